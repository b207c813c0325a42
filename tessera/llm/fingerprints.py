"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests. DataFrame functions only.

A text is cut at line feeds and after sentence ends; the distinct non-empty pieces' 64-bit hashes are
its digests. A sketch has CELLS cells of (count, xor of digests, xor of checks); each digest is in one
cell of each third. Equal texts have equal sketches. Two sketches subtract cell by cell, which leaves
the digests that differ; peeling takes a cell of one digest, removes it from its other cells, and goes
on until nothing is left. If it gets stuck, the retry is larger: the digests are dealt out by hash to
sub-sketches for about SHARE digests each, and a sub-sketch that still fails is built anew with other
hashes at twice the cells, up to RETRIES times. Only after that are its digests compared outright.

The likeness of two texts is |common digests| / |digests of either|, and 1 for two without any.
Null text counts as empty. Rows with equal doc_id stand in the order of a hash of their text. A
single row is its own next. Null doc_ids come first. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import parts

CELLS, SHARE, RETRIES = 48, 8, 4
#: Peeling that takes more rounds than this counts as stuck; the retry has more cells.
ROUNDS = 8
PIECE_ENDS = r"\\n|(?<=[.!?]) "


def _let(value: str, name: str, body: str) -> str:
    """body with `name` bound to value, which is worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _spots(x: str, m: int, salt: int) -> str:
    """SQL fields p0, p1, p2: a digest's place in each third."""
    return ", ".join(f"'p{k}', cast(pmod(xxhash64({x}, {salt * 8 + k}), {m // 3}) as int)" for k in range(3))


def _check(x: str) -> str:
    return f"(xxhash64({x}, 99) & 4294967295L)"


_ZERO = "named_struct('c', 0L, 'x', 0L, 'y', 0L)"


def digests(text: str) -> str:
    """SQL for the distinct digests of a text."""
    return f"array_distinct(transform(filter(split({text}, '{PIECE_ENDS}'), p -> length(trim(p)) > 0), p -> xxhash64(trim(p))))"


def sketch(signed: str, m: int = CELLS, salt: int = 0) -> str:
    """SQL for the cells of an array of (c, x): signs and digests."""
    hits = f"transform({signed}, e -> named_struct('c', e.c, 'x', e.x, 'y', {_check('e.x')}, {_spots('e.x', m, salt)}))"
    thirds = [f"transform(sequence(0, {m // 3 - 1}), j -> aggregate(filter(h, e -> e.p{k} = j), {_ZERO}, (s, e) -> named_struct('c', s.c + e.c, 'x', s.x ^ e.x, 'y', s.y ^ e.y)))" for k in range(3)]
    return _let(hits, "h", f"concat({', '.join(thirds)})")


def signed(array: str, sign: int) -> str:
    return f"transform({array}, x -> named_struct('c', {sign}L, 'x', x))"


def minus(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (u, v) -> named_struct('c', u.c - v.c, 'x', u.x ^ v.x, 'y', u.y ^ v.y))"


def peel(cells: str, m: int = CELLS, salt: int = 0) -> str:
    """SQL for the (c, x) that the cells hold: signs and digests; null (whose size is null) if peeling gets stuck."""
    pure = f"array_distinct(transform(filter(s.t, w -> abs(w.c) = 1 and w.y = {_check('w.x')}), w -> named_struct('c', w.c, 'x', w.x)))"
    placed = f"transform(q, e -> named_struct('c', e.c, 'x', e.x, 'y', {_check('e.x')}, {_spots('e.x', m, salt)}))"
    thirds = [f"transform(slice(s.t, {k * (m // 3) + 1}, {m // 3}), (w, j) -> aggregate(filter(r, e -> e.p{k} = j), w, (v, e) -> named_struct('c', v.c - e.c, 'x', v.x ^ e.x, 'y', v.y ^ e.y)))" for k in range(3)]
    left = f"concat({', '.join(thirds)})"
    step = _let(pure, "q", f"if(size(q) = 0, s, named_struct('t', {_let(placed, 'r', left)}, 'f', concat(s.f, q)))")
    start = f"named_struct('t', {cells}, 'f', filter(array(named_struct('c', 0L, 'x', 0L)), e -> false))"
    done = f"aggregate(sequence(1, {ROUNDS}), {start}, (s, i) -> {step})"
    return _let(done, "z", "if(exists(z.t, w -> w.c <> 0 or w.x <> 0 or w.y <> 0), null, z.f)")


def _sub_difference(entries: str) -> str:
    """SQL for the number of digests that differ in a share of both versions' signed digests."""
    tries = []
    for k in range(RETRIES):
        m = 24 << k
        tries.append(f"size({peel(sketch(entries, m, k + 1), m, k + 1)})")
    outright = f"size(filter(transform({entries}, e -> e.x), x -> size(filter({entries}, o -> o.x = x)) = 1))"
    return f"coalesce({', '.join(tries)}, {outright})"


def larger_difference(a: str, b: str) -> str:
    """SQL for the number of differing digests of two digest arrays, by sub-sketches; two levels of dealing keep it near linear."""
    both = f"concat({signed(a, 1)}, {signed(b, -1)})"
    groups = "transform(sequence(1, cast(ceil(sqrt(size(l) / " + str(SHARE) + ".0D)) as int)), g -> filter(l, e -> pmod(xxhash64(e.x, 71), ceil(sqrt(size(l) / " + str(SHARE) + ".0D))) = g - 1))"
    shares = f"transform(sequence(1, cast(greatest(1, ceil(size(k) / {SHARE}.0D)) as int)), g -> filter(k, e -> pmod(xxhash64(e.x, 73), greatest(1, ceil(size(k) / {SHARE}.0D))) = g - 1))"
    split = f"flatten(transform({groups}, k -> {shares}))"
    total = f"aggregate({split}, 0L, (n, v) -> n + {_sub_difference('v')})"
    return f"if(size({a}) + size({b}) = 0, 0L, {_let(both, 'l', total)})"


def likeness(a: str, b: str, cells_a: str, cells_b: str) -> str:
    """SQL for the likeness of two texts from their sketches; the digest arrays serve the retries."""
    differ = f"coalesce(cast(size({peel(minus(cells_a, cells_b))}) as bigint), {larger_difference(a, b)})"
    return f"if({cells_a} = {cells_b} and size({a}) = size({b}), 1D, {_let(differ, 'gap', f'(size({a}) + size({b}) - gap) / 2D / ((size({a}) + size({b}) - gap) / 2D + gap)')})"


def as_text(cells: str) -> str:
    return f"array_join(transform({cells}, w -> concat_ws('.', w.c, lower(hex(w.x)), lower(hex(w.y)))), '|')"


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text (in ascending doc_id order; the first after the last), and bucket, turn, tail.

    Buckets are ranges of doc_id between quantiles, so one exchange by bucket serves every later
    step; each bucket also gets the first row of the next one, as its tail.
    """
    spark = docs.sparkSession
    n = parts(spark)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bounds = own.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)] or [0.5], 10_000).alias("b")).first()["b"] or []
    bounds = sorted(set(bounds))  # at most a value for each partition
    step = max(1, int(len(bounds) ** 0.5))
    fine = "array(" + ", ".join(f"{b}L" for b in bounds) + ")" if bounds else "cast(array() as array<bigint>)"
    rough = "array(" + ", ".join(f"{b}L" for b in bounds[step - 1 :: step]) + ")" if bounds else fine
    at = _let(f"size(filter({rough}, b -> b < doc_id))", "r", f"r * {step} + size(filter(slice({fine}, r * {step} + 1, {step}), b -> b < doc_id))")
    own = own.withColumn("bucket", F.coalesce(F.expr(at), F.lit(0)).cast("int")).withColumn("tie", F.xxhash64("text"))
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    heads = own.groupBy("bucket").agg(F.min(F.struct(key.alias("k"), "tie")).alias("h")).orderBy("bucket").select("bucket", "h.k", "h.tie").collect()  # a row for each bucket
    before = [(h["k"], h["tie"], heads[i - 1]["bucket"]) for i, h in enumerate(heads)]
    heads = spark.createDataFrame(before, "k long, tie long, before int")
    own = own.withColumn("k", key).join(F.broadcast(heads), ["k", "tie"], "left")
    to = F.expr("if(before is null, array(struct(bucket as bucket, 0 as tail)), array(struct(bucket as bucket, 0 as tail), struct(before as bucket, 1 as tail)))")
    own = own.select("k", "doc_id", "tie", "text", F.explode(to).alias("to")).select("k", "doc_id", "tie", "text", "to.bucket", "to.tail")
    w = Window.partitionBy("bucket").orderBy("tail", "k", "tie")
    own = own.repartition(n, "bucket")
    return own.withColumn("next_text", F.lead("text").over(w)).withColumn("turn", F.row_number().over(w))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and the number of pieces."""
    rows = with_next(docs)
    half = "cast(char_length(text) div 2 as int)"
    rows = rows.withColumn("edited", F.expr(f"concat(substring(text, 1, char_length(text) - {half}), substring(coalesce(next_text, ''), 1, {half}))"))
    rows = rows.select("bucket", "tail", "turn", "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.expr(digests("text")).alias("own_set"), F.expr(digests("edited")).alias("edited_set"))
    rows = rows.select("*", F.expr(sketch(signed("own_set", 1))).alias("own_cells"), F.expr(sketch(signed("edited_set", 1))).alias("edited_cells"))
    w = Window.partitionBy("bucket").orderBy("turn")
    rows = rows.select("*", F.lead("own_set").over(w).alias("next_set"), F.lead("own_cells").over(w).alias("next_cells")).where("tail = 0")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256",
        F.expr(as_text("own_cells")).alias("fingerprint"), F.expr(as_text("edited_cells")).alias("edited_fingerprint"),
        F.expr(likeness("own_set", "edited_set", "own_cells", "edited_cells")).alias("near_edited"), F.expr(likeness("own_set", "next_set", "own_cells", "next_cells")).alias("near_next"),
        F.size("own_set").cast("long").alias("n_pieces"),
    )
