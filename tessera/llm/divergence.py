"""Source divergence audit: how far the term use of each source of a language lies from the other sources' and the language's.

Terms are runs of ASCII letters (A-Z count as a-z) and bytes from 0x80 on. A language keeps the terms in at least `least_docs` of
its documents, V of them. A group is a (lang, source), or a language as a whole; with N occurrences of kept terms it gives each
kept term of `count` occurrences p = 1 + floor(10**9 * (count + 2) / (N + 2 * V)), and f(p, q) = floor((p - q)**2 / (p + q)).

Part `pair`: each other source of the language, by the sum of f over all kept terms. Part `term`: the kept terms that the group has
and uses more than its language (p > q), by f, the first `top`. Ranks: value descending, then UTF-8 order of the item.

Terms are counted once, with map-side sums. Kept terms are dealt into chunks by hash, so a language with most of the rows is
many tasks, each with a bounded part of its dictionary. A chunk's terms are a sorted array; searchsorted gives their ids, which are
in UTF-8 order, and bincount makes a dense row of counts for each source. Sources beyond BLOCK are dealt into blocks, each pair of
which is a group; what the terms that neither block has add is the same for each pair of sources, and comes in at the end.

Integers throughout: exact as long as N + 2 * V is under 2**53. Null lang, source and text count as ''. Repeated rows count each.
A group without terms has all pairs; V = 0 gives the value 0. doc_id isn't read, extra columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import Scratch
from .textops import small

SCALE = 10**9
LEAST_DOCS, TOP = 10, 10
#: Sources in a block; counts in a chunk's dense rows, about; terms a task holds before it hands its sums on.
BLOCK, DENSE, HELD = 256, 1 << 17, 200_000
#: A long text is split into words by pieces of about so many bytes.
PIECE = 1 << 20
#: Rows of one language meet the row of that language in so many shares.
SHARES = 64
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of bounded size but for a single longer term."""
    text, at = text.translate(_TERM), 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that have it)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple[str, str], Counter] = {}
        docs: dict[tuple[str, str], Counter] = {}

        def sums() -> Iterator[pa.RecordBatch]:
            for (lang, source), own in n.items():
                seen = docs[lang, source]
                names = list(own)
                for a in range(0, len(names), 50_000):
                    part = names[a : a + 50_000]
                    columns = [pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()), pa.array(part, pa.binary()).cast(pa.string()), pa.array([own[t] for t in part], pa.int64()), pa.array([seen[t] for t in part], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
            n.clear()
            docs.clear()

        held = 0
        for batch in small(batches):
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                own, seen = n.setdefault((lang, source), Counter()), docs.setdefault((lang, source), Counter())
                held -= len(own)
                found: Counter = Counter()
                for words in terms(text.encode()):
                    found.update(words)
                own.update(found)
                seen.update(found.keys())
                held += len(own)
                if held > HELD:
                    yield from sums()
                    held = 0
        yield from sums()

    return docs.mapInArrow(count, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def with_language(rows: DataFrame, langs: DataFrame) -> DataFrame:
    """rows with the columns of their language's one row in langs, in shares, so that no language is one task."""
    share = F.pmod(F.xxhash64(*rows.columns), F.lit(SHARES))
    spread = langs.withColumn("_share", F.explode(F.expr(f"sequence(0L, {SHARES - 1}L)")))
    return rows.withColumn("_share", share).join(spread, ["lang", "_share"]).drop("_share")


def scaled(count: np.ndarray, n: int, v: int) -> np.ndarray:
    """1 + floor(10**9 * (count + 2) / (n + 2 * v)) by long division in thousands, as the product may not fit 64 bits."""
    rest, out, d = count + 2, np.zeros_like(count), n + 2 * v
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // d
        rest = rest % d
    return out + 1


def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


_PART = "lang string, source string, part string, item string, value long, rest long"


def chunk_part(key: tuple, rows: pa.Table) -> pa.Table:
    """Of a chunk of a language's terms and a pair of its blocks of sources: what each pair of sources gets, and each source's first terms.

    rows: an entry for each source and term (n, all: the language's n), and, with null term, one for each source (n: its N, all:
    the language's N, v: V). `rest` of a pair is V * f of two terms that neither source has; `value` is what the chunk's terms differ from it.
    """
    first, second = key[2].as_py(), key[3].as_py()
    term = rows.column("term").combine_chunks()
    total = rows.filter(term.is_null())
    names = total.column("source").to_pylist()
    order = sorted(range(len(names)), key=lambda k: names[k].encode())
    sources = [names[k] for k in order]
    sums, blocks = (total.column(c).to_numpy()[order] for c in ("n", "block"))
    v, language = total.column("v")[0].as_py(), total.column("all")[0].as_py()
    entries = rows.filter(term.is_valid())
    own = np.array(entries.column("term").cast(pa.binary()).to_pylist(), object)
    kept = np.array(sorted(set(own)), object)
    ids = np.searchsorted(kept, own) if len(kept) else np.zeros(0, np.int64)
    place = {s: k for k, s in enumerate(sources)}
    who = np.array([place[s] for s in entries.column("source").to_pylist()], np.int64)
    shape = len(sources), len(kept)
    counts = np.bincount(who * len(kept) + ids, entries.column("n").to_numpy(), len(sources) * len(kept)).astype(np.int64).reshape(shape)
    out: dict[str, list] = {c: [] for c in ("source", "part", "item", "value", "rest")}

    def put(*row) -> None:
        for c, x in zip(out, row, strict=True):
            out[c].append(x)

    if v:
        p = np.stack([scaled(c, int(n), v) for c, n in zip(counts, sums, strict=True)])
        none = scaled(np.zeros(len(sources), np.int64), 0, 1) if not len(sources) else np.array([int(scaled(np.zeros(1, np.int64), int(n), v)[0]) for n in sums], np.int64)
    for a in range(len(sources)):
        others = np.arange(a + 1, len(sources)) if first == second else np.flatnonzero(blocks == second) if blocks[a] == first else np.zeros(0, np.int64)
        if not len(others):
            continue
        alone = f(none[a], none[others]) if v else np.zeros(len(others), np.int64)
        value = f(p[a], p[others]).sum(1) - alone * len(kept) if v else alone
        for b, x, y in zip(others.tolist(), value.tolist(), (alone * v).tolist(), strict=True):
            put(sources[a], "pair", sources[b], x, y)
    if first == second and len(kept):
        every = np.zeros(len(kept), np.int64)
        every[ids] = entries.column("all").to_numpy()
        q = scaled(every, language, v)
        for a, s in enumerate(sources):
            more = np.flatnonzero((counts[a] > 0) & (p[a] > q))
            value = f(p[a][more], q[more])
            for k in np.argsort(-value, kind="stable")[:TOP].tolist():  # ids ascend, so ties stand in order
                put(s, "term", kept[more[k]].decode(), int(value[k]), 0)
    columns = [pa.array([key[0].as_py()] * len(out["value"]), pa.string()), *(pa.array(out[c], pa.int64() if c in ("value", "rest") else pa.string()) for c in out)]
    return pa.Table.from_arrays(columns, names=["lang", *out])


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, part, item, value, rank."""
    scratch = Scratch(docs.sparkSession, "divergence")
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = scratch.keep(term_counts(docs), "counts")
    kept = scratch.keep(counts.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs"), "kept")
    groups = scratch.keep(docs.select("lang", "source").distinct(), "groups")
    langs = groups.groupBy("lang").agg(F.count("*").alias("s")).join(kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("language")), "lang", "left")
    langs = langs.select("lang", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("language", F.lit(0)).alias("language"), F.ceil(F.col("s") / BLOCK).alias("blocks"), F.least("s", F.lit(2 * BLOCK)).alias("wide"))
    langs = scratch.keep(langs.select("lang", "v", "language", "blocks", F.greatest(F.lit(1), F.ceil(F.col("v") * F.col("wide") / DENSE)).alias("chunks")), "langs")
    block = F.pmod(F.xxhash64("source"), F.col("blocks"))
    where = with_language(kept, langs.select("lang", "blocks", "chunks")).select("lang", "term", "all", "blocks", F.pmod(F.xxhash64("term"), F.col("chunks")).alias("chunk"))
    entries = scratch.keep(counts.select("lang", "source", "term", "n").join(where, ["lang", "term"]).select("lang", "chunk", "source", "term", "n", "all", "blocks", block.alias("block")), "entries")
    sums = groups.join(entries.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left")
    sums = with_language(sums.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n")), langs)
    totals = sums.select("lang", F.explode(F.expr("sequence(0L, chunks - 1L)")).alias("chunk"), "source", F.lit(None).cast("string").alias("term"), "n", F.col("language").alias("all"), "blocks", block.alias("block"), "v")
    rows = entries.withColumn("v", F.lit(0).cast("long")).unionByName(totals)
    other = F.explode(F.expr("sequence(0L, blocks - 1L)"))
    rows = rows.withColumn("other", other).select("lang", "chunk", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "source", "term", "n", "all", "block", "v")
    found = scratch.keep(rows.groupBy("lang", "chunk", "b1", "b2").applyInArrow(chunk_part, _PART), "found")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "item").agg((F.sum("value") + F.max("rest")).alias("value"))
    sides = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("x")
    pairs = pairs.select("lang", sides, "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(by))
    firsts = found.where("part = 'term'").select("lang", "source", "part", "item", "value").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= TOP)
    return pairs.unionByName(firsts)


#: DuckDB SQL for audit(documents).
SQL = f"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS term FROM d),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS docs FROM t GROUP BY lang, source, term),
k AS MATERIALIZED (SELECT lang, term, sum(n)::BIGINT AS every FROM c GROUP BY lang, term HAVING sum(docs) >= {LEAST_DOCS}),
v AS (SELECT lang, count(*) AS v, sum(every)::HUGEINT AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS n FROM g LEFT JOIN (SELECT lang, source, n FROM c JOIN k USING (lang, term)) USING (lang, source) GROUP BY lang, source),
p AS MATERIALIZED (SELECT gn.lang, gn.source, k.term, coalesce(c.n, 0) AS count, 1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + 2)) // (gn.n + 2 * v.v) AS p, 1 + ({SCALE}::HUGEINT * (k.every + 2)) // (v.n + 2 * v.v) AS q
  FROM gn JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE count > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found) WHERE part = 'pair' OR rank <= {TOP}"""
