"""Layers on the embeddings table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import tensor
from tessera.plans.base import query, spread, table

_X = "e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings)"


def _weight(rows: int, cols: int, a: int, b: int) -> list[list[float]]:
    """A fixed matrix: ((i * a + j * b) mod 13 - 6) / 10."""
    return [[((i * a + j * b) % 13 - 6) / 10.0 for j in range(cols)] for i in range(rows)]


def _sql_weight(rows: int, cols: int, a: int, b: int) -> str:
    return "[" + ", ".join("[" + ", ".join(f"{v}::DOUBLE" for v in r) + "]" for r in _weight(rows, cols, a, b)) + "]"


def _sql_linear(x: str, w: str) -> str:
    return f"list_transform({w}, lambda w: list_dot_product({x}, w))"


def _round(c, n=6):
    return F.transform(c, lambda v: F.round(v, n) + 0.0)


_ROUND = "list_transform({}, lambda v: round(v, 6) + 0.0)"


def _vectors(spark, d):
    return spread(table(spark, d, "embeddings")).select("vec_id", tensor.doubles("embedding").alias("x"))


@query(f"WITH {_X} SELECT vec_id, {_ROUND.format(_sql_linear('x', _sql_weight(16, 64, 31, 17)))} AS y FROM e")
def linear(spark, d):
    return _vectors(spark, d).select("vec_id", _round(tensor.linear(F.col("x"), tensor.matrix(_weight(16, 64, 31, 17)))).alias("y"))


@query(f"WITH {_X} SELECT vec_id, {_ROUND.format('list_transform(x, lambda v, i: v / sqrt(list_dot_product(x, x) / 64 + 1e-5::DOUBLE) * (1 + i / 64.0::DOUBLE))')} AS y FROM e")
def rms_norm(spark, d):
    gain = F.array(*[F.lit(1 + (i + 1) / 64.0) for i in range(64)])
    return _vectors(spark, d).select("vec_id", _round(tensor.rms_norm(F.col("x"), gain)).alias("y"))


_ANGLE = "(vec_id * pow(10000::DOUBLE, -2.0::DOUBLE * ((i - 1) // 2) / 64))"


@query(f"WITH {_X} SELECT vec_id, list(round(CASE WHEN i % 2 = 1 THEN x[i] * cos{_ANGLE} - x[i + 1] * sin{_ANGLE} ELSE x[i - 1] * sin{_ANGLE} + x[i] * cos{_ANGLE} END, 6) + 0.0 ORDER BY i) AS y FROM e, unnest(range(1, 65)) u(i) GROUP BY vec_id")
def rope(spark, d):
    return _vectors(spark, d).select("vec_id", _round(tensor.rope(F.col("x"), F.col("vec_id"), 64)).alias("y"))


_G = _sql_linear("x", _sql_weight(32, 64, 7, 11))
_H = _sql_linear("x", _sql_weight(32, 64, 5, 3))


@query(f"WITH {_X}, h AS (SELECT vec_id, {_G} AS g, {_H} AS h FROM e), s AS (SELECT vec_id, list_transform(g, lambda v, i: v / (1 + exp(-v)) * h[i]) AS s FROM h) SELECT vec_id, {_ROUND.format(_sql_linear('s', _sql_weight(64, 32, 3, 7)))} AS y FROM s")
def swiglu(spark, d):
    w = [tensor.matrix(_weight(*a)) for a in ((32, 64, 7, 11), (32, 64, 5, 3), (64, 32, 3, 7))]
    x = _vectors(spark, d).withColumn("s", F.zip_with(tensor.linear(F.col("x"), w[0]), tensor.linear(F.col("x"), w[1]), lambda g, h: tensor.silu(g) * h))
    return x.select("vec_id", _round(tensor.linear(F.col("s"), w[2])).alias("y"))


def _attention_sql(real: str = "true", groups: int = 1) -> str:
    return f"""WITH {_X}, r AS (SELECT vec_id // 50 AS seq, h AS head, vec_id % 50 AS pos, x[h * 16 + 1 : h * 16 + 16] AS q, x[(h // {groups}) * 16 + 17 : (h // {groups}) * 16 + 32] AS k, x[(h // {groups}) * 8 + 1 : (h // {groups}) * 8 + 8] AS v FROM e, unnest([0, 1]) u(h)),
    s AS (SELECT a.seq, a.head, a.pos, list_dot_product(a.q, b.k) / sqrt(16) AS s, b.v FROM r a JOIN r b ON a.seq = b.seq AND a.head = b.head AND b.pos <= a.pos WHERE {real}),
    w AS (SELECT seq, head, pos, v, exp(s - max(s) OVER (PARTITION BY seq, head, pos)) AS e FROM s)
    SELECT seq, head::INT AS head, pos, [{", ".join(f"round(sum(e * v[{j}]) / sum(e), 6) + 0.0" for j in range(1, 9))}] AS y FROM w GROUP BY seq, head, pos"""


def _heads(spark, d, groups: int = 1):
    x = F.col("x")
    rows = []
    for h in range(2):
        own = h % groups == 0  # with groups, only every groups-th head has keys of its own
        g = h // groups
        k = F.slice(x, g * 16 + 17, 16) if groups == 1 or own else F.lit(None).cast("array<double>")
        rows.append(F.struct(F.lit(h).alias("head"), F.slice(x, h * 16 + 1, 16).alias("q"), k.alias("k"), F.slice(x, g * 8 + 1, 8).alias("v")))
    t = _vectors(spark, d).select(F.floor(F.col("vec_id") / 50).alias("seq"), (F.col("vec_id") % 50).alias("pos"), F.explode(F.array(*rows)).alias("h"))
    return t.select("seq", "pos", "h.*", F.lit(True).alias("real"))


def _out(a):
    return a.select("seq", "head", "pos", _round(F.col("out")).alias("y"))


@query(_attention_sql())
def causal_attention(spark, d):
    return _out(tensor.attention(_heads(spark, d)))


@query(_attention_sql())
def chunked_attention(spark, d):
    return _out(tensor.attention(_heads(spark, d), chunk=16))


@query(_attention_sql("b.pos < 40 OR b.pos = a.pos"))
def masked_attention(spark, d):
    """Places from 40 on are padding; a padded query still sees itself, so that it has a value."""
    rows = _heads(spark, d)
    real = tensor.attention(rows.withColumn("real", F.col("pos") < 40)).where("pos < 40")
    rest = tensor.attention(_own_key(rows)).where("pos >= 40").withColumn("seq", F.col("seq.seq"))
    return _out(real.unionByName(rest))


def _own_key(rows):
    """Each padded query in a sequence of its own, with the real keys and itself."""
    pad = rows.where("pos >= 40").select("seq", F.col("pos").alias("own"), "head").distinct()
    all_ = rows.join(pad, ["seq", "head"]).where("pos < 40 or pos = own")
    return all_.withColumn("seq", F.struct("seq", "own"))


@query(_attention_sql(groups=2))
def gqa_attention(spark, d):
    """Two query heads on one key head."""
    rows = _heads(spark, d, groups=2)
    return _out(tensor.attention(rows, groups=2))


#: The layers' fixed weights: rows, columns and two factors of ((i * a + j * b) mod 13 - 6) / 10, scaled by a tenth.
_LAYER = {"q": (64, 64, 3, 5), "k": (32, 64, 5, 7), "v": (32, 64, 7, 3), "o": (64, 64, 2, 9), "w1": (96, 64, 7, 11), "w3": (96, 64, 5, 3), "w2": (64, 96, 3, 7)}
_HEADS, _KV_HEADS = 4, 2


def _made(rows: int, cols: int, a: int, b: int) -> np.ndarray:
    i, j = np.ogrid[:rows, :cols]
    return ((i * a + j * b) % 13 - 6) / 100.0


def _sql_made(rows: int, cols: int, a: int, b: int) -> str:
    return f"list_transform(range({rows}), lambda i: list_transform(range({cols}), lambda j: ((i * {a} + j * {b}) % 13 - 6)::DOUBLE / 100))"


def _sql_block(given: str, out: str) -> str:
    """CTEs of a block from given(seq, pos, x) to out(seq, pos, x); w has the weights."""
    norm = "list_transform({0}, lambda v: v / sqrt(list_sum(list_transform({0}, lambda u: u * u)) / len({0}) + 1e-5::DOUBLE))".format
    times = "list_transform(w.{1}, lambda r: list_dot_product({0}, r))".format
    turn = "list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 1 THEN {0}[i] * cos(pos * pow(10000.0::DOUBLE, -((i - 1) // 2 * 2) / 16.0::DOUBLE)) - {0}[i + 1] * sin(pos * pow(10000.0::DOUBLE, -((i - 1) // 2 * 2) / 16.0::DOUBLE)) ELSE {0}[i - 1] * sin(pos * pow(10000.0::DOUBLE, -((i - 1) // 2 * 2) / 16.0::DOUBLE)) + {0}[i] * cos(pos * pow(10000.0::DOUBLE, -((i - 1) // 2 * 2) / 16.0::DOUBLE)) END)".format
    return f"""{out}_n AS MATERIALIZED (SELECT seq, pos, x, {norm('x')} AS n FROM {given}),
    {out}_p AS MATERIALIZED (SELECT seq, pos, {times('n', 'q')} AS q, {times('n', 'k')} AS k, {times('n', 'v')} AS v FROM {out}_n, w),
    {out}_h AS MATERIALIZED (SELECT seq, pos, h, {turn('q')} AS q, {turn('k')} AS k, v FROM (SELECT seq, pos, h, q[h * 16 + 1 : h * 16 + 16] AS q, k[h // 2 * 16 + 1 : h // 2 * 16 + 16] AS k, v[h // 2 * 16 + 1 : h // 2 * 16 + 16] AS v FROM {out}_p, unnest([0, 1, 2, 3]) u(h))),
    {out}_s AS (SELECT a.seq, a.h, a.pos, list_dot_product(a.q, b.k) / 4 AS s, b.v FROM {out}_h a JOIN {out}_h b ON a.seq = b.seq AND a.h = b.h AND b.pos <= a.pos),
    {out}_e AS (SELECT seq, h, pos, v, exp(s - max(s) OVER (PARTITION BY seq, h, pos)) AS e FROM {out}_s),
    {out}_a AS (SELECT seq, h, pos, [{', '.join(f'sum(e * v[{j}]) / sum(e)' for j in range(1, 17))}] AS y FROM {out}_e GROUP BY seq, h, pos),
    {out}_c AS MATERIALIZED (SELECT seq, pos, flatten(list(y ORDER BY h)) AS a FROM {out}_a GROUP BY seq, pos),
    {out}_r AS MATERIALIZED (SELECT seq, pos, list_transform({times('a', 'o')}, lambda v, i: v + x[i]) AS x FROM {out}_c JOIN {out}_n USING (seq, pos), w),
    {out}_m AS MATERIALIZED (SELECT seq, pos, x, {times('n', 'w1')} AS g, {times('n', 'w3')} AS u FROM (SELECT seq, pos, x, {norm('x')} AS n FROM {out}_r), w),
    {out} AS MATERIALIZED (SELECT seq, pos, list_transform({times('f', 'w2')}, lambda v, i: v + x[i]) AS x FROM (SELECT seq, pos, x, list_transform(g, lambda v, i: v / (1 + exp(-v)) * u[i]) AS f FROM {out}_m), w)"""


_SQL_LAYERS = f"WITH {_X}, w AS MATERIALIZED (SELECT " + ", ".join(f"{_sql_made(*a)} AS {c}" for c, a in _LAYER.items()) + f"), x0 AS (SELECT vec_id // 50 AS seq, vec_id % 50 AS pos, x FROM e), {_sql_block('x0', 'x1')}"


def _hidden(spark, d):
    return _vectors(spark, d).select(F.floor(F.col("vec_id") / 50).alias("seq"), (F.col("vec_id") % 50).alias("pos"), "x", F.lit(True).alias("real"))


def _block(rows, chunk=None):
    return tensor.transformer_block(rows, {c: _made(*a) for c, a in _LAYER.items()}, _HEADS, _KV_HEADS, chunk)


@query(f"{_SQL_LAYERS} SELECT seq, pos, {_ROUND.format('x')} AS y FROM x1")
def transformer_block(spark, d):
    """A pre-norm block with rotated grouped-query attention and SwiGLU on sequences of fifty vectors."""
    return _block(_hidden(spark, d), 16).select("seq", "pos", _round(F.col("x")).alias("y"))


@query(f"""{_SQL_LAYERS}, {_sql_block('x1', 'x2')}, head AS (SELECT vec_id AS id, x AS vector FROM e WHERE vec_id < 32), goal AS (SELECT vec_id // 50 AS seq, vec_id % 50 AS pos, lead(vec_id % 32) OVER (PARTITION BY vec_id // 50 ORDER BY vec_id) AS target FROM e),
z AS (SELECT seq, pos, target, id, list_dot_product(list_transform(x, lambda v: v / sqrt(list_sum(list_transform(x, lambda u: u * u)) / len(x) + 1e-5::DOUBLE)), vector) AS z FROM x2 JOIN goal USING (seq, pos), head WHERE target IS NOT NULL),
m AS (SELECT *, max(z) OVER (PARTITION BY seq, pos) AS m FROM z)
SELECT seq, pos, target, round(max(m) + ln(sum(exp(z - m))) - max(z) FILTER (id = target), 6) AS loss FROM m GROUP BY seq, pos, target""")
def language_model_loss(spark, d):
    """Two blocks, a norm and a head tied to the first 32 vectors: the loss of each place's next id."""
    e = _vectors(spark, d)
    goal = e.select(F.floor(F.col("vec_id") / 50).alias("seq"), (F.col("vec_id") % 50).alias("pos"), (F.col("vec_id") % 32).alias("own"))
    after = goal.select("seq", (F.col("pos") - 1).alias("pos"), F.col("own").alias("target"))
    rows = _block(_block(_hidden(spark, d))).join(after, ["seq", "pos"])
    head = np.array([r["x"] for r in e.where("vec_id < 32").orderBy("vec_id").collect()])  # the head's 32 rows
    return tensor.next_token_loss(rows, head).withColumn("loss", F.round("loss", 6))


@query("SELECT d.doc_id, e.vec_id, e.label, round(list_sum(e.embedding)::DOUBLE, 4) AS total FROM documents d JOIN embeddings e ON e.vec_id = d.n_chars % 500")
def embedding_lookup(spark, d):
    docs = table(spark, d, "documents").select("doc_id", (F.col("n_chars") % 500).alias("vec_id"))
    e = table(spark, d, "embeddings").select("vec_id", "label", F.round(F.aggregate(tensor.doubles("embedding"), F.lit(0.0), lambda s, x: s + x), 4).alias("total"))
    return docs.join(e, "vec_id").select("doc_id", "vec_id", "label", "total")


_PARAMS = f"{_X}, p AS (SELECT vec_id, i, x[i] AS theta, x[65 - i] AS grad, x[i] / 10 AS m, x[i] * x[i] AS v, vec_id % 5 AS t FROM e, unnest(range(1, 65)) u(i))"


@query(f"""WITH {_PARAMS}, s AS (SELECT vec_id, i, theta, t + 1 AS t, 0.9::DOUBLE * m + (1 - 0.9::DOUBLE) * grad AS m, 0.95::DOUBLE * v + (1 - 0.95::DOUBLE) * grad * grad AS v FROM p)
SELECT vec_id, i - 1 AS i, t, round((theta - 1e-3::DOUBLE * sqrt(1 - pow(0.95::DOUBLE, t)) / (1 - pow(0.9::DOUBLE, t)) * m / (sqrt(v) + 1e-8::DOUBLE)) * (1 - 1e-3::DOUBLE * 0.1::DOUBLE), 9) AS theta, round(m, 9) AS m, round(v, 9) AS v FROM s""")
def adamw_step(spark, d):
    p = _vectors(spark, d).select("vec_id", F.posexplode("x").alias("i", "theta"), "x")
    p = p.select("vec_id", F.col("i").cast("long").alias("i"), "theta", F.expr("element_at(x, 64 - i)").alias("grad"), (F.col("theta") / 10).alias("m"), (F.col("theta") * F.col("theta")).alias("v"), (F.col("vec_id") % 5).alias("t"))
    s = tensor.adamw(p, 1e-3, 0.9, 0.95, 1e-8, 0.1)
    return s.select("vec_id", "i", "t", *[F.round(c, 9).alias(c) for c in ("theta", "m", "v")])


@query("WITH p AS MATERIALIZED (SELECT vec_id, unnest(list_reverse(x)) AS grad, unnest(range(len(x))) AS i FROM (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings)), n AS MATERIALIZED (SELECT sqrt(sum(grad * grad)) AS norm FROM p) SELECT vec_id, i, round(norm, 6) AS norm, round(CASE WHEN norm > 1 THEN grad * (1 / (norm + 1e-6::DOUBLE)) ELSE grad END, 9) AS grad FROM p, n")
def clip_grad_norm(spark, d):
    p = _vectors(spark, d).select("vec_id", F.posexplode(F.reverse("x")).alias("i", "grad"))
    return tensor.clip_norm(p, 1.0).select("vec_id", F.col("i").cast("long").alias("i"), F.round("norm", 6).alias("norm"), F.round("grad", 9).alias("grad"))
