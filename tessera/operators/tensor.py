"""Layers of a transformer over array columns: each row is a vector at a place of a sequence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import dot
from tessera.sources.scratch import small_batches


def doubles(x: str | Column) -> Column:
    return F.transform(x, lambda v: v.cast("double"))


def matrix(rows: list[list[float]]) -> Column:
    """A small weight matrix as a literal array of rows."""
    return F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in rows])


def linear(x: Column, weight: Column) -> Column:
    """weight @ x, without a bias."""
    return F.transform(weight, lambda w: dot(x, w))


def rms_norm(x: Column, gain: Column, eps: float = 1e-5) -> Column:
    scale = 1 / F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v) / F.size(x) + eps)
    return F.zip_with(x, gain, lambda v, g: v * scale * g)


def rope(x: Column, pos: Column, d: int, theta: float = 10000.0) -> Column:
    """Rotates the pairs (2k, 2k + 1) of a vector of d numbers by pos * theta**(-2k / d)."""
    out = []
    for k in range(d // 2):
        a = pos * F.lit(theta ** (-2.0 * k / d))
        even, odd = F.element_at(x, 2 * k + 1), F.element_at(x, 2 * k + 2)
        out += [even * F.cos(a) - odd * F.sin(a), even * F.sin(a) + odd * F.cos(a)]
    return F.array(*out)


def silu(x: Column) -> Column:
    return x / (1 + F.exp(-x))


def swiglu(x: Column, w1: Column, w3: Column, w2: Column) -> Column:
    """w2 @ (silu(w1 @ x) * (w3 @ x))."""
    return linear(F.zip_with(linear(x, w1), linear(x, w3), lambda g, h: silu(g) * h), w2)


def _partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row, a block of queries and a block of keys before or at them: each query's largest score, and the sum of weights
    and of weighted values relative to it."""

    def block(batch: pa.RecordBatch, name: str, k: int) -> np.ndarray:
        rows = batch.column(name)[k].values
        return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)

    for batch in batches:
        out = {c: [] for c in ("pos", "top", "total", "sum")}
        for k in range(len(batch)):
            q, keys, values = (block(batch, c, k) for c in ("qs", "ks", "vs"))
            pos, at = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("poss", "ats"))
            scores = np.where(at[None, :] <= pos[:, None], q @ keys.T / np.sqrt(q.shape[1]), -np.inf)
            seen = np.isfinite(scores).any(1)
            scores, pos = scores[seen], pos[seen]
            top = scores.max(1, initial=-np.inf)
            weights = np.exp(scores - top[:, None])
            out["pos"].append(pos.tolist())
            out["top"].append(top.tolist())
            out["total"].append(weights.sum(1).tolist())
            out["sum"].append((weights @ values).tolist())
        kinds = {"pos": pa.list_(pa.int64()), "sum": pa.list_(pa.list_(pa.float64()))}
        columns = [pa.array(x, kinds.get(c, pa.list_(pa.float64()))) for c, x in out.items()]
        yield pa.RecordBatch.from_arrays([batch.column("seq"), batch.column("head"), batch.column("block"), *columns], names=["seq", "head", "block", *out])


def _merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the partial results of a block of queries in whatever order they come; only the sums so far are held."""
    held: dict[int, tuple[float, float, np.ndarray]] = {}
    for batch in batches:
        for row in batch.select(["pos", "top", "total", "sum"]).to_pylist():
            for pos, top, total, value in zip(row["pos"], row["top"], row["total"], row["sum"], strict=True):
                value = np.array(value)
                if pos in held:
                    t, n, v = held[pos]
                    most = max(t, top)
                    a, b = np.exp(t - most), np.exp(top - most)
                    held[pos] = most, a * n + b * total, a * v + b * value
                else:
                    held[pos] = top, total, value
    if held:
        pos = sorted(held)
        out = [(held[p][2] / held[p][1]).tolist() for p in pos]
        yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(pos), k.type) for k in key[:2]] + [pa.array(pos, pa.int64()), pa.array(out, pa.list_(pa.float64()))], names=["seq", "head", "pos", "out"])


#: Places in a block of queries or keys.
BLOCK = 128


def attention(rows: DataFrame, chunk: int | None = None, groups: int = 1) -> DataFrame:
    """Causal attention of rows(seq, head, pos, q, k, v, real): seq, head, pos, out.

    A query sees the real keys up to its place; query head h reads key head h div groups. Queries and keys stand in rows of
    `chunk` places; a block of queries meets each block of keys up to its own in a row, which gives mergeable partial results
    (largest score, sum of weights, weighted values). They are merged for each block of queries as they come, so neither a join's row
    nor a group's state grows with the sequence, and no task has all keys of a query. A query without any key has no row.
    """
    small_batches(rows.sparkSession)  # a row is a block of queries with one of keys
    size = chunk or BLOCK
    block = F.floor(F.col("pos") / size).alias("block")
    q = rows.select("seq", "head", block, F.col("pos").cast("long").alias("pos"), F.transform("q", lambda x: x.cast("double")).alias("q"))
    q = q.groupBy("seq", "head", "block").agg(F.sort_array(F.collect_list(F.struct("pos", "q"))).alias("x"))  # `size` rows
    q = q.select("seq", "head", "block", (F.col("head") / groups).cast("int").alias("kv"), F.col("x.pos").alias("poss"), F.col("x.q").alias("qs"))
    kv = rows.where("real").where("k is not null").select("seq", F.col("head").cast("int").alias("kv"), F.floor(F.col("pos") / size).alias("own"), F.struct(F.col("pos").cast("long").alias("at"), F.transform("k", lambda x: x.cast("double")).alias("k"), F.transform("v", lambda x: x.cast("double")).alias("v")).alias("x"))
    kv = kv.groupBy("seq", "kv", "own").agg(F.sort_array(F.collect_list("x")).alias("x"))  # `size` rows
    last = q.groupBy("seq").agg(F.max("block").alias("last"))
    kv = kv.join(last, "seq").where(F.col("own") <= F.col("last")).select("seq", "kv", F.explode(F.sequence("own", "last")).alias("block"), F.col("x.at").alias("ats"), F.col("x.k").alias("ks"), F.col("x.v").alias("vs"))
    met = q.join(kv, ["seq", "kv", "block"]).select("seq", "head", "block", "poss", "qs", "ats", "ks", "vs")
    numbers = T.ArrayType(T.DoubleType())
    keys = [rows.schema["seq"], rows.schema["head"]]
    parts = met.mapInArrow(_partials, T.StructType([*keys, T.StructField("block", T.LongType()), T.StructField("pos", T.ArrayType(T.LongType())), T.StructField("top", numbers), T.StructField("total", numbers), T.StructField("sum", T.ArrayType(numbers))]))
    return parts.groupBy("seq", "head", "block").applyInArrow(_merge, T.StructType([*keys, T.StructField("pos", T.LongType()), T.StructField("out", numbers)]))


Layer = dict[str, np.ndarray]
_VECTOR = T.ArrayType(T.DoubleType())


def _rows(column: pa.Array) -> np.ndarray:
    """A column of vectors of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _column(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x).ravel()))


def _unit(x: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    return x / np.sqrt((x * x).mean(1, keepdims=True) + eps)


def _turned(x: np.ndarray, pos: np.ndarray, theta: float) -> np.ndarray:
    """rope() for a matrix, a place for each row."""
    angle = pos[:, None] * theta ** (-np.arange(0, x.shape[1], 2) / x.shape[1])
    even, odd, cos, sin = x[:, ::2], x[:, 1::2], np.cos(angle), np.sin(angle)
    return np.stack([even * cos - odd * sin, even * sin + odd * cos], 2).reshape(x.shape)


def heads_of(rows: DataFrame, layer: Layer, heads: int, kv_heads: int, theta: float = 10000.0) -> DataFrame:
    """rows(seq, pos, x, real) to a row for each query head of the normed x, with queries and keys turned by place, as attention() takes them.

    Head h of the first kv_heads carries the keys and values of that number. A batch of rows is one matrix product.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x, pos = _unit(_rows(batch.column("x"))), batch.column("pos").to_numpy(zero_copy_only=False)
            q, k, v = (np.split(x @ layer[c].T, n, 1) for c, n in (("q", heads), ("k", kv_heads), ("v", kv_heads)))
            for h in range(heads):
                own = [_column(_turned(k[h], pos, theta)), _column(v[h])] if h < kv_heads else [pa.nulls(len(batch), pa.list_(pa.float64()))] * 2
                yield pa.RecordBatch.from_arrays([batch.column("seq"), batch.column("pos"), pa.array(np.full(len(batch), h, np.int32)), _column(_turned(q[h], pos, theta)), *own, batch.column("real")], names=["seq", "pos", "head", "q", "k", "v", "real"])

    fields = [rows.schema["seq"], rows.schema["pos"], T.StructField("head", T.IntegerType()), *(T.StructField(c, _VECTOR) for c in "qkv"), rows.schema["real"]]
    return rows.select("seq", "pos", "x", "real").mapInArrow(split, T.StructType(fields))


def transformer_block(rows: DataFrame, layer: Layer, heads: int, kv_heads: int, chunk: int | None = None) -> DataFrame:
    """rows(seq, pos, x, real) after a pre-norm block: x + attention(norm(x)), then that + SwiGLU of its norm. Weights: q, k, v, o, w1, w3, w2.

    A place sees earlier real ones only, so the rows of a sequence's start are those of the start alone: what a cache of keys and
    values holds. A place that sees none takes nothing from attention. The layer's weights go with the tasks.
    """
    seen = attention(heads_of(rows, layer, heads, kv_heads), chunk, heads // kv_heads)
    seen = seen.groupBy("seq", "pos").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("head", "out"))), lambda s: s["out"])).alias("a"))  # a row for each head
    none = F.array_repeat(F.lit(0.0), layer["o"].shape[1])
    met = rows.select("seq", "pos", "x", "real").join(seen, ["seq", "pos"], "left").withColumn("a", F.coalesce("a", none))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = _rows(batch.column("x")) + _rows(batch.column("a")) @ layer["o"].T
            n = _unit(x)
            gate = n @ layer["w1"].T
            x = x + (gate / (1 + np.exp(-gate)) * (n @ layer["w3"].T)) @ layer["w2"].T
            yield pa.RecordBatch.from_arrays([batch.column("seq"), batch.column("pos"), _column(x), batch.column("real")], names=["seq", "pos", "x", "real"])

    return met.mapInArrow(finish, T.StructType([rows.schema["seq"], rows.schema["pos"], T.StructField("x", _VECTOR), rows.schema["real"]]))


def next_token_loss(rows: DataFrame, head: np.ndarray) -> DataFrame:
    """rows(seq, pos, x, target) to seq, pos, target, loss: under logits of the normed x with each row of head; rows without a target go."""

    def lose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 1024) for k in range(0, len(batch), 1024)):
                z = _unit(_rows(part.column("x"))) @ head.T
                top = z.max(1)
                own = z[np.arange(len(z)), part.column("target").to_numpy(zero_copy_only=False)]
                yield pa.RecordBatch.from_arrays([part.column("seq"), part.column("pos"), part.column("target"), pa.array(top + np.log(np.exp(z - top[:, None]).sum(1)) - own)], names=["seq", "pos", "target", "loss"])

    return rows.where("target is not null").select("seq", "pos", "x", "target").mapInArrow(lose, T.StructType([rows.schema["seq"], rows.schema["pos"], rows.schema["target"], T.StructField("loss", T.DoubleType())]))


def adamw(params: DataFrame, lr: float, beta1: float, beta2: float, eps: float, decay: float) -> DataFrame:
    """params(theta, grad, m, v, t) after a step: the bias is corrected in the rate, and the decay scales the new theta."""
    t = F.col("t") + 1
    m = beta1 * F.col("m") + (1 - beta1) * F.col("grad")
    v = beta2 * F.col("v") + (1 - beta2) * F.col("grad") * F.col("grad")
    rate = lr * F.sqrt(1 - F.pow(F.lit(beta2), t)) / (1 - F.pow(F.lit(beta1), t))
    return params.withColumns({"_m": m, "_v": v}).withColumn("theta", (F.col("theta") - rate * F.col("_m") / (F.sqrt("_v") + eps)) * (1 - lr * decay)).withColumns({"m": F.col("_m"), "v": F.col("_v"), "t": t}).drop("_m", "_v")


def clip_norm(grads: DataFrame, most: float, eps: float = 1e-6) -> DataFrame:
    """grads(grad, ...) rescaled if their common norm is above `most`, and the norm."""
    norm = grads.agg(F.sqrt(F.sum(F.col("grad") * F.col("grad"))).alias("norm"))
    out = grads.crossJoin(F.broadcast(norm))  # one row
    return out.withColumn("grad", F.when(F.col("norm") > most, F.col("grad") * (most / (F.col("norm") + eps))).otherwise(F.col("grad")))
