"""Tables about models and runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera.operators import ordering


def flops(configs: DataFrame, peaks: DataFrame, tokens_per_second: Column) -> DataFrame:
    """configs with the forward FLOPs of a sequence, the first chip (by ord) whose name the device's holds, and the share of its peak in training."""
    c = configs.select("*", *[F.col(x).cast("long").alias(f"_{x}") for x in ("context", "d_model", "d_ff", "vocab", "kv_heads", "q_heads", "layers")])
    t, w = F.col("_context"), F.col("_d_model")
    kv = F.col("_kv_heads") * F.expr("_d_model div _q_heads")
    layer = 4 * t * w * w + 4 * t * w * kv + 4 * t * t * w + F.when(F.col("gate"), 3).otherwise(2) * 2 * t * w * F.col("_d_ff")
    c = c.withColumn("flops", F.col("_layers") * layer + 2 * t * w * F.col("_vocab"))
    name = F.upper(F.replace("device", F.lit(" "), F.lit("")))
    hit = c.select("device", name.alias("n")).distinct().join(F.broadcast(peaks), F.expr("contains(n, upper(chip))")).groupBy("device").agg(F.min_by("chip", "ord").alias("chip"), F.min_by("peak", "ord").alias("peak"))  # a few chips
    step = tokens_per_second / (F.col("batch") * F.col("context"))
    return c.join(hit, "device", "left").withColumn("mfu", step * 3 * F.col("flops") * F.col("batch") / F.col("peak"))


def parameters(params: DataFrame, embedding: str) -> DataFrame:
    """params(name, shape, storage): all numbers, shared storage once, and without the embedding's."""
    size = F.aggregate("shape", F.lit(1).cast("long"), lambda s, x: s * x)
    own = params.groupBy("storage").agg(F.max(size).alias("n"))
    return own.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("storage") != embedding, F.col("n"))).alias("without_embedding"))


def resolved(first: DataFrame, second: DataFrame, third: DataFrame) -> DataFrame:
    """key, value of three layers; the first that has a value counts."""
    layers = [x.select("key", "value", F.lit(k).alias("layer")) for k, x in enumerate((first, second, third))]
    rows = layers[0].unionByName(layers[1]).unionByName(layers[2])
    return rows.groupBy("key").agg(F.min_by("value", F.when(F.col("value").isNotNull(), F.col("layer"))).alias("value"))


def state_difference(model: DataFrame, saved: DataFrame) -> DataFrame:
    """Names of a model that a checkpoint lacks, and the other way; a compiler's prefix doesn't count."""
    saved = saved.select(F.regexp_replace("name", r"^_orig_mod\.", "").alias("name"))
    return model.join(saved, "name", "left_anti").withColumn("status", F.lit("missing")).unionByName(saved.join(model, "name", "left_anti").withColumn("status", F.lit("unexpected")))


def crossover(bench: DataFrame, by: str) -> DataFrame:
    """For each run of bench(by, gen, cached, plain) the first gen at which the cached one is faster."""
    return bench.groupBy(by).agg(F.min(F.when(F.col("cached") / F.greatest("plain", F.lit(1e-6)) > 1, F.col("gen"))).alias("crossover"))


def rounded(x: Column, places: int) -> Column:
    """x rounded as DuckDB does it: the scaled double, halves away from zero; Spark's round takes the decimal digits instead."""
    return F.round(x * F.lit(10.0**places)) / F.lit(10.0**places)


def means_in_order(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key, mean, n: each key's mean, its values added one after the other in an order, and the number of its rows.

    Sums of doubles depend on the order, and where a mean is halfway between two rounded values its last bit counts. Rows are sorted
    by key, so a task holds one sum at a time. Null values don't count for the mean.
    """
    kind = rows.schema[key].dataType
    own = rows.select(F.col(key).alias("key"), F.col(order).alias("order"), F.col(value).cast("double").alias("value"))
    own = own.repartition("key").sortWithinPartitions("key", "order").select("key", "value")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last key, with its sum, values and rows so far
        for batch in batches:
            if not len(batch):
                continue
            keys, values = batch.column("key"), batch.column("value")
            new = np.ones(len(batch), bool)
            new[1:] = [a != b for a, b in zip(keys[1:].to_pylist(), keys[:-1].to_pylist(), strict=True)]
            at, first = np.cumsum(new) - 1, np.flatnonzero(new)
            names, real = keys.take(pa.array(first)).to_pylist(), values.is_valid().to_numpy(zero_copy_only=False)
            start, seen, n = np.zeros(len(first)), np.bincount(at[real], minlength=len(first)), np.bincount(at)
            if held and held[0] == names[0]:
                start[0], seen[0], n[0] = held[1], seen[0] + held[2], n[0] + held[3]
            elif held:
                yield out([held])
            # bincount adds in order
            sums = np.bincount(np.concatenate([np.arange(len(first)), at[real]]), np.concatenate([start, values.to_numpy(zero_copy_only=False)[real]]))
            done = list(zip(names, sums.tolist(), seen.tolist(), n.tolist(), strict=True))
            held = done.pop()
            if done:
                yield out(done)
        if held:
            yield out([held])

    def out(done: list[tuple]) -> pa.RecordBatch:
        return pa.table({"key": pa.array([r[0] for r in done], of), "mean": pa.array([r[1] / r[2] if r[2] else None for r in done], pa.float64()), "n": pa.array([r[3] for r in done], pa.int64())}).to_batches()[0]

    of = to_arrow_type(kind)
    return own.mapInArrow(add_up, T.StructType([T.StructField("key", kind), T.StructField("mean", T.DoubleType()), T.StructField("n", T.LongType())]))


def ablations(runs: DataFrame) -> DataFrame:
    """Runs by loss, with their distance from the baseline, or from the best without one."""
    base = runs.agg(F.coalesce(F.max(F.when(F.col("name") == "baseline", F.col("val_loss"))), F.min("val_loss")).alias("base"))
    rows = ordering.ranked(runs, "val_loss", "place", ("name",)).crossJoin(F.broadcast(base))  # one row
    return rows.select((F.col("place") + 1).alias("place"), "name", "val_loss", F.exp("val_loss").alias("val_ppl"), (F.col("val_loss") - F.col("base")).alias("delta"), "params")


def widths(models: DataFrame) -> DataFrame:
    """models with d_ff from d_model."""
    return models.withColumn("d_ff", F.expr("(8 * d_model div 3 + 63) div 64 * 64"))
