"""The corpus as one stream of token ids: places across documents, windows and batches of it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import uniform
from tessera.operators import ordering

#: The stream is cut into blocks of so many ids, on which windows meet what they cover.
BLOCK = 4096


def stream(tokens: DataFrame, key: str) -> DataFrame:
    """tokens(key, ids) as start, ids: each row's place in the stream of all rows in the order of the key; rows without ids have none."""
    return ordering.running_totals(tokens.where(F.size("ids") > 0).select(key, "ids"), [key], {"start": F.size("ids")}).select("start", "ids")


def length(segments: DataFrame) -> int:
    return segments.agg(F.coalesce(F.max(F.col("start") + F.size("ids")), F.lit(0)).alias("n")).first()["n"]


def _blocks(lo, hi, block: int):
    return F.explode(F.sequence(F.floor(lo / block), F.floor((hi - 1) / block)))


def _cut(ids, at, lo, hi):
    """The part of ids, which start at `at`, within lo and hi."""
    first = F.greatest(lo, at)
    return F.slice(ids, (first - at + 1).cast("int"), (F.least(hi, at + F.size(ids)) - first).cast("int"))


def windows(segments: DataFrame, wanted: DataFrame, block: int = BLOCK) -> DataFrame:
    """wanted(lo, hi, ...) with `ids`: the stream from lo to hi, whichever documents that is in.

    Segments are cut, and windows repeated, for the blocks of the stream that they touch; they are joined on the block, so a window
    meets only its own blocks, no array is taken apart, and a long document is many rows.
    """
    lo, hi = F.col("start"), F.col("start") + F.size("ids")
    parts = segments.withColumn("_block", _blocks(lo, hi, block))
    first = F.greatest(lo, F.col("_block") * block)
    parts = parts.select("_block", first.alias("_at"), _cut(F.col("ids"), lo, F.col("_block") * block, (F.col("_block") + 1) * block).alias("_ids"))
    names = wanted.columns
    own = wanted.where("lo < hi").withColumn("_block", _blocks(F.col("lo"), F.col("hi"), block))
    met = own.join(parts, "_block").where((F.col("_at") < F.col("hi")) & (F.col("_at") + F.size("_ids") > F.col("lo")))
    met = met.select(*names, F.struct(F.greatest("_at", "lo").alias("at"), _cut(F.col("_ids"), F.col("_at"), F.col("lo"), F.col("hi")).alias("ids")).alias("p"))
    return met.groupBy(*names).agg(F.flatten(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["ids"])).alias("ids"))  # a window's ids


def list_sums(lists: pa.Array, start: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
    """For each list of whole numbers its sum, and its sum by place; places count on from start + 1. A null list has none."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    x, end = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(size)
    place = np.arange(len(x)) - np.repeat(end - size - start, size) + 1
    plain, placed = (np.concatenate([[0], np.cumsum(y)]) for y in (x, x * place))
    return plain[end] - plain[end - size], placed[end] - placed[end - size]


def sums(found: DataFrame, names: list[str]) -> DataFrame:
    """names of found(inputs, targets, ...) with the lists' length, sums and sums by place, each batch in arrays."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = pc.cast(pc.list_value_length(batch.column("inputs")), pa.int64())
            columns = [pa.array(x) for c in ("inputs", "targets") for x in list_sums(batch.column(c))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], n, *columns], names=schema.names)

    added = ["n_ids", "input_sum", "input_placed", "target_sum", "target_placed"]
    schema = T.StructType([*[found.schema[c] for c in names], *(T.StructField(c, T.LongType()) for c in added)])
    return found.select(*names, "inputs", "targets").mapInArrow(add_up, schema)


def slice_sums(rows: DataFrame, width: int) -> DataFrame:
    """rows(start, ids) to slice, n, s, p: the slice of `width` places that a row starts in, its length, sum and sum by place in the stream."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = batch.column("start").to_numpy(zero_copy_only=False)
            n = pc.cast(pc.list_value_length(batch.column("ids")), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(start // width), n, *[pa.array(x) for x in list_sums(batch.column("ids"), start)]], names=["slice", "n", "s", "p"])

    return rows.select("start", "ids").mapInArrow(add_up, "slice long, n long, s long, p long")


def _pairs(found: DataFrame, *names: str) -> DataFrame:
    n = F.size("ids") - 1
    return found.select(*names, F.slice("ids", F.lit(1), n).alias("inputs"), F.slice("ids", F.lit(2), n).alias("targets"))


def get_batch(segments: DataFrame, size: int, context: int, seed: str) -> DataFrame:
    """draw, start, inputs, targets: `size` windows of `context` ids at starts drawn by hash from all places of the stream that have a next id."""
    n = length(segments)
    if n <= context:
        raise ValueError(f"the stream has {n} ids, a window and its targets take {context + 1}")
    wanted = segments.sparkSession.range(size).select(F.col("id").alias("draw"))
    wanted = wanted.withColumn("lo", F.floor(uniform(F.concat_ws("-", F.lit(seed), "draw")) * (n - context)))
    return _pairs(windows(segments, wanted.withColumn("hi", F.col("lo") + context + 1)).withColumnRenamed("lo", "start"), "draw", "start")


def context_windows(segments: DataFrame, context: int) -> DataFrame:
    """window_no, start, inputs, targets: the stream in windows one after the other, the last one shorter; each id but the first is a target once."""
    n = length(segments)
    wanted = segments.sparkSession.range(max(0, -(-(n - 1) // context))).select(F.col("id").alias("window_no"), (F.col("id") * context).alias("lo"))
    wanted = wanted.withColumn("hi", F.least(F.col("lo") + context + 1, F.lit(n)))
    return _pairs(windows(segments, wanted).withColumnRenamed("lo", "start"), "window_no", "start")
