"""Ranks and running totals over a whole table without sending it, or all rows of one key, to one task."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.scratch import shared_dir


def running_totals(df: DataFrame, keys: list[str | Column], sizes: dict[str, Column]) -> DataFrame:
    """df with a column for each size: its sum over all rows before, in the order of the keys.

    Two levels: rows are dealt into sorted ranges, each of which adds up on its own and is written; the ranges' totals, a row for
    each, give what is in front of each range. Rows with equal keys are told apart by their place in the input, which is part of
    the ranges' bounds, so a key with all rows is cut into ranges as well. Among themselves such rows stand in that order. A null
    size counts as 0, null keys come first.
    """
    spark, n = df.sparkSession, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = df.withColumn("_place", F.monotonically_increasing_id()).withColumns({f"_size{k}": F.coalesce(x.cast("long"), F.lit(0)) for k, x in enumerate(sizes.values())})
    own = own.repartitionByRange(n, *keys, "_place").sortWithinPartitions(*keys, "_place").drop("_place")
    names, added = df.columns, list(sizes)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, so_far = TaskContext.get().partitionId(), [0] * len(added)
        for batch in batches:
            columns = [batch.column(c) for c in names]
            for k in range(len(added)):
                size = batch.column(f"_size{k}").to_numpy(zero_copy_only=False)
                columns += [pa.array(so_far[k] + np.cumsum(size) - size), batch.column(f"_size{k}")]
                so_far[k] += int(size.sum())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(batch), number, np.int64))], names=schema.names)

    schema = T.StructType([*df.schema.fields, *(T.StructField(x, T.LongType()) for k, c in enumerate(added) for x in (c, f"_size{k}")), T.StructField("_part", T.LongType())])
    at = f"{shared_dir(spark)}/totals-{uuid.uuid4().hex}"
    own.mapInArrow(add_up, schema).write.parquet(at)
    rows = spark.read.schema(schema).parquet(at)
    before, so_far = [], [0] * len(added)
    for r in rows.groupBy("_part").agg(*[F.sum(f"_size{k}").alias(c) for k, c in enumerate(added)]).orderBy("_part").collect():  # a row for each range
        before.append((r["_part"], *so_far))
        so_far = [x + r[c] for x, c in zip(so_far, added, strict=True)]
    front = spark.createDataFrame(before, T.StructType([T.StructField("_part", T.LongType()), *(T.StructField(f"_front{k}", T.LongType()) for k in range(len(added)))]))
    rows = rows.join(F.broadcast(front), "_part")
    return rows.select(*names, *[(F.col(c) + F.col(f"_front{k}")).alias(c) for k, c in enumerate(added)])


def ranked(df: DataFrame, key: str, name: str = "rn", ties: tuple[str, ...] = ()) -> DataFrame:
    """df with the place (from 0) of each row in the order of a key, then `ties`, then of the input."""
    return running_totals(df, [key, *ties], {name: F.lit(1)})


def held_out_tail(df: DataFrame, key: str, share: float = 0.95) -> DataFrame:
    """The rows from place int(share * n) on."""
    n = df.count()
    return ranked(df, key).where(F.col("rn") >= int(n * share))


def train_val_split(df: DataFrame, key: str, val: float) -> DataFrame:
    """df with `split`: the first int(n * (1 - val)) rows train, the rest validate."""
    n = df.count()
    return ranked(df, key).withColumn("split", F.when(F.col("rn") < int(n * (1 - val)), "train").otherwise("val"))


def _mixed(key: str, seed: str) -> Column:
    mixed = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(seed)))
    return F.conv(F.substring(mixed, 1, 15), 16, 10).cast("long")


def shuffled(df: DataFrame, key: str, seed: str) -> DataFrame:
    """df with its place in a seeded order: by MD5 of key and seed."""
    return ranked(df.withColumn("_mix", _mixed(key, seed)), "_mix", "place", (key,)).drop("_mix")


def seeded_head(df: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """The first n rows of the seeded order; each task keeps n rows, so nothing is ranked."""
    return df.orderBy(_mixed(key, seed), key).limit(n)


def epoch_batches(df: DataFrame, key: str, size: int, seeds: list[str]) -> DataFrame:
    """Each seed's epoch in full batches of `size`: seed, batch, slot; a last, smaller batch is left out."""
    n = df.count() // size * size
    out = None
    for s in seeds:
        e = shuffled(df, key, s).where(F.col("place") < n).select(F.lit(s).alias("seed"), F.floor(F.col("place") / size).cast("long").alias("batch"), (F.col("place") % size).alias("slot"), key)
        out = e if out is None else out.unionByName(e)
    return out
