"""Endless training batches as a streaming source: the offset is an epoch and a batch, and a row's place follows from them alone."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

ROUNDS = 4


def shuffled_places(index: np.ndarray, n: int, seed: str) -> np.ndarray:
    """The place of each index of 0 to n - 1 in an order of its own for each seed, without making that order.

    A Feistel network permutes the numbers of an even count of bits; numbers that come out beyond n go in again.
    """
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(int.from_bytes(sha256(f"{seed}|{r}".encode()).digest()[:8], "little") | 1) for r in range(ROUNDS)]
    out = index.astype(np.uint64)
    rest = np.arange(len(out))
    while len(rest):
        x = out[rest]
        left, right = x >> np.uint64(half), x & mask
        for key in keys:
            mixed = (right + np.uint64(1)) * key
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(32))) & mask)
        out[rest] = left << np.uint64(half) | right
        rest = rest[out[rest] >= n]
    return out.astype(np.int64)


@dataclass
class Batches(InputPartition):
    first: int  # batches are counted on through the epochs
    last: int


class EndlessReader(DataSourceStreamReader):
    """Options: rows, batchSize, seed, batchesPerTrigger, and batchesPerTask.

    An epoch is rows div batchSize full batches; what is left over differs from epoch to epoch. Each call for the latest offset goes on
    by batchesPerTrigger. After a restart the engine asks for the last planned batches again, whose end is where the source goes on.
    """

    def __init__(self, options: dict):
        self.rows, self.size, self.seed = int(options["rows"]), int(options["batchsize"]), options.get("seed", "0")
        self.step, self.share = int(options.get("batchespertrigger", 1000)), int(options.get("batchespertask", 250))
        self.epoch = self.rows // self.size
        if self.epoch < 1:
            raise ValueError(f"{self.rows} rows make no batch of {self.size}")
        self.at: int | None = None

    def _offset(self, batch: int) -> dict:
        return {"epoch": batch // self.epoch, "batch": batch % self.epoch}

    def _number(self, offset: dict) -> int:
        return offset["epoch"] * self.epoch + offset["batch"]

    def initialOffset(self) -> dict:
        return self._offset(0)

    def latestOffset(self) -> dict:
        self.at = (self.at or 0) + self.step
        return self._offset(self.at)

    def partitions(self, start: dict, end: dict) -> list[Batches]:
        first, last = self._number(start), self._number(end)
        if self.at is None:
            self.at = last
        return [Batches(k, min(last, k + self.share)) for k in range(first, last, self.share)]

    def read(self, part: Batches) -> Iterator[pa.RecordBatch]:
        k = part.first
        while k < part.last:
            epoch = k // self.epoch
            end = min(part.last, (epoch + 1) * self.epoch, k + max(1, (1 << 16) // self.size))
            row = np.arange((k - epoch * self.epoch) * self.size, (end - epoch * self.epoch) * self.size)
            place = shuffled_places(row, self.rows, f"{self.seed}-{epoch}")
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (np.full(len(row), epoch), row // self.size, row % self.size, place)], names=["epoch", "batch", "slot", "place"])
            k = end

    def commit(self, end: dict) -> None:
        pass


class EndlessBatches(DataSource):
    @classmethod
    def name(cls) -> str:
        return "endless_batches"

    def schema(self) -> str:
        return "epoch long, batch long, slot long, place long"

    def streamReader(self, schema) -> EndlessReader:
        return EndlessReader(self.options)


def endless(spark: SparkSession, rows: int, size: int, seed: str, per_trigger: int) -> DataFrame:
    """A streaming DataFrame of epoch, batch, slot and the place (0 to rows - 1) of the row that stands there."""
    spark.dataSource.register(EndlessBatches)
    return spark.readStream.format("endless_batches").options(rows=rows, batchSize=size, seed=seed, batchesPerTrigger=per_trigger).load()
