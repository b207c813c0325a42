"""Token-id files of patched frame-of-reference blocks.

A file segment holds whole documents, in order. Ids lie in blocks of 128: each block subtracts its
minimum, packs the low bits at the width that covers a percentile of its values, and lists the
others as exceptions (place, high bits). An index of block starts lets one block be read alone.

Segments travel as binary rows of a Parquet dataset, so the write is committed by Spark, works on
any file system that Spark reaches, and a lost executor's tasks are simply run again.

Null text counts as empty (a document of the end id alone). Null doc_ids sort first. Repeated
doc_ids stay separate documents in any order among themselves. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch, parts
from .textops import flat, small
from .tokens import encoded

BLOCK = 128
MAGIC = 0x31524650
SEGMENT_IDS = 1 << 20
SEGMENT = "part int, seg int, base long, n_docs int, n_ids long, payload binary"


def pack(ids: np.ndarray, percentile: float = 90.0) -> bytes:
    """One segment's ids (unsigned 32-bit values) as bytes."""
    ids = np.asarray(ids).astype(np.uint32)
    n = len(ids)
    nb = -(-n // BLOCK)
    padded = np.empty(nb * BLOCK, np.uint32)
    padded[:n] = ids
    padded[n:] = ids[-1] if n else 0
    rows = padded.reshape(nb, BLOCK)
    least = rows.min(1) if nb else np.zeros(0, np.uint32)
    delta = rows - least[:, None]
    k = min(BLOCK - 1, int(BLOCK * percentile / 100))
    pivot = np.partition(delta, k, axis=1)[:, k] if nb else np.zeros(0, np.uint32)
    width = np.ceil(np.log2(pivot.astype(np.float64) + 1)).astype(np.int64)
    high = (delta.astype(np.uint64) >> width[:, None].astype(np.uint64)).astype(np.uint32)
    odd = high > 0
    n_odd = odd.sum(1)
    size = 16 * width + 5 * n_odd
    start = np.cumsum(size) - size
    body = np.zeros(int(size.sum()), np.uint8)
    bits = np.unpackbits(np.ascontiguousarray(delta).view(np.uint8).reshape(nb, BLOCK, 4), axis=2, bitorder="little") if nb else None
    for w in np.unique(width):
        if w:
            at = np.flatnonzero(width == w)
            packed = np.packbits(bits[at][:, :, :w].reshape(len(at), -1), axis=1, bitorder="little")
            body[start[at][:, None] + np.arange(16 * w)] = packed
    r, c = np.nonzero(odd)
    if len(r):
        nth = np.arange(len(r)) - (np.cumsum(n_odd) - n_odd)[r]
        base = start[r] + 16 * width[r]
        body[base + nth] = c.astype(np.uint8)
        body[(base + n_odd[r] + 4 * nth)[:, None] + np.arange(4)] = high[r, c].view(np.uint8).reshape(-1, 4)
    head = np.array([MAGIC, n, nb], np.uint64).tobytes()
    return head + least.tobytes() + width.astype(np.uint8).tobytes() + n_odd.astype(np.uint8).tobytes() + start.astype(np.uint64).tobytes() + body.tobytes()


def unpack(raw: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of the blocks first..last-1 (all by default) of a segment."""
    magic, n, nb = (int(x) for x in np.frombuffer(raw, np.uint64, 3))
    if magic != MAGIC:
        raise ValueError("not a token segment")
    at = 24
    least = np.frombuffer(raw, np.uint32, nb, at)
    width = np.frombuffer(raw, np.uint8, nb, at + 4 * nb).astype(np.int64)
    n_odd = np.frombuffer(raw, np.uint8, nb, at + 5 * nb).astype(np.int64)
    start = np.frombuffer(raw, np.uint64, nb, at + 6 * nb).astype(np.int64)
    body = np.frombuffer(raw, np.uint8, -1, at + 14 * nb) if len(raw) > at + 14 * nb else np.zeros(0, np.uint8)
    last = nb if last is None else min(last, nb)
    first = min(first, last)
    out = np.zeros((last - first, BLOCK), np.uint32)
    for w in np.unique(width[first:last]):
        at = np.flatnonzero(width[first:last] == w)
        if w:
            bits = np.unpackbits(body[start[first + at][:, None] + np.arange(16 * w)], axis=1, bitorder="little").reshape(len(at), BLOCK, w)
            full = np.zeros((len(at), BLOCK, 32), np.uint8)
            full[:, :, :w] = bits
            out[at] = np.packbits(full, axis=2, bitorder="little").view(np.uint32).reshape(len(at), BLOCK)
    k = n_odd[first:last]
    if k.sum():
        r = np.repeat(np.arange(last - first), k)
        nth = np.arange(len(r)) - np.repeat(np.cumsum(k) - k, k)
        base = start[first + r] + 16 * width[first + r]
        c = body[base + nth]
        high = np.ascontiguousarray(body[(base + k[r] + 4 * nth)[:, None] + np.arange(4)]).view(np.uint32).ravel()
        out[r, c] |= (high.astype(np.uint64) << width[first + r].astype(np.uint64)).astype(np.uint32)
    out += least[first:last, None]
    return out.ravel()[: max(0, n - first * BLOCK)]


def _segment(doc_ids: list[np.ndarray], sizes: list[np.ndarray], ids: list[np.ndarray]) -> bytes:
    d, s, i = np.concatenate(doc_ids), np.concatenate(sizes), np.concatenate(ids)
    return np.array([len(d)], np.uint64).tobytes() + d.astype(np.int64).tobytes() + s.astype(np.int64).tobytes() + pack(i)


def read_segment(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, number of ids of each, and all ids of a segment."""
    n = int(np.frombuffer(raw, np.uint64, 1)[0])
    return np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.int64, n, 8 + 8 * n), unpack(raw[8 + 16 * n :])


def write_token_files(docs: DataFrame, path: str, tokenizer: str, kind: str, end_id: int) -> None:
    """Encodes docs(doc_id, text) in ascending doc_id order into segments under `path`, range-partitioned by doc_id."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = seg = base = 0
        d: list[np.ndarray] = []
        s: list[np.ndarray] = []
        t: list[np.ndarray] = []

        def full():
            nonlocal seg, base
            n = int(sum(map(len, t)))
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seg": pa.array([seg], pa.int32()), "base": pa.array([base], pa.int64()), "n_docs": pa.array([sum(map(len, d))], pa.int32()), "n_ids": pa.array([n], pa.int64()), "payload": pa.array([_segment(d, s, t)], pa.binary())})
            seg, base = seg + 1, base + n
            d.clear(), s.clear(), t.clear()
            return row

        for batch in small(batches):
            if len(batch) == 0:
                continue
            part = batch.column("part")[0].as_py()
            names = batch.column("doc_id").fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            data, offs = flat(batch.column("text"))
            for i, ids, at in encoded(tokenizer, kind, data, offs, end_id):
                d.append(names[i : i + len(at) - 1])
                s.append(np.diff(at))
                t.append(ids)
                if sum(map(len, t)) >= SEGMENT_IDS:
                    yield full()
        if d:
            yield full()

    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = own.repartitionByRange(parts(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    own.select(F.spark_partition_id().alias("part"), "doc_id", "text").mapInArrow(encode, SEGMENT).write.mode("overwrite").parquet(path)


def read_token_files(spark, path: str) -> DataFrame:
    """Per document of the files under `path`: doc_id, start, n_tokens, ids_crc32, in the order they were written in.

    The start adds up three levels: its segment's ids before it, its part's segments before, and the
    parts before. Only the last is summed over in one place, and it has a row per part.
    """
    seg = spark.read.schema(SEGMENT).parquet(path)
    totals = [(r["part"], r["n"]) for r in seg.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()]
    before, total = [], 0
    for p, n in totals:
        before.append((p, total))
        total += n

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, base, raw in zip(batch.column("part").to_pylist(), batch.column("base").to_pylist(), batch.column("payload"), strict=True):
                names, sizes, ids = read_segment(raw.as_py())
                ends = np.cumsum(sizes)
                view = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(view[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                null = names == -(1 << 63)
                yield pa.RecordBatch.from_pydict({"part": pa.array(np.full(len(names), part), pa.int32()), "doc_id": pa.array(names, pa.int64(), mask=null), "at": pa.array(base + ends - sizes, pa.int64()), "n_tokens": pa.array(sizes, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    docs = seg.select("part", "base", "payload").mapInArrow(decode, "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    parts_before = spark.createDataFrame(before, "part int, before long")  # a row per part: bounded by the partition count
    return docs.join(F.broadcast(parts_before), "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str, kind: str = "spaces", end_id: int = 2) -> DataFrame:
    """Writes the files into the shared folder and reads them back."""
    spark = docs.sparkSession
    at = Scratch(spark, "token-files").at
    write_token_files(docs, at, tokenizer, kind, end_id)
    return read_token_files(spark, at)
