"""Token streams as folders of .npy shards: a data source that writes them under a commit protocol and reads slices by byte range.

    npy.register(spark)
    ids.write.format("npy").mode("append").save(path)                      # a column `ids`, lists of whole numbers
    spark.read.format("npy").option("rowIds", 4096).load(path)            # path, start, ids

A shard is a plain one-dimensional .npy file. Tasks write theirs into a folder of the job; the commit moves them and writes the
list of shards with their lengths last, so a reader sees a job's shards all or not at all, and a second attempt of a task adds
nothing. Shards stand in the order of the partitions, so rows sorted by range make one stream in their order. Without a list, the
.npy files of a folder, or the one file, are read in the order of their names.

Paths are those of pyarrow's file systems (file, hdfs, s3, gs), of a store that driver and executors share.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

LIST = "_shards.json"
SCHEMA = "path string, start long, ids array<long>"
#: Ids that a reader has in memory, if a row has no more, and shards that a commit moves at a time.
RUN, MOVES = 1 << 16, 16


def _store(path: str) -> tuple[fs.FileSystem, str]:
    store, at = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
    return store, at.rstrip("/")


def _header(store: fs.FileSystem, path: str) -> tuple[np.dtype, int, int]:
    """Type, length and first byte of a shard's numbers."""
    with store.open_input_file(path) as f:
        head = io.BytesIO(f.read_at(min(f.size(), 1 << 16), 0))
    version = np.lib.format.read_magic(head)
    shape, _, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(head)
    if len(shape) != 1 or kind.kind not in "iu":
        raise ValueError(f"{path} is no list of whole numbers")
    return kind, shape[0], head.tell()


def _listed(store: fs.FileSystem, at: str) -> list[dict]:
    if store.get_file_info(f"{at}/{LIST}").type != fs.FileType.File:
        return []
    with store.open_input_file(f"{at}/{LIST}") as f:
        return json.loads(f.read())


def _shards(store: fs.FileSystem, at: str) -> list[dict]:
    """name, n, kind and first byte of each shard, in order."""
    if store.get_file_info(at).type == fs.FileType.File:
        paths = [at]
    elif found := _listed(store, at):
        return [s | {"path": f"{at}/{s['name']}"} for s in found]
    else:
        paths = sorted(x.path for x in store.get_file_info(fs.FileSelector(at)) if x.is_file and x.path.endswith(".npy"))
    heads = [_header(store, p) for p in paths]
    return [{"path": p, "n": n, "kind": kind.str, "first": first} for p, (kind, n, first) in zip(paths, heads, strict=True)]


@dataclass
class Slice:
    path: str
    kind: str
    first: int  # the byte of the shard's first number
    start: int  # the shard's first place in the stream
    lo: int  # from this place of the stream
    hi: int


@dataclass
class Slices(InputPartition):
    slices: list[Slice]


class NpyReader(DataSourceReader):
    """Slices of `sliceIds` places of the stream, in rows of `rowIds`; both also end with a shard. A partition is as many slices, one
    after the other, as have `taskIds` places together, or one that has more: small shards don't make a task each."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.row, self.slice, self.task = int(options.get("rowids", 1 << 16)), int(options.get("sliceids", 1 << 22)), int(options.get("taskids", 1 << 22))

    def partitions(self) -> list[Slices]:
        out, n = [], 0
        for s in self._slices():
            if not out or n + s.hi - s.lo > self.task:
                out.append(Slices([]))
                n = 0
            out[-1].slices.append(s)
            n += s.hi - s.lo
        return out

    def _slices(self) -> list[Slice]:
        store, at = _store(self.path)
        out, start = [], 0
        for s in _shards(store, at):
            lo = start
            while lo < start + s["n"]:
                hi = min(start + s["n"], (lo // self.slice + 1) * self.slice)
                out.append(Slice(s["path"], s["kind"], s["first"], start, lo, hi))
                lo = hi
            start += s["n"]
        return out

    def read(self, part: Slices) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        for path, slices in groupby(part.slices, lambda s: s.path):
            with store.open_input_file(path) as f:
                for s in slices:
                    yield from self._rows(f, s)

    def _rows(self, f: pa.NativeFile, s: Slice) -> Iterator[pa.RecordBatch]:
        kind, lo = np.dtype(s.kind), s.lo
        while lo < s.hi:  # a run of rows at a time is in memory
            hi = min(s.hi, (lo // self.row + max(1, RUN // self.row)) * self.row)
            raw = f.read_at((hi - lo) * kind.itemsize, s.first + (lo - s.start) * kind.itemsize)
            ids = pa.array(np.frombuffer(raw, kind).astype(np.int64))
            cuts = np.array([lo, *range((lo // self.row + 1) * self.row, hi, self.row), hi])
            lists = pa.ListArray.from_arrays(pa.array((cuts - lo).astype(np.int32)), ids)
            yield pa.RecordBatch.from_arrays([pa.array([s.path] * len(lists)), pa.array(cuts[:-1], pa.int64()), lists], names=["path", "start", "ids"])
            lo = hi


@dataclass
class Written(WriterCommitMessage):
    shards: list  # part, name, n, kind, first


class NpyWriter(DataSourceArrowWriter):
    """Option `dtype` (uint16), and `shardIds`: a task begins another shard after so many ids, and holds no more."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.kind, self.most = np.dtype(options.get("dtype", "uint16")).newbyteorder("<"), int(options.get("shardids", 1 << 24))
        self.job = uuid.uuid4().hex

    def _folder(self, at: str) -> str:
        return f"{at}/_temporary-{self.job}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        store, at = _store(self.path)
        part, limits, done = TaskContext.get().partitionId(), np.iinfo(self.kind), []
        store.create_dir(self._folder(at), recursive=True)

        def put(arrays: list[np.ndarray], n: int) -> None:
            head = io.BytesIO()
            np.lib.format.write_array_header_1_0(head, {"descr": self.kind.str, "fortran_order": False, "shape": (n,)})
            name = f"part-{part:06d}-{len(done):05d}-{uuid.uuid4().hex}.npy"  # another attempt has other names
            with store.open_output_stream(f"{self._folder(at)}/{name}") as f:
                f.write(head.getvalue())
                for a in arrays:
                    f.write(a.tobytes())
            done.append({"part": part, "name": name, "n": n, "kind": self.kind.str, "first": len(head.getvalue())})

        held, n = [], 0
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids")).flatten()
            if ids.null_count:
                raise ValueError("an id is null")
            numbers = ids.to_numpy(zero_copy_only=False)
            if len(numbers) and not limits.min <= numbers.min() <= numbers.max() <= limits.max:
                raise ValueError(f"an id does not fit {self.kind}")
            numbers = numbers.astype(self.kind)
            while n + len(numbers) >= self.most:
                put([*held, numbers[: self.most - n]], self.most)
                held, n, numbers = [], 0, numbers[self.most - n :]
            if len(numbers):
                held.append(numbers)
                n += len(numbers)
        if n:
            put(held, n)
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        store, at = _store(self.path)
        store.create_dir(at, recursive=True)
        before = _listed(store, at)
        new = sorted((s for m in messages if m for s in m.shards), key=lambda s: (s["part"], s["name"][:17]))
        with ThreadPoolExecutor(MOVES) as pool:
            list(pool.map(lambda s: store.move(f"{self._folder(at)}/{s['name']}", f"{at}/{s['name']}"), new))
        with store.open_output_stream(f"{at}/{LIST}.{self.job}") as f:
            f.write(json.dumps([*([] if self.overwrite else before), *new]).encode())
        store.move(f"{at}/{LIST}.{self.job}", f"{at}/{LIST}")
        if self.overwrite:
            for s in before:
                store.delete_file(f"{at}/{s['name']}")
        self._clear(store, at)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_store(self.path))

    def _clear(self, store: fs.FileSystem, at: str) -> None:
        if store.get_file_info(self._folder(at)).type == fs.FileType.Directory:
            store.delete_dir(self._folder(at))


class Npy(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> NpyReader:
        return NpyReader(self.options)

    def writer(self, schema, overwrite: bool) -> NpyWriter:
        if "ids" not in schema.names:
            raise ValueError("a column `ids` is needed")
        return NpyWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Npy)
