"""Packing documents into sequences of at most C tokens by linear grouping and best fit.

Only counts by length reach the driver (at most C rows), and the plan that comes back is a table of
rank ranges: the i-th item of a length goes to such a sequence. Items are ranked in parallel, by
partition counts and offsets, so neither a hot length nor a growing corpus meets in one task.

 1. A document longer than C is cut into pieces of C tokens; its first piece may be shorter.
 2. Large lengths are sorted downwards into groups of about equal cardinality and rounded up to the
    largest of their group, so that few sizes are left.
 3. Configurations of those few sizes are chosen by a bounded knapsack that fills a sequence best
    around the largest size left, each used as often as the counts allow.
 4. The actual documents take their group's places, which frees what rounding had added.
 5. Small items then go, largest first, to the sequence with the least room that still holds them;
    new sequences open only when none does.

Null text counts as empty (the end id alone). Repeated rows are packed each. An empty table gives
an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import Scratch
from .textops import flat, small
from .tokens import encoded

CAPACITY = 2048
GROUPS = 256
SMALL = 256
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, kind: str = "blanks", end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Each document's pieces: doc_id, piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            names = batch.column("doc_id")
            data, offs = flat(batch.column("text"))
            for i, ids, at in encoded(tokenizer, kind, data, offs, end_id):
                n = np.diff(at)
                k = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), k)
                piece = np.arange(len(doc)) - (np.cumsum(k) - k)[doc]
                head = n - (k - 1) * capacity
                start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[doc], capacity)
                view = memoryview(ids.astype("<u4").tobytes())
                a = at[:-1][doc] + start
                crc = [zlib.crc32(view[4 * x : 4 * y]) for x, y in zip(a.tolist(), (a + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(doc + i)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


def _best_fill(room: int, sizes: list[int], most: list[int]) -> list[int]:
    """How many of each size fill `room` best: a bounded knapsack over the room."""
    reach = np.zeros(room + 1, bool)
    reach[0] = True
    last = np.full(room + 1, -1, np.int32)
    before = np.zeros(room + 1, np.int32)
    for g, (s, m) in enumerate(zip(sizes, most, strict=True)):
        for _ in range(min(m, room // s) if s else 0):
            new = np.zeros_like(reach)
            new[s:] = reach[:-s]
            new &= ~reach
            at = np.flatnonzero(new)
            if not len(at):
                break
            reach |= new
            last[at], before[at] = g, at - s
        if reach[room]:
            break
    out, c = [0] * len(sizes), int(np.flatnonzero(reach)[-1])
    while c:
        out[last[c]] += 1
        c = int(before[c])
    return out


def plan_large(counts: dict[int, int], capacity: int, groups: int) -> tuple[list[tuple], list[tuple], int]:
    """Groups (length, group, index of its first item) and uses (group, from, to, first sequence, places in it, first place), and the number of sequences."""
    total = sum(counts.values())
    bases, sizes, need, filled = [], [], [], 0
    for v in sorted(counts, reverse=True):
        hot = counts[v] * groups >= total  # a group's worth alone: not to be rounded up
        if not sizes or hot or filled * groups >= total * len(sizes):
            sizes.append(v)
            need.append(0)
        bases.append((v, len(sizes) - 1, need[-1]))
        need[-1] += counts[v]
        filled += counts[v]
    left, used, uses, n = list(need), [0] * len(sizes), [], 0
    for g in range(len(sizes)):
        while left[g]:
            rest = [x - (h == g) for h, x in enumerate(left)]
            fill = _best_fill(capacity - sizes[g], sizes[g:], rest[g:])
            config = {g + h: m for h, m in enumerate(fill) if m}
            config[g] = config.get(g, 0) + 1
            times = min(left[h] // m for h, m in config.items())
            place = 0
            for h, m in sorted(config.items()):
                uses.append((h, used[h], used[h] + m * times, n, m, place))
                used[h] += m * times
                left[h] -= m * times
                place += m
            n += times
    return bases, uses, n


def plan_small(counts: dict[int, int], rooms: dict[int, int], capacity: int) -> tuple[list[tuple], int]:
    """Moves (length, from, to, room class, first rank in it, used before) by best fit; class -1 holds the new sequences. And how many are new."""
    at: dict[int, list[tuple]] = defaultdict(list)
    heap: list[int] = []
    for room, n in rooms.items():
        if room and n:
            at[room].append((room, 0, n, 0))
    moves, fresh = [], 0
    for v in sorted(counts, reverse=True):
        left, done = counts[v], 0
        heap = [r for r in at if r >= v and at[r]]
        heapq.heapify(heap)
        while left:
            while heap and not at[heap[0]]:
                heapq.heappop(heap)
            if not heap:
                new = -(-left // (capacity // v))
                at[capacity].append((-1, fresh, new, 0))
                fresh += new
                heapq.heappush(heap, capacity)
            room = heap[0]
            kind, rank, n, used = at[room].pop()
            take = min(n, left)
            if take < n:
                at[room].append((kind, rank + take, n - take, used))
            moves.append((v, done, done + take, kind, rank, used))
            at[room - v].append((kind, rank, take, used + v))
            if room - v >= v:
                heapq.heappush(heap, room - v)
            left, done = left - take, done + take
    return moves, fresh


def ranked(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """df(pid, key, ...) with `rank`, from 0 within each key: by pid, then by order. Counts by pid give each pid's first rank."""
    n = df.groupBy(key, "pid").agg(F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    n = n.select(key, "pid", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy(key, "pid").orderBy(*order)) - 1
    return df.withColumn("own", own).join(n, [key, "pid"]).withColumn("rank", F.col("before") + F.col("own")).drop("own", "before")


def pack_pieces(pieces: DataFrame, scratch: Scratch, capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> DataFrame:
    """pieces(doc_id, piece, start, length, ...) with sequence_id and offset. Lengths are from 1 to capacity."""
    spark = pieces.sparkSession
    pieces = scratch.keep(pieces.withColumn("pid", F.spark_partition_id()), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    bases, uses, n_large = plan_large({v: c for v, c in counts.items() if v > small}, capacity, groups)
    r = scratch.keep(ranked(pieces, "length", ["doc_id", "piece", "start"]), "ranked")
    bases = spark.createDataFrame(bases, "length long, g int, base long")  # at most `capacity` rows
    uses = spark.createDataFrame(uses, "g int, lo long, hi long, first long, m long, place long")  # a few for each group
    large = r.join(F.broadcast(bases), "length").withColumn("k", F.col("base") + F.col("rank"))
    large = large.join(F.broadcast(uses), "g").where("k >= lo and k < hi")
    large = large.withColumn("sequence_id", F.expr("first + (k - lo) div m")).withColumn("place", F.expr("place + (k - lo) % m"))
    by = Window.partitionBy("sequence_id")
    large = large.withColumn("offset", F.sum("length").over(by.orderBy("place")) - F.col("length")).withColumn("used", F.sum("length").over(by))
    names = [c for c in pieces.columns if c != "pid"]
    large = scratch.keep(large.select(*names, "sequence_id", "offset", "used").withColumn("pid", F.spark_partition_id()), "large")
    bins = large.where("offset = 0").select("sequence_id", "used", (F.lit(capacity) - F.col("used")).alias("room"), "pid")
    rooms = {x["room"]: x["count"] for x in bins.groupBy("room").count().collect()}  # at most `capacity` rows
    moves, _ = plan_small({v: c for v, c in counts.items() if v <= small}, rooms, capacity)
    moves = spark.createDataFrame(moves, "length long, lo long, hi long, room long, first long, used long")  # a few thousand rows: each splits one class of equal rooms
    tiny = r.where(F.col("length") <= small).join(F.broadcast(moves), "length").where("rank >= lo and rank < hi")
    tiny = tiny.withColumn("nth", F.expr("first + rank - lo"))
    new = tiny.where("room = -1").select(*names, (F.lit(n_large) + F.col("nth")).alias("sequence_id"), F.col("used").alias("offset"))
    spots = ranked(bins, "room", ["sequence_id"]).select("room", F.col("rank").alias("nth"), "sequence_id", F.col("used").alias("full"))
    old = tiny.where("room >= 0").join(spots, ["room", "nth"]).select(*names, "sequence_id", (F.col("full") + F.col("used")).alias("offset"))
    return large.select(*names, "sequence_id", "offset").unionByName(old).unionByName(new)


def best_fit_packing(docs: DataFrame, tokenizer: str, kind: str = "blanks", end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Documents to packed pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_pieces(token_pieces(docs, tokenizer, kind, end_id, capacity), Scratch(docs.sparkSession, "packing"), capacity)
