"""Benchmark decontamination with an FM-index for each shard of the training text.

Words are runs of ASCII digits, ASCII letters (A-Z count as a-z) and bytes from 0x80 on. A test item's
windows are its runs of `window` words; an item of fewer words, but not none, is one window. A
document word inside any occurrence of a window is hit.

A shard is a slice of a partition of bounded size. Only its runs of words that the test items use can
hold a window, so the index covers these: a suffix array by prefix doubling, its Burrows-Wheeler
transform in a wavelet matrix, and suffix positions kept at every eighth place and at run starts.
All windows are searched backwards at once; their suffix ranges are walked to kept positions, and
the occurrences' spans are merged for each document.

Null text has no words. Null item text, and items without words, have no windows. Items with equal
windows all count; equal item_ids count once; the windows of items with null item_id hit words, but such items
are not listed or counted. Repeated rows are judged each. Extra columns are ignored. An empty test table
leaves every document clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .store import Scratch
from .textops import LOWER, edges, flat, run_hashes, slices, word_table, small

WINDOW = 10
SHARD_BYTES = 4 << 20
#: Test items are searched in blocks of about so many bytes of text; each is a pass, with a broadcast of about ten times its size at most.
BLOCK_BYTES = 4 << 20
KEPT_EVERY = 8
_WORD = word_table(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)


def words_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, ends and hashes."""
    starts, ends = edges(data, offs, _WORD)
    return starts, ends, run_hashes(LOWER[data], starts, ends)


class Windows:
    """The windows of a block of test items as word symbols 1..V, and the items of each."""

    def __init__(self, items: list, texts: list, window: int):
        data, offs = flat(pa.array(texts, pa.large_string()))
        starts, _, h = words_of(data, offs)
        self.vocabulary, symbols = np.unique(h, return_inverse=True)
        symbols = symbols.astype(np.int32) + 1
        at = np.searchsorted(starts, offs)
        size = np.diff(at)
        #: distinct ids as strings, ascending; items without an id have windows but are not listed
        self.items = sorted({str(x) for x in items if x is not None})
        place = {x: i for i, x in enumerate(self.items)}
        ids = np.array([-1 if x is None else place[str(x)] for x in items], np.int64)
        #: length -> windows as rows, first item of each, items of all
        self.groups = {}
        for n in np.unique(np.minimum(size[size > 0], window)).tolist():
            own = np.flatnonzero(size >= window if n == window else size == n)
            m = size[own] - n + 1
            first = np.repeat(at[own], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            rows, which = np.unique(np.lib.stride_tricks.sliding_window_view(symbols, n)[first], axis=0, return_inverse=True)
            pairs = np.unique(np.stack([which.ravel(), np.repeat(ids[own], m)], 1), axis=0)
            pairs = pairs[pairs[:, 1] >= 0]
            self.groups[n] = (rows, np.searchsorted(pairs[:, 0], np.arange(len(rows) + 1)), pairs[:, 1])
        self.shortest = min(self.groups, default=0)


class FMIndex:
    """Of a sequence of symbols 1..top cut into runs; windows never cross a cut."""

    def __init__(self, symbols: np.ndarray, run_starts: np.ndarray, top: int):
        n, runs = len(symbols) + len(run_starts), len(run_starts)
        # a distinct, smaller symbol ends each run, so that no comparison goes beyond it
        ends = np.append(run_starts[1:], len(symbols))
        text = np.empty(n, np.int64)
        self.place = np.arange(len(symbols)) + np.repeat(np.arange(runs), ends - run_starts)
        text[self.place] = symbols + runs
        stop = ends + np.arange(runs)
        text[stop] = np.arange(runs)
        _, rank = np.unique(text, return_inverse=True)
        order, k = np.argsort(rank, kind="stable"), 1
        while True:
            nxt = np.full(n, 0, np.int64)
            nxt[: n - k] = rank[k:] + 1
            key = rank * (n + 1) + nxt
            order = np.argsort(key, kind="stable")
            step = np.empty(n, np.int64)
            step[0] = 0
            np.cumsum(key[order][1:] != key[order][:-1], out=step[1:])
            rank = np.empty(n, np.int64)
            rank[order] = step
            if step[-1] == n - 1:
                break
            k *= 2
        self.n = n
        last = text[(order - 1) % n] - runs
        self.last = np.where(last < 0, 0, last)  # all ends look alike; no walk passes one
        seen = np.bincount(np.where(text < runs, 0, text - runs), minlength=top + 2)
        self.before = np.concatenate([[0], np.cumsum(seen)[:-1]])
        self.levels = []
        now = self.last
        for bit in range(max(1, int(top).bit_length()) - 1, -1, -1):
            on = (now >> bit & 1).astype(bool)
            ones = np.concatenate([[0], np.cumsum(on)])
            self.levels.append((bit, ones, n - int(ones[-1])))
            now = np.concatenate([now[~on], now[on]])
        kept = np.zeros(n, bool)
        kept[self.place[run_starts]] = True
        kept[self.place[::KEPT_EVERY]] = True
        self.kept, self.where = kept[order], np.where(kept[order], order, -1)

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol is among the first `upto` of the transform."""
        lo, hi = np.zeros_like(upto), upto
        for bit, ones, zeros in self.levels:
            on = (symbol >> bit & 1).astype(bool)
            lo = np.where(on, zeros + ones[lo], lo - ones[lo])
            hi = np.where(on, zeros + ones[hi], hi - ones[hi])
        return hi - lo

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which windows occur, and their suffix ranges."""
        who = np.arange(len(windows))
        lo, hi = np.zeros(len(windows), np.int64), np.full(len(windows), self.n, np.int64)
        for j in range(windows.shape[1] - 1, -1, -1):
            c = windows[who, j]
            lo, hi = self.before[c] + self.rank(c, lo), self.before[c] + self.rank(c, hi)
            on = lo < hi
            who, lo, hi = who[on], lo[on], hi[on]
        return who, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of suffix ranks: back to a kept place, counting steps."""
        out, steps, who = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        while len(who):
            on = self.kept[rows]
            out[who[on]] = self.where[rows[on]] + steps
            who, rows = who[~on], rows[~on]
            c = self.last[rows]
            rows = self.before[c] + self.rank(c, rows)
            steps += 1
        return out


def shard_hits(data: np.ndarray, offs: np.ndarray, windows: Windows) -> tuple:
    """For a shard: words of each document, how many occurrences begin less end at each word, word starts and ends, and sorted (document, item place)."""
    starts, ends, h = words_of(data, offs)
    at = np.searchsorted(starts, offs)
    cover, found = np.zeros(len(starts) + 1, np.int64), []
    vocabulary = windows.vocabulary
    if not len(vocabulary) or not len(h):
        return at, cover, starts, ends, np.zeros((0, 2), np.int64)
    s = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    known = vocabulary[s] == h
    a, z = edges(known.view(np.uint8), at, np.array([False] + [True] * 255))
    long = z - a >= windows.shortest
    a, z = a[long], z[long]
    if not len(a):
        return at, cover, starts, ends, np.zeros((0, 2), np.int64)
    size = z - a
    own = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(a, size)
    index = FMIndex(s[own] + 1, np.cumsum(size) - size, len(vocabulary))
    back = np.zeros(index.n, np.int64)
    back[index.place] = own
    for n, (rows, first, items) in windows.groups.items():
        who, lo, hi = index.search(rows)
        if not len(who):
            continue
        times = hi - lo
        place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(lo, times)
        word, who = back[index.locate(place)], np.repeat(who, times)
        np.add.at(cover, word, 1)
        np.add.at(cover, word + n, -1)
        doc = np.searchsorted(at, word, "right") - 1
        pairs = np.unique(np.stack([doc, who], 1), axis=0)
        k = first[pairs[:, 1] + 1] - first[pairs[:, 1]]
        item = items[np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(first[pairs[:, 1]], k)]
        found.append(np.stack([np.repeat(pairs[:, 0], k), item], 1))
    return at, cover, starts, ends, np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)


def blocks_of(benchmark: DataFrame, window: int = WINDOW) -> Iterator[Windows]:
    """The windows of the test items, block by block; at least one, which may be empty."""
    items, texts, size, none = [], [], 0, True
    for row in benchmark.select("item_id", F.col("text").cast("string").alias("text")).toLocalIterator():
        items.append(row["item_id"])
        texts.append(row["text"] or "")
        size += len(texts[-1])
        if size >= BLOCK_BYTES:
            yield Windows(items, texts, window)
            items, texts, size, none = [], [], 0, False
    if items or none:
        yield Windows(items, texts, window)


_FLAG = np.array([False] + [True] * 255)


def search(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, finish=None, result: StructType | None = None) -> DataFrame:
    """docs(c0, c1, ..., text) with n_words, hits (starts and ends of the merged runs of hit words, in turn) and item_ids.

    With `finish`, the last pass gives finish(batch) of each such batch, of the schema `result`, in the same worker.

    Each block of test items is one pass over the documents that adds to what the passes before have found, so one
    block at a time is in the driver and in a worker.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "contamination")
    names = docs.columns
    schema = StructType([*docs.schema.fields, StructField("n_words", LongType()), StructField("hits", ArrayType(LongType())), StructField("item_ids", ArrayType(StringType()))])

    def passed(block, more: bool, done):
        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows = block.value
            for batch in small(batches):
                data, offs = flat(batch.column("text"))
                for i, j in slices(offs, SHARD_BYTES):
                    at, cover, _, _, pairs = shard_hits(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], windows)
                    part = batch.slice(i, j - i)
                    own: list[set] = [set(x) for x in part.column("item_ids").to_pylist()] if more else [set() for _ in range(j - i)]
                    if more:
                        for d, seen in enumerate(part.column("hits").to_pylist()):
                            np.add.at(cover, np.array(seen[::2], np.int64) + at[d], 1)
                            np.add.at(cover, np.array(seen[1::2], np.int64) + at[d], -1)
                    for d, k in pairs.tolist():
                        own[d].add(windows.items[k])
                    hit = np.cumsum(cover[:-1]) > 0
                    a, z = edges(hit.view(np.uint8), at, _FLAG)
                    d = np.searchsorted(at, a, "right") - 1
                    n = np.bincount(d, minlength=j - i)
                    flags = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(2 * n)]), pa.int32()), pa.array(np.stack([a - at[d], z - at[d]], 1).ravel(), pa.int64()))
                    out = pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(np.diff(at), pa.int64()), flags, pa.array([sorted(x) for x in own], pa.list_(pa.string()))], names=[*names, "n_words", "hits", "item_ids"])
                    yield done(out) if done else out

        return judge

    out, k, blocks = docs, 0, blocks_of(benchmark, window)
    block = next(blocks)
    while block is not None:
        sent = spark.sparkContext.broadcast(block)  # about BLOCK_BYTES of text as numbers
        following = next(blocks, None)
        last = finish if following is None else None
        out = out.mapInArrow(passed(sent, k > 0, last), result if last else schema)
        block, k = following, k + 1
        if block is not None:
            out = scratch.keep(out, f"pass{k}")
            sent.destroy()
            if k > 1:
                scratch.drop(f"pass{k - 1}")
    return out


REPORT = "doc_id long, n_words long, n_hit long, n_items long, item_ids array<string>, spans array<struct<start:long,end:long>>, items_sha256 string, contaminated boolean"


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, with_spans: bool = True) -> DataFrame:
    """Per document: word and hit counts, the items found (sorted as strings), and the merged byte spans that hits cover."""
    found = search(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), benchmark, window)
    n_hit = F.expr("aggregate(hits, 0L, (n, x) -> x - n)")  # of starts and ends in turn: what ends hold less what starts do
    found = found.select("doc_id", "text", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), "item_ids", "hits", F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))
    if not with_spans:
        return found.drop("text", "hits")

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            got = [[{"start": a, "end": z} for a, z in s] for s in _byte_spans(batch.column("text"), batch.column("hits"))]
            columns = [pa.array(got, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))) if c == "spans" else batch.column(c) for c in _REPORT_NAMES]
            yield pa.RecordBatch.from_arrays(columns, names=_REPORT_NAMES)

    return found.mapInArrow(spans, REPORT)


_REPORT_NAMES = ["doc_id", "n_words", "n_hit", "n_items", "item_ids", "spans", "items_sha256", "contaminated"]


def _byte_spans(texts: pa.Array, hits: pa.Array) -> list[list[tuple[int, int]]]:
    """Runs of hit words as byte spans of their texts."""
    out = []
    for text, seen in zip(texts, hits.to_pylist(), strict=True):
        if not seen:
            out.append([])
            continue
        data, offs = flat(pa.array([text.as_py()], pa.large_string()))
        starts, ends = edges(data, offs, _WORD)
        out.append([(int(starts[a]), int(ends[z - 1])) for a, z in zip(seen[::2], seen[1::2], strict=True)])
    return out


def remove_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with every hit span cut out of its text, and n_chars to match; a document of which only white space is left goes.

    Documents without a hit pass untouched, null text included.
    """
    names = docs.columns
    at = names.index("text")
    plain = docs.toDF(*["text" if k == at else f"c{k}" for k in range(len(names))])
    own = plain.columns

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, stay = batch.column("text").to_pylist(), np.ones(len(batch), bool)
        for d, spans in enumerate(_byte_spans(batch.column("text"), batch.column("hits"))):
            if spans:
                raw, left, last = texts[d].encode(), [], 0
                for a, z in spans:
                    left.append(raw[last:a])
                    last = z
                texts[d] = b"".join([*left, raw[last:]]).decode("utf-8", "replace")
                stay[d] = bool(texts[d].strip())
        columns = [pa.array(texts, batch.schema.field(c).type) if c == "text" else batch.column(c) for c in own]
        return pa.RecordBatch.from_arrays(columns, names=own).filter(pa.array(stay))

    out = search(plain, benchmark, window, cut, plain.schema).toDF(*names)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*names) if "n_chars" in names else out
