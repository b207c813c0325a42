"""Importance resampling towards a target distribution: hashed word n-grams, array-scored weights, an exact draw.

Words are runs of ASCII digits, ASCII letters (A-Z count as a-z) and bytes from 0x80 on. Features are all runs of 1 to 3
consecutive words joined by one blank, repeats counted; a feature's bucket is its CRC-32 modulo BUCKETS. With s and t of S and
T features of the documents and of the target in a bucket, its gain is floor(1000 * ln((t+1)*(S+BUCKETS) / ((s+1)*(T+BUCKETS)))),
and a document's weight is the sum over its features. Its score adds a Gumbel variable from the SHA-256 of seed and doc_id, so the
highest scores are a sample without replacement in proportion to exp(weight / 1000).

The draw: each task writes its eligible rows as sorted runs. A sample of the runs' keys bounds ranges of about equal
size, of which only those that the draw reaches are read again; each range merges its pieces of runs by a tournament tree, and
the ranges' counts give the first rank of each. Every row has a key of its own (score, doc_id, run, place), so rows alike in
score and doc_id, however many, are cut into ranges too.

Null text has no words: weight 0, not eligible. A null doc_id hashes like an empty one and comes after all others of its score.
Repeated rows are drawn each. Extra columns are ignored. An empty target gives gains of documents' counts alone; an empty table
gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Scratch
from .textops import LOWER, edges, flat, slices, small, word_table

BUCKETS = 10_000
PERCENT, LEAST_WORDS, SEED = 5, 20, 42
#: A run has at most so many rows; every so many rows of it are in the sample; a range has about so many rows.
RUN_ROWS, SAMPLED, RANGE_ROWS = 1 << 18, 1 << 9, 1 << 15
SLICE_BYTES = 2 << 20
_WORD = word_table(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
#: Words of up to so many bytes are hashed side by side, longer ones one by one.
SHORT = 48
U32 = np.uint32


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 of a byte after a state, and of n zero bytes after each byte of a state: a map of four lookups for each n."""
    step = np.arange(256, dtype=U32)
    for _ in range(8):
        step = np.where(step & U32(1), (step >> U32(1)) ^ U32(0xEDB88320), step >> U32(1))
    shift = np.zeros((SHORT + 2, 4, 256), U32)
    for byte in range(4):
        shift[0, byte] = np.arange(256, dtype=U32) << U32(8 * byte)
    for n in range(1, SHORT + 2):
        shift[n] = (shift[n - 1] >> U32(8)) ^ step[shift[n - 1] & U32(255)]
    return step, shift


_STEP, _SHIFT = _tables()


def appended(first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of a text and another one after it, of `size` bytes, from those of both: the state moves on by `size` zero bytes."""
    out, rest = first, size.copy()
    while True:
        n = np.minimum(rest, SHORT + 1)
        out = _SHIFT[n, 0, out & U32(255)] ^ _SHIFT[n, 1, out >> U32(8) & U32(255)] ^ _SHIFT[n, 2, out >> U32(16) & U32(255)] ^ _SHIFT[n, 3, out >> U32(24)]
        rest -= n
        if not rest.any():
            return out ^ second


def crc_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    size = ends - starts
    order = np.argsort(-np.minimum(size, SHORT + 1), kind="stable")
    begin, n = starts[order], size[order]
    many = int(np.searchsorted(-n, -SHORT))  # the longer ones come first
    state = np.full(len(starts), 0xFFFFFFFF, U32)
    for j in range(int(n[many:].max(initial=0))):
        live = many + int(np.searchsorted(-n[many:], -j))
        state[many:live] = (state[many:live] >> U32(8)) ^ _STEP[(state[many:live] ^ data[begin[many:live] + j]) & U32(255)]
    state ^= U32(0xFFFFFFFF)
    for k in range(many):
        state[k] = zlib.crc32(data[begin[k] : begin[k] + n[k]].tobytes())
    out = np.empty_like(state)
    out[order] = state
    return out


_BLANK = zlib.crc32(b" ")


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each document; the bucket of each feature and its document, in no order."""
    starts, ends = edges(data, offs, _WORD)
    at = np.searchsorted(starts, offs)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(at))
    one = crc_words(LOWER[data], starts, ends)
    size = (ends - starts).astype(np.int64)
    spaced = appended(np.full(len(one), _BLANK, U32), one, size)  # a blank and the word
    last = np.zeros(len(one) + 1, bool)
    last[at] = True
    after = ~last[1:-1]  # the next word is of the same document
    buckets, docs, so_far = [one], [doc], one
    keep = np.arange(len(one))
    for k in (1, 2):
        ok = keep[keep + k < len(one)]
        ok = ok[after[ok + k - 1]]
        so_far = appended(so_far[np.searchsorted(keep, ok)], spaced[ok + k], size[ok + k] + 1)
        buckets.append(so_far)
        docs.append(doc[ok])
        keep = ok
    return np.diff(at), (np.concatenate(buckets) % U32(BUCKETS)).astype(np.int64), np.concatenate(docs)


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many features of texts(text) fall into each bucket; one row for each task and bucket is summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS, np.int64)
        for batch in small(batches):
            data, offs = flat(batch.column("text"))
            for i, j in slices(offs, SLICE_BYTES):
                seen += np.bincount(features(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])[1], minlength=BUCKETS)
        own = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(seen[own])], names=["bucket", "n"])

    found = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for r in found.collect():  # BUCKETS rows at most
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    s_all, t_all = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _keys(score: np.ndarray, doc: np.ndarray, run: int) -> np.ndarray:
    """Keys of 32 bytes whose order is score descending, doc_id ascending, run, place."""
    top = np.int64(-(2**63))
    parts = np.empty((len(score), 4), ">u8")
    parts[:, 0] = (~score ^ top).view(np.uint64)
    parts[:, 1] = (doc ^ top).view(np.uint64)
    order = np.lexsort((parts[:, 1], parts[:, 0]))
    parts = parts[order]
    parts[:, 2], parts[:, 3] = run, np.arange(len(score))
    return order, parts


_SCORED = "doc_id long, n_features long, weight long, score long, eligible boolean, key binary"


def scored(docs: DataFrame, gain: np.ndarray, least_words: int, seed: int) -> DataFrame:
    """docs(doc_id, text) with weight and score; rows are in sorted runs, and eligible ones have the key of their place in all."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")

    def run(parts: list[tuple], number: int) -> Iterator[pa.RecordBatch]:
        doc, h, n_words, n, weight = (np.concatenate(x) for x in zip(*[p[1:] for p in parts], strict=True))
        known = pa.chunked_array([p[0] for p in parts]).combine_chunks()
        score = weight + np.array([math.floor(-1000 * math.log(-math.log((x + 0.5) / 4294967296))) for x in h.tolist()], np.int64)
        own = n_words >= least_words
        order, keys = _keys(score[own], doc[own], number)
        order = np.concatenate([np.flatnonzero(own)[order], np.flatnonzero(~own)])
        raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(keys), [None, pa.py_buffer(keys.tobytes())]).cast(pa.binary())
        raw = pa.concat_arrays([raw, pa.nulls(len(order) - len(keys), pa.binary())])
        out = pa.RecordBatch.from_arrays([known.take(pa.array(order)), *(pa.array(x[order]) for x in (n, weight, score, own)), raw], names=["doc_id", "n_features", "weight", "score", "eligible", "key"])
        yield from small([out], 10_000)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        parts, held, number = [], 0, TaskContext.get().partitionId() << 32
        for batch in small(batches):
            data, offs = flat(batch.column("text"))
            ids, hs = batch.column("doc_id"), batch.column("h").to_numpy(zero_copy_only=False)
            plain = ids.fill_null(2**63 - 1).to_numpy(zero_copy_only=False)
            for i, j in slices(offs, SLICE_BYTES):
                n_words, bucket, doc = features(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                weight = np.zeros(j - i, np.int64)
                np.add.at(weight, doc, gain[bucket])
                parts.append((ids.slice(i, j - i), plain[i:j], hs[i:j], n_words, np.bincount(doc, minlength=j - i), weight))
                held += j - i
            if held >= RUN_ROWS:
                yield from run(parts, number)
                parts, held, number = [], 0, number + 1
        if held:
            yield from run(parts, number)

    return docs.select("doc_id", "text", h.alias("h")).mapInArrow(work, _SCORED)


class Tournament:
    """The least of the heads of k sorted runs, again and again: a tree of losers, so a step costs log2(k) comparisons.

    An inner node holds the run that lost there, and node 0 the winner; runs that are over hold a key above all.
    """

    def __init__(self, runs: list[list[bytes]]):
        self.runs, self.next, k = runs, [0] * len(runs), max(1, len(runs))
        self.head = [r[0] if r else _OVER for r in runs] or [_OVER]
        self.k, self.node, won = k, [0] * k, list(range(-k, k))
        for i in range(2 * k - 1, k - 1, -1):
            won[i] = i - k
        for i in range(k - 1, 0, -1):
            a, b = won[2 * i], won[2 * i + 1]
            won[i], self.node[i] = (a, b) if self.head[a] <= self.head[b] else (b, a)
        self.node[0] = won[1] if k > 1 else 0

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """Run and place in it of each element, in order."""
        head, node, k = self.head, self.node, self.k
        while head[run := node[0]] is not _OVER:
            yield run, self.next[run]
            self.next[run] += 1
            own = self.runs[run]
            head[run] = own[self.next[run]] if self.next[run] < len(own) else _OVER
            i = (run + k) // 2
            while i:
                if head[node[i]] < head[run]:
                    run, node[i] = node[i], run
                i //= 2
            node[0] = run


_OVER = b"\xff" * 33  # above any key of 32 bytes


def drawn(rows: DataFrame, draw: int, scratch: Scratch) -> tuple[DataFrame | None, bytes | None]:
    """The first `draw` eligible rows of rows by key, with `rank` from 1 on, and the last one's key."""
    if draw <= 0:
        return None, None
    # every SAMPLED-th row of a run stands for the rows up to the next one; those after a run's last sample are in front of
    # none, so a bound after samples for `draw` rows and one share for each run is behind the draw's last row for certain
    place = F.conv(F.hex(F.substring("key", 25, 8)), 16, 10).cast("long")
    sample = rows.where("eligible").select("key", place.alias("place")).where(F.col("place") % SAMPLED == 0)
    runs = sample.where("place = 0").count()
    bounds = [bytes(r["key"]) for r in sample.orderBy("key").limit(draw // SAMPLED + runs + 1).collect()]  # a row for SAMPLED rows drawn, and for each run
    last, bounds = (bounds[-1] if len(bounds) > draw // SAMPLED + runs else None), bounds[RANGE_ROWS // SAMPLED :: RANGE_ROWS // SAMPLED]
    near = rows.where("eligible") if last is None else rows.where("eligible").where(F.col("key") <= F.lit(last))
    cuts = np.array(bounds, "S32")

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.array(batch.column("key").to_pylist(), "S32")
            part = np.searchsorted(cuts, keys, "right") if len(cuts) else np.zeros(len(keys), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int64)), *batch.columns], names=["part", *batch.schema.names])

    near = scratch.keep(near.drop("eligible").mapInArrow(ranged, "part long, doc_id long, n_features long, weight long, score long, key binary"), "near")
    before, total = {}, 0
    for r in near.groupBy("part").count().orderBy("part").collect():  # a row for each range
        before[r["part"]] = total
        total += r["count"]
    reached = max(p for p in before if before[p] < draw)

    def merged(key: tuple, rows: pa.Table) -> pa.Table:
        first = before[key[0].as_py()]
        keys = rows.column("key").to_pylist()
        runs: dict[bytes, list[tuple[bytes, int]]] = {}
        for k, x in enumerate(keys):
            runs.setdefault(x[16:24], []).append((x, k))
        own = [sorted(r) for r in runs.values()]  # pieces of a run may come in any order
        tree, order = Tournament([[x for x, _ in r] for r in own]), []
        for r, at in tree:
            if first + len(order) == draw:
                break
            order.append(own[r][at][1])
        out = rows.select(["doc_id", "n_features", "weight", "score", "key"]).take(pa.array(order, pa.int64()))
        return out.append_column("rank", pa.array(np.arange(first + 1, first + 1 + len(order))))

    out = near.where(F.col("part") <= reached).groupBy("part").applyInArrow(merged, "doc_id long, n_features long, weight long, score long, key binary, rank long")
    out = scratch.keep(out, "drawn")
    return out, bytes(out.where(F.col("rank") == draw).first()["key"])


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_features, weight, score, rank (null: not drawn)."""
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "resampling")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    gain = gains(bucket_counts(docs), bucket_counts(target))
    rows = scratch.keep(scored(docs, gain, least_words, seed), "scored")
    draw = percent * rows.where("eligible").count() // 100
    top, last = drawn(rows, draw, scratch)
    result = ["doc_id", "n_features", "weight", "score", "rank"]
    rest = rows if top is None else rows.where(~F.col("eligible") | (F.col("key") > F.lit(last)))
    rest = rest.withColumn("rank", F.lit(None).cast("long")).select(result)
    return rest if top is None else top.select(result).unionByName(rest)


#: DuckDB SQL for resample(documents, benchmark): CRC-32 by a table of its 256 steps, over each distinct feature's bytes.
SQL = f"""WITH steps AS (SELECT list(v ORDER BY i) AS step FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) AS v FROM range(256) r(i))),
d AS (SELECT row_number() OVER () AS id, false AS target, doc_id, text FROM documents UNION ALL SELECT -1, true, NULL, text FROM benchmark),
words AS (SELECT id, target, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM d),
grams AS (SELECT id, target, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM words),
counted AS MATERIALIZED (SELECT id, target, f, count(*) AS n FROM grams GROUP BY ALL),
hashed AS MATERIALIZED (SELECT f, xor(list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket FROM (SELECT DISTINCT f FROM counted), steps),
buckets AS (SELECT bucket, coalesce(sum(n) FILTER (NOT target), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (target), 0)::DOUBLE AS t FROM counted JOIN hashed USING (f) GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + {BUCKETS}) / ((s + 1) * (sum(t) OVER () + {BUCKETS}))))::BIGINT AS gain FROM buckets),
weights AS (SELECT id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM counted JOIN hashed USING (f) JOIN gains USING (bucket) WHERE NOT target GROUP BY id),
scored AS (SELECT id, doc_id, len(w) >= {LEAST_WORDS} AS eligible, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('{SEED}:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM words LEFT JOIN weights USING (id) WHERE NOT target),
ranked AS (SELECT *, row_number() OVER (PARTITION BY eligible ORDER BY score DESC, doc_id) AS place, count(*) FILTER (eligible) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN eligible AND place <= n * {PERCENT} // 100 THEN place END AS rank FROM ranked"""
