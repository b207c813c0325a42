"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Texts are lower-cased (A-Z), every other ASCII sign counts as a blank, and each text starts with one.
Features are the distinct n-grams of 4 to 6 characters of a whole text. Their log-count ratio is
r = log((p + 1) / (|p| + 2)) - log((q + 1) / (|q| + 2)), with p and q the numbers of documents of
either label that hold the n-gram and |p|, |q| the documents. A logistic regression with an L2
penalty learns weights for the features times r.

Features are hashed to 2**SLOT_BITS slots. It is fitted in one task on at most `most_toxic` + `most_clean` labelled documents (by a hash of
their ids, and of these as many as hold SAMPLE_BYTES) outside the held-out fifth, and keeps the `most_features` n-grams that differ most.
Of rows with the same doc_id the fit takes the least text.
Scoring reads every whole text. Null and empty texts get the score that the constant gives. Rows
with null doc_id are scored, count as not held out and are never trained on. Where the sample lacks a label, or
no n-gram tells the labels apart, the score follows the labels' numbers alone, (toxic + 0.5) to (clean + 1.5), so that
without any label all documents count as clean. Repeated rows are scored each. Extra columns are ignored.
"""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import Scratch, small_batches
from .textops import BYTE, U, flat, mix, powers, slices, small

GRAMS = (4, 5, 6)
MOST_TOXIC, MOST_CLEAN = 1500, 2500
MOST_FEATURES = 30_000
SAMPLE_BYTES = 64 << 20
SLICE_BYTES = 1 << 18
#: An n-gram's feature is the top bits of its hash.
SLOT_BITS = 23

_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def grams(data: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all runs of n characters, and n_docs + 1 offsets. data holds a blank before each text (see folded)."""
    first = np.flatnonzero((data & 0xC0) != 0x80)
    pw, inv = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * pw[: len(data)], out=sums[1:])
    at = np.searchsorted(first, offs)
    edge = np.append(first, len(data))
    m = max(0, len(first) - n + 1)
    a, z = edge[:m], edge[n : n + m]
    h = (mix((sums[z] - sums[a]) * inv[a] + U(n)) >> U(64 - SLOT_BITS)).astype(np.int64)
    doc_end = np.repeat(at[1:], np.diff(at))[:m]
    ok = np.arange(m) + n <= doc_end
    return h[ok], np.concatenate([[0], np.cumsum(ok)])[np.minimum(at, m)]


def folded(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(offs) - 1
    out = np.full(len(data) + n, 32, np.uint8)
    own = np.ones(len(out), bool)
    own[offs[:-1] + np.arange(n)] = False
    out[own] = _FOLD[data]
    return out, offs + np.arange(n + 1)


class Model:
    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(keys)
        self.keys, self.weights, self.bias, self.name = keys[order], weights[order], bias, uuid.uuid4().hex

    def table(self) -> np.ndarray:
        """Which slots have a weight; built once for each worker process."""
        home = sys.modules.setdefault("_tessera_worker", types.ModuleType("_tessera_worker"))
        if getattr(home, "toxic_name", None) != self.name:
            home.toxic = np.zeros(1 << SLOT_BITS, bool)
            home.toxic[self.keys] = True
            home.toxic_name = self.name
        return home.toxic

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        out = np.full(len(offs) - 1, self.bias)
        if len(self.keys):
            table = self.table()
            data, offs = folded(data, offs)
            pairs = []
            for n in GRAMS:
                h, at = grams(data, offs, n)
                on = np.flatnonzero(table[h])
                doc = np.searchsorted(at, on, "right") - 1
                pairs.append(doc * len(self.keys) + np.searchsorted(self.keys, h[on]))
            pair = np.unique(np.concatenate(pairs))
            out += np.bincount(pair // len(self.keys), self.weights[pair % len(self.keys)], len(out))
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def _slots(data: np.ndarray, offs: np.ndarray):
    """Each document's number and distinct slots."""
    for i, j in slices(offs, SLICE_BYTES):
        some, at = folded(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        found = [grams(some, at, n) for n in GRAMS]
        for d in range(j - i):
            yield i + d, np.unique(np.concatenate([h[own[d] : own[d + 1]] for h, own in found]))


def _differing(counts: np.ndarray, n1: float, n0: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The slots that differ most between the labels, by the statistic of the two shares, ascending, and their log-count ratios."""
    slots, stats = [], []
    step = 1 << 20
    for a in range(0, counts.shape[1], step):
        q, p = counts[0, a : a + step].astype(float), counts[1, a : a + step].astype(float)
        share = (p + q) / (n1 + n0)
        z = np.abs(p / n1 - q / n0) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / n0))
        on = np.flatnonzero((z >= 3) & (p + q >= 3))
        slots.append(on + a)
        stats.append(z[on])
    slots, stats = np.concatenate(slots), np.concatenate(stats)
    slots = np.sort(slots[np.argsort(-stats, kind="stable")[:most]])
    r = np.log((counts[1, slots] + 1.0) / (n1 + 2)) - np.log((counts[0, slots] + 1.0) / (n0 + 2))
    return slots.astype(np.int64), r


def fit(texts: list[str] | pa.Array, toxic: list[int], most_features: int = MOST_FEATURES, penalty: float = 1e-3, steps: int = 300) -> Model:
    """A model from fewer than 65,536 labelled texts. Where nothing tells the labels apart, or there is one or none, their shares alone
    decide, and without any label all texts count as clean."""
    y = np.array(toxic, float)
    n1, n0 = y.sum(), (1 - y).sum()
    prior = Model(np.zeros(0, np.int64), np.zeros(0), float(np.clip(np.log((n1 + 0.5) / (n0 + 1.5)), -6, 6)))
    if not n1 or not n0:
        return prior
    data, offs = flat(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts)
    counts = np.zeros((2, 1 << SLOT_BITS), np.uint16)
    for i, slots in _slots(data, offs):
        counts[toxic[i], slots] += 1
    slots, r = _differing(counts, n1, n0, most_features)
    del counts
    if not len(slots):
        return prior
    col, size = [], np.zeros(len(y), np.int64)
    for i, own in _slots(data, offs):
        k = np.minimum(np.searchsorted(slots, own), max(0, len(slots) - 1))
        k = k[slots[k] == own] if len(slots) else k[:0]
        col.append(k.astype(np.int32))
        size[i] = len(k)
    del data
    col = np.concatenate(col)
    row = np.repeat(np.arange(len(y), dtype=np.int32), size)[np.argsort(col, kind="stable")]  # documents in order of features
    each = np.bincount(col, minlength=len(r))

    def sums(values: np.ndarray, index: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Sums of values[index] over runs of n each, some runs at a time."""
        edge, out, a = np.concatenate([[0], np.cumsum(n)]), np.zeros(len(n)), 0
        while a < len(n):
            b = max(a + 1, int(np.searchsorted(edge, edge[a] + (1 << 18), "right")) - 1)
            own = np.flatnonzero(n[a:b]) + a
            if len(own):
                out[own] = np.add.reduceat(values[index[edge[a] : edge[b]]], edge[own] - edge[a])
            a = b
        return out

    # gradient steps with momentum terms on the whole sample; either label weighs half
    w, b = np.zeros(len(r)), 0.0
    weigh = np.where(y == 1, 0.5 / n1, 0.5 / n0)
    m, v = np.zeros(len(r) + 1), np.zeros(len(r) + 1)
    for t in range(1, steps + 1):
        s = sums(w * r, col, size) + b
        g = weigh * (1 / (1 + np.exp(-np.clip(s, -500, 500))) - y)
        grad = np.append(sums(g, row, each) * r + penalty * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    own = w * r
    keep = np.abs(own) > 1e-4
    return Model(slots[keep], own[keep], float(b))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> Model:
    """Fits on labelled documents outside the held-out fifth: at most so many of either label."""
    small_batches(docs.sparkSession)
    known = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    ids = known.where("toxic = 1").orderBy(order, "doc_id").limit(most_toxic).unionByName(known.where("toxic = 0").orderBy(order, "doc_id").limit(most_clean))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")  # at most most_toxic + most_clean ids
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").cast("int").alias("toxic")).select("text", "toxic", F.xxhash64("doc_id").alias("turn"), F.col("doc_id").cast("long").alias("doc_id"))
    rows = Scratch(docs.sparkSession, "toxicity").keep(rows, "sample")
    # texts beyond SAMPLE_BYTES, in the order of `turn`, stay where they are: only their lengths are added up (most_toxic + most_clean rows)
    upto = F.sum(F.octet_length("text").cast("long")).over(Window.orderBy("turn", "doc_id"))
    near = rows.select("doc_id", "turn", upto.alias("upto"), F.row_number().over(Window.orderBy("turn", "doc_id")).alias("nth")).where((F.coalesce("upto", F.lit(0)) <= SAMPLE_BYTES) | (F.col("nth") == 1))
    rows = rows.join(F.broadcast(near.select("doc_id")), "doc_id").select("text", "toxic", "turn", "doc_id")
    got = rows.repartition(1).mapInArrow(_fitted, "keys binary, weights binary, bias double").first()
    return Model(np.frombuffer(got["keys"], np.int64), np.frombuffer(got["weights"], float), got["bias"]) if got else fit([], [])


_SAMPLE = pa.schema([("text", pa.string()), ("toxic", pa.int32()), ("turn", pa.int64()), ("doc_id", pa.int64())])


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sample's model as a row; the sample fits into a task by its bounds."""
    batches = list(batches)
    table = pa.Table.from_batches(batches) if batches else _SAMPLE.empty_table()
    turn, ids = (table.column(c).to_numpy() for c in ("turn", "doc_id"))
    table = table.take(pa.array(np.lexsort((ids, turn))))
    model = fit(table.column("text").combine_chunks(), table.column("toxic").to_pylist())
    del table
    yield pa.RecordBatch.from_arrays([pa.array([model.keys.tobytes()], pa.binary()), pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias])], names=["keys", "weights", "bias"])


def toxicity(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """docs with score double and predicted int."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most most_features keys and weights
    names = docs.columns

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            data, offs = flat(batch.column("text"))
            scores = [sent.value.scores(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in slices(offs, SLICE_BYTES)]
            s = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    schema = docs.select("*", F.lit(0.0).cast("double").alias("score"), F.lit(0).cast("int").alias("predicted")).schema
    return docs.mapInArrow(judge, schema)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return toxicity(own, train(docs, labels)).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that the classifier predicts toxic."""
    names = docs.columns
    plain = docs.toDF(*["text" if c == "text" else f"c{k}" for k, c in enumerate(names)])
    return toxicity(plain, train(docs, labels)).where("predicted = 0").select(*[F.col(c).alias(name) for c, name in zip(plain.columns, names, strict=True)])
