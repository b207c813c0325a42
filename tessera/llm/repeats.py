"""Removal of repeated strings by prefix-free parsing, over whole texts as bytes.

A byte goes if it lies in a `window`-byte string of its document that also starts earlier: in a
document with a smaller doc_id, or earlier in the same. Strings are judged on the input.

The trigger of a window is its K-byte string with the least rolling hash, so every window has one, equal windows
have equal ones in equal places, and it stands between two phrases: what the windows of a trigger reach to
its left, and what they reach from it on. A document is parsed into the phrases at its triggers.

 1. Documents are dealt to parts. Each part sends the distinct hashes of its triggers once, so that a
    passage that many documents share arrives once from each part; hashes of one occurrence are done.
 2. Around each trigger left, its two phrases are an entry. A part sends each distinct entry once, with its
    first place in the part.
 3. At a hash's place, the left phrases of all parts are the dictionary, and what follows them is the parse.
    Both are sorted as suffix arrays with the lengths of common prefixes: the dictionary by the phrases'
    suffixes up to the trigger, the parse by the strings from it on. A window is a suffix of a phrase and a
    prefix of what follows, so the two ranks at those lengths combine to its class, byte for byte, and
    the first places give each class its first start in corpus order.
 4. Each part hears, for its entries, where their windows start first; a window that starts there
    later is repeated. Its documents' repeated windows are merged and cut out.

There is no single array of the whole corpus: it is dealt out by trigger, and only runs of windows travel. Entries are
told apart by 128 bits of hashes on their way; windows are compared by their bytes.

Texts travel packed and compressed. Null text is empty. Documents with equal doc_id are ordered by a
hash of their text; rows equal in both are one document. Null doc_ids come first. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch, parts
from .textops import BYTE, U, blob, flat, mix, slices, unblob

WINDOW, K = 100, 32
SLICE_BYTES = 2 << 20
#: At a hash's place, whole hashes of about so many entries together are ranked at a time, to bound memory.
SHARE = 1 << 15
#: A window's trigger is the first with the least upper bits of its hash; the lower bits hold its place.
_PLACE = U((1 << 36) - 1)
_LOW48 = U((1 << 48) - 1)
_TOP = U(0xFFFFFFFFFFFFFFFF)
_ROW = "part int, kind int, payload binary"
_ARROW = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])


def _rolling(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k bytes, k a power of two, by doubling."""
    h, have, mult = BYTE[data], 1, 0x9E3779B97F4A7C15
    while have < k:
        h = h[:-have] * U(pow(mult, have, 1 << 64)) + h[have:] if len(h) > have else h[:0]
        have *= 2
    return mix(h)


def _sliding(x: np.ndarray, n: int, f) -> np.ndarray:
    """f (minimum or maximum) over each n consecutive values."""
    have, out = 1, x
    while have * 2 <= n:
        out = f(out[:-have], out[have:])
        have *= 2
    return f(out[: len(out) - (n - have)], out[n - have :]) if n > have else out


def triggers(data: np.ndarray, offs: np.ndarray, window: int = WINDOW, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of all triggers, ascending, their hashes, and the first and last start of the windows that have each."""
    n, span = len(data), window - k + 1
    none = np.zeros(0, np.int64)
    if n < window:
        return none, np.zeros(0, np.uint64), none, none
    h = _rolling(data, k)
    at = (_sliding((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), span, np.minimum) & _PLACE).astype(np.int64)
    end = np.repeat(offs[1:], np.diff(offs))[: len(at)]
    start = np.flatnonzero(np.arange(len(at)) + window <= end)  # windows within a document
    at = at[start]
    if not len(at):
        return none, np.zeros(0, np.uint64), none, none
    turn = np.flatnonzero(at[1:] != at[:-1]) + 1
    lo, hi = np.concatenate([[0], turn]), np.append(turn, len(at))
    return at[lo], mix(h[at[lo]]), start[lo], start[hi - 1]  # least hashes are small; mixed ones spread over all places


def _zstd():
    import zstandard

    return zstandard


def _pack(p: int):
    """Documents to their parts, as compressed blobs."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = _zstd().ZstdCompressor(level=1)
        for batch in batches:
            data, offs = flat(batch.column("text"))
            ids = batch.column("doc_id").fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            ties = batch.column("tie").to_numpy(zero_copy_only=False)
            dest = (mix(ids.view(np.uint64).copy()) % U(p)).astype(np.int64)
            for i, j in slices(offs, SLICE_BYTES * 8):
                order = np.argsort(dest[i:j], kind="stable") + i
                d = dest[order]
                cut = np.concatenate([[0], np.flatnonzero(d[1:] != d[:-1]) + 1, [j - i]])
                rows = []
                for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    own = order[a:b]
                    text = b"".join(data[offs[q] : offs[q + 1]].tobytes() for q in own.tolist())
                    rows.append((int(d[a]), blob(ids[own], ties[own], np.diff(offs)[own], np.frombuffer(z.compress(text), np.uint8))))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([0] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema=_ARROW)

    return pack


class _Part:
    """A part's documents, in corpus order of arrival, and the other payloads sent to it."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        z = _zstd().ZstdDecompressor()
        self.number, self.docs, self.other = None, [], []
        for batch in batches:
            for part, kind, raw in zip(batch.column("part").to_pylist(), batch.column("kind").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                self.number = part
                if kind:
                    self.other.append(raw)
                else:
                    ids, ties, size, text = unblob(raw, np.int64, np.int64, np.int64, np.uint8)
                    self.docs.append((ids, ties, size, z.decompress(text.tobytes()) if size.sum() else b""))

    def slices(self):
        """(ids, ties, bytes, offsets) of bounded size, in the same order each time."""
        for ids, ties, size, text in self.docs:
            offs = np.concatenate([[0], np.cumsum(size)])
            data = np.frombuffer(text, np.uint8)
            for i, j in slices(offs, SLICE_BYTES):
                yield ids[i:j], ties[i:j], data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]


def _deal(keys: np.ndarray, p: int) -> np.ndarray:
    return (((keys >> U(40)) * U(p)) >> U(24)).astype(np.int64)


def _out(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in ((0, pa.int32()), (1, pa.int32()), (2, pa.binary()))], schema=_ARROW)


def _cuts(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1, [len(x)]]) if len(x) else np.zeros(1, np.int64)


def _send_hashes(p: int, window: int):
    def send(batches):
        part, found = _Part(batches), []
        for _, _, data, offs in part.slices():
            h, n = np.unique(triggers(data, offs, window)[1], return_counts=True)
            found.append(np.stack([h, n.astype(np.uint64)]))
        if not found:
            return
        h, n = np.concatenate(found, axis=1)
        order = np.argsort(h, kind="stable")
        h, n = h[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        h, n = h[first], np.add.reduceat(n, first) if len(h) else n
        dest = _deal(h, p)
        rows, cut = [], _cuts(dest)
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            low = np.ascontiguousarray(h[a:b].view(np.uint8).reshape(-1, 8)[:, :6]).ravel()
            rows.append((int(dest[a]), 1, blob(np.array([part.number], np.int64), low, np.packbits(n[a:b] > 1))))
        if rows:
            yield _out(rows)

    return send


def _return_hashes(batches):
    """To each part: its hashes (48 bits) that occur elsewhere or more than once."""
    who, hs, more, at = [], [], [], 0
    for batch in batches:
        for dest, raw in zip(batch.column("part").to_pylist(), batch.column("payload").to_pylist(), strict=True):
            part, low, many = unblob(raw, np.int64, np.uint8, np.uint8)
            wide = np.zeros((len(low) // 6, 8), np.uint8)
            wide[:, :6] = low.reshape(-1, 6)
            h = wide.view(np.uint64).ravel()
            at = dest
            hs.append(h)
            who.append(np.full(len(h), part[0]))
            more.append(np.unpackbits(many)[: len(h)].astype(bool))
    if not hs:
        return
    h, who, more = np.concatenate(hs), np.concatenate(who), np.concatenate(more)
    order = np.argsort(h, kind="stable")
    h, who, more = h[order], who[order], more[order]
    same = h[1:] == h[:-1]
    more[1:] |= same
    more[:-1] |= same
    h, who = h[more], who[more]
    order = np.argsort(who, kind="stable")
    h, who = h[order], who[order]
    cut = _cuts(who)
    rows = [(int(who[a]), 1, blob(np.array([at], np.int64), h[a:b])) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
    if rows:
        yield _out(rows)


def _shared(part: _Part, p: int) -> dict[int, np.ndarray]:
    out: dict[int, list] = {}
    for raw in part.other:
        at, h = unblob(raw, np.int64, np.uint64)
        out.setdefault(int(at[0]), []).append(h)
    return {k: np.unique(np.concatenate(v)) for k, v in out.items()}


def _entries(part: _Part, shared: dict[int, np.ndarray], p: int, window: int):
    """Per slice: ids, ties, data, offs, and for each trigger left its document, place, hash, dealt place, and entry bytes as rows."""
    reach = window - K
    keys = None
    if shared:
        dests = sorted(shared)
        keys = np.concatenate([shared[d] for d in dests])  # sorted within a place only
        edge = np.concatenate([[0], np.cumsum([len(shared[d]) for d in dests])])
        dests = np.array(dests)
    for ids, ties, data, offs in part.slices():
        at, h, begin, until = triggers(data, offs, window)
        if keys is None or not len(at):
            yield ids, ties, data, offs, None
            continue
        dest, low = _deal(h, p), h & _LOW48
        k = np.searchsorted(dests, dest)
        k = np.minimum(k, len(dests) - 1)
        known = dests[k] == dest
        # one search over all places: the place's rank above the 48 bits keeps the whole sorted
        rank = np.repeat(np.arange(len(dests)), np.diff(edge)).astype(np.uint64)
        whole, ask = (rank << U(48)) | keys, (k.astype(np.uint64) << U(48)) | low
        s = np.minimum(np.searchsorted(whole, ask), len(whole) - 1)
        on = known & (whole[s] == ask)
        at, h, dest, begin, until = at[on], h[on], dest[on], begin[on], until[on]
        doc = np.searchsorted(offs, at, "right") - 1
        first, last = reach - (at - begin), reach + until - at + window
        padded = np.concatenate([np.zeros(reach, np.uint8), data, np.zeros(window, np.uint8)])
        rows = np.lib.stride_tricks.sliding_window_view(padded, reach + window)[at]
        col = np.arange(reach + window, dtype=np.int16)
        rows[(col < first[:, None].astype(np.int16)) | (col >= last[:, None].astype(np.int16))] = 0
        yield ids, ties, data, offs, (doc, at, h, dest, rows, first, last)


def _entry_hash(h: np.ndarray, rows: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for seed in (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A63):
        weight = mix(np.arange(1, rows.shape[1] + 1, dtype=np.uint64) * U(seed))
        total = [(BYTE[rows[a : a + 4096]] * weight).sum(1, dtype=np.uint64) for a in range(0, len(rows), 4096)] or [np.zeros(0, np.uint64)]
        out.append(mix(np.concatenate(total) + h * U(3) + (first * 1000 + last).astype(np.uint64) * U(seed)))
    return out[0], out[1]


def _send_entries(p: int, window: int):
    def send(batches):
        part = _Part(batches)
        got: list[tuple] = []
        for ids, ties, _, offs, e in _entries(part, _shared(part, p), p, window):
            if e is None or not len(e[0]):
                continue
            doc, at, h, dest, rows, first, last = e
            x, y = _entry_hash(h, rows, first, last)
            got.append((x, y, h, dest, ids[doc], ties[doc], at - offs[doc], first, last, rows))
        if not got:
            return
        x, y, h, dest, ids, ties, place, first, last, rows = (np.concatenate(c) for c in zip(*got, strict=True))
        order = np.lexsort((place, ties, ids, y, x))
        new = np.concatenate([[True], (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])])
        order = order[new]
        order = order[np.argsort(dest[order], kind="stable")]
        z = _zstd().ZstdCompressor(level=1)
        cut, sent = _cuts(dest[order]), []
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            o = order[a:b]
            sent.append((int(dest[o[0]]), 1, blob(np.array([part.number], np.int64), x[o], y[o], ids[o], ties[o], place[o], first[o].astype(np.uint8), last[o].astype(np.uint8), h[o], np.frombuffer(z.compress(rows[o].tobytes()), np.uint8))))
        yield _out(sent)

    return send


def suffix_array(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of bytes in lexical order, as each row's rank, and how many bytes each rank has in common with the one before."""
    n, width = rows.shape
    wide = np.zeros((n, -(-width // 8) * 8), np.uint8)
    wide[:, :width] = rows
    order = np.lexsort(wide.view(">u8").astype(np.uint64).T[::-1])
    rank, common = np.empty(n, np.int64), np.zeros(n, np.int16)
    rank[order] = np.arange(n)
    for a in range(1, n, 4096):
        own = rows[order[a - 1 : a + 4096]]
        same = own[1:] == own[:-1]
        common[a : a + 4096] = np.where(same.all(1), width, same.argmin(1))
    return rank, common


def first_windows(rows: np.ndarray, first: np.ndarray, last: np.ndarray, doc: np.ndarray, place: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Of distinct entries: runs of windows as (entry, offset, number, document, place) of where the run's windows start first in the corpus.

    Consecutive windows of an entry are one run while their first starts move along. Memory is a few numbers for an entry.
    """
    reach, n = rows.shape[1] - window, len(rows)
    left, left_common = suffix_array(rows[:, :reach][:, ::-1])  # read from the trigger back: suffixes of phrases are prefixes
    right, right_common = suffix_array(rows[:, reach:])
    start = np.full(n, -1)  # of the run that an entry is in; what it had first, and its length
    source, size = np.zeros(n, np.int64), np.zeros(n, np.int64)
    out = []

    def close(own: np.ndarray) -> None:
        own = own[start[own] >= 0]
        out.append(np.stack([own, start[own], size[own], source[own] >> 40, source[own] & ((1 << 40) - 1)]))
        start[own] = -1

    for o in range(reach + 1):
        own = np.flatnonzero((first <= o) & (o + window <= last))
        close(np.flatnonzero((start >= 0) & ((first > o) | (o + window > last))))
        if not len(own):
            continue
        # windows are equal if as much of the phrase before the trigger is, and as much from it on
        cls = np.cumsum(left_common < reach - o)[left[own]] * (n + 1) + np.cumsum(right_common < window - (reach - o))[right[own]]
        key = doc[own] << 40 | (place[own] - reach + o)
        by = np.lexsort((key, cls))
        head = np.concatenate([[True], cls[by][1:] != cls[by][:-1]])
        least = np.empty(len(by), np.int64)
        least[by] = key[by][head][np.cumsum(head) - 1]
        on = (start[own] >= 0) & (source[own] + size[own] == least)
        close(own[~on])
        size[own[on]] += 1
        new = own[~on]
        start[new], source[new], size[new] = o, least[~on], 1
    close(np.arange(n))
    e, o, m, d, p = np.concatenate(out, axis=1)
    order = np.lexsort((o, e))
    return e[order], o[order], m[order], d[order], p[order]


def _first_starts(window: int):
    """At the hashes' place: for each entry, runs of its windows and where they start first."""
    width = window - K + window

    def answer(batches):
        z, got = _zstd().ZstdDecompressor(), []
        for batch in batches:
            for raw in batch.column("payload").to_pylist():
                part, *c, text = unblob(raw, np.int64, np.uint64, np.uint64, np.int64, np.int64, np.int64, np.uint8, np.uint8, np.uint64, np.uint8)
                got.append((np.full(len(c[0]), part[0]), *c, np.frombuffer(z.decompress(text.tobytes()), np.uint8).reshape(-1, width)))
        if not got:
            return
        got = [np.concatenate(c) for c in zip(*got, strict=True)]
        h = got.pop(-2)
        order = np.argsort(h, kind="stable")
        cut = _cuts(h[order])
        a = 0
        while a < len(order):
            b = int(cut[min(len(cut) - 1, max(np.searchsorted(cut, a, "right"), np.searchsorted(cut, a + SHARE, "right") - 1))])
            yield from answers(*(c[order[a:b]] for c in got))
            a = b

    def answers(part, x, y, ids, ties, place, first, last, rows):
        order = np.lexsort((place, ties, ids, y, x))
        new = np.concatenate([[True], (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])])
        entry = np.empty(len(x), np.int64)
        entry[order] = np.cumsum(new) - 1
        top = order[new]  # each entry's first place in the corpus
        docs = np.lexsort((ties[top], ids[top]))
        step = np.concatenate([[0], np.cumsum((ids[top][docs][1:] != ids[top][docs][:-1]) | (ties[top][docs][1:] != ties[top][docs][:-1]))])
        doc = np.empty(len(top), np.int64)
        doc[docs] = step
        run_of, from_, size, name, src = first_windows(rows[top], first[top], last[top], doc, place[top], window)
        name = docs[np.searchsorted(step, name)]
        src_id, src_tie = ids[top][name], ties[top][name]
        lo, hi = np.searchsorted(run_of, np.arange(len(top))), np.searchsorted(run_of, np.arange(len(top)), "right")
        turn = np.argsort(part, kind="stable")
        cut, sent = _cuts(part[turn]), []
        for s, t in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            own = turn[s:t]
            n = (hi - lo)[entry[own]]
            r = np.repeat(lo[entry[own]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            sent.append((int(part[own[0]]), 2, blob(x[own], y[own], n, from_[r].astype(np.uint8), size[r].astype(np.uint8), src_id[r], src_tie[r], src[r])))
        yield _out(sent)

    return answer


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _cut(p: int, window: int, with_kept: bool):
    reach = window - K

    def cut(batches):
        part = _Part(batches)
        answers, hashes = [], []
        for raw in part.other:
            (answers if raw[:4] == b"ANSW" else hashes).append(raw[4:])
        part.other = hashes
        x = y = n = None
        if answers:
            x, y, n, from_, size, src_id, src_tie, src = (np.concatenate(c) for c in zip(*[unblob(a, np.uint64, np.uint64, np.int64, np.uint8, np.uint8, np.int64, np.int64, np.int64) for a in answers], strict=True))
            at = np.cumsum(n) - n
            order = np.argsort(x, kind="stable")
            sorted_x = x[order]
        for ids, ties, data, offs, e in _entries(part, _shared(part, p), p, window):
            gone = np.zeros(len(data) + 1, np.int64)
            if e is not None and x is not None and len(e[0]):
                doc, place, h, _, rows, first, last = e
                ex, ey = _entry_hash(h, rows, first, last)
                s = np.minimum(np.searchsorted(sorted_x, ex), len(sorted_x) - 1)
                k = order[s]
                hit = (x[k] == ex) & (y[k] == ey)
                k, doc, place = k[hit], doc[hit], place[hit]
                m = n[k]
                r = np.repeat(at[k], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                doc, place = np.repeat(doc, m), np.repeat(place, m)
                begin = place - reach + from_[r].astype(np.int64)
                own = begin - offs[doc]
                before = (src_id[r] < ids[doc]) | (src_id[r] == ids[doc]) & ((src_tie[r] < ties[doc]) | (src_tie[r] == ties[doc]) & (src[r] < own))
                begin, end = begin[before], (begin + size[r].astype(np.int64) - 1 + window)[before]
                np.add.at(gone, begin, 1)
                np.add.at(gone, end, -1)
            kept = np.cumsum(gone[:-1]) == 0
            lost = ~kept
            turn = lost.copy()
            turn[1:] &= kept[:-1]
            inner = offs[:-1][offs[:-1] < len(data)]
            turn[inner] = lost[inner]
            spans, lost = (np.concatenate([[0], np.cumsum(v)]) for v in (turn, lost))
            left = [data[a:b][kept[a:b]].tobytes() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            null = ids == -(1 << 63)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64(), mask=null), pa.array(np.diff(offs), pa.int64()), pa.array(np.diff(lost[offs]), pa.int64()), pa.array(np.diff(spans[offs]), pa.int64()), pa.array([hashlib.sha256(v).hexdigest() for v in left], pa.string()), pa.array(left if with_kept else [None] * len(left), pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return cut


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_kept: bool = True) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the kept bytes."""
    spark = docs.sparkSession
    p, scratch = min(parts(spark), 65_535), Scratch(spark, "repeats")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))

    def packed() -> DataFrame:
        return own.mapInArrow(_pack(p), _ROW)

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartitionById(p, F.col("part"))

    hashes = dealt(dealt(packed()).mapInArrow(_send_hashes(p, window), _ROW)).mapInArrow(_return_hashes, _ROW)
    hashes = scratch.keep(hashes, "hashes")
    entries = dealt(dealt(packed().unionByName(hashes)).mapInArrow(_send_entries(p, window), _ROW))
    answers = scratch.keep(entries.mapInArrow(_first_starts(window), _ROW), "answers")
    told = hashes.withColumn("payload", F.concat(F.lit(b"HASH"), "payload")).unionByName(answers.withColumn("payload", F.concat(F.lit(b"ANSW"), "payload")))
    return dealt(packed().unionByName(told)).mapInArrow(_cut(p, window, with_kept), _RESULT)
