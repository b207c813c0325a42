"""Exact ids of a tokenizers file at the speed of a lookup: texts are cut where every pre-tokenizer
split is certain, each distinct piece is encoded once by the library, and ids are gathered."""

from __future__ import annotations

import os
import sys
import types

import numpy as np
import pandas as pd

from .textops import edges, run_hashes, slices, word_table

#: A piece cache starts anew beyond so many pieces; it lives in the worker process, across tasks.
CACHE_PIECES = 600_000
SLICE_BYTES = 4 << 20
_NOT_SPACE = word_table(lambda b: b not in (9, 10, 13, 32))
_INK = word_table(lambda b: 0x21 <= b <= 0x7E)


_MARK = word_table(lambda b: b in b".,;:!?%&$#*()")
_LETTER = word_table(lambda b: 97 <= b <= 122 or 65 <= b <= 90)


def _letter_edges(data: np.ndarray) -> np.ndarray:
    """Whether a cut between bytes i - 1 and i is certain: a letter (ASCII, or Latin-1 led by C3) beside a mark other than an apostrophe."""
    n = len(data)
    cut = np.zeros(n, bool)
    if n > 1:
        latin = np.zeros(n, bool)  # its last byte; C3 97 and C3 B7 are signs, not letters
        latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        mark, letter = _MARK[data], _LETTER[data]
        cut[1:] = (letter | latin)[:-1] & mark[1:] | mark[:-1] & letter[1:]
    return cut


def space_runs(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces for a tokenizer that drops white space: runs without blank, tab, line feed or return, cut where letters meet marks."""
    starts, ends = edges(data, offs, _NOT_SPACE)
    cut = np.zeros(len(data) + 1, bool)
    cut[:-1] = _letter_edges(data)  # both sides are ink, so such a cut lies within a run or on a document's edge
    cut[starts] = False
    cut[ends] = False
    first, last = cut.copy(), cut
    first[starts] = True
    last[ends] = True
    return np.flatnonzero(first), np.flatnonzero(last)


def blank_led(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces for byte-level pre-tokenizing, where one blank leads the next word: they cover all bytes.

    A cut before a blank is certain if the character on either side is surely not white space
    (printable ASCII, or Latin-1 letters, led by byte C3); a line feed before such a character
    stands alone. Elsewhere pieces just get longer.
    """
    n = len(data)
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    if n > 1:
        ink = _INK[data]
        inked_before = np.zeros(n, bool)
        inked_before[1:] = ink[:-1]
        inked_before[2:] |= (data[:-2] == 0xC3) & (data[1:-1] >= 0x80)
        inked_after = np.zeros(n, bool)
        inked_after[:-1] = ink[1:] | (data[1:] == 0xC3)
        at = offs[:-1]
        inked_before[at[at < n]] = False
        at = offs[1:] - 1
        inked_after[at[at >= 0]] = False
        feed = data == 10
        cut[:-1] |= ((data == 32) | feed) & (inked_before | inked_after)
        cut[1:] |= feed & inked_after
        cut[:-1] |= _letter_edges(data)
    at = np.flatnonzero(cut)
    return at[:-1], at[1:]


class PieceEncoder:
    """encode(data, offs) gives all ids and each document's number of ids."""

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.pieces = Tokenizer.from_file(path), {"spaces": space_runs, "blanks": blank_led}[kind]
        self.join = {"spaces": " | ", "blanks": "\n"}[kind]  # becomes one id that no piece without it has
        sign = self.tokenizer.encode(f"a{self.join}b", add_special_tokens=False).ids
        self.sign = sign[1] if len(sign) == 3 else None
        self.clear()

    def clear(self) -> None:
        self.known, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.at, self.size, self.ids, self.used, self.count = np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.zeros(1 << 16, np.int32), 0, 0

    @classmethod
    def shared(cls, path: str, kind: str) -> PieceEncoder:
        """The worker process's own encoder for the file."""
        home = sys.modules.setdefault("_tessera_worker", types.ModuleType("_tessera_worker"))
        at = home.__dict__.setdefault("encoders", {})
        if (path, kind) not in at:
            at[path, kind] = cls(path, kind)
        return at[path, kind]

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        mark = self.join.strip(" ")
        plain = [k for k, x in enumerate(texts) if mark not in x and len(x.split()) == 1 and x[-1:].isprintable() and not x[-1:].isspace()] if self.sign is not None else []
        odd = np.ones(len(texts), bool)
        odd[plain] = False
        odd = np.flatnonzero(odd)
        got = [self.tokenizer.encode(texts[k], add_special_tokens=False).ids for k in odd.tolist()]
        order = [odd]
        sizes = [np.fromiter(map(len, got), np.int32, len(got))]
        ids = [np.fromiter((i for x in got for i in x), np.int32, int(sizes[0].sum()))]
        for a in range(0, len(plain), 4096):  # an encoding's own cost would outweigh a piece's
            some = plain[a : a + 4096]
            x = np.asarray(self.tokenizer.encode_batch_fast([self.join.join(texts[k] for k in some)], add_special_tokens=False)[0].ids, np.int32)
            sign = x == self.sign
            size = np.diff(np.concatenate([[-1], np.flatnonzero(sign), [len(x)]])) - 1
            if len(size) != len(some):
                raise AssertionError("pieces don't stay apart")
            order.append(np.array(some, np.int64))
            sizes.append(size.astype(np.int32))
            ids.append(x[~sign])
        order, sizes, ids = np.concatenate(order), np.concatenate(sizes), np.concatenate(ids)
        hashes, got = hashes[order], order
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.count + len(got) > len(self.at):
            self.at, self.size = np.concatenate([self.at, np.zeros_like(self.at)]), np.concatenate([self.size, np.zeros_like(self.size)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.at[self.count : self.count + len(got)] = self.used + np.cumsum(sizes) - sizes
        self.size[self.count : self.count + len(got)] = sizes
        order = np.argsort(hashes)
        where = np.searchsorted(self.known, hashes[order])
        self.known = np.insert(self.known, where, hashes[order])
        self.slot = np.insert(self.slot, where, self.count + order)
        self.used, self.count = self.used + len(ids), self.count + len(got)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends = self.pieces(data, offs)
        if len(starts) == 0:
            return np.zeros(0, np.int32), np.zeros(len(offs) - 1, np.int64)
        code, kinds = pd.factorize(run_hashes(data, starts, ends))
        if self.count + len(kinds) > CACHE_PIECES:
            self.clear()
        where = np.minimum(np.searchsorted(self.known, kinds), max(0, len(self.known) - 1))
        new = np.flatnonzero(self.known[where] != kinds) if len(self.known) else np.arange(len(kinds))
        if len(new):
            first = np.full(len(kinds), -1, np.int64)
            first[code[::-1]] = np.arange(len(code))[::-1]
            raw = data.tobytes()
            self._learn(kinds[new], [raw[a:b].decode("utf-8") for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            where = np.searchsorted(self.known, kinds)
        slot = self.slot[where][code]
        size = self.size[slot].astype(np.int64)
        done = np.cumsum(size)
        ids = self.ids[np.repeat(self.at[slot] - (done - size), size) + np.arange(done[-1])]
        upto = np.concatenate([[0], done])[np.searchsorted(starts, offs)]
        return ids, np.diff(upto)


def encoded(path: str, kind: str, data: np.ndarray, offs: np.ndarray, end: int):
    """For slices of bounded size: first document, ids with `end` after each document, and n + 1 offsets into them."""
    encoder = PieceEncoder.shared(path, kind)
    for i, j in slices(offs, SLICE_BYTES):
        ids, sizes = encoder.encode(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        at = np.concatenate([[0], np.cumsum(sizes)])
        out = np.full(len(ids) + j - i, end, np.int32)
        keep = np.ones(len(out), bool)
        keep[at[1:] + np.arange(j - i)] = False
        out[keep] = ids
        yield i, out, at + np.arange(j - i + 1)
