"""License scan: an Aho-Corasick automaton over words finds notices and identifier tags; a shunting-yard parser
evaluates the expression after each tag.

Words are runs of ASCII digits, ASCII letters (A-Z count as a-z) and bytes from 0x80 on. A phrase is found where its words
stand consecutively, whatever stands between them. Base phrases count at every place; of the method's own labels, a phrase
that lies within a longer one has none (`cc by` in `cc by nc`).

After `spdx license identifier` comes an expression up to the end of its line: identifiers, brackets, WITH (binds first), AND,
OR (last), in any case. Its longest valid start is taken; what is cut off inside brackets or after an operator doesn't count.
AND is as strict as its stricter side, OR as open as its more open side, WITH lifts one step; an unknown identifier is
restricted. The verdict and the families of the identifiers are labels.

score is 1 less the product of (1 - weight) over the distinct labels of notices and expressions.

Null text has no words, labels or places, and score 0. Repeated rows are judged each; null doc_ids stay; extra columns are
ignored; an empty table gives no rows. A text is scanned whole, with work linear in its length.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import small_batches
from .textops import LOWER, edges, flat, run_hashes, slices, small, word_table

_WORD = word_table(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)

#: Phrases that count as places, and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: The method's own notices, their labels and weights.
NOTICES = {
    "mit license": ("mit", 0.8),
    "mit licence": ("mit", 0.8),
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 0.9),
    "apache license": ("apache", 0.8),
    "apache licence": ("apache", 0.8),
    "apache license version 2 0": ("apache-2.0", 0.9),
    "general public license": ("gpl", 0.8),
    "general public licence": ("gpl", 0.8),
    "general public license version 2": ("gpl-2.0", 0.9),
    "general public license version 3": ("gpl-3.0", 0.9),
    "lesser general public license": ("lgpl", 0.8),
    "library general public license": ("lgpl", 0.8),
    "affero general public license": ("agpl", 0.8),
    "mozilla public license": ("mpl", 0.8),
    "eclipse public license": ("epl", 0.8),
    "european union public licence": ("eupl", 0.8),
    "bsd license": ("bsd", 0.8),
    "bsd licence": ("bsd", 0.8),
    "2 clause bsd": ("bsd", 0.7),
    "3 clause bsd": ("bsd", 0.7),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "isc license": ("isc", 0.8),
    "zlib license": ("zlib", 0.8),
    "boost software license": ("bsl", 0.8),
    "artistic license": ("artistic", 0.8),
    "unlicense": ("unlicense", 0.5),
    "cc0": ("cc0", 0.6),
    "cc by": ("cc-by", 0.7),
    "cc by sa": ("cc-by-sa", 0.8),
    "cc by nc": ("cc-by-nc", 0.8),
    "cc by nd": ("cc-by-nd", 0.8),
    "cc by nc sa": ("cc-by-nc-sa", 0.8),
    "cc by nc nd": ("cc-by-nc-nd", 0.8),
    "creative commons attribution": ("cc-by", 0.8),
    "creative commons attribution sharealike": ("cc-by-sa", 0.8),
    "creative commons attribution noncommercial": ("cc-by-nc", 0.8),
    "creative commons zero": ("cc0", 0.8),
    "public domain dedication": ("public-domain", 0.7),
    "released into the public domain": ("public-domain", 0.7),
    "all rights reserved": ("all-rights-reserved", 0.4),
}
#: Fixed value: the words of the identifier tag. Its expression has a weight of its own.
TAG, TAG_WEIGHT = "spdx license identifier", 0.95

LEVELS = ("restricted", "copyleft", "weak-copyleft", "permissive")
#: Starts of identifiers in lower case, longest first, with family and level.
FAMILIES = (
    ("unlicense", "unlicense", 3),
    ("artistic", "artistic", 2),
    ("cc-by-nc", "cc-by-nc", 0),
    ("cc-by-nd", "cc-by-nd", 0),
    ("cc-by-sa", "cc-by-sa", 1),
    ("apache", "apache", 3),
    ("cc-by", "cc-by", 3),
    ("agpl", "agpl", 1),
    ("lgpl", "lgpl", 2),
    ("eupl", "eupl", 1),
    ("zlib", "zlib", 3),
    ("0bsd", "bsd", 3),
    ("bsl", "bsl", 3),
    ("bsd", "bsd", 3),
    ("cc0", "cc0", 3),
    ("epl", "epl", 2),
    ("gpl", "gpl", 1),
    ("isc", "isc", 3),
    ("mit", "mit", 3),
    ("mpl", "mpl", 2),
)

_PART = re.compile(rb"[ \t]*([()]|[A-Za-z0-9][A-Za-z0-9.+\-]*)")
_BINDS = {b"OR": 1, b"AND": 2, b"WITH": 3}


def parsed(text: bytes, at: int) -> tuple[int, list[bytes]]:
    """Where the longest valid expression from `at` on ends, and it in postfix order; `at` and nothing if there is none.

    Shunting-yard, with a copy of nothing: when a start is valid, the operators still held are those of that start, so its
    end and how many of the output and of the operators it has are noted, and the rest is dropped at the end.
    """
    out: list[bytes] = []
    held: list[bytes] = []
    depth, operand, valid = 0, True, (at, 0, [])
    while m := _PART.match(text, at):
        token = m[1]
        word = token.upper()
        if operand:
            if token == b"(":
                held.append(token)
                depth += 1
            elif token == b")" or word in _BINDS:
                break
            else:
                out.append(token)
                operand = False
        elif token == b")" and depth:
            while held[-1] != b"(":
                out.append(held.pop())
            held.pop()
            depth -= 1
        elif word in _BINDS:
            while held and held[-1] != b"(" and _BINDS[held[-1]] >= _BINDS[word]:
                out.append(held.pop())
            held.append(word)
            operand = True
        else:
            break
        at = m.end()
        if not operand and not depth:
            valid = (at, len(out), held[:])  # at most one operator of each kind is held outside brackets
    end, n, held = valid
    return end, out[:n] + held[::-1]


def family(identifier: bytes) -> tuple[str, int]:
    name = identifier.decode().lower()
    return next(((f, level) for start, f, level in FAMILIES if name.startswith(start)), ("other", 0))


def evaluated(postfix: list[bytes]) -> tuple[int, list[str]]:
    """The level of an expression in postfix order, and its distinct identifiers."""
    stack: list[tuple[int, bytes]] = []
    names: list[str] = []
    for token in postfix:
        if token not in _BINDS:
            stack.append((family(token)[1], token))
            names.append(token.decode())
            continue
        (b, exception), (a, own) = stack.pop(), stack.pop()
        if token == b"WITH":
            names.remove(exception.decode())  # an exception is no license
            stack.append((min(3, a + 1) if a else 0, own))
        else:
            stack.append((min(a, b) if token == b"AND" else max(a, b), own))
    return stack[0][0], sorted(set(names))


class Automaton:
    """Aho-Corasick over word symbols: 0 for any word of no phrase."""

    def __init__(self, phrases: list[str]):
        self.phrases = phrases
        split = [p.encode().split() for p in phrases]
        self.size = np.array([len(p) for p in split])
        words = sorted({w for p in split for w in p})
        data, offs = np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        h = run_hashes(data, offs[:-1], offs[1:])
        order = np.argsort(h)
        self.hashes, self.bytes, self.first, self.length = h[order], data, offs[:-1][order], np.diff(offs)[order]
        symbol = {words[k]: s + 1 for s, k in enumerate(order.tolist())}
        step: list[dict[int, int]] = [{}]
        ends: list[list[int]] = [[]]
        for k, p in enumerate(split):
            s = 0
            for w in p:
                if symbol[w] not in step[s]:
                    step[s][symbol[w]] = len(step)
                    step.append({})
                    ends.append([])
                s = step[s][symbol[w]]
            ends[s].append(k)
        self.delta = np.zeros((len(step), len(words) + 1), np.int32)
        fail, queue = [0] * len(step), deque([0])
        while queue:  # a state's row is its fail state's row but for its own children
            s = queue.popleft()
            self.delta[s] = self.delta[fail[s]] if s else 0
            for c, t in step[s].items():
                fail[t] = int(self.delta[s, c]) if s else 0
                self.delta[s, c] = t
                ends[t] += ends[fail[t]]
                queue.append(t)
        self.n_ends = np.array([len(x) for x in ends])
        self.end_at = np.cumsum(self.n_ends) - self.n_ends
        self.ends = np.array([k for x in ends for k in x], np.int64)

    def symbols(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The symbol of each word (of lower-case data), compared byte by byte where its hash is known."""
        h = run_hashes(data, starts, ends)
        s = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        known = np.flatnonzero((self.hashes[s] == h) & (self.length[s] == ends - starts))
        n = self.length[s[known]]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        same = data[np.repeat(starts[known], n) + inner] == self.bytes[np.repeat(self.first[s[known]], n) + inner]
        good = known[np.logical_and.reduceat(same, np.cumsum(n) - n)] if len(known) else known
        out = np.zeros(len(h), np.int32)
        out[good] = s[good] + 1
        return out

    #: Runs are walked in pieces of so many words, all pieces side by side.
    PIECE = 256

    def find(self, symbols: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrase and first word of each occurrence within a document; at[d] is document d's first word."""
        a, z = edges((symbols > 0).view(np.uint8), at, np.array([False] + [True] * 255))
        if not len(a):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        n = (z - a + self.PIECE - 1) // self.PIECE
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        run, stop = np.repeat(a, n), np.repeat(z, n)
        own = run + k * self.PIECE
        begin, stop = np.maximum(run, own - int(self.size.max()) + 1), np.minimum(stop, own + self.PIECE)
        order = np.argsort(begin - stop, kind="stable")  # the longest first
        begin, own, stop = begin[order], own[order], stop[order]
        state, found = np.zeros(len(begin), np.int32), []
        length = stop - begin
        for j in range(int(length[0])):
            live = int(np.searchsorted(-length, -j))  # those longer than j
            place = begin[:live] + j
            state = self.delta[state[:live], symbols[place]]
            hit = np.flatnonzero((self.n_ends[state] > 0) & (place >= own[:live]))
            if len(hit):
                m = self.n_ends[state[hit]]
                which = self.ends[np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(self.end_at[state[hit]], m)]
                found.append((which, np.repeat(place[hit], m) - self.size[which] + 1))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        which, word = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((-self.size[which], word))
        return which[order], word[order]


REPORT = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, "
    "score double, findings array<struct<phrase:string,word:long>>, expressions array<struct<expression:string,identifiers:array<string>,verdict:string>>"
)
SLICE_BYTES = 4 << 20


def scan(docs: DataFrame, findings: bool = True) -> DataFrame:
    """Per row of docs(doc_id, text): the REPORT. `findings` lists every phrase found with its first word; without, that list is empty."""
    small_batches(docs.sparkSession)
    phrases = sorted({*BASE, *NOTICES, TAG})
    automaton = Automaton(phrases)
    base = np.array([p in BASE for p in phrases])
    label = [NOTICES.get(p, (None, 0.0)) for p in phrases]
    tag = phrases.index(TAG)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())), ("score", pa.float64()), ("findings", pa.list_(pa.struct([("phrase", pa.string()), ("word", pa.int64())]))), ("expressions", pa.list_(pa.struct([("expression", pa.string()), ("identifiers", pa.list_(pa.string())), ("verdict", pa.string())])))])

    def judged(ids: pa.Array, data: np.ndarray, offs: np.ndarray) -> pa.RecordBatch:
        lower = LOWER[data]
        starts, ends = edges(data, offs, _WORD)
        at = np.searchsorted(starts, offs)
        which, word = automaton.find(automaton.symbols(lower, starts, ends), at)
        doc, rows = np.searchsorted(at, word, "right") - 1, len(offs) - 1
        own = base[which]
        n_base = np.bincount(doc[own], minlength=rows)
        first, last = np.full(rows, np.iinfo(np.int64).max), np.full(rows, -1)
        np.minimum.at(first, doc[own], word[own] - at[doc[own]])
        np.maximum.at(last, doc[own], word[own] - at[doc[own]])
        stop = word + automaton.size[which]
        outer = np.ones(len(word), bool)  # not within one that starts earlier, or there and is longer
        if len(word):
            outer[1:] = stop[1:] > np.maximum.accumulate(stop)[:-1]
        based: list[set] = [set() for _ in range(rows)]
        weights: list[dict] = [{} for _ in range(rows)]
        listed: list[list] = [[] for _ in range(rows)]
        told: list[list] = [[] for _ in range(rows)]
        for d, p in np.unique(np.stack([doc[own], which[own]], 1), axis=0).tolist():
            based[d].add(BASE[phrases[p]])
        for d, p in np.unique(np.stack([doc[outer], which[outer]], 1), axis=0).tolist():
            if p != tag:
                weights[d][label[p][0]] = max(label[p][1], weights[d].get(label[p][0], 0))
        for d, w in zip(doc[which == tag].tolist(), (word[which == tag] + 2).tolist(), strict=True):
            a, text = int(ends[w]), data[offs[d] : offs[d + 1]]
            a -= int(offs[d])
            line = text[a:].tobytes() if len(text) - a < 4096 else _line(text, a)
            if line[:1] == b":":
                end, postfix = parsed(line, 1)
                if postfix:
                    level, names = evaluated(postfix)
                    told[d].append({"expression": line[1:end].decode().strip(), "identifiers": names, "verdict": LEVELS[level]})
                    for x in (*(family(n.encode())[0] for n in names), LEVELS[level]):
                        weights[d][x] = TAG_WEIGHT
        if findings:
            for d, p, w in zip(doc.tolist(), which.tolist(), (word - at[doc]).tolist(), strict=True):
                listed[d].append({"phrase": phrases[p], "word": w})
        score = [1.0 - float(np.prod([1.0 - w[x] for x in sorted(w)])) if w else 0.0 for w in weights]
        none = n_base == 0
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(np.diff(at)), pa.array(n_base.astype(np.int64)), pa.array(first, mask=none), pa.array(last, mask=none), pa.array([sorted(x) for x in based], schema.field("base_labels").type), pa.array([sorted({*x, *y}) for x, y in zip(based, weights, strict=True)], schema.field("labels").type), pa.array(score), pa.array(listed, schema.field("findings").type), pa.array(told, schema.field("expressions").type)],
            schema=schema,
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            data, offs = flat(batch.column("text"))
            for i, j in slices(offs, SLICE_BYTES):
                yield judged(batch.column("doc_id").slice(i, j - i), data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, REPORT)


def _line(text: np.ndarray, at: int) -> bytes:
    """From `at` to the end of the line, however far it is."""
    size = 4096
    while True:
        part = text[at : at + size].tobytes()
        end = part.find(b"\n")
        if end >= 0 or at + size >= len(text):
            return part[:end] if end >= 0 else part
        size *= 4
