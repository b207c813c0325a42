"""Licence scan, source divergence and resampling against plain versions and their SQL."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import divergence, licenses, resampling
from tessera.llm.queries import ORACLES, QUERIES
from tests.llm.brute import lower

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

NOTICES = [
    "Released under the MIT License.",
    "mit\n-- LICENSE, mit license mit license",
    "Licensed under the Apache License, Version 2.0",
    "the GNU Lesser General Public License",
    "GNU General Public License, version 3.",
    "CC BY-NC 4.0 and CC-BY",
    "/* SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND BSD-3-Clause */",
    "SPDX-License-Identifier: GPL-2.0 WITH Classpath-exception-2.0\nMIT",
    "SPDX-License-Identifier: MIT AND (",
    "SPDX-License-Identifier MIT",
    "SPDX-License-Identifier: ((((",
    "émit license; smit license; MIT Licenses; apachelicense",
    "mit " * 3000 + "license",
    "general public " * 400 + "license version 2",
]


def _phrases(words):
    out = []
    for p in {*licenses.BASE, *licenses.NOTICES, licenses.TAG}:
        q = p.encode().split()
        out += [(k, len(q), p) for k in range(len(words) - len(q) + 1) if words[k : k + len(q)] == q]
    return out


def _scan(text):
    """words, base places, base labels, labels of notices."""
    words = WORD.findall(lower(text).encode())
    found = _phrases(words)
    base = [(k, licenses.BASE[p]) for k, _, p in found if p in licenses.BASE]
    outer = [x for x in found if not any(y[0] <= x[0] and y[0] + y[1] >= x[0] + x[1] and y != x for y in found)]
    return words, base, {licenses.NOTICES[p] for _, _, p in outer if p != licenses.TAG}


def test_license_scan(spark, texts, docs, empty):
    rows = texts + [(1000 + k, t) for k, t in enumerate([*NOTICES, " x ".join(NOTICES), NOTICES[0], "\n".join(NOTICES * 40)])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("labels", F.lit("clash")).withColumn("score", F.lit(3))
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        words, base, own = _scan(t)
        r, place = got[i], sorted(k for k, _ in base)
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(base), *((place[0], place[-1]) if place else (None, None)))
        assert r.base_labels == sorted({x for _, x in base}) and {*r.base_labels, *(x for x, _ in own)} <= {*r.labels} and r.labels == sorted({*r.labels})
        assert sorted((f.word, f.phrase) for f in r.findings) == sorted((k, p) for k, _, p in _phrases(words))
        weights = {}
        for x, w in own:
            weights[x] = max(w, weights.get(x, 0))
        for e in r.expressions:
            weights |= dict.fromkeys([licenses.family(x.encode())[0] for x in e.identifiers] + [e.verdict], licenses.TAG_WEIGHT)
        assert r.score == pytest.approx(1 - math.prod(1 - w for w in weights.values())) and 0 <= r.score <= 1
        assert {*r.labels} == {*r.base_labels, *weights}
    assert licenses.scan(empty).count() == 0
    assert licenses.scan(docs.union(docs)).count() == 2 * docs.count()
    assert [r.score for r in licenses.scan(spark.createDataFrame([(None, None)], "doc_id long, text string")).collect()] == [0.0]


def test_license_expressions():
    def told(text):
        end, postfix = licenses.parsed(text, 0)
        return (text[:end].decode(), *licenses.evaluated(postfix)) if postfix else None

    assert told(b" MIT OR (Apache-2.0 AND GPL-2.0 WITH X-exception)\nfoo") == (" MIT OR (Apache-2.0 AND GPL-2.0 WITH X-exception)", 3, ["Apache-2.0", "GPL-2.0", "MIT"])
    assert told(b"GPL-2.0 with X and mit OR CC-BY-NC-4.0 tail") == ("GPL-2.0 with X and mit OR CC-BY-NC-4.0", 2, ["CC-BY-NC-4.0", "GPL-2.0", "mit"])
    assert told(b"MIT AND (ISC OR") == ("MIT", 3, ["MIT"])
    assert told(b"(MIT)) OR ISC")[0] == "(MIT)"
    assert told(b"(MIT") is None and told(b"OR MIT") is None and told(b"") is None
    rng = random.Random(4)
    level = {"MIT": 3, "MPL-2.0": 2, "GPL-3.0": 1, "Odd": 0}

    def made(depth):
        if not depth or rng.random() < 0.3:
            x = rng.choice(list(level))
            return x, level[x], 3
        op = rng.choice(["AND", "OR"])
        (a, x, p), (b, y, q) = made(depth - 1), made(depth - 1)
        rank = {"OR": 1, "AND": 2}[op]
        a, b = (f"({a})" if p < rank else a), (f"({b})" if q <= rank else b)
        return f"{a} {op} {b}", (min if op == "AND" else max)(x, y), rank

    for _ in range(300):
        text, want, _ = made(5)
        assert told(text.encode())[:2] == (text, want)


def _audit(rows, least=10):
    terms = [(a or "", b or "", re.findall(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t).encode())) for a, b, t in rows]
    df, n = defaultdict(Counter), defaultdict(Counter)
    for a, b, w in terms:
        df[a].update(set(w))
        n[a, b].update(w)
    out = set()
    for lang in {a for a, _, _ in terms}:
        kept = sorted(t for t, c in df[lang].items() if c >= least)
        groups = {b: [n[lang, b][t] for t in kept] for a, b in n if a == lang}
        every = [sum(x) for x in zip(*groups.values())] if kept else []
        p = lambda c: [1 + 10**9 * (x + 2) // (sum(c) + 2 * len(kept)) for x in c]
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for b, c in groups.items():
            pairs = sorted((-sum(map(f, p(c), p(o))), k.encode()) for k, o in groups.items() if k != b)
            out |= {(lang, b, "pair", k.decode(), -v, r) for r, (v, k) in enumerate(pairs, 1)}
            own = sorted((-f(x, q), t) for x, q, t, m in zip(p(c), p(every), kept, c) if m and x > q)
            out |= {(lang, b, "term", t.decode(), -v, r) for r, (v, t) in enumerate(own[:10], 1)}
    return out


@pytest.mark.parametrize("dense, block", [(1 << 17, 256), (40, 3)])
def test_divergence(spark, monkeypatch, dense, block):
    monkeypatch.setattr(divergence, "DENSE", dense)
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "PIECE", 50)
    monkeypatch.setattr(divergence, "HELD", 30)
    rng = random.Random(8)
    vocabulary = ["the", "ÉÑ", "日本", "zz", "a", "A", "É", "é", "ß"] + [f"w{chr(97 + k)}" for k in range(12)]
    rows = [(rng.choice(["en", "en", "de", None]), rng.choice(["s0", "s0", "s1", "é", None, "s2", "S", "x1", "x2"]), "1,".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 30)))) for _ in range(150)]
    rows += [("fr", "one", "rare words"), ("fr", "two", None), ("it", "alone", "x " * 50), ("en", "no terms", "12 3"), ("en", "s0", "the " * 4000)] + [("de", "s1", "copies of copies")] * 12
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, source string, text string, item string, n int")
    got = [tuple(r) for r in divergence.audit(df).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == _audit(rows)
    assert divergence.audit(df.limit(0)).count() == 0


def test_scaled_is_exact():
    rng = random.Random(2)
    for _ in range(2000):
        d, v = rng.randrange(1, 10**15), rng.randrange(1, 10**6)
        c = rng.randrange(d)
        assert int(divergence.scaled(np.array([c]), d, v)[0]) == 1 + 10**9 * (c + 2) // (d + 2 * v)


def _features(text):
    w = WORD.findall(lower(text).encode())
    return len(w), [zlib.crc32(b" ".join(w[i : i + m])) % 10_000 for m in (1, 2, 3) for i in range(len(w) - m + 1)]


def _resampled(rows, target, percent=5, least=20):
    own = [(i, *_features(t)) for i, t in rows]
    s, t = Counter(b for _, _, x in own for b in x), Counter(b for x in target for b in _features(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (s_all + 10000.0) / ((s[b] + 1.0) * (t_all + 10000.0))))
    out = []
    for i, n, x in own:
        h = int(sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, x))
        out.append([i, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least])
    eligible = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    draw = len(eligible) * percent // 100
    return out, [(r[0], r[3], k + 1) for k, r in enumerate(eligible[:draw])]


@pytest.mark.parametrize("percent, run, sampled, ranges", [(5, 1 << 18, 1 << 9, 1 << 15), (40, 9, 2, 6), (100, 7, 1, 1), (0, 50, 4, 8)])
def test_resampling(spark, texts, empty, monkeypatch, percent, run, sampled, ranges):
    monkeypatch.setattr(resampling, "RUN_ROWS", run)
    monkeypatch.setattr(resampling, "SAMPLED", sampled)
    monkeypatch.setattr(resampling, "RANGE_ROWS", ranges)
    monkeypatch.setattr(resampling, "SLICE_BYTES", 3000)
    rng = random.Random(9)
    words = ["One", "two", "é日", "x" * 70, "y" * 49, "z" * 48, "7"] + [f"w{k}" for k in range(60)]
    rows = texts + [(100 + k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for k in range(150)]
    rows += [(7, "one row again and again " * 6)] * 90 + [(None, "no id " * 12)] * 3
    target = [None, "", "two 7 w1 w2", "w1 w2 w3 one row"]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, score int, key string").repartition(5)
    bench = spark.createDataFrame([(str(k), t) for k, t in enumerate(target)], "item_id string, text string")
    got = resampling.resample(df, bench, percent).collect()
    want, top = _resampled(rows, target, percent)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r)[:4] for r in got), key=key) == sorted((tuple(r[:4]) for r in want), key=key)
    assert [(r.doc_id, r.score, r["rank"]) for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == top
    if percent == 5:
        assert resampling.resample(empty, bench).count() == 0
        none = resampling.resample(df, bench.limit(0)).collect()
        assert sorted((tuple(r)[:4] for r in none), key=key) == sorted((tuple(r[:4]) for r in _resampled(rows, [])[0]), key=key)


def test_tournament():
    rng = random.Random(3)
    for _ in range(200):
        runs = [sorted(bytes([rng.randrange(5), rng.randrange(5)]) for _ in range(rng.randrange(7))) for _ in range(rng.randrange(9))]
        assert [runs[a][k] for a, k in resampling.Tournament(runs)] == sorted(x for r in runs for x in r)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    at, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    df, rel = QUERIES[name](spark, at), con.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert sorted((tuple(r) for r in df.select(*rel.columns).collect()), key=repr) == sorted(rel.fetchall(), key=repr)
