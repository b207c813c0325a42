"""The transformer block, its loss, and generation by joins, against loops over places."""

import math
import random
from hashlib import md5

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import generation, tensor


def _plain_block(x, real, layer, heads, kv_heads):
    unit = lambda v: v / np.sqrt((v @ v) / len(v) + 1e-5)

    def turned(v, pos):
        out = v.copy()
        for k in range(0, len(v), 2):
            a = pos * 10000.0 ** (-k / len(v))
            out[k], out[k + 1] = v[k] * math.cos(a) - v[k + 1] * math.sin(a), v[k] * math.sin(a) + v[k + 1] * math.cos(a)
        return out

    out = []
    for t in range(len(x)):
        q = np.split(layer["q"] @ unit(x[t]), heads)
        said = []
        for h in range(heads):
            see = [s for s in range(t + 1) if real[s]]
            keys = [turned(np.split(layer["k"] @ unit(x[s]), kv_heads)[h * kv_heads // heads], s) for s in see]
            values = [np.split(layer["v"] @ unit(x[s]), kv_heads)[h * kv_heads // heads] for s in see]
            scores = np.array([turned(q[h], t) @ k / math.sqrt(len(k)) for k in keys])
            e = np.exp(scores - scores.max()) if see else scores
            said.append(sum(w * v for w, v in zip(e / e.sum(), values)) if see else np.zeros(len(layer["v"]) // kv_heads))
        y = x[t] + layer["o"] @ np.concatenate(said)
        g = layer["w1"] @ unit(y)
        out.append(y + layer["w2"] @ (g / (1 + np.exp(-g)) * (layer["w3"] @ unit(y))))
    return np.array(out)


def _layer(rng, width, heads, kv_heads, size, inner):
    shapes = {"q": (heads * size, width), "k": (kv_heads * size, width), "v": (kv_heads * size, width), "o": (width, heads * size), "w1": (inner, width), "w3": (inner, width), "w2": (width, inner)}
    return {c: rng.normal(0, 0.3, s) for c, s in shapes.items()}


def test_block_against_loops(spark):
    rng = np.random.default_rng(2)
    for heads, kv_heads, chunk in [(4, 2, 3), (2, 2, None), (4, 1, 1)]:
        layer, n = _layer(rng, 6, heads, kv_heads, 4, 5), 9
        x = {seq: rng.normal(0, 1, (n - 4 * seq, 6)) for seq in range(3)}
        real = {seq: [k != 2 and not (seq == 1 and k < 2) for k in range(len(v))] for seq, v in x.items()}
        rows = [(seq, k, v[k].tolist(), real[seq][k]) for seq, v in x.items() for k in range(len(v))]
        df = spark.createDataFrame(rows, "seq int, pos int, x array<double>, real boolean").repartition(3)
        got = {(r.seq, r.pos): r.x for r in tensor.transformer_block(df, layer, heads, kv_heads, chunk).collect()}
        for seq, v in x.items():
            want = _plain_block(v, real[seq], layer, heads, kv_heads)
            assert np.allclose([got[seq, k] for k in range(len(v))], want, rtol=1e-9)
        start = {(r.seq, r.pos): r.x for r in tensor.transformer_block(df.where("pos < 4"), layer, heads, kv_heads, chunk).collect()}
        assert all(np.allclose(start[k], got[k]) for k in start)  # what a cache holds stays
    assert tensor.transformer_block(df.limit(0), layer, 4, 1).count() == 0


def test_loss_against_softmax(spark):
    rng = np.random.default_rng(3)
    head, x = rng.normal(0, 30, (7, 4)), rng.normal(0, 1, (5, 4))
    df = spark.createDataFrame([(0, k, x[k].tolist(), None if k == 4 else k) for k in range(5)], "seq int, pos int, x array<double>, target long")
    got = {r.pos: r.loss for r in tensor.next_token_loss(df, head).collect()}
    for k in range(4):
        z = head @ (x[k] / np.sqrt((x[k] @ x[k]) / 4 + 1e-5))
        assert math.isclose(got[k], math.log(sum(math.exp(v - z.max()) for v in z)) + z.max() - z[k], rel_tol=1e-9)
    assert len(got) == 4


def test_generation_against_loops(spark):
    rng = random.Random(5)
    texts = [[rng.randrange(6) for _ in range(rng.randint(0, 30))] for _ in range(8)] + [[0, 9], None]  # nothing follows 9
    counts = generation.bigram_counts(spark.createDataFrame([(t,) for t in texts], "ids array<int>"))
    seen = {}
    for t in texts:
        for a, b in zip(t or [], (t or [])[1:]):
            seen.setdefault(a, {}).setdefault(b, 0)
            seen[a][b] += 1
    assert {(r.prev, r.tok): r.n for r in counts.collect()} == {(a, b): n for a, x in seen.items() for b, n in x.items()}
    prompts = spark.createDataFrame([(k, k % 11) for k in range(40)], "seq long, last int")
    for k, temperature, seed in [(1, 1.0, "a"), (3, 0.7, "b"), (50, 1.5, "c")]:
        got = {r.seq: r.ids for r in generation.generate(prompts, generation.next_ids(counts, k, temperature), 12, 5, seed).collect()}
        for seq in range(40):
            last, want = seq % 11, []
            while len(want) < 12 and last in seen and (not want or last != 5):
                top = sorted(seen[last].items(), key=lambda x: (-x[1], x[0]))[:k]
                w = [n ** (1 / temperature) for _, n in top]
                u = int(md5(f"{seed}|{seq}|{len(want)}".encode()).hexdigest()[:8], 16) / 2**32 * sum(w)
                last = next(t for j, (t, _) in enumerate(top) if sum(w[: j + 1]) > u)
                want.append(last)
            assert got[seq] == want
    rows = generation.pieces(generation.generate(prompts, generation.next_ids(counts, 1, 1.0), 3, 5, "a"), 5, 3).collect()
    why = {r.seq: r.finish for r in rows if r.finish}
    assert set(why.values()) <= {"stop", "length", "end"} and all(r.finish is None or r.step == max(x.step for x in rows if x.seq == r.seq) for r in rows)
    assert generation.generate(prompts.limit(0), generation.next_ids(counts.where(F.lit(False)), 1, 1.0), 2, 5, "a").count() == 0
