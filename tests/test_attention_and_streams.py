"""Attention by mergeable partial results, decoding with state, and endless batches, against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import tensor
from tessera.plans.registry import QUERIES
from tessera.streaming import batches, decoder


@pytest.mark.parametrize("chunk, groups", [(None, 1), (1, 1), (7, 2), (16, 1)])
def test_attention_against_dense(spark, chunk, groups):
    """Long and short sequences, scores far beyond exp's range, padding, queries that see no key, places with gaps."""
    rng, rows, want = np.random.default_rng(3), [], {}
    for seq, n in enumerate([1, 5, 40]):
        places = np.sort(rng.choice(60, n, replace=False))
        real = rng.random(n) < 0.7
        k, v = rng.normal(0, 1, (2 // groups, n, 4)), rng.normal(0, 1, (2 // groups, n, 3))
        for head in range(2):
            q = rng.normal(0, 400 if seq == 2 else 1, (n, 4))
            own = head // groups
            for a in range(n):
                has = head < 2 // groups
                rows.append((seq, head, int(places[a]), q[a].tolist(), k[head][a].tolist() if has else None, v[head][a].tolist() if has else None, bool(real[a])))
                see = [b for b in range(a + 1) if real[b]]
                if see:
                    s = k[own][see] @ q[a] / 2
                    e = np.exp(s - s.max())
                    want[seq, head, int(places[a])] = e @ v[own][see] / e.sum()
    df = spark.createDataFrame(rows, "seq int, head int, pos int, q array<double>, k array<double>, v array<double>, real boolean")
    got = {(r.seq, r["head"], r.pos): r.out for r in tensor.attention(df, chunk, groups).collect()}
    assert got.keys() == want.keys()
    assert all(np.allclose(got[x], want[x], rtol=1e-9) for x in want)
    assert tensor.attention(df.limit(0), chunk).count() == 0


def test_partial_results_merge_in_any_order():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    scores, values = rng.normal(0, 300, 12), rng.normal(0, 1, (12, 2))
    parts = []
    for k in range(0, 12, 4):
        top = scores[k : k + 4].max()
        w = np.exp(scores[k : k + 4] - top)
        parts.append(pa.RecordBatch.from_pylist([{"pos": [3], "top": [top], "total": [w.sum()], "sum": [(w @ values[k : k + 4]).tolist()]}]))
    w = np.exp(scores - scores.max())
    for order in ([0, 1, 2], [2, 0, 1], [1, 2, 0]):
        out = next(tensor._merge((pa.scalar(1), pa.scalar(0), pa.scalar(0)), iter([parts[k] for k in order])))
        assert np.allclose(out.column("out")[0].as_py(), w @ values / w.sum())


def test_decoding_goes_on_from_a_checkpoint(spark, tmp_path):
    """Characters of up to four bytes, cut between micro-batches and between two runs; bytes that never become one."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = random.Random(7)
    texts = {k: "".join(rng.choice("aé日𝄞") for _ in range(rng.randint(1, 20))).encode() for k in range(12)}
    texts[50] = b"ab\xe6\x97"
    rows = [(k, p, raw[p : p + 1], p == len(raw) - 1, p % 4 if k == 1 else p * 4 // len(raw)) for k, raw in texts.items() for p in range(len(raw))]
    rows = [(k, p, t, last, part if k != 1 else p * 4 // len(texts[1])) for k, p, t, last, part in rows]
    df = spark.createDataFrame(rows, "stream long, pos long, tok binary, last boolean, part int")
    for run in range(2):
        for part in (2 * run, 2 * run + 1):
            df.where(f"part = {part}").drop("part").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(df.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        got = decoder.run_available(source, decoder.decode_stream, str(tmp_path / "out"), str(tmp_path / "state"))
        n = len(list((tmp_path / "state" / "commits").glob("[0-9]*")))
        assert n >= 2 * (run + 1)  # a micro-batch for each part
    pieces = got.collect()
    assert len(pieces) == len(rows)
    for k, raw in texts.items():
        assert "".join(r.piece for r in sorted((r for r in pieces if r.stream == k), key=lambda r: r.pos)) == raw.decode("utf-8", "replace")


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 1000, 4097])
def test_places_are_a_permutation(n):
    orders = [batches.shuffled_places(np.arange(n), n, f"s-{e}").tolist() for e in range(3)]
    assert all(sorted(o) == list(range(n)) for o in orders)
    assert n < 100 or len({tuple(o) for o in orders}) == 3 and sum(a == b for a, b in zip(*orders[:2])) < n / 4
    some = np.array([n - 1, 0, n // 2])
    assert batches.shuffled_places(some, n, "s-1").tolist() == [orders[1][k] for k in some]


def test_endless_batches_go_on_from_a_checkpoint(spark, tmp_path):
    def run(name, per_trigger):
        at = str(tmp_path / name)
        return decoder.run_available(batches.endless(spark, 103, 10, "seed", per_trigger), lambda s: s, f"{at}/out", f"{at}/state")

    once = {(r.epoch, r.batch, r.slot): r.place for r in run("once", 36).collect()}
    for _ in range(3):
        parts = run("thrice", 12)
    rows = parts.collect()
    assert len(rows) == 360 and {(r.epoch, r.batch, r.slot): r.place for r in rows} == once
    for epoch in range(3):
        own = [once[epoch, b, s] for b in range(10) for s in range(10)]
        assert own == batches.shuffled_places(np.arange(100), 103, f"seed-{epoch}").tolist() and len(set(own)) == 100
    reader = batches.EndlessReader({"rows": "103", "batchsize": "10", "seed": "seed", "batchespertask": "7"})
    found = [x for p in reader.partitions({"epoch": 0, "batch": 5}, {"epoch": 2, "batch": 1}) for b in reader.read(p) for x in b.to_pylist()]
    assert {(x["epoch"], x["batch"], x["slot"]): x["place"] for x in found} == {k: v for k, v in once.items() if (0, 5) <= k[:2] < (2, 1)}
    with pytest.raises(ValueError):
        batches.EndlessReader({"rows": "9", "batchsize": "10"})


@pytest.mark.parametrize("name", ["streaming_decode", "streaming_decode_stateful"])
def test_turns_of_long_conversations_are_streams_of_their_own(spark, tmp_path, name):
    """The hundredth turn of one conversation and the first of the next have the same id in the results, but are two rows."""
    rows = [(0, 100, "aé日"), (1, 0, "𝄞b"), (1, 1, ""), (1, 2, None), (2, 350, "xyz" * 50), (5, 50, "é")]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted(tuple(r) for r in QUERIES[name](spark, str(tmp_path)).select("stream", "text").collect())
    assert got == sorted((c * 100 + t, x) for c, t, x in rows if x)
