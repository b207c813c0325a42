"""Steps whose work for one task, batch or word has a bound."""

import random

import numpy as np
import pyarrow as pa

from tessera.functions import text as texts
from tessera.operators import merging, token_stream
from tessera.plans.base import spread
from tessera.sources import files, npy


def test_partitions_follow_the_rows(spark):
    df = spark.range(10_000).coalesce(1)
    assert max(df.sparkSession.createDataFrame([(len(p),) for p in spread(df, 500).rdd.glom().collect()], "n long").toPandas()["n"]) <= 600


def test_bytes_of_texts_in_slices():
    given = ["", None, "aé日", "x\0", None, "😀"]
    for a in range(len(given)):
        assert texts._bytes_of(pa.array(given).slice(a)).to_pylist() == [None if t is None else list(t.encode()) for t in given[a:]]


def test_sums_of_lists_by_place():
    lists = pa.array([[5], [], [1, 2, 3], None, [7, 0]], pa.list_(pa.int32()))
    plain, placed = token_stream.list_sums(lists, np.array([10, 0, 2, 4, 0]))
    assert plain.tolist() == [5, 0, 6, 0, 7] and placed.tolist() == [55, 0, 3 + 8 + 15, 0, 7]


def test_short_words_merge_as_long_ones(monkeypatch):
    """Any merges in any order, such as make a pair of lower rank than their own."""
    rng = random.Random(4)
    for _ in range(300):
        tokens = ["a", "b", "c"]
        ranks = {}
        for r in rng.sample(range(99), 6):
            a, b = rng.choice(tokens), rng.choice(tokens)
            tokens.append(a + b)
            ranks.setdefault((a, b), r)
        word = [rng.choice("abc") for _ in range(rng.randint(0, 20))]
        monkeypatch.setattr(merging, "SHORT_WORD", 0)
        want = merging.encode(word, ranks)
        monkeypatch.setattr(merging, "SHORT_WORD", 32)
        assert merging.encode(word, ranks) == want


def test_payloads_go_in_small_batches():
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array([[1] * n for n in (3, 900_000, 0, 2, 600_000, 1)], pa.list_(pa.int64()))], names=["k", "ids"])
    parts = list(files._parts(batch, "ids"))
    assert [k for p in parts for k in p.column("k").to_pylist()] == list(range(6)) and len(parts) == 3


def test_small_shards_are_not_a_task_each(spark, tmp_path):
    npy.register(spark)
    at = str(tmp_path / "ids")
    spark.range(1).selectExpr("sequence(0, 999) AS ids").write.format("npy").mode("append").option("shardIds", 10).save(at)
    for most, tasks in ((1 << 22, 1), (100, 10), (1, 233)):
        read = spark.read.format("npy").option("sliceIds", 6).option("rowIds", 4).option("taskIds", most).load(at)
        assert read.rdd.getNumPartitions() == tasks
        rows = sorted(read.collect(), key=lambda r: r.start)
        assert [x for r in rows for x in r.ids] == list(range(1000)) and all(r.ids[0] == r.start and len(r.ids) <= 4 for r in rows)
