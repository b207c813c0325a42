"""Running totals, the token stream, .npy shards, split reading and blocks over whole tables, against plain versions."""

import io
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import ordering, token_stream
from tessera.sources import files, npy


def test_one_key_for_all_rows_is_many_tasks(spark):
    df = spark.range(0, 5000, 1, 6).select(F.lit(7).alias("k"), "id", (F.col("id") % 3).alias("size"))
    got = ordering.running_totals(df, ["k"], {"before": F.col("size"), "rn": F.lit(1)}).orderBy("rn").collect()
    assert [r.rn for r in got] == list(range(5000))
    assert [r.before for r in got] == np.concatenate([[0], np.cumsum([r.size for r in got])[:-1]]).tolist()
    per_file = [r["count"] for r in ordering.running_totals(df, ["k"], {"rn": F.lit(1)}).groupBy(F.input_file_name()).count().collect()]
    assert len(per_file) >= 4 and max(per_file) < 3000  # each range is written by its task


def test_running_totals_by_several_keys(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, 1, 2, 2, 2]), rng.randrange(5), rng.choice([None, 3, 10**12]), k) for k in range(400)]
    df = spark.createDataFrame(rows, "a int, b int, n long, k int").repartition(5)
    got = ordering.running_totals(df, [F.col("a").desc(), "b", "k"], {"place": F.lit(1), "before": F.col("n")}).collect()
    want, so_far = {}, 0
    for place, (a, b, n, k) in enumerate(sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1], r[3]))):
        want[k] = (place, so_far)
        so_far += n or 0
    assert {r.k: (r.place, r.before) for r in got} == want
    assert ordering.running_totals(df.limit(0), ["a"], {"x": F.lit(1)}).count() == 0
    assert ordering.ranked(df, "k", "place", ("a",)).where("place <> k").count() == 0


@pytest.fixture(scope="module")
def tokens(spark):
    rng = random.Random(2)
    rows = [(k, None if k % 11 == 3 else [rng.randrange(1000) for _ in range(rng.choice([0, 1, 5, 40, 700]))]) for k in range(60)]
    rows += [(200, list(range(20_000))), (200, [5, 6])]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>").repartition(4)
    return df, [x for _, ids in rows for x in ids or []]


def test_stream_windows(spark, tokens):
    df, flat = tokens
    s = token_stream.stream(df.where("size(ids) <> 2 or doc_id <> 200").unionByName(df.where("size(ids) = 2 and doc_id = 200")), "doc_id")
    flat_now = [x for r in sorted(s.collect(), key=lambda r: r.start) for x in r.ids]
    assert sorted(flat_now) == sorted(flat) and token_stream.length(s) == len(flat)
    for context in (1, 7, 300, len(flat) - 1, len(flat) + 5):
        got = sorted(token_stream.context_windows(s, context).collect(), key=lambda r: r.window_no)
        assert [r.start for r in got] == list(range(0, len(flat) - 1, context))
        assert [x for r in got for x in r.inputs] == flat_now[:-1] and [x for r in got for x in r.targets] == flat_now[1:]
    batch = token_stream.get_batch(s, 50, 64, "seed").collect()
    assert len(batch) == 50 and len({r.start for r in batch}) > 25
    for r in batch:
        assert 0 <= r.start < len(flat) - 64 and r.inputs == flat_now[r.start : r.start + 64] and r.targets == flat_now[r.start + 1 : r.start + 65]
    assert sorted(token_stream.get_batch(s, 50, 64, "seed").collect()) == sorted(batch)
    with pytest.raises(ValueError):
        token_stream.get_batch(s, 1, len(flat), "seed")
    assert token_stream.context_windows(token_stream.stream(df.limit(0), "doc_id"), 8).count() == 0


@pytest.mark.parametrize("shard, piece, row", [(1 << 24, 1 << 22, 1 << 16), (1000, 512, 100), (7, 5, 3)])
def test_npy_shards(spark, tokens, tmp_path, shard, piece, row):
    df, _ = tokens
    npy.register(spark)
    at = str(tmp_path / "ids")
    some = df.where("doc_id < 12") if shard == 7 else df
    own = some.repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id", F.size("ids").desc())
    flat = [x for r in some.orderBy("doc_id", F.size("ids").desc()).collect() for x in r.ids or []]
    own.write.format("npy").mode("append").option("shardIds", shard).save(at)
    listed = json.loads((tmp_path / "ids" / npy.LIST).read_text())
    plain = [np.load(tmp_path / "ids" / s["name"]) for s in listed]  # any reader of .npy files
    assert np.concatenate(plain).tolist() == flat and all(a.dtype == np.uint16 and len(a) <= shard for a in plain)
    assert {p.name for p in (tmp_path / "ids").iterdir()} == {npy.LIST, *(s["name"] for s in listed)}
    read = spark.read.format("npy").option("sliceIds", piece).option("rowIds", row).load(at)
    rows = sorted(read.collect(), key=lambda r: r.start)
    assert [x for r in rows for x in r.ids] == flat and all(len(r.ids) <= row for r in rows)
    assert [r.start for r in rows] == np.concatenate([[0], np.cumsum([len(r.ids) for r in rows])[:-1]]).tolist()
    own.write.format("npy").mode("append").option("shardIds", shard).save(at)
    assert sum(len(r.ids) for r in spark.read.format("npy").load(at).collect()) == 2 * len(flat)
    own.write.format("npy").mode("overwrite").option("dtype", "uint32").save(at)
    assert sorted(x for r in spark.read.format("npy").load(at).collect() for x in r.ids) == sorted(flat)


def test_npy_commit_and_errors(spark, tmp_path):
    """A job that fails leaves nothing that a reader sees; attempts that are not committed add nothing; other writers' files are read."""
    npy.register(spark)
    at = str(tmp_path / "ids")
    good = spark.createDataFrame([([1, 2, 3],)], "ids array<int>")
    good.write.format("npy").mode("append").save(at)
    bad = spark.createDataFrame([([4],), ([70_000],)], "ids array<int>").repartition(2)
    with pytest.raises(Exception, match="does not fit"):
        bad.write.format("npy").mode("append").save(at)
    assert [r.ids for r in spark.read.format("npy").load(at).collect()] == [[1, 2, 3]]
    assert not [p for p in (tmp_path / "ids").iterdir() if p.name.startswith("_temporary")]
    import pyarrow as pa

    class Task:
        partitionId = staticmethod(lambda: 0)

    writer = npy.NpyWriter({"path": at}, False)
    batch = pa.RecordBatch.from_arrays([pa.array([[9]], pa.list_(pa.int32()))], names=["ids"])
    import pyspark

    pyspark.TaskContext.get, was = staticmethod(lambda: Task), pyspark.TaskContext.get
    try:
        first, second = writer.write(iter([batch])), writer.write(iter([batch]))  # two attempts of one task
    finally:
        pyspark.TaskContext.get = was
    assert first.shards[0]["name"] != second.shards[0]["name"]
    writer.commit([second])
    assert [x for r in spark.read.format("npy").load(at).collect() for x in r.ids] == [1, 2, 3, 9]
    (tmp_path / "plain").mkdir()
    for k, a in enumerate([np.arange(5, dtype=">i8"), np.zeros(0, np.uint8), np.array([60_000], np.uint16)]):
        np.save(tmp_path / "plain" / f"{k}.npy", a)
    got = spark.read.format("npy").load(f"file://{tmp_path}/plain").collect()
    assert [x for r in sorted(got, key=lambda r: r.start) for x in r.ids] == [0, 1, 2, 3, 4, 60_000]
    assert spark.read.format("npy").load(str(tmp_path / "plain" / "0.npy")).first().ids == [0, 1, 2, 3, 4]
    np.save(tmp_path / "plain" / "x.npy", np.zeros((2, 2)))
    with pytest.raises(Exception, match="no list of whole numbers"):
        spark.read.format("npy").load(str(tmp_path / "plain")).collect()


def test_one_file_is_many_partitions(spark, tmp_path):
    rng = random.Random(3)
    mark = "<|endoftext|>"
    docs = ["".join(rng.choice(["a", "é", "\n", "<|", "|>", "<|endoftext", "日本", " "]) for _ in range(rng.choice([0, 1, 30, 400]))) for _ in range(500)] + ["x" * 30_000, "", "last"]
    raw = mark.join(docs)
    docs = raw.split(mark)  # some are made by chance
    (tmp_path / "corpus.txt").write_bytes(raw.encode())
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        read = files.read_split_documents(spark, str(tmp_path / "corpus.txt"), mark)
        assert read.select("block").distinct().count() > 10
        got = ordering.running_totals(read, ["file", "block", "nth"], {"k": F.lit(1), "at": F.octet_length("text") + len(mark)}).orderBy("k").collect()
        assert [r.text for r in got] == docs
        size = [len(x.encode()) + len(mark) for x in docs]
        assert [r.at for r in got] == [sum(size[:k]) for k in range(len(docs))]
        cuts = [0, *np.flatnonzero([raw.encode().startswith(mark.encode(), k) for k in range(len(raw.encode()))]).tolist(), len(raw.encode()) + len(mark)]
        for n in (1, 3, 8, 5000):
            want = cuts
            # the last document has a mark behind it as well, as files of whole documents have
            full = [*cuts[:-1], len(raw.encode()), cuts[-1]]
            want = full if len(full) <= n + 1 else [full[i * max(1, (len(full) - 1) // n)] for i in range(n)] + [full[-1]]
            assert [r.at for r in files.chunk_starts(read, mark, n).orderBy("chunk").collect()] == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_blocks_go_across_documents_and_partitions(spark):
    rng = random.Random(5)
    lines = [rng.choice(["", "a", "b"]) if k < 300 else "c" for k in range(600)]
    df = spark.createDataFrame([(k // 40, k % 40, x) for k, x in enumerate(lines)], "doc_id long, line_no int, line string").repartition(7)
    got = {(r.doc_id, r.line_no): r.block for r in files.corpus_blocks(df, F.col("line") == "").collect()}
    block, want = 0, {}
    for k, x in enumerate(lines):
        if x == "":
            block += 1
        else:
            want[k // 40, k % 40] = block
    assert got == want
    assert files.corpus_blocks(df.limit(0), F.col("line") == "").count() == 0


def test_npy_header_of_other_versions(tmp_path):
    f = io.BytesIO()
    np.lib.format.write_array(f, np.arange(3, dtype=np.int32), version=(2, 0))
    (tmp_path / "a.npy").write_bytes(f.getvalue())
    kind, n, first = npy._header(*npy._store(str(tmp_path / "a.npy")))
    assert (kind, n) == (np.dtype(np.int32), 3) and f.getvalue()[first:] == np.arange(3, dtype=np.int32).tobytes()
