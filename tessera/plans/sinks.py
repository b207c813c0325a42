"""Every sink, written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions.text import byte_ids
from tessera.operators import chat, ordering, token_stream
from tessera.plans.base import query, table
from tessera.plans.chat import PACKED, _PAD, _SFT, _examples
from tessera.sources import files, npy
from tessera.sources.scratch import shared_dir, small_batches


def _place(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS ids FROM documents")
def npy_sink(spark, d):
    """Byte ids of whole documents as .npy payloads."""
    at = _place(spark, "npy")
    files.write_npy(table(spark, d, "documents").select("doc_id", byte_ids("text").alias("ids")), at)
    return files.parse_npy(spark.read.parquet(at)).select("doc_id", "ids")


_SHARD_IDS = "SELECT row_number() OVER (ORDER BY doc_id, i) - 1 AS pos, id FROM (SELECT doc_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS i FROM (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::INT) AS ids FROM documents))"


@query(f"SELECT pos // 4096 AS slice, count(*)::BIGINT AS n_ids, sum(id)::BIGINT AS id_sum, sum((pos + 1) * id)::BIGINT AS placed FROM ({_SHARD_IDS}) GROUP BY 1")
def npy_shards(spark, d):
    """The stream of all documents' byte ids in .npy files of 100,000 ids at most, read back by byte ranges."""
    npy.register(spark)
    small_batches(spark)
    at = _place(spark, "npy-shards")
    texts = table(spark, d, "documents").select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    texts.select(byte_ids("text").alias("ids")).write.format("npy").mode("append").option("shardIds", 100_000).save(at)
    rows = spark.read.format("npy").option("rowIds", 4096).option("sliceIds", 65_536).load(at)
    rows = token_stream.slice_sums(rows, 4096)
    return rows.groupBy("slice").agg(F.sum("n").alias("n_ids"), F.sum("s").alias("id_sum"), F.sum("p").alias("placed"))  # a slice may go across shards


@query(f"WITH {_SFT}, packed AS (WITH {_PAD}) SELECT conv_id, CASE WHEN row_number() OVER (ORDER BY conv_id) - 1 < floor(count(*) OVER () * (1 - 0.1::DOUBLE)) THEN 'train' ELSE 'val' END AS split, input_ids, list_sum(loss_mask) AS n_response FROM packed")
def packed_sink(spark, d):
    """Padded examples in a folder for each split."""
    at = _place(spark, "packed")
    files.write_packed(ordering.train_val_split(chat.pad_and_shift(_examples(spark, d), PACKED, 256), "conv_id", 0.1).drop("rn"), at)
    return spark.read.parquet(at).select("conv_id", "split", "input_ids", F.aggregate("loss_mask", F.lit(0.0), lambda s, x: s + x).alias("n_response"))


@query("SELECT conv_id, turn, role, text FROM conversations")
def jsonl_sink(spark, d):
    at = _place(spark, "jsonl")
    files.write_jsonl(table(spark, d, "conversations").select("conv_id", "turn", "role", "text"), at)
    return files.read_jsonl(spark, at, "conv_id long, turn long, role string, text string")


@query("SELECT event_id AS step, value AS loss, part FROM events, (VALUES ('first'), ('second')) p(part) WHERE (event_id % 2 = 0) = (part = 'first')")
def csv_log_sink(spark, d):
    """A log appended to twice."""
    at = _place(spark, "log")
    t = table(spark, d, "events").select(F.col("event_id").alias("step"), F.col("value").alias("loss"))
    even = F.col("step") % 2 == 0
    files.append_csv_log(t.where(even).withColumn("part", F.lit("first")), at)
    files.append_csv_log(t.where(~even).withColumn("part", F.lit("second")), at)
    return files.read_csv_log(spark, at, "step long, loss double, part string")


@query("SELECT 'w' || vec_id AS name, label + 2 AS shape, embedding::DOUBLE[] AS vals FROM embeddings")
def checkpoint_sink(spark, d):
    """Two generations of parameters; the later one is read."""
    at = _place(spark, "checkpoint")
    for step in (1, 2):
        files.write_checkpoint(table(spark, d, "embeddings").select(F.concat(F.lit("w"), "vec_id").alias("name"), (F.col("label") + step).alias("shape"), F.col("embedding").cast("array<double>").alias("vals")), at, step)
    return files.read_checkpoint(spark, at, 2)
