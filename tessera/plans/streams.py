"""Streams, and the numpy transformer."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions.text import byte_ids, pretokens
from tessera.operators import generation, ordering, transformer
from tessera.plans.base import query, spread, sql_pretokens, table
from tessera.plans.metrics import ids_of
from tessera.sources.scratch import shared_dir
from tessera.streaming import batches, decoder


#: Turns in a task of the model, and bytes of text in one of the incremental decoder: what a task does has a bound, their number grows.
PROMPTS, DECODED = 1000, 1 << 21


@query(f"SELECT conv_id, turn, {sql_pretokens('text')} AS words FROM conversations")
def stream_encode(spark, d):
    """Conversations as a stream, pre-tokenized as they come; the rows are those of the batch."""
    schema = table(spark, d, "conversations").schema
    source = spark.readStream.schema(schema).parquet(f"{d}/conversations*.parquet")
    at = f"{shared_dir(spark)}/stream-encode-{uuid.uuid4().hex}"
    return decoder.run_available(source, lambda s: s.select("conv_id", "turn", pretokens("text").alias("words")), f"{at}/out", f"{at}/state")


def _streams(spark, d):
    """Conversations with a key of each turn's own: the ids that the results show are not, from a conversation's hundredth turn on."""
    return table(spark, d, "conversations").withColumn("stream", F.shiftleft("conv_id", 20) + F.col("turn"))


def _joined(pieces):
    """stream, text: a turn's pieces in their order, under the id that the results show."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "piece"))), lambda s: s["piece"]), "")
    out = pieces.groupBy("stream").agg(text.alias("text"))
    return out.select((F.shiftright("stream", 20) * 100 + F.col("stream").bitwiseAND(F.lit((1 << 20) - 1))).alias("stream"), "text")


@query("SELECT conv_id * 100 + turn AS stream, text FROM conversations WHERE text <> ''")
def streaming_decode(spark, d):
    """Each turn's bytes decoded one by one, and the pieces joined."""
    return _joined(decoder.decode_batch(decoder.byte_tokens(_streams(spark, d), "stream")))


@query("SELECT conv_id * 100 + turn AS stream, text FROM conversations WHERE text <> ''")
def streaming_decode_stateful(spark, d):
    """Each turn's bytes as a stream in four parts, cut anywhere in a character: decoded with state over several micro-batches, by
    two runs of which the second goes on from the first one's checkpoint."""
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # transformWithState needs it
    at, turns = f"{shared_dir(spark)}/stream-decode-{uuid.uuid4().hex}", _streams(spark, d)
    n = max(2, -(-(turns.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // DECODED))
    turns = turns.select("stream", "text").repartition(n, "stream")
    for run in range(2):
        for part in (2 * run, 2 * run + 1):  # a stream's tokens of one part are in one file, and parts come one after the other
            tokens = decoder.byte_tokens(turns, "stream", part=part, parts=4)
            tokens.write.mode("append").parquet(f"{at}/in")
        source = spark.readStream.schema(tokens.schema).option("maxFilesPerTrigger", n).parquet(f"{at}/in")
        pieces = decoder.run_available(source, lambda s: decoder.decode_stream(s, 16 * n), f"{at}/out", f"{at}/state", n)
    return _joined(pieces)


@query()
def endless_batches(spark, d):
    """Seventy-five batches of 32 documents over several seeded epochs, by three runs that each go on from the checkpoint."""
    docs = table(spark, d, "documents").select("doc_id")
    n, at = docs.count(), f"{shared_dir(spark)}/endless-{uuid.uuid4().hex}"
    for _ in range(3):
        places = decoder.run_available(batches.endless(spark, n, 32, "train", 25), lambda s: s, f"{at}/out", f"{at}/state")
    return places.join(ordering.ranked(docs, "doc_id", "place"), "place").select("epoch", "batch", "slot", "doc_id")


@query()
def transformer_forward(spark, d):
    """The mean loss of each window of 64 bytes, the model's context, of each turn, under seeded weights."""
    t = spread(table(spark, d, "conversations"), PROMPTS).select((F.col("conv_id") * 100 + F.col("turn")).alias("turn"), byte_ids("text").alias("t")).where("size(t) > 0")
    t = t.select("turn", F.posexplode(F.expr("transform(sequence(1, size(t), 64), s -> slice(t, s, 64))")).alias("w", "ids"))
    nll = transformer.score(t.select((F.col("turn") * 10_000 + F.col("w")).alias("seq"), "ids"), transformer.Transformer())
    return nll.select("seq", F.round("nll", 6).alias("nll"))


_BYTES = "list_transform(regexp_extract_all(hex(encode({})), '..'), lambda x: ('0x' || x)::INT)"


def _sql_generated(k: int, temperature: float, steps: int, stop: int, seed: str) -> str:
    """CTEs after WITH RECURSIVE up to done(seq, ids)."""
    return f"""t AS (SELECT conv_id * 100 + turn AS seq, role, {_BYTES.format('text')} AS t FROM conversations WHERE text <> ''),
counts AS (SELECT prev, tok, count(*) AS n FROM (SELECT unnest(t[:-2]) AS prev, unnest(t[2:]) AS tok FROM t WHERE len(t) > 1) GROUP BY prev, tok),
top AS (SELECT prev, tok, place, pow(n::DOUBLE, 1 / {temperature}::DOUBLE) AS w FROM (SELECT *, row_number() OVER (PARTITION BY prev ORDER BY n DESC, tok) AS place FROM counts) WHERE place <= {k}),
choices AS MATERIALIZED (SELECT prev, list({{'until': until, 'tok': tok}} ORDER BY place) AS c FROM (SELECT prev, tok, place, sum(w) OVER (PARTITION BY prev ORDER BY place) / sum(w) OVER (PARTITION BY prev ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS until FROM top) GROUP BY prev),
g AS (SELECT seq, 0 AS step, t[-1] AS id, []::INT[] AS ids FROM t WHERE role = 'user'
  UNION ALL SELECT seq, step + 1, tok, list_append(ids, tok) FROM (SELECT seq, step, ids, coalesce(list_filter(c, lambda x: x.until > ('0x' || substr(md5('{seed}|' || seq || '|' || step), 1, 8))::BIGINT / 4294967296.0::DOUBLE)[1].tok, c[-1].tok)::INT AS tok FROM g JOIN choices ON prev = id WHERE step < {steps} AND (step = 0 OR id <> {stop}))),
done AS (SELECT seq, arg_max(ids, step) AS ids FROM g GROUP BY seq)"""


def _bigram(spark, d, k, temperature):
    ids = table(spark, d, "conversations").select(F.expr(ids_of("text")).alias("ids"))
    return generation.next_ids(generation.bigram_counts(ids), k, temperature)


def _lasts(spark, d):
    t = table(spark, d, "conversations").where("role = 'user' and text <> ''")
    return t.select((F.col("conv_id") * 100 + F.col("turn")).alias("seq"), F.element_at(F.expr(ids_of("text")), -1).alias("last"))


@query(f"WITH RECURSIVE {_sql_generated(1, 1.0, 16, 10, 'greedy')} SELECT seq, ids FROM done")
def bigram_generate(spark, d):
    """Sixteen ids after each user turn, the most frequent one after the last id each time; a line feed ends it."""
    return generation.generate(_lasts(spark, d), _bigram(spark, d, 1, 1.0), 16, 10, "greedy")


@query(f"WITH RECURSIVE {_sql_generated(8, 0.8, 16, 10, 'sampled')} SELECT seq, (i - 1)::BIGINT AS step, ids[i] AS id, CASE WHEN i = len(ids) THEN CASE WHEN ids[-1] = 10 THEN 'stop' WHEN len(ids) = 16 THEN 'length' ELSE 'end' END END AS finish FROM done, unnest(range(1, len(ids) + 1)) u(i)")
def bigram_generate_stream(spark, d):
    """Up to sixteen sampled ids after each user turn (top 8, temperature 0.8), a row for each with the reason for the end."""
    return generation.pieces(generation.generate(_lasts(spark, d), _bigram(spark, d, 8, 0.8), 16, 10, "sampled"), 10, 16)


def _prompts(spark, d):
    return spread(table(spark, d, "conversations").where("role = 'user'"), PROMPTS).select((F.col("conv_id") * 100 + F.col("turn")).alias("seq"), byte_ids("text").alias("ids"))


@query()
def generate(spark, d):
    """Sixteen ids after each user turn, by the likeliest each time."""
    return transformer.generate(_prompts(spark, d), transformer.Transformer(), 16, 64)


#: Settings of the sampled stream.
SAMPLER = transformer.Sampler(temperature=0.8, k=40, share=0.02, mass=0.9, penalty=1.2, seed="stream")


@query()
def generate_stream(spark, d):
    """Up to sixteen sampled ids after each user turn, a row for each; a line feed ends a stream."""
    return transformer.generate_stream(_prompts(spark, d), transformer.Transformer(), 16, 64, 10, SAMPLER)
