"""BPE training, encoding and decoding on the corpus."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions.text import END, byte_sequence, merged, sequence_tokens
from tessera.operators import bpe
from tessera.plans.base import MERGES, query, spread, sql_bpe, sql_pretokens, sql_vocab, sql_words, table
from tessera.sources import files
from tessera.sources.scratch import shared_dir


#: Merges of the queries that SQL cannot follow any more.
MANY, PRODUCTION = 200, 10_000


def _merges(spark, d, n=MERGES):
    return bpe.train(bpe.word_sequences(bpe.word_freqs(spread(table(spark, d, "documents")))), n)


def _vocab(spark, d):
    return bpe.vocabulary(spark, _merges(spark, d))


def _merge_rows(spark, merges):
    return spark.createDataFrame([(k, a, b, c) for k, (a, b, c) in enumerate(merges)], "rank int, a string, b string, c long")  # as many as merges


_PAIRS = """SELECT a, b, sum(cnt)::BIGINT AS c FROM (SELECT cnt, unnest(t[:-2]) AS a, unnest(t[2:]) AS b FROM (SELECT cnt, string_split(seq[2:-2], '><') AS t FROM words) WHERE len(t) > 1) WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY a, b"""


@query(f"WITH {sql_words()} {_PAIRS}")
def pair_counts(spark, d):
    return bpe.pair_counts(bpe.word_sequences(bpe.word_freqs(spread(table(spark, d, "documents")))))


@query(f"WITH {sql_words()}, p AS ({_PAIRS}) SELECT * FROM p ORDER BY c DESC, a DESC, b DESC LIMIT 1")
def best_pair(spark, d):
    return bpe.best_pair(pair_counts(spark, d))


@query(f"WITH {sql_words().replace('words AS', 'words AS MATERIALIZED')}, p AS ({_PAIRS}), best AS MATERIALIZED (SELECT * FROM p ORDER BY c DESC, a DESC, b DESC LIMIT 1) SELECT word, seq, cnt FROM words, best WHERE contains(seq, '<' || a || '><' || b || '>')")
def words_of_best_pair(spark, d):
    """By the inverted table from pairs to words, written and looked up."""
    at = f"{shared_dir(spark)}/pair-index-{uuid.uuid4().hex}"
    words = bpe.word_sequences(bpe.word_freqs(spread(table(spark, d, "documents"))))
    bpe.write_pair_index(words, at)
    top = bpe.best_pair(bpe.pair_counts(words)).first()
    return bpe.words_with(spark, at, (top["a"], top["b"])) if top else words.limit(0)


@query(f"WITH {sql_words()} SELECT word, replace(replace(seq, '<65><6E>', '<656E>'), '<656E><74>', '<656E74>') AS seq FROM words")
def bpe_apply_merge(spark, d):
    words = bpe.word_freqs(spread(table(spark, d, "documents")))
    return words.select("word", merged(merged(byte_sequence("word"), "65", "6E"), "656E", "74").alias("seq"))


@query(f"WITH RECURSIVE {sql_bpe()} SELECT rank::INT AS rank, a, b, c FROM merged")
def bpe_train_k(spark, d):
    return _merge_rows(spark, _merges(spark, d))


@query()
def bpe_train_200(spark, d):
    """Two hundred merges; tests compare training with plain Python."""
    return _merge_rows(spark, _merges(spark, d, MANY))


@query()
def bpe_train_10000(spark, d):
    """A production vocabulary's merges; tests compare training with plain Python."""
    return _merge_rows(spark, _merges(spark, d, PRODUCTION))


@query()
def bpe_encode_200(spark, d):
    """Each distinct word's tokens by two hundred merges."""
    return bpe.segmented(bpe.word_freqs(spread(table(spark, d, "documents"))).select("word"), _merges(spark, d, MANY))


@query()
def encode_docs_10000(spark, d):
    """Documents with their end marks, by a production vocabulary."""
    merges = _merges(spark, d, PRODUCTION)
    return bpe.encoded_arrays(_marked(spark, d), merges, bpe.vocabulary(spark, merges))


@query(f"WITH RECURSIVE {sql_bpe()}, {sql_vocab()} SELECT id, tok FROM vocab")
def load_vocab(spark, d):
    """The vocabulary written as JSON and read back."""
    return files.vocab_from_json(files.vocab_json(_vocab(spark, d)))


@query(f"WITH RECURSIVE {sql_bpe()} SELECT rank::INT AS rank, a, b FROM merged")
def load_merges(spark, d):
    """The merges written as lines and read back."""
    return files.merges_from_text(files.merges_text(_merge_rows(spark, _merges(spark, d))))


@query(f"""WITH RECURSIVE {sql_bpe()}, {sql_vocab()}
SELECT '{{' || string_agg('"' || id || '":"' || lower(tok) || '"', ',' ORDER BY id) || '}}' AS json, (SELECT '# BPE merges' || chr(10) || string_agg(lower(a) || ' ' || lower(b), chr(10) ORDER BY rank) || chr(10) FROM merged) AS text FROM vocab""")
def vocab_roundtrip(spark, d):
    """Both files' contents."""
    merges = _merges(spark, d)
    return files.vocab_json(bpe.vocabulary(spark, merges)).crossJoin(files.merges_text(_merge_rows(spark, merges)))  # two rows of one each


@query(f"""WITH RECURSIVE {sql_bpe()}, {sql_vocab()}, more AS (SELECT * FROM (VALUES (0, '<|pad|>'), (1, '<|user|>'), (2, '<|tool|>')) m(k, s)),
missing AS (SELECT hex(encode(s)) AS tok, row_number() OVER (ORDER BY k) AS n FROM more WHERE hex(encode(s)) NOT IN (SELECT tok FROM vocab))
SELECT id, tok FROM vocab UNION ALL SELECT ((SELECT max(id) FROM vocab) + n)::INT, tok FROM missing""")
def vocab_with_specials(spark, d):
    return bpe.with_specials(_vocab(spark, d), ["<|pad|>", "<|user|>", "<|tool|>"])


@query(f"WITH RECURSIVE {sql_bpe()}, {sql_vocab()} SELECT id, (length(tok) // 2)::INT AS n_bytes, tok FROM vocab ORDER BY 2 DESC, id LIMIT 1")
def longest_token(spark, d):
    return _vocab(spark, d).select("id", (F.length("tok") / 2).cast("int").alias("n_bytes"), "tok").orderBy(F.desc("n_bytes"), "id").limit(1)


@query(f"WITH RECURSIVE {sql_bpe()} SELECT word, string_split(seq[2:-2], '><') AS tokens FROM final")
def bpe_encode(spark, d):
    """Each distinct word's tokens."""
    return bpe.segmented(bpe.word_freqs(spread(table(spark, d, "documents"))).select("word"), _merges(spark, d))


_ENCODED = f"""{sql_bpe()}, {sql_vocab()},
tok AS (SELECT doc_id, i AS nth, w[i] AS word FROM (SELECT doc_id, {sql_pretokens("text")} AS w FROM documents), unnest(range(1, len(w) + 1)) u(i)),
wid AS (SELECT word, list(id ORDER BY k) AS ids FROM (SELECT word, t[k] AS tok, k FROM (SELECT word, string_split(seq[2:-2], '><') AS t FROM final), unnest(range(1, len(t) + 1)) u(k)) JOIN (SELECT tok, max(id) AS id FROM vocab GROUP BY tok) v USING (tok) GROUP BY word),
ids AS (SELECT doc_id, list_append(flatten(list(ids ORDER BY nth)), 256) AS ids FROM tok JOIN wid USING (word) GROUP BY doc_id)"""


def _marked(spark, d):
    """Documents, each with the end mark after its text."""
    return spread(table(spark, d, "documents")).select("doc_id", F.concat("text", F.lit(END)).alias("text"))


def encoded(spark, d, merges=None):
    merges = _merges(spark, d) if merges is None else merges
    return bpe.encoded_arrays(_marked(spark, d), merges, bpe.vocabulary(spark, merges))


@query(f"WITH RECURSIVE {_ENCODED} SELECT doc_id, ids FROM ids")
def encode_docs(spark, d):
    return encoded(spark, d)


@query(f"WITH RECURSIVE {_ENCODED} SELECT doc_id, (i - 1)::BIGINT AS pos, ids[i] AS id FROM ids, unnest(range(1, len(ids) + 1)) u(i)")
def encode_iterable(spark, d):
    return encoded(spark, d).select("doc_id", F.posexplode("ids").alias("pos", "id")).select("doc_id", F.col("pos").cast("long").alias("pos"), "id")


@query("SELECT doc_id, text || '<|endoftext|>' AS text FROM documents")
def decode_tokens(spark, d):
    merges = _merges(spark, d)
    return bpe.decode(encoded(spark, d, merges), bpe.vocabulary(spark, merges))


@query(f"WITH RECURSIVE {_ENCODED} SELECT sum(octet_length(encode(text)))::BIGINT AS n_bytes, sum(len(ids) - 1)::BIGINT AS n_tokens, round(sum(octet_length(encode(text)))::DOUBLE / greatest(1, sum(len(ids) - 1)), 6) AS bytes_per_token FROM documents JOIN ids USING (doc_id)")
def compression_ratio(spark, d):
    t = encoded(spark, d).agg(F.sum(F.greatest(F.size("ids") - 1, F.lit(0))).alias("n")).crossJoin(table(spark, d, "documents").agg(F.sum(F.octet_length("text")).alias("b")))  # one row each
    return t.agg(F.sum("b").alias("n_bytes"), F.sum("n").alias("n_tokens")).select("n_bytes", "n_tokens", F.round(F.col("n_bytes") / F.greatest(F.lit(1), "n_tokens"), 6).alias("bytes_per_token"))


@query(f"""WITH RECURSIVE {sql_bpe()}, pairs AS (SELECT word, i - 1 AS pos, t[i] AS a, t[i + 1] AS b FROM (SELECT word, string_split(seq[2:-2], '><') AS t FROM words), unnest(range(1, len(t))) u(i))
SELECT word, pos, a, b, coalesce(rank, 1000000)::BIGINT AS rank FROM pairs LEFT JOIN merged USING (a, b)""")
def pair_ranks(spark, d):
    """The rank of each pair of neighbouring bytes of each word; a million stands for none."""
    words = bpe.word_sequences(bpe.word_freqs(spread(table(spark, d, "documents")))).select("word", sequence_tokens("seq").alias("t")).where("size(t) > 1")
    pairs = words.select("word", F.posexplode(F.arrays_zip(F.expr("slice(t, 1, size(t) - 1)").alias("a"), F.expr("slice(t, 2, size(t) - 1)").alias("b"))).alias("pos", "p"))
    ranks = F.broadcast(_merge_rows(spark, _merges(spark, d)).select("a", "b", "rank"))  # as many rows as merges
    pairs = pairs.select("word", F.col("pos").cast("long").alias("pos"), "p.a", "p.b").join(ranks, ["a", "b"], "left")
    return pairs.select("word", "pos", "a", "b", F.coalesce("rank", F.lit(1_000_000)).cast("long").alias("rank"))
