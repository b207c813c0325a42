"""Byte-level BPE as relations: words, pair counts, merges, encoding and decoding."""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import SPECIALS, byte_sequence, pretokens, sequence_tokens, split_specials
from tessera.operators import merging
from tessera.sources.scratch import remove, shared_dir


def pretokenize(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, pos, word."""
    return docs.select("doc_id", F.posexplode(pretokens(text)).alias("pos", "word"))


def word_freqs(docs: DataFrame, text: str = "text") -> DataFrame:
    return pretokenize(docs, text).groupBy("word").agg(F.count("*").alias("cnt"))


def word_sequences(freqs: DataFrame) -> DataFrame:
    return freqs.select("word", byte_sequence("word").alias("seq"), "cnt")


def pair_counts(words: DataFrame) -> DataFrame:
    """words(seq, cnt): how often each two tokens stand side by side."""
    t = words.select(sequence_tokens("seq").alias("t"), "cnt").where(F.size("t") > 1)
    pairs = t.select(F.explode(F.arrays_zip(F.expr("slice(t, 1, size(t) - 1)").alias("a"), F.expr("slice(t, 2, size(t) - 1)").alias("b"))).alias("p"), "cnt")
    return pairs.groupBy("p.a", "p.b").agg(F.sum("cnt").alias("c"))


def best_pair(counts: DataFrame) -> DataFrame:
    """The most frequent pair; of equals the one with the greatest bytes."""
    return counts.where("c > 0").orderBy(F.desc("c"), F.desc("a"), F.desc("b")).limit(1)


def pair_index(words: DataFrame) -> DataFrame:
    """The inverted table of words(word, seq, cnt): a, b, word, cnt for each pair of tokens of a word."""
    t = words.select("word", "cnt", sequence_tokens("seq").alias("t")).where(F.size("t") > 1)
    pairs = F.array_distinct(F.arrays_zip(F.expr("slice(t, 1, size(t) - 1)").alias("a"), F.expr("slice(t, 2, size(t) - 1)").alias("b")))
    return t.select("word", "cnt", F.explode(pairs).alias("p")).select("p.a", "p.b", "word", "cnt")


def write_pair_index(words: DataFrame, path: str) -> None:
    """The inverted table, sorted by pair and word: a pair's rows are next to each other, and those of a frequent one in several files."""
    pair_index(words).repartitionByRange("a", "b", "word").sortWithinPartitions("a", "b", "word").write.option("parquet.block.size", 8 << 20).parquet(path)


def words_with(spark: SparkSession, path: str, pair: tuple[str, str]) -> DataFrame:
    """word, seq, cnt of the words that hold a pair, from the inverted table; bounds in the files' footers leave out the rest."""
    a, b = pair
    return spark.read.parquet(path).where((F.col("a") == a) & (F.col("b") == b)).select("word", byte_sequence("word").alias("seq"), "cnt")


#: Pairs that a round of training starts from, at most; sequences, and characters of them, that come to the driver for it.
TOP_PAIRS, SEQUENCES, SEQUENCE_CHARS = 1 << 16, 100_000, 16 << 20


def _tokens(seq: str) -> list[str]:
    return seq[1:-1].split("><")


def _sequence(tokens: list[str]) -> str:
    return f"<{'><'.join(tokens)}>"


def between_rare(words: DataFrame, frequent: set[tuple[str, str]]) -> DataFrame:
    """seq, cnt: words cut between neighbours that are no frequent pair, equal pieces of two tokens or more counted together."""
    sent = words.sparkSession.sparkContext.broadcast(frequent)  # TOP_PAIRS at most

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = sent.value
        for batch in batches:
            n: dict[str, int] = defaultdict(int)
            for seq, cnt in zip(batch.column("seq").to_pylist(), batch.column("cnt").to_pylist(), strict=True):
                t, a = _tokens(seq), 0
                for k in range(1, len(t) + 1):
                    if k == len(t) or (t[k - 1], t[k]) not in frequent:
                        if k - a > 1:
                            n[_sequence(t[a:k])] += cnt
                        a = k
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["seq", "cnt"])

    return words.select("seq", "cnt").mapInArrow(cut, "seq string, cnt long").groupBy("seq").agg(F.sum("cnt").alias("cnt"))


def with_merges(words: DataFrame, merges: list[tuple[str, str, int]]) -> DataFrame:
    """words(seq, cnt) after merges, with `was`: the sequence before, null where nothing changed."""
    place = {(a, b): k for k, (a, b, _) in enumerate(merges)}

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs, now = batch.column("seq").to_pylist(), []
            for seq in seqs:
                t = _tokens(seq)
                now.append(_sequence(merging.replay(t, place)) if any(p in place for p in zip(t, t[1:], strict=False)) else seq)
            was = [x if x != y else None for x, y in zip(seqs, now, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(now, pa.string()), batch.column("cnt"), pa.array(was, pa.string())], names=["seq", "cnt", "was"])

    return words.select("seq", "cnt").mapInArrow(rewrite, "seq string, cnt long, was string")


def train(words: DataFrame, merges: int) -> list[tuple[str, str, int]]:
    """Up to `merges` merges (a, b, count), in order, as one at a time would give them; words stay distributed.

    A round takes the pairs above a floor, the count of the first pair that it leaves out. A merge leaves counts of pairs lower or
    equal, and a pair that it makes stands nowhere but where one of the pairs that it took from stood, so nothing outside of the
    places of these pairs can come above the floor: the words cut at all other places have all that the merges above the floor
    depend on. These pieces, equal ones as one, are few, and the merges are made of them on the driver; if they are more than
    SEQUENCES, the round takes fewer pairs. Then the words with such a pair are rewritten, and pair counts go by the differences of
    the rewritten words. Tables of a round are written, so that no plan grows, and go when the next ones are there.
    """
    spark, at = words.sparkSession, f"{shared_dir(words.sparkSession)}/bpe-{uuid.uuid4().hex}"

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{at}/{name}")
        return spark.read.schema(df.schema).parquet(f"{at}/{name}")

    # few merges need few pairs; a round that takes too many goes over all words for nothing
    k, width, found, known = 0, min(TOP_PAIRS, max(64, 8 * merges)), [], set()
    now = written(words.select("seq", "cnt").where("seq like '%><%'"), "words0")
    counts = written(pair_counts(now).where("c > 0"), "counts0")
    while len(found) < merges:
        top = [tuple(r) for r in counts.orderBy(F.desc("c"), F.desc("a"), F.desc("b")).limit(width + 1).collect()]
        if not top:
            break
        floor = top[width][2] if len(top) > width else 0
        frequent, most = {(a, b) for a, b, c in top if c > floor}, merges - len(found)
        if not frequent:  # the first `width` pairs are equally frequent: only the first of them is certain
            frequent, most, floor = {top[0][:2]}, 1, 0
        pieces = written(between_rare(now, frequent), f"pieces{k}-{width}")
        size = pieces.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("chars")).first()
        if len(frequent) > 1 and (size["n"] > SEQUENCES or size["chars"] > SEQUENCE_CHARS):
            remove(spark, f"{at}/pieces{k}-{width}")
            width = max(1, width // 8)
            continue
        new = merging.next_merges([(_tokens(r["seq"]), r["cnt"]) for r in pieces.collect()], most, floor, known)
        found += new
        known |= {a + b for a, b, _ in new}
        if len(found) < merges:
            now = written(with_merges(now, new).where("was is not null or seq like '%><%'"), f"words{k + 1}")
            changed = now.where("was is not null").select(F.explode(F.array(F.struct("seq", "cnt"), F.struct(F.col("was").alias("seq"), (-F.col("cnt")).alias("cnt")))).alias("x"))
            counts = written(counts.unionByName(pair_counts(changed.select("x.*"))).groupBy("a", "b").agg(F.sum("c").alias("c")).where("c > 0"), f"counts{k + 1}")
            now = now.where("seq like '%><%'")
        for name in (f"words{k}", f"counts{k}", f"pieces{k}-{width}"):
            remove(spark, f"{at}/{name}")
        k, width = k + 1, min(TOP_PAIRS, width * 2)
    remove(spark, at)
    return found


def _ranks(merges: list[tuple]) -> dict[tuple[bytes, bytes], int]:
    """Pair to rank; of a pair that comes twice the first counts."""
    return {(bytes.fromhex(a), bytes.fromhex(b)): k for k, (a, b, *_) in reversed(list(enumerate(merges)))}


#: Words that a task remembers with their tokens.
REMEMBERED = 1 << 17


class Words:
    """Tokens of words by merges, the latest of them remembered."""

    def __init__(self, ranks: dict[tuple[bytes, bytes], int], of=None):
        self.ranks, self.of, self.seen = ranks, of or (lambda tokens: tokens), {}

    def __call__(self, word: str):
        found = self.seen.get(word)
        if found is None:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            found = self.seen[word] = self.of(merging.encode([bytes((x,)) for x in word.encode()], self.ranks))
        return found


def segmented(words: DataFrame, merges: list[tuple]) -> DataFrame:
    """words(word) with `tokens`, as hex: each task applies the merges, the lowest rank and leftmost first, by a heap."""
    sent = words.sparkSession.sparkContext.broadcast(_ranks(merges))  # as many as merges

    @F.pandas_udf("array<string>")
    def encode(word: pd.Series) -> pd.Series:
        return word.map(Words(sent.value, lambda tokens: [t.hex().upper() for t in tokens]))

    return words.withColumn("tokens", encode("word"))


def vocabulary(spark: SparkSession, merges: list[tuple], specials=SPECIALS) -> DataFrame:
    """id, tok (hex): the 256 bytes, the specials, then the merged tokens in order."""
    rows = [(k, f"{k:02X}") for k in range(256)]
    rows += [(256 + k, s.encode().hex().upper()) for k, s in enumerate(specials)]
    rows += [(256 + len(specials) + k, a + b) for k, (a, b, *_) in enumerate(merges)]
    return spark.createDataFrame(rows, "id int, tok string")  # as many rows as the vocabulary


def with_specials(vocab: DataFrame, specials: list[str]) -> DataFrame:
    """vocab with the specials that it lacks, at ids from the largest on, in order."""
    spark = vocab.sparkSession
    more = spark.createDataFrame([(k, s.encode().hex().upper()) for k, s in enumerate(specials)], "k int, tok string")
    top = vocab.agg(F.max("id").alias("top"))
    have = more.join(vocab.select("tok"), "tok", "left_anti")
    ranked = have.select("tok", F.expr("row_number() over (order by k)").alias("n"))  # one row for each special
    return vocab.select("id", "tok").unionByName(ranked.crossJoin(top).select((F.col("top") + F.col("n")).cast("int").alias("id"), "tok"))


def token_ids(vocab: DataFrame) -> DataFrame:
    """tok to id; of equal tokens the last id counts."""
    return vocab.groupBy("tok").agg(F.max("id").alias("id"))


def pieces_of(text: str | Column, specials=SPECIALS) -> Column:
    """The words of a text in order, specials among them as words of their own."""
    quick = list(specials)
    return F.flatten(F.transform(split_specials(text, quick, keep=True), lambda p: F.when(p.isin(*quick), F.array(p)).otherwise(pretokens(p)) if quick else pretokens(p)))


def encoded_arrays(docs: DataFrame, merges: list[tuple], vocab: DataFrame, text: str = "text", specials=SPECIALS) -> DataFrame:
    """doc_id and the ids of its text, in order; a document without text has none.

    Each task encodes its documents: a batch's distinct words once each, by the merges, with the latest words remembered, so no
    token is shuffled and a frequent word is no task of its own. Merges and vocabulary are broadcast. Specials are kept whole.
    """
    ids = {bytes.fromhex(r["tok"]): r["id"] for r in token_ids(vocab).collect()}  # the vocabulary's size
    sent = docs.sparkSession.sparkContext.broadcast((_ranks(merges), ids, {s: [ids[s.encode()]] for s in specials if s.encode() in ids}))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, ids, own = sent.value
        words = Words(ranks, lambda tokens: [ids[t] for t in tokens if t in ids])
        for batch in batches:
            for part in (batch.slice(k, 1000) for k in range(0, len(batch), 1000)):
                column = part.column("words")
                flat = pc.dictionary_encode(column.flatten())
                known = [own[w] if w in own else words(w) for w in flat.dictionary.to_pylist()]
                n = np.array([len(x) for x in known], np.int64)
                data, first = np.fromiter(chain.from_iterable(known), np.int32, int(n.sum())), np.cumsum(n) - n
                which = flat.indices.to_numpy(zero_copy_only=False)
                size = n[which]
                at = np.concatenate([[0], np.cumsum(size)])
                own_ids = data[np.repeat(first[which], size) + np.arange(at[-1]) - np.repeat(at[:-1], size)]
                lists = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(at[lists].astype(np.int32)), pa.array(own_ids, pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", pieces_of(text, specials).alias("words")).mapInArrow(encode, T.StructType([docs.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """tokens(doc_id, ids) to text, each task its own; bytes that aren't UTF-8 become U+FFFD, ids out of the vocabulary go."""
    rows = vocab.select("id", "tok").collect()  # the vocabulary's size
    known = {r["id"]: bytes.fromhex(r["tok"]) for r in rows if r["id"] >= 0}
    size = np.zeros(max(known, default=-1) + 2, np.int64)  # the last one stands for ids out of the vocabulary
    for i, t in known.items():
        size[i] = len(t)
    sent = tokens.sparkSession.sparkContext.broadcast((size, np.frombuffer(b"".join(known[i] for i in sorted(known)), np.uint8)))

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, data = sent.value
        first = np.cumsum(size) - size
        for part in (batch.slice(k, 1000) for batch in batches for k in range(0, len(batch), 1000)):
            column = part.column("ids")
            ids = pc.fill_null(column.flatten(), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = np.where((ids >= 0) & (ids < len(size)), ids, len(size) - 1)
            n = size[ids]
            at = np.concatenate([[0], np.cumsum(n)])
            raw = data[np.repeat(first[ids] - at[:-1], n) + np.arange(at[-1])].tobytes()
            lists = at[np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))])].tolist()
            texts = [raw[a:z].decode("utf-8", "replace") if on else None for a, z, on in zip(lists[:-1], lists[1:], column.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(back, T.StructType([tokens.schema["doc_id"], T.StructField("text", T.StringType())]))
