"""Incremental decoding of token streams, and encoding of a stream of documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.functions.text import byte_tokens_of

#: Groups of streams whose state is kept together, unless a caller says how many; a call for each stream costs more than its tokens.
GROUPS = 64


def valid_prefix(buffer: bytes) -> tuple[str, bytes]:
    """The longest start that is UTF-8, as text, and the bytes after it."""
    try:
        return buffer.decode("utf-8"), b""
    except UnicodeDecodeError as e:
        return buffer[: e.start].decode("utf-8"), buffer[e.start :]


def _pieces(rows: pd.DataFrame, held: dict[int, bytes]) -> pd.DataFrame:
    """stream, pos, piece of rows in the order of stream and pos; `held` has the bytes that streams wait with, and is changed."""
    out = []
    for stream, tok, last in zip(rows["stream"].tolist(), rows["tok"].tolist(), rows["last"].tolist(), strict=True):
        tok = bytes(tok)
        if tok.isascii() and stream not in held:
            out.append(tok.decode("ascii"))
            continue
        text, left = valid_prefix(held.pop(stream, b"") + tok)
        if last:
            text, left = text + left.decode("utf-8", "replace"), b""
        if left:
            held[stream] = left
        out.append(text)
    return pd.DataFrame({"stream": rows["stream"].array, "pos": rows["pos"].array, "piece": out})


class TokenDecoder(StatefulProcessor):
    """For rows (stream, pos, tok: binary, last: boolean) of a group of streams: the text that each token completes. What is left at
    the end becomes U+FFFD. The state has the streams that wait within a character, and no others."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getMapState("waiting", "stream long", "bytes binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = {k[0]: bytes(v[0]) for k, v in self.waiting.iterator()} if self.waiting.exists() else {}
        held = dict(before)
        yield _pieces(pd.concat(list(rows)).sort_values(["stream", "pos"]), held)
        for stream in before.keys() - held.keys():
            self.waiting.removeKey((stream,))
        for stream, left in held.items():
            if before.get(stream) != left:
                self.waiting.updateValue((stream,), (left,))

    def close(self) -> None:
        pass


def decode_stream(tokens: DataFrame, groups: int = GROUPS) -> DataFrame:
    """A streaming DataFrame of (stream, pos, tok, last) to (stream, pos, piece). A checkpoint keeps its number of groups."""
    own = tokens.select("stream", "pos", "tok", "last", F.pmod(F.xxhash64("stream"), F.lit(groups)).alias("group"))
    return own.groupBy("group").transformWithStateInPandas(TokenDecoder(), "stream long, pos long, piece string", "Append", "None")


def run_available(source: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, partitions: int | None = None) -> DataFrame:
    """Runs a stream over all that is there, into Parquet, and reads it. The state is in so many partitions, or as many as a shuffle has
    in this session; each has a store and a worker to begin in every micro-batch. A checkpoint keeps their number."""
    result = transform(source)
    spark = source.sparkSession
    name = "spark.sql.shuffle.partitions"
    usual = spark.conf.get(name)
    if partitions:
        spark.conf.set(name, str(partitions))
    try:
        q = result.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(name, usual)
    return spark.read.schema(result.schema).parquet(out)


def decode_batch(tokens: DataFrame) -> DataFrame:
    """The same pieces for a finished table: what the longest valid prefix grows by at each token."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = {}
        for rows in batches:
            if len(rows):
                yield _pieces(rows, held)
                end = rows["stream"].iloc[-1]
                held = {k: v for k, v in held.items() if k == end}  # other streams are over

    own = tokens.select("stream", "pos", "tok", "last").repartition("stream").sortWithinPartitions("stream", "pos")
    return own.mapInPandas(decode, "stream long, pos long, piece string")


def byte_tokens(docs: DataFrame, name: str, text: str = "text", part: int = 0, parts: int = 1) -> DataFrame:
    """Each byte of a text as a token, or of one of so many parts of it, which may be cut within a character."""
    n = F.octet_length(text)
    cut = lambda k: F.floor((n.cast("long") * k + parts - 1) / parts).cast("int")
    t = docs.select(F.col(name).alias("stream"), n.alias("n"), cut(part).alias("lo"), cut(part + 1).alias("hi"), F.col(text).cast("binary").alias("raw")).where("lo < hi")
    t = t.select("stream", "n", "lo", byte_tokens_of(F.substring("raw", F.col("lo") + 1, F.col("hi") - F.col("lo"))).alias("toks"))
    t = t.select("stream", "n", "lo", F.posexplode("toks").alias("at", "tok")).withColumn("pos", (F.col("lo") + F.col("at")).cast("long"))
    return t.select("stream", "pos", "tok", (F.col("pos") == F.col("n") - 1).alias("last"))
