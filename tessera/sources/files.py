"""Readers and writers of the file forms of a language-model project, and the row forms they share."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import uniform
from tessera.operators import ordering
from tessera.sources.scratch import small_batches


def read_text_documents(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """A file of documents between separators, as rows of text."""
    return spark.read.option("lineSep", separator).text(path).select(F.col("value").alias("text"))


def read_split_documents(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """Documents of a file, or of a folder of files, with their place: file, block, nth, text.

    Spark cuts a file into byte ranges; a range's task moves on to its first separator and reads on to the one behind its end, so
    one huge file is many partitions and each document comes once. file, block and nth are in the order of the files' bytes.
    """
    rows = spark.read.option("lineSep", separator).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"), F.col("value").alias("text"))


def chunk_starts(documents: DataFrame, separator: str, chunks: int) -> DataFrame:
    """chunk, at: bytes at which a corpus of read_split_documents() may be cut into about so many chunks, each but the first at a separator.

    As many of all cuts (0, the separators, the end) as there are, if that is at most chunks + 1; else every so many-th one and the end.
    """
    size = F.octet_length("text") + len(separator.encode())
    own = ordering.running_totals(documents.select("file", "block", "nth", size.alias("size")), ["file", "block", "nth"], {"at": F.col("size"), "k": F.lit(1)})
    cuts = own.select((F.col("k") + 1).alias("k"), (F.col("at") + F.col("size") - len(separator.encode())).alias("at"))  # the separator behind each document
    n, end = own.agg(F.count("*"), F.coalesce(F.max(F.col("at") + F.col("size")), F.lit(0))).first()
    step = 1 if n + 2 <= chunks + 1 else max(1, (n + 1) // chunks)
    most = n + 1 if n + 2 <= chunks + 1 else chunks
    ends = documents.sparkSession.createDataFrame([(0, 0), (n + 1, end)], "k long, at long")
    cuts = cuts.unionByName(ends).where((F.col("k") % step == 0) & (F.col("k") < most * step) | (F.col("k") == n + 1))
    return cuts.select(F.when(F.col("k") == n + 1, most).otherwise(F.floor(F.col("k") / step)).cast("long").alias("chunk"), "at")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return json_rows(spark.read.text(path), "value", schema)


def json_rows(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """JSON lines to columns; blank lines are skipped."""
    return rows.where(F.trim(column) != "").select(F.from_json(column, schema).alias("j")).select("j.*")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("append").text(path)


#: Bytes of payloads, or of lists, that a task parses or makes at a time.
PAYLOADS = 1 << 22


def _parts(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows of PAYLOADS bytes, or of one row that has more."""
    lengths = batch.column(column)
    size = pc.fill_null(pc.binary_length(lengths) if pa.types.is_binary(lengths.type) else pc.multiply(pc.list_value_length(lengths), 8), 0)
    group = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64)) // PAYLOADS
    cut = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(batch)] if len(batch) else [0]
    for a, z in zip(cut[:-1], cut[1:], strict=True):
        yield batch.slice(a, z - a)


def parse_npy(df: DataFrame, column: str = "content") -> DataFrame:
    """df with `ids`, the whole numbers of a .npy payload."""
    small_batches(df.sparkSession)
    names = [c for c in df.columns if c != column]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, column):
                ids = [np.load(io.BytesIO(x.as_py())) for x in part.column(column)]
                offs = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(ids).astype(np.int64)))], names=[*names, "ids"])

    schema = T.StructType([*[df.schema[c] for c in names], T.StructField("ids", T.ArrayType(T.LongType()))])
    return df.mapInArrow(parse, schema)


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """path and ids of each .npy file."""
    return parse_npy(spark.read.format("binaryFile").load(path).select("path", "content"))


def npy_payloads(df: DataFrame, column: str = "ids", name: str = "content") -> DataFrame:
    """df with `name`, a .npy payload of 16-bit numbers, in place of the whole numbers of `column`.

    A number outside 0 to 65,535 is an error; null and empty lists are payloads without numbers.
    """
    small_batches(df.sparkSession)
    names = [c for c in df.columns if c != column]

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in _parts(batch, column)):
            out = []
            for ids in part.column(column):
                numbers = ids.values.to_numpy(zero_copy_only=False) if ids.is_valid else np.zeros(0, np.int64)
                if len(numbers) and not 0 <= numbers.min() <= numbers.max() < 1 << 16:
                    raise ValueError("an id does not fit 16 bits")
                f = io.BytesIO()
                np.save(f, numbers.astype(np.uint16))
                out.append(f.getvalue())
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(out, pa.binary())], names=[*names, name])

    return df.mapInArrow(save, T.StructType([*[df.schema[c] for c in names], T.StructField(name, T.BinaryType())]))


def write_npy(df: DataFrame, path: str) -> None:
    """Rows with `ids` as Parquet rows of .npy payloads; `parse_npy` reads them."""
    npy_payloads(df).write.mode("errorifexists").parquet(path)


def text_chunks(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, chunk, text: texts in runs of `size` characters, whose edges may fall within words; null and empty texts have none."""
    return docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))).alias("chunk", "text"))


def synthetic_tokens(rows: DataFrame, vocab: int, seed: str) -> DataFrame:
    """rows(seq, length) as seq and `length` ids below `vocab` each, from the hash of seed, row and place."""
    place = F.transform(F.sequence(F.lit(1), "length"), lambda i: F.floor(uniform(F.concat_ws("|", F.lit(seed), F.col("seq").cast("string"), (i - 1).cast("string"))) * vocab).cast("int"))
    return rows.select("seq", F.when(F.col("length") > 0, place).otherwise(F.expr("cast(array() as array<int>)")).alias("ids"))


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, line; null text is one empty line."""
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))


def line_blocks(rows: DataFrame, separator: Column) -> DataFrame:
    """Lines that are no separators, with the number of separators before them in their document."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    rows = rows.withColumn("_sep", separator).withColumn("block", F.sum(F.when(F.col("_sep"), 1).otherwise(0)).over(w))
    return rows.where(~F.col("_sep")).drop("_sep")


def corpus_blocks(rows: DataFrame, separator: Column) -> DataFrame:
    """rows(doc_id, line_no, line): lines that are no separators, with the number of separators before them in the whole table.

    A block goes on from one document to the next. Separators are added up by ranges, so no window holds the table.
    """
    rows = ordering.running_totals(rows.withColumn("_sep", separator), ["doc_id", "line_no"], {"block": F.col("_sep").cast("long")})
    return rows.where(~F.col("_sep")).drop("_sep")


def vocab_json(vocab: DataFrame) -> DataFrame:
    """One row: the vocabulary as a JSON object of id to hex."""
    pairs = F.transform(F.sort_array(F.collect_list(F.struct("id", F.lower("tok").alias("tok")))), lambda s: F.struct(s["id"].cast("string").alias("k"), s["tok"]))
    return vocab.agg(F.to_json(F.map_from_entries(pairs)).alias("json"))


def vocab_from_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode(F.from_json("json", "map<string,string>")).alias("k", "v")).select(F.col("k").cast("int").alias("id"), F.upper("v").alias("tok"))


def merges_text(merges: DataFrame) -> DataFrame:
    """One row: merges(rank, a, b) as lines of two hex words under a comment."""
    lines_ = F.transform(F.sort_array(F.collect_list(F.struct("rank", F.lower("a").alias("a"), F.lower("b").alias("b")))), lambda s: F.concat_ws(" ", s["a"], s["b"]))
    return merges.agg(F.concat(F.lit("# BPE merges\n"), F.array_join(lines_, "\n"), F.lit("\n")).alias("text"))


def merges_from_text(rows: DataFrame) -> DataFrame:
    """rank, a, b of the lines; blank lines and comments are skipped."""
    t = rows.select(F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~F.startswith(x, F.lit("#"))).alias("l"))
    t = t.select(F.posexplode("l").alias("rank", "line")).select("rank", F.split("line", " ").alias("p"))
    return t.select("rank", F.upper(F.col("p")[0]).alias("a"), F.upper(F.col("p")[1]).alias("b"))


def append_csv_log(df: DataFrame, path: str) -> None:
    """Appends rows to a log of CSV files with headers."""
    df.write.mode("append").option("header", True).csv(path)


def read_csv_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_packed(df: DataFrame, path: str) -> None:
    """Packed examples, partitioned by split."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def write_checkpoint(params: DataFrame, path: str, step: int) -> None:
    """params(name, shape, values) as an immutable generation of its own."""
    params.write.mode("errorifexists").parquet(f"{path}/step_{step:06d}")


def read_checkpoint(spark: SparkSession, path: str, step: int) -> DataFrame:
    return spark.read.parquet(f"{path}/step_{step:06d}")
