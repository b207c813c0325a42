"""Conversations: training examples with response masks, packing, plain prompts, serving text rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import END, SPECIALS, strip
from tessera.operators import bpe


def turn_text(role: str = "role", text: str = "text") -> Column:
    """A turn with its marks; an unknown role is an error."""
    known = F.col(role).isin("system", "user", "assistant")
    return F.when(known, F.concat(F.lit("<|"), role, F.lit("|>"), text, F.lit(END))).otherwise(F.raise_error(F.concat(F.lit("Unknown role: "), F.coalesce(F.col(role), F.lit("null")))).cast("string"))


def format_examples(turns: DataFrame, merges: list, vocab: DataFrame, max_length: int) -> DataFrame:
    """turns(conv_id, turn, role, text) to conv_id, ids, mask: 1 on what an assistant turn says and on its end mark."""
    docs = turns.select(F.struct("conv_id", "turn", "role").alias("doc_id"), turn_text().alias("text"))
    e = bpe.encoded_arrays(docs, merges, vocab, specials=SPECIALS)
    said = F.col("doc_id.role") == "assistant"  # a turn's first id is its role's mark
    e = e.select(F.col("doc_id.conv_id").alias("conv_id"), F.struct("doc_id.turn", "ids", F.transform("ids", lambda _, k: (said & (k > 0)).cast("int")).alias("mask")).alias("s"))
    e = e.groupBy("conv_id").agg(F.sort_array(F.collect_list("s")).alias("s"))
    ids, mask = F.flatten(F.transform("s", lambda s: s["ids"])), F.flatten(F.transform("s", lambda s: s["mask"]))
    return e.select("conv_id", F.slice(ids, 1, max_length).alias("ids"), F.slice(mask, 1, max_length).alias("mask"))


def pad_and_shift(examples: DataFrame, max_length: int, pad: int) -> DataFrame:
    """ids and mask to inputs, targets one on, the loss mask of the targets and the mask of real inputs, all max_length - 1 long."""
    if max_length < 2:
        raise ValueError("max_length must be 2 at least")
    n = F.least(F.size("ids"), F.lit(max_length))
    n = F.when(n < 2, 0).otherwise(n - 1)

    def filled(c: Column, value) -> Column:
        return F.concat(c, F.array_repeat(value, F.lit(max_length - 1) - n))

    return examples.select(
        "conv_id",
        filled(F.slice("ids", F.lit(1), n), F.lit(pad)).alias("input_ids"),
        filled(F.slice("ids", F.lit(2), n), F.lit(pad)).alias("target_ids"),
        filled(F.transform(F.slice("mask", F.lit(2), n), lambda x: x.cast("double")), F.lit(0.0)).alias("loss_mask"),
        F.concat(F.array_repeat(F.lit(True), n), F.array_repeat(F.lit(False), F.lit(max_length - 1) - n)).alias("attention_mask"),
    )


def parse_blocks(lines: DataFrame, marker: str = "Story:") -> DataFrame:
    """lines(block, line_no, line) to block, prompt, story: what stands before and after the first line led by the marker.

    Blank lines go; the rest of the marker's line leads the story. Sides that are empty are null.
    """
    led = F.startswith(F.regexp_replace("line", r"(?U)^\s+", ""), F.lit(marker))
    at = lines.where(led).groupBy("block").agg(F.min("line_no").alias("at"))
    rows = lines.join(at, "block", "left")
    line = F.when(F.col("line_no") == F.col("at"), strip(F.substring(F.regexp_replace("line", r"(?U)^\s+", ""), len(marker) + 1, 1 << 30))).otherwise(F.col("line"))
    rows = rows.select("block", "line_no", "at", line.alias("line")).withColumn("real", strip("line") != "")

    def side(test: Column) -> Column:
        text = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(test & F.col("real"), F.struct("line_no", "line")))), lambda s: s["line"]), "\n")
        return F.nullif(strip(text), F.lit(""))

    return rows.groupBy("block").agg(side(F.col("line_no") < F.col("at")).alias("prompt"), side(F.col("line_no") >= F.col("at")).alias("story"))


def open_prompt(user: Column) -> Column:
    return F.concat(F.lit("<|user|>"), user, F.lit(END + "<|assistant|>"))


def plain_chat(turns: DataFrame) -> DataFrame:
    """conv_id and its turns as one prompt that ends with an open 'Assistant:'."""
    said = F.when(F.col("role") == "system", strip("text")).when(F.col("role") == "user", F.concat(F.lit("User: "), strip("text"))).when(F.col("role") == "assistant", F.concat(F.lit("Assistant: "), strip("text")))
    t = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", said.alias("said")))).alias("s"))
    return t.select("conv_id", F.concat_ws("\n", F.transform("s", lambda s: s["said"]), F.lit("Assistant:")).alias("prompt"))


def request_settings(requests: DataFrame) -> DataFrame:
    """Sampling settings as a sampler takes them: absent, zero and negative limits are none."""
    add = F.greatest(F.coalesce("presence_penalty", F.lit(0.0)), F.coalesce("frequency_penalty", F.lit(0.0)), F.lit(0.0))
    return requests.select(
        "request_id", F.coalesce("temperature", F.lit(1.0)).alias("temperature"), "top_p",
        F.when(F.col("top_k") > 0, F.col("top_k")).alias("top_k"), F.when(F.col("min_p") > 0, F.col("min_p")).alias("min_p"), (1 + add).alias("repetition_penalty"),
    )


def last_ids(ids: Column, most: int, blank: int) -> Column:
    """The last `most` ids; an empty prompt is one blank."""
    ids = F.when(F.size(ids) == 0, F.array(F.lit(blank))).otherwise(ids)
    return F.slice(ids, F.greatest(F.lit(1), F.size(ids) - most + 1), F.lit(most))


def strip_end(ids: Column, end: int) -> Column:
    """Without one end id at the end."""
    return F.when(F.get(ids, F.size(ids) - 1) == end, F.slice(ids, F.lit(1), F.size(ids) - 1)).otherwise(ids)


def rolled_context(turns: DataFrame, most: int) -> DataFrame:
    """turns(conv_id, turn, ids) with the last `most` ids of all turns so far.

    A window gathers only the last `most` turns that have ids, and the last `most` ids of each, so its size doesn't
    depend on the conversation's.
    """
    so_far = Window.partitionBy("conv_id").orderBy("turn")
    t = turns.withColumn("_n", F.count(F.when(F.size("ids") > 0, 1)).over(so_far))
    tail = F.when(F.size("ids") > 0, F.struct("turn", F.slice("ids", F.greatest(F.lit(1), F.size("ids") - most + 1), F.lit(most)).alias("ids")))
    near = F.collect_list(tail).over(Window.partitionBy("conv_id").orderBy("_n").rangeBetween(1 - most, 0))
    ids = F.flatten(F.transform(F.sort_array(near), lambda s: s["ids"]))
    return t.withColumn("ids", ids).withColumn("ids", F.slice("ids", F.greatest(F.lit(1), F.size("ids") - most + 1), F.lit(most))).drop("_n")


def strip_artifacts(text: Column, prefix: Column) -> Column:
    rest = F.when(F.startswith(text, prefix), F.expr("1").cast("int")).otherwise(F.lit(0))
    rest = F.when(rest == 1, F.substring(text, F.length(prefix) + 1, F.length(text))).otherwise(text)
    return strip(F.substring_index(rest, END, 1))
