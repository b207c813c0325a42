"""Autoregressive generation for all prompts side by side: each step is a join with the model's table of next ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import uniform


def bigram_counts(ids: DataFrame) -> DataFrame:
    """ids(ids) to prev, tok, n."""
    pairs = F.arrays_zip(F.expr("slice(ids, 1, size(ids) - 1)").alias("prev"), F.expr("slice(ids, 2, size(ids) - 1)").alias("tok"))
    return ids.where(F.size("ids") > 1).select(F.explode(pairs).alias("p")).groupBy("p.prev", "p.tok").agg(F.count("*").alias("n"))


def next_ids(counts: DataFrame, k: int, temperature: float) -> DataFrame:
    """prev and `choices`: its k most frequent next ids (of equals the smallest), with the running sum of their shares of n ** (1 / temperature).

    Greedy generation is k = 1. A row for each id of the vocabulary at most.
    """
    order = Window.partitionBy("prev").orderBy(F.desc("n"), "tok")
    top = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).withColumn("w", F.pow(F.col("n").cast("double"), F.lit(1.0 / temperature)))
    by = Window.partitionBy("prev")
    top = top.withColumn("until", F.sum("w").over(by.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("w").over(by.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return top.groupBy("prev").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "until", "tok"))), lambda c: F.struct(c["until"], c["tok"])).alias("choices"))


def generate(prompts: DataFrame, choices: DataFrame, steps: int, stop: int, seed: str) -> DataFrame:
    """prompts(seq, last) with `ids`: up to `steps` ids, the last of them `stop` if that came up, or none where nothing follows.

    The choice of a step is drawn by the hash of seed, seq and step, so a lost task's rows come out the same again.
    """
    table = F.broadcast(choices)  # the vocabulary's size
    now = prompts.select("seq", "last", F.expr("cast(array() as array<int>)").alias("ids"))
    for step in range(steps):
        u, so_far = uniform(F.concat_ws("|", F.lit(seed), "seq", F.lit(step))), F.try_element_at("ids", F.lit(-1))
        now = now.withColumn("prev", F.when((F.size("ids") == step) & (so_far != stop), so_far) if step else F.col("last"))
        picked = F.coalesce(F.try_element_at(F.filter("choices", lambda c: c["until"] > u), F.lit(1))["tok"], F.try_element_at("choices", F.lit(-1))["tok"])  # the last one, should rounding leave its sum below 1
        now = now.join(table, "prev", "left").select("seq", "last", F.when(F.col("choices").isNotNull(), F.concat("ids", F.array(picked.cast("int")))).otherwise(F.col("ids")).alias("ids"))
    return now.select("seq", "ids")


def pieces(generated: DataFrame, stop: int, steps: int) -> DataFrame:
    """A row for each id as it comes: seq, step, id, and on the last row why it is the last."""
    last = F.col("step") == F.size("ids") - 1
    why = F.when(F.try_element_at("ids", F.lit(-1)) == stop, "stop").when(F.size("ids") == steps, "length").otherwise("end")
    rows = generated.select("seq", "ids", F.posexplode("ids").alias("step", "id"))
    return rows.select("seq", F.col("step").cast("long").alias("step"), "id", F.when(last, why).alias("finish"))
