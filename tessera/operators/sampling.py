"""Next-token distributions: penalties, temperature, top-k, min-p, top-p and draws, over long tables (ctx, tok, logit)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import uniform
from tessera.operators.metrics import softmax


def repetition_penalty(logits: DataFrame, seen: DataFrame, penalty: float) -> DataFrame:
    """Positive logits of seen(ctx, tok) are divided, others multiplied, once for each distinct token."""
    s = seen.select("ctx", "tok").distinct().withColumn("_seen", F.lit(True))
    hit = logits.join(s, ["ctx", "tok"], "left")
    new = F.when(F.col("_seen") & (F.col("logit") > 0), F.col("logit") / penalty).when(F.col("_seen"), F.col("logit") * penalty).otherwise(F.col("logit"))
    return hit.withColumn("logit", new).drop("_seen")


def top_k(logits: DataFrame, k: int) -> DataFrame:
    """The k largest logits of each context; those that tie with the k-th stay."""
    w = Window.partitionBy("ctx").orderBy(F.desc("logit"))
    return logits.withColumn("_r", F.rank().over(w)).where(F.col("_r") <= k).drop("_r")


def _renormed(p: DataFrame) -> DataFrame:
    return p.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy("ctx")))


def min_p(p: DataFrame, share: float) -> DataFrame:
    """Tokens of at least `share` of the likeliest one's probability, summing to 1 again."""
    return _renormed(p.withColumn("_m", F.max("p").over(Window.partitionBy("ctx"))).where(F.col("p") >= F.col("_m") * share).drop("_m"))


def top_p(p: DataFrame, mass: float) -> DataFrame:
    """The likeliest tokens before which no more than `mass` lies, summing to 1 again; outside (0, 1) nothing changes."""
    if not 0 < mass < 1:
        return p
    w = Window.partitionBy("ctx").orderBy(F.desc("p"), "tok").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _renormed(p.withColumn("_c", F.sum("p").over(w)).where(F.col("_c") - F.col("p") <= mass).drop("_c"))


def sampler(logits: DataFrame, temperature: float = 1.0, k: int | None = None, share: float | None = None, mass: float | None = None) -> DataFrame:
    """ctx, tok, p of the whole chain."""
    t = logits.withColumn("logit", F.col("logit") / temperature)
    t = top_k(t, k) if k else t
    p = softmax(t, ["ctx"]).select("ctx", "tok", "p")
    p = min_p(p, share) if share else p
    return top_p(p, mass) if mass is not None else p


def draw(p: DataFrame, seed: str) -> DataFrame:
    """A token of each context by inverse distribution, at a number from the context's hash."""
    w = Window.partitionBy("ctx").orderBy(F.desc("p"), "tok")
    c = p.withColumn("_c", F.sum("p").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_r", F.row_number().over(w))
    u = uniform(F.concat_ws("|", F.col("ctx").cast("string"), F.lit(seed)))
    last = F.max("_r").over(Window.partitionBy("ctx"))
    c = c.withColumn("_last", last).where((F.col("_c") > u) | (F.col("_r") == F.col("_last")))
    return c.groupBy("ctx").agg(F.min_by("tok", "_r").alias("tok"))
