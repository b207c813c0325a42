"""Losses and likelihoods over tables of logits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import log_sigmoid


def softmax(df: DataFrame, by: list[str], logit: str = "logit", name: str = "p") -> DataFrame:
    """df with exp(logit - largest) over its sum, within `by`."""
    w = Window.partitionBy(*by)
    e = df.withColumn("_e", F.exp(F.col(logit) - F.max(logit).over(w)))
    return e.withColumn(name, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def log_softmax(df: DataFrame, by: list[str], logit: str = "logit", name: str = "logp") -> DataFrame:
    w = Window.partitionBy(*by)
    e = df.withColumn("_s", F.col(logit) - F.max(logit).over(w))
    return e.withColumn(name, F.col("_s") - F.ln(F.sum(F.exp("_s")).over(w))).drop("_s")


def cross_entropy(nll: DataFrame) -> DataFrame:
    return nll.agg(F.avg("nll").alias("loss"))


def masked_mean(value: Column, mask: Column) -> Column:
    """Sum over the mask by its size, 1 at least: no selected place gives 0."""
    return F.coalesce(F.sum(value * mask), F.lit(0.0)) / F.greatest(F.coalesce(F.sum(mask), F.lit(0.0)), F.lit(1.0))


def bits_per_char(total: Column, n_ids: Column, n_chars: Column) -> Column:
    """Summed losses as bits for each character; NaN below two ids, of which none is predicted."""
    return F.when((n_ids < 2) | (n_chars < 1), F.lit(float("nan"))).otherwise(total / F.nullif(n_chars, F.lit(0)) / F.ln(F.lit(2.0)))


def capped_perplexity(loss: Column) -> Column:
    return F.exp(F.least(loss, F.lit(20.0)))


def sequence_log_probs(nll: DataFrame) -> DataFrame:
    return nll.groupBy("seq").agg(F.sum(-F.col("nll") * F.col("mask")).alias("logp"))


def dpo(pairs: DataFrame, beta: float) -> DataFrame:
    """pairs(policy_chosen, policy_rejected, ref_chosen, ref_rejected): the loss and what it is watched by."""
    chosen, rejected = F.col("policy_chosen") - F.col("ref_chosen"), F.col("policy_rejected") - F.col("ref_rejected")
    margin = beta * (chosen - rejected)
    return pairs.agg(
        F.avg(-log_sigmoid(margin)).alias("loss"), F.avg(beta * chosen).alias("chosen_reward"), F.avg(beta * rejected).alias("rejected_reward"), F.avg(margin).alias("reward_margin"),
        F.avg(F.when(margin > 0, 1.0).otherwise(0.0)).alias("accuracy"), F.avg("policy_chosen").alias("policy_chosen_logp"), F.avg("policy_rejected").alias("policy_rejected_logp"),
    )


def windowed_perplexity(nll: DataFrame, size: int) -> DataFrame:
    """The mean of the windows' means, its exponential (of 20 at most) and its bits."""
    means = nll.groupBy("seq", F.floor(F.col("pos") / size).alias("w")).agg(F.avg("nll").alias("m"))
    return means.agg(F.avg("m").alias("loss")).select("loss", capped_perplexity(F.col("loss")).alias("perplexity"), (F.col("loss") / F.ln(F.lit(2.0))).alias("bits_per_token"))
