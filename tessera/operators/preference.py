"""Preference pairs: candidates, judge prompts and verdicts, swap consistency, win rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the prompt that a judge is asked with.
RUBRIC = """Compare the two completions. Pick the one that is more coherent, has clearer narrative structure, and ends more satisfyingly.

Prompt:
{prompt}

Completion A:
{a}

Completion B:
{b}

Answer with a single letter, A or B. Do not explain."""


#: Fixed value: what the judge is told to be.
SYSTEM = "You are an expert evaluator of short stories for children. Read two completions to the same prompt and decide which is better."


def keep_pair(a: Column, b: Column, least: int = 40, prefix: int = 20, differ: int = 30) -> Column:
    """Whether two completions are worth judging: long enough, not the same, without a long common start; of like
    lengths, the first and last 50 characters must both differ."""
    long = (F.length(a) >= least) & (F.length(b) >= least)
    start = F.left(a, F.lit(prefix)) != F.left(b, F.lit(prefix)) if prefix <= least else None
    if start is None:
        raise ValueError("the common prefix may not be longer than the least length")
    ends = (F.left(a, F.lit(50)) != F.left(b, F.lit(50))) & (F.right(a, F.lit(50)) != F.right(b, F.lit(50)))
    return long & (a != b) & start & ((F.abs(F.length(a) - F.length(b)) >= differ) | ends)


def judge_prompt(prompt: Column, a: Column, b: Column) -> Column:
    head, rest = RUBRIC.split("{prompt}")
    middle, rest = rest.split("{a}")
    between, tail = rest.split("{b}")
    return F.concat(F.lit(head), prompt, F.lit(middle), a, F.lit(between), b, F.lit(tail))


def judge_messages(prompt: Column, a: Column, b: Column) -> Column:
    """The judge's chat: an array of role and content."""
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(SYSTEM).alias("content")), F.struct(F.lit("user").alias("role"), judge_prompt(prompt, a, b).alias("content")))


def verdict(answer: Column) -> Column:
    """The first A or B of an answer, in any case; null if there is none."""
    return F.nullif(F.regexp_extract(F.upper(answer), "[AB]", 0), F.lit(""))


def outcome(first: Column, swapped: Column) -> Column:
    """x or y if both orders name the same completion; invalid if either names none; else flipped."""
    return F.when(first.isNull() | swapped.isNull(), "invalid").when((first == "A") & (swapped == "B"), "x").when((first == "B") & (swapped == "A"), "y").otherwise("flipped")


def swap_join(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """verdicts(keys, swapped, verdict) to a row for each pair with both orders' verdicts and the outcome."""
    one = verdicts.where("not swapped").select(*keys, F.col("verdict").alias("v1"))
    two = verdicts.where("swapped").select(*keys, F.col("verdict").alias("v2"))
    return one.join(two, keys).withColumn("outcome", outcome(F.col("v1"), F.col("v2")))


def model_pairs(models: DataFrame) -> DataFrame:
    """models(ord, model), a few rows, to its pairs x before y."""
    x, y = (models.select(F.col("ord").alias(f"{k}_ord"), F.col("model").alias(k)) for k in "xy")
    return x.join(F.broadcast(y), F.col("x_ord") < F.col("y_ord"))


def matchups(completions: DataFrame) -> DataFrame:
    """completions(prompt_id, ord, model, text) to each prompt's pairs of models."""
    x, y = (completions.select("prompt_id", F.col("ord").alias(f"{k}_ord"), F.col("model").alias(k), F.col("text").alias(f"{k}_text")) for k in "xy")
    return x.join(y, "prompt_id").where("x_ord < y_ord")


def counts(judged: DataFrame) -> DataFrame:
    n = lambda name: F.count_if(F.col("outcome") == name)
    return judged.groupBy("x", "y").agg(n("x").alias("wins_x"), n("y").alias("wins_y"), n("flipped").alias("flipped"), n("invalid").alias("invalid"))


def win_rates(counted: DataFrame, models: list[str]) -> DataFrame:
    """Rows beat columns: wins of all judgements that aren't invalid; null on the diagonal and without judgements."""
    total = F.nullif(F.col("wins_x") + F.col("wins_y") + F.col("flipped"), F.lit(0))
    both = counted.select("x", "y", (F.col("wins_x") / total).alias("rate")).unionByName(counted.select(F.col("y").alias("x"), F.col("x").alias("y"), (F.col("wins_y") / total).alias("rate")))
    return both.groupBy(F.col("x").alias("model")).pivot("y", models).agg(F.first("rate"))


def consistency(counted: DataFrame) -> DataFrame:
    own = F.col("wins_x") + F.col("wins_y")
    return counted.withColumn("consistent", own).where(F.col("consistent") + F.col("flipped") > 0).withColumn("rate", F.col("consistent") / (F.col("consistent") + F.col("flipped"))).select("x", "y", "consistent", "flipped", "rate", (F.col("rate") < 0.7).alias("low_signal"))
