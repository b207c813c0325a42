"""Preference data and pairwise evaluation, judged by a stand-in: verdicts from the MD5 of a pair and its order."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import preference as pref
from tessera.plans.base import query, table

MODELS = ["base", "sft", "dpo"]

# each assistant turn is a prompt's completion by three models: as it is, its last 60 characters first, and upside down
_COMPLETIONS = """c AS (SELECT conv_id * 100 + turn AS prompt_id, 0 AS ord, 'base' AS model, text FROM conversations WHERE role = 'assistant'
UNION ALL SELECT conv_id * 100 + turn, 1, 'sft', right(text, 60) || text FROM conversations WHERE role = 'assistant'
UNION ALL SELECT conv_id * 100 + turn, 2, 'dpo', reverse(text) FROM conversations WHERE role = 'assistant')"""
_PAIRS = f"{_COMPLETIONS}, p AS (SELECT a.prompt_id, a.ord AS x_ord, a.model AS x, a.text AS x_text, b.ord AS y_ord, b.model AS y, b.text AS y_text FROM c a JOIN c b USING (prompt_id) WHERE a.ord < b.ord)"


def _answer(swapped: str) -> str:
    h = f"md5(prompt_id || x || y || '{swapped}')"
    return f"CASE WHEN substr({h}, 1, 1) IN ('0', '1') THEN 'neither' WHEN substr({h}, 1, 1) < '8' THEN ' a.' ELSE 'B is' END"


_JUDGED = f"""{_PAIRS}, v AS (SELECT prompt_id, x, y, nullif(regexp_extract(upper({_answer('0')}), '[AB]'), '') AS v1, nullif(regexp_extract(upper({_answer('1')}), '[AB]'), '') AS v2 FROM p),
j AS (SELECT *, CASE WHEN v1 IS NULL OR v2 IS NULL THEN 'invalid' WHEN v1 = 'A' AND v2 = 'B' THEN 'x' WHEN v1 = 'B' AND v2 = 'A' THEN 'y' ELSE 'flipped' END AS outcome FROM v),
n AS (SELECT x, y, count_if(outcome = 'x')::BIGINT AS wins_x, count_if(outcome = 'y')::BIGINT AS wins_y, count_if(outcome = 'flipped')::BIGINT AS flipped, count_if(outcome = 'invalid')::BIGINT AS invalid FROM j GROUP BY x, y)"""


def _completions(spark, d):
    t = table(spark, d, "conversations").where("role = 'assistant'").withColumn("prompt_id", F.col("conv_id") * 100 + F.col("turn"))
    texts = [F.col("text"), F.concat(F.right("text", F.lit(60)), "text"), F.reverse("text")]
    each = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(m).alias("model"), x.alias("text")) for k, (m, x) in enumerate(zip(MODELS, texts, strict=True))])
    return t.select("prompt_id", F.explode(each).alias("c")).select("prompt_id", "c.*")


def _verdicts(spark, d):
    p = pref.matchups(_completions(spark, d)).select("prompt_id", "x", "y", F.explode(F.array(F.lit(False), F.lit(True))).alias("swapped"))
    h = F.substring(F.md5(F.concat("prompt_id", "x", "y", F.col("swapped").cast("int").cast("string"))), 1, 1)
    answer = F.when(h.isin("0", "1"), "neither").when(h < "8", " a.").otherwise("B is")
    return p.withColumn("verdict", pref.verdict(answer))


def _judged(spark, d):
    return pref.swap_join(_verdicts(spark, d), ["prompt_id", "x", "y"])


def _counts(spark, d):
    return pref.counts(_judged(spark, d))


@query(f"WITH {_PAIRS} SELECT prompt_id, x, y, x_text, y_text FROM p")
def pairwise_matchups(spark, d):
    return pref.matchups(_completions(spark, d)).select("prompt_id", "x", "y", "x_text", "y_text")


@query("WITH m AS (SELECT DISTINCT source AS model FROM documents) SELECT a.model AS x, b.model AS y FROM m a JOIN m b ON a.model < b.model")
def model_pairs(spark, d):
    """Sources as models: each pair once, in the order of their names."""
    models = table(spark, d, "documents").select(F.col("source").alias("ord"), F.col("source").alias("model")).distinct()
    return pref.model_pairs(models).select("x", "y")


@query(f"WITH {_PAIRS} SELECT prompt_id, x, y, length(x_text) >= 40 AND length(y_text) >= 40 AND x_text <> y_text AND left(x_text, 20) <> left(y_text, 20) AND (abs(length(x_text) - length(y_text)) >= 30 OR (left(x_text, 50) <> left(y_text, 50) AND right(x_text, 50) <> right(y_text, 50))) AS keep FROM p")
def pref_heuristic(spark, d):
    return pref.matchups(_completions(spark, d)).select("prompt_id", "x", "y", pref.keep_pair(F.col("x_text"), F.col("y_text")).alias("keep"))


@query(f"WITH {_PAIRS} SELECT prompt_id, x, y, replace(replace(replace('{pref.RUBRIC}', '{{prompt}}', 'p' || prompt_id), '{{a}}', x_text), '{{b}}', y_text) AS prompt FROM p")
def judge_prompt(spark, d):
    m = pref.matchups(_completions(spark, d))
    return m.select("prompt_id", "x", "y", pref.judge_prompt(F.concat(F.lit("p"), "prompt_id"), F.col("x_text"), F.col("y_text")).alias("prompt"))


@query(f"WITH {_PAIRS} SELECT prompt_id, x, y, 'system' AS role, '{pref.SYSTEM}' AS content FROM p UNION ALL SELECT prompt_id, x, y, 'user', replace(replace(replace('{pref.RUBRIC}', '{{prompt}}', 'p' || prompt_id), '{{a}}', x_text), '{{b}}', y_text) FROM p")
def judge_messages(spark, d):
    m = pref.matchups(_completions(spark, d))
    return m.select("prompt_id", "x", "y", F.inline(pref.judge_messages(F.concat(F.lit("p"), "prompt_id"), F.col("x_text"), F.col("y_text"))))


@query("SELECT conv_id, turn, nullif(regexp_extract(upper(text), '[AB]'), '') AS verdict FROM conversations")
def judge_parse(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", pref.verdict(F.col("text")).alias("verdict"))


@query(f"WITH {_JUDGED} SELECT prompt_id, x, y, v1, v2 FROM j")
def swap_join(spark, d):
    return _judged(spark, d).select("prompt_id", "x", "y", "v1", "v2")


@query(f"WITH {_JUDGED} SELECT prompt_id, x, y, outcome, CASE outcome WHEN 'x' THEN x_text WHEN 'y' THEN y_text END AS chosen, CASE outcome WHEN 'x' THEN y_text WHEN 'y' THEN x_text END AS rejected FROM j JOIN p USING (prompt_id, x, y)")
def swap_consistency(spark, d):
    t = _judged(spark, d).join(pref.matchups(_completions(spark, d)), ["prompt_id", "x", "y"])
    chosen = F.when(F.col("outcome") == "x", F.col("x_text")).when(F.col("outcome") == "y", F.col("y_text"))
    rejected = F.when(F.col("outcome") == "x", F.col("y_text")).when(F.col("outcome") == "y", F.col("x_text"))
    return t.select("prompt_id", "x", "y", "outcome", chosen.alias("chosen"), rejected.alias("rejected"))


@query(f"WITH {_JUDGED} SELECT * FROM n")
def judge_counts(spark, d):
    return _counts(spark, d)


_BOTH = "b AS (SELECT x, y, wins_x / nullif(wins_x + wins_y + flipped, 0) AS r FROM n UNION ALL SELECT y, x, wins_y / nullif(wins_x + wins_y + flipped, 0) FROM n)"


@query(f"WITH {_JUDGED}, {_BOTH} SELECT x AS model, round(max(r) FILTER (y = 'base'), 6) AS base, round(max(r) FILTER (y = 'sft'), 6) AS sft, round(max(r) FILTER (y = 'dpo'), 6) AS dpo FROM b GROUP BY x")
def win_rate_matrix(spark, d):
    return pref.win_rates(_counts(spark, d), MODELS).select("model", *[F.round(m, 6).alias(m) for m in MODELS])


@query(f"WITH {_JUDGED} SELECT x, y, wins_x + wins_y AS consistent, flipped, round((wins_x + wins_y) / (wins_x + wins_y + flipped), 6) AS rate, (wins_x + wins_y) / (wins_x + wins_y + flipped) < 0.7::DOUBLE AS low_signal FROM n WHERE wins_x + wins_y + flipped > 0")
def swap_consistency_rate(spark, d):
    return pref.consistency(_counts(spark, d)).withColumn("rate", F.round("rate", 6))


@query(f"""WITH {_JUDGED} SELECT x || ' vs ' || y AS pair, '| ' || x || ' vs ' || y || ' | ' || (wins_x + wins_y) || ' | ' || flipped || ' | ' || printf('%.1f', 100.0::DOUBLE * (wins_x + wins_y) / (wins_x + wins_y + flipped)) || '%' || CASE WHEN (wins_x + wins_y) / (wins_x + wins_y + flipped) < 0.7::DOUBLE THEN ' (low signal)' ELSE '' END || ' |' AS line FROM n""")
def eval_report_lines(spark, d):
    """The rows of the report's consistency table."""
    c = pref.consistency(_counts(spark, d))
    return c.select(F.concat_ws(" vs ", "x", "y").alias("pair"), F.format_string("| %s vs %s | %d | %d | %.1f%%%s |", "x", "y", "consistent", "flipped", F.col("rate") * 100, F.when(F.col("low_signal"), F.lit(" (low signal)")).otherwise(F.lit(""))).alias("line"))


@query(f"""WITH {_JUDGED}, w AS (SELECT x || '>' || y AS k, wins_x AS v FROM n UNION ALL SELECT y || '>' || x, wins_y FROM n) SELECT '{{' || string_agg('"' || k || '":' || v, ',' ORDER BY k) || '}}' AS win_counts FROM w""")
def eval_raw_json(spark, d):
    n = _counts(spark, d)
    w = n.select(F.concat_ws(">", "x", "y").alias("k"), F.col("wins_x").alias("v")).unionByName(n.select(F.concat_ws(">", "y", "x").alias("k"), F.col("wins_y").alias("v")))
    return w.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v"))))).alias("win_counts"))
