"""Samplers on the next-byte distributions of a bigram model of conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import metrics, sampling
from tessera.plans.base import query, table
from tessera.plans.metrics import ids_of, positions, sequences

_L = """b AS (SELECT list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::INT) AS t, role FROM conversations WHERE text <> ''),
pr AS (SELECT t[i] AS ctx, t[i + 1] AS tok FROM b, unnest(range(1, len(t))) u(i)), l AS (SELECT ctx, tok, ln(count(*)::DOUBLE + 0.5) AS logit FROM pr GROUP BY ctx, tok)"""
_P = "p AS (SELECT ctx, tok, exp(logit - max(logit) OVER (PARTITION BY ctx)) AS e, logit FROM l), q AS (SELECT ctx, tok, e / sum(e) OVER (PARTITION BY ctx) AS p FROM p)"


def _logits(spark, d):
    n = positions(sequences(spark, d)).groupBy(F.col("prev").alias("ctx"), "tok").agg(F.count("*").alias("n"))
    return n.select("ctx", "tok", F.ln(F.col("n") + 0.5).alias("logit"))


def _rounded(df):
    return df.select("ctx", "tok", F.round("p", 9).alias("p"))


@query(f"WITH {_L}, {_P} SELECT ctx, tok, round(p, 9) AS p FROM q")
def softmax(spark, d):
    return _rounded(metrics.softmax(_logits(spark, d), ["ctx"]))


@query(f"WITH {_L} SELECT ctx, tok, round(logit, 9) AS logit FROM (SELECT *, rank() OVER (PARTITION BY ctx ORDER BY logit DESC) AS r FROM l) WHERE r <= 5")
def topk_filter(spark, d):
    return sampling.top_k(_logits(spark, d), 5).select("ctx", "tok", F.round("logit", 9).alias("logit"))


@query(f"WITH {_L}, {_P}, m AS (SELECT *, max(p) OVER (PARTITION BY ctx) AS top FROM q) SELECT ctx, tok, round(p / sum(p) OVER (PARTITION BY ctx), 9) AS p FROM m WHERE p >= top * 0.05::DOUBLE")
def minp_filter(spark, d):
    return _rounded(sampling.min_p(metrics.softmax(_logits(spark, d), ["ctx"]).select("ctx", "tok", "p"), 0.05))


_TOP_P = "SELECT ctx, tok, p / sum(p) OVER (PARTITION BY ctx) AS p FROM (SELECT *, sum(p) OVER (PARTITION BY ctx ORDER BY p DESC, tok ROWS UNBOUNDED PRECEDING) AS c FROM {}) WHERE c - p <= 0.9::DOUBLE"


@query(f"WITH {_L}, {_P} SELECT ctx, tok, round(p, 9) AS p FROM ({_TOP_P.format('q')})")
def top_p_filter(spark, d):
    return _rounded(sampling.top_p(metrics.softmax(_logits(spark, d), ["ctx"]).select("ctx", "tok", "p"), 0.9))


_CHAIN = f"""t AS (SELECT ctx, tok, logit / 0.8::DOUBLE AS logit FROM l), k AS (SELECT *, rank() OVER (PARTITION BY ctx ORDER BY logit DESC) AS r FROM t),
e AS (SELECT ctx, tok, exp(logit - max(logit) OVER (PARTITION BY ctx)) AS e FROM k WHERE r <= 10), s AS (SELECT ctx, tok, e / sum(e) OVER (PARTITION BY ctx) AS p FROM e),
m AS (SELECT *, max(p) OVER (PARTITION BY ctx) AS top FROM s), n AS (SELECT ctx, tok, p / sum(p) OVER (PARTITION BY ctx) AS p FROM m WHERE p >= top * 0.05::DOUBLE), chain AS ({_TOP_P.format('n')})"""


@query(f"WITH {_L}, {_CHAIN} SELECT ctx, tok, round(p, 9) AS p FROM chain")
def sampler_pipeline(spark, d):
    return _rounded(sampling.sampler(_logits(spark, d), 0.8, 10, 0.05, 0.9))


@query(f"""WITH {_L}, {_CHAIN}, c AS (SELECT *, sum(p) OVER (PARTITION BY ctx ORDER BY p DESC, tok ROWS UNBOUNDED PRECEDING) AS c, row_number() OVER (PARTITION BY ctx ORDER BY p DESC, tok) AS r, count(*) OVER (PARTITION BY ctx) AS n FROM chain)
SELECT ctx, arg_min(tok, r) AS tok FROM c WHERE c > ('0x' || substr(md5(ctx || '|7'), 1, 8))::BIGINT / 4294967296.0::DOUBLE OR r = n GROUP BY ctx""")
def sample_inverse_cdf(spark, d):
    return sampling.draw(sampling.sampler(_logits(spark, d), 0.8, 10, 0.05, 0.9), "7")


@query(f"WITH {_L}, s AS (SELECT DISTINCT t[1] AS ctx, unnest(t) AS tok FROM b WHERE role = 'system' OR role = 'user') SELECT ctx, tok, round(CASE WHEN s.tok IS NULL THEN logit WHEN logit > 0 THEN logit / 1.3::DOUBLE ELSE logit * 1.3::DOUBLE END, 9) AS logit FROM l LEFT JOIN s USING (ctx, tok)")
def repetition_penalty(spark, d):
    """A context's seen bytes: those of the user and system turns that begin with it."""
    t = table(spark, d, "conversations").where("text <> '' and role in ('system', 'user')").select(F.expr(ids_of("text")).alias("t"))
    seen = t.select(F.element_at("t", 1).alias("ctx"), F.explode(F.array_distinct("t")).alias("tok"))
    return sampling.repetition_penalty(_logits(spark, d), seen, 1.3).select("ctx", "tok", F.round("logit", 9).alias("logit"))
