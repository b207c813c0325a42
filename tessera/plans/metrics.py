"""Losses of a bigram model over bytes of conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.text import cosine_schedule, log_sigmoid
from tessera.operators import metrics
from tessera.plans.base import query, table

_IDS = "list_transform(regexp_extract_all(hex(encode({})), '..'), lambda x: ('0x' || x)::INT)"


def _sql_model(alpha: str, name: str) -> str:
    return f"""{name} AS (SELECT prev, tok, l - m - ln(sum(exp(l - m)) OVER (PARTITION BY prev)) AS logp FROM (SELECT prev, tok, l, max(l) OVER (PARTITION BY prev) AS m FROM (
    SELECT a.id AS prev, b.id AS tok, ln(coalesce(n, 0) + {alpha}::DOUBLE) AS l FROM ids a CROSS JOIN ids b LEFT JOIN counts c ON c.prev = a.id AND c.tok = b.id)))"""


_SEQ = f"""seqs AS (SELECT conv_id * 100 + turn AS seq, role, text, {_IDS.format('text')} AS t FROM conversations WHERE text <> ''),
pos AS (SELECT seq, (i - 1)::BIGINT AS pos, t[i] AS prev, t[i + 1] AS tok, CASE WHEN role = 'assistant' THEN 1.0 ELSE 0.0 END::DOUBLE AS mask FROM seqs, unnest(range(1, len(t))) u(i)),
ids AS (SELECT DISTINCT unnest(t) AS id FROM seqs), counts AS (SELECT prev, tok, count(*) AS n FROM pos GROUP BY prev, tok), {_sql_model('0.5', 'model')}, {_sql_model('2.0', 'ref')},
nll AS (SELECT seq, pos, mask, -logp AS nll FROM pos JOIN model USING (prev, tok))"""


def ids_of(text: str) -> str:
    return f"transform(filter(split(regexp_replace(hex(encode({text}, 'UTF-8')), '(..)', '$1,'), ','), x -> x <> ''), x -> cast(conv(x, 16, 10) as int))"


def positions(seqs):
    """seqs(seq, mask, text) to seq, pos, prev, tok, mask."""
    t = seqs.select("seq", "mask", F.expr(ids_of("text")).alias("t")).where("size(t) > 1")
    pairs = F.arrays_zip(F.expr("slice(t, 1, size(t) - 1)").alias("prev"), F.expr("slice(t, 2, size(t) - 1)").alias("tok"))
    return t.select("seq", "mask", F.posexplode(pairs).alias("pos", "p")).select("seq", F.col("pos").cast("long").alias("pos"), "p.prev", "p.tok", "mask")


def sequences(spark, d):
    t = table(spark, d, "conversations").where("text <> ''")
    return t.select((F.col("conv_id") * 100 + F.col("turn")).alias("seq"), F.when(F.col("role") == "assistant", 1.0).otherwise(0.0).alias("mask"), "text")


def model(spark, d, alpha: float):
    """prev, tok, logit for all bytes seen: at most 256 * 256 rows."""
    seqs = sequences(spark, d)
    ids = seqs.select(F.explode(F.expr(ids_of("text"))).alias("id")).distinct()
    n = positions(seqs).groupBy("prev", "tok").agg(F.count("*").alias("n"))
    grid = ids.select(F.col("id").alias("prev")).crossJoin(F.broadcast(ids.select(F.col("id").alias("tok"))))  # 256 bytes at most
    return grid.join(n, ["prev", "tok"], "left").select("prev", "tok", F.ln(F.coalesce("n", F.lit(0)) + alpha).alias("logit"))


def losses(spark, d, alpha: float = 0.5, seqs=None):
    table_ = metrics.log_softmax(model(spark, d, alpha), ["prev"])
    seqs = sequences(spark, d) if seqs is None else seqs
    return positions(seqs).join(F.broadcast(table_.select("prev", "tok", "logp")), ["prev", "tok"]).select("seq", "pos", "mask", (-F.col("logp")).alias("nll"))


@query(f"WITH {_SEQ} SELECT round(avg(nll), 6) AS loss FROM nll")
def cross_entropy(spark, d):
    return metrics.cross_entropy(losses(spark, d)).select(F.round("loss", 6).alias("loss"))


@query(f"WITH {_SEQ} SELECT round(sum(nll * mask) / greatest(sum(mask), 1), 6) AS loss FROM nll")
def masked_cross_entropy(spark, d):
    return losses(spark, d).agg(F.round(metrics.masked_mean(F.col("nll"), F.col("mask")), 6).alias("loss"))


@query(f"WITH {_SEQ} SELECT seq, round(sum(-nll * mask), 6) + 0.0 AS logp FROM nll GROUP BY seq")
def sequence_log_probs(spark, d):
    return metrics.sequence_log_probs(losses(spark, d)).select("seq", (F.round("logp", 6) + 0.0).alias("logp"))


_SIDES = f"""side AS (SELECT conv_id * 100 + turn AS seq, 'chosen' AS side, {_IDS.format('text')} AS t FROM conversations WHERE role = 'assistant' AND text <> '' UNION ALL SELECT conv_id * 100 + turn, 'rejected', list_reverse({_IDS.format('text')}) FROM conversations WHERE role = 'assistant' AND text <> ''),
sp AS (SELECT seq, side, t[i] AS prev, t[i + 1] AS tok FROM side, unnest(range(1, len(t))) u(i)),
lp AS (SELECT seq, sum(m.logp) FILTER (side = 'chosen') AS pc, sum(m.logp) FILTER (side = 'rejected') AS pr, sum(r.logp) FILTER (side = 'chosen') AS rc, sum(r.logp) FILTER (side = 'rejected') AS rr FROM sp JOIN model m USING (prev, tok) JOIN ref r USING (prev, tok) GROUP BY seq),
g AS (SELECT *, 0.1::DOUBLE * ((pc - rc) - (pr - rr)) AS margin FROM lp)"""


@query(f"""WITH {_SEQ}, {_SIDES} SELECT round(avg(CASE WHEN margin >= 0 THEN ln(1 + exp(-margin)) ELSE ln(1 + exp(margin)) - margin END), 6) AS loss, round(avg(0.1::DOUBLE * (pc - rc)), 6) AS chosen_reward, round(avg(0.1::DOUBLE * (pr - rr)), 6) AS rejected_reward,
round(avg(margin), 6) AS reward_margin, round(avg(CASE WHEN margin > 0 THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS accuracy, round(avg(pc), 5) AS policy_chosen_logp, round(avg(pr), 5) AS policy_rejected_logp FROM g""")
def dpo_loss(spark, d):
    """Answers against the same bytes backwards; the policy and its reference smooth differently."""
    t = table(spark, d, "conversations").where("role = 'assistant' and text <> ''").select((F.col("conv_id") * 100 + F.col("turn")).alias("seq"), F.expr(ids_of("text")).alias("t"))
    sides = t.select("seq", F.explode(F.array(F.struct(F.lit("chosen").alias("side"), F.col("t").alias("t")), F.struct(F.lit("rejected").alias("side"), F.reverse("t").alias("t")))).alias("s")).select("seq", "s.*").where("size(t) > 1")
    pairs = F.arrays_zip(F.expr("slice(t, 1, size(t) - 1)").alias("prev"), F.expr("slice(t, 2, size(t) - 1)").alias("tok"))
    pos = sides.select("seq", "side", F.explode(pairs).alias("p")).select("seq", "side", "p.*")
    for name, alpha in (("policy", 0.5), ("ref", 2.0)):
        m = metrics.log_softmax(model(spark, d, alpha), ["prev"]).select("prev", "tok", F.col("logp").alias(name))
        pos = pos.join(F.broadcast(m), ["prev", "tok"])
    sums = [F.sum(F.when(F.col("side") == s, F.col(m))).alias(f"{m}_{s}") for m in ("policy", "ref") for s in ("chosen", "rejected")]
    out = metrics.dpo(pos.groupBy("seq").agg(*sums), 0.1)
    return out.select(*[F.round(c, 5 if c.endswith("logp") else 6).alias(c) for c in out.columns])


@query(f"WITH {_SEQ}, w AS (SELECT seq, pos // 64 AS w, avg(nll) AS m FROM nll GROUP BY ALL) SELECT round(avg(m), 6) AS loss, round(exp(least(avg(m), 20)), 5) AS perplexity, round(avg(m) / ln(2), 6) AS bits_per_token FROM w")
def perplexity(spark, d):
    return metrics.windowed_perplexity(losses(spark, d), 64).select(F.round("loss", 6).alias("loss"), F.round("perplexity", 5).alias("perplexity"), F.round("bits_per_token", 6).alias("bits_per_token"))


@query(f"WITH {_SEQ} SELECT seq, round(sum(nll) / length(any_value(text)) / ln(2), 6) AS bpc FROM nll JOIN seqs USING (seq) GROUP BY seq")
def bits_per_char(spark, d):
    n = losses(spark, d).groupBy("seq").agg(F.sum("nll").alias("s"))
    return n.join(sequences(spark, d), "seq").select("seq", F.round(F.col("s") / F.length("text") / F.ln(F.lit(2.0)), 6).alias("bpc"))


_SHORT = "SELECT conv_id * 100 + turn AS seq, turn, left(text, turn::INT) AS text, strlen(left(text, turn::INT)) AS n, greatest(strlen(left(text, turn::INT)) - 1, 0) * ln(256) AS total FROM conversations"


@query(f"SELECT seq, n::BIGINT AS n_ids, round(CASE WHEN n < 2 THEN 'NaN'::DOUBLE ELSE total / length(text) / ln(2) END, 6) AS bpc, round(exp(least(turn * 9.0::DOUBLE, 20)), 5) AS perplexity, round(CASE WHEN turn % 2 = 0 THEN 0 ELSE turn * 9.0::DOUBLE END, 6) AS masked FROM ({_SHORT})")
def metric_guards(spark, d):
    """Losses of texts too short to have one, of nothing selected, and beyond the perplexity's cap; under a uniform model."""
    t = table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("seq"), "turn", F.expr("left(text, cast(turn as int))").alias("text"))
    t = t.withColumn("n_ids", F.octet_length("text").cast("long"))
    total = F.greatest(F.col("n_ids") - 1, F.lit(0)) * F.ln(F.lit(256.0))
    loss = F.col("turn") * F.lit(9.0)
    out = t.groupBy("seq", "n_ids", "turn", "text").agg(metrics.masked_mean(F.lit(9.0) * F.col("turn"), (F.col("turn") % 2).cast("double")).alias("masked"))
    return out.select("seq", "n_ids", F.round(metrics.bits_per_char(total, F.col("n_ids"), F.length("text")), 6).alias("bpc"), F.round(metrics.capped_perplexity(loss), 5).alias("perplexity"), F.round("masked", 6).alias("masked"))


@query("SELECT vec_id, round(list_sum(list_transform(x, lambda v: CASE WHEN v >= 0 THEN -ln(1 + exp(-v)) ELSE v - ln(1 + exp(v)) END)), 6) AS total, round(CASE WHEN x[1] >= 0 THEN -ln(1 + exp(-x[1])) ELSE x[1] - ln(1 + exp(x[1])) END, 9) AS first FROM (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE * 200) AS x FROM embeddings)")
def log_sigmoid_values(spark, d):
    """Of all numbers of each vector, far into both tails."""
    t = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: log_sigmoid(v.cast("double") * 200)).alias("y"))
    return t.select("vec_id", F.round(F.aggregate("y", F.lit(0.0), lambda a, v: a + v), 6).alias("total"), F.round(F.element_at("y", 1), 9).alias("first"))


_LR = "CASE WHEN t < 100 THEN t / 100.0::DOUBLE * 1e-3::DOUBLE WHEN t <= 1000 THEN 1e-4::DOUBLE + 0.5::DOUBLE * (1 + cos((t - 100) / 900.0::DOUBLE * 3.141592653589793::DOUBLE)) * (1e-3::DOUBLE - 1e-4::DOUBLE) ELSE 1e-4::DOUBLE END"


@query(f"SELECT event_id, t, round({_LR}, 12) AS lr FROM (SELECT event_id, event_id % 1200 AS t FROM events)")
def lr_schedule(spark, d):
    """The rate at each logged step of runs of 1,200 steps."""
    t = table(spark, d, "events").select("event_id", (F.col("event_id") % 1200).alias("t"))
    return t.withColumn("lr", F.round(cosine_schedule(F.col("t"), 1e-3, 1e-4, 100, 1000), 12))


@query("SELECT event_id, round(1e-7::DOUBLE * pow(pow(1.0::DOUBLE / 1e-7::DOUBLE, 1.0::DOUBLE / 100), event_id % 100), 12) AS lr FROM events")
def lr_ramp(spark, d):
    """The rate at each logged step of sweeps of 100 steps."""
    return table(spark, d, "events").select("event_id", F.round(1e-7 * F.pow(F.lit((1.0 / 1e-7) ** (1.0 / 100)), F.col("event_id") % 100), 12).alias("lr"))


# the first 150 events stand for a sweep: a number for each, as a loss
_SWEEP = "s AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS it, abs(value) + 1 AS loss FROM events), h AS (SELECT it, loss, 1e-7::DOUBLE * pow(1.1::DOUBLE, it) AS lr, min(loss) OVER (ORDER BY it) AS best FROM s), stop AS (SELECT min(it) AS halt FROM h WHERE loss > 4 * best AND it > 10)"


def _sweep(spark, d):
    e = table(spark, d, "events").withColumn("key", F.unix_micros(F.col("ts").cast("timestamp")))
    from tessera.operators.ordering import ranked

    e = ranked(e.select("key", "event_id", "value"), "key", "it", ("event_id",)).select("it", (F.abs("value") + 1).alias("loss"))
    return running_best(e, "it", "loss").withColumn("lr", 1e-7 * F.pow(F.lit(1.1), "it"))


def running_best(df, order: str, value: str, size: int = 4096):
    """df with the least value so far: within ranges of the order, then over the ranges' least values (a row for each)."""
    own = df.withColumn("_r", F.floor(F.col(order) / size))
    before = own.groupBy("_r").agg(F.min(value).alias("_m")).select("_r", F.min("_m").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)).alias("_b"))
    w = Window.partitionBy("_r").orderBy(order)
    return own.join(F.broadcast(before), "_r").withColumn("best", F.least(F.min(value).over(w), "_b")).drop("_r", "_b")


@query(f"WITH {_SWEEP} SELECT it, round(loss, 6) AS loss, round(best, 6) AS best FROM h, stop WHERE halt IS NULL OR it <= halt")
def lr_find_stop(spark, d):
    h = _sweep(spark, d)
    stop = h.where("loss > 4 * best and it > 10").agg(F.min("it").alias("at"))
    return h.crossJoin(F.broadcast(stop)).where("at is null or it <= at").select("it", F.round("loss", 6).alias("loss"), F.round("best", 6).alias("best"))  # one row is broadcast


@query(f"WITH {_SWEEP} SELECT round(arg_min(lr, (loss, it)) / 10, 12) AS suggested FROM h, stop WHERE halt IS NULL OR it <= halt")
def lr_suggest(spark, d):
    h = _sweep(spark, d)
    stop = h.where("loss > 4 * best and it > 10").agg(F.min("it").alias("at"))
    return h.crossJoin(F.broadcast(stop)).where("at is null or it <= at").agg(F.round(F.min_by("lr", F.struct("loss", "it")) / 10, 12).alias("suggested"))


@query("SELECT (s - 1) // 100 + 1 AS interval_no, round(avg(v), 6) AS avg_loss, count(*)::BIGINT AS steps FROM (SELECT row_number() OVER (ORDER BY ts, event_id) AS s, value AS v FROM events) GROUP BY 1")
def log_interval_avg(spark, d):
    from tessera.operators.ordering import ranked

    e = table(spark, d, "events").withColumn("key", F.unix_micros(F.col("ts").cast("timestamp"))).select("key", "event_id", "value")
    s = ranked(e, "key", "s", ("event_id",))
    return s.groupBy((F.floor(F.col("s") / 100) + 1).alias("interval_no")).agg(F.round(F.avg("value"), 6).alias("avg_loss"), F.count("*").alias("steps"))
