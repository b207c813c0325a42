"""Reports about models and runs, over configurations, parameters and measurements that the tables hold.

Rows of `part` stand for model configurations, rows of `embeddings` for tensors of a checkpoint, users of `events` for training runs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators import reports
from tessera.plans.base import query, table
from tessera.sources import files
from tessera.sources.scratch import shared_dir

#: Peak FLOPs of accelerators at half and at single precision.
PEAKS = [("A100", 312e12, 19.5e12), ("H100", 989e12, 67.0e12), ("T4", 65e12, 8.1e12), ("V100", 125e12, 15.7e12), ("L4", 121e12, 30.3e12), ("RTX4090", 330e12, 82.6e12), ("RTX3090", 142e12, 35.6e12)]
_DEVICES = ["Tesla T4", "NVIDIA L4", "Apple M1", "NVIDIA A100-SXM4", "h100 pcie", "GeForce RTX 4090"]
_PEAK_SQL = "(VALUES " + ", ".join(f"({i}, '{n}', {h}::DOUBLE)" for i, (n, h, _) in enumerate(PEAKS)) + ") p(ord, chip, peak)"
_FLOPS = "(layers::BIGINT * (4 * context::BIGINT * d_model * d_model + 4 * context::BIGINT * d_model * (kv_heads * (d_model // q_heads)) + 4 * context::BIGINT * context * d_model + (CASE WHEN gate THEN 3 ELSE 2 END) * 2 * context::BIGINT * d_model * d_ff) + 2 * context::BIGINT * d_model * vocab)"
_WIDTH = "64 * (1 + p_partkey % 16)"
_CONFIG = {
    "name": "p_partkey",
    "vocab": "8000 + 100 * (p_partkey % 90)",
    "context": "128 * (1 + p_size % 8)",
    "d_model": _WIDTH,
    "layers": "1 + p_size % 12",
    "q_heads": "8",
    "kv_heads": "CASE WHEN p_partkey % 3 = 0 THEN 8 ELSE 2 END",
    "gate": "p_partkey % 2 = 0",
    "batch": "8 + p_size",
    "speed": "p_retailprice * 20",
}


def _configs(spark, d):
    t = table(spark, d, "part").selectExpr(*[f"{e} AS {c}" for c, e in _CONFIG.items()])
    return reports.widths(t.withColumn("device", F.element_at(F.array(*[F.lit(x) for x in _DEVICES]), (F.col("name") % len(_DEVICES) + 1).cast("int"))))


_CONFIG_SQL = "(SELECT *, ((8 * d_model // 3 + 63) // 64 * 64) AS d_ff, [" + ", ".join(f"'{x}'" for x in _DEVICES) + f"][name % {len(_DEVICES)} + 1] AS device FROM (SELECT " + ", ".join(f"{e} AS {c}" for c, e in _CONFIG.items()) + " FROM part))"


@query(f"""SELECT name, {_FLOPS}::BIGINT AS flops, chip, round(speed / (batch * context) * 3 * {_FLOPS} * batch / peak, 6) AS mfu
FROM {_CONFIG_SQL} c LEFT JOIN (SELECT device, arg_min(chip, ord) AS chip, arg_min(peak, ord) AS peak FROM (SELECT DISTINCT device FROM {_CONFIG_SQL}), {_PEAK_SQL} WHERE contains(upper(replace(device, ' ', '')), upper(chip)) GROUP BY device) k USING (device)""")
def flops_estimate(spark, d):
    """Each configuration's forward cost of a sequence, and the share of its device's peak that its tokens a second use in training."""
    peaks = spark.createDataFrame([(i, n, h) for i, (n, h, _) in enumerate(PEAKS)], "ord int, chip string, peak double")
    return reports.flops(_configs(spark, d), peaks, F.col("speed")).select("name", "flops", "chip", F.round("mfu", 6).alias("mfu"))


@query(f"SELECT name, d_ff::BIGINT AS d_ff FROM {_CONFIG_SQL}")
def feed_forward_width(spark, d):
    """8/3 of each model's width, rounded up to a multiple of 64."""
    return _configs(spark, d).select("name", "d_ff")


_TENSORS = "(SELECT 'w' || vec_id AS name, [len(embedding), label + 1, vec_id % 7 + 1] AS shape, CASE WHEN vec_id % 10 = 9 THEN 'w' || (vec_id - 9) ELSE 'w' || vec_id END AS storage FROM embeddings)"


@query(f"WITH s AS (SELECT storage, max(list_product(shape)::BIGINT) AS n FROM {_TENSORS} GROUP BY storage) SELECT sum(n)::BIGINT AS total, sum(n) FILTER (storage <> 'w0')::BIGINT AS without_embedding FROM s")
def num_parameters(spark, d):
    """Numbers in all tensors; every tenth shares the storage of the one nine before it."""
    t = table(spark, d, "embeddings")
    name, tied = F.concat(F.lit("w"), F.col("vec_id")), F.concat(F.lit("w"), F.col("vec_id") - 9)
    return reports.parameters(t.select(name.alias("name"), F.array(F.size("embedding").cast("long"), F.col("label").cast("long") + 1, F.col("vec_id") % 7 + 1).alias("shape"), F.when(F.col("vec_id") % 10 == 9, tied).otherwise(name).alias("storage")), "w0")


@query("""WITH a AS (SELECT 'k' || o_custkey AS k, min(o_orderpriority) AS v FROM orders GROUP BY 1), b AS (SELECT 'k' || c_custkey AS k, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS v FROM customer WHERE c_custkey % 5 > 0),
c AS (SELECT 'k' || (c_custkey + 100) AS k, c_name AS v FROM customer), names AS (SELECT k FROM a UNION SELECT k FROM b UNION SELECT k FROM c)
SELECT k AS key, coalesce(a.v, b.v, c.v) AS value FROM names LEFT JOIN a USING (k) LEFT JOIN b USING (k) LEFT JOIN c USING (k)""")
def config_resolve(spark, d):
    """Three layers of settings; the first that has a value counts."""
    key = lambda c: F.concat(F.lit("k"), c).alias("key")
    orders, customers = table(spark, d, "orders"), table(spark, d, "customer")
    first = orders.groupBy(key("o_custkey")).agg(F.min("o_orderpriority").alias("value"))
    second = customers.where("c_custkey % 5 > 0").select(key("c_custkey"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).alias("value"))
    return reports.resolved(first, second, customers.select(key(F.col("c_custkey") + 100), F.col("c_name").alias("value")))


_MODEL_SQL = "m AS (SELECT 'block.' || label || '.w' || vec_id AS name FROM embeddings), c AS (SELECT regexp_replace(name, '^_orig_mod\\.', '') AS name FROM (SELECT '_orig_mod.block.' || label || CASE WHEN vec_id % 4 = 0 THEN '.x' ELSE '.w' END || vec_id AS name FROM embeddings WHERE vec_id % 3 > 0))"


@query(f"WITH {_MODEL_SQL} SELECT name, 'missing' AS status FROM m WHERE name NOT IN (SELECT name FROM c) UNION ALL SELECT name, 'unexpected' FROM c WHERE name NOT IN (SELECT name FROM m)")
def state_dict_diff(spark, d):
    """A checkpoint written under a compiler's prefix and loaded again, against the model's names."""
    t, at = table(spark, d, "embeddings"), f"{shared_dir(spark)}/state-{uuid.uuid4().hex}"
    name = lambda prefix, kind: F.concat(F.lit(prefix), F.col("label"), kind, F.col("vec_id")).alias("name")
    files.write_checkpoint(t.where("vec_id % 3 > 0").select(name("_orig_mod.block.", F.when(F.col("vec_id") % 4 == 0, ".x").otherwise(".w")), F.array(F.size("embedding")).alias("shape"), "embedding"), at, 1)
    return reports.state_difference(t.select(name("block.", F.lit(".w"))), files.read_checkpoint(spark, at, 1))


@query("SELECT user_id, min(event_id) FILTER (value / greatest(event_id % 400, 1e-6::DOUBLE) > 1) AS crossover FROM events GROUP BY user_id")
def kv_crossover(spark, d):
    """For each run the first length from which the cached speed is the higher one."""
    runs = table(spark, d, "events").select("user_id", F.col("event_id").alias("gen"), F.col("value").alias("cached"), (F.col("event_id") % 400).cast("double").alias("plain"))
    return reports.crossover(runs, "user_id")


_RUNS_SQL = "r AS (SELECT CASE WHEN user_id = 0 THEN 'baseline' ELSE 'run-' || user_id END AS name, round(avg(value) / 100, 6) AS val_loss, count(*)::BIGINT * 1000 AS params FROM events GROUP BY 1)"


@query(f"WITH {_RUNS_SQL} SELECT row_number() OVER (ORDER BY val_loss, name) AS place, name, val_loss, round(exp(val_loss), 4) AS val_ppl, round(val_loss - coalesce((SELECT val_loss FROM r WHERE name = 'baseline'), (SELECT min(val_loss) FROM r)), 6) + 0.0 AS delta, params FROM r")
def ablation_report(spark, d):
    """Users as runs, by their mean value as a loss."""
    name = F.when(F.col("user_id") == 0, "baseline").otherwise(F.concat(F.lit("run-"), "user_id"))
    means = reports.means_in_order(table(spark, d, "events").select(name.alias("name"), "event_id", "value"), "name", "event_id", "value")
    out = reports.ablations(means.select(F.col("key").alias("name"), reports.rounded(F.col("mean") / 100, 6).alias("val_loss"), (F.col("n") * 1000).alias("params")))
    return out.select("place", "name", "val_loss", reports.rounded(F.col("val_ppl"), 4).alias("val_ppl"), (reports.rounded(F.col("delta"), 6) + 0.0).alias("delta"), "params")
