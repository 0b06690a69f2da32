"""Queries over a results table: pairing, tests, effects, validation, runner state; with their SQL.

The results table comes from ``orders``: five datasets (priorities), three seeds, six budgets; each
cell predicts prices by the context's mean for the order's status and scores the test rows.  Its SQL is
the same in both engines; what is tested is what the operators do with it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import effects as X
from ..operators import grid as G
from ..operators import statistics as T
from ..operators import validation as V
from ..functions.tables import written
from ..sources import datasets as DS
from ..sources import results as R
from . import data, sql
from .sql import CLF, P, with_

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def _seeds(engine: str) -> str:
    return "SELECT explode(array(0, 1, 2)) AS seed" if engine == "spark" else "SELECT unnest([0, 1, 2])::INTEGER AS seed"


def _budgets(engine: str) -> str:
    keys = [("f0.02", 0.02), ("f0.05", 0.05), ("f0.1", 0.1), ("f0.2", 0.2), ("f0.4", 0.4), ("f0.8", 0.8)]
    return " UNION ALL ".join(f"SELECT '{k}' AS budget_key, CAST({f} AS DOUBLE) AS f" for k, f in keys)


def results_ctes(engine: str) -> list[str]:
    return [
        "o AS (SELECT o_orderkey AS id, o_orderpriority AS ds, o_orderstatus AS st, o_totalprice AS y FROM orders)",
        "tr AS (SELECT * FROM o WHERE id % 4 <> 0)",
        "te AS (SELECT * FROM o WHERE id % 4 = 0)",
        f"sd AS ({_seeds(engine)})",
        f"bk AS ({_budgets(engine)})",
        "nt AS (SELECT ds, count(*) AS n FROM tr GROUP BY ds)",
        "rk AS (SELECT ds, id, st, y, seed, row_number() OVER (PARTITION BY ds, seed ORDER BY md5(concat_ws(':', CAST(seed AS STRING), 'random', CAST(id AS STRING))), id) AS rr, row_number() OVER (PARTITION BY ds, seed ORDER BY md5(concat_ws(':', CAST(seed AS STRING), 'core', CAST(id % 97 AS STRING))), id) AS rc FROM tr CROSS JOIN sd)".replace("STRING", "STRING" if engine == "spark" else "VARCHAR"),
        "bb AS (SELECT ds, budget_key, CAST(floor(f * n) AS INT) AS b, n FROM nt CROSS JOIN bk)",
        "cx AS (SELECT r.ds, r.seed, 'random' AS method, b.budget_key, b.b, b.n, r.st, r.y FROM rk r JOIN bb b ON b.ds = r.ds AND r.rr <= b.b UNION ALL SELECT r.ds, r.seed, 'core', b.budget_key, b.b, b.n, r.st, r.y FROM rk r JOIN bb b ON b.ds = r.ds AND r.rc <= b.b UNION ALL SELECT t.ds, s.seed, 'full', 'full', CAST(n.n AS INT), n.n, t.st, t.y FROM tr t CROSS JOIN sd s JOIN nt n ON n.ds = t.ds)",
        "md AS (SELECT ds, seed, method, budget_key, b, n, st, avg(y) AS p FROM cx GROUP BY ds, seed, method, budget_key, b, n, st)",
        "sc AS (SELECT m.ds, m.seed, m.method, m.budget_key, m.b, m.n, sqrt(avg((p - t.y) * (p - t.y))) AS rmse, avg(CASE WHEN (p > 150000) = (t.y > 150000) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS acc FROM md m JOIN te t ON t.ds = m.ds AND t.st = m.st GROUP BY m.ds, m.seed, m.method, m.budget_key, m.b, m.n)",
        "mm AS (SELECT ds, seed, method, budget_key, b, n, 'rmse' AS metric, round(rmse, 6) AS value FROM sc UNION ALL SELECT ds, seed, method, budget_key, b, n, 'accuracy', round(CAST(acc AS DOUBLE), 6) FROM sc)",
        "results AS (SELECT 'coreset' AS experiment, ds AS dataset, CASE WHEN ds < '3' THEN 'dev' ELSE 'confirm' END AS split, CASE WHEN ds < '3' THEN 'small' ELSE 'medium' END AS tier, 'regression' AS task, seed, method, CAST(b AS DOUBLE) AS budget, CAST(b AS DOUBLE) / CAST(n AS DOUBLE) AS ratio, CAST(n AS INT) AS n_train, metric, value, 'means' AS backend, CASE WHEN method = 'core' THEN 'method' WHEN method = 'full' THEN 'reference' ELSE 'baseline' END AS role, '' AS flags, 0 AS split_seed, -1 AS n_estimators, budget_key, concat_ws('|', 'coreset', ds, 's0', concat('r', CAST(seed AS STRING)), method, budget_key, CAST(b AS STRING)) AS cell FROM mm)".replace("STRING", "STRING" if engine == "spark" else "VARCHAR"),
    ]


D = results_ctes("duckdb")


_kept: dict = {}


def results(s, d):
    """The results table, worked out once a session and written: every report reads it from there."""
    key = (s.sparkContext.applicationId, d)
    if key not in _kept:
        data.table(s, d, "orders").createOrReplaceTempView("orders_for_results")
        made = s.sql(with_(*[c.replace(" FROM orders)", " FROM orders_for_results)") for c in results_ctes("spark")], select="SELECT * FROM results"))
        _kept[key] = written(made.coalesce(1), "results")
    return _kept[key]


def family(s):
    rows = [("core", "random", k, m) for k in ("f0.02", "f0.05", "f0.1", "f0.2") for m in ("rmse", "accuracy")] + [("core", "random", None, "rmse")]
    return s.createDataFrame(rows, "method string, baseline string, budget_key string, metric string")


_FAM = "fam AS (SELECT 'core' AS method, 'random' AS baseline, k AS budget_key, m AS metric FROM (SELECT unnest(['f0.02', 'f0.05', 'f0.1', 'f0.2']) AS k) CROSS JOIN (SELECT unnest(['rmse', 'accuracy']) AS m) UNION ALL SELECT 'core', 'random', NULL, 'rmse')"
_PAIR = "pd AS (SELECT f.method, f.baseline, f.budget_key, f.metric, m.dataset, avg(m.value - b.value) AS diff FROM fam f JOIN results m ON m.method = f.method AND m.metric = f.metric AND (f.budget_key IS NULL OR f.budget_key = m.budget_key) JOIN results b ON b.method = f.baseline AND b.metric = m.metric AND b.dataset = m.dataset AND b.seed = m.seed AND b.split_seed = m.split_seed AND b.budget IS NOT DISTINCT FROM m.budget AND b.n_estimators = m.n_estimators GROUP BY f.method, f.baseline, f.budget_key, f.metric, m.dataset)"
_CMP = [
    *D, _FAM, _PAIR, "im AS (SELECT *, diff * CASE WHEN metric = 'accuracy' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS imp, row_number() OVER (PARTITION BY method, baseline, budget_key, metric ORDER BY dataset) - 1 AS i, count(*) OVER (PARTITION BY method, baseline, budget_key, metric) AS n FROM pd)",
    "bt AS (SELECT method, baseline, budget_key, metric, n, b, (('0x' || substr(md5(concat_ws(':', '0', 'boot', b, j)), 1, 12))::UBIGINT % n)::BIGINT AS i FROM (SELECT DISTINCT method, baseline, budget_key, metric, n FROM im) CROSS JOIN (SELECT unnest(range(200)) AS b) CROSS JOIN (SELECT unnest(range(5)) AS j) WHERE j < n)",
    "bm AS (SELECT t.method, t.baseline, t.budget_key, t.metric, t.b, avg(i.imp) AS m FROM bt t JOIN im i ON i.method = t.method AND i.metric = t.metric AND i.budget_key IS NOT DISTINCT FROM t.budget_key AND i.i = t.i GROUP BY ALL)",
    "ci AS (SELECT method, baseline, budget_key, metric, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM bm GROUP BY ALL)",
    "ag AS (SELECT method, baseline, budget_key, metric, count(*) AS n_datasets, avg(diff) AS mean_diff, avg(imp) AS improvement, count(*) FILTER (imp > 0) AS w, count(*) FILTER (imp < 0) AS l FROM im GROUP BY ALL)",
    "cb AS (SELECT k, r, CASE WHEN r = 0 THEN 1 WHEN r = 1 THEN k WHEN r = 2 THEN k * (k - 1) / 2 ELSE 0 END::DOUBLE AS ways FROM (SELECT unnest(range(0, 7)) AS k) CROSS JOIN (SELECT unnest(range(0, 3)) AS r) WHERE r <= k)",
    "sg AS (SELECT ag.*, CASE WHEN w + l = 0 THEN 1 ELSE least(1, 2 * (SELECT sum(ways) FROM cb WHERE k = w + l AND r <= least(w, l)) / pow(2, w + l)) END AS p_sign FROM ag)",
    "hm AS (SELECT *, least(1, (count(*) OVER () - row_number() OVER (ORDER BY p_sign, method, baseline, budget_key NULLS FIRST, metric) + 1) * p_sign) AS a FROM sg)",
    "ho AS (SELECT *, max(a) OVER (ORDER BY p_sign, method, baseline, budget_key NULLS FIRST, metric ROWS UNBOUNDED PRECEDING) AS p_holm FROM hm)",
]


@query("paired_compare", with_(*D, _FAM, _PAIR, select="SELECT method, baseline, budget_key, metric, dataset, round(diff, 6) AS diff FROM pd"))
def paired_compare(s, d):
    return T.paired(results(s, d), family(s)).select("method", "baseline", "budget_key", "metric", "dataset", F.round("diff", 6).alias("diff"))


@query("compare_family", with_(*_CMP, select="SELECT h.method, h.baseline, h.budget_key, h.metric, n_datasets, round(mean_diff, 7) AS mean_diff, round(improvement, 7) AS improvement, round(ci_low, 7) AS ci_low, round(ci_high, 7) AS ci_high, round(p_sign, 6) AS p_sign, round((w + 0.5 * (n_datasets - w - l)) / n_datasets, 6)::DOUBLE AS win_rate, n_datasets >= 2 AND (ci_low > 0 OR ci_high < 0) AND p_sign < 0.05 AS significant, round(p_holm, 6) AS p_holm, p_holm < 0.05 AND (ci_low > 0 OR ci_high < 0) AS significant_holm FROM ho h JOIN ci c ON c.method = h.method AND c.metric = h.metric AND c.budget_key IS NOT DISTINCT FROM h.budget_key"))
def compare_family(s, d):
    out = T.compare(results(s, d), family(s), n_boot=200)
    five = [F.round(c, 7).alias(c) for c in ("mean_diff", "improvement", "ci_low", "ci_high")]
    return out.select("method", "baseline", "budget_key", "metric", "n_datasets", *five, *[F.round(c, 6).alias(c) for c in ("p_sign", "win_rate", "p_holm")], "significant", "significant_holm")


@query("wilcoxon_paired_t")
def wilcoxon_paired_t(s, d):
    return T.paired_t_by_dataset(results(s, d), "random", "rmse")


@query("compare_by_tier")
def compare_by_tier(s, d):
    out, p = T.by_tier(results(s, d), "core", "random", "rmse", n_boot=200)
    return out.withColumn("heterogeneity_p", F.lit(p))


@query("bootstrap_ci", with_(*_CMP[:-4], select="SELECT metric, budget_key, round(ci_low, 7) AS ci_low, round(ci_high, 7) AS ci_high FROM ci"))
def bootstrap_ci(s, d):
    p = T.paired(results(s, d), family(s)).withColumn("imp", F.col("diff") * T.orientation(F.col("metric")))
    return T.bootstrap_ci(p, T.GROUP, "imp", n_boot=200).select("metric", "budget_key", F.round("ci_low", 7).alias("ci_low"), F.round("ci_high", 7).alias("ci_high"))


_HP = "hp AS (SELECT c_nationkey AS k, (count(*) FILTER (c_acctbal < 0))::DOUBLE / count(*) AS p FROM customer GROUP BY c_nationkey), ha AS (SELECT *, least(1, (count(*) OVER () - row_number() OVER (ORDER BY p, k) + 1) * p) AS a FROM hp)"


@query("holm", with_(_HP, select="SELECT k, round(p, 6) AS p, round(max(a) OVER (ORDER BY p, k ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM ha"))
def holm(s, d):
    p = data.table(s, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg((F.count_if(F.col("c_acctbal") < 0).cast("double") / F.count("*")).alias("p"))
    return T.holm(p, "p", tie=["k"]).select("k", F.round("p", 6).alias("p"), F.round("p_holm", 6).alias("p_holm"))


_FP = "fp AS (SELECT r.dataset, r.budget, r.metric, r.value - f.value AS d FROM results r JOIN results f ON f.method = 'full' AND f.dataset = r.dataset AND f.metric = r.metric AND f.seed = r.seed WHERE r.method = 'random')"
_SAT = "sa AS (SELECT dataset, budget, metric FROM fp GROUP BY ALL HAVING count(*) >= 2 AND (abs(avg(d)) < stddev_samp(d) / sqrt(count(*)) OR max(abs(d)) = 0))"


@query("annotate_saturation", with_(*D, _FP, _SAT, select="SELECT r.cell, r.metric, CASE WHEN s.dataset IS NOT NULL AND r.method <> 'full' THEN 'saturated' ELSE '' END AS flags FROM results r LEFT JOIN sa s ON s.dataset = r.dataset AND s.budget = r.budget AND s.metric = r.metric"))
def annotate_saturation(s, d):
    return X.annotate_saturation(results(s, d)).select("cell", "metric", "flags")


_EFF = [
    *D, _FP, "fu AS (SELECT dataset, avg(value) AS m_full FROM results WHERE method = 'full' AND metric = 'rmse' GROUP BY dataset)",
    "ra AS (SELECT dataset, budget, avg(value) AS m_random FROM results WHERE method = 'random' AND metric = 'rmse' GROUP BY dataset, budget)",
    "co AS (SELECT dataset, budget, budget_key, any_value(ratio) AS ratio, avg(value) AS m_core FROM results WHERE method = 'core' AND metric = 'rmse' GROUP BY dataset, budget, budget_key)",
    "no AS (SELECT dataset, budget, stddev_samp(d) / sqrt(count(*)) AS noise FROM fp WHERE metric = 'rmse' GROUP BY dataset, budget)",
    "eg AS (SELECT c.*, m_random, m_full, CASE WHEN abs(m_random - m_full) > greatest(coalesce(noise, 0), 1e-12) THEN (m_random - m_core) / (m_random - m_full) END AS gap_closed FROM co c JOIN ra USING (dataset, budget) JOIN fu USING (dataset) LEFT JOIN no USING (dataset, budget))",
]
# isotonic quality -m_random: greatest over starts of the least over ends of interval means
_ISO = [
    "ri AS (SELECT dataset, budget, -m_random AS q0, row_number() OVER (PARTITION BY dataset ORDER BY budget) AS i FROM ra)",
    "av AS (SELECT a.dataset, a.i AS lo, b.i AS hi, avg(c.q0) AS m FROM ri a JOIN ri b ON b.dataset = a.dataset AND b.i >= a.i JOIN ri c ON c.dataset = a.dataset AND c.i BETWEEN a.i AND b.i GROUP BY a.dataset, a.i, b.i)",
    "iq AS (SELECT r.dataset, r.i, r.budget AS b, (SELECT max(z) FROM (SELECT lo, min(m) AS z FROM av WHERE av.dataset = r.dataset AND lo <= r.i AND hi >= r.i GROUP BY lo)) AS q FROM ri r)",
]
_EQ = [
    "ev AS (SELECT e.*, -m_core AS v FROM eg e)",
    "ej AS (SELECT dataset, budget, min(i) AS j FROM ev JOIN iq USING (dataset) WHERE q >= v GROUP BY dataset, budget)",
    "em AS (SELECT e.dataset, e.budget_key, CASE WHEN j IS NULL THEN 'above_range' WHEN e.v < (SELECT q FROM iq WHERE iq.dataset = e.dataset AND i = 1) THEN 'below_range' ELSE '' END AS flag, CASE WHEN a.i = 1 OR a.q = e.v THEN a.b ELSE exp(ln(p.b) + (e.v - p.q) / (a.q - p.q) * (ln(a.b) - ln(p.b))) END / e.budget AS mult FROM ev e LEFT JOIN ej USING (dataset, budget) LEFT JOIN iq a ON a.dataset = e.dataset AND a.i = j LEFT JOIN iq p ON p.dataset = e.dataset AND p.i = j - 1)",
]


@query("gap_closed", with_(*_EFF, select="SELECT dataset, budget_key, round(m_core, 7) AS m_core, round(m_random, 7) AS m_random, round(m_full, 7) AS m_full, round(gap_closed, 6) AS gap_closed FROM eg"))
def gap_closed(s, d):
    return X.effect_sizes(results(s, d), "core", "rmse").select("dataset", "budget_key", *[F.round(c, 7).alias(c) for c in ("m_core", "m_random", "m_full")], F.round("gap_closed", 6).alias("gap_closed"))


@query("equivalent_budget", with_(*_EFF, *_ISO, *_EQ, select="SELECT dataset, budget_key, flag AS range_flag, CASE WHEN flag = '' THEN round(mult, 6) END AS multiplier FROM em"))
def equivalent_budget(s, d):
    r = results(s, d).where("metric = 'rmse'")
    curve = r.where("method = 'random'").groupBy("dataset", "budget").agg(F.avg("value").alias("value"))
    core = r.where("method = 'core'").groupBy("dataset", "budget", "budget_key").agg(F.avg("value").alias("value"))
    return X.equivalent_budget(core, curve, ["dataset"], False).select("dataset", "budget_key", "range_flag", F.round("multiplier", 6).alias("multiplier"))


@query("smooth_monotone", with_(*_EFF, *_ISO, select="SELECT dataset, b AS budget, round(q, 7) AS q FROM iq"))
def smooth_monotone(s, d):
    r = results(s, d).where("metric = 'rmse' AND method = 'random'")
    return X.isotonic(r.groupBy("dataset", "budget").agg(F.avg("value").alias("value")), ["dataset"], False).select("dataset", "budget", F.round("q", 7).alias("q"))


@query("ratio_curve", with_(*_EFF, "per AS (SELECT round(ratio, 6) AS ratio, dataset, avg(gap_closed) AS g FROM eg GROUP BY 1, 2)", select="SELECT ratio, round(avg(g), 6) AS gap_closed, count(g) AS n_datasets FROM per GROUP BY ratio"))
def ratio_curve(s, d):
    return X.ratio_curve(X.effect_sizes(results(s, d), "core", "rmse")).select("ratio", F.round("gap_closed", 6).alias("gap_closed"), "n_datasets")


@query("summarize_effect", with_(*_EFF, "per AS (SELECT dataset, avg(gap_closed) AS v FROM eg GROUP BY dataset)", select="SELECT 'gap_closed' AS column, count(v) AS n_datasets, round(avg(v), 6) AS mean FROM per"))
def summarize_effect(s, d):
    return X.summarize(X.effect_sizes(results(s, d), "core", "rmse"), "gap_closed", n_boot=200).select("column", "n_datasets", F.round("mean", 6).alias("mean"))


@query("estimate_noise", with_(*D, "j AS (SELECT m.dataset, (m.value - b.value) / greatest(abs(b.value), 1e-12) AS d FROM results m JOIN results b ON b.method = 'random' AND b.metric = m.metric AND b.dataset = m.dataset AND b.seed = m.seed AND b.budget = m.budget WHERE m.method = 'core' AND m.metric = 'rmse')", "p AS (SELECT dataset, avg(d) AS m, coalesce(var_samp(d), 0) AS v, count(*) AS n FROM j GROUP BY dataset)", select="SELECT round(stddev_samp(m), 6) AS sd_dataset, round(sqrt(avg(v)), 6) AS sd_seed, count(*) AS n_datasets, avg(n) AS seeds_per_dataset FROM p"))
def estimate_noise(s, d):
    return X.estimate_noise(results(s, d), "core", "random", "rmse").select(F.round("sd_dataset", 6).alias("sd_dataset"), F.round("sd_seed", 6).alias("sd_seed"), "n_datasets", "seeds_per_dataset")


@query("scaling_steps", with_(*D, "lv AS (SELECT dataset, method, budget, lead(budget) OVER (PARTITION BY dataset, method ORDER BY budget) AS nx FROM (SELECT DISTINCT dataset, method, budget FROM results WHERE metric = 'rmse'))", select="SELECT a.dataset, a.method, a.n_estimators, a.budget, lv.nx AS next, count(*) AS n, round(avg(b.value - a.value), 7) AS mean_step, round(stddev_samp(b.value - a.value), 7) AS sd_step FROM results a JOIN lv ON lv.dataset = a.dataset AND lv.method = a.method AND lv.budget = a.budget AND nx IS NOT NULL JOIN results b ON b.metric = 'rmse' AND b.dataset = a.dataset AND b.method = a.method AND b.budget = lv.nx AND b.seed = a.seed WHERE a.metric = 'rmse' GROUP BY ALL"))
def scaling_steps(s, d):
    return X.steps(results(s, d), "rmse").select("dataset", "method", "n_estimators", "budget", "next", "n", F.round("mean_step", 7).alias("mean_step"), F.round("sd_step", 7).alias("sd_step"))


_TIME = "tm AS (SELECT DISTINCT cell, dataset, method, budget, n_estimators, seed, budget / 1000 AS total_s FROM results)"


def timing(s, d):
    t = results(s, d).select("cell", "dataset", "method", "budget", "n_estimators", "seed", "split_seed").distinct()
    return t.withColumns({"select_s": F.lit(0.0), "fit_s": F.col("budget") / 4000, "predict_s": F.col("budget") / 4000, "total_s": F.col("budget") / 1000, "ingest_seq": F.pmod(F.xxhash64("cell"), F.lit(1000))})


@query("scaling_summary", with_(*D, _TIME, select="SELECT s.dataset, s.budget, s.n_estimators, round(mean, 7) AS mean, round(sd, 7) AS sd, n, round(sd / sqrt(n), 7) AS se, round(total_s, 6) AS total_s FROM (SELECT dataset, budget, n_estimators, avg(value) AS mean, stddev_samp(value) AS sd, count(value) AS n FROM results WHERE metric = 'rmse' GROUP BY ALL) s LEFT JOIN (SELECT dataset, budget, n_estimators, avg(total_s) AS total_s FROM tm GROUP BY ALL) USING (dataset, budget, n_estimators)"))
def scaling_summary(s, d):
    out = X.scaling_summary(results(s, d), timing(s, d), "rmse")
    return out.select("dataset", "budget", "n_estimators", *[F.round(c, 7).alias(c) for c in ("mean", "sd")], "n", F.round("se", 7).alias("se"), F.round("total_s", 6).alias("total_s"))


@query("tune_params", with_(*D, "p AS (SELECT budget_key, dataset, avg(value) AS v FROM results WHERE metric = 'rmse' AND split = 'dev' AND method = 'core' GROUP BY ALL)", select="SELECT budget_key, round(avg(v), 7) AS value FROM p GROUP BY budget_key ORDER BY avg(v), budget_key LIMIT 1"))
def tune_params(s, d):
    return X.tune(results(s, d).where("split = 'dev' AND method = 'core'"), "rmse", ["budget_key"]).select("budget_key", F.round("value", 7).alias("value"))


@query("learning_curve", "SELECT o_orderkey AS row_id, round(0.3 + 2 * pow(o_orderkey::DOUBLE, -0.5), 6) AS m FROM orders")
def learning_curve(s, d):
    return data.table(s, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.round(G.curve(0.3, 2, 0.5, F.col("o_orderkey")), 6).alias("m"))


@query("plan_power")
def plan_power(s, d):
    p = X.plan(20, 3, 0.5, 1.0, 0.5)
    return s.createDataFrame([(p["power"], p["enough"], float(p["min_effect"]), float(p["min_effect_approx"]))], "power double, enough boolean, min_effect double, min_effect_approx double")


# validation: a damaged copy of the results, so each check finds something
def damaged(s, d):
    r = results(s, d)
    h = F.pmod(F.conv(F.substring(F.md5("cell"), 1, 8), 16, 10).cast("long"), F.lit(11))
    r = r.withColumn("h", h).withColumn("value", F.when(F.col("h") == 1, F.lit(float("nan"))).when((F.col("h") == 2) & (F.col("metric") == "accuracy"), F.lit(1.5)).otherwise(F.col("value"))).withColumn("metric", F.when(F.col("h") == 3, F.lit("speed")).otherwise(F.col("metric"))).withColumn("budget", F.when((F.col("h") == 4) & (F.col("method") == "core"), F.col("budget") * 1000).otherwise(F.col("budget")))
    return r.where("h <> 5 OR method = 'core'").union(r.where("h = 6")).drop("h")


_DMG = [*D, "h0 AS (SELECT *, ('0x' || substr(md5(cell), 1, 8))::UBIGINT % 11 AS h FROM results)", "h1 AS (SELECT * REPLACE (CASE WHEN h = 1 THEN 'nan'::DOUBLE WHEN h = 2 AND metric = 'accuracy' THEN 1.5 ELSE value END AS value, CASE WHEN h = 3 THEN 'speed' ELSE metric END AS metric, CASE WHEN h = 4 AND method = 'core' THEN budget * 1000 ELSE budget END AS budget) FROM h0)", "dm AS (SELECT * EXCLUDE (h) FROM h1 WHERE h <> 5 OR method = 'core' UNION ALL SELECT * EXCLUDE (h) FROM h1 WHERE h = 6)"]

query("validate_metrics", with_(*_DMG, select="SELECT metric, count(*) AS n FROM dm WHERE metric NOT IN ('rmse', 'accuracy') GROUP BY metric"))(lambda s, d: V.unknown_metrics(damaged(s, d)))
query("validate_finite", with_(*_DMG, select="SELECT cell, metric FROM dm WHERE NOT isfinite(value)"))(lambda s, d: V.bad_values(damaged(s, d)).select("cell", "metric"))
query("validate_dups", with_(*_DMG, select="SELECT dataset, seed, method, budget, metric, count(*) AS n FROM dm GROUP BY experiment, dataset, split_seed, seed, method, budget, n_estimators, metric, budget_key HAVING count(*) > 1"))(lambda s, d: V.duplicates(damaged(s, d)).select("dataset", "seed", "method", "budget", "metric", "n"))
query("validate_range", with_(*_DMG, select="SELECT cell, metric FROM dm WHERE NOT isnan(value) AND (metric = 'accuracy' AND (value > 1 + 1e-9 OR value < -1e-9) OR metric = 'rmse' AND value < -1e-9)"))(lambda s, d: V.out_of_range(damaged(s, d).where(~F.isnan("value"))).select("cell", "metric"))
query("validate_budget", with_(*_DMG, select="SELECT cell, metric FROM dm WHERE method <> 'full' AND budget > n_train"))(lambda s, d: V.over_budget(damaged(s, d)).select("cell", "metric"))
query("validate_grid", with_(*_DMG, select="SELECT x.dataset, y.method, z.seed, w.budget_key FROM (SELECT DISTINCT dataset FROM dm) x CROSS JOIN (SELECT DISTINCT method FROM dm) y CROSS JOIN (SELECT DISTINCT seed FROM dm) z CROSS JOIN (SELECT DISTINCT budget_key FROM dm) w ANTI JOIN dm ON dm.dataset = x.dataset AND dm.method = y.method AND dm.seed = z.seed AND dm.budget_key = w.budget_key"))(lambda s, d: (lambda r: V.missing_cells(r, V.grid(r, "dataset", "method", "seed", "budget_key")))(damaged(s, d)))
query("validate_baselines", with_(*_DMG, "wn AS (SELECT DISTINCT dataset, split_seed, seed, budget FROM dm WHERE role = 'method')", select="SELECT wn.*, 'random' AS method FROM wn ANTI JOIN (SELECT * FROM dm WHERE method = 'random') b ON b.dataset = wn.dataset AND b.split_seed = wn.split_seed AND b.seed = wn.seed AND b.budget = wn.budget"))(lambda s, d: V.missing_baselines(damaged(s, d), ["random"]))
query("validate_curves", with_(*_DMG, select="SELECT d.dataset, coalesce(n, 0) AS n FROM (SELECT DISTINCT dataset FROM dm) d LEFT JOIN (SELECT dataset, count(DISTINCT budget) AS n FROM dm WHERE method = 'random' GROUP BY dataset) USING (dataset) WHERE coalesce(n, 0) < 7"))(lambda s, d: V.short_curves(damaged(s, d), 7))
query("validate_timing", with_(*D, _TIME, "t2 AS (SELECT * FROM tm WHERE budget < 1000)", select="SELECT DISTINCT cell, 'missing' AS problem FROM results ANTI JOIN t2 USING (cell)"))(lambda s, d: V.timing_problems(timing(s, d).where("budget < 1000"), results(s, d)))

# sources, sinks and runner state
_CE = "ce AS (SELECT cell, row_number() OVER (ORDER BY cell) - 1 AS cell_idx FROM (SELECT DISTINCT cell FROM results))"


def cells(s, d):
    from pyspark.sql import Window

    return results(s, d).select("cell").distinct().withColumn("cell_idx", F.row_number().over(Window.orderBy("cell")) - 1)


query("results_table", with_(*D, select="SELECT * FROM results"))(results)
query("resume_antijoin", with_(*D, _CE, select="SELECT cell_idx, ce.cell FROM ce ANTI JOIN (SELECT DISTINCT cell FROM results WHERE seed = 0) r ON r.cell = ce.cell WHERE cell_idx % 3 = 1"))(lambda s, d: R.pending(cells(s, d), results(s, d).where("seed = 0"), 1, 3).select(F.col("cell_idx").cast("long").alias("cell_idx"), "cell"))
query("merge_shards", with_(*D, select="SELECT cell, metric, value FROM results"))(lambda s, d: (lambda r: R.merge_shards([r.where(f"pmod(seed, 2) = {i}") for i in (0, 1)] + [r.where("seed = 0")]))(results(s, d)).select("cell", "metric", "value"))
query("keep_last", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) SELECT user_id, event_id, event_type FROM r WHERE k = 1")(lambda s, d: R.keep_last(data.table(s, d, "events"), "user_id", "event_id").select("user_id", "event_id", "event_type"))
query("open_failures", with_(*D, "f AS (SELECT DISTINCT cell, dataset, method FROM results WHERE seed <> 0)", select="SELECT f.cell, f.dataset, f.method FROM f ANTI JOIN (SELECT cell FROM results WHERE seed = 1) r ON r.cell = f.cell"))(lambda s, d: (lambda r: R.open_failures(r.where("seed <> 0").select("cell", "dataset", "method", F.lit(1).alias("ingest_seq")), r.where("seed = 1")))(results(s, d)).select("cell", "dataset", "method"))
query("unpivot_scores", "SELECT p_partkey, 'p_retailprice' AS metric, p_retailprice AS value FROM part UNION ALL SELECT p_partkey, 'size', p_size::DOUBLE FROM part")(lambda s, d: R.unpivot_scores(data.table(s, d, "part").select("p_partkey", "p_retailprice", F.col("p_size").cast("double").alias("size")), ["p_partkey"], ["p_retailprice", "size"]))
query("drop_null_target", "SELECT doc_id, quality FROM labels WHERE quality IS NOT NULL")(lambda s, d: DS.drop_null_target(data.table(s, d, "labels"), "quality").select("doc_id", "quality"))
query("describe_dataset", "SELECT count(*) AS n_rows, 3 AS n_features, round(0.0::DOUBLE, 6) AS missing, count(DISTINCT p_retailprice) AS n_targets, min(p_retailprice) AS low, max(p_retailprice) AS high FROM part")(lambda s, d: DS.describe(data.table(s, d, "part"), "p_retailprice", ["p_brand", "p_type", "p_size"]).withColumn("missing", F.round("missing", 6)))
query("parse_methods", "WITH m AS (SELECT DISTINCT p_brand AS b FROM part), n AS (SELECT 'local_mix_r0.' || right(b, 1) || '+gate' AS method FROM m UNION ALL SELECT b || '_corrected' FROM m) SELECT method, regexp_replace(method, '(\\+.*|_corrected)$', '') AS base, coalesce(try_cast(nullif(regexp_extract(method, '^local_mix_r([0-9.]+)', 1), '') AS DOUBLE), NULL) AS ratio, method LIKE 'local_mix%' OR method LIKE 'crumb%' AS transductive FROM n")(lambda s, d: __import__("tessera.plans.runner", fromlist=["x"]).method_table((lambda m: m.select(F.concat(F.lit("local_mix_r0."), F.right("b", F.lit(1)), F.lit("+gate")).alias("method")).union(m.select(F.concat("b", F.lit("_corrected")))))(data.table(s, d, "part").select(F.col("p_brand").alias("b")).distinct())))
query("synthetic_classes")(lambda s, d: DS.make_synthetic(s, 1000, 4, 3, noise=0.1, seed=1).groupBy("y").agg(F.count("*").alias("n")))
query("synthetic_regression")(lambda s, d: DS.make_synthetic(s, 1000, 4, task="regression", noise=0.1, seed=1, heavy_tail=True).select(F.count("*").alias("n"), F.round(F.avg("y"), 3).alias("mean")))


def _run_sql() -> str:
    ctes, parts = [*CLF, P, "tr AS (SELECT row_id, y FROM test)"], []
    for k in (1, 4):
        ctes += [f"o{k} AS (SELECT * FROM outs WHERE est < {k})", f"p{k} AS (SELECT * FROM pr WHERE est < {k})"]
        ctes += [f"mean{k} AS (SELECT row_id, cls, avg(p) AS p FROM p{k} GROUP BY row_id, cls)", f"lm{k} AS (SELECT row_id, cls, avg(logit) AS logit FROM o{k} GROUP BY row_id, cls)", sql.proba(f"lm{k}", f"logit_mean{k}", "row_id"), f"med{k} AS (SELECT row_id, cls, quantile_cont(p, 0.5) AS p, avg(p) AS q FROM p{k} GROUP BY row_id, cls)", sql.renorm(f"med{k}", f"median{k}")]
        for rule in ("mean", "logit_mean", "median"):
            n = f"{rule}{k}"
            ctes.append(f"t_{n} AS (SELECT row_id, cls AS c, p AS conf FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY p DESC, cls) AS z FROM {n}) WHERE z = 1)")
            ctes.append(f"u_{n} AS (SELECT cls, p, (y = cls)::INTEGER AS hit, rank() OVER (PARTITION BY cls ORDER BY p) + (count(*) OVER (PARTITION BY cls, p) - 1) / 2.0::DOUBLE AS r FROM {n} JOIN tr USING (row_id))")
            ctes.append(f"v_{n} AS (SELECT CASE WHEN sum(hit) > 0 AND sum(hit) < count(*) THEN (sum(r) FILTER (hit = 1) - sum(hit) * (sum(hit) + 1) / 2.0::DOUBLE) / (sum(hit)::DOUBLE * (count(*) - sum(hit))) END AS area FROM u_{n} GROUP BY cls)")
            ctes.append(f"e_{n} AS (SELECT count(*) AS n, avg((c = y)::INTEGER) AS acc, avg(conf) AS conf FROM t_{n} JOIN tr USING (row_id) GROUP BY least(floor(conf * 15), 14))")
            head = f"SELECT '{rule}' AS method, {k} AS n_estimators"
            parts += [f"{head}, 'log_loss' AS metric, round(-avg(ln(least(greatest(p, 1e-15), 1))), 6) AS value FROM {n} JOIN tr ON tr.row_id = {n}.row_id AND tr.y = {n}.cls", f"{head}, 'accuracy', round(avg((c = y)::INTEGER), 6) FROM t_{n} JOIN tr USING (row_id)", f"{head}, 'roc_auc', round(avg(area), 6) FROM v_{n}", f"{head}, 'ece', round(sum(n * abs(acc - conf)) / sum(n), 6) FROM e_{n}"]
    return with_(*ctes, select=" UNION ALL ".join(parts))


@query("run_aggregation", _run_sql())
def run_aggregation(s, d):
    from .runner import run_aggregation as run

    c = data.clf(s, d)
    return run({"vectors": c}, ["mean", "logit_mean", "median"], [1, 4], [0]).select("method", "n_estimators", "metric", "value")


def _seeds_sql() -> str:
    ctes, parts = [*CLF, "tr AS (SELECT row_id, y FROM test)"], []
    for seed in (0, 1):
        ctes += [sql.context("train", f"cx{seed}", data.CONTEXT, data.ESTIMATORS, seed), sql.centroid("train", "test", f"cx{seed}", f"os{seed}"), sql.proba(f"os{seed}", f"ps{seed}"), f"ms{seed} AS (SELECT row_id, cls, avg(p) AS p FROM ps{seed} GROUP BY row_id, cls)", sql.scores(f"ms{seed}", f"sc{seed}")]
        parts.append(f"SELECT {seed} AS seed, metric, value FROM sc{seed}")
    return with_(*ctes, select=" UNION ALL ".join(parts))


@query("run_aggregation_seeds", _seeds_sql())
def run_aggregation_seeds(s, d):
    """Each seed has contexts and a fit of its own."""
    from ..operators.backends import CentroidBackend
    from ..operators.subsets import subsets
    from .runner import run_aggregation as run

    c = data.clf(s, d)
    fit = lambda c, seed: CentroidBackend(data.ESTIMATORS).clf_outputs(c["train"], subsets(c["train"], "perest_random", data.CONTEXT, data.ESTIMATORS, seed), c["test"])
    return run({"vectors": c}, ["mean"], [data.ESTIMATORS], [0, 1], fit).select("seed", "metric", "value")


def _coreset_sql() -> str:
    ctes, parts = [*CLF, "tr AS (SELECT row_id, y FROM test)", "e2 AS (SELECT unnest([0, 1])::INTEGER AS est)", "nn AS (SELECT count(*) AS n FROM train)", "zt AS (SELECT y AS grp, count(*) AS n FROM train GROUP BY y)"], []
    for method, key, f in [("full", "full", None), ("random", "f0.2", 0.2), ("random", "f0.5", 0.5), ("stratified", "f0.2", 0.2), ("stratified", "f0.5", 0.5)]:
        n = f"{method}{key[1:].replace('.', '') if f else ''}"
        budget = f"(SELECT greatest(2, round_even(n * {f}::DOUBLE, 0)::BIGINT) FROM nn)"
        if method == "full":
            ctes.append(f"c_{n} AS (SELECT est, row_id FROM train CROSS JOIN e2)")
        elif method == "random":
            ctes.append(f"c_{n} AS (SELECT est, row_id FROM (SELECT row_id, row_number() OVER (ORDER BY {sql.h(0, 'random', 'row_id')}, row_id) AS k FROM train) CROSS JOIN e2 WHERE k <= {budget})")
        else:
            ctes += [sql.allocate(f"a_{n}", "zt", budget, True), f"c_{n} AS (SELECT est, row_id FROM (SELECT row_id, y, row_number() OVER (PARTITION BY y ORDER BY {sql.h(0, 'stratified', 'row_id')}, row_id) AS k FROM train) JOIN a_{n} ON grp = y CROSS JOIN e2 WHERE k <= take)"]
        ctes += [sql.centroid("train", "test", f"c_{n}", f"o_{n}", 2), sql.proba(f"o_{n}", f"p_{n}"), f"m_{n} AS (SELECT row_id, cls, avg(p) AS p FROM p_{n} GROUP BY row_id, cls)", sql.scores(f"m_{n}", f"s_{n}")]
        b = "(SELECT n FROM nn)" if f is None else budget
        parts.append(f"SELECT '{method}' AS method, '{key}' AS budget_key, {b}::DOUBLE AS budget, metric, value FROM s_{n}")
    return with_(*ctes, select=" UNION ALL ".join(parts))


@query("run_coreset", _coreset_sql())
def run_coreset(s, d):
    from .runner import run_coreset as run

    return run(data.vectors(s, d), "vectors", ["random", "stratified"], {"f0.2": 0.2, "f0.5": 0.5}, [0]).select("method", "budget_key", "budget", "metric", "value")


@query("run_coreset_methods")
def run_coreset_methods(s, d):
    """Contexts that differ between estimators or rows, with the rows that go with them."""
    from .runner import run_coreset as run

    return run(data.vectors(s, d), "vectors", ["perest_random", "cluster_experts", "local_mix_r0.9"], {"f0.2": 0.2}, [0], combined_aggregators=["median"], local_groups=2).select("method", "budget_key", "role", "flags", "metric", "value")


# reports: three seeds, so paired differences have two degrees of freedom
_T2 = "CASE WHEN n >= 2 AND sd > 0 THEN " + sql.t_tail2("(m / (sd / sqrt(n)))") + " END"
_SIGN = "CASE WHEN metric = 'accuracy' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END"


def _holm_sql(src: str, tie: str) -> str:
    return f"hx AS (SELECT *, least(1, (count(*) OVER () - row_number() OVER (ORDER BY p, {tie}) + 1) * p) AS a FROM {src} WHERE p IS NOT NULL), hy AS (SELECT * EXCLUDE (a), max(a) OVER (ORDER BY p, {tie} ROWS UNBOUNDED PRECEDING) AS p_holm FROM hx UNION ALL SELECT *, NULL FROM {src} WHERE p IS NULL)"


_DEV = [
    *D, f"dp AS (SELECT r.dataset, r.budget, r.metric, r.method, r.value, CASE WHEN r.method <> 'random' THEN (r.value - b.value) * {_SIGN.replace('metric', 'r.metric')} END AS imp FROM results r LEFT JOIN results b ON b.method = 'random' AND b.dataset = r.dataset AND b.budget = r.budget AND b.metric = r.metric AND b.seed = r.seed)",
    "da AS (SELECT dataset, budget, metric, method, count(value) AS nv, avg(value) AS mean, stddev_samp(value) / sqrt(count(value)) AS se, count(imp) AS n, avg(imp) AS m, stddev_samp(imp) AS sd FROM dp GROUP BY ALL)",
    f"db AS (SELECT *, {_T2} AS p FROM da)", _holm_sql("db", "dataset, budget, metric, method"),
]


@query("dev_table", with_(*_DEV, select="SELECT dataset, budget, metric, method, nv AS n, round(mean, 5) AS mean, round(se, 5) AS se, CASE WHEN n >= 2 THEN round(m, 5) END AS improvement, round(p, 5) AS p, round(p_holm, 4) AS p_holm FROM hy"))
def dev_table(s, d):
    from . import analysis

    out = analysis.dev_table(results(s, d))
    return out.select("dataset", "budget", "metric", "method", "n", *[F.round(c, 5).alias(c) for c in ("mean", "se", "improvement", "p")], F.round("p_holm", 4).alias("p_holm"))


_STEP = [
    *D, "lv AS (SELECT dataset, method, metric, budget, lead(budget) OVER (PARTITION BY dataset, method, metric ORDER BY budget) AS nx FROM (SELECT DISTINCT dataset, method, metric, budget FROM results))",
    f"sp AS (SELECT a.dataset, a.method, a.metric, a.budget, lv.nx, a.value AS va, b.value AS vb, (b.value - a.value) * {_SIGN.replace('metric', 'a.metric')} AS imp FROM results a JOIN lv ON lv.dataset = a.dataset AND lv.method = a.method AND lv.metric = a.metric AND lv.budget = a.budget JOIN results b ON b.dataset = a.dataset AND b.method = a.method AND b.metric = a.metric AND b.budget = lv.nx AND b.seed = a.seed)",
    "sa AS (SELECT dataset, method, metric, budget, nx, count(*) AS n, avg(va) AS va, avg(vb) AS vb, avg(imp) AS m, stddev_samp(imp) AS sd FROM sp GROUP BY ALL)", f"sb AS (SELECT *, {_T2} AS p FROM sa)",
]


@query("step_table", with_(*_STEP, select="SELECT dataset, method, metric, budget AS budget_from, nx AS budget_to, n AS n_seeds, round(va, 5) AS value_from, round(vb, 5) AS value_to, round(m, 5) AS improvement, round(sd / sqrt(n), 5) AS se, round(p, 5) AS p FROM sb"))
def step_table(s, d):
    from . import analysis

    out = analysis.step_table(results(s, d), "budget")
    return out.select("dataset", "method", "metric", "budget_from", "budget_to", "n_seeds", *[F.round(c, 5).alias(c) for c in ("value_from", "value_to", "improvement", "se", "p")])


_RANKS = [
    *D, _FAM, _PAIR, f"sg AS (SELECT *, diff * {_SIGN} AS imp FROM pd)", "nz AS (SELECT *, rank() OVER w + (count(*) OVER v - 1) / 2.0 AS r, count(*) OVER u AS n, count(*) OVER v AS t FROM sg WHERE imp <> 0 WINDOW u AS (PARTITION BY method, baseline, budget_key, metric), w AS (PARTITION BY method, baseline, budget_key, metric ORDER BY abs(imp)), v AS (PARTITION BY method, baseline, budget_key, metric, abs(imp)))",
    "wr AS (SELECT method, baseline, budget_key, metric, n, sum(CASE WHEN imp > 0 THEN r ELSE 0 END) AS w, max(t) AS t, list(r ORDER BY r) AS rs FROM nz GROUP BY ALL)",
    "wp AS (SELECT w.*, (SELECT count(*) FROM (SELECT unnest(range(0, (1 << w.n)::BIGINT)) AS b) x WHERE (SELECT coalesce(sum(i), 0) FROM (SELECT unnest(range(1, w.n + 1)) AS i) y WHERE (x.b >> (i - 1)::BIGINT) & 1 = 1) <= least(w, n * (n + 1) / 2.0 - w)) AS ways FROM wr w)",
]


@query("wilcoxon", with_(*_RANKS, select="SELECT method, baseline, budget_key, metric, round(least(1, 2 * ways / pow(2, n)), 6)::DOUBLE AS p_wilcoxon FROM wp WHERE t = 1 AND n = 5"))
def wilcoxon(s, d):
    """Signed-rank test of each comparison of five datasets without ties."""
    d = T.paired(results(s, d), family(s)).withColumn("imp", F.col("diff") * T.orientation(F.col("metric")))
    one = d.groupBy(*T.GROUP).agg(F.collect_list("imp").alias("d"), F.count_distinct(F.abs("imp")).alias("k"), F.count_if(F.col("imp") != 0).alias("n")).where("k = 5 and n = 5")
    return one.select(*T.GROUP, F.round(T.wilcoxon(F.col("d")), 6).alias("p_wilcoxon"))


@query("analyze_aggregation")
def analyze_aggregation(s, d):
    from . import analysis
    from .runner import run_aggregation as run

    return analysis.analyze_aggregation(run({"vectors": data.clf(s, d)}, ["mean", "logit_mean"], [1, 4], [0]), n_boot=50).select("method", "metric", "n_estimators", "task", "n_datasets", "mean_diff")


@query("saturated_cells", with_(*D, _FP, _SAT, select="SELECT DISTINCT r.dataset, r.budget, r.metric FROM results r JOIN sa s ON s.dataset = r.dataset AND s.budget = r.budget AND s.metric = r.metric WHERE r.method <> 'full'"))
def saturated_cells(s, d):
    from . import analysis

    return analysis.analyze_coreset(results(s, d), n_boot=50)["saturated_cells"]


query("dev_table_cost", with_(*D, "tm AS (SELECT DISTINCT cell, dataset, method, budget FROM results)", select="SELECT r.dataset, r.method, r.metric, r.budget, round(c.total_s, 5) AS total_s FROM (SELECT DISTINCT dataset, method, metric, budget FROM results) r LEFT JOIN (SELECT dataset, method, avg(budget / 1000) AS total_s FROM tm GROUP BY dataset, method) c USING (dataset, method)"))(lambda s, d: _cost(s, d))


def _cost(s, d):
    from . import analysis

    return analysis.dev_table(results(s, d), "random", timing(s, d).withColumn("n_fits", F.lit(1))).select("dataset", "method", "metric", "budget", F.round("total_s", 5).alias("total_s"))
