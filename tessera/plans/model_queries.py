"""Queries of ensemble aggregation, densities and scores, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregation as A
from ..operators import distribution as D
from ..operators import metrics as M
from ..operators.encode import class_prior, prior_correct
from . import data, sql
from .sql import CLF, MEAN, REG, SHOW, VAL, P, with_

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def _p(pred):
    return pred.select("row_id", "cls", F.round("p", 6).alias("p"))


query("clf_outputs", with_(*CLF, select="SELECT row_id, est, cls, round(logit, 6) AS logit FROM outs"))(lambda s, d: data.clf(s, d)["out"].select("row_id", "est", "cls", F.round("logit", 6).alias("logit")))
query("agg_mean", with_(*CLF, P, MEAN, select=SHOW))(lambda s, d: _p(A.aggregate_clf("mean", data.clf(s, d)["out"])))
query("agg_logit_mean", with_(*CLF, "lm AS (SELECT row_id, cls, avg(logit) AS logit FROM outs GROUP BY row_id, cls)", sql.proba("lm", "pred", "row_id"), select=SHOW))(lambda s, d: _p(A.aggregate_clf("logit_mean", data.clf(s, d)["out"])))
query("agg_median", with_(*CLF, P, "med AS (SELECT row_id, cls, quantile_cont(p, 0.5) AS p, avg(p) AS q FROM pr GROUP BY row_id, cls)", sql.renorm("med", "pred"), select=SHOW))(lambda s, d: _p(A.aggregate_clf("median", data.clf(s, d)["out"])))
query("agg_trimmed_mean", with_(*CLF, P, "rk AS (SELECT *, row_number() OVER (PARTITION BY row_id, cls ORDER BY p, est) AS rn, count(*) OVER (PARTITION BY row_id, cls) AS e FROM pr)", "tm AS (SELECT row_id, cls, avg(p) AS p, NULL::DOUBLE AS q FROM rk WHERE rn > floor(0.3::DOUBLE * e) AND rn <= e - floor(0.3::DOUBLE * e) GROUP BY row_id, cls)", sql.renorm("tm", "pred"), select=SHOW))(lambda s, d: _p(A.aggregate_clf("trimmed_mean", data.clf(s, d)["out"], trim=0.3)))
_ENT = "hs AS (SELECT row_id, est, sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END) AS hh FROM pr GROUP BY row_id, est), wx AS (SELECT row_id, est, exp(-hh - max(-hh) OVER (PARTITION BY row_id)) AS w FROM hs)"
query("agg_entropy_weighted", with_(*CLF, P, _ENT, "ew AS (SELECT row_id, cls, sum(w * p) / sum(w) AS p, NULL::DOUBLE AS q FROM pr JOIN wx USING (row_id, est) GROUP BY row_id, cls)", sql.renorm("ew", "pred"), select=SHOW))(lambda s, d: _p(A.aggregate_clf("entropy_weighted", data.clf(s, d)["out"])))
query("agg_weighted", with_(*CLF, P, "pred AS (SELECT row_id, cls, sum([1, 2, 3, 4][est + 1] * p) / sum([1, 2, 3, 4][est + 1]) AS p FROM pr GROUP BY row_id, cls)", select=SHOW))(lambda s, d: _p(A.aggregate_clf("weighted", data.clf(s, d)["out"], weights=[1, 2, 3, 4])))
_LOSS = "vl AS (SELECT est, -avg(ln(least(greatest(p, 1e-15), 1))) AS loss FROM vpr JOIN vtest t ON t.row_id = vpr.row_id AND t.y = vpr.cls GROUP BY est)"


@query("agg_val_weighted", with_(*CLF, P, *VAL, sql.proba("vouts", "vpr"), _LOSS, "vw AS (SELECT est, exp(-loss / 0.1 - max(-loss / 0.1) OVER ()) AS w FROM vl)", "pred AS (SELECT row_id, cls, sum(w * p) / sum(w) AS p FROM pr JOIN vw USING (est) GROUP BY row_id, cls)", select=SHOW))
def agg_val_weighted(s, d):
    v = data.clf(s, d, validation=True)
    return _p(A.aggregate_clf("val_weighted", data.clf(s, d)["out"], val_out=v["out"], val_truth=v["truth"]))


@query("estimator_log_losses", with_(*CLF, *VAL, sql.proba("vouts", "vpr"), _LOSS, select="SELECT est, round(loss, 6) AS loss FROM vl"))
def estimator_log_losses(s, d):
    v = data.clf(s, d, validation=True)
    return A.estimator_log_losses(v["out"], v["truth"]).select("est", F.round("loss", 6).alias("loss"))


_GRID = "grid AS (SELECT unnest([0.05, 0.2, 1.0, 4.0, 20.0])::DOUBLE AS s)"


@query("agg_temp_grid", with_(*CLF, _GRID, "gz AS (SELECT s, o.*, exp((logit - max(logit) OVER (PARTITION BY s, row_id, est)) / s) AS z FROM outs o CROSS JOIN grid)", "gp AS (SELECT *, z / sum(z) OVER (PARTITION BY s, row_id, est) AS p FROM gz)", "gm AS (SELECT s, row_id, cls, avg(p) AS p FROM gp GROUP BY s, row_id, cls)", select="SELECT s, round(-avg(ln(least(greatest(p, 1e-15), 1))), 6) AS loss FROM gm JOIN test t ON t.row_id = gm.row_id AND t.y = gm.cls GROUP BY s"))
def agg_temp_grid(s, d):
    c = data.clf(s, d)
    loss = A._mean_loss_at(c["out"], c["truth"], 1.0, [0.05, 0.2, 1.0, 4.0, 20.0])
    return s.createDataFrame([(k, round(v, 6)) for k, v in loss.items()], "s double, loss double")


@query("agg_mean_temp_offline")
def agg_mean_temp_offline(s, d):
    v = data.clf(s, d, validation=True)
    return _p(A.aggregate_clf("mean_temp_offline", data.clf(s, d)["out"], val_out=v["out"], val_truth=v["truth"]))


_GATE = "gate AS (SELECT DISTINCT row_id, est, 1.0::DOUBLE + (row_id + est) % 3 AS w FROM outs)"
query("agg_sample_weighted", with_(*CLF, P, _GATE, "pred AS (SELECT row_id, cls, sum(w * p) / sum(w) AS p FROM pr JOIN gate USING (row_id, est) GROUP BY row_id, cls)", select=SHOW))(lambda s, d: (lambda o: _p(A.sample_weighted(o, data.gate(o))))(data.clf(s, d)["out"]))
query("agg_single", with_(*CLF, P, "pred AS (SELECT row_id, cls, p FROM pr WHERE est = 0)", select=SHOW))(lambda s, d: _p(A.single(data.clf(s, d)["out"])))
query("agg_first_estimators", with_(*CLF, P, "pred AS (SELECT row_id, cls, avg(p) AS p FROM pr WHERE est < 2 GROUP BY row_id, cls)", select=SHOW))(lambda s, d: _p(A.mean(A.first_estimators(data.clf(s, d)["out"], 2))))
_PRIOR = "cp AS (SELECT k.cls, count(c.row_id)::DOUBLE / (SELECT count(*) FROM cx) AS c FROM (SELECT DISTINCT y AS cls FROM train) k LEFT JOIN cx c ON c.y = k.cls GROUP BY k.cls), tp AS (SELECT y AS cls, count(*)::DOUBLE / (SELECT count(*) FROM train) AS t FROM train GROUP BY y)"


@query("prior_correct", with_(*CLF, P, MEAN, "cx AS (SELECT t.row_id, t.y FROM train t JOIN ctx ON ctx.row_id = t.row_id AND ctx.est = 0)", _PRIOR, "pq AS (SELECT row_id, cls, p, CASE WHEN c > 0 THEN p * t / c ELSE 0 END AS q FROM pred JOIN cp USING (cls) JOIN tp USING (cls))", select="SELECT row_id, cls, round(CASE WHEN s > 0 THEN q / s ELSE p END, 6) AS p FROM (SELECT *, sum(q) OVER (PARTITION BY row_id) AS s FROM pq)"))
def prior_corrected(s, d):
    c = data.clf(s, d)
    classes = c["train"].select(F.col("y").alias("cls")).distinct()
    own = c["train"].join(c["context"].where("est = 0"), "row_id")
    return _p(prior_correct(A.mean(c["out"]), class_prior(own, classes), class_prior(c["train"], classes)))


# scores
_T = "tr AS (SELECT row_id, y FROM test)"
_TOP = "top AS (SELECT row_id, cls AS c, p AS conf FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY p DESC, cls) AS k FROM pred) WHERE k = 1)"
_AUC = """au AS (SELECT cls, p, (y = cls)::INTEGER AS hit, rank() OVER (PARTITION BY cls ORDER BY p) + (count(*) OVER (PARTITION BY cls, p) - 1) / 2.0::DOUBLE AS r FROM pred JOIN tr USING (row_id)),
ar AS (SELECT cls, CASE WHEN sum(hit) > 0 AND sum(hit) < count(*) THEN (sum(r) FILTER (hit = 1) - sum(hit) * (sum(hit) + 1) / 2.0::DOUBLE) / (sum(hit)::DOUBLE * (count(*) - sum(hit))) END AS area FROM au GROUP BY cls)"""
_ECE = "ec AS (SELECT least(floor(conf * 15), 14) AS b, count(*) AS n, avg((c = y)::INTEGER) AS acc, avg(conf) AS conf FROM top JOIN tr USING (row_id) GROUP BY 1)"
_SCORES = """SELECT 'log_loss' AS metric, round(-avg(ln(least(greatest(p, 1e-15), 1))), 6) AS value FROM pred JOIN tr ON tr.row_id = pred.row_id AND tr.y = pred.cls
UNION ALL SELECT 'accuracy', round(avg((c = y)::INTEGER), 6) FROM top JOIN tr USING (row_id)
UNION ALL SELECT 'roc_auc', round(avg(area), 6) FROM ar
UNION ALL SELECT 'ece', round(sum(n * abs(acc - conf)) / sum(n), 6) FROM ec"""


@query("metric_classification", with_(*CLF, P, MEAN, _T, _TOP, _AUC, _ECE, select=_SCORES))
def metric_classification(s, d):
    c = data.clf(s, d)
    pred = A.mean(c["out"])
    return M.score_classification(pred, c["truth"]).select("metric", F.round("value", 6).alias("value"))


@query("metric_brier", with_(*CLF, P, MEAN, _T, select="SELECT round(avg(b), 6) AS brier FROM (SELECT row_id, sum((p - (y = cls)::INTEGER) * (p - (y = cls)::INTEGER)) AS b FROM pred JOIN tr USING (row_id) GROUP BY row_id)"))
def metric_brier(s, d):
    c = data.clf(s, d)
    return M.brier(A.mean(c["out"]), c["truth"]).select(F.round("brier", 6).alias("brier"))


_EK = "SELECT e.k AS n_estimators, pr.* FROM pr CROSS JOIN (SELECT unnest([1, 2, 4]) AS k) e WHERE pr.est < e.k"


@query("flagship", with_(*CLF, P, _T, f"ek AS ({_EK})", "pm AS (SELECT n_estimators, row_id, cls, avg(p) AS p FROM ek GROUP BY ALL)", "pt AS (SELECT n_estimators, row_id, cls, p, row_number() OVER (PARTITION BY n_estimators, row_id ORDER BY p DESC, cls) AS k FROM pm)", select="""SELECT n_estimators, 'accuracy' AS metric, round(avg((cls = y)::INTEGER), 6) AS value FROM pt JOIN tr USING (row_id) WHERE k = 1 GROUP BY n_estimators
UNION ALL SELECT n_estimators, 'log_loss', round(-avg(ln(least(greatest(p, 1e-15), 1))), 6) FROM pm JOIN tr ON tr.row_id = pm.row_id AND tr.y = pm.cls GROUP BY n_estimators"""))
def flagship(s, d):
    """All ensemble sizes from one fit: the mean rule, scored."""
    c = data.clf(s, d)
    each = A.proba(c["out"]).withColumn("n_estimators", F.explode(F.filter(F.array(F.lit(1), F.lit(2), F.lit(4)), lambda k: k > F.col("est"))))
    pred = each.groupBy("n_estimators", "row_id", "cls").agg(F.avg("p").alias("p"))
    by = ("n_estimators",)
    out = M.accuracy(pred, c["truth"], by).select(*by, F.lit("accuracy").alias("metric"), F.round("accuracy", 6).alias("value"))
    return out.union(M.log_loss(pred, c["truth"], by).select(*by, F.lit("log_loss").alias("metric"), F.round("log_loss", 6).alias("value")))


# regression
_LV = data.QUARTERS
_MIX = "mx AS (SELECT row_id, bin, avg(p) AS p FROM outs GROUP BY row_id, bin)"
_LOGP = "lp0 AS (SELECT row_id, bin, CASE WHEN min(p) > 0 THEN exp(avg(ln(p))) ELSE 0 END AS p FROM outs GROUP BY row_id, bin), lp AS (SELECT row_id, bin, p / sum(p) OVER (PARTITION BY row_id) AS p FROM lp0)"
_Q = "SELECT row_id, level, round(q, 4) AS q FROM qs"


def _q(out):
    return out["quantiles"].select("row_id", "level", F.round("q", 4).alias("q"))


def _agg(name):
    def run(s, d):
        r = data.reg(s, d)
        return _q(A.aggregate_reg(name, r["out"], r["bins"], _LV))

    return run


query("reg_outputs", with_(*REG, select="SELECT row_id, est, bin, round(p, 6) AS p FROM outs"))(lambda s, d: data.reg(s, d)["out"].select("row_id", "est", "bin", F.round("p", 6).alias("p")))
query("reg_mixture", with_(*REG, _MIX, sql.quantiles("mx", "qs", _LV), select=_Q))(_agg("mixture"))
query("reg_log_pool", with_(*REG, _LOGP, sql.quantiles("lp", "qs", _LV), select=_Q))(_agg("log_pool"))
query("reg_quantile_mean", with_(*REG, sql.quantiles("outs", "qe", _LV, "row_id, est"), "qs AS (SELECT row_id, level, avg(q) AS q FROM qe GROUP BY row_id, level)", select=_Q))(_agg("quantile_mean"))
query("reg_quantile_median", with_(*REG, sql.quantiles("outs", "qe", _LV, "row_id, est"), "qs AS (SELECT row_id, level, quantile_cont(q, 0.5) AS q FROM qe GROUP BY row_id, level)", select=_Q))(_agg("quantile_median"))
query("reg_icdf", with_(*REG, "oz AS (SELECT * FROM outs WHERE est = 0)", sql.quantiles("oz", "qs", _LV), select=_Q))(lambda s, d: (lambda r: _q({"quantiles": D.quantiles(r["out"].where("est = 0"), r["bins"], _LV)}))(data.reg(s, d)))


@query("reg_sample_weighted_mixture", with_(*REG, _GATE, "sw AS (SELECT row_id, bin, sum(w * p) / sum(w) AS p FROM outs JOIN gate USING (row_id, est) GROUP BY row_id, bin)", sql.quantiles("sw", "qs", _LV), select=_Q))
def reg_sample_weighted(s, d):
    r = data.reg(s, d)
    return _q(A.sample_weighted_mixture(r["out"], r["bins"], data.gate(r["out"]), _LV))


_RM = "rm AS (SELECT row_id, sum(p * (lo + hi) / 2.0::DOUBLE) / sum(p) AS mean FROM mx JOIN bins USING (bin) GROUP BY row_id)"


@query("metric_regression", with_(*REG, _MIX, _RM, sql.quantiles("mx", "qs", _LV), select="""SELECT 'rmse' AS metric, round(sqrt(avg((mean - y) * (mean - y))), 4) AS value FROM rm JOIN test USING (row_id)
UNION ALL SELECT 'crps', round(2 * avg(greatest(level * (y - q), (level - 1) * (y - q))), 4) FROM qs JOIN test USING (row_id)"""))
def metric_regression(s, d):
    r = data.reg(s, d)
    got = A.aggregate_reg("mixture", r["out"], r["bins"], _LV)
    return M.score_regression(got["mean"], got["quantiles"], r["truth"]).select("metric", F.round("value", 4).alias("value"))


_DEN = "ld AS (SELECT t.row_id, CASE WHEN m.p > 0 THEN ln(m.p) - ln(b.hi - b.lo) ELSE '-inf'::DOUBLE END AS ld FROM test t JOIN bins b ON (t.y > b.lo OR b.bin = (SELECT min(bin) FROM bins)) AND (t.y <= b.hi OR b.bin = (SELECT max(bin) FROM bins)) JOIN mx m ON m.row_id = t.row_id AND m.bin = b.bin)"


@query("reg_log_density", with_(*REG, _MIX, _DEN, select="SELECT row_id, round(ld, 6) AS log_density FROM ld"))
def reg_log_density(s, d):
    r = data.reg(s, d)
    return D.log_density(A.mixture(r["out"], r["bins"], _LV)["bins"], r["bins"], r["truth"]).select("row_id", F.round("log_density", 6).alias("log_density"))


@query("metric_nll_coverage", with_(*REG, _MIX, _DEN, sql.quantiles("mx", "qs", _LV), select="""SELECT 'nll' AS metric, round(-avg(ld), 6) AS value FROM ld
UNION ALL SELECT 'coverage', round(avg((y BETWEEN lo AND hi)::INTEGER), 6) FROM (SELECT row_id, min(q) AS lo, max(q) AS hi FROM qs WHERE level IN (0.05, 0.95) GROUP BY row_id) JOIN test USING (row_id)"""))
def metric_nll_coverage(s, d):
    r = data.reg(s, d)
    got = A.mixture(r["out"], r["bins"], _LV)
    nll = M.nll(D.log_density(got["bins"], r["bins"], r["truth"]))
    cov = M.coverage(got["quantiles"], r["truth"])
    return nll.select(F.lit("nll").alias("metric"), F.round("nll", 6).alias("value")).union(cov.select(F.lit("coverage"), F.round("coverage", 6)))


_TO = "tb AS (SELECT unnest([0, 1, 2]) AS tb, unnest(['-inf'::DOUBLE, 1200.0, 1500.0]) AS tlo, unnest([1200.0, 1500.0, 'inf'::DOUBLE]) AS thi)"


@query("reg_rebin", with_(*REG, _MIX, _TO, select="SELECT row_id, tb AS bin, round(sum(p * (least(hi, thi) - greatest(lo, tlo)) / (hi - lo)), 6) AS p FROM mx JOIN bins USING (bin) JOIN tb ON lo < thi AND hi > tlo GROUP BY row_id, tb"))
def reg_rebin(s, d):
    r = data.reg(s, d)
    to = s.createDataFrame([(0, 900.0, 1200.0), (1, 1200.0, 1500.0), (2, 1500.0, 2100.0)], "bin int, lo double, hi double")
    return D.translate(A.mixture(r["out"], r["bins"], _LV)["bins"], r["bins"], to).select("row_id", "bin", F.round("p", 6).alias("p"))


@query("model_forest")
def model_forest(s, d):
    from ..operators.backends import make_backend

    c = data.clf(s, d)
    out = make_backend({"name": "forest", "estimators": 2, "trees": 5}).clf_outputs(c["train"], c["context"].where("est < 2"), c["test"])
    return _p(A.mean(out))
