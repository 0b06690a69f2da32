"""Queries of experts, local fits and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import distribution as D
from ..operators import encode as E
from ..operators import experts as X
from ..operators import routing as R
from ..operators import selection as S
from . import data, sql
from .model_queries import _p
from .selection_queries import _LM, _SPLITV, ORACLES as _SEL, _d2, _lloyd, _near, _parts  # noqa: F401
from .sql import h, with_

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def _fit(context: str, name: str) -> str:
    """Outputs of class means of each context, all features."""
    return f"""
{name}_l AS (SELECT row_id, y, unnest(f) AS x, generate_subscripts(f, 1) - 1 AS pos FROM train),
{name}_m AS (SELECT c.est, l.y AS cls, l.pos, avg(l.x) AS m FROM {name}_l l JOIN {context} c USING (row_id) GROUP BY c.est, l.y, l.pos),
{name}_q AS (SELECT row_id, unnest(f) AS x, generate_subscripts(f, 1) - 1 AS pos FROM test),
{name}_o AS (SELECT q.row_id, m.est, m.cls, -sum((q.x - m.m) * (q.x - m.m)) / count(*) AS logit FROM {name}_q q JOIN {name}_m m USING (pos) GROUP BY q.row_id, m.est, m.cls),
{name} AS (SELECT g.row_id, g.est, k.cls, coalesce(o.logit, -50::DOUBLE) AS logit FROM (SELECT DISTINCT row_id, est FROM {name}_o) g
  CROSS JOIN (SELECT DISTINCT y AS cls FROM train) k LEFT JOIN {name}_o o ON o.row_id = g.row_id AND o.est = g.est AND o.cls = k.cls)"""


_EXP = [
    *_SPLITV, _lloyd("train", "ce", "5", "experts"), _near("train", "ce", "nt"), _near("test", "ce", "na"),
    f"ex AS (SELECT n.row_id, n.c AS own, z.c AS grp, {_d2('n.f', 'z.v')} AS dd, {h(0, 'expert', 'z.c', 'n.row_id')} AS hh FROM nt n CROSS JOIN ce z)",
    "ec AS (SELECT grp AS est, row_id FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY (own <> grp)::INTEGER, CASE WHEN own = grp THEN hh END NULLS FIRST, dd, row_id) AS p FROM ex) WHERE p <= 60)",
    "nb AS (SELECT c, other, slot FROM (SELECT a.c, b.c AS other, row_number() OVER (PARTITION BY a.c ORDER BY (a.c <> b.c)::INTEGER, " + _d2("a.v", "b.v") + ", b.c) - 1 AS slot FROM ce a CROSS JOIN ce b) WHERE slot < 2)",
    "rt AS (SELECT na.row_id, nb.slot, nb.other AS est, " + _d2("na.f", "z.v") + " AS d2 FROM na JOIN nb ON nb.c = na.c JOIN ce z ON z.c = nb.other)",
    "tau AS (SELECT CASE WHEN t > 0 THEN t ELSE 1 END AS tau FROM (SELECT quantile_cont(d2, 0.5) AS t FROM nt))",
    "gz AS (SELECT row_id, est, slot, exp(-(d2 - min(d2) OVER (PARTITION BY row_id)) / tau) AS w FROM rt CROSS JOIN tau)",
    _fit("ec", "eo"), sql.proba("eo", "pr"),
]
_MIXED = "SELECT pr.row_id, cls, round(sum(w * p) / sum(w), 6) AS p FROM pr JOIN gz ON gz.row_id = pr.row_id AND gz.est = pr.est {} GROUP BY pr.row_id, cls"


def _experts(hard: bool):
    def run(s, d):
        train, test = _parts(s, d)
        return _p(X.expert_mixture(train, test, 60, 2, 0, clusters=5, hard=hard))

    return run


query("experts_mixture", with_(*_EXP, select=_MIXED.format("")))(_experts(False))
query("experts_hard", with_(*_EXP, select=_MIXED.format("AND slot = 0")))(_experts(True))


@query("cluster_experts_tuned")
def cluster_experts_tuned(s, d):
    train, test = _parts(s, d)
    return _p(X.tuned_cluster_experts(train, test, 100, 3, 0, bias=True))


@query("local_mix_predictions", with_(*_LM, "lc AS (SELECT (grp * 100000 + est) AS est, row_id FROM lm)", "tn AS (SELECT * EXCLUDE (k) FROM (SELECT t.row_id, g.grp, row_number() OVER (PARTITION BY t.row_id ORDER BY " + _d2("t.f", "g.v") + ", g.grp) AS k FROM test t CROSS JOIN gr g) WHERE k = 1)", _fit("lc", "eo"), "own AS (SELECT eo.* FROM eo JOIN tn USING (row_id) WHERE est // 100000 = grp)", sql.proba("own", "pr"), select="SELECT row_id, cls, round(avg(p), 6) AS p FROM pr GROUP BY row_id, cls"))
def local_mix_predictions(s, d):
    train, test = _parts(s, d)
    return _p(X.local_predictions(train, test, R.local_mix(train, test, 50, 2, ratio=0.8, groups=2, seed=0)))


_RS = _SEL["sel_resampled"]


@query("resample_summary", f"WITH rs AS ({_RS}), m AS (SELECT context, count(*) AS n, avg(quality) AS mean FROM rs JOIN labels ON doc_id = row_id GROUP BY context) SELECT context, n, round(mean, 6) AS mean, round((SELECT mean FROM m WHERE context = 'full') - mean, 6) AS improvement FROM m")
def resample_summary(s, d):
    rows = data.graded(s, d)
    return X.resample_scores(rows, S.resampled(rows, 3, 0)).select("context", "n", F.round("mean", 6).alias("mean"), F.round("improvement", 6).alias("improvement"))


@query("distribution_tails", with_(*sql.REG, "mx AS (SELECT row_id, bin, avg(p) AS p FROM outs GROUP BY row_id, bin)", "bm AS (SELECT bin, CASE WHEN bin = (SELECT min(bin) FROM bins) THEN hi - (hi - lo) / 0.67449 * sqrt(2 / pi()) WHEN bin = (SELECT max(bin) FROM bins) THEN lo + (hi - lo) / 0.67449 * sqrt(2 / pi()) ELSE (lo + hi) / 2 END AS mid FROM bins)", select="SELECT row_id, round(sum(p * mid) / sum(p), 4) AS mean FROM mx JOIN bm USING (bin) GROUP BY row_id"))
def distribution_tails(s, d):
    r = data.reg(s, d)
    p = r["out"].groupBy("row_id", "bin").agg(F.avg("p").alias("p"))
    return D.mean(p, r["bins"], tails=True).select("row_id", F.round("mean", 4).alias("mean"))


query("distribution_borders", with_(*sql.REG[:7], select="SELECT bin, lo, hi FROM bins"))(lambda s, d: data.reg(s, d)["bins"])


@query("align_logits", "WITH t AS (SELECT o_custkey % 50 AS row_id, o_orderstatus AS cls, avg(o_totalprice) / 100000 AS logit FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL) SELECT g.row_id, 0 AS est, k.cls, round(coalesce(t.logit, -50), 6) AS logit FROM (SELECT DISTINCT row_id FROM t) g CROSS JOIN (SELECT DISTINCT o_orderstatus AS cls FROM orders) k LEFT JOIN t ON t.row_id = g.row_id AND t.cls = k.cls")
def align_logits(s, d):
    o = data.table(s, d, "orders")
    own = o.where("o_orderstatus <> 'P'").groupBy((F.col("o_custkey") % 50).alias("row_id"), F.lit(0).alias("est"), F.col("o_orderstatus").alias("cls")).agg((F.avg("o_totalprice") / 100000).alias("logit"))
    return E.align(own, o.select(F.col("o_orderstatus").alias("cls")).distinct()).select("row_id", "est", "cls", F.round("logit", 6).alias("logit"))
