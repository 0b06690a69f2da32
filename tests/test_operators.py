"""Contracts and hand-computed values of selection, aggregation, scores and routing."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import aggregation as A
from tessera.operators import cluster as C
from tessera.operators import distribution as D
from tessera.operators import grid as G
from tessera.operators import metrics as M
from tessera.operators import routing as R
from tessera.operators import selection as S
from tessera.operators import subsets as U
from tessera.operators.allocate import allocate
from tessera.operators.encode import prior_correct, split_rows
from tessera.sources.datasets import make_synthetic


@pytest.fixture(scope="module")
def rows(spark):
    return make_synthetic(spark, 300, 4, 3, imbalance=[0.8, 0.14, 0.06], seed=3).cache()


@pytest.mark.parametrize("method", [m for m in S.SELECTORS if m not in ("full", "uncertainty_mix")])
def test_selectors_keep_their_contract(rows, method):
    got = [r.row_id for r in S.select_context(rows, method, 40, 7).select("row_id").collect()]
    again = [r.row_id for r in S.select_context(rows.repartition(5), method, 40, 7).select("row_id").collect()]
    assert len(got) == len(set(got)) == 40 and set(got) == set(again) and set(got) <= set(range(300))
    if S.method_info(method)["covers_classes"] and method != "nested":
        assert S.select_context(rows, method, 40, 7).select("y").distinct().count() == 3
    assert S.select_context(rows, method, 999, 7).count() == 300 or method == "embedding_kmeans"


@pytest.mark.parametrize("method", [m for m in U.PER_ESTIMATOR if m != "perest_kcenter"])
def test_subsets_keep_their_contract(rows, method):
    got = U.subsets(rows, method, 30, 3, 1).collect()
    for e in range(3):
        own = [r.row_id for r in got if r.est == e]
        assert len(own) == len(set(own)) == 30


def test_bad_requests(rows):
    for budget in (0, -1, 2.5, True):
        with pytest.raises(ValueError):
            S.select_context(rows, "random", budget)
    with pytest.raises(KeyError):
        S.select_context(rows, "nothing", 3)
    with pytest.raises(KeyError):
        U.subsets(rows, "nothing", 3, 2)
    with pytest.raises(ValueError):
        U.emulate_subsample(rows, 2, "stratified", 2, 0)
    with pytest.raises(ValueError):
        U.emulate_subsample(rows, 20, "stratified", 2, 0, task="regression")


def test_allocation_of_the_label_vector(spark):
    sizes = spark.createDataFrame([(0, 700), (1, 200), (2, 100)], "grp int, n long")
    assert [r.take for r in allocate(sizes, 50, True).orderBy("grp").collect()] == [34, 10, 6]
    assert [r.take for r in allocate(sizes, 5000).orderBy("grp").collect()] == [700, 200, 100]


def test_pools_use_rows_evenly():
    for n, k, e in ((12, 4, 9), (25, 7, 9), (10, 3, 11)):
        drawn = [set() for _ in range(e)]
        for number, est, a, b in U.passes(n, k, e):
            drawn[est] |= {(number, i) for i in range(a, b)}
        assert all(len(d) == k for d in drawn)
    with_rows = {}
    for _, est, a, b in U.passes(12, 4, 9):
        for i in range(a, b):
            with_rows[i] = with_rows.get(i, 0) + 1
    assert set(with_rows.values()) == {3}


def test_split_is_disjoint_complete_and_in_proportion(rows):
    parts = split_rows(rows, 0, 0.3)
    assert parts.count() == 300 and parts.where("part = 'test'").count() == 90
    assert parts.where("part = 'test'").select("y").distinct().count() == 3


def _logits(spark, probs):
    return spark.createDataFrame([(0, e, c, math.log(p)) for e, ps in enumerate(probs) for c, p in enumerate(ps)], "row_id long, est int, cls int, logit double")


def test_mean_and_logit_mean_by_hand(spark):
    out = _logits(spark, [[0.9, 0.1], [0.2, 0.8]])
    p = {r.cls: r.p for r in A.mean(out).collect()}
    assert p[0] == pytest.approx(0.55) and p[1] == pytest.approx(0.45)
    assert {r.cls: r.p for r in A.logit_mean(out).collect()}[0] == pytest.approx(0.6)


@pytest.mark.parametrize("rule", [r for r in A.CLF if r not in A.NEEDS_VALIDATION | {"weighted"}])
def test_rules_give_distributions_and_agree_on_one_estimator(spark, rule):
    rng = np.random.RandomState(0)
    out = spark.createDataFrame([(i, e, c, float(x)) for i in range(5) for e in range(5) for c, x in enumerate(rng.normal(0, 2, 3))], "row_id long, est int, cls int, logit double")
    sums = A.aggregate_clf(rule, out).groupBy("row_id").agg(F.sum("p").alias("s"), F.min("p").alias("m")).collect()
    assert all(r.s == pytest.approx(1) and r.m >= 0 for r in sums)
    one = out.where("est = 0")
    a = {(r.row_id, r.cls): r.p for r in A.aggregate_clf(rule, one).collect()}
    b = {(r.row_id, r.cls): r.p for r in A.single(out).collect()}
    assert a == pytest.approx(b)


def test_rule_errors(spark):
    out = _logits(spark, [[0.9, 0.1], [0.2, 0.8]])
    for bad in ([1.0], [-1.0, 2.0], [0.0, 0.0]):
        with pytest.raises(ValueError):
            A.aggregate_clf("weighted", out, weights=bad)
    with pytest.raises(KeyError):
        A.aggregate_clf("nothing", out)
    with pytest.raises(ValueError):
        A.aggregate_clf("val_weighted", out)


def test_quantile_mean_by_hand(spark):
    bins = spark.createDataFrame([(i, float(i), float(i + 1)) for i in range(4)], "bin int, lo double, hi double")
    out = spark.createDataFrame([(0, e, i, p) for e, ps in enumerate([[0.5, 0.5, 0, 0], [0, 0, 0.5, 0.5]]) for i, p in enumerate(map(float, ps))], "row_id long, est int, bin int, p double")
    q = [r.q for r in A.aggregate_reg("quantile_mean", out, bins, [0.25, 0.5, 0.75])["quantiles"].orderBy("level").collect()]
    assert q == pytest.approx([1.5, 2.0, 2.5])
    truth = spark.createDataFrame([(0, 0.5)], "row_id long, y double")
    one = out.where("est = 0").drop("est")
    assert D.log_density(one, bins, truth).first().log_density == pytest.approx(math.log(0.5))
    assert D.log_density(one, bins, truth.withColumn("y", F.lit(3.5))).first().log_density == float("-inf")
    pool = A.aggregate_reg("log_pool", out, bins, [0.5])["bins"]
    assert pool.agg(F.sum("p")).first()[0] == 0
    wide = spark.createDataFrame([(0, 0.0, 2.0), (1, 2.0, 4.0)], "bin int, lo double, hi double")
    assert {r.bin: r.p for r in D.translate(one, bins, wide).collect()}[0] == pytest.approx(1.0)


def test_crps_by_hand(spark):
    q = spark.createDataFrame([(0, 0.1, -1.0), (0, 0.5, 0.0), (0, 0.9, 2.0)], "row_id long, level double, q double")
    assert M.crps(q, spark.createDataFrame([(0, 0.0)], "row_id long, y double")).first().crps == pytest.approx(0.2)


def test_auc_with_ties_and_one_class(spark):
    pred = spark.createDataFrame([(i, c, p if c else 1 - p) for i, p in enumerate([0.1, 0.4, 0.4, 0.8]) for c in (0, 1)], "row_id long, cls int, p double")
    truth = spark.createDataFrame([(0, 0), (1, 1), (2, 0), (3, 1)], "row_id long, y int")
    assert M.roc_auc(pred, truth).first().roc_auc == pytest.approx(0.875)
    assert M.roc_auc(pred, truth.withColumn("y", F.lit(0))).first().roc_auc is None


def test_prior_correction_by_hand(spark):
    pred = spark.createDataFrame([(0, 0, 0.5), (0, 1, 0.5)], "row_id long, cls int, p double")
    prior = lambda a: spark.createDataFrame([(0, a), (1, 1 - a)], "cls int, prior double")
    assert {r.cls: r.p for r in prior_correct(pred, prior(0.5), prior(0.9)).collect()} == pytest.approx({0: 0.9, 1: 0.1})


def test_budgets_by_hand(spark):
    sizes = spark.createDataFrame([("d", 1000)], "dataset string, n long")
    assert sorted(r.budget for r in G.resolve_budgets(sizes, [0.5, 0.1, 0.001, 0.1], [500, 2000, 1], 5).collect()) == [5, 100, 500]
    assert G.scaling_budgets(5000) == [512, 1024, 2048, 4096, 5000]
    assert len(G.learning_curve_budgets(1000)) >= 6
    with pytest.raises(ValueError):
        G.scaling_budgets(10, factor=1)


def test_small_blob_keeps_its_share(spark):
    big = spark.range(1000).select(F.col("id").alias("row_id"), F.lit(0).alias("y"), F.when(F.col("id") < 900, F.array(F.col("id") % 7 * 0.01, F.lit(0.0))).otherwise(F.array(10 + F.col("id") % 5 * 0.01, F.lit(10.0))).alias("features"))
    got = S.select_context(big, "representative", 50, 0).where("row_id >= 900").count()
    assert abs(got - 5) <= 1


def test_lloyd_keeps_empty_centres():
    x = np.array([[0.0], [0.0], [5.0], [5.1]])
    assert C.lloyd(x, 2)[1][0] == 0.0 or len(C.lloyd(x, 2)) == 2
    assert C.lloyd(x, 9).shape == (4, 1)


def test_routing(spark):
    base = make_synthetic(spark, 200, 3, 2, seed=1)
    train, test = base.where("row_id < 150"), base.where("row_id >= 150")
    with pytest.raises(ValueError):
        R.local_mix(train, test, 20, 2, ratio=1.5)
    mix = R.local_mix(train, test, 20, 2, ratio=0.5, groups=2)["context"]
    sizes = mix.groupBy("grp", "est").agg(F.count_distinct("row_id").alias("n"), F.count("*").alias("m")).collect()
    assert len(sizes) == 4 and all(r.n == r.m == 20 for r in sizes)
    d, tau = R.gate_distances(train, test, 3, 0)
    w = R.gate_weights(d, tau).groupBy("row_id").agg(F.sum("w").alias("s")).collect()
    assert all(r.s == pytest.approx(1) for r in w)
    held = R.gate_holdout(train, 0)
    assert held.where("held").count() == 30
    crumb = R.crumb(train, test, 10, 2, groups=2, per_estimator=True)["context"]
    assert all(r.n == 10 for r in crumb.groupBy("grp", "est").agg(F.count_distinct("row_id").alias("n")).collect())
    assert R.supervised_scale(np.array([1.0, 0.0])) == pytest.approx(np.sqrt([1.9, 0.1]))


def test_gate_bias_moves_from_a_bad_expert(spark):
    d = spark.createDataFrame([(i, e, 1.0 + (i + e) % 2) for i in range(200) for e in (0, 1)], "row_id long, est int, d2 double")
    s = spark.createDataFrame([(i, e, -0.1 if e == 0 else -6.0) for i in range(200) for e in (0, 1)], "row_id long, est int, score double")
    plain, fitted = R.fit_gate(d, s, 1.0), R.fit_gate(d, s, 1.0, bias=True)
    assert fitted.loss < plain.loss and fitted.bias[0] > fitted.bias[1]


def test_greedy_choice_sees_all_rows_of_large_groups(spark):
    """More than 4,000 rows a group with far points that a sample of 4,000 mostly misses, and a budget beyond it."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(9000, 2)) * 0.01
    x[8990:] += 50 * rng.normal(size=(10, 2))
    df = spark.createDataFrame([(i, "a", [float(v) for v in p]) for i, p in enumerate(x)], "row_id long, y string, features array<double>").repartition(4)
    found = {r.row_id for r in U.subsets(df, "perest_kcenter", 20, 1).collect()}
    assert len(found) == 20 and set(range(8990, 9000)) <= found
    # steps over all rows take what one task takes, past a state that is kept
    whole = U.subsets(df, "perest_kcenter", 20, 2, one_task=10000).collect()
    assert {tuple(r) for r in U.subsets(df, "perest_kcenter", 20, 2, one_task=1).collect()} == {tuple(r) for r in whole}
    train, test = df.where("row_id < 200 or row_id >= 8990"), df.where("row_id between 200 and 260")
    one = {tuple(r) for r in R.crumb(train, test, 20, 2, groups=2, per_estimator=True)["context"].collect()}
    assert len(one) == 80 and one == {tuple(r) for r in R.crumb(train, test, 20, 2, groups=2, per_estimator=True, one_task=1)["context"].collect()}
    some = df.where("row_id < 4100")
    assert R.crumb(some, test, 4050, 1, groups=1, one_task=5000)["context"].count() == 4050
