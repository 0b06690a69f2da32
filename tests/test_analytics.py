"""Statistics, effects, validation, sources and runner."""

import math

import pytest
from pyspark.sql import functions as F

from tessera import cli
from tessera.functions import special
from tessera.operators import effects as X
from tessera.operators import statistics as T
from tessera.operators import validation as V
from tessera.operators.estimator import ContextClassifier, resolve_budget
from tessera.plans import analytics_queries as Q
from tessera.sources import datasets as DS
from tessera.sources import results as R
from tessera.streaming.ingest import append_new, result_stream


@pytest.fixture(scope="module")
def results(spark, sf):
    return Q.results(spark, sf).cache()


def test_special_functions():
    assert special.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-9)
    assert special.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9) and special.chi2_sf(20.0, 3) == pytest.approx(0.00016974243555282632)
    assert special.binomial_two_sided(9, 10) == pytest.approx(22 / 1024)
    assert special.wilcoxon([1.0, 2.0, 3.0, 4.0, 5.0]) == pytest.approx(0.0625) and special.wilcoxon([0.0, 0.0]) == 1.0
    assert special.kruskal([[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]]) == pytest.approx(0.049534613)
    assert special.paired_t([1.0]) is None and special.paired_t([1.0, 1.0]) is None


def test_holm_by_hand(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.005])], "k int, p double")
    assert [r.p_holm for r in T.holm(df, "p", tie=["k"]).orderBy("k").collect()] == pytest.approx([0.03, 0.06, 0.06, 0.02])


def test_sign_test_and_win_rate(spark):
    df = spark.createDataFrame([(9, 1), (0, 0), (5, 5), (30, 2)], "w long, l long").select(T.sign_p(F.col("w"), F.col("l")).alias("p"), "w", "l")
    for r in df.collect():
        assert r.p == pytest.approx(special.binomial_two_sided(r.w, r.w + r.l))


def _table(spark, rows):
    full = {"experiment": "e", "split": "dev", "tier": "small", "task": "t", "ratio": 0.1, "n_train": 1000, "backend": "b", "role": "method", "flags": "", "split_seed": 0, "n_estimators": -1, "budget_key": "f0.1", "budget": None, "seed": 0, "cell": ""}
    return spark.createDataFrame([tuple({**full, **r}[f.name] for f in R.RESULTS) for r in rows], R.RESULTS)


def test_datasets_weigh_the_same_and_missing_budgets_match(spark):
    rows = [dict(dataset="A", seed=i, method=m, metric="rmse", value=v) for i in range(10) for m, v in (("m", 0.0), ("b", 1.0))] + [dict(dataset="B", method=m, metric="rmse", value=v) for m, v in (("m", 4.0), ("b", 1.0))]
    family = spark.createDataFrame([("m", "b", None, "rmse")], "method string, baseline string, budget_key string, metric string")
    got = T.compare(_table(spark, rows), family, n_boot=50).first()
    assert got.n_datasets == 2 and got.mean_diff == pytest.approx(1.0) and got.improvement == pytest.approx(-1.0) and got.win_rate == 0.5
    flagged = T.paired(_table(spark, [{**r, "flags": "x,saturated" if r["dataset"] == "A" else "nonsaturated"} for r in rows]), family)
    assert [r.dataset for r in flagged.collect()] == ["B"]


def test_bootstrap_of_one_value(spark):
    df = spark.createDataFrame([("a", "d", 2.5)], "g string, dataset string, value double")
    assert T.bootstrap_ci(df, ["g"], n_boot=20).first()[1:] == (2.5, 2.5)


def test_gap_and_equivalent_budget_by_hand(spark):
    df = spark.createDataFrame([(0.5, 0.4, 0.3, 0.0), (0.5, 0.4, 0.5, 0.0), (0.5, 0.4, 0.45, 0.1)], "r double, c double, f double, n double")
    assert [r[0] for r in df.select(X.gap_closed(*map(F.col, "rcfn"))).collect()] == [pytest.approx(0.5), None, None]
    curve = spark.createDataFrame([("d", b, 0.3 + 2 * b**-0.5) for b in (50.0, 100.0, 200.0, 400.0, 800.0)], "dataset string, budget double, value double")
    core = spark.createDataFrame([("d", 100.0, 0.3 + 2 * 200**-0.5), ("d", 50.0, 9.0), ("d", 800.0, 0.01), ("e", 5.0, 1.0)], "dataset string, budget double, value double")
    got = {(r.dataset, r.budget): (r.multiplier, r.range_flag) for r in X.equivalent_budget(core, curve, ["dataset"], False).collect()}
    assert got["d", 100.0] == (pytest.approx(2.0), "") and got["d", 50.0] == (None, "below_range") and got["d", 800.0] == (None, "above_range") and got["e", 5.0][1] == "no_curve"


def test_planning():
    assert X.min_detectable_effect(5, 3, 1.0, 0.5, n_sim=60) == math.inf
    assert X.min_detectable_effect(5, 3, 0.0, 0.0) == 0.0
    e = X.min_detectable_effect(20, 3, 1.0, 0.5, n_sim=100)
    assert X.simulate_power(20, 3, 2 * e, 1.0, 0.5) > 0.8 > X.simulate_power(20, 3, 0.0, 1.0, 0.5)
    assert cli.main(["plan", "--datasets", "6", "--seeds", "1", "--effect", "0.01", "--sd-dataset", "1", "--sd-seed", "1"]) == 2


def test_tuning_needs_dev_rows(results):
    with pytest.raises(ValueError):
        X.tune(results, "rmse", ["budget_key"])


def test_validation_finds_what_is_planted(spark, results):
    assert V.validate(results) == []
    bad = results.withColumn("value", F.when(F.col("metric") == "accuracy", 2.0).otherwise(F.col("value")))
    assert len(V.validate(bad)) == 1 and "range" in V.validate(bad)[0]
    assert any("duplicate" in p for p in V.validate(results.union(results.limit(1))))
    assert V.validate(results.drop("value")) == ["missing column value"]
    assert any("baselines" in p for p in V.validate(results, baselines=["other"]))


def test_store(spark, results, tmp_path):
    path = str(tmp_path / "r")
    R.append(results.limit(10), path)
    R.append(results.limit(10), path)
    assert R.read_results(spark, path).count() == 20
    cache = R.OutputCache(spark, str(tmp_path / "cache"))
    key = R.cache_key(a=1, b={"x": 2, "y": 3})
    assert key == R.cache_key(b={"y": 3, "x": 2}, a=1) != R.cache_key(a=2, b={"x": 2, "y": 3})
    assert cache.get(key) is None and cache.get_or_put(key, lambda: spark.range(3)).count() == 3 and cache.get_or_put(key, lambda: 1 / 0).count() == 3
    R.write_meta(spark, str(tmp_path / "m"), {"k": [1, 2]})
    assert R.read_meta(spark, str(tmp_path / "m")) == {"k": [1, 2]}
    R.write_meta(spark, str(tmp_path / "m"), {"k": [3]})
    assert R.read_meta(spark, str(tmp_path / "m")) == {"k": [3]}
    assert R.table_name("/a/r", "failures", 2) == "/a/r.shard2.failures"


def test_stream_adds_each_key_once(spark, results, tmp_path):
    results.repartition(3).write.parquet(str(tmp_path / "in"))
    for i in range(2):
        append_new(result_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / f"cp{i}")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == results.count()


def test_datasets(spark):
    df = DS.make_synthetic(spark, 500, 5, 3, imbalance=[0.9, 0.07, 0.03], noise=0.1, seed=2)
    assert df.count() == 500 and all(r.n >= 2 for r in df.groupBy("y").agg(F.count("*").alias("n")).collect())
    assert df.repartition(7).agg(F.sum(F.col("features")[0])).first()[0] == pytest.approx(df.agg(F.sum(F.col("features")[0])).first()[0])
    with pytest.raises(ValueError):
        DS.load_dataset(spark, {"source": "nothing"})
    assert DS.load_dataset(spark, {"source": "synthetic", "n": 50, "max_rows": 20, "target": "y"}).count() == 20


def test_estimator(spark):
    df = DS.make_synthetic(spark, 240, 4, 2, seed=5)
    train, test = df.where("row_id < 180"), df.where("row_id >= 180")
    for method, budget in (("stratified", 60), ("perest_random", 0.3), ("random", None)):
        got = ContextClassifier(method, budget, backend={"name": "centroid", "estimators": 2}).fit(train).predict(test).join(test, "row_id")
        assert got.count() == 60 and got.where("cls = y").count() > 30
    assert resolve_budget(0.5, 10) == 5
    with pytest.raises(ValueError):
        resolve_budget(1.5, 10)


def test_entry_points(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 6
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 100
