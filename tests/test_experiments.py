"""Whole experiments on small synthetic data: configuration, cells, resume, failures, reports."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import cli
from tessera.functions import special
from tessera.functions.seeding import first_each, hash_order, least_each, ranked
from tessera.operators import aggregation as A
from tessera.operators import distribution as D
from tessera.operators import encode as E
from tessera.operators import experts as X
from tessera.operators import routing as R
from tessera.operators import statistics as T
from tessera.operators.backends import make_backend
from tessera.operators.coverage import cover_classes
from tessera.operators.estimator import ContextClassifier, ContextRegressor
from tessera.operators.validation import validate_path
from tessera.plans import analysis
from tessera.plans.config import normalize, parse_imbalance
from tessera.plans.runner import Cell, Run, run_aggregation, run_cells, run_coreset, run_experiment
from tessera.sources import datasets as DS
from tessera.sources import results as S

METHODS = ["random", "balanced", "builtin_subsample", "perest_random", "local_mix", "cluster_experts", "canary_shuffled"]


def classes(spark, n=160, **options):
    return DS.make_synthetic(spark, n, 4, 3, **({"noise": 0.1, "seed": 3} | options)).cache()


def numbers(spark, n=160, **options):
    return DS.make_synthetic(spark, n, 4, task="regression", noise=0.2, seed=4, **options).cache()


def spec(name, split="dev", task="classification", n=140, seed=1):
    return {"name": name, "source": "synthetic", "n": n, "n_features": 4, "n_classes": 3, "task": task, "noise": 0.1, "seed": seed, "split": split}


def test_configuration():
    c = normalize({"seeds": 3, "coreset_methods": ["local_mix", "random"], "local_ratios": [0.5]})
    assert c["coreset_methods"] == ["local_mix_r0.5", "random"] and c["selection_seeds"] == [0, 1, 2]
    assert [d["split"] for d in normalize({"datasets": {"dev": [{"name": "a"}], "confirm": [{"name": "b"}]}})["datasets"]] == ["dev", "confirm"]
    for bad in ({"datasets": [{"name": "a"}, {"name": "a"}]}, {"datasets": {"dev": [{"name": "a"}], "confirm": [{"name": "a"}]}}, {"no_such_key": 1}, {"perest_mode": "other"}, {"budget_fractions": [0.0]}, {"test_size": 1.0}, {"n_estimators": [0]}):
        with pytest.raises(ValueError):
            normalize(bad)
    with pytest.raises(ValueError):
        normalize({"budget_factor": 1}, "scaling")
    assert parse_imbalance("None") is None and parse_imbalance("[0.9, 0.1]") == [0.9, 0.1] and parse_imbalance(0.5) == 0.5 == parse_imbalance("0.5")
    assert cli.parse_shard("1/3") == (1, 3)
    with pytest.raises(ValueError):
        cli.parse_shard("3/3")


def test_seeds_have_fits_of_their_own(spark):
    rows = classes(spark)
    config = {"datasets": [{"name": "a"}], "n_estimators": [1, 3], "aggregators": ["mean", "val_weighted", "mean_temp_offline"], "seeds": 2, "context": 30, "backend": {"name": "centroid", "estimators": 3}}
    run = Run(spark, normalize(config, "aggregation"), load=lambda _: rows)
    from tessera.plans.runner import rows_of

    got = {(s, r.method, r.n_estimators, r.metric): r.value for s in (0, 1) for r in rows_of(run, Cell("aggregation", "a", s, s)).collect()}
    assert {m for _, m, _, _ in got} == {"single", "mean", "val_weighted", "mean_temp_offline", "native", "native_tuned"}
    assert any(abs(got[0, "mean", 3, m] - got[1, "mean", 3, m]) > 1e-6 for m in ("log_loss", "accuracy", "roc_auc", "ece"))
    assert all(got[s, "single", 1, "log_loss"] == got[s, "single", 3, "log_loss"] == got[s, "mean", 1, "log_loss"] for s in (0, 1))
    with pytest.raises(ValueError):
        run_aggregation({"a": {"train": rows, "truth": rows, "out": rows}}, ["mean"], [1], [0, 1])


def test_every_coreset_method_has_its_rows(spark):
    rows = classes(spark)
    out = run_coreset(rows, "a", [*METHODS, "uncertainty_mix", "crumb_perest", "cluster_experts_tuned", "experts_full"], {"f0.3": 0.3}, [0], combined_aggregators=["median"], local_ratios=[0.5], local_groups=2, coreset_kwargs={"experts_full": {"max_clusters": 4}})
    got = out.where("metric = 'log_loss'").select("method", "role", "flags", "value").collect()
    want = {"full", "random", "balanced", "balanced_corrected", "builtin_subsample", "perest_random", "perest_random+median", "local_mix_r0.5", "local_mix_r0.5+median", "cluster_experts", "cluster_experts+gate", "cluster_experts+median", "canary_shuffled", "uncertainty_mix", "uncertainty_mix_corrected", "crumb_perest", "crumb_perest+median", "cluster_experts_tuned", "cluster_experts_tuned+bias", "cluster_experts_tuned+heuristic", "experts_full", "experts_full+heuristic", "experts_full+hard"}
    assert {r.method for r in got} == want and all(math.isfinite(r.value) for r in got)
    by = {r.method: r for r in got}
    assert by["local_mix_r0.5"].flags == "transductive" and by["full"].role == "reference" and by["random"].role == "baseline" and by["canary_shuffled"].role == "canary"
    # estimators have contexts of their own
    assert by["perest_random"].value != by["random"].value


def test_regression_methods(spark):
    rows = numbers(spark)
    out = run_coreset(rows, "r", ["random", "perest_random", "cluster_experts", "cluster_experts_tuned", "experts_scaled", "crumb"], {"f0.4": 0.4}, [0], task="regression", backend=make_backend({"name": "histogram", "estimators": 2}), local_groups=2, coreset_kwargs={"experts_scaled": {"max_clusters": 3}})
    got = {r.method: r.value for r in out.where("metric = 'rmse'").collect()}
    assert set(got) == {"full", "random", "perest_random", "cluster_experts", "cluster_experts+gate", "cluster_experts_tuned", "cluster_experts_tuned+bias", "cluster_experts_tuned+heuristic", "experts_scaled", "experts_scaled+heuristic", "experts_scaled+hard", "crumb"}
    sd = rows.agg(F.stddev("y")).first()[0]
    assert all(0 < v < 2 * sd for v in got.values())


def test_a_cell_that_breaks_is_a_failure_and_a_restart_does_the_rest(spark, tmp_path):
    from tessera.plans.runner import rows_of

    rows, path = classes(spark), str(tmp_path / "r")
    config = normalize({"datasets": [{"name": "a"}], "n_estimators": 2, "backend": {"name": "centroid", "estimators": 2}})
    run = Run(spark, config, load=lambda _: rows)
    cells = [Cell("coreset", "a", 0, s, "random", 30, "a30") for s in range(3)]
    calls = []

    def breaks(run, cell):
        calls.append(cell.seed)
        out = rows_of(run, cell)
        # fails in a task, not while the plan is built
        return out.withColumn("method", F.raise_error(F.lit("java.lang.OutOfMemoryError: x")).cast("string")) if cell.seed == 1 and len(calls) < 3 else out

    failed = run_cells(run, cells, path, evaluate=breaks)
    assert [f["cell"] for f in failed] == ["coreset|a|s0|r1|random|a30|30"] and failed[0]["oom"]
    assert S.read_results(spark, path).select("cell").distinct().count() == 2
    assert S.open_failures(S.read_side(spark, S.FAILURES, S.table_name(path, "failures")), S.read_results(spark, path)).count() == 1
    assert run_cells(run, cells, path, evaluate=breaks) == [] and calls == [0, 1, 2, 1]
    have = S.read_results(spark, path)
    assert have.count() == 12 and have.select("seed").distinct().count() == 3
    assert S.open_failures(S.read_side(spark, S.FAILURES, S.table_name(path, "failures")), have).count() == 0
    timing = S.read_timing(spark, path)
    assert timing.count() == 3 and timing.where("total_s <= 0 or n_fits <> 1 or select_s > total_s").count() == 0


def test_scaling_from_the_command_line(spark, tmp_path):
    config, path = str(tmp_path / "c.json"), str(tmp_path / "scale")
    with open(config, "w") as f:
        json.dump({"datasets": [spec("a"), spec("r", task="regression")][:1], "seeds": 2, "n_estimators": [1, 2], "budget_start": 40, "backend": {"name": "centroid", "estimators": 2}}, f)
    for shard in ("0/2", "1/2"):
        assert cli.main(["scaling", "--config", config, "--out", path, "--shard", shard]) == 0
    assert cli.main(["merge", "--out", path]) == 0 and cli.main(["validate", "--results", path]) == 0
    rows = S.read_results(spark, path)
    assert {r[0] for r in rows.select("budget").distinct().collect()} == {40.0, 80.0, 98.0} and rows.count() == 2 * 3 * 2 * 4
    # nested: a seed's smaller context is inside the larger one
    assert cli.main(["analyze", "--results", path, "--out", str(tmp_path / "report")]) == 0
    steps = spark.read.parquet(str(tmp_path / "report") + ".analysis.context_steps")
    assert {(r.budget_from, r.budget_to) for r in steps.collect()} == {(40.0, 80.0), (80.0, 98.0)} and steps.where("n_seeds <> 2").count() == 0
    assert spark.read.parquet(str(tmp_path / "report") + ".analysis.summary").where("total_s is null").count() == 0
    # a cell that is taken away is missed
    rows.where("seed = 0").write.parquet(str(tmp_path / "half"))
    S.write_meta(spark, str(tmp_path / "half.meta"), S.read_meta(spark, path + ".meta"))
    assert any("missing cells" in p for p in validate_path(spark, str(tmp_path / "half")))


def test_coreset_reports(spark, tmp_path):
    path = str(tmp_path / "core")
    config = {"datasets": {"confirm": [spec("a", seed=1, n=110), spec("b", seed=2, n=120)]}, "n_estimators": 2, "selection_seeds": 2, "budget_fractions": [0.3], "coreset_methods": ["random", "stratified"], "learning_curve_points": 1, "backend": {"name": "centroid", "estimators": 2}}
    assert run_experiment(spark, config, "coreset", path) == []
    meta = S.read_meta(spark, path + ".meta")
    assert ["stratified", "random", "f0.3", "log_loss"] in meta["family"] and not any(f[0] == "random" for f in meta["family"])
    assert not [p for p in validate_path(spark, path) if "curves" not in p]
    tables = analysis.analyze(spark, path)
    assert set(tables) == {"family", "effects", "effect_summary", "ratio_curves", "saturated_cells"}
    # cells that are saturated on every dataset have no row
    assert {tuple(r) for r in tables["family"].select("method", "baseline", "budget_key", "metric").collect()} <= set(map(tuple, meta["family"])) and tables["effects"].count() == 2
    dev = analysis.dev_table(S.read_results(spark, path), "random", S.read_timing(spark, path)).collect()
    assert all(r.total_s is not None for r in dev) and all((r.improvement is None) == (r.method == "random" or r.method == "full" or r.n < 2) for r in dev if r.method != "full")
    assert normalize(config)["datasets"][0]["split"] == "confirm"


def test_datasets_are_described(spark):
    config = normalize({"datasets": [{**spec("a"), "target": "y"}, {**spec("r", task="regression"), "target": "y"}, {"name": "gone", "source": "nothing"}], "budget_absolute": [10, 60]})
    got = {r.dataset: r for r in DS.describe_all(spark, config).collect()}
    assert got["a"].n_train == 98 and "3 classes" in got["a"].target and "[60]" in got["a"].problems
    assert got["r"].n_rows == 140 and "distinct" in got["r"].target and got["gone"].problems.startswith("ValueError")


def test_estimators(spark):
    rows = numbers(spark)
    train, test = rows.where("row_id < 120"), rows.where("row_id >= 120")
    for rule in ("mixture", "quantile_median"):
        model = ContextRegressor("perest_random", 0.5, rule, backend={"name": "histogram", "estimators": 2}).fit(train)
        assert model.predict(test).count() == 40 and model.predict_distribution(test, [0.1, 0.9])["quantiles"].count() == 80
    forest = ContextRegressor("none", backend={"name": "forest", "estimators": 1, "trees": 10}).fit(train)
    err = forest.predict(test).join(test, "row_id").agg(F.sqrt(F.avg((F.col("mean") - F.col("y")) ** 2))).first()[0]
    assert err < test.agg(F.stddev("y")).first()[0]
    rows = classes(spark)
    train, test = rows.where("row_id < 120"), rows.where("row_id >= 120")
    for rule in ("val_weighted", "mean_temp_offline"):
        model = ContextClassifier("random", 60, rule, backend={"name": "centroid", "estimators": 3}).fit(train)
        assert model.predict(test).join(test, "row_id").where("cls = y").count() > 20
        assert model.rule in ("weighted", "mean") and (model.temperature != 1.0 or rule == "val_weighted")
    with pytest.raises(KeyError):
        ContextClassifier("random", 10, "mixture").fit(train)


def test_projection(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(200, 3)) @ rng.normal(size=(3, 60))
    wide = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(base)], "row_id long, " + ", ".join(f"x{j} double" for j in range(60)))
    columns = [f"x{j}" for j in range(60)]
    apply = E.feature_transform(wide.where("row_id < 150"), columns)
    got = np.array([r.features for r in apply(wide).orderBy("row_id").collect()])
    assert got.shape == (200, 50) and np.allclose(got[:, 3:], 0, atol=1e-6)
    plain = np.array([r.features for r in E.feature_transform(wide, columns, dims=60)(wide).orderBy("row_id").collect()])
    own = E.feature_transform(wide, columns)(wide).orderBy("row_id").collect()
    # distances survive, since three dimensions hold all
    flat = np.array([r.features for r in own])
    assert np.allclose(np.linalg.norm(plain[:20, None] - plain[None, :20], axis=2), np.linalg.norm(flat[:20, None] - flat[None, :20], axis=2), atol=1e-6)


def test_missing_classes_are_swapped_in(spark):
    rows = spark.createDataFrame([(i, 0 if i < 90 else 1 if i < 97 else 2) for i in range(100)], "row_id long, y int")
    chosen = spark.createDataFrame([(0, i, int(i < 4)) for i in range(8)] + [(1, i, 0) for i in (1, 91)] + [(2, i, 1) for i in (1, 2, 91, 98)], "est int, row_id long, protected int")
    got = {}
    for r in cover_classes(rows, chosen, ("est",)).collect():
        got.setdefault(r.est, set()).add(r.row_id)
    y = lambda ids: {0 if i < 90 else 1 if i < 97 else 2 for i in ids}
    assert len(got[0]) == 8 and y(got[0]) == {0, 1, 2} and {0, 1, 2, 3} <= got[0]
    assert got[1] == {1, 91} and got[2] == {1, 2, 91, 98}
    skewed = DS.make_synthetic(spark, 300, 4, 3, imbalance=[0.96, 0.02, 0.02], seed=2)
    mix = R.local_mix(skewed, skewed.limit(40), 20, 2, 0.9, groups=3)["context"].join(skewed, "row_id")
    assert {r.n for r in mix.groupBy("grp", "est").agg(F.count_distinct("y").alias("n")).collect()} == {3}
    assert {r.n for r in mix.groupBy("grp", "est").agg(F.count_distinct("row_id").alias("n")).collect()} == {20}


def test_gate_on_squared_error(spark):
    rng = random.Random(1)
    rows = [(i, e, float(d), float(d) * 3 + rng.gauss(0, 0.05), 0.0) for i in range(300) for e, d in enumerate((0, rng.random()))]
    d = spark.createDataFrame([r[:3] for r in rows], "row_id long, est int, d2 double")
    score = spark.createDataFrame([(r[0], r[1], r[3], r[4] + 0.01 * r[0]) for r in rows], "row_id long, est int, score double, y double")
    zero = score.withColumn("y", F.lit(0.0) + F.col("row_id") * 0)
    tight = R.fit_gate(d, zero, 1.0)
    assert tight.tau < 0.1 and R.gate_loss(d, zero, [1.0])[1.0] > tight.loss
    both = R.fit_gate(d, zero, 1.0, bias=True, ridge=1e-4)
    assert both.loss <= tight.loss + 1e-12


def test_weighted_experts_stretch_what_matters(spark):
    rng = random.Random(2)
    rows = spark.createDataFrame([(i, i % 2, [float(i % 2) + rng.gauss(0, 0.1), rng.gauss(0, 1), rng.gauss(0, 1)]) for i in range(200)], "row_id long, y int, features array<double>")
    plan = R.expert_plan(rows, 50, 2, 0, weighted=True)
    assert plan.scale[0] > 1.3 and max(plan.scale[1:]) < 1 and np.mean(plan.scale**2) == pytest.approx(1.0)
    assert plan.context.groupBy("grp").count().where("count <> 50").count() == 0
    assert R.expert_route(plan, rows).where("slot = 0").count() == 200
    found = X.tuned_experts(rows.where("row_id < 150"), rows.where("row_id >= 150"), "experts_weighted", 40, 2, most=4)
    assert set(found) == {"", "+heuristic", "+hard"} and all(p.groupBy("row_id").agg(F.sum("p").alias("s")).where("abs(s - 1) > 1e-9").count() == 0 for p in found.values())


def test_densities_by_kind_and_as_arrays(spark):
    flat, tails = (D.make_distribution(spark, k, [0.0, 1.0, 3.0]) for k in ("bar", "full_support"))
    p = spark.createDataFrame([(1, 0, 0, 0.5), (1, 0, 1, 0.5)], "row_id long, est int, bin int, p double")
    assert flat.mean(p).first().mean == pytest.approx(1.25) and tails.mean(p).first().mean != pytest.approx(1.25)
    back = D.from_row(spark, flat.to_row())
    assert back.to_row() == {"kind": "bar", "borders": [0.0, 1.0, 3.0]}
    assert sorted(map(tuple, D.from_arrays(D.to_arrays(p, "p", "bin"), "p", "bin").collect())) == sorted(map(tuple, p.collect()))
    for kind, edges in (("other", [0, 1]), ("bar", [1, 1]), ("bar", [1])):
        with pytest.raises(ValueError):
            D.make_distribution(spark, kind, edges)


def test_tests_on_arrays_equal_plain_python(spark):
    rng = random.Random(5)
    rows = [[rng.gauss(0.2, 1) for _ in range(n)] for n in (1, 2, 5, 12, 30, 50, 51, 80)] + [[float(rng.randint(-3, 3)) for _ in range(n)] for n in (1, 4, 9, 40)] + [[], [0.0, 0.0], [1.0, 1.0], [0.0, 1.0, 2.0], [1.0, -1.0]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, d array<double>")
    for r in df.select("i", T.wilcoxon(F.col("d")).alias("w"), T.paired_t(F.col("d")).alias("t")).collect():
        assert r.w == pytest.approx(special.wilcoxon(rows[r.i])), rows[r.i]
        want = special.paired_t(rows[r.i])
        assert r.t is None if want is None else r.t == pytest.approx(want)


def test_first_and_least_of_large_groups(spark):
    rows = spark.range(30000).select(F.col("id").alias("row_id"), (F.col("id") % 3).alias("g"), F.pmod(F.xxhash64("id"), F.lit(10007)).cast("double").alias("s"))
    sizes = rows.groupBy("g").agg(F.count("*").alias("n"))
    order = hash_order(0, "x", "row_id")
    want = {(r.g, r.row_id) for r in ranked(rows, order, "row_id", ("g",)).where("rn <= 50").collect()}
    assert {(r.g, r.row_id) for r in first_each(rows, order, 50, ("g",), sizes).collect()} == want
    by = {}
    for r in rows.collect():
        by.setdefault(r.g, []).append((r.s, r.row_id))
    for k in (10, 1500, 20000):
        got = {}
        for r in least_each(rows, F.col("s"), k, ("g",)).collect():
            got.setdefault(r.g, []).append((r.s, r.row_id))
        assert {g: sorted(v) for g, v in got.items()} == {g: sorted(v)[:k] for g, v in by.items()}


def test_flags_and_embeddings(spark):
    df = spark.createDataFrame([("a,very_saturated",), ("saturated",), (None,)], "flags string")
    assert [r[0] for r in df.select(T.has_flag(F.col("flags"), "saturated")).collect()] == [False, True, False]
    assert [r[0] for r in df.select(T.has_flag(F.col("flags"), "saturated", exact=False)).collect()] == [True, True, False]
    from tessera.operators.selection import select_context

    rows = classes(spark)
    forest = make_backend({"name": "forest", "estimators": 1, "trees": 3})
    got = select_context(rows, "embedding_kmeans", 12, 0, backend=forest, estimators=2)
    assert got.count() == 12 and got.select("y").distinct().count() == 3 and got.columns == rows.columns
    assert A.mean(forest.clf_outputs(rows, rows.select("row_id", F.lit(0).alias("est")), rows)).count() == 480
