"""python -m tessera.cli VERB: datasets, aggregation, coreset, scaling, validate, merge, analyze, plan.

Runs resume: cells that have results are left out.  Exit codes: 0 fine, 1 problems or failures found, 2 a plan without enough power (unless --force).
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession


def load_config(path: str) -> dict:
    with open(path) as f:
        text = f.read()
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text)


def parse_shard(text: str | None) -> tuple[int, int]:
    if not text:
        return 0, 1
    i, n = map(int, text.split("/"))
    if not 0 <= i < n:
        raise ValueError("a shard is i/n with 0 <= i < n")
    return i, n


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tessera", description=__doc__)
    sub = p.add_subparsers(dest="verb", required=True)
    for verb in ("aggregation", "coreset", "scaling", "datasets"):
        v = sub.add_parser(verb)
        v.add_argument("--config", required=True)
        v.add_argument("--out")
        v.add_argument("--shard")
        v.add_argument("--log")
    for verb in ("validate", "analyze"):
        v = sub.add_parser(verb)
        v.add_argument("--results", required=True)
        v.add_argument("--out")
    v = sub.add_parser("merge")
    v.add_argument("--out", required=True)
    v.add_argument("shards", nargs="*")
    v = sub.add_parser("plan")
    for name, kind in (("datasets", int), ("seeds", int), ("effect", float), ("sd-dataset", float), ("sd-seed", float)):
        v.add_argument(f"--{name}", type=kind)
    v.add_argument("--config")
    v.add_argument("--pilot")
    v.add_argument("--force", action="store_true")
    a = p.parse_args(args)
    if a.verb == "plan":
        return _plan(p, a)
    spark = SparkSession.builder.getOrCreate()
    if a.verb == "analyze":
        from .plans.analysis import analyze

        analyze(spark, a.results, a.out)
        return 0
    if a.verb in ("validate", "merge"):
        from .operators.validation import validate_path
        from .sources.results import merge

        path = a.results if a.verb == "validate" else a.out
        if a.verb == "merge":
            merge(spark, path, a.shards)
        problems = validate_path(spark, path)
        print("\n".join(problems) or "no problems")
        return int(bool(problems))
    from .plans.config import normalize
    from .plans.runner import run_experiment
    from .sources.datasets import describe_all
    from .sources.results import setup_logging, table_name

    given = load_config(a.config)
    if a.verb == "datasets":
        table = describe_all(spark, normalize(given, given.get("experiment", "coreset")))
        table.show(1000, truncate=False)
        return int(bool(table.where("problems <> ''").limit(1).count()))
    setup_logging(file=a.log)
    shard, shards = parse_shard(a.shard)
    out = a.out or given.get("out") or given.get("out_csv")
    if not out:
        p.error("--out, or out in the configuration, says where results go")
    failed = run_experiment(spark, given, a.verb, table_name(out, "results", shard if a.shard else None), shard, shards)
    return int(bool(failed))


def _plan(p: argparse.ArgumentParser, a: argparse.Namespace) -> int:
    from .operators.effects import plan, plan_from_config

    if a.config:
        from .plans.config import normalize

        pilot = None
        if a.pilot:
            from .sources.results import read_results

            pilot = read_results(SparkSession.builder.getOrCreate(), a.pilot)
        got = plan_from_config(normalize(load_config(a.config), "coreset"), pilot)
    else:
        values = (a.datasets, a.seeds, a.effect, a.sd_dataset, a.sd_seed)
        if None in values:
            p.error("plan needs --config, or --datasets, --seeds, --effect, --sd-dataset and --sd-seed")
        got = plan(*values)
    print(json.dumps(got))
    return 0 if got["enough"] or a.force else 2


if __name__ == "__main__":
    sys.exit(main())
