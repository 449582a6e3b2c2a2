"""Command line: ``python -m rallyframe.cli COMMAND``."""

from __future__ import annotations

import argparse
import json
import sys

from rallyframe import __version__


def _tables(spark, folder: str, names: list[str]):
    from rallyframe.sources.tables import table

    return [table(spark, folder, n) for n in names]


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="rallyframe")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("version")
    commands.add_parser("health")
    commands.add_parser("queries")
    run = commands.add_parser("run")
    run.add_argument("name")
    run.add_argument("folder")
    run.add_argument("out")
    ingest = commands.add_parser("ingest-snapshot")
    for a in ("root", "out", "repo", "commit"):
        ingest.add_argument(a)
    features = commands.add_parser("build-features")
    features.add_argument("folder")
    features.add_argument("out")
    train = commands.add_parser("train")
    train.add_argument("folder")
    train.add_argument("bundle")
    train.add_argument("--family", default="logistic_regression")
    train.add_argument("--calibrator", default="sigmoid", choices=("sigmoid", "isotonic"))
    evaluate = commands.add_parser("evaluate")
    for a in ("folder", "bundle", "out"):
        evaluate.add_argument(a)
    again = commands.add_parser("replay")
    for a in ("folder", "bundle", "report"):
        again.add_argument(a)
    collect = commands.add_parser("collect-market-pages")
    for a in ("recordings", "path", "out"):
        collect.add_argument(a)
    args = parser.parse_args(argv)
    if args.command == "version":
        print(__version__)
        return 0
    from rallyframe.plans import general, reference, pipelines
    from rallyframe.session import get_session
    from rallyframe.sources.artifacts import write_report
    from rallyframe.sources.tables import table_if_there
    from rallyframe.util import purge, ship_code

    known = general.QUERIES | reference.QUERIES
    if args.command == "queries":
        print("\n".join(sorted(known)))
        return 0
    spark = get_session()
    ship_code(spark)
    if args.command == "health":
        print("ok" if spark.range(1).count() == 1 else "failing")
    elif args.command == "run":
        known[args.name](spark, args.folder).write.mode("errorifexists").parquet(args.out)
    elif args.command == "ingest-snapshot":
        pipelines.persist(pipelines.canonical_tables(spark, args.root, args.repo, args.commit), args.out)
    elif args.command == "train":
        print(json.dumps(pipelines.train_bundle(spark, args.folder, args.bundle, args.family, args.calibrator), sort_keys=True))
    elif args.command == "evaluate":
        rows, metrics = pipelines.evaluate_bundle(spark, args.folder, args.bundle)
        write_report(args.out, {"predictions": rows}, {"bundle": args.bundle, "metrics": metrics})
    elif args.command == "replay":
        n = pipelines.replay_bundle(spark, args.folder, args.bundle, spark.read.parquet(f"{args.report}/predictions.parquet")).count()
        print(f"{n} predictions differ")
        purge(spark)
        return 1 if n else 0
    elif args.command == "build-features":
        matches, rankings = _tables(spark, args.folder, ["canonical_matches", "canonical_rankings"])
        stats = table_if_there(spark, args.folder, "canonical_match_stats")
        pipelines.persist(pipelines.feature_tables(matches, rankings, stats), args.out)
    else:
        from rallyframe.sources.market_api import collect_tables, file_transport

        pipelines.persist(collect_tables(spark, file_transport(args.recordings), args.path.split(",")), args.out)
    purge(spark)
    return 0


if __name__ == "__main__":
    sys.exit(main())
