"""Command line: train, predict, infer, report, run (train, predict and report in turn), check-env."""

from __future__ import annotations

import argparse
import importlib.util
import sys

NEEDED = ("pyspark", "numpy", "pandas", "pyarrow", "yaml")


def check_env() -> int:
    missing = [m for m in NEEDED if importlib.util.find_spec(m) is None]
    print("all modules found" if not missing else f"missing: {', '.join(missing)}")
    return int(bool(missing))


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="effectlens")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("train", "predict", "report", "run"):
        commands.add_parser(name).add_argument("--config", required=True)
    infer = commands.add_parser("infer")
    for name in ("--config", "--data", "--output-subdir"):
        infer.add_argument(name, required=True)
    commands.add_parser("check-env")
    given = parser.parse_args(args)
    if given.command == "check-env":
        return check_env()
    from pyspark.sql import SparkSession

    from effectlens.plans import training
    from effectlens.plans.report import report
    from effectlens.sources.files import load_config

    config = load_config(given.config)
    out = config["paths"]["output_dir"]
    spark = SparkSession.builder.appName("effectlens").getOrCreate()
    if given.command in ("train", "run"):
        training.train(spark, config["paths"]["input_data"], config, out)
    if given.command in ("predict", "run"):
        training.predict(spark, out)
    if given.command in ("report", "run"):
        report(spark, out)
    if given.command == "infer":
        training.infer(spark, out, given.data, f"{out}/{given.output_subdir}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
