"""Reading and writing tables and artifacts."""

from __future__ import annotations

import csv
import json
import re
import uuid
import warnings
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The spellings of a missing value that CSV readers of data-frame libraries know.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def sniff(spark: SparkSession, path: str, lines: int = 20) -> str | None:
    """The separator that the first lines of a file agree on; None where none does."""
    head = "\n".join(r.value for r in spark.read.text(path).limit(lines).collect())
    try:
        return csv.Sniffer().sniff(head, delimiters=",;\t|:").delimiter
    except csv.Error:
        return None


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header.  One column only means another separator: then the first lines tell it.

    NA spellings are nulls before types are inferred.
    """
    raw = spark.read.csv(path, header=True)
    if len(raw.columns) == 1 and (sep := sniff(spark, path)) and sep != ",":
        raw = spark.read.csv(path, header=True, sep=sep)
    clean = raw.select(*[F.when(~F.col(f"`{c}`").isin(NA_TOKENS), F.col(f"`{c}`")).alias(c) for c in raw.columns])
    return infer_types(clean)


def infer_types(df: DataFrame) -> DataFrame:
    """Strings become boolean, long or double where every value allows it: one aggregation over all columns."""
    tests = {"boolean": r"^(true|True|TRUE|false|False|FALSE)$", "long": r"^[+-]?\d{1,18}$", "double": r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"}
    one = df.agg(*[F.coalesce(F.every(F.col(f"`{c}`").rlike(t)), F.lit(False)).alias(f"{i}|{kind}") for i, c in enumerate(df.columns) for kind, t in tests.items()]).first()
    kind = [next((k for k in tests if one[f"{i}|{k}"]), "string") for i in range(len(df.columns))]
    return df.select(*[F.col(f"`{c}`").cast(k).alias(c) for c, k in zip(df.columns, kind, strict=True)])


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV by its suffix, which is case-sensitive; all else is Parquet."""
    return read_csv(spark, path) if path.endswith(".csv") else spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str) -> None:
    """Spark's commit protocol makes the files of a table appear together."""
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A small result as one CSV part with a header."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One file on the filesystem that the tables go to: written beside its place, then moved there."""
    jvm = spark.sparkContext._jvm
    target, beside = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.{uuid.uuid4().hex}.tmp"))
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = files.create(beside, True)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()
    if not files.rename(beside, target):  # some filesystems don't rename over a file
        files.delete(target, False)
        if not files.rename(beside, target):
            raise OSError(f"can't write {path}")


def save_json(spark: SparkSession, data, path: str) -> None:
    write_text(spark, json.dumps(data, indent=2, sort_keys=True, default=str), path)


def load_json(spark: SparkSession, path: str):
    return json.loads(spark.read.text(path, wholetext=True).first().value)


def expand(value, paths: dict[str, str]):
    """value with every ${paths.name} in its strings filled in."""
    if isinstance(value, str):
        return re.sub(r"\$\{paths\.(\w+)\}", lambda m: str(paths.get(m[1], m[0])), value)
    if isinstance(value, dict):
        return {k: expand(v, paths) for k, v in value.items()}
    return [expand(v, paths) for v in value] if isinstance(value, list) else value


def load_config(path: str) -> dict:
    config = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    config = expand(config, config.get("paths") or {})
    if left := re.findall(r"\$\{[^}]*\}", json.dumps(config, default=str)):
        warnings.warn(f"unresolved in {path}: {', '.join(sorted(set(left)))}")
    return config


def save_config(spark: SparkSession, config: dict, path: str) -> None:
    write_text(spark, yaml.safe_dump(config, sort_keys=False), path)
