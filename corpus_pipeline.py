"""The corpus pipeline: five stages, each on all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the
next one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from effectlens.llm.bpe import encode_documents
from effectlens.llm.decontaminate import decontaminated
from effectlens.llm.langid import UNKNOWN, fit, fold, identify
from effectlens.llm.lines import dedup_lines
from effectlens.llm.neardup import near_duplicates
from effectlens.llm.queries import token_digests, tokenizer_path
from effectlens.llm.shared import stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled ones are in.

    A text that is null, empty or without a letter is in none and goes, whatever its id; so does one that
    needs over twice the phrases of unseen text of its nearest language, as a related language may not.  Rows are judged by their
    own text alone, so repeated rows and rows without an id share its fate.  Ties, very long texts and
    columns of any name change nothing.  Without labelled rows no language is known and no row stays.
    """
    model = fit(docs.filter(F.coalesce(fold("doc_id", 4) != 2, F.lit(False))))
    named = identify(docs, model, carry=docs.columns)
    return named.filter((F.col("lang_pred") != UNKNOWN) & ~F.col("foreign")).select(*[f"`{c}`" for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a document of smaller id holds.

    All rows stay, with null and empty texts as they are.  A row without an id keeps its lines and takes
    none from others; rows equal in id and text come out equal.  An empty table stays empty.
    """
    return dedup_lines(docs).select(*[f"`{c}`" for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, linked at 0.8 of five-word shingles; 34 bands of 6 values miss one pair at 0.8 in 30,000.

    Every row is a document of its own here, also one that repeats an id or has none.  Of a group the row of
    the smallest id stays, of equal ids any, of rows without an id one if there is no other.  Rows whose text
    is null, empty or blank are near nothing and all stay.  An empty table stays empty.
    """
    numbered = stored(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("at")), "numbered")
    found = near_duplicates(numbered.select("at", F.col("row")["text"].alias("text")), id_col="at", percent=80, bands=34, rows=6)
    copies = found.filter("NOT kept").select("at", "component_id")
    members = stored(copies.unionByName(copies.select(F.col("component_id").alias("at"), "component_id").distinct()), "members")
    named = members.join(numbered.select("at", F.col("row")["doc_id"].alias("id")), "at")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "at")).alias("m")).select(F.col("m.at").alias("at"))
    gone = members.select("at").join(first, "at", "left_anti")
    return numbered.join(gone, "at", "left_anti").select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item.

    Each row is judged by its own text: one without an id goes like any other, repeated rows go together,
    null and empty texts hold nothing and stay.  Without items all rows stay.
    """
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left, and of its decoding.

    One row for each row, with its id, null or not.  A null or empty text has no token.
    """
    return token_digests(encode_documents(docs, tokenizer_path()))


STAGES = [
    ("language_id", language),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("bpe", tokenize),
]

#: The first stage, a trained model, has no SQL form; the tests compare the stages with plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
