"""Line deduplication over levelled sorted runs of line hashes.

The runs hold, for every line key seen so far, its 128-bit hash and the smallest document that holds
it, in buckets sorted by hash.  A batch of documents is merge-joined with the runs: its keys without a
match (the anti-join) become a run of level 0, the others name the document that holds them; when a
level has ``fanout`` runs they are compacted into one run of the next level.  Lines whose key a smaller
document holds, in the runs or in the batch itself, are dropped.

``dedup_lines`` feeds a whole table in batches of ascending ids, so that the first holder is the
smallest.  Only DataFrame functions are used.  A line that very many documents share is
pre-aggregated before each shuffle, and the join that finds its copies meets one row per key.

Edge cases: a null or empty text is one empty line, and stays.  A row without an id keeps all its
lines and holds none.  Repeated rows (equal id and text) get equal results, and their lines count as
of one document; rows with one id and different texts are one holder but lose lines on their own.
An empty table gives an empty result.  Columns of other names are passed through.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from effectlens.llm.shared import new_table, stored

BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h1", "h2"]
SORTED_SCANS = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(BLANK))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


class LineRuns:
    """Levelled runs of line keys; ``levels[i]`` lists the tables of level i.

    A run is a table in buckets of its key's hash, one sorted file for each, as many as the shuffles of the
    session have partitions.  So a merge join reads it as it lies: only a batch's own keys are exchanged.
    """

    def __init__(self, spark: SparkSession, fanout: int = 3):
        self.spark, self.fanout, self.levels = spark, fanout, [[]]
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    @contextmanager
    def in_order(self) -> Iterator[None]:
        """Within it, scans of buckets of one file each count as sorted."""
        before = self.spark.conf.get(SORTED_SCANS)
        self.spark.conf.set(SORTED_SCANS, "true")
        try:
            yield
        finally:
            self.spark.conf.set(SORTED_SCANS, before)

    def write(self, keys: DataFrame) -> tuple[str, str]:
        """(table, path) of keys, dealt and sorted into buckets."""
        path = new_table(self.spark, "line_run")
        name = "line_run_" + uuid4().hex
        with self.in_order():
            keys.write.format("parquet").option("path", path).bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(name)
        return name, path

    def read(self, name: str) -> DataFrame:
        return self.spark.table(name).filter("known IS NULL").select(*KEY, "first")

    def all(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, batch: DataFrame) -> DataFrame:
        """Take in a batch of (id, h1, h2); returns (h1, h2, first) of the keys with a line to drop.

        The batch's keys are merged with each run in turn.  Those that no run knows are the new run; keys of
        runs are disjoint, so that at most one knows any.
        """
        own = batch.groupBy(*KEY).agg(F.min("id").alias("first"), F.max("id").alias("last"))
        names = self.all()
        for i, name in enumerate(names):
            own = own.join(self.read(name).withColumnRenamed("first", f"in{i}").hint("merge"), KEY, "left")
        known = F.coalesce(F.lit(None).cast("long"), *[F.col(f"in{i}") for i in range(len(names))])
        name, path = self.write(own.select(*KEY, "first", "last", known.alias("known")))
        self.levels[0].append(name)
        self.compact()
        keys = self.spark.read.schema("h1 long, h2 long, first long, last long, known long").parquet(path)
        return keys.filter("known IS NOT NULL OR first < last").select(*KEY, F.coalesce("known", "first").alias("first"))

    def compact(self) -> None:
        """Merge each level that is full into one run of the next."""
        for i, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                if i + 1 == len(self.levels):
                    self.levels.append([])
                merged = reduce(DataFrame.unionByName, map(self.read, level)).groupBy(*KEY).agg(F.min("first").alias("first"))
                self.levels[i + 1].append(self.write(merged.withColumn("known", F.lit(None).cast("long")))[0])
                self.levels[i] = []
                self.forget(level)

    def forget(self, names: list[str]) -> None:
        """Take tables off the session's list; their files stay, as what was planned from them may still run."""
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, batches: int = 4, fanout: int = 3) -> DataFrame:
    """docs with the text that stays, and (n_lines, n_dropped); other columns as they are."""
    spark, text = docs.sparkSession, F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    row = [F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("of")]
    cuts = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else []
    batch = sum(((F.col("id") > c).cast("int") for c in cuts or []), F.lit(0))
    lines = docs.filter(F.col(id_col).isNotNull()).select(*row, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    lines = lines.select("id", "of", "pos", batch.alias("batch"), line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
    lines = stored(lines.select("id", "of", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "batch"), "lines", "batch")
    runs = LineRuns(spark, fanout)
    found = None
    try:
        for b in range(len(cuts or []) + 1):
            repeats = runs.add(lines.filter(F.col("batch") == b)).withColumn("batch", F.lit(b))
            found = repeats if found is None else found.unionByName(repeats)
    finally:
        runs.forget(runs.all())
    drops = lines.join(found, [*KEY, "batch"]).filter("id > first").groupBy("id", "of").agg(F.collect_set("pos").alias("drop"))
    # The texts are dealt out by id once; what meets them is a list of positions for each.  A row travels
    # as one column, so that its names clash with none here.
    rows = docs.select(F.struct("*").alias("row"), *row, F.split(text, "\n").alias("lines"))
    rows = rows.join(drops, ["id", "of"], "left")
    stay = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop")), lambda i: F.get("lines", i))
    kept = F.when(F.col("drop").isNull(), F.col("row")[text_col]).otherwise(F.array_join(stay, "\n"))
    counts = [F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped")]
    return rows.select(*[kept.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")], *counts)


ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
e AS (SELECT rid, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM t),
k AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
d AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.*, coalesce(k.doc_id > d.first, false) AS gone FROM k LEFT JOIN d ON k.key = d.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid
"""
