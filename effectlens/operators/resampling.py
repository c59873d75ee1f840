"""Folds, permutations and bootstraps in hash order: the same whatever the partitioning, seeds included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from effectlens.functions.columns import hash_index, hashed, let
from effectlens.operators.permuting import ROUNDS, key_columns, round_keys, with_place
from effectlens.sources.scratch import stored


RANGE_ROWS, MOST_RANGES = 500_000, 4096
TASK_DRAWS = 4_000_000


def below(cuts: list, x: Column) -> Column:
    """How many of the sorted cuts are under x: looked up in two steps of about sqrt(n) each."""
    step = max(1, int(len(cuts) ** 0.5))
    parts = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    listed = lambda some: F.array(*[F.lit(c) for c in some])
    coarse = F.size(F.filter(listed([p[0] for p in parts]), lambda b: b < x))
    fine = F.get(F.array(*[listed(p) for p in parts]), F.greatest(coarse - 1, F.lit(0)))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + F.size(F.filter(fine, lambda b: b < x)))


def dense_index(df: DataFrame, order: list[Column], name: str = "k", lead: Column | None = None, rows: int | None = None, part: Column | None = None) -> DataFrame:
    """df with each row's place, from 0, in a total order.

    lead is a number that never falls along the order (its first column, if that is a number).
    Splitters of it cut the order into ranges; a window numbers the rows within each range, and the
    ranges' counts, one row each, give where it starts.  rows, counted unless told, says how many ranges.
    Of a hash the leading digits tell the range, as part, and no splitters need be found.
    """
    if part is None:
        lead = order[0] if lead is None else lead
        parts = min(MOST_RANGES, max(64, (df.count() if rows is None else rows) // RANGE_ROWS))
        marked = df.withColumn("_lead", lead)
        cuts = marked.agg(F.percentile_approx("_lead", [i / parts for i in range(1, parts)], 20 * parts)).first()[0] or []
        cuts = sorted(set(cuts))
        marked = marked.withColumn("_part", let(F.col("_lead"), lambda x: below(cuts, x)) if cuts else F.lit(0))
    else:
        marked = df.withColumn("_part", part)
    counts = marked.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_start"))
    placed = marked.withColumn("_r", F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1)
    # One row for each of at most `parts` ranges: its size is bounded.
    placed = placed.join(F.broadcast(starts), "_part")
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_start") + F.col("_r")).cast("long").alias(name))


def hash_lead(h: Column) -> Column:
    """The leading digits of an md5 as a number, for dense_index."""
    return F.conv(F.substring(h, 1, 12), 16, 10).cast("long")


def hash_range(h: Column, rows: int) -> Column:
    """The leading digits of an md5, which never fall along its order: ranges of at most about RANGE_ROWS rows, if 4096 suffice."""
    return F.substring(h, 1, 2 if rows <= 256 * RANGE_ROWS else 3)


def kfold(df: DataFrame, key: str, folds: int, seed: int) -> DataFrame:
    """df with fold: contiguous pieces of the hash order, the first n mod folds one row larger."""
    h, n = hashed(seed, "fold", F.col(key)), df.count()
    placed = dense_index(df.withColumn("_h", h), [F.col("_h"), F.col(key)], "_k", part=hash_range(F.col("_h"), n))
    small, large = n // folds, n % folds
    edge = large * (small + 1)
    fold = F.when(F.col("_k") < edge, F.floor(F.col("_k") / (small + 1))).otherwise(large + F.floor((F.col("_k") - edge) / max(small, 1)))
    return placed.select(*df.columns, fold.cast("int").alias("fold"))


def stratified_kfold(df: DataFrame, key: str, label: str, folds: int, seed: int) -> DataFrame:
    """df with fold: within each label, rows in hash order take turns.

    A label may hold most rows, so its order is numbered in pieces of the hash's first two digits.
    """
    h = hashed(seed, "fold", F.col(key))
    marked = df.withColumn("_h", h).withColumn("_p", F.substring("_h", 1, 2))
    counts = marked.groupBy(label, "_p").agg(F.count("*").alias("_n"))
    starts = counts.select(F.col(label).alias("_l"), F.col("_p").alias("_q"), (F.sum("_n").over(W.partitionBy(label).orderBy("_p")) - F.col("_n")).alias("_start"))
    placed = marked.withColumn("_r", F.row_number().over(W.partitionBy(label, "_p").orderBy("_h", key)) - 1)
    placed = placed.join(starts, placed[label].eqNullSafe(starts["_l"]) & (placed["_p"] == starts["_q"]))
    return placed.select(*df.columns, F.pmod(F.col("_start") + F.col("_r"), F.lit(folds)).cast("int").alias("fold"))


def folds_for(df: DataFrame, key: str, label: str, folds: int, seed: int, classification: bool) -> DataFrame:
    """Stratified for a classification of under 20 classes, else plain."""
    if classification and df.agg(F.count_distinct(label)).first()[0] < 20:
        return stratified_kfold(df, key, label, folds, seed)
    return kfold(df, key, folds, seed)


def values_at(placed: DataFrame, c: str, name: str, place: str = "k") -> DataFrame:
    """(_from, name): the value at each place, to be dealt out by place: files say little of how large rows are in memory, so none are sent to all."""
    return placed.select(F.col(place).alias("_from"), F.col(c).alias(name)).hint("shuffle_hash")


def with_shadow(df: DataFrame, key: str, columns: list[str], seed: int, fold: int = 0) -> DataFrame:
    """df with k, each row's place in the order of keys, and shadow_<c>: each column's values permuted on their own.

    Rows are numbered once, and k is there for those that draw them later; where a value comes from is computed.
    """
    n = df.count()
    placed = out = stored(dense_index(df, [F.col(key)], "k", None if dict(df.dtypes)[key] != "string" else hash_free_lead(key), rows=n), "places")
    for c in columns:
        moved = with_place(out, "k", n, round_keys(seed, fold, c), "_from")
        out = moved.join(values_at(placed, c, f"shadow_{c}"), "_from").drop("_from")
    return out


def shadow(df: DataFrame, key: str, columns: list[str], seed: int, fold: int = 0) -> DataFrame:
    """(key, shadow_<c>...) of the rows."""
    return with_shadow(df.select(key, *columns), key, columns, seed, fold).select(key, *[f"shadow_{c}" for c in columns])


def shadow_by_fold(df: DataFrame, key: str, columns: list[str], fold: str, seed: int) -> DataFrame:
    """(key, shadow_<c>...): values permuted within each fold, all folds at once."""
    return with_shadow_by_fold(df.select(key, fold, *columns), key, columns, fold, seed).select(key, *[f"shadow_{c}" for c in columns])


def with_shadow_by_fold(df: DataFrame, key: str, columns: list[str], fold: str, seed: int) -> DataFrame:
    """df with shadow_<c>: values permuted within each fold, all folds at once.

    Rows are numbered by fold and a hash of the key, so a fold's places follow each other.  They bring their columns along, and aren't met again.
    """
    n = df.count()
    marked = df.withColumn("_h", hashed(seed, "place", F.col(fold), F.col(key)))
    by, part = [F.col(fold), F.col("_h"), F.col(key)], F.struct(F.col(fold), hash_range(F.col("_h"), n))
    placed = stored(dense_index(marked, by, "_k", part=part).drop("_h"), "places")
    # One row for each fold, with the keys of its permutations.
    keys = [F.array(*key_columns(seed, F.col(fold), c)).alias(f"_keys_{c}") for c in columns]
    sizes = stored(placed.groupBy(fold).agg(F.min("_k").alias("_start"), F.count("*").alias("_size")).select("*", *keys), "fold-sizes")
    out = placed.join(F.broadcast(sizes), fold).withColumn("_place", F.col("_k") - F.col("_start")).drop("_k")
    for c in columns:
        moved = with_place(out, "_place", F.col("_size"), [F.get(f"_keys_{c}", r) for r in range(ROUNDS)], "_to").withColumn("_from", F.col("_start") + F.col("_to"))
        out = moved.join(values_at(placed, c, f"shadow_{c}", "_k"), "_from").drop("_from", "_to", f"_keys_{c}")
    return out.select(*df.columns, *[f"shadow_{c}" for c in columns])


def bootstrap_indices(spark, n: int, n_boot: int, seed: int) -> DataFrame:
    """(b, slot, k): the place k drawn for each slot of each resample, made in tasks of about TASK_DRAWS."""
    parts = max(spark.sparkContext.defaultParallelism, n * n_boot // TASK_DRAWS)
    slots = spark.range(0, n, 1, parts).select(F.col("id").alias("slot"), F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("b"))
    return slots.select("b", "slot", hash_index(F.lit(n), seed, F.col("b"), F.col("slot")).alias("k"))


def bootstrap_counts(spark, n: int, n_boot: int, seed: int) -> DataFrame:
    """(b, k, times): how often each place is drawn; pre-aggregated before it is dealt out."""
    return bootstrap_indices(spark, n, n_boot, seed).groupBy("b", "k").agg(F.count("*").alias("times"))


def with_drawn(draws: DataFrame, placed: DataFrame) -> DataFrame:
    """draws (b, k...) with the row at each place k.

    Both sides are dealt out by k.  Spark takes draws for as small as the numbers that they are made from, and left to itself would send all of them through the driver.
    """
    return draws.join(placed.hint("shuffle_hash"), "k")


def cluster_bootstrap(rows: DataFrame, cluster: str, n_boot: int, seed: int) -> DataFrame:
    """(b, slot, cluster, *rows): clusters are drawn, and all their rows come along."""
    ids = stored(dense_index(rows.select(cluster).distinct(), [F.col(cluster)], "k"), "clusters")
    drawn = bootstrap_indices(rows.sparkSession, ids.count(), n_boot, seed)
    return with_drawn(drawn, ids).drop("k").join(rows, cluster)


def require_equal_clusters(rows: DataFrame, cluster: str) -> int:
    """The number of rows that every cluster has."""
    low, high = rows.groupBy(cluster).count().agg(F.min("count"), F.max("count")).first()
    if low != high:
        raise ValueError(f"clusters have from {low} to {high} rows")
    return low


def by_aggregate(metric):
    """A metric that is one aggregate of (y, p, times), as a function of tables."""

    def of(df: DataFrame, by: list[str] = (), times: str | None = None) -> DataFrame:
        return df.groupBy(*by).agg(metric(F.col("y"), F.col("p"), F.col(times) if times else F.lit(1)).alias("value"))

    return of


def bootstrap_ci(pairs: DataFrame, key: str, metric, n_boot: int, seed: int, alpha: float = 0.05) -> DataFrame:
    """One row (score, ci_low, ci_high, n_used) of a metric of (y, p); resamples of a single y are left out."""
    return bootstrap_ci_of_table(pairs.select(key, "y", "p"), key, metric, n_boot, seed, alpha, aggregate=True)


def bootstrap_ci_of_table(pairs: DataFrame, key: str, metric, n_boot: int, seed: int, alpha: float = 0.05, aggregate: bool = False) -> DataFrame:
    """The same of a metric that takes (table, by, times) and returns (by, value), value by any name.

    An aggregate metric shares its pass over the draws with the search for resamples of a single y.
    """
    placed = stored(dense_index(pairs, [F.col(key)], "k", None if dict(pairs.dtypes)[key] != "string" else hash_free_lead(key)), "placed")
    # Repeats need no counting for an aggregate: draws are dealt out once, by place.
    draws = (lambda *a: bootstrap_indices(*a).withColumn("times", F.lit(1))) if aggregate else bootstrap_counts
    drawn = with_drawn(draws(pairs.sparkSession, placed.count(), n_boot, seed), placed)
    ends = [F.min("y").alias("lo"), F.max("y").alias("hi")]
    if aggregate:
        by = drawn.groupBy("b").agg(metric(F.col("y"), F.col("p"), F.col("times")).alias("value"), *ends).filter("lo <> hi")
        metric = by_aggregate(metric)
    else:
        varied = drawn.groupBy("b").agg(*ends).filter("lo <> hi").select("b")
        by = metric(drawn, ["b"], "times").toDF("b", "value").join(varied, "b")
    spread = by.agg(F.percentile("value", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("q"), F.count("value").alias("n_used"))
    base = metric(placed).toDF("score")
    low, high = (F.coalesce(F.get("q", i), F.col("score")) for i in (0, 1))
    return base.crossJoin(spread).select("score", low.alias("ci_low"), high.alias("ci_high"), "n_used")


def hash_free_lead(key: str) -> Column:
    """A number that never falls along the order of a string: its first six bytes."""
    head = F.rpad(F.substring(F.hex(F.encode(key, "UTF-8")), 1, 12), 12, "0")
    return F.conv(head, 16, 10).cast("long")


def permuted(pairs: DataFrame, key: str, n_perm: int, seed: int) -> DataFrame:
    """(b, y, *rest): y permuted against everything else, once for each b.

    Rows are numbered once in the order of their keys; the place that each row's y comes from is computed for each b.
    """
    rest = [c for c in pairs.columns if c not in (key, "y")]
    n = pairs.count()
    placed = stored(dense_index(pairs.select(key, "y", *rest), [F.col(key)], "_r", None if dict(pairs.dtypes)[key] != "string" else hash_free_lead(key), rows=n), "places")
    # One row for each permutation.
    runs = pairs.sparkSession.range(n_perm).select(F.col("id").cast("int").alias("b"), F.array(*key_columns(seed, "perm", F.col("id"))).alias("_keys"))
    every = placed.select(*rest, "_r", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))).alias("b")).join(F.broadcast(runs), "b")
    moved = with_place(every, "_r", n, [F.get("_keys", r) for r in range(ROUNDS)], "_from")
    return moved.join(placed.select(F.col("_r").alias("_from"), "y"), "_from").select("b", "y", *rest)


def permutation_null(pairs: DataFrame, key: str, metric, n_perm: int, seed: int) -> DataFrame:
    """(b, null): a metric that takes (table, by), of each permutation."""
    return metric(permuted(pairs, key, n_perm, seed), ["b"]).toDF("b", "null")


def permutation_test(pairs: DataFrame, key: str, metric, name: str, n_perm: int, seed: int) -> DataFrame:
    """One row (metric, observed, null_mean, null_std, p_value) of a metric of (y, p)."""
    return permutation_test_of_table(pairs, key, by_aggregate(metric), name, n_perm, seed)


def permutation_test_of_table(pairs: DataFrame, key: str, metric, name: str, n_perm: int, seed: int) -> DataFrame:
    """The same of a metric that takes (table, by) and returns (by, value)."""
    return held_against(metric(pairs).toDF("observed"), permutation_null(pairs, key, metric, n_perm, seed), name)


def held_against(observed: DataFrame, null: DataFrame, name: str) -> DataFrame:
    """One row of the test from the observed value and its null (b, null)."""
    null = null.crossJoin(F.broadcast(observed))  # one row
    return null.groupBy("observed").agg(
        F.avg("null").alias("null_mean"),
        F.stddev_pop("null").alias("null_std"),
        ((F.sum(F.when(F.col("null") >= F.col("observed"), 1).otherwise(0)) + 1) / (F.count("*") + 1)).alias("p_value"),
    ).select(F.lit(name).alias("metric"), "observed", "null_mean", "null_std", "p_value")
