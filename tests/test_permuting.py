import numpy as np
import pytest
from pyspark.sql import functions as F

from effectlens.operators import permuting as P
from effectlens.operators import resampling as R


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 10, 26, 97, 100, 1000, 4099])
def test_places_are_permuted(spark, n):
    rows = spark.range(n).select(F.col("id").alias("k"), F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("b"))
    got = P.with_place(rows, "k", n, P.key_columns(9, "t", F.col("b")), "to").toPandas()
    for b in range(3):
        mine = got[got.b == b].sort_values("k")
        assert sorted(mine["to"]) == list(range(n))
        if b == 0:
            assert mine["to"].tolist() == [P.place_of(k, n, P.round_keys(9, "t", 0)) for k in range(n)]
    sized = P.with_place(rows.filter("b = 0").withColumn("n", F.lit(n)), "k", F.col("n"), P.round_keys(9, "t", 0), "to")
    assert sized.columns == ["k", "b", "n", "to"] and sorted(sized.toPandas()["to"]) == list(range(n))


def test_places_are_spread_evenly():
    n, runs = 60, 3000
    hits = np.zeros((n, n))
    pairs = np.zeros((n, n))
    for b in range(runs):
        to = [P.place_of(k, n, P.round_keys(b, "even")) for k in range(n)]
        hits[np.arange(n), to] += 1
        pairs[to[0], to[1]] += 1
    expected = runs / n
    assert ((hits - expected) ** 2 / expected).sum() / (n - 1) ** 2 == pytest.approx(1, abs=0.12)
    off = ~np.eye(n, dtype=bool)
    rest = runs / n / (n - 1)
    assert pairs[~off].sum() == 0 and ((pairs[off] - rest) ** 2 / rest).sum() / off.sum() == pytest.approx(1, abs=0.12)


def test_permutations_sort_nothing_but_the_first_order(spark):
    pairs = spark.range(200).select(F.col("id").alias("key"), F.col("id").alias("y"), (F.col("id") * 2).alias("p"))
    got = R.permuted(pairs, "key", 4, 1)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan
    rows = got.toPandas()
    for b in range(4):
        mine = rows[rows.b == b]
        assert sorted(mine["y"]) == list(range(200)) and sorted(mine["p"]) == list(range(0, 400, 2))
    assert len({tuple(rows[rows.b == b].sort_values("p")["y"]) for b in range(4)}) == 4


def test_shadows_stay_in_their_fold(spark):
    rows = spark.range(300).select(F.concat(F.lit("r"), "id").alias("key"), (F.col("id") % 7 % 3).cast("int").alias("fold"), F.col("id").alias("a"), (F.col("id") * 3).alias("b"))
    got = R.shadow_by_fold(rows, "key", ["a", "b"], "fold", 5).join(rows, "key").toPandas()
    assert len(got) == 300
    for _, part in got.groupby("fold"):
        assert sorted(part["shadow_a"]) == sorted(part["a"]) and sorted(part["shadow_b"]) == sorted(part["b"])
        assert (part["shadow_a"] != part["a"]).mean() > 0.9 and (part["shadow_b"] != 3 * part["shadow_a"]).mean() > 0.9
    whole = R.shadow(rows, "key", ["a"], 5).toPandas()
    assert sorted(whole["shadow_a"]) == list(range(300))
