"""Queries on effects, their resamples, calibration and presentation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectlens.functions.columns import ordinal_code, stratum
from effectlens.operators import effects as X
from effectlens.operators import presentation as P
from effectlens.operators import resampling as R
from effectlens.operators import splines as S
from effectlens.operators.encoding import encode
from effectlens.plans import training as T
from effectlens.plans.cleaning import LEVELS_SQL, PRIORITIES
from effectlens.plans.registry import SEED, query, rounded, table
from effectlens.plans.scoring import DRAW, RUNS, SHADOW, order_rows
from effectlens.sources.scratch import stored

N_BOOT = 64
A, B = "o_orderpriority", "o_orderstatus"
EFFECTS = [(A, A, None, "ordinal", None), (B, B, None, "nominal", None), (f"{A} x {B}", A, B, "ordinal", "nominal")]
STRATA = {A: "singleton_ordinal", B: "singleton_nominal", f"{A} x {B}": "interaction_nominal_ordinal"}


#: What the first priority adds to the price: an effect that is there to be found.
PLANTED_SQL = "o_totalprice + CASE WHEN o_orderpriority = '1-URGENT' THEN 300000 ELSE 0 END"


def planted(spark, sf_dir) -> DataFrame:
    return order_rows(spark, sf_dir).withColumn("o_totalprice", F.expr(PLANTED_SQL))


def cells(rows: DataFrame) -> DataFrame:
    return X.cell_effects(rows, A, B, "o_totalprice")


def with_cells(rows: DataFrame) -> DataFrame:
    """rows with their cells' effects.  A row for each pair of the two features' levels, 15 whatever the rows, is sent to all: dealt out by cell, most rows would meet in a few tasks."""
    return rows.join(F.broadcast(cells(rows).drop("n")), [A, B])


def in_long_form(wide: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, eff, i, j, stratum, x, phi) of cells: one row for each effect."""
    parts = []
    for (eff, i, j, ti, tj), phi in zip(EFFECTS, ("phi_a", "phi_b", "phi_ab"), strict=True):
        x = F.concat_ws("|", i, j) if j else F.col(i)
        parts.append(F.struct(F.lit(eff).alias("eff"), F.lit(i).alias("i"), F.lit(j).cast("string").alias("j"), stratum(F.lit(ti), F.lit(tj).cast("string")).alias("stratum"), x.alias("x"), F.col(phi).alias("phi")))
    return wide.select(*keep, F.explode(F.array(*parts)).alias("e")).select(*keep, "e.*")


def effects_long(spark, sf_dir) -> DataFrame:
    """(row, eff, i, j, stratum, x, phi) of each order."""
    rows = planted(spark, sf_dir)
    return in_long_form(with_cells(rows), ["o_orderkey"]).withColumnRenamed("o_orderkey", "row")


def boots(spark, sf_dir) -> DataFrame:
    """(b, eff, stratum, m, v, gii).  Draws are counted per cell before any effect is looked at."""
    rows = planted(spark, sf_dir)
    placed = R.dense_index(rows, [F.col("o_orderkey")])
    drawn = R.with_drawn(R.bootstrap_indices(spark, rows.count(), N_BOOT, SEED), placed).groupBy("b", A, B).agg(F.count("*").alias("times"))
    return of_draws(drawn, rows)


def of_draws(drawn: DataFrame, rows: DataFrame) -> DataFrame:
    long = in_long_form(drawn.join(cells(rows).drop("n"), [A, B]), ["b", "times"])
    return X.variability(long, ["b", "eff", "stratum"], ["x"], times="times")


def both_boots(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Of the features and of their shadows.  Rows are numbered once, for the shadows and for the draws, and both sides count the same draws."""
    names = {A: f"shadow_{A}", B: f"shadow_{B}"}
    placed = stored(R.with_shadow(planted(spark, sf_dir), "o_orderkey", [A, B], SEED).drop("o_orderkey"), "shadowed")
    fake = placed.select("o_totalprice", *[F.col(n).alias(c) for c, n in names.items()])
    drawn = R.with_drawn(R.bootstrap_indices(spark, placed.count(), N_BOOT, SEED), placed)
    drawn = stored(drawn.groupBy("b", A, B, *names.values()).agg(F.count("*").alias("times")), "draws")
    real = drawn.groupBy("b", A, B).agg(F.sum("times").alias("times"))
    shadows = drawn.groupBy("b", *[F.col(n).alias(c) for c, n in names.items()]).agg(F.sum("times").alias("times"))
    return of_draws(real, placed), of_draws(shadows, fake)


CELL = """{t}_ab AS (SELECT o_orderpriority AS a, o_orderstatus AS s, avg(o_totalprice) AS v FROM {t} GROUP BY 1, 2),
{t}_a AS (SELECT o_orderpriority AS a, avg(o_totalprice) AS va FROM {t} GROUP BY 1), {t}_s AS (SELECT o_orderstatus AS s, avg(o_totalprice) AS vs FROM {t} GROUP BY 1),
{t}_0 AS (SELECT avg(o_totalprice) AS v0 FROM {t}),
{t}_cell AS (SELECT a, s, va - v0 AS phi_a, vs - v0 AS phi_s, v - va - vs + v0 AS phi_as FROM {t}_ab JOIN {t}_a USING (a) JOIN {t}_s USING (s), {t}_0)"""
LONG = """SELECT {k}, 'o_orderpriority' AS eff, 'o_orderpriority' AS i, NULL AS j, 'singleton_ordinal' AS stratum, a AS x, phi_a AS phi FROM {f} UNION ALL
SELECT {k}, 'o_orderstatus', 'o_orderstatus', NULL, 'singleton_nominal', s, phi_s FROM {f} UNION ALL
SELECT {k}, 'o_orderpriority x o_orderstatus', 'o_orderpriority', 'o_orderstatus', 'interaction_nominal_ordinal', a || '|' || s, phi_as FROM {f}"""
REAL = f"real AS (SELECT * REPLACE ({PLANTED_SQL} AS o_totalprice), row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders)"
FAKE = f"fake AS (SELECT o_orderkey, {PLANTED_SQL} AS o_totalprice, k, shadow_o_orderpriority AS o_orderpriority, shadow_o_orderstatus AS o_orderstatus FROM ({SHADOW}))"
DRAWS = f"draws AS (SELECT b, {DRAW.format(seed=SEED, n='(SELECT count(*) FROM real)')} AS k FROM {RUNS.format(b=N_BOOT)}, (SELECT unnest(range((SELECT count(*) FROM real))) AS slot))"
BOOT = """{t}_w AS (SELECT b, o_orderpriority AS a, o_orderstatus AS s, count(*) AS w FROM draws JOIN {t} USING (k) GROUP BY ALL),
{t}_wc AS (SELECT * FROM {t}_w JOIN {t}_cell USING (a, s)), {t}_wl AS (""" + LONG.format(k="b, w", f="{t}_wc") + """),
{t}_boot AS (SELECT *, sqrt(m * v) AS gii FROM (SELECT b, eff, stratum, sum(w * abs(phi)) / sum(w) AS m,
sqrt(greatest(sum(w * phi * phi) / sum(w) - (sum(w * phi) / sum(w)) ** 2, 0)) AS v FROM {t}_wl GROUP BY ALL))"""
WITH_REAL = f"WITH {REAL}, {CELL.format(t='real')}"
WITH_LONG = f"{WITH_REAL}, rl AS (SELECT o_orderkey AS row, o_orderpriority AS a, o_orderstatus AS s, c.* EXCLUDE (a, s) FROM real JOIN real_cell c ON o_orderpriority = c.a AND o_orderstatus = c.s), long AS ({LONG.format(k='row', f='rl')})"
WITH_BOOT = f"{WITH_REAL}, {DRAWS}, {BOOT.format(t='real')}"
WITH_BOTH = f"{WITH_BOOT}, {FAKE}, {CELL.format(t='fake')}, {BOOT.format(t='fake')}"
NOISE = ", noise AS (SELECT b, stratum, max(m) AS m, max(v) AS v, max(gii) AS gii FROM fake_boot GROUP BY ALL), any_noise AS (SELECT b, max(m) AS m, max(v) AS v, max(gii) AS gii FROM noise GROUP BY b)"
HELD = ", held AS (SELECT r.*, n.m AS noise_m, n.v AS noise_v, n.gii AS noise_gii FROM real_boot r JOIN noise n USING (b, stratum))"
P_SQL = f"(count(*) FILTER ({{s}} <= noise_{{s}}) + 1) / {N_BOOT + 1}"
PVALS = ", p AS (SELECT eff, stratum, " + ", ".join(P_SQL.format(s=s) + f" AS {s}_p" for s in X.STATISTICS) + " FROM held GROUP BY ALL)"
QVALS = ", " + ", ".join(
    f"q_{s} AS (SELECT eff, least(1.0, min({s}_p * n / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) AS {s}_q FROM (SELECT eff, {s}_p, row_number() OVER (ORDER BY {s}_p, eff) AS k, count(*) OVER () AS n FROM p))" for s in X.STATISTICS
)
SUMS = ", sums AS (SELECT eff, " + ", ".join(
    f"avg({s}) AS {s}_value, quantile_cont({s}, 0.025) AS {s}_ci_low, quantile_cont({s}, 0.975) AS {s}_ci_high, CASE WHEN quantile_cont({s}, 0.975) - quantile_cont({s}, 0.025) > 1e-12 THEN median({s}) / (quantile_cont({s}, 0.975) - quantile_cont({s}, 0.025)) ELSE 0 END AS {s}_stab"
    for s in X.STATISTICS
) + " FROM real_boot GROUP BY eff)"
STATS = WITH_BOTH + NOISE + HELD + PVALS + QVALS + SUMS + ", stats AS (SELECT *, " + ", ".join(f"coalesce({s}_q < 0.05 AND {s}_stab >= 2, false) AS {s}_sig" for s in X.STATISTICS) + " FROM p JOIN sums USING (eff) JOIN q_m USING (eff) JOIN q_v USING (eff) JOIN q_gii USING (eff))"


def stats(spark, sf_dir) -> DataFrame:
    return X.statistics(*both_boots(spark, sf_dir), N_BOOT)


@query(f"{WITH_REAL} SELECT a AS level, round(any_value(phi_a), 4) AS phi, (SELECT count(*) FROM orders WHERE o_orderpriority = a) AS n FROM real_cell GROUP BY a")
def effect_singletons(spark, sf_dir):
    return rounded(X.level_effects(planted(spark, sf_dir), A, "o_totalprice").select("level", "phi", "n"))


@query(f"{WITH_REAL} SELECT a AS o_orderpriority, s AS o_orderstatus, round(phi_a, 4) AS phi_a, round(phi_s, 4) AS phi_b, round(phi_as, 4) AS phi_ab FROM real_cell WHERE abs(phi_as) > 0")
def effect_interactions_2way(spark, sf_dir):
    features = spark.createDataFrame([(A,), (B,)], "feature string")
    wide = cells(planted(spark, sf_dir))
    long = in_long_form(wide, []).filter("j IS NOT NULL")
    kept = X.nonzero(long, ["i", "j"]).join(X.pairs_of(features), ["i", "j"])
    return rounded(wide.join(kept, (kept["i"] == A) & (kept["j"] == B), "left_semi").select(A, B, "phi_a", "phi_b", "phi_ab"))


TYPE_I = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'ordinal' WHEN '2' THEN 'nominal' WHEN '3' THEN 'continuous' END"
TYPE_J = "CASE o_orderstatus WHEN 'F' THEN 'nominal' WHEN 'O' THEN 'continuous' END"


@query(f"""WITH e AS (SELECT DISTINCT o_orderpriority AS i, o_orderstatus AS j, coalesce({TYPE_I}, 'continuous') AS a, coalesce({TYPE_J}, 'continuous') AS b FROM orders
UNION ALL SELECT DISTINCT o_orderpriority, NULL, coalesce({TYPE_I}, 'continuous'), NULL FROM orders)
SELECT i, j, CASE WHEN j IS NULL THEN 'singleton_' || a ELSE 'interaction_' || least(a, b) || '_' || greatest(a, b) END AS stratum FROM e""")
def effect_stratum(spark, sf_dir):
    """Strata of effects whose features are named by the levels in the data; the types of some aren't known."""
    rows = order_rows(spark, sf_dir)
    left = rows.select(F.col("o_orderpriority").alias("i"), F.expr(TYPE_I).alias("type_i")).distinct().filter("type_i IS NOT NULL")
    right = rows.select(F.col("o_orderstatus").alias("j"), F.expr(TYPE_J).alias("type_j")).distinct().filter("type_j IS NOT NULL")
    pairs = rows.select(F.col("o_orderpriority").alias("i"), F.col("o_orderstatus").alias("j")).distinct()
    effs = pairs.unionByName(pairs.select("i", F.lit(None).cast("string").alias("j")).distinct())
    kind = F.when(F.col("j").isNotNull(), F.coalesce("type_j", F.lit("continuous")))
    return effs.join(left, "i", "left").join(right, "j", "left").select("i", "j", stratum(F.col("type_i"), kind).alias("stratum"))


@query(f"{WITH_LONG} SELECT eff, round(avg(abs(phi)), 4) AS m FROM long GROUP BY eff")
def effect_magnitude(spark, sf_dir):
    return rounded(effects_long(spark, sf_dir).groupBy("eff").agg(X.magnitude(F.col("phi")).alias("m")))


@query(f"""{WITH_LONG}, g AS (SELECT eff, avg(phi) OVER (PARTITION BY eff, x) AS signal FROM long WHERE j IS NULL)
SELECT eff, round(stddev_pop(signal), 3) AS v FROM g GROUP BY eff""")
def effect_variability_1d(spark, sf_dir):
    return rounded(X.variability(effects_long(spark, sf_dir).filter("j IS NULL"), ["eff"], ["x"]).select("eff", "v"), 3)


@query(f"""{WITH_LONG}, g AS (SELECT eff, avg(phi) OVER (PARTITION BY eff, x) AS signal FROM long WHERE j IS NOT NULL)
SELECT eff, round(stddev_pop(signal), 3) AS v FROM g GROUP BY eff""")
def effect_variability_2d(spark, sf_dir):
    rows = planted(spark, sf_dir)
    both = with_cells(rows).select(F.lit(f"{A} x {B}").alias("eff"), A, B, F.col("phi_ab").alias("phi"))
    return rounded(X.variability(both, ["eff"], [A, B]).select("eff", "v"), 3)


@query(f"""{WITH_LONG}, g AS (SELECT eff, phi, avg(phi) OVER (PARTITION BY eff, x) AS signal FROM long)
SELECT eff, round(sqrt(avg(abs(phi)) * stddev_pop(signal)), 3) AS gii FROM g GROUP BY eff""")
def effect_gii(spark, sf_dir):
    return rounded(X.variability(effects_long(spark, sf_dir), ["eff"], ["x"]).select("eff", "gii"), 3)


@query(f"{WITH_BOOT} SELECT eff, round(avg(gii), 3) AS gii, round(quantile_cont(gii, 0.025), 3) AS ci_low, round(quantile_cont(gii, 0.975), 3) AS ci_high FROM real_boot GROUP BY eff")
def gii_bootstrap_ci(spark, sf_dir):
    s = X.summary(boots(spark, sf_dir), "gii", ["eff"])
    return rounded(s.select("eff", F.col("gii_value").alias("gii"), F.col("gii_ci_low").alias("ci_low"), F.col("gii_ci_high").alias("ci_high")), 3)


@query(f"{WITH_BOOT}{SUMS} SELECT eff, round(m_stab, 3) AS m_stab, round(v_stab, 3) AS v_stab, round(gii_stab, 3) AS gii_stab FROM sums")
def gii_stability(spark, sf_dir):
    return rounded(X.summary(boots(spark, sf_dir), X.STATISTICS, ["eff"]).select("eff", *[f"{s}_stab" for s in X.STATISTICS]), 3)


@query(f"{WITH_BOTH}{NOISE} SELECT b::INTEGER AS b, stratum, round(m, 3) AS m, round(v, 3) AS v, round(gii, 3) AS gii FROM noise")
def noise_stratified_max(spark, sf_dir):
    return rounded(X.noise(both_boots(spark, sf_dir)[1]), 3)


@query(f"""{WITH_BOTH}, few AS (SELECT * FROM fake_boot WHERE stratum <> 'singleton_nominal'), own AS (SELECT b, stratum, max(gii) AS gii FROM few GROUP BY ALL), whole AS (SELECT b, max(gii) AS gii FROM few GROUP BY b)
SELECT r.b::INTEGER AS b, r.eff, round(coalesce(own.gii, whole.gii), 3) AS noise_gii FROM real_boot r LEFT JOIN own ON own.b = r.b AND own.stratum = r.stratum JOIN whole ON whole.b = r.b""")
def noise_global_fallback(spark, sf_dir):
    real, shadows = both_boots(spark, sf_dir)
    return rounded(X.with_noise(real, shadows.filter("stratum <> 'singleton_nominal'")).select("b", "eff", "noise_gii"), 3)


@query(f"""{WITH_BOTH}, u AS (SELECT eff, stratum, false AS is_shadow FROM real_boot UNION SELECT eff, stratum, true FROM fake_boot)
SELECT stratum, count(*) FILTER (NOT is_shadow) AS n_real, count(*) FILTER (is_shadow) AS n_shadow FROM u GROUP BY stratum""")
def real_shadow_split(spark, sf_dir):
    real, shadows = both_boots(spark, sf_dir)
    both = real.select("eff", "stratum", F.lit(False).alias("is_shadow")).unionByName(shadows.select("eff", "stratum", F.lit(True).alias("is_shadow"))).distinct()
    return both.groupBy("stratum").agg(F.count_if(~F.col("is_shadow")).alias("n_real"), F.count_if("is_shadow").alias("n_shadow"))


@query(f"{WITH_BOTH}{NOISE}{HELD}{PVALS} SELECT eff, round(m_p, 6) AS m_p, round(v_p, 6) AS v_p, round(gii_p, 6) AS gii_p FROM p")
def exceedance_p(spark, sf_dir):
    held = X.with_noise(*both_boots(spark, sf_dir))
    return rounded(held.groupBy("eff").agg(*[X.exceedance(s, N_BOOT).alias(f"{s}_p") for s in X.STATISTICS]), 6)


@query("""WITH t AS (SELECT c_custkey, (('0x' || substr(md5('p|' || c_custkey), 1, 6))::BIGINT + 1) / 16777217.0 AS p FROM customer),
r AS (SELECT *, row_number() OVER (ORDER BY p, c_custkey) AS k, count(*) OVER () AS n FROM t)
SELECT c_custkey, round(least(1.0, min(p * n / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)), 6) AS q FROM r""")
def bh_fdr(spark, sf_dir):
    p = (F.conv(F.substring(F.md5(F.concat(F.lit("p|"), F.col("c_custkey").cast("string"))), 1, 6), 16, 10).cast("long") + 1) / 16777217.0
    return rounded(X.bh(table(spark, sf_dir, "customer").select("c_custkey", p.alias("p")), "p", "q").select("c_custkey", "q"), 6)


@query(f"{STATS} SELECT eff, m_sig, v_sig, gii_sig FROM stats")
def significance_flags(spark, sf_dir):
    return stats(spark, sf_dir).select("eff", "m_sig", "v_sig", "gii_sig")


STAT_COLUMNS = [f"{s}_{c}" for s in X.STATISTICS for c in ("value", "ci_low", "ci_high", "p", "q", "stab")]


@query(f"{STATS} SELECT eff, stratum, {', '.join(f'round({c}, 3) AS {c}' for c in STAT_COLUMNS)}, m_sig, v_sig, gii_sig, 0.0::DOUBLE AS v_failure_rate, false AS calc_failed FROM stats")
def stats_table(spark, sf_dir):
    out = stats(spark, sf_dir).orderBy(*X.final_order())
    return rounded(out.select("eff", "stratum", *STAT_COLUMNS, "m_sig", "v_sig", "gii_sig", "v_failure_rate", "calc_failed"), 3)


SAVE = "SELECT eff, k::INTEGER AS save_rank FROM (SELECT *, row_number() OVER (ORDER BY {s}_sig DESC, {s}_q, eff) AS k, sum({s}_sig::INT) OVER () AS n FROM stats) WHERE k <= n + 1"


@query(f"{STATS} {SAVE.format(s='gii')}")
def save_selection(spark, sf_dir):
    return X.save_set(stats(spark, sf_dir), 1, "gii_sig", "gii_q").select("eff", "save_rank")


@query(f"{STATS} {SAVE.format(s='v')}")
def save_selection_v(spark, sf_dir):
    return X.save_set(stats(spark, sf_dir), 1, "v_sig", "v_q").select("eff", "save_rank")


@query(f"{STATS} SELECT eff, (row_number() OVER (ORDER BY gii_value DESC, eff))::INTEGER AS rank FROM stats WHERE gii_sig")
def rank_significant(spark, sf_dir):
    return X.ranked_significant(stats(spark, sf_dir)).select("eff", "rank")


PRIORITY_CODE = "substr(o_orderpriority, 1, 1)::DOUBLE - 1"
STATUS_CODE = "dense_rank() OVER (ORDER BY o_orderstatus)::DOUBLE - 1"


@query(f"""{WITH_LONG}, coded AS (SELECT *, {PRIORITY_CODE} AS pc, {STATUS_CODE} AS sc FROM orders),
shown AS (SELECT o_orderkey, 'o_orderpriority' AS f, pc::INTEGER::VARCHAR AS value, pc AS code, o_orderpriority AS raw, 'ordinal' AS type FROM coded UNION ALL SELECT o_orderkey, 'o_orderstatus', o_orderstatus, sc, o_orderstatus, 'nominal' FROM coded)
SELECT l.row, eff, round(phi, 3) AS phi, i AS main_feature, j AS interaction_partner, a.value AS feature_value, a.code AS feature_code, a.raw AS main_feature_raw, a.type AS main_feature_type,
b.value AS partner_value, b.code AS partner_code, b.raw AS partner_feature_raw, b.type AS partner_feature_type
FROM long l JOIN shown a ON a.o_orderkey = l.row AND a.f = l.i LEFT JOIN shown b ON b.o_orderkey = l.row AND b.f = l.j""")
def microdata_long(spark, sf_dir):
    raw = planted(spark, sf_dir).withColumn(T.ROW, F.col("o_orderkey"))
    roles = {A: "ordinal", B: "nominal"}
    rows = encode(raw, roles, {A: PRIORITIES}, keep=[T.ROW])
    return rounded(X.microdata(effects_long(spark, sf_dir), T.shown_values(rows, T.as_written(raw, [A, B]), T.Contract({}, "regression", [], roles))), 3)


@query(f"{WITH_LONG} PIVOT (SELECT row, eff, round(phi, 3) AS phi FROM long) ON eff IN ('o_orderpriority', 'o_orderstatus', 'o_orderpriority x o_orderstatus') USING first(phi) GROUP BY row".replace("PIVOT (SELECT", "SELECT * FROM (PIVOT (SELECT", 1) + ")")
def effects_pivot_wide(spark, sf_dir):
    return rounded(effects_long(spark, sf_dir).groupBy("row").pivot("eff", [e[0] for e in EFFECTS]).agg(F.first("phi")), 3)


@query(f"""{WITH_BOOT} SELECT b::INTEGER AS b, eff, 'm' AS statistic, round(m, 3) AS value FROM real_boot UNION ALL SELECT b::INTEGER, eff, 'v', round(v, 3) FROM real_boot
UNION ALL SELECT b::INTEGER, eff, 'gii', round(gii, 3) FROM real_boot""")
def null_unpivot(spark, sf_dir):
    return rounded(boots(spark, sf_dir).unpivot(["b", "eff"], list(X.STATISTICS), "statistic", "value"), 3)


@query(f"""WITH m AS (SELECT {LEVELS_SQL} AS place, avg(o_totalprice) - (SELECT avg(o_totalprice) FROM orders) AS mean FROM orders GROUP BY 1),
s AS (SELECT place, mean, lead(place) OVER (ORDER BY place) AS x, lead(mean) OVER (ORDER BY place) AS y FROM m)
SELECT (place + x) / 2.0::DOUBLE AS crossing FROM s WHERE mean <> 0 AND y <> 0 AND sign(mean) <> sign(y)""")
def level_means_crossing(spark, sf_dir):
    rows = order_rows(spark, sf_dir)
    levels = X.level_effects(rows.withColumn("place", ordinal_code(F.col(A), PRIORITIES) + 1), "place", "o_totalprice")
    return P.mean_crossings(levels, "level", "phi")


@query("""WITH m AS (SELECT l_quantity AS x, avg(l_extendedprice) - (SELECT avg(l_extendedprice) FROM lineitem) AS y FROM lineitem GROUP BY 1),
s AS (SELECT x, y, lead(x) OVER (ORDER BY x) AS x2, lead(y) OVER (ORDER BY x) AS y2 FROM m)
SELECT round(x - y * (x2 - x) / (y2 - y), 4) AS zero FROM s WHERE y <> 0 AND y2 IS NOT NULL AND sign(y) <> sign(y2) ORDER BY x LIMIT 1""")
def trend_zero_crossing(spark, sf_dir):
    trend = X.level_effects(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")
    return rounded(P.first_zero(trend, "level", "phi"))


@query("SELECT o_orderpriority, n FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1) ORDER BY n DESC, o_orderpriority LIMIT 5")
def top5_levels(spark, sf_dir):
    return P.top_levels(order_rows(spark, sf_dir), A)


@query(f"""{STATS} SELECT eff AS metric, round(gii_value, 3) AS gii_value, CASE WHEN eff <> 'o_orderstatus' THEN round(gii_p, 6) END AS p_value FROM stats""")
def performance_join(spark, sf_dir):
    s = stats(spark, sf_dir).select(F.col("eff").alias("metric"), F.round("gii_value", 3).alias("gii_value"), F.round("gii_p", 6).alias("p_value"))
    return P.performance_panel(s.select("metric", "gii_value"), s.filter("metric <> 'o_orderstatus'"))


@query(f"{WITH_LONG} SELECT row, eff, round(-phi / (SELECT max(o_totalprice) - min(o_totalprice) FROM orders) * 100, 4) AS percent FROM long")
def shap_rescale(spark, sf_dir):
    span = order_rows(spark, sf_dir).agg((F.max("o_totalprice") - F.min("o_totalprice")).alias("span"))
    out = effects_long(spark, sf_dir).crossJoin(F.broadcast(span))
    return rounded(out.select("row", "eff", P.rescaled(F.col("phi"), F.col("span"), negate=True).alias("percent")))


@query(f"{WITH_BOTH}{NOISE}{HELD} SELECT round(greatest(max(m), max(noise_m)) * 1.05, 3) AS axis_limit FROM held")
def axis_limit(spark, sf_dir):
    return rounded(P.axis_limit(X.with_noise(*both_boots(spark, sf_dir)), "m", "noise_m"), 3)


@query("""SELECT 'l_quantity' AS feature, CASE WHEN count(DISTINCT l_quantity) <= 15 THEN 'discrete' ELSE 'continuous' END AS nature FROM lineitem UNION ALL
SELECT 'l_discount', CASE WHEN count(DISTINCT l_discount) <= 15 THEN 'discrete' ELSE 'continuous' END FROM lineitem UNION ALL
SELECT 'l_tax', CASE WHEN count(DISTINCT l_tax) <= 15 THEN 'discrete' ELSE 'continuous' END FROM lineitem UNION ALL SELECT 'l_partkey', 'discrete'""")
def effect_nature(spark, sf_dir):
    roles = {"l_quantity": "continuous", "l_discount": "continuous", "l_tax": "continuous", "l_partkey": "nominal"}
    one = table(spark, sf_dir, "lineitem").agg(*[F.count_distinct(c).alias(c) for c in roles]).unpivot([], list(roles), "feature", "n")
    role = F.create_map(*[F.lit(x) for kv in roles.items() for x in kv])[F.col("feature")]
    return one.select("feature", X.nature(F.col("n"), role).alias("nature"))


SPLINE = {"n_knots": 3, "degree": 3}  # curves of three inner knots are made of lines


def spline_rows(spark, sf_dir, second) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_linestatus", F.col("l_quantity").cast("double").alias("x1"), second.cast("double").alias("x2"), F.lit(False).alias("nominal1"), F.lit(False).alias("nominal2"), F.lit(True).alias("paired"), (F.col("l_extendedprice") / 1000).cast("double").alias("phi"), F.lit(1).alias("times"))


def least_squares_sql(rows: str, axes: list[str]) -> str:
    """Tables of least-squares fits of y on hat functions, by g: c (cells), w (g, n, mean), f (cells with their fitted value f), u (total variations)."""
    x = ", ".join(axes)
    hat = lambda a: f"greatest(0, least(CASE WHEN i{a} = 1 THEN 1 ELSE ({a} - t{a}[i{a} - 1]) / (t{a}[i{a}] - t{a}[i{a} - 1]) END, CASE WHEN i{a} = len(t{a}) THEN 1 ELSE (t{a}[i{a} + 1] - {a}) / (t{a}[i{a} + 1] - t{a}[i{a}]) END))"
    nodes = ", ".join(f"list_sort(list_distinct(list_concat([min({a}), max({a})], quantile_cont({a}, [0.25, 0.5, 0.75])))) AS t{a}" for a in axes)
    place = " + ".join([f"i{axes[-1]}", *[f"(i{a} - 1) * len(t{axes[-1]})" for a in axes[:-1]]])
    each = " ".join(f", unnest(range(1, len(t{a}) + 1)) AS u{a}(i{a})" for a in axes)
    along = " UNION ALL ".join(
        f"SELECT g, mx - mn + coalesce(abs(mn - lag(mx) OVER (PARTITION BY g ORDER BY {o})), 0) AS raw, coalesce(abs(f - lag(f) OVER (PARTITION BY g ORDER BY {o})), 0) AS fitted FROM f"
        for o in ([x] if len(axes) == 1 else [x, ", ".join(axes[::-1])])
    )
    return f"""{rows},
w AS (SELECT g, count(*) AS n, avg(y) AS mean, {nodes} FROM r GROUP BY g),
c AS (SELECT g, {x}, count(*) AS n, sum(y) AS s, min(y) AS mn, max(y) AS mx FROM r GROUP BY g, {x}),
h AS (SELECT g, {x}, n, s, i, b FROM (SELECT c.g, {x}, c.n, s, {place} AS i, {" * ".join(map(hat, axes))} AS b FROM c JOIN w USING (g){each}) WHERE b > 0),
p AS (SELECT a.g, a.i, b.i AS j, sum(a.b * b.b * a.n) AS v FROM h a JOIN h b USING (g, {x}) GROUP BY ALL UNION ALL SELECT g, i, 1000000, sum(b * s) FROM h GROUP BY ALL),
d AS (SELECT a.g, a.i, b.j FROM (SELECT DISTINCT g, i FROM p) a JOIN (SELECT DISTINCT g, j FROM p) b USING (g)),
l AS (SELECT g, i, list(coalesce(v, 0) ORDER BY j) AS line FROM d LEFT JOIN p USING (g, i, j) GROUP BY g, i),
z AS (
  SELECT g, 1 AS k, list(line ORDER BY i) AS m FROM l GROUP BY g
  UNION ALL
  SELECT g, k + 1, list_transform(range(1, len(m) + 1), lambda r: CASE WHEN r = k THEN list_transform(m[k], lambda v: v / m[k][k]) ELSE list_transform(range(1, len(m) + 2), lambda q: m[r][q] - m[r][k] * m[k][q] / m[k][k]) END)
  FROM z WHERE k <= len(m)
),
o AS (SELECT g, i, m[row_number() OVER (PARTITION BY g ORDER BY i)][len(m) + 1] AS coefficient FROM (SELECT DISTINCT g, i FROM p) JOIN (FROM z WHERE k = len(m) + 1) USING (g)),
f AS (SELECT c.*, f FROM c JOIN (SELECT g, {x}, sum(b * coefficient) AS f FROM h JOIN o USING (g, i) GROUP BY ALL) USING (g, {x})),
u AS (SELECT g, sum(raw) AS raw, sum(fitted) AS fitted FROM ({along}) GROUP BY g),
e AS (SELECT g, sum(n * (f - mean) ** 2) AS ss, sum(c.n * (s / c.n - mean) ** 2) AS by_cell FROM (SELECT f.*, mean FROM f JOIN w USING (g)) c GROUP BY g),
k AS (SELECT g, n, mean, CASE WHEN raw = 0 THEN fitted < 1e-9 ELSE fitted <= 1.001 * raw END AS calm, ss, by_cell FROM w JOIN u USING (g) JOIN e USING (g))"""


ENDED = "SELECT l_linestatus, round(m::DOUBLE, 4) AS m, round(v::DOUBLE, 4) AS v, round(sqrt(m * v)::DOUBLE, 4) AS gii FROM (SELECT l_linestatus, avg(abs(l_extendedprice / 1000)) AS m FROM lineitem GROUP BY 1) JOIN"


@query(f"""WITH RECURSIVE {least_squares_sql("r AS (SELECT l_linestatus AS g, l_quantity::DOUBLE AS x, l_extendedprice::DOUBLE / 1000 AS y FROM lineitem)", ["x"])}
{ENDED} (SELECT g AS l_linestatus, sqrt(CASE WHEN calm THEN ss ELSE by_cell END / n) AS v FROM k) USING (l_linestatus)""")
def spline_v_1d(spark, sf_dir):
    rows = spline_rows(spark, sf_dir, F.lit(0)).withColumn("paired", F.lit(False))
    return rounded(S.variability_by(rows, ["l_linestatus"], **SPLINE))


@query(f"""WITH RECURSIVE {least_squares_sql("r AS (SELECT l_linestatus AS g, l_quantity::DOUBLE AS x1, l_partkey::DOUBLE AS x2, l_extendedprice::DOUBLE / 1000 AS y FROM lineitem)", ["x1", "x2"])}
{ENDED} (SELECT g AS l_linestatus, sqrt(CASE WHEN calm THEN ss ELSE by_cell END / n) AS v FROM k) USING (l_linestatus)""")
def spline_v_2d(spark, sf_dir):
    return rounded(S.variability_by(spline_rows(spark, sf_dir, F.col("l_partkey")), ["l_linestatus"], **SPLINE))


@query(f"""WITH RECURSIVE {least_squares_sql("r AS (SELECT {'g': l_linestatus, 'd': l_discount::DOUBLE} AS g, l_quantity::DOUBLE AS x, l_extendedprice::DOUBLE / 1000 AS y FROM lineitem)", ["x"])},
j AS (SELECT g.g AS l_linestatus, n, mean, CASE WHEN calm THEN ss ELSE 0 END AS ss FROM k)
{ENDED} (SELECT l_linestatus, sqrt((sum(ss) + sum(n * mean * mean)) / sum(n) - (sum(n * mean) / sum(n)) ** 2) AS v FROM j GROUP BY 1) USING (l_linestatus)""")
def spline_v_stacked(spark, sf_dir):
    return rounded(S.variability_by(spline_rows(spark, sf_dir, F.col("l_discount")), ["l_linestatus"], **SPLINE))
