"""Queries on sources, selection, cleaning and encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from effectlens.functions.columns import nominal, ordinal_code, recode_missing, slug, to_number
from effectlens.operators import encoding as E
from effectlens.operators.presentation import level_order as order_levels
from effectlens.operators.selection import FeatureSelector
from effectlens.plans import config as C
from effectlens.plans.registry import query, rounded, table
from effectlens.sources.files import read_csv, write_parquet

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
LEVELS_SQL = "list_position(['1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW'], o_orderpriority)"
# The tables have no nulls or blanks: these put some in.
DIRTY = "CASE WHEN event_id % 7 = 0 THEN '   ' WHEN event_id % 11 = 0 THEN '' ELSE event_type END"
TEXTED = "CASE WHEN event_id % 5 = 0 THEN 'n/a' WHEN event_id % 7 = 0 THEN '1.5d' WHEN event_id % 11 = 0 THEN ' -2.5e1 ' ELSE cast(value AS STRING) END"
HOLES = "CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END"


def holed(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.expr(DIRTY).alias("event_type"), F.expr(HOLES).alias("value"), F.lit(None).cast("double").alias("empty"))


HOLED = f"SELECT event_id, user_id, CASE WHEN trim({DIRTY}) = '' THEN NULL ELSE {DIRTY} END AS event_type, {HOLES} AS value, NULL::DOUBLE AS empty FROM events"


@query(f"SELECT event_id, CASE WHEN regexp_full_match(t, '\\s*') THEN NULL ELSE t END AS event_type FROM (SELECT event_id, {DIRTY} AS t FROM events)")
def clean_blank_to_null(spark, sf_dir):
    return E.clean_strings(table(spark, sf_dir, "events").select("event_id", F.expr(DIRTY).alias("event_type")))


@query(rf"""SELECT event_id, CASE WHEN regexp_full_match(t, '\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*') THEN trim(t)::DOUBLE END AS value
FROM (SELECT event_id, {TEXTED.replace("STRING", "VARCHAR")} AS t FROM events)""")
def numeric_coerce(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", to_number(F.expr(TEXTED)).alias("value"))


@query("SELECT coalesce(CASE WHEN l_linenumber <> 3 THEN l_returnflag END, '__NA__') AS flag, (l_quantity::BIGINT)::VARCHAR AS quantity, count(*) AS n FROM lineitem GROUP BY ALL")
def nominal_fill_na(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(nominal(F.when(F.col("l_linenumber") != 3, F.col("l_returnflag"))).alias("flag"), nominal(F.col("l_quantity"), "double").alias("quantity"))
    return rows.groupBy("flag", "quantity").agg(F.count("*").alias("n"))


@query(f"SELECT o_orderkey, ({LEVELS_SQL} - 1)::INTEGER AS code FROM orders")
def ordinal_encode(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", ordinal_code(F.col("o_orderpriority"), PRIORITIES).alias("code"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END::INTEGER AS code FROM orders")
def ordinal_quote_normalize(spark, sf_dir):
    quoted = F.concat(F.lit("‘"), F.col("o_orderstatus"), F.lit("”"))
    return table(spark, sf_dir, "orders").select("o_orderkey", ordinal_code(quoted, ["'F\"", "’O“"]).alias("code"))


UNKNOWN_SQL = """WITH d AS (SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1)
SELECT round({}, 6) AS {} FROM d"""


@query(UNKNOWN_SQL.format("count(*) FILTER (p NOT IN ('1-URGENT','2-HIGH','3-MEDIUM'))::DOUBLE / count(*)", "unique_frac"))
def ordinal_unknown_unique_frac(spark, sf_dir):
    return rounded(E.unknown_levels(table(spark, sf_dir, "orders"), "o_orderpriority", PRIORITIES[:3]).select("unique_frac"), 6)


@query(UNKNOWN_SQL.format("sum(n) FILTER (p NOT IN ('1-URGENT','2-HIGH','3-MEDIUM'))::DOUBLE / sum(n)", "obs_frac"))
def ordinal_unknown_obs_frac(spark, sf_dir):
    return rounded(E.unknown_levels(table(spark, sf_dir, "orders"), "o_orderpriority", PRIORITIES[:3]).select("obs_frac"), 6)


@query("""SELECT * FROM (VALUES ('l_discount', 'continuous'), ('l_linenumber', 'ordinal'), ('l_linestatus', 'nominal'),
('l_quantity', 'continuous'), ('l_returnflag', 'nominal'), ('l_tax', 'continuous')) t(feature, role)""")
def feature_roles(spark, sf_dir):
    rules = {
        "continuous": [{"pattern": ["l_quantity", "l_tax"], "mode": "exact"}, {"pattern": "count", "mode": "substring"}],
        "ordinal": [{"pattern": "number", "mode": "suffix", "levels": [1, 2, 3, 4, 5, 6, 7]}],
        "nominal": [{"pattern": "l_", "mode": "prefix", "exclude": ["key", "quantity", "tax", "discount", "number", "date"]}],
    }
    found = FeatureSelector(rules).fit(table(spark, sf_dir, "lineitem").columns, outcomes=["l_extendedprice"])
    return spark.createDataFrame(sorted(found.roles.items()), "feature string, role string")


@query(f"""WITH e AS ({HOLED}), u AS (
SELECT 'event_type' AS feature, count(*) - count(event_type) AS m, count(*) AS t FROM e UNION ALL
SELECT 'value', count(*) - count(value), count(*) FROM e UNION ALL SELECT 'empty', count(*) - count(empty), count(*) FROM e UNION ALL
SELECT 'user_id', count(*) - count(user_id), count(*) FROM e)
SELECT feature, round(m::DOUBLE / t, 6) AS missing_rate, m AS missing_count, t AS total_count FROM u""")
def missingness_report(spark, sf_dir):
    report = E.missingness(E.clean_strings(holed(spark, sf_dir)), ["event_type", "value", "empty", "user_id"])
    return rounded(report.orderBy(F.desc("missing_rate"), "feature"), 6)


@query(f"SELECT event_id, user_id, event_type, value, empty FROM ({HOLED}) WHERE value IS NOT NULL AND event_type IS NOT NULL")
def drop_missing_outcome(spark, sf_dir):
    return E.drop_missing_outcome(E.clean_strings(holed(spark, sf_dir)), ["value", "event_type"])


@query("SELECT 'empty' AS feature")
def all_missing_columns(spark, sf_dir):
    rows = holed(spark, sf_dir)
    return spark.createDataFrame([(c,) for c in E.all_missing(rows, rows.columns)], "feature string")


@query(f"SELECT event_id, value IS NOT NULL AND event_type IS NOT NULL AS supervised FROM ({HOLED})")
def supervised_mask(spark, sf_dir):
    return E.supervised(E.clean_strings(holed(spark, sf_dir)), ["value", "event_type"]).select("event_id", "supervised")


@query(f"""WITH e AS ({HOLED}) SELECT 'empty' AS feature, 1.0::DOUBLE AS missing_rate FROM e HAVING avg((empty IS NULL)::INT) > 0.2
UNION ALL SELECT 'value', round(avg((value IS NULL)::INT), 6) FROM e HAVING avg((value IS NULL)::INT) > 0.2
UNION ALL SELECT 'event_type', round(avg((event_type IS NULL)::INT), 6) FROM e HAVING avg((event_type IS NULL)::INT) > 0.2""")
def high_missing_features(spark, sf_dir):
    rows = E.require_columns(E.clean_strings(holed(spark, sf_dir)), ["event_type", "value", "empty"])
    return rounded(E.missingness(rows, rows.columns).filter("missing_rate > 0.2").select("feature", "missing_rate"), 6)


@query("SELECT quality, count(*) AS n, count(*) >= 5 AS enough FROM labels GROUP BY 1")
def class_counts(spark, sf_dir):
    return E.class_counts(table(spark, sf_dir, "labels"), "quality", 5)


@query("SELECT DISTINCT toxic AS label FROM labels WHERE toxic IS NOT NULL")
def distinct_labels(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(F.col("toxic").alias("label")).filter("label IS NOT NULL").distinct().orderBy("label")


@query("""SELECT 'l_extendedprice' AS target, round(avg(l_extendedprice), 4) AS mean, round(stddev_pop(l_extendedprice), 4) AS scale FROM lineitem
UNION ALL SELECT 'l_tax', round(avg(l_tax), 4), round(stddev_pop(l_tax), 4) FROM lineitem""")
def zscore_targets(spark, sf_dir):
    return rounded(E.zscore(table(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_tax"]))


@query("""SELECT l_returnflag AS flag, round(sum((l_extendedprice - m) / s), 3) AS z_sum, round(sum((l_extendedprice - m) / s * s + m) / 1000, 1) AS back_sum
FROM lineitem, (SELECT avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS s FROM lineitem) GROUP BY 1""")
def zscore_inverse(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")
    moments = E.zscore(rows, ["l_extendedprice"])
    z = E.scaled(rows, ["l_extendedprice"]).crossJoin(F.broadcast(moments))
    out = z.groupBy(F.col("l_returnflag").alias("flag")).agg(F.sum("l_extendedprice").alias("z_sum"), F.sum(F.col("l_extendedprice") * F.col("scale") + F.col("mean")).alias("back_sum"))
    return out.select("flag", F.round("z_sum", 3).alias("z_sum"), F.round(F.col("back_sum") / 1000, 1).alias("back_sum"))


@query("""WITH c AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS code FROM (SELECT DISTINCT o_orderstatus AS s FROM orders WHERE o_orderstatus <> 'F'))
SELECT o_orderkey, coalesce(c.code, (SELECT max(code) + 1 FROM c))::INTEGER AS status, coalesce(CASE WHEN o_totalprice > 100000 THEN o_totalprice END, 0) AS price, o_totalprice <= 100000 AS price_missing
FROM orders LEFT JOIN c ON o_orderstatus = c.s""")
def numeric_matrix_codes(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("status"), F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("price"))
    codes = E.level_codes(rows, "status")
    last = codes.agg((F.max("code") + 1).alias("none"))
    out = rows.join(codes, "status", "left").crossJoin(F.broadcast(last))
    return out.select("o_orderkey", F.coalesce("code", "none").cast("int").alias("status"), F.coalesce("price", F.lit(0.0)).alias("price"), F.col("price").isNull().alias("price_missing"))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def csv_delimiter_fallback(spark, sf_dir):
    from effectlens.sources.scratch import scratch

    path = scratch(spark, "orders-csv")
    table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority").write.csv(path, header=True, sep=";")
    return read_csv(spark, path)


@query("SELECT o_totalprice, o_orderkey FROM orders")
def parquet_roundtrip_projection(spark, sf_dir):
    from effectlens.sources.scratch import scratch

    path = scratch(spark, "orders-parquet")
    write_parquet(table(spark, sf_dir, "orders"), path)
    return E.require_columns(spark.read.parquet(path), ["o_totalprice", "o_orderkey"]).orderBy("o_orderkey")


@query("""SELECT coalesce(CASE WHEN event_type IN ('error', 'click') THEN NULL WHEN event_type = 'view' THEN '__NA__' ELSE event_type END, '__NA__') AS label, count(*) AS n FROM events GROUP BY 1""")
def label_recode_na(spark, sf_dir):
    raw = F.when(F.col("event_type") == "error", None).when(F.col("event_type") == "click", "nan").when(F.col("event_type") == "view", "NaN").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").groupBy(recode_missing(raw).alias("label")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT o_orderpriority || ' x ' || o_orderstatus AS eff, regexp_replace(o_orderpriority || ' x ' || o_orderstatus, '[^a-zA-Z0-9_]', '', 'g') AS slug FROM orders")
def effect_slug(spark, sf_dir):
    names = table(spark, sf_dir, "orders").select(F.concat_ws(" x ", "o_orderpriority", "o_orderstatus").alias("eff")).distinct()
    return names.select("eff", slug(F.col("eff")).alias("slug"))


@query(f"SELECT DISTINCT o_orderpriority AS level, {LEVELS_SQL}::INTEGER AS place FROM orders")
def level_order(spark, sf_dir):
    coded = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("level"), ordinal_code(F.col("o_orderpriority"), PRIORITIES).alias("code"))
    return order_levels(coded, "level", "code")


FOLDS_SQL = "CASE WHEN {n} // {per} >= 10 THEN 10 WHEN {n} // {per} >= 5 THEN 5 ELSE 3 END"


@query(f"""WITH g AS (SELECT 'line ' || l_linenumber AS name, count(*)::INTEGER AS n_rows FROM lineitem GROUP BY 1 UNION ALL SELECT 'nation ' || c_nationkey, count(*)::INTEGER FROM customer GROUP BY 1),
o AS (SELECT *, {FOLDS_SQL.format(n='n_rows', per=30)} AS cv_folds FROM g)
SELECT name, n_rows, 'regression' AS task_type, 'RMSE' AS loss_function, cv_folds, {FOLDS_SQL.format(n='(n_rows - n_rows // cv_folds)', per=20)} AS inner_cv_folds,
greatest(3, least(10, floor(log2(greatest(n_rows / 5, 4)))::INTEGER)) AS depth_high, greatest(2, least(200, n_rows // 50)) AS min_leaf_high, CASE WHEN n_rows < 100 THEN 2000 WHEN n_rows < 500 THEN 5000 ELSE 10000 END AS n_boot FROM o""")
def config_defaults(spark, sf_dir):
    """Defaults for tables of the sizes that groups of the data have."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("name")).agg(F.count("*").alias("n"))
    nations = table(spark, sf_dir, "customer").groupBy(F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")).alias("name")).agg(F.count("*").alias("n"))
    rows = []
    for r in lines.unionByName(nations).collect():  # a row per line number and nation
        c, _ = C.resolve({"modeling": {"outcome": "y"}}, r.n)
        m, space = c["modeling"], c["modeling"]["tuning"]["search_space"]
        rows.append((r.name, r.n, m["task_type"], m["loss_function"], m["cv_folds"], m["tuning"]["inner_cv_folds"], space["depth"]["high"], space["min_data_in_leaf"]["high"], c["shap"]["bootstrapping"]["n_boot"]))
    return spark.createDataFrame(rows, "name string, n_rows int, task_type string, loss_function string, cv_folds int, inner_cv_folds int, depth_high int, min_leaf_high int, n_boot int")
