from pyspark.sql import functions as F

from effectlens.operators import boosting as B
from effectlens.streaming.scoring import score_stream


def test_stream_is_scored_like_a_table(spark, tmp_path):
    rows = spark.range(60).select(F.col("id").alias("key"), (F.col("id") % 5).cast("double").alias("a"), F.col("id").cast("double").alias("_y0"), (F.col("id") % 2).cast("int").alias("fold"))
    models = B.fit_folds(rows, "fold", ["a"], [], ["_y0"], B.Params(iterations=3)).select("fold", "model").cache()
    rows.select("key", "a").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key long, a double").parquet(str(tmp_path / "in"))
    q = score_stream(stream, models, "key", [], str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination(60)
    got = {r.key: r.pred for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    each = B.predict_folds(rows.select("key", "a"), models, "fold", "key", [], every=True)
    assert got == {r.key: r.p for r in each.groupBy("key").agg(F.avg(F.get("pred", 0)).alias("p")).collect()} and len(got) == 60
