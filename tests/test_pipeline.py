from pyspark.sql import functions as F

from commitloom.plans import pipeline
from commitloom.runtime import table


def test_from_tables_to_a_data_set(spark, data):
    c = table(spark, data, "commits")
    combined = pipeline.combined_commits(c, table(spark, data, "bugs"), table(spark, data, "changes"), table(spark, data, "change_details"))
    rows = pipeline.annotate(combined.withColumnRenamed("committed_date", "date"))
    assert rows.count() == combined.count() == combined.select("cid").distinct().count()
    done = pipeline.ordered(rows).cache()
    n = done.count()
    assert [tuple(r) for r in done.agg(F.min("order"), F.max("order"), F.count_distinct("order")).collect()] == [(1, n, n)]
    scores = done.select("cid", (F.col("order") % 7).cast("double").alias("guilt"))
    scaled, labels, fitted = pipeline.data_set(done, scores, 5)
    assert labels.filter("label = 1").count() >= 5 and labels.count() == n
    assert scaled.filter("value < -1e-9 or value > 1 + 1e-9").count() == 0
    assert fitted.select("index").distinct().count() == fitted.count()


def test_order_within_a_hot_key(spark):
    from commitloom.operators.ordering import order_within

    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("t"), F.lit(0).alias("_part"))
    got = {(r.k, r.t): r.o for r in order_within(df, ["k"], ["t"], "o", 7).collect()}
    assert len(got) == 3000 and all(o == (t // 3 + 1 if k in (None, "hot") else 1) for (k, t), o in got.items())
