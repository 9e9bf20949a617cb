from pyspark.sql import functions as F
from tidewatch import cli
from tidewatch.operators import contracts
from tidewatch.plans import pipeline
from tidewatch.sources import mock
from tidewatch.sources.reviews import read_table


def test_crisis_is_found_and_stages_are_idempotent(spark, tmp_path):
    src, root = str(tmp_path / "raw"), str(tmp_path / "tables")
    mock.raw_reviews(spark).write.json(src)
    args = ["--root", root, "--category", "Toys", "--source", src, "--stage"]
    cli.main([*args, "all"])
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    for name, (_, day) in pipeline.KEYS.items():
        df = read_table(spark, f"{root}/{name}", day)
        assert df.count() > 0
        contracts.validate(name, df)
    m = read_table(spark, f"{root}/indicator_matrix", "window_end").withColumn("late", F.col("window_end") > F.date_sub(F.lit("2023-05-01"), 14))
    rate = {(r["sku"], r["late"], r["indicator_id"]): r["rate"] for r in m.groupBy("sku", "late", "indicator_id").agg(F.avg(F.col("triggered").cast("int")).alias("rate")).collect()}
    for i in ("I1", "I2", "I4", "I5", "I6", "I8"):
        assert rate["SKU0", True, i] > 0.15, i
    normal = [v for (sku, late, i), v in rate.items() if sku != "SKU0" and i in ("I1", "I2", "I4", "I5")]
    assert sum(normal) / len(normal) <= 0.05
    a = read_table(spark, f"{root}/alerts", "window_end")
    assert {r["sku"] for r in a.where("level = 'HIGH'").collect()} == {"SKU0"}
    before = sorted(map(str, a.collect()))
    cli.main([*args, "score"])
    spark.catalog.refreshByPath(f"{root}/alerts")
    assert sorted(map(str, read_table(spark, f"{root}/alerts", "window_end").collect())) == before
    labels = spark.createDataFrame([("SKU0", "Toys", "r")], "sku string, category string, recall_id string").withColumn("recall_date", F.lit("2023-05-01").cast("date"))
    report = {r["policy"]: r["detected"] for r in pipeline.run_evaluate(spark, pipeline.Settings(root, "Toys"), labels).collect()}
    assert report["medium_or_high"] == 1 and report["high_only"] == 1
    a = read_table(spark, f"{root}/alerts", "window_end")
    assert pipeline.missing(a, a.limit(1), "sku").count() < len(before)
