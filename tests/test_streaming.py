"""A stream of rows against a fitted monitor."""

from statloom.operators import monitor
from statloom.streaming.monitoring import fault_counts, scored


def test_stream_equals_batch(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax", "cast(l_shipdate as timestamp) as ts")
    model = monitor.fit(rows, ["l_quantity", "l_extendedprice", "l_tax"], 2)
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = scored(stream, model, ["l_orderkey", "l_linenumber"]).writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("scored").exceptAll(scored(rows, model, ["l_orderkey", "l_linenumber"])).count() == 0
    assert spark.table("scored").count() == rows.count()
    q = fault_counts(stream, model, "ts", "30 days", "3650 days").writeStream.format("memory").outputMode("complete").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("windows").exceptAll(fault_counts(rows, model, "ts", "30 days")).count() == 0
