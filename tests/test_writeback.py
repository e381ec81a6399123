"""Blocks written back between untouched columns, names of transformed datasets, overlays and diagnostics of many responses."""

import pytest
from pyspark.sql import functions as F

from statloom.operators import surface, writeback


def test_names():
    assert writeback.transformed_name("wine_ORIGINAL.csv", "snv") == "wine.snv"
    assert writeback.transformed_name("wine.snv", "der1") == "wine.der1"


def test_written_back(spark):
    df = spark.createDataFrame([(i, "m", 1.0 * i, 2.0 * i, 3.0 * i, "z") for i in range(6)], "id int, meta string, a double, b double, c double, tail string")
    made = df.where("id > 1").select("id", (F.col("a") + 10).alias("x"), (F.col("b") + 10).alias("y"))
    out = writeback.written_back(df, made, "id", ["a", "b", "c"], ["x", "y"])
    assert out.columns == ["id", "meta", "a", "b", "tail"]
    assert sorted(map(tuple, out.collect())) == [(i, "m", i + 10.0, 2 * i + 10.0, "z") for i in range(2, 6)]
    arrays = df.withColumn("s", F.array("a", "b"))
    assert writeback.array_written_back(arrays, "s", ["a", "b", "c"], 2).columns == ["id", "meta", "a", "b", "tail"]
    with pytest.raises(ValueError):
        writeback.written_back(df, made, "id", ["a", "c"], ["x", "y"])
    with pytest.raises(ValueError):
        writeback.array_written_back(arrays, "s", ["a", "b"], 3)
    after = writeback.before_and_after(arrays, "id", ["a", "b", "c"], "s").where("id = 2").orderBy("position").collect()
    assert [(r.variable, r.before, r.after) for r in after] == [("a", 2.0, 2.0), ("b", 4.0, 4.0), ("c", 6.0, None)]


def test_overlay_counts_what_each_point_meets(spark):
    cells = [(i, j, float(i), float(j), n, float(i + (j if n == "p" else -j)), 0.5) for i in range(4) for j in range(4) for n in ("p", "q")]
    rows = spark.createDataFrame(cells, "ix int, iy int, x double, y double, response string, z double, ci double")
    out = {(r.ix, r.iy): (r.met, r.of, r.failing) for r in surface.overlay(rows, {"p": ("Threshold_Above", 2.5, 0.0), "q": ("Threshold_Below", 0.0, 0.6)}).collect()}
    for (i, j), (met, of, failing) in out.items():
        p, q = i + j - 0.5 >= 2.5, i - j + 0.5 <= 0.6
        assert (met, of, failing) == (p + q, 2, "p" if not p else "q" if not q else None)
