"""Reports as Markdown and JSON, read back."""

import json

from pyspark.sql import functions as F

from effortlens.sources import writers
from effortlens.sources.documents import read_reports
from effortlens.storage import new_path


def test_markdown_round_trip(spark):
    rows = spark.createDataFrame([("b|c", 2, None), ("a\nx", 1, 0.5), ("z", 3, 1.0)], "name string, n int, share double")
    path = new_path(spark, "report")
    writers.write_report(writers.markdown(rows, [F.col("n")], most=2), path)
    assert [r["value"] for r in spark.read.text(path).collect()] == ["| name | n | share |", "| --- | --- | --- |", "| a x | 1 | 0.5 |", "| b\\|c | 2 |  |"]
    writers.write_report(writers.markdown(rows.limit(0), [F.col("n")]), path)
    assert spark.read.text(path).count() == 2


def test_json_round_trip(spark):
    rows = spark.createDataFrame([("a", 1), ("b", None)], "name string, n int")
    path = new_path(spark, "report")
    writers.write_report(writers.json_lines(rows), path)
    found = [json.loads(r["value"]) for r in spark.read.text(path).collect()]
    assert sorted(found, key=lambda x: x["name"]) == [{"name": "a", "n": 1}, {"name": "b"}]
    whole = spark.read.schema("name string, n int").json(path).collect()
    assert sorted((r["name"], r["n"]) for r in whole) == [("a", 1), ("b", None)]
    one = new_path(spark, "one")
    writers.write_report(writers.json_lines(rows.limit(1)), one)
    assert [(r["name"], r["n"]) for r in read_reports(spark, one, "name string, n int").collect()] == [("a", 1)]
