"""Bulk loading on small files."""

import pytest
from pyspark.sql import functions as F

from holdgraph.sources import loaders as B


def test_required_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("LEI,Name\nx,A\n")
    assert B.lower_named(B.read_csv(spark, str(tmp_path / "a.csv"), ["LEI"])).first().lei == "x"
    with pytest.raises(ValueError, match="Country"):
        B.read_csv(spark, str(tmp_path / "a.csv"), ["LEI", "Country"])


def test_first_header_with_a_value(spark):
    df = spark.createDataFrame([(" ", "b"), ("a", "c")], "name string, title string")
    assert [r.x for r in B.first_of(df, ["missing", "name", "title"], "x").collect()] == ["b", "a"]
    assert B.first_of(df, ["missing"], "x").first().x is None


def test_xml_rows(spark):
    xml = "<n><org><id>1</id><name>A</name></org><org><id>2</id><name>B</name></org></n>"
    df = spark.createDataFrame([("k", xml)], "key string, x string")
    got = B.xml_rows(df, "x", "org", "org array<struct<id:int,name:string>>").collect()
    assert [(r.key, r.id, r.name) for r in got] == [("k", 1, "A"), ("k", 2, "B")]


def test_assembled_keeps_rows_without_parts(spark):
    base = spark.createDataFrame([(1,), (2,)], "code int")
    part = spark.createDataFrame([(1, "b"), (1, "a")], "code int, name string")
    got = {r.code: r.people for r in B.assembled(base, "code", people=part).collect()}
    assert [p.name for p in got[1]] == ["a", "b"] and got[2] is None


def test_lookup_takes_the_last_value_that_is_there(spark):
    rows = spark.createDataFrame([("1", "x", 1), ("1", "y", 2), ("1", None, 3)], "k string, v string, seq int")
    assert [tuple(r) for r in B.lookup(rows, F.lpad("k", 3, "0"), "v", "seq").collect()] == [("001", "y")]
