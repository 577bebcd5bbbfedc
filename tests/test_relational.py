"""Numbering, first matches, exports and the readers of odd files."""

import pytest
from pyspark.sql import functions as F

from fieldmark import scratch
from fieldmark.functions import classify, columns, states
from fieldmark.operators import filters, relational
from fieldmark.sources import files


def test_numbered_keeps_all_rows_with_payload(spark):
    rows = spark.range(0, 1_000_000, 1, 8).select((F.col("id") * 7919 % 1_000_003).alias("k"), F.concat(F.lit("payload "), "id").alias("payload"))
    got = relational.numbered(rows, ["k"], 5)
    assert got.columns == ["k", "payload", "id"]
    s = got.agg(F.count("*"), F.countDistinct("id"), F.min("id"), F.max("id"), F.countDistinct("payload")).first()
    assert tuple(s) == (1_000_000, 1_000_000, 5, 1_000_004, 1_000_000)
    pairs = [r.k for r in got.where("id < 200").orderBy("id").collect()]
    assert pairs == sorted(pairs)


def test_numbered_ties_and_no_rows(spark):
    rows = spark.range(100).select((F.col("id") % 3).alias("k"), "id").withColumnRenamed("id", "own")
    assert sorted(r.id for r in relational.numbered(rows, ["k"]).collect()) == list(range(100))
    assert relational.numbered(rows.where("k > 5"), ["k"]).count() == 0


def test_empty_name_takes_the_first_title(spark):
    names = spark.createDataFrame([(1, ""), (2, "farm"), (3, "none")], "name_id int, name string")
    titles = spark.createDataFrame([("B Farm", 2), ("A", 1)], "title string, _ord int")
    assert {r.name_id: r.title for r in relational.first_containing(names, titles).collect()} == {1: "A", 2: "B Farm", 3: None}


@pytest.mark.parametrize("few", [10_000, 0])
def test_parts_of_titles_are_not_broadcast(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(relational, "FEW_NAMES", few)
    names = spark.createDataFrame([(1, "farm 7"), (2, "farm"), (3, "none"), (4, "m")], "name_id int, name string")
    spark.range(200).select(F.concat(F.lit("Farm "), "id").alias("title"), F.col("id").alias("_ord")).write.parquet(str(tmp_path / "titles"))
    titles = spark.read.parquet(str(tmp_path / "titles"))
    plan = relational.containment_candidates(names, titles)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") == bool(few) and "Generate" not in plan.partition("BroadcastExchange")[2]
    assert {r.name_id: r.title for r in relational.first_containing(names, titles).collect()} == {1: "Farm 7", 2: "Farm 0", 3: None, 4: "Farm 0"}


def test_chunks_of_rows_are_files(spark, tmp_path):
    relational.write_chunks(spark.range(25).select("id", F.col("id").alias("v")).withColumnRenamed("id", "k"), ["k"], str(tmp_path / "c"), 10)
    got = spark.read.option("header", True).csv(str(tmp_path / "c")).groupBy("chunk").count().collect()
    assert {r.chunk: r["count"] for r in got} == {1: 10, 2: 10, 3: 5}


def test_export_has_the_union_of_headers(spark, tmp_path):
    a = spark.createDataFrame([("x, y", 'say "a"')], "name string, note string").coalesce(1)
    files.write_export([a, spark.createDataFrame([(7,)], "size int").coalesce(1)], str(tmp_path / "e"))
    lines = {line for f in (tmp_path / "e").glob("*.csv") for line in f.read_text().splitlines()}  # a header in each file
    assert lines == {'"x, y","say ""a""",', ",,7", "name,note,size"}


def test_encoding_and_positions(spark, tmp_path):
    (tmp_path / "u.csv").write_bytes("1;Zürich\n".encode())
    (tmp_path / "l.csv").write_bytes("1;Zürich;more\n2\n".encode("latin-1"))
    u, l = str(tmp_path / "u.csv"), str(tmp_path / "l.csv")
    assert [files.text_encoding(spark, p) for p in (u, l)] == ["UTF-8", "ISO-8859-1"]
    got = files.read_positional(spark, l, ["id", "city"], ";", files.text_encoding(spark, l)).collect()
    assert [tuple(r) for r in got] == [("1", "Zürich"), ("2", None)]


def test_orphan_placemarks(spark, tmp_path):
    mark = "<Placemark><name>{0}</name><description>d</description><Point><coordinates>1.5,2.5,0</coordinates></Point></Placemark>"
    (tmp_path / "k.kml").write_text(f"<kml><Document>{mark.format('alone')}<Folder><name>f</name>{mark.format('held')}</Folder></Document></kml>")
    assert [tuple(r) for r in files.read_orphan_placemarks(spark, str(tmp_path / "k.kml")).collect()] == [("alone", "d", 2.5, 1.5)]


def test_unknown_danish_industry_fails(spark):
    with pytest.raises(Exception, match="unknown industry"):
        spark.createDataFrame([("Slagter på hjul",)], "i string").select(classify.danish_activities(F.col("i"))).collect()


def test_italian_address_is_stripped(spark):
    got = spark.createDataFrame([(" VIA ROMA, X (LT) ",), (None,)], "a string").select(*columns.italian_address(F.col("a"), {"LT": "Latina"})).collect()
    assert [tuple(r) for r in got] == [("VIA ROMA", "X", "Latina"), ("", "", "")]


def test_states_of_mexico_in_any_case(spark):
    got = spark.createDataFrame([("Sonora",), ("XX",)], "s string").select(filters.country_match("MX", F.col("s"), F.lit("us"), states.REGIONS, states.TAGGED).alias("m")).collect()
    assert [r.m for r in got] == [True, False]
    assert (len(states.US), len(states.GERMANY), len(states.FRANCE), len(states.CANADA), len(states.MEXICO)) == (56, 17, 100, 13, 32)


def test_scratch_is_refused_on_a_cluster_without_a_shared_folder(spark, monkeypatch):
    monkeypatch.setattr(scratch, "_own", {})
    monkeypatch.setattr(spark.sparkContext, "master", "local-cluster[2,1,1024]")
    if not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(ValueError):
            scratch.scratch_dir(spark, "x")
