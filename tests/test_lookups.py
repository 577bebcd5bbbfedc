"""First containing titles, dense places, dictionaries, enrichment, pages and the table by country."""

import random

import pytest
from pyspark.sql import functions as F

from fieldmark.functions import columns, registers
from fieldmark.operators import dictionaries, enrichment, filters, locations, relational
from fieldmark.sources import pages


def one(spark, *cols):
    row = spark.range(1).select(*cols).first()
    return row[0] if len(row) == 1 else tuple(row)


def test_first_title_by_brute_force(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choices("abA ", k=rng.randrange(n)))
    names, titles = [(i, word(6)) for i in range(80)] + [(80, None)], [(word(30), i) for i in range(60)] + [(None, 60)]
    want = {i: next((t for t, _ in titles if t is not None and n.lower() in t.lower()), None) if n is not None else None for i, n in names}
    got = relational.first_containing(spark.createDataFrame(names, "name_id int, name string"), spark.createDataFrame(titles, "title string, _ord int"))
    assert {r.name_id: r.title for r in got.collect()} == want


def test_names_meet_titles_by_their_rarest_part(spark):
    names = spark.range(100).select(F.col("id").alias("name_id"), F.concat(F.lit("united farms of k"), F.lpad(F.col("id").cast("string"), 3, "0"), F.lit("z")).alias("name"))
    titles = spark.range(2000).select(F.concat(F.lit("United Farms of K"), F.lpad((F.col("id") % 500).cast("string"), 3, "0"), F.lit("Z inc")).alias("title"), F.col("id").alias("_ord"))
    assert relational.containment_candidates(names, titles).count() <= 100 * 80  # all pairs: 200,000; names of one end share it with a tenth of the titles at most
    got = relational.first_containing(names, titles).collect()
    assert all(r.title == f"United Farms of K{r.name_id:03d}Z inc" for r in got) and len(got) == 100


def test_dense_cells_are_dealt(spark):
    points = spark.range(100_000).select(F.col("id").alias("point_id"), F.lit(1.0001).alias("lat"), F.lit(2.0001).alias("lng"), (F.col("id") % 2).alias("layer"), (-F.col("id")).alias("_ord"))
    targets = spark.createDataFrame([(1, 1.0002, 2.0002), (2, 1.00005, 2.0), (3, 5.0, 5.0)], "target_id int, t_lat double, t_lng double")
    pairs = relational.near_pairs(points, targets, 0.001, 5_000)
    sizes = pairs.groupBy("_x", "_y", "_part").agg(F.countDistinct("point_id").alias("n")).collect()
    assert len(sizes) == 20 and max(r.n for r in sizes) < 6_000 and sum(r.n for r in sizes) == 100_000
    assert sorted(map(tuple, relational.near(points, targets, dense=5_000).collect())) == [(1, 99_998), (2, 99_998)]


def split_by_hand(text):
    items, item, depth = [], "", 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            items, item = [*items, item.strip()], ""
        else:
            item += c
    return [*items, item.strip()] if item else items


def test_lists_split_at_any_depth(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choices("ab ,,()é😀", k=rng.randrange(25))) for _ in range(300)] + ["", ",", "a,", "((a,b),c),d", "a), b", "(a, b"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", columns.outer_commas(F.col("t")).alias("s")).collect()
    assert all(r.s == split_by_hand(r.t) for r in got)


def test_lists_are_translated_at_every_level(spark):
    words = {"cow": "Kuh", "calf": "Kalb", "dog": "Hund"}
    assert one(spark, registers.translated_list(F.lit("Cows (Calf (3 Dogs, Cow), 2 cows), X (dog"), words)) == "Kuh (Kalb (3 Hund, Kuh), 2 Kuh), X (dog"
    assert one(spark, registers.translated_list(F.lit("A (B (cow))"), words, 1)) == "A (B (cow))"


def test_nested_documents_become_dotted_keys(spark):
    docs = [("en", '{"nav": {"home": "Home", "sub": {"deep": {"er": "x"}, "n": 3, "none": null}}, "list": ["a", {"b": "c"}], "flag": true, "a.b": "dotted"}'), ("de", '{"nav": {"home": "Start"}}'), ("xx", "no json"), ("yy", "7"), ("zz", None)]
    keys = dictionaries.dotted_keys(spark.createDataFrame(docs, "locale string, json string"))
    leaves = {(r.locale, r.key): r.value for r in keys.where("leaf").collect()}
    assert leaves == {("en", "nav.home"): "Home", ("en", "nav.sub.deep.er"): "x", ("en", "nav.sub.n"): "3", ("en", "nav.sub.none"): None, ("en", "list.0"): "a", ("en", "list.1.b"): "c", ("en", "flag"): "true", ("en", "a.b"): "dotted", ("de", "nav.home"): "Start"}
    assert {(r.locale, r.key): r.value for r in keys.where("not leaf").collect()}[("en", "nav.sub.deep")] == '{"er":"x"}'
    asked = spark.createDataFrame([("nav.home",), ("nav.sub.n",), ("nav.nowhere",), ("nav.sub.deep",)], "k string")
    got = {r.k: (r.text, r.known) for r in dictionaries.translated(asked, "k", keys, "de", "en").collect()}
    assert got == {"nav.home": ("Start", True), "nav.sub.n": ("3", True), "nav.nowhere": ("nav.nowhere", False), "nav.sub.deep": ('{"er":"x"}', True)}
    assert {r.k: r.known for r in dictionaries.translated(asked, "k", keys, "de").collect()}["nav.sub.n"] is False


def test_addresses_are_asked_once(spark, tmp_path):
    cache, asked = str(tmp_path / "cache"), []

    def ask(addresses):
        asked.append(sorted(r.address for r in addresses.collect()))
        near = F.when(F.col("address") == "Rome", 41.9).when(F.col("address") == "Far", 10.0)
        return addresses.select("address", near.alias("latitude"), F.lit(12.5).alias("longitude")).where("address <> 'Nowhere'")

    rows = spark.createDataFrame([(1, "Rome", 0.0, 0.0), (2, " Rome ", 0.0, 0.0), (3, "Far", 1.0, 1.0), (4, "Nowhere", None, None), (5, "Milan", 45.5, 9.2), (6, " ", 0.0, 0.0), (7, None, 3.0, 3.0)], "id int, place string, latitude double, longitude double")
    inside = lambda lat, lng: filters.in_box(lat, lng, 40, 48, 6, 20)
    want = [(1, 41.9, 12.5, "geocoded"), (2, 41.9, 12.5, "geocoded"), (3, 1.0, 1.0, "failed"), (4, None, None, "failed"), (5, 45.5, 9.2, "skipped"), (6, 0.0, 0.0, "skipped"), (7, 3.0, 3.0, "skipped")]
    for _ in range(2):
        got = enrichment.with_coordinates(rows, F.col("place"), ask, inside, cache)
        assert [(r.id, r.latitude, r.longitude, r.outcome) for r in got.orderBy("id").collect()] == want
    assert asked == [["Far", "Nowhere", "Rome"]]  # the second run asks for nothing
    more = rows.union(spark.createDataFrame([(8, "Turin", 0.0, 0.0)], rows.schema))
    enrichment.with_coordinates(more, F.col("place"), ask, inside, cache).count()
    assert asked[1:] == [["Turin"]]


PAGE = """<html><table class=menu><tr><td>Home</td></tr></table>
<TABLE border=1><tr><td colspan=3>Section I</td></tr><tr><th> Approval number </th><th>NAME</th><th>TOWN/REGION</th></tr>
<tr><td>40 L</td><td>A &amp;amp; B <b>srl</b></td><td>ROMA</td></tr><tr><td>41</td><td>C</td></tr></TABLE>
<table><tr><td>APPROVAL NUMBER</td></tr><tr><td>second</td></tr></table></html>"""


def test_page_files_become_rows(spark, tmp_path):
    (tmp_path / "a.html").write_text(PAGE)
    (tmp_path / "b.html").write_text("<table><tr><td>nothing</td></tr></table>")
    got = pages.read_marked_rows(spark, str(tmp_path / "*.html"), "APPROVAL NUMBER", ["Approval number", "TOWN/REGION", "VAT", "NAME"])
    assert [tuple(r)[1:] for r in got.orderBy("_ord").collect()] == [(0, "40 L", "ROMA", None, "A &amp; B srl"), (1, "41", None, None, "C")]
    wide = "<table><tr><td>h</td></tr><tr><td>u</td></tr><tr><td>1</td><td>2</td></tr><tr><td>x</td></tr><tr><th>3</th><td>4</td></tr></table><table><tr></tr><tr></tr><tr><td>5</td><td>6</td></tr></table>"
    rows = pages.wide_rows(spark.createDataFrame([(1, wide), (2, None)], "id int, html string"), "id", ["a", "b"])
    assert sorted(map(tuple, rows.collect())) == [(1, 0, "1", "2"), (1, 1, "3", "4")]


def test_one_country_is_read_alone(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), "dk" if i % 3 else "us") for i in range(30)], "establishment_id string, country string")
    locations.write_countries(rows, str(tmp_path / "t"))
    us = locations.read_country(spark, str(tmp_path / "t"), "us")
    assert us.count() == 10 and locations.read_country(spark, str(tmp_path / "t")).count() == 30
    plan = us._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(country" in plan and "PushedFilters: []" in plan
    locations.write_countries(locations.read_country(spark, str(tmp_path / "t")).where("country = 'us'"), str(tmp_path / "t"))
    assert locations.read_country(spark, str(tmp_path / "t")).count() == 10


@pytest.mark.parametrize(("label", "want"), [("Class A - Breeder", "A"), ("Class C", "C"), ("old Class B and Class R", "B"), ("Class T", "T"), ("Class H", "H"), ("Klasse A", None), (None, None)])
def test_registration_labels(spark, label, want):
    assert one(spark, registers.registration_label(F.lit(label).cast("string"))) == want
