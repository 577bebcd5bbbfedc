"""Expectations for lists, rules, parsers, scans and the stream."""

import pytest
from pyspark.sql import functions as F

from fieldmark.functions import animals, classify, columns
from fieldmark.operators import filters
from fieldmark.sources import files
from fieldmark.streaming import drops


def one(spark, *cols):
    row = spark.range(1).select(*cols).first()
    return row[0] if len(row) == 1 else tuple(row)


@pytest.mark.parametrize(
    ("yes", "expected"),
    [([], ""), (["beef_cow", "steer", "heifer"], "Cattle (Cows, Bulls)"), (["beef_cow", "market_swine", "young_chicken"], "Cattle (Cows, Bulls), Pigs, Chickens")],
)
def test_slaughtered(spark, yes, expected):
    assert one(spark, animals.slaughtered(F.lit(""), lambda n: F.lit("Yes" if n in yes else "No"))) == expected


def test_processed(spark):
    assert one(spark, animals.processed(F.lit(""), lambda n: F.lit(""))) == "N/A"
    assert one(spark, animals.processed(F.lit(""), lambda n: F.lit("Yes" if n == "ratite" else ""))) == "Ratite (Ostrich/Emu)"
    assert one(spark, animals.processed(F.lit("Given"), lambda n: F.lit("Yes"))) == "Given"


@pytest.mark.parametrize(("count", "expected"), [("0", "Unknown"), ("5", "5 Dogs"), ("invalid", "Unknown"), ("5.9", "5 Dogs"), ("0.5", "0 Dogs"), ("5f", "Unknown"), (" 5 ", "Unknown"), ("3e9", "2147483647 Dogs")])
def test_tested(spark, count, expected):
    assert one(spark, animals.tested([(F.lit(count), "Dogs")])) == expected


@pytest.mark.parametrize(
    ("text", "key", "suffix", "category"),
    [
        ("Mixed Farm (Dairy Farm, Intensive Pig Farm)", "dairyFarm", "", "breeder"), ("Mixed Farm (Goats)", "mixedFarm", " (goats)", "breeder"),
        ("Meat Processing; Meat Slaughter", "slaughterhouse", "", "slaughter"), ("Aquatic Processing", "aquaticProcessingFacility", "", "slaughter"),
        ("Aquaculture Farm", "aquacultureFacility", "", "breeder"), ("Farm / Breeder", "farm", "", "breeder"), ("Fishing Operation", "processing", "", "processing"), ("", "processing", "", "processing"),
    ],
)
def test_facility_type(spark, text, key, suffix, category):
    assert one(spark, *classify.facility_type(F.lit(text))) == (f"facilityTypes.{key}", suffix, category, category)


@pytest.mark.parametrize(("codes", "kind"), [("3x 6fx 9B/US 11ADFGKV", "Slaughter"), ("9A", "Type 9"), ("5", "Type 5"), ("", "Unknown"), ("6f", "Processing")])
def test_function_codes(spark, codes, kind):
    assert one(spark, classify.function_type(F.lit(codes))) == kind


def test_addresses(spark):
    assert one(spark, *columns.uk_address(F.lit("1 Mill Lane, Leeds, LS1 4AB, United Kingdom"))) == ("1 Mill Lane", "Leeds", "LS1 4AB")
    assert one(spark, *columns.spanish_address(F.lit("Calle Sol 4, Lugo, 27001, España"))) == ("Calle Sol 4", "Lugo", "27001")
    assert one(spark, *columns.spanish_address(F.lit("Finca 12345, Lugo, 27001, España"), street_first=True)) == ("Finca 12345", "Lugo", "27001")
    assert one(spark, *columns.spanish_address(F.lit("Finca 12345, Lugo"))) == ("Finca 12345", "", "12345")  # as the register's converter reads it
    assert one(spark, *columns.german_address(F.lit("Hauptstr. 1 10115 Berlin"))) == ("Hauptstr. 1", "10115", "Berlin")
    assert one(spark, *columns.city_state_zip(F.lit("DAVIS, CA 95616-1234"))) == ("DAVIS", "CA", "95616-1234")
    assert one(spark, *columns.city_state_zip(F.lit("DAVIS CA"))) == (None, None, None)
    assert one(spark, columns.clean_phone(F.lit("+52 (55) 12.34"))) == "+52(55)1234"


def test_coordinates(spark):
    wrap = lambda a, b: one(spark, *columns.wrapped(F.lit(float(a)), F.lit(float(b))))
    assert wrap(90, 190) == (85.0, -170.0) and wrap(0, 180) == (0.0, 180.0)
    good = lambda a, b: one(spark, *columns.valid_coordinates(F.lit(float(a)), F.lit(float(b))))
    assert good(0, 10) == good(91, 10) == (None, None) and good(45, 9) == (45.0, 9.0)
    assert one(spark, columns.outer_commas(F.lit("Cattle (Cows, Bulls), Pigs"))) == ["Cattle (Cows, Bulls)", "Pigs"]


def test_country_match(spark):
    match = lambda c, state, tag: one(spark, filters.country_match(c, F.lit(state), F.lit(tag), {"US": ["CA"], "MX": ["SONORA"]}, {"NZ", "MX"}))
    assert match("UK", "Otago", "nz") and match("NZ", "Otago", "nz") and not match("US", "Otago", "nz") and not match("UK", "CA", "us")


def test_register_policies(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text('id,name,latitude\n1,"a, ""b""",1.5\n2,,bad\n')
    assert [tuple(r) for r in files.read_register(spark, str(path), ["id"], ["latitude"], "drop").select("id").collect()] == [("1",)]
    with pytest.raises(Exception, match="bad latitude"):
        files.read_register(spark, str(path), ["id"], ["latitude"], "fail").collect()
    with pytest.raises(ValueError):
        files.read_register(spark, str(path), ["nope"], [])


def test_placemarks(spark, tmp_path):
    mark = "<Placemark><name>x</name><description>d</description><Point><coordinates>2.5,48.5,0</coordinates></Point></Placemark>"
    (tmp_path / "k.kml").write_text(f"<kml><Folder><name>f</name>{mark}{mark}</Folder></kml>")
    assert [tuple(r) for r in files.read_placemarks(spark, str(tmp_path / "k.kml")).collect()] == [("f", "x", "d", 48.5, 2.5)] * 2


def test_stream_of_drops(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("id,country\n1,dk\n2,nz\n")
    for _ in range(2):  # a file is taken once
        drops.ingest_drops(spark, str(tmp_path / "in"), "id int, country string", str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).where("country = 'dk'").count() == 1
