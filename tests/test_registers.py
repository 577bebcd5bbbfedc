"""Expectations for the national registers' rules and the common location table."""

import pytest
from pyspark.sql import functions as F

from fieldmark.functions import registers
from fieldmark.operators import locations
from fieldmark.sources import files


def one(spark, *cols):
    row = spark.range(1).select(*cols).first()
    return row[0] if len(row) == 1 else tuple(row)


def set_flags(spark, flags):
    return {n for n, v in spark.range(1).select(*[c.alias(n) for n, c in flags.items()]).first().asDict().items() if v == "Yes"}


def test_federal_letters_count_anywhere(spark):
    assert set_flags(spark, registers.federal_animals(F.lit("6f"))) == {"chicken_processing"}
    assert set_flags(spark, registers.federal_animals(F.lit("1d US"))) == {"market_swine_slaughter", "goat_slaughter"}


def test_german_codes(spark):
    assert one(spark, registers.german_activity(F.lit("SH"))) == "Meat Processing; Meat Slaughter"
    assert one(spark, registers.german_activity(F.lit(" "))) == ""
    got = set_flags(spark, registers.german_animals(F.lit("CP"), F.lit("wA")))
    assert {"meat_processing", "poultry_processing", "slaughter_or_processing_only"} <= got and not any(n.endswith("_slaughter") for n in got)


def test_addresses_and_names(spark):
    assert one(spark, registers.mexican_address(F.lit("CALLE"), F.lit("Sol"), F.lit("4"), F.lit("B"), F.lit("2"), F.lit("C"))) == "CALLE Sol 4 B Int. 2 C"
    assert one(spark, registers.mexican_address(*[F.lit("")] * 6, none="Unknown")) == "Unknown"
    assert one(spark, registers.nz_activity(F.lit(""), F.lit(None).cast("string"))) == ""
    assert one(spark, registers.company_name(F.lit("Tyson Foods, Inc."))) == "Tyson Foods"
    assert one(spark, *registers.lab_row(F.lit("x"), F.lit("1 Way"), F.lit(""), F.lit("Davis, CA 95616")))[2:5] == ("CA", "Davis", "95616")
    assert one(spark, *registers.lab_row(F.lit("x"), F.lit(None).cast("string"), F.lit(""), F.lit(None).cast("string")))[2:5] == ("", "", "")
    assert one(spark, registers.italian_province(F.lit("BASSIANO (LT) "))) == "LT"
    assert one(spark, registers.display_state(F.lit("BY"), [{"CA": "California"}, {"BY": "Bavaria"}])) == "Bavaria"
    assert one(spark, registers.country_by_box(F.lit(55.0), F.lit(9.0), F.lit(""), F.lit(""))) == "dk"
    assert one(spark, registers.country_by_box(F.lit(47.0), F.lit(9.0), F.lit(""), F.lit(""))) is None


def test_ontario(spark):
    held = lambda name: F.lit("1" if name.startswith(("Deer", "Goats")) else "")
    assert set_flags(spark, registers.ontario_animals(held)) == {f"{n}_slaughter" for n in ("deer_reindeer", "elk", "goat", "lamb", "sheep")}


def test_translated_list(spark):
    words = {"cattle": "Vieh", "cow": "Kuh", "rabbit": "Hase"}
    assert one(spark, registers.translated_list(F.lit("Cattle (Cows, Bulls), 12 Rabbits"), words)) == "Vieh (Kuh, Bulls), 12 Hase"
    assert one(spark, registers.translated_list(F.lit(""), words)) == ""


def test_html_tables(spark):
    html = "<table><tr><td>x</td></tr><tr><th>Approval <b>Number</b></th><th>Name</th></tr><tr><td>1</td><td> A\n B </td></tr></table>"
    rows = registers.html_rows(F.lit(html))
    assert one(spark, registers.html_rows(F.lit(html), 2)) == [["Approval Number", "Name"], ["1", "A B"]]
    assert one(spark, *registers.table_under(rows, "APPROVAL NUMBER")) == (["Approval Number", "Name"], [["1", "A B"]])
    assert one(spark, *registers.table_under(rows, "nothing")) == (None, None)


def test_xml_rows(spark, tmp_path):
    (tmp_path / "r.xml").write_text("<document><row><navn1>a</navn1><Geo_Lat>55.5</Geo_Lat></row><row><navn1>b</navn1></row></document>")
    rows = files.read_xml_rows(spark, str(tmp_path / "r.xml"), "navn1 string, Geo_Lat double")
    assert sorted(map(tuple, rows.collect())) == [("a", 55.5), ("b", None)]


def test_countries(spark, tmp_path):
    head = ",".join(locations.REQUIRED)
    blank = {c: "" for c in locations.REQUIRED} | {"latitude": "1.5", "longitude": "2"}
    for cc, extra, value in (("dk", "", ""), ("us", ",steer_slaughter", ",Yes")):
        (tmp_path / cc).mkdir()
        row = blank | {"establishment_id": cc}
        (tmp_path / cc / "locations.csv").write_text(f"{head}{extra}\n{','.join(row[c] for c in locations.REQUIRED)}{value}\n")
    with pytest.warns(UserWarning, match="no register of fr"):
        found = locations.read_countries(spark, str(tmp_path), ["dk", "fr", "us"])
    assert len(locations.COLUMNS) == len(set(locations.COLUMNS))
    shown = {r["country"]: r for r in locations.shown_locations(found).collect()}
    assert shown["us"]["animals_slaughtered"] == "Cattle (Cows, Bulls)" and shown["dk"]["animals_slaughtered"] == "" and shown["dk"]["animals_processed"] == "N/A"
    assert shown["us"]["latitude"] == 1.5 and len(locations.shown_locations(found).columns) == 18
    with pytest.raises(ValueError, match="no register"), pytest.warns(UserWarning):
        locations.read_countries(spark, str(tmp_path), ["xx"])
