"""Column helpers: blanks, codes, addresses, phones and coordinates, all built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Volume categories and their texts.
PROCESSING_VOLUMES = {
    "1.0": "Less than 10,000 pounds/month.", "2.0": "10k - 100k pounds/month.", "3.0": "100k - 1M pounds/month.",
    "4.0": "1M - 10M pounds/month.", "5.0": "Over 10M pounds/month.",
}
SLAUGHTER_VOLUMES = {
    "1.0": "Less than 1,000 animals/year.", "2.0": "1k - 10k animals/year.", "3.0": "10k - 100k animals/year.",
    "4.0": "100k - 10M animals/year.", "5.0": "Over 10M animals/year.",
}


#: Texts that are numbers.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def filled(c: Column) -> Column:
    """The trimmed text, or null where nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def first_filled(*cols: Column, default: str = "Unknown") -> Column:
    return F.coalesce(*[filled(c) for c in cols], F.lit(default))


def matched(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of a pattern, null where it does not match."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def lookup(c: Column, mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[c]


def volume_label(c: Column, mapping: dict[str, str]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), c), F.lit("N/A"))


def state_of(city_state_zip: Column) -> Column:
    return matched(city_state_zip, ", ([A-Z]{2})")


CITY_STATE_ZIP = r"^(.*),\s*([A-Z]{2})\s*(\d{5}(?:-\d{4})?)$"


def city_state_zip(c: Column) -> list[Column]:
    return [matched(c, CITY_STATE_ZIP, k).alias(n) for k, n in ((1, "city"), (2, "state"), (3, "zip"))]


def clean_phone(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\d\-+()]", "")


def german_address(c: Column) -> list[Column]:
    """Street, zip and city around the first run of five digits; all blank without one."""
    pattern = r"(?s)^(.*?)([0-9]{5})(.*)$"
    return [F.when(c.rlike(pattern), F.trim(F.regexp_extract(c, pattern, k))).otherwise("").alias(n) for k, n in ((1, "street"), (2, "zip"), (3, "city"))]


def italian_address(c: Column, provinces: dict[str, str]) -> list[Column]:
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")
    pattern = r"^(.+?),\s*(.+?)\s*\(([A-Z]{2})\)$"
    hit, code = c.rlike(pattern), F.regexp_extract(c, pattern, 3)
    return [
        F.when(hit, F.regexp_extract(c, pattern, 1)).otherwise(c).alias("street"),
        F.when(hit, F.regexp_extract(c, pattern, 2)).otherwise("").alias("city"),
        F.when(hit, F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in provinces.items() for x in kv]), code), code)).otherwise("").alias("state"),
    ]


UK_POSTCODE = r"\b[A-Z]{1,2}[0-9R][0-9A-Z]?\s*[0-9][A-Z]{2}\b"


def comma_address(c: Column, country: str, postcode: str, from_end: bool, whole_part: bool, first: int = 0) -> list[Column]:
    """Street, city and zip of an address of comma-separated parts.

    The part with a postcode is found from either end, among those from number
    ``first`` (from 0) on; the city stands before it, the street before the first
    part equal to the city.
    """
    parts = F.transform(F.split(F.regexp_replace(c, rf",\s*{country}\s*$", ""), ","), lambda x: F.trim(x))
    places = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: (i >= first) & F.get(parts, i).rlike(postcode))
    at = F.when(F.size(places) > 0, F.element_at(places, -1 if from_end else 1))
    part = F.get(parts, at)
    code = part if whole_part else F.regexp_extract(part, f"({postcode})", 1)
    city = F.when(at.isNull(), F.element_at(parts, -1)).when(at > 0, F.get(parts, at - 1)).otherwise("")
    place = F.array_position(parts, city)
    street = F.when((city != "") & (place > 0), F.array_join(F.slice(parts, F.lit(1), (place - 1).cast("int")), ", ")).when(
        F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), ", ")
    ).otherwise(F.get(parts, F.lit(0)))
    return [F.coalesce(x, F.lit("")).alias(n) for x, n in ((street, "street"), (city, "city"), (code, "zip"))]


def uk_address(c: Column) -> list[Column]:
    return comma_address(c, "United Kingdom", UK_POSTCODE, True, True)


def spanish_address(c: Column, street_first: bool = False) -> list[Column]:
    """Where addresses begin with the street, five digits in it are a house number; else any five digits are a postcode, as registers are read."""
    return comma_address(c, "España", r"\b\d{5}\b", False, False, int(street_first))


def split_dba(c: Column) -> list[Column]:
    """Name and trade names around 'Also Doing Business' where ' As' follows it."""
    hit, parts = c.rlike(r"Also Doing Business (As|as)"), F.split(c, "Also Doing Business", 2)
    return [F.when(hit, F.trim(parts[0])).otherwise(F.trim(c)).alias("name"), F.when(hit, F.trim(F.replace(F.get(parts, F.lit(1)), F.lit("Name:"), F.lit("")))).otherwise("").alias("dba")]


def outer_commas(c: Column) -> Column:
    """Splits at commas outside parentheses of any depth and trims the items; nothing behind the last comma is no item.

    A fold over the pieces between parentheses and commas keeps the depth.  A
    closing parenthesis too many lowers it below zero, where commas part nothing.
    """
    pieces = F.regexp_extract_all(c, F.lit(r"[(),]|[^(),]+"), 0)
    blank = F.struct(F.lit(0).alias("depth"), F.lit("").alias("item"), F.array().cast("array<string>").alias("items"))
    trimmed = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")

    def step(s: Column, piece: Column) -> Column:
        cut = (piece == ",") & (s["depth"] == 0)
        depth = s["depth"] + F.when(piece == "(", 1).when(piece == ")", -1).otherwise(0)
        item = F.when(cut, "").otherwise(F.concat(s["item"], piece))
        return F.struct(depth.alias("depth"), item.alias("item"), F.when(cut, F.array_append(s["items"], trimmed(s["item"]))).otherwise(s["items"]).alias("items"))

    return F.aggregate(pieces, blank, step, lambda s: F.when(s["item"] != "", F.array_append(s["items"], trimmed(s["item"]))).otherwise(s["items"]))


def valid_coordinates(lat: Column, lng: Column) -> list[Column]:
    good = lat.between(-90, 90) & lng.between(-180, 180) & (lat != 0) & (lng != 0)
    return [F.when(good, lat).alias("lat"), F.when(good, lng).alias("lng")]


def wrapped(lat: Column, lng: Column) -> list[Column]:
    """Latitude held within 85 degrees, longitude brought into the closed [-180, 180]."""
    turns = F.when(lng > 180, F.ceil((lng - 180) / 360)).when(lng < -180, -F.ceil((-180 - lng) / 360)).otherwise(F.lit(0))
    return [F.greatest(F.lit(-85.0), F.least(F.lit(85.0), lat)).alias("lat"), (lng - 360 * turns).alias("lng")]


def plain_text(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(html, r"<!\[CDATA\[|\]\]>", ""), r"<[^>]+>", " "), r"[ \t\n\r\f\x0b]+", " "))


def any_contains(c: Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(t) for t in terms])


def prefixed_id(prefix: str, number: Column) -> Column:
    """A register's running number under its prefix, as in CA_ON_12."""
    return F.concat(F.lit(f"{prefix}_"), number.cast("string"))


def trade_name(operator: Column, name: Column) -> Column:
    """The operator where it differs from the name, else blank."""
    return F.when(~operator.eqNullSafe(name), F.coalesce(operator, F.lit(""))).otherwise("")


def distinct_items(c: Column) -> Column:
    """A '; ' list with each item once, at its first place."""
    return F.array_join(F.array_distinct(F.split(c, "; ")), "; ")


def query_address(*parts: Column, country: str = "Italy") -> Column:
    """The parts that are not blank and the country, as a geocoder is asked."""
    return F.concat_ws(", ", *[F.when(F.trim(p) != "", F.trim(p)) for p in parts], F.lit(country))
