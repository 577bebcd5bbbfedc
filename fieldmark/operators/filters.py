"""Predicates of the facility map: country, state, text, licence and coordinates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYNONYMS = {"cow": "cattle", "cows": "cattle"}
LAB_PHRASES = ["research laboratory", "laboratory", "research facility", "testing facility", "lab"]
LICENCES = {"breeder": "Class A - Breeder", "dealer": "Class B - Dealer", "exhibitor": "Class C - Exhibitor"}


def in_country(df: DataFrame, code: str | None) -> DataFrame:
    """All rows, or those of one country tag; on a partitioned table this prunes partitions."""
    return df if code is None else df.where(F.col("country") == code)


def country_match(selected: str, state: Column, country: Column, regions: dict[str, list[str]], tagged: set[str]) -> Column:
    """Membership of the state in the selected country's regions, or its tag; UK is what no dictionary holds."""
    if selected == "all":
        return F.lit(True)
    if selected == "UK":
        known = [s for states in regions.values() for s in states]
        return (F.trim(F.coalesce(state, F.lit(""))) != "") & ~state.isin(known)
    given = F.upper(state) if selected == "MX" else state  # Mexican registers write states in any case
    tests = [given.isin(regions[selected])] if selected in regions else []
    tests += [country == selected.lower()] if selected in tagged else []
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False))


def state_match(selected_country: str, selected_state: str, state: Column, city: Column) -> Column:
    if selected_state == "all" or selected_country == "FR":
        return F.lit(True)
    return (city if selected_country == "DK" else state) == selected_state


def text_match(term: str, texts: list[Column], animals: list[Column]) -> Column:
    """Literal, case-insensitive containment; synonyms hold for animal columns only."""
    term = term.lower().strip()
    if not term:
        return F.lit(True)
    found = [F.lower(c).contains(term) for c in texts] + [F.lower(c).contains(SYNONYMS.get(term, term)) for c in animals]
    return F.coalesce(reduce(lambda a, b: a | b, [F.coalesce(x, F.lit(False)) for x in found]), F.lit(False))


def lab_match(term: str, name: Column, animals: Column) -> Column:
    if not term or any(term in p for p in LAB_PHRASES):
        return F.lit(True)
    return F.coalesce(F.lower(name).contains(term), F.lit(False)) | F.coalesce(F.lower(animals).contains(term), F.lit(False))


def inspection_match(term: str, name: Column, licence: Column, shown: list[str]) -> Column:
    layers = licence.isin([LICENCES[s] for s in shown])
    if not term:
        return layers
    reverse = [licence == v for k, v in LICENCES.items() if term in k]
    return layers & reduce(lambda a, b: a | b, [F.lower(name).contains(term), F.lower(licence).contains(term), *reverse])


def meaningful(c: Column) -> Column:
    return (F.trim(c) != "") & ~F.lower(c).isin("n/a", "unknown")


def in_box(lat: Column, lng: Column, south: float, north: float, west: float, east: float) -> Column:
    return (lat > south) & (lat < north) & (lng > west) & (lng < east)


def inspection_filter(country: str, selected_state: str, term: str, state: Column, tag: Column, name: Column, licence: Column, shown: list[str], regions: dict[str, list[str]], tagged: set[str]) -> Column:
    """Inspections of a country and state whose name or licence holds the term, on the layers that are shown."""
    here = F.lit(True) if selected_state == "all" else state == selected_state
    return country_match(country, state, tag, regions, tagged) & here & inspection_match(term, name, licence, shown)


def located(row_id: Column, lat: Column, lng: Column) -> Column:
    """Rows with an id and coordinates that are numbers of the globe, neither of them 0."""
    return (F.trim(row_id) != "") & lat.between(-90, 90) & lng.between(-180, 180) & (lat != 0) & (lng != 0)


def placeable(lat: Column, lng: Column) -> Column:
    """Coordinates that a marker can stand at: neither zero nor NaN nor missing."""
    return (lat != 0) & (lng != 0) & ~F.isnan(lat) & ~F.isnan(lng)


def researchable(company: Column) -> Column:
    """Company names long and special enough to look up."""
    return (F.length(company) >= 4) & ~F.lower(company).isin("meat", "usda")


def first_of_type(df: DataFrame, kind: str | Column, order: str, limit: int = 20) -> DataFrame:
    """The first rows of one type in order."""
    return df.where(F.col("type") == kind).orderBy(order).limit(limit)
