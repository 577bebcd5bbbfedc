"""National registers from their raw files to the common location table.

A ``Register`` says where each column of the location table comes from, which
constants and rules hold, and which rows are left out; ``read_locations`` applies
any of them.  Headers that a file lacks count as blank, but for those that the
register requires.  Rows keep their place in the file as ``_ord``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, columns, provinces, registers
from ..functions.columns import first_filled
from ..operators.locations import COLUMNS, to_locations
from ..operators.relational import numbered, with_cached_coordinates
from .files import read_positional, text_encoding
from .ordered import read_in_order, with_source_order

#: Gives the text under a header, '' where there is none.
Cell = Callable[[str], Column]


def _everything(cell: Cell) -> Column:
    return F.lit(True)


def _none(cell: Cell) -> dict[str, Column]:
    return {}


@dataclass(frozen=True)
class Register:
    """A national register: its columns by header or rule, constants, flags and the rows that count."""

    name: str
    country: str
    headers: dict[str, str] = field(default_factory=dict)  # column: header
    rules: Callable[[Cell], dict[str, Column]] = _none
    constants: dict[str, str] = field(default_factory=dict)
    flags: Callable[[Cell], dict[str, Column]] = _none
    keep: Callable[[Cell], Column] = _everything
    required: tuple[str, ...] = ()
    encoding: str | None = "UTF-8"  # None: UTF-8 where all lines are, else latin-1
    trimmed: bool = True  # whether blanks around values go


def cells(raw: DataFrame, trimmed: bool = True) -> Cell:
    have = set(raw.columns)
    text = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "") if trimmed else c
    return lambda header: F.coalesce(text(F.col(f"`{header}`").cast("string")), F.lit("")) if header in have else F.lit("")


def locations(register: Register, raw: DataFrame) -> DataFrame:
    """The location table of a register's raw rows, with ``country`` and, where the rows have it, ``_ord``."""
    if missing := set(register.required) - set(raw.columns):
        raise ValueError(f"{register.name} lacks the columns {sorted(missing)}")
    cell = cells(raw, register.trimmed)
    found = {c: cell(h) for c, h in register.headers.items()} | {c: F.lit(v) for c, v in register.constants.items()} | register.rules(cell)
    flags = {c: v for c, v in register.flags(cell).items() if c in COLUMNS}  # the table has no column for some
    order = [c for c in ("_ord",) if c in raw.columns]
    made = raw.where(register.keep(cell)).select(*[v.alias(c) for c, v in (found | flags).items()], *order)
    return to_locations(made, *order).withColumn("country", F.lit(register.country))


def read_locations(spark: SparkSession, register: Register, path: str) -> DataFrame:
    """The location table of a register's file."""
    return locations(register, read_in_order(spark, [path], register.encoding or text_encoding(spark, path)))


def combined(parts: list[DataFrame]) -> DataFrame:
    """Location tables of one country under one another; ``_source`` is the place of the table in the list."""
    return reduce(lambda a, b: a.unionByName(b), [df.withColumn("_source", F.lit(k)) for k, df in enumerate(parts)])


def number(text: Column) -> Column:
    """A blank is 0.0; null for what is no number."""
    text = F.trim(text)
    return F.when(text == "", 0.0).otherwise(F.when(text.rlike(columns.NUMBER), text).try_cast("double"))


def both_or_zero(lat: Column, lng: Column) -> dict[str, Column]:
    """Coordinates that are both 0.0 where either is no number."""
    a, b = number(lat), number(lng)
    good = a.isNotNull() & b.isNotNull()
    return {"latitude": F.when(good, a).otherwise(0.0), "longitude": F.when(good, b).otherwise(0.0)}


def on_the_globe(lat: Column, lng: Column) -> dict[str, Column]:
    """Coordinates that are null unless both are numbers of the globe and neither is 0."""
    good = columns.valid_coordinates(number(lat), number(lng))
    return dict(zip(("latitude", "longitude"), good, strict=True))


def named(parts: list[Column], *names: str) -> dict[str, Column]:
    return dict(zip(names, parts, strict=True))


# Italy ------------------------------------------------------------------------------------------


def _italian(cell: Cell) -> dict[str, Column]:
    street, city, state = columns.italian_address(cell("TOWN/REGION"), provinces.ITALY)
    activity = registers.italian_activity(cell("ASSOCIATED ACTIVITIES"))
    return {"street": F.trim(street), "city": F.trim(city), "state": state, "county": state, "type": activity}


ITALY = Register(
    "Italian register", "it",
    headers={"establishment_id": "APPROVAL NUMBER", "establishment_number": "APPROVAL NUMBER", "establishment_name": "NAME", "duns_number": "VAT"},
    rules=_italian,
    constants={"size": "Unknown", "processing_volume_category": "Unknown"},
    keep=lambda cell: cell("APPROVAL NUMBER") != "",
    required=("NAME",),
)

# Canada -----------------------------------------------------------------------------------------


def _federal(cell: Cell) -> dict[str, Column]:
    name, dba = columns.split_dba(cell("Name of the operator"))
    codes = cell("Function Codes")
    return {
        "establishment_id": columns.prefixed_id("CA_FED", cell("Establishment number")), "establishment_name": name, "dbas": dba, "type": classify.function_type(codes),
    } | both_or_zero(cell("Geocodio Latitude"), cell("Geocodio Longitude"))


FEDERAL_CANADA = Register(
    "federal Canadian register", "ca",
    headers={
        "establishment_number": "Establishment number", "phone": "Telephone Number", "street": "Geocodio Address Line 1", "city": "Geocodio City", "state": "Geocodio State",
        "zip": "Geocodio Postal Code",
    },
    rules=_federal,
    constants={"grant_date": "2025-01-01"},
    flags=lambda cell: registers.federal_animals(cell("Function Codes")),
    encoding=None,
)


def _ontario(cell: Cell) -> dict[str, Column]:
    kind = registers.ontario_type(cell("FP_ETVA avec abattoir"), cell("FSMP_ETVA"))
    return {"establishment_id": columns.prefixed_id("CA_ON", cell("Plant Number_No. de l'usine")), "type": kind} | both_or_zero(cell("Latitude"), cell("Longitude"))


ONTARIO = Register(
    "register of Ontario", "ca",
    headers={
        "establishment_number": "Plant Number_No. de l'usine", "establishment_name": "Plant Name_ Nom de l'usine", "street": "Address_Adresse", "city": "City_Ville", "state": "Province",
        "zip": "Postal Code_Code postal", "phone": "Telephone_Téléphone",
    },
    rules=_ontario,
    constants={"grant_date": "2025-01-01"},
    flags=registers.ontario_animals,
    encoding=None,
)

# Mexico -----------------------------------------------------------------------------------------

#: Activity codes that count, and their types.
SCIAN_TYPES = {
    "112513": "Aquaculture Facility",
    "112514": "Aquaculture Facility",
    "112515": "Aquaculture Facility",
    "112516": "Aquaculture Facility",
    "112519": "Aquaculture Facility",
    "114111": "Fishing Operation",
    "114112": "Fishing Operation",
    "114113": "Fishing Operation",
    "114119": "Fishing Operation",
    "115210": "Animal Farming Service",
}
#: The types of the focused table.
FOCUSED_TYPES = ["Aquaculture Facility", "Animal Farming Service"]


def _mexican_type(cell: Cell) -> Column:
    return columns.lookup(cell("codigo_act"), SCIAN_TYPES)


def _mexican(cell: Cell) -> dict[str, Column]:
    street = registers.mexican_address(*[cell(h) for h in ("tipo_vial", "nom_vial", "numero_ext", "letra_ext", "numero_int", "letra_int")], none="Unknown")
    town = first_filled(cell("municipio"))
    return {
        "establishment_name": first_filled(cell("nom_estab")), "street": street, "city": F.coalesce(columns.filled(cell("nomb_asent")), town), "county": town,
        "state": first_filled(cell("entidad")), "phone": columns.clean_phone(cell("telefono")), "type": classify.mapped(_mexican_type(cell), classify.MEXICAN_NAMES),
    } | on_the_globe(cell("latitud"), cell("longitud"))


_MEXICAN_HEADERS = {"establishment_id": "id", "establishment_number": "id", "zip": "cod_postal", "grant_date": "fecha_alta", "dbas": "raz_social"}
MEXICO = Register("Mexican register", "mx", headers=_MEXICAN_HEADERS, rules=_mexican, keep=lambda cell: cell("codigo_act").isin(*SCIAN_TYPES), encoding="ISO-8859-1")
MEXICO_FOCUSED = Register("focused Mexican register", "mx", headers=_MEXICAN_HEADERS, rules=_mexican, keep=lambda cell: _mexican_type(cell).isin(FOCUSED_TYPES), encoding="ISO-8859-1")


def _placed(cell: Cell, row_id: str, lat: str, lng: str) -> Column:
    return (cell(row_id) != "") & on_the_globe(cell(lat), cell(lng))["latitude"].isNotNull()


def _unit(cell: Cell) -> dict[str, Column]:
    parts = ("Tipo de vialidad", "Nombre de la vialidad", "Número exterior o kilómetro", "Letra exterior", "Número interior", "Letra interior")
    return {
        "establishment_name": first_filled(cell("Nombre de la Unidad Económica"), cell("Razón social")), "street": registers.mexican_address(*[cell(h) for h in parts]),
        "city": first_filled(cell("Localidad"), cell("Municipio"), default=""), "type": classify.keyword_type(cell("Nombre de clase de la actividad"), classify.MEXICAN_TYPES, "Processing"),
    } | on_the_globe(cell("Latitud"), cell("Longitud"))


#: Laboratories and meat plants, which the register lists in files of one form.
MEXICO_UNITS = Register(
    "Mexican laboratories and meat plants", "mx",
    headers={
        "establishment_id": "ID", "establishment_number": "ID", "state": "Entidad federativa", "zip": "Código Postal", "phone": "Número de teléfono", "dbas": "Razón social",
        "grant_date": "Fecha de incorporación al DENUE", "size": "Descripcion estrato personal ocupado",
    },
    rules=_unit,
    flags=lambda cell: registers.mexican_animals(cell("Nombre de clase de la actividad")),
    keep=lambda cell: _placed(cell, "ID", "Latitud", "Longitud"),
    encoding="ISO-8859-1",
)


def _aquaculture(cell: Cell) -> dict[str, Column]:
    return {"establishment_name": first_filled(cell("establishment_name"), cell("dbas"))} | on_the_globe(cell("latitude"), cell("longitude"))


#: The location table of aquaculture once more, as a part of the combined one.
MEXICO_AQUACULTURE = Register(
    "Mexican aquaculture", "mx",
    headers={c: c for c in ("establishment_id", "establishment_number", "duns_number", "street", "city", "state", "zip", "phone", "grant_date", "dbas", "district", "circuit", "size", "county", "fips_code")},
    rules=_aquaculture,
    constants={"type": "Aquaculture"},
    keep=lambda cell: _placed(cell, "establishment_id", "latitude", "longitude"),
    encoding="ISO-8859-1",
)

# United Kingdom ---------------------------------------------------------------------------------

#: Classifications and the flags they set.
BRITISH_SLAUGHTER = {
    "cow_slaughter": ["beef_cow_slaughter", "steer_slaughter", "heifer_slaughter", "bull_stag_slaughter", "dairy_cow_slaughter"],
    "pig_slaughter": ["market_swine_slaughter", "sow_slaughter"],
    "goat_slaughter": ["goat_slaughter", "young_goat_slaughter", "adult_goat_slaughter"],
    "sheep_lamb_slaughter": ["sheep_slaughter", "lamb_slaughter"],
    "poultry_slaughter": ["poultry_slaughter", "young_chicken_slaughter"],
    "other_mammal_slaughter": ["other_voluntary_livestock_slaughter"],
}


def _british(cell: Cell) -> dict[str, Column]:
    street, city, zip_code = columns.uk_address(cell("address"))
    zero = lambda c: F.coalesce(number(c), F.lit(0.0))
    return {
        "street": street, "city": city, "zip": zip_code, "grant_date": F.substring(cell("firstImportedAt"), 1, 10), "type": classify.british_activities(cell("classifications")),
        "dbas": columns.trade_name(cell("operator"), cell("name")), "latitude": zero(cell("latitude")), "longitude": zero(cell("longitude")),
    }


def _british_flags(cell: Cell) -> dict[str, Column]:
    """Other mammals make a row a slaughterhouse by its activities, but do not set the flag of slaughter."""
    held = classify.classification_flags(cell("classifications"), classify.BRITISH_FLAGS)
    yes = lambda c: F.when(c, "Yes").otherwise("")
    kills = yes(reduce(lambda a, b: a | b, [held[c] for c in BRITISH_SLAUGHTER if c != "other_mammal_slaughter"]))
    return {"slaughter": kills, "meat_slaughter": kills} | {flag: yes(held[c]) for c, flags in BRITISH_SLAUGHTER.items() for flag in flags}


UNITED_KINGDOM = Register(
    "British register", "uk",
    headers={"establishment_id": "id", "establishment_number": "id", "establishment_name": "name", "state": "county", "county": "county"},
    rules=_british,
    constants={"size": "Unknown", "slaughter_volume_category": "Unknown", "processing_volume_category": "Unknown"},
    flags=_british_flags,
    required=("id", "name", "operator", "address", "county", "classifications", "firstImportedAt", "latitude", "longitude"),
    trimmed=False,
)


def with_british_types(table: DataFrame, raw: DataFrame) -> DataFrame:
    """The British table with the plain names of its classifications as types; rows that ``raw`` lacks keep theirs, the last of a repeated id counts."""
    unquoted = lambda c: F.btrim(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'))
    names = raw.select(unquoted("id").alias("establishment_id"), classify.primary_type(unquoted("classifications"), classify.BRITISH_TYPES).alias("_type"), "_ord")
    last = names.groupBy("establishment_id").agg(F.max_by("_type", "_ord").alias("_type"))
    return table.join(last, "establishment_id", "left").withColumn("type", F.coalesce("_type", "type")).select(table.columns)

# Spain ------------------------------------------------------------------------------------------


def _spanish(cell: Cell) -> dict[str, Column]:
    street, city, zip_code = columns.spanish_address(cell("address"))
    zero = lambda c: F.coalesce(number(c), F.lit(0.0))
    return {
        "street": street, "city": city, "zip": zip_code, "state": F.coalesce(columns.filled(cell("country")), cell("county")), "grant_date": F.substring(cell("firstImportedAt"), 1, 10),
        "type": classify.spanish_activities(cell("classifications")), "dbas": columns.trade_name(cell("operator"), cell("name")), "latitude": zero(cell("latitude")), "longitude": zero(cell("longitude")),
    }


#: Farms and aquaculture only: no flag of slaughter is ever set.
SPAIN = Register(
    "Spanish register", "es",
    headers={"establishment_id": "id", "establishment_number": "id", "establishment_name": "name", "county": "county"},
    rules=_spanish,
    constants={"size": "Unknown", "slaughter_volume_category": "Unknown", "processing_volume_category": "Unknown"},
    required=("id", "name", "operator", "address", "country", "county", "classifications", "firstImportedAt", "latitude", "longitude"),
    trimmed=False,
)

# Denmark ----------------------------------------------------------------------------------------

DANISH_ROWS = "branche string, navn1 string, adresse1 string, postnr string, By string, Geo_Lat string, Geo_Lng string"


def _danish(cell: Cell) -> dict[str, Column]:
    zero = lambda c: F.coalesce(F.when(c != "", number(c)), F.lit(0.0))
    return {
        "zip": F.coalesce(cell("postnr").try_cast("long").cast("string"), F.lit("")), "type": classify.danish_activities(cell("branche")),
        "latitude": zero(cell("Geo_Lat")), "longitude": zero(cell("Geo_Lng")),
    }


DENMARK = Register(
    "Danish register", "dk",
    headers={"establishment_name": "navn1", "street": "adresse1", "city": "By"},
    rules=_danish,
    constants={"county": "Denmark"},
    keep=lambda cell: classify.danish_industry(cell("branche")),
)


def read_denmark(spark: SparkSession, path: str, row_tag: str = "row") -> DataFrame:
    """The Danish table from its XML file; ids are the places among the rows that count, from 0."""
    raw = with_source_order(spark.read.format("xml").option("rowTag", row_tag).schema(DANISH_ROWS).load(path))
    found = numbered(locations(DENMARK, raw), ["_ord"])
    return found.withColumn("establishment_id", F.col("id").cast("string")).drop("id")


# Germany ----------------------------------------------------------------------------------------

#: The file has no header; names for its first columns.
GERMAN_COLUMNS = ["number", "old number", "name", "address", "activities", "category", "species"]


def _german(cell: Cell) -> dict[str, Column]:
    street, zip_code, city = columns.german_address(cell("address"))
    return {"establishment_id": F.coalesce(columns.filled(cell("number")), cell("old number")), "street": street, "zip": zip_code, "city": city, "type": registers.german_activity(cell("activities"))}


def _german_flags(cell: Cell) -> dict[str, Column]:
    found = registers.german_animals(cell("activities"), cell("species"))
    return found | {"slaughter": found["meat_slaughter"]}


GERMANY = Register("German register", "de", headers={"establishment_name": "name"}, rules=_german, flags=_german_flags)


def read_germany(spark: SparkSession, path: str, cache: DataFrame, encoding: str = "UTF-8") -> DataFrame:
    """The German table from its file without a header, with coordinates from a cache (street, city, zip, latitude, longitude, _ord)."""
    raw = with_source_order(read_positional(spark, path, GERMAN_COLUMNS, encoding=encoding))
    found = locations(GERMANY, raw)
    return with_cached_coordinates(found, cache).select(found.columns)


# France -----------------------------------------------------------------------------------------

_MARK = "struct<name: string, description: string, Point: struct<coordinates: string>>"


def _marks(placemarks: DataFrame, order: list[str]) -> DataFrame:
    """The location table of placemarks (folder and p), numbered in order from 1."""
    bare = lambda c: F.trim(F.regexp_replace(c, r"\[CDATA\[|\]\]", ""))
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", ""), r"\[CDATA\[|\]\]", ""), r"(?U)\s+", " "))
    part = lambda k: F.get(F.split(F.trim("p.Point.coordinates"), ","), F.lit(k)).try_cast("double")
    rows = numbered(placemarks, order, 1)
    key = F.col("id").cast("string")
    made = rows.select(
        key.alias("establishment_id"), key.alias("establishment_number"), F.coalesce(bare(F.col("p.name")), F.concat(F.lit("Location "), key)).alias("establishment_name"),
        registers.french_activity(plain(F.col("p.description")), bare(F.coalesce("folder", F.lit("Unknown")))).alias("type"), part(1).alias("latitude"), part(0).alias("longitude"), F.lit("2024-03-01").alias("grant_date"),
        *[F.lit("Unknown").alias(c) for c in ("size", "slaughter_volume_category", "processing_volume_category")], F.col("id").alias("_ord"),
    )
    return to_locations(made, "_ord").withColumn("country", F.lit("fr"))


def read_france(spark: SparkSession, path: str) -> DataFrame:
    """The French table from the folders of its KML map, ids in the order of the file from 1."""
    folders = with_source_order(spark.read.format("xml").option("rowTag", "Folder").schema(f"name string, Placemark array<{_MARK}>").load(path))
    return _marks(folders.select(F.col("name").alias("folder"), F.col("_ord").alias("_folder"), F.posexplode("Placemark").alias("_place", "p")), ["_folder", "_place"])


# New Zealand ------------------------------------------------------------------------------------


def _new_zealand(cell: Cell) -> dict[str, Column]:
    kills, slaughtered, processed = registers.nz_animals(cell("Secondary Process"), cell("Product/Material"))
    return {"type": registers.nz_activity(cell("Risk Measure Type"), cell("Programme Type")), "slaughter": kills, "animals_slaughtered_list": slaughtered, "animals_processed_list": processed}


#: Coordinates come from the addresses: see ``enrichment.with_coordinates`` and ``new_zealand_address``.
NEW_ZEALAND = Register(
    "register of New Zealand", "nz",
    headers={
        "establishment_id": "MPI ID Number", "establishment_name": "Operator Business Name", "street": "Physical Address", "city": "Physical Town/City", "state": "Operator Local Authority",
        "grant_date": "Effective Date", "dbas": "Operator Trading Name",
    },
    rules=_new_zealand,
    trimmed=False,
)


def new_zealand_address() -> Column:
    """What a geocoder is asked for a row of the table."""
    return F.concat_ws(", ", "street", "city", F.lit("New Zealand"))
