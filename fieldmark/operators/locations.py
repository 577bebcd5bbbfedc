"""The common location table of all national registers, and what is shown of it."""

from __future__ import annotations

import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import animals
from ..sources.exports import read_current, replace_table
from ..sources.files import read_register
from .filters import in_country

#: Columns that every register must have, and the others that describe an establishment.
REQUIRED = [
    "establishment_id", "establishment_name", "street", "city", "state", "zip", "phone", "grant_date", "type", "dbas",
    "latitude", "longitude", "slaughter", "slaughter_volume_category", "processing_volume_category",
]
OPTIONAL = [
    "establishment_number", "duns_number", "animals_slaughtered_list", "animals_processed_list", "district", "circuit", "size", "county", "fips_code",
    "slaughter_or_processing_only", "slaughter_only_class", "slaughter_only_species", "meat_slaughter_only_species", "poultry_slaughter_only_species",
    "meat_exemption_custom_slaughter", "poultry_exemption_custom_slaughter",
]
SLAUGHTER_FLAGS = ["meat_slaughter", "poultry_slaughter", *[f"{n}_slaughter" for names in animals.SLAUGHTER.values() for n in names]]
PROCESSING_FLAGS = [f"{n}_processing" for n in animals.PROCESSING]
COLUMNS = [*REQUIRED, *OPTIONAL, *SLAUGHTER_FLAGS, *PROCESSING_FLAGS]


#: Headers of older registers under the names of today.
RENAMED = {"activities": "type"}
RESEARCH_HEADERS = {"Legal Name": "facility_name", "Certificate Number": "certificate_number", "City": "city", "State": "state", "Zip Code": "zip_code"}


def renamed(df: DataFrame, names: dict[str, str] = RENAMED) -> DataFrame:
    """Columns under new names; names that the table lacks are passed over."""
    return df.withColumnsRenamed(names)


def to_locations(df: DataFrame, *kept: str) -> DataFrame:
    """All columns of the location table: blanks for what is missing, 0.0 for missing coordinates; other columns but ``kept`` go."""
    have = set(df.columns)
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) if c in have else F.lit("")
    number = lambda c: F.coalesce(F.col(f"`{c}`").try_cast("double"), F.lit(0.0)) if c in have else F.lit(0.0)
    return df.select(*[(number(c) if c in ("latitude", "longitude") else text(c)).alias(c) for c in COLUMNS], *kept)


def shown_locations(locations: DataFrame) -> DataFrame:
    """The columns that are shown: flags become lists of animals."""
    same = ["establishment_id", "establishment_name", "latitude", "longitude", "type", "state", "city", "street", "zip", "slaughter"]
    lists = [animals.slaughtered(F.col("animals_slaughtered_list")).alias("animals_slaughtered"), animals.processed(F.col("animals_processed_list")).alias("animals_processed")]
    return locations.select("country", *same, *lists, "slaughter_volume_category", "processing_volume_category", "dbas", "phone", "grant_date")


def read_countries(spark: SparkSession, folder: str, countries: list[str], ordered: bool = False) -> DataFrame:
    """The registers <folder>/<country>/locations.csv under one another; a missing one warns and is skipped, a bad row fails.

    With ``ordered`` rows have their place in the register as ``_ord``.  The country is a literal of each branch of the union, so a filter on it drops the other files from the plan.
    """
    found = []
    for country in countries:
        try:
            rows = read_register(spark, f"{folder}/{country}/locations.csv", REQUIRED, ["latitude", "longitude"], ordered=ordered)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            warnings.warn(f"no register of {country}", stacklevel=2)
            continue
        found.append(to_locations(rows, *["_ord"] * ordered).withColumn("country", F.lit(country)))
    if not found:
        raise ValueError(f"no register in {folder}")
    first, *rest = found
    for df in rest:
        first = first.unionByName(df)
    return first


def write_countries(locations: DataFrame, path: str) -> None:
    """Puts the location table, as Parquet with a folder for each country, in the place of what ``path`` holds, which becomes its backup."""
    replace_table(locations.repartition("country", F.pmod(F.xxhash64("establishment_id"), F.lit(8))), path, ["country"])


def read_country(spark: SparkSession, path: str, country: str | None = None) -> DataFrame:
    """The written table, or only the folder of one country."""
    return in_country(read_current(spark, path), country)
