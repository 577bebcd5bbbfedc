"""Queries of whole national registers: raw rows made from the tables, then the register's description."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import national
from .adapter import table
from .registers import _pick
from .registry import query


def _text(name: str):
    return F.col(name).cast("string")


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS establishment_id, s_name AS establishment_name, CASE s_suppkey % 4 WHEN 1 THEN concat('VIA ', s_nationkey) WHEN 2 THEN concat('BORGO ', s_suppkey) ELSE 'PIAZZA, ALTA' END AS street,
    CASE s_suppkey % 4 WHEN 1 THEN 'ALBA' ELSE '' END AS city, CASE WHEN s_suppkey % 4 = 1 THEN list_extract(['Cuneo', 'L''Aquila', 'Forlì-Cesena', 'QQ', 'Reggio di Calabria'], CAST(s_nationkey % 5 + 1 AS INTEGER)) ELSE '' END AS county,
    list_extract(['Meat Processing', 'Meat Slaughter', 'Meat Processing; Meat Slaughter', 'Meat Production'], CAST(s_nationkey % 4 + 1 AS INTEGER)) AS type, 'Unknown' AS size, 0.0::DOUBLE AS latitude, '' AS slaughter, 'it' AS country
    FROM supplier WHERE s_suppkey % 4 <> 0""")
def italian_locations(spark, d):
    """Rows without an approval number go; provinces by code, also one that is unknown."""
    s = table(spark, d, "supplier")
    place = F.concat(F.lit(" VIA "), _text("s_nationkey"), F.lit(", ALBA ("), _pick(["CN", "AQ", "FU", "QQ", "RC"], "s_nationkey"), F.lit(")"))
    kind = F.col("s_suppkey") % 4
    raw = s.select(
        F.when(kind == 0, " ").otherwise(_text("s_suppkey")).alias("APPROVAL NUMBER"), F.concat(F.lit(" "), "s_name").alias("NAME"), _pick(["CP", "SH", "CP|SH", "-"], "s_nationkey").alias("ASSOCIATED ACTIVITIES"),
        F.when(kind == 1, place).when(kind == 2, F.concat(F.lit("BORGO "), _text("s_suppkey"))).otherwise("PIAZZA, ALTA").alias("TOWN/REGION"),
    )
    return national.locations(national.ITALY, raw).select("establishment_id", "establishment_name", "street", "city", "county", "type", "size", "latitude", "slaughter", "country")


_CANADA_SQL = """SELECT concat('CA_FED_', s_suppkey) AS establishment_id, s_name AS establishment_name, CASE s_suppkey % 2 WHEN 0 THEN 'as Best' ELSE '' END AS dbas, '2025-01-01' AS grant_date,
    CASE s_nationkey % 3 WHEN 0 THEN 'Slaughter' WHEN 1 THEN 'Canning' ELSE 'Unknown' END AS type, CASE WHEN s_suppkey % 3 = 2 THEN 0.0 ELSE s_nationkey + 0.5 END AS latitude,
    CASE s_nationkey % 3 WHEN 0 THEN 'Yes' ELSE '' END AS market_swine_slaughter, CASE s_nationkey % 3 WHEN 1 THEN 'Yes' ELSE '' END AS goat_processing, '' AS elk_slaughter FROM supplier
    UNION ALL SELECT concat('CA_ON_', c_custkey), c_name, '', '2025-01-01', CASE c_custkey % 3 WHEN 0 THEN 'Slaughter' WHEN 1 THEN 'Processing' ELSE 'Other' END, c_nationkey + 0.25,
    CASE c_nationkey % 2 WHEN 0 THEN 'Yes' ELSE '' END, '', CASE c_nationkey % 2 WHEN 1 THEN 'Yes' ELSE '' END FROM customer"""


@query(_CANADA_SQL)
def canadian_locations(spark, d):
    """Both Canadian registers; a place of which one coordinate is no number has none."""
    s, c = table(spark, d, "supplier"), table(spark, d, "customer")
    federal = s.select(
        _text("s_suppkey").alias("Establishment number"), F.when(F.col("s_suppkey") % 2 == 0, F.concat("s_name", F.lit(" Also Doing Business as Best"))).otherwise(F.col("s_name")).alias("Name of the operator"),
        _pick(["1d", "2s", ""], "s_nationkey").alias("Function Codes"), (F.col("s_nationkey") + 0.5).cast("string").alias("Geocodio Latitude"), _pick(["1.5", "", "west"], "s_suppkey").alias("Geocodio Longitude"),
    )
    ontario = c.select(
        _text("c_custkey").alias("Plant Number_No. de l'usine"), F.col("c_name").alias("Plant Name_ Nom de l'usine"), _pick(["1", "0", ""], "c_custkey").alias("FP_ETVA avec abattoir"), _pick(["1", "1", "0"], "c_custkey").alias("FSMP_ETVA"),
        _pick(["1", "0"], "c_nationkey").alias("Pigs_Porcs"), _pick(["0", "1"], "c_nationkey").alias("Deer, Elk_Cerfs, Élans"), (F.col("c_nationkey") + 0.25).cast("string").alias("Latitude"), F.lit("").alias("Longitude"),
    )
    both = national.combined([national.locations(national.FEDERAL_CANADA, federal), national.locations(national.ONTARIO, ontario)])
    return both.select("establishment_id", "establishment_name", "dbas", "grant_date", "type", "latitude", "market_swine_slaughter", "goat_processing", "elk_slaughter")


#: Codes of the register, by hand, with two that do not count.
_SCIAN = ["112512", "112513", "112514", "112515", "112516", "112519", "114111", "114112", "114113", "114119", "115210", "115310"]
_MEXICO_SQL = """SELECT CAST(c_custkey AS VARCHAR) AS establishment_id, CASE WHEN c_nationkey = 0 THEN 'Unknown' ELSE c_name END AS establishment_name, CASE WHEN c_nationkey % 2 = 0 THEN 'CALLE SOL' ELSE 'Unknown' END AS street,
    CASE c_nationkey % 3 WHEN 0 THEN c_mktsegment WHEN 1 THEN 'LEÓN' ELSE 'Unknown' END AS city, CASE WHEN c_custkey % 12 BETWEEN 1 AND 5 THEN 'Aquaculture Farm' WHEN c_custkey % 12 = 10 THEN 'Farm / Breeder' ELSE 'Fishing Operation' END AS type,
    '(55)12' AS phone, CASE WHEN c_nationkey BETWEEN 1 AND 8 THEN c_nationkey * 10.0 ELSE 0.0 END AS latitude, 'mx' AS country FROM customer WHERE """


def _mexico(spark, d, register):
    c = table(spark, d, "customer")
    raw = c.select(
        _text("c_custkey").alias("id"), F.when(F.col("c_nationkey") != 0, F.col("c_name")).alias("nom_estab"), _pick(_SCIAN, "c_custkey").alias("codigo_act"), _pick(["CALLE", ""], "c_nationkey").alias("tipo_vial"),
        _pick(["SOL", " "], "c_nationkey").alias("nom_vial"), F.when(F.col("c_nationkey") % 3 == 0, F.col("c_mktsegment")).alias("nomb_asent"), F.when(F.col("c_nationkey") % 3 < 2, "LEÓN").alias("municipio"),
        F.lit("tel (55) 12").alias("telefono"), (F.col("c_nationkey") * 10.0 + F.when(F.col("c_nationkey") == 9, 0.5).otherwise(0.0)).cast("string").alias("latitud"), F.lit("-99.5").alias("longitud"),
    )
    return national.locations(register, raw).select("establishment_id", "establishment_name", "street", "city", "type", "phone", "latitude", "country")


@query(_MEXICO_SQL + "c_custkey % 12 BETWEEN 1 AND 10")
def mexican_locations(spark, d):
    """Ten codes count; a latitude of 0 or beyond the globe is none."""
    return _mexico(spark, d, national.MEXICO)


@query(_MEXICO_SQL + "c_custkey % 12 IN (1, 2, 3, 4, 5, 10)")
def mexican_focused_locations(spark, d):
    return _mexico(spark, d, national.MEXICO_FOCUSED)


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS establishment_id, s_name AS establishment_name, CASE WHEN s_suppkey % 2 = 0 THEN 'Op' ELSE '' END AS dbas, 'Leeds' AS city, 'LS1 4AB' AS zip, '2020-01-02' AS grant_date,
    list_extract(['Meat Slaughter', 'Meat Slaughter', 'Animal Production', 'Unknown'], CAST(s_suppkey % 4 + 1 AS INTEGER)) AS type, CASE s_suppkey % 4 WHEN 0 THEN 'Yes' ELSE '' END AS slaughter,
    CASE s_suppkey % 4 WHEN 0 THEN 'Yes' ELSE '' END AS steer_slaughter, CASE s_suppkey % 4 WHEN 1 THEN 'Yes' ELSE '' END AS other_voluntary_livestock_slaughter, 0.0::DOUBLE AS latitude, s_nationkey * 1.0::DOUBLE AS longitude FROM supplier""")
def british_locations(spark, d):
    """Other mammals set the type and their own flag, but not the flag of slaughter; coordinates count each for itself."""
    raw = table(spark, d, "supplier").select(
        _text("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 2 == 0, "Op").otherwise(F.col("s_name")).alias("operator"), F.lit("1 Mill Lane, Leeds, LS1 4AB, United Kingdom").alias("address"),
        F.lit("Yorkshire").alias("county"), _pick(["CowSlaughterhouse", "OtherMammalSlaughterhouse", "DairyFarm", "Zoo"], "s_suppkey").alias("classifications"), F.lit("2020-01-02T03").alias("firstImportedAt"),
        F.lit("north").alias("latitude"), (F.col("s_nationkey") * 1.0).cast("string").alias("longitude"),
    )
    return national.locations(national.UNITED_KINGDOM, raw).select(
        "establishment_id", "establishment_name", "dbas", "city", "zip", "grant_date", "type", "slaughter", "steer_slaughter", "other_voluntary_livestock_slaughter", "latitude", "longitude"
    )


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS establishment_id, CASE WHEN s_suppkey % 3 = 0 THEN 'kept' ELSE list_extract(['Cattle Slaughterhouse', 'Dairy Farm', 'Unknown Facility'], CAST(s_nationkey % 3 + 1 AS INTEGER)) END AS type FROM supplier""")
def british_types_updated(spark, d):
    """A table whose types are replaced by another file's; quotes around ids and classifications go, the last row of an id counts."""
    s = table(spark, d, "supplier")
    old = s.select(_text("s_suppkey").alias("establishment_id"), F.lit("kept").alias("type"))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    first = s.select(_text("s_suppkey").alias("id"), F.lit("PigSlaughterhouse").alias("classifications"), F.lit(0).alias("_ord"))
    last = s.select(quoted(_text("s_suppkey")).alias("id"), quoted(_pick(["CowSlaughterhouse", "DairyFarm", ""], "s_nationkey")).alias("classifications"), F.lit(1).alias("_ord"))
    return national.with_british_types(old, first.union(last).where('cast(replace(id, \'"\', \'\') as long) % 3 <> 0'))
