"""Queries of markers, popups, export rows and the smaller rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, columns, registers, states
from ..operators import filters, locations, relational, reports
from .adapter import table
from .registers import _pick
from .registry import LICENCE_SQL, _licence, query


@query(f"SELECT o_orderkey, CASE {LICENCE_SQL} WHEN 'Class B - Dealer' THEN 'dealer' WHEN 'Class C - Exhibitor' THEN 'exhibitor' ELSE 'breeder' END AS icon FROM orders")
def licence_icons(spark, d):
    return table(spark, d, "orders").select("o_orderkey", classify.licence_icon(_licence()).alias("icon"))


@query("""SELECT p_partkey, p_partkey % 2 = 0 AND p_size % 4 = 0 AND p_partkey % 3 <> 1 AS shows_slaughtered, p_partkey % 2 = 0 AND p_size % 7 BETWEEN 1 AND 5 AS shows_slaughter_volume,
    p_size % 4 IN (0, 3) AND p_partkey % 3 <> 1 AS shows_processed, p_size % 7 BETWEEN 1 AND 5 AND p_partkey % 3 <> 1 AS shows_processing_volume, p_partkey % 3 = 1 AS approximate FROM part""")
def popup_sections(spark, d):
    """Lists that are filled, blank, N/A or unknown; volumes from 0.0 to 6.0; facilities in the US, Mexico and nowhere."""
    volume = F.concat((F.col("p_size") % 7).cast("string"), F.lit(".0"))
    country = F.when(F.col("p_partkey") % 3 == 0, "us").when(F.col("p_partkey") % 3 == 1, "mx")
    slaughtered, processed = _pick(["Pigs", " ", "N/A", "unknown"], "p_size"), _pick(["Beef", "", "n/a", "Veal"], "p_size")
    return table(spark, d, "part").select("p_partkey", *reports.popup_sections(F.col("p_partkey") % 2 == 0, slaughtered, volume, processed, volume, country))


@query(f"""SELECT o_orderkey FROM orders WHERE {LICENCE_SQL} IN ('Class A - Breeder', 'Class C - Exhibitor') AND o_custkey % 3 = 0
    AND (contains(lower(o_orderstatus), 'e') OR contains(lower({LICENCE_SQL}), 'e'))""")
def inspections_of_state(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", _licence().alias("licence"), _pick(["CA", "TX", "ON"], "o_custkey").alias("state"))
    wanted = filters.inspection_filter("US", "CA", "e", F.col("state"), F.lit("us"), F.col("o_orderstatus"), F.col("licence"), ["breeder", "exhibitor"], states.REGIONS, states.TAGGED)
    return o.where(wanted).select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (0, 1) AND c_nationkey * 8 BETWEEN -90 AND 90")
def located_rows(spark, d):
    """Nation 0 has an id and stands at 0, nation 1 has no id."""
    row_id, lat = F.when(F.col("c_nationkey") == 1, " ").otherwise(F.col("c_name")), F.col("c_nationkey") * 8.0
    return table(spark, d, "customer").where(filters.located(row_id, lat, lat)).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0 AND c_nationkey NOT IN (0, 7)")
def placeable_markers(spark, d):
    """Zero, missing and NaN coordinates have no marker."""
    lat, lng = F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey") % 5 * 1.0), F.when(F.col("c_nationkey") == 7, float("nan")).otherwise(F.col("c_nationkey") * 1.0)
    return table(spark, d, "customer").where(filters.placeable(lat, lng)).select("c_custkey")


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey % 4 = 3")
def researchable_companies(spark, d):
    return table(spark, d, "supplier").where(filters.researchable(_pick(["Abc", "MEAT", "usda", "Acme Foods"], "s_suppkey"))).select("s_suppkey")


@query("SELECT p_partkey, p_type AS type FROM part WHERE p_type = (SELECT min(p_type) FROM part WHERE p_partkey = 0) ORDER BY p_partkey LIMIT 20")
def first_of_type(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_type").alias("type"))
    kind = p.where("p_partkey = 0").agg(F.min("type"))
    return filters.first_of_type(p, kind.scalar(), "p_partkey")


@query("""SELECT p_partkey, p_type AS type FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS n FROM
    (SELECT * FROM part ORDER BY p_partkey LIMIT 20)) WHERE n <= 2""")
def samples_per_type(spark, d):
    return relational.samples_per_type(table(spark, d, "part").select("p_partkey", F.col("p_type").alias("type")), "type", "p_partkey")


@query("SELECT c_custkey, concat('CA_ON_', c_custkey) AS id, CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN c_mktsegment ELSE '' END AS dbas, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE c_name END AS state FROM customer")
def names_and_ids(spark, d):
    """Prefixed ids, operators as trade names where they differ from the name, and the county where the country is missing."""
    operator = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).when(F.col("c_custkey") % 3 == 1, F.col("c_mktsegment"))
    state = columns.first_filled(F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")), F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", columns.prefixed_id("CA_ON", F.col("c_custkey")).alias("id"), columns.trade_name(operator, F.col("c_name")).alias("dbas"), state.alias("state"))


@query("SELECT p_partkey, p_type AS type, p_brand AS city FROM part")
def renamed_headers(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_type").alias("activities"), F.col("p_brand").alias("City"))
    return locations.renamed(locations.renamed(p), locations.RESEARCH_HEADERS)


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand || '; ' || p_type ELSE p_type || '; ' || p_brand END AS items FROM part")
def distinct_items(spark, d):
    a, b = F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(F.col("p_type")), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", columns.distinct_items(F.concat_ws("; ", a, b, a, b, b)).alias("items"))


_EMPLOYEES_SQL = "list_extract(['0-5', '251+', 'Unknown', '250+', 'Unknown'], CAST(p_size % 5 + 1 AS INTEGER))"


@query(f"""SELECT p_partkey, list_extract(['Aquaculture Farm', 'Fishing Operation', 'Farm / Breeder', 'Zoo'], CAST(p_partkey % 4 + 1 AS INTEGER)) AS type,
    list_extract(['Aquaculture', 'Fishing', 'Breeding/Farming', 'Breeding/Farming'], CAST(p_partkey % 4 + 1 AS INTEGER)) AS category, {_EMPLOYEES_SQL} AS employees FROM part""")
def mexican_types(spark, d):
    given = _pick(["Aquaculture Facility", "Fishing Operation", "Animal Farming Service", "Zoo"], "p_partkey")
    people = classify.employees(_pick(["0 a 5 personas", "251+", "", "251 y mas", ""], "p_size"))
    return table(spark, d, "part").select("p_partkey", classify.mapped(given, classify.MEXICAN_NAMES).alias("type"), classify.mexican_category(given).alias("category"), people.alias("employees"))


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN s_name || ', LT, Italy' WHEN 1 THEN 'Via Roma 1, ' || s_name || ', Italy' ELSE s_name || ', Italy' END AS address FROM supplier")
def query_addresses(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", columns.query_address(_pick(["", "Via Roma 1 ", " "], "s_suppkey"), F.col("s_name"), F.when(F.col("s_suppkey") % 3 == 0, "LT")).alias("address"))


@query("""WITH c AS (SELECT s_nationkey + 5 AS k, s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_acctbal END AS v FROM supplier)
    SELECT c_custkey, coalesce(v, 0.0) AS latitude, coalesce(-v, 0.0) AS longitude FROM customer LEFT JOIN (SELECT k, arg_max(v, s_suppkey) AS v FROM c WHERE v IS NOT NULL GROUP BY k) ON k = c_nationkey""")
def cached_coordinates(spark, d):
    """A cache with bad numbers and repeated places; some places are not in it."""
    place = [F.lit("Main St").alias("street"), F.lit("Davis").alias("city")]
    lat = F.when(F.col("s_suppkey") % 3 == 0, "n/a").otherwise(F.col("s_acctbal").cast("string"))
    cache = table(spark, d, "supplier").select(*place, (F.col("s_nationkey") + 5).cast("string").alias("zip"), lat.alias("latitude"), (-F.col("s_acctbal")).cast("string").alias("longitude"), F.col("s_suppkey").alias("_ord"))
    rows = table(spark, d, "customer").select("c_custkey", *place, F.col("c_nationkey").cast("string").alias("zip"))
    return relational.with_cached_coordinates(rows, cache).select("c_custkey", "latitude", "longitude")


@query("""SELECT count(*) FILTER (NOT v AND f) AS geocoded, count(*) FILTER (NOT v AND NOT f) AS failed, count(*) FILTER (v) AS skipped,
    round(100.0 * count(*) FILTER (NOT v AND f) / nullif(count(*) FILTER (NOT v), 0), 1) AS pct_found FROM (SELECT c_nationkey * 2 > 40 AS v, c_custkey % 3 > 0 AS f FROM customer)""")
def geocode_outcomes(spark, d):
    lat = F.col("c_nationkey") * 2.0
    return reports.geocode_outcomes(table(spark, d, "customer"), filters.in_box(lat, F.lit(12.0), 40, 48.1, 6, 20), F.col("c_custkey") % 3 > 0)


@query("""SELECT n_name AS state, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name ORDER BY n DESC, min(c_custkey) LIMIT 10""")
def most_common_states(spark, d):
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    return reports.most_common(c.select(F.col("n_name").alias("state"), "c_custkey"), "state", "c_custkey")


@query("""SELECT CAST(count(*) FILTER (o_orderstatus IN ('F', 'P')) AS BIGINT) AS total, count(*) FILTER (o_orderstatus IN ('F', 'P')) >= 2800 AS clustered FROM orders""")
def clustered_layers(spark, d):
    """Slaughterhouses are on, processing plants off, inspections count always."""
    layer = F.when(F.col("o_orderstatus") == "F", "slaughter").when(F.col("o_orderstatus") == "P", "inspections").otherwise("processing")
    return reports.clustered(table(spark, d, "orders").groupBy(layer.alias("layer")).agg(F.count("*").alias("n")), {"slaughter"})


@query("SELECT DISTINCT * FROM customer")
def whole_row_dedup(spark, d):
    c = table(spark, d, "customer")
    return c.unionByName(c).dropDuplicates()


@query(f"""SELECT CASE {LICENCE_SQL} WHEN 'Class A - Breeder' THEN 'Breeder' WHEN 'Class B - Dealer' THEN 'Dealer' WHEN 'Class C - Exhibitor' THEN 'Exhibitor' ELSE 'Other' END AS "Type",
    o_orderstatus AS "Name", CASE WHEN o_custkey % 2 = 0 THEN 'CA' ELSE '' END AS "State", CASE WHEN o_custkey % 3 = 0 THEN '' ELSE 'Davis' END AS "City", CASE WHEN o_custkey % 3 = 0 THEN '' ELSE '95616' END AS "ZIP",
    CASE WHEN o_custkey % 2 = 0 AND o_custkey % 3 = 0 THEN '' WHEN o_custkey % 2 = 0 THEN 'Davis, CA 95616' WHEN o_custkey % 3 = 0 THEN concat(o_custkey, ' Way,') ELSE concat(o_custkey, ' Way, Davis, CA 95616') END AS "Address",
    '1.5' AS "Latitude", '' AS "Longitude", CAST(o_orderkey AS VARCHAR) AS "CertificateNumber" FROM orders""")
def export_inspection_rows(spark, d):
    """Streets and places that are missing leave a comma at either end of the address; the one at the end is followed by a blank and stays."""
    line = F.when(F.col("o_custkey") % 2 == 1, F.concat(F.col("o_custkey").cast("string"), F.lit(" Way")))
    place = F.when(F.col("o_custkey") % 3 != 0, "Davis, CA 95616")
    state = F.when(F.col("o_custkey") % 2 == 0, "CA")
    return table(spark, d, "orders").select(*registers.inspection_row(_licence(), F.col("o_orderstatus"), state, line, place, F.lit("1.5"), F.lit(None), F.col("o_orderkey")))


@query("""SELECT CASE c_custkey % 3 WHEN 0 THEN 'Production Facility' WHEN 1 THEN '[object Object]' ELSE 'facilityTypes.mixedFarm' END AS "Type", c_name AS "Name", CASE c_custkey % 2 WHEN 0 THEN 'California' ELSE '' END AS "State",
    c_mktsegment AS "City", '95616' AS "ZIP", CASE WHEN c_nationkey = 3 THEN '' ELSE concat('1 Way, ', c_mktsegment, CASE c_custkey % 2 WHEN 0 THEN ', California' ELSE '' END, ' 95616') END AS "Address",
    CASE WHEN c_nationkey = 0 THEN '' ELSE c_nationkey || '.0' END AS "Latitude", '-1.5' AS "Longitude", CAST(c_custkey AS VARCHAR) AS "EstablishmentID", '' AS "Phone", 'Beef' AS "AnimalsProcessed", 'N/A' AS "AnimalsSlaughtered" FROM customer""")
def export_facility_rows(spark, d):
    text = F.lit
    rows = table(spark, d, "customer").select(
        _pick(["", "Mixed Farm (Pigs, Hens)", "MIXED FARM"], "c_custkey").alias("type"), F.col("c_name").alias("establishment_name"), _pick(["CA", ""], "c_custkey").alias("state"),
        F.col("c_mktsegment").alias("city"), text("95616").alias("zip"), F.when(F.col("c_nationkey") != 3, " 1 Way").alias("street"), (F.col("c_nationkey") * 1.0).alias("latitude"), text(-1.5).alias("longitude"),
        F.col("c_custkey").alias("establishment_id"), text(None).cast("string").alias("phone"), text("Beef").alias("animals_processed"), text("N/A").alias("animals_slaughtered"),
    )
    return rows.select(*registers.facility_row("breeding", [states.US, states.GERMANY, states.SPAIN, states.FRANCE, states.CANADA, states.MEXICO]))


@query("SELECT page_id, 1 AS n_rows FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT page_id, 2 FROM pages WHERE page_id % 2 = 1")
def wide_table_rows(spark, d):
    """Rows of three cells below two head rows; shorter rows go."""
    row = lambda n, text: "<tr>" + f"<td>{text}</td>" * n + "</tr>"
    page = F.concat(F.coalesce("html", F.lit("")), F.lit("<table>" + row(3, "head") + row(3, "units") + row(3, "a") + row(2, "short")), F.when(F.col("page_id") % 2 == 1, row(3, "b")).otherwise(""), F.lit("</table>"))
    return table(spark, d, "pages").select("page_id", F.size(registers.html_rows(page, 3, 2)).alias("n_rows"))


@query("""SELECT '{"id":' || s_suppkey || ',"name":"' || s_name || '","state":' || CASE WHEN s_suppkey % 2 = 0 THEN 'null' ELSE '"x"' END || '}' AS line FROM supplier""")
def json_response(spark, d):
    """The rows of a response, blanks named as null."""
    shown = F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 2 == 1, "x").alias("state"))
    return table(spark, d, "supplier").select(F.to_json(shown, {"ignoreNullFields": "false"}).alias("line"))
