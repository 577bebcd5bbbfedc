"""Queries of dictionaries, pages, exports, enrichment and clusters, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import registers
from ..operators import clusters, dictionaries, enrichment, filters
from ..scratch import scratch_dir
from ..sources import exports, pages
from .adapter import markers, table
from .registers import _pick
from .registry import query


def _locales(spark, d):
    """A document for each region, three levels deep, made of its nations."""
    joined = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 5 regions
    names = F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("n_nationkey").cast("string"), "n_name"))))
    documents = joined.groupBy(F.col("r_name").alias("locale")).agg(names.alias("names"), F.count("*").alias("n"))
    tree = F.struct(F.struct(F.col("names").alias("names"), F.struct("n").alias("facts")).alias("nations"), F.lit("Home").alias("home"), F.array(F.lit("a"), F.col("locale")).alias("list"))
    return documents.select("locale", F.to_json(tree).alias("json"))


_KEYS = """keys AS (
    SELECT r_name AS locale, concat('nations.names.', n_nationkey) AS key, n_name AS value FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT r_name, 'nations.facts.n', CAST(count(*) AS VARCHAR) FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name
    UNION ALL SELECT r_name, 'home', 'Home' FROM region UNION ALL SELECT r_name, 'list.0', 'a' FROM region UNION ALL SELECT r_name, 'list.1', r_name FROM region)"""


@query(f"WITH {_KEYS} SELECT locale, key, value FROM keys WHERE locale IN (SELECT r_name FROM nation JOIN region ON n_regionkey = r_regionkey)")
def dotted_keys(spark, d):
    return dictionaries.dotted_keys(_locales(spark, d)).where("leaf").select("locale", "key", "value")


@query(f"""WITH {_KEYS} SELECT c_custkey, coalesce(a.value, e.value, concat('nations.names.', c_nationkey)) AS text, a.value IS NOT NULL OR e.value IS NOT NULL AS known
    FROM customer LEFT JOIN keys a ON a.locale = 'ASIA' AND a.key = concat('nations.names.', c_nationkey) LEFT JOIN keys e ON e.locale = 'EUROPE' AND e.key = concat('nations.names.', c_nationkey)""")
def translated_keys(spark, d):
    """Nations in the words of one region, or else of another; those of the rest show their key."""
    asked = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("nations.names."), F.col("c_nationkey").cast("string")).alias("k"))
    return dictionaries.translated(asked, "k", dictionaries.dotted_keys(_locales(spark, d)), "ASIA", "EUROPE").select("c_custkey", "text", "known")


@query("""SELECT page_id, 0 AS _ord, 'IT ' || page_id AS number, 'A & B' AS name, NULL AS vat FROM pages WHERE page_id % 3 > 0
    UNION ALL SELECT page_id, 1, CAST(page_id AS VARCHAR), NULL, NULL FROM pages WHERE page_id % 3 = 2""")
def page_registers(spark, d):
    """Behind each page a menu and a register, whose header stands below another row; a third of the pages has none."""
    row = lambda *cells: F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td class=x>"), c, F.lit("</td>\n")) for c in cells], F.lit("</tr>"))
    key = F.col("page_id").cast("string")
    body = F.concat(row(F.concat(F.lit("IT <b>"), key, F.lit("</b>")), F.lit("A &amp; B")), F.when(F.col("page_id") % 3 == 2, row(key)).otherwise(""))
    register = F.concat(F.lit("<TABLE>"), row(F.lit("List")), row(F.lit(" number "), F.lit("name"), F.lit("Approval NUMBER")), body, F.lit("</TABLE><table>"), row(F.lit("approval number")), row(F.lit("z")), F.lit("</table>"))
    html = F.concat(F.coalesce("html", F.lit("")), F.lit("<table><tr><td>menu</td></tr></table>"), F.when(F.col("page_id") % 3 > 0, register).otherwise(""))
    found = pages.marked_rows(table(spark, d, "pages").select("page_id", html.alias("html")), "page_id", "APPROVAL NUMBER", ["number", "name", "vat"])
    return found.withColumn("vat", F.col("vat").cast("int"))


@query("""SELECT CASE WHEN c_custkey % 3 = 0 THEN concat('"', c_name, ', ', repeat('"', 2), c_mktsegment, repeat('"', 3), ',', CASE WHEN c_nationkey % 2 = 0 THEN CAST(c_nationkey // 2 AS VARCHAR) ELSE concat(c_nationkey // 2, '.5') END, ',')
    WHEN c_custkey % 3 = 1 THEN concat(' ', c_name, ' ,', CASE WHEN c_nationkey % 2 = 0 THEN CAST(c_nationkey // 2 AS VARCHAR) ELSE concat(c_nationkey // 2, '.5') END, ',')
    ELSE concat(',', CASE WHEN c_nationkey % 2 = 0 THEN CAST(c_nationkey // 2 AS VARCHAR) ELSE concat(c_nationkey // 2, '.5') END, ',') END AS line FROM customer
    UNION ALL SELECT concat(s_name, ',,', s_suppkey) FROM supplier UNION ALL SELECT 'Name,Latitude,Size'""")
def client_export(spark, d):
    """Facilities and laboratories of differing columns under one header, with quotes, blanks and whole numbers."""
    named = F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"'))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit(" "), "c_name", F.lit(" ")))
    first = table(spark, d, "customer").select(named.alias("Name"), (F.col("c_nationkey") / 2.0).alias("Latitude"), F.col("c_custkey").alias("_ord"))
    labs = table(spark, d, "supplier").select(F.col("s_name").alias("Name"), F.col("s_suppkey").alias("Size"), F.col("s_suppkey").alias("_ord"))
    return exports.client_lines([first, labs], [["_ord"], ["_ord"]]).select("line")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 45.0 WHEN c_nationkey % 5 = 1 THEN 41.5 ELSE 0.0 END AS latitude,
    CASE WHEN c_custkey % 4 = 0 OR c_custkey % 4 = 1 THEN 'skipped' WHEN c_nationkey % 5 = 1 THEN 'geocoded' ELSE 'failed' END AS outcome FROM customer WHERE c_custkey % 4 <> 1
    UNION ALL SELECT c_custkey, 0.0, 'skipped' FROM customer WHERE c_custkey % 4 = 1""")
def enriched_places(spark, d):
    """Places in the box, without an address, and others, of which some are answered, some outside the box and some not."""
    here = F.col("c_custkey") % 4
    rows = table(spark, d, "customer").select("c_custkey", F.when(here == 1, " ").otherwise(F.concat(F.lit("Town "), F.col("c_nationkey").cast("string"))).alias("place"), F.when(here == 0, 45.0).otherwise(0.0).alias("latitude"), F.when(here == 0, 9.0).otherwise(0.0).alias("longitude"))
    known = table(spark, d, "nation").select(F.concat(F.lit("Town "), F.col("n_nationkey").cast("string")).alias("address"), F.when(F.col("n_nationkey") % 5 == 1, 41.5).otherwise(10.0).alias("latitude"), F.lit(12.5).alias("longitude")).where("n_nationkey % 5 < 3")
    ask = lambda addresses: addresses.join(known, "address")
    inside = lambda lat, lng: filters.in_box(lat, lng, 40, 48, 6, 20)
    return enrichment.with_coordinates(rows, F.col("place"), ask, inside, scratch_dir(spark, "answers")).select("c_custkey", "latitude", "outcome")


@query("""SELECT s_suppkey, list_extract(['A', 'B', 'C', 'R', 'T', 'H', NULL], CAST(s_suppkey % 7 + 1 AS INTEGER)) AS label FROM supplier""")
def registration_labels(spark, d):
    given = _pick(["Class A - Breeder", "Class B - Dealer and Class C", "Class C", "old Class R", "Class T", "Class H", "class a"], "s_suppkey")
    return table(spark, d, "supplier").select("s_suppkey", registers.registration_label(given).alias("label"))


@query()
def marker_clusters(spark, d):
    """Clusters at two zooms; no SQL says what depends on the markers before, the tests hold it against taking one after the other."""
    rows = markers(spark, d).where("lat <> 0 and lng <> 0").withColumn("_ord", F.col("id"))
    return clusters.marker_clusters(rows, [3, 2], off=4)
