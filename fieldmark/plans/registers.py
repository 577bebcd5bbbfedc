"""Queries of the national registers' rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import registers
from ..operators import locations
from .adapter import table
from .registry import query


def _pick(values: list[str], n: str):
    """One of the texts by an integer column modulo their number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(n) % len(values) + 1).cast("int"))


def _pick_sql(values: list[str], n: str) -> str:
    quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"list_extract([{quoted}], CAST({n} % {len(values)} + 1 AS INTEGER))"


def _yes(flags: dict) -> F.Column:
    """Names of the flags that are set, in the order of the alphabet."""
    return F.concat_ws(",", *[F.when(flags[n] == "Yes", n) for n in sorted(flags)])


_CODES = "concat(CAST(o_orderkey % 10 AS VARCHAR), substr('ADFKRVX', CAST(o_custkey % 7 + 1 AS INTEGER), 1))"


@query(f"""SELECT o_orderkey, list_extract(['beef_cow', 'market_swine', 'young_chicken', 'young_turkey', 'duck', 'sheep', 'rabbit'], CAST(o_custkey % 7 + 1 AS INTEGER)) || '_slaughter' AS flags
    FROM orders WHERE {_CODES} LIKE '1%' UNION ALL
    SELECT o_orderkey, list_extract(['beef', 'pork', 'chicken', 'turkey', 'duck', 'sheep', 'rabbit'], CAST(o_custkey % 7 + 1 AS INTEGER)) || '_processing' FROM orders WHERE {_CODES} NOT LIKE '1%'""")
def federal_animals(spark, d):
    codes = F.concat((F.col("o_orderkey") % 10).cast("string"), F.substr(F.lit("ADFKRVX"), (F.col("o_custkey") % 7 + 1).cast("int"), F.lit(1)))
    return table(spark, d, "orders").select("o_orderkey", _yes(registers.federal_animals(codes)).alias("flags"))


_DESCRIPTIONS = ["Salle d'abattage", "Ferme pédagogique", "Faisans et PERDRIX", "", "Volailles"]
_FOLDERS = ["Elevages divers", "Abattoirs", "Elevages de Chasse (AUTRES)", "Points reçus", "autre", "Vivier - Personnes aquatiques vivantes ALIM' CONFIANCE"]


@query(f"""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN CASE WHEN b LIKE '%Animal Production%' THEN 'Animal Production; Meat Slaughter' ELSE 'Meat Slaughter' END
    WHEN 1 THEN 'Exhibition' WHEN 2 THEN 'Animal Production; Hunting/Game' ELSE b END AS activity FROM (SELECT p_partkey,
    {_pick_sql(["Animal Production", "Meat Slaughter", "Animal Production; Hunting/Game", "Other", "Animal Production", "Aquatic Production"], "p_size")} AS b FROM part)""")
def french_activity(spark, d):
    return table(spark, d, "part").select("p_partkey", registers.french_activity(_pick(_DESCRIPTIONS, "p_partkey"), _pick(_FOLDERS, "p_size")).alias("activity"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'Meat Processing' ELSE 'Meat Processing; Meat Slaughter' END AS activity,
    CASE p_partkey % 3 WHEN 0 THEN '' ELSE concat_ws(',', CASE WHEN p_size % 2 = 0 THEN 'goat_processing' END, CASE WHEN p_partkey % 3 = 2 AND p_size % 2 = 0 THEN 'goat_slaughter' END,
        CASE WHEN p_size % 2 = 1 THEN 'rabbit_processing' END, CASE WHEN p_partkey % 3 = 2 AND p_size % 2 = 1 THEN 'rabbit_slaughter' END) END AS flags FROM part""")
def german_codes(spark, d):
    codes, species = _pick(["", "CP", "CP SH"], "p_partkey"), _pick(["C", "wL"], "p_size")
    flags = registers.german_animals(codes, species)
    shown = {n: flags[n] for n in ("goat_processing", "goat_slaughter", "rabbit_processing", "rabbit_slaughter")}
    return table(spark, d, "part").select("p_partkey", registers.german_activity(codes).alias("activity"), _yes(shown).alias("flags"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Meat Processing' WHEN 1 THEN 'Meat Slaughter' WHEN 2 THEN 'Meat Processing; Meat Slaughter' ELSE 'Meat Production' END AS activity,
    CASE WHEN p_partkey % 4 IN (1, 2) AND p_size % 3 < 2 THEN CASE p_size % 3 WHEN 0 THEN 'Cattle (Cows, Bulls), Pigs' ELSE 'Chickens' END ELSE 'N/A' END AS animals FROM part""")
def italian_codes(spark, d):
    codes, species = _pick(["CP", "SH", "CP-SH", "x"], "p_partkey"), _pick(["P | B", "C", "-"], "p_size")
    return table(spark, d, "part").select("p_partkey", registers.italian_activity(codes).alias("activity"), registers.italian_animals(codes, species).alias("animals"))


@query("""SELECT c_custkey, concat('CALLE ', c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN ' ' || c_nationkey ELSE '' END, CASE WHEN c_custkey % 3 = 0 THEN ' Int. 7' ELSE '' END) AS address FROM customer""")
def mexican_address(spark, d):
    number, inner = F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey").cast("string")), F.when(F.col("c_custkey") % 3 == 0, " 7 ").otherwise(" ")
    return table(spark, d, "customer").select("c_custkey", registers.mexican_address(F.lit(" CALLE"), F.col("c_mktsegment"), number, F.lit(""), inner, F.lit(None).cast("string")).alias("address"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'beef_cow_slaughter,beef_processing,beef_slaughter,meat_slaughter' WHEN 1 THEN 'chicken_processing,poultry_slaughter,young_chicken_slaughter'
    WHEN 2 THEN 'goat_processing,goat_slaughter,rabbit_processing,rabbit_slaughter' ELSE '' END AS flags FROM part""")
def mexican_animals(spark, d):
    return table(spark, d, "part").select("p_partkey", _yes(registers.mexican_animals(_pick(["Matanza de GANADO", "Avicultura y aves", "conejo, cabra", "acuicultura"], "p_size"))).alias("flags"))


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'RMP - ' || p_brand WHEN 1 THEN p_brand ELSE 'RCP' END AS activity, CASE p_partkey % 2 WHEN 0 THEN 'Yes' ELSE 'No' END AS slaughter,
    CASE p_partkey % 2 WHEN 0 THEN p_type ELSE '' END AS animals_slaughtered_list, p_type AS animals_processed_list FROM part""")
def nz_register(spark, d):
    risk, programme = _pick(["RMP", "", "RCP"], "p_size"), F.when(F.col("p_size") % 3 < 2, F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", registers.nz_activity(risk, programme).alias("activity"), *registers.nz_animals(_pick(["SLAUGHTER of cattle", "Canning"], "p_partkey"), F.col("p_type")))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'BY' WHEN s_suppkey % 3 = 1 THEN 'DE_UNKNOWN' ELSE s_name END AS state FROM supplier""")
def german_states(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", registers.german_state(_pick(["BY 20001", "BYX1", "HE 1"], "s_suppkey"), F.when(F.col("s_suppkey") % 3 == 2, F.col("s_name")).otherwise(" "), F.lit("de")).alias("state"))


@query("""SELECT c_custkey, concat(c_custkey, ' Main St, ', c_mktsegment, ', CA 95616') AS address FROM customer""")
def postal_address(spark, d):
    line = F.concat(F.lit("Po Box 12, "), F.col("c_custkey").cast("string"), F.lit(" Main St room B2"))
    return table(spark, d, "customer").select("c_custkey", registers.postal_address(line, F.concat(F.col("c_mktsegment"), F.lit(", CA 95616"))).alias("address"))


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'Farm & Sons' WHEN 1 THEN 'Ácme' ELSE '(x)' END AS company FROM supplier")
def company_names(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", registers.company_name(_pick(["Farm & Sons, Inc.", "Ácme LLC (west)", "(x)"], "s_suppkey")).alias("company"))


@query("""SELECT 'Lab' AS "Type", c_name AS "Name", 'CA' AS "State", c_mktsegment AS "City", lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') AS "ZIP",
    concat(c_custkey, ' Way  ', c_mktsegment, ', CA ', lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0')) AS "Address" FROM customer""")
def export_lab(spark, d):
    place = F.concat(F.col("c_mktsegment"), F.lit(", CA "), F.lpad((F.col("c_custkey") % 100000).cast("string"), 5, "0"))
    return table(spark, d, "customer").select(*registers.lab_row(F.col("c_name"), F.concat(F.col("c_custkey").cast("string"), F.lit(" Way")), F.lit(None).cast("string"), place))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN concat(c_name, ', Davis, ', c_mktsegment, ' 1') ELSE '' END AS address FROM customer")
def facility_address(spark, d):
    street = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" "), F.col("c_name"))).otherwise(" ")
    return table(spark, d, "customer").select("c_custkey", registers.facility_address(street, F.lit("Davis "), F.col("c_mktsegment"), F.lit("1")).alias("address"))


@query("SELECT l_orderkey, l_partkey, CASE l_returnflag WHEN 'A' THEN 'Vieh (Kühe, Bulls), Schweine' WHEN 'N' THEN CAST(l_linenumber AS VARCHAR) || ' Hund' ELSE 'Yak' END AS animals FROM lineitem")
def translated_lists(spark, d):
    given = F.when(F.col("l_returnflag") == "A", "Cattle (Cows, Bulls), Pigs").when(F.col("l_returnflag") == "N", F.concat(F.col("l_linenumber").cast("string"), F.lit(" Dogs"))).otherwise("Yak")
    words = {"cattle": "Vieh", "cows": "Kühe", "pigs": "Schweine", "dog": "Hund"}
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", registers.translated_list(given, words).alias("animals"))


@query("""SELECT page_id, 3 + page_id % 2 AS n_rows, 5 + page_id % 2 AS n_cells FROM pages""")
def html_tables(spark, d):
    """Each page with a table put behind it: a head, two or three rows, one of them over two lines."""
    more = F.when(F.col("page_id") % 2 == 1, "<tr><td>odd</td></tr>").otherwise("")
    added = F.concat(F.coalesce("html", F.lit("")), F.lit("<table><TR class='h'><th>Id</th></TR><tr>\n<td>"), F.col("page_id").cast("string"), F.lit("</td>\n<td>a\nb</td></tr><tr><td>x</td><td></td></tr>"), more, F.lit("</table>"))
    rows = table(spark, d, "pages").select("page_id", F.explode(registers.html_rows(added)).alias("cells"))
    return rows.groupBy("page_id").agg(F.count("*").alias("n_rows"), F.sum(F.size("cells")).cast("long").alias("n_cells"))


@query("""SELECT s_suppkey, concat('to=', replace(s_name, '#', '%23'), '%20x') AS url FROM supplier""")
def url_parts(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("to="), registers.url_part(F.concat(F.col("s_name"), F.lit(" x")))).alias("url"))


@query("""SELECT 'us' AS country, CAST(p_partkey AS VARCHAR) AS establishment_id, p_name AS establishment_name, CASE p_size % 3 WHEN 0 THEN 'Cattle (Cows, Bulls)' ELSE '' END AS animals_slaughtered,
    CASE p_size % 2 WHEN 0 THEN 'Beef' ELSE 'N/A' END AS animals_processed, 0.0::DOUBLE AS latitude FROM part""")
def shown_locations(spark, d):
    """The common table from a register that lacks most columns, then what is shown of it."""
    yes = lambda k: F.when(F.col("p_size") % k == 0, "Yes")
    own = table(spark, d, "part").select(F.col("p_partkey").alias("establishment_id"), F.col("p_name").alias("establishment_name"), yes(3).alias("steer_slaughter"), yes(2).alias("beef_processing"))
    shown = locations.shown_locations(locations.to_locations(own).withColumn("country", F.lit("us")))
    return shown.select("country", "establishment_id", "establishment_name", "animals_slaughtered", "animals_processed", "latitude")
