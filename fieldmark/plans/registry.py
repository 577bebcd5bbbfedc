"""Names, queries and SQL of everything that the library registers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import animals, classify, columns, registers, states
from ..operators import filters, relational, reports
from .adapter import FACILITIES, MARKERS, facilities, markers, table

Query = Callable[[SparkSession, str], DataFrame]
_FOUND: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def register(f: Query) -> Query:
        _FOUND[f.__name__] = f, sql
        return f

    return register


def queries() -> dict[str, Query]:
    return {n: f for n, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for n, (_, s) in _FOUND.items() if s}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Classify typed facilities, filter by text, count by state and category."""
    part = table(spark, d, "part").select(F.concat_ws(" ", "p_type", "p_name").alias("type"), F.col("p_brand").alias("state"), F.col("p_name").alias("name"))
    kinds = part.select("state", "name", *classify.facility_type(F.col("type")))
    return kinds.where(filters.text_match("facility", [F.col("name"), F.col("label_key")], [])).groupBy("state", "category").count().orderBy("state", "category")


# Filters ----------------------------------------------------------------------------------------


@query(f"WITH {FACILITIES} SELECT id, name, state FROM fac WHERE country = 'EUROPE'")
def filter_country(spark, d):
    return filters.in_country(facilities(spark, d), "EUROPE").select("id", "name", "state")


_STATES = ["CA", "TX", "BY", "DE_UNKNOWN", "Sevilla", "Catalunya", "13", "971", "QC", "Sonora", "NUEVO LEÓN", "nuevo leon", "London", " ", ""]
_STATE_SQL = "CASE c_custkey % 15 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_STATES)) + " END"
_TAG_SQL = "CASE c_nationkey % 4 WHEN 0 THEN 'fr' WHEN 1 THEN 'mx' WHEN 2 THEN 'dk' ELSE 'us' END"


@query(f"""WITH c AS (SELECT {_STATE_SQL} AS state, {_TAG_SQL} AS tag FROM customer) SELECT state,
    count(*) FILTER (state IN ('CA', 'TX')) AS us, count(*) FILTER (state IN ('BY', 'DE_UNKNOWN')) AS de, count(*) FILTER (state IN ('Sevilla', 'Catalunya')) AS es,
    count(*) FILTER (tag = 'fr' OR state IN ('13', '971')) AS fr, count(*) FILTER (tag = 'mx' OR state IN ('Sonora', 'NUEVO LEÓN')) AS mx, count(*) FILTER (state = 'QC') AS ca,
    count(*) FILTER (tag = 'dk') AS dk, count(*) FILTER (state IN ('Sonora', 'nuevo leon', 'London')) AS uk, count(*) AS everything FROM c GROUP BY state""")
def country_predicate(spark, d):
    named = F.element_at(F.array(*[F.lit(s) for s in _STATES]), (F.col("c_custkey") % 15 + 1).cast("int"))
    tag = F.element_at(F.array(*[F.lit(x) for x in ("fr", "mx", "dk", "us")]), (F.col("c_nationkey") % 4 + 1).cast("int"))
    rows = table(spark, d, "customer").select(named.alias("state"), tag.alias("country"))
    m = lambda c: F.count_if(filters.country_match(c, F.col("state"), F.col("country"), states.REGIONS, states.TAGGED)).alias("everything" if c == "all" else c.lower())
    return rows.groupBy("state").agg(*[m(c) for c in ("US", "DE", "ES", "FR", "MX", "CA", "DK", "UK", "all")])


@query(f"""SELECT c_custkey, CASE c_custkey % 15 WHEN 0 THEN 'California' WHEN 1 THEN 'Texas' WHEN 2 THEN 'Bayern' WHEN 3 THEN 'Deutschland (Unspecified)' WHEN 4 THEN 'Sevilla' WHEN 5 THEN 'Cataluña'
    WHEN 6 THEN 'Bouches-du-Rhône' WHEN 7 THEN 'Guadeloupe' WHEN 8 THEN 'Quebec' WHEN 10 THEN 'Nuevo León' WHEN 13 THEN '' ELSE {_STATE_SQL} END AS shown FROM customer""")
def state_names(spark, d):
    named = F.element_at(F.array(*[F.lit(s) for s in _STATES]), (F.col("c_custkey") % 15 + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", registers.display_state(named, [states.US, states.GERMANY, states.SPAIN, states.FRANCE, states.CANADA, states.MEXICO]).alias("shown"))


@query(f"WITH {FACILITIES} SELECT count(*) FILTER (state = 'FRANCE') AS plain, count(*) AS fr, count(*) FILTER (country = 'ASIA') AS dk FROM fac")
def state_predicate(spark, d):
    m = lambda c, s: F.count_if(filters.state_match(c, s, F.col("state"), F.col("country")))
    return facilities(spark, d).agg(m("US", "FRANCE").alias("plain"), m("FR", "FRANCE").alias("fr"), m("DK", "ASIA").alias("dk"))


_ANIMALS_SQL = "CASE p_size % 4 WHEN 0 THEN 'Cattle (Cows, Bulls), Pigs' WHEN 1 THEN 'CATTLE' WHEN 2 THEN 'cow bells' END"


@query(f"SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'cow') OR contains(lower({_ANIMALS_SQL}), 'cattle') OR contains(lower(concat(p_brand, CASE WHEN p_partkey % 9 = 0 THEN ' Cow Lane' ELSE '' END)), 'cow')")
def text_search(spark, d):
    given = F.when(F.col("p_size") % 4 == 0, "Cattle (Cows, Bulls), Pigs").when(F.col("p_size") % 4 == 1, "CATTLE").when(F.col("p_size") % 4 == 2, "cow bells")
    place = F.concat("p_brand", F.when(F.col("p_partkey") % 9 == 0, " Cow Lane").otherwise(""))
    return table(spark, d, "part").where(filters.text_match(" Cow", [F.col("p_name"), place], [given])).select("p_partkey", "p_name")


@query(f"WITH {FACILITIES} SELECT id, name FROM fac WHERE contains(lower(name), 'supplier#00') OR contains(lower(type), 'supplier#00')")
def lab_search(spark, d):
    return facilities(spark, d).where(filters.lab_match("supplier#00", F.col("name"), F.col("type"))).select("id", "name")


@query("SELECT count(*) AS n, count(*) FILTER (contains(lower(c_name), '7') OR contains(lower(c_mktsegment), '7')) AS named, count(*) FILTER (contains(lower(c_mktsegment), 'build')) AS segment FROM customer")
def reverse_containment(spark, d):
    """A term inside one of the laboratory phrases shows all; another one only rows that hold it."""
    m = lambda term: F.count_if(filters.lab_match(term, F.col("c_name"), F.col("c_mktsegment")))
    return table(spark, d, "customer").agg(m("search lab").alias("n"), m("7").alias("named"), m("build").alias("segment"))


LICENCE_SQL = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Class A - Breeder' WHEN '2' THEN 'Class B - Dealer' WHEN '3' THEN 'Class C - Exhibitor' ELSE 'Other' END"


def _licence():
    first = F.substring("o_orderpriority", 1, 1)
    return F.when(first == "1", "Class A - Breeder").when(first == "2", "Class B - Dealer").when(first == "3", "Class C - Exhibitor").otherwise("Other")


@query(f"SELECT {LICENCE_SQL} AS licence, count(*) AS n FROM orders WHERE {LICENCE_SQL} IN ('Class A - Breeder', 'Class C - Exhibitor') GROUP BY 1")
def licence_layers(spark, d):
    o = table(spark, d, "orders").withColumn("licence", _licence())
    return o.where(filters.inspection_match("", F.col("o_orderstatus"), F.col("licence"), ["breeder", "exhibitor"])).groupBy("licence").agg(F.count("*").alias("n"))


@query(f"SELECT o_orderkey FROM orders WHERE {LICENCE_SQL} = 'Class A - Breeder'")
def inspection_search(spark, d):
    o = table(spark, d, "orders").withColumn("licence", _licence())
    return o.where(filters.inspection_match("breed", F.col("o_orderstatus"), F.col("licence"), ["breeder", "dealer"])).select("o_orderkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'")
def active_status(spark, d):
    return table(spark, d, "orders").where(F.col("o_orderstatus") == "F").select("o_orderkey", "o_custkey")


@query("SELECT p_partkey, CASE p_size WHEN 1 THEN 'Farm' WHEN 7 THEN 'Slaughterhouse' ELSE 'Laboratory' END AS kind FROM part WHERE p_size IN (1, 7, 15)")
def code_membership(spark, d):
    codes = spark.createDataFrame([(1, "Farm"), (7, "Slaughterhouse"), (15, "Laboratory")], "p_size int, kind string")
    return table(spark, d, "part").join(F.broadcast(codes), "p_size").select("p_partkey", "kind")


@query(f"WITH {MARKERS} SELECT id, CASE WHEN lat <> 0 AND lng <> 0 THEN lat END AS lat, CASE WHEN lat <> 0 AND lng <> 0 THEN lng END AS lng FROM mk")
def coord_valid(spark, d):
    return markers(spark, d).select("id", *columns.valid_coordinates(F.col("lat"), F.col("lng")))


@query(f"WITH {MARKERS} SELECT id FROM mk WHERE lat > 40 AND lat < 48 AND lng > 6 AND lng < 20")
def bbox(spark, d):
    return markers(spark, d).where(filters.in_box(F.col("lat"), F.col("lng"), 40, 48, 6, 20)).select("id")


@query("SELECT DISTINCT p_type FROM part WHERE trim(p_type) <> '' AND lower(p_type) NOT IN ('n/a', 'unknown')")
def meaningful_values(spark, d):
    return table(spark, d, "part").where(filters.meaningful(F.col("p_type"))).select("p_type").distinct()


# Animal lists -----------------------------------------------------------------------------------


FLAGS_SQL = {"beef": "l_returnflag = 'A'", "pork": "l_returnflag = 'N'", "goat": "l_linestatus = 'O'", "chicken": "l_discount > 0.05", "ratite": "l_tax > 0.04"}


def _flags(spark, d):
    l = table(spark, d, "lineitem")
    tests = {"beef": F.col("l_returnflag") == "A", "pork": F.col("l_returnflag") == "N", "goat": F.col("l_linestatus") == "O", "chicken": F.col("l_discount") > 0.05, "ratite": F.col("l_tax") > 0.04}
    return l, lambda name: F.when(tests[name], "Yes").otherwise("No") if name in tests else F.lit("No")


@query("""SELECT l_orderkey, l_partkey, coalesce(nullif(concat_ws(', ', CASE WHEN l_returnflag = 'A' THEN 'Beef' END, CASE WHEN l_returnflag = 'N' THEN 'Pork' END, CASE WHEN l_linestatus = 'O' THEN 'Goat' END,
    CASE WHEN l_discount > 0.05 THEN 'Chicken' END, CASE WHEN l_tax > 0.04 THEN 'Ratite (Ostrich/Emu)' END), ''), 'N/A') AS processed FROM lineitem""")
def flags_to_list_na(spark, d):
    l, flag = _flags(spark, d)
    return l.select("l_orderkey", "l_partkey", animals.processed(F.lit(""), flag).alias("processed"))


@query("""SELECT l_orderkey, l_partkey, concat_ws(', ', CASE WHEN l_returnflag = 'A' OR l_linestatus = 'O' THEN 'Cattle (Cows, Bulls)' END, CASE WHEN l_returnflag = 'N' THEN 'Pigs' END,
    CASE WHEN l_discount > 0.05 THEN 'Chickens' END) AS slaughtered FROM lineitem""")
def flag_groups_to_list(spark, d):
    l, flag = _flags(spark, d)
    names = {"beef_cow": "beef", "steer": "goat", "sow": "pork", "capon": "chicken"}
    return l.select("l_orderkey", "l_partkey", animals.slaughtered(F.lit(""), lambda n: flag(names.get(n, ""))).alias("slaughtered"))


@query("""SELECT l_orderkey, l_partkey, coalesce(nullif(concat_ws(', ', CASE WHEN l_quantity > 0 THEN concat(CAST(floor(CAST(l_quantity AS FLOAT)) AS INTEGER), ' Dogs') END,
    CASE WHEN l_discount > 0 THEN concat(CAST(floor(CAST(l_discount * 10 AS FLOAT)) AS INTEGER), ' Cats') END), ''), 'Unknown') AS tested FROM lineitem""")
def counts_to_text(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", animals.tested([(F.col("l_quantity").cast("string"), "Dogs"), ((F.col("l_discount") * 10).cast("string"), "Cats"), (F.lit("5f"), "Pigs")]).alias("tested"))


# Classification ---------------------------------------------------------------------------------

#: A type for each rule, its key and its category, by hand; the SQL knows nothing of the rules' table.
_EXPECTED = [
    ("Mixed Farm (Goats)", "mixedFarm", "breeder"), ("MIXED SLAUGHTERHOUSE (Pig)", "mixedSlaughterhouse", "slaughter"), ("Meat Processing; Meat Slaughter", "slaughterhouse", "slaughter"),
    ("Aquatic Processing", "aquaticProcessingFacility", "slaughter"), ("Aquatic Production", "aquaticProductionFacility", "breeder"), ("Farm / Breeder", "farm", "breeder"), ("Butcher", "butcher", "slaughter"),
    ("Duck Farm", "duckFarm", "breeder"), ("Exhibition", "exhibitionFacility", "exhibitor"), ("Fishing Operation", "processing", "processing"), ("Pheasant Farm", "pheasantFarm", "breeder"),
    ("Quail farm", "quailFarm", "breeder"), ("Farm of ostrich", "ostrichFarm", "breeder"), ("Emu farm", "emuFarm", "breeder"), ("Bison Farm", "bisonFarm", "breeder"), ("buffalo farm", "buffaloFarm", "breeder"),
    ("elk farm", "elkFarm", "breeder"), ("Goose Farm", "gooseFarm", "breeder"), ("Dairy Farm", "dairyFarm", "breeder"), ("Intensive Sow Pig Farm", "intensiveSowPigFarm", "breeder"),
    ("Intensive Poultry Farm", "intensivePoultryFarm", "breeder"), ("Finishing Unit", "finishingUnit", "breeder"), ("Cattle Slaughterhouse", "cattleSlaughterhouse", "slaughter"),
    ("Sheep & Lamb Slaughterhouse", "sheepLambSlaughterhouse", "slaughter"), ("Other Mammal Slaughterhouse", "otherMammalSlaughterhouse", "slaughter"), ("Wild Rabbit Slaughterhouse", "wildRabbitSlaughterhouse", "slaughter"),
    ("Pig Breeding Farm", "pigBreedingFarm", "breeder"), ("Pig Farm", "pigFarm", "breeder"), ("Aquaculture", "aquacultureFacility", "breeder"), ("Intensive fruit farm", "intensiveFarm", "breeder"),
    ("Animal Production - Game", "gameHuntingFacility", "breeder"), ("Animal Production", "animalFarm", "breeder"), ("Chicken Producer", "chickenProducer", "breeder"), ("Farm with slaughter", "slaughterhouse", "slaughter"),
    ("", "processing", "processing"), ("Horse Slaughterhouse", "horseSlaughterhouse", "slaughter"), ("Intensive Pig Farm", "intensivePigFarm", "breeder"), ("Large Bird Slaughterhouse", "largeBirdSlaughterhouse", "slaughter"),
    ("beef and sheep farm", "beefFarm", "breeder"), ("rabbit farm", "rabbitFarm", "breeder"),
    ("Pig Slaughterhouse", "pigSlaughterhouse", "slaughter"), ("Poultry Slaughterhouse", "poultrySlaughterhouse", "slaughter"), ("Goat Slaughterhouse", "goatSlaughterhouse", "slaughter"),
    ("Wild Bird Slaughterhouse", "wildBirdSlaughterhouse", "slaughter"), ("Farm of horses", "horseFarm", "breeder"), ("deer farm", "deerFarm", "breeder"), ("Turkey Farm", "turkeyFarm", "breeder"),
    ("lamb farm", "lambFarm", "breeder"), ("Sheep farm", "sheepFarm", "breeder"), ("goat farm", "goatFarm", "breeder"), ("cattle farm", "cattleFarm", "breeder"), ("chicken farm", "chickenFarm", "breeder"),
    ("Animal Production; Hunting", "gameHuntingFacility", "breeder"), ("Farm for dairy", "dairyFarm", "breeder"), ("Farm for pigs", "pigFarm", "breeder"), ("Farm for poultry", "poultryFarm", "breeder"),
    ("Poultry Farm", "poultryFarm", "breeder"), ("Unknown (Zoo)", "processing", "processing"),
]


def _typed(spark, d):
    text = F.element_at(F.array(*[F.lit(t) for t, _, _ in _EXPECTED]), (F.col("p_partkey") % len(_EXPECTED) + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", text.alias("type"))


_KINDS = f"kinds AS (SELECT p_partkey, 'facilityTypes.' || e.label AS label_key, e.category FROM part JOIN (VALUES {', '.join(f'({i}, {k!r}, {g!r})' for i, (_, k, g) in enumerate(_EXPECTED))}) e(i, label, category) ON p_partkey % {len(_EXPECTED)} = e.i)"


@query(f"WITH {_KINDS} SELECT p_partkey, label_key, category FROM kinds")
def classify_rules(spark, d):
    key, _, category, _ = classify.facility_type(F.col("type"))
    return _typed(spark, d).select("p_partkey", key, category)


@query("""SELECT p_partkey, list_extract(['', ' (pigs, goats)', ' (goats)', '', ''], CAST(p_partkey % 5 + 1 AS INTEGER)) AS label_suffix FROM part""")
def label_suffixes(spark, d):
    """What stands in the parentheses of mixed farms and slaughterhouses, in small letters."""
    given = F.element_at(F.array(*[F.lit(t) for t in ("Goat Farm (old)", "Mixed Slaughterhouse (Pigs, Goats)", "MIXED FARM (Goats)", "Mixed Farm", "Butcher (Mixed)")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", classify.facility_type(given)[1])


@query(f"WITH {_KINDS} SELECT category, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM kinds GROUP BY category")
def category_counts(spark, d):
    _, _, category, _ = classify.facility_type(F.col("type"))
    counts = _typed(spark, d).select(category).groupBy("category").agg(F.count("*").alias("n"))
    return counts.withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0))))  # a row per category, four at most


@query(f"""WITH {_KINDS}, c AS (SELECT category, count(*) AS n FROM kinds GROUP BY category UNION ALL SELECT 'labs', count(*) FROM supplier WHERE s_suppkey < 0 UNION ALL SELECT 'inspections', count(*) FROM orders),
    l AS (SELECT * FROM c JOIN (VALUES ('slaughter', 'Slaughterhouses', 0), ('breeder', 'Production Facilities', 2), ('inspections', 'Other Locations', 5)) v(layer, label, place) ON category = layer AND n > 0)
    SELECT layer, label, n, CAST(sum(n) OVER () AS BIGINT) AS total, place FROM l""")
def layer_counts(spark, d):
    _, _, category, _ = classify.facility_type(F.col("type"))
    kinds = _typed(spark, d).select(category).groupBy(F.col("category").alias("layer")).agg(F.count("*").alias("n"))
    others = [table(spark, d, t).agg(F.lit(name).alias("layer"), F.count_if(test).alias("n")) for t, name, test in (("supplier", "labs", F.col("s_suppkey") < 0), ("orders", "inspections", F.lit(True)))]
    return reports.layer_counts(kinds.union(others[0]).union(others[1]), {"slaughter", "breeder", "labs"})


@query("""SELECT o_orderkey, CASE WHEN regexp_extract(c, '^.*([1234678])', 1) <> '' THEN CASE regexp_extract(c, '^.*([1234678])', 1) WHEN '1' THEN 'Slaughter' WHEN '2' THEN 'Canning' WHEN '3' THEN 'Boning and Cutting' WHEN '4' THEN 'Rendering'
    WHEN '6' THEN 'Processing' WHEN '7' THEN 'Packaging' ELSE 'Inedible Rendering' END WHEN regexp_extract(c, '[059]') <> '' THEN concat('Type ', regexp_extract(c, '[059]')) ELSE 'Unknown' END AS function_type
    FROM (SELECT o_orderkey, upper(concat(CAST(o_orderkey % 1000 AS VARCHAR), 'a/US ', substr(o_orderpriority, 1, 1))) AS c FROM orders)""")
def function_codes(spark, d):
    codes = F.concat((F.col("o_orderkey") % 1000).cast("string"), F.lit("a/US "), F.substring("o_orderpriority", 1, 1))
    return table(spark, d, "orders").select("o_orderkey", classify.function_type(codes).alias("function_type"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Dairy Farm' WHEN 1 THEN 'Mixed Slaughterhouse (Cattle Slaughterhouse, Pig Slaughterhouse)' WHEN 2 THEN 'Unknown (Zoo)' ELSE 'Unknown Facility' END AS kind FROM part""")
def mixed_type(spark, d):
    names = {"CowSlaughterhouse": "Cattle Slaughterhouse", "PigSlaughterhouse": "Pig Slaughterhouse", "DairyFarm": "Dairy Farm"}
    given = F.element_at(F.array(*[F.lit(x) for x in ("CowSlaughterhouse,DairyFarm", "CowSlaughterhouse,PigSlaughterhouse", "Zoo", "")]), F.col("p_size") % 4 + 1)
    return table(spark, d, "part").select("p_partkey", classify.primary_type(given, names).alias("kind"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'Aquaculture' WHEN 1 THEN 'Slaughterhouse' ELSE 'Processing' END AS kind FROM part")
def keyword_types(spark, d):
    given = F.element_at(F.array(F.lit("Piscicultura y otra"), F.lit("Matanza de ganado"), F.lit("Comercio")), F.col("p_size") % 3 + 1)
    return table(spark, d, "part").select("p_partkey", classify.keyword_type(given, classify.MEXICAN_TYPES, "Processing").alias("kind"))


_CLASSES = ["CowSlaughterhouse, DairyFarm", "PigSlaughterhouse", "IntensivePoultryFarm,IntensivePigFarm", "GoatSlaughterhouse,PoultrySlaughterhouse", "Zoo", None, "SheepAndLambSlaughterhouse, OtherMammalSlaughterhouse", "FinishingUnit"]


@query("""SELECT p_partkey, k IN (0) AS cow_slaughter, k IN (1) AS pig_slaughter, k IN (6) AS sheep_lamb_slaughter, k IN (3) AS goat_slaughter, k IN (3) AS poultry_slaughter, k IN (6) AS other_mammal_slaughter, k IN (0) AS dairy_farm,
    k IN (2) AS intensive_pig_farm, k IN (2) AS intensive_poultry_farm, CASE WHEN k = 0 THEN 'Meat Slaughter; Animal Production' WHEN k IN (1, 3, 6) THEN 'Meat Slaughter' WHEN k = 2 THEN 'Animal Production' ELSE 'Unknown' END AS activities,
    CASE k WHEN 0 THEN 'Dairy Farm' WHEN 1 THEN 'Pig Slaughterhouse' WHEN 2 THEN 'Mixed Farm (Intensive Poultry Farm, Intensive Pig Farm)' WHEN 3 THEN 'Mixed Slaughterhouse (Goat Slaughterhouse, Poultry Slaughterhouse)' WHEN 4 THEN 'Unknown (Zoo)'
    WHEN 5 THEN 'Unknown Facility' WHEN 6 THEN 'Mixed Slaughterhouse (Sheep & Lamb Slaughterhouse, Other Mammal Slaughterhouse)' ELSE 'Finishing Unit' END AS kind FROM (SELECT p_partkey, p_partkey % 8 AS k FROM part)""")
def british_classifications(spark, d):
    given = F.element_at(F.array(*[F.lit(c) for c in _CLASSES]), (F.col("p_partkey") % 8 + 1).cast("int"))
    flags = classify.classification_flags(given, classify.BRITISH_FLAGS)
    return table(spark, d, "part").select("p_partkey", *[c.alias(n) for n, c in flags.items()], classify.british_activities(given).alias("activities"), classify.primary_type(given, classify.BRITISH_TYPES).alias("kind"))


@query("""SELECT p_partkey, k IN (0, 1) AS intensive_pig_farm, false AS intensive_pig_breeding_farm, k IN (2) AS intensive_poultry_farm, k IN (2, 3) AS aquaculture,
    CASE k WHEN 0 THEN 'Animal Production' WHEN 1 THEN 'Animal Production' WHEN 2 THEN 'Animal Production; Aquaculture' WHEN 3 THEN 'Aquaculture' ELSE 'Unknown' END AS activities FROM (SELECT p_partkey, p_partkey % 5 AS k FROM part)""")
def spanish_classifications(spark, d):
    """The sow farms' name contains the pig farms' name, which so always comes first."""
    given = F.element_at(F.array(*[F.lit(c) for c in ("GranjaPorcinaIntensiva", "GranjaPorcinaIntensivaDeCerdas", "GranjaAvícolaIntensiva, Acuicultura", "Acuicultura", "")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    flags = classify.classification_flags(given, classify.SPANISH_FLAGS)
    return table(spark, d, "part").select("p_partkey", *[c.alias(n) for n, c in flags.items()], classify.spanish_activities(given).alias("activities"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Meat Processing; Meat Slaughter' WHEN 1 THEN 'Meat Processing; Meat Slaughter' ELSE 'Meat Processing' END AS activities FROM part WHERE p_partkey % 5 < 3")
def danish_activities(spark, d):
    industries = ["Slagterier", "Fremstilling af animalske produkter - Kød", "Fremstilling af animalske produkter - Æg", "Bager", ""]
    given = F.element_at(F.array(*[F.lit(c) for c in industries]), (F.col("p_partkey") % 5 + 1).cast("int"))
    rows = table(spark, d, "part").select("p_partkey", given.alias("industry")).where(classify.danish_industry(F.col("industry")))
    return rows.select("p_partkey", classify.danish_activities(F.col("industry")).alias("activities"))


# Aggregates -------------------------------------------------------------------------------------


@query("SELECT p_type, count(*) AS n FROM part GROUP BY p_type")
def type_counts(spark, d):
    return table(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("n"))


@query("SELECT lang, source, count(*) AS n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY lang, source")
def pair_counts(spark, d):
    return table(spark, d, "documents").dropna(subset=["lang", "source"]).groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT event_type FROM events")
def distinct_values(spark, d):
    return table(spark, d, "events").select("event_type").distinct()


@query("SELECT p_size, count(DISTINCT p_brand) AS n, min(p_brand) AS one FROM part GROUP BY p_size")
def code_name_sets(spark, d):
    names = F.array_sort(F.collect_set("p_brand"))
    return table(spark, d, "part").groupBy("p_size").agg(names.alias("names")).select("p_size", F.size("names").cast("long").alias("n"), F.get("names", F.lit(0)).alias("one"))


@query(f"""WITH {MARKERS} SELECT count(*) AS total, count(*) FILTER (lat <> 0 AND lng <> 0) AS n_coords, round(100.0 * count(*) FILTER (lat <> 0 AND lng <> 0) / count(*), 1) AS pct_coords,
    count(*) FILTER (lat > 0) AS n_north, round(100.0 * count(*) FILTER (lat > 0) / count(*), 1) AS pct_north FROM mk""")
def coverage_report(spark, d):
    return reports.coverage(markers(spark, d), {"coords": (F.col("lat") != 0) & (F.col("lng") != 0), "north": F.col("lat") > 0})


@query(f"WITH {FACILITIES} SELECT state, count(*) AS n FROM fac GROUP BY state ORDER BY n DESC, state LIMIT 10")
def top10_states(spark, d):
    return facilities(spark, d).groupBy("state").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "state").limit(10)


@query("SELECT count(*) AS before, count(*) FILTER (o_orderstatus = 'F') AS after, round(100.0 * (count(*) - count(*) FILTER (o_orderstatus = 'F')) / count(*), 1) AS pct_removed FROM orders")
def version_diff(spark, d):
    after = F.count_if(F.col("o_orderstatus") == "F")
    return table(spark, d, "orders").agg(F.count("*").alias("before"), after.alias("after"), F.round(100.0 * (F.count("*") - after) / F.count("*"), 1).alias("pct_removed"))


@query("SELECT p_size, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM part GROUP BY p_size")
def histogram_share(spark, d):
    counts = table(spark, d, "part").groupBy("p_size").agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 2))  # a row per size


@query("SELECT count(*) AS n FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer)")
def distinct_pairs(spark, d):
    return table(spark, d, "customer").agg(F.countDistinct("c_nationkey", "c_mktsegment").alias("n"))


@query(f"WITH {FACILITIES} SELECT country, bool_or(state = 'FRANCE') AS has_france FROM fac GROUP BY country")
def existence(spark, d):
    return facilities(spark, d).groupBy("country").agg(F.bool_or(F.col("state") == "FRANCE").alias("has_france"))


@query(f"WITH {MARKERS} SELECT min(lat) - 0.1 * (max(lat) - min(lat)) AS south, max(lat) + 0.1 * (max(lat) - min(lat)) AS north, min(lng) - 0.1 * (max(lng) - min(lng)) AS west, max(lng) + 0.1 * (max(lng) - min(lng)) AS east FROM mk WHERE lat <> 0 AND lng <> 0")
def bounds(spark, d):
    return reports.padded_bounds(markers(spark, d).where("lat <> 0 and lng <> 0"))


@query(f"""WITH {MARKERS} SELECT CAST(floor((lng + 180) / 360 * 4096 / 50) AS BIGINT) AS cx, CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 4096 / 50) AS BIGINT) AS cy, count(*) AS n, round(avg(lat), 6) AS lat, round(avg(lng), 6) AS lng
    FROM mk WHERE abs(lat) < 85 GROUP BY 1, 2""")
def grid_cluster(spark, d):
    return reports.grid_clusters(markers(spark, d).where("abs(lat) < 85"), 4)


@query("SELECT count(*) AS total, count(*) >= 2800 AS clustered FROM customer")
def cluster_switch(spark, d):
    return table(spark, d, "customer").agg(F.count("*").alias("total"), (F.count("*") >= 2800).alias("clustered"))


# Joins ------------------------------------------------------------------------------------------


@query("""SELECT a.doc_id, a.lang AS lang_x, b.lang AS lang_y FROM (SELECT doc_id, lang FROM documents) a LEFT JOIN (SELECT l.doc_id, CASE WHEN l.quality = 1 THEN 'good' ELSE 'bad' END AS lang FROM labels l) b ON a.doc_id IS NOT DISTINCT FROM b.doc_id""")
def left_join_suffix(spark, d):
    right = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("lang"))
    return relational.suffixed_left_join(table(spark, d, "documents").select("doc_id", "lang"), right, "doc_id")


@query("SELECT d.doc_id, coalesce(CASE l.quality WHEN 1 THEN 'good' WHEN 0 THEN 'bad' END, d.source) AS source FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def lookup_update(spark, d):
    updates = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("source"), F.col("doc_id").alias("_ord"))
    return relational.lookup_update(table(spark, d, "documents").select("doc_id", "source"), updates, "doc_id", "source")


@query("""SELECT o_orderkey, coalesce(c_acctbal, 0.0) AS found FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING') c ON o_custkey = c_custkey AND o_custkey % 25 = c_nationkey % 25""")
def composite_lookup(spark, d):
    c = table(spark, d, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_nationkey") % 25).cast("long").alias("k"), "c_acctbal")
    o = table(spark, d, "orders").withColumn("k", F.col("o_custkey") % 25)
    return o.join(c, ["o_custkey", "k"], "left").select("o_orderkey", F.coalesce("c_acctbal", F.lit(0.0)).alias("found"))


@query("""SELECT n_nationkey AS name_id, n_name AS name, (SELECT arg_min(c_name, c_custkey) FROM customer WHERE contains(lower(c_name), '000' || CAST(n_nationkey AS VARCHAR))) AS title FROM nation""")
def theta_first_match(spark, d):
    names = table(spark, d, "nation").select(F.col("n_nationkey").alias("name_id"), F.concat(F.lit("000"), F.col("n_nationkey").cast("string")).alias("name"), F.col("n_name").alias("label"))
    titles = table(spark, d, "customer").select(F.col("c_name").alias("title"), F.col("c_custkey").alias("_ord"))
    return relational.first_containing(names, titles).select("name_id", F.col("label").alias("name"), "title")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_semi").select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id")


@query("""WITH p AS (SELECT c_custkey AS point_id, (c_custkey % 97) / 100.0 AS lat, (c_custkey % 89) / 100.0 AS lng, c_nationkey % 2 AS layer FROM customer),
    t AS (SELECT s_suppkey AS target_id, (s_suppkey % 97) / 100.0 + 0.0004 AS t_lat, (s_suppkey % 89) / 100.0 - 0.0003 AS t_lng FROM supplier)
    SELECT target_id, arg_min(point_id, layer * 1000000000 + point_id) AS point_id FROM t JOIN p ON abs(lat - t_lat) < 0.001 AND abs(lng - t_lng) < 0.001 GROUP BY target_id""")
def proximity_match(spark, d):
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    points = table(spark, d, "customer").select(k.alias("point_id"), (k % 97 / 100.0).alias("lat"), (k % 89 / 100.0).alias("lng"), (F.col("c_nationkey") % 2).alias("layer"), k.alias("_ord"))
    targets = table(spark, d, "supplier").select(s.alias("target_id"), (s % 97 / 100.0 + 0.0004).alias("t_lat"), (s % 89 / 100.0 - 0.0003).alias("t_lng"))
    return relational.near(points, targets)


# Dedup and set operations -----------------------------------------------------------------------


@query("SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def full_dedup(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").dropDuplicates()


@query("""SELECT k, id FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s, o) AS n FROM (
    SELECT c_nationkey AS k, c_custkey AS id, 0 AS s, -c_custkey AS o FROM customer UNION ALL SELECT s_nationkey + 10, s_suppkey, 1, s_suppkey FROM supplier)) WHERE n = 1""")
def keyed_dedup(spark, d):
    base = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("id"), F.col("c_custkey").alias("_ord"))
    others = table(spark, d, "supplier").select((F.col("s_nationkey") + 10).alias("k"), F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("_ord"), F.lit(0).alias("_source"))
    return relational.keyed_dedup(base, others, "k").select("k", "id")


@query("SELECT DISTINCT v FROM (SELECT c_mktsegment AS v FROM customer UNION ALL SELECT p_type FROM part UNION ALL SELECT event_type FROM events) WHERE v IS NOT NULL AND v <> ''")
def distinct_union(spark, d):
    parts = [table(spark, d, t).select(F.col(c).alias("v")) for t, c in (("customer", "c_mktsegment"), ("part", "p_type"), ("events", "event_type"))]
    return parts[0].union(parts[1]).union(parts[2]).where("v is not null and v <> ''").distinct()


@query("SELECT upper(p_type) AS folded, arg_min(p_type, p_partkey) AS first_seen FROM part GROUP BY upper(p_type)")
def ci_distinct_first(spark, d):
    return table(spark, d, "part").groupBy(F.upper("p_type").alias("folded")).agg(F.min_by("p_type", "p_partkey").alias("first_seen"))


@query("SELECT c_custkey AS id, 'c' AS source FROM customer UNION ALL SELECT s_suppkey, 's' FROM supplier")
def union_all(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("c").alias("source")).unionByName(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("s").alias("source")))


@query("SELECT c_custkey AS id, c_name AS name, NULL AS size, NULL AS status FROM customer UNION ALL SELECT p_partkey, NULL, p_size, NULL FROM part UNION ALL SELECT o_orderkey, NULL, NULL, o_orderstatus FROM orders")
def hetero_union(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    b = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"))
    c = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)


@query("SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def set_difference(spark, d):
    return table(spark, d, "customer").select("c_custkey").subtract(table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")))


@query("""SELECT id, source_rank FROM (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS dba, 1 AS source_rank FROM customer UNION ALL SELECT s_suppkey, s_name, '', 0 FROM supplier)
    WHERE contains(lower(name), '12') OR contains(lower(dba), '12') ORDER BY CASE WHEN contains(lower(name), '12') THEN 0 ELSE 1 END, source_rank, id LIMIT 10""")
def ranked_search_top10(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("dba"), F.lit(1).alias("source_rank"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("").alias("dba"), F.lit(0).alias("source_rank"))
    return relational.ranked_search(c.unionByName(s).withColumn("_ord", F.col("id")), "12").select("id", "source_rank")


@query("""SELECT k, row_number() OVER (ORDER BY try_cast(k AS BIGINT) IS NULL, try_cast(k AS BIGINT), k) AS rn FROM (SELECT DISTINCT CASE WHEN p_size % 3 = 0 THEN p_brand ELSE CAST(p_size AS VARCHAR) END AS k FROM part)""")
def mixed_key_sort(spark, d):
    keys = table(spark, d, "part").select(F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).otherwise(F.col("p_size").cast("string")).alias("k")).distinct()
    n = F.col("k").try_cast("bigint")
    order = keys.withColumn("_t", n.isNull()).withColumn("_n", F.coalesce(n, F.lit(0)))
    return relational.numbered(order.withColumnRenamed("_n", "num"), ["_t", "num", "k"], 1).select("k", F.col("id").alias("rn"))


@query("""SELECT name, row_number() OVER (ORDER BY strip_accents(lower(name)), lower(name)) AS place FROM (SELECT DISTINCT CASE p_partkey % 7 WHEN 0 THEN 'Ávila' WHEN 1 THEN 'avila' WHEN 2 THEN 'Burgos'
    WHEN 3 THEN 'Cádiz' WHEN 4 THEN 'Cuenca' WHEN 5 THEN 'Zamora' ELSE 'Álava' END AS name FROM part)""")
def locale_sort(spark, d):
    given = F.element_at(F.array(*[F.lit(n) for n in ("Ávila", "avila", "Burgos", "Cádiz", "Cuenca", "Zamora", "Álava")]), (F.col("p_partkey") % 7 + 1).cast("int"))
    names = relational.locale_sorted(table(spark, d, "part").select(given.alias("name")).distinct(), "name")
    return names.select("name", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.collate("name", "UNICODE"))).cast("long").alias("place"))  # seven rows


@query("SELECT o_orderkey, o_custkey, o_orderpriority, row_number() OVER (ORDER BY o_orderkey) - 1 AS id FROM orders WHERE o_orderstatus = 'F'")
def surrogate_ids(spark, d):
    return relational.numbered(table(spark, d, "orders").where("o_orderstatus = 'F'"), ["o_orderkey"]).select("o_orderkey", "o_custkey", "o_orderpriority", "id")


@query("SELECT c_custkey, c_name, CAST((row_number() OVER (ORDER BY c_custkey) - 1) // 200 + 1 AS INTEGER) AS chunk FROM customer")
def chunk_assign(spark, d):
    return relational.chunked(table(spark, d, "customer"), ["c_custkey"], 200).select("c_custkey", "c_name", "chunk")


# Scalars ----------------------------------------------------------------------------------------

def _csz():
    return F.concat(F.col("c_mktsegment"), F.when(F.col("c_custkey") % 3 == 0, " CA ").otherwise(", CA "), F.lpad((F.col("c_custkey") % 100000).cast("string"), 5, "0"))


_CSZ_SQL = "concat(c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN ' CA ' ELSE ', CA ' END, lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0'))"


@query(f"""SELECT c_custkey, CASE WHEN regexp_matches(x, p) THEN regexp_extract(x, p, 1) END AS city, CASE WHEN regexp_matches(x, p) THEN regexp_extract(x, p, 2) END AS state, CASE WHEN regexp_matches(x, p) THEN regexp_extract(x, p, 3) END AS zip
    FROM (SELECT c_custkey, {_CSZ_SQL} AS x FROM customer), (SELECT '^(.*),\\s*([A-Z]{{2}})\\s*(\\d{{5}}(?:-\\d{{4}})?)$' AS p)""".replace("regexp_matches(x, p)", "regexp_matches(x, '^(.*),\\s*([A-Z]{2})\\s*(\\d{5}(?:-\\d{4})?)$')").replace("(x, p, ", "(x, '^(.*),\\s*([A-Z]{2})\\s*(\\d{5}(?:-\\d{4})?)$', "))
def csz_split(spark, d):
    return table(spark, d, "customer").select("c_custkey", *columns.city_state_zip(_csz()))


@query(f"SELECT c_custkey, nullif(regexp_extract({_CSZ_SQL}, ', ([A-Z]{{2}})', 1), '') AS state FROM customer")
def state_from_csz(spark, d):
    return table(spark, d, "customer").select("c_custkey", columns.state_of(_csz()).alias("state"))


@query("SELECT s_suppkey, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN concat('As  B', s_suppkey) ELSE '' END AS dba FROM supplier")
def dba_split(spark, d):
    given = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.col("s_name"), F.lit(" Also Doing Business As Name: B"), F.col("s_suppkey"))).otherwise(F.col("s_name"))
    return table(spark, d, "supplier").select("s_suppkey", *columns.split_dba(given))


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN concat(s_suppkey, ' Mill Lane') WHEN 1 THEN concat(s_suppkey, ' High St, Unit 2') WHEN 2 THEN '' ELSE 'The Mill' END AS street,
    CASE s_suppkey % 4 WHEN 0 THEN 'Leeds' WHEN 1 THEN 'York' WHEN 2 THEN concat('Farm ', s_suppkey) ELSE 'Bath' END AS city, CASE s_suppkey % 4 WHEN 0 THEN 'LS1 4AB' WHEN 3 THEN 'BA1 1AA' ELSE '' END AS zip FROM supplier""")
def uk_address(spark, d):
    """With a postcode, without one, a single part, and a town that occurs again behind the postcode."""
    k, kind = F.col("s_suppkey").cast("string"), F.col("s_suppkey") % 4
    given = F.when(kind == 0, F.concat(k, F.lit(" Mill Lane, Leeds, LS1 4AB, United Kingdom"))).when(kind == 1, F.concat(k, F.lit(" High St, Unit 2,  York"))).when(kind == 2, F.concat(F.lit("Farm "), k)).otherwise("The Mill, Bath, BA1 1AA, Somerset")
    return table(spark, d, "supplier").select("s_suppkey", *columns.uk_address(given))


@query("""SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN concat('Calle Sol ', s_suppkey) WHEN 1 THEN concat('Finca ', s_suppkey) ELSE 'Calle Mar' END AS street,
    CASE s_suppkey % 3 WHEN 0 THEN 'Lugo' WHEN 1 THEN 'Soria' ELSE 'Vigo' END AS city, CASE s_suppkey % 3 WHEN 0 THEN '27001' WHEN 1 THEN '' ELSE '36201' END AS zip FROM supplier""")
def es_address(spark, d):
    k, kind = F.col("s_suppkey").cast("string"), F.col("s_suppkey") % 3
    given = F.when(kind == 0, F.concat(F.lit("Calle Sol "), k, F.lit(", Lugo, 27001, España"))).when(kind == 1, F.concat(F.lit("Finca "), k, F.lit(", Soria"))).otherwise("Calle Mar, Vigo, 36201 Pontevedra")
    return table(spark, d, "supplier").select("s_suppkey", *columns.spanish_address(given, street_first=True))


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN concat('Weg ', s_nationkey) WHEN 1 THEN '' WHEN 2 THEN '' ELSE 'Gasse 3' END AS street, CASE s_suppkey % 4 WHEN 0 THEN lpad(CAST(s_suppkey AS VARCHAR), 5, '1') WHEN 1 THEN '' WHEN 2 THEN '10115' ELSE '12345' END AS zip,
    CASE s_suppkey % 4 WHEN 0 THEN 'Berlin' WHEN 1 THEN '' WHEN 2 THEN 'Bonn' ELSE '6 Ulm 10115' END AS city FROM supplier""")
def de_address(spark, d):
    """A street, no zip, no street, and more than five digits."""
    k, kind = F.lpad(F.col("s_suppkey").cast("string"), 5, "1"), F.col("s_suppkey") % 4
    given = F.when(kind == 0, F.concat(F.lit("Weg "), F.col("s_nationkey").cast("string"), F.lit(" "), k, F.lit(" Berlin"))).when(kind == 1, F.concat(F.lit("Weg "), F.col("s_nationkey").cast("string"))).when(kind == 2, "10115Bonn").otherwise("Gasse 3 123456 Ulm 10115")
    return table(spark, d, "supplier").select("s_suppkey", *columns.german_address(given))


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN concat('VIA ROMA ', s_suppkey) WHEN 1 THEN 'VIA, ALTA' WHEN 2 THEN concat(s_suppkey, ' BORGO') ELSE 'VIA PO' END AS street,
    CASE s_suppkey % 4 WHEN 0 THEN 'BASSIANO' WHEN 3 THEN 'ASTI, NORD' ELSE '' END AS city, CASE s_suppkey % 4 WHEN 0 THEN 'Latina' WHEN 3 THEN 'XX' ELSE '' END AS state FROM supplier""")
def it_address(spark, d):
    """Blanks around, no province, no comma, and a comma in the town with an unknown province."""
    k, kind = F.col("s_suppkey").cast("string"), F.col("s_suppkey") % 4
    given = F.when(kind == 0, F.concat(F.lit(" VIA ROMA "), k, F.lit(", BASSIANO (LT) "))).when(kind == 1, "VIA, ALTA").when(kind == 2, F.concat(k, F.lit(" BORGO "))).otherwise("VIA PO, ASTI, NORD(XX)")
    return table(spark, d, "supplier").select("s_suppkey", *columns.italian_address(given, {"LT": "Latina"}))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN concat('+52(55)', c_custkey, '-', c_nationkey) WHEN 1 THEN replace(c_phone, ' ', '') ELSE '' END AS phone FROM (SELECT *, concat('(', c_nationkey, ') ', c_custkey) AS c_phone FROM customer)")
def phone_clean(spark, d):
    """Signs, letters and points; digits in parentheses; nothing but letters."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    given = F.when(k % 3 == 0, F.concat(F.lit("+52 (55) "), k, F.lit(".-"), n, F.lit(" x"))).when(k % 3 == 1, F.concat(F.lit("("), n, F.lit(") "), k)).otherwise("s/n.")
    return table(spark, d, "customer").select("c_custkey", columns.clean_phone(given).alias("phone"))


@query("""SELECT p_partkey, list_extract(['N/A', 'Less than 10,000 pounds/month.', '10k - 100k pounds/month.', '100k - 1M pounds/month.', '1M - 10M pounds/month.', 'Over 10M pounds/month.', 'N/A'], CAST(p_size % 7 + 1 AS INTEGER)) AS volume,
    list_extract(['N/A', 'Less than 1,000 animals/year.', '1k - 10k animals/year.', '10k - 100k animals/year.', '100k - 10M animals/year.', 'Over 10M animals/year.', 'N/A'], CAST(p_size % 7 + 1 AS INTEGER)) AS slaughtered FROM part""")
def volume_label(spark, d):
    code = F.concat((F.col("p_size") % 7).cast("string"), F.lit(".0"))
    return table(spark, d, "part").select("p_partkey", columns.volume_label(code, columns.PROCESSING_VOLUMES).alias("volume"), columns.volume_label(code, columns.SLAUGHTER_VOLUMES).alias("slaughtered"))


@query("""SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN concat('Cattle (Cows, Bulls)|', n_name) WHEN 1 THEN concat('A (B (c, ', n_name, '), d)|e') WHEN 2 THEN concat('||', n_name) WHEN 3 THEN concat('x), ', n_name) ELSE '' END AS items,
    CAST(list_extract([2, 2, 3, 1, 0], CAST(n_nationkey % 5 + 1 AS INTEGER)) AS BIGINT) AS n FROM nation""")
def paren_split(spark, d):
    """One level, two levels, blank items, a parenthesis too many, and nothing."""
    name, kind = F.col("n_name"), F.col("n_nationkey") % 5
    given = F.when(kind == 0, F.concat(F.lit("Cattle (Cows, Bulls), "), name, F.lit(","))).when(kind == 1, F.concat(F.lit("A (B (c, "), name, F.lit("), d) ,e"))).when(kind == 2, F.concat(F.lit(",,"), name)).when(kind == 3, F.concat(F.lit("x), "), name)).otherwise("")
    items = columns.outer_commas(given)
    return table(spark, d, "nation").select("n_nationkey", F.array_join(items, "|").alias("items"), F.size(items).cast("long").alias("n"))


@query("SELECT event_id, CASE event_type WHEN (SELECT min(event_type) FROM events) THEN 'first' ELSE event_type END AS text FROM events")
def i18n_lookup(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type")
    words = e.agg(F.min("event_type").alias("key")).select(F.lit("en").alias("locale"), "key", F.lit("first").alias("value"))
    return reports.translated(e, "event_type", words, "en").select("event_id", "text")


@query("""SELECT concat_ws(',', CAST(c_custkey AS VARCHAR), concat('"', c_name, ', "', c_mktsegment, '"', '"'), CASE WHEN c_nationkey = 0 THEN '' ELSE CAST(c_nationkey AS VARCHAR) END) AS line FROM customer""".replace("""concat('"', c_name, ', "', c_mktsegment, '"', '"')""", """concat('"', c_name, ', ""', c_mktsegment, '""', '"')"""))
def export_facility(spark, d):
    name = F.concat(F.col("c_name"), F.lit(', "'), F.col("c_mktsegment"), F.lit('"'))
    return table(spark, d, "customer").select(reports.csv_line(F.col("c_custkey"), name, reports.shown_coordinate(F.col("c_nationkey"))).alias("line"))


@query(f"SELECT concat_ws(',', CAST(o_orderkey AS VARCHAR), CASE {LICENCE_SQL} WHEN 'Class A - Breeder' THEN 'Breeder' WHEN 'Class B - Dealer' THEN 'Dealer' WHEN 'Class C - Exhibitor' THEN 'Exhibitor' ELSE 'Other' END) AS line FROM orders")
def export_inspection(spark, d):
    kind = F.coalesce(F.nullif(F.regexp_extract(_licence(), r"^Class [ABC] - (\w+)$", 1), F.lit("")), F.lit("Other"))
    return table(spark, d, "orders").select(reports.csv_line(F.col("o_orderkey"), kind).alias("line"))


@query(f"WITH {MARKERS} SELECT id, greatest(-85.0, least(85.0, CAST(lat AS DOUBLE))) AS lat, CASE WHEN lng * 3 > 180 THEN lng * 3 - 360 * ceil((lng * 3 - 180) / 360) WHEN lng * 3 < -180 THEN lng * 3 + 360 * ceil((-180 - lng * 3) / 360) ELSE lng * 3 END AS lng FROM mk")
def wrap_coords(spark, d):
    return markers(spark, d).select("id", *columns.wrapped(F.col("lat"), F.col("lng") * 3))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<!\[CDATA\[|\]\]>', '', 'g'), '<[^>]+>', ' ', 'g'), '[ \t\n\r\f\x0b]+', ' ', 'g')) AS text FROM pages")
def strip_tags(spark, d):
    return table(spark, d, "pages").select("page_id", columns.plain_text(F.col("html")).alias("text"))


@query("SELECT p_partkey, coalesce(nullif(trim(CASE WHEN p_size % 2 = 0 THEN p_name ELSE ' ' END), ''), nullif(trim(p_brand), ''), 'Unknown') AS v FROM part")
def fallback_chain(spark, d):
    return table(spark, d, "part").select("p_partkey", columns.first_filled(F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(" "), F.col("p_brand")).alias("v"))
