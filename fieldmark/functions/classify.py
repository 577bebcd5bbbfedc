"""Facility classification: ordered rules and code lists as CASE expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: (words that must all occur, key, category), the first match wins.
RULES = [
    (["dairy farm"], "dairyFarm", "breeder"), (["intensive pig farm"], "intensivePigFarm", "breeder"), (["intensive poultry farm"], "intensivePoultryFarm", "breeder"),
    (["intensive sow pig farm"], "intensiveSowPigFarm", "breeder"), (["finishing unit"], "finishingUnit", "breeder"), (["mixed farm"], "mixedFarm", "breeder"),
    (["cattle slaughterhouse"], "cattleSlaughterhouse", "slaughter"), (["pig slaughterhouse"], "pigSlaughterhouse", "slaughter"),
    (["poultry slaughterhouse"], "poultrySlaughterhouse", "slaughter"), (["sheep & lamb slaughterhouse"], "sheepLambSlaughterhouse", "slaughter"),
    (["goat slaughterhouse"], "goatSlaughterhouse", "slaughter"), (["horse slaughterhouse"], "horseSlaughterhouse", "slaughter"),
    (["other mammal slaughterhouse"], "otherMammalSlaughterhouse", "slaughter"), (["large bird slaughterhouse"], "largeBirdSlaughterhouse", "slaughter"),
    (["wild bird slaughterhouse"], "wildBirdSlaughterhouse", "slaughter"), (["wild rabbit slaughterhouse"], "wildRabbitSlaughterhouse", "slaughter"),
    (["mixed slaughterhouse"], "mixedSlaughterhouse", "slaughter"), (["slaughter"], "slaughterhouse", "slaughter"),
    (["pig breeding farm"], "pigBreedingFarm", "breeder"), (["pig farm"], "pigFarm", "breeder"), (["poultry farm"], "poultryFarm", "breeder"),
    (["aquaculture"], "aquacultureFacility", "breeder"),
    *[(["farm", a], f"{a}Farm", "breeder") for a in ("dairy", "pig", "poultry", "cattle", "beef", "sheep", "goat", "chicken", "duck", "turkey", "lamb", "horse", "deer", "rabbit", "pheasant", "quail", "ostrich", "emu", "bison", "buffalo", "elk", "goose")],
    (["farm", "intensive"], "intensiveFarm", "breeder"), (["farm"], "farm", "breeder"),
    (["animal production", "hunting"], "gameHuntingFacility", "breeder"), (["animal production", "game"], "gameHuntingFacility", "breeder"), (["animal production"], "animalFarm", "breeder"),
    (["exhibition"], "exhibitionFacility", "exhibitor"), (["aquatic", "processing"], "aquaticProcessingFacility", "slaughter"), (["aquatic"], "aquaticProductionFacility", "breeder"),
    (["chicken producer"], "chickenProducer", "breeder"), (["butcher"], "butcher", "slaughter"),
]
#: Federal function digits.
FUNCTION_TYPES = {"1": "Slaughter", "2": "Canning", "3": "Boning and Cutting", "4": "Rendering", "6": "Processing", "7": "Packaging", "8": "Inedible Rendering"}
#: Description keywords of Mexican activities, in order.
MEXICAN_TYPES = [
    ("Aquaculture", ["acuicultura", "piscicultura", "ranicultura", "pez", "acua"]), ("Laboratory", ["laboratorio", "investigacion", "analytical", "análisis"]),
    ("Slaughterhouse", ["matanza", "slaughter", "sacrifi"]),
]
#: British classifications and their names.
BRITISH_TYPES = {
    "DairyFarm": "Dairy Farm", "IntensivePigFarm": "Intensive Pig Farm", "IntensivePoultryFarm": "Intensive Poultry Farm", "IntensiveSowPigFarm": "Intensive Sow Pig Farm", "FinishingUnit": "Finishing Unit",
    "CowSlaughterhouse": "Cattle Slaughterhouse", "PigSlaughterhouse": "Pig Slaughterhouse", "PoultrySlaughterhouse": "Poultry Slaughterhouse", "SheepAndLambSlaughterhouse": "Sheep & Lamb Slaughterhouse",
    "GoatSlaughterhouse": "Goat Slaughterhouse", "HorseSlaughterhouse": "Horse Slaughterhouse", "LargeBirdSlaughterhouse": "Large Bird Slaughterhouse", "WildBirdSlaughterhouse": "Wild Bird Slaughterhouse",
    "WildRabbitSlaughterhouse": "Wild Rabbit Slaughterhouse", "OtherMammalSlaughterhouse": "Other Mammal Slaughterhouse",
}
#: Text in a classification and the flag it sets; of one classification only the first.
BRITISH_FLAGS = [
    ("CowSlaughterhouse", "cow_slaughter"), ("PigSlaughterhouse", "pig_slaughter"), ("SheepAndLambSlaughterhouse", "sheep_lamb_slaughter"), ("GoatSlaughterhouse", "goat_slaughter"),
    ("PoultrySlaughterhouse", "poultry_slaughter"), ("OtherMammalSlaughterhouse", "other_mammal_slaughter"), ("DairyFarm", "dairy_farm"), ("IntensivePigFarm", "intensive_pig_farm"),
    ("IntensivePoultryFarm", "intensive_poultry_farm"),
]
SPANISH_FLAGS = [("GranjaPorcinaIntensiva", "intensive_pig_farm"), ("GranjaPorcinaIntensivaDeCerdas", "intensive_pig_breeding_farm"), ("GranjaAvícolaIntensiva", "intensive_poultry_farm"), ("Acuicultura", "aquaculture")]
#: Danish industries that slaughter, and those that only process.
DANISH_SLAUGHTER = [
    "Fremstilling af animalske produkter - Fisk og muslinger m.v.", "Fremstilling af animalske produkter - Kød", "Slagterier", "Specialforretning - Slagter m.v.",
    "Virksomhed, foreløbig AUT: Slagteri, slagteri med fremstilli", "Virksomhed, foreløbig: Slagter, slagterafdeling",
]
DANISH_PROCESSING = ["Fremstilling af animalske produkter - Andre produkter", "Fremstilling af animalske produkter - Mælk og ost", "Fremstilling af animalske produkter - Æg"]


def classification_flags(classifications: Column, flags: list[tuple[str, str]]) -> dict[str, Column]:
    """A flag column for each of ``flags``, from a comma-separated list; blank or null sets none."""
    each = F.transform(F.split(F.coalesce(classifications, F.lit("")), ","), lambda x: reduce(lambda chain, f: chain.when(x.contains(f[0]), f[1]), flags[1:], F.when(x.contains(flags[0][0]), flags[0][1])))
    return {name: F.coalesce(F.array_contains(F.filter(each, lambda x: x.isNotNull()), name), F.lit(False)) for _, name in flags}


def flag_activities(flags: dict[str, Column], groups: list[tuple[str, str]]) -> Column:
    """Activities whose flags (those with the given ending) are set, in order; else Unknown."""
    named = [F.when(reduce(lambda a, b: a | b, [c for n, c in flags.items() if n.endswith(ending)]), activity) for ending, activity in groups]
    text = F.concat_ws("; ", *named)
    return F.when(text == "", "Unknown").otherwise(text)


def british_activities(classifications: Column) -> Column:
    return flag_activities(classification_flags(classifications, BRITISH_FLAGS), [("_slaughter", "Meat Slaughter"), ("_farm", "Animal Production")])


def spanish_activities(classifications: Column) -> Column:
    return flag_activities(classification_flags(classifications, SPANISH_FLAGS), [("_farm", "Animal Production"), ("aquaculture", "Aquaculture")])


def danish_industry(industry: Column) -> Column:
    """Whether a row is of interest: made of animals, or a butcher's."""
    return F.lower(industry).startswith("fremstilling af animalske produkter") | F.lower(industry).contains("slagter")


def danish_activities(industry: Column) -> Column:
    """The activities of an industry; an unknown one fails the query."""
    known = F.when(industry.isin(DANISH_SLAUGHTER), "Meat Processing; Meat Slaughter").when(industry.isin(DANISH_PROCESSING), "Meat Processing")
    return known.otherwise(F.raise_error(F.concat(F.lit("unknown industry: "), F.coalesce(industry, F.lit("null")))))


def _first(c: Column, pick, default: str) -> Column:
    lower = F.lower(c)
    rules = [(reduce(lambda a, b: a & b, [lower.contains(w) for w in words]), pick(key, category)) for words, key, category in RULES]
    return reduce(lambda chain, rule: chain.when(*rule), rules[1:], F.when(*rules[0])).otherwise(default)


def facility_type(c: Column) -> list[Column]:
    """label_key, label_suffix, category and icon of a facility type text."""
    text = F.coalesce(c, F.lit(""))
    key = _first(text, lambda k, _: f"facilityTypes.{k}", "facilityTypes.processing")
    category = _first(text, lambda _, g: g, "processing")
    inner = F.regexp_extract(F.lower(text), r"mixed (?:farm|slaughterhouse) \(([^)]+)\)", 1)
    suffix = F.when(key.isin("facilityTypes.mixedFarm", "facilityTypes.mixedSlaughterhouse") & (inner != ""), F.concat(F.lit(" ("), inner, F.lit(")"))).otherwise("")
    return [key.alias("label_key"), suffix.alias("label_suffix"), category.alias("category"), category.alias("icon")]


def function_type(codes: Column) -> Column:
    """The last deciding digit names the type; else the first of 0, 5, 9; else Unknown."""
    upper = F.upper(F.trim(codes))
    last, other = F.regexp_extract(upper, r"(?s)^.*([1234678])", 1), F.regexp_extract(upper, "[059]", 0)
    known = F.create_map(*[F.lit(x) for kv in FUNCTION_TYPES.items() for x in kv])
    return F.when(last != "", F.try_element_at(known, last)).when(other != "", F.concat(F.lit("Type "), other)).otherwise("Unknown")


def primary_type(classifications: Column, names: dict[str, str]) -> Column:
    """The type of a comma-separated list of classifications; farms outrank slaughterhouses."""
    mapping = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    known = F.filter(F.transform(F.split(classifications, ","), lambda x: F.try_element_at(mapping, F.trim(x))), lambda x: x.isNotNull())
    is_farm = lambda x: x.contains("Farm") | x.contains("Unit")
    farms, others = F.filter(known, is_farm), F.filter(known, lambda x: ~is_farm(x))
    mixed = lambda xs, what: F.when(F.size(xs) > 1, F.concat(F.lit(f"Mixed {what} ("), F.array_join(xs, ", "), F.lit(")"))).otherwise(F.get(xs, F.lit(0)))
    return F.when(F.trim(F.coalesce(classifications, F.lit(""))) == "", "Unknown Facility").when(F.size(farms) > 0, mixed(farms, "Farm")).when(F.size(others) > 0, mixed(others, "Slaughterhouse")).otherwise(F.concat(F.lit("Unknown ("), classifications, F.lit(")")))


def keyword_type(c: Column, types: list[tuple[str, list[str]]], default: str) -> Column:
    lower = F.lower(c)
    return reduce(lambda chain, t: chain.when(lower.rlike("|".join(t[1])), t[0]), types[1:], F.when(lower.rlike("|".join(types[0][1])), types[0][0])).otherwise(default)


# Types of the Mexican register under the names of the map, and its ranges of employees.
MEXICAN_NAMES = {"Aquaculture Facility": "Aquaculture Farm", "Fishing Operation": "Fishing Operation", "Animal Farming Service": "Farm / Breeder"}
EMPLOYEES = {
    "0 a 5 personas": "0-5", "6 a 10 personas": "6-10", "11 a 30 personas": "11-30", "31 a 50 personas": "31-50", "51 a 100 personas": "51-100",
    "101 a 250 personas": "101-250", "251 y mas": "250+",
}


def mapped(c: Column, names: dict[str, str]) -> Column:
    """The name of a value, the value itself where it has none."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), c), c)


def mexican_category(facility_type: Column) -> Column:
    return F.when(facility_type.contains("Aquaculture"), "Aquaculture").when(facility_type.contains("Fishing"), "Fishing").otherwise("Breeding/Farming")


def employees(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", "Unknown").otherwise(mapped(c, EMPLOYEES))


def licence_icon(licence: Column) -> Column:
    """The marker of an inspection; unknown licences look like breeders."""
    return F.when(licence == "Class B - Dealer", "dealer").when(licence == "Class C - Exhibitor", "exhibitor").otherwise("breeder")
