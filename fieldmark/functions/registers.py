"""National registers: codes, activities, addresses and animal flags as built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .classify import facility_type, function_type
from .columns import any_contains, filled, matched, outer_commas

#: Product letters of Canadian federal codes and the animals they stand for, in slaughter and in processing.
FEDERAL_LETTERS = {
    "A": ("beef_cow_slaughter", "beef_processing"),
    "B": ("beef_cow_slaughter", "beef_processing"),
    "C": ("beef_cow_slaughter", "beef_processing"),
    "D": ("market_swine_slaughter", "pork_processing"),
    "E": ("market_swine_slaughter", "pork_processing"),
    "F": ("young_chicken_slaughter", "chicken_processing"),
    "G": ("young_chicken_slaughter", "chicken_processing"),
    "I": ("young_chicken_slaughter", "chicken_processing"),
    "K": ("young_turkey_slaughter", "turkey_processing"),
    "R": ("duck_slaughter", "duck_processing"),
    "S": ("goat_slaughter", "goat_processing"),
    "V": ("sheep_slaughter", "sheep_processing"),
    "X": ("rabbit_slaughter", "rabbit_processing"),
}
#: Activities of the folders of the French map.
FRENCH_FOLDERS = {
    "Elevages divers": "Animal Production", "Elevages et Accessoires de chasse et pêche": "Animal Production; Hunting/Game", "Elevages de Chasse (AUTRES)": "Animal Production; Hunting/Game",
    "Abattoirs": "Meat Slaughter", "Liste des Abattoirs ALIM' CONFIANCE": "Meat Slaughter", "Abattoirs Personnes Aquatiques ALIM' CONFIANCE": "Aquatic Processing",
    "Vivier - Personnes aquatiques vivantes ALIM' CONFIANCE": "Aquatic Production", "Points reçus": "Other",
}
#: German species codes and the flags they set, for slaughter and for processing.
GERMAN_SLAUGHTER = {
    "B": ["beef_cow_slaughter", "steer_slaughter", "heifer_slaughter", "bull_stag_slaughter", "dairy_cow_slaughter", "heavy_calf_slaughter", "bob_veal_slaughter", "formula_fed_veal_slaughter", "non_formula_fed_veal_slaughter"],
    "P": ["market_swine_slaughter", "sow_slaughter", "roaster_swine_slaughter"],
    "wU": ["boar_stag_swine_slaughter", "stag_swine_slaughter", "feral_swine_slaughter"],
    "C": ["goat_slaughter", "young_goat_slaughter", "adult_goat_slaughter"],
    "O": ["sheep_slaughter", "lamb_slaughter"],
    "L": ["rabbit_slaughter"],
    "R": ["ostrich_slaughter", "emu_slaughter", "rhea_slaughter"],
    "A": ["poultry_slaughter", "young_chicken_slaughter", "light_fowl_slaughter", "heavy_fowl_slaughter", "capon_slaughter", "young_turkey_slaughter", "young_breeder_turkey_slaughter", "old_breeder_turkey_slaughter", "fryer_roaster_turkey_slaughter", "duck_slaughter", "goose_slaughter"],
}
GERMAN_PROCESSING = {
    "A": ["poultry_processing", "chicken_processing", "duck_processing", "goose_processing", "turkey_processing"],
    "B": ["beef_processing"],
    "P": ["pork_processing"],
    "wU": ["deer_processing", "elk_processing"],
    "C": ["goat_processing"],
    "L": ["rabbit_processing"],
    "O": ["sheep_processing"],
    "R": ["ratite_processing"],
}
#: Italian species codes, in the order of the list.
ITALIAN_SPECIES = {"B": "Cattle (Cows, Bulls)", "P": "Pigs", "C": "Chickens", "S": "Sheep & Lambs", "O": "Other"}
#: Keywords in Mexican activities and the flags they set (a word may set several).
MEXICAN_FLAGS = {
    "beef": ["beef_slaughter", "beef_cow_slaughter", "steer_slaughter", "heifer_slaughter", "bull_stag_slaughter", "dairy_cow_slaughter", "beef_processing"],
    "pork": ["market_swine_slaughter", "sow_slaughter", "roaster_swine_slaughter", "pork_processing"],
    "poultry": ["poultry_slaughter", "young_chicken_slaughter", "light_fowl_slaughter", "heavy_fowl_slaughter", "young_turkey_slaughter", "chicken_processing", "turkey_processing"],
    "avicultura": ["poultry_slaughter", "young_chicken_slaughter", "chicken_processing"],
    "ganado": ["beef_slaughter", "beef_cow_slaughter", "beef_processing", "meat_slaughter"],
    "carne": ["meat_slaughter"],
    "cerdo": ["market_swine_slaughter", "pork_processing"],
    "conejo": ["rabbit_slaughter", "rabbit_processing"],
    "cabra": ["goat_slaughter", "goat_processing"],
    "oveja": ["sheep_slaughter"],
    "pez": ["poultry_slaughter"],
    "aves": ["poultry_slaughter"],
}
#: Species columns of the Ontario register and the flags they set.
ONTARIO_SPECIES = {
    "Beef_Boeuf": ["beef_cow_slaughter"],
    "Pigs_Porcs": ["market_swine_slaughter"],
    "Chicken, Fowl_Poulet, Oiseaux de basse-cour": ["young_chicken_slaughter"],
    "Turkeys_Dindes": ["young_turkey_slaughter"],
    "Ducks, Geese_Canards, Oies": ["duck_slaughter"],
    "Rabbits_Lapins": ["rabbit_slaughter"],
    "Goats, Lamb, Sheep_Chèvres, Agneaux, Moutons": ["goat_slaughter", "lamb_slaughter", "sheep_slaughter"],
    "Veal, Light Calves_Veaux de boucherie, Veaux légers": ["heavy_calf_slaughter"],
    "Deer, Elk_Cerfs, Élans": ["deer_reindeer_slaughter", "elk_slaughter"],
    "Buffalo,Yak_Bison, Yack": ["bison_slaughter", "yak_slaughter"],
    "Emus, Ostrich, Rhea_Émeus, Autruches, Nandous": ["ostrich_slaughter", "emu_slaughter"],
    "Alpaca, Llama_Alpaga, Lama": ["other_voluntary_livestock_slaughter"],
    "Fancy Poultry_Volaille à chair fine": ["other_voluntary_poultry_slaughter"],
}
#: What is no part of a laboratory's postal address.
ADDRESS_NOISE = [
    r"V\.P\. FOR RESEARCH[ /]*", r"OFFICE OF COMPARATIVE MEDICINE[ /]*", r"OFFICE OF RESEARCH ADMIN[ /]*", r"DIR\., PRECLINICAL RES\. DEPT[ ,]*",
    r"P O BOX \d+[ ,]*", r"PO Box \d+[ ,]*", r"ROOM \w+[ ,]*", r"DEPT \w+[ ,]*", r"Unit \d+[ ,]*",
]


def _stripped(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _flags(tests: dict[str, Column]) -> dict[str, Column]:
    return {name: F.when(F.coalesce(test, F.lit(False)), "Yes").otherwise("") for name, test in tests.items()}


def _any(tests: list[tuple[str, Column]]) -> dict[str, Column]:
    """Flags by name; a name that occurs several times is set by any of its tests."""
    found: dict[str, Column] = {}
    for name, test in tests:
        found[name] = found[name] | test if name in found else test
    return _flags(found)


def federal_animals(codes: Column) -> dict[str, Column]:
    """Flag columns of Canadian federal codes: letters anywhere in the text, for slaughter or else for processing."""
    upper, slaughters = F.upper(codes), function_type(codes) == "Slaughter"
    pairs = [(letter, flags) for letter, flags in FEDERAL_LETTERS.items()]
    return _any([(killed, slaughters & upper.contains(letter)) for letter, (killed, _) in pairs] + [(made, ~slaughters & upper.contains(letter)) for letter, (_, made) in pairs])


def french_activity(description: Column, folder: Column) -> Column:
    """Activities by keywords of the description, else those of the folder (unknown folders: Animal Production)."""
    base = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in FRENCH_FOLDERS.items() for x in kv]), folder), F.lit("Animal Production"))
    text = F.lower(F.coalesce(description, F.lit("")))
    slaughter = F.when(base.contains("Animal Production"), "Animal Production; Meat Slaughter").otherwise("Meat Slaughter")
    return (
        F.when(any_contains(text, ["abattoir", "slaughter", "abattage"]), slaughter)
        .when(any_contains(text, ["pédagogique", "educative"]), "Exhibition")
        .when(any_contains(text, ["faisan", "perdrix", "sanglier", "chasse", "gibier"]), "Animal Production; Hunting/Game")
        .otherwise(base)
    )


def german_activity(codes: Column) -> Column:
    """Any code means processing; SH adds slaughter; blank gives nothing."""
    given = filled(codes).isNotNull()
    return F.concat_ws("; ", F.when(given, "Meat Processing"), F.when(given & codes.contains("SH"), "Meat Slaughter"))


def german_animals(codes: Column, species: Column) -> dict[str, Column]:
    """Flag columns of German codes; species codes are found anywhere, so that wA and wL count as A and L too."""
    kills, makes = german_activity(codes).contains("Slaughter"), german_activity(codes).contains("Processing")
    tests = [(n, kills & species.contains(k)) for k, names in GERMAN_SLAUGHTER.items() for n in names]
    tests += [(n, makes & species.contains(k)) for k, names in GERMAN_PROCESSING.items() for n in names]
    return _any([("meat_slaughter", kills), ("meat_processing", makes), ("slaughter_or_processing_only", kills != makes), *tests])


def italian_activity(codes: Column) -> Column:
    codes = F.coalesce(codes, F.lit(""))
    return F.coalesce(F.nullif(F.concat_ws("; ", F.when(codes.contains("CP"), "Meat Processing"), F.when(codes.contains("SH"), "Meat Slaughter")), F.lit("")), F.lit("Meat Production"))


def italian_animals(codes: Column, species: Column) -> Column:
    """Animals of a '|'-separated list of species where the codes name slaughter, else N/A."""
    held = F.transform(F.split(F.coalesce(species, F.lit("")), r"\|"), lambda x: F.trim(x))
    names = F.concat_ws(", ", *[F.when(F.array_contains(held, k), v) for k, v in ITALIAN_SPECIES.items()])
    return F.when(codes.contains("SH") & (names != ""), names).otherwise("N/A")


def italian_province(c: Column) -> Column:
    return matched(c, r"\(([A-Z]{2})\)\s*$")


def mexican_address(kind: Column, street: Column, number: Column, letter: Column, inner: Column, inner_letter: Column, none: str = "") -> Column:
    """Street kind, name, number and letter, then the inner number after 'Int.' and its letter."""
    front = F.concat_ws(" ", *[filled(c) for c in (kind, street, number, letter)])
    back = F.concat(F.coalesce(F.concat(F.lit(" Int. "), filled(inner)), F.lit("")), F.coalesce(F.concat(F.lit(" "), filled(inner_letter)), F.lit("")))
    whole = F.concat(front, back)
    return F.when(F.trim(whole) != "", whole).otherwise(none)


def mexican_animals(activity: Column) -> dict[str, Column]:
    """Flag columns of an activity's keywords; all keywords that occur count."""
    text = F.lower(F.coalesce(activity, F.lit("")))
    return _any([(flag, text.contains(word)) for word, flags in MEXICAN_FLAGS.items() for flag in flags])


def nz_activity(risk: Column, programme: Column) -> Column:
    """'risk - programme' without dashes and blanks at the ends."""
    return F.btrim(F.concat(F.coalesce(risk, F.lit("")), F.lit(" - "), F.coalesce(programme, F.lit(""))), F.lit(" -"))


def nz_animals(process: Column, product: Column) -> list[Column]:
    """slaughter (Yes or No), animals_slaughtered_list and animals_processed_list."""
    kills, made = F.coalesce(F.lower(process).contains("slaughter"), F.lit(False)), F.coalesce(product, F.lit(""))
    return [F.when(kills, "Yes").otherwise("No").alias("slaughter"), F.when(kills, made).otherwise("").alias("animals_slaughtered_list"), made.alias("animals_processed_list")]


def german_state(establishment: Column, state: Column, country: Column) -> Column:
    """A blank German state from the establishment's prefix, DE_UNKNOWN without one; other rows keep theirs."""
    prefix = matched(establishment, r"^(BW|BY|BE|BB|HB|HH|HE|MV|NI|NW|RP|SL|SN|ST|SH|TH)\s")
    blank = (country == "de") & filled(F.coalesce(state, F.lit(""))).isNull()
    return F.when(blank, F.coalesce(prefix, F.lit("DE_UNKNOWN"))).otherwise(state)


def postal_address(line: Column, city_state_zip: Column) -> Column:
    """A laboratory's address without offices, boxes, rooms and units."""
    clean = reduce(lambda c, p: F.regexp_replace(c, f"(?iU){p}", ""), ADDRESS_NOISE, line)
    return F.concat(_stripped(clean), F.lit(", "), city_state_zip)


def company_name(establishment: Column) -> Column:
    """The leading words of a name without its legal form; a name that starts otherwise stays."""
    start = F.regexp_extract(establishment, r"(?U)^([\w\s,&.-]+)", 1)
    bare = F.regexp_replace(_stripped(start), r"(?i),? (Inc|LLC|Corp|Co)\.?$", "")
    return F.when(start != "", _stripped(bare)).otherwise(establishment)


def registration_label(c: Column) -> Column:
    """'Class A' and so on to the class letter, in this order; null otherwise."""
    return reduce(lambda chain, k: chain.when(c.contains(f"Class {k}"), k), "BCRTH", F.when(c.contains("Class A"), "A"))


def display_state(state: Column, dictionaries: list[dict[str, str]]) -> Column:
    """The name of a state in the first dictionary that knows it, else the code itself; blank gives ''."""
    found = [F.try_element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), state) for d in dictionaries]
    return F.when(F.trim(F.coalesce(state, F.lit(""))) == "", "").otherwise(F.coalesce(*found, state))


def country_by_box(lat: Column, lng: Column, country: Column, county: Column) -> Column:
    """A missing country from the Danish county or box, then the German box (borders are outside)."""
    inside = lambda s, n, w, e: (lat > s) & (lat < n) & (lng > w) & (lng < e)
    return F.when(filled(country).isNotNull(), country).when((county == "Denmark") | inside(54.5, 58, 8, 16), "dk").when(inside(47, 55.2, 5, 16), "de")


def ontario_type(slaughters: Column, processes: Column) -> Column:
    return F.when(slaughters == "1", "Slaughter").when(processes == "1", "Processing").otherwise("Other")


def ontario_animals(held=lambda name: F.col(f"`{name}`")) -> dict[str, Column]:
    """Flag columns of the species columns that hold '1'."""
    return _any([(flag, held(name) == "1") for name, flags in ONTARIO_SPECIES.items() for flag in flags])


def lab_row(name: Column, line1: Column, line2: Column, city_state_zip: Column) -> list[Column]:
    """A laboratory's export columns: the state is the first word after the first comma, the zip the last word."""
    place = F.coalesce(city_state_zip, F.lit(""))
    parts = F.split(place, ",")
    blank = lambda c: F.coalesce(c, F.lit(""))
    state = blank(F.get(F.split(_stripped(F.get(parts, F.lit(1))), " "), F.lit(0)))
    address = F.replace(_stripped(F.concat_ws(" ", blank(line1), blank(line2), place)), F.lit(" ,"), F.lit(","))
    return [
        F.lit("Lab").alias("Type"), blank(name).alias("Name"), state.alias("State"), _stripped(F.get(parts, F.lit(0))).alias("City"),
        F.element_at(F.split(place, r"\s+"), -1).alias("ZIP"), address.alias("Address"),
    ]


def inspection_row(licence: Column, name: Column, state: Column, line1: Column, city_state_zip: Column, lat: Column, lng: Column, certificate: Column) -> list[Column]:
    """An inspection's export columns: the licence's last word as type, the address without a comma at either end."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    place = blank(city_state_zip)
    kind = F.when(licence == "Class A - Breeder", "Breeder").when(licence == "Class B - Dealer", "Dealer").when(licence == "Class C - Exhibitor", "Exhibitor").otherwise("Other")
    return [
        kind.alias("Type"), blank(name).alias("Name"), blank(state).alias("State"), _stripped(F.get(F.split(place, ","), F.lit(0))).alias("City"),
        F.element_at(F.split(place, r"\s+"), -1).alias("ZIP"), _stripped(F.regexp_replace(F.concat(blank(line1), F.lit(", "), place), r"^,|,\z", "")).alias("Address"),
        blank(lat).alias("Latitude"), blank(lng).alias("Longitude"), blank(certificate).alias("CertificateNumber"),
    ]


def facility_row(layer: str, dictionaries: list[dict[str, str]], name: str = "establishment_name") -> list[Column]:
    """A facility's export columns from the location table: the label's key as type, or the layer's name where there is no type.

    The label of a mixed farm is no text in the export, but an object.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    key, suffix, *_ = facility_type(F.col("type"))
    layers = {"breeding": "Production Facility", "exhibition": "Exhibition Facility", "slaughter": "Slaughterhouse", "processing": "Processing"}
    label = F.when(blank("type") == "", layers.get(layer, "Facility")).when(suffix != "", "[object Object]").otherwise(key)
    state = display_state(_stripped(blank("state")), dictionaries)
    number = lambda c: F.when(F.col(c) != 0, F.col(c).cast("string")).otherwise("")
    return [
        label.alias("Type"), blank(name).alias("Name"), display_state(F.col("state"), dictionaries).alias("State"), blank("city").alias("City"), blank("zip").alias("ZIP"),
        facility_address(F.col("street"), F.col("city"), state, F.col("zip")).alias("Address"), number("latitude").alias("Latitude"), number("longitude").alias("Longitude"),
        blank("establishment_id").alias("EstablishmentID"), blank("phone").alias("Phone"), blank("animals_processed").alias("AnimalsProcessed"), blank("animals_slaughtered").alias("AnimalsSlaughtered"),
    ]


def facility_address(street: Column, city: Column, state_name: Column, zip_code: Column) -> Column:
    """Street, city, state and zip; nothing without a street."""
    state = F.when(F.coalesce(state_name, F.lit("")) != "", F.concat(F.lit(", "), state_name)).otherwise("")
    whole = F.concat(_stripped(street), F.lit(", "), _stripped(F.coalesce(city, F.lit(""))), state, F.lit(" "), F.coalesce(zip_code, F.lit("")))
    return F.when(filled(street).isNotNull(), F.replace(whole, F.lit(" ,"), F.lit(","))).otherwise("")


#: Parentheses within parentheses that are translated.
LEVELS = 5


def translated_list(c: Column, words: dict[str, str], levels: int = LEVELS) -> Column:
    """The items of a list in other words: 'Main (list)', '<number> item' or 'item'; plurals fall back to singulars, unknown items stay.

    Lists in parentheses are translated ``levels`` deep; what lies deeper stays.
    """
    table = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])

    def item(x: Column) -> Column:
        key = F.lower(x)
        return F.coalesce(F.try_element_at(table, key), F.when(key.endswith("s"), F.try_element_at(table, F.regexp_replace(key, "s$", ""))), x)

    def counted(x: Column) -> Column:
        number = r"(?s)^(\d+)\s+(.+)$"
        return F.when(x.rlike(number), F.concat(F.regexp_extract(x, number, 1), F.lit(" "), item(F.regexp_extract(x, number, 2)))).otherwise(item(x))

    def listed(text: Column, left: int) -> Column:
        return F.array_join(F.transform(outer_commas(text), lambda x: whole(x, left)), ", ")

    def whole(x: Column, left: int) -> Column:
        group = r"(?s)^([^(]+)\s*\((.*)\)$"
        if not left:
            return counted(x)
        inner = listed(F.regexp_extract(x, group, 2), left - 1)
        return F.when(x.rlike(group), F.concat(item(_stripped(F.regexp_extract(x, group, 1))), F.lit(" ("), inner, F.lit(")"))).otherwise(counted(x))

    return F.when(c == "", c).otherwise(listed(c, levels))


def url_part(c: Column) -> Column:
    """URL-encoded with %20 for blanks."""
    return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))


def html_rows(html: Column, cells: int | None = None, skip: int = 0) -> Column:
    """Rows of cell texts of all tables in a page, but the first ``skip``; with ``cells``, only rows of so many."""
    rows = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1), lambda r: F.transform(
        F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), 1), lambda c: _stripped(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"\s+", " "))
    ))
    rows = F.slice(rows, skip + 1, F.greatest(F.size(rows), F.lit(1))) if skip else rows
    return F.filter(rows, lambda r: F.size(r) == cells) if cells else rows


def table_under(rows: Column, marker: str) -> list[Column]:
    """Header and body of rows: the first row with a cell that holds the marker, and what follows it."""
    has = F.transform(rows, lambda r: F.exists(r, lambda c: F.lower(c).contains(marker.lower())))
    at = F.array_position(has, True)
    return [F.when(at > 0, F.element_at(rows, at.cast("int"))).alias("header"), F.when(at > 0, F.slice(rows, (at + 1).cast("int"), F.size(rows))).alias("body")]
