"""Animal lists from flag columns and counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import NUMBER

#: Flag columns and their labels, in the order of the lists.
PROCESSING = {
    "beef": "Beef", "pork": "Pork", "antelope": "Antelope", "bison": "Bison", "buffalo": "Buffalo", "deer": "Deer", "elk": "Elk", "goat": "Goat",
    "other_voluntary_livestock": "Other Voluntary Livestock", "rabbit": "Rabbit", "reindeer": "Reindeer", "sheep": "Sheep", "yak": "Yak", "chicken": "Chicken",
    "duck": "Duck", "goose": "Goose", "pigeon": "Pigeon", "ratite": "Ratite (Ostrich/Emu)", "turkey": "Turkey", "exotic_poultry": "Exotic Poultry",
    "other_voluntary_poultry": "Other Voluntary Poultry",
}
SLAUGHTER = {
    "Cattle (Cows, Bulls)": ["beef_cow", "steer", "heifer", "bull_stag", "dairy_cow"],
    "Calves (Veal)": ["heavy_calf", "bob_veal", "formula_fed_veal", "non_formula_fed_veal"],
    "Pigs": ["market_swine", "sow", "roaster_swine", "boar_stag_swine", "stag_swine", "feral_swine"],
    "Goats": ["goat", "young_goat", "adult_goat"], "Sheep & Lambs": ["sheep", "lamb"], "Deer & Reindeer": ["deer_reindeer"], "Antelope": ["antelope"], "Elk": ["elk"],
    "Bison & Buffalo": ["bison", "buffalo", "water_buffalo", "cattalo"], "Yak": ["yak"], "Other Livestock": ["other_voluntary_livestock"], "Rabbits": ["rabbit"],
    "Chickens": ["young_chicken", "light_fowl", "heavy_fowl", "capon"],
    "Turkeys": ["young_turkey", "young_breeder_turkey", "old_breeder_turkey", "fryer_roaster_turkey"],
    "Ducks": ["duck"], "Geese": ["goose"], "Pheasants": ["pheasant"], "Quail": ["quail"], "Guinea Fowl": ["guinea"],
    "Ratites (Ostrich, Emu, etc.)": ["ostrich", "emu", "rhea"], "Pigeons (Squab)": ["squab"], "Other Poultry": ["other_voluntary_poultry"],
}
TESTED = ["Dogs", "Cats", "Guinea Pigs", "Hamsters", "Rabbits", "Non-Human Primates", "Sheep", "Pigs", "Other Farm Animals", "All Other Animals"]


def labels(flags: list[tuple[Column, str]], none: str) -> Column:
    """Labels of the true flags in order, or ``none``."""
    return F.coalesce(F.nullif(F.concat_ws(", ", *[F.when(c, F.lit(n)) for c, n in flags]), F.lit("")), F.lit(none))


def processed(given: Column, flag=lambda name: F.col(f"{name}_processing")) -> Column:
    return F.when(given != "", given).otherwise(labels([(flag(k) == "Yes", v) for k, v in PROCESSING.items()], "N/A"))


def slaughtered(given: Column, flag=lambda name: F.col(f"{name}_slaughter")) -> Column:
    groups = [(reduce(lambda a, b: a | b, [flag(k) == "Yes" for k in names]), label) for label, names in SLAUGHTER.items()]
    return F.when(given != "", given).otherwise(labels(groups, ""))


def tested(counts: list[tuple[Column, str]]) -> Column:
    """'<whole number> <label>' of the counts above 0 in order, or 'Unknown'; anything but a plain number is skipped."""
    items = []
    for c, name in counts:
        n = F.when(c.rlike(NUMBER), c).try_cast("float")
        items.append(F.when(n > 0, F.concat(F.least(F.floor(n.cast("double")), F.lit(2147483647)).cast("int").cast("string"), F.lit(f" {name}"))))
    return F.coalesce(F.nullif(F.concat_ws(", ", *items), F.lit("")), F.lit("Unknown"))
