"""Small tables with every awkward case, for the tests of the operators."""

import duckdb

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, slots string, bucket int, runs string, _id long, vertex string"
TEXTS = [None, "", " \t", "one", "One two", "b c d e f g h\nb c d e f g h\n\nlast", "b c d e f g h\nb c d e f g h\n\nlast", "word " * 40_000, "x" * 100_000, "naïve ▁ text\x00 😀\r\n", "</s> [INST] \\ <s>"]


def rows(texts):
    return [(i, t, "en", "s", len(t or ""), 0.5, "s", 1, "r", 7, "v") for i, t in enumerate(texts)]


def frame(spark, texts):
    return spark.createDataFrame(rows(texts), SCHEMA)


def awkward(spark):
    """All texts, a repeated row, an id with two texts, and a null id; extra columns clash with internal names."""
    more = [(5, TEXTS[5]), (5, "another text"), (None, "no id"), (None, None)]
    return frame(spark, TEXTS).union(spark.createDataFrame([(i, t, None, None, None, None, None, None, None, None, None) for i, t in more], SCHEMA))


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def duck(sf_dir=SF):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels", "conversations"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con
