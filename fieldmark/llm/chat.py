r"""Operator 6, chat formatting with a grammar round trip (DataFrame functions only).

A conversation becomes ``<s>`` and its turns: ``[INST] text [/INST]`` for a
user, `` text</s>`` for an assistant, ``[ROLE]role[/ROLE] text[/TURN]`` for any
other role.  One regular expression reads it back.  Control strings inside texts
are escaped (a backslash goes into each and before each backslash).  Each
conversation is rendered, parsed and compared with its source; where they differ
every ``<``, ``[`` and ``\`` is escaped, and a conversation that still differed
would fail the query.  The parser always
unescapes, so no flag is needed.

Defined results: rows are ordered by turn, then role, then text (nulls first);
a null role or text is empty; repeated rows are turns of their own; extra
columns are ignored.  A conversation is one value, so its turns meet in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN = r"(?s)\[INST\] (.*?) \[/INST\]| (.*?)</s>|\[ROLE\](.*?)\[/ROLE\] (.*?)\[/TURN\]"
CONTROL = r"(<)(/?s>)|(\[)(/?INST\]|/?ROLE\]|/TURN\])"
START = "<s>"


def escape(text: Column, level: int) -> Column:
    if level == 2:
        return F.regexp_replace(text, r"([\\<\[])", r"\\$1")
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1$3\\$2$4")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _turn(role: Column, text: Column, level: int) -> Column:
    body = escape(text, level)
    other = F.concat(F.lit("[ROLE]"), escape(role, level), F.lit("[/ROLE] "), body, F.lit("[/TURN]"))
    return F.when(role == "user", F.concat(F.lit("[INST] "), body, F.lit(" [/INST]"))).when(role == "assistant", F.concat(F.lit(" "), body, F.lit("</s>"))).otherwise(other)


def render(turns: Column, level: int) -> Column:
    return F.concat(F.lit(START), F.array_join(F.transform(turns, lambda t: _turn(t["role"], t["text"], level)), ""))


def _read(piece: Column, user: Column, assistant: Column, role: Column, other: Column) -> Column:
    is_user, is_other = piece.startswith("[INST] "), piece.startswith("[ROLE]")
    return F.struct(
        F.when(is_user, "user").when(is_other, unescape(role)).otherwise("assistant").alias("role"),
        unescape(F.when(is_user, user).when(is_other, other).otherwise(assistant)).alias("text"),
    )


def parse(formatted: Column) -> Column:
    """The turns that the grammar finds; null if they do not cover the whole text."""
    pieces, *groups = [F.regexp_extract_all(formatted, F.lit(TURN), F.lit(k)) for k in range(5)]
    whole = (F.substring(formatted, 1, len(START)) == START) & (F.length(formatted) == len(START) + F.length(F.array_join(pieces, "")))
    zipped = F.arrays_zip(pieces.alias("p"), *[g.alias(f"g{k}") for k, g in enumerate(groups)])
    return F.when(whole, F.transform(zipped, lambda z: _read(*[z[k] for k in ("p", "g0", "g1", "g2", "g3")])))


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (as read back), loss_spans (start, end) and loss_text per conversation."""
    source = F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    chats = conversations.groupBy("conv_id").agg(source.alias("source")).withColumn("source", F.transform("source", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    fits = lambda level: F.coalesce(parse(render(F.col("source"), level)) == F.col("source"), F.lit(False))
    failed = F.raise_error(F.lit("a conversation does not survive its round trip")).cast("string")
    formatted = F.when(fits(1), render(F.col("source"), 1)).when(fits(2), render(F.col("source"), 2)).otherwise(failed)
    done = chats.select("conv_id", formatted.alias("formatted"))
    pieces = done.select("conv_id", F.col("formatted"), F.posexplode(F.regexp_extract_all("formatted", F.lit(TURN), F.lit(0))).alias("pos", "piece"))
    end = F.sum(F.length("piece").cast("long")).over(Window.partitionBy("conv_id").orderBy("pos")) + len(START)
    is_loss = F.col("piece").startswith(" ")
    spans = pieces.select(
        "conv_id", "pos", F.when(F.col("pos") == 0, F.col("formatted")).alias("formatted"),
        F.when(is_loss, F.struct((end - F.length("piece") + 1).alias("start"), (end - 4).alias("end"))).alias("span"),
        F.when(is_loss, unescape(F.expr("substring(piece, 2, length(piece) - 5)"))).alias("loss"),
    )
    rows = F.sort_array(F.collect_list(F.struct("pos", "span", "loss")))
    merged = spans.groupBy("conv_id").agg(F.max("formatted").alias("formatted"), rows.alias("rows"))
    kept = F.filter("rows", lambda r: r["span"].isNotNull())
    return merged.select(
        "conv_id", "formatted", parse(F.col("formatted")).alias("turns"),
        F.transform(kept, lambda r: r["span"]).alias("loss_spans"), F.array_join(F.transform(kept, lambda r: r["loss"]), "").alias("loss_text"),
    )
