"""Operator 8, benchmark decontamination over templates.

Texts become templates: numbers, names and units turn into typed placeholders,
other words are lower-cased.  Windows of the templates are hashed and joined:
a bitmap of the benchmark's hashes (of fixed size) goes to all tasks and leaves
only windows that can match; those are joined by hash.  Matched windows that lie
equally far apart in document and item are one alignment, and the slots of each
alignment are compared: a document matches when in some alignment each
placeholder of the item stands for one value in the document and the other way
round, so that a question with other numbers or names is still caught, also
beside the original, and windows that only share the shape are not.  Windows
whose slots hold the item's own values are verbatim and match by themselves; in
an alignment that is not consistent they alone count.

A name is a capitalised word inside a sentence; a unit is one of ``UNITS`` after
a number.  How the first words of a passage read so hangs on what stands before
it; each window of an item is therefore hashed under all its readings
(``CONTEXTS``), and a first word that only then is a placeholder must be the same
word in the document.  A window with fewer than ``MIN_LITERAL`` words that are no
placeholders is hashed by its exact words: only verbatim copies match it.

Defined results: null and empty texts match nothing; an item with fewer words
than a window is one shorter window of its own length; the rows of an id, null
included, count as one document, and those of an item id as one item; of several
alignments of a document and an item the one with most windows is told, of equal
ones that with more slots; an empty benchmark gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, staged

WINDOW, MIN_LITERAL, FILTER_BITS = 10, 5, 1 << 24
TOKEN = re.compile(r"[+-]?\d[\d.,:/]*|[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?\n]|[^\s\w]|_")
#: Unit words and signs.
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg t lb oz ml l gal s sec min h hr ms hz khz mhz ghz b kb mb gb tb w kw mw kwh v a j kj cal kcal pa kpa bar k c f "
    "meter meters metre metres kilometer kilometers kilometre kilometres mile miles foot feet inch inches gram grams kilogram kilograms pound pounds ounce ounces "
    "liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros percent degree degrees % $ € £ °".split()
)
#: What a token may be, as bits.
NUMBER, WORD, ENDS, UNIT, TITLED = 1, 2, 4, 8, 16
PLACES = ["", "<number>", "<unit>", "<name>"]
PLACE_HASHES = np.array([xxhash.xxh64_intdigest(p.encode()) for p in PLACES], np.uint64)
#: Texts are taken together up to so many characters.
GROUP_CHARS = 200_000
#: What may stand before a passage, with its number of words: a sentence's start or none, a number or none.
CONTEXTS = [("", 0), ("x ", 1), ("1 ", 1), ("1. ", 1)]
SCHEMA = "doc_id long, hash long, slots string, size int, place int, reread boolean"


class Tokens(dict):
    """Places of tokens in three arrays: what a token may be, and the hashes of its lower-cased form and of its value."""

    def __init__(self):
        self.flags, self.hashes, self.values = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.uint64)

    def __missing__(self, token: str) -> int:
        i, lower = len(self), token.lower()
        if i == len(self.flags):
            self.flags, self.hashes, self.values = (np.concatenate([x, np.zeros_like(x)]) for x in (self.flags, self.hashes, self.values))
        if token[-1].isdigit() or token[0].isdigit() or (token[0] in "+-" and len(token) > 1):
            flags = NUMBER | (ENDS if token[-1] == "." else 0)
        else:
            flags = (WORD if token[0].isalpha() else ENDS if token in ".!?\n" else 0) | (UNIT if lower in UNITS else 0)
            flags |= TITLED if token[0].isupper() and token[1:].islower() else 0
        self.flags[i], self.hashes[i] = flags, xxhash.xxh64_intdigest(lower.encode())
        self.values[i] = xxhash.xxh64_intdigest(value(lower, flags & NUMBER).encode())
        self[token] = i
        return i

    def templates(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All tokens; of each word of the templates its text, the token's place, its kind (0: literal), its hash and its value's."""
        if len(self) > 300_000:
            self.clear()
        tokens, sizes = [], []
        for text in texts:
            tokens += TOKEN.findall(text or "")
            tokens.append("\n")  # a line feed is no word and lets nothing pass from text to text
            sizes.append(len(tokens))
        n = len(tokens)
        at = np.fromiter(map(self.__getitem__, tokens), np.int64, n)
        flags = self.flags[at]
        number, ends = flags & NUMBER > 0, flags & ENDS > 0
        unit = flags & UNIT > 0
        unit[1:] &= number[:-1]
        unit[:1] = False
        word = (flags & WORD > 0) & ~unit
        # A sentence starts at the text's start and where the last number, word or sign of an end before says so.
        last = np.maximum.accumulate(np.where(number | word | ends, np.arange(1, n + 1), 0))
        start = np.concatenate([[True], ends])[np.concatenate([[0], last])[:n]]
        kind = np.where(number, 1, np.where(unit, 2, np.where(word & (flags & TITLED > 0) & ~start, 3, 0)))
        out = np.flatnonzero(number | unit | word)
        kind = kind[out]
        return tokens, np.searchsorted(sizes, out, "right"), out, kind, np.where(kind > 0, PLACE_HASHES[kind], self.hashes[at[out]]), self.values[at[out]]


def value(token: str, number: int) -> str:
    return token.rstrip(".,:/") if number else token.lower()


def slot(token: str, kind: int) -> str:
    """The placeholder and the value that it stands for; nothing for a literal word."""
    return PLACES[kind] + value(token, kind == 1) if kind else ""


def window_hashes(words: np.ndarray, size: int, at: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of all windows of ``size`` words, by Horner's rule over the words' hashes; with ``at``, others of the windows there."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, size, np.uint64) if at is None else np.full(len(at), size + 256, np.uint64)
    for k in range(size):
        out = (out ^ (words[k : k + n] if at is None else words[at + k])) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _windows(texts: list[str | None], sizes: list[int], known: Tokens, allowed: np.ndarray | None) -> Iterator[tuple[int, int, str, int, int]]:
    """Number of the text, hash, slots, size and place of windows; those poor in literals have the hash of their values and no slots."""
    tokens, of, out, kind, hashes, values = known.templates(texts)
    literal = np.concatenate([[0], np.cumsum(kind == 0)])
    first = np.searchsorted(of, np.arange(len(texts)))
    for size in sizes:
        h = window_hashes(hashes, size)
        if not len(h):
            continue
        keep = of[size - 1 :] == of[: len(h)]
        poor = keep & (literal[size:] - literal[:-size] < MIN_LITERAL)
        at = np.flatnonzero(poor)
        h[at] = window_hashes(values, size, at)
        if allowed is not None:
            bit = h & np.uint64(FILTER_BITS - 1)
            keep &= (allowed[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
        for i in np.flatnonzero(keep):
            slots = "\x1f" * (size - 1) if poor[i] else "\x1f".join(slot(tokens[j], k) for j, k in zip(out[i : i + size], kind[i : i + size], strict=True))
            yield int(of[i]), int(h[i].astype(np.int64)), slots, size, int(i - first[of[i]])


def _item_windows(text: str | None, known: Tokens) -> Iterator[tuple[str, int, int, int, bool]]:
    """Hash, slots, size, place of an item's windows, or of the whole of it if it is short; then (reread) those of their other readings."""
    spans = [m.span() for m in TOKEN.finditer(text or "")]
    out = known.templates([text])[2]
    size = min(WINDOW, len(out))
    if not size:
        return
    seen = set()
    for _, h, slots, _, place in _windows([text], [size], known, None):
        seen.add((h, slots, place))
        yield h, slots, size, place, False
    parts = [text[spans[a][0] : spans[b][1]] for a, b in zip(out, out[size - 1 :], strict=False)]
    for before, lead in CONTEXTS:
        for begin, end in _groups(parts, GROUP_CHARS):
            for k, h, slots, _, place in _windows([before + p for p in parts[begin:end]], [size], known, None):
                if place == lead and (h, slots, begin + k) not in seen:
                    seen.add((h, slots, begin + k))
                    yield h, slots, size, begin + k, True


def _groups(texts: list[str | None], chars: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``chars`` characters together; a longer text stands alone."""
    begin, held = 0, 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if held + n > chars and i > begin:
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(texts):
        yield begin, len(texts)


def _windows_of(frame: DataFrame, key: str, sizes: list[int] | None, allowed) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bits = Tokens(), None if allowed is None else np.frombuffer(allowed.value, np.uint8)
        for batch in batches:
            ids, texts = (c.to_pylist() for c in batch.columns)
            if sizes is None:
                rows = [(i, *w) for i, text in zip(ids, texts, strict=True) for w in _item_windows(text, known)]
            else:
                rows = [(ids[a + k], *w, False) for a, b in _groups(texts, GROUP_CHARS) for k, *w in _windows(texts[a:b], sizes, known, bits)]
            if rows:
                yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["doc_id", "hash", "slots", "size", "place", "reread"]), pa.schema([("doc_id", pa.int64()), ("hash", pa.int64()), ("slots", pa.string()), ("size", pa.int32()), ("place", pa.int32()), ("reread", pa.bool_())]), preserve_index=False)

    return frame.select(F.col(key).cast("long").alias("doc_id"), "text").mapInArrow(frugal(cut), SCHEMA)


def _bitmap(windows: DataFrame) -> bytes:
    """The benchmark's hashes as a bitmap of ``FILTER_BITS`` bits, built from at most that many bit numbers."""
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    places = windows.select(F.expr(f"cast(hash & {FILTER_BITS - 1}L as int)").alias("bit")).distinct()
    for batch in places.toArrow().to_batches():
        bit = batch.column(0).to_numpy()
        np.bitwise_or.at(bits, bit >> 3, (1 << (bit & 7)).astype(np.uint8))
    return bits.tobytes()


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows, n_slots: one row per document and item that it contains, of the alignment with most windows."""
    spark = docs.sparkSession
    cut = _windows_of(benchmark, "item_id", None, None).withColumnRenamed("doc_id", "item_id")
    # A window that an item repeats stands at its first place only, so that repetitive items meet each window of a document once.
    # The item's own reading goes before others.
    items = cut.groupBy("item_id", "hash", "size", F.col("slots").alias("item_slots")).agg(F.min(F.struct("reread", "place")).alias("at")).select("item_id", "hash", "size", "item_slots", F.col("at.place").alias("item_place"), "at.reread")
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # WINDOW numbers at most
    allowed = spark.sparkContext.broadcast(_bitmap(items))
    found = _windows_of(docs, "doc_id", sizes, allowed).drop("reread").distinct()
    # Windows that only share the bitmap's bit go in the join; hot windows of one hash are few per document.
    # Two aggregates read them, so they are written: the documents are cut into windows once.
    first_word = lambda c: F.substring_index(c, "\x1f", 1)
    fits = ~F.col("reread") | (first_word("slots") == first_word("item_slots"))
    pairs = staged(found.join(items, ["hash", "size"]).where(fits).drop("reread").withColumn("offset", F.col("place") - F.col("item_place")), "matched-windows")
    key = ["doc_id", "item_id", "offset"]
    same = F.col("slots") == F.col("item_slots")
    windows = pairs.groupBy(*key, "hash").agg(F.max(same.cast("int")).alias("same")).groupBy(*key).agg(F.count("*").alias("n_windows"), F.sum("same").alias("same_windows"))
    plain = F.regexp_replace("slots", "\x1f", "") == ""
    slots = pairs.where(~plain).select(*key, same.cast("int").alias("same"), F.explode(F.arrays_zip(F.split("slots", "\x1f").alias("d"), F.split("item_slots", "\x1f").alias("i"))).alias("z")).where("z.i <> ''").groupBy(*key, F.col("z.d").alias("d"), F.col("z.i").alias("i")).agg(F.max("same").alias("same"))
    ambiguous = slots.groupBy(*key).agg(F.count("*").alias("pairs"), F.countDistinct("d").alias("values"), F.countDistinct("i").alias("n_slots"), F.sum("same").alias("same_slots"))
    told = ambiguous.withColumnsRenamed({c: f"_{c}" for c in key})
    alike = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key])  # an id may be null
    judged = windows.join(told, alike, "left").drop(*[f"_{c}" for c in key]).fillna(0, ["pairs", "values", "n_slots", "same_slots"])
    consistent = (F.col("pairs") == F.col("values")) & (F.col("pairs") == F.col("n_slots"))
    counted = F.when(consistent, F.struct("n_windows", "n_slots")).when(F.col("same_windows") > 0, F.struct(F.col("same_windows").alias("n_windows"), F.col("same_slots").alias("n_slots")))
    judged = judged.withColumn("counted", counted).where(F.col("counted").isNotNull())
    return judged.groupBy("doc_id", "item_id").agg(F.max("counted").alias("best")).select("doc_id", "item_id", "best.n_windows", "best.n_slots")
