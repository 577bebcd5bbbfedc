"""Operator 12, compression of vectors to codes: Lloyd rounds with Hamerly's bounds.

Components become integers floor(256 * x).  A vector is cut into ``PARTS`` equal
consecutive parts, and every part position has a codebook of ``ENTRIES``
entries, at first those parts of the rows with the smallest ids.  A round
assigns each part to its nearest entry and replaces the entries by the floored
means of their parts.  All distances that decide are exact integers.

The staged table keeps, for every part, its entry, an upper bound of the
distance to it and one lower bound of the distance to the second nearest.  When
the entries have moved, both are loosened by the movements; where the upper
bound is strictly below the lower one (or below half the way from the entry to
its nearest neighbour) the entry stands, even after rounding; else the upper
bound is made exact; and only where that is not enough all entries are measured.
Equal distances fail the strict test, so that a scan gives them to the lower
index.  Tasks add up their parts per entry; the driver sees ``PARTS * ENTRIES``
sums, never a row.

Defined results: vectors that are null or hold null or non-finite components
take no part, nor do those of another dimension than the most frequent one (the
larger of equally frequent ones) or with components beyond ``limit``, whose
squares 64-bit integers could not add up.  Null ids come after all others;
repeated rows are coded each, and equal ids stand in the order of their vectors;
with fewer rows than ``ENTRIES`` a codebook has fewer entries.  A dimension that
``PARTS`` does not divide is cut at floor(i * dimension / PARTS).  Empty tables
give no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows whose distances are measured at once; how far bounds are put outward, above the rounding of float32.
ROWS_AT_ONCE, OUTWARD = 2048, 1e-6
STATE = "vec_id long, label string, ints array<int>, code binary, upper binary, lower binary, scans int, error long"


def limit(dim: int) -> int:
    return min(isqrt((1 << 61) // max(dim, 1)), (1 << 31) - 1)


def kept(vectors: DataFrame) -> DataFrame:
    """vec_id, label and ints of the rows that take part."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.col("label").cast("string") if "label" in vectors.columns else F.lit(None).cast("string")
    rows = vectors.where(F.col("embedding").isNotNull() & F.coalesce(sound, F.lit(False)))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE)).alias("ints"))
    sizes = rows.groupBy(F.size("ints").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    dim = sizes[0]["dim"] if sizes else 0
    fits = F.forall("ints", lambda x: F.abs(x) <= limit(dim))
    return rows.where((F.size("ints") == dim) & fits).withColumn("ints", F.col("ints").cast("array<int>"))


def cuts(dim: int) -> list[tuple[int, int]]:
    edges = [i * dim // PARTS for i in range(PARTS + 1)]
    return list(zip(edges, edges[1:], strict=False))


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row to every entry."""
    out = np.zeros((len(x), len(entries)), np.int64)
    for j in range(x.shape[1]):
        step = x[:, j, None] - entries[None, :, j]
        out += step * step
    return out


def scan(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry (the lower of equal ones), its distance and the second nearest's, as bounds."""
    code, upper, lower = np.empty(len(x), np.int64), np.empty(len(x)), np.full(len(x), np.inf)
    for k in range(0, len(x), ROWS_AT_ONCE):
        d = squares(x[k : k + ROWS_AT_ONCE], entries)
        at, rows = d.argmin(1), np.arange(len(d))
        code[k : k + len(d)], upper[k : k + len(d)] = at, np.sqrt(d[rows, at])
        if len(entries) > 1:
            d[rows, at] = np.iinfo(np.int64).max
            lower[k : k + len(d)] = np.sqrt(d.min(1))
    return code, upper * (1 + OUTWARD), lower * (1 - OUTWARD)


class Moved:
    """How far the entries of one part position went, and how far they now lie apart."""

    def __init__(self, before: np.ndarray, now: np.ndarray):
        way = np.sqrt(((now - before).astype(float) ** 2).sum(1)) * (1 + OUTWARD)
        self.own, order = way, np.argsort(-way)
        self.others = np.full(len(way), way[order[0]])  # the farthest way of another entry
        self.others[order[0]] = way[order[1]] if len(way) > 1 else 0.0
        apart = squares(now, now).astype(float)
        np.fill_diagonal(apart, np.inf)
        self.half = np.sqrt(apart.min(1)) / 2 * (1 - OUTWARD)


def assign(x: np.ndarray, entries: np.ndarray, moved: Moved | None = None, code: np.ndarray | None = None, upper: np.ndarray | None = None, lower: np.ndarray | None = None):
    """Codes and bounds of the parts ``x``, and where all entries were measured."""
    if moved is None:
        return *scan(x, entries), np.ones(len(x), bool)
    upper, lower = (upper + moved.own[code]) * (1 + OUTWARD), (lower - moved.others[code]) * (1 - OUTWARD)
    lower = np.maximum(lower, 0)
    bound, code = np.maximum(lower, moved.half[code]), code.copy()
    open_ = np.flatnonzero(~(upper < bound))
    step = x[open_] - entries[code[open_]]
    upper[open_] = np.sqrt((step * step).sum(1)) * (1 + OUTWARD)
    open_ = open_[~(upper[open_] < bound[open_])]
    code[open_], upper[open_], lower[open_] = scan(x[open_], entries)
    scanned = np.zeros(len(x), bool)
    scanned[open_] = True
    return code, upper, lower, scanned


def integers(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def fixed(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), PARTS)


def assigned(rows: DataFrame, dim: int, books: list[np.ndarray], before: list[np.ndarray] | None, name: str) -> DataFrame:
    """The staged state after one assignment; ``before`` are the entries that the bounds in ``rows`` hold for."""
    shipped = rows.sparkSession.sparkContext.broadcast((books, before))  # PARTS * ENTRIES entries at most

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, before = shipped.value
        moved = [Moved(b, n) for b, n in zip(before, books, strict=True)] if before else [None] * PARTS
        for batch in batches:
            if not len(batch):
                continue
            x = integers(batch.column("ints"), dim)
            old = [fixed(batch.column(n), k) for n, k in (("code", np.uint8), ("upper", np.float32), ("lower", np.float32))] if before else None
            code, upper, lower = np.empty((len(x), PARTS), np.uint8), np.empty((len(x), PARTS)), np.empty((len(x), PARTS))
            scans, error = np.zeros(len(x), np.int32), np.zeros(len(x), np.int64)
            for p, (a, b) in enumerate(cuts(dim)):
                held = (old[0][:, p].astype(np.int64), old[1][:, p].astype(float), old[2][:, p].astype(float)) if old else ()
                code[:, p], upper[:, p], lower[:, p], scanned = assign(x[:, a:b], books[p], moved[p], *held)
                scans += scanned
                way = x[:, a:b] - books[p][code[:, p]]
                error += (way * way).sum(1)
            upper, lower = (upper * (1 + OUTWARD)).astype(np.float32), (lower * (1 - OUTWARD)).astype(np.float32)
            cells = [pa.array([r.tobytes() for r in cells], pa.binary()) for cells in (code, upper, lower)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("ints"), *cells, pa.array(scans), pa.array(error)], [c.split()[0] for c in STATE.split(", ")])

    return staged(rows.mapInArrow(step, STATE), name)


def replaced(state: DataFrame, dim: int, books: list[np.ndarray]) -> list[np.ndarray]:
    """The floored means of each entry's parts; unused entries stay."""
    width, size = max((b - a for a, b in cuts(dim)), default=0), max(len(b) for b in books)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((PARTS, size), np.int64), np.zeros((PARTS, size, width), np.int64)
        for batch in batches:
            x, code = integers(batch.column("ints"), dim), fixed(batch.column("code"), np.uint8)
            for p, (a, b) in enumerate(cuts(dim)):
                n[p] += np.bincount(code[:, p], minlength=size)
                np.add.at(total[p, :, : b - a], code[:, p], x[:, a:b])
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), pa.array(total[part, entry].tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

    sums = state.select("ints", "code").mapInArrow(add, "part int, entry int, n long, total array<long>")
    out = [b.copy() for b in books]
    for r in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("total", F.lit(j))).alias(f"t{j}") for j in range(width)]).collect():
        out[r["part"]][r["entry"]] = [r[f"t{j}"] // r["n"] for j in range(out[r["part"]].shape[1])]
    return out


def learn_codes(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[DataFrame, list[np.ndarray]]:
    """(state, codebooks): the columns of ``STATE`` for every row that takes part, and the final codebooks."""
    rows = staged(kept(vectors), "vector-parts")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).select("ints").collect()
    dim = len(first[0]["ints"]) if first else 0
    table = np.array([r["ints"] for r in first], np.int64).reshape(len(first), dim)
    books = [table[:, a:b] for a, b in cuts(dim)]
    if not first:
        return rows.sparkSession.createDataFrame([], STATE), books
    state, before = rows, None
    for k in range(rounds + 1):
        done = assigned(state, dim, books, before, f"vector-codes-{k}")
        discard(state)
        state, before = done, books
        if k < rounds:
            books = replaced(state, dim, books)
    return state, books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error and codebooks_sha256."""
    state, books = learn_codes(vectors)
    rows = state.select("vec_id", "label", F.lower(F.hex("code")).alias("code"), "error")
    total = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return rows.join(total, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
