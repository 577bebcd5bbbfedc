"""Operator 9, n-gram Jaccard join by partitioning the universe of shingles.

The pigeonhole: two sets of a size band with similarity p/q or more differ in at
most H shingles.  Shingles hash into m segments, and segment i gets a weight v_i
of 1 or 2 with sum(v) > H.  Then in some segment the two sets differ in fewer
than v_i shingles: their subsets are equal, or (weight 2) one is the other less
one shingle.  So a set is indexed by the hash of its subset of each segment and,
at weight 2, by those of all its one-deletion neighbours.  ``allocate`` picks m
and the weights for each band from the cost of index entries and of the chance
candidates expected among the band's sets.

Subsets that are empty say nothing, so they are left out while the weights of
the others still exceed H; a set for which they do not (rare: the sum has slack
for the expected number) indexes its empty subsets too.  Of two such sets both
do, and of any other pair one has a non-empty subset that both index: no pair
is lost.

Equal sets collapse to one vertex first.  Vertices that share an entry form a
bucket; equal buckets collapse.  Pairs are ruled out by size and by profile: the
distance of two profiles (``BINS`` counts of a set's hashes) is at most the
number of shingles in which the sets differ, so nothing that is similar is ruled
out.  Only sets of pairs that pass ever travel.

1. Stars: each vertex is compared with the first vertex of each of its buckets.
2. Buckets that then still span several components are searched in tasks for
   pairs across components that size and profile allow.  A task returns no pairs
   but the forest that connects them; its trees are groups.
3. The sets of a group meet, are compared exactly across components, and the
   task returns the links that merge components, no others.

Large buckets and groups are dealt in blocks.  Their main component is cut into
blocks of its own that meet the other components' vertices but not each other,
so that a group of near copies which a star has already connected costs its size
and not its square.

Defined results: documents without words are linked with nothing; rows with one
doc_id are one document (they share a component); a null doc_id links with
nothing and has a null component; extra columns are ignored.  Shingles are
compared as 64-bit hashes.  Sets are named by 64-bit keys; a second key tells
when two sets got one name, and all are then named anew under another seed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, distinct, frugal, staged
from .components import component_labels
from .shingles import WordHashes, mix, set_keys, shingle_set

#: Chance that two unrelated sets share what fills a segment, given that it is nearly empty.
COLLIDE = 1e-4
#: Buckets above so many vertices stream through without being compared with others.
LONG_RUN = 1_000_000
#: Sets that a task remembers to have indexed.
SEEN = 500_000
#: Counts in a set's profile; vertices in a block of a bucket; rows that small buckets share a task by.
BINS, BLOCK, PACK = 256, 2048, 5_000
#: Ids of vertices, 8 bytes each, that are sent to all tasks at most; beyond, texts are shuffled to them.
FEW = 500_000
#: Sets that meet in a task, and in a block of a larger group; pairs and rows that a task looks at together.
SETS, SLAB, ROWS = 512, 400_000, 500
SUMMARY = "doc_id long, n_shingles long, vertex long, other_key long, band int, profile binary"


class Bands:
    """Size bands: a set's partner is in its own band or in the next one."""

    def __init__(self, p: int, q: int):
        self.p, self.q, self.starts = p, q, [1]

    def of(self, size: int) -> int:
        while self.starts[-1] <= size:
            self.starts.append(self.q * self.starts[-1] // self.p + 1)
        return int(np.searchsorted(self.starts, size, "right")) - 1

    def range(self, band: int) -> tuple[int, int, int]:
        """Least size, largest size of the smaller set and largest size of its partner."""
        while len(self.starts) < band + 2:
            self.starts.append(self.q * self.starts[-1] // self.p + 1)
        largest = self.starts[band + 1] - 1
        return self.starts[band], largest, self.q * largest // self.p


def allocate(bands: Bands, band: int, sets: int) -> tuple[int, int, int]:
    """(H, m, n2): the most that two sets differ, the segments, and how many of these have weight 2."""
    low, high, reach = bands.range(band)
    most = (bands.q - bands.p) * (high + reach) // (bands.q + bands.p)
    best = (math.inf, 1, 1)
    for m in sorted({max(1, round((most + 1) * f / 40)) for f in range(20, 81)}):
        load = low / m
        empty = 2 * m * math.exp(-load)
        need = most + 1 + (math.ceil(empty + 2 * math.sqrt(empty)) if empty > 0.02 else 0)
        n2 = max(0, need - m)
        if n2 <= m and need <= 2 * m:
            entries = m + n2 * load
            best = min(best, (entries + sets * m * math.exp(-load) * COLLIDE, m, n2))
    return most, best[1], best[2]


def segment_entries(shingles: np.ndarray, band: int, plan: tuple[int, int, int]) -> np.ndarray:
    """The index entries of a set in a band."""
    most, m, n2 = plan
    segment = ((shingles >> np.uint64(20)) % np.uint64(m)).astype(np.int64)
    count = np.bincount(segment, minlength=m)
    low = np.bincount(segment, (shingles & np.uint64(0xFFFFFFFF)).astype(float), m).astype(np.uint64)
    high = np.bincount(segment, (shingles >> np.uint64(32)).astype(float), m).astype(np.uint64)
    total = low + (high << np.uint64(32))
    name = mix(np.arange(m, dtype=np.uint64) + np.uint64(band << 32))
    filled = count > 0
    weight = np.ones(m, int)
    weight[:n2] = 2
    keep = filled if weight[filled].sum() > most else np.ones(m, bool)
    whole = mix(total + name)[keep]
    if not n2:
        return whole
    near = segment < n2
    return distinct(np.concatenate([whole, mix(total[segment[near]] - shingles[near] + name[segment[near]])]))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, as a row grows into many entries."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def profile(shingles: np.ndarray) -> bytes:
    return np.minimum(np.bincount((shingles >> np.uint64(40)).astype(np.int64) % BINS, minlength=BINS), 255).astype(np.uint8).tobytes()


def summarise(docs: DataFrame, size: int, p: int, q: int, seed: int = 0) -> DataFrame:
    """doc_id, n_shingles, vertex and other_key (keys of the set), size band and profile of every row."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bands = WordHashes(), Bands(p, q)
        for batch in slices(batches):
            sets = [shingle_set(hashes.of(t.as_py()), size) for t in batch.column("text")]
            n = [len(s) for s in sets]
            keys = [set_keys(s, seed) if len(s) else (None, None) for s in sets]
            columns = [n, [k for k, _ in keys], [k for _, k in keys], [bands.of(k) for k in n], [profile(s) if len(s) else None for s in sets]]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], ["doc_id", "n_shingles", "vertex", "other_key", "band", "profile"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(frugal(one), SUMMARY)


def index_entries(docs: DataFrame, size: int, p: int, q: int, plans: dict[int, tuple[int, int, int]], seed: int = 0) -> DataFrame:
    """entry, vertex: each distinct set of a task once, under its own band and the one below."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bands, seen = WordHashes(), Bands(p, q), set()
        for batch in slices(batches):
            found, keys = [], []
            for text in batch.column("text"):
                s = shingle_set(hashes.of(text.as_py()), size)
                if not len(s) or (key := set_keys(s, seed)[0]) in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()  # a set that comes again is written again, and found to be the same later
                seen.add(key)
                own = bands.of(len(s))
                for band in (own, own - 1):
                    if (plan := plans.get(band)) and plan[0] and len(s) <= bands.range(band)[2]:
                        found.append(segment_entries(s, band, plan))
                        keys.append(np.full(len(found[-1]), key))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(keys))], ["entry", "vertex"])

    return docs.where("doc_id is not null").select("text").mapInArrow(frugal(entries), "entry long, vertex long")


def buckets(entries: DataFrame) -> DataFrame:
    """bucket, vertex, first: the vertices that share an entry; equal buckets once."""

    def rows(name: np.ndarray, vertex: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(name), pa.array(vertex), pa.array(first)], ["bucket", "vertex", "first"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries arrive sorted; a run of an entry may go on in the next batch."""
        entry, vertex, long_run = np.empty(0, np.int64), np.empty(0, np.int64), None
        for batch in [*_chained(batches), None]:
            if batch is not None:
                entry, vertex = np.concatenate([entry, batch[0]]), np.concatenate([vertex, batch[1]])
            if not len(entry):
                continue
            fresh = np.concatenate([[True], (entry[1:] != entry[:-1]) | (vertex[1:] != vertex[:-1])])
            entry, vertex = entry[fresh], vertex[fresh]
            start = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]]))
            done = len(entry) if batch is None else start[-1]
            if batch is not None and done == 0 and len(entry) < LONG_RUN:
                continue
            if done == 0:  # a run too long to hold: it goes out as it comes, under the entry itself
                long_run = (entry[0], vertex[0]) if long_run is None or long_run[0] != entry[0] else long_run
                yield rows(entry[:-1], vertex[:-1], np.full(len(entry) - 1, long_run[1]))
                entry, vertex = entry[-1:], vertex[-1:]
                continue
            at, own = start[start < done], vertex[:done]
            n = np.diff(np.append(at, done))
            mixed = mix(own.view(np.uint64))
            name = np.repeat(mix(np.add.reduceat(mixed, at) + n.astype(np.uint64)).view(np.int64), n)
            first = np.repeat(own[at], n)
            if long_run is not None and entry[0] == long_run[0]:
                name[: n[0]], first[: n[0]], n[0] = entry[0], long_run[1], max(n[0], 2)
                many = np.repeat(n > 1, np.diff(np.append(at, done)))
            else:
                many = np.repeat(n > 1, n)
            long_run = None
            if many.any():
                yield rows(name[many], own[many], first[many])
            entry, vertex = entry[done:], vertex[done:]

    return entries.repartition("entry").sortWithinPartitions("entry", "vertex").mapInArrow(frugal(runs), "bucket long, vertex long, first long").distinct()


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Columns as arrays, several batches at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= 200_000:
            yield tuple(np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1))
            held = []
    if held:
        yield tuple(np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1))


def fits(pairs: DataFrame, vertices: DataFrame, p: int, q: int) -> DataFrame:
    """The pairs (a, b) that sizes and profiles do not rule out."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS).astype(np.int16) for c in ("pa", "pb"))
            n = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            keep = np.abs(x - y).sum(1) * (q + p) <= n * (q - p)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    side = lambda k: vertices.select(F.col("vertex").alias(k), F.col("n").alias(f"n{k}"), F.col("profile").alias(f"p{k}"))
    sized = pairs.join(side("b"), "b").join(side("a"), "a").where(q * F.least("na", "nb") >= p * F.greatest("na", "nb"))
    return sized.select("a", "b", "na", "nb", "pa", "pb").mapInArrow(frugal(near), "a long, b long")


def sets_of(docs: DataFrame, vertices: DataFrame, size: int, seed: int) -> DataFrame:
    """vertex and shingles (sorted 64-bit hashes) of the ``vertices`` (vertex, doc_id), read from their documents."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches):
            sets = [shingle_set(hashes.of(t.as_py()), size) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array([set_keys(s, seed)[0] if len(s) else None for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["vertex", "shingles"])

    ids = staged(vertices.select(F.col("doc_id").alias("_id")).distinct(), "wanted")
    chosen = F.broadcast(ids) if ids.count() <= FEW else ids
    texts = docs.selectExpr("cast(doc_id as long) as doc_id", "text").join(chosen, F.col("doc_id") == F.col("_id"), "left_semi").select("text")
    # An id in several rows has several sets; only those asked for stay, once.
    return texts.mapInArrow(frugal(one), "vertex long, shingles binary").join(vertices.select("vertex"), "vertex", "left_semi").dropDuplicates(["vertex"])


def shared_shingles(x: np.ndarray, y: np.ndarray) -> int:
    at = np.searchsorted(y, x)
    return int((y[np.minimum(at, len(y) - 1)] == x).sum())


def similar(pairs: DataFrame, sets: DataFrame, p: int, q: int) -> DataFrame:
    """The pairs (a, b) whose sets have q * intersection >= p * union."""

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = shared_shingles(x, y)
                keep.append(q * both >= p * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda k, c: sets.select(F.col("vertex").alias(k), F.col("shingles").alias(c))
    return pairs.join(side("b", "y"), "b").join(side("a", "x"), "a").select("a", "b", "x", "y").mapInArrow(frugal(exact), "a long, b long")


def dealt(rows: DataFrame, group: str, near: str, block: int, packs: int) -> DataFrame:
    """``rows`` (with group, vertex, root) under the tasks (large, pack, i, j) that they take part in.

    Small groups share tasks, those with equal ``near`` the same one.  Of a group
    above ``block`` vertices the main component is cut into blocks of its own;
    every two blocks meet in a task, but for two of the main component.
    """
    of_root = rows.groupBy(group, "root").agg(F.count("*").alias("k"))
    of_group = of_root.groupBy(group).agg(F.sum("k").alias("total"), F.max("k").alias("top"), F.max_by("root", F.struct("k", "root")).alias("main"))
    large = F.col("total") > block
    mains = F.when(large, F.ceil(F.col("top") / block)).otherwise(0)
    others = F.when(large, F.greatest(F.lit(1), F.ceil((F.col("total") - F.col("top")) / block))).otherwise(1)
    plan = of_group.select(group, large.alias("large"), "main", mains.cast("long").alias("mains"), others.cast("long").alias("others"))
    placed = rows.join(plan, group)
    at = F.when((F.col("mains") > 0) & (F.col("root") == F.col("main")), F.pmod(F.xxhash64("vertex"), F.greatest("mains", F.lit(1))))
    placed = placed.withColumn("at", at.otherwise(F.col("mains") + F.pmod(F.xxhash64("vertex"), "others")))
    last = F.col("mains") + F.col("others") - 1
    placed = placed.withColumn("meets", F.explode(F.sequence(F.when(F.col("at") < F.col("mains"), F.col("mains")).otherwise(F.lit(0).cast("long")), last)))
    pack = F.when(F.col("large"), F.col(group)).otherwise(F.pmod(F.xxhash64(near), F.lit(packs)))
    return placed.select("large", pack.alias("pack"), F.least("at", "meets").alias("i"), F.greatest("at", "meets").alias("j"), F.col(group).alias("of"), "vertex", "root", "at")


TASK = ["large", "pack", "i", "j"]


class Forest:
    """Union-find over small integers."""

    def __init__(self, size: int):
        self.parent = list(range(size))

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether x and y were apart."""
        x, y = self.root(x), self.root(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y


def close_pairs(group: np.ndarray, n: np.ndarray, root: np.ndarray, at: np.ndarray, levels: list[np.ndarray], p: int, q: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Positions of two rows of a group, and their profiles' distance, of different roots, that sizes and profiles allow.

    Rows are sorted by group and size.  ``levels`` are profiles, coarse ones first.  If
    rows lie in two blocks (``at``), only pairs across them.
    """
    ends = np.searchsorted(group, group, "right")
    order = n.astype(np.int64) * p
    limit = n.astype(np.int64) * q
    last = np.empty(len(n), np.int64)
    for a, b in zip(*(lambda s: (s, np.append(s[1:], len(n))))(np.unique(ends, return_index=True)[1]), strict=True):
        last[a:b] = a + np.searchsorted(order[a:b], limit[a:b], "right")
    width = np.maximum(last - np.arange(len(n)) - 1, 0)
    total = np.concatenate([[0], width.cumsum()])
    start = 0
    while start < len(n):
        stop = max(start + 1, int(np.searchsorted(total, total[start] + SLAB, "right")) - 1)
        w = width[start:stop]
        x = np.repeat(np.arange(start, stop), w)
        y = np.arange(w.sum()) - np.repeat(total[start:stop] - total[start], w) + x + 1
        keep = (root[x] != root[y]) & (at[x] != at[y] if len(at) and at.min() != at.max() else True)
        x, y = x[keep], y[keep]
        for level in levels:
            far = np.abs(level[x] - level[y]).sum(1, dtype=np.int64)
            keep = far * (q + p) <= (n[x] + n[y]) * (q - p)
            x, y, far = x[keep], y[keep], far[keep]
        if len(x):
            yield x, y, far
        start = stop


def levels_of(profiles: np.ndarray) -> list[np.ndarray]:
    fine = profiles.astype(np.int16)
    return [fine.reshape(len(fine), k, -1).sum(2, dtype=np.int16) for k in (16, 64)] + [fine]


def open_groups(rest: DataFrame, vertices: DataFrame, p: int, q: int) -> DataFrame:
    """a, b: a forest that connects the vertices of different roots which share a bucket (bucket, vertex, first, root) and which sizes and profiles allow to be similar."""

    def search(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(known):
            return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
        known = known.sort_values("vertex")
        ids, size = known["vertex"].to_numpy(), known["n"].to_numpy()
        levels = levels_of(np.frombuffer(b"".join(known["profile"]), np.uint8).reshape(len(ids), BINS))
        of = np.searchsorted(ids, rows["vertex"].to_numpy())
        order = np.lexsort((size[of], rows["of"].to_numpy()))
        of, bucket, root, at = of[order], *(rows[c].to_numpy()[order] for c in ("of", "root", "at"))
        forest, out = Forest(len(ids)), []
        for x, y, _ in close_pairs(bucket, size[of], root, at, [level[of] for level in levels], p, q):
            for pair in distinct(of[x] * len(ids) + of[y]).tolist():
                v, w = divmod(pair, len(ids))
                if forest.join(v, w):
                    out.append((ids[v], ids[w]))
        return pd.DataFrame(np.array(out, np.int64).reshape(-1, 2), columns=["a", "b"])

    packs = max(1, -(-rest.count() // PACK))
    rows = dealt(rest, "bucket", "first", BLOCK, packs)
    # New columns, as both sides stem from one table.
    known = rows.select(*[F.col(c).alias(c) for c in (*TASK, "vertex")]).distinct().join(vertices, "vertex")
    return rows.groupBy(*TASK).cogroup(known.groupBy(*TASK)).applyInPandas(search, "a long, b long")


def merging_links(groups: DataFrame, sets: DataFrame, p: int, q: int) -> DataFrame:
    """a, b: similar vertices of a group (group, vertex, root), of different roots; only links that merge components of a task."""

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(n=[len(s) // 8 for s in frame["shingles"]]).sort_values(["of", "n", "vertex"])
        group, n, root, at, vertex = (frame[c].to_numpy() for c in ("of", "n", "root", "at", "vertex"))
        sets = [np.frombuffer(s, np.uint64) for s in frame["shingles"]]
        roots, known = np.unique(root, return_inverse=True)
        forest, out = Forest(len(roots)), []
        levels = levels_of(np.frombuffer(b"".join(map(profile, sets)), np.uint8).reshape(len(sets), BINS))
        for x, y, far in close_pairs(group, n, root, at, levels, p, q):
            nearest = np.argsort(far, kind="stable")  # likely links first, since they spare others
            for v, w in zip(x[nearest].tolist(), y[nearest].tolist(), strict=True):
                if forest.root(known[v]) != forest.root(known[w]):
                    both = shared_shingles(sets[v], sets[w])
                    if q * both >= p * (n[v] + n[w] - both):
                        forest.join(known[v], known[w])
                        out.append((vertex[v], vertex[w]))
        return pd.DataFrame(np.array(out, np.int64).reshape(-1, 2), columns=["a", "b"])

    packs = max(1, -(-groups.count() // SETS))
    rows = dealt(groups, "group", "group", SETS, packs).join(sets, "vertex")
    return rows.groupBy(*TASK).applyInPandas(compare, "a long, b long")


def named_sets(docs: DataFrame, size: int, p: int, q: int) -> tuple[int, DataFrame]:
    """A seed under which no two sets have one name, and the summary under it."""
    for seed in range(8):
        summary = staged(summarise(docs, size, p, q, seed), "sets")
        if summary.groupBy("vertex").agg(F.min("other_key").alias("a"), F.max("other_key").alias("b")).where("a <> b").isEmpty():
            return seed, summary
        discard(summary)
    raise ValueError("sets share their keys under every seed")


def similarity_classes(docs: DataFrame, size: int = 5, p: int = 80, q: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id for every row: components of similarity p/q or more on ``size``-word shingles."""
    seed, summary = named_sets(docs, size, p, q)
    counts = {r["band"]: r["n"] for r in summary.groupBy("band").agg(F.count("*").alias("n")).collect()}  # a row per size band
    bands = Bands(p, q)
    plans = {b: allocate(bands, b, counts.get(b, 0) + counts.get(b + 1, 0)) for k in counts if k >= 0 for b in (k - 1, k) if b >= 0}
    named = summary.where("vertex is not null and doc_id is not null")
    first = F.min(F.struct("doc_id", F.col("n_shingles").alias("n"), "profile")).alias("r")
    vertices = staged(named.groupBy("vertex").agg(first).select("vertex", "r.*"), "vertices")
    known = vertices.select("vertex", "n", "profile")
    shared = staged(buckets(index_entries(docs, size, p, q, plans, seed)), "buckets")
    root = F.coalesce("root", "vertex")

    def sets(rows: DataFrame) -> DataFrame:
        wanted = rows.select("vertex").distinct().join(vertices.select("vertex", "doc_id"), "vertex")
        return staged(sets_of(docs, staged(wanted, "wanted"), size, seed), "shingles")

    several = named.groupBy("doc_id").agg(F.min("vertex").alias("a"), F.max("vertex").alias("most")).where("a <> most").drop("most")
    same_id = named.join(several, "doc_id").where("vertex <> a").select("a", F.col("vertex").alias("b")).distinct()
    stars = staged(fits(shared.where("vertex <> first").select(F.col("first").alias("a"), F.col("vertex").alias("b")).distinct(), known, p, q), "stars")
    ends = stars.select(F.explode(F.array("a", "b")).alias("vertex"))
    links = staged(similar(stars, sets(ends), p, q).union(same_id), "links")
    labels = component_labels(links)
    placed = shared.join(labels, "vertex", "left").select("bucket", "vertex", "first", root.alias("root"))
    spanning = placed.groupBy("bucket").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("bucket")
    rest = staged(placed.join(spanning, "bucket"), "open-buckets")
    discard(shared, stars)
    trees = component_labels(open_groups(rest, known, p, q))
    groups = staged(trees.withColumnRenamed("root", "group").join(labels, "vertex", "left").select("group", "vertex", root.alias("root")), "groups")
    discard(rest)
    labels = component_labels(links.union(staged(merging_links(groups, sets(groups), p, q), "links")))
    rooted = vertices.join(labels, "vertex", "left").select("vertex", "doc_id", root.alias("root"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_vertex = rooted.join(least, "root").select(F.col("vertex").alias("_vertex"), "component_id")
    joined = summary.drop("profile").join(of_vertex, F.col("vertex") == F.col("_vertex"), "left")
    return joined.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
