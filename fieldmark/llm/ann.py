"""Operator 3, nearest neighbours: inverted lists whose vectors are searched within proven bounds.

Coarse centroids are fitted in numpy on a bounded sample (``TRAIN``); every vector
belongs to the list of its nearest centroid.  The vectors are cut into slices by a
hash, so that a list that holds a third of all rows is spread over all of them,
and the queries into blocks.  Where a slice meets a block, each query is measured
against its nearest list; a further list, or ring of one, is left out only if the
triangle inequality proves that it holds nothing as near as the ``k`` found.  Rings
that remain are compared by products of matrices, and what lies within their
rounding error of the edge is measured exactly, on the original vectors.  So the
sample and the parameters decide how much is compared, never what is found.

Fitting looks at the sample only, and the number of lists follows the number of
rows up to ``MAX_LISTS``.  Defined results: vectors that are null, zero, of
another dimension than the most frequent one (the larger of equally frequent
ones), or hold null or non-finite components take no part; ties go to the smaller
id; a query id in several rows asks once, with the least of its vectors, and rows
of its own id never count; a candidate id in several rows is a candidate with
each; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

TRAIN, MAX_LISTS = 20_000, 4096
#: Rows of a slice at most (of a smaller table at least ``LEAST``, over ``SPREAD`` slices), slices merged in one step, and numbers in a slice, block or sample.
SLICE, LEAST, SPREAD, MERGES, NUMBERS = 65_536, 4096, 32, 64, 1 << 22
#: Queries that meet a slice in one task, at least and at most; those compared at once, vectors at once, and pairs measured at once.
FEWEST, MOST, AT_ONCE, RING, PAIRS = 4096, 65_536, 1024, 4096, 1 << 22
#: Lists that a query searches before the edge is known, and found rows of a query that wait to be ranked.
PROBES, DEPTH = 1, 64


def valid(vectors: DataFrame) -> DataFrame:
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(sound, F.lit(False)) & F.exists("embedding", lambda x: x != 0))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :]


def homes(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row."""
    return np.concatenate([squared(x[k : k + AT_ONCE], centres).argmin(1) for k in range(0, len(x), AT_ONCE)])


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        nearest = homes(x, centres)
        n = np.bincount(nearest, minlength=len(centres))
        for j in range(x.shape[1]):
            total = np.bincount(nearest, x[:, j], len(centres))
            centres[:, j] = np.where(n > 0, total / np.maximum(n, 1), centres[:, j])
    return centres


def fit(vectors: DataFrame, dim: int, n: int, train: int = TRAIN) -> np.ndarray:
    """Centroids of at most ``train`` rows, chosen by a hash of the id."""
    rows = min(train, max(1, NUMBERS // dim))
    sample = np.array([r[0] for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").select("embedding").limit(rows).collect()]).reshape(-1, dim)
    return kmeans(sample, int(min(MAX_LISTS, max(1, len(sample) // 8), max(1, n**0.5 / 2))))


def measured(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows of the same place, summed from the first component on."""
    total = np.zeros(len(a))
    for x, y in zip(a.T, b.T, strict=True):
        total += (x - y) * (x - y)
    return np.sqrt(total)


class Slice:
    """Vectors by list and by distance from its centre, in rings of at most ``RING``.

    Of equal vectors the smallest ``k`` + 1 ids are kept, with ``k`` rows each: a query leaves out but its own.
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray, x: np.ndarray, centres: np.ndarray, k: int):
        mark = x @ np.random.default_rng(1).normal(size=x.shape[1])
        order = np.lexsort((rows, ids, mark))
        ids, rows, x = ids[order], rows[order], x[order]
        at = np.arange(len(x))
        other = np.ones(len(x), bool)
        for s in range(1, len(x), AT_ONCE):
            other[s : s + AT_ONCE] = (x[s : s + AT_ONCE] != x[s - 1 : s - 1 + AT_ONCE][: len(x) - s]).any(1)
        new = other.copy()
        new[1:] |= ids[1:] != ids[:-1]
        nth = np.cumsum(new)
        within = nth - np.maximum.accumulate(np.where(other, nth, 0))
        again = at - np.maximum.accumulate(np.where(new, at, 0))
        keep = (within <= k) & (again < k)
        ids, rows, x = ids[keep], rows[keep], x[keep]
        home = homes(x, centres)
        far = np.sqrt(((x - centres[home]) ** 2).sum(1))
        order = np.lexsort((far, home))
        self.ids, self.rows, self.x, self.k = ids[order], rows[order], x[order], k
        home, far = home[order], far[order]
        present, first = np.unique(home, return_index=True)
        self.centres, self.middle = centres[present], centres.mean(0)
        self.rings = [[(s, e, far[s], far[e - 1]) for s in range(a, b, RING) for e in [min(b, s + RING)]] for a, b in zip(first, [*first[1:], len(home)], strict=True)]
        self.rounding = 4 * (x.shape[1] + 16) * np.finfo(float).eps

    def nearest(self, ids: np.ndarray, x: np.ndarray, probes: int, depth: int):
        """Places among ``ids``, places in the slice and distances of the ``k`` nearest of each."""
        k, edge, found = self.k, np.full(len(x), np.inf), []  # edge: squared distance that k rows are known to be within

        def ranked():
            q, at, score = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.lexsort((self.rows[at], self.ids[at], score, q))
            q, at, score = q[order], at[order], score[order]
            nth = np.arange(len(q)) - np.searchsorted(q, q)
            kept = nth < k
            last = nth == k - 1
            edge[q[last]] = np.minimum(edge[q[last]], score[last] ** 2)
            found[:] = [(q[kept], at[kept], score[kept])]

        def compare(j: int, some: np.ndarray) -> None:
            for a, b, least, most in self.rings[j]:
                asked = some[~((low[some, j] - most > reach(some)) | (least - high[some, j] > reach(some)))]
                if not len(asked):
                    continue
                p, m = x[asked] - self.centres[j], self.x[a:b] - self.centres[j]
                pp, mm = (p * p).sum(1), (m * m).sum(1)
                way = pp[:, None] - 2 * p @ m.T + mm
                slack = 2 * self.rounding * (pp + mm.max())
                own = self.ids[a:b] == ids[asked, None]
                open_ = np.flatnonzero(edge[asked] == np.inf)
                if len(open_) and b - a > k:
                    kth = np.partition(np.where(own[open_], np.inf, way[open_]), k - 1, axis=1)[:, k - 1]
                    edge[asked[open_]] = np.where(np.isnan(kth), np.inf, kth + slack[open_])
                q, at = np.nonzero(~(way > (edge[asked] + slack)[:, None]) & ~own)
                step = max(1, PAIRS // x.shape[1])
                for s in range(0, len(q), step):
                    u, v = asked[q[s : s + step]], at[s : s + step] + a
                    found.append((u, v, measured(x[u], self.x[v])))
                    if sum(len(f[0]) for f in found) > max(depth, 2 * k) * len(x):
                        ranked()

        reach = lambda some: np.sqrt(edge[some]) * (1 + 1e-9)
        with np.errstate(over="ignore", invalid="ignore"):
            moved, centres = x - self.middle, self.centres - self.middle
            apart = squared(moved, centres)
            error = self.rounding * ((moved * moved).sum(1)[:, None] + (centres * centres).sum(1))
            low, high = np.sqrt(np.maximum(apart - error, 0)) * (1 - 1e-9), np.sqrt(np.maximum(apart + error, 0)) * (1 + 1e-9)
            first = np.zeros(apart.shape, bool)
            np.put_along_axis(first, np.argsort(apart, 1, kind="stable")[:, :probes], True, 1)
            for stage in (first, ~first):
                for j in np.flatnonzero(stage.any(0)):
                    compare(j, np.flatnonzero(stage[:, j]))
                if found:
                    ranked()
        return found[0] if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, probes: int = PROBES, depth: int = DEPTH) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest for each row of ``queries``; ``probes`` and ``depth`` change but the work."""
    spark, base = vectors.sparkSession, valid(vectors)
    sizes = base.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = sizes[0]["dim"], sizes[0]["count"]
    sized = F.size("embedding") == dim
    base = staged(base.where(sized).withColumn("row", F.monotonically_increasing_id()), "vectors")  # so that a row keeps its number
    shipped = spark.sparkContext.broadcast(fit(base, dim, n))  # of a bounded size
    bounded = max(1, NUMBERS // dim)
    slices = max(-(-n // min(SLICE, bounded)), min(SPREAD, -(-n // LEAST)))

    def rank(key, rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "score": [], "vec_id": [], "row": [], "part": []})]
        if len(rows) and len(asked):
            held = Slice(rows["vec_id"].to_numpy(), rows["row"].to_numpy(), np.stack(rows["embedding"].to_numpy()), shipped.value, k)
            ids, x = asked["query_id"].to_numpy(), np.stack(asked["embedding"].to_numpy())
            for s in range(0, len(ids), AT_ONCE):
                q, at, score = held.nearest(ids[s : s + AT_ONCE], x[s : s + AT_ONCE], probes, depth)
                out.append(pd.DataFrame({"query_id": ids[s + q], "score": score, "vec_id": held.ids[at], "row": held.rows[at], "part": int(key[0]) % MERGES}))
        return pd.concat([x for x in out if len(x)] or out)

    questions = staged(valid(queries).where(sized).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "ivf-questions")
    asked = questions.count()
    blocks = -(-asked // min(bounded, max(FEWEST, min(MOST, -(-asked // 16))))) or 1
    cut = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    key, tasks = ["slice", "block"], min(4 * slices * blocks, 20_000)  # by number, so that small groups are not put into one task
    left = base.withColumn("slice", cut("row", slices)).withColumn("block", every(blocks)).repartition(tasks, *key)
    right = questions.select(F.col("vec_id").alias("query_id"), "embedding").withColumn("block", cut("query_id", blocks)).withColumn("slice", every(slices)).repartition(tasks, *key)
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(rank, "query_id long, score double, vec_id long, row long, part long")
    best = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("score", "vec_id", "row"))).where(F.col("rank") <= k)
    if slices > MERGES:
        found = best(found, "query_id", "part")
    return best(found, "query_id").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
