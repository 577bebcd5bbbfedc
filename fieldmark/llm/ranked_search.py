"""Operator 13, ranked lexical search: a document-at-a-time merge over compressed postings.

``build_index`` cuts the documents, where they lie, into shards of bounded size
and writes each shard's postings: for every term the documents, as gaps between
places in the shard's order by doc_id, and how often each holds it, in
variable-length bytes; one more row lists the shard's documents and their
lengths.  Nothing is shuffled for that.

``search`` takes the rows of the asked terms only.  Shards are dealt to tasks,
which go through them one by one; for each item a heap merges the postings by
document, so that a document's whole score is known when it is left, and a heap
of the best ``k``, by score and then doc_id, is kept across the task's shards.
Lists whose greatest scores together lie strictly below the worst of a full
heap cannot bring a document in: they are not merged but looked up for those
that the others bring.  The tasks' results are merged in two steps.

Scores are integers (see ``search``), so all ways of adding give the same.
Items are searched in blocks of ``BLOCK_BYTES`` of text, which bounds what is
sent to the tasks.

Defined results: null texts have no terms; documents without terms are not
counted.  Repeated documents are documents each; null ids come last among equal
scores.  An item id in several rows asks once, with the least of its texts.
Items without terms, or with none that a document holds, give no rows, nor do
empty tables; extra columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

SHARD_BYTES, SHARD_DOCS, PIECE, BLOCK_BYTES, MERGES = 16 << 20, 32_768, 4 << 20, 4 << 20, 64
#: ASCII letters to lower case; all other ASCII characters but digits part terms.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: Stands for a null id in the order of ids.
LAST = 1 << 63
POSTINGS = "shard long, term string, df int, gaps binary, counts binary, doc_ids array<long>, lengths array<long>"


def terms(raw: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text, a piece at a time."""
    text = (raw or b"").translate(TERMS)
    at = 0
    while at < len(text):
        end = text.find(b" ", min(at + PIECE, len(text)))
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values, seven bits each and the low ones first, and how many each takes."""
    size = np.ones(len(values), np.int64)
    for k in range(7, 35, 7):
        size += values >= (1 << k)
    at = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[at[has] + k] = ((values[has] >> (7 * k)) & 127) | np.where(size[has] > k + 1, 128, 0)
    return out, size


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.empty(0, np.int64)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    shift = 7 * (np.arange(len(raw)) - np.repeat(starts, ends - starts + 1))
    return np.add.reduceat((raw & 127).astype(np.int64) << shift, starts)


class Shard:
    """Documents that are gathered until their postings are written."""

    def __init__(self, most_bytes: int, most_docs: int):
        self.most_bytes, self.most_docs = most_bytes, most_docs
        self.vocab: dict[bytes, int] = {}
        self.docs: list[tuple[int, int | None, np.ndarray]] = []
        self.size = 0

    def add(self, doc_id: int | None, raw: bytes | None) -> None:
        new = self.vocab
        ids = [np.fromiter((new.setdefault(t, len(new)) for t in piece), np.int32, len(piece)) for piece in terms(raw)]
        ids = np.concatenate(ids) if ids else np.empty(0, np.int32)
        self.size += len(raw or b"")
        if len(ids):
            self.docs.append((LAST if doc_id is None else doc_id, doc_id, ids))

    def full(self) -> bool:
        return bool(self.docs) and (self.size >= self.most_bytes or len(self.docs) >= self.most_docs)

    def rows(self, shard: int) -> pa.RecordBatch:
        self.docs.sort(key=lambda d: d[0])
        lengths = np.array([len(d[2]) for d in self.docs], np.int64)
        names = sorted(self.vocab)
        rank = np.empty(len(names), np.int64)
        rank[[self.vocab[t] for t in names]] = np.arange(len(names))
        n = len(self.docs)
        pairs = np.sort(np.concatenate([rank[d[2]] * n + i for i, d in enumerate(self.docs)]))
        first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
        counts = np.diff(np.concatenate([first, [len(pairs)]]))
        term, place = pairs[first] // n, pairs[first] % n
        opens = np.concatenate([[True], term[1:] != term[:-1]])
        gaps = np.where(opens, place, place - np.concatenate([[0], place[:-1]]))
        df = np.bincount(term, minlength=len(names))
        lists = []
        for values in (gaps, counts - 1):
            data, size = packed(values)
            edges = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(df)])].astype(np.int32)
            lists.append(pa.concat_arrays([pa.array([None], pa.binary()), pa.BinaryArray.from_buffers(pa.binary(), len(names), [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(data.tobytes())])]))
        none = [None] * len(names)
        columns = [
            pa.array(np.full(len(names) + 1, shard)), pa.array([None, *(t.decode() for t in names)], pa.string()), pa.array([n, *df.tolist()], pa.int32()), *lists,
            pa.array([[d[1] for d in self.docs], *none], pa.list_(pa.int64())), pa.array([lengths.tolist(), *none], pa.list_(pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in POSTINGS.split(", ")])


@dataclass
class Index:
    """The written postings, the number of documents with terms, and all their terms."""

    postings: DataFrame
    documents: int
    length: int


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES, shard_docs: int = SHARD_DOCS) -> Index:
    """The index of all documents; a shard ends with the document that reaches either bound."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number = Shard(shard_bytes, shard_docs), TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("raw"), strict=True):
                shard.add(doc_id, raw.as_py())
                if shard.full():
                    yield shard.rows(number)
                    shard, number = Shard(shard_bytes, shard_docs), number + 1
        if shard.docs:
            yield shard.rows(number)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw"))
    postings = staged(rows.mapInArrow(build, POSTINGS), "postings")
    found = postings.where("term is null").agg(F.sum("df").alias("n"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("l")).first()
    return Index(postings, found["n"] or 0, found["l"] or 0)


class Asked:
    """A block of items: each item's terms with how often it has them, and the terms' weights."""

    def __init__(self, items: list[tuple[int, bytes]], k: int):
        self.k, self.place, self.items, self.documents, self.length = k, {}, [], 0, 0
        for item_id, raw in items:
            met = Counter(t for piece in terms(raw) for t in piece)
            self.items.append((item_id, [(self.place.setdefault(t.decode(), len(self.place)), n) for t, n in met.items()]))
        self.weight = np.zeros(len(self.place), np.int64)

    def weigh(self, index: Index, df: dict[str, int]) -> None:
        self.documents, self.length = index.documents, index.length
        for term, n in df.items():
            self.weight[self.place[term]] = math.floor(1000 * math.log((2 * index.documents + 2) / (2 * n + 1)))


class Lists:
    """The asked terms' postings of one shard: places and scores, decoded all at once."""

    def __init__(self, asked: Asked, ids: list[int | None], lengths: list[int], names: list[str], df: list[int], gaps: list[bytes], counts: list[bytes]):
        self.ids = ids
        at = np.concatenate([[0], np.cumsum(df)]).astype(np.int64)
        steps, tf = np.cumsum(unpacked(b"".join(gaps))), unpacked(b"".join(counts)) + 1
        place = steps - np.repeat(np.concatenate([[0], steps])[at[:-1]], df)
        norm = np.array([75 + 25 * n * asked.documents // asked.length for n in lengths], np.int64)
        term = np.array([asked.place[t] for t in names], np.int64)
        score = np.repeat(asked.weight[term], df) * (1_000_000_000 * tf // (1000 * tf + 12 * norm[place]))
        self.most, self.kth, self.place, self.score = {}, {}, {}, {}
        for t, a, b in zip(term.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
            own = score[a:b]
            self.most[t] = int(own.max())
            self.kth[t] = int(np.partition(own, b - a - asked.k)[b - a - asked.k]) if b - a >= asked.k else 0
            self.place[t], self.score[t] = place[a:b].tolist(), own.tolist()


def merge(lists: Lists, wanted: list[tuple[int, int]], best: list[tuple[int, int]], k: int) -> None:
    """Puts the shard's documents for one item into ``best``, a heap of (score, -doc_id) of ``k`` at most."""
    held = sorted((lists.most[t] * n, t, n) for t, n in wanted if lists.most.get(t))
    if not held:
        return
    places, scores, times = [lists.place[t] for _, t, _ in held], [lists.score[t] for _, t, _ in held], [n for *_, n in held]
    below, total = [], 0  # the most that the lists up to each can add
    for most, *_ in held:
        total += most
        below.append(total)
    floor = max([best[0][0] if len(best) == k else 1, *(lists.kth[t] * n for _, t, n in held)])
    rare, at = 0, [0] * len(held)
    while rare < len(held) and below[rare] < floor:
        rare += 1
    heap = [(places[j][0], j) for j in range(rare, len(held))]
    heapify(heap)
    while heap:
        doc, score = heap[0][0], 0
        while heap and heap[0][0] == doc:
            j = heap[0][1]
            score += scores[j][at[j]] * times[j]
            at[j] += 1
            if at[j] < len(places[j]):
                heapreplace(heap, (places[j][at[j]], j))
            else:
                heappop(heap)
        for j in range(rare - 1, -1, -1):
            if score + below[j] < floor:
                break
            at[j] = i = bisect_left(places[j], doc, at[j])
            if i < len(places[j]) and places[j][i] == doc:
                score += scores[j][i] * times[j]
        if score >= floor:
            doc_id = lists.ids[doc]
            entry = (score, -(LAST if doc_id is None else doc_id))
            if len(best) < k:
                heappush(best, entry)
            elif entry > best[0]:
                heapreplace(best, entry)
            if len(best) == k and best[0][0] > floor:
                floor, old = best[0][0], rare
                while rare < len(held) and below[rare] < floor:
                    rare += 1
                if rare > old:
                    heap = [x for x in heap if x[1] >= rare]
                    heapify(heap)


def search_block(index: Index, items: list[tuple[int, bytes]], k: int) -> DataFrame:
    """query_id, doc_id and score of the best of each task."""
    spark, asked = index.postings.sparkSession, Asked(items, k)
    names = F.broadcast(spark.createDataFrame([(t,) for t in asked.place], "term string"))  # of BLOCK_BYTES of text
    wanted = index.postings.join(names, "term", "left_semi")
    asked.weigh(index, dict(wanted.groupBy("term").agg(F.sum("df").alias("df")).collect()))
    shipped = spark.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, shard, rows = shipped.value, None, []
        best: list[list[tuple[int, int]]] = [[] for _ in asked.items]

        def close() -> None:
            (ids, lengths), found = rows[0][4:], rows[1:]
            if found:
                lists = Lists(asked, ids, lengths, *map(list, zip(*(r[:4] for r in found), strict=True)))
                for (_, wanted), heap in zip(asked.items, best, strict=True):
                    merge(lists, wanted, heap, asked.k)

        for batch in batches:
            for number, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number != shard and rows:
                    close()
                    rows = []
                shard = number
                rows.append(row)
        if rows:
            close()
        out = [(item_id, None if key == -LAST else -key, score) for (item_id, _), heap in zip(asked.items, best, strict=True) for score, key in heap]
        part = TaskContext.get().partitionId() % MERGES
        yield pa.RecordBatch.from_pydict({"item_id": pa.array([r[0] for r in out], pa.int64()), "doc_id": pa.array([r[1] for r in out], pa.int64()), "score": pa.array([r[2] for r in out], pa.int64()), "part": pa.array([part] * len(out), pa.int32())})

    # A shard's row of documents stands before its postings.
    dealt = wanted.unionByName(index.postings.where("term is null")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard").sortWithinPartitions("shard", F.col("term").asc_nulls_first())
    return dealt.select("shard", "term", "df", "gaps", "counts", "doc_ids", "lengths").mapInArrow(run, "item_id long, doc_id long, score long, part int")


def search(index: Index, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id and score of each item's ``k`` highest-scoring documents with a score above 0.

    A term's weight w is floor(1000 * ln((2 N + 2) / (2 df + 1))); a document's
    score is the sum of w * (10^9 tf div (1000 tf + 12 m)) over the item's terms,
    repeats included, where m is 75 + 25 n N div L.
    """
    spark = items.sparkSession
    asked = items.groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.min(F.col("text").cast("string")).alias("text")).where("text is not null")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found = spark.createDataFrame([], "item_id long, doc_id long, score long, part int")
    blocks = size // BLOCK_BYTES + 1
    for b in range(blocks if index.documents and size else 0):
        block = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).select("item_id", F.col("text").cast("binary")).collect()
        if block:
            found = found.union(search_block(index, [(i, bytes(t)) for i, t in block], k))
    order = (F.desc("score"), F.col("doc_id").asc_nulls_last())
    near = found.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*order))).where(F.col("rank") <= k)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)).cast("int")).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
