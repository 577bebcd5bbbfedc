"""Operator 4, language-model scoring: a Katz backoff model of word pairs.

P(w | v) is d(r) * c(v w) / c(v) for a pair seen in training, with the
Good-Turing discount d(r) up to counts of ``MAX_DISCOUNTED``, and
alpha(v) * P(w) otherwise, where alpha(v) gives exactly what the discounts freed,
over the probability of the words not seen after v.  P(w) is in turn discounted
c(w) / N, and all unknown words together hold what that frees.  A context that
was not seen backs off with weight 1.

How it runs: documents are cut into chunks of bounded size.  1. A chunk sends its
distinct words, packed by word bucket; each bucket adds up counts and sends ids
and counts back by chunk.  2. Chunks (now of integers) meet their dictionaries
and send sorted pairs with the documents they occur in, packed by context
bucket; contexts that would overfill a bucket are split by word.  3. Buckets add
up pair counts and are written as the table of pairs; sums of split contexts and
counts of counts are added up over buckets.  4. A pass over that table computes
backoff weights and scores, added up per document.  All that meets in one task
is a chunk or a bucket, and the number of buckets follows the corpus.  A chunk
sends a piece to nearly every bucket, so pieces grow with the square of the corpus
while their sizes shrink: whatever is done for each must not depend on the chunk's
or the bucket's size.  Both passes over the documents must cut the same chunks; a
digest of each tells if they did not, and the query then fails.

Defined results: a null or empty text is one end token; repeated rows are
documents of their own; a null doc_id counts as an empty text when the fold is
chosen; an empty table gives no rows; without training documents every score
is 0; extra columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import islice
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, give_back, staged, words
from .shingles import mix

#: A chunk's tokens, if it is not a single text; a bucket's text, a word bucket being WORD_BUCKETS of them.
CHUNK_TOKENS, BUCKET_BYTES, WORD_BUCKETS, MAX_DISCOUNTED = 1_500_000, 6 << 20, 4, 5
END, UNKNOWN, BEGIN, FIRST = 1, 0, 1, 2
END_WORD = b" "  # no word has a space
PACKED = "bucket long, chunk long, data binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_squeezer, _expander = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
_HEAD = struct.Struct("<3s3sQ")
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written within leaves no shuffle files; else they stay on disk until the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def pack(*arrays: np.ndarray) -> bytes:
    """Compressed arrays of one dimension, byte by byte of their numbers: the high bytes are mostly alike, or left out where all are 0."""
    heads, planes = [bytes([len(arrays)])], []
    for a in arrays:
        kept = np.ascontiguousarray(a, np.min_scalar_type(a.max()) if a.dtype.kind == "u" and len(a) else None)
        heads.append(_HEAD.pack(a.dtype.str.encode(), kept.dtype.str.encode(), len(a)))
        planes.append(kept.view(np.uint8).reshape(len(a), kept.itemsize).T.tobytes())
    return _squeezer.compress(b"".join(heads + planes))


def unpack(data: bytes) -> tuple[np.ndarray, ...]:
    data = _expander.decompress(data)
    out, at = [], 1 + data[0] * _HEAD.size
    for k in range(data[0]):
        kind, kept, n = _HEAD.unpack_from(data, 1 + k * _HEAD.size)
        kept = np.dtype(kept.decode())
        planes = np.frombuffer(data, np.uint8, n * kept.itemsize, at).reshape(kept.itemsize, n)
        out.append(planes.T.copy().view(kept).reshape(-1).astype(kind.decode(), copy=False))
        at += n * kept.itemsize
    return tuple(out)


class WordCodes(dict):
    """Numbers words as they come, the end of a text first."""

    def __init__(self):
        super().__init__({END_WORD: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code

    def hashes(self) -> np.ndarray:
        """64-bit hashes by code."""
        return np.fromiter((END, *map(xxhash.xxh64_intdigest, islice(self, 1, None))), np.uint64, len(self))


class Chunk(NamedTuple):
    """Documents' ids, which of them have none, held-out flags and lengths; codes of the tokens, an end after each document; word hashes by code."""

    chunk: int
    ids: np.ndarray
    missing: np.ndarray
    held: np.ndarray
    lengths: np.ndarray
    codes: np.ndarray
    hashes: np.ndarray


def chunks(frames: Iterator[pd.DataFrame]) -> Iterator[Chunk]:
    part, k, size = TaskContext.get().partitionId(), 0, 0
    codes, docs, tokens = WordCodes(), [], []

    def cut() -> Chunk:
        ids, held = zip(*docs, strict=True)
        missing = np.array([i is None for i in ids])
        return Chunk(part << 24 | k, np.array([i or 0 for i in ids], np.int64), missing, np.array(held), np.array([len(t) for t in tokens], np.uint32), np.concatenate(tokens), codes.hashes())

    for frame in frames:
        for doc_id, text, out in zip(frame["doc_id"], frame["text"], frame["held_out"], strict=True):
            found = words(text)
            found.append(END_WORD)
            if docs and size + len(found) > CHUNK_TOKENS:
                yield cut()
                codes, docs, tokens, size, k = WordCodes(), [], [], 0, k + 1
                give_back()
            tokens.append(np.fromiter(map(codes.__getitem__, found), np.uint32, len(found)))
            docs.append((None if pd.isna(doc_id) else int(doc_id), bool(out)))
            size += len(found)
    if docs:
        yield cut()


def edges(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the length."""
    return np.append(np.flatnonzero(np.append(True, x[1:] != x[:-1])), len(x)) if len(x) else np.zeros(1, int)


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Slices of a sorted array of bucket numbers."""
    cuts = edges(bucket)
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield int(bucket[a]), slice(a, b)


def dealt(bucket: np.ndarray, buckets: int) -> np.ndarray:
    """The stable order by bucket; narrow numbers are sorted by their digits."""
    return np.argsort(bucket.astype(np.min_scalar_type(buckets)), kind="stable")


def steps(x: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Differences of neighbours, from 0 at the first of each bucket."""
    out = np.diff(x, prepend=x.dtype.type(0))
    first = edges(bucket)[:-1]
    out[first] = x[first]
    return out


def low_bits(x: np.ndarray, width: np.uint64) -> np.ndarray:
    return (x & ((np.uint64(1) << width) - np.uint64(1))).astype(np.uint32)


def word_order(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes in the order in which words are sent, by bucket and hash; their buckets."""
    order = np.argsort(hashes)
    bucket = (hashes[order] % np.uint64(buckets)).astype(np.int64)
    again = dealt(bucket, buckets)
    return order[again], bucket[again]


def discounts(counts: np.ndarray) -> np.ndarray:
    """d(0..MAX_DISCOUNTED+1) from the counts of counts 1, 2, ...; half a count where Good-Turing gives none in (0, 1)."""
    n = np.append(0.0, counts.astype(float))
    k = MAX_DISCOUNTED
    out = np.ones(k + 2)
    for r in range(1, k + 1):
        d = 0.0
        if n[1] > 0 and n[r] > 0 and (k + 1) * n[k + 1] < n[1]:
            tail = (k + 1) * n[k + 1] / n[1]
            d = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail)
        out[r] = d if 0 < d < 1 else 1 - 0.5 / r
    return out


def of_counts(c: np.ndarray) -> np.ndarray:
    """How many have the counts 1 to MAX_DISCOUNTED + 1."""
    return np.bincount(np.minimum(c, MAX_DISCOUNTED + 2).astype(np.int64), minlength=MAX_DISCOUNTED + 3)[1 : MAX_DISCOUNTED + 2]


class Unigrams:
    """P(w) by count: discounted, what is freed belonging to the unknown words."""

    def __init__(self, total: int, types: int, counts: np.ndarray):
        self.total, self.types, self.d = total, types, discounts(counts)
        r = np.arange(1, MAX_DISCOUNTED + 1)
        freed = float((counts[:MAX_DISCOUNTED] * r * (1 - self.d[1:-1])).sum()) / total if total else 1.0
        least = 1 / (total + types + 1)
        self.scale = 1.0 if freed >= least or not total else (1 - least) / (1 - freed)
        self.unknown = max(freed, least) if total else 1.0

    def of(self, count: np.ndarray) -> np.ndarray:
        d = self.d[np.minimum(count, MAX_DISCOUNTED + 1)]
        return np.where(count > 0, d * count / max(self.total, 1) * self.scale, self.unknown)


def digest(part: Chunk) -> np.ndarray:
    """Tells whether a chunk is the same in both passes over the documents."""
    whole = xxhash.xxh64()
    for a in (part.codes, part.hashes, part.lengths, part.held):
        whole.update(a.tobytes())
    return np.array([whole.intdigest()], np.uint64)


def send_words(docs: DataFrame, buckets: int) -> DataFrame:
    """Distinct words of each chunk with their training counts, by word bucket."""

    def send(frames):
        for part in chunks(frames):
            counts = np.bincount(part.codes[~np.repeat(part.held, part.lengths)], minlength=len(part.hashes)).astype(np.uint64)
            order, bucket = word_order(part.hashes, buckets)
            gaps, counts, mark = steps(part.hashes[order], bucket), counts[order], digest(part)
            rows = [(b, part.chunk, pack(gaps[at], counts[at], mark)) for b, at in by_bucket(bucket)]
            yield pd.DataFrame(rows, columns=["bucket", "chunk", "data"])

    return docs.mapInPandas(send, PACKED)


def add_words(sent: DataFrame, buckets: int) -> DataFrame:
    """Ids and total counts for each chunk, in the order they were sent; counts of counts under chunk -1."""

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        bucket = int(frame["bucket"].iloc[0])
        parts = [unpack(d) for d in frame["data"]]
        words, place = np.unique(np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts]), return_inverse=True)
        total = np.bincount(place, np.concatenate([p[1] for p in parts]), len(words)).astype(np.uint64)
        ids = FIRST + np.arange(len(words)) * buckets + bucket
        if ids[-1] >= 1 << 32:
            raise ValueError("more words than 32-bit ids")
        ids = np.where(total > 0, ids, UNKNOWN).astype(np.uint32)
        cuts = np.cumsum([len(p[0]) for p in parts])[:-1]
        back = [pack(ids[w], total[w], p[2]) for p, w in zip(parts, np.split(place, cuts), strict=True)]
        stats = np.append(of_counts(total), [int(total.sum()), np.count_nonzero(total)])
        return pd.DataFrame({"bucket": bucket, "chunk": [*frame["chunk"], -1], "data": [*back, pack(stats)]})

    return sent.groupBy("bucket").applyInPandas(add, PACKED)


def send_tokens(docs: DataFrame, buckets: int) -> DataFrame:
    """Each chunk as integers: places in its list of words, ordered as its dictionary comes back."""

    def send(frames):
        for part in chunks(frames):
            order, _ = word_order(part.hashes, buckets)
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order))
            yield pd.DataFrame({"bucket": [-1], "chunk": [part.chunk], "data": [pack(part.ids, part.missing, part.held, part.lengths, rank[part.codes], digest(part))]})

    return docs.mapInPandas(send, PACKED)


def send_pairs(tokens: DataFrame, dictionary: DataFrame, uni: Unigrams, buckets: int, train_docs: int) -> DataFrame:
    """Sorted pairs of each chunk with the documents they occur in (twice their places, and 1 for those held out), by context bucket; per-document sums under -1 - chunk."""
    full = max(1, uni.total // (4 * buckets))

    def send(own: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        give_back()
        chunk = int(own["chunk"].iloc[0])
        doc_ids, missing, held, lengths, place, mark = unpack(own["data"].iloc[0])
        parts = [unpack(d) for d in words.sort_values("bucket")["data"]]
        if any(p[2][0] != mark[0] for p in parts):
            raise ValueError("the documents came in another order when they were read again; write them to a table first")
        # the chunk's words by id, unknown ones as one: what holds for a word is computed once
        names, rank = np.unique(np.concatenate([np.array([UNKNOWN, BEGIN], np.uint32), *[p[0] for p in parts]]), return_inverse=True)
        rank, names = rank[2:].astype(np.uint32), names.astype(np.uint64)
        count = np.zeros(len(names), np.int64)
        count[rank] = np.concatenate([p[1] for p in parts])
        of_context = count.copy()
        of_context[BEGIN] = train_docs
        w = rank[place]
        starts = np.cumsum(lengths, dtype=np.int64) - lengths
        context = np.append(np.uint32(BEGIN), w[:-1])
        context[starts] = BEGIN
        doc = np.repeat(np.arange(len(lengths), dtype=np.uint32), lengths)
        base = np.add.reduceat(np.log10((count + 1) / (uni.total + uni.types + 1))[w], starts)
        known = np.add.reduceat((count > 0).astype(np.int64)[w], starts)
        lost = (of_context == 0)[context]
        score = np.bincount(doc[lost], np.log10(uni.of(count))[w[lost]], len(lengths)).astype(float)
        rows = [(-1 - chunk, chunk, pack(doc_ids, missing, held, lengths, base, known, score))]
        # context, word and document in one number: a chunk's words and documents together are hardly more than its tokens, or it is one document
        for_doc, for_word = np.uint64((2 * len(lengths)).bit_length()), np.uint64(len(names).bit_length())
        key = context[~lost].astype(np.uint64)
        for more, width in ((w, for_word), (doc << np.uint32(1) | held[doc], for_doc)):
            key <<= width
            key |= more[~lost]
        del place, parts, w, context, doc, lost, more
        key.sort()
        both = low_bits(key, for_doc)
        key >>= for_doc
        cuts = edges(key)
        key, n, first = key[cuts[:-1]], np.diff(cuts).astype(np.uint32), cuts[:-1]
        c, w = (key >> for_word).astype(np.uint32), low_bits(key, for_word)
        key = names[c] << np.uint64(32)
        key |= names[w]
        share = np.maximum(1, -(-of_context // full)).astype(np.uint64)  # buckets that the context is split over
        bucket = mix(key)
        bucket %= share[c]
        bucket += (mix(names) % np.uint64(buckets))[c]
        bucket %= np.uint64(buckets)
        order = dealt(bucket, buckets)
        bucket, n, first = bucket[order], n[order], first[order]
        gaps, count, split = steps(key[order], bucket), count.astype(np.uint64)[w[order]], (share > 1)[c[order]]
        del key, c, w, order, cuts
        ends = np.append(0, np.cumsum(n, dtype=np.int64))
        first = np.repeat(first - ends[:-1], n)
        first += np.arange(len(first))
        both = both[first]
        del first
        for b, at in by_bucket(bucket):
            rows.append((b, chunk, pack(gaps[at], count[at], n[at], both[ends[at.start] : ends[at.stop]], split[at])))
        return pd.DataFrame(rows, columns=["bucket", "chunk", "data"])

    return tokens.groupBy("chunk").cogroup(dictionary.groupBy("chunk")).applyInPandas(send, PACKED)


def context_sums(pairs: np.ndarray, c: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts of sorted pairs; by context: all counts, pairs of count 1 to MAX_DISCOUNTED, P(w) of the seen words; the context's place for each pair."""
    context = pairs >> np.uint64(32)
    cuts = edges(context)
    names, place = context[cuts[:-1]], np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    sums = [np.bincount(place, c, len(names)), *[np.bincount(place[c == r], minlength=len(names)) for r in range(1, MAX_DISCOUNTED + 1)], np.bincount(place, np.where(c > 0, p, 0.0), len(names))]
    return names, np.stack(sums), place


def add_pairs(sent: DataFrame, uni: Unigrams) -> DataFrame:
    """The table of pairs: a row per bucket with pairs, counts, P(w), places and the sums of its contexts."""
    schema = "bucket long, chunk long, data binary, counts array<long>, contexts array<struct<context: long, sums: array<double>>>"

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        if frame["bucket"].iloc[0] < 0:  # a chunk's own sums pass by
            return frame.assign(counts=[[]] * len(frame), contexts=[[]] * len(frame))
        give_back()
        gaps, counts, n, both, split = map(list, zip(*map(unpack, frame["data"]), strict=True))
        sizes = np.array([len(x) for x in both], np.uint32)
        n, both, split = np.concatenate(n), np.concatenate(both), np.concatenate(split)
        keys = np.concatenate([np.cumsum(g) for g in gaps])
        del gaps
        pairs, place = np.unique(keys, return_inverse=True)
        del keys
        word, halved = np.zeros(len(pairs), np.uint64), np.zeros(len(pairs), bool)
        word[place], halved[place] = np.concatenate(counts), split
        at = np.repeat(place.astype(np.uint32), n)
        del counts, split, place, n
        c = np.bincount(at[both & np.uint32(1) == 0], minlength=len(pairs))
        placed = (both >> np.uint32(1)).astype(np.uint64)
        placed <<= np.uint64(32)
        placed |= at
        del both, at
        for part in np.split(placed, np.cumsum(sizes[:-1], dtype=np.int64)):
            part.sort()
        names, sums, _ = context_sums(pairs, c, uni.of(word.astype(np.int64)))
        large = np.isin(names, pairs[halved] >> np.uint64(32))
        contexts = [{"context": int(k), "sums": s.tolist()} for k, s in zip(names[large], sums[:, large].T, strict=True)]
        data = pack(np.diff(pairs, prepend=np.uint64(0)), c.astype(np.uint64), word, np.array(frame["chunk"]), sizes, (placed >> np.uint64(32)).astype(np.uint32), placed.astype(np.uint32))
        return pd.DataFrame({"bucket": [int(frame["bucket"].iloc[0])], "chunk": [-1], "data": [data], "counts": [of_counts(c).tolist()], "contexts": [contexts]})

    return sent.groupBy("bucket").applyInPandas(add, schema)


def score_pairs(table: DataFrame, totals: DataFrame, uni: Unigrams, d: np.ndarray) -> DataFrame:
    """chunk, data: per bucket and chunk the sums of log10 probabilities of its documents."""

    def score(frames):
        for frame in frames:
            own = frame[frame["chunk"] >= 0]
            if len(own):
                yield pd.DataFrame({"chunk": own["chunk"], "kind": 0, "data": own["data"]})
            for chunk, data, known in zip(frame["chunk"], frame["data"], frame["totals"], strict=True):
                if chunk >= 0:
                    continue
                give_back()
                gaps, c, word, chunk_ids, sizes, doc, at = unpack(data)
                pairs, c = np.cumsum(gaps), c.astype(np.int64)
                first = uni.of(word.astype(np.int64))
                names, sums, of = context_sums(pairs, c, first)
                for t in known if known is not None else []:
                    i = np.searchsorted(names, np.uint64(t["context"]))
                    if i < len(names) and names[i] == t["context"]:
                        sums[:, i] = t["sums"]
                total = sums[0]
                r = np.arange(1, MAX_DISCOUNTED + 1)[:, None]
                freed = (sums[1:-1] * r * (1 - d[1:-1])[:, None]).sum(0) / np.maximum(total, 1)
                least = 0.5 / (total + 1)  # nothing was freed: all pairs are frequent
                scale = np.where(freed >= least, 1.0, (1 - least) / np.maximum(1 - freed, 1e-300))
                alpha = np.maximum(freed, least) / np.maximum(1 - sums[-1], uni.unknown)
                seen = scale[of] * d[np.minimum(c, MAX_DISCOUNTED + 1)] * c / np.maximum(total[of], 1)
                logs = np.log10(np.where(c > 0, seen, alpha[of] * first))[at]
                at_chunk = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
                edge = edges(at_chunk << np.uint64(32) | doc)[:-1]
                doc, sums_of = doc[edge], np.add.reduceat(logs, edge)
                rows = [(int(chunk_ids[k]), 1, pack(doc[s], sums_of[s])) for k, s in by_bucket(at_chunk[edge])]
                yield pd.DataFrame(rows, columns=["chunk", "kind", "data"])

    return table.join(totals, "bucket", "left").select("chunk", "data", "totals").mapInPandas(score, "chunk long, kind int, data binary")


def score_documents(docs: DataFrame) -> DataFrame:
    """Scores of all ``docs`` (doc_id, text, held_out), learnt from those that are not held out."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("held_out", F.lit(False)).alias("held_out"))
    sizes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.count_if(~F.col("held_out")).alias("train")).first()
    buckets = max(12, -(-sizes["bytes"] // BUCKET_BYTES))
    word_buckets = max(12, -(-buckets // WORD_BUCKETS))
    with shuffles_dropped(docs.sparkSession):
        dictionary = staged(add_words(send_words(docs, word_buckets), word_buckets), "lm-words")
    names = [f"n{k}" for k in range(MAX_DISCOUNTED + 3)]

    def add_stats(frames):
        yield pd.DataFrame([sum((unpack(d)[0] for f in frames for d in f["data"]), np.zeros(len(names), np.int64))], columns=names)

    stats = dictionary.where("chunk = -1").select("data").mapInPandas(add_stats, ", ".join(f"{x} long" for x in names)).agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in names]).first()
    uni = Unigrams(stats[-2], stats[-1], np.array(stats[:-2]))
    sent = send_pairs(send_tokens(docs, word_buckets), dictionary.where("chunk >= 0"), uni, buckets, sizes["train"])
    with shuffles_dropped(docs.sparkSession):
        table = staged(add_pairs(sent, uni), "lm-pairs")
    discard(dictionary)
    d = np.array(table.agg(*[F.coalesce(F.sum(F.get("counts", F.lit(r))), F.lit(0)) for r in range(MAX_DISCOUNTED + 1)]).first())
    parts = table.select("bucket", F.inline("contexts")).select("bucket", "context", *[F.get("sums", F.lit(k)).alias(f"s{k}") for k in range(MAX_DISCOUNTED + 2)])
    split = parts.groupBy("context").agg(F.count("*").alias("n"), F.array(*[F.sum(f"s{k}") for k in range(MAX_DISCOUNTED + 2)]).alias("sums")).where("n > 1").drop("n")
    totals = parts.select("bucket", "context").join(split, "context").groupBy("bucket").agg(F.collect_list(F.struct("context", "sums")).alias("totals"))
    # a context is split into parts of a quarter of a bucket or so: a few hundred bytes of totals for each bucket, while the table is as large as the input
    scored = score_pairs(table.drop("counts", "contexts"), F.broadcast(totals), uni, discounts(d))
    n = uni.total

    def add_up(frame: pd.DataFrame) -> pd.DataFrame:
        give_back()
        frame = frame.sort_values("kind", kind="stable")
        ids, missing, held, lengths, base, known, score = unpack(frame["data"].iloc[0])
        for data in sorted(frame["data"].iloc[1:]):
            doc, s = unpack(data)
            score[doc] += s
        return pd.DataFrame({"doc_id": pd.arrays.IntegerArray(ids, missing), "held_out": held, "n_tokens": lengths.astype(np.int64), "n_known": known, "train_tokens": n, "base_score": base, "score": score})

    return scored.groupBy("chunk").applyInPandas(add_up, SCORES)
