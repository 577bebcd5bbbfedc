"""Operator 7, toxicity: averaged subword embeddings under a linear softmax.

A word's vector is the mean of the vectors of its character n-grams (hashed
into a fixed number of buckets), a window's vector the mean over its words, and
a softmax over the window's vector gives the class.  Embeddings and softmax are
trained jointly in numpy with Adam.  A document is as toxic as its most toxic
window, so a long text does not dilute a short insult; training first labels
all windows of a toxic document toxic, then only the highest-scoring ones.

The model is fitted on the driver from a bounded sample of labelled rows
(``MAX_DOCS``, ``MAX_CHARS`` and
``MAX_TEXT``); all documents are scored whole, in Arrow
batches.  Defined results: null, empty and wordless texts get the score of a
zero vector; with one class or no labels at all the score is the smoothed share
of toxic labels; repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import distinct, frugal, give_back, words

MAX_DOCS, MAX_CHARS, MAX_TEXT = 3000, 3_000_000, 6000
BUCKETS, DIM, WINDOW, STRIDE, EPOCHS = 1 << 18, 6, 6, 3, 24
#: Buckets met in fewer documents of the sample stay at zero: they can only be learnt by heart.
MIN_SEEN, DECAY = 8, 1e-5
#: Texts of each class from which on the edge is found on a quarter of them.
ENOUGH = 40
#: Zero vectors averaged into each word, so that a word of few n-grams weighs less.
SHRINK = 6
SIZES = range(3, 6)
#: Words whose scores a task keeps at most (and those of a part); words of a part; what a code point is
#: multiplied by; words that are hashed at once; texts that are Python objects at once.
CACHE_SIZE, PART, FACTOR, WORDS_AT_ONCE, ROWS = 200_000, 50_000, 0x100000001B3, 20_000, 500


def subwords(vocabulary: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Position of a word and bucket, for the distinct buckets of each word, some thousand words at a time."""
    parts = [subwords_of(vocabulary[k : k + WORDS_AT_ONCE]) for k in range(0, max(len(vocabulary), 1), WORDS_AT_ONCE)]
    return np.concatenate([w + k * WORDS_AT_ONCE for k, (w, _) in enumerate(parts)]).astype(np.int32), np.concatenate([b for _, b in parts]).astype(np.int32)


def subwords_of(vocabulary: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a word: its character n-grams, its ends marked, and itself.

    All words at once: they lie in one array of code points with marks between them,
    and an n-gram is a polynomial of its code points, so that a whole word and an
    equal n-gram share a bucket.
    """
    if not vocabulary:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    text = b"\n" + b"\n".join(vocabulary) + b"\n"  # words hold no white space
    points = np.frombuffer(text.decode().encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    marks = np.flatnonzero(points == ord("\n") + 1)
    start, length = marks[:-1], np.diff(marks) + 1
    owner = np.repeat(np.arange(len(start)), length - 1)
    room = np.repeat(marks[1:], length - 1) - np.arange(marks[-1]) + 1  # code points up to the next mark
    power = np.full(int(length.max()), FACTOR, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    whole = np.add.reduceat(points[:-1] * power[np.arange(marks[-1]) - np.repeat(start, length - 1)], start) + points[marks[1:]] * power[length - 1]
    hashes, words_at = [whole], [np.arange(len(start))]
    gram = np.zeros(len(room), np.uint64)
    for n in range(max(SIZES)):
        gram[: len(room) - n + 1] += points[n : n + len(room)][: len(room) - n + 1] * power[n] if n < len(power) else np.uint64(0)
        if n + 1 in SIZES:
            fits = room >= n + 1
            hashes.append(gram[fits])
            words_at.append(owner[fits])
    mixed = np.concatenate(hashes) * np.uint64(0x9E3779B97F4A7C15)
    bucket = ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) % BUCKETS
    found = distinct(np.concatenate(words_at) * BUCKETS + bucket)
    return found // BUCKETS, found % BUCKETS


def windows(n: int) -> np.ndarray:
    """First words of the windows of a text of n words."""
    return np.arange(0, max(n - WINDOW, 0) + STRIDE, STRIDE) if n > WINDOW else np.zeros(min(n, 1), int)


class Bags:
    """Word lists as index arrays: windows over words over n-gram buckets."""

    def __init__(self, texts: list[list[bytes]]):
        vocab: dict[bytes, int] = {}
        ids = [np.array([vocab.setdefault(w, len(vocab)) for w in t], int) for t in texts]
        self.gram_word, self.grams = subwords(list(vocab))
        self.gram_n = np.bincount(self.gram_word, minlength=len(vocab))
        self.weight_n = self.gram_n + SHRINK
        self.gram_at = np.concatenate([[0], self.gram_n.cumsum()[:-1]])
        spans = [(d, t[s : s + WINDOW]) for d, t in enumerate(ids) for s in windows(len(t)) if s < len(t)]
        self.doc = np.array([d for d, _ in spans])
        self.word_n = np.array([len(s) for _, s in spans])
        self.words = np.concatenate([s for _, s in spans]).astype(np.int32)
        self.word_at = np.concatenate([[0], self.word_n.cumsum()[:-1]])
        self.word_window = np.repeat(np.arange(len(spans), dtype=np.int32), self.word_n)
        self.seen = np.zeros(BUCKETS, int)
        grams = np.split(self.grams, self.gram_at[1:])
        for t in ids:  # document by document: all pairs at once would be the driver's largest array
            self.seen[distinct(np.concatenate([grams[w] for w in set(t.tolist())]))] += 1

    def forward(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # One dimension at a time, which keeps the driver's arrays small.
        of_words = np.stack([np.add.reduceat(table[:, k][self.grams], self.gram_at) / self.weight_n for k in range(DIM)], 1)
        return of_words, np.stack([np.add.reduceat(of_words[:, k][self.words], self.word_at) / self.word_n for k in range(DIM)], 1)

    def backward(self, grad: np.ndarray) -> np.ndarray:
        """Gradient of the bucket table from that of the window vectors."""
        out = np.empty((BUCKETS, DIM), np.float32)
        for k in range(DIM):
            of_words = np.bincount(self.words, (grad[:, k] / self.word_n)[self.word_window], len(self.gram_n)) / self.weight_n
            out[:, k] = np.bincount(self.grams, of_words[self.gram_word], BUCKETS)
        return out


def train(texts: list[list[bytes]], toxic: list[int]) -> dict:
    """Embedding table, softmax weights and bias.

    What was learnt by heart stands farther from the edge than what is new, so the
    edge is found on texts that took no part: a first model learns from three of
    four texts of each class and tells where the fourth ones lie; the final one
    learns from all.  With fewer than ``ENOUGH`` texts of a class the edge comes
    from the learnt texts.
    """
    kept = [(t, y) for t, y in zip(texts, toxic, strict=True) if t]
    if len({y for _, y in kept}) < 2:
        share = (sum(toxic) + 1) / (len(toxic) + 20)
        return {"table": np.zeros((BUCKETS, DIM)), "weights": np.zeros((DIM, 2)), "bias": np.array([0.0, np.log(share / (1 - share))])}
    rows = [[t for t in kept if t[1] == y] for y in (0, 1)]
    if min(map(len, rows)) < ENOUGH:
        model, *learnt = descend(kept)
        return model | {"bias": model["bias"] + [0.0, shift(model, *learnt)]}
    first = descend([t for k in rows for i, t in enumerate(k) if i % 4])[0]
    held = [t for k in rows for t in k[::4]]
    edge = shift(first, Bags([t for t, _ in held]), np.array([y for _, y in held]))
    model = descend(kept)[0]
    return model | {"bias": model["bias"] + [0.0, edge]}


def descend(kept: list[tuple[list[bytes], int]]) -> tuple[dict, Bags, np.ndarray]:
    """A model of the texts, without the shift of its edge, and what it learnt from."""
    bags, label = Bags([t for t, _ in kept]), np.array([y for _, y in kept])
    rng = np.random.default_rng(7)
    known = (bags.seen >= MIN_SEEN)[:, None]
    params = [(rng.normal(0, 0.1, (BUCKETS, DIM)) * known).astype(np.float32), rng.normal(0, 0.5, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    per_doc = np.bincount(bags.doc, minlength=len(label))
    of_window = label[bags.doc]
    share = 1 / per_doc[bags.doc]
    for epoch in range(EPOCHS):
        _, vectors = bags.forward(params[0])
        logits = vectors @ params[1] + params[2]
        p = 1 / (1 + np.exp(np.clip(logits[:, 0] - logits[:, 1], -50, 50)))
        weight = share.copy()
        if epoch >= EPOCHS // 3:  # only the highest windows of a toxic document are held toxic
            top = np.full(len(label), -1.0)
            np.maximum.at(top, bags.doc, p)
            peak = p >= top[bags.doc] * 0.98
            count = np.bincount(bags.doc, peak, len(label))[bags.doc]
            weight = np.where(of_window == 1, peak / count, share / 2 + peak / count / 2)
        for y in (0, 1):
            weight[of_window == y] /= weight[of_window == y].sum()
        error = (p - of_window) * weight
        grad = np.stack([-error, error], 1)
        steps = [bags.backward(grad @ params[1].T) * known + DECAY * params[0], vectors.T @ grad, grad.sum(0)]
        for q, g, m, v in zip(params, steps, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            q -= 0.15 * (m / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(v / (1 - 0.99 ** (epoch + 1))) + 1e-9)
    return {"table": params[0], "weights": params[1], "bias": params[2]}, bags, label


def shift(model: dict, bags: Bags, label: np.ndarray) -> float:
    """What to add to the toxic logit so that 0.5 parts the classes' highest windows best."""
    _, vectors = bags.forward(model["table"])
    margin = (vectors @ model["weights"] + model["bias"]) @ [-1.0, 1.0]
    top = np.full(len(label), -np.inf)
    np.maximum.at(top, bags.doc, margin)
    order = np.argsort(top)
    ranked = label[order]
    missed = np.concatenate([[0], ranked.cumsum()]) / max(ranked.sum(), 1)
    false = np.concatenate([[(1 - ranked).sum()], (1 - ranked).sum() - (1 - ranked).cumsum()]) / max((1 - ranked).sum(), 1)
    best = np.flatnonzero((missed + 2 * false) == (missed + 2 * false).min())
    edges = np.concatenate([[top.min() - 1], np.sort(top), [top.max() + 1]])
    return float(-(edges[best[0]] + edges[best[-1] + 1]) / 2)


class Scorer:
    """Word scores are linear in the embedding, so each word is one cached number."""

    def __init__(self, model: dict):
        self.table = model["table"] @ (model["weights"][:, 1] - model["weights"][:, 0])
        self.bias = float(model["bias"][1] - model["bias"][0])
        self.cache: dict[bytes, float] = {}

    def learn(self, new: list[bytes]) -> None:
        """Scores of words, all at once."""
        word, bucket = subwords(new)
        n = np.bincount(word, minlength=len(new))
        self.cache.update(zip(new, (np.bincount(word, self.table[bucket], len(new)) / (n + SHRINK)).tolist(), strict=True))

    def scores(self, texts: list[str | None]) -> list[float]:
        """Scores of texts, in parts of about ``PART`` words whose new words are learnt together."""
        out, part, held = [], [], 0
        for text in texts:
            part.append(words(text))
            held += len(part[-1])
            if held >= PART:
                out += self.part(part)
                part, held = [], 0
        return out + self.part(part)

    def part(self, texts: list[list[bytes]]) -> list[float]:
        if len(self.cache) >= CACHE_SIZE:
            self.cache.clear()
        self.learn(list({w for t in texts for w in t if w not in self.cache}))
        return [self.windowed(t) for t in texts]

    def score(self, text: str | None) -> float:
        return self.scores([text])[0]

    def windowed(self, text: list[bytes]) -> float:
        """The score of the highest window of words that were learnt."""
        s = np.fromiter(map(self.cache.__getitem__, text), float, len(text))
        margin = self.bias
        if len(s):
            size = min(WINDOW, len(s))
            total = np.concatenate([[0.0], s.cumsum()])
            margin += float((total[size:] - total[:-size]).max() / size)
        return float(1 / (1 + np.exp(-np.clip(margin, -500, 500))))


def sample_rows(docs: DataFrame, labels: DataFrame, max_docs: int, max_chars: int, max_text: int) -> list:
    """A bounded, repeatable sample, a third of it toxic where there is as much: ids first, then their texts."""
    chars = F.length(F.coalesce("text", F.lit("")))
    labelled = docs.select("doc_id", chars.alias("chars")).where(F.col("chars") <= max_text).join(labels.select("doc_id", "toxic").where("toxic is not null").dropDuplicates(["doc_id"]), "doc_id")
    picked: dict[int, int] = {}
    for y, share in ((0, 2 / 3), (1, 1 / 3)):
        left = max_chars * share
        for r in labelled.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(int(max_docs * share)).collect():
            if r["chars"] <= left and r["doc_id"] not in picked:
                left -= r["chars"]
                picked[r["doc_id"]] = y
    if not picked:
        return []
    chosen = F.broadcast(docs.sparkSession.createDataFrame(list(picked.items()), "doc_id long, toxic int"))  # max_docs rows at most
    return docs.select("doc_id", "text").where(chars <= max_text).join(chosen, "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS, max_text: int = MAX_TEXT) -> dict:
    """Fits on a sample of at most ``max_docs`` labelled rows of up to ``max_text``, together ``max_chars``, characters."""
    rows = sample_rows(docs, labels, max_docs, max_chars, max_text)
    model = train([words(r["text"]) for r in rows], [int(r["toxic"]) for r in rows])
    del rows
    give_back()  # the driver goes on with other work
    return model


def score_documents(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with score and predicted; the model has a fixed size."""
    shipped = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    names = docs.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(pickle.loads(shipped.value))
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            scores = scorer.scores(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], [*names, "score", "predicted"])

    kept = [f for f in docs.schema.fields if f.name not in ("score", "predicted")]
    names = [f.name for f in kept]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return docs.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(frugal(score), f"{schema}, score double, predicted int")
