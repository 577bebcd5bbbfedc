"""Operators 11 to 13 against formulas, brute force and awkward tables."""

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from llm_fixtures import SF, TEXTS, awkward, duck, empty, frame  # noqa: E402

from fieldmark.llm import quality, queries, ranked_search, vector_codes  # noqa: E402

Q = queries.queries()

# 11 ---------------------------------------------------------------------------------------------


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in Q["op11_quality"](spark, sf).collect()}
    marks = dict(duck(sf).sql("select doc_id, quality from labels").fetchall())
    assert len(got) == duck(sf).sql("select count(*) from documents").fetchall()[0][0]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for i, r in got.items())
    held = [(r.predicted, marks[i]) for i, r in got.items() if r.held_out and i in marks]
    assert np.mean([p for p, y in held if y]) >= 0.98
    assert np.mean([1 - p for p, y in held if not y]) >= 0.95


def test_quality_density_is_the_normal_one():
    rng = np.random.default_rng(3)
    size = len(quality.NAMES)
    x = {k: rng.normal(k, 1 + k, (400, size)) @ rng.normal(0, 1, (size, size)) for k in (0, 1)}
    one = {k: np.concatenate([np.ones((400, 1)), v], 1) for k, v in x.items()}
    model = quality.Discriminant({k: v.T @ v for k, v in one.items()})
    at, want = rng.normal(0, 2, (20, size)), np.zeros(20)
    pooled = sum(np.cov(x[k].T, bias=True) for k in x) / 2
    unit = np.sqrt(np.diag(pooled))
    for k, sign in ((1, 1), (0, -1)):
        cov = quality.shrunk(((1 - quality.POOL) * np.cov(x[k].T, bias=True) + quality.POOL * pooled) / np.outer(unit, unit), 400)
        way = (at - x[k].mean(0)) / unit
        want += sign * -0.5 * (np.einsum("ij,jk,ik->i", way, np.linalg.inv(cov), way) + np.linalg.slogdet(cov)[1])
    assert np.allclose(model.difference(at), want)


def test_quality_sums_see_every_row(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(quality.with_statistics(docs), labels)
    rows = duck().sql("select text, quality from documents join labels using (doc_id)").fetchall()
    x = {k: np.array([quality.statistics((t or "").encode()) for t, y in rows if y == k]) for k in (0, 1)}
    for k in (0, 1):
        assert np.allclose(model.mean[k] * model.unit, x[k].mean(0))


def test_quality_awkward(spark):
    labels = spark.createDataFrame([(5, 0), (5, 1), (6, None), (7, 1), (8, 0), (9, 0), (10, 1), (None, 1)], "doc_id long, quality int")
    docs = awkward(spark)
    measured = quality.with_statistics(docs)
    got = quality.score_documents(measured, quality.fit(measured, labels)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert got[0].lang == "en" and "text" not in got[0].asDict()
    assert len({r.score for r in got if r.doc_id in (0, 1, 2)}) == 1  # null, empty, blank
    one = quality.score_documents(measured, quality.fit(measured, labels.where("quality = 1")))
    assert all(r.score == pytest.approx(6 / 7) for r in one.collect())  # three rows of id 5, one each of 7 and 10; the null id has no label
    none = quality.with_statistics(empty(spark))
    assert quality.score_documents(none, quality.fit(none, labels.limit(0))).count() == 0


# 12 ---------------------------------------------------------------------------------------------


def coded(rows, entries=64, rounds=2):
    """(id, ints) rows in order: codes, errors and codebooks by whole scans in Python integers."""
    dim = len(rows[0][1])
    cut = [(i * dim // 16, (i + 1) * dim // 16) for i in range(16)]
    books = [[list(x[a:b]) for _, x in rows[:entries]] for a, b in cut]
    near = lambda x, book: min((sum((p - q) ** 2 for p, q in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for n in range(rounds + 1):
        at = [[near(x[a:b], books[p]) for p, (a, b) in enumerate(cut)] for _, x in rows]
        for p, (a, b) in enumerate(cut) if n < rounds else ():
            for e in range(len(books[p])):
                mine = [x[a:b] for (_, x), c in zip(rows, at, strict=True) if c[p][1] == e]
                if mine:
                    books[p][e] = [sum(v) // len(mine) for v in zip(*mine, strict=True)]
    return [("".join(f"{k:02x}" for _, k in c), sum(d for d, _ in c)) for c in at], books


@pytest.mark.parametrize("spread", [3, 400])
def test_codes_against_whole_scans(spark, spread):
    rng = random.Random(spread)  # of few values, so that equal distances abound
    rows = [(rng.randrange(200), [rng.randint(-spread, spread) for _ in range(32)]) for _ in range(300)]
    rows += [rows[3], rows[3]]
    table = spark.createDataFrame([(i, [x / 256 + 0.001 for x in v], i % 3 if i % 5 else None) for i, v in rows], "vec_id long, embedding array<double>, label int").repartition(5)
    state, books = vector_codes.learn_codes(table)
    want, want_books = coded(sorted(rows))
    assert [b.tolist() for b in books] == want_books
    assert sorted((r.vec_id, bytes(r.code).hex(), r.error) for r in state.collect()) == sorted((i, c, e) for (i, _), (c, e) in zip(sorted(rows), want, strict=True))
    got = vector_codes.compress(table).collect()
    of = Counter()
    for (i, _), (_, e) in zip(sorted(rows), want, strict=True):
        of[i % 3 if i % 5 else None] += e
    assert len(got) == 302 and all(r.label_error == of[r.vec_id % 3 if r.vec_id % 5 else None] for r in got)
    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(",".join(str(x) for b in want_books for e in b for x in e).encode()).hexdigest()}


def test_bounds_spare_scans(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 1, (64, 16))
    rows = [(i, (centres[i % 64] + rng.normal(0, 0.01, 16)).tolist()) for i in range(1280)]
    state, _ = vector_codes.learn_codes(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    scans = [r.scans for r in state.collect()]
    assert sum(scans) < 0.5 * 16 * len(rows)


def test_bounds_hold_while_entries_move():
    rng = np.random.default_rng(2)
    x, books = rng.integers(-9, 9, (500, 3)), rng.integers(-9, 9, (12, 3))
    code, upper, lower, _ = vector_codes.assign(x, books)
    for _ in range(20):
        now = books + rng.integers(-1, 2, books.shape)
        code, upper, lower, _ = vector_codes.assign(x, now, vector_codes.Moved(books, now), code, upper.astype(np.float32).astype(float) * (1 + 1e-6), lower.astype(np.float32).astype(float) * (1 - 1e-6))
        d = ((x[:, None] - now[None]) ** 2).sum(2)
        assert (code == d.argmin(1)).all()
        assert (upper >= np.sqrt(d.min(1))).all() and (lower <= np.sqrt(np.sort(d, 1)[:, 1])).all()
        books = now


def test_codes_awkward(spark):
    schema = "vec_id long, embedding array<double>, label string, code string, part int"
    rows = [(1, [0.5] * 32), (1, [0.5] * 32), (None, [0.25] * 32), (2, None), (3, [None] * 32), (4, [math.nan] * 32), (5, [math.inf] * 32), (6, [1.0] * 3), (7, [1e30] * 32), (8, [])]
    table = spark.createDataFrame([(*r, None, "c", 1) for r in rows], schema)
    got = vector_codes.compress(table).collect()
    assert sorted((r.vec_id or 0, r.code, r.error, r.label_error) for r in got) == [(0, "02" * 16, 0, 0), (1, "00" * 16, 0, 0), (1, "00" * 16, 0, 0)]
    assert vector_codes.compress(table.limit(0)).count() == 0
    short = spark.createDataFrame([(k, [float(k)] * 5) for k in range(70)], "vec_id long, embedding array<double>")
    assert vector_codes.compress(short).count() == 70


# 13 ---------------------------------------------------------------------------------------------


def split(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, items, k):
    held = [(i, Counter(t)) for i, x in docs if (t := split(x))]
    n_docs, total, df = len(held), sum(c.total() for _, c in held), Counter(t for _, c in held for t in c)
    out = []
    for item, text in items.items():
        found = []
        for i, c in held:
            m = 75 + 25 * c.total() * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in split(text) if c[t])
            if score > 0:
                found.append((-score, math.inf if i is None else i))
        out += [(item, r + 1, None if i == math.inf else i, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard_docs", [1, 7, 1000])
def test_search_against_brute_force(spark, shard_docs):
    rng = random.Random(shard_docs)
    words = [f"w{i}" for i in range(30)] + ["Éa", "é", "9", "ſ"]
    share = [1 / (i + 1) for i in range(len(words))]
    texts = [" ".join(rng.choices(words, share, k=rng.randrange(12))) for _ in range(150)]
    docs = [(rng.choice([None, *range(100)]), t) for t in texts] + [(500, "W0-w1_w2\x00w3\x7fÉa"), (501, None), (502, "")]
    items = {i: " ".join(rng.choices([*words, "unmet"], k=rng.randrange(9))) for i in range(30)} | {98: "", 99: "unmet"}
    table = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, shard string").repartition(3)
    index = ranked_search.build_index(table, shard_docs=shard_docs)
    asked = spark.createDataFrame([*items.items(), (None, None), (97, None), (5, "~"), (5, items[5])], "item_id long, text string")
    asked = asked.where("text is null or text <> '~'").withColumn("rank", asked.item_id)
    for k in (1, 4, 20):
        got = sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in ranked_search.search(index, asked, k).collect()), key=repr)
        assert got == ranked(docs, items, k)


def test_search_blocks_of_items(spark, monkeypatch):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = sorted(map(tuple, Q["op13_ranked_search"](spark, SF).collect()))
    monkeypatch.setattr(ranked_search, "BLOCK_BYTES", 2000)
    assert sorted(map(tuple, ranked_search.search(ranked_search.build_index(docs), items).collect())) == whole


def test_postings_bytes():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**31, 5])
    data, size = ranked_search.packed(values)
    assert ranked_search.unpacked(data.tobytes()).tolist() == values.tolist() and size.sum() == len(data)
    assert ranked_search.unpacked(b"").tolist() == []


def test_terms_of_long_texts_are_whole_at_pieces(monkeypatch):
    text = "ab cd efg " * 50 + "x" * 90 + " end"
    monkeypatch.setattr(ranked_search, "PIECE", 7)
    assert [t.decode() for p in ranked_search.terms(text.encode()) for t in p] == split(text)


def test_search_awkward(spark):
    docs = awkward(spark)
    index = ranked_search.build_index(docs)
    items = spark.createDataFrame([(1, "b last"), (2, None), (3, "</s>"), (4, "WORD"), (None, "naïve")], "item_id long, text string")
    got = sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in ranked_search.search(index, items).collect()), key=repr)
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    assert got == ranked(pairs, {1: "b last", 3: "</s>", 4: "WORD", None: "naïve"}, 20)
    assert ranked_search.search(ranked_search.build_index(empty(spark)), items).count() == 0
    assert ranked_search.search(index, items.limit(0)).count() == 0
    assert frame(spark, TEXTS).count() == len(TEXTS)
