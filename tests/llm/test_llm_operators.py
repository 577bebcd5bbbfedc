"""The ten operators against SQL, brute force, the libraries, and awkward tables."""

import hashlib
import math
import random
import re
import struct
import sys
import zlib
from collections import Counter
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from llm_fixtures import SF, TEXTS, awkward, duck, empty, frame, rows  # noqa: E402

from fieldmark.llm import ann, chat, decontamination, jaccard_join, katz, line_dedup, queries, sentencepiece_bpe, sharding, token_counts, toxicity  # noqa: E402

Q = queries.queries()


def tokens(text):
    return [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    mine, theirs = Q[name](spark, SF).toPandas(), duck().sql(queries.oracle_sql()[name]).df()
    cols = sorted(mine.columns)
    assert cols == sorted(theirs.columns)
    assert sorted(map(repr, mine[cols].values.tolist())) == sorted(map(repr, theirs[cols].values.tolist()))


# 1 ----------------------------------------------------------------------------------------------


def test_token_counts(spark):
    path, pattern = queries.vocabulary(queries.BPE_RANKS), queries.token_pattern()
    code = token_counts.encoder(path, pattern).encode_ordinary
    docs = awkward(spark)
    got = token_counts.tokens_per_document(spark, docs, path, pattern).collect()
    assert sorted((r[0] is None, r[0] or 0, r[1]) for r in got) == sorted((r.doc_id is None, r.doc_id or 0, len(code(r.text or ""))) for r in docs.collect())
    assert token_counts.tokens_per_document(spark, empty(spark), path, pattern).count() == 0
    assert token_counts.separator_of(path, pattern) == 50256


def test_token_counts_of_many_documents_in_a_file(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "IDS", 3)
    path, pattern = queries.vocabulary(queries.BPE_RANKS), queries.token_pattern()
    docs = spark.createDataFrame([(k, "a " * k) for k in range(20)], "doc_id long, text string").coalesce(1)
    code = token_counts.encoder(path, pattern).encode_ordinary
    assert sorted(map(tuple, token_counts.tokens_per_document(spark, docs, path, pattern).collect())) == [(k, len(code("a " * k))) for k in range(20)]


def test_a_vocabulary_beyond_16_bits_is_refused(monkeypatch):
    monkeypatch.setattr(token_counts, "LARGEST", 50_000)
    with pytest.raises(ValueError, match="16 bits"):
        token_counts.separator_of(queries.vocabulary(queries.BPE_RANKS), queries.token_pattern())


@pytest.mark.parametrize("block", [1, 2, 7, 1000])
def test_separator_scan_stitches_blocks(spark, tmp_path, block):
    rng = np.random.default_rng(block)
    files, want = [], []
    for k in range(3):
        ids = rng.choice([9, 9, 9, 1], 60).astype("<u2")
        (tmp_path / f"{k}.bin").write_bytes(ids.tobytes())
        files.append((f"{tmp_path}/{k}.bin", len(ids)))
        at = 0
        for place, piece in enumerate(np.split(ids, np.flatnonzero(ids == 1) + 1)):
            if len(piece):
                want.append((files[-1][0], place, int((piece != 1).sum())))
                at += 1
    token_counts_rows = token_counts.count_documents(spark.createDataFrame(files, "path string, n_tokens long"), 1, block).collect()
    assert sorted(map(tuple, token_counts_rows)) == sorted(want)


# 2 ----------------------------------------------------------------------------------------------


def test_sharding(spark):
    got = Q["op2_sharding"](spark, SF).toPandas()
    docs = duck().sql("select doc_id, coalesce(text, '') as text from documents").df()
    assert sorted(got.doc_id) == sorted(docs.doc_id)
    crc = dict(zip(docs.doc_id, (zlib.crc32(t.encode()) for t in docs.text), strict=True))
    assert all(crc[i] == c for i, c in zip(got.doc_id, got.text_crc32, strict=True))
    load = got.groupby("shard")["size"].sum().reindex(range(8), fill_value=0)
    assert load.max() - load.min() <= got["size"].max()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


def test_sharding_of_awkward_rows_and_growth(spark):
    docs = awkward(spark)
    got, slot_map = sharding.assign_shards(docs, 3)
    assert got.count() == docs.count() and got.agg(F.sum("size")).first()[0] == sum(len((r.text or "").encode()) + 1 for r in docs.collect())
    assert sharding.assign_shards(empty(spark), 3)[0].count() == 0
    grown = sharding.grown_map(slot_map, sharding.slot_sizes(sharding.slotted(docs)), 3)
    before, after = {r.virtual_slot: r.shard for r in slot_map.collect()}, {r.virtual_slot: (r.shard, r.version) for r in grown.collect()}
    assert all(after[s][0] in (before[s], 3) and after[s][1] == 2 for s in before)


# 3 ----------------------------------------------------------------------------------------------


def test_sharding_map_is_stored_and_edited(spark, tmp_path):
    docs, path = spark.read.parquet(f"{SF}/documents.parquet"), str(tmp_path / "map")
    rows_1, used = sharding.assign_shards(docs, 3, map_path=path)
    grown = sharding.rebalance(docs, path)
    assert {r.version for r in grown.collect()} == {2} and grown.count() == used.count()
    rows_2, _ = sharding.assign_shards(docs, map_path=path, first=False)
    before, after = ({(r.doc_id, r.text_crc32): r.shard for r in x.collect()} for x in (rows_1, rows_2))
    assert all(after[k] in (s, 3) for k, s in before.items()) and set(after.values()) == {0, 1, 2, 3}
    held = rows_2.groupBy("shard").agg(F.sum("size").alias("b")).toPandas().b
    assert held.max() <= 1.2 * held.mean()
    assert sharding.load_map(spark, path, 1).exceptAll(used).count() == 0


def test_sharding_of_other_documents_under_an_old_map(spark, tmp_path):
    docs, path = spark.read.parquet(f"{SF}/documents.parquet"), str(tmp_path / "map")
    sharding.assign_shards(docs.where("doc_id < 50"), 3, map_path=path)
    rows, used = sharding.assign_shards(docs, map_path=path, first=False)
    assert rows.count() == docs.count() and used.count() == sharding.N_SLOTS
    assert set(rows.toPandas().groupby("shard").size().index) == {0, 1, 2}
    again, _ = sharding.assign_shards(docs, 3, map_path=path)  # a second first map is the next version
    assert again.count() == docs.count() and sharding.latest_version(spark, path) == 2
    sharding.store_map(used.where("virtual_slot > 2000"), path)
    with pytest.raises(Exception, match="the map has no slot"):
        sharding.assign_shards(docs, map_path=path, first=False)[0].collect()


def recall(got, ids, x, asked):
    """Share of the true ten nearest that were found; ranks, scores and their order are checked on the way."""
    hits = total = 0
    by_query = dict(list(got.groupby("query_id")))
    for q in asked:
        dist = np.sqrt(((x - x[q]) ** 2).sum(1))
        dist[q] = np.inf
        mine = by_query[ids[q]].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, 11))
        assert np.allclose(mine.score, dist[np.searchsorted(ids, mine.vec_id)], rtol=1e-12)
        assert list(zip(mine.score, mine.vec_id)) == sorted(zip(mine.score, mine.vec_id))
        hits += len(set(mine.vec_id) & set(ids[np.lexsort((ids, dist))[:10]]))
        total += 10
    return hits / total


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_ann_recall(spark, sf):
    d = f"/root/testdata/sf{sf}"
    table = duck(d).sql("select vec_id, embedding from embeddings order by vec_id").df()
    x, ids = np.stack(table.embedding.to_numpy()).astype(float), table.vec_id.to_numpy()
    assert recall(Q["op3_ann"](spark, d).toPandas(), ids, x, np.flatnonzero(ids % 100 == 0)) >= 0.9
    vectors = spark.read.parquet(f"{d}/embeddings.parquet")
    assert recall(ann.search(vectors, vectors).toPandas(), ids, x, range(len(ids))) >= 0.9


def odd_rows(kind, n, r):
    if kind == "lengths":
        return r.normal(size=(n, 64)) * np.exp(3 * r.normal(size=(n, 1)))
    if kind == "many dimensions":
        return r.normal(size=(n, 300))
    if kind == "offset":
        return 1e6 + r.normal(size=(n, 16))
    if kind == "large":
        return 1e200 * r.normal(size=(n, 4))  # whose squares are infinite
    x = r.integers(-1, 2, size=(n, 5)).astype(float)  # copies and ties
    x[n // 2 :] = x[0] + 1e-4 * r.normal(size=(n - n // 2, 5))
    x[0, 0] = 1
    return x


def nearest_by_hand(ids, x, q, k):
    with np.errstate(over="ignore"):
        dist = np.sqrt(sum((x[:, j] - x[q, j]) ** 2 for j in range(x.shape[1])))
    return [(d, i) for d, i in sorted(zip(dist, ids)) if i != ids[q]][:k]


@pytest.mark.parametrize("kind", ["lengths", "many dimensions"])
def test_ann_finds_the_nearest_of_odd_rows(spark, kind):
    x = odd_rows(kind, 2500, np.random.default_rng(3))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = dict(list(ann.search(v, v.where("vec_id % 100 = 0")).toPandas().sort_values("rank").groupby("query_id")))
    for q in range(0, len(x), 100):
        assert list(zip(got[q].score, got[q].vec_id)) == nearest_by_hand(range(len(x)), x, q, 10)


@pytest.mark.parametrize("kind", ["lengths", "many dimensions", "offset", "large", "copies"])
@pytest.mark.parametrize("ring, probes, depth", [(4096, 1, 64), (7, 3, 0)])
def test_ann_slice_leaves_out_only_what_is_farther(monkeypatch, kind, ring, probes, depth):
    monkeypatch.setattr(ann, "RING", ring)
    r = np.random.default_rng(8)
    x = odd_rows(kind, 700, r)
    ids = r.integers(0, 500, len(x))  # an id in several rows
    held = ann.Slice(ids, np.arange(len(x)), x, ann.kmeans(x[:200], 20) if kind != "large" else x[:20], 4)
    q, at, score = held.nearest(ids[:90], x[:90], probes, depth)
    for i in range(90):
        assert sorted(zip(score[q == i], held.ids[at[q == i]])) == nearest_by_hand(ids, x, i, 4)


def test_ann_over_slices_and_blocks_finds_the_same(spark, monkeypatch):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    asked = vectors.where("vec_id % 7 = 0")
    want = sorted(map(tuple, ann.search(vectors, asked, depth=20).collect()))
    monkeypatch.setattr(ann, "SLICE", 200)
    monkeypatch.setattr(ann, "FEWEST", 20)
    assert sorted(map(tuple, ann.search(vectors, asked, depth=20).collect())) == want


def test_ann_takes_the_most_frequent_dimension(spark):
    x = np.random.default_rng(4).normal(size=(39, 6))
    rows = [(i, r.tolist()) for i, r in enumerate(x)] + [(100 + i, [1.0, 2.0]) for i in range(20)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(v, v).toPandas()
    assert len(got) == 390 and set(got.query_id) == set(got.vec_id) == set(range(39))


def test_ann_awkward(spark):
    schema = "vec_id long, embedding array<float>, list int, code string"
    vectors = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [float("inf"), 1.0]), (9, [1.0]), (None, [1.0, 1.0])]
    v = spark.createDataFrame([(*r, 1, "c") for r in vectors], schema)
    got = ann.search(v, v.where("vec_id = 0"), probes=1000).collect()
    assert [(r.rank, r.vec_id) for r in sorted(got, key=lambda r: r.rank)] == [(1, 1), (2, 2), (3, 3)]
    assert ann.search(v.limit(0), v).count() == 0 and ann.search(v, v.limit(0)).count() == 0


@pytest.mark.parametrize("n", [2, 3, 11, 17, 24, 40])
def test_ann_finds_all_there_are_in_small_tables(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 4))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(v, v).toPandas()
    for q in range(n):
        mine = got[got.query_id == q].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, min(10, n - 1) + 1)) and len(set(mine.vec_id) - {q}) == len(mine)


def test_ann_query_in_several_rows_asks_once(spark):
    rows = [(0, [0.1, 1.0]), (0, [0.1, 1.0]), (0, [9.0, 1.0])] + [(i, [float(i), 1.0]) for i in range(1, 15)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(v, v.where("vec_id = 0"), probes=1000).orderBy("rank").collect()
    assert [(r.rank, r.vec_id) for r in got] == [(i, i) for i in range(1, 11)]


# 4 ----------------------------------------------------------------------------------------------


def good_turing(n):
    d = {}
    for r in range(1, 6):
        v = -1.0
        if n[1] and n[r] and 6 * n[6] < n[1]:
            tail = 6 * n[6] / n[1]
            v = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail)
        d[r] = v if 0 < v < 1 else 1 - 0.5 / r
    return lambda c: d.get(c, 1.0)


def katz_brute(docs):
    """Plain dictionaries: scores by document and the model's probabilities."""
    train = [tokens(t) + ["</s>"] for t, held in docs if not held]
    uni = Counter(w for t in train for w in t)
    pairs = Counter((v, w) for t in train for v, w in zip(["<s>", *t], t))
    total, types = sum(uni.values()), len(uni)
    d1, d2 = good_turing(Counter(uni.values())), good_turing(Counter(pairs.values()))
    freed = sum(c * (1 - d1(c)) for c in uni.values()) / total
    least = 1 / (total + types + 1)
    scale = 1.0 if freed >= least else (1 - least) / (1 - freed)
    p1 = lambda w: d1(uni[w]) * uni[w] / total * scale if uni[w] else max(freed, least)
    after = {}
    for (v, w), c in pairs.items():
        after.setdefault(v, {})[w] = c

    def p2(v, w):
        if v not in after:
            return p1(w)
        of, n = after[v], sum(after[v].values())
        gone = sum(c * (1 - d2(c)) for c in of.values()) / n
        low = 0.5 / (n + 1)
        if w in of:
            return d2(of[w]) * of[w] / n * (1.0 if gone >= low else (1 - low) / (1 - gone))
        return max(gone, low) / max(1 - sum(map(p1, of)), max(freed, least)) * p1(w)

    scores = [sum(math.log10(p2(v, w)) for v, w in zip(["<s>", *t], t)) for t in ([*tokens(x), "</s>"] for x, _ in docs)]
    base = [sum(math.log10((uni[w] + 1) / (total + types + 1)) for w in [*tokens(x), "</s>"]) for x, _ in docs]
    return scores, base, total, (p2, uni, after)


@pytest.mark.parametrize(("chunk", "bucket"), [(50, 400), (1_000_000, 12 << 20)])
def test_katz_against_dictionaries(spark, monkeypatch, chunk, bucket):
    monkeypatch.setattr(katz, "CHUNK_TOKENS", chunk)
    monkeypatch.setattr(katz, "BUCKET_BYTES", bucket)
    rng = random.Random(3)
    texts = [" ".join(f"w{min(int(rng.paretovariate(0.8)), 40)}" for _ in range(rng.randrange(30))) for _ in range(60)] + [None, "", "new words only", "W1 w1\tw1\x0bw1"]
    docs = [(t, i % 7 == 2) for i, t in enumerate(texts)]
    table = spark.createDataFrame([(i, t, h, 1) for i, (t, h) in enumerate(docs)], "doc_id long, text string, held_out boolean, bucket int")
    got = katz.score_documents(table).orderBy("doc_id").toPandas()
    scores, base, total, (p2, uni, after) = katz_brute(docs)
    assert np.allclose(got.score, scores) and np.allclose(got.base_score, base) and set(got.train_tokens) == {total}
    assert list(got.n_tokens) == [len(tokens(t)) + 1 for t in texts]
    for v in ["<s>", b"w1", b"w7"]:
        assert math.isclose(sum(p2(v, w) for w in [*uni, "never seen"]), 1.0, rel_tol=1e-9)


def test_katz_awkward(spark):
    docs = awkward(spark)
    got = katz.score_documents(docs.withColumn("held_out", F.lit(False)))
    assert got.count() == docs.count() and got.where("score > 0 or score is null or isnan(score)").count() == 0
    assert katz.score_documents(empty(spark).withColumn("held_out", F.lit(False))).count() == 0
    untrained = katz.score_documents(docs.withColumn("held_out", F.lit(True))).select("score", "train_tokens").distinct().collect()
    assert [tuple(r) for r in untrained] == [(0.0, 0)]


def test_katz_fails_when_the_second_pass_sees_other_chunks(spark):
    docs = frame(spark, ["a b c", "d e"]).select("doc_id", "text").withColumn("held_out", F.lit(False)).coalesce(1)
    other = frame(spark, ["a b", "c d e"]).select("doc_id", "text").withColumn("held_out", F.lit(False)).coalesce(1)
    words = katz.add_words(katz.send_words(docs, 2), 2)
    uni = katz.Unigrams(7, 6, np.array([5, 1, 0, 0, 0, 0]))
    with pytest.raises(Exception, match="another order"):
        katz.send_pairs(katz.send_tokens(other, 2), words.where("chunk >= 0"), uni, 2, 2).count()


def test_katz_hashes_a_chunk_once_for_all_its_buckets(monkeypatch):
    marked = []
    monkeypatch.setattr(katz, "digest", lambda *chunk, of=katz.digest: marked.append(1) or of(*chunk))
    monkeypatch.setattr(katz, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    send = katz.send_words(SimpleNamespace(mapInPandas=lambda f, schema: f), 64)
    docs = pd.DataFrame({"doc_id": range(100), "text": [" ".join(f"w{i * j}" for j in range(50)) for i in range(100)], "held_out": False})
    sent = pd.concat(send(iter([docs])))
    assert sent.bucket.nunique() == 64 and sent.chunk.nunique() == 1 and len(marked) == 1


def test_katz_table_of_pairs_stays_where_it_was_written(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = katz.score_documents(frame(spark, ["a b c", "b c d"]).withColumn("held_out", F.lit(False)))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin [bucket" not in plan and "BroadcastHashJoin [bucket" in plan
    assert spark.conf.get(katz._CLEANUP, None) is None


@pytest.mark.parametrize("kind", ["u1", "u4", "u8", "i8", "f8", "?"])
@pytest.mark.parametrize("values", [[], [0], [1, 0, 255, 3], [1, 2**40, 2**64 - 1, 0]])
def test_katz_packed_arrays_come_back(kind, values):
    want = np.array(values, np.uint64).astype(kind)
    got, again = katz.unpack(katz.pack(want, want[:1]))
    assert got.dtype == want.dtype and got.tobytes() == want.tobytes() and again.tobytes() == want[:1].tobytes()

# 5 ----------------------------------------------------------------------------------------------


def test_sentencepiece_equals_library(spark):
    import sentencepiece

    path = queries.vocabulary(queries.PIECES)
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(frame(spark, TEXTS).selectExpr("doc_id - 1000", "text"))
    want = {}
    for r in docs.collect():
        ids = lib.encode(r.text or "", add_bos=True, add_eos=True)
        want[r.doc_id] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())
        if len(ids) < 300:
            assert sentencepiece_bpe.decode(ids, path) == lib.decode(ids)
    assert {r[0]: tuple(r)[1:] for r in sentencepiece_bpe.encode_documents(docs, path).collect()} == want
    assert sentencepiece_bpe.encode_documents(empty(spark), path).count() == 0


def test_sentencepiece_rows_merge_as_the_agenda_does(monkeypatch):
    model, r = sentencepiece_bpe.model(queries.vocabulary(queries.PIECES)), random.Random(1)
    letters, pieces = "abcdefghijklmnop▁éüñ😀\x00日本\U0010ffff0123ABC'.-", sorted(model.ids)
    cuts = ["".join(r.choice(letters) for _ in range(r.randint(1, 48))) for _ in range(2000)]
    cuts += ["".join(r.choice(pieces) for _ in range(r.randint(1, 5)))[:48] for _ in range(2000)]
    cuts += [c * n for c in ("a", "▁", "\n", "ab") for n in range(1, 25)]
    monkeypatch.setattr(sentencepiece_bpe, "AT_ONCE", 1000)
    assert model.encode_short(cuts) == [model.encode_cut(c) for c in cuts] and model.encode_short([]) == []


# 6 ----------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    said = ["</s>[INST] ok [/INST]", "\\", "\\\\<s>", "", None, "[ROLE]x[/ROLE] y[/TURN]", "a\nb [/INST", " [/INST]", "<\\s>", "x" * 50_000]
    chats = [(c, t, r, said[(c * 3 + t) % len(said)], "extra") for c in range(10) for t, r in enumerate(["system", "user", "assistant", None, "[/ROLE]", "user", "assistant"])]
    chats += [(3, 1, "user", "again", "extra"), (3, 1, "user", "again", "extra"), (None, None, None, None, None)]
    got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(chats, "conv_id long, turn int, role string, text string, formatted string")).collect()}
    for conv in {c[0] for c in chats}:
        source = sorted((c[1] is not None, c[1] or 0, c[2] or "", c[3] or "") for c in chats if c[0] == conv)
        assert [(t.role, t.text) for t in got[conv].turns] == [s[2:] for s in source]
        assert got[conv].loss_text == "".join(s[3] for s in source if s[2] == "assistant")
        spans = [got[conv].formatted[s.start : s.end] for s in got[conv].loss_spans]
        assert [re.sub(r"(?s)\\(.)", r"\1", s) for s in spans] == [s[3] for s in source if s[2] == "assistant"]
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0


def test_chat_escapes_control_strings_wherever_they_stand(spark):
    chats = spark.createDataFrame([(1, 0, "assistant", "[INST]"), (2, 0, "user", "</s>")], "conv_id long, turn int, role string, text string")
    got = {r.conv_id: r.formatted for r in chat.format_chats(chats).collect()}
    assert got == {1: "<s> [\\INST]</s>", 2: "<s>[INST] <\\/s> [/INST]"}


# 7 ----------------------------------------------------------------------------------------------


#: Tables, the least held-out recall and the most false alarms; the larger ones, with more labels to learn from, where they are there.
HELD_OUT = [("/root/testdata/sf0.1", 0.9, 0.05), ("/root/testdata/check_s", 0.97, 0.02)]


def test_toxicity_held_out(spark):
    for d, least, most in HELD_OUT:
        if Path(d).exists():
            docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
            known = docs.join(labels.where("toxic is not null").select("doc_id", "toxic"), "doc_id")
            model = toxicity.fit(docs.where(queries.remainder(5) != 0), labels)
            held = toxicity.score_documents(known.where(queries.remainder(5) == 0), model).toPandas()
            assert held[held.toxic == 1].predicted.mean() >= least and held[held.toxic == 0].predicted.mean() <= most


def test_toxicity_scores_words_as_it_was_trained():
    texts = [[b"one", b"two", "zw\u00f6lf".encode(), b"a"], [b"two"], [b"x" * 300, b"one"] * 9]
    model = toxicity.train(texts, [0, 1, 1])
    bags = toxicity.Bags(texts)
    _, vectors = bags.forward(model["table"])
    margin = (vectors @ model["weights"] + model["bias"]) @ [-1.0, 1.0]
    for d, own in enumerate(toxicity.Scorer(model).scores([b" ".join(t).decode() for t in texts])):
        assert own == pytest.approx(1 / (1 + np.exp(-margin[bags.doc == d].max())), rel=1e-4)


def test_toxicity_awkward_and_misspelt(spark):
    calm = [f"a calm sentence about gardens number {i} and walks" for i in range(60)]
    rude = [f"you stupid horrible idiot number {i} go away" for i in range(60)]
    docs, labels = frame(spark, calm + rude), spark.createDataFrame([(i, 0, int(i >= 60)) for i in range(120)] + [(None, 1, 1), (500, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = [r.predicted for r in toxicity.score_documents(frame(spark, ["such a stupidd horribble idiott", "calm gardens and walks"]), model).orderBy("doc_id").collect()]
    assert got == [1, 0]
    all_rows = toxicity.score_documents(awkward(spark), model)
    assert all_rows.count() == awkward(spark).count() and all_rows.where("score between 0 and 1").count() == all_rows.count()
    assert "vertex" in all_rows.columns and all_rows.columns.count("score") == 1
    none = toxicity.fit(empty(spark), labels)
    assert toxicity.score_documents(empty(spark), none).count() == 0 and 0 < toxicity.Scorer(none).score("x") < 0.5


# 8 ----------------------------------------------------------------------------------------------


def test_decontamination_catches_other_numbers_and_names(spark):
    item = "Each morning the old baker Anna carries 12 kg of flour to the mill and returns with 7 loaves of bread for the town"
    items = spark.createDataFrame([(1, item, "x"), (2, None, "x"), (3, "", "x"), (4, "one two three", "x"), (1, item, "x")], "item_id long, text string, slots string")
    other = item.replace("Anna", "Peter").replace("12", "3.5").replace("7", "90")
    mixed = other.replace("carries 3.5", "carries 90")
    texts = [f"Intro words here. {item} And more.", f"x\n{other}", mixed, item.lower().replace("flour", "sand").replace("loaves", "stones"), f"{item}. {other}", None, "", "word " * 20_000]
    got = {r.doc_id for r in decontamination.find_leaks(frame(spark, texts), items).where("item_id = 1").collect()}
    assert got == {0, 1, 4}
    assert decontamination.find_leaks(frame(spark, texts), items.limit(0)).count() == 0
    assert decontamination.find_leaks(awkward(spark), items).count() == 0 and decontamination.find_leaks(empty(spark), items).count() == 0


def test_decontamination_reads_first_words_in_all_ways(spark):
    said = ["What river flows through the old town of Linz?", "A Boy sells nine red apples at the market", "What is 12 times 7?", "In 1999"]
    items = spark.createDataFrame(list(enumerate(said)), "item_id long, text string")
    leads = ["", "Question: ", "He said, \"", "Question 1: ", "1. ", "1 ", "It ended. "]
    texts = [f"{lead}{t} and so on" for t in said for lead in leads]
    wrong = ["Question: Which river flows through the old town of Linz?", "1. M Boy sells nine red apples at the market", "What is 13 times 7?", "Question: Who is 12 times 7?", "In 1998"]
    got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(frame(spark, texts + wrong), items).collect()}
    assert got == {(k, k // len(leads)) for k in range(len(texts))}


def test_decontamination_of_rows_without_id(spark):
    item = "the boy took 7 apples plus 7 pears home again today"
    same = item.replace("7", "9")
    other = same.replace("9 pears", "8 pears")  # one slot of the item stands for two values
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    for text, found in ((same, 1), (other, 0)):
        for doc_id in (5, None):
            docs = spark.createDataFrame([(doc_id, text)], "doc_id long, text string")
            with_windows = decontamination.find_leaks(docs, bench).collect()
            assert (len(with_windows), {r.doc_id for r in with_windows}) == (found, {doc_id} if found else set())


def test_decontamination_reports_verbatim_windows_beside_others(spark):
    item = "the old baker carries 7 sacks of white flour to the mill by the river and comes home with 7 loaves of fresh bread for all of the town"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    last, first, both = item.replace("7 loaves", "8 loaves"), item.replace("7 sacks", "8 sacks"), item.replace("7 sacks", "9 sacks").replace("7 loaves", "8 loaves")
    got = {r.doc_id: (r.n_windows, r.n_slots) for r in decontamination.find_leaks(frame(spark, [item, last, first, both]), items).collect()}
    starts, (a, b) = range(len(item.split()) - 9), [k for k, w in enumerate(item.split()) if w == "7"]
    without = lambda *at: sum(not any(i <= k < i + 10 for k in at) for i in starts)
    assert got == {0: (len(starts), 1), 1: (without(b), 1), 2: (without(a), 1), 3: (without(a, b), 0)}


def test_decontamination_against_windows(spark):
    con, size = duck("/root/testdata/sf0.01"), 8
    cut = lambda t: {tuple(w[i : i + size]) for w in [re.findall(r"\w+", (t or "").lower())] for i in range(len(w) - size + 1)}
    items = [(i, cut(t)) for i, t in con.sql("select item_id, text from benchmark").fetchall()]
    want = {d for d, t in con.sql("select doc_id, text from documents").fetchall() for w in [cut(t)] for _, v in items if v and v <= w}
    assert want <= {r.doc_id for r in Q["op8_decontamination"](spark, "/root/testdata/sf0.01").collect()}


# 9 ----------------------------------------------------------------------------------------------


def components_brute(docs, size, p, q):
    sets = {}
    for i, t in docs:
        w = tokens(t)
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if q * both >= p * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("size", "p"), [(3, 90), (5, 80)])
def test_jaccard_classes(spark, size, p):
    rng = random.Random(size)
    texts = [t for (t,) in duck().sql("select text from documents order by doc_id").fetchall()]
    base = [" ".join(str(rng.randrange(900)) for _ in range(rng.choice([4, 12, 40, 150]))) for _ in range(15)]
    for t in base:
        texts.append(t)
        for _ in range(6):  # chains of small edits, many of them at the threshold
            w = texts[-1].split()
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = str(rng.randrange(900))
            texts.append(" ".join(w))
    texts += [None, "", "a", "A", "a b", "a b"]
    docs = frame(spark, texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similarity_classes(docs, size, p, 100).collect()}
    assert got == components_brute([(r[0], r[1]) for r in rows(texts)], size, p, 100)


def near_copies(rng, n, base_words, edits):
    base = [str(rng.randrange(10**6)) for _ in range(base_words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(edits):
            w[rng.randrange(len(w))] = str(rng.randrange(10**6))
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("few", "run"), [(0, 10**6), (500_000, 6)])
def test_jaccard_blocks(spark, monkeypatch, few, run):
    """Groups and buckets in many blocks, sets that are shuffled to, runs too long to hold, and a passage that unlike texts share."""
    monkeypatch.setattr(jaccard_join, "LONG_RUN", run)
    monkeypatch.setattr(jaccard_join, "SEEN", run)
    monkeypatch.setattr(jaccard_join, "BLOCK", 7)
    monkeypatch.setattr(jaccard_join, "SETS", 6)
    monkeypatch.setattr(jaccard_join, "PACK", 5)
    monkeypatch.setattr(jaccard_join, "FEW", few)
    rng = random.Random(few)
    texts = [t for e in (2, 3, 4) for t in near_copies(rng, 30, 60, e)]
    shared = " ".join(str(k) for k in range(60))
    texts += [f"{shared} {' '.join(str(rng.randrange(10**6)) for _ in range(rng.choice([8, 15, 40])))}" for _ in range(40)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similarity_classes(frame(spark, texts), 5, 80, 100).collect()}
    assert got == components_brute([(r[0], r[1]) for r in rows(texts)], 5, 80, 100)


def test_jaccard_large_group_stays_linear(spark, monkeypatch):
    """5,000 near copies: no step returns more than a few rows for each."""
    seen, write = {}, jaccard_join.staged

    def counted(df, label):
        done = write(df, label)
        seen[label] = max(seen.get(label, 0), done.count())
        return done

    monkeypatch.setattr(jaccard_join, "staged", counted)
    texts = near_copies(random.Random(1), 5000, 80, 1)
    got = jaccard_join.similarity_classes(frame(spark, texts), 5, 80, 100)
    assert got.select("component_id").distinct().count() == 1
    assert seen["stars"] < 30 * len(texts) and seen["links"] < 30 * len(texts) and seen["groups"] <= len(texts), seen


def test_jaccard_names_sets_anew_where_two_share_a_name(spark, monkeypatch):
    real = jaccard_join.summarise
    monkeypatch.setattr(jaccard_join, "summarise", lambda d, size, p, q, seed=0: real(d, size, p, q, seed) if seed else real(d, size, p, q).withColumn("vertex", F.expr("case when vertex is not null then 1L end")))
    seed, summary = jaccard_join.named_sets(frame(spark, ["a b c", "d e f"]), 2, 80, 100)
    assert seed == 1 and summary.select("vertex").distinct().count() == 2


def test_jaccard_awkward(spark):
    got = jaccard_join.similarity_classes(awkward(spark)).collect()
    assert len(got) == awkward(spark).count()
    assert all(r.component_id is None for r in got if r.doc_id is None)
    assert {r.component_id for r in got if r.doc_id in (5, 6)} == {5}
    assert jaccard_join.similarity_classes(empty(spark)).count() == 0


def test_jaccard_links_all_texts_of_an_id(spark):
    texts = [" ".join(f"{name}{k}" for k in range(20)) for name in "abcde"]
    docs = frame(spark, texts).select("doc_id", "text").union(spark.createDataFrame([(9, t) for t in texts], "doc_id long, text string"))
    assert {r.component_id for r in jaccard_join.similarity_classes(docs).collect()} == {0}


# 10 ---------------------------------------------------------------------------------------------


def lines_brute(docs, min_docs, min_chars):
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    found = {}
    for i, t in docs:
        for line in (t or "").split("\n"):
            found.setdefault(key(line), set()).add(i)
    gone = {k for k, ids in found.items() if len(k) >= min_chars and len(ids) >= min_docs}
    return sorted((i, len((t or "").split("\n")), "\n".join(s for s in (t or "").split("\n") if key(s) not in gone)) for i, t in docs)


def test_lines(spark):
    texts = [f"Shared LINE \r\nown {i}\n\n  shared line\n{'twice' if i < 2 else i}" for i in range(12)] + [None, "", "\n", "shared line", "x\n" * 30_000]
    docs = frame(spark, texts)
    for least in (1, 2, 3):
        done = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs, least, 1))
        assert sorted((r.doc_id, r.n_lines, r.kept_text) for r in done.collect()) == lines_brute([(r[0], r[1]) for r in rows(texts)], least, 1)
    first = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs, 2, 1, keep_first=True)).orderBy("doc_id").collect()
    assert first[0].kept_text.startswith("Shared LINE \r\nown 0\n\ntwice") and first[1].kept_text == "own 1\n"


def test_lines_awkward(spark):
    docs = awkward(spark).withColumn("kept_text", F.lit(1)).withColumn("_lines", F.lit(2)).withColumn("mark", F.lit(3))
    done = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs, 2))
    assert done.count() == docs.count() and done.where("_lines = 2 and mark = 3 and kept_text is not null").count() == docs.count()
    assert line_dedup.apply_bitmaps(empty(spark), line_dedup.keep_bitmaps(empty(spark))).count() == 0
