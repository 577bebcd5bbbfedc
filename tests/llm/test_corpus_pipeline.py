"""The pipeline's stages, each against its operator's brute force, and on awkward documents."""

import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from llm_fixtures import awkward, duck, empty, frame  # noqa: E402

import corpus_pipeline as c  # noqa: E402

SF = "/root/testdata/sf0.01"  # large enough to learn toxicity from


def test_stages_on_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toxic = {i for (i,) in duck(SF).sql("select doc_id from labels where toxic = 1").fetchall()}
    before = {r.doc_id: r.text for r in docs.collect()}
    for (name, stage), k in zip(c.STAGES[:-1], range(4), strict=True):
        docs = c.staged(stage(spark, docs, SF), f"test-{k}")
        assert docs.columns == c.COLUMNS, name
        after = {r.doc_id: r.text for r in docs.collect()}
        assert set(after) <= set(before)
        if name == "toxicity":
            assert len(set(after) & toxic) <= 0.1 * len(toxic)
            assert len(after) >= 0.8 * (len(before) - len(toxic & set(before)))
        if name == "n-gram Jaccard join":
            shingles = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) for t in after.values())]
            assert not any(a and b and 100 * min(len(a), len(b)) >= 80 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b) for i, a in enumerate(shingles) for b in shingles[i + 1 :])
        if name == "benchmark decontamination":
            items = [t for (t,) in duck(SF).sql("select text from benchmark where length(text) > 80").fetchall()]
            assert not any(t in (x or "") for t in items for x in after.values())
        before = after
    assert c.encoded(spark, docs, SF).count() == len(before)


def test_awkward_and_empty(spark):
    for make in (awkward, empty):
        docs = make(spark)
        for k, (_, stage) in enumerate(c.STAGES):
            docs = c.staged(stage(spark, docs, SF), f"test-{k}")
        assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        assert (docs.count() > 0) == (make is awkward)


def test_line_stage_leaves_no_stubs_of_copies(spark):
    copy = "Yes.\n \t\nA line that all the copies share, long enough for any bound.\n\nEnd."
    texts = [copy] * 12 + [f"{copy}\nown {i}" for i in range(2)] + ["", " \n", None]
    got = {r.doc_id: (r.text, r.n_chars) for r in c.without_repeated_lines(spark, frame(spark, texts), SF).collect()}
    own = {12 + i: f" \t\n\nown {i}" for i in range(2)}
    assert got == {i: (t, len(t or "")) for i, t in ({0: copy} | own | {14: "", 15: " \n", 16: None}).items()}


def test_join_stage_keeps_one_row_of_each_group_whatever_the_ids(spark):
    copy = " ".join(f"w{i}" for i in range(40))
    near, other = f"{copy} more", " ".join(f"v{i}" for i in range(40))
    texts = [(1, copy), (1, copy), (2, near), (None, copy), (None, copy), (3, other), (3, other), (4, ""), (5, None), (1, "short")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    got = [r.text for r in c.without_near_copies(spark, docs, SF).collect()]
    assert len(got) == 5 and sorted(t or "" for t in got)[:3] == ["", "", "short"]
    assert len([t for t in got if t in (copy, near)]) == 1 and got.count(other) == 1


def test_run_leaves_only_its_result(spark, tmp_path, monkeypatch):
    from fieldmark import scratch

    monkeypatch.setattr(scratch, "_own", {spark.sparkContext.applicationId: str(tmp_path)})
    got = c.run(spark, SF)
    assert got.count() > 0 and got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    if not spark.conf.get("spark.checkpoint.dir", None):
        assert [p.name.rpartition("-")[0] for p in tmp_path.iterdir()] == ["stage-SentencePiece-encoding"]


def test_benchmark_stage_takes_each_row_by_its_text(spark):
    ((item,),) = duck(SF).sql("select text from benchmark where length(text) > 80 order by item_id limit 1").fetchall()
    texts = [(None, f"So: {item}"), (None, "clean"), (7, item), (7, "also clean"), (8, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    got = {(r.doc_id, r.text) for r in c.without_benchmark(spark, docs, SF).collect()}
    assert got == {(None, "clean"), (7, "also clean"), (8, None)}
