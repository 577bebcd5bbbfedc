"""The registered queries of the operators, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontamination, jaccard_join, katz, line_dedup, quality, ranked_search, sentencepiece_bpe, sharding, token_counts, toxicity, vector_codes
from .common import staged, table

#: Where the public vocabulary files are; a parameter of the operators.
BPE_RANKS, PIECES = "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def remainder(n: int) -> Column:
    """crc32 of the id as text (a null id as an empty text), modulo n."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.tokens_per_document(spark, table(spark, sf_dir, "documents"), vocabulary(BPE_RANKS), token_pattern())


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), 8)[0]


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 100 = 0"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", remainder(7) == 2)
    return katz.score_documents(docs)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary(PIECES))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    chats = chat.format_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP6_SQL = r"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
    SELECT *, length(regexp_replace(regexp_replace(replace(text, '\', '\\'), '<(/?s>)', '<\\\1', 'g'), '\[(/?INST\]|/?ROLE\]|/TURN\])', '[\\\1', 'g')) AS n,
        length(regexp_replace(regexp_replace(replace(role, '\', '\\'), '<(/?s>)', '<\\\1', 'g'), '\[(/?INST\]|/?ROLE\]|/TURN\])', '[\\\1', 'g')) AS r
    FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    cast(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    cast(3 + sum(n + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 5 ELSE r + 21 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs.where(remainder(5) != 0), table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model).select("doc_id", (remainder(5) == 0).alias("held_out"), "score", "predicted")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similarity_classes(table(spark, sf_dir, "documents"), 3, 90, 100)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs, 10, 1))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH l AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), k AS (
    SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key FROM l
), f AS (
    SELECT line_key FROM k WHERE length(line_key) >= 1 GROUP BY line_key HAVING count(DISTINCT doc_id) >= 10
), j AS (
    SELECT k.*, f.line_key IS NOT NULL AS gone FROM k LEFT JOIN f USING (line_key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = staged(quality.with_statistics(table(spark, sf_dir, "documents").select("doc_id", "text")), "statistics")
    model = quality.fit(measured.where(remainder(4) != 2), table(spark, sf_dir, "labels"))
    return quality.score_documents(measured, model).select("doc_id", (remainder(4) == 2).alias("held_out"), "score", "predicted")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def _op12_sql() -> str:
    way = "list_sum(list_transform(range(1, len(x.xs) + 1), lambda i: (x.xs[i] - c.xs[i]) * (x.xs[i] - c.xs[i])))"
    steps = []
    for k in range(vector_codes.ROUNDS + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT x.r, x.p, min({way} * 64 + c.e) AS least FROM parts x JOIN c{k} c USING (p) GROUP BY x.r, x.p)")
        if k < vector_codes.ROUNDS:
            steps.append(f"""s{k} AS MATERIALIZED (SELECT p, e, i, sum(v)::BIGINT AS t, count(*) AS n
                FROM (SELECT x.p, a.least % 64 AS e, unnest(x.xs) AS v, generate_subscripts(x.xs, 1) AS i FROM parts x JOIN a{k} a USING (r, p)) GROUP BY p, e, i)""")
            steps.append(f"""c{k + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.xs, c.xs) AS xs FROM c{k} c
                LEFT JOIN (SELECT p, e, list((t - ((t % n) + n) % n) // n ORDER BY i) AS xs FROM s{k} GROUP BY p, e) m USING (p, e))""")
    last = vector_codes.ROUNDS
    return f"""
WITH v AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, ints) - 1 AS r, vec_id, label, ints FROM (
        SELECT vec_id, label, list_transform(embedding, lambda x: cast(floor(256 * x::DOUBLE) AS BIGINT)) AS ints FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
), parts AS MATERIALIZED (
    SELECT r, p.p, ints[p.p * (len(ints) // 16) + 1 : (p.p + 1) * (len(ints) // 16)] AS xs FROM v, range(16) p(p)
), c0 AS MATERIALIZED (SELECT p, r AS e, xs FROM parts WHERE r < 64), {", ".join(steps)}, coded AS (
    SELECT r, string_agg(printf('%02x', least % 64), '' ORDER BY p) AS code, sum(least // 64)::BIGINT AS error FROM a{last} GROUP BY r
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
    (SELECT sha256(string_agg(array_to_string(xs, ','), ',' ORDER BY p, e)) FROM c{last}) AS codebooks_sha256
FROM v JOIN coded USING (r)
"""


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(ranked_search.build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), 20)


OP13_SQL = r"""
WITH t AS (
    SELECT row_number() OVER () AS d, doc_id,
        regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
    FROM documents WHERE text IS NOT NULL
), g AS (
    SELECT count(*) AS docs, sum(len(ts))::BIGINT AS total FROM t WHERE len(ts) > 0
), p AS (
    SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(ts) AS term FROM t) GROUP BY d, term
), w AS (
    SELECT term, cast(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, g GROUP BY term, docs
), q AS (
    SELECT item_id, term, count(*) AS times FROM (
        SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM (SELECT item_id, min(text) AS text FROM benchmark GROUP BY item_id)) GROUP BY item_id, term
), s AS (
    SELECT item_id, d, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(ts) * docs) // total))))::BIGINT AS score
    FROM q JOIN w USING (term) JOIN p USING (term) JOIN t USING (d), g GROUP BY item_id, d, doc_id
), r AS (
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0
)
SELECT * FROM r WHERE rank <= 20
"""


def queries() -> dict:
    found = [
        op1_token_counts, op2_sharding, op3_ann, op4_lm_scoring, op5_sentencepiece, op6_chat_formatting,
        op7_toxicity, op8_decontamination, op9_jaccard_join, op10_line_dedup, op11_quality, op12_vector_codes,
        op13_ranked_search,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op6_chat_formatting": OP6_SQL, "op10_line_dedup": OP10_SQL, "op12_vector_codes": _op12_sql(), "op13_ranked_search": OP13_SQL}
