"""Operator 1, token counts by a separator scan over flat token files.

A flat token file is nothing but 16-bit token ids, an end-of-document id after
each document; it has no index.  ``count_documents`` cuts files into blocks,
searches each block for the separator with numpy, and stitches documents that
cross blocks with a two-level prefix scan over the blocks' totals (blocks within
a span, then spans within a file), so that one huge file needs no single task.
``write_token_files`` makes such files from documents, in the order of the rows.

Defined results: a null or empty text has no tokens and is a document of length
0; a separator that is missing at a file's end still ends the last document;
repeated rows are documents of their own; empty files and tables give no rows;
extra columns are ignored.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch_dir, staged

BLOCK_TOKENS, SPAN_BLOCKS = 1 << 20, 1024
#: Ids of documents in a row of the manifest; the largest id that 16 bits hold.
IDS, LARGEST = 50_000, (1 << 16) - 1
FILES = "path string, n_tokens long, first long, doc_ids array<long>"
BLOCKS = "path string, block long, n_tokens long, n_ends long, tail long, lengths array<long>"


@lru_cache(maxsize=2)
def encoder(ranks_path: str, pattern: str):
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def separator_of(ranks_path: str, pattern: str) -> int:
    """The id behind the vocabulary's last one, which no text gives; it must fit into 16 bits."""
    separator = encoder(ranks_path, pattern).max_token_value + 1
    if separator > LARGEST:
        raise ValueError(f"a vocabulary of {separator} ids does not fit into 16 bits")
    return separator


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of the file system on which Spark finds it, as the tasks' own reads and writes need it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return re.sub("^file:/+", "file:///", at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString())


def open_fs(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a URI, or of a plain path."""
    return pa.fs.FileSystem.from_uri(path if re.match(r"\w+:", path) else f"file://{path}")


def write_token_files(docs: DataFrame, folder: str, ranks_path: str, pattern: str) -> DataFrame:
    """Writes a flat file per input partition and returns a manifest: a row with each file's path and n_tokens, and
    rows with path, first and doc_ids, the ids of its documents from that place on, some at a time.

    Documents end with ``separator_of`` the vocabulary.  An attempt writes to a name of its own and the manifest lists only what a
    successful attempt returned, so a lost or repeated task leaves no duplicates.
    """

    folder, separator = qualified(docs.sparkSession, folder), separator_of(ranks_path, pattern)

    def row(path: str, n_tokens: int | None, first: int | None, ids: list[int | None] | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n_tokens], pa.int64()), pa.array([first], pa.int64()), pa.array([ids], pa.list_(pa.int64()))], ["path", "n_tokens", "first", "doc_ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(ranks_path, pattern).encode_ordinary
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.bin"
        n, first, ids = 0, 0, []
        with fs.open_output_stream(f"{base}/{name}") as out:
            for batch in batches:
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                    tokens = np.array([*code(text.as_py() or ""), separator], "<u2")
                    out.write(tokens.tobytes())
                    n += len(tokens)
                    ids.append(doc_id)
                    if len(ids) == IDS:
                        yield row(f"{folder}/{name}", None, first, ids)
                        first, ids = first + IDS, []
        if ids:
            yield row(f"{folder}/{name}", None, first, ids)
        if n:
            yield row(f"{folder}/{name}", n, None, None)

    return staged(docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(write, FILES), "token-files")


def scan_blocks(files: DataFrame, separator: int, block_tokens: int) -> DataFrame:
    """One row per block: its tokens, its separators, what follows the last one, and the lengths that end in it."""
    cut = files.select("path", "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n_tokens - 1) div {block_tokens}"))).alias("block")).where("n_tokens > 0")
    dealt = cut.select("path", "block", F.least(F.col("n_tokens") - F.col("block") * block_tokens, F.lit(block_tokens)).alias("n")).repartition("path", "block")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, block, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                fs, name = open_fs(path)
                with fs.open_input_file(name) as f:
                    tokens = np.frombuffer(f.read_at(2 * n, 2 * block * block_tokens), "<u2")
                ends = np.flatnonzero(tokens == separator)
                lengths = np.diff(ends, prepend=-1) - 1
                tail = n - 1 - int(ends[-1]) if len(ends) else n
                row = [[path], [block], [n], [len(ends)], [tail], [lengths.tolist()]]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, [pa.string(), *[pa.int64()] * 4, pa.list_(pa.int64())], strict=True)], ["path", "block", "n_tokens", "n_ends", "tail", "lengths"])

    return dealt.mapInArrow(scan, BLOCKS)


def count_documents(files: DataFrame, separator: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """path, place (from 0) and n_tokens of every document in the files (path, n_tokens)."""
    blocks = staged(scan_blocks(files.select("path", "n_tokens"), separator, block_tokens), "token-blocks").withColumn("span", F.expr(f"block div {SPAN_BLOCKS}"))
    # What a run of blocks passes on: documents ended, and the tokens open at its end.  A run
    # without a separator adds to the open tokens; the last separator's place decides otherwise.
    at = F.struct("block", "tail")
    inside = Window.partitionBy("path", "span").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    has_end = F.col("n_ends") > 0
    totals = blocks.select("path", "span", "block", "n_tokens", "n_ends", "tail")
    spans = totals.groupBy("path", "span").agg(
        F.sum("n_ends").alias("span_ends"), F.sum("n_tokens").alias("span_tokens"), F.max(F.when(has_end, at)).alias("last"), F.max("block").alias("last_block")
    )
    after = totals.join(spans.select("path", "span", F.col("last.block").alias("last_at")), ["path", "span"]).where("block > last_at").groupBy("path", "span").agg(F.sum("n_tokens").alias("after"))
    spans = spans.join(after, ["path", "span"], "left").select("path", "span", "span_ends", "span_tokens", "last_block", F.when(F.col("last").isNotNull(), F.col("last.tail") + F.coalesce("after", F.lit(0))).alias("span_open"))
    before = Window.partitionBy("path").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    running = F.coalesce(F.sum("span_tokens").over(before), F.lit(0))
    spans = spans.withColumn("running", running).withColumn("base", F.coalesce(F.sum("span_ends").over(before), F.lit(0)))
    # Tokens before this span, less those before the last span that has a separator, plus what that one left open.
    anchor = F.last(F.when(F.col("span_open").isNotNull(), F.col("span_open") - F.col("running") - F.col("span_tokens")), True).over(before)
    spans = spans.select("path", "span", "base", "last_block", (F.col("running") + F.coalesce(anchor, F.lit(0))).alias("carry"))
    run = F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    scanned = totals.withColumn("run", run).withColumn("ended", F.coalesce(F.sum("n_ends").over(inside), F.lit(0)))
    own = F.last(F.when(has_end, F.col("tail") - F.col("run") - F.col("n_tokens")), True).over(inside)
    scanned = scanned.select("path", "span", "block", "run", "ended", own.alias("own"))
    files_end = files.groupBy("path").agg(F.expr(f"(max(n_tokens) - 1) div {block_tokens}").alias("final"))
    joined = blocks.join(scanned, ["path", "span", "block"]).join(spans, ["path", "span"]).join(files_end, "path")
    open_before = F.col("run") + F.when(F.col("own").isNotNull(), F.col("own")).otherwise(F.col("carry"))
    open_end = F.when(has_end, F.col("tail")).otherwise(F.col("open") + F.col("n_tokens"))
    unended = F.when((F.col("block") == F.col("final")) & (open_end > 0), F.array(F.struct((F.col("first") + F.col("n_ends")).alias("place"), open_end.alias("n_tokens"))))
    ended = F.transform("lengths", lambda n, i: F.struct((F.col("first") + i).alias("place"), (n + F.when(i == 0, F.col("open")).otherwise(F.lit(0))).alias("n_tokens")))
    return (
        joined.withColumn("open", open_before).withColumn("first", F.col("base") + F.col("ended")).select("path", F.inline(F.when(unended.isNull(), ended).otherwise(F.concat(ended, unended))))
    )


def tokens_per_document(spark: SparkSession, docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens: writes the documents as flat files, scans these, and puts the ids back by place."""
    files = write_token_files(docs, scratch_dir(spark, "tokens"), ranks_path, pattern)
    ids = files.where("doc_ids is not null").select("path", "first", F.posexplode("doc_ids").alias("i", "doc_id")).select("path", (F.col("first") + F.col("i")).alias("place"), "doc_id")
    counts = count_documents(files.where("n_tokens is not null"), separator_of(ranks_path, pattern))
    return ids.join(counts, (ids["path"] == counts["path"]) & (ids["place"] == counts["place"])).select("doc_id", "n_tokens")
