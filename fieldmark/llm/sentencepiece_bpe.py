"""Operator 5, SentencePiece encoding and decoding for merge-type vocabularies.

Encoding keeps an agenda (a heap) of adjacent symbol pairs whose join is a
piece, ordered by score and then by place, and merges the best pair until none
is left; short texts, many at a time, are the rows of arrays, where every round
merges the best pair of each row: the same merges.  Symbols that are no piece fall
back to bytes.  No piece of such a vocabulary crosses the start of a word or a line
feed (checked when the model is read), so a text is cut there and each cut is
encoded once per worker and kept in a bounded cache.  Every cut that enters the cache is checked against the
sentencepiece library, an Arrow batch at a time; a difference fails the task.
Decoding starts from the ids of the whole document.

Defined results: a null text is empty (begin and end id only); repeated rows are
encoded each; extra columns are ignored; texts of any length are encoded whole.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import itertools
import re
import struct
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import frugal, keeps

SPACE = "▁"
#: Cuts kept by a worker in each of two generations; a full younger one becomes the older.
CACHE_SIZE = 250_000
#: Characters of a cut that is merged in rows, at most; rows at once.
SHORT, AT_ONCE = 48, 8192
#: Numbers for what stands behind the end of a row and for characters in no piece (the table of symbols ends with both), and the rank of a pair that is no piece.
PADDING, UNKNOWN, NO_PAIR = -1, -2, 1 << 30
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class BpeModel:
    """Pieces and scores of a model file, an encoder of one cut and its cache."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        size = lib.get_piece_size()
        kinds = {i: lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i) for i in range(size)}
        self.ids = {lib.id_to_piece(i): i for i in range(size) if not kinds[i]}
        self.scores = {p: lib.get_score(i) for p, i in self.ids.items()}
        self.bytes = {b: lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
        self.byte_ids = set(self.bytes.values())
        self.begin, self.end = lib.bos_id(), lib.eos_id()
        self.spelt = [b""] * size  # by id
        for p, i in self.ids.items():
            self.spelt[i] = p.replace(SPACE, " ").encode()
        for b, i in self.bytes.items():
            self.spelt[i] = bytes([b])
        if any(SPACE in p.lstrip(SPACE) for p in self.ids) or any("\n" in p for p in self.ids):
            raise ValueError("a piece crosses the start of a word or a line feed")
        self.cuts = re.compile(rf"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")
        self._number_symbols()
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _number_symbols(self) -> None:
        """Pieces and their characters as numbers, and the pairs of symbols that join to a piece, as arrays."""
        symbols = sorted(set(self.ids).union(*self.ids))
        number = {p: i for i, p in enumerate(symbols)}
        self.piece = np.array([self.ids.get(p, -1) for p in symbols] + [-1, -1], np.int64)
        single = [p for p in symbols if len(p) == 1]
        self.characters = np.full(max(map(ord, single)) + 2, UNKNOWN, np.int32)  # the last one stands for all beyond
        self.characters[[ord(p) for p in single]] = [number[p] for p in single]
        ranks = {s: i for i, s in enumerate(sorted(set(self.scores.values()), reverse=True))}
        pairs = sorted(
            (number[p[:k]] * len(self.piece) + number[p[k:]], ranks[self.scores[p]], number[p])
            for p in self.ids for k in range(1, len(p)) if p[:k] in number and p[k:] in number
        )
        self.pair_keys = np.array([p[0] for p in pairs] or [-1], np.int64)
        self.pair_ranks, self.pair_joins = (np.array([p[i] for p in pairs] or [0], np.int32) for i in (1, 2))

    def encode_cut(self, text: str) -> list[int]:
        """Ids of a cut: the agenda of pairs, best score first, leftmost among equals."""
        ids, scores = self.ids, self.scores
        if (whole := ids.get(text)) is not None and len(text) <= 2:
            return [whole]
        parts: list[str] = list(text)
        last = len(parts)
        pairs = map(str.__add__, parts, parts[1:])
        agenda = [(-s, i, p) for i, p in enumerate(pairs) if (s := scores.get(p)) is not None]
        heapq.heapify(agenda)
        after, before = list(range(1, last + 1)), list(range(-1, last - 1))
        pop, push = heapq.heappop, heapq.heappush
        while agenda:
            _, i, joined = pop(agenda)
            left, j = parts[i], after[i]
            if not left or j >= last or left + parts[j] != joined:
                continue  # one of the two has been merged since
            parts[i], parts[j] = joined, ""
            after[i] = k = after[j]
            if k < last:
                before[k] = i
                if (s := scores.get(p := joined + parts[k])) is not None:
                    push(agenda, (-s, i, p))
            if (h := before[i]) >= 0 and (s := scores.get(p := parts[h] + joined)) is not None:
                push(agenda, (-s, h, p))
        return self.spell(filter(None, parts))

    def encode_short(self, cuts: list[str]) -> list[list[int]]:
        """Ids of cuts of at most ``SHORT`` characters: a row each, in which every round merges the best pair, leftmost among equals."""
        out: list[list[int]] = [[]] * len(cuts)
        order = sorted(range(len(cuts)), key=lambda i: len(cuts[i]))
        for s in range(0, len(order), AT_ONCE):
            for i, ids in self._rounds(order[s : s + AT_ONCE], cuts):
                out[i] = ids
        return out

    def _rounds(self, rows: list[int], cuts: list[str]) -> Iterator[tuple[int, list[int]]]:
        texts = [cuts[i] for i in rows]
        width = len(texts[-1])
        points = np.frombuffer("".join(t.ljust(width, "\n") for t in texts).encode("utf-32-le"), np.uint32).reshape(-1, width)
        known = self.characters[np.minimum(points, len(self.characters) - 1)]
        symbols = np.where(np.arange(width) < np.array([len(t) for t in texts])[:, None], known, PADDING)
        starts = np.broadcast_to(np.arange(width), symbols.shape)
        rows, ranks = np.array(rows), self.pair(symbols[:, :-1], symbols[:, 1:])[0]
        while len(rows):
            at = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(rows), int)
            more = ranks[np.arange(len(rows)), at] < NO_PAIR if ranks.shape[1] else np.zeros(len(rows), bool)
            yield from self._spelt_rows(rows[~more], symbols[~more], starts[~more], cuts)
            rows, symbols, starts, ranks, at = rows[more], symbols[more], starts[more], ranks[more], at[more]
            if not len(rows):
                break
            n = np.arange(len(rows))
            symbols[n, at] = self.pair(symbols[n, at], symbols[n, at + 1])[1]
            others = np.arange(symbols.shape[1]) != at[:, None] + 1
            symbols, starts = symbols[others].reshape(len(n), -1), starts[others].reshape(len(n), -1)
            ranks = ranks[others[:, 1:]].reshape(len(n), -1)
            right, left = np.flatnonzero(at < ranks.shape[1]), np.flatnonzero(at > 0)
            ranks[right, at[right]] = self.pair(symbols[right, at[right]], symbols[right, at[right] + 1])[0]
            ranks[left, at[left] - 1] = self.pair(symbols[left, at[left] - 1], symbols[left, at[left]])[0]

    def _spelt_rows(self, rows, symbols, starts, cuts: list[str]) -> Iterator[tuple[int, list[int]]]:
        filled = symbols != PADDING
        ids, sizes = self.piece[symbols], filled.sum(1)
        odd = (filled & (ids < 0)).any(1)
        for i, own, n, rare, first in zip(rows.tolist(), ids.tolist(), sizes.tolist(), odd.tolist(), starts, strict=True):
            if rare:
                ends = [*first[1:n].tolist(), len(cuts[i])]
                own, n = self.spell(cuts[i][a:b] for a, b in zip(first[:n].tolist(), ends, strict=True)), None
            yield i, own[:n]

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (by score, the best is 0) and symbol of the joins of symbols; ``NO_PAIR`` where it is no piece."""
        keys = left.astype(np.int64) * len(self.piece) + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        hit = (self.pair_keys[at] == keys) & (left >= 0) & (right >= 0)
        return np.where(hit, self.pair_ranks[at], NO_PAIR), np.where(hit, self.pair_joins[at], UNKNOWN)

    def spell(self, parts: Iterable[str]) -> list[int]:
        """Ids of the parts that are left; those that are no piece in bytes."""
        ids, out = self.ids, []
        for p in parts:
            known = ids.get(p)
            if known is not None:
                out.append(known)
            else:
                out.extend([self.bytes[b] for b in p.encode()])
        return out

    def check(self, cuts: list[str], ids: list[list[int]]) -> None:
        """Compares cuts with the library, encoded and decoded; one that starts no word, or is but a space, is put behind a line feed."""
        lead = self.library.encode("\n")
        starts = [c[0] == SPACE and c != SPACE for c in cuts]
        given = [c[1:].replace(SPACE, " ") if s else "\n" + c.replace(SPACE, " ") for c, s in zip(cuts, starts, strict=True)]
        theirs = self.library.encode(given, num_threads=1)
        back = self.library.decode(theirs, num_threads=1)
        for cut, start, own, other, text, again in zip(cuts, starts, ids, theirs, given, back, strict=True):
            if other != (own if start else lead + own) or again != text:
                raise ValueError(f"the agenda and the library differ on {cut[:80]!r}")

    def learn(self, cuts: set[str]) -> None:
        """Puts cuts into the cache: from the older generation, or encoded and checked."""
        older = self.older
        if len(self.cache) + len(cuts) > CACHE_SIZE:
            self.older, self.cache = self.cache, {}
        new = []
        for c in cuts:
            known = older.get(c)
            if known is None:
                new.append(c)
            else:
                self.cache[c] = known
        new.sort(key=len)
        short = bisect.bisect_right(new, SHORT, key=len)
        ids = self.encode_short(new[:short]) + [self.encode_cut(c) for c in new[short:]]
        self.check(new, ids)
        for c, own in zip(new, ids, strict=True):
            self.cache[c] = struct.pack(f"<{len(own)}I", *own)

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Per text: its ids as little-endian 32-bit integers, with begin and end id."""
        first, last = struct.pack("<I", self.begin), struct.pack("<I", self.end)
        cut = [self.cuts.findall(SPACE + text.replace(" ", SPACE)) if text else [] for text in texts]
        known = self.cache
        self.learn(set(itertools.chain.from_iterable(cut)).difference(known))
        young, old = self.cache, self.older
        get = young.__getitem__ if young is known else lambda c: young.get(c) or old[c]  # a new generation has begun
        return [b"".join([first, *map(get, cuts), last]) for cuts in cut]

    def decode(self, ids: Iterable[int]) -> bytes:
        """Text of ids in UTF-8: pieces joined, word marks to spaces, byte pieces as they are; controls vanish, and so does one space at the start.

        Byte pieces that are no UTF-8 become replacement characters, run by run.
        """
        ids = list(ids)
        text = b"".join(map(self.spelt.__getitem__, ids))
        try:
            text.decode()
        except UnicodeDecodeError:
            runs, values = itertools.groupby(ids, lambda i: i in self.byte_ids), self.spelt.__getitem__
            text = b"".join(b"".join(map(values, run)).decode("utf-8", "replace").encode() if raw else b"".join(map(values, run)) for raw, run in runs)
        shown = next((i for i in ids if self.spelt[i]), None)
        return text[1:] if shown not in self.byte_ids and text.startswith(b" ") else text


@lru_cache(maxsize=2)
def model(path: str) -> BpeModel:
    return BpeModel(path)


keeps("sentencepiece", model.cache_clear)


def decode(ids: list[int], path: str) -> str:
    return model(path).decode(ids).decode()


def encode_documents(docs: DataFrame, model_path: str, max_rows: int = 1024) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, max_rows):
                part = batch.slice(at, max_rows)
                coded = [(len(i) // 4, hashlib.sha256(i).hexdigest(), hashlib.sha256(bpe.decode(array("I", i))).hexdigest()) for i in bpe.encode_batch(part.column("text").to_pylist())]
                n, ids, decoded = zip(*coded, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(frugal(encode, "sentencepiece"), SCHEMA)
