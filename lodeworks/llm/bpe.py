"""Byte-level BPE encoding and decoding through a minimal acyclic transducer lexicon.

The words of the whole corpus are counted; the frequent ones are compiled with their token ids into a shared-suffix
automaton (``lexicon.py``) that Spark delivers to the executors, where it is memory-mapped. A document is cut into
words, its distinct words walk through the automaton, and words that the automaton lacks are merged exactly by rank.

Defined cases: a null text counts as empty (no tokens, digests of the empty string); ids are those of the tokenizers
library without added special tokens, so the special token's own string in a text becomes the special id; null and
repeated ``doc_id`` values pass through, a row in is a row out; an empty table gives an empty result; texts of any
length are taken whole; only ``doc_id`` and ``text`` are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.llm import common
from lodeworks.llm.lexicon import Lexicon, build
from lodeworks.llm.merging import MergeTable, merge_words

#: The word pattern of this kind of vocabulary, and the same for texts below U+0250.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBERS = "0-9²³¹¼-¾"
#: Unicode white space below U+0250; Python's \s also has U+001C to U+001F.
_BLANKS = "\t-\r \u0085\u00a0"
_LATIN = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_BLANKS}{_LETTERS}{_NUMBERS}]+|[{_BLANKS}]+(?![^{_BLANKS}])|[{_BLANKS}]+"

_full = regex.compile(PATTERN).findall
_latin = re.compile(_LATIN).findall
_beyond = re.compile("[^\x00-ɏ]").search


def split_words(text: str) -> list[str]:
    return _full(text) if _beyond(text) else _latin(text)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = dict.fromkeys(plain)
    extra = iter(range(256, 512))
    return [chr(b if b in letters else next(extra)) for b in range(256)]


class Vocabulary:
    """Merge table and token bytes of a vocabulary file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            doc = json.load(f)
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        ids = doc["model"]["vocab"]
        self.single = [ids[c] for c in byte_letters()]
        self.special = {t["content"]: t["id"] for t in doc["added_tokens"]}
        self.tokens: list[bytes] = [b""] * (1 + max([*ids.values(), *self.special.values()]))
        for token, i in ids.items():
            self.tokens[i] = bytes(map(byte_of.__getitem__, token))
        for token, i in self.special.items():
            self.tokens[i] = token.encode()
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(doc["model"]["merges"]):
            self.merges[ids[a], ids[b]] = (rank, ids[a + b])
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merge(self, word: bytes) -> list[int]:
        """Token ids of one word: always the leftmost pair of the lowest rank is joined next."""
        single, merges = self.single, self.merges
        parts = [single[b] for b in word]
        if len(parts) > 64:
            return self._merge_long(parts)
        none = (1 << 30, 0)
        pairs = [merges.get(p, none) for p in zip(parts, parts[1:], strict=False)]
        while pairs:
            best = min(pairs)
            if best is none or best[0] == none[0]:
                break
            i = pairs.index(best)
            parts[i : i + 2] = [best[1]]
            del pairs[i]
            if i:
                pairs[i - 1] = merges.get((parts[i - 1], parts[i]), none)
            if i < len(pairs):
                pairs[i] = merges.get((parts[i], parts[i + 1]), none)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same over a linked list with a heap, for words without a length bound."""
        from heapq import heapify, heappop, heappush

        n, merges = len(parts), self.merges
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*m, i) for i in range(n - 1) if (m := merges.get((parts[i], parts[i + 1])))]
        heap = [(rank, i, new, parts[i], parts[i + 1]) for rank, new, i in heap]
        heapify(heap)
        while heap:
            _, i, new, a, b = heappop(heap)
            j = right[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = new, -1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if m := merges.get((new, parts[k])):
                    heappush(heap, (m[0], i, m[1], new, parts[k]))
            if (h := left[i]) >= 0 and (m := merges.get((parts[h], new))):
                heappush(heap, (m[0], h, m[1], parts[h], new))
        return [p for p in parts if p >= 0]

    def decode(self, ids) -> str:
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=1)
def _lexicon(path: str) -> Lexicon:
    return Lexicon.open(path)


def _count(max_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in common.documents_in_pieces(batches, 0, 6_000_000):
            found: Counter[str] = Counter()
            for text in texts:
                found.update(split_words(text))
            words = [w for w in found if len(w) <= max_bytes]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([found[w] for w in words], pa.int64())], ["word", "n"])

    return run


def frequent_words(docs: DataFrame, most: int, max_chars: int = 64) -> list[str]:
    """The most frequent words of all texts: all those above the lowest count at which at most ``most`` words remain.

    Every occurrence is counted. ``max_chars`` leaves out words that a lexicon should not hold; they are merged instead.
    """
    found = docs.select("text").mapInArrow(_count(max_chars), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = common.settle(found, "word-counts")
    left, least = most, None
    for row in sorted(counts.groupBy("n").count().collect(), key=lambda r: -r["n"]):
        left -= row["count"]
        if left < 0:
            break
        least = row["n"]
    if least is None:
        return []
    return counts.where(F.col("n") >= least).select("word").toArrow().column(0).to_pylist()


def compile_lexicon(docs: DataFrame, vocab_path: str, most: int = 131_072) -> bytes:
    """The lexicon file for a corpus; its size is bounded by ``most`` words."""
    vocab = _vocabulary(vocab_path)
    words = [w.encode() for w in frequent_words(docs, most)]
    return build(words, [vocab.merge(w) for w in words])


class Encoder:
    """Encodes lists of texts with a lexicon; remembers at most ``remember`` merged words between calls."""

    def __init__(self, vocab: Vocabulary, lexicon: Lexicon, remember: int = 100_000) -> None:
        self.vocab, self.lexicon, self.remember = vocab, lexicon, remember
        self.merged: dict[str, bytes] = {}
        self.table, self.single = MergeTable(vocab.merges), np.array(vocab.single, np.int32)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed little-endian ids of each text."""
        vocab, cut = self.vocab, self.vocab.cut
        marks = list(vocab.special)
        split = []
        for text in texts:
            if cut and any(m in text for m in marks):
                words = []
                for piece in cut.split(text):
                    words.extend([piece] if piece in vocab.special else split_words(piece))
                split.append(words)
            else:
                split.append(split_words(text))
        distinct = list(set().union(*split))
        known = dict(zip(distinct, self.lexicon.lookup([w.encode() for w in distinct]), strict=True))
        if len(self.merged) > self.remember:
            self.merged = {}
        merged, merge = self.merged, vocab.merge
        unseen = [w for w, ids in known.items() if ids is None and w not in merged]
        for word, ids in zip(unseen, merge_words(self.table, [w.encode() for w in unseen], self.single, self.single, "<u4"), strict=True):
            if ids is None:  # a long word
                known[word] = np.array(merge(word.encode()), "<u4").tobytes()
            else:
                merged[word] = ids
        for word, ids in known.items():
            if ids is None:
                known[word] = merged[word]
        for mark, i in vocab.special.items():
            known[mark] = int(i).to_bytes(4, "little")
        return [b"".join(map(known.__getitem__, words)) for words in split]


@lru_cache(maxsize=1)
def _encoder(vocab_path: str, lexicon_path: str) -> Encoder:
    return Encoder(_vocabulary(vocab_path), _lexicon(lexicon_path))


def ship(docs: DataFrame, vocab_path: str, most: int) -> tuple[str, str]:
    """Build the lexicon for ``docs``; both files go to the executors through Spark."""
    spark = docs.sparkSession
    lexicon = common.ship_bytes(spark, "lexicon.bin", compile_lexicon(docs, vocab_path, most))
    with open(vocab_path, "rb") as f:
        return common.ship_bytes(spark, "vocabulary.json", f.read()), lexicon


def _encode_rows(vocab_name: str, lexicon_name: str, text_at: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(SparkFiles.get(vocab_name), SparkFiles.get(lexicon_name))
        decode = encoder.vocab.decode
        for rows, texts in common.documents_in_pieces(batches, text_at):
            packed = encoder.encode(texts)
            arrays = [*rows.columns]
            names = [*rows.schema.names]
            del arrays[text_at], names[text_at]
            arrays += [
                pa.array([len(p) // 4 for p in packed], pa.int64()),
                pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()),
                pa.array([hashlib.sha256(decode(np.frombuffer(p, "<u4").tolist()).encode()).hexdigest() for p in packed], pa.string()),
            ]
            names += ["n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                ends = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<u4").astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def digests(docs: DataFrame, vocab_path: str, most: int = 131_072) -> DataFrame:
    """Encode, decode again and digest both: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    docs = docs.select("doc_id", "text")
    vocab, lexicon = ship(docs, vocab_path, most)
    return docs.mapInArrow(_encode_rows(vocab, lexicon, 1, False), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, vocab_path: str, most: int = 131_072) -> DataFrame:
    """The digests with the token ids as ``ids array<int>``."""
    docs = docs.select("doc_id", "text")
    vocab, lexicon = ship(docs, vocab_path, most)
    return docs.mapInArrow(_encode_rows(vocab, lexicon, 1, True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>")


def decode(encoded: DataFrame, vocab_path: str) -> DataFrame:
    """``doc_id`` and the decoded text of rows with ``doc_id, ids`` (null ids: empty)."""
    with open(vocab_path, "rb") as f:
        vocab = common.ship_bytes(encoded.sparkSession, "vocabulary.json", f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(SparkFiles.get(vocab))
        for rows in batches:
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([v.decode(x or []) for x in rows.column(1).to_pylist()], pa.string())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded string")


def default_vocabulary() -> str:
    """Path of the public vocabulary file; ``LODEWORKS_BPE`` names another."""
    if named := os.environ.get("LODEWORKS_BPE"):
        return named
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents"), default_vocabulary())
