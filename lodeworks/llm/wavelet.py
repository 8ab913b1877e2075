"""Token-id files as one wavelet matrix per shard: access, counting and occurrence lookup on bit-planes.

A corpus is put in ascending ``doc_id`` order, encoded, and cut into shards of about a million ids. Each shard is one
file image: document ids and lengths, then one bit-plane per bit of an id, stably partitioned from the highest bit
down, with a count directory every 512 bits. Images are rows of a Parquet table in the shared folder, so Spark's
committer makes them whole or absent and any store can hold them; ``image_to_file`` gives a stand-alone file.

Defined cases: a null text counts as empty (its only id is the end id); rows are ordered by ``doc_id`` (nulls first),
ties by a hash of the text, so repeated rows all appear; an empty table gives no shards and no rows; long texts are
taken whole (a document may make a shard larger than the aim); columns besides ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import json
import os
import re
import string
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeworks.llm import common
from lodeworks.llm.bpe import byte_letters
from lodeworks.llm.merging import MergeTable, merge_column

_MAGIC = b"LWWAV1\n\0"
_STEP = 512
_PIECE = 1 << 15


def _partition(ones: np.ndarray, low: int) -> Iterator[tuple[tuple[np.ndarray, np.ndarray], slice, int, int]]:
    """A plane in pieces that stay in the processor's cache.

    For each piece: where its zeros and its ones are, the piece, and where they begin in the stably partitioned sequence.
    """
    z, o = 0, low
    for at in range(0, len(ones), _PIECE):
        piece = slice(at, at + _PIECE)
        zero, one = np.flatnonzero(~ones[piece]), np.flatnonzero(ones[piece])
        yield (zero, one), piece, z, o
        z, o = z + len(zero), o + len(one)


class WaveletMatrix:
    """Bit-planes of a sequence of non-negative integers below ``2 ** bits``."""

    def __init__(self, n: int, bits: int, planes: list[np.ndarray], zeros: list[int], directory: list[np.ndarray]) -> None:
        self.n, self.bits, self.planes, self.zeros, self.directory = n, bits, planes, zeros, directory

    @classmethod
    def of(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        x = np.ascontiguousarray(ids, np.uint16 if bits <= 16 else np.uint32)
        planes, zeros, directory = [], [], []
        for shift in range(bits - 1, -1, -1):
            ones = (x & x.dtype.type(1 << shift)) != 0
            plane = np.packbits(ones)
            planes.append(plane)
            directory.append(cls._directory(plane))
            low = len(x) - int(np.count_nonzero(ones))
            zeros.append(low)
            parted = np.empty_like(x)
            for (zero, one), piece, z, o in _partition(ones, low):
                parted[z : z + len(zero)] = x[piece][zero]
                parted[o : o + len(one)] = x[piece][one]
            x = parted
        return cls(len(ids), bits, planes, zeros, directory)

    @staticmethod
    def _directory(plane: np.ndarray) -> np.ndarray:
        step = _STEP // 8
        padded = np.zeros(-(-max(len(plane), 1) // step) * step, np.uint8)
        padded[: len(plane)] = plane
        counts = np.bitwise_count(padded.view(np.uint64)).reshape(-1, step // 8).sum(axis=1, dtype=np.uint32)
        return np.concatenate([np.zeros(1, np.uint32), np.cumsum(counts, dtype=np.uint32)])

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        block = i // _STEP
        at = block * _STEP // 8
        total = int(self.directory[level][block])
        whole = self.planes[level][at : i // 8]
        total += int(np.bitwise_count(whole).sum())
        if i % 8:
            total += (int(self.planes[level][i // 8]) >> (8 - i % 8)).bit_count()
        return total

    def access(self, i: int) -> int:
        """The id at position ``i``."""
        value = 0
        for level in range(self.bits):
            bit = (int(self.planes[level][i // 8]) >> (7 - i % 8)) & 1
            ones = self._ones(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def count(self, value: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of ``value`` in positions ``start`` to ``end`` (exclusive)."""
        lo, hi = start, self.n if end is None else end
        if not 0 <= value < 1 << self.bits:
            return 0
        for level in range(self.bits):
            a, b = self._ones(level, lo), self._ones(level, hi)
            if value >> (self.bits - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return max(0, hi - lo)

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        """Position of the ``k``-th (from 0) such bit of a plane."""
        counts = self.directory[level].astype(np.int64)
        if not bit:
            counts = np.minimum(np.arange(len(counts)) * _STEP, self.n) - counts
        block = int(np.searchsorted(counts, k, "right")) - 1
        at = block * _STEP
        piece = np.unpackbits(self.planes[level][at // 8 : (at + _STEP) // 8])[: self.n - at]
        return at + int(np.flatnonzero(piece == bit)[k - int(counts[block])])

    def select(self, value: int, k: int) -> int:
        """Position of the ``k``-th (from 0) occurrence of ``value``."""
        if not 0 <= k < self.count(value):
            raise IndexError(k)
        lo = 0
        for level in range(self.bits):
            ones = self._ones(level, lo)
            lo = self.zeros[level] + ones if value >> (self.bits - 1 - level) & 1 else lo - ones
        i = lo + k
        for level in range(self.bits - 1, -1, -1):
            bit = value >> (self.bits - 1 - level) & 1
            i = self._select_bit(level, bit, i - self.zeros[level] if bit else i)
        return i

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, k) for k in range(self.count(value))]

    def all(self) -> np.ndarray:
        """The whole sequence, from the lowest plane up."""
        x = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            ones = np.unpackbits(self.planes[level], count=self.n).view(bool)
            up = np.empty_like(x)
            x[self.zeros[level] :] |= x.dtype.type(1 << (self.bits - 1 - level))
            for (zero, one), piece, z, o in _partition(ones, self.zeros[level]):
                up[piece][zero] = x[z : z + len(zero)]
                up[piece][one] = x[o : o + len(one)]
            x = up
        return x


def to_image(doc_ids: list[int | None], lengths: list[int], matrix: WaveletMatrix) -> bytes:
    """One shard as file bytes."""
    parts = [
        np.array([d is not None for d in doc_ids], np.uint8).tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.array(lengths, "<i8").tobytes(),
        np.array(matrix.zeros, "<i8").tobytes(),
        *(p.tobytes() for p in matrix.planes),
        *(d.astype("<u4").tobytes() for d in matrix.directory),
    ]
    return _MAGIC + struct.pack("<qqq", len(doc_ids), matrix.n, matrix.bits) + b"".join(parts)


def from_image(image: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """Document ids, lengths and matrix of a shard."""
    if image[:8] != _MAGIC:
        raise ValueError("not a token shard")
    docs, n, bits = struct.unpack_from("<qqq", image, 8)
    at = 32

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(image, kind, count, at)
        at += out.nbytes
        return out

    known, ids, lengths, zeros = take("u1", docs), take("<i8", docs), take("<i8", docs), take("<i8", bits)
    planes = [take("u1", (n + 7) // 8) for _ in range(bits)]
    steps = -(-max((n + 7) // 8, 1) // (_STEP // 8)) + 1
    directory = [take("<u4", steps) for _ in range(bits)]
    return [i if k else None for k, i in zip(known.tolist(), ids.tolist(), strict=True)], lengths, WaveletMatrix(n, bits, planes, zeros.tolist(), directory)


def image_to_file(image: bytes, path: str) -> None:
    """A stand-alone compressed file of one shard, put in place by rename."""
    with open(f"{path}.part", "wb") as f:
        f.write(zlib.compress(image, 1))
    os.replace(f"{path}.part", path)


#: The words of this vocabulary for lower-case text below U+0130, and its white space.
_BLANKS = "\t-\r \u0085\u00a0"
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-į"
_NUMBERS = "0-9²³¹¼-¾"
_MARKS = string.punctuation
_ALL_LETTERS = "".join(c for c in map(chr, range(0x130)) if re.match(f"[{_LETTERS}]", c))
_words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_BLANKS}{_LETTERS}{_NUMBERS}]+").findall
#: What the fast way leaves to the library: later letters, and controls that only Python takes for white space.
_beyond = re.compile("[^\x00-\x1b\x20-į]").search


def _is_plain(text: str) -> bool:
    """Whether the fast way gives what the library gives."""
    return "<|" not in text and ((text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f")) or not _beyond(text))


def _joined(parts: pa.Array, sizes: np.ndarray) -> pa.Array:
    """Runs of so many neighbouring binaries as one binary each."""
    _, offsets, data = parts.buffers()
    ends = np.frombuffer(offsets, np.int64, len(parts) + 1, parts.offset * 8)[np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])]
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), data])


class WordTokenizer:
    """What the tokenizers library gives, with the merges of a call's distinct words made side by side.

    White space never joins two words of this vocabulary, so a chunk's ids do not depend on its neighbours. Nothing is
    kept between calls; what is not plain text and words over 48 bytes go through the library itself.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids, end = model["vocab"], model["end_of_word_suffix"]
        self.merges = MergeTable({(ids[a], ids[b]): (rank, ids[a.removesuffix(end) + b]) for rank, (a, b) in enumerate(model["merges"])})
        self.inside = np.array([ids[c] for c in byte_letters()], np.int32)
        self.ending = np.array([ids[c + end] for c in byte_letters()], np.int32)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _of_words(self, words: pa.Array) -> pa.Array:
        """Packed ids of distinct words."""
        made = merge_column(self.merges, words, self.inside, self.ending, "<u2")
        if not made.null_count:
            return made
        long = made.is_null()
        ids = [struct.pack(f"<{len(i)}H", *i) for i in self._encode(words.filter(long).to_pylist())]
        return pc.replace_with_mask(made, long, pa.array(ids, pa.large_binary()))

    def _of_chunks(self, chunks: pa.Array) -> pa.Array:
        """Packed ids of distinct chunks, put together from those of their words.

        Most chunks are letters with or without marks behind them, a word each; the others are cut one by one.
        """
        letters, marks = pc.utf8_rtrim(chunks, characters=_MARKS), pc.utf8_ltrim(chunks, characters=_ALL_LETTERS)
        simple = pc.utf8_is_alpha(letters)
        others = list(map(_words, chunks.filter(pc.invert(simple)).to_numpy(zero_copy_only=False)))
        sizes = np.array([len(ws) for ws in others], np.int64)
        few = pc.unique(marks.filter(simple))
        cut = pa.concat_arrays([letters.filter(simple), few, pa.array([w for ws in others for w in ws], pa.string())]).dictionary_encode()
        ids = self._of_words(cut.dictionary).take(cut.indices)
        n = len(chunks) - len(others)
        tails = ids.slice(n, len(few)).take(pc.index_in(marks.filter(simple), few))
        whole = pc.binary_join_element_wise(ids.slice(0, n), tails, pa.scalar(b"", pa.large_binary()))
        rest = _joined(ids.slice(n + len(few)), sizes)
        at = simple.to_numpy(zero_copy_only=False)
        places = np.where(at, np.cumsum(at) - 1, n + np.cumsum(~at) - 1)
        return pa.concat_arrays([whole, rest]).take(pa.array(places))

    def encode(self, texts: list[str], end: int) -> list[bytes]:
        """Packed unsigned 16-bit ids of each text and the end id.

        Plain texts are cut, numbered and put together in whole columns.
        """
        stop = struct.pack("<H", end)
        plain = [i for i, t in enumerate(texts) if _is_plain(t)]
        out: list[bytes] = [stop] * len(texts)
        cut = pc.utf8_split_whitespace(pc.utf8_lower(pa.array([texts[i] for i in plain], pa.string())))
        coded = cut.flatten().dictionary_encode()
        joined = self._of_chunks(coded.dictionary).take(coded.indices)
        _, offsets, data = joined.buffers()
        if data is not None:
            ends = np.frombuffer(offsets, np.int64, len(joined) + 1)[cut.offsets.to_numpy()].tolist()
            whole = memoryview(data)
            for i, s, e in zip(plain, ends, ends[1:], strict=False):
                out[i] = whole[s:e].tobytes() + stop
        done = set(plain)
        rest = [i for i in range(len(texts)) if i not in done]
        for i, ids in zip(rest, self._encode([texts[i] for i in rest]), strict=True):
            out[i] = struct.pack(f"<{len(ids)}H", *ids) + stop
        return out


@lru_cache(maxsize=1)
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


_SHARDS = "part int, shard int, before long, n_docs long, n_tokens long, image binary"


def _write(vocab: str, end: int, aim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(SparkFiles.get(vocab))
        bits = max(1, (tokenizer.size - 1).bit_length())
        part, shard, before = TaskContext.get().partitionId(), 0, 0
        docs: list[int | None] = []
        packed: list[bytes] = []

        def close() -> pa.RecordBatch:
            nonlocal shard, before, docs, packed
            lengths = [len(p) // 2 for p in packed]
            image = to_image(docs, lengths, WaveletMatrix.of(np.frombuffer(b"".join(packed), "<u2"), bits))
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([before], pa.int64()), pa.array([len(docs)], pa.int64()), pa.array([sum(lengths)], pa.int64()), pa.array([image], pa.binary())],
                ["part", "shard", "before", "n_docs", "n_tokens", "image"],
            )
            shard, before, docs, packed = shard + 1, before + sum(lengths), [], []
            return row

        held = 0
        for rows, texts in common.documents_in_pieces(batches, 1, 6_000_000):
            for doc, ids in zip(rows.column(0).to_pylist(), tokenizer.encode(texts, end), strict=True):
                docs.append(doc)
                packed.append(ids)
                held += len(ids) // 2
                if held >= aim:
                    yield close()
                    held = 0
        if docs:
            yield close()

    return run


def write_shards(docs: DataFrame, vocab_path: str, end: int = 1, aim: int = 1_000_000) -> DataFrame:
    """Write all documents as shards in the shared folder; the table of shards, read back from there."""
    spark = docs.sparkSession
    with open(vocab_path, "rb") as f:
        vocab = common.ship_bytes(spark, "words.json", f.read())
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return common.settle(keyed.select("doc_id", "text").mapInArrow(_write(vocab, end, aim), _SHARDS), "token-shards")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        for start, image in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
            docs, lengths, matrix = from_image(image.as_py())
            ids = matrix.all().astype("<u4")
            view, ends = memoryview(ids), np.cumsum(lengths)
            begins = ends - lengths
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(docs, pa.int64()),
                    pa.array(begins + start),
                    pa.array(lengths),
                    pa.array([zlib.crc32(view[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)], pa.int64()),
                ],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_documents(shards: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in a table of shards.

    Offsets of the writing tasks are a running sum over one row per task, which also bounds what is broadcast.
    """
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    begins = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("begin"))
    placed = shards.join(F.broadcast(begins), "part").select((F.col("begin") + F.col("before")).alias("start"), "image")
    return placed.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def count_token(shards: DataFrame, token: int) -> DataFrame:
    """Occurrences of one id per shard, counted on the bit-planes without decoding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = [from_image(x.as_py())[2].count(token) for x in rows.column(2)]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(found, pa.int64())], ["part", "shard", "n"])

    return shards.select("part", "shard", "image").mapInArrow(run, "part int, shard int, n long")


def default_vocabulary() -> str:
    """Path of the public vocabulary file; ``LODEWORKS_WORD_BPE`` names another."""
    if named := os.environ.get("LODEWORKS_WORD_BPE"):
        return named
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_documents(write_shards(common.table(spark, sf_dir, "documents"), default_vocabulary()))
