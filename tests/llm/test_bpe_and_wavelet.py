import cProfile
import hashlib
import pstats
import random
import struct
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from lodeworks.llm import bpe, wavelet
from lodeworks.llm.lexicon import Lexicon, build

ALPHABET = "ab 'sTM\n\t\x1c\x85\xa0éÉ²½٣中🎉!#<|ǅʰ́İΣσ-."


def odd_texts(n, seed):
    rnd = random.Random(seed)
    return ["", " ", "x" * 3000, "ab" * 4000, "a<|endoftext|>b <|startoftext|>"] + ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


def test_lexicon_is_a_map():
    words = sorted({w.encode() for w in "car cars care cat cats dog dogs do zebra ä 中".split()})
    lex = Lexicon(build(words, [[i, 2 * i] for i in range(len(words))]))
    assert lex.lookup(words) == [struct.pack("<II", i, 2 * i) for i in range(len(words))]
    assert lex.lookup([b"ca", b"", b"carsx", b"d" * 100]) == [None] * 4
    assert lex.head["states"] < 1 + sum(map(len, words))
    assert Lexicon(build([], [])).lookup([b"a"]) == [None]


def test_encoder_equals_library():
    vocab = bpe.Vocabulary(bpe.default_vocabulary())
    known = ["a", "ab", " ab", "é", "!!"]
    encoder = bpe.Encoder(vocab, Lexicon(build([w.encode() for w in known], [vocab.merge(w.encode()) for w in known])))
    library = Tokenizer.from_file(bpe.default_vocabulary())
    texts = odd_texts(1500, 1)
    for text, packed in zip(texts, encoder.encode(texts), strict=True):
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(packed, "<u4").tolist() == ids
        assert vocab.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_digests(spark):
    library = Tokenizer.from_file(bpe.default_vocabulary())
    rows = [(1, "hello world hello"), (1, "hello world hello"), (None, "dup"), (3, None), (4, ""), (5, "word " * 30_000)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, n_tokens string")
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(df, bpe.default_vocabulary(), 10).collect())
    expected = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        expected.append((i or -1, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(expected)
    assert bpe.digests(df.limit(0), bpe.default_vocabulary()).count() == 0
    encoded = bpe.encode(df, bpe.default_vocabulary(), 10)
    back = {r.doc_id: r.decoded for r in bpe.decode(encoded, bpe.default_vocabulary()).collect()}
    assert back[5] == rows[5][1] and back[3] == ""


@pytest.mark.parametrize("n", [0, 1, 7, 511, 512, 513, 4000])
def test_wavelet_matrix(n):
    x = np.random.default_rng(n).integers(0, 300, n)
    _, lengths, m = wavelet.from_image(wavelet.to_image([1, None], [n, 0], wavelet.WaveletMatrix.of(x, 9)))
    assert (m.all() == x).all() and lengths.tolist() == [n, 0]
    for i in range(0, n, max(1, n // 30)):
        assert m.access(i) == x[i]
    for v in (0, 5, 299, 400):
        assert m.count(v) == (x == v).sum() and m.count(v, n // 3, n // 2) == (x[n // 3 : n // 2] == v).sum()
        assert m.occurrences(v) == np.flatnonzero(x == v).tolist()


def test_word_tokenizer_equals_library():
    library, mine = Tokenizer.from_file(wavelet.default_vocabulary()), wavelet.WordTokenizer(wavelet.default_vocabulary())
    texts = odd_texts(1500, 2)
    for text, packed in zip(texts, mine.encode(texts, 1), strict=True):
        assert np.frombuffer(packed, "<u2").tolist() == [*library.encode(text, add_special_tokens=False).ids, 1]


def made_up_words(n, seed):
    rnd = random.Random(seed)
    parts = ["tion", "ing", "the", "schein", "keit", "ción", "ñ", "ó", "que", "é", "euil", "ß", "x", "q"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 9))) + rnd.choice(["", "", ",", ".", "!!", ".'", "'s", "'", "7", "-a"]) for _ in range(n)]


def test_word_tokenizer_on_columns_of_words():
    library, mine = Tokenizer.from_file(wavelet.default_vocabulary()), wavelet.WordTokenizer(wavelet.default_vocabulary())
    words = made_up_words(20_000, 3)
    texts = ["'", "!", ",,", "7", "a", "", "!!a!!", *(" ".join(words[i : i + 40]) for i in range(0, len(words), 40))]
    for text, packed in zip(texts, mine.encode(texts, 1), strict=True):
        assert np.frombuffer(packed, "<u2").tolist() == [*library.encode(text, add_special_tokens=False).ids, 1]


def test_word_tokenizer_handles_words_as_columns():
    library, mine = Tokenizer.from_file(wavelet.default_vocabulary()), wavelet.WordTokenizer(wavelet.default_vocabulary())
    words = {w.rstrip("-a7s'") for w in made_up_words(150_000, 4)}
    profile = cProfile.Profile()
    packed = profile.runcall(mine.encode, [" ".join(words)], 1)[0]
    assert np.frombuffer(packed, "<u2").tolist() == [*library.encode(" ".join(words), add_special_tokens=False).ids, 1]
    assert pstats.Stats(profile).total_calls < len(words)  # no call for each word


def test_wavelet_matrix_of_several_pieces():
    n = 2 * wavelet._PIECE + 77
    x = np.random.default_rng(5).integers(0, 49_000, n)
    m = wavelet.from_image(wavelet.to_image([1], [n], wavelet.WaveletMatrix.of(x, 16)))[2]
    assert (m.all() == x).all()
    assert all(m.access(i) == x[i] for i in range(0, n, 997)) and m.occurrences(int(x[n // 2])) == np.flatnonzero(x == x[n // 2]).tolist()


def test_token_files(spark):
    library = Tokenizer.from_file(wavelet.default_vocabulary())
    rows = [(5, "five words are in here"), (2, None), (9, "two"), (2, "again"), (None, "no id")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, part int")
    shards = wavelet.write_shards(df, wavelet.default_vocabulary(), aim=5)
    got = wavelet.read_documents(shards).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 2, 2, 5, 9]
    texts = {(i, len(library.encode(t or "", add_special_tokens=False).ids) + 1): t or "" for i, t in rows}
    start = 0
    for r in got:
        ids = [*library.encode(texts[r.doc_id, r.n_tokens], add_special_tokens=False).ids, 1]
        assert (r.start, r.ids_crc32) == (start, zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    assert sum(r.n for r in wavelet.count_token(shards, 1).collect()) == len(rows)
    assert wavelet.read_documents(wavelet.write_shards(df.limit(0), wavelet.default_vocabulary())).count() == 0
