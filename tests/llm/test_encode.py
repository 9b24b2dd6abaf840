import base64
import random

import pytest

from echolith.llm import encode
from echolith.llm.encode import Transducer, decode_column, decode_stream, encode_column, transducer

FOLDER = encode.VOCABULARIES
TEXTS = [
    None, "", " ", "\n\n \t", "Hello world's end", "größe naïve 漢字かな 🐛🐛", "<|endoftext|> stays text", "a" * 5000, "ab" * 700, "1234567890" * 40, "=" * 300 + "-" * 77, "don't  stop\r\n  now   ", "é ​﻿ x", "\x00\x07\x1b[31m",
]


@pytest.fixture(scope="module")
def library():
    tiktoken = pytest.importorskip("tiktoken")
    with open(encode._file(FOLDER, "byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(t): int(i) for t, i in (x.split() for x in lines if x.strip())}
    return tiktoken.Encoding("own", pat_str=encode.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_as_the_library(library):
    t = transducer(FOLDER, "byte_bpe_50k")
    r = random.Random(2)
    alphabets = ["ab", "abcdefghijklmnopqrstuvwxyz", "ACGT", "é漢字あ", "=-_*", "0123456789", "aaaaab", " \n\t", "etaoin shrdlu"]
    texts = TEXTS + ["".join(r.choices(r.choice(alphabets), k=r.randint(1, 700))) for _ in range(150)]
    for text in texts:
        assert t.encode(text) == library.encode_ordinary(text or "")


def test_stream_gives_the_same_in_chunks_of_any_size(library):
    t = transducer(FOLDER, "byte_bpe_50k")
    for text in ("abcdefgh" * 300, "the" * 400 + "q" * 999, "漢" * 300):
        raw = text.encode()
        for size in (1, 7, 100, len(raw)):
            assert list(t.stream(raw[i : i + size] for i in range(0, len(raw), size))) == library.encode_ordinary(text)


def test_texts_in_chunks_of_any_size(library, monkeypatch):
    """Whatever the buffer: contractions, runs of blanks and long pieces that lie on a border."""
    t = transducer(FOLDER, "byte_bpe_50k")
    r = random.Random(5)
    texts = [x for x in TEXTS if x] + ["it's we'll they've I'd 'tis '", "a   b", "a \n  b", " " * 90 + "x" * 90 + " " * 90, "\n" * 70 + "y", " " + "z" * 200 + "'s", "!" * 150 + "'ll" + "1" * 99 + " 2", "\t" * 80]
    texts += ["".join(r.choices(["'", "s", "ll", " ", "  ", "\n", "a", "é", "1", "-", "漢"], k=60)) for _ in range(60)]
    for buffer in (1, 5, 64):
        monkeypatch.setattr(encode, "_BUFFER", buffer)
        for text in texts:
            assert t.encode(text) == library.encode_ordinary(text), (buffer, text)
            size = r.randint(1, 7)
            assert list(t.encode_stream(text[i : i + size] for i in range(0, len(text), size))) == library.encode_ordinary(text)


def test_memory_does_not_grow_with_the_text():
    """Twenty million characters, as words and as one single piece, in a few megabytes."""
    import tracemalloc

    t = transducer(FOLDER, "byte_bpe_50k")
    for block in ("the quick brown fox's tail 123 \n" * 2_000, "ab" * 500):
        peaks = []
        for n in (2, 8):
            tracemalloc.start()
            assert sum(1 for _ in t.encode_stream(block for _ in range(n))) > 0
            peaks.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
        assert peaks[1] < peaks[0] + 3_000_000


def test_lookahead_comes_from_the_merges():
    """Live positions are those whose bytes since begin a token; most of the time far fewer than the longest token allows."""
    t = Transducer({bytes([i]): i for i in range(97, 101)} | {b"ab": 300, b"abc": 301})
    p = encode._Piece(t)
    assert list(p.feed(b"ddab")) == [] and p.live() == {2, 4}
    assert list(p.feed(b"c")) == [] and p.live() == {5}
    assert list(p.close()) == [100, 100, 301]


def test_tokens_come_before_the_end():
    t = transducer(FOLDER, "byte_bpe_50k")
    read = 0

    def source():
        nonlocal read
        for _ in range(20_000):
            read += 1
            yield b"ab"

    next(iter(t.stream(source())))
    assert read < 1_000


def test_the_other_rank_vocabulary():
    tiktoken = pytest.importorskip("tiktoken")
    t = transducer(FOLDER, "byte_bpe_multi_50k")
    other = tiktoken.Encoding("m", pat_str=encode.PATTERN, mergeable_ranks=t.ranks, special_tokens={})
    for text in TEXTS:
        assert t.encode(text) == other.encode_ordinary(text or "")


def test_round_trip(spark, rows):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(0, None, 2)], "id bigint, text string, ids int")
    ids = encode_column(df, "id", "text")
    assert dict(ids.dtypes) == {"id": "bigint", "ids": "array<int>"} and ids.where("ids is null").count() == 0 and ids.count() == len(TEXTS) + 1
    assert rows(decode_column(ids, "id", "ids")) == sorted([(i, t or "") for i, t in enumerate(TEXTS)] + [(0, "")], key=repr)
    assert encode_column(df.limit(0), "id", "text").count() == 0


def test_decoding_holds_back_unfinished_characters():
    t = Transducer({bytes([i]): i for i in range(256)})
    parts = list(decode_stream("a漢".encode(), t.token_bytes))
    assert parts == ["a", "漢"] and "".join(decode_stream([0xE6], t.token_bytes)) == "�"
