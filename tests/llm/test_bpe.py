"""Encoding by chunks against the tokenizers library, and decoding."""

import hashlib
import random

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tributary.llm import bpe, queries, tokens

BITS = [" ", "  ", "\n", "\t ", "'", "'s", "'re", "'ll", "a", "bc", "the", "1", "23", "!", "_", "é", "日", "😀", "<|endoftext|>", "<|end", "\x00", "\x1c", "\x85", "́", "r", "e", "Ᲊ", "͸"]
DOCS = "doc_id long, text string, ids int, n_tokens int, chunks int"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_tokenizer())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    mixed = ["".join(rng.choice(BITS) for _ in range(rng.choice([1, 3, 10, 300, 3000]))) for _ in range(200)]
    passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(900))
    shared = [f"{k} begins {passage}\nand ends {k}" for k in range(5)]
    long_ = ["a" * 30_000, "ab" * 20_000 + " x", "!" * 9_999 + " " * 9_999 + "\n" * 9_000, " " * 20_000, "'" * 5_000 + "s", "x\n" * 30_000]
    edges = [None, "", "   a  b   ", "<|endoftext|>", "<|endoftext|><|endoftext|> ", "'s 's'S can't  ''s !'s\n's  'll're've'v'l'rex"]
    return mixed + shared + long_ + edges


def test_ids_are_those_of_the_library(library, texts):
    encoder = bpe.Encoder(bpe.default_tokenizer())
    got = list(encoder.encode(texts))
    assert [g.tolist() for g in got] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    back = bpe.decoded(np.concatenate(got), np.concatenate(([0], np.cumsum([len(g) for g in got]))), bpe.default_tokenizer())
    assert back == [t or "" for t in texts]


def test_ids_with_little_memory(library, texts, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 50)
    monkeypatch.setattr(bpe, "GROUP_CHARS", 2000)
    encoder = bpe.Encoder(bpe.default_tokenizer(), memory=4000)
    got = [g.tolist() for g in encoder.encode(texts)]
    assert got == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert encoder.held <= 4000


def test_shared_passages_are_encoded_once(texts):
    rng = random.Random(2)
    passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(5000))
    encoder = bpe.Encoder(bpe.default_tokenizer())
    list(encoder.encode([passage]))
    once = encoder.encoded
    list(encoder.encode([f"{'other words ' * k}{passage} {k}" for k in range(20)]))
    assert encoder.encoded - once < 0.2 * 20 * len(passage) and encoder.reused > 0.8 * 20 * len(passage)


def test_cuts_cover_texts_and_follow_content():
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefghij 日") for _ in range(40_000))
    ends = bpe.cuts(text)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(text) and sizes[:-1].min() >= bpe.LEAST and sizes.max() <= bpe.MOST
    moved = {e - 7 for e in bpe.cuts("another" + text)}
    assert len(moved & set(ends)) > 0.9 * len(ends)
    assert bpe.cuts("") == [] and bpe.cuts("a") == [1] and bpe.cuts("a" * 9000)[-1] == 9000


def test_words_begin_where_the_pattern_matches(texts):
    for t in filter(None, texts):
        if any(c in t for c in "Ᲊ͸\x1c"):  # where regex and the tokenizer have other tables
            continue
        text = t + "\0"
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kind = bpe._kinds()[code]
        kind[-1] = bpe.END
        assert bpe.word_starts(code, kind).tolist() == [m.start() for m in regex.finditer(bpe.PATTERN, t)]


def test_every_character_is_of_the_kind_the_tokenizer_sees(library):
    encoder = bpe.Encoder(bpe.default_tokenizer())
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    sample = points[:0x3000] + points[0x3000::7]
    for begin in range(0, len(sample), 4000):
        part = sample[begin : begin + 4000]
        at = {o[0] for _, o in library.pre_tokenizer.pre_tokenize_str("".join(f"\na{chr(c)}\n1{chr(c)}\n!{chr(c)}" for c in part))}
        seen = [tokens.LETTER if 9 * j + 2 not in at else tokens.NUMBER if 9 * j + 5 not in at else tokens.OTHER if 9 * j + 8 not in at else tokens.SPACE for j in range(len(part))]
        assert encoder._kind(np.array(part, np.uint32)).tolist() == seen


def test_decoding_of_any_ids(spark, library):
    rng = random.Random(6)
    rows = [(k, [rng.randrange(50257) for _ in range(n)]) for k, n in enumerate([0, 1, 5, 400])] + [(9, None)]
    got = bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), bpe.default_tokenizer()).collect()
    assert {r["doc_id"]: r["text"] for r in got} == {k: library.decode(ids or [], skip_special_tokens=False) for k, ids in rows}


def test_query_equals_the_library(spark, sf, library):
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, queries.op11_bpe_round_trip(spark, sf).collect())) == sorted(want)


def test_tables(spark, library, texts):
    rows = [(k, t, 1, 2, 3) for k, t in enumerate(texts)] + [(None, "one", 1, 2, 3)] * 2
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = bpe.encode(docs, bpe.default_tokenizer(), keep=["doc_id", "n_tokens"]).collect()
    assert sorted((str(r["doc_id"]), r["ids"]) for r in got) == sorted((str(r[0]), library.encode(r[1] or "", add_special_tokens=False).ids) for r in rows)
    assert bpe.round_trip_digest(docs.limit(0), bpe.default_tokenizer()).count() == 0
    digest = bpe.round_trip_digest(docs, bpe.default_tokenizer())
    assert digest.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert digest.filter(F.col("n_tokens") == 0).count() == 2
    with pytest.raises(ValueError):
        bpe.encode(docs, bpe.default_tokenizer(), keep=["ids"])


def test_other_tokenizers_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        bpe.Encoder(public_tokenizers.path("word_bpe_49k.json"))
