"""Ranked search against a brute-force version of the score."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tributary.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, n int, terms int, score int, item_id int, rank int"


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def best_by_hand(docs, items, best=50):
    counted = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(n > 0 for _, _, n in counted), sum(n for _, _, n in counted)
    df = Counter(w for _, c, _ in counted for w in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, words in asked.items():
        scores = []
        for doc, c, n in counted:
            m = 100 - 50 + (50 * n * n_docs) // n_terms if n else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 20 * m)) for w in words if c[w])
            if score > 0:
                scores.append((-score, doc is not None, doc or 0, doc))
        out += [(item, k, doc, -score) for k, (score, _, _, doc) in enumerate(sorted(scores)[:best], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = [*"abcdefghij", "the", "The", "x1", "日本", "é", "lone"]
    docs = [(rng.choice([None, *range(120)]), " ".join(rng.choice(words[:-1]) for _ in range(rng.choice([1, 3, 30])))) for _ in range(200)]
    docs += docs[:30] + [(500, None), (501, ""), (502, "..., !"), (503, "lone " * 3000), (504, " ".join(f"w{k}" for k in range(50_000)))]
    items = [(i, " ".join(rng.choice(words) for _ in range(k))) for i, k in enumerate([1, 2, 5, 12, 40])]
    items += [(9, None), (10, ""), (11, "nowhere"), (3, "lone w7 w8"), (None, "the; a")]
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, 1, 2, 3, 4, 5) for d in docs], DOCS).repartition(3), spark.createDataFrame([(*i, 7) for i in items], "item_id long, text string, w int")


def test_search_equals_brute_force_and_sql(spark, rows):
    docs, items = frames(spark, *rows)
    want = best_by_hand(*rows)
    for bounds in ({}, {"window": 7}, {"window": 64, "block_terms": 5}, {"most_terms": 3}):
        assert sorted(map(tuple, search.search(docs, items, **bounds).collect()), key=str) == want
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    con.register("benchmark", items.toArrow())
    assert sorted(con.sql(search.ORACLE_SQL).fetchall(), key=str) == want


def test_best_is_a_parameter_and_ids_may_be_texts(spark, rows):
    docs, items = rows
    d = spark.createDataFrame([(f"d{i:04}", t) for i, t in docs if i is not None], "doc string, text string")
    m = spark.createDataFrame([(f"i{i}", t) for i, t in items if i is not None], "item string, text string")
    got = search.search(d, m, best=4, id_col="doc", item_col="item", window=16)
    want = best_by_hand([r for r in docs if r[0] is not None], [r for r in items if r[0] is not None], 4)
    assert sorted(map(tuple, got.collect())) == sorted((f"i{i}", k, f"d{doc:04}", s) for i, k, doc, s in want)
    with pytest.raises(ValueError):
        search.search(d, m, id_col="item", item_col="item")


def test_search_of_nothing(spark, rows):
    docs, items = frames(spark, *rows)
    no_docs, no_items = docs.limit(0), items.limit(0)
    assert search.search(no_docs, items).count() == search.search(docs, no_items).count() == search.search(no_docs, no_items).count() == 0


def test_windows_are_bounded_and_whole():
    rng = random.Random(4)
    sizes = [rng.choice([0, 1, 3, 40]) for _ in range(100)]
    of = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(of), pa.array(np.arange(of[-1], dtype=t))) for t in (np.int64, np.int32)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array([5] * 100), *lists], names=["id", "n", "terms", "tfs"])
    got = list(search._windows(iter([batch.slice(0, 30), batch.slice(30)]), window=9, most=20))
    assert [i for w in got for i in w[0].to_pylist()] == list(range(100))
    assert np.concatenate([w[2] for w in got]).tolist() == list(range(of[-1]))
    assert all(len(w[1]) <= 9 and (len(w[2]) <= 20 or len(w[1]) == 1) for w in got)


def test_a_word_of_the_same_hash_is_no_match():
    data = np.frombuffer(b"one two three", np.uint8)
    starts, ends = np.array([0, 4, 8]), np.array([3, 7, 13])
    hashes = np.array([5, 5, 9], np.uint64)
    known = search.Vocabulary([b"three", b"two"], np.array([9, 5], np.uint64))
    assert known.find(hashes, data, starts, ends).tolist() == [-1, 0, 1]
