"""The filter audit against a brute-force version, document by document and order by order."""

import random
import re
from itertools import permutations

import duckdb
import pytest

from tributary.llm import filteraudit

DOCS = "doc_id long, text string, source string, n int, mask int, part string, step int, sha int"
LABELS = "doc_id long, quality int, toxic int, id int, good int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def audit_by_hand(docs, labels):
    good = {i for i, quality, _ in labels if quality == 1 and i is not None}
    toxic = {i for i, _, harmful in labels if harmful == 1 and i is not None}
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    parts = {}
    for i, text, source in docs:
        text = text or ""
        words = WORD.findall(text)
        capitals = sum("A" <= c <= "Z" for c in text)
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * capitals > 5 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": i is not None and i > first[text],
        }
        parts.setdefault(source or "", []).append((fails, i in good, i in toxic))
    out = []
    for part, rows in parts.items():
        removed_by = dict.fromkeys("ABCDE", 0)
        found = []
        for order in permutations("ABCDE"):
            for step, name in enumerate(order, 1):
                left = [r for r in rows if not any(r[0][x] for x in order[: step - 1])]
                gone = [r for r in left if r[0][name]]
                redundant = sum(r[0][name] for r in rows) - len(gone)
                alone = sum(r[0][name] and sum(r[0].values()) == 1 for r in rows)
                removed_by[name] += len(gone)
                found.append((part, "".join(order), step, len(left) - len(gone), len(gone), redundant, alone, sum(r[1] for r in gone), sum(r[2] for r in gone)))
        out += [(*f, removed_by[f[1][f[2] - 1]]) for f in found]
    return sorted(out)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(5)
    texts = [None, "", "a b", "# x", "A" * 30, "a " * 60, " ".join(map(str, range(70))), "X\x0b \x1c Y日本 é | \n\tz", "Ab cd " * 25, " ".join(f"Q{k}" for k in range(90))]
    docs = [(rng.choice([None, *range(100)]), rng.choice(texts), rng.choice([None, "", "s1", "s2"])) for _ in range(300)]
    docs += docs[:20]  # whole rows again
    labels = [(rng.choice([None, *range(120)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(150)]
    return docs, labels


def test_audit_equals_brute_force_and_sql(spark, tables):
    docs, labels = tables
    d = spark.createDataFrame([(*r, 1, 2, "p", 3, 4) for r in docs], DOCS).repartition(3)
    m = spark.createDataFrame([(*r, 5, 6) for r in labels], LABELS)
    got = sorted(map(tuple, filteraudit.filter_audit(d, m).collect()))
    want = audit_by_hand(docs, labels)
    assert got == want
    con = duckdb.connect()
    con.register("documents", d.toArrow())
    con.register("labels", m.toArrow())
    assert sorted(con.sql(filteraudit.ORACLE_SQL).fetchall()) == want


def test_audit_edges(spark, tables):
    docs, labels = tables
    none, no_labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    m = spark.createDataFrame([(*r, 5, 6) for r in labels], LABELS)
    assert filteraudit.filter_audit(none, m).count() == 0
    d = spark.createDataFrame([(*r, 1, 2, "p", 3, 4) for r in docs], DOCS)
    assert {r["good_lost"] + r["toxic_lost"] for r in filteraudit.filter_audit(d, no_labels).collect()} == {0}
    long_words, long_run = " ".join(f"w{i}" for i in range(300_000)), "x" * 3_000_000
    long_docs = spark.createDataFrame([(1, long_words, "a"), (2, long_run, "a"), (3, long_words, "a")], "doc_id long, text string, source string")
    steps = {(r["filter_order"], r["step"]): r for r in filteraudit.filter_audit(long_docs, m).collect()}
    assert [steps["ABCDE", k]["removed"] for k in range(1, 6)] == [1, 0, 0, 0, 1]


def test_other_filters(spark, tables):
    docs, labels = tables
    d = spark.createDataFrame([(*r, 1, 2, "p", 3, 4) for r in docs], DOCS)
    m = spark.createDataFrame([(*r, 5, 6) for r in labels], LABELS)
    own = {"x": lambda text, words: text.startswith("a"), "y": filteraudit.REPEAT}
    rows = filteraudit.filter_audit(d, m, own).collect()
    assert {r["filter_order"] for r in rows} == {"xy", "yx"} and len(rows) == 3 * 4
    by_part = {}
    for r in rows:
        by_part.setdefault((r["part"], r["filter_order"]), []).append(r)
    for (part, _), steps in by_part.items():
        n = sum((s or "") == part for _, _, s in docs)
        assert min(s["kept"] for s in steps) + sum(s["removed"] for s in steps) == n
    with pytest.raises(ValueError):
        filteraudit.filter_audit(d, m, {"long": own["x"]})
    with pytest.raises(ValueError):
        filteraudit.orders("")


def test_a_text_of_many_rows_is_counted_before_it_meets(spark):
    """Copies of one text become one row for each cell before the window over the text."""
    d = spark.range(2000).selectExpr("id AS doc_id", "'same' AS text", "'s' AS source")
    m = spark.createDataFrame([], LABELS)
    counts = {r["mask"]: r["n"] for r in filteraudit.cells(filteraudit.masks(d, filteraudit.standard_filters()), m, filteraudit.standard_filters()).collect()}
    assert counts == {0b00001: 1, 0b10001: 1999}
