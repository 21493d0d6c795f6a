"""The pipeline against its stages by hand on a small table with planted cases."""

import random
import re

import pytest
from test_corpus import classes_by_hand, lines_by_hand, overlap_by_hand

from tributary.llm import minhash, packing, tokens

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SYLLABLES = "an be ca do en fi ga ho in ju ka lo ma ne on pa que re sa ti".split()


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(2, 4))) for _ in range(n))


def without_repeated_lines(rows):
    """Texts without the lines that have an earlier like; a text that loses all its lines with words goes."""
    gone, out = lines_by_hand(rows), []
    for d, t in rows:
        lines = t.split("\n")
        own = gone.get(d, set())
        if not own or own != {i for i, x in enumerate(lines) if re.search(r"[^\W_]", x)}:
            out.append((d, "\n".join(x for i, x in enumerate(lines) if i not in own)))
    return out


def test_pipeline_equals_its_stages_by_brute_force(spark, tmp_path):
    """From the documents of a known language on, every stage is done again by comparing everything with everything."""
    rng = random.Random(21)
    passage, long_lines = prose(rng, 25), [prose(rng, 200).split() for _ in range(6)]
    rows = [(i, "\n".join(prose(rng, 25) for _ in range(3)), "en" if i % 2 else "fr") for i in range(40)]
    for g, line in enumerate(long_lines):  # near copies that no two of which share a line, one of them with the passage
        for k in range(4):
            own = list(line)
            for at in rng.sample(range(0, 200, 20), 2 + k % 2):
                own[at] = prose(rng, 1)
            rows.append((1000 + 10 * k + g, " ".join(own) + (f"\n{passage} {g}" if k == 0 and g < 2 else ""), "en"))
    rows += [(500, f"{prose(rng, 30)} {passage}", "fr"), (501, rows[3][1] + "\n" + prose(rng, 20), "en"), (502, rows[4][1], "fr")]
    docs = spark.createDataFrame([(i, t, lang, f"s{i % 3}", len(t)) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    items = [(1, passage), (2, prose(rng, 12))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    now = stages["language_id"](spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path))
    want = sorted((r["doc_id"], r["text"]) for r in now.collect())
    assert len(want) >= len(rows) - 1
    want = without_repeated_lines(want)
    now = stages["line_dedup"](spark, now, str(tmp_path))
    assert sorted((r["doc_id"], r["text"]) for r in now.collect()) == want
    classes = classes_by_hand([t for _, t in want], minhash.shingle_weights(now))
    assert sum(c != i for i, c in enumerate(classes)) >= 10  # there is something to remove
    want = [r for i, r in enumerate(want) if classes[i] == i]
    now = stages["near_dedup"](spark, now, str(tmp_path))
    assert sorted((r["doc_id"], r["text"]) for r in now.collect()) == want
    want = [(d, t) for d, t in want if not overlap_by_hand(t, items)[-1]]
    encoder = tokens.Encoder(packing.default_tokenizer())
    sizes = {d: len(ids) + 1 for (d, _), ids in zip(want, encoder.encode([t for _, t in want]), strict=True)}
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert out.groupby("doc_id").length.sum().to_dict() == sizes == out.groupby("doc_id").doc_tokens.first().to_dict()
    assert (out.groupby("sequence_id").length.sum().sort_index().iloc[:-1] == 2048).all()


def test_pipeline(spark, tmp_path):
    rng = random.Random(12)
    passage, shared = prose(rng, 30), prose(rng, 60)
    rows = [(i, "\n".join(prose(rng, 25) for _ in range(4)), "en" if i % 2 else "fr", f"s{i % 3}") for i in range(60)]
    clean = {i for i, *_ in rows}
    rows += [(100, rows[7][1], "fr", "s0"), (101, "12345 !!!", "en", "s0"), (102, None, "en", "s0"), (103, f"{prose(rng, 20)} {passage} {prose(rng, 9)}", "en", "s1"), (104, f"{shared}\n{prose(rng, 30)}", "en", "s1"), (105, f"{prose(rng, 30)}\n{shared}", "en", "s1")]
    docs = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept, texts, now = {}, {}, spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
        found = now.collect()
        kept[name], texts[name] = {r["doc_id"] for r in found}, {r["doc_id"]: r["text"] for r in found}
    everything = {r[0] for r in rows}
    assert kept["language_id"] == everything - {101, 102}
    assert kept["line_dedup"] == kept["language_id"] - {100}
    assert shared in texts["line_dedup"][104] and shared not in texts["line_dedup"][105]
    assert kept["near_dedup"] == kept["line_dedup"]
    assert kept["decontamination"] == kept["near_dedup"] - {103}
    assert clean <= kept["decontamination"] and all(texts["decontamination"][i] == rows[i][1] for i in clean)
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(out.doc_id) == kept["decontamination"]
    full = out.groupby("sequence_id").length.sum()
    assert (full.iloc[:-1] == 2048).all()


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_texts_of_no_learned_language_go(spark, sf, tmp_path):
    """Junk with letters and a language that wasn't learned go; clean documents held out from training stay."""
    rng = random.Random(3)
    docs = spark.read.parquet(f"{sf.rsplit('/', 1)[0]}/sf0.01/documents.parquet")
    learned = docs.filter("lang <> 'fr'")
    junk = [" ".join("".join(rng.choice("bcdfghjklmnpqrstvwxyz") for _ in range(rng.randrange(3, 10))) for _ in range(n)) for n in (20, 100, 400)]
    junk += ['<div class="x"><span style="color:red"></span></div>' * 9, "Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему."]
    planted = spark.createDataFrame([(-1 - i, t, "en", "a", len(t)) for i, t in enumerate(junk)], "doc_id long, text string, lang string, source string, n_chars long")
    other = docs.filter("lang = 'fr' AND n_chars > 200").selectExpr("-1000 - doc_id AS doc_id", "text", "CAST(NULL AS string) AS lang", "source", "n_chars")
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, learned.unionByName(planted).unionByName(other), str(tmp_path)).collect()}
    assert not [i for i in kept if -1000 < i < 0]
    assert len([i for i in kept if i <= -1000]) <= 0.05 * other.count()
    assert len([i for i in kept if i >= 0]) >= 0.99 * learned.count()
