"""Filter interaction audit by long-form window evaluation.

What a filter removes depends on the filters before it.  Given the filters that each
document fails, as bits of a mask, the audit tells for every order of the filters
and every step what the step removes, what it finds already gone, what only its
filter would catch, and each filter's Shapley total over all orders.

1. One reading of the texts gives each document's mask (``masks``); texts go no further.
2. Documents are counted by cell: part, mask and labels (``cells``).  There are at most
   2^filters masks in a part, so all that follows is small however many documents there are.
3. Every cell meets every step of every order in long form, once each.  A running
   bit-or over the steps before (a window) tells whether an earlier filter has removed
   the cell; conditional sums count, and a window over all orders of a filter gives its
   total (``audit``).

Repeated texts are a filter too (``REPEAT``), one that needs the whole table: rows are
counted by checksum (SHA-256 of the text), cell and id, so a text that fills a third of
the table becomes a row for each id in parallel and then one for each cell; what meets in
one window are the cells of one text, never its copies.

Defined cases: null text is empty; null part is the empty string; a repeated row counts
each time, and as a row's like has no smaller id it is not a repeat of it; a row with a
null id is nobody's earlier copy and repeats nothing; an id labelled twice has a label
that any of its rows has; labels of null or unknown ids are ignored; an empty table gives no
rows; further columns of either table are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Blanks between words: the space and the control characters from tab to carriage return.
BLANKS = r"[\x20\x09-\x0D]+"
#: The filter on repeated texts, known by its name as it is no expression of one row.
REPEAT = "repeat"
#: More filters than this have too many orders to list.
MOST_FILTERS = 7
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_of(text: Column) -> Column:
    """Maximal runs of other characters than blanks."""
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def standard_filters() -> dict[str, object]:
    """The five filters of the audit, by letter.  Each is a function of (text, words) or ``REPEAT``."""
    return {
        "A": lambda text, words: F.size(words) < 50,
        "B": lambda text, words: F.size(F.array_distinct(words)).cast("long") * 100 < F.size(words).cast("long") * 65,
        "C": lambda text, words: (F.length(text) - F.length(F.translate(text, CAPITALS, ""))).cast("long") * 100 > F.length(text).cast("long") * 5,
        "D": lambda text, words: text.rlike("[#$%&*|]"),
        "E": REPEAT,
    }


def masks(docs: DataFrame, filters: Mapping[str, object], *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``id``, ``part``, ``sha`` and ``mask`` of each row: bit i is set where the row fails filter i.

    The bit of ``REPEAT`` is not set yet.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("id", "part", "text", words_of(F.col("text")).alias("words"))
    mask = F.lit(0)
    for i, test in enumerate(filters.values()):
        if test is not REPEAT:
            mask = mask.bitwiseOR(F.when(test(F.col("text"), F.col("words")), F.lit(1 << i)).otherwise(F.lit(0)))
    sha = F.unhex(F.sha2("text", 256)) if REPEAT in filters.values() else F.lit(None).cast("binary")
    return rows.select("id", "part", sha.alias("sha"), mask.alias("mask"))


def cells(marked: DataFrame, labels: DataFrame, filters: Mapping[str, object], *, id_col: str = "doc_id") -> DataFrame:
    """Counts by ``part`` and ``mask``: ``n`` documents, of them ``n_good`` and ``n_toxic``."""
    tags = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("tag_id"))
    tags = tags.agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic"))
    # counted by id and labels before anything else, on the join's own partitioning
    rows = marked.join(tags, F.col("id") == F.col("tag_id"), "left").fillna(False, ["good", "toxic"])
    rows = rows.groupBy("sha", "part", "mask", "good", "toxic", "id").agg(F.count("*").alias("n"))
    if REPEAT in filters.values():
        rows = _repeats(rows, 1 << list(filters.values()).index(REPEAT))
    return rows.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("n_good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("n_toxic")
    )


def _repeats(rows: DataFrame, bit: int) -> DataFrame:
    """Counts with the repeat bit set for rows whose text some smaller id has."""
    kinds = ["sha", "part", "mask", "good", "toxic"]
    # of each text and cell: all rows, rows without an id, and the rows of the least id
    by_cell = rows.groupBy(*kinds).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("n_no_id"),
        F.min("id").alias("least"),
        F.min_by("n", "id").alias("n_least"),
    )
    first = F.min("least").over(Window.partitionBy("sha"))
    fresh = F.col("n_no_id") + F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0)
    split = by_cell.withColumn("first", first).withColumn("fresh", fresh)
    both = F.array(F.struct(F.col("mask"), F.col("fresh").alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(bit)).alias("mask"), (F.col("n") - F.col("fresh")).alias("n")))
    return split.select("part", "good", "toxic", F.inline(both)).filter("n > 0")


def orders(names: str) -> Column:
    """A row for every order of the filters, each a word of their letters."""
    if not 1 <= len(names) <= MOST_FILTERS or len(set(names)) < len(names):
        raise ValueError(f"1 to {MOST_FILTERS} filters of different names, not {names!r}")
    return F.explode(F.array(*[F.lit("".join(p)) for p in permutations(names)]))


def audit(counts: DataFrame, names: str) -> DataFrame:
    """Metrics by part, order and step from the counts of ``cells``; ``names`` has a letter for each bit."""
    long_form = counts.select("*", orders(names).alias("filter_order"))
    long_form = long_form.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(names)))).alias("step"))
    long_form = long_form.withColumn("letter", F.substring("filter_order", F.col("step"), F.lit(1)))
    bits = F.create_map(*[F.lit(v) for i, name in enumerate(names) for v in (name, 1 << i)])
    long_form = long_form.withColumn("bit", bits[F.col("letter")])
    own = F.col("mask").bitwiseAND(F.col("bit"))
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    long_form = long_form.withColumn("own", own).withColumn("earlier", F.coalesce(F.bit_or("own").over(before), F.lit(0)))

    fails, gone = F.col("own") != 0, F.col("earlier") != 0

    def total(where: Column, what: str = "n") -> Column:
        return F.sum(F.when(where, F.col(what)).otherwise(0)).cast("long")

    by_step = long_form.groupBy("part", "filter_order", "step", "letter").agg(
        total(~fails & ~gone).alias("kept"),
        total(fails & ~gone).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(fails & ~gone, "n_good").alias("good_lost"),
        total(fails & ~gone, "n_toxic").alias("toxic_lost"),
    )
    return by_step.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")


def filter_audit(docs: DataFrame, labels: DataFrame, filters: Mapping[str, object] | None = None, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The audit of ``filters`` (default: the standard five) over all of ``docs``, part by part."""
    filters = standard_filters() if filters is None else filters
    if any(len(name) != 1 for name in filters):
        raise ValueError("a filter's name is one letter")
    marked = masks(docs, filters, id_col=id_col, text_col=text_col, part_col=part_col)
    return audit(cells(marked, labels, filters, id_col=id_col), "".join(filters))


#: The same by joins and self-joins over documents, without cells or windows of steps.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
first AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT w.doc_id, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        [len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words),
         100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
         regexp_matches(t, '[#$%&*|]'), coalesce(w.doc_id > first.first, false)] AS fails
      FROM w JOIN first USING (t) LEFT JOIN l ON l.doc_id = w.doc_id),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM f GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e
           WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT o, step, ascii(o[step]) - 64 AS own, list_transform(range(1, step), lambda k: ascii(o[k]) - 64) AS before
      FROM orders, range(1, 6) r(step)),
m AS (SELECT part, o, step, own, n, n_good, n_toxic, fails[own] AS fail, len(list_filter(before, lambda k: fails[k])) > 0 AS gone,
             len(list_filter(fails, lambda x: x)) AS n_fails FROM g, s),
r AS (SELECT part, o AS filter_order, step::INT AS step, own,
        coalesce(sum(n) FILTER (NOT fail AND NOT gone), 0)::BIGINT AS kept,
        coalesce(sum(n) FILTER (fail AND NOT gone), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (fail AND gone), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (fail AND n_fails = 1), 0)::BIGINT AS unique_fails,
        coalesce(sum(n_good) FILTER (fail AND NOT gone), 0)::BIGINT AS good_lost,
        coalesce(sum(n_toxic) FILTER (fail AND NOT gone), 0)::BIGINT AS toxic_lost
      FROM m GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley
FROM r JOIN (SELECT part, own, sum(removed)::BIGINT AS shapley FROM r GROUP BY ALL) USING (part, own)
"""
