"""Line deduplication over a whole corpus by a deletion-neighbourhood join.

Lines are compared by their words (lower case, marks dropped; characters of scripts
that leave no blanks are words each).  Two lines are alike if they have the same words,
or, from ``MIN_WORDS`` words on, if one word was put in, taken out or replaced (likes
then share four fifths of their words; below, one word may be all that matters).  The
earliest line (by document id, then line number) stays; a line with an earlier like goes.

Only DataFrame functions are used.  Equal lines are folded first.  Lines alike
but not equal share the first or the second half of their words, so only lines
that share a half with another one go on; nothing is lost by that.  Each of those
emits its variants with one word deleted, as hashed keys: once with the place of
the word (lines with a word replaced meet there, and any two that meet are
alike), once without it (a longer line meets the shorter one, which emits
itself).  A group of equal keys is therefore a star about its earliest line or
about the shorter line, so each group needs only two minima, never its pairs.
Each line's earliest like is then verified word by word.

Variant keys come from sums of word hashes before and after the deleted word, so
a line of n words costs n rows, not n squared.

Defined cases: null texts stay null; lines without a word (blank, or marks only) always
stay; null ids count as earliest; rows with equal id and text are one document given
repeatedly and share one result; a document that lost lines and has none with a word
left is dropped; further columns are carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release

MIN_WORDS = 5
_BITS = 40
#: Kinds of keys: a word replaced at a place; a longer line less one word; the shorter line as it is.
REPLACED, LONGER, ITSELF = 0, 1, 2


def normalized(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "))


def spaced(norm: Column) -> Column:
    """A normalised line with blanks around each character of the scripts that have none between words."""
    scripts = r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}])"

    def apart(x: Column) -> Column:
        # such a character has three bytes and none stands below U+0E00, so most lines are told apart without looking up scripts
        wide = (F.octet_length(x) - F.char_length(x) >= 2) & x.rlike(r"[^\x{0}-\x{DFF}]")
        return F.when(wide, F.trim(F.regexp_replace(F.regexp_replace(x, scripts, " $1 "), " +", " "))).otherwise(x)

    # by way of an array, so that the line is normalised once
    return F.transform(F.array(norm), apart)[0]


def _half(second: bool, m: Column) -> Column:
    """Hash of the first m // 2 words, or of the last m - m // 2."""
    h = F.floor(m / 2).cast("int")
    words = F.call_function("substring_index", F.col("norm"), F.lit(" "), h - m.cast("int") if second else h)
    return F.xxhash64(F.lit(int(second)), m.cast("int"), words)


def line_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, hash of text, line number, normalised line and its number of words, of every line."""
    lines = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "line"))
    lines = lines.select("id", "th", "line_no", normalized(F.col("line")).alias("norm")).withColumn("norm", spaced(F.col("norm")))
    blanks = F.octet_length("norm") - F.octet_length(F.replace("norm", F.lit(" "), F.lit("")))
    return lines.withColumn("n", F.when(F.col("norm") == "", 0).otherwise(blanks + 1))


def _line_hash() -> list[Column]:
    return [F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit(7), F.col("norm")).alias("h2")]


def _word_hash(place: Column) -> list[Column]:
    """Two hashes of a word at a place, short enough to be added up."""
    return [F.pmod(F.xxhash64(F.lit(s), F.col("word"), place), F.lit(1 << _BITS)) for s in (1, 2)]


def _variants(lines: DataFrame) -> DataFrame:
    """(lid, key, kind) for every line: its variants with one word less, twice, and the line itself."""
    words = lines.select("lid", "n", F.posexplode(F.split("norm", " ")).alias("i", "word"))
    here, left = _word_hash(F.col("i")), _word_hash(F.col("i") - 1)
    words = words.select("lid", "n", "i", here[0].alias("a1"), here[1].alias("a2"), left[0].alias("b1"), left[1].alias("b2"))
    line = Window.partitionBy("lid")
    before = line.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = line.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    v = [F.sum(f"a{k}").over(before) - F.col(f"a{k}") + F.sum(f"b{k}").over(total) - F.sum(f"b{k}").over(before) for k in (1, 2)]
    own = [F.sum(f"a{k}").over(total) for k in (1, 2)]
    words = words.select("lid", "n", "i", v[0].alias("v1"), v[1].alias("v2"), own[0].alias("t1"), own[1].alias("t2"))
    replaced = F.struct(F.xxhash64(F.lit(0), "v1", "v2", "i").alias("key"), F.lit(REPLACED).alias("kind"))
    longer = F.struct(F.xxhash64(F.lit(1), "v1", "v2", F.col("n") - 1).alias("key"), F.lit(LONGER).alias("kind"))
    itself = F.struct(F.xxhash64(F.lit(1), "t1", "t2", F.col("n")).alias("key"), F.lit(ITSELF).alias("kind"))
    emitted = F.when(F.col("i") == 0, F.array(replaced, longer, itself)).otherwise(F.array(replaced, longer))
    return words.select("lid", F.explode(emitted).alias("e")).select("lid", "e.key", "e.kind")


def _alike(a: Column, b: Column) -> Column:
    """Whether two arrays of words differ by one word put in, taken out or replaced."""
    m = F.least(F.size(a), F.size(b))
    gap = F.abs(F.size(a) - F.size(b))

    def equal_run(x: Column, y: Column) -> Column:
        # length of the common start: place of the first difference, or all of it
        differ = F.array_position(F.zip_with(F.slice(x, F.lit(1), m), F.slice(y, F.lit(1), m), lambda p, q: p != q), F.lit(True))
        return F.when(differ == 0, m.cast("long")).otherwise(differ - 1)

    return (gap <= 1) & (equal_run(a, b) + equal_run(F.reverse(a), F.reverse(b)) >= F.greatest(F.size(a), F.size(b)) - 1)


def removals(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, th, gone), a written table: for each document that loses lines, their numbers."""
    spark = docs.sparkSession
    m = F.col("n")
    halves = [F.when(m >= min_words, _half(second, x)).alias(f"k{second:d}{j}") for second in (False, True) for j, x in enumerate((m, m - 1))]
    keys = [f"k{s}{j}" for s in (0, 1) for j in (0, 1)]
    # lines without words are left out only when read again: a filter here would normalise every line twice
    table = materialize(line_table(docs, id_col, text_col).select("id", "th", "line_no", "n", *_line_hash(), *halves), "lines")
    lines = table.filter("n > 0")
    first = F.min(F.struct("id", "th", "line_no")).alias("first")
    distinct = materialize(lines.groupBy("h1", "h2").agg(first, F.count("*").alias("times"), *[F.max(k).alias(k) for k in keys]), "lines-distinct")
    release(spark)

    halves = distinct.filter("k00 IS NOT NULL").select("h1", "h2", F.explode(F.array(*keys)).alias("k"))
    shared = materialize(halves.groupBy("k").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).filter("a <> b").select("k"), "lines-halves")
    maybe = halves.join(shared, "k", "left_semi").select("h1", "h2").distinct()
    maybe = materialize(maybe.join(distinct.select("h1", "h2", "first"), ["h1", "h2"]), "lines-maybe")
    release(spark, shared)

    # the words of those lines, from where each stands first; lid follows the order of first standing
    wanted = maybe.groupBy(F.col("first.id").alias("__id"), F.col("first.th").alias("__th")).agg(F.collect_list(F.struct("first.line_no", "h1", "h2")).alias("wanted"))
    text = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    text = text.join(wanted, text["id"].eqNullSafe(wanted["__id"]) & (text["th"] == wanted["__th"]))
    picked = F.transform(F.array(F.split("text", "\n")), lambda lines: F.transform("wanted", lambda w: F.struct(w["h1"].alias("h1"), w["h2"].alias("h2"), w["line_no"].alias("line_no"), F.get(lines, w["line_no"]).alias("line"))))[0]
    found = text.select("id", "th", F.inline(picked)).select("h1", "h2", "id", "th", "line_no", normalized(F.col("line")).alias("norm"))
    found = found.withColumn("norm", spaced(F.col("norm"))).withColumn("n", F.size(F.split("norm", " ")))
    found = found.dropDuplicates(["h1", "h2"])
    order = ["id", "th", "line_no", "h1", "h2"]
    likely = materialize(found.repartitionByRange(*order).sortWithinPartitions(*order).select(F.monotonically_increasing_id().alias("lid"), "h1", "h2", "norm", "n"), "lines-likely")
    release(spark, maybe)

    variants = materialize(_variants(likely), "lines-variants")
    least = [F.min(F.when(F.col("kind") == k, F.col("lid"))).alias(f"m{k}") for k in (REPLACED, LONGER, ITSELF)]
    groups = variants.groupBy("key").agg(*least, F.max("lid").alias("last"))
    groups = materialize(groups.filter("m0 < last OR (m1 IS NOT NULL AND m2 IS NOT NULL)").drop("last"), "lines-groups")
    # a line with a word replaced meets the earliest such line; a longer line the shorter one, and the other way round
    to = F.when(F.col("kind") == REPLACED, F.col("m0")).when(F.col("kind") == LONGER, F.col("m2")).otherwise(F.col("m1"))
    links = variants.join(groups, "key").select("lid", to.alias("to")).filter("to < lid")
    best = materialize(links.groupBy("lid").agg(F.min("to").alias("to")), "lines-links")
    release(spark, variants, groups)

    words = likely.select("lid", "h1", "h2", "norm")
    pairs = best.join(words, "lid").join(likely.select(F.col("lid").alias("to"), F.col("norm").alias("earlier")), "to")
    near = pairs.filter(_alike(F.split("norm", " "), F.split("earlier", " "))).select("h1", "h2", F.lit(True).alias("near"))
    known = distinct.select("h1", "h2", "first", "times").join(near, ["h1", "h2"], "left")
    known = materialize(known.filter("times > 1 OR near").select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near")), "lines-known")
    release(spark, distinct, likely, best)

    stands = lines.select("id", "th", "line_no", "h1", "h2").join(known, ["h1", "h2"])
    gone = stands.filter(F.col("near") | ~F.struct("id", "th", "line_no").eqNullSafe(F.col("first")))
    out = materialize(gone.groupBy("id", "th").agg(F.collect_set("line_no").alias("gone")), "lines-gone")
    release(spark, table, known)
    return out


def cleaned(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with ``text_col`` cleaned, ``__gone`` (numbers of lines removed, null if none)
    and ``__keep`` (whether a line with a word is left)."""
    gone = removals(docs, id_col=id_col, text_col=text_col, min_words=min_words)
    own = gone.select(F.col("id").alias("__id"), F.col("th").alias("__th"), F.col("gone").alias("__gone"))
    joined = docs.join(own, docs[id_col].eqNullSafe(own["__id"]) & (F.xxhash64(docs[text_col]) == own["__th"]), "left")
    kept = F.transform(
        F.array(F.split(F.col(text_col), "\n")),
        lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone")), lambda i: F.get(lines, i)),
    )[0]
    joined = joined.withColumn("__lines", F.when(F.col("__gone").isNotNull(), kept))
    some = F.exists("__lines", lambda x: x.rlike(r"[\p{L}\p{N}]"))
    text = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join("__lines", "\n"))
    return joined.withColumn("__keep", F.col("__gone").isNull() | some).withColumn(text_col, text).drop("__id", "__th", "__lines")


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without lines that have an earlier like, and without documents nothing is left of."""
    return cleaned(docs, id_col=id_col, text_col=text_col, min_words=min_words).filter("__keep").select(*docs.columns)


def line_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document: n_lines, n_removed, kept, and the text that is left."""
    out = cleaned(docs.select(id_col, text_col, F.size(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("n_lines")), id_col=id_col, text_col=text_col, min_words=min_words)
    return out.select(id_col, F.col("n_lines").cast("long").alias("n_lines"), F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"), F.col("__keep").alias("kept"), F.when(F.col("__keep"), F.col(text_col)).otherwise(F.lit("")).alias("text"))
