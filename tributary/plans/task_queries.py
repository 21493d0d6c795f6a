"""Queries over tasks, splits, checks and seed batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.functions import scalars
from tributary.operators import checks, keys, seeds, splits, stats
from tributary.plans.fixture import Registry, database, table

REGISTRY = Registry()


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


_PAIRS = [("labels", "doc_id", "documents", "doc_id"), ("events", "user_id", "customer", "c_custkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey")]


@REGISTRY.add(" UNION ALL ".join(f"SELECT '{c}' AS child, '{k}' AS fk, '{p}' AS parent, count(*) AS n FROM {c} LEFT JOIN (SELECT DISTINCT {o} AS __k FROM {p}) ON {k} = __k WHERE {k} IS NOT NULL AND __k IS NULL" for c, k, p, o in _PAIRS))
def fk_violations(spark, sf_dir):
    db = database(spark, sf_dir, ["documents", "labels", "events", "customer", "orders", "lineitem"])
    return checks.violations(db)


@REGISTRY.add("SELECT e.event_id, e.user_id FROM events e LEFT JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING') c ON user_id = c_custkey WHERE user_id IS NOT NULL AND c_custkey IS NULL")
def orphan_entities(spark, sf_dir):
    """Events of customers that a narrower entity table does not have."""
    customers = table(spark, sf_dir, "customer").filter("c_mktsegment <> 'BUILDING'")
    return keys.orphans(table(spark, sf_dir, "events"), ["user_id"], customers, ["c_custkey"]).select("event_id", "user_id")


@REGISTRY.add("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return keys.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


_NULLS = {"customer": "c_custkey", "orders": "o_custkey", "lineitem": "l_orderkey", "events": "user_id", "documents": "lang", "labels": "quality"}


@REGISTRY.add(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", '{k}' AS key, count(*) FILTER ({k} IS NULL) AS n FROM {t}" for t, k in _NULLS.items()))
def null_keys(spark, sf_dir):
    return _union([keys.null_keys(table(spark, sf_dir, t), [k]).agg(F.count("*").alias("n")).select(F.lit(t).alias("table"), F.lit(k).alias("key"), "n") for t, k in _NULLS.items()])


@REGISTRY.add("""SELECT event_id, ts, CASE WHEN ts >= (SELECT min(ts) FROM (SELECT ts FROM events ORDER BY ts DESC, event_id LIMIT (SELECT greatest(1, least(CAST(ceil(count(*) * 0.2) AS BIGINT), count(*) - 1)) FROM events))) THEN 'validation' ELSE 'train' END AS split FROM events""")
def default_time_split(spark, sf_dir):
    return splits.default_split(table(spark, sf_dir, "events").select("event_id", "ts"), ["event_id"], time="ts")


_HASH_SPLIT = """SELECT doc_id, {cols} CASE WHEN quality IS NULL THEN 'test' WHEN row_number() OVER (PARTITION BY quality IS NULL ORDER BY md5(concat_ws('|', '42', CAST(doc_id AS string))), doc_id) <= (SELECT greatest(1, least(CAST(ceil(count(quality) * 0.2) AS BIGINT), count(quality) - 1)) FROM {t}) THEN 'validation' ELSE 'train' END AS split FROM {t}"""


@REGISTRY.add(_HASH_SPLIT.format(cols="quality,", t="labels"))
def default_hash_split(spark, sf_dir):
    return splits.default_split(table(spark, sf_dir, "labels").select("doc_id", "quality"), ["doc_id"], label="quality")


_FOLD = "CASE WHEN doc_id % 10 < 7 THEN 'a' WHEN doc_id % 10 < 9 THEN 'b' ELSE 'c' END"


@REGISTRY.add(f"SELECT split, count(*) AS n, sum(CAST(quality AS BIGINT))::BIGINT AS n_good FROM (SELECT quality, CASE {_FOLD} WHEN 'a' THEN 'train' WHEN 'b' THEN 'validation' ELSE 'test' END AS split FROM labels) GROUP BY split")
def column_split(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").withColumn("fold", F.expr(_FOLD))
    out = splits.column_split(rows, "fold", {"train": "a", "validation": "b", "test": "c"})
    return out.groupBy("split").agg(F.count("*").alias("n"), F.sum(F.col("quality").cast("bigint")).alias("n_good"))


@REGISTRY.add(f"""WITH rest AS (SELECT * FROM labels WHERE toxic = 0), own AS ({_HASH_SPLIT.format(cols="", t="rest")})
SELECT doc_id, split FROM own UNION ALL SELECT doc_id, 'test' FROM labels WHERE toxic = 1""")
def sql_query_split_test_only(spark, sf_dir):
    """Test rows by a query, the rest by default."""
    rows = table(spark, sf_dir, "labels")
    return splits.query_split(rows, ["doc_id"], {"test": rows.filter("toxic = 1").select("doc_id")}, label="quality").select("doc_id", "split")


_THREE = {"train": "quality = 1 AND toxic = 0", "validation": "quality = 0", "test": "quality = 0 AND toxic = 0"}


@REGISTRY.add("""WITH m AS (SELECT doc_id, CAST(quality = 1 AND toxic = 0 AS INT) + CAST(quality = 0 AS INT) + CAST(quality = 0 AND toxic = 0 AS INT) AS k FROM labels)
SELECT p.problem, count(m.doc_id) AS n FROM (VALUES ('ok'), ('overlap'), ('uncovered'), ('unknown')) AS p(problem)
LEFT JOIN m ON p.problem = CASE k WHEN 0 THEN 'uncovered' WHEN 1 THEN 'ok' ELSE 'overlap' END GROUP BY p.problem""")
def split_overlap_report(spark, sf_dir):
    rows = table(spark, sf_dir, "labels")
    return splits.overlap_report(rows, ["doc_id"], {k: rows.filter(w) for k, w in _THREE.items()})


_SPLIT_BY = "CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 9 THEN 'validation' ELSE 'test' END"


@REGISTRY.add(f"""WITH r AS (SELECT {_SPLIT_BY} AS split, quality * 2 + toxic AS label FROM labels)
SELECT split, count(*) AS n, count(label) AS n_labelled, count(DISTINCT label) AS n_classes, count(DISTINCT label) FILTER (label NOT IN (SELECT label FROM r WHERE split = 'train')) AS n_unseen FROM r GROUP BY split""")
def label_domain_check(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select(F.expr(_SPLIT_BY).alias("split"), F.expr("quality * 2 + toxic").alias("label"))
    return checks.label_report(rows, "label")


@REGISTRY.add("SELECT count(*) AS n_rows, (SELECT max(quality) + 1 FROM labels) AS classes_quality, (SELECT max(toxic) + 1 FROM labels) AS classes_toxic FROM labels")
def class_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "labels")
    found = (rows.count(), seeds.class_count(rows, "quality"), seeds.class_count(rows, "toxic"))
    return spark.createDataFrame([found], "n_rows bigint, classes_quality int, classes_toxic int")


_VERSIONS = {"doc_id % 4 = 0": ("' Yes '", "' No '"), "doc_id % 4 = 1": ("'T'", "'f'"), "doc_id % 4 = 2": ("'1'", "'0'")}
_SPELLED = "CASE " + " ".join(f"WHEN {w} THEN CASE WHEN toxic = 1 THEN {a} ELSE {b} END" for w, (a, b) in _VERSIONS.items()) + " ELSE CASE WHEN toxic = 1 THEN 'TRUE' ELSE 'maybe' END END"


@REGISTRY.add(f"SELECT doc_id, CASE WHEN lower(trim(s)) IN ('t', 'true', '1', 'yes') THEN 1.0::DOUBLE WHEN lower(trim(s)) IN ('f', 'false', '0', 'no') THEN 0.0::DOUBLE END AS label FROM (SELECT doc_id, {_SPELLED} AS s FROM labels)")
def binary_label_parse(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", F.expr(_SPELLED).alias("s"))
    return rows.select("doc_id", scalars.binary_label("s", strict=False).alias("label"))


def _epoch_sql(t: str, key: str, epoch: int, batch: int, block: int) -> str:
    return f"""SELECT {epoch}::BIGINT AS epoch, CAST(first + place // {batch} AS BIGINT) AS batch, place % {batch} AS pos, key FROM (
  SELECT {key} AS key, {key} // {block} AS block, row_number() OVER (PARTITION BY {key} // {block} ORDER BY md5(concat_ws('|', '42', '{epoch}', CAST({key} AS string))), {key}) - 1 AS place FROM {t})
JOIN (SELECT block, CAST(sum(batches) OVER (ORDER BY md5(concat_ws('|', '42', '{epoch}', CAST(block AS string))), block) - batches AS BIGINT) AS first
  FROM (SELECT {key} // {block} AS block, CAST(ceil(count(*) / {batch}.0) AS BIGINT) AS batches FROM {t} GROUP BY 1)) USING (block)"""


@REGISTRY.add(_epoch_sql("orders", "o_orderkey", 0, 512, 4096))
def seed_epoch_order(spark, sf_dir):
    return seeds.epoch_order(table(spark, sf_dir, "orders"), "o_orderkey", epoch=0, batch_size=512)


@REGISTRY.add(f"""WITH e AS ({_epoch_sql("labels", "doc_id", 0, 32, 256)} UNION ALL {_epoch_sql("labels", "doc_id", 1, 32, 256)}), s AS (SELECT epoch, batch, count(*) AS n FROM e GROUP BY ALL)
SELECT epoch, count(*) AS n_rows, count(DISTINCT key) AS n_distinct, count(DISTINCT batch) AS n_batches, (SELECT max(n) FROM s WHERE s.epoch = e.epoch) AS largest FROM e GROUP BY epoch""")
def seed_epoch_coverage(spark, sf_dir):
    """Every row once in each of two epochs."""
    return seeds.coverage(seeds.epochs(table(spark, sf_dir, "labels"), "doc_id", 2, batch_size=32, block_rows=256))


@REGISTRY.add("""SELECT 'left' AS side, CAST(count(*) AS BIGINT) AS n FROM labels WHERE toxic = 1 UNION ALL SELECT 'value', count(*) FROM labels WHERE toxic = 0 AND quality = 0""")
def run_differences(spark, sf_dir):
    """Rows missing on one side, and values that differ by more than the tolerance."""
    labels = table(spark, sf_dir, "labels").withColumn("x", F.col("quality").cast("double"))
    left = labels.select("doc_id", "x")
    right = labels.filter("toxic = 0").select("doc_id", (F.col("x") + F.when(F.col("quality") == 0, 1e-3).otherwise(1e-9)).alias("x"))
    found = checks.differences(left, right, ["doc_id"])
    # a missing row differs in its value as well; it counts once
    one = found.groupBy("doc_id").agg(F.max(F.col("column") == "missing").alias("missing"))
    n = one.groupBy(F.when(F.col("missing"), "left").otherwise("value").alias("side")).agg(F.count("*").alias("n"))
    return spark.createDataFrame([("left",), ("value",)], "side string").join(n, "side", "left").select("side", F.coalesce("n", F.lit(0)).alias("n"))


# ---- parts of the checks, one by one


@REGISTRY.add("SELECT 'documents' AS \"table\", c AS \"column\", n AS n_set FROM (SELECT unnest(['doc_id', 'text', 'lang', 'source', 'n_chars']) AS c, unnest([count(doc_id), count(text), count(lang), count(source), count(n_chars)]) AS n FROM documents)")
def column_fill_counts(spark, sf_dir):
    return stats.fill_counts(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"), "documents")


@REGISTRY.add("SELECT (SELECT count(*) FROM (SELECT user_id, event_type FROM events GROUP BY ALL HAVING count(*) > 1)) AS n_duplicate, (SELECT count(*) FROM events WHERE user_id IS NULL OR event_type IS NULL) AS n_null")
def sample_key_problems(spark, sf_dir):
    return checks.key_problems(table(spark, sf_dir, "events"), ["user_id", "event_type"])


@REGISTRY.add("SELECT event_id FROM events WHERE event_id % 7 = 0 OR event_id % 11 = 3")
def unreadable_prediction_times(spark, sf_dir):
    """Times as text, some of them none and some of them missing."""
    text = F.when(F.col("event_id") % 7 == 0, "some day").when(F.col("event_id") % 11 == 3, None).otherwise(F.col("ts").cast("string"))
    return checks.bad_times(table(spark, sf_dir, "events").select("event_id", text.alias("at")), "at").select("event_id")


@REGISTRY.add("SELECT event_id, epoch_us(ts)::BIGINT AS micros, epoch_us(ts)::BIGINT - 3600000000 AS micros_from_berlin FROM events")
def iso_times_round_trip(spark, sf_dir):
    """Times written as ISO text and read back; and read as wall times of a zone (an hour ahead in January)."""
    rows = table(spark, sf_dir, "events").select("event_id", scalars.iso("ts").alias("at"))
    back = scalars.parse_time("at")
    return rows.select("event_id", F.unix_micros(back.cast("timestamp")).alias("micros"), F.unix_micros(scalars.utc(back.cast("timestamp"), "Europe/Berlin")).alias("micros_from_berlin"))


@REGISTRY.add("SELECT event_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01'))::BIGINT * 1000 AS stored, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01'))::BIGINT AS micros FROM events")
def interval_encoding_round_trip(spark, sf_dir):
    """Spans of time kept as whole nanoseconds."""
    span = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) * 1000
    rows = table(spark, sf_dir, "events").select("event_id", scalars.encode_value("timedelta_ns", span).alias("stored"))
    return rows.select("event_id", "stored", F.call_function("div", scalars.decode_value("timedelta_ns", "stored", "bigint"), F.lit(1000)).alias("micros"))


@REGISTRY.add("SELECT doc_id, CAST(quality AS DOUBLE) AS binary_target, CAST(quality AS BIGINT) AS class_target, CAST(quality AS DOUBLE) AS number_target FROM labels WHERE quality IS NOT NULL")
def target_values(spark, sf_dir):
    """A label in the type that each kind of task trains on."""
    rows = table(spark, sf_dir, "labels").filter("quality IS NOT NULL").select("doc_id", F.when(F.col("quality") == 1, " Yes").otherwise("F ").alias("binary_target"), F.col("quality").cast("string").alias("class_target"), F.col("quality").cast("string").alias("number_target"))
    for column, kind in (("binary_target", "binary_classification"), ("class_target", "multiclass_classification"), ("number_target", "regression")):
        rows = seeds.target_value(rows, column, kind)
    return rows.withColumn("binary_target", F.col("binary_target").cast("double"))


@REGISTRY.add("SELECT DISTINCT l_partkey AS item FROM lineitem WHERE l_partkey % 5 = 0")
def unknown_destinations(spark, sf_dir):
    """Parts in the lists of what was ordered together that the destination table lacks."""
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("parts"))
    return checks.unknown_destinations(lists, "parts", table(spark, sf_dir, "part").filter("p_partkey % 5 <> 0"), "p_partkey")
