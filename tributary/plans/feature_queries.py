"""Queries over statistics, vocabularies, encodings, gathers and texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.functions import scalars, text
from tributary.operators import checks, features, graph, metrics, processors, sampling, stats
from tributary.plans.fixture import Registry, database, table
from tributary.session import together
from tributary.sources.catalog import Task

REGISTRY = Registry()


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


_NUMERIC = {"lineitem": ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "orders": ["o_totalprice"], "events": ["value"], "part": ["p_size", "p_retailprice"]}


def _stats_sql(t: str, c: str, x: str | None = None) -> str:
    x = x or f"CAST({c} AS DOUBLE)"
    q = ", ".join(f"round(quantile_cont(x, {s}), 6) AS q{int(100 * s)}" for s in stats.QUANTILES)
    return f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", count(x) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, {q} FROM (SELECT {x} AS x FROM {t})"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("table", "column", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "q0", "q25", "q50", "q75", "q100")])


@REGISTRY.add(" UNION ALL ".join(_stats_sql(t, c) for t, cs in _NUMERIC.items() for c in cs))
def numeric_stats(spark, sf_dir):
    return _rounded(_union(together(lambda t: stats.numeric_stats(table(spark, sf_dir, t), _NUMERIC[t]).withColumn("table", F.lit(t)), _NUMERIC)))


_DIRTY = "CASE WHEN event_id % 11 = 0 THEN 'bad' WHEN event_id % 13 = 0 THEN 'Infinity' WHEN event_id % 17 = 0 THEN NULL ELSE CAST(value AS string) END"


@REGISTRY.add(_stats_sql("events", "dirty", f"CASE WHEN isfinite(TRY_CAST({_DIRTY} AS DOUBLE)) THEN TRY_CAST({_DIRTY} AS DOUBLE) END"))
def numeric_stats_dirty_text(spark, sf_dir):
    """Statistics of text with words and infinities among its numbers."""
    rows = table(spark, sf_dir, "events").select(F.expr(_DIRTY).alias("dirty"))
    return _rounded(stats.numeric_stats(rows, ["dirty"]).withColumn("table", F.lit("events")))


_CATEGORIES = [("part", "p_brand"), ("part", "p_type"), ("lineitem", "l_returnflag"), ("lineitem", "l_linestatus"), ("events", "event_type")]


def _vocabulary_sql(t: str, c: str) -> str:
    return f"SELECT '{c}' AS \"column\", value, n, row_number() OVER (ORDER BY n DESC, value) - 1 AS idx FROM (SELECT CAST({c} AS string) AS value, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY 1)"


@REGISTRY.add(" UNION ALL ".join(_vocabulary_sql(*x) for x in _CATEGORIES))
def category_vocabulary(spark, sf_dir):
    """Vocabularies of several tables, one scan of each."""
    columns = {}
    for t, c in _CATEGORIES:
        columns.setdefault(t, {})[c] = False
    return _union(together(lambda t: stats.vocabularies(table(spark, sf_dir, t), columns[t]), columns))


@REGISTRY.add(_vocabulary_sql("(SELECT unnest(string_split(p_type, ' ')) AS p_type FROM part)", "p_type"))
def multicategory_vocabulary(spark, sf_dir):
    return stats.element_vocabulary(table(spark, sf_dir, "part"), "p_type", " ")


def _time_sql(t: str, c: str) -> str:
    return f"SELECT '{c}' AS \"column\", count({c}) AS n, CAST(year(min({c})) AS INT) AS min_year, CAST(year(max({c})) AS INT) AS max_year, min({c}) AS oldest, (SELECT {c} FROM {t} WHERE {c} IS NOT NULL ORDER BY {c} LIMIT 1 OFFSET (SELECT count({c}) // 2 FROM {t})) AS median, max({c}) AS newest FROM {t}"


@REGISTRY.add(" UNION ALL ".join(_time_sql(t, c) for t, c in (("orders", "o_orderdate"), ("events", "ts"), ("lineitem", "l_shipdate"))))
def timestamp_order_stats(spark, sf_dir):
    columns = {"orders": "o_orderdate", "events": "ts", "lineitem": "l_shipdate"}
    return _union(together(lambda t: stats.time_stats(table(spark, sf_dir, t), columns[t]), columns))


@REGISTRY.add("SELECT o_orderkey, epoch_us(o_orderdate) // 1000000 AS seconds, year(o_orderdate)::INT AS year, month(o_orderdate)::INT - 1 AS month, day(o_orderdate)::INT - 1 AS day, isodow(o_orderdate)::INT - 1 AS weekday, hour(o_orderdate)::INT AS hour, minute(o_orderdate)::INT AS minute, second(o_orderdate)::INT AS second FROM orders")
def timestamp_components(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.seconds("o_orderdate").alias("seconds"), *[c.alias(n) for n, c in scalars.time_parts("o_orderdate")])


@REGISTRY.add(f"""WITH v AS ({_vocabulary_sql("(SELECT p_type FROM part WHERE p_size < 12)", "p_type")})
SELECT p_partkey, coalesce(idx, -1) AS idx FROM part LEFT JOIN v ON value = p_type WHERE p_size >= 12""")
def category_encode_with_unknown(spark, sf_dir):
    """Train vocabulary on validation rows; values it does not have get -1."""
    part = table(spark, sf_dir, "part")
    v = stats.vocabulary(part.filter("p_size < 12"), "p_type")
    return features.encode_category(part.filter("p_size >= 12"), "p_type", v, "idx").select("p_partkey", "idx")


@REGISTRY.add("SELECT CAST(0 AS BIGINT) AS n_bad, count(DISTINCT p_brand) AS n_values FROM part")
def category_range_check(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    v = stats.vocabulary(part, "p_brand")
    n = v.count()
    encoded = features.encode_category(part, "p_brand", v, "idx")
    return checks.out_of_range(encoded, "idx", n).agg(F.count("*").alias("n_bad")).withColumn("n_values", F.lit(n).cast("bigint"))


_REQUESTS = "SELECT l_orderkey AS node_id, l_orderkey * 100000 + l_linenumber * 1000 + l_suppkey AS pos FROM lineitem"


@REGISTRY.add(f"SELECT pos, node_id, o_totalprice, o_orderpriority FROM ({_REQUESTS}) JOIN orders ON o_orderkey = node_id")
def feature_gather_with_duplicates(spark, sf_dir):
    """Orders asked for by lines, as often as asked."""
    requests = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("node_id"), F.expr("l_orderkey * 100000 + l_linenumber * 1000 + l_suppkey").alias("pos"))
    return features.gather(requests, table(spark, sf_dir, "orders"), "o_orderkey", columns=["o_totalprice", "o_orderpriority"])


@REGISTRY.add("SELECT l_orderkey // 1024 AS win, count(*) AS requested, count(DISTINCT l_partkey) AS unique_rows, round(count(*) / count(DISTINCT l_partkey), 6) AS duplicate_factor FROM lineitem GROUP BY 1")
def feature_window_dedup_stats(spark, sf_dir):
    requests = table(spark, sf_dir, "lineitem").select(F.expr("l_orderkey div 1024").alias("win"), F.col("l_partkey").alias("node_id"))
    return features.request_stats(requests, "win").withColumn("duplicate_factor", F.round("duplicate_factor", 6))


@REGISTRY.add("SELECT l_partkey // 64 AS block, count(*) AS requested, count(DISTINCT l_partkey) AS unique_rows, count(DISTINCT l_partkey) / 64e0 AS density FROM lineitem GROUP BY 1")
def block_density_histogram(spark, sf_dir):
    return features.block_density(table(spark, sf_dir, "lineitem").select("l_partkey"), "l_partkey", 64)


@REGISTRY.add("SELECT d.doc_id, lang, n_chars, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def hidden_column_projection(spark, sf_dir):
    """Features of labelled documents without keys and without the columns their task hides."""
    db = database(spark, sf_dir, ["documents", "labels"])
    task = Task("label", "labels", "binary_classification", "labels", "doc_id", "quality", extra={"kind": "autocomplete", "hidden_columns": [["documents", "text"], ["documents", "source"]]})
    docs = db["documents"].select("doc_id", *db.feature_columns("documents", task.hides()))
    labels = db["labels"].select("doc_id", *db.feature_columns("labels", task.hides()))
    return docs.join(labels, "doc_id")


@REGISTRY.add("SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, CAST(length(text) AS BIGINT) AS n_text, CASE WHEN n_chars < 512 THEN '0-511' WHEN n_chars < 2048 THEN '512-2047' WHEN n_chars < 8192 THEN '2048-8191' ELSE '8192+' END AS bucket FROM documents")
def text_normalize_stats(spark, sf_dir):
    t = scalars.text_value("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length(t).cast("bigint").alias("n_bytes"), F.length(t).cast("bigint").alias("n_text"), scalars.bucket("n_chars", (512, 2048, 8192)).alias("bucket"))


@REGISTRY.add("SELECT CASE WHEN n_chars < 512 THEN '0-511' WHEN n_chars < 2048 THEN '512-2047' WHEN n_chars < 8192 THEN '2048-8191' ELSE '8192+' END AS bucket, count(*) AS n FROM documents GROUP BY 1")
def length_buckets(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(scalars.bucket("n_chars", (512, 2048, 8192)).alias("bucket")).agg(F.count("*").alias("n"))


@REGISTRY.add("SELECT lang, count(*) AS n, count(DISTINCT text) AS n_distinct, round(count(*) / count(DISTINCT text), 6) AS factor FROM documents GROUP BY lang")
def text_dedup_ratio(spark, sf_dir):
    h = F.sha2(scalars.text_value("text"), 256)
    out = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct(h).alias("n_distinct"))
    return out.withColumn("factor", F.round(F.col("n") / F.col("n_distinct"), 6))


@REGISTRY.add("SELECT DISTINCT sha256(text) AS text_sha256 FROM documents WHERE source <> 'src0' AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE source = 'src0')")
def text_sha256_cache_misses(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    cache = features.text_cache_misses(docs.filter("source = 'src0'"), "text", None).select("text_sha256")
    return features.text_cache_misses(docs.filter("source <> 'src0'"), "text", cache).select("text_sha256")


@REGISTRY.add()
def text_embed_hashed(spark, sf_dir):
    """A vector for each document, equal texts embedded once."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return text.embed_column(docs, "text", text.hashed_embedder(32)).select("doc_id", "embedding")


@REGISTRY.add("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props_decode(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@REGISTRY.add("SELECT c_custkey, CAST(c_acctbal AS DOUBLE) AS acctbal, CAST(length(c_name) AS BIGINT) AS n_name, lower(regexp_replace(regexp_replace(c_name, '[^0-9A-Za-z]+', '_', 'g'), '^_+|_+$', '', 'g')) AS slug FROM customer")
def scalar_round_trip(spark, sf_dir):
    """Values through their stored form and back."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", scalars.encode_value("decimal", F.col("c_acctbal").cast("decimal(38,4)")).alias("a"), scalars.encode_value("json", F.array("c_name")).alias("n"))
    return rows.select("c_custkey", scalars.decode_value("decimal", "a", "double").alias("acctbal"), F.length(scalars.decode_value("json", "n", "array<string>")[0]).cast("bigint").alias("n_name"), scalars.slug(scalars.decode_value("json", "n", "array<string>")[0]).alias("slug"))


@REGISTRY.add("SELECT 'p_size' AS \"column\", 'numerical' AS kind UNION ALL SELECT 'p_retailprice', 'numerical' UNION ALL SELECT 'p_brand', 'categorical' UNION ALL SELECT 'p_type', 'categorical'")
def semantic_types(spark, sf_dir):
    found = stats.infer_types(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice"), key="p_partkey")
    return spark.createDataFrame([(k, v) for k, v in found.items() if k != "p_partkey"], "column string, kind string")


@REGISTRY.add(f"""WITH s AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS d FROM orders WHERE o_orderdate <= TIMESTAMP '1999-01-01'), v AS ({_vocabulary_sql("(SELECT * FROM orders WHERE o_orderdate <= TIMESTAMP '1999-01-01')", "o_orderpriority")})
SELECT o_orderkey, round((o_totalprice - m) / d, 6) AS price, coalesce(idx, -1) AS priority FROM orders CROSS JOIN s LEFT JOIN v ON value = o_orderpriority""")
def processors_fit_before_cutoff(spark, sf_dir):
    """Processors fitted on rows visible at train time, applied to all."""
    orders = table(spark, sf_dir, "orders")
    train = orders.filter(F.col("o_orderdate") <= F.lit("1999-01-01").cast("timestamp_ntz"))
    for p in processors.plan({"o_totalprice": "numerical", "o_orderpriority": "categorical"}):
        orders = p.fit(train).transform(orders)
    return orders.select("o_orderkey", F.round("o_totalprice_std", 6).alias("price"), F.col("o_orderpriority_idx").alias("priority"))


@REGISTRY.add(f"WITH b AS ({_vocabulary_sql('part', 'p_brand')}) SELECT p_partkey, round(p_retailprice, 6) AS x0, CAST(p_size AS DOUBLE) AS x1, b.idx AS c0 FROM part JOIN b ON b.value = p_brand")
def table_encode(spark, sf_dir):
    """Arrays for each semantic type, columns in order of name."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    out = features.encode_table(part, "p_partkey", {"p_brand": "categorical", "p_size": "numerical", "p_retailprice": "numerical"}, {"p_brand": stats.vocabulary(part, "p_brand")})
    return out.select("p_partkey", F.round(F.col("numerical")[0], 6).alias("x0"), F.col("numerical")[1].alias("x1"), F.col("categorical")[0].alias("c0"))


@REGISTRY.add("""WITH r AS (SELECT c_custkey AS tree_id, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY md5(concat_ws('|', '42', '1', CAST(c_custkey AS string), 'f2p_o_custkey', CAST(c_custkey AS string), CAST(o_orderkey AS string))), o_orderkey) AS rk
 FROM customer JOIN orders ON o_custkey = c_custkey WHERE epoch_us(o_orderdate) // 1000000 <= 893462400)
SELECT tree_id, o_orderkey AS node_id, round(o_totalprice, 4) AS price FROM r JOIN orders USING (o_orderkey) WHERE rk <= 2""")
def assemble_batch(spark, sf_dir):
    """Sampled nodes with their encoded features."""
    db = database(spark, sf_dir, ["customer", "orders"])
    seeds = db["customer"].select(F.col("c_custkey").alias("tree_id"), F.lit("customer").alias("node_type"), F.col("c_custkey").alias("node_id"), F.lit(893462400).alias("seed_time"))
    nodes, _ = sampling.khop(seeds, graph.edges(db, directions=(False,)), [2])
    encoded = features.encode_table(db["orders"], "o_orderkey", {"o_totalprice": "numerical"})
    return features.attach(nodes, {"orders": (encoded, "o_orderkey")})["orders"].select("tree_id", "node_id", F.round(F.col("numerical")[0], 4).alias("price"))


@REGISTRY.add()
def schema_fingerprint(spark, sf_dir):
    """One digest of all numeric statistics, rounded so that the order of sums does not matter."""
    return stats.stats_fingerprint(numeric_stats(spark, sf_dir))


# ---- reports


@REGISTRY.add("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, max(value) AS max FROM events GROUP BY event_type")
def latency_summary(spark, sf_dir):
    out = metrics.latency(table(spark, sf_dir, "events"), ["event_type"], "value")
    return out.withColumns({"total": F.round("total", 4), "mean": F.round("mean", 6)})


@REGISTRY.add("SELECT event_type, l[CAST(round_even((len(l) - 1) * 0.5, 0) AS BIGINT) + 1] AS p50, l[CAST(round_even((len(l) - 1) * 0.95, 0) AS BIGINT) + 1] AS p95 FROM (SELECT event_type, list(value ORDER BY value) AS l FROM events GROUP BY event_type)")
def nearest_rank_percentiles(spark, sf_dir):
    return metrics.nearest_rank(table(spark, sf_dir, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


@REGISTRY.add("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rk FROM events) WHERE rk = 1")
def latest_row_per_key(spark, sf_dir):
    return metrics.latest(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


_STATES = ["F", "O", "P"]


@REGISTRY.add("SELECT o_orderpriority, " + ", ".join(f"round(sum(o_totalprice) FILTER (o_orderstatus = '{s}'), 2) AS \"{s}\"" for s in _STATES) + " FROM orders GROUP BY o_orderpriority")
def phase_pivot(spark, sf_dir):
    out = metrics.phases(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", "o_totalprice", _STATES)
    return out.select("o_orderpriority", *[F.round(s, 2).alias(s) for s in _STATES])


@REGISTRY.add("SELECT round(exp(avg(ln(l_extendedprice / l_quantity))), 6) AS geomean, count(*) AS n FROM lineitem WHERE l_extendedprice > 0 AND l_quantity > 0")
def geomean_ratio(spark, sf_dir):
    return metrics.geometric_mean(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity").withColumn("geomean", F.round("geomean", 6))


@REGISTRY.add("SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 8) AS mean FROM lineitem GROUP BY 1")
def weighted_mean_loss(spark, sf_dir):
    return metrics.weighted_mean(table(spark, sf_dir, "lineitem"), "l_discount", "l_quantity", ["l_returnflag"]).withColumn("mean", F.round("mean", 8))


@REGISTRY.add("SELECT coalesce(a.k, b.k) AS k, a.v AS \"left\", b.v AS \"right\", CASE WHEN a.k IS NULL THEN 'missing left' WHEN b.k IS NULL THEN 'missing right' ELSE 'both' END AS state FROM (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_mktsegment <> 'BUILDING') a FULL JOIN (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_acctbal > 0) b ON a.k = b.k")
def paired_runs(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumns({"k": F.col("c_custkey"), "v": F.col("c_acctbal")})
    return metrics.paired_runs(c.filter("c_mktsegment <> 'BUILDING'"), c.filter("v > 0"), ["k"], "v")


@REGISTRY.add("""SELECT "table", requests, hits, indexed_rows, CASE WHEN hits / requests >= 0.2 AND indexed_rows <= 1000 THEN 'dimension-hot' WHEN hits / requests >= 0.05 THEN 'mixed-hot' WHEN indexed_rows >= 1000 THEN 'streaming' ELSE 'warming' END AS heat FROM (
SELECT "table", requests, requests - indexed_rows AS hits, indexed_rows FROM (
SELECT 'part' AS "table", count(*) AS requests, count(DISTINCT l_partkey) AS indexed_rows FROM lineitem UNION ALL SELECT 'orders', count(*), count(DISTINCT l_orderkey) FROM lineitem UNION ALL SELECT 'region', count(*), count(DISTINCT n_regionkey) FROM nation UNION ALL SELECT 'events', count(*), count(DISTINCT event_id) FROM events))""")
def table_heat_class(spark, sf_dir):
    asked = [("part", "lineitem", "l_partkey"), ("orders", "lineitem", "l_orderkey"), ("region", "nation", "n_regionkey"), ("events", "events", "event_id")]
    rows = _union([table(spark, sf_dir, t).agg(F.count("*").alias("requests"), F.countDistinct(k).alias("indexed_rows")).select(F.lit(n).alias("table"), "requests", (F.col("requests") - F.col("indexed_rows")).alias("hits"), "indexed_rows") for n, t, k in asked])
    return metrics.heat(rows, warm_rows=1000)


@REGISTRY.add("SELECT event_id, value FROM events ORDER BY md5(concat_ws('|', '42', CAST(event_id AS string))), event_id LIMIT 100")
def uniform_sample(spark, sf_dir):
    return metrics.draw(table(spark, sf_dir, "events").select("event_id", "value"), "event_id", 100)


@REGISTRY.add("SELECT day, n, epoch(last - lag(last) OVER (ORDER BY day))::BIGINT AS elapsed FROM (SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n, date_trunc('second', max(ts)) AS last FROM events GROUP BY 1)")
def epoch_wall_clock(spark, sf_dir):
    days = table(spark, sf_dir, "events").groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("n"), scalars.seconds(F.max("ts")).alias("last"))
    return metrics.gaps(days, "day", "last").select("day", "n", "elapsed")


_POOLED = "SELECT word, list_transform(range(8), lambda i: ((ascii(word) + length(word) * (i + 1)) % 17) / 4.0) AS vector FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) WHERE length(word) <= 6"


POOLED_SQL = f"""WITH v AS ({_POOLED}),
d AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+')) AS word FROM documents),
m AS (SELECT doc_id, i, avg(vector[i]) AS x FROM (SELECT doc_id, vector, unnest(range(1, 9)) AS i FROM d JOIN v USING (word)) GROUP BY doc_id, i)
SELECT doc_id, k - 1 AS i, round(CAST(CAST(coalesce(x, 0) AS FLOAT) AS DOUBLE), 4) AS x
FROM (SELECT doc_id, unnest(range(1, 9)) AS k FROM documents) LEFT JOIN m USING (doc_id) WHERE m.i = k OR m.i IS NULL"""


def word_vectors(docs: DataFrame) -> DataFrame:
    """Vectors of eight numbers for the shorter words of the documents, made up from the words."""
    words = docs.select(F.explode(F.expr("regexp_extract_all(lower(text), '[a-z]+', 0)")).alias("word")).filter("length(word) <= 6").distinct()
    return words.withColumn("vector", F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: ((F.ascii("word") + F.length("word") * i) % 17) / 4.0))


@REGISTRY.add(POOLED_SQL)
def text_pooled_word_vectors(spark, sf_dir):
    """Mean of the vectors of a text's words, from a table of word vectors."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = text.pool_vectors(docs, "text", word_vectors(docs), dim=8)
    return out.select("doc_id", F.posexplode("embedding").alias("i", "x")).select("doc_id", F.col("i").cast("bigint").alias("i"), F.round(F.col("x").cast("double"), 4).alias("x"))
