"""Queries over the whole flow, its statistics, encodings and moments, and what a scan is told."""

from __future__ import annotations

from pyspark.sql import functions as F

from tributary import api
from tributary.config import parse_config
from tributary.functions import encodings, scalars, text
from tributary.operators import features, graph, processors, sampling, seeds, stats
from tributary.plans.feature_queries import POOLED_SQL, word_vectors
from tributary.plans.fixture import LINE_ID_SQL, Registry, database, table
from tributary.schema import Keys, Link
from tributary.sources.readers import FramesReader

REGISTRY = Registry()


def _numbers_sql(t: str, c: str) -> str:
    named = {"mean": f"avg({c})", "std": f"stddev_pop({c})"} | {f"q{100 * q:.0f}": f"quantile_cont({c}, {q})" for q in stats.QUANTILES}
    one = "SELECT '{c}' AS \"column\", 'numerical' AS kind, '{name}' AS name, CAST(NULL AS VARCHAR) AS value, round(CAST({x} AS DOUBLE), 4) AS number, count({c}) AS n FROM {t}"
    return " UNION ALL ".join(one.format(c=c, name=k, x=x, t=t) for k, x in named.items())


_STATISTICS_SQL = f"""{_numbers_sql("orders", "o_totalprice")}
UNION ALL SELECT 'o_orderdate', 'timestamp', name, NULL, CAST(epoch_us(t) AS DOUBLE), (SELECT count(o_orderdate) FROM orders) FROM (
  SELECT 'oldest' AS name, min(o_orderdate) AS t FROM orders UNION ALL SELECT 'newest', max(o_orderdate) FROM orders
  UNION ALL SELECT 'median', o_orderdate FROM (SELECT o_orderdate, row_number() OVER (ORDER BY o_orderdate) - 1 AS r, count(*) OVER () AS m
    FROM orders WHERE o_orderdate IS NOT NULL) WHERE r = m // 2)
UNION ALL SELECT 'o_orderpriority', 'categorical', 'value', value, CAST(row_number() OVER (ORDER BY n DESC, value) - 1 AS DOUBLE), n
  FROM (SELECT o_orderpriority AS value, count(*) AS n FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1)"""


@REGISTRY.add(_STATISTICS_SQL)
def statistics_plan(spark, sf_dir):
    """All statistics of a table, of every semantic type, as rows."""
    types = {"o_totalprice": "numerical", "o_orderdate": "timestamp", "o_orderpriority": "categorical"}
    out = stats.statistics(table(spark, sf_dir, "orders"), types).frame(spark)
    return out.withColumn("number", F.when(F.col("kind") == "numerical", F.round("number", 4)).otherwise(F.col("number")))


@REGISTRY.add(POOLED_SQL)
def text_embedding_bags(spark, sf_dir):
    """Mean word vectors as bags over a matrix of the vectors."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = text.WordVectors(word_vectors(docs), dim=8).embed(docs, "text", "embedding")
    parts = out.select("doc_id", F.posexplode("embedding").alias("i", "x"))
    return parts.select("doc_id", F.col("i").cast("bigint").alias("i"), F.round(F.col("x").cast("double"), 4).alias("x"))


@REGISTRY.add("""SELECT event_id, event_id % 97 AS k, CAST(round(value, 2) AS DECIMAL(18,2))::DOUBLE AS money, date_trunc('second', ts) AS at,
octet_length(encode(event_type))::BIGINT AS n_raw, event_type AS kind, event_id % 1000 AS span FROM events""")
def encodings_from_values(spark, sf_dir):
    """Columns written as texts, of which their values tell what they are, decoded again."""
    written = table(spark, sf_dir, "events").select(
        "event_id",
        F.to_json(F.struct((F.col("event_id") % 97).alias("k"), F.array("event_type").alias("types"))).alias("js"),
        F.round("value", 2).cast("decimal(18,2)").cast("string").alias("money"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"),
        F.concat(F.lit("0x"), F.lower(F.hex(F.col("event_type").cast("binary")))).alias("raw"),
        F.col("event_type").alias("kind"),
        F.expr("CAST(make_dt_interval(0, 0, 0, event_id % 1000) AS string)").alias("span"),
    )
    found = encodings.infer_encodings(written)
    out = encodings.decode_frame(written, found)
    return out.select(
        "event_id", "js.k", F.col("money").cast("double").alias("money"), F.col("at").cast("timestamp_ntz").alias("at"),
        F.octet_length("raw").cast("bigint").alias("n_raw"), "kind", F.expr("CAST(extract(DAY FROM span) * 86400 + extract(HOUR FROM span) * 3600 + extract(MINUTE FROM span) * 60 + extract(SECOND FROM span) AS bigint)").alias("span"),
    )


@REGISTRY.add("SELECT event_id, epoch_us(ts) // 1000000 AS seconds, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000, event_id) AS place FROM events")
def mixed_time_order(spark, sf_dir):
    """Moments written in five forms, with and without zones, in order."""
    second = F.date_trunc("second", F.col("ts").cast("timestamp"))
    east = F.concat(F.date_format(second + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))
    forms = [F.date_format(second, "yyyy-MM-dd HH:mm:ss"), F.date_format(second, "yyyy-MM-dd'T'HH:mm:ss'Z'"), east, F.date_format(second, "yyyy-MM-dd'T'HH:mm:ss.000"), scalars.julian_day(second).cast("string")]
    written = table(spark, sf_dir, "events").select("event_id", "user_id", F.get(F.array(*forms), (F.col("event_id") % 5).cast("int")).alias("t"))
    moments = written.select("event_id", "user_id", scalars.seconds(scalars.instant("t")).alias("seconds"))
    return graph.neighbour_rank(
        moments.select(F.lit("at").alias("edge_type"), F.lit("e").alias("src_type"), F.lit("u").alias("dst_type"), F.col("event_id").alias("src_id"), F.col("user_id").alias("dst_id"), F.col("seconds").alias("src_time"))
    ).select(F.col("src_id").alias("event_id"), F.col("src_time").alias("seconds"), (F.col("rank") + 1).alias("place"))


@REGISTRY.add("SELECT l_orderkey * 8 + l_linenumber AS pos, o_orderkey AS node_id, o_totalprice FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_orderkey BETWEEN 1000 AND 3000 OR l_orderkey > 14000")
def feature_gather_by_ranges(spark, sf_dir):
    """Orders asked for in parts of the table; the scan is told the ranges of their ids."""
    lines = table(spark, sf_dir, "lineitem").filter("l_orderkey BETWEEN 1000 AND 3000 OR l_orderkey > 14000")
    asked = lines.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"), F.col("l_orderkey").alias("node_id"))
    return features.gather(asked, table(spark, sf_dir, "orders"), "o_orderkey", columns=["o_totalprice"], block_rows=512)


_TIME = 915148800  # 1999-01-01


def _hop_sql(hop: int, edge: str, start: str, rows: str, key: str, own: str, time: str) -> str:
    return f"""SELECT tree_id, '{edge}' AS edge_type, {own} AS src_id, node_id AS dst_id, {hop} AS hop FROM (
  SELECT tree_id, node_id, {own}, row_number() OVER (PARTITION BY tree_id, node_id ORDER BY
    md5(concat_ws('|', '42', '{hop}', tree_id::VARCHAR, '{edge}', node_id::VARCHAR, {own}::VARCHAR)), {own}) AS rk
  FROM {start} JOIN {rows} ON {key} = node_id WHERE epoch_us({time}) // 1000000 <= {_TIME}) WHERE rk <= 2"""


@REGISTRY.add(f"""WITH l AS (SELECT *, {LINE_ID_SQL} AS line_id FROM lineitem), s AS (SELECT c_custkey::BIGINT AS tree_id, c_custkey::BIGINT AS node_id FROM customer),
a AS ({_hop_sql(1, 'f2p_o_custkey', 's', 'orders', 'o_custkey', 'o_orderkey', 'o_orderdate')}),
b AS ({_hop_sql(2, 'f2p_l_orderkey', '(SELECT tree_id, src_id AS node_id FROM a)', 'l', 'l_orderkey', 'line_id', 'l_shipdate')})
SELECT * FROM a UNION ALL SELECT * FROM b""")
def sample_two_hops(spark, sf_dir):
    """Two orders of each customer and two lines of each of these, none later than the seed."""
    db = database(spark, sf_dir, ["customer", "orders", "lineitem"])
    own = F.col("c_custkey").cast("bigint")
    start = db["customer"].select(own.alias("tree_id"), F.lit("customer").alias("node_type"), own.alias("node_id"), F.lit(_TIME).cast("bigint").alias("seed_time"))
    return sampling.khop(start, graph.edges(db, directions=(False,)), [2, 2])[1]


def _flow(spark, sf_dir, **change) -> api.PreparedDataset:
    """Labels of documents, which are known by source and id, prepared as a task."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "lang", "n_chars", "text")
    labels = table(spark, sf_dir, "labels").join(docs.select("source", "doc_id"), "doc_id")
    part = F.when(F.col("doc_id") % 5 == 0, "test").when(F.col("doc_id") % 5 == 1, "validation").otherwise("train")
    tasks = labels.select("doc_id", "source", F.when(F.col("quality") == 1, "Yes").otherwise("no").alias("good"), part.alias("part"))
    keys = Keys({"documents": ("source", "doc_id")}, (Link("tasks", ("source", "doc_id"), "documents"),))
    task = {"table": "tasks", "type": "binary_classification", "entity_table": "documents", "entity_columns": ["source", "doc_id"], "target": "good", "key": "doc_id"}
    split = {"column": "part", "values": {p: p for p in ("train", "validation", "test")}}
    value = {"database": {"path": "frames"}, "task": task | {"split": split}, "hidden_columns": [["documents", "text"]], "sampling": {"batch_size": 64}}
    reader = FramesReader(spark, {"documents": docs.filter("doc_id IS NOT NULL AND source IS NOT NULL"), "tasks": tasks}, keys)
    return api.prepare(spark, parse_config(value | change), reader=reader, check=False)


_NODES = "SELECT source, doc_id, lang, n_chars, row_number() OVER (ORDER BY source, doc_id) - 1 AS node_id FROM documents WHERE source IS NOT NULL AND doc_id IS NOT NULL"


@REGISTRY.add(f"""WITH n AS ({_NODES})
SELECT row_number() OVER (ORDER BY doc_id) - 1 AS tree_id, node_id, CAST(quality = 1 AS DOUBLE) AS target
FROM labels JOIN n USING (doc_id) WHERE doc_id % 5 > 1""")
def flow_entities_of_two_columns(spark, sf_dir):
    """Seeds of a task whose entity has a text and a number for its key."""
    return _flow(spark, sf_dir).seeds(0).select("tree_id", "node_id", "target")


@REGISTRY.add(f"""WITH n AS ({_NODES}), v AS (SELECT value, row_number() OVER (ORDER BY n DESC, value) - 1 AS idx
  FROM (SELECT lang AS value, count(*) AS n FROM n WHERE lang IS NOT NULL GROUP BY 1)),
q AS (SELECT quantile_cont(n_chars, 0.5) AS m, quantile_cont(n_chars, 0.75) - quantile_cont(n_chars, 0.25) AS d FROM n)
SELECT node_id, round((n_chars - m) / d, 6) AS chars, coalesce(idx, -1) AS lang FROM n CROSS JOIN q LEFT JOIN v ON value = lang""")
def flow_processors(spark, sf_dir):
    """Features encoded as configured: numbers by median and quartiles, categories by their place."""
    chosen = [{"table": "documents", "column": "n_chars", "semantic_type": "numerical", "processor": "standardize", "params": {"center": "median", "scale": "quartiles"}}]
    chosen.append({"table": "documents", "column": "lang", "semantic_type": "categorical"})
    encoded, key = _flow(spark, sf_dir, features=chosen).encoded("documents")
    return encoded.select(F.col(key).alias("node_id"), F.round(F.col("numerical")[0], 6).alias("chars"), F.col("categorical")[0].alias("lang"))


@REGISTRY.add("""WITH v AS (SELECT value, row_number() OVER (ORDER BY n DESC, value) - 1 AS idx FROM (
  SELECT value, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS value FROM part) GROUP BY value HAVING count(*) >= 2)),
p AS (SELECT p_partkey, unnest(string_split(p_type, ' ')) AS value, unnest(range(len(string_split(p_type, ' ')))) AS i FROM part)
SELECT p_partkey, i, coalesce(idx, -1) AS idx FROM p LEFT JOIN v USING (value)""")
def index_lists(spark, sf_dir):
    """The words of each part's type as places in their vocabulary, in order."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    plan = processors.fit_all(part, processors.plan({"p_type": "multicategorical"}, {"p_type": (None, {"separator": " ", "least_count": 2})}))
    out = processors.transform_all(part, "p_partkey", plan)
    return out.select("p_partkey", F.posexplode("p_type_idx").alias("i", "idx")).select("p_partkey", F.col("i").cast("bigint").alias("i"), "idx")


@REGISTRY.add("SELECT 'quality' AS label, max(quality) + 1 AS classes FROM labels UNION ALL SELECT 'toxic', max(toxic) + 1 FROM labels UNION ALL SELECT 'both', max(quality * 2 + toxic) + 1 FROM labels")
def class_counts_of_lists(spark, sf_dir):
    """Numbers of classes of single labels and of lists of labels."""
    rows = table(spark, sf_dir, "labels").withColumn("both", F.array(F.lit(0), F.col("quality") * 2 + F.col("toxic")))
    found = [(c, seeds.class_count(rows, c)) for c in ("quality", "toxic", "both")]
    return spark.createDataFrame(found, "label string, classes int")
