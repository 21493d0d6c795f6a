"""The registered queries of the corpus operators, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, filteraudit, langid, licenses, linededup, lmscore, media, minhash, packing, pii, search, sharding
from .common import documents


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.class_report(documents(spark, sf_dir))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_digest(licenses.scan(documents(spark, sf_dir)))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(documents(spark, sf_dir))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(documents(spark, sf_dir))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", langid.held_out())
    model = langid.fit(docs.filter(~F.col("held_out")))
    return langid.predict(docs, model, keep=["doc_id", "held_out"])


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.report(documents(spark, sf_dir))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlap_digest(decontaminate.find_overlaps(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(documents(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), packing.default_tokenizer())


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return lmscore.score(lmscore.count(docs, lmscore.good_documents(spark.read.parquet(f"{sf_dir}/labels.parquet"))))


def op11_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digest(documents(spark, sf_dir), bpe.default_tokenizer())


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.filter_audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    registered = (
        op1_near_dedup, op2_license_scan, op3_sharding, op4_personal_data, op5_language_id, op6_media_columns, op7_decontamination,
        op8_line_dedup, op9_packing, op10_lm_scoring, op11_bpe_round_trip, op12_ranked_search, op13_filter_audit,
    )
    return {f.__name__: f for f in registered}


LINE_DEDUP_SQL = r"""
WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, i AS line_no, trim(regexp_replace(regexp_replace(regexp_replace(lower(lines[i + 1]), '[^\p{L}\p{N}]+', ' ', 'g'),
             '([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])', ' \1 ', 'g'), ' +', ' ', 'g')) AS norm
      FROM (SELECT doc_id, lines, unnest(range(len(lines))) AS i FROM docs)),
e AS (SELECT *, string_split(norm, ' ') AS w, len(string_split(norm, ' ')) AS n, doc_id * 1000000 + line_no AS ord
      FROM l WHERE norm <> ''),
u AS (SELECT norm, any_value(w) AS w, any_value(n) AS n, min(ord) AS ord FROM e GROUP BY norm),
v AS (SELECT norm, ord, i, array_to_string(list_concat(w[1:i], w[i + 2:]), ' ') AS cut
      FROM (SELECT *, unnest(range(n)) AS i FROM u WHERE n >= 5)),
s AS (SELECT norm, ord, min(ord) OVER (PARTITION BY i, cut) AS earliest FROM v),
d AS (SELECT v.norm AS long_norm, v.ord AS long_ord, u.norm AS short_norm, u.ord AS short_ord FROM v JOIN u ON u.norm = v.cut WHERE u.n >= 5),
near AS (SELECT norm FROM s WHERE earliest < ord
         UNION SELECT long_norm FROM d WHERE short_ord < long_ord
         UNION SELECT short_norm FROM d WHERE long_ord < short_ord),
gone AS (SELECT DISTINCT e.doc_id, e.line_no FROM e JOIN u USING (norm) LEFT JOIN near USING (norm)
         WHERE near.norm IS NOT NULL OR e.ord > u.ord),
g AS (SELECT doc_id, list(line_no) AS gone FROM gone GROUP BY doc_id),
eligible AS (SELECT doc_id, count(*) AS n FROM e GROUP BY doc_id),
r AS (SELECT docs.doc_id, lines, coalesce(gone, []) AS gone, gone IS NULL OR len(gone) < eligible.n AS kept
      FROM docs LEFT JOIN g USING (doc_id) LEFT JOIN eligible USING (doc_id))
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(gone) AS BIGINT) AS n_removed, kept,
       CASE WHEN kept THEN array_to_string([lines[i + 1] FOR i IN range(len(lines)) IF NOT list_contains(gone, i)], chr(10)) ELSE '' END AS text
FROM r
"""


#: A CRC-32 in SQL: its table of 256, then byte by byte over the hexadecimal form.
_HEX = "'0123456789ABCDEF'"
SHARDING_SQL = f"""
WITH crc AS (SELECT list(c ORDER BY n) AS entry FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(n))),
d AS (SELECT doc_id, source, encode(coalesce(text, '')) AS raw FROM documents),
b AS (SELECT doc_id, source, octet_length(raw)::BIGINT + 1 AS size, list_transform(regexp_extract_all(hex(raw), '..'), lambda p: (strpos({_HEX}, p[1]) - 1) * 16 + strpos({_HEX}, p[2]) - 1) AS bytes FROM d),
e AS (SELECT doc_id, source, size, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: xor(entry[(xor(c, x) & 255) + 1], c >> 8)), 4294967295)::BIGINT AS text_crc32 FROM b, crc),
h AS (SELECT *, md5(concat_ws('|', '42', doc_id::VARCHAR, text_crc32::VARCHAR)) AS h, md5(concat_ws('|', '43', source)) AS p FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h) - 1 AS rank, count(*) OVER (PARTITION BY source) AS n,
      list_reduce([0, strpos('0123456789abcdef', p[1]) - 1, strpos('0123456789abcdef', p[2]) - 1, strpos('0123456789abcdef', p[3]) - 1, strpos('0123456789abcdef', p[4]) - 1, strpos('0123456789abcdef', p[5]) - 1], lambda a, x: a * 16 + x) / 1048576.0::DOUBLE AS phase FROM h),
g AS (SELECT *, row_number() OVER (ORDER BY (rank + phase) / n, source NULLS FIRST, h) - 1 AS place, count(*) OVER () AS total FROM r),
s AS (SELECT *, total // 8 AS small, total % 8 AS more FROM g),
t AS (SELECT *, CASE WHEN place < more * (small + 1) THEN place // (small + 1) ELSE more + (place - more * (small + 1)) // greatest(small, 1) END AS shard FROM s)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard::INT AS shard, (place - shard * small - least(shard, more))::BIGINT AS slot, NULL::INT AS grown_shard, source AS stratum FROM t
"""

DECONTAMINATION_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
k AS (SELECT item, w, least(10, len(w)) AS k FROM i WHERE len(w) > 0),
b AS (SELECT DISTINCT item, k, array_to_string(w[p:p + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS p FROM k)),
v AS (SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM k) WHERE len(w) >= k)),
h AS (SELECT doc_id, k, p, item FROM v JOIN b USING (k, g)),
n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM h) GROUP BY doc_id),
f AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(sha, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN f USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_license_scan": licenses.oracle(),
        "op3_sharding": SHARDING_SQL,
        "op7_decontamination": DECONTAMINATION_SQL,
        "op8_line_dedup": LINE_DEDUP_SQL,
        "op12_ranked_search": search.ORACLE_SQL,
        "op13_filter_audit": filteraudit.ORACLE_SQL,
    }
