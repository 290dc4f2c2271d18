"""Queries whose program is declarative SQL: one text, from which the DuckDB form follows by renaming functions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewright.sources.scan import TABLES, table

TEXTS: dict[str, str] = {}

TEXTS["q01_size_bucket_counts"] = """
WITH sized AS (SELECT CASE WHEN n_chars < 1024 THEN 'small' WHEN n_chars < 9216 THEN 'medium' ELSE 'large' END AS size FROM {documents}),
     names AS (SELECT * FROM (VALUES ('small'), ('medium'), ('large')) AS v(size))
SELECT names.size, count(sized.size) AS n FROM names LEFT JOIN sized ON names.size = sized.size GROUP BY names.size
"""
TEXTS["q02_profile_stats"] = """
SELECT lang, count(*) AS n, min(n_chars) AS least, max(n_chars) AS most, avg(n_chars) AS mean, median(n_chars) AS middle,
       cast(sum(n_chars) AS bigint) AS total, cast(count_if(n_chars > 1000) AS bigint) AS long_ones, count(DISTINCT source) AS sources
FROM {documents} GROUP BY lang
"""
TEXTS["q03_zero_filled_grid"] = """
WITH l AS (SELECT DISTINCT lang FROM {documents}), s AS (SELECT DISTINCT source FROM {documents}),
     c AS (SELECT lang, source, count(*) AS n FROM {documents} WHERE n_chars > 3000 GROUP BY lang, source)
SELECT l.lang, s.source, coalesce(c.n, 0) AS n FROM l CROSS JOIN s LEFT JOIN c ON c.lang = l.lang AND c.source = s.source
"""
TEXTS["q04_share_and_imbalance"] = """
WITH c AS (SELECT event_type, count(*) AS n FROM {events} GROUP BY event_type)
SELECT event_type, n, n / cast(sum(n) OVER () AS double) AS share, max(n) OVER () / cast(min(nullif(n, 0)) OVER () AS double) AS imbalance,
       n / cast(sum(n) OVER () AS double) - 1 / cast(count(*) OVER () AS double) AS off_target
FROM c
"""
TEXTS["q05_pivot_status_by_segment"] = """
SELECT c_mktsegment, cast(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS bigint) AS open_n,
       cast(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS bigint) AS filled_n,
       cast(sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS bigint) AS partial_n
FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY c_mktsegment
"""
TEXTS["q06_histogram"] = """
WITH r AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM {lineitem}),
     b AS (SELECT least(cast(floor((l_quantity - lo) * 30 / (hi - lo)) AS bigint), cast(29 AS bigint)) AS bin FROM {lineitem}, r)
SELECT bin, count(*) AS n FROM b GROUP BY bin
"""
TEXTS["q12_review_integrity"] = """
SELECT 'missing_label' AS rule, cast(d.doc_id AS varchar(20)) AS item FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL
UNION ALL SELECT 'extra_label', cast(l.doc_id AS varchar(20)) FROM {labels} l LEFT JOIN {documents} d ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL
UNION ALL SELECT 'assigned_twice', cast(doc_id AS varchar(20)) FROM {labels} GROUP BY doc_id HAVING count(*) > 1
UNION ALL SELECT 'pending', cast(doc_id AS varchar(20)) FROM {labels} WHERE quality IS NULL OR toxic IS NULL
UNION ALL SELECT 'invalid_status', cast(doc_id AS varchar(20)) FROM {labels} WHERE quality NOT IN (0, 1) OR toxic NOT IN (0, 1)
"""
TEXTS["q18_range_join"] = """
WITH bands AS (SELECT * FROM (VALUES ('low', 0, 999), ('mid', 1000, 1399), ('high', 1400, 1799), ('top', 1700, 9999)) AS v(band, lo, hi)),
     m AS (SELECT p_partkey, band FROM {part} JOIN bands ON floor(p_retailprice) BETWEEN lo AND hi)
SELECT p.p_partkey, count(m.band) AS matches, CASE WHEN count(m.band) = 1 THEN min(m.band) END AS band,
       CASE WHEN count(m.band) = 0 THEN 'no_range' WHEN count(m.band) > 1 THEN 'several_ranges' ELSE 'ok' END AS outcome
FROM {part} p LEFT JOIN m ON p.p_partkey = m.p_partkey GROUP BY p.p_partkey
"""
TEXTS["q19_adjacent_pairs"] = """
SELECT a.o_orderkey AS first_key, b.o_orderkey AS second_key FROM {orders} a JOIN {orders} b ON b.o_orderkey = a.o_orderkey + 1 AND a.o_custkey % 7 = b.o_custkey % 7
"""
TEXTS["q21_semi_anti"] = """
SELECT c_mktsegment, CASE WHEN has_order THEN 'semi' ELSE 'anti' END AS side, count(*) AS n
FROM (SELECT c_mktsegment, o.k IS NOT NULL AS has_order FROM {customer} LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM {orders}) o ON o.k = c_custkey) t
GROUP BY c_mktsegment, CASE WHEN has_order THEN 'semi' ELSE 'anti' END
"""
TEXTS["q22_bijection_check"] = """
WITH f AS (SELECT d.doc_id AS a, l.doc_id AS b FROM {documents} d FULL JOIN {labels} l ON d.doc_id = l.doc_id)
SELECT cast(count_if(b IS NULL) AS bigint) AS unmapped, cast(count_if(a IS NULL) AS bigint) AS foreign_rows, cast(count(a) - count(DISTINCT a) AS bigint) AS repeated_left,
       cast(count(b) - count(DISTINCT b) AS bigint) AS repeated_right, count_if(a IS NULL OR b IS NULL) = 0 AS set_equal
FROM f
"""
TEXTS["q23_full_outer_inventory"] = """
WITH t AS (SELECT sha2(text, 256) AS h, source, n_chars FROM {documents}),
     a AS (SELECT h, min(n_chars) AS size FROM t WHERE source < 'src5' GROUP BY h), b AS (SELECT h, min(n_chars) AS size FROM t WHERE source >= 'src3' GROUP BY h)
SELECT coalesce(a.h, b.h) AS h, a.size AS listed, b.size AS present,
       CASE WHEN b.h IS NULL THEN 'missing' WHEN a.h IS NULL THEN 'unlisted' WHEN a.size <> b.size THEN 'size_differs' ELSE 'ok' END AS outcome
FROM a FULL JOIN b ON a.h = b.h
"""
TEXTS["q25_star_join"] = """
SELECT r_name, n_name, c_mktsegment, cast(sum(cast(round(l_extendedprice * 100) AS bigint) * cast(round((1 - l_discount) * 100) AS bigint)) AS bigint) AS revenue_e4, count(*) AS lines
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey
     JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
GROUP BY r_name, n_name, c_mktsegment
"""
TEXTS["q26_rule_chain_first_failure"] = """
SELECT code, count(*) AS n FROM (
  SELECT CASE WHEN text IS NULL THEN 'corrupt' WHEN length(trim(text)) = 0 THEN 'empty_text' WHEN n_chars <> length(text) THEN 'wrong_length'
              WHEN length(text) < 40 THEN 'too_short' WHEN lang NOT IN ('en', 'de', 'fr', 'es') THEN 'unknown_language'
              WHEN text LIKE '%!!%' THEN 'shouting' ELSE 'ok' END AS code FROM {documents}
  UNION ALL
  SELECT CASE WHEN user_id IS NULL THEN 'no_user' WHEN value IS NULL THEN 'non_numeric' WHEN value <= 0 THEN 'non_positive' WHEN value > 100 THEN 'out_of_range' ELSE 'ok_event' END FROM {events}
) t GROUP BY code
"""
TEXTS["q27_all_violations"] = """
SELECT 'lineitem' AS suite, 'discount_range' AS rule, 'error' AS severity, concat(l_orderkey, ':', l_linenumber) AS item FROM {lineitem} WHERE l_discount < 0 OR l_discount > 0.09
UNION ALL SELECT 'lineitem', 'orphan_line', 'error', concat(l_orderkey, ':', l_linenumber) FROM {lineitem} LEFT JOIN {orders} ON l_orderkey = o_orderkey WHERE o_orderkey IS NULL
UNION ALL SELECT 'lineitem', 'shipped_before_order', 'warning', concat(l_orderkey, ':', l_linenumber) FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate
UNION ALL SELECT 'orders', 'no_lines', 'warning', cast(o_orderkey AS varchar(20)) FROM {orders} LEFT JOIN (SELECT DISTINCT l_orderkey FROM {lineitem}) l ON l_orderkey = o_orderkey WHERE l_orderkey IS NULL
UNION ALL SELECT 'orders', 'repeated_key', 'error', cast(o_orderkey AS varchar(20)) FROM {orders} GROUP BY o_orderkey HAVING count(*) > 1
"""
TEXTS["q28_path_safety"] = """
WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*/?', '') AS path FROM {pages})
SELECT page_id, path, (path = '' OR path LIKE '/%' OR regexp_like(path, '^[A-Za-z]:') OR regexp_like(path, '(^|/)[.]{{0,2}}(/|$)')) AS unsafe,
       regexp_like(path, '[.](html|htm)$') AS page_suffix, regexp_like(path, '(^|/)(test|private)(/|$)') AS prohibited
FROM p
"""
TEXTS["q29_secret_scan"] = """
WITH rules AS (SELECT * FROM (VALUES ('private_key', '-----BEGIN [A-Z ]*PRIVATE KEY-----'), ('access_key', 'AKIA[0-9A-Z]{{16}}'), ('token', 'gh[pousr]_[A-Za-z0-9]{{20,}}')) AS v(rule, pattern)),
     t AS (SELECT 'documents' AS origin, text AS x FROM {documents} UNION ALL SELECT 'pages', html FROM {pages}),
     h AS (SELECT origin, CASE WHEN regexp_like(x, '-----BEGIN [A-Z ]*PRIVATE KEY-----') THEN 1 ELSE 0 END AS a, CASE WHEN regexp_like(x, 'AKIA[0-9A-Z]{{16}}') THEN 1 ELSE 0 END AS b,
                  CASE WHEN regexp_like(x, 'gh[pousr]_[A-Za-z0-9]{{20,}}') THEN 1 ELSE 0 END AS c FROM t),
     s AS (SELECT origin, sum(a) AS a, sum(b) AS b, sum(c) AS c FROM h GROUP BY origin)
SELECT origin, rule, cast(CASE rule WHEN 'private_key' THEN a WHEN 'access_key' THEN b ELSE c END AS bigint) AS hits FROM s CROSS JOIN rules
"""
TEXTS["q31_string_agg_sorted"] = {
    "spark": "SELECT r_name, array_join(sort_array(collect_set(n_name)), ';') AS members, count(*) AS n FROM {nation} JOIN {region} ON n_regionkey = r_regionkey GROUP BY r_name",
    "duck": "SELECT r_name, string_agg(DISTINCT n_name, ';' ORDER BY n_name) AS members, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
}
TEXTS["q32_rank_composite"] = """
WITH m AS (SELECT c_mktsegment AS model, avg(c_acctbal) AS a, max(c_acctbal) AS b, cast(count(*) AS bigint) AS n, min(c_acctbal) AS latency FROM {customer} GROUP BY c_mktsegment)
SELECT model, cast(row_number() OVER (ORDER BY b DESC, n DESC, latency ASC, model ASC) AS bigint) AS place,
       row_number() OVER (ORDER BY b DESC, n DESC, latency ASC, model ASC) = 1 AS recommended
FROM m
"""
TEXTS["q33_contiguity"] = """
WITH t AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM {conversations})
SELECT conv_id, count(*) AS turns, cast(count_if(before IS NOT NULL AND turn <> before + 1) AS bigint) AS gaps, cast(count(turn) - count(DISTINCT turn) AS bigint) AS repeated, min(turn) AS first_turn
FROM t GROUP BY conv_id
"""
TEXTS["q34_delta_previous_and_baseline"] = """
WITH d AS (SELECT cast(ts AS date) AS day, count(*) AS n FROM {events} GROUP BY cast(ts AS date))
SELECT day, n, n - lag(n) OVER (ORDER BY day) AS from_previous, n - first_value(n) OVER (ORDER BY day) AS from_first,
       (n - first_value(n) OVER (ORDER BY day)) / cast(nullif(first_value(n) OVER (ORDER BY day), 0) AS double) AS relative
FROM d
"""
TEXTS["q35_running_tp_fp_envelope"] = """
WITH s AS (SELECT l.doc_id, lang, quality, cast(row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, l.doc_id) AS bigint) AS no FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id),
     r AS (SELECT *, cast(sum(quality) OVER (PARTITION BY lang ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bigint) AS tp FROM s)
SELECT doc_id, lang, no, tp, no - tp AS fp, max(tp / cast(no AS double)) OVER (PARTITION BY lang ORDER BY no DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS envelope FROM r
"""
TEXTS["q36_topn_multi_rule"] = """
WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS a, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS b,
                  row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS c, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS d,
                  row_number() OVER (PARTITION BY event_type ORDER BY user_id, event_id) AS e FROM {events})
SELECT event_type, event_id, cast(CASE WHEN a <= 8 THEN 1 WHEN b <= 8 THEN 2 WHEN c <= 8 THEN 3 WHEN d <= 8 THEN 4 ELSE 5 END AS integer) AS first_rule FROM r WHERE a <= 8 OR b <= 8 OR c <= 8 OR d <= 8 OR e <= 8
"""
TEXTS["q37_best_per_class"] = """
SELECT l_returnflag, l_linestatus, l_orderkey, l_linenumber, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS no FROM {lineitem}) t WHERE no = 1
"""
TEXTS["q38_latest_per_key"] = {
    "spark": "SELECT user_id, max_by(event_id, struct(ts, event_id)) AS event_id, max_by(event_type, struct(ts, event_id)) AS event_type FROM {events} GROUP BY user_id",
    "duck": "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id",
}
TEXTS["q40_paging"] = """
SELECT source, doc_id, cast(floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 20) + 1 AS bigint) AS page FROM {documents}
"""
TEXTS["q47_disagreement_range"] = """
WITH p AS (SELECT user_id, count_if(event_type = 'click') AS c, count_if(event_type = 'view') AS v, count_if(event_type = 'error') AS e FROM {events} GROUP BY user_id)
SELECT user_id, cast(c AS bigint) AS click_n, cast(v AS bigint) AS view_n, cast(e AS bigint) AS error_n, cast(greatest(c, v, e) - least(c, v, e) AS bigint) AS spread FROM p
"""
TEXTS["q50_all_equal_check"] = """
SELECT l_orderkey, count(DISTINCT l_returnflag) = 1 AS same_flag, count(DISTINCT l_linestatus) = 1 AS same_status, count(*) AS n FROM {lineitem} GROUP BY l_orderkey
"""
TEXTS["q51_change_flags"] = """
WITH b AS (SELECT doc_id, source, lang, CASE WHEN n_chars % 3 = 0 THEN upper(source) ELSE source END AS source2, CASE WHEN doc_id % 5 = 0 THEN cast(NULL AS varchar(9)) ELSE lang END AS lang2 FROM {documents}),
     o AS (SELECT source, count(DISTINCT source2) AS outs FROM b GROUP BY source), i AS (SELECT source2, count(DISTINCT source) AS ins FROM b GROUP BY source2)
SELECT b.doc_id, (b.source IS DISTINCT FROM b.source2 OR b.lang IS DISTINCT FROM b.lang2) AS changed,
       CASE WHEN o.outs > 1 AND i.ins > 1 THEN 'both' WHEN o.outs > 1 THEN 'split' WHEN i.ins > 1 THEN 'merge' ELSE 'same' END AS kind
FROM b JOIN o ON b.source = o.source JOIN i ON b.source2 = i.source2
"""
TEXTS["q52_json_extract"] = {
    "spark": "SELECT event_id, cast(get_json_object(props, '$.k') AS bigint) AS k, get_json_object(props, '$.none') AS none FROM {events}",
    "duck": "SELECT event_id, cast(json_extract_string(props, '$.k') AS bigint) AS k, json_extract_string(props, '$.none') AS none FROM events",
}
TEXTS["q53_protected_reject"] = """
SELECT doc_id FROM (SELECT doc_id, sha2(text, 256) AS h FROM {documents}) d LEFT JOIN (SELECT DISTINCT sha2(text, 256) AS h2 FROM {benchmark}) b ON h = h2 WHERE h2 IS NULL
"""
TEXTS["q55_rollup_totals"] = """
SELECT coalesce(lang, 'all') AS lang, coalesce(source, 'all') AS source, count(*) AS n FROM {documents} WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY ROLLUP(lang, source)
"""
TEXTS["q56_column_normalised_and_macro"] = """
WITH c AS (SELECT d.lang AS truth, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' ELSE 'bad' END AS guess, count(*) AS n FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id
           GROUP BY d.lang, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' ELSE 'bad' END)
SELECT truth, guess, n, n / cast(greatest(sum(n) OVER (PARTITION BY guess), 1) AS double) AS share,
       cast(row_number() OVER (ORDER BY n DESC, truth, guess) AS bigint) AS place
FROM c
"""
TEXTS["q57_set_operations"] = """
SELECT 'intersect' AS op, count(*) AS n FROM (SELECT c_nationkey AS k FROM {customer} WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM {supplier}) a
UNION ALL SELECT 'except', count(*) FROM (SELECT c_nationkey AS k FROM {customer} EXCEPT SELECT s_nationkey FROM {supplier} WHERE s_acctbal > 5000) b
UNION ALL SELECT 'union', count(*) FROM (SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}) c
UNION ALL SELECT 'except_all', count(*) FROM (SELECT c_nationkey AS k FROM {customer} EXCEPT ALL SELECT s_nationkey FROM {supplier}) d
UNION ALL SELECT 'subset', count(*) FROM (SELECT o_custkey AS k FROM {orders} EXCEPT SELECT c_custkey FROM {customer}) e
"""
TEXTS["q58_latency_throughput"] = """
WITH t AS (SELECT user_id, sum(value) AS total, sum(CASE WHEN event_type = 'error' THEN value ELSE 0 END) AS loss FROM {events} GROUP BY user_id)
SELECT user_id, cast(round(total - loss, 6) AS double) AS latency, CASE WHEN total - loss > 0 THEN cast(round(1000 / (total - loss), 6) AS double) END AS throughput FROM t
"""


def _parts(text: str | dict) -> tuple[str, str]:
    """(the Spark text, the DuckDB text)."""
    if isinstance(text, dict):
        return text["spark"], text["duck"]
    duck = text.format(**{t: t for t in TABLES})
    duck = re.sub(r"sha2\(([^()]*), 256\)", r"sha256(\1)", duck).replace("regexp_like(", "regexp_matches(").replace("varchar(20)", "varchar").replace("varchar(9)", "varchar")
    return text.replace("varchar(20)", "string").replace("varchar(9)", "string"), duck


def _query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text, **{t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in text})

    return run


QUERIES = {name: _query(_parts(text)[0]) for name, text in TEXTS.items()}
SQL = {name: _parts(text)[1] for name, text in TEXTS.items()}
