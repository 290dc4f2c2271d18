"""The validation suites over manifests that SQL derives from the test tables; the same derivations feed the DuckDB forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import scalars as S
from tidewright.operators import graph, metrics, ordering, suites
from tidewright.sources.scan import TABLES, table

from .curation import LINES, images

#: Manifests by name, as SQL that both engines read.
MADE = {
    "records": "SELECT concat('d/', doc_id) AS image_path, CASE WHEN n_chars % 7 = 0 THEN 'excluded' ELSE 'included' END AS inclusion_status FROM {documents}",
    "review": "SELECT concat('d/', doc_id) AS image_path, CASE WHEN quality = 1 AND doc_id % 5 > 0 THEN concat('g', doc_id % 60) WHEN toxic = 1 THEN 'kept' ELSE ' ' END AS duplicate_group_id, CASE WHEN doc_id % 19 = 0 THEN 'pending' WHEN quality = 1 THEN 'confirmed' WHEN doc_id % 11 = 0 THEN 'odd' ELSE 'rejected' END AS review_status FROM {labels}",
    "sources": "SELECT concat('d/', doc_id - doc_id % 2 * (CASE WHEN doc_id % 29 = 0 THEN 1 ELSE 0 END)) AS image_path, CASE WHEN doc_id % 13 = 0 THEN ' ' ELSE source END AS source_group_id, CASE doc_id % 9 WHEN 0 THEN 'pending' WHEN 1 THEN 'odd' WHEN 2 THEN 'split_required' ELSE 'confirmed' END AS review_status FROM {documents} WHERE doc_id % 17 <> 0",
    "present": "SELECT concat('d/', doc_id) AS path FROM {documents} WHERE doc_id % 23 <> 0",
    "splits": "SELECT CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 9 THEN 'val' ELSE 'test' END AS split, CASE WHEN doc_id % 97 = 0 THEN 'd/shared' ELSE concat('d/', doc_id) END AS image_path, CASE WHEN doc_id % 89 = 0 THEN ' ' ELSE sha2(text, 256) END AS content_hash, CASE WHEN n_chars % 3 = 0 THEN source ELSE concat(source, doc_id % 10) END AS source_group_id FROM {documents}",
    "copies": "SELECT concat('d/', doc_id) AS image_path, concat('g', doc_id % 300) AS duplicate_group_id FROM {labels} WHERE quality = 1",
    "used": "SELECT 'backgrounds' AS manifest, concat('d/', doc_id) AS image_path, CASE WHEN doc_id % 46 = 0 THEN 'changed' ELSE sha2(text, 256) END AS content_hash FROM {documents} WHERE doc_id % 23 = 0",
    "written": "SELECT concat('d/', item_id * 7) AS path FROM {benchmark}",
    "bank": "SELECT concat('o', doc_id % 950) AS object_id, concat('d/', doc_id) AS image_path, CASE WHEN doc_id % 31 = 0 THEN 'changed' ELSE sha2(text, 256) END AS content_hash, lang AS class_name, CASE WHEN n_chars % 7 = 0 THEN 'excluded' ELSE 'included' END AS inclusion_status, CASE WHEN n_chars % 14 = 0 THEN 'blurred' ELSE '' END AS exclusion_reason, concat(CASE WHEN doc_id % 37 = 0 THEN '../' ELSE 'c/' END, doc_id) AS crop_path, concat('m/', doc_id) AS mask_path, concat('h', doc_id % 43) AS crop_hash, concat('h', doc_id % 47) AS mask_hash FROM {documents} WHERE doc_id % 3 = 0",
    "crops": "SELECT concat('c/', doc_id) AS path, concat('h', doc_id % 43 % 42) AS sha256, 64 AS width, 48 AS height FROM {documents} WHERE doc_id % 41 <> 0 UNION ALL SELECT concat('m/', doc_id), concat('h', doc_id % 47), 64, CASE WHEN doc_id % 53 = 0 THEN 47 ELSE 48 END FROM {documents}",
    "rows": "SELECT concat('mix', doc_id % 4) AS regime, CASE WHEN doc_id % 4 >= 2 THEN 'synthetic' ELSE 'real' END AS sample_type, CASE WHEN doc_id % 59 = 0 THEN 'lost' ELSE concat('d/', doc_id) END AS image_path, concat('d/', doc_id - doc_id % 8) AS canvas, CASE WHEN doc_id % 61 = 0 THEN 'changed' ELSE sha2(text, 256) END AS image_hash, CASE WHEN doc_id % 67 = 0 THEN 'old' ELSE 'real1' END AS real_identity, CASE WHEN doc_id % 71 = 0 THEN 'old' ELSE 'pool1' END AS pool_identity FROM {documents}",
    "wanted": "SELECT concat('mix', doc_id) AS regime, CASE WHEN doc_id < 2 THEN 250 ELSE 0 END AS real, CASE WHEN doc_id < 2 THEN 0 ELSE 250 END AS synthetic FROM {documents} WHERE doc_id < 4",
    "stored": "SELECT concat('d/', doc_id) AS path, sha2(text, 256) AS hash FROM {documents} WHERE doc_id % 8 < 7",
    "held": "SELECT concat('d/', doc_id) AS path, sha2(text, 256) AS hash FROM {documents} WHERE doc_id % 101 = 0",
    "pictures": "SELECT concat('x/images/', o_orderkey, CASE o_orderkey % 31 WHEN 0 THEN '.tif' WHEN 1 THEN '' ELSE '.JPG' END) AS path, o_orderkey % 37 <> 0 AS readable FROM {orders} UNION ALL SELECT concat('y/images/', o_orderkey, '.png'), true FROM {orders} WHERE o_orderkey % 41 = 0",
    "notes": "SELECT concat('x/labels/', o_orderkey, '.txt') AS path FROM {orders} WHERE o_orderkey % 29 <> 0 UNION ALL SELECT concat('x/labels/z', o_orderkey, '.txt') FROM {orders} WHERE o_orderkey % 43 = 0",
    "noted": "SELECT concat('x/labels/', l_orderkey, '.txt') AS path, l_linenumber AS line_number, CASE WHEN l_orderkey % 47 = 0 THEN '   ' ELSE concat(l_linenumber % 5, ' ', CASE WHEN l_orderkey % 17 = 0 THEN 'a' ELSE concat('0.', l_partkey % 10) END, CASE WHEN l_partkey % 10 = 9 THEN ' 1.5' ELSE ' 0.5' END, ' 0.', l_suppkey % 4, ' 0.2', CASE WHEN l_orderkey % 13 = 0 THEN ' 9' ELSE '' END) END AS line FROM {lineitem} WHERE l_orderkey % 29 <> 0",
}

QUERIES, SQL = {}, {}


def made(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(MADE[name], **{t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in MADE[name]})


def _with(*names: str) -> str:
    """The manifests as the beginning of a DuckDB query."""
    text = ", ".join(f"{n} AS ({MADE[n].format(**{t: t for t in TABLES})})" for n in names)
    return f"WITH {text}".replace("sha2(text, 256)", "sha256(text)")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _rules(found: DataFrame) -> DataFrame:
    return found.select("rule", "key")


@query("q65_review_suite", _with("records", "review", "sources", "present") + """,
i AS (SELECT image_path AS p FROM records WHERE inclusion_status = 'included'), c AS (SELECT image_path AS p, trim(duplicate_group_id) AS g FROM review WHERE review_status = 'confirmed' AND trim(duplicate_group_id) <> ''),
m AS (SELECT g, count(DISTINCT coalesce(trim(source_group_id), '')) AS n, bool_or(coalesce(trim(source_group_id), '') = '') AS none FROM c LEFT JOIN sources ON image_path = p GROUP BY g)
SELECT 'duplicate_pending' AS rule, image_path AS key FROM review WHERE review_status = 'pending'
UNION ALL SELECT 'duplicate_status_invalid', image_path FROM review WHERE review_status = 'odd'
UNION ALL SELECT 'duplicate_assigned_twice', image_path FROM review GROUP BY image_path HAVING count(*) > 1
UNION ALL SELECT 'duplicate_missing', p FROM i WHERE p NOT IN (SELECT image_path FROM review)
UNION ALL SELECT DISTINCT 'duplicate_extra', image_path FROM review WHERE image_path NOT IN (SELECT p FROM i)
UNION ALL SELECT 'confirmed_without_group', image_path FROM review WHERE review_status = 'confirmed' AND trim(duplicate_group_id) = ''
UNION ALL SELECT 'group_kept_on_rejected', image_path FROM review WHERE review_status = 'rejected' AND trim(duplicate_group_id) <> ''
UNION ALL SELECT 'group_of_one', g FROM c GROUP BY g HAVING count(*) < 2
UNION ALL SELECT 'source_pending', image_path FROM sources WHERE review_status IN ('pending', 'split_required')
UNION ALL SELECT 'source_status_invalid', image_path FROM sources WHERE review_status = 'odd'
UNION ALL SELECT 'source_assigned_twice', image_path FROM sources GROUP BY image_path HAVING count(*) > 1
UNION ALL SELECT 'source_missing', p FROM i WHERE p NOT IN (SELECT image_path FROM sources)
UNION ALL SELECT DISTINCT 'source_extra', image_path FROM sources WHERE image_path NOT IN (SELECT p FROM i)
UNION ALL SELECT DISTINCT 'source_of_excluded', image_path FROM sources WHERE image_path IN (SELECT image_path FROM records WHERE inclusion_status = 'excluded')
UNION ALL SELECT 'source_without_id', image_path FROM sources WHERE trim(source_group_id) = ''
UNION ALL SELECT 'group_across_sources', g FROM m WHERE n <> 1 OR none
UNION ALL SELECT DISTINCT 'file_missing', image_path FROM sources WHERE image_path IN (SELECT p FROM i) AND image_path NOT IN (SELECT path FROM present)""")
def q65(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rules(suites.review_integrity(*[made(spark, sf_dir, x) for x in ("records", "review", "sources", "present")]))


@query("q66_split_preconditions", _with("records", "review", "sources") + """, i AS (SELECT image_path AS p FROM records WHERE inclusion_status = 'included')
SELECT 'duplicate_rows_differ' AS rule, p AS key FROM i WHERE p NOT IN (SELECT image_path FROM review) UNION ALL SELECT DISTINCT 'duplicate_rows_differ', image_path FROM review WHERE image_path NOT IN (SELECT p FROM i)
UNION ALL SELECT DISTINCT 'duplicate_pending', duplicate_group_id FROM review WHERE trim(duplicate_group_id) <> '' AND review_status = 'pending'
UNION ALL SELECT DISTINCT 'source_pending', source_group_id FROM sources WHERE review_status <> 'confirmed'
UNION ALL SELECT 'source_missing', p FROM i WHERE p NOT IN (SELECT image_path FROM sources WHERE trim(source_group_id) <> '')""")
def q66(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rules(suites.split_preconditions(*[made(spark, sf_dir, x) for x in ("records", "review", "sources")]))


@query("q67_leakage_suite", _with("splits", "copies", "used", "written") + """,
v AS (SELECT 'path_overlap' AS rule, split, image_path AS x FROM splits UNION ALL SELECT 'hash_overlap', split, trim(content_hash) FROM splits UNION ALL SELECT 'source_overlap', split, source_group_id FROM splits
      UNION ALL SELECT 'duplicate_group_overlap', split, duplicate_group_id FROM splits JOIN copies USING (image_path)),
t AS (SELECT u.*, s.content_hash AS h FROM used u LEFT JOIN (SELECT * FROM splits WHERE split = 'train') s USING (image_path)), h AS (SELECT DISTINCT split, image_path, trim(content_hash) AS x FROM splits WHERE split <> 'train')
SELECT rule, x AS key FROM v WHERE x <> '' GROUP BY rule, x HAVING count(DISTINCT split) > 1
UNION ALL SELECT 'protected_path_used', p.image_path FROM (SELECT DISTINCT split, image_path FROM h) p JOIN (SELECT DISTINCT image_path FROM used) u USING (image_path)
UNION ALL SELECT 'protected_hash_used', x FROM (SELECT DISTINCT split, x FROM h WHERE x <> '') p JOIN (SELECT DISTINCT content_hash FROM used) u ON x = content_hash
UNION ALL SELECT 'source_not_train', image_path FROM t WHERE h IS NULL UNION ALL SELECT 'source_hash_differs', image_path FROM t WHERE h <> content_hash
UNION ALL SELECT DISTINCT 'output_is_a_real_path', path FROM written WHERE path IN (SELECT image_path FROM splits)""")
def q67(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rules(suites.leakage(*[made(spark, sf_dir, x) for x in ("splits", "copies", "used", "written")]))


@query("q68_object_bank_suite", _with("bank", "crops") + """, train AS (SELECT concat('d/', doc_id) AS p, sha256(text) AS h FROM documents WHERE doc_id % 10 < 7), inc AS (SELECT * FROM bank WHERE inclusion_status = 'included'),
f AS (SELECT b.*, c.sha256 AS ch, m.sha256 AS mh, c.height <> m.height AS sized FROM inc b LEFT JOIN crops c ON c.path = crop_path LEFT JOIN crops m ON m.path = mask_path)
SELECT 'excluded_rows_differ' AS rule, object_id AS key FROM bank WHERE inclusion_status = 'excluded' AND image_path LIKE '%5'
UNION ALL SELECT 'object_id_repeated', object_id FROM bank GROUP BY object_id HAVING count(*) > 1
UNION ALL SELECT 'source_not_train', object_id FROM bank WHERE image_path NOT IN (SELECT p FROM train)
UNION ALL SELECT 'source_hash_differs', object_id FROM bank JOIN train ON p = image_path WHERE h <> content_hash
UNION ALL SELECT 'excluded_without_reason', object_id FROM bank WHERE inclusion_status = 'excluded' AND exclusion_reason = ''
UNION ALL SELECT 'path_unsafe', object_id FROM inc WHERE crop_path LIKE '../%'
UNION ALL SELECT 'crop_or_mask_missing', object_id FROM f WHERE ch IS NULL OR mh IS NULL
UNION ALL SELECT 'crop_or_mask_hash_differs', object_id FROM f WHERE ch <> crop_hash OR mh <> mask_hash
UNION ALL SELECT 'crop_and_mask_sizes_differ', object_id FROM f WHERE sized AND ch IS NOT NULL AND mh IS NOT NULL
UNION ALL SELECT 'class_without_object', 'xx'""")
def q68(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank, docs = made(spark, sf_dir, "bank"), table(spark, sf_dir, "documents")
    train = docs.where("doc_id % 10 < 7").select(F.concat(F.lit("d/"), "doc_id").alias("image_path"), F.sha2("text", 256).alias("content_hash"))
    classes = bank.where("inclusion_status = 'included'").select("class_name").distinct().unionAll(spark.range(1).select(F.lit("xx")))
    return _rules(suites.object_bank(train, bank, bank.where("inclusion_status = 'excluded' AND image_path NOT LIKE '%5'"), made(spark, sf_dir, "crops"), classes))


@query("q69_regime_suite", _with("rows", "wanted", "stored", "held") + """,
has AS (SELECT w.*, count_if(sample_type = 'real') AS r, count_if(sample_type = 'synthetic') AS s, count(r.regime) AS n FROM wanted w LEFT JOIN rows r ON r.regime = w.regime GROUP BY ALL),
t AS (SELECT r.*, CASE WHEN sample_type = 'real' OR path IS NOT NULL THEN hash END AS h FROM rows r LEFT JOIN stored ON path = image_path), k AS (SELECT *, regime || ':' || image_path AS key FROM t)
SELECT 'row_count' AS rule, regime AS key FROM has WHERE n <> real + synthetic UNION ALL SELECT 'real_count', regime FROM has WHERE r <> real UNION ALL SELECT 'synthetic_count', regime FROM has WHERE s <> synthetic
UNION ALL SELECT 'canvas_repeated', regime || ':' || canvas FROM rows GROUP BY regime, canvas HAVING count(*) > 1
UNION ALL SELECT 'canvas_missing', w.regime || ':' || path FROM wanted w, (SELECT DISTINCT path FROM stored) p WHERE NOT EXISTS (SELECT 1 FROM rows r WHERE r.regime = w.regime AND r.canvas = p.path)
UNION ALL SELECT DISTINCT 'canvas_unknown', regime || ':' || canvas FROM rows WHERE canvas NOT IN (SELECT path FROM stored)
UNION ALL SELECT 'protected_used', key FROM (SELECT DISTINCT * FROM rows JOIN (SELECT regime AS r2, image_path AS p2, key FROM k) ON r2 = regime AND p2 = image_path WHERE image_path IN (SELECT path FROM held) OR image_hash IN (SELECT hash FROM held))
UNION ALL SELECT 'real_identity_differs', key FROM k WHERE real_identity <> 'real1' UNION ALL SELECT 'pool_identity_differs', key FROM k WHERE pool_identity <> 'pool1'
UNION ALL SELECT 'path_unknown', key FROM k WHERE h IS NULL UNION ALL SELECT 'image_hash_differs', key FROM k WHERE h <> image_hash""")
def q69(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = made(spark, sf_dir, "stored")
    return _rules(suites.regimes(made(spark, sf_dir, "rows"), made(spark, sf_dir, "wanted"), stored, stored, made(spark, sf_dir, "held"), ("real1", "pool1")))


@query("q70_dataset_suite", _with("pictures", "notes", "noted") + r""",
p AS (SELECT *, replace(regexp_replace(path, '[.][^./]*$', ''), 'images/', 'labels/') || '.txt' AS label, regexp_matches(path, '[.](JPG|png)$') AS ok, lower(regexp_extract(path, '([^/]*?)([.][^./]*)?$', 1)) AS stem FROM pictures),
l AS (SELECT path, line_number, string_split(trim(line), ' ') AS t FROM noted WHERE trim(line) <> ''),
j AS (SELECT path, line_number, CASE WHEN len(t) <> 5 THEN 'unsupported_annotation_line' WHEN t[2] = 'a' THEN 'non_numeric_annotation' WHEN t[1] = '4' THEN 'unknown_class' WHEN t[3] = '1.5' THEN 'non_normalized_box' WHEN t[4] = '0.0' THEN 'non_positive_box'
  WHEN cast(t[2] AS double) - cast(t[4] AS double) / 2 < 0 OR cast(t[2] AS double) + cast(t[4] AS double) / 2 > 1 THEN 'box_outside_image' END AS code FROM l)
SELECT 'unsupported_image_extension' AS rule, path AS key FROM p WHERE NOT ok UNION ALL SELECT DISTINCT 'orphan_label', path FROM notes WHERE path NOT IN (SELECT label FROM p WHERE ok)
UNION ALL SELECT 'corrupt_image', path FROM p WHERE ok AND NOT readable UNION ALL SELECT 'missing_label', path FROM p WHERE ok AND label NOT IN (SELECT path FROM notes)
UNION ALL SELECT DISTINCT 'empty_label', path FROM notes WHERE path NOT IN (SELECT path FROM l) UNION ALL SELECT code, path || ':' || line_number FROM j WHERE code IS NOT NULL
UNION ALL SELECT 'no_valid_objects', path FROM p WHERE ok AND readable AND label IN (SELECT path FROM notes) AND label NOT IN (SELECT path FROM j WHERE code IS NULL)
UNION ALL SELECT 'duplicate_file_stem', path FROM p WHERE ok AND stem IN (SELECT stem FROM p WHERE ok GROUP BY stem HAVING count(*) > 1)""")
def q70(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rules(suites.dataset_files(*[made(spark, sf_dir, x) for x in ("pictures", "notes", "noted")], 4))


#: All events of the greedy match: the recursion of the true positives, with what every prediction met besides.
EVENTS = f"""WITH RECURSIVE {LINES},
q AS (SELECT image, ord AS pid, pc, score, row_number() OVER (PARTITION BY image ORDER BY score DESC, pc, ord) AS rn, (x2 - x1) * (y2 - y1) AS pa FROM p),
top AS (SELECT image, pid, tid, tc, iou FROM (SELECT *, row_number() OVER (PARTITION BY image, pid ORDER BY iou DESC, tid) AS no FROM c) z WHERE no = 1),
g(image, rn, used, pid, btid, biou) AS (SELECT DISTINCT image, cast(0 AS bigint), cast([] AS bigint[]), cast(NULL AS bigint), cast(NULL AS bigint), cast(NULL AS double) FROM q
  UNION ALL SELECT g.image, q.rn, CASE WHEN b.iou >= 0.5 THEN list_append(g.used, b.tid) ELSE g.used END, q.pid, b.tid, b.iou FROM g JOIN q ON q.image = g.image AND q.rn = g.rn + 1
  LEFT JOIN LATERAL (SELECT c.tid, c.iou FROM c WHERE c.image = q.image AND c.pid = q.pid AND c.pc = c.tc AND NOT list_contains(g.used, c.tid) ORDER BY c.iou DESC, c.tid LIMIT 1) b ON true),
e AS (SELECT q.*, btid, biou, top.tid AS atid, top.tc AS atc, top.iou AS aiou, CASE WHEN biou >= 0.5 THEN 'true_positive' WHEN top.iou >= 0.5 AND top.tc <> q.pc THEN 'class_confusion' WHEN biou >= 0.1 THEN 'localization_error' ELSE 'false_positive' END AS kind
  FROM g JOIN q ON q.image = g.image AND q.pid = g.pid JOIN top ON top.image = q.image AND top.pid = q.pid),
w AS (SELECT image, pid AS prediction, CASE WHEN kind IN ('true_positive', 'localization_error') THEN btid ELSE atid END AS truth, kind, CASE WHEN kind IN ('true_positive', 'localization_error') THEN biou ELSE aiou END AS iou, pc, score, pa FROM e),
lost AS (SELECT t.image, t.ord, t.tc, (t.x2 - t.x1) * (t.y2 - t.y1) AS ta FROM t LEFT JOIN w ON w.image = t.image AND w.truth = t.ord AND w.kind = 'true_positive' WHERE w.truth IS NULL),
n AS (SELECT lost.image, lost.ord, c.pid, c.pc, q.score, c.iou, row_number() OVER (PARTITION BY lost.image, lost.ord ORDER BY c.iou DESC, q.rn) AS no FROM lost JOIN c ON c.image = lost.image AND c.tid = lost.ord AND c.pc = c.tc JOIN q ON q.image = c.image AND q.pid = c.pid),
v AS (SELECT w.image, prediction, truth, kind, iou, cast(pc AS integer) AS prediction_class, cast(t.tc AS integer) AS truth_class, score, CASE WHEN kind = 'true_positive' THEN (t.x2 - t.x1) * (t.y2 - t.y1) ELSE pa END AS area FROM w JOIN t ON t.image = w.image AND t.ord = w.truth
  UNION ALL SELECT lost.image, n.pid, lost.ord, 'false_negative', coalesce(n.iou, 0), cast(n.pc AS integer), cast(lost.tc AS integer), n.score, ta FROM lost LEFT JOIN n ON n.image = lost.image AND n.ord = lost.ord AND n.no = 1)"""
ROWS = "image, prediction, truth, kind, iou, prediction_class, truth_class, score, CASE WHEN area < 1024 THEN 'small' WHEN area < 9216 THEN 'medium' ELSE 'large' END AS size"


@query("q44c_all_events", f"{EVENTS} SELECT {ROWS} FROM v")
def q44c(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.greedy_events(images(spark, sf_dir), "image")


@query("q44d_false_negatives", f"{EVENTS} SELECT truth_class, size, count(*) AS missed, count(prediction) AS with_prediction, round(max(iou), 9) AS best FROM (SELECT {ROWS} FROM v) z WHERE kind = 'false_negative' GROUP BY truth_class, size")
def q44d(spark: SparkSession, sf_dir: str) -> DataFrame:
    lost = metrics.greedy_events(images(spark, sf_dir), "image").where("kind = 'false_negative'")
    return lost.groupBy("truth_class", "size").agg(F.count("*").alias("missed"), F.count("prediction").alias("with_prediction"), F.round(F.max("iou"), 9).alias("best"))


SQL["q44b_event_counts"] = f"{EVENTS} SELECT kind, count(*) AS n FROM v GROUP BY kind"


@query("q71_category_offset", "SELECT l_orderkey, l_linenumber, cast(l_linenumber - 1 AS bigint) AS class_id FROM lineitem")
def q71(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return ordering.category_offset(rows, "l_linenumber", 7).select("l_orderkey", "l_linenumber", F.col("class_id").cast("long").alias("class_id"))


YOLO = "l_partkey % 110 / 100.0::DOUBLE AS x, l_suppkey % 100 / 100.0::DOUBLE AS y, l_quantity % 40 / 100.0::DOUBLE AS w, (l_linenumber - 1) / 8.0::DOUBLE AS h"


@query("q72_pixel_boxes", f"""WITH v AS (SELECT l_orderkey, l_linenumber, {YOLO} FROM lineitem),
k AS (SELECT *, (x - w / 2) * 640 AS a, (y - h / 2) * 480 AS b, (x + w / 2) * 640 AS c, (y + h / 2) * 480 AS d FROM v),
f AS (SELECT *, CASE WHEN w <= 0 OR h <= 0 THEN 'not positive' WHEN least(x, y, w, h) < 0 OR greatest(x, y, w, h) > 1 THEN 'not shares of the image' WHEN a < -1e-6 OR b < -1e-6 OR c > 640 + 1e-6 OR d > 480 + 1e-6 THEN 'outside the image' END AS fault FROM k)
SELECT l_orderkey, l_linenumber, fault, CASE WHEN fault IS NULL THEN cast(greatest(0, floor(a)) AS integer) END AS x1, CASE WHEN fault IS NULL THEN cast(least(480, ceil(d)) AS integer) END AS y2, CASE WHEN fault IS NULL THEN least(640, ceil(c)) - greatest(0, floor(a)) = 640 END AS full_width FROM f""")
def q72(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised boxes as pixels, or why they are none."""
    share = lambda c, by: (c / F.lit(by)).cast("double")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", share(F.col("l_partkey") % 110, 100.0).alias("x"), share(F.col("l_suppkey") % 100, 100.0).alias("y"), share(F.col("l_quantity") % 40, 100.0).alias("w"), share(F.col("l_linenumber") - 1, 8.0).alias("h"))
    own = [*[F.col(c) for c in "xywh"], F.lit(640), F.lit(480)]
    out = rows.withColumn("fault", S.yolo_fault(*own)).withColumn("b", F.when(F.col("fault").isNull(), S.yolo_to_xyxy(*own)))
    return out.select("l_orderkey", "l_linenumber", "fault", F.col("b.x1").alias("x1"), F.col("b.y2").alias("y2"), S.edge_touches(F.col("b"), F.lit(640), F.lit(480)).alias("e"), "b").select("l_orderkey", "l_linenumber", "fault", "x1", "y2", (F.col("e.left") & F.col("e.right")).alias("full_width"))


@query("q73_object_ids", """SELECT doc_id, substr(sha256('["d/' || doc_id || '",' || (doc_id % 7) || ',"' || source || ' \\u00e9"]'), 1, 16) AS object_id, regexp_replace(source, '[^A-Za-z0-9_.-]+', '-', 'g') AS safe, regexp_matches(sha256(text), '^[0-9a-f]{64}$') AS digest FROM documents""")
def q73(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", S.object_id(F.concat(F.lit("d/"), "doc_id"), F.col("doc_id") % 7, F.concat("source", F.lit(" é"))).alias("object_id"), S.safe_name(F.col("source")).alias("safe"), S.is_digest(F.sha2("text", 256)).alias("digest"))


@query("q74_capture_groups", """WITH RECURSIVE r AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'IMG_' || (doc_id // 40) || '_MOV-' || doc_id ELSE 'IMG_' || (doc_id * 3 // 2) || '_jpg.rf.0' || doc_id END || '.jpg' AS path, CASE WHEN n_chars % 50 = 0 THEN 'g' || (n_chars % 1000) END AS g FROM documents),
k AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(path, '[.]jpg$', ''), '[.]rf[.][0-9a-f]+$', ''), '_jpg$', '') AS id FROM r), z AS (SELECT *, CASE WHEN id LIKE '%MOV%' THEN split_part(id, '-', 1) END AS video, CASE WHEN id NOT LIKE '%MOV%' THEN cast(substr(id, 5) AS bigint) END AS no FROM k),
one AS (SELECT x.path AS a, y.path AS b FROM z x JOIN z y ON x.video = y.video UNION SELECT x.path, y.path FROM z x JOIN z y ON x.g = y.g UNION SELECT x.path, y.path FROM z x JOIN z y ON y.no - x.no IN (0, 1)),
e AS (SELECT a, b FROM one UNION SELECT b, a FROM one), c(node, lab) AS (SELECT path, path FROM z UNION SELECT e.b, c.lab FROM c JOIN e ON e.a = c.node), m AS (SELECT node, min(lab) AS lab FROM c GROUP BY node)
SELECT node AS path, lab AS source_group FROM m""")
def q74(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source groups by frames of one video, consecutive numbers and duplicate groups."""
    d = F.col("doc_id")
    video, still = F.concat(F.lit("IMG_"), F.floor(d / 40), F.lit("_MOV-"), d), F.concat(F.lit("IMG_"), F.floor(d * 3 / 2), F.lit("_jpg.rf.0"), d)
    rows = table(spark, sf_dir, "documents").select(F.concat(F.when(d % 5 == 0, video).otherwise(still), F.lit(".jpg")).alias("path"), F.when(F.col("n_chars") % 50 == 0, F.concat(F.lit("g"), F.col("n_chars") % 1000)).alias("duplicate_group_id"))
    rows = graph.settled(rows)
    return graph.components(rows.select(F.col("path").alias("node")), suites.source_edges(rows)).select(F.col("node").alias("path"), F.col("component").alias("source_group"))
