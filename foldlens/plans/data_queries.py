"""Queries about metadata, duplicates, entities and accounting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cleaning
from ..operators import contracts, duplicates, profile
from ..sources import images, tables
from . import views as v
from .evaluation_queries import ORDER_ROWS, R, W, _bounds, order_rows

META = W + v.DIRTY_META
PATHS = r", p AS (SELECT sample_id, label, parts, len(parts) AS n FROM (SELECT sample_id, label, string_split(substr(replace(filepath, '\', '/'), 6), '/') AS parts FROM dirty_meta))"


def doc_pairs(spark, d) -> DataFrame:
    docs = v.table(spark, d, "documents")
    return duplicates.exact_pairs(docs, "doc_id", F.col("text"))


DOC_PAIRS = "doc_pairs AS (SELECT a.doc_id AS id_a, b.doc_id AS id_b FROM documents a JOIN documents b ON a.text = b.text AND a.doc_id < b.doc_id)"
DOC_MANIFEST = v.MANIFEST.replace(
    "SELECT vec_id AS id, label::INT AS label, ((row_number() OVER (ORDER BY label, md5('42|' || vec_id), vec_id) - 1) % 7 + 1)::INT AS fold FROM embeddings",
    "SELECT doc_id AS id, lang AS label, ((row_number() OVER (ORDER BY lang, md5('42|' || doc_id), doc_id) - 1) % 7 + 1)::INT AS fold FROM documents",
)


def doc_manifest(spark, d) -> DataFrame:
    from ..operators import folds

    docs = v.table(spark, d, "documents")
    return folds.manifest(folds.stratified_folds(docs, "doc_id", "lang"))


def hashes(spark, d) -> DataFrame:
    return duplicates.fingerprints(v.table(spark, d, "embeddings"), "vec_id", F.col("embedding"))


HASHES = """bits AS (
  SELECT vec_id AS id, list_sort(embedding[2:64])[32]::DOUBLE AS middle, embedding FROM embeddings
), hashes AS (
  SELECT id, list_sum([CASE WHEN embedding[i]::DOUBLE > middle THEN 1::BIGINT << (i - 1)::INT ELSE 0 END FOR i IN range(1, 33)])::BIGINT AS low,
         list_sum([CASE WHEN embedding[i + 32]::DOUBLE > middle THEN 1::BIGINT << (i - 1)::INT ELSE 0 END FOR i IN range(1, 33)])::BIGINT AS high FROM bits
)"""
HAMMING = "(bit_count(xor(a.low, b.low)) + bit_count(xor(a.high, b.high)))::INT"


def near_copies(spark, d) -> DataFrame:
    """The hashes of all vectors and two copies of each with one and with three other bits."""
    own = hashes(spark, d)
    bit = lambda n: F.expr(f"shiftleft(1L, cast(id % {n} as int))")
    one = own.select((F.col("id") + 1_000_000_000).alias("id"), F.col("low").bitwiseXOR(bit(31)).alias("low"), "high")
    three = own.select((F.col("id") + 2_000_000_000).alias("id"), F.col("low").bitwiseXOR(bit(29)).alias("low"), F.col("high").bitwiseXOR(bit(13) * 3).alias("high"))
    return own.unionByName(one).unionByName(three)


NEAR_COPIES = """, copies AS (SELECT * FROM hashes UNION ALL SELECT id + 1000000000, xor(low, 1::BIGINT << (id % 31)::INT), high FROM hashes
  UNION ALL SELECT id + 2000000000, xor(low, 1::BIGINT << (id % 29)::INT), xor(high, 3::BIGINT << (id % 13)::INT) FROM hashes)"""


def _drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, square) of (doc_id, text): each text is turned into code points once."""
    for whole in batches:
        for begin in range(0, whole.num_rows, 1000):
            batch = whole.slice(begin, 1000)
            points = [np.frombuffer(t.as_py().encode("utf-32-le"), np.uint32) for t in batch.column("text")]
            flat = [p[np.arange(1024) * len(p) // 1024] % 256 for p in points]
            values = pa.array(np.concatenate(flat).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * 1024), values)], ["doc_id", "square"])


def pixel_hash(spark, d) -> DataFrame:
    """Perceptual hashes of texts drawn as squares: 1,024 characters at even steps are the luminances."""
    docs = v.table(spark, d, "documents").filter("length(text) > 0").select(F.col("doc_id").cast("long"), "text")
    hashed = images.pixel_hashes(docs.mapInArrow(_drawn, "doc_id long, square array<int>"), "square")
    return hashed.select("doc_id", images.hash_digits(F.col("low"), F.col("high")).alias("phash"))


PIXEL_HASH = """WITH px AS (SELECT doc_id, k % 32 AS x, k // 32 AS y, unicode(substr(text, (k * length(text)) // 1024 + 1, 1)) % 256 AS p FROM documents, range(1024) t(k) WHERE length(text) > 0),
m AS (SELECT k, x, cos(pi() * (2 * x + 1) * k / 64) * CASE WHEN k = 0 THEN sqrt(1 / 32) ELSE sqrt(2 / 32) END AS c FROM range(8) a(k), range(32) b(x)),
across AS (SELECT doc_id, y, k AS v, sum(p * c) AS s FROM px JOIN m USING (x) GROUP BY ALL),
low AS (SELECT doc_id, 8 * k + v AS i, round(sum(s * c), 6) AS f FROM across JOIN m ON m.x = across.y GROUP BY ALL),
mid AS (SELECT doc_id, median(f) AS middle FROM low WHERE i > 0 GROUP BY doc_id),
halves AS (SELECT doc_id, sum(CASE WHEN f > middle AND i < 32 THEN 1::BIGINT << i::INT ELSE 0 END)::BIGINT AS low, sum(CASE WHEN f > middle AND i >= 32 THEN 1::BIGINT << (i - 32)::INT ELSE 0 END)::BIGINT AS high FROM low JOIN mid USING (doc_id) GROUP BY doc_id)
SELECT doc_id, lpad(lower(to_hex(high)), 8, '0') || lpad(lower(to_hex(low)), 8, '0') AS phash FROM halves"""


def image_rows(spark, d) -> DataFrame:
    """Vectors as images: their rounded values stand for their pixels, the hash halves for the content."""
    rows = hashes(spark, d).join(v.vectors(spark, d), "id")
    # Spark's round drops the sign of what becomes 0, SQL's keeps it: -0.0 and 0.0 are different pixels
    tenths = lambda x: F.when(F.round(x, 1) == 0, x * F.lit(0.0).cast("float")).otherwise(F.round(x, 1))
    text = F.concat_ws(",", F.transform("embedding", lambda x: tenths(x).cast("string")))
    return rows.select("id", F.sha2(F.concat_ws("-", F.col("low").cast("string"), F.col("high").cast("string")), 256).alias("sha256"), F.sha2(text, 256).alias("pixel_sha256"), "low", "high", (F.col("id") % 29 != 0).alias("decode_ok"))


def review(spark, d) -> DataFrame:
    """Document pairs with splits and a review that is yes, no or blank."""
    split = lambda c: F.when(F.col(c) % 5 == 0, "Test").otherwise("Train")
    status = F.when(F.col("id_a") % 3 == 0, " Yes").when(F.col("id_a") % 3 == 1, "no")
    return doc_pairs(spark, d).select("id_a", "id_b", (F.col("id_b") % 2 == 0).alias("pixel_identical"), status.alias("verified_related"), split("id_a").alias("split_a"), split("id_b").alias("split_b"))


REVIEW = DOC_PAIRS + """, review AS (SELECT id_a, id_b, id_b % 2 = 0 AS pixel_identical, CASE id_a % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE '' END AS status, CASE WHEN id_a % 5 = 0 THEN 'Test' ELSE 'Train' END AS split_a, CASE WHEN id_b % 5 = 0 THEN 'Test' ELSE 'Train' END AS split_b,
  id_a IN (SELECT doc_id FROM documents WHERE lang = 'en') AND id_b IN (SELECT doc_id FROM documents WHERE lang = 'en') AS inside FROM doc_pairs)"""


def cohort(spark, d) -> DataFrame:
    return v.table(spark, d, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("id"))


def entities(spark, d) -> DataFrame:
    """Documents' hosts as entities: source and a number; some are unknown."""
    entity = F.when(F.col("doc_id") % 10 == 0, "Unknown").otherwise(F.concat_ws("-", "source", (F.col("doc_id") % 40).cast("string")))
    return v.table(spark, d, "documents").select(F.col("doc_id").alias("id"), entity.alias("entity"))


ENTITIES = "entities AS (SELECT doc_id AS id, source || '-' || (doc_id % 40) AS entity FROM documents WHERE doc_id % 10 <> 0)"


def components(spark, d) -> DataFrame:
    edges = duplicates.copy_edges(v.table(spark, d, "documents"), "doc_id", F.col("text")).union(duplicates.star_edges(entities(spark, d)))
    nodes = v.table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    return duplicates.connected_components(spark, nodes, edges)


COMPONENTS = "WITH RECURSIVE " + DOC_PAIRS + ", " + ENTITIES + """
, stars AS (SELECT id AS a, min(id) OVER (PARTITION BY entity) AS b FROM entities)
, edges AS (SELECT id_a AS a, id_b AS b FROM doc_pairs UNION SELECT id_b, id_a FROM doc_pairs UNION SELECT a, b FROM stars UNION SELECT b, a FROM stars)
, reach(id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.id, edges.b FROM reach JOIN edges ON reach.other = edges.a)
SELECT id, min(other) AS cluster FROM reach GROUP BY id"""


def serialized(spark, d) -> DataFrame:
    """Nested counts in cells, as result files hold them; one cell is hostile, one impossible."""
    rows = order_rows(spark, d).filter("attribute in ('c_mktsegment', 'r_name') and model is not null")
    per = rows.groupBy("model", "attribute", "group").agg(F.count_if(F.col("y_true") == F.col("y_pred")).alias("k"), F.count(F.lit(1)).alias("n"))
    pair = F.concat(F.lit("'"), F.col("group"), F.lit("': (np.int64("), F.col("k"), F.lit("), np.int64("), F.col("n"), F.lit("))"))
    axis = per.groupBy("model", "attribute").agg(F.array_join(F.array_sort(F.collect_list(pair)), ", ").alias("groups"))
    cell = F.concat(F.lit("'"), F.col("attribute"), F.lit("': {"), F.col("groups"), F.lit("}"))
    cells = axis.groupBy("model").agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(cell)), ", "), F.lit("}")).alias("pooled_groups"))
    bad = spark.createDataFrame([("hostile", "__import__('os').system('x')"), ("impossible", "{'a': {'x': (np.int64(3), np.int64(2))}}")], "model string, pooled_groups string")
    return cells.unionByName(bad)


def nested(spark, d) -> DataFrame:
    return profile.parse_counts(serialized(spark, d), "pooled_groups").drop("pooled_groups")


NESTED = ORDER_ROWS + """, nested AS (SELECT model, attribute, "group", count(*) FILTER (y_true = y_pred) AS correct, count(*) AS n FROM axis_rows WHERE attribute IN ('c_mktsegment', 'r_name') GROUP BY ALL)"""

FOLD_METRICS = W + v.PRED_ORDERS + ", f AS (SELECT model, fold, avg((y_true = y_pred)::INT) AS accuracy, avg((y_true = 'F')::INT) AS share_f FROM pred_orders GROUP BY ALL)"


def fold_metrics(spark, d) -> DataFrame:
    return v.pred_orders(spark, d).groupBy("model", "fold").agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy"), F.avg((F.col("y_true") == "F").cast("double")).alias("share_f"))


def accounting_check(spark, d) -> DataFrame:
    """Counts by fold and axis against the fold's accuracy; one group of fold 3 is off by one."""
    rows = v.pred_orders(spark, d).select("model", "fold", "y_true", "y_pred", F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).alias("group")) for a in ("c_mktsegment", "r_name")])).alias("x"))
    counts = rows.groupBy("model", "fold", "x.attribute", "x.group").agg(F.count_if(F.col("y_true") == F.col("y_pred")).alias("correct"), F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("n", F.col("n") + ((F.col("fold") == 3) & (F.col("group") == "ASIA")).cast("long"))
    return contracts.accounting_violations(counts.join(fold_metrics(spark, d), ["model", "fold"])).select("model", "fold", "n_min", "n_max", "k_min", "k_max")


def history(spark, d) -> DataFrame:
    rows = v.table(spark, d, "events").select((F.col("user_id") % 10).alias("run"), F.col("event_id").alias("epoch"), F.round("value", 2).alias("loss"))
    return profile.early_stopping(rows)


def _digest_tree(row: str, deepest: int = 8) -> str:
    """Digests level by level; rows enter at the level that their number asks for."""
    sql = f"""WITH e AS (SELECT sha256({row}) AS h, count(*) AS n FROM customer GROUP BY 1), size AS (SELECT greatest(1, ceil(log(count(*) / {profile.LEAF}) / log(16)))::INT AS depth FROM e)"""
    for level in range(deepest, -1, -1):
        above = f" UNION ALL SELECT prefix[1:{level}] AS prefix, prefix || ':' || digest AS part, n FROM t{level + 1}" if level < deepest else ""
        sql += f""", t{level} AS (SELECT prefix, sha256(string_agg(part, ',' ORDER BY part)) AS digest, sum(n)::BIGINT AS n FROM (SELECT h[1:{level}] AS prefix, h || ':' || n AS part, n FROM e, size WHERE depth = {level}{above}) GROUP BY prefix)"""
    return sql + " SELECT n AS rows, digest FROM t0"


DIGEST_TREE = _digest_tree("concat_ws(chr(31), c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment)")


QUERIES = {
    "proxy_binning": (
        lambda s, d: v.audit_meta(s, d).select("sample_id", "age_proxy", "age_group_model", "age_display_legacy"),
        META + " SELECT sample_id, age_proxy, age_group_model, age_display_legacy FROM audit_meta",
    ),
    "value_mapping": (
        lambda s, d: v.audit_meta(s, d).select("sample_id", "gender_raw", "gender_proxy", "appearance_raw", "appearance_proxy", "composite_proxy"),
        META + " SELECT sample_id, gender_raw, gender_proxy, appearance_raw, appearance_proxy, composite_proxy FROM audit_meta",
    ),
    "observed_mapping": (
        lambda s, d: profile.observed_mapping(v.audit_meta(s, d), {"gender_raw": "gender_proxy", "appearance_raw": "appearance_proxy"}),
        META + ", o AS (SELECT unnest(['gender_proxy', 'appearance_proxy']) AS attribute, unnest([gender_raw, appearance_raw]) AS raw_label, unnest([gender_proxy, appearance_proxy]) AS final_label FROM audit_meta) SELECT attribute, raw_label, final_label, count(*) AS n FROM o GROUP BY ALL",
    ),
    "crosstab_axes": (
        lambda s, d: profile.crosstabs(v.audit_meta(s, d), [("age_proxy", "gender_proxy"), ("gender_proxy", "appearance_proxy"), ("label", "age_proxy")]),
        META + """, o AS (SELECT unnest(['age_proxy', 'gender_proxy', 'label']) AS "left", unnest(['gender_proxy', 'appearance_proxy', 'age_proxy']) AS "right", unnest([age_proxy, gender_proxy, label]) AS a, unnest([gender_proxy, appearance_proxy, age_proxy]) AS b FROM audit_meta)
          SELECT x."left", x."right", x.a, y.b, (SELECT count(*) FROM o WHERE o."left" = x."left" AND o.a = x.a AND o.b = y.b) AS n FROM (SELECT DISTINCT "left", "right", a FROM o) x JOIN (SELECT DISTINCT "left", b FROM o) y ON x."left" = y."left" """,
    ),
    "dataset_accounting": (
        lambda s, d: profile.accounting(v.audit_meta(s, d).withColumn("ok", F.col("sample_id") % 31 != 0), "sample_id", "ok", ["age_proxy", "gender_proxy"]),
        META + " SELECT 'rows' AS stage, count(*) AS n FROM audit_meta UNION ALL SELECT 'decode success', count(*) FROM audit_meta WHERE sample_id % 31 <> 0 UNION ALL SELECT 'decode failures', count(*) FROM audit_meta WHERE sample_id % 31 = 0 UNION ALL SELECT 'unique ids', count(DISTINCT sample_id) FROM audit_meta UNION ALL SELECT 'age_proxy: ' || age_proxy, count(*) FROM audit_meta GROUP BY age_proxy UNION ALL SELECT 'gender_proxy: ' || gender_proxy, count(*) FROM audit_meta GROUP BY gender_proxy",
    ),
    "numeric_profile_median": (
        lambda s, d: profile.numeric_profile(v.audit_meta(s, d), "age_proxy", ["p_size", "p_retailprice"]),
        META + f', o AS (SELECT age_proxy, unnest([\'p_size\', \'p_retailprice\']) AS "column", unnest([p_size::DOUBLE, p_retailprice]) AS x FROM audit_meta) SELECT age_proxy, "column", count(x) AS count, {R("median(x)", "median")}, {R("min(x)", "min")}, {R("max(x)", "max")} FROM o GROUP BY ALL',
    ),
    "path_parts": (
        lambda s, d: v.dirty_meta(s, d).select("sample_id", *[c.alias(n) for n, c in cleaning.path_parts(cleaning.without_prefix(F.col("filepath"), "data\\")).items()], cleaning.safe_name(F.col("label")).alias("safe")),
        META + PATHS + r" SELECT sample_id, CASE WHEN n >= 3 THEN parts[1] ELSE 'unknown' END AS archive_split, CASE WHEN n >= 2 THEN parts[n - 1] ELSE 'unknown' END AS archive_label, lower(parts[n]) AS basename, regexp_replace(label, '[^\p{L}\p{N}_-]', '_', 'g') AS safe FROM p",
    ),
    "class_folders": (
        lambda s, d: tables.class_folders(v.dirty_meta(s, d).select("sample_id", *[c.alias(n) for n, c in cleaning.path_parts(cleaning.without_prefix(F.col("filepath"), "data\\")).items()])).select("sample_id", "archive_label", "class_id"),
        META + PATHS + " SELECT sample_id, CASE WHEN n >= 2 THEN parts[n - 1] ELSE 'unknown' END AS archive_label, (dense_rank() OVER (ORDER BY CASE WHEN n >= 2 THEN parts[n - 1] ELSE 'unknown' END) - 1)::INT AS class_id FROM p",
    ),
    "ambiguous_basenames": (
        lambda s, d: contracts.ambiguous_basenames(v.dirty_meta(s, d).select(cleaning.path_parts(F.col("filepath"))["basename"].alias("basename")), "basename"),
        META + r" SELECT lower(string_split(replace(filepath, '\', '/'), '/')[-1]) AS basename, count(*) AS n FROM dirty_meta GROUP BY 1 HAVING count(*) > 1",
    ),
    "exact_duplicates": (doc_pairs, W + DOC_PAIRS + " SELECT * FROM doc_pairs"),
    "exact_duplicate_groups": (
        lambda s, d: duplicates.exact_groups(v.table(s, d, "documents"), "doc_id", F.col("text")),
        "SELECT doc_id AS id, min(doc_id) OVER w AS first_id, count(*) OVER w AS copies FROM documents WHERE text IS NOT NULL WINDOW w AS (PARTITION BY text) QUALIFY count(*) OVER w > 1",
    ),
    "fingerprint64": (hashes, W + HASHES + " SELECT id, low, high FROM hashes"),
    "hamming_pairs": (
        lambda s, d: duplicates.hamming_pairs(hashes(s, d), 20),
        W + HASHES + f" SELECT a.id AS id_a, b.id AS id_b, {HAMMING} AS distance FROM hashes a JOIN hashes b ON a.id < b.id WHERE {HAMMING} <= 20",
    ),
    "hamming_near_copies": (
        lambda s, d: duplicates.hamming_pairs(near_copies(s, d), 6),
        W + HASHES + NEAR_COPIES + f" SELECT a.id AS id_a, b.id AS id_b, {HAMMING} AS distance FROM copies a JOIN copies b ON a.id < b.id WHERE {HAMMING} <= 6",
    ),
    "document_pixel_hash": (pixel_hash, PIXEL_HASH),
    "hamming_pairs_banded": (
        lambda s, d: duplicates.hamming_pairs(hashes(s, d), 15, bands=4),
        W + HASHES + f" SELECT a.id AS id_a, b.id AS id_b, {HAMMING} AS distance FROM hashes a JOIN hashes b ON a.id < b.id WHERE {HAMMING} <= 15",
    ),
    "candidate_pairs": (
        lambda s, d: duplicates.candidate_pairs(image_rows(s, d), 15),
        W + HASHES + f""", images AS (SELECT h.id, low, high, array_to_string([round(x, 1)::VARCHAR FOR x IN embedding], ',') AS pixels FROM hashes h JOIN embeddings ON vec_id = h.id WHERE h.id % 29 <> 0)
SELECT id_a, id_b, byte_identical, pixel_identical, distance, CASE WHEN pixel_identical THEN 'yes' ELSE '' END AS verified_related, CASE WHEN pixel_identical THEN 'exact decoded pixels' ELSE 'CANDIDATE ONLY; visual/source review required' END AS review_reason
FROM (SELECT a.id AS id_a, b.id AS id_b, a.low = b.low AND a.high = b.high AS byte_identical, a.pixels = b.pixels AS pixel_identical, {HAMMING} AS distance FROM images a JOIN images b ON a.id < b.id)
WHERE distance <= 15 OR pixel_identical""",
    ),
    "numbered_pairs": (
        lambda s, d: duplicates.numbered_pairs(duplicates.hamming_pairs(hashes(s, d), 18).withColumn("exact", F.col("id_b") % 2 == 0), "exact", "distance"),
        W + HASHES + f", p AS (SELECT a.id AS id_a, b.id AS id_b, {HAMMING} AS distance, b.id % 2 = 0 AS exact FROM hashes a JOIN hashes b ON a.id < b.id WHERE {HAMMING} <= 18) SELECT *, row_number() OVER (ORDER BY exact DESC, distance, id_a, id_b) AS pair_id FROM p",
    ),
    "cohort_semi_join": (
        lambda s, d: duplicates.within_cohort(doc_pairs(s, d), cohort(s, d)),
        W + DOC_PAIRS + " SELECT id_a, id_b FROM doc_pairs WHERE id_a IN (SELECT doc_id FROM documents WHERE lang = 'en') AND id_b IN (SELECT doc_id FROM documents WHERE lang = 'en')",
    ),
    "cross_role_leakage": (
        lambda s, d: duplicates.cross_role_pairs(doc_pairs(s, d), doc_manifest(s, d)),
        W + DOC_PAIRS + ", " + DOC_MANIFEST + " SELECT id_a, id_b, a.fold, a.role AS role_a, b.role AS role_b FROM doc_pairs JOIN manifest a ON a.id = id_a JOIN manifest b ON b.id = id_b AND b.fold = a.fold WHERE a.role <> b.role",
    ),
    "entity_leakage": (
        lambda s, d: duplicates.entities_across_roles(entities(s, d), doc_manifest(s, d), "host"),
        W + ENTITIES + ", " + DOC_MANIFEST + " SELECT 'host' AS identifier, entity AS value, fold, string_agg(DISTINCT role, '|' ORDER BY role) AS roles, count(*) AS n FROM manifest JOIN entities USING (id) GROUP BY entity, fold HAVING count(DISTINCT role) > 1",
    ),
    "review_summary": (
        lambda s, d: duplicates.review_summary(review(s, d), cohort(s, d)),
        W + REVIEW + " SELECT count(*) AS candidates, count(*) FILTER (pixel_identical) AS exact_pairs, count(*) FILTER (pixel_identical AND split_a <> split_b) AS cross_split_exact_pairs, count(*) FILTER (inside) AS cohort_candidates, count(*) FILTER (inside AND pixel_identical) AS cohort_exact_pairs, count(*) FILTER (inside AND status = 'yes') AS reviewed_yes, count(*) FILTER (inside AND status = 'no') AS reviewed_no, count(*) FILTER (inside AND status = '') AS unresolved FROM review",
    ),
    "review_violations": (lambda s, d: duplicates.review_violations(review(s, d)), W + REVIEW + " SELECT id_a, id_b, status FROM review WHERE status = ''"),
    "connected_components": (components, COMPONENTS),
    "nested_counts": (
        nested,
        NESTED + """ SELECT model, attribute, "group", correct, n, true AS valid FROM nested UNION ALL SELECT 'hostile', NULL, NULL, NULL, NULL, false UNION ALL SELECT 'impossible', 'a', 'x', 3, 2, false""",
    ),
    "nested_counts_merge": (
        lambda s, d: profile.merge_counts(nested(s, d)),
        NESTED + f""", m AS (SELECT attribute, "group", sum(correct)::BIGINT AS correct, sum(n)::BIGINT AS n FROM nested GROUP BY ALL) SELECT attribute, "group", correct, n, {R("correct / n::DOUBLE", "accuracy")}, {_bounds(("correct", "n", "wilson"))} FROM m""",
    ),
    "metric_mean_sd": (
        lambda s, d: profile.metric_summary(fold_metrics(s, d), ["accuracy", "share_f"], "model"),
        FOLD_METRICS + f", long AS (SELECT model, unnest(['accuracy', 'share_f']) AS metric, unnest([accuracy, share_f]) AS x FROM f) SELECT model, metric, {R('avg(x)', 'mean')}, {R('stddev_samp(x)', 'sample_sd')}, {R('stddev_pop(x)', 'population_sd')}, count(x) AS n_folds FROM long GROUP BY ALL",
    ),
    "accounting_violations": (
        accounting_check,
        W + v.PRED_ORDERS + """, long AS (SELECT model, fold, unnest(['c_mktsegment', 'r_name']) AS attribute, unnest([c_mktsegment, r_name]) AS "group", (y_true = y_pred)::INT AS hit FROM pred_orders)
          , g AS (SELECT model, fold, attribute, "group", sum(hit) AS k, count(*) + CASE WHEN fold = 3 AND "group" = 'ASIA' THEN 1 ELSE 0 END AS n FROM long GROUP BY model, fold, attribute, "group"), a AS (SELECT model, fold, attribute, sum(k) AS k, sum(n) AS n FROM g GROUP BY ALL)
          SELECT model, fold, min(n)::BIGINT AS n_min, max(n)::BIGINT AS n_max, min(k)::BIGINT AS k_min, max(k)::BIGINT AS k_max FROM a GROUP BY ALL HAVING min(n) <> max(n) OR min(k) <> max(k)""",
    ),
    "duplicate_keys": (
        lambda s, d: contracts.duplicate_keys(v.table(s, d, "lineitem"), "l_orderkey", "l_suppkey"),
        "SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    ),
    "referential_violations": (
        lambda s, d: contracts.unreferenced(v.table(s, d, "labels"), v.table(s, d, "documents").filter("lang <> 'fr'"), "doc_id"),
        "SELECT doc_id, 'left' AS only_in FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents WHERE lang <> 'fr') UNION ALL SELECT doc_id, 'right' FROM (SELECT doc_id FROM documents WHERE lang <> 'fr' EXCEPT SELECT doc_id FROM labels)",
    ),
    "table_fingerprint": (
        lambda s, d: profile.table_fingerprint(v.table(s, d, "customer"), v.table(s, d, "customer").columns),
        DIGEST_TREE,
    ),
    "early_stopping": (
        history,
        f"""WITH RECURSIVE h AS (SELECT user_id % 10 AS run, event_id AS epoch, round(value, 2) AS loss, row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) AS place FROM events)
, walk(run, place, epoch, best_epoch, best_loss, patience) AS (
  SELECT run, place, epoch, epoch, loss, 0 FROM h WHERE place = 1
  UNION ALL
  SELECT h.run, h.place, h.epoch, CASE WHEN h.loss < best_loss THEN h.epoch ELSE best_epoch END, CASE WHEN h.loss < best_loss THEN h.loss ELSE best_loss END, CASE WHEN h.loss < best_loss THEN 0 ELSE patience + 1 END
  FROM walk JOIN h ON h.run = walk.run AND h.place = walk.place + 1 WHERE patience < 20)
SELECT run, best_epoch, {R('best_loss', 'best_loss')}, epoch AS stop_epoch FROM walk QUALIFY row_number() OVER (PARTITION BY run ORDER BY place DESC) = 1""",
    ),
}
