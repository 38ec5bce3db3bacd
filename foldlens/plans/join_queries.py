"""Queries about joins of stated multiplicity, look-ups, reviews and copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cleaning
from ..functions.schedules import learning_rate
from ..operators import contracts, duplicates, joins, probe
from . import views as v
from .data_queries import DOC_MANIFEST, DOC_PAIRS, HAMMING, HASHES, META, NEAR_COPIES, doc_manifest, doc_pairs, near_copies
from .evaluation_queries import R, W


def lines_with_orders(spark, d) -> DataFrame:
    """Lines with their order's attributes; only even orders have any."""
    lines = v.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("order_id"), "l_linenumber", "l_quantity")
    orders = v.table(spark, d, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("order_id"), "o_orderstatus", "o_orderpriority")
    return joins.attach(lines, orders, "order_id")


def documents_with_labels(spark, d) -> DataFrame:
    docs = v.table(spark, d, "documents").select("doc_id", "lang", "source")
    return joins.attach(docs, v.table(spark, d, "labels"), "doc_id", validate="one_to_one")


def routed(spark, d) -> DataFrame:
    """Vectors with their route: the fold that tests them; every fifth has none and keeps 'unrouted'."""
    routes = v.manifest(spark, d).filter("role = 'Test' and id % 5 <> 0").select("id", F.concat(F.lit("route-"), F.col("fold")).alias("route"))
    rows = joins.attach(v.vectors(spark, d).select("id", "label"), routes, "id", validate="one_to_one")
    return rows.withColumn("route", F.coalesce("route", F.lit("unrouted")))


def rater_join(spark, d) -> DataFrame:
    """Two raters' tables with equal key sets, met one to one."""
    both = v.raters(spark, d)
    return joins.attach(both.select("sample_id", "rater_a"), both.select("sample_id", "rater_b"), "sample_id", validate="one_to_one", how="inner")


def resolved(spark, d) -> DataFrame:
    """Paths of the metadata among files of unique base names; every seventh file is absent."""
    number = F.col("p_partkey") % 1000
    files = v.table(spark, d, "part").select(number.alias("k")).distinct().filter("k % 7 <> 0").select(F.concat(F.lit("store/"), F.col("k") % 10, F.lit("/img_"), F.col("k"), F.lit(".png")).alias("file"))
    return joins.by_basename(v.dirty_meta(spark, d).select("sample_id", "filepath"), files, "filepath", "file").select("sample_id", "resolved")


def aligned(spark, d) -> DataFrame:
    """Labels in the order of the documents' lengths, with the place that carries the order."""
    docs = v.table(spark, d, "documents").select("doc_id", (-F.length("text")).alias("place"))
    return joins.align(docs, v.table(spark, d, "labels"), "doc_id", "place")


def fallbacks(spark, d) -> DataFrame:
    """Columns that a table may lack: the first that it has, else a constant."""
    meta = v.dirty_meta(spark, d)
    return meta.select(
        "sample_id", cleaning.first_present(meta, ["gender", "dominant_gender"], "missing").alias("gender"),
        cleaning.first_present(meta, ["label", "dominant_race"], "missing").alias("first"), cleaning.first_present(meta, ["skin_tone"], "missing").alias("skin"),
    )


def absent_references(spark, d) -> DataFrame:
    return contracts.first_examples(contracts.unreferenced(v.table(spark, d, "labels"), v.table(spark, d, "documents").filter("lang <> 'fr'"), "doc_id"), "doc_id", "only_in")


def sided_images(spark, d) -> DataFrame:
    """Vectors and near copies of each as images with split and label; a vector and its nearer copy share their pixels."""
    own, far = F.col("id") % 1_000_000_000, F.col("id") >= 2_000_000_000
    text = lambda *parts: F.sha2(F.concat_ws("-", *[p.cast("string") for p in parts]), 256)
    return near_copies(spark, d).select(
        "id", text(F.col("low"), F.col("high")).alias("sha256"), text(own, far).alias("pixel_sha256"), "low", "high", (own % 29 != 0).alias("decode_ok"),
        F.when(F.col("id") % 3 == 0, "Test").otherwise("Train").alias("archive_split"), F.concat(F.lit("class-"), own % 5).alias("archive_label"),
    )


SIDED = HASHES + NEAR_COPIES + """, images AS (SELECT id, low, high, (id % 1000000000) || '-' || (id >= 2000000000) AS pixels, CASE WHEN id % 3 = 0 THEN 'Test' ELSE 'Train' END AS split, 'class-' || (id % 1000000000 % 5) AS label FROM copies WHERE id % 1000000000 % 29 <> 0)"""


def stale(spark, d) -> DataFrame:
    """A review that misses some candidates, has some that are none, and some twice."""
    pairs = doc_pairs(spark, d)
    done = pairs.filter("id_a % 7 <> 0").unionByName(pairs.filter("id_b % 5 = 0 and id_a % 7 <> 0"))
    return duplicates.stale_reviews(done.unionByName(pairs.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b"))), pairs)


def block_sizes(spark, d) -> DataFrame:
    """The three inputs of a probe by row: widths (the unknown token has a place that stays 0), and sums of what isn't the image's."""
    rows = v.manifest(spark, d).select("id", "fold", "role").join(v.vectors(spark, d), "id").withColumn("value", F.concat(F.lit("v"), F.col("id") % 11))
    blocks = probe.feature_blocks(rows, "embedding", ["value"])
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return blocks.select(
        "id", "fold", "role", *[F.size(c).alias(f"{c}_width") for c in ("image_only", "metadata_only", "concat")], F.round(total("metadata_only"), 6).alias("ones"),
        F.round(total("concat") - total("image_only"), 6).alias("ones_of_concat"),
    )


BLOCK_SIZES = W + v.MANIFEST + """, own AS (SELECT id, fold, role, 'v' || (id % 11) AS value FROM manifest), vocab AS (SELECT DISTINCT fold, value FROM own WHERE role = 'Train'), widths AS (SELECT fold, (count(*) + 1)::INT AS w FROM vocab GROUP BY fold)
SELECT id, fold, role, 64::INT AS image_only_width, w AS metadata_only_width, (64 + w)::INT AS concat_width, (vocab.value IS NOT NULL)::INT::DOUBLE AS ones, (vocab.value IS NOT NULL)::INT::DOUBLE AS ones_of_concat FROM own JOIN widths USING (fold) LEFT JOIN vocab USING (fold, value)"""


QUERIES = {
    "attach_many_to_one": (
        lines_with_orders,
        "SELECT l_orderkey AS order_id, l_linenumber, l_quantity, o_orderstatus, o_orderpriority FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 2 = 0) ON l_orderkey = o_orderkey",
    ),
    "attach_one_to_one": (documents_with_labels, "SELECT doc_id, lang, source, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)"),
    "attach_routes": (
        routed,
        W + v.MANIFEST + " SELECT vec_id AS id, e.label::INT AS label, coalesce('route-' || fold, 'unrouted') AS route FROM embeddings e LEFT JOIN (SELECT id, fold FROM manifest WHERE role = 'Test' AND id % 5 <> 0) ON id = vec_id",
    ),
    "rater_join": (rater_join, W + v.RATERS + " SELECT sample_id, rater_a, rater_b FROM raters"),
    "basename_lookup": (
        resolved,
        META + " SELECT sample_id, CASE WHEN sample_id % 1000 % 7 <> 0 THEN 'store/' || (sample_id % 1000 % 10) || '/img_' || (sample_id % 1000) || '.png' END AS resolved FROM dirty_meta",
    ),
    "aligned_rows": (aligned, "SELECT doc_id, -length(text)::INT AS place, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)"),
    "optional_columns": (fallbacks, META + " SELECT sample_id, dominant_gender AS gender, label AS first, 'missing' AS skin FROM dirty_meta"),
    "first_examples": (
        absent_references,
        "SELECT * FROM (SELECT doc_id, 'left' AS only_in FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents WHERE lang <> 'fr') UNION ALL SELECT doc_id, 'right' FROM (SELECT doc_id FROM documents WHERE lang <> 'fr' EXCEPT SELECT doc_id FROM labels)) ORDER BY doc_id, only_in LIMIT 10",
    ),
    "candidate_pair_sides": (
        lambda s, d: duplicates.candidate_pairs(sided_images(s, d)),
        W + SIDED + f""" SELECT * FROM (SELECT a.id AS id_a, b.id AS id_b, a.low = b.low AND a.high = b.high AS byte_identical, a.pixels = b.pixels AS pixel_identical, {HAMMING} AS distance, CASE WHEN a.pixels = b.pixels THEN 'yes' ELSE '' END AS verified_related,
          CASE WHEN a.pixels = b.pixels THEN 'exact decoded pixels' ELSE 'CANDIDATE ONLY; visual/source review required' END AS review_reason, a.split AS split_a, b.split AS split_b, a.label AS label_a, b.label AS label_b FROM images a JOIN images b ON a.id < b.id) WHERE distance <= 6 OR pixel_identical""",
    ),
    "stale_reviews": (
        stale,
        W + DOC_PAIRS + """, done AS (SELECT id_a, id_b FROM doc_pairs WHERE id_a % 7 <> 0 UNION ALL SELECT id_a, id_b FROM doc_pairs WHERE id_a % 7 <> 0 AND id_b % 5 = 0 UNION ALL SELECT id_b, id_a FROM doc_pairs), r AS (SELECT id_a, id_b, count(*) AS n FROM done GROUP BY ALL)
          SELECT id_a, id_b, CASE WHEN c.id_c IS NULL THEN 'not a candidate' WHEN n IS NULL THEN 'not reviewed' ELSE 'reviewed twice' END AS problem FROM r FULL JOIN (SELECT id_a, id_b, id_a AS id_c FROM doc_pairs) c USING (id_a, id_b) WHERE c.id_c IS NULL OR n IS NULL OR n > 1""",
    ),
    "copies_across_roles": (
        lambda s, d: duplicates.copies_across_roles(v.table(s, d, "documents"), "doc_id", F.col("text"), doc_manifest(s, d)),
        W + DOC_MANIFEST + """, g AS (SELECT doc_id AS id, min(doc_id) OVER w AS first_id FROM documents WHERE text IS NOT NULL WINDOW w AS (PARTITION BY text) QUALIFY count(*) OVER w > 1)
          SELECT first_id, fold, string_agg(DISTINCT role, '|' ORDER BY role) AS roles, count(*) AS n FROM manifest JOIN g USING (id) GROUP BY first_id, fold HAVING count(DISTINCT role) > 1""",
    ),
    "probe_blocks": (block_sizes, BLOCK_SIZES),
    "learning_rate": (
        lambda s, d: v.table(s, d, "events").select("event_id", learning_rate(F.col("event_id"), 500, 8000, 0.001).alias("rate")),
        f"SELECT event_id, {R('CASE WHEN event_id < 500 THEN 0.001::DOUBLE * event_id / 500 ELSE 0.0005::DOUBLE * (1 + cos(pi() * least(1, (event_id - 500) / 7500::DOUBLE))) END', 'rate')} FROM events",
    ),
}
