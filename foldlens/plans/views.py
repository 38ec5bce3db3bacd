"""Prediction, metadata and manifest views derived from the fixture tables, in both dialects.

No fixture table holds predictions, folds or images, so each is derived by a fixed rule:
hashes of ids stand for a model's errors and confidences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cleaning import composite
from ..operators import folds

STATUS = ["F", "O", "P"]
AXES = ["c_mktsegment", "r_name", "o_orderpriority", "composite"]
DIGITS = [str(d) for d in range(10)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def uniform(text: Column, start: int) -> Column:
    """A number in [0, 1) from 8 hexadecimal digits of md5(text)."""
    return F.conv(F.substring(F.md5(text), start, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def pred_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of models a and b for the orders' status, with four axes."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region")
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    models = F.explode(F.array(F.struct(F.lit("a").alias("model"), F.lit(0.85).alias("keep")), F.struct(F.lit("b").alias("model"), F.lit(0.75).alias("keep"))))
    rows = rows.select("*", models.alias("m"))
    name = F.concat_ws("|", F.col("m.model"), F.col("o_orderkey").cast("string"))
    after = F.when(F.col("o_orderstatus") == "F", "O").when(F.col("o_orderstatus") == "O", "P").otherwise("F")
    rows = rows.withColumns(
        {
            "y_pred": F.when(uniform(name, 1) < F.col("m.keep"), F.col("o_orderstatus")).otherwise(after),
            "conf": 0.4 + 0.6 * uniform(name, 9),
        }
    )
    p = F.array(*[F.when(F.col("y_pred") == s, F.col("conf")).otherwise((1 - F.col("conf")) / 2) for s in STATUS])
    return rows.select(
        F.col("m.model").alias("model"), F.col("o_orderkey").alias("sample_id"), (F.col("o_orderkey") % 7 + 1).cast("int").alias("fold"),
        F.col("o_orderstatus").alias("y_true"), "y_pred", p.alias("p"), "c_mktsegment", "r_name", "o_orderpriority",
        composite(F.col("c_mktsegment"), F.col("r_name"), F.col("o_orderpriority")).alias("composite"),
    )


PRED_ORDERS = """pred_orders AS (
  SELECT model, sample_id, fold, y_true, y_pred, [CASE WHEN y_pred = 'F' THEN conf ELSE (1 - conf) / 2 END, CASE WHEN y_pred = 'O' THEN conf ELSE (1 - conf) / 2 END, CASE WHEN y_pred = 'P' THEN conf ELSE (1 - conf) / 2 END] AS p,
         c_mktsegment, r_name, o_orderpriority, c_mktsegment || '|' || r_name || '|' || o_orderpriority AS composite
  FROM (SELECT model, o_orderkey AS sample_id, (o_orderkey % 7 + 1)::INT AS fold, o_orderstatus AS y_true,
               CASE WHEN ('0x' || substr(h, 1, 8))::BIGINT / 4294967296.0::DOUBLE < keep THEN o_orderstatus WHEN o_orderstatus = 'F' THEN 'O' WHEN o_orderstatus = 'O' THEN 'P' ELSE 'F' END AS y_pred,
               0.4::DOUBLE + 0.6::DOUBLE * (('0x' || substr(h, 9, 8))::BIGINT / 4294967296.0::DOUBLE) AS conf, c_mktsegment, r_name, o_orderpriority
        FROM (SELECT *, md5(model || '|' || o_orderkey) AS h FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
              CROSS JOIN (VALUES ('a', 0.85::DOUBLE), ('b', 0.75::DOUBLE)) m(model, keep)))
)"""

ORDER_AXES = """axis_rows AS (
  SELECT model, 'all' AS scope, unnest(['c_mktsegment', 'r_name', 'o_orderpriority', 'composite']) AS attribute, unnest([c_mktsegment, r_name, o_orderpriority, composite]) AS "group", y_true, y_pred FROM pred_orders
)"""


def pred_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small unbalanced table: is a document good, told by its length alone."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    rows = table(spark, sf_dir, "labels").join(docs, "doc_id")
    return rows.select(
        F.lit("length").alias("model"), F.col("doc_id").alias("sample_id"), (F.col("doc_id") % 7 + 1).cast("int").alias("fold"), F.col("quality").cast("string").alias("y_true"),
        (F.col("n_chars") >= 400).cast("int").cast("string").alias("y_pred"), "lang", "source", F.col("toxic").cast("string").alias("toxic"),
    )


PRED_DOCS = """pred_docs AS (
  SELECT 'length' AS model, doc_id AS sample_id, (doc_id % 7 + 1)::INT AS fold, quality::VARCHAR AS y_true, (n_chars >= 400)::INT::VARCHAR AS y_pred, lang, source, toxic::VARCHAR AS toxic
  FROM labels JOIN documents USING (doc_id)
)"""
DOC_AXES = """axis_rows AS (
  SELECT model, scope, attribute, "group", y_true, y_pred FROM (
    SELECT model, unnest(['lang', 'source', 'toxic']) AS attribute, unnest([lang, source, toxic]) AS "group", ['all', 'route=' || lang] AS scopes, y_true, y_pred FROM pred_docs), unnest(scopes) AS s(scope)
)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("label"), "embedding")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven stratified folds of the vectors with validation rows."""
    return folds.manifest(folds.stratified_folds(vectors(spark, sf_dir), "id", "label"))


FOLDS = """folds AS (
  SELECT vec_id AS id, label::INT AS label, ((row_number() OVER (ORDER BY label, md5('42|' || vec_id), vec_id) - 1) % 7 + 1)::INT AS fold FROM embeddings
)"""
MANIFEST = (
    FOLDS
    + """, runs AS (SELECT id, label, folds.fold AS own, f.fold::INT AS fold FROM folds CROSS JOIN range(1, 8) f(fold)
), rest AS (SELECT * FROM runs WHERE own <> fold
), rest_sizes AS (SELECT fold, label, count(*) AS size, sum(count(*)) OVER (PARTITION BY fold) AS total FROM rest GROUP BY fold, label
), rest_exact AS (SELECT *, ceil(round(total * 0.175::DOUBLE, 9))::BIGINT AS wanted FROM rest_sizes
), rest_base AS (SELECT *, wanted * size / total::DOUBLE AS exact FROM rest_exact
), rest_rank AS (
  SELECT *, row_number() OVER (PARTITION BY fold ORDER BY round(exact - floor(exact), 9) DESC, label) AS place, wanted - sum(floor(exact)) OVER (PARTITION BY fold) AS leftover FROM rest_base
), takes AS (SELECT fold, label, floor(exact)::BIGINT + CASE WHEN place <= leftover THEN 1 ELSE 0 END AS take FROM rest_rank
), manifest AS (
  SELECT id, label, fold, CASE WHEN place <= take THEN 'Val' ELSE 'Train' END AS role
  FROM (SELECT *, row_number() OVER (PARTITION BY fold, label ORDER BY md5((42 + fold) || '|' || id), id) AS place FROM rest) JOIN takes USING (fold, label)
  UNION ALL SELECT id, label, fold, 'Test' FROM runs WHERE own = fold
)"""
)


def raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two raters of the documents' quality; some ratings are blank."""
    return pred_docs(spark, sf_dir).select(
        "sample_id", F.when(F.col("sample_id") % 17 == 0, " ").otherwise(F.col("y_true")).alias("rater_a"), F.col("y_pred").alias("rater_b")
    )


RATERS = PRED_DOCS + """, raters AS (SELECT sample_id, CASE WHEN sample_id % 17 = 0 THEN ' ' ELSE y_true END AS rater_a, y_pred AS rater_b FROM pred_docs
), rated AS (SELECT sample_id, trim(rater_a) AS y_true, trim(rater_b) AS y_pred FROM raters WHERE trim(rater_a) <> '' AND trim(rater_b) <> '')"""


def dirty_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw attributes of the parts: ages with gaps and impossible values, mixed-case categories."""
    key = F.col("p_partkey")
    age = F.when(key % 13 == 0, F.lit(None)).when(key % 17 == 0, "n/a").when(key % 19 == 0, "150").when(key % 11 == 0, "17.5").otherwise((F.col("p_size") * 2 - 1).cast("string"))
    gender = F.element_at(F.array(*[F.lit(x) for x in (" Man", "WOMAN", "female", "Other/Unclear", "", "robot", "unknown")]), (key % 7 + 1).cast("int"))
    look = F.element_at(F.array(*[F.lit(x) for x in ("White", " black ", "Asian", "INDIAN", "Latino Hispanic", "martian", "", "unclear")]), (key % 8 + 1).cast("int"))
    split = F.when(key % 7 < 2, "").when(key % 5 == 0, "Train/").when(key % 5 == 1, "Val/").otherwise("Test/")
    folder = F.when(key % 7 == 0, "").otherwise(F.concat("p_brand", F.lit("/")))  # some paths have two parts, some one
    path = F.concat(F.lit("data\\"), split, folder, F.lit("IMG_"), (key % 1000).cast("string"), F.lit(".PNG"))
    return table(spark, sf_dir, "part").select(key.alias("sample_id"), age.alias("age"), gender.alias("dominant_gender"), look.alias("dominant_race"), path.alias("filepath"), "p_size", "p_retailprice", F.col("p_brand").alias("label"))


DIRTY_META = r"""dirty_meta AS (
  SELECT p_partkey AS sample_id, CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 17 = 0 THEN 'n/a' WHEN p_partkey % 19 = 0 THEN '150' WHEN p_partkey % 11 = 0 THEN '17.5' ELSE (p_size * 2 - 1)::VARCHAR END AS age,
         [' Man', 'WOMAN', 'female', 'Other/Unclear', '', 'robot', 'unknown'][(p_partkey % 7 + 1)::INT] AS dominant_gender,
         ['White', ' black ', 'Asian', 'INDIAN', 'Latino Hispanic', 'martian', '', 'unclear'][(p_partkey % 8 + 1)::INT] AS dominant_race,
         'data\' || CASE WHEN p_partkey % 7 < 2 THEN '' WHEN p_partkey % 5 = 0 THEN 'Train/' WHEN p_partkey % 5 = 1 THEN 'Val/' ELSE 'Test/' END || CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_brand || '/' END || 'IMG_' || (p_partkey % 1000) || '.PNG' AS filepath, p_size, p_retailprice, p_brand AS label
  FROM part
), proxies AS (
  SELECT *, try_cast(age AS DOUBLE) AS years, lower(trim(coalesce(dominant_gender, ''))) AS g, lower(trim(coalesce(dominant_race, ''))) AS r FROM dirty_meta
), clean_meta AS (
  SELECT sample_id, label, p_size, p_retailprice, filepath,
         CASE WHEN years BETWEEN 0 AND 17 THEN '0-17' WHEN years > 17 AND years <= 59 THEN '18-59' WHEN years > 59 AND years <= 120 THEN '60+' ELSE 'missing' END AS age_proxy,
         CASE WHEN years <= -1 THEN 'nan' WHEN years <= 17 THEN 'child' WHEN years <= 29 THEN 'young_adult' WHEN years <= 44 THEN 'adult' WHEN years <= 64 THEN 'middle_aged' WHEN years <= 200 THEN 'senior' ELSE 'nan' END AS age_group_model,
         CASE WHEN g = '' THEN 'missing' ELSE g END AS gender_raw, CASE WHEN r = '' THEN 'missing' ELSE r END AS appearance_raw,
         CASE WHEN g IN ('man', 'male') THEN 'male' WHEN g IN ('woman', 'female') THEN 'female' WHEN g IN ('other/unclear', 'unclear') THEN 'unclear' WHEN g = 'unknown' THEN 'unknown' WHEN g IN ('', 'missing') THEN 'missing' ELSE 'unmapped' END AS gender_proxy,
         CASE WHEN r = '' THEN 'missing' WHEN r IN ('white', 'black', 'asian', 'indian', 'latino hispanic', 'middle eastern', 'unclear', 'unknown', 'missing') THEN r ELSE 'unmapped' END AS appearance_proxy
  FROM proxies
), audit_meta AS (
  SELECT *, CASE WHEN age_group_model = 'child' THEN '0-17' WHEN age_group_model IN ('young_adult', 'adult', 'middle_aged') THEN '18-59' WHEN age_group_model = 'senior' THEN '60+' ELSE 'unknown' END AS age_display_legacy,
         age_proxy || '|' || gender_proxy || '|' || appearance_proxy AS composite_proxy FROM clean_meta
)"""


def audit_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical attributes of ``dirty_meta``."""
    from ..functions import cleaning as c

    meta = dirty_meta(spark, sf_dir)
    gender, look = c.first_present(meta, ["dominant_gender", "gender"], "missing"), c.first_present(meta, ["dominant_race", "skin_tone"], "missing")
    out = meta.withColumns(
        {
            "age_proxy": c.age_proxy(F.col("age")),
            "age_group_model": c.age_group_model(F.col("age")),
            "gender_raw": c.normalized(gender),
            "appearance_raw": c.normalized(look),
            "gender_proxy": c.gender_proxy(gender),
            "appearance_proxy": c.appearance_proxy(look),
        }
    )
    return out.withColumns(
        {
            "age_display_legacy": c.age_display_legacy(F.col("age_group_model")),
            "composite_proxy": c.composite(F.col("age_proxy"), F.col("gender_proxy"), F.col("appearance_proxy")),
        }
    )
