"""Queries about folds, probes and permutation controls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import comparison, contracts, folds, probe
from . import views as v
from .evaluation_queries import D, R, W


def probe_rows(spark, d) -> DataFrame:
    """Vectors with fold, role and label, one row for each fold."""
    return v.manifest(spark, d).select("id", "fold", "role").join(v.vectors(spark, d), "id")


def clustered(spark, d) -> DataFrame:
    """Orders' lines as samples, clustered by order."""
    rows = v.table(spark, d, "lineitem")
    ident = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return rows.select(ident.alias("sample_id"), F.col("l_returnflag").alias("label"), F.col("l_orderkey").alias("order_id"))


def grouped(spark, d) -> DataFrame:
    return folds.grouped_folds(clustered(spark, d), "sample_id", "label", "order_id")


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with unique ids: some orders have a line number several times."""
    place = F.row_number().over(Window.partitionBy("sample_id").orderBy("label"))
    return rows.withColumn("sample_id", F.concat_ws("-", "sample_id", place.cast("string")))


def group_roles(rows: DataFrame) -> DataFrame:
    """A manifest that forgets the clusters: lines of one order land in several roles."""
    own = folds.stratified_folds(rows.withColumnRenamed("order_id", "cluster"), "sample_id", "label", keep=("cluster",))
    return folds.manifest(own, keep=("cluster",))


def grouped_violations(spark, d) -> DataFrame:
    """Violations over Train, Val and Test of all grouped folds: none."""
    return folds.role_violations(folds.grouped_manifest(grouped(spark, d)), folds.ROLES)


def by_customer(spark, d) -> DataFrame:
    """Lines in folds that keep customers together: larger clusters, nearly all with counts of their own."""
    rows = v.table(spark, d, "lineitem").join(v.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    ident = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return folds.grouped_folds(rows.select(ident.alias("sample_id"), F.col("l_returnflag").alias("label"), F.col("o_custkey").alias("customer")), "sample_id", "label", "customer")


def grouped_balance(own: DataFrame) -> DataFrame:
    """What grouped folds promise, by label: every line once, no cluster split, no fold far from a seventh."""
    per = own.groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n"))
    spread = per.groupBy("label").agg(F.sum("n").alias("lines"), F.count(F.lit(1)).alias("folds"), (F.max("n") - F.min("n") <= 0.02 * F.sum("n")).alias("even"))
    split = own.groupBy("cluster").agg(F.count_distinct("fold").alias("f")).agg(F.count_if(F.col("f") > 1).alias("split_clusters"))
    return spread.join(F.broadcast(split))


LINES = "lines AS (SELECT l_orderkey || '-' || l_linenumber || '-' || row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_returnflag) AS id, l_returnflag AS label, l_orderkey AS cluster FROM lineitem)"
LINE_MANIFEST = LINES + ", " + v.MANIFEST.replace("SELECT vec_id AS id, label::INT AS label, ((row_number() OVER (ORDER BY label, md5('42|' || vec_id), vec_id) - 1) % 7 + 1)::INT AS fold FROM embeddings", "SELECT id, label, ((row_number() OVER (ORDER BY label, md5('42|' || id), id) - 1) % 7 + 1)::INT AS fold FROM lines")
CROSSED = " SELECT cluster, fold, string_agg(DISTINCT role, '|' ORDER BY role) AS roles, count(*) AS n FROM manifest JOIN lines USING (id) GROUP BY cluster, fold HAVING count(DISTINCT role) > 1"


def vocabulary_rows(spark, d) -> DataFrame:
    docs = v.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("value"), F.col("lang").alias("label"))
    own = folds.stratified_folds(docs, "id", "label")
    return folds.manifest(own).join(docs.select("id", "value"), "id")


DOC_FOLDS = v.MANIFEST.replace(
    "SELECT vec_id AS id, label::INT AS label, ((row_number() OVER (ORDER BY label, md5('42|' || vec_id), vec_id) - 1) % 7 + 1)::INT AS fold FROM embeddings",
    "SELECT doc_id AS id, lang AS label, ((row_number() OVER (ORDER BY lang, md5('42|' || doc_id), doc_id) - 1) % 7 + 1)::INT AS fold FROM documents",
)
VOCAB = W + DOC_FOLDS + ", own AS (SELECT m.*, source AS value FROM manifest m JOIN documents ON doc_id = id), vocab AS (SELECT fold, value, row_number() OVER (PARTITION BY fold ORDER BY value) AS code FROM (SELECT DISTINCT fold, value FROM own WHERE role = 'Train' AND value IS NOT NULL))"


def encoded(rows: DataFrame) -> DataFrame:
    # values that training has not seen must meet the unknown token
    rows = rows.withColumn("value", F.when((F.col("role") == "Test") & (F.col("id") % 5 == 0), "unseen").otherwise(F.col("value")))
    return probe.encode(rows, "value").select("id", "fold", "role", "code")


def one_hot_sizes(rows: DataFrame) -> DataFrame:
    """The sparse one-hot vector of each value: its width, and the place of its one, if any."""
    widths = probe.train_values(rows, "value").groupBy("fold").agg((F.count(F.lit(1)) + 1).cast("int").alias("width"))
    code = F.col("code")
    known = probe.encode(rows, "value").join(widths, "fold")
    return known.select("id", "fold", "width", F.when(code > 0, code).otherwise(-1).cast("long").alias("place"), (code > 0).cast("int").cast("double").alias("ones"))


def oof(spark, d) -> DataFrame:
    return probe.nearest_centroid(probe_rows(spark, d), "embedding").withColumn("hit", F.col("label") == F.col("predicted"))


def oof_per_fold(spark, d) -> DataFrame:
    return oof(spark, d).groupBy("fold").agg(F.count(F.lit(1)).alias("n_test"), F.count_if("hit").alias("hits"))


CENTROIDS = W + v.MANIFEST + """
, long AS (SELECT m.fold, m.role, m.id, m.label, unnest(range(0, 64)) AS dim, unnest(embedding)::DOUBLE AS x FROM manifest m JOIN embeddings e ON e.vec_id = m.id)
, means AS (SELECT fold, label, dim, avg(x) AS m FROM long WHERE role = 'Train' GROUP BY ALL)
, far AS (SELECT t.fold, t.id, t.label, c.label AS c, round(sum((t.x - c.m) * (t.x - c.m)), 9) AS d FROM long t JOIN means c ON t.fold = c.fold AND t.dim = c.dim WHERE t.role = 'Test' GROUP BY ALL)
, best AS (SELECT fold, id, label, c AS predicted FROM far QUALIFY row_number() OVER (PARTITION BY fold, id ORDER BY d, c) = 1)"""

STANDARD = W + v.MANIFEST + f"""
, long AS (SELECT m.fold, m.role, m.id, unnest(range(0, 64))::INT AS dim, unnest(embedding)::DOUBLE AS x FROM manifest m JOIN embeddings e ON e.vec_id = m.id)
, stats AS (SELECT fold, dim, avg(x) AS m, stddev_pop(x) AS s FROM long WHERE role = 'Train' GROUP BY ALL)
SELECT id, fold, role, dim, round((x - m) / CASE WHEN round(s, 12) = 0 THEN 1 ELSE s END, 6) + 0.0::DOUBLE AS z FROM long JOIN stats USING (fold, dim)"""

def standardized(rows: DataFrame) -> DataFrame:
    return probe.standardize(rows, "embedding").withColumn("z", F.round("z", 6) + F.lit(0.0))


def logistic(spark, d) -> DataFrame:
    """Out-of-fold probes of the vectors, of the documents' attributes with their ids, and of both."""
    docs = v.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    rows = probe_rows(spark, d).join(docs, "id", "left").na.fill("missing", ["lang", "source"])
    return probe.logistic_joint(probe.sparse_blocks(rows, "embedding", ["lang", "source"]))


def permutation(spark, d, mode: str) -> DataFrame:
    docs = v.table(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 7 + 1).cast("int").alias("fold"), "lang", "source")
    return probe.permuted(docs, ["lang", "source"], mode)


def _permuted_sql(mode: str, seed: str = "perm") -> str:
    base = W + f"docs AS (SELECT doc_id AS id, (doc_id % 7 + 1)::INT AS fold, lang, source FROM documents), base AS (SELECT id, fold, row_number() OVER (PARTITION BY fold ORDER BY md5('{seed}|base|' || id), id) AS place FROM docs)"
    ranked = "SELECT fold, row_number() OVER (PARTITION BY fold ORDER BY md5('{seed}|{name}|' || id), id) AS place, {part} FROM docs"
    if mode == "joint":
        return f"{base} SELECT base.id, base.fold, lang, source FROM base JOIN ({ranked.format(seed=seed, name='tuple', part='lang, source')}) USING (fold, place)"
    return f"{base} SELECT base.id, base.fold, lang, source FROM base JOIN ({ranked.format(seed=seed, name='lang', part='lang')}) USING (fold, place) JOIN ({ranked.format(seed=seed, name='source', part='source')}) USING (fold, place)"


def guessed(df: DataFrame) -> DataFrame:
    """Whether a text is long, predicted by a rule that only sees lang."""
    truth = F.when(F.col("long"), "1").otherwise("0")
    guess = F.when(F.col("lang") == "en", "1").otherwise("0")
    return df.select(F.col("id").alias("sample_id"), "fold", truth.alias("y_true"), guess.alias("y_pred"), F.when(truth == guess, 0.8).otherwise(0.2).alias("own_p"), F.concat_ws("|", "lang", "source").alias("inputs"))


def long_docs(spark, d) -> DataFrame:
    return v.table(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 7 + 1).cast("int").alias("fold"), "lang", "source", (F.length("text") >= 400).alias("long"))


def perturbation(spark, d) -> DataFrame:
    """What the joint shuffle changes."""
    docs = long_docs(spark, d)
    moved = probe.permuted(docs.select("id", "fold", "lang", "source"), ["lang", "source"], "joint").join(docs.select("id", "long"), "id")
    return comparison.perturbation_effect(guessed(docs), guessed(moved))


def permutation_repeats(spark, d) -> DataFrame:
    """Both shuffles, twice."""
    effects = probe.permutation_effects(long_docs(spark, d), ["lang", "source"], guessed, 2)
    rounded = ("original_accuracy", "delta_accuracy", "delta_log_loss", "changed")
    return effects.withColumns({**{c: F.round(c, 9) for c in rounded}, "permuted_accuracy": F.round("permuted_accuracy", 6)})


def _perturbed_sql(mode: str, seed: str) -> str:
    return _permuted_sql(mode, seed).replace(" SELECT base.id, base.fold, lang", ", moved AS (SELECT base.id, base.fold, lang") + f""")
, truth AS (SELECT doc_id AS id, (length(text) >= 400)::INT AS y FROM documents)
, both_ AS (SELECT o.fold, y, (o.lang = 'en')::INT AS y0, (m.lang = 'en')::INT AS y1, o.lang <> m.lang OR o.source <> m.source AS moved_ FROM docs o JOIN moved m USING (id) JOIN truth USING (id))
SELECT fold, count(*) AS n, {R("avg((y = y0)::INT)", "original_accuracy")}, {R("avg((y = y1)::INT) - avg((y = y0)::INT)", "delta_accuracy")},
       {R("avg(-ln(CASE WHEN y = y1 THEN 0.8::DOUBLE ELSE 0.2::DOUBLE END)) - avg(-ln(CASE WHEN y = y0 THEN 0.8::DOUBLE ELSE 0.2::DOUBLE END))", "delta_log_loss")}, {R("avg(moved_::INT)", "changed")} FROM both_ GROUP BY fold"""


PERTURBED = _perturbed_sql("joint", "perm")
REPEATED = " UNION ALL ".join(
    f"""SELECT '{condition}' AS condition, {repeat}::INT AS "repeat", fold, n, round(original_accuracy, 9) AS original_accuracy, round(delta_accuracy, 9) AS delta_accuracy, round(delta_log_loss, 9) AS delta_log_loss,
    round(changed, 9) AS changed, round(original_accuracy + delta_accuracy, 6) AS permuted_accuracy FROM ({_perturbed_sql(mode, f"perm|{repeat}")})"""
    for repeat in range(2)
    for mode, condition in (("joint", "joint_tuple"), ("independent", "independent_columns"))
)


def sample(spark, d) -> DataFrame:
    return folds.stratified_sample(v.table(spark, d, "documents"), "doc_id", "lang", 100)


SAMPLE_SQL = """WITH c AS (SELECT lang AS label, count(*) AS size, sum(count(*)) OVER () AS total FROM documents GROUP BY lang)
, e AS (SELECT *, 100 * size / total::DOUBLE AS exact FROM c)
, t AS (SELECT label, floor(exact)::BIGINT + CASE WHEN row_number() OVER (ORDER BY round(exact - floor(exact), 9) DESC, label) <= 100 - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS take FROM e)
, r AS (SELECT doc_id AS id, lang AS label, row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || doc_id), doc_id) AS place FROM documents)
SELECT id, label FROM r JOIN t USING (label) WHERE place <= take"""


def held_out(spark, d) -> DataFrame:
    """Ids 3, 6, ... lose their Test row, ids 5, 10, ... get a second one."""
    rows = v.manifest(spark, d)
    broken = rows.filter("not (role = 'Test' and id % 3 = 0)").unionByName(rows.filter("role = 'Test' and id % 5 = 0"))
    return folds.held_out_once_violations(v.vectors(spark, d).select("id"), broken)


QUERIES = {
    "stratified_folds": (lambda s, d: folds.stratified_folds(v.vectors(s, d), "id", "label"), W + v.FOLDS + " SELECT * FROM folds"),
    "validation_split": (v.manifest, W + v.MANIFEST + " SELECT * FROM manifest"),
    "fold_counts": (lambda s, d: folds.fold_counts(v.manifest(s, d)), W + v.MANIFEST + " SELECT fold, role, label, count(*) AS n FROM manifest GROUP BY ALL"),
    "test_train_ratio": (
        lambda s, d: comparison.test_train_ratio(v.manifest(s, d)),
        W + v.MANIFEST + f" SELECT fold, count(*) FILTER (role = 'Test') AS test, count(*) FILTER (role = 'Train') AS train, {R(D("count(*) FILTER (role = 'Test')", "count(*) FILTER (role = 'Train')"), 'ratio')} FROM manifest GROUP BY fold",
    ),
    "heldout_once_violations": (
        held_out,
        W + v.MANIFEST + ", broken AS (SELECT * FROM manifest WHERE NOT (role = 'Test' AND id % 3 = 0) UNION ALL SELECT * FROM manifest WHERE role = 'Test' AND id % 5 = 0) SELECT vec_id AS id, count(b.id) AS tests FROM embeddings LEFT JOIN broken b ON b.id = vec_id AND b.role = 'Test' GROUP BY vec_id HAVING count(b.id) <> 1",
    ),
    "stratified_sample": (sample, SAMPLE_SQL),
    "grouped_folds": (grouped, None),
    "grouped_fold_balance_customers": (
        lambda s, d: grouped_balance(by_customer(s, d)),
        "SELECT l_returnflag AS label, count(*) AS lines, 7::BIGINT AS folds, true AS even, 0::BIGINT AS split_clusters FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_returnflag",
    ),
    "grouped_fold_balance": (lambda s, d: grouped_balance(grouped(s, d)), "SELECT l_returnflag AS label, count(*) AS lines, 7::BIGINT AS folds, true AS even, 0::BIGINT AS split_clusters FROM lineitem GROUP BY l_returnflag"),
    "grouped_fold_violations": (grouped_violations, "SELECT l_orderkey AS cluster, 1::INT AS fold, '' AS roles, count(*) AS n FROM lineitem WHERE false GROUP BY l_orderkey"),
    "cluster_role_violations": (lambda s, d: folds.role_violations(group_roles(numbered(clustered(s, d))), folds.ROLES), W + LINE_MANIFEST + CROSSED),
    "missing_training_classes": (
        lambda s, d: folds.missing_training_classes(v.manifest(s, d).filter("not (fold = 3 and label = 4)").unionByName(v.manifest(s, d).filter("fold = 3 and label = 4 and role = 'Test'"))),
        W + v.MANIFEST + ", m AS (SELECT * FROM manifest WHERE NOT (fold = 3 AND label = 4 AND role <> 'Test')) SELECT fold, label FROM (SELECT DISTINCT fold FROM m), (SELECT DISTINCT label FROM m) WHERE (fold, label) NOT IN (SELECT (fold, label) FROM m WHERE role = 'Train')",
    ),
    "count_fingerprint": (
        lambda s, d: folds.count_fingerprint(v.pred_docs(s, d), v.pred_docs(s, d).filter("sample_id % 50 <> 0"), ["lang", "source"]),
        W + v.PRED_DOCS + """, long AS (SELECT fold, sample_id, unnest(['lang', 'source']) AS attribute, unnest([lang, source]) AS "group" FROM pred_docs) SELECT fold, attribute, "group", count(*) AS n_left, count(*) FILTER (sample_id % 50 <> 0) AS n_right FROM long GROUP BY ALL HAVING count(*) <> count(*) FILTER (sample_id % 50 <> 0)""",
    ),
    "manifest_violations": (
        lambda s, d: contracts.manifest_violations(v.manifest(s, d).unionByName(v.manifest(s, d).filter("fold = 2 and id < 10")).withColumn("role", F.when(F.col("id") == 7, "test").otherwise(F.col("role")))),
        W + v.MANIFEST + ", m AS (SELECT * FROM manifest UNION ALL SELECT * FROM manifest WHERE fold = 2 AND id < 10) SELECT (SELECT count(*) FROM m WHERE id = 7) AS unknown_roles, (SELECT count(*) FROM (SELECT 1 FROM m GROUP BY id, fold HAVING count(*) > 1)) AS repeated_rows",
    ),
    "not_test_violations": (
        lambda s, d: contracts.not_test_violations(oof(s, d).select(F.lit("centroid").alias("model"), F.col("id").alias("sample_id"), (F.col("fold") % 7 + (F.col("id") % 2)).cast("int").alias("fold")), v.manifest(s, d)),
        W + v.MANIFEST + ", p AS (SELECT id AS sample_id, (fold % 7 + id % 2)::INT AS fold FROM manifest WHERE role = 'Test') SELECT 'centroid' AS model, sample_id, p.fold, role FROM p LEFT JOIN manifest m ON m.id = sample_id AND m.fold = p.fold WHERE role IS NULL OR role <> 'Test'",
    ),
    "train_vocab_codes": (
        lambda s, d: encoded(vocabulary_rows(s, d)),
        VOCAB + " SELECT id, fold, role, coalesce(code, 0)::INT AS code FROM (SELECT id, fold, role, CASE WHEN role = 'Test' AND id % 5 = 0 THEN 'unseen' ELSE value END AS value FROM own) LEFT JOIN vocab USING (fold, value)",
    ),
    "train_vocab_onehot": (
        lambda s, d: one_hot_sizes(vocabulary_rows(s, d)),
        VOCAB + " SELECT id, fold, width, coalesce(code, -1)::BIGINT AS place, (code IS NOT NULL)::INT::DOUBLE AS ones FROM own LEFT JOIN vocab USING (fold, value) JOIN (SELECT fold, (count(*) + 1)::INT AS width FROM vocab GROUP BY fold) USING (fold)",
    ),
    "standardize_train_only": (lambda s, d: standardized(probe_rows(s, d)), STANDARD),
    "nearest_centroid_oof": (oof, CENTROIDS + " SELECT fold, id, label, predicted, label = predicted AS hit FROM best"),
    "centroid_fold_log": (oof_per_fold, CENTROIDS + " SELECT fold, count(*) AS n_test, count(*) FILTER (label = predicted) AS hits FROM best GROUP BY fold"),
    "logistic_probe_oof": (logistic, None),
    "permutation_joint": (lambda s, d: permutation(s, d, "joint"), _permuted_sql("joint")),
    "permutation_independent": (lambda s, d: permutation(s, d, "independent"), _permuted_sql("independent")),
    "perturbation_effect": (perturbation, PERTURBED),
    "permutation_repeats": (permutation_repeats, REPEATED),
}
