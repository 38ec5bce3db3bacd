"""Quality rules whose thresholds come from the corpus, by language and source.

Each document has whole-number measures; a quantile sketch of each measure is kept for every
(lang, source). The sketch counts values in log-linear cells (exact below 64, above that the six
leading bits, so within 1/32): cells of two sketches add up, whatever was merged first, so
a sketch is a table (lang, source, measure, cell, n), its merge is a sum, Spark combines it
before the shuffle, and stored sketches of other runs can be added. Sources merge into their
language and languages into the corpus: a group of fewer than ``MIN_DOCS`` documents takes the
thresholds of the next larger one.

A measure fails beyond its group's upper quartile by more than ``FENCE`` times the distance of
the quartiles, or of ``WIDTH`` where the quartiles are closer; mean word lengths fail below the
lower quartile in the same way, and count for documents of ``LENGTH_WORDS`` words or more only
(in shorter ones a single long token decides them). Two fixed base rules stay. Thresholds join
the documents by group: groups with many documents are broadcast, of which there are few, the
others meet by a shuffle.

Defined results: a null or empty text has no words, counts of 0 and fails the base rules; null
languages and sources are groups of their own; texts of any length are read whole (the words of
one text are held by one task, the windows as numbers); repeated rows count each; an empty table
gives no rows; other columns stay as they are, but ones named like an added column are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Scratch, join_by_weight, named_as, need, place_of, plainly_named

WINDOW = 8
#: The fixed base rules: at least so many words, at most 30 of 100 words in repeated windows.
BASE_WORDS, BASE_REPEATS = 20, 30
#: Measures by name: the least distance of quartiles that a fence reckons with.
WIDTH = {"symbols": 50, "repeats": 80, "copies": 150, "length": 40}
FENCE = 3
MIN_DOCS = 100
LENGTH_WORDS = 50
#: Leading bits of a value that name its cell.
BITS = 6
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")
_BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
#: Texts whose windows are ranked together, in characters.
_PACK = 1 << 20


def repeated_words(codes: np.ndarray, first: np.ndarray, n: int = WINDOW) -> np.ndarray:
    """For each text the words that lie in windows of ``n`` words that it holds twice or more.

    Text i has the words first[i] ... first[i + 1] - 1 of ``codes``. Windows are ranked by
    doubling: the rank of 2w words is that of the pair of ranks of w words, so equal ranks are
    equal windows.
    """
    texts = len(first) - 1
    if len(codes) < n:
        return np.zeros(texts, np.int64)
    rank, width = codes.astype(np.int64), 1
    while width < n:
        step = min(width, n - width)
        rank = np.unique(rank[:-step] * (int(rank.max()) + 1) + rank[step:], return_inverse=True)[1]
        width += step
    own = np.repeat(np.arange(texts), np.diff(first))
    start = np.flatnonzero(np.arange(len(rank)) + n <= first[1:][own[: len(rank)]])
    if not len(start):
        return np.zeros(texts, np.int64)
    _, which, times = np.unique(own[start] * (int(rank.max()) + 1) + rank[start], return_inverse=True, return_counts=True)
    start = start[times[which] > 1]
    cover = np.zeros(len(codes) + 1, np.int64)
    np.add.at(cover, start, 1)
    np.add.at(cover, start + n, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    return inside[first[1:]] - inside[first[:-1]]


def measure(texts: list[str | None]) -> dict[str, np.ndarray]:
    """The ``COUNTS`` of each text."""
    out = {c: np.zeros(len(texts), np.int64) for c in COUNTS}
    words, first = [], [0]
    for i, text in enumerate(texts):
        found = _WORD.findall(text or "")
        words += found
        first.append(len(words))
        lines = [x for x in (text or "").split("\n") if x.strip(_BLANKS)]
        out["word_chars"][i] = sum(map(len, found))
        out["n_symbols"][i] = len(_SYMBOL.findall(text or ""))
        out["n_lines"][i], out["n_dup_lines"][i] = len(lines), len(lines) - len(set(lines))
    at = np.array(first)
    out["n_words"] = np.diff(at)
    out["n_repeat_words"] = repeated_words(pd.factorize(np.array(words, dtype=object))[0] if words else np.zeros(0, np.int64), at)
    return out


def _packs(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    begin = held = 0
    for i, text in enumerate(texts):
        if held >= _PACK:
            yield begin, i
            begin, held = i, 0
        held += len(text or "")
    if begin < len(texts):
        yield begin, len(texts)


def with_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with the ``COUNTS`` in place of the text."""
    others = [f for f in docs.schema.fields if f.name != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            parts = [measure(texts[a:b]) for a, b in _packs(texts)]
            counts = [pa.array(np.concatenate([p[c] for p in parts] or [np.zeros(0, np.int64)])) for c in COUNTS]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in others], *counts], [*[f.name for f in others], *COUNTS])

    return docs.mapInArrow(run, T.StructType([*others, *[T.StructField(c, T.LongType()) for c in COUNTS]]))


def measures() -> dict[str, Column]:
    """Whole-number measures from the counts; null where a document has none."""
    per = lambda scale, part, of: F.when(F.col(of) > 0, F.expr(f"{scale} * {part} div {of}"))
    return {
        "symbols": per(1000, "n_symbols", "n_words"),
        "repeats": per(1000, "n_repeat_words", "n_words"),
        "copies": per(1000, "n_dup_lines", "n_lines"),
        "length": F.when(F.col("n_words") >= LENGTH_WORDS, F.expr("100 * word_chars div n_words")),
    }


def cell(value: Column) -> Column:
    """The lower end of the cell that a value falls into: its ``BITS`` leading bits."""
    low = F.greatest(F.length(F.bin(value)) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, low), low)


def sketch(counted: DataFrame) -> DataFrame:
    """(lang, source, measure, cell, n) of documents with ``COUNTS``."""
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), v.alias("value")) for m, v in measures().items()]))
    rows = counted.select("lang", "source", values.alias("m")).filter("m.value is not null")
    return rows.groupBy("lang", "source", F.col("m.measure").alias("measure"), cell(F.col("m.value")).alias("cell")).agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, *keys: str) -> DataFrame:
    """Sketches summed over all but ``keys``: pieces of one group, or the groups of a larger one."""
    return sketches.groupBy(*keys, "measure", "cell").agg(F.sum("n").alias("n"))


def fences(sketches: DataFrame, *keys: str) -> DataFrame:
    """(keys, docs, limits) with limits a map of each measure's (low, high)."""
    group = Window.partitionBy(*keys, "measure")
    upto = group.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)  # over the cells of a sketch, 2,000 at most
    rows = sketches.withColumns({"upto": F.sum("n").over(upto), "all": F.sum("n").over(group)})
    quartile = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("all") * q, F.col("cell")))
    found = rows.groupBy(*keys, "measure").agg(F.max("all").alias("docs"), quartile(1).alias("q1"), quartile(3).alias("q3"))
    width = F.element_at(F.create_map(*[F.lit(x) for pair in WIDTH.items() for x in pair]), F.col("measure"))
    reach = FENCE * F.greatest(F.col("q3") - F.col("q1"), width)
    limit = F.struct((F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"))
    return found.groupBy(*keys).agg(F.max("docs").alias("docs"), F.map_from_entries(F.collect_list(F.struct("measure", limit.alias("limit")))).alias("limits"))


def thresholds(sketches: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, docs, limits) of every group, from itself, its language or the corpus.

    A measure that a group's sketch lacks is taken from the next larger one, too.
    """
    own = fences(sketches, "lang", "source")
    by_lang = fences(merge(sketches, "lang"), "lang").select(F.col("lang").alias("__l"), F.col("docs").alias("lang_docs"), F.col("limits").alias("lang_limits"))
    every = fences(merge(sketches)).first()["limits"] or {}  # one row
    whole = [x for m, v in every.items() for x in (F.lit(m), F.struct(F.lit(v["low"]).cast("long").alias("low"), F.lit(v["high"]).cast("long").alias("high")))]
    top = F.create_map(*whole) if whole else F.lit(None).cast(own.schema["limits"].dataType)
    joined = own.join(by_lang, F.col("lang").eqNullSafe(F.col("__l")))

    def limit(m: str) -> Column:
        mine = F.when(F.col("docs") >= min_docs, F.try_element_at("limits", F.lit(m)))
        wider = F.when(F.col("lang_docs") >= min_docs, F.try_element_at("lang_limits", F.lit(m)))
        return F.coalesce(mine, wider, F.try_element_at(top, F.lit(m))).alias(m)

    return joined.select("lang", "source", "docs", F.struct(*[limit(m) for m in WIDTH]).alias("limits"))


def base_failed() -> Column:
    return (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEATS * F.col("n_words"))


def judge(counted: DataFrame, limits: DataFrame) -> DataFrame:
    """``counted`` with base_failed, kept and failed, the names of the measures beyond their limits."""
    key = F.to_json(F.struct("lang", "source"))
    known = limits.select(key.alias("__group"), F.col("docs").alias("__docs"), "limits")
    rows = counted.withColumn("__group", key)
    total = limits.agg(F.sum("docs")).first()[0] or 0  # one number
    # documents without a word have no measure and may have no group: they fail by the base rules
    met = join_by_weight(rows.filter("n_words > 0"), known, ["__group"], "__docs", total)
    met = met.unionByName(rows.filter("n_words = 0").withColumn("limits", F.lit(None).cast(known.schema["limits"].dataType)))
    beyond = lambda m, v: F.coalesce((v > F.col(f"limits.{m}.high")) | (v < F.col(f"limits.{m}.low")), F.lit(False))
    failed = F.array_compact(F.array(*[F.when(beyond(m, v), F.lit(m)) for m, v in measures().items()]))
    met = met.withColumns({"failed": failed, "base_failed": base_failed()})
    return met.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)).drop("__group", "limits")


def quality_rules(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The columns of ``docs`` but the text, with ``COUNTS``, base_failed, failed and kept."""
    need(docs, text_col, lang_col, source_col)
    plain = plainly_named(docs)
    text = place_of(docs, text_col)
    rest = docs.select(*[c for c in docs.columns if c != text_col])
    names = {place_of(docs, lang_col): "lang", place_of(docs, source_col): "source"}
    scratch = Scratch(docs.sparkSession, "quality-rules")
    plain = plain.withColumns({new: F.col(old).cast("string") for old, new in names.items()})
    counted = scratch.write(with_counts(plain, text), "counts")
    held = scratch.write(sketch(counted), "sketch")
    judged = judge(counted, scratch.write(thresholds(held), "thresholds"))
    places = [(place_of(docs, c), c) for c in rest.columns]
    added = [*COUNTS, "base_failed", "failed", "kept"]
    return judged.select(*[F.col(p).alias(c) for p, c in places if c not in added], *added)


def keep_good(docs: DataFrame) -> DataFrame:
    """``docs`` with the documents that pass all rules, rows whole."""
    marked = plainly_named(docs)
    ident = "__row"
    numbered = Scratch(docs.sparkSession, "quality-rules").write(marked.withColumn(ident, F.monotonically_increasing_id()), "rows")
    lang, source, text = (place_of(docs, c) for c in ("lang", "source", "text"))
    good = quality_rules(numbered.select(ident, text, lang, source), text, lang, source).filter("kept").select(ident)
    return named_as(numbered.join(good, ident, "left_semi"), docs)


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their counts, the base rules and the verdict of the adaptive thresholds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    judged = quality_rules(docs)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed", ",").alias("failed"))


def _level(name: str, keys: str) -> str:
    """Fences of one level of groups in SQL."""
    by = f"{keys}, " if keys else ""
    width = " ".join(f"WHEN '{m}' THEN {w}" for m, w in WIDTH.items())
    return f"""{name} AS MATERIALIZED (SELECT {by}measure, docs, q1 - {FENCE} * greatest(q3 - q1, width) AS low, q3 + {FENCE} * greatest(q3 - q1, width) AS high
    FROM (SELECT {by}measure, max(total) AS docs, min(CASE WHEN upto * 4 >= total THEN cell END) AS q1, min(CASE WHEN upto * 4 >= total * 3 THEN cell END) AS q3,
        CASE measure {width} END AS width
    FROM (SELECT {by}measure, cell, sum(n) OVER (PARTITION BY {by}measure ORDER BY cell) AS upto, sum(n) OVER (PARTITION BY {by}measure) AS total
    FROM (SELECT {by}measure, cell, count(*) AS n FROM cells GROUP BY ALL)) GROUP BY ALL))"""


OP12_SQL = f"""WITH rows AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
split AS MATERIALIZED (SELECT r, doc_id, lang, source, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM rows),
windows AS (SELECT r, i, list_slice(words, i, i + {WINDOW - 1}) AS w FROM (SELECT r, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM split)),
repeats AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS times FROM windows) WHERE times > 1) GROUP BY r),
counted AS MATERIALIZED (SELECT split.r AS r, doc_id, lang, source, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words FROM split LEFT JOIN repeats USING (r)),
long AS MATERIALIZED (SELECT r, lang, source, unnest(['symbols', 'repeats', 'copies', 'length']) AS measure,
    unnest([CASE WHEN n_words > 0 THEN 1000 * n_symbols // n_words END, CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words END,
    CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines END, CASE WHEN n_words >= {LENGTH_WORDS} THEN 100 * word_chars // n_words END]) AS value FROM counted),
cells AS (SELECT lang, source, measure, (value >> s) << s AS cell FROM (SELECT *, greatest(length(bin(value)) - {BITS}, 0) AS s FROM long WHERE value IS NOT NULL)),
{_level("own", "lang, source")}, {_level("wide", "lang")}, {_level("every", "")},
sized AS (SELECT lang, source, max(docs) AS docs FROM own GROUP BY ALL), lang_sized AS (SELECT lang, max(docs) AS docs FROM wide GROUP BY ALL),
beyond AS (SELECT long.r AS r, long.measure AS measure FROM long
    JOIN sized ON long.lang IS NOT DISTINCT FROM sized.lang AND long.source IS NOT DISTINCT FROM sized.source JOIN lang_sized ON long.lang IS NOT DISTINCT FROM lang_sized.lang
    LEFT JOIN own ON long.lang IS NOT DISTINCT FROM own.lang AND long.source IS NOT DISTINCT FROM own.source AND long.measure = own.measure AND sized.docs >= {MIN_DOCS}
    LEFT JOIN wide ON long.lang IS NOT DISTINCT FROM wide.lang AND long.measure = wide.measure AND lang_sized.docs >= {MIN_DOCS}
    LEFT JOIN every ON long.measure = every.measure
    WHERE long.value > coalesce(own.high, wide.high, every.high) OR long.value < coalesce(own.low, wide.low, every.low)),
failing AS (SELECT r, string_agg(measure, ',' ORDER BY list_position(['symbols', 'repeats', 'copies', 'length'], measure)) AS failed FROM beyond GROUP BY r),
based AS (SELECT *, n_words < {BASE_WORDS} OR 100 * n_repeat_words > {BASE_REPEATS} * n_words AS base_failed FROM counted)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
    NOT base_failed AND failed IS NULL AS kept, coalesce(failed, '') AS failed
FROM based LEFT JOIN failing USING (r)"""
