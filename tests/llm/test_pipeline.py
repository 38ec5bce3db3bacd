"""The whole pipeline against brute force on a small fixture."""

import os
import random
import re
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
from test_operators import brute_components, brute_contamination, brute_lines  # noqa: E402

import corpus_pipeline  # noqa: E402
from foldlens.llm import quality  # noqa: E402

VOCABULARY = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in "nrst"]


def documents():
    rng = random.Random(4)
    some = lambda k: " ".join(rng.choice(VOCABULARY) for _ in range(k))
    passage = some(14)
    rows, base = [], None
    for i in range(240):
        text = "\n".join(some(rng.randint(6, 14)) for _ in range(rng.randint(2, 5)))
        if i % 12 == 5 and base:
            text = base.replace(" ", " tok ", 1) if i % 24 == 5 else base  # near and exact copies
        if i % 30 == 7:
            text += "\n" + passage
        if i % 6 == 1:
            text += "\nAll rights reserved "
        if i % 5 == 3:
            text = text.upper() + " !!!! #### $$$$"
        if i % 12 == 4:
            base = text
        rows.append((i * 7 + 2, text, "en", f"s{i % 3}", len(text)))
    rows += [(5001, None, None, None, None), (5003, "", "en", "s1", 0)]
    return rows, [(1, "x " + passage + " y"), (2, "")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    rows, items = documents()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(r[0], int(not (r[1] or "").endswith("$$$$")), 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_pipeline(spark, folder):
    rows, items = documents()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.fit_quality(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    kept = [(r[0], r[1], r[3]) for r, s in zip(rows, model.score([r[1] for r in rows]), strict=True) if s >= quality.THRESHOLD]
    assert 0.7 * len(rows) < len(kept) < len(rows)
    lined = [(i, text, source) for (i, _, source), (text, _, _) in zip(kept, brute_lines([t for _, t, _ in kept], 10), strict=True)]
    assert any("rights" in (t or "").lower() for _, t, _ in kept) and not any("rights reserved" in t.lower() for _, t, _ in lined)
    component = brute_components([(i, t) for i, t, _ in lined], 5, 80, 100)
    single = [x for x in lined if component[x[0]][1] == x[0]]
    assert len(single) < len(lined)
    clean = [x for x in single if not brute_contamination(x[1], [(str(a), b) for a, b in items])[1]]
    assert len(clean) < len(single)

    got = corpus_pipeline.run(spark, folder).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t, _ in clean}
    want = {i: (t, s) for i, t, s in clean}
    assert all(want[r.doc_id] == (r.text, r.source) and r.size == size[r.doc_id] and r.n_chars == len(r.text) for r in got)
    assert all(0 < r.taken <= 2 * r.size for r in got)
    total = {}
    for i, _, s in clean:
        total[s] = total.get(s, 0) + size[i]
    targets = {r.source: r.target for r in got}
    assert all(r.source_size == total[r.source] for r in got)
    for source, target in targets.items():
        assert abs(sum(r.taken for r in got if r.source == source) - target) <= 64
    assert sum(targets.values()) == pytest.approx(1.5 * sum(size.values()))


def test_stages_keep_columns_and_bear_empty_tables(spark, folder):
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    docs = empty
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.isEmpty(), name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.dtypes == empty.dtypes


def test_stages_keep_columns_that_clash(spark, folder):
    """Columns named like what the operators add pass unchanged, and repeated rows too."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = ["n_words", "score", "predicted", "n_lines", "n_dropped", "hit_words", "head", "row", "node", "g", "k1", "c0", "c3"]
    clash = docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id")) for n in names})
    clash = clash.unionByName(clash.filter("doc_id = 5003"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, clash, folder)
        assert got.columns == clash.columns, name
        rows = got.collect()
        assert rows and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names), name
    mixed = corpus_pipeline.mixing_stage(spark, clash.withColumns({"size": F.lit("x"), "taken": F.lit("y")}), folder)
    assert set(clash.columns) <= set(mixed.columns) and dict(mixed.dtypes)["size"] == "bigint"
    rows = mixed.collect()
    assert rows and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names)
