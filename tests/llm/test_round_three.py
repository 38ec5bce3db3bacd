"""Ball k-means, adaptive quality rules and token alignment against brute force, and their edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldlens.llm import alignment, ballkmeans, quality_rules

# ---- 11


def brute_kmeans(rows, k, rounds, seed, scale):
    kept = [(i, [int(np.floor(x * scale)) for x in v]) for i, v in rows if v is not None and len(v) == 3 and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in order[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    for t in range(rounds + 1):
        at = [min((far(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]
        if t < rounds:
            for j in range(len(centroids)):
                mine = [v for (_, v), (_, c) in zip(kept, at, strict=True) if c == j]
                if mine:
                    centroids[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return sorted(((i, c, d) for (i, _), (d, c) in zip(kept, at, strict=True)), key=repr), centroids


@pytest.mark.parametrize("seed", [1, 2])
def test_ball_kmeans_equals_all_comparisons(spark, seed):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(m, 0.3) for _ in range(3)]) for i, m in enumerate(rng.choice([-2, 0, 1, 5]) for _ in range(300))]
    rows += [(7, [0.5, 0.5, 0.5])] * 3 + [(900, None), (901, [1.0, 2.0]), (902, [1.0, None, 2.0]), (903, [1.0, float("nan"), 0.0]), (904, [float("inf"), 0.0, 0.0]), (None, [0.1, 0.2, 0.3])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("clash"))
    got, centroids = ballkmeans.ball_kmeans(table, 7, 6, seed, dimensions=3, scale=64)
    want, final = brute_kmeans(rows, 7, 6, seed, 64)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == want
    assert centroids.tolist() == final


def test_ball_kmeans_ties_few_and_none(spark):
    grid = [(i, [float(i % 3), float(i // 3 % 3), 0.0]) for i in range(18)]  # many equal distances
    table = spark.createDataFrame(grid, "vec_id long, embedding array<double>")
    got, _ = ballkmeans.ball_kmeans(table, 4, 5, 3, dimensions=3, scale=2)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == brute_kmeans(grid, 4, 5, 3, 2)[0]
    got, centroids = ballkmeans.ball_kmeans(table.limit(2), 4, 2, 3, dimensions=3, scale=2)
    assert len(centroids) == 2 and got.count() == 2
    got, centroids = ballkmeans.ball_kmeans(table.limit(0), 4, 2, 3, dimensions=3, scale=2)
    assert got.count() == 0 and len(centroids) == 0


def test_balls_skip_what_they_may(monkeypatch):
    """The stable core is compared with nothing, and balls at rest aren't looked at."""
    asked = []
    real = ballkmeans._challenge
    monkeypatch.setattr(ballkmeans, "_challenge", lambda v, at, j, *rest: (asked.append((j, len(at))), real(v, at, j, *rest)))
    centroids = np.array([[0, 0], [100, 0], [1000, 0]])
    v = np.array([[1, 0], [60, 0], [99, 0], [1001, 0]])
    cluster = np.array([0, 0, 1, 2])
    balls = ballkmeans.Balls(centroids, centroids + [1, 0], {0: 3600, 1: 4, 2: 4})
    best, least = balls.assign(v, cluster, np.zeros(4, np.int64))
    assert best.tolist() == [0, 1, 1, 2] and least.tolist() == [1, 1600, 1, 1]
    assert asked == [(1, 1)]  # only the member outside of the core, with the one neighbour
    rest = ballkmeans.Balls(centroids, centroids, {0: 3600, 1: 4, 2: 4})
    assert rest.resting.all()


# ---- 12


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    covered = {p for at in windows.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines), len(lines) - len(set(lines)), len(covered)


def texts_of_words(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        body = [rng.choice("ab") for _ in range(rng.randint(0, 60))]
        yield "".join(w + rng.choice([" ", "\n", "\t", "  ", " \x85", " # "]) for w in body)


def test_counts_equal_brute_force():
    texts = [None, "", "\n \n", "one", "a b c d e f g h a b c d e f g h", *texts_of_words(5, 300)]
    got = quality_rules.measure(texts)
    assert [tuple(int(got[c][i]) for c in quality_rules.COUNTS) for i in range(len(texts))] == [brute_counts(t) for t in texts]


def corpus(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7)))
    rows = []
    for i in range(600):
        text = " ".join(word() for _ in range(rng.randint(60, 120)))
        if i % 50 == 7:
            text = text.replace(" ", "%%% ")
        rows.append((i, text, "en" if i % 3 else None, "hot" if i % 5 else f"s{i}", "x"))
    rows += [(601, None, "en", "hot", "x"), (602, "", None, None, "x"), (603, "few words", "de", None, "x"), (604, rows[0][1], None, None, "x"), (604, rows[0][1], None, None, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept string")


def test_adaptive_rules_reject_what_stands_out(spark):
    docs = corpus(spark)
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    assert {i for i in range(600) if not got[i]["kept"]} == {i for i in range(600) if i % 50 == 7}
    assert got[7]["failed"] == ["symbols", "length"]
    assert got[601]["base_failed"] and got[602]["n_words"] == 0 and got[603]["base_failed"] and got[604]["kept"]
    good = quality_rules.keep_good(docs)
    assert good.columns == docs.columns and good.count() == 600 - 12 + 2
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0


def test_sketches_merge_in_any_order(spark):
    counted = quality_rules.with_counts(corpus(spark), "text").drop("kept")
    whole = quality_rules.sketch(counted)
    parts = [quality_rules.sketch(counted.filter(F.col("doc_id") % 3 == k)) for k in range(3)]
    merged = quality_rules.merge(parts[2].unionByName(parts[0]).unionByName(parts[1]), "lang", "source")
    key = lambda d: sorted([tuple(r) for r in d.select("lang", "source", "measure", "cell", "n").collect()], key=repr)
    assert key(whole) == key(merged)


# ---- 13


def brute_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a_of = Tokenizer.from_file(f"{alignment.TOKENIZERS}/byte_bpe_50k.json")
    a_of.encode_special_tokens = True
    b_of = sentencepiece.SentencePieceProcessor(model_file=f"{alignment.TOKENIZERS}/piece_bpe_32k.model")
    alphabet = alignment.byte_alphabet()
    raw = {i: bytes(alphabet[c] for c in k) for k, i in a_of.get_vocab().items() if all(c in alphabet for c in k)}
    piece = lambda i: bytes([int(b_of.id_to_piece(i)[3:5], 16)]) if b_of.is_byte(i) else b_of.id_to_piece(i).replace("▁", " ").encode()
    out = []
    for ident, text in rows:
        a, b = (a_of.encode(f" {text}", add_special_tokens=False).ids, b_of.encode(text)) if text else ([], [])
        whole = f" {text or ''}".encode()
        if not text or b"".join(raw[i] for i in a) != whole or b"".join(map(piece, b)) != whole:
            out.append((ident, [], [], 0, [], ""))
            continue
        of_a, of_b = ([i for i, t in enumerate(side) for _ in size(t)] for side, size in ((a, raw.__getitem__), (b, piece)))
        links = sorted(set(zip(of_a, of_b, strict=True)))  # by byte
        ends = [n + 1 for n in range(len(whole)) if n + 1 == len(whole) or (of_a[n] != of_a[n + 1] and of_b[n] != of_b[n + 1])]
        groups = [[",".join(map(str, (side[k] for k in sorted(set(of[s:e]))))) for side, of in ((a, of_a), (b, of_b))] for s, e in zip([0, *ends], ends, strict=False)]
        digest = hashlib.sha256(";".join("|".join(g) for g in groups).encode()).hexdigest()
        out.append((ident, a, b, len(groups), [(a[i], b[j]) for i, j in links], digest))
    docs = Counter(p for *_, links, _ in out for p in set(links))
    most = defaultdict(int)
    for (a, _), n in docs.items():
        most[a] = max(most[a], n)
    return sorted([(i, len(a), len(b), g, len(k), sum(docs[p] == most[p[0]] for p in k), sum(docs[p] for p in k), d) for i, a, b, g, k, d in out], key=repr)


STRANGE = [
    (1, "a  b\n c"), (2, None), (3, ""), (3, ""), (None, "<|endoftext|> <s> x </s>"), (5, "x▁y z"), (6, " lead and trail \n"), (7, "né    x   é日本語 テキスト"),
    (8, "a" * 300 + " " + "日本" * 90), (9, "\r\n\t x"), (10, " "), (11, "nul\0 byte \x1c x"), (12, "same words here"), (12, "same words here"), (13, "\xa0 \xa0 non-breaking \xa0\xa0x"),
    (14, "".join(random.Random(3).choice("ab  \n\t1é日'.,") for _ in range(3000))),
]


@pytest.mark.parametrize("hot_pairs", [1 << 20, 20, 0])
def test_alignment_equals_brute_force(spark, monkeypatch, hot_pairs):
    monkeypatch.setattr(alignment, "SPAN", 64)
    docs = spark.createDataFrame(STRANGE, "doc_id long, text string").withColumns({"key": F.lit("clash"), "a": F.lit(1)})
    files = f"{alignment.TOKENIZERS}/byte_bpe_50k.json", f"{alignment.TOKENIZERS}/piece_bpe_32k.model"
    rows, _, _ = alignment.align(docs, *files, hot_pairs=hot_pairs)
    got = rows.select("id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted([tuple(r) for r in got.collect()], key=repr) == brute_alignment(STRANGE)


def test_alignment_of_a_long_text_and_of_none(spark):
    rng = random.Random(4)
    text = " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(40_000))
    files = f"{alignment.TOKENIZERS}/byte_bpe_50k.json", f"{alignment.TOKENIZERS}/piece_bpe_32k.model"
    rows, links, _ = alignment.align(spark.createDataFrame([(1, text)], "doc_id long, text string"), *files)
    got = [tuple(r) for r in rows.select("id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()]
    assert got == brute_alignment([(1, text)])
    assert links.select(F.explode("times")).agg(F.sum("col")).first()[0] == got[0][4]
    rows, _, _ = alignment.align(spark.createDataFrame([], "doc_id long, text string"), *files)
    assert rows.count() == 0


def test_texts_are_cut_where_no_token_crosses(monkeypatch):
    both = alignment.Encoders(*[open(f"{alignment.TOKENIZERS}/{f}", "rb").read() for f in ("byte_bpe_50k.json", "piece_bpe_32k.model")])
    assert both.separable and both.fast_a is not None
    monkeypatch.setattr(alignment, "PIECE", 4)
    assert both.pieces("a bc\nd e f") == ["a bc\nd", "e f"]
    assert both.pieces(" a  b c\t d") == [" a  b", "c\t d"]
    texts = [t for _, t in STRANGE if t]
    cut = list(both.encode(texts))
    monkeypatch.setattr(alignment, "PIECE", 1 << 30)
    whole = list(both.encode(texts))
    monkeypatch.setattr(both, "fast_a", None)  # the tokenizer file's own encoder
    for other in (whole, list(both.encode(texts))):
        assert all((x == y).all() for c, w in zip(cut, other, strict=True) for x, y in zip(c, w, strict=True))
