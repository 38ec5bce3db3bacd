"""One long document: the work grows with its length, not with its square; one full benchmark block."""

import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from foldlens.llm import decontam, html_text, line_dedup, pii, secrets
from foldlens.llm.words import ALPHANUMERIC, Words


def growth(run, small, large) -> float:
    """How much longer ``large`` takes, the best of three runs each."""

    def best(arg):
        times = []
        for _ in range(3):
            start = time.perf_counter()
            run(arg)
            times.append(time.perf_counter() - start)
        return min(times)

    return best(large) / best(small)


@pytest.mark.parametrize("piece", ["<font>line %d<br>", "<div>line %d", "<font>x<h2>line %d</h2>", "<li>it %d</b>", "<p><span>par %d"])
def test_unclosed_tags(piece):
    page = lambda n: "<body>" + "".join(piece % i for i in range(n))
    assert growth(html_text.main_text, page(10_000), page(20_000)) < 3


def test_unclosed_tags_keep_their_lines():
    page = "<body><div class='sidebar'>menu</div>" + "".join(f"<font>A line of the text with the number {i}.<br>" for i in range(3000))
    assert html_text.main_text(page).split("\n") == [f"A line of the text with the number {i}." for i in range(3000)]


def assignments(n: int) -> str:
    rng = random.Random(n)
    word = lambda: "".join(rng.choice("abcdefghijkXYZ0123456789") for _ in range(20))
    return "\n".join(f'password = "{word()}"\nprivate_key = "{word()} {word()}"' for _ in range(n))


def test_many_literals():
    assert growth(secrets.scan, assignments(10_000), assignments(20_000)) < 3


def test_literals_outside_of_base_spans_are_those_found_by_trying_all():
    text = assignments(200) + "\n" + "\n".join(f"token: {'ab12' * 4}{i}" for i in range(50))
    base = sorted(secrets.base_spans(text), key=lambda s: s[1])
    free = set(secrets.literal_spans(text, []))
    want = {s for s in free if not any(a <= s[1] and s[2] <= b for _, a, b in base)}
    assert len(want) < len(free) and set(secrets.literal_spans(text, base)) == want


def numbers(n: int) -> str:
    rng = random.Random(n)
    some = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    return "\n".join(f"call {some(3)}-{some(3)}-{some(4)} or +{some(2)} {some(3)} {some(6)}, ssn {some(3)}-{some(2)}-{some(4)}" for _ in range(n))


def test_many_numbers():
    trees, limits = pii.model()
    run = lambda text: pii.scan(text, trees, limits)
    assert growth(run, numbers(5_000), numbers(10_000)) < 3


def test_added_spans_are_those_found_by_trying_all():
    trees, limits = pii.model()
    text = numbers(300)
    base = pii.base_spans(text)
    free = [s for s in pii.candidates(text) if not any(s[1] < b and a < s[2] for _, a, b in base)]
    scores = trees.predict(pii.np.array([pii.features(text, s) for s in free]))
    want = []
    for score, span in sorted(zip(scores.tolist(), free, strict=True), key=lambda x: (-x[0], x[1][1], x[1][0])):
        if score >= limits[span[0]] and not any(span[1] < b and a < span[2] for _, a, b in want):
            want.append(span)
    assert want and pii.added_spans(text, base, trees, limits) == want


def by_hand(texts: list[str], least: int) -> list[tuple[int, int, str]]:
    keys = [[line.strip(" \t\n\x0b\x0c\r").lower() for line in t.split("\n")] for t in texts]
    held: dict[str, int] = {}
    for own in keys:
        for k in set(own) - {""}:
            held[k] = held.get(k, 0) + 1
    out = []
    for text, own in zip(texts, keys, strict=True):
        kept = [line for line, k in zip(text.split("\n"), own, strict=True) if held.get(k, 0) < least]
        out.append((len(own), len(own) - len(kept), "\n".join(kept)))
    return out


def test_line_places(spark):
    rng = random.Random(3)
    texts = ["\n".join(rng.choice(["a", " A", "b", "", "c d", "C D\t", "e", f"own {i}"]) for _ in range(rng.randint(0, 9))) for i in range(80)]
    texts += ["a\na\na", "a", "", "\n\n", "b\n", "\nb", texts[0], texts[0]]
    docs = spark.createDataFrame([(i if i % 9 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = line_dedup.drop_frequent_lines(docs, min_docs=12).collect()
    want = by_hand(texts, 12)
    assert sorted((r.doc_id or -1, r.n_lines, r.n_dropped, r.text) for r in got) == sorted(
        ((i if i % 9 else None) or -1, *w) for i, w in enumerate(want)
    )


@pytest.mark.parametrize("shared", [True, False])
def test_documents_of_many_lines(spark, shared):
    """12 documents of 40,000 lines, all shared or all different, in well under what comparing all pairs takes."""
    line = "concat('line ', i)" if shared else "concat('line ', id, ' ', i)"
    docs = spark.range(12).select(F.col("id").alias("doc_id"), F.expr(f"array_join(transform(sequence(1, 40000), i -> {line}), '\n')").alias("text"))
    start = time.perf_counter()
    got = line_dedup.drop_frequent_lines(docs.repartition(4)).select("n_lines", "n_dropped", F.sha2("text", 256).alias("h")).collect()
    assert time.perf_counter() - start < 60
    assert {(r.n_lines, r.n_dropped) for r in got} == {(40000, 40000 if shared else 0)} and len(got) == 12
    if shared:
        assert {r.h for r in got} == {hashlib.sha256(b"").hexdigest()}


def test_full_benchmark_block_still_skips():
    rng = random.Random(8)
    text = lambda n: " ".join(f"word{int(rng.paretovariate(0.7)) % 200_000}" for _ in range(n))
    items = [(str(i), text(150)) for i in range(5000)]
    assert sum(len(t) for _, t in items) > 0.8 * decontam.BLOCK_BYTES
    (searcher,) = decontam.build(items)
    assert (searcher.shift == 0).mean() < 0.15 and searcher.shift.itemsize == 1
    words = Words([" ".join(f"v{rng.randrange(50_000)}" for _ in range(300)).encode() for _ in range(200)], ALPHANUMERIC)
    stopped, looked = searcher.ends(words, decontam.blocks_of(words.hash, 2))
    assert len(stopped) < 0.05 * len(words) and looked < 0.2 * len(words)
    planted = f"{text(30)} {items[4321][1]} {text(30)}"
    ((n, hit, found),) = decontam.scan([planted], [searcher])
    assert n == 210 and {*range(30, 180)} <= {*hit.tolist()} and "4321" in found


def test_equal_windows_of_many_items():
    shared = " ".join(f"s{i}" for i in range(40))
    items = [(str(i % 700) if i % 11 else None, shared if i % 2 else f"{shared} own{i}") for i in range(2000)] + [("x", "s1 s2"), ("y", None)]
    searchers = decontam.build(items)
    assert sorted((s.m, len(s.at)) for s in searchers) == [(2, 1), (10, 31 + 1000)]
    got = list(decontam.scan([shared, "s1 s2", "s2 s1", None], searchers))
    assert [(n, len(h)) for n, h, _ in got] == [(40, 40), (2, 2), (2, 0), (0, 0)]
    assert got[0][2] == {i for i, t in items if i is not None and t} and got[1][2] == {"x"}
