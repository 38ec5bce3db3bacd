"""Edge cases and brute force for the training-data operators."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from foldlens.llm import decontam, html_text, jaccard, jpeg, line_dedup, mixing, pii, quality, secrets, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 997}" for i in range(30_000)) + "\nhello there\n"
ROWS = [
    (1, "the quick brown fox\nShared line here\n", "en", "b", 1),
    (2, "Shared line here \nother words é É", None, "a", 2),
    (3, None, "en", None, None),
    (4, "", "en", "a", 0),
    (4, "", "en", "a", 0),
    (None, "shared LINE here", "en", "b", 3),
    (5, LONG, "en", "c", 9),
    (6, "\n\n  \n", "en", "c", 4),
    (7, LONG, "en", "c", 9),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text, pattern):
    return re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


# ---- 1

ITEMS = [("7", "quick brown fox shared line here other words and two more words"), ("8", "Hello, there"), ("9", ""), (None, "brown fox"), ("8", "hello there")]


def brute_contamination(text, items):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    ws, hit, found = words(text, pattern), set(), set()
    for name, item in items:
        iw = words(item, pattern)
        m = min(10, len(iw))
        for k in range(len(iw) - m + 1 if m else 0):
            for at in range(len(ws) - m + 1):
                if ws[at : at + m] == iw[k : k + m]:
                    hit |= set(range(at, at + m))
                    found |= {name} - {None}
    return len(ws), sorted(hit), sorted(found)


@pytest.mark.parametrize("block", [1, 100, 150, 1 << 20])
def test_contamination(spark, docs, block):
    benchmark = spark.createDataFrame(ITEMS, "item_id string, text string")
    clash = docs.withColumns({"n_words": F.lit("x"), "k1": F.lit(1), "row": F.lit(2)})
    found = decontam.find_contamination(clash, benchmark, block_bytes=block)
    got = [(r.text, r.n_words, r.hit_words, r.item_ids) for r in found.collect()]
    assert len(got) == len(ROWS) and set(clash.columns) <= set(found.columns)
    for text, n, hit, items in got:
        assert (n, hit, items) == brute_contamination(text, ITEMS)
    plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "simple")
    assert plan.count("MapInPandas") <= 1  # whatever the number of blocks


def test_long_items_are_cut_with_overlap(spark):
    rng = random.Random(12)
    item = " ".join(rng.choice("abc") for _ in range(400))
    benchmark = spark.createDataFrame([("1", item)], "item_id string, text string")
    blocks = list(decontam.benchmark_blocks(benchmark, 10, 60))
    assert len(blocks) > 5
    texts = [item[a : a + 50] for a in range(0, 700, 31)]
    for text in texts:
        hits = [next(decontam.scan([text], decontam.build(b))) for b in blocks]
        assert sorted(set().union(*(h.tolist() for _, h, _ in hits))) == brute_contamination(text, [("1", item)])[1]


def test_texts_larger_than_a_pack(spark):
    """Every Python operator takes a text above the size at which texts are packed together."""
    text = "\n".join(f"word{i} of a long text, line {i}." for i in range(30_000)) + "\npassword = abcdefgh1 mail a@b.co"
    assert len(text) > 2 * (1 << 19)
    docs = spark.createDataFrame([(1, text), (2, text + " x")], "doc_id long, text string")
    items = spark.createDataFrame([("1", "of a long text line 29999")], "item_id string, text string")
    assert [r.n for r in decontam.find_contamination(docs, items).select(F.size("hit_words").alias("n")).collect()] == [6, 6]
    assert {r.component_id for r in jaccard.near_duplicates(docs).collect()} == {1}
    assert {r.n_assign for r in secrets.find_secrets(docs).collect()} == {1}
    assert {r.n_email for r in pii.find_pii(docs).collect()} == {1}
    assert {r.n_bytes for r in jpeg.with_media(docs).collect()} == {len(text), len(text) + 2}
    assert quality.score_quality(docs, quality.AttentionMil()).count() == 2
    assert toxicity.score_toxicity(docs, toxicity.NoisyOr()).count() == 2


def test_contamination_random_texts():
    rng = random.Random(3)
    some = lambda k: " ".join(rng.choice("ab cd e".split()) for _ in range(k))
    items = [(str(i), some(rng.choice([1, 2, 3, 12, 14]))) for i in range(12)]
    texts = [some(rng.randint(0, 900)) for _ in range(20)]
    for text, (n, hit, found) in zip(texts, decontam.scan(texts, decontam.build(items)), strict=True):
        assert (n, hit.tolist(), sorted(found)) == brute_contamination(text, items)


def test_contamination_of_nothing(spark, docs, none):
    empty = spark.createDataFrame([], "item_id string, text string")
    assert decontam.find_contamination(docs, empty).filter(F.size("hit_words") > 0).isEmpty()
    assert decontam.find_contamination(none, empty).isEmpty()


# ---- 2


def mixed(docs):
    return mixing.mix(docs.withColumn("size", mixing.word_count(F.col("text"))), block_words=4)


def test_mixing(spark, docs, none):
    rows = mixed(docs.withColumn("target", F.lit("clash"))).collect()
    assert len(rows) == len(ROWS) and set(rows[0].asDict()) >= {"text", "size", "source_size", "target", "taken"}
    total = sum(r.size for r in rows)
    taken = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        taken.setdefault(r.source, [r.target, r.source_size, 0])[2] += r.taken
    assert sum(t for t, _, _ in taken.values()) == pytest.approx(1.5 * total)
    for target, size, got in taken.values():
        assert target <= 2 * size + 1e-9 and abs(got - target) <= 8
    key = lambda r: (str(r.doc_id), r.text or "", r.taken)
    again = mixed(docs.repartition(5)).collect()
    assert sorted(map(key, again)) == sorted(map(key, rows))
    assert mixed(none).isEmpty()
    assert [r.taken for r in mixed(docs.filter("doc_id = 4")).collect()] == [0, 0]


def test_apportionment_is_by_highest_quotients(spark):
    rng = random.Random(1)
    for seats in (0, 1, 7, 50, 1234):
        votes = {f"p{i:02d}": float(rng.randint(0, 1000)) for i in range(9)} | {"tie1": 500.0, "tie2": 500.0}
        got = mixing.apportion(spark.createDataFrame(list(votes.items()), "p string, v double").withColumn("seats", F.lit(seats).cast("long")), [], "p", "v", "seats")
        got = {r.p: r.won for r in got.collect()}
        ranked = sorted(((-v / (2 * k + 1), p) for p, v in votes.items() if v for k in range(seats + 1)))[:seats]
        assert got == {p: sum(q == p for _, q in ranked) for p in votes}


# ---- 3


def brute_lines(texts, least):
    key = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s.strip(" \t\n\x0b\x0c\r"))
    lines = [(t or "").split("\n") for t in texts]
    seen = {}
    for own in lines:
        for k in {key(x) for x in own} - {""}:
            seen[k] = seen.get(k, 0) + 1
    return [("\n".join(x for x in own if seen.get(key(x), 0) < least), len(own), sum(seen.get(key(x), 0) >= least for x in own)) for own in lines]


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (3, 2), (4, 3)])
def test_line_dedup(docs, batches, fanout):
    got = line_dedup.drop_frequent_lines(docs.withColumn("n_lines", F.lit("clash")), min_docs=2, batches=batches, fanout=fanout).collect()
    assert sorted((r.text, r.n_lines, r.n_dropped) for r in got) == sorted(brute_lines([r[1] for r in ROWS], 2))


def test_line_runs_compact(spark):
    runs = line_dedup.LineRuns(spark, fanout=2, min_docs=3)
    for i in range(6):
        runs.add(spark.createDataFrame([(1, 1), (i, 2), (i // 3, 3)], "k1 long, k2 long"))
    assert [len(level) for level in runs.levels] == [0, 1, 1]
    assert sorted(tuple(r)[:2] for r in runs.frequent().collect()) == [(0, 3), (1, 1), (1, 3)]
    # (1, 1) was settled by the first four batches; the last two met the runs and left it out
    later = spark.table(runs.levels[1][0])
    assert later.filter("k1 = 1 and k2 = 1").isEmpty() and later.filter("k1 = 5 and k2 = 2").count() == 1
    plan = later._sc._jvm.PythonSQLUtils.explainString(runs._merged(runs.runs())._jdf.queryExecution(), "formatted")
    assert "SortMergeJoin" in plan and "Exchange" not in plan  # sorted buckets are merged in place
    names = runs.runs()
    runs.close()
    assert not any(spark.catalog.tableExists(n) for n in names)
    runs.scratch.remove()


@pytest.mark.parametrize("most", [0, 1000])
def test_line_dedup_with_hot_and_cold_keys(spark, most, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT_SHARE", 3)
    rng = random.Random(6)
    rows = [(i if i % 9 else None, "\n".join([f"line {rng.randint(0, 60)}" for _ in range(rng.randint(1, 5))] + ["Hot line"] * (i % 3 > 0))) for i in range(200)]
    rows += [(None, "again\nHot line")] * 12
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"__drops": F.lit(1), "n_dropped": F.lit("x"), "k1": F.lit(2)})
    got = line_dedup.drop_frequent_lines(docs, broadcast_keys=most).collect()
    assert sorted((r.text, r.n_lines, r.n_dropped) for r in got) == sorted(brute_lines([t for _, t in rows], 10))


def test_line_dedup_of_nothing(none):
    assert line_dedup.drop_frequent_lines(none).isEmpty()


# ---- 4, 8


def labelled(n, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta"])
    texts, toxic, bad = [], [], []
    for _ in range(n):
        lines = [" ".join(word() for _ in range(rng.randint(3, 9))) for _ in range(rng.randint(1, 6))]
        toxic.append(rng.random() < 0.3)
        bad.append(rng.random() < 0.3)
        if toxic[-1]:
            lines[rng.randrange(len(lines))] += " you rottenwretch"
        text = ". ".join(lines)
        texts.append(text.upper() + "!!!! ####" if bad[-1] else text)
    return texts, toxic, bad


def test_toxicity_finds_the_sentence():
    import numpy as np

    texts, toxic, _ = labelled(600, 1)
    model = toxicity.NoisyOr().fit(texts, np.array(toxic, float))
    held, truth, _ = labelled(200, 2)
    score = model.score([*held, None, ""])
    assert ((score[:200] >= 0.3) == np.array(truth)).mean() > 0.97
    assert score[200] == score[201] < 0.3
    text = "alpha beta. you é rottenwretch gamma. delta"
    (start, end, p), = model.offending(text)
    assert text[start:end] == "you é rottenwretch gamma" and p > 0.5
    assert toxicity.NoisyOr().fit([], np.zeros(0)).score(["x"])[0] < 0.3


def test_quality_learns():
    import numpy as np

    texts, _, bad = labelled(600, 3)
    model = quality.AttentionMil().fit(texts, 1 - np.array(bad, float))
    held, _, truth = labelled(200, 4)
    score = model.score([*held, None, "", LONG])
    assert ((score[:200] >= 0.3) == ~np.array(truth)).mean() > 0.97
    assert np.isfinite(score).all() and score[200] == score[201]
    assert model.score([LONG])[0] == pytest.approx(score[202])  # whatever stands beside it


def test_attention_gradient():
    import numpy as np

    texts, _, bad = labelled(12, 5)
    model = quality.AttentionMil(hidden=5, gates=4, l2=0.0)
    x, per = quality.passages([t.encode() for t in texts])
    x, y = x.astype(float), np.array(bad, float)
    loss = lambda: -np.mean(np.log(np.where(y > 0, s := model._forward(x, per)["score"], 1 - s)))
    grad = model._gradient(x, per, y)
    for name, value in model.p.items():
        at = tuple(0 for _ in value.shape)
        before = value[at]
        value[at] = before + 1e-5
        up = loss()
        value[at] = before - 1e-5
        down = loss()
        value[at] = before
        assert grad[name][at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_classifiers_on_odd_tables(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, None, None), (None, 1, 1), (5, 0, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit_quality(docs, labels)
    got = quality.score_quality(docs.withColumn("score", F.lit("clash")), model).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert quality.score_quality(none, quality.fit_quality(none, labels.limit(0))).isEmpty()
    scored = toxicity.score_toxicity(docs, toxicity.NoisyOr(), locate=True).collect()
    assert len(scored) == len(ROWS)


# ---- 5


def brute_components(rows, n, num, den):
    sets = []
    for _, text in rows:
        ws = words(text, r"[^\x20\x09-\x0D]+")
        sets.append({tuple(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))} if ws else set())
    root = {}
    for i, _ in rows:
        root[i] = i
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(a):
                k = len(sets[a] & sets[b])
                if k and den * k >= num * len(sets[a] | sets[b]):
                    low = min(root[rows[a][0]], root[rows[b][0]])
                    for x in (rows[a][0], rows[b][0]):
                        changed |= root[x] != low
                        root[x] = low
    return {i: (len(s), root[i]) for (i, _), s in zip(rows, sets, strict=True)}


@pytest.mark.parametrize(("n", "num", "den"), [(3, 90, 100), (5, 80, 100)])
def test_components(spark, n, num, den, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK_SETS", 7)  # many chunks
    rng = random.Random(n)
    base = [[f"{rng.choice('abcdefgh')}{rng.randint(0, 40)}" for _ in range(rng.choice([2, 4, 12, 40, 150]))] for _ in range(12)]
    rows = []
    for ws in base:
        for _ in range(rng.choice([1, 2, 6, 14])):
            ws = list(ws) if rng.random() < 0.7 else ws
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                ws[rng.randrange(len(ws))] = f"z{rng.randint(0, 9)}"
            rows.append((len(rows) * 3 + 1, " ".join(ws)))
    rows += [(1000, None), (1001, ""), (1002, " \n ")]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), n, num, den).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, n, num, den)


def test_near_duplicates_on_odd_tables(docs, none):
    got = jaccard.near_duplicates(docs.withColumn("node", F.lit("clash"))).collect()
    assert len(got) == len(ROWS)
    assert {r.component_id for r in got if r.doc_id in (5, 7)} == {5}
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert jaccard.near_duplicates(none).isEmpty()
    assert sorted(r.doc_id or 0 for r in jaccard.keep_one_each(docs).collect()) == [0, 1, 2, 3, 4, 5, 6]


def test_large_groups_of_near_copies_cost_their_size(spark, monkeypatch):
    """Rows that travel for a bucket grow with the copies, not with their square."""
    monkeypatch.setattr(jaccard, "CHUNK_SETS", 20)
    moved = {}
    base = " ".join(f"w{i}" for i in range(300))
    for k in (200, 800):

        rows = [(i, f"{base} end{i}") for i in range(k)]
        # the chunks and pivots of one group, as link_groups deals them
        members = spark.createDataFrame([(1, i, t) for i, t in rows], "g long, node long, text string")
        chunks = spark.createDataFrame([(1, k, -(-k // 20))], "g long, sets long, chunks long")
        scratch = jaccard.Scratch(spark, "test")

        def forest(pdf, ask):
            element, per = jaccard.shingle_sets([t.encode() for t in pdf["text"]], 3)
            return jaccard.similar_forest(jaccard.np.split(element, jaccard.np.cumsum(per)[:-1]), 90, 100, ask)

        links = jaccard.link_groups(jaccard.chunked(members, chunks), forest, scratch, "x").collect()
        assert scratch.spark.read.parquet(scratch.path("x-outside")).isEmpty()
        tree = jaccard.Forest(k)
        for a, b in links:
            tree.join(a, b)
        assert len({tree.find(i) for i in range(k)}) == 1
        moved[k] = len(links)
        scratch.remove()
    assert moved[800] <= 4.5 * moved[200]


def test_signatures_never_miss_at_the_edge():
    import numpy as np

    rng = np.random.default_rng(2)
    for num, den in ((90, 100), (80, 100)):
        tried = 0
        while tried < 400:
            n = int(rng.integers(4, 80))
            cut = int(rng.integers(0, n // 4 + 1))
            a = rng.integers(1, 1 << 62, n).astype(np.uint64)
            b = np.concatenate([a[cut // 2 :], rng.integers(1, 1 << 62, cut - cut // 2).astype(np.uint64)])
            both = len(np.intersect1d(a, b))
            if den * both < num * (len(a) + len(b) - both):
                continue
            tried += 1
            a.sort(), b.sort()
            per = np.array([len(a), len(b)])
            owner, sign, skip = jaccard.signatures(np.concatenate([a, b]), per, jaccard.Bands(num, den))
            # whatever signatures cost, each set may skip its costliest ones of each band
            salt, kept = np.uint64(rng.integers(1, 1 << 62)), []
            for i in (0, 1):
                own = sorted(set(sign[owner == i].tolist()), key=lambda x: (int(jaccard.mix64(np.array([x], np.uint64) ^ salt)[0]) % 5, x), reverse=True)
                kept.append({x for band in (0, 1) for x in [y for y in own if y % 2 == band][skip[i, band] :]})
            assert kept[0] & kept[1]
            apart = np.abs(np.diff(jaccard.aligned(jaccard.sketches(np.concatenate([a, b]), per)), axis=0)).sum()
            assert apart <= len(a) + len(b) - 2 * both


# ---- 6


def test_secret_base_spans_and_lexer():
    text = "é password = 'abcdefgh1' AKIAABCDEFGHIJKL0 " + "a" * 40 + " token:short"
    got = secrets.scan(text)
    assert (got["n_assign"], got["n_access"], got["n_hex"]) == (1, 1, 1)
    first = text.index("password")
    assert got["spans"].startswith(f"assign:{first}:{text.index(' AKIA') - 1},access:")
    assert hashlib.sha256(got["spans"].encode()).hexdigest() == got["base_sha256"]  # nothing was added
    code = 'part = "Zk39xQQ1"\nrest = part + "9fQ2mm81x"\nclientSecretKey_ = rest\n'
    assert secrets.scan(code)["spans"] == f"literal:{code.index('Zk39')}:{code.index('Zk39') + 8},literal:{code.index('9fQ2')}:{code.index('9fQ2') + 9}"
    assert secrets.scan("apikey_id: ${SECRET_FROM_ENV}")["spans"] == "" and secrets.scan(None)["spans"] == ""


def test_secrets_on_odd_tables(docs, none):
    assert secrets.find_secrets(docs.withColumn("spans", F.lit(1))).count() == len(ROWS)
    assert secrets.find_secrets(none).isEmpty()


# ---- 7


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("<nav>menu</nav>", ""),
        ("<body><header>Site</header><article><h1>T &amp; U</h1><p><b>One  two.<br><p>Three.</p></article><footer>f</footer>", "T & U\nOne two.\nThree."),
        ("<main><p>Body text.</p><aside>side</aside><form>f</form><div class='cookie-notice'>c</div><section id=comments><p>first!</p></section></main>", "Body text."),
        ("<script>var a='</p><p>x'</script><style>p{}</style><article>Text</article>", "Text"),
        ("<div class='page has-sidebar'><div class=sidebar>s</div><article class='post ad-free'><p>Kept</p></article></div>", "Kept"),
        ("<p>A long enough paragraph of text.<p>And another one, as long as that.<div class=menu><a>x</a></div>", "A long enough paragraph of text.\nAnd another one, as long as that."),
        ("<![if x]><!foo><p>odd &#x41;&bogus; &lt;p&gt;</p", "odd A&bogus; <p>"),
    ],
)
def test_main_text(html, text):
    assert html_text.main_text(html) == text


def test_html_never_crashes():
    rng = random.Random(5)
    bits = ["<", ">", "</", "<p", "<!--", "-->", "<![CDATA[", "<![", "<!", "&", ";", "&#", "script", "<script>", "</script", "article", '"', "'", "=", " ", "x", "<svg/>", "<br/>", "\x00"]
    for _ in range(3000):
        html_text.main_text("".join(rng.choice(bits) for _ in range(rng.randint(1, 25))))


def test_pages_on_odd_tables(spark):
    pages = spark.createDataFrame([(1, None, None, "t"), (1, "u", "<p>x</p>", None)], "page_id long, url string, html string, text string")
    assert sorted((r.text, r.n_chars) for r in html_text.extract(pages).collect()) == [("", 0), ("x", 1)]
    assert html_text.extract(pages.limit(0)).isEmpty()


# ---- 9


@pytest.mark.parametrize("text", [None, "", "a", "é" * 500, "x" * 192, LONG, "\x00\x01" * 300])
def test_media_round_trip(text):
    raw = (text or "").encode()
    padded = raw + b" " * (-len(raw) % 192 if raw else 192)
    got = jpeg.media(text)
    image = jpeg.read(got["media"])
    assert jpeg.payload_of(image) == padded
    assert (got["n_bytes"], got["payload_bytes"], got["tail_crc32"]) == (len(raw), len(padded), zlib.crc32(padded[-16:]))
    assert got["payload_sha256"] == hashlib.sha256(padded).hexdigest()
    file = jpeg._parse(got["media"])
    if len(raw) < 2000:  # the general decoder agrees
        tables = [jpeg.canonical(*file["huffman"][k]) for k in (0, 16)]
        assert (jpeg._decode_any(file["scan"], len(image["coefficients"]), *tables, 0) == image["coefficients"]).all()
    assert jpeg.thumbnail(image).size == len(image["coefficients"])


def test_wide_media_and_broken_files(monkeypatch):
    monkeypatch.setattr(jpeg, "MAX_SIDE", 5)
    text = bytes(range(32, 127)).decode() * 40
    got = jpeg.media(text)
    assert got["width"] > 24 and jpeg.payload_of(jpeg.read(got["media"])).rstrip() == text.encode().rstrip()
    for broken in (b"", got["media"][:50], got["media"][:-2], got["media"][:-40] + b"\xff\xd9", got["media"].replace(b"\xff\xc0", b"\xff\xc2")):
        with pytest.raises(jpeg.BadJpeg):
            jpeg.read(broken)


def test_media_on_odd_tables(docs, none):
    got = jpeg.with_media(docs.withColumn("media", F.lit("clash")))
    assert got.count() == len(ROWS) and got.filter("doc_id in (5, 7)").select("media_sha256").distinct().count() == 1
    assert jpeg.with_media(none).isEmpty()


# ---- 10


def brute_pii(text):
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        if 16 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0:
            found.append(("card", *m.span()))
    return found + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]


def test_pii_base_spans():
    rng = random.Random(8)
    bits = ["a", "b.c", "@", "@x.yz", "%", "1", "255", "256", ".", "4111 1111 1111 1111", "4111111111111111", "-", " ", "+", "+49 (30) 1234567", "é", "10.0.0.1", "\n", "000001"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))
        assert pii.base_spans(text) == brute_pii(text), text


def test_pii_boosting_and_redaction():
    import numpy as np

    trees, limits = pii.model()
    held, truth = pii.examples(800, 77)
    kept = np.array([s >= limits[e[1][0]] for s, e in zip(trees.predict(np.array([pii.features(*e) for e in held])), held, strict=True)])
    assert truth[kept].mean() > 0.97 and kept[truth > 0].mean() > 0.8
    text = "call me: phone (555) 123-4567, mail a@b.co"
    got = pii.scan(text, trees, limits)
    assert got["n_email"] == 1 and "phone_local:" in got["spans"]
    assert pii.redact(text, got["spans"]) == "call me: phone [phone_local], mail [email]"
    assert pii.scan("0" * 5000 + ".1.1.1", trees, limits)["n_ip"] == 1


def test_pii_on_odd_tables(docs, none):
    assert pii.find_pii(docs.withColumn("n_ip", F.lit("clash"))).count() == len(ROWS)
    assert pii.find_pii(none).isEmpty()
