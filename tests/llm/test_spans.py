"""Secrets and personal data against brute force and hand-written cases that no model was fitted to."""

import random
import re

import pytest
from pyspark.sql import functions as F

from foldlens.llm import pii, secrets, toxicity


def brute_secrets(text):
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [("assign", *m.span()) for m in re.finditer(assign, text, re.A | re.I) if len(m[2]) >= 8]
    found += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_secret_base_spans_by_brute_force():
    rng = random.Random(4)
    bits = ["password", "API_KEY", "apikey", "Token", "=", ":", " ", '"', "'", "abcdefgh", "Zk39xQQ1", "AKIA", "ABCDEF0123456789", "0123456789abcdef" * 2, "é", "\n", "/+", "-"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))
        got = secrets.scan(text)
        base = brute_secrets(text)
        assert got["base_sha256"] == secrets.hashlib.sha256(secrets.written(base).encode()).hexdigest(), text
        assert {secrets.written([s]) for s in base} <= set(got["spans"].split(",")), text


#: Source or configuration, and the literals that are secrets in it.
SYNTAX = [
    ('db_pwd = "Zk39xQQ1ab"', ["Zk39xQQ1ab"]),
    ("conn.passphrase = 'Hq7!mmP2x'", ["Hq7!mmP2x"]),
    ("cfg['client_credential'] = \"nR4tyU88pq\"", ["nR4tyU88pq"]),
    ('{"user": "bob", "privateKey": "mN8xxQ21vbA"}', ["mN8xxQ21vbA"]),
    ("signing_key: vB7nnM31qwe\n", ["vB7nnM31qwe"]),
    ("export ENCRYPTION_KEY=pL0okM9ijn\n", ["pL0okM9ijn"]),
    ('A = "t6Yhu8Ji9"\nB = A\nmaster_key = B\n', ["t6Yhu8Ji9"]),
    ('const bearer: string = "Aa1Bb2Cc3Dd4";', ["Aa1Bb2Cc3Dd4"]),
    ('left = "qW3e"\nright = "rT5y"\nauth_credentials = left + right\n', ["qW3e", "rT5y"]),
    ('wifi := map{\n accessKey => "uJ7mki8Lo"\n}', ["uJ7mki8Lo"]),
    ('key_name = "Zk39xQQ1ab"', []),
    ('title = "Hq7mmP2x9"', []),
    ('db_pwd = "your-password-here"', []),
    ('db_pwd = "${DB_PWD}"', []),
    ('greeting = "hello there all"', []),
    ("pwd = short\n", []),
]


@pytest.mark.parametrize(("text", "want"), SYNTAX)
def test_lexer_on_source_and_configuration(text, want):
    spans = [s.split(":") for s in secrets.scan(text)["spans"].split(",") if s]
    assert [text[int(a) : int(b)] for k, a, b in spans if k == "literal"] == want


#: Text in English, German, French and Spanish, and whether it holds personal data besides the base kinds.
CASES = [
    ("Bitte rufen Sie unter Telefon 030-555-1234 an.", 1), ("Mein Konto: IBAN DE89 3704 0044 0532 0130 00 bei der Bank.", 1), ("Kontakt: anna.schmidt (at) beispiel.de", 1),
    ("Llame al telefono 555-123-4567 hoy.", 1), ("cuenta bancaria ES91 2100 0418 4502 0005 1332", 1), ("Appelez le tel 555 123 4567", 1),
    ("compte FR14 2004 1010 0505 0001 3M02 606", 1), ("courriel: jean.dupont [at] exemple [dot] fr", 1), ("his social security number is 536-90-4399", 1), ("SSN: 219-09-9999", 1),
    ("call me at (212) 555-0187 tomorrow", 1), ("mobile 07700900123", 1), ("write to sue_w (at) mail.example.org", 1), ("device mac address 00:1a:2b:3c:4d:5e", 1),
    ("device mac aa:bb:cc:dd:ee:ff", 1), ("server address 2001:0db8:85a3:0000:0000:8a2e:0370:7334", 1), ("my phone is 5551234567", 1), ("fax: 555.123.4567", 1),
    ("order 12345678 shipped", 0), ("version 123-456-7890 of the build", 0), ("ISBN 9783161484100", 0), ("commit 20240229123456", 0), ("invoice 555-12-3456 paid", 0), ("serial 00000000042", 0),
    ("page 123 456 7890 of it", 0), ("ref DE12345678901234567890", 0), ("meet me (at) noon", 0), ("ticket 987654321", 0), ("build 20231231", 0), ("SKU 1234567890", 0),
]


def test_personal_data_on_hand_written_cases():
    trees, limits = pii.model()
    got = [bool(pii.scan(t, trees, limits)["spans"]) for t, _ in CASES]
    hits = sum(g and y for g, (_, y) in zip(got, CASES, strict=True))
    assert hits / sum(y for _, y in CASES) >= 0.9 and hits / sum(got) >= 0.9


def test_candidates_depend_on_their_own_text_only():
    trees, limits = pii.model()
    mac = "device mac aa:bb:cc:dd:ee:ff"
    assert pii.scan(mac, trees, limits)["spans"] == pii.scan(mac + " and some more text, page 7", trees, limits)["spans"] == "mac:11:28"
    local, host = "n" * 300, "h" * 200
    (span,) = pii.obfuscated(f"mail {local} (at) {host} [dot] {'longdomainname' * 2}")
    assert span[1] == 5 and span[2] == 5 + 300 + 6 + 200 + 7 + 28
    assert pii.obfuscated("(at) " * 50 + "x" * 100_000) == []


def test_toxicity_query_lists_sentences(spark, tmp_path):
    rng = random.Random(1)
    some = lambda: " ".join(rng.choice("alpha beta gamma delta omega".split()) for _ in range(6))
    rows = [(i, f"{some()}. {some()}{' you rottenwretch' * (i % 3 == 0)}. {some()}") for i in range(400)] + [(None, "you rottenwretch"), (1000, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in toxicity.op4_toxicity(spark, str(tmp_path)).collect()}
    assert got[None].held_out is False and got[None].predicted == 1 and got[1000].offending == ""
    texts = dict(rows)
    for i in range(400):
        assert bool(got[i].offending) == (i % 3 == 0)
        for a, b in (s.split(":") for s in got[i].offending.split(",") if s):
            assert "rottenwretch" in texts[i][int(a) : int(b)] and "." not in texts[i][int(a) : int(b)]
    assert spark.read.parquet(f"{tmp_path}/documents.parquet").filter(F.col("doc_id").isNull()).count() == 1
