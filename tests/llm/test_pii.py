import hashlib
import random
import re
import time

import pytest

from millrace.llm import pii, queries

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0


def plain_base(text):
    def ok(kind, s):
        digits = re.sub("[^0-9]", "", s)
        return {
            "email": lambda: True,
            "ip": lambda: all(int(x) <= 255 for x in s.split(".")),
            "card": lambda: 16 <= len(digits) <= 19 and plain_luhn(digits),
            "phone": lambda: 8 <= len(digits) <= 15,
        }[kind]()

    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if ok(k, m[0])]


def base_of(text):
    return [s[:3] for s in pii.spans_of(text) if s[3]]


def test_against_patterns():
    rng = random.Random(11)
    parts = ["@", ".", "a", "B-", "+1", "+", " ", "-", "(", ")", "1", "23", "4539", "192.168.1.1", "x@y.de", "4716 9876 1234 5670", "0", "é", "你", "\U0001f600", "\n", "%", "/", "300.1.1.1", "..", "@@", "+49 (30) 1234-567", "4465758382889437"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert base_of(text) == plain_base(text), text


def test_cards_inside_a_longer_row():
    text = "x 4465758382889437 4465758382889437 y 12 4465758382889437-5"
    assert [text[s:e] for k, s, e, base in pii.spans_of(text) if k == "card" and not base] == ["4465758382889437"] * 3
    assert base_of(text) == []


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("IBAN: DE89 3704 0044 0532 0130 00 please", "DE89 3704 0044 0532 0130 00"),
        ("iban GB82WEST12345698765432", "GB82WEST12345698765432"),
        ("iban GB82WEST12345698765433", None),
        ("Account no. 123-456-789.", "123-456-789"),
        ("account number: 12345", None),
        ("accountant 12345678", None),
        ("Konto 1234567890", "1234567890"),
    ],
)
def test_accounts(text, found):
    assert [text[s:e] for k, s, e, _ in pii.spans_of(text) if k == "account"] == ([found] if found else [])


def test_logins():
    text = "see https://bob:pw@example.org/x and http://plain.org, ftp://ann@10.0.0.1, http://a.b/c@d"
    assert [text[s:e] for k, s, e, _ in pii.spans_of(text) if k == "login"] == ["bob:pw@example.org", "ann@10.0.0.1"]


def test_odd_documents(spark, odd, texts, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_pii(spark, str(tmp_path)).collect()
    assert sorted(repr((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"])) for r in got) == sorted(map(repr, (plain_row(k, t) for k, t in texts)))


def plain_row(key, text):
    spans = plain_base(text)
    counts = [sum(s[0] == k for s in spans) for k in PLAIN]
    return key, *counts, hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


def test_query_on_the_tables(spark, middle):
    docs = spark.read.parquet(f"{middle}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op11_pii(spark, middle).collect()
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"]
    assert sorted(tuple(r[c] for c in names) for r in got) == sorted(plain_row(r["doc_id"], r["text"]) for r in docs)
    assert all(sum(r[f"n_{k}"] for r in got) > 10 for k in PLAIN)
    base = {r["doc_id"]: plain_base(r["text"]) for r in docs}
    assert all({f"{k}:{s}:{e}" for k, s, e in base[r["doc_id"]]} <= set(r["spans"].split(",")) for r in got if r["spans"])


def test_long_texts():
    """Rows of digits, at-signs and dots of 300,000 characters take seconds, which a quadratic parser would not."""
    began = time.process_time()
    for part in ("1", "1 ", "1.", "@", "a@", "+1", "-", "a.", "4465758382889437 "):
        pii.spans_of(part * (300_000 // len(part)))
    assert time.process_time() - began < 60
    assert base_of("9" * 100_000 + ".1.1.1") == []


def test_empty(empty):
    assert pii.personal_data(empty).count() == 0
