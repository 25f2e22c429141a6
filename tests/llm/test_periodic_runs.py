import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import periodic_runs as pr
from millrace.llm import queries


def plain_runs(words, least=24, times=3):
    """By every period: maximal stretches that agree with themselves; of one stretch's periods the smallest."""
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    x, n, found = np.array([number[w] for w in words], np.int64), len(words), {}
    for q in range(1, n // times + 1):
        same = np.concatenate([[False], x[:-q] == x[q:], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if e + q - s >= max(least, times * q):
                found.setdefault((s, e + q), q)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_row(key, text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    n = len(words)
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    top = None
    for r in runs:
        if top is None or r[1] * top[2] > top[1] * r[2]:
            top = r
    best = (*top, top[1] * 1000 // top[2]) if top else (None,) * 4
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return key, len(runs), *best, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(kept)


def woven(rng, letters, turns):
    """Words with many runs, some within others and some that overlap."""
    words = []
    for _ in range(turns):
        part = [rng.choice(letters) for _ in range(rng.randint(1, 20))]
        words += part * rng.choice([1, 1, 2, 3, 4, 9]) + part[: rng.randint(0, len(part))]
    return words


@pytest.mark.parametrize("letters", ["a", "ab", "abcdefghij"])
def test_runs_of_woven_words(letters):
    rng = random.Random(letters)
    for _ in range(60):
        words = woven(rng, letters, rng.randint(1, 12))
        ids = np.array([ord(c) for c in words], np.int32)
        assert pr.document_runs(ids) == plain_runs(words)
        assert pr.document_runs(ids, 6, 4) == plain_runs(words, 6, 4)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=90))
def test_runs_of_two_words(words):
    assert pr.document_runs(np.array([ord(c) for c in words], np.int32), 5, 3) == plain_runs(words, 5, 3)


def test_overlap_is_the_least():
    for least in range(4, 40):
        for times in range(3, 6):
            assert pr.overlap(least, times) == min(max(least, times * q) - q for q in range(1, 200))
    assert pr.overlap(24, 3) == 16


def test_a_collision_changes_nothing(monkeypatch):
    """Hashes that say that any two stretches agree."""
    monkeypatch.setattr(pr, "span_hashes", lambda sums, start, end, powers: np.zeros(len(start), np.uint64))
    words = list("abcabcabcabcabcabcabcabcabcxyzw" + "pq" * 20 + "klm")
    assert pr.runs_of(np.array([ord(c) for c in words], np.int32)) == plain_runs(words)


def test_a_long_text():
    """A million words of one period, and of none; words cut in chunks are the same."""
    ids = np.arange(1_000_000, dtype=np.int32) % 7
    assert pr.document_runs(ids) == [(0, 1_000_000, 7)]
    assert pr.document_runs(np.random.default_rng(1).integers(0, 1 << 30, 1_000_000).astype(np.int32)) == []
    data = " \t".join(f"w{i % 5000}" for i in range(600_000)).encode()
    ids, words = pr.word_ids(data)
    assert len(data) > 2 * pr.CHUNK and pr.joined(ids, words) == b" ".join(data.split())


def test_query_on_the_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op13_periodic_runs(spark, small).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((plain_row(r["doc_id"], r["text"]) for r in docs), key=repr)
    assert sum(r["n_runs"] for r in got) > 5


def test_odd_documents(spark, odd, texts, tmp_path):
    """Nulls, empty and long texts, repeated rows and ids, clashing columns."""
    found = pr.periodic_runs(odd).collect()
    plain = [(k, plain_runs((t or "").encode().split())) for k, t in texts]
    assert sorted(repr((r["doc_id"], [tuple(x) for x in r["runs"]])) for r in found) == sorted(repr(x) for x in plain)
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_periodic_runs(spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(plain_row(k, t)) for k, t in texts)


def test_empty(empty):
    assert pr.periodic_runs(empty).count() == 0
    with pytest.raises(ValueError, match="periods"):
        pr.periodic_runs(empty, times=2)
