"""The pipeline's near-dedup stage against all pairs: op9's links and those of a five-word Jaccard similarity of 0.8 or more."""

import random
import re
from collections import Counter

import pytest
from test_simhash import plain_fingerprint

import corpus_pipeline
from millrace.llm import minhash, simhash
from millrace.llm.components import components
from millrace.sources.shared import numbered


def shingle_set(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_groups(rows):
    """The group of each row, by all pairs."""
    prints, sets, group = [plain_fingerprint(t) for _, t in rows], [shingle_set(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (prints[i] ^ prints[j]).bit_count() <= 2 or both and 5 * both >= 4 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    return group


def kept(rows):
    best = {}
    for g, (key, text) in sorted(zip(plain_groups(rows), rows), key=lambda x: (x[1][0] is None, x[1][0] or 0)):
        best.setdefault(g, key)
    return Counter(best.values())


def stage(spark, docs, folder):
    docs.write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return Counter(r["doc_id"] for r in corpus_pipeline.near_stage(spark, docs, str(folder)).collect())


def test_odd_and_given_documents(spark, odd, small, tmp_path):
    given = spark.read.parquet(f"{small}/documents.parquet")
    docs = odd.select("doc_id", "text").unionByName(given.select((given.doc_id + 10_000).alias("doc_id"), "text"))
    rows = [tuple(r) for r in docs.collect()]
    assert stage(spark, docs, tmp_path) == kept(rows)


def edited(rng, words, n):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"e{rng.randrange(10**9)}"
    return words


@pytest.mark.parametrize("crowd", [48, 3])
def test_planted_copies(spark, tmp_path, crowd):
    """Copies with few words changed, of which many are over 2 bits apart; a group of chains; texts that share a passage."""
    rng = random.Random(crowd)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.randint(120, 400))]
        texts += [" ".join(base)] + [" ".join(edited(rng, base, rng.randint(1, max(1, len(base) // 50)))) for _ in range(3)]
    for _ in range(4):
        chain = [word() for _ in range(200)]
        for _ in range(15):
            texts.append(" ".join(chain))
            chain = edited(rng, chain, 3)
    passage = [word() for _ in range(80)]
    texts += [" ".join(passage + [word() for _ in range(40)]) for _ in range(60)]
    texts += ["one", "ONE", "two words", "Two\twords", "four words in all", "", None]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs, row = numbered(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    prints = simhash.fingerprints(docs, set_width=5, row_col=row).cache()
    known = simhash.links(prints.select("fp").distinct())
    found = minhash.similar_components(prints, docs, known, components, simhash.near, row, "text", 0.8, 5, crowd)
    roots = {r["node"]: r["root"] for r in found.collect()}
    mine = {r["id"]: roots.get(r["fp"], r["fp"]) for r in prints.collect()}
    pairs = {(g, mine[key]) for g, (key, _) in zip(plain_groups(rows), rows)}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    assert len(pairs) < len(set(plain_fingerprint(t) for t in texts)) - 50


def test_one_large_group_is_not_paired_off(spark, tmp_path, monkeypatch):
    """Copies of one text with one to six words changed, many of which are like none of the others: few pairs are looked at, no link is lost."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    texts = [" ".join(edited(rng, base, rng.randint(1, 6))) for _ in range(400)]
    # Groups within it: further changes to copies that are themselves far from the text.
    for _ in range(5):
        far = edited(rng, base, 8)
        texts += [" ".join(edited(rng, far, rng.randint(1, 2))) for _ in range(6)]
    rows = list(enumerate(texts))
    looked, verified = [], minhash.verified

    def counted(pairs, *args):
        looked.append(pairs.count())
        return verified(pairs, *args)

    monkeypatch.setattr(minhash, "verified", counted)
    assert stage(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), tmp_path) == kept(rows)
    assert len(set(plain_groups(rows))) > 50
    assert len(looked) == 2 and looked[1] < 4 * len(rows)
