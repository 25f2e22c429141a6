import re

import pytest

from millrace.llm import common, decontaminate

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(GAP, low) if w]


def brute(texts, items):
    windows = {}
    for item, text in items:
        w = words(text)
        if item is not None:
            for i in range(max(1, len(w) - 12) if w else 0):
                windows.setdefault(tuple(w[i : i + 13]), set()).add(item)
    sizes, out = {len(w) for w in windows}, []
    for key, text in texts:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if here := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= here
        out.append((key, len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(map(repr, out))


def result(found):
    return sorted(repr((r["doc_id"], r["n_words"], r["n_hit"], sorted(r["items"]), r["contaminated"])) for r in found.collect())


def test_items(spark, odd, texts):
    pool = [words(t) for _, t in texts if t and len(words(t)) > 20]
    items = [(i, " ".join(w[3:18])) for i, w in enumerate(pool[:8])] + [(20, "of"), (21, ""), (22, None), (None, "the of"), (23, "the of, THE"), (24, " ".join(pool[0] + ["zzz"])), (25, " ".join(pool[0] + ["zzz"])), (20, "of"), (26, "absent words here")]
    benchmark = spark.createDataFrame([(*i, "x", 2) for i in items], "item_id long, text string, row string, n int")
    wanted = brute(texts, items)
    assert result(decontaminate.contamination(odd, benchmark)) == wanted


def test_a_crowded_bitmap_misses_nothing(spark, odd, texts, monkeypatch):
    """With 64 bits every shingle is a probe."""
    monkeypatch.setattr(common, "LEAST_BITS", 6)
    monkeypatch.setattr(common, "MOST_BITS", 6)
    items = [(i, " ".join(words(t)[5:30])) for i, (_, t) in enumerate(texts[:12])] + [(50, "of une"), (51, "une")]
    assert result(decontaminate.contamination(odd, spark.createDataFrame(items, "item_id long, text string"))) == brute(texts, items)


def test_a_large_benchmark(spark, tmp_path):
    """8 MB of items in over a million windows: nothing of it passes through the driver."""
    text = "array_join(transform(sequence(1, 130), i -> concat('w', pmod(xxhash64(id, i), 9000))), ' ')"
    spark.range(10_000).selectExpr("id as item_id", f"{text} as text").write.parquet(f"{tmp_path}/items")
    items = spark.read.parquet(f"{tmp_path}/items")
    docs = items.where("item_id < 50").selectExpr("item_id as doc_id", "concat('x y z ', text, ' x y z') as text").union(spark.range(1000, 1050).selectExpr("id as doc_id", f"{text} || ' z' as text"))
    docs = docs.union(spark.range(20_000, 20_050).selectExpr("id as doc_id", f"{text} as text"))
    rows = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.contamination(docs, items).collect()}
    assert rows == {i: (136, 130, [i]) for i in range(50)} | {i: (131, 130, [i]) for i in range(1000, 1050)} | {i: (130, 0, []) for i in range(20_000, 20_050)}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, " ")]])
def test_without_items(spark, odd, texts, rows):
    benchmark = spark.createDataFrame(rows, "item_id long, text string")
    assert result(decontaminate.contamination(odd, benchmark)) == brute(texts, rows)


def test_empty(spark, empty):
    assert decontaminate.contamination(empty, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def test_string_ids(spark):
    docs = spark.createDataFrame([("a", "one two three"), (None, "two")], "doc_id string, text string")
    items = spark.createDataFrame([("i", "two"), ("j", "four")], "item_id string, text string")
    small = items.selectExpr("cast(ascii(item_id) as smallint) as item_id", "text")
    assert [r["items"] for r in decontaminate.contamination(docs, small).where("doc_id = 'a'").collect()] == [[105]]
    assert sorted(map(repr, ((r["doc_id"], r["items"]) for r in decontaminate.contamination(docs, items).collect()))) == ["('a', ['i'])", "(None, ['i'])"]


