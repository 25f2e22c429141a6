import hashlib
import re
import time
import zlib
from collections import Counter, defaultdict

import pytest

from millrace.llm import exact_dedup, sharding


def order(rows):
    return sorted(map(repr, rows))


@pytest.mark.parametrize("block_chars", [3, 8192])
def test_exact_groups(odd, texts, block_chars):
    if block_chars == 3:
        odd, texts = odd.where("length(text) < 300 or text is null"), [x for x in texts if len(x[1] or "") < 300]
    groups = defaultdict(list)
    for key, text in texts:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(key)
    wanted = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        for key in ids:
            wanted.append((key, min(known) if known else None, len(ids), hashlib.sha256(text.encode()).hexdigest()))
    got = exact_dedup.exact_groups(odd, block_chars=block_chars).collect()
    assert order((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == order(wanted)
    assert sum(r["kept"] for r in got) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_very_long_texts(spark, tmp_path):
    """Time grows in proportion to the length: for a text of 64 MB far less than 64 times that for one of 1 MB, and little more than for 64 of these."""
    part = "".join(f"w{i:07d} " for i in range(1 << 17))[:1024]
    took = {}
    for n, mb in ((1, 1), (64, 1), (1, 64)):
        made = spark.range(n).selectExpr("id as doc_id", f"repeat('{part}', {mb * 1024}) as text")
        made.repartition(1).write.parquet(f"{tmp_path}/{n}-{mb}")
        began = time.perf_counter()
        rows = exact_dedup.exact_groups(spark.read.parquet(f"{tmp_path}/{n}-{mb}")).collect()
        took[n, mb] = time.perf_counter() - began
        want = hashlib.sha256((part * (mb * 1024)).encode()).hexdigest()
        assert {(r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows} == {(0, n, want)}
    print("seconds by texts and MB", took)
    assert took[1, 64] < 16 * took[1, 1] and took[1, 64] < 3 * took[64, 1] + 10


def test_exact_empty(empty):
    assert exact_dedup.exact_groups(empty).count() == 0


def jump(key: int, n: int) -> int:
    """The published loop."""
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def check(rows, texts, shards=8):
    wanted = Counter((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), jump(k or 0, shards), jump(k or 0, shards + 1)) for k, t in texts)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in rows) == wanted
    slots = defaultdict(list)
    for r in rows:
        assert r["law"] == "key" and r["grown_shard"] in (r["shard"], shards)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards(odd, texts):
    check(sharding.shard(odd).collect(), texts)


def test_one_id_for_most_rows(spark):
    rows = [(5, f"t{i % 7}") for i in range(900)] + [(i, "u") for i in range(300)] + [(1 << 62, None), (-(1 << 62), "")]
    check(sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), ranges=16).collect(), rows)


@pytest.mark.parametrize("kind", ["string", "decimal(20,2)", "smallint"])
def test_ids_of_other_types(spark, kind):
    docs = spark.range(500).selectExpr(f"cast(if(id % 3 = 0, 7, id) as {kind}) as doc_id", "if(id % 3 = 0, 'same', cast(id as string)) as text").union(spark.range(2).selectExpr(f"cast(null as {kind})", "'none'"))
    rows = sharding.shard(docs, ranges=16).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == 502 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({(r["doc_id"], r["shard"], r["grown_shard"]) for r in rows}) == len({r["doc_id"] for r in rows}) and len(slots) == 8


def test_shards_empty(empty):
    assert sharding.shard(empty).count() == 0
