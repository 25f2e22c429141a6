from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import packing
from millrace.llm.queries import byte_bpe_ranks, op1_packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check(pieces, texts, tokenizer, capacity=2048):
    """Every id in exactly one piece, the ids right, sequences gapless and full or a power of two."""
    wanted = Counter((k, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids) + (1,)) for k, t in texts)
    got, by_doc, by_seq = Counter(), defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p["length"] > 0 and len(p["ids"]) == 4 * p["length"]
        by_seq[p["sequence_id"]].append((p["offset"], p["length"], p["seq_tokens"]))
        by_doc[p["doc_id"], p["doc_tokens"]].append((p["start"], tuple(np.frombuffer(p["ids"], "<u4").tolist())))
    for seq in by_seq.values():
        at = 0
        for offset, length, total in sorted(seq):
            assert offset == at
            at += length
            assert total == sum(x[1] for x in seq) <= capacity
        assert at == capacity or at & (at - 1) == 0
    assert sum(len(ids) for parts in by_doc.values() for _, ids in parts) == sum(len(ids) * n for (_, ids), n in wanted.items())
    once = Counter(k for k, _ in texts)
    for (key, tokens), parts in by_doc.items():
        if once[key] == 1:
            ids = sum((ids for _, ids in sorted(parts)), ())
            assert len(ids) == tokens and [s for s, _ in sorted(parts)] == [int(x) for x in np.cumsum([0] + [len(i) for _, i in sorted(parts)])[:-1]]
            got[key, ids] += 1
    assert got == Counter({k: n for k, n in wanted.items() if once[k[0]] == 1})


def test_odd_documents(odd, texts, tokenizer):
    check(packing.pack(odd, byte_bpe_ranks(), group_tokens=4096).collect(), texts, tokenizer)


def test_end_of_text_is_one_id(spark, encoder, tokenizer):
    assert encoder.ids("hello <|endoftext|> world").tolist() == [31373, 220, 50256, 995]
    texts = [(1, "<|endoftext|>"), (2, "a<|endoftext|>b  <|endoftext|>\n\n<|endoftext|> x"), (3, "<|endoftext|")]
    check(packing.pack(spark.createDataFrame(texts, "doc_id long, text string"), byte_bpe_ranks()).collect(), texts, tokenizer)


def test_query(spark, small, tokenizer):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    check(packing.pack(spark.read.parquet(f"{small}/documents.parquet"), byte_bpe_ranks()).collect(), docs, tokenizer)
    names = op1_packing(spark, small).columns
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(names)


def test_empty(empty):
    assert packing.pack(empty, byte_bpe_ranks()).count() == 0


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(byte_bpe_ranks())


def test_ids_are_the_tokenizers(encoder, tokenizer):
    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.one_of(st.sampled_from([*" \n\t\r  　\x85\x1c\x1f'sStTlLvVeE1.é", "<|endoftext|>", "<|endoftext"]), st.characters(exclude_categories=["Cs", "Cn"])), max_size=40).map("".join))
    def run(text):
        assert encoder.ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids

    run()


def test_long_texts_are_cut_where_the_pattern_parts(encoder, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "LONG", 50)
    text = "Don't  stop now,\n\n it's 12345 long words and\tmore " * 20
    assert encoder.ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_costs_are_balanced():
    packer = packing.Packer(100, 1 << 30, 1.0, 1 / 50)
    rng = np.random.default_rng(1)
    for i, n in enumerate(rng.integers(1, 60, 400)):
        packer.add(i, int(n))
    cost = defaultdict(float)
    for _, _, length, seq, _ in packer.flush():
        cost[seq] += packer.cost(length)
    values = list(cost.values())
    assert max(values) < 1.6 * np.mean(values)


