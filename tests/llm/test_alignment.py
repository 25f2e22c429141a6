import collections
import hashlib
import random
import sys

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import alignment, queries

RANKS, PIECES = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")
NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def plain_tokens():
    """Both tokenizers as their own libraries have them: (id, bytes) of each token."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printed]
    to_byte = {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(rest)}
    b = sentencepiece.SentencePieceProcessor(model_file=PIECES)

    def piece(i):
        name = b.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if b.is_byte(i) else name.replace("▁", " ").encode()

    def tokens(text):
        if not text:
            return [], []
        data = b" " + text.encode()
        mine = [(i, bytes(to_byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        other = [(i, piece(i)) for i in b.encode(text)]
        return (mine, other) if b"".join(x for _, x in mine) == data == b"".join(x for _, x in other) else ([], [])

    return tokens


def placed(tokens):
    at, out = 0, []
    for i, data in tokens:
        out.append((i, at, at + len(data)))
        at += len(data)
    return out


def plain_rows(texts, tokens):
    found, counts = [], collections.Counter()
    for key, text in texts:
        a, b = (placed(t) for t in tokens(text))
        common = sorted({x[2] for x in a} & {x[2] for x in b})
        links, first = [], 0
        for i, s, e in a:
            while first < len(b) and b[first][2] <= s:
                first += 1
            j = first
            while j < len(b) and b[j][1] < e:
                links.append((i, b[j][0]))
                j += 1
        groups, before = [], 0
        ends = {x: [] for x in common}
        for side in (a, b):
            k = 0
            for c in common:
                ids = []
                while k < len(side) and side[k][2] <= c:
                    ids.append(str(side[k][0]))
                    k += 1
                ends[c].append(",".join(ids))
        groups = ";".join("|".join(ends[c]) for c in common)
        counts.update(links)
        found.append((key, len(a), len(b), len(common), links, groups))
    most = collections.Counter()
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    return [
        (key, n_a, n_b, n, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(groups.encode()).hexdigest() if groups else "")
        for key, n_a, n_b, n, links, groups in found
    ]


def same(got, wanted):
    assert sorted(repr(tuple(r[c] for c in NAMES)) for r in got) == sorted(map(repr, wanted))


ODD = ["", None, " ", "  a  b ", "<s>x</s><unk>", "<|endoftext|> x", "a▁b", "a\x00b", "\n\n a", "你好 é\U0001f600", "é ", "a\tb\r\n", "<0x0A>", "�", "a  b", "ｆｕｌｌ width", "=" * 500, "ab" * 2000, " " * 300 + "x", "don't can't  won't", "\x1c x \x1c", "x \u0085 y", "1234567 89 000", "ﬁ ① Å", "x​y z﻿"]


@pytest.mark.parametrize(("part", "common"), [(1 << 13, 1 << 18), (5, 10), (1, 0)])
def test_odd_texts(spark, plain_tokens, part, common):
    """Parts of a text give what the whole one does, and so do groups that are joined in place of broadcast."""
    texts = list(enumerate(ODD)) + [(100, "the cat  sat on the mat. " * 30), (100, "the cat sat"), (None, "the cat sat"), (101, None)]
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in texts], "doc_id long, text string, row int, pair string").repartition(3)
    same(alignment.align(docs, RANKS, PIECES, part_chunks=part, common_groups=common).collect(), plain_rows(texts, plain_tokens))


def test_odd_documents(spark, odd, texts, plain_tokens):
    same(alignment.align(odd, RANKS, PIECES).collect(), plain_rows(texts, plain_tokens))


def test_query_on_the_tables(spark, small, plain_tokens):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op12_alignment(spark, small).collect()
    same(got, plain_rows([(r["doc_id"], r["text"]) for r in docs], plain_tokens))
    assert sum(r["n_links"] for r in got) > 100_000


def test_empty(empty):
    assert alignment.align(empty, RANKS, PIECES).columns == NAMES and alignment.align(empty, RANKS, PIECES).count() == 0


def test_repeated_chunks_are_aligned_once(spark):
    """However often a chunk stands in a task's texts, the array functions get its tokens once."""
    docs = spark.createDataFrame([(i, i, "the cat sat on the mat " * 50 + f"number{i}") for i in range(20)], "row long, id long, text string").coalesce(1)
    assert alignment.tokenised(docs, RANKS, PIECES).select(F.sum(F.size("a_ends"))).first()[0] < 100


def test_a_word_is_looked_up_once_a_step():
    """Words of the same texts are made distinct by Arrow, and the numbers are those of the chunks of each text."""
    seen = []

    class Counted(alignment.Numbers):
        def __getitem__(self, key):
            seen.append(key)
            return super().__getitem__(key)

    rng = random.Random(3)
    parts = ["the", "cat", "é", "你好", " ", " ", " ", " ", "  ", "\n", "\x1c", "\x85", "\xa0", "\u3000", "\u2003"]
    texts = ["the cat sat on the mat"] * 500 + [t or "" for t in ODD] + ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(300)]
    chunks = alignment.Chunks(None)
    chunks.known = Counted()
    found = chunks.numbers(pa.array([*["x"] * 3, *texts]).slice(3))
    assert len(seen) < 2500
    names = list(chunks.known)
    assert [[names[i] for i in numbers] for numbers in found] == [alignment._seam.split(t) if t else [] for t in texts]


def test_blank_ends():
    """As Python and its regular expressions have blanks, of any length in UTF-8."""
    words = [c for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000 and ((c := chr(i)).isspace() or i < 0x3100 or i % 97 == 0)]
    words = ["", *words, *(w + c for c in words if c.isspace() for w in ("a", "é", "好"))]
    assert alignment.blank_ends(pa.array(words)).tolist() == [not w or w[0].isspace() or w[-1].isspace() for w in words]
    assert alignment.blank_ends(pa.array([], pa.string())).tolist() == []


def test_groups_stay_text_until_they_are_laid(spark):
    """Spark makes one string a piece and side, not one a group."""
    docs = spark.createDataFrame([(1, 1, "unbelievable 你好 cat")], "row long, id long, text string")
    found = alignment.grouped(alignment.tokenised(docs, RANKS, PIECES))
    assert dict(found.dtypes)["a"] == dict(found.dtypes)["b"] == "string" and "groups" not in found.columns
    piece = found.where("row is null").first()
    sides = [piece[side].split(alignment.BETWEEN) for side in "ab"]
    assert [len(side) for side in sides] == [len(piece["common"])] * 2 and found.where("row is not null and a is not null").count() == 0


@pytest.mark.parametrize("remembered", [0, 20, 1 << 20])
def test_forgotten_chunks(spark, plain_tokens, remembered):
    """Numbers that begin anew in each batch, or after some, tell the same groups."""
    texts = [(i, f"the cat{i % 7} sat  on {'a mat ' * (i % 5)}") for i in range(40)] + list(enumerate(ODD, 40))
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "3")
    try:
        same(alignment.align(docs, RANKS, PIECES, part_chunks=4, remembered=remembered).collect(), plain_rows(texts, plain_tokens))
    finally:
        spark.conf.set(name, before)


def test_least_common(spark):
    counts = spark.createDataFrame([(1,), (1,), (2,), (3,), (9,)], "n long")
    assert [alignment.least_common(counts, n) for n in (0, 1, 2, 3, 4, 5)] == [16, 4, 4, 2, 2, 1]
    assert alignment.least_common(counts.where(F.lit(False)), 3) == 1
