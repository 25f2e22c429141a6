"""Alignment of two tokenizers' tokens over the same bytes: groups between common ends, links of tokens that overlap, and
how often each pair of ids is linked in the whole corpus.

Both vocabularies always part a text at a single space between other characters, so the chunks between such spaces can be
tokenised and aligned by themselves, and each distinct one only once as long as a task remembers it. Python numbers the chunks
and tokenises the new ones, laid end to end in pieces: each side's ends in bytes, and the ends again with the ids in the lower
half of one number. A long text is dealt out over several rows.

Spark's array functions make the groups of each piece. The ends that both sides have (array_intersect) close them: sorted in
among a side's tokens they part its ids. The next step of the same task puts both sides' parts together and lays the
groups of each document's chunks end to end, by their numbers; rows reach it in the order in which they were made. A group's
ids tell the bytes of its tokens and so their overlaps, so links are made once for each distinct group, from its ends in order: at
place k of that order the index of a token of one side is known, and so how many tokens of the other end before, k less that index.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_batches, steps, text_or_empty, utf8
from millrace.llm.packing import Encoder
from millrace.sources.shared import new_path, table

#: A text of more chunks than this is dealt out over several rows.
PART_CHUNKS = 1 << 13

#: Bytes of text whose tokens make one Arrow batch, and those of new chunks that are tokenised at once.
STEP, PIECE = 1 << 19, 1 << 12

#: Tokens of distinct chunks that a task remembers, but for those of one step; chunks whose groups are laid out at once.
REMEMBERED, LAID_CHUNKS = 1 << 20, 1 << 17

#: Groups whose sums are broadcast, some 30 MB; the rarer ones are joined by a shuffle.
COMMON_GROUPS = 1 << 18

#: Bytes of distinct groups that a file's dictionary takes.
DICTIONARY = 16 << 20

_seam = re.compile(r"(?<=\S) (?=\S)")

#: The blanks among the bytes of ASCII, and the bytes that other blanks begin with in UTF-8, two or three bytes long.
BLANK, LEADS = (np.isin(np.arange(256), found) for found in ([*range(9, 14), *range(28, 33)], [0xC2, 0xE1, 0xE2, 0xE3]))

#: The lower half of a sorted end: an id or an index, and a bit for side b; MARK comes after both.
SIDE, INDEX, MARK = 1 << 31, (1 << 31) - 1, (1 << 32) - 1
BETWEEN = f",{MARK},"


class Tokenizers:
    def __init__(self, ranks_path: str, pieces_path: str):
        import sentencepiece

        self.encoder = Encoder(ranks_path)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        if any("▁" in name.lstrip("▁") for name in names):
            raise ValueError("a piece goes on after a space, so texts can't be cut there")
        self.decoded = [bytes([int(n[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", n) else n.replace("▁", " ").encode() for n in names]
        full = self.encoder.full
        self.sizes = [np.array([len(x) for x in found], np.int64) for found in ([full.decode_single_token_bytes(i) for i in range(full.n_vocab)], self.decoded)]

    def ids(self, text: str) -> list[np.ndarray] | None:
        """Both sides' ids, or None if either's bytes are not a space and the text."""
        data = b" " + text.encode()
        b = self.pieces.encode(text)
        if b"".join(map(self.decoded.__getitem__, b)) != data:
            return None
        a = self.encoder.plain_ids(" " + text)  # each byte is a token of this vocabulary, so none is lost
        return [a.astype(np.int64), np.array(b, np.int64)] if self.sizes[0][a].sum() == len(data) else None


class Numbers(dict):
    """Keys' numbers in the order in which they are first asked for; those not yet taken are `new`."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self.new.append(key)
        self[key] = found = len(self)
        return found

    def take(self) -> list[str]:
        found, self.new = self.new, []
        return found


class Chunks:
    """Numbers of distinct chunks, and how many tokens they have on both sides; one that can't be had back from its tokens is not `whole`."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        self.epoch = 0
        self.forget()

    def forget(self) -> None:
        self.epoch += 1
        self.known = Numbers()
        self.whole = np.empty(0, bool)
        self.counts = [np.empty(0, np.int32)] * 2

    def numbers(self, texts: pa.Array) -> list[np.ndarray]:
        """Of each text. One whose spaces all stand singly is parted and its words made distinct by Arrow, before they are looked up."""
        parted = pc.split_pattern(texts, " ")
        words = parted.flatten().dictionary_encode()
        places, offsets = np.asarray(words.indices), np.asarray(parted.offsets) - parted.offsets[0].as_py()
        other = blank_ends(words.dictionary)
        odd = np.logical_or.reduceat(other[places], offsets[:-1])  # each text has a word, if an empty one
        number, numbers = self.known.__getitem__, np.zeros(len(other), np.int32)
        if not other.all():
            names = words.dictionary.filter(pa.array(~other))
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names), " ")[0].as_py()  # faster than one by one
            numbers[~other] = np.fromiter(map(number, joined.split(" ")), np.int32, len(names))
        found = np.split(numbers[places], offsets[1:-1])
        for i in np.flatnonzero(odd).tolist():
            chunks = chunks_of(texts[i].as_py())
            found[i] = np.fromiter(map(number, chunks), np.int32, len(chunks))
        return found

    def learn(self) -> Iterator[list[tuple[np.ndarray, ...]]]:
        """What `numbers` found for the first time, tokenised: pieces of chunks laid end to end, in the order of their numbers,
        in lists of about STEP bytes. Of a piece: where its chunks end, both sides' ids and both sides' ends. A chunk that is not whole has no length."""
        chunks = self.known.take()
        column = pa.array(chunks, pa.string())
        sizes = np.diff(utf8(column)[1]) + 1
        upto = np.append(0, np.cumsum(sizes))
        alone = np.flatnonzero(blank_ends(column)).tolist()  # a text's first or last chunk
        whole, counts = [], [[], []]
        found, first, given = [], 0, 0
        while first < len(chunks):
            last = max(first + 1, int(np.searchsorted(upto, upto[first] + PIECE)))
            at = bisect_left(alone, first)
            if at < len(alone):
                last = min(last, max(alone[at], first + 1))
            last = min(last, len(chunks))
            ids, good = self.tokenizers.ids(" ".join(chunks[first:last])), np.ones(last - first, bool)
            if ids is None:
                tries = [self.tokenizers.ids(c) for c in chunks[first:last]]
                good = np.array([t is not None for t in tries])
                ids = [np.concatenate([np.empty(0, np.int64), *(t[side] for t in tries if t is not None)]) for side in range(2)]
            ends = np.cumsum(sizes[first:last] * good)
            token_ends = [np.cumsum(self.tokenizers.sizes[side][ids[side]]) for side in range(2)]
            for side in range(2):
                counts[side].append(np.diff(np.searchsorted(token_ends[side], ends, "right"), prepend=0).astype(np.int32))
            whole.append(good)
            found.append((ends, *ids, *token_ends))
            if upto[last] - given >= STEP:
                yield found
                found, given = [], upto[last]
            first = last
        if found:
            yield found
        self.whole = np.concatenate([self.whole, *whole])
        self.counts = [np.concatenate([self.counts[side], *counts[side]]) for side in range(2)]


def chunks_of(text: str) -> list[str]:
    return _seam.split(text) if text else []


def blank_ends(words: pa.Array) -> np.ndarray:
    """Which words are empty, or have a blank at either end."""
    data, offsets = utf8(words)
    found = offsets[1:] == offsets[:-1]
    some = np.flatnonzero(~found)
    first, last = offsets[some], offsets[some + 1]
    found[some] = BLANK[data[first]] | BLANK[data[last - 1]]
    other = LEADS[data[first]] | LEADS[data[np.maximum(last - 2, 0)]] | LEADS[data[np.maximum(last - 3, 0)]]
    for i in some[other].tolist():
        word = words[i].as_py()
        found[i] = word[0].isspace() or word[-1].isspace()
    return found


def lists(rows: list[np.ndarray], kind: np.dtype) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]).astype(np.int32)), pa.array(np.concatenate([np.empty(0, kind), *rows]).astype(kind)))


def tokenised(docs: DataFrame, ranks_path: str, pieces_path: str, part_chunks: int = PART_CHUNKS, remembered: int = REMEMBERED) -> DataFrame:
    """docs (row, id, text) to rows of two sorts, in an order that counts. Those of new chunks have each side's ends
    (end << 32 | MARK) and ids (end << 32 | id), where the chunks end (upto) and a null row. After them those of parts of documents have (row, id, part, parts),
    counts of tokens and the numbers of their chunks, by their order since `epoch` last changed. A text without tokens has one part, of no chunks.
    """
    kind = docs.schema["id"].dataType.simpleString()
    arrays = "".join(f", {s}_ends array<long>, {s}_ids array<long>" for s in "ab")
    schema = f"epoch int, upto array<int>{arrays}, row long, id {kind}, part int, parts int, n_a int, n_b int, numbers binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = Tokenizers(ranks_path, pieces_path)
        chunks = Chunks(tokenizers)

        def batch_of(columns: dict, n: int, kind: pa.DataType) -> pa.RecordBatch:
            ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
            kinds = {"epoch": pa.int32(), "upto": ints, "a_ends": longs, "a_ids": longs, "b_ends": longs, "b_ids": longs, "row": pa.int64(), "id": kind}
            kinds |= {"part": pa.int32(), "parts": pa.int32(), "n_a": pa.int32(), "n_b": pa.int32(), "numbers": pa.binary()}
            columns = {"epoch": pa.array([chunks.epoch] * n, pa.int32())} | columns
            return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, t) for c, t in kinds.items()], names=list(kinds))

        def made(docs: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            kind = docs.column(1).type
            if chunks.counts[0].sum() > remembered:
                chunks.forget()
            numbers = chunks.numbers(docs.column(2))
            for pieces in chunks.learn():
                columns = {"upto": lists([p[0] for p in pieces], np.int32)}
                for side, name in enumerate("ab"):
                    ends = [p[side + 3] << 32 for p in pieces]
                    columns |= {f"{name}_ends": lists([e | MARK for e in ends], np.int64), f"{name}_ids": lists([e | p[side + 1] for e, p in zip(ends, pieces)], np.int64)}
                yield batch_of(columns, len(pieces), kind)
            rows = []
            for *doc, found in zip(docs.column(0).to_pylist(), docs.column(1).to_pylist(), numbers):
                if not chunks.whole[found].all():
                    found = found[:0]
                parts = max(1, -(-len(found) // part_chunks))
                for part in range(parts):
                    own = found[part * part_chunks : (part + 1) * part_chunks]
                    rows.append((*doc, part, parts, *(int(chunks.counts[side][own].sum()) for side in range(2)), own.tobytes()))
            names = ["row", "id", "part", "parts", "n_a", "n_b", "numbers"]
            kinds = [pa.int64(), kind, *[pa.int32()] * 4, pa.binary()]
            yield batch_of({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(zip(names, kinds))}, len(rows), kind)

        for batch in batches:
            for first, last, *_ in steps(batch.column(2), STEP):
                yield from made(batch.slice(first, last - first))

    return map_batches(docs.select("row", "id", "text"), run, schema)


def grouped(tokens: DataFrame) -> DataFrame:
    """tokens with `common`, the ends that both sides have, and each side's ids as text, `a` and `b`: commas between them, and
    where a group ends, BETWEEN."""
    found = tokens.withColumn("common", F.array_intersect("a_ends", "b_ends"))  # of nulls, null
    inner = F.slice("common", 1, F.greatest(F.size("common") - 1, F.lit(0)))

    def parted(side: str) -> Column:
        marked = F.sort_array(F.concat(f"{side}_ids", inner))
        return F.array_join(F.transform(marked, lambda x: x.bitwiseAND(F.lit(MARK)).cast("string")), ",")

    return found.select("*", parted("a").alias("a"), parted("b").alias("b")).drop("a_ends", "a_ids", "b_ends", "b_ids")


class Laid:
    """The groups of numbered chunks, to be laid end to end: each chunk's end is a common one, so a text's groups are its chunks'."""

    def __init__(self):
        self.forget(None)

    def forget(self, epoch: int | None) -> None:
        self.epoch = epoch
        self.values = pa.array([], pa.string())
        self.firsts = np.zeros(1, np.int64)

    def learn(self, pieces: pa.RecordBatch) -> None:
        if pieces.column("epoch")[0].as_py() != self.epoch:
            self.forget(pieces.column("epoch")[0].as_py())
        some = pc.greater(pc.list_value_length(pieces.column("common")), 0)
        values = pc.binary_join_element_wise(*(pc.split_pattern(pieces.column(side).filter(some), BETWEEN).flatten() for side in "ab"), "|")

        def in_order(column: pa.ListArray, shift: int) -> np.ndarray:
            """Ends of all pieces in one order: a piece's number, then the place."""
            return (np.repeat(np.arange(len(column)), np.diff(np.asarray(column.offsets))) << 32) + (np.asarray(column.flatten()) >> shift)

        ends = np.searchsorted(in_order(pieces.column("common"), 32), in_order(pieces.column("upto"), 0), "right")
        self.firsts = np.append(self.firsts, self.firsts[-1] + ends)
        self.values = pa.concat_arrays([self.values, values])

    def groups(self, numbers: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
        firsts = self.firsts[numbers]
        counts = self.firsts[numbers + 1] - firsts
        upto = np.append(0, np.cumsum(counts))
        places = np.arange(upto[-1]) + np.repeat(firsts - upto[:-1], counts)
        return pa.ListArray.from_arrays(pa.array(upto[offsets].astype(np.int32)), self.values.take(pa.array(places)))


def of_documents(found: DataFrame) -> DataFrame:
    """What `grouped` gives to (row, id, n_a, n_b, groups, groups_sha256), one row a part; the hash, of all parts, stands in the last one."""
    schema = f"row long, id {found.schema['id'].dataType.simpleString()}, n_a int, n_b int, groups array<string>, groups_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sha = Laid(), None

        def laid(docs: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal sha
            data, offsets = utf8(docs.column("numbers"))
            numbers, offsets, hashes = data.view(np.int32), offsets // 4, []
            groups = known.groups(numbers, offsets)
            texts, ends = utf8(pc.binary_join(groups, ";"))
            for part, parts, first, last in zip(docs.column("part").to_pylist(), docs.column("parts").to_pylist(), ends.tolist(), ends[1:].tolist()):
                if not part:
                    sha = hashlib.sha256()
                sha.update(b";" * (part > 0))
                sha.update(texts[first:last])
                hashes.append(None if part + 1 < parts else sha.hexdigest() if last > first else "")
            columns = [*map(docs.column, ("row", "id", "n_a", "n_b")), groups, pa.array(hashes, pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=["row", "id", "n_a", "n_b", "groups", "groups_sha256"])

        for batch in batches:
            is_doc = np.asarray(batch.column("row").is_valid())
            edges = [0, *(np.flatnonzero(np.diff(is_doc)) + 1).tolist(), len(is_doc)]
            for first, last in pairwise(edges):
                if not is_doc[first]:
                    known.learn(batch.slice(first, last - first))
                    continue
                sizes = np.append(0, np.cumsum(np.diff(utf8(batch.column("numbers").slice(first, last - first))[1]) // 4))
                at = 0
                while at < last - first:
                    after = max(at + 1, int(np.searchsorted(sizes, sizes[at] + LAID_CHUNKS, "right")) - 1)
                    yield laid(batch.slice(first + at, after - at))
                    at = after

    return map_batches(found, run, schema)


def links_of(groups: DataFrame, sizes: list[np.ndarray], width: int) -> DataFrame:
    """groups (group, n) to their links (group, n, pair), pair being a_id * width + b_id; sizes: of both sides' tokens by id."""
    a, b = (F.split(F.substring_index("group", "|", end), ",").cast("array<long>") for end in (1, -1))
    found = groups.select("group", "n", a.alias("a"), b.alias("b"))
    single = (F.size("a") == 1) & (F.size("b") == 1)
    plain = found.where(single).select("group", "n", (F.col("a")[0] * width + F.col("b")[0]).alias("pair"))

    def at(side: str) -> Column:
        size = F.split(F.lit(",".join(map(str, sizes[side == "b"]))), ",").cast("array<int>")  # constant, so made once
        ends = F.aggregate(side, F.array(F.lit(0).cast("long")), lambda ends, i: F.concat(ends, F.array(F.element_at(ends, -1) + size[i.cast("int")])))
        return F.transform(F.slice(ends, 2, F.size(side)), lambda e, i: F.shiftleft(e, 32).bitwiseOR(i.cast("long") + (SIDE if side == "b" else 0)))

    found = found.where(~single).select("*", F.sort_array(F.concat(at("a"), at("b"))).alias("ends"))
    found = found.select("*", F.posexplode_outer("ends").alias("k", "x"))  # never empty; without `outer` the planner adds a test that sorts again
    x, k = F.col("x"), F.col("k")
    index = x.bitwiseAND(F.lit(INDEX)).cast("int")
    of_a = x.bitwiseAND(F.lit(SIDE)) == 0
    # A common end, which is the group's, stands there twice: side a's gives the link.
    again = ~of_a & (k > 0) & (F.shiftright(F.col("ends")[F.greatest(k - 1, F.lit(0))], 32) == F.shiftright(x, 32))
    of = {s: F.col(s)[F.when(of_a == (s == "a"), index).otherwise(k - index)] for s in "ab"}
    return plain.unionByName(found.where(~again).select("group", "n", (of["a"] * width + of["b"]).alias("pair")))


def group_sums(groups: DataFrame, sizes: list[np.ndarray]) -> DataFrame:
    """groups (group, n) with n_best and count_sum, sums over the links of one group, by the counts of all groups' links."""
    width = len(sizes[1])
    links = table(links_of(groups, sizes, width))
    counts = table(links.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.col("pair") % width))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    judged = counts.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))
    # A frequent pair stands in many groups: written, so that Spark can split its rows.
    met = links.select("group", "n", "pair").join(table(judged), "pair")
    return table(met.groupBy("group").agg(F.first("n").alias("n"), F.sum("best").alias("n_best"), F.sum("count").alias("count_sum")))


def least_common(counts: DataFrame, limit: int) -> int:
    """The least power of two that no more than `limit` values of n reach."""
    by_bits = dict(map(tuple, counts.groupBy(F.length(F.bin("n")).alias("bits")).count().collect()))  # 63 rows at the most
    total = 0
    for bits in range(63, 0, -1):
        total += by_bits.get(bits, 0)
        if total > limit:
            return 1 << bits
    return 1


def sums_of(rows: DataFrame, known: DataFrame, limit: int) -> DataFrame:
    """(row, n_best, count_sum) of rows (row, group). The sums of the most frequent groups, `limit` at the most, are broadcast;
    another group meets its own in a shuffle. Such a group is in few places, so none is hot."""
    least = least_common(known, limit)
    sums = lambda df: df.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    marked = rows.join(F.broadcast(known.where(F.col("n") >= least).drop("n")), "group", "left")
    if least == 1:
        return sums(marked)
    rare = marked.where("n_best is null").select("row", "group").join(known.where(F.col("n") < least).hint("merge"), "group")
    return sums(marked.where("n_best is not null")).unionByName(sums(rare))


def align(docs: DataFrame, ranks_path: str, pieces_path: str, id_col: str = "doc_id", text_col: str = "text", part_chunks: int = PART_CHUNKS, common_groups: int = COMMON_GROUPS, remembered: int = REMEMBERED) -> DataFrame:
    """One row a document: the id column, n_a, n_b, n_groups, n_links, n_best, count_sum (long) and groups_sha256.

    A's tokens are those of the byte-level vocabulary over a space and the text, B's those of the sentencepiece model over
    the text. A text that is null, empty or does not come back from both as a space and itself has none: zeros, and an empty
    groups_sha256. Groups are written `a1,a2|b1;a3|b2` and hashed. A pair's count is over all documents, so repeated
    rows count again; n_best are the links whose pair is, or ties for, the most frequent of its B id, count_sum adds up
    the links' counts. Repeated and null ids are rows of their own, an empty table gives no rows, other columns are ignored.

    Memory is bounded but for a text itself with the list of its chunks, and for a chunk without single spaces, which is
    tokenised at once. A group of thousands of tokens costs as their number squared, once.
    """
    sizes = Tokenizers(ranks_path, pieces_path).sizes
    named = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    found = of_documents(grouped(tokenised(named, ranks_path, pieces_path, part_chunks, remembered)))
    path = new_path(docs.sparkSession, "groups")
    found.write.option("parquet.dictionary.page.size", DICTIONARY).parquet(path)
    parts = docs.sparkSession.read.schema(found.schema).parquet(path)
    single = parts.select("row", F.explode("groups").alias("group"))
    known = group_sums(table(single.groupBy("group").agg(F.count(F.lit(1)).alias("n"))), sizes)
    counts = [F.col(c).cast("long").alias(c) for c in ("n_a", "n_b")] + [F.size("groups").cast("long").alias("n_groups")]
    own = parts.select("row", "id", *counts, "groups_sha256")
    every = own.unionByName(sums_of(single, known, common_groups), allowMissingColumns=True)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    found = every.groupBy("row").agg(F.max("id").alias(id_col), *map(total, ("n_a", "n_b", "n_groups", "n_best", "count_sum")), F.max("groups_sha256").alias("groups_sha256"))
    # The distinct ends are those of both sides less the common ones, and one link ends at each.
    n_links = F.col("n_a") + F.col("n_b") - F.col("n_groups")
    return found.select(id_col, "n_a", "n_b", "n_groups", n_links.alias("n_links"), "n_best", "count_sum", "groups_sha256")
