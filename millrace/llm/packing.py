"""Cost-balanced packing of token sequences.

The cost of a document piece of n tokens is estimated as linear * n + quadratic * n * n, the two parts of a
transformer's work. Documents are tokenised and cut into full sequences and a rest. The rests of a group are assigned,
longest first, to the sequence of the lowest cost so far among those with room; what fits nowhere is cut and fills the
gaps, again the cheapest sequence first. A group has just as many sequences as its tokens fill; what does not fill the last
one goes over into the next group, and at the end of a task is laid out in sequences of powers of two, which need no padding.

Each task packs its own documents, group by group, so there is no shuffle and a lost task is simply run again.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_batches, text_or_empty

#: Of a text longer than this, pieces are tokenised one by one; they end where the pattern always parts words.
LONG = 1 << 20

# The vocabulary's pattern. The short one differs only in runs of white space, which the long one parts before the last.
PATTERN_SHORT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Fixed value: the vocabulary's one added token; its id comes after the merge ranks.
END_OF_TEXT = "<|endoftext|>"


class Encoder:
    """The ids that the vocabulary's JSON file gives in the `tokenizers` library, by the merge ranks in `tiktoken`.

    That takes a fifth of the time. As in that library, END_OF_TEXT within a text is the added token, not its letters:
    a text is parted there first.
    """

    def __init__(self, ranks_path: str):
        import regex
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
        self.full, self.short = (tiktoken.Encoding(name, pat_str=p, mergeable_ranks=ranks, special_tokens={}) for name, p in (("full", PATTERN), ("short", PATTERN_SHORT)))
        self.end_of_text = np.array([len(ranks)], "<u4")
        self.run = regex.compile(r"\s\s").search
        self.seam = regex.compile(r"(?<=\S) (?=\S)")

    def ids(self, text: str) -> np.ndarray:
        first, *more = (self.plain_ids(part) for part in text.split(END_OF_TEXT))
        return np.concatenate([first, *(x for part in more for x in (self.end_of_text, part))]) if more else first

    def plain_ids(self, text: str) -> np.ndarray:
        encode = (self.full if self.run(text) else self.short).encode_ordinary
        if len(text) <= LONG:
            return np.array(encode(text), "<u4")
        parts, first = [], 0
        while first < len(text):
            seam = self.seam.search(text, first + LONG)
            last = seam.start() if seam else len(text)
            parts.append(np.array(encode(text[first:last]), "<u4"))
            first = last
        return np.concatenate(parts)


class Packer:
    """Takes documents one by one and gives pieces (document, start, length, sequence, offset)."""

    def __init__(self, capacity: int, group_tokens: int, linear: float, quadratic: float):
        self.capacity, self.group_tokens, self.linear, self.quadratic = capacity, group_tokens, linear, quadratic
        self.waiting: list[tuple[int, int, int]] = []
        self.tokens = self.sequences = 0

    def cost(self, n: int) -> float:
        return self.linear * n + self.quadratic * n * n

    def add(self, document: int, length: int) -> list[tuple]:
        """Full sequences of the document at once; its rest waits."""
        full = length // self.capacity
        out = [(document, i * self.capacity, self.capacity, self.sequences + i, 0) for i in range(full)]
        self.sequences += full
        if rest := length - full * self.capacity:
            self.waiting.append((document, full * self.capacity, rest))
            self.tokens += rest
        return out

    def full(self) -> bool:
        return self.tokens >= self.group_tokens

    def flush(self, end: bool = False) -> list[tuple]:
        """Packs what waits into full sequences; at the end also what is left, in powers of two."""
        n = self.tokens // self.capacity
        out, left = self._assign([self.capacity] * n)
        self.waiting, self.tokens = left, sum(x[2] for x in left)
        if end and self.tokens:
            more, left = self._assign([1 << b for b in reversed(range(self.capacity.bit_length())) if self.tokens >> b & 1])
            out += more
            self.waiting, self.tokens = [], 0
        return out

    def _assign(self, sizes: list[int]) -> tuple[list[tuple], list[tuple]]:
        if not sizes:
            return [], self.waiting
        room, cost, used = np.array(sizes), np.zeros(len(sizes)), np.zeros(len(sizes), np.int64)
        out, first = [], self.sequences
        self.sequences += len(sizes)

        def put(document: int, start: int, length: int, at: int) -> None:
            out.append((document, start, length, first + at, int(used[at])))
            used[at] += length
            room[at] -= length
            cost[at] += self.cost(length)

        cuttable = []
        for document, start, length in sorted(self.waiting, key=lambda x: (-x[2], x[0])):
            at = int(np.argmin(np.where(room >= length, cost, np.inf)))
            if room[at] >= length:
                put(document, start, length, at)
            else:
                cuttable.append((document, start, length))
        left = []
        for document, start, length in cuttable:
            while length and room.any():
                at = int(np.argmin(np.where(room > 0, cost, np.inf)))
                part = min(length, int(room[at]))
                put(document, start, part, at)
                start, length = start + part, length - part
            if length:
                left.append((document, start, length))
        return out, left


def pack(
    docs: DataFrame,
    ranks_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    end_id: int = 1,
    group_tokens: int = 1 << 20,
    linear: float = 1.0,
    quadratic: float = 1 / 4096,
) -> DataFrame:
    """One row per piece: the id column, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset, seq_tokens.

    The ids are those of Encoder: END_OF_TEXT in a text is one id. Every document ends with end_id, so a null or empty text is that id alone. Repeated and null ids are documents of
    their own. An empty table gives no rows. Other columns are ignored. Sequences are full but for at most a few a
    task, whose lengths are distinct powers of two: nothing is padded. sequence_id holds the task in its upper bits.
    """
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, seq_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = Encoder(ranks_path), Packer(capacity, group_tokens, linear, quadratic)
        held: dict[int, tuple] = {}
        base, number, kind = TaskContext.get().partitionId() << 33, 0, None

        def rows(pieces: list[tuple]) -> pa.RecordBatch:
            filled: dict[int, int] = {}
            for p in pieces:
                filled[p[3]] = filled.get(p[3], 0) + p[2]
            found = [(*held[p[0]], *p) for p in pieces]
            columns = [
                pa.array([x[0] for x in found], kind),
                pa.array([x[3] for x in found], pa.int64()),
                pa.array([x[4] for x in found], pa.int64()),
                pa.array([x[1][x[3] : x[3] + x[4]].tobytes() for x in found], pa.binary()),
                pa.array([len(x[1]) for x in found], pa.int64()),
                pa.array([base + x[5] for x in found], pa.int64()),
                pa.array([x[6] for x in found], pa.int64()),
                pa.array([filled[x[5]] for x in found], pa.int64()),
            ]
            waiting = {w[0] for w in packer.waiting}
            for document in [d for d in held if d not in waiting]:
                del held[document]
            return pa.RecordBatch.from_arrays(columns, names=[id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "seq_tokens"])

        pieces, tokens = [], 0
        for batch in batches:
            kind = batch.column(0).type
            for key, text in zip(batch.column(0), batch.column(1)):
                ids = np.append(encoder.ids(text.as_py()), np.uint32(end_id)).astype("<u4")
                held[number] = key.as_py(), ids
                pieces += packer.add(number, len(ids))
                number, tokens = number + 1, tokens + len(ids)
                if packer.full() or tokens >= 2 * group_tokens:
                    pieces += packer.flush()
                    if pieces:
                        yield rows(pieces)
                    pieces, tokens = [], packer.tokens
        if kind is not None and (pieces := pieces + packer.flush(end=True)):
            yield rows(pieces)

    return map_batches(docs.select(F.col(id_col), text_or_empty(text_col).alias("text")), run, schema)
