"""Runs: stretches of words that repeat with a period, and a text without its repeated turns.

A run of period q and at least `times` * q words, `least` at the least, agrees with itself shifted by q over length - q
words. The smallest that this overlap can be is k, and each word of a run lies in some k words that stand in the document
twice. So words outside a document's repeated k-grams can't be in a run, nor join two parts of one: they are masked,
and the segments between them are searched one by one.

A segment is searched by Main and Lorentz: it is halved again and again, and a run is found where it crosses the middle of
the smallest part that holds it, by how far the words at the middle agree with those a period away, forwards and
backwards. All parts of a size are done in one numpy step. Agreement is measured by hashes of stretches and a binary search;
what is found is compared word by word, so a collision can't change the result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import WORD_POWERS, map_batches, mixed, prefix_sums, span_hashes, text_or_empty

#: Bytes of text that are cut into words at once, and words that are joined at once.
CHUNK = 1 << 20

#: Pairs of a middle and a period that are compared at once.
PAIRS = 1 << 18

_BLANK = re.compile(rb"[\x20\x09-\x0D]")

Run = tuple[int, int, int]
Cycle = Callable[[object, int], tuple[int, int] | None]


def overlap(least: int, times: int) -> int:
    """The smallest length - period of a run."""
    turn = least // times  # up to this period a run may have `least` words
    return min(least - turn, (times - 1) * (turn + 1)) if turn else times - 1


def word_ids(data: bytes) -> tuple[np.ndarray, list[bytes]]:
    """The words' numbers, and the distinct words by number; the text is cut chunk by chunk."""
    known: dict[bytes, int] = {}
    parts, first = [np.empty(0, np.int32)], 0
    while first < len(data):
        blank = _BLANK.search(data, first + CHUNK)
        last = blank.start() if blank else len(data)
        words = data[first:last].split()  # by the six ASCII blanks
        parts.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words)))
        first = last
    return np.concatenate(parts), list(known)


def joined(ids: np.ndarray, words: list[bytes]) -> bytes:
    return b" ".join(b" ".join([words[i] for i in ids[at : at + CHUNK].tolist()]) for at in range(0, len(ids), CHUNK))


def sums_of(ids: np.ndarray) -> np.ndarray:
    return prefix_sums(mixed(ids.astype(np.uint64) + np.uint64(1)), WORD_POWERS)


def segments(ids: np.ndarray, k: int, least: int) -> list[tuple[int, int]]:
    """Maximal stretches, of at least `least` words, of words in k-grams that stand in ids twice or more."""
    n = len(ids)
    if n < least or n <= k:
        return []
    at = np.arange(n - k + 1)
    grams = span_hashes(sums_of(ids), at, at + k, WORD_POWERS)
    order = np.sort(grams)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return []
    # The places of repeated grams; a gram covers the k words from its place on.
    places = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, grams), len(twice) - 1)] == grams)
    gap = np.flatnonzero(np.diff(places) > k)
    firsts, lasts = places[np.append(0, gap + 1)], places[np.append(gap, len(places) - 1)] + k
    return [(int(a), int(b)) for a, b in zip(firsts, lasts) if b - a >= least]


class Agreement:
    """How far the words from a and from b on agree."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.sums = ids, sums_of(ids)

    def same(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        return span_hashes(self.sums, a, a + n, WORD_POWERS) == span_hashes(self.sums, b, b + n, WORD_POWERS)

    def forwards(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """a < b: the words from both places on."""
        return self._longest(len(self.ids) - b, lambda n: self.same(a, b, n))

    def backwards(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The words before both places."""
        return self._longest(a, lambda n: self.same(a - n, b - n, n))

    @staticmethod
    def _longest(most: np.ndarray, same: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            ok = same(middle)
            low, high = np.where(ok, middle, low), np.where(ok, high, middle - 1)
        return low

    def exactly(self, a: int, q: int) -> tuple[int, int]:
        """The stretch around a and a + q of words that are the same q apart, by comparing words."""
        unlike = self.ids[:-q] != self.ids[q:]
        before, after = np.flatnonzero(unlike[:a]), np.flatnonzero(unlike[a:])
        return int(before[-1]) + 1 if len(before) else 0, (a + int(after[0]) if len(after) else len(unlike)) + q


def pairs(ids: np.ndarray, size: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places a and periods q, such that a run that crosses the middle of a part of `size` has its words a and a + q on one side of the middle, or next to it, and the same."""
    n = len(ids)
    middles = np.arange(size // 2, n, size)
    wide = max(1, PAIRS // len(middles))
    for low in range(1, most + 1, wide):
        q = np.arange(low, min(low + wide, most + 1))
        m, q = np.repeat(middles, len(q)), np.tile(q, len(middles))
        right = np.flatnonzero(m + q < n)
        right = right[ids[m[right]] == ids[m[right] + q[right]]]
        yield m[right], q[right]
        left = np.flatnonzero(m - q >= 1)
        left = left[ids[m[left] - 1] == ids[m[left] - q[left] - 1]]
        yield -m[left], q[left]


def runs_of(ids: np.ndarray, least: int = 24, times: int = 3) -> list[Run]:
    """All runs (start, length, smallest period) of a segment, by start and period."""
    n, agree = len(ids), Agreement(ids)
    found: list[np.ndarray] = []
    # least words strictly cross a multiple of this power of two
    size = 2 << ((least - 1).bit_length() - 1)
    while size < 2 * n:
        for m, q in pairs(ids, size, min(size, n) // times):
            forwards = m > 0
            a = np.where(forwards, m, -m - q)
            # Half of the run, so (times - 2) / 2 periods at least beyond the first, is on one side of the middle.
            half = ((times - 2) * q + 1) // 2
            inside = np.where(forwards, a + q + half <= n, a - half >= 0)
            a, q, half, forwards = a[inside], q[inside], half[inside], forwards[inside]
            at = np.where(forwards, a, a - half)
            same = agree.same(at, at + q, half)
            a, q = a[same], q[same]
            starts = a - agree.backwards(a, a + q)
            ends = a + q + agree.forwards(a, a + q)
            long = ends - starts >= np.maximum(least, times * q)
            if long.any():
                found.append(np.stack([starts[long], ends[long], q[long], a[long]], 1))
        size *= 2
    if not found:
        return []
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    out: dict[tuple[int, int], int] = {}
    for group in np.split(rows, np.flatnonzero((np.diff(rows[:, :2], axis=0) != 0).any(1)) + 1):
        s, e, q, _ = map(int, group[0])
        if (ids[s : e - q] == ids[s + q : e]).all():
            stretches = [(s, e, q)]  # of the periods of one stretch the smallest: it divides the others
        else:  # a collision of hashes
            stretches = [(*agree.exactly(int(a), int(q)), int(q)) for _, _, q, a in group]
        for s, e, q in stretches:
            if e - s >= max(least, times * q):
                out[s, e] = min(q, out.get((s, e), q))
    return sorted((s, e - s, q) for (s, e), q in out.items())


def document_runs(ids: np.ndarray, least: int = 24, times: int = 3) -> list[Run]:
    """All runs of a document, by start and period."""
    found = []
    for first, last in segments(ids, overlap(least, times), least):
        found += [(first + s, length, q) for s, length, q in runs_of(ids[first:last], least, times)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Which words stay: not those that some run holds after its first turn."""
    steps = np.zeros(n + 1, np.int32)
    for start, length, q in runs:
        steps[start + q] += 1
        steps[start + length] -= 1
    return np.cumsum(steps[:n]) == 0


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 24, times: int = 3, cycle: Cycle | None = None) -> DataFrame:
    """One row a document: the id column, n_words, runs (start, length and period in words; by start, then period), and
    collapsed, the text's words joined by one space without those that a run holds after its first turn.

    Words are what blanks (space, tab to carriage return) part. A run has its smallest period q, max(least, times * q)
    words or more, and no neighbouring word extends it; times is 3 or more. Where `cycle`, of an id and a number of words,
    gives (a, p), each word i from a on is taken to be word a + (i - a) % p.

    A null or empty text has no words, no runs and collapses to the empty text. Repeated and null ids are rows of their
    own, an empty table gives no rows, and other columns are ignored. Memory grows with the longest text, by some
    10 times its bytes (a word takes 4 bytes, and its hashes 8 each).
    """
    if times < 3 or least < 4:
        raise ValueError("a run has to have 3 periods and 4 words at least")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, offsets, rows, texts = [], [0], [], []
            for key, text in zip(batch.column(0), batch.column(1)):
                ids, words = word_ids(text.as_py().encode())
                n = len(ids)
                if cycle and (turn := cycle(key.as_py(), n)):
                    ids = np.concatenate([ids[: turn[0]], ids[turn[0] + np.arange(n - turn[0]) % turn[1]]])
                runs = document_runs(ids, least, times)
                numbers.append(n)
                rows += runs
                offsets.append(len(rows))
                texts.append(joined(ids[kept_words(n, runs)] if runs else ids, words))
            fields = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
            spans = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(numbers, pa.int64()), spans, pa.array(texts, pa.binary()).cast(pa.string())], [id_col, "n_words", "runs", "collapsed"])

    return map_batches(docs.select(F.col(id_col), text_or_empty(text_col).alias("text")), run, schema)
