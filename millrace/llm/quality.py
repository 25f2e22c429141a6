"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

Tokens are runs of letters and digits or of punctuation. Features are hashes of single tokens, of pairs, and of pairs
and triples of token shapes (kind, case, length, whether the token repeats the one before), counted and divided by the
root of the document's number of tokens. Training is FTRL-Proximal, one document at a time, over a sample of
at most `max_train` labelled rows in one task; scoring is one sparse dot product a document, in numpy, and needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import BYTE_POWERS, BYTE_VALUES, LOWER, lean, map_batches, mixed, prefix_sums, smallest, span_hashes, steps, text_or_empty

BITS = 18
#: Bytes of one text that are taken at once.
WINDOW = 1 << 20
#: The longest n-grams are of three tokens, and a token's shape looks at the one before.
CARRIED = 3
#: Of each byte: 0 white space and controls, 1 letters and digits, 2 punctuation.
KINDS = np.zeros(256, np.uint8)
KINDS[33:127] = 2
KINDS[48:58] = KINDS[65:91] = KINDS[97:123] = KINDS[128:] = 1


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature number and row of each n-gram, and tokens in each row."""
    kind = KINDS[data]
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    edge = np.ones(n + 1, bool)
    edge[1:n] = kind[1:] != kind[:-1]
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    token = kind[starts] > 0
    starts, ends = starts[token], ends[token]
    row = np.searchsorted(offsets, starts, "right") - 1
    n_tokens = np.bincount(row, minlength=len(offsets) - 1)
    word = span_hashes(prefix_sums(BYTE_VALUES[LOWER[data]], BYTE_POWERS), starts, ends, BYTE_POWERS)
    capitals = np.append(0, np.cumsum((data >= 65) & (data <= 90)))
    upper = capitals[ends] - capitals[starts]
    size = np.minimum(ends - starts, 20)
    again = np.zeros(len(word), np.int64)
    again[1:] = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
    case = np.where(upper == 0, 0, np.where(upper == ends - starts, 2, 1))
    # A run of punctuation is its own shape.
    shape = np.where(kind[starts] == 2, word, (1000 + size * 8 + case * 2 + again).astype(np.uint64))
    # Also without the length.
    rough = np.where(kind[starts] == 2, word, (10 + case * 2 + again).astype(np.uint64))
    prime = np.uint64(0x9E3779B97F4A7C15)
    grams, rows = [mixed(word), mixed(shape ^ np.uint64(1 << 40))], [row, row]
    for values, salt in ((word, 2), (shape, 3), (rough, 4)):
        pair = row[1:] == row[:-1]
        grams.append(mixed(values[:-1] * prime + values[1:] + np.uint64(salt))[pair])
        rows.append(row[1:][pair])
    three = row[2:] == row[:-2]
    grams.append(mixed((rough[:-2] * prime + rough[1:-1]) * prime + rough[2:] + np.uint64(5))[three])
    rows.append(row[2:][three])
    return (np.concatenate(grams) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(rows), n_tokens


def windows(data: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, int]]:
    """Stretches of a text of some `limit` bytes that end with a token, and how many bytes of each repeat the last CARRIED tokens of
    the one before. Its n-grams are those of the stretches less those of what is repeated."""
    kind, first, carried = KINDS, 0, 0
    while first + carried < len(data):
        last = first + carried + limit
        step = limit
        while last < len(data) and kind[data[last]] == kind[data[last - 1]]:
            same = np.flatnonzero(kind[data[last : last + step]] != kind[data[last - 1]])[:1]
            last += int(same[0]) if len(same) else step
        part = data[first : min(last, len(data))]
        yield part, carried
        own = kind[part]
        starts = np.flatnonzero((own > 0) & (own != np.append(0, own[:-1])))
        keep = int(starts[-min(CARRIED, len(starts))]) if len(starts) else len(part)
        first, carried = first + keep, len(part) - keep


class Ftrl:
    """Per-coordinate FTRL-Proximal for the logistic loss (McMahan et al.)."""

    def __init__(self, alpha: float = 0.1, beta: float = 1.0, l1: float = 0.05, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)  # the last is the intercept

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def sparse_rows(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct features and their values of each row, the intercept last."""
    for low, high, data, offsets in steps(column):
        at, row, n_tokens = ngrams(data, offsets)
        key, count = np.unique(row << BITS | at, return_counts=True)
        parts = np.searchsorted(key >> BITS, np.arange(high - low + 1))
        for i in range(high - low):
            part = slice(parts[i], parts[i + 1])
            x = count[part] / np.sqrt(max(1, n_tokens[i]))
            yield np.append(key[part] & ((1 << BITS) - 1), 1 << BITS), np.append(x, 1.0)


def train(labelled: DataFrame, max_train: int = 8000, epochs: int = 3, text_col: str = "text", label_col: str = "label", order_col: str = "order") -> np.ndarray:
    """Weights from at most max_train rows, those of the smallest `order_col`; zeros if there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = Ftrl(), []
        for batch in batches:
            y = batch.column(1).to_pylist()
            seen += [(at.astype(np.int32), x.astype(np.float32), y[i]) for i, (at, x) in enumerate(sparse_rows(batch.column(0)))]
        for _ in range(epochs):
            for at, x, y in seen:
                model.update(at, x, y)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights().astype(np.float32).tobytes()], pa.binary())], names=["weights"])

    sample = labelled.select(text_or_empty(text_col).alias("text"), F.col(label_col).cast("int").alias("y"), F.col(order_col).alias("o")).orderBy("o", "text").limit(max_train)
    found = sample.coalesce(1).select("text", "y").mapInArrow(lean(run), "weights binary").first()
    return np.frombuffer(found["weights"], np.float32) if found else np.zeros((1 << BITS) + 1, np.float32)


def sums(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the sum of its n-grams' weights, and the number of tokens; one long text is taken window by window."""
    if len(offsets) > 2 or len(data) <= 2 * WINDOW:
        at, row, n_tokens = ngrams(data, offsets)
        return np.bincount(row, weights[at], len(offsets) - 1), n_tokens
    total = np.zeros((2, 1))
    for part, carried in windows(data, WINDOW):
        for sign, piece in ((1, part), (-1, part[:carried])):
            at, row, n_tokens = ngrams(piece, np.array([0, len(piece)]))
            total += sign * np.array([np.bincount(row, weights[at], 1), n_tokens])
    return total[0], total[1]


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column and the probability `score` of label 1, for each row."""
    handle = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = handle.value
        for batch in batches:
            logits = np.zeros(batch.num_rows)
            for low, high, data, offsets in steps(batch.column(1)):
                total, n_tokens = sums(data, offsets, weights)
                logits[low:high] = total / np.sqrt(np.maximum(n_tokens, 1))
            p = 1 / (1 + np.exp(-np.clip(logits + weights[-1], -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], names=[id_col, "score"])

    return map_batches(docs.select(F.col(id_col), text_or_empty(text_col).alias("text")), run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double")


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; of a null id 0."""
    return F.coalesce(F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % folds, F.lit(0).cast("long"))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 3, held: int = 1, max_train: int = 8000) -> DataFrame:
    """One row per row of docs: the id column, held_out, score (0 to 1, higher: label 1 likelier), predicted.

    Learns from rows with a label whose fold is not `held`, at most max_train of them in order of a hash of the
    id. Rows of labels with a null id or label are passed over; of several for an id the largest label counts. Null
    and empty texts get the score of no features. Null ids are not held out; repeated ids are rows of their own. Without
    labels every score is 0.5. An empty table gives no rows. Other columns are ignored.
    """
    labels = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).where(fold(F.col(id_col), folds) != held)
    order = F.xxhash64(id_col)
    labels = labels.groupBy(id_col).agg(F.max(label_col).alias("label")).withColumn("order", order)
    chosen = smallest(labels, max_train, "order", labels)
    # At most max_train ids and labels, so small by contract.
    labelled = docs.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(chosen), id_col)
    weights = train(labelled, max_train)
    held_out = fold(F.col(id_col), folds) == held
    return score(docs, weights, id_col, text_col).select(id_col, held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
