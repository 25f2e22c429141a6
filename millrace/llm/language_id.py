"""Language of the words of code-switched text by a linear-chain conditional random field.

A word's features are its affixes (the first 1 to 3 and the last 1 to 4 bytes), its n-grams of bytes with the word's
ends, and the word itself if it is in the lexicon, the frequent words of the training texts. Transitions between words are
learned as well. A document is one chain, however long: forward-backward, in numpy over many runs of `SPAN` words at once,
gives each word's probabilities, and the messages that pass from run to run are carried by each run's product of
matrices, so the runs leave no seam. A document's language is the one with the largest mean over its words.

The training sequences, of at most `SPAN` words, are half taken as they are and half spliced from two texts, so that
switches occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import BYTE_POWERS, BYTE_VALUES, LOWER, lean, map_batches, mixed, prefix_sums, smallest, span_hashes, spans_of, steps
from millrace.llm.quality import fold

BITS = 17
SPAN = 64
LEXICON = 20000
LETTER = np.zeros(256, bool)
LETTER[97:123] = LETTER[128:] = True


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (features, languages)
    transitions: np.ndarray  # from, to
    lexicon: np.ndarray  # sorted hashes of words


@dataclass
class Words:
    row: np.ndarray
    hashes: np.ndarray
    affixes: np.ndarray  # (words, 7) features
    grams: np.ndarray  # features at letters
    first: np.ndarray  # of each word among grams


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    low = LOWER[data]
    # Capitals of two bytes after C3 (Latin letters with marks).
    low[1:][(low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)] += 0x20
    letter = LETTER[low]
    starts, ends, row = spans_of(letter, offsets)
    sums = prefix_sums(BYTE_VALUES[low], BYTE_POWERS)
    columns = [span_hashes(sums, starts, np.minimum(starts + k, ends), BYTE_POWERS) ^ np.uint64(k) for k in (1, 2, 3)]
    columns += [span_hashes(sums, np.maximum(ends - k, starts), ends, BYTE_POWERS) ^ np.uint64(8 + k) for k in (1, 2, 3, 4)]
    affixes = np.stack([(mixed(c) >> np.uint64(64 - BITS)).astype(np.int32) for c in columns], 1)
    at = np.flatnonzero(letter)
    inner = np.concatenate([[0], low, [0]]).astype(np.uint32)
    before, after = inner[at], inner[at + 2]
    first = np.cumsum(ends - starts) - (ends - starts)
    if len(starts):
        before[first] = 0
        after[first + (ends - starts) - 1] = 0
    before[~LETTER[before]], after[~LETTER[after]] = 0, 0
    code = (before << np.uint32(16) | inner[at + 1] << np.uint32(8) | after).astype(np.uint64)
    return Words(row, span_hashes(sums, starts, ends, BYTE_POWERS), affixes, (mixed(code + np.uint64(1 << 30)) >> np.uint64(64 - BITS)).astype(np.int32), first)


def lexicon_features(hashes: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    """The row of weights after the hashed ones; that of no entry is the last."""
    if not len(lexicon):
        return np.full(len(hashes), 1 << BITS)
    at = np.minimum(np.searchsorted(lexicon, hashes), len(lexicon) - 1)
    return (1 << BITS) + np.where(lexicon[at] == hashes, at, len(lexicon))


def emissions(words: Words, model: Model) -> np.ndarray:
    """(words, languages): the sum of each word's feature weights."""
    if not len(words.first):
        return np.zeros((0, len(model.languages)), np.float32)
    w = model.weights
    out = np.add.reduceat(w[words.grams], words.first, axis=0)
    for column in words.affixes.T:
        out += w[column]
    return out + w[lexicon_features(words.hashes, model.lexicon)]


def sequences(row: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """Each word's sequence and place in it: runs of at most span words of a row."""
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.empty(0, np.int64)
    size = np.diff(np.append(first, len(row)))
    within = np.arange(len(row)) - np.repeat(first, size)
    place = within % span
    return np.cumsum(place == 0) - 1, place


def forward_backward(scores: np.ndarray, present: np.ndarray, transitions: np.ndarray, pairs: bool = False, before: np.ndarray | None = None, after: np.ndarray | None = None):
    """Probabilities (sequences, places, languages) of words laid out in rows, absent places at the end.

    before: what the words before a sequence say of its first word (by language; all ones at a text's start); after: what
    those after it say of its last one. With pairs also the expected number of each transition.
    """
    n, t, k = scores.shape
    e = np.exp(scores - scores.max(2, keepdims=True))
    step = np.exp(transitions - transitions.max())
    ahead, back = np.empty_like(e), np.empty_like(e)
    a = e[:, 0] if before is None else before * e[:, 0]
    a = a / a.sum(1, keepdims=True)
    ahead[:, 0] = a
    for i in range(1, t):
        a = (a @ step) * e[:, i]
        a /= a.sum(1, keepdims=True)
        ahead[:, i] = a
    b = np.ones((n, k), e.dtype) if after is None else after
    expected = np.zeros((k, k))
    for i in range(t - 1, -1, -1):
        back[:, i] = b
        if i:
            if pairs:
                on = present[:, i]
                joint = ahead[on, i - 1, :, None] * step * (e[on, i] * back[on, i])[:, None, :]
                expected += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            c = (b * e[:, i]) @ step.T
            b = np.where(present[:, i, None], c / c.sum(1, keepdims=True), b)
    p = ahead * back
    p /= p.sum(2, keepdims=True)
    return (p, expected) if pairs else p


def messages(scores: np.ndarray, present: np.ndarray, head: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`before` and `after` of each sequence, where those of a text follow each other and `head` marks a text's first."""
    n, t, k = scores.shape
    before, after = np.ones((n, k), scores.dtype), np.ones((n, k), scores.dtype)
    later = np.flatnonzero(~head)
    if not len(later):
        return before, after
    e = np.exp(scores - scores.max(2, keepdims=True))
    step = np.exp(transitions - transitions.max()).astype(scores.dtype)
    # Of each sequence but a text's first, what leads from the word before it to its last word; of a first one, from its first word.
    through = np.where(head[:, None, None], np.eye(k, dtype=scores.dtype), step) * e[:, 0, None, :]
    for i in range(1, t):
        on = np.flatnonzero(present[:, i])
        m = (through[on].reshape(-1, k) @ step).reshape(-1, k, k) * e[on, i, None, :]
        through[on] = m / m.max((1, 2), keepdims=True)
    first = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.arange(n) - first
    by_rank = np.argsort(rank, kind="stable")
    edges = np.searchsorted(rank[by_rank], np.arange(rank.max() + 2))
    ranked = [by_rank[a:b] for a, b in zip(edges[:-1], edges[1:])]
    last = np.ones((n, k), scores.dtype)  # what a sequence's words, and those before, say of its last one
    for r, at in enumerate(ranked):
        m = (np.ones((len(at), 1, k), scores.dtype) if r == 0 else last[at - 1][:, None, :]) @ through[at]
        last[at] = m[:, 0] / m.sum((1, 2))[:, None]
        if r:
            m = last[at - 1] @ step
            before[at] = m / m.sum(1, keepdims=True)
    for at in ranked[:0:-1]:
        m = (through[at] @ after[at][:, :, None])[:, :, 0]
        after[at - 1] = m / m.sum(1, keepdims=True)
    return before, after


def word_probabilities(words: Words, model: Model) -> np.ndarray:
    e = emissions(words, model).astype(np.float32)
    if not len(e):
        return e
    sequence, place = sequences(words.row)
    scores = np.zeros((sequence[-1] + 1, place.max() + 1, e.shape[1]), np.float32)
    present = np.zeros(scores.shape[:2], bool)
    scores[sequence, place] = e
    present[sequence, place] = True
    row = words.row[place == 0]
    transitions = model.transitions.astype(np.float32)
    before, after = messages(scores, present, np.append(True, row[1:] != row[:-1]), transitions)
    return forward_backward(scores, present, transitions, False, before, after)[sequence, place]


def ascent(e: np.ndarray, lengths: np.ndarray, truth: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gradient of the conditional log-likelihood, by the words' scores e (of sequences laid end to end) and by transitions."""
    k = e.shape[1]
    s = np.repeat(np.arange(len(lengths)), lengths)
    p = np.arange(len(e)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    scores = np.zeros((len(lengths), lengths.max(), k))
    present = np.zeros(scores.shape[:2], bool)
    scores[s, p], present[s, p] = e, True
    prob, expected = forward_backward(scores, present, transitions, True)
    g = -prob[s, p]
    g[np.arange(len(e)), truth] += 1
    seen = np.zeros((k, k))
    inner = p[1:] > 0
    np.add.at(seen, (truth[:-1][inner], truth[1:][inner]), 1)
    return g, seen - expected


def fit(words: Words, truth: np.ndarray, languages: list[str], epochs: int = 3, batch: int = 256, rate: float = 0.2, seed: int = 7) -> Model:
    """Ascends the conditional log-likelihood by AdaGrad over batches of sequences."""
    k = len(languages)
    found, count = np.unique(words.hashes, return_counts=True)
    often = np.argsort(-count, kind="stable")[:LEXICON]
    lexicon = np.sort(found[often[count[often] >= 3]])
    size = (1 << BITS) + len(lexicon) + 1
    model = Model(languages, np.zeros((size, k)), np.zeros((k, k)), lexicon)
    lex = lexicon_features(words.hashes, lexicon)
    counts = np.diff(np.append(words.first, len(words.grams)))
    sequence, place = sequences(words.row)
    if not len(sequence):
        return model
    ends = np.append(np.flatnonzero(place == 0), len(place))
    runs = [np.arange(a, b) for a, b in zip(ends[:-1], ends[1:])]
    rng = np.random.default_rng(seed)
    spliced = []
    for i in rng.permutation(len(runs))[: len(runs) // 2]:
        a, b = runs[i], runs[rng.integers(len(runs))]
        spliced.append(np.concatenate([a[: rng.integers(len(a)) + 1], b[rng.integers(len(b)) :]]))
    runs += spliced
    squares, squares_t = np.full((size, k), 1e-2), np.full((k, k), 1e-2)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(runs)), max(1, len(runs) // batch)):
            chosen = [runs[i] for i in part]
            at = np.concatenate(chosen)
            lengths = np.array([len(c) for c in chosen])
            n = counts[at]
            gram_at = np.repeat(words.first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            grams, owner = words.grams[gram_at], np.repeat(np.arange(len(at)), n)
            w = model.weights
            e = np.add.reduceat(w[grams], np.cumsum(n) - n, axis=0) + w[words.affixes[at]].sum(1) + w[lex[at]]
            g, g_t = ascent(e, lengths, truth[at], model.transitions)
            features = np.concatenate([grams, words.affixes[at].ravel(), lex[at]])
            owners = np.concatenate([owner, np.repeat(np.arange(len(at)), 7), np.arange(len(at))])
            touched, inverse = np.unique(features, return_inverse=True)
            grad = np.stack([np.bincount(inverse, g[owners, j], len(touched)) for j in range(k)], 1) / len(chosen)
            squares[touched] += grad**2
            model.weights[touched] += rate * grad / np.sqrt(squares[touched])
            grad = g_t / len(chosen)
            squares_t += grad**2
            model.transitions += rate * grad / np.sqrt(squares_t)
    # No language's words count double for its share in the sample: only the features and the switches speak.
    model.weights = model.weights.astype(np.float32)
    return model


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held: int = 2, max_train: int = 1500) -> Model:
    """From the whole texts of at most max_train rows with a language whose fold is not `held`, in order of a hash."""
    known = docs.where(F.col(lang_col).isNotNull()).where(fold(F.col(id_col), folds) != held)
    rows = known.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(id_col).alias("o"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        texts, langs = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            langs += batch.column(1).to_pylist()
        languages = sorted(set(langs))
        parts, truth, base = [], [], 0
        for low, high, data, offsets in steps(pa.array(texts, pa.string())):
            w = words_of(data, offsets)
            truth.append(np.array([languages.index(x) for x in langs[low:high]], np.int64)[w.row])
            w.row = w.row + low
            w.first = w.first + base
            base += len(w.grams)
            parts.append(w)
        if parts:
            words = Words(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("row", "hashes", "affixes", "grams", "first")))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(words, np.concatenate(truth), languages))], pa.binary())], names=["model"])

    found = smallest(rows, max_train, "o", known).coalesce(1).select("text", "lang").mapInArrow(lean(run), "model binary").first()
    if not found:
        return Model([], np.zeros(((1 << BITS) + 1, 0), np.float32), np.zeros((0, 0)), np.empty(0, np.uint64))
    import pickle

    return pickle.loads(found["model"])


@dataclass
class Found:
    lang: np.ndarray
    score: np.ndarray
    n_words: np.ndarray
    runs: list


def predict(texts: pa.Array, model: Model, runs: bool = False) -> Found:
    """The language, its score, the number of words and (if asked for) the runs of words, for each text; a text is one chain."""
    k, rows = len(model.languages), len(texts)
    out = Found(np.full(rows, "und", object), np.zeros(rows), np.zeros(rows, np.int64), [[]] * rows)
    for low, high, data, offsets in steps(texts) if k else ():
        words = words_of(data, offsets)
        n = np.bincount(words.row, minlength=high - low)
        p = word_probabilities(words, model)
        mean = np.stack([np.bincount(words.row, p[:, j], high - low) for j in range(k)], 1) / np.maximum(n, 1)[:, None]
        top = mean.argmax(1)
        out.n_words[low:high] = n
        # Characters beyond ASCII may be no letters; only texts without ASCII letters need a closer look.
        good = n > 0
        ascii_letters = np.append(0, np.cumsum((LOWER[data] >= 97) & (LOWER[data] <= 122)))
        for i in np.flatnonzero(good & (ascii_letters[offsets[1:]] == ascii_letters[offsets[:-1]])):
            good[i] = any(c.isalpha() for c in texts[low + int(i)].as_py())
        good = np.flatnonzero(good)
        out.lang[low + good] = np.array(model.languages, object)[top[good]]
        out.score[low + good] = np.clip(mean[good, top[good]], 0, 1)
        if runs and len(p):
            label = p.argmax(1)
            cuts = np.flatnonzero(np.append(True, (label[1:] != label[:-1]) | (words.row[1:] != words.row[:-1])))
            before = np.cumsum(n) - n
            for a, b in zip(cuts, np.append(cuts[1:], len(label))):
                r = words.row[a]
                out.runs[low + r] = [*out.runs[low + r], {"lang": model.languages[label[a]], "first": int(a - before[r]), "last": int(b - before[r])}]
    return out


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", runs: bool = False) -> DataFrame:
    """One row per row of docs: the id column, lang_pred, score, n_words; with runs also `runs`, the words labelled.

    lang_pred is `und`, with score 0, if the text is null or has no letter, or nothing was learned. Equal means go to
    the first language by name. score is the mean probability of lang_pred over the words. runs: (lang, first word, last
    word + 1), maximal. Null and repeated ids are rows of their own. Other columns are ignored.
    """
    handle = docs.sparkSession.sparkContext.broadcast(model)
    more = ", runs array<struct<lang:string,first:long,last:long>>" if runs else ""
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double, n_words long{more}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = predict(batch.column(1), handle.value, runs)
            columns = [batch.column(0), pa.array(found.lang, pa.string()), pa.array(found.score), pa.array(found.n_words)]
            if runs:
                columns.append(pa.array(found.runs, pa.list_(pa.struct({"lang": pa.string(), "first": pa.int64(), "last": pa.int64()}))))
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "lang_pred", "score", "n_words", *["runs"] * runs])

    return map_batches(docs.select(F.col(id_col), F.col(text_col).alias("text")), run, schema)


def known_languages(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.3) -> DataFrame:
    """docs, all columns, without the rows whose language is `und` or scores below `least`."""
    handle, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = predict(batch.column(at), handle.value)
            yield batch.filter(pa.array((found.lang != "und") & (found.score >= least)))

    return map_batches(docs, run, docs.schema)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held: int = 2, max_train: int = 1500) -> DataFrame:
    """Trains on docs' own languages, outside the held-out fold, and adds held_out to identify()'s rows."""
    model = train(docs, id_col, text_col, lang_col, folds, held, max_train)
    return identify(docs, model, id_col, text_col).withColumn("held_out", fold(F.col(id_col), folds) == held)
