"""Language ID and quality: held-out accuracy, exact forward-backward, odd documents."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import language_id, quality
from millrace.llm.common import BYTE_VALUES, utf8
from millrace.llm.queries import op4_quality, op7_language_id


def test_forward_backward_is_exact():
    rng = np.random.default_rng(3)
    scores, transitions = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3))
    total, marginal = 0.0, np.zeros((4, 3))
    for path in itertools.product(range(3), repeat=4):
        w = np.exp(sum(scores[0, i, k] for i, k in enumerate(path)) + sum(transitions[a, b] for a, b in zip(path, path[1:])))
        total += w
        for i, k in enumerate(path):
            marginal[i, k] += w
    got = language_id.forward_backward(scores, np.ones((1, 4), bool), transitions)
    assert np.allclose(got[0], marginal / total)


@pytest.mark.parametrize("sizes", [[1], [3, 1, 200, 64, 65, 128, 2], [5000, 7]])
def test_a_text_is_one_chain(sizes):
    """Runs of 5 words that pass messages give what each text gives as a whole."""
    rng = np.random.default_rng(sum(sizes))
    transitions = rng.normal(size=(3, 3)) * 2
    e, row = rng.normal(size=(sum(sizes), 3)) * 3, np.repeat(np.arange(len(sizes)), sizes)
    sequence, place = language_id.sequences(row, 5)
    scores, present = np.zeros((sequence[-1] + 1, 5, 3)), np.zeros((sequence[-1] + 1, 5), bool)
    scores[sequence, place], present[sequence, place] = e, True
    own = row[place == 0]
    messages = language_id.messages(scores, present, np.append(True, own[1:] != own[:-1]), transitions)
    got = language_id.forward_backward(scores, present, transitions, False, *messages)[sequence, place]
    for r in range(len(sizes)):
        whole = language_id.forward_backward(e[None, row == r], np.ones((1, sizes[r]), bool), transitions)[0]
        assert np.allclose(got[row == r], whole, atol=1e-9)


def log_likelihood(e, lengths, truth, transitions):
    """By enumeration of every path."""
    out, base = 0.0, 0
    for n in lengths:
        weight = lambda path: sum(e[base + i, k] for i, k in enumerate(path)) + sum(transitions[a, b] for a, b in zip(path, path[1:]))  # noqa: B023, E731
        out += weight(truth[base : base + n]) - np.log(sum(np.exp(weight(p)) for p in itertools.product(range(e.shape[1]), repeat=n)))
        base += n
    return out


def test_gradient():
    """Against differences of the log-likelihood."""
    rng = np.random.default_rng(8)
    lengths = np.array([3, 1, 4])
    e, transitions, truth = rng.normal(size=(8, 3)), rng.normal(size=(3, 3)), rng.integers(0, 3, 8)
    by_e, by_t = language_id.ascent(e, lengths, truth, transitions)
    for values, gradient in ((e, by_e), (transitions, by_t)):
        for at in np.ndindex(*values.shape):
            values[at] += 1e-5
            up = log_likelihood(e, lengths, truth, transitions)
            values[at] -= 2e-5
            down = log_likelihood(e, lengths, truth, transitions)
            values[at] += 1e-5
            assert abs((up - down) / 2e-5 - gradient[at]) < 1e-6


def test_predictions_by_enumeration():
    """Short texts, word by word and path by path."""
    rng = np.random.default_rng(9)
    k = 3
    known = language_id.words_of(*utf8(pa.array(["maison haus"])))
    model = language_id.Model(["a", "b", "c"], rng.normal(size=((1 << language_id.BITS) + 3, k)).astype(np.float32), rng.normal(size=(k, k)), np.sort(known.hashes))
    texts = ["Maison, une HAUS x1", "Ärger", "the the 12 the", "", "naïve É"]
    found = language_id.predict(pa.array(texts), model)
    for text, lang, score, n in zip(texts, found.lang, found.score, found.n_words):
        words = [w for w in re.split(r"[^A-Za-z\x80-\U0010ffff]+", text) if w]
        assert n == len(words)
        if not words:
            assert (lang, score) == ("und", 0)
            continue
        e = np.concatenate([language_id.emissions(language_id.words_of(*utf8(pa.array([w]))), model) for w in words]).astype(float)
        total, mass = 0.0, np.zeros((len(words), k))
        for path in itertools.product(range(k), repeat=len(words)):
            w = np.exp(sum(e[i, c] for i, c in enumerate(path)) + sum(model.transitions[a, b] for a, b in zip(path, path[1:])))
            total += w
            for i, c in enumerate(path):
                mass[i, c] += w
        mean = (mass / total).mean(0)
        assert lang == "abc"[mean.argmax()] and abs(score - mean.max()) < 1e-5


def test_language_of_held_out_documents(spark, middle):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{middle}/documents.parquet").collect()}
    rows = op7_language_id(spark, middle).collect()
    assert len(rows) == len(truth) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r["lang_pred"] == truth[r["doc_id"]] for r in rows if r["held_out"]]
    assert np.mean(held) > 0.97


def test_words_of_spliced_texts(spark, middle):
    docs = spark.read.parquet(f"{middle}/documents.parquet")
    model = language_id.train(docs)
    by = {lang: next(r["text"] for r in docs.where(f"lang = '{lang}' and length(text) between 600 and 2000").orderBy("doc_id").collect()) for lang in ("en", "fr")}
    mixed = spark.createDataFrame([(1, by["en"] + "\n" + by["fr"])], "doc_id long, text string")
    row = language_id.identify(mixed, model, runs=True).first()
    share = {lang: sum(x["last"] - x["first"] for x in row["runs"] if x["lang"] == lang) / row["n_words"] for lang in ("en", "fr")}
    assert min(share.values()) > 0.2 and sum(share.values()) > 0.9
    assert [x["first"] for x in row["runs"]] == [0] + [x["last"] for x in row["runs"]][:-1] and row["runs"][-1]["last"] == row["n_words"]


def test_language_of_odd_documents(odd, texts):
    rows = language_id.language_id(odd).collect()
    assert sorted(map(repr, (r["doc_id"] for r in rows))) == sorted(repr(k) for k, _ in texts)
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "fr", "de", "und")
    by = {r["doc_id"]: r["lang_pred"] for r in rows}
    assert all(by[k] == "und" for k in (100, 101, 102, 103)) and by[104] != "und"


def test_nothing_to_learn_from(spark, empty, odd):
    assert language_id.language_id(empty).count() == 0
    unknown = odd.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r["lang_pred"] for r in language_id.language_id(unknown).collect()} == {"und"}
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.quality(odd, labels).collect()} == {0.5}
    assert quality.quality(empty, labels).count() == 0


def test_known_languages_keep_all_columns(odd):
    model = language_id.train(odd)
    kept = language_id.known_languages(odd, model)
    assert kept.columns == odd.columns and 100 not in {r["doc_id"] for r in kept.collect()}


def area(y, s):
    order = np.argsort(s)
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def plain_ngrams(text: str) -> dict[int, float]:
    """Feature numbers and values of a text, token by token in plain integers."""
    full, base = (1 << 64) - 1, 0x9E3779B97F4A7C15 | 1

    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & full
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & full
        return x ^ (x >> 31)

    tokens = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[!-/:-@\[-`{-~]+", text.encode())
    word = [mix((sum(int(BYTE_VALUES[c]) * pow(base, i, 1 << 64) for i, c in enumerate(t.lower())) + len(t) * 0xD6E8FEB86659FD93) & full) for t in tokens]
    shape, rough = [], []
    for i, t in enumerate(tokens):
        upper = sum(65 <= c <= 90 for c in t)
        case = 0 if not upper else 2 if upper == len(t) else 1
        again = int(i > 0 and word[i] == word[i - 1])
        mark = not re.match(rb"[0-9A-Za-z\x80-\xff]", t)
        shape.append(word[i] if mark else 1000 + min(len(t), 20) * 8 + case * 2 + again)
        rough.append(word[i] if mark else 10 + case * 2 + again)
    grams = [mix(w) for w in word] + [mix(x ^ 1 << 40) for x in shape]
    for values, salt in ((word, 2), (shape, 3), (rough, 4)):
        grams += [mix((a * 0x9E3779B97F4A7C15 + b + salt) & full) for a, b in zip(values, values[1:])]
    grams += [mix((((a * 0x9E3779B97F4A7C15 + b) * 0x9E3779B97F4A7C15) + c + 5) & full) for a, b, c in zip(rough, rough[1:], rough[2:])]
    return {f: n / max(1, len(tokens)) ** 0.5 for f, n in Counter(g >> (64 - quality.BITS) for g in grams).items()}


def plain_ftrl(rows, epochs, alpha=0.1, beta=1.0, l1=0.05, l2=1.0):
    """The published updates, coordinate by coordinate."""
    z, n = Counter(), Counter()
    weight = lambda f: 0.0 if abs(z[f]) <= l1 else ((1 if z[f] > 0 else -1) * l1 - z[f]) / ((beta + n[f] ** 0.5) / alpha + l2)
    for _ in range(epochs):
        for x, y in rows:
            w = {f: weight(f) for f in x}
            p = 1 / (1 + math.exp(-sum(w[f] * v for f, v in x.items())))
            for f, v in x.items():
                g = (p - y) * v
                z[f] += g - ((n[f] + g * g) ** 0.5 - n[f] ** 0.5) / alpha * w[f]
                n[f] += g * g
    return {f: weight(f) for f in z}


def test_quality_by_plain_updates(spark):
    """The operator's scores against plain n-grams, updates and dot products, the query's split of rows included."""
    rng = np.random.default_rng(6)
    vocabulary = ["the", "The", "HOUSE", "house", "of", "!!", "...", "naïve", "12", "x,y", "of", "of"]
    texts = {i: " ".join(rng.choice(vocabulary, rng.integers(0, 25))) for i in range(60)} | {60: None, 61: ""}
    labels = {i: int(rng.integers(0, 2)) for i in range(0, 60, 2)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    marks = spark.createDataFrame([(i, y, 0) for i, y in labels.items()], "doc_id long, quality int, toxic int")
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in texts}
    order = {r["doc_id"]: r["o"] for r in docs.selectExpr("doc_id", "xxhash64(doc_id) as o").collect()}
    features = {i: plain_ngrams(t or "") | {1 << quality.BITS: 1.0} for i, t in texts.items()}
    weights = plain_ftrl([(features[i], labels[i]) for i in sorted(labels, key=order.get) if not held[i]], epochs=3)
    rows = quality.quality(docs, marks).collect()
    assert len(rows) == 62
    for r in rows:
        p = 1 / (1 + math.exp(-sum(weights.get(f, 0.0) * v for f, v in features[r["doc_id"]].items())))
        assert abs(r["score"] - p) < 1e-5 and r["held_out"] == held[r["doc_id"]] and r["predicted"] == (r["score"] >= 0.5)
    assert len({round(r["score"], 6) for r in rows}) > 40


def test_quality_of_held_out_documents(spark, middle):
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{middle}/labels.parquet").collect()}
    rows = op4_quality(spark, middle).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [(truth[r["doc_id"]], r["score"]) for r in rows if r["held_out"] and truth.get(r["doc_id"]) is not None]
    y, s = map(np.array, zip(*held))
    print("area", area(y, s), "accuracy", np.mean((s >= 0.5) == y), "share of 1", y.mean(), len(y))
    assert area(y, s) > 0.85


def test_quality_of_odd_documents(spark, odd, texts):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (3, None, None), (5, 1, 0), (5, 0, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.quality(odd, labels).collect()
    assert sorted(map(repr, (r["doc_id"] for r in rows))) == sorted(repr(k) for k, _ in texts)
    assert len({r["score"] for r in rows if r["doc_id"] in (100, 101, 102)}) == 1


@pytest.mark.parametrize("text", [b"", b"Hello, hello WORLD 12", "é ü".encode()])
def test_ngrams_stay_within_rows(text):
    data = np.frombuffer(text + text, np.uint8)
    one = quality.ngrams(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    two = quality.ngrams(data, np.array([0, len(text), 2 * len(text)]))
    assert two[2].tolist() == one[2].tolist() * 2
    assert sorted(two[0][two[1] == 1].tolist()) == sorted(one[0].tolist())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "Bc", "é", "!", "..", " ", "\n", "same", "same ", "x" * 40, "?!" * 20]), max_size=60), st.integers(1, 50))
def test_quality_of_windows(parts, limit):
    """A text's n-grams are those of its windows less those of what windows repeat."""
    data = np.frombuffer("".join(parts).encode(), np.uint8)
    weights = np.random.default_rng(1).standard_normal((1 << quality.BITS) + 1)
    at, row, n_tokens = quality.ngrams(data, np.array([0, len(data)]))
    total, n = 0.0, 0
    for part, carried in quality.windows(data, limit):
        for sign, piece in ((1, part), (-1, part[:carried])):
            a, _, k = quality.ngrams(piece, np.array([0, len(piece)]))
            total += sign * weights[a].sum()
            n += sign * int(k[0])
    assert n == int(n_tokens.sum()) and abs(total - weights[at].sum()) < 1e-6


def test_quality_of_a_long_text(monkeypatch):
    data = np.frombuffer(("The cat, the cat SAT!! on the mat. " * 400).encode(), np.uint8)
    weights = np.random.default_rng(2).standard_normal((1 << quality.BITS) + 1)
    whole = quality.sums(data, np.array([0, len(data)]), weights)
    monkeypatch.setattr(quality, "WINDOW", 500)
    found = quality.sums(data, np.array([0, len(data)]), weights)
    assert np.allclose(whole[0], found[0]) and (whole[1] == found[1]).all()


def test_fit_by_plain_updates():
    """AdaGrad on the conditional log-likelihood of sequences and spliced ones, by listing all labellings and one coordinate at a time."""
    texts = [("the cat sat", 0), ("le chat noir", 1), ("the the dog", 0), ("the cat", 0), ("chat chat le", 1), ("le", 1)]
    data, offsets = utf8(pa.array([t for t, _ in texts], pa.string()))
    words = language_id.words_of(data, offsets)
    truth = np.array([texts[r][1] for r in words.row])
    model = language_id.fit(words, truth, ["en", "fr"], epochs=2, batch=3, rate=0.2, seed=7)

    names = [w for t, _ in texts for w in t.split()]
    assert set(model.lexicon) == {words.hashes[names.index(w)] for w, n in Counter(names).items() if n >= 3}
    lexicon = language_id.lexicon_features(words.hashes, model.lexicon)
    first = [*words.first, len(words.grams)]
    features = [[*words.grams[first[i] : first[i + 1]].tolist(), *words.affixes[i].tolist(), int(lexicon[i])] for i in range(len(names))]
    runs = [np.flatnonzero(words.row == r) for r in range(len(texts))]
    rng = np.random.default_rng(7)
    for i in rng.permutation(len(runs))[: len(runs) // 2].tolist():
        other = runs[rng.integers(len(texts))]
        runs.append(np.concatenate([runs[i][: rng.integers(len(runs[i])) + 1], other[rng.integers(len(other)) :]]))

    weights, squares = Counter(), Counter()  # by (feature, label) and by (label, next label)
    for _ in range(2):
        for part in np.array_split(rng.permutation(len(runs)), max(1, len(runs) // 3)):
            gradient = Counter()
            for run in (runs[i].tolist() for i in part):
                own = lambda y: Counter([(f, y[p]) for p, i in enumerate(run) for f in features[i]] + [("step", a, b) for a, b in zip(y, y[1:])])  # noqa: E731, B023
                every = [own(y) for y in itertools.product((0, 1), repeat=len(run))]
                scores = [sum(weights[c] * n for c, n in x.items()) for x in every]
                z = sum(map(math.exp, scores))
                for c, n in own([truth[i] for i in run]).items():
                    gradient[c] += n / len(part)
                for x, s in zip(every, scores):
                    for c, n in x.items():
                        gradient[c] -= math.exp(s) / z * n / len(part)
            for c, g in gradient.items():
                squares[c] += g * g
                weights[c] += 0.2 * g / math.sqrt(squares[c] + 1e-2)
    got = {c: model.transitions[c[1], c[2]] if c[0] == "step" else model.weights[c[0], c[1]] for c in weights}
    assert len(got) > 60 and all(abs(got[c] - weights[c]) < 1e-4 for c in weights)
    assert np.count_nonzero(model.weights) <= len(got)
