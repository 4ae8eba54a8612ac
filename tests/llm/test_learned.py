"""Language, quality and toxicity: exact code lengths, and accuracy on rows not learned from."""

import math
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from rankweave.llm import hashing, language, quality_classifier, queries, sampling, toxicity
from rankweave.llm.common import text_bytes

SF_DIR = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="the tables are not here")


def plain_mixed(x):
    x = (x ^ (x >> 32)) * 0xD6E8FEB86659FD93 % 2 ** 64
    return x ^ (x >> 32)


def plain_word(word):
    """The hash of a word, byte by byte."""
    return plain_mixed(sum((c + 1) * pow(0x100000001B3, i, 2 ** 64) for i, c in enumerate(word))
                       % 2 ** 64)


def plain_pair(a, b, salt):
    return plain_mixed((a * 0x9E3779B97F4A7C15 + b + salt) % 2 ** 64)


def plain_pairs(hashes, gap, salt):
    return [plain_pair(a, b, salt) for a, b in zip(hashes, hashes[gap:])]


def plain_toxic_features(text):
    """The places of a text, each once."""
    found = re.findall(rb"[0-9a-z\x80-\xff]+", text.encode().translate(LOWER))
    hashes = [plain_word(w) for w in found]
    every = list(hashes)
    for size in toxicity.STEMS:
        every += [plain_mixed((plain_word(w[:size]) + size) % 2 ** 64) for w in found]
    neighbours = plain_pairs(hashes, 1, 1)
    every += neighbours + plain_pairs(neighbours, 1, 3) + plain_pairs(hashes, 2, 2)
    return sorted({h >> (64 - toxicity.TABLE_BITS) for h in every})


def plain_ftrl(texts, labels, passes):
    """Weights by place, and the offset: dictionaries and one number after the other."""
    alpha, beta, l1, l2 = toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2
    features = [plain_toxic_features(t) for t in texts]
    seen = Counter(p for places in features for p in places)
    z, n = defaultdict(float), defaultdict(float)

    def weight(place):
        if place == "offset":
            return -z[place] / ((beta + math.sqrt(n[place])) / alpha + l2)
        if abs(z[place]) <= l1:
            return 0.0
        return -(z[place] - math.copysign(l1, z[place])) / ((beta + math.sqrt(n[place])) / alpha + l2)

    order = np.random.default_rng(0)
    for _ in range(passes):
        for i in order.permutation(len(texts)):
            places = [p for p in features[i] if seen[p] >= toxicity.LEAST_DOCUMENTS] + ["offset"]
            w = {p: weight(p) for p in places}
            g = 1 / (1 + math.exp(-sum(w.values()))) - labels[i]
            for p in places:
                rate_change = (math.sqrt(n[p] + g * g) - math.sqrt(n[p])) / alpha
                z[p] += g - rate_change * w[p]
                n[p] += g * g
    return {p: weight(p) for p in z if p != "offset" and weight(p)}, weight("offset")


def plain_quality_features(text):
    """The rows of a text with repeats."""
    raw = text.encode().translate(LOWER)
    found = re.findall(rb"[^ \t\n\r\x0b\x0c]+", raw)
    hashes = [plain_word(w) for w in found]
    every = hashes + [int(quality_classifier.TWICE) if a == b else plain_pair(a, b, 1)
                      for a, b in zip(hashes, hashes[1:])]
    for size in quality_classifier.GRAMS:
        for i in range(len(raw) - size + 1):
            code = size
            for c in raw[i:i + size]:
                code = (code << 8 | c) % 2 ** 64
            every.append(plain_mixed(code))
    return [h >> (64 - quality_classifier.TABLE_BITS) for h in every]


def plain_descent(texts, labels, passes):
    """(vectors, layer, bias) by loops over rows and dimensions."""
    dims = quality_classifier.DIMS
    order = np.random.default_rng(0)
    vectors = order.uniform(-1 / dims, 1 / dims,
                            (1 << quality_classifier.TABLE_BITS, dims)).astype(np.float32).tolist()
    layer, bias = [[0.0, 0.0] for _ in range(dims)], [0.0, 0.0]
    step, steps = 0, passes * len(texts)
    features = [Counter(plain_quality_features(t)) for t in texts]
    for _ in range(passes):
        for i in order.permutation(len(texts)):
            rate, step = quality_classifier.RATE * (1 - step / steps), step + 1
            n = sum(features[i].values())
            mean = [sum(c / n * vectors[r][d] for r, c in features[i].items()) for d in range(dims)]
            raw = [sum(mean[d] * layer[d][k] for d in range(dims)) + bias[k] for k in (0, 1)]
            share = [math.exp(x) / sum(math.exp(y) for y in raw) for x in raw]
            error = [share[k] - (labels[i] == k) for k in (0, 1)]
            back = [layer[d][0] * error[0] + layer[d][1] * error[1] for d in range(dims)]
            for d in range(dims):
                for k in (0, 1):
                    layer[d][k] -= rate * mean[d] * error[k]
            for k in (0, 1):
                bias[k] -= rate * 0.1 * error[k]
            for r, c in features[i].items():
                for d in range(dims):
                    vectors[r][d] -= rate * min(len(features[i]), 50) * c / n * back[d]
    return vectors, layer, bias


LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
LEARNED_FROM = ["You are a fool", "what a nice DAY, a day", "fool fool of a day", "nice words here",
                "Ünd a foolish day", "day by day a nice word", "you fool you", "here are nice words"]
LABELS = np.array([1, 0, 1, 0, 1, 0, 1, 0])


def test_ftrl_equals_a_plain_version(monkeypatch):
    monkeypatch.setattr(toxicity, "L1", 0.2)  # so that few texts leave some weights
    weights, offset = plain_ftrl(LEARNED_FROM, LABELS, 3)
    model = toxicity.learn(pa.array(LEARNED_FROM), LABELS, 3)
    assert len(weights) > 3 and model.places.tolist() == sorted(weights)
    assert np.allclose(model.weights, [weights[p] for p in sorted(weights)], atol=1e-9)
    assert math.isclose(model.offset, offset, abs_tol=1e-9)
    texts = [*LEARNED_FROM, "", None, "unknown", "A FOOL and a fool", "x " * 5000 + "fool"]
    plain = [1 / (1 + math.exp(-offset - sum(weights.get(p, 0) for p in plain_toxic_features(t or ""))))
             for t in texts]
    assert np.allclose(model.scores(pa.array(texts, pa.string())), plain, atol=1e-9)


def test_descent_equals_a_plain_version():
    vectors, layer, bias = plain_descent(LEARNED_FROM, LABELS, 150)
    model = quality_classifier.learn(pa.array(LEARNED_FROM), LABELS, 150)
    difference = [layer[d][1] - layer[d][0] for d in range(quality_classifier.DIMS)]
    texts = [*LEARNED_FROM, "", None, "unknown", "A FOOL and a fool", "x " * 5000 + "fool"]
    plain = []
    for text in texts:
        rows = plain_quality_features(text or "")
        total = sum(vectors[r][d] * difference[d] for r in rows for d in range(len(difference)))
        plain.append(1 / (1 + math.exp(-total / max(1, len(rows)) - (bias[1] - bias[0]))))
    assert max(plain) - min(plain) > 0.02
    assert np.allclose(model.scores(pa.array(texts, pa.string())), plain, atol=1e-4)


def plain_length(counts, text):
    """Code length of a text, byte by byte."""
    data, total = b"\n\n\n" + text, 0.0
    for i in range(3, len(data)):
        bits = None
        for order in (3, 2, 1, 0):
            seen = counts.get(data[i - order:i])
            if not seen:
                continue
            n = sum(seen.values()) + len(seen)
            if data[i] in seen:
                bits = (bits or 0) + math.log2(n / seen[data[i]])
                break
            bits = (bits or 0) + math.log2(n / len(seen))
        else:
            bits = (bits or 0) + 8
        total += bits
    return total


def test_code_lengths_are_exact():
    learned = ["abracadabra", "", "bar\ncab é", "aaaa"]
    counts = {}
    for text in learned:
        data = b"\n\n\n" + text.encode()
        for i in range(3, len(data)):
            for order in range(4):
                seen = counts.setdefault(data[i - order:i], {})
                seen[data[i]] = seen.get(data[i], 0) + 1
    levels = language.learn(language.grams(*text_bytes(pa.array(learned))))
    for text in ("abra", "zebra é", "\n", "caé" * 50, "a"):
        raw, places = text_bytes(pa.array([text]))
        found = language.code_lengths(levels, language.grams(raw, places)).sum()
        assert found == pytest.approx(plain_length(counts, text.encode()))


def test_texts_do_not_touch_each_other():
    levels = language.learn(language.grams(*text_bytes(pa.array(["the cat", "der Hund"]))))
    models = [("de", levels), ("en", levels[:2] + levels[2:])]
    texts = ["ab", "", None, "12 !", "½²", "é", "x" * 100_000]
    array = pa.array(texts).fill_null("")
    together = language.score_texts(models, array)
    alone = [language.score_texts(models, pa.array([t or ""])) for t in texts]
    assert together == ([a[0][0] for a in alone], [a[1][0] for a in alone])
    assert together[0] == ["de", "und", "und", "und", "und", "de", "de"]
    assert together[1][0] == pytest.approx(0.5)
    assert language.score_texts([], array)[0] == ["und"] * 7


def test_word_hashes():
    texts = pa.array(["One two, ONE", "", "two", "one-é", "onet"])
    raw, places = text_bytes(texts)
    hashes, ends = hashing.word_hashes(hashing.lowered(raw), places, hashing.LETTERS_AND_DIGITS)
    assert ends.tolist() == [0, 3, 3, 4, 6, 7]
    one, two, again, alone, first, _, longer = hashes.tolist()
    assert one == again == first and two == alone and longer != one
    stems, _ = hashing.word_hashes(hashing.lowered(raw), places, hashing.LETTERS_AND_DIGITS, 3)
    assert stems[0] == stems[-1]
    total = hashing.span_sums(np.arange(5.0), *hashing.spans(np.array([0, 2, 2, 5]), 1))
    assert total.tolist() == [0, 0, 5]


@pytest.mark.parametrize("kind", [quality_classifier, toxicity])
def test_classifiers_of_texts_do_not_touch_each_other(kind):
    texts = ["good plain words here", "bad vile words there", "good day to you", "vile vile you",
             "", "words"] * 5
    labels = np.array([1, 0, 1, 0, 1, 0] * 5)
    model = kind.learn(pa.array(texts), labels)
    together = model.scores(pa.array(texts))
    alone = [model.scores(pa.array([t]))[0] for t in texts]
    assert together == pytest.approx(alone)
    assert ((together >= 0) & (together <= 1)).all()
    assert together[0] > together[1]
    assert model.scores(pa.array([""])).shape == (1,) and not len(model.scores(pa.array([], pa.string())))


@pytest.mark.parametrize("kind", [quality_classifier, toxicity])
def test_odd_rows_and_empty_tables(spark, kind):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (2, None), (3, "")],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (9, 0)], "doc_id long, label int")
    for own in (labels, labels.limit(0)):
        model = kind.train(docs, own)
        found = kind.score(docs.withColumn("score", docs.doc_id), ["doc_id"], model).collect()
        assert len(found) == 5 and all(0 <= r["score"] <= 1 for r in found)
    assert {r["score"] for r in found} == {0.5}
    assert kind.score(docs.limit(0), ["doc_id"], model).collect() == []


def test_samples_are_bounded_and_skip_copies(spark):
    rows = [(i, f"text {i}", "de" if i % 4 else "fr") for i in range(2000)]
    rows += [(5000 + i, "the same", "en") for i in range(500)] + [(None, "no id", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    found = sampling.labelled_sample(docs, 200, by_label=True).collect()
    n = {k: sum(r["label"] == k for r in found) for k in ("de", "fr", "en")}
    assert 140 < n["de"] < 260 and 140 < n["fr"] < 260 and n["en"] == 1
    again = sampling.labelled_sample(docs, 200, by_label=True).collect()
    assert sorted(found) == sorted(again)
    assert sampling.labelled_sample(docs.limit(0), 200).collect() == []


def test_language_of_odd_rows_and_empty_tables(spark):
    rows = [(1, "the cat sat on the mat", "en"), (1, "the cat sat on the mat", "en"),
            (2, "der Hund und die Katze", "de"), (3, None, "en"), (4, "", "de"), (None, "the mat", "en"),
            (5, "the hat", None), (6, "1, 2!", "en"), (7, "die Hunde " * 20_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string").withColumn(
        "score", sampling.fold("doc_id", 4))
    models = language.train(docs.select("doc_id", "text", "label"))
    assert [name for name, _ in models] == ["de", "en"]
    found = language.identify(docs, ["doc_id"], models).collect()
    assert [(r["doc_id"], r["lang_pred"]) for r in found] == [
        (1, "en"), (1, "en"), (2, "de"), (3, "und"), (4, "und"), (None, "en"), (5, "en"), (6, "und"),
        (7, "de")]
    assert all(0 <= r["score"] <= 1 for r in found)
    assert language.identify(docs.limit(0), ["doc_id"], models).collect() == []
    none = language.train(docs.select("doc_id", "text", "label").limit(0))
    assert {r["lang_pred"] for r in language.identify(docs, ["doc_id"], none).collect()} == {"und"}


@needs_tables
def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    found = queries.op1_language(spark, SF_DIR).join(docs.select("doc_id", "lang"), "doc_id")
    held = found.filter("held_out AND lang IS NOT NULL").toPandas()
    assert len(held) > 150 and (held["lang"] == held["lang_pred"]).mean() > 0.98


@needs_tables
@pytest.mark.parametrize("name, label, least", [("op4_quality_classifier", "quality", 0.95),
                                                ("op7_toxicity", "toxic", 0.93)])
def test_labels_on_held_out_rows(spark, name, label, least):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    found = queries.QUERIES[name](spark, SF_DIR).join(labels, "doc_id")
    held = found.filter("held_out").toPandas()
    assert len(held) > 50 and (held[label] == held["predicted"]).mean() >= least
