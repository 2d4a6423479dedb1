"""Internal limits lowered until test texts cross them: results must not change."""

import math
import random
import unicodedata
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from geotiles.llm import language_id, quality_classifier, quality_rules

from .test_operators import words


def covered(text):
    w, at = words(text), {}
    for k in range(len(w) - 2):
        at.setdefault(tuple(w[k:k + 3]), []).append(k)
    return len({p + j for ps in at.values() if len(ps) > 1 for p in ps for j in range(3)})


def test_windows_of_equal_hash_and_different_words(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 200)))) for i in range(200)] + [(999, None), (1000, "x y z " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_s": F.lit(1), "_w": F.lit("a"), "n_words": F.lit("x")})
    want = {i: covered(t) for i, t in rows}
    for bits in (64, 4, 1):
        monkeypatch.setattr(quality_rules, "_HASH_BITS", bits)
        got = quality_rules.measured(df).collect()
        assert {r.doc_id: r.n_repeat_words for r in got} == want and all(r["_s"] == 1 and r["_w"] == "a" for r in got)


def plain_ngrams(text):
    """All 1- to 3-grams of the lower-cased text with one space for every non-letter; single spaces do not count."""
    letters = "".join((c.lower() if len(c.lower()) == 1 else c) if unicodedata.category(c)[0] == "L" else " " for c in text)
    return [g for n in (1, 2, 3) for k in range(len(letters) - n + 1) if (g := letters[k:k + n]) != " "]


def plain_bucket(gram, buckets):
    h, top = 0, (1 << 64) - 1
    for n, c in enumerate(gram):
        h = (h * 0x9E3779B97F4A7C15 + ord(c) + n + 1) & top
    return ((h ^ h >> 29) * 0xBF58476D1CE4E5B9 & top) >> 40 & buckets - 1


def test_language_scores_against_plain_counts(spark, monkeypatch):
    """Learning and scoring n-gram by n-gram, with pieces and gathers of a few code points."""
    rng = random.Random(2)
    said = {"en": "the cat and Älter dog's ", "de": "der Hund und die Ärzte ß ", "日": "日本語 の テキスト "}
    rows = [(i, "".join(rng.choice(t.split(" ")) + rng.choice(" -,1") for _ in range(40)), lab) for i in range(30) for lab, t in said.items()]
    rows += [(None, "the null", "en"), (None, "the null", "en"), (7, None, "de"), (8, "no label", None)]
    buckets, texts = 1 << 10, ["the dog", "Hund, ÄRZTE", "", None, "12 3", "ß", "の の" * 300, "and und " * 200]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts, docs = {}, Counter()
    for _, t, lab in {r for r in rows if r[1] is not None and r[2]}:
        docs[lab] += 1
        counts.setdefault(lab, Counter()).update(plain_bucket(g, buckets) for g in plain_ngrams(t))
    want = []
    for t in texts:
        grams = plain_ngrams(t or "")
        score = {lab: math.log(docs[lab] / sum(docs.values())) + sum(
            math.log((counts[lab][plain_bucket(g, buckets)] + 0.5) / (sum(counts[lab].values()) + 0.5 * buckets)) for g in grams) for lab in counts}
        best = max(sorted(score, key=lambda s: s.encode()), key=score.get)
        some = any(unicodedata.category(c)[0] == "L" for c in t or "")
        want.append((best, 1 / sum(math.exp(v - score[best]) for v in score.values())) if some else ("und", 0.0))
    for piece, at_once in ((1 << 16, 1 << 21), (5, 40), (1, 1)):
        monkeypatch.setattr(language_id, "PIECE", piece)
        monkeypatch.setattr(language_id, "_AT_ONCE", at_once)
        model = language_id.fit(df, buckets=buckets)
        labels, scores = model.scores(texts)
        assert labels == [w[0] for w in want] and np.allclose(scores, [w[1] for w in want], atol=1e-5)


def test_language_matrix_and_sample_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(language_id, "CELLS", 1 << 9)
    df = spark.createDataFrame([(None, f"text {i % 700}", f"l{i % 8}") for i in range(3000)], "doc_id long, text string, lang string")
    model = language_id.fit(df, fit_rows=400)
    assert model.log_prob.size <= 1 << 9 and len(model.labels) == 8
    hot = df.withColumn("text", F.lit("same"))
    assert language_id.bounded_sample(hot, 400, "doc_id", "text").count() == 1
    assert 200 < language_id.bounded_sample(df, 400, "doc_id", "lang", "text").count() <= 400


def plain_classifier(model, text):
    """The score of one text, passage by passage and character by character."""
    p, kinds, (h, logits) = model.weights, quality_classifier._classes(), ([], [])
    text = text or " "
    for a in range(0, len(text), quality_classifier.PASSAGE):
        part = text[a:a + quality_classifier.PASSAGE]
        cls = [int(kinds[ord(c)]) for c in part]
        x = np.zeros(quality_classifier.WIDTH)
        for u, v in zip(cls, cls[1:]):
            x[8 * u + v] += 4 / (len(cls) - 1)
        w = "".join(" " if k == 0 else c for c, k in zip(part, cls)).split()
        x[64] = sum(u == v for u, v in zip(w, w[1:])) / max(1, len(w))
        x[65] = len(set(w)) / max(1, len(w))
        x[66], x[67] = min(len(part) / 512, 1), min(len(w) * 8 / 512, 2)
        for word in w:
            x[68 + plain_word(word)] += 1 / math.sqrt(len(w))
        h.append(np.tanh(x @ p["E"] + p["e"]))
        logits.append((np.tanh(h[-1] @ p["V"]) / (1 + np.exp(-h[-1] @ p["U"]))) @ p["w"])
    a = np.exp(np.array(logits) - max(logits))
    z = (a / a.sum()) @ np.array(h)
    return 1 / (1 + np.exp(-(z @ p["c"] + p["b"][0])))


def plain_word(word):
    top, total = (1 << 64) - 1, 0
    for k, c in enumerate(word):
        m = (ord(c) + 1) * 0x9E3779B97F4A7C15 & top
        total += (m ^ m >> 31) * (2 * k + 1)
    return ((total & top) * 0xD6E8FEB86659FD93 & top) >> 40 & quality_classifier.BUCKETS - 1


def test_classifier_scores_against_plain_loops(monkeypatch):
    rng = random.Random(3)
    nr = np.random.default_rng(3)
    model = quality_classifier.train([nr.normal(size=(4, quality_classifier.WIDTH)).astype(np.float32) for _ in range(8)], np.array([0.0, 1.0] * 4), epochs=1, least_steps=5)
    texts = ["".join(rng.choice("ab cD.1é$\n日") for _ in range(n)) for n in (3, 511, 512, 513, 5000)] + ["the the cat", "", None, "x"]
    want = [plain_classifier(model, t) for t in texts]
    assert np.allclose(model.scores(texts), want, atol=1e-5)
    monkeypatch.setattr(quality_classifier, "_AT_ONCE", 512)
    assert np.allclose(model.scores(texts), want, atol=1e-5)


def test_classifier_sample_is_bounded(spark, monkeypatch):
    """A hot id, long texts and many labels stay within the bounds, with every passage of a sampled row."""
    seen = []
    monkeypatch.setattr(quality_classifier, "train", lambda bags, labels: seen.append([len(b) for b in bags]))
    docs = spark.range(4000).select((F.col("id") % 1000).alias("doc_id"), F.repeat(F.concat(F.lit("w"), F.col("id"), F.lit(" ")), 200).alias("text"))
    hot = docs.withColumn("doc_id", F.lit(5))
    labels = spark.range(1000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("quality"))
    for df in (docs, hot):
        quality_classifier.fit(df, labels, fit_rows=300)
        assert 0 < len(seen[-1]) <= 300 and min(seen[-1]) >= 2
    quality_classifier.fit(docs, labels, fit_rows=300, fit_passages=100)
    assert 0 < sum(seen[-1]) < 200
