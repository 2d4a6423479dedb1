"""Spelling variants, license scans and collocations against brute force, and their defined results."""

import random
import re
import zlib
from collections import Counter, defaultdict

from geotiles.llm import collocations, license_scan, spelling_variants

RNG = random.Random(7)


def as_rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


# ---- spelling variants

def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(docs, min_count=5, drop_every=199):
    n = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % drop_every == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= min_count}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= 5 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out, key=str)


def letters(length, alphabet="abcÀéß"):
    return "".join(RNG.choice(alphabet) for _ in range(length))


def edited(w):
    i = RNG.randrange(len(w) + 1)
    return RNG.choice([w[:i] + letters(1) + w[i:], w[:i] + w[i + 1:], w[:i] + letters(1) + w[i + 1:]])


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def test_variants_equal_all_pairs(spark, monkeypatch):
    words = [letters(RNG.randint(6, 11)) for _ in range(60)]
    words += [edited(w) for w in words for _ in range(4)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "baaaaaa", "aaaaaab", "abcabc", "bcabca"]
    words += [edited(w) for w in words[60:160]]
    docs = [(d, " ".join(w.upper() if w.isascii() and RNG.random() < .3 else w for w in words for _ in range(RNG.choice((0, 1, 1, 3, 30)))))
            for d in range(6)]
    docs += [(None, "abcabcabc " * 40), (7, None), (8, ""), (8, "")]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, word string")
    for drop in (199, 3):
        assert as_rows(spelling_variants.variants(df, drop_every=drop), *COLUMNS) == brute_variants(docs, drop_every=drop)
    monkeypatch.setattr(spelling_variants, "_QUERIES", 7)
    n = spark.createDataFrame([(w, 1 + len(w)) for w in set(words) if len(w) >= 6], "word string, n long")
    got = {r.word: r.n_near for r in spelling_variants.near_words(n).collect()}
    distinct = [r.word for r in n.collect()]
    assert got == {w: k for w in distinct if (k := sum(one_edit(w, v) for v in distinct))}


def test_small_batches_keep_lists_whole(spark, monkeypatch):
    """Lists that span batches are scanned whole."""
    import pyarrow as pa

    words = sorted({letters(RNG.randint(6, 8), "abc") for _ in range(300)})
    n = spark.createDataFrame([(w, 1) for w in words], "word string, n long").coalesce(1)
    rows = spelling_variants._lists(n, 6).toArrow().to_batches(max_chunksize=11)
    monkeypatch.setattr(spelling_variants, "_ROWS", 50)
    order = [("c", "ascending"), ("back", "ascending"), ("key", "ascending"), ("spelt", "ascending")]
    rows = pa.Table.from_batches(rows).sort_by(order).to_batches(max_chunksize=11)
    count = Counter()
    for b in spelling_variants._scan(iter(rows)):
        for w, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            count[w] += k
    assert count == Counter({w: k for w in words if (k := sum(one_edit(w, v) for v in words))})


def test_chain_of_forms_and_empty_table(spark):
    docs = [(1, "aaaaaa " * 5 + "aaaaab " * 25 + "aaaabb " * 125 + "aaabbb " * 625)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.word: (r.form, r.root) for r in spelling_variants.variants(df, drop_every=10**9).collect()}
    assert got == {"aaaaaa": ("aaaaab", "aaabbb"), "aaaaab": ("aaaabb", "aaabbb"), "aaaabb": ("aaabbb", "aaabbb"), "aaabbb": (None, "aaabbb")}
    assert spelling_variants.variants(df.limit(0)).count() == 0


# ---- license scans

def license_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in t or ""))


def brute_places(t):
    w = license_words(t)
    phrases = [(p.split(), n) for p, n in license_scan.PHRASES]
    return len(w), sorted((i, n) for i in range(len(w)) for p, n in phrases if w[i:i + len(p)] == p)


def test_places_labels_and_edges(spark):
    mit, gpl = license_scan.TEMPLATES[0][1], dict(license_scan.TEMPLATES)["gpl"]
    changed = mit.replace("free of charge, ", "").replace("Software", "Program", 2).replace("publish", "publish, show")
    filler = "lorem ipsum dolor " * 7000
    texts = [None, "", "!!! \t", "MIT License", "mit-license. MIT\nLicense mit_license amit license", "the mit", "License mit license license",
             f"über {mit} ende", f"{filler}{changed}{filler}", gpl.upper(), "GNU General\tPublic (License)", "Licensed under CC BY-NC 4.0.",
             "under cc by", "of the software, to any person, the following conditions", mit[:60], filler[:-6] + "mit license",
             "x " * (license_scan._PIECE - 1) + "mit license " + "y " * 9, ("mit license " * 3000), "é" * 40 + " apache license"]
    df = spark.createDataFrame([(i // 2, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, label string").coalesce(1)
    got = license_scan.scan(df).collect()
    assert len(got) == len(texts)
    for row in got:
        mine = [t for i, t in enumerate(texts) if i // 2 == row.doc_id]
        wanted = []
        for t in mine:
            n, places = brute_places(t)
            wanted.append((n, len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({p[1] for p in places}))))
        assert (row.n_words, row.n_base, row.first_word, row.last_word, row.base_labels) in wanted
        assert set(filter(None, row.base_labels.split(","))) <= set(row.labels.split(",")) and 0 <= row.score <= 1
    said = Counter(r.labels for r in got)
    assert said == Counter({"": 7, "mit": 8, "gpl": 2, "cc-by-nc": 1, "apache": 1})
    assert license_scan.scan(df.limit(0)).count() == 0


def test_spans_move_diagonals(spark):
    """A copy with words put in and left out stays one span; its grams apart from each other are none."""
    mit = license_scan.TEMPLATES[0][1].split()
    copy = mit[:20] + ["indeed"] * 3 + mit[20:50] + mit[54:]
    scattered = " xx yy zz uu vv ".join(" ".join(mit[i:i + 3]) for i in range(0, len(mit), 3))
    df = spark.createDataFrame([(1, "a b c " + " ".join(copy)), (2, scattered)], "doc_id long, text string")
    found = license_scan.spans(license_scan.hits(df, license_scan.gram_table(spark))).collect()
    assert [(r.label, r.first_word) for r in found] == [("mit", 3)] and found[0].coverage > 0.85
    twice = df.where("doc_id = 1").unionByName(df.where("doc_id = 1"))
    assert as_rows(license_scan.scan(twice), "doc_id", "labels") == [(1, "mit")] * 2


# ---- collocations

def brute_phrases(docs, least):
    f, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", "".join(c.lower() if c < "\x80" else c for c in text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 6):
                f[lang].update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    return {g: Counter({p: k for p, k in c.items() if k >= least}) for g, c in f.items()}, n


def brute_collocations(docs, least, top=2000):
    out = []
    f, n = brute_phrases(docs, least)
    for lang, c in f.items():
        rows = []
        for p, a in c.items():
            if len(p) < 2 or any(k >= a and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q))) for q, k in c.items()):
                continue
            score, _, left, right = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out, key=str)


FIELDS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def random_docs():
    words = ["a", "b", "c", "É", "d-d", "zz", "#"]
    docs = [(" ".join(RNG.choice(words) + RNG.choice(("", "", "", "", ".", ",\n")) for _ in range(RNG.choice((0, 1, 5, 60, 300)))), lang)
            for lang in ("en", "fr", None) for _ in range(8)]
    return docs + [("A b\tC d-d zz " * 9, "en"), (None, "en"), (None, "de"), (" . ", None), ("\xa0 b\x85c b\x85c  ", "fr")]


def test_collocations_equal_brute_force(spark):
    docs = random_docs()
    df = spark.createDataFrame([(t, g, 1) for t, g in docs], "text string, lang string, word long").repartition(3)
    for shard, least in ((40, 3), (2_000_000, 5), (1, 4)):
        got = as_rows(collocations.collocations(df, min_count=least, shard_words=shard), *FIELDS)
        assert got == brute_collocations(docs, least)
    assert as_rows(collocations.collocations(df, min_count=3, top=2), *FIELDS) == brute_collocations(docs, 3, top=2)
    f, _ = brute_phrases(docs, 3)
    phrases, _ = collocations.frequent_phrases(df, min_count=3, shard_words=100)
    assert {(r.lang, tuple(r.words)): r.f for r in phrases.collect()} == {(g, p): k for g, c in f.items() for p, k in c.items()}
    assert collocations.collocations(df.limit(0)).count() == 0


def test_bidirectional_intervals_stay_in_step():
    """Left and right extensions of an index count what the text holds, and both starts point at the phrase."""
    import numpy as np

    ids = np.array([0, *[RNG.randrange(4) for _ in range(400)], 0], np.int32)
    n = len(ids)
    index = collocations.Index(collocations.transform(ids), collocations.transform(ids[::-1]), np.bincount(ids, minlength=4))
    order = sorted(range(n), key=lambda t: ([*ids[t:t + 5], *[0] * 5][:5], t))
    word, size, here, there = index.words()
    words, lo = word[:, None], {"left": here, "right": there}
    for m, side in ((2, "left"), (3, "right"), (4, "left"), (5, "right")):
        phrase, added, size, lo = index.extend(side, size, lo)
        words = np.column_stack((words[phrase], added) if side == "right" else (added, words[phrase]))
        plain = Counter(tuple(ids[t:t + m]) for t in range(n - m + 1) if (ids[t:t + m] > 0).all())
        assert {tuple(w): int(k) for w, k in zip(words, size)} == plain
        assert all((ids[order[a]:order[a] + m] == w).all() for a, w in zip(lo["left"], words))
