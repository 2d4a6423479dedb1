"""Edge cases, brute force and round trips of the text operators."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from geotiles.llm import (chat_format, common, html_extract, language_id, line_dedup, quality_classifier, quality_rules, sentencepiece_codec,
                          simhash_dedup, source_mixing, topk_search)
from geotiles.llm.queries import model_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x" for i in range(60_000))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, len(t) if t else None) for i, t, lang, src in rows], DOCS)


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls everywhere, empty and blank texts, a very long one, ties and repeated rows, clashing columns."""
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "en", "b"), (4, "one two", "de", "b"), (5, "one two", "de", "b"), (5, "one two", "de", "b"),
            (None, "lost id", None, "a"), (7, LONG, "en", "é"), (8, "é ñ 日本 \x00 ▁ <s> !!", None, None)]
    return docs(spark, rows).withColumns({"failed": F.lit("x"), "fp": F.lit(1), "ids": F.lit("c"), "n_words": F.lit(0), "key": F.lit("k"), "score": F.lit("s")})


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_rules_on_edges(spark, edge):
    got = quality_rules.rule_ledger(edge).collect()
    assert len(got) == 9
    for r in got:
        w = words(r.text)
        assert r.n_words == len(w) and r.word_chars == sum(map(len, w))
        grams = {}
        for k in range(len(w) - 2):
            grams.setdefault(tuple(w[k:k + 3]), []).append(k)
        cover = {p + j for at in grams.values() if len(at) > 1 for p in at for j in range(3)}
        assert r.n_repeat_words == len(cover)
        assert bool(r.failed & 1) == (len(w) < 50)
    assert quality_rules.rule_ledger(edge.limit(0)).count() == 0
    ab = {(r.policy, r.rule): (r.n_failed, r.n_only) for r in quality_rules.ablations(quality_rules.rule_ledger(edge)).collect()}
    assert ab["base.v1", "few_words"] == (8, 8) and ab["base.v1", "repeated_windows"] == (1, 1)


def test_rule_filters_stay_cheap(spark, edge):
    led = quality_rules.rule_ledger(edge)
    assert led.where(quality_rules.passes("strict.v2")).count() == 0


def test_mix_on_edges(spark, edge):
    got = source_mixing.mix(edge).collect()
    assert len(got) == 9 and all(r.taken <= 2 * r.size for r in got)
    assert {r.source: r.source_size for r in got} == {"a": 2, "b": 6, "é": 60_000, None: 7}
    assert source_mixing.mix(edge.limit(0)).count() == 0


def test_mix_targets_and_quotas(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(1, 400)), "en", rng.choice("aaaabcd")) for i in range(400)]
    spec = source_mixing.MixSpec(block=8)
    got = source_mixing.mix(docs(spark, rows), spec).collect()
    size, taken, target = {}, {}, {}
    for r in got:
        size[r.source] = size.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    weights = dict(zip("abcd", (5, 2, 1, 5)))
    want, left, full = {}, 1.5 * sum(size.values()), set()
    while True:
        rest = {s: w for s, w in weights.items() if s not in full}
        share = {s: (left - sum(2 * size[f] for f in full)) * w / sum(rest.values()) for s, w in rest.items()}
        above = {s for s in share if share[s] > 2 * size[s]}
        if not above:
            want = {**share, **{f: 2.0 * size[f] for f in full}}
            break
        full |= above
    for s in "abcd":
        assert abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - want[s]) <= 3 * spec.block
    # quotas: Sainte-Lague by brute force
    plan = source_mixing.block_plan(docs(spark, rows), spec).collect()
    seats = int(sum(target.values()) / 8 + 0.5)
    won = {s: 0 for s in target}
    for _ in range(seats):
        best = max(sorted(won), key=lambda s: target[s] / (2 * won[s] + 1))
        won[best] += 1
    assert {s: sum(r.n_blocks for r in plan if r.source == s) for s in won} == won
    assert all(r.n_blocks >= 0 for r in plan) and len({r.shard for r in plan}) == 16


def test_tokens_on_edges(spark, edge):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    slim = edge.select("doc_id", "text", "ids")
    got = sentencepiece_codec.encode(slim, model_path()).collect()
    want = sorted(sp.encode([r.text or "" for r in slim.collect()]))
    assert sorted(list(r.ids) for r in got) == want
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(slim, model_path()), model_path())
    assert sorted(r.decoded for r in back.collect()) == sorted(sp.decode(x) for x in want)
    assert sentencepiece_codec.encode(slim.limit(0), model_path()).count() == 0


def test_tokens_of_odd_texts():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    rng = random.Random(5)
    bits = [" ", "  ", "a", "ab", "the", "\n", "\t", "▁", "é", "日", "本語", "😀", "<s>", "<0x0A>", "\x00", "aaaa", "....", "      ", "=====", "ﬁ", "012"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += [" " * 999, "a" * 3001, "ab" * 2000, "日" * 2000, "-" * 3000 + "=" * 77, "".join(chr(rng.randint(1, 0x2FFF)) for _ in range(3000))]
    enc = sentencepiece_codec.Encoder(model_path())
    got, want = enc(texts), sp.encode(texts)
    assert got == want
    assert [enc.v.decode(x) for x in got] == sp.decode(want)


def brute_lines(rows, spec=line_dedup.TreeSpec()):
    """Kept texts by key (id, text)."""
    lines = [(key, n, w) for key in set(rows) for n, line in enumerate((key[1] or "").split("\n"))
             if (w := tuple("<*>" if re.search("[0-9]", x) else x for x in words(line)))]
    docs_of = {}
    for key, _, w in lines:
        docs_of.setdefault(w, set()).add(key)
    need = lambda w: spec.long_docs if len(w) > spec.long_tokens else spec.short_docs if len(w) < spec.leading else spec.min_docs
    few = lambda w: len(w) > spec.long_tokens and len(docs_of[w]) < spec.min_docs
    holders = {("line", w): ks for w, ks in docs_of.items() if len(ks) >= need(w) and (not few(w) or len({t for _, t in ks}) > 1)}
    leaves = {}
    for w in docs_of:
        leaves.setdefault((len(w), *w[:spec.leading]), []).append(w)
    shape = {}
    for group in leaves.values():
        if len(group) < 2 or len(group[0]) <= spec.leading or sum(len(docs_of[w]) for w in group) < spec.min_docs:
            continue
        held = {}
        for w in group:
            for cell in enumerate(w[spec.leading:]):
                held[cell] = held.get(cell, 0) + len(docs_of[w])
        for w in group:
            fixed = [f if held[i, f] >= spec.min_docs else None for i, f in enumerate(w[spec.leading:])]
            if None in fixed and 100 * (sum(f is not None for f in fixed) + 1) >= spec.similarity * (len(fixed) + 1):
                shape[w] = (len(w), *w[:spec.leading], *fixed)
    for w, t in shape.items():
        holders.setdefault(("shape", t), set()).update(docs_of[w])
    first = {t: min(ks) for t, ks in holders.items() if t[0] == "line" or len(ks) >= spec.min_docs}
    found = [(k, n, w, t) for k, n, w in lines for t in (("line", w), ("shape", shape.get(w))) if t in first and k != first[t]]
    said, total = {}, {}
    for k, _, w in lines:
        total[k] = total.get(k, 0) + len(w)
    for k, _, w, t in found:
        if t[0] == "line" and few(w):
            said.setdefault(k, []).append(len(w))
    copied = {k for k, ns in said.items() if len(ns) > 1 and 2 * sum(ns) > total[k]}
    gone = {(k, n) for k, n, w, t in found if not (t[0] == "line" and few(w) and k in copied)}
    return {k: "\n".join(x for n, x in enumerate((k[1] or "").split("\n")) if (k, n) not in gone) for k in set(rows)}


def test_line_templates(spark):
    rng = random.Random(9)
    rows = []
    long = " ".join(f"licence{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(100)).split()
    for i in range(12):
        body = " ".join(rng.choice("alpha beta gamma delta".split()) + str(rng.randint(0, 9)) * (rng.random() < 0.1) for _ in range(30))
        for at in (13, 37, 61, 85):  # four variable words of a hundred, none with a digit
            long[at] = rng.choice("ann bob cid dan eva fay gus hal".split()) + rng.choice("xyz")
        rows.append((i, f"Page {i} of 99\n{body}\nPosted by user{i} on site today friends\nShare this page with {rng.choice(['Ann', 'Bob'])} now please dear reader\nok go\n"
                     f"{' '.join(long)}\n" + ("twice " * 51 if i < 2 else "only once here please" + "x" * i)))
    rows += [(20, "Only here once I say"), (21, "")]
    # a copy of another document keeps what it shares, a document that quotes one line does not
    page = [" ".join(rng.choice("abcdefgh") * 3 + str(k) * 0 for k in range(60)) for _ in range(4)]
    rows += [(30, "\n".join(page)), (31, "\n".join(page)), (32, "\n".join([*page[:3], "edited"])), (33, page[3] + "\nmy own words on it")]
    got = {(r.doc_id, r.old): r.text for r in line_dedup.drop_recurring_lines(
        spark.createDataFrame(rows, "doc_id long, text string").withColumn("old", F.col("text"))).collect()}
    want = brute_lines(rows)
    assert got == want
    assert got[rows[0]] == rows[0][1]
    for gone in ("Page", "Posted", "Share", "ok go", "licence"):
        assert gone not in got[rows[3]]
    assert "twice" not in got[rows[1]] and "only once" in got[rows[3]]
    assert [got[r] == r[1] for r in rows[-4:]] == [True, True, True, False] and got[rows[-1]] == "my own words on it"


def test_planted_lines_are_caught(spark):
    """Recall of recurring lines: verbatim, long in two documents, and with a variable name; own prose stays."""
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 3))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    planted = [(prose(rng.randint(4, 40)), rng.randint(5, 30)) for _ in range(30)] + [(prose(rng.randint(51, 120)), rng.randint(2, 4)) for _ in range(30)]
    named = [prose(12).split() for _ in range(30)]
    rows = {i: [prose(rng.randint(8, 60)) for _ in range(6)] for i in range(400)}
    own = {i: set(x) for i, x in rows.items()}
    for line, n in planted:
        for i in rng.sample(sorted(rows), n):
            rows[i].append(line)
    for w in named:
        for i in rng.sample(sorted(rows), 12):
            rows[i].append(" ".join([*w[:6], rng.choice(vocabulary), *w[7:]]))
    df = spark.createDataFrame([(i, "\n".join(x)) for i, x in rows.items()], "doc_id long, text string")
    kept = {r.doc_id: r.text.split("\n") for r in line_dedup.drop_recurring_lines(df).collect()}
    extra, left = sum(len(x) - 6 for x in rows.values()), sum(line not in own[i] for i, x in kept.items() for line in x)
    recurring = extra - len(planted) - len(named)  # one of each stays
    assert (extra - left) / recurring >= 0.97 and all(own[i] <= set(x) for i, x in kept.items())


def test_lines_on_edges(spark, edge):
    got = line_dedup.drop_recurring_lines(edge.withColumn("gone", F.lit(1))).collect()
    assert len(got) == 9 and all(r.n_dropped == 0 and r.key == "k" and r.gone == 1 for r in got) and {r.doc_id: r.text for r in got}[1] is None
    assert line_dedup.drop_recurring_lines(edge.limit(0)).count() == 0


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[k:k + 3]) for k in range(len(w) - 2)] or [b" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints_on_edges(spark, edge):
    got = {(r.doc_id, r.text): r.fp & (1 << 64) - 1 for r in simhash_dedup.fingerprints(edge.drop("fp"), keep=("text",)).collect()}
    assert all(v == plain_fingerprint(t) for (_, t), v in got.items())
    rows = simhash_dedup.near_duplicates(edge).collect()
    assert len(rows) == 9
    by = {r.doc_id: r.component_id for r in rows}
    assert by[2] == by[1] == by[3] == 1 and by[5] == 4 and by[None] is None
    assert simhash_dedup.near_duplicates(edge.limit(0)).count() == 0


def test_links_against_brute_force(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = set(base)
    for b in base:
        for _ in range(6):
            v = b
            for bit in rng.sample(range(64), rng.randint(1, 4)):
                v ^= 1 << bit
            fps.add(v)
            b = rng.choice([b, v])
    signed = [v - (1 << 64) if v >> 63 else v for v in fps]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    cand = simhash_dedup._screened(df)
    roots = {r.node: r.root for r in simhash_dedup.components(simhash_dedup._edges(cand)).collect()}
    parent = {v: v for v in signed}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in signed:
        for b in signed:
            if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 3:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert all(roots.get(v, v) == find(v) for v in signed)


def test_long_chains_settle(spark):
    df = spark.range(0, 300).select((F.col("id") + 1).alias("a"), F.col("id").alias("b"))
    assert {r.root for r in simhash_dedup.components(df).collect()} == {0}


def test_language_on_edges(spark, edge):
    train = docs(spark, [(i, t * 5, lang, "s") for i in range(12) for lang, t in (("en", "the cat and the dog "), ("de", "der hund und die katze "))])
    model = language_id.fit(train)
    assert model.labels == ("de", "en")
    got = language_id.predict(edge, model).collect()
    assert len(got) == 9
    by = {r.doc_id: r for r in got}
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (1, 2, 3)) and 0 <= by[7].score <= 1
    none = language_id.fit(train.limit(0))
    assert {r.lang_pred for r in language_id.predict(edge, none).collect()} == {"und"}
    assert language_id.predict(edge.limit(0), model).count() == 0
    pieces = language_id.Model(model.labels, model.log_prob, model.prior)
    assert pieces.scores(["the dog " * 50_000])[0] == ["en"]


def test_language_held_out(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.fit(d.where(~common.held_out()))
    got = language_id.predict(d, model).join(d.select("doc_id", "lang"), "doc_id").where(common.held_out()).select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert got > 0.95


def test_classifier_on_edges_and_held_out(spark, sf, edge):
    d, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality_classifier.fit(d, lab.where(~common.held_out()))
    got = quality_classifier.score(d, model).join(lab, "doc_id").where(common.held_out()).select("score", "quality").collect()
    assert np.mean([(r.score >= 0.7) == (r.quality == 1) for r in got]) > 0.9
    on = quality_classifier.score(edge.drop("score"), model).collect()
    assert len(on) == 9 and all(0 <= r.score <= 1 for r in on)
    assert quality_classifier.score(edge.limit(0), model).count() == 0
    empty = quality_classifier.fit(d, lab.limit(0))
    assert {r.score for r in quality_classifier.score(edge, empty).collect()} == {0.5}


def test_pooling_in_parts_equals_pooling_at_once():
    rng = np.random.default_rng(1)
    model = quality_classifier.train([rng.normal(size=(3, quality_classifier.WIDTH)).astype(np.float32) for _ in range(8)], np.array([0.0, 1.0] * 4), epochs=1, least_steps=3)
    text = LONG[:400_000]
    whole = model.scores([text, "abc"])
    old, quality_classifier._AT_ONCE = quality_classifier._AT_ONCE, 512 * 20
    try:
        assert np.allclose(model.scores([text, "abc"]), whole)
    finally:
        quality_classifier._AT_ONCE = old


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(2)
    v = np.floor(rng.normal(size=(900, 8)) * 20)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(2000 + i, v[0].tolist()) for i in range(150)]
    rows += [(3000, None), (3001, [1.0, None] * 4), (3002, [float("nan")] * 8), (3003, []), (3004, [1.0, 2.0]), (None, [1.0] * 8), (5, v[5].tolist())]
    df = spark.createDataFrame(rows, "id long, v array<double>").withColumn("score", F.lit("x"))
    vec = topk_search.vectors(df, "id", "v")
    got = topk_search.exact_top_k(vec, vec.where("id % 50 = 0"), 5, shard_rows=200)
    mine = {}
    for r in got.orderBy("query_id", "rank").collect():
        mine.setdefault(r.query_id, []).append((r.id, r.score))
    ok = [(i, np.array(x)) for i, x in rows[:1050]]
    for qid, qv in [(i, x) for i, x in ok if i % 50 == 0]:
        want = sorted(((-float(x @ qv), i) for i, x in ok if i != qid))[:5]
        assert mine[qid] == [(i, -s) for s, i in want]
    assert topk_search.exact_top_k(vec.limit(0), vec.limit(0), 5).count() == 0
    # two vectors under one id are two queries
    two = topk_search.vectors(spark.createDataFrame([(50, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [5.0, 1.0]), (2, [1.0, 6.0])], "id long, v array<double>"), "id", "v")
    got = topk_search.exact_top_k(two, two.where("id = 50"), 1).collect()
    assert sorted((r.id, r.score) for r in got) == [(1, 5.0), (2, 6.0)]


def test_chat_round_trip(spark):
    odd = ["", None, "<|im_end|>", "<\\|x", "a\n<|im_start|>assistant\nb", "é<\\\\|😀", "\\n", "x" * 100_000]
    rows = [(c, t, r, x) for c in (1, None) for t, x in enumerate(odd) for r in ("user", "assistant")] + [(2, None, None, "hi"), (2, 0, "tool\n|", "x"), (2, 0, "tool\n|", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    turns = chat_format.format_turns(df).collect()
    assert len(turns) == len(rows)
    said = sorted((r.conv_id is None, r.turn is None, r.turn or 0, *chat_format.parse_turn(r.formatted)) for r in turns)
    assert said == sorted((c is None, t is None, t or 0, r or "", x or "") for c, t, r, x in rows)
    for r in turns:
        assert r.formatted.count("<|im_start|>") == 1 and r.formatted.count("<|im_end|>") == 1
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_turns(df)).collect()}
    assert set(got) == {1, 2, None} and got[1].n_turns == 16 and got[2].n_turns == 3
    loss = "".join(x or "" for x in odd)
    assert got[1].loss_chars == len(loss) and got[1].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat_format.read_back(chat_format.format_turns(df.limit(0))).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li>Menu</ul></nav><header>Top</header>
<div class="cookie-notice">We use cookies</div><article><h1>Big &amp; small&#33;</h1><p><b>One
 two<br>three<p>Four &lt;5&gt;</p><div class=share-box>Share me</div><ul><li>x<li>y</ul><script>var a="</p>";</script><form>Name</form>
<section id="comments"><p>First!</p></section></article><aside>Side</aside><footer>Foot</footer>"""


def test_html_blocks():
    text = lambda h: html_extract.main_text(html_extract.read_tree(h), set())
    assert text(PAGE) == "Big & small!\n\nOne two three\n\nFour <5>\n\nx\n\ny"
    assert text("") == "" and text("plain < text & more") == "plain < text & more"
    assert text('<p title="a>b">in</p><p>cut <a href="x') == "in\n\ncut"
    assert text("<article><p>a</p><!-- <p>b</p> --><p>c") == "a\n\nc"
    assert text("<main><p>m</p></main><article class='comment'><p>no</p></article>") == "m"


def test_site_templates_go(spark):
    pages = [(i, f"http://h{i % 2}.org/{i}", f"<body><div class=x><p>Same words</p></div><p>Own {i}</p></body>") for i in range(40)]
    pages += [(100, None, None), (101, "odd", ""), (102, "http://h0.org/a", f"<article><p>{'long ' * 50_000}</p></article>"), (5, "http://h1.org/5", pages[5][2])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_extract.extract(df).collect()
    assert len(got) == 44
    by = {r.page_id: r.text for r in got}
    assert by[3] == "Own 3" and by[100] == "" and by[101] == "" and len(by[102]) == 50_000 * 5 - 1
    assert html_extract.extract(df.limit(0)).count() == 0


def five_words(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} or {tuple(w)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_similar_documents_are_grouped(spark):
    """Pairs at a Jaccard similarity of 0.8 to 0.95 are found, pairs below never are."""
    rng = random.Random(11)
    vocabulary = [f"word{i}" for i in range(3000)]
    rows, near, far = [], [], []
    for n in range(300):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([60, 150, 350]))]
        copy = list(text)
        for at in rng.sample(range(len(text)), max(1, int(len(text) * rng.uniform(0.002, 0.04)))):
            copy[at] = "changed" + str(rng.random())
        similarity = jaccard(five_words(" ".join(text)), five_words(" ".join(copy)))
        (near if 0.8 <= similarity <= 0.95 else far if similarity < 0.8 else []).append((2 * n, 2 * n + 1))
        rows += [(2 * n, " ".join(text)), (2 * n + 1, " ".join(copy))]
    got = {r.key: r.group for r in simhash_dedup.similar_groups(spark.createDataFrame(rows, "key long, text string"), "key").collect()}
    found = sum(got[a] == got[b] for a, b in near)
    assert len(near) > 80 and len(far) > 20 and found >= 0.97 * len(near)
    assert not any(got[a] == got[b] for a, b in far)
    assert len({got[a] for a in range(0, 600, 2)}) == 300


def test_similar_documents_on_edges(spark, edge):
    rows = simhash_dedup.similar_groups(edge.withColumn("key", F.xxhash64("doc_id", "text")), "key").collect()
    assert len(rows) == 9 and len({r.group for r in rows}) == 5
    assert simhash_dedup.similar_groups(edge.limit(0).withColumn("key", F.lit(1).cast("long")), "key").count() == 0


def test_marks_do_not_drop_the_article():
    text = lambda h: html_extract.main_text(html_extract.read_tree(h), set())
    assert text('<body><div class="page with-sidebar"><article><p>Body</p></article></div></body>') == "Body"
    assert text('<div class="with-sidebar"><article><p>real</p></article><div id="comments"><article><p>said</p></article></div></div>') == "real"
    assert text('<div class="comments"><article><p>said</p></article></div><article><p>real</p></article>') == "real"
    assert text('<main><p>m</p></main><div class="related"><article><p>other</p></article></div>') == "m"


def test_site_templates_do_not_depend_on_host_size(spark):
    block = "<div class=x><p>Same words</p></div>"
    pages = [(i, f"http://big.org/{i}", f"<body>{block if i < 12 else ''}<p>Own {i}</p></body>") for i in range(600)]
    pages += [(1000 + i, f"http://small.org/{i}", f"<body>{block}<p>Own {i}</p></body>") for i in range(5)]
    pages += [(2000, "http://rep.org/0", "<body><p>Own</p></body>")] * 400
    pages += [(2001 + i, f"http://rep.org/{i + 1}", f"<body>{block}<p>Own {i}</p></body>") for i in range(10)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[3] == "Own 3" and got[1002] == "Own 2" and got[2003] == "Own 2"


def test_a_cluster_of_near_copies_is_one_group(spark):
    """Members of one crowded variant are linked through each other, with pairs in proportion to the members."""
    rng = random.Random(13)
    base = [f"word{rng.randrange(9999)}" for _ in range(240)]
    rows = []
    for i in range(600):
        copy = list(base)
        copy[rng.randrange(240)] = f"own{i}"
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame(rows, "key long, text string")
    sets = simhash_dedup._set_prints(df, "text", "key", ()).select("set_key", "prints")
    assert simhash_dedup._met(sets).count() <= 600 * simhash_dedup.TABLES * simhash_dedup.SYMBOLS * 2
    assert len({r.group for r in simhash_dedup.similar_groups(df, "key").collect()}) == 1


def test_loose_groups_come_together(spark):
    """Groups of 250 whose members differ from each other by up to a fifth: nearly all pairs at 0.8 and above share a group, and none too many."""
    rng = random.Random(29)
    rows = []
    for g, changes in enumerate(((1, 3), (2, 4), (3, 5))):
        base = [f"w{g}x{i}" for i in range(200)]
        for i in range(250):
            copy = list(base)
            for at in rng.sample(range(200), rng.randint(*changes)):
                copy[at] = f"own{rng.random()}"
            rows.append((g * 1000 + i, " ".join(copy)))
    got = {r.key: r.group for r in simhash_dedup.similar_groups(spark.createDataFrame(rows, "key long, text string"), "key").collect()}
    sets = {k: five_words(t) for k, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and a // 1000 == b // 1000 and jaccard(sets[a], sets[b]) >= 0.8]
    kept = sum(got[a] == got[b] for a, b in pairs)
    print("loose groups", len(pairs), kept / len(pairs), len(set(got.values())))
    assert kept >= 0.99 * len(pairs)
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a, b in pairs:
        root[find(a)] = find(b)
    true = len({find(k) for k in root})
    assert true <= len(set(got.values())) <= true + 0.08 * len(rows)  # pairs that barely reach 0.8 and have no other partner
    assert all(len({find(k) for k in sets if got[k] == g}) == 1 for g in set(got.values()))


def test_long_turns_take_bounded_memory(spark):
    """A turn of 50 MB, and turns that add up to 50 MB: a few copies of a slice at a time."""
    import tracemalloc

    import pyarrow as pa

    for texts in (["a" * 50_000_000], ["b" * 200_000] * 250):
        roles, contents = pa.array(["user"] * len(texts)), pa.array(texts)
        tracemalloc.start()
        size = 0
        for a, n in chat_format._slices(contents):
            made, _, _ = chat_format.assemble(roles.slice(a, n), contents.slice(a, n))
            size += sum(len(x.as_buffer()) for x in made)
            del made
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert size > 50_000_000 and peak < (120e6 if len(texts) == 1 else 30e6)


def test_mix_of_hot_and_null_ids(spark):
    """A third of the rows share an id, others have none, sources share their first letters: every row is placed once."""
    rows = [(5 if i % 3 == 0 else None if i % 7 == 0 else i, "w " * (i % 9), "en", f"http://site{i % 25}") for i in range(900)]
    got = source_mixing.mix(docs(spark, rows)).collect()
    assert len(got) == 900 and all(0 <= r.taken <= 2 * r.size for r in got)
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(by))}
    for s, rs in by.items():
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= 64 and rs[0].source_size == sum(r.size for r in rs)
    assert all((by[a][0].target / weights[a] - by[b][0].target / weights[b]) < 1e-6 or by[b][0].target == 2 * by[b][0].source_size for a in by for b in by)


def brute_groups(sets):
    """The smallest key that each key reaches over pairs at 0.8 and above."""
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in sets}


def as_partition(groups):
    by = {}
    for k, g in groups.items():
        by.setdefault(g, []).append(k)
    return sorted(sorted(v) for v in by.values())


@pytest.mark.parametrize("block", [2048, 20])
def test_similar_groups_are_those_of_all_pairs(spark, monkeypatch, block):
    """Loose copies, pairs at exactly 0.8 and at just less, a passage that many hold: the groups are those that all pairs make."""
    rng = random.Random(31)
    rows = []
    for g, changes in enumerate(((2, 4), (3, 5))):
        base = [f"w{g}x{i}" for i in range(200)]
        for i in range(120):
            copy = list(base)
            for at in rng.sample(range(200), rng.randint(*changes)):
                copy[at] = f"own{rng.random()}"
            rows.append((g * 1000 + i, " ".join(copy)))
    for i in range(60):  # of a + b shingles either shares 4 (a + b) / 9, or one less
        words = [f"p{i}y{k}" for k in range(49)]
        rows += [(5000 + 2 * i, " ".join(words[:-(5 if i % 2 else 4)])), (5001 + 2 * i, " ".join([*words[9 - 4:], *[f"q{i}y{k}" for k in range(i % 2)]]))]
    for i in range(12):  # 36 shingles of 45
        words = [f"z{i}y{k}" for k in range(49)]
        rows += [(6000 + 2 * i, " ".join(words)), (6001 + 2 * i, " ".join(words[:40]))]
    passage = " ".join(f"said{k}" for k in range(40))
    rows += [(7000 + i, passage + " " + " ".join(f"o{i}y{k}" for k in range(rng.randint(5, 60)))) for i in range(100)]
    rows += [(8000, ""), (8001, None), (8002, "one"), (8003, "one two"), (8004, "ONE two")]
    monkeypatch.setattr(simhash_dedup, "BLOCK", block)
    got = {r.key: r.group for r in simhash_dedup.similar_groups(spark.createDataFrame(rows, "key long, text string"), "key").collect()}
    want = brute_groups({k: five_words(t) for k, t in rows})
    assert len(set(want.values())) > 200 and as_partition(got) == as_partition(want)


def test_texts_that_share_a_passage_are_no_candidates(spark, monkeypatch):
    """Sets that have a passage and little else in common are told apart before their pairs are listed; copies among them are not."""
    rng = random.Random(37)
    rows = []
    for g in range(8):
        passage = [f"said{g}x{k}" for k in range(60)]
        rows += [(100 * g + i, " ".join(passage + [f"own{g}x{i}x{k}" for k in range(rng.randint(30, 50))])) for i in range(30)]
        rows.append((100 * g + 50, rows[-1][1].replace(" said", " Said ", 1) + " end"))
    listed, unmet = [], simhash_dedup._unmet
    monkeypatch.setattr(simhash_dedup, "_met", lambda sets: sets.limit(0).select(F.col("set_key").alias("a"), F.col("set_key").alias("b")))
    monkeypatch.setattr(simhash_dedup, "_unmet", lambda *given: listed.append(unmet(*given).cache()) or listed[-1])
    got = {r.key: r.group for r in simhash_dedup.similar_groups(spark.createDataFrame(rows, "key long, text string"), "key").collect()}
    assert as_partition(got) == as_partition(brute_groups({k: five_words(t) for k, t in rows}))
    assert len(set(got.values())) == 240 and listed[0].count() < 100


def test_parities_never_tell_more_apart_than_there_is():
    """Sets of all sizes, folded and cut short: the parities that differ are at most the hashes that only one set has, and few of strangers are missed."""
    import pyarrow as pa

    rng = np.random.default_rng(41)
    sets = [np.array([], np.uint64), np.array([5], np.uint64)]
    for n in (1, 60, 64, 65, 130, 700, 4000, 9000):
        base = rng.integers(0, 1 << 63, n, np.uint64)
        sets += [np.unique(base[:m]) for m in (n, n - n // 9, n - n // 5)] + [np.unique(rng.integers(0, 1 << 63, n, np.uint64))]
    held = pa.array([b"x" * 8] + [simhash_dedup._parities(s) for s in sets], pa.binary()).slice(1)
    a, b = (x.ravel() for x in np.indices((len(sets), len(sets))))
    least = simhash_dedup._least_apart(held, a, b)
    true = np.array([len(np.setxor1d(sets[x], sets[y])) for x, y in zip(a, b)])
    size = np.array([len(s) for s in sets])
    assert (least <= true).all() and (least[a == b] == 0).all()
    strangers = (true == size[a] + size[b]) & (size[a] == size[b]) & (size[a] >= 60) & (size[a] <= 4000)
    assert strangers.any() and (9 * least > size[a] + size[b])[strangers].all()
