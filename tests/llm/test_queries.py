"""The registered text queries against their SQL, and the pipeline stage by stage."""

import hashlib
import os
from collections import Counter

import duckdb
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from geotiles.llm import line_dedup, quality_rules, source_mixing
from geotiles.llm.oracles import ORACLES
from geotiles.llm.queries import QUERIES, model_path

from .test_operators import brute_lines, five_words, jaccard, plain_fingerprint, words


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f[:-8]} as select * from '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = db.execute(ORACLES[name])
    names = [c[0] for c in got.description]
    key = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    want = sorted(tuple(key(r[names.index(c)]) for c in cols) for r in got.fetchall())
    assert sorted(tuple(key(r[c]) for c in cols) for r in df.collect()) == want


def test_chat_sql_escapes_roles(spark, tmp_path):
    """The SQL and the query agree on roles that hold control strings."""
    from geotiles.llm import chat_format

    rows = [(1, 0, "us<|er", "a"), (1, 1, "assistant", "b <\\| c"), (2, 0, None, None), (2, 0, "<\\|x", "<|im_end|>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    path = str(tmp_path / "conversations.parquet")
    df.write.parquet(path)
    got = duckdb.connect()
    got.execute(f"create view conversations as select * from '{path}/*.parquet'")
    cur = got.execute(ORACLES["op9_chat_format"])
    names = [c[0] for c in cur.description]
    want = {r[names.index("conv_id")]: r for r in cur.fetchall() if r[names.index("conv_id")] > 0}
    mine = {r.conv_id: tuple(r[n] for n in names) for r in chat_format.read_back(chat_format.format_turns(df)).collect()}
    assert mine == want


def test_near_duplicates_query(spark, sf, db):
    got = {r.doc_id: r for r in QUERIES["op7_simhash_dedup"](spark, sf).collect()}
    texts = dict(db.execute("select doc_id, text from documents").fetchall())
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    assert all(got[i].fingerprint == f"{fp:016x}" for i, fp in fps.items())
    label = {i: i for i in fps}
    for _ in range(len(fps)):
        new = {i: min(label[j] for j in fps if bin(fps[i] ^ fps[j]).count("1") <= 3) for i in fps}
        if new == label:
            break
        label = new
    assert {i: r.component_id for i, r in got.items()} == label


def test_tokens_query(spark, sf, db):
    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for i, t in db.execute("select doc_id, text from documents").fetchall():
        ids = sp.encode(t or "")
        want[i] = (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op3_sentencepiece"](spark, sf).collect()} == want


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
        docs = stage(spark, docs, sf).persist()
        out[name] = docs
    rows = {n: df.collect() for n, df in out.items()}
    base = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in quality_rules.rule_ledger(base).collect() if r.n_words and not r.failed & quality_rules.mask_of("strict.v3")}
    assert {r.doc_id for r in rows["quality_rules"]} == kept
    want = brute_lines([(r.doc_id, r.text) for r in rows["quality_rules"]], line_dedup.TreeSpec())
    assert {r.doc_id: r.text for r in rows["line_dedup"]} == {k[0]: t for k, t in want.items() if words(t)}
    sets = {r.doc_id: five_words(r.text) for r in rows["line_dedup"]}
    group = {i: i for i in sets}
    for _ in sets:
        near = {i: min(group[j] for j in sets if i == j or jaccard(sets[i], sets[j]) >= 0.8) for i in sets}
        if near == group:
            break
        group = near
    left = {r.doc_id for r in rows["simhash_dedup"]}
    assert left == {i for i, g in group.items() if i == g}
    mixed = rows["source_mixing"]
    assert {r.doc_id for r in mixed} <= left and max(sum(1 for r in mixed if r.doc_id == i) for i in {m.doc_id for m in mixed}) <= 2
    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in mixed:
        ids = sp.encode(r.text or "")
        want.append((r.doc_id, len(words(r.text)), len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))))
    assert sorted((r.doc_id, r.n_words, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows["sentencepiece"]) == sorted(want)
    # the mix: whole passes nearest to what the operator takes
    ledger = source_mixing.mix(out["simhash_dedup"]).collect()
    passes = {r.doc_id: int(r.taken / r.size + 0.5) if r.size else 0 for r in ledger}
    assert Counter(r.doc_id for r in mixed) == Counter({i: n for i, n in passes.items() if n})
    drift, target = {}, {r.source: r.target for r in ledger}
    for r in ledger:
        drift[r.source] = drift.get(r.source, 0) + passes[r.doc_id] * r.size
    # rounding moves a source by less than half a document at either end of its blocks
    assert all(abs(drift[s] - t) <= max(r.size for r in ledger if r.source == s) + 64 for s, t in target.items())


def test_token_stage_on_edges(spark, sf):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n", "en", "a", 2), (4, "word " * 40_000, "en", "a", 200_000), (4, "tie", "en", "a", 3), (None, "no id", None, "a", 5)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{sf}/documents.parquet").schema).withColumn("n_tokens", F.lit("clash"))
    got = dict(corpus_pipeline.STAGES)["sentencepiece"](spark, docs, sf).collect()
    assert sorted(r.n_words for r in got) == [0, 0, 0, 1, 2, 40_000] and all(len(r.ids_sha256) == 64 for r in got)


def test_repeated_rows_in_the_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(30)
    twice = docs.unionByName(docs).unionByName(docs.limit(1).select(*[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes]))
    for name, stage in corpus_pipeline.STAGES[:4]:
        twice = stage(spark, twice.withColumn("extra", F.lit(1)), sf)
        assert twice.columns == list(corpus_pipeline.COLUMNS)
        if name == "simhash_dedup":
            assert twice.count() == twice.select("doc_id").distinct().count()


def test_near_duplicate_stage_keeps_one_of_each_similar_pair(spark, sf, db):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sets = {i: five_words(t) for i, t in db.execute("select doc_id, text from documents").fetchall()}
    left = {r.doc_id for r in dict(corpus_pipeline.STAGES)["simhash_dedup"](spark, docs, sf).collect()}
    assert not any(a < b and jaccard(sets[a], sets[b]) >= 0.8 for a in left for b in left)
    assert all(any(a < b and jaccard(sets[a], sets[b]) >= 0.8 for a in sets) for b in set(sets) - left)
