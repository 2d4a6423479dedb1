"""Phrase collocation mining with an FM-index per shard over word ids.

1. Shards: every task turns the texts it reads into word ids, by language, and closes a shard after
   ``SHARD_WORDS`` words; no text is shuffled.  A shard is written as two Burrows-Wheeler transforms, of its ids and of its
   ids reversed, from suffixes sorted to ``LONGEST`` words (interval extension needs no more).
2. Pairs: intervals of single words are extended by one word to the right; the counts of a pair are summed across
   shards, and the pairs of at least ``min_count`` go back to the shards that have them.
3. Longer phrases: frequent pairs are extended right, left and right again, in bidirectional intervals (one in each
   transform, kept in step), as long as every pair inside is frequent.  Counts are summed across shards.  A phrase's left and right
   extensions are the phrases of one word more, and the largest of their counts decides whether it is dropped.
4. Scores: every cut of a candidate meets the counts of its two parts in equi joins; products are decimals of 38 digits.

All intervals of a level are extended at once in numpy: rows of one phrase are adjacent, a rank query is a binary
search among sorted (word, row) keys.  A shard's memory is bounded by its words; what is shuffled are shard-wise counts, so a phrase
in a third of all documents is one row a shard.  Words travel as 64-bit hashes of language and word; that no two words share
one is checked over the whole vocabulary.

Defined results: null text is empty, null lang is ``und``; texts of any length (shards close at the end
of a piece, and a piece is never cut); repeated rows count each; ties fall to the phrase; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

LONGEST = 5
#: Words of a shard; its index takes some 100 bytes a word while it is built.
SHARD_WORDS = 2_000_000
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_TO_STOP = bytes.maketrans(_BREAKS, b"." * len(_BREAKS))
_SLICE = 1 << 18  # rows of a batch sent back

_INDEX = ("shard long, lang string, n_ids long, words array<string>, ids array<long>, counts array<long>,"
          "left binary, right binary")


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words with a ``.`` where a piece ends; bytes.lower and split know exactly A-Z and the six gaps."""
    return text.lower().translate(_TO_STOP).replace(b".", b" . ").split()


def _ranks(first: np.ndarray, second: np.ndarray, shift: int) -> np.ndarray:
    """One sortable key per position t: (first[t], second[t + shift]), 0 past the end."""
    then = np.zeros(len(second), np.int64)
    then[:-shift] = second[shift:]
    return first.astype(np.int64) * (int(second.max()) + 1) + then


def transform(ids: np.ndarray) -> np.ndarray:
    """Burrows-Wheeler transform of ids (0 ends pieces, first and last are 0), suffixes sorted to five words."""
    dense = lambda keys: np.unique(keys, return_inverse=True)[1]
    two = dense(_ranks(ids, ids, 1))
    four = dense(_ranks(two, two, 2))
    return ids[np.argsort(_ranks(four, ids, 4), kind="stable") - 1]


class Index:
    """Bidirectional intervals over the transforms of a text and of its reverse."""

    def __init__(self, left: np.ndarray, right: np.ndarray, counts: np.ndarray):
        self.symbols = {"left": left, "right": right}
        self.n, self.v = len(left if left is not None else right), len(counts)
        self.counts, self.start = counts, np.cumsum(counts) - counts
        self._keys: dict[str, np.ndarray] = {}

    def words(self) -> tuple[np.ndarray, ...]:
        """(word, size, interval in the text's transform, interval in the reverse's) of all single words."""
        w = np.arange(1, self.v)
        return w, self.counts[1:], self.start[1:], self.start[1:]

    def _rank(self, side: str, word: np.ndarray, row: np.ndarray) -> np.ndarray:
        if side not in self._keys:
            self._keys[side] = np.sort(self.symbols[side].astype(np.int64) * self.n + np.arange(self.n))
        return np.searchsorted(self._keys[side], word * self.n + row)

    def extend(self, side: str, size: np.ndarray, lo: dict[str, np.ndarray], wanted=None, ranks: bool = True) -> tuple:
        """(phrase, word, size, lo) of every extension by one word to a side.

        ``lo["left"]`` are the interval starts where words are added to the left, ``lo["right"]`` those in the
        reverse's transform; both stay in step.  ``wanted(phrase, word)`` says which extensions to keep; without
        ``ranks`` they are counted only.
        """
        other = "left" if side == "right" else "right"
        begin = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(size)), size)
        rows = np.arange(len(owner)) - begin[owner] + lo[side][owner]
        key, n = np.unique(owner * self.v + self.symbols[side][rows], return_counts=True)
        phrase, word = key // self.v, key % self.v
        before = np.cumsum(n) - n - begin[phrase]  # rows of the phrase whose word is smaller
        keep = word > 0
        if wanted is not None:
            keep[keep] = wanted(phrase[keep], word[keep])
        phrase, word, n, before = phrase[keep], word[keep], n[keep], before[keep]
        if not ranks:
            return phrase, word, n, None
        return phrase, word, n, {side: self._rank(side, word, lo[side][phrase]), other: lo[other][phrase] + before}


def _packed(ids: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(ids, np.int32), codec="zstd", asbytes=True)


def _unpacked(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(column[0].as_buffer(), decompressed_size=4 * n, codec="zstd"), np.int32)


def _shards(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Index rows over (lang, text) batches."""
    schema = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("n_ids", pa.int64()), ("words", pa.list_(pa.string())),
                        ("ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("left", pa.binary()), ("right", pa.binary())])
    serial = count(TaskContext.get().partitionId() << 32)
    open_: dict[str, tuple[dict, list]] = {}
    filled: dict[str, int] = defaultdict(int)

    def close(lang: str) -> pa.RecordBatch:
        known, parts = open_.pop(lang)
        filled.pop(lang)
        seen = np.concatenate([np.zeros(1, np.int32), *parts])
        names = sorted(known, key=known.get)[1:]
        counts = np.bincount(seen, minlength=len(names) + 1)
        keys = np.array([xxhash.xxh64_intdigest(lang.encode() + b"\0" + w) for w in names], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array([v], t) for v, t in zip((next(serial), lang, len(seen), [w.decode() for w in names], keys, counts[1:],
                                               _packed(transform(seen)), _packed(transform(seen[::-1]))), schema.types)], schema=schema)

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
            found, at = tokens(text.as_buffer().to_pybytes()), 0
            found.append(b".")
            while at < len(found):
                end = found.index(b".", min(at + limit, len(found)) - 1) + 1
                if lang not in open_:
                    open_[lang] = (defaultdict(count().__next__, {}), [])
                    open_[lang][0][b"."]
                known, parts = open_[lang]
                parts.append(np.fromiter(map(known.__getitem__, found[at:end]), np.int32, end - at))
                filled[lang] += end - at
                at = end
                if filled[lang] >= limit:
                    yield close(lang)
        while sum(filled.values()) > 2 * limit:
            yield close(max(filled, key=filled.get))
    for lang in list(open_):
        yield close(lang)


def _shard_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, a, b, n): every pair of neighbouring words of a shard, from (shard, n_ids, ids, counts, right) rows."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            shard, ids, counts, right = _opened(row, "right")
            index = Index(None, right, counts)
            _, size, here, there = index.words()
            phrase, word, n, _ = index.extend("right", size, {"right": here, "left": there}, ranks=False)
            for at in range(0, len(n), _SLICE):
                part = slice(at, at + _SLICE)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n[part]), shard)), pa.array(ids[phrase[part]]),
                                                  pa.array(ids[word[part] - 1]), pa.array(n[part])], ["shard", "a", "b", "n"])


def _opened(row: pa.RecordBatch | pa.Table, *sides: str) -> tuple:
    """(shard, ids, counts with that of the piece ends before, transform of each side) of one index row."""
    take = lambda name: row.column(row.schema.get_field_index(name))
    n = take("n_ids")[0].as_py()
    ids, counts = take("ids")[0].values.to_numpy(), take("counts")[0].values.to_numpy()
    return (take("shard")[0].as_py(), ids, np.concatenate(([n - counts.sum()], counts)), *[_unpacked(take(side), n) for side in sides])


def _longer_phrases(row: pa.Table, pairs: pa.Table) -> pa.Table:
    """(w1..w5, n): the phrases of three to five words of a shard whose pairs are all frequent; w4 and w5 may be null."""
    names = [f"w{i}" for i in range(1, LONGEST + 1)]
    schema = pa.schema([(c, pa.int64()) for c in (*names, "n")])
    if not row.num_rows or not pairs.num_rows:
        return schema.empty_table()
    _, ids, counts, left, right = _opened(row, "left", "right")
    index = Index(left, right, counts)
    by_id = np.argsort(ids)
    local = lambda c: by_id[np.searchsorted(ids, pairs.column(c).to_numpy(), sorter=by_id)] + 1
    frequent = np.sort(local("a") * index.v + local("b"))

    def is_pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * index.v + b
        return frequent[np.minimum(np.searchsorted(frequent, key), len(frequent) - 1)] == key

    word, size, here, there = index.words()
    words, lo = word[:, None], {"left": here, "right": there}
    out = []
    for m, side in zip(range(2, LONGEST + 1), ("right", "right", "left", "right")):
        wanted = (lambda p, w: is_pair(words[p, -1], w)) if side == "right" else (lambda p, w: is_pair(w, words[p, 0]))
        phrase, added, size, lo = index.extend(side, size, lo, wanted)
        words = np.column_stack((words[phrase], added) if side == "right" else (added, words[phrase]))
        if m > 2 and len(size):
            said = [pa.array(ids[words[:, j] - 1]) if j < m else pa.nulls(len(size), pa.int64()) for j in range(LONGEST)]
            out.append(pa.Table.from_arrays([*said, pa.array(size)], schema=schema))
    return pa.concat_tables(out) if out else schema.empty_table()


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = 100,
                     shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame]:
    """(lang, words array, f) of all phrases of one to five words found ``min_count`` times at least, and (lang, n) of all words."""
    slim = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary").alias("text"))
    index = written(slim.mapInArrow(lambda batches: _shards(batches, shard_words), _INDEX), "fm-index")
    vocabulary = index.select("lang", F.explode(F.arrays_zip("ids", "words", "counts")).alias("e")).select(
        "lang", F.col("e.ids").alias("id"), F.col("e.words").alias("word"), F.col("e.counts").alias("n"))
    words = written(vocabulary.groupBy("lang", "id").agg(
        F.sum("n").alias("f"), F.min("word").alias("word"), F.max("word").alias("last")), "words")
    if words.where("word <> last").limit(1).count():
        raise ValueError("two words share a hash of 64 bits; choose another hash")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    pairs = index.select("shard", "n_ids", "ids", "counts", "right").mapInArrow(
        _shard_pairs, "shard long, a long, b long, n long")
    # a pair has one row a shard: nothing is left to combine, and its shards are needed again
    pairs = written(pairs.withColumn("f", F.sum("n").over(Window.partitionBy("a", "b"))).where(F.col("f") >= min_count), "pairs")
    two = pairs.groupBy("a", "b").agg(F.first("f").alias("f")).select(F.array("a", "b").alias("ids"), "f")
    columns = [f"w{i}" for i in range(1, LONGEST + 1)]
    longer = (index.select("shard", "n_ids", "ids", "counts", "left", "right").groupBy("shard")
              .cogroup(pairs.select("shard", "a", "b").groupBy("shard"))
              .applyInArrow(_longer_phrases, ", ".join(f"{c} long" for c in (*columns, "n"))))
    longer = (longer.groupBy(*columns).agg(F.sum("n").alias("f")).where(F.col("f") >= min_count)
              .select(F.filter(F.array(*columns), lambda x: x.isNotNull()).alias("ids"), "f"))
    coded = written(two.unionByName(longer), "coded")
    named = (coded.select("ids", "f", F.posexplode("ids").alias("at", "id"))
             .join(words.select("lang", "id", "word"), "id").groupBy("ids", "f", "lang")
             .agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("w"))
             .select("lang", F.col("w.word").alias("words"), "f"))
    one = words.where(F.col("f") >= min_count).select("lang", F.array("word").alias("words"), "f")
    return written(one.unionByName(named), "phrases"), written(totals, "totals")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = 100, top: int = 2000,
                 cover: int = 100, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best-scored phrases of two to five words.

    ``score`` is floor(1000 a n / (l r)) of the cut that scores least; a phrase goes where one that holds it has
    ``cover`` percent of its count at least.
    """
    phrases, totals = frequent_phrases(docs, text, lang, min_count, shard_words)
    said = lambda c: F.array_join(c, " ")
    counted = phrases.select("lang", said("words").alias("part"), "f")
    # counts of longer phrases fall with every word added, so the extensions by one word decide
    extended = (phrases.where(F.size("words") > 2)
                .select("lang", "f", F.explode(F.array(F.expr("slice(words, 1, size(words) - 1)"), F.expr("slice(words, 2, size(words) - 1)"))).alias("p"))
                .groupBy("lang", said("p").alias("phrase")).agg(F.max("f").alias("longer")))
    kept = (phrases.where(F.size("words") > 1).select("lang", "words", said("words").alias("phrase"), F.col("f").alias("a"))
            .join(extended, ["lang", "phrase"], "left")
            .where(F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("a"))))
    cuts = kept.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", said(F.expr("slice(words, 1, k)")).alias("first"), said(F.expr("slice(words, k + 1, size(words) - k)")).alias("rest"))
    part = lambda name, value: counted.select("lang", F.col("part").alias(name), F.col("f").alias(value))
    whole = lambda c: f"cast({c} as decimal(19, 0))"
    scored = (cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
              .join(totals, "lang")
              .withColumn("score", F.expr(f"(1000 * {whole('a')} * {whole('n')}) div ({whole('l')} * {whole('r')})")))
    least = (scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("c"))
             .select("lang", "phrase", "c.*"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return (least.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= top)
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
