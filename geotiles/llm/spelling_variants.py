"""Spelling variants: words one edit apart, by dynamic programming over sorted lists.

1. Words are counted with map-side combining; a word in every document is one row a task.
2. Lists: of two words one edit apart, the shorter of ``c`` code points, either the first or the last ``c // 2``
   code points are equal.  So a word goes to a list for each of these (as the shorter, and as the longer of its pair; for the last code points it is
   read backwards): four rows a word, and no pair is lost.  Lists are dealt by a hash and sorted inside their task.
3. Scan: a list is walked for each of its words.  The edit matrix is a band of three cells a row, and a row belongs to
   a prefix: neighbours of the sorted list share the rows of their common prefix (LCP), and a range whose prefix
   has no cell of one or less is skipped whole.  All words of a task's lists walk one column at a time in numpy.
4. A word keeps the number of its near words and the best of them; forms are followed to their roots by pointer
   jumping over written tables (counts grow fivefold along a chain, so a handful of rounds do).

A list holds the distinct words that share half of their letters and all but one of their length, so its size is bounded by spelling, not
by how often words occur; queries over it are taken in blocks of bounded size.

Defined results: null text has no words; a null id counts as an empty one where letters are dropped; texts of any length; repeated rows
count each; of near words with equal counts the smallest is the form; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, written

RUN = "([A-Za-zÀ-ÿ]+)"
MIN_LENGTH = 6
MIN_COUNT = 5
RATIO = 5
DROP_EVERY = 199
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ROWS, _QUERIES = 1 << 16, 1 << 13  # rows scanned together; words that walk at once


def lowered(col: Column) -> Column:
    """A-Z in lower case, other letters as they are (the plain function where it does the same, as it is faster)."""
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(F.translate(col, _UPPER, _LOWER))


def word_counts(docs: DataFrame, text: str = "text", id_col: str = "doc_id", min_length: int = MIN_LENGTH,
                min_count: int = MIN_COUNT, drop_every: int = DROP_EVERY) -> DataFrame:
    """(word, n): lower-cased runs, of which one in ``drop_every`` (document, run) has lost a letter."""
    runs = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(text_or_empty(F.col(f"`{text}`")), F.lit(RUN), F.lit(1))).alias("run"))
    runs = runs.where(F.length("run") >= min_length).select("id", lowered(F.col("run")).alias("run"))
    mark = runs.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    at = F.expr("cast(h % length(run) as int)")
    word = F.when(F.col("h") % drop_every == 0, F.concat(F.substring("run", F.lit(1), at), F.expr("substring(run, cast(h % length(run) as int) + 2)"))).otherwise(F.col("run"))
    return (mark.select(word.alias("word")).where(F.length("word") >= min_length)
            .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count))


def _lists(words: DataFrame, min_length: int) -> DataFrame:
    """(c, back, key, spelt, n), sorted: the lists of every word; ``spelt`` runs backwards where ``back``."""
    entry = lambda c, back, spelt: F.struct(
        F.expr(c).alias("c"), F.lit(back).alias("back"), F.expr(f"left({spelt}, ({c}) div 2)").alias("key"), F.expr(spelt).alias("spelt"))
    entries = F.array(*[entry(c, back, spelt) for c in ("length(word)", "length(word) - 1")
                        for back, spelt in ((False, "word"), (True, "reverse(word)"))])
    rows = words.select("n", F.explode(entries).alias("e")).where(F.col("e.c") >= min_length).select("e.*", "n")
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, F.xxhash64("c", "back", "key")).sortWithinPartitions("c", "back", "key", "spelt")


def _walk(letters: np.ndarray, length: np.ndarray, lcp: np.ndarray, queries: np.ndarray, low: np.ndarray, high: np.ndarray,
          depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(query row, row one edit away): queries walk their list's rows [low, high), whose first ``depth`` letters are equal.

    A state is a query, a range of rows with one prefix, and the row of the edit matrix for this prefix: the cells
    for the query's first d - 1, d and d + 1 letters, never counted above two.
    """
    q, a, b = queries, low, high
    below, on, above = (np.full(len(q), x, np.int8) for x in (1, 0, 1))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    two = np.int8(2)
    for d in range(depth, letters.shape[1] - 1):
        heads = np.append(np.flatnonzero(lcp <= d), len(lcp))  # where prefixes of d + 1 letters begin
        first, last = np.searchsorted(heads, a), np.searchsorted(heads, b)
        n = last - first
        state = np.repeat(np.arange(len(q)), n)
        at = np.arange(len(state)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        row, letter = heads[at], letters[heads[at], d]
        q_, below_, on_, above_ = q[state], below[state], on[state], above[state]
        over = letter == 0  # the row's word ends: its distance is the cell at the query's length
        cell = np.choose(np.clip(length[q_[over]] - d + 1, 0, 2), (below_[over], on_[over], above_[over]))
        hit = (cell == 1) & (np.abs(length[q_[over]] - d) <= 1)
        found.append((q_[over][hit], row[over][hit]))
        below_next = np.minimum(on_ + 1, below_ + (letters[q_, d - 1] != letter))
        on_next = np.minimum(np.minimum(above_ + 1, on_ + (letters[q_, d] != letter)), below_next + 1)
        above_next = np.minimum(above_ + (letters[q_, d + 1] != letter), on_next + 1)
        keep = ~over & (np.minimum(np.minimum(below_next, on_next), above_next) <= 1)
        q, a, b = q_[keep], row[keep], heads[at[keep] + 1]
        below, on, above = (np.minimum(x[keep], two).astype(np.int8) for x in (below_next, on_next, above_next))
        if not len(q):
            break
    return tuple(np.concatenate(x) for x in zip(*found))


def _near(c: int, back: np.ndarray, opens: np.ndarray, spelt: list[str], n: np.ndarray) -> pa.RecordBatch:
    """(word, n_near, form_n, form) of the rows of whole lists of one ``c``; ``opens`` are the lists' first rows."""
    width, half, rows = c + 3, c // 2, len(spelt)
    letters = np.frombuffer("".join([s.ljust(width, "\0") for s in spelt]).encode("utf-32-le"), np.uint32).reshape(rows, width)
    length = np.fromiter(map(len, spelt), np.int64, rows)
    differs = letters[1:] != letters[:-1]
    lcp = np.concatenate(([-1], differs.argmax(axis=1)))
    lcp[opens] = -1
    words = [s[::-1] if r else s for s, r in zip(spelt, back.tolist())]
    order = pc.rank(pa.array(words), tiebreaker="dense").to_numpy().astype(np.int64)
    starts = np.frombuffer("".join([w[:half] for w in words]).encode("utf-32-le"), np.uint32).reshape(rows, half)
    bounds = np.append(opens, rows)
    home = np.searchsorted(opens, np.arange(rows), side="right") - 1
    low, high = bounds[home], bounds[home + 1]
    count, best = np.zeros(rows, np.int64), np.full(rows, -1)
    for at in range(0, rows, _QUERIES):
        queries = np.arange(at, min(rows, at + _QUERIES))
        x, y = _walk(letters, length, lcp, queries, low[queries], high[queries], half)
        # two longer words belong to another list; read backwards, words with equal beginnings were met forwards
        own = (np.minimum(length[x], length[y]) == c) & ~(back[x] & (starts[x] == starts[y]).all(axis=1))
        x, y = x[own], y[own]
        count += np.bincount(x, minlength=rows)
        by = np.lexsort((order[y], -n[y], x))
        x, y = x[by], y[by]
        lead = np.flatnonzero(np.diff(x, prepend=-1))
        best[x[lead]] = y[lead]
    some = np.flatnonzero(count)
    names = pa.array(words)
    return pa.RecordBatch.from_arrays([names.take(pa.array(some)), pa.array(count[some]), pa.array(n[best[some]]),
                                       names.take(pa.array(best[some]))], ["word", "n_near", "form_n", "form"])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole lists out of sorted rows, a bounded number of rows at a time."""

    def scanned(table: pa.Table, opens: np.ndarray) -> Iterator[pa.RecordBatch]:
        cs = table.column("c").to_numpy()
        for part in np.split(np.arange(table.num_rows), np.flatnonzero(np.diff(cs)) + 1):
            if len(part):
                a, b = int(part[0]), int(part[-1]) + 1
                rows = table.slice(a, b - a)
                yield _near(int(cs[a]), rows.column("back").to_numpy(), opens[(opens >= a) & (opens < b)] - a,
                            rows.column("spelt").to_pylist(), rows.column("n").to_numpy())

    waiting, rows = [], 0
    for b in batches:
        waiting.append(b)
        rows += b.num_rows
        if rows >= _ROWS:
            table = pa.Table.from_batches(waiting).combine_chunks()
            opens = _opens(table)
            last = int(opens[-1])
            yield from scanned(table.slice(0, last), opens[:-1])
            waiting, rows = table.slice(last).to_batches(), table.num_rows - last
    if rows:
        table = pa.Table.from_batches(waiting).combine_chunks()
        yield from scanned(table, _opens(table))


def _opens(table: pa.Table) -> np.ndarray:
    """First rows of the lists."""
    new = np.zeros(table.num_rows - 1, bool)
    for c in ("c", "back", "key"):
        column = table.column(c)
        new |= pc.not_equal(column.slice(1), column.slice(0, table.num_rows - 1)).to_numpy()
    return np.concatenate(([0], np.flatnonzero(new) + 1))


def near_words(words: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(word, n_near, form_n, form) of the words of (word, n) that have a word one edit away; form is the commonest such word."""
    found = _lists(words, min_length).mapInArrow(_scan, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form"))).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", (-F.col("b.less")).alias("form_n"), F.col("b.form").alias("form"))


def _roots(links: DataFrame) -> DataFrame:
    """(word, root) of (word, form) links without cycles: every round doubles how far a word sees."""
    seen = written(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = seen.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(seen.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not step.where("moved").limit(1).count():
            return seen
        seen = step.drop("moved")


def variants(docs: DataFrame, text: str = "text", id_col: str = "doc_id", min_length: int = MIN_LENGTH,
             min_count: int = MIN_COUNT, ratio: int = RATIO, drop_every: int = DROP_EVERY) -> DataFrame:
    """(word, form, root, n, n_near, form_n): one row per word; a form occurs ``ratio`` times as often at least."""
    words = written(word_counts(docs, text, id_col, min_length, min_count, drop_every), "words")
    near = near_words(words, min_length)
    able = F.col("form_n") >= ratio * F.col("n")
    judged = written(words.join(near, "word", "left").select(
        "word", F.when(able, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(able, F.col("form_n")).alias("form_n")), "judged")
    roots = _roots(judged.where("form IS NOT NULL"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
