"""Language identification: multinomial naive Bayes over hashed character n-grams.

Features are the 1-, 2- and 3-grams of code points after lower-casing, with every
non-letter read as one space.  Fitting counts features per label over a bounded
sample of labelled rows: tasks emit sparse partial counts that Spark sums, so the
driver receives at most labels x buckets cells.  The log-probability matrix
(buckets x labels, float32) is broadcast and holds at most ``CELLS`` cells: the more
labels, the fewer buckets.

Scoring takes the texts of an Arrow batch as the rows of a sparse matrix: feature ids one
after the other and where each row begins.  Its product with the matrix is a gather
of rows and one ``np.add.reduceat``.  Long texts are rows of ``PIECE`` first positions
each (their n-grams reach past the end of the piece, so none is lost), which are summed
per text in order; a text's score does not depend on the batch it comes in.

Defined results: null texts and texts without a letter are ``und`` with score 0;
null labels are not learnt from; without any labelled row every text is ``und``;
ties go to the label that comes first in code-point order; texts of any length are
scored whole, in bounded memory besides the text; repeated rows are
scored one by one (and learnt from once); null ids are rows like any other; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

UNKNOWN = "und"
#: Bound of the labelled sample a model is fitted on.
FIT_ROWS = 20_000
BUCKETS = 1 << 15
#: Bound of the broadcast matrix.
CELLS = 1 << 25
#: First positions of the n-grams of one sparse row.
PIECE = 1 << 16
_NGRAMS = 3
_AT_ONCE = 1 << 21  # matrix cells gathered at a time


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> lower-cased code point of a letter, else a space."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if unicodedata.category(ch)[0] == "L":
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def _points(text: str) -> np.ndarray:
    return _letters().take(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))


def _pieces(text: str) -> Iterator[np.ndarray]:
    """Stretches of PIECE code points, each with the few that its last n-grams reach into."""
    for a in range(0, len(text), PIECE):
        yield _points(text[a:a + PIECE + _NGRAMS - 1])


def _features(points: np.ndarray, owner: np.ndarray, first: np.ndarray, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n, (row, bucket) of the n-grams, row by row: ``owner`` names each code point's row, n-grams begin where ``first``.

    Single characters count only if they are letters.
    """
    h = np.zeros(len(points), np.uint64)
    wide = points.astype(np.uint64)
    for n in range(min(_NGRAMS, len(points))):
        h = h[:len(points) - n] * np.uint64(0x9E3779B97F4A7C15) + wide[n:] + np.uint64(n + 1)
        mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)
        keep = first & (points != 32) if n == 0 else first[:len(h)] & (owner[:len(h)] == owner[n:])
        keep = np.flatnonzero(keep)
        yield owner.take(keep), mixed.take(keep).astype(np.int64) % buckets


def _stacked(pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(points, owner, first) of several rows laid end to end."""
    size = np.array([len(p) for p in pieces])
    owner = np.repeat(np.arange(len(pieces)), size)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    return np.concatenate(pieces), owner, place < PIECE


@dataclass(frozen=True)
class Model:
    labels: tuple[str, ...]
    log_prob: np.ndarray  # float32 (buckets, labels)
    prior: np.ndarray  # float64 (labels)

    def scores(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Label and posterior of each text."""
        n, buckets = len(self.labels), len(self.log_prob)
        out, some = np.zeros((len(texts), n)), np.zeros(len(texts), bool)
        if not n:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        held: list[np.ndarray] = []
        who: list[int] = []

        def flush() -> None:
            points, owner, first = _stacked(held)
            part = np.zeros((len(held), n))
            some[np.array(who)[owner[points != 32]]] = True
            for row, ids in _features(points, owner, first, buckets):
                if len(row):
                    starts = np.flatnonzero(np.diff(row, prepend=-1))
                    sums = np.add.reduceat(self.log_prob.take(ids, axis=0), starts, axis=0, dtype=np.float64)
                    np.add.at(part, row[starts], sums)
            np.add.at(out, who, part)  # pieces in order
            held.clear()
            who.clear()

        room = max(1, _AT_ONCE // (_NGRAMS * n))
        for k, text in enumerate(texts):
            for piece in _pieces(text or ""):
                if held and sum(map(len, held)) + len(piece) > room:
                    flush()
                held.append(piece)
                who.append(k)
        if held:
            flush()
        out += self.prior
        best = out.argmax(axis=1)
        share = 1.0 / np.exp(out - out.max(axis=1, keepdims=True)).sum(axis=1)
        return ([self.labels[b] if s else UNKNOWN for b, s in zip(best, some)], np.where(some, share, 0.0))


def bounded_sample(rows: DataFrame, bound: int, *content: str) -> DataFrame:
    """Rows of distinct ``content``, chosen by its hash: all if they are ``bound`` or fewer, else fewer than ``bound``.

    Repeated rows are one, so neither a hot id nor null ids can exceed the bound.  The
    number chosen is binomial; four deviations below the bound are aimed at.
    """
    hashed = rows.withColumn("_h", F.xxhash64(*[F.col(f"`{c}`") for c in content]))
    n = hashed.select("_h").distinct().count()
    if n > bound:
        aim = max(1.0, bound - 4 * bound ** 0.5)
        hashed = hashed.where(F.pmod(F.xxhash64("_h"), F.lit(1 << 30)) < int((1 << 30) * aim / n))
    return hashed.dropDuplicates(["_h"]).drop("_h")


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id",
        fit_rows: int = FIT_ROWS, buckets: int = BUCKETS) -> Model:
    """A model from (text, label) rows; fewer than ``fit_rows`` distinct ones, chosen by hash."""
    rows = labelled.where(F.col(f"`{label}`").isNotNull() & F.col(f"`{text}`").isNotNull()).select(
        F.col(f"`{label}`").cast("string").alias("label"), F.col(f"`{text}`").alias("text"), F.col(f"`{key}`").alias("key"))
    rows = bounded_sample(rows, fit_rows, "key", "label", "text").select("label", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lab, txt in zip(b.column(0).to_pylist(), b.column(1)):
                mine = np.zeros(buckets, np.int64)
                for piece in _pieces(txt.as_py()):
                    for _, ids in _features(*_stacked([piece]), buckets):
                        mine += np.bincount(ids, minlength=buckets)
                found = np.flatnonzero(mine)
                yield pa.RecordBatch.from_arrays([  # the last row counts the text itself
                    pa.array([lab] * (len(found) + 1), pa.string()), pa.array(np.append(found, -1), pa.int64()),
                    pa.array(np.append(mine[found], 1), pa.int64())], ["label", "feature", "n"])

    cells = written(rows.mapInArrow(count, "label string, feature long, n long").groupBy("label", "feature").agg(
        F.sum("n").alias("n")), "features")
    size = buckets
    n_labels = cells.where("feature < 0").count()
    while size > 1 and size * n_labels > CELLS:
        size //= 2  # bucket numbers are hashes modulo a power of two, so they fold
    folded = cells.select("label", F.when(F.col("feature") < 0, -1).otherwise(F.col("feature") % size).alias("feature"), "n")
    got = folded.groupBy("label", "feature").agg(F.sum("n").alias("n")).toArrow()
    names = got.column("label").to_pylist()
    labels = tuple(sorted(set(names), key=lambda s: s.encode()))
    at = {lab: k for k, lab in enumerate(labels)}
    who = np.array([at[x] for x in names], np.int64)
    feature, n = got.column("feature").to_numpy(), got.column("n").to_numpy()
    grid, prior = np.zeros((size, len(labels))), np.zeros(len(labels))
    real = feature >= 0
    grid[feature[real], who[real]] = n[real]
    prior[who[~real]] = n[~real]
    smooth = grid + 0.5
    with np.errstate(divide="ignore"):
        return Model(labels, np.log(smooth / smooth.sum(axis=0)).astype(np.float32),
                     np.log(prior / max(1.0, prior.sum())))


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep, lang_pred, score) for every row, over its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text"))
    schema = T.StructType([*slim.schema.fields[:-1], T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 64):
                b = whole.slice(a, 64)
                labels, score = shared.value.scores(b.column(b.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[:-1], pa.array(labels, pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    return slim.mapInArrow(run, schema)
