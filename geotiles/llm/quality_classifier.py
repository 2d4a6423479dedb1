"""Quality classifier: gated-attention multiple-instance learning.

A document is a bag of passages, fixed stretches of its whole text.  Every passage
is encoded by what it says, its words hashed into ``BUCKETS`` counts, and by how: the distribution
of its character-class bigrams plus shares of repeated words and the like.  A small network turns that into a vector h.
Attention weights a = softmax(w . (tanh(V h) * sigmoid(U h))) over the passages of
a document, learnt from document labels alone, form the weighted passage
representation that is scored: sigmoid(c . sum(a h) + b).

Fitting uses a bounded sample of labelled rows, every passage of each: fewer than ``FIT_ROWS`` rows and about
``FIT_PASSAGES`` passages at most (rows are left out, never passages; documents of more than ``FIT_LONGEST`` passages
are not sampled).  Features are computed in tasks and only they come to the driver, ``WIDTH`` floats of 2 bytes a passage.
Scoring covers every passage of every text.

Defined results: null and empty texts are one empty passage and get the score the
model gives it; null labels and null ids are not learnt from; of several labels of an id the largest holds; without labels every score is
0.5; texts of any length are scored whole in bounded memory besides the text; ties cannot occur; repeated rows are scored one by one
(and learnt from once); an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .language_id import bounded_sample

FIT_ROWS = 6_000
FIT_PASSAGES = 60_000
FIT_LONGEST = 2_000
PASSAGE = 512  # code points
BUCKETS = 128
_CLASSES = 8
WIDTH = _CLASSES * _CLASSES + 4 + BUCKETS
_AT_ONCE = 1 << 20  # code points encoded together


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Code point -> 0 gap, 1 lower, 2 upper, 3 digit, 4 stop, 5 other punctuation, 6 sign, 7 other."""
    import unicodedata

    kind = {"Ll": 1, "Lo": 1, "Lm": 1, "Lu": 2, "Lt": 2, "Nd": 3, "Zs": 0}
    table = np.full(0x110000, 7, np.uint8)
    for c in range(0x30000):
        cat = unicodedata.category(chr(c))
        table[c] = kind.get(cat, 5 if cat[0] == "P" else 6 if cat[0] == "S" else 7)
    for c in " \t\n\r\v\f":
        table[ord(c)] = 0
    for c in ".,;:?":
        table[ord(c)] = 4
    for c in "#*$%&|<>!":
        table[ord(c)] = 6
    return table


def encode_passages(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Feature rows of consecutive passages: ``starts`` are their first code points, strictly rising from 0."""
    n, count = len(starts), len(points)
    size = np.diff(np.append(starts, count))
    owner = np.repeat(np.arange(n), size)
    cls = _classes()[points].astype(np.int64)
    pair = cls[:-1] * _CLASSES + cls[1:]
    inside = owner[:-1] == owner[1:]
    grams = np.bincount(owner[:-1][inside] * 64 + pair[inside], minlength=n * 64).reshape(n, 64).astype(np.float32)
    grams /= np.maximum(grams.sum(axis=1, keepdims=True), 1)
    # words: rolling hash of each word, and whether it equals the word before
    gap = cls == 0
    opens = np.zeros(count, bool)
    opens[starts] = True  # a word cut by a passage's end counts in both
    first = np.flatnonzero(~gap & (opens | np.concatenate(([True], gap[:-1]))))
    if len(first):
        mixed = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(31)
        step = np.arange(count) - np.repeat(np.concatenate(([0], first)), np.diff(np.concatenate(([0], first, [count]))))
        weighted = np.where(gap, np.uint64(0), mixed * (2 * step.astype(np.uint64) + np.uint64(1)))
        word = np.add.reduceat(weighted, first)
        who = owner[first]
        again = np.concatenate(([False], (word[1:] == word[:-1]) & (who[1:] == who[:-1])))
        words = np.bincount(who, minlength=n)
        stutter = np.bincount(who, again, minlength=n) / np.maximum(words, 1)
        order = np.lexsort((word, who))
        fresh = np.concatenate(([True], (word[order][1:] != word[order][:-1]) | (who[order][1:] != who[order][:-1])))
        distinct = np.bincount(who[order], fresh, minlength=n) / np.maximum(words, 1)
        bucket = ((word * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)).astype(np.int64) % BUCKETS
        said = np.bincount(who * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS).astype(np.float32)
        said /= np.sqrt(np.maximum(words, 1))[:, None]
    else:
        words, stutter, distinct, said = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros((n, BUCKETS), np.float32)
    rest = np.stack([stutter, distinct, np.minimum(size / PASSAGE, 1), np.minimum(words * 8 / PASSAGE, 2)], axis=1)
    return np.concatenate([grams * 4, rest.astype(np.float32), said], axis=1)


def passages(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text index of each passage, features), a bounded number of code points at a time."""
    held: list[tuple[int, np.ndarray]] = []
    total = 0

    def flush() -> tuple[np.ndarray, np.ndarray]:
        points = np.concatenate([p for _, p in held])
        at, starts, who = 0, [], []
        for k, p in held:
            mine = np.arange(0, len(p), PASSAGE)
            starts.append(at + mine)
            who.append(np.full(len(mine), k))
            at += len(p)
        return np.concatenate(who), encode_passages(points, np.concatenate(starts))

    for k, text in enumerate(texts):
        points = np.frombuffer((text or " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        for a in range(0, len(points), _AT_ONCE):
            held.append((k, points[a:a + _AT_ONCE]))
            total += len(held[-1][1])
            if total >= _AT_ONCE:
                yield flush()
                held, total = [], 0
    if held:
        yield flush()


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


@dataclass(frozen=True)
class Model:
    weights: dict[str, np.ndarray]

    def embed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(h, attention logit) of passages."""
        p = self.weights
        h = np.tanh(x @ p["E"] + p["e"])
        gate = np.tanh(h @ p["V"]) * _sigmoid(h @ p["U"])
        return h, gate @ p["w"]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Weighted passage representations are pooled with running sums, so texts may be of any length."""
        p, n = self.weights, len(texts)
        top, mass = np.full(n, -np.inf), np.zeros(n)
        pooled = np.zeros((n, p["e"].shape[0]))
        for who, x in passages(texts):
            h, logit = self.embed(x)
            new = top.copy()
            np.maximum.at(new, who, logit)
            scale = np.where(np.isfinite(top), np.exp(np.where(np.isfinite(top), top, 0) - np.where(np.isfinite(new), new, 0)), 0)
            top, mass, pooled = new, mass * scale, pooled * scale[:, None]
            a = np.exp(logit - top[who])
            mass += np.bincount(who, a, minlength=n)
            np.add.at(pooled, who, a[:, None] * h)
        z = pooled / np.maximum(mass, 1e-300)[:, None]
        return _sigmoid(z @ p["c"] + p["b"][0])


def train(bags: list[np.ndarray], labels: np.ndarray, hidden: int = 24, gates: int = 12,
          epochs: int = 12, least_steps: int = 1200, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Model:
    """Adam over whole bags; gradients of the gated attention written out.  Small samples get more epochs."""
    epochs = max(epochs, -(-least_steps * batch // len(bags)))
    rng = np.random.default_rng(seed)
    draw = lambda *s: rng.normal(0, s[0] ** -0.5, s)
    p = {"E": draw(WIDTH, hidden), "e": np.zeros(hidden), "V": draw(hidden, gates), "U": draw(hidden, gates),
         "w": draw(gates, 1)[:, 0], "c": draw(hidden, 1)[:, 0], "b": np.zeros(1)}
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    t = 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            pick = order[at:at + batch]
            x = np.concatenate([bags[k] for k in pick]).astype(np.float64)
            size = np.array([len(bags[k]) for k in pick])
            start, who = np.cumsum(size) - size, np.repeat(np.arange(len(pick)), size)
            y = labels[pick]
            h = np.tanh(x @ p["E"] + p["e"])
            tv, su = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
            logit = (tv * su) @ p["w"]
            a = np.exp(logit - np.maximum.reduceat(logit, start)[who])
            a /= np.add.reduceat(a, start)[who]
            z = np.add.reduceat(a[:, None] * h, start)
            miss = (_sigmoid(z @ p["c"] + p["b"][0]) - y) / len(pick)
            dz = miss[:, None] * p["c"]
            da = (h * dz[who]).sum(axis=1)
            dl = a * (da - np.add.reduceat(a * da, start)[who])
            dg = dl[:, None] * p["w"]
            dtv, dsu = dg * su * (1 - tv ** 2), dg * tv * su * (1 - su)
            dh = (a[:, None] * dz[who] + dtv @ p["V"].T + dsu @ p["U"].T) * (1 - h ** 2)
            grad = {"E": x.T @ dh, "e": dh.sum(axis=0), "V": h.T @ dtv, "U": h.T @ dsu, "w": (tv * su).T @ dl,
                    "c": z.T @ miss, "b": np.array([miss.sum()])}
            t += 1
            for k, g in grad.items():
                g = g + 1e-4 * p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)
    return Model({k: x.astype(np.float64) for k, x in p.items()})


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id",
        fit_rows: int = FIT_ROWS, fit_passages: int = FIT_PASSAGES) -> Model:
    """A model from the labelled documents: a sample of rows by hash, within both bounds."""
    known = labels.where(F.col(f"`{label}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("key")).agg(
        F.max(F.col(f"`{label}`")).cast("double").alias("y"))
    known = bounded_sample(known, fit_rows, "key")
    size = F.greatest(F.lit(1), F.ceil(F.length("text") / PASSAGE))
    met = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).join(
        F.broadcast(known), "key")  # fewer than fit_rows rows of two numbers
    met = written(met.withColumn("n", size).where(F.col("n") <= FIT_LONGEST), "labelled")
    rows = bounded_sample(met, fit_rows, "key", "text")
    total = rows.agg(F.sum("n")).first()[0] or 0
    if total > fit_passages:
        rows = rows.where(F.pmod(F.xxhash64("text", "key"), F.lit(1 << 30)) < int((1 << 30) * fit_passages / total))
    rows = rows.select("y", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for y, text_ in zip(b.column(0).to_pylist(), b.column(1)):
                x = np.concatenate([f for _, f in passages([text_.as_py()])])
                yield pa.RecordBatch.from_pydict({"y": pa.array([y], pa.float64()), "n": pa.array([len(x)], pa.int32()),
                                                  "x": pa.array([x.astype(np.float16).tobytes()], pa.binary())})

    got = rows.mapInArrow(features, "y double, n int, x binary").toArrow().to_pylist()
    got.sort(key=lambda r: (r["x"], r["y"]))  # whatever order tasks end in
    bags = [np.frombuffer(r["x"], np.float16).reshape(r["n"], WIDTH).astype(np.float32) for r in got]
    if not bags:
        return Model({"E": np.zeros((WIDTH, 1)), "e": np.zeros(1), "V": np.zeros((1, 1)), "U": np.zeros((1, 1)),
                      "w": np.zeros(1), "c": np.zeros(1), "b": np.zeros(1)})
    return train(bags, np.array([r["y"] for r in got]))


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep, score) for every row, over its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text"))
    schema = T.StructType([*slim.schema.fields[:-1], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 128):
                b = whole.slice(a, 128)
                got = shared.value.scores(b.column(b.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(got)], [*keep, "score"])

    return slim.mapInArrow(run, schema)
