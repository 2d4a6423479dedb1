"""Line dedup by a log-template tree.

A line is parsed to a leaf of a fixed-depth tree: its token count, then its
``leading`` tokens, where a token with a digit counts as variable.  Each token below the leading
ones is a field.  A field value held by ``min_docs`` lines of its leaf (equal lines of a
document are one) is constant, any other one variable: a line's template is its leaf with the
constant fields and ``<*>`` for the others, and it counts only if at least ``similarity``
percent of its fields are constant (the leading tokens count as one).  How many documents make a
template recur depends on what it generalises:

- with variable fields, or wholly constant: ``min_docs``;
- wholly constant and of more than ``long_tokens`` tokens: ``long_docs`` (chance does not repeat such a line), if not all
  of them have the same text; where such lines are two at least and more than half of a document's tokens, the document
  is a copy of others rather than one that quotes them, and keeps them: that is for document dedup to decide;
- fewer than ``leading`` tokens: such a line is a leaf of its own, and ``short_docs`` documents make it recur.

A recurring template is dropped everywhere but in the first of its documents (smallest
id, then smallest key), so no content is lost with it.

Spark does the work on distinct lines: equal lines are counted first, with map-side combining, so
a line in a third of all documents is one row from there on.  Only leaves of several
distinct lines and ``min_docs`` documents have their tokens counted.  Lines, documents and templates are named
by hashes of 128 bits; fields are compared as tokens.  Joins are equi joins between written tables, which
skew handling may split; no leaf is ever gathered.

Defined results: null text has no lines and stays null; lines without a token are
always kept; lines end at \\n only and may be of any length; repeated rows
(same id and text) share one key and so one verdict; null ids are allowed and come last; an empty
table gives an empty result; extra columns stay, whatever their names, but n_lines and n_dropped are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import content_key, fresh, written

_DIGIT = re.compile(rb"[0-9]")


@dataclass(frozen=True)
class TreeSpec:
    leading: int = 3  # tokens that select a leaf
    similarity: int = 60  # percent of fields that must be constant
    min_docs: int = 5
    long_tokens: int = 50
    long_docs: int = 2
    short_docs: int = 10


def _tokens(line: bytes) -> list[bytes]:
    """Tokens between the six ASCII gaps; those with a digit are masked."""
    if _DIGIT.search(line):
        return [b"<*>" if _DIGIT.search(w) else w for w in line.split()]
    return line.split()


def _leaf(w: list[bytes], spec: TreeSpec) -> int:
    return xxhash.xxh64_intdigest(b" ".join([b"%d" % len(w), *w[:spec.leading]])) - (1 << 63)


def parsed(docs: DataFrame, spec: TreeSpec, text: str, id_col: str) -> DataFrame:
    """(key, id, same, line_no, n, leaf, line): one row per line with a token; ``line`` is the hash of its tokens, ``same`` that of the text."""
    base = docs.select(content_key(id_col, text).alias("key"), F.col(f"`{id_col}`").alias("id"),
                       F.col(f"`{text}`").cast("binary").alias("text"))
    schema = f"key binary, id {docs.schema[id_col].dataType.simpleString()}, same long, line_no int, n int, leaf long, line binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, same, number, size, leaf, line = [], [], [], [], [], []
            for k, t in enumerate(b.column(2)):
                whole = t.as_py() or b""
                mark = xxhash.xxh3_64_intdigest(whole) - (1 << 63)
                for i, said in enumerate(whole.split(b"\n")):
                    if w := _tokens(said):
                        row.append(k)
                        same.append(mark)
                        number.append(i)
                        size.append(len(w))
                        leaf.append(_leaf(w, spec))
                        line.append(xxhash.xxh3_128_digest(b" ".join(w)))
            at = pa.array(np.array(row, np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), pa.array(same, pa.int64()), pa.array(number, pa.int32()), pa.array(size, pa.int32()),
                 pa.array(leaf, pa.int64()), pa.array(line, pa.binary())], ["key", "id", "same", "line_no", "n", "leaf", "line"])

    return base.mapInArrow(run, schema)


def _texts(docs: DataFrame, spec: TreeSpec, text: str) -> DataFrame:
    """(leaf, line, said): the masked tokens of every line with a field."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf, line, said = [], [], []
            for t in b.column(0):
                for raw in (t.as_py() or b"").split(b"\n"):
                    w = _tokens(raw)
                    if len(w) > spec.leading:
                        whole = b" ".join(w)
                        leaf.append(_leaf(w, spec))
                        line.append(xxhash.xxh3_128_digest(whole))
                        said.append(whole)
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), pa.array(line, pa.binary()),
                                              pa.array(said, pa.binary()).cast(pa.string())], ["leaf", "line", "said"])

    return docs.select(F.col(f"`{text}`").cast("binary").alias("text")).mapInArrow(run, "leaf long, line binary, said string")


def _first() -> F.Column:
    """The document a template stays in."""
    return F.min(F.struct(F.col("id").isNull().alias("z"), "id", "key")).alias("first")


def _generalised(docs: DataFrame, counts: DataFrame, spec: TreeSpec, text: str) -> DataFrame:
    """(line, leaf, a, b): lines whose template has variable fields; (leaf, a, b) names the template."""
    leaves = written(counts.where(F.col("n") > spec.leading).groupBy("leaf").agg(
        F.count("*").alias("lines"), F.sum("n_docs").alias("docs")).where(
        (F.col("lines") > 1) & (F.col("docs") >= spec.min_docs)).select("leaf"), "leaves")
    said = _texts(docs, spec, text).join(leaves, "leaf", "left_semi").groupBy("line", "leaf").agg(F.min("said").alias("said"))
    known = written(said.join(counts.select("line", "n_docs"), "line"), "lines-in-leaves")
    tokens = F.split("said", " ")
    cells = known.select("line", "leaf", "n_docs", F.posexplode(
        F.slice(tokens, spec.leading + 1, F.size(tokens))).alias("pos", "value"))
    constant = written(cells.groupBy("leaf", "pos", "value").agg(F.sum("n_docs").alias("n")).where(
        F.col("n") >= spec.min_docs).drop("n"), "fields").withColumn("constant", F.lit(True))
    seen = cells.drop("n_docs").join(constant, ["leaf", "pos", "value"], "left")
    part = lambda *salt: F.bit_xor(F.when(F.col("constant"), F.xxhash64(*salt, "pos", "value")).otherwise(0))
    shape = seen.groupBy("line", "leaf").agg(part().alias("a"), part(F.lit(1)).alias("b"), F.count("*").alias("fields"),
                                             F.count("constant").alias("fixed"))
    return shape.where((F.col("fixed") < F.col("fields")) & (100 * (F.col("fixed") + 1) >= spec.similarity * (F.col("fields") + 1))
                       ).select("line", "leaf", "a", "b")


def recurring(docs: DataFrame, spec: TreeSpec = TreeSpec(), text: str = "text",
              id_col: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, constant templates, generalised ones).

    lines: (key, id, same, line_no, n, leaf, line); constant: (line, n_docs, first, quoted), quoted if few documents hold the line;
    generalised: (key, id, line_no, leaf, a, b, n_docs, first), one row per line of such a template.
    """
    lines = written(parsed(docs, spec, text, id_col), "lines")
    counts = written(lines.select("line", "key", "id", "same", "n", "leaf").distinct().groupBy("line", "n", "leaf").agg(
        F.count("*").alias("n_docs"), (F.min("same") != F.max("same")).alias("apart"), _first()), "line-counts")
    enough = F.when(F.col("n") > spec.long_tokens, spec.long_docs).when(F.col("n") < spec.leading, spec.short_docs).otherwise(spec.min_docs)
    quoted = (F.col("n") > spec.long_tokens) & (F.col("n_docs") < spec.min_docs)
    constant = counts.where((F.col("n_docs") >= enough) & (~quoted | F.col("apart"))).select("line", "n_docs", "first", quoted.alias("quoted"))
    shapes = written(_generalised(docs, counts, spec, text), "shapes")
    made = written(lines.select("line", "key", "id", "line_no").join(shapes, "line").drop("line"), "made")
    found = written(made.select("leaf", "a", "b", "key", "id").distinct().groupBy("leaf", "a", "b").agg(
        F.count("*").alias("n_docs"), _first()).where(F.col("n_docs") >= spec.min_docs), "templates")
    return lines, constant, made.join(found, ["leaf", "a", "b"])


def drop_recurring_lines(docs: DataFrame, spec: TreeSpec = TreeSpec(), text: str = "text",
                         id_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``text`` rid of recurring templates, plus n_lines and n_dropped.

    Dropped line numbers are gathered by document and written; the texts are shuffled
    to meet them only where that list is too large to be broadcast.
    """
    lines, constant, generalised = recurring(docs, spec, text, id_col)
    elsewhere = F.col("key") != F.col("first.key")
    found = (lines.select("line", "key", "line_no", "n").join(written(constant, "constant"), "line").where(elsewhere)
             .select("key", "line_no", "n", "quoted")
             .unionByName(generalised.where(elsewhere).select("key", "line_no", F.lit(0).alias("n"), F.lit(False).alias("quoted"))))
    base = docs.drop("n_lines", "n_dropped")
    key, list_ = fresh(base, "key"), fresh(base, "gone")
    pick = lambda q: F.collect_set(F.when(F.col("quoted") == q, F.col("line_no")))
    lists = written(found.groupBy("key").agg(pick(False).alias("plain"), pick(True).alias("said"), F.sum(F.when(
        F.col("quoted"), F.col("n")).otherwise(0)).alias("n_said")), "found")
    tokens = lines.groupBy("key").agg(F.sum("n").alias("n_all"))
    copied = (F.size("said") > 1) & (2 * F.col("n_said") > F.col("n_all"))
    every = F.when(copied, F.col("plain")).otherwise(F.array_union("plain", "said"))
    gone = written(lists.join(tokens, "key").select(F.col("key").alias(key), F.sort_array(every).alias(list_)).where(F.size(list_) > 0), "gone")
    parts = F.split(F.col(f"`{text}`"), "\n")
    joined = base.withColumn(key, content_key(id_col, text)).join(gone, key, "left")
    kept = F.filter(parts, lambda _, i: ~F.array_contains(F.col(list_), i))
    new = F.when(F.col(list_).isNull(), F.col(f"`{text}`")).otherwise(F.array_join(kept, "\n"))
    return joined.select(
        *[(new.alias(text) if c == text else F.col(f"`{c}`")) for c in base.columns],
        F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(list_), F.lit(0)).cast("long").alias("n_dropped"))
