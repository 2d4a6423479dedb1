"""Quality rules: a bitmask ledger, JVM only.

Every rule is evaluated once per document.  The ledger stores the measurements
and one BIGINT whose bit *i* says that rule *i* failed.  A policy is a named,
versioned mask: a document is rejected if ``failed & mask`` is not zero, so any
number of policies and ablations are bit operations over the stored ledger and
the texts are never read again.

Defined results: null text counts as empty (no words); nulls in other columns
pass through; texts of any length are measured exactly, in memory of a small multiple
of the text; there are no ties to break; repeated rows are judged one by one; an empty table gives an empty
ledger; extra columns are kept, and a column whose name clashes with a ledger
column is replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, text_or_empty

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "n_lines", "n_upper", "n_bangs")

#: Bits of a window's hash that are looked at; a position takes the bits it needs out of the 64.
_HASH_BITS = 64


def _repeats(df: DataFrame) -> DataFrame:
    """Adds ``_rep``: positions of the three-word windows of ``_w`` that stand twice or more, sorted; exact at any length.

    Windows become BIGINTs, hash above and position below, so that one primitive
    sort brings equal hashes together; the position has as many bits as the number of
    words has.  ``_t`` holds the windows that share their hash with a neighbour.  Where
    neighbours of one hash hold the same words all of that hash do; where any two
    differ, the windows of that text are sorted as texts instead.
    """
    w, t, mask = F.col("_w"), F.col("_t"), F.col("_mask")
    starts = F.sequence(F.lit(0), F.size(w) - 3)
    some = F.size(w) >= 3
    window = lambda i: F.call_function(
        "shiftleft", F.xxhash64(w[i], w[i + 1], w[i + 2]).bitwiseAND(F.lit((1 << _HASH_BITS) - 1 if _HASH_BITS < 63 else -1)),
        F.col("_bits")).bitwiseOR(i.cast("long"))
    at = lambda x: x.bitwiseAND(mask).cast("int")
    alike = lambda x, y: F.coalesce(x.bitwiseXOR(y).between(F.lit(0), mask), F.lit(False))
    same = lambda i, j: (w[i] == w[j]) & (w[i + 1] == w[j + 1]) & (w[i + 2] == w[j + 2])
    df = df.withColumn("_bits", F.length(F.bin(F.size(w).cast("long")))).withColumn(
        "_mask", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bits")) - 1)
    s = F.col("_s")
    df = df.withColumn("_s", F.when(some, F.sort_array(F.transform(starts, window))))
    df = df.withColumn("_t", F.filter(s, lambda x, k: alike(F.get(s, k - 1), x) | alike(F.get(s, k + 1), x)))
    differ = F.filter(t, lambda x, k: alike(F.get(t, k - 1), x) & ~F.coalesce(same(at(F.get(t, k - 1)), at(x)), F.lit(True)))
    said = F.sort_array(F.transform(starts, lambda i: F.struct(
        F.concat_ws(" ", w[i], w[i + 1], w[i + 2]).alias("g"), i.alias("i"))))
    df = df.withColumn("_g", F.when(F.size(differ) > 0, said))
    g = F.col("_g")
    twin = lambda k, x: F.coalesce(F.get(g, k)["g"] == x["g"], F.lit(False))
    slow = F.transform(F.filter(g, lambda x, k: twin(k - 1, x) | twin(k + 1, x)), lambda x: x["i"])
    return df.withColumn("_rep", F.sort_array(F.when(g.isNotNull(), slow).otherwise(F.transform(t, at))))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds MEASURES; one pass, no shuffle, array functions only."""
    t = text_or_empty(text)
    base = docs.drop(*MEASURES)
    given = {f"_given{k}": c for k, c in enumerate(base.columns)}  # so that no column of the input can clash
    named = base.select(*[F.col(f"`{c}`").alias(g) for g, c in given.items()], t.alias("_text"))
    t = F.col("_text")
    df = _repeats(named.withColumn("_w", F.filter(F.split(t, GAP), lambda w: w != "")))
    w = F.col("_w")
    # each repeated window covers its three words; words it shares with the previous one count once
    rep = F.col("_rep")
    cover = F.aggregate(
        F.transform(rep, lambda p, k: F.least(p - F.coalesce(F.get(rep, k - 1), F.lit(-3)), F.lit(3))),
        F.lit(0), lambda a, n: a + n)
    df = df.withColumn("_lines", F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    measures = F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(cover, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count(t, F.lit("!!")).cast("long").alias("n_bangs"),
    )
    # one row out of one: filters on the measures stay above this, so nothing is measured twice
    kept = df.select(*given, F.explode(F.array(measures)).alias("_m"))
    return kept.select(*[F.col(g).alias(c) for g, c in given.items()], "_m.*")


@dataclass(frozen=True)
class Rule:
    """``fails`` is a boolean Column over MEASURES; ``bit`` never changes once published."""

    bit: int
    name: str
    fails: Column


def default_rules() -> list[Rule]:
    n, chars = F.col("n_words"), F.col("word_chars")
    return [
        Rule(0, "few_words", n < 50),
        Rule(1, "repeated_windows", 100 * F.col("n_repeat_words") > 50 * n),
        Rule(2, "symbol_heavy", 100 * F.col("n_symbols") > 5 * chars),
        Rule(3, "shouting", 100 * F.col("n_upper") > 40 * chars),
        Rule(4, "exclaiming", 100 * F.col("n_bangs") > 10 * n),
        Rule(5, "odd_word_length", (chars > 30 * n) | (chars < 2 * n)),
        Rule(6, "duplicate_lines", 2 * F.col("n_dup_lines") > F.col("n_lines")),
    ]


#: Versioned policies by name: the bits that reject.
POLICIES = {
    "base.v1": (0, 1),
    "strict.v1": (0, 1, 2, 3, 4),
    "strict.v2": (0, 1, 2, 3, 4, 5, 6),
    "strict.v3": (1, 2, 3, 4, 5, 6),  # a short document is no bad one
}


def mask_of(policy: str) -> int:
    return sum(1 << b for b in POLICIES[policy])


def rule_ledger(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """Every row of ``docs`` with MEASURES and ``failed`` (bitmask BIGINT)."""
    bits = [F.when(F.coalesce(r.fails, F.lit(False)), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long")
            for r in (rules or default_rules())]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return measured(docs, text).withColumn("failed", mask)


def passes(policy: str, failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(mask_of(policy)).cast("long")) == 0


def ablations(ledger: DataFrame, policies: list[str] | None = None,
              rules: list[Rule] | None = None) -> DataFrame:
    """(policy, rule, n_failed, n_only): documents a rule rejects, and those no other rule of the policy does.

    One pass: per distinct bitmask (at most 2^rules, bounded) a count, then bit tests.
    """
    counts = ledger.groupBy("failed").agg(F.count("*").alias("n"))
    cells = F.array(*[
        F.struct(F.lit(p).alias("policy"), F.lit(r.name).alias("rule"),
                 F.lit(1 << r.bit).cast("long").alias("bit"), F.lit(mask_of(p)).cast("long").alias("mask"))
        for p in (policies or list(POLICIES)) for r in (rules or default_rules()) if r.bit in POLICIES[p]])
    hit = F.col("failed").bitwiseAND(F.col("c.bit")) != 0
    alone = F.col("failed").bitwiseAND(F.col("c.mask")) == F.col("c.bit")
    return (counts.select("failed", "n", F.explode(cells).alias("c"))
            .groupBy(F.col("c.policy").alias("policy"), F.col("c.rule").alias("rule"))
            .agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
                 F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("n_only")))
