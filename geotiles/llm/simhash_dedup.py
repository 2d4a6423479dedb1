"""SimHash near-duplicates by meet-in-the-middle ball hashing.

1. Fingerprints: per document the bitwise majority over XXH64 (seed 42) of its
   word shingles.  Documents with equal fingerprints collapse to one
   representative before anything else is shuffled.
2. Screening: with three differing bits at most, one 32-bit half differs in one
   bit at most.  Every fingerprint emits the variants of each half within half
   the radius (the half itself and its 32 one-bit flips).  A fingerprint whose
   variants all stay alone has no partner; the others go on.  (Halves one bit apart
   meet where one of them stands unflipped; a variant so held by two fingerprints
   shows in map-side combined minima and maxima.)
3. Balls: each remaining fingerprint emits its 64-bit variants: itself, the 64
   one-bit flips (inner) and the two-bit flips inside one half (outer).  Of
   three differing bits two always share a half, so any two fingerprints within
   radius three meet in a variant that is inner for at least one of them, and
   whoever meets an inner member is within 1 + 2 bits of it.  Linking all members
   of a variant to its smallest inner member therefore loses no link and adds
   none: edges grow with the members, never with their pairs.
4. Components: edges are confirmed by ``bit_count(a ^ b) <= 3`` and contracted by
   alternating large-star and small-star rounds, each written to the shared
   folder; the smallest doc_id of a component names it.

``similar_groups`` serves documents at an exact similarity instead of a radius: five-word shingle sets with
Jaccard >= 0.8.  Every pair at 0.8 ends in one group, and none below is linked:

1. Crowds: most copies are found by chance and cheaply.  A fingerprint is made of ``SYMBOLS`` symbols of
   ``SYMBOL_BITS`` bits, each taken from the least shingle hash in an order of its own; every fingerprint emits its
   variants with one symbol left out, and a document meets the first and the one before it in each variant, in one of two orders.
   Pairs met are checked on the whole sets and contracted.  This round need not be complete; it keeps the next one small.
2. The rest, exactly: in any order of shingles that all documents share, two sets at 0.8 have one in common among the first
   ``n // 5 + 1`` of each.  Shingles that many documents begin with are put last, as rare ones meet few (the order decides the work, not the result).
   Rows of shingles that several sets begin with are kept; in each, all pairs of different groups are compared by size, position and
   parities: of every bit that shingles hash to, whether an odd number of the set's did.  Each parity that differs is a shingle that only one
   of the two has; of those, sets at 0.8 have a ninth of both sizes at most.  Texts that share a passage stop there.
   A pair goes on if the beginnings share so many shingles that the sets can be at 0.8, and is checked on the whole sets.
   A crowded shingle is dealt out as blocks against blocks.  Only pairs of one group are left out, whose link changes nothing.

Defined results: null or wordless text has fingerprint zero and is linked like
any other; fewer than three words make one shingle; repeated rows fall into one
component; a component whose doc_ids are all null has a null id; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, written

SHINGLE_WORDS = 3
RADIUS = 3
SIMILAR_WORDS = 5
SIMILARITY = (4, 5)  # 0.8
TABLES = 5
SYMBOLS = 5
SYMBOL_BITS = 12
CROWD = 32  # documents beginning with a shingle from which on it is put last; a share of 1 / CROWD_SHARE on larger tables
CROWD_SHARE = 20_000
SENT = 2_000_000  # keys of texts that are sent to all tasks at most
BLOCK = 2048  # rows of a shingle that are compared with each other in one go
PARITIES = 4096  # bits of a set at most; sets of twice as many shingles and more are hardly told apart, which costs work and no pair
_STEP = 1 << 15  # shingles counted at a time, so that one very long text stays small


def _fingerprint(text: str | None, size: int) -> int:
    """Bitwise majority of the shingle hashes; bytes.lower/split know exactly A-Z and the six gaps."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    if len(words) < size:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest, n = xxhash.xxh64_digest, len(words) - size + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _STEP):
        to = min(n, at + _STEP)
        pairs = zip(starts[at:to].tolist(), ends[at + size - 1:to + size - 1].tolist())
        raw = b"".join([digest(joined[a:b], 42) for a, b in pairs])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id",
                 size: int = SHINGLE_WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, *keep, fp BIGINT): the unsigned fingerprint as a signed 64-bit value."""
    slim = docs.select(*[F.col(f"`{c}`") for c in (id_col, *keep)], F.col(f"`{text}`").alias("_text"))
    schema = T.StructType([*slim.schema.fields[:-1], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((_fingerprint(t.as_py(), size) for t in b.column(b.num_columns - 1)),
                              np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps)], [*b.schema.names[:-1], "fp"])

    return slim.mapInArrow(run, schema)


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _spread(df: DataFrame, col: str = "fp") -> DataFrame:
    """A few MB of fingerprints dealt to as many tasks as what they emit needs.

    Dealt by a hash of the column: by the column itself a distinct before it has dealt them
    already, and the planner would leave this out.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(col))


def _screened(fps: DataFrame) -> DataFrame:
    """Fingerprints that may have a partner: some half-variant of theirs is held by another one too."""
    flips = F.array(*[F.lit(f).cast("long") for f in (0, *(1 << i for i in range(32)))])
    halves = F.array(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)),
                     F.shiftrightunsigned("fp", 32).bitwiseOR(F.lit(1 << 32)))
    emitted = (_spread(fps).select("fp", F.explode(halves).alias("half"))
               .select("fp", F.posexplode(F.transform(flips, lambda x: F.col("half").bitwiseXOR(x))).alias("flip", "variant")))
    # two halves one bit apart meet where one of them stands unflipped
    shared = (emitted.groupBy("variant")
              .agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.min("flip").alias("flip"))
              .where("lo <> hi AND flip = 0"))
    # every member of a shared variant, without keeping a bucket together
    return emitted.select("variant", "fp").join(
        shared.select("variant").hint("merge"), "variant", "left_semi").select("fp").distinct()


def _edges(candidates: DataFrame) -> DataFrame:
    """(a, b) with a > b: each member of a variant with the variant's smallest inner member."""
    inner = [0, *(1 << i for i in range(64))]
    outer = [(1 << i) | (1 << j) for h in (0, 32) for i in range(h, h + 32) for j in range(i + 1, h + 32)]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    table = lambda vs: F.array(*[F.lit(signed(v)).cast("long") for v in vs])
    candidates = _spread(candidates)
    spread = lambda vs, kind: candidates.select(
        "fp", F.explode(table(vs)).alias("flip")).select(
        F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"), "fp", F.lit(kind).alias("inner"))
    emitted = spread(inner, True).unionByName(spread(outer, False))
    hubs = (emitted.groupBy("variant")
            .agg(F.min(F.when(F.col("inner"), F.col("fp"))).alias("hub"), F.min("fp").alias("lo"), F.max("fp").alias("hi"))
            .where("hub IS NOT NULL AND lo <> hi").select("variant", "hub"))
    # merged by hint: the planner takes what is emitted for as small as the file it comes from
    return (emitted.select("variant", "fp").join(hubs.hint("merge"), "variant").where("fp <> hub")
            .where(distance(F.col("fp"), F.col("hub")) <= RADIUS)
            .select(F.greatest("fp", "hub").alias("a"), F.least("fp", "hub").alias("b")).distinct())


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of an edge: root is the smallest node reachable.

    Large-star / small-star contraction: each round is two map-side combined
    minima and equi joins over the edges; it ends when a round changes nothing.  The
    minima are written, so that the joins meet two exchanges and the rows of a node
    with many neighbours can be dealt to several tasks.
    """
    def stamp(df: DataFrame) -> tuple:
        return df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()

    current = written(edges.select("a", "b"), name)
    mark = stamp(current)
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"{name}-least")
        # large star: neighbours above a node move to its minimum
        large = written(both.where("b > a").join(least, "a")
                        .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), f"{name}-large")
        # small star: a node and its lower neighbours move to their minimum
        low = written(large.groupBy("a").agg(F.min("b").alias("m")), f"{name}-low")
        moved = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = written(moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), name)
        for used in (current, least, large, low):
            discard(used)
        current = small
        last, mark = mark, stamp(current)
        if last == mark:
            break
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id",
                    size: int = SHINGLE_WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, *keep, fp, component_id): one row per input row."""
    prints = written(fingerprints(docs, text, id_col, size, keep), "fingerprints")
    reps = prints.groupBy("fp").agg(F.min(id_col).alias("rep"))
    candidates = written(_screened(prints.select("fp").distinct()), "candidates")
    roots = components(_edges(candidates), "near-links")
    classes = written(reps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "rep", F.coalesce("root", "fp").alias("root")), "classes")
    named = written(classes.groupBy("root").agg(F.min("rep").alias("component_id")), "named")
    members = written(classes.join(named, "root").select("fp", "component_id"), "members")
    return prints.join(members, "fp").select(id_col, *keep, "fp", "component_id")


def _shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words make one shingle, none an empty set."""
    words = text.encode().lower().split() if text else []
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)] if words else [], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[:len(words) - size + 1].tolist(), ends[size - 1:].tolist())
    return np.unique(np.fromiter((digest(joined[a:b], 42) for a, b in pairs), np.uint64, len(words) - size + 1))


def _orders(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets of n orders of 64-bit hashes."""
    draw = lambda name: np.array([xxhash.xxh64_intdigest(f"{name}{i}") for i in range(n)], np.uint64)
    return draw("factor") | np.uint64(1), draw("offset")


def _symbols(hashes: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """TABLES fingerprints of packed symbols: symbol j is a part of the least hash in order j."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        part = hashes[at:at + 2048, None] * factors + offsets
        np.minimum(least, part.min(axis=0), out=least)
    symbol = (least >> np.uint64(17) & np.uint64((1 << SYMBOL_BITS) - 1)).astype(np.int64).reshape(TABLES, SYMBOLS)
    return (symbol << SYMBOL_BITS * np.arange(SYMBOLS)).sum(axis=1)


def _parities(hashes: np.ndarray) -> bytes:
    """A bit for each shingle at least (a power of two, 64 to PARITIES), set where an odd number of hashes fall."""
    n = min(PARITIES, max(64, 1 << (len(hashes) - 1).bit_length()))
    odd = np.bincount((hashes & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _least_apart(parities: pa.BinaryArray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows a and b, shingles that only one set has, at least: the parities that differ, the longer ones folded onto the shorter."""
    at = np.frombuffer(parities.buffers()[1], np.int32)[parities.offset:parities.offset + len(parities) + 1] // 8
    words = np.frombuffer(parities.buffers()[2], np.uint64, int(at[-1]))
    length, out = np.diff(at), np.zeros(len(a), np.int64)
    shorter = np.minimum(length[a], length[b])

    def folded(rows: np.ndarray, n: int) -> np.ndarray:
        made = np.empty((len(rows), n), np.uint64)
        for m in np.unique(length[rows]):
            k = np.flatnonzero(length[rows] == m)
            whole = words[at[rows[k], None] + np.arange(m)]
            made[k] = np.bitwise_xor.reduce(whole.reshape(len(k), m // n, n), axis=1)
        return made

    for n in np.unique(shorter):
        k = np.flatnonzero(shorter == n)
        out[k] = np.bitwise_count(folded(a[k], n) ^ folded(b[k], n)).sum(axis=1, dtype=np.int64)
    return out


def _set_prints(docs: DataFrame, text: str, key: str, keep: tuple[str, ...]) -> DataFrame:
    """(key, *keep, set_key, prints, parities): rows of equal shingle sets share set_key (128 bits)."""
    slim = docs.select(*[F.col(f"`{c}`") for c in (key, *keep)], F.col(f"`{text}`").alias("_text"))
    schema = T.StructType([*slim.schema.fields[:-1], T.StructField("set_key", T.BinaryType()),
                           T.StructField("prints", T.ArrayType(T.LongType())), T.StructField("parities", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = _orders(TABLES * SYMBOLS)
        for b in batches:
            keys, prints, parities = [], [], []
            for t in b.column(b.num_columns - 1):
                hashes = _shingle_set(t.as_py(), SIMILAR_WORDS)
                keys.append(xxhash.xxh3_128_digest(hashes.tobytes(), 42))
                prints.append(_symbols(hashes, *orders))
                parities.append(_parities(hashes))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(keys, pa.binary()), pa.array(prints, pa.list_(pa.int64())),
                                              pa.array(parities, pa.binary())], schema.names)

    return slim.mapInArrow(run, schema)


def _variants(sets: DataFrame, *keep: str) -> DataFrame:
    """(variant, t, set_key, *keep): every fingerprint with each of its symbols left out."""
    low = lambda x, i: x.bitwiseAND(F.lit((1 << SYMBOL_BITS * i) - 1).cast("long"))
    without = lambda x, i: F.shiftleft(F.shiftright(x, SYMBOL_BITS * (i + 1)), SYMBOL_BITS * i).bitwiseOR(low(x, i))
    each = _spread(sets, "set_key").select("set_key", *keep, F.posexplode("prints").alias("t", "fp"))
    names = F.array(*[F.struct(F.lit(i).alias("i"), without(F.col("fp"), i).alias("rest")) for i in range(SYMBOLS)])
    tag = F.shiftleft((F.col("t") * SYMBOLS + F.col("e.i")).cast("long"), SYMBOL_BITS * (SYMBOLS - 1))
    return each.select("set_key", *keep, "t", F.explode(names).alias("e")).select(tag.bitwiseOR(F.col("e.rest")).alias("variant"), "t", "set_key", *keep)


def _met(sets: DataFrame) -> DataFrame:
    """(a, b) with a > b: each member of a variant with its first member and the one before it."""
    emitted = _variants(sets).select("variant", F.xxhash64(F.col("t") % 2, "set_key").alias("place"), "set_key")
    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = emitted.repartition(n, F.xxhash64("variant")).sortWithinPartitions("variant", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None  # the first row of the variant that goes on, and the last row
        for b in batches:
            if not b.num_rows:
                continue
            rows = pa.Table.from_batches([b.select(["variant", "set_key"])])
            skip = 0 if tail is None else tail.num_rows
            rows = pa.concat_tables([tail, rows]).combine_chunks() if skip else rows
            v, key = rows.column(0).to_numpy(), rows.column(1).combine_chunks()
            at = np.arange(skip, len(v))
            opens = np.ones(len(at), bool)
            opens[1 if not skip else 0:] = v[at[1 if not skip else 0:]] != v[at[1 if not skip else 0:] - 1]
            first = np.maximum.accumulate(np.where(opens, at, 0))
            one, two = [], []
            for other in (first, np.maximum(at - 1, 0)):
                # rows of another variant, and the row itself, are no partners
                some = (v[other] == v[at]) & (other < at) & (other >= np.where(first >= skip, first, 0))
                one.append(at[some])
                two.append(other[some])
            a, c = key.take(pa.array(np.concatenate(one))), key.take(pa.array(np.concatenate(two)))
            yield pa.RecordBatch.from_arrays([a, c], ["x", "y"])
            start = int(first[-1])
            tail = rows.take(pa.array([start, len(v) - 1]))

    pairs = ordered.mapInArrow(run, "x binary, y binary").where("x <> y")
    return pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def _shingle_sets(pairs: DataFrame, docs: DataFrame, owners: DataFrame, text: str, key: str) -> DataFrame:
    """(set_key, hashes), written: the shingle sets of all members of pairs; the only time that texts are read again."""
    wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("set_key")).distinct().join(owners, "set_key").select("set_key", "key"), "wanted")
    if wanted.count() <= SENT:  # a few MB are sent to the texts; texts move only where that list is long
        wanted = F.broadcast(wanted)
    slim = (docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).join(wanted, "key")
            .select("set_key", "text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [_shingle_set(t.as_py(), SIMILAR_WORDS).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["set_key", "hashes"])

    return written(slim.mapInArrow(hashed, "set_key binary, hashes binary").dropDuplicates(["set_key"]), "shingle-sets")


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose shingle sets have a Jaccard similarity of SIMILARITY at least."""
    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(SIMILARITY[1] * both >= SIMILARITY[0] * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda c: sets.select(F.col("set_key").alias(c), F.col("hashes").alias(f"h{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ha", "hb").mapInArrow(checked, "a binary, b binary")


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after further links (a, b): only the groups that they touch are contracted."""
    named = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    ends = written(links.join(named("a"), "a", "left").join(named("b"), "b", "left").select(
        "a", "b", F.coalesce("a_root", "a").alias("x"), F.coalesce("b_root", "b").alias("y")), "group-links")
    moved = components(ends.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "joined-groups")
    alone = ends.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("x").alias("root")), F.struct(F.col("b").alias("node"), F.col("y").alias("root")))).alias("e"))
    every = roots.unionByName(alone.select("e.*")).distinct()
    return written(every.join(moved.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "similar-roots")


def _begun(docs: DataFrame, text: str, last: np.ndarray | None) -> DataFrame:
    """(token, set_id, size, place): the first n // 5 + 1 shingles of every set, those in ``last`` after all others.

    Without ``last`` they are a quarter more, as many as move up when some are put last.  token and set_id are 48 and 64 bits.
    """
    more, less = SIMILARITY[1], SIMILARITY[1] - SIMILARITY[0]

    def columns(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], ["token", "set_id", "size", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, n = [], 0
            for t in b.column(0):
                hashes = _shingle_set(t.as_py(), SIMILAR_WORDS)
                size = len(hashes)
                first = size * less // more + 1
                token = (hashes >> np.uint64(16)).astype(np.int64)
                if last is None:
                    token = token[:first + first // 4 + 1]
                elif len(last) and size:
                    late = last[np.minimum(np.searchsorted(last, token), len(last) - 1)] == token
                    token = np.concatenate((token[~late], token[late]))[:first]
                else:
                    token = token[:first]
                held.append((token, np.full(len(token), xxhash.xxh3_128_intdigest(hashes.tobytes(), 42) >> 64, np.uint64).view(np.int64),
                             np.full(len(token), size, np.int32), np.arange(len(token), dtype=np.int32)))
                n += len(token)
                if n > _STEP:
                    yield columns(held)
                    held, n = [], 0
            if held:
                yield columns(held)

    return docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "token long, set_id long, size int, place int")


def _crowded(docs: DataFrame, text: str, n: int) -> np.ndarray:
    """Sorted tokens that many documents begin with: at most some CROWD_SHARE times the shingles that a document begins with, however many documents."""
    counts = _begun(docs, text, None).groupBy("token").count()
    many = counts.where(F.col("count") > max(CROWD, n // CROWD_SHARE)).select("token")
    return np.sort(many.toArrow().column(0).to_numpy())


def _set_id(set_key: str) -> Column:
    """The 64 bits of a set_key that name it in ``_begun``."""
    return F.conv(F.hex(F.substring(set_key, 1, 8)), 16, -10).cast("long")


def _unmet(shared: DataFrame, roots: DataFrame, parities: DataFrame) -> DataFrame:
    """(x, y): the pairs of sets of different groups that may be at SIMILARITY, from (token, set_id, size, place), (set_id, root) and (set_id, parities)."""
    marked = shared.join(roots.select("set_id", "root"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    tokens = marked.groupBy("token").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    # block i of a crowded token meets block j: a row goes to the cells of its block with every other
    dealt = marked.join(tokens.select("token", "n"), "token").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn(
        "block", F.pmod(F.xxhash64("set_id"), "blocks").cast("int"))
    cells = dealt.select("token", "set_id", "size", "place", "root", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "token", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "set_id", "size", "place", "root")
    n = int(shared.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = cells.join(parities, "set_id").repartition(n, "token", "i", "j").sortWithinPartitions("token", "i", "j")
    more = SIMILARITY[1]
    both = sum(SIMILARITY)  # of sizes a and b, sets at SIMILARITY share 4 (a + b) / 9 shingles and differ in (a + b) / 9

    def compared(rows: pa.Table, end: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The pairs of whole cells; ``end`` is where each row's cell ends."""
        size, place, root, own, block = (rows.column(c).to_numpy() for c in ("size", "place", "root", "set_id", "block"))
        size, place, parities = size.astype(np.int64), place.astype(np.int64), rows.column("parities").combine_chunks()
        alike = rows.column("i").to_numpy() == rows.column("j").to_numpy()
        live = np.arange(len(own))
        for step in range(1, len(own)):  # every row with the one so many rows below
            live = live[live + step < end[live]]
            if not len(live):
                break
            a, b = live, live + step
            total = size[a] + size[b]
            reach = np.minimum(place[a], place[b]) + np.minimum(size[a] - place[a], size[b] - place[b])  # shared before, and from here on
            some = (root[a] != root[b]) & (both * reach >= SIMILARITY[0] * total) & (alike[a] | (block[a] != block[b]))
            some &= more * np.minimum(size[a], size[b]) >= SIMILARITY[0] * np.maximum(size[a], size[b])
            a, b, total = a[some], b[some], total[some]
            some = both * _least_apart(parities, a, b) <= (more - SIMILARITY[0]) * total
            a, b = a[some], b[some]
            if len(a):
                a, b = np.where(own[a] < own[b], a, b), np.where(own[a] < own[b], b, a)
                yield pa.RecordBatch.from_arrays([pa.array(own[a]), pa.array(own[b]), pa.array(size[a]), pa.array(size[b])], ["x", "y", "nx", "ny"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the cell that goes on
        for b in batches:
            if not b.num_rows:
                continue
            rows = pa.Table.from_batches([b])
            rows = (pa.concat_tables([held, rows]) if held is not None else rows).combine_chunks()
            at = [rows.column(c).to_numpy() for c in ("token", "i", "j")]
            cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in at])) + 1
            if len(cuts):
                yield from compared(rows.slice(0, cuts[-1]).combine_chunks(), np.repeat(cuts, np.diff(cuts, prepend=0)))
            held = rows.slice(cuts[-1] if len(cuts) else 0)
        if held is not None:
            yield from compared(held.combine_chunks(), np.full(held.num_rows, held.num_rows))

    pairs = ordered.mapInArrow(run, "x long, y long, nx long, ny long").groupBy("x", "y", "nx", "ny").agg(F.count("*").alias("common"))
    # what is shared beyond the beginnings of both is at most the rest of one of them
    rest = lambda c: F.col(c) - F.floor(F.col(c) * (SIMILARITY[1] - SIMILARITY[0]) / SIMILARITY[1]) - 1
    return pairs.where(both * (F.col("common") + F.greatest(rest("nx"), rest("ny"))) >= SIMILARITY[0] * (F.col("nx") + F.col("ny"))).select("x", "y")


def similar_groups(docs: DataFrame, key: str, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, group), a row per row: rows linked by shingle sets of Jaccard >= SIMILARITY share a group.

    ``key`` names a row's content.
    """
    prints = written(_set_prints(docs, text, key, keep), "set-prints")
    owners = prints.groupBy("set_key").agg(F.min(F.col(f"`{key}`")).alias("key"))
    pairs = written(_met(prints.select("set_key", "prints").dropDuplicates(["set_key"])), "met")
    sets = _shingle_sets(pairs, docs, owners, text, key)
    links = written(_similar(pairs, sets), "similar-links")
    for used in (pairs, sets):
        discard(used)
    roots = written(components(links, "similar-groups"), "similar-roots")

    holders = Window.partitionBy("token")
    begun = _begun(docs, text, _crowded(docs, text, prints.count()))
    shared = written(begun.withColumn("lo", F.min("set_id").over(holders)).withColumn("hi", F.max("set_id").over(holders))
                     .where("lo <> hi").select("token", "set_id", "size", "place").distinct(), "shared-shingles")
    parities = prints.select(_set_id("set_key").alias("set_id"), "parities").dropDuplicates(["set_id"])
    found = written(_unmet(shared, roots.select(_set_id("node").alias("set_id"), _set_id("root").alias("root")), parities), "unmet")
    names = owners.select("set_key", _set_id("set_key").alias("set_id"))
    side = lambda c, name: names.select(F.col("set_id").alias(c), F.col("set_key").alias(name))
    pairs = written(found.join(side("x", "a"), "x").join(side("y", "b"), "y").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "unmet-sets")
    roots = _joined(roots, written(_similar(pairs, _shingle_sets(pairs, docs, owners, text, key)), "similar-links"))
    return prints.join(roots.withColumnRenamed("node", "set_key"), "set_key", "left").select(
        *[F.col(f"`{c}`") for c in (key, *keep)], F.coalesce("root", "set_key").alias("group"))
