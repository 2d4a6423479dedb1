"""SentencePiece (BPE) encoding and decoding by vectorised merge rounds.

The vocabulary comes from a model file whose path is a parameter.  A text is cut
into segments that no piece can span: before a gap mark that follows another
character, and between two characters that are neighbours in no piece.  Distinct
segments of an Arrow batch are laid out as one flat numpy symbol array and merged
together in rounds: look up the rank of every adjacent pair, take each segment's
minimum, merge its leftmost occurrence - or all leftmost non-overlapping ones,
where no pair made from the merged piece can come before it - and compact, until
no pair remains.  Characters without a piece become byte pieces.  Ids of known
segments are kept in a bounded per-task cache.

Decoding joins the pieces' bytes, turns gap marks into spaces, drops the space
that encoding put in front, and reads UTF-8.

The model must be BPE with byte fallback and without text normalisation, which
``Vocabulary`` checks.  Defined results: null is encoded like an empty text, to no
ids; very long texts are encoded in whole, one at a time; repeated rows give equal
ids; an empty table gives an empty one; extra columns are kept unless they clash
with an output column, which replaces them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

GAP = "▁"
_CACHED = 400_000  # segments remembered by a task
_MERGED_AT_ONCE = 1 << 20  # symbols laid out in one round
_LONG = 40  # words above are cut further
_BLOCK = 128  # texts handled together


class Vocabulary:
    """Pieces, ranks and the pair table of one model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        byte = [sp.is_byte(i) for i in range(n)]
        plain = [not (byte[i] or sp.is_control(i) or sp.is_unknown(i)) for i in range(n)]
        if sum(byte) != 256 or any(sp.is_unused(i) for i in range(n)):
            raise ValueError("the model must have byte fallback and no unused pieces")
        probe = "ﬁ Ａ  é\t"
        if sp.decode(sp.encode(probe)) != probe:
            raise ValueError("the model must not normalise texts")
        self.id_of = {p: i for i, p in enumerate(self.pieces) if plain[i]}
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bytes_of = [p.replace(GAP, " ").encode() if plain[i] else b"" for i, p in enumerate(self.pieces)]
        for b, i in enumerate(self.byte_ids):
            self.bytes_of[i] = bytes([b])

        scores = np.array([sp.get_score(i) for i in range(n)])
        _, rank = np.unique(-scores, return_inverse=True)
        keys, made = [], []
        self.neighbours = set()
        for piece, i in self.id_of.items():
            self.neighbours.update(zip(piece, piece[1:]))
            for k in range(1, len(piece)):
                left, right = self.id_of.get(piece[:k]), self.id_of.get(piece[k:])
                if left is not None and right is not None:
                    keys.append(left * n + right)
                    made.append(i)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.pair_keys = np.array(keys, np.int64)[order]
        self.pair_made = np.array(made, np.int64)[order]
        self.rank, self.size = rank.astype(np.int64), n
        # a piece may be merged everywhere at once if all pairs made with it come later than itself
        self.at_once = np.ones(n, bool)
        for part in (self.pair_keys // n, self.pair_keys % n):
            early = self.rank[self.pair_made] <= self.rank[part]
            self.at_once[part[early]] = False
        if any(c not in self.id_of for p in self.id_of for c in p):
            raise ValueError("every character of a piece must itself be a piece")
        self.char_ids = np.full(0x110000, -1, np.int32)
        for piece, i in self.id_of.items():
            if len(piece) == 1:
                self.char_ids[ord(piece)] = i

    def cut(self, word: str) -> list[str]:
        """Segments of a long word: no piece spans the cuts."""
        if len(word) <= _LONG:
            return [word]
        near = self.neighbours
        cuts = [k for k in range(1, len(word)) if (word[k - 1], word[k]) not in near]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])]

    def merged(self, segments: list[str]) -> list[list[int]]:
        """Ids of each segment, all merged together in rounds."""
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        chars = "".join(segments)
        points = np.frombuffer(chars.encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = self.char_ids[points].astype(np.int64)
        owner = np.repeat(np.arange(len(segments)), lengths)
        none = np.iinfo(np.int64).max
        finished: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        place = np.arange(len(chars))  # of each symbol's first character
        while len(symbols) > 1:
            left, right = symbols[:-1], symbols[1:]
            valid = (owner[:-1] == owner[1:]) & (left >= 0) & (right >= 0)
            key = np.where(valid, left * self.size + right, -1)
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            known = valid & (self.pair_keys[at] == key)
            made = self.pair_made[at]
            rank = np.where(known, self.rank[made], none)
            # segmented minimum: pairs are grouped by the owner of their left symbol
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            rank = np.append(rank, none)
            least = np.minimum.reduceat(rank, starts)
            group = np.cumsum(np.concatenate(([True], owner[1:] != owner[:-1]))) - 1
            best = known & (rank[:-1] == least[group[:-1]])
            spots = np.flatnonzero(best)
            # leave what has no pair left, and go on with the rest
            open_ = (least < none)[group]
            if not open_.all():
                finished.append((owner[~open_], place[~open_], symbols[~open_]))
            if not len(spots):
                symbols, owner, place = symbols[:0], owner[:0], place[:0]
                break
            new = made[spots]
            first = np.concatenate(([True], group[spots[1:]] != group[spots[:-1]]))
            # equal ranks may hide different pieces: at once only for the piece of the leftmost spot
            lead = new[np.maximum.accumulate(np.where(first, np.arange(len(spots)), 0))]
            take = first | (self.at_once[lead] & (new == lead))
            # among touching spots (a run such as "aaa") every other one, from the left
            spots, new = spots[take], new[take]
            run = np.concatenate(([True], spots[1:] != spots[:-1] + 1))
            since = np.arange(len(spots)) - np.maximum.accumulate(np.where(run, np.arange(len(spots)), 0))
            spots, new = spots[since % 2 == 0], new[since % 2 == 0]
            symbols = symbols.copy()
            symbols[spots] = new
            keep = open_.copy()
            keep[spots + 1] = False
            symbols, owner, place = symbols[keep], owner[keep], place[keep]
        finished.append((owner, place, symbols))
        owner, place, symbols = (np.concatenate([f[k] for f in finished]) for k in range(3))
        order = np.argsort(place)
        owner, place, symbols = owner[order], place[order], symbols[order]
        flat = symbols.tolist()
        if len(missing := np.flatnonzero(symbols < 0)):
            bytes_at = {k: [self.byte_ids[b] for b in chars[place[k]].encode()] for k in missing.tolist()}
            flat = list(chain.from_iterable(bytes_at.get(k, (s,)) for k, s in enumerate(flat)))
        extra = np.ones(len(symbols), np.int64)
        if (symbols < 0).any():
            code = points[place[symbols < 0]]
            extra[symbols < 0] = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
        ends = np.cumsum(np.bincount(owner, extra, len(segments)).astype(np.int64)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        if all(len(w) <= _LONG for w in words):
            return self._all_merged(words)
        short = [w for w in words if len(w) <= _LONG]
        known = dict(zip(short, self._all_merged(short)))
        long = [w for w in words if len(w) > _LONG]
        known.update(zip(long, self._cut_and_merged(long)))
        return [known[w] for w in words]

    def _all_merged(self, segments: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        for at in range(0, len(segments), _MERGED_AT_ONCE // _LONG):
            out += self.merged(segments[at:at + _MERGED_AT_ONCE // _LONG])
        return out

    def _cut_and_merged(self, words: list[str]) -> list[list[int]]:
        cut = [self.cut(w) for w in words]
        distinct = list(dict.fromkeys(chain.from_iterable(cut)))
        ids: dict[str, list[int]] = {}
        at = 0
        while at < len(distinct):
            to, size = at, 0
            while to < len(distinct) and (to == at or size + len(distinct[to]) <= _MERGED_AT_ONCE):
                size += len(distinct[to])
                to += 1
            ids.update(zip(distinct[at:to], self.merged(distinct[at:to])))
            at = to
        return [list(chain.from_iterable(ids[s] for s in segments)) for segments in cut]

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        return raw.decode("utf-8", "replace").removeprefix(" ")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def split_words(text: str) -> list[str]:
    """The marked text in words: a gap mark starts a word unless it follows another one."""
    parts = text.split(" ")
    if "" not in parts and GAP not in text:
        return [GAP + p for p in parts]
    marked = GAP + text.replace(" ", GAP)
    words, at = [], 0
    while at < len(marked):
        to = at
        while to < len(marked) and marked[to] == GAP:
            to += 1
        to = marked.find(GAP, to)
        to = len(marked) if to < 0 else to
        words.append(marked[at:to])
        at = to
    return words


class Encoder:
    """Encodes texts with a bounded memory of words, kept while a Python worker is reused."""

    _memory: dict[str, dict[str, list[int]]] = {}

    def __init__(self, path: str):
        self.v = vocabulary(path)
        self.known = self._memory.setdefault(path, {})

    def __call__(self, texts: list[str]) -> list[list[int]]:
        cut = [split_words(t) if t else [] for t in texts]
        known = self.known
        if len(known) > _CACHED:
            known.clear()
        fresh = list(set(chain.from_iterable(cut)).difference(known))
        if fresh:
            known.update(zip(fresh, self.v.encode_words(fresh)))
        return [list(chain.from_iterable(map(known.__getitem__, words))) for words in cut]


def _mapped(docs: DataFrame, text: str, fields: list[T.StructField], run) -> DataFrame:
    names = [f.name for f in fields]
    slim = docs.drop(*[n for n in names if n != text])
    keep = [f for f in slim.schema.fields if f.name != text]
    slim = slim.select(*[F.col(f"`{f.name}`") for f in keep], F.col(f"`{text}`").alias("_text"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = run()
        for whole in it:
            for at in range(0, whole.num_rows, _BLOCK):
                b = whole.slice(at, _BLOCK)
                made = step(b.column(b.num_columns - 1))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], [*(f.name for f in keep), *names])

    return slim.mapInArrow(batches, T.StructType([*keep, *fields]))


def encode(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` without the text, with ``ids`` (ARRAY<INT>)."""
    def run():
        encoder = Encoder(model_path)
        return lambda texts: [pa.array(encoder([t or "" for t in texts.to_pylist()]), pa.list_(pa.int32()))]

    return _mapped(docs, text, [T.StructField(ids, T.ArrayType(T.IntegerType()))], run)


def decode(encoded: DataFrame, model_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``encoded`` without the ids, with ``text`` (STRING)."""
    def run():
        v = vocabulary(model_path)
        return lambda lists: [pa.array([v.decode(x or []) for x in lists.to_pylist()], pa.string())]

    return _mapped(encoded, ids, [T.StructField(text, T.StringType())], run)


def round_trip_digests(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """``docs`` without the text, with n_tokens, ids_sha256 and decoded_sha256."""
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
              T.StructField("decoded_sha256", T.StringType())]

    def run():
        encoder = Encoder(model_path)
        v = encoder.v
        written = list(map(str, range(v.size)))
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

        def step(texts: pa.Array) -> list[pa.Array]:
            ids = encoder([t or "" for t in texts.to_pylist()])
            return [pa.array(list(map(len, ids)), pa.int64()),
                    pa.array([sha(",".join(map(written.__getitem__, x))) for x in ids], pa.string()),
                    pa.array([sha(v.decode(x)) for x in ids], pa.string())]

        return step

    return _mapped(docs, text, fields, run)
