"""Simplifying, clipping and writing the geometries of a whole Arrow batch at once, over flat arrays of points.

``Rings`` are points with ring boundaries; every step takes all rings of a batch: the radial pass advances in all of them together,
Douglas-Peucker splits all stretches of a level by segmented maxima, lines are cut by Liang and Barsky segment-wise, and commands are placed by
cumulative counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

POINT, LINE, AREA = 0, 1, 2
_CODES = {"Point": POINT, "MultiPoint": POINT, "LineString": LINE, "MultiLineString": LINE, "Polygon": AREA, "MultiPolygon": AREA}
#: Longer rings pass the radial step one by one: in step with short ones they would hold up the others.
_IN_STEP = 256


@dataclass
class Rings:
    """Points xy with the start of each ring (and the end of the last), the geometry and the part of each ring."""

    xy: np.ndarray
    at: np.ndarray
    geom: np.ndarray
    part: np.ndarray

    @property
    def size(self) -> np.ndarray:
        return np.diff(self.at)

    def picked(self, index: np.ndarray, size: np.ndarray, rings: np.ndarray) -> Rings:
        """The rings ``rings`` made of the points ``index``, ``size`` each."""
        return Rings(self.xy[index], np.concatenate(([0], np.cumsum(size))), self.geom[rings], self.part[rings])

    def only(self, rings: np.ndarray) -> Rings:
        """The rings where the mask says so."""
        some = np.flatnonzero(rings)
        size = self.size[some]
        return self.picked(spans(self.at[:-1][some], size), size, some)


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every stretch, one after the other."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


def read(geom: pa.StructArray) -> tuple[Rings, np.ndarray]:
    """(rings, kind code of each geometry); a null geometry has no rings."""
    parts = geom.field("parts")
    rings = parts.values
    points = rings.values
    xy = np.stack([points.values.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y")], axis=1)
    of_geom, of_part, of_ring = (a.offsets.to_numpy().astype(np.int64) for a in (parts, rings, points))
    kinds = np.array([_CODES.get(k, AREA) for k in geom.field("kind").to_pylist()], np.int64)
    number = np.diff(of_geom)
    number[~geom.is_valid().to_numpy(zero_copy_only=False)] = 0
    part = spans(of_geom[:-1], number)
    rings_of = np.diff(of_part)[part]
    ring = spans(of_part[:-1][part], rings_of)
    size = np.diff(of_ring)[ring]
    flat = Rings(xy, of_ring, np.zeros(0), np.zeros(0))
    out = flat.xy[spans(of_ring[:-1][ring], size)]
    return Rings(out, np.concatenate(([0], np.cumsum(size))), np.repeat(np.repeat(np.arange(len(kinds)), number), rings_of), np.repeat(np.arange(len(part)), rings_of)), kinds


def _radial(xy: np.ndarray, start: np.ndarray, size: np.ndarray, tol_sq: np.ndarray) -> np.ndarray:
    """Mask of the points farther than the tolerance from the last one kept; the ends of each stretch stay."""
    keep = np.zeros(len(xy), bool)
    keep[start] = keep[start + size - 1] = True
    order = np.argsort(-size, kind="stable")
    start, size, tol_sq = start[order], size[order], tol_sq[order]
    for k in range(int((size > _IN_STEP).sum())):
        (lx, ly), least = xy[start[k]].tolist(), float(tol_sq[k])
        for i, (x, y) in enumerate(xy[start[k] + 1:start[k] + size[k] - 1].tolist(), int(start[k]) + 1):
            if (x - lx) ** 2 + (y - ly) ** 2 > least:
                keep[i] = True
                lx, ly = x, y
    short = size <= _IN_STEP
    start, size, tol_sq = start[short], size[short], tol_sq[short]
    last = xy[start].copy() if len(start) else np.zeros((0, 2))
    for i in range(1, int(size.max()) - 1 if len(size) else 0):
        n = int(np.searchsorted(-size, -(i + 1), side="left"))  # stretches with a point after this one
        here = xy[start[:n] + i]
        off = here - last[:n]
        far = off[:, 0] ** 2 + off[:, 1] ** 2 > tol_sq[:n]
        keep[start[:n][far] + i] = True
        last[:n][far] = here[far]
    return keep


def _peucker(xy: np.ndarray, start: np.ndarray, size: np.ndarray, tol_sq: np.ndarray) -> np.ndarray:
    """Mask of the points that Douglas-Peucker keeps in every stretch, level by level."""
    keep = np.zeros(len(xy), bool)
    keep[start] = keep[start + size - 1] = True
    a, b, least = start, start + size - 1, tol_sq
    while True:
        some = b - a >= 2
        a, b, least = a[some], b[some], least[some]
        if not len(a):
            return keep
        inner = b - a - 1
        place = spans(a + 1, inner)
        chord = np.repeat(np.arange(len(a)), inner)
        d = xy[b] - xy[a]
        n = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1]
        x, y = xy[place, 0] - xy[a, 0][chord], xy[place, 1] - xy[a, 1][chord]
        dx, dy, n = d[chord, 0], d[chord, 1], n[chord]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(n > 0, np.minimum(1.0, np.maximum(0.0, (x * dx + y * dy) / n)), 0.0)
        x, y = x - t * dx, y - t * dy
        off = x * x + y * y
        head = np.cumsum(inner) - inner
        most = np.maximum.reduceat(off, head)
        first = np.minimum.reduceat(np.where(off == most[chord], place, np.iinfo(np.int64).max), head)
        split = most > least
        a, b, k, least = a[split], b[split], first[split], least[split]
        keep[k] = True
        a, b, least = np.concatenate((a, k)), np.concatenate((k, b)), np.concatenate((least, least))


def simplified(rings: Rings, kinds: np.ndarray, tol: np.ndarray, values: Rings | None = None) -> Rings:
    """Rings of geometries simplified by a tolerance each: radial pass at half of it, then Douglas-Peucker.

    Areas keep four points, lines two, else a ring stays as it is; rings that are none go, unless nothing is left of an area.  Points, and
    geometries without tolerance, stay whole.  With ``values`` the points come from there (the same rings in other units).
    """
    size, kind, least = rings.size, kinds[rings.geom], tol[rings.geom]
    area = kind == AREA
    able = (kind != POINT) & (least > 0) & (size > np.where(area, 4, 2))
    work = np.flatnonzero(able)
    start, n = rings.at[:-1][work], (size - area)[work]  # areas without their closing point
    flat = spans(start, n)
    own = np.cumsum(n) - n
    xy = rings.xy[flat]
    one = _radial(xy, own, n, (least[work] * 0.5) ** 2) if len(work) else np.zeros(0, bool)
    ring = np.repeat(np.arange(len(work)), n)
    n1 = np.bincount(ring[one], minlength=len(work))
    flat, ring = flat[one], ring[one]
    two = _peucker(xy[one], np.cumsum(n1) - n1, n1, least[work] ** 2) if len(work) else np.zeros(0, bool)
    flat, ring = flat[two], ring[two]
    n2 = np.bincount(ring, minlength=len(work))
    first, last = np.cumsum(n2) - n2, np.cumsum(n2) - 1
    closes = area[work] & (rings.xy[flat[last]] != rings.xy[flat[first]]).any(axis=1) if len(work) else np.zeros(0, bool)
    whole = np.where(area[work], (n2 < 3) | (n2 + closes < 4), n2 < 2)
    # every ring: all its points, or those kept and, for areas, the first again
    count = size.copy()
    count[work[~whole]] = (n2 + closes)[~whole]
    index = spans(rings.at[:-1], size)
    out = np.empty(int(count.sum()), np.int64)
    begin = np.cumsum(count) - count
    plain = np.ones(len(size), bool)
    plain[work[~whole]] = False
    out[spans(begin[plain], size[plain])] = index[spans(rings.at[:-1][plain], size[plain])]
    changed = ~whole[ring]
    within = np.arange(len(flat)) - first[ring]
    out[begin[work[ring[changed]]] + within[changed]] = flat[changed]
    ended = np.flatnonzero(closes & ~whole)
    out[begin[work[ended]] + n2[ended]] = flat[first[ended]]
    enough = count >= np.where(area, 4, 2)
    left = np.zeros(len(kinds), bool)
    left[rings.geom[enough]] = True
    stays = enough | (kind == POINT) | (least <= 0) | (area & ~left[rings.geom])
    return (values or rings).picked(out[np.repeat(stays, count)], count[stays], np.flatnonzero(stays))


def _cut_lines(rings: Rings, lo: float, hi: float) -> Rings:
    """Stretches of lines inside the square [lo, hi], by Liang and Barsky over all segments."""
    size = rings.size
    first = spans(rings.at[:-1], np.maximum(size - 1, 0))
    ring = np.repeat(np.arange(len(size)), np.maximum(size - 1, 0))
    a, b = rings.xy[first], rings.xy[first + 1]
    d = b - a
    t0, t1 = np.zeros(len(a)), np.ones(len(a))
    with np.errstate(divide="ignore", invalid="ignore"):
        for num, den in ((a[:, 0] - lo, -d[:, 0]), (hi - a[:, 0], d[:, 0]), (a[:, 1] - lo, -d[:, 1]), (hi - a[:, 1], d[:, 1])):
            t1 = np.where(den > 0, np.minimum(t1, num / den), np.where((den == 0) & (num < 0), -1.0, t1))
            t0 = np.where(den < 0, np.maximum(t0, num / den), t0)
    ok = np.flatnonzero(t0 <= t1)
    a, b, d, t0, t1, ring = a[ok], b[ok], d[ok], t0[ok, None], t1[ok, None], ring[ok]
    enter, leave = a + t0 * d, np.where(t1 == 1, b, a + t1 * d)
    opens = np.ones(len(ok), bool)
    opens[1:] = (ring[1:] != ring[:-1]) | (ok[1:] != ok[:-1] + 1) | (t0[1:, 0] > 0) | (t1[:-1, 0] < 1)
    # a stretch is its first entry and then every exit
    room = 1 + opens.astype(np.int64)
    place = np.cumsum(room) - 1
    xy = np.empty((int(room.sum()), 2))
    xy[place] = leave
    xy[place[opens] - 1] = enter[opens]
    heads = place[opens] - 1
    return Rings(xy, np.append(heads, len(xy)), rings.geom[ring[opens]], rings.part[ring[opens]])


def _cut_ring(p: np.ndarray, axis: int, at: float, below: bool) -> np.ndarray:
    """One side of a ring (open form), by Sutherland and Hodgman."""
    if not len(p):
        return p
    side = p[:, axis] <= at if below else p[:, axis] >= at
    if side.all():
        return p
    before, was = np.roll(p, 1, axis=0), np.roll(side, 1)
    turns = side != was
    t = np.zeros(len(p))
    t[turns] = (at - before[turns, axis]) / (p[turns, axis] - before[turns, axis])
    room = turns.astype(np.int64) + side
    end = np.cumsum(room)
    out = np.empty((int(end[-1]), 2))
    out[(end - room)[turns]] = (before + t[:, None] * (p - before))[turns]
    out[end[side] - 1] = p[side]
    return out


def clipped(rings: Rings, kinds: np.ndarray, lo: float, hi: float) -> Rings:
    """Rings in whole units inside the square [lo, hi], in order; a hole goes with its outer ring."""
    size, kind = rings.size, kinds[rings.geom]
    if not len(size):
        return Rings(np.zeros((0, 2), np.int64), rings.at, rings.geom, rings.part)
    outside = ((rings.xy < lo) | (rings.xy > hi)).any(axis=1)
    crosses = np.zeros(len(size), bool)
    crosses[np.repeat(np.arange(len(size)), size)[outside]] = True
    # pieces of every ring, to be put in order afterwards: (ring number, points)
    inside = np.flatnonzero(~crosses & (size > 0))
    made = [(inside, rings.picked(spans(rings.at[:-1][inside], size[inside]), size[inside], inside))]
    lines = np.flatnonzero(crosses & (kind == LINE))
    if len(lines):
        some = rings.picked(spans(rings.at[:-1][lines], size[lines]), size[lines], lines)
        cut = _cut_lines(Rings(some.xy, some.at, lines, some.part), lo, hi)
        made.append((cut.geom, Rings(cut.xy, cut.at, rings.geom[cut.geom], cut.part)))
    rest: list[tuple[int, np.ndarray]] = []
    lost: set[int] = set()  # parts whose outer ring is gone
    for r in np.flatnonzero(crosses & (kind != LINE)).tolist():
        p = rings.xy[rings.at[r]:rings.at[r + 1]]
        if kind[r] == POINT:
            p = p[((p >= lo) & (p <= hi)).all(axis=1)]
        else:
            p = p[:-1]
            for axis in (0, 1):
                p = _cut_ring(_cut_ring(p, axis, hi, True), axis, lo, False)
            p = np.vstack([p, p[:1]]) if len(p) >= 3 else p[:0]
            if not len(p) and (r == 0 or rings.part[r - 1] != rings.part[r]):
                lost.add(int(rings.part[r]))
        if len(p):
            rest.append((r, p))
    if rest:
        number = np.array([r for r, _ in rest])
        made.append((number, Rings(np.concatenate([p for _, p in rest]), np.concatenate(([0], np.cumsum([len(p) for _, p in rest]))), rings.geom[number], rings.part[number])))
    number = np.concatenate([n for n, _ in made])
    whole = Rings(np.concatenate([m.xy for _, m in made]), np.concatenate(([0], np.cumsum(np.concatenate([m.size for _, m in made])))),
                  np.concatenate([m.geom for _, m in made]), np.concatenate([m.part for _, m in made]))
    order = np.argsort(number, kind="stable")
    if lost:
        order = order[~np.isin(whole.part[order], list(lost))]
    out = whole.picked(spans(whole.at[:-1][order], whole.size[order]), whole.size[order], order)
    out.xy = np.rint(out.xy).astype(np.int64)
    return out


def commands(rings: Rings, kinds: np.ndarray) -> list[bytes]:
    """Tile geometry commands of every geometry (empty without rings): MoveTo 1, LineTo 2, ClosePath 7, with zigzag deltas, as base-128 numbers.

    Outer rings turn one way, holes the other; the closing point is left out.
    """
    area = kinds[rings.geom] == AREA
    n = rings.size - area
    start = rings.at[:-1]
    index = spans(start, n)
    ring = np.repeat(np.arange(len(n)), n)
    xy = rings.xy[index]
    begin = np.cumsum(n) - n
    if area.any():
        nxt = np.where(np.arange(len(index)) + 1 < (begin + n)[ring], np.arange(len(index)) + 1, begin[ring])
        twice = xy[:, 0] * xy[nxt, 1] - xy[nxt, 0] * xy[:, 1]
        total = np.zeros(len(n), np.int64)
        np.add.at(total, ring, twice)
        outer = np.ones(len(n), bool)
        outer[1:] = rings.part[1:] != rings.part[:-1]
        turned = area & ((total > 0) != outer)
        within = np.arange(len(index)) - begin[ring]
        xy = xy[np.where(turned[ring], begin[ring] + n[ring] - 1 - within, np.arange(len(index)))]
    geom = rings.geom[ring]
    delta = xy.copy()
    same = np.flatnonzero(geom[1:] == geom[:-1]) + 1
    delta[same] -= xy[same - 1]
    delta = ((delta << 1) ^ (delta >> 63)).view(np.uint64)
    # a ring: 9, its first point, (n - 1) << 3 | 2, the others, and 15 for areas
    room = 1 + 2 * n + (n > 1) + area
    at = np.cumsum(room) - room
    within = np.arange(len(index)) - begin[ring]
    slot = at[ring] + 1 + 2 * within + (within > 0)
    flat = np.empty(int(room.sum()), np.uint64)
    flat[at] = 9
    more = n > 1
    flat[at[more] + 3] = ((n[more] - 1) << 3 | 2).astype(np.uint64)
    flat[slot], flat[slot + 1] = delta[:, 0], delta[:, 1]
    flat[(at + room - 1)[area]] = 15
    return varints(flat, np.bincount(rings.geom, weights=room, minlength=len(kinds)).astype(np.int64))


def varints(flat: np.ndarray, count: np.ndarray) -> list[bytes]:
    """Unsigned numbers as base-128 bytes, ``count`` a row."""
    length = np.ones(len(flat), np.int64)
    for k in range(1, 10):
        length += flat >= np.uint64(1) << np.uint64(7 * k)
    ends = np.cumsum(length)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(length.max()) if len(length) else 0):
        some = length > k
        byte = (flat[some] >> np.uint64(7 * k) & np.uint64(127)).astype(np.uint8)
        out[ends[some] - length[some] + k] = byte | np.where(length[some] > k + 1, 128, 0).astype(np.uint8)
    raw, stops = out.tobytes(), np.concatenate(([0], ends))[np.cumsum(count)].tolist()
    return [raw[a:b] for a, b in zip([0, *stops[:-1]], stops)]
