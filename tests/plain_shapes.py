"""Geometry shaping ring by ring and point by point: what the flat version is compared with."""

import numpy as np

from geotiles.functions import tilemath as tm


def _radial(pts: list[list[float]], tol_sq: float) -> list[int]:
    """Places of the points that lie farther than the tolerance from the last one kept; the ends stay."""
    keep, (lx, ly) = [0], pts[0]
    for i in range(1, len(pts) - 1):
        x, y = pts[i]
        if (x - lx) ** 2 + (y - ly) ** 2 > tol_sq:
            keep.append(i)
            lx, ly = x, y
    return [*keep, len(pts) - 1]


def _farthest(pts: list[list[float]], a: int, b: int) -> tuple[float, int]:
    """(squared distance, place) of the point of a stretch that is farthest from its chord."""
    (ax, ay), (bx, by) = pts[a], pts[b]
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    best, at = -1.0, a
    for k in range(a + 1, b):
        x, y = pts[k][0] - ax, pts[k][1] - ay
        t = min(1.0, max(0.0, (x * dx + y * dy) / n)) if n > 0 else 0.0
        x, y = x - t * dx, y - t * dy
        if (d := x * x + y * y) > best:
            best, at = d, k
    return best, at


def _peucker(pts: list[list[float]], tol_sq: float) -> list[int]:
    """Places that Douglas-Peucker keeps, with an explicit stack; distances of a long stretch at once, of a short one in a loop that costs less."""
    keep, todo = [0, len(pts) - 1], [(0, len(pts) - 1)]
    p = np.array(pts) if len(pts) > 40 else None
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        if b - a < 40:
            dist, k = _farthest(pts, a, b)
        else:
            mid, d = p[a + 1:b] - p[a], p[b] - p[a]
            n = d @ d
            t = np.minimum(1.0, np.maximum(0.0, (mid @ d) / n))[:, None] if n > 0 else 0.0
            off = mid - t * d
            every = (off * off).sum(axis=1)
            k = int(every.argmax())
            dist, k = float(every[k]), a + 1 + k
        if dist > tol_sq:
            keep.append(k)
            todo += [(a, k), (k, b)]
    return sorted(keep)


def kept_places(p: np.ndarray, tol: float, closed: bool) -> list[int] | None:
    """Places of the points that stay: radial pass, then Douglas-Peucker; None if all do.

    Rings keep four points, lines two, else they stay as they are.
    """
    n = len(p)
    if tol <= 0 or n <= (4 if closed else 2):
        return None
    pts = p.tolist()
    first = pts[0]
    if closed:
        pts = pts[:-1]
    at = _radial(pts, (tol * 0.5) ** 2) if len(pts) > 2 else list(range(len(pts)))
    if len(at) > 2:
        some = [pts[k] for k in at]
        at = [at[k] for k in _peucker(some, tol * tol)]
    if not closed:
        return at if len(at) >= 2 else None
    if len(at) < 3:
        return None
    ring = at if pts[at[-1]] == first else [*at, at[0]]
    return ring if len(ring) >= 4 else None


def simplify_line(p: np.ndarray, tol: float, closed: bool) -> np.ndarray:
    at = kept_places(p, tol, closed)
    return p if at is None else p[at]


def simplify_parts(kind: str, parts: list[list[np.ndarray]], tol: float) -> list[list[np.ndarray]]:
    return [[p[a:b] if at is None else p[a:b][at] for p, a, b, at in rings] for rings in simplified_places(kind, [[(r, 0, len(r)) for r in rings] for rings in parts], tol)]


def simplified_places(kind: str, parts: list[list[tuple[np.ndarray, int, int]]], tol: float) -> list[list[tuple[np.ndarray, int, int, list[int] | None]]]:
    """Rings (points, start, end) with the places that stay in them; rings that are none any more are left out.

    A polygon of which nothing is left stays as it is.
    """
    if kind == "Point" or tol <= 0:
        return [[(*ring, None) for ring in rings] for rings in parts]
    area, made = kind in ("Polygon", "MultiPolygon"), []
    for rings in parts:
        got = []
        for p, a, b in rings:
            at = kept_places(p[a:b], tol, area)
            if (b - a if at is None else len(at)) >= (4 if area else 2):
                got.append((p, a, b, at))
        if got or not area:
            made.append(got)
    return made or [[(*ring, None) for ring in rings] for rings in parts]


def usable(kind: str, parts: list[list[np.ndarray]]) -> bool:
    least = {"Point": 1, "LineString": 2, "MultiLineString": 2}.get(kind, 4)
    return any(len(r) >= least for rings in parts for r in rings)


def _cut_ring(p: np.ndarray, axis: int, at: float, below: bool) -> np.ndarray:
    """One side of a ring (open form), by Sutherland and Hodgman."""
    if not len(p):
        return p
    side = p[:, axis] <= at if below else p[:, axis] >= at
    if side.all():
        return p
    out = []
    for k in range(len(p)):
        a, b = p[k - 1], p[k]
        if side[k] != side[k - 1]:
            t = (at - a[axis]) / (b[axis] - a[axis])
            out.append(a + t * (b - a))
        if side[k]:
            out.append(b)
    return np.array(out).reshape(-1, 2)


def _cut_line(p: np.ndarray, lo: float, hi: float) -> list[np.ndarray]:
    """Stretches of a line inside the square [lo, hi], by Liang and Barsky."""
    out: list[list[tuple[float, float]]] = []
    pts = p.tolist()
    for (ax, ay), (bx, by) in zip(pts, pts[1:]):
        dx, dy, t0, t1 = bx - ax, by - ay, 0.0, 1.0
        for num, den in ((ax - lo, -dx), (hi - ax, dx), (ay - lo, -dy), (hi - ay, dy)):
            if den == 0:
                if num < 0:
                    t0, t1 = 1.0, 0.0
            elif den > 0:
                t1 = min(t1, num / den)
            else:
                t0 = max(t0, num / den)
        if t0 > t1:
            continue
        one, two = (ax + t0 * dx, ay + t0 * dy), (ax + t1 * dx, ay + t1 * dy)
        if out and t0 == 0 and out[-1][-1] == one:
            out[-1].append(two)
        else:
            out.append([one, two])
    return [np.array(s) for s in out]


def clip_units(kind: str, parts: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
    """As ``clip_to_tile``, of parts already in tile units."""
    lo, hi = -float(tm.BUFFER), float(tm.EXTENT + tm.BUFFER)
    made = []
    for rings in parts:
        got = []
        for p in rings:
            if p.min() >= lo and p.max() <= hi:
                got.append(np.rint(p).astype(np.int64))
            elif kind == "Point":
                keep = p[((p >= lo) & (p <= hi)).all(axis=1)]
                if len(keep):
                    got.append(np.rint(keep).astype(np.int64))
            elif kind in ("LineString", "MultiLineString"):
                got += [np.rint(s).astype(np.int64) for s in _cut_line(p, lo, hi)]
            else:
                q = p[:-1]
                for axis in (0, 1):
                    q = _cut_ring(_cut_ring(q, axis, hi, True), axis, lo, False)
                if len(q) >= 3:
                    got.append(np.rint(np.vstack([q, q[:1]])).astype(np.int64))
                elif not got:
                    break
        if got:
            made.append(got)
    return made


def varints(rows: list[list[int]]) -> list[bytes]:
    """Unsigned numbers of every row as base-128 bytes, all rows at once."""
    flat = np.array([v for row in rows for v in row], np.uint64)
    length = np.ones(len(flat), np.int64)
    for k in range(1, 10):
        length += flat >= np.uint64(1) << np.uint64(7 * k)
    ends = np.cumsum(length)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(length.max()) if len(length) else 0):
        some = length > k
        byte = (flat[some] >> np.uint64(7 * k) & np.uint64(127)).astype(np.uint8)
        out[ends[some] - length[some] + k] = byte | np.where(length[some] > k + 1, 128, 0).astype(np.uint8)
    raw, bounds = out.tobytes(), np.concatenate(([0], ends))
    stops = bounds[np.cumsum([len(r) for r in rows], dtype=np.int64)].tolist() if rows else []
    return [raw[a:b] for a, b in zip([0, *stops[:-1]], stops)]


def command_numbers(kind: str, parts: list[list[np.ndarray]]) -> list[int]:
    """Geometry commands of whole-unit parts as numbers: MoveTo 1, LineTo 2, ClosePath 7, with zigzag deltas."""
    area = kind in ("Polygon", "MultiPolygon")
    out: list[int] = []
    cx = cy = 0
    for rings in parts:
        for k, ring in enumerate(rings):
            pts = ring.tolist()
            if area:
                pts = pts[:-1]
                if (sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(pts, pts[1:] + pts[:1])) > 0) != (k == 0):
                    pts = pts[::-1]
            for n, (x, y) in enumerate(pts):
                if n < 2:
                    out.append(9 if n == 0 else len(pts) - 1 << 3 | 2)
                dx, dy = x - cx, y - cy
                out.append(dx << 1 ^ dx >> 63)
                out.append(dy << 1 ^ dy >> 63)
                cx, cy = x, y
            if area:
                out.append(15)
    return out


def commands(kind: str, parts: list[list[np.ndarray]]) -> bytes:
    return varints([command_numbers(kind, parts)])[0]


