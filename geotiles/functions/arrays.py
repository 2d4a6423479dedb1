"""Geometry columns as numpy views of their Arrow buffers, for functions that run in tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

Parts = list[list[np.ndarray]]
POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
ARROW = pa.struct([("kind", pa.string()), ("parts", pa.list_(pa.list_(pa.list_(POINT))))])


def geometries(geom: pa.StructArray) -> Iterator[tuple[str | None, Parts]]:
    """(kind, parts) of every geometry; rings are views, n x 2; a null geometry has no kind."""
    parts = geom.field("parts")
    rings = parts.values
    points = rings.values
    xy = np.stack([points.values.field("x").to_numpy(zero_copy_only=False), points.values.field("y").to_numpy(zero_copy_only=False)], axis=1)
    of_geom, of_part, of_ring = (a.offsets.to_numpy().tolist() for a in (parts, rings, points))
    sound = geom.is_valid().to_pylist()
    for k, kind in enumerate(geom.field("kind").to_pylist()):
        yield (kind if sound[k] else None), [[xy[of_ring[r]:of_ring[r + 1]] for r in range(of_part[p], of_part[p + 1])]
                                             for p in range(of_geom[k], of_geom[k + 1])]


def to_arrow(rows: Iterable[tuple[str, Parts] | None]) -> pa.StructArray:
    """The geometry column of (kind, parts) rows; None is null."""
    kinds, of_geom, of_part, of_ring, flat = [], [0], [0], [0], []
    for row in rows:
        kind, parts = row or (None, [])
        kinds.append(kind)
        for rings in parts:
            for ring in rings:
                flat.append(np.asarray(ring, float).reshape(-1, 2))
                of_ring.append(of_ring[-1] + len(flat[-1]))
            of_part.append(of_part[-1] + len(rings))
        of_geom.append(of_geom[-1] + len(parts))
    xy = np.concatenate(flat) if flat else np.zeros((0, 2))
    points = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(xy[:, 0])), pa.array(np.ascontiguousarray(xy[:, 1]))], fields=list(POINT))
    lists = points
    for offsets in (of_ring, of_part, of_geom):
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), lists)
    return pa.StructArray.from_arrays([pa.array(kinds, pa.string()), lists.cast(ARROW.field("parts").type)], fields=list(ARROW),
                                      mask=pa.array([k is None for k in kinds], pa.bool_()))
