"""Which extracts cover a requested box."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..schema import BOX
from ..sources.scratch import running_totals, settled
from .assemble import union_features

STEPS = (0.0, 0.25, 0.5, 0.75, 1.0)


def unwrapped(ring: Column) -> Column:
    """A ring whose longitudes never jump by more than half a turn."""
    start = F.array().cast(g.POINTS)

    def step(acc: Column, p: Column) -> Column:
        last = F.element_at(acc, -1)["x"]
        x = F.when(F.size(acc) > 0, p["x"] - 360.0 * F.round((p["x"] - last) / 360.0)).otherwise(p["x"])
        return F.concat(acc, F.array(g.xy(x, p["y"])))

    return F.aggregate(ring, start, step)


def point_in_ring_wrapped(x: Column, y: Column, ring: Column) -> Column:
    """Ray cast that knows the antimeridian and counts edges as inside."""
    def test(r: Column) -> Column:
        centre = F.aggregate(r, F.lit(0.0), lambda a, p: a + p["x"]) / F.size(r)
        return g.let(x - 360.0 * F.round((x - centre) / 360.0), lambda px: _edge(px, r) | g.point_in_ring(px, y, r))

    def _edge(px: Column, r: Column) -> Column:
        def on(i: Column) -> Column:
            a, b = r[i - 1], r[i]
            dx, dy = b["x"] - a["x"], b["y"] - a["y"]
            cross = (px - a["x"]) * dy - (y - a["y"]) * dx
            dot = (px - a["x"]) * dx + (y - a["y"]) * dy
            long = dx * dx + dy * dy
            return (F.abs(cross) <= 1e-10) & (long > 0) & (dot >= 0) & (dot <= long)  # a repeated point is no edge
        return F.exists(F.sequence(F.lit(1), F.size(r) - 1), on)

    return g.let(unwrapped(ring), test)


def _cell_pairs(boxes: DataFrame, extracts: DataFrame) -> DataFrame:
    """Boxes (box, minx..maxy) with the extracts (id, eminx..emaxy, ...) whose box they touch; a pair only in the cell of its lower-left common corner."""
    cell = 10.0
    cells = lambda df, x: df.withColumn("_cx", F.explode(F.sequence(F.floor(F.col(f"{x}minx") / cell), F.floor(F.col(f"{x}maxx") / cell)))).withColumn(
        "_cy", F.explode(F.sequence(F.floor(F.col(f"{x}miny") / cell), F.floor(F.col(f"{x}maxy") / cell))))
    own = (F.col("_cx") == F.floor(F.greatest("minx", "eminx") / cell)) & (F.col("_cy") == F.floor(F.greatest("miny", "eminy") / cell))
    n = int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a number of their own: both sides are small beside their pairs, and would be put together into few tasks
    dealt = lambda df: df.repartition(n, "_cx", "_cy")
    return dealt(cells(boxes.select("box", *BOX), "")).join(dealt(cells(extracts, "e")).hint("shuffle_hash"), ["_cx", "_cy"]).where(
        own & (F.col("minx") <= F.col("emaxx")) & (F.col("maxx") >= F.col("eminx")) & (F.col("miny") <= F.col("emaxy")) & (F.col("maxy") >= F.col("eminy"))).drop("_cx", "_cy")


def touching(boxes: DataFrame, extracts: DataFrame) -> DataFrame:
    """(box, id): boxes (box, minx..maxy) with the extracts (id, minx..maxy) whose box they touch."""
    return _cell_pairs(boxes, extracts.select("id", *[F.col(c).alias("e" + c) for c in BOX])).select("box", "id")


_GRID = [(a, b) for a in STEPS for b in STEPS]
ALL = (1 << len(_GRID)) - 1  # a bit for each sample


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that filters behind it do not compute again: they are not moved in front of a generator."""
    return df.withColumn(name, F.explode(F.array(value)))


def _bits(unit: int, test: str) -> str:
    """SQL of the bits of the steps that pass a test over {k}, 1 << unit * k for the kth."""
    return "CAST(" + " + ".join(f"CASE WHEN {test.format(k=k)} THEN {1 << unit * k} ELSE 0 END" for k in range(len(STEPS))) + " AS BIGINT)"


def _plain(rings: Column) -> Column:
    """Whether an extract's rings are its box."""
    ring = F.get(F.get(rings, F.lit(0)), F.lit(0))
    xs, ys = (F.transform(ring, lambda p: p[c]) for c in ("x", "y"))
    same = (F.array_min(xs) == F.col("minx")) & (F.array_max(xs) == F.col("maxx")) & (F.array_min(ys) == F.col("miny")) & (F.array_max(ys) == F.col("maxy"))
    return F.coalesce(g.is_box(rings) & same, F.lit(False))


def _rays() -> Column:
    """Bits of the samples of a box that rings hold.  Long to put together, so made once for several joins."""
    grid = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(1 << k).cast("long").alias("bit")) for k, (a, b) in enumerate(_GRID)])

    def in_rings(s: Column) -> Column:
        px, py = F.col("minx") + (F.col("maxx") - F.col("minx")) * s["a"], F.col("miny") + (F.col("maxy") - F.col("miny")) * s["b"]
        return F.exists("rings", lambda poly: point_in_ring_wrapped(px, py, poly[0]) & ~F.exists(
            F.slice(poly, 2, F.greatest(F.size(poly) - 1, F.lit(0))), lambda h: point_in_ring_wrapped(px, py, h)))

    return F.aggregate(F.filter(grid, in_rings), F.lit(0).cast("long"), lambda a, s: a + s["bit"])


def _hits(pairs: DataFrame, extracts: DataFrame, rays: Column | None) -> DataFrame:
    """Adds hits and points to pairs (box, id, minx..maxy, eminx..emaxy, plain, ...): which of the 25 samples of the box the extract holds, as bits.

    An extract that is its box, and so near that nothing wraps, is asked by comparisons, with the ray cast's tolerance on its edges; only the
    others' rings are joined, and none if ``rays`` is None.
    """
    easy = F.lit(True) if rays is None else _easy()
    boxed = pairs.where(easy).selectExpr("*", *[f"min{c} + (max{c} - min{c}) * {s}D AS _{c}{k}" for c in "xy" for k, s in enumerate(STEPS)])
    inside = lambda c, unit: _bits(unit, f"_{c}{{k}} BETWEEN emin{c} AND emax{c}")
    on = lambda c, o, unit: _bits(unit, f"least(abs(_{c}{{k}} - emin{c}), abs(_{c}{{k}} - emax{c})) * (emax{o} - emin{o}) <= 1e-10D")
    boxed = boxed.selectExpr("*", f"{inside('x', len(STEPS))} AS _xin", f"{inside('y', 1)} AS _yin", f"{on('x', 'y', len(STEPS))} AS _xon", f"{on('y', 'x', 1)} AS _yon")
    boxed = _once(boxed, "points", F.when(_within(), F.lit(ALL).cast("long")).otherwise(F.expr("_xin * _yin | _xon * _yin | _xin * _yon"))).select(*pairs.columns, "points")
    if rays is None:
        return boxed.withColumn("hits", F.bit_count("points").cast("long"))
    ringed = _once(pairs.where(~easy).join(extracts.where("rings IS NOT NULL").select("id", "rings"), "id"), "points", rays).drop("rings")
    return union_features(boxed, ringed).withColumn("hits", F.bit_count("points").cast("long"))


def _easy() -> Column:
    return F.col("plain") & ((F.col("maxx") - F.col("minx")) + (F.col("emaxx") - F.col("eminx")) < 180.0)


def _within() -> Column:
    return (F.col("minx") >= F.col("eminx")) & (F.col("maxx") <= F.col("emaxx")) & (F.col("miny") >= F.col("eminy")) & (F.col("maxy") <= F.col("emaxy"))


def _touch() -> Column:
    return (F.col("minx") <= F.col("emaxx")) & (F.col("maxx") >= F.col("eminx")) & (F.col("miny") <= F.col("emaxy")) & (F.col("maxy") >= F.col("eminy"))


def sample_hits(boxes: DataFrame, extracts: DataFrame) -> DataFrame:
    """(box, id, hits, points): which of a box's 25 sample points each extract (id, minx..maxy, rings) that it touches holds."""
    ex = extracts.select("id", *[F.col(c).alias("e" + c) for c in BOX], _plain(F.col("rings")).alias("plain"))
    grid = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in _GRID])
    points = F.filter(grid, lambda s, i: F.call_function("shiftright", F.col("points"), i).bitwiseAND(F.lit(1)) == 1)
    return _hits(_cell_pairs(boxes, ex), extracts, _rays()).select("box", "id", "hits", points.alias("points"))


# A cell is named by the class of its extracts, its side and its place; a box is in the cell of its lower-left corner.
KEY = ("class", "side", "cx", "cy")
BLOCK = 8  # cells a side of a block
FINEST = 2.0 ** -10  # degrees, of cells


def _power(wide: Column, high: Column, parts: float) -> Column:
    """A power of two, near the longer side over parts."""
    return F.greatest(F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(wide, high)))) / parts, F.lit(FINEST))


def _placed(boxes: DataFrame, classes: DataFrame) -> DataFrame:
    """Boxes (box, minx..maxy, ...) in a cell for each class of extracts: an eighth of their length or half the box's, whichever is more."""
    side = F.greatest("class", _power(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"), 2.0))
    # a power of two each, so they are few
    return boxes.crossJoin(F.broadcast(classes)).withColumn("side", side).withColumns({"cx": F.floor(F.col("minx") / F.col("side")), "cy": F.floor(F.col("miny") / F.col("side"))})


def _reach(placed: DataFrame) -> DataFrame:
    """A row a cell: least and greatest edges of the boxes in it, and their greatest sides."""
    ends = [f(c).alias(f"{c}_{n}") for c in BOX for n, f in (("lo", F.min), ("hi", F.max))]
    return placed.groupBy(*KEY).agg(*ends, F.max(F.col("maxx") - F.col("minx")).alias("wide"), F.max(F.col("maxy") - F.col("miny")).alias("high"))


def _spread(extracts: DataFrame, spans: DataFrame, margin: bool) -> DataFrame:
    """Extracts with the sides of cells their class has and the cells (x0..y1) of boxes whose lower-left corner they hold; with margin, of those they touch."""
    df = extracts.join(F.broadcast(spans), "class")
    first = lambda c, w: F.floor((F.col(f"emin{c}") - F.greatest(F.lit(0.0), w)) / F.col("side") - 1e-6) if margin else F.floor(F.col(f"emin{c}") / F.col("side"))
    df = df.withColumns({"x0": first("x", F.col("wide")), "y0": first("y", F.col("high")), "x1": F.floor(F.col("emaxx") / F.col("side")), "y1": F.floor(F.col("emaxy") / F.col("side"))})
    return df.where("x0 <= x1 AND y0 <= y1").drop("wide", "high")


def _in_cells(spread: DataFrame, reach: DataFrame) -> DataFrame:
    """A row for each cell with boxes that an extract of ``_spread`` may touch."""
    steps = lambda c: F.explode(F.sequence(f"{c}0", f"{c}1"))
    each = spread.withColumn("cx", steps("x")).withColumn("cy", steps("y")).drop("x0", "x1", "y0", "y1")
    return each.join(reach, [*KEY]).where(
        (F.col("minx_lo") <= F.col("emaxx")) & (F.col("maxx_hi") >= F.col("eminx")) & (F.col("miny_lo") <= F.col("emaxy")) & (F.col("maxy_hi") >= F.col("eminy")))


def _holds_some() -> Column:
    """Whether an extract may contain a box of the cell."""
    return (F.col("minx_hi") >= F.col("eminx")) & (F.col("maxx_lo") <= F.col("emaxx")) & (F.col("miny_hi") >= F.col("eminy")) & (F.col("maxy_lo") <= F.col("emaxy"))


def _holds_all() -> Column:
    """Whether an extract that is its box contains every box of the cell."""
    inside = [(F.col(f"{c}_lo") >= F.col(f"emin{c[-1]}")) & (F.col(f"{c}_hi") <= F.col(f"emax{c[-1]}")) for c in BOX]
    return F.coalesce(F.col("plain") & (F.col("wide") + (F.col("emaxx") - F.col("eminx")) < 180.0) & inside[0] & inside[1] & inside[2] & inside[3], F.lit(False))


def _containers(pairs: DataFrame, extracts: DataFrame, rays: Column | None) -> DataFrame:
    """Pairs whose extract contains the box and all its samples; one that is its box holds all samples of what it contains: nothing to be asked."""
    near = pairs.where(_touch() & _within())
    if rays is None:
        return near
    return union_features(near.where(_easy()), _hits(near.where(~_easy()), extracts, rays).where(F.col("hits") == len(_GRID)).drop("hits", "points"))


PART = ("parent", "class", "side", "bx", "by")


def _blocks(siblings: DataFrame, spans: DataFrame) -> DataFrame:
    """Siblings in the blocks of cells that they touch, dealt so that those of one parent and block meet: a cell for each would be too much to shuffle."""
    steps = lambda c: F.explode(F.sequence(F.floor(F.col(f"{c}0") / BLOCK), F.floor(F.col(f"{c}1") / BLOCK)))
    df = _spread(siblings, spans, True).withColumn("bx", steps("x")).withColumn("by", steps("y"))
    cut = {f"{c}{k}": f(F.col(f"{c}{k}"), F.col(f"b{c}") * BLOCK + k * (BLOCK - 1)) for c in "xy" for k, f in ((0, F.greatest), (1, F.least))}
    return df.withColumns(cut).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *PART)


def _sibling_pairs(blocks: DataFrame, placed: DataFrame, reach: DataFrame) -> DataFrame:
    """(box, id, parent, ...): boxes with the siblings of every parent that may be the best to hold all their samples together.

    A parent whose children surely share out each box of a cell bounds what the others there may weigh: by the sum of all that may
    take part, ties by parent.  One that weighs more, even by those alone that surely take part, is best nowhere in the cell.
    """
    cells = _in_cells(blocks, reach)

    # a sample of the cell's boxes lies between two ends that rise with its step, so an extract holds surely, or possibly, the steps that are left
    # after some at the start and some at the end; roundings and what is near an edge, which a ray cast takes for inside, make less sure and more possible
    last = len(STEPS) - 1
    easy = ["plain", "wide + (emaxx - eminx) < 180", *[f"emax{c} > emin{c} AND max{c}_lo >= min{c}_lo AND max{c}_hi >= min{c}_hi" for c in "xy"]]
    slack = lambda c: f"(greatest(abs(min{c}_lo), abs(max{c}_hi), abs(min{c}_hi), abs(max{c}_lo)) + 1) * 1e-12D"
    asked = cells.selectExpr("*", f"coalesce({' AND '.join(easy)}, false) AS easy", *[f"{slack(c)} AS _s{c}" for c in "xy"], *[
        f"{slack(c)} + coalesce(try_divide(2e-10D, emax{o} - emin{o}), 0) AS _n{c}" for c, o in ("xy", "yx")])
    early = lambda c, w, edge, by: f"CASE WHEN min{c}_{w} >= {edge} THEN 0 WHEN max{c}_{w} < {edge} THEN {last + 1} ELSE ceil(({edge} - min{c}_{w}) * {last} / (max{c}_{w} - min{c}_{w}) {by} 1e-9D) END"
    late = lambda c, w, edge, by: f"CASE WHEN max{c}_{w} <= {edge} THEN 0 WHEN min{c}_{w} > {edge} THEN {last + 1} ELSE ceil((max{c}_{w} - {edge}) * {last} / (max{c}_{w} - min{c}_{w}) {by} 1e-9D) END"
    # two that meet, each across the whole cell's reach the other way, hold all between them wherever their seam is
    spans = lambda c: f"easy AND emin{c} <= min{c}_lo - _s{c} AND emax{c} >= max{c}_hi + _s{c}"
    ends = [f"IF({spans(o)} AND {v}, {e}, NULL) AS {n}" for c, o in ("xy", "yx") for n, e, v in (
        (f"_low{c}", f"emax{c}", f"emin{c} <= min{c}_lo - _s{c}"), (f"_high{c}", f"emin{c}", f"emax{c} >= max{c}_hi + _s{c}"))]
    reached = ["_lowx", "_highx", "_lowy", "_highy"]
    asked = asked.selectExpr(*PART, "cx", "cy", "area", "easy", *ends, *[f"CAST({v} AS INT) AS {n}{c}" for c in "xy" for n, v in (
        ("_a", early(c, "lo", f"(emin{c} + _s{c})", "+")), ("_b", late(c, "hi", f"(emax{c} - _s{c})", "+")), ("_c", early(c, "hi", f"(emin{c} - _n{c})", "-")), ("_d", late(c, "lo", f"(emax{c} + _n{c})", "-")))])
    kept = lambda a, b, c, unit: f"greatest(0L, (shiftleft(1L, {unit} * ({last + 1} - {b}{c})) - shiftleft(1L, {unit} * {a}{c})) div {(1 << unit) - 1})"
    both = lambda a, b: f"{kept(a, b, 'x', last + 1)} * {kept(a, b, 'y', 1)}"
    asked = asked.selectExpr(*PART, "cx", "cy", "area", *reached, f"IF(easy, {both('_a', '_b')}, 0) AS _sure", f"IF(easy, {both('_c', '_d')}, {ALL}) AS _may")
    asked = _once(_once(asked, "sure", F.col("_sure")), "may", F.col("_may")).where("may != 0")
    sure = F.col("sure") != 0
    found = asked.groupBy(*PART, "cx", "cy").agg(
        F.bit_or("sure").alias("sure"), F.bit_or("may").alias("may"), F.count("*").alias("n"), F.count_if(sure).alias("n_sure"), F.min("area").alias("least"),
        F.sum("area").alias("total"), F.sum(F.when(sure, F.col("area"))).alias("total_sure"), F.bool_and(F.coalesce(F.col("area") >= 0, F.lit(False))).alias("weighed"),
        *[(F.max if "low" in c else F.min)(c).alias(c) for c in reached])
    shared = F.coalesce(F.bit_count("sure") == len(_GRID), F.lit(False)) | F.coalesce(F.expr("_lowx >= _highx"), F.lit(False)) | F.coalesce(F.expr("_lowy >= _highy"), F.lit(False))
    # sums of two are exact in any order, longer ones to a rounding
    most = F.col("total") * F.when(F.col("n") <= 2, 1.0).otherwise(1 + 1e-9)
    fewest = F.greatest(F.col("least") * 2, F.col("total_sure") * F.when(F.col("n_sure") <= 2, 1.0).otherwise(1 - 1e-9))
    weigh = lambda total: F.struct(total.alias("total"), F.col("parent").alias("parent"))
    groups = settled(found.where((F.bit_count("may") == len(_GRID)) & (F.col("n") > 1)).select(
        *PART, "cx", "cy", "weighed", fewest.alias("fewest"), F.when(F.col("weighed") & shared & (F.col("n_sure") > 1), most).alias("most")), "groups")
    bounds = settled(groups.where("most IS NOT NULL").groupBy(*KEY).agg(F.min(weigh(F.col("most"))).alias("bound")), "bounds")
    left = groups.join(bounds, [*KEY], "left").where(F.col("bound").isNull() | ~F.col("weighed") | (weigh(F.col("fewest")) <= F.col("bound"))).select(*PART, "cx", "cy")
    members = blocks.join(left, [*PART]).where("cx BETWEEN x0 AND x1 AND cy BETWEEN y0 AND y1").drop("bx", "by", "x0", "x1", "y0", "y1")
    n = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda df: df.repartition(n, *KEY)
    return dealt(placed).join(dealt(members).hint("shuffle_hash"), [*KEY]).where(_touch()).drop(*KEY)


def select_coverage(boxes: DataFrame, extracts: DataFrame) -> DataFrame:
    """(box, ids): the extracts chosen for each box; no row if none contains it.

    Two to four administrative siblings that together hold all samples win (least total area); else the
    smallest container, replaced at borders with siblings by the smallest non-administrative one, and by
    a cached container of at most six times the area.
    ``extracts``: (id, parent, admin ARRAY<STRING>, cached, area, minx..maxy, rings).

    Boxes meet only what can be chosen in their cell: an extract that contains all boxes of a cell bounds by its rank (area, then id) what
    they can be given, and a pair of siblings that all of them lie across bounds what groups may weigh.  Extracts of other shapes than
    their box are bounded by those, but bound nothing themselves.
    """
    ex = extracts.repartition("id").select("id", "parent", F.size("admin").alias("codes"), "cached", "area", *[F.col(c).alias("e" + c) for c in BOX], _plain(F.col("rings")).alias("plain")).withColumn(
        "class", _power(F.col("emaxx") - F.col("eminx"), F.col("emaxy") - F.col("eminy"), 8.0))
    ex = settled(running_totals(ex, (), ("area", "id"), rank=F.lit(1).cast("long")).repartition("rank"), "extracts")
    placed = _placed(boxes.select("box", *BOX).where(" AND ".join(f"{c} IS NOT NULL" for c in BOX)).repartition("box"), ex.select("class").distinct())
    reach = settled(_reach(placed), "reach")
    spans = reach.groupBy("class", "side").agg(F.max("wide").alias("wide"), F.max("high").alias("high"))

    # where all extracts are boxes, and none so wide that it may wrap, no plan carries the ray cast
    plain = F.coalesce(F.col("plain") & (F.col("wide") + (F.col("emaxx") - F.col("eminx")) < 180.0), F.lit(False))
    rays = None if ex.crossJoin(F.broadcast(spans.agg(F.max("wide").alias("wide")))).where(~plain).isEmpty() else _rays()
    own = ["rank", "id", "codes", "area", "plain", *["e" + c for c in BOX]]
    order, open_to_all = F.struct("area", "id"), F.coalesce("codes", F.lit(0)) <= 0
    near = lambda some, cells: _in_cells(_spread(some, spans, False), cells).where(_holds_some())
    least = near(ex, reach).where(_holds_all()).groupBy(*KEY).agg(F.min("rank").alias("least"), F.min(F.when(open_to_all, F.col("rank"))).alias("least_open"))
    bounded = settled(reach.join(least, [*KEY], "left"), "bounded")
    may = (F.col("rank") <= F.coalesce("least", "rank")) | (open_to_all & (F.col("rank") <= F.coalesce("least_open", "rank")))
    found = settled(near(ex, bounded).where(may).select(*KEY, *own), "containers")
    best = _containers(placed.join(found, [*KEY]), extracts, rays).groupBy("box").agg(
        *[F.first(c).alias(c) for c in BOX], F.min("rank").alias("rank"), F.min(F.when(open_to_all, F.col("rank"))).alias("rank_open"))
    best = settled(best.join(ex.select("rank", F.struct("area", "id", "parent", "codes").alias("small")), "rank").join(
        ex.select(F.col("rank").alias("rank_open"), order.alias("plain")), "rank_open", "left").drop("rank", "rank_open"), "best")

    # only siblings count where they hold a part of the box; those of one parent share their cells
    siblings = ex.where(F.col("parent").isNotNull() & (F.col("codes") > 0))
    blocks = _blocks(siblings.drop("class").join(siblings.groupBy("parent").agg(F.max("class").alias("class")), "parent"), spans)
    hits = _hits(_sibling_pairs(blocks, placed, reach), extracts, rays).where("hits > 0")
    groups = hits.groupBy("box", "parent").agg(
        F.count("*").alias("members"), F.sum("area").alias("total"), F.bit_count(F.bit_or("points")).alias("covered"), F.array_sort(F.collect_list(order)).alias("ids"))
    plans = groups.where((F.col("covered") == len(_GRID)) & (F.col("members") > 1)).groupBy("box").agg(
        F.min(F.struct("total", "parent", "ids")).alias("plan"))
    edge = best.where((F.col("small.codes") > 0) & F.col("plain").isNotNull()).select("box", *BOX, F.col("small.parent").alias("parent"), F.col("small.id").alias("sid"))
    edge = _placed(edge, ex.select("class").distinct()).withColumns({f"b{c}": F.floor(F.col(f"c{c}") / BLOCK) for c in "xy"})
    crowd = edge.join(blocks, [*PART]).where(_touch() & (F.col("id") != F.col("sid")) & F.col("cx").between(F.col("x0"), F.col("x1")) & F.col("cy").between(F.col("y0"), F.col("y1")))
    beside = settled(_hits(crowd, extracts, rays).where("hits > 0").select("box").distinct().withColumn("beside", F.lit(True)), "beside")
    safe = F.when(F.col("beside"), F.col("plain")).otherwise(F.struct("small.area", "small.id"))
    chosen = best.join(beside, "box", "left").select("box", *BOX, safe.alias("safe"))

    # of the cached containers, the first that is no smaller: bounded for each area that a box of the cell can be given
    kept = ex.where("cached")
    large = F.col("area").between(F.col("from"), F.col("from") * 6)
    given = best.select("box", *BOX, F.explode(F.array_distinct(F.array("small.area", "plain.area"))).alias("from"))
    wanted = settled(_placed(given, kept.select("class").distinct()).select(*KEY, "from").distinct(), "wanted")
    least = near(kept, reach).where(_holds_all()).join(wanted, [*KEY]).where(large).groupBy(*KEY, "from").agg(F.min("rank").alias("least"))
    wanted = settled(wanted.join(least, [*KEY, "from"], "left"), "wanted_bounded")
    found = settled(near(kept, reach).join(wanted, [*KEY]).where(large & (F.col("rank") <= F.coalesce("least", "rank"))).select(*KEY, "from", *own), "cached")
    cached = _containers(_placed(chosen.withColumn("from", F.col("safe.area")), kept.select("class").distinct()).join(found, [*KEY, "from"]), extracts, rays).groupBy("box").agg(
        F.min(order).alias("cached"))
    together = F.size("plan.ids").between(2, 4)
    return chosen.join(plans, "box", "left").join(cached, "box", "left").select("box", F.when(F.coalesce(together, F.lit(False)), F.transform("plan.ids", lambda x: x["id"])).otherwise(
        F.array(F.coalesce("cached", "safe")["id"])).alias("ids"))


def list_coverage(boxes: DataFrame, extracts: DataFrame) -> DataFrame:
    """(box, id, area): intersecting extracts; children of a root only, where there are any."""
    roots = extracts.where("parent IS NULL").select(F.col("id").alias("parent")).withColumn("top", F.lit(True))
    cell = touching(boxes, extracts).join(extracts.select("id", "parent", "area"), "id").join(roots, "parent", "left")
    some = cell.groupBy("box").agg(F.max(F.coalesce("top", F.lit(False))).alias("some"))
    return cell.join(some, "box").where(~F.col("some") | F.coalesce("top", F.lit(False))).select("box", "id", "area")


def coverage_by_id(boxes: DataFrame, extracts: DataFrame, wanted: list[str]) -> DataFrame:
    """(box, id, ok): whether each wanted extract exists and intersects the box."""
    w = boxes.select("box", F.explode(F.array(*map(F.lit, wanted))).alias("id"))
    met = touching(boxes, extracts).withColumn("ok", F.lit(True))
    return w.join(met, ["box", "id"], "left").select("box", "id", F.coalesce("ok", F.lit(False)).alias("ok"))
