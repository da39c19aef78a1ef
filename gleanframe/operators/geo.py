"""Planar polygons as nested arrays: centroids, areas, a coverage dissolve and its polygons.

A polygon is ``rings: array<array<struct<x,y>>>``, each ring closed, outer rings
counter-clockwise and holes clockwise. Coordinates are projected metres.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from gleanframe.operators.joins import enrich
from gleanframe.session import materialise


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def rectangle(x: Column, y: Column, width: float, height: float) -> Column:
    """Rings of an axis-parallel rectangle with its lower left corner at (x, y)."""
    w, h = F.lit(float(width)), F.lit(float(height))
    return F.array(F.array(_point(x, y), _point(x + w, y), _point(x + w, y + h), _point(x, y + h), _point(x, y)))


def square(x: Column, y: Column, side: float) -> Column:
    """Rings of an axis-parallel square with its lower left corner at (x, y)."""
    return rectangle(x, y, side, side)


def edges(df: DataFrame, keys: Sequence[str], rings: str = "rings") -> DataFrame:
    """One row per directed ring edge: ``x0, y0, x1, y1``."""
    ring = df.select(*keys, F.explode(rings).alias("r"))
    pairs = F.arrays_zip(
        F.slice("r", F.lit(1), F.size("r") - 1).alias("a"), F.slice("r", F.lit(2), F.size("r") - 1).alias("b")
    )
    e = ring.select(*keys, F.explode(pairs).alias("e"))
    return e.select(*keys, *[F.col(f"e.{p}.{c}").alias(f"{c}{i}") for i, p in enumerate("ab") for c in "xy"])


def area_and_centroid(df: DataFrame, keys: Sequence[str], rings: str = "rings") -> DataFrame:
    """Area and area-weighted centroid per key.

    The edge sums add up, so the centroid of a fused zone needs no fused outline.
    Map-side combined: each task sends one row per key.
    """
    cross = F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")
    sums = edges(df, keys, rings).groupBy(*keys).agg(
        (F.sum(cross) / 2).alias("area"),
        (F.sum((F.col("x0") + F.col("x1")) * cross) / 6).alias("__mx"),
        (F.sum((F.col("y0") + F.col("y1")) * cross) / 6).alias("__my"),
    )
    return sums.select(
        *keys, "area", F.try_divide("__mx", "area").alias("cx"), F.try_divide("__my", "area").alias("cy")
    )


def dissolve_edges(df: DataFrame, keys: Sequence[str], rings: str = "rings") -> DataFrame:
    """Outline of the union per key, as directed edges.

    In a clean coverage (shared corners identical, no overlap) an inner border occurs
    once in each direction; the two cancel in a map-side combined count.
    """
    e = edges(df, keys, rings)
    forward = (F.col("x0") < F.col("x1")) | ((F.col("x0") == F.col("x1")) & (F.col("y0") <= F.col("y1")))
    flip = lambda a, b: F.when(forward, F.col(a)).otherwise(F.col(b))
    undirected = e.select(
        *keys, flip("x0", "x1").alias("xa"), flip("y0", "y1").alias("ya"), flip("x1", "x0").alias("xb"),
        flip("y1", "y0").alias("yb"), F.when(forward, 1).otherwise(-1).alias("d"),
    )
    net = undirected.groupBy(*keys, "xa", "ya", "xb", "yb").agg(F.sum("d").alias("d")).filter("d <> 0")
    ahead = F.col("d") > 0
    turn = lambda a, b: F.when(ahead, F.col(a)).otherwise(F.col(b))
    return net.select(
        *keys, turn("xa", "xb").alias("x0"), turn("ya", "yb").alias("y0"), turn("xb", "xa").alias("x1"), turn("yb", "ya").alias("y1")
    )


def outline_rings(outline: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Order outline edges into rings: adds ``ring`` (its smallest edge) and ``seq`` (1-based).

    Each edge learns its successor (at a corner shared by several rings, the sharpest
    right turn, which keeps rings simple), then pointer doubling finds every ring's first
    edge and the distance to it: a round per doubling of the longest ring, each a plain
    equi-join, so no ring or key is ever gathered in one task. Rounds stop when no edge
    changes.
    """
    keys = list(keys)
    edge = F.struct("x0", "y0", "x1", "y1")
    heading = F.atan2(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0"))
    e = outline.select(*keys, edge.alias("e"), heading.alias("h"))
    arrive = e.select(*keys, F.col("e"), F.col("h"), F.struct("e.x1", "e.y1").alias("v"))
    leave = e.select(*keys, F.col("e").alias("next"), F.col("h").alias("nh"), F.struct("e.x0", "e.y0").alias("v2"))
    # a corner of a clean coverage has a handful of leaving edges
    links = enrich(
        arrive, leave.withColumnRenamed("v2", "v"), keys + ["v"], how="inner"
    )
    pi = 3.141592653589793
    turned = F.col("nh") - F.col("h")
    turned = F.when(turned > pi, turned - 2 * pi).when(turned <= -pi, turned + 2 * pi).otherwise(turned)
    # rounded, so that a straight reversal sorts last rather than first
    right = F.when(F.round(turned, 9) <= F.lit(-3.141592653), pi).otherwise(turned)
    state = links.groupBy(*keys, "e").agg(F.min_by("next", right).alias("to"))
    # low: smallest edge seen so far ahead, steps: distance to it
    state = materialise(
        state.select(*keys, "e", F.col("to"), F.least("e", "to").alias("low"),
                     F.when(F.col("to") < F.col("e"), 1).otherwise(0).cast("bigint").alias("steps"))
    )
    hop = 1
    while True:
        ahead = state.select(
            *keys, F.col("e").alias("to"), F.col("to").alias("to2"), F.col("low").alias("low2"), F.col("steps").alias("steps2")
        )
        better = F.col("low2") < F.col("low")
        moved = enrich(state, ahead, keys + ["to"], how="inner").select(
            *keys, "e", F.col("to2").alias("to"), F.least("low", "low2").alias("low"),
            F.when(better, F.col("steps2") + hop).otherwise(F.col("steps")).alias("steps"), better.alias("changed"),
        )
        moved = materialise(moved)
        state = moved.drop("changed")
        hop *= 2
        if moved.filter("changed").limit(1).count() == 0:
            break
    ring_size = state.groupBy(*keys, "low").agg(F.count(F.lit(1)).alias("n"))
    out = enrich(state, ring_size, keys + ["low"], how="inner")
    seq = F.when(F.col("steps") == 0, 1).otherwise(F.col("n") - F.col("steps") + 1)
    return out.select(*keys, F.col("low").alias("ring"), seq.alias("seq"), "e.x0", "e.y0", "e.x1", "e.y1")


class BrokenCoverage(ValueError):
    """Polygons that overlap, or whose borders do not close."""


def cells_of_edges(e: DataFrame, cell: float) -> DataFrame:
    """Edges repeated for the grid cells (``gx``, ``gy``) they pass: column by column, the rows between where they enter and leave."""
    low, high = F.least("x0", "x1"), F.greatest("x0", "x1")
    columns = F.sequence(F.floor(low / cell), F.floor(high / cell))
    per_column = e.withColumn("gx", F.explode(columns))
    # a border point belongs to both sides, so edges reach a hair into the next cell
    left, right = F.greatest(low, F.col("gx") * cell), F.least(high, (F.col("gx") + 1) * cell)
    slope = F.try_divide(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0"))
    at = lambda x: F.col("y0") + (x - F.col("x0")) * slope
    upright = F.col("x0") == F.col("x1")
    ends = [F.when(upright, F.col("y0")).otherwise(at(left)), F.when(upright, F.col("y1")).otherwise(at(right))]
    rows = F.sequence(F.floor(F.least(*ends) / cell - 1e-9), F.floor(F.greatest(*ends) / cell + 1e-9))
    return per_column.withColumn("gy", F.explode(rows))


def split_at_corners(e: DataFrame, keys: Sequence[str], cell: float, tolerance: float = 0.0) -> DataFrame:
    """Edges cut at every corner of the same key that lies on them (T-junctions).

    Corners meet only the edges that pass their grid cell. ``tolerance`` is how far beside an edge a
    corner may lie.
    """
    keys = list(keys)
    edge = ["x0", "y0", "x1", "y1"]
    corners = e.select(*keys, F.col("x0").alias("px"), F.col("y0").alias("py")).distinct()
    corners = corners.withColumns({"gx": F.floor(F.col("px") / cell), "gy": F.floor(F.col("py") / cell)})
    distinct = e.select(*keys, *edge).distinct()
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    along = ((F.col("px") - F.col("x0")) * dx + (F.col("py") - F.col("y0")) * dy) / (dx * dx + dy * dy)
    beside = F.abs((F.col("px") - F.col("x0")) * dy - (F.col("py") - F.col("y0")) * dx) / F.sqrt(dx * dx + dy * dy)
    met = cells_of_edges(distinct, cell).join(corners, [*keys, "gx", "gy"]).withColumns({"along": along, "beside": beside})
    inside = met.filter((F.col("along") > 0) & (F.col("along") < 1) & (F.col("beside") <= tolerance))
    # as many cuts as an edge has corners on it
    cuts = inside.groupBy(*keys, *edge).agg(F.array_sort(F.collect_set(F.struct("along", "px", "py"))).alias("cuts"))
    cut = e.join(cuts, [*keys, *edge], "left")
    inner = F.transform(F.coalesce("cuts", F.array()), lambda c: _point(c["px"], c["py"]))
    stops = F.concat(F.array(_point(F.col("x0"), F.col("y0"))), inner, F.array(_point(F.col("x1"), F.col("y1"))))
    pairs = F.arrays_zip(F.slice(stops, 1, F.size(stops) - 1).alias("a"), F.slice(stops, 2, F.size(stops) - 1).alias("b"))
    parts = cut.select(*keys, F.explode(pairs).alias("e"))
    return parts.select(*keys, *[F.col(f"e.{p}.{c}").alias(f"{c}{i}") for i, p in enumerate("ab") for c in "xy"])


def clean_outline(e: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Outline of directed edges per key, as ``dissolve_edges`` has it, checked.

    Raises ``BrokenCoverage`` if an edge is left more than once (an overlap), or if a corner has not
    as many edges that arrive as edges that leave (a border that does not close).
    """
    keys = list(keys)
    forward = F.struct("x0", "y0") <= F.struct("x1", "y1")
    flip = lambda a, b: F.when(forward, F.col(a)).otherwise(F.col(b))
    undirected = e.select(
        *keys, flip("x0", "x1").alias("xa"), flip("y0", "y1").alias("ya"), flip("x1", "x0").alias("xb"), flip("y1", "y0").alias("yb"),
        F.when(forward, 1).otherwise(-1).alias("d"),
    )
    net = undirected.groupBy(*keys, "xa", "ya", "xb", "yb").agg(F.sum("d").alias("d")).filter("d <> 0")
    net = materialise(net)
    twice = net.filter("abs(d) > 1").limit(1).collect()
    if twice:
        raise BrokenCoverage(f"polygons overlap at an edge: {twice[0]}")
    ahead = F.col("d") > 0
    turn = lambda a, b: F.when(ahead, F.col(a)).otherwise(F.col(b))
    out = net.select(*keys, turn("xa", "xb").alias("x0"), turn("ya", "yb").alias("y0"), turn("xb", "xa").alias("x1"), turn("yb", "ya").alias("y1"))
    ends = F.explode(F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y"), F.lit(1).alias("d")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"), F.lit(-1).alias("d"))))
    corners = out.select(*keys, ends.alias("v")).groupBy(*keys, "v.x", "v.y").agg(F.sum("v.d").alias("open"))
    loose = corners.filter("open <> 0").limit(1).collect()
    if loose:
        raise BrokenCoverage(f"a border does not close at a corner: {loose[0]}")
    return out


def hold_holes(rings: DataFrame, keys: Sequence[str], band: float) -> DataFrame:
    """(keys, ring, outer): the outer ring that holds each hole; an outer ring holds itself.

    ``rings`` are ordered edges as ``outline_rings`` gives them. The middle of a hole's first edge
    lies on no other ring, so an outer ring holds the hole if it crosses the ray from there to the
    right an odd number of times; of several the one of least area is taken. Edges meet only the
    points of their bands of height ``band``.
    """
    keys = list(keys)
    cross = F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")
    sizes = materialise(rings.groupBy(*keys, "ring").agg((F.sum(cross) / 2).alias("area")))
    first = rings.filter("seq = 1").select(*keys, "ring", ((F.col("x0") + F.col("x1")) / 2).alias("px"), ((F.col("y0") + F.col("y1")) / 2).alias("py"))
    holes = first.join(sizes.filter("area < 0"), [*keys, "ring"]).drop("area").withColumnRenamed("ring", "hole")
    holes = holes.withColumn("band", F.floor(F.col("py") / band))
    outer = rings.join(sizes.filter("area > 0"), [*keys, "ring"]).filter("y0 <> y1")
    reach = F.sequence(F.floor(F.least("y0", "y1") / band), F.floor(F.greatest("y0", "y1") / band))
    met = outer.withColumn("band", F.explode(reach)).join(holes, [*keys, "band"])
    spans = (F.col("y0") <= F.col("py")) != (F.col("y1") <= F.col("py"))
    at = F.col("x0") + (F.col("py") - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))
    crossed = met.filter(spans & (at > F.col("px"))).groupBy(*keys, "hole", "ring", "area").agg((F.count(F.lit(1)) % 2).alias("odd")).filter("odd = 1")
    holders = crossed.groupBy(*keys, "hole").agg(F.min_by("ring", F.struct("area", "ring")).alias("outer"))
    own = sizes.filter("area > 0").select(*keys, "ring", F.col("ring").alias("outer"))
    return own.unionByName(holders.withColumnRenamed("hole", "ring").select(*keys, "ring", "outer"))


def dissolve(
    df: DataFrame, keys: Sequence[str], attributes: Sequence[str] = (), order: Sequence[str] = (), rings: str = "rings",
    cell: float | None = None, tolerance: float = 0.0,
) -> DataFrame:
    """One row per key: ``polygons``, the union's polygons with their rings, and the first value of each attribute.

    A polygon is a list of closed rings, its outer ring (counter-clockwise) first, then its holes
    (clockwise); polygons and holes are in the order of their least corners. Corners of a neighbour
    on an edge (T-junctions) cut the edge, so neighbours of other sizes fuse. Parts that touch in a
    corner only are one polygon, whose ring passes the corner twice; holes that do are two. The first row of a key
    is that of the least ``order`` values (nulls last); its attributes are taken, nulls too. Rows without rings give
    attributes only (``polygons`` null), and so does a null key. Overlaps and open borders raise
    ``BrokenCoverage``. ``cell`` is the side of the index cells: by default the mean extent of edges.
    """
    keys = list(keys)
    e = materialise(edges(df, keys, rings))
    if cell is None:
        cell = e.agg(F.avg(F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))))).first()[0] or 1.0
    outline = clean_outline(split_at_corners(e, keys, cell, tolerance), keys)
    ordered = materialise(outline_rings(outline, keys))
    holders = hold_holes(ordered, keys, cell)
    # a ring is one value of the result, and so are a polygon and all polygons of a key
    corners = F.transform(F.array_sort(F.collect_list(F.struct("seq", "x0", "y0"))), lambda p: _point(p["x0"], p["y0"]))
    shape = ordered.groupBy(*keys, "ring").agg(corners.alias("open")).select(*keys, "ring", F.concat("open", F.slice("open", 1, 1)).alias("line"))
    placed = shape.join(holders, [*keys, "ring"], "left")
    lost = placed.filter("outer IS NULL").limit(1).collect()
    if lost:
        raise BrokenCoverage(f"a hole lies in no outer ring: {lost[0]['ring']}")
    inner = F.col("ring") != F.col("outer")
    each = placed.groupBy(*keys, "outer").agg(F.array_sort(F.collect_list(F.struct(inner.alias("inner"), "ring", "line"))).alias("parts"))
    whole = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("outer", F.transform("parts", lambda p: p["line"]).alias("rings")))).alias("all"))
    polygons = whole.select(*keys, F.transform("all", lambda p: p["rings"]).alias("polygons"))
    rank = F.struct(*[x for c in order for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))]) if order else F.lit(0)
    firsts = df.groupBy(*keys).agg(F.min_by(F.struct(F.lit(0).alias("__"), *attributes), rank).alias("first"))
    firsts = firsts.select(*keys, *[F.col(f"first.{a}").alias(a) for a in attributes])
    return enrich(firsts, polygons, keys)


def scan_polygons(spark: SparkSession, path: str, rings: str = "rings") -> DataFrame:
    """Read a stored polygon table; its rings must be lists of lists of points with numbers x and y."""
    df = spark.read.parquet(path)
    kind = df.schema[rings].dataType if rings in df.columns else None
    point = kind.elementType.elementType if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType) else None
    numbers = {f.name for f in point.fields if isinstance(f.dataType, T.NumericType)} if isinstance(point, T.StructType) else set()
    if not {"x", "y"} <= numbers:
        raise TypeError(f"column {rings} of {path} is no list of rings of points: {kind}")
    plain = F.transform(rings, lambda ring: F.transform(ring, lambda p: _point(p["x"].cast("double"), p["y"].cast("double"))))
    return df.withColumn(rings, plain)


def with_geometry(layer: DataFrame, places: DataFrame, keys: Sequence[str], rings: str = "rings", fill: dict | None = None) -> DataFrame:
    """Every place with its polygon and its row of ``layer`` (one row per key, aggregated before).

    The polygons are joined last and keep all places, so that geometry meets a row per place and never
    travels with facts. A place without a row has nulls, or the values of ``fill``. A layer row
    whose place has no polygon is left out; a null key has none.
    """
    out = enrich(places.select(*keys, rings), layer, list(keys))
    return out.fillna(fill) if fill else out
