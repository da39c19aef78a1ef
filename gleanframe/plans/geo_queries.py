"""Areas, centroids and dissolved outlines of the parcels."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanframe.functions.nulls import rounded
from gleanframe.functions.text import fuse_places
from gleanframe.operators import geo
from gleanframe.plans.registry import query
from gleanframe.plans.sqlviews import with_views
from gleanframe.session import scratch_path
from gleanframe.sources.standins import lots, mentions, parcels, table

OUTLINE = """
, e AS (
  SELECT owner, x AS x0, y AS y0, x + 10 AS x1, y AS y1 FROM parcels UNION ALL SELECT owner, x + 10, y, x + 10, y + 10 FROM parcels
  UNION ALL SELECT owner, x + 10, y + 10, x, y + 10 FROM parcels UNION ALL SELECT owner, x, y + 10, x, y FROM parcels)
, outline AS (
  SELECT owner, x0, y0, x1, y1 FROM e a WHERE NOT EXISTS (
    SELECT 1 FROM e b WHERE b.owner = a.owner AND b.x0 = a.x1 AND b.y0 = a.y1 AND b.x1 = a.x0 AND b.y1 = a.y0))
"""


@query("geo_centroid", with_views("parcels", """
SELECT owner, count(*) * 100.0::DOUBLE AS area, round(avg(x + 5), 6) AS cx, round(avg(y + 5), 6) AS cy FROM parcels GROUP BY owner"""))
def geo_centroid(spark, sf):
    df = geo.area_and_centroid(parcels(spark, sf), ["owner"])
    return df.withColumns({c: rounded(c) for c in ("area", "cx", "cy")})


@query("geo_dissolve", with_views("parcels", OUTLINE + "SELECT * FROM outline"))
def geo_dissolve(spark, sf):
    return geo.dissolve_edges(parcels(spark, sf), ["owner"])


@query("geo_dissolve_rings", """WITH RECURSIVE """ + with_views("parcels", OUTLINE)[5:] + """
, turns AS (
  SELECT a.owner, row(a.x0, a.y0, a.x1, a.y1) AS e, row(b.x0, b.y0, b.x1, b.y1) AS nxt,
         CASE WHEN (a.x1 - a.x0) * (b.y1 - b.y0) - (a.y1 - a.y0) * (b.x1 - b.x0) < 0 THEN 0
              WHEN (a.x1 - a.x0) * (b.y1 - b.y0) - (a.y1 - a.y0) * (b.x1 - b.x0) > 0 THEN 2 ELSE 1 END AS side
  FROM outline a JOIN outline b ON a.owner = b.owner AND a.x1 = b.x0 AND a.y1 = b.y0)
, nexts AS (SELECT owner, e, arg_min(nxt, side) AS nxt FROM turns GROUP BY owner, e)
, walk AS (
  SELECT owner, e AS start, e AS at, 1 AS step FROM nexts
  UNION ALL
  SELECT w.owner, w.start, n.nxt, w.step + 1 FROM walk w JOIN nexts n ON n.owner = w.owner AND n.e = w.at WHERE n.nxt > w.start)
, rings AS (
  SELECT w.owner, w.start, max(w.step) AS n FROM walk w GROUP BY 1, 2)
, closed AS (
  SELECT r.* FROM rings r JOIN walk w ON w.owner = r.owner AND w.start = r.start AND w.step = r.n
  JOIN nexts n ON n.owner = w.owner AND n.e = w.at WHERE n.nxt = r.start)
SELECT owner, count(*) AS n_rings, CAST(sum(n) AS BIGINT) AS n_edges, max(n)::BIGINT AS longest FROM closed GROUP BY owner""")
def geo_dissolve_rings(spark, sf):
    rings = geo.outline_rings(geo.dissolve_edges(parcels(spark, sf), ["owner"]), ["owner"])
    per_ring = rings.groupBy("owner", "ring").agg(F.max("seq").alias("n"), F.count_distinct("seq").alias("m"))
    return per_ring.groupBy("owner").agg(
        F.count(F.lit(1)).alias("n_rings"), F.sum("m").alias("n_edges"), F.max("n").alias("longest")
    )


@query("geo_fuse_regions", """
SELECT CASE WHEN r_name IN ('ASIA', 'EUROPE') THEN 'EURASIA' ELSE r_name END AS place, count(*) AS n
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def geo_fuse_regions(spark, sf):
    df = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    df = df.join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return df.groupBy(fuse_places("r_name", ("ASIA", "EUROPE"), "EURASIA").alias("place")).agg(F.count(F.lit(1)).alias("n"))


@query("geo_rings", """WITH RECURSIVE """ + with_views("parcels", """
, lots AS (
  SELECT parcel, owner, x, y, 10.0::DOUBLE AS h FROM parcels WHERE parcel % 3 <> 0
  UNION ALL SELECT parcel, owner, x, y + unnest([0, 5]), 5 FROM parcels WHERE parcel % 3 = 0)
, e0 AS (
  SELECT owner, x AS x0, y AS y0, x + 10 AS x1, y AS y1 FROM lots UNION ALL SELECT owner, x + 10, y, x + 10, y + h FROM lots
  UNION ALL SELECT owner, x + 10, y + h, x, y + h FROM lots UNION ALL SELECT owner, x, y + h, x, y FROM lots)
, corner AS (SELECT DISTINCT owner, x0 AS x, y0 AS y FROM e0)
, cut AS (SELECT e0.*, c.y AS mid FROM e0 LEFT JOIN corner c ON c.owner = e0.owner AND c.x = x0 AND x0 = x1 AND c.y = (y0 + y1) / 2)
, e AS (
  SELECT owner, x0, y0, x1, y1 FROM cut WHERE mid IS NULL UNION ALL SELECT owner, x0, y0, x1, mid FROM cut WHERE mid IS NOT NULL
  UNION ALL SELECT owner, x0, mid, x1, y1 FROM cut WHERE mid IS NOT NULL)
, outline AS (
  SELECT owner, x0, y0, x1, y1 FROM e a WHERE NOT EXISTS (
    SELECT 1 FROM e b WHERE b.owner = a.owner AND b.x0 = a.x1 AND b.y0 = a.y1 AND b.x1 = a.x0 AND b.y1 = a.y0))
, turns AS (
  SELECT a.owner, row(a.x0, a.y0, a.x1, a.y1) AS e, row(b.x0, b.y0, b.x1, b.y1) AS nxt,
         sign((a.x1 - a.x0) * (b.y1 - b.y0) - (a.y1 - a.y0) * (b.x1 - b.x0)) AS side
  FROM outline a JOIN outline b ON a.owner = b.owner AND a.x1 = b.x0 AND a.y1 = b.y0)
, nexts AS (SELECT owner, e, arg_min(nxt, side) AS nxt FROM turns GROUP BY owner, e)
, walk AS (
  SELECT owner, e AS start, e AS at, 1 AS step FROM nexts
  UNION ALL
  SELECT w.owner, w.start, n.nxt, w.step + 1 FROM walk w JOIN nexts n ON n.owner = w.owner AND n.e = w.at WHERE n.nxt > w.start)
, ends AS (SELECT owner, start, max(step) AS n FROM walk GROUP BY 1, 2)
, closed AS (
  SELECT r.* FROM ends r JOIN walk w ON w.owner = r.owner AND w.start = r.start AND w.step = r.n
  JOIN nexts n ON n.owner = w.owner AND n.e = w.at WHERE n.nxt = r.start)
, side AS (
  SELECT c.owner, c.start, c.n, struct_extract(w.at, 1) AS x0, struct_extract(w.at, 2) AS y0, struct_extract(w.at, 3) AS x1, struct_extract(w.at, 4) AS y1
  FROM closed c JOIN walk w ON w.owner = c.owner AND w.start = c.start)
, ring AS (SELECT owner, start, any_value(n) AS n, sum(x0 * y1 - x1 * y0) / 2 AS area FROM side GROUP BY owner, start)
, hole AS (
  SELECT owner, start, n, area, (struct_extract(start, 1) + struct_extract(start, 3)) / 2 AS px, (struct_extract(start, 2) + struct_extract(start, 4)) / 2 AS py
  FROM ring WHERE area < 0)
, held AS (
  SELECT h.owner, h.start, h.n, h.area, s.start AS outer_start, r.area AS around
  FROM hole h JOIN side s ON s.owner = h.owner AND (s.y0 <= h.py) <> (s.y1 <= h.py) AND s.x0 + (h.py - s.y0) * (s.x1 - s.x0) / (s.y1 - s.y0) > h.px
  JOIN ring r ON r.owner = s.owner AND r.start = s.start AND r.area > 0
  GROUP BY ALL HAVING count(*) % 2 = 1)
, own AS (SELECT owner, n, area, arg_min(outer_start, row(around, outer_start)) AS outer_start FROM held GROUP BY owner, start, n, area)
SELECT owner, struct_extract(start, 1) AS x, struct_extract(start, 2) AS y, 1 + count(h.n) AS n_rings, CAST(any_value(ring.n) + coalesce(sum(h.n), 0) AS BIGINT) AS n_corners,
       round(any_value(ring.area) + coalesce(sum(h.area), 0), 6) AS area, any_value(f.parcel) AS parcel
FROM ring LEFT JOIN (SELECT owner AS o, outer_start, n, area FROM own) h ON h.o = owner AND h.outer_start = start
JOIN (SELECT owner AS fo, min(parcel) AS parcel FROM parcels GROUP BY 1) f ON fo = owner
WHERE ring.area > 0 GROUP BY owner, start""")[5:])
def geo_rings(spark, sf):
    fused = geo.dissolve(lots(spark, sf), ["owner"], ["parcel"], ["parcel"])
    each = fused.select("owner", "parcel", F.explode("polygons").alias("rings")).select(
        "owner", "parcel", "rings", F.col("rings")[0][0]["x"].alias("x"), F.col("rings")[0][0]["y"].alias("y")
    )
    keys = ["owner", "x", "y"]
    sizes = geo.area_and_centroid(each, keys).select(*keys, rounded("area").alias("area"))
    corners = F.aggregate("rings", F.lit(0).cast("long"), lambda n, r: n + F.size(r) - 1)
    told = each.select(*keys, "parcel", F.size("rings").cast("long").alias("n_rings"), corners.alias("n_corners"))
    return told.join(sizes, keys)


@query("map_layer_geometry", with_views("mentions", """
, places AS (SELECT n_name AS area, (n_nationkey % 5) * 10.0::DOUBLE AS x, (n_nationkey // 5) * 10.0::DOUBLE AS y FROM nation)
, cited AS (SELECT area, count(*) AS mentions, count(DISTINCT name) AS names FROM mentions GROUP BY area)
SELECT p.area AS place, coalesce(mentions, 0) AS mentions, coalesce(names, 0) AS names, 1::BIGINT AS n_rings, 5::BIGINT AS n_points,
       round(x + 5, 6) AS cx, round(y + 5, 6) AS cy
FROM places p LEFT JOIN cited c ON c.area = p.area"""))
def map_layer_geometry(spark, sf):
    cited = mentions(spark, sf, "area", "name").withColumnRenamed("area", "place").groupBy("place").agg(F.count(F.lit(1)).alias("mentions"), F.count_distinct("name").alias("names"))
    layer = geo.with_geometry(cited, stored_places(spark, sf), ["place"], fill={"mentions": 0, "names": 0})
    centre = geo.area_and_centroid(layer, ["place"]).select("place", rounded("cx").alias("cx"), rounded("cy").alias("cy"))
    told = layer.select("place", "mentions", "names", F.size("rings").cast("long").alias("n_rings"), F.size(F.col("rings")[0]).cast("long").alias("n_points"))
    return told.join(centre, "place")


def stored_places(spark, sf):
    """The nations as squares, written with their nested rings and read again."""
    at = F.col("n_nationkey")
    shape = geo.square((at % 5).cast("double") * 10.0, F.floor(at / 5).cast("double") * 10.0, 10.0)
    path = scratch_path(spark, "places")
    table(spark, sf, "nation").select(F.col("n_name").alias("place"), shape.alias("rings")).write.parquet(path)
    return geo.scan_polygons(spark, path)
