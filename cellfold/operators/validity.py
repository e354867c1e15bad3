"""Validity of polygons as joins of edges: a ring of a million points is checked by many tasks.

Rings are closed, finite, of four points or more and not without area. Edges of a feature
neither cross nor run along each other; they may touch at points. Holes
lie in their shell and not in each other, and parts don't overlap. As no edges cross by then, a
point of each ring tells where it lies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places along an edge this close to its ends, in parts of its length, are its ends.
END = 1e-12


def _pairs(ring: Column, f) -> Column:
    """``f`` of the ends of each edge of a ring."""
    return F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), f)


def is_box(geometry: Column) -> Column:
    """Upright rectangles of one closed finite ring with area."""
    ring = F.get(F.get(geometry, 0), 0)
    p = [F.get(ring, i) for i in range(5)]
    same = lambda a, b, c: a[c] == b[c]
    upright = lambda i: same(p[i], p[i + 1], "x") & same(p[i + 2], p[(i + 3) % 4], "x") & same(p[i + 1], p[i + 2], "y") & same(p[(i + 3) % 4], p[i], "y")
    return _one_ring(geometry, (F.size(ring) == 5) & same(p[0], p[4], "x") & same(p[0], p[4], "y") & (upright(0) | upright(1)) & ~same(p[0], p[2], "x") & ~same(p[0], p[2], "y"))


def is_simple(geometry: Column) -> Column:
    """Triangles and upright rectangles of one closed finite ring with area: they are valid without further tests."""
    ring = F.get(F.get(geometry, 0), 0)
    p = [F.get(ring, i) for i in range(4)]
    turn = (p[1]["x"] - p[0]["x"]) * (p[2]["y"] - p[0]["y"]) - (p[2]["x"] - p[0]["x"]) * (p[1]["y"] - p[0]["y"])
    triangle = (F.size(ring) == 4) & (p[0]["x"] == p[3]["x"]) & (p[0]["y"] == p[3]["y"]) & (turn != 0)
    return is_box(geometry) | _one_ring(geometry, triangle)


def _one_ring(geometry: Column, shape: Column) -> Column:
    """Whether a geometry is one finite ring of a shape."""
    return F.coalesce((F.size(geometry) == 1) & (F.size(F.get(geometry, 0)) == 1) & _finite(F.get(F.get(geometry, 0), 0)) & shape, F.lit(False))


def _finite(ring: Column) -> Column:
    limit = F.lit(float("inf"))
    return F.forall(ring, lambda p: (F.abs(p["x"]) < limit) & (F.abs(p["y"]) < limit))


def has_broken_ring(geometry: Column) -> Column:
    """Whether a ring isn't closed, has too few points, points that aren't finite, or no area."""

    def broken(ring: Column) -> Column:
        origin, last = F.get(ring, 0), F.element_at(ring, -1)
        twice = F.aggregate(_pairs(ring, lambda p, q: (p["x"] - origin["x"]) * (q["y"] - origin["y"]) - (q["x"] - origin["x"]) * (p["y"] - origin["y"])), F.lit(0.0), lambda a, v: a + v)
        return F.when(F.size(ring) < 4, True).otherwise(~_finite(ring) | (origin["x"] != last["x"]) | (origin["y"] != last["y"]) | (twice == 0))

    return F.exists(F.flatten(geometry), broken)


def _class(p: Column, q: Column) -> Column:
    """The power of two at or above an edge's longer side."""
    return F.ceil(F.log2(F.greatest(F.abs(q["x"] - p["x"]), F.abs(q["y"] - p["y"])))).cast("int")


def numbered_edges(features: DataFrame) -> DataFrame:
    """(fid, part, ring, edge, ax, ay, bx, by, size, sizes): edges with their size class, and those of their feature; points left out."""
    sizes = F.array_distinct(F.filter(F.flatten(F.transform(F.flatten("geometry"), lambda r: _pairs(r, _class))), lambda c: c.isNotNull()))
    parts = features.select("fid", sizes.alias("sizes"), F.posexplode("geometry").alias("part", "rings"))
    rings = parts.select("fid", "sizes", "part", F.posexplode("rings").alias("ring", "points"))
    edges = rings.select("fid", "sizes", "part", "ring", F.posexplode(_pairs(F.col("points"), lambda p, q: F.struct(p.alias("p"), q.alias("q")))).alias("edge", "e"))
    ends = [F.col(f"e.{end}.{c}").alias(f"{name}{c}") for name, end in (("a", "p"), ("b", "q")) for c in "xy"]
    return edges.select("fid", "part", "ring", "edge", *ends, _class(F.col("e.p"), F.col("e.q")).alias("size"), "sizes").where("size is not null")


def crossing_edges(edges: DataFrame) -> DataFrame:
    """(fid): of features with edges that cross or run along each other.

    An edge is listed in the tiles of its own size class, of which it touches four at most, and asks those of every
    larger class of its feature: two edges meet in the class of the larger.
    """

    def tiles(frame: DataFrame, exponent: Column) -> DataFrame:
        step = F.pow(F.lit(2.0), exponent)
        span = lambda c: F.sequence(F.floor(F.least(F.col(f"a{c}"), F.col(f"b{c}")) / step), F.floor(F.greatest(F.col(f"a{c}"), F.col(f"b{c}")) / step))
        return frame.withColumn("tx", F.explode(span("x"))).withColumn("ty", F.explode(span("y")))

    listed = tiles(edges.withColumn("class", F.col("size")).drop("sizes"), F.col("class")).alias("a")
    asked = tiles(edges.withColumn("class", F.explode(F.filter("sizes", lambda c: c >= F.col("size")))).drop("sizes"), F.col("class")).alias("b")
    met = listed.join(asked, (F.col("a.fid") == F.col("b.fid")) & (F.col("a.class") == F.col("b.class")) & (F.col("a.tx") == F.col("b.tx")) & (F.col("a.ty") == F.col("b.ty")))
    place = lambda s: F.struct(f"{s}.part", f"{s}.ring", f"{s}.edge")
    # Of edges of one class each pair is met from both sides.
    once = (F.col("a.size") > F.col("b.size")) | (place("a") < place("b"))
    met = met.where(once & (place("a") != place("b")))
    c = {f"{s}{n}": F.col(f"{s}.{n}") for s in "ab" for n in ("ax", "ay", "bx", "by")}
    rx, ry, sx, sy = c["abx"] - c["aax"], c["aby"] - c["aay"], c["bbx"] - c["bax"], c["bby"] - c["bay"]
    dx, dy = c["bax"] - c["aax"], c["bay"] - c["aay"]
    named = met.select(F.col("a.fid").alias("fid"), *[v.alias(k) for k, v in zip(("rx", "ry", "sx", "sy", "dx", "dy"), (rx, ry, sx, sy, dx, dy), strict=True)])
    named = named.withColumn("den", F.col("rx") * F.col("sy") - F.col("ry") * F.col("sx"))
    t = F.try_divide(F.col("dx") * F.col("sy") - F.col("dy") * F.col("sx"), F.col("den"))
    u = F.try_divide(F.col("dx") * F.col("ry") - F.col("dy") * F.col("rx"), F.col("den"))
    inner = lambda v: (v > END) & (v < 1 - END)
    length = F.col("rx") * F.col("rx") + F.col("ry") * F.col("ry")
    t0 = (F.col("dx") * F.col("rx") + F.col("dy") * F.col("ry")) / length
    t1 = t0 + (F.col("sx") * F.col("rx") + F.col("sy") * F.col("ry")) / length
    along = (F.col("den") == 0) & (F.col("dx") * F.col("ry") - F.col("dy") * F.col("rx") == 0) & (F.least(F.greatest(t0, t1), F.lit(1.0)) - F.greatest(F.least(t0, t1), F.lit(0.0)) > END)
    return named.where(((F.col("den") != 0) & inner(t) & inner(u)) | along).select("fid").distinct()


def misplaced_rings(edges: DataFrame) -> DataFrame:
    """(fid): of features with a hole outside its shell or in another hole, or a part in another part; rings don't cross.

    A ring's place is that of the middle of its longest edge: in another ring if an odd number of its edges lies to the
    right. Points and edges meet by bands of height, in all classes of the edges' own heights.
    """
    ring = ["fid", "part", "ring"]
    length = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    middle = F.struct(length.alias("length"), ((F.col("ax") + F.col("bx")) / 2).alias("x"), ((F.col("ay") + F.col("by")) / 2).alias("y"), "edge")
    rise = F.ceil(F.log2(F.abs(F.col("by") - F.col("ay")))).cast("int")
    sloped = edges.where("ay <> by").withColumn("class", rise)
    step = F.pow(F.lit(2.0), F.col("class"))
    listed = sloped.withColumn("band", F.explode(F.sequence(F.floor(F.least("ay", "by") / step), F.floor(F.greatest("ay", "by") / step))))
    rings = edges.groupBy(*ring).agg(F.max(middle).alias("m")).select(*ring, "m.x", "m.y")
    counts = rings.groupBy("fid").agg(F.count("*").alias("rings")).where("rings > 1").select("fid")
    classes = sloped.select("fid", "class").distinct()
    points = rings.join(counts, "fid").join(classes, "fid").withColumn("band", F.floor(F.col("y") / step))
    a, b = points.alias("a"), listed.alias("b")
    met = a.join(b, (F.col("a.fid") == F.col("b.fid")) & (F.col("a.class") == F.col("b.class")) & (F.col("a.band") == F.col("b.band")))
    same = F.col("a.part") == F.col("b.part")
    straddles = (F.col("b.ay") > F.col("a.y")) != (F.col("b.by") > F.col("a.y"))
    at = F.col("b.ax") + (F.col("a.y") - F.col("b.ay")) * (F.col("b.bx") - F.col("b.ax")) / (F.col("b.by") - F.col("b.ay"))
    met = met.where(straddles & (F.col("a.x") < at) & (~same | (F.col("a.ring") != F.col("b.ring"))) & (same | (F.col("a.ring") == 0)))
    # Within a part rings count one by one, across parts all rings of the other part together.
    other = F.when(same, F.col("b.ring")).otherwise(-1)
    odd = met.groupBy(F.col("a.fid").alias("fid"), F.col("a.part").alias("part"), F.col("a.ring").alias("ring"), F.col("b.part").alias("part2"), other.alias("ring2")).agg((F.count("*") % 2).alias("odd")).where("odd = 1")
    told = odd.groupBy(*ring).agg(F.max((F.col("ring2") == 0).cast("int")).alias("in_shell"), F.max((F.col("ring2") != 0).cast("int")).alias("in_other"))
    placed = rings.join(told, ring, "left").na.fill(0, ["in_shell", "in_other"])
    # A shell lies in no hole of its own, as those lie in it.
    wrong = F.when(F.col("ring") == 0, F.col("in_other") == 1).otherwise((F.col("in_shell") == 0) | (F.col("in_other") == 1))
    return placed.where(wrong).select("fid").distinct()


def invalid_features(features: DataFrame) -> DataFrame:
    """(fid): of ``features(fid, geometry)``, ids distinct and geometries neither null nor empty, those that aren't valid."""
    broken = has_broken_ring(F.col("geometry"))
    rough = features.where(~broken & ~is_simple(F.col("geometry")))
    edges = numbered_edges(rough)
    return features.where(broken).select("fid").unionByName(crossing_edges(edges)).unionByName(misplaced_rings(edges))
