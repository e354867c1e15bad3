"""Pairs of polygons that share area, and how much, in DataFrame operations only.

Candidates come from an equi-join of boxes by tile. A point is in a polygon if, of the edges
right of it, more go up than down; so the shared area of two polygons is a sum over pairs
of an edge of each: the integral, over the heights that both have, of the lesser x. Edges
are cut at horizontal bands and meet by band, so that a huge pair spreads over tasks. Two
upright rectangles need no edges: what they share is a rectangle too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellfold.operators.coverage import plane_area, ring_area
from cellfold.operators.validity import is_box

#: Shared areas up to this part of the smaller polygon are rounding along common edges.
EPSILON = 1e-12


def overlap_pairs(features: DataFrame) -> DataFrame:
    """(left, right, shared): pairs of ``features(fid, geometry)`` with a positive shared area.

    Boxes are listed in tiles of a size class: the power of two at or above their longer
    side, so a box touches few tiles of its own class. Every box also asks the tiles of
    larger classes that occur; so a pair meets in the class of its larger box, and no
    inequality join is needed. It counts in one tile only, that of the lower left corner of
    what both boxes cover, so that pairs aren't compared with each other.
    """
    boxes = _boxes(features)
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    boxes = boxes.where((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))).withColumn("size", F.ceil(F.log2(side)).cast("int"))
    kinds = boxes.select("size", "upright").distinct().collect()  # exponents of doubles: at most about 2,000
    classes = sorted({r[0] for r in kinds})
    if not classes:
        return features.sparkSession.createDataFrame([], "left long, right long, shared double")
    # Few tiles may hold most pairs, and Spark sees only how small the tiles are: it would put them into one task.
    tasks = int(features.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def tiles(frame: DataFrame) -> DataFrame:
        at = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("class")))
        corner = frame.withColumns({"cx": at("x0"), "cy": at("y0")})
        return corner.withColumn("tx", F.explode(F.sequence("cx", at("x1")))).withColumn("ty", F.explode(F.sequence("cy", at("y1")))).repartition(tasks, "class", "tx", "ty")

    listed = tiles(boxes.withColumn("class", F.col("size")))
    asked = tiles(boxes.withColumn("class", F.explode(F.filter(F.array(*[F.lit(c) for c in classes]), lambda c: c >= F.col("size")))))
    a, b = listed.alias("a"), asked.alias("b")
    meet = (F.col("a.class") == F.col("b.class")) & (F.col("a.tx") == F.col("b.tx")) & (F.col("a.ty") == F.col("b.ty"))
    touch = (F.col("a.x0") < F.col("b.x1")) & (F.col("b.x0") < F.col("a.x1")) & (F.col("a.y0") < F.col("b.y1")) & (F.col("b.y0") < F.col("a.y1"))
    here = (F.greatest("a.cx", "b.cx") == F.col("a.tx")) & (F.greatest("a.cy", "b.cy") == F.col("a.ty"))
    once = (F.col("a.size") > F.col("b.size")) | ((F.col("a.size") == F.col("b.size")) & (F.col("a.fid") < F.col("b.fid")))
    met = b.join(a.hint("merge"), meet & touch & here & once)
    upright, pair = F.col("a.upright") & F.col("b.upright"), [F.least("a.fid", "b.fid").alias("left"), F.greatest("a.fid", "b.fid").alias("right")]
    width, height = (F.least(f"a.{c}1", f"b.{c}1") - F.greatest(f"a.{c}0", f"b.{c}0") for c in "xy")
    found = met.where(upright).select(*pair, (width * height).alias("shared"), F.least("a.area", "b.area").alias("least"))
    found = found.where(F.col("shared") > EPSILON * F.col("least")).select("left", "right", "shared")
    if all(r[1] for r in kinds):
        return found
    rough = shared_areas(met.where(~upright).select(*pair), features)
    return found.unionByName(rough) if any(r[1] for r in kinds) else rough


def _boxes(features: DataFrame) -> DataFrame:
    """(fid, x0, x1, y0, y1, area, edges, upright) of each feature."""
    ring = F.flatten("geometry")
    xs = F.flatten(F.transform(ring, lambda r: F.transform(r, lambda p: p["x"])))
    ys = F.flatten(F.transform(ring, lambda r: F.transform(r, lambda p: p["y"])))
    return features.select("fid", F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"), plane_area(F.col("geometry")).alias("area"), F.size(ys).alias("edges"), is_box(F.col("geometry")).alias("upright"))


def _step(exponent: str) -> Column:
    return F.pow(F.lit(2.0), F.col(exponent))


def _bands(low: Column, high: Column, exponent: str) -> Column:
    return F.explode(F.sequence(F.floor(low / _step(exponent)), F.floor(high / _step(exponent))))


def upward_edges(features: DataFrame) -> DataFrame:
    """(fid, turn, ax, ay, bx, by): edges from their lower to their upper end; ``turn`` is 1 where the inside is left of it, else -1.

    Horizontal edges bound no area of their own and are left out.
    """
    rings = features.select("fid", F.explode("geometry").alias("part")).select("fid", F.posexplode("part").alias("ring_no", "ring"))
    sign = F.signum(ring_area(F.col("ring"))) * F.when(F.col("ring_no") == 0, 1.0).otherwise(-1.0)
    edges = rings.select("fid", sign.alias("sign"), F.explode(F.expr("transform(sequence(1, size(ring) - 1), i -> struct(ring[i - 1] as p, ring[i] as q))")).alias("e")).where("e.p.y <> e.q.y")
    up = F.col("e.p.y") < F.col("e.q.y")
    low, high = F.when(up, F.col("e.p")).otherwise(F.col("e.q")), F.when(up, F.col("e.q")).otherwise(F.col("e.p"))
    return edges.select("fid", F.when(up, F.col("sign")).otherwise(-F.col("sign")).alias("turn"), low["x"].alias("ax"), low["y"].alias("ay"), high["x"].alias("bx"), high["y"].alias("by"))


def shared_areas(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """(left, right, shared) of the ``pairs(left, right)`` of features that share area.

    A feature's bands have the height, a power of two, that spreads its edges over about the
    square root of their number. Bands of two features nest, so that both sides' pieces meet in the higher ones.
    """
    exponent = F.ceil(F.log2((F.col("y1") - F.col("y0")) / F.sqrt("edges"))).cast("int")
    boxes = _boxes(features).where("y1 > y0").withColumn("k", exponent)
    listed = upward_edges(features).join(boxes.select("fid", "k"), "fid").withColumn("band", _bands(F.col("ay"), F.col("by"), "k")).drop("k")
    side = lambda name: boxes.select([F.col(c).alias(name if c == "fid" else f"{c}_{name}") for c in boxes.columns])
    known = pairs.join(side("left"), "left").join(side("right"), "right")
    both = lambda f, c: f(F.col(f"{c}_left"), F.col(f"{c}_right"))
    known = known.select("left", "right", "k_left", "k_right", both(F.greatest, "x0").alias("x"), both(F.greatest, "y0").alias("low"), both(F.least, "y1").alias("high"), both(F.greatest, "k").alias("k"), both(F.least, "area").alias("least"))

    def pieces(name: str) -> DataFrame:
        """Pieces of the edges of one side within a pair's heights."""
        asked = known.withColumns({"fid": F.col(name), "own": F.col(f"k_{name}")}).withColumn("band", _bands(F.col("low"), F.col("high"), "own"))
        found = asked.join(listed, ["fid", "band"])
        bottom = F.greatest(F.col("ay"), F.col("low"), F.col("band") * _step("own"))
        top = F.least(F.col("by"), F.col("high"), (F.col("band") + 1) * _step("own"))
        at = lambda y: F.when(F.col("ax") == F.col("bx"), F.col("ax")).otherwise(F.col("ax") + (y - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay"))) - F.col("x")
        # Of a long edge its slope counts, so pieces keep the ends' x as well as their heights.
        cut = found.withColumns({"y0": bottom, "y1": top}).where("y0 < y1")
        return cut.select("left", "right", F.floor(F.col("y0") / _step("k")).alias("band"), "y0", "y1", at(F.col("y0")).alias("e0"), at(F.col("y1")).alias("e1"), "turn")

    a, b = pieces("left").alias("a"), pieces("right").alias("b")
    meet = a.join(b, ["left", "right", "band"]).where("a.y0 < b.y1 and b.y0 < a.y1")
    low, high = F.greatest("a.y0", "b.y0"), F.least("a.y1", "b.y1")
    along = lambda s, y: F.when(y == F.col(f"{s}.y0"), F.col(f"{s}.e0")).when(y == F.col(f"{s}.y1"), F.col(f"{s}.e1")).otherwise(F.col(f"{s}.e0") + (y - F.col(f"{s}.y0")) * (F.col(f"{s}.e1") - F.col(f"{s}.e0")) / (F.col(f"{s}.y1") - F.col(f"{s}.y0")))
    ends = meet.select("left", "right", (F.col("a.turn") * F.col("b.turn")).alias("turn"), (high - low).alias("h"), *[along(s, y).alias(f"{s}{i}") for s in "ab" for i, y in enumerate((low, high))])
    d0, d1 = F.col("a0") - F.col("b0"), F.col("a1") - F.col("b1")
    # The integral of the lesser of two lines: one of them, less what lies beyond the other.
    least = (F.least("a0", "b0") + F.least("a1", "b1")) / 2
    crossed = (F.col("a0") + F.col("a1")) / 2 - F.pow(F.greatest(d0, d1), 2) / (2 * (F.abs(d0) + F.abs(d1)))
    area = F.col("turn") * F.col("h") * F.when(d0 * d1 < 0, crossed).otherwise(least)
    summed = ends.select("left", "right", area.alias("area")).groupBy("left", "right").agg(F.sum("area").alias("shared"))
    return summed.join(known.select("left", "right", "least"), ["left", "right"]).where(F.col("shared") > EPSILON * F.col("least")).select("left", "right", "shared")


def first_overlap(features: DataFrame) -> tuple | None:
    """The first overlapping pair in order of rows, or None."""
    row = overlap_pairs(features).orderBy("left", "right").limit(1).select("left", "right").first()
    return tuple(row) if row else None
