"""Equal-area pixels of the sky: numbers, centres, cones as ranges of numbers, joins of close directions, masks.

The sphere has 12 faces, each cut into 4**order pixels of one area.  In nested
order a pixel's number is its face and, bit by bit in turn, its place along the
face's two sides, so a pixel's 4 parts of the next order follow each other: what
a cone covers is a short list of ranges, and a coarser pixel is a shift.  Ring
order numbers pixels along circles of latitude, as most maps are stored.

Angles are radians: co-latitude ``theta`` from the north pole, longitude ``phi``.
All are column expressions, so close directions meet by an equal pixel, and the
exact distance decides among those that met.

Defined cases: a null angle has no pixel and is in no cone, pair or mask; poles,
and longitudes of any turn, are points like others; a cone of radius 0 holds its
centre's own points; a radius of pi or more holds all.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..session import checkpoints, spread

HALF_PI = math.pi / 2
#: Highest order: two bits each in a long beside the face.
MAX_ORDER = 29
#: By face, the ring (in sides) of its lowest corner, and its first meridian (in eighths of a turn).
FACE_RING = (2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4)
FACE_TURN = (1, 3, 5, 7, 0, 2, 4, 6, 1, 3, 5, 7)
#: The even places of a long.
EVEN = sum(1 << i for i in range(0, 62, 2))


def _long(value: Column) -> Column:
    return value.cast("long")


def _let(use: Callable[..., Column], **values: Column) -> Column:
    """``use`` of the values, each computed once: an expression that names another twice would be computed, and compiled, twice for it."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), lambda x: use(*[x[k] for k in values])), F.lit(0))


def _spread(x: Column) -> Column:
    """Bit i to place 2 i: binary digits read as digits to the base 4."""
    return _long(F.conv(F.bin(x), 4, 10))


def _gathered(x: Column) -> Column:
    """Places 0, 2, 4.. to bits 0, 1, 2..: digits to the base 4, all 0 or 1, read as binary ones."""
    return _long(F.conv(F.conv(x.bitwiseAND(F.lit(EVEN)).cast("string"), 10, 4), 2, 10))


def pixel(theta: Column, phi: Column, order: int) -> Column:
    """Nested number of the pixel that holds a direction."""
    if not 0 <= order <= MAX_ORDER:
        raise ValueError(f"order must be from 0 to {MAX_ORDER}")
    side = 1 << order

    def number(face: Column, x: Column, y: Column) -> Column:
        return F.shiftleft(_long(face), 2 * order) + _spread(x) + F.shiftleft(_spread(y), 1)

    def belt(up: Column, down: Column) -> Column:
        """Around the equator, lines of both directions are straight in z and phi."""
        a, b = F.shiftright(up, order), F.shiftright(down, order)
        face = F.when(a == b, a.bitwiseAND(F.lit(3)) + 4).when(a < b, a.bitwiseAND(F.lit(3))).otherwise(b.bitwiseAND(F.lit(3)) + 8)
        return number(face, down.bitwiseAND(F.lit(side - 1)), F.lit(side - 1) - up.bitwiseAND(F.lit(side - 1)))

    def cap(turn: Column, quarter: Column, away: Column, north: Column) -> Column:
        """In the caps, a pixel's place is its distance from the pole and the part of the quarter turn."""
        first, second = (F.least(_long(F.floor(part * away)), F.lit(side - 1).cast("long")) for part in (turn - quarter, 1 - (turn - quarter)))
        return F.when(north, number(quarter, F.lit(side - 1) - second, F.lit(side - 1) - first)).otherwise(number(quarter + 8, first, second))

    def placed(z: Column, turn: Column) -> Column:
        middle = _let(belt, up=_long(F.floor(side * (turn + 0.5) - side * 0.75 * z)), down=_long(F.floor(side * (turn + 0.5) + side * 0.75 * z)))
        away = side * F.sqrt(F.lit(6.0)) * F.when(z > 0, F.sin(theta / 2)).otherwise(F.cos(theta / 2))
        polar = _let(cap, turn=turn, quarter=F.least(_long(F.floor(turn)), F.lit(3).cast("long")), away=away, north=z > 0)
        return F.when(F.abs(z) <= 2 / 3, middle).otherwise(polar)

    turn = F.pmod(F.pmod(phi, F.lit(2 * math.pi)) / HALF_PI, F.lit(4.0))
    return F.when(theta.isNotNull() & phi.isNotNull(), _let(placed, z=F.cos(theta), turn=turn))


def _on_ring(number: Column, order: int, use: Callable[..., Column]) -> Column:
    """``use`` of a nested pixel's ring (from 1, north to south), the pixels of a quarter of it, its place in the ring (from 1), and whether the ring's first pixel begins at longitude 0."""
    side = 1 << order
    of_face = lambda values, face: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), _long(face).cast("int") + 1)

    def ring_of(face: Column, x: Column, y: Column) -> Column:
        ring = of_face(FACE_RING, face) * side - x - y - 1
        return _let(lambda ring: _let(lambda quarter, whole: placed(face, x, y, ring, quarter, whole), quarter=F.least(ring, F.lit(side).cast("long"), 4 * side - ring), whole=(ring < side) | (ring > 3 * side) | ((ring - side).bitwiseAND(F.lit(1)) == 0)), ring=ring)

    def placed(face: Column, x: Column, y: Column, ring: Column, quarter: Column, whole: Column) -> Column:
        place = F.shiftright(_long(of_face(FACE_TURN, face) * quarter + x - y + 1 + F.when(whole, F.lit(0)).otherwise(F.lit(1))), 1)
        return use(ring, quarter, F.pmod(place - 1, 4 * quarter) + 1, whole)

    inside = number.bitwiseAND(F.lit((1 << 2 * order) - 1))
    return _let(ring_of, face=F.shiftright(number, 2 * order), x=_gathered(inside), y=_gathered(F.shiftright(inside, 1)))


def ring_number(number: Column, order: int) -> Column:
    """Ring-order number of a nested pixel."""
    side = 1 << order

    def counted(ring: Column, quarter: Column, place: Column, whole: Column) -> Column:
        before = F.when(ring < side, 2 * ring * (ring - 1)).when(ring > 3 * side, F.lit(12 * side * side) - 2 * quarter * (quarter + 1)).otherwise(F.lit(2 * side * (side - 1)) + (ring - side) * (4 * side))
        return _long(before + place - 1)

    return _let(lambda n: _on_ring(n, order, counted), n=number)


def centre(number: Column, order: int) -> Column:
    """theta and phi (a struct) of a nested pixel's centre."""
    side = 1 << order

    def directed(ring: Column, quarter: Column, place: Column, whole: Column) -> Column:
        polar = 2 * F.asin(F.sqrt(quarter * quarter / F.lit(6.0 * side * side)))
        theta = F.when(ring < side, polar).when(ring > 3 * side, math.pi - polar).otherwise(F.acos((F.lit(2.0 * side) - ring) * 2 / F.lit(3.0 * side)))
        return F.struct(theta.alias("theta"), ((place - F.when(whole, F.lit(0.5)).otherwise(F.lit(1.0))) * (HALF_PI / quarter)).alias("phi"))

    return _let(lambda n: _on_ring(n, order, directed), n=number)


def reach(order: int) -> float:
    """The largest distance of a pixel's points from its centre, a little rounded up."""
    side = 1 << order
    z1, z2, turn = 2 / 3, 1 - (1 - 1 / side) ** 2 / 3, math.pi / (4 * side)
    x, y = math.sqrt(1 - z1 * z1), math.sqrt(1 - z2 * z2)
    return 2 * math.asin(min(1.0, math.dist((x * math.cos(turn), x * math.sin(turn), z1), (y, 0.0, z2)) / 2)) * (1 + 1e-9) + 1e-12


def distance(theta1: Column, phi1: Column, theta2: Column, phi2: Column) -> Column:
    """Great-circle distance by the half angles, exact for near points."""
    half = F.pow(F.sin((theta1 - theta2) / 2), 2) + F.sin(theta1) * F.sin(theta2) * F.pow(F.sin((phi1 - phi2) / 2), 2)
    return 2 * F.asin(F.sqrt(F.least(F.lit(1.0), half)))


def cover(cones: DataFrame, order: int, theta: str = "theta", phi: str = "phi", radius: str = "radius") -> DataFrame:
    """A row for each range [low, high) of pixels of ``order`` that a cone may touch, ``inside`` where all of the range's points are in it.

    From the 12 faces down: a pixel too far away goes, one wholly inside stays as
    one range, any other gives its 4 parts; so a cone has some rows for each
    order along its edge, and none for its inner pixels.  Of the last order, the
    pixels are those whose centre is within ``reach(order)`` of the cone.
    """
    rows = cones.withColumns({"_at": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long")))})
    out = []
    for level in range(order + 1):
        to = _let(lambda c: distance(F.col(theta), F.col(phi), c["theta"], c["phi"]), c=centre(F.col("_at"), level))
        rows = rows.withColumn("_to", to).where(F.col("_to") <= F.col(radius) + (reach(level) + reach(order) if level < order else reach(order)))
        whole = F.col("_to") + reach(level) <= F.col(radius)
        last = level == order
        shift = 2 * (order - level)
        done = rows if last else rows.where(whole)
        out.append(done.select(*cones.columns, F.shiftleft("_at", shift).alias("low"), F.shiftleft(F.col("_at") + 1, shift).alias("high"), whole.alias("inside")))
        if not last:
            rows = rows.where(~whole).withColumn("_at", F.explode(F.transform(F.array(*map(F.lit, range(4))), lambda i: F.shiftleft("_at", 2) + i))).drop("_to")
    return reduce(DataFrame.unionByName, out)


def _band(theta: Column, size: float) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(F.lit(math.floor(math.pi / size)).cast("long"), _long(F.floor(theta / size))))


def _slots(band: Column, size: float) -> Column:
    """Parts of a band of latitude that are about as long as it is high."""
    low, high = band * size, (band + 1) * size
    widest = F.when((low <= HALF_PI) & (high >= HALF_PI), F.lit(1.0)).otherwise(F.greatest(F.sin(low), F.sin(high)))
    return F.greatest(F.lit(1).cast("long"), _long(F.floor(widest * (2 * math.pi / size))))


def _turn(phi: Column) -> Column:
    return F.pmod(phi, F.lit(2 * math.pi)) / (2 * math.pi)


def _touching(cones: DataFrame, size: float, theta: str, phi: str, radius: str) -> DataFrame:
    """A row for each cell (_band, _slot) that a cone may touch: bands of latitude, cut into parts of longitude."""
    reached = F.col(radius) * (1 + 1e-9) + 1e-12
    rows = spread(cones.where(F.col(theta).isNotNull() & F.col(phi).isNotNull())).withColumn("_band", F.explode(F.sequence(_band(F.col(theta) - reached, size), _band(F.col(theta) + reached, size))))
    polar = (F.col(theta) - reached <= 0) | (F.col(theta) + reached >= math.pi)
    half = F.asin(F.least(F.lit(1.0), F.sin(reached) / F.sin(theta))) * ((1 + 1e-9) / (2 * math.pi)) + 1e-12
    rows = rows.withColumns({"_n": _slots(F.col("_band"), size), "_turn": _turn(F.col(phi)), "_half": F.when(polar, F.lit(1.0)).otherwise(half)})
    low, high = (_long(F.floor((F.col("_turn") + k * F.col("_half")) * F.col("_n"))) for k in (-1, 1))
    every = high - low + 1 >= F.col("_n")
    slots = F.sequence(F.when(every, F.lit(0).cast("long")).otherwise(low), F.when(every, F.col("_n") - 1).otherwise(high))
    return rows.withColumn("_slot", F.explode(slots)).withColumn("_slot", F.pmod("_slot", "_n")).drop("_n", "_turn", "_half")


def _celled(points: DataFrame, size: float, theta: str, phi: str) -> DataFrame:
    rows = points.where(F.col(theta).isNotNull() & F.col(phi).isNotNull()).withColumn("_band", _band(F.col(theta), size))
    n = _slots(F.col("_band"), size)
    return rows.withColumn("_slot", F.least(_long(F.floor(_turn(F.col(phi)) * n)), n - 1))


def _met(cones: DataFrame, points: DataFrame, largest: float, theta: str, phi: str, radius: str, keys: Sequence[str] = ()) -> DataFrame:
    size = min(max(largest, 1e-8), math.pi)
    touched = _touching(cones.where(F.col(radius) <= largest), size, theta, phi, radius)
    beside = _celled(points.select(*[F.col(c).alias(f"point_{c}") for c in points.columns]), size, f"point_{theta}", f"point_{phi}")
    on = [touched[c] == beside[c] for c in ("_band", "_slot")] + [F.col(k) == F.col(f"point_{k}") for k in keys] + [F.abs(F.col(theta) - F.col(f"point_{theta}")) <= F.col(radius) + 1e-9]
    # a file of cones may be small and their cells many: no broadcast, with which the pairs would be found in as many tasks as the points have files
    return touched.join(beside.hint("merge"), reduce(lambda a, b: a & b, on)).drop("_band", "_slot")


def within(cones: DataFrame, points: DataFrame, largest: float, theta: str = "theta", phi: str = "phi", radius: str = "radius", keys: Sequence[str] = ()) -> DataFrame:
    """All pairs of a cone and a point in it: the columns of both (a point's as point_*), and their distance.

    ``largest`` is the largest radius; cells of about that size are the join's
    key, beside ``keys``, which both tables have.  A cone has a row for each
    cell it touches, a point one; a hot cell's rows are split by AQE's skew join.
    """
    met = _met(cones, points, largest, theta, phi, radius, keys)
    return met.withColumn("distance", distance(F.col(theta), F.col(phi), F.col(f"point_{theta}"), F.col(f"point_{phi}"))).where(F.col("distance") <= F.col(radius))


#: Groups of cells of ``totals``, and comparisons of a step of it.
GROUPS, STEP = 256, 1 << 20


def _apart(theta1: np.ndarray, phi1: np.ndarray, theta2: np.ndarray, phi2: np.ndarray) -> np.ndarray:
    half = np.sin((theta1 - theta2) / 2) ** 2 + np.sin(theta1) * np.sin(theta2) * np.sin((phi1 - phi2) / 2) ** 2
    return 2 * np.arcsin(np.sqrt(np.minimum(1.0, half)))


def _vectors(theta: np.ndarray, phi: np.ndarray) -> np.ndarray:
    return np.stack([np.sin(theta) * np.cos(phi), np.sin(theta) * np.sin(phi), np.cos(theta)], axis=1)


def _summed(cones: tuple[np.ndarray, ...], points: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Of each cone (theta, phi, radius) the count, the nearest distance (infinite if there is none) and the sum of values of the points (theta, phi, value) in it.

    Products of unit vectors decide; those too near the edge, and the nearest, by the distance itself.
    """
    (theta, phi, radius), (t, p, value) = cones, points
    n, nearest, total = np.zeros(len(theta), np.int64), np.full(len(theta), np.inf), np.zeros(len(theta), np.int64)
    ours, theirs, least = _vectors(theta, phi), _vectors(t, p).T.copy(), np.cos(np.minimum(radius, math.pi))
    # 21 bits a column, so that sums of doubles are exact
    parts = np.stack([np.ones(len(t)), value & 0x1FFFFF, (value >> 21) & 0x1FFFFF, value >> 42], axis=1).astype(float)
    wide = min(len(t), 1 << 14)
    for a in range(0, len(t), max(wide, 1)):
        there = slice(a, a + wide)
        for b in range(0, len(theta), max(1, STEP // wide)):
            here = slice(b, b + max(1, STEP // wide))
            near = ours[here] @ theirs[:, there]
            inside = near >= least[here, None]
            i, j = np.nonzero(np.abs(near - least[here, None]) < 1e-12)
            inside[i, j] = _apart(theta[here][i], phi[here][i], t[there][j], p[there][j]) <= radius[here][i]
            sums = (inside.astype(float) @ parts[there]).astype(np.int64)
            n[here] += sums[:, 0]
            total[here] += sums[:, 1] + (sums[:, 2] << 21) + (sums[:, 3] << 42)
            i, j = np.nonzero(inside & (near >= near.max(axis=1, keepdims=True) - 1e-14))
            np.minimum.at(nearest, b + i, _apart(theta[here][i], phi[here][i], t[there][j], p[there][j]))
    return n, nearest, total


def totals(cones: DataFrame, points: DataFrame, largest: float, key: str, value: str, theta: str = "theta", phi: str = "phi", radius: str = "radius") -> DataFrame:
    """Per cone that holds a point: its key, ``n`` points, the distance of the ``nearest``, the ``total`` of a whole number of theirs (null as 0).

    The pairs of ``within`` are never rows: cones and points meet in the same cells,
    and a cell gives one row for each of its cones.  Cones are told apart by their key.
    """
    size = min(max(largest, 1e-8), math.pi)
    group = F.pmod(F.xxhash64("_band", "_slot"), F.lit(GROUPS)).alias("_group")
    rows = _touching(cones.where(F.col(radius) <= largest).select(F.col(key).alias("_key"), theta, phi, radius), size, theta, phi, radius).select("_key", F.col(theta).alias("_t"), F.col(phi).alias("_p"), F.col(radius).alias("_r"), "_band", "_slot", group)
    beside = _celled(points.select(theta, phi, F.coalesce(F.col(value).cast("long"), F.lit(0).cast("long")).alias("_v")), size, theta, phi).select(F.col(theta).alias("_t"), F.col(phi).alias("_p"), "_v", "_band", "_slot", group)

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        there = b.groupby(["_band", "_slot"]).indices
        found = []
        for cell, here in a.groupby(["_band", "_slot"]).indices.items():
            if cell in there:
                x, y = a.iloc[here], b.iloc[there[cell]]
                n, nearest, total = _summed(tuple(x[c].to_numpy(float) for c in ("_t", "_p", "_r")), (y["_t"].to_numpy(float), y["_p"].to_numpy(float), y["_v"].to_numpy(np.int64)))
                found.append(pd.DataFrame({"_key": x["_key"].to_numpy(), "n": n, "nearest": nearest, "total": total})[n > 0])
        return pd.concat(found) if found else pd.DataFrame({"_key": a["_key"][:0], "n": [], "nearest": [], "total": []})

    met = rows.groupBy("_group").cogroup(beside.groupBy("_group")).applyInPandas(run, f"_key {dict(cones.dtypes)[key]}, n long, nearest double, total long")
    return met.groupBy(F.col("_key").alias(key)).agg(F.sum("n").alias("n"), F.min("nearest").alias("nearest"), F.sum("total").alias("total"))


def close_directions(points: DataFrame, radius: float, key: str, theta: str = "theta", phi: str = "phi") -> DataFrame:
    """Pairs of points at most ``radius`` apart, each once: id_a < id_b and their distance."""
    cones = points.select(F.col(key).alias("id_a"), theta, phi, F.lit(float(radius)).alias("radius"))
    met = _met(cones, points.select(key, theta, phi), radius, theta, phi, "radius").where(F.col("id_a") < F.col(f"point_{key}"))
    met = met.withColumn("distance", distance(F.col(theta), F.col(phi), F.col(f"point_{theta}"), F.col(f"point_{phi}"))).where(F.col("distance") <= radius)
    return met.select("id_a", F.col(f"point_{key}").alias("id_b"), "distance")


def circles(cones: DataFrame, order: int, theta: str = "theta", phi: str = "phi", radius: str = "radius") -> DataFrame:
    """The pixels (nested) of a mask of each cone: those that overlap it, judged by parts two orders finer; a radius below a pixel's size counts as that size."""
    fine = min(order + 2, MAX_ORDER)
    least = math.sqrt(math.pi / 3) / (1 << order)
    keep = [c for c in cones.columns if c != radius]
    raised = cones.withColumn(radius, F.greatest(F.col(radius), F.lit(least)))
    parts = cover(raised, fine, theta, phi, radius)
    shift = 2 * (fine - order)
    coarse = parts.select(*keep, F.explode(F.sequence(F.shiftright("low", shift), F.shiftright(F.col("high") - 1, shift))).alias("pixel"))
    return coarse.distinct()


def full_mask(spark: SparkSession, circle: DataFrame, order: int) -> DataFrame:
    """Every pixel of an order with value 1 where ``circle`` has it, else 0."""
    every = spark.range(12 << 2 * order).withColumnRenamed("id", "pixel")
    return every.join(circle.select("pixel").distinct().withColumn("value", F.lit(1)), "pixel", "left").select("pixel", F.coalesce("value", F.lit(0)).alias("value"))


def _longitude(phi: Column, frame: str, gps: Column | None) -> Column:
    """A point's longitude in the frame of a mask: as it is on Earth, or on the sky at a time."""
    if frame == "geo":
        return phi
    if frame != "icrs":
        raise ValueError(f"unknown frame of a mask: {frame}")
    if gps is None:
        raise ValueError("a mask on the sky needs a time")
    return geo.longitude_to_ra(phi, gps)


def in_patch(points: DataFrame, theta0: float, phi0: float, radius: float, frame: str = "geo", gps: Column | None = None) -> DataFrame:
    """Points within a circle."""
    if not 0 <= radius <= math.pi:
        raise ValueError("a radius must be from 0 to pi")
    return points.where(distance(F.col("theta"), _longitude(F.col("phi"), frame, gps), F.lit(theta0), F.lit(phi0)) <= radius)


def nearest_point(points: DataFrame, targets: DataFrame, key: str, target: str, order: int = 4) -> DataFrame:
    """For each target (its key, theta, phi) the point next to it, of equally near ones the one of the smallest key: ``target``, ``key`` and ``distance``.

    Rings of pixels around a target grow until one has a point: a target looks at
    cones of 1, 2, 4.. pixels' size, and takes part no more once its cone held one.
    """
    checkpoints(points.sparkSession)
    near: list[DataFrame] = []
    left, size = targets.select(target, "theta", "phi"), reach(order)
    if points.where("theta IS NOT NULL AND phi IS NOT NULL").isEmpty():
        return points.sparkSession.createDataFrame([], targets.select(target).schema.add(key, points.schema[key].dataType).add("distance", "double"))
    left = left.where("theta IS NOT NULL AND phi IS NOT NULL")
    while True:
        met = within(left.withColumn("radius", F.lit(size)), points.select(key, "theta", "phi"), size)
        best = met.groupBy(target).agg(F.min(F.struct("distance", F.col(f"point_{key}").alias("k"))).alias("m")).select(target, F.col("m.k").alias(key), F.col("m.distance").alias("distance"))
        near.append(best.checkpoint())
        left = left.join(near[-1].select(target), target, "left_anti").checkpoint()
        if size >= math.pi or left.isEmpty():
            return reduce(DataFrame.unionByName, near)
        size = min(2 * size, math.pi)


def on_map(points: DataFrame, sky_map: DataFrame, order: int, above: float, ring: bool = False, frame: str = "geo", gps: Column | None = None) -> DataFrame:
    """Points whose pixel has a value above a limit in a map (pixel, value), numbered nested or by rings."""
    number = pixel(F.col("theta"), _longitude(F.col("phi"), frame, gps), order)
    number = ring_number(number, order) if ring else number
    kept = sky_map.where(F.col("value") > above).select(F.col("pixel").alias("_pixel")).distinct()
    return points.withColumn("_pixel", number).join(kept, "_pixel", "left_semi").drop("_pixel")
