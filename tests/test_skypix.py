"""Pixels of the sky against the formula by rings, cones and masks against distances to all points."""

import math
import random

import pytest
from pyspark.sql import functions as F

from chirplake.operators import skypix

SCHEMA = "id long, theta double, phi double"


def ring_by_hand(side, theta, phi):
    z, turn = math.cos(theta), (phi % (2 * math.pi)) / (math.pi / 2)
    if abs(z) <= 2 / 3:
        a, b = math.floor(side * (0.5 + turn - 0.75 * z)), math.floor(side * (0.5 + turn + 0.75 * z))
        ring = side + 1 + a - b
        return 2 * side * (side - 1) + (ring - 1) * 4 * side + ((a + b - side + (1 - (ring & 1)) + 1) // 2) % (4 * side)
    part, away = turn - math.floor(turn), side * math.sqrt(3 * (1 - abs(z)))
    ring = math.floor(part * away) + math.floor((1 - part) * away) + 1
    place = math.floor(turn * ring) % (4 * ring)
    return 2 * ring * (ring - 1) + place if z > 0 else 12 * side * side - 2 * ring * (ring + 1) + place


def apart(a, b, c, d):
    return 2 * math.asin(math.sqrt(min(1, math.sin((a - c) / 2) ** 2 + math.sin(a) * math.sin(c) * math.sin((b - d) / 2) ** 2)))


@pytest.fixture(scope="module")
def points():
    rng = random.Random(1)
    return [(i, math.acos(rng.uniform(-1, 1)), rng.uniform(-7, 7)) for i in range(1500)] + [(2000, 0.0, 1.0), (2001, math.pi, 0.0), (2002, math.pi / 2, 2 * math.pi)]


@pytest.mark.parametrize("order", [0, 1, 6, 29])
def test_pixel_and_ring(spark, frame, points, order):
    inner = [p for p in points if p[0] < 2000]
    got = frame(inner, SCHEMA).select("id", skypix.pixel(F.col("theta"), F.col("phi"), order).alias("p")).withColumn("r", skypix.ring_number(F.col("p"), order))
    assert {r.id: r.r for r in got.collect()} == {i: ring_by_hand(1 << order, t, p) for i, t, p in inner}


@pytest.mark.parametrize("order", [0, 1, 4])
def test_centres_lie_in_their_pixels(spark, order):
    n = 12 * 4**order
    at = spark.range(n).withColumn("c", skypix.centre(F.col("id"), order))
    theta, phi = F.col("c.theta"), F.col("c.phi")
    rows = at.select("id", theta.alias("theta"), phi.alias("phi"), skypix.ring_number(F.col("id"), order).alias("ring"), skypix.pixel(theta, phi, order).alias("back")).collect()
    assert all(r.back == r.id and ring_by_hand(1 << order, r.theta, r.phi) == r.ring for r in rows)
    assert sorted(r.ring for r in rows) == list(range(n))


def test_points_are_within_reach_of_their_centres(spark, frame, points):
    for order in (0, 1, 3, 7):
        at = frame(points, SCHEMA).withColumn("p", skypix.pixel(F.col("theta"), F.col("phi"), order))
        at = at.withColumn("c", skypix.centre(F.col("p"), order))
        most = at.agg(F.max(skypix.distance(F.col("theta"), F.col("phi"), F.col("c.theta"), F.col("c.phi")))).first()[0]
        assert most <= skypix.reach(order) < 3 * most


CONES = [(1, 0.5, 1.0, 0.3), (2, 3.1, 0.0, 0.01), (3, 1.5, 6.2, 1.0), (4, 0.0, 0.0, 0.0), (5, 1.0, 1.0, 3.2), (6, None, 1.0, 1.0), (7, math.pi / 2, 0.0, 1e-6)]


def test_cones_hold_their_points(spark, frame, points):
    cones = frame(CONES, "cone long, theta double, phi double, radius double")
    got = skypix.within(cones, frame([*points, (3000, None, 1.0)], SCHEMA), 3.2)
    want = sorted((c, i) for c, t, p, r in CONES if t is not None for i, a, b in points if apart(t, p, a, b) <= r)
    assert sorted((r.cone, r.point_id) for r in got.collect()) == want and (4, 2000) in want and (7, 2002) in want


def test_a_cover_holds_all_and_its_inner_ranges_only_points_inside(spark, frame, points):
    ranges = skypix.cover(frame(CONES, "cone long, theta double, phi double, radius double"), 5).collect()
    pixel = {r.id: r.p for r in frame(points, SCHEMA).select("id", skypix.pixel(F.col("theta"), F.col("phi"), 5).alias("p")).collect()}
    for c, t, p, r in CONES[:5]:
        own = [x for x in ranges if x.cone == c]
        for i, a, b in points:
            hit = [x for x in own if x.low <= pixel[i] < x.high]
            assert len(hit) <= 1
            if apart(t, p, a, b) <= r:
                assert hit
            elif hit:
                assert not hit[0].inside


def test_close_directions(spark, frame, points):
    got = skypix.close_directions(frame(points, SCHEMA), 0.05, "id").collect()
    want = {(i, j) for i, a, b in points for j, c, d in points if i < j and apart(a, b, c, d) <= 0.05}
    assert {(r.id_a, r.id_b) for r in got} == want and len(got) == len(want)


def test_masks(spark, frame, points):
    all_points = frame(points, SCHEMA)
    assert {r.id for r in skypix.in_patch(all_points, 1.0, 2.0, 0.4).collect()} == {i for i, a, b in points if apart(1.0, 2.0, a, b) <= 0.4}
    with pytest.raises(ValueError, match="time"):
        skypix.in_patch(all_points, 1.0, 2.0, 0.4, frame="icrs")
    with pytest.raises(ValueError, match="radius"):
        skypix.in_patch(all_points, 1.0, 2.0, 4.0)
    values = frame([(p, float(p % 3)) for p in range(192)], "pixel long, value double")
    got = {r.id for r in skypix.on_map(all_points, values, 2, 0.5, ring=True).collect()}
    assert {i for i, a, b in points if i < 2000 and ring_by_hand(4, a, b) % 3 > 0} == {i for i in got if i < 2000}
    sky = skypix.in_patch(all_points, 1.0, 2.0, 0.4, "icrs", F.lit(1.2e9))
    from chirplake.functions import geo

    moved = all_points.withColumn("phi", geo.longitude_to_ra(F.col("phi"), F.lit(1.2e9)))
    assert {r.id for r in sky.collect()} == {r.id for r in skypix.in_patch(moved, 1.0, 2.0, 0.4).collect()}


def test_a_circle_is_at_least_one_pixel_and_holds_the_pixels_of_its_points(spark, frame, points):
    cones = frame([(1, 1.0, 2.0, 0.0), (2, 0.4, 5.0, 0.7)], "cone long, theta double, phi double, radius double")
    mask = {(r.cone, r.pixel) for r in skypix.circles(cones, 3).collect()}
    size = math.sqrt(math.pi / 3) / 8
    pixel = {r.id: r.p for r in frame(points, SCHEMA).select("id", skypix.pixel(F.col("theta"), F.col("phi"), 3).alias("p")).collect()}
    for c, t, p, r in ((1, 1.0, 2.0, size), (2, 0.4, 5.0, 0.7)):
        assert {pixel[i] for i, a, b in points if apart(t, p, a, b) <= r} <= {x for k, x in mask if k == c}
    full = skypix.full_mask(spark, skypix.circles(cones.where("cone = 2"), 3), 3)
    assert full.count() == 768 and full.agg(F.sum("value")).first()[0] == sum(k == 2 for k, _ in mask)


def test_nearest_points(spark, frame, points):
    targets = [(1, 0.3, 0.2), (2, 3.0, 4.0), (3, 1.6, 6.28), (4, None, 0.0)]
    grid = [p for p in points if p[0] % 300 == 0]  # few, so cones must grow
    got = skypix.nearest_point(frame(grid, SCHEMA), frame(targets, "target long, theta double, phi double"), "id", "target", order=5)
    want = {t: min((apart(a, b, x, y), i) for i, x, y in grid)[1] for t, a, b in targets[:3]}
    assert {r.target: r.id for r in got.collect()} == want
    assert skypix.nearest_point(frame([], SCHEMA), frame(targets, "target long, theta double, phi double"), "id", "target").count() == 0
