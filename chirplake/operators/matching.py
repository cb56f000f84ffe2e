"""Trigger-to-simulation matching and nearest joins."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import with_cells


def trigger_window(df: DataFrame, gps: str = "gps_time") -> tuple[Column, Column]:
    """Least and greatest of the detectors' event bounds, each moved by its segment lag; the time itself where there are none."""
    def moved(kind: str) -> list[Column]:
        out = []
        for name in df.columns:
            if name.startswith(f"{kind}_"):
                lag = f"segment_lag_{name[len(kind) + 1:]}"
                out.append(F.coalesce(F.col(name) + (F.coalesce(F.col(lag), F.lit(0.0)) if lag in df.columns else F.lit(0.0)), F.col(gps)))
        return out

    starts, stops = moved("event_start"), moved("event_stop")
    lo = F.least(*starts, F.col(gps)) if starts else F.col(gps)
    hi = F.greatest(*stops, F.col(gps)) if stops else F.col(gps)
    return lo, hi


def overlapping(triggers: DataFrame, sims: DataFrame, buffer: float = 0.0, cell: float | None = None) -> DataFrame:
    """All pairs with equal trial (and job, where both sides have it) whose windows overlap strictly; simulation columns as sim_*."""
    lo, hi = trigger_window(triggers)
    t = triggers.withColumn("_lo", lo - buffer).withColumn("_hi", hi + buffer)
    s = sims.select(*[F.col(c).alias(f"sim_{c}") for c in sims.columns])
    keys = [k for k in ("trial_idx", "job_id") if k in triggers.columns and k in sims.columns]
    on = F.lit(True)
    if not cell and not keys:
        raise ValueError("without a key in common, the join needs cells of time")
    if cell:
        t = with_cells(t, F.col("_lo"), F.col("_hi"), cell)
        s = with_cells(s, F.col("sim_real_start"), F.col("sim_real_end"), cell).withColumnRenamed("_cell", "_cell2")
        first = F.floor(F.greatest("_lo", "sim_real_start") / cell)
        on = (F.col("_cell") == F.col("_cell2")) & (first == F.col("_cell"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"sim_{k}"))
    on = on & (F.col("_lo") < F.col("sim_real_end")) & (F.col("_hi") > F.col("sim_real_start"))
    return t.join(s, on).drop("_lo", "_hi", "_cell", "_cell2")


#: Comparisons of a step of ``_loudest``, which bound its memory.
STEP = 1 << 21
#: Cells of a group of ``matched``.
BLOCK = 32


def _loudest(loud: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: np.ndarray, start: np.ndarray, end: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """For each window the place of its overlapping trigger of least ``loud``, then nearest, then first; -1 where there is none.

    Triggers come sorted by ``loud``, so a window looks at them from the loudest on
    and is done at the first that it meets; all as loud as that one are then compared.
    """
    best = np.full(len(start), -1, np.int64)
    # windows that nothing overlaps would look at all triggers
    some = np.searchsorted(np.sort(lo), end, "left") - np.searchsorted(np.sort(hi), start, "right") > 0
    todo, first = np.flatnonzero(some), 0
    while len(todo) and first < len(lo):
        last = min(len(lo), first + max(1, min(max(64, first), STEP // len(todo))))
        met = (lo[None, first:last] < end[todo, None]) & (hi[None, first:last] > start[todo, None])
        found = met.any(axis=1)
        best[todo[found]] = first + met[found].argmax(axis=1)
        todo, first = todo[~found], last
    met = np.flatnonzero(best >= 0)
    left, right = (np.searchsorted(loud, loud[best[met]], side) for side in ("left", "right"))
    met, left, right = (x[right - left > 1] for x in (met, left, right))
    order = np.argsort(left, kind="stable")
    for some in np.split(order, np.flatnonzero(np.diff(left[order])) + 1) if len(order) else []:
        a, b = left[some[0]], right[some[0]]
        for part in np.array_split(some, max(1, -(-len(some) * int(b - a) // STEP))):
            w = met[part]
            near = np.abs(at[None, a:b] - middle[w, None])
            near = np.where(np.isnan(near), -1.0, near)  # as a null distance is ordered
            near[~((lo[None, a:b] < end[w, None]) & (hi[None, a:b] > start[w, None]))] = np.inf
            best[w] = a + near.argmin(axis=1)
    return best


def _candidates(t: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
    """The best trigger of each cell for each of its windows; windows alike look once."""
    code, seen = pd.factorize(t["_loud"], sort=True)
    t = t.assign(_code=np.where(code < 0, len(seen), code)).sort_values(["_cell", "_code", "_id"], kind="stable")
    s = s.sort_values(["_cell", "_start", "_end", "_at"], kind="stable")
    windows = s[["_cell", "_start", "_end", "_at"]].to_numpy(float)
    fresh = np.ones(len(s), bool)
    fresh[1:] = (windows[1:] != windows[:-1]).any(axis=1)
    which, (cells, *alike) = np.cumsum(fresh) - 1, windows[fresh].T
    of_cell, columns = t["_cell"].to_numpy(float), [t[c].to_numpy(float) for c in ("_code", "_lo", "_hi", "_gps")]
    best = np.full(len(cells), -1, np.int64)
    for first, last in zip(*(np.searchsorted(cells, np.unique(cells), side) for side in ("left", "right")), strict=True):
        left, right = (np.searchsorted(of_cell, cells[first], side) for side in ("left", "right"))
        got = _loudest(*[c[left:right] for c in columns], *[c[first:last] for c in alike])
        best[first:last] = np.where(got < 0, -1, got + left)
    best = best[which]
    some = best >= 0
    won = t.iloc[best[some]]
    return pd.DataFrame({"_sim": s["_sim"].to_numpy()[some], "_id": won["_id"].to_numpy(), "_loud": won["_loud"].to_numpy(float), "_dist": np.abs(won["_gps"].to_numpy(float) - s["_at"].to_numpy(float)[some])})


def matched(triggers: DataFrame, sims: DataFrame, buffer: float, cell: float) -> DataFrame:
    """``resolve`` of the ``overlapping`` pairs, without the pairs, whose number is the square of how close rows lie.

    Both sides meet in blocks of cells of time, in narrow rows, and a cell gives one trigger
    for each simulation.  Triggers alike but for the id count by their first one.
    """
    keys = [k for k in ("trial_idx", "job_id") if k in triggers.columns and k in sims.columns]
    k = [f"_k{i}" for i in range(len(keys))]
    named = lambda prefix="": [F.col(prefix + c).alias(n) for c, n in zip(keys, k, strict=True)]
    lo, hi = trigger_window(triggers)
    loud = F.coalesce(-F.col("rho").cast("double"), F.lit(float("inf")))
    t = triggers.select(*named(), (lo - buffer).cast("double").alias("_lo"), (hi + buffer).cast("double").alias("_hi"), F.col("gps_time").cast("double").alias("_gps"), loud.alias("_loud"), F.col("id").alias("_id")).dropna(subset=[*k, "_lo", "_hi", "_id"])
    t = t.groupBy(*k, "_lo", "_hi", "_gps", "_loud").agg(F.min("_id").alias("_id"))
    s = sims.select(*named(), F.col("real_start").cast("double").alias("_start"), F.col("real_end").cast("double").alias("_end"), F.col("gps_time").cast("double").alias("_at"), F.col("sim_idx").alias("_sim")).dropna(subset=[*k, "_start", "_end"])
    t, s = with_cells(t, F.col("_lo"), F.col("_hi"), cell), with_cells(s, F.col("_start"), F.col("_end"), cell)
    # a group is a block of cells: one for each cell would cost more than its rows
    t, s = (x.withColumn("_block", F.floor(F.col("_cell") / BLOCK)) for x in (t, s))
    kinds = dict(t.dtypes) | dict(s.dtypes)
    by = [*k, "_block"]
    found = t.groupBy(*by).cogroup(s.groupBy(*by)).applyInPandas(lambda g, a, b: _keyed(g[:-1], k, _candidates(a, b)), ", ".join([f"{n} {kinds[n]}" for n in (*k, "_sim", "_id")] + ["_loud double", "_dist double"]))
    one = found.groupBy("_sim").agg(F.min_by(F.struct(*k, "_sim", "_id", "_dist"), F.struct("_loud", "_dist", "_id")).alias("r")).select("r.*")
    kept = one.groupBy("_id").agg(F.min_by(F.struct(*k, "_sim", "_id"), F.struct("_dist", "_sim")).alias("r")).select("r.*")
    left = triggers.dropDuplicates(["id", *keys])
    right = sims.select(*[F.col(c).alias(f"sim_{c}") for c in sims.columns]).dropDuplicates(["sim_sim_idx", *[f"sim_{c}" for c in keys]])
    # Spark can't know that these are as many rows as there are matches
    both = left.join(kept.hint("merge"), (left["id"] == kept["_id"]) & _all(left[c] == kept[n] for c, n in zip(keys, k, strict=True)))
    out = both.hint("merge").join(right, both["_sim"].eqNullSafe(right["sim_sim_idx"]) & _all(right[f"sim_{c}"] == both[n] for c, n in zip(keys, k, strict=True)))
    return out.select(*left.columns, *right.columns)


def _keyed(values: tuple, names: Sequence[str], rows: pd.DataFrame) -> pd.DataFrame:
    return rows.assign(**dict(zip(names, values, strict=True)))[[*names, "_sim", "_id", "_loud", "_dist"]]


def _all(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def resolve(pairs: DataFrame) -> DataFrame:
    """One to one, in two passes: each simulation keeps its loudest (then nearest, then first) trigger, each trigger then its nearest simulation.

    A maximum per key in each pass, so no key's pairs are sorted in one task.
    """
    dist = F.abs(F.col("gps_time") - F.col("sim_gps_time"))
    row = F.struct(*pairs.columns)
    loud = F.struct(F.coalesce(-F.col("rho").cast("double"), F.lit(float("inf"))), dist, F.col("id"))
    one = pairs.groupBy("sim_sim_idx").agg(F.min_by(row, loud).alias("r")).select("r.*")
    near = F.struct(dist, F.col("sim_sim_idx"))
    return one.groupBy("id").agg(F.min_by(F.struct(*one.columns), near).alias("r")).select("r.*")


def match(triggers: DataFrame, sims: DataFrame, how: str = "inner", buffer: float = 0.0, cell: float | None = None) -> DataFrame:
    """Matched pairs, and with left, right or outer also the rows of that side without one."""
    if how not in ("inner", "left", "right", "outer"):
        raise ValueError(f"unknown kind of join: {how}")
    found = matched(triggers, sims, buffer, cell) if cell else resolve(overlapping(triggers, sims, buffer))
    out = found
    if how in ("left", "outer"):
        out = out.unionByName(triggers.join(found.select("id").distinct(), "id", "left_anti"), allowMissingColumns=True)
    if how in ("right", "outer"):
        free = sims.join(found.select(F.col("sim_sim_idx").alias("sim_idx")).distinct(), "sim_idx", "left_anti")
        out = out.unionByName(free.select(*[F.col(c).alias(f"sim_{c}") for c in sims.columns]), allowMissingColumns=True)
    return out


def nearest(points: DataFrame, events: DataFrame, window: float, at: str, event_at: str, event_id: str, key: str) -> DataFrame:
    """For each point the event nearest in time within the window; of equally near ones the smallest id.

    Both sides meet in cells as long as the window, an event also in the two beside
    its own; there a point takes the last event before it and the first behind it,
    so there are no pairs, however close rows lie.
    """
    cell = lambda c: F.floor(F.col(c) / window).cast("long")
    e = events.where(F.col(event_at).isNotNull() & F.col(event_id).isNotNull()).groupBy(F.col(event_at).cast("double").alias("_at")).agg(F.min(event_id).alias("_id"))
    e = e.withColumn("_cell", F.explode(F.array(*[cell("_at") + d for d in (-1, 0, 1)])))
    p = points.where(F.col(at).isNotNull()).select(F.col(at).cast("double").alias("_at"), F.col(key).alias("_key")).withColumn("_cell", cell("_at")).withColumn("_point", F.lit(True))
    own = F.when(F.col("_point").isNull(), F.struct("_at", "_id"))
    before, after = (Window.partitionBy("_cell").orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow) for o in (F.col("_at").asc(), F.col("_at").desc()))
    seen = e.unionByName(p, allowMissingColumns=True).withColumn("_before", F.max(own).over(before)).withColumn("_after", F.min(own).over(after)).where("_point")
    found = lambda c: F.struct(F.abs(F.col(f"{c}._at") - F.col("_at")).alias("dt"), F.col(f"{c}._id").alias("id"))
    near = F.array_min(F.array(*[F.when(F.abs(F.col(f"{c}._at") - F.col("_at")) <= window, found(c)) for c in ("_before", "_after")]))
    best = seen.select(F.col("_key").alias(key), near.alias("m")).where("m IS NOT NULL").groupBy(key).agg(F.min("m").alias("m"))
    return points.join(best, key).select(*points.columns, F.col("m.id").alias("nearest_id"), F.col("m.dt").alias("dt"))


def semi(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys.select(*on).distinct(), list(on), "left_semi")


def anti(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys.select(*on).distinct(), list(on), "left_anti")


#: Parts of ``window`` that a group of ``close_pairs`` is long, and its rows at most: the pairs of two groups are held at once.
SLOTS, GROUP = 4, 256
#: Rows of a cell of time that one task pairs, and rows of all its cells that a task has on average at most.
CROWD, SHARE = 100_000, 250_000
#: Degrees beyond which sines and cosines are too rough to tell by them which directions can't be close.
TURNS = 1e6


def close_groups(df: DataFrame, window: float, degrees: float, at: str = "gps", key: str = "id") -> DataFrame:
    """Two groups of kinds of rows (a, b) wherever ``close_pairs`` may have a pair in them; each pair of rows is in one at most.

    Rows of one time and direction are one kind, with their ids; a group's kinds are alike
    in both.  Groups meet in cells of time and are told apart by their boxes: of time, and of
    the unit vectors.  Both sides are made from one shuffle of narrow rows, a row's own cell
    and the next, in as many tasks as the rows ask for, whatever the session's number.  The
    earlier rows of a crowded cell are dealt to several tasks.
    """
    chord = 2 * math.sin(_limit(degrees) / 2)
    size = min(max(chord / 2, 0.1), 0.5)
    theta, phi = F.radians("theta"), F.radians("phi")
    place = {"x": F.sin(theta) * F.cos(phi), "y": F.sin(theta) * F.sin(phi), "z": F.cos(theta)}
    told = (F.abs("theta") <= TURNS) & (F.abs("phi") <= TURNS)
    # no pair has an infinite time, and the separation from a missing direction is 180
    known = F.col("theta").isNotNull() & F.col("phi").isNotNull() if degrees <= 180 else F.lit(True)
    rows = df.select(F.col(key).alias("id"), F.col(at).alias("t"), "theta", "phi").where((F.abs("t") < float("inf")) & known)
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-2 * rows.count() // SHARE))
    # slots are a little longer than parts of the window, as rounding could move a row over an edge
    rows = rows.withColumn("_slot", F.floor(F.col("t") / (window / SLOTS * 1.01))).withColumn("_own", F.floor(F.col("_slot") / SLOTS))
    celled = rows.withColumn("_cell", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    crowded = F.broadcast(celled.groupBy("_cell").count().where(F.col("count") > CROWD).select("_cell", F.ceil(F.col("count") / CROWD).alias("_deals")))
    deals, own = F.coalesce("_deals", F.lit(1)), F.col("_cell") == F.col("_own")
    # of its own cell a row is in all deals as the later one of a pair, and in one as the earlier
    dealt = celled.join(crowded, "_cell", "left").withColumn("_one", F.pmod(F.xxhash64("id", "t", "theta", "phi"), deals))
    dealt = dealt.withColumn("_deal", F.explode(F.when(own, F.sequence(F.lit(0).cast("long"), deals - 1)).otherwise(F.array("_one"))))
    sides = F.when(own, 2).otherwise(0) + F.when(F.col("_deal") == F.col("_one"), 1).otherwise(0)
    dealt = dealt.select("id", "t", "theta", "phi", "_slot", "_cell", "_deal", sides.cast("byte").alias("_sides")).repartition(tasks, "_cell", "_deal")

    def groups(side: str, bit: int) -> DataFrame:
        by, part = ["_cell", "_deal", "_slot"], [F.floor(F.col(c) / size).alias(f"_{c}") for c in place]
        placed = lambda df: df.withColumns({c: F.when(told, v) for c, v in place.items()}).select("*", *part)
        numbered = placed(dealt).withColumn("_part", F.floor((F.row_number().over(Window.partitionBy(*by, "_x", "_y", "_z").orderBy("t", "theta", "phi", "id")) - 1) / GROUP))
        ids = F.collect_list(F.when(F.col("_sides").bitwiseAND(F.lit(bit).cast("byte")) > 0, F.struct("id")))
        kinds = placed(numbered.groupBy(*by, "_part", "t", "theta", "phi").agg(ids.alias("ids")).where(F.size("ids") > 0))
        box = [f(c).alias(f"{side}_{c}_{n}") for c in ("t", *place) for n, f in (("lo", F.min), ("hi", F.max))]
        return kinds.groupBy(*by, "_x", "_y", "_z", "_part").agg(F.collect_list(F.struct("t", "theta", "phi", *place, "ids")).alias(side), *box).drop("_slot", "_x", "_y", "_z", "_part")

    # directions that aren't told have no box, and are looked at beside all others
    gap = [F.greatest(F.col(f"a_{c}_lo") - F.col(f"b_{c}_hi"), F.col(f"b_{c}_lo") - F.col(f"a_{c}_hi"), F.lit(0.0)) for c in place]
    near = (F.col("b_t_hi") >= F.col("a_t_lo")) & (F.col("b_t_lo") - F.col("a_t_hi") < window) & (reduce(lambda x, y: x + y, [g * g for g in gap]) <= chord * chord + 1e-9)
    return groups("a", 1).join(groups("b", 2), ["_cell", "_deal"]).where(near).select("a", "b")


def _limit(degrees: float) -> float:
    return math.radians(min(max(degrees, 0.0), 180.0))


def close_pairs(df: DataFrame, window: float, degrees: float, at: str = "gps", key: str = "id") -> DataFrame:
    """Pairs closer than ``window`` in time and ``degrees`` on the sky (theta, phi in degrees), each once.

    Their number is the square of how close rows lie; ``close_groups`` leaves out most that
    are not close.  A direction that is not finite has no separation and counts as close.
    Whether rows are close is asked once for two kinds, and the pairs of two kinds come
    together, one first id after the other: values stand in runs, which files of them keep short.
    """
    from ..functions.geo import separation

    columns, cosine = ("t", "theta", "phi", "x", "y", "z", "ids"), math.cos(_limit(degrees))
    each = close_groups(df, window, degrees, at, key).select("b", F.inline("a").alias(*[f"{c}_a" for c in columns]))
    each = each.select(*[f"{c}_a" for c in columns], F.inline("b").alias(*[f"{c}_b" for c in columns]))
    dot = reduce(lambda x, y: x + y, [F.col(f"{c}_a") * F.col(f"{c}_b") for c in "xyz"])
    # the separation itself is needed only where rounding could decide, or without unit vectors
    close = F.when(dot > cosine + 1e-9, True).when(dot < cosine - 1e-9, False).otherwise(separation(F.col("theta_a"), F.col("phi_a"), F.col("theta_b"), F.col("phi_b")) < degrees)
    kinds = each.where((F.col("t_b") >= F.col("t_a")) & (F.col("t_b") - F.col("t_a") < window) & close).select("ids_a", "ids_b", (F.col("t_b") > F.col("t_a")).alias("_later"), (F.col("t_b") - F.col("t_a")).alias("dt"))
    pairs = kinds.select("ids_b", "_later", "dt", F.inline("ids_a").alias("id_a")).select("id_a", "_later", "dt", F.inline("ids_b").alias("id_b"))
    return pairs.where(F.col("_later") | (F.col("id_b") > F.col("id_a"))).select("id_a", "id_b", "dt")
