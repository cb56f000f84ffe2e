"""The operators on the provided tables, each with the SQL that must give the same rows.

Stand-ins: events are triggers (job = user, time = seconds of ts, rho = value,
injection parameters = props); line items with their orders are progress rows
(job = customer, lag = line number - 1, live time = quantity); events of one
type with half a window on either side are simulations; parts are waveform
families; embeddings are waveforms.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, geo
from ..operators import catalog, cuts, efficiency, far, features, intervals, jobs, kernels, lags, matching, reports, selection, sky
from ..session import scratch_dir
from ..sources import store
from ..streaming import online

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

SECONDS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {}) / 1000000D"
_T = "t AS (SELECT event_id AS id, user_id AS job_id, epoch(ts) AS gps_time, value AS rho, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"
_P = "p AS (SELECT o_custkey AS job_id, l_linenumber - 1 AS lag_idx, l_quantity AS livetime, o_orderstatus AS status, epoch(o_orderdate) AS timestamp FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
YEAR = catalog.YEAR
#: The stand-ins' range of rho, and the bins of their curve.
LO, WIDTH, BINS, LIVETIME = 0.0, 10.0, 60, 1.0e7


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("job_id"), F.expr(SECONDS.format("ts")).alias("gps_time"), F.col("value").alias("rho"), "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    both = items.select("l_orderkey", "l_linenumber", "l_quantity").join(orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.select(F.col("o_custkey").alias("job_id"), (F.col("l_linenumber") - 1).alias("lag_idx"), F.col("l_quantity").alias("livetime"), F.col("o_orderstatus").alias("status"), F.expr(SECONDS.format("o_orderdate")).alias("timestamp"))


def query(sql: str | None = None, *ctes: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = ("WITH " + ", ".join(ctes) + " " if ctes else "") + sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


_CURVE = f"g AS (SELECT unnest(range({BINS})) AS bin), b AS (SELECT CASE WHEN rho = {LO + WIDTH * BINS} THEN {BINS - 1} ELSE CAST(floor((rho - {LO}) / {WIDTH}) AS BIGINT) END AS bin, count(*) AS n FROM t WHERE rho BETWEEN {LO} AND {LO + WIDTH * BINS} GROUP BY 1), f AS (SELECT g.bin, {LO} + (g.bin + 0.5) * {WIDTH} AS center, coalesce(n, 0) AS n, CAST(sum(coalesce(n, 0)) OVER (ORDER BY g.bin DESC) AS BIGINT) AS n_above FROM g LEFT JOIN b USING (bin)), c AS (SELECT *, n_above / ({LIVETIME} / {YEAR}) AS far FROM f)"


def _curve(spark: SparkSession, d: str) -> DataFrame:
    return far.far_curve(triggers(spark, d), "rho", LO, WIDTH, BINS, LIVETIME)


@query("SELECT bin, center, n, n_above, round(far, 6) AS far FROM c", _T, _CURVE)
def far_curve(spark, d):
    return rounded(_curve(spark, d), "far")


@query(f"SELECT threshold, (SELECT count(*) FROM t WHERE rho >= threshold) AS n_above, round((SELECT count(*) FROM t WHERE rho >= threshold) / {LIVETIME} * 1e6, 6) AS rate, round(sqrt((SELECT count(*) FROM t WHERE rho >= threshold)) / {LIVETIME} * 1e6, 6) AS rate_error FROM (SELECT CAST(unnest(range(0, 500, 25)) AS DOUBLE) AS threshold)", _T)
def cumulative_rate(spark, d):
    out = far.cumulative_rate(triggers(spark, d), "rho", list(range(0, 500, 25)), LIVETIME)
    return rounded(out.withColumn("rate", F.col("rate") * 1e6).withColumn("rate_error", F.col("rate_error") * 1e6), "rate", "rate_error")


@query(f"SELECT id, round(far, 6) AS far, round(1 / greatest(far, 1e-30), 6) AS ifar_years, round(0 - log10(greatest(1 - exp(-far * {LIVETIME / YEAR}), 1e-300)), 6) AS significance FROM (SELECT id, greatest((SELECT far FROM c WHERE bin = CAST(greatest(0, least({BINS - 1}, floor((rho - {LO + WIDTH / 2}) / {WIDTH}))) AS BIGINT)), (SELECT min(far) FROM c WHERE far > 0)) AS far FROM t)", _T, _CURVE)
def far_attach(spark, d):
    return rounded(far.attach_far(triggers(spark, d).select("id", "rho"), "rho", _curve(spark, d), LIVETIME).select("id", "far", "ifar_years", "significance"), "far", "ifar_years", "significance")


@query(f"SELECT a.id, count(*) AS n_above, round(count(*) / {LIVETIME} * 1e6, 6) AS far_hz, round({LIVETIME} / count(*), 4) AS ifar_s FROM (SELECT * FROM t WHERE event_type = 'click') a JOIN t b ON b.rho >= a.rho GROUP BY a.id", _T)
def per_event_ifar(spark, d):
    t = triggers(spark, d)
    out = far.per_event_ifar(t.where("event_type = 'click'").select("id", "rho"), t, "rho", LIVETIME)
    return out.select("id", "n_above", F.round(F.col("far_hz") * 1e6, 6).alias("far_hz"), F.round("ifar_s", 4).alias("ifar_s"))


@query("SELECT min_by(rho, r) AS threshold FROM (SELECT rho, row_number() OVER (ORDER BY rho DESC, id) AS r FROM t) WHERE r / 1e7 >= 1 / 31557.6", _T)
def ifar_threshold(spark, d):
    # the quietest of the n loudest that the rate allows: a bounded top-k, no global rank
    allowed = int(-(-1e7 // 31557.6))
    return triggers(spark, d).orderBy(F.col("rho").desc(), "id").limit(allowed).agg(F.min("rho").alias("threshold"))


@query("SELECT id, rho, gps_time, CAST(row_number() OVER (ORDER BY rho DESC, id) AS BIGINT) AS rank FROM t ORDER BY rho DESC, id LIMIT 100", _T)
def loudest_topk(spark, d):
    return catalog.rank_top(triggers(spark, d).select("id", "rho", "gps_time"), "rho", "id", 100)


@query(f"SELECT id, rho, rank, round(rank / ({LIVETIME} / {YEAR}), 6) AS far FROM (SELECT id, rho, CAST(row_number() OVER (ORDER BY rho DESC, id) AS BIGINT) AS rank FROM t) WHERE rank <= 200", _T)
def rank_far_table(spark, d):
    return catalog.rank_top(triggers(spark, d).select("id", "rho"), "rho", "id", 200).withColumn("far", F.round(F.col("rank") / (LIVETIME / YEAR), 6))


_POINTS = [(0.0, 0.1), (50.0, 1.0), (100.0, 5.0), (200.0, 20.0), (400.0, 100.0)]


@query("SELECT id, round(CASE WHEN rho <= 0 THEN 0.1 " + " ".join(f"WHEN rho <= {b[0]} THEN {a[1]} + (rho - {a[0]}) * {(b[1] - a[1]) / (b[0] - a[0])!r}" for a, b in zip(_POINTS, _POINTS[1:], strict=False)) + " ELSE 100.0 END, 6) AS ifar FROM t", _T)
def ifar_interp(spark, d):
    return triggers(spark, d).select("id", F.round(far.interpolate(None, "rho", _POINTS), 6).alias("ifar"))


@query(f"SELECT round(1 - exp(-count(*) / {LIVETIME}), 9) AS p_value, round(-log10(1 - exp(-count(*) / {LIVETIME})), 6) AS significance FROM t WHERE rho >= 100", _T)
def poisson_significance(spark, d):
    mu = F.count("*") / LIVETIME
    p = 1 - F.exp(-mu)
    return triggers(spark, d).where("rho >= 100").agg(F.round(p, 9).alias("p_value"), F.round(-F.log10(p), 6).alias("significance"))


@query("SELECT job_id, lag_idx, livetime FROM p WHERE lag_idx = 0 AND job_id % 2 = 0", _P)
def zero_lag_rows(spark, d):
    p = progress(spark, d)
    return p.where(lags.zero_lag(p, F.col("job_id") % 2 == 0)).select("job_id", "lag_idx", "livetime")


@query("SELECT job_id, count(*) AS n FROM p WHERE NOT (lag_idx = 0 AND job_id % 2 = 0) GROUP BY 1", _P)
def nonzero_lag_rows(spark, d):
    p = progress(spark, d)
    return p.where(lags.nonzero_lag(p, F.col("job_id") % 2 == 0)).groupBy("job_id").agg(F.count("*").alias("n"))


@query("SELECT round(sum(livetime), 4) AS livetime, count(*) AS n_rows FROM p WHERE lag_idx = 0 AND status = 'F'", _P)
def zero_lag_livetime(spark, d):
    p = progress(spark, d)
    return rounded(catalog.live_time(p, lags.zero_lag(p, F.lit(True)) & (F.col("status") == "F")), "livetime", digits=4)


@query("SELECT job_id, round(sum(livetime), 4) AS livetime, count(*) AS n_rows FROM p GROUP BY 1", _P)
def livetime_by_job(spark, d):
    return rounded(catalog.live_time(progress(spark, d), by=["job_id"]), "livetime", digits=4)


@query("SELECT lag_idx, round(sum(livetime), 4) AS livetime, count(*) AS n_rows FROM p GROUP BY 1", _P)
def livetime_by_lag(spark, d):
    return rounded(catalog.live_time(progress(spark, d), by=["lag_idx"]), "livetime", digits=4)


@query("SELECT c_custkey AS job_id, lag_idx, round(c_acctbal + 2000, 4) AS livetime FROM customer, (SELECT unnest(range(5)) AS lag_idx)")
def livetime_fallback(spark, d):
    j = read(spark, d, "customer").select(F.col("c_custkey").alias("job_id"), F.lit(0.0).alias("analyze_start"), (F.col("c_acctbal") + 2000).alias("analyze_end"))
    return catalog.live_time_from_jobs(j, 5).select("job_id", F.col("lag_idx").cast("long"), F.round("livetime", 4).alias("livetime"))


@query("SELECT job_id, CAST(sum(CASE WHEN status = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS n_done, CAST(sum(CASE WHEN status = 'F' THEN 0 ELSE 1 END) AS BIGINT) AS n_skipped, round(sum(livetime), 4) AS livetime, max(timestamp) AS last_seen FROM p GROUP BY 1", _P)
def progress_by_job(spark, d):
    return rounded(catalog.progress_by_job(progress(spark, d), "F"), "livetime", digits=4)


@query("SELECT job_id, CAST(sum(CASE WHEN status = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS n_done, CAST(sum(CASE WHEN status = 'F' THEN 0 ELSE 1 END) AS BIGINT) AS n_skipped, round(sum(livetime), 4) AS livetime, max(timestamp) AS last_seen FROM p GROUP BY 1", _P)
def progress_fragments(spark, d):
    p = progress(spark, d)
    parts = [catalog.progress_by_job(p.where(F.col("lag_idx") % 2 == i), "F") for i in (0, 1)]
    return rounded(catalog.combine_summaries(parts[0].unionByName(parts[1])), "livetime", digits=4)


@query("SELECT status, count(*) AS n FROM p GROUP BY 1", _P)
def status_counts(spark, d):
    return reports.status_counts(progress(spark, d))


@query("SELECT job_id, count(DISTINCT lag_idx) AS n_lags FROM p WHERE status = 'F' GROUP BY 1", _P)
def completed_lags(spark, d):
    return catalog.completed_lags(progress(spark, d), "F")


@query("SELECT status, lag_idx, round(sum(livetime), 4) AS livetime, count(*) AS n_rows, count(DISTINCT job_id) AS n_jobs FROM p GROUP BY 1, 2", _P)
def interval_summary(spark, d):
    return rounded(reports.interval_summary(progress(spark, d), ["status", "lag_idx"]), "livetime", digits=4)


@query("SELECT job_id, id, lag_idx, rho FROM (SELECT job_id, event_type AS id, k AS lag_idx, rho, row_number() OVER (PARTITION BY job_id, event_type, k ORDER BY id DESC) AS r FROM t) WHERE r = 1", _T)
def dedup_keep_last(spark, d):
    t = triggers(spark, d).select("job_id", F.col("event_type").alias("id"), F.col("k").alias("lag_idx"), "rho", F.col("id").alias("_seq"))
    return catalog.keep_last(t).drop("_seq")


@query("SELECT job_id, id, rho FROM (SELECT job_id, event_type AS id, rho, row_number() OVER (PARTITION BY job_id, event_type ORDER BY id DESC) AS r FROM t) WHERE r = 1", _T)
def dedup_two_key(spark, d):
    t = triggers(spark, d).select("job_id", F.col("event_type").alias("id"), "rho", F.col("id").alias("_seq"))
    return catalog.keep_last(t, ("job_id", "id")).drop("_seq")


@query("SELECT id, job_id FROM t WHERE job_id % 10 <> 3 OR EXISTS (SELECT 1 FROM p WHERE p.job_id = t.job_id AND p.lag_idx = t.k % 7 AND status = 'F')", _T, _P)
def stale_removal(spark, d):
    t = triggers(spark, d).withColumn("lag_idx", (F.col("k") % 7).cast("int"))
    return catalog.remove_stale(t, progress(spark, d).where("status = 'F'").select("job_id", "lag_idx"), F.col("job_id") % 10 == 3).select("id", "job_id")


_HALF = 600.0
_S = f"s AS (SELECT id AS sim_idx, job_id, k % 3 AS trial_idx, gps_time, gps_time - {_HALF} AS real_start, gps_time + {_HALF} AS real_end FROM t WHERE event_type = 'view'), g AS (SELECT id, job_id, k % 3 AS trial_idx, gps_time, rho FROM t WHERE event_type <> 'view'), m0 AS (SELECT g.*, s.sim_idx, s.gps_time AS sim_gps FROM g JOIN s ON g.trial_idx = s.trial_idx AND g.gps_time < s.real_end AND g.gps_time > s.real_start), m1 AS (SELECT * FROM m0 QUALIFY row_number() OVER (PARTITION BY sim_idx ORDER BY rho DESC NULLS LAST, abs(gps_time - sim_gps), id) = 1), m AS (SELECT * FROM m1 QUALIFY row_number() OVER (PARTITION BY id ORDER BY abs(gps_time - sim_gps), sim_idx) = 1)"


def _sides(spark, d):
    t = triggers(spark, d).withColumn("trial_idx", F.col("k") % 3)
    sims = t.where("event_type = 'view'").select(F.col("id").alias("sim_idx"), "trial_idx", "gps_time", (F.col("gps_time") - _HALF).alias("real_start"), (F.col("gps_time") + _HALF).alias("real_end"))
    return t.where("event_type <> 'view'").select("id", "trial_idx", "gps_time", "rho"), sims


def _match(how):
    def run(spark, d):
        t, s = _sides(spark, d)
        return matching.match(t, s, how, cell=2 * _HALF).select("id", "rho", "sim_sim_idx")

    return run


def match_inner(spark, d):
    return _match("inner")(spark, d)


def match_left(spark, d):
    return _match("left")(spark, d)


def match_right(spark, d):
    return _match("right")(spark, d)


def match_outer(spark, d):
    return _match("outer")(spark, d)


_IN = "SELECT id, rho, sim_idx AS sim_sim_idx FROM m"
_LEFT = " UNION ALL SELECT id, rho, NULL FROM g WHERE id NOT IN (SELECT id FROM m)"
_RIGHT = " UNION ALL SELECT NULL, NULL, sim_idx FROM s WHERE sim_idx NOT IN (SELECT sim_idx FROM m)"
for _f, _sql in ((match_inner, _IN), (match_left, _IN + _LEFT), (match_right, _IN + _RIGHT), (match_outer, _IN + _LEFT + _RIGHT)):
    query(_sql, _T, _S)(_f)


@query("SELECT id, sim_idx FROM m0", _T, _S)
def match_many_to_many(spark, d):
    t, s = _sides(spark, d)
    return matching.overlapping(t, s, cell=2 * _HALF).select("id", F.col("sim_sim_idx").alias("sim_idx"))


@query("SELECT a.id, min_by(b.id, struct_pack(dt := abs(b.gps_time - a.gps_time), i := b.id)) AS nearest_id, min(abs(b.gps_time - a.gps_time)) AS dt FROM (SELECT * FROM t WHERE event_type = 'purchase') a JOIN (SELECT * FROM t WHERE event_type <> 'purchase') b ON abs(b.gps_time - a.gps_time) <= 300 GROUP BY a.id", _T)
def nearest_asof(spark, d):
    t = triggers(spark, d)
    return matching.nearest(t.where("event_type = 'purchase'").select("id", "gps_time"), t.where("event_type <> 'purchase'"), 300.0, "gps_time", "gps_time", "id", "id").select("id", "nearest_id", "dt")


@query("SELECT id FROM t WHERE job_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')", _T)
def semi_job_filter(spark, d):
    c = read(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("job_id"))
    return matching.semi(triggers(spark, d), c, ["job_id"]).select("id")


@query("SELECT id FROM t WHERE job_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')", _T)
def anti_job_filter(spark, d):
    c = read(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("job_id"))
    return matching.anti(triggers(spark, d), c, ["job_id"]).select("id")


@query("SELECT id FROM t WHERE EXISTS (SELECT 1 FROM p WHERE p.job_id = t.job_id AND p.lag_idx = t.k % 7 AND status = 'O')", _T, _P)
def composite_semi(spark, d):
    t = triggers(spark, d).withColumn("lag_idx", (F.col("k") % 7).cast("int"))
    return matching.semi(t, progress(spark, d).where("status = 'O'"), ["job_id", "lag_idx"]).select("id")


@query("SELECT t.id, x.lag_idx FROM t JOIN (SELECT DISTINCT lag_idx, livetime FROM p WHERE lag_idx < 2) x ON abs(CAST(t.k AS DOUBLE) - x.livetime) <= 1e-12 AND t.event_type = 'purchase'", _T, _P)
def tolerance_join(spark, d):
    t = triggers(spark, d).where("event_type = 'purchase'").withColumn("shift", F.col("k").cast("double"))
    x = progress(spark, d).where("lag_idx < 2").select("lag_idx", "livetime").distinct()
    # equal within the tolerance means equal when rounded far above it; the rest is the residual
    on = (F.round("shift", 6) == F.round("livetime", 6)) & (F.abs(F.col("shift") - F.col("livetime")) <= lags.TOLERANCE)
    return t.join(x, on).select("id", "lag_idx")


_SKY = "sky AS (SELECT id, gps_time, CAST(id % 180 AS DOUBLE) AS theta, CAST((id * 7) % 360 AS DOUBLE) AS phi FROM t)"


@query("SELECT a.id AS id_a, b.id AS id_b, round(b.gps_time - a.gps_time, 6) AS dt FROM sky a JOIN sky b ON (b.gps_time > a.gps_time OR (b.gps_time = a.gps_time AND b.id > a.id)) AND b.gps_time - a.gps_time < 900 AND degrees(acos(least(1.0, greatest(-1.0, cos(radians(a.theta)) * cos(radians(b.theta)) + sin(radians(a.theta)) * sin(radians(b.theta)) * cos(radians(a.phi - b.phi)))))) < 20", _T, _SKY)
def spatial_dup_pairs(spark, d):
    t = triggers(spark, d).select("id", F.col("gps_time").alias("gps"), (F.col("id") % 180).cast("double").alias("theta"), ((F.col("id") * 7) % 360).cast("double").alias("phi"))
    # what round gives for times of whole microseconds, but without a decimal for each pair
    return matching.close_pairs(t, 900.0, 20.0).withColumn("dt", F.floor(F.col("dt") * 1e6 + 0.5) / 1e6)


_IV = "iv AS (SELECT job_id, event_type, gps_time AS s, gps_time + 1000 + k * 10 AS e FROM t)"


def _iv(spark, d):
    return triggers(spark, d).select("id", "job_id", "event_type", F.col("gps_time").alias("start"), (F.col("gps_time") + 1000 + F.col("k") * 10).cast("double").alias("end"))


@query("SELECT a.job_id, round(greatest(a.s, b.s), 4) AS start, round(least(a.e, b.e), 4) AS \"end\" FROM iv a JOIN iv b ON a.job_id = b.job_id AND a.event_type = 'view' AND b.event_type = 'click' AND a.s < b.e AND b.s < a.e", _T, _IV)
def interval_intersect(spark, d):
    v = _iv(spark, d)
    return rounded(intervals.intersect(v.where("event_type = 'view'"), v.where("event_type = 'click'"), ["job_id"], width=4000.0), "start", "end", digits=4)


@query("SELECT job_id, round(min(s), 3) AS start, round(max(e), 3) AS \"end\" FROM (SELECT *, sum(CASE WHEN b IS NULL OR s > b THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM (SELECT *, max(e) OVER (PARTITION BY job_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM iv)) GROUP BY job_id, i", _T, _IV)
def interval_union(spark, d):
    return rounded(intervals.union(_iv(spark, d), ["job_id"]), "start", "end", digits=3)


@query("SELECT job_id, round(sum(least(e, floor(s / 86400) * 86400 + 43200) - greatest(s, floor(s / 86400) * 86400)), 3) AS livetime FROM iv WHERE least(e, floor(s / 86400) * 86400 + 43200) > greatest(s, floor(s / 86400) * 86400) GROUP BY 1", _T, _IV)
def interval_clip(spark, d):
    day = F.floor(F.col("start") / 86400) * 86400
    out = intervals.clip(_iv(spark, d).withColumn("day", day), F.col("day").cast("double"), (F.col("day") + 43200).cast("double"))
    return rounded(intervals.total(out, ["job_id"]), "livetime", digits=3)


@query("SELECT job_id, round(sum(CASE WHEN a + l <= 5000 THEN l ELSE (5000 - a) + (a + l - 5000) END), 3) AS livetime, CAST(sum(CASE WHEN a + l <= 5000 THEN 1 ELSE 2 END) AS BIGINT) AS pieces FROM (SELECT job_id, (s + k0) % 5000 AS a, e - s AS l FROM (SELECT *, 1234.5 AS k0 FROM iv)) GROUP BY 1", _T, _IV)
def circular_livetime(spark, d):
    v = _iv(spark, d)
    out = intervals.shift_circular(v, F.lit(1234.5), F.lit(5000.0))
    return rounded(out.groupBy("job_id").agg(F.sum(F.col("end") - F.col("start")).alias("livetime"), F.count("*").alias("pieces")), "livetime", digits=3)


@query("SELECT job_id, max(c) AS max_overlap FROM (SELECT job_id, CAST(sum(dd) OVER (PARTITION BY job_id ORDER BY x, dd ROWS UNBOUNDED PRECEDING) AS BIGINT) AS c FROM (SELECT job_id, s AS x, 1 AS dd FROM iv UNION ALL SELECT job_id, e, -1 FROM iv)) GROUP BY 1", _T, _IV)
def chirp_overlap_sweep(spark, d):
    return intervals.max_overlap(_iv(spark, d), ["job_id"])


@query("SELECT job_id, round(b, 3) AS start, round(s, 3) AS \"end\" FROM (SELECT *, max(e) OVER (PARTITION BY job_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM iv) WHERE s > b", _T, _IV)
def frame_coverage(spark, d):
    return rounded(intervals.gaps(_iv(spark, d), ["job_id"]), "start", "end", digits=3)


@query("SELECT a.id, min(b.id) AS segment_idx FROM (SELECT id, gps_time FROM t WHERE event_type = 'click') a LEFT JOIN (SELECT id, gps_time AS s, gps_time + 900 AS e FROM t WHERE event_type = 'signup') b ON b.s <= a.gps_time AND a.gps_time < b.e GROUP BY a.id", _T)
def point_in_interval(spark, d):
    t = triggers(spark, d)
    seg = t.where("event_type = 'signup'").select(F.col("id").alias("segment_idx"), F.col("gps_time").alias("start"), (F.col("gps_time") + 900).alias("end"))
    return jobs.own_segment(t.where("event_type = 'click'").select("id", "gps_time"), seg, "gps_time", 900.0).select("id", "segment_idx")


@query("SELECT id, EXISTS (SELECT 1 FROM t b WHERE b.event_type = 'signup' AND b.gps_time <= a.gps_time AND a.gps_time < b.gps_time + 900) AS vetoed FROM t a WHERE event_type = 'click'", _T)
def boundary_flag(spark, d):
    t = triggers(spark, d)
    win = t.where("event_type = 'signup'").select(F.col("gps_time").alias("start"), (F.col("gps_time") + 900).alias("end"))
    return jobs.in_windows(t.where("event_type = 'click'").select("id", "gps_time"), win, "gps_time", 900.0, "vetoed").select("id", "vetoed")


@query("SELECT interval_id, piece, start, \"end\" FROM (SELECT interval_id, unnest(CASE WHEN n = 0 THEN CASE WHEN l >= 600 THEN [{'piece': 0, 'start': a, 'end': b}] ELSE [] END WHEN n = 1 THEN CASE WHEN l > 1200 AND floor(l / 2) >= 600 THEN [{'piece': 0, 'start': a, 'end': a + floor(l / 2)}, {'piece': 1, 'start': a + floor(l / 2), 'end': b}] WHEN l > 1200 THEN [{'piece': 0, 'start': a, 'end': a + 1200}] ELSE [{'piece': 0, 'start': a, 'end': b}] END ELSE list_transform(range(0, n - 1), lambda i: {'piece': CAST(i AS INTEGER), 'start': a + i * 1200, 'end': a + (i + 1) * 1200}) || CASE WHEN floor((b - a - (n - 1) * 1200) / 2) >= 600 THEN [{'piece': CAST(n - 1 AS INTEGER), 'start': a + (n - 1) * 1200, 'end': a + (n - 1) * 1200 + floor((b - a - (n - 1) * 1200) / 2)}, {'piece': CAST(n AS INTEGER), 'start': a + (n - 1) * 1200 + floor((b - a - (n - 1) * 1200) / 2), 'end': b}] ELSE [{'piece': CAST(n - 1 AS INTEGER), 'start': a + (n - 1) * 1200, 'end': a + n * 1200}] END END, recursive := true) FROM (SELECT *, b - a AS l, CAST(floor((b - a) / 1200) AS BIGINT) AS n FROM (SELECT id AS interval_id, ceil(gps_time) + 10.0 AS a, floor(gps_time + 40 * k) - 10.0 AS b FROM t)) WHERE l > 0)", _T)
def job_split(spark, d):
    t = triggers(spark, d).select(F.col("id").alias("interval_id"), F.col("gps_time").alias("start"), (F.col("gps_time") + 40 * F.col("k")).alias("end"))
    return jobs.split_jobs(t, 1200.0, 600.0, 10.0)


@query("SELECT CAST(0 AS BIGINT) AS s0, a AS s1, b AS s2, abs(a) + abs(b) AS distance FROM (SELECT unnest(range(-8, 9)) AS a), (SELECT unnest(range(-8, 9)) AS b) WHERE (a = 0 AND b = 0 OR a <> 0 AND b <> 0 AND a <> b) AND abs(a) + abs(b) <= 9 ORDER BY distance, s1, s2 LIMIT 60 OFFSET 2")
def superlags(spark, d):
    out = jobs.superlags(spark, 3, 8, 0, 9, off=2, size=60)
    return out.select(*[F.get("shift", F.lit(i)).alias(f"s{i}") for i in range(3)], "distance")


@query("SELECT c_custkey AS job_id, x AS lag_idx, round(x * 1.5 * 2, 6) AS shift FROM customer, (SELECT CAST(unnest(range(7)) AS INTEGER) AS x)")
def lag_plan(spark, d):
    return read(spark, d, "customer").select(F.col("c_custkey").alias("job_id"), jobs.lag_shifts(7, 1.5, 2).alias("x")).select("job_id", "x.lag_idx", F.round("x.shift", 6).alias("shift"))


@query("SELECT s.id, s.trial_idx, i.interval_id, round(i.start + s.pos - i.lo, 4) AS gps_time FROM (SELECT id, CAST(floor(i / cap) AS BIGINT) AS trial_idx, 50.0 + (i % cap) * st AS pos FROM (SELECT id, id AS i, cap, CASE WHEN cap > 1 THEN (tot - 100.0) / (cap - 1) ELSE 0 END AS st FROM t, (SELECT CAST(floor(sum(e - start) * 0.01) AS BIGINT) AS cap, sum(e - start) AS tot FROM q))) s JOIN (SELECT *, hi - (e - start) AS lo FROM (SELECT *, sum(e - start) OVER (ORDER BY start, interval_id ROWS UNBOUNDED PRECEDING) AS hi FROM q)) i ON s.pos >= i.lo AND s.pos < i.hi", _T, "q AS (SELECT c_custkey AS interval_id, c_custkey * 10000.0 AS start, c_custkey * 10000.0 + 500 + c_custkey % 97 AS e FROM customer WHERE c_custkey < 300)")
def schedule_rate(spark, d):
    iv = read(spark, d, "customer").where("c_custkey < 300").select(F.col("c_custkey").alias("interval_id"), (F.col("c_custkey") * F.lit(10000.0)).alias("start"), (F.col("c_custkey") * F.lit(10000.0) + 500 + F.col("c_custkey") % 97).alias("end"))
    out = jobs.schedule_at_rate(triggers(spark, d).select("id"), iv, 0.01, "id")
    return out.select("id", "trial_idx", "interval_id", F.round("gps_time", 4).alias("gps_time"))


@query("SELECT s.id, s.trial_idx, i.interval_id, round(i.start + s.pos - i.lo, 4) AS gps_time FROM (SELECT id, CAST(floor(i / cap) AS BIGINT) AS trial_idx, 50.0 + (i % cap) * st AS pos FROM (SELECT id, id AS i, cap, CASE WHEN cap > 1 THEN (tot - 100.0) / (cap - 1) ELSE 0 END AS st FROM t, (SELECT CAST(floor(sum(e - start) * 0.01) AS BIGINT) AS cap, sum(e - start) AS tot FROM q))) s JOIN (SELECT *, hi - (e - start) AS lo FROM (SELECT *, sum(e - start) OVER (ORDER BY start, interval_id ROWS UNBOUNDED PRECEDING) AS hi FROM q)) i ON s.pos >= i.lo AND s.pos < i.hi", _T, "q AS (SELECT c_custkey AS interval_id, c_custkey * 10000.0 AS start, c_custkey * 10000.0 + 500 + c_custkey % 97 AS e FROM customer)")
def schedule_rate_all(spark, d):
    iv = read(spark, d, "customer").select(F.col("c_custkey").alias("interval_id"), (F.col("c_custkey") * F.lit(10000.0)).alias("start"), (F.col("c_custkey") * F.lit(10000.0) + 500 + F.col("c_custkey") % 97).alias("end"))
    out = jobs.schedule_at_rate(triggers(spark, d).select("id"), iv, 0.01, "id")
    return out.select("id", "trial_idx", "interval_id", F.round("gps_time", 4).alias("gps_time"))


@query("SELECT job_id, livetime FROM (SELECT job_id, livetime, sum(livetime) OVER (ORDER BY h, job_id ROWS UNBOUNDED PRECEDING) - livetime AS before FROM (SELECT job_id, sum(livetime) AS livetime, md5('7_' || job_id) AS h FROM p GROUP BY 1)) WHERE before < 100000", _P)
def livetime_running_select(spark, d):
    per = catalog.live_time(progress(spark, d), by=["job_id"]).select("job_id", "livetime")
    return selection.select_by_livetime(per, F.lit(100000.0), seed=7)


@query("SELECT id, rho FROM t ORDER BY md5('3_' || id), id LIMIT 500", _T)
def random_sample(spark, d):
    return selection.sample_rows(triggers(spark, d).select("id", "rho"), "id", 500, seed=3)


@query("SELECT id, event_type, CAST('0x' || substr(md5('5_' || event_type || '_' || id), 1, 8) AS BIGINT) % 10000 < 1000 AS is_test FROM t", _T)
def train_test_split(spark, d):
    return selection.train_test(triggers(spark, d).select("id", "event_type"), "id", "event_type", 0.1, seed=5)


_PART = "w AS (SELECT p_brand AS name, p_size AS hrss, p_partkey, p_retailprice >= 901 + (p_size * 10) AS detected FROM part)"


def _parts(spark, d):
    return read(spark, d, "part").select(F.col("p_brand").alias("name"), F.col("p_size").alias("hrss"), "p_partkey", (F.col("p_retailprice") >= 901 + F.col("p_size") * 10).alias("detected"))


def _eff(keys):
    return f"SELECT {keys}, count(*) AS n_sims, CAST(sum(CAST(detected AS INT)) AS BIGINT) AS n_detected, round(avg(CAST(detected AS INT)), 6) AS efficiency FROM w GROUP BY {keys}"


@query(_eff("hrss"), _PART)
def efficiency_by_hrss(spark, d):
    return rounded(efficiency.by_group(_parts(spark, d), ["hrss"], F.col("detected")), "efficiency")


@query(_eff("name"), _PART)
def efficiency_by_waveform(spark, d):
    return rounded(efficiency.by_group(_parts(spark, d), ["name"], F.col("detected")), "efficiency")


@query(_eff("name, hrss"), _PART)
def efficiency_by_waveform_hrss(spark, d):
    return rounded(efficiency.by_group(_parts(spark, d), ["name", "hrss"], F.col("detected")), "efficiency")


@query("SELECT hrss, n_detected, n_sims, round(n_detected / n_sims, 6) AS efficiency FROM (SELECT hrss, CAST(sum(CAST(detected AS INT)) AS BIGINT) AS n_detected, count(*) AS n_sims, count(DISTINCT p_partkey % 3) AS c FROM w GROUP BY 1) WHERE c = 3", _PART)
def chunk_efficiency_merge(spark, d):
    w = _parts(spark, d)
    chunks = [efficiency.by_group(w.where(F.col("p_partkey") % 3 == i), ["hrss"], F.col("detected")).drop("efficiency") for i in range(3)]
    return rounded(efficiency.merge_chunks(chunks, ["hrss"]), "efficiency")


@query("SELECT name, round(CASE WHEN lo > 0.5 THEN first WHEN hi < 0.5 THEN last ELSE mid END, 5) AS crossing FROM (SELECT name, min(e) AS lo, max(e) AS hi, CAST(min(hrss) AS DOUBLE) AS first, CAST(max(hrss) AS DOUBLE) AS last, min_by(CASE WHEN abs(e2 - e) < 1e-12 THEN hrss ELSE pow(10, log10(hrss) + (0.5 - e) / (e2 - e) * (log10(h2) - log10(hrss))) END, hrss) FILTER (WHERE e <= 0.5 AND e2 >= 0.5 OR e >= 0.5 AND e2 <= 0.5) AS mid FROM (SELECT name, hrss, e, lead(e) OVER (PARTITION BY name ORDER BY hrss) AS e2, lead(hrss) OVER (PARTITION BY name ORDER BY hrss) AS h2 FROM (SELECT name, hrss, avg(CAST(detected AS INT)) AS e FROM w GROUP BY 1, 2)) GROUP BY 1)", _PART)
def hrss50_crossing(spark, d):
    curve = efficiency.by_group(_parts(spark, d), ["name", "hrss"], F.col("detected"))
    return rounded(efficiency.crossing(curve, ["name"]), "crossing", digits=5)


@query("SELECT id, sim_idx FROM (SELECT id, job_id AS sim_idx, CASE WHEN k % 5 = 0 THEN NULL ELSE k % 2 = 0 END AS cat0, rho > 90 AS across FROM t) WHERE sim_idx IS NOT NULL AND NOT coalesce(cat0, false) AND NOT across", _T)
def clean_simulations(spark, d):
    t = triggers(spark, d).select("id", F.col("job_id").alias("sim_idx"), F.when(F.col("k") % 5 == 0, F.lit(None)).otherwise(F.col("k") % 2 == 0).alias("cat0"), (F.col("rho") > 90).alias("across"))
    return efficiency.clean(t, ["cat0", "across"]).select("id", "sim_idx")


@query("SELECT id, rho FROM t WHERE rho > 90 AND k < 50", _T)
def struct_filter(spark, d):
    t = triggers(spark, d).withColumn("injection", F.struct("k", "rho"))
    return t.where("injection.rho > 90 AND injection.k < 50").select("id", "rho")


@query("SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) >= 80")
def json_extract_filter(spark, d):
    k = F.get_json_object("props", "$.k").cast("double")
    return read(spark, d, "events").where(k >= 80).select(F.col("event_id").alias("id"), k.alias("k"))


@query("SELECT k, round(avg(rho), 6) AS mean_rho, count(*) AS n FROM t GROUP BY 1", _T)
def mean_by_struct_key(spark, d):
    t = triggers(spark, d).withColumn("injection", F.struct("k"))
    return t.groupBy(F.col("injection.k").alias("k")).agg(F.round(F.avg("rho"), 6).alias("mean_rho"), F.count("*").alias("n"))


@query("SELECT unnest(json_keys(props)) AS name, count(*) AS n FROM events GROUP BY 1")
def json_key_discovery(spark, d):
    return read(spark, d, "events").select(F.explode(F.json_object_keys("props")).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


@query("SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x0, CAST(embedding[2] AS DOUBLE) AS x1, CAST(embedding[500] AS DOUBLE) AS x499 FROM embeddings")
def list_element_columns(spark, d):
    return read(spark, d, "embeddings").select("vec_id", *[arrays.element(F.col("embedding"), i).cast("double").alias(f"x{i}") for i in (0, 1, 499)])


_FEATURES = "l AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS ecor, l_extendedprice + l_quantity AS likelihood, l_quantity AS duration, l_tax + 0.5 AS bandwidth, l_quantity AS s_snr_0, l_discount * 400 AS s_snr_1, l_tax + 1 AS noise_0, l_discount + 1 AS noise_1, l_discount - 0.05 AS qveto, l_tax AS qfactor, 1 + l_discount AS penalty FROM lineitem)"


def _lines(spark, d):
    c = F.col
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", c("l_extendedprice").alias("ecor"), (c("l_extendedprice") + c("l_quantity")).alias("likelihood"), c("l_quantity").alias("duration"), (c("l_tax") + 0.5).alias("bandwidth"), c("l_quantity").alias("s_snr_0"), (c("l_discount") * 400).alias("s_snr_1"), (c("l_tax") + 1).alias("noise_0"), (c("l_discount") + 1).alias("noise_1"), (c("l_discount") - 0.05).alias("qveto"), c("l_tax").alias("qfactor"), (1 + c("l_discount")).alias("penalty"))


@query("SELECT l_orderkey, l_linenumber, round(ecor / likelihood, 6) AS ecor_ratio, round(duration * bandwidth, 6) AS area, round(bandwidth / duration, 6) AS shape, round(least(s_snr_0, s_snr_1), 6) AS m_snr, round(sqrt(1 / (1 / (noise_0 * noise_0) + 1 / (noise_1 * noise_1))), 6) AS noise, round(sqrt(greatest(qveto, 0)), 6) AS q_a, round(qfactor / (2 * sqrt(log10(least(200.0, ecor)))), 6) AS q_p, round(sqrt(ecor / (1 + penalty * (greatest(1.0, penalty) - 1))), 6) AS rho0, round(least(s_snr_0, s_snr_1) / likelihood, 6) AS m_snr_ratio FROM l", _FEATURES)
def features_derived(spark, d):
    names = ["ecor_ratio", "area", "shape", "m_snr", "noise", "q_a", "q_p", "rho0", "m_snr_ratio"]
    return rounded(features.derived(_lines(spark, d), 2).select("l_orderkey", "l_linenumber", *names), *names)


@query("SELECT id, CASE WHEN rho > 60 THEN 60.0 ELSE rho END AS rho, CASE WHEN k % 7 = 0 THEN NULL WHEN k > 50 THEN 50.0 ELSE CAST(k AS DOUBLE) END AS k FROM t", _T)
def feature_caps(spark, d):
    t = triggers(spark, d)
    k = F.when(F.col("k") % 7 != 0, F.col("k").cast("double"))
    return t.select("id", features.cap(F.col("rho"), 60.0).alias("rho"), features.cap(k, 50.0).alias("k"))


@query("SELECT id, cls FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY md5('11_' || id), id) AS r FROM (SELECT id, k % 3 = 0 AS cls FROM t WHERE rho >= 60)) WHERE r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM t WHERE rho >= 60 GROUP BY k % 3 = 0))", _T)
def tail_balance(spark, d):
    t = triggers(spark, d).select("id", "rho", (F.col("k") % 3 == 0).alias("cls"))
    return features.balanced_tail(t, "rho", "cls", 60.0, "id", seed=11).select("id", "cls")


@query("SELECT id, bin, round(CASE WHEN cls = 1 THEN 1.0 ELSE coalesce(weight, 1.0) END, 6) AS weight FROM (SELECT id, cls, CASE WHEN rho BETWEEN 60 AND 100 THEN 3 WHEN rho BETWEEN 30 AND 60 THEN 2 WHEN rho BETWEEN 10 AND 30 THEN 1 WHEN rho BETWEEN 0 AND 10 THEN 0 END AS bin FROM y) LEFT JOIN (SELECT bin, CASE WHEN s > 0 AND b > 0 THEN s / b ELSE 1.0 END * exp(ln(10.0) * pow(1 - bin / 3.0, 2)) AS weight FROM (SELECT bin, sum(cls) AS s, sum(1 - cls) AS b FROM (SELECT cls, CASE WHEN rho BETWEEN 60 AND 100 THEN 3 WHEN rho BETWEEN 30 AND 60 THEN 2 WHEN rho BETWEEN 10 AND 30 THEN 1 WHEN rho BETWEEN 0 AND 10 THEN 0 END AS bin FROM y) WHERE bin IS NOT NULL GROUP BY 1)) USING (bin)", _T, "y AS (SELECT id, rho, CAST(k % 4 = 0 AS INT) AS cls FROM t)")
def bulk_weights(spark, d):
    t = triggers(spark, d).select("id", "rho", (F.col("k") % 4 == 0).cast("int").alias("cls"))
    return rounded(features.bulk_weights(t, "rho", "cls", [0.0, 10.0, 30.0, 60.0, 100.0], 10.0, 2.0).select("id", "bin", "weight"), "weight")


@query("SELECT 'rho' AS name, count(rho) AS n, min(rho) AS lo, round(quantile_cont(rho, 0.5), 6) AS median, max(rho) AS hi FROM t UNION ALL SELECT 'k', count(k), CAST(min(k) AS DOUBLE), round(quantile_cont(k, 0.5), 6), CAST(max(k) AS DOUBLE) FROM t", _T)
def numeric_profile(spark, d):
    return rounded(catalog.numeric_profile(triggers(spark, d), ["rho", "k"]), "median")


@query("SELECT CAST(greatest(ceil(rho / 25.0) - 1, 0) AS BIGINT) AS bin, max(k) AS y_max, count(*) AS n FROM t GROUP BY 1", _T)
def binned_max(spark, d):
    return catalog.binned_max(triggers(spark, d), "rho", "k", 0.0, 25.0)


@query("SELECT CASE WHEN rho = 400 THEN 39 ELSE CAST(floor(rho / 10.0) AS BIGINT) END AS bin, count(*) AS n FROM t WHERE rho BETWEEN 0 AND 400 GROUP BY 1", _T)
def hist_1d(spark, d):
    return catalog.histogram(triggers(spark, d), "rho", 0.0, 10.0, 40)


@query("SELECT CAST(floor(rho / 25.0) AS BIGINT) AS bx, CAST(floor(k / 10.0) AS BIGINT) AS bk, count(*) AS n FROM t GROUP BY 1, 2", _T)
def hist_2d(spark, d):
    return triggers(spark, d).groupBy(F.floor(F.col("rho") / 25.0).alias("bx"), F.floor(F.col("k") / 10.0).alias("bk")).agg(F.count("*").alias("n"))


_ANGLE = "degrees(acos(least(1.0, greatest(-1.0, sin(radians(d1)) * sin(radians(d2)) + cos(radians(d1)) * cos(radians(d2)) * cos(radians(r1 - r2))))))"
_ANG = f"ang AS (SELECT id, job_id, rho, {_ANGLE} AS err FROM (SELECT id, job_id, rho, (id * 13) % 360 AS r1, (id * 7) % 180 - 90 AS d1, (id * 13 + k) % 360 AS r2, (id * 7 + k // 3) % 180 - 90 AS d2 FROM t))"


def _angles(spark, d):
    i, k = F.col("id"), F.col("k")
    err = geo.separation_dec((i * 13) % 360, (i * 7) % 180 - 90, (i * 13 + k) % 360, (i * 7 + F.floor(k / 3)) % 180 - 90)
    return triggers(spark, d).select("id", "job_id", "rho", err.alias("err"))


@query("SELECT id, round(err, 5) AS err FROM ang", _T, _ANG)
def angular_error(spark, d):
    return _angles(spark, d).select("id", F.round("err", 5).alias("err"))


@query("SELECT job_id, count(*) AS n, round(avg(err), 4) AS mean, round(quantile_cont(err, 0.5), 4) AS median, round(quantile_cont(err, 0.9), 4) AS p90, round(max(err), 4) AS worst, count(*) FILTER (WHERE err <= 30.0000001) AS within FROM ang GROUP BY 1", _T, _ANG)
def run_angle_summary(spark, d):
    return _angles(spark, d).groupBy("job_id").agg(F.count("*").alias("n"), F.round(F.avg("err"), 4).alias("mean"), F.round(F.percentile("err", 0.5), 4).alias("median"), F.round(F.percentile("err", 0.9), 4).alias("p90"), F.round(F.max("err"), 4).alias("worst"), F.count_if(F.col("err") <= 30.0000001).alias("within"))


@query("SELECT job_id, event_type, max_by(id, struct_pack(r := rho, i := -id)) AS id, max(rho) AS rho FROM t GROUP BY 1, 2", _T)
def best_per_event(spark, d):
    return triggers(spark, d).groupBy("job_id", "event_type").agg(F.max_by("id", F.struct("rho", -F.col("id"))).alias("id"), F.max("rho").alias("rho"))


_JD = f"((gps_time - {geo.GPS_J2000}) / {86400.0 * 36525.0})"
_GMST = f"((({geo.SIDEREAL[0] + 43200.0} + {geo.SIDEREAL[1]} * {_JD} + {geo.SIDEREAL[2]} * {_JD} * {_JD} + {geo.SIDEREAL[3]} * {_JD} * {_JD} * {_JD} + (gps_time - {geo.GPS_J2000})) % 86400.0 + 86400.0) % 86400.0) * {geo.TWO_PI / 86400.0}"


@query(f"SELECT id, round((k * 0.05 + {_GMST}) % {geo.TWO_PI}, 5) AS ra FROM t", _T)
def sidereal_ra(spark, d):
    return triggers(spark, d).select("id", F.round(geo.longitude_to_ra(F.col("k") * 0.05, F.col("gps_time")), 5).alias("ra"))


@query("SELECT p_partkey, TRY_CAST(regexp_extract('SG_Q' || p_size || '_' || (p_partkey % 2000) || 'Hz', '_Q(\\d+)_', 1) AS INTEGER) AS q, TRY_CAST(regexp_extract('SG_Q' || p_size || '_' || (p_partkey % 2000) || 'Hz', '_(\\d+)Hz', 1) AS INTEGER) AS hz FROM part")
def waveform_q_freq(spark, d):
    name = F.concat(F.lit("SG_Q"), F.col("p_size").cast("string"), F.lit("_"), (F.col("p_partkey") % 2000).cast("string"), F.lit("Hz"))
    q, hz = arrays.quality_and_frequency(name)
    return read(spark, d, "part").select("p_partkey", q.alias("q"), hz.alias("hz"))


@query("SELECT id, substr(md5(job_id || '_' || k || '_' || id), 1, 16) AS row_id FROM t", _T)
def hash_id(spark, d):
    return triggers(spark, d).select("id", arrays.row_id(F.col("job_id"), F.col("k"), F.col("id")).alias("row_id"))


_E = "e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings)"


@query("SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.x, b.x), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform(a.x, lambda z: z * z))) * sqrt(list_sum(list_transform(b.x, lambda z: z * z)))), 6) AS overlap FROM e a JOIN e b ON b.vec_id = a.vec_id + 1", _E)
def waveform_overlap(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", "embedding")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select("vec_id", F.round(arrays.overlap(F.col("embedding"), F.col("other")), 6).alias("overlap"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(x, lambda z: z * z)) * 0.0009765625), 6) AS hrss FROM e", _E)
def waveform_hrss(spark, d):
    return read(spark, d, "embeddings").select("vec_id", F.round(arrays.hrss(F.col("embedding"), 1 / 1024), 6).alias("hrss"))


@query("SELECT vec_id, i AS sample, round(sqrt(list_sum(list_transform(x[1:i + 1], lambda z: z * z)) * 0.0009765625), 5) AS value FROM e, (SELECT CAST(unnest(range(64)) AS INTEGER) AS i) WHERE i < len(x)", _E)
def cumulative_hrss(spark, d):
    return read(spark, d, "embeddings").select("vec_id", F.posexplode(arrays.cumulative_hrss(F.col("embedding"), 1 / 1024)).alias("sample", "value")).withColumn("value", F.round("value", 5))


@query("SELECT id, job_id, 'a' AS run, rho, NULL AS extra FROM t WHERE event_type = 'view' UNION ALL SELECT id, job_id, 'b', rho, k FROM t WHERE event_type = 'click'", _T)
def multi_run_union(spark, d):
    t = triggers(spark, d)
    return catalog.union_runs({"a": t.where("event_type = 'view'").select("id", "job_id", "rho"), "b": t.where("event_type = 'click'").select("id", "job_id", "rho", F.col("k").alias("extra"))})


@query("SELECT count(*) AS n_rows, round(sum(livetime), 4) AS livetime, round(min(livetime), 4) AS least, round(max(livetime), 4) AS most, count(*) FILTER (WHERE livetime = 50) AS n_equal, count(*) FILTER (WHERE livetime < 50 - 1e-9) AS n_less, count(DISTINCT job_id) AS n_jobs FROM p", _P)
def live_summary(spark, d):
    out = reports.live_summary(progress(spark, d), 50.0)
    return rounded(out, "livetime", "least", "most", digits=4).select("n_rows", "livetime", "least", "most", "n_equal", "n_less", "n_jobs")


@query("SELECT CAST(round(job_id / 100.0) AS BIGINT) AS slag, lag_idx, count(*) AS n_rows, round(sum(livetime), 4) AS livetime FROM p GROUP BY 1, 2", _P)
def slag_summary(spark, d):
    return rounded(reports.slag_summary(progress(spark, d), F.round(F.col("job_id") / 100.0).cast("long")), "livetime", digits=4)


@query("SELECT epoch(s) AS start, count(*) AS n, max(value) AS loudest FROM (SELECT value, unnest([time_bucket(INTERVAL 20 seconds, ts), time_bucket(INTERVAL 20 seconds, ts) - INTERVAL 20 seconds, time_bucket(INTERVAL 20 seconds, ts) - INTERVAL 40 seconds]) AS s FROM events) GROUP BY 1")
def online_windows(spark, d):
    e = read(spark, d, "events")
    return online.sliding(e, "ts").select(F.expr(SECONDS.format("start")).alias("start"), "n", "loudest")


@query("SELECT user_id, count(*) AS n, min(event_id) AS first_id FROM (SELECT *, sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 3600 seconds THEN 1 ELSE 0 END AS g FROM events)) GROUP BY user_id, s")
def gap_sessions(spark, d):
    e = read(spark, d, "events")
    return online.sessions(e, "ts", 3600, ["user_id"], first_id=F.min("event_id")).select("user_id", "n", "first_id")


@query()
def q_veto(spark, d):
    return read(spark, d, "embeddings").select("vec_id", kernels.q_veto_udf("embedding").alias("q")).select("vec_id", "q.qveto", "q.qfactor")


@query()
def sigmoid_fit(spark, d):
    curve = efficiency.by_group(_parts(spark, d), ["name", "hrss"], F.col("detected"))
    return efficiency.sigmoid(curve, "name")


@query()
def pixel_clusters(spark, d):
    t = triggers(spark, d).select("job_id", "id", F.floor("rho").cast("int").alias("freq"), F.floor(F.col("gps_time") / 3600).cast("int").alias("time"), F.col("rho").alias("likelihood"))
    return kernels.cluster_statistics(kernels.cluster_pixels(t, ["job_id"]), ["job_id"])


@query()
def sky_scan(spark, d):
    return kernels.scan_events(read(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 3).alias("x")), "x").drop("x")


@query()
def whitened(spark, d):
    return kernels.map_waves(read(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", kernels.whiten, "white").select("vec_id", F.size("white").alias("n"), F.round(F.array_max("white"), 6).alias("peak"))


@query()
def gbt_score(spark, d):
    t = triggers(spark, d).select("id", "rho", F.col("k").cast("double"), (F.col("rho") + F.col("k") > 120).cast("double").alias("label"))
    return features.score_trees(features.train_trees(t, ["rho", "k"], "label", maxIter=3, maxDepth=3), t).select("id", F.round("score", 6).alias("score"))


@query(SQL["online_windows"])
def online_stream(spark, d):
    """The sliding windows as a stream over the events' file, run to its end; the last windows too, which no watermark closes."""
    import uuid

    schema = read(spark, d, "events").schema
    stream = online.event_time(spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parq*"), "ts")
    out = f"{scratch_dir(spark)}/online-{uuid.uuid4().hex}"
    online.write_updates(online.sliding(stream, "ts"), f"{out}/rows", f"{out}/state").awaitTermination()
    rows = online.latest(spark.read.parquet(f"{out}/rows"), ["start", "end"])
    return rows.select((F.unix_micros("start") / 1_000_000).alias("start"), "n", "loudest")


@query("SELECT id, rho FROM t WHERE sqrt(rho) > 7 AND greatest(rho, k) > 60 AND NOT k = 3", _T)
def cut_strings(spark, d):
    return cuts.all_cuts(triggers(spark, d), ["sqrt(rho) > 7", "max(rho, k) > 60 & not k == 3"]).select("id", "rho")


@query("SELECT id, concat_ws(';', CASE WHEN rho < 20 THEN 'quiet' END, CASE WHEN k > 80 THEN 'late' END, CASE WHEN event_type = 'error' THEN 'error' END) AS reason, CASE WHEN rho < 20 THEN 1 ELSE 0 END AS status FROM t", _T)
def rejection_reasons(spark, d):
    c = F.col
    return triggers(spark, d).select("id", cuts.rejection({"quiet": c("rho") < 20, "late": c("k") > 80, "error": c("event_type") == "error"}).alias("reason"), cuts.status(c("rho"), 20.0).alias("status"))


@query("SELECT id FROM t WHERE least(rho, rho + k) > 30 AND rho > 40 AND rho > 0.5 * k", _T)
def sub_network_cut(spark, d):
    c = F.col
    return triggers(spark, d).where(cuts.sub_network(c("rho"), c("rho") + c("k"), c("rho"), c("rho"), c("k"), 30.0, 40.0, 0.5)).select("id")


@query("SELECT id FROM sky WHERE degrees(acos(least(1.0, greatest(-1.0, cos(radians(theta)) * cos(radians(60.0)) + sin(radians(theta)) * sin(radians(60.0)) * cos(radians(phi - 120.0)))))) <= 25.0000001", _T, _SKY)
def sky_mask(spark, d):
    t = triggers(spark, d)
    return t.where(cuts.sky_patch((F.col("id") % 180).cast("double"), ((F.col("id") * 7) % 360).cast("double"), 60.0, 120.0, 25.0000001)).select("id")


@query("SELECT job_id, id, round(quantile_cont(rho, 0.5) OVER (PARTITION BY job_id ORDER BY id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS median FROM t", _T)
def rolling_median(spark, d):
    return rounded(cuts.rolling_median(triggers(spark, d).select("job_id", "id", "rho"), ["job_id"], "id", "rho", 3).drop("rho"), "median")


@query("SELECT sample, round(quantile_cont(x, 0.05), 5) AS lower, round(quantile_cont(x, 0.5), 5) AS median, round(quantile_cont(x, 0.95), 5) AS upper FROM (SELECT i AS sample, x[i + 1] AS x FROM e, (SELECT CAST(unnest(range(64)) AS INTEGER) AS i)) GROUP BY 1", _E)
def waveform_bands(spark, d):
    return rounded(cuts.bands(read(spark, d, "embeddings"), "embedding"), "lower", "median", "upper", digits=5)


@query("SELECT vec_id, CAST(len(list_filter(x, lambda z: z > 0.1)) AS INTEGER) AS n_above, round(list_sort(x[11:30])[6], 6) AS fifth, round(x[17], 6) AS slid, round(x[4] + x[1], 6) AS added, round(sqrt(list_sum(list_transform(x, lambda z: abs(z)))), 5) AS snr FROM e", _E)
def array_functions(spark, d):
    x = F.transform("embedding", lambda z: z.cast("double"))
    e = read(spark, d, "embeddings").select("vec_id", x.alias("x"))
    c = F.col("x")
    return e.select("vec_id", arrays.count_above(c, 0.1).alias("n_above"), F.round(arrays.order_statistic(c, 10, 30, 5), 6).alias("fifth"), F.round(F.get(arrays.slide(c, 4), F.lit(20)), 6).alias("slid"), F.round(F.get(arrays.add_at(c, c, 3), F.lit(3)), 6).alias("added"), F.round(arrays.network_snr(F.transform(c, lambda z: F.abs(z))), 5).alias("snr"))


@query("SELECT id, round(pi() / 2 - k * 0.01, 6) AS dec, round(((k * 0.07 + pi()) % (2 * pi())) - pi(), 6) AS lon, round(cos(0.01 * k) * cos(0.05 * k), 6) AS x, format('{:.4f}_{}', rho, id) AS name FROM t", _T)
def coordinate_functions(spark, d):
    k = F.col("k")
    return triggers(spark, d).select("id", F.round(geo.colatitude_to_dec(k * 0.01), 6).alias("dec"), F.round(geo.to_geographic(k * 0.07), 6).alias("lon"), F.round(geo.cartesian(k * 0.05, k * 0.01)["x"], 6).alias("x"), arrays.long_id(F.col("rho"), F.col("id")).alias("name"))


@query("SELECT id, unnest(list_concat(range(k, k + 3), [CAST(500 AS BIGINT)])) AS number FROM t WHERE event_type = 'signup'", _T)
def id_ranges(spark, d):
    text = F.concat(F.col("k").cast("string"), F.lit("-"), (F.col("k") + 2).cast("string"), F.lit(", 500"))
    return triggers(spark, d).where("event_type = 'signup'").select("id", F.explode(arrays.id_ranges(text).cast("array<bigint>")).alias("number"))


@query("SELECT id, round(CAST(CAST('0x' || substr(md5('1_' || id), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 * 2 * pi(), 5) AS ra, round(asin(2 * (CAST(CAST('0x' || substr(md5('2_' || id), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0) - 1), 5) AS dec FROM t", _T)
def sky_draw(spark, d):
    return rounded(sky.all_sky(triggers(spark, d).select("id"), "id", 1), "ra", "dec", digits=5)


@query("SELECT job_id, trial_idx, CAST(row_number() OVER (ORDER BY job_id, trial_idx) AS INTEGER) AS index FROM (SELECT DISTINCT c_custkey AS job_id, unnest([0, c_custkey % 3]) AS trial_idx FROM customer)")
def trials_flattened(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("job_id"), F.array(F.lit(0).cast("long"), F.col("c_custkey") % 3).alias("trials"))
    return jobs.by_trial(c)


@query("SELECT id, job_id, CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS classifier FROM t", _T)
def labelled_union(spark, d):
    t = triggers(spark, d)
    return store.labelled(t.where("event_type = 'view'"), t.where("event_type <> 'view'")).select("id", "job_id", "classifier")


@query("SELECT job_id, round(min(rho), 6) AS lo, round(max(rho) - min(rho), 6) AS spread, count(DISTINCT event_type) AS kinds FROM t GROUP BY 1", _T)
def consistency_across_runs(spark, d):
    return triggers(spark, d).groupBy("job_id").agg(F.round(F.min("rho"), 6).alias("lo"), F.round(F.max("rho") - F.min("rho"), 6).alias("spread"), F.count_distinct("event_type").alias("kinds"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
