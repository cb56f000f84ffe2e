"""More operators on the provided tables: the catalogue door, data quality, scheduling, clusters, reports, the sky, the online side.

The stand-ins are those of ``queries``.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import arrays, geo
from ..operators import clusters, dq, efficiency, graph, injections, intervals, jobs, network, reports, selection, sky
from ..sources import params, store
from ..streaming import online
from .queries import _GMST, _IV, _SKY, _T, LIVETIME, SECONDS, Query, _iv, progress, read, rounded, triggers
from .queries import _P as _PROGRESS

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *ctes: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = ("WITH " + ", ".join(ctes) + " " if ctes else "") + sql
        return f

    return add


# --- the catalogue door

_ASKED = "SELECT job_id, id, rho FROM triggers QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY rho DESC, id) = 1"


@query(_ASKED, _T, "triggers AS (SELECT * FROM t)")
def catalog_sql(spark, d):
    return store.query(spark, _ASKED, triggers=triggers(spark, d).select("job_id", "id", "rho"))


_JSON = "SELECT event_type, count(*) AS n, max(json_extract_string(props, '$.k')::INT) AS most FROM triggers WHERE json_extract_string(props, '$.k')::INT > 10 GROUP BY event_type ORDER BY n"


@query(_JSON, "triggers AS (SELECT * FROM events)")
def catalog_sql_json(spark, d):
    return store.query(spark, _JSON, triggers=read(spark, d, "events"))


_JOINED = "SELECT t.id, j.c_name FROM triggers t JOIN jobs j ON t.job_id = j.c_custkey WHERE t.rho > 100 AND j.c_mktsegment = 'BUILDING'"


@query(_JOINED, _T, "triggers AS (SELECT * FROM t)", "jobs AS (SELECT * FROM customer)")
def catalog_sql_join(spark, d):
    return store.query(spark, _JOINED, triggers=triggers(spark, d), jobs=read(spark, d, "customer"))


@query("SELECT x AS lag_idx, round(sum(c_acctbal + 2000), 3) AS livetime, count(*) AS n_rows FROM (SELECT *, unnest(range(c_custkey % 4 + 1)) AS x FROM customer) GROUP BY 1")
def meta_jobs(spark, d):
    j = read(spark, d, "customer").select(F.col("c_custkey").alias("job_id"), (F.col("c_custkey") % 4 + 1).cast("int").alias("n_lags"), F.lit(0.0).alias("analyze_start"), (F.col("c_acctbal") + 2000).alias("analyze_end"))
    rows = store.live_time_rows(j).groupBy("lag_idx").agg(F.round(F.sum("livetime"), 3).alias("livetime"), F.count("*").alias("n_rows"))
    return rows.withColumn("lag_idx", F.col("lag_idx").cast("long"))


@query("SELECT id, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS classifier FROM t", _T)
def labelled_by_injection(spark, d):
    t = triggers(spark, d).withColumn("injection", F.when(F.col("event_type") == "view", F.struct(F.col("k"))))
    return store.labelled_by_injection(t).select("id", "classifier")


@query("SELECT id, k * 1.0 AS time_0, k * 2.0 AS time_1, rho FROM t", _T)
def detector_columns(spark, d):
    t = triggers(spark, d).select("id", (F.col("k") * 1.0).alias("time_H1"), (F.col("k") * 2.0).alias("time_L1"), "rho")
    return store.flat_detectors(t, ["H1", "L1"])


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def parameters_flat(spark, d):
    e = read(spark, d, "events").select("event_id", "props")
    return params.flat(e, "props", params.inferred(e, "props")).select("event_id", "k")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, json_extract_string(props, '$.none') AS absent FROM events WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) >= 50")
def parameter_values(spark, d):
    return read(spark, d, "events").select("event_id", params.value("props", "k", "double").alias("k"), params.value("props", "none").alias("absent")).where("k >= 50")


# --- data quality and jobs

_MERGED = "u AS (SELECT job_id, event_type, min(s) AS s, max(e) AS e FROM (SELECT *, sum(CASE WHEN b IS NULL OR s > b THEN 1 ELSE 0 END) OVER (PARTITION BY job_id, event_type ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM (SELECT *, max(e) OVER (PARTITION BY job_id, event_type ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM iv)) GROUP BY job_id, event_type, i)"


@query("SELECT a.job_id, round(greatest(a.s, b.s), 3) AS start, round(least(a.e, b.e), 3) AS \"end\" FROM u a JOIN u b ON a.job_id = b.job_id AND a.event_type = 'view' AND b.event_type = 'click' AND a.s < b.e AND b.s < a.e", _T, _IV, _MERGED)
def dq_common(spark, d):
    rows = _iv(spark, d).where("event_type in ('view', 'click')")
    return rounded(dq.common(rows, ["job_id"], ["event_type"], F.lit(2)), "start", "end", digits=3)


@query("SELECT v.job_id, round(v.l, 3) AS livetime, round(v.l - coalesce(g.l, 0), 3) AS livetime_left FROM (SELECT job_id, sum(e - s) AS l FROM u WHERE event_type = 'view' GROUP BY 1) v LEFT JOIN (SELECT a.job_id, sum(least(a.e, b.e) - greatest(a.s, b.s)) AS l FROM u a JOIN u b ON a.job_id = b.job_id AND a.event_type = 'view' AND b.event_type = 'click' AND a.s < b.e AND b.s < a.e GROUP BY 1) g USING (job_id)", _T, _IV, _MERGED)
def veto_live(spark, d):
    v = _iv(spark, d)
    merged = intervals.union(v.where("event_type = 'view'"), ["job_id"])
    return rounded(intervals.live_outside(merged, v.where("event_type = 'click'"), ["job_id"], 4000.0), "livetime", "livetime_left", digits=3)


@query("SELECT job_id, round(min(s), 3) AS start, round(max(e), 3) AS \"end\" FROM (SELECT *, sum(CASE WHEN b IS NULL OR s > b THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM (SELECT *, max(e) OVER (PARTITION BY job_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM (SELECT job_id, gps_time - 1800 AS s, gps_time + 1800 AS e FROM t WHERE event_type = 'view'))) GROUP BY job_id, i", _T)
def padded_windows(spark, d):
    t = triggers(spark, d).where("event_type = 'view'").select("job_id", F.col("gps_time").alias("at"))
    return rounded(intervals.padded_union(t, ["job_id"], 1800.0), "start", "end", digits=3)


@query("SELECT id, start, CASE WHEN CAST(floor((e - start) * 4 + 0.001) AS BIGINT) % 2 = 1 THEN e - 1 ELSE e END AS \"end\" FROM (SELECT id, CAST(k AS DOUBLE) AS start, k + 600 + (id % 7) * 0.25 AS e FROM t)", _T)
def even_jobs(spark, d):
    t = triggers(spark, d).select("id", F.col("k").cast("double").alias("start"), (F.col("k") + 600 + (F.col("id") % 7) * 0.25).alias("end"))
    return dq.even_length(t, 4.0)


# --- selections and schedules


@query("SELECT job_id, round(livetime, 4) AS livetime, CASE WHEN b < t0 THEN 'train' ELSE 'test' END AS split FROM (SELECT *, (SELECT min(a) FROM r WHERE a >= 0.6 * tot - 1e-9) AS t0 FROM r)", _PROGRESS, "j AS (SELECT job_id, CAST(CAST(round(sum(livetime)) AS BIGINT) AS DOUBLE) AS livetime FROM p GROUP BY 1)", "o AS (SELECT *, md5('3_' || job_id) AS h FROM j)", "r AS (SELECT *, sum(livetime) OVER (ORDER BY h, job_id ROWS UNBOUNDED PRECEDING) AS a, sum(livetime) OVER (ORDER BY h, job_id ROWS UNBOUNDED PRECEDING) - livetime AS b, sum(livetime) OVER () AS tot FROM o)")
def split_by_fraction(spark, d):
    rows = progress(spark, d).groupBy("job_id").agg(F.round(F.sum("livetime")).cast("long").cast("double").alias("livetime"))
    return rounded(selection.split_table(rows, {"train": 0.6, "test": 0.4}, ["job_id"], seed=3).select("job_id", "livetime", "split"), "livetime", digits=4)


_ROOM = "q AS (SELECT count(*) AS n FROM t), w AS (SELECT n, CASE WHEN n / 0.25 <= 900000.0 THEN n ELSE CAST(floor(900000.0 * 0.25) AS BIGINT) END AS each FROM q), z AS (SELECT each, CASE WHEN each > 1 THEN (1900000.0 - 2 - (1000000.0 + 2)) / (each - 1) ELSE 0 END AS step FROM w)"


@query("SELECT id, CAST(floor(id / each) AS BIGINT) AS trial_idx, round(1000002.0 + (id % each) * step, 3) AS gps_time FROM t, z", _T, _ROOM)
def range_rate(spark, d):
    t = triggers(spark, d).select("id")
    out = injections.in_range_at_rate(t, 0.25, 1000000.0, 1900000.0, "id", t.count())
    return rounded(out, "gps_time", digits=3)


@query("SELECT id, round(k + (CAST(CAST('0x' || substr(md5('5_' || id), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 * 2 - 1) * 3, 6) AS gps_time FROM t", _T)
def jitter(spark, d):
    return rounded(injections.jittered(triggers(spark, d).select("id", F.col("k").cast("double").alias("gps_time")), 3.0, 0.1, "id", seed=5), "gps_time")


@query()
def poisson_schedule(spark, d):
    c = read(spark, d, "customer")
    iv = c.select(F.col("c_custkey").alias("interval_id"), (F.col("c_custkey") * 1000.0).alias("start"), (F.col("c_custkey") * 1000.0 + 500).alias("end"))
    t = triggers(spark, d).select("id")
    numbered = graph.numbered(t, "id", ["id"], "i")  # ids may have gaps
    return rounded(injections.in_intervals_poisson(numbered, 0.01, iv, "i", t.count(), seed=1), "gps_time", digits=4)


@query("SELECT s.id, s.vetoed_cat1, s.across_segments, s.segment_idx FROM (SELECT a.id, (SELECT min(b.id) FROM g b WHERE b.s <= a.x AND a.x < b.e) AS segment_idx, (SELECT min(b.id) FROM g b WHERE b.s <= a.x AND a.x < b.e) IS NULL AS vetoed_cat1, (SELECT min(b.id) FROM g b WHERE b.s <= a.x - 100 AND a.x - 100 < b.e) IS DISTINCT FROM (SELECT min(b.id) FROM g b WHERE b.s <= a.x + 100 AND a.x + 100 < b.e) AS across_segments FROM (SELECT id, gps_time AS x FROM t WHERE event_type = 'click') a) s", _T, "g AS (SELECT id, gps_time AS s, gps_time + 900 AS e FROM t WHERE event_type = 'signup')")
def simulation_flags(spark, d):
    t = triggers(spark, d)
    seg = t.where("event_type = 'signup'").select(F.col("id").alias("segment_idx"), F.col("gps_time").alias("start"), (F.col("gps_time") + 900).alias("end"))
    points = t.where("event_type = 'click'").select("id", "gps_time", (F.col("gps_time") - 100).alias("real_start"), (F.col("gps_time") + 100).alias("real_end"))
    return injections.flags(points, seg, None, None, "gps_time", 900.0).select("id", "vetoed_cat1", "across_segments", "segment_idx")


# --- clusters

_PIX = "pix AS (SELECT id AS pixel, job_id, id % 400 AS cluster_id, gps_time / 4000.0 AS time, k * 1.0 AS freq, CAST(1 << (id % 4) AS DOUBLE) AS rate, rho AS likelihood FROM t)"


def _pixels(spark, d):
    t, i = triggers(spark, d), F.col("id")
    return t.select(i.alias("pixel"), "job_id", (i % 400).alias("cluster_id"), (F.col("gps_time") / 4000.0).alias("time"), (F.col("k") * 1.0).alias("freq"), F.pow(F.lit(2.0), i % 4).alias("rate"), F.col("rho").alias("likelihood"), F.array((F.col("gps_time") / 4000.0), (F.col("gps_time") / 4000.0) + F.col("k") * 0.001).alias("index"))


_NEAR = "near AS (SELECT *, greatest(abs(ta - tb), abs(ta + fa * 0.001 - (tb + fb * 0.001))) - (1 / p + 1 / q) / 2 AS dt, abs(fa - fb) - (p + q) / 2 AS df FROM (SELECT a.job_id, least(a.cluster_id, b.cluster_id) AS a, greatest(a.cluster_id, b.cluster_id) AS b, a.time AS ta, b.time AS tb, a.freq AS fa, b.freq AS fb, a.rate AS p, b.rate AS q FROM pix a JOIN pix b ON a.job_id = b.job_id AND a.cluster_id <> b.cluster_id AND a.pixel < b.pixel))"


@query("SELECT DISTINCT job_id, a, b FROM near WHERE abs(ta - tb) <= 1.0 * 6 AND greatest(p, q) <= 3 * least(p, q) AND greatest(dt, 0) * (p + q) + greatest(df, 0) * (1 / p + 1 / q) <= 5", _T, _PIX, _NEAR)
def cluster_links(spark, d):
    return clusters.close_links(_pixels(spark, d), ["job_id"], 5.0)


@query("SELECT DISTINCT job_id, a, b FROM near WHERE dt < 2.0 AND df < 8.0", _T, _PIX, _NEAR)
def fragment_links(spark, d):
    return clusters.fragment_links(_pixels(spark, d), ["job_id"], 2.0, 8.0)


_REACH = "l AS (SELECT DISTINCT job_id, a, b FROM near WHERE dt < 2.0 AND df < 8.0), e AS (SELECT job_id, a, b FROM l UNION SELECT job_id, b, a FROM l), reach AS (SELECT DISTINCT job_id, cluster_id AS a, cluster_id AS b FROM pix UNION SELECT reach.job_id, reach.a, e.b FROM reach JOIN e ON e.job_id = reach.job_id AND e.a = reach.b)"


@query("SELECT pix.pixel, pix.job_id, m.c AS cluster_id FROM pix JOIN (SELECT job_id, a, min(b) AS c FROM reach GROUP BY 1, 2) m ON m.job_id = pix.job_id AND m.a = pix.cluster_id", "RECURSIVE " + _T, _PIX, _NEAR, _REACH)
def defragmented(spark, d):
    return clusters.defragmented(_pixels(spark, d), ["job_id"], 2.0, 8.0).select("pixel", "job_id", "cluster_id")


@query("SELECT cluster_id, CAST(r - 1 AS INTEGER) AS place, pixel, round(likelihood, 6) AS likelihood FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY likelihood DESC, pixel) AS r FROM pix) WHERE r <= 3", _T, _PIX)
def loudest_pixels(spark, d):
    return rounded(clusters.loudest_pixels(_pixels(spark, d).drop("index"), [], 3).select("cluster_id", "place", "pixel", "likelihood"), "likelihood")


@query("SELECT a.cluster_id, a.pixel % 9 AS index_a, b.pixel % 9 AS index_b, round(sum(a.likelihood * b.likelihood * (0.1 * (a.pixel % 9) + 0.01 * (b.pixel % 9))), 2) AS talk FROM pix a JOIN pix b ON a.cluster_id = b.cluster_id AND a.pixel % 9 < 3 AND b.pixel % 9 >= 6 GROUP BY 1, 2, 3", _T, _PIX)
def cross_talk(spark, d):
    p = _pixels(spark, d).select("cluster_id", F.lit(0).alias("layer"), (F.col("pixel") % 9).alias("index"), F.col("likelihood").alias("amplitude"))
    pairs = spark.createDataFrame([(0, i, 0, j, 0.1 * i + 0.01 * j) for i in range(3) for j in range(6, 9)], "layer_a int, index_a long, layer_b int, index_b long, coefficient double")
    out = clusters.cross_talk(p, pairs)
    return out.groupBy("cluster_id", "index_a", "index_b").agg(F.round(F.sum(F.col("amplitude_a") * F.col("amplitude_b") * F.col("coefficient")), 2).alias("talk"))


# --- reports


@query("SELECT count(DISTINCT k) AS n_sims, count(*) AS n_recovered, count(DISTINCT event_type) AS n_waveforms, round(min(rho), 6) AS hrss_min, round(max(rho), 6) AS hrss_max FROM t", _T)
def matched_profile(spark, d):
    t = triggers(spark, d).select("id", F.col("k").alias("sim_sim_idx"), F.col("event_type").alias("sim_name"), F.col("rho").alias("sim_hrss"))
    return rounded(reports.matched_profile(t), "hrss_min", "hrss_max")


_ALLOWED = 5000.0


@query(f"SELECT min(rho) AS threshold FROM (SELECT rho FROM t ORDER BY rho DESC LIMIT {int(LIVETIME / _ALLOWED)})", _T)
def threshold_of_ifar(spark, d):
    return spark.createDataFrame([(reports.ifar_threshold(triggers(spark, d), "rho", LIVETIME, _ALLOWED),)], "threshold double")


@query("SELECT event_type AS name, ifar, hrss, count(*) AS n_sims, CAST(sum(CASE WHEN rho >= least THEN 1 ELSE 0 END) AS BIGINT) AS n_detected FROM (SELECT event_type, k // 20 AS hrss, rho FROM t), (VALUES ('1yr', 60.0), ('1mo', 30.0)) x(ifar, least) GROUP BY 1, 2, 3", _T)
def efficiency_by_ifar(spark, d):
    t = triggers(spark, d).select(F.col("event_type").alias("name"), F.floor(F.col("k") / 20).alias("hrss"), "rho")
    table = F.array(*[F.struct(F.lit(n).alias("ifar"), F.lit(x).alias("least")) for n, x in (("1yr", 60.0), ("1mo", 30.0))])
    each = t.withColumn("_t", F.explode(table)).select("*", "_t.ifar", "_t.least")
    return efficiency.by_group(each, ["name", "ifar", "hrss"], F.col("rho") >= F.col("least")).drop("efficiency")


_IFAR = "e AS (SELECT event_type AS name, ifar, 1.0 + k // 20 AS hrss, avg(CASE WHEN rho >= least THEN 1.0 ELSE 0.0 END) AS e FROM t, (VALUES ('1yr', 60.0), ('1mo', 30.0)) x(ifar, least) GROUP BY ALL), n AS (SELECT *, lead(e) OVER w AS e2, lead(hrss) OVER w AS h2 FROM e WINDOW w AS (PARTITION BY name, ifar ORDER BY hrss))"


@query("SELECT name, ifar, round(CASE WHEN min(e) > 0.5 THEN min(hrss) WHEN max(e) < 0.5 THEN max(hrss) ELSE min_by(CASE WHEN abs(e2 - e) < 1e-12 THEN hrss ELSE pow(10, log10(hrss) + (0.5 - e) / (e2 - e) * (log10(h2) - log10(hrss))) END, hrss) FILTER (WHERE e <= 0.5 AND e2 >= 0.5 OR e >= 0.5 AND e2 <= 0.5) END, 5) AS hrss50 FROM n GROUP BY 1, 2", _T, _IFAR)
def hrss50_by_ifar(spark, d):
    t = triggers(spark, d).select(F.col("event_type").alias("name"), (F.floor(F.col("k") / 20) + 1.0).alias("hrss"), "rho")
    return rounded(reports.hrss50_by_ifar(t, "rho", {"1yr": 60.0, "1mo": 30.0}), "hrss50", digits=5)


@query("SELECT CASE WHEN rho = hi THEN 19 ELSE CAST(floor((rho - lo) / ((hi - lo) / 20)) AS BIGINT) END AS bin, count(*) AS n FROM t, (SELECT min(rho) AS lo, max(rho) AS hi FROM t) GROUP BY 1", _T)
def auto_histogram(spark, d):
    return reports.auto_histogram(triggers(spark, d), "rho", 20)


@query("SELECT id, rho, rank, round(rank / (10000000.0 / 31557600.0), 6) AS far FROM (SELECT id, rho, CAST(row_number() OVER (ORDER BY rho DESC, id) AS BIGINT) AS rank FROM t) WHERE rank <= 50", _T)
def background_report(spark, d):
    return rounded(reports.background_report(triggers(spark, d).select("id", "rho"), "rho", LIVETIME, 0.0, 10.0, 60, top=50)["loudest"], "far")


@query()
def zero_lag_counts(spark, d):
    t = triggers(spark, d).select("id", "rho")
    return reports.zero_lag_report(t.where("id % 50 = 0"), t, "rho", LIVETIME, LIVETIME / 100)["bands"]


# --- the sky

H1 = network.Detector("H1", (-2161414.9, -3834695.2, 4600350.2), (-0.2239, 0.7998, 0.5569), (-0.9140, 0.0261, -0.4049))
L1 = network.Detector("L1", (-74276.0, -5496283.7, 3224257.0), (-0.9546, -0.1416, -0.2622), (0.2977, -0.4879, -0.8205))


@query()
def antenna_patterns(spark, d):
    t = triggers(spark, d).select("id", (F.col("id") % 360).alias("a"), (F.col("id") * 7 % 180 - 90).alias("b"), "gps_time")
    plus, cross = network.antenna(H1, F.radians("a"), F.radians("b"), F.lit(0.3), F.col("gps_time"))
    return t.select("id", F.round(plus, 6).alias("f_plus"), F.round(cross, 6).alias("f_cross"))


@query()
def sky_delays(spark, d):
    grid = spark.range(3072).select(F.col("id").alias("sky_idx"), F.acos(1 - 2 * (F.col("id") + 0.5) / 3072).alias("theta"), F.pmod(math.pi * (1 + 5**0.5) * (F.col("id") + 0.5), F.lit(2 * math.pi)).alias("phi"))
    return network.sky_table(grid, [H1, L1], H1, 16384.0).select("sky_idx", "delays", F.transform("f_plus", lambda x: F.round(x, 6)).alias("f_plus"))


@query("SELECT id, round(pi() / 2 - k * 0.01, 6) AS dec FROM t", _T)
def frame_to_icrs(spark, d):
    t = triggers(spark, d)
    return t.select("id", F.round(network.to_icrs("colatitude", F.col("k") * 0.01, F.col("k") * 0.01, F.col("gps_time"))[1], 6).alias("dec"))


@query(f"SELECT id, frame, round((k * 0.05 + {_GMST}) % {geo.TWO_PI}, 5) AS ra, round(CASE frame WHEN 'geo' THEN k * 0.01 ELSE pi() / 2 - k * 0.01 END, 6) AS dec FROM t, (VALUES ('geo'), ('colatitude')) f(frame)", _T)
def frames_to_icrs(spark, d):
    """Both frames, and both coordinates of each."""
    t = triggers(spark, d)
    parts = []
    for frame in ("geo", "colatitude"):
        ra, dec = network.to_icrs(frame, F.col("k") * 0.05, F.col("k") * 0.01, F.col("gps_time"))
        parts.append(t.select("id", F.lit(frame).alias("frame"), F.round(ra, 5).alias("ra"), F.round(dec, 6).alias("dec")))
    return parts[0].unionByName(parts[1])


@query()
def weighted_sky(spark, d):
    pixels = spark.range(768).select((F.col("id") * 0.008).alias("ra"), (F.col("id") % 100 * 0.01).alias("dec"), (F.col("id") % 5).cast("double").alias("value"))
    return sky.weighted(triggers(spark, d).select("id"), "id", pixels, 2).groupBy("ra", "dec").agg(F.count("*").alias("n"))


# --- scalars and arrays


@query("SELECT id, CAST(k AS VARCHAR) || ',' || format('{:.12g}', k * 0.125) || ',' || format('{:.12g}', -(k + 1) / 3.0) AS key FROM t", _T)
def shift_key(spark, d):
    k = F.col("k")
    return triggers(spark, d).select("id", arrays.shift_key(F.array(k.cast("double"), k * 0.125, -(k + 1) / F.lit(3.0))).alias("key"))


@query("SELECT id, CASE WHEN k % 3 = 0 THEN NULL ELSE CAST(k AS DOUBLE) + 1 END AS second FROM t", _T)
def lag_vectors(spark, d):
    k = F.col("k").cast("string")
    text = F.when(F.col("k") % 3 == 0, F.concat(k, F.lit(",1;2"))).otherwise(F.concat(F.lit("0,0; "), k, F.lit(","), (F.col("k") + 1).cast("string"), F.lit(";")))
    return triggers(spark, d).select("id", F.get(F.get(arrays.lag_vectors(text), F.lit(1)), F.lit(1)).alias("second"))


@query("SELECT vec_id, round(abs(x[21]) / sqrt(list_sum(list_transform(y, lambda z: z * z))), 5) AS first FROM (SELECT vec_id, x, list_transform(x, lambda z, i: CASE WHEN i <= 19 THEN z WHEN i = 20 THEN 1 ELSE 0 END) AS y FROM (SELECT vec_id, list_transform(embedding, lambda z: CAST(z AS DOUBLE)) AS x FROM embeddings))")
def leakage(spark, d):
    x = F.transform("embedding", lambda z: z.cast("double"))
    cut = F.transform(x, lambda z, i: F.when(i < 19, z).when(i == 19, F.lit(1.0)).otherwise(F.lit(0.0)))
    return read(spark, d, "embeddings").select("vec_id", F.round(F.get(arrays.leakage(x, cut, 3), F.lit(0)), 5).alias("first"))


# --- online


@query()
def settled_neighbours(spark, d):
    t = triggers(spark, d).select(F.lit("all").alias("search"), "id", F.round(F.col("gps_time") / 100, 2).alias("gps"), (F.col("id") % 18 * 10).cast("double").alias("theta"), (F.col("id") % 12 * 30).cast("double").alias("phi"), "rho")
    return online.settled_neighbours_batch(t, "search", seconds=5.0, degrees=40.0).select("id", "gps", "rho")


@query("SELECT a.id FROM sky a JOIN t USING (id) WHERE a.id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM sky b JOIN t u ON u.id = b.id WHERE b.id % 2 = 1 AND u.rho >= t.rho AND abs(a.gps_time - b.gps_time) < 900 AND degrees(acos(least(1.0, greatest(-1.0, cos(radians(a.theta)) * cos(radians(b.theta)) + sin(radians(a.theta)) * sin(radians(b.theta)) * cos(radians(a.phi - b.phi)))))) < 20)", _T, _SKY)
def unknown_or_louder(spark, d):
    t = triggers(spark, d).select("id", F.col("gps_time").alias("gps"), (F.col("id") % 180).cast("double").alias("theta"), ((F.col("id") * 7) % 360).cast("double").alias("phi"), "rho")
    return online.unknown_or_louder(t.where("id % 2 = 0"), t.where("id % 2 = 1"), 900.0, 20.0).select("id")


@query("SELECT event_type, round(epoch(TIMESTAMP '2030-01-01 00:00:00') - max(epoch(ts)), 3) AS age, epoch(TIMESTAMP '2030-01-01 00:00:00') - max(epoch(ts)) > 100000000 AS stale FROM events GROUP BY 1")
def staleness(spark, d):
    now = F.lit("2030-01-01 00:00:00").cast("timestamp")
    return online.staleness(online.event_time(read(spark, d, "events"), "ts"), ["event_type"], "ts", now, 1e8).select("event_type", F.round("age", 3).alias("age"), "stale")


@query("SELECT user_id, round(epoch(b) + 3600, 3) AS start, round(epoch(ts), 3) AS \"end\" FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events) WHERE ts > b + INTERVAL 3600 seconds")
def gap_journal(spark, d):
    stretches = online.sessions(read(spark, d, "events"), "ts", 3600, ["user_id"])
    return online.journal(stretches, ["user_id"]).select("user_id", *[F.round(F.expr(SECONDS.format(c)), 3).alias(c) for c in ("start", "end")])


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
