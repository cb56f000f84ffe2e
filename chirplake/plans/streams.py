"""The online operators on the provided tables, as tables and as streams over their files; the stand-ins are those of ``queries``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import scratch_dir
from ..streaming import buffer, coincide, online
from .queries import Query, read

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *ctes: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = ("WITH " + ", ".join(ctes) + " " if ctes else "") + sql
        return f

    return add


def _stream(spark, d: str, name: str):
    schema = read(spark, d, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/{name}.parq*")


def _ran(spark, name: str, rows):
    """What a stream gave out by its end."""
    out = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    rows.writeStream.outputMode("append").format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{out}/rows")


# --- coincidences of two detectors: clicks and purchases of a user, half an hour apart at most


_PAIRS = "SELECT a.event_id AS id, b.event_id AS other FROM events a {} JOIN events b ON b.event_type = 'purchase' AND b.user_id = a.user_id AND a.ts BETWEEN b.ts - INTERVAL 1800 SECONDS AND b.ts + INTERVAL 1800 SECONDS WHERE a.event_type = 'click'"


def _sides(events):
    rows = online.event_time(events, "ts").select("event_id", "user_id", "ts", "event_type")
    return rows.where("event_type = 'click'"), rows.where("event_type = 'purchase'")


@query(_PAIRS.format("LEFT"))
def coincidences(spark, d):
    return coincide.coincident(*_sides(read(spark, d, "events")), "ts", 1_800_000, "left", ["user_id"]).select(F.col("event_id").alias("id"), F.col("other_event_id").alias("other"))


@query(_PAIRS.format(""))
def coincidence_stream(spark, d):
    """Both sides as streams over the events' file, to its end."""
    a, b = (_sides(_stream(spark, d, "events"))[i] for i in (0, 1))
    return _ran(spark, "coincide", coincide.coincident(a, b, "ts", 1_800_000, "inner", ["user_id"]).select(F.col("event_id").alias("id"), F.col("other_event_id").alias("other")))


# --- windows of samples: an order is a chunk of one second with two samples

_WHOLE = "k AS (SELECT CAST(o_orderkey // 4096 AS VARCHAR) AS detector, o_orderkey AS s, CAST(o_totalprice AS DOUBLE) AS a, CAST(o_custkey AS DOUBLE) AS b FROM orders), w AS (SELECT DISTINCT detector, (s // 2 - x) * 2 AS start FROM k, range(3) r(x))"
_WINDOWS = 'SELECT w.detector, CAST(w.start AS DOUBLE) AS start, 8 AS n, round(sum(a + b), 2) AS total, min_by(a, s) AS first, max_by(b, s) AS last FROM w JOIN k ON k.detector = w.detector AND k.s >= w.start AND k.s < w.start + 4 GROUP BY 1, 2 HAVING count(*) = 4'


def _chunks(orders):
    s = F.col("o_orderkey")
    return orders.select(F.floor(s / 4096).cast("string").alias("detector"), s.cast("double").alias("start"), F.array(F.col("o_totalprice").cast("double"), F.col("o_custkey").cast("double")).alias("samples"), F.timestamp_seconds(s + 1).alias("done"))


def _summed(rows):
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)
    return rows.select("detector", "start", F.size("samples").alias("n"), F.round(total, 2).alias("total"), F.get("samples", F.lit(0)).alias("first"), F.element_at("samples", -1).alias("last"))


@query(_WINDOWS, _WHOLE)
def sample_windows(spark, d):
    return _summed(buffer.windows(_chunks(read(spark, d, "orders")), 4.0, 2.0, 2.0))


@query(_WINDOWS, _WHOLE)
def sample_window_stream(spark, d):
    """The orders' file as a stream; what no watermark has passed is complete all the same."""
    return _summed(_ran(spark, "samples", buffer.streamed_windows(_chunks(_stream(spark, d, "orders")), "done", 4.0, 2.0, 2.0, 600)))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
