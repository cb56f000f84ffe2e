"""Readers and writers of catalogue files and of the text formats around them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Per-detector columns: four times, then single-precision statistics.
TIMES = ("time", "segment_start", "event_start", "event_stop")
INJECTION = "struct<name:string,hrss:float,target_snr:float,ra:float,dec:float,gps_time:double,pol:float,approximant:string,parameters:string>"


def trigger_schema(ifos: Sequence[str], statistics: Sequence[str] = ("rho", "likelihood", "ecor", "duration", "bandwidth"), per_ifo: Sequence[str] = ("s_snr", "noise")) -> T.StructType:
    """Keys, statistics, flat per-detector columns and the nullable injection struct."""
    parts = ["id string", "job_id int", "lag_idx int", "trial_idx int", "ifo_list array<string>", "gps_time double", "ifar double"]
    parts += [f"{s} float" for s in statistics] + [f"{t}_{i} double" for i in ifos for t in TIMES] + [f"{s}_{i} float" for i in ifos for s in per_ifo]
    return T._parse_datatype_string(", ".join([*parts, f"injection {INJECTION}"]))


PROGRESS = "job_id int, trial_idx int, lag_idx int, n_triggers int, livetime double, timestamp double, status string"


def read_catalog(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A Parquet catalogue; a path without rows' files is an error of Spark's."""
    reader = spark.read.option("mergeSchema", "true") if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_json_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A JSON (or JSON.gz) document with a list ``triggers``."""
    return spark.read.option("multiLine", "true").json(path).select(F.explode("triggers").alias("t")).select("t.*")


def append(df: DataFrame, path: str, sequence: Column | None = None) -> None:
    """Appends rows with an ingest order ``_seq`` (the append's time, then the row in it), which keep-last reads; Spark's commit makes the write atomic."""
    seq = sequence if sequence is not None else F.struct(F.unix_micros(F.current_timestamp()).alias("append"), F.monotonically_increasing_id().alias("row"))
    df.withColumn("_seq", seq).write.mode("append").parquet(path)


def available(df: DataFrame, wanted: Sequence[str], required: Sequence[str] = ()) -> DataFrame:
    """The wanted columns that are there; a missing required one is an error."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[c for c in dict.fromkeys([*required, *wanted]) if c in df.columns])


def read_segments(spark: SparkSession, path: str, shift: float = 0.0, four_columns: bool = False) -> DataFrame:
    """Start and end per line of a segment list; # starts a comment."""
    line = F.trim(F.regexp_replace("value", "#.*", ""))
    cols = F.split(line, r"\s+")
    at = 1 if four_columns else 0
    return spark.read.text(path).where(line != "").select((F.get(cols, F.lit(at)).cast("double") + shift).alias("start"), (F.get(cols, F.lit(at + 1)).cast("double") + shift).alias("end"))


def invert_segments(df: DataFrame, lo: float, hi: float) -> DataFrame:
    """What [lo, hi) has outside the segments of one list."""
    w = Window.orderBy("start", "end")
    ends = df.select("start", "end").union(df.sparkSession.createDataFrame([(hi, hi)], "start double, end double"))
    before = F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(float(lo)))
    return ends.select(F.greatest(before, F.lit(float(lo))).alias("a"), F.least("start", F.lit(float(hi))).alias("b")).where("b > a").select(F.col("a").alias("start"), F.col("b").alias("end"))


def read_frame_list(spark: SparkSession, path: str) -> DataFrame:
    """Start and duration written in frame file names."""
    start, length = (F.regexp_extract("value", r"-(\d+)-(\d+)\.gwf", i).try_cast("double") for i in (1, 2))
    return spark.read.text(path).select(F.col("value").alias("path"), start.alias("start"), (start + length).alias("end")).where("start is not null")


def read_columns(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """White-space separated columns; lines with another number of columns are left out, # starts a comment."""
    fields = T._parse_datatype_string(schema).fields
    line = F.trim(F.regexp_replace("value", "#.*", ""))
    cols = F.split(line, r"\s+")
    return spark.read.text(path).where((line != "") & (F.size(cols) == len(fields))).select(*[F.get(cols, F.lit(i)).try_cast(f.dataType).alias(f.name) for i, f in enumerate(fields)])


def read_job_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").try_cast("int").alias("job_id")).where("job_id is not null")


def read_intervals(spark: SparkSession, path: str, schema: str = "start double, end double") -> DataFrame:
    return spark.read.parquet(path) if path.endswith((".parquet", ".pq")) else spark.read.schema(schema).option("header", "true").csv(path)


def merge_fragments(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Fragments with differing columns, by name."""
    return spark.read.option("mergeSchema", "true").parquet(*paths)
