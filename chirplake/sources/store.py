"""The catalogue door: a folder with the tables of one search, opened, checked, appended to and asked in SQL.

``triggers`` and ``progress`` are Parquet folders; ``run_config`` (one row) and
``jobs`` (a row per job, with its shift and its injections) hold what a
single-file catalogue keeps as metadata of the file.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import catalog, lags
from .files import PROGRESS

#: Job ids that go to a scan as a filter.
PUSHED = 1000
#: Ingest order: the append, then the row inside it.
SEQUENCE = "_seq"
CONFIG = "version string, config string"
JOBS = "job_id int, shift array<double>, n_lags int, analyze_start double, analyze_end double, injections array<string>"


def _size(spark: SparkSession, path: str) -> int | None:
    """Bytes below a path, in whatever store Spark reads; None if nothing is there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.getContentSummary(at).getLength() if system.exists(at) else None


def validate(spark: SparkSession, path: str) -> str:
    """The path, if it holds bytes; else FileNotFoundError or ValueError."""
    size = _size(spark, path)
    if size is None:
        raise FileNotFoundError(path)
    if size == 0:
        raise ValueError(f"empty catalogue: {path}")
    return path


def with_sequence(df: DataFrame) -> DataFrame:
    """Rows with their ingest order: the time of the append above the row's number in it, so no two rows of a catalogue share one."""
    return df.withColumn(SEQUENCE, F.struct(F.unix_micros(F.current_timestamp()).alias("append"), F.monotonically_increasing_id().alias("row")))


@dataclass(frozen=True)
class Catalogue:
    spark: SparkSession
    path: str

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType, config: Mapping, jobs: DataFrame | None = None, version: str = "1") -> Catalogue:
        """An empty catalogue with its schema and metadata."""
        out = cls(spark, path)
        with_sequence(spark.createDataFrame([], schema)).write.parquet(f"{path}/triggers")
        spark.createDataFrame([], PROGRESS).write.parquet(f"{path}/progress")
        spark.createDataFrame([(version, json.dumps(config))], CONFIG).coalesce(1).write.parquet(f"{path}/run_config")
        (jobs if jobs is not None else spark.createDataFrame([], JOBS)).write.parquet(f"{path}/jobs")
        return out

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Catalogue:
        validate(spark, f"{path}/triggers")
        return cls(spark, path)

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(f"{self.path}/{name}")

    def columns(self) -> list[str]:
        """Names from the files' schema; no row is read."""
        return [c for c in self._table("triggers").columns if c != SEQUENCE]

    def total(self) -> int:
        """Rows as stored, repeated ones included; counted from the files' footers."""
        return self._table("triggers").count()

    def triggers(self, deduplicate: bool = True) -> DataFrame:
        rows = self._table("triggers")
        return (catalog.keep_last(rows, order=SEQUENCE) if deduplicate else rows).drop(SEQUENCE)

    def of_jobs(self, ids: DataFrame, where: Column | None = None) -> DataFrame:
        """Triggers of the jobs of a table with ``job_id``, as the last append left them; a filter sees those alone, never a row that was replaced.

        Up to ``PUSHED`` ids go to the scan as a filter on the key, so files and
        row groups without them are skipped (see ``cluster``); more meet the
        triggers in a semi-join, which Spark helps by a filter at run time.
        """
        wanted = ids.select("job_id").distinct()
        few = [r["job_id"] for r in wanted.limit(PUSHED + 1).collect()]
        rows = self._table("triggers")
        rows = rows.where(F.col("job_id").isin(few)) if len(few) <= PUSHED else rows.join(wanted, "job_id", "left_semi")
        last = catalog.keep_last(rows, order=SEQUENCE).drop(SEQUENCE)
        return last if where is None else last.where(where)

    def cluster(self, files: int = 64, row_group: int = 16 << 20) -> Catalogue:
        """A catalogue beside this one, ``<path>-clustered``, with the triggers dealt and sorted by job: every file holds a range of jobs, every row group a narrow one, and a Bloom filter of them, so a scan for some jobs skips the rest.

        ``files`` bounds the number of files; appends go on in either.
        """
        out = Catalogue(self.spark, f"{self.path}-clustered")
        rows = self._table("triggers").repartitionByRange(files, "job_id").sortWithinPartitions("job_id")
        writer = rows.write.option("parquet.block.size", str(row_group)).option("parquet.bloom.filter.enabled#job_id", "true").option("parquet.bloom.filter.expected.ndv#job_id", "100000")
        writer.parquet(f"{out.path}/triggers")
        for name in ("progress", "run_config", "jobs"):
            self._table(name).write.parquet(f"{out.path}/{name}")
        return out

    def append(self, rows: DataFrame) -> None:
        with_sequence(rows).write.mode("append").parquet(f"{self.path}/triggers")

    def append_progress(self, rows: DataFrame) -> None:
        rows.select(*[f.name for f in T._parse_datatype_string(PROGRESS).fields]).write.mode("append").parquet(f"{self.path}/progress")

    def progress(self) -> DataFrame:
        return self._table("progress")

    def metadata(self) -> dict:
        """Version and configuration: the one row of ``run_config``."""
        row = self._table("run_config").first()
        return {"version": row["version"], "config": json.loads(row["config"])}

    def jobs(self) -> DataFrame:
        return self._table("jobs")

    def injections(self) -> DataFrame:
        """The jobs' scheduled injections, one row each, as they were written (JSON)."""
        return self.jobs().select("job_id", F.explode("injections").alias("injection"))

    def unshifted(self) -> DataFrame:
        return lags.unshifted_jobs(self.jobs())

    def live_time(self, where: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
        """Summed live time of the completed progress rows; without any, the jobs' lengths for each of their lags."""
        done = self.progress().where("status = 'completed'")
        if done.isEmpty():
            done = live_time_rows(self.jobs())
        return catalog.live_time(done, where, by)

    def query(self, sql: str, **tables: DataFrame) -> DataFrame:
        """SQL over the relation ``triggers`` (and further ones by name)."""
        return query(self.spark, sql, triggers=self.triggers(), **tables)


def live_time_rows(jobs: DataFrame) -> DataFrame:
    """A live-time row for each lag of each job, from the job table alone."""
    return jobs.select("job_id", F.explode(F.sequence(F.lit(0), F.greatest(F.coalesce("n_lags", F.lit(1)), F.lit(1)) - 1)).alias("lag_idx"), (F.col("analyze_end") - F.col("analyze_start")).alias("livetime"))


_RENAMED = {"json_extract_string": "get_json_object", "json_extract": "get_json_object", "list_contains": "array_contains", "list_sum": "aggregate_sum", "list_max": "array_max", "list_min": "array_min", "epoch": "unix_seconds"}
_QUALIFY = re.compile(r"\bQUALIFY\b(.*?)(?=\bORDER\s+BY\b(?![^()]*\))|\bLIMIT\b|\Z)", re.I | re.S)


def _without_text(sql: str) -> tuple[str, list[str]]:
    """SQL with its quoted texts as numbered marks, and these texts."""
    found: list[str] = []

    def mark(m: re.Match) -> str:
        found.append(m[0])
        return f"\0{len(found) - 1}\0"

    return re.sub(r"'(?:[^']|'')*'", mark, sql.strip().rstrip(";")), found


def _with_text(sql: str, texts: list[str]) -> str:
    return re.sub("\0([0-9]+)\0", lambda m: texts[int(m[1])], sql)


def translated(sql: str, views: Mapping[str, str] | None = None) -> str:
    """The sort of SQL that catalogues are asked in, as Spark's: names of JSON and list functions, list elements counted from 1, QUALIFY behind one SELECT (an error elsewhere), names in double quotes; relations are common tables over the views given for them.

    Text in quotes stays as it is.
    """
    sql, texts = _without_text(sql)
    for old, new in _RENAMED.items():
        sql = re.sub(rf"\b{old}\s*\(", f"{new}(", sql, flags=re.I)
    sql = re.sub(r"\baggregate_sum\(([\w.]+)\)", r"aggregate(\1, 0D, (a, x) -> a + x)", sql)
    sql = re.sub(r"([A-Za-z_][\w.]*)\[(\d+)\]", r"try_element_at(\1, \2)", sql)
    sql = re.sub(r'"((?:[^"]|"")*)"', lambda m: "`" + m[1].replace('""', '"').replace("`", "``") + "`", sql)
    found = _QUALIFY.search(sql)
    if found:
        head, tail = sql[: found.start()], sql[found.end() :]
        if not re.match(r"\s*SELECT\b", sql, re.I) or head.count("(") != head.count(")") or _QUALIFY.search(tail) or re.search(r"\b(?:UNION|EXCEPT|INTERSECT)\b", sql, re.I):
            raise ValueError("QUALIFY is understood behind a single SELECT only")
        inner = re.sub(r"^\s*SELECT\s+(.*?)\s+FROM\s", lambda m: f"SELECT {m[1]}, ({found[1].strip()}) AS __kept FROM ", head, count=1, flags=re.I | re.S)
        sql = f"SELECT * EXCEPT (__kept) FROM ({inner}) WHERE __kept {tail}"
    if views:  # the query's own names, ahead of its own common tables
        own = ", ".join(f"{name} AS (SELECT * FROM {view})" for name, view in views.items())
        start = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql, re.I)
        sql = f"WITH {start[1] or ''}{own}, {sql[start.end() :]}" if start else f"WITH {own} {sql}"
    return _with_text(sql, texts)


def query(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """SQL over the given relations, by views that only this query's text names."""
    views = {name: f"{name}_{uuid.uuid4().hex}" for name in tables}
    for name, rows in tables.items():
        rows.createOrReplaceTempView(views[name])
    return spark.sql(translated(sql, views))


def from_json(spark: SparkSession, path: str) -> DataFrame:
    """Triggers of a JSON catalogue (.json or .json.gz, one document with a list ``triggers``), keep-last by (job_id, id); ask it with ``query``."""
    rows = spark.read.option("multiLine", "true").json(validate(spark, path)).select(F.posexplode("triggers").alias("_at", "t")).select("_at", "t.*")
    return catalog.keep_last(rows, ("job_id", "id"), "_at").drop("_at")


def rows_of(spark: SparkSession, path: str) -> DataFrame:
    """A catalogue's triggers, or the rows of a plain Parquet table; repeated rows go where the key is there."""
    if _size(spark, f"{path}/triggers") is not None:
        return Catalogue.open(spark, path).triggers()
    return spark.read.parquet(validate(spark, path))


def runs(catalogues: Mapping[str, Catalogue], columns: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Triggers and scheduled injections of several catalogues by column name, with run_index and run_name: also injections without a trigger."""
    if not catalogues:
        raise ValueError("no catalogue")
    out = []
    for part in ("triggers", "injections"):
        frames = []
        for index, (name, one) in enumerate(catalogues.items()):
            rows = getattr(one, part)()
            rows = rows.select(*[c for c in rows.columns if c in columns]) if columns and part == "triggers" else rows
            frames.append(rows.withColumn("run_index", F.lit(index)).withColumn("run_name", F.lit(name)))
        whole = frames[0]
        for more in frames[1:]:
            whole = whole.unionByName(more, allowMissingColumns=True)
        out.append(whole)
    return out[0], out[1]


def labelled(background: DataFrame, simulations: DataFrame, label: str = "classifier") -> DataFrame:
    """Rows of both classes, 0 and 1, by column name."""
    return background.withColumn(label, F.lit(0)).unionByName(simulations.withColumn(label, F.lit(1)), allowMissingColumns=True)


def labelled_by_injection(triggers: DataFrame, label: str = "classifier", injection: str = "injection") -> DataFrame:
    """0 for rows without an injection, else 1."""
    return triggers.withColumn(label, F.when(F.col(injection).isNull(), 0).otherwise(1))


def flat_detectors(df: DataFrame, ifos: Sequence[str]) -> DataFrame:
    """Columns ``name_IFO`` as ``name_0``, ``name_1``: by the detectors' places in the list."""
    names = {f"{c}": f"{c[: -len(ifo) - 1]}_{i}" for i, ifo in enumerate(ifos) for c in df.columns if c.endswith(f"_{ifo}")}
    return df.withColumnsRenamed(names)
