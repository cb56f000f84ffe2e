"""The command line: python -m chirplake COMMAND; on a cluster, spark-submit of this file."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators import catalog, injections, matching
from .plans.workflow import Workflow
from .session import get_spark
from .sources import files
from .sources.store import Catalogue


def progress(spark: SparkSession, args: argparse.Namespace) -> None:
    """Summed progress of each job."""
    catalog.progress_by_job(Catalogue.open(spark, args.catalogue).progress()).orderBy("job_id").show(args.rows, truncate=False)


def query(spark: SparkSession, args: argparse.Namespace) -> None:
    """SQL over the relation triggers."""
    Catalogue.open(spark, args.catalogue).query(args.sql).show(args.rows, truncate=False)


def merge(spark: SparkSession, args: argparse.Namespace) -> None:
    """Fragments of one table, by column name, as one."""
    files.merge_fragments(spark, args.fragments).write.parquet(args.out)


def post_process(spark: SparkSession, args: argparse.Namespace) -> None:
    """A workflow file."""
    flow = Workflow.read(args.workflow)
    flow.context.setdefault("spark", spark)
    flow.run()


def match_simulations(spark: SparkSession, args: argparse.Namespace) -> None:
    """Triggers with their simulations."""
    triggers = Catalogue.open(spark, args.catalogue).triggers()
    matching.match(triggers, spark.read.parquet(args.simulations), args.how, args.buffer, args.cell).write.parquet(args.out)


def simulation_summary(spark: SparkSession, args: argparse.Namespace) -> None:
    """Scheduled injections with their segment and veto flags."""
    windows = lambda path: spark.read.parquet(path) if path else None
    out = injections.flags(spark.read.parquet(args.simulations), spark.read.parquet(args.segments), windows(args.cat0), windows(args.cat2), "gps_time", args.cell)
    out.write.parquet(args.out)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="chirplake", description=__doc__)
    out.add_argument("--master")
    commands = out.add_subparsers(dest="command", required=True)

    def add(run, *options: tuple) -> None:
        one = commands.add_parser(run.__name__.replace("_", "-"), help=run.__doc__)
        one.set_defaults(run=run)
        for names, more in options:
            one.add_argument(*names, **more)

    catalogue, out_path, rows = (("catalogue",), {}), (("--out",), {"required": True}), (("--rows",), {"type": int, "default": 100})
    cell = (("--cell",), {"type": float, "default": 10.0})
    add(progress, catalogue, rows)
    add(query, catalogue, (("sql",), {}), rows)
    add(merge, (("fragments",), {"nargs": "+"}), out_path)
    add(post_process, (("workflow",), {}))
    add(match_simulations, catalogue, (("simulations",), {}), out_path, (("--how",), {"default": "inner", "choices": ["inner", "left", "right", "outer"]}), (("--buffer",), {"type": float, "default": 0.0}), cell)
    add(simulation_summary, (("simulations",), {}), (("segments",), {}), out_path, (("--cat0",), {}), (("--cat2",), {}), cell)
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(spark or get_spark("chirplake", args.master), args)


if __name__ == "__main__":
    main()
