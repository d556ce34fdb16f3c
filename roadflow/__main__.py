"""Command line: ``python -m roadflow <job> ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from roadflow.plans import jobs
from roadflow.session import build_session
from roadflow.sources import tables


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="roadflow")
    jobs_ = p.add_subparsers(dest="job", required=True)

    def job(name: str, *arguments: tuple[str, dict]):
        sub = jobs_.add_parser(name)
        for flag, options in arguments:
            sub.add_argument(flag, **options)

    text, whole, real = {"required": True}, {"type": int}, {"type": float}
    job("odmatrix", ("--flows", text), ("--out", text), ("--frequency-s", {**whole, "default": 20}), ("--sampling-s", {**whole, "default": 5}), ("--seed", {**whole, "default": 0}))
    job("combine", ("--rules", text), ("--out", text), ("--separator", {"default": ";"}))
    job("vehicles", ("--od", text), ("--map", text), ("--out", text), ("--no-routing", {"action": "store_true"}),
        ("--frequency-s", {**whole, "default": 20}), ("--sampling-s", {**whole, "default": 5}), ("--download-date", {}),
        ("--grow-lat", {**real, "default": 0.0}), ("--grow-lon", {**real, "default": 0.0}),
        ("--south", real), ("--north", real), ("--west", real), ("--east", real))
    job("map", ("--graphml", text), ("--out", text))
    job("aggregate", ("--records", text), ("--out", text), ("--frames", whole), ("--round-freq-s", {**whole, "default": 5}), ("--interval-s", whole), ("--run", {}))
    job("merge", ("--runs", {"required": True, "nargs": "+"}), ("--out", text))
    job("info", ("--records", text), ("--minute", whole), ("--completion", real))
    job("comparison", ("--records", text), ("--vehicles", text), ("--minutes", {**whole, "default": 5}), ("--out", text))
    job("enrich", ("--frames", text), ("--map", text), ("--out", text), ("--offset-s", {**whole, "default": 0}))
    job("gps", ("--records", text), ("--map", text), ("--out", text))
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = build_session(f"roadflow-{a.job}")

    def part(name: str):
        return spark.read.parquet(f"{a.map}/{name}")

    if a.job == "odmatrix":
        jobs.flows_to_od(spark, a.flows, a.out, a.frequency_s, a.sampling_s, a.seed)
    elif a.job == "combine":
        jobs.combine_od(spark, a.rules, a.out, a.separator)
    elif a.job == "vehicles":
        made = jobs.od_to_vehicles(
            spark, tables.read_od(spark, a.od), part("nodes"), part("segments"), a.frequency_s, a.sampling_s, a.no_routing,
            a.download_date, a.grow_lat, a.grow_lon, south=a.south, north=a.north, west=a.west, east=a.east)
        tables.save_table(made, a.out)
    elif a.job == "map":
        jobs.build_map(spark, a.graphml, a.out)
    elif a.job == "aggregate":
        records, source = tables.load_records(spark, a.records), None
        if a.run:
            source = tables.RecordStore(spark, a.run, resume=True).attributes()
        jobs.aggregate(spark, records, a.out, a.frames, a.round_freq_s, a.interval_s, source)
    elif a.job == "merge":
        tables.merge_records(spark, a.runs, a.out)
    elif a.job == "info":
        for table in jobs.info(tables.load_records(spark, a.records), a.minute, a.completion):
            table.show(truncate=False, vertical=True)
    elif a.job == "comparison":
        jobs.comparison(spark, tables.load_records(spark, a.records), spark.read.parquet(a.vehicles), a.minutes, a.out)
    elif a.job == "enrich":
        edges = part("segments").select("node_from", "node_to", F.col("max_speed_kph").cast("double").alias("max_speed"))
        jobs.enrich(spark, a.frames, edges, a.out, a.offset_s)
    elif a.job == "gps":
        jobs.gps(tables.load_records(spark, a.records), part("nodes"), a.out)


if __name__ == "__main__":
    main()
