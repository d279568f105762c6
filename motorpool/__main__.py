"""Command line: make a fleet, make a feed, run the pipeline, certify it, watch the feed.

    spark-submit ... -m motorpool generate --out DIR --reservations 4000
    python -m motorpool events --out DIR --count 200 --inject-spike
    python -m motorpool pipeline --raw DIR
    python -m motorpool certify --by "data team" --date 2025-01-01
    python -m motorpool watch --events DIR --out DIR --checkpoint DIR
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from dataclasses import replace
from datetime import datetime

from pyspark.sql import SparkSession

from motorpool.plans import generate, medallion
from motorpool.session import configure
from motorpool.streaming.watch import watch
from motorpool.synth import fleet


def _size(opts: argparse.Namespace) -> fleet.Size:
    names = ("seed", "sites", "vehicles", "customers", "reservations", "days")
    return replace(fleet.Size(), **{n: getattr(opts, n) for n in names})


def _generate(spark: SparkSession, opts: argparse.Namespace) -> None:
    generate.write_fleet(spark, _size(opts), opts.out, opts.format).show(truncate=False)


def _events(spark: SparkSession, opts: argparse.Namespace) -> None:
    spike = None
    if opts.inject_spike:
        usual = fleet.Spike.of(opts.count)
        spike = fleet.Spike(
            usual.start if opts.spike_start is None else opts.spike_start,
            usual.duration if opts.spike_duration is None else opts.spike_duration,
            opts.spike_type,
            opts.spike_fraction,
        )
    start = datetime.fromisoformat(opts.start_ts.removesuffix("Z"))
    made = fleet.events(spark, _size(opts), opts.count, start, opts.ts_step_sec, spike)
    fleet.write_events(made, opts.out, opts.files)


def _pipeline(spark: SparkSession, opts: argparse.Namespace) -> None:
    raw = generate.read_fleet(spark, opts.raw, opts.format)
    for table, rows in medallion.run(spark, raw, source_system=opts.source_system, prefix=opts.prefix).items():
        print(f"{table:45s} {rows:>12d}")


def _certify(spark: SparkSession, opts: argparse.Namespace) -> None:
    medallion.certify_gold(spark, opts.by, opts.date, opts.prefix, opts.comment).show(truncate=False)


def _watch(spark: SparkSession, opts: argparse.Namespace) -> None:
    seen = watch(spark, opts.events, opts.out, opts.checkpoint, opts.delay)
    seen.alerts.groupBy("rule").count().show(truncate=False)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="motorpool")
    commands = top.add_subparsers(required=True)

    def command(name: str, run: object, sized: bool = False) -> argparse.ArgumentParser:
        sub = commands.add_parser(name)
        sub.set_defaults(run=run)
        if sized:
            default = fleet.Size()
            for option in ("seed", "sites", "vehicles", "customers", "reservations", "days"):
                sub.add_argument(f"--{option}", type=int, default=getattr(default, option))
        return sub

    make = command("generate", _generate, sized=True)
    make.add_argument("--out", required=True)
    make.add_argument("--format", choices=["csv", "parquet", "both"], default="both")

    feed = command("events", _events, sized=True)
    feed.add_argument("--out", required=True)
    feed.add_argument("--count", type=int, default=200)
    feed.add_argument("--files", type=int)
    feed.add_argument("--start-ts", default="2025-01-01T00:00:00Z")
    feed.add_argument("--ts-step-sec", type=float, default=1.0)
    feed.add_argument("--inject-spike", action="store_true")
    feed.add_argument("--spike-start", type=int)
    feed.add_argument("--spike-duration", type=int)
    feed.add_argument("--spike-type", choices=["idle", "fault", "both"], default="both")
    feed.add_argument("--spike-fraction", type=float, default=0.5)

    pipeline = command("pipeline", _pipeline)
    pipeline.add_argument("--raw", required=True)
    pipeline.add_argument("--format", choices=["csv", "parquet"], default="parquet")
    pipeline.add_argument("--source-system", default="synthetic")
    pipeline.add_argument("--prefix", default="")

    seal = command("certify", _certify)
    seal.add_argument("--by", required=True)
    seal.add_argument("--date", required=True)
    seal.add_argument("--comment", default="Checked, de-duplicated and approved for use.")
    seal.add_argument("--prefix", default="")

    live = command("watch", _watch)
    live.add_argument("--events", required=True)
    live.add_argument("--out", required=True)
    live.add_argument("--checkpoint", required=True)
    live.add_argument("--delay")
    return top


def main(argv: Sequence[str] | None = None) -> None:
    opts = parser().parse_args(argv)
    opts.run(configure(SparkSession.builder.appName("motorpool").getOrCreate()), opts)


if __name__ == "__main__":
    main()
