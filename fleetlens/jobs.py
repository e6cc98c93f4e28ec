"""The two maintenance commands as jobs, for ``spark-submit``.

    fleetlens/jobs.py prune --registry IN --out OUT --seconds 86400 [--now 2024-05-01T00:00:00]
    fleetlens/jobs.py check --registry IN --out OUT --probes PROBES

Both write a new snapshot and print how many rows they pruned or failed.
"""

from __future__ import annotations

import argparse
from datetime import UTC, datetime

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from fleetlens import schemas as S
from fleetlens.operators.transitions import health_sweep, is_prunable, prune_cutoff
from fleetlens.session import builder
from fleetlens.sources.registry import read_registry, write_registry


def prune(spark: SparkSession, registry: str, out: str, seconds: int, now: datetime) -> int:
    """Rewrite the registry without old terminal rows, counting them in the same pass."""
    rows = read_registry(spark, registry)
    old = is_prunable(rows, prune_cutoff(now, seconds))
    seen = Observation()
    write_registry(rows.observe(seen, F.count_if(old).alias("pruned")).where(~old), out)
    return seen.get["pruned"]


def check(spark: SparkSession, registry: str, out: str, probes: str) -> int:
    """Rewrite the registry with unreachable sessions FAILED, counting them in the same pass."""
    swept = health_sweep(read_registry(spark, registry), spark.read.schema(S.PROBE_SCHEMA).parquet(probes))
    seen = Observation()
    write_registry(swept.marked.observe(seen, F.count_if("_hit").alias("failed")), out)
    return seen.get["failed"]


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Maintain a session registry.")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("prune", "check"):
        command = commands.add_parser(name)
        command.add_argument("--registry", required=True)
        command.add_argument("--out", required=True)
        if name == "prune":
            command.add_argument("--seconds", type=int, required=True)
            command.add_argument("--now", type=datetime.fromisoformat, default=datetime.now(UTC))
        else:
            command.add_argument("--probes", required=True)
    args = parser.parse_args(argv)
    spark = builder().getOrCreate()
    if args.command == "prune":
        print(f"pruned {prune(spark, args.registry, args.out, args.seconds, args.now)}")
    else:
        print(f"failed {check(spark, args.registry, args.out, args.probes)}")


if __name__ == "__main__":
    main()
