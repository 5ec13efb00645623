"""``python -m cladeframe -dir proteomes``: an orthology run from the command line."""

from __future__ import annotations

from pyspark.sql import SparkSession

from cladeframe.config import parse_args
from cladeframe.plans.pipeline import run


def main(argv: list[str] | None = None) -> None:
    config = parse_args(argv)
    builder = SparkSession.builder.appName("cladeframe")
    if config.threads > 1:  # as on one machine; on a cluster the master is spark-submit's
        builder = builder.master(f"local[{config.threads}]")
    run(SparkSession.getActiveSession() or builder.getOrCreate(), config)


if __name__ == "__main__":
    main()
