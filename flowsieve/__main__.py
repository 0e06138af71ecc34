"""Command line: ``python -m flowsieve --out DIR [--cic GLOB] [--unsw PATH ...]``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from flowsieve.operators.models import BOOST_ROUNDS, FOREST_TREES
from flowsieve.plans.job import Settings, run_all
from flowsieve.session import ship_package


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="flowsieve", description=run_all.__doc__)
    parser.add_argument("--out", required=True, help="folder for tables, models and metrics")
    parser.add_argument("--cic", help="glob of headered flow files")
    parser.add_argument("--unsw", nargs="+", help="headerless flow files")
    parser.add_argument("--null-label", choices=("attack", "drop"), default="attack")
    parser.add_argument("--forest-trees", type=int, default=FOREST_TREES)
    parser.add_argument("--boost-rounds", type=int, default=BOOST_ROUNDS)
    options = parser.parse_args(arguments)
    if not (options.cic or options.unsw):
        parser.error("name at least one of --cic and --unsw")
    spark = SparkSession.builder.appName("flowsieve").getOrCreate()
    ship_package(spark)
    settings = Settings(
        forest={"trees": options.forest_trees},
        boost={"rounds": options.boost_rounds},
        null_label=options.null_label,
    )
    run_all(spark, options.out, options.cic, options.unsw, settings).show(50, truncate=False)


if __name__ == "__main__":
    main()
