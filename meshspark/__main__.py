"""``python -m meshspark ALGORITHM -d graph [-v root] [-i iterations] [-r rounds] ... [-o folder]``: run it, print times, write the result.

The session comes from spark-submit's settings; the result is written as Parquet where -o says, else its first rows are shown.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .plans.config import ALGORITHMS, RunConfig, execute, mean_seconds


def main(args: list[str], spark: SparkSession | None = None) -> float:
    """Mean seconds of the supersteps of a round."""
    if not args or args[0] not in ALGORITHMS:
        raise SystemExit(f"usage: python -m meshspark {{{','.join(sorted(ALGORITHMS))}}} -d graph [options]")
    name, rest, out = args[0], list(args[1:]), None
    if "-o" in rest:
        at = rest.index("-o")
        out = rest[at + 1]
        del rest[at : at + 2]
    spark = spark or SparkSession.builder.appName(f"meshspark {name}").getOrCreate()
    result, report = execute(spark, name, RunConfig.parse(rest))
    for r in report.collect():  # a row a round
        print(f"{r.label} round {r.round}: {r.seconds:.3f} s in {r.supersteps} supersteps, {r.total:.3f} s in all{'' if r.counted else ' (not counted)'}")
    mean = mean_seconds(report)
    print(f"{name}: {mean:.3f} s on average")
    if out:
        result.write.mode("overwrite").parquet(out)
    else:
        result.show()
    return mean


if __name__ == "__main__":
    main(sys.argv[1:])
