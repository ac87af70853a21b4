"""Run parameters, the runs they describe, and the harness that repeats a query and reports its times."""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

from ..graph import Graph
from ..operators import algorithms as A
from ..operators.gas import timing
from ..operators.partitioning import Bins, bin_params
from ..storage import cut


@dataclass(frozen=True)
class RunConfig:
    """``threads`` and ``kilobytes`` size the bins; ``dynamic`` asks for unequal partitions where partitions are made."""

    data: str = ""
    root: int = 1
    kilobytes: int = 256
    iterations: int = 20
    rounds: int = 3
    threads: int = 20
    dynamic: bool = False

    @classmethod
    def parse(cls, args: list[str]) -> RunConfig:
        """From options -d file, -v root, -s kilobytes, -i iterations, -r rounds, -t threads, -y (dynamic)."""
        p = argparse.ArgumentParser(prog="meshspark", exit_on_error=False)
        for flag, name in zip(("-d", "-v", "-s", "-i", "-r", "-t"), fields(cls), strict=False):
            p.add_argument(flag, dest=name.name, type=type(name.default), default=name.default)
        p.add_argument("-y", dest="dynamic", action="store_true")
        return cls(**vars(p.parse_args(args)))

    def bins(self, g: Graph) -> Bins:
        return bin_params(g.vertices.count(), self.threads, self.kilobytes)


#: Algorithm -> its result with the parameters of a run.
ALGORITHMS: dict[str, Callable[[Graph, RunConfig], DataFrame]] = {
    "pagerank": lambda g, r: A.pagerank(g, r.iterations),
    "pagerank_delta": lambda g, r: A.pagerank_delta(g, r.iterations, bins=r.bins(g)).state,
    "bfs": lambda g, r: A.bfs(g, r.root).state,
    "components": lambda g, r: A.connected_components(g).state,
    "sssp": lambda g, r: A.sssp(g, r.root).state,
    "nibble": lambda g, r: A.nibble(g, r.root, r.iterations).state,
    "in_degree": lambda g, r: A.in_degree(g),
    "eigenvector": lambda g, r: A.eigenvector(g, r.iterations),
    "collaborative_filtering": lambda g, r: A.collaborative_filtering(g, r.iterations),
    "hits": lambda g, r: A.hits(g, r.iterations),
}
#: Their mean time counts the first round too.
ALL_ROUNDS = ("pagerank_delta", "nibble")


def execute(spark: SparkSession, name: str, config: RunConfig, g: Graph | None = None) -> tuple[DataFrame, DataFrame]:
    """(result of the last round, report of the rounds' times) of an algorithm on ``config.data`` (a binary file or folder) or a graph in hand.

    A graph that was loaded here is released again.
    """
    own = g is None
    if g is None:
        g = Graph.load(spark, config.data, "csr_weighted" if name == "sssp" else "mix").saved()
    result: list[DataFrame] = []

    def query() -> DataFrame:
        result[:] = [ALGORITHMS[name](g, config)]
        return result[0]

    report = timed_rounds(spark, name, query, config, skip_first=name not in ALL_ROUNDS)
    out = cut(result[0] if result else ALGORITHMS[name](g, config), "run-result")
    if own:
        g.release()
    return out, report


def timed_rounds(spark: SparkSession, label: str, query: Callable[[], DataFrame], config: RunConfig, skip_first: bool = True) -> DataFrame:
    """label, round, seconds, counted, total, supersteps: every round runs the query whole; the first is left out of the mean if others exist.

    ``seconds`` are those of the supersteps alone, from the first state to the last (``total`` has what comes before
    and after as well); of a query without supersteps they are the total.
    """
    rows = []
    for i in range(config.rounds):
        began = time.perf_counter()
        with timing() as laps:
            query().write.format("noop").mode("overwrite").save()
        total = time.perf_counter() - began
        seconds = sum(s for _, s in laps) if laps else total
        rows.append((label, i, seconds, not (skip_first and i == 0 and config.rounds > 1), total, laps[-1][0] if laps else 0))
    return spark.createDataFrame(rows, "label string, round int, seconds double, counted boolean, total double, supersteps int")


def mean_seconds(report: DataFrame) -> float:
    return report.where("counted").agg({"seconds": "avg"}).first()[0] or 0.0
