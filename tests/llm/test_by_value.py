"""Every operator and the pipeline where the package lies on the driver's path alone: executors get its code with the tasks."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from meshspark.llm import queries

CODE = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
import __spark_entry__ as entry

spark = (
    SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
    .config("spark.checkpoint.dir", {shared!r}).getOrCreate()
)
spark.sparkContext.setLogLevel("OFF")

def seen(batches):
    import importlib.util

    import pyarrow as pa

    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([importlib.util.find_spec("meshspark") is not None] * b.num_rows)], names=["seen"])

assert not any(r.seen for r in spark.range(4).mapInArrow(seen, "seen boolean").collect())
failed = []
for name in {names!r}:
    try:
        entry.queries()[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    except Exception as e:
        failed.append((name, str(e).strip().splitlines()[-1]))
print("failed:", failed)
"""


@pytest.mark.parametrize("names", [sorted(queries.queries()), ["pipeline"]], ids=["operators", "pipeline"])
def test_executors_need_no_package(tmp_path, names):
    repo = str(Path(__file__).resolve().parents[2])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = CODE.format(repo=repo, shared=str(tmp_path / "shared"), names=names)
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.stdout.strip().splitlines()[-1:] == ["failed: []"], done.stdout + done.stderr[-2000:]
