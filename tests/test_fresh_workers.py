"""Workers that load one module of operators before any other."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
MODULES = sorted(str(p.relative_to(ROOT).with_suffix("")).replace("/", ".") for p in (ROOT / "quarry").rglob("*.py") if p.name != "__init__.py")

RUN = """
from pyspark.sql import SparkSession
from quarry import registry
s = SparkSession.builder.master("local[1]").config("spark.sql.shuffle.partitions", "1").config("spark.ui.enabled", "false").getOrCreate()
print("ROWS", registry.QUERIES["{name}"](s, "/root/testdata/sf0.001").count())
"""


def fresh(code):
    return subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=os.environ | {"PYTHONPATH": str(ROOT)}, capture_output=True, text=True, timeout=300)


@pytest.mark.parametrize("name", MODULES)
def test_module_loads_first(name):
    """Unpickling a function in a worker imports its module, whatever was imported before."""
    done = fresh(f"import {name}")
    assert not done.returncode, done.stderr[-500:]


def first_query(name):
    """A query as the first one of a session."""
    done = fresh(RUN.format(name=name))
    assert not done.returncode, done.stderr[-500:]
    assert int(done.stdout.rpartition("ROWS")[2]) > 0


def test_context_clusters_first():
    first_query("n06_context_clusters")


def test_code_lengths_first():
    first_query("n07_code_lengths")
