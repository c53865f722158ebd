"""The driver's entry where a library or the whole subpackage is missing, and the shared folder's rules."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

from tesserae.plans import shared

ROOT = Path(__file__).resolve().parents[1]
HIDE = """
import sys
class Hide:
    def find_spec(self, name, path=None, target=None):
        if name in {names}:
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Hide())
import __spark_entry__ as e
print(*e.queries())
"""


def names(*hidden):
    out = subprocess.run([sys.executable, "-c", HIDE.format(names=hidden)], cwd=ROOT, capture_output=True, text=True, check=True)
    return set(out.stdout.split())


def test_missing_libraries_take_only_their_queries():
    full, without, core = names("nothing"), names("zstandard"), names("tesserae.llm")
    assert {x for x in core if x[0] == "p" and x[1].isdigit()} == set() and core < full or core == full
    assert core <= without <= full and len(core) > 100
    if "p2_found" in full:
        assert "p2_found" not in without and "p7_found" in without and "p6_found" in without


def test_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, name, default):
            return default

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()  # noqa: N815

    with pytest.raises(RuntimeError):
        shared.shared_dir(Session())


def test_written_tables_go(spark):
    table = shared.materialize(spark.range(3), "t")
    path = table.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert table.count() == 3 and Path(path).exists()
    shared.clear(spark)
    assert not Path(path).exists()
