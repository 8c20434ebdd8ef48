"""Every telemetry query against its SQL on the smallest tables."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

from tests.oracle import same
from tramline.plans import catalogue

ROOT = str(Path(__file__).resolve().parent.parent)
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_as_sql(spark, name):
    same(spark, SF, catalogue.QUERIES[name], catalogue.ORACLES[name])


@pytest.mark.parametrize("name", ["decimate_track", "route_polyline", "hmm_snap", "subgraph_corridor", "stream_late_drop"])
def test_gives_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_entry_without_the_corpus_operators():
    code = (
        "import sys, importlib.util as u\n"
        "f = u.find_spec\n"
        "u.find_spec = lambda n, *a: None if n.startswith('tramline.llm') or n == 'corpus_pipeline' else f(n, *a)\n"
        "import __spark_entry__ as e\n"
        "assert 'target_stop' in e.queries() and not [q for q in e.queries() if q.startswith('op') or q == 'pipeline']\n"
        "assert not [m for m in sys.modules if m.startswith('tramline.llm')]\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
