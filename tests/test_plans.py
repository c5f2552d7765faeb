"""Plan-shape guards over every query of the catalog (sf0.001); the training-data queries read other columns."""

import io
from contextlib import redirect_stdout

import pytest

from quarry.plans.catalog import QUERIES

FORBIDDEN = ("BroadcastNestedLoopJoin", "CartesianProduct")


@pytest.fixture(scope="module")
def plans(spark):
    from conftest import SF_SMALL

    out = {}
    for name, fn in QUERIES.items():
        buf = io.StringIO()
        with redirect_stdout(buf):
            fn(spark, SF_SMALL).explain("formatted")
        out[name] = buf.getvalue()
    return out


def test_no_cross_or_nested_loop_joins(plans):
    bad = {n: [f for f in FORBIDDEN if f in p] for n, p in plans.items() if any(f in p for f in FORBIDDEN)}
    assert bad == {}


def test_scans_read_only_needed_columns(plans):
    # documents carry lang/source/n_chars that no query uses; no scan may read them
    for name, p in plans.items():
        for line in p.splitlines():
            if line.startswith("ReadSchema:") and "doc_id:bigint,text:string" in line:
                assert "lang" not in line and "n_chars" not in line, name
