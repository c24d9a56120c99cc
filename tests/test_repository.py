"""Rules of the repository itself, and parity of the queries with their SQL."""

import datetime as dt
import math
import re
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from quillspark.operators.ledger import ChunkLedger
from quillspark.plans import company_queries, core_queries, entity_queries, market_queries, source_queries

ROOT = Path(__file__).resolve().parent.parent
SOURCES = [p for p in (ROOT / "quillspark").rglob("*.py")]


def test_nothing_imports_the_optional_subpackage():
    for p in SOURCES:
        if "llm" not in p.parts:
            assert not re.search(r"^\s*(from|import)\s+quillspark\.llm", p.read_text(), re.M), p


def test_no_unreliable_checkpoints_or_row_udfs():
    for p in SOURCES:
        text = p.read_text()
        assert ".localCheckpoint(" not in text and "F.udf(" not in text and ".rdd" not in text, p


def test_ledger(spark, tmp_path):
    path, seen = str(tmp_path / "l.json"), []
    assert ChunkLedger(path, "j").run(["a", "b"], seen.append) == ["a", "b"]
    assert ChunkLedger(path, "j").run(["a", "b", "c"], seen.append) == ["c"]
    assert seen == ["a", "b", "c"]
    with pytest.raises(ValueError):
        ChunkLedger(path, "other")


SQL = {k: v for m in (core_queries, market_queries, company_queries, source_queries, entity_queries) for k, v in m.ORACLE_SQL.items()}
RUN = {k: v for m in (core_queries, market_queries, company_queries, source_queries, entity_queries) for k, v in m.QUERIES.items()}


def cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "-"
    if isinstance(x, (float, Decimal)):
        return f"{float(x):.6f}"
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None).isoformat()
    return x.isoformat() if isinstance(x, dt.date) else str(x)


def canonical(columns, table):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in table)


@pytest.fixture(scope="module")
def oracle(data):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in Path(data).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_parity_with_sql(spark, data, oracle, name):
    df = RUN[name](spark, data)
    got = oracle.execute(SQL[name])
    want = canonical([c[0] for c in got.description], got.fetchall())
    assert canonical(df.columns, df.collect()) == want


def test_hot_paths_stay_in_the_jvm(spark, data):
    """Plans that native expressions can express run no Python."""
    for name in ("vol_topn_lists", "outcome_forward", "facts_resolve", "trend_matched_plans", "purchase_clusters", "p5_found", "merge_latest"):
        plan = RUN[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan, name


def test_scans_read_only_what_is_used(spark, data):
    plan = RUN["ticker_owner_count"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"ReadSchema: struct<cik:string,ticker:string>", plan)
    plan = RUN["vol_moves"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan
