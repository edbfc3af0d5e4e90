"""The driver contract."""

import pytest

import __spark_entry__ as entry
from rankscope.plans import catalog


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    own = {name for name in entry.queries() if name in catalog.QUERIES}
    assert own - set(entry.oracle_sql()) == {"k03_analysis_document"}


def test_flagship_query(spark):
    df = entry.entry(spark)
    assert df.count() == 20 and df.columns[0] == "position"


def test_the_analysis_summary_has_its_findings(spark, sf_dir):
    """Totals, pattern and issue lines, equal to the SQL."""
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for name in ("lineitem", "orders"):
        db.execute(f"create view {name} as from read_parquet('{sf_dir}/{name}.parquet')")
    want = sorted(db.execute(entry.oracle_sql()["k07_analysis_findings"]).fetchall())
    got = sorted(tuple(r) for r in entry.queries()["k07_analysis_findings"](spark, sf_dir).collect())
    assert got == want and {line // 100 for line, *_ in got} == {0, 1, 2}


def test_the_document_has_all_members(spark, sf_dir):
    """One numbered line per element, so that no run is one value."""
    import json
    lines = entry.queries()["k03_analysis_document"](spark, sf_dir).collect()
    assert lines[0].asDict().keys() == {"run_id", "section", "position", "json"}
    assert lines == sorted(lines, key=lambda r: (r.run_id, r.section, r.position)) and len({r[:3] for r in lines}) == len(lines)
    own = {}
    for r in lines:
        own.setdefault(r.section, []).append(json.loads(r.json))
    assert {name.split(".")[0] for name in own} == {"metadata", "topology", "time_anchors", "statistics", "hardware_blueprint", "analysis", "chunks"}
    assert len(own["topology"]) == len(own["time_anchors"]) == len(own["analysis.per_rank"]) == 64 and len(own["metadata"]) == 1
    assert sum(c["n_events"] for c in own["chunks"]) == own["analysis.summary"][0]["total_events"]
    assert json.loads(own["hardware_blueprint"][0]["hardware_blueprint"])["cabinets"]


def test_the_document_values_are_all_its_fields(spark, sf_dir):
    """No section and no field is left out; real numbers, call counts and the metrics of findings are compared too."""
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for name in ("lineitem", "orders", "nation", "region"):
        db.execute(f"create view {name} as from read_parquet('{sf_dir}/{name}.parquet')")
    want = sorted(db.execute(entry.oracle_sql()["k03_document_values"]).fetchall(), key=str)
    got = sorted((tuple(r) for r in entry.queries()["k03_document_values"](spark, sf_dir).collect()), key=str)
    assert got == want
    said = {(section, field) for section, _, field, _ in got}
    assert {"hardware_blueprint", "analysis.time_windows", "analysis.top_ranks_by_out_bytes", "analysis.top_ranks_by_in_bytes"} <= {section for section, _ in said}
    assert {("analysis.top_links", "calls"), ("analysis.issues", "score"), ("analysis.issues", "metrics.top_ranks_by_touch"), ("chunks", "t_end"),
            ("analysis.summary", "pair_density"), ("time_anchors", "mpi_time_zero")} <= said
