"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tracewright.plans.oracles import ORACLE
from tracewright.plans.queries import QUERIES

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return c


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    want = duck.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(want.fetchall(), want.columns)


def rows_of(spark, name):
    return [r.asDict() for r in QUERIES[name](spark, DIR).collect()]


def events(duck):
    return duck.sql("SELECT count(*) FROM events").fetchall()[0][0]


def test_refined_rows_agree_with_each_other(spark, duck):
    """Every event once; the trail follows from the refined rows."""
    refined = rows_of(spark, "refined_labels")
    assert len({r["EventID"] for r in refined}) == len(refined) == events(duck)
    for r in refined:
        assert r["refined_activity"] == r["Activity"] or r["refined_activity"].startswith(r["Activity"] + "_") and r["n_active"] > 1
        assert r["best_sim"] is None or 0 <= r["best_sim"] <= 1
        assert r["verdict"] in ("split", "merge", "no_change")
    made = sum(r["best_sim"] is None or r["best_sim"] < 0.15 for r in refined)
    asked = sum(not (r["best_sim"] is None or r["best_sim"] < 0.15) and r["verdict"] != "no_change" for r in refined)
    trail = rows_of(spark, "audit_log")
    assert sum(r["action"] == "cluster_create" for r in trail) == made and sum(r["action"].endswith("_decision") for r in trail) == asked
    assert len({r["refined_activity"] for r in rows_of(spark, "refined_labels_numeric")}) > 5


def test_bins_and_drifts_agree_with_each_other(spark, duck):
    n = events(duck)
    assert {r["feature"]: 0 for r in rows_of(spark, "adaptive_bins")}.keys() == {"ProcessingTime", "PriorityLevel", "FileSize"}
    assert sum(r["n"] for r in rows_of(spark, "adaptive_bins")) == 3 * n
    wide = rows_of(spark, "binned_log")
    assert len(wide) == n
    for r in rows_of(spark, "adaptive_bins"):
        assert r["n"] == sum(x[f"{r['feature']}_bin"] == r["bin"] for x in wide)
    drifts = {(r["feature"], r["seq"]) for r in rows_of(spark, "adwin_drift")}
    weights = rows_of(spark, "drift_weights")
    assert len(weights) == 3 * n and {(r["feature"], r["seq"]) for r in weights if r["changed"]} == drifts
    assert all(0.5 <= r["weight"] <= 2.0 for r in weights)
    edges = rows_of(spark, "maintained_edges")
    for f in {r["feature"] for r in edges}:
        own = [r["edge"] for r in sorted(edges, key=lambda r: r["pos"]) if r["feature"] == f]
        assert own == sorted(set(own)) and len(own) >= 2


def test_similar_groups_are_alike(spark):
    from tracewright.plans.queries import SHARP

    sim = {(r["i"], r["j"]): r["sim"] for r in rows_of(spark, "similarity_matrix")}
    assert sim
    groups = {}
    for r in rows_of(spark, "similar_groups"):
        groups.setdefault((r["grp"], r["number"]), []).append(r["member"])
    assert groups and all(len(m) == len(set(m)) > 1 for m in groups.values())
    members = [m for g in groups.values() for m in g]
    assert len(members) == len(set(members)) and SHARP.analysis_split < SHARP.analysis_merge


def test_generated_log(spark):
    rows = rows_of(spark, "generated_log")
    cases = {}
    for r in sorted(rows, key=lambda r: int(r["EventID"][2:])):
        cases.setdefault(r["CaseID"], []).append(r)
    assert len(rows) == 1400 and len(cases) == 200
    from tracewright.sources.logs import VARIANTS

    for events_ in cases.values():
        assert tuple(r["Activity"] for r in events_) in VARIANTS
        gaps = [(b["Timestamp"] - a["Timestamp"]).total_seconds() / 60 for a, b in zip(events_, events_[1:])]
        assert all(1 <= g <= 120 for g in gaps)
        assert all(1 <= r["ProcessingTime"] <= 120 and 1 <= r["PriorityLevel"] <= 5 and 0.1 <= r["FileSize"] <= 10 for r in events_)


def test_every_query_is_compared_or_checked():
    checked = {"refined_labels", "audit_log", "adaptive_bins", "binned_log", "adwin_drift", "drift_weights", "maintained_edges", "similar_groups", "generated_log"}
    assert set(QUERIES) == set(ORACLE) | checked


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(ORACLE) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
