"""Operators of the log engine on small fixtures with hand-derived results, and properties."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewright.config import CALIBRATED, Binning, Clustering, Decay, Params
from tracewright.functions import vectors as V
from tracewright.functions.calendar import with_calendar
from tracewright.operators import binning, clustering, context, encoding, scoring, similarity
from tracewright.operators.drift import Adwin
from tracewright.plans.repair import repaired, with_vector
from tracewright.sources import logs

T0 = datetime(2024, 1, 1, 9)


def log_of(spark, rows):
    """(event, case, activity, minutes, resource) rows as a log."""
    data = [(e, c, a, None if m is None else T0 + timedelta(minutes=m), r, 1.0, 1, 0.5) for e, c, a, m, r in rows]
    return spark.createDataFrame(data, "EventID string, CaseID string, Activity string, Timestamp timestamp, Resource string, ProcessingTime double, PriorityLevel int, FileSize double")


def values(spark, xs, kind="double"):
    return spark.createDataFrame([(i, x) for i, x in enumerate(xs)], f"i int, x {kind}")


def column(df, name):
    return [r[name] for r in df.orderBy("i").collect()]


def test_calendar(spark):
    rows = spark.createDataFrame([(i, datetime(2024, 3, day, h)) for i, (day, h) in enumerate([(1, 3), (7, 4), (8, 8), (29, 12), (30, 16), (31, 20)])], "i int, Timestamp timestamp")
    got = with_calendar(rows)
    assert column(got, "hour_bin") == ["Night", "Early_Morning", "Morning", "Afternoon", "Late_Afternoon", "Night"]
    assert column(got, "week_of_month") == [1, 1, 2, 5, 5, 5]
    assert column(got, "is_weekend") == [False, False, False, False, True, True]
    assert with_calendar(spark.createDataFrame([(0, None)], "i int, Timestamp timestamp")).first()["hour_bin"] is None


def test_context_of_one_case(spark):
    log = log_of(spark, [("1", "a", "A", 0, "u"), ("2", "a", "B", 1, "u"), ("3", "a", "C", 2, "u")])
    got = [(r["p1"], r["p2"], r["p3"]) for r in context.with_context(log).orderBy("EventID").collect()]
    assert got == [("UNKNOWN",) * 3, ("UNKNOWN", "UNKNOWN", "A"), ("UNKNOWN", "A", "B")]
    literal = [(r["p1"], r["p2"], r["p3"], r["Activity"]) for r in context.literal_context(log).orderBy("EventID", "pass").collect()]
    u = "UNKNOWN"
    assert literal == [(u, u, u, "A"), (u, u, "A", "A"), (u, "A", "A", "B"), ("A", "A", "B", "B"), ("A", "B", "B", "C"), ("B", "B", "C", "C")]


def test_sequence_breaks_ties_by_event(spark):
    log = log_of(spark, [("b", "1", "A", 5, "u"), ("a", "2", "A", 5, "u"), ("c", "3", "A", 0, "u"), ("d", "3", "A", 500, "u")])
    assert {r["EventID"]: r["seq"] for r in context.sequenced(log).collect()} == {"c": 1, "a": 2, "b": 3, "d": 4}


def test_rarity(spark):
    log = log_of(spark, [(str(i), "c", "A", i, "u") for i in range(3)])
    assert [r["rarity"] for r in scoring.resource_rarity(log).orderBy("EventID").collect()] == [1, 1 / 2, 1 / 3]
    assert [(r["rarity_1"], r["rarity_2"]) for r in scoring.resource_rarity_literal(log).orderBy("EventID").collect()] == [(1, 1 / 2), (1 / 3, 1 / 4), (1 / 5, 1 / 6)]


def test_weights_over_many_blocks_equal_the_recurrence(spark):
    log = log_of(spark, [(f"{i:04d}", "c", "A", i, f"u{i % 7}") for i in range(700)])
    got = [r["weight"] for r in scoring.ewma_weight(scoring.resource_rarity(log), "rarity", Decay(tau=2.0)).orderBy("EventID").collect()]
    d, w, want = math.exp(-1 / 2), 1.0, []
    for i in range(700):
        w = 1.0 if i == 0 else w * d + (1 / (i // 7 + 1)) * (1 - d)
        want.append(w)
    assert got == pytest.approx(want, abs=1e-9)


def test_literal_weights_over_many_blocks_equal_the_recurrence(spark):
    """Counters up to 900 times tau, whose exponential no double holds, and gaps of both signs."""
    log = log_of(spark, [(f"{i:04d}", "c", "AAB"[i % 3] if i < 300 else "AB"[i % 5 > 0], i, f"u{i % 7}") for i in range(1500)])
    got = [r["weight"] for r in scoring.ewma_weight_literal(scoring.resource_rarity(log), "rarity", Decay(tau=1.0)).orderBy("EventID").collect()]
    seen, uses, w, before, want = {}, {}, 1.0, 1, []
    for r in log.orderBy("EventID").collect():
        c = seen[r["Activity"]] = seen.get(r["Activity"], 0) + 1
        k = uses[r["Activity"], r["Resource"]] = uses.get((r["Activity"], r["Resource"]), 0) + 1
        d = math.exp(-(c - before))
        w, before = w * d + 1 / k * (1 - d), c
        want.append(w)
    assert max(seen.values()) > 750 and max(map(abs, want)) > 1e9
    assert got == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_codes(spark):
    log = context.sequenced(log_of(spark, [(str(i), "c", a, i, "u") for i, a in enumerate("MAMZ")]))
    got = encoding.with_arrival_code(log, "Activity", "code").orderBy("seq").collect()
    assert [r["code"] for r in got] == [0, 0, 1, 2]
    assert [r["code"] for r in encoding._folded(log, "Activity", "code").orderBy("seq").collect()] == [0, 0, 1, 2]


def test_codes_of_many_values(spark, monkeypatch):
    """An expression, a broadcast and a fold say the same, nulls and values that sort before earlier ones among them."""
    r = random.Random(8)
    rows = [(f"{i:04d}", "c", None if i % 17 == 0 else f"v{r.randrange(120):x}é", i, "u") for i in range(600)]
    log = context.sequenced(log_of(spark, rows))
    seen, want = [], {}
    import bisect

    for i, (_, _, a, _, _) in enumerate(rows):
        if a is None:
            want[i + 1] = -1
            continue
        if a not in seen:
            bisect.insort(seen, a)
        want[i + 1] = seen.index(a)
    for low, most in ((1000, 10**6), (0, 10**6), (0, 0)):
        monkeypatch.setattr(encoding, "LOW_CARDINALITY", low)
        monkeypatch.setattr(encoding, "BROADCAST_VALUES", most)
        assert {x["seq"]: x["code"] for x in encoding.with_arrival_code(log, "Activity", "code").collect()} == want


def test_bins(spark):
    df = values(spark, [0.025, 0.1, 0.125, 0.475, 0.99, 1.0, -5.0, None])
    e = binning.uniform_edges(0.0, 1.0)
    assert column(df.withColumn("b", binning.literal_bin(F.col("x"), e)), "b") == [0, 2, 2, 10, 20, 19, 19, 0]
    assert column(df.withColumn("b", binning.bin_of(F.col("x"), e)), "b") == [0, 2, 2, 9, 19, 19, 0, 0]
    edges = spark.createDataFrame([(0, [0.0, 0.2, 0.6, 0.9, 1.2])], "i int, e array<double>")
    assert edges.select(binning.min_width_edges("e", 0.5).alias("k")).first()["k"] == [0.0, 0.6, 1.2]


def test_minmax_and_zscore(spark):
    df = values(spark, [[2.0, 4.0, 6.0], [3.0, 3.0], []], "array<double>")
    assert column(df.withColumn("m", V.minmax("x")), "m") == [[0, 0.5, 1], [0, 0], []]
    z = df.where("i < 2").withColumn("z", V.zscore("x"))
    assert column(z, "z")[0] == pytest.approx([-math.sqrt(1.5), 0, math.sqrt(1.5)]) and column(z, "z")[1] == [0, 0]


def test_zscore_of_long_vectors(spark):
    """Work in proportion to the length: 4,000 slots by their cube would take hours."""
    x = np.random.default_rng(3).normal(5, 2, 4000)
    out = values(spark, [x.tolist(), [1.0, None, 3.0], None], "array<double>").withColumn("z", V.zscore("x"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 2
    z = column(out, "z")
    assert z[0] == pytest.approx(((x - x.mean()) / x.std()).tolist(), abs=1e-9) and z[1] == [0, 0, 0] and z[2] is None


def test_similarity_values(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0, 0.0], [0.0, 1.0, 1.0]), (1, [1.0, 0.0], [0.0, 1.0, 1.0]), (2, [0.3, 1.0, 0.0], [0.3, 1.0, 0.0])], "i int, a array<double>, b array<double>")
    assert column(df.withColumn("s", V.similarity("a", "b", 0.15)), "s") == pytest.approx([0.2, 0.0, 1.0])
    assert column(df.withColumn("s", V.similarity("a", "b", 0.15, "diagonal")), "s") == pytest.approx([0, 0, 1])


def test_variance_weights(spark):
    df = spark.createDataFrame([("g", 0, [0.0, 0.0]), ("g", 1, [0.0, 1.0])], "g string, k int, vector array<double>")
    assert similarity.variance_weights(df, "g").first()["weights"] == pytest.approx([1 / 11, 10 / 11])


def test_top_features(spark):
    df = spark.range(1)
    for spread, n in ((9.9, 0), (10.0, 1), (40.0, 1)):
        s = {"a": F.lit(-spread), "b": F.lit(spread)}
        got = df.select(scoring.top_features(s).alias("t")).first()["t"]
        assert got == ["b"][:n]


def test_numeric_cells(spark):
    df = values(spark, ["nan", "", " M ", "null", None, "1.5 ", "x", "NaN", "-3"], "string")
    assert column(df.withColumn("v", V.numeric_cell(F.col("x"))), "v") == [None, None, None, None, None, 1.5, None, None, -3.0]


def test_csv_round_trip_and_quarantine(spark, tmp_path):
    made = logs.generated(spark, 20).drop("true_label").withColumn("Timestamp", F.date_format("Timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    bad = made.limit(2).withColumns({"Timestamp": F.lit("yesterday"), "EventID": F.concat(F.lit("bad"), "EventID")})
    logs.write_csv(made.unionByName(bad), str(tmp_path / "log"))
    log = logs.read_csv(spark, str(tmp_path / "log"))
    assert log.count() == 140 and dict(log.dtypes)["Timestamp"] == "timestamp"
    raw = logs.raw_csv(spark, str(tmp_path / "log"))
    assert logs.quarantine(raw.withColumn("Timestamp", logs.parsed_time(F.col("Timestamp")))).count() == 2
    out = repaired(log)
    assert out.where("refined_activity is null").count() == 0
    logs.write_csv(out, str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert back.columns == out.columns and back.count() == 140


def test_literal_mode_changes_nothing(spark):
    out = repaired(logs.generated(spark, 10), Params(mode="literal")).collect()
    assert all(r["refined_activity"] == r["Activity"] and r["cluster_id"] == 0 and r["verdict"] == "merge" for r in out)
    c = clustering.Clusters(Params(mode="literal"))
    assert {c.add([0.0, 1.0, r / 9], "x")[0:4:3] for r in range(9)} == {(0, "merge")}


def test_repair_finds_the_two_meanings(spark):
    """In the generated log a label's later occurrences take other processing times than its first."""
    out = repaired(logs.generated(spark, 150), Params(vector_features="numeric", scaling="per_feature", clustering=CALIBRATED)).where("Activity = 'Submit'")
    table = {}
    for r in out.collect():
        table.setdefault(r["refined_activity"], []).append(r["true_label"] == "Submit_1")
    n = sum(map(len, table.values()))
    right = sum(max(sum(x), len(x) - sum(x)) for x in table.values())
    assert len(table) > 1 and right / n > 0.9


def test_edges_without_a_case(spark):
    log = context.sequenced(log_of(spark, [("1", "a", "A", 0, "u"), ("2", "a", "B", 1, "u"), ("3", "b", "A", 2, "u")]))
    rest = context.without_cases(context.edges(log), log, log.where("CaseID = 'a'").select("CaseID").distinct()).collect()
    assert [(r["Activity"], r["n"]) for r in rest] == [("A", 1)]


def test_adaptive_bins_fold():
    bins = binning.AdaptiveBins(Binning(window=200))
    r = random.Random(1)
    hits = [bins.update(r.gauss(0.5 if i < 600 else 5.0, 0.1))[1] for i in range(1200)]
    assert not any(hits[:600]) and any(hits[600:]) and bins.edges[-1] > 1
    assert bins.update(None) == (0, False) and bins.update(math.nan) == (0, False)
    n = len(bins.edges)
    counts = dict(bins.counts)
    bins.merge_sparse()
    assert len(bins.edges) <= n and sum(bins.counts.values()) == sum(counts.values())


def test_split_bin():
    """The median of the fullest bin becomes an edge, counts are halved, and the next split waits."""
    bins = binning.AdaptiveBins(Binning(window=400, split_cooldown=50))
    r = random.Random(3)
    for _ in range(300):
        bins.update(r.uniform(0.5, 0.55))
    b = max(bins.counts, key=bins.counts.get)
    n, edges = bins.counts[b], list(bins.edges)
    assert bins.split(b) and len(bins.edges) == len(edges) + 1
    assert bins.edges[b + 1] == pytest.approx(np.median([v for v in bins.window if edges[b] <= v < edges[b + 1]]))
    assert bins.counts[b] + bins.counts[b + 1] == n and abs(bins.counts[b] - bins.counts[b + 1]) <= 1
    assert not bins.split(b)
    for _ in range(50):
        bins.update(0.52)
    assert bins.split(max(bins.counts, key=bins.counts.get))


def folded_by_hand(rows, begin, step):
    state, out = {}, {}
    for key, seq, value in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        if key not in state:
            state[key] = begin()
        out[key, seq] = step(state[key], value)
    return out


def test_folds_take_several_batches(spark):
    """Batches of 64 rows: state goes on from one to the next, and begins anew with each key, a null among them."""
    from tracewright.operators.folds import fold

    r = random.Random(7)
    rows = [(k, i, float(r.randrange(100))) for i, k in enumerate(r.choices(["a", "b", None, "c"], weights=[500, 60, 30, 1], k=700))]
    df = spark.createDataFrame(rows, "k string, seq long, v double").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        def step(state, pdf):
            out = []
            for v in pdf["v"]:
                state.append(v)
                out.append(sum(state))
            return pdf[["k", "seq"]].assign(total=out)

        got = {(x["k"], x["seq"]): x["total"] for x in fold(df, "k", "seq", lambda _: [], step, "k string, seq long, total double").collect()}

        def add(state, v):
            state.append(v)
            return sum(state)

        assert got == folded_by_hand(rows, list, add)
        log = context.sequenced(logs.generated(spark, 40))
        vectors = with_vector(with_calendar(log)).select("seq", "Activity", "vector")
        labels = {x["seq"]: (x["cluster_id"], x["refined_activity"], x["step"]) for x in clustering.refine(vectors).collect()}
        states = {}
        for x in vectors.orderBy("seq").collect():
            got = states.setdefault(x["Activity"], clustering.Clusters()).add(x["vector"], x["Activity"])
            assert labels[x["seq"]] == (got[0], got[4], got[6])
        binned = {(x["feature"], x["seq"]): (x["bin"], x["drifted"]) for x in binning.adaptive_bins(log, ("ProcessingTime", "FileSize")).collect()}
        for c in ("ProcessingTime", "FileSize"):
            bins = binning.AdaptiveBins()
            assert all(binned[c, x["seq"]] == bins.update(float(x[c])) for x in log.orderBy("seq").collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_bins_on_the_log_and_edges(spark):
    log = context.sequenced(logs.generated(spark, 120))
    wide = binning.with_bins(log, ("ProcessingTime", "FileSize"))
    assert wide.columns == [*log.columns, "ProcessingTime_bin", "FileSize_bin"] and wide.count() == log.count()
    long = {(x["feature"], x["seq"]): x["bin"] for x in binning.adaptive_bins(log, ("ProcessingTime", "FileSize")).collect()}
    assert all(long["ProcessingTime", x["seq"]] == x["ProcessingTime_bin"] and long["FileSize", x["seq"]] == x["FileSize_bin"] for x in wide.collect())
    edges = {}
    for x in binning.maintained_edges(log, ("ProcessingTime",), Binning(split_cooldown=100)).orderBy("pos").collect():
        edges.setdefault(x["feature"], []).append(x["edge"])
    assert edges["ProcessingTime"] == sorted(edges["ProcessingTime"]) and len(edges["ProcessingTime"]) >= 2


def test_drift_weights(spark):
    from tracewright.operators import drift

    r = random.Random(5)
    xs = [r.random() + 3 * (i > 300) for i in range(700)]
    got = drift.drift_weights(spark.createDataFrame([("f", i, x) for i, x in enumerate(xs)], "feature string, seq long, value double")).orderBy("seq").collect()
    detector, w, changes = Adwin(0.02), 1.0, 0
    for x, row in zip(xs, got):
        hit = detector.update(x)
        w = min(2.0, w * 1.1) if hit else max(0.5, w * 0.9)
        changes += hit
        assert row["changed"] == hit and row["weight"] == pytest.approx(w)
    assert changes


def test_similar_groups(spark):
    sim = [[1, .9, .85, .1, .3], [.9, 1, .1, .2, .3], [.85, .1, 1, .2, .3], [.1, .2, .2, 1, .95], [.3, .3, .3, .95, 1]]
    rows = [("g", i, j, float(sim[i][j])) for i in range(5) for j in range(i, 5)]
    got = similarity.similar_groups(spark.createDataFrame(rows, "grp string, i long, j long, sim double"), "grp")
    assert {(x["number"], x["member"]) for x in got.collect()} == {(0, 0), (0, 1), (1, 3), (1, 4)}


def test_pairs_of_a_large_group_meet_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 8)
    df = spark.createDataFrame([("g" if i < 30 else "h", i, [float(i)]) for i in range(33)], "grp string, k long, vector array<double>")
    got = sorted((x["grp"], x["i"], x["j"]) for x in similarity.pairs(df, "grp", "k").collect())
    assert got == sorted([("g", i, j) for i in range(30) for j in range(i, 30)] + [("h", i, j) for i in range(30, 33) for j in range(i, 33)])


def test_two_level_numbers_and_ranks(spark):
    rows = [(f"{i:04d}", "c", None if i % 5 == 0 else "AB"[i % 2], (i * 37) % 400, "u") for i in range(300)]
    log = log_of(spark, rows)
    got = {x["EventID"]: x["k"] for x in context.numbered(log, ["Activity"], "k").collect()}
    count = {}
    for e, _, a, m, _ in sorted(rows, key=lambda r: (r[3], r[0])):
        count[a] = count.get(a, 0) + 1
        assert got[e] == count[a]
    values_ = [f"v{(i * 7919) % 1000:03d}" for i in range(1000)]
    ranks = {x["value"]: x["code"] for x in context.ranked(spark.createDataFrame([(v,) for v in set(values_)], "value string"), "value", "code").collect()}
    assert ranks == {v: i for i, v in enumerate(sorted(set(values_)))}


def test_missing_label_is_an_error(spark):
    log = log_of(spark, [("1", "a", "A", 0, "u"), ("2", "a", None, 1, "u")])
    assert logs.with_label(log.where("EventID = '1'")).count() == 1
    with pytest.raises(Exception, match="no activity label in event 2"):
        logs.with_label(log).collect()


def test_written_columns_and_times(spark, tmp_path):
    from tracewright.plans.repair import output, output_columns

    log = logs.generated(spark, 5).drop("true_label")
    out = output(repaired(log), log)
    assert out.columns == output_columns(log) and len(out.columns) == 18 and out.columns[-1] == "refined_activity"
    logs.write_csv(out, str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert back.columns == out.columns and {len(x["Timestamp"]) for x in back.collect()} <= {19, 26}


def test_sinks_go_on_after_a_restart(spark, tmp_path):
    """Two runs over a growing source and one checkpoint write what one run over all of it would, in CSV and JSON."""
    from tracewright.streaming import sinks, topology

    log = logs.generated(spark, 30).drop("true_label")
    rows = with_vector(log)
    middle = rows.approxQuantile("ProcessingTime", [0.5], 0)[0]
    end = rows.orderBy(F.desc("Timestamp")).limit(1).withColumns({"EventID": F.lit("end"), "CaseID": F.lit("end"), "Activity": F.lit("end"), "Timestamp": F.expr("Timestamp + interval 9 days")})
    half = rows.orderBy("Timestamp").limit(rows.count() // 2)
    assert middle is not None

    def run():
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        sinks.save_refined(topology.refined_stream(topology.arrivals(stream, "40 days")), str(tmp_path / "rows"), str(tmp_path / "audit"), str(tmp_path / "c")).awaitTermination()

    half.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    rest = rows.join(half.select("EventID"), "EventID", "left_anti").select(*rows.columns)
    rest.unionByName(end.withColumn("Timestamp", F.expr("Timestamp + interval 60 days"))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    got = spark.read.option("header", True).option("recursiveFileLookup", True).csv(str(tmp_path / "rows")).collect()
    batch = clustering.refine(context.sequenced(rows).select("seq", "Activity", "vector"))
    ids = context.sequenced(log).select("seq", "EventID")
    want = {(r["EventID"], str(r["cluster_id"]), r["refined_activity"]) for r in batch.join(ids, "seq").collect()}
    assert len(got) == len(want) and {(r["EventID"], r["cluster_id"], r["refined_activity"]) for r in got} == want
    trail = spark.read.option("recursiveFileLookup", True).json(str(tmp_path / "audit"))
    assert trail.count() and {r["action"] for r in trail.select("action").distinct().collect()} <= {"cluster_create", "split_decision", "merge_decision"}


def test_adwin_on_a_steady_stream():
    r = random.Random(2)
    steady = Adwin(0.002)
    assert sum(steady.update(r.random()) for _ in range(5000)) <= 1
    moved = Adwin(0.002)
    assert any([moved.update(r.random() + (i > 1000)) for i in range(2000)][1001:])


vector = st.lists(st.floats(0, 1, allow_nan=False), min_size=2, max_size=6)


@settings(deadline=None)
@given(st.integers(2, 6).flatmap(lambda n: st.tuples(*[st.lists(st.floats(0, 1), min_size=n, max_size=n)] * 2)), st.sampled_from(["reference", "pairs", "diagonal"]))
def test_similarity_properties(ab, normaliser):
    a, b = map(np.array, ab)
    x, y = clustering.similarities(a[None], b, 0.15, normaliser)[0], clustering.similarities(b[None], a, 0.15, normaliser)[0]
    assert 0 <= x <= 1 and x == pytest.approx(y)


@settings(deadline=None)
@given(st.lists(st.integers(0, 1), min_size=2, max_size=7), st.lists(st.integers(0, 1), min_size=2, max_size=7))
def test_reference_similarity_has_a_lower_bound(a, b):
    n = min(len(a), len(b))
    a, b = np.array(a[:n], float), np.array(b[:n], float)
    s = clustering.similarities(a[None], b, 0.15, "reference")[0]
    if set(a) == set(b) == {0.0, 1.0}:
        assert s >= min(1, 0.3 * (n - 1) / n) - 1e-9


@settings(deadline=None)
@given(st.lists(st.text("abc", max_size=2), max_size=30))
def test_arrival_code_is_below_the_number_of_values(xs):
    import bisect

    seen = []
    for x in xs:
        if x not in seen:
            bisect.insort(seen, x)
        assert seen.index(x) < len(set(xs))


def test_stream_equals_batch(spark, tmp_path):
    from tracewright.streaming import topology

    log = logs.generated(spark, 60).drop("true_label")
    end = log.orderBy(F.desc("Timestamp")).limit(1).withColumns({"EventID": F.lit("end"), "CaseID": F.lit("end"), "Activity": F.lit("end"), "Timestamp": F.expr("Timestamp + interval 9 days")})
    params = Params()
    rows = with_vector(log, params).unionByName(with_vector(log, params).where("false").unionByName(end.withColumn("vector", F.array(F.lit(0.0))), allowMissingColumns=True))
    rows.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    topology.drained(topology.context_stream(topology.arrivals(stream())), str(tmp_path / "c"), str(tmp_path / "cc"))
    got = {(r["EventID"], r["p1"], r["p2"], r["p3"]) for r in spark.read.parquet(str(tmp_path / "c")).collect()}
    assert got == {(r["EventID"], r["p1"], r["p2"], r["p3"]) for r in context.with_context(log).collect()}
    topology.drained(topology.refined_stream(topology.arrivals(stream()), params), str(tmp_path / "r"), str(tmp_path / "rc"))
    got = {(r["EventID"], r["cluster_id"], r["refined_activity"]) for r in spark.read.parquet(str(tmp_path / "r")).collect()}
    batch = clustering.refine(context.sequenced(with_vector(log, params)).select("seq", "Activity", "vector", "EventID").drop("EventID"), params)
    ids = context.sequenced(log).select("seq", "EventID")
    assert got == {(r["EventID"], r["cluster_id"], r["refined_activity"]) for r in batch.join(ids, "seq").collect()}


def test_thresholds(spark):
    split, merge = similarity.adjusted_thresholds(F.col("x"), 0.15, 0.8)
    rows = values(spark, [0.1, 0.3]).select("i", split.alias("s"), merge.alias("m"))
    assert column(rows, "s") == pytest.approx([0.6, 0.2]) and column(rows, "m") == pytest.approx([0.85, 0.75])
    assert Clustering().normaliser == "diagonal"
