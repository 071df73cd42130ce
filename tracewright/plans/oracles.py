"""DuckDB SQL that says the same as the registered queries, written on its own."""

from __future__ import annotations

_LOG = """log AS (SELECT event_id AS EventID, user_id AS CaseID, event_type AS Activity, CAST(ts AS TIMESTAMP) AS Timestamp, k AS Resource, value AS ProcessingTime, k % 5 + 1 AS PriorityLevel, value / 50 AS FileSize
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""
_CAL = """cal AS (SELECT *, CASE WHEN hour(Timestamp) BETWEEN 4 AND 7 THEN 'Early_Morning' WHEN hour(Timestamp) BETWEEN 8 AND 11 THEN 'Morning' WHEN hour(Timestamp) BETWEEN 12 AND 15 THEN 'Afternoon'
        WHEN hour(Timestamp) BETWEEN 16 AND 19 THEN 'Late_Afternoon' ELSE 'Night' END AS hour_bin,
    isodow(Timestamp) - 1 AS day_of_week, isodow(Timestamp) >= 6 AS is_weekend, (day(Timestamp) - 1) // 7 + 1 AS week_of_month,
    CASE WHEN month(Timestamp) IN (12, 1, 2) THEN 'Winter' WHEN month(Timestamp) <= 5 THEN 'Spring' WHEN month(Timestamp) <= 8 THEN 'Summer' ELSE 'Fall' END AS season, month(Timestamp) AS month FROM log)"""
_SEQ = "seq AS (SELECT *, row_number() OVER (ORDER BY Timestamp, EventID) AS seq FROM log)"
_CTX = """ctx AS (SELECT *, coalesce(lag(Activity, 3) OVER w, 'UNKNOWN') AS p1, coalesce(lag(Activity, 2) OVER w, 'UNKNOWN') AS p2, coalesce(lag(Activity, 1) OVER w, 'UNKNOWN') AS p3
    FROM seq WINDOW w AS (PARTITION BY CaseID ORDER BY Timestamp, EventID))"""
_STATS = "SELECT count(*) AS n_events, count(DISTINCT EventID) AS n_event_ids, count(DISTINCT Activity) AS n_activities, count(DISTINCT CaseID) AS n_cases"
_RARE = "rare AS (SELECT *, 1.0::DOUBLE / row_number() OVER (PARTITION BY Activity, Resource ORDER BY Timestamp, EventID) AS rarity FROM log)"
_VEC = "vec AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(label AS BIGINT) AS label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_FEW = """few AS (SELECT vec_id, vec_id // 6 AS grp, list_transform(s, lambda x: CASE WHEN list_max(s) > list_min(s) THEN (x - list_min(s)) / (list_max(s) - list_min(s)) ELSE 0 END) AS v
    FROM (SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(embedding AS DOUBLE[]) AS s FROM embeddings))"""
_SLOTS = "slots AS (SELECT grp, vec_id, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS p FROM few)"


def _arrival(column: str) -> str:
    """Rank of an event's value, as text, among the values seen until then."""
    return f"(SELECT count(*) FROM (SELECT CAST({column} AS VARCHAR) AS v, min(seq) AS f FROM scal GROUP BY 1) q WHERE q.f <= s.seq AND q.v < CAST(s.{column} AS VARCHAR))"


_SCAL = "scal AS (SELECT c.*, s.seq FROM cal c JOIN seq s USING (EventID))"


_COLUMNS = ["EventID", "CaseID", "Activity", "Timestamp", "Resource", "ProcessingTime", "PriorityLevel", "FileSize", "hour_bin", "day_of_week", "is_weekend", "week_of_month", "season", "month"]
_W = ["resource", "hour_bin", "day_of_week", "month", "is_weekend"]
#: The recurrence of the five weights, event by event of an activity, and the scores that the weights before an event make.
_SCORES = f"""{_LOG}, {_CAL}, {_SEQ}, {_SCAL}, {_RARE},
        x AS (SELECT s.EventID, s.Activity, rarity AS s_resource, {_arrival('hour_bin')}::DOUBLE AS s_hour_bin, {_arrival('day_of_week')}::DOUBLE AS s_day_of_week, {_arrival('month')}::DOUBLE AS s_month,
            CAST(is_weekend AS INT)::DOUBLE AS s_is_weekend, row_number() OVER (PARTITION BY s.Activity ORDER BY s.seq) AS c FROM scal s JOIN rare USING (EventID)),
        f AS (SELECT EventID, Activity, c, {", ".join(f"1.0::DOUBLE AS w_{k}, 1.0::DOUBLE AS b_{k}" for k in _W)} FROM x WHERE c = 1
            UNION ALL SELECT x.EventID, x.Activity, x.c, {", ".join(f"f.w_{k} * exp(-1 / 200.0) + x.s_{k} * (1 - exp(-1 / 200.0)), f.w_{k}" for k in _W)} FROM f JOIN x ON x.Activity = f.Activity AND x.c = f.c + 1),
        made AS (SELECT EventID, b_resource * s_resource AS rs, {" + ".join(f"b_{k} * s_{k}" for k in _W[1:])} AS ts FROM f JOIN x USING (EventID)),
        judged AS (SELECT *, least(greatest(sqrt(greatest((rs * rs + ts * ts) / 5 - power((rs + ts) / 5, 2), 0)) / 10, 0.1), 1.5) AS threshold FROM made)"""


#: Clusters by recursion: each step takes an activity's next event, and a list of its clusters as the state.
_SIM = "least(greatest((greatest(1 - (m.c[1] - v[1]) * (m.c[1] - v[1]), 0) + greatest(1 - (m.c[2] - v[2]) * (m.c[2] - v[2]), 0) + greatest(1 - (m.c[3] - v[3]) * (m.c[3] - v[3]), 0)) / 3, 0), 1)"
_MOVED = "[m.c[1] + (v[1] - m.c[1]) / (m.w + 1), m.c[2] + (v[2] - m.c[2]) / (m.w + 1), m.c[3] + (v[3] - m.c[3]) / (m.w + 1)]"
_CLUSTERS = f"""{_LOG}, bounds AS (SELECT min(ProcessingTime) AS l1, max(ProcessingTime) AS h1, min(PriorityLevel)::DOUBLE AS l2, max(PriorityLevel)::DOUBLE AS h2, min(FileSize) AS l3, max(FileSize) AS h3 FROM log),
        x AS (SELECT EventID, Activity, [(ProcessingTime - l1) / (h1 - l1), (PriorityLevel::DOUBLE - l2) / (h2 - l2), (FileSize - l3) / (h3 - l3)] AS v,
            row_number() OVER (PARTITION BY Activity ORDER BY Timestamp, EventID) AS k FROM log, bounds),
        f AS (SELECT EventID, Activity, k, 0::BIGINT AS chosen, NULL::DOUBLE AS best, 1::BIGINT AS next, [{{'id': 0::BIGINT, 'c': v, 'w': 1.0::DOUBLE, 'last': k}}] AS st, [0::BIGINT] AS seen FROM x WHERE k = 1
            UNION ALL SELECT EventID, Activity, k, chosen, best, next,
                CASE WHEN made THEN list_append(st, {{'id': chosen, 'c': v, 'w': 1.0::DOUBLE, 'last': k}})
                     ELSE list_transform(st, lambda m: CASE WHEN m.id <> chosen THEN m ELSE {{'id': m.id, 'c': CASE WHEN best > 0.85 THEN {_MOVED} ELSE m.c END, 'w': CASE WHEN best > 0.85 THEN m.w + 1 ELSE m.w END, 'last': k}} END) END AS st,
                CASE WHEN list_contains(seen, chosen) THEN seen ELSE list_append(seen, chosen) END AS seen
            FROM (SELECT *, CASE WHEN made THEN old ELSE -top.n END AS chosen, top.s AS best, CASE WHEN made THEN old + 1 ELSE old END AS next
                FROM (SELECT *, top IS NULL OR top.s < 0.82 AS made
                    FROM (SELECT *, list_max(list_transform(st, lambda m: {{'s': {_SIM}, 'n': -m.id}})) AS top
                        FROM (SELECT x.EventID, x.Activity, x.k, x.v, f.next AS old, f.seen,
                                list_filter(list_transform(f.st, lambda m: {{'id': m.id, 'c': m.c, 'w': m.w * exp(-1 / 200.0), 'last': m.last}}), lambda m: NOT (m.w < 1e-4 AND x.k - m.last > 400)) AS st
                            FROM f JOIN x ON x.Activity = f.Activity AND x.k = f.k + 1))))),
        refined AS (SELECT EventID, Activity, k, chosen AS cluster_id, best, len(list_filter(st, lambda m: m.w > 0.01)) AS n_active, list_filter(st, lambda m: m.id = chosen)[1].w AS weight, list_position(seen, chosen) AS ordinal FROM f)"""
_REFINED = "round(best, 6) AS best_sim, CAST(n_active AS BIGINT) AS n_active, CASE WHEN n_active <= 1 THEN Activity ELSE Activity || '_' || ordinal END AS refined_activity"


def _matrix(alpha: float) -> str:
    """Weighted similarity of pairs of a group."""
    other = f"a.grp = b.grp AND a.vec_id <= b.vec_id" + ("" if alpha else " AND a.p = b.p")
    return f"""var AS (SELECT grp, p, var_pop(x) AS v FROM slots GROUP BY grp, p),
        raised AS (SELECT grp, p, greatest(CASE WHEN sum(v) OVER (PARTITION BY grp) > 0 THEN v / sum(v) OVER (PARTITION BY grp) ELSE 1 END, 0.1) AS w FROM var),
        wt AS (SELECT grp, p, w / sum(w) OVER (PARTITION BY grp) AS w FROM raised),
        sims AS (SELECT a.grp, a.vec_id AS i, b.vec_id AS j,
            least(greatest(sum(greatest(1 - (a.x - b.x) * (a.x - b.x), 0) * CASE WHEN a.p = b.p THEN 1 ELSE {alpha} END * (wa.w + wb.w) / 2), 0), 1) AS sim
            FROM slots a JOIN slots b ON {other} JOIN wt wa ON wa.grp = a.grp AND wa.p = a.p JOIN wt wb ON wb.grp = b.grp AND wb.p = b.p GROUP BY 1, 2, 3)"""


#: The same thresholds as the registered queries'.
_SPLIT, _MERGE = 0.86, 0.93

_BIN = "CAST(least(greatest(floor({x}), 0), 19) AS BIGINT)"

ORACLE: dict[str, str] = {
    "log_stats": f"WITH {_LOG} {_STATS} FROM log",
    "lineitem_log_stats": """SELECT count(*) AS n_events, count(DISTINCT l_orderkey * 10 + l_linenumber) AS n_event_ids, count(DISTINCT l_returnflag || l_linestatus) AS n_activities, count(DISTINCT l_orderkey) AS n_cases FROM lineitem""",
    "activity_counts": "SELECT event_type AS Activity, count(*) AS n FROM events GROUP BY 1",
    "valid_timestamps": "SELECT event_id AS EventID, event_id % 10 <= 5 AS is_valid, event_id % 10 IN (6, 7) AS parsed, event_id % 10 = 6 AS parsed_literal FROM events",
    "calendar_features": f"WITH {_LOG}, {_CAL} SELECT EventID, hour_bin, day_of_week, is_weekend, week_of_month, season, month FROM cal",
    "hour_bin_counts": f"WITH {_LOG}, {_CAL} SELECT Activity, hour_bin, count(*) AS n FROM cal GROUP BY 1, 2",
    "season_weekend_matrix": f"WITH {_LOG}, {_CAL} SELECT season, count(*) FILTER (NOT is_weekend) AS weekday_events, count(*) FILTER (is_weekend) AS weekend_events FROM cal GROUP BY 1",
    "dedup_events": f"WITH {_LOG} SELECT EventID, CaseID, Activity, round(ProcessingTime, 6) AS ProcessingTime FROM log",
    "numeric_cells": f"WITH {_LOG} SELECT EventID, CASE WHEN EventID % 7 < 5 THEN 0 ELSE PriorityLevel + 0.5 END::DOUBLE AS value FROM log",
    "event_sequence": f"WITH {_LOG}, {_SEQ} SELECT EventID, seq FROM seq",
    "prev_activity_context": f"WITH {_LOG}, {_SEQ}, {_CTX} SELECT EventID, p1, p2, p3 FROM ctx",
    "prev_activity_literal_context": f"""WITH {_LOG}, twice AS (SELECT l.*, t.pass FROM log l, (VALUES (1::BIGINT), (2::BIGINT)) t(pass))
        SELECT EventID, pass, coalesce(lag(Activity, 3) OVER w, 'UNKNOWN') AS p1, coalesce(lag(Activity, 2) OVER w, 'UNKNOWN') AS p2, coalesce(lag(Activity, 1) OVER w, 'UNKNOWN') AS p3
        FROM twice WINDOW w AS (PARTITION BY CaseID ORDER BY Timestamp, EventID, pass)""",
    "dfg_edges": f"WITH {_LOG}, {_SEQ}, {_CTX} SELECT p1, p2, p3, Activity, count(*) AS n, max(seq) AS last_seq FROM ctx GROUP BY 1, 2, 3, 4",
    "dfg_pair_frequency": f"WITH {_LOG}, {_SEQ}, {_CTX} SELECT p3 AS prev, Activity, count(*) AS n FROM ctx GROUP BY 1, 2",
    "dfg_without_cases": f"WITH {_LOG}, {_SEQ}, {_CTX} SELECT p1, p2, p3, Activity, count(*) AS n FROM ctx WHERE CaseID % 10 <> 0 GROUP BY 1, 2, 3, 4",
    "case_paths": f"WITH {_LOG} SELECT CaseID, string_agg(Activity, '>' ORDER BY Timestamp, EventID) AS path, count(*) AS n FROM log GROUP BY 1",
    "dfg_decayed": f"""WITH {_LOG}, {_SEQ}, {_CTX}, m AS (SELECT max(seq) AS e FROM seq),
        w AS (SELECT p1, p2, p3, Activity, sum(CASE WHEN seq >= e // 200 * 200 THEN 1 ELSE exp((seq - e // 200 * 200) / 200.0) END) AS weight, max(seq) AS last_seq, max(e) AS e FROM ctx, m GROUP BY 1, 2, 3, 4)
        SELECT p1, p2, p3, Activity, round(weight, 6) AS weight, last_seq FROM w WHERE NOT (weight < 1e-4 AND e - last_seq > 400)
        QUALIFY row_number() OVER (ORDER BY weight DESC, p1, p2, p3, Activity) <= 500""",
    "resource_usage": f"WITH {_LOG} SELECT Activity, Resource, count(*) AS n FROM log GROUP BY 1, 2",
    "resource_rarity_score": f"WITH {_LOG}, {_RARE} SELECT EventID, round(rarity, 6) AS rarity FROM rare",
    "resource_rarity_literal": f"""WITH {_LOG}, k AS (SELECT EventID, row_number() OVER (PARTITION BY Activity, Resource ORDER BY Timestamp, EventID) AS k FROM log)
        SELECT EventID, round(1.0::DOUBLE / (2 * k - 1), 6) AS rarity_1, round(1.0::DOUBLE / (2 * k), 6) AS rarity_2 FROM k""",
    "activity_event_index": f"""WITH {_LOG}, k AS (SELECT EventID, row_number() OVER (PARTITION BY Activity ORDER BY Timestamp, EventID) AS k FROM log)
        SELECT EventID, k, 2 * k - 1 AS literal_first, 2 * k AS literal_second FROM k""",
    "event_gap_decay": f"""WITH {_LOG}, {_SEQ}, g AS (SELECT EventID, seq - lag(seq) OVER (PARTITION BY Activity ORDER BY seq) AS gap FROM seq) SELECT EventID, gap, round(exp(-gap / 200.0), 6) AS decay FROM g""",
    "prev_time_gap": f"WITH {_LOG} SELECT EventID, round((epoch_us(Timestamp) - lag(epoch_us(Timestamp)) OVER (PARTITION BY CaseID ORDER BY Timestamp, EventID)) / 1e6, 6) AS seconds FROM log",
    "time_distribution_sets": f"""WITH {_LOG}, {_CAL} SELECT Activity, hour_bin, day_of_week, month, NULL::BOOLEAN AS is_weekend, NULL::BIGINT AS week_of_month, NULL AS season, count(*) AS n FROM cal GROUP BY 1, 2, 3, 4
        UNION ALL SELECT Activity, NULL, NULL, NULL, is_weekend, NULL, NULL, count(*) FROM cal GROUP BY 1, 5
        UNION ALL SELECT Activity, NULL, NULL, NULL, NULL, week_of_month, NULL, count(*) FROM cal GROUP BY 1, 6
        UNION ALL SELECT Activity, NULL, NULL, NULL, NULL, NULL, season, count(*) FROM cal GROUP BY 1, 7""",
    "past_occurrence_score": f"""WITH {_LOG}, {_CAL}, p AS (SELECT *, count(*) OVER (PARTITION BY Activity, hour_bin, day_of_week, month ORDER BY Timestamp, EventID ROWS UNBOUNDED PRECEDING) - 1 AS past FROM cal)
        SELECT EventID, past, round((day_of_week + month + CAST(is_weekend AS INT)) / (past + 1)::DOUBLE, 6) AS time_score FROM p""",
    "label_codes_arrival": f"WITH {_LOG}, {_CAL}, {_SEQ}, {_SCAL} SELECT EventID, {_arrival('hour_bin')} AS code_hour_bin, {_arrival('day_of_week')} AS code_day_of_week, {_arrival('month')} AS code_month FROM scal s",
    "label_codes_fold": f"""WITH {_LOG}, {_SEQ}, q AS (SELECT CAST(CaseID AS VARCHAR) AS v, min(seq) AS f FROM seq GROUP BY 1)
        SELECT EventID, (SELECT count(*) FROM q WHERE q.f <= s.seq AND q.v < CAST(s.CaseID AS VARCHAR)) AS code FROM seq s""",
    "label_codes_sorted": f"WITH {_LOG} SELECT v AS value, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT CAST(Resource AS VARCHAR) AS v FROM log)",
    "label_codes_frozen": f"WITH {_LOG}, {_SEQ} SELECT Activity AS value, row_number() OVER (ORDER BY min(seq)) - 1 AS code FROM seq GROUP BY 1",
    "ewma_weight_resource": f"""WITH RECURSIVE {_LOG}, {_RARE}, r AS (SELECT *, row_number() OVER (PARTITION BY Activity ORDER BY Timestamp, EventID) AS c FROM rare),
        f AS (SELECT EventID, Activity, c, 1.0::DOUBLE AS w FROM r WHERE c = 1
              UNION ALL SELECT r.EventID, r.Activity, r.c, f.w * exp(-1 / 200.0) + r.rarity * (1 - exp(-1 / 200.0)) FROM f JOIN r ON r.Activity = f.Activity AND r.c = f.c + 1)
        SELECT EventID, round(w, 6) AS weight FROM f""",
    "ewma_weight_literal": f"""WITH RECURSIVE {_LOG}, {_RARE}, c AS (SELECT *, row_number() OVER (PARTITION BY Activity ORDER BY Timestamp, EventID) AS c, row_number() OVER (ORDER BY Timestamp, EventID) AS k FROM rare),
        r AS (SELECT *, exp(-(c - lag(c, 1, c) OVER (ORDER BY k)) / 200.0) AS d FROM c),
        f AS (SELECT EventID, k, 1.0::DOUBLE AS w FROM r WHERE k = 1 UNION ALL SELECT r.EventID, r.k, f.w * r.d + r.rarity * (1 - r.d) FROM f JOIN r ON r.k = f.k + 1)
        SELECT EventID, round(w, 6) AS weight FROM f""",
    "time_score": f"WITH {_LOG}, {_CAL}, {_SEQ}, {_SCAL} SELECT EventID, CAST({_arrival('hour_bin')} + {_arrival('day_of_week')} + {_arrival('month')} + CAST(is_weekend AS INT) AS DOUBLE) AS time_score FROM scal s",
    "data_change_score": f"""WITH {_LOG}, p AS (SELECT *, lag(ProcessingTime) OVER w AS pt, lag(FileSize) OVER w AS fs, lag(PriorityLevel) OVER w AS pl, lag(Resource) OVER w AS rs, coalesce((epoch_us(Timestamp) - lag(epoch_us(Timestamp)) OVER w) / 1e6, 0) AS s
            FROM log WINDOW w AS (PARTITION BY CaseID ORDER BY Timestamp, EventID))
        SELECT EventID, round(0.6 * CASE WHEN power(ProcessingTime - pt, 2) / 4 > 0.05 THEN 1.2 ELSE 1.0 END * exp(-0.05 * s), 6) AS score_ProcessingTime,
            round(0.6 * CASE WHEN power(PriorityLevel - pl, 2) / 4 > 0.05 THEN 1.2 ELSE 1.0 END * exp(-0.05 * s), 6) AS score_PriorityLevel,
            round(0.6 * CASE WHEN power(FileSize - fs, 2) / 4 > 0.05 THEN 1.2 ELSE 1.0 END * exp(-0.05 * s), 6) AS score_FileSize,
            round(0.6 * CASE WHEN rs <> Resource THEN 1.15 ELSE 1.0 END * exp(-0.05 * s), 6) AS score_Resource FROM p""",
    "adaptive_topn": f"""WITH {_LOG}, {_RARE}, s AS (SELECT EventID, rarity, PriorityLevel * FileSize AS t FROM rare),
        h AS (SELECT *, least(greatest(sqrt(greatest((rarity * rarity + t * t) / 5 - power((rarity + t) / 5, 2), 0)) / 10, 0.1), 1.5) AS threshold FROM s)
        SELECT EventID, round(threshold, 6) AS threshold, CASE WHEN threshold < 1 THEN '' WHEN t > rarity THEN 'time_score' ELSE 'Resource' END AS top FROM h""",
    "feature_vector_minmax": f"""WITH {_LOG}, b AS (SELECT *, least(ProcessingTime, PriorityLevel, FileSize) AS lo, greatest(ProcessingTime, PriorityLevel, FileSize) AS hi FROM log)
        SELECT EventID, round(CASE WHEN hi > lo THEN (ProcessingTime - lo) / (hi - lo) ELSE 0 END, 6) AS v0, round(CASE WHEN hi > lo THEN (PriorityLevel - lo) / (hi - lo) ELSE 0 END, 6) AS v1,
            round(CASE WHEN hi > lo THEN (FileSize - lo) / (hi - lo) ELSE 0 END, 6) AS v2 FROM b""",
    "vector_frequency": f"""WITH {_LOG}, {_SEQ}, c AS (SELECT Activity, CAST(PriorityLevel AS DOUBLE) AS v0, floor(FileSize) AS v1, count(*) AS frequency, max(seq) AS last_seen FROM seq GROUP BY 1, 2, 3)
        SELECT *, Activity AS refined_label, row_number() OVER (PARTITION BY Activity ORDER BY frequency, last_seen) AS place FROM c""",
    "vector_frequency_decayed": f"""WITH {_LOG}, k AS (SELECT *, row_number() OVER (PARTITION BY Activity ORDER BY Timestamp, EventID) AS k FROM log),
        d AS (SELECT *, exp(-(max(k) OVER (PARTITION BY Activity) - k) / 200.0) AS f, max(k) OVER (PARTITION BY Activity) AS e FROM k),
        c AS (SELECT Activity, CAST(PriorityLevel AS DOUBLE) AS v0, floor(FileSize) AS v1, sum(f) AS frequency, max(k) AS last_seen, any_value(e) AS e FROM d GROUP BY 1, 2, 3)
        SELECT Activity, v0, v1, round(frequency, 6) AS frequency, last_seen FROM c WHERE NOT (frequency < 1e-4 AND e - last_seen > 400)
        QUALIFY row_number() OVER (PARTITION BY Activity ORDER BY frequency DESC, last_seen DESC) <= 500""",
    "feature_scores": f"""WITH RECURSIVE {_SCORES}
        SELECT EventID, 5::BIGINT AS n_scores, round(rs, 6) AS resource_score, round(ts, 6) AS time_score, round((rs + ts) / 5, 6) AS mean_score, round(threshold, 6) AS threshold FROM judged""",
    "event_vectors": f"""WITH RECURSIVE {_SCORES}, b AS (SELECT *, least(ProcessingTime, PriorityLevel, FileSize) AS lo, greatest(ProcessingTime, PriorityLevel, FileSize) AS hi FROM log)
        SELECT EventID, Activity AS activity_label, round(CASE WHEN hi > lo THEN (ProcessingTime - lo) / (hi - lo) ELSE 0 END, 6) AS v0, round(CASE WHEN hi > lo THEN (PriorityLevel - lo) / (hi - lo) ELSE 0 END, 6) AS v1,
            round(CASE WHEN hi > lo THEN (FileSize - lo) / (hi - lo) ELSE 0 END, 6) AS v2, CASE WHEN threshold < 1 THEN '' WHEN ts > rs THEN 'time_score' ELSE 'Resource' END AS top_features
        FROM b JOIN judged USING (EventID)""",
    "case_expiry": f"""WITH {_LOG}, {_SEQ}, g AS (SELECT CaseID, max(seq) AS last_seq, (SELECT max(seq) FROM seq) - max(seq) AS gap FROM seq GROUP BY 1)
        SELECT CaseID, last_seq, gap, round(exp(-gap / 10.0), 6) AS weight, exp(-gap / 10.0) < 1e-4 AND gap > 20 AS expired FROM g""",
    "dfg_of_live_cases": f"""WITH {_LOG}, {_SEQ}, {_CTX}, g AS (SELECT CaseID, (SELECT max(seq) FROM seq) - max(seq) AS gap FROM seq GROUP BY 1)
        SELECT p1, p2, p3, Activity, count(*) AS n FROM ctx JOIN g USING (CaseID) WHERE NOT (exp(-gap / 10.0) < 1e-4 AND gap > 20) GROUP BY 1, 2, 3, 4""",
    "iso_log": f"WITH {_LOG} SELECT EventID, CaseID, CASE WHEN epoch_us(Timestamp) % 1000000 = 0 THEN strftime(Timestamp, '%Y-%m-%dT%H:%M:%S') ELSE strftime(Timestamp, '%Y-%m-%dT%H:%M:%S.%f') END AS iso FROM log",
    "label_codes_joined": f"WITH {_LOG} SELECT EventID, dense_rank() OVER (ORDER BY CAST(Resource AS VARCHAR)) - 1 AS code FROM log",
    "adjusted_thresholds": f"""WITH {_VEC}, d AS (SELECT a.label, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda t: power(t[1] - t[2], 2)))) AS d FROM vec a JOIN vec b ON a.label = b.label AND a.vec_id < b.vec_id),
        f AS (SELECT label, least(greatest((avg(d) + stddev_pop(d)) / 10, 0.2), 1.5) AS v FROM d GROUP BY 1)
        SELECT label, CASE WHEN v > 0.2 THEN 0.2 ELSE 0.6 END::DOUBLE AS split, CASE WHEN v > 0.2 THEN 0.75 ELSE 0.85 END::DOUBLE AS merge FROM f""",
    "bad_rows": "SELECT event_id AS EventID, CASE WHEN event_id % 50 = 7 THEN 'no valid time' ELSE 'no activity' END AS reason FROM events WHERE event_id % 50 IN (7, 9, 11)",
    "dissimilar_members": f"""WITH {_FEW}, {_SLOTS}, {_matrix(0.0)}, o AS (SELECT grp, unnest([i, j]) AS m FROM sims WHERE i <> j AND round(sim, 9) < {_SPLIT}),
        u AS (SELECT DISTINCT grp, m FROM o) SELECT grp, string_agg(CAST(m AS VARCHAR), ',' ORDER BY m) AS members FROM u GROUP BY 1""",
    "data_columns": "SELECT unnest(['ProcessingTime', 'PriorityLevel', 'FileSize']) AS column",
    "feature_types": f"""WITH {_LOG}, {_CAL}, one AS (SELECT * FROM cal LIMIT 1),
        t AS (SELECT {", ".join(f"typeof({c}) AS {c}" for c in _COLUMNS)} FROM one), u AS (UNPIVOT t ON {", ".join(_COLUMNS)} INTO NAME feature VALUE type)
        SELECT feature, CASE WHEN type IN ('BIGINT', 'INTEGER', 'DOUBLE', 'BOOLEAN') THEN 'numeric' ELSE 'categorical' END AS kind FROM u""",
    "refined_labels_numeric": f"WITH RECURSIVE {_CLUSTERS} SELECT EventID, Activity, cluster_id, {_REFINED}, round(weight, 6) AS weight, k AS step FROM refined",
    "stream_refined": f"WITH RECURSIVE {_CLUSTERS} SELECT EventID, Activity, cluster_id, {_REFINED} FROM refined",
    "cluster_summary": f"""WITH RECURSIVE {_CLUSTERS}, e AS (SELECT Activity, max(k) AS e, count(*) AS n FROM refined GROUP BY 1),
        c AS (SELECT Activity, cluster_id, count(*) AS n, max_by(weight, k) AS w, max(k) AS last FROM refined GROUP BY 1, 2), d AS (SELECT Activity, c.n, w * exp(-(e - last) / 200.0) AS w, e.n AS all FROM c JOIN e USING (Activity))
        SELECT Activity, count(*) AS n_clusters, max(d.all) AS n_events, round(avg(n), 6) AS mean_size, round(avg(w), 6) AS mean_weight, round(sum(w), 6) AS total_weight FROM d GROUP BY 1""",
    "refined_output_literal": f"""WITH {_LOG}, {_CAL} SELECT EventID, CaseID, Activity, CASE WHEN epoch_us(Timestamp) % 1000000 = 0 THEN strftime(Timestamp, '%Y-%m-%dT%H:%M:%S') ELSE strftime(Timestamp, '%Y-%m-%dT%H:%M:%S.%f') END AS Timestamp,
        Resource, round(ProcessingTime, 6) AS ProcessingTime, PriorityLevel, round(FileSize, 6) AS FileSize, hour_bin, day_of_week, is_weekend, week_of_month, season, month, Activity AS refined_activity FROM cal""",
    "csv_log": f"""WITH {_LOG} SELECT EventID, CAST(CaseID AS VARCHAR) AS CaseID, Activity, CASE WHEN epoch_us(Timestamp) % 1000000 = 0 THEN strftime(Timestamp, '%Y-%m-%dT%H:%M:%S') ELSE strftime(Timestamp, '%Y-%m-%dT%H:%M:%S.%f') END AS Timestamp,
        'Zürich' AS Location, CAST(round(ProcessingTime) AS BIGINT) AS ProcessingTime FROM log WHERE EventID % 40 NOT IN (3, 5)""",
    "cluster_summary_literal": f"WITH {_LOG} SELECT Activity, 1::BIGINT AS n_clusters, count(*)::DOUBLE AS mean_size, 1.0::DOUBLE AS mean_weight, 1.0::DOUBLE AS total_weight, count(*) AS n_events FROM log GROUP BY 1",
    "audit_log_literal": f"WITH {_LOG}, {_SEQ} SELECT seq, 'INFO' AS level, 'cluster_create' AS action, Activity AS label FROM seq",
    "late_rows": f"""WITH {_LOG} SELECT EventID, Activity, 'late' AS reason FROM log WHERE EventID % 10 = 0 AND Timestamp <= (SELECT max(Timestamp) FROM log WHERE EventID % 10 <> 0) - INTERVAL 1 HOUR""",
    "static_bins": f"WITH {_LOG} SELECT EventID, (SELECT least(greatest(count(*) - 1, 0), 19) FROM range(0, 21) e(i) WHERE 0.0 + i * 10.0 / 20 <= FileSize * 1.2 - 0.5) AS bin FROM log",
    "static_bins_halfeven": f"""WITH {_LOG}, v AS (SELECT EventID, round(FileSize * 1.2 / 10 - 0.05, 3) AS v FROM log), e AS (SELECT CAST(i AS INT) AS i, i / 20.0::DOUBLE AS lo, (i + 1) / 20.0::DOUBLE AS hi FROM range(0, 20) r(i))
        SELECT EventID, CAST(coalesce(round_even(i + (v - lo) / (hi - lo), 0), 19) AS BIGINT) AS bin FROM v LEFT JOIN e ON v >= lo AND v < hi""",
    "bin_counts": f"""WITH {_LOG}, x AS (SELECT 'FileSize' AS feature, FileSize AS v FROM log UNION ALL SELECT 'ProcessingTime', ProcessingTime / 50 FROM log)
        SELECT feature, (SELECT least(greatest(count(*) - 1, 0), 19) FROM range(0, 21) e(i) WHERE 0.0 + i * 10.0 / 20 <= v) AS bin, count(*) AS n FROM x GROUP BY 1, 2""",
    "sparse_bins": f"""WITH {_LOG}, c AS (SELECT CAST(floor(ProcessingTime / 2 + power(ProcessingTime / 100, 4)) AS BIGINT) AS bin, count(*) AS n FROM log GROUP BY 1)
        SELECT 'ProcessingTime' AS feature, bin, n, n < 15 AND coalesce(lag(n) OVER (ORDER BY bin), 1000000) < 15 AND coalesce(lead(n) OVER (ORDER BY bin), 1000000) < 15 AS sparse FROM c""",
    "bin_quantiles": f"""WITH {_LOG}, x AS (SELECT 'FileSize' AS feature, quantile_cont(FileSize, [0.05, 0.2, 0.4, 0.6, 0.8, 0.95]) AS q FROM log UNION ALL SELECT 'ProcessingTime', quantile_cont(ProcessingTime, [0.05, 0.2, 0.4, 0.6, 0.8, 0.95]) FROM log)
        SELECT feature, unnest(range(0, 6)) AS pos, round(unnest(q), 6) AS edge FROM x""",
    "bin_split_median": f"""WITH {_LOG}, b AS (SELECT FileSize, (SELECT least(greatest(count(*) - 1, 0), 19) FROM range(0, 21) e(i) WHERE 0.0 + i * 10.0 / 20 <= FileSize) AS bin FROM log)
        SELECT bin, round(median(FileSize), 6) AS median, count(*) AS n FROM b GROUP BY 1""",
    "min_width_edges": f"""WITH RECURSIVE {_LOG}, v AS (SELECT DISTINCT CaseID, FileSize AS e FROM log),
        k AS (SELECT CaseID, min(e) AS e, 1::BIGINT AS n FROM v GROUP BY 1 UNION ALL
              SELECT CaseID, e, n FROM (SELECT k.CaseID, min(v.e) AS e, any_value(k.n) + 1 AS n FROM k JOIN v ON v.CaseID = k.CaseID AND v.e - k.e >= 0.5 GROUP BY k.CaseID, k.n))
        SELECT CaseID, max(n) AS n_kept, round(max(e), 6) AS last_kept FROM k GROUP BY 1""",
    "kde_density_peaks": f"""WITH {_LOG}, s AS (SELECT count(*) AS n, min(ProcessingTime) AS lo, max(ProcessingTime) AS hi, stddev_samp(ProcessingTime) * power(count(*), -0.2) AS h FROM log),
        g AS (SELECT g, lo + g * (hi - lo) / 99 AS x, n, h FROM s, range(0, 100) r(g)),
        d AS (SELECT g, x, sum(exp(-power((x - ProcessingTime) / h, 2) / 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())) AS density FROM g, log GROUP BY g, x),
        p AS (SELECT *, lag(density) OVER (ORDER BY g) AS b, lead(density) OVER (ORDER BY g) AS a FROM d) SELECT g, round(x, 6) AS x, round(density, 9) AS density FROM p WHERE density > b AND density > a""",
    "sliding_window_stats": f"""WITH {_LOG} SELECT EventID, count(*) OVER w AS n, round(sum(ProcessingTime) OVER w, 2) AS total, round(stddev_pop(ProcessingTime) OVER w, 5) AS sd FROM log
        WINDOW w AS (PARTITION BY Activity ORDER BY Timestamp, EventID ROWS BETWEEN 999 PRECEDING AND CURRENT ROW)""",
    "event_deviation": f"""WITH {_LOG}, h AS (SELECT EventID, ProcessingTime AS v, avg(ProcessingTime) OVER w AS m, stddev_pop(ProcessingTime) OVER w AS sd FROM log
            WINDOW w AS (PARTITION BY Activity ORDER BY Timestamp, EventID ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT EventID, round(abs(v - m) / CASE WHEN sd > 1e-9 THEN sd ELSE 1 END, 4) AS z FROM h""",
    "euclid_pair_stats": f"""WITH {_VEC}, d AS (SELECT a.label, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda t: power(t[1] - t[2], 2)))) AS d FROM vec a JOIN vec b ON a.label = b.label AND a.vec_id < b.vec_id)
        SELECT label, count(*) AS n_pairs, round(avg(d), 6) AS mean_distance, round(stddev_pop(d), 6) AS sd_distance FROM d GROUP BY 1""",
    "variability_factor": f"""WITH {_VEC}, d AS (SELECT a.label, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda t: power(t[1] - t[2], 2)))) AS d FROM vec a JOIN vec b ON a.label = b.label AND a.vec_id < b.vec_id)
        SELECT label, round(least(greatest((avg(d) + stddev_pop(d)) / 10, 0.2), 1.5), 6) AS variability FROM d GROUP BY 1""",
    "variance_weights": f"""WITH {_VEC}, s AS (SELECT label, unnest(v) AS x, unnest(range(0, len(v))) AS pos FROM vec), p AS (SELECT label, pos, var_pop(x) AS v FROM s GROUP BY 1, 2),
        w AS (SELECT label, pos, greatest(v / sum(v) OVER (PARTITION BY label), 0.1) AS w FROM p) SELECT label, pos, round(w / sum(w) OVER (PARTITION BY label), 6) AS w FROM w""",
    "pair_similarity": f"""WITH {_FEW}, {_SLOTS}, s AS (SELECT a.vec_id AS i, b.vec_id AS j, sum(greatest(1 - power(a.x - b.x, 2), 0)) FILTER (a.p = b.p) AS same, sum(greatest(1 - power(a.x - b.x, 2), 0)) FILTER (a.p <> b.p) AS other, max(a.p) AS n
            FROM slots a JOIN slots b ON a.grp = b.grp AND a.vec_id < b.vec_id GROUP BY 1, 2)
        SELECT i, j, round(same + 0.15 * other, 6) AS raw, round(least((same + 0.15 * other) / n, 1), 6) AS reference, round((same + 0.15 * other) / (n + 0.15 * n * (n - 1)), 6) AS pairs, round(same / n, 6) AS diagonal FROM s""",
    "similarity_matrix": f"WITH {_FEW}, {_SLOTS}, {_matrix(0.05)} SELECT i, j, round(sim, 6) AS sim FROM sims",
    "split_merge_verdict": f"""WITH {_FEW}, {_SLOTS}, {_matrix(0.0)}, o AS (SELECT grp, i, j, round(sim, 9) AS sim FROM sims WHERE i <> j), b AS (SELECT grp, i, j FROM o WHERE sim > {_MERGE} UNION ALL SELECT grp, j, i FROM o WHERE sim > {_MERGE}),
        one AS (SELECT grp, i, min(j) AS j FROM b GROUP BY 1, 2 HAVING count(*) = 1), two AS (SELECT grp FROM one GROUP BY 1 HAVING count(*) = 2 AND min(i) = min_by(j, -i) AND max(i) = min_by(j, i)),
        l AS (SELECT grp, min(sim) AS least FROM o GROUP BY 1), g AS (SELECT DISTINCT grp FROM sims)
        SELECT g.grp, CASE WHEN least < {_SPLIT} THEN 'split' WHEN two.grp IS NOT NULL THEN 'merge' ELSE 'no_change' END AS verdict FROM g LEFT JOIN l ON l.grp = g.grp LEFT JOIN two ON two.grp = g.grp""",
    "zscore_vector": f"""WITH {_VEC}, s AS (SELECT vec_id, unnest(v) AS x, unnest(range(0, len(v))) AS pos, list_avg(v) AS m, list_stddev_pop(v) AS sd FROM vec)
        SELECT vec_id, pos, round((x - m) / sd, 5) AS z FROM s""",
    "centroid_mean": f"WITH {_VEC}, s AS (SELECT label, unnest(v) AS x, unnest(range(0, len(v))) AS pos FROM vec) SELECT label, pos, round(avg(x), 6) AS m FROM s GROUP BY 1, 2",
    "most_frequent_vector": f"""WITH {_LOG}, {_SEQ}, c AS (SELECT Activity, CAST(PriorityLevel AS DOUBLE) AS v0, floor(FileSize) AS v1, count(*) AS n, min(seq) AS f FROM seq GROUP BY 1, 2, 3)
        SELECT Activity, v0, v1, n FROM c QUALIFY row_number() OVER (PARTITION BY Activity ORDER BY n DESC, f) = 1""",
    "refined_labels_literal": f"WITH {_LOG} SELECT EventID, 0::BIGINT AS cluster_id, 'merge' AS verdict, Activity AS refined_activity FROM log",
    "stream_context": f"WITH {_LOG}, {_SEQ}, {_CTX} SELECT EventID, CaseID, Activity, p1, p2, p3 FROM ctx",
}
