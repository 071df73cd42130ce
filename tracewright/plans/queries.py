"""One registered query for each operator, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import CALIBRATED, Clustering, Decay, Params
from ..functions import vectors as V
from ..functions.calendar import with_calendar
from ..operators import binning, clustering, context, drift, encoding, scoring, similarity
from ..sources import logs
from ..storage import app_dir
from .repair import output, repaired, with_vector

#: Thresholds at which all three verdicts occur among the vectors.
SHARP = Clustering(analysis_split=0.86, analysis_merge=0.93)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _log(spark: SparkSession, d: str) -> DataFrame:
    return logs.events_log(spark, d)


def _seq(spark: SparkSession, d: str) -> DataFrame:
    return context.sequenced(_log(spark, d))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as vectors of doubles, their label the group."""
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))


def _r(c: Column | str, n: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, n)


@query
def log_stats(spark, d):
    return logs.log_statistics(_log(spark, d))


@query
def lineitem_log_stats(spark, d):
    return logs.log_statistics(logs.lineitem_log(spark, d))


@query
def activity_counts(spark, d):
    return logs.activity_counts(_log(spark, d))


@query
def valid_timestamps(spark, d):
    """Times written in ten ways, of which some are formats of the check and some are the log's own."""
    t, k = F.col("Timestamp"), F.col("EventID") % 10
    ways = ["yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy hh:mm a", "yyyy/MM/dd HH:mm:ss", "MM-dd-yyyy HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'", "E MMM dd HH:mm:ss yyyy", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy.MM.dd"]
    text = F.lit("no time")
    for i, way in enumerate(ways):
        text = F.when(k == i, F.date_format(t, way)).otherwise(text)
    df = _log(spark, d).select("EventID", text.alias("x"))
    return df.select("EventID", logs.is_valid_time(F.col("x")).alias("is_valid"), logs.parsed_time(F.col("x")).isNotNull().alias("parsed"), logs.parsed_time(F.col("x"), True).isNotNull().alias("parsed_literal"))


@query
def calendar_features(spark, d):
    c = with_calendar(_log(spark, d))
    return c.select("EventID", "hour_bin", F.col("day_of_week").cast("long").alias("day_of_week"), "is_weekend", F.col("week_of_month").cast("long").alias("week_of_month"), "season", F.col("month").cast("long").alias("month"))


@query
def hour_bin_counts(spark, d):
    return with_calendar(_log(spark, d)).groupBy("Activity", "hour_bin").agg(F.count("*").alias("n"))


@query
def season_weekend_matrix(spark, d):
    c = with_calendar(_log(spark, d)).groupBy("season").pivot("is_weekend", [False, True]).agg(F.count(F.lit(1)))
    return c.select("season", F.coalesce("false", F.lit(0)).alias("weekday_events"), F.coalesce("true", F.lit(0)).alias("weekend_events"))


@query
def dedup_events(spark, d):
    log = _log(spark, d)
    later = log.where("EventID % 3 = 0").withColumn("Timestamp", F.col("Timestamp") + F.expr("interval 1 day")).withColumn("ProcessingTime", F.lit(-1.0))
    return context.first_rows(log.unionByName(later)).select("EventID", "CaseID", "Activity", _r("ProcessingTime").alias("ProcessingTime"))


@query
def numeric_cells(spark, d):
    k = F.col("EventID") % 7
    text = F.when(k == 0, "NaN").when(k == 1, " m ").when(k == 2, "").when(k == 3, "null").when(k == 4, "12x").otherwise(F.concat(F.lit(" "), F.col("PriorityLevel").cast("string"), F.lit(".5 ")))
    return _log(spark, d).select("EventID", F.coalesce(V.numeric_cell(text), F.lit(0.0)).alias("value"))


@query
def data_columns(spark, d):
    names = logs.data_columns(_log(spark, d))
    return spark.range(1).select(F.explode(F.array(*map(F.lit, names))).alias("column"))


@query
def feature_types(spark, d):
    kinds = logs.feature_types(with_calendar(_log(spark, d)))
    return spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), F.lit(v).alias("kind")) for k, v in kinds.items()])).alias("x")).select("x.*")


@query
def event_sequence(spark, d):
    return _seq(spark, d).select("EventID", F.col("seq").cast("long").alias("seq"))


@query
def prev_activity_context(spark, d):
    return context.with_context(_log(spark, d)).select("EventID", "p1", "p2", "p3")


@query
def prev_activity_literal_context(spark, d):
    return context.literal_context(_log(spark, d)).select("EventID", F.col("pass").cast("long").alias("pass"), "p1", "p2", "p3")


@query
def dfg_edges(spark, d):
    return context.edges(_seq(spark, d)).select("p1", "p2", "p3", "Activity", "n", F.col("last_seq").cast("long").alias("last_seq"))


@query
def dfg_pair_frequency(spark, d):
    return context.pair_frequency(_log(spark, d))


@query
def dfg_without_cases(spark, d):
    log = _seq(spark, d)
    gone = log.where("CaseID % 10 = 0").select("CaseID").distinct()
    return context.without_cases(context.edges(log), log, gone).select("p1", "p2", "p3", "Activity", "n")


@query
def case_paths(spark, d):
    return context.case_paths(_log(spark, d))


@query
def dfg_decayed(spark, d):
    return context.decayed_edges(_seq(spark, d)).select("p1", "p2", "p3", "Activity", _r("weight").alias("weight"), F.col("last_seq").cast("long").alias("last_seq"))


@query
def resource_usage(spark, d):
    return context.resource_usage(_log(spark, d))


@query
def resource_rarity_score(spark, d):
    return scoring.resource_rarity(_log(spark, d)).select("EventID", _r("rarity").alias("rarity"))


@query
def resource_rarity_literal(spark, d):
    return scoring.resource_rarity_literal(_log(spark, d)).select("EventID", _r("rarity_1").alias("rarity_1"), _r("rarity_2").alias("rarity_2"))


@query
def activity_event_index(spark, d):
    k = F.row_number().over(context.activity_order()).cast("long")
    return _log(spark, d).select("EventID", k.alias("k"), (2 * k - 1).alias("literal_first"), (2 * k).alias("literal_second"))


@query
def event_gap_decay(spark, d):
    return context.event_gaps(_seq(spark, d), "Activity").select("EventID", F.col("gap").cast("long").alias("gap"), _r("decay").alias("decay"))


@query
def prev_time_gap(spark, d):
    return context.time_gaps(_log(spark, d)).select("EventID", _r("seconds").alias("seconds"))


@query
def time_distribution_sets(spark, d):
    c = context.time_distribution(with_calendar(_log(spark, d)))
    return c.withColumns({k: F.col(k).cast("long") for k in ("day_of_week", "month", "week_of_month")})


@query
def past_occurrence_score(spark, d):
    return scoring.past_occurrence_score(with_calendar(_log(spark, d))).select("EventID", F.col("past").cast("long").alias("past"), _r("time_score").alias("time_score"))


@query
def label_codes_arrival(spark, d):
    log = with_calendar(_seq(spark, d))
    for c in ("hour_bin", "day_of_week", "month"):
        log = encoding.with_arrival_code(log, c, f"code_{c}")
    return log.select("EventID", *[F.col(f"code_{c}").cast("long").alias(f"code_{c}") for c in ("hour_bin", "day_of_week", "month")])


@query
def label_codes_fold(spark, d):
    """Codes of a column of many values, the cases, as they are when the values are broadcast."""
    log = encoding._by_dimension(_seq(spark, d), "CaseID", "code")
    return log.select("EventID", F.col("code").cast("long").alias("code"))


@query
def label_codes_sorted(spark, d):
    return encoding.sorted_codes(_log(spark, d), "Resource").select("value", F.col("code").cast("long").alias("code"))


@query
def label_codes_frozen(spark, d):
    return encoding.frozen_codes(_seq(spark, d), "Activity").select("value", F.col("code").cast("long").alias("code"))


@query
def ewma_weight_resource(spark, d):
    return scoring.ewma_weight(scoring.resource_rarity(_log(spark, d)), "rarity").select("EventID", _r("weight").alias("weight"))


@query
def ewma_weight_literal(spark, d):
    return scoring.ewma_weight_literal(scoring.resource_rarity(_log(spark, d)), "rarity").select("EventID", _r("weight").alias("weight"))


@query
def time_score(spark, d):
    log = with_calendar(_seq(spark, d))
    for c in ("hour_bin", "day_of_week", "month"):
        log = encoding.with_arrival_code(log, c, f"code_{c}")
    codes = {c: F.col(f"code_{c}") for c in ("hour_bin", "day_of_week", "month")} | {"is_weekend": F.col("is_weekend").cast("int")}
    ones = dict.fromkeys(codes, F.lit(1.0))
    return log.select("EventID", _r(scoring.time_score(codes, ones)).alias("time_score"))


@query
def data_change_score(spark, d):
    out = scoring.data_change(_log(spark, d), ("ProcessingTime", "PriorityLevel", "FileSize"), ("Resource",))
    return out.select("EventID", *[_r(f"score_{c}").alias(f"score_{c}") for c in ("ProcessingTime", "PriorityLevel", "FileSize", "Resource")])


def _scores(log: DataFrame) -> dict[str, Column]:
    """The scores in their order: context 0, rarity, and a time score that is spread widely enough for a top feature."""
    zero = F.lit(0.0)
    return {"prev_activity_1": zero, "prev_activity_2": zero, "prev_activity_3": zero, "Resource": F.col("rarity"), "time_score": F.col("PriorityLevel") * F.col("FileSize")}


@query
def adaptive_topn(spark, d):
    log = scoring.resource_rarity(_log(spark, d))
    s = _scores(log)
    return log.select("EventID", _r(scoring.adaptive_threshold(F.array(*s.values()))).alias("threshold"), F.array_join(scoring.top_features(s), ",").alias("top"))


@query
def feature_vector_minmax(spark, d):
    raw = F.array(F.col("ProcessingTime"), F.col("PriorityLevel").cast("double"), F.col("FileSize"))
    v = _log(spark, d).withColumn("raw", raw).withColumn("v", V.minmax("raw"))
    return v.select("EventID", *[_r(F.col("v")[i]).alias(f"v{i}") for i in range(3)])


def _small_vector() -> Column:
    return F.array(F.col("PriorityLevel").cast("double"), F.floor(F.col("FileSize")).cast("double"))


@query
def vector_frequency(spark, d):
    """Each activity's vectors, their label in a log without repair, and their place among those seen less often or less lately."""
    rows = clustering.vector_metadata(_seq(spark, d).withColumns({"vector": _small_vector(), "refined_activity": F.col("Activity")}))
    return rows.select("Activity", F.col("vector")[0].alias("v0"), F.col("vector")[1].alias("v1"), "frequency", F.col("last_seen").cast("long").alias("last_seen"), "refined_label", F.col("place").cast("long").alias("place"))


@query
def vector_frequency_decayed(spark, d):
    rows = clustering.decayed_frequencies(context.numbered(_log(spark, d), ["Activity"], "k").withColumn("vector", _small_vector()))
    return rows.select("Activity", F.col("vector")[0].alias("v0"), F.col("vector")[1].alias("v1"), _r("frequency").alias("frequency"), F.col("last_seen").cast("long").alias("last_seen"))


@query
def feature_scores(spark, d):
    """Every score of the selection step, with the weights that the events before left."""
    rows = scoring.feature_scores(with_calendar(_seq(spark, d)))
    return rows.select("EventID", F.size("scores").cast("long").alias("n_scores"), _r(F.col("scores")["Resource"]).alias("resource_score"), _r(F.col("scores")["time_score"]).alias("time_score"), _r("mean_score").alias("mean_score"), _r("threshold").alias("threshold"))


@query
def event_vectors(spark, d):
    """What the vector step hands on for an event: its label, its scaled vector and its top features."""
    rows = scoring.feature_scores(with_calendar(_seq(spark, d))).select("EventID", F.array_join("top", ",").alias("top_features"))
    vectors = with_vector(_log(spark, d), Params(vector_features="numeric"))
    return vectors.join(rows, "EventID").select("EventID", F.col("Activity").alias("activity_label"), *[_r(F.col("vector")[i]).alias(f"v{i}") for i in range(3)], "top_features")


@query
def case_expiry(spark, d):
    """At a quick decay, by which some cases of the log have expired."""
    rows = context.case_expiry(_seq(spark, d), Decay(tau=10.0, removal_gap=20))
    return rows.select("CaseID", F.col("last_seq").cast("long").alias("last_seq"), F.col("gap").cast("long").alias("gap"), _r("weight").alias("weight"), "expired")


@query
def dfg_of_live_cases(spark, d):
    return context.edges(context.without_expired(_seq(spark, d), Decay(tau=10.0, removal_gap=20))).select("p1", "p2", "p3", "Activity", "n")


@query
def iso_log(spark, d):
    return logs.in_order(_log(spark, d)).select("EventID", "CaseID", F.col("Timestamp").alias("iso"))


@query
def label_codes_joined(spark, d):
    return encoding.with_sorted_code(_log(spark, d), "Resource", "code").select("EventID", F.col("code").cast("long").alias("code"))


@query
def adjusted_thresholds(spark, d):
    v = similarity.distance_statistics(_vectors(spark, d), "label", "vec_id")
    split, merge = similarity.adjusted_thresholds(F.col("variability"), 0.15, 0.8)
    return v.select("label", _r(split).alias("split"), _r(merge).alias("merge"))


@query
def bad_rows(spark, d):
    """A log of which some rows have no time or no activity: what the quarantine holds."""
    k = F.col("EventID") % 50
    log = _log(spark, d).withColumns({"Timestamp": F.when(k != 7, F.col("Timestamp")), "Activity": F.when(k == 9, "").when(k != 11, F.col("Activity"))})
    return logs.quarantine(log).select("EventID", "reason")


def _edges() -> Column:
    return binning.uniform_edges(0.0, 10.0)


@query
def static_bins(spark, d):
    return _log(spark, d).select("EventID", binning.bin_of(F.col("FileSize") * 1.2 - 0.5, _edges()).cast("long").alias("bin"))


@query
def static_bins_halfeven(spark, d):
    e = binning.uniform_edges(0.0, 1.0)
    return _log(spark, d).select("EventID", binning.literal_bin(F.round(F.col("FileSize") * 1.2 / 10 - 0.05, 3), e).cast("long").alias("bin"))


@query
def bin_counts(spark, d):
    bins = {"FileSize": binning.bin_of(F.col("FileSize"), _edges()), "ProcessingTime": binning.bin_of(F.col("ProcessingTime") / 50, _edges())}
    return binning.bin_counts(_log(spark, d), bins).withColumn("bin", F.col("bin").cast("long"))


@query
def sparse_bins(spark, d):
    b = F.floor(F.col("ProcessingTime") / 2 + F.pow(F.col("ProcessingTime") / 100, 4)).cast("int")
    return binning.sparse_bins(binning.bin_counts(_log(spark, d), {"ProcessingTime": b}), 45).withColumn("bin", F.col("bin").cast("long"))


@query
def bin_quantiles(spark, d):
    q = binning.quantiles(_log(spark, d), ("ProcessingTime", "FileSize"), exact=True)
    return q.select("feature", F.posexplode("edges").alias("pos", "edge")).select("feature", F.col("pos").cast("long").alias("pos"), _r("edge").alias("edge"))


@query
def bin_split_median(spark, d):
    return binning.bin_medians(_log(spark, d), "FileSize", _edges(), exact=True).select(F.col("bin").cast("long").alias("bin"), _r("median").alias("median"), "n")


@query
def min_width_edges(spark, d):
    """Of each case's sorted file sizes, those half a unit from the last one kept."""
    edges = _log(spark, d).groupBy("CaseID").agg(F.array_sort(F.collect_set("FileSize")).alias("edges"))
    kept = edges.select("CaseID", binning.min_width_edges("edges", 0.5).alias("kept"))
    return kept.select("CaseID", F.size("kept").cast("long").alias("n_kept"), _r(F.element_at("kept", -1)).alias("last_kept"))


@query
def kde_density_peaks(spark, d):
    return binning.density_peaks(_log(spark, d), "ProcessingTime").select(F.col("g").cast("long").alias("g"), _r("x").alias("x"), _r("density", 9).alias("density"))


@query
def adaptive_bins(spark, d):
    b = binning.adaptive_bins(_seq(spark, d), ("ProcessingTime", "PriorityLevel", "FileSize"))
    return b.groupBy("feature", "bin").agg(F.count("*").alias("n"), F.count_if("drifted").alias("n_drifts"))


@query
def sliding_window_stats(spark, d):
    return scoring.sliding_statistics(_log(spark, d), "ProcessingTime").select("EventID", "n", _r("total", 2).alias("total"), _r("sd", 5).alias("sd"))


@query
def event_deviation(spark, d):
    """How far an event's time lies from its activity's history, in deviations."""
    return scoring.deviations(_log(spark, d), "ProcessingTime").select("EventID", _r("z", 4).alias("z"))


@query
def euclid_pair_stats(spark, d):
    s = similarity.distance_statistics(_vectors(spark, d), "label", "vec_id")
    return s.select("label", "n_pairs", _r("mean_distance").alias("mean_distance"), _r("sd_distance").alias("sd_distance"))


@query
def variability_factor(spark, d):
    return similarity.distance_statistics(_vectors(spark, d), "label", "vec_id").select("label", _r("variability").alias("variability"))


@query
def variance_weights(spark, d):
    w = similarity.variance_weights(_vectors(spark, d), "label")
    return w.select("label", F.posexplode("weights").alias("pos", "w")).select("label", F.col("pos").cast("long").alias("pos"), _r("w").alias("w"))


def _few(spark: SparkSession, d: str) -> DataFrame:
    """Vectors scaled within themselves; groups of a few, as micro-clusters are: vectors of near ids."""
    v = _vectors(spark, d).withColumn("vector", V.minmax("vector"))
    return v.withColumn("grp", F.floor(F.col("vec_id") / 6))


@query
def pair_similarity(spark, d):
    p = similarity.pair_similarity(_few(spark, d), "grp", "vec_id")
    return p.select("i", "j", _r("raw").alias("raw"), _r("reference").alias("reference"), _r("pairs").alias("pairs"), _r("diagonal").alias("diagonal"))


@query
def similarity_matrix(spark, d):
    return similarity.weighted_matrix(_few(spark, d), "grp", "vec_id").select("i", "j", _r("sim").alias("sim"))


@query
def split_merge_verdict(spark, d):
    """At thresholds that all three verdicts occur at."""
    matrix = similarity.weighted_matrix(_few(spark, d), "grp", "vec_id", 0.0).withColumn("sim", _r("sim", 9))
    return similarity.verdicts(matrix, "grp", SHARP)


@query
def dissimilar_members(spark, d):
    """The vectors of each group that some other is too unlike."""
    matrix = similarity.weighted_matrix(_few(spark, d), "grp", "vec_id", 0.0).withColumn("sim", _r("sim", 9))
    return similarity.dissimilar(matrix, "grp", SHARP.analysis_split).select("grp", F.array_join("members", ",").alias("members"))


@query
def similar_groups(spark, d):
    matrix = similarity.weighted_matrix(_few(spark, d), "grp", "vec_id", 0.0).withColumn("sim", _r("sim", 9))
    return similarity.similar_groups(matrix, "grp", SHARP.analysis_merge, SHARP.analysis_split)


@query
def zscore_vector(spark, d):
    v = _vectors(spark, d).withColumn("z", V.zscore("vector"))
    return v.select("vec_id", F.posexplode("z").alias("pos", "z")).select("vec_id", F.col("pos").cast("long").alias("pos"), _r("z", 5).alias("z"))


@query
def centroid_mean(spark, d):
    c = similarity.centroids(_vectors(spark, d), "label")
    return c.select("label", F.posexplode("centroid").alias("pos", "m")).select("label", F.col("pos").cast("long").alias("pos"), _r("m").alias("m"))


@query
def most_frequent_vector(spark, d):
    """Each activity's most frequent vector, the first seen among equals."""
    vector = F.array(F.col("PriorityLevel").cast("double"), F.floor(F.col("FileSize")).cast("double"))
    top = clustering.most_frequent_vectors(_seq(spark, d).withColumn("vector", vector))
    return top.select("Activity", F.col("vector")[0].alias("v0"), F.col("vector")[1].alias("v1"), "n")


@query
def refined_labels_literal(spark, d):
    return repaired(_log(spark, d), Params(mode="literal")).select("EventID", F.col("cluster_id").cast("long").alias("cluster_id"), "verdict", "refined_activity")


@query
def refined_labels(spark, d):
    r = repaired(_log(spark, d))
    return r.select("EventID", "Activity", "cluster_id", _r("best_sim").alias("best_sim"), "n_active", "verdict", "refined_activity")


#: Numeric columns scaled by feature, at the thresholds that fit such vectors.
CALIBRATED_PARAMS = Params(vector_features="numeric", scaling="per_feature", clustering=CALIBRATED)


@query
def refined_labels_numeric(spark, d):
    r = repaired(_log(spark, d), CALIBRATED_PARAMS)
    return r.select("EventID", "Activity", F.col("cluster_id").cast("long").alias("cluster_id"), _r("best_sim").alias("best_sim"), F.col("n_active").cast("long").alias("n_active"), "refined_activity", _r("weight").alias("weight"), "step")


@query
def refined_output_literal(spark, d):
    """Refined rows in the columns in which they are written."""
    log = _log(spark, d)
    rows = output(repaired(log, Params(mode="literal")), log)
    return rows.withColumns({"Timestamp": logs.iso_time(F.col("Timestamp")), **{c: F.col(c).cast("long") for c in ("day_of_week", "week_of_month", "month")}, **{c: _r(c) for c in ("ProcessingTime", "FileSize")}})


@query
def csv_log(spark, d):
    """The log written as CSV, some rows without a valid time or an activity, and read again."""
    path = f"{app_dir(spark)}/csv-{uuid.uuid4().hex}"
    k = F.col("EventID") % 40
    rows = _log(spark, d).select(
        "EventID", "CaseID", F.when(k != 3, F.col("Activity")).alias("Activity"), F.when(k == 5, "soon").otherwise(logs.iso_time(F.col("Timestamp"))).alias("Timestamp"), "Resource",
        F.lit("Zürich").alias("Location"), F.lit("Night").alias("Shift"), F.lit("IT").alias("Department"), F.round("ProcessingTime").cast("int").alias("ProcessingTime"), "PriorityLevel", "FileSize",
    )
    rows.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    log = logs.read_csv(spark, path)
    return log.select(F.col("EventID").cast("long").alias("EventID"), "CaseID", "Activity", logs.iso_time(F.col("Timestamp")).alias("Timestamp"), "Location", F.col("ProcessingTime").cast("long").alias("ProcessingTime"))


@query
def cluster_summary(spark, d):
    rows = clustering.cluster_summary(repaired(_log(spark, d), CALIBRATED_PARAMS))
    return rows.select("Activity", "n_clusters", "n_events", _r("mean_size").alias("mean_size"), _r("mean_weight").alias("mean_weight"), _r("total_weight").alias("total_weight"))


@query
def cluster_summary_literal(spark, d):
    rows = clustering.cluster_summary(repaired(_log(spark, d), Params(mode="literal")))
    return rows.select("Activity", "n_clusters", "mean_size", "mean_weight", "total_weight", "n_events")


@query
def audit_log(spark, d):
    """The whole trail."""
    return clustering.audit(repaired(_log(spark, d)))


@query
def audit_log_literal(spark, d):
    """The trail where every event makes a cluster anew and every verdict is to merge."""
    return clustering.audit(repaired(_log(spark, d), Params(mode="literal"))).select(F.col("seq").cast("long").alias("seq"), "level", "action", "label")


@query
def generated_log(spark, d):
    return logs.generated(spark)


def _shifted(spark: SparkSession, d: str) -> DataFrame:
    """feature, seq and value of all numeric columns, the second half of the log shifted, so that there is a change to find."""
    log = _seq(spark, d)
    half = log.count() / 2
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in logs.LOG.numeric])
    rows = log.select("seq", F.explode(rows).alias("x")).select("seq", "x.*")
    span = rows.groupBy("feature").agg((F.max("value") - F.min("value")).alias("span"))
    rows = rows.join(F.broadcast(span), "feature")  # three rows
    return rows.select("feature", "seq", (F.col("value") + F.when(F.col("seq") > half, 0.3 * F.col("span")).otherwise(0.0)).alias("value"))


@query
def adwin_drift(spark, d):
    return drift.drifts(_shifted(spark, d))


@query
def drift_weights(spark, d):
    """Each feature's weight after every look, by whether its values have drifted."""
    return drift.drift_weights(_shifted(spark, d))


@query
def binned_log(spark, d):
    """The log with the adaptive bin of each numeric column."""
    columns = logs.LOG.numeric
    return binning.with_bins(_seq(spark, d), columns).select("EventID", *[f"{c}_bin" for c in columns])


@query
def maintained_edges(spark, d):
    return binning.maintained_edges(_seq(spark, d), logs.LOG.numeric)


def _streamed(spark: SparkSession, rows: DataFrame, make) -> DataFrame:
    """rows written to a folder, read as a stream by make(), and its result."""
    from ..streaming.topology import drained

    root = f"{app_dir(spark)}/stream-{uuid.uuid4().hex}"
    # one event far later moves the watermark past all others, and itself waits for ever
    end = {"EventID": F.lit(-1), "CaseID": F.lit(-1), "Activity": F.lit("end"), "Timestamp": F.expr("Timestamp + interval 10 days")}
    last = rows.orderBy(F.desc("Timestamp")).limit(1).withColumns({k: v.cast(rows.schema[k].dataType) for k, v in end.items()})
    rows.unionByName(last).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{root}/in")
    drained(make(stream), f"{root}/out", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out")


@query
def stream_context(spark, d):
    from ..streaming import topology

    log = _log(spark, d)
    return _streamed(spark, log, lambda s: topology.context_stream(topology.arrivals(s))).select("EventID", "CaseID", "Activity", "p1", "p2", "p3")


@query
def stream_refined(spark, d):
    from ..streaming import topology

    rows = with_vector(with_calendar(_log(spark, d)), CALIBRATED_PARAMS).select("EventID", "CaseID", "Activity", "Timestamp", "vector")
    out = _streamed(spark, rows, lambda s: topology.refined_stream(topology.arrivals(s), CALIBRATED_PARAMS))
    return out.select("EventID", "Activity", F.col("cluster_id").cast("long").alias("cluster_id"), _r("best_sim").alias("best_sim"), F.col("n_active").cast("long").alias("n_active"), "refined_activity")


@query
def late_rows(spark, d):
    """What a stream's watermark lets go: the log comes in two batches, of which the second holds every tenth event, most of them late."""
    from ..streaming import sinks

    root = f"{app_dir(spark)}/late-{uuid.uuid4().hex}"
    log = _log(spark, d)
    for part, rows in enumerate((log.where("EventID % 10 <> 0"), log.where("EventID % 10 = 0"))):
        rows.coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(log.schema).parquet(f"{root}/in")
        sinks.save_late(stream, f"{root}/late", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/late").select("EventID", "Activity", "reason")
