"""Event logs: schema, scans, mappings of other tables, the generator, and sinks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class LogSchema:
    """Which column plays which role."""

    event: str = "EventID"
    case: str = "CaseID"
    activity: str = "Activity"
    time: str = "Timestamp"
    resource: str = "Resource"
    numeric: tuple[str, ...] = ("ProcessingTime", "PriorityLevel", "FileSize")

    @property
    def roles(self) -> tuple[str, ...]:
        return self.event, self.case, self.activity, self.time, self.resource


LOG = LogSchema()

CSV_SCHEMA = "EventID string, CaseID string, Activity string, Timestamp string, Resource string, Location string, Shift string, Department string, ProcessingTime int, PriorityLevel int, FileSize double"

#: Time formats, the first two of the log itself (fraction of a second or none), the others accepted by the check.
ISO = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"
ISO_FRACTION = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
FORMATS = ("yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy hh:mm a", "yyyy/MM/dd HH:mm:ss", "MM-dd-yyyy HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'")
_DAY_NAME = r"^(Mon|Tue|Wed|Thu|Fri|Sat|Sun) "


def parsed_time(text: Column, literal: bool = False) -> Column:
    """A timestamp, null if the text isn't one; literal: only with a fraction of a second."""
    return F.try_to_timestamp(text, F.lit(ISO_FRACTION if literal else ISO))


def is_valid_time(text: Column) -> Column:
    """Whether a text has one of six formats; the sixth begins with the day's name, which must be the date's."""
    at = F.try_to_timestamp(F.regexp_replace(text, _DAY_NAME, ""), F.lit("MMM dd HH:mm:ss yyyy"))
    named = text.rlike(_DAY_NAME) & at.isNotNull() & (F.date_format(at, "E") == F.substring(text, 1, 3))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in FORMATS]).isNotNull() | F.coalesce(named, F.lit(False))


def read_csv(spark: SparkSession, path: str, literal: bool = False) -> DataFrame:
    """A log from CSV, with its header; rows without a valid time or activity are left out, and found by quarantine()."""
    return valid(raw_csv(spark, path).withColumn("Timestamp", parsed_time(F.col("Timestamp"), literal)))


def raw_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("encoding", "ISO-8859-1").schema(CSV_SCHEMA).csv(path)


def valid(log: DataFrame, s: LogSchema = LOG) -> DataFrame:
    return log.where(F.col(s.time).isNotNull() & (F.length(s.activity) > 0))


def quarantine(log: DataFrame, s: LogSchema = LOG) -> DataFrame:
    """What valid() leaves out, with a reason."""
    reason = F.when(F.col(s.time).isNull(), "no valid time").when(F.coalesce(F.length(s.activity), F.lit(0)) == 0, "no activity")
    return log.withColumn("reason", reason).where("reason is not null")


def iso_time(ts: Column) -> Column:
    """A time as text in the log's own format: no fraction where it is 0."""
    return F.when(F.unix_micros(ts) % 1_000_000 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(ts, ISO_FRACTION))


def in_order(log: DataFrame, s: LogSchema = LOG) -> DataFrame:
    """log by case and time, as the generator writes it, times as text."""
    return log.orderBy(s.case, s.time, s.event).withColumn(s.time, iso_time(F.col(s.time)))


def write_csv(log: DataFrame, path: str, mode: str = "overwrite", s: LogSchema = LOG) -> None:
    """One header in each file, all columns named, times in the log's own format."""
    if dict(log.dtypes).get(s.time, "").startswith("timestamp"):
        log = log.withColumn(s.time, iso_time(F.col(s.time)))
    log.write.mode(mode).option("header", True).csv(path)


def with_label(log: DataFrame, s: LogSchema = LOG) -> DataFrame:
    """log, in which an event without a label is an error: for callers that have left such rows out."""
    missing = F.coalesce(F.length(s.activity), F.lit(0)) == 0
    return log.withColumn(s.activity, F.when(missing, F.raise_error(F.concat(F.lit("no activity label in event "), F.coalesce(F.col(s.event).cast("string"), F.lit("null"))))).otherwise(F.col(s.activity)))


def data_columns(log: DataFrame, s: LogSchema = LOG) -> list[str]:
    """Columns that play no role."""
    return [c for c in log.columns if c not in (*s.roles, "original_timestamp")]


def feature_types(log: DataFrame) -> dict[str, str]:
    """numeric or categorical for each column, from the schema; a boolean is numeric."""
    numeric = (T.NumericType, T.BooleanType)
    return {f.name: "numeric" if isinstance(f.dataType, numeric) else "categorical" for f in log.schema}


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a log."""
    k = F.get_json_object("props", "$.k").cast("long")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("EventID"), F.col("user_id").alias("CaseID"), F.col("event_type").alias("Activity"), F.col("ts").cast("timestamp").alias("Timestamp"),
        k.alias("Resource"), F.col("value").alias("ProcessingTime"), (k % 5 + 1).alias("PriorityLevel"), (F.col("value") / 50).alias("FileSize"),
    )


def lineitem_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as a log with many ties in time."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("EventID"), F.col("l_orderkey").alias("CaseID"), F.concat("l_returnflag", "l_linestatus").alias("Activity"), F.col("l_shipdate").cast("timestamp").alias("Timestamp"),
        F.col("l_suppkey").alias("Resource"), F.col("l_quantity").alias("ProcessingTime"), F.col("l_linenumber").cast("long").alias("PriorityLevel"), F.col("l_tax").alias("FileSize"),
    )


# Domains of the synthetic log.
VARIANTS = (
    ("Submit", "Archive", "Review", "Submit", "Approve", "Submit", "Finalize"),
    ("Submit", "Archive", "Submit", "Review", "Submit", "Approve", "Finalize"),
    ("Submit", "Review", "Archive", "Submit", "Review", "Submit", "Approve"),
    ("Submit", "Review", "Archive", "Submit", "Approve", "Submit", "Finalize"),
    ("Submit", "Submit", "Review", "Submit", "Approve", "Submit", "Finalize"),
)
RESOURCES = ("User_1", "User_2", "User_3", "User_4")
LOCATIONS = ("Branch_A", "Branch_B", "Branch_C", "Headquarters")
SHIFTS = ("Morning", "Afternoon", "Night")
DEPARTMENTS = ("HR", "Finance", "IT", "Operations")


def generated(spark: SparkSession, cases: int = 200, seed: int = 42, start: str = "2024-01-01T09:00:00") -> DataFrame:
    """A seeded synthetic log with true_label: the activity and which of its occurrences in the case an event is.

    Each later occurrence draws its data from other ranges than the first, so that a label's meaning can be told from them.
    """

    def draw(name: str, n: int) -> Column:
        return F.pmod(F.xxhash64("case", "step", F.lit(name), F.lit(seed)), F.lit(n))

    def one_of(name: str, values: tuple[str, ...]) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (draw(name, len(values)) + 1).cast("int"))

    variants = F.array(*[F.array(*map(F.lit, v)) for v in VARIANTS])
    base = spark.range(1, cases + 1).select(F.col("id").alias("case"))
    trace = F.element_at(variants, (F.pmod(F.xxhash64("case", F.lit("variant"), F.lit(seed)), F.lit(len(VARIANTS))) + 1).cast("int"))
    rows = base.select("case", F.posexplode(trace).alias("step", "Activity"))
    of_case = Window.partitionBy("case").orderBy("step")
    minutes = F.sum(F.when(F.col("step") == 0, 0).otherwise(draw("gap", 120) + 1)).over(of_case)
    day = F.pmod(F.xxhash64("case", F.lit("day"), F.lit(seed)), F.lit(31))
    at = F.timestamp_seconds(F.unix_seconds(F.to_timestamp(F.lit(start))) + 86400 * day + 60 * minutes)
    rows = rows.withColumns({"Timestamp": at, "nth": F.row_number().over(Window.partitionBy("case", "Activity").orderBy("step"))})
    # ids in the order of cases and steps: every variant has as many steps
    number = (F.col("case") - 1) * len(VARIANTS[0]) + F.col("step") + 1
    return rows.select(
        F.concat(F.lit("E_"), number).alias("EventID"), F.concat(F.lit("Case_"), "case").alias("CaseID"), "Activity", "Timestamp",
        one_of("resource", RESOURCES).alias("Resource"), one_of("location", LOCATIONS).alias("Location"), one_of("shift", SHIFTS).alias("Shift"), one_of("department", DEPARTMENTS).alias("Department"),
        F.when(F.col("nth") == 1, draw("time", 30) + 1).otherwise(draw("time", 30) + 90).cast("int").alias("ProcessingTime"), (draw("priority", 5) + 1).cast("int").alias("PriorityLevel"),
        F.round(F.lit(0.1) + draw("size", 991) / 100, 2).alias("FileSize"), F.concat_ws("_", "Activity", "nth").alias("true_label"),
    )


def log_statistics(log: DataFrame, s: LogSchema = LOG) -> DataFrame:
    """Rows, distinct events, activities and cases, in one row."""
    return log.agg(F.count("*").alias("n_events"), F.count_distinct(s.event).alias("n_event_ids"), F.count_distinct(s.activity).alias("n_activities"), F.count_distinct(s.case).alias("n_cases"))


def activity_counts(log: DataFrame, s: LogSchema = LOG) -> DataFrame:
    return log.groupBy(s.activity).agg(F.count("*").alias("n"))
