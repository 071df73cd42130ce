"""Order, control-flow context, the directly-follows graph and counts by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Decay, Scoring
from ..sources.logs import LOG, LogSchema
from ..storage import written


def case_order(s: LogSchema = LOG):
    return Window.partitionBy(s.case).orderBy(s.time, s.event)


def activity_order(s: LogSchema = LOG):
    return Window.partitionBy(s.activity).orderBy(s.time, s.event)


def sequenced(log: DataFrame, s: LogSchema = LOG) -> DataFrame:
    """log with seq, the place of each event in the order of (time, event), from 1.

    Two levels, so that no task sees all events: row numbers within an hour, and the totals of the hours before.
    """
    hours = log.groupBy(F.date_trunc("hour", s.time).alias("__hour")).agg(F.count("*").alias("n"))
    before = Window.orderBy("__hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.select("__hour", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__hour").orderBy(s.time, s.event))
    rows = log.withColumn("__hour", F.date_trunc("hour", s.time)).withColumn("__own", own)
    return rows.join(hours, "__hour").withColumn("seq", F.col("__before") + F.col("__own")).drop("__hour", "__before", "__own")


def numbered(log: DataFrame, keys: list[str], name: str, s: LogSchema = LOG) -> DataFrame:
    """log with the place of each event among those of equal keys, in the order of (time, event), from 1; in two levels, as seq is."""
    hours = log.groupBy(*keys, F.date_trunc("hour", s.time).alias("__hour")).agg(F.count("*").alias("n"))
    before = Window.partitionBy(*keys).orderBy("__hour").rowsBetween(Window.unboundedPreceding, -1)  # a row for each hour
    hours = hours.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__hour").alias("__at"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    rows = log.withColumn("__hour", F.date_trunc("hour", s.time))
    rows = rows.withColumn("__own", F.row_number().over(Window.partitionBy(*keys, "__hour").orderBy(s.time, s.event)))
    same = F.col("__hour") == F.col("__at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return rows.join(hours, same).withColumn(name, F.col("__before") + F.col("__own")).drop("__hour", "__at", "__before", "__own", *[f"__{k}" for k in keys])


def ranked(values: DataFrame, order: str, name: str) -> DataFrame:
    """values, distinct in order, with their rank in it from 0: Spark's range-partitioned sort, and the totals of the partitions before."""
    table = written(values.orderBy(order).withColumn("__m", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__m", 33)
    sizes = table.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition of the sort
    sizes = sizes.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    rows = table.withColumn("__part", part).join(F.broadcast(sizes), "__part")
    return rows.withColumn(name, F.col("__before") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).drop("__part", "__before", "__m")


def first_rows(log: DataFrame, s: LogSchema = LOG) -> DataFrame:
    """log with one row of each event id, the earliest."""
    rank = F.row_number().over(Window.partitionBy(s.event).orderBy(s.time, *[c for c in log.columns if c not in (s.event, s.time)]))
    return log.withColumn("__n", rank).where("__n = 1").drop("__n")


def previous(n: int, s: LogSchema = LOG, unknown: str = Scoring.unknown) -> Column:
    """The activity n events before in the case."""
    return F.coalesce(F.lag(s.activity, n).over(case_order(s)), F.lit(unknown))


def with_context(log: DataFrame, s: LogSchema = LOG) -> DataFrame:
    """log with p1, p2, p3: the three activities before in the case, oldest first."""
    return log.withColumns({"p1": previous(3, s), "p2": previous(2, s), "p3": previous(1, s)})


def literal_context(log: DataFrame, s: LogSchema = LOG) -> DataFrame:
    """Both contexts of an event when each is recorded twice: its pass (1 or 2) and p1, p2, p3."""
    out = log.columns
    log = log.withColumns({"__a1": previous(1, s), "__a2": previous(2, s), "__start": F.lag(s.activity, 1).over(case_order(s)).isNull()})
    a1, a2 = F.col("__a1"), F.col("__a2")
    first = F.struct(F.lit(1).alias("pass"), a2.alias("p1"), a1.alias("p2"), a1.alias("p3"))
    second = F.struct(F.lit(2).alias("pass"), a1.alias("p1"), a1.alias("p2"), F.col(s.activity).alias("p3"))
    unknown = F.lit(Scoring.unknown)
    second = F.when(F.col("__start"), F.struct(F.lit(2).alias("pass"), unknown.alias("p1"), unknown.alias("p2"), F.col(s.activity).alias("p3"))).otherwise(second)
    return log.select("*", F.explode(F.array(first, second)).alias("x")).select(*out, "x.*")


def edges(log: DataFrame, s: LogSchema = LOG) -> DataFrame:
    """The graph's edges with counts and the last event of each; log has seq."""
    return with_context(log, s).groupBy("p1", "p2", "p3", s.activity).agg(F.count("*").alias("n"), F.max("seq").alias("last_seq"))


def pair_frequency(log: DataFrame, s: LogSchema = LOG) -> DataFrame:
    """How often an activity directly follows another."""
    return log.select(previous(1, s).alias("prev"), s.activity).groupBy("prev", s.activity).agg(F.count("*").alias("n"))


def case_paths(log: DataFrame, s: LogSchema = LOG) -> DataFrame:
    """Each case's activities in order, as one text."""
    steps = F.array_sort(F.collect_list(F.struct(s.time, s.event, s.activity)))
    return log.groupBy(s.case).agg(F.array_join(F.transform(steps, lambda x: x[s.activity]), ">").alias("path"), F.count("*").alias("n"))


def without_cases(graph: DataFrame, log: DataFrame, gone: DataFrame, s: LogSchema = LOG) -> DataFrame:
    """The graph less the edges of the cases in gone; edges of which none is left go."""
    lost = with_context(log.join(gone.select(s.case), s.case, "left_semi"), s).groupBy("p1", "p2", "p3", s.activity).agg(F.count("*").alias("lost"))
    rest = graph.join(lost, ["p1", "p2", "p3", s.activity], "left").withColumn("n", F.col("n") - F.coalesce("lost", F.lit(0)))
    return rest.where("n > 0").drop("lost")


def case_expiry(log: DataFrame, decay: Decay = Decay(), s: LogSchema = LOG) -> DataFrame:
    """Each case with its last event, the events of the whole log since then, exp(-gap / tau), and whether it has expired by both bounds; log has seq."""
    end = log.agg(F.max("seq").alias("end"))
    cases = log.groupBy(s.case).agg(F.max("seq").alias("last_seq")).join(F.broadcast(end))  # one row
    cases = cases.withColumn("gap", F.col("end") - F.col("last_seq")).withColumn("weight", F.exp(-F.col("gap") / decay.tau)).drop("end")
    return cases.withColumn("expired", (F.col("weight") < decay.floor) & (F.col("gap") > decay.removal_gap))


def without_expired(log: DataFrame, decay: Decay = Decay(), s: LogSchema = LOG) -> DataFrame:
    """The events of the cases that have not expired: what history, counts and the graph are then made of."""
    return log.join(case_expiry(log, decay, s).where("expired").select(s.case), s.case, "left_anti")


def decayed_edges(log: DataFrame, decay: Decay = Decay(), s: LogSchema = LOG) -> DataFrame:
    """The graph after forgetting at every tau-th event: a use counts exp(-(last tick - its seq) / tau), and one since the last tick counts 1.

    This is the step by step shrinking of all edges in closed form, so no edge needs a state.  An edge below the floor that wasn't used for the
    removal gap goes, and the budget keeps the edges with the largest counts.
    """
    tau = F.lit(decay.tau)
    used = with_context(log, s)
    end = used.agg(F.max("seq").alias("end"))
    rows = used.join(F.broadcast(end))  # one row
    last_tick = F.floor(F.col("end") / tau) * tau
    kept = F.when(F.col("seq") >= last_tick, F.lit(1.0)).otherwise(F.exp(-(last_tick - F.col("seq")) / tau))
    out = rows.groupBy("p1", "p2", "p3", s.activity).agg(F.sum(kept).alias("weight"), F.max("seq").alias("last_seq"), F.max("end").alias("end"))
    out = out.where(~((F.col("weight") < decay.floor) & (F.col("end") - F.col("last_seq") > decay.removal_gap)))
    return out.orderBy(F.desc("weight"), "p1", "p2", "p3", s.activity).limit(decay.budget).drop("end")


def resource_usage(log: DataFrame, s: LogSchema = LOG) -> DataFrame:
    return log.groupBy(s.activity, s.resource).agg(F.count("*").alias("n"))


def event_gaps(log: DataFrame, key: str, decay: Decay = Decay()) -> DataFrame:
    """log with gap, events since the key's last one, and exp(-gap / tau); log has seq."""
    gap = F.col("seq") - F.lag("seq").over(Window.partitionBy(key).orderBy("seq"))
    return log.withColumn("gap", gap).withColumn("decay", F.exp(-F.col("gap") / decay.tau))


def time_gaps(log: DataFrame, s: LogSchema = LOG) -> DataFrame:
    """log with the seconds since the case's last event."""
    before = F.lag(s.time).over(case_order(s))
    return log.withColumn("seconds", (F.unix_micros(s.time) - F.unix_micros(before)) / 1e6)


def time_distribution(log: DataFrame, s: LogSchema = LOG) -> DataFrame:
    """Counts by activity and each of four sets of calendar features, one scan; log has the calendar columns."""
    a = F.col(s.activity)
    sets = [[a, F.col("hour_bin"), F.col("day_of_week"), F.col("month")], [a, F.col("is_weekend")], [a, F.col("week_of_month")], [a, F.col("season")]]
    features = [F.col(c) for c in ("hour_bin", "day_of_week", "month", "is_weekend", "week_of_month", "season")]
    return log.groupingSets(sets, a, *features).agg(F.count("*").alias("n")).select(a.alias("Activity"), *features, "n")
