"""Circuit breaker over guard events, as batch queries.

The breaker of a log opens when a dangerous chat event finds at least
``threshold`` dangerous events in the trailing window, and stays open until a
reset, which also starts a new log.

Both the epoch of an event and the trailing count are running counts: resets so
far, and dangerous events so far minus those before the window. Running counts
are prefix sums in two levels. Rows are range-partitioned by log and time, so a
bucket is bounded by rows: a burst within one hour of one log is split like any
other stretch. Buckets are counted each on its own, and one small row per bucket
and log is ordered to give the counts at its start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import materialise
from ..tables import contexts as values


def running_counts(df: DataFrame, *, keys: list[str], order: list[str], weights: dict[str, Column],
                   buckets: int | None = None) -> DataFrame:
    """Adds, per name in ``weights``, the sum of its weight over the rows of the key up to and including the row.

    ``order`` should tell all rows of a key apart. Rows are dealt into ``buckets`` ranges (one per shuffle partition
    unless given) and written once, so both levels see the same ranges."""
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = {name: f"_w{i}" for i, name in enumerate(weights)}
    dealt = materialise(df.withColumns({own: weights[name].cast("long") for name, own in names.items()})
                        .repartitionByRange(n, *keys, *order).withColumn("_bucket", F.spark_partition_id()))
    sums = dealt.groupBy(*keys, "_bucket").agg(*[F.sum(own).alias(own) for own in names.values()])
    earlier = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(*keys, "_bucket", *[F.coalesce(F.sum(own).over(earlier), F.lit(0)).alias(f"{own}_before") for own in names.values()])
    inside = W.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    joined = dealt.withColumns({own: F.sum(own).over(inside) for own in names.values()}).join(
        _null_safe(starts, keys), [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_bucket") == F.col("_k__bucket")])
    return joined.select(*df.columns, *[(F.col(own) + F.col(f"{own}_before")).alias(name) for name, own in names.items()])


def _null_safe(starts: DataFrame, keys: list[str]) -> DataFrame:
    for key in [*keys, "_bucket"]:
        starts = starts.withColumnRenamed(key, f"_k_{key}")
    return starts


def number_epochs(events: DataFrame, *, log: str, ts: str = "ts", event_id: str = "event_id",
                  reset: str = "is_reset", buckets: int | None = None) -> DataFrame:
    """Adds ``epoch``: resets seen so far in the log, the event itself included."""
    return running_counts(events, keys=[log], order=[ts, event_id], buckets=buckets,
                          weights={"epoch": F.coalesce(F.col(reset), F.lit(False)).cast("int")})


def trailing_dangerous(events: DataFrame, *, keys: list[str], ts: str = "ts", minutes: int = values.BREAKER_MINUTES,
                       buckets: int | None = None) -> DataFrame:
    """Dangerous events with ``recent``: dangerous events in the trailing window,
    its edge and events of the same instant included."""
    reach = minutes * 60_000_000
    dangerous = events.filter((F.col("verdict") == "DANGEROUS") & F.col(ts).isNotNull()).withColumn("_at", F.unix_micros(ts))
    instants = dangerous.groupBy(*keys, "_at").agg(F.count("*").alias("_n"))
    # Each instant stands in line twice: itself, and as the start of its window, in front of what happens there.
    places = F.explode(F.array(F.struct(F.col("_at").alias("at"), F.lit(1).alias("own")),
                               F.struct((F.col("_at") - reach).alias("at"), F.lit(0).alias("own")))).alias("_place")
    line = instants.select(*keys, "_at", "_n", places).select(*keys, F.col("_at").alias("_of"), "_place.at", "_place.own", "_n")
    counted = running_counts(line, keys=keys, order=["at", "own", "_of"], weights={"_so_far": F.col("_n") * F.col("own")}, buckets=buckets)
    recent = counted.groupBy(*keys, "_of").agg(F.sum(F.when(F.col("own") == 1, F.col("_so_far")).otherwise(-F.col("_so_far"))).alias("recent"))
    own = recent.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_of", "recent")
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_at") == F.col("_of")]
    return dangerous.join(own, same).select(*events.columns, "recent")


def breaker_alerts(events: DataFrame, *, log: str, ts: str = "ts", event_id: str = "event_id",
                   chat: str = "is_chat", reset: str | None = "is_reset", minutes: int = values.BREAKER_MINUTES,
                   threshold: int = values.BREAKER_THRESHOLD) -> DataFrame:
    """Chat events that trip the breaker: ``(log, epoch, event_id, ts, recent)``. Events that `number_epochs` has
    numbered are not numbered again."""
    if "epoch" in events.columns:
        epochs = events
    elif reset:
        # Only resets and dangerous events matter here.
        epochs = number_epochs(events.filter((F.col("verdict") == "DANGEROUS") | F.col(reset)).select(log, event_id, ts, "verdict", chat, reset),
                               log=log, ts=ts, event_id=event_id, reset=reset)
    else:
        epochs = events.withColumn("epoch", F.lit(0).cast("long"))
    recent = trailing_dangerous(epochs.select(log, "epoch", event_id, ts, "verdict", chat), keys=[log, "epoch"], ts=ts, minutes=minutes)
    return (recent.filter(F.col(chat) & (F.col("recent") >= threshold))
            .select(log, "epoch", event_id, ts, "recent"))


def breaker_epochs(events: DataFrame, alerts: DataFrame, *, log: str, ts: str = "ts",
                   event_id: str = "event_id", chat: str = "is_chat", reset: str = "is_reset") -> DataFrame:
    """Per log and epoch that opened: ``opened_at``, alerts, and chat events blocked
    after it. Both sides are reduced per epoch before they meet; the event side
    is joined to one row per opened epoch. Give events that `number_epochs` has numbered, for the alerts and here, and
    they are numbered once."""
    opened = alerts.groupBy(log, "epoch").agg(F.min(ts).alias("opened_at"), F.count("*").alias("alerts"))
    numbered = events if "epoch" in events.columns else number_epochs(events, log=log, ts=ts, event_id=event_id, reset=reset)
    blocked = (numbered.filter(F.col(chat)).join(opened.select(log, "epoch", "opened_at"), [log, "epoch"])
               .filter(F.col(ts) > F.col("opened_at"))
               .groupBy(log, "epoch").agg(F.count("*").alias("blocked_chats")))
    return (opened.join(blocked, [log, "epoch"], "left")
            .select(log, "epoch", "opened_at", "alerts", F.coalesce("blocked_chats", F.lit(0)).alias("blocked_chats")))


def danger_watch(events: DataFrame, *, window: str = "1 hour", slide: str | None = None,
                 threshold: int = values.BREAKER_THRESHOLD, ts: str = "ts", by: list[str] = ()) -> DataFrame:
    """Time windows with at least ``threshold`` dangerous events."""
    dangerous = events.filter(F.col("verdict") == "DANGEROUS")
    counted = dangerous.groupBy(*by, F.window(ts, window, slide).alias("w")).agg(F.count("*").alias("dangerous"))
    return counted.filter(F.col("dangerous") >= threshold).select(
        *by, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "dangerous")
