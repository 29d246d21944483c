"""Calendar events and reminders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mailgrain.operators.joins import salted_join
from mailgrain.session import stored

# Hours before the due date at which reminders fall, and the default snooze.
REMINDER_HOURS = [168, 48, 24, 3]
SNOOZE_HOURS = 4
# Statuses of events that still want reminding.
OPEN_STATUSES = ["pending", "snoozed"]


def append(rows: DataFrame, path: str, batch: str) -> None:
    """Append rows as one batch folder; re-running the batch replaces it instead of doubling it."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def pending_events(events: DataFrame) -> DataFrame:
    """Events neither approved nor synced, earliest due date first, undated ones before all."""
    waiting = events.filter(~F.col("sync_approved") & ~F.col("is_synced"))
    return waiting.orderBy(F.col("due_date").asc_nulls_first(), F.col("id"))


def reminders_for_event(reminders: DataFrame, events: DataFrame) -> DataFrame:
    """The reminders of the given events, one row each, by time within an event.

    A row per reminder instead of a list per event: one event may hold a large share of them all.
    """
    wanted = events.select(F.col("id").alias("event_id")).distinct()
    found = salted_join(reminders, wanted, ["event_id"], F.col("id"))
    return found.orderBy("event_id", "reminder_time", F.col("id"))


def due_reminders(events: DataFrame, reminders: DataFrame, as_of: Column) -> DataFrame:
    """Open events whose next reminder is due, with their reminders in order.

    One row per event and reminder; an event without reminders keeps one row with NULLs. Matching
    rows come from a salted join, the rest from an anti-join against the event ids found, so a
    busy event is split and never gathered. Events are read once, and of reminders the event ids once more, for hot ones.
    """
    due = events.filter(F.col("reminder_status").isin(OPEN_STATUSES) & (F.col("next_reminder_at") <= as_of))
    due = stored(due.withColumnRenamed("id", "event_id"), "due")
    held = reminders.withColumnRenamed("id", "reminder_id")
    with_reminders = stored(salted_join(held, due, ["event_id"], F.col("reminder_id")), "held")
    without = due.join(with_reminders.select("event_id").distinct(), "event_id", "left_anti")
    rows = with_reminders.unionByName(without, allowMissingColumns=True)
    return rows.orderBy("next_reminder_at", "event_id", "reminder_time", "reminder_id")


def reminder_schedule(events: DataFrame, as_of: Column, hours: list[int] | None = None) -> DataFrame:
    """One reminder per interval before the due date, and the next one from ``as_of`` on."""
    times = [(h, F.col("due_date") - F.make_dt_interval(hours=F.lit(h))) for h in hours or REMINDER_HOURS]
    ahead = [F.when(at >= as_of, at) for _, at in times]
    plan = F.explode(F.array(*[F.struct(F.lit(h).alias("hours"), at.alias("at")) for h, at in times]))
    return (
        events.filter(F.col("due_date").isNotNull())
        .select(
            F.col("id").alias("event_id"),
            "due_date",
            (F.least(*ahead) if len(ahead) > 1 else ahead[0]).alias("next_reminder_at"),
            plan.alias("t"),
        )
        .select(
            "event_id",
            "due_date",
            F.col("t.hours").alias("hours_before"),
            F.col("t.at").alias("reminder_time"),
            "next_reminder_at",
        )
    )


def snooze(reminders: DataFrame, hours: int = SNOOZE_HOURS) -> DataFrame:
    """When snoozed reminders return: as told, else some hours after they were sent."""
    back = F.coalesce(F.col("snooze_until"), F.col("sent_at") + F.make_dt_interval(hours=F.lit(hours)))
    return reminders.filter(F.col("user_action") == "snoozed").withColumn("returns_at", back)
