"""Scheduled-alert bookkeeping A01-A03 as table jobs (delivery itself is not data work)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def due_alerts(alerts: DataFrame, today: str) -> DataFrame:
    """Active subscriptions whose period has elapsed (frequency case-insensitive:
    daily / weekly / monthly; B14 fixed -- the reference only ever served 'daily')."""
    d = F.lit(today).cast("date")
    last = F.to_date("last_sent_at")
    freq = F.lower(F.trim("frequency"))
    due = (F.col("last_sent_at").isNull()
           | ((freq == "daily") & (last < d))
           | ((freq == "weekly") & (last <= F.date_sub(d, 7)))
           | ((freq == "monthly") & (last <= F.add_months(d, -1))))
    return alerts.filter(F.col("is_active") & freq.isin("daily", "weekly", "monthly") & due)


def run_log(results: DataFrame, sent_at: str) -> DataFrame:
    """One log row per processed alert; response and error text whole."""
    return results.select(
        F.md5(F.concat_ws("|", "alert_id", F.lit(sent_at))).alias("log_id"), "alert_id",
        F.lit(sent_at).cast("timestamp_ntz").alias("sent_at"), "question",
        "response",
        F.when(F.col("error").isNull(), "success").otherwise("failed").alias("status"),
        F.col("error").alias("error_message"))


def mark_sent(alerts: DataFrame, log: DataFrame) -> DataFrame:
    """last_sent_at of successfully sent alerts moves to the send time (upsert)."""
    ok = log.filter(F.col("status") == "success").groupBy("alert_id").agg(F.max("sent_at").alias("__sent"))
    j = alerts.join(ok, "alert_id", "left")
    return j.withColumn("last_sent_at", F.coalesce("__sent", "last_sent_at")).drop("__sent")


def subscriptions(alerts: DataFrame, log: DataFrame, recipient: str | None = None) -> DataFrame:
    """Subscriptions with the number of successful sends."""
    sent = log.filter(F.col("status") == "success").groupBy("alert_id").agg(F.count(F.lit(1)).alias("times_sent"))
    a = alerts if recipient is None else alerts.filter(F.col("recipient_email") == recipient)
    return a.join(sent, "alert_id", "left").withColumn("times_sent", F.coalesce("times_sent", F.lit(0)))


def cancel_matching(alerts: DataFrame, recipient: str, question_part: str) -> DataFrame:
    """Deactivate the recipient's alerts whose question contains the given text."""
    hit = (F.col("recipient_email") == recipient) & F.col("question").ilike(f"%{question_part}%")
    return alerts.withColumn("is_active", F.when(hit, F.lit(False)).otherwise(F.col("is_active")))
