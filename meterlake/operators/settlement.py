"""Subscriptions and tasks: calendar ends, resets, expiry and settlement, all in UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from meterlake.functions.scalars import quota_truncated

DAY = 86_400


def _date(seconds: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / DAY).cast("int"))


def _seconds(date: Column) -> Column:
    return F.datediff(date, F.lit("1970-01-01").cast("date")).cast("bigint") * DAY


def plan_end(start: Column, unit: Column, amount: Column, custom_seconds: Column) -> Column:
    """End of a plan in unix seconds; null for an invalid one.

    Years and months go by the calendar and overflow into the next month (January 31 + 1 month is March 2 or 3): the
    month is added to the first of the month, then the days are. Days, hours and custom spans are seconds.
    """
    date = _date(start)
    months = F.when(unit == "year", amount * 12).otherwise(amount).cast("int")
    month = F.add_months(F.trunc(date, "MM"), F.when(unit.isin("year", "month"), months).otherwise(0))
    calendar = _seconds(F.date_add(month, F.dayofmonth(date) - 1)) + F.pmod(start, F.lit(DAY))
    span = F.when(unit == "day", amount * DAY).when(unit == "hour", amount * 3600)
    return F.when(unit == "custom", F.when(custom_seconds > 0, start + custom_seconds)).when(amount <= 0, F.lit(None)).when(unit.isin("year", "month"), calendar).otherwise(start + span)


def next_reset(base: Column, period: Column, custom_seconds: Column, end: Column) -> Column:
    """The next reset after ``base``: midnight, Monday, the first of a month, or a span; 0 if never or after the end."""
    date = _date(base)
    when = (
        F.when(period == "daily", _seconds(F.date_add(date, 1)))
        .when(period == "weekly", _seconds(F.date_add(date, 7 - F.weekday(date))))
        .when(period == "monthly", _seconds(F.add_months(F.trunc(date, "MM"), 1)))
        .when((period == "custom") & (custom_seconds > 0), base + custom_seconds)
        .otherwise(0)
    )
    return F.when((end > 0) & (when > end), 0).otherwise(when).cast("bigint")


def due_resets(subscriptions: DataFrame, now: int) -> DataFrame:
    """Active subscriptions whose reset is due, after it: amount_used 0, last_reset_time and next_reset_time moved on.

    The last boundary at or before both now and the end is found directly, without stepping through periods.
    """
    period, custom = F.col("reset_period"), F.coalesce("custom_seconds", F.lit(0)) if "custom_seconds" in subscriptions.columns else F.lit(0)
    base = F.when(F.col("last_reset_time") > 0, F.col("last_reset_time")).otherwise(F.col("start_time"))
    rows = subscriptions.where((F.col("status") == "active") & (F.col("next_reset_time") > 0) & (F.col("next_reset_time") <= now) & ((F.col("end_time") == 0) | (F.col("end_time") > now)) & period.isin("daily", "weekly", "monthly", "custom"))
    at = F.lit(now)
    date = _date(at)
    boundary = (
        F.when(period == "daily", _seconds(date))
        .when(period == "weekly", _seconds(F.date_sub(date, F.weekday(date))))
        .when(period == "monthly", _seconds(F.trunc(date, "MM")))
        .otherwise(base + F.floor((at - base) / F.nullif(custom, F.lit(0))) * custom)
    )
    rows = rows.withColumns({"base": base.cast("bigint"), "boundary": boundary.cast("bigint")}).where(F.col("boundary") > F.col("base"))
    following = next_reset(F.col("boundary"), period, custom, F.col("end_time"))
    return rows.withColumns({"amount_used": F.lit(0).cast("bigint"), "next_reset_time": following, "last_reset_time": F.col("boundary")}).drop("base", "boundary")


def expire(subscriptions: DataFrame, users: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(expired subscriptions, group changes as user_id and target).

    A user of an expired subscription keeps the group while another active one upgrades it; else the last expired one
    with a group decides: its downgrade group, or the group before it if the user still has its upgrade group.
    """
    due = (F.col("status") == "active") & (F.col("end_time") > 0) & (F.col("end_time") <= now)
    after = subscriptions.withColumn("due", due).withColumn("status", F.when(due, "expired").otherwise(F.col("status")))
    decides = (F.col("status") == "expired") & ((F.col("downgrade_group") != "") | (F.col("upgrade_group") != ""))
    fields = F.struct("downgrade_group", "upgrade_group", "prev_group")
    per = after.groupBy("user_id").agg(
        F.max("due").alias("any_due"), F.max((F.col("status") == "active") & (F.col("end_time") > now) & (F.col("upgrade_group") != "")).alias("upgraded"),
        F.max_by(F.when(decides, fields), F.when(decides, F.struct("end_time", "id"))).alias("last"))
    rows = per.where("any_due and not upgraded and last is not null").join(users.select(F.col("id").alias("user_id"), F.col("group").alias("current")), "user_id")
    down, up, before = (F.trim(F.col(f"last.{c}")) for c in ("downgrade_group", "upgrade_group", "prev_group"))
    target = F.when(down != "", down).when((up != "") & (before != "") & (F.col("current") == up), before)
    return after.where("due").drop("due"), rows.select("user_id", target.alias("target")).where("target is not null and target != ''").join(users.select(F.col("id").alias("user_id"), F.col("group").alias("current")), "user_id").where("target != current").select("user_id", "target")


def active_subscriptions(subscriptions: DataFrame, now: int) -> DataFrame:
    """Active ones of each user with their place (by end, then id, latest first) and whether all allow overflow."""
    rows = subscriptions.where((F.col("status") == "active") & (F.col("end_time") > now))
    user = Window.partitionBy("user_id")
    return rows.withColumns({"place": F.row_number().over(user.orderBy(F.desc("end_time"), F.desc("id"))), "all_overflow": F.bool_and("allow_overflow").over(user)})


def settle_tasks(tasks: DataFrame) -> DataFrame:
    """Log rows that bring charged quota to the actual one: consume for more, refund for less; negatives are ignored."""
    delta = F.col("actual_quota") - F.col("quota")
    rows = tasks.where((F.col("actual_quota") >= 0) & (delta != 0))
    return rows.select("id", "user_id", "channel_id", "token_id", F.when(delta > 0, 2).otherwise(6).alias("type"), F.abs(delta).alias("log_quota"), delta.alias("delta"))


def task_quota(tokens: Column, model_ratio: Column, group_ratio: Column, multiplier: Column) -> Column:
    """Actual quota from tokens, truncated; null without tokens or a configured ratio."""
    return F.when((tokens > 0) & (model_ratio > 0), quota_truncated(tokens * model_ratio * group_ratio * multiplier)["value"])


def refunds(tasks: DataFrame) -> DataFrame:
    """Refund rows of failed tasks that were charged."""
    return tasks.where("status = 'FAILURE' and quota != 0").select("id", "user_id", "channel_id", "token_id", F.lit(6).alias("type"), F.col("quota").alias("log_quota"), (-F.col("quota")).alias("delta"))


def net_usage(rows: DataFrame) -> DataFrame:
    """Net quota by user, channel and token of settlement rows."""
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).cast("bigint").alias("id"), F.col("delta").cast("bigint").alias("delta")) for k, c in (("user", "user_id"), ("channel", "channel_id"), ("token", "token_id"))))
    from meterlake.operators.usage import net_deltas

    return net_deltas(rows.select(F.inline(kinds)))
