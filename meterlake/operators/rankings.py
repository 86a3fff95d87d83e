"""Leaderboards of models and vendors, movers, histories, and chart series.

Places in a list of any length come from ranges of it: each range is ordered on its own, and the counts of the ranges
say where it begins. Global windows run only over lists of a fixed length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from meterlake.functions.scalars import QUOTA_PER_UNIT, ratio, rounded


#: Ranges that a list is cut into, and rows of the sample that sets their ends, a range.
RANGES, EACH = 256, 16


def growth(now: Column, before: Column) -> Column:
    """Per cent at 4 digits; 100 if it rose from nothing, 0 if it stayed nothing."""
    return F.when(before > 0, rounded((now - before).cast("double") / before * 100, 4)).when(now > 0, F.lit(100.0)).otherwise(F.lit(0.0))


def period_totals(cube: DataFrame, start: int, end: int, before: int, before_end: int) -> DataFrame:
    """(model_name, tokens, previous) of two windows in one scan of the cube."""
    now, then = F.col("created_at").between(start, end), F.col("created_at").between(before, before_end)
    rows = cube.where((now | then) & (F.col("model_name") != ""))
    total = rows.groupBy("model_name").agg(*(F.coalesce(F.sum(F.when(w, F.col("token_used"))), F.lit(0)).alias(n) for w, n in ((now, "tokens"), (then, "previous"))))
    return total.where("tokens > 0 or previous > 0")


def with_vendor(models: DataFrame, meta: DataFrame, vendors: DataFrame) -> DataFrame:
    """Adds the vendor: name by id, else the owner's text, else Unknown."""
    m = meta.select("model_name", "vendor_id", "owner").join(vendors.select(F.col("id").alias("vendor_id"), F.col("name").alias("vendor_name")), "vendor_id", "left")
    empty = lambda c: F.nullif(F.col(c), F.lit(""))
    return models.join(m.drop("vendor_id"), "model_name", "left").withColumn("vendor", F.coalesce(empty("vendor_name"), empty("owner"), F.lit("Unknown"))).drop("vendor_name", "owner")


def _cell(key: Column, ends: Column) -> Column:
    """The range of ``key``: how many ends lie before it."""
    return F.size(F.filter(ends, lambda end: end < key))


def _counts(rows: DataFrame, cells: dict[str, Column]) -> DataFrame:
    """(list, cell, n, upto): rows of each range of each list, and of it and all before it."""
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("list"), c.alias("cell")) for name, c in cells.items())))
    counts = rows.select(each.alias("at")).groupBy("at.list", "at.cell").agg(F.count("*").alias("n"))
    return counts.withColumn("upto", F.sum("n").over(Window.partitionBy("list").orderBy("cell")))  # RANGES rows


def numbered(rows: DataFrame, orders: dict[str, list[Column]], ranges: int = RANGES) -> DataFrame:
    """Adds for each of ``orders`` the number of the row, from 1, if rows are sorted by it, ascending, nulls first.

    No task gets all rows: the ends of ``ranges`` ranges come from the rows whose hashes are least, so equal values are
    cut by the columns that follow them. Rows that no column of an order tells apart have numbers in any order, and
    share a range.
    """
    keys = {name: F.struct(*(c.alias(f"k{k}") for k, c in enumerate(by))) for name, by in orders.items()}
    held = rows.withColumns({f"{name}_key": key for name, key in keys.items()})
    parts = [f"{name}_key" for name in orders]
    sample = held.select(*parts).orderBy(F.xxhash64(*parts), *parts).limit(ranges * EACH)
    every = lambda name: F.filter(F.array_sort(F.collect_list(f"{name}_key")), lambda _, k: k % EACH == EACH - 1)
    ends = sample.agg(*(every(name).alias(f"{name}_ends") for name in orders))  # one row
    placed = held.join(F.broadcast(ends), F.lit(True))
    placed = placed.withColumns({f"{name}_cell": _cell(F.col(f"{name}_key"), F.col(f"{name}_ends")) for name in orders})
    counts = _counts(placed, {name: F.col(f"{name}_cell") for name in orders})
    for name in orders:
        cell = f"{name}_cell"
        start = counts.where(F.col("list") == name).select(F.col("cell").alias(cell), (F.col("upto") - F.col("n")).alias("before"))
        own = F.row_number().over(Window.partitionBy(cell).orderBy(f"{name}_key"))
        # a row a range
        placed = placed.join(F.broadcast(start), cell).withColumn(name, F.col("before") + own).drop("before")
    return placed.select(*rows.columns, *orders)


def _with_shares(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """Adds the share of the tokens of all ``totals`` that have some, and the growth."""
    all_tokens = totals.agg(F.sum(F.when(F.col("tokens") > 0, F.col("tokens"))).alias("all_tokens"))  # one row
    share = rounded(ratio(F.col("tokens"), F.col("all_tokens")), 4)
    rows = rows.join(F.broadcast(all_tokens), F.lit(True))
    return rows.withColumns({"share": share, "growth": growth(F.col("tokens"), F.col("previous"))}).drop("all_tokens")


def _by(value: str, name: str) -> list[Column]:
    return [F.negate(F.col(value)), F.col(name)]


def ranked_models(totals: DataFrame) -> DataFrame:
    """All models with tokens now: rank, previous_rank (null if it had none), share and growth."""
    rows = numbered(totals, {"rank": _by("tokens", "model_name"), "previous_rank": _by("previous", "model_name")})
    earlier = F.when(F.col("previous") > 0, F.col("previous_rank"))
    return _with_shares(rows.withColumn("previous_rank", earlier).where("tokens > 0"), totals)


def model_leaderboard(totals: DataFrame, limit: int = 20) -> DataFrame:
    """The first ``limit`` of the ranked models: a top-k, whose earlier ranks are counts of the models before each."""
    top = totals.where("tokens > 0").orderBy(F.desc("tokens"), "model_name").limit(limit)
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("tokens"), "model_name")))  # limit rows
    key = F.struct(*_by("previous", "model_name"))
    ends = F.broadcast(top.agg(F.array_sort(F.collect_list(key)).alias("ends")))  # one row
    at = _cell(key, F.col("ends"))
    # a model of the list is the last of its own range, so that as many are before it
    counts = _counts(totals.where("previous > 0").join(ends, F.lit(True)), {"previous": at})
    earlier = counts.select("cell", F.col("upto").alias("previous_rank"))
    rows = top.join(ends, F.lit(True)).withColumn("cell", at).join(F.broadcast(earlier), "cell", "left")
    rows = rows.withColumn("previous_rank", F.when(F.col("previous") > 0, F.col("previous_rank"))).drop("cell", "ends")
    return _with_shares(rows, totals)


def vendor_leaderboard(totals: DataFrame) -> DataFrame:
    """Vendors with tokens now, by tokens and name; ``totals`` has a vendor column."""
    top = F.min_by("model_name", F.struct(-F.col("tokens"), "model_name"))
    sums = (F.sum(c).alias(c) for c in ("tokens", "previous"))
    counted = F.count_if(F.col("tokens") > 0).alias("models_count")
    rows = totals.groupBy("vendor").agg(*sums, counted, top.alias("top_model")).where("tokens > 0")
    return _with_shares(numbered(rows, {"rank": _by("tokens", "vendor")}), rows)


def movers(ranked: DataFrame, limit: int = 6) -> DataFrame:
    """The models that rose and fell most among all ranked ones: direction, delta and place."""
    rows = ranked.withColumn("delta", F.col("previous_rank") - F.col("rank")).where("delta != 0")
    rows = rows.withColumn("direction", F.when(F.col("delta") > 0, "up").otherwise("down"))
    order = Window.partitionBy("direction").orderBy(F.desc(F.abs("delta")), F.desc(F.abs("growth")), "model_name")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("direction", "place", "model_name", "rank", "previous_rank", "delta", "growth")


def folded(rows: DataFrame, name: str, value: str, by: list[str], limit: int, other: str) -> DataFrame:
    """Sums of ``value`` by ``by`` and ``name``, all names but the ``limit`` with the largest totals as ``other``."""
    totals = rows.groupBy(name).agg(F.sum(value).alias("total"))
    top = totals.withColumn("place", F.row_number().over(Window.orderBy(F.desc("total"), name))).where(F.col("place") <= limit).select(F.col(name), F.col(name).alias("kept"))
    # the top list has ``limit`` rows
    joined = rows.join(F.broadcast(top), name, "left")
    return joined.groupBy(*by, F.coalesce("kept", F.lit(other)).alias(name)).agg(F.sum(value).alias(value)).where(F.col(value) > 0)


def model_history(buckets: DataFrame, limit: int = 10) -> DataFrame:
    return folded(buckets, "model_name", "tokens", ["bucket"], limit, "Others")


def vendor_history(buckets: DataFrame, limit: int = 5) -> DataFrame:
    """Tokens of vendors by bucket and their share of the bucket."""
    rows = folded(buckets, "vendor", "tokens", ["bucket"], limit, "Others")
    return rows.withColumn("share", rounded(ratio(F.col("tokens"), F.sum("tokens").over(Window.partitionBy("bucket"))), 4))


def chart_key(column: str, grain: str) -> Column:
    """Axis label in UTC: MM-DD, with HH:00 for hours, and the day six days later for weeks."""
    at = F.timestamp_seconds(column)
    day = F.date_format(at, "MM-dd")
    if grain == "hour":
        return F.concat(day, F.lit(" "), F.date_format(at, "HH"), F.lit(":00"))
    if grain == "week":
        return F.concat(day, F.lit(" - "), F.date_format(F.timestamp_seconds(F.col(column) + 6 * 86400), "MM-dd"))
    return day


def dense_grid(rows: DataFrame, time: str, name: str, values: list[str], step: int, least: int = 7) -> DataFrame:
    """One row per time and name, zeros filled in; with under ``least`` times, the axis is ``least`` steps to the last."""
    axis = rows.select(F.col(time)).distinct()
    span = axis.agg(F.count("*").alias("n"), F.max(time).alias("last"))
    steps = F.transform(F.sequence(F.lit(least - 1), F.lit(0), F.lit(-1)), lambda k: F.col("last") - k * step)
    short = span.where((F.col("n") < least) & (F.col("n") > 0)).select(F.explode(steps).alias(time))
    long = axis.join(F.broadcast(span.where(F.col("n") >= least)), F.lit(True)).select(time)
    names = rows.select(name).distinct()
    grid = short.unionByName(long).join(names, F.lit(True))  # the result's own size: the optimiser picks the side to send
    sums = rows.groupBy(time, name).agg(*(F.sum(v).alias(v) for v in values))
    return grid.join(sums, [time, name], "left").select(time, name, *(F.coalesce(v, F.lit(0)).alias(v) for v in values))


def area_series(cube: DataFrame, size: int, limit: int = 15) -> DataFrame:
    """Quota in USD at 4 digits by bucket, top models and Other."""
    rows = cube.select(F.expr(f"created_at div {size} * {size}").alias("bucket"), "model_name", "quota")
    return folded(rows, "model_name", "quota", ["bucket"], limit, "Other").withColumn("usd", rounded(F.col("quota").cast("double") / QUOTA_PER_UNIT, 4))


def count_series(cube: DataFrame, size: int, limit: int = 20) -> DataFrame:
    rows = cube.select(F.expr(f"created_at div {size} * {size}").alias("bucket"), "model_name", "count")
    return folded(rows, "model_name", "count", ["bucket"], limit, "Other")


def count_shares(cube: DataFrame, limit: int = 20) -> DataFrame:
    """Calls of each top model and Other, and their share of all."""
    rows = folded(cube, "model_name", "count", [], limit, "Other")
    return rows.withColumn("share", rounded(ratio(F.col("count"), F.sum("count").over(Window.partitionBy())), 4))


def user_trend(cube: DataFrame, size: int, limit: int = 10) -> DataFrame:
    """Quota by bucket of the users with the most, zeros filled in."""
    top = cube.groupBy("username").agg(F.sum("quota").alias("total")).orderBy(F.desc("total"), "username").limit(limit).select("username")
    rows = cube.join(F.broadcast(top), "username").select(F.expr(f"created_at div {size} * {size}").alias("bucket"), "username", "quota")
    return dense_grid(rows, "bucket", "username", ["quota"], size, least=1)
