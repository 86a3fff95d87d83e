"""Filters, projections, joins and paging of logs, tasks, audits and catalogs."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from meterlake.functions.scalars import text_match

#: Parts of ``other`` that a role may not see.
USER_HIDDEN = ("admin_info", "root_info", "audit_info", "channel_id", "channel_name", "channel_type", "reject_reason")
ADMIN_HIDDEN = ("root_info",)


def filter_logs(logs: DataFrame, type: int = 0, start: int = 0, end: int = 0, model: str = "", username: str = "", token_name: str = "", channel: int = 0, group: str = "", request_id: str = "", upstream_request_id: str = "") -> DataFrame:
    """Rows that fit every given filter; 0 and '' mean none; ends are inclusive. Times prune month partitions."""
    if type:
        logs = logs.where(F.col("type") == type)
    for column, value in (("model_name", model), ("username", username), ("token_name", token_name)):
        if value:
            logs = logs.where(text_match(column, value))
    for column, value in (("channel_id", channel), ("group", group), ("request_id", request_id), ("upstream_request_id", upstream_request_id)):
        if value:
            logs = logs.where(F.col(column) == value)
    if start:
        logs = logs.where(F.col("created_at") >= start)
    if end:
        logs = logs.where(F.col("created_at") <= end)
    return logs


def _members(text: str) -> dict[str, str] | None:
    """Top-level members with the raw text of their values."""
    decoder, out, at = json.JSONDecoder(), {}, 0
    space = " \t\n\r"
    try:
        if not isinstance(json.loads(text), dict):
            return None
    except ValueError:
        return None
    at = text.index("{") + 1
    while True:
        while text[at] in space + ",":
            at += 1
        if text[at] == "}":
            return out
        key, at = decoder.raw_decode(text, at)
        while text[at] in space + ":":
            at += 1
        _, end = decoder.raw_decode(text, at)
        out[key] = text[at:end]
        at = end


def _compact(raw: str) -> str:
    """Raw JSON without white space between tokens."""
    out, quoted, escaped = [], False, False
    for c in raw:
        if quoted:
            out.append(c)
            quoted, escaped = escaped or c != '"', not escaped and c == "\\"
        elif c not in " \t\n\r":
            out.append(c)
            quoted = c == '"'
    return "".join(out)


def _object(fields: dict[str, str]) -> str:
    return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_compact(v)}" for k, v in sorted(fields.items())) + "}"


def project_other(role: str) -> Column:
    """``other`` as a role sees it. Text that does not change is returned byte for byte; invalid JSON gives {}.

    Users lose the private scopes and legacy fields, admins root_info; for admin and root a legacy reject_reason
    moves into admin_info unless it has one. Changed text is compact with top-level keys sorted. Values pass as raw
    JSON text, so large integers stay exact.
    """

    def seen(text: str | None) -> str | None:
        if text is None or text == "":
            return text
        fields = _members(text)
        if fields is None:
            return text if role == "root" else "{}"
        before = dict(fields)
        for name in {"user": USER_HIDDEN, "admin": ADMIN_HIDDEN}.get(role, ()):
            fields.pop(name, None)
        if role in ("admin", "root") and "reject_reason" in fields:
            inner = _members(fields.get("admin_info", "{}"))
            if inner is not None:
                reason = fields.pop("reject_reason")
                fields["admin_info"] = _object({"reject_reason": reason} | inner)
        return text if fields == before else _object(fields)

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        return column.map(seen, na_action="ignore")

    return run("other")


def user_view(logs: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of logs as their user sees them: no channel name, public ``other``, display numbers as ids."""
    rows = page(logs, limit, offset)
    return rows.withColumns({"channel_name": F.lit(""), "other": project_other("user")})


def page(logs: DataFrame, limit: int, offset: int = 0, columnar: bool = False) -> DataFrame:
    """Rows offset + 1 to offset + limit, newest first, with display_id. A top-k, never a whole sort."""
    order = [F.desc("created_at"), F.desc("request_id" if columnar else "id")]
    top = logs.orderBy(*order).limit(offset + limit)
    numbered = top.withColumn("display_id", F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    return numbered.where(F.col("display_id") > offset)


def deep_page(logs: DataFrame, offset: int, limit: int, cells: int = 4_096, rows: int = 100_000) -> DataFrame:
    """The page that ``page`` gives, for any offset: what lies before it is counted, not sorted.

    While more than ``rows`` rows are left to skip, a histogram of ``cells`` equal ranges of created_at, within one second
    of id, tells the range where the page begins, which is then divided again. A pass brings at most cells + 1 counts
    to the driver. At last only the rows from that range on are read, down to a range where the page is known to end,
    and a top-k of at most ``rows`` + ``limit`` of them is taken. Null times and ids come last. Only rows that share
    both time and id can make it longer. An offset past the end gives an empty page.
    """
    before, within, inside, older, same, floor = 0, logs, F.lit(True), F.lit(False), F.lit(True), None
    for column in ("created_at", "id"):
        if offset - before <= rows:
            break
        low, high = within.agg(F.min(column), F.max(column)).first()
        below, value = F.lit(False), None
        while offset - before > rows and low is not None and value is None:
            width = (high - low) // cells + 1
            cell = F.coalesce(F.expr(f"({high} - `{column}`) div {width}"), F.lit(cells + 1))
            found, total = None, before
            for number, n in sorted(map(tuple, within.groupBy(cell.alias("cell")).count().collect())):
                total += n
                if found is None and total > offset:
                    found, before = number, total - n
                if column == "created_at" and total >= offset + limit and number <= cells:
                    floor = high - number * width - width + 1
                    break
            if found is None:
                return page(logs.limit(0), limit)
            if found > cells:  # nulls, the last of all
                low, below = None, F.lit(False)
                break
            high = high - found * width
            low = max(low, high - width + 1)
            within, below = within.where(F.col(column).between(low, high)), (F.col(column) < low) | F.col(column).isNull()
            value = low if low == high else None
        older = older | (same & below)
        inside = same & (F.col(column).isNull() if low is None else F.col(column).between(low, high))
        if low is None:
            within = within.where(F.col(column).isNull())
        elif value is None:
            break
        same = inside
    wanted = logs.where(inside | older)
    wanted = wanted if floor is None else wanted.where(F.col("created_at") >= floor)
    return page(wanted, limit, offset - before).withColumn("display_id", F.col("display_id") + before)


def page_after(logs: DataFrame, created_at: int, id: int, limit: int) -> DataFrame:
    """The page after a row, by key: deep pages cost as much as the first."""
    before = (F.col("created_at") < created_at) | ((F.col("created_at") == created_at) & (F.col("id") < id))
    return logs.where(before).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def capped_count(logs: DataFrame, cap: int = 10_000) -> DataFrame:
    """Number of rows, counted no further than ``cap``."""
    return logs.select(F.lit(1)).limit(cap).agg(F.count("*").alias("total"))


def recent(logs: DataFrame, limit: int, token_id: int | None = None) -> DataFrame:
    """The newest rows of one token, or of each token."""
    if token_id is not None:
        return logs.where(F.col("token_id") == token_id).orderBy(F.desc("id")).limit(limit)
    rank = F.row_number().over(Window.partitionBy("token_id").orderBy(F.desc("id")))
    return logs.withColumn("rank", rank).where(F.col("rank") <= limit).drop("rank")


def saturated() -> Column:
    """Whether ``other`` has the saturation marker as a quoted key; a path that contains the word has not."""
    return F.coalesce(F.col("other").contains('"quota_saturation":'), F.lit(False))


def redemption_state(now: int) -> Column:
    """usable, expired, used or disabled, from status (1 enabled, 3 used) and expired_time (0: never)."""
    enabled, expiry = F.col("status") == 1, F.col("expired_time")
    return F.when(enabled & (expiry != 0) & (expiry < now), "expired").when(enabled, "usable").when(F.col("status") == 3, "used").otherwise("disabled")


def timed_out(tasks: DataFrame, cutoff: int, limit: int) -> DataFrame:
    """Unfinished tasks submitted before ``cutoff``, oldest first."""
    rows = tasks.where((F.col("progress") != "100%") & ~F.col("status").isin("FAILURE", "SUCCESS") & (F.col("submit_time") < cutoff))
    return rows.orderBy("submit_time", "id").limit(limit)


def search_tasks(tasks: DataFrame, platform: str = "", channel_id: int = 0, users: list[int] | None = None, task_id: str = "", action: str = "", status: str = "", start: int = 0, end: int = 0) -> DataFrame:
    for column, value in (("platform", platform), ("channel_id", channel_id), ("task_id", task_id), ("action", action), ("status", status)):
        if value:
            tasks = tasks.where(F.col(column) == value)
    if users:
        tasks = tasks.where(F.col("user_id").isin(users))
    if start:
        tasks = tasks.where(F.col("submit_time") >= start)
    return tasks.where(F.col("submit_time") <= end) if end else tasks


#: Scopes of an audit row's ``other`` that a viewer may not see.
AUDIT_HIDDEN = {"user": ("admin_info", "root_info", "audit_info"), "admin": ("root_info",)}


def search_audits(
    audits: DataFrame, viewer: str, self_view: bool = False, user_id: int = 0, username: str = "", category: str = "", token: str = "", not_token: str = "",
    request_id: str = "", start: int = 0, end: int = 0, success: bool | None = None,
) -> DataFrame:
    """Audit rows that a viewer (root, admin or user) may see, newest first when paged; ends are inclusive.

    Below root only rows of common users and admins. Admins see ``other`` without root_info, users and everyone in
    their own view without admin_info and audit_info too; text that does not change stays byte for byte.
    """
    if viewer != "root":
        audits = audits.where(F.col("actor_role").isin("common", "admin"))
    for column, value in (("user_id", user_id), ("username", username), ("category", category), ("token_ref", token), ("request_id", request_id)):
        if value:
            audits = audits.where(F.col(column) == value)
    if not_token:
        audits = audits.where(F.col("token_ref") != not_token)
    if start:
        audits = audits.where(F.col("created_at") >= start)
    if end:
        audits = audits.where(F.col("created_at") <= end)
    if success is not None:
        audits = audits.where(F.col("success") == success)
    hidden = AUDIT_HIDDEN.get("user" if self_view or viewer not in ("root", "admin") else viewer, ())
    return audits.withColumn("other", without_members(hidden)) if hidden else audits


def without_members(names: tuple[str, ...]) -> Column:
    """``other`` without some top-level members; other text, and text without them, stays as it is."""

    def seen(text: str) -> str:
        fields = _members(text) if any(n in text for n in names) else None
        left = {k: v for k, v in (fields or {}).items() if k not in names}
        return text if fields is None or len(left) == len(fields) else _object(left)

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        return column.map(seen, na_action="ignore")

    return run("other")


def page_with_total(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """Rows offset + 1 to offset + limit in order, a top-k, with ``total``, the number of all rows."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total), F.lit(True))  # one row


def expired(rows: DataFrame, cutoff: int, column: str = "created_at") -> DataFrame:
    return rows.where(F.col(column) < cutoff)


def retained(rows: DataFrame, cutoff: int, column: str = "created_at") -> DataFrame:
    return rows.where(F.col(column) >= cutoff)


def prunable(history: DataFrame, cutoff: int) -> DataFrame:
    """Old rows that may go: never the newest of a type, and nothing at or above the newest id."""
    newest = history.groupBy("type").agg(F.max("id").alias("id"))
    last = history.agg(F.max("id").alias("last"))
    rows = history.where(F.col("created_at") < cutoff).join(newest.select("id"), "id", "left_anti")
    return rows.join(F.broadcast(last), rows["id"] < last["last"]).drop("last")


def with_channel_name(logs: DataFrame, channels: DataFrame) -> DataFrame:
    """Adds channel_name, '' where the channel is gone."""
    names = channels.select(F.col("id").alias("channel_id"), F.col("name").alias("channel_name"))
    return logs.join(names, "channel_id", "left").withColumn("channel_name", F.coalesce("channel_name", F.lit("")))


def with_token_name(flow: DataFrame, tokens: DataFrame) -> DataFrame:
    names = tokens.select(F.col("id").alias("token_id"), F.col("name").alias("token_name"))
    return flow.join(names, "token_id", "left").withColumn("token_name", F.coalesce("token_name", F.lit("")))


def with_channel_label(flow: DataFrame, channels: DataFrame) -> DataFrame:
    """Adds channel_name; without one `channel-<id>` for ids above 0, else ''."""
    names = channels.select(F.col("id").alias("channel_id"), F.nullif(F.col("name"), F.lit("")).alias("known"))
    fallback = F.when(F.col("channel_id") > 0, F.concat(F.lit("channel-"), F.col("channel_id").cast("string"))).otherwise("")
    return flow.join(names, "channel_id", "left").withColumn("channel_name", F.coalesce("known", fallback)).drop("known")


def with_owner(findings: DataFrame, tokens: DataFrame, users: DataFrame) -> DataFrame:
    """Adds token_name, user_id and username of a finding's token; findings without one stay."""
    t = tokens.select(F.col("id").alias("token_id"), F.col("name").alias("token_name"), F.col("user_id").alias("owner_id"))
    u = users.select(F.col("id").alias("owner_id"), F.col("username").alias("owner_name"))
    return findings.join(t, "token_id", "left").join(u, "owner_id", "left")


def search_models(models: DataFrame, vendors: DataFrame, keyword: str = "", vendor: str = "", status: int | None = None, sync_official: int | None = None) -> DataFrame:
    """Models whose name, description or tags hold the keyword; vendor by id or by part of its name. Pages go by id,
    newest first."""
    if keyword:
        models = models.where(F.col("model_name").contains(keyword) | F.col("description").contains(keyword) | F.col("tags").contains(keyword))
    if vendor.isdigit():
        models = models.where(F.col("vendor_id") == int(vendor))
    elif vendor:
        models = models.join(vendors.where(F.col("name").contains(vendor)).select(F.col("id").alias("vendor_id")), "vendor_id", "left_semi")
    for column, value in (("status", status), ("sync_official", sync_official)):
        if value is not None:
            models = models.where(F.col(column) == value)
    return models
