"""Flow graphs from cube rows: paths, filters, top nodes, nodes and links. Input is aggregated, so one row a path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from meterlake.functions.scalars import ratio

#: Stages of each role, and metrics of a row.
STAGES = {"root": ["user", "node", "token", "group", "model", "channel"], "admin": ["user", "group", "model", "channel"], "user": ["token", "group", "model"]}
METRICS = {"quota": "quota", "tokens": "token_used", "requests": "count"}


def stages_of(role: str, visible: list[str] | None = None) -> list[str]:
    """Visible stages of a role in order; hiding all but one shows all."""
    own = STAGES.get(role, STAGES["user"])
    chosen = [s for s in own if visible is None or s in visible]
    return chosen if len(chosen) >= 2 else own


def node(kind: str) -> Column:
    """struct(kind, id, label) of a row; the id falls back from id to name to `unknown`."""
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    by_id = lambda c, name: F.when(F.col(c) > 0, F.col(c).cast("string")).otherwise(F.coalesce(text(name), F.lit("unknown")))
    numbered = lambda c, unknown: F.when(F.col(c) > 0, F.concat(F.lit(f"{kind}-"), F.col(c).cast("string"))).otherwise(unknown)
    id, label = {
        "user": lambda: (by_id("user_id", "username"), F.coalesce(text("username"), numbered("user_id", "Unknown User"))),
        "node": lambda: (F.coalesce(text("node_name"), F.lit("default-node")),) * 2,
        "token": lambda: (by_id("token_id", "token_name"), F.coalesce(text("token_name"), numbered("token_id", "Unknown Token"))),
        "group": lambda: (F.coalesce(text("use_group"), F.lit("unknown")),) * 2,
        "model": lambda: (F.coalesce(text("model_name"), F.lit("unknown")), F.coalesce(text("model_name"), F.lit("Unknown Model"))),
        "channel": lambda: (by_id("channel_id", "channel_name"), F.coalesce(text("channel_name"), numbered("channel_id", "Unknown"))),
    }[kind]()
    return F.struct(F.lit(kind).alias("kind"), F.concat(F.lit(f"{kind}:"), id).alias("id"), label.alias("label"))


def paths(rows: DataFrame, stages: list[str]) -> DataFrame:
    """(path, quota, tokens, requests): the nodes of each row, rows of equal paths added up."""
    built = rows.select(F.array(*map(node, stages)).alias("path"), *(F.col(c).alias(m) for m, c in METRICS.items()))
    return built.groupBy("path").agg(*(F.sum(m).alias(m) for m in METRICS))


def filtered(paths: DataFrame, chosen: dict[str, list[str]]) -> DataFrame:
    """Paths with one of the chosen ids of every kind that has any."""
    for ids in chosen.values():
        if ids:
            paths = paths.where(F.exists("path", lambda n: n["id"].isin(ids)))
    return paths


def node_totals(paths: DataFrame) -> DataFrame:
    return paths.select(F.explode("path").alias("node"), *METRICS).groupBy("node.kind", "node.id", "node.label").agg(*(F.sum(m).alias(m) for m in METRICS))


def limited(paths: DataFrame, metric: str, limit: int, hide: bool = False) -> DataFrame:
    """Only the top nodes of each stage stay; others become `<kind>:__other__`, or take their paths with them.

    Node totals are of all paths. The kept ids, ``limit`` a stage, are few and are broadcast.
    """
    totals = node_totals(paths)
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc(metric), "label", "id"))
    top = totals.withColumn("rank", rank).where(F.col("rank") <= limit).agg(F.coalesce(F.collect_set("id"), F.array().cast("array<string>")).alias("top"))
    joined = paths.join(F.broadcast(top), F.lit(True))
    kept = lambda n: F.array_contains("top", n["id"])
    if hide:
        return joined.where(F.forall("path", kept)).drop("top")
    other = lambda n: F.struct(n["kind"].alias("kind"), F.concat(n["kind"], F.lit(":__other__")).alias("id"), F.lit("Other").alias("label"))
    folded = joined.withColumn("path", F.transform("path", lambda n: F.when(kept(n), n).otherwise(other(n))))
    return folded.groupBy("path").agg(*(F.sum(m).alias(m) for m in METRICS))


def links(paths: DataFrame, metric: str = "quota") -> DataFrame:
    """(source, target, metrics, share): sums of neighbouring nodes; share of what leaves the first stage."""
    pairs = F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("a"), F.slice("path", 2, F.size("path")).alias("b"))
    steps = paths.select(F.posexplode(pairs).alias("at", "pair"), *METRICS)
    rows = steps.groupBy(F.col("pair.a.id").alias("source"), F.col("pair.b.id").alias("target")).agg(F.min("at").alias("at"), *(F.sum(m).alias(m) for m in METRICS))
    total = F.sum(F.when(F.col("at") == 0, F.col(metric))).over(Window.partitionBy())
    return rows.withColumn("share", ratio(F.col(metric), total)).drop("at")


def masked(nodes: DataFrame) -> DataFrame:
    """Labels of models and of Other stay; all others are hidden, ids are not changed."""
    return nodes.withColumn("label", F.when((F.col("kind") == "model") | F.col("id").endswith(":__other__"), F.col("label")).otherwise("***"))


def option_totals(rows: DataFrame, stages: list[str], chosen: dict[str, list[str]]) -> DataFrame:
    """Node totals of each stage under the filters of the other stages."""
    whole, out = paths(rows, stages), None
    for stage in stages:
        others = {k: v for k, v in chosen.items() if k != stage}
        part = node_totals(filtered(whole, others)).where(F.col("kind") == stage)
        out = part if out is None else out.unionAll(part)
    return out


def summary(paths: DataFrame) -> DataFrame:
    return paths.agg(*(F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in METRICS))
