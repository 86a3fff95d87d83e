"""Merkle manifests of a table with proofs by pointer jumping, in DataFrame operations only.

Rows are leaves. In each source the leaves ascend by id, and every ARITY consecutive nodes make a run whose digest is a
node of the next level, until one node, the subroot, is left; the subroots in order of their sources make a tree of the
same kind, whose last node is the root. All leaves of a run share the segments above it, so proofs are built for runs:
a run's row holds a pointer to an ancestor and the siblings on the way there. Each self-join takes the ancestor's own
segments and pointer, which doubles the distance, so the logarithm of the depth is the number of joins after which all
runs point to the root. A leaf's proof is its siblings in its run and the run's segments.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from meterlake.llm.scratch import Scratch

#: Nodes of a run.
ARITY = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "array<struct<place:int,siblings:array<string>>>"
TOP, ROOT = -1, "root"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts' UTF-8 bytes."""
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(*values: Column) -> Column:
    """Digest of values in order: each is ``-`` if null, else its UTF-8 byte count, ``:`` and itself as text."""
    own = [v.cast("string") for v in values]
    return digest(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in own))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its proof lead to."""
    join = lambda nodes: F.array_join(nodes, "")
    return F.aggregate(
        proof,
        leaf,
        lambda own, step: digest(
            join(F.slice(step["siblings"], F.lit(1), step["place"])),
            own,
            join(F.slice(step["siblings"], step["place"] + 1, F.lit(ARITY))),
        ),
    )


def proof_digest(proof: Column) -> Column:
    """Digest of all siblings of a proof, from the leaf's run to the root's, left to right."""
    return digest(F.array_join(F.flatten(F.transform(proof, lambda step: step["siblings"])), ""))


def numbered(rows: DataFrame, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """Adds ``number``, from 0 in ascending order (nulls first): rows are ranged into partitions and sorted there, and
    prefix sums over the partitions' sizes give where each begins. Rows alike in ``order`` come in any order."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    table = scratch.keep(ranged.withColumn("mark", F.monotonically_increasing_id()), name)
    sizes = table.groupBy(F.shiftright("mark", 33).alias("part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))  # a row a partition
    placed = table.join(F.broadcast(starts), F.shiftright("mark", 33) == F.col("part"))
    place = F.col("start") + F.col("mark").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.select(*rows.columns, place.alias("number"))


def _node(tree: Column, level: int, place: Column) -> Column:
    return F.concat_ws("/", tree, F.lit(level), place)


def _above(n: Column) -> Column:
    """Nodes of the next level."""
    return F.ceil(n / ARITY).cast("bigint")


def _runs(nodes: DataFrame) -> DataFrame:
    """(tree, n, run, members) of nodes (tree, n, place, digest), where a tree has ``n`` nodes, more than one."""
    member = F.struct((F.col("place") % ARITY).alias("at"), "digest")
    runs = nodes.groupBy("tree", "n", F.expr(f"place div {ARITY}").alias("run"))
    members = runs.agg(F.array_sort(F.collect_list(member)).alias("members"))  # ARITY at most
    return members.withColumn("members", F.col("members.digest"))


def _climb(nodes: DataFrame, level: int, most: int, parent, scratch: Scratch) -> tuple[list[DataFrame], list[DataFrame]]:
    """(tables of pointers, tables of last nodes): all levels from ``level`` up, for trees of at most ``most`` nodes
    there. A pointer is (id, up, steps, digest): a node, its parent, and its siblings on the way."""
    pointers, last = [], []
    while True:
        last.append(nodes.where("n = 1"))
        if most <= 1:
            return pointers, last
        runs = scratch.keep(_runs(nodes.where("n > 1")), f"level-{level}")
        each = runs.select("tree", "n", "run", "members", F.posexplode("members").alias("at", "digest"))
        siblings = F.filter("members", lambda m, k: k != F.col("at"))
        pointers.append(
            each.select(
                _node(F.col("tree"), level, F.col("run") * ARITY + F.col("at")).alias("id"),
                parent(F.col("tree"), level + 1, F.col("run"), _above(F.col("n"))).alias("up"),
                F.array(F.struct(F.col("at").alias("place"), siblings.alias("siblings"))).alias("steps"),
                "digest",
            )
        )
        nodes = runs.select(
            "tree",
            _above(F.col("n")).alias("n"),
            F.col("run").alias("place"),
            digest(F.array_join("members", "")).alias("digest"),
        )
        level, most = level + 1, -(-most // ARITY)


def _within(tree: Column, level: int, place: Column, n: Column) -> Column:
    """Id of a node in a source's tree; a subroot is a node of the top tree."""
    return F.when(n == 1, _node(F.lit(TOP), 0, tree)).otherwise(_node(tree, level, place))


def _on_top(tree: Column, level: int, place: Column, n: Column) -> Column:
    return F.when(n == 1, F.lit(ROOT)).otherwise(_node(tree, level, place))


def _jumped(pointers: DataFrame, depth: int, scratch: Scratch) -> DataFrame:
    """Pointers that all lead to the root, with the segments of the whole way."""
    for _ in range(math.ceil(math.log2(max(1, depth)))):
        there, far = pointers.where(F.col("up") == ROOT), pointers.where(F.col("up") != ROOT)
        next_ = pointers.select(*(F.col(c).alias(f"next_{c}") for c in pointers.columns))
        moved = far.join(next_, F.col("up") == F.col("next_id")).select(
            "id",
            F.col("next_up").alias("up"),
            F.concat("steps", "next_steps").alias("steps"),
            F.coalesce("subroot", "next_subroot").alias("subroot"),
        )
        after = scratch.keep(there.unionByName(moved), "jumped")
        scratch.drop(pointers)
        pointers = after
    return pointers


def manifest(
    docs: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    fields: tuple[str, ...] = FIELDS,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """(``carry``, doc_id, leaf, subroot, root, proof): one row per input row.

    A leaf's digest covers ``fields``, nulls told apart from empty texts. ``proof``: a step for each run on the way to
    the root, with the leaf's (then its ancestor's) place in the run and the digests of the run's other nodes. Sources
    are ordered by their text, null first; ids ascend, null first, and rows of one id by their leaves' digests; rows
    alike in all fields are leaves each. A lone leaf is its subroot, a lone subroot the root. An empty table gives an
    empty one. Carried columns (of types that can be ordered) keep their names unless one of the results has it.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    kept = [c for c in carry if c not in ("doc_id", "leaf", "subroot", "root", "proof")]
    body = F.struct(F.col(f"`{doc_id}`").alias("doc_id"), *(F.col(f"`{c}`").alias(f"kept_{k}") for k, c in enumerate(kept)))
    leaves = docs.select(
        F.col(f"`{source}`").cast("string").alias("source"),
        F.col(f"`{doc_id}`").alias("own_id"),
        leaf_digest(*(F.col(f"`{c}`") for c in fields)).alias("digest"),
        body.alias("body"),
    )
    leaves = numbered(scratch.keep(leaves, "leaves"), ["source", "own_id", "digest"], scratch, "ranged")
    sizes = leaves.groupBy("source").agg(F.min("number").alias("first"), F.count("*").alias("n"))
    sources = numbered(scratch.keep(sizes, "sizes"), ["first"], scratch, "sources").withColumnRenamed("number", "tree")
    n_sources, most = sources.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()

    inside = leaves.join(sources.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    place = F.col("number") - F.col("first")
    entry = F.struct((place % ARITY).cast("int").alias("at"), "digest", "body")
    runs = inside.groupBy("tree", "n", F.floor(place / ARITY).alias("run"))
    bottom = scratch.keep(runs.agg(F.array_sort(F.collect_list(entry)).alias("leaves")), "runs")  # ARITY a run at most

    whole = digest(F.array_join(F.col("leaves.digest"), ""))
    nodes = bottom.select(
        "tree",
        _above(F.col("n")).alias("n"),
        F.col("run").alias("place"),
        F.when(F.col("n") == 1, F.col("leaves")[0]["digest"]).otherwise(whole).alias("digest"),
    )
    below, last = _climb(nodes, 1, -(-most // ARITY), _within, scratch)
    subroots = last[0]
    for found in last[1:]:
        subroots = subroots.unionByName(found)
    subroots = subroots.select(
        F.lit(TOP).cast("bigint").alias("tree"), F.lit(n_sources).alias("n"), F.col("tree").alias("place"), "digest"
    )
    subroots = scratch.keep(subroots, "subroots")
    above, roots = _climb(subroots, 0, n_sources, _on_top, scratch)
    root = roots[-1].select("digest").first()

    none = F.lit(None).cast("string")
    steps = [t.select("id", "up", "steps", none.alias("subroot")) for t in below]
    for k, t in enumerate(above):
        steps.append(t.select("id", "up", "steps", (none if k else F.col("digest")).alias("subroot")))
    runs = bottom.withColumn("id", _within(F.col("tree"), 1, F.col("run"), _above(F.col("n"))))
    if steps:
        pointers = steps[0]
        for t in steps[1:]:
            pointers = pointers.unionByName(t)
        runs = runs.join(_jumped(scratch.keep(pointers, "pointers"), len(steps), scratch), "id", "left")
    else:
        runs = runs.withColumns({"steps": F.lit(None).cast(PROOF), "subroot": none})
    rows = runs.select("n", "steps", "subroot", F.col("leaves.digest").alias("members"), F.explode("leaves").alias("entry"))
    siblings = F.filter("members", lambda m, k: k != F.col("entry.at"))
    first = F.array(F.struct(F.col("entry.at").alias("place"), siblings.alias("siblings"))).cast(PROOF)
    empty = F.array().cast(PROOF)
    proof = F.concat(F.when(F.col("n") > 1, first).otherwise(empty), F.coalesce("steps", empty))
    top = F.lit(root[0] if root else None).cast("string")
    return rows.select(
        *(F.col(f"entry.body.kept_{k}").alias(c) for k, c in enumerate(kept)),
        F.col("entry.body.doc_id").alias("doc_id"),
        F.col("entry.digest").alias("leaf"),
        F.coalesce("subroot", top).alias("subroot"),
        top.alias("root"),
        proof.alias("proof"),
    )


def tamper_check(docs: DataFrame) -> DataFrame:
    """Digests of the manifest of ``documents``, and which leaves still lead to the root where each fifth id by hash had
    its text's A-Z lower-cased."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    changed = leaf_digest(*(F.translate(c, upper, lower) if c == "text" else F.col(c) for c in FIELDS))
    made = manifest(docs.withColumn("changed", F.when(hit, changed)), carry=("changed",))
    found = fold(F.coalesce("changed", "leaf"), F.col("proof"))
    rows = made.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), found.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql(levels: int = 6, top_levels: int = 4) -> str:
    """DuckDB SQL of ``tamper_check``, its levels written out: enough for 16**6 leaves a source and 16**4 sources."""
    value = lambda c: f"COALESCE(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(value(text if c == "text" else c) for c in FIELDS) + ")"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    digits = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = f"""xor(4294967295, list_reduce(list_prepend(4294967295, {digits}), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x)
      WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))"""
    out = [
        f"""hashed AS (SELECT doc_id, source, {leaf("text")} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf(lowered)} END AS changed FROM documents)""",
        """trees AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) AS n FROM hashed GROUP BY source)""",
        """path0 AS (SELECT h.doc_id, h.leaf, t.tree, t.n, COALESCE(changed, leaf) AS folded, '' AS proof,
  row_number() OVER (PARTITION BY t.tree ORDER BY h.doc_id NULLS FIRST, h.leaf) - 1 AS place
  FROM hashed h JOIN trees t ON h.source IS NOT DISTINCT FROM t.source)""",
        "node0 AS (SELECT tree, n, place, leaf AS digest FROM path0)",
    ]

    def climb(k):
        out.append(f"""run{k} AS (SELECT tree, n, place // 16 AS run, list(digest ORDER BY place) AS members FROM node{k} GROUP BY ALL)""")
        out.append(f"""node{k + 1} AS (SELECT tree, (n + 15) // 16 AS n, run AS place,
  CASE WHEN n = 1 THEN members[1] ELSE sha256(array_to_string(members, '')) END AS digest FROM run{k})""")
        before, after = "array_to_string(members[: place % 16], '')", "array_to_string(members[place % 16 + 2 :], '')"
        keep = "doc_id, leaf" + (", subroot, source_tree" if k > levels else "")
        out.append(f"""path{k + 1} AS (SELECT {keep}, p.tree, (p.n + 15) // 16 AS n, place // 16 AS place,
  CASE WHEN p.n = 1 THEN proof ELSE proof || {before} || {after} END AS proof,
  CASE WHEN p.n = 1 THEN folded ELSE sha256({before} || folded || {after}) END AS folded
  FROM path{k} p JOIN run{k} r ON p.tree = r.tree AND place // 16 = run)""")

    for k in range(levels):
        climb(k)
    k = levels + 1
    out.append(f"node{k} AS (SELECT -1 AS tree, (SELECT count(*) FROM trees) AS n, tree AS place, digest FROM node{levels})")
    out.append(f"""path{k} AS (SELECT doc_id, leaf, d.digest AS subroot, p.tree AS source_tree, -1 AS tree, (SELECT count(*) FROM trees) AS n,
  p.tree AS place, proof, folded FROM path{levels} p JOIN node{levels} d ON p.tree = d.tree)""")
    for k in range(levels + 1, levels + 1 + top_levels):
        climb(k)
    k = levels + 1 + top_levels
    return "WITH " + ",\n".join(out) + f"""
SELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = digest AS verified
FROM path{k} CROSS JOIN node{k}"""


#: The same rows in DuckDB, over ``documents``.
SQL = _sql()
