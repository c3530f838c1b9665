"""Merkle manifest of a dataset, with proofs by pointer jumping.

Every document is a leaf. Per source the leaves form a tree of runs of three,
and the sources' subroots, in order, form the tree on top. A node's link holds
its ancestor at some distance and the siblings met on the way there. Joining
the links with themselves doubles that distance and concatenates the siblings,
so a proof of ``d`` levels takes ``log2(d)`` joins.

Nodes are named by ``(t, k, i)``: the tree (a source's number, or ``TOP``),
the level and the place in it. A subroot carries its name in the top tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickpath.llm.store import release, ship, stored

RUN = 3
TOP = -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field_code(value: Column) -> Column:
    """``-`` for null, else the length in UTF-8 bytes, a colon and the value; no two rows of fields share their codes joined."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[field_code(c) for c in fields]), 256)


def numbered(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``i``, a row's place from 0 among the rows of its group in ascending order (nulls first), and ``n``, their number.

    Rows are range-partitioned by group and order, so that a hot group spreads
    over many tasks; a place is the rank within the partition plus the
    counts of the partitions before. Equal rows are told apart by where they
    are stored, so they spread as well.
    """
    spark = df.sparkSession
    keys = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    spread = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys, "_tie").sortWithinPartitions(*keys, "_tie").drop("_tie")
    spread = stored(spark, spread.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), "spread")
    # one row for each partition and group in it
    counts = spread.groupBy("_part", *group).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    by_group = Window.partitionBy(*group)
    counts = counts.withColumn("n", F.sum("_n").over(by_group))
    counts = counts.withColumn("_before", F.sum("_n").over(by_group.orderBy("_part")) - F.col("_n"))
    counts = stored(spark, counts.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_{c}") for c in group], "_first", "_before", "n"), "places")
    same = F.col("_part") == F.col("_p")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    out = spread.join(counts, same).withColumn("i", F.col("_at") - F.col("_first") + F.col("_before"))
    out = stored(spark, out.select(*df.columns, "i", "n"), "numbered")
    release(spread, counts)
    return out


def _levels(n: int) -> int:
    k = 0
    while n > 1:
        n, k = -(-n // RUN), k + 1
    return k


def _runs(nodes: DataFrame) -> DataFrame:
    """The level above ``nodes (t, i, n, h)``: ``(t, i, n, kids, h)``."""
    kids = F.transform(F.sort_array(F.collect_list(F.struct("i", "h"))), lambda x: x["h"])
    up = nodes.groupBy("t", F.expr(f"i div {RUN}").alias("up")).agg(F.max("n").alias("n"), kids.alias("kids"))
    return up.select("t", F.col("up").alias("i"), F.expr(f"(n + {RUN - 1}) div {RUN}").alias("n"), "kids", F.sha2(F.array_join("kids", ""), 256).alias("h"))


def _step(kids: Column, at: Column) -> Column:
    """The siblings of the run's member ``at``: the digests to its left and to its right, joined."""
    return F.struct(F.array_join(F.slice(kids, 1, at), "").alias("l"), F.array_join(F.slice(kids, at + 2, F.lit(RUN)), "").alias("r"))


def _links(runs: DataFrame, k: int) -> DataFrame:
    """One link from each node of level ``k`` to its parent in ``runs``."""
    ends = (F.col("n") == 1) & (F.col("t") != TOP)
    kids = runs.select("*", F.posexplode("kids").alias("at", "kid"))
    return kids.select("t", F.lit(k).alias("k"), (F.col("i") * RUN + F.col("at")).alias("i"), *_parent(ends, k + 1), F.array(_step(F.col("kids"), F.col("at"))).alias("steps"))


def _parent(ends: Column, k: int) -> list[Column]:
    """The name of the run: a subroot (``ends``) is the node of the top tree at its source's number."""
    name = ((F.lit(TOP).cast("long"), F.col("t")), (F.lit(0), F.lit(k)), (F.col("t"), F.col("i")))
    return [F.when(ends, a).otherwise(b).alias(c) for (a, b), c in zip(name, ("pt", "pk", "pi"))]


def _joined(links: DataFrame, above: DataFrame) -> DataFrame:
    """``links`` led on by the links of the nodes that they point to; those that point to the root stay."""
    far = above.select(F.col("t").alias("_t"), F.col("k").alias("_k"), F.col("i").alias("_i"), F.col("pt").alias("_pt"), F.col("pk").alias("_pk"), F.col("pi").alias("_pi"), F.col("steps").alias("_steps"))
    out = links.join(far, (F.col("pt") == F.col("_t")) & (F.col("pk") == F.col("_k")) & (F.col("pi") == F.col("_i")), "left")
    keep = [c for c in links.columns if c not in ("pt", "pk", "pi", "steps")]
    return out.select(*keep, *[F.coalesce(f"_{c}", c).alias(c) for c in ("pt", "pk", "pi")],
                      F.when(F.col("_steps").isNull(), F.col("steps")).otherwise(F.concat("steps", "_steps")).alias("steps"))


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, carry: dict[str, Column] | None = None) -> DataFrame:
    """``(doc_id, source, *carry, leaf, subroot, root, steps)`` for every row of ``docs``.

    The first of ``fields`` orders the leaves of a source, the second is the
    source; a leaf hashes all of them. ``steps`` is the proof, from the leaf
    to the root: for each level the digests left and right of the node's own
    in its run, joined. ``carry`` are further columns over ``docs``, computed
    in the pass that reads it. Null ids come first within their source, null
    sources are a source and come first; rows of the same id are ordered by
    their leaf, so repeated rows are leaves of their own. Texts of any length
    are one hash. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    order, source = fields[:2]
    extra = carry or {}
    names = [f"carry_{k}" for k in range(len(extra))]
    leaves = stored(spark, docs.select(F.col(order).alias("doc_id"), F.col(source).alias("source"), leaf_hash([F.col(c) for c in fields]).alias("h"),
                                       *[c.alias(n) for n, c in zip(names, extra.values())]), "leaves")
    placed = numbered(leaves, ["source"], ["doc_id", "h"])
    release(leaves)
    sources = numbered(placed.where("i = 0").select("source", F.col("n").alias("m")), [], ["source"])
    most, n_sources = sources.agg(F.max("m"), F.count("*")).first()
    if not n_sources:
        digests = [F.lit(None).cast("string").alias(c) for c in ("leaf", "subroot", "root")]
        return placed.select("doc_id", "source", *[F.col(n).alias(c) for n, c in zip(names, extra)], *digests, F.lit(None).cast("array<struct<l:string,r:string>>").alias("steps"))
    numbers = sources.select(F.col("source").alias("_source"), F.col("i").alias("t"))
    # the first level keeps what belongs to its leaves
    member = placed.join(numbers, F.col("source").eqNullSafe(F.col("_source"))).select("t", "n", F.expr(f"i div {RUN}").alias("i"), F.struct(F.col("i"), "h", "doc_id", "source", *names).alias("leaf"))
    runs = member.groupBy("t", "i").agg(F.max("n").alias("m"), F.sort_array(F.collect_list(F.col("leaf"))).alias("members"))
    kids = F.transform("members", lambda x: x["h"])
    runs = stored(spark, runs.select("t", "i", F.expr(f"(m + {RUN - 1}) div {RUN}").alias("n"), "m", "members",
                                     F.when(F.col("m") == 1, F.get(kids, 0)).otherwise(F.sha2(F.array_join(kids, ""), 256)).alias("h")), "runs")
    release(placed)
    subroots, links, tables = [runs.where("n = 1").select("t", "h")], [], []

    def climb(nodes: DataFrame, first: int, levels: int) -> DataFrame:
        for k in range(first, levels):
            up = stored(spark, _runs(nodes.where("n > 1")), f"level-{k + 1}")
            tables.append(up)
            links.append(_links(up, k))
            nodes = up.select("t", "i", "n", "h")
            subroots.append(nodes.where("n = 1").select("t", "h"))
        return nodes

    depth = _levels(most)
    climb(runs.select("t", "i", "n", "h"), 1, depth)
    tops = subroots[0]
    for level in subroots[1:]:
        tops = tops.union(level)
    tops = stored(spark, tops, "subroots")
    top_depth = _levels(n_sources)
    root = climb(tops.select(F.lit(TOP).cast("long").alias("t"), F.col("t").alias("i"), F.lit(n_sources).cast("long").alias("n"), "h"), 0, top_depth).first()["h"]

    paths = runs.select("t", "i", "n", "m", F.posexplode("members").alias("at", "leaf"), kids.alias("kids"))
    nothing = F.array().cast("array<struct<l:string,r:string>>")
    paths = paths.select("t", "leaf", *_parent(F.col("n") == 1, 1), F.when(F.col("m") == 1, nothing).otherwise(F.array(_step(F.col("kids"), F.col("at")))).alias("steps"))
    if links:
        above = links[0]
        for more in links[1:]:
            above = above.union(more)
        far, reach = stored(spark, above, "links-1"), 1
        release(*tables)
        while True:
            paths = _joined(paths, far)
            reach *= 2
            if reach >= depth + top_depth:
                break
            # paths have now climbed `reach` levels: within a source only nodes at multiples of it are ever pointed to
            far = stored(spark, _joined(far.where((F.col("t") == TOP) | (F.col("k") % reach == 0)), far), f"links-{reach}")
    out = paths.join(tops.select(F.col("t").alias("_t"), F.col("h").alias("subroot")), F.col("t") == F.col("_t"))
    return out.select("leaf.doc_id", "leaf.source", *[F.col("leaf")[n].alias(c) for n, c in zip(names, extra)], F.col("leaf.h").alias("leaf"), "subroot", F.lit(root).alias("root"), "steps")


def folded(leaf: Column, steps: Column) -> Column:
    """The root that ``leaf`` and the siblings of ``steps`` lead to."""
    return F.aggregate(steps, leaf, lambda h, s: F.sha2(F.concat(s["l"], h, s["r"]), 256))


def proof_hash(steps: Column) -> Column:
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["l"], s["r"])), ""), 256)


def tamper_report(docs: DataFrame) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)``: proofs held against rows of which some lost the line ends of their text.

    Rows whose id's decimal digits have an even CRC-32 are tampered with;
    rows without an id are not.
    """
    plain = [F.col(c) for c in FIELDS]
    bad = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    changed = leaf_hash([*plain[:-1], F.replace(F.col("text"), F.lit("\n"), F.lit(""))])
    rows = manifest(docs, carry={"found": F.when(bad, changed)})
    rows = rows.select("doc_id", "leaf", "subroot", "root", proof_hash(F.col("steps")).alias("proof_sha256"), folded(F.coalesce("found", "leaf"), F.col("steps")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
