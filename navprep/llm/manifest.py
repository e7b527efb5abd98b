"""A Merkle manifest of a dataset: hashes of rows, folded in runs of a fixed fan-out to a subroot for each group and one root, with a proof for each row.

Levels are windows: partitioned by group and parent index, an ordered list over the full frame gives the parent's preimage and every node's siblings; one
row of each parent goes on to the next level. Positions come from a range sort whose partitions count their rows, so no task holds a group. Proofs are
put together from the top down: a node takes its own siblings and what its parent holds, so each list is written once for a run, not for each row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window as W

from ._store import discard, sized, stored

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: An end of a proof: what stands left and right of a node's hash in its parent's preimage, level by level.
_NO_STEPS = "cast(array() as array<struct<left:string,right:string>>)"


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 bytes' count, a colon and the value."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(fields: Sequence[Column]) -> Column:
    return digest(*map(field, fields))


def positions(rows: DataFrame, group: str, order: Sequence[str], name: str) -> DataFrame:
    """rows (stored, range-sorted by group and order) with idx, each row's place in its group from 0, and n, the group's rows.

    Each partition numbers its sorted rows; a group's rows before a partition are a sum over (group, partition) counts, which are as many as there are
    partitions and groups. Full repeats are told apart by a number of their own, so that any key may be as frequent as it likes. Nulls stand first."""
    spark = rows.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    by = [group, *order]
    once = stored(rows.withColumn("_row", F.monotonically_increasing_id()), f"{name}-rows")
    ranged = once.repartitionByRange(parts, *by, "_row").sortWithinPartitions(*by, "_row").drop("_row").withColumn("_at", F.monotonically_increasing_id())
    ranged = stored(ranged, f"{name}-sorted")
    discard(once)
    # the numbers of a partition start at its own multiple of 2**33
    part = F.shiftright("_at", 33).alias("_part")
    spans = ranged.groupBy(F.col(group).alias("_group"), part).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    spans = spans.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy("_group").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    spans = spans.withColumn("n", F.sum("_n").over(W.partitionBy("_group")))
    spans = stored(spans.select("_group", F.col("_part").alias("_span"), "_first", "_before", "n"), f"{name}-spans")
    met = ranged.join(sized(spans, 200_000), F.col(group).eqNullSafe(F.col("_group")) & (F.shiftright("_at", 33) == F.col("_span")))
    return met.withColumn("idx", F.col("_before") + F.col("_at") - F.col("_first")).drop("_group", "_span", "_first", "_before", "_at")


def with_siblings(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """nodes (gid, idx, n, hash) with up (the parent's idx), left and right (the hashes of its run beside it) and parent (the hash of the run)."""
    nodes = nodes.withColumn("up", F.expr(f"idx div {fanout}"))
    run = W.partitionBy("gid", "up").orderBy("idx").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    x = nodes.withColumn("run", F.collect_list("hash").over(run))
    at = (F.col("idx") % fanout).cast("int")
    x = x.withColumn("left", F.concat_ws("", F.slice("run", 1, at))).withColumn("right", F.concat_ws("", F.slice("run", at + 2, fanout)))
    return x.withColumn("parent", F.sha2(F.concat_ws("", "run"), 256)).drop("run")


def _parents(nodes: DataFrame, fanout: int) -> DataFrame:
    one = with_siblings(nodes, fanout).dropDuplicates(["gid", "up"])
    return one.select("gid", F.col("up").alias("idx"), F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"), F.col("parent").alias("hash"))


def tree(nodes: DataFrame, fanout: int, name: str) -> list[DataFrame]:
    """Levels of (gid, idx, n, hash) from the leaves on, each stored; n is the level's nodes in the group. A group ends at the level where n is 1."""
    levels = [nodes]
    while levels[-1].where("n > 1").limit(1).count():
        levels.append(stored(_parents(levels[-1].where("n > 1"), fanout), name))
    return levels


def roots(levels: list[DataFrame]) -> DataFrame:
    out = levels[0].where("n = 1")
    for x in levels[1:]:
        out = out.unionByName(x.where("n = 1"))
    return out.select("gid", "hash")


def _step() -> Column:
    return F.array(F.struct("left", "right"))


def steps_above(levels: list[DataFrame], top: DataFrame, fanout: int) -> DataFrame:
    """(gid, idx, steps, more columns of top) for every node above the leaves: its steps to the root. top: the same by gid for each group's root.

    Groups of one leaf have a row (idx 0) as well: their leaf's steps are the root's."""
    rest = [c for c in top.columns if c not in ("gid", "steps")]

    def ends(level: DataFrame) -> DataFrame:
        return top.join(level.where("n = 1").select("gid"), "gid", "left_semi").select("gid", F.lit(0).cast("long").alias("idx"), "steps", *rest)

    above = ends(levels[-1])
    for k in range(len(levels) - 2, -1, -1):
        if k:
            x = with_siblings(levels[k].where("n > 1"), fanout).select("gid", "idx", "up", "left", "right")
            above = x.join(above.withColumnRenamed("idx", "up"), ["gid", "up"]).select("gid", "idx", F.concat(_step(), "steps").alias("steps"), *rest)
        above = above.unionByName(ends(levels[k]))
    return above


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", group_col: str = "source", tampered: dict[str, Column] | None = None, where: Column | None = None, fanout: int = FANOUT) -> DataFrame:
    """id_col, group_col, leaf, subroot, root, steps (array of left, right), proof_sha256, folded_root, verified for every row of docs.

    tampered: columns that stand for fields in the rows that `where` picks; their leaf is recomputed and folded with the original siblings. Elsewhere the
    original leaf is folded. A null field is `-`; null ids and the null group stand first; rows of one id stand by leaf; full repeats are leaves of their
    own. A group of one row is its own subroot, a table of one group its own root; an empty table gives an empty result. Extra columns are ignored."""
    own = leaf([F.col(c) for c in fields])
    changed = F.lit(None).cast("string")
    if tampered:
        changed = F.when(F.coalesce(where, F.lit(False)) if where is not None else F.lit(True), leaf([tampered.get(c, F.col(c)) for c in fields]))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(group_col).alias("_g"), own.alias("hash"), changed.alias("changed"))
    leaves = stored(positions(rows, "_g", ["_id", "hash"], "manifest"), "manifest-leaves")
    # groups by number: their place in the order of groups
    groups = positions(leaves.where("idx = 0").select(F.lit(0).alias("gid"), F.col("_g").alias("_name")), "gid", ["_name"], "manifest-groups")
    groups = stored(groups.select(F.col("idx").alias("_gid"), "_name"), "manifest-gids")
    nodes = leaves.join(sized(groups, 200_000), F.col("_g").eqNullSafe(F.col("_name"))).select(F.col("_gid").alias("gid"), "idx", "n", "hash", "_id", "_g", "changed")
    nodes = stored(nodes, "manifest-nodes")
    discard(leaves)
    levels = tree(nodes.select("gid", "idx", "n", "hash"), fanout, "manifest-level")
    subroots = stored(roots(levels), "manifest-subroots")
    count = subroots.count()
    tops = tree(subroots.select(F.lit(0).cast("long").alias("gid"), F.col("gid").alias("idx"), F.lit(count).cast("long").alias("n"), "hash"), fanout, "manifest-top")
    root = tops[-1].where("n = 1").select("gid", F.expr(_NO_STEPS).alias("steps"), F.col("hash").alias("root"))
    end = steps_above(tops, root, fanout).withColumnRenamed("idx", "up")
    last = with_siblings(tops[0], fanout).select("gid", "idx", "up", "left", "right", F.col("hash").alias("subroot")).join(end, ["gid", "up"])
    own_step = F.when(F.lit(count > 1), _step()).otherwise(F.expr(_NO_STEPS))
    top = stored(last.select(F.col("idx").alias("gid"), F.concat(own_step, "steps").alias("steps"), "subroot", "root"), "manifest-steps")
    above = stored(steps_above(levels, top, fanout), "manifest-above")
    up = above.withColumnRenamed("idx", "up")
    met = with_siblings(nodes, fanout).join(up, ["gid", "up"])
    steps = F.concat(F.when(F.col("n") > 1, _step()).otherwise(F.expr(_NO_STEPS)), F.col("steps"))
    x = met.select(F.col("_id").alias(id_col), F.col("_g").alias(group_col), F.col("hash").alias("leaf"), "subroot", "root", steps.alias("steps"), F.coalesce("changed", "hash").alias("_from"))
    x = x.withColumn("proof_sha256", F.sha2(F.concat_ws("", F.transform("steps", lambda s: F.concat(s["left"], s["right"]))), 256))
    x = x.withColumn("folded_root", F.aggregate("steps", F.col("_from"), lambda h, s: digest(s["left"], h, s["right"]))).drop("_from")
    return x.withColumn("verified", F.col("folded_root") == F.col("root"))


def lowered(text: Column) -> Column:
    """text with A-Z in lower case, other letters unchanged."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    picked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    out = manifest(docs, tampered={"text": lowered(F.col("text"))}, where=picked)
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


ORACLE = """
WITH RECURSIVE d AS (SELECT *, CASE WHEN bits % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END other FROM (
 SELECT doc_id, source, lang, n_chars, text, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
  lambda h, c: list_reduce(list_prepend(xor(h, c), range(8)), lambda r, i: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384::BIGINT) ELSE r // 2 END))) bits FROM documents)),
f AS (SELECT doc_id, source, other IS DISTINCT FROM text changed, {doc_id} || {source} || {lang} || {n_chars} head, {text} tail, {other} tail2 FROM d),
l AS (SELECT doc_id, source, sha256(head || tail) leaf, CASE WHEN changed THEN sha256(head || tail2) ELSE sha256(head || tail) END start FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 idx, count(*) OVER (PARTITION BY source) n FROM l),
t AS (SELECT 0 level, source, idx, n, leaf hash FROM p UNION ALL
 SELECT level + 1, source, idx // 16, (any_value(n) + 15) // 16, sha256(string_agg(hash, '' ORDER BY idx)) FROM t WHERE n > 1 GROUP BY level, source, idx // 16),
s AS (SELECT source, hash subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 gid, count(*) OVER () m FROM t WHERE n = 1),
u AS (SELECT 0 level, gid idx, m n, subroot hash FROM s UNION ALL
 SELECT level + 1, idx // 16, (any_value(n) + 15) // 16, sha256(string_agg(hash, '' ORDER BY idx)) FROM u WHERE n > 1 GROUP BY level, idx // 16),
tr AS (SELECT level, source, idx // 16 up, list(hash ORDER BY idx) run FROM t WHERE n > 1 GROUP BY ALL),
ur AS (SELECT level, idx // 16 up, list(hash ORDER BY idx) run FROM u WHERE n > 1 GROUP BY ALL),
walk AS (SELECT doc_id, leaf, source, 0 level, idx, n, start h, '' proof FROM p UNION ALL
 SELECT doc_id, leaf, w.source, w.level + 1, w.idx // 16, (w.n + 15) // 16, sha256(array_to_string(run[:w.idx % 16], '') || h || array_to_string(run[w.idx % 16 + 2:], '')),
  proof || array_to_string(run[:w.idx % 16], '') || array_to_string(run[w.idx % 16 + 2:], '') FROM walk w JOIN tr ON tr.level = w.level AND tr.source IS NOT DISTINCT FROM w.source AND tr.up = w.idx // 16 WHERE w.n > 1),
walk2 AS (SELECT doc_id, leaf, subroot, 0 level, gid idx, m n, h, proof FROM walk JOIN s ON s.source IS NOT DISTINCT FROM walk.source WHERE walk.n = 1 UNION ALL
 SELECT doc_id, leaf, subroot, w.level + 1, w.idx // 16, (w.n + 15) // 16, sha256(array_to_string(run[:w.idx % 16], '') || h || array_to_string(run[w.idx % 16 + 2:], '')),
  proof || array_to_string(run[:w.idx % 16], '') || array_to_string(run[w.idx % 16 + 2:], '') FROM walk2 w JOIN ur ON ur.level = w.level AND ur.up = w.idx // 16 WHERE w.n > 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) proof_sha256, h folded_root, h = root verified FROM walk2, (SELECT hash root FROM u WHERE n = 1) WHERE n = 1
""".format(**{c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in (*FIELDS, "other")})  # fmt: skip
