"""A Merkle manifest of a dataset: a digest for each row, a tree of them for each group, a tree of the groups' roots, and
for each row the proof that leads from its digest to the root.

  1. a leaf digests the fields of one row; texts are read once, and from here on only digests move;
  2. leaves are numbered within their group: all are sorted by range, rows are counted for each range and group, and
     prefix sums over ranges tell where each begins, so no group is sorted in one task;
  3. each level is one window over (group, parent): its full ordered frame lists the digests of up to FANOUT children.
     The list is the parent's preimage and holds each child's siblings; the first child stands for the parent on
     the next level, so parents come once. Levels end where a group has one node, its subroot;
  4. the subroots, in order of their groups, are numbered and levelled likewise, up to the root;
  5. paths go down the levels again: a node's path is its own siblings and then its parent's path, joined on
     (group, parent). A row folds its path with its (perhaps tampered) digest into a root, and digests it into a proof.

A level has a third of the rows of the one below, so all levels together hold half as many as there are rows.

Cases: any field may be null ('-', unlike an empty text); a null group is a group, first in order; rows without an id come first
in their group; rows with one id are in order of their leaf digests; equal rows take a place each, in any order, which
gives the same rows; an empty table has no rows and no root; columns other than the fields are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayline.llm._common import materialize, table

FANOUT = 3
PATH = "array<struct<left:string,right:string>>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """'-' for null, else the length in UTF-8 bytes, a colon, the value."""
    shown = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    return digest(F.concat(*map(field, values)))


def numbered(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """rows (group, ...) with idx, their place in their group by order (which need not tell all rows apart), and n, the group's rows.

    Only Spark's range partitioning sees all rows of a group; the windows hold one range of it, or one row for each range.
    """
    tie = F.monotonically_increasing_id()
    spread = rows.withColumn("tie", tie).repartitionByRange("group", *order, "tie").withColumn("part", F.spark_partition_id())
    spread = materialize(spread, f"{name}-ranges")
    counts = spread.groupBy("group", "part").agg(F.count(F.lit(1)).alias("c"))
    of_group = Window.partitionBy("group")
    ahead = F.coalesce(F.sum("c").over(of_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("group", "part", ahead.alias("start"), F.sum("c").over(of_group).alias("n"))
    inside = spread.withColumn("k", F.row_number().over(Window.partitionBy("group", "part").orderBy(*order, "tie")))
    return inside.join(starts, ["group", "part"]).withColumn("idx", F.col("start") + F.col("k") - 1).drop("start", "k", "part", "tie")


def levels(nodes: DataFrame, name: str) -> list[DataFrame]:
    """The levels of every group's tree, leaves first. nodes: group, idx, n, hash, and more that only the leaves keep.

    Each level has group, idx, n, hash, parent (idx // FANOUT), and left and right, the digests of the siblings on either
    side; those three are null for a group's last node (n = 1).
    """
    most = nodes.agg(F.max("n").alias("n")).first()["n"] or 0
    out = []
    while True:
        family = Window.partitionBy("group", "parent").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        at = (F.col("idx") % FANOUT).cast("int")
        among = nodes.withColumn("parent", F.floor(F.col("idx") / FANOUT)).withColumn("kids", F.collect_list("hash").over(family))
        side = lambda kids: F.when(F.col("n") > 1, F.array_join(kids, ""))
        level = among.withColumns({"left": side(F.slice("kids", F.lit(1), at)), "right": side(F.slice("kids", at + 2, F.lit(FANOUT)))}).drop("kids")
        level = materialize(level, f"{name}-level")
        out.append(level)
        if most <= 1:
            return out
        most = -(-most // FANOUT)
        first = level.filter((F.col("idx") % FANOUT == 0) & (F.col("n") > 1))
        nodes = first.select("group", F.col("parent").alias("idx"), F.ceil(F.col("n") / FANOUT).alias("n"), digest(F.concat("left", "hash", "right")).alias("hash"))


def with_paths(tree: Sequence[DataFrame], tops: DataFrame) -> DataFrame:
    """The leaves of a tree with path and with what tops (group, path, ...) says of their group's last node."""
    told = [c for c in tops.columns if c not in ("group", "path")]
    above = None
    for k, level in reversed(list(enumerate(tree))):
        own = [c for c in level.columns if c not in ("parent", "left", "right")] if k == 0 else ["group", "idx"]
        kept = [F.col(f"l.{c}") for c in own]
        here = level.filter("n = 1").alias("l").join(tops.alias("t"), "group").select(*kept, "t.path", *(F.col(f"t.{c}") for c in told))
        if above is not None:
            up = above.withColumnRenamed("idx", "parent").alias("t")
            below = level.filter("n > 1").alias("l").join(up, ["group", "parent"])
            step = F.array(F.struct(F.col("l.left").alias("left"), F.col("l.right").alias("right")))
            here = here.unionByName(below.select(*kept, F.concat(step, F.col("t.path")).alias("path"), *(F.col(f"t.{c}") for c in told)))
        above = here
    return above


def last_nodes(tree: Sequence[DataFrame]) -> DataFrame:
    """group, hash of each group's last node."""
    return reduce(DataFrame.unionByName, [level.filter("n = 1").select("group", "hash") for level in tree])


def merkle(leaves: DataFrame, order: Sequence[str], name: str = "merkle") -> DataFrame:
    """leaves (group, a string, never null; order; hash; more) with subroot, root and path, the siblings from the leaf to the root."""
    tree = levels(numbered(leaves, order, name), name)
    tops = last_nodes(tree).select(F.lit("").alias("group"), F.col("group").alias("of"), "hash")
    upper = levels(numbered(tops, ["of"], f"{name}-top"), f"{name}-top")
    whole = last_nodes(upper).select("group", F.array().cast(PATH).alias("path"), F.col("hash").alias("root"))
    groups = with_paths(upper, whole).select(F.col("of").alias("group"), F.col("hash").alias("subroot"), "root", "path")
    return with_paths(tree, materialize(groups, f"{name}-groups"))


def fold(hash: Column, path: Column) -> Column:
    """The root that a digest and the siblings on its way up give."""
    return F.aggregate(path, hash, lambda h, p: digest(F.concat(p["left"], h, p["right"])))


def proof(path: Column) -> Column:
    return digest(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""))


def manifest(docs: DataFrame, tampered: Column, id: str = "doc_id", group: str = "source", fields: Sequence[str] = FIELDS, text: str = "text") -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root, verified, path. tampered is the text to check each row with."""
    # 's' before the name keeps the order and tells a null from an empty name
    of = F.coalesce(F.concat(F.lit("s"), F.col(group).cast("string")), F.lit(""))
    again = [tampered if f == text else F.col(f) for f in fields]
    leaves = docs.select(F.col(id).alias("id"), of.alias("group"), leaf([F.col(f) for f in fields]).alias("hash"), leaf(again).alias("checked"))
    found = merkle(materialize(leaves, "leaves"), ["id", "hash"])
    folded = found.withColumn("folded_root", fold(F.col("checked"), F.col("path")))
    return folded.select(
        F.col("id").alias(id), F.col("hash").alias("leaf"), "subroot", "root", proof(F.col("path")).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), "path",
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return manifest(docs, F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))).drop("path")


_SQL_FIELD = "coalesce(octet_length(encode({0}::VARCHAR))::VARCHAR || ':' || {0}::VARCHAR, '-')"
_SQL_LEAF = "sha256(" + " || ".join(_SQL_FIELD.format(c) for c in FIELDS[:-1]) + " || " + _SQL_FIELD + ")"
_SQL_CRC = """xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT),
    lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"""
_SQL_TREE = """
  SELECT 0 AS level, grp, idx, n, hash FROM {leaves}
  UNION ALL
  SELECT level + 1, grp, idx // 3, (max(n) + 2) // 3, sha256(string_agg(hash, '' ORDER BY idx)) FROM {tree} WHERE n > 1 GROUP BY level, grp, idx // 3"""
_SQL_SIDES = """
  SELECT level, grp, idx, n, hash, coalesce(string_agg(hash, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(hash, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {tree} WINDOW w AS (PARTITION BY level, grp, idx // 3 ORDER BY idx)"""
OP11_SQL = f"""
WITH RECURSIVE d AS (
  SELECT *, CASE WHEN {_SQL_CRC} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS seen, coalesce('s' || source, '') AS grp FROM documents
), h AS (
  SELECT doc_id, grp, {_SQL_LEAF.format("text")} AS hash, {_SQL_LEAF.format("seen")} AS checked FROM d
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, hash) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n FROM h
), tree AS ({_SQL_TREE.format(leaves="leaves", tree="tree")}
), tops AS (
  SELECT '' AS grp, grp AS src, hash, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS n FROM tree WHERE n = 1
), upper_ AS ({_SQL_TREE.format(leaves="tops", tree="upper_")}
), side AS ({_SQL_SIDES.format(tree="tree")}
), upper_side AS ({_SQL_SIDES.format(tree="upper_")}
), walk AS (
  SELECT row_number() OVER () AS k, doc_id, hash AS leaf, grp, 0 AS level, idx, n, checked AS acc, '' AS proof FROM leaves
  UNION ALL
  SELECT k, doc_id, leaf, w.grp, w.level + 1, w.idx // 3, (w.n + 2) // 3, sha256(s.l || acc || s.r), proof || s.l || s.r
  FROM walk w JOIN side s ON w.grp = s.grp AND w.level = s.level AND w.idx = s.idx WHERE w.n > 1
), climb AS (
  SELECT k, doc_id, leaf, t.hash AS subroot, '' AS grp, 0 AS level, t.idx, t.n, acc, proof FROM walk w JOIN tops t ON w.grp = t.src WHERE w.n = 1
  UNION ALL
  SELECT k, doc_id, leaf, subroot, c.grp, c.level + 1, c.idx // 3, (c.n + 2) // 3, sha256(s.l || acc || s.r), proof || s.l || s.r
  FROM climb c JOIN upper_side s ON c.level = s.level AND c.idx = s.idx WHERE c.n > 1
), root AS (SELECT hash AS root FROM upper_ WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = root AS verified FROM climb, root WHERE n = 1
"""
