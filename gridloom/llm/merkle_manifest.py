"""Merkle manifest of a table: one root for all rows, and for each row the proof that it is in.

A row's leaf is the SHA-256 of its columns. The rows of one group (language) ascend by id; while there is more than one
node, every eight consecutive ones become the hash of their digests. The groups' roots, in the groups' order, are joined likewise.

Leaves are numbered within their groups by ranges, without a task that sees a group. Buckets of 512 consecutive nodes, which no
run of eight crosses, go as Arrow tables to DuckDB on the executors: level by level, ordered string_agg and sha256 give each
bucket's root. Spark combines the bucket roots, which are the leaves of the next round, until each group has one, and then
the groups; a round has a 512th of the nodes of the one before. On the way back, buckets are joined to the siblings beyond
them (the outer proof), and DuckDB adds the siblings within and folds them over the leaf.

What happens in each case: a null column is hashed as `-`; a null group is one of its own and comes first; null ids come first,
and rows of one id ascend by their leaves, so equal rows are consecutive and have proofs of their own; an empty table gives an
empty result; a group of one row has its leaf as root; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import cut, join_hot, workers_can_import
from gridloom.operators import running

#: Nodes that become one.
ARITY = 8
#: Levels within a bucket: 512 nodes.
DEPTH = 3
BUCKET = ARITY**DEPTH


def leaf(values: list[Column]) -> Column:
    """SHA-256 in lowercase hex of the values' texts, each with its size in bytes in front, or `-`."""
    told = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in told)), 256)


@cache
def _duck():
    import duckdb

    engine = duckdb.connect()
    engine.execute("SET threads = 1")
    return engine


def _levels(n: int) -> int:
    """Levels until n nodes are one."""
    depth = 0
    while ARITY**depth < n:
        depth += 1
    return depth


def _climb(nodes: pa.Table) -> tuple[object, int]:
    """DuckDB with a table level_0, level_1 ... of a bucket's nodes, and the last one's number."""
    engine = _duck()
    top = min(DEPTH, _levels(nodes["n"][0].as_py()))
    engine.register("given", nodes)
    engine.execute("CREATE OR REPLACE TEMP TABLE level_0 AS SELECT pos, node FROM given")
    for i in range(top):
        engine.execute(f"CREATE OR REPLACE TEMP TABLE level_{i + 1} AS SELECT pos // {ARITY} AS pos, sha256(string_agg(node, '' ORDER BY pos)) AS node FROM level_{i} GROUP BY 1")
    return engine, top


def _roots(nodes: pa.Table) -> pa.Table:
    engine, top = _climb(nodes)
    node = engine.execute(f"SELECT node FROM level_{top}").fetchall()[0][0]
    row = nodes.slice(0, 1)
    return pa.table({"tree": row["tree"], "pos": pa.array([row["pos"][0].as_py() // BUCKET]), "node": [node], "n": pa.array([-(-row["n"][0].as_py() // BUCKET)])})


def _siblings(nodes: pa.Table, columns: str) -> pa.Table:
    """The nodes with, for each level from their own to the root, what stands before and after them in their run (b, a)."""
    engine, top = _climb(nodes)
    beside = "string_agg(node, '') OVER (PARTITION BY pos // 8 ORDER BY pos ROWS BETWEEN {})"
    for i in range(top):
        before, after = (f"coalesce({beside.format(x)}, '')" for x in ("UNBOUNDED PRECEDING AND 1 PRECEDING", "1 FOLLOWING AND UNBOUNDED FOLLOWING"))
        engine.execute(f"CREATE OR REPLACE TEMP TABLE run_{i} AS SELECT pos, {before} AS b, {after} AS a FROM level_{i}")
    lists = {x: f"list_concat([{', '.join(f'r{i}.{x}' for i in range(top))}]::VARCHAR[], g.outer_{x})" for x in "ba"}
    joins = " ".join(f"JOIN run_{i} r{i} ON r{i}.pos = g.pos // {ARITY**i}" for i in range(top))
    engine.execute(f"CREATE OR REPLACE TEMP TABLE beside AS SELECT g.*, {lists['b']} AS b, {lists['a']} AS a FROM given g {joins}")
    levels = engine.execute("SELECT max(len(b)) FROM beside").fetchall()[0][0]
    fold = "coalesce(tampered, node)"
    for i in range(1, levels + 1):  # a bucket's nodes have equally many levels above them
        fold = f"sha256(b[{i}] || {fold} || a[{i}])"
    proof = "sha256(array_to_string(list_transform(range(1, len(b) + 1), lambda i: b[i] || a[i]), ''))"
    return engine.sql(f"SELECT {columns.format(fold=fold, proof=proof)} FROM beside").to_arrow_table()


_NODES = "tree string, pos long, node string, n long"


def _up(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("tree", F.expr(f"pos div {BUCKET}")).applyInArrow(_roots, _NODES)


def _down(nodes: DataFrame, above: DataFrame, columns: str, schema: str) -> DataFrame:
    """Nodes with what DuckDB says of them, given (tree, pos, node, b, a) of their buckets."""
    outer = above.select("tree", F.col("pos").alias("bucket"), F.col("b").alias("outer_b"), F.col("a").alias("outer_a"), "root", "subroot")
    rows = nodes.withColumn("bucket", F.expr(f"pos div {BUCKET}")).join(outer, ["tree", "bucket"])
    return rows.groupBy("tree", "bucket").applyInArrow(lambda x: _siblings(x, columns), schema)


_BESIDE = "tree, pos, node, b, a, root, subroot"
_BESIDE_SCHEMA = "tree string, pos long, node string, b array<string>, a array<string>, root string, subroot string"


def _tops(nodes: DataFrame) -> list[DataFrame]:
    """Rounds of nodes, from these up to one node a tree."""
    rounds = [nodes]
    while (rounds[-1].agg(F.max("n")).first()[0] or 0) > 1:
        rounds.append(cut(_up(rounds[-1])))
    return rounds


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows, computed once, with their positions within their tree (pos) and its size (n)."""
    placed = running.numbered(rows, ["tree", *order], "at")
    sizes = placed.groupBy("tree").agg(F.min("at").alias("from"), F.count("*").alias("n"))
    return cut(join_hot(placed, sizes, "tree").withColumn("pos", F.col("at") - F.col("from")).drop("at", "from"))


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tampered: dict[str, Column] | None = None) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row. `tampered` gives columns other values for the
    check: a row's root is folded from the leaf of those, with the siblings of the untouched rows; null leaves a row as it is."""
    workers_can_import(docs.sparkSession)
    other = [F.coalesce(tampered[c], F.col(c)) if c in (tampered or {}) else F.col(c) for c in columns]
    told = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.concat(F.lit(":"), F.col(group_col).cast("string")), F.lit("-")).alias("tree"), leaf([F.col(c) for c in columns]).alias("node"), leaf(other).alias("other"))
    told = told.withColumn("tampered", F.when(F.col("other") != F.col("node"), F.col("other"))).drop("other")
    leaves = _numbered(told, ["id", "node"])
    groups = _tops(leaves)
    subroots = groups[-1].select(F.lit("").alias("tree"), F.col("tree").alias("group"), "node")
    whole = _tops(_numbered(subroots, ["group"]))
    none = F.array().cast("array<string>")
    above = whole[-1].select("tree", "pos", "node", none.alias("b"), none.alias("a"), F.col("node").alias("root"), F.lit(None).cast("string").alias("subroot"))
    blank = F.lit(None).cast("string").alias("tampered")
    for nodes in reversed(whole[:-1]):
        above = cut(_down(nodes.select("tree", "pos", "node", "n", blank), above, _BESIDE, _BESIDE_SCHEMA))
    # The roots of the groups stand at their places in the tree of groups, and on top of their own trees.
    above = whole[0].select("pos", "group").join(above, "pos").select(F.col("group").alias("tree"), F.lit(0).cast("long").alias("pos"), "node", "b", "a", "root", F.col("node").alias("subroot"))
    for nodes in reversed(groups[1:-1]):
        above = cut(_down(nodes.select("tree", "pos", "node", "n", blank), above, _BESIDE, _BESIDE_SCHEMA))
    found = _down(leaves, above, "id, node AS leaf, subroot, root, {proof} AS proof_sha256, {fold} AS folded_root, {fold} = root AS verified", "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return found.withColumnRenamed("id", id_col)
