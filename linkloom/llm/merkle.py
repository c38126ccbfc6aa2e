"""Operator 11: a Merkle manifest of a table, with the authentication path of every row.

A row's leaf is the SHA-256 of its columns, each as byte count, colon and value (``-`` if null).
The leaves of a group (a language) ascend by key and are hashed in pairs up to the group's root;
the groups' roots, in the order of their names, are hashed likewise up to the table's root. The
last node of an odd run is hashed alone.

Rows are ranked in their group by a range shuffle and the sizes of its parts, and dealt to
aligned blocks of ``BLOCK`` leaves. The roots of a level's blocks are the nodes of the next
level, until each group has one. Then paths go down: a block's nodes share the path above them,
and within a block the path advances leaf by leaf: a stack for each height works out the sibling
that its height needs next, and the stack whose last node is lowest works first, so that a block
keeps a number of nodes that grows with the logarithm of its leaves. No group is ever gathered;
a task holds one block.

A path is text: for each height ``<`` and the sibling's digest if that stands left, ``>`` and it
if right, ``=`` if the node has none.

Defined results: nulls are hashed as ``-``, a null group comes first, a null key first in its
group; rows of equal key are ordered by their leaf, repeated rows have equal leaves and different
paths; a group of one row has its leaf as root; an empty table gives no rows; columns that are
not named are not read.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm._run import Scratch

#: Heights of a block and its leaves.
HEIGHT = 10
BLOCK = 1 << HEIGHT
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_NODE = "_group string, _rank long, _size long, _node string"


def said(values: list[Column]) -> Column:
    """The digest of values, each with its length."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def _hash(text: str) -> str:
    return sha256(text.encode("ascii")).hexdigest()


def height(size: int) -> int:
    """Of a block, by the nodes of its group on that level: up to one node, or up to the block's height."""
    return (size - 1).bit_length() if size <= BLOCK else HEIGHT


class Tree:
    """A treehash: takes leaves first to end one by one and gives the node of height ``top`` above them."""

    __slots__ = ("nodes", "at", "end", "top", "stack", "node")

    def __init__(self, nodes: list[str], first: int, top: int):
        self.nodes, self.at, self.end, self.top = nodes, first, min(first + (1 << top), len(nodes)), top
        self.stack: list[tuple[int, str]] = []
        self.node: str | None = None  # stays None if there are no leaves

    def over(self) -> bool:
        return self.node is not None or self.at >= self.end and not self.stack

    def lowest(self) -> int:
        """The height of the last node, or of the whole where none is there yet."""
        return self.stack[-1][0] if self.stack else self.top

    def step(self) -> tuple[int, str] | None:
        """One unit of work: joins the last two nodes, raises the last one where no more leaves come, or takes a leaf. Gives the node made."""
        s = self.stack
        if len(s) > 1 and s[-1][0] == s[-2][0]:
            (h, right), (_, left) = s.pop(), s.pop()
            s.append((h + 1, _hash(left + right)))
        elif self.at < self.end:
            s.append((0, self.nodes[self.at]))
            self.at += 1
        else:
            h, alone = s.pop()
            s.append((h + 1, _hash(alone)))
        if s[0][0] == self.top:
            self.node = s[0][1]
        return s[-1]

    def finish(self) -> str | None:
        while not self.over():
            self.step()
        return self.node


def root(nodes: list[str], top: int) -> str:
    return Tree(nodes, 0, top).finish()


def paths(nodes: list[str], top: int):
    """The path of each node in turn, up to height ``top``."""
    tree = Tree(nodes, 0, top)
    first: list[list[str | None]] = [[None, None] for _ in range(top + 1)]  # the first two nodes of each height
    made = [0] * (top + 1)
    while not tree.over():
        h, node = tree.step()
        if made[h] < 2:
            first[h][made[h]] = node
        made[h] += 1
    beside = [first[h][1] for h in range(top)]
    ready: list[str | None] = [first[h][0] for h in range(top)]
    works: list[Tree | None] = [None] * top
    for leaf in range(len(nodes)):
        yield "".join("=" if beside[h] is None else (">" if not leaf >> h & 1 else "<") + beside[h] for h in range(top))
        after = leaf + 1
        for h in range(top):
            if after & ((1 << h) - 1):
                break
            beside[h] = works[h].finish() if works[h] is not None else ready[h]
            works[h] = Tree(nodes, (after + (1 << h)) ^ (1 << h), h)
        for _ in range(2 * top - 1):
            todo = [t for t in works if t is not None and not t.over()]
            if not todo:
                break
            min(todo, key=Tree.lowest).step()


def ranked(own: Scratch, rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with _rank (from 0, in the group by order; equal rows in any order) and _size, the rows of the group."""
    rows = own.settle(rows.withColumn("_same", F.monotonically_increasing_id()), "leaves")  # so that equal rows can be dealt to many tasks
    key = [group, *order, "_same"]
    dealt = rows.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("_at", F.monotonically_increasing_id())
    dealt = own.settle(dealt.withColumn("_part", F.shiftright("_at", 33)).drop("_same"), "ranked")
    own.drop(rows)
    parts = dealt.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))  # as many as groups and parts
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(group, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(Window.partitionBy(group)).alias("_size"))
    return dealt.join(parts, [group, "_part"]).withColumn("_rank", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def _block() -> Column:
    return F.shiftright("_rank", HEIGHT)


def _above(nodes: DataFrame) -> DataFrame:
    """The next level: the root of each block."""

    def run(key, table):
        order = np.argsort(table["_rank"].to_numpy())
        size = table["_size"][0].as_py()
        node = root(table["_node"].take(pa.array(order)).to_pylist(), height(size))
        return pa.table({"_group": [key[0].as_py()], "_rank": [key[1].as_py()], "_size": [-(-size // BLOCK)], "_node": [node]})

    return nodes.select("_group", "_rank", "_size", "_node").groupBy("_group", _block().alias("_block")).applyInArrow(run, _NODE)


def _below(nodes: DataFrame, upper: DataFrame, carry: list[str]) -> DataFrame:
    """nodes (with the columns ``carry``) with _path and _sub; upper: _group, _block, _path and _sub of their blocks."""
    keys = ["_group", "_block"]
    kinds = ", ".join(f"`{c}` {nodes.schema[c].dataType.simpleString()}" for c in carry)

    def run(key, table, block):
        table = table.take(pa.array(np.argsort(table["_rank"].to_numpy())))
        up, sub = block["_path"][0].as_py(), block["_sub"][0].as_py()
        own = [p + up for p in paths(table["_node"].to_pylist(), height(table["_size"][0].as_py()))]
        return table.select(carry).append_column("_path", pa.array(own)).append_column("_sub", pa.array([sub] * len(own), pa.string()))

    dealt = nodes.select(*dict.fromkeys([*carry, "_rank", "_size", "_node", "_group"]), _block().alias("_block"))
    return dealt.groupBy(keys).cogroup(upper.select(*keys, "_path", "_sub").groupBy(keys)).applyInArrow(run, f"{kinds}, _path string, _sub string")


def _levels(own: Scratch, nodes: DataFrame) -> list[DataFrame]:
    """nodes, the roots of their blocks, and so on; each group has one node on the last."""
    out = [nodes]
    while True:
        out.append(own.settle(_above(out[-1]), "level"))
        if out[-1].filter("_size > 1").isEmpty():
            return out


def _descended(own: Scratch, levels: list[DataFrame], upper: DataFrame) -> DataFrame:
    """Paths of the blocks of the lowest level, from those of the highest level's nodes."""
    for nodes in reversed(levels[1:-1]):
        upper = own.settle(_below(nodes, upper, ["_group", "_rank"]).withColumnRenamed("_rank", "_block"), "paths")
    return upper


def proofs(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, key: str = "doc_id", group: str = "lang", more: dict[str, Column] | None = None) -> DataFrame:
    """key, leaf, subroot (of the row's group), root, path of every row, and the columns ``more``, given by expressions on docs."""
    more = more or {}
    name = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # null comes first
    leaves = docs.select(name.alias("_group"), F.col(key).alias("_key"), said([F.col(c) for c in columns]).alias("_node"), *(c.alias(f"_more_{k}") for k, c in more.items()))
    with Scratch(docs.sparkSession) as own:
        nodes = own.settle(ranked(own, leaves, "_group", ["_key", "_node"]), "nodes")
        levels = _levels(own, nodes)
        subs = levels[-1].select(F.lit("").alias("_all"), F.col("_group").alias("_name"), F.col("_node"))
        top = own.settle(ranked(own, subs, "_all", ["_name"]).withColumnRenamed("_all", "_group"), "subroots")
        tops = _levels(own, top)
        found = tops[-1].first()  # one row, or none of an empty table
        upper = _descended(own, tops, tops[-1].select("_group", F.col("_rank").alias("_block"), F.lit("").alias("_path"), F.lit("").alias("_sub")))
        upper = _below(top, upper, ["_name", "_node"]).select(F.col("_name").alias("_group"), F.lit(0).cast("long").alias("_block"), "_path", F.col("_node").alias("_sub"))
        upper = _descended(own, levels, own.settle(upper, "paths"))
        own.keep(nodes, upper)
    out = _below(nodes, upper, ["_key", "_node", *(f"_more_{k}" for k in more)])
    return out.select(F.col("_key").alias(key), F.col("_node").alias("leaf"), F.col("_sub").alias("subroot"), F.lit(found and found["_node"]).cast("string").alias("root"), F.col("_path").alias("path"), *(F.col(f"_more_{k}").alias(k) for k in more))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path give."""

    def up(node: Column, step: Column) -> Column:
        side, beside = F.substring(step, 1, 1), F.substring(step, 2, 64)
        return F.sha2(F.when(side == "<", F.concat(beside, node)).otherwise(F.concat(node, beside)), 256)

    return F.aggregate(F.regexp_extract_all(path, F.lit("[<>=][0-9a-f]*"), F.lit(0)), leaf, up)


def siblings_digest(path: Column) -> Column:
    """The digest of all siblings, from the leaf up."""
    return F.sha2(F.translate(path, "<>=", ""), 256)


def audited(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: where 7 divides crc32 of doc_id, the leaf is folded with 1 added to n_chars."""
    tampered = [(F.col(c).cast("decimal(38,0)") + 1) if c == "n_chars" else F.col(c) for c in COLUMNS]
    other = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, said(tampered))
    rows = proofs(docs, more={"other": other}).withColumn("folded_root", folded(F.coalesce("other", "leaf"), F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", "root", siblings_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def oracle() -> str:
    """The same by whole levels, as lists."""
    parts = lambda n: " || ".join(f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", n, "text"))
    pairs = "list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')))"
    return f"""WITH RECURSIVE z AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t),
d AS (SELECT doc_id, lang, sha256({parts('n_chars')}) AS leaf, sha256({parts('(n_chars::HUGEINT + 1)')}) AS altered, xor(list_reduce(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 7 = 0 AS bad FROM documents, z),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
l AS (SELECT lang, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM o GROUP BY lang UNION ALL SELECT lang, level + 1, {pairs} FROM l WHERE len(nodes) > 1),
s AS (SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM l WHERE len(nodes) = 1),
u AS (SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM s UNION ALL SELECT level + 1, {pairs} FROM u WHERE len(nodes) > 1),
nl AS (SELECT lang, level, unnest(nodes) AS node, generate_subscripts(nodes, 1) - 1 AS i FROM l WHERE len(nodes) > 1), nu AS (SELECT level, unnest(nodes) AS node, generate_subscripts(nodes, 1) - 1 AS i FROM u WHERE len(nodes) > 1),
hl AS (SELECT lang, max(level) AS h FROM l GROUP BY lang), hu AS (SELECT max(level) AS h FROM u),
q AS (SELECT row_number() OVER () AS r, o.*, s.subroot, s.place, hl.h AS low, hu.h AS high FROM o JOIN s ON o.lang IS NOT DISTINCT FROM s.lang JOIN hl ON o.lang IS NOT DISTINCT FROM hl.lang, hu),
e AS (SELECT r, lang, place, unnest(range(0, low + high)) AS k, low, pos FROM q),
p AS (SELECT r, list(CASE WHEN k < e.low THEN coalesce(CASE WHEN (pos >> k) % 2 = 1 THEN '<' ELSE '>' END || nl.node, '=') ELSE coalesce(CASE WHEN (place >> (k - e.low)) % 2 = 1 THEN '<' ELSE '>' END || nu.node, '=') END ORDER BY k) AS steps
FROM e LEFT JOIN nl ON k < e.low AND e.lang IS NOT DISTINCT FROM nl.lang AND nl.level = k AND nl.i = xor(pos >> k, 1) LEFT JOIN nu ON k >= e.low AND nu.level = k - e.low AND nu.i = xor(place >> (k - e.low), 1) GROUP BY r),
f AS (SELECT q.*, coalesce(steps, []::VARCHAR[]) AS steps, (SELECT nodes[1] FROM u WHERE len(nodes) = 1) AS root FROM q LEFT JOIN p USING (r)),
g AS (SELECT *, list_reduce(steps, lambda n, s: sha256(CASE WHEN s[1] = '<' THEN s[2:] || n ELSE n || s[2:] END), CASE WHEN bad THEN altered ELSE leaf END) AS folded_root FROM f)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda s: s[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM g"""
