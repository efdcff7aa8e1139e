"""Merkle manifest of a table: a tree of digests per source, the sources' roots under one root, and a proof for every row.

Leaves of a source are numbered in order, and ``arity ** depth`` neighbours are a superblock. Going up, each superblock is
reduced to one node; the nodes are numbered already and are reduced in the same way until a source has one. Going down, the nodes of a
superblock and the one row of outer nodes that lie on the way from it to the root are cogrouped: the local reduction, the join of its
proofs with the outer ones and the folding are one step. No task holds more than a superblock, whatever a source's size.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable
from .ranks import ranked

Path = list[tuple[str, str]]
"""Of each level, upwards: the digests to the left and to the right in the run, concatenated."""


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def encoded(columns: list[str | Column]) -> Column:
    """The columns one after the other, each as byte count, ":" and value, or "-" if null."""
    values = [F.col(c) if isinstance(c, str) else c for c in columns]
    values = [v.cast("string") for v in values]
    return F.concat(*[F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in values])


@dataclass(frozen=True)
class Shape:
    """``arity`` nodes make one of the next level, and ``depth`` levels are a superblock."""

    arity: int = 16
    depth: int = 3

    @property
    def span(self) -> int:
        return self.arity**self.depth

    def deep(self, n: int) -> int:
        """How often a superblock is reduced, in a tree of ``n`` nodes at its level: until one is left, or to the next superblocks."""
        if n > self.span:
            return self.depth
        deep = 0
        while n > 1:
            n, deep = -(-n // self.arity), deep + 1
        return deep

    def reduced(self, nodes: list[str], n: int) -> list[list[str]]:
        """The levels over the nodes of a superblock, themselves included."""
        levels = [nodes]
        for _ in range(self.deep(n)):
            last = levels[-1]
            levels.append([digest("".join(last[i : i + self.arity])) for i in range(0, len(last), self.arity)])
        return levels

    def way_up(self, levels: list[list[str]], i: int) -> Path:
        """Siblings of the i-th node at each level that gets reduced."""
        out = []
        for level in levels[:-1]:
            start = i // self.arity * self.arity
            out.append(("".join(level[start:i]), "".join(level[i + 1 : start + self.arity])))
            i //= self.arity
        return out


def folded(node: str, path: Path) -> str:
    for left, right in path:
        node = digest(left + node + right)
    return node


def parents(nodes: DataFrame, shape: Shape) -> DataFrame:
    """One node (tree, pos, n, node) for each superblock of ``nodes``."""
    def reduce(rows: pd.DataFrame) -> pd.DataFrame:
        rows, n = rows.sort_values("pos"), int(rows["n"].iloc[0])
        top = shape.reduced(rows["node"].tolist(), n)[-1][0]
        return pd.DataFrame({"tree": [rows["tree"].iloc[0]], "pos": [rows["pos"].iloc[0] // shape.span], "n": [-(-n // shape.span)], "node": [top]})

    blocks = nodes.select("tree", "pos", "n", "node", F.floor(F.col("pos") / shape.span).alias("block"))
    return blocks.groupBy("tree", "block").applyInPandas(reduce, "tree string, pos long, n long, node string")


def climbed(leaves: DataFrame, shape: Shape) -> tuple[list[DataFrame], DataFrame]:
    """The levels of superblock nodes above ``leaves`` (one list entry each, from the leaves on), and the root of each tree."""
    levels = [leaves]
    while True:
        up = durable(parents(levels[-1], shape))
        if (up.agg(F.max("n")).first()[0] or 1) == 1:
            return levels, up
        levels.append(up)


def exchanged(nodes: DataFrame, outer: DataFrame, finish: Callable[[dict, str, Path], dict], fields: str, shape: Shape) -> DataFrame:
    """A row of ``fields`` for each node: ``finish(row, subroot, path)``, with the path from the node to the root.

    ``outer`` has one row per superblock: tree, pos (the superblock's number), subroot and the lefts and rights of its path.
    """
    names = [f.split()[0] for f in fields.split(", ")]

    def join(own: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        if own.empty:
            return pd.DataFrame(columns=names)
        own, above = own.sort_values("pos"), around.iloc[0]
        beyond = list(zip(above["lefts"], above["rights"]))
        levels = shape.reduced(own["node"].tolist(), int(own["n"].iloc[0]))
        rows = [finish(row, above["subroot"], shape.way_up(levels, i) + beyond) for i, row in enumerate(own.to_dict("records"))]
        return pd.DataFrame(rows, columns=names)

    inner = nodes.withColumn("block", F.floor(F.col("pos") / shape.span)).groupBy("tree", "block")
    return inner.cogroup(outer.withColumnRenamed("pos", "block").groupBy("tree", "block")).applyInPandas(join, fields)


PATHS = "tree string, pos long, subroot string, lefts array<string>, rights array<string>"


def as_outer(row: dict, subroot: str, path: Path) -> dict:
    return {"tree": row["tree"], "pos": row["pos"], "subroot": subroot, "lefts": [a for a, _ in path], "rights": [b for _, b in path]}


def descended(levels: list[DataFrame], outer: DataFrame, shape: Shape) -> DataFrame:
    """The paths of all nodes of ``levels[0]``, from the paths of the trees' roots."""
    for nodes in reversed(levels):
        outer = durable(exchanged(nodes, outer, as_outer, PATHS, shape))
    return outer


def manifest(docs: DataFrame, columns: list[str], id_column: str = "doc_id", source: str = "source", seen: dict[str, Column] | None = None, proofs: bool = False, shape: Shape = Shape()) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of ``docs``; with ``proofs`` also its siblings.

    ``columns`` are what a leaf's digest covers. ``seen`` replaces some of them by what a reader is given (say, a tampered text): the
    proof, always of the true siblings, is folded from the leaf of that, and ``verified`` says if it gives the root. A node is the SHA-256
    of up to ``shape.arity`` digests in hex, concatenated; a source's tree ends when one node is left, and the sources' roots, null first
    and then bytewise, are the leaves of the last tree. Siblings come as two lists, upwards: what stands left and right
    of the node in its run.

    Rows of one id are leaves next to each other, in the order of their digests; a null id comes first. Null
    values have their own mark. An empty table gives no rows.
    """
    given = [(seen or {}).get(c, F.col(c)) for c in columns]
    named = F.col(source).cast("string")
    tree = F.when(named.isNull(), "-").otherwise(F.concat(F.lit("="), named))  # "-" sorts before "="
    leaf = F.sha2(encoded(columns), 256)
    table = durable(docs.select(tree.alias("tree"), F.col(id_column).alias("number"), F.col(id_column).cast("string").alias("id"), leaf.alias("node"), F.sha2(encoded(given), 256).alias("given"), F.monotonically_increasing_id().alias("row")))
    leaves = durable(ranked(table, "tree", "pos", "n", ["number", "node", "row"]).drop("number", "row"))
    levels, subroots = climbed(leaves, shape)

    tops = durable(ranked(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node"), "tree", "pos", "n", ["name"]))
    top_levels, roots = climbed(tops, shape)
    found = roots.first()
    root = found["node"] if found else None
    none = docs.sparkSession.createDataFrame([("", 0, None, [], [])], PATHS)
    above = descended(top_levels, none, shape).join(tops.select("pos", "name", "node"), "pos")
    above = durable(above.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), F.col("node").alias("subroot"), "lefts", "rights"))
    outer = descended(levels[1:], above, shape)

    def finish(row: dict, subroot: str, path: Path) -> dict:
        end = folded(row["given"], path)
        out = {"id": row["id"], "leaf": row["node"], "subroot": subroot, "root": root, "proof_sha256": digest("".join(a + b for a, b in path)), "folded_root": end, "verified": end == root}
        return out | ({"lefts": [a for a, _ in path], "rights": [b for _, b in path]} if proofs else {})

    fields = "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    fields += ", lefts array<string>, rights array<string>" if proofs else ""
    out = exchanged(leaves, outer, finish, fields, shape)
    return out.select(F.col("id").cast(docs.schema[id_column].dataType).alias(id_column), *out.columns[1:])
