"""Connected components of an edge table: of parts of it first, then of what joins these by alternating large-star and small-star rounds.

A task brings its edges, some at a time, to stars: each node with the smallest that it meets there. Nodes that are in several
stars join these, and only these joints go through rounds, so there are few where edges that are near each other are read
together. Each round is two min-aggregations and two joins over the joints; its result is written to the shared folder,
so neither lineage nor lost executors make a later round start over. Ends when a round changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweft.tables import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every edge has a > b here, so the neighbours of a are no larger than it."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    rest = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _joined(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The smallest of 0..n-1 that each of them is joined with by the edges x, y: roots are hung below smaller ones, until none is left to hang."""
    least = np.arange(n)
    while len(x):
        a, b = least[x], least[y]
        apart = a != b
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))
        while (up := least[least]).tobytes() != least.tobytes():
            least = up
    return least


def _stars(batches: Iterator[pa.RecordBatch], most: int = 250_000) -> Iterator[pa.RecordBatch]:
    """node, root of every node of some `most` edges at a time."""

    def made(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ends = [np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in ("x", "y")]
        nodes, at = np.unique(np.concatenate(ends), return_inverse=True)
        roots = nodes[_joined(at[: len(ends[0])], at[len(ends[0]) :], len(nodes))]
        return pa.RecordBatch.from_arrays([pa.array(c, held[0].schema.field("x").type) for c in (nodes, roots)], ["node", "root"])

    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= most:
            yield made(held)
            held, rows = [], 0
    if rows:
        yield made(held)


def _sign(edges: DataFrame) -> tuple[int, int]:
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first())


def components(edges: DataFrame, src: str = "a", dst: str = "b", max_rounds: int = 60, near: list[str] | None = None) -> DataFrame:
    """node, component (its smallest node) for every node that has an edge; nodes are whole numbers or texts. Self-loops and nulls join nothing.
    With near, columns of edges whose order keeps edges together that join each other, edges are dealt by their ranges first."""
    if near:
        edges = edges.repartitionByRange(*near)
    ends = edges.select(F.col(src).alias("x"), F.col(dst).alias("y")).where("x is not null and y is not null")
    kind = ends.schema["x"].dataType.simpleString()
    stars = materialize(ends.mapInArrow(_stars, f"node {kind}, root {kind}"), "stars")
    least = materialize(stars.groupBy("node").agg(F.min("root").alias("root"), F.count_distinct("root").alias("n")), "least")
    several = least.where("n > 1").select("node", F.col("root").alias("b"))
    now = materialize(stars.join(several, "node").where("root <> b").select(F.col("root").alias("a"), "b").distinct(), "edges", replaces=stars)
    seen = _sign(now)
    if not seen[0]:
        return least.select("node", F.col("root").alias("component"))
    for _ in range(max_rounds):
        now = materialize(_small_star(_large_star(now)), "edges", replaces=now)
        sign = _sign(now)
        if sign == seen:
            break
        seen = sign
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return least.join(now.withColumnsRenamed({"a": "root", "b": "component"}), "root", "left").select("node", F.coalesce("component", "root").alias("component"))
