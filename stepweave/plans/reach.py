"""Graph queries over edges (source, target): successors, neighbourhoods, reachability, and edits that keep a graph sound."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.schema import END, HOPS, START
from stepweave.sources.arrival import written


def successors(edges: DataFrame, source: str, process_type: str | None = None) -> DataFrame:
    """Edges out of a node, in edge order; process_type keeps those whose modal condition has it."""
    out = edges.where(F.col("source") == source)
    return (out if process_type is None else out.where(F.col("process_type") == process_type)).orderBy("source", "target")


def neighbourhood(edges: DataFrame, starts: DataFrame, hops: int = HOPS) -> DataFrame:
    """start, hop, source, target: edges within `hops` of each start; a node is left once, at its nearest hop."""
    pairs = edges.select("source", "target").distinct()
    front = starts.select(F.col("node").alias("start"), "node").distinct()
    visited, found = front, None
    for hop in range(1, hops + 1):
        out = front.join(pairs, front["node"] == pairs["source"]).select("start", F.lit(hop).alias("hop"), "source", "target")
        found = out if found is None else found.unionByName(out)
        front = out.select("start", F.col("target").alias("node")).distinct().join(visited, ["start", "node"], "left_anti")
        visited = visited.unionByName(front)
    return found


def reachable(edges: DataFrame, start: str = START, backwards: bool = False) -> DataFrame:
    """Nodes that a walk from `start` reaches (or, backwards, that reach it), itself included."""
    pairs = edges.select("source", "target").distinct()
    if backwards:
        pairs = pairs.select(F.col("target").alias("source"), F.col("source").alias("target"))
    front = edges.sparkSession.createDataFrame([(start,)], "node string")
    seen = front
    while not front.isEmpty():
        step = front.join(pairs, front["node"] == pairs["source"]).select(F.col("target").alias("node")).distinct()
        front = written(step.join(seen, "node", "left_anti"))
        seen = seen.unionByName(front)
    return seen


def structure(edges: DataFrame) -> DataFrame:
    """node, from_start and to_end of every node."""
    names = edges.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    forth, back = reachable(edges).withColumn("f", F.lit(True)), reachable(edges, END, backwards=True).withColumn("t", F.lit(True))
    return names.join(forth, "node", "left").join(back, "node", "left").select("node", F.coalesce("f", F.lit(False)).alias("from_start"), F.coalesce("t", F.lit(False)).alias("to_end"))


@dataclass
class GraphEditor:
    """Adds, deletes and revises authored moves; a refusal names its reason and leaves the graph as it was."""

    edges: DataFrame
    rejections: list[tuple[str, str, str]] = field(default_factory=list)

    def _has(self, source: str, target: str) -> bool:
        return not self.edges.where((F.col("source") == source) & (F.col("target") == target)).isEmpty()

    def _known(self, node: str) -> bool:
        return node in (START, END) or not self.edges.where((F.col("source") == node) | (F.col("target") == node)).isEmpty()

    def _apply(self, proposed: DataFrame, source: str, target: str, reason: str | None) -> bool:
        if reason is None:
            own = self.edges.select(F.explode(F.array("source", "target")).alias("node")).distinct()
            after = own.join(structure(proposed), "node", "left").agg(F.bool_and(F.coalesce("from_start", F.lit(False))).alias("f"), F.bool_and(F.coalesce("to_end", F.lit(False))).alias("t")).first()
            reason = None if after.f and after.t else "unreachable" if not after.f else "dead_end"
        if reason:
            self.rejections.append((source, target, reason))
            return False
        self.edges = proposed
        return True

    def _authored(self, source: str, target: str) -> DataFrame:
        return self.edges.sparkSession.createDataFrame([(source, target, 0, 0.0, "Unknown")], "source string, target string, support long, weight double, process_type string")

    def _without(self, source: str, target: str) -> DataFrame:
        return self.edges.where(~((F.col("source") == source) & (F.col("target") == target)))

    def add(self, source: str, target: str) -> bool:
        reason = "unknown_node" if not (self._known(source) and self._known(target)) else "duplicate_move" if self._has(source, target) else None
        return self._apply(self.edges.unionByName(self._authored(source, target), allowMissingColumns=True), source, target, reason)

    def delete(self, source: str, target: str) -> bool:
        return self._apply(self._without(source, target), source, target, None if self._has(source, target) else "unknown_move")

    def revise(self, source: str, target: str, new_target: str) -> bool:
        reason = "unknown_move" if not self._has(source, target) else "unknown_node" if not self._known(new_target) else "duplicate_move" if self._has(source, new_target) else None
        return self._apply(self._without(source, target).unionByName(self._authored(source, new_target), allowMissingColumns=True), source, new_target, reason)
