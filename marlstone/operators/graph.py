"""Stable topological order of many graphs at once.

Groups are files or trees, so one group fits a task; any number of groups
spreads over the cluster.  Nodes and edges are folded to arrays by group and one
Arrow function orders each group with a heap.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def order(n: int, edges: list[tuple[int, int]]) -> tuple[list[int] | None, list[int]]:
    """Nodes 0..n-1 in order, or None on a cycle; and each node's component, named by its least node.

    Components come by their least node; within one, the least node whose
    predecessors are out comes next.
    """
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    waits, after = [0] * n, [[] for _ in range(n)]
    for a, b in edges:
        after[a].append(b)
        waits[b] += 1
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    part = [find(x) for x in range(n)]
    ready = [(part[x], x) for x in range(n) if not waits[x]]
    heapq.heapify(ready)
    out = []
    while ready:
        _, x = heapq.heappop(ready)
        out.append(x)
        for y in after[x]:
            waits[y] -= 1
            if not waits[y]:
                heapq.heappush(ready, (part[y], y))
    return (out if len(out) == n else None), part


def order_ids(ids: list[str], edges: list[tuple[str, str]]) -> list[str] | None:
    """The ids of one group, repeated ones once, in ``order``; edges that leave the group are dropped."""
    own = list(dict.fromkeys(ids))
    place = {x: k for k, x in enumerate(own)}
    out, _ = order(len(own), [(place[a], place[b]) for a, b in edges if a in place and b in place])
    return None if out is None else [own[k] for k in out]


def inner_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges (group_id, src, dst) whose ends both are nodes (group_id, id) of the group."""
    ends = nodes.select("group_id", "id").distinct()
    by_src = edges.join(ends.withColumnRenamed("id", "src"), ["group_id", "src"], "left_semi")
    return by_src.join(ends.withColumnRenamed("id", "dst"), ["group_id", "dst"], "left_semi")


def distinct_nodes(nodes: DataFrame) -> DataFrame:
    """First occurrence of each id: (group_id, id, idx)."""
    return nodes.groupBy("group_id", "id").agg(F.min("idx").alias("idx"))


def in_degrees(edges: DataFrame) -> DataFrame:
    """Incoming edges, parallel ones counted."""
    return edges.groupBy("group_id", F.col("dst").alias("id")).agg(F.count("*").alias("degree"))


def toposort(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(group_id, ok, id, rank, component): the order of each group's nodes.

    ``nodes`` (group_id, idx, id), ``edges`` (group_id, src, dst).  A group with a
    cycle has one row with ok false.  Edges to other groups' nodes are dropped.
    """
    own = distinct_nodes(nodes)
    packed = own.groupBy("group_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "id"))), lambda x: x["id"]).alias("ids"))
    pairs = edges.groupBy("group_id").agg(F.collect_list(F.struct("src", "dst")).alias("pairs"))
    both = packed.join(pairs, "group_id", "left")
    # Ends become positions; edges that leave the group have no position.
    at = lambda x: F.array_position("ids", x)
    small = F.size("ids") <= 64
    local = F.when(small, F.filter(F.transform(F.col("pairs"), lambda p: F.struct(at(p["src"]).alias("a"), at(p["dst"]).alias("b"))), lambda p: (p["a"] > 0) & (p["b"] > 0)))

    @F.pandas_udf("ok boolean, ranks array<int>, parts array<int>")
    def ordered(ids: pd.Series, pairs: pd.Series, local: pd.Series) -> pd.DataFrame:
        rows = []
        for own_ids, edges_of, short in zip(ids, pairs, local, strict=True):
            if short is not None:
                known = [(int(e["a"]) - 1, int(e["b"]) - 1) for e in short]
            else:
                place = {x: k for k, x in enumerate(own_ids)}
                known = [(place[e["src"]], place[e["dst"]]) for e in (edges_of if edges_of is not None else ()) if e["src"] in place and e["dst"] in place]
            out, part = order(len(own_ids), known)
            rows.append((out is not None, out or [], part))
        return pd.DataFrame(rows, columns=["ok", "ranks", "parts"])

    done = both.withColumn("r", ordered("ids", "pairs", local))
    good = done.filter("r.ok").select("group_id", "ids", "r.parts", F.posexplode("r.ranks").alias("rank", "k"))
    good = good.select("group_id", F.lit(True).alias("ok"), F.get("ids", F.col("k")).alias("id"), "rank", F.get("ids", F.get("parts", F.col("k"))).alias("component"))
    kind = good.schema["id"].dataType
    bad = done.filter("not r.ok").select("group_id", F.lit(False).alias("ok"), F.lit(None).cast(kind).alias("id"), F.lit(None).cast("int").alias("rank"), F.lit(None).cast(kind).alias("component"))
    return good.unionByName(bad)
