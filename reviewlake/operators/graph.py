"""The property graph: neighbours, closure, paths, cycles, and point operations.

edges has from_id, to_id, kind (and edge_idx); nodes has id, kind, name, file_path, line and more. Closure runs in
rounds: a frontier is joined to the edges and cut down by an anti-join with what was visited, so cyclic graphs
end, and each round's tables are written to the shared folder. Many starts run at once, told apart by `seed`.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.operators.tables import written

UNBOUNDED = 1 << 30
#: Edges of a graph, or of one weak component of it, that one task may search.
ONE_TASK = 1_000_000


def direct_dependents(edges: DataFrame, node: int) -> DataFrame:
    return edges.filter(F.col("to_id") == node).select(F.col("from_id").alias("id")).distinct()


def dependencies(edges: DataFrame, node: int) -> DataFrame:
    return edges.filter(F.col("from_id") == node).select(F.col("to_id").alias("id")).distinct()


def by_edge_kind(edges: DataFrame, node: int, kind: str) -> DataFrame:
    return dependencies(edges.filter(F.col("kind") == kind), node)


def by_edge_kind_reverse(edges: DataFrame, node: int, kind: str) -> DataFrame:
    return direct_dependents(edges.filter(F.col("kind") == kind), node)


def closure(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, reverse: bool = True, kinds: Iterable[str] = ()) -> DataFrame:
    """seed, id, depth: what each seed (column id) reaches over the edges, without the seed itself.

    reverse: against the edges (dependents). Depth 1 are neighbours; None goes on until nothing is new.
    """
    if kinds:
        edges = edges.filter(F.col("kind").isin(list(kinds)))
    source, target = ("to_id", "from_id") if reverse else ("from_id", "to_id")
    steps = edges.select(F.col(source).alias("id"), F.col(target).alias("next")).filter("id <> next").distinct()
    if max_depth is None or max_depth > 2:
        steps = written(steps, "closure-steps")  # read in each round
    frontier = seeds.select(F.col("id").alias("seed"), "id").distinct()
    found = frontier.withColumn("depth", F.lit(0))
    depth = 0
    while depth < (UNBOUNDED if max_depth is None else max_depth):
        depth += 1
        reached = frontier.join(steps, "id").select("seed", F.col("next").alias("id")).distinct()
        fresh = written(reached.join(found, ["seed", "id"], "left_anti"), "closure-frontier")
        if fresh.isEmpty():
            break
        found = found.unionByName(fresh.withColumn("depth", F.lit(depth)))
        if depth % 8 == 0:
            found = written(found, "closure-found")
        frontier = fresh
    return found.filter("depth > 0")


def transitive_dependents(edges: DataFrame, node: int, max_depth: int | None = None) -> DataFrame:
    return closure(edges, _one(edges, node), max_depth).select("id", "depth")


def transitive_callers(edges: DataFrame, node: int, max_depth: int | None = None) -> DataFrame:
    return closure(edges, _one(edges, node), max_depth, kinds=["Calls"]).select("id", "depth")


def transitive_dependencies(edges: DataFrame, node: int, max_depth: int | None = None) -> DataFrame:
    return closure(edges, _one(edges, node), max_depth, reverse=False).select("id", "depth")


def _one(edges: DataFrame, node: int) -> DataFrame:
    return edges.sparkSession.range(1).select(F.lit(node).cast("long").alias("id"))


def simple_paths(edges: DataFrame, start: int, end: int, max_length: int) -> DataFrame:
    """path: all simple paths with at most max_length nodes; parallel edges give a path each."""
    paths = edges.sparkSession.range(1).select(F.array(F.lit(start).cast("long")).alias("path"))
    done = paths.filter(F.lit(start == end) & F.lit(max_length >= 1))
    if start == end:
        return done
    for _ in range(max_length - 1):
        last = paths.withColumn("from_id", F.element_at("path", -1))
        grown = last.join(edges.select("from_id", "to_id"), "from_id").filter(~F.array_contains("path", F.col("to_id")))
        paths = grown.select(F.concat("path", F.array("to_id")).alias("path"))
        done = done.unionByName(paths.filter(F.element_at("path", -1) == end))
        paths = paths.filter(F.element_at("path", -1) != end)
    return done


def components(edges: DataFrame) -> DataFrame:
    """id, component (its smallest id) of weakly connected components.

    While there are more edges than one task may search, each node is merged into the least of itself and its
    neighbours by a hash that changes with the round, so that long paths and rings shrink by a constant share.
    Every round is whole: merged nodes are adjacent, and the edges between merged nodes stay.
    """
    live = written(edges.select(F.least("from_id", "to_id").alias("a"), F.greatest("from_id", "to_id").alias("b")).filter("a <> b").distinct(), "cc-edges")
    ends = live.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    merged: list[DataFrame] = []
    while live.count() > ONE_TASK:
        turn = F.lit(len(merged))
        rank = lambda c: F.struct(F.xxhash64(c, turn).alias("h"), F.col(c).alias("k"))  # noqa: E731, B023
        sides = live.select("a", rank("b").alias("r")).unionByName(live.select(F.col("b").alias("a"), rank("a").alias("r")))
        near = sides.groupBy("a").agg(F.min("r").alias("r"))
        to = written(near.select(F.col("a").alias("id"), F.least("r", rank("a"))["k"].alias("root")), "cc-merged")
        moved = live.join(to.select(F.col("id").alias("a"), F.col("root").alias("x")), "a").join(to.select(F.col("id").alias("b"), F.col("root").alias("y")), "b")
        live = written(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a <> b").distinct(), "cc-edges")
        merged.append(to)
    rest = written(live.groupBy(F.lit(0).alias("all")).applyInPandas(_united, "id bigint, root bigint"), "cc-rest")
    if not merged:
        return rest.select("id", F.col("root").alias("component"))
    labels = ends.select("id", F.col("id").alias("root"))
    for table in [*merged, rest]:
        labels = labels.join(table.select(F.col("id").alias("root"), F.col("root").alias("next")), "root", "left").select("id", F.coalesce("next", "root").alias("root"))
    labels = written(labels, "cc-labels")
    return labels.join(labels.groupBy("root").agg(F.min("id").alias("component")), "root").select("id", "component")


def _numbered(x, y):
    """The distinct ids in order, and x and y as places among them."""
    import numpy as np

    ids, place = np.unique(np.concatenate([x, y]), return_inverse=True)
    return ids, place[: len(x)], place[len(x) :]


def _united(pdf):
    import pandas as pd

    ids, x, y = _numbered(pdf["a"].to_numpy(), pdf["b"].to_numpy())
    up = list(range(len(ids)))
    for a, b in zip(x.tolist(), y.tolist(), strict=True):
        while up[a] != a:
            up[a] = a = up[up[a]]
        while up[b] != b:
            up[b] = b = up[up[b]]
        if a < b:
            up[b] = a
        else:
            up[a] = b
    for k in range(len(up)):  # what a node points to is smaller, and done
        up[k] = up[up[k]]
    return pd.DataFrame({"id": ids, "root": ids[up]})


def _trimmed(live: DataFrame, least: float = 0.0) -> tuple[DataFrame, int]:
    """Edges whose ends all have both incoming and outgoing edges, trimmed round by round, and their number.

    least: a round that takes no more than this share of the edges is the last.
    """
    size = live.count()
    while True:
        left = live.join(live.select(F.col("to_id").alias("from_id")).distinct(), "from_id", "left_semi").join(live.select(F.col("from_id").alias("to_id")).distinct(), "to_id", "left_semi").select("from_id", "to_id")
        live = written(left, "scc-edges")
        before, size = size, live.count()
        if before - size <= least * before:
            return live, size


def mutual_reach(edges: DataFrame) -> DataFrame:
    """id, scc: members of strongly connected components of two nodes or more, scc being the smallest member.

    Nodes without an incoming or an outgoing edge are trimmed, as long as that takes many edges. A strong component lies
    in one weak component: those of up to ONE_TASK edges are searched by tasks, many together, and turns over tables
    are left for larger ones.
    """
    live = written(edges.select("from_id", "to_id").filter("from_id <> to_id").distinct(), "scc-edges")
    live, size = _trimmed(live, 0.25)
    if size <= ONE_TASK:
        return _searched(live, 1)
    parts = components(live)
    inside = written(live.join(parts.withColumnRenamed("id", "from_id"), "from_id"), "scc-parts")
    large = written(inside.groupBy("component").count().filter(F.col("count") > ONE_TASK).select("component"), "scc-large")
    if large.isEmpty():
        return _searched(inside, -(-size // ONE_TASK))
    # Components of more edges are few: at most one for each ONE_TASK edges.
    small = _searched(inside.join(F.broadcast(large), "component", "left_anti"), -(-size // ONE_TASK))
    return small.unionByName(_by_turns(inside.join(F.broadcast(large), "component", "left_semi").select("from_id", "to_id")))


def _searched(edges: DataFrame, tasks: int) -> DataFrame:
    """The strong components of whole weak components (column component, where there are several tasks)."""
    key = F.pmod(F.xxhash64("component"), F.lit(tasks)) if tasks > 1 else F.lit(0)
    return written(edges.groupBy(key.alias("task")).applyInPandas(_strong, "id bigint, scc bigint"), "scc-found")


def _strong(pdf):
    """Tarjan's search without recursion."""
    import numpy as np
    import pandas as pd

    ids, x, y = _numbered(pdf["from_id"].to_numpy(), pdf["to_id"].to_numpy())
    order = np.argsort(x, kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(x, minlength=len(ids)))]).tolist()
    after, at = y[order].tolist(), first[:-1]
    index, low, own = [-1] * len(ids), [0] * len(ids), [-1] * len(ids)
    stack: list[int] = []
    count = 0
    for start in range(len(ids)):
        if index[start] >= 0:
            continue
        walk = [start]
        while walk:
            v = walk[-1]
            if index[v] < 0:
                index[v] = low[v] = count
                count += 1
                stack.append(v)
            deeper = False
            while at[v] < first[v + 1]:
                w = after[at[v]]
                if index[w] < 0:
                    walk.append(w)
                    deeper = True
                    break
                at[v] += 1
                if own[w] < 0:
                    low[v] = min(low[v], low[w])
            if deeper:
                continue
            walk.pop()
            if low[v] == index[v]:
                group = []
                while not group or group[-1] != v:
                    group.append(stack.pop())
                least = min(group)
                for w in group:
                    own[w] = least
    own = np.array(own, np.int64)
    use = np.bincount(own, minlength=len(ids))[own] > 1
    return pd.DataFrame({"id": ids[use], "scc": ids[own[use]]})


def _by_turns(edges: DataFrame) -> DataFrame:
    """mutual_reach() by turns over tables, for weak components of any size.

    Nodes without an incoming or an outgoing edge are trimmed first. Each node then takes as colour the least of the
    nodes that reach it, by a hash so that chains of components need few turns; a component lies within one colour,
    and what reaches the colour's own node inside it is one. Tables have a row for each node or edge, never for pairs.
    """
    live, _ = _trimmed(written(edges, "scc-edges"))
    found = live.select(F.col("from_id").alias("id"), F.col("from_id").alias("root")).limit(0)
    while not live.isEmpty():
        rank = F.struct(F.xxhash64("id").alias("h"), F.col("id").alias("k"))
        colours = written(live.select(F.col("from_id").alias("id")).distinct().select("id", rank.alias("colour"), F.lit(True).alias("moved")), "scc-colours")
        while not colours.filter("moved").isEmpty():
            near = live.join(colours.filter("moved").select(F.col("id").alias("from_id"), "colour"), "from_id").groupBy(F.col("to_id").alias("id")).agg(F.min("colour").alias("m"))
            step = colours.join(near, "id", "left").select("id", F.least("colour", "m").alias("colour"), F.coalesce(F.col("m") < F.col("colour"), F.lit(False)).alias("moved"))
            colours = written(step, "scc-colours")
        own = colours.select("id", F.col("colour.k").alias("root"))
        same = live.join(own.withColumnRenamed("id", "from_id"), "from_id").join(own.select(F.col("id").alias("to_id"), F.col("root").alias("other")), "to_id")
        same = written(same.filter("root = other").select("from_id", "to_id"), "scc-same")
        members = frontier = own.filter("id = root")
        turn = 0
        while not frontier.isEmpty():
            turn += 1
            reached = same.join(frontier.select(F.col("id").alias("to_id"), "root"), "to_id").select(F.col("from_id").alias("id"), "root").distinct()
            frontier = written(reached.join(members, "id", "left_anti"), "scc-frontier")
            members = members.unionByName(frontier)
            if turn % 8 == 0:
                members = written(members, "scc-members")
        members = written(members, "scc-members")
        found = found.unionByName(members)
        left = same.join(members.select(F.col("id").alias("from_id")), "from_id", "left_anti").join(members.select(F.col("id").alias("to_id")), "to_id", "left_anti")
        live, _ = _trimmed(written(left.select("from_id", "to_id"), "scc-edges"))
    least = found.groupBy("root").agg(F.min("id").alias("scc"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return found.join(least, "root").select("id", "scc")


def import_cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """cycle (ids, the smallest first): cycles of File-Imports-File edges that a depth-first search closes.

    The search follows ids and edge numbers in ascending order, within each weak component of the edges that lie on
    cycles; like the reference's search it tells a cycle for each back edge, not all elementary cycles.
    """
    files = nodes.filter("kind = 'File'").select("id")
    imports = edges.filter("kind = 'Imports'").join(files.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(files.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    order = "edge_idx" if "edge_idx" in edges.columns else "to_id"
    held = written(imports.select("from_id", "to_id", F.col(order).cast("long").alias("idx")), "cycle-edges")
    inner = held.join(mutual_reach(held).select(F.col("id").alias("from_id"), F.col("scc").alias("component")), "from_id")
    ends = inner.select("component", F.col("from_id").alias("to_id")).distinct()
    inner = inner.join(ends, ["component", "to_id"], "left_semi").select("component", "from_id", "to_id", "idx")
    loops = held.filter("from_id = to_id").select(F.array("from_id").alias("cycle")).distinct()
    # Edges stay within components, so a search of several together is that of each.
    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return inner.groupBy(F.pmod(F.xxhash64("component"), F.lit(tasks)).alias("task")).applyInPandas(_search, "cycle array<bigint>").distinct().unionByName(loops).distinct()


def _search(pdf):
    import pandas as pd

    out: dict[tuple[int, ...], None] = {}
    after: dict[int, list[int]] = {}
    for a, b in pdf.sort_values(["from_id", "idx", "to_id"])[["from_id", "to_id"]].itertuples(index=False):
        after.setdefault(int(a), []).append(int(b))
    done: set[int] = set()
    for root in sorted(after):
        if root in done:
            continue
        path, place, walks = [root], {root: 0}, [iter(after.get(root, ()))]
        while walks:
            step = next(walks[-1], None)
            if step is None:
                walks.pop()
                done.add(path[-1])
                del place[path.pop()]
            elif step in place:
                ring = path[place[step] :]
                k = ring.index(min(ring))
                out[tuple(ring[k:] + ring[:k])] = None
            elif step not in done:
                place[step] = len(path)
                path.append(step)
                walks.append(iter(after.get(step, ())))
    return pd.DataFrame({"cycle": [list(c) for c in out]})


def top_level(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that a File contains."""
    files = nodes.filter("kind = 'File'").select(F.col("id").alias("from_id"))
    inside = edges.filter("kind = 'Contains'").join(files, "from_id", "left_semi").select(F.col("to_id").alias("id"))
    return nodes.join(inside, "id", "left_semi")


def without_callers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    called = edges.filter(F.col("kind").isin("Calls", "References")).select(F.col("to_id").alias("id"))
    return nodes.join(called, "id", "left_anti")


def find_nodes(nodes: DataFrame, path: str, name: str | None = None) -> DataFrame:
    found = nodes.filter(F.col("file_path") == path)
    return found if name is None else found.filter(F.col("name") == name)


def edges_from(edges: DataFrame, node: int) -> DataFrame:
    return edges.filter(F.col("from_id") == node)


def edges_to(edges: DataFrame, node: int) -> DataFrame:
    return edges.filter(F.col("to_id") == node)


def remove_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without the nodes in ids (column id) and their edges."""
    left = edges.join(ids.select(F.col("id").alias("from_id")), "from_id", "left_anti").join(ids.select(F.col("id").alias("to_id")), "to_id", "left_anti")
    return nodes.join(ids.select("id"), "id", "left_anti"), left.select(*edges.columns)


def merge(*graphs: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """One graph from several; ids are unique by construction (file ordinal and place), so nothing is renumbered."""
    nodes, edges = graphs[0]
    for n, e in graphs[1:]:
        nodes, edges = nodes.unionByName(n), edges.unionByName(e)
    return nodes, edges


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes, edges, files: one row."""
    own = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("kind") == "File").alias("files"))
    return own.join(edges.agg(F.count(F.lit(1)).alias("edges")))
