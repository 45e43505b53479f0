"""Strongly connected components and one cycle of each, of any length: contraction, colouring, and paths carried by edges."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import drop, stash

#: Rounds beyond which a loop is taken not to end, and the edges a removed node that make a round of contraction worth its jobs.
ROUNDS, WORTH = 10_000, 12
#: Edges up to which a group is worked on within one task; larger ones go through the rounds.
WITHIN = 100_000


def removable(edges: DataFrame, round_: int, keep: DataFrame | None = None) -> DataFrame:
    """Nodes v with one way in or one way out, no two of them adjacent: those whose hash is the least among such neighbours."""
    ways = edges.select(F.col("a").alias("v"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(edges.select("b", F.lit(1), F.lit(0))).groupBy("v").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    narrow = ways.where("i = 1 or o = 1").select("v")
    if keep is not None:
        narrow = narrow.join(keep.select(F.col("node").alias("v")), "v", "left_anti")
    rank = lambda c: F.struct(F.xxhash64(c, F.lit(round_)), c)
    both = edges.join(narrow.select(F.col("v").alias("a")), "a").join(narrow.select(F.col("v").alias("b")), "b").select("a", "b")
    beaten = both.select(F.when(rank(F.col("a")) < rank(F.col("b")), F.col("b")).otherwise(F.col("a")).alias("v")).distinct()
    return narrow.join(beaten, "v", "left_anti")


def contracted(edges: DataFrame, keep: DataFrame | None = None, paths: bool = False) -> tuple[DataFrame, list[tuple[DataFrame, DataFrame]], DataFrame | None]:
    """Edges (a, b) when nodes with one way in or out are passed by, again and again: the rest, what each round removed, and closed paths.

    Passing v by puts an edge from before v to behind it in place of the two, so edges never become more and a chain of n
    nodes takes log n rounds; it ends when a round finds few such nodes. A round is (nodes v, their edges). Loops are dropped. With paths, edges carry the nodes `via`
    between their ends, the shortest list for equal ends, then the least; and the loops of nodes in `keep` are returned (node, via).
    """
    columns = ["a", "b", *(["via"] if paths else [])]
    now, rounds, loops = stash(edges.select(columns), "edges"), [], None
    for k in range(ROUNDS):
        gone = stash(removable(now, k, keep), "gone")
        if gone.count() * WORTH <= now.count():
            drop(gone)
            return now, rounds, loops
        into, out = now.join(gone.select(F.col("v").alias("b")), "b"), now.join(gone.select(F.col("v").alias("a")), "a")
        rest = now.join(gone.select(F.col("v").alias("a")), "a", "left_anti").join(gone.select(F.col("v").alias("b")), "b", "left_anti").select(columns)
        first = into.select("a", F.col("b").alias("v"), *([F.col("via").alias("x")] if paths else []))
        then = out.select(F.col("a").alias("v"), "b", *([F.col("via").alias("y")] if paths else []))
        past = first.join(then, "v").select("a", "b", *([F.concat("x", F.array("v"), "y").alias("via")] if paths else []))
        if paths:
            made = stash(rest.union(past), "past")
            closed = made.where("a = b").select(F.col("a").alias("node"), "via")
            loops = closed if loops is None else loops.union(closed)
            best = made.where("a <> b").groupBy("a", "b").agg(F.min(F.struct(F.size("via").alias("n"), "via")).alias("m")).select("a", "b", F.col("m.via").alias("via"))
            last, now = now, stash(best, "edges")
            drop(last)
        else:
            rounds.append((gone, stash(into.select("a", "b").union(out.select("a", "b")), "around")))
            last, now = now, stash(rest.union(past).where("a <> b").distinct(), "edges")
            drop(last)
    raise RuntimeError(f"more than {ROUNDS} rounds")


def strong(ways: dict) -> dict:
    """For each node of ways (node: its successors, every node a key) the least node of its strongly connected component."""
    order, low, stack, found = {}, {}, [], {}
    for root in ways:
        todo = [] if root in order else [(root, iter(ways[root]))]
        while todo:
            v, onward = todo[-1]
            if v not in order:
                order[v] = low[v] = len(order)
                stack.append(v)
            for w in onward:
                if w not in order:
                    todo.append((w, iter(ways[w])))
                    break
                if w not in found:
                    low[v] = min(low[v], order[w])
            else:
                todo.pop()
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[v])
                if low[v] == order[v]:
                    at = len(stack) - 1
                    while stack[at] != v:
                        at -= 1
                    found |= dict.fromkeys(stack[at:], min(stack[at:]))
                    del stack[at:]
    return found


def least_cycle(start, ways: dict) -> list | None:
    """The shortest way from start back to it, of those the least, node by node; None if there is none."""
    before: dict = {}
    for a, onward in ways.items():
        for b in onward:
            before.setdefault(b, []).append(a)
    far, front = {start: 0}, [start]
    while front:
        front = [w for v in front for w in before.get(v, ()) if far.setdefault(w, far[v] + 1) == far[v] + 1 and w != start]
        front = list(dict.fromkeys(front))
    if start in ways[start]:
        return [start]
    left, path = min((far[w] for w in ways[start] if w in far), default=None), [start]
    if left is None:
        return None
    while left:
        path.append(min(w for w in ways[path[-1]] if far.get(w) == left))
        left -= 1
    return path


def within_groups(edges: DataFrame, group: str, cycles: bool) -> tuple[DataFrame, DataFrame]:
    """Results for the groups of WITHIN edges or fewer, one after the other within tasks, and the edges (a, b) of larger ones.

    Edges of different groups must share no node. Results are (node, component), or with `cycles` (component, n_nodes, cycle).
    """
    clean = stash(edges.select(F.col(group).alias("g"), "a", "b").where("a is not null and b is not null").distinct(), "grouped")
    large = stash(clean.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > WITHIN).select("g"), "large")
    small = clean.join(large, clean["g"].eqNullSafe(large["g"]), "left_anti")
    kind = clean.schema["a"].dataType.simpleString()
    schema = f"component {kind}, n_nodes bigint, cycle array<{kind}>" if cycles else f"node {kind}, component {kind}"
    names = [c.split()[0] for c in schema.split(", ")]

    def settled(ways: dict) -> list[tuple]:
        found = strong(ways)
        if not cycles:
            return list(found.items())
        members: dict = {}
        for node, c in found.items():
            members.setdefault(c, []).append(node)
        inner = {c: {v: [w for w in ways[v] if found[w] == c] for v in nodes} for c, nodes in members.items() if len(nodes) > 1 or c in ways[c]}
        return [(c, len(members[c]), path) for c, ways_ in inner.items() if (path := least_cycle(c, ways_))]

    def run(batches):
        now, ways, rows = None, {}, []
        types = None
        for batch in batches:
            types = [batch.schema.field(1).type, pa.int64(), pa.list_(batch.schema.field(1).type)] if cycles else [batch.schema.field(1).type] * 2
            for g, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != now:
                    rows += settled(ways)
                    now, ways = g, {}
                ways.setdefault(a, []).append(b)
                ways.setdefault(b, [])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                rows = []
        rows = settled(ways)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    found = small.repartition("g").sortWithinPartitions("g").mapInArrow(run, schema)
    return stash(found, "within"), clean.join(large, clean["g"].eqNullSafe(large["g"]), "left_semi").select("a", "b")


def strong_components(edges: DataFrame, group: str | None = None) -> DataFrame:
    """(node, component) for each node of directed edges (a, b): component is the least node of its strongly connected component.

    Edges with a null end are ignored. Nodes with one way in or out are passed by first, so long chains and rings cost
    log n rounds. In what is left, colours run forward until each node has the greatest that reaches it; a colour's own
    node and those of that colour that reach it are a component, which is taken out, and the rest goes on. Nodes
    passed by then return in reverse: a node is in the component that it has both a way from and a way to, if there is one.
    Every step is written, and no node's edges are gathered in one row.

    With a column `group` of edges, of which no two share a node, groups of WITHIN edges or fewer are settled within tasks,
    after one shuffle of the edges, and only larger ones go through these rounds. Nodes are then texts or whole numbers.
    """
    if group:
        found, rest = within_groups(edges, group, False)
        return found if rest.isEmpty() else found.unionByName(strong_components(rest))
    clean = stash(edges.select("a", "b").where("a is not null and b is not null").distinct(), "directed")
    core, rounds, _ = contracted(clean.where("a <> b"))
    found = stash(clean.where("false").select(F.col("a").alias("node"), F.col("a").alias("s")), "strong")
    for _ in range(ROUNDS):
        # nodes without a way in or out are alone; peeling them first spares colours
        while True:
            n = core.count()
            kept = core.join(core.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(core.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b")
            last, core = core, stash(kept, "core")
            drop(last)
            if core.count() == n:
                break
        if not n:
            break
        colour = stash(core.select(F.col("a").alias("node")).union(core.select("b")).distinct().withColumn("s", F.col("node")), "colour")
        while True:
            came = core.join(colour, F.col("a") == F.col("node")).groupBy(F.col("b").alias("node")).agg(F.max("s").alias("came"))
            grown = colour.join(came, "node", "left").select("node", F.greatest("s", F.coalesce("came", "s")).alias("s"), (F.col("came") > F.col("s")).alias("moved"))
            last, colour = colour, stash(grown, "colour")
            drop(last)
            moved = colour.where("moved").isEmpty()
            if moved:
                break
        inner = stash(core.join(colour.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(colour.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b").where("sa = sb").select("a", "b", F.col("sa").alias("s")), "inner")
        back = stash(colour.where("node = s").select("node", "s"), "back")
        front = back
        while True:
            more = inner.join(front.select(F.col("node").alias("b"), "s"), ["b", "s"]).select(F.col("a").alias("node"), "s").distinct().join(back, ["node", "s"], "left_anti")
            front = stash(more, "front")
            if front.isEmpty():
                break
            back = stash(back.union(front), "back")
        found = stash(found.union(back.select("node", "s")), "strong")
        core = stash(core.join(back.select(F.col("node").alias("a")), "a", "left_anti").join(back.select(F.col("node").alias("b")), "b", "left_anti").select("a", "b"), "core")
    else:
        raise RuntimeError(f"more than {ROUNDS} rounds")
    for gone, around in reversed(rounds):
        # a node outside all components so far is one by itself
        of = around.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(found, "node", "left").select("node", F.coalesce("s", "node").alias("s"))
        of = of.join(gone, F.col("node") == F.col("v"), "left_anti")
        into = around.join(of, F.col("a") == F.col("node")).select(F.col("b").alias("v"), "s")
        out = around.join(of, F.col("b") == F.col("node")).select(F.col("a").alias("v"), "s")
        joined = into.join(out, ["v", "s"]).select(F.col("v").alias("node"), "s").distinct()
        rings = joined.select(F.col("s").alias("node"), "s").distinct().join(found, "node", "left_anti")  # what a node passed by makes a component of
        last, found = found, stash(found.union(joined).union(rings), "strong")
        drop(last, gone, around)
    nodes = clean.select(F.col("a").alias("node")).union(clean.select("b")).distinct()
    least = found.groupBy("s").agg(F.min("node").alias("component"))
    named = stash(found.join(least, "s").select("node", "component"), "named")
    return nodes.join(named, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def canonical_cycles(edges: DataFrame, group: str | None = None) -> DataFrame:
    """One cycle of each strongly connected component that has one: component, n_nodes (of the component), cycle (an array of nodes).

    The cycle is the shortest through the component's least node, where it begins; of those the least, node by node. A node
    with an edge to itself alone is a cycle of one. Lengths have no bound: other nodes with one way in or out are
    passed by first, edges carrying the nodes between, and shortest paths then grow by one edge of the rest a round.
    With `group`, as for strong_components, only groups of more than WITHIN edges go through these rounds.
    """
    if group:
        found, rest = within_groups(edges, group, True)
        return found if rest.isEmpty() else found.unionByName(canonical_cycles(rest))
    member = stash(strong_components(edges), "member")
    sizes = member.groupBy("component").agg(F.count("*").alias("n_nodes"))
    clean = edges.select("a", "b").where("a is not null and b is not null").distinct()
    label = lambda x: member.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    inner = stash(clean.join(label("a"), "a").join(label("b"), "b").where("ca = cb").select("a", "b", "ca", F.slice(F.array("a"), 1, 0).alias("via")), "inner")
    starts = stash(inner.select(F.col("ca").alias("node")).distinct(), "starts")
    core, _, loops = contracted(inner.where("a <> b"), keep=starts, paths=True)
    closed = inner.where("a = b and a = ca").select(F.col("a").alias("node"), "via")
    if loops is not None:
        closed = closed.union(loops.join(starts, "node", "left_semi"))
    # shortest paths from the least node: node, start, and the nodes on the way, both ends left out
    out = core.join(starts.select(F.col("node").alias("a")), "a")
    seen = stash(out.select(F.col("b").alias("node"), F.col("a").alias("start"), "via"), "reach")
    while True:
        onward = core.join(starts.select(F.col("node").alias("a")), "a", "left_anti").select("a", "b", F.col("via").alias("y"))
        more = seen.join(onward, F.col("node") == F.col("a")).where("b <> start").select(F.col("b").alias("node"), "start", F.concat("via", F.array("a"), "y").alias("via"))
        best = seen.union(more).groupBy("node", "start").agg(F.min(F.struct(F.size("via").alias("n"), "via")).alias("m")).select("node", "start", F.col("m.via").alias("via"))
        last, seen = seen, stash(best, "reach")
        same = seen.join(last, ["node", "start"]).where(seen["via"] == last["via"]).count() == seen.count()
        drop(last)
        if same:
            break
    home = core.join(starts.select(F.col("node").alias("b")), "b").select("a", F.col("b").alias("start"), F.col("via").alias("y"))
    found = seen.join(home, [seen["node"] == home["a"], seen["start"] == home["start"]]).select(seen["start"].alias("node"), F.concat("via", F.array("a"), "y").alias("via"))
    every = closed.union(found).groupBy("node").agg(F.min(F.struct(F.size("via").alias("n"), "via")).alias("m"))
    return every.join(sizes, F.col("node") == F.col("component")).select("component", "n_nodes", F.concat(F.array("node"), "m.via").alias("cycle"))
