"""Parent-child rows to full hierarchies, with loops told apart.

1. Components are found by pointer doubling: each node's pointer jumps to its
   pointer's pointer until it rests. So that no component, however large, has to
   lie in one task, pointers also rest on cut nodes: a node of many children
   always is one, others are by a hash, with a chance of children / ``EVERY``.
   The subtrees that hang below a rest are pieces of about ``EVERY`` nodes.
2. Each piece is co-located and walked by an iterative depth-first search with
   node colours, which writes depths and, where wanted, paths; an edge back to a
   node still being walked closes a loop.
3. The cut nodes, each with the way to its own rest, are a smaller forest, which
   is solved alike until no node is cut; pieces then take on what was found for
   the node they hang below. Input of every size goes the same way.

A round is one lookup, parted where many nodes point at one, and a checkpoint;
nodes that rest aren't moved again. Depths alone take linear time and space;
paths and ancestors are as long as asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.session import cut, lookup_join, may_broadcast, shipped, stored

#: Nodes of a piece, about, and children from which a node is cut for sure.
EVERY = 100_000
CYCLE = "cycle"
SEPARATOR = " / "


def linked(nodes: DataFrame) -> DataFrame:
    """tree, scope, id, name, parent (name) to the same with node and up (keys) and parent_id.

    Names and parents must be plain already. A parent that is null or names no
    node of the tree and scope gives a null ``up``. Of several nodes with one
    name the one with the smallest id is the parent. A parent that many name is
    parted.
    """
    keyed = nodes.withColumn("node", F.concat_ws("\u0001", "tree", F.coalesce("scope", F.lit("\u0002")), "id")).withColumn("s", F.coalesce("scope", F.lit("\u0002")))
    known = keyed.filter("name is not null").groupBy("tree", "s", F.col("name").alias("parent")).agg(F.min(F.struct("id", "node")).alias("p"))
    # the names are no more than the nodes, which are cheaper to measure
    fits = may_broadcast(keyed.select("tree", "s", "name", "id", "node")) or None
    found = lookup_join(keyed, known, ["tree", "s", "parent"], "left", salt_by="id", fits=fits)
    return found.select("tree", "scope", "id", "name", F.col("p.id").alias("parent_id"), F.col("p.node").alias("up"), "node")


class _Piece:
    """Nodes of whole pieces, their children and the results of the search."""

    def __init__(self, batch: pd.DataFrame, paths: bool) -> None:
        self.nodes, self.low, self.step = batch["node"].tolist(), batch["low"].tolist(), batch["step"].tolist()
        at = {n: i for i, n in enumerate(self.nodes)}
        self.up = [-1 if n == top else at.get(u, -1) for n, u, top in zip(self.nodes, batch["up"], batch["piece"])]
        self.below: list[list[int]] = [[] for _ in self.nodes]
        for i, u in enumerate(self.up):
            if u >= 0:
                self.below[u].append(i)
        self.seen = [False] * len(self.nodes)
        self.walking = [False] * len(self.nodes)
        self.depth = self.step.copy()
        self.closed: list[str] = []
        self.labels = {c: [list(x) for x in batch[c]] for c in ("trail", "above")} if paths else {}

    def search(self, start: int) -> None:
        stack = [(start, 0)]
        self.seen[start] = self.walking[start] = True
        while stack:
            i, k = stack.pop()
            if k == len(self.below[i]):
                self.walking[i] = False
                continue
            stack.append((i, k + 1))
            child = self.below[i][k]
            if self.walking[child]:
                self.closed.append(self.low[child])  # its edge to i leads back
            elif not self.seen[child]:
                self.seen[child] = self.walking[child] = True
                self.depth[child] = self.depth[i] + self.step[child]
                self.low[child] = min(self.low[i], self.low[child])
                for label in self.labels.values():
                    label[child] = label[i] + label[child]
                stack.append((child, 0))


def _trees(batch: pd.DataFrame, paths: bool) -> pd.DataFrame:
    """Each node's way to the rest its piece hangs below: depth, the smallest node on it and, where wanted, names and ids."""
    p = _Piece(batch, paths)
    for i, u in enumerate(p.up):
        if u < 0:
            p.search(i)
    return pd.DataFrame({"node": p.nodes, "at": batch["at"].tolist(), "hit": batch["hit"].tolist(), "depth": p.depth, "low": p.low, **p.labels})


def _loops(batch: pd.DataFrame, paths: bool) -> pd.DataFrame:
    """The node that closes each loop: the smallest on it, from which the search starts. What only leads to another piece is passed over."""
    p = _Piece(batch.assign(piece=None), False)
    for i, u in enumerate(p.up):
        if u < 0:
            p.search(i)
    for i in range(len(p.nodes)):
        if not p.seen[i]:
            met: set[int] = set()
            j = i
            while j not in met:
                met.add(j)
                j = p.up[j]
            loop, k = [j], p.up[j]
            while k != j:
                loop.append(k)
                k = p.up[k]
            p.search(min(loop, key=p.low.__getitem__))
    return pd.DataFrame({"node": p.closed})


def _by_piece(walk: Callable[[pd.DataFrame, bool], pd.DataFrame], paths: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The rows of a partition come sorted by piece; the last of a batch may go on in the next."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            last = pdf["piece"].iloc[-1]
            if held and held[0]["piece"].iloc[0] == last:
                held.append(pdf)
                continue
            going_on = pdf["piece"] == last
            whole = pd.concat([*held, pdf[~going_on]], ignore_index=True)
            if len(whole):
                yield walk(whole, paths)
            held = [pdf[going_on]]
        if held:
            yield walk(pd.concat(held, ignore_index=True), paths)

    return run


def _walked(rows: DataFrame, walk: Callable[[pd.DataFrame, bool], pd.DataFrame], paths: bool, schema: str) -> DataFrame:
    return rows.repartition("piece").sortWithinPartitions("piece").mapInPandas(_by_piece(walk, paths), schema)


def _caught(active: DataFrame, links: DataFrame, fits: bool) -> DataFrame:
    """The nodes that close the loops of ``active``, nodes that never come to rest.

    ``low`` is doubled to the smallest of all that a node reaches. Nodes of a loop share it, so that it co-locates them.
    """
    state = cut(links.join(active.select("node"), "node").select("node", F.col("up").alias("at"), "low", F.lit(True).alias("fell")))
    while not state.filter("fell").isEmpty():
        state = cut(_jumped(state, state.select("node", "at", F.col("low").alias("t_low")), fits, F.least("low", "t_low").alias("low"), (F.col("t_low") < F.col("low")).alias("fell")))
    rows = links.select("node", "up", "step", "low").join(state.select("node", F.col("low").alias("piece")), "node")
    return _walked(rows, _loops, False, "node string")


def _jumped(rows: DataFrame, pointers: DataFrame, fits: bool, *columns) -> DataFrame:
    """Each row's node with the pointer of the node it points at, and ``columns``."""
    to = pointers.withColumnRenamed("at", "next").withColumnRenamed("node", "at")
    return lookup_join(rows, to, ["at"], salt_by="node", fits=fits).select("node", F.col("next").alias("at"), *columns)


def _solved(links: DataFrame, paths: bool, loops: bool, every: int, level: int = 0) -> tuple[DataFrame, list[DataFrame]]:
    """Each node's root and depth, and, with ``loops``, the nodes that close loops.

    ``links``: node, up, step, low and, for paths, trail and above, of nodes that
    have a parent; an ``up`` that is no node is a root. Result: node, root (null
    where the way up leads into a loop), depth, and trail and above from the root.
    """
    labels = ["trail", "above"] if paths else []
    counts = links.groupBy(F.col("up").alias("node")).agg(F.count(F.lit(1)).alias("children"))
    chance = F.pmod(F.xxhash64(F.lit(level), "node"), F.lit(every))
    cutters = cut(counts.filter(chance < F.col("children")).select("node", F.lit(True).alias("hit")))
    fits = may_broadcast(links.select("node", "up", "low"))
    if not (no_cuts := cutters.isEmpty()):
        cutters = cut(lookup_join(links.select("node"), cutters, ["node"]))  # roots rest by themselves
        no_cuts = cutters.isEmpty()
    marks = links.select("node", "up", F.lit(False).alias("hit"))
    if not no_cuts:
        marks = cut(lookup_join(links.select("node", "up"), cutters, ["node"], "left", salt_by="up").select("node", "up", F.coalesce("hit", F.lit(False)).alias("hit")))
    # a pointer rests on a cut node, or on a root, which is no node of the links
    known = marks.select(F.col("node").alias("at"), (~F.col("hit")).alias("goes_on"))
    state = lookup_join(marks.select("node", F.col("up").alias("at"), F.col("node").alias("piece")), known, ["at"], "left", salt_by="node", fits=fits)
    state = cut(state.select("node", "at", "piece", (~F.coalesce("goes_on", F.lit(False))).alias("rests")))
    rested, active = state.filter("rests"), state.filter("not rests")
    before, n = -1, active.count()
    while n and n != before:
        pointers = rested.unionByName(active).select("node", "at", F.col("piece").alias("t_piece"), F.col("rests").alias("t_rests"))
        state = cut(_jumped(active.select("node", "at"), pointers, fits, F.col("t_piece").alias("piece"), F.col("t_rests").alias("rests")))
        rested, active = rested.unionByName(state.filter("rests")), state.filter("not rests")
        before, n = n, active.count()
    closers = [_caught(active, links, fits)] if n and loops else []
    lost = [active.select("node")] if n else []

    rows = links.join(rested.select("node", "at", "piece"), "node")
    rows = rows.withColumn("hit", F.lit(False)) if no_cuts else rows.join(marks.select("node", "hit"), "node")
    schema = "node string, at string, hit boolean, depth long, low string" + ", trail array<string>, above array<string>" * paths
    local = _walked(rows.select("node", "up", "step", "low", "piece", "at", "hit", *labels), _trees, paths, schema)
    if no_cuts:
        solved = local.select("node", F.col("at").alias("root"), "depth", *labels)
    else:
        local = stored(local, "pieces")
        deeper = local.filter("hit").select("node", F.col("at").alias("up"), F.col("depth").alias("step"), "low", *labels)
        # the cut nodes that were caught are left out of ``deeper``, and what hangs below them is caught with them
        above, more = _solved(deeper, paths, loops, every, level + 1)
        missed = [x.join(cutters, "node", "left_semi") for x in lost]
        for x in missed:
            above = above.unionByName(x.select("node", F.lit(None).cast("string").alias("root"), F.lit(None).cast("long").alias("depth"), *(F.lit(None).cast("array<string>").alias(c) for c in labels)))
        above = cut(above.select(F.col("node").alias("at"), F.lit(True).alias("cut"), F.col("root"), F.col("depth").alias("rest_depth"), *(F.col(c).alias(f"rest_{c}") for c in labels)))
        joined = lookup_join(local, above, ["at"], "left", salt_by="node")
        root = F.when(F.col("cut"), F.col("root")).otherwise(F.col("at"))
        solved = joined.select("node", root.alias("root"), F.when(F.col("cut"), F.col("rest_depth") + F.col("depth")).otherwise(F.col("depth")).alias("depth"), *(F.when(F.col("cut"), F.concat(f"rest_{c}", c)).otherwise(F.col(c)).alias(c) for c in labels))
        closers += more
    for x in lost:
        solved = solved.unionByName(x.select("node", F.lit(None).cast("string").alias("root"), F.lit(None).cast("long").alias("depth"), *(F.lit(None).cast("array<string>").alias(c) for c in labels)))
    return solved, closers


def hierarchy(nodes: DataFrame, paths: bool = True, every: int = EVERY, loops: bool = True) -> DataFrame:
    """One row a node: tree, scope, id, name, parent_id, root_id, depth and, with ``loops``, closes_loop and, with ``paths``, path and ancestors.

    ``nodes``: tree, scope, id, name and parent, unique by tree, scope and id;
    names and parents plain, null for blank. Rows with a null id are left out.
    A node that is its own parent, lies on a loop or leads up into one has
    root_id ``cycle``, depth -1, a null path and null ancestors; ``closes_loop``
    marks the smallest node of each loop, whose edge to its parent closes it.
    ``ancestors`` holds ids from the root down to the parent. An empty table
    gives an empty one; other columns are ignored.
    """
    if every < 2:
        raise ValueError("every: two nodes a piece at least")
    shipped(nodes.sparkSession)
    edges = cut(linked(nodes.select("tree", "scope", "id", "name", "parent").filter("id is not null")))
    labels = [F.array(F.coalesce("name", F.lit(""))).alias("trail"), F.array("parent_id").alias("above")] if paths else []
    links = edges.filter("up is not null").select("node", "up", F.lit(1).cast("long").alias("step"), F.col("node").alias("low"), *labels)
    solved, closers = _solved(links, paths, loops, every)
    out = edges.join(solved, "node", "left").withColumn("closes", F.lit(False))
    if closers:
        ends = closers[0]
        for c in closers[1:]:
            ends = ends.unionByName(c)
        out = lookup_join(out.drop("closes"), cut(ends.withColumn("closes", F.lit(True))), ["node"], "left", salt_by="id")
    is_root, caught = F.col("up").isNull(), F.col("up").isNotNull() & F.col("root").isNull()
    # a root's key ends in its id, which follows the tree and the scope
    root_id = F.substring("root", F.length("tree") + F.length(F.coalesce("scope", F.lit("\u0002"))) + 3, F.length("root"))
    columns = [
        "tree", "scope", "id", "name", "parent_id",
        F.when(is_root, F.col("id")).when(caught, F.lit(CYCLE)).otherwise(root_id).alias("root_id"),
        F.when(is_root, F.lit(0)).when(caught, F.lit(-1)).otherwise(F.col("depth")).cast("long").alias("depth"),
    ]
    columns += [F.coalesce("closes", F.lit(False)).alias("closes_loop")] if loops else []
    if not paths:
        return out.select(*columns)
    tops = edges.filter("up is null").select(F.col("node").alias("root"), F.coalesce("name", F.lit("")).alias("top"))
    named = lookup_join(out, tops, ["root"], "left", salt_by="id")
    none = F.array().cast("array<string>")
    path = F.when(is_root, F.coalesce("name", F.lit(""))).when(~caught, F.concat_ws(SEPARATOR, F.array("top"), "trail"))
    return named.select(*columns, path.alias("path"), F.when(is_root, none).when(~caught, F.col("above")).alias("ancestors"))


def descendants(nodes: DataFrame, every: int = EVERY) -> DataFrame:
    """tree, scope, ancestor_id, descendant_id, distance: all pairs below each node, loops left out.

    The result has as many rows as the depths sum up to, which is what was asked for.
    """
    walked = hierarchy(nodes, True, every, loops=False).filter("depth > 0").select("tree", "scope", F.col("id").alias("descendant_id"), "depth", F.posexplode("ancestors").alias("at", "ancestor_id"))
    return walked.select("tree", "scope", "ancestor_id", "descendant_id", (F.col("depth") - F.col("at")).alias("distance"))
