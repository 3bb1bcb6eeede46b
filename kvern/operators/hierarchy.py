"""Parent-child links of unknown depth to full hierarchies, by leaf peeling.

Upwards: nodes without children are peeled off, level by level, and take their
subtrees' sizes and descendant lists to their parents.  Messages to one parent are
added up before the shuffle, so a parent with very many children is no hot spot.
Nodes that are never peeled lie on a circle: every node has at most one parent, so
nothing but the circle itself can stay behind.

``LEVELS`` peel levels make one batch, one written table, and only what is left goes on to
the next batch.  As most nodes of a tree are near its leaves, what is left soon is
small; once it is below ``TAIL_BYTES`` it is finished in one task, and beyond that in
further batches.

Downwards, in reverse peel order: a node takes root, depth and path of its parent
and adds itself.  Inside a batch these are joined by doubling, then the batch is
joined once to what was peeled after it.

Descendant lists are rows, not arrays, as one node may be above a third of all
nodes.  Inside a batch a node's rows are sent on to its parent level by level; what
arrives at a node above the batch is passed to all nodes above that one by a single join.
Joins on a parent are on an equal key, with at most one row per node on the other side, so
that a skewed partition can be split (adaptive skew join) without anything but that row repeated.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvern.session import Stage

LEVELS = 4  # peel levels per batch; a power of two, so that log2 doublings join a batch
TAIL_BYTES = 8 << 20  # what is left of a hierarchy is finished in one task up to this size
NODE_BYTES = 64  # a node's row, its parent's number and its size


def bare_number(column: Column) -> Column:
    """A number without blanks of any kind; null where nothing is left."""
    return F.nullif(F.regexp_replace(column, r"[\s\x{A0}\x{2007}\x{202F}\x{FEFF}]+", ""), F.lit(""))


def current_links(rows: DataFrame, child: str, parent: str, order: str) -> DataFrame:
    """``(node, parent)``, one row per node that is named as child or as parent.

    Of several rows for a child the one with the latest ``order`` holds; among
    equal ones a row with a parent before one without, then the greatest parent.
    Rows without a child number only name their parent.
    """
    clean = rows.select(
        bare_number(F.col(child)).alias("node"), bare_number(F.col(parent)).alias("parent"), F.col(order).alias("at")
    )
    # one pass: a child row carries (at, parent), a mention as parent carries nothing
    mentions = clean.select(
        F.explode(
            F.array(
                F.struct(F.col("node"), F.struct("at", "parent").alias("link")),
                F.struct(F.col("parent").alias("node"), F.lit(None).cast(_link(clean)).alias("link")),
            )
        ).alias("m")
    ).select("m.*")
    return (
        mentions.where("node IS NOT NULL")
        .groupBy("node")
        .agg(F.max("link").alias("link"))
        .select("node", F.col("link.parent").alias("parent"))
    )


def _link(clean: DataFrame) -> str:
    kinds = dict(clean.dtypes)
    return f"struct<at:{kinds['at']},parent:{kinds['parent']}>"


def _state(links: DataFrame) -> DataFrame:
    """``(node, parent, pending, size, level)``: every node with its number of children; ``level`` null means not peeled."""
    own = F.struct("node", "parent", F.lit(0).cast("bigint").alias("pending"), F.lit(1).cast("bigint").alias("size"))
    child = F.struct(F.col("parent").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(1).cast("bigint").alias("pending"), F.lit(0).cast("bigint").alias("size"))
    rows = links.select(F.explode(F.when(F.col("parent").isNotNull(), F.array(own, child)).otherwise(F.array(own))).alias("r"))
    added = [F.max("parent").alias("parent"), F.sum("pending").alias("pending"), F.sum("size").alias("size")]
    return rows.select("r.*").groupBy("node").agg(*added).withColumn("level", F.lit(None).cast("int"))


def _peel_once(state: DataFrame, level: int) -> DataFrame:
    """One level: every unpeeled node without pending children is peeled and tells its parent its size.

    The node's row and its message are exploded from one row, so the plan stays a
    chain and the state is computed once.
    """
    leaf = F.col("level").isNull() & (F.col("pending") == 0)
    own = F.struct("node", "parent", "pending", "size", F.when(leaf, F.lit(level)).otherwise(F.col("level")).alias("level"))
    tell = F.struct(F.col("parent").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(-1).cast("bigint").alias("pending"), "size", F.lit(None).cast("int").alias("level"))
    rows = state.select(F.explode(F.when(leaf & F.col("parent").isNotNull(), F.array(own, tell)).otherwise(F.array(own))).alias("r"))
    added = [F.max("parent").alias("parent"), F.sum("pending").alias("pending"), F.sum("size").alias("size"), F.max("level").alias("level")]
    return rows.select("r.*").groupBy("node").agg(*added)


_DONE = "node string, parent string, root string, depth bigint, status string, path array<string>, subtree_size bigint, level int"


def _finish(paths: bool) -> Callable[[pa.Table], pa.Table]:
    """Peels what is left in one go, and resolves it in reverse order."""

    def finish(group: pa.Table) -> pa.Table:
        node, parent, size = (group[c].to_pylist() for c in ("node", "parent", "size"))
        at = {n: i for i, n in enumerate(node)}
        up = [at.get(p, -1) for p in parent]
        pending = [0] * len(node)
        for p in up:
            if p >= 0:
                pending[p] += 1
        front, order, level = [i for i, n in enumerate(pending) if not n], [], [None] * len(node)
        step = 0
        while front:
            above = []
            for i in front:
                level[i] = step
                if up[i] >= 0:
                    size[up[i]] += size[i]
                    pending[up[i]] -= 1
                    if not pending[up[i]]:
                        above.append(up[i])
            order += front
            front, step = above, step + 1
        out = {i: ("", -1, "cycle", []) for i in range(len(node)) if level[i] is None}
        for i in reversed(order):
            root, depth, status, path = out[up[i]] if up[i] >= 0 else (node[i], -1, "tree", [])
            if status == "tree":
                out[i] = (root, depth + 1, status, [*path, node[i]] if paths else [])
            else:
                out[i] = ("", -1, "below_cycle", [])
        rows = [out[i] for i in range(len(node))]
        known = [None if level[i] is None else size[i] for i in range(len(node))]
        columns = [node, parent, [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows], known, level]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.int32()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in _DONE.split(", ")])

    return finish


class Hierarchy:
    """The batches of one peeling, and what was resolved of them: see ``nodes`` and ``pairs``."""

    def __init__(self, rows: DataFrame, child: str, parent: str, order: str, paths: bool = False):
        self.stage = Stage(rows.sparkSession, "hierarchy")
        self.paths = paths
        stage, self.batches = self.stage, []
        state = _state(current_links(rows, child, parent, order))
        low = 0
        while True:
            for level in range(low, low + LEVELS):
                state = _peel_once(state, level)
            self.batches.append(f"batch{len(self.batches)}")
            written = stage.write(state, self.batches[-1])
            last, left = written.agg(F.max("level"), F.count_if(F.col("level").isNull())).first()
            state = written.where("level IS NULL")
            low += LEVELS
            stuck = last is None or last < low - 1
            if stuck or left * NODE_BYTES <= TAIL_BYTES:
                break
        self.like = written
        if stuck and left * NODE_BYTES > TAIL_BYTES:  # circles alone are left
            rest = state.select("node", "parent", F.lit("").alias("root"), F.lit(-1).cast("bigint").alias("depth"), F.lit("cycle").alias("status"), _no_path().alias("path"), F.lit(None).cast("bigint").alias("subtree_size"), "level")
        else:
            rest = state.select("node", "parent", "size", F.lit(0).alias("one")).groupBy("one").applyInArrow(_finish(paths), _DONE)
        self.done = ["rest"]
        self.resolved = stage.write(rest, "rest")
        for batch in reversed(self.batches):
            stage.write(self._resolve(self._peeled(batch), self.nodes()), f"{batch}-done")
            self.done.append(f"{batch}-done")

    def _peeled(self, batch: str) -> DataFrame:
        return self.stage.read([batch], self.like).where("level IS NOT NULL")

    def nodes(self) -> DataFrame:
        return self.stage.read(self.done, self.resolved)

    def _resolve(self, peeled: DataFrame, above: DataFrame) -> DataFrame:
        """One batch: doubling inside it, then one join to what was peeled later."""
        own = F.array("node") if self.paths else _no_path()
        chain = peeled.select("node", "parent", "size", "level", F.col("parent").alias("top"), F.lit(0).cast("bigint").alias("steps"), F.col("node").alias("head"), own.alias("path"))
        reach = 1
        while reach < LEVELS:
            # the lowest level of a batch is nobody's parent in it
            inner = chain.where(F.col("level") % LEVELS > 0)
            up = inner.select(F.col("node").alias("top"), F.col("top").alias("next"), F.col("steps").alias("more"), F.col("head").alias("high"), F.col("path").alias("front"))
            hit = F.col("high").isNotNull()
            chain = chain.join(up, "top", "left").select(
                "node", "parent", "size", "level", F.when(hit, F.col("next")).otherwise(F.col("top")).alias("top"),
                F.when(hit, F.col("steps") + F.col("more") + 1).otherwise(F.col("steps")).alias("steps"), F.coalesce("high", "head").alias("head"),
                F.when(hit, F.concat("front", "path")).otherwise(F.col("path")).alias("path"),
            )
            reach *= 2
        over = above.select(F.col("node").alias("top"), F.col("root").alias("up_root"), F.col("depth").alias("up_depth"), F.col("status").alias("up_status"), F.col("path").alias("front"))
        tree = F.col("up_status").isNull() | (F.col("up_status") == "tree")
        return chain.join(over, "top", "left").select(
            "node", "parent", F.when(tree, F.coalesce("up_root", "head")).otherwise("").alias("root"),
            F.when(tree, F.col("steps") + F.coalesce(F.col("up_depth") + 1, F.lit(0))).otherwise(-1).alias("depth"), F.when(tree, "tree").otherwise("below_cycle").alias("status"),
            F.when(tree, F.concat(F.coalesce("front", _no_path()), "path")).otherwise(_no_path()).alias("path"), F.col("size").alias("subtree_size"), "level",
        )

    def pairs(self) -> DataFrame:
        """``(ancestor, descendant, distance)``: every node's descendants, a row for each.

        A node below a circle has the nodes between it and the circle above it and all
        nodes of the circle, a node on a circle all others of it; a node is no row with itself.
        """
        stage = self.stage
        rest = self.stage.read(["rest"], self.resolved)
        tables = []

        def keep(df: DataFrame, name: str) -> DataFrame:
            tables.append(name)
            return stage.write(df, name)

        like = keep(_lists(rest.where("level IS NOT NULL"), rest.agg(F.coalesce(F.max("level"), F.lit(0)) + 1).first()[0], stage, "rest-lists"), "rest-pairs")
        circle = keep(_circle_pairs(rest), "circle-pairs")
        # lists that arrive at a circle go all around it
        around = like.withColumnRenamed("ancestor", "via").join(circle.select(F.col("descendant").alias("via"), "ancestor", F.col("distance").alias("more")), "via")
        keep(around.select("ancestor", "descendant", (F.col("distance") + F.col("more")).alias("distance")), "around-pairs")
        for batch in reversed(self.batches):
            inside = stage.write(_lists(self._peeled(batch), LEVELS, stage, f"{batch}-lists"), f"{batch}-inside")
            upper = stage.read(tables, like).select(F.col("descendant").alias("via"), "ancestor", F.col("distance").alias("more"))
            onward = inside.withColumnRenamed("ancestor", "via").join(upper, "via").select("ancestor", "descendant", (F.col("distance") + F.col("more")).alias("distance"))
            tables.append(f"{batch}-inside")
            keep(onward, f"{batch}-onward")
        return stage.read(tables, like)


def _no_path() -> Column:
    return F.array().cast("array<string>")


def _lists(peeled: DataFrame, levels: int, stage: Stage, name: str) -> DataFrame:
    """``(ancestor, descendant, distance)`` of a batch: its nodes' lists, sent up level by level, down to the first node above the batch.

    A node's list is whole when it is peeled, as its children's have arrived then; it
    goes to its parent with the node itself.  Lists of up to ``LEVELS`` levels are one plan.
    """
    links = peeled.where("parent IS NOT NULL").select("node", "parent", "level")
    sent = links.select(F.col("parent").alias("ancestor"), F.col("node").alias("descendant"), F.lit(1).cast("bigint").alias("distance"))
    every, step = sent, 1
    arrived, tables = sent, []
    while step < levels:
        up = links.select(F.col("node").alias("via"), F.col("parent").alias("ancestor"))
        arrived = arrived.withColumnRenamed("ancestor", "via").join(up, "via").select("ancestor", "descendant", (F.col("distance") + 1).alias("distance"))
        if step % LEVELS == 0:
            tables.append(f"{name}{step}")
            arrived = stage.write(arrived, tables[-1])
            if arrived.isEmpty():
                break
        every = every.unionByName(arrived)
        step += 1
    return every


def _circle_pairs(hierarchy: DataFrame) -> DataFrame:
    """``(ancestor, descendant, distance)`` of the nodes of each circle, by doubling.  Runs jobs: a round per doubling of the longest circle."""
    stage = Stage(hierarchy.sparkSession, "circles")
    steps = stage.write(hierarchy.where("status = 'cycle'").select(F.col("parent").alias("ancestor"), F.col("node").alias("descendant"), F.lit(1).cast("bigint").alias("distance")), "steps")
    pairs, known, reach = steps.where("ancestor <> descendant"), -1, 1
    while True:
        pairs = stage.write(pairs, f"pairs{reach}")
        count = pairs.count()
        if count == known:
            return pairs
        known = count
        # steps lead ``reach`` up from every node, pairs at most as far
        up = steps.select(F.col("descendant").alias("via"), F.col("ancestor"), F.col("distance").alias("more"))
        further = pairs.withColumnRenamed("ancestor", "via").join(up, "via").select("ancestor", "descendant", (F.col("distance") + F.col("more")).alias("distance"))
        jumps = steps.withColumnRenamed("ancestor", "via").join(up, "via").select("ancestor", "descendant", (F.col("distance") + F.col("more")).alias("distance"))
        pairs = pairs.unionByName(further).where("ancestor <> descendant").groupBy("ancestor", "descendant").agg(F.min("distance").alias("distance"))
        reach *= 2
        steps = stage.write(jumps, f"steps{reach}")


def build_hierarchy(rows: DataFrame, child: str, parent: str, order: str, paths: bool = True) -> DataFrame:
    """``(node, parent, root, depth, status, path, subtree_size, level)``, one row per node.

    ``status``: ``tree``; ``cycle`` for a node that is its own ancestor;
    ``below_cycle`` for one with an ancestor on a circle.  ``path`` runs from the
    root to the node; without ``paths`` it is empty.  For the latter two statuses root
    is ``''``, depth -1, the path empty and, on a circle, the subtree size null.  An empty
    table gives no rows; nulls, blanks and repeated rows are treated as ``current_links`` says;
    other columns are not read.  Runs jobs: peeling needs to know when it is done.
    """
    made = Hierarchy(rows, child, parent, order, paths)
    for batch in made.batches:
        made.stage.drop(batch)
    return made.nodes()


def descendants(rows: DataFrame, child: str, parent: str, order: str) -> DataFrame:
    """``(ancestor, descendant, distance)`` of the same links, with the nodes on and below circles: see ``Hierarchy.pairs``."""
    return Hierarchy(rows, child, parent, order).pairs()
