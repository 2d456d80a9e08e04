"""The time-revisioned graph of blocks: as-of views, closures, paths, components, ordered inserts.

edges: line_id, parent, child, kind; edge_revisions: line_id, parent, child, known_at, retired_at;
node_memberships: node_id, known_at, retired_at; node_states: node_id, state_id, knowledge_at, created_at, readable, ...
A revision holds at t if known_at <= t and it isn't retired by t.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.stage import materialize

#: Rounds of a traversal after which its state is written to the shared folder.
CUT_EVERY = 4


def holds_at(at: Column) -> Column:
    return (F.col("known_at") <= at) & (F.col("retired_at").isNull() | (F.col("retired_at") > at))


def edges_at(revisions: DataFrame, at: Column) -> DataFrame:
    """(line_id, parent, child) that hold at a literal cutoff."""
    return revisions.where(holds_at(at)).select("line_id", "parent", "child").distinct()


def edges_at_each(revisions: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """(question_id, line_id, parent, child) as of each question's own cutoff; cutoffs: question_id, line_id, at."""
    return revisions.join(cutoffs, "line_id").where(holds_at(F.col("at"))).select("question_id", "line_id", "parent", "child").distinct()


def related(revisions: DataFrame, edges: DataFrame, at: Column, kind: str | None = None) -> DataFrame:
    """Edges at a cutoff, of one kind or any."""
    own = edges if kind is None else edges.where(F.col("kind") == kind)
    return edges_at(revisions, at).join(own.select("line_id", "parent", "child", "kind"), ["line_id", "parent", "child"])


def state_at(states: DataFrame, at: Column) -> DataFrame:
    """Each node's newest readable state known by the cutoff; a correction wins."""
    w = Window.partitionBy("node_id").orderBy(F.desc("knowledge_at"), F.desc("created_at"), F.desc("state_id"))
    return states.where((F.col("knowledge_at") <= at) & F.col("readable")).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def visible_nodes(nodes: DataFrame, memberships: DataFrame, states: DataFrame, at: Column) -> DataFrame:
    """Nodes with a membership at the cutoff and a readable state; lost evidence greys a node and never hides it."""
    member = memberships.where(holds_at(at)).select("node_id").distinct()
    return nodes.join(member, "node_id", "left_semi").join(state_at(states, at).select("node_id"), "node_id", "left_semi")


def frontier(visible: DataFrame, edges: DataFrame) -> DataFrame:
    """Visible nodes (line_id, node_id) without a visible child."""
    ids = visible.select("node_id")
    inner = edges.join(ids.withColumnRenamed("node_id", "parent"), "parent", "left_semi").join(ids.withColumnRenamed("node_id", "child"), "child", "left_semi")
    return visible.join(inner.select(F.col("parent").alias("node_id")).distinct(), "node_id", "left_anti")


def closure(starts: DataFrame, steps: DataFrame, most: int | None = None) -> DataFrame:
    """(start, node, depth): what steps (src, dst) reach from starts (start), breadth first, at the least depth; the start itself isn't in it.

    most: the depth to stop at; None: until nothing new is reached. Each round joins what the last one found.
    """
    seen = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")).distinct()
    edge = steps.select("src", "dst").distinct()
    last, depth = seen, 0
    while most is None or depth < most:
        depth += 1
        new = last.join(edge, last["node"] == edge["src"]).select("start", F.col("dst").alias("node")).distinct()
        new = new.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(depth))
        if most is None or depth % CUT_EVERY == 0:
            new = materialize(new, "frontier")
            if not new.limit(1).count():
                break
        seen, last = seen.unionByName(new), new
        if depth % CUT_EVERY == 0:
            seen = materialize(seen, "seen")
    return seen.where("depth > 0")


def ancestors(starts: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    return closure(starts, edges.select(F.col("child").alias("src"), F.col("parent").alias("dst")), most)


def descendants(starts: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    return closure(starts, edges.select(F.col("parent").alias("src"), F.col("child").alias("dst")), most)


def near(anchors: DataFrame, edges: DataFrame, reach: int) -> DataFrame:
    """(question_id, node) at most `reach` edges from an anchor (question_id, node), up or down, anchors left out."""
    up = edges.select(F.col("child").alias("src"), F.col("parent").alias("dst"))
    both = up.union(edges.select(F.col("parent").alias("src"), F.col("child").alias("dst"))).distinct()
    seen = last = materialize(anchors.select("question_id", "node").distinct(), "anchors")
    start = seen
    for _ in range(reach):
        new = last.join(both, last["node"] == both["src"]).select("question_id", F.col("dst").alias("node")).distinct()
        last = materialize(new.join(seen, ["question_id", "node"], "left_anti"), "near")  # else every round repeats all before it
        seen = seen.unionByName(last)
    return seen.join(start, ["question_id", "node"], "left_anti")


def between(hits: DataFrame, edges: DataFrame, gap: int) -> DataFrame:
    """(question_id, node): steps on an upward path between two hits (question_id, node) with at most `gap` steps between them."""
    up = edges.select(F.col("child").alias("src"), F.col("parent").alias("dst")).distinct()
    own = hits.select("question_id", "node").distinct()
    marked = own.select("question_id", F.col("node").alias("dst"), F.lit(True).alias("is_hit"))
    path = own.select("question_id", F.col("node").alias("at"), F.expr("CAST(array() AS array<string>)").alias("path"))
    found = None
    for _ in range(gap + 1):
        step = path.join(up, path["at"] == up["src"]).select("question_id", "dst", "path").join(marked, ["question_id", "dst"], "left")
        done = step.where("is_hit").select("question_id", F.explode("path").alias("node"))
        found = done if found is None else found.unionByName(done)
        path = step.where("is_hit IS NULL").where(~F.array_contains("path", F.col("dst"))).select("question_id", F.col("dst").alias("at"), F.concat("path", F.array(F.col("dst").cast("string"))).alias("path"))
    return found.distinct()


def components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(question_id, node, piece): components of the edges among each question's nodes (question_id, node); piece: the smallest node.

    Labels spread to neighbours and jump to their label's label, so rounds grow with the logarithm of a piece's length, about.
    """
    own = nodes.select("question_id", "node").distinct()
    a = own.withColumnRenamed("node", "child")
    inner = edges.select("parent", "child").distinct().join(a, "child").join(own.select("question_id", F.col("node").alias("parent")), ["question_id", "parent"])
    both = materialize(inner.select("question_id", F.col("parent").alias("x"), F.col("child").alias("y")).union(inner.select("question_id", F.col("child").alias("x"), F.col("parent").alias("y"))).distinct(), "inner")
    label = own.withColumn("piece", F.col("node"))
    for _ in range(most_rounds):
        seen = both.join(label.withColumnRenamed("node", "y"), ["question_id", "y"]).groupBy("question_id", F.col("x").alias("node")).agg(F.min("piece").alias("low"))
        new = label.join(seen, ["question_id", "node"], "left").withColumn("low", F.least("piece", F.coalesce("low", "piece")))
        jump = label.select("question_id", F.col("node").alias("low"), F.col("piece").alias("far"))
        new = materialize(new.join(jump, ["question_id", "low"], "left").select("question_id", "node", F.least("low", F.coalesce("far", "low")).alias("next"), "piece"), "labels")
        label = new.select("question_id", "node", F.col("next").alias("piece"))
        if not new.where("next <> piece").limit(1).count():
            return label
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def paths_to_frontier(visible: DataFrame, edges: DataFrame, max_paths: int = 128, max_nodes: int = 256) -> DataFrame:
    """(line_id, path): every path from a root to a frontier node among visible nodes (line_id, node_id). Bounds raise, nothing is cut off."""
    ids = visible.select("node_id")
    inner = edges.join(ids.withColumnRenamed("node_id", "parent"), "parent", "left_semi").join(ids.withColumnRenamed("node_id", "child"), "child", "left_semi").select("parent", "child").distinct()
    ends = frontier(visible, edges)
    path = ends.select("line_id", F.col("node_id").alias("head"), F.array("node_id").alias("path"))
    done = None
    for _ in range(max_nodes):
        step = path.join(inner, path["head"] == inner["child"], "left")
        roots = step.where("parent IS NULL").select("line_id", "path")
        done = roots if done is None else done.unionByName(roots)
        longer = step.where("parent IS NOT NULL")
        if longer.where(F.array_contains("path", F.col("parent"))).limit(1).count():
            raise ValueError("cycle in a line")
        path = materialize(longer.select("line_id", F.col("parent").alias("head"), F.concat(F.array("parent"), "path").alias("path")), "paths")
        if not path.limit(1).count():
            break
    else:
        raise ValueError(f"a path is longer than {max_nodes} nodes")
    done = done.distinct()
    if done.groupBy("line_id").count().where(F.col("count") > max_paths).limit(1).count():
        raise ValueError(f"more than {max_paths} paths")
    return done


def raw_closure(targets: DataFrame, edges: DataFrame, memberships: DataFrame, states: DataFrame, at: Column, max_nodes: int = 100_000) -> DataFrame:
    """(start, source_keys, complete): sources of a node and its ancestry at the cutoff, and whether all their evidence is there.

    A node without a membership at the cutoff, or without a readable state, adds nothing and leads no further. Too many nodes raise.
    """
    member = memberships.where(holds_at(at)).select("node_id").distinct()
    live = state_at(states, at).join(member, "node_id", "left_semi").select("node_id", "source_keys", "evidence_complete")
    through = edges.join(live.select(F.col("node_id").alias("child")), "child", "left_semi")
    reached = ancestors(targets, through).select("start", "node").unionByName(targets.select("start", F.col("start").alias("node")))
    if reached.groupBy("start").count().where(F.col("count") > max_nodes).limit(1).count():
        raise ValueError(f"a closure has more than {max_nodes} nodes")
    joined = reached.join(live, reached["node"] == live["node_id"])
    return joined.groupBy("start").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_keys")))).alias("source_keys"), F.bool_and("evidence_complete").alias("complete"))


def retire(revisions: DataFrame, retired: DataFrame, keys: list[str]) -> DataFrame:
    """revisions with retired_at set from each retired (keys, at) forward, where it isn't earlier already."""
    cut = retired.groupBy(*keys).agg(F.min("at").alias("__at"))
    earlier = F.col("__at").isNotNull() & (F.col("retired_at").isNull() | (F.col("retired_at") > F.col("__at")))
    return revisions.join(cut, keys, "left").withColumn("retired_at", F.when(earlier, F.col("__at")).otherwise(F.col("retired_at"))).drop("__at")


def boundaries(revisions: DataFrame, start: Column) -> DataFrame:
    """(line_id, at): the times from `start` on at which a line's edges change, `start` included."""
    times = revisions.select("line_id", F.explode(F.array("known_at", "retired_at")).alias("at")).where(F.col("at") >= start)
    return times.unionByName(revisions.select("line_id", start.alias("at"))).distinct()


class _Line:
    """One line while edges are inserted: revisions by (parent, child)."""

    def __init__(self) -> None:
        self.revisions: dict[tuple, list[tuple]] = defaultdict(list)
        self.below: dict[object, list] = defaultdict(list)  # a node's children at any time
        self.times: list = []  # when anything changes, in order

    def children(self, node, at) -> list:
        return [c for c in self.below[node] if any(k <= at and (r is None or r > at) for k, r in self.revisions[node, c])]

    def _note(self, at) -> None:
        i = bisect_left(self.times, at)
        if i == len(self.times) or self.times[i] != at:
            self.times.insert(i, at)

    def reaches(self, start, target, at) -> bool:
        todo, seen = {start}, set()
        while todo:
            node = todo.pop()
            if node == target:
                return True
            seen.add(node)
            todo |= set(self.children(node, at)) - seen
        return False

    def insert(self, parent, child, at) -> str:
        if parent == child:
            return "self"
        if self.reaches(parent, child, at):
            return "implied"  # an edge, or a shortcut past other edges
        if any(self.reaches(child, parent, t) for t in [at, *self.times[bisect_left(self.times, at) :]]):
            return "cycle"
        if (parent, child) not in self.revisions:
            self.below[parent].append(child)
        self.revisions[parent, child].append((at, None))
        self._note(at)
        return "added"

    def retire(self, parent, child, at) -> str:
        spans = self.revisions.get((parent, child), [])
        if not spans:
            return "unknown"
        self._note(at)
        self.revisions[parent, child] = [(k, at if r is None or r > at else r) for k, r in spans]
        return "retired"


def insert_edges(events: DataFrame) -> DataFrame:
    """events (line_id, ord, action, parent, child, kind, at) with `outcome`, in each line's order.

    Actions: add, retire. An added edge may be refused: self, implied (already an ancestor), cycle (at any later change of the
    line), other_line (an end is known in another line). Later decisions hang on earlier ones, so a line is folded in one group.
    """
    homes = events.select(F.explode(F.array("parent", "child")).alias("node"), "line_id", "ord").groupBy("node").agg(F.min_by("line_id", F.struct("ord", "line_id")).alias("home"))
    e = events.join(homes.select(F.col("node").alias("parent"), F.col("home").alias("ph")), "parent", "left").join(homes.select(F.col("node").alias("child"), F.col("home").alias("ch")), "child", "left")
    e = e.withColumn("foreign", (F.col("ph") != F.col("line_id")) | (F.col("ch") != F.col("line_id"))).select("line_id", "ord", "action", "parent", "child", "kind", "at", "foreign")
    kinds = [(c, e.schema[c].dataType.simpleString()) for c in ("line_id", "ord", "action", "parent", "child", "kind", "at")]

    def fold(f: pd.DataFrame) -> pd.DataFrame:
        line, out = _Line(), []
        f = f.sort_values("ord")
        for r in f.itertuples(index=False):
            if r.action == "retire":
                out.append(line.retire(r.parent, r.child, r.at))
            else:
                out.append("other_line" if r.foreign and r.parent != r.child else line.insert(r.parent, r.child, r.at))
        return f.drop(columns="foreign").assign(outcome=out)

    return e.groupBy("line_id").applyInPandas(fold, ", ".join(f"{c} {k}" for c, k in kinds) + ", outcome string")


def tree_report(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(line_id, place, depth, node, text): each line's nodes as an indented outline, a child under its smallest parent.

    Levels are followed to the deepest; nodes of a cycle hang under no root and aren't shown.
    """
    one = edges.groupBy("line_id", "child").agg(F.min("parent").alias("parent"))
    roots = labels.join(one.select(F.col("child").alias("node")), "node", "left_anti").select("line_id", "node", F.array("node").alias("path"))
    all_paths, last = roots, roots
    while True:  # every child has one parent, so a node is reached once and the levels end
        last = last.join(one.select(F.col("child").alias("next"), F.col("parent").alias("node")), "node").select("line_id", F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path"))
        last = materialize(last, "outline")
        if not last.limit(1).count():
            break
        all_paths = all_paths.unionByName(last)
    place = F.row_number().over(Window.partitionBy("line_id").orderBy("path"))
    return all_paths.join(labels.select("node", "label"), "node").select("line_id", place.alias("place"), (F.size("path") - 1).alias("depth"), "node", F.concat(F.repeat(F.lit("  "), F.size("path") - 1), F.lit("- "), "label").alias("text"))
