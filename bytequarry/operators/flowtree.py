"""Trees over control flow and closures: spanning and dominator trees, intervals, loop nesting, block and emission order.

Trees are rows (prototype, node, parent), the parent null at a root. Orders come
from Euler tours ranked by pointer doubling, and nearest common ancestors by
lifting, so that rounds grow with the logarithm of a tree's depth; rounds are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import written_rows as written

ENTRY = 1


def heads(pointers: DataFrame) -> DataFrame:
    """(prototype, node, head) of pointers (prototype, node, to): where following them ends; nodes that only lead to a cycle are left out.

    Pointer doubling: a round doubles the steps, until no pointer leads to another or the steps exceed the nodes.
    """
    rows = written(pointers.select("prototype", "node", "to"), "pointers")
    most, steps = rows.groupBy("prototype").count().agg(F.max("count")).first()[0] or 0, 1
    while steps <= most:
        ahead = rows.select("prototype", F.col("node").alias("to"), F.col("to").alias("_next"))
        rows = written(rows.join(ahead, ["prototype", "to"], "left").select("prototype", "node", F.coalesce("_next", "to").alias("to"), F.col("_next").isNotNull().alias("_on")), "pointers")
        if not rows.where("_on").limit(1).count():
            break
        rows, steps = rows.drop("_on"), steps * 2
    inner = pointers.select("prototype", F.col("node").alias("to"))
    return rows.join(inner, ["prototype", "to"], "left_anti").select("prototype", "node", F.col("to").alias("head"))


def spanning_tree(edges: DataFrame, blocks: DataFrame, entry: int = ENTRY) -> DataFrame:
    """(prototype, node, parent) of the blocks that the entry reaches.

    Blocks with one predecessor hang below it; they are contracted by pointer
    doubling into the block where their chain begins. Waves go over what is left,
    blocks where ways meet, so a path of any length takes one.
    """
    edges = written(edges.select("prototype", "src", "dst").distinct(), "edges")
    into = edges.groupBy("prototype", F.col("dst").alias("node")).agg(F.count("*").alias("n"), F.min("src").alias("to"))
    single = written(into.where(f"n = 1 and node <> {entry} and to <> node").select("prototype", "node", "to"), "single")
    chain = written(heads(single), "chains")
    start = blocks.where(F.col("block_start") == entry).select("prototype", F.col("block_start").alias("node"), F.lit(None).cast("long").alias("parent"))
    meet = edges.withColumnRenamed("dst", "node").join(single, ["prototype", "node"], "left_anti").where(F.col("node") != entry)
    meet = meet.join(chain.select("prototype", F.col("node").alias("src"), "head"), ["prototype", "src"], "left")
    inner = single.select("prototype", F.col("node").alias("head"))
    meet = written(meet.withColumn("head", F.coalesce("head", "src")).join(inner, ["prototype", "head"], "left_anti"), "meet")
    seen = front = written(start, "wave")
    while True:
        step = front.select("prototype", F.col("node").alias("head")).join(meet, ["prototype", "head"]).groupBy("prototype", "node").agg(F.min("src").alias("parent"))
        front = written(step.join(seen, ["prototype", "node"], "left_anti"), "wave")
        if not front.limit(1).count():
            break
        seen = written(seen.union(front), "seen")
    below = single.join(chain, ["prototype", "node"]).join(seen.select("prototype", F.col("node").alias("head")), ["prototype", "head"], "left_semi")
    return seen.union(below.select("prototype", "node", F.col("to").alias("parent")))


def reachable(edges: DataFrame, blocks: DataFrame, entry: int = ENTRY) -> DataFrame:
    """(prototype, block_start) of blocks that the entry reaches."""
    return spanning_tree(edges, blocks, entry).select("prototype", F.col("node").alias("block_start"))


#: Levels of a forest up to which a node carries the way from its root; deeper forests are toured.
SHALLOW = 16


def _ways(tree: DataFrame) -> DataFrame | None:
    """The forest with way, the nodes from the root to each, by pointer doubling; None if some way is longer than ``SHALLOW``."""
    rows = tree.select("prototype", "node", F.col("parent").alias("to"), F.array("node").alias("way"))
    while rows.where("to is not null").limit(1).count():
        if rows.where(F.size("way") > SHALLOW // 2).limit(1).count():
            return None
        ahead = rows.select("prototype", F.col("node").alias("to"), F.col("to").alias("_to"), F.col("way").alias("_way"))
        rows = written(rows.join(ahead, ["prototype", "to"], "left").select("prototype", "node", F.col("_to").alias("to"), F.concat(F.coalesce("_way", F.array().cast("array<bigint>")), "way").alias("way")), "ways")
    return rows.select("prototype", "node", F.get("way", F.size("way") - 2).alias("parent"), "way")


def numbered(tree: DataFrame) -> DataFrame:
    """(prototype, node, parent, enter, leave, post): intervals of a forest; children and roots in order of their numbers.

    enter counts nodes in pre-order from 1, leave is the largest enter below the
    node, post counts in post-order. A node is below or at another if its enter lies
    in the other's interval. Euler tour: each node is entered and left; the tour's
    successor of every such event is known from first children and next siblings,
    and pointer doubling sums what follows each event. In a shallow forest the ways from
    the roots are in pre-order as they are, and in post-order with an end behind all nodes.
    """
    tree = written(tree.select("prototype", "node", "parent"), "tree")
    if (ways := _ways(tree)) is not None:
        of = Window.partitionBy("prototype")
        last = F.lit(2**63 - 1)
        rows = ways.select("*", F.row_number().over(of.orderBy("way")).cast("long").alias("enter"), F.row_number().over(of.orderBy(F.array_append("way", last))).cast("long").alias("post"))
        # Before a node's end lie all that begin before it but its ancestors, and all below it.
        return rows.select("prototype", "node", "parent", "enter", (F.col("post") + F.size("way") - 1).alias("leave"), "post")
    order = Window.partitionBy("prototype", "parent").orderBy("node")
    rows = tree.withColumn("_sibling", F.lead("node").over(order))
    first = tree.where("parent is not null").groupBy("prototype", F.col("parent").alias("node")).agg(F.min("node").alias("_child"))
    rows = rows.join(first, ["prototype", "node"], "left")
    enter = rows.select("prototype", (F.col("node") * 2).alias("at"), F.coalesce(F.col("_child") * 2, F.col("node") * 2 + 1).alias("to"), F.lit(1).cast("long").alias("ins"), F.lit(0).cast("long").alias("outs"))
    leave = rows.select("prototype", (F.col("node") * 2 + 1).alias("at"), F.coalesce(F.col("_sibling") * 2, F.col("parent") * 2 + 1).alias("to"), F.lit(0).cast("long").alias("ins"), F.lit(1).cast("long").alias("outs"))
    tour = written(enter.union(leave), "tour")
    while tour.where("to is not null").limit(1).count():
        ahead = tour.select("prototype", F.col("at").alias("to"), F.col("to").alias("_next"), F.col("ins").alias("_ins"), F.col("outs").alias("_outs"))
        plus = lambda c: (F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c)
        tour = written(tour.join(ahead, ["prototype", "to"], "left").select("prototype", "at", F.col("_next").alias("to"), plus("ins"), plus("outs")), "tour")
    size = tree.groupBy("prototype").agg(F.count("*").alias("_size"))
    sides = tour.join(size, "prototype").withColumn("node", F.floor(F.col("at") / 2)).groupBy("prototype", "node").agg(
        F.max(F.when(F.col("at") % 2 == 0, F.col("_size") - F.col("ins") + 1)).alias("enter"),
        F.max(F.when(F.col("at") % 2 == 1, F.col("_size") - F.col("ins"))).alias("leave"),
        F.max(F.when(F.col("at") % 2 == 1, F.col("_size") - F.col("outs") + 1)).alias("post"),
    )
    return tree.join(sides, ["prototype", "node"])


def _lifts(tree: DataFrame) -> list[DataFrame]:
    """(prototype, node, to, enter, leave) for 1, 2, 4.. steps up: the ancestor and its interval."""
    ends = tree.select("prototype", F.col("node").alias("to"), "enter", "leave")
    up = written(tree.where("parent is not null").select("prototype", "node", F.col("parent").alias("to")).join(ends, ["prototype", "to"]).select("prototype", "node", "to", "enter", "leave"), "lift")
    out = []
    while up.limit(1).count():
        out.append(up)
        twice = up.select("prototype", F.col("node").alias("_mid"), F.col("to").alias("_to"), F.col("enter").alias("_enter"), F.col("leave").alias("_leave"))
        up = up.withColumnRenamed("to", "_mid").join(twice, ["prototype", "_mid"]).select("prototype", "node", F.col("_to").alias("to"), F.col("_enter").alias("enter"), F.col("_leave").alias("leave"))
        up = written(up, "lift")
    return out


def _nearest_common(tree: DataFrame, groups: DataFrame) -> DataFrame:
    """(prototype, node, common) of groups (prototype, node, member): the nearest common ancestor of a node's members.

    It is that of the first and last member in the tour: climb from the first, by
    halves, as long as the interval doesn't hold the last.
    """
    place = tree.select("prototype", F.col("node").alias("member"), "enter", "leave")
    ends = groups.join(place, ["prototype", "member"]).groupBy("prototype", "node").agg(F.min(F.struct("enter", "member", "leave")).alias("lo"), F.max("enter").alias("last"))
    rows = written(ends.select("prototype", "node", "last", F.col("lo.member").alias("at"), (F.col("lo.leave") >= F.col("last")).alias("done")), "climb")
    lifts = _lifts(tree)
    for up in reversed(lifts):
        up = up.select("prototype", F.col("node").alias("at"), "to", "leave")
        step = rows.join(up, ["prototype", "at"], "left")
        # enter of an ancestor of the first member is never after it, so the interval holds the last member if it ends after that.
        below = ~F.col("done") & F.col("to").isNotNull() & (F.col("leave") < F.col("last"))
        rows = written(step.select("prototype", "node", "last", F.when(below, F.col("to")).otherwise(F.col("at")).alias("at"), "done"), "climb")
    if not lifts:
        return rows.select("prototype", "node", F.col("at").alias("common"))
    one = lifts[0].select("prototype", F.col("node").alias("at"), "to")
    return rows.join(one, ["prototype", "at"], "left").select("prototype", "node", F.when(F.col("done"), F.col("at")).otherwise(F.col("to")).alias("common"))


def dominator_tree(edges: DataFrame, blocks: DataFrame, entry: int = ENTRY) -> DataFrame:
    """(prototype, node, parent, enter, leave, post) of reached blocks; the parent is the immediate dominator.

    A block dominates those whose enter lies in its interval. From a spanning
    tree, blocks where ways meet rise to the nearest common ancestor of their
    predecessors, all at once, until none does: a block's dominators are its
    ancestors in each of these trees, and in the last all ancestors dominate.
    """
    tree = written(spanning_tree(edges, blocks, entry), "spanning")
    member = edges.select("prototype", F.col("dst").alias("node"), F.col("src").alias("member")).distinct().where(F.col("node") != entry)
    member = member.join(tree.select("prototype", F.col("node").alias("member")), ["prototype", "member"], "left_semi")
    several = member.groupBy("prototype", "node").count().where("count > 1").select("prototype", "node")
    member = written(member.join(several, ["prototype", "node"], "left_semi"), "members")
    while True:
        full = written(numbered(tree), "numbered")
        common = written(_nearest_common(full, member), "common")
        moved = tree.join(common, ["prototype", "node"], "left").withColumn("_moves", F.col("common").isNotNull() & (F.col("common") != F.col("parent")))
        moved = written(moved.select("prototype", "node", F.coalesce("common", "parent").alias("parent"), "_moves"), "moved")
        if not moved.where("_moves").limit(1).count():
            return full
        tree = moved.drop("_moves")


def loop_bodies(edges: DataFrame, dominators: DataFrame) -> DataFrame:
    """(prototype, header, block) of natural loops, those of one header merged; back edges by the interval test."""
    place = dominators.select("prototype", "node", "enter", "leave")
    side = lambda c: place.select("prototype", *(F.col(x).alias(f"{c}_{x}" if x != "node" else c) for x in ("node", "enter", "leave")))
    live = written(edges.select("prototype", "src", "dst").distinct().join(side("src"), ["prototype", "src"]).join(side("dst"), ["prototype", "dst"]), "live")
    back = live.where("src_enter between dst_enter and dst_leave").select("prototype", F.col("dst").alias("header"), F.col("src").alias("block")).distinct()
    body = written(back.union(back.select("prototype", "header", F.col("header").alias("block"))).distinct(), "body")
    front, ways = body.where("block <> header"), live.select("prototype", "src", F.col("dst").alias("block"))
    while True:
        step = front.where("block <> header").join(ways, ["prototype", "block"]).select("prototype", "header", F.col("src").alias("block")).distinct()
        front = written(step.join(body, ["prototype", "header", "block"], "left_anti"), "wave")
        if not front.limit(1).count():
            return body
        body = written(body.union(front), "body")


def loop_nesting(edges: DataFrame, dominators: DataFrame) -> DataFrame:
    """(prototype, block_start, depth, loop, outer) of reached blocks in loops: how many loops hold it, the innermost one's header, and the header of the loop around that.

    The innermost loop is the one with the smallest body, of equals with the smaller header; so is the loop around a
    loop's header, its own excepted. Blocks outside loops have no row.
    """
    body = written(loop_bodies(edges, dominators), "bodies")
    size = body.groupBy("prototype", "header").agg(F.count("*").alias("size"))
    held = body.join(size, ["prototype", "header"])
    inner = held.groupBy("prototype", F.col("block").alias("block_start")).agg(F.count("*").alias("depth"), F.min(F.struct("size", "header"))["header"].alias("loop"))
    outer = held.where("block <> header").groupBy("prototype", F.col("block").alias("loop")).agg(F.min(F.struct("size", "header"))["header"].alias("outer"))
    return inner.join(outer, ["prototype", "loop"], "left").select("prototype", "block_start", "depth", "loop", "outer")


def block_order(ways: DataFrame, entry: int = ENTRY) -> DataFrame:
    """(prototype, block_start, place) of the blocks that the entry reaches: places from 1, such that jumps become neighbours.

    ways: (prototype, block_start, preferred, alternative), each block once. A run
    goes from a start along preferred ways until it meets a placed block;
    alternatives of its blocks wait in a queue, whose first unplaced block starts
    the next run. What waits when a run begins is popped before what the run adds,
    so runs come in waves, and all runs of a wave are made at once: of a wave's
    starts that lead to a block, the first holds it, in order of its distance. First
    starts and distances come from pointer doubling; rounds are the waves times the
    logarithm of a prototype's unplaced blocks. Ways to unknown blocks are ways out.
    """
    known = written(ways.select("prototype", "block_start", "preferred", "alternative"), "ways")
    free = known
    starts = written(known.where(F.col("block_start") == entry).select("prototype", "block_start", F.lit(1).cast("long").alias("rank")), "starts")
    placed, wave = written(starts.select("prototype", "block_start", F.lit(0).alias("wave"), "rank", F.lit(0).cast("long").alias("steps")).limit(0), "placed"), 0
    while starts.limit(1).count():
        wave += 1
        runs = written(first_holders(free.join(starts.select("prototype").distinct(), "prototype", "left_semi"), starts).withColumn("wave", F.lit(wave)), "runs")
        placed = written(placed.unionByName(runs), "placed")
        free = written(free.join(runs, ["prototype", "block_start"], "left_anti"), "free")
        # An alternative waits where the first of its blocks in this wave has put it.
        waits = runs.join(known, ["prototype", "block_start"]).groupBy("prototype", F.col("alternative").alias("block_start")).agg(F.min(F.struct("rank", "steps")).alias("_by"))
        waits = waits.join(free, ["prototype", "block_start"], "left_semi")
        starts = written(waits.select("prototype", "block_start", F.row_number().over(Window.partitionBy("prototype").orderBy("_by")).cast("long").alias("rank")), "starts")
    order = Window.partitionBy("prototype").orderBy("wave", "rank", "steps")
    return placed.select("prototype", "block_start", F.row_number().over(order).cast("long").alias("place"))


def first_holders(ways: DataFrame, starts: DataFrame) -> DataFrame:
    """(prototype, block_start, rank, steps): of the starts (prototype, block_start, rank) that preferred ways lead from to a block, the least rank and its distance."""
    labels = written(ways.select("prototype", "block_start").join(starts, ["prototype", "block_start"], "left").select("prototype", "block_start", F.when(F.col("rank").isNotNull(), F.struct("rank", F.lit(0).cast("long").alias("steps"))).alias("label")), "labels")
    there = ways.select("prototype", F.col("block_start").alias("to"))
    jumps = written(ways.select("prototype", "block_start", F.col("preferred").alias("to")).join(there, ["prototype", "to"], "left_semi"), "jumps")
    most, steps = ways.groupBy("prototype").count().agg(F.max("count")).first()[0] or 0, 1
    while steps < most and jumps.limit(1).count():
        ahead = labels.where("label is not null").join(jumps, ["prototype", "block_start"])
        ahead = ahead.select("prototype", F.col("to").alias("block_start"), F.struct(F.col("label.rank").alias("rank"), (F.col("label.steps") + steps).alias("steps")).alias("label"))
        labels = written(labels.unionByName(ahead).groupBy("prototype", "block_start").agg(F.min("label").alias("label")), "labels")
        twice = jumps.select("prototype", F.col("block_start").alias("to"), F.col("to").alias("_to"))
        jumps = written(jumps.join(twice, ["prototype", "to"]).select("prototype", "block_start", F.col("_to").alias("to")), "jumps")
        steps *= 2
    return labels.where("label is not null").select("prototype", "block_start", "label.rank", "label.steps")


def emission_order(closures: DataFrame, prototypes: DataFrame) -> DataFrame:
    """(prototype, node, parent, place): prototypes of a group such that what a prototype creates comes before it.

    closures: (prototype: the group, node: the creator, child); prototypes: (prototype, node).
    A child that several create belongs to the smallest creator but itself. Trees
    follow in order of their roots, children in order of their numbers. Prototypes
    that create each other in a circle have no root: the smallest of a circle
    becomes one. Children that aren't among the prototypes are left out.
    """
    known = written(prototypes.select("prototype", "node").distinct(), "prototypes")
    made = closures.where("child <> node").join(known, ["prototype", "node"], "left_semi").groupBy("prototype", F.col("child").alias("node")).agg(F.min("node").alias("to"))
    made = written(made.join(known, ["prototype", "node"], "left_semi"), "made")
    ended = heads(made).select("prototype", "node")
    stuck = written(made.join(ended, ["prototype", "node"], "left_anti"), "stuck")
    cut = stuck.limit(0).select("prototype", "node")
    if stuck.limit(1).count():
        # Of those that lead to a circle, the smallest number met within as many steps as there are nodes is the circle's own.
        cut = circle_least(stuck)
    tree = known.join(made, ["prototype", "node"], "left").join(cut.withColumn("_cut", F.lit(True)), ["prototype", "node"], "left")
    tree = tree.select("prototype", "node", F.when(F.col("_cut").isNull(), F.col("to")).alias("parent"))
    return numbered(tree).select("prototype", "node", "parent", F.col("post").alias("place"))


def circle_least(pointers: DataFrame) -> DataFrame:
    """(prototype, node): the smallest node of each circle of pointers (prototype, node, to) that all lead to circles."""
    rows = written(pointers.select("prototype", "node", "to", F.col("to").alias("least")), "circles")
    most, steps = rows.groupBy("prototype").count().agg(F.max("count")).first()[0], 1
    while steps < 2 * most:
        ahead = rows.select("prototype", F.col("node").alias("to"), F.col("to").alias("_to"), F.col("least").alias("_least"))
        rows = written(rows.join(ahead, ["prototype", "to"]).select("prototype", "node", F.col("_to").alias("to"), F.least("least", "_least").alias("least")), "circles")
        steps *= 2
    # After more steps than nodes a pointer stands on its circle, and so does what a node there has met.
    on = rows.select("prototype", F.col("to").alias("node")).distinct()
    return rows.join(on, ["prototype", "node"], "left_semi").where("node = least").select("prototype", "node")
