"""Control-flow graphs of record prototypes: leaders, blocks, edges, reachability."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import written_rows as written
from .records import opcode_dimension, plausible

JUMPS, BRANCHES, EXITS = ("jump", "for-prep"), ("test", "compare-jump", "for-loop"), ("return", "tailcall")


def flow(instructions: DataFrame) -> DataFrame:
    """(prototype, pc, size, kind, target): what each instruction does to control.

    Unknown opcodes, and effects that name implausible registers, fall through.

    A target is one more than the branch channel's resolved place or payload.
    """
    dim = F.broadcast(opcode_dimension(instructions.sparkSession).where("status = 'proven'").select("raw_opcode", "kind", "target"))
    sized = instructions.withColumn("size", F.max("pc").over(Window.partitionBy("prototype")))
    rows = plausible(sized, keep_unknown=True).join(dim, "raw_opcode", "left")
    rows = rows.withColumn("kind", F.when(F.col("plausible") == 1, F.col("kind")))
    word = F.when(F.col("target") == "a", F.col("word_a")).when(F.col("target") == "n", F.col("word_n")).when(F.col("target") == "q", F.col("word_q"))
    payload, mode = F.floor(word / 8), word % 8
    place = F.when(mode == 3, F.col("pc") + payload).when(mode == 6, F.col("pc") - payload).otherwise(payload) + 1
    ends = F.col("kind").isin(*JUMPS, *BRANCHES, *EXITS)
    return rows.select("prototype", "pc", "size", F.when(ends, F.col("kind")).alias("kind"), F.when(ends, place).alias("target"))


def blocks(flow: DataFrame) -> DataFrame:
    """(prototype, block_start, block_end): blocks from leaders, which are 1, targets in range, and what follows a branch."""
    first = flow.select("prototype", "size", F.lit(1).cast("long").alias("leader"))
    target = flow.where("target between 1 and size").select("prototype", "size", F.col("target").cast("long"))
    after = flow.where("kind is not null and pc < size").select("prototype", "size", (F.col("pc") + 1).cast("long"))
    leaders = first.union(target).union(after).distinct()
    order = Window.partitionBy("prototype").orderBy("leader")
    return leaders.select("prototype", F.col("leader").alias("block_start"), (F.coalesce(F.lead("leader").over(order), F.col("size") + 1) - 1).cast("long").alias("block_end"))


def edges(flow: DataFrame, blocks: DataFrame) -> DataFrame:
    """(prototype, src, dst): distinct edges between blocks, by their starts. Targets are leaders, so they are joined by equality."""
    last = blocks.join(flow.withColumnRenamed("pc", "block_end"), ["prototype", "block_end"])
    kind = F.col("kind")
    nexts = F.when(kind.isin(*EXITS), F.array().cast("array<bigint>")).when(kind.isin(*JUMPS), F.array(F.col("target").cast("long"))).when(kind.isin(*BRANCHES), F.array(F.col("target").cast("long"), F.col("block_end") + 1)).otherwise(F.array(F.col("block_end") + 1))
    out = last.select("prototype", F.col("block_start").alias("src"), F.explode(nexts).alias("dst"), "size")
    return out.where("dst between 1 and size").select("prototype", "src", "dst").distinct()


def ways(flow: DataFrame, blocks: DataFrame) -> DataFrame:
    """(prototype, block_start, preferred, alternative): a row a block; null where there is no such way, or it leaves the prototype.

    Preferred is what follows a block or its jump leads to; after a branch, the next block, and the branch's target is the alternative.
    """
    last = blocks.join(flow.withColumnRenamed("pc", "block_end"), ["prototype", "block_end"])
    kind, target, after = F.col("kind"), F.col("target").cast("long"), F.col("block_end") + 1
    to = F.when(kind.isin(*JUMPS), target).when(kind.isNull() | kind.isin(*BRANCHES), after)
    within = lambda c, name: F.when(c.between(1, F.col("size")), c).alias(name)
    return last.select("prototype", "block_start", within(to, "preferred"), within(F.when(kind.isin(*BRANCHES), target), "alternative"))


def circling(edges: DataFrame) -> DataFrame:
    """(prototype) of those with an edge that leads to no later block. A circle has one, so the others have no loop at all."""
    return edges.where("dst <= src").select("prototype").distinct()


def dominators(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """(prototype, block_start, dominator) of reachable blocks: what every way from the block at 1 passes, itself included.

    Pairs are a relation: a block keeps what all of its predecessors that have
    been met share. Rounds are written, and end when nothing changes.
    """
    entry = blocks.where("block_start = 1").select("prototype", "block_start", F.col("block_start").alias("dominator"))
    pairs, state = written(entry, "pairs"), None
    while True:
        inward = edges.where("dst <> 1").join(pairs.withColumnRenamed("block_start", "src"), ["prototype", "src"])
        shared = inward.groupBy("prototype", "dst", "dominator").agg(F.count("*").alias("n"))
        met = inward.where("dominator = src").groupBy("prototype", "dst").agg(F.count("*").alias("sources"))
        kept = shared.join(met, ["prototype", "dst"]).where("n = sources").select("prototype", F.col("dst").alias("block_start"), "dominator")
        own = met.select("prototype", F.col("dst").alias("block_start"), F.col("dst").alias("dominator"))
        pairs = written(entry.union(kept).union(own).distinct(), "pairs")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("prototype", "block_start", "dominator").cast("decimal(38,0)"))).first()
        if now == state:
            return pairs
        state = now


def natural_loops(edges: DataFrame, dominators: DataFrame) -> DataFrame:
    """(prototype, header, latch, body, exits, rank): loops of back edges, whose target dominates their source.

    body counts the blocks that reach the latch without passing the header, and
    both of these; exits the edges that leave them. rank goes from the smallest
    body up. Bodies grow backwards by waves, each written.
    """
    known = dominators.select("prototype", F.col("block_start").alias("src")).distinct()
    edges = written(edges.join(known, ["prototype", "src"], "left_semi"), "edges")
    back = edges.join(dominators.select("prototype", F.col("block_start").alias("src"), F.col("dominator").alias("dst")), ["prototype", "src", "dst"])
    back = written(back.select("prototype", F.col("dst").alias("header"), F.col("src").alias("latch")), "back")
    keys = ["prototype", "header", "latch"]
    front = back.select(*keys, F.col("latch").alias("block"))
    body = front
    while True:
        step = front.where("block <> header").join(edges.withColumnRenamed("dst", "block"), ["prototype", "block"]).select(*keys, F.col("src").alias("block")).distinct()
        front = written(step.join(body, [*keys, "block"], "left_anti"), "wave")
        if not front.limit(1).count():
            break
        body = body.union(front)
    body = written(body, "body")
    inside = body.withColumnRenamed("block", "dst")
    leaving = body.withColumnRenamed("block", "src").join(edges, ["prototype", "src"]).join(inside, [*keys, "dst"], "left_anti").groupBy(*keys).agg(F.count("*").alias("exits"))
    sized = body.groupBy(*keys).agg(F.count("*").alias("body")).join(leaving, keys, "left")
    order = Window.partitionBy("prototype").orderBy("body", "header", "latch")
    return sized.select(*keys, "body", F.coalesce("exits", F.lit(0).cast("long")).alias("exits"), F.row_number().over(order).alias("rank"))
