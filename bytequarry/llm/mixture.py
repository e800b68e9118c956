"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

A source's target is its share of all words, at most ``most`` times what it has.
Each document is taken whole as often as the ratio's integer part says. The
words that remain come from a sample with inclusion probabilities by size: p is
in proportion to the document's size class (powers of two), 1 at most, such that
the words expected are those that remain. Classes that reach 1 are certain and
taken whole. The others are ranked by the odds of a fixed uniform number divided
by the odds of p (Rosen's Pareto order sampling) and taken in that order: the
sample's size is fixed, in words, within half a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fits_broadcast, text_or_empty, word_count, written

WEIGHTS = (1, 2, 3)
SLICES = 4096  # of the ranks of a source; only the slice where a source's words run out is sorted


def uniform(id_col: Column, seed: int) -> Column:
    """A number in (0, 1) from an id and a seed, the same in every run: 52 bits of an MD5."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, most: int = 3, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target): one row a source.

    Sources by code point, null last, weigh ``weights`` in turn. A source whose
    share exceeds ``most`` times its size gets that, and the others share the
    excess by weight, until none exceeds: in order of size by weight, sources are
    capped as long as the level of what is left, by weight left, reaches them.
    The windows here are over one row a source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    by_source = by_source.withColumn("w", F.element_at(F.array(*(F.lit(w) for w in weights)), (turn + 1).cast("int")))
    every = Window.partitionBy()
    order = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    level = left / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    capped = by_source.select("*", level.alias("level")).withColumn("capped", F.col("w") * F.col("level") >= most * F.col("source_size"))
    final = F.min(F.when(~F.col("capped"), F.struct(F.col("source_size") / F.col("w"), F.col("level"))))
    final = final.over(every)["level"]
    target = F.when(F.col("capped"), most * F.col("source_size")).otherwise(F.col("w") * final).cast("double")
    return capped.select("source", "source_size", target.alias("target"))


def size_class(size: Column) -> Column:
    """Number of binary digits: sizes of a class differ by a factor below 2. 0 for no words."""
    return F.when(size > 0, F.length(F.bin(size))).otherwise(0)


def inclusion(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, odds): for each source a map from size class to inclusion probability.

    From the largest class down, classes are certain as long as the level of
    words that are left, by words times measure, would exceed 1 for them. There
    are at most 63 classes, so the windows over a source's classes are small.
    """
    words = sizes.where("size > 0").groupBy("source", "class").agg(F.sum("size").alias("words"))
    words = words.join(plan.select(F.col("source").alias("_s"), "rest"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    words = words.withColumn("measure", F.expr("shiftleft(1L, class - 1)").cast("double"))
    down = Window.partitionBy("source").orderBy(F.col("class").desc()).rowsBetween(Window.unboundedPreceding, -1)
    up = Window.partitionBy("source").orderBy("class").rowsBetween(Window.unboundedPreceding, 0)
    level = (F.col("rest") - F.coalesce(F.sum("words").over(down), F.lit(0))) / F.sum(F.col("words") * F.col("measure")).over(up)
    words = words.withColumn("level", level)
    free = F.max(F.when(F.col("level") * F.col("measure") <= 1, F.struct("class", "level"))).over(Window.partitionBy("source"))
    p = F.when(F.col("class") > F.coalesce(free["class"], F.lit(0)), 1.0).otherwise(free["level"] * F.col("measure"))
    return words.select("source", "class", p.alias("p")).groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("class", "p"))).alias("odds"))


def place(u: Column, p: Column) -> Column:
    """The Pareto rank q = odds(u) / odds(p), as q / (1 + q): 0 for p = 1, 1 for p = 0."""
    a, b = u * (1 - p), p * (1 - u)
    return F.when(p >= 1, 0.0).when(p <= 0, 1.0).otherwise(a / (a + b))


def slice_of(rank: Column, p: Column) -> Column:
    """Number of a rank's slice; -1 for certain documents, which are never sorted."""
    return F.when(p >= 1, -1).otherwise(F.least(F.floor(rank * SLICES), F.lit(SLICES - 1)).cast("int"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = 3, seed: int = 1, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """All rows and columns of ``docs`` with mix_size, mix_source_size, mix_target and mix_copies.

    mix_copies (0 to ``most``) is how often the mix takes the row whole;
    copies * size sums up, in a source, to its target within about one document.

    A source may hold most rows: its words are summed by size class, and by
    slices of the rank, before the shuffle, and only the slice where its words
    run out is sorted. What goes back to the rows is one row a source.

    Null and empty texts have size 0; null sources are one source. Rows with the
    same id and text are drawn together or not at all; so results don't depend on
    the order of rows. An empty table gives no rows. Columns of ``docs`` with the
    names above are replaced.
    """
    docs = docs.drop("mix_size", "mix_source_size", "mix_target", "mix_copies")
    text = text_or_empty(text_col)
    row = {"size": word_count(text), "u": uniform(F.col(id_col), seed), "tie": F.xxhash64(text)}
    sizes = docs.select(F.col(source_col).cast("string").alias("source"), F.col(id_col).cast("long").alias("id"), *(c.alias(a) for a, c in row.items()))
    sizes = written(sizes.withColumn("class", size_class(F.col("size"))), "sizes")
    plan = targets(sizes, most, weights)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = plan.withColumn("ratio", ratio).withColumn("whole", F.floor("ratio").cast("long"))
    plan = written(plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).drop("ratio"), "plan")
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    odds = inclusion(sizes, plan)
    plan = written(plan.join(odds, same(plan, odds), "left").select(plan["*"], "odds"), "odds")
    side = lambda x: F.broadcast(x) if fits_broadcast(x, 2048) else x

    def probability(cls: Column, odds: Column) -> Column:
        return F.coalesce(F.element_at(odds, cls), F.lit(0.0))

    p = probability(F.col("class"), F.col("odds"))
    ranked = sizes.join(side(plan), same(sizes, plan)).select(sizes["*"], "rest", p.alias("p"))
    ranked = ranked.withColumn("v", place(F.col("u"), F.col("p")))
    ranked = ranked.withColumn("s", slice_of(F.col("v"), F.col("p")))
    by_slice = ranked.groupBy("source", "s").agg(F.sum("size").alias("words"), F.max("rest").alias("rest"))
    by_slice = by_slice.withColumn("after", F.sum("words").over(Window.partitionBy("source").orderBy("s")))
    cut = by_slice.where("s >= 0 and after >= rest").groupBy("source").agg(F.min(F.struct("s", "after", "words")).alias("cut"))
    cut = cut.select("source", F.col("cut.s").alias("cut_slice"), (F.col("cut.after") - F.col("cut.words")).alias("before"))
    known = plan.join(cut, same(plan, cut), "left").select(plan["*"], "cut_slice", "before")
    known = written(known, "cuts")

    edge = ranked.drop("rest").join(side(known.select("source", "rest", "cut_slice", "before")), same(ranked, known) & (F.col("s") == F.col("cut_slice"))).where("p > 0")
    edge = edge.select(ranked["source"], "id", "size", "v", "tie", "before", "rest")
    order = Window.partitionBy("source").orderBy("v", "id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0))
    taken = edge.withColumn("start", start).where((F.col("start") < F.col("rest")) & (F.col("start") + F.col("size") / 2 <= F.col("rest")))
    last = taken.groupBy("source").agg(F.max(F.struct("v", "id", "tie")).alias("last"))
    # Names of this side can't meet the documents' own.
    final = known.join(last, same(known, last), "left").select(*(known[c].alias(f"_bq_{c}") for c in ("source", "source_size", "target", "whole", "odds", "cut_slice")), F.col("last").alias("_bq_last"))
    final = written(final, "mixture")

    rows = docs.withColumn("mix_size", row["size"])
    out = rows.join(side(final), F.col(source_col).cast("string").eqNullSafe(F.col("_bq_source")))
    p = probability(size_class(F.col("mix_size")), F.col("_bq_odds"))
    v, cut = place(row["u"], p), F.col("_bq_cut_slice")
    at, here = slice_of(v, p), F.struct(v.alias("v"), F.col(id_col).cast("long").alias("id"), row["tie"].alias("tie"))
    drawn = (p > 0) & (cut.isNull() | (at < cut) | ((at == cut) & F.coalesce(here <= F.col("_bq_last"), F.lit(False))))
    copies = F.col("_bq_whole") + drawn.cast("long")
    return out.select(*rows.columns, F.col("_bq_source_size").alias("mix_source_size"), F.col("_bq_target").alias("mix_target"), copies.alias("mix_copies"))


def take(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row as often as mix_copies says, without the columns that ``mix`` added.

    Rows of null mix_copies, and blank texts, of which ``mix`` takes none, go; repeated rows are taken each as often as
    their own copies say; an empty table gives none.
    """
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies")))
    kept = [c for c in mixed.columns if c not in ("mix_size", "mix_source_size", "mix_target", "mix_copies")]
    return mixed.where("mix_copies > 0").select(*kept, times.alias("_bq_copy")).select(*kept)


#: The same mix in SQL; the window over a whole source is what the operator avoids.
MIX_SQL = r"""
with sizes as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         (('0x' || substr(md5('1:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint::double + 0.5) / 4503599627370496.0 as u
  from {docs}
), by_source as (
  select source, sum(size)::bigint as source_size, 1 + (row_number() over (order by source collate "C" nulls last) - 1) % 3 as w
  from sizes group by source
), leveled as (
  select *, (sum(source_size) over () - 3 * coalesce(sum(source_size) over before, 0))::double / (sum(w) over () - coalesce(sum(w) over before, 0)) as level
  from by_source
  window before as (order by source_size::double / w, source collate "C" nulls last rows between unbounded preceding and 1 preceding)
), plan as (
  select source, source_size, case when w * level >= 3 * source_size then (3 * source_size)::double
         else w * (select arg_min(level, source_size::double / w) from leveled where w * level < 3 * source_size) end as target
  from leveled
), ratios as (
  select *, floor(case when source_size > 0 then target / source_size else 0 end)::bigint as whole from plan
), sized as (
  select s.*, case when size > 0 then length(ltrim(bin(size), '0')) else 0 end as class, r.source_size, r.target, r.whole, r.target - r.whole * r.source_size as rest
  from sizes s join ratios r on s.source is not distinct from r.source
), classes as (
  select source, class, rest, sum(size)::double as words, (1::bigint << (class - 1)::int)::double as measure from sized where size > 0 group by source, class, rest
), filled as (
  select *, (rest - coalesce(sum(words) over (partition by source order by class desc rows between unbounded preceding and 1 preceding), 0))
    / sum(words * measure) over (partition by source order by class rows unbounded preceding) as level
  from classes
), free as (
  select source, max(class) filter (level * measure <= 1) as class, arg_max(level, class) filter (level * measure <= 1) as level from filled group by source
), odds as (
  select f.source, f.class, case when f.class > coalesce(x.class, 0) then 1.0 else x.level * f.measure end as p
  from filled f join free x on f.source is not distinct from x.source
), placed as (
  select s.*, coalesce(o.p, 0.0::double) as p from sized s left join odds o on s.source is not distinct from o.source and s.class = o.class
), ranked as (
  select *, case when p >= 1 then 0.0 when p <= 0 then 1.0 else u * (1 - p) / (u * (1 - p) + p * (1 - u)) end as v from placed
), started as (
  select *, coalesce(sum(size) over (partition by source order by p < 1, v, doc_id rows between unbounded preceding and 1 preceding), 0) as start from ranked
), drawn as (
  select *, case when p > 0 and (p >= 1 or (start < rest and start + size / 2.0 <= rest)) then 1 else 0 end as more from started
)
select doc_id, size, source_size, target, (size * (whole + more))::bigint as taken, (whole + more)::bigint as copies
from drawn
"""
