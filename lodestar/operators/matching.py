"""Matches of captions, mentions, labels, boxes and requests."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.functions.text import SHORTENED, let
from lodestar.operators.spatial import with_cells
from lodestar.sources.scratch import remove, written


def figures_or_panels(figures: DataFrame, panels: DataFrame, fig: str, usable: str) -> DataFrame:
    """Usable panels stand for their figure; a figure without any stays itself. A task holds the other side's distinct keys of its share and nothing else: rows run through unsorted, no side is a broadcast, and the shares are not put together into fewer tasks, as these keys take many times what they take in a shuffle."""
    parts = int(figures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    good = panels.where(F.col(usable)).drop(usable)
    dealt = lambda df: df.repartition(parts, fig)
    keys = lambda df: dealt(df.select(fig)).hint("shuffle_hash")
    return dealt(figures).join(keys(good), fig, "left_anti").unionByName(dealt(good).join(keys(figures), fig, "left_semi"))


def ordered_distinct(df: DataFrame, value: str, order: str, parts: int = 64) -> DataFrame:
    """Distinct values in the order in which they are first seen. Ranges of the order are ranked each by itself, after what the ranges before hold; their bounds and sizes are one row for each of parts ranges."""
    g = df.groupBy(value).agg(F.min(order).alias("primero"))
    bounds = F.broadcast(df.agg(F.array_sort(F.array_distinct(F.percentile_approx(order, [k / parts for k in range(1, parts)], 1000))).alias("_bounds")))  # one row
    placed = g.crossJoin(bounds).withColumn("_part", F.size(F.filter("_bounds", lambda b: b < F.col("primero")))).drop("_bounds")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # at most parts rows
    ranked = placed.withColumn("_own", F.row_number().over(Window.partitionBy("_part").orderBy("primero")))
    return ranked.join(F.broadcast(before), "_part").select(value, "primero", (F.col("_own") + F.col("_before")).cast("int").alias("puesto"))


def missing_elsewhere(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys the other table lacks."""
    return df.join(other.select(*keys).distinct(), keys, "left_anti")


def captions(figures: DataFrame, caps: DataFrame, keys: list[str], fid: str, share: float = 0.3, most: float = 60.0, size: float = 100.0) -> DataFrame:
    """(keys, fid, cid): the caption of least score on a figure's page. figures: x0, y0, x1, y1; caps: cid, cx0, cy0, cx1, cy1. Below: the distance; above: that and 10; inside: 5. They must overlap sideways by a share of the narrower, and be within most.

    Bands of size over the height make it an equi-join: a figure reaches as far as its score allows, a caption is where it is; they meet in the first band that both have.
    """
    band = lambda c: F.floor(c / size)
    spans = lambda df, lo, hi: df.withColumn("_lo", band(lo)).withColumn("_cell", F.explode(F.sequence(F.col("_lo"), band(hi))))
    reach = most + 10
    f = spans(figures, F.least("y0", "y1") - reach, F.greatest("y0", "y1") + reach).withColumnRenamed("_lo", "_flo")
    j = f.join(spans(caps, F.least("cy0", "cy1"), F.greatest("cy0", "cy1")), [*keys, "_cell"]).where(F.col("_cell") == F.greatest("_flo", "_lo"))
    over = F.least("cx1", "x1") - F.greatest("cx0", "x0")
    score = F.when(F.col("cy0") >= F.col("y1") - 2, F.col("cy0") - F.col("y1")).when(F.col("cy1") <= F.col("y0") + 2, F.col("y0") - F.col("cy1") + 10).otherwise(F.lit(5.0))
    ok = j.where(over >= share * F.least(F.col("cx1") - F.col("cx0"), F.col("x1") - F.col("x0"))).withColumn("_s", score).where(F.col("_s") - 10 <= most)
    return ok.groupBy(*keys, fid).agg(F.min(F.struct("_s", "cid")).alias("_b")).select(*keys, fid, F.col("_b.cid").alias("cid"), F.col("_b._s").alias("puntaje"))


def cited_numbers(text: Column) -> Column:
    """The figure numbers that a text cites, ranges spelt out where they are under 20 wide. What follows each mention is looked at by itself."""
    after = F.split(F.lower(text), rf"\b(?:{'|'.join(sorted(SHORTENED, reverse=True))})s?\.?\s*")
    after = F.slice(after, 2, F.greatest(F.size(after) - 1, F.lit(0)))

    def spelt(piece):
        return let(F.regexp_extract(piece, r"^\d+(\.\d+)?", 0), lambda number: F.when(number == "", F.array().cast("array<string>")).otherwise(ranged(piece, number)))

    def ranged(piece, number):
        last = F.regexp_extract(F.substring(piece, F.length(number) + 1, F.length(piece)), r"^\s*[-–]\s*(\d+)", 1)
        end = let(last, lambda d: F.when(d != "", d.try_cast("int")))  # a cast that fails throws inside, which is slow
        return let(F.struct(number.try_cast("int").alias("a"), end.alias("b")), lambda x: whole(number, x["a"], x["b"]))

    def whole(number, a, b):
        wide = a.isNotNull() & b.isNotNull() & (b > a) & (b - a < 20)
        low = F.coalesce(a, F.lit(0))
        return F.when(wide, F.transform(F.sequence(low, F.when(wide, b).otherwise(low)), lambda n: n.cast("string"))).otherwise(F.array(number))

    return F.sort_array(F.array_distinct(F.flatten(F.transform(after, spelt))))


def mentions(figures: DataFrame, paragraphs: DataFrame, doc: str, fid: str, number: str, pid: str, text: str, caption: Column, most: int = 6) -> DataFrame:
    """(doc, fid, pid): the first paragraphs of the document that cite a figure's number, captions left out. Numbers are read once and joined by equality; of those that cite a number the first ones are enough for all its figures."""
    cites = paragraphs.where(~caption).select(doc, pid, F.explode_outer(cited_numbers(F.col(text))).alias("_n")).where("_n is not null")  # an inner explode would read each text twice, once for whether it has any
    cites = cites.withColumn("_k", F.row_number().over(Window.partitionBy(doc, "_n").orderBy(pid))).where(F.col("_k") <= most)
    j = figures.join(cites, (figures[doc] == cites[doc]) & (figures[number] == cites["_n"])).select(figures[doc], fid, pid)
    return j.withColumn("puesto", F.row_number().over(Window.partitionBy(doc, fid).orderBy(pid))).where(F.col("puesto") <= most)


def around(figures: DataFrame, blocks: DataFrame, keys: list[str], fid: str, bid: str, words: Column, least: int = 8, slack: float = 2.0) -> DataFrame:
    """The closest body block that ends above a figure, and the closest that starts below it, for figures on pages with body blocks. blocks: by0, by1. An as-of on position: figures and blocks in one order, each figure takes the last block before it, from above and from below. Of blocks at one height the one with the least id."""
    body = blocks.where(words >= least)
    types = dict(blocks.dtypes)
    block = lambda at: body.select(*keys, at.alias("_at"), F.lit(1).alias("_rank"), F.lit(None).cast(dict(figures.dtypes)[fid]).alias(fid), F.struct(at.alias("at"), F.col(bid).alias("id")).alias("_block"))
    figure = lambda at, rank: figures.select(*keys, at.alias("_at"), rank.alias("_rank"), fid, F.lit(None).cast(f"struct<at:{types['by0']},id:{types[bid]}>").alias("_block"))
    order = ["_at", "_rank", F.desc("_block.id")]
    last = lambda df, name: df.withColumn(name, F.last("_block", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).where(F.col(fid).isNotNull()).select(*keys, fid, name)
    above = last(block(F.col("by1")).union(figure(F.col("y0") + slack, F.lit(2))), "_a")
    # below, positions count downwards; a figure lower than twice the slack takes blocks that lie wholly under its upper edge
    low = F.col("y1") - F.col("y0") <= 2 * slack
    start = F.when(low, F.col("y0") + slack).otherwise(F.col("y1") - slack)
    below = last(block(-F.col("by0")).union(figure(-start, F.when(low, 0).otherwise(2))), "_b")
    # and those that begin beside such a low figure but end under it: few, met in bands of the slack
    band = lambda c: F.floor(c / slack)
    beside = figures.where(low).withColumn("_band", F.explode(F.sequence(band(F.col("y1") - slack), band(F.col("y0") + slack)))).join(body.withColumn("_band", band(F.col("by0"))), [*keys, "_band"])
    beside = beside.where((F.col("by0") >= F.col("y1") - slack) & (F.col("by0") <= F.col("y0") + slack) & (F.col("by1") > F.col("y0") + slack)).groupBy(*keys, fid).agg(F.min(F.struct(F.col("by0").alias("at"), F.col(bid).alias("id"))).alias("_c"))
    both = above.join(below, [*keys, fid]).join(beside, [*keys, fid], "left").join(body.select(*keys).distinct(), keys, "left_semi")
    return both.select(*keys, fid, F.col("_a.id").alias("antes"), F.coalesce("_c.id", "_b.id").alias("despues"))


def interval_labels(groups: DataFrame, tokens: DataFrame, keys: list[str], gid: str, size: float) -> DataFrame:
    """Tokens (keys, tid, cx) go to the group (keys, gid, c0, c1) between whose neighbours' middles they lie. Cells of size make it an equi-join."""
    o = Window.partitionBy(*keys).orderBy("c0")
    wide = F.col("c1") - F.col("c0")
    span = groups.withColumn("_a", F.coalesce((F.lag("c1").over(o) + F.col("c0")) / 2, F.col("c0") - wide)).withColumn("_b", F.coalesce((F.col("c1") + F.lead("c0").over(o)) / 2, F.col("c1") + wide))
    spread = span.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_a") / size), F.floor(F.col("_b") / size))))
    return tokens.withColumn("_cell", F.floor(F.col("cx") / size)).join(spread, [*keys, "_cell"]).where(F.col("cx").between(F.col("_a"), F.col("_b"))).select(*keys, gid, "tid")


def greedy_pairs(candidates: DataFrame, keys: list[str], left: str, right: str, order: list[str]) -> DataFrame:
    """Candidates in order; each left and each right is used once. A pair that comes first both for its left and for its right is one that the order would take, whatever happens elsewhere; so all such pairs are taken at a time, those that share a side with them go, and again, until none are left. No group needs to fit a task."""
    rank = F.struct(*(o for o in order), *(c for c in (left, right) if c not in order))
    first = lambda df, side: df.groupBy(*keys, side).agg(F.min("_rank").alias("_first"))
    left_over, taken = written(candidates.withColumn("_rank", rank)), []
    while True:
        best = left_over.join(first(left_over, left), [*keys, left]).where("_rank = _first").drop("_first").join(first(left_over, right), [*keys, right]).where("_rank = _first").drop("_first")
        taken.append(written(best.select(*candidates.columns)))
        rest = written(left_over.join(taken[-1].select(*keys, left), [*keys, left], "left_anti").join(taken[-1].select(*keys, right), [*keys, right], "left_anti").select(*left_over.columns))
        remove(candidates.sparkSession, left_over.scratch_path)
        left_over = rest
        if rest.isEmpty():
            return functools.reduce(DataFrame.unionByName, taken)


def value_labels(bars: DataFrame, tokens: DataFrame, keys: list[str], size: float, band: float = 0.3) -> DataFrame:
    """(keys, bar, tid): each bar, the longest first, takes the unused number nearest to its end.

    bars: bar, c0, c1 (its band), near, far (its ends), vertical; tokens: tid, cx, cy, pw, ph. A number must lie in the band widened by a share of its width, and from the bar's end outwards within 2.5 of its own height, inwards within 0.6 of the bar's length and its own height. Cells of size over the band make the candidates an equi-join.
    """
    wide = band * (F.col("c1") - F.col("c0"))
    spread = bars.withColumn("_lo", F.col("c0") - wide).withColumn("_hi", F.col("c1") + wide).withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_lo") / size), F.floor(F.col("_hi") / size))))
    # a number seen across an upright bar, and across a lying one
    seen = F.explode(F.array(F.struct(F.lit(True).alias("vertical"), F.col("cx").alias("_c"), F.col("cy").alias("_v"), F.col("ph").alias("_h")), F.struct(F.lit(False).alias("vertical"), F.col("cy").alias("_c"), F.col("cx").alias("_v"), F.col("pw").alias("_h"))))
    across = tokens.select(*keys, "tid", seen.alias("_s")).select(*keys, "tid", "_s.*").withColumn("_cell", F.floor(F.col("_c") / size))
    met = spread.join(across, [*keys, "vertical", "_cell"]).where(F.col("_c").between(F.col("_lo"), F.col("_hi")))
    out = F.when(F.col("far") < F.col("near"), F.col("far") - F.col("_v")).otherwise(F.col("_v") - F.col("far"))
    length = F.abs(F.col("far") - F.col("near"))
    fits = met.withColumn("_d", out).where((F.col("_d") <= 2.5 * F.col("_h")) & (F.col("_d") >= -0.6 * length - F.col("_h")))
    ranked = fits.select(*keys, "bar", "tid", (-length).alias("_l"), F.abs("_d").alias("_a"))
    return greedy_pairs(ranked, keys, "bar", "tid", ["_l", "bar", "_a", "tid"]).select(*keys, "bar", "tid")


def nearest_pairs(lefts: DataFrame, rights: DataFrame, keys: list[str], left: str, right: str, x: str, y: str, most: float) -> DataFrame:
    """greedy_pairs of the candidates left and right with |x - y| < most, in order of that distance d, left and right, without making them. On a line what is nearest to a left is the last right before it or the first behind it; lefts and rights that are nearest to each other are taken at a time, then again among what is left. Rounds are sorts by position, so no group needs to fit a task's memory."""
    side = lambda df, i, v, k: df.where(F.col(v).isNotNull() & ~F.isnan(F.col(v).cast("double"))).select(*keys, F.lit(k).alias("_side"), F.col(v).cast("double").alias("_v"), F.col(i).alias("_id"))
    types = dict(lefts.dtypes)[left], dict(rights.dtypes)[right]
    if types[0] != types[1]:
        raise TypeError(f"ids of both sides should be of one type, not {types[0]} and {types[1]}")
    todo, taken = written(side(lefts, left, x, 0).union(side(rights, right, y, 1))), []
    up = Window.partitionBy(*keys).orderBy("_v").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy(*keys).orderBy(F.desc("_v")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    while True:
        # of equal places the least id comes first
        spots = todo.withColumn("_least", F.min("_id").over(Window.partitionBy(*keys, "_side", "_v")))
        at = F.struct(F.col("_v").alias("v"), F.col("_least").alias("id"))
        other = lambda over, f: F.when(F.col("_side") == 0, f(F.when(F.col("_side") == 1, at)).over(over)).otherwise(f(F.when(F.col("_side") == 0, at)).over(over))
        seen = spots.withColumn("_before", other(up, F.max)).withColumn("_after", other(down, F.min))
        reach = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("_v") - F.col(f"{c}.v")).alias("d"), F.col(f"{c}.id").alias("id")))
        near = seen.withColumn("_to", F.least(reach("_before"), reach("_after"))).where((F.col("_to.d") < most))
        mine = lambda k, a, b: near.where(F.col("_side") == k).select(*keys, F.col("_id").alias(a), F.col("_to.id").alias(b), F.col("_to.d").alias("d"))
        pairs = written(mine(0, left, right).join(mine(1, right, left).drop("d"), [*keys, left, right]))
        if pairs.isEmpty():
            remove(lefts.sparkSession, todo.scratch_path)
            return functools.reduce(DataFrame.unionByName, [*taken, pairs])
        taken.append(pairs)
        gone = pairs.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("_side"), F.col(left).alias("_id")), F.struct(F.lit(1).alias("_side"), F.col(right).alias("_id")))).alias("_x")).select(*keys, "_x.*")
        rest = written(todo.join(gone, [*keys, "_side", "_id"], "left_anti").select(*todo.columns))
        remove(lefts.sparkSession, todo.scratch_path)
        todo = rest


def nearest_class(items: DataFrame, palette: DataFrame, vector: str, names: str, centre: str, most: float) -> DataFrame:
    """The closest reference of a fixed palette, null beyond most. The palette is short: it goes to every task."""
    pal = palette.agg(F.array_sort(F.collect_list(F.struct(names, centre))).alias("_pal"))
    dist = lambda p: F.sqrt(F.aggregate(F.zip_with(F.col(vector), p[centre], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    best = F.array_min(F.transform("_pal", lambda p: F.struct(dist(p).alias("d"), p[names].alias("c"))))
    j = items.crossJoin(F.broadcast(pal)).withColumn("_b", best)  # one row
    return j.withColumn("clase", F.when(F.col("_b.d") <= most, F.col("_b.c"))).withColumn("distancia", F.col("_b.d")).drop("_pal", "_b")


def by_position(df: DataFrame, labels: DataFrame, keys: list[str], x: str, tol: float = 0.25) -> DataFrame:
    """The label (keys, pos, label) at the rounded position, if x is within tol of it."""
    return df.withColumn("_p", F.bround(x, 0).cast("int")).join(labels.withColumnRenamed("pos", "_p"), [*keys, "_p"], "left").withColumn("label", F.when(F.abs(F.col(x) - F.col("_p")) <= tol, F.col("label"))).drop("_p")


def nearest_label(groups: DataFrame, labels: DataFrame, keys: list[str], gid: str, step: float, share: float = 0.6) -> DataFrame:
    """The label (keys, lid, lx) nearest to each group's centre (gx), within a share of the step."""
    reach = share * step
    cell = lambda c: F.floor(c / reach)
    more = reach * (1 + 1e-9)
    row, types = F.struct(*(F.col(c) for c in groups.columns)), dict(labels.dtypes)
    at = f"struct<x:{types['lx']},lid:{types['lid']}>"
    # labels at one place are one, the least; each is in the cells that it reaches
    places = labels.groupBy(*keys, "lx").agg(F.min("lid").alias("lid")).withColumn("_cell", F.explode(F.sequence(cell(F.col("lx") - more), cell(F.col("lx") + more))))
    asked = groups.select(*keys, cell(F.col("gx")).alias("_cell"), F.col("gx").cast("double").alias("_x"), F.lit(1).alias("_side"), row.alias("_g"), F.lit(None).cast(at).alias("_l"))
    both = places.select(*keys, "_cell", F.col("lx").cast("double").alias("_x"), F.lit(0).alias("_side"), F.lit(None).cast(asked.schema["_g"].dataType).alias("_g"), F.struct(F.col("lx").alias("x"), "lid").alias("_l")).unionByName(asked)
    # an as-of from either side: a group sees the last label before it and the first behind it, however many lie around
    last = lambda x: F.last("_l", ignorenulls=True).over(Window.partitionBy(*keys, "_cell").orderBy(x, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    off = lambda c: F.abs(F.col("_x") - F.col(f"{c}.x"))
    near = lambda c: F.when(off(c) <= reach, F.struct(off(c).alias("d"), F.col(f"{c}.lid").alias("lid")))
    seen = both.withColumn("_a", last(F.col("_x"))).withColumn("_b", last(F.desc("_x"))).where("_side = 1")
    return seen.select("_g.*", F.least(near("_a"), near("_b"))["lid"].alias("lid"))


def without_overlaps(boxes: DataFrame, keys: list[str], bid: str, inside: float = 0.85, alike: float = 0.6, most_strokes: int = 3, size: float = 200.0) -> DataFrame:
    """Boxes (x0, y0, x1, y1, keep, caption, strokes) of a page without those that show the same figure again, in order of bid.

    Of two boxes that lie in one another by inside, nearly equal ones (areas within alike) lose the smaller. A much larger one is a frame, and goes, if both have the same caption, it holds no third box, and of its strokes (boxes as arrays) at most most_strokes lie outside the smaller, its own background (0.9 of its area) aside; else both stay. In either case a line chart (keep) stays over one that is not. A box that is gone decides nothing.

    Which boxes lie in which is a join by cells; what a pair would lose is told pair by pair. Only who is gone by then hangs on the order: a fold over a page's pairs.
    """
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    sized = boxes.withColumn("_area", area).where("_area > 0")
    fields = ("x0", "y0", "x1", "y1", "_area", "keep")
    one = lambda k, *more: sized.select(*keys, F.struct(F.col(bid).alias("id"), *fields, F.trim(F.coalesce("caption", F.lit(""))).alias("caption"), *more).alias(k), *fields[:4])
    placed = lambda k, *more: with_cells(one(k, *more), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), size).drop(*fields[:4])
    over = lambda lo, hi: F.greatest(F.least(f"s.{hi}", f"l.{hi}") - F.greatest(f"s.{lo}", f"l.{lo}"), F.lit(0.0))
    shared = over("x0", "x1") * over("y0", "y1")
    met = placed("s").join(placed("l", F.col("strokes")), [*keys, "cx", "cy"]).where((F.col("s.id") != F.col("l.id")) & (shared / F.col("s._area") >= inside))
    lies = written(met.groupBy(*keys, F.col("s.id").alias("_s"), F.col("l.id").alias("_l")).agg(F.first("s").alias("s"), F.first("l").alias("l")))
    held = lies.groupBy(*keys, "_l").agg(F.count(F.lit(1)).alias("_holds"))
    # each pair once: the smaller is the one of less area, of equal ones the first
    small = (F.col("s._area") < F.col("l._area")) | ((F.col("s._area") == F.col("l._area")) & (F.col("_s") < F.col("_l")))
    apart = lambda b: (b[2] <= F.col("s.x0")) | (b[0] >= F.col("s.x1")) | (b[3] <= F.col("s.y0")) | (b[1] >= F.col("s.y1"))
    outside = F.size(F.filter(F.coalesce("l.strokes", F.array().cast("array<array<double>>")), lambda b: apart(b) & ((b[2] - b[0]) * (b[3] - b[1]) < 0.9 * F.col("l._area"))))
    frame = (F.col("s.caption") != "") & (F.col("s.caption") == F.col("l.caption")) & (F.col("_holds") == 1) & (outside <= most_strokes)
    loser = F.when(F.col("s._area") >= alike * F.col("l._area"), F.struct(F.col("_s").alias("gone"), F.col("_l").alias("stays"), F.col("s.keep").alias("k"), F.col("l.keep").alias("o"))).when(frame, F.struct(F.col("_l").alias("gone"), F.col("_s").alias("stays"), F.col("l.keep").alias("k"), F.col("s.keep").alias("o")))
    told = lies.join(held, [*keys, "_l"]).where(small).withColumn("_x", loser).where("_x is not null").withColumn("_gone", F.when(F.col("_x.k") & ~F.col("_x.o"), F.col("_x.stays")).otherwise(F.col("_x.gone")))
    pair = F.struct(F.least("_s", "_l").alias("a"), F.greatest("_s", "_l").alias("b"), F.col("_gone").alias("gone"))
    none = F.array().cast(f"array<{dict(boxes.dtypes)[bid]}>")
    fold = F.aggregate("_pairs", none, lambda gone, p: F.when(F.array_contains(gone, p["a"]) | F.array_contains(gone, p["b"]), gone).otherwise(F.concat(gone, F.array(p["gone"]))))
    lost = told.groupBy(*keys).agg(F.array_sort(F.collect_list(pair)).alias("_pairs")).select(*keys, F.explode(fold).alias(bid))
    return boxes.join(lost, [*keys, bid], "left_anti").select(*boxes.columns)


def united_boxes(boxes: DataFrame, keys: list[str], bid: str, gap: float = 15.0, size: float = 100.0) -> DataFrame:
    """Boxes nearer than gap in both axes are united until none are. In a round each box joins the near one of the least hash (its own, if that is less), and boxes of one name become one; a round more as long as boxes are near. Hashes instead of ids, so that a chain of boxes shrinks by a share in each round. How boxes are united in between does not change where it ends: near boxes are of one in any case."""
    spark = boxes.sparkSession
    shape = lambda df: df.select(*keys, "_h", *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")))
    todo = written(shape(boxes.withColumn("_h", F.xxhash64(F.col(bid)))))
    while True:
        cells = with_cells(todo, F.col("x0") - gap / 2, F.col("y0") - gap / 2, F.col("x1") + gap / 2, F.col("y1") + gap / 2, size)
        o = cells.select(*keys, "cx", "cy", *(F.col(c).alias(f"o_{c}") for c in ("_h", "x0", "y0", "x1", "y1")))
        # cells are more than Spark thinks, so neither side is a broadcast
        near = cells.join(o.hint("shuffle_hash"), [*keys, "cx", "cy"]).where(F.expr(f"_h <> o__h and x0 - {gap} <= o_x1 and o_x0 - {gap} <= x1 and y0 - {gap} <= o_y1 and o_y0 - {gap} <= y1"))
        named = written(near.groupBy(*keys, "_h").agg(F.min("o__h").alias("_to")))
        if named.isEmpty():
            break
        joined = todo.join(named, [*keys, "_h"], "left").withColumn("_h", F.least("_h", F.coalesce("_to", "_h")))
        fewer = written(shape(joined.groupBy(*keys, "_h").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))))
        for t in (todo, named):
            remove(spark, t.scratch_path)
        todo = fewer
    order = Window.partitionBy(*keys).orderBy("x0", "y0", "x1", "y1")
    return todo.select(*keys, (F.row_number().over(order) - 1).cast("bigint").alias("n"), "x0", "y0", "x1", "y1")
