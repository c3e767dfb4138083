"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

DataFrame and SQL functions only. Documents of a source are dealt into permuted blocks by a hash;
whole passes and a part of a last pass over a source's blocks make up its target. A binary tree
splits the exact vector of block quotas among output shards: each node gives half of its draws to
its left child, source by source, by simulated draws without replacement. Each shard then takes the
next blocks of a source's permuted order, so that shards are disjoint, and is shuffled by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .common import WORD, fresh

# Blocks per source: bounds every table below except those of documents.
BLOCKS = 128
# The mix takes this share of all words; no source, and no document, is taken more than twice.
SHARE, MOST = 1.5, 2.0
# Sources in order of their names weigh these, repeating.
WEIGHTS = (3, 1, 2)
# 2 ** LEVELS output shards.
LEVELS = 4
SEED = 17


def source_targets(sized: DataFrame) -> DataFrame:
    """(source, n_docs, source_size, target, place, n_blocks) from (source, size).

    Sources are ordered by code point, null last. The common level of words per weight is the one at
    which targets, each cut at ``MOST`` times its source, add up to ``SHARE`` of all words.
    """
    totals = sized.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size")
    )
    # One row per source: names are few, and these windows see nothing else.
    every = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = totals.withColumn(
        "weight",
        F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(every) - 1) % len(WEIGHTS) + 1),
    ).withColumn("cut", MOST * F.col("source_size"))
    # By rising words per weight: the sources up to some place are cut, the others share the rest.
    rising = Window.orderBy(F.col("cut") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        SHARE * F.sum("source_size").over(whole) - F.coalesce(F.sum("cut").over(before), F.lit(0.0))
    ) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    # The first source in this order that is not cut has the common level.
    stepped = weighed.withColumn("level", level)
    uncut = F.when(F.col("cut") >= F.col("level") * F.col("weight"), F.col("level"))
    stepped = stepped.withColumn(
        "common",
        F.first(uncut, ignorenulls=True).over(
            rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        ),
    )
    target = F.least("cut", F.col("weight") * F.coalesce("common", F.lit(0.0)))
    return stepped.select(
        "source", "n_docs", "source_size", target.cast("double").alias("target"),
        F.row_number().over(every).alias("place"),
        F.greatest(F.lit(1), F.least(F.lit(BLOCKS), F.col("n_docs"))).cast("int").alias("n_blocks"),
    )


def _draws(quota: Column, among: Column, wanted: Column, seed: Column) -> Column:
    """How many of ``quota`` marked among ``among`` units come up in ``wanted`` draws without replacement."""
    start = F.struct(quota.alias("marked"), among.alias("units"), F.lit(0).cast("long").alias("drawn"))

    def draw(state: Column, turn: Column) -> Column:
        u = F.pmod(F.xxhash64(seed, turn), F.lit(1 << 30)) / float(1 << 30)
        hit = (u * state["units"] < state["marked"]).cast("long")
        return F.struct(
            (state["marked"] - hit).alias("marked"),
            (state["units"] - 1).alias("units"),
            (state["drawn"] + hit).alias("drawn"),
        )

    turns = F.when(wanted > 0, F.sequence(F.lit(1).cast("long"), wanted)).otherwise(
        F.array().cast("array<bigint>")
    )
    return F.aggregate(turns, start, draw, lambda state: state["drawn"])


def _left_quotas(quotas: Column, node: Column) -> Column:
    """Quotas of the left child: half of all units, drawn source by source from what is left."""
    total = F.aggregate(quotas, F.lit(0).cast("long"), lambda a, q: a + q["n"])
    empty = F.array().cast("array<struct<place:int,n:bigint>>")
    start = F.struct(total.alias("units"), F.floor((total + 1) / 2).alias("wanted"), empty.alias("out"))

    def take(state: Column, q: Column) -> Column:
        got = _draws(q["n"], state["units"], state["wanted"], F.xxhash64(node, q["place"]))
        return F.struct(
            (state["units"] - q["n"]).alias("units"),
            (state["wanted"] - got).alias("wanted"),
            F.concat(state["out"], F.array(F.struct(q["place"].alias("place"), got.alias("n")))).alias("out"),
        )

    return F.aggregate(quotas, start, take, lambda state: state["out"])


def split_quotas(quotas: DataFrame, levels: int = LEVELS, seed: int = SEED) -> DataFrame:
    """(place, shard, n): quotas (place int, n long) split exactly among 2 ** levels shards.

    Every child vector is a multivariate-hypergeometric draw from its parent's: a univariate draw
    for each source in turn, conditional on the ones before.
    """
    nodes = quotas.agg(
        F.array_sort(F.collect_list(F.struct(F.col("place").cast("int").alias("place"), F.col("n").cast("long").alias("n")))).alias("q")
    ).select(F.lit(0).cast("long").alias("shard"), "q")
    for level in range(levels):
        left = _left_quotas(F.col("q"), F.xxhash64(F.lit(seed), F.lit(level), F.col("shard")))
        nodes = nodes.withColumn("left", left).select(
            "shard", "q", "left",
            F.zip_with(
                "q", "left", lambda a, b: F.struct(a["place"].alias("place"), (a["n"] - b["n"]).alias("n"))
            ).alias("right"),
        ).select(
            F.explode(
                F.array(
                    F.struct((F.col("shard") * 2).alias("shard"), F.col("left").alias("q")),
                    F.struct((F.col("shard") * 2 + 1).alias("shard"), F.col("right").alias("q")),
                )
            ).alias("node")
        ).select("node.shard", "node.q")
    return nodes.select("shard", F.explode("q").alias("q")).select("q.place", "shard", "q.n")


def block_plan(dealt: DataFrame, levels: int = LEVELS, seed: int = SEED) -> DataFrame:
    """(source, block, passes, whole, cut, shard_1, shard_2): what is drawn of each block.

    ``passes`` is how often all of the source is taken, ``whole`` whether the last, partial pass
    takes this block too, ``cut`` the words that it takes of the one block at its end. A shard is
    where the block's first or second copy goes, null if there is none.
    """
    by_block = dealt.groupBy("source", "block").agg(
        F.sum("size").alias("words"), F.first("target").alias("target"),
        F.first("source_size").alias("source_size"), F.first("place").alias("place"),
    )
    along = Window.partitionBy("place").orderBy("turn", "block")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
    spread = (
        by_block.withColumn("turn", F.xxhash64(F.lit(seed + 2), "place", "block"))
        .withColumn("passes", F.least(F.coalesce(passes, F.lit(0)), F.lit(int(MOST))).cast("long"))
        .withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
        .withColumn(
            "before",
            F.coalesce(F.sum("words").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        )
    )
    inside = F.col("before") + F.col("words") <= F.col("rest")
    spread = spread.withColumn("whole", inside & (F.col("rest") > 0)).withColumn(
        "cut", F.when(~inside & (F.col("before") < F.col("rest")), F.col("rest") - F.col("before"))
    )
    units = F.col("passes") + (F.col("whole") | F.col("cut").isNotNull()).cast("long")
    # Draws of a source, second copies among first ones, are numbered in a permuted order.
    numbered = Window.partitionBy("place").orderBy(F.xxhash64(F.lit(seed + 5), "place", "block", "copy"), "block", "copy")
    drawn = spread.select(
        "place", "block", "turn",
        F.explode(F.when(units > 0, F.sequence(F.lit(1).cast("long"), units))).alias("copy"),
    ).withColumn("number", F.row_number().over(numbered).cast("long"))
    split = split_quotas(drawn.groupBy("place").agg(F.count(F.lit(1)).alias("n")), levels, seed)
    # Shard by shard, each takes the next numbers of a source.
    end = F.sum("n").over(Window.partitionBy("place").orderBy("shard"))
    dealt_out = split.withColumn("end", end).where("n > 0").select(
        "place", "shard",
        F.explode(F.sequence(F.col("end") - F.col("n") + 1, F.col("end"))).alias("number"),
    )
    shard_of = lambda copy: F.max(F.when(F.col("copy") == copy, F.col("shard")))
    copies = drawn.join(dealt_out, ["place", "number"]).groupBy("place", "block").agg(
        shard_of(1).alias("shard_1"), shard_of(2).alias("shard_2")
    )
    return spread.select("source", "place", "block", "passes", "whole", "cut").join(
        copies, ["place", "block"], "left"
    )


def taken_words(documents: DataFrame, levels: int = LEVELS, seed: int = SEED) -> DataFrame:
    """What the mix takes of each row: doc_id, source, size, source_size, target, taken, shards.

    Sizes are words between blanks, 0 for a null text; a null source is a source of its own, after
    the others. Whole documents are taken: those of whole blocks, those of the cut block in drawn
    order while they fit, and per source the one other document that comes closest to what is then
    missing, if that is closer than none. Rows that share source and id are drawn together.
    ``shard_1`` and ``shard_2`` say where a document's copies go. Documents without words have
    nothing to take. A source without words has target 0. No rows give no rows.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    # Three narrow columns: texts are read and counted once.
    sized = stage(documents.select("doc_id", "source", size.alias("size")), "mix-sizes")
    # Staged so that Spark knows their sizes and broadcasts them only if they are small.
    sources = stage(source_targets(sized), "mix-sources")
    dealt = sized.alias("d").join(
        sources.alias("s"), F.expr("d.source <=> s.source")
    ).select(
        "d.doc_id", "d.source", "d.size", "s.source_size", "s.target", "s.place",
        F.xxhash64(F.lit(seed), "d.doc_id").alias("draw"),
        F.pmod(F.xxhash64(F.lit(seed + 1), "d.doc_id"), F.col("s.n_blocks")).cast("int").alias("block"),
    )
    blocks = stage(block_plan(dealt, levels, seed), "mix-blocks").drop("source")
    placed = dealt.join(blocks, ["place", "block"])
    # The cut block holds one part in BLOCKS of its source.
    in_order = Window.partitionBy("place").orderBy("draw", "doc_id").rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    ids = placed.where("cut is not null").withColumn("upto", F.sum("size").over(in_order))
    fits = ids.where("upto <= cut")
    last_taken = fits.groupBy("place").agg(
        F.max(F.struct("draw", "doc_id", "upto")).alias("edge")
    )
    edges = stage(
        placed.where("cut is not null").select("place", "block", "cut").distinct()
        .join(last_taken, "place", "left")
        .select("place", "cut", F.col("block").alias("cut_block"), "edge"),
        "mix-edges",
    )
    missing = F.col("cut") - F.coalesce(F.col("edge.upto"), F.lit(0))
    key = F.struct("draw", "doc_id")
    in_cut = F.col("block") == F.col("cut_block")
    taken_in_cut = in_cut & F.coalesce(key <= F.struct("edge.draw", "edge.doc_id"), F.lit(False))
    marked = placed.drop("cut").join(edges, "place", "left").withColumn(
        "part", F.coalesce(F.col("whole"), F.lit(False)) | F.coalesce(taken_in_cut, F.lit(False))
    ).withColumn("missing", missing)
    closest = stage(
        marked.where("not part and missing is not null and size > 0")
        .groupBy("place")
        .agg(F.min(F.struct(F.abs(F.col("size") - F.col("missing")).alias("gap"), "draw", "doc_id", "size", "missing")).alias("c"))
        .where("c.gap < c.missing")
        .select("place", F.col("c.doc_id").alias("last_id"), F.col("c.size").alias("last_size")),
        "mix-last",
    )
    picked = marked.join(closest, "place", "left").withColumn(
        "once_more",
        F.col("part")
        | F.coalesce(F.col("doc_id").eqNullSafe(F.col("last_id")) & (F.col("size") == F.col("last_size")), F.lit(False)),
    ).withColumn("copies", F.col("passes") + F.col("once_more").cast("long"))
    # A document picked from a block that was not drawn goes where its draw points.
    any_shard = F.pmod(F.col("draw"), F.lit(2**levels))
    return picked.select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("size") * F.col("copies")).alias("taken"), "copies",
        F.when(F.col("copies") >= 1, F.coalesce("shard_1", any_shard)).alias("shard_1"),
        F.when(F.col("copies") >= 2, F.coalesce("shard_2", any_shard)).alias("shard_2"),
    )


def mix(documents: DataFrame, levels: int = LEVELS, seed: int = SEED) -> DataFrame:
    """The mixed documents: every copy taken is a row with the columns of ``documents``.

    A document taken twice gives two rows. Rows are grouped by output shard and permuted inside it.
    Repeated rows of one id take the copies of their id; rows with a null id are matched by it too.
    """
    plan = taken_words(documents, levels, seed).where("copies > 0").groupBy("doc_id", "source", "size").agg(
        F.max("shard_1").alias("shard_1"), F.max("shard_2").alias("shard_2")
    )
    names = [fresh(f"mix_{name}", documents.columns) for name in ("id", "source", "size", "shards", "shard")]
    n_id, n_source, n_size, n_shards, n_shard = names
    plan = plan.select(
        F.col("doc_id").alias(n_id), F.col("source").alias(n_source), F.col("size").alias(n_size),
        F.array_compact(F.array("shard_1", "shard_2")).alias(n_shards),
    )
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    copies = documents.join(
        plan,
        F.col("doc_id").eqNullSafe(F.col(n_id)) & F.col("source").eqNullSafe(F.col(n_source)) & (size == F.col(n_size)),
    ).select(*documents.columns, F.posexplode(n_shards).alias(n_size, n_shard))
    return (
        copies.repartition(F.col(n_shard), F.pmod(F.xxhash64(F.lit(seed + 3), "doc_id"), F.lit(64)))
        .sortWithinPartitions(n_shard, F.xxhash64(F.lit(seed + 4), "doc_id", n_size))
        .select(*documents.columns)
    )
