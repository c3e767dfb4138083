"""Connected groups of items that share buckets, without pairing all members of a bucket.

Candidates are pairs of items in one bucket. A first round tests each item only against the most
central item of each of its buckets, the one whose buckets are fullest: of a text and its many
edited copies that is the text itself. What is confirmed joins components. Then only buckets that
still hold more than one component are looked at, and the caller finds the links between the
components of such a family. So every possible link is either tested or already inside a component,
and none is lost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_staged, stage

Confirm = Callable[[DataFrame], DataFrame]
Across = Callable[[DataFrame], DataFrame]


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of (a, b) edges of longs.

    Alternates large-star and small-star steps: every neighbour above a node, then every one below
    it, is linked to the smallest one known, until nothing changes. Minima are combined before the
    shuffle, and a node with very many edges is only ever joined with its one minimum.
    """
    edges = stage(edges.where("a <> b").select("a", "b").distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.where("a <> b")
        # Every edge now goes from a node to a smaller one.
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        small = small.unionByName(low.withColumnRenamed("low", "b")).where("a <> b")
        done, edges = edges, stage(small.distinct(), "links")
        drop_staged(done)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def shared_buckets(buckets: DataFrame) -> DataFrame:
    """(bucket, node, weight), staged: rows of buckets of several rows, a node's weight being the sizes of its buckets."""
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sized = stage(buckets.join(sizes, "bucket"), "shared-buckets")
    weight = sized.groupBy("node").agg(F.sum("size").alias("weight"))
    shared = stage(sized.select("bucket", "node").join(weight, "node"), "shared-buckets")
    drop_staged(sized)
    return shared


def link(buckets: DataFrame, confirm: Confirm, across: Across) -> DataFrame:
    """(node, component) of all nodes with a link; ``buckets`` has (bucket, node), both long.

    ``confirm`` takes distinct pairs (a, b), a < b, and returns those that are links. ``across`` takes
    the rows (bucket, node, c) of buckets that hold several components c and returns links (a, b)
    that connect all components with a link between them. Buckets are
    never gathered: a bucket is known by its size, its centre and its smallest and largest component,
    aggregates that are combined before the shuffle, and joined back to its rows.
    """
    return link_shared(shared_buckets(buckets), confirm, across)


def link_shared(shared: DataFrame, confirm: Confirm, across: Across) -> DataFrame:
    """``link`` from the table of ``shared_buckets``, which is removed; so is every step's table once it has been read."""
    tested = stage(_stars(shared), "tested-pairs")
    links = stage(confirm(tested), "links")
    drop_staged(tested)
    found = stage(components(links), "components")
    left = stage(_mixed(shared, found), "mixed-buckets")
    drop_staged(shared, found)
    more = stage(across(left), "links")
    drop_staged(left)
    return components(links.unionByName(more))


def link_pairs(pairs: DataFrame, shared: DataFrame, confirm: Confirm, across: Across) -> DataFrame:
    """``link`` from candidates that are known as distinct pairs (a, b), a < b, and buckets that hold too many as ``shared``.

    Of the pairs, each item is tested first against the one of its partners that has most; the others
    only where they join two components. Both tables are removed, as every step's once it has been read.
    """
    ends = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degrees = ends.groupBy("a").agg(F.count(F.lit(1)).alias("degree")).select(F.col("a").alias("b"), "degree")
    best = F.max(F.struct("degree", (-F.col("b")).alias("b"))).alias("best")
    hubs = ends.join(degrees, "b").groupBy("a").agg(best).select("a", (-F.col("best.b")).alias("hub"))
    tested = stage(_pairs(hubs, "a", "hub").unionByName(_stars(shared)).distinct(), "tested-pairs")
    links = stage(confirm(tested), "links")
    found = stage(components(links), "components")
    of_a, of_b = (found.toDF(x, f"c_{x}") for x in "ab")
    rest = pairs.join(tested, ["a", "b"], "left_anti").join(of_a, "a", "left").join(of_b, "b", "left")
    rest = stage(rest.where("coalesce(c_a, a) <> coalesce(c_b, b)").select("a", "b"), "untested-pairs")
    drop_staged(tested, pairs)
    more = stage(confirm(rest), "links")
    drop_staged(rest)
    left = stage(_mixed(shared, found), "mixed-buckets")
    drop_staged(shared, found)
    links = links.unionByName(more).unionByName(stage(across(left), "links"))
    drop_staged(left)
    return components(links)


def _stars(shared: DataFrame) -> DataFrame:
    """Distinct pairs of each node and the most central one of each of its buckets."""
    centre = F.max(F.struct("weight", (-F.col("node")).alias("node"))).alias("centre")
    hubs = shared.groupBy("bucket").agg(centre).select("bucket", (-F.col("centre.node")).alias("hub"))
    return _pairs(shared.join(hubs, "bucket").where("node <> hub"), "node", "hub")


def _mixed(shared: DataFrame, found: DataFrame) -> DataFrame:
    """(bucket, node, c) of buckets of more than one component; of two items, the one pair has been tested."""
    placed = shared.join(found.withColumnRenamed("component", "c"), "node", "left").withColumn(
        "c", F.coalesce("c", "node")
    )
    mixed = placed.groupBy("bucket").agg(
        F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("size")
    ).where("low < high and size > 2")
    return placed.join(mixed.select("bucket"), "bucket").select("bucket", "node", "c")


def families(rows: DataFrame) -> DataFrame:
    """(node, family): nodes of (bucket, node) rows that a chain of common buckets connects."""
    first = rows.groupBy("bucket").agg(F.min("node").alias("b"))
    found = components(rows.join(first, "bucket").select(F.col("node").alias("a"), "b"))
    return found.select("node", F.col("component").alias("family"))


def tiles(nodes: DataFrame, size: int) -> DataFrame:
    """(family, i, j, node, part): every pair of tiles of a family, for blocked comparison.

    A family of (family, node) rows is dealt into tiles of about ``size`` nodes; each node goes to the
    pairs of its own tile, so that rows grow by the number of tiles, not of nodes. ``part`` is the
    node's tile.
    """
    counts = nodes.groupBy("family").agg(F.count(F.lit(1)).alias("size"))
    dealt = nodes.join(counts, "family").withColumn("n", F.ceil(F.col("size") / size).cast("int")).withColumn(
        "part", F.pmod(F.xxhash64("node"), F.col("n")).cast("int")
    )
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return other.select(
        "family", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "node", "part"
    )


def tiles_across(rows: DataFrame, size: int) -> DataFrame:
    """``tiles`` of (family, node, c) rows without the pairs of tiles that the largest component of a family fills.

    Its nodes have tiles of their own, the last ones, and go to the pairs with tiles of other nodes only.
    """
    parts = rows.groupBy("family", "c").agg(F.count(F.lit(1)).alias("n"))
    most = parts.groupBy("family").agg(F.max(F.struct("n", "c")).alias("most"), F.sum("n").alias("size")).select(
        "family", F.col("most.c").alias("main"), F.ceil(F.col("most.n") / size).cast("int").alias("n_main"),
        F.ceil((F.col("size") - F.col("most.n")) / size).cast("int").alias("n_rest"),
    )
    inside, spread = F.col("c") == F.col("main"), F.xxhash64("node")
    part = F.when(inside, F.col("n_rest") + F.pmod(spread, F.col("n_main"))).otherwise(F.pmod(spread, F.col("n_rest")))
    last = F.when(inside, F.col("n_rest")).otherwise(F.col("n_rest") + F.col("n_main")) - 1
    dealt = rows.join(most, "family").where("n_rest > 0").withColumn("part", part.cast("int"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return other.select(
        "family", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "node", "part"
    )


def _pairs(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Distinct (a, b), a < b, of two columns."""
    return rows.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()
