"""First-wins deduplication by one key, and by two keys at once."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailframe.session import scratch, stage

Staging = Callable[[DataFrame, str], DataFrame]


def _any_null(columns: list[str]) -> Column:
    return reduce(lambda x, y: x | y, [F.col(c).isNull() for c in columns])


def first_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of every ``key`` by ``order``; rows with a NULL in the key all stay.

    Filtering ``row_number() = 1`` lets Spark keep one row per key and task *before* the shuffle,
    so a key that holds a third of the rows costs one row per task. Rows without a key are groups
    of their own, spread by their order columns instead of meeting in one task; ``order`` has to
    identify a row.
    """
    own_group = F.when(_any_null(key), F.struct(*order))
    first = Window.partitionBy(*key, own_group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def _key_struct(columns: list[str]) -> Column:
    return F.when(~_any_null(columns), F.struct(*columns))


def _ranked(bound: DataFrame, keep: Staging) -> DataFrame:
    """Rows with their keys and ``_o``, a number in their order.

    Minima and joins of the rounds take a number in place of a struct of the order and both keys. Rows
    are sorted over all tasks; numbers rise within a task and from task to task.
    """
    rows = bound.select("_row", "_a", "_b").orderBy("_row")
    return keep(rows.select(F.monotonically_increasing_id().alias("_o"), "_row", "_a", "_b"), "ranked")


def _least(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("_o").alias(name))


def _caps(rows: DataFrame, key: str, other: str) -> DataFrame:
    """For each ``other`` key the order by which it is certainly taken.

    The first row of a ``key`` is kept unless its ``other`` key is taken even earlier; a row without
    a ``key`` is the first of its own.
    """
    first = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct("_o", other)).alias("_first"))
    leads = first.select("_first._o", f"_first.{other}").unionByName(rows.where(F.col(key).isNull()).select("_o", other))
    return _least(leads, other, f"_c{other}")


def _prune(rows: DataFrame) -> DataFrame:
    """Drop rows that come after one of their keys is certainly taken.

    Only aggregates that Spark combines before the shuffle: a key with very many rows shrinks to
    one row per task, and where one key has few values the caps are small and broadcast.
    """
    for key, other in (("_a", "_b"), ("_b", "_a")):
        cap = f"_c{other}"
        rows = rows.join(_caps(rows, key, other), other, "left").where(F.col(cap).isNull() | (F.col("_o") <= F.col(cap)))
        rows = rows.select("_o", "_a", "_b")
    return rows


def _pruned(rows: DataFrame, keep: Staging) -> tuple[DataFrame, int]:
    """``rows`` pruned as long as that drops a tenth of them, and how many are left."""
    before, left = 0, rows.count()
    while left and (not before or 10 * left < 9 * before):
        rows = keep(_prune(rows), "pruned")
        before, left = left, rows.count()
    return rows, left


def _without(rows: DataFrame, won: DataFrame) -> DataFrame:
    """The rows that share no key with a kept one."""
    return (
        rows.join(won.select("_a"), "_a", "left_anti")
        .join(won.select("_b"), "_b", "left_anti")
        .select("_o", "_a", "_b")
    )


def _blockers(undecided: DataFrame) -> DataFrame:
    """Every row with what is earlier in its groups: ``_to`` if that is one row, ``_many`` if more.

    The two smallest orders of a key are aggregates that Spark combines before the shuffle; no
    group is sorted. A row without either leads both of its groups.
    """
    rows = undecided
    for key in ("_a", "_b"):
        least, second = f"_m{key}", f"_s{key}"
        rows = rows.join(_least(undecided, key, least), key, "left")
        after = rows.where(F.col("_o") > F.col(least)).select("_o", key)
        rows = rows.join(_least(after, key, second), key, "left")
    ahead = {}
    for key in ("_a", "_b"):
        least, second = F.col(f"_m{key}"), F.col(f"_s{key}")
        ahead[key] = F.when(F.col(key).isNull() | (F.col("_o") == least), 0).when(F.col("_o") == second, 1).otherwise(2)
    several = ahead["_a"] + ahead["_b"] > 1
    one = F.when(ahead["_a"] == 1, F.col("_m_a")).when(ahead["_b"] == 1, F.col("_m_b"))
    return rows.select("_o", "_a", "_b", F.when(~several, one).alias("_to"), several.alias("_many"))


def _jump(steps: DataFrame) -> DataFrame:
    """Every row under way goes on by what the row that it has reached has gone."""
    open_ = steps.where("_many is null")
    further = steps.select(*(F.col(c).alias(f"_n{c}") for c in steps.columns))
    moved = open_.join(further, F.col("_to") == F.col("_n_o")).select(
        "_o", F.col("_n_to").alias("_to"), (F.col("_odd") != F.col("_n_odd")).alias("_odd"), F.col("_n_many").alias("_many")
    )
    return steps.where("_many is not null").unionByName(moved)


def _follow(blocked: DataFrame, keep: Staging) -> DataFrame:
    """Rows with one blocker, followed to the end of their path: (_o, _many, _odd).

    Such a row is kept if its blocker is not, so that along a path of them the number of steps
    decides. Every round doubles the steps of all rows twice (pointer jumping), and a row stops at the
    first row that leads (``_many`` false) or has several blockers (true). Only rows under way are
    joined: no two or more of them meet at one end, where all rows of a path would be one hot key.
    """
    ends = blocked.where("_to is null").select(F.col("_o").alias("_end"), F.col("_many").alias("_stop"))
    steps = blocked.where("_to is not null").select("_o", "_to").join(ends, F.col("_to") == F.col("_end"), "left")
    steps = keep(steps.select("_o", "_to", F.lit(True).alias("_odd"), F.col("_stop").alias("_many")), "steps")
    while not steps.where("_many is null").isEmpty():
        steps = keep(_jump(_jump(steps)), "steps")
    return steps.select("_o", "_many", "_odd")


def _matching_rounds(rows: DataFrame, keep: Staging) -> DataFrame:
    """Orders of the rows that a sequential first-wins insert would keep.

    Rows behind a certain loss of a key are pruned first, which decides most where keys have many
    rows. What is left is decided by whole paths: rows with a single blocker follow it to the path's
    end, in rounds that quadruple their steps. Only rows with several blockers, and paths that end at
    one, wait for the next turn. Every round is one written table, so that lost executors cost one
    round and plans stay short.
    """
    kept = []
    undecided, left = _pruned(rows, keep)
    # Repeats of one (a, b) pair: a key once taken stays taken, so only the first can be kept.
    undecided = undecided.groupBy("_a", "_b").agg(F.min("_o").alias("_o")).select("_o", "_a", "_b")
    while left:
        blocked = keep(_blockers(undecided), "blockers")
        ended = _follow(blocked, keep).withColumnsRenamed({"_many": "_stopped"})
        decided = keep(
            blocked.join(ended, "_o", "left").select(
                "_o", "_a", "_b",
                F.when(F.col("_to").isNull(), ~F.col("_many")).otherwise(~F.col("_stopped") & ~F.col("_odd")).alias("_won"),
                F.when(F.col("_to").isNull(), F.col("_many")).otherwise(F.col("_stopped")).alias("_waits"),
            ),
            "decided",
        )
        won = decided.where("_won")
        kept.append(won.select("_o"))
        undecided, left = _pruned(_without(decided.where("_waits"), won), keep)
    return reduce(DataFrame.unionByName, kept) if kept else undecided.select("_o")


def dedupe_two_keys(
    df: DataFrame,
    order: list[str],
    key_a: list[str],
    key_b: list[str],
    unique_a: bool = False,
) -> DataFrame:
    """Keep what inserting rows in ``order`` under two unique constraints would keep.

    A dropped row does not block later rows, so this is a greedy matching of the two keys and not
    two passes of row_number. A NULL key blocks nothing. With ``unique_a`` the caller states that
    no ``key_a`` repeats (the normal case for uids), and one window over ``key_b`` is enough.
    """
    if unique_a:
        return first_per_key(df, key_b, order)
    columns = df.columns
    parts = [F.col(c).alias(f"f{i}") for i, c in enumerate([*order, *key_a, *key_b])]
    keyed = (
        df.withColumn("_a", _key_struct(key_a))
        .withColumn("_b", _key_struct(key_b))
        .withColumn("_row", F.struct(*parts))
    )
    bound = keyed.where("_a is not null or _b is not null")
    free = keyed.where("_a is null and _b is null")
    with scratch(df.sparkSession, "dedupe") as keep:
        ranked = _ranked(bound, keep)
        kept = _matching_rounds(ranked.select("_o", "_a", "_b"), keep)
        kept = stage(ranked.join(kept, "_o", "left_semi").select("_row"), "dedupe-kept")
    chosen = first_per_key(bound.join(kept, "_row", "left_semi"), ["_row"], ["_row"])
    return chosen.select(*columns).unionByName(free.select(*columns))
