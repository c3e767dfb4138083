import random
from contextlib import contextmanager

import models
from mailframe.operators import dedupe
from mailframe.operators.dedupe import dedupe_two_keys, first_per_key


def kept(spark, rows, unique_a=False):
    df = spark.createDataFrame(rows, "o long, a string, b string")
    out = dedupe_two_keys(df, ["o"], ["a"], ["b"], unique_a)
    assert out.columns == ["o", "a", "b"]
    return sorted(tuple(r) for r in out.collect())


def test_losers_do_not_block(spark):
    assert kept(spark, [(1, "u1", "m1"), (2, "u2", "m1"), (3, "u2", "m2")]) == [
        (1, "u1", "m1"), (3, "u2", "m2"),
    ]


def test_rows_without_second_key_stay(spark):
    rows = [(1, "u1", None), (2, "u2", None), (3, "u3", "m"), (4, "u4", "m"), (5, "u1", "x")]
    assert kept(spark, rows) == [(1, "u1", None), (2, "u2", None), (3, "u3", "m")]
    assert kept(spark, rows[:4], unique_a=True) == [(1, "u1", None), (2, "u2", None), (3, "u3", "m")]


def test_exact_repeats_are_stored_once(spark):
    rows = [(1, "u1", "m1")] * 3 + [(2, None, None)] * 2
    assert kept(spark, rows) == [(1, "u1", "m1"), (2, None, None), (2, None, None)]


def test_random_batches_equal_sequential_insert(spark):
    rnd = random.Random(5)
    for size, keys in ((60, 8), (200, 40), (300, 200)):
        def key(prefix):
            return None if rnd.random() < 0.1 else f"{prefix}{rnd.randrange(keys)}"
        rows = [(i, key("u"), key("m")) for i in range(size)]
        assert kept(spark, rows) == sorted(models.first_wins(rows), key=lambda r: r[0])


def test_hot_key_and_long_chain(spark):
    hot = [(i, f"u{i}", "m" if i % 3 else f"m{i}") for i in range(3000)]
    assert kept(spark, hot) == sorted(models.first_wins(hot))
    chain = [(i, f"u{i // 2}", f"m{(i + 1) // 2}") for i in range(9)]
    assert kept(spark, chain) == sorted(models.first_wins(chain))


def test_group_limit_runs_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id as o", "cast(id % 7 as string) as b")
    plan = first_per_key(df, ["b"], ["o"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def count_tables(monkeypatch):
    """Names of the tables that two-key dedupe writes from now on."""
    written = []
    real = dedupe.scratch

    @contextmanager
    def counted(spark, name):
        with real(spark, name) as keep:
            def note(df, label):
                written.append(label)
                return keep(df, label)

            yield note

    monkeypatch.setattr(dedupe, "scratch", counted)
    return written


def test_a_long_chain_takes_a_logarithm_of_rounds(spark, monkeypatch):
    written = count_tables(monkeypatch)
    chain = [(i, f"u{(i + 1) // 2}", f"m{i // 2}") for i in range(1000)]
    assert kept(spark, chain) == [row for row in chain if row[0] % 2 == 0]
    assert len(written) <= 12


def test_chains_in_any_order_and_rings(spark):
    rnd = random.Random(9)
    rows, start = [], 0
    for length in (1, 2, 3, 7, 40, 65):
        orders = rnd.sample(range(start, start + length), length)
        ring = length > 3 and length % 2 == 0
        for i, order in enumerate(orders):
            rows.append((order, f"u{start + (i + 1) // 2}", f"m{start + (i % (length if ring else 10**6)) // 2}"))
        start += length
    assert kept(spark, rows) == models.first_wins(rows)


def test_hot_end_of_many_paths(spark):
    # Many paths that all end at rows of one message id, and rows with several blockers.
    rows = [(i, f"a{i}", "hot") for i in range(40)]
    rows += [(100 + i, f"a{i}", f"b{i}") for i in range(40)] + [(200 + i, f"c{i}", f"b{i}") for i in range(40)]
    rows += [(300 + i, f"c{i}", f"b{(i + 1) % 40}") for i in range(40)]
    assert kept(spark, rows) == models.first_wins(rows)


def test_few_ids_of_very_many_rows_take_few_rounds(spark, monkeypatch):
    """Every id has far more rows than can be kept, and senders come back all the time."""
    written = count_tables(monkeypatch)
    rnd = random.Random(3)
    rows = [(i, f"u{rnd.randrange(400)}", f"m{i // 200}-{int(rnd.expovariate(0.2))}") for i in range(6000)]
    assert kept(spark, rows) == sorted(models.first_wins(rows))
    assert len(written) <= 30


def test_rounds_move_numbers_for_rows(spark, monkeypatch):
    """Minima and joins of the rounds are of one number a row, not of its order and both keys; ties and nulls too."""
    types = []
    real = dedupe.scratch

    @contextmanager
    def noted(spark, name):
        with real(spark, name) as keep:
            def note(df, label):
                types.extend(t for c, t in df.dtypes if c in ("_o", "_to"))
                return keep(df, label)

            yield note

    monkeypatch.setattr(dedupe, "scratch", noted)
    rows = [(o, f"u{(i + 1) // 2}", f"m{i // 2}") for i, o in enumerate([5, None, 3, 3, 9, 1, 1, 4, 8, 7, 7, 2])] + [(3, None, "m0")] * 2
    ranks = {row: n for n, row in enumerate(sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "", r[2])))}
    taken = models.first_wins(sorted((ranks[row], row[1], row[2]) for row in rows))
    df = spark.createDataFrame(rows, "o long, a string, b string")
    got = sorted(ranks[tuple(r)] for r in dedupe_two_keys(df, ["o"], ["a"], ["b"]).collect())
    assert got == sorted(r[0] for r in taken)
    assert types and set(types) == {"bigint"}
