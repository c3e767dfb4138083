from datetime import datetime

from pyspark.sql import functions as F

from mailframe import schemas
from mailframe.operators import incremental as inc
from mailframe.operators import scope

KEYS = "mailbox string, uid_validity long, uid long, message_id string"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_baseline_cases(spark):
    state = spark.createDataFrame(
        [("new", 8, 635), ("moved", 8, 40), ("same", 8, 104), ("empty", 8, 0), ("zero", 9, 10)],
        schemas.MAILBOX_STATE,
    )
    cursors = spark.createDataFrame(
        [("moved", 7, 99), ("same", 8, 100), ("zero", 0, 0)], schemas.CURSORS
    )
    got = rows(inc.baseline(state, cursors), "mailbox", "uid_validity", "last_uid", "initialized")
    assert got == [
        ("empty", 8, 0, True), ("moved", 8, 39, True), ("new", 8, 634, True),
        ("same", 8, 100, False), ("zero", 9, 9, True),
    ]


def test_new_since_cursor(spark):
    raw = spark.createDataFrame(
        [("a", 8, u, None) for u in (99, 100, 101, 103)]
        + [("a", 7, 500, None), ("b", 8, 5, None), ("c", 1, 4294967295, None)],
        schemas.RAW_MAIL,
    )
    cursors = spark.createDataFrame(
        [("a", 8, 100), ("b", 7, 1), ("c", 1, 4294967295)], schemas.CURSORS
    )
    assert rows(inc.new_since(raw, cursors), "mailbox", "uid") == [("a", 101), ("a", 103)]
    state = spark.createDataFrame([("a", 9, 1)], schemas.MAILBOX_STATE)
    assert rows(inc.new_since(raw, cursors, state), "uid") == []


def test_lowest_cursor_bounds_the_scan(spark, tmp_path):
    path = str(tmp_path / "raw")
    spark.range(100).selectExpr(
        "if(id < 50, 'a', 'b') mailbox", "1L uid_validity", "id uid", "cast(cast(id as string) as binary) raw"
    ).write.parquet(path)
    raw = spark.read.parquet(path)
    cursors = spark.createDataFrame([("a", 1, 40), ("b", 1, 90)], schemas.CURSORS)
    new = inc.new_since(raw, cursors)
    assert rows(new, "uid") == [(u,) for u in [*range(41, 50), *range(91, 100)]]
    assert "scalar-subquery" in new._jdf.queryExecution().optimizedPlan().toString()
    nothing = spark.createDataFrame([], schemas.CURSORS)
    assert inc.new_since(raw, nothing).count() == 0


def test_late_moves_never_lower_a_cursor_or_its_epoch(spark):
    cursors = spark.createDataFrame([("a", 8, 100), ("b", 8, 100)], schemas.CURSORS)
    late = spark.createDataFrame(
        [("a", 7, 5), ("b", 8, 60), ("c", 3, 4), ("c", 2, 9)], schemas.CURSORS
    )
    got = inc.advance_cursors(cursors, None, late)
    want = [("a", 8, 100), ("b", 8, 100), ("c", 3, 4)]
    assert rows(got, "mailbox", "uid_validity", "last_uid") == want
    reset = spark.createDataFrame([("a", 9, 3)], schemas.CURSORS)
    after = spark.createDataFrame([("a", 8, 200), ("a", 9, 7)], schemas.CURSORS)
    got = inc.advance_cursors(cursors, reset, after)
    assert rows(got, "mailbox", "uid_validity", "last_uid") == [("a", 9, 7), ("b", 8, 100)]


def test_cursor_moves(spark):
    cursors = spark.createDataFrame([("a", 7, 99), ("b", 1, 5)], schemas.CURSORS)
    resets = spark.createDataFrame([("a", 8, 39)], schemas.CURSORS)
    batch = spark.createDataFrame([("b", 1, 6, None), ("b", 1, 9, "m")], KEYS)
    got = inc.advance_cursors(cursors, resets, inc.batch_moves(batch))
    assert rows(got, "mailbox", "uid_validity", "last_uid") == [("a", 8, 39), ("b", 1, 9)]


def test_known_by_either_key(spark):
    stored = spark.createDataFrame([("a", 1, 1, "m1"), ("a", 1, 2, None)], KEYS)
    batch = spark.createDataFrame(
        [
            ("a", 1, 1, "other"), ("a", 1, 3, "m1"), ("a", 1, 2, None), ("a", 1, 4, None),
            ("a", 1, 5, ""), ("a", 2, 1, "m9"), ("b", 1, 7, "m1"),
        ],
        KEYS,
    )
    got = rows(inc.unknown_only(batch, stored), "mailbox", "uid_validity", "uid")
    assert got == [("a", 1, 4), ("a", 1, 5), ("a", 2, 1), ("b", 1, 7)]


def test_insert_absent_uses_both_paths(spark):
    stored = spark.createDataFrame([("a", 1, 1, "m1")], KEYS)
    batch = spark.createDataFrame(
        [("a", 1, 2, "m2"), ("a", 1, 3, "m2"), ("a", 1, 3, "m3"), ("a", 1, 4, None),
         ("a", 1, 5, None), ("a", 1, 1, "m4")],
        KEYS,
    )
    assert not inc.uids_are_unique(batch)
    got = rows(inc.insert_absent(batch, stored), "uid", "message_id")
    assert sorted(got, key=str) == sorted([(2, "m2"), (3, "m3"), (4, None), (5, None)], key=str)
    single = batch.where("not (uid = 3 and message_id = 'm3')")
    assert inc.uids_are_unique(single)
    for unique in (True, False):
        got = inc.insert_absent(single, stored, unique)
        assert sorted(r.uid for r in got.collect()) == [2, 4, 5]


def test_known_test_has_no_nested_loop(spark):
    batch = spark.range(100).selectExpr(
        "'a' mailbox", "1L uid_validity", "id uid", "cast(id as string) message_id"
    )
    plan = inc.unknown_only(batch, batch)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_scope_flag_list_and_table(spark):
    df = spark.createDataFrame(
        [(1, " Desk@Lending.EXAMPLE "), (2, "x@y"), (3, None)], "i long, from_addr string"
    )
    listed = scope.split_allowlist(" desk@lending.example , ,B@c.d")
    assert listed == ["desk@lending.example", "b@c.d"]
    table = spark.createDataFrame([("desk@LENDING.example ",), ("",), (None,)], "entry string")
    blank = spark.createDataFrame([("",), ("  ",)], "entry string")
    for allow, want in (
        (listed, [True, False, False]), (table, [True, False, False]),
        ([], [True] * 3), (None, [True] * 3), ([" "], [True] * 3), (blank, [True] * 3),
    ):
        got = scope.flag_scope(df, allow).orderBy("i").collect()
        assert [r.in_scope for r in got] == want


def test_outcomes_and_counts(spark):
    schema = (
        "i long, mailbox string, parse_error string, in_scope boolean, is_duplicate boolean, "
        "model struct<text:string,action:string,deadline:string,tone:string,status:string,err:string>"
    )
    ok = ("s", "reply", "2025-01-01", "heated", "ok", None)
    bad = ("could not summarize", None, None, None, "error", "boom")
    df = spark.createDataFrame(
        [
            (1, "a", "broken", False, False, None), (2, "a", None, False, False, None),
            (3, "a", None, True, False, ok), (4, "a", None, True, False, bad),
            (5, "a", None, True, True, bad), (6, "b", None, False, True, None),
        ],
        schema,
    )
    out = scope.route_outcome(df)
    got = [tuple(r) for r in out.orderBy("i").select(
        "summary", "action_req", "deadline", "tone", "in_scope", "llm_status", "llm_error"
    ).collect()]
    assert got[:4] == [
        ("could not summarize - read original", None, None, None, True, "error",
         "parse message: broken"),
        ("out of scope - not summarized", "none", None, "neutral", False, "ok", None),
        ("s", "reply", "2025-01-01", "heated", True, "ok", None),
        ("could not summarize", None, None, None, True, "error", "boom"),
    ]
    counts = rows(scope.poll_counts(out), "mailbox", "fetched", "processed", "duplicates",
                  "errors", "out_of_scope")
    assert counts == [("a", 5, 4, 1, 2, 1), ("b", 1, 0, 1, 0, 0)]
    batch = scope.batch_counts(out, out.where("not is_duplicate"))
    assert rows(batch, "mailbox", "fetched", "processed", "duplicates", "errors",
                "out_of_scope") == counts
