import json
import random

from pyspark.sql import functions as F

import models
from mailframe.functions.replies import with_lint, with_validation

GOOD = '{"summary":"The choir meets on Tuesday.","action_required":"none","deadline":null,"tone":"neutral"}'


def checked(spark, replies):
    df = spark.createDataFrame(list(enumerate(replies)), "i long, raw string")
    rows = with_validation(df, "raw", "v").collect()
    return [r.v for r in sorted(rows, key=lambda r: r.i)]


def reply(**change):
    base = {"summary": "s", "action_required": "reply", "deadline": "2027-02-14", "tone": "heated"}
    return json.dumps({**base, **change})


def test_reply_table(spark):
    cases = [
        (GOOD, None),
        (reply(), None),
        (reply(summary=""), "empty summary"),
        (reply(action_required="hurry"), "invalid action_required"),
        (reply(tone="cross"), "invalid tone"),
        (reply(deadline="14/02/2027"), "invalid deadline"),
        (reply(deadline="2025-02-30"), "invalid deadline"),
        (reply(deadline="2025-6-30"), "invalid deadline"),
        (reply(deadline=""), None),
        (reply(summary=3), "invalid JSON"),
        (reply(deadline=20270214), "invalid JSON"),
        (GOOD + " trailing", "invalid JSON"),
        (GOOD + "," + GOOD, "invalid JSON"),
        (GOOD + "]", "invalid JSON"),
        (GOOD + "}", "invalid JSON"),
        ("[" + GOOD + "]", "invalid JSON"),
        (GOOD.replace('"', "'"), "invalid JSON"),
        ("", "invalid JSON"),
        (None, "invalid JSON"),
        ("not json", "invalid JSON"),
        (reply(extra={"a": [1, 2]}), None),
        (GOOD.replace("summary", "SUMMARY"), None),
        ('{"summary":1,"summary":"s","action_required":"none","tone":"neutral"}', "invalid JSON"),
        ('{"summary":"s","summary":null,"action_required":"none","tone":"neutral"}', None),
        ('{"summary":"s","summary":"","action_required":"none","tone":"neutral"}', "empty summary"),
        ("  \n" + GOOD + "\n ", None),
    ]
    got = checked(spark, [raw for raw, _ in cases])
    assert [v.err for v in got] == [err for _, err in cases]
    assert got[0].text == "The choir meets on Tuesday." and got[0].deadline is None
    assert got[1].asDict() == {
        "text": "s", "action": "reply", "deadline": "2027-02-14", "tone": "heated",
        "status": "ok", "err": None,
    }
    assert got[2].status == "error" and got[2].text is None


def test_long_summary_is_cut(spark):
    (got,) = checked(spark, [reply(summary="é" * 250)])
    assert got.text == "é" * 200 and got.status == "ok"


def test_random_replies_equal_json_reader(spark):
    rnd = random.Random(3)
    keys = ["summary", "Summary", "action_required", "deadline", "tone", "TONE", "other"]
    values = ['"s"', '""', "null", "1", "true", '"none"', '"fyi"', '"neutral"', '"heated"',
              '"2024-02-29"', '"2023-02-29"', "{}", "[1]", "NaN", '"a\\"b"']
    likely = {"summary": '"s"', "action_required": '"none"', "deadline": "null", "tone": '"neutral"'}
    raws = []
    for _ in range(3000):
        pairs = list(likely.items())
        for _ in range(rnd.randint(0, 3)):
            pairs.insert(rnd.randint(0, len(pairs)), (rnd.choice(keys), rnd.choice(values)))
        if rnd.random() < 0.3:
            pairs.pop(rnd.randrange(len(pairs)))
        raw = "{" + ",".join(f'"{k}":{v}' for k, v in pairs) + "}"
        raws.append(rnd.choice(["", " ", "\n"]) + raw + rnd.choice(["", "", "", " ", "x", "{}", ",1"]))
    got = checked(spark, raws)
    wrong = [r for r, v in zip(raws, got) if (v.status == "ok") != models.reply_is_good(r)]
    assert wrong == []


def test_lint_order_and_wording(spark):
    rows = [
        ("fine", "ok", None, False, []),
        ("x" * 201, "ok", None, False, ["summary>200chars (201)"]),
        ("STOP! Elle exige ÉTÉ", "ok", None, True,
         ["affect-marker '!'", "ALL-CAPS run", "accusation verb", "note: source was truncated"]),
        ("réaccuse", "ok", None, False, ["accusation verb"]),
        ("reaccuse", "ok", None, False, []),
        ("BLAME", "ok", None, False, ["ALL-CAPS run", "accusation verb"]),
        ("could not summarize!", "error", "boom", True, ["llm-fallback: boom"]),
        ("", "error", None, False, ["llm-fallback: "]),
    ]
    df = spark.createDataFrame(
        [(i, *r[:4]) for i, r in enumerate(rows)],
        "i long, text string, status string, err string, truncated boolean",
    )
    got = with_lint(df, "text", "status", "err", "truncated", "w").collect()
    assert [r.w for r in sorted(got, key=lambda r: r.i)] == [r[4] for r in rows]
