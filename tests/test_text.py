import random

import pytest
import models
from mailframe.functions import text as tx


def column_of(spark, values, expr, name="c"):
    rows = list(enumerate(values))
    df = spark.createDataFrame(rows, "i long, c string")
    got = df.select("i", expr.alias("out")).collect()
    return [r.out for r in sorted(got, key=lambda r: r.i)]


def random_bodies(n, seed):
    rnd = random.Random(seed)
    bits = [
        "> quoted", ">", "--", "-- ", "--\t", "---", "On Mon, Board wrote:", "on x wrote: ",
        "On wrote:", "Le 1 juin, A a écrit :", "LE 2 a ecrit:", "Le a écrit:", "hello  there",
        "\ttabs\t", "", "", "  ", " pad ", "\x0b", "é–ü 中文 🎉", " > not quoted", "x\r",
    ]
    return ["\n".join(rnd.choice(bits) for _ in range(rnd.randint(0, 9))) for _ in range(n)]


def test_whitespace_and_quotes_equal_line_model(spark):
    bodies = random_bodies(6000, 7)
    assert column_of(spark, bodies, tx.normalize_whitespace("c")) == [
        models.normalize(b) for b in bodies
    ]
    assert column_of(spark, bodies, tx.strip_quoted("c")) == [
        models.strip_quotes(b) for b in bodies
    ]
    df = spark.createDataFrame(list(enumerate(bodies)), "i long, text string")
    cleaned = sorted(tx.with_clean_body(df, html=None, limit=0).collect(), key=lambda r: r.i)
    assert [r.body_text for r in cleaned] == [
        models.strip_quotes(models.normalize(b)) for b in bodies
    ]


@pytest.mark.parametrize(
    "body,kept,dropped",
    [
        ("Hello world.\nThis is a plain message.", ["Hello world.", "plain message"], []),
        (
            "My reply here.\n\nOn Mon, 1 Jun 2025, Board wrote:\n> line 1\n> line 2",
            ["My reply here."],
            ["line 1", "wrote"],
        ),
        (
            "Ma réponse ici.\n\nLe 1 juin 2025, Syndicat <b@c.tld> a écrit :\n> Texte original",
            ["Ma réponse ici."],
            ["Texte original", "écrit"],
        ),
        ("Main content here.\n\n--\nSignature block", ["Main content here."], ["Signature"]),
        (
            "First response.\n\nOn Jun 1, Board wrote:\n> Quoted text\n\nSecond response.",
            ["First response.", "Second response."],
            ["Quoted text"],
        ),
        (
            "On June 1, someone wrote a new proposal:\nThe proposal content here.",
            ["On June 1, someone wrote a new proposal:", "The proposal content here."],
            [],
        ),
        ("Content.\n\nOn 2024-01-15 12:00, Sender wrote:\n\n> Quoted", ["Content."], ["Quoted"]),
    ],
)
def test_quote_table(spark, body, kept, dropped):
    (out,) = column_of(spark, [body], tx.strip_quoted("c"))
    assert all(part in out for part in kept)
    assert not any(part in out for part in dropped)


def test_strip_html_rules(spark):
    cases = {
        "<p>a</p><br/>b": "\na\nb",
        "x<script>var t='</p>';</script>y": "x y",
        "x<STYLE a='1'>p{}</Style>y<pre>z</pre>": "x y\nz",
        "<h7>t</h7><h2>u": "t\nu",
        "a &amp;lt; b &lt;i&gt; &quot;q&quot; &#39;&nbsp;&mdash;&ndash;&laquo;&raquo;": (
            "a &lt; b <i> \"q\" ' —–«»"
        ),
        "open <b never closed": "open <b never closed",
        "a <script>one</script> b <script>no end > c": "a   b no end > c",
        "1 < 2 and 3 > 2": "1  2",
        "<>empty<>": "<>empty<>",
        "": "",
    }
    assert column_of(spark, list(cases), tx.strip_html("c")) == list(cases.values())


def test_scripts_equal_plain_substitution(spark):
    import re

    rnd = random.Random(3)
    bits = ["<script", "<style>", "<script a=1>", "</script>", "</STYLE>", ">", "<", "<b>", "x", "é🎉", "\n", "</script"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 12))) for _ in range(3000)]
    want = [re.sub(r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ", t) for t in texts]
    assert column_of(spark, texts, tx._drop_scripts(tx.F.col("c"))) == want


def test_unclosed_openers_before_one_closer_stay_linear(spark):
    import time

    for opener in ("<script ", "<style>", "<p ", "<"):
        text = opener * (1_000_000 // len(opener)) + "</script>"
        start = time.perf_counter()
        column_of(spark, [text], tx.strip_html("c"))
        assert time.perf_counter() - start < 15


def test_long_unclosed_markup_stays_linear(spark):
    hostile = ["<" * 300_000, "<p" * 150_000, "<script>" * 40_000, "a" + "\u00a0" * 200_000 + "b"]
    df = spark.createDataFrame([(i, "", h) for i, h in enumerate(hostile)], "i long, text string, html string")
    cleaned = tx.with_clean_body(df, limit=0).orderBy("i").collect()
    out = [r.body_text for r in cleaned]
    assert out[0] == hostile[0] and out[1] == hostile[1]
    assert out[2] == "" and out[3] == hostile[3]


def test_truncation_counts_code_points(spark):
    df = spark.createDataFrame([("é🎉" * 10,), ("short",), ("",)], "text string")
    cut = tx.with_clean_body(df, html=None, limit=19).collect()
    assert [(len(r.body_text), r.truncated) for r in cut] == [(19, True), (5, False), (0, False)]
    whole = tx.with_clean_body(df, html=None, limit=0).collect()
    assert [(len(r.body_text), r.truncated) for r in whole] == [(20, False), (5, False), (0, False)]


def test_html_is_used_only_without_text(spark):
    df = spark.createDataFrame([("plain", "<p>m</p>"), ("", "<p>m</p>"), (None, None)], "text string, html string")
    assert [r.body_text for r in tx.with_clean_body(df).collect()] == ["plain", "m", ""]


def test_names_and_addresses(spark):
    ids = ["<message/id@example.test>", " \t<..a b..>", "", "<>", "é🎉x", "a" * 130, "..."]
    assert column_of(spark, ids, tx.safe_name("c")) == [
        "message_id_example.test", "a_b", None, None, "__x", "a" * 120, None,
    ]
    df = spark.createDataFrame([("Board", "b@x"), ("", "b@x"), (None, None)], "n string, a string")
    out = [r[0] for r in df.select(tx.format_address("n", "a")).collect()]
    assert out == ["Board <b@x>", "b@x", ""]
