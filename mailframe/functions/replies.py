"""Checks on the model's JSON replies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailframe import fixed
from mailframe.functions.text import _col

# The reader's defaults are wider than JSON.
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def _is_one_value(raw: Column) -> Column:
    """Exactly one JSON value. Each wrapping alone lets some trailing text pass; both do not."""
    listed = F.json_array_length(F.concat(F.lit("["), raw, F.lit("]"))) == 1
    nested = F.from_json(
        F.concat(F.lit('{"w":'), raw, F.lit("}")), "map<string,string>", _STRICT
    ).isNotNull()
    return listed & nested


def _field_values(entries: Column, name: str) -> Column:
    """Every value given for ``name``; keys match in any letter case."""
    mine = F.filter(entries, lambda e: F.lower(F.upper(e["key"])) == name)
    return F.transform(mine, lambda e: e["value"])


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def _text_of(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _well_typed(values: Column) -> Column:
    return F.coalesce(
        F.forall(values, lambda v: _kind(v).isin("STRING", "VOID")), F.lit(True)
    )


def _last_text(values: Column) -> Column:
    """The last string wins; a null leaves the earlier one in place."""
    texts = F.filter(values, lambda v: _kind(v) == "STRING")
    return F.coalesce(_text_of(F.try_element_at(texts, F.lit(-1))), F.lit(""))


_NAMES = ["summary", "action_required", "deadline", "tone"]


def with_validation(df: DataFrame, raw: str = "raw", out: str = "checked") -> DataFrame:
    """Add ``out``, STRUCT<text, action, deadline, tone, status, err>, for the replies in ``raw``.

    ``err`` names the first broken rule. Works in projections because later rules read the parsed
    reply several times, and an expression that holds a lambda is evaluated anew at every mention.
    """
    columns = df.columns
    parsed = df.withColumns(
        {
            "_one": F.coalesce(_is_one_value(F.col(raw)), F.lit(False)),
            "_entries": F.map_entries(F.from_json(raw, "map<string,variant>", _STRICT)),
        }
    )
    valued = parsed.select(
        *columns,
        (F.col("_one") & F.col("_entries").isNotNull()).alias("_is_object"),
        *(_field_values(F.col("_entries"), name).alias(f"_{name}s") for name in _NAMES),
    )
    typed = reduce(lambda x, y: x & y, [_well_typed(F.col(f"_{name}s")) for name in _NAMES])
    fields = valued.select(
        *columns,
        (F.col("_is_object") & typed).alias("_typed"),
        *(_last_text(F.col(f"_{n}s")).alias(f"_{n}") for n in _NAMES if n != "deadline"),
        # An explicit null takes an earlier deadline back.
        F.coalesce(
            _text_of(F.try_element_at("_deadlines", F.lit(-1))), F.lit("")
        ).alias("_deadline"),
    )
    deadline = F.col("_deadline")
    real_date = deadline.rlike(fixed.ISO_DATE) & F.try_to_date(deadline, "yyyy-MM-dd").isNotNull()
    problem = (
        F.when(~F.col("_typed"), "invalid JSON")
        .when(F.col("_summary") == "", "empty summary")
        .when(~F.col("_action_required").isin(fixed.ACTIONS), "invalid action_required")
        .when(~F.col("_tone").isin(fixed.TONES), "invalid tone")
        .when((deadline != "") & ~real_date, "invalid deadline")
    )
    judged = fields.withColumn("_err", problem)
    good = F.col("_err").isNull()
    return judged.select(
        *columns,
        F.struct(
            F.when(good, F.left("_summary", F.lit(fixed.SUMMARY_CHAR_LIMIT))).alias("text"),
            F.when(good, F.col("_action_required")).alias("action"),
            F.when(good & (deadline != ""), deadline).alias("deadline"),
            F.when(good, F.col("_tone")).alias("tone"),
            F.when(good, "ok").otherwise("error").alias("status"),
            F.col("_err").alias("err"),
        ).alias(out),
    )


def with_lint(
    df: DataFrame,
    text: Column | str,
    status: Column | str,
    err: Column | str,
    truncated: Column | str,
    out: str = "checks",
) -> DataFrame:
    """Add ``out``, the warnings on each summary in fixed order; a failed one only reports that.

    The word pattern looks back at every position, so plain searches in the upper-cased text rule
    most summaries out first. That text is a column of its own: inside the branch of a condition
    it would be made once per word.
    """
    columns = df.columns
    summary = F.coalesce(_col(text), F.lit(""))
    failed = _col(status) == "error"
    prepared = df.select(
        *columns,
        summary.alias("_text"),
        F.upper(summary).alias("_upper"),
        F.coalesce(failed, F.lit(False)).alias("_failed"),
        F.concat(F.lit(fixed.LINT_FALLBACK), F.coalesce(_col(err), F.lit(""))).alias("_failure"),
        F.coalesce(_col(truncated), F.lit(False)).alias("_cut"),
    )
    text, size = F.col("_text"), F.length("_text")
    worded = reduce(
        lambda x, y: x | y, [F.col("_upper").contains(w.upper()) for w in fixed.ACCUSATIONS]
    )
    checks = F.array_compact(
        F.array(
            F.when(size > fixed.SUMMARY_CHAR_LIMIT, F.format_string(fixed.LINT_TOO_LONG, size)),
            F.when(text.contains("!"), fixed.LINT_AFFECT),
            F.when(text.rlike(fixed.CAPITALS_RUN), fixed.LINT_CAPITALS),
            F.when(worded & text.rlike(fixed.ACCUSATION), fixed.LINT_ACCUSATION),
            F.when(F.col("_cut"), fixed.LINT_TRUNCATED),
        )
    )
    return prepared.select(
        *columns, F.when(F.col("_failed"), F.array("_failure")).otherwise(checks).alias(out)
    )
