"""Text cleaning as native column expressions; nothing here needs a Python worker."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailframe import fixed


Step = Callable[[Column], Column]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_space(c: Column | str) -> Column:
    """Strip every kind of Unicode white space from both ends (``trim`` only knows U+0020)."""
    return F.btrim(_col(c), F.lit(fixed.SPACES))


def empty_to_null(c: Column | str) -> Column:
    return F.nullif(_col(c), F.lit(""))


def null_to_empty(c: Column | str) -> Column:
    return F.coalesce(_col(c), F.lit(""))


def _replace_if(c: Column, needle: Column, pattern: str, replacement: str) -> Column:
    """``regexp_replace`` only where a plain search says that the pattern can occur at all.

    A search runs over the bytes; a pattern first needs the text decoded, and rebuilt afterwards.
    Most text has nothing to replace.
    """
    return F.when(needle, F.regexp_replace(c, pattern, replacement)).otherwise(c)


def _replace_closed(c: Column, pattern: str, replacement: str, closer: str) -> Column:
    """``regexp_replace`` over the part up to the last ``closer``; the rest cannot match.

    An opener without a closer would otherwise make the engine rescan the text to its end, once
    per opener.
    """
    head = F.regexp_extract(c, f"(?isu)\\A.*{closer}", 0)
    return F.concat(
        F.regexp_replace(head, pattern, replacement), F.substr(c, F.length(head) + F.lit(1))
    )


def _drop_scripts(c: Column) -> Column:
    """Script and style elements become blanks.

    An element that is never closed means that no later one is closed either. So each match starts
    where the last one ended, passes over text without an opener, and the search ends at the first
    opener that fails: every opener is looked at once.
    """
    plain = r"(?isu)\G([^<]*+(?:<(?!script|style)[^<]*+)*+)"
    return _replace_if(c, c.contains("<"), plain + fixed.SCRIPT_OR_STYLE, "$1 ")


def _break_blocks(c: Column) -> Column:
    return _replace_closed(c, fixed.BLOCK_TAG, "\n", ">")


def _drop_tags(c: Column) -> Column:
    return _replace_closed(c, fixed.ANY_TAG, "", ">")


def _decode_entities(c: Column) -> Column:
    # "&" is decoded last, so that text such as "&amp;lt;" is decoded once and not twice.
    pairs = reversed(fixed.ENTITIES)
    return reduce(lambda text, pair: F.replace(text, F.lit(pair[0]), F.lit(pair[1])), pairs, c)


def _tabs_to_blanks(c: Column) -> Column:
    return F.translate(c, "\t", " ")


def _single_blanks(c: Column) -> Column:
    return _replace_if(c, c.contains("  ") | c.contains(" \n"), fixed.EXTRA_BLANKS, "$1")


def _single_empty_lines(c: Column) -> Column:
    return _replace_if(c, c.contains("\n\n\n"), fixed.NEWLINE_RUN, "\n\n")


def _cut_signature(c: Column) -> Column:
    return _replace_if(c, c.contains("--"), fixed.SIGNATURE, "")


def _drop_quotes(c: Column) -> Column:
    unquoted = F.regexp_replace(
        F.regexp_replace(c, fixed.REPLY_HEADER, ""), fixed.QUOTED_LINE, ""
    )
    return F.when(c.startswith(">") | c.contains("\n>"), unquoted).otherwise(c)


# The text rules as their steps, for ``with_steps``.
STRIP_HTML: list[Step] = [_drop_scripts, _break_blocks, _drop_tags, _decode_entities]
NORMALIZE: list[Step] = [_tabs_to_blanks, _single_blanks, _single_empty_lines, trim_space]
STRIP_QUOTED: list[Step] = [_cut_signature, _drop_quotes, trim_space]


def with_steps(df: DataFrame, name: str, start: Column | str, *steps: Step) -> DataFrame:
    """Add ``name``: ``start`` after all ``steps``, a projection per step.

    Most steps read their input more than once. Nested in one expression, the inner ones would be
    repeated at every level; Spark keeps the projections apart for the same reason, and still
    compiles them into one stage.
    """
    return reduce(lambda d, step: d.withColumn(name, step(F.col(name))), steps,
                  df.withColumn(name, _col(start)))


def strip_html(c: Column | str) -> Column:
    """Markup to text: scripts and styles go, block tags become newlines, entities are decoded."""
    return reduce(lambda text, step: step(text), STRIP_HTML, _col(c))


def normalize_whitespace(c: Column | str) -> Column:
    """One blank between words, none at line ends, at most one empty line, trimmed."""
    return reduce(lambda text, step: step(text), NORMALIZE, _col(c))


def strip_quoted(c: Column | str) -> Column:
    """Drop the signature, quoted lines and reply headers that stand directly before a quote."""
    return reduce(lambda text, step: step(text), STRIP_QUOTED, _col(c))


def truncate(c: Column | str, limit: int) -> Column:
    """The first ``limit`` code points; 0 means no limit."""
    return F.left(_col(c), F.lit(limit)) if limit > 0 else _col(c)


def is_truncated(c: Column | str, limit: int) -> Column:
    return F.length(_col(c)) > limit if limit > 0 else F.lit(False)


def with_clean_body(
    df: DataFrame,
    text: str = "text",
    html: str | None = "html",
    limit: int = fixed.BODY_CHAR_LIMIT,
) -> DataFrame:
    """Add ``body_text`` and ``truncated``.

    The body is the plain text if there is any, else the stripped markup; normalised, with quotes
    and signature removed, then cut.
    """
    plain = empty_to_null(text)
    if html is not None:
        # NULL where there is plain text, and NULL passes through all steps untouched.
        df = with_steps(df, "_html", F.when(plain.isNull(), F.col(html)), *STRIP_HTML)
        plain = F.coalesce(plain, F.col("_html"))
    body = with_steps(df, "_body", null_to_empty(plain), *NORMALIZE, *STRIP_QUOTED)
    return (
        body.withColumn("body_text", truncate("_body", limit))
        .withColumn("truncated", is_truncated("_body", limit))
        .drop("_body", "_html")
    )


def trim_id(c: Column | str) -> Column:
    return F.btrim(_col(c), F.lit(fixed.ID_TRIM_CHARS))


def format_address(name: Column | str, addr: Column | str) -> Column:
    """``Name <addr>``, or the address alone when there is no name."""
    name, addr = null_to_empty(name), null_to_empty(addr)
    return F.when(name == "", addr).otherwise(F.concat(name, F.lit(" <"), addr, F.lit(">")))


def safe_name(message_id: Column | str) -> Column:
    """A message id as a file name; NULL when nothing is left of it."""
    name = F.left(
        F.regexp_replace(trim_id(message_id), fixed.UNSAFE_NAME_CHAR, "_"),
        F.lit(fixed.ARCHIVE_NAME_LIMIT),
    )
    return empty_to_null(F.btrim(name, F.lit(".")))
