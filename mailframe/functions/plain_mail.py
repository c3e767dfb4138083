"""Single-part mail as column expressions: headers, encoded words, dates, transfer encodings.

Covers the forms that nearly all single-part mail has, each in full, and says of every message
whether it is one of them. All others are for a MIME reader. Rules that read their input more than once
are projections in sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailframe.functions.text import trim_space
from mailframe.schemas import MAIL_PARTS

# Forms of RFC 5322, 2045 and 2047.
FIELD = "^[!-9;-~]+:"
ENCODED_WORD = r"=\?[^?\s]+\?[bqBQ]\?[^?]*\?="
UTF8_WORD = r"^=\?(?i:utf-8)\?(?:[bB]\?(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?|[qQ]\?(?:[!-<>@-~]|=[0-9A-Fa-f]{2})*)\?=$"
BASE64 = r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"
ATOM = r"[^\x00-\x20\x7f<>@,;:\"()\[\]\\]+"
ADDRESS = r"[A-Za-z0-9!#$%&'*+/=?^_`{|}~.-]+@[A-Za-z0-9.-]+"
SENDER = rf'^[ \t]*(?:"([^"\\]*)"|({ATOM}(?: {ATOM})*))?[ \t]*<({ADDRESS})>[ \t]*$'
BARE_SENDER = rf"^[ \t]*({ADDRESS})[ \t]*$"
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
DATE = (
    rf"^(?:[A-Za-z]{{3}}, )?([0-9]{{1,2}}) ({'|'.join(MONTHS)}) ([1-9][0-9]{{3}}) "
    r"([01][0-9]|2[0-3]):([0-5][0-9])(?::([0-5][0-9]))? ([+-])([01][0-9]|2[0-3])([0-5][0-9])$"
)
TEXT_TYPE = (
    r"^(?i)text/(plain|html)[ \t]*(?:;[ \t]*charset=(?:\"(utf-8|us-ascii|iso-8859-1)\"|(utf-8|us-ascii|iso-8859-1))[ \t]*)?"
    r"(?:;[ \t]*format=(?:flowed|fixed)[ \t]*)?$"
)
TRANSFERS = ("", "7bit", "8bit", "binary", "quoted-printable", "base64")
_HEADERS = ("message-id", "from", "subject", "date", "content-type", "content-transfer-encoding")


def _bytes_of(quoted: Column) -> Column:
    """What quoted-printable text of ASCII stands for."""
    pieces = F.regexp_extract_all(quoted, F.lit("=[0-9A-Fa-f]{2}|[^=]+"), F.lit(0))
    one = lambda t: F.when(t.startswith("="), F.char(F.conv(F.substring(t, 2, 2), 16, 10).cast("int"))).otherwise(t)
    return F.encode(F.array_join(F.transform(pieces, one), ""), "ISO-8859-1")


def _word(token: Column) -> Column:
    """The text of one token of a header: an encoded word decoded, anything else as it is."""
    content = F.regexp_extract(token, r"^=\?[^?]*\?[bqBQ]\?([^?]*)\?=$", 1)
    is_base64 = F.lower(token).startswith("=?utf-8?b?")
    raw = F.when(is_base64, F.unbase64(content)).otherwise(_bytes_of(F.replace(content, F.lit("_"), F.lit(" "))))
    return F.when(token.rlike(f"^{ENCODED_WORD}$"), raw.cast("string")).otherwise(token)


def _tokens(header: Column) -> Column:
    joined = F.regexp_replace(header, r"(\?=)\s+(?==\?)", "$1")
    cut = F.regexp_extract_all(joined, F.lit(f"{ENCODED_WORD}|[^=]+|="), F.lit(0))
    return F.when(header.contains("=?"), cut).otherwise(F.array(header))


def with_plain_parts(df: DataFrame, raw: str) -> DataFrame:
    """Add ``_plain`` and, in ``_parts``, the parts of MAIL_PARTS where a message is a plain one.

    Plain is a valid UTF-8 message of well-formed header lines and one text part, without names of
    files, whose sender, date, charset, encoded words and transfer encoding have the usual forms.
    """
    keep = [F.col(c) for c in df.columns]
    step = df.select(*keep, F.col(raw).cast("string").alias("_text"))
    ends = [F.when(F.locate(end, F.col("_text")) > 0, F.locate(end, F.col("_text"))) for end in ("\n\n", "\n\r\n")]
    step = step.select(*keep, "_text", F.least(*ends).alias("_end"))
    after = F.when(F.substring("_text", F.col("_end") + 1, F.lit(1)) == "\n", 2).otherwise(3)
    step = step.select(
        *keep,
        F.is_valid_utf8("_text").alias("_valid"),
        F.substring("_text", F.lit(1), F.col("_end")).alias("_head"),
        F.substring("_text", F.col("_end") + after, F.length("_text")).alias("_body"),
    )
    # Blanks before a value go; those that a fold puts before it stay.
    unfolded = F.regexp_replace(F.regexp_replace("_head", r"(\A|\n)([!-9;-~]+:)[ \t]+", "$1$2"), r"\r?\n(?=[ \t])", "")
    step = step.select(
        *keep, "_body",
        (F.col("_valid") & F.col("_head").isNotNull() & ~F.col("_head").rlike(r"\r(?!\n)|[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")).alias("_valid"),
        F.filter(F.split(unfolded, r"\r?\n"), lambda line: line != "").alias("_lines"),
    )

    step = step.select("*", F.transform("_lines", lambda line: F.lower(F.substring_index(line, ":", 1))).alias("_names"))

    def header(name: str) -> Column:
        at = F.array_position("_names", name).cast("int")
        line = F.when(at > 0, F.try_element_at("_lines", at))
        return F.coalesce(F.substring(line, F.lit(len(name) + 2), F.length(line)), F.lit(""))

    wellformed = (
        F.col("_valid")
        & F.forall("_lines", lambda line: line.rlike(FIELD))
        & ~F.array_contains("_names", "content-disposition")
    )
    step = step.select(*keep, "_body", wellformed.alias("_valid"), *(header(n).alias(f"_{n}") for n in _HEADERS))
    step = step.select(
        *keep, "_body", "_valid", *(_tokens(F.col(f"_{n}")).alias(f"_{n}") for n in _HEADERS[:4]),
        F.col("_content-type").alias("_type"), F.lower("_content-transfer-encoding").alias("_transfer"),
    )
    usual = F.col("_valid")
    for name in _HEADERS[:4]:
        usual &= F.forall(f"_{name}", lambda t: ~t.rlike(f"^{ENCODED_WORD}$") | t.rlike(UTF8_WORD))
    decoded = {n: F.array_join(F.transform(f"_{n}", _word), "") for n in _HEADERS[:4]}
    step = step.select(
        *keep, "_body", "_type", "_transfer", usual.alias("_valid"),
        *(F.when(usual, decoded[n]).alias(f"_{n}") for n in _HEADERS[:4]),
    )
    is_date = (F.col("_date") == "") | F.col("_date").rlike(DATE)
    is_sender = (F.col("_from") == "") | F.col("_from").rlike(SENDER) | F.col("_from").rlike(BARE_SENDER)
    is_text = (F.col("_type") == "") | F.col("_type").rlike(TEXT_TYPE)
    charset = F.lower(F.concat(F.regexp_extract("_type", TEXT_TYPE, 2), F.regexp_extract("_type", TEXT_TYPE, 3)))
    step = step.select(
        *keep, "_transfer", *(f"_{n}" for n in _HEADERS[:4]),
        charset.alias("_charset"),
        (F.lower(F.regexp_extract("_type", TEXT_TYPE, 1)) == "html").alias("_is_html"),
        F.when(F.col("_transfer") == "quoted-printable", F.regexp_replace("_body", r"=\r?\n", ""))
        .when(F.col("_transfer") == "base64", F.regexp_replace("_body", r"[\r\n]", "")).otherwise(F.col("_body")).alias("_body"),
        (
            F.col("_valid") & is_date & is_sender & is_text & F.col("_transfer").isin(*TRANSFERS)
            & F.is_valid_utf8("_message-id") & F.is_valid_utf8("_from") & F.is_valid_utf8("_subject")
        ).alias("_valid"),
    )
    ascii_only = ~F.col("_body").rlike(r"[^\x00-\x7f]")
    fits = (
        F.when(F.col("_transfer") == "quoted-printable", ascii_only & ~F.col("_body").rlike("=(?![0-9A-Fa-f]{2})"))
        .when(F.col("_transfer") == "base64", F.col("_body").rlike(BASE64))
        .otherwise(F.col("_charset").isin("", "utf-8") | ascii_only)
    )
    data = (
        F.when(F.col("_transfer") == "quoted-printable", _bytes_of(F.col("_body")))
        .when(F.col("_transfer") == "base64", F.unbase64("_body"))
    )
    day, month, year, hour, minute, second, sign, off_hour, off_minute = (
        F.regexp_extract("_date", DATE, i) for i in range(1, 10)
    )
    month = F.array_position(F.array(*map(F.lit, MONTHS)), month).cast("int")
    second = F.when(second != "", second).otherwise("0").cast("int")
    date = F.try_to_date(F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")
    seconds = hour.cast("int") * 3600 + minute.cast("int") * 60 + second
    offset = (off_hour.cast("int") * 3600 + off_minute.cast("int") * 60) * F.when(sign == "-", -1).otherwise(1)
    dated = F.col("_date") != ""
    step = step.select(
        *keep, *(f"_{n}" for n in _HEADERS[:3]), "_charset", "_is_html", "_body", (F.col("_valid") & fits).alias("_valid"),
        F.when(F.col("_valid") & fits, data).alias("_data"),
        F.when(F.col("_valid") & dated, (F.unix_date(date).cast("long") * 86_400 + seconds) * 1_000_000).alias("_local_us"),
        F.when(F.col("_valid") & dated, offset.cast("long") * 1_000_000).alias("_offset_us"),
    )
    # ISO-8859-1 holds every byte; with ASCII the two other charsets are UTF-8.
    text = (
        F.when(F.col("_data").isNull(), F.col("_body"))
        .when(F.col("_charset") == "iso-8859-1", F.decode("_data", "ISO-8859-1"))
        .otherwise(F.col("_data").cast("string"))
    )
    step = step.select("*", text.alias("_out"))
    readable = F.is_valid_utf8("_out") & ~((F.col("_charset") == "us-ascii") & F.col("_out").rlike(r"[^\x00-\x7f]"))
    body = F.replace("_out", F.lit("\r\n"), F.lit("\n"))
    name = F.concat(F.regexp_extract("_from", SENDER, 1), F.regexp_extract("_from", SENDER, 2))
    address = F.concat(F.regexp_extract("_from", SENDER, 3), F.regexp_extract("_from", BARE_SENDER, 1))
    parts = {
        "message_id_raw": F.col("_message-id"),
        "from_name": name,
        "from_addr": address,
        "subject": trim_space("_subject"),
        "sent_us": F.col("_local_us") - F.col("_offset_us"),
        "local_us": F.col("_local_us"),
        "text": F.when(F.col("_is_html"), "").otherwise(body),
        "html": F.when(F.col("_is_html"), body).otherwise(""),
        "has_attachment": F.lit(False),
        "parse_error": F.lit(None).cast("string"),
    }
    plain = F.coalesce(F.col("_valid") & readable, F.lit(False))
    return step.select(
        *keep, plain.alias("_plain"), F.struct(*(parts[f.name].cast(f.dataType).alias(f.name) for f in MAIL_PARTS)).alias("_parts")
    )
