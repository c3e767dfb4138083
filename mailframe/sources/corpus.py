"""Mail and text files as a table: scan, and MIME reading in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from email import message_from_bytes
from email.header import decode_header
from email.message import Message
from email.utils import getaddresses, parsedate_to_datetime
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailframe import fixed
from mailframe.functions.plain_mail import with_plain_parts
from mailframe.functions.text import format_address, trim_id, trim_space, with_clean_body
from mailframe.schemas import MAIL_PARTS
from mailframe.session import stage
from mailframe.sources.corpus_files import FORMAT, check_path, register

_ENCODED_WORD = re.compile(r"=\?[^?\s]+\?[bqBQ]\?[^?]*\?=")
_ZONE_AT_END = re.compile(r"(?:[+-]\d{4}|[A-Z]{3,4})\s*(?:\([^)]*\))?\s*$")


def scan_corpus(spark: SparkSession, path: str) -> DataFrame:
    """All .eml and .txt files below ``path`` (or ``path`` itself) as (path, content, read_error).

    Empty files and names that start with ``_`` or ``.`` count too; extensions in any letter case.
    Files come in partitions of about the same number of bytes, in the order of their paths. A file
    that cannot be opened has ``read_error`` and no content.
    """
    check_path(path)
    register(spark)
    return spark.read.format(FORMAT).load(path).select("path", "content", "read_error")


def _header(message: Message, name: str) -> str:
    """First header of that name: raw UTF-8 allowed, unfolded, encoded words decoded."""
    for key, value in message.raw_items():
        if key.lower() != name:
            continue
        text = str(value).encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        text = re.sub(r"\r?\n(?=[ \t])", "", text)
        text = re.sub(r"(\?=)\s+(?==\?)", r"\1", text)

        def decoded(match: re.Match) -> str:
            (chunk, charset), *_ = decode_header(match.group())
            return _decode(chunk, charset) if isinstance(chunk, bytes) else chunk

        return _ENCODED_WORD.sub(decoded, text)
    return ""


def _decode(data: bytes, charset: str | None) -> str:
    try:
        return data.decode(charset or "utf-8", "replace")
    except LookupError:
        return data.decode("utf-8", "replace")


def _sender(value: str) -> tuple[str, str]:
    """(name, address) of the first sender, or the whole header as address."""
    for name, addr in getaddresses([value])[:1]:
        if "@" in addr:
            return name, addr
    return "", value.strip()


_EPOCH = datetime(1970, 1, 1)


def _dates(value: str) -> tuple[int | None, int | None]:
    """Microseconds of (UTC, the header's own clock); a date without a zone is no date."""
    try:
        if not _ZONE_AT_END.search(value):
            return None, None
        when = parsedate_to_datetime(value)
    except (ValueError, OverflowError, TypeError):
        return None, None
    micro = timedelta(microseconds=1)
    offset = when.utcoffset() or timedelta()
    local = when.replace(tzinfo=None) - _EPOCH
    return (local - offset) // micro, local // micro


def read_mail(raw: bytes, sender: Callable[[str], tuple[str, str]] = _sender) -> dict:
    """The parts of one message that the native expressions work on."""
    message = message_from_bytes(raw)
    if not message.keys():
        raise ValueError("malformed MIME header")
    bodies, attached = {}, False
    for part in message.walk():
        if part.is_multipart():
            continue
        kind = part.get_content_type()
        is_attachment = part.get_content_disposition() == "attachment"
        attached = attached or is_attachment or bool(part.get_filename())
        if kind in ("text/plain", "text/html") and not is_attachment and kind not in bodies:
            body = _decode(part.get_payload(decode=True) or b"", part.get_content_charset())
            bodies[kind] = body.replace("\r\n", "\n")
    sent_us, local_us = _dates(_header(message, "date"))
    from_name, from_addr = sender(_header(message, "from"))
    return {
        "message_id_raw": _header(message, "message-id"),
        "from_name": from_name,
        "from_addr": from_addr,
        "subject": _header(message, "subject").strip(),
        "sent_us": sent_us,
        "local_us": local_us,
        "text": bodies.get("text/plain", ""),
        "html": bodies.get("text/html", ""),
        "has_attachment": attached,
        "parse_error": None,
    }


_FAILED = dict.fromkeys(MAIL_PARTS.names)


def _read_batches(column: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Senders repeat; address lists are the slowest header to read.
        sender = lru_cache(maxsize=10_000)(_sender)
        for batch in batches:
            parts = []
            for raw in batch[column]:
                try:
                    parts.append(read_mail(bytes(raw), sender))
                except Exception as failure:  # noqa: BLE001 - a bad message is a row
                    reason = str(failure) or type(failure).__name__
                    parts.append({**_FAILED, "parse_error": reason})
            fields = pd.DataFrame(
                parts, columns=MAIL_PARTS.names, index=batch.index, dtype=object
            )
            yield pd.concat([batch.drop(columns=[column]), fields], axis=1)

    return run


def parse_mail(
    df: DataFrame, raw: str = "raw", limit: int = fixed.BODY_CHAR_LIMIT
) -> DataFrame:
    """Replace ``raw`` by the parsed message; a message that cannot be read has ``parse_error``.

    Plain single-part mail is read by native expressions. Only what is left, multipart mail and
    rare or broken forms, has its container opened in Python. What the expressions found is written
    once, with the original of the others, and the two kinds are read from there. The id is trimmed
    and the body cleaned and cut by native expressions for all. Other columns travel through the
    worker, so select what is needed.
    """
    keep = [f for f in df.schema if f.name != raw]
    names = [f.name for f in keep]
    read = with_plain_parts(df, raw)
    routed = stage(
        read.select(*names, "_plain", F.when(~F.col("_plain"), F.col(raw)).alias(raw), F.when(F.col("_plain"), F.col("_parts")).alias("_parts")),
        "routed-mail",
    )
    plain = routed.where("_plain").select(*names, "_parts.*")
    schema = T.StructType([*keep, *MAIL_PARTS])
    others = routed.where("not _plain").select(*names, raw).mapInPandas(_read_batches(raw), schema)
    cleaned = with_clean_body(plain.unionByName(others), "text", "html", limit)
    times = {
        "message_id": trim_id("message_id_raw"),
        "sent_at": F.timestamp_micros("sent_us"),
        "sent_local": F.timestamp_micros("local_us").cast("timestamp_ntz"),
    }
    return cleaned.withColumns(times).drop(
        "message_id_raw", "sent_us", "local_us", "text", "html"
    )


def parse_corpus(files: DataFrame, limit: int = fixed.BODY_CHAR_LIMIT) -> DataFrame:
    """Corpus files as records (path, from_display, subject, flags, body_text, parse_error).

    Text files have neither headers nor limits; they never reach a Python worker. Files with a
    ``read_error``, where the table has that column, are records of that error.
    """
    record = ["path", "from_display", "subject", "has_attachment", "truncated", "body_text", "parse_error"]
    if "read_error" not in files.columns:
        files = files.withColumn("read_error", F.lit(None).cast("string"))
    is_text = F.lower("path").endswith(fixed.CORPUS_EXTENSIONS[1])
    unread = F.col("read_error").isNotNull()
    mail = parse_mail(files.where(~is_text & ~unread).select("path", "content"), "content", limit).withColumn(
        "from_display", format_address("from_name", "from_addr")
    )
    text = files.where(is_text & ~unread).select(
        "path",
        F.lit(fixed.NO_HEADER).alias("from_display"),
        F.lit(fixed.NO_HEADER).alias("subject"),
        F.lit(False).alias("has_attachment"),
        F.lit(False).alias("truncated"),
        trim_space(F.make_valid_utf8(F.col("content").cast("string"))).alias("body_text"),
        F.lit(None).cast("string").alias("parse_error"),
    )
    absent = [F.lit(None).cast(mail.schema[c].dataType).alias(c) for c in record[1:-1]]
    failed = files.where(unread).select("path", *absent, F.col("read_error").alias("parse_error"))
    return mail.select(*record).unionByName(text.select(*record)).unionByName(failed)
