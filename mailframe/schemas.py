"""Table and record shapes."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _B, _TS = T.StringType(), T.LongType(), T.BooleanType(), T.TimestampType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


MESSAGE_KEY = ["mailbox", "uid_validity", "uid"]

# Protocol uids are unsigned 32-bit numbers, which INT cannot hold.
RAW_MAIL = _struct(("mailbox", _S), ("uid_validity", _L), ("uid", _L), ("raw", T.BinaryType()))
MAILBOX_STATE = _struct(("mailbox", _S), ("uid_validity", _L), ("uid_next", _L))
CURSORS = _struct(("mailbox", _S), ("uid_validity", _L), ("last_uid", _L))

# What the MIME reader returns for one message; everything after it is native expressions. Times
# are microseconds, of the instant and of the header's own clock: any year fits, unlike in pandas.
MAIL_PARTS = _struct(
    ("message_id_raw", _S), ("from_name", _S), ("from_addr", _S), ("subject", _S),
    ("sent_us", _L), ("local_us", _L), ("text", _S), ("html", _S), ("has_attachment", _B),
    ("parse_error", _S),
)

ATTEMPT = _struct(("raw", _S), ("call_error", _S), ("latency_ms", _L))

MESSAGES = _struct(
    ("mailbox", _S), ("uid_validity", _L), ("uid", _L), ("message_id", _S), ("received_at", _TS),
    ("from_name", _S), ("from_addr", _S), ("subject", _S), ("raw_path", _S), ("summary", _S),
    ("action_req", _S), ("deadline", _S), ("tone", _S), ("in_scope", _B), ("llm_status", _S),
    ("llm_error", _S), ("processed_at", _TS), ("received_month", _S),
)
ARCHIVE = _struct(
    ("raw_path", _S), ("base_path", _S), ("sha", _S), ("raw", T.BinaryType()), ("year", _S),
    ("month", _S),
)
DIGEST_ITEMS = _struct(
    ("mailbox", _S), ("uid_validity", _L), ("uid", _L), ("digest_id", _S), ("digested_at", _TS),
    ("received_month", _S),
)
DIGESTS = _struct(
    ("digest_id", _S), ("mailbox", _S), ("sent_at", _TS), ("window_start", _TS),
    ("window_end", _TS), ("email_count", _L),
)
