"""Values that results depend on. They are facts of the message format, not tuning knobs."""

# --- Fixed values: limits -------------------------------------------------
BODY_CHAR_LIMIT = 4000
SUMMARY_CHAR_LIMIT = 200
ARCHIVE_NAME_LIMIT = 120
ARCHIVE_HASH_HEX = 12
MAX_UID = 4294967295
MODEL_TIMEOUT_SECONDS = 600.0
DEFAULT_ZONE = "America/Toronto"
DIGEST_HOUR = 8
DIGEST_DAYS = 7

# --- Fixed values: enumerations -------------------------------------------
ACTIONS = ["none", "reply", "action", "fyi"]
TONES = ["neutral", "heated"]
CORPUS_EXTENSIONS = [".eml", ".txt"]

# --- Fixed values: stored and displayed texts -----------------------------
FAILED_SUMMARY = "could not summarize - read original"
OUT_OF_SCOPE_SUMMARY = "out of scope - not summarized"
FALLBACK_SUMMARY = "could not summarize"
VALIDATION_FAILED = "validation failed after retry"
PARSE_ERROR_PREFIX = "parse message: "
UNKNOWN_SENDER = "(unknown sender)"
NO_SUBJECT = "(no subject)"
NO_HEADER = "(none)"
DIGEST_TITLE = "Weekly email digest"
DIGEST_EMPTY = "No messages were received during this period."

# --- Fixed values: lint warnings, in report order -------------------------
LINT_FALLBACK = "llm-fallback: "
LINT_TOO_LONG = "summary>200chars (%d)"
LINT_AFFECT = "affect-marker '!'"
LINT_CAPITALS = "ALL-CAPS run"
LINT_ACCUSATION = "accusation verb"
LINT_TRUNCATED = "note: source was truncated"

# --- Fixed values: entities and what they stand for -----------------------
ENTITIES = [
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&nbsp;", " "),
    ("&mdash;", "—"),
    ("&ndash;", "–"),
    ("&laquo;", "«"),
    ("&raquo;", "»"),
]

# --- Fixed values: the white space that trimming removes ------------------
SPACES = (
    "\t\n\v\f\r \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# --- Fixed values: patterns, in the java.util.regex dialect ---------------
# d: only \n ends a line; u: case folding beyond ASCII; \z: end of input.
SCRIPT_OR_STYLE = r"(?isu)<(script|style)[^>]*>.*?</(script|style)>"
BLOCK_TAG = r"(?iu)<(br|p|div|tr|li|h[1-6]|blockquote)[^>]*/?>"
ANY_TAG = r"<[^>]+>"
EXTRA_BLANKS = r" +(?=\n)|( ) +"
NEWLINE_RUN = r"\n{3,}"
SIGNATURE = r"(?md)^--[ \t]*$[\s\S]*"
REPLY_HEADER = (
    r"(?imud)^(?:On .+wrote:[ \t\f\r]*|Le .+a [eé]crit[ \t\f\r]*:[ \t\f\r]*)\n(?=\n*>)"
)
QUOTED_LINE = r"(?md)^>.*(?:\n|\z)"
ID_TRIM_CHARS = "<> \t"
UNSAFE_NAME_CHAR = r"[^A-Za-z0-9._-]"
CAPITALS_RUN = r"[A-ZÀÂÆÇÉÈÊËÎÏÔŒÙÛÜ]{3,}"
ACCUSATIONS = ["accuse", "exige", "insiste", "blame"]
ACCUSATION = r"(?iu)(?<![A-Za-z0-9_])(" + "|".join(ACCUSATIONS) + ")"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}\z"

# --- Fixed values: time formats, in Spark's notation ----------------------
CARD_TIME = "MMM d, yyyy HH:mm"
ARCHIVE_MONTH = "yyyy/MM"
