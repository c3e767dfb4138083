"""Line-by-line Python models of the text rules, for randomised comparison."""

import json
import re
import unicodedata
from datetime import date

SPACE = {chr(c) for c in [*range(9, 14), 32, 0x85]} | {
    chr(c) for c in range(0x110000) if unicodedata.category(chr(c)).startswith("Z")
}


def trim(text):
    start, end = 0, len(text)
    while start < end and text[start] in SPACE:
        start += 1
    while end > start and text[end - 1] in SPACE:
        end -= 1
    return text[start:end]


def normalize(text):
    rows = [re.sub("[ \t]+", " ", row).rstrip(" ") for row in text.split("\n")]
    return trim(re.sub("\n\n\n+", "\n\n", "\n".join(rows)))


def is_header(row):
    fold = row.lower()
    tail = fold.rstrip("\t\n\f\r ")
    english = fold.startswith("on ") and tail.endswith("wrote:") and len(tail) > len("on wrote:")
    return english or bool(re.fullmatch(r"le .+a [eé]crit[\t\n\f\r ]*:", tail, re.S))


def strip_quotes(text):
    rows = text.split("\n")
    for i, row in enumerate(rows):
        if row.rstrip(" \t") == "--":
            rows = rows[:i]
            break
    kept = []
    for i, row in enumerate(rows):
        following = next((r for r in rows[i + 1 :] if r != ""), "")
        quoted_header = is_header(row) and following.startswith(">")
        if not row.startswith(">") and not quoted_header:
            kept.append(row)
    return trim("\n".join(kept))


def first_wins(rows):
    """Sequential two-key insert: (order, a, b) rows, None never blocks."""
    seen_a, seen_b, kept = set(), set(), []
    for order, a, b in sorted(rows, key=lambda r: r[0]):
        if (a is not None and a in seen_a) or (b is not None and b in seen_b):
            continue
        kept.append((order, a, b))
        seen_a.add(a)
        seen_b.add(b)
    return kept


def reply_is_good(raw):
    """Python's own JSON reader as the judge of a reply."""
    if raw is None:
        return False
    try:
        pairs = json.loads(raw, object_pairs_hook=list, parse_constant=lambda c: 1 / 0)
    except (ValueError, ZeroDivisionError):
        return False
    if not isinstance(pairs, list) or not raw.strip().startswith("{"):
        return False
    got = {"summary": "", "action_required": "", "deadline": None, "tone": ""}
    for key, value in pairs:
        name = key.lower()
        if name not in got:
            continue
        if value is not None and not isinstance(value, str):
            return False
        if value is not None or name == "deadline":
            got[name] = value
    if not got["summary"]:
        return False
    if got["action_required"] not in ("none", "reply", "action", "fyi"):
        return False
    if got["tone"] not in ("neutral", "heated"):
        return False
    if got["deadline"]:
        if not re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", got["deadline"]):
            return False
        try:
            date.fromisoformat(got["deadline"])
        except ValueError:
            return False
    return True
