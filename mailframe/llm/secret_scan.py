"""Secret scans: fixed patterns, and a linear-chain conditional random field over tokens.

The field tags every token as secret begin, inside or outside from its shape, the words and signs around
it and features of the whole file. A token whose learned scores leave outside as the only tag of any best
path cuts the chain, so that Viterbi runs on the stretches between such tokens and still decodes the whole
text. It is trained on texts of the corpus whose pattern matches serve as labels.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import hash_order

# The kinds in their order, their patterns and least lengths.
KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
# What the names in assignments are in lower case; a text without any of them has no assignment.
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST_VALUE, ACCESS, HEX = 12, re.compile("AKIA[A-Z0-9]{14,}"), re.compile("[0-9a-f]{16,}")

# Documents that the field learns from, half of them with a match if there are as many, and runs of their
# tokens, at most. Runs in a match come first, up to half of the runs.
SAMPLE_ROWS, SAMPLE_RUNS = 4000, 3000
EPOCHS, RATE = 12, 0.3
# Tokens this close to each other belong to one run. Training sees windows of runs of about so many tokens;
# of those without a secret, at most so many of one document.
GAP, WINDOW, CLEAN_WINDOWS = 2, 8, 4
CONTEXT = 24
# Edges of the lengths of tokens.
LENGTHS = (4, 8, 12, 16, 20, 32, 41, 64)
# Shapes of tokens and scores of feature groups that a task remembers.
SHAPES = 50_000
REMEMBERED = 200_000
DIGITS, NO_DIGITS = re.compile("[0-9]+"), str.maketrans("", "", "0123456789")
# Tokens have a letter or digit; signs alone are a gap.
TOKEN = re.compile("((?<![A-Za-z0-9+/_=-])[+/_=-]*+[A-Za-z0-9][A-Za-z0-9+/_=-]*)")
LAST_WORD = re.compile(r"([A-Za-z_]+)[^A-Za-z_]*$")
BEGIN, INSIDE, OUTSIDE = range(3)
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _assignments(text: str) -> Iterator[re.Match]:
    lowered = text.lower()
    found = ASSIGN.finditer(text) if any(name in lowered for name in NAMES) else iter(())
    return (m for m in found if len(m[2]) >= LEAST_VALUE)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all pattern matches, in code points, by start and kind."""
    found = [(m.start(), 0, m.end()) for m in _assignments(text)]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def secrets_in(text: str) -> list[tuple[int, int]]:
    """(start, end) of the secrets themselves in the pattern matches, without what names them."""
    found = [m.span(2) for m in _assignments(text)]
    return sorted(found + [m.span() for p in (ACCESS, HEX) for m in p.finditer(text)])


def _bucket(number: int, edges: tuple[int, ...]) -> int:
    return bisect_right(edges, number)


@lru_cache(maxsize=SHAPES)
def _shape_names(lower: bool, upper: bool, hexed: bool, share: int, length: int, signs: str, kinds: int, head: str) -> tuple[str, ...]:
    shape = f"{int(lower)}{int(upper)}{int(hexed)}{_bucket(share, (1, 15, 40, 70, 100))}"
    return (
        "bias", f"shape={shape}", f"length={length}", f"both={shape}/{length}", f"signs={signs}",
        f"kinds={_bucket(kinds, (20, 40, 60, 80))}", f"head={head}",
    )


def shape_features(token: str) -> tuple[str, ...]:
    """What the token is like. Tokens are ASCII."""
    n, head = len(token), token[:4]
    if token.isalpha():
        lower = token.islower()
        return _shape_names(
            lower or not token.isupper(), not lower, lower and not token.strip("abcdef"), 0, bisect_right(LENGTHS, n), "",
            100 * len(set(token)) // n, "" if lower or not head.isupper() else head,
        )
    return _shape_names(
        token != token.upper(), token != token.lower(), not token.strip("0123456789abcdef"),
        100 * (n - len(token.translate(NO_DIGITS))) // n,
        bisect_right(LENGTHS, n),
        "" if token.isalnum() else "".join(sorted({c for c in token if not c.isalnum()})),
        100 * len(set(token)) // n, head if head.isupper() else "",
    )


def before_features(text: str) -> list[str]:
    """The word and signs before the token, in the end of the token before it and the gap between."""
    word = LAST_WORD.search(text)
    sign = text[word.end(1) :].strip() if word else text.strip()
    return [f"word={word[1].lower() if word else ''}", f"sign={sign[-2:]}"]


def sign_features(gap: str) -> list[str]:
    """What before_features says of a gap behind a word; that the word is the token before is told apart."""
    return [f"sign={gap.strip()[-2:]}"]


def after_features(sign: str) -> list[str]:
    return [f"next={sign.strip()}"]


def place_features(place: int) -> list[str]:
    return [f"place={place}"]


@dataclass
class Tokens:
    """All tokens of a text with what stands around them; a run ends where a gap is longer than GAP."""

    text: str

    def __post_init__(self) -> None:
        pieces = TOKEN.split(self.text)
        self.gaps, self.tokens = pieces[::2], pieces[1::2]
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        self.starts, self.ends = ends[:-1:2], ends[1::2]
        place = np.arange(len(self.tokens))
        self.first = np.ones(len(place), bool)
        self.first[1:] = self.starts[1:] - self.ends[:-1] > GAP
        self.place = np.minimum(place - np.maximum.accumulate(np.where(self.first, place, 0)), 2)
        self.after = [g[:1] for g in self.gaps[1:]]

    def before(self, i: int) -> str:
        """The end of what stands before a token."""
        return ((self.tokens[i - 1] if i else "") + self.gaps[i])[-CONTEXT:]

    def file(self) -> list[str]:
        n = len(self.tokens)
        return [f"tokens={_bucket(n, (5, 20, 100, 1000))}", f"dense={_bucket(1000 * len(DIGITS.findall(self.text)) // (n + 1), (1, 10, 100, 300))}"]

    def features(self, i: int) -> list[str]:
        """All features of a token but the file's."""
        return [
            *shape_features(self.tokens[i]), *before_features(self.before(i)),
            *after_features(self.after[i]), *place_features(self.place[i]),
        ]

    def labels(self) -> list[int]:
        """Begin for the first token that lies in a secret, inside for those after it."""
        spans, at, last, out = secrets_in(self.text), 0, None, []
        for start, end, first in zip(self.starts.tolist(), self.ends.tolist(), self.first.tolist(), strict=True):
            while at < len(spans) and spans[at][1] <= start:
                at += 1
            owner, i = None, at
            while owner is None and i < len(spans) and spans[i][0] < end:
                owner, i = (spans[i] if start < spans[i][1] else None), i + 1
            out.append(OUTSIDE if owner is None else INSIDE if owner is last and not first else BEGIN)
            last = owner
        return out

    def windows(self, tags: list[int]) -> list[range]:
        """Stretches of runs of about WINDOW tokens, none of which begins inside a secret."""
        cuts = []
        for i, (tag, first) in enumerate(zip(tags, self.first.tolist(), strict=True)):
            if first or (i - cuts[-1] >= WINDOW and tag != INSIDE):
                cuts.append(i)
        return [range(a, b) for a, b in zip(cuts, [*cuts[1:], len(tags)], strict=False)]


@dataclass
class Field:
    """Weights of features and of neighbouring tags."""

    weights: dict[str, list[float]]
    steps: list[list[float]]

    def unary(self, found: Iterable[str]) -> list[float]:
        begin = inside = outside = 0.0
        for f in found:
            w = self.weights.get(f)
            if w:
                begin, inside, outside = begin + w[0], inside + w[1], outside + w[2]
        return [begin, inside, outside]

    def decode(self, scores: list[list[float]], goes_on: bool = False) -> list[int]:
        """The best tags of tokens; before them stands an outside token, so they cannot start inside.

        With ``goes_on`` an outside token stands behind them too.
        """
        best = [s + self.steps[OUTSIDE][t] for t, s in enumerate(scores[0])]
        best[INSIDE] = -math.inf
        back = []
        for unary in scores[1:]:
            came, new = [], []
            for t in range(3):
                options = [best[p] + (-math.inf if t == INSIDE and p == OUTSIDE else self.steps[p][t]) for p in range(3)]
                came.append(options.index(max(options)))
                new.append(max(options) + unary[t])
            back.append(came)
            best = new
        if goes_on:
            best = [x + self.steps[t][OUTSIDE] for t, x in enumerate(best)]
        tags = [best.index(max(best))]
        for came in reversed(back):
            tags.append(came[tags[-1]])
        return tags[::-1]

    def bounds(self) -> tuple[float, float]:
        """What a tag other than outside may gain by its steps: before a token that is not inside, and before one that is.

        A token whose outside score leads by more is outside on every best path: tagged outside, and a token
        inside behind it tagged begin, the path would be better.
        """
        step = self.steps
        plain, inside = [], []
        for p in (BEGIN, INSIDE, OUTSIDE):
            for t in (BEGIN, INSIDE) if p != OUTSIDE else (BEGIN,):
                turn = step[p][t] - step[p][OUTSIDE]
                plain += [turn, *(turn + step[t][n] - step[OUTSIDE][n] for n in (BEGIN, OUTSIDE))]
                turn += step[t][INSIDE] - step[OUTSIDE][BEGIN]
                inside += [turn, *(turn + step[INSIDE][n] - step[BEGIN][n] for n in range(3))]
        return max(plain), max(inside)

    def marginals(self, scores: list[list[float]]) -> tuple[list[list[float]], list[list[list[float]]]]:
        """Chances of tags and of neighbouring tags, by forward and backward sums."""
        n = len(scores)
        step = [[math.exp(x) for x in row] for row in self.steps]
        step[OUTSIDE][INSIDE] = 0.0
        unary = [[math.exp(min(30.0, x - max(u))) for x in u] for u in scores]
        ahead = [[unary[0][t] * step[OUTSIDE][t] for t in range(3)]]
        for u in unary[1:]:
            row = [u[t] * sum(ahead[-1][p] * step[p][t] for p in range(3)) for t in range(3)]
            total = sum(row)
            ahead.append([x / total for x in row])
        behind = [[1.0] * 3]
        for u in reversed(unary[1:]):
            row = [sum(step[t][q] * u[q] * behind[0][q] for q in range(3)) for t in range(3)]
            total = sum(row) or 1.0
            behind.insert(0, [x / total for x in row])
        single = []
        for a, b in zip(ahead, behind, strict=True):
            row = [x * y for x, y in zip(a, b, strict=True)]
            single.append([x / sum(row) for x in row])
        double = []
        for i in range(n - 1):
            grid = [[ahead[i][p] * step[p][t] * unary[i + 1][t] * behind[i + 1][t] for t in range(3)] for p in range(3)]
            total = sum(map(sum, grid))
            double.append([[x / total for x in row] for row in grid])
        return single, double


def train(runs: list[tuple[list[list[str]], list[int]]]) -> Field:
    """Gradient ascent on the likelihood with a step per weight that shrinks by what it has moved."""
    field = Field({}, [[0.0] * 3 for _ in range(3)])
    moved: dict[str, list[float]] = {}
    moved_steps = [[1e-6] * 3 for _ in range(3)]
    for _ in range(EPOCHS):
        for found, tags in runs:
            single, double = field.marginals([field.unary(f) for f in found])
            for f, tag, chance in zip(found, tags, single, strict=True):
                slope = [(t == tag) - chance[t] for t in range(3)]
                for name in f:
                    w, m = field.weights.setdefault(name, [0.0] * 3), moved.setdefault(name, [1e-6] * 3)
                    for t in range(3):
                        m[t] += slope[t] ** 2
                        w[t] += RATE * slope[t] / math.sqrt(m[t])
            firsts = [(OUTSIDE, tags[0], [single[0] if p == OUTSIDE else [0.0] * 3 for p in range(3)])]
            for p, t, chance in [*firsts, *zip(tags, tags[1:], double, strict=False)]:
                for a in range(3):
                    for b in range(3):
                        slope = (a == p and b == t) - chance[a][b]
                        moved_steps[a][b] += slope**2
                        field.steps[a][b] += RATE * slope / math.sqrt(moved_steps[a][b])
    return field


def _training_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, rows, marks = [], [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            tokens = Tokens(text)
            tags, file = tokens.labels(), tokens.file()
            windows = tokens.windows(tags)
            secret = [w for w in windows if any(tags[i] != OUTSIDE for i in w)]
            clean = [w for w in windows if all(tags[i] == OUTSIDE for i in w)]
            clean.sort(key=lambda w: (zlib.crc32(" ".join(tokens.tokens[w.start : w.stop]).encode()), w.start))
            for window in secret + clean[:CLEAN_WINDOWS]:
                ids.append(doc_id)
                rows.append(json.dumps([[tokens.features(i) + file for i in window], [tags[i] for i in window]]))
                marks.append(any(tags[i] != OUTSIDE for i in window))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(rows, pa.string()), pa.array(marks, pa.bool_())], names=["doc_id", "run", "secret"]
        )


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether a document has a match, so that it can teach what a secret looks like."""
    for batch in batches:
        found = [bool(secrets_in(text)) for text in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.bool_())], names=["doc_id", "secret"])


def learn(documents: DataFrame, rows: int = SAMPLE_ROWS, runs: int = SAMPLE_RUNS) -> Field | None:
    """A field from documents with a match and clean ones, those with the lowest hash of their id each.

    All documents are looked at, so that rare secrets are learned from too; None if there is no match at all.
    """
    order = [hash_order(F.col("doc_id")), F.col("doc_id")]
    known = documents.where("doc_id is not null").mapInArrow(_matched, "doc_id long, secret boolean")
    known = stage(known.groupBy("doc_id").agg(F.max("secret").alias("secret")), "secret-documents")
    shown = known.where("secret").orderBy(*order).limit(rows // 2)
    chosen = shown.union(known.where("not secret").orderBy(*order).limit(rows - rows // 2)).select("doc_id")
    # A fixed number of ids, so a broadcast that does not grow with the data.
    texts = documents.join(F.broadcast(chosen), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = stage(texts.mapInArrow(_training_runs, "doc_id long, run string, secret boolean"), "secret-runs")
    order = [F.xxhash64("run"), F.col("run")]
    pairs = [r for r in found.where("secret").orderBy(*order).limit(runs // 2).collect()]
    if not pairs:
        return None
    pairs += found.where("not secret").orderBy(*order).limit(runs - len(pairs)).collect()
    # In the order of a hash, so that both kinds take turns.
    pairs.sort(key=lambda r: hashlib.sha256(r["run"].encode()).digest())
    return train([tuple(json.loads(r["run"])) for r in pairs])


class Remembered(dict):
    """Scores of groups of features by what they are taken from, remembered up to a bound.

    A key leads to its row of scores. Keys with the same learned features share a row, so that a token
    never seen before mostly costs its features and no sum. Tuples of features are few and share a row
    as they are; of lists only what is learned counts.
    """

    def __init__(self, field: Field, found: Callable[..., tuple[str, ...] | list[str]]):
        self.field, self.found, self.rows, self.same = field, found, np.empty((1024, 3)), {}
        self.is_learned = field.weights.__contains__

    def __missing__(self, key) -> int:
        learned = self.found(key)
        if type(learned) is list:
            learned = tuple(filter(self.is_learned, learned))
        n = self.same.get(learned)
        if n is None:
            n = self.same[learned] = len(self.same)
            if n == len(self.rows):
                self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
            self.rows[n] = self.field.unary(learned)
        self[key] = n
        return n

    def scores(self, keys: list) -> np.ndarray:
        if len(self) >= REMEMBERED:
            self.clear()
            self.same.clear()
        at = np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))
        return self.rows[at]


class Tagger:
    """The best tags of whole texts by a field."""

    def __init__(self, field: Field):
        self.field, self.bounds = field, field.bounds()
        groups = (shape_features, before_features, sign_features, after_features)
        self.shape, self.before, self.sign, self.after = (Remembered(field, f) for f in groups)
        self.place = np.array([field.unary(place_features(place)) for place in range(3)])
        learned = [f for f in field.weights if f.startswith("word=")]
        self.words = {f.removeprefix("word="): n for n, f in enumerate(learned, 1)}
        self.word = np.array([[0.0] * 3, *(field.weights[f] for f in learned)])

    def scores_before(self, tokens: Tokens) -> np.ndarray:
        """Scores of before_features of all tokens, without a string for each where the word is the token before."""
        n, gaps = len(tokens.tokens), tokens.gaps[1:-1]
        out, plain = np.empty((n, 3)), np.zeros(n, bool)
        if n > 1:
            lowered = " ".join(tokens.tokens[:-1]).lower().split(" ")
            out[1:] = self.word[np.fromiter(map(self.words.get, lowered, repeat(0)), np.int64, n - 1)] + self.sign.scores(gaps)
            plain[1:] = np.fromiter(map(str.isalpha, lowered), bool, n - 1) & (np.diff(tokens.starts) <= CONTEXT)
            if "_" in tokens.text:
                plain[1:] &= np.fromiter(("_" not in gap for gap in gaps), bool, n - 1)
        other = np.flatnonzero(~plain)
        out[other] = self.before.scores([tokens.before(i) for i in other.tolist()])
        return out

    def scores(self, tokens: Tokens) -> np.ndarray:
        groups = self.shape.scores(tokens.tokens) + self.scores_before(tokens) + self.after.scores(tokens.after)
        return groups + self.place[tokens.place] + np.array(self.field.unary(tokens.file()))

    def spans(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of the secrets of a text, by start."""
        tokens = Tokens(text)
        if not tokens.tokens:
            return []
        scores = self.scores(tokens)
        lead = scores[:, OUTSIDE] - scores[:, :OUTSIDE].max(axis=1)
        # What the next token of the run gains as inside rather than begin.
        gain = np.append(scores[1:, INSIDE] - scores[1:, BEGIN], 0.0)
        goes_on = np.append(~tokens.first[1:], False)
        plain, inside = self.bounds
        maybe = ~((lead > plain) & (~goes_on | (lead - gain > inside)))
        found: list[tuple[int, int]] = []
        at = np.flatnonzero(maybe)
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] - at[:-1] > 1) | tokens.first[at[1:]]
        edges = np.append(np.flatnonzero(new), len(at))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            low, high = int(at[a]), int(at[b - 1]) + 1
            for i, tag in enumerate(self.field.decode(scores[low:high].tolist(), bool(goes_on[high - 1])), low):
                if tag == BEGIN:
                    found.append((int(tokens.starts[i]), int(tokens.ends[i])))
                elif tag == INSIDE:
                    found[-1] = (found[-1][0], int(tokens.ends[i]))
        return found


def field_spans(text: str, tagger: Tagger, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that the field adds: whole secrets that no pattern match touches."""
    return [(s, 3, e) for s, e in tagger.spans(text) if not any(b[0] < e and s < b[2] for b in base)]


def find_secrets(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Spans are kind:start:end in code points, end exclusive, by start and then kind, over whole texts;
    a null text is empty. ``base_sha256`` is the digest of the pattern matches alone, ``spans`` has
    those that the field adds too. Repeated rows are scanned each; no rows give none.
    """
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    model = spark.sparkContext.broadcast(learn(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model.value) if model.value else None
        for batch in batches:
            counts, digests, spans = [[], [], []], [], []
            for text in batch.column(1).to_pylist():
                base = base_spans(text)
                for kind, column in enumerate(counts):
                    column.append(sum(s[1] == kind for s in base))
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                added = field_spans(text, tagger, base) if tagger else []
                spans.append(written(sorted(base + added)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return texts.mapInArrow(run, SCHEMA)
