"""Toxicity by the nearest labelled examples under exact cosine of weighted TF-IDF vectors.

Terms are words and word beginnings (inflected forms share a beginning). The vocabulary holds all terms
that two examples of a bounded labelled sample have, toxic or not; their document frequencies are
counted over all documents. A term weighs its frequency in the text, times its inverse document
frequency, times the root of the likelihood ratio that ties it to either class. Examples lie in an inverted index: postings of rare
terms, and for the most common terms blocks of alike examples, with each term's largest weight in a block. A document
scores the blocks whose upper bound reaches the nearest examples found.
"""

from __future__ import annotations

import hashlib
from array import array
from collections import Counter
from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import held_out, labelled_sample

# Labelled documents of each class that are learned from, at most; of these, a term is in so many at least.
PER_CLASS = 4000
LEAST_EXAMPLES = 2
BEGINNINGS = (4, 5, 6)
EXAMPLE = "doc_id long, label int, terms array<int>, counts array<int>"
NEIGHBOURS = 15
BLOCK_ROWS = 64
# Terms whose weights are a matrix, the most common ones; those of all others are postings.
COMMON_TERMS = 2048
# Blocks hold alike examples: clusters of them by their most common terms. Any clusters give the same neighbours.
CLUSTERS, CLUSTER_TERMS, CLUSTER_ROUNDS = 32, 512, 6
# Texts that are searched for together.
TOGETHER = 256
# Blocks that a search scores first.
FIRST_BLOCKS = 8
# The prior counts as much as one example of this similarity.
PRIOR_WEIGHT = 0.3
THRESHOLD = 0.5
# Texts' terms whose votes a task remembers, at most.
REMEMBERED = 20_000
# Words whose terms a task remembers, at most.
REMEMBERED_WORDS = 200_000
# ASCII signs separate words, A-Z are lowered, all other bytes stay.
FOLD = bytes(32 if b < 128 and not chr(b).isalnum() else b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


def terms_of(word: bytes) -> list[bytes]:
    """A word and its beginnings, these marked by a final star."""
    return [word, *(word[:length] + b"*" for length in BEGINNINGS if len(word) >= length)]


class KnownTerms(dict):
    """The terms of words that are in the vocabulary, remembered up to a bound: words are numbered, their terms one list."""

    def __init__(self, place: dict[bytes, int]):
        self.place = place
        self.forget()

    def forget(self) -> None:
        self.clear()
        # Word number i has the terms from edge i to the next one; the first entry is of no word.
        self.terms, self.edges = array("i", [0]), array("q", [1])

    def __missing__(self, word: bytes) -> int:
        self.terms.extend([t for t in map(self.place.get, terms_of(word)) if t is not None])
        self.edges.append(len(self.terms))
        found = self[word] = len(self.edges) - 2
        return found

    def _of(self, words: Collection[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The known terms of words, one word after the other, and how many each word has."""
        if len(self) >= REMEMBERED_WORDS:
            self.forget()
        numbers = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        edges = np.frombuffer(self.edges, np.int64)
        starts, ends = edges.take(numbers), edges.take(numbers + 1)
        return np.frombuffer(self.terms, np.int32).take(_ranges(starts, ends)), ends - starts

    def distinct(self, text: str) -> np.ndarray:
        """The known terms of a text, in order."""
        return np.unique(self._of(set(words_of(text)))[0])

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The known terms of a text, in order, and how often it has them."""
        times = Counter(words_of(text))
        terms, sizes = self._of(times)
        counts = np.repeat(np.fromiter(times.values(), np.int64, len(times)), sizes)
        order = np.argsort(terms)
        terms = terms[order]
        first = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]]) if len(terms) else np.empty(0, np.int64)
        return terms[first], np.add.reduceat(counts[order], first) if len(terms) else counts


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = sorted({term for word in set(words_of(text)) for term in terms_of(word)})
            yield pa.RecordBatch.from_arrays(
                [pa.array([label] * len(found), pa.int32()), pa.array(found, pa.binary())], names=["label", "term"]
            )


def vocabulary(sample: DataFrame, sizes: dict[int, int]) -> tuple[list[bytes], np.ndarray]:
    """Terms of LEAST_EXAMPLES examples, and the log-likelihood ratio of their document counts in the classes."""
    counts = sample.select("label", "text").mapInArrow(_term_rows, "label int, term binary").groupBy("term").agg(
        F.sum("label").cast("double").alias("a"), F.sum(1 - F.col("label")).cast("double").alias("b")
    )
    n1, n0 = float(sizes[1]), float(sizes[0])
    share = (F.col("a") + F.col("b")) / (n1 + n0)

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    ratio = 2 * (
        part(F.col("a"), n1 * share) + part(n1 - F.col("a"), n1 * (1 - share))
        + part(F.col("b"), n0 * share) + part(n0 - F.col("b"), n0 * (1 - share))
    )
    rows = counts.where(F.col("a") + F.col("b") >= LEAST_EXAMPLES).select("term", ratio.alias("ratio")).orderBy("term").toArrow()
    return rows["term"].to_pylist(), np.maximum(rows["ratio"].to_numpy(), 0.0)


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one after the other."""
    sizes = ends - starts
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


# Terms and their weights, as a mapping or as two arrays.
Vector = dict[int, float] | tuple[np.ndarray, np.ndarray]


def _arrays(vector: Vector) -> tuple[np.ndarray, np.ndarray]:
    if not isinstance(vector, dict):
        return vector
    return np.fromiter(vector, np.int32, len(vector)), np.fromiter(vector.values(), np.float64, len(vector))


class BlockMaxIndex:
    """Unit vectors of examples, alike ones in blocks, under the terms that they have.

    Pickled, it is a list of terms and weights by example. A process that searches makes of it the
    postings of rare terms, the weights of the most common terms as a matrix, and the largest weight of each
    of those terms in each block.
    """

    def __init__(self, vectors: list[Vector], labels: list[int], n_terms: int):
        self.labels = np.array(labels, np.float64)
        self.n_terms, self.n_blocks = n_terms, -(-max(len(vectors), 1) // BLOCK_ROWS)
        pairs = [_arrays(v) for v in vectors]
        sizes = np.array([len(t) for t, _ in pairs], np.int64)
        frequency = np.zeros(n_terms, np.int64)
        for terms, _ in pairs:
            frequency[terms] += 1
        # The most common terms first; fewer than BLOCK_ROWS examples of a term are postings.
        common = np.argsort(-frequency, kind="stable")[:COMMON_TERMS]
        common = common[frequency[common] >= BLOCK_ROWS]
        self.n_common = len(common)
        self.column = np.full(n_terms, -1, np.int32)
        self.column[common] = np.arange(len(common))
        # The row of each place: blocks hold examples of one cluster after the other.
        self.row = np.argsort(_clusters(pairs, self.column), kind="stable")
        order = [pairs[i] for i in self.row]
        self.starts = np.r_[0, np.cumsum(sizes[self.row])]
        # Weights have 24 bits, as every executor gets a copy.
        self.terms, self.weights = np.empty(self.starts[-1], np.int32), np.empty(self.starts[-1], np.float32)
        for (terms, weights), a, b in zip(order, self.starts, self.starts[1:], strict=False):
            by = np.argsort(terms, kind="stable")
            self.terms[a:b], self.weights[a:b] = terms[by], weights[by]
        self.lists = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"lists": None}

    def _lists(self) -> tuple[np.ndarray, ...]:
        """Starts, places and weights of the postings of rare terms; weights of common terms; their maxima by block."""
        if self.lists is None:
            place = np.repeat(np.arange(len(self.row), dtype=np.int32), np.diff(self.starts))
            column = self.column[self.terms]
            at = np.flatnonzero(column < 0)
            at = at[np.argsort(self.terms[at], kind="stable")]
            starts = np.searchsorted(self.terms[at], np.arange(self.n_terms + 1))
            rare = starts, place[at], self.weights[at]
            dense = np.zeros((self.n_blocks * BLOCK_ROWS, self.n_common), np.float32)
            at = np.flatnonzero(column >= 0)
            dense[place[at], column[at]] = self.weights[at]
            self.lists = *rare, dense, dense.reshape(self.n_blocks, BLOCK_ROWS, self.n_common).max(axis=1)
        return self.lists

    def nearest(self, vector: Vector, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """(rows, cosines) of the k nearest examples of positive cosine, all weights exact."""
        return self.nearest_of([vector], k)[0]

    def nearest_of(self, vectors: list[Vector], k: int = NEIGHBOURS) -> list[tuple[np.ndarray, np.ndarray]]:
        """The nearest examples of some vectors, as ``nearest`` has them.

        Postings of rare terms are added up for all examples. With the largest weights of common terms they
        bound what a block can hold: those of the highest bounds are scored first, of the others those whose
        bound reaches the k-th cosine found. These scores have 24 bits: all that may be among the k nearest, by the
        error they can have, are added up again in double precision. Equal cosines stay in the order of the examples.
        """
        starts, places, weights, dense, most = self._lists()
        pairs = [_arrays(v) for v in vectors]
        slack = np.float32((self.n_common + 64) * 2.0**-23)
        asked = np.zeros((len(pairs), self.n_common), np.float32)
        rare = np.zeros((len(pairs), len(dense)), np.float32)
        for i, (terms, found) in enumerate(pairs):
            column = self.column[terms]
            asked[i, column[column >= 0]] = found[column >= 0]
            terms, found = terms[column < 0], found[column < 0]
            a, b = starts[terms], starts[terms + 1]
            at = _ranges(a, b)
            part = weights.take(at, mode="clip") * np.repeat(found.astype(np.float32), b - a)
            rare[i] = np.bincount(places.take(at, mode="clip"), part, len(dense))
        bounds = asked @ most.T + rare.reshape(len(pairs), self.n_blocks, BLOCK_ROWS).max(axis=2) + slack
        scores = np.full(rare.shape, -1, np.float32)
        # What the k-th cosine is at least, by the blocks of the highest bounds.
        least = np.zeros(len(pairs), np.float32)
        first = np.zeros(bounds.shape, bool)
        np.put_along_axis(first, np.argsort(-bounds, axis=1)[:, :FIRST_BLOCKS], True, axis=1)
        for wanted in (first, ~first):
            wanted &= bounds >= least[:, None]
            for block in np.flatnonzero(wanted.any(axis=0)):
                some, part = np.flatnonzero(wanted[:, block]), slice(block * BLOCK_ROWS, (block + 1) * BLOCK_ROWS)
                scores[some, part] = rare[some, part] + asked[some] @ dense[part].T
            if len(dense) > k:
                least = np.maximum(np.partition(scores, -k, axis=1)[:, -k] - slack, 0)
        out, asked_of, none = [], np.zeros(self.n_terms), [np.empty(0, np.int32)]
        for (terms, found), score, bound in zip(pairs, scores, least, strict=True):
            near = np.flatnonzero((score > 0) & (score >= bound - slack))
            a, b = self.starts[near], self.starts[near + 1]
            lists = [slice(*edges) for edges in zip(a.tolist(), b.tolist(), strict=True)]
            asked_of[terms] = found
            part = asked_of.take(np.concatenate([self.terms[x] for x in lists] or none), mode="clip")
            part *= np.concatenate([self.weights[x] for x in lists] or none)
            exact = np.bincount(np.repeat(np.arange(len(near)), b - a), part, len(near))
            asked_of[terms] = 0
            rows = self.row[near]
            best = np.lexsort((rows, -exact))[:k]
            out.append((rows[best], exact[best]))
        return out


def _clusters(pairs: list[tuple[np.ndarray, np.ndarray]], column: np.ndarray) -> np.ndarray:
    """A cluster for each vector by its most common terms, after some rounds of spherical k-means."""
    points = np.zeros((len(pairs), min(len(column), CLUSTER_TERMS)), np.float32)
    for i, (terms, weights) in enumerate(pairs):
        at = column[terms]
        seen = (at >= 0) & (at < CLUSTER_TERMS)
        points[i, at[seen]] = weights[seen]
    centres = points[:: -(-max(len(pairs), 1) // CLUSTERS)]
    own = np.zeros(len(pairs), np.int64)
    for _ in range(CLUSTER_ROUNDS if len(pairs) else 0):
        own = np.argmax(points @ centres.T, axis=1)
        member = np.zeros((len(centres), len(pairs)), np.float32)
        member[own, np.arange(len(pairs))] = 1
        centres = member @ points
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    return own


def _unit(terms: np.ndarray, counts: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights by frequency in the text and ``weight`` of the terms, at length 1; those of weight 0 are left out."""
    found = counts * weight[terms]
    some = found > 0
    found = found[some]
    return terms[some].astype(np.int32), found / np.sqrt((found * found).sum()) if len(found) else found


def score_toxicity(
    documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS
) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, evidence.

    Only labels of rows that are not held out are learned; a score depends on the text alone: the
    votes of the nearest examples, weighted by cosine and by how many rows an example stands for,
    with the share of toxic examples among those without any term as prior. Texts without a term, empty
    or null, get that prior. Without labels every score is 0. ``evidence`` lists the ids of the
    nearest examples. Repeated rows are scored each; no rows give none.
    """
    spark = documents.sparkSession
    sample = stage(labelled_sample(documents, labels, "toxic", per_class), "toxic-sample")
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    known = labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count_distinct("doc_id").alias("n")).collect()}
    sizes = {c: sizes.get(c, 0) for c in (0, 1)}
    terms, ratios = vocabulary(sample, sizes) if sizes[0] and sizes[1] else ([], np.empty(0))
    n_terms = len(terms)
    words = spark.sparkContext.broadcast({term: i for i, term in enumerate(terms)})
    del terms
    texts = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"),
        F.coalesce("text", F.lit("")).alias("text"),
    )

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many documents have each term, and under -1 how many there are."""
        place, seen, n = words.value, np.zeros(len(words.value) + 1, np.int64), 0
        known = KnownTerms(place)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen[known.distinct(text)] += 1
                n += 1
        seen[-1] = n
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.where(at == len(place), -1, at), pa.int64()), pa.array(seen[at], pa.int64())], names=["term", "n"]
        )

    counted = texts.select("text").mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    frequency = np.zeros(n_terms + 1, np.int64)
    frequency[counted["term"].to_numpy()] = counted["n"].to_numpy()
    weight = (np.log((1 + frequency[-1]) / (1 + frequency[:-1])) + 1) * np.sqrt(ratios)

    # The examples: at most 2 * per_class lists of numbers.
    listed = sample.select("doc_id", "label", "text").mapInArrow(_example_rows(words), EXAMPLE).orderBy("doc_id").toArrow()
    columns = (listed["doc_id"].to_pylist(), listed["label"].to_pylist(), _lists(listed["terms"]), _lists(listed["counts"]))
    rows = [{"doc_id": i, "label": label, "vector": _unit(t, n, weight)} for i, label, t, n in zip(*columns, strict=True)]
    del listed, columns
    stands_for = {c: max(totals.get(c, 0), sizes[c]) / max(sizes[c], 1) for c in (0, 1)}
    bare = [stands_for[r["label"]] * np.array([1, r["label"]]) for r in rows if not len(r["vector"][0])]
    bare_all, bare_toxic = np.sum(bare, axis=0) if bare else (0.0, 0.0)
    prior = float(bare_toxic / bare_all) if bare_all else 0.0
    examples = [r for r in rows if len(r["vector"][0])]
    index = BlockMaxIndex([r["vector"] for r in examples], [r["label"] for r in examples], n_terms)
    ids = np.array([r["doc_id"] for r in examples], np.int64)
    votes = np.array([stands_for[r["label"]] for r in examples])
    model = spark.sparkContext.broadcast((index, ids, votes, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, ids, votes, weight = model.value
        known = KnownTerms(words.value)
        seen: dict[bytes, tuple[float, list[int]]] = {}

        def vote(near: np.ndarray, cosines: np.ndarray) -> tuple[float, list[int]]:
            weights = cosines * votes[near]
            liked = (weights * index.labels[near]).sum()
            return float((liked + PRIOR_WEIGHT * prior) / (weights.sum() + PRIOR_WEIGHT)), ids[near].tolist()

        def results(texts: list[str]) -> list[tuple[float, list[int]]]:
            keys, new = [], {}
            for text in texts:
                found, counts = known.of(text)
                keys.append(hashlib.blake2b(found.tobytes() + counts.tobytes(), digest_size=16).digest())
                if keys[-1] not in seen and keys[-1] not in new:
                    vector = _unit(found, counts, weight)
                    if len(vector[0]):
                        new[keys[-1]] = vector
                    else:
                        seen[keys[-1]] = prior, []
            for key, near in zip(new, index.nearest_of(list(new.values())) if new else [], strict=True):
                seen[key] = vote(*near)
            out = [seen[key] for key in keys]
            if len(seen) > REMEMBERED:
                seen.clear()
            return out

        for batch in batches:
            texts, scores, evidence = batch.column(2), [], []
            for start in range(0, len(texts), TOGETHER):
                for score, near in results(texts.slice(start, TOGETHER).to_pylist()):
                    scores.append(score)
                    evidence.append(near)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(scores, pa.float64()),
                    pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()), pa.array(evidence, pa.list_(pa.int64())),
                ],
                names=["doc_id", "held_out", "score", "predicted", "evidence"],
            )

    return texts.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, evidence array<long>")


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.asarray(x.values) for x in column]


def _example_rows(words):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = KnownTerms(words.value)
        for batch in batches:
            found = [known.of(x) for x in batch.column(2).to_pylist()]
            columns = [pa.array([f[i].tolist() for f in found], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "label", "terms", "counts"])

    return run
