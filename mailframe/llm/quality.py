"""Quality classification by nearest labelled neighbours in a latent-semantic space.

A document is a bag of terms: pairs of neighbouring character classes, and degrees of repetition.
Weights are term share times inverse document frequency over all documents; a truncated singular
value decomposition of a labelled sample gives the latent space. Every document meets every labelled
vector in blocked exact cosine products, and the labels of the nearest vote by similarity.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, held_out, labelled_sample

# Labelled documents of each class that are learned from, at most.
PER_CLASS = 2000
DIMENSIONS = 32
NEIGHBOURS = 25
# Votes count by this power of the cosine.
SHARPNESS = 8
THRESHOLD = 0.3
BLOCK = 256
# Shares of repeated words at which one more repetition term is present.
REPEATED = (0.02, 0.1, 0.3, 0.6)
REPEAT_WEIGHT = 40.0


def _classes() -> tuple[np.ndarray, int]:
    """A class per byte: small, capital, digit, line end, other control, blank, each ASCII sign, lead."""
    of = np.zeros(256, np.uint8)
    for byte in range(256):
        char = chr(byte)
        if byte >= 0xC0:
            of[byte] = 6
        elif byte >= 0x80:
            # Second bytes of Latin letters: capitals have the lower half.
            of[byte] = 1 if byte < 0xA0 else 0
        elif char.isalpha():
            of[byte] = 1 if char.isupper() else 0
        elif char.isdigit():
            of[byte] = 2
        elif char == "\n":
            of[byte] = 3
        elif char in " \t\r\x0b\x0c":
            of[byte] = 5
        elif byte < 32 or byte == 127:
            of[byte] = 4
    signs = [b for b in range(33, 127) if not chr(b).isalnum()]
    of[signs] = np.arange(7, 7 + len(signs))
    return of, 7 + len(signs)


CLASS, N_CLASSES = _classes()
LEAD = 6
N_TERMS = N_CLASSES * N_CLASSES + len(REPEATED)


def term_shares(text: str) -> np.ndarray:
    """Term weights before document frequencies: 0 everywhere for an empty text."""
    out = np.zeros(N_TERMS, np.float32)
    kinds = CLASS[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    kinds = kinds[kinds != LEAD].astype(np.int32)
    if len(kinds) > 1:
        counts = np.bincount(kinds[:-1] * N_CLASSES + kinds[1:], minlength=N_CLASSES * N_CLASSES)
        out[: len(counts)] = np.log1p(counts * (170.0 / len(kinds)))
    words = text.split()
    if len(words) > 1:
        share = sum(map(operator.eq, words, words[1:])) / len(words)
        out[N_CLASSES * N_CLASSES :] = [share >= least for least in REPEATED]
    return out


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n): documents of one partition that have a term; term -1 counts documents."""
    have, rows = np.zeros(N_TERMS, np.int64), 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            have += term_shares(text) > 0
            rows += 1
    terms = np.flatnonzero(have)
    yield pa.RecordBatch.from_arrays(
        [pa.array([-1, *terms.tolist()], pa.int32()), pa.array([rows, *have[terms].tolist()], pa.int64())],
        names=["term", "n"],
    )


def document_frequencies(documents: DataFrame) -> np.ndarray:
    """Inverse document frequencies over all documents; at most N_TERMS numbers reach the driver."""
    texts = documents.select(F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.mapInArrow(_frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    n = {r["term"]: r["n"] for r in rows}
    have = np.array([n.get(t, 0) for t in range(N_TERMS)], np.float64)
    idf = (np.log((1 + n.get(-1, 0)) / (1 + have)) + 0.1).astype(np.float32)
    idf[N_CLASSES * N_CLASSES :] = REPEAT_WEIGHT
    return idf


class LatentSpace:
    """Labelled documents as unit vectors of a latent space, with the weight of each vote."""

    def __init__(self, shares: np.ndarray, labels: np.ndarray, idf: np.ndarray, class_sizes: dict[int, int]):
        self.idf = idf
        self.labels = labels.astype(np.float32)
        weights = self._unit(shares * idf)
        # Directions of the sample's decomposition from its Gram matrix of terms.
        values, vectors = np.linalg.eigh(weights.T @ weights)
        self.axes = np.ascontiguousarray(vectors[:, np.argsort(-values)[:DIMENSIONS]])
        self.points = self._unit(weights @ self.axes)
        # A class of which only a part was sampled speaks for all of it.
        sizes = {c: max(1, int((labels == c).sum())) for c in (0, 1)}
        self.votes = np.array([class_sizes[int(c)] / sizes[int(c)] for c in labels], np.float32)
        self.prior = float((self.votes * self.labels).sum() / self.votes.sum())

    @staticmethod
    def _unit(rows: np.ndarray) -> np.ndarray:
        return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)

    def score(self, texts: list[str]) -> list[float]:
        """Chance of label 1 for each text: votes of the nearest; the prior for an empty vector."""
        out: list[float] = []
        for start in range(0, len(texts), BLOCK):
            shares = np.stack([term_shares(t) for t in texts[start : start + BLOCK]])
            cosines = self._unit(self._unit(shares * self.idf) @ self.axes) @ self.points.T
            k = min(NEIGHBOURS, cosines.shape[1])
            near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            votes = np.maximum(np.take_along_axis(cosines, near, 1), 0) ** SHARPNESS * self.votes[near]
            total = votes.sum(axis=1)
            liked = (votes * self.labels[near]).sum(axis=1)
            out += np.where(total > 0, liked / np.maximum(total, 1e-12), self.prior).clip(0, 1).astype(float).tolist()
        return out


def train(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Broadcast | None:
    """The labelled vectors, broadcast: at most 2 * per_class of DIMENSIONS numbers. None without labels."""
    spark = documents.sparkSession

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [term_shares(t).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(rows, pa.binary())], names=["doc_id", "label", "shares"]
            )

    sample = labelled_sample(documents, labels, "quality", per_class)
    rows = sample.select("doc_id", "text", "label").mapInArrow(shares, "doc_id long, label int, shares binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: r["doc_id"])
    known = labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count_distinct("doc_id").alias("n")).collect()}
    matrix = np.stack([np.frombuffer(r["shares"], np.float32) for r in rows])
    space = LatentSpace(
        matrix, np.array([r["label"] for r in rows]), document_frequencies(documents), {c: sizes.get(c, 1) for c in (0, 1)}
    )
    return spark.sparkContext.broadcast(space)


def score_quality(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Only labels of rows that are not held out are learned; a score depends on the text alone. A null
    text is empty and gets the prior; without any labels every score is 0.5. Predicted is 1 from a
    score of THRESHOLD. Repeated rows are scored each; no rows give none.
    """
    model = train(documents, labels, per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            scores = model.value.score(texts) if model else [0.5] * len(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(scores, pa.float64()),
                    pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()),
                ],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    texts = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return texts.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """Documents whose score reaches the threshold, with all their columns; rules as above."""
    model = train(documents, labels, per_class)
    if not model:
        return documents
    score = fresh("score", documents.columns)

    @F.pandas_udf("double")
    def scored(texts):
        import pandas as pd

        return pd.Series(model.value.score(texts.tolist()))

    found = documents.withColumn(score, scored(F.coalesce("text", F.lit(""))))
    return found.where(F.col(score) >= THRESHOLD).select(*documents.columns)
