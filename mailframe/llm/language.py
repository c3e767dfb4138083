"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to ORDER bytes with counts frozen after training. A
byte costs the code length that the longest known context gives it; bytes not seen there cost an
escape and what the next shorter context gives among the bytes it has not excluded. All languages
read the whole text, and the shortest code wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_order, held_out

ORDER = 3
# Training documents per language, about: the bound of what is learned from.
SAMPLE_ROWS = 1000
# Contexts kept, of all orders; the most visited ones of any language.
CONTEXTS = 8192
CHUNK = 1 << 18
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
# What stands before a text.
START = b"\n" * ORDER


def _lower(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)


def _grams(text: str) -> np.ndarray:
    """Every byte of a text with the ORDER bytes before it, as one number."""
    p = np.concatenate([np.frombuffer(START, np.uint8), _lower(text)]).astype(np.uint32)
    return (p[:-3] << 24) | (p[1:-2] << 16) | (p[2:-1] << 8) | p[3:]


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang in sorted(set(langs)):
            of_lang = [t for t, x in zip(texts, langs, strict=True) if x == lang]
            grams, counts = np.unique(np.concatenate([_grams(t) for t in of_lang]), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(grams)), pa.array(grams.astype(np.int64)), pa.array(counts)],
                names=["lang", "gram", "n"],
            )


def gram_counts(documents: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(lang, gram, n) over a bounded sample per language of rows that are not held out.

    Sampled are the rows whose hash of the id falls into a share of all hashes that gives about
    ``sample_rows`` rows of the language, so that no language meets in one task; rows are chosen on
    the narrow columns and their texts read afterwards.
    """
    usable = documents.select("doc_id", "lang", "text").where(
        "doc_id is not null and lang is not null and text is not null"
    ).where(~held_out(F.col("doc_id")))
    ids = usable.select("doc_id", "lang").distinct()
    sizes = ids.groupBy("lang").agg(F.count(F.lit(1)).alias("of_lang"))
    place = F.pmod(hash_order(F.col("doc_id")), F.lit(1 << 31)) / float(1 << 31)
    chosen = ids.join(sizes, "lang").where(place < F.lit(float(sample_rows)) / F.col("of_lang"))
    texts = usable.join(chosen.select("doc_id", "lang"), ["doc_id", "lang"], "left_semi")
    return texts.select("lang", "text").distinct().mapInArrow(_count_grams, "lang string, gram long, n long").groupBy(
        "lang", "gram"
    ).agg(F.sum("n").alias("n"))


class Trees:
    """The frozen context trees of all languages as one table of code lengths in bits."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], contexts: int = CONTEXTS):
        self.langs = sorted(counts)
        # Nodes: contexts of 1 to ORDER bytes, the most visited of any language.
        visits: dict[tuple[int, int], int] = {}
        tables: list[dict[tuple[int, int], np.ndarray]] = []
        for lang in self.langs:
            grams, n = counts[lang]
            symbols = grams & 255
            table = {}
            for order in range(ORDER + 1):
                context = (grams >> 8) & ((1 << (8 * order)) - 1)
                keys, at = np.unique(context, return_inverse=True)
                dense = np.zeros((len(keys), 256), np.float32)
                np.add.at(dense, (at, symbols), n)
                totals = dense.sum(axis=1)
                for key, row, total in zip(keys.tolist(), dense, totals.tolist(), strict=True):
                    table[order, key] = row
                    visits[order, key] = max(visits.get((order, key), 0), total)
            tables.append(table)
        ranked = sorted(visits, key=lambda node: (-visits[node], node))
        # A context's shorter contexts are visited at least as often, so that they are kept with it.
        self.nodes = sorted({(0, 0), *ranked[:contexts]})
        place = {node: i for i, node in enumerate(self.nodes)}
        cost = np.zeros((len(self.nodes), 256, len(self.langs)), np.float32)
        for k, table in enumerate(tables):
            chance = np.zeros((len(self.nodes), 256))
            for i, (order, key) in enumerate(self.nodes):
                if order:
                    parent = chance[place[self._shorter(order, key, place)]]
                else:
                    parent = np.full(256, 1 / 256)
                row = table.get((order, key))
                chance[i] = parent if row is None else self._blend(row, parent)
            cost[:, :, k] = -np.log2(chance)
        self.cost = cost.reshape(len(self.nodes) * 256, len(self.langs))

    @staticmethod
    def _shorter(order: int, key: int, place: dict) -> tuple[int, int]:
        while order:
            order -= 1
            key &= (1 << (8 * order)) - 1
            if (order, key) in place:
                return order, key
        return 0, 0

    @staticmethod
    def _blend(row: np.ndarray, parent: np.ndarray) -> np.ndarray:
        """Seen bytes by their counts; an escape, as likely as there are distinct ones, to the rest."""
        seen = row > 0
        total, distinct = row.sum(), seen.sum()
        left = parent[~seen].sum()
        escape = distinct / (total + distinct) if left > 0 else 0.0
        out = row * ((1 - escape) / total)
        if left > 0:
            out = np.where(seen, out, parent * (escape / left))
        return out

    def index(self) -> np.ndarray:
        """The longest known context of every three bytes, by their number."""
        found = np.zeros(1, np.uint16)
        for order in range(1, ORDER + 1):
            found = np.tile(found, 256)
            at = [(key, i) for i, (o, key) in enumerate(self.nodes) if o == order]
            if at:
                keys, places = np.array(at).T
                found[keys] = places
        return found


def code_lengths(text: str, index: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Bits of the whole text in each language."""
    bits = np.zeros(cost.shape[1])
    p = np.concatenate([np.frombuffer(START, np.uint8), _lower(text)])
    for start in range(0, len(p) - ORDER, CHUNK):
        q = p[start : start + CHUNK + ORDER].astype(np.int32)
        context = (q[:-3] << 16) | (q[1:-2] << 8) | q[2:-1]
        bits += cost.take(index[context].astype(np.int32) * 256 + q[3:], axis=0).sum(axis=0, dtype=np.float64)
    return bits


def predict_language(documents: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Learned from text and language of rows that are not held out; prediction sees the text alone.
    ``score`` is the posterior of the winner under equal priors; ties go to the language that sorts
    first. A text that is null or has no letter is ``und`` with score 0, as is every text if there
    was nothing to learn from. Repeated rows are predicted each; no rows give none.
    """
    spark = documents.sparkSession
    # Bounded by the sample: at most as many numbers as the sampled texts have bytes.
    got = gram_counts(documents, sample_rows).orderBy("lang", "gram").toPandas()
    counts = {
        lang: (part["gram"].to_numpy(np.int64), part["n"].to_numpy(np.int64)) for lang, part in got.groupby("lang")
    }
    trees = spark.sparkContext.broadcast(Trees(counts)) if counts else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if trees:
            model = trees.value
            index = model.index()
        for batch in batches:
            langs, scores = [], []
            for text, letters in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if not letters or not trees:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                bits = code_lengths(text, index, model.cost)
                best = int(bits.argmin())
                langs.append(model.langs[best])
                scores.append(float(1 / np.exp2(np.minimum(bits[best] - bits, 0)).sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    texts = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text",
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"),
    )
    return texts.mapInArrow(run, SCHEMA)
