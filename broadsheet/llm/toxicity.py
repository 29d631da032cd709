"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its distinct words, word pairs, and word pairs with one word between (lower case, trimmed of
punctuation), hashed into 2**BITS places. Training runs over a sample of labelled rows, bounded by ``MOST_ROWS`` (those with the
smallest hashed ids; of several rows of an id one) and by ``MOST_FEATURES`` (rows behind that many features are not learnt), in
one task; the L1 term leaves few weights, which are broadcast: at most 2**BITS, whatever the corpus. Scoring streams every whole text.

Defined results: null text is empty; an empty text has the bias alone; labels that are null are no labels; of several
labels of an id the largest counts; rows with null ids are scored and never learnt from; repeated rows are scored each
and learnt once; columns of any name may be there; without labelled rows every score is 0; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.llm import wordhash

BITS = 20
#: Labelled rows that training looks at, at most.
MOST_ROWS = 16_384
#: Features of all rows that training holds in memory, at most (4 bytes each).
MOST_FEATURES = 64_000_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 0.1, 8.0, 0.01

_TRIM = np.zeros(256, bool)
_TRIM[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def features(texts: wordhash.Texts) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every occurrence, in no order."""
    buf, starts, ends = texts.lowered(), texts.starts, texts.ends.copy()
    starts = starts.copy()
    for _ in range(3):  # quotes, brackets and stops around a word
        on = (starts < ends - 1) & _TRIM[buf[starts]] if len(starts) else np.zeros(0, bool)
        starts[on] += 1
        on = (starts < ends - 1) & _TRIM[buf[ends - 1]] if len(starts) else np.zeros(0, bool)
        ends[on] -= 1
    words = wordhash.byte_hashes(buf, starts, ends)
    docs, places = [texts.doc], [words]
    for gap in (1, 2):
        same = texts.doc[gap:] == texts.doc[:-gap]
        pair = wordhash.mix(words[:-gap] * np.uint64(0x9FB21C651E98DF25 + 2 * gap) + words[gap:])
        docs.append(texts.doc[gap:][same])
        places.append(pair[same])
    return np.concatenate(docs), (np.concatenate(places) >> np.uint64(64 - BITS)).astype(np.int64)


class Ftrl:
    """FTRL-proximal: each coordinate has its own learning rate; weights below the L1 term are exactly 0."""

    def __init__(self):
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
        self.bias = 1 << BITS

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, l1 = self.z[at], np.where(at == self.bias, 0.0, L1)
        w = -(z - np.sign(z) * l1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, self.bias)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def sample_labels(labels: DataFrame, usable: Column, id_col: str, label_col: str, most: int = MOST_ROWS) -> DataFrame:
    """(id, label) of at most ``most`` usable labelled ids: those with the smallest hashes."""
    rows = labels.where(usable & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    per_id = rows.groupBy(F.col(id_col).alias("label_id")).agg(F.max(label_col).cast("int").alias("label"))
    return per_id.orderBy(F.xxhash64("label_id"), "label_id").limit(most)


def train(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the weights that are not 0; the bias is at 2**BITS."""
    mine = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    rows = mine.join(F.broadcast(sample), F.col("doc") == F.col("label_id"))
    once = rows.groupBy("label_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = once.select(F.xxhash64("label_id").alias("order"), "text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[tuple[np.ndarray, int]] = []
        held = 0
        for batch in batches:
            labels = batch.column(2).to_pylist()
            for row, texts in wordhash.steps(batch.column(1)):
                doc, place = features(texts)
                both = np.unique((doc << BITS) | place)
                doc, place = both >> BITS, (both & ((1 << BITS) - 1)).astype(np.int32)
                cuts = np.searchsorted(doc, np.arange(len(texts.bounds)))
                held += len(place)
                if held > MOST_FEATURES:
                    continue
                seen += [(place[a:b], labels[row + i]) for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))]
        model = Ftrl()
        for _ in range(EPOCHS if seen else 0):
            for place, label in seen:
                model.learn(place.astype(np.int64), label)
        w = model.weights(np.arange((1 << BITS) + 1))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int64()), "w": pa.array(w[at], pa.float64())})

    # The bounded sample goes to one task, in a fixed order.
    got = rows.repartition(1).sortWithinPartitions("order", "text").mapInArrow(run, "at long, w double").toArrow()
    return got.column("at").to_numpy(), got.column("w").to_numpy()


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, score_col: str = "score") -> DataFrame:
    """id_col, the columns ``keep``, and score_col (0 to 1) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast((model[0], model[1].astype(np.float32)))
    keep = keep or []
    names = [f"keep_{i}" for i in range(len(keep))]
    rows = docs.select(F.col(id_col).alias("keep_id"), F.col(text_col).cast("string").alias("text"), *[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)])
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"{n} {kinds[n]}" for n in ["keep_id", *names]) + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w = sent.value
        dense = np.zeros((1 << BITS) + 1, np.float32)
        dense[at] = w
        has = dense != 0
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for row, texts in wordhash.steps(batch.column(1)):
                doc, place = features(texts)
                on = has[place]
                both = np.unique((doc[on] << BITS) | place[on])
                n = len(texts.bounds) - 1
                out[row : row + n] = np.bincount(both >> BITS, dense[both & ((1 << BITS) - 1)], n)
            probability = 1 / (1 + np.exp(-np.clip(out + float(dense[-1]), -35, 35)))
            if not len(at):
                probability = np.zeros(batch.num_rows)
            columns = [batch.column(0), *(batch.column(i) for i in range(2, batch.num_columns)), pa.array(probability)]
            yield pa.RecordBatch.from_arrays(columns, names=["keep_id", *names, "score"])

    return rows.mapInArrow(run, schema).select(F.col("keep_id").alias(id_col), *[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], F.col("score").alias(score_col))


def toxicity_scores(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", keep: list[str] | None = None) -> DataFrame:
    """Fit on a bounded sample of the usable labels and score every document."""
    sample = sample_labels(labels, usable, id_col, label_col)
    return score(docs, train(docs, sample, id_col, text_col), id_col, text_col, keep)
