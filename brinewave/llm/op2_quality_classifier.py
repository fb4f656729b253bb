"""Quality classifier: logistic regression on hashed word n-grams, trained with
follow-the-regularised-leader (proximal) updates, scored as sparse dot products.

A whitespace word is three tokens: its core (letters and digits, lower case),
its affix (the ASCII punctuation around the core) and its shape. Features are
the unigrams and bigrams of each of the three, and the bigram of a word with
itself whatever the word, hashed into ``1 << BITS`` buckets; a feature's value is its count over the text's words, so long and
short texts have the same scale. Whole texts are read.

The model is fitted on a bounded sample of the labelled rows (``TRAIN_DOCS``);
the features of those rows are computed by the executors.

Defined results: a null or empty text has no features and gets the score of
the bias alone; without labelled rows every score is 0.5; repeated rows are
scored one by one; rows without a usable label (null, not 0 or 1) are not
learned from; a very long text is scored whole, in time that grows with its
words; a score of just 0.5 predicts 1; an empty table gives an empty result;
input columns named like an output column give way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _ODD, bucket_of, in_arrow, labelled_sample, mix, other_columns, small_batches, table, text_bytes

BITS = 19
#: Labelled rows that the model is fitted on, about.
TRAIN_DOCS = 6000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
#: Distinct words that a worker remembers the tokens of.
CACHE = 200_000
PUNCT = bytes(b for b in range(33, 127) if not chr(b).isalnum())

_SHAPES = {(0, 0): 11, (1, 0): 12, (0, 1): 13, (1, 1): 14}
_U = np.uint64
_DOUBLED = _U(xxhash.xxh3_64_intdigest(b"doubled", 4))


class Tokens(dict):
    """word -> (core, affix, shape) hashes, worked out once for each distinct word."""

    def __missing__(self, word: bytes) -> tuple[int, int, int]:
        core = word.strip(PUNCT)
        at = word.find(core)
        affix = word[:at] + b" " + word[at + len(core) :] if len(core) < len(word) else b""
        text = core.decode("utf-8", "replace")
        shape = 15 if core.isdigit() else 16 if not core else _SHAPES[text.isupper() and len(text) > 1, text[:1].isupper() and not text.isupper()]
        found = (xxhash.xxh3_64_intdigest(text.lower().encode(), 1), xxhash.xxh3_64_intdigest(affix, 2), xxhash.xxh3_64_intdigest(str(shape).encode(), 3))
        if len(self) >= CACHE:
            self.clear()
        self[word] = found
        return found


def features(data: bytes, tokens: Tokens, bits: int = BITS) -> tuple[np.ndarray, int]:
    """Buckets of every n-gram occurrence of a text, and its number of words."""
    words = data.split()
    if not words:
        return np.empty(0, np.int64), 0
    kinds = np.array([tokens[w] for w in words], np.uint64)
    pairs = mix(kinds[:-1] * _ODD[0] + kinds[1:] * _ODD[1])
    doubled = np.full(np.count_nonzero(kinds[:-1, 0] == kinds[1:, 0]), _DOUBLED)
    return (np.concatenate((kinds.ravel(), pairs.ravel(), doubled)) >> _U(64 - bits)).astype(np.int64), len(words)


def sparse(data: bytes | None, tokens: Tokens, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    index, n = features(data or b"", tokens, bits)
    at, counts = np.unique(index, return_counts=True)
    return at, counts / max(n, 1)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    bits: int


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS) -> Model:
    """FTRL-proximal over the rows, in the order given, ``epochs`` times."""
    size = (1 << bits) + 1  # the last coordinate is the bias
    z, n = np.zeros(size), np.zeros(size)

    def weights(at: np.ndarray | slice) -> np.ndarray:
        za, na = z[at], n[at]
        l1 = np.full(len(za), L1)
        l1[-1 if isinstance(at, slice) else at == size - 1] = 0.0
        return np.where(np.abs(za) <= l1, 0.0, -(za - np.sign(za) * l1) / ((BETA + np.sqrt(na)) / ALPHA + L2))

    for _ in range(epochs):
        for index, values, label in rows:
            at, x = np.append(index, size - 1), np.append(values, 1.0)
            w = weights(at)
            g = (1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(slice(None))
    return Model(w[:-1].astype(np.float32), float(w[-1]), bits)


def fit(docs: DataFrame, labels: DataFrame, usable, label: str = "quality", key: str = "doc_id", text: str = "text", bound: int = TRAIN_DOCS, bits: int = BITS) -> Model:
    picked = labelled_sample(docs, labels, label, usable, bound, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in small_batches(batches, "text"):
            found = [sparse(t, tokens, bits) for t in text_bytes(batch.column(3))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([a.astype(np.int32).tobytes() for a, _ in found], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in found], pa.binary())],
                names=["h", "label", "at", "x"],
            )

    sent = in_arrow(picked, run, "h long, label int, at binary, x binary")
    rows = sorted(sent.toLocalIterator(), key=lambda r: (r["h"], r["label"], bytes(r["at"]), bytes(r["x"])))
    return ftrl([(np.frombuffer(r["at"], np.int32), np.frombuffer(r["x"], np.float32).astype(float), r["label"]) for r in rows], bits)


def score_texts(texts: list[bytes | None], model: Model, tokens: Tokens) -> np.ndarray:
    out = np.full(len(texts), model.bias)
    for i, data in enumerate(texts):
        if data:
            index, n = features(data, tokens, model.bits)
            if n:
                out[i] += float(model.weights[index].sum(dtype=np.float64)) / n
    return 1.0 / (1.0 + np.exp(-np.clip(out, -35, 35)))


def with_quality(docs: DataFrame, model: Model, text: str = "text", score: str = "score", predicted: str = "predicted") -> DataFrame:
    """The rows of ``docs`` with the text replaced by score and prediction, which
    take the place of columns of their names."""
    rest = other_columns(docs, text, score, predicted)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 1 << BITS weights, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in small_batches(batches, text):
            p = score_texts(text_bytes(batch.column(batch.schema.get_field_index(text))), shared.value, tokens)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in rest), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*rest, score, predicted]
            )

    schema = docs.select(*rest).schema.add(score, "double").add(predicted, "integer")
    return in_arrow(docs.select(*rest, text), run, schema)


def held_out(key: Column) -> Column:
    return bucket_of(key, 3) == 1


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), lambda k: ~held_out(k))
    return with_quality(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model)
