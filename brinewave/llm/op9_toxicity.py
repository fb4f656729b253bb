"""Toxicity: a bidirectional gated recurrent network with attention pooling,
trained in numpy, that scores the overlapping windows of a text.

A word's input is an embedding of its hash, the mean embedding of its character
trigrams, its log-odds of toxicity (shrunk, counted on the training sample) and
the highest log-odds of its runs of five characters. Windows are ``WINDOW``
words, one every ``STRIDE``, over the whole text; the text's score is its
highest window's.

Training reads whole texts on the executors, twice: they count words and runs,
and then hand in ``PICKED`` windows of each text from anywhere in it, those with
the highest log-odds and a few at random, so that the driver holds a bounded
number of windows however long the texts are. In each epoch a document is
learned from the window of these that now scores highest (and a clean one from
a random one as well), as the labels are of whole texts. Words have their
embeddings hidden at times and their log-odds at others, so that neither is
relied on alone.

Log-odds are cross-fitted: a half of the sample sees those of the other half,
so that a word of one document tells nothing about that document's label.

Defined results: null and empty texts have one empty window; without labelled
rows of both classes every score is the share of toxic ones (0 if none);
repeated rows are scored one by one; unusable labels are not learned from; of
windows that score the same the first is taken, which leaves the score as it
is, and a score of just 0.5 predicts 1; an empty table gives an empty result;
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

from .common import bucket_of, discard, in_arrow, labelled_sample, mix, other_columns, small_batches, stash, table, text_bytes

WINDOW, STRIDE = 32, 16
HIDDEN, WORD_DIM, CHAR_DIM, ATTENTION = 8, 6, 8, 8
WORD_BITS, CHAR_BITS, RUN_BITS, RUN = 16, 12, 18, 5
#: Labelled rows that the model is fitted on, about, and windows that are
#: learned from of each, some of them at random.
TRAIN_DOCS, PICKED, RANDOM = 5000, 8, 2
EPOCHS, BATCH, RATE, SEED = 6, 256, 0.01, 9
#: Small samples are gone through more often, so that so many steps are made.
MIN_STEPS = 150
#: Shares of words whose embeddings are hidden in training, and whose log-odds
#: are; and the rate of the tables against the others'.
DROP, DROP_ODDS, TABLE_RATE = 0.35, 0.35, 1.0
#: Strength of the shrinkage of a word's rate to the sample's.
SHRINK = 8.0
#: Distinct words whose input projections a worker remembers.
CACHE = 150_000
PUNCT = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def word_bucket(words: list[bytes]) -> np.ndarray:
    out = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return (out >> np.uint64(64 - WORD_BITS)).astype(np.int64)


def normal(words: list[bytes]) -> list[bytes]:
    return [w.strip(PUNCT).lower() for w in words]


def grams_of(words: list[bytes], width: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte n-grams of ^word$ and the word each belongs to."""
    data = np.frombuffer(b"".join(b"^%b$" % w for w in words), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    n = len(data) - width + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    code = data[:n].copy()
    for k in range(1, width):
        code = (code << np.uint64(8)) | data[k : k + n]
    inside = owner[:n] == owner[width - 1 :]
    return (mix(code[inside]) >> np.uint64(64 - bits)).astype(np.int64), owner[:n][inside]


def trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return grams_of(words, 3, CHAR_BITS)


def highest(odds: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Of each word the highest log-odds of its runs, 0 if it has none above."""
    out = np.zeros(len(words))
    runs, owner = grams_of(words, RUN, RUN_BITS)
    np.maximum.at(out, owner, odds[runs])
    return out


def window_rows(n: int) -> np.ndarray:
    """[windows, WINDOW] positions of a text of n words, -1 beyond its end."""
    starts = np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE)
    at = starts[:, None] + np.arange(WINDOW)
    return np.where(at < n, at, -1)


@dataclass
class Model:
    odds: np.ndarray  # [1 << WORD_BITS]
    runs: np.ndarray  # [1 << RUN_BITS]
    p: dict[str, np.ndarray] | None  # parameters; None: ``base`` for every text
    base: float


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def new_parameters(rng: np.random.Generator, prior: float) -> dict[str, np.ndarray]:
    d = ODDS + WORD_DIM + CHAR_DIM
    p = {"word": rng.normal(0, 0.1, (1 << WORD_BITS, WORD_DIM)), "char": rng.normal(0, 0.1, (1 << CHAR_BITS, CHAR_DIM))}
    for side in "fb":
        p["x" + side] = rng.normal(0, d**-0.5, (d, 3 * HIDDEN))
        p["u" + side] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 3 * HIDDEN))
        p["c" + side] = np.zeros(3 * HIDDEN)
    p["wa"] = rng.normal(0, 0.25, (2 * HIDDEN, ATTENTION))
    p["va"] = rng.normal(0, 0.35, ATTENTION)
    p["wo"] = rng.normal(0, 0.25, 2 * HIDDEN)
    p["bo"] = np.array([np.log(prior / (1 - prior))])
    return p


#: Of a word's input, the first columns are log-odds.
ODDS = 2


def inputs(odds: np.ndarray, p: dict[str, np.ndarray], buckets: np.ndarray, grams: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """[words, inputs], of the words' two log-odds; a word of punctuation alone has no trigram and a zero there."""
    share = np.bincount(owner, minlength=len(buckets)).clip(1)
    char = summed(p["char"][grams], owner, len(buckets)) / share[:, None].astype(p["char"].dtype)
    return np.concatenate((odds.astype(p["char"].dtype), p["word"][buckets], char), 1)


def gru(proj: np.ndarray, ids: np.ndarray, u: np.ndarray, back: bool, keep: list | None = None) -> np.ndarray:
    """States [WINDOW, windows, HIDDEN]. proj: input projections of the words,
    the last row for positions beyond the end, where the state stays."""
    h = np.zeros((len(ids), HIDDEN), proj.dtype)
    out = np.empty((ids.shape[1], len(ids), HIDDEN), proj.dtype)
    for t in range(ids.shape[1])[:: -1 if back else 1]:
        x, hu = proj[ids[:, t]], h @ u
        gate = sigmoid(x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
        r, z = gate[:, :HIDDEN], gate[:, HIDDEN:]
        n = np.tanh(x[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
        mask = (ids[:, t] >= 0)[:, None]
        new = np.where(mask, n + z * (h - n), h)
        if keep is not None:
            keep.append((t, h, r, z, n, hu[:, 2 * HIDDEN :], mask))
        h = out[t] = new
    return out


def pool(states: np.ndarray, ids: np.ndarray, p: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Attention over the positions: logits, weights, context, activations."""
    a = np.tanh(states @ p["wa"])
    s = np.where(ids.T >= 0, a @ p["va"], -1e9)
    e = np.exp(s - s.max(0))
    w = e / e.sum(0)
    c = np.einsum("tw,twh->wh", w, states)
    return c @ p["wo"] + p["bo"], w, c, a


def logits(proj: tuple[np.ndarray, np.ndarray], ids: np.ndarray, p: dict[str, np.ndarray]) -> np.ndarray:
    states = np.concatenate((gru(proj[0], ids, p["uf"], False), gru(proj[1], ids, p["ub"], True)), 2)
    return pool(states, ids, p)[0]


def projections(x: np.ndarray, p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    pad = np.zeros((1, 3 * HIDDEN), x.dtype)
    return np.concatenate((x @ p["xf"] + p["cf"], pad)), np.concatenate((x @ p["xb"] + p["cb"], pad))


def gradients(p: dict[str, np.ndarray], x: np.ndarray, ids: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
    """Mean cross entropy of the windows ``ids`` (rows of x, -1 beyond the end),
    its gradients by parameter, and by x."""
    proj = projections(x, p)
    kept: dict[str, list] = {"f": [], "b": []}
    states = np.concatenate((gru(proj[0], ids, p["uf"], False, kept["f"]), gru(proj[1], ids, p["ub"], True, kept["b"])), 2)
    out, w, c, a = pool(states, ids, p)
    q = sigmoid(out)
    loss = float(-np.mean(y * np.log(q + 1e-12) + (1 - y) * np.log(1 - q + 1e-12)))
    d_out = (q - y) / len(y)
    g = {"bo": np.array([d_out.sum()]), "wo": c.T @ d_out}
    d_c = d_out[:, None] * p["wo"]
    d_states = w[:, :, None] * d_c[None]
    d_w = np.einsum("twh,wh->tw", states, d_c)
    d_s = w * (d_w - (w * d_w).sum(0))
    g["va"] = np.einsum("twa,tw->a", a, d_s)
    d_a = d_s[:, :, None] * p["va"] * (1 - a * a)
    g["wa"] = np.einsum("twh,twa->ha", states, d_a)
    d_states += d_a @ p["wa"].T
    d_x = np.zeros_like(x)
    for side, part in (("f", d_states[:, :, :HIDDEN]), ("b", d_states[:, :, HIDDEN:])):
        u, wx = p["u" + side], p["x" + side]
        g["u" + side] = np.zeros_like(u)
        d_h = np.zeros((len(ids), HIDDEN), x.dtype)
        d_in_of = np.zeros((len(x), 3 * HIDDEN), x.dtype)
        for t, h, r, z, n, hu, mask in reversed(kept[side]):
            d_h = d_h + part[t]
            d_new = np.where(mask, d_h, 0.0)
            d_n = d_new * (1 - z) * (1 - n * n)
            d_z = d_new * (h - n) * z * (1 - z)
            d_r = d_n * hu * r * (1 - r)
            d_in = np.concatenate((d_r, d_z, d_n), 1)
            d_hu = np.concatenate((d_r, d_z, d_n * r), 1)
            g["u" + side] += h.T @ d_hu
            rows = np.flatnonzero(mask[:, 0])
            at = ids[rows, t]
            np.add.at(d_in_of, at, d_in[rows])
            d_h = np.where(mask, d_new * z, d_h) + d_hu @ u.T
        g["x" + side], g["c" + side] = x.T @ d_in_of, d_in_of.sum(0)
        d_x += d_in_of @ wx.T
    return loss, g, d_x


@dataclass
class Odds:
    """Shrunk log of a bucket's rate of toxic documents over the sample's."""

    word: np.ndarray
    run: np.ndarray

    def of(self, words: list[bytes], buckets: np.ndarray) -> np.ndarray:
        return np.stack((self.word[buckets], highest(self.run, words)), 1)


def tally(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the whole text's words and of their runs, each once."""
    words = normal(list(set(text.split())))
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.unique(word_bucket(words)), np.unique(grams_of(words, RUN, RUN_BITS)[0])


class Counts:
    """Documents and toxic documents of each half of the sample by bucket."""

    def __init__(self) -> None:
        self.docs = np.zeros((2, 2), np.int64)  # half; all, toxic
        self.word = np.zeros((2, 2, 1 << WORD_BITS), np.int64)
        self.run = np.zeros((2, 2, 1 << RUN_BITS), np.int64)

    def add(self, half: int, label: int, text: bytes) -> None:
        for table_, at in zip((self.word, self.run), tally(text), strict=True):
            table_[half, 0, at] += 1
            table_[half, 1, at] += label
        self.docs[half] += (1, label)

    def odds(self, halves: list[int]) -> Odds:
        n, toxic = self.docs[halves].sum(0)
        rate = max(toxic, 0.5) / max(n, 1)
        shrunk = lambda t: np.log((t[halves, 1].sum(0) + SHRINK * rate) / (t[halves, 0].sum(0) + SHRINK) / rate).astype(np.float32)
        return Odds(shrunk(self.word), shrunk(self.run))


def picked_windows(text: bytes, odds: Odds, seed: int) -> list[list[bytes]]:
    """At most ``PICKED`` windows of the whole text, as normal words."""
    words = normal(text.split())
    at = window_rows(len(words))
    if len(at) > PICKED:
        distinct = list(dict.fromkeys(words))
        number = {w: i for i, w in enumerate(distinct)}
        weight = (np.maximum(odds.of(distinct, word_bucket(distinct)), 0.0) ** 2).sum(1)
        each = np.append(weight[np.fromiter(map(number.__getitem__, words), np.int64, len(words))], 0.0)
        order = np.argsort(-each[at].sum(1), kind="stable")
        more = np.random.default_rng(seed).choice(order[PICKED - RANDOM :], RANDOM, replace=False)
        at = at[np.sort(np.append(order[: PICKED - RANDOM], more))]
    return [[words[i] for i in row if i >= 0] for row in at]


def train(texts: list[tuple[bytes, int]], epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """The model of texts with labels, in the order given."""
    counts = Counts()
    for i, (t, y) in enumerate(texts):
        counts.add(i & 1, y, t)
    other = [counts.odds([1]), counts.odds([0])]
    return learn([(i & 1, y, picked_windows(t, other[i & 1], i)) for i, (t, y) in enumerate(texts)], counts, epochs, seed)


def learn(sample: list[tuple[int, int, list[list[bytes]]]], counts: Counts, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """The model of (half, label, windows) in the order given."""
    toxic = sum(y for _, y, _ in sample)
    if not 0 < toxic < len(sample):
        return Model(np.zeros(1 << WORD_BITS), np.zeros(1 << RUN_BITS), None, toxic / len(sample) if sample else 0.0)
    rng = np.random.default_rng(seed)
    number: dict[bytes, int] = {}
    rows = [[number.setdefault(w, len(number)) for w in window] for _, _, windows in sample for window in windows]
    flat = np.full((len(rows), WINDOW), -1, np.int64)
    for i, row in enumerate(rows):
        flat[i, : len(row)] = row
    ends = np.cumsum([len(windows) for *_, windows in sample])
    starts = np.append(0, ends[:-1])
    half_of, label_of = np.array([h for h, *_ in sample]), np.array([y for _, y, _ in sample])
    words = list(number)
    del number, rows
    buckets = word_bucket(words)
    grams, owner = trigrams(words)
    gram_ends = np.searchsorted(owner, np.arange(len(words) + 1))
    other = [counts.odds([1]).of(words, buckets), counts.odds([0]).of(words, buckets)]
    p = {k: x.astype(np.float32) for k, x in new_parameters(rng, min(max(toxic / len(sample), 0.01), 0.5)).items()}
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0

    def adam(k: str, g: np.ndarray, at=slice(None)) -> None:
        m[k][at] = 0.9 * m[k][at] + 0.1 * g
        v[k][at] = 0.999 * v[k][at] + 0.001 * g * g
        p[k][at] -= (RATE * TABLE_RATE if k in ("word", "char") else RATE) * (m[k][at] / (1 - 0.9**step)) / (np.sqrt(v[k][at] / (1 - 0.999**step)) + 1e-8)

    batch = min(BATCH, max(32, len(sample) // 8))
    for _ in range(max(epochs, -(-MIN_STEPS * batch // (2 * len(sample))))):
        score = np.empty(len(flat), np.float32)
        by_half = np.repeat(half_of, ends - starts)
        for half in (0, 1):
            mine = np.flatnonzero(by_half == half)
            proj = projections(inputs(other[half], p, buckets, grams, owner), p)
            for k in range(0, len(mine), 4096):
                score[mine[k : k + 4096]] = logits(proj, flat[mine[k : k + 4096]], p)
        best = np.array([a + int(np.argmax(score[a:b])) for a, b in zip(starts, ends, strict=True)])
        clean = np.flatnonzero(label_of == 0)
        extra = starts[clean] + rng.integers(0, (ends - starts)[clean])
        chosen = np.concatenate((np.stack((best, np.arange(len(sample))), 1), np.stack((extra, clean), 1)))
        chosen = chosen[rng.permutation(len(chosen))]
        for half in (0, 1):
            own = chosen[half_of[chosen[:, 1]] == half]
            for k in range(0, len(own), batch):
                part = own[k : k + batch]
                ids, y = flat[part[:, 0]], label_of[part[:, 1]].astype(np.float32)
                used, back = np.unique(np.append(ids.ravel(), -1), return_inverse=True)
                used = used[1:]
                local = back[:-1].reshape(ids.shape) - 1
                if not len(used):
                    continue
                pieces = np.concatenate([np.arange(gram_ends[w], gram_ends[w + 1]) for w in used])
                own_of = np.repeat(np.arange(len(used)), gram_ends[used + 1] - gram_ends[used])
                x = inputs(other[half][used], p, buckets[used], grams[pieces], own_of)
                draw = rng.random(len(used))[:, None]
                shown = np.ones_like(x)
                shown[:, :ODDS] = (draw >= DROP_ODDS) / (1 - DROP_ODDS)
                shown[:, ODDS:] = (draw < 1 - DROP) / (1 - DROP)
                _, g, d_x = gradients(p, x * shown, local, y)
                d_x *= shown
                step += 1
                for key, grad in g.items():
                    adam(key, grad)
                one, back = np.unique(buckets[used], return_inverse=True)
                adam("word", summed(d_x[:, ODDS : ODDS + WORD_DIM], back, len(one)), one)
                d_char = d_x[:, ODDS + WORD_DIM :] / np.bincount(own_of, minlength=len(used)).clip(1)[:, None]
                one, back = np.unique(grams[pieces], return_inverse=True)
                adam("char", summed(d_char[own_of], back, len(one)), one)
    whole = counts.odds([0, 1])
    return Model(whole.word, whole.run, p, 0.0)


def summed(rows: np.ndarray, to: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(to, rows[:, k], minlength=n) for k in range(rows.shape[1])], 1).astype(rows.dtype)


class Scorer:
    """Scores texts; remembers the input projections of the words it has met."""

    def __init__(self, model: Model) -> None:
        self.model, self.row = model, {}
        self.forward = np.zeros((1024, 3 * HIDDEN), np.float32)
        self.back = np.zeros((1024, 3 * HIDDEN), np.float32)

    def learn(self, words: list[bytes]) -> None:
        grams, owner = trigrams(plain := normal(words))
        at = word_bucket(plain)
        x = inputs(Odds(self.model.odds, self.model.runs).of(plain, at), self.model.p, at, grams, owner)
        first, second = projections(x, self.model.p)
        at = len(self.row)
        need = at + len(words) + 1
        if need > len(self.forward):
            grow = max(need, 2 * len(self.forward)) - len(self.forward)
            self.forward = np.concatenate((self.forward, np.zeros((grow, 3 * HIDDEN), np.float32)))
            self.back = np.concatenate((self.back, np.zeros((grow, 3 * HIDDEN), np.float32)))
        self.forward[at : need - 1], self.back[at : need - 1] = first[:-1], second[:-1]
        for w in words:
            self.row[w] = len(self.row)

    def __call__(self, texts: list[bytes | None]) -> np.ndarray:
        if self.model.p is None:
            return np.full(len(texts), self.model.base)
        out = np.full(len(texts), -np.inf)
        split = [(t or b"").split() for t in texts]
        at = 0
        while at < len(texts):  # so many texts at a time that their windows stay few
            to, n = at, 0
            while to < len(texts) and (to == at or n < 60_000):
                n += len(split[to])
                to += 1
            self.run(split, at, to, out)
            at = to
        return sigmoid(out)

    def run(self, split: list[list[bytes]], at: int, to: int, out: np.ndarray) -> None:
        if len(self.row) > CACHE:
            self.row.clear()
        row = self.row
        if missing := [w for w in {w for words in split[at:to] for w in words} if w not in row]:
            self.learn(missing)
        rows, owner = [], []
        for i in range(at, to):
            ids = np.fromiter(map(row.__getitem__, split[i]), np.int64, len(split[i]))
            found = window_rows(len(ids))
            rows.append(np.where(found >= 0, np.append(ids, -1)[found], -1))
            owner.append(np.full(len(found), i))
        ids, of = np.concatenate(rows), np.concatenate(owner)
        for k in range(0, len(ids), 2048):
            np.maximum.at(out, of[k : k + 2048], logits((self.forward, self.back), ids[k : k + 2048], self.model.p))


def fit(docs: DataFrame, labels: DataFrame, usable, label: str = "toxic", key: str = "doc_id", text: str = "text", bound: int = TRAIN_DOCS) -> Model:
    spark = docs.sparkSession
    picked = stash(labelled_sample(docs, labels, label, usable, bound, key, text).select("h", "label", "text"), "op9-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()
        for batch in small_batches(batches, "text"):
            for h, y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2)), strict=True):
                counts.add(h & 1, y, t)
        for kind, found in enumerate((counts.docs[:, :, None], counts.word, counts.run)):
            half, at = np.nonzero(found[:, 0])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(half.astype(np.int32)), pa.array(at), pa.array(found[half, 0, at]), pa.array(found[half, 1, at])], names=["kind", "half", "at", "n", "bad"])

    # a row for each half and bucket at most
    sums = in_arrow(picked, count, "kind int, half int, at long, n long, bad long").groupBy("kind", "half", "at").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).toArrow()
    kind, half, at, n, bad = (np.asarray(sums.column(c)) for c in ("kind", "half", "at", "n", "bad"))
    counts = Counts()
    for k, table_ in enumerate((counts.docs[:, :, None], counts.word, counts.run)):
        of = kind == k
        table_[half[of], 0, at[of]], table_[half[of], 1, at[of]] = n[of], bad[of]
    shared = spark.sparkContext.broadcast([counts.odds([1]), counts.odds([0])])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            hashes = batch.column(0).to_pylist()
            found = [picked_windows(t, shared.value[h & 1], h) for h, t in zip(hashes, text_bytes(batch.column(2)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([[b" ".join(w) for w in x] for x in found], pa.list_(pa.binary()))], names=["h", "label", "windows"])

    rows = sorted((r["h"], r["label"], [bytes(w) for w in r["windows"]]) for r in in_arrow(picked, pick, "h long, label int, windows array<binary>").toLocalIterator())
    discard(picked)
    # an empty word is one of punctuation; a window without a word is empty
    return learn([(h & 1, y, [w.split(b" ") if w else [] for w in windows]) for h, y, windows in rows], counts)


def with_toxicity(docs: DataFrame, model: Model, text: str = "text", score: str = "score", predicted: str = "predicted") -> DataFrame:
    """The rows of ``docs`` with the text replaced by score and prediction, which
    take the place of columns of their names."""
    rest = other_columns(docs, text, score, predicted)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of parameters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in small_batches(batches, text):
            s = scorer(text_bytes(batch.column(batch.schema.get_field_index(text))))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in rest), pa.array(s.astype(float)), pa.array((s >= 0.5).astype(np.int32))], names=[*rest, score, predicted]
            )

    schema = docs.select(*rest).schema.add(score, "double").add(predicted, "integer")
    return in_arrow(docs.select(*rest, text), run, schema)


def held_out(key: Column) -> Column:
    return bucket_of(key, 5) == 0


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), lambda k: ~held_out(k))
    return with_toxicity(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model)
