"""Language identification by cross-parsing entropy.

Training: per language, a bounded sample of labelled text (``TRAIN_CHARS``
characters, in pieces from all over the texts of about ``TRAIN_DOCS`` rows)
becomes a suffix automaton, held as a dense transition table. Scoring: a text
is parsed greedily into the longest phrases that occur in a language's sample;
the number of phrases, normalised by the text's length and by the logarithm of
the sample's length, is the cross-parsing entropy of the text under that
language. The language with the lowest wins.

Every letter of the samples, of whatever script, counts: up to ``WIDTH`` of
them are a symbol each; if there are more, the most frequent ones are, and the
others are written as three or four digits in base 64 of their code point, as
symbols of their own. A letter that no sample has matches nothing.

Whole texts are parsed, in blocks of ``BLOCK`` symbols that are advanced side
by side (one numpy step moves every block of a batch by one symbol); a phrase
does not cross the end of a block.

Defined results: a null text, or one without a letter, is ``und`` with score
0, as is every text if nothing was learned; ties go to the language that is
first by code point; null languages are not learned from; repeated rows are
judged one by one; an empty table gives an empty result; input columns named
like an output column give way to it. The score is second/(best + second) of
the normalised phrase counts, so 0.5 at a tie; with a single language it is 1.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_of, in_arrow, other_columns, small_batches, table

#: Bounds of what a language is learned from, in pieces of so many characters.
TRAIN_CHARS, PIECE = 60_000, 512
TRAIN_DOCS = 120
#: Symbols of letters, at most, and the digits among them where that is too few.
WIDTH, DIGITS = 120, 64
BLOCK = 512
#: Languages beyond this are refused, as the model goes to every worker; its
#: tables stay below MODEL_BYTES, by shorter samples where there are many.
MAX_LANGUAGES, MODEL_BYTES = 200, 512 << 20

UNDETERMINED = "und"
#: Code points below this are looked up in a table, others by search.
_CODES = 0x3000


@dataclass
class Alphabet:
    """Symbols of code points: 0 no letter, 1 unknown letter, then letters by
    themselves, then digits."""

    low: np.ndarray  # of code points below _CODES
    high: np.ndarray  # others that the samples have, ascending
    high_symbol: np.ndarray
    spelled: np.ndarray  # [letters, 4] digits, -1 where there are three; symbol SPELLED + row stands for them
    width: int  # symbols, with the padding symbol as the last


SPELLED = 1 << 20


@dataclass
class Model:
    languages: list[str]
    alphabet: Alphabet
    tables: list[np.ndarray]  # [state * width + symbol] -> (next state * width) << 1 | new phrase
    scale: list[float]

    @property
    def width(self) -> int:
        return self.alphabet.width


def lower(code: int) -> int:
    c = chr(code).lower()
    return ord(c) if len(c) == 1 else code


_IS_LETTER = np.array([chr(i).isalpha() for i in range(_CODES)])


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def alphabet(texts: Iterable[str]) -> Alphabet:
    """Of the letters in ``texts``, their capitals included."""
    counts: Counter[int] = Counter()
    for text in texts:
        found, n = np.unique(codes_of(text), return_counts=True)
        for c, k in zip(found.tolist(), n.tolist(), strict=True):
            if chr(c).isalpha():
                counts[lower(c)] += k
    order = sorted(counts, key=lambda c: (-counts[c], c))
    single = order if len(order) <= WIDTH else order[: WIDTH - DIGITS]
    symbol = {c: 2 + i for i, c in enumerate(single)}
    rest = sorted(set(order) - set(single))
    symbol |= {c: SPELLED + i for i, c in enumerate(rest)}
    digit = lambda c, k: 2 + len(single) + (c >> 6 * k & 63)
    spelled = np.array([[*(digit(c, k) for k in (2, 1, 0)), -1] if c < 1 << 18 else [digit(c, k) for k in (3, 2, 1, 0)] for c in rest], np.int64).reshape(-1, 4)
    low = _IS_LETTER.astype(np.int64)
    capitals = {ord(u): symbol[c] for c in order if len(u := chr(c).upper()) == 1 and lower(ord(u)) == c}
    all_of = capitals | symbol
    for c, k in all_of.items():
        if c < _CODES:
            low[c] = k
    high = np.array(sorted(c for c in all_of if c >= _CODES), np.int64)
    return Alphabet(low, high, np.array([all_of[c] for c in high.tolist()], np.int64), spelled, 2 + len(single) + (DIGITS if rest else 0) + 1)


def symbols(text: str, letters: Alphabet) -> tuple[np.ndarray, int]:
    """The text's symbols with runs of non-letters made one blank, and its number of letters."""
    codes = codes_of(text)
    out = letters.low[np.minimum(codes, _CODES - 1)]
    at = np.flatnonzero(codes >= _CODES)
    if len(at):
        found, back = np.unique(codes[at], return_inverse=True)
        known = np.isin(found, letters.high)
        of = np.array([int(chr(c).isalpha()) for c in found.tolist()])
        of[known] = letters.high_symbol[np.searchsorted(letters.high, found[known])]
        out[at] = of[back]
    n = int(np.count_nonzero(out))
    blank = out == 0
    keep = np.ones(len(out), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    out = out[keep]
    if len(letters.spelled) and (long := out >= SPELLED).any():
        parts = np.full((len(out), 4), -1, np.int64)
        parts[:, 0] = out
        parts[long] = letters.spelled[out[long] - SPELLED]
        out = parts[parts >= 0]
    return out, n


def automaton(sequence: list[int]) -> list[dict[int, int]]:
    """Suffix automaton of a symbol sequence: the transitions of each state."""
    moves: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for symbol in sequence:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and symbol not in moves[p]:
            moves[p][symbol] = new
            p = link[p]
        if p >= 0:
            q = moves[p][symbol]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(symbol) == q:
                    moves[p][symbol] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return moves


def dense(moves: list[dict[int, int]], width: int) -> np.ndarray:
    """The automaton as a table in which a failed match has begun a new phrase
    already. An unknown first symbol is a phrase of its own."""
    root = np.full(width, 1, np.int32)
    for s, q in moves[0].items():
        root[s] = (q * width) << 1 | 1
    out = np.tile(root, (len(moves), 1))
    for state, edges in enumerate(moves):
        for s, q in edges.items():
            out[state, s] = (q * width) << 1 | (1 if state == 0 else 0)
        out[state, width - 1] = (state * width) << 1
    return out.reshape(-1)


def train(samples: dict[str, list[str]]) -> Model:
    """A model of ``samples``: texts per language, all of them used."""
    used = {lang: samples[lang] for lang in sorted(samples, key=lambda x: x.encode("utf-32-be")) if any(c.isalpha() for t in samples[lang] for c in t)}
    letters = alphabet(t for texts in used.values() for t in texts)
    tables, scale = [], []
    for texts in used.values():
        sequence: list[int] = []
        for text in texts:
            sequence += [0, *symbols(text, letters)[0].tolist()]
        tables.append(dense(automaton(sequence), letters.width))
        scale.append(float(np.log2(len(sequence) + 2)))
    return Model(list(used), letters, tables, scale)


def phrases(model: Model, blocks: np.ndarray) -> np.ndarray:
    """[language, block] phrase counts; blocks is [BLOCK, n] of symbols."""
    out = np.zeros((len(model.tables), blocks.shape[1]), np.int64)
    for k, moves in enumerate(model.tables):
        state = np.zeros(blocks.shape[1], np.int32)
        count = np.zeros(blocks.shape[1], np.int32)
        for row in blocks:
            state += row
            step = moves.take(state)
            count += step & 1
            state = step >> 1
        out[k] = count
    return out


def predict(model: Model, texts: list[str | None], lanes: int = 8192) -> tuple[list[str], np.ndarray]:
    n, pad = len(texts), model.width - 1
    total = np.zeros((len(model.tables), n), np.int64)
    letters, length = np.zeros(n, np.int64), np.ones(n, np.int64)
    waiting: list[np.ndarray] = []
    owner: list[int] = []

    def flush() -> None:
        if waiting and model.tables:
            blocks = np.full((len(waiting), BLOCK), pad, np.uint8)
            for i, part in enumerate(waiting):
                blocks[i, : len(part)] = part
            found = phrases(model, np.ascontiguousarray(blocks.T))
            for k in range(len(model.tables)):
                total[k] += np.bincount(owner, found[k], minlength=n).astype(np.int64)
        waiting.clear()
        owner.clear()

    for i, text in enumerate(texts):
        if not text:
            continue
        seq, letters[i] = symbols(text, model.alphabet)
        length[i] = len(seq)
        if letters[i]:
            for at in range(0, len(seq), BLOCK):
                waiting.append(seq[at : at + BLOCK])
                owner.append(i)
                if len(waiting) >= lanes:
                    flush()
    flush()
    langs, scores = [UNDETERMINED] * n, np.zeros(n)
    if not model.tables:
        return langs, scores
    rate = total * np.array(model.scale)[:, None] / length
    best = np.argmin(rate, axis=0)
    first = rate[best, np.arange(n)]
    if len(model.tables) > 1:
        rest = rate.copy()
        rest[best, np.arange(n)] = np.inf
        second = rest.min(axis=0)
        with np.errstate(invalid="ignore", divide="ignore"):
            scores = np.where(first + second > 0, second / (first + second), 0.5)
    else:
        scores = np.ones(n)
    for i in range(n):
        if letters[i]:
            langs[i] = model.languages[best[i]]
        else:
            scores[i] = 0.0
    return langs, scores


def sample(docs: DataFrame, usable: Column, key: str, text: str, lang: str, train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> dict[str, list[str]]:
    """Pieces of about ``train_docs`` texts of each language, chosen by hash of
    the key, ``train_chars`` characters in all: one piece of each text from
    anywhere in it, then a second one of each, ...

    Language counts (one row per language) come first; they give the share of
    each language's rows to read, so one pass over the texts is enough and what
    reaches the driver is bounded by languages times ``train_chars``.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text")).filter(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return {}
    hashed = F.shiftrightunsigned(F.xxhash64(F.col("key"), F.lit(5)), 33)
    wanted = F.lit(False)
    for name, n in sorted(counts.items()):
        share = min(1.0, (train_docs + 3 * train_docs**0.5) / n)
        wanted = wanted | ((F.col("lang") == name) & (hashed < int(share * (1 << 31)) + 1))
    # a symbol of a sample takes two states of a row of WIDTH numbers at most
    pieces = max(1, min(train_chars, MODEL_BYTES // (len(counts) * 2 * 4 * (WIDTH + 3))) // PIECE)
    numbers = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.length("text") - 1, F.lit(0)) / PIECE).cast("int")), lambda i: F.struct(F.xxhash64("key", i).alias("h"), i.alias("i")))
    numbers = F.slice(F.array_sort(numbers), 1, pieces)
    each = rows.filter(wanted).select("lang", "key", "text", F.posexplode(numbers).alias("at", "x")).select("lang", "at", "x.h", "key", "x.i", F.expr(f"substring(text, x.i * {PIECE} + 1, {PIECE})").alias("piece"))
    first = each.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("at", "h", "key", "i"))).filter(F.col("rank") <= pieces)
    out: dict[str, list[tuple[int, str]]] = {}
    for r in first.select("lang", "rank", "piece").toLocalIterator():
        out.setdefault(r["lang"], []).append((r["rank"], r["piece"]))
    return {k: [t for _, t in sorted(v)] for k, v in out.items()}


def with_language(docs: DataFrame, model: Model, text: str = "text", pred: str = "lang_pred", score: str = "score", keep_text: bool = False) -> DataFrame:
    """The rows of ``docs`` (without the text, unless it is kept) and their
    prediction, which takes the place of columns named ``pred`` or ``score``."""
    rest = [c for c in other_columns(docs, pred, score) if keep_text or c != text]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text):
            langs, scores = predict(shared.value, batch.column(batch.schema.get_field_index(text)).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in rest), pa.array(langs, pa.string()), pa.array(scores)],
                names=[*rest, pred, score],
            )

    schema = docs.select(*rest).schema.add(pred, "string").add(score, "double")
    columns = [F.col(c) for c in rest] + ([] if keep_text else [F.col(text)])
    return in_arrow(docs.select(*columns), run, schema)


def held_out(key: Column) -> Column:
    return bucket_of(key, 4) == 2


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    return train(sample(docs, ~held_out(F.col("key")), key, text, lang))


#: In :func:`keep_identified`, texts are rejected below this score: no language
#: explains them better than the next one.
MIN_SCORE = 0.51


def keep_identified(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", min_score: float = MIN_SCORE) -> DataFrame:
    """The rows whose language is determined, all columns unchanged."""
    p, q = "__op5_lang", "__op5_score"
    model = fit(docs, key, text, lang)
    return with_language(docs, model, text, p, q, keep_text=True).filter((F.col(p) != UNDETERMINED) & (F.col(q) >= min_score)).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs)
    slim = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return with_language(slim, model)
