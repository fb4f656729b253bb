"""Host-level quality rules.

1. Base measures of every whole text, in Arrow batches.
2. Failures are counted per host (domain), partially aggregated before the
   shuffle, so a host with a third of all rows costs one row per map task.
3. An empirical Beta(a, b) prior is fitted to the hosts' rates by the method
   of moments, and each host's rate is shrunk to (fails + a) / (n + a + b).
4. A host is rejected when its shrunk rate lies in the upper tail of the fitted
   prior, ``TAIL`` deviations above its mean; hosts that fail at most at
   ``MIN_HOST_RATE`` are never rejected and those above ``MAX_HOST_RATE``
   always are. The verdict is joined back to the host's documents.

Defined results: null text has no words and fails the base rule; a null host
is one host of its own; empty tables give an empty result; repeated rows are
judged one by one; a very long text is measured whole; a rate at the very
bound is kept; extra input columns are kept by :func:`apply_rules` and working
columns carry a prefix so that they never clash with them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, small_batches, stash, table, text_bytes, window_hashes, word_hashes

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
#: A host is rejected when its shrunk failure rate is so many deviations above
#: the prior's mean; between hosts that are much alike that would be little, so
#: the bound is kept within these rates.
TAIL, MIN_HOST_RATE, MAX_HOST_RATE = 2.0, 0.25, 0.5
#: More rejected hosts than this are joined by a shuffle instead of a broadcast.
MAX_BROADCAST_HOSTS = 100_000
SYMBOLS = b"#*$%&|<>"

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_STARTS = np.array([(b & 0xC0) != 0x80 for b in range(256)])
_IN_WORD = (_STARTS & ~_SEPARATOR).astype(np.int64)
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(SYMBOLS)] = 1

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(hashes: np.ndarray, lengths: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Per text, the words covered by ``width``-word windows found twice or
    more in it. Windows are told apart by 64-bit fingerprints."""
    ends = np.cumsum(lengths)
    starts = ends - lengths
    out = np.zeros(len(lengths), np.int64)
    windows = window_hashes(hashes, width)
    if not len(windows):
        return out
    owner = np.repeat(np.arange(len(lengths)), lengths)[: len(windows)]
    at = np.flatnonzero(np.arange(len(windows)) + width <= ends[owner])
    key = windows[at] ^ (owner[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(step, at[twice], 1)
    np.add.at(step, at[twice] + width, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(step[:-1]) > 0)))
    return covered[ends] - covered[starts]


def measure(texts: list[bytes | None]) -> dict[str, np.ndarray]:
    """The five base measures of each text."""
    n = len(texts)
    counts = np.zeros((4, n), np.int64)
    hashes = []
    for i, data in enumerate(texts):
        if not data:
            continue
        words = data.split()
        hashes.append(word_hashes(words))
        histogram = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        counts[0, i], counts[1, i], counts[2, i] = len(words), histogram @ _IN_WORD, histogram @ _SYMBOL
        lines = [x for x in data.split(b"\n") if x and not x.isspace()]
        counts[3, i] = len(lines) - len(set(lines))
    flat = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    return dict(zip(MEASURES, (*counts, repeated_words(flat, counts[0])), strict=True))


def with_measures(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """The rows of ``docs`` with the text replaced by its base measures."""
    rest = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text):
            found = measure(text_bytes(batch.column(batch.schema.get_field_index(text))))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in rest), *(pa.array(found[m]) for m in MEASURES)],
                names=[*rest, *(prefix + m for m in MEASURES)],
            )

    schema = docs.select(*rest).schema
    for m in MEASURES:
        schema = schema.add(prefix + m, "long")
    return in_arrow(docs.select(*rest, text), run, schema)


def base_failed(prefix: str = "") -> Column:
    n = F.col(prefix + "n_words")
    return (n < MIN_WORDS) | (100 * F.col(prefix + "n_repeat_words") > MAX_REPEAT_PERCENT * n)


def host_verdicts(judged: DataFrame, host: str, failed: str, max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per host: rows, failures, shrunk rate and verdict.

    The prior is one row; it is read to the driver as two numbers.
    """
    hosts = judged.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("host_docs"), F.sum(F.col(failed).cast("long")).alias("host_fails")
    )
    rate = F.col("host_fails") / F.col("host_docs")
    row = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v"), F.avg(1 / F.col("host_docs")).alias("inv")).first()
    a, b = beta_prior(row["m"], row["v"], row["inv"])
    shrunk = (F.col("host_fails") + F.lit(a)) / (F.col("host_docs") + F.lit(a + b))
    return hosts.withColumn("host_rate", shrunk).withColumn("host_kept", F.col("host_rate") <= rate_bound(a, b, max_host_rate))


def rate_bound(a: float, b: float, max_host_rate: float = MAX_HOST_RATE) -> float:
    """The highest shrunk rate at which a host is kept, given the prior."""
    mean = a / (a + b)
    return min(max(mean + TAIL * (mean * (1 - mean) / (a + b + 1)) ** 0.5, MIN_HOST_RATE), max_host_rate)


def beta_prior(mean: float | None, var: float | None, inverse_size: float | None) -> tuple[float, float]:
    """Moment estimate of Beta(a, b) from host rates, the binomial part of the
    variance taken out; a uniform-strength prior of 2 where there is nothing to fit."""
    if mean is None:
        return 1.0, 1.0
    m = min(max(mean, 1e-3), 1 - 1e-3)
    between = (var or 0.0) - m * (1 - m) * (inverse_size or 0.0)
    strength = min(max(m * (1 - m) / between - 1, 2.0), 1e4) if between > 0 else (1e4 if var is not None and var > 0 else 2.0)
    return m * strength, (1 - m) * strength


def judge(docs: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """key, measures, base_failed, host columns and kept, a row per input row."""
    slim = docs.select(F.col(key).alias("key"), F.col(host).alias("host"), F.col(text).alias("text"))
    measured = stash(with_measures(slim).withColumn("base_failed", base_failed()), "op1-measures")
    verdicts = host_verdicts(measured, "host", "base_failed", max_host_rate).withColumnRenamed("host", "of")
    return (
        measured.join(verdicts, measured["host"].eqNullSafe(verdicts["of"]), "left")
        .withColumn("kept", ~F.col("base_failed") & F.col("host_kept"))
        .select(F.col("key").alias(key), *MEASURES, "base_failed", "kept", "host_docs", "host_fails", F.round("host_rate", 9).alias("host_rate"))
    )


def apply_rules(docs: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The rows of ``docs`` that pass, all columns unchanged.

    Texts are parsed once and not shuffled: the rows are written with their base
    verdict (without the text where it fails), hosts are counted from the two
    narrow columns, and the rejected ones are left out as the rows are read back.
    """
    p = "__op1_"
    names, schema = docs.columns, docs.select(*[F.col(c) for c in docs.columns]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text):
            at = batch.schema.get_field_index(text)
            found = measure(text_bytes(batch.column(at)))
            n = found["n_words"]
            failed = (n < MIN_WORDS) | (100 * found["n_repeat_words"] > MAX_REPEAT_PERCENT * n)
            columns = list(batch.columns)
            columns[at] = columns[at].take(pa.array(np.arange(len(n)), mask=failed))  # null where it fails
            yield pa.RecordBatch.from_arrays([*columns, pa.array(failed)], names=[*names, p + "failed"])

    schema[text].nullable = True
    measured = stash(in_arrow(docs.select(*names), run, schema.add(p + "failed", "boolean")), "op1-measured")
    bad = host_verdicts(measured, host, p + "failed", max_host_rate).filter(~F.col("host_kept")).select(F.col("host").alias(p + "host"))
    good = measured.filter(~F.col(p + "failed"))
    n_bad = bad.count()
    if not n_bad:
        return good.select(*names)
    if n_bad <= MAX_BROADCAST_HOSTS:
        bad = F.broadcast(bad)
    return good.join(bad, good[host].eqNullSafe(bad[p + "host"]), "left_anti").select(*names)


def query(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


#: The same in DuckDB's dialect.
ORACLE_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM docs),
tokens AS (SELECT rid, generate_subscripts(words, 1) AS i, unnest(words) AS w FROM split),
runs AS (SELECT rid, i, string_agg(w, ' ') OVER r AS run, count(*) OVER r AS n FROM tokens WINDOW r AS (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)),
windows AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, run) AS times FROM runs WHERE n = {WINDOW}),
repeated AS (SELECT rid, count(DISTINCT place) AS n FROM (SELECT rid, unnest(range(i, i + {WINDOW})) AS place FROM windows WHERE times > 1) GROUP BY rid),
measured AS (
  SELECT s.rid, doc_id, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM split s LEFT JOIN repeated USING (rid)),
judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM measured),
hosts AS (SELECT source, count(*) AS host_docs, CAST(sum(CAST(base_failed AS INT)) AS BIGINT) AS host_fails FROM judged GROUP BY source),
moments AS (SELECT greatest(least(avg(host_fails / host_docs), 0.999::DOUBLE), 0.001::DOUBLE) AS m, var_pop(host_fails / host_docs) AS v, avg(1 / host_docs) AS inv FROM hosts),
prior AS (SELECT m, CASE WHEN v - m * (1 - m) * inv > 0 THEN least(greatest(m * (1 - m) / (v - m * (1 - m) * inv) - 1, 2), 10000) WHEN v > 0 THEN 10000 ELSE 2 END AS strength FROM moments),
verdicts AS (
  SELECT source, host_docs, host_fails, (host_fails + m * strength) / (host_docs + strength) AS host_rate,
    least(greatest(m + {TAIL} * sqrt(m * (1 - m) / (strength + 1)), {MIN_HOST_RATE}), {MAX_HOST_RATE}) AS bound FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_rate <= bound AS kept, host_docs, host_fails, round(host_rate, 9) AS host_rate
FROM judged j JOIN verdicts h ON j.source IS NOT DISTINCT FROM h.source
"""
