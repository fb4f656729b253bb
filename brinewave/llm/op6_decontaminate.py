"""Benchmark decontamination by template canonicalisation.

A text becomes a sequence of templates' tokens: words without the punctuation
around them, lower case, with numbers, units and names (capitalised inside a
sentence) replaced by typed placeholders. Windows of ``WIDTH`` tokens are
hashed and joined to the windows of the benchmark's items; for each occurrence
(document, item, offset between them) the slots, the raw values behind the
placeholders, have to be consistent: the pairs (value of the item, value of
the document) form a one-to-one mapping, equal ones included. So a question
with other numbers or names is found, and one whose values cannot be a renaming
is not. An item has leaked into a document if the share ``MIN_COVERAGE`` of its
windows is found there, or ``MIN_WINDOWS`` of them (25 words on end).

A window with fewer than ``MIN_LITERAL`` plain words says too little as a
template and is compared word for word instead; the coverage is that of all
windows or that of the templates alone, whichever is higher. The first word of an item
counts as a name as well as a plain word, as what precedes it is unknown.

The benchmark's window hashes are given to the scan of the documents, where
they drop nearly all windows at once: the hashes themselves if they are at most
``MAX_BROADCAST_WINDOWS``, else a bit map of fixed size (32 MB). The join that
follows makes the result the same.

Defined results: null or empty texts and items have no windows; an item of
fewer than ``WIDTH`` but at least ``MIN_TOKENS`` tokens is one window of its
own width, shorter ones are not searched; repeated rows of either table count
once; rows that share an id (or have none) and differ in text are documents,
or items, of their own, and of items that share an id the best covered one is
given; of any length, whole texts are searched; a null document id gives a row
with a null id; other columns are never read, so their names cannot clash;
empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _ODD, in_arrow, mix, small_batches, stash, table, text_bytes, window_hashes

WIDTH = 8
MIN_TOKENS = 5
MIN_LITERAL = 4
MIN_COVERAGE, MIN_WINDOWS = 0.5, 18
MAX_BROADCAST_WINDOWS = 4_000_000
#: Bits of the map that stands in for more hashes than that.
MAP_BITS = 28
MAX_BROADCAST_IDS = 2_000_000
CACHE = 300_000
PUNCT = bytes(b for b in range(33, 127) if not chr(b).isalnum())

NUMBER = re.compile(rb"[+-]?\d[\d.,:/]*(?:st|nd|rd|th|%)?$")
NUMBER_WORDS = frozenset(
    b"zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    b"twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
)
UNITS = frozenset(
    b"mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    b"mg g kg t lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l liter liters litre litres gallon gallons "
    b"s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    b"dollar dollars cent cents euro euros usd eur percent degree degrees kmh mph watt watts volt volts joule joules".split()
)
#: Kinds of token; a plain word's value is its hash with the low bits clear.
_NUM, _UNIT, _NAME = 1, 2, 3
_CAPITAL, _ENDS = 1 << 2, 1 << 3
_LOW = np.uint64(0xF)


class Tokens(dict):
    """word -> 60 bits of hash, whether it ends a sentence, whether it is capitalised, kind."""

    def __missing__(self, word: bytes) -> int:
        core = word.strip(PUNCT)
        low = core.lower()
        flags = _ENDS if word[-1:] in b".!?:" else 0
        if low[:1].isdigit() and NUMBER.match(low) or low in NUMBER_WORDS:
            flags |= _NUM
        elif low in UNITS:
            flags |= _UNIT
        elif core[:1] != low[:1] and core[1:] == low[1:]:
            flags |= _CAPITAL
        found = xxhash.xxh3_64_intdigest(low) & ~0xF | flags
        if len(self) >= CACHE:
            self.clear()
        self[word] = found
        return found


_PLACEHOLDER = np.array([0, 0x1111111111111110, 0x2222222222222220, 0x3333333333333330], np.uint64)
_LITERAL = np.uint64(0x5555555555555555)


def canonical(values: np.ndarray, starts: np.ndarray, named_first: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Template tokens and their kinds (0: plain) of texts laid end to end.

    named_first: capitalised first words of texts are names, too."""
    flags = (values & _LOW).astype(np.int64)
    kind = flags & 3
    after = np.ones(len(values), bool)  # follows the end of a sentence
    after[1:] = (flags[:-1] & _ENDS) > 0
    after[starts[starts < len(values)]] = not named_first
    kind[(flags & _CAPITAL > 0) & ~after] = _NAME
    return np.where(kind > 0, _PLACEHOLDER[kind], values & ~_LOW), kind


class Wanted:
    """The window hashes to look for: all of them, or a bit map that lets some
    others through."""

    def __init__(self, hashes: np.ndarray | None = None, words: np.ndarray | None = None) -> None:
        self.hashes = hashes  # sorted
        if hashes is not None:
            self.shift = np.uint64(64 - max(16, int(len(hashes)).bit_length() + 6))
            self.map = np.zeros(1 << int(64 - self.shift), bool)
            self.map[(hashes >> self.shift).astype(np.int64)] = True
        else:
            self.shift, self.words = np.uint64(64 - MAP_BITS), words

    def among(self, found: np.ndarray) -> np.ndarray:
        """Positions of ``found`` that can be wanted."""
        top = found >> self.shift
        if self.hashes is None:
            return np.flatnonzero(self.words[(top >> np.uint64(6)).astype(np.int64)] >> (top & np.uint64(63)) & np.uint64(1))
        at = np.flatnonzero(self.map[top.astype(np.int64)])
        if not len(self.hashes):
            return at[:0]
        return at[self.hashes[np.searchsorted(self.hashes, found[at]).clip(max=len(self.hashes) - 1)] == found[at]]


def windows(texts: list[bytes | None], tokens: Tokens, widths: tuple[int, ...], item: bool = False, wanted: Wanted | None = None):
    """(row, position, hash, slots) of each window, of those in ``wanted`` if given;
    slots are None for windows that are compared word for word.

    item: a text shorter than the last width is one window, and the windows at
    its start are given a second time if its first word can be a name.
    """
    split = [t.split() if t else [] for t in texts]
    lengths = np.array([len(w) for w in split], np.int64)
    words = [w for x in split for w in x]
    ends = np.cumsum(lengths)
    starts = ends - lengths
    values = np.fromiter(map(tokens.__getitem__, words), np.uint64, len(words))
    owner = np.repeat(np.arange(len(texts)), lengths)
    literal = values & ~_LOW
    out = []
    for named_first in (False, True)[: 1 + item]:
        token, kind = canonical(values, starts, named_first)
        plain = np.concatenate(([0], np.cumsum(kind == 0)))
        for width in widths:
            if len(token) < width:
                continue
            hashes = window_hashes(token, width)
            poor = np.flatnonzero(plain[width:] - plain[:-width] < MIN_LITERAL)
            if len(poor):
                hashes[poor] = mix(sum(literal[poor + j] * _ODD[j] for j in range(width))) ^ _LITERAL
            hashes ^= np.uint64(width)
            at = np.arange(len(hashes)) if wanted is None else wanted.among(hashes)
            at = at[at + width <= ends[owner[at]]]
            if item and width < WIDTH:
                at = at[lengths[owner[at]] == width]
            if named_first:
                at = at[(at == starts[owner[at]]) & (values[at] & np.uint64(_CAPITAL) > 0)]
            few = np.isin(at, poor)
            for i, bare in zip(at.tolist(), few.tolist(), strict=True):
                slots = None if bare else [words[j].strip(PUNCT).decode("utf-8", "replace") for j in range(i, i + width) if kind[j]]
                out.append((int(owner[i]), i - int(starts[owner[i]]), int(hashes[i].view(np.int64)), slots))
    return out


_SCHEMA = "doc_key long, doc_row long, pos int, hash long, slots array<string>"


def row_of(text: str) -> Column:
    """Tells rows that share an id apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def template_windows(rows: DataFrame, key: str, text: str, widths: tuple[int, ...], item: bool = False, wanted=None) -> DataFrame:
    """doc_key, doc_row, pos, hash, slots. wanted: a broadcast, or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        only = None if wanted is None else wanted.value
        for batch in small_batches(batches, "text"):
            found = windows(text_bytes(batch.column(2)), tokens, widths, item, only)
            rows = pa.array([r for r, *_ in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array([p for _, p, *_ in found], pa.int32()), pa.array([h for *_, h, _ in found], pa.int64()), pa.array([s for *_, s in found], pa.list_(pa.string()))],
                names=["doc_key", "doc_row", "pos", "hash", "slots"],
            )

    return in_arrow(rows.select(F.col(key).cast("long").alias("key"), row_of(text).alias("row"), F.col(text).alias("text")), run, _SCHEMA)


def wanted_hashes(hashes: DataFrame, max_broadcast: int) -> Wanted:
    """What the scan looks for; the driver holds at most ``max_broadcast`` hashes,
    or the words of the bit map."""
    if hashes.limit(max_broadcast + 1).count() <= max_broadcast:
        return Wanted(np.sort(hashes.toPandas()["hash"].to_numpy(np.int64).view(np.uint64)))
    at = F.shiftrightunsigned("hash", 64 - MAP_BITS)
    words = hashes.groupBy(F.shiftrightunsigned(at, 6).alias("w")).agg(F.expr(f"bit_or(shiftleft(1L, cast(shiftrightunsigned(hash, {64 - MAP_BITS}) & 63 as int)))").alias("bits")).toPandas()
    out = np.zeros(1 << MAP_BITS - 6, np.uint64)
    out[words["w"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return Wanted(words=out)


def found_leaks(docs: DataFrame, benchmark: DataFrame, key: str, text: str, item: str, item_text: str, min_coverage: float, min_windows: int, max_broadcast: int) -> DataFrame:
    """doc_key, doc_row, item_key and the best covered of the items of that id."""
    all_widths = (*range(MIN_TOKENS, WIDTH), WIDTH)
    items = stash(
        template_windows(benchmark.select(F.col(item).alias("item"), F.col(item_text).alias("words")).distinct(), "item", "words", all_widths, item=True)
        .select(F.col("doc_key").alias("item_key"), F.col("doc_row").alias("item_row"), F.col("pos").alias("item_pos"), "hash", F.col("slots").isNotNull().alias("rich"), F.coalesce("slots", F.array()).alias("item_slots")),
        "op6-items",
    )
    places = items.groupBy(F.col("item_key").alias("of"), F.col("item_row").alias("of_row"), "item_pos").agg(F.max("rich").alias("rich"))
    totals = places.groupBy("of", "of_row").agg(F.count(F.lit(1)).alias("item_windows"), F.count_if("rich").alias("item_templates"))
    wanted = docs.sparkSession.sparkContext.broadcast(wanted_hashes(items.select("hash").distinct(), max_broadcast))
    # rows that repeat meet again in the groups below, where they count once
    found = template_windows(docs, key, text, all_widths, wanted=wanted)
    pair = ["doc_key", "doc_row", "item_key", "item_row"]
    met = found.withColumn("slots", F.coalesce("slots", F.array())).join(items, "hash").filter(F.size("slots") == F.size("item_slots"))
    offset = met.withColumn("offset", F.col("pos") - F.col("item_pos")).select(*pair, "offset", F.struct("item_pos", "rich").alias("at"), F.arrays_zip("item_slots", "slots").alias("pairs")).distinct()
    # an occurrence has at most twice as many windows as its item
    occurrence = offset.groupBy(*pair, "offset").agg(F.collect_set("at").alias("at"), F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs"))
    values = lambda side: F.size(F.array_distinct(F.transform("pairs", lambda p: p[side])))
    one_to_one = (values("item_slots") == F.size("pairs")) & (values("slots") == F.size("pairs"))
    same = F.forall("pairs", lambda p: p["item_slots"] == p["slots"])
    consistent = occurrence.filter(one_to_one).select(*pair, F.explode("at").alias("at"), same.alias("same"))
    covered = consistent.groupBy(*pair, "at.item_pos").agg(F.max("same").alias("same"), F.max("at.rich").alias("rich"))
    counted = covered.groupBy(*pair).agg(F.count(F.lit(1)).alias("matched_windows"), F.count_if("rich").alias("matched_templates"), F.min("same").alias("exact"))
    both = counted.join(totals, counted["item_key"].eqNullSafe(totals["of"]) & (counted["item_row"] == totals["of_row"]))
    both = both.withColumn("coverage", F.greatest(F.col("matched_windows") / F.col("item_windows"), F.try_divide("matched_templates", "item_templates")))
    enough = both.filter((F.col("coverage") >= min_coverage) | (F.col("matched_windows") >= min_windows))
    return enough.groupBy("doc_key", "doc_row", "item_key").agg(F.max(F.struct("coverage", "matched_windows", "item_windows", "exact")).alias("best"))


def leaks(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    min_coverage: float = MIN_COVERAGE, min_windows: int = MIN_WINDOWS, max_broadcast: int = MAX_BROADCAST_WINDOWS,
) -> DataFrame:
    """key, item, matched_windows, item_windows, coverage, exact: a row per
    document (id and text) and item that has leaked into it."""
    found = found_leaks(docs, benchmark, key, text, item, item_text, min_coverage, min_windows, max_broadcast)
    return found.select(F.col("doc_key").alias(key), F.col("item_key").alias(item), "best.matched_windows", "best.item_windows", "best.coverage", "best.exact")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", min_coverage: float = MIN_COVERAGE, min_windows: int = MIN_WINDOWS, max_broadcast: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """The rows of ``docs`` into which no item has leaked, all columns unchanged;
    a clean row stays even if its id is that of a row that goes."""
    found = found_leaks(docs, benchmark, key, text, item, item_text, min_coverage, min_windows, max_broadcast)
    bad = stash(found.select(F.col("doc_key").cast(docs.schema[key].dataType).alias("__op6_key"), F.col("doc_row").alias("__op6_row")).distinct(), "op6-bad")
    if bad.count() <= MAX_BROADCAST_IDS:
        bad = F.broadcast(bad)
    return docs.join(bad, docs[key].eqNullSafe(bad["__op6_key"]) & (row_of(text) == bad["__op6_row"]), "left_anti").select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _in(words: frozenset[bytes]) -> str:
    return ", ".join(f"'{w.decode()}'" for w in sorted(words))


#: The same in DuckDB's dialect, with the templates themselves instead of hashes.
ORACLE_SQL = rf"""
WITH rows_in AS (
  SELECT row_number() OVER () AS rid, false AS item, doc_id AS id, text FROM (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents)
  UNION ALL SELECT row_number() OVER (), true, item_id, text FROM (SELECT DISTINCT item_id, coalesce(text, '') AS text FROM benchmark)
), words AS (
  SELECT item, rid, id, generate_subscripts(w, 1) AS i, unnest(w) AS w FROM (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM rows_in)
), cores AS (
  SELECT *, regexp_replace(w, '^[[:punct:]]+|[[:punct:]]+$', '', 'g') AS core, regexp_matches(w, '[.!?:]$') AS ends FROM words
), lowered AS (
  SELECT *, translate(core, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, coalesce(lag(ends) OVER (PARTITION BY item, rid ORDER BY i), true) AS starts FROM cores
), typed AS (
  SELECT *, CASE WHEN regexp_full_match(low, '[0-9][0-9.,:/]*(st|nd|rd|th|%)?') OR low IN ({_in(NUMBER_WORDS)}) THEN '<num>'
    WHEN low IN ({_in(UNITS)}) THEN '<unit>' WHEN regexp_full_match(core, '[A-Z][^A-Z]*') THEN '<name>' END AS kind FROM lowered
), kinds AS (
  SELECT item, rid, id, 0 AS form, i, core, low, CASE WHEN kind = '<name>' AND starts THEN NULL ELSE kind END AS kind FROM typed
  UNION ALL SELECT item, rid, id, 1, i, core, low, CASE WHEN kind = '<name>' AND starts AND i > 1 THEN NULL ELSE kind END FROM typed
  WHERE item AND rid IN (SELECT rid FROM typed WHERE item AND i = 1 AND kind = '<name>')
), windows AS (
  {" UNION ALL ".join(f"SELECT item, rid, id, form, p, n, plain < {MIN_LITERAL} AS bare, CASE WHEN plain < {MIN_LITERAL} THEN exact ELSE key END AS key FROM (SELECT item, rid, id, form, i AS p, {n} AS n, string_agg(coalesce(kind, low), ' ') OVER w AS key, string_agg(low, ' ') OVER w AS exact, count(*) OVER w AS got, count(*) FILTER (kind IS NULL) OVER w AS plain, count(*) OVER (PARTITION BY item, rid, form) AS whole FROM kinds WINDOW w AS (PARTITION BY item, rid, form ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)) WHERE got = {n} AND (form = 0 OR p = 1)" + ("" if n == WIDTH else f" AND (NOT item OR whole = {n})") for n in range(MIN_TOKENS, WIDTH + 1))}
), items AS (SELECT * FROM windows WHERE item),
totals AS (SELECT rid AS trid, count(DISTINCT p) AS item_windows, count(DISTINCT p) FILTER (NOT bare) AS item_templates FROM items GROUP BY rid),
hits AS (
  SELECT d.id AS doc_id, t.id AS item_id, d.rid AS drid, t.rid AS trid, t.form, t.p AS ip, d.p - t.p AS off, n, bare FROM windows d JOIN items t USING (n, key, bare) WHERE NOT d.item
),
slots AS (SELECT item, rid, form, i, core FROM kinds WHERE kind IS NOT NULL),
pairs AS (
  SELECT DISTINCT drid, h.trid, off, t.core AS a, d.core AS b FROM hits h JOIN slots t ON t.item AND t.rid = h.trid AND t.form = h.form AND t.i >= h.ip AND t.i < h.ip + h.n
  JOIN slots d ON NOT d.item AND d.rid = h.drid AND d.i = t.i + h.off WHERE NOT bare
),
bad AS (SELECT drid, trid, off FROM pairs GROUP BY ALL HAVING count(*) <> count(DISTINCT a) OR count(*) <> count(DISTINCT b)),
changed AS (SELECT DISTINCT drid, trid, off FROM pairs WHERE a <> b),
covered AS (
  SELECT m.drid, m.trid, ip, max(CAST(c.off IS NULL AS INT)) AS same, max(CAST(NOT bare AS INT)) AS rich FROM (SELECT DISTINCT drid, trid, off, ip, bare FROM hits) m
  LEFT JOIN bad b USING (drid, trid, off) LEFT JOIN changed c USING (drid, trid, off) WHERE b.off IS NULL GROUP BY ALL
), counted AS (SELECT drid, trid, count(*) AS matched_windows, sum(rich) AS matched_templates, min(same) = 1 AS exact FROM covered GROUP BY ALL),
enough AS (
  SELECT d.id AS doc_id, drid, t.id AS item_id, matched_windows, item_windows, greatest(matched_windows / item_windows, matched_templates / nullif(item_templates, 0)) AS coverage, exact
  FROM counted JOIN totals USING (trid) JOIN rows_in d ON NOT d.item AND d.rid = drid JOIN rows_in t ON t.item AND t.rid = trid
  WHERE coverage >= {MIN_COVERAGE} OR matched_windows >= {MIN_WINDOWS}
)
SELECT doc_id, item_id, matched_windows, item_windows, coverage, exact FROM enough
QUALIFY row_number() OVER (PARTITION BY drid, item_id ORDER BY coverage DESC, matched_windows DESC, item_windows DESC, exact DESC) = 1
"""
