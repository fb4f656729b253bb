"""Near-duplicate documents by bottom-k sketches of their word shingles.

1. One pass over the texts: the set of 5-word shingles (64-bit hashes of the
   whole text), its size, a 128-bit signature of the set, and the sketch: the
   ``K`` smallest hashes, of one hash function.
2. Documents with equal sets are one class; its smallest id stands for it.
3. Inverted lists of the retained values. Two sets that are similar enough
   share many of the values they retain (surely where both are retained whole,
   else but for a chance of some 1e-5 at the very threshold), so it suffices
   that one of a document's rarest ones is shared: by the prefix rule, of s
   values with t shared, one is among the s - t + 1 rarest of either. Values
   that one class alone retains use up places and make no list, so common lines
   and passages generate nothing for documents that have enough of their own.
   Members of long lists are sketched again with eight times the values, as
   often as a long list has a member that isn't retained whole (``LEVELS``);
   that bounds the share more and more tightly, and in the end exactly. The
   lists of the longer sketches take the place of the long ones.
4. Lists are worked off in rounds of hubs: a list's members are compared with
   that of the lowest id, then with about 7, 56, ... others by a hash of their
   ids, so that no list is ever put in order; pairs that are in one component
   by then are left out, as are those whose places in the list leave too few
   values for two sets of their sizes to share, and a list that lies within one
   component is finished. A group of thousands of copies is so linked through a
   few hubs and is never expanded into its pairs, and variants that are too far
   from all others hold too many values of their own to fit any partner; no pair
   of different components that shares a list is left untested.
5. A candidate pair is estimated on the K smallest values of the union of the
   two sketches, and what passes is confirmed on the full sets.

Defined results: a text with fewer than five words is one shingle, its whole
sequence; without words (or null) the set is empty, linked to nothing and
kept; a null id stands for itself alone: no component, kept; of different texts
that share an id, the one with the highest signature takes part in links, for
all of them; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, in_arrow, mix, small_batches, stash, stash_counted, table, text_bytes, window_hashes, word_hashes
from .components import components

SHINGLE = 5
PERCENT = 75
K = 64
#: Values of the sketches; members of lists longer than LONG go on to the next.
LEVELS = (K, 512, 4096, 32768)
LONG = 64
#: The one level of the exact mode: every set is retained whole.
WHOLE = 2**31 - 1
#: Deviations below the mean that a share is still expected: a chance of 2e-5.
DEVIATIONS = 4.25
#: Each round has so many times the hubs of all before it.
WIDEN = 7
#: Ids up to this number are broadcast (16 MB); more are joined by a shuffle.
MAX_BROADCAST_IDS = 2_000_000


def shingles(data: bytes | None) -> np.ndarray:
    """The sorted set of shingle hashes (int64) of a text."""
    words = data.lower().split() if data else []
    if not words:
        return np.empty(0, np.int64)
    hashes = word_hashes(words)
    if len(words) < SHINGLE:
        found = window_hashes(hashes, len(words)) ^ mix(np.array([len(words)], np.uint64))
    else:
        found = window_hashes(hashes, SHINGLE)
    return np.unique(found.view(np.int64))


def long_lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64)))


def sketches(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """key, n, s1, s2 (signature of the set), sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            sets = [shingles(t) for t in text_bytes(batch.column(1))]
            signs = np.array([signature(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(signs[:, 0]), pa.array(signs[:, 1]), long_lists([s[:k] for s in sets])],
                names=["key", "n", "s1", "s2", "sketch"],
            )

    slim = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return in_arrow(slim, run, "key long, n long, s1 long, s2 long, sketch array<long>")


def signature(items: np.ndarray) -> tuple[int, int]:
    return divmod(xxhash.xxh3_128_intdigest(items.tobytes()), 1 << 64)


def full_sets(docs: DataFrame, members: DataFrame, key: str, text: str) -> DataFrame:
    """of, items: the whole shingle sets of ``members`` (of, s1, s2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            sets = [shingles(t) for t in text_bytes(batch.column(1))]
            signs = np.array([signature(s) for s in sets], np.uint64).view(np.int64)
            own = (signs[:, 0] == np.asarray(batch.column(2))) & (signs[:, 1] == np.asarray(batch.column(3)))
            out = pa.RecordBatch.from_arrays([batch.column(0), long_lists(sets)], names=["of", "items"])
            yield out.filter(pa.array(own))

    slim = docs.select(F.col(key).cast("long").alias("of"), F.col(text).alias("text"))
    return in_arrow(semi(slim, members, "of", "inner").select("of", "text", "s1", "s2"), run, "of long, items array<long>")


def semi(rows: DataFrame, ids: DataFrame, column: str, how: str = "left_semi") -> DataFrame:
    """Rows with (or without) an id in ``ids``; a bounded id list is broadcast,
    so that texts are not shuffled, a longer one is not."""
    if ids.count() <= MAX_BROADCAST_IDS:
        ids = F.broadcast(ids)
    return rows.join(ids, column, how)


def shared_values(k: int, percent: int = PERCENT) -> int:
    """Of the k values of a union's sketch, how many a pair at the threshold
    shares, but for a chance of 2e-5."""
    p = percent / 100
    return int(k * p - DEVIATIONS * (k * p * (1 - p)) ** 0.5)


def shared_by_size(k: Column, n_a: Column, n_b: Column, percent: int = PERCENT) -> Column:
    """How many of the k values of one sketch the other retains as well, but for
    a chance of 2e-5, if the sets are similar enough and not both whole. Of the
    two sketches, that which ends at the lower value is a sample of its set, of
    which the share p at least is in the other set; of sets of one size that is
    more than of sets whose sizes are far apart."""
    s = percent / 100
    p = F.least(F.lit(s / (1 + s)) * (1 + F.least(n_a, n_b) / F.greatest(n_a, n_b)), F.lit(1.0))
    return F.floor(k * p - DEVIATIONS * F.sqrt(k * p * (1 - p)))


def inverted_lists(reps: DataFrame, k: int, percent: int = PERCENT) -> DataFrame:
    """v, rep, n, left: the lists that remain after the prefix rule; left is the
    number of a member's values from this one on, in order of rarity.

    reps: rep, n, sketch (of k values), a row per class.
    """
    entries = reps.select("rep", F.explode("sketch").alias("v"))
    # counts are combined before their shuffle, and a value that many sketches
    # retain is a skewed key of a join, which is split at run time
    common = entries.groupBy("v").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    by_rep = entries.join(common, "v").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("c", "v"))).alias("found"))  # k at most
    kept = F.least("n", F.lit(k))
    least = F.ceil(F.col("n") * percent / F.lit(100.0))
    # a partner of a set this small is retained whole, too; the union with one of
    # a set that is just retained whole can have fewer than k values, or more
    shared = F.when(F.col("n") * 100 <= percent * k, least).when(F.col("n") <= k, F.least(least, F.lit(shared_values(k, percent)))).otherwise(F.lit(shared_values(k, percent)))
    own = kept - F.size("found")
    cut = by_rep.join(reps.select("rep", "n"), "rep").withColumn("take", (kept - shared + 1 - own).cast("int")).filter("take > 0")
    placed = cut.select("rep", "n", F.posexplode(F.slice("found", F.lit(1), F.col("take"))).alias("at", "x"), (kept - own).alias("rest"))
    return placed.select(F.col("x.v").alias("v"), "rep", "n", (F.col("rest") - F.col("at")).cast("int").alias("left"))


def with_sizes(lists: DataFrame) -> DataFrame:
    """Lists of two members or more, with their size and lowest member."""
    sizes = lists.groupBy("v").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("first")).filter("size > 1")
    return lists.join(sizes, "v")


def could_share(k: Column, left: Column, n_a: Column, n_b: Column, percent: int = PERCENT) -> Column:
    """Whether sets with at most ``left`` values in common can be similar. At the
    rarest value that a pair shares, left is a bound; at others it may be too
    low, which loses nothing, as the pair is met there as well."""
    fit = (n_a * 100 >= n_b * percent) & (n_b * 100 >= n_a * percent)
    whole = (n_a <= k) & (n_b <= k)
    return fit & F.when(whole, left * 100 >= percent * (n_a + n_b - left)).otherwise(left >= shared_by_size(k, n_a, n_b, percent))


def links(pairs: DataFrame, sketch: DataFrame, sets: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b and further columns) that are similar enough: estimate
    first, then full sets."""
    side = lambda x, c: sketch.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(c))
    near = pairs.join(side("a", "sa"), "a").join(side("b", "sb"), "b").filter(
        (F.col("n_a") * 100 >= F.col("n_b") * percent) & (F.col("n_b") * 100 >= F.col("n_a") * percent)
    )
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    both = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
    # where the union is retained whole the share is the similarity itself
    enough = F.when(F.size(F.array_union("sa", "sb")) < k, both * 100 >= percent * F.size(F.array_union("sa", "sb"))).otherwise(both >= shared_values(k, percent))
    near = near.filter(enough).select(*pairs.columns, "n_a", "n_b")
    full = lambda x, c: sets.select(F.col("of").alias(x), F.col("items").alias(c))
    common = F.size(F.array_intersect("ia", "ib")).cast("long")
    return near.join(full("a", "ia"), "a").join(full("b", "ib"), "b").filter(common * 100 >= percent * (F.col("n_a") + F.col("n_b") - common)).select(*pairs.columns)


def all_lists(reps: DataFrame, sets: Callable[[DataFrame], DataFrame], levels: tuple[int, ...]) -> DataFrame:
    """k, v, rep, n, left, size: the lists of every level that are worked off.

    sets gives the whole shingle sets of representatives that have a list.
    """
    kept, now, whole = [], reps, None
    for k, longer in zip(levels, (*levels[1:], None), strict=True):
        lists = stash(with_sizes(stash(inverted_lists(now, k), "op7-listed")).withColumn("k", F.lit(k)), "op7-short")
        whole = sets(lists) if whole is None else whole
        crowded = lists.filter(F.col("size") > LONG)
        if longer is None or not crowded.filter(F.col("n") > k).limit(1).count():
            kept.append(lists)  # no longer sketch says more
            break
        kept.append(lists.filter(F.col("size") <= LONG))
        members = crowded.select(F.col("rep").alias("of")).distinct()
        now = stash(whole.join(members, "of", "left_semi").dropDuplicates(["of"]).select(F.col("of").alias("rep"), F.size("items").cast("long").alias("n"), F.slice("items", 1, longer).alias("sketch")), "op7-longer")
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return out


def representative_components(docs: DataFrame, reps: DataFrame, key: str, text: str, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """node, component for the classes that are linked to another."""
    spark, held = docs.sparkSession, {}

    def sets_of(lists: DataFrame) -> DataFrame:
        listed = lists.select(F.col("rep").alias("of")).distinct()
        held["sketch"] = stash(reps.join(listed, reps["rep"] == listed["of"], "left_semi"), "op7-sketches")
        members = held["sketch"].select(F.col("rep").alias("of"), "s1", "s2")
        held["sets"] = stash(full_sets(docs, members, key, text), "op7-sets")
        return held["sets"]

    both = all_lists(reps, sets_of, levels)
    sketch, sets = held["sketch"], held["sets"]
    # the lowest member comes first, as components form around it, and the others
    # lie evenly between the places 2 and size + 1
    place = F.shiftrightunsigned(F.xxhash64("rep", F.lit(7)), 33) / F.lit(float(1 << 31)) * (F.col("size") - 1) + 2
    ranked = both.withColumn("rank", F.when(F.col("rep") == F.col("first"), F.lit(1.0)).otherwise(place)).drop("first")
    named, left, _ = stash_counted(ranked.withColumn("label", F.col("rep")), "op7-lists")
    merges: list[DataFrame] = []  # of each round: label, and the label of the component that it is now in
    merged = 0  # rows of them, at most
    low, high = 1, 2
    while left:
        hubs = named.filter((F.col("rank") >= low) & (F.col("rank") < high)).select("k", "v", F.col("rep").alias("a"), F.col("rank").alias("at"), F.col("label").alias("la"), F.col("n").alias("n_hub"), F.col("left").alias("left_hub"))
        fits = could_share(F.col("k"), F.least("left", "left_hub"), F.col("n"), F.col("n_hub"))
        met = named.join(hubs, ["k", "v"]).filter(((F.col("rank") > F.col("at")) | ((F.col("rank") == F.col("at")) & (F.col("rep") > F.col("a")))) & (F.col("la") != F.col("label")) & fits)
        pairs = met.select("a", F.col("rep").alias("b"), "la", F.col("label").alias("lb")).distinct()
        found, n, _ = stash_counted(links(pairs, sketch, sets, levels[0]), "op7-links")
        rows = named.filter(F.col("size") >= high)
        if n:
            # only labels are merged: what is one component by now is one node
            merges.append(stash(components(found, "la", "lb", n), "op7-merges"))
            merged += 2 * n
            rows = rows.join(merges[-1], rows["label"] == merges[-1]["node"], "left").withColumn("label", F.coalesce("component", "label")).drop("node", "component")
        # what lies within one component is finished
        spread = rows.groupBy("k", "v").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("k", "v")
        old = named
        named, left, _ = stash_counted(rows.join(spread, ["k", "v"], "left_semi"), "op7-lists")
        discard(old, found)
        low, high = high, high + WIDEN * (high - 1)
    discard(named, sets, sketch)
    if not merges:
        return spark.createDataFrame([], "node long, component long")
    # a label and what it was merged into are one component, whatever the round
    steps = merges[0]
    for merge in merges[1:]:
        steps = steps.union(merge)
    return components(steps, "node", "component", merged)


def label_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", exact: bool = False) -> DataFrame:
    """key, n_shingles, component_id, kept: a row per input row.

    exact: lists of whole sets instead of sketches, so that no pair is missed
    by chance, for the price of a shuffle of all shingles.
    """
    levels = (WHOLE,) if exact else LEVELS
    found = stash(sketches(docs, key, text, levels[0]), "op7-sketched")
    classes = stash(found.filter("n > 0 and key is not null").groupBy("s1", "s2").agg(F.min("key").alias("rep")), "op7-classes")
    firsts = classes.groupBy(F.col("rep").alias("key")).agg(F.max(F.struct("s1", "s2")).alias("x")).select("key", "x.s1", "x.s2")
    first_rows = found.join(firsts, ["key", "s1", "s2"], "left_semi")
    if found.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1 and key is not null").limit(1).count():
        first_rows = first_rows.dropDuplicates(["key"])
    reps = stash(first_rows.select(F.col("key").alias("rep"), "n", "s1", "s2", "sketch"), "op7-reps")
    linked = representative_components(docs, reps, key, text, levels)
    discard(reps)
    named = stash(
        classes.join(linked, classes["rep"] == linked["node"], "left").select(F.col("s1").alias("t1"), F.col("s2").alias("t2"), F.coalesce("component", "rep").alias("class_component")), "op7-named-classes"
    )
    rows = found.select("key", F.col("n").alias("n_shingles"), "s1", "s2")
    joined = rows.join(named, (rows["s1"] == named["t1"]) & (rows["s2"] == named["t2"]) & (rows["n_shingles"] > 0), "left")
    component = F.when(F.col("key").isNull(), None).otherwise(F.coalesce("class_component", "key"))
    return joined.select(F.col("key").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged."""
    gone = stash(label_documents(docs, key, text).filter(~F.col("kept")).select(F.col(key).cast(docs.schema[key].dataType).alias(key)).distinct(), "op7-gone")
    return semi(docs, gone, key, "left_anti").select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return label_documents(table(spark, sf_dir, "documents"))


#: The same over all pairs that share a shingle, in DuckDB's dialect.
ORACLE_SQL = rf"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {SHINGLE} THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - {SHINGLE - 2}), lambda i: array_to_string(words[i:i + {SHINGLE - 1}], ' ')) END) AS g FROM split
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sets x JOIN sets y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, component) AS (
  SELECT doc_id, doc_id FROM split UNION SELECT b, component FROM reach JOIN both_ways ON a = node
), lowest AS (SELECT node, min(component) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM split d JOIN lowest ON node = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""
