"""Mixing sources to target weights by systematic sampling (JVM-side only).

Every document of a source gets the same number of expected copies, target /
source size. The expected copies are prefix-summed within the source, one
random offset is added, and a copy is emitted for each integer boundary that a
document's interval crosses. Documents are summed in order of a size class
(quarter octaves), a salt, the size and a hash of the key, so neighbours have
like sizes and the words taken come near the target.

Prefix sums without a hot group: rows are ranked within (source, size class,
salt), and the counts of those cells, at most ``SALTS`` times the size classes
for each source whatever the input's size, are summed before them. Sources
themselves can be many: their order and the water level are running sums over
range partitions, to which the sums of the partitions before are added.

Defined results: null text has size 0 and the null source is one source, after
all others; a source of size 0 has target 0; empty tables give an empty
result; repeated rows are documents of their own, and of equal rows it doesn't
matter which is taken; rows that share an id (or have none) are told apart by a
hash of the row; a very long text counts whole; clashing columns are no matter,
as working columns are selected first, but an input column named ``copy`` gives
way to the output's. Targets are reached by
water-filling: what exceeds ``MAX_COPIES`` times a source's size goes to the
others by weight.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import other_columns, stash, table, word_count

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_COPIES = 2.0
SALTS = 64
#: Sources up to this number are broadcast; more are joined by a shuffle.
MAX_BROADCAST_SOURCES = 100_000
SEED = 3


def hash60(*parts: Column) -> Column:
    """60 bits of an md5, the same in any SQL."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 15), 16, 10).cast("long")


def running(rows: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with the sum of each column of ``sums`` over the rows before, in
    ``order``. Rows are sorted in range partitions; only a row for each partition
    meets in one task."""
    placed = stash(rows.withColumns(sums).repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "op3-ranged")
    ahead = Window.orderBy("of_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy(F.col("part").alias("of_part")).agg(*(F.sum(c).alias(c) for c in sums))
    starts = parts.select("of_part", *(F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"start_{c}") for c in sums))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    met = placed.withColumns({c: F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums}).join(F.broadcast(starts), F.col("part") == F.col("of_part"))
    return met.select(*rows.columns, *((F.col(c) + F.col(f"start_{c}")).alias(c) for c in sums))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MAX_COPIES) -> DataFrame:
    """source, source_size, target: one row per source.

    Sources reach their cap in the order of cap / weight, so the capped ones
    are a prefix of that order: the shortest one after which the level (what is
    left by weight) lifts no other source above its cap.
    """
    rows = sizes.groupBy("source").agg(F.sum("size").alias("n")).withColumn("null", F.col("source").isNull())
    named = running(rows, ["null", "source"], {"at": F.lit(1)})
    weight = F.element_at(F.lit(list(weights)), (F.col("at") % len(weights) + 1).cast("int"))
    weighed = named.withColumn("w", weight).withColumn("r", F.lit(float(most)) * F.col("n") / F.col("w"))
    levels = stash(running(weighed, ["r", "at"], {"n_before": F.col("n"), "w_before": F.col("w")}), "op3-levels")
    whole = levels.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("w")).first()
    left = F.lit(float(share) * whole["n"]) - F.lit(float(most)) * F.col("n_before")
    rest = F.lit(float(whole["w"])) - F.col("w_before")
    cut = levels.filter(left / rest <= F.col("r")).agg(F.min(F.struct("r", "at", left.alias("left"), rest.alias("rest"))).alias("c")).first()["c"]
    target = F.lit(float(most)) * F.col("n")
    if cut is not None:
        under = (F.col("r") > cut["r"]) | ((F.col("r") == cut["r"]) & (F.col("at") >= cut["at"]))
        target = F.when(under, F.least(F.lit(cut["left"]) * F.col("w") / F.lit(cut["rest"]), target)).otherwise(target)
    return stash(levels.select(F.col("source").alias("of"), F.col("n").alias("source_size"), target.alias("target")), "op3-targets")


def copies(slim: DataFrame, salts: int = SALTS, seed: int = SEED, **how) -> DataFrame:
    """slim has key, source, row and size; adds source_size, target and copies."""
    targets = source_targets(slim, **how)
    if targets.count() <= MAX_BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    bits = F.bin("size")  # the number of bits, and the two after the first
    size_class = (4 * F.length(bits) + F.coalesce(F.conv(F.substring(bits, 2, 2), 2, 10).cast("int"), F.lit(0))).cast("int")
    hashed = hash60(F.lit(str(seed)), F.coalesce(F.col("key").cast("string"), F.lit("")))
    rows = slim.withColumn("cls", size_class).withColumn("h", hashed).withColumn("salt", F.pmod(F.col("h"), F.lit(salts)).cast("int"))
    cell = ["source", "cls", "salt"]
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*cell).orderBy("size", "h", "key", "row")))
    before = (
        rows.groupBy(*cell)
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("cls", "salt").rowsBetween(Window.unboundedPreceding, -1)))
        .select(*(F.col(c).alias(f"b_{c}") for c in cell), F.coalesce("before", F.lit(0)).alias("before"))
    )
    on = ranked["source"].eqNullSafe(before["b_source"]) & (ranked["cls"] == before["b_cls"]) & (ranked["salt"] == before["b_salt"])
    placed = ranked.join(before, on).withColumn("i", F.col("rank") + F.col("before"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = hash60(F.lit(str(seed)), F.when(F.col("source").isNull(), "null").otherwise("source"), F.coalesce("source", F.lit(""))) / F.lit(float(1 << 60))
    joined = placed.join(targets, placed["source"].eqNullSafe(targets["of"]))
    crossed = F.floor(F.col("i") * rate + offset) - F.floor((F.col("i") - 1) * rate + offset)
    most = F.lit(math.ceil(how.get("most", MAX_COPIES)))  # rounding may not add a copy
    return joined.select("key", "source", "row", "size", "source_size", "target", F.least(crossed, most).alias("copies"))


def sized(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """key, source, row (a hash of the row) and size of every row, written once:
    the texts are read in one pass."""
    return stash(docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), row_of(docs).alias("row"), word_count(F.col(text)).alias("size")), "op3-sizes")


def row_of(docs: DataFrame) -> Column:
    """A hash of all columns (maps aside, which have none)."""
    return F.xxhash64(*(F.col(c) for c, kind in docs.dtypes if "map<" not in kind))


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **how) -> DataFrame:
    found = copies(sized(docs, key, source, text), **how)
    return found.select(F.col("key").alias(key), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def query(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


#: Taken rows up to this number are broadcast (a key and a count each).
MAX_BROADCAST_ROWS = 2_000_000


def sample_mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **how) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as it is taken,
    with the number of the copy in ``copy``.

    Copies are decided on narrow rows and joined to the texts by id and a hash
    of the row; the texts are shuffled only if more rows are taken than may be
    broadcast. Equal rows are taken as one row with the copies of all of them.
    A column ``copy`` of ``docs`` counts as a part of its rows and is replaced.
    """
    decided = stash(copies(sized(docs, key, source, text), **how).select("key", "row", "copies"), "op3-copies")
    names, identity = other_columns(docs, "copy"), ["__op3_key", "__op3_row"]
    each = decided.groupBy(F.col("key").alias("__op3_taken_key"), F.col("row").alias("__op3_taken_row")).agg(F.sum("copies").alias("__op3_copies"), F.count(F.lit(1)).alias("__op3_rows"))
    repeated = stash(each.filter(F.col("__op3_rows") > 1), "op3-repeated")
    rows = docs.withColumn("__op3_key", F.col(key)).withColumn("__op3_row", row_of(docs))
    met = rows["__op3_key"].eqNullSafe(F.col("__op3_taken_key")) & (rows["__op3_row"] == F.col("__op3_taken_row"))
    parts = []
    if repeated.limit(1).count():
        taken = decided.join(repeated, decided["key"].eqNullSafe(repeated["__op3_taken_key"]) & (decided["row"] == repeated["__op3_taken_row"]), "left_anti")
        # equal rows are made one before the shuffle, so a hot one costs a row for each task
        parts.append(rows.join(narrow(repeated), met, "left_semi").dropDuplicates(identity).join(narrow(repeated.filter("__op3_copies > 0")), met))
    else:
        taken = decided
    taken = taken.filter("copies > 0").select(F.col("key").alias("__op3_taken_key"), F.col("row").alias("__op3_taken_row"), F.col("copies").alias("__op3_copies"))
    parts.append(rows.join(narrow(taken), met))
    return parts_of(parts, names)


def narrow(taken: DataFrame) -> DataFrame:
    """Broadcast if it is small enough, whatever the input's size."""
    return F.broadcast(taken) if taken.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS else taken


def parts_of(parts: list[DataFrame], names: list[str]) -> DataFrame:
    out = [p.select(*names, F.explode(F.sequence(F.lit(1), F.col("__op3_copies").cast("int"))).alias("copy")) for p in parts]
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


#: The same mix in DuckDB's dialect, with one window for each source instead of cells.
ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS n FROM sized GROUP BY source
), numbered AS (
  SELECT source, n, row_number() OVER (ORDER BY source IS NULL, encode(source)) AS pos FROM sources
), weighed AS (
  SELECT *, (CASE (pos - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END)::DOUBLE AS w FROM numbered
), ordered AS (
  SELECT *, 2.0::DOUBLE * n / w AS r, row_number() OVER (ORDER BY 2.0::DOUBLE * n / w, pos) AS k FROM weighed
), levels AS (
  SELECT *,
    1.5::DOUBLE * (SELECT sum(n) FROM sources) - coalesce(sum(2.0::DOUBLE * n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
    sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS whole
  FROM ordered
), cut AS (
  SELECT k, remaining, whole FROM levels WHERE remaining / whole <= r ORDER BY k LIMIT 1
), targets AS (
  SELECT o.source, o.n, CASE WHEN c.k IS NULL OR o.k < c.k THEN 2.0::DOUBLE * o.n
                             ELSE least(c.remaining * o.w / c.whole, 2.0::DOUBLE * o.n) END AS target
  FROM ordered o LEFT JOIN cut c ON true
), hashed AS (
  SELECT *, CAST('0x' || substr(md5('3:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h,
         4 * length(bin(size)) + CASE substr(bin(size), 2, 2) WHEN '1' THEN 1 WHEN '01' THEN 1 WHEN '10' THEN 2 WHEN '11' THEN 3 ELSE 0 END AS cls
  FROM sized
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY cls, h % 64, size, h, doc_id) AS i FROM hashed
), crossed AS (
  SELECT r.doc_id, r.size, t.n AS source_size, t.target, r.i,
         CASE WHEN t.n > 0 THEN t.target / t.n ELSE 0.0 END AS rate,
         CAST('0x' || substr(md5('3:' || CASE WHEN r.source IS NULL THEN 'null' ELSE 'source' END || ':' || coalesce(r.source, '')), 1, 15) AS BIGINT)::DOUBLE / 1152921504606846976.0::DOUBLE AS u
  FROM ranked r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(least(floor(i * rate + u) - floor((i - 1) * rate + u), 2) AS BIGINT) * size AS taken
FROM crossed
"""
