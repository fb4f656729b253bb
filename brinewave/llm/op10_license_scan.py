"""Licence scan: sparse TF-IDF cosine of headers and licence files to templates,
then inheritance from the nearest ancestor directory by path joins (JVM-side
only).

1. Passages: every line of the whole text with a licence cue, and the paragraph
   around it (what lies between blank or comment-only lines), as headers run
   over lines; of a paragraph of more than ``SPAN`` lines, so many from shortly
   before each line with a cue; of a file whose name is a licence file's, also
   the whole and all of its paragraphs.
2. Terms are lower-case runs of letters and digits (dots inside kept). Document
   frequencies of the templates' terms are counted over all files; a term that
   no template has weighs as much as one in a single file. Vectors are tf * idf,
   and the cosine to each template is a sparse dot product by a join on terms.
   A passage meets the templates only if its part within their vocabulary is
   long enough, against the whole vector, for a cosine of ``MIN_COSINE``.
3. A passage that gives a version, or an SPDX tag, is not that of a template with
   another one. A file's licence is that of its best passage at ``MIN_COSINE`` or
   more (ties: the template first by name); as licences come with a copyright,
   ``Proprietary`` counts only if there is no other. A licence file, by name or
   because at least ``FILE_SHARE`` of its words are such passages, holds for its
   directory.
4. Files without a licence of their own inherit from the nearest directory
   above them that has one: distinct directories are unfolded into their
   ancestors and joined by path, files only meet one row for each directory.

Defined results: null or empty texts have no passage and can inherit; a null
path has no directory and inherits nothing; of several licence files in a
directory the best cosine counts, then the template's name; repeated rows are
files of their own with the same result; passages of any length are compared;
other columns are not read, so their names cannot clash; empty tables give an
empty result.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash, table, word_count
from .license_texts import TEMPLATES

CUE = r"(?i)licen[cs]e|copyright|all rights reserved|public domain|creative commons|redistribution and use|permission is hereby granted|spdx"
LICENCE_NAME = r"(?i)^(un)?licen[cs]e([-_.].*)?$|^copying([-_.].*)?$|^notice([-_.].*)?$"
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
#: Paragraphs are separated by lines that are blank but for comment signs.
BREAK = r"\n(?:[ \t\r#*/;%-]*\n)+"
SPAN, BEFORE = 24, 3
TAG = r"spdx-license-identifier:\s*([a-z0-9.+-]*[a-z0-9+])"
VERSION = r"(?:\bversion|\bv\.?)\s*([0-9]+(?:\.[0-9]+)*)"
MIN_COSINE = 0.6
FILE_SHARE = 0.2


def template_terms() -> list[tuple[str, int, str, int]]:
    """template, number of its form, term, count."""
    out = []
    for name, forms in TEMPLATES.items():
        for k, form in enumerate(forms):
            found = re.findall(TERM, form.lower())
            out += [(name, k, t, found.count(t)) for t in sorted(set(found))]
    return out


VOCABULARY = sorted({t for _, _, t, _ in template_terms()})


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def version(text: Column, pattern: str) -> Column:
    """The first version number ('' if none); 2.0 is 2."""
    return F.regexp_replace(F.regexp_extract(F.lower(text), pattern, 1), r"\.0$", "")


def tag(text: Column) -> Column:
    """The SPDX identifier in a text ('' if none), without what follows its version."""
    return F.regexp_replace(F.regexp_extract(F.lower(text), TAG, 1), r"(-only|-or-later|\+)$", "")


def directory(path: Column) -> Column:
    """The path up to its last slash ('' for the root); null for a null path."""
    return F.when(path.isNotNull(), F.regexp_replace(path, r"(^|/)[^/]*$", ""))


def passages(files: DataFrame) -> DataFrame:
    """The rows of ``files`` (id, path, text) with n_words, df (template terms
    of the whole text) and lines, the passages."""
    named = F.coalesce(F.regexp_extract("path", r"([^/]*)$", 1).rlike(LICENCE_NAME), F.lit(False))
    text = F.coalesce("text", F.lit(""))
    cued = lambda parts: F.filter(parts, lambda x: x.rlike(CUE))
    rows = lambda block: F.split(block, "\n")
    at = lambda block: F.filter(F.sequence(F.lit(1), F.size(rows(block))), lambda i: F.element_at(rows(block), i).rlike(CUE))
    spans = lambda block: F.transform(at(block), lambda i: F.array_join(F.slice(rows(block), F.greatest(i - BEFORE, F.lit(1)), F.lit(SPAN)), "\n"))
    blocks = F.split(text, BREAK)
    near = F.flatten(F.transform(F.when(named, blocks).otherwise(cued(blocks)), lambda b: F.when(F.size(rows(b)) > SPAN, spans(b)).otherwise(F.array(b))))
    lines = F.when(~named & ~text.rlike(CUE), F.array().cast("array<string>")).otherwise(F.concat(cued(rows(text)), near, F.when(named, F.array(text)).otherwise(F.array().cast("array<string>"))))
    return files.select("id", "key", "path", named.alias("named"), word_count(F.col("text")).alias("n_words"), F.array_intersect(F.lit(VOCABULARY), terms(text)).alias("df"), F.array_distinct(lines).alias("lines"))


def matches(found: DataFrame, n_files: int, min_cosine: float) -> DataFrame:
    """id, template, cosine, words, single (on one line): the best template of
    each passage."""
    spark = found.sparkSession
    counted = {r["t"]: r["c"] for r in found.select(F.explode("df").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("c")).collect()}  # the vocabulary at most
    idf = {t: math.log((n_files + 1) / (counted.get(t, 0) + 1)) + 1 for t in VOCABULARY}
    other = math.log((n_files + 1) / 2) + 1
    norm: dict[tuple[str, int], float] = {}
    for name, k, t, c in template_terms():
        norm[name, k] = norm.get((name, k), 0.0) + (c * idf[t]) ** 2
    # a row for each term of a template: a constant of this package
    weights = F.broadcast(spark.createDataFrame([(n, k, t, c * idf[t] ** 2 / math.sqrt(norm[n, k])) for n, k, t, c in template_terms()], "template string, form int, term string, w double"))
    known = F.broadcast(spark.createDataFrame(list(idf.items()), "word string, idf double"))
    text = F.col("text")
    lines = found.select("id", F.explode("lines").alias("text")).select("id", "text", version(text, VERSION).alias("said"), tag(text).alias("tag"), word_count(text).alias("words"), (~text.contains("\n")).alias("single"))
    passage = stash(lines.withColumn("p", F.monotonically_increasing_id()), "op10-lines")
    counts = stash(passage.select("p", F.explode(terms(text)).alias("term")).groupBy("p", "term").agg(F.count(F.lit(1)).alias("tf")), "op10-counts")
    length = (
        counts.join(known, counts["term"] == known["word"], "left")
        .groupBy("p")
        .agg(F.sqrt(F.sum(F.pow(F.col("tf") * F.coalesce("idf", F.lit(other)), 2))).alias("norm"), F.sqrt(F.sum(F.pow(F.col("tf") * F.col("idf"), 2))).alias("inside"))
    )
    # the cosine is at most inside / norm; the slack is for rounding
    can = stash(length.filter(F.col("inside") >= (min_cosine - 1e-6) * F.col("norm")).select("p", "norm"), "op10-lengths")
    dots = counts.join(can, "p").join(weights, "term").groupBy("p", "norm", "template", "form").agg(F.sum(F.col("tf") * F.col("w")).alias("dot"))
    scored = dots.withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 9)).filter(F.col("cosine") >= min_cosine)
    near = scored.select("p", "template", "cosine").join(passage.drop("text"), "p")
    number = version(F.col("template"), r"-([0-9]+(?:\.[0-9]+)*)$")
    fits = ((F.col("said") == "") | (number == "") | (F.col("said") == number)) & ((F.col("tag") == "") | (F.col("tag") == F.lower("template")))
    best = near.filter(fits).groupBy("p", "id", "words", "single").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "template")).alias("b"))
    return best.select("id", "words", "single", F.col("b.template").alias("template"), (-F.col("b.c")).alias("cosine"))


def ancestors(path: Column) -> Column:
    """A directory and all above it, as structs of path and depth; depths grow
    with slashes, the root is depth 0."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("dir"), n.alias("depth")))
    root = F.array(F.struct(F.lit("").alias("dir"), F.lit(0).alias("depth")))
    return F.when(path == "", root).otherwise(F.concat(root, above))


def scan(files: DataFrame, key: str, path: str, text: str = "text", min_cosine: float = MIN_COSINE, file_share: float = FILE_SHARE) -> DataFrame:
    """key, license, cosine, license_from ('own', 'inherited' or null),
    license_dir (of an inherited one): a row per input row.

    key need not be unique or set: rows are told apart by a hash of key, path
    and text, so equal rows share a result.
    """
    rows = files.select(F.col(key).alias("key"), F.col(path).cast("string").alias("path"), F.col(text).alias("text"))
    identity = F.concat(F.hex(F.xxhash64("key", "path", "text")), F.hex(F.xxhash64(F.lit(1), "key", "path", "text")))
    found = stash(passages(rows.withColumn("id", identity)), "op10-passages")
    hits = stash(matches(found, found.count(), min_cosine), "op10-matches")
    late = (F.col("template") == "Proprietary").alias("late")
    # lines are parts of paragraphs, and paragraphs of the whole
    said = F.greatest(F.coalesce(F.sum(F.when(F.col("single"), F.col("words"))), F.lit(0)), F.max("words"))
    own = hits.groupBy(F.col("id").alias("of")).agg(F.min(F.struct(late, (-F.col("cosine")).alias("c"), "template")).alias("best"), said.alias("licence_words"))
    own = own.select("of", F.struct("best.c", "best.template").alias("own"), "licence_words")
    slim = found.select("id", "key", "path", "named", "n_words", directory(F.col("path")).alias("dir"))
    judged = stash(slim.join(own, slim["id"] == own["of"], "left").drop("of"), "op10-judged")
    is_file = F.col("own").isNotNull() & F.col("dir").isNotNull() & (F.col("named") | (F.col("licence_words") >= F.lit(file_share) * F.col("n_words")))
    holders = judged.filter(is_file).groupBy(F.col("dir").alias("holder")).agg(F.min("own").alias("held"))
    wanted = judged.filter(F.col("own").isNull() & F.col("dir").isNotNull()).select("dir").distinct()
    above = wanted.select("dir", F.explode(ancestors(F.col("dir"))).alias("a")).select("dir", "a.dir", "a.depth").toDF("below", "dir", "depth")
    near = above.join(holders, above["dir"] == holders["holder"]).groupBy("below").agg(F.max(F.struct("depth", "holder", "held")).alias("near"))
    nearest = stash(near.select("below", F.col("near.holder").alias("holder"), F.col("near.held").alias("held")), "op10-nearest")
    out = judged.join(nearest, F.when(judged["own"].isNull(), judged["dir"]) == nearest["below"], "left")
    return out.select(
        F.col("key").alias(key),
        F.coalesce("own.template", "held.template").alias("license"),
        F.coalesce(-F.col("own.c"), -F.col("held.c")).alias("cosine"),
        F.when(F.col("own").isNotNull(), "own").when(F.col("held").isNotNull(), "inherited").alias("license_from"),
        F.when(F.col("own").isNull(), F.col("holder")).alias("license_dir"),
    )


def path_sql(div: str) -> str:
    """A path for a document, as it has none: in turns of twenty ids, one turn of
    ten is of files in directories of a thousand ids (every other such turn of
    files that are named as a licence is), one of files in the source's directory,
    and the others of files in directories of a hundred ids, a level below."""
    upper, lower = f"CAST(doc_id {div} 1000 AS STRING)", f"CAST(doc_id {div} 100 AS STRING)"
    turn = f"(doc_id {div} 20)"
    return (
        f"source || '/' || CASE {turn} % 10 WHEN 0 THEN {upper} || CASE WHEN {turn} % 20 = 0 THEN '/LICENSE.' ELSE '/f' END || CAST(doc_id AS STRING) "
        f"WHEN 1 THEN 'f' || CAST(doc_id AS STRING) ELSE {upper} || '/' || {lower} || '/f' || CAST(doc_id AS STRING) END"
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs.select("doc_id", F.expr(path_sql("div")).alias("path"), "text"), "doc_id", "path")


def _values(rows: list[tuple]) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)


ORACLE_SQL = rf"""
WITH forms(template, form, term, c) AS (VALUES {_values(template_terms())}),
vocabulary AS (SELECT DISTINCT term FROM forms),
paths AS (SELECT doc_id, coalesce(text, '') AS text, {path_sql("//")} AS path FROM documents),
files AS (
  SELECT doc_id, path, text, regexp_replace(path, '(^|/)[^/]*$', '') AS dir, coalesce(regexp_matches(regexp_extract(path, '([^/]*)$', 1), '{LICENCE_NAME}'), false) AS named,
         CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_words
  FROM paths
),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM files),
seen AS (
  SELECT term, count(*) AS c FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '{TERM}')) AS term FROM files) GROUP BY term
),
idf AS (SELECT v.term, ln((n + 1) / (coalesce(s.c, 0) + 1)) + 1 AS idf FROM vocabulary v CROSS JOIN n LEFT JOIN seen s USING (term)),
norms AS (SELECT template, form, sqrt(sum((c * idf) * (c * idf))) AS norm FROM forms JOIN idf USING (term) GROUP BY ALL),
weights AS (SELECT template, form, term, c * idf * idf / norm AS w FROM forms JOIN idf USING (term) JOIN norms USING (template, form)),
split AS (SELECT doc_id, text, named, string_split(text, chr(10)) AS lines, regexp_split_to_array(text, '{BREAK}') AS blocks FROM files),
parts AS (
  SELECT doc_id, list_distinct(list_concat(list_filter(lines, lambda x: regexp_matches(x, '{CUE}')), flatten(list_transform(CASE WHEN named THEN blocks ELSE list_filter(blocks, lambda x: regexp_matches(x, '{CUE}')) END, lambda b: CASE WHEN len(string_split(b, chr(10))) <= {SPAN} THEN [b] ELSE
      list_transform(list_filter(range(1, len(string_split(b, chr(10))) + 1), lambda i: regexp_matches(string_split(b, chr(10))[i], '{CUE}')), lambda i: array_to_string(string_split(b, chr(10))[greatest(i - {BEFORE}, 1):greatest(i - {BEFORE}, 1) + {SPAN - 1}], chr(10))) END)),
    CASE WHEN named THEN [text] ELSE [] END)) AS parts FROM split
),
passages AS (
  SELECT *, regexp_replace(regexp_extract(lower(text), '{VERSION}', 1), '\.0$', '') AS said, regexp_replace(regexp_extract(lower(text), '{TAG}', 1), '(-only|-or-later|\+)$', '') AS tag,
    NOT contains(text, chr(10)) AS single, CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS words
  FROM (SELECT doc_id, generate_subscripts(parts, 1) AS line, unnest(parts) AS text FROM parts)
),
counts AS (
  SELECT doc_id, line, term, count(*) AS tf FROM (SELECT doc_id, line, unnest(regexp_extract_all(lower(text), '{TERM}')) AS term FROM passages) GROUP BY ALL
),
lengths AS (
  SELECT doc_id, line, sqrt(sum((tf * coalesce(idf, ln((n + 1) / 2) + 1)) * (tf * coalesce(idf, ln((n + 1) / 2) + 1)))) AS norm
  FROM counts CROSS JOIN n LEFT JOIN idf USING (term) GROUP BY ALL
),
scored AS (
  SELECT doc_id, line, template, round(max(dot / norm), 9) AS cosine, regexp_replace(regexp_extract(lower(template), '-([0-9]+(?:\.[0-9]+)*)$', 1), '\.0$', '') AS number
  FROM (SELECT doc_id, line, template, form, sum(tf * w) AS dot FROM counts JOIN weights USING (term) GROUP BY ALL) JOIN lengths USING (doc_id, line) GROUP BY ALL
),
hits AS (
  SELECT doc_id, line, template, cosine, words, single FROM scored JOIN passages USING (doc_id, line)
  WHERE cosine >= {MIN_COSINE} AND (said = '' OR number = '' OR said = number) AND (tag = '' OR tag = lower(template))
  QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY cosine DESC, template) = 1
),
own AS (
  SELECT doc_id, first(template ORDER BY template = 'Proprietary', cosine DESC, template) AS template, first(cosine ORDER BY template = 'Proprietary', cosine DESC, template) AS cosine,
         greatest(coalesce(sum(words) FILTER (single), 0), max(words)) AS words
  FROM hits GROUP BY doc_id
),
holders AS (
  SELECT dir, first(template ORDER BY cosine DESC, template) AS template, max(cosine) AS cosine
  FROM files JOIN own USING (doc_id) WHERE (named OR words >= {FILE_SHARE} * n_words) AND dir IS NOT NULL GROUP BY dir
),
dirs AS (SELECT DISTINCT dir, string_split(dir, '/') AS names FROM files WHERE dir IS NOT NULL),
above AS (
  SELECT dir AS below, depth, CASE WHEN depth = 0 THEN '' ELSE array_to_string(names[1:depth], '/') END AS dir
  FROM (SELECT dir, names, unnest(range(0, len(names) + 1)) AS depth FROM dirs)
),
nearest AS (
  SELECT below, dir AS holder, template, cosine FROM above JOIN holders USING (dir) QUALIFY row_number() OVER (PARTITION BY below ORDER BY depth DESC) = 1
)
SELECT f.doc_id, coalesce(o.template, h.template) AS license, coalesce(o.cosine, h.cosine) AS cosine,
       CASE WHEN o.template IS NOT NULL THEN 'own' WHEN h.template IS NOT NULL THEN 'inherited' END AS license_from,
       CASE WHEN o.template IS NULL THEN h.holder END AS license_dir
FROM files f LEFT JOIN own o USING (doc_id) LEFT JOIN nearest h ON f.dir = h.below
"""
