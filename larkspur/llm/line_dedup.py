"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

Lines are compared after lower-casing and squeezing of white space, as word sequences with an edit bound
of one word: a line is a copy of an earlier one if they are equal, or if one replaced, inserted or deleted
word tells them apart (in lines of ``min_words`` words or more).  Each line emits its variants with one
word deleted, as hashed keys:

* lines with the same variant, the same deleted place and the same length differ in that word alone, so
  the earliest line of such a group is within the bound of all of them: one row a group, no pairs;
* a line that is itself the variant of a line one word longer is within the bound of it.

Lines that share neither their first nor their last half with another line cannot be within the bound of
one, so they emit no variants; those that share one half emit variants of the other half only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, materialise, table

_WHITE = r"[ \t\r\f\x0B]+"
#: White space that squeezing changes: most lines have none, and finding that out costs less.
_LOOSE = r"[\t\r\f\x0B]|  "


def normal_line(line: Column) -> Column:
    """The form in which lines are compared; empty for lines without a word."""
    low = F.lower(line)
    return F.trim(F.when(low.rlike(_LOOSE), F.regexp_replace(low, _WHITE, " ")).otherwise(low))


def has_word(line: Column) -> Column:
    return line.rlike(r"[^ \t\r\f\x0B]")


def word_count(norm: Column) -> Column:
    return F.when(norm == "", 0).otherwise(F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit(""))) + 1)


def without_word(norm: Column, i: Column, n: Column) -> Column:
    """The line without its i-th of n words."""
    return F.concat_ws(" ", F.when(i > 1, _words(norm, i - 1)), F.when(i < n, _words(norm, i - n)))


def _words(norm: Column, k: Column) -> Column:
    """The first k words, or the last -k."""
    return F.call_function("substring_index", norm, F.lit(" "), k)


def _lines(rows: DataFrame) -> DataFrame:
    """(d, t, p) tells a line: document id, hash of its text, place; ties of ids go by the hash."""
    lines = rows.select("d", "t", F.posexplode(F.split("text", "\n")).alias("p", "line")).where(has_word(F.col("line")))
    return lines.select(F.struct("d", "t", "p").alias("at"), normal_line(F.col("line")).alias("norm")).withColumn("n", word_count(F.col("norm")))


def line_verdicts(docs: DataFrame, min_words: int = 8, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(first, near): places of the lines that are the first of their equals, and of those among them
    that are within the edit bound of an earlier line, with that line's place.

    ``at`` is a struct (d, t, p): document id, hash of the document's text and line number from 0.
    """
    rows = docs.select(F.col(id_col).alias("d"), F.xxhash64(F.col(text_col)).alias("t"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    k = F.floor(F.col("n") / 2).cast("int")
    # lengths n and n - 1 share a half size: n // 2 of an odd n, n / 2 - 1 of an even one
    sizes = F.when(F.col("n") % 2 == 0, F.array(k, k - 1)).otherwise(F.array(k))
    halves = F.when(
        F.col("n") >= min_words - 1,
        F.flatten(F.transform(sizes, lambda h: F.array(F.xxhash64(F.lit("a"), h, _words(F.col("norm"), h)), F.xxhash64(F.lit("z"), h, _words(F.col("norm"), -h))))),
    )
    lines = _lines(rows).select("at", "n", F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit(1), "norm").alias("h2"), halves.alias("halves"))
    firsts = materialise(lines.groupBy("h1", "h2").agg(F.min("at").alias("at"), F.first("n").alias("n"), F.first("halves").alias("halves")).select("at", "n", "halves"), "lines")

    # which halves another line shares: the smallest shared half of either side bounds the edited places
    keys = firsts.where("halves IS NOT NULL").select("at", "n", F.posexplode("halves").alias("k", "key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    size = F.floor(F.col("n") / 2).cast("int") - F.floor(F.col("k") / 2).cast("int")
    open_ends = (
        keys.join(shared, "key")
        .groupBy("at", "n")
        .agg(F.min(F.when(F.col("k") % 2 == 0, size)).alias("head"), F.min(F.when(F.col("k") % 2 == 1, size)).alias("tail"))
        .groupBy(F.col("at.d").alias("d"), F.col("at.t").alias("t"))
        .agg(F.collect_list(F.struct(F.col("at.p").alias("p"), "n", "head", "tail")).alias("some"))
    )
    found = open_ends.alias("o").join(rows.alias("r"), F.expr("o.d <=> r.d AND o.t = r.t")).select("r.d", "r.t", "some", F.split("text", "\n").alias("all"))
    found = found.select("d", "t", F.explode(F.transform("some", lambda s: s.withField("line", F.get("all", s.p)))).alias("s"))
    near_lines = found.select(F.struct("d", "t", F.col("s.p").alias("p")).alias("at"), normal_line(F.col("s.line")).alias("norm"), F.col("s.n").alias("n"), "s.head", "s.tail")
    near_lines = materialise(near_lines, "near-lines")

    n, i = F.col("n"), F.col("i")
    places = F.filter(F.sequence(F.lit(1), n), lambda x: (F.col("head").isNotNull() & (x > F.col("head"))) | (F.col("tail").isNotNull() & (x <= n - F.col("tail"))))
    deleted = near_lines.where(n >= min_words).select("at", "n", "norm", F.explode(places).alias("i"))
    deleted = deleted.select(F.xxhash64(without_word(F.col("norm"), i, n)).alias("v"), "i", "n", "at")
    whole = near_lines.select(F.xxhash64("norm").alias("v"), F.lit(0).alias("i"), n, "at")
    # one row for each (variant, deleted place, length) that two lines share, and for each whole line
    groups = deleted.groupBy("v", "i", "n").agg(F.min("at").alias("other"), F.count("*").alias("c")).where("c > 1").select("v", "i", "n", "other")
    keep = groups.unionByName(whole.select("v", "i", (n + 1).alias("n"), F.col("at").alias("other")))
    g = keep.select("v", F.col("i").alias("j"), "n", "other")
    pairs = deleted.join(g, ["v", "n"]).where("j IN (0, i) AND at <> other")
    # the later line of each pair, with the earliest other line
    close = pairs.select(F.greatest("at", "other").alias("at"), F.least("at", "other").alias("other")).groupBy("at").agg(F.min("other").alias("other"))

    # the edit distance itself, on the lines' words
    a = near_lines.select("at", F.split("norm", " ").alias("a"))
    b = near_lines.select(F.col("at").alias("other"), F.split("norm", " ").alias("b"))
    near = close.join(a, "at").join(b, "other").where(within_one_edit(F.col("a"), F.col("b"))).select("at", "other")
    return firsts.select("at"), near


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether one replaced, inserted or deleted element at most tells two arrays apart."""
    long, short = F.when(F.size(a) >= F.size(b), a).otherwise(b), F.when(F.size(a) >= F.size(b), b).otherwise(a)
    differ = F.filter(F.sequence(F.lit(1), F.size(long)), lambda i: ~F.coalesce(F.get(long, i - 1) == F.get(short, i - 1), F.lit(False)))
    at = F.coalesce(F.get(differ, F.lit(0)), F.size(long))  # the first place where they differ
    rest = F.slice(long, at + 1, F.size(long))
    return ((F.size(long) == F.size(short)) & (F.size(differ) <= 1)) | ((F.size(long) == F.size(short) + 1) & (rest == F.slice(short, at, F.size(long))))


def dedup_lines(docs: DataFrame, min_words: int = 8, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``docs`` with the same columns; each text keeps the lines that are no copy of an earlier line
    (smaller id, then text hash, then place) of the table.  Lines are judged on the input, not on what is
    left of it, so the result does not depend on any order of work.

    Lines without a word stay.  Null texts stay null, a text of copies alone becomes empty; no row goes.
    Null ids come first.  Rows that are equal in id and text are one document, and keep the same lines.
    ``length_col``: a column that is to hold the characters of the new text.
    """
    names = docs.columns
    if len(set(names)) < len(names):
        raise ValueError(f"columns with equal names: {names}")
    own_d, own_t, own_h, own_kept = (free_name(names, c) for c in ("__d", "__t", "__h", "__kept"))
    first, near = line_verdicts(docs, min_words, id_col, text_col)
    kept = first.join(near.select("at"), "at", "left_anti")
    kept = kept.groupBy(F.col("at.d").alias(own_d), F.col("at.t").alias(own_t)).agg(F.array_sort(F.collect_list("at.p")).alias(own_kept))
    text, d = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    joined = docs.withColumn(own_h, F.xxhash64(text)).join(kept, F.col(own_d).eqNullSafe(d) & (F.col(own_t) == F.col(own_h)), "left")
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    marks = F.coalesce(own_kept, F.array().cast("array<int>"))
    # the kept places are as many as lines at most: a map makes each look-up short in long texts
    own = F.map_from_arrays(marks, marks)
    left = F.filter(lines, lambda s: F.map_contains_key(own, s.i) | ~has_word(s.x))
    new = F.array_join(F.transform(left, lambda s: s.x), "\n")
    columns = {text_col: F.when(text.isNotNull(), new)}
    if length_col:
        columns[length_col] = F.when(text.isNotNull(), F.length(new)).otherwise(F.col(f"`{length_col}`")).cast(docs.schema[length_col].dataType)
    return joined.select(*[columns[c].alias(c) if c in columns else F.col(f"`{c}`") for c in names])


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, those left, and the digest of the text that is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    count = lambda c: F.when(c.isNull(), 0).otherwise(F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + 1).cast("long")
    kept = dedup_lines(docs.withColumn("n_lines", count(F.col("text"))))
    text = F.coalesce("text", F.lit(""))
    return kept.select("doc_id", "n_lines", F.length(text).cast("long").alias("n_chars_kept"), F.sha2(text, 256).alias("kept_sha256"))


#: The same by plain means: all lines, all variants.
OP10_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS p, unnest(string_split(text, chr(10))) AS line FROM documents),
m AS (SELECT doc_id, p, line, trim(regexp_replace(lower(line), '[ \t\r\f\x0B]+', ' ', 'g')) AS norm FROM l),
c AS (SELECT norm, string_split(norm, ' ') AS w, len(string_split(norm, ' ')) AS n, min((doc_id, p)) AS pl FROM m WHERE norm <> '' GROUP BY norm),
v AS (SELECT pl, n, i, array_to_string(list_concat(w[1:i-1], w[i+1:n]), ' ') AS v FROM (SELECT pl, n, w, unnest(range(1, n + 1)) AS i FROM c WHERE n >= 8)),
s AS (SELECT v, i, n, min(pl) AS pl, count(*) AS k FROM v GROUP BY v, i, n HAVING count(*) > 1),
near AS (
  SELECT v.pl FROM v JOIN s ON v.v = s.v AND v.i = s.i AND v.n = s.n AND s.pl < v.pl
  UNION SELECT greatest(v.pl, c.pl) FROM v JOIN c ON v.v = c.norm),
kept AS (
  SELECT m.doc_id, m.p, m.line FROM m LEFT JOIN c ON c.norm = m.norm
  WHERE m.norm = '' OR (c.pl = (m.doc_id, m.p) AND c.pl NOT IN (SELECT pl FROM near))),
t AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY p) AS text FROM kept GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines,
  CAST(length(coalesce(t.text, '')) AS BIGINT) AS n_chars_kept, sha256(coalesce(t.text, '')) AS kept_sha256
FROM documents d LEFT JOIN t USING (doc_id)
"""
