"""Removal of content-defined chunks of lines that repeat anywhere in the corpus, in DataFrame functions only.

Every line that is not blank has a hash; a rolling hash slides over the hashes of two neighbouring such lines and chooses the
boundaries between them. There is a boundary

* where the rolling hash occurs nowhere else, or at most half as often in the corpus as the one before or after it: a passage
  that was put between other lines ends there;
* where it is 0 modulo ``divisor``, unless a neighbour is a boundary of the first kind (a line would stand alone): long
  repeated runs fall into chunks that come back into step after a change;
* before and after a line of ``single_words`` words or ``single_chars`` characters.

So boundaries depend on the lines near them and never on a place in the document. Chunks of two lines or more, and single
lines of that length, that occurred before (in a document of smaller doc_id, or earlier in the same one) are removed after
their bytes have been compared with the first occurrence's. The first occurrence is never removed, so every chunk survives
as a whole.

Blank lines (spaces only) belong to no chunk and stay. Null texts stay null; a document all of whose lines are removed has an
empty text. Rows of one doc_id count as one place of the corpus: the same chunk at the same place of two such rows is no
repetition. Null ids come last. All columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, release, shared_dir, store, table, without

#: Words or characters (for scripts without blanks) of a line that is a chunk by itself, and the rolling hash's divisor.
SINGLE_WORDS, SINGLE_CHARS, DIVISOR = 50, 500, 8
#: White space between words, beyond ASCII too.
BLANKS = r"[ \t\x0B\f\r\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"
LAST_ID = 9223372036854775807


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _hashed(df: DataFrame, single_words: int, single_chars: int) -> DataFrame:
    """id, print and s: for every line that is not blank its place i, hashes h and m, and whether it is long (w)."""
    n_words = lambda x: F.size(F.array_remove(F.split(x, BLANKS), ""))
    long = lambda x: F.when(F.length(x) < 2 * single_words - 1, False).when(F.length(x) >= single_chars, True).otherwise(n_words(x) >= single_words)
    spoken = F.filter(F.transform(_lines(F.col("text")), lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: F.trim(s["x"]) != "")
    m = lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, 7), 16, 10).cast("int")
    return df.select("id", "print", F.transform(spoken, lambda s: F.struct(s["i"].alias("i"), F.xxhash64(s["x"]).alias("h"), m(s["x"]).alias("m"), long(s["x"]).alias("w"))).alias("s")).where(F.size("s") > 0)


def _counted(lines: DataFrame) -> DataFrame:
    """id, print and c: for every pair of neighbouring lines of a row how often its rolling hash occurs in the corpus."""
    rolled = F.zip_with(F.slice("s", 1, F.size("s") - 1), F.slice("s", 2, F.size("s")), lambda p, q: F.xxhash64(p["h"], q["h"]))
    pairs = lines.where(F.size("s") > 1).select("id", "print", F.posexplode(rolled).alias("p", "r"))
    common = pairs.groupBy("r").agg(F.count("*").alias("n")).where("n > 1")
    known = pairs.join(common, "r", "left").select("id", "print", F.struct("p", F.coalesce("n", F.lit(1)).alias("n")).alias("c"))
    return known.groupBy("id", "print").agg(F.array_sort(F.collect_set("c")).alias("c"))  # a set: repeated rows count once


def _chunks(lines: DataFrame, divisor: int) -> DataFrame:
    """The chunks that may go: id, print, a (place of the first line), places, k1 and k2 (hashes)."""
    df = lines.join(_counted(lines), ["id", "print"], "left").select("id", "print", "s", F.coalesce(F.transform("c", lambda c: c["n"]), F.array().cast("array<bigint>")).alias("c"))
    line, count = (lambda i: F.get("s", i)), (lambda i: F.coalesce(F.get("c", i), F.lit(0)))
    hard = F.transform("c", lambda n, i: line(i)["w"] | line(i + 1)["w"] | (n == 1) | (2 * n <= F.greatest(count(i - 1), count(i + 1))))
    df = df.withColumn("hard", hard)
    soft = lambda i: ((line(i)["m"].cast("long") * 31 + line(i + 1)["m"]) % divisor == 0) & ~F.coalesce(F.get("hard", i - 1), F.lit(True)) & ~F.coalesce(F.get("hard", i + 1), F.lit(True))
    df = df.withColumn("cut", F.filter(F.transform("hard", lambda v, i: F.when(v | soft(i), i + 1)), lambda j: j.isNotNull()))
    df = df.select("id", "print", "s", F.concat(F.array(F.lit(0)), "cut").alias("starts"), F.concat("cut", F.array(F.size("s"))).alias("stops"))
    spans = F.filter(F.zip_with("starts", "stops", lambda a, z: F.struct(a.alias("a"), (z - a).alias("n"))), lambda p: (p["n"] > 1) | line(p["a"])["w"])
    parts = F.transform(spans, lambda p: F.slice("s", p["a"] + 1, p["n"]))
    keyed = F.transform(parts, lambda x: F.struct(x.getItem("i").alias("places"), F.xxhash64(x.getItem("h")).alias("k1"), F.xxhash64(x.getItem("m")).alias("k2")))
    return df.select("id", "print", F.explode(keyed).alias("k")).select("id", "print", F.get("k.places", F.lit(0)).alias("a"), "k.places", "k.k1", "k.k2")


def _cuts(docs: DataFrame, root: str, single_words: int, single_chars: int, divisor: int) -> DataFrame:
    df = docs.where(F.col("text").isNotNull()).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), F.xxhash64("text").alias("print"), "text")
    lines = store(_hashed(df, single_words, single_chars), root, "lines")
    chunks = store(_chunks(lines, divisor), root, "chunks")
    release(docs.sparkSession, f"{root}/lines")
    twice = chunks.groupBy("k1", "k2").agg(F.min(F.struct("id", "a")).alias("first"), F.max(F.struct("id", "a")).alias("last")).where("first < last").select("k1", "k2")
    suspects = chunks.join(twice, ["k1", "k2"]).groupBy("id", "print").agg(F.collect_set(F.struct("a", "places", "k1", "k2")).alias("chunks"))
    texts = df.join(suspects.hint("merge"), ["id", "print"]).select("id", "print", _lines(F.col("text")).alias("x"), F.explode("chunks").alias("k"))
    texts = store(texts.select("id", "print", "k.*", F.array_join(F.transform("k.places", lambda i: F.get("x", i)), "\n").alias("bytes")), root, "texts")
    release(docs.sparkSession, f"{root}/chunks")
    first = texts.groupBy("k1", "k2").agg(F.min(F.struct("id", "a", "bytes")).alias("first"))
    again = texts.join(first, ["k1", "k2"]).where((F.struct("id", "a") > F.struct("first.id", "first.a")) & (F.col("bytes") == F.col("first.bytes")))
    found = store(again.groupBy("id", "print").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("removed")), root, "cuts")
    release(docs.sparkSession, f"{root}/texts")
    return found


def removed_lines(docs: DataFrame, single_words: int = SINGLE_WORDS, single_chars: int = SINGLE_CHARS, divisor: int = DIVISOR) -> DataFrame:
    """id, print and the sorted places of removed lines, for the documents that lose some."""
    return _cuts(docs, shared_dir(docs.sparkSession), single_words, single_chars, divisor)


def dedupe_lines(docs: DataFrame, removed: str = "removed", **limits: int) -> DataFrame:
    """``docs`` with repeated chunks cut out of ``text``, and ``removed``: the places of the lines cut (null: none)."""
    docs = without(docs, removed)
    key, print_, gone = free_name(docs, "dedup_id"), free_name(docs, "dedup_print"), free_name(docs, "dedup_removed")
    cut = removed_lines(docs, **limits).select(F.col("id").alias(key), F.col("print").alias(print_), F.col("removed").alias(gone))
    left = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))).withColumn(print_, F.xxhash64("text"))
    kept = F.array_except(F.sequence(F.lit(0), F.size(_lines(F.col("text"))) - 1), F.col(gone))
    lines = _lines(F.col("text"))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    joined = left.join(cut.hint("merge"), [key, print_], "left")  # one plan at every size; what is cut grows with the input
    return joined.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns], F.col(gone).alias(removed))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedupe_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), "text")


OP3_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL
), s AS (
  SELECT doc_id, x, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p, CAST('0x' || substr(md5(x), 1, 7) AS BIGINT) AS m,
         length(x) >= 500 OR len(list_filter(regexp_split_to_array(x, '[ \t\x0B\f\r\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'), lambda v: v <> '')) >= 50 AS w
  FROM l WHERE trim(x) <> ''
), two AS (
  SELECT doc_id, p, x, w, m, lead(x) OVER d AS y, lead(w) OVER d AS v, lead(m) OVER d AS o FROM s WINDOW d AS (PARTITION BY doc_id ORDER BY p)
), f AS (
  SELECT *, count(*) OVER (PARTITION BY x, y) AS n FROM two WHERE y IS NOT NULL
), h AS (
  SELECT doc_id, p, m, o, w OR v OR n = 1 OR 2 * n <= greatest(coalesce(lag(n) OVER d, 0), coalesce(lead(n) OVER d, 0)) AS hard FROM f WINDOW d AS (PARTITION BY doc_id ORDER BY p)
), c AS (
  SELECT doc_id, p + 1 AS p, hard OR (m * 31 + o) % 8 = 0 AND NOT coalesce(lag(hard) OVER d, true) AND NOT coalesce(lead(hard) OVER d, true) AS cut FROM h WINDOW d AS (PARTITION BY doc_id ORDER BY p)
), k AS (
  SELECT s.doc_id, s.x, s.i, s.p, s.w, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY s.doc_id ORDER BY s.p) AS k FROM s LEFT JOIN c ON s.doc_id = c.doc_id AND s.p = c.p
), chunks AS (
  SELECT doc_id, k, string_agg(x, chr(10) ORDER BY p) AS bytes, list(i) AS places FROM k GROUP BY doc_id, k HAVING count(*) > 1 OR bool_or(w)
), nth AS (
  SELECT *, row_number() OVER (PARTITION BY bytes ORDER BY doc_id, k) AS nth FROM chunks
), gone AS (SELECT doc_id, unnest(places) AS i FROM nth WHERE nth > 1
), kept AS (
  SELECT l.doc_id, string_agg(x, chr(10) ORDER BY i) AS text FROM l ANTI JOIN gone USING (doc_id, i) GROUP BY l.doc_id
), n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_removed, 0) AS n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text
FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""
