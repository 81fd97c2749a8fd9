"""Quality rules with cross-document line frequency, in built-in DataFrame functions only.

Every line of a text is normalised (lower case, white space squeezed) and hashed. Per host, the documents
that hold a line are counted; documents of one text count as one document, because a text that stands in a
host a hundred times over is a matter for deduplication: counted row by row, all its lines would be
boilerplate, and all of its copies would be lost. A line found in more than ``MIN_DOCS`` documents of a
host is boilerplate and is taken away, and a document is depleted, and rejected, when less than
``kept_percent`` of the words of its distinct lines are left. The base rules look at one text alone.

The documents are read once; their metrics and line hashes are written to the shared folder and read from
there. No line is ever shuffled, and a text only as said below; what travels are 64-bit hashes with word counts. Boilerplate
lines, and the texts that hold some, are broadcast when a count shows them to be few, and joined by their
keys otherwise; rows of texts that a thousandth of all rows share are spread over salted keys there. In that case
``accepted`` moves the rows of flawed texts, and of few others, with their texts.

Defined results: null or empty texts have no words, fail the base rule and are not kept; a null host
is a host of its own (the empty string); repeated rows are judged alike; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.llm.common import discard, renamed, stash, table

SPACE = r"[\x20\x09-\x0D]+"
MIN_DOCS, KEPT_PERCENT = 20, 30
#: Tables of so many rows or fewer are broadcast.
FEW = 50_000
#: Join keys over which the rows of a text that very many documents share are spread.
SALT = 16
#: Words of 64 bits, at most, of the table that tells which texts may be flawed.
MARKS = 1 << 18


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def base_metrics(docs: DataFrame) -> DataFrame:
    """The single-document counts, each array used in one row and never shuffled.

    Repeats: the hashes of the 5-word windows are put in order with their positions; neighbours of
    equal hash are repeats; sorted positions of those windows give the covered words.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.withColumn("t", text).withColumn("w", _words(F.col("t")))
    d = d.withColumn("n_words", F.size("w").cast("long")).withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    h = F.col("h")
    win = F.when(F.col("n_words") >= 5, F.transform(F.sequence(F.lit(0), F.size(h) - 5), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(5)]))).otherwise(F.array().cast("array<bigint>"))
    d = d.withColumn("win", win).drop("h", "w")
    pairs = F.sort_array(F.transform("win", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    d = d.withColumn("s", F.when(F.size(F.array_distinct("win")) < F.size("win"), pairs).otherwise(F.array().cast("array<struct<x:bigint,i:int>>"))).drop("win")
    s = F.col("s")
    again = F.filter(s, lambda e, i: (e.x == F.get(s, i - 1).x) | (e.x == F.get(s, i + 1).x))
    d = d.withColumn("pos", F.sort_array(F.transform(again, lambda e: e.i))).drop("s")
    pos = F.col("pos")
    gaps = F.transform(pos, lambda p, i: F.coalesce(F.least(F.get(pos, i + 1) - p, F.lit(5)), F.lit(5)))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumn("n_repeat_words", F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)).drop("pos").withColumn("raw_lines", lines)
    d = d.withColumn("word_chars", F.length(F.translate("t", " \t\n\x0b\x0c\r", "")).cast("long"))
    d = d.withColumn("n_symbols", (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long"))
    d = d.withColumn("n_dup_lines", (F.size("raw_lines") - F.size(F.array_distinct("raw_lines"))).cast("long"))
    return d.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).drop("raw_lines", "t")


def normal_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), SPACE, " "))


def line_structs(docs: DataFrame) -> DataFrame:
    """``docs(text, source, ...)`` with host, text_hash, the distinct normalised lines as (hash, words), and the words in them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    norm = F.filter(F.transform(F.split(text, "\n"), normal_line), lambda x: x != "")
    each = F.transform(norm, lambda x: F.struct(F.xxhash64(x).alias("line"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).cast("long").alias("words")))
    return docs.withColumns({"host": F.coalesce(F.col("source"), F.lit("")), "text_hash": F.xxhash64(text), "lines": F.array_distinct(each)})


def boilerplate(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(host, line) in more than ``min_docs`` documents of the host; ``lines(host, text_hash, lines)``, a row per document."""
    distinct = lines.groupBy("host", "text_hash").agg(F.first("lines").alias("lines"))
    return distinct.select("host", F.explode("lines.line").alias("line")).groupBy("host", "line").agg(F.count("*").alias("docs")).where(F.col("docs") > min_docs).select("host", "line")


def few(table: DataFrame) -> bool:
    return table.limit(FEW + 1).count() <= FEW


def flawed(lines: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, str]:
    """(host, text_hash, bad): texts with boilerplate lines and the hashes and words of these; a table in the shared folder, and its path."""
    spark = lines.sparkSession
    found, path = stash(boilerplate(lines, min_docs), "quality-boilerplate")
    each = lines.select("host", "text_hash", F.explode("lines").alias("l")).select("host", "text_hash", F.col("l.line").alias("line"), F.col("l.words").alias("words"))
    bad = each.join(F.broadcast(found) if few(found) else found, ["host", "line"]).groupBy("host", "text_hash").agg(F.collect_set(F.struct("line", "words")).alias("bad"))
    bad, bad_path = stash(bad, "quality-flawed")
    discard(spark, path)
    return bad, bad_path


def with_flaws(rows: DataFrame, bad: DataFrame, texts: DataFrame) -> DataFrame:
    """``rows(host, text_hash, ...)`` with ``bad`` of their text, null where there is none.

    ``texts(host, text_hash)``, a stored table with a row per document, tells which texts are shared by more than
    a thousandth of all rows; these are fewer than a thousand, and their rows are spread over ``SALT`` keys.
    """
    keys = ["host", "text_hash"]
    if few(bad):
        return rows.join(F.broadcast(bad), keys, "left")
    total = texts.count()
    hot = texts.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") * 1000 > total).select(*keys, F.lit(True).alias("hot"))
    marked = lambda d: d.join(F.broadcast(hot), keys, "left")
    spread = marked(rows).withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALT))).otherwise(0).cast("int")).drop("hot")
    copied = marked(bad).withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(F.lit(0))))).drop("hot")
    return spread.join(copied, [*keys, "salt"], "left").drop("salt")


def touched(rows: DataFrame, bad: DataFrame) -> DataFrame:
    """``rows(text_hash, ...)`` with ``touched``: false only where the text is not in ``bad``, true for few others.

    A hash is one bit of a broadcast table of at most ``MARKS`` words, whatever the size of ``bad``.
    """
    bit = F.pmod(F.col("text_hash"), F.lit(64 * MARKS))
    word, mark = F.shiftright(bit, 6).alias("_word"), F.expr("shiftleft(1L, CAST(pmod(text_hash, 64) AS INT))")
    marks = bad.select(word, mark.alias("_mark")).groupBy("_word").agg(F.bit_or("_mark").alias("_marks"))
    found = rows.withColumn("_word", word).join(F.broadcast(marks), "_word", "left")
    return found.withColumn("touched", F.coalesce(F.col("_marks").bitwiseAND(mark) != 0, F.lit(False))).drop("_word", "_marks")


def _sum_words(lines: Column) -> Column:
    return F.coalesce(F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + x.words), F.lit(0).cast("long"))


def depleted(line_words: Column, removed: Column, kept_percent: int) -> Column:
    return 100 * (line_words - removed) < kept_percent * line_words


def assess(docs: DataFrame, min_docs: int = MIN_DOCS, kept_percent: int = KEPT_PERCENT) -> DataFrame:
    """doc_id with the base counts, the words in its distinct lines, those removed, and the verdict."""
    rows, _ = stash(base_metrics(line_structs(docs.select("doc_id", "text", "source"))).drop("text", "source"), "quality-rows")
    bad, _ = flawed(rows.select("host", "text_hash", "lines"), min_docs)
    out = with_flaws(rows.withColumn("line_words", _sum_words(F.col("lines"))).drop("lines"), bad, rows).withColumn("removed_words", _sum_words(F.col("bad")))
    kept = ~F.col("base_failed") & ~depleted(F.col("line_words"), F.col("removed_words"), kept_percent)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_words", "removed_words", "base_failed", kept.alias("kept"))


def accepted(docs: DataFrame, min_docs: int = MIN_DOCS, kept_percent: int = KEPT_PERCENT) -> DataFrame:
    """The kept documents with their boilerplate lines taken out of ``text``; all other columns as they are.

    Base rules are a filter on the scan, and texts stay where they are read; where flawed texts are many, these alone travel.
    """
    plain, name = renamed(docs)
    text, source = F.col(name["text"]), F.col(name["source"])
    lines, _ = stash(line_structs(plain.select(text.alias("text"), source.alias("source"))).select("host", "text_hash", "lines"), "quality-lines")
    bad, _ = flawed(lines, min_docs)
    words = lines.join(F.broadcast(bad.select("host", "text_hash")) if few(bad) else bad.select("host", "text_hash"), ["host", "text_hash"], "left_semi")
    words = words.groupBy("host", "text_hash").agg(F.first(_sum_words(F.col("lines"))).alias("line_words"))
    removed = _sum_words(F.col("bad"))
    verdicts, _ = stash(bad.join(words, ["host", "text_hash"]).select("host", "text_hash", depleted(F.col("line_words"), removed, kept_percent).alias("depleted"), F.col("bad.line").alias("bad")), "quality-verdicts")
    host, text_hash = F.coalesce(source, F.lit("")).alias("host"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash")
    rows = plain.select(F.struct(*plain.columns).alias("_row"), text.alias("text"), host, text_hash)

    def passed(some: DataFrame) -> DataFrame:
        # Behind a generator: a filter on the projections themselves would be pushed into them, and their arrays computed again for every element.
        return base_metrics(some).select("_row", "host", "text_hash", F.explode(F.array("base_failed")).alias("_failed")).where(~F.col("_failed")).drop("_failed")

    if few(verdicts):
        found = with_flaws(passed(rows), verdicts, lines)
    else:  # rows of texts without a flaw stay where they are read
        split = touched(rows, verdicts)
        flawed_rows = with_flaws(passed(split.where("touched").drop("touched")), verdicts, lines)
        none = {c: F.lit(None).cast(verdicts.schema[c].dataType) for c in ("depleted", "bad")}
        found = passed(split.where("NOT touched").drop("touched")).withColumns(none).unionByName(flawed_rows)
    found = found.where(~F.coalesce(F.col("depleted"), F.lit(False)))
    whole = F.coalesce(F.col(f"_row.{name['text']}"), F.lit(""))
    bad_lines = F.col("bad")
    left = F.array_join(F.filter(F.split(whole, "\n"), lambda x: ~F.array_contains(bad_lines, F.xxhash64(normal_line(x)))), "\n")
    cleaned = F.when(bad_lines.isNull(), whole).otherwise(left)
    return found.select(*[cleaned.alias(c) if c == name["text"] else F.col(f"_row.{c}").alias(c) for c in plain.columns]).toDF(*docs.columns)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(table(spark, sf_dir, "documents"))


OP9_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS host FROM documents),
w AS (SELECT doc_id, t, host, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 5),
keyed AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS k FROM win),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM keyed) WHERE n > 1),
cov AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM rep) GROUP BY doc_id),
raw AS (SELECT doc_id, host, t, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
norm AS (SELECT DISTINCT doc_id, host, t, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS line FROM raw),
lw AS (SELECT doc_id, host, t, line, length(line) - length(replace(line, ' ', '')) + 1 AS words FROM norm WHERE line <> ''),
freq AS (SELECT host, line, count(DISTINCT t) AS docs FROM lw GROUP BY host, line),
boil AS (SELECT host, line FROM freq WHERE docs > {MIN_DOCS}),
lines AS (SELECT lw.doc_id, sum(words) AS line_words, sum(CASE WHEN b.line IS NOT NULL THEN words ELSE 0 END) AS removed_words
  FROM lw LEFT JOIN boil b ON lw.host = b.host AND lw.line = b.line GROUP BY lw.doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(coalesce(line_words, 0) AS BIGINT) AS line_words, CAST(coalesce(removed_words, 0) AS BIGINT) AS removed_words
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN lines USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND 100 * (line_words - removed_words) >= {KEPT_PERCENT} * line_words AS kept FROM b
"""
