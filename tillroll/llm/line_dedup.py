"""Line dedup by content-defined line chunks (DataFrame functions only).

A text is split at newlines. A rolling hash over the hashes of a line and the
line before it ends a chunk where it is 0 modulo ``divisor``; lines of at least
``long_words`` words are chunks of their own. Boundaries depend on nearby lines
only, so a passage that moves keeps its inner boundaries. A chunk of two or
more lines, or one long line, that occurs again anywhere in the corpus is
removed from every place but the first (smallest doc_id, then text hash, then
position). Hashes only nominate chunks: the copies are grouped and joined on
the chunk's own bytes.

Chunks cross one shuffle, to meet the repeated hashes; the few that do are
written once. Copies of a chunk are combined before they are grouped, and the
joins on (hash, chunk) are plain joins that Spark can split.

``remove_repeated_passages`` (the pipeline's stage) also takes every two
neighbouring lines with words, and the blank lines between them, as a run. A
repeated passage of two or more lines holds its own runs wherever it stands, so
it goes whole, whatever surrounds it. Runs are equal by SHA-256 of their bytes.
A line leaves a place only if the same line stands at an earlier place of its
run, so the first copy of every line stays. Neighbouring lines that would go
are one passage, and it goes only from ``passage_words`` words on: closing
braces, short answers and refrains that many texts share stay.
``remove_repeated_chunks`` keeps the rule of ``ORACLE``.

Defined results: a null text stays null with 0 lines; an empty text has one
empty line; rows with equal doc_id and text are one document (equal results);
a text of which all lines go becomes empty (the row stays); other columns are
kept as they are, also those named like the result's (the result's win).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise


@dataclass(frozen=True)
class Params:
    divisor: int = 2  # expected lines between hash boundaries
    long_words: int = 40  # a line from this many words is a chunk alone
    passage_words: int = 30  # a repeated passage with fewer words stays (remove_repeated_passages)


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("bigint")


def _lines(docs: DataFrame, p: Params) -> DataFrame:
    """Per document: lines, and 1-based numbers of the lines that end a chunk."""
    text = docs.where("text IS NOT NULL").select(F.col("doc_id").alias("d"), F.md5("text").alias("t"), F.split("text", "\n", -1).alias("lines"))
    marks = F.transform("lines", lambda x: F.struct(_line_hash(x).alias("h"), (F.size(F.split(F.trim(x), " +")) >= p.long_words).alias("long")))
    rows = text.withColumn("marks", marks)

    def ends(i: Column) -> Column:
        mine = F.element_at("marks", i)
        before = F.when(i > 1, F.element_at("marks", F.greatest(i - 1, F.lit(1)))["h"]).otherwise(F.lit(0))
        after = F.when(i < F.size("marks"), F.element_at("marks", F.least(i + 1, F.size("marks")))["long"]).otherwise(F.lit(True))
        rolled = (mine["h"] * 31 + before * 17) % 1000003 % p.divisor == 0
        return mine["long"] | after | rolled

    return rows.withColumn("ends", F.filter(F.sequence(F.lit(1), F.size("marks")), ends))


def _spans(p: Params) -> Column:
    """(first, last) of the chunks that may be removed."""
    spans = F.transform(
        "ends",
        lambda e, k: F.struct(F.when(k == 0, F.lit(1)).otherwise(F.element_at("ends", F.greatest(k, F.lit(1))) + 1).alias("first"), e.alias("last")),
    )
    return F.filter(spans, lambda s: (s["last"] > s["first"]) | F.element_at("marks", s["first"])["long"])


def _chunks(rows: DataFrame, p: Params) -> DataFrame:
    """(d, t, first, last, chunk): chunks that may be removed."""
    cut = rows.select("d", "t", "lines", F.explode(_spans(p)).alias("s"))
    chunk = F.array_join(F.slice("lines", F.col("s.first"), F.col("s.last") - F.col("s.first") + 1), "\n")
    return cut.select("d", "t", F.col("s.first").alias("first"), F.col("s.last").alias("last"), chunk.alias("chunk"))


def remove_repeated_chunks(docs: DataFrame, p: Params = Params(), label: str = "lines") -> DataFrame:
    """``docs`` with text cleaned, plus n_lines, lines_removed and chunks_removed."""
    chunks = _chunks(_lines(docs, p), p).withColumn("h", F.xxhash64("chunk"))
    place = F.struct("d", "t", "first")
    # Equal rows are one document, so a chunk counts once for each place.
    repeated = chunks.groupBy("h").agg(F.min(place).alias("x"), F.max(place).alias("y")).where("x <> y").select("h")
    copies = materialise(chunks.join(repeated, "h"), label)
    keeper = copies.groupBy("h", "chunk").agg(F.min(place).alias("keep"))
    gone = copies.join(keeper, ["h", "chunk"]).where(place != F.col("keep"))
    cuts = gone.groupBy("d", "t").agg(F.collect_set(F.struct("first", "last")).alias("__found"))

    base = docs.drop("n_lines", "lines_removed", "chunks_removed").withColumn("__t", F.md5("text"))
    out = base.join(cuts.withColumnsRenamed({"d": "__d", "t": "__k"}), F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__t") == F.col("__k")), "left")
    cuts_of = F.coalesce("__found", F.expr("array()").cast("array<struct<first:int,last:int>>"))
    lines = F.split("text", "\n", -1)
    out = out.withColumn("__cuts", F.sort_array(cuts_of))
    # Chunks of a text do not overlap, so what is kept are the slices between them.
    bounds = F.transform("__cuts", lambda c, k: F.struct(F.when(k > 0, F.element_at("__cuts", F.greatest(k, F.lit(1)))["last"]).otherwise(0).alias("after"), c["first"].alias("before")))
    bounds = F.concat(bounds, F.array(F.struct(F.element_at("__cuts", -1)["last"].alias("after"), (F.size(lines) + 1).alias("before"))))
    kept = F.flatten(F.transform(bounds, lambda b: F.slice(lines, b["after"] + 1, b["before"] - b["after"] - 1)))
    out = out.withColumn("chunks_removed", F.size("__cuts").cast("bigint"))
    out = out.withColumn("lines_removed", F.aggregate("__cuts", F.lit(0).cast("bigint"), lambda s, c: s + c["last"] - c["first"] + 1))
    out = out.withColumn("n_lines", F.coalesce(F.size(lines), F.lit(0)).cast("bigint"))
    out = out.withColumn("n_lines", F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.col("n_lines")).cast("bigint"))
    out = out.withColumn("text", F.when(F.size("__cuts") == 0, F.col("text")).otherwise(F.array_join(kept, "\n")))
    return out.drop("__t", "__d", "__k", "__cuts", "__found")


_BLANK = " \t\r\x0b\f"


def _word_counts(lines: Column) -> Column:
    """Words of each line; 0 for blank lines."""
    return F.transform(lines, lambda x: F.size(F.filter(F.split(x, f"[{_BLANK}]+"), lambda w: w != "")))


def _runs(rows: DataFrame, p: Params) -> DataFrame:
    """(d, t, n, first, words, run): chunks, and lines with words up to the next such line."""
    chunks = _spans(p)
    worded = F.filter(F.transform("lines", lambda x, i: F.when(F.btrim(x, F.lit(_BLANK)) != "", i + 1)), lambda i: i.isNotNull())
    rows = rows.select("d", "t", "lines", chunks.alias("chunks"), worded.alias("worded"))
    pairs = F.zip_with("worded", F.slice("worded", 2, F.greatest(F.size("worded"), F.lit(1))), lambda a, b: F.struct(a.alias("first"), b.alias("last")))
    spans = F.array_distinct(F.concat("chunks", F.filter(pairs, lambda s: s["last"].isNotNull())))
    cut = rows.select("d", "t", "lines", F.explode(spans).alias("s"))
    lines = F.slice("lines", F.col("s.first"), F.col("s.last") - F.col("s.first") + 1)
    run = F.array_join(lines, "\n")
    return cut.select("d", F.xxhash64("t").alias("t"), F.size("lines").alias("n"), F.col("s.first").alias("first"), _word_counts(lines).alias("words"), F.unhex(F.sha2(run, 256)).alias("run"))


def remove_repeated_passages(docs: DataFrame, p: Params = Params(), label: str = "passages") -> DataFrame:
    """``docs`` with text cleaned of all passages of repeated runs."""
    runs = _runs(_lines(docs, p), p).withColumn("h", F.xxhash64("run"))
    place = F.struct("d", "t", "first")
    repeated = runs.groupBy("h").agg(F.min(place).alias("x"), F.max(place).alias("y")).where("x <> y").select("h")
    copies = materialise(runs.join(repeated, "h"), label)
    keeper = copies.groupBy("run").agg(F.min(place).alias("keep"))
    gone = copies.join(keeper, "run").where(place != F.col("keep"))
    gone = gone.select("d", "t", "n", "first", F.posexplode("words").alias("k", "words")).groupBy("d", "t", (F.col("first") + F.col("k")).alias("i")).agg(F.max("n").alias("n"), F.max("words").alias("words"))
    # Neighbouring lines are a passage (one text's lines at most in a window).
    in_text = Window.partitionBy("d", "t").orderBy("i")
    gone = gone.withColumn("passage", F.col("i") - F.row_number().over(in_text))
    gone = gone.withColumn("words", F.sum("words").over(Window.partitionBy("d", "t", "passage"))).where(F.col("words") >= p.passage_words)
    gone = gone.groupBy("d", "t").agg(F.max("n").alias("n"), F.collect_set("i").alias("gone"))
    # A mark for each line, in order, so that a text is cut in linear time.
    stays = F.array_except(F.sequence(F.lit(1), F.col("n")), "gone")
    mark = lambda lines, kept: F.transform(lines, lambda i: F.struct(i.alias("i"), F.lit(kept).alias("kept")))
    marks = F.transform(F.sort_array(F.concat(mark(stays, True), mark(F.col("gone"), False))), lambda x: x["kept"])
    marks = gone.select(F.col("d").alias("__d"), F.col("t").alias("__k"), marks.alias("__marks"))

    base = docs.withColumn("__t", F.xxhash64(F.md5("text")))
    out = base.join(marks, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__t") == F.col("__k")), "left")
    kept = F.filter(F.zip_with(F.split("text", "\n", -1), "__marks", lambda x, k: F.when(k, x)), lambda x: x.isNotNull())
    out = out.withColumn("text", F.when(F.col("__marks").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
    return out.drop("__t", "__d", "__k", "__marks")


#: The same rule for DuckDB (params as above).
ORACLE = r"""
WITH base AS (
    SELECT doc_id, text, md5(text) AS t, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL
), l AS (
    SELECT doc_id, t, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i, len(lines) AS n FROM base
), m AS (
    SELECT *, ('0x' || substr(md5(line), 1, 7))::BIGINT AS h, len(regexp_split_to_array(trim(line, ' '), ' +')) >= 40 AS long FROM l
), e AS (
    SELECT *, long OR coalesce(lead(long) OVER w, true)
        OR (h * 31 + coalesce(lag(h) OVER w, 0) * 17) % 1000003 % 2 = 0 AS is_end
    FROM m WINDOW w AS (PARTITION BY doc_id, t ORDER BY i)
), c AS (
    SELECT *, coalesce(sum(is_end::INT) OVER (PARTITION BY doc_id, t ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM e
), chunks AS (
    SELECT doc_id, t, k, min(i) AS first, max(i) AS last, bool_or(long) AS long, string_agg(line, chr(10) ORDER BY i) AS chunk
    FROM c GROUP BY doc_id, t, k
), able AS (
    SELECT * FROM chunks WHERE last > first OR long
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, t, first) AS r FROM able
), gone AS (
    SELECT doc_id, t, first, last FROM ranked WHERE r > 1
), kept AS (
    SELECT c.doc_id, c.t, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE g.first IS NULL) AS text, count(*) FILTER (WHERE g.first IS NOT NULL) AS lines_removed
    FROM c LEFT JOIN gone g ON g.doc_id = c.doc_id AND g.t = c.t AND c.i BETWEEN g.first AND g.last GROUP BY c.doc_id, c.t
), cuts AS (
    SELECT doc_id, t, count(*) AS n FROM gone GROUP BY doc_id, t
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
    CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines,
    coalesce(kept.lines_removed, 0) AS lines_removed, coalesce(cuts.n, 0) AS chunks_removed
FROM documents d LEFT JOIN kept ON kept.doc_id = d.doc_id AND kept.t = md5(d.text) LEFT JOIN cuts ON cuts.doc_id = d.doc_id AND cuts.t = md5(d.text)
"""
