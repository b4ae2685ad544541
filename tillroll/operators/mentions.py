"""Dictionary phrases in texts, by joins on words.

``phrase_mentions`` finds every occurrence of every phrase of a table at word
edges. The phrase table is never shipped whole: texts are cut into words, each
word meets the lengths of the phrases that begin with it (one row a first
word), and only then the words of such a length meet the phrase itself, by
equality. So a frequent first word meets lengths, not phrases, and both joins
are plain ones that Spark can broadcast, sort or split.

A word is a run of letters, digits and ``_`` of any script. Signs at a phrase's
ends ('u.k.') belong to it and are compared with the text around its words.

Defined results: case counts (callers lower both sides); a null text has no
mentions; a phrase without any word character is never found; occurrences may
overlap, also those of one phrase; offsets are 0-based code points, end
exclusive; keys must name rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

_W = r"[\p{L}\p{N}_]"
_NOT = r"[^\p{L}\p{N}_]"
#: Words of the text before a mention that are returned with it.
CONTEXT_WORDS = 3


def _dictionary(phrases: DataFrame, phrase: str) -> DataFrame:
    """Phrases as words: lead sign, core, trailing sign, first word, number of words."""
    p = F.col("phrase")
    lead, trail = F.regexp_extract(p, rf"^({_NOT}*)", 1), F.regexp_extract(p, rf"({_NOT}*)\z", 1)
    core = F.substring(p, F.char_length(lead) + 1, F.char_length(p) - F.char_length(lead) - F.char_length(trail))
    rows = phrases.select(F.col(phrase).alias("phrase")).distinct().where(p.rlike(_W))
    rows = rows.select("phrase", lead.alias("lead"), trail.alias("trail"), core.alias("core"))
    return rows.select("*", F.regexp_extract("core", rf"^({_W}+)", 1).alias("head"), F.size(F.regexp_extract_all("core", F.lit(f"{_W}+"), 0)).alias("size"))


def _joined(words: Column, gaps: Column, size: Column) -> Column:
    """The first ``size`` words with what stands between them."""
    return F.array_join(F.transform(F.slice(words, 1, size), lambda w, i: F.when(i == 0, w).otherwise(F.concat(F.get(gaps, i - 1), w))), "")


def phrase_mentions(texts: DataFrame, key: str, text: str, phrases: DataFrame, phrase: str) -> DataFrame:
    """(key, phrase, start, end, before): ``before`` is the text of the last
    words before the mention, up to it."""
    listed = _dictionary(phrases, phrase)
    # One number: how many words the longest phrase has.
    longest = listed.agg(F.max("size")).first()[0] or 1
    sizes = listed.groupBy("head").agg(F.collect_set("size").alias("sizes"))

    cut = texts.select(
        F.col(key).alias("key"),
        F.regexp_extract_all(F.col(text), F.lit(f"{_W}+"), 0).alias("words"),
        F.split(F.col(text), f"{_W}+", -1).alias("gaps"),
    )
    cut = cut.withColumn("starts", tx._starts(F.col("gaps"), F.col("words")))

    def at(word: Column, i: Column) -> Column:
        first = F.greatest(i - CONTEXT_WORDS, F.lit(0))
        return F.struct(
            F.get("starts", i).alias("start"), word.alias("head"), i.alias("i"), (F.size("words") - i).alias("left"), F.get("gaps", i).alias("gap"),
            F.slice("words", i + 1, F.lit(longest)).alias("words"), F.slice("gaps", i + 2, F.lit(longest)).alias("gaps"),
            F.slice("words", first + 1, i - first).alias("pre_words"), F.slice("gaps", first + 2, i - first).alias("pre_gaps"),
        )

    heads = cut.select("key", F.explode(F.transform("words", at)).alias("w")).select("key", "w.*").join(sizes, "head")
    runs = heads.withColumn("size", F.explode("sizes")).where("size <= left")
    runs = runs.withColumn("core", _joined(F.col("words"), F.col("gaps"), F.col("size"))).withColumn("after", F.get("gaps", F.col("size") - 1))
    found = runs.join(listed.drop("head", "size"), "core")
    led = (F.col("lead") == "") | (F.endswith("gap", "lead") & ((F.col("i") == 0) | (F.char_length("gap") > F.char_length("lead"))))
    trailed = (F.col("trail") == "") | (F.startswith("after", "trail") & ((F.col("left") == F.col("size")) | (F.char_length("after") > F.char_length("trail"))))
    start = F.col("start") - F.char_length("lead")
    context = F.array_join(F.transform("pre_words", lambda w, i: F.concat(w, F.get("pre_gaps", i))), "")
    before = F.when(F.col("i") == 0, F.col("gap")).otherwise(context)
    before = F.substring(before, F.lit(1), F.char_length(before) - F.char_length("lead"))
    return found.where(led & trailed).select(
        F.col("key").alias(key), "phrase", start.alias("start"),
        (F.col("start") + F.char_length("core") + F.char_length("trail")).alias("end"), before.alias("before"),
    )


# ---- countries -----------------------------------------------------------------------------

_LIST_LINK = rf"({tx.SPACE}*(?:,|and|or){tx.SPACE}*)\z"


def country_mentions(texts: DataFrame, key: str, text: str, countries: DataFrame, name: str) -> DataFrame:
    """Countries each text names: those that an exclusion phrase ('outside',
    'other than the', ...) stands before, possibly through a list of countries,
    and the others. A country may be in both lists.

    Mentions of a text are put in order; one that follows another through a
    comma, 'and' or 'or' shares the state of the first of its list. A name
    inside a longer one takes the longer one's state if they begin together.
    """
    names = countries.select(F.col(name).cast("string").alias("country")).where("country IS NOT NULL").distinct()
    names = names.withColumn("phrase", F.lower("country"))
    for alias, country in tx.COUNTRY_ALIASES.items():
        names = names.unionByName(names.where(F.col("phrase") == country.lower()).select("country", F.lit(alias).alias("phrase")))
    low = texts.select(key, F.lower(F.col(text)).alias("__low"))
    found = phrase_mentions(low, key, "__low", names, "phrase")

    excluding = F.col("before").rlike(tx.jvm_pattern("(?:" + tx.EXCLUSION_PREFIX + r")\z"))
    link = F.regexp_extract("before", _LIST_LINK, 1)
    found = found.select("*", excluding.alias("direct"), F.when(link != "", F.col("start") - F.char_length(link)).alias("follows"))

    by_place = Window.partitionBy(key).orderBy("start", F.desc("end"), "phrase")
    earlier = by_place.rowsBetween(Window.unboundedPreceding, -1)
    so_far = by_place.rowsBetween(Window.unboundedPreceding, 0)
    spans = found.withColumn("outer", ~F.coalesce(F.max("end").over(earlier) >= F.col("end"), F.lit(False)))
    last_end = F.last(F.when(F.col("outer"), F.col("end")), ignorenulls=True).over(earlier)
    heads = F.col("outer") & ~F.coalesce(last_end == F.col("follows"), F.lit(False))
    spans = spans.withColumn("list", F.sum(heads.cast("int")).over(so_far))
    in_list = Window.partitionBy(key, "list").orderBy("start", F.desc("end"), "phrase").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    state = F.when(F.col("outer"), F.first(F.when(F.col("outer"), F.col("direct")), ignorenulls=True).over(in_list))
    spans = spans.withColumn("state", state)
    same_start = F.max("state").over(Window.partitionBy(key, "start"))
    spans = spans.withColumn("excluded", F.coalesce("state", same_start, "direct"))

    named = spans.join(names, "phrase")
    lists = named.groupBy(key).agg(
        F.sort_array(F.collect_set(F.when(~F.col("excluded"), F.col("country")))).alias("included"),
        F.sort_array(F.collect_set(F.when(F.col("excluded"), F.col("country")))).alias("excluded"),
    )
    return lists.select(key, "included", "excluded")
