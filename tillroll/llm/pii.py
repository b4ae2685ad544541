"""PII by bootstrapped contextual extraction.

*Base spans* are e-mail addresses, IPv4 addresses, card numbers (Luhn) and
phone numbers by fixed patterns. They are the seeds of a bootstrap: words that
hold a digit or an @ are *instances*, and so is the longest run of neighbouring
number words of one line (digits, with brackets, blanks, dots and hyphens
between) that is shaped like a card or a phone, and those first and last words
of a run that are shaped so. The words around an instance are its *lexical
patterns* (two words before; one before and one after; two after). An instance
inside another counts neither for nor against a pattern.
Spark scores the graph of patterns and instances in rounds until a round accepts
nothing new and no confidence rises by more than ``settled``:

    pattern  = sum of its occurrences' confidence / (occurrences + ``doubt``),
               0 under ``support`` distinct confident instances;
    instance = 1 for a seed of the kind, else 1 - product(1 - pattern) over its
               distinct patterns, for instances shaped like the kind.

Unseen instances that end at ``accept`` or more add spans of their kind; base
spans stay, and an added span never overlaps one, nor lies in another added
span. Occurrences are combined to (pattern, instance) counts before any shuffle
by pattern, so a pattern around a third of the corpus is a few rows a task.

Defined results: a null or empty text has no spans; rows are independent (equal
rows have equal results); other columns are ignored by ``find`` and kept by
``redact`` (except a clashing n_chars, which is the new text's length).
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from itertools import count, islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

# The base patterns and kinds that the contract states.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


@dataclass(frozen=True)
class Params:
    settled: float = 0.01  # rounds end when no confidence rises by more and nothing new is accepted
    support: int = 3  # distinct confident instances that a pattern needs
    doubt: float = 1.0
    accept: float = 0.8


def _emails(text: str):
    """Leftmost non-overlapping matches of LOCAL+@DOMAIN, in linear time: the
    characters before each @ are walked back to the last match or @ at most."""
    end = at = text.find("@")
    done = 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        done = end = found.end() if found else at + 1
        at = text.find("@", end)


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start and then kind."""
    if not text:
        return []
    out = [(s, e, "email") for s, e in _emails(text)]
    out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def written(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


# ---------------------------------------------------------------- contexts

_WORD = re.compile(r"\S+")
_TOUCH = re.compile(r"[0-9@]")
_EDGE = ".,;:!?()[]{}<>\"'|"


def shape_fits(value: str, kind: str) -> bool:
    """Whether an unseen instance looks like an identifier of the kind."""
    digits = sum(c.isdigit() for c in value)
    if kind == "email":
        return "@" in value[1:-1]
    if kind == "ip":
        return value.count(".") == 3 and digits >= 4 and digits + 3 == len(value)
    if kind == "card":
        return 11 <= digits <= 20 and digits + value.count("-") + sum(c.isspace() for c in value) == len(value)
    return 7 <= digits <= 15 and not any(c.isalpha() for c in value)


def _plain(word: str) -> str:
    plain = re.sub("[0-9]", "0", word.strip(_EDGE).lower())
    return plain if len(plain) <= 200 else hashlib.md5(plain.encode("utf-8", "surrogatepass")).hexdigest()


def _words_before(text: str, s: int) -> list[str]:
    """The last two whole words before ``s``, however long they or the blanks are."""
    reach = 200
    while True:
        words = _WORD.findall(text[max(0, s - reach) : s])
        # The first word of a window may be a part, so a third shows that two are whole.
        if len(words) > 2 or reach >= s:
            return words[-2:]
        reach *= 4


# Number words of one line, with blanks or lone signs between; each is a whole word.
_NUMBER = r"[+(.-]*+[0-9][0-9().+/-]*+(?=[,;:!?\]}>\"'|]*+(?:\s|$))"
_RUN = re.compile(rf"(?<![^\s\"'\[{{<|]){_NUMBER}(?:[^\S\r\n]++(?:[().-]++[^\S\r\n]++)*+{_NUMBER})+")


def _trimmed(text: str, s: int, e: int) -> tuple[int, int]:
    """The place without signs at its ends; a bracket whose other half is inside stays."""
    while s < e and text[s] in _EDGE + "-":
        s += 1
    while e > s and text[e - 1] in _EDGE + "-":
        e -= 1
    opened, closed = text.count("(", s, e), text.count(")", s, e)
    if closed > opened and s > 0 and text[s - 1] == "(":
        s -= 1
    elif opened > closed and text[e : e + 1] == ")":
        e += 1
    return s, e


def _numeric(value: str) -> bool:
    return shape_fits(value, "card") or shape_fits(value, "phone")


def _runs(text: str, spans) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Runs shaped like a card or a phone, and first and last words of runs shaped so."""
    whole, ends = [], []
    parts, at = [], 0
    for s, e, _ in spans:
        if e > at:
            parts += [text[at:s], "x" * (e - max(s, at))]
            at = e
    masked = "".join(parts) + text[at:]
    for m in _RUN.finditer(masked):
        s, e = _trimmed(text, m.start(), m.end())
        if _numeric(text[s:e]):
            whole.append((s, e))
        # At most 20 digits, so at most 20 number words, from either end.
        words = [w.span() for w in re.finditer(r"\S*[0-9]\S*", text[s:e])]
        if len(words) > 1:
            some = {_trimmed(text, s, s + b) for _, b in words[1:20]} | {_trimmed(text, s + a, e) for a, _ in words[-20:-1]}
            ends += sorted(x for x in some if _numeric(text[x[0] : x[1]]))
    return whole, ends


def occurrences(text: str, spans) -> list[tuple[int, int, str, str | None, list[str], int]]:
    """(start, end, value, seed kind, patterns, count) of base spans, of other
    words that hold a digit or an @, and of runs of number words; an instance
    inside another has the count 0."""
    places = [(s, e, k, 1) for s, e, k in spans]
    taken = sorted((s, e) for s, e, _ in spans)
    whole, ends = _runs(text, spans)
    places += [(s, e, None, 1) for s, e in whole] + [(s, e, None, 0) for s, e in ends]
    inside = 0
    last = -1
    for m in _TOUCH.finditer(text):
        if m.start() <= last:
            continue
        s = e = m.start()
        while s > 0 and not text[s - 1].isspace():
            s -= 1
        while e < len(text) and not text[e].isspace():
            e += 1
        last = e - 1
        while s < e and text[s] in _EDGE:
            s += 1
        while e > s and text[e - 1] in _EDGE:
            e -= 1
        if e - s >= 4 and not any(a < e and s < b for a, b in taken):
            while inside < len(whole) and whole[inside][1] <= s:
                inside += 1
            nested = inside < len(whole) and whole[inside][0] < e
            places.append((s, e, None, 0 if nested else 1))
    out = []
    for s, e, k, n in places:
        before = [_plain(w) for w in _words_before(text, s)]
        after = [_plain(w[0]) for w in islice(_WORD.finditer(text, e), 2)]
        patterns = []
        if len(before) == 2:
            patterns.append("l " + " ".join(before))
        if before and after:
            patterns.append(f"m {before[-1]} {after[0]}")
        if len(after) == 2:
            patterns.append("r " + " ".join(after))
        out.append((s, e, text[s:e].lower(), k, patterns, n))
    return out


def _scan(docs: DataFrame) -> DataFrame:
    def run(frames):
        for frame in frames:
            out = []
            for doc, text in zip(frame["doc_id"], frame["text"]):
                spans = base_spans(text)
                found = occurrences(text, spans) if text else []
                out.append((
                    doc,
                    hashlib.md5((text or "").encode()).hexdigest(),
                    [{"start": s, "end": e, "kind": k} for s, e, k in spans],
                    [{"start": s, "end": e, "value": v, "kind": k, "patterns": p, "n": n} for s, e, v, k, p, n in found],
                ))
            made = pd.DataFrame(out, columns=["doc_id", "text_key", "base", "found"])
            made["doc_id"] = made["doc_id"].astype("Int64")
            yield made

    span = "start: long, `end`: long, kind: string"
    shape = f"doc_id long, text_key string, base array<struct<{span}>>, found array<struct<start: long, `end`: long, value: string, kind: string, patterns: array<string>, n: int>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, shape)


def _discover(scan: DataFrame, p: Params, label: str) -> DataFrame:
    """(value, kind): unseen instances that the bootstrap accepts."""
    each = scan.select(F.explode("found").alias("x")).select("x.value", "x.kind", "x.n", F.explode("x.patterns").alias("pattern"))
    graph = materialise(each.groupBy("pattern", "value", "kind").agg(F.sum("n").alias("n")), f"{label}-graph")
    fits = F.udf(lambda v: [k for k in KINDS if shape_fits(v, k)], "array<string>")
    unseen = graph.where("kind IS NULL").select("value").distinct().withColumn("as_kind", F.explode(fits("value")))
    seeds = graph.where("kind IS NOT NULL").select("value", F.col("kind").alias("as_kind"), F.lit(1.0).alias("c")).distinct()
    # A value that is a seed of a kind somewhere is one everywhere.
    unseen = materialise(unseen.join(seeds, ["value", "as_kind"], "left_anti"), f"{label}-unseen")
    edges = graph.groupBy("pattern", "value").agg(F.sum("n").alias("n"))
    size = edges.groupBy("pattern").agg(F.sum("n").alias("all"))
    known, accepted = seeds, 0
    # Confidences only rise from round to round, so the rounds settle.
    for k in count():
        votes = edges.where("n > 0").join(known, "value").groupBy("pattern", "as_kind").agg(F.sum(F.col("n") * F.col("c")).alias("good"), F.sum((F.col("c") >= p.accept).cast("int")).alias("seen"))
        trust = votes.where(F.col("seen") >= p.support).join(size, "pattern").select("pattern", "as_kind", (F.col("good") / (F.col("all") + p.doubt)).alias("trust"))
        reached = edges.join(unseen, "value").join(trust, ["pattern", "as_kind"]).groupBy("value", "as_kind")
        c = reached.agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("trust"), F.lit(1e-6)))))).alias("c"))
        last = known.select("value", "as_kind", F.col("c").alias("last"))
        c = seeds.unionByName(c).join(last, ["value", "as_kind"], "left")
        known = materialise(c.select("value", "as_kind", "c", (F.col("c") - F.coalesce("last", F.lit(0.0))).alias("rise")), f"{label}-round{k}")
        now = known.agg(F.max("rise").alias("rise"), F.sum((F.col("c") >= p.accept).cast("long")).alias("n")).first()
        known = known.drop("rise")
        if not now["n"] or (now["n"] == accepted and now["rise"] <= p.settled):
            break
        accepted = now["n"]
    return known.join(unseen, ["value", "as_kind"], "left_semi").where(F.col("c") >= p.accept).select("value", F.col("as_kind").alias("kind"))


def _outer(spans):
    """Spans that lie in no other one of them."""
    out, reach = [], -1
    for x in sorted(spans, key=lambda x: (x["start"], -x["end"])):
        if x["end"] > reach:
            out.append((x["start"], x["end"], x["kind"]))
            reach = x["end"]
    return out


def find(docs: DataFrame, p: Params = Params(), label: str = "pii") -> DataFrame:
    """(doc_id, text_key, base, spans): sorted arrays of (start, end, kind), a row for each row."""
    scan = materialise(_scan(docs), f"{label}-scan")
    outer = F.udf(_outer, "array<struct<start: long, `end`: long, kind: string>>")
    # One kind a value: the first in the listed order.
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    added = _discover(scan, p, label).groupBy("value").agg(F.min_by("kind", order).alias("as_kind"))
    new = scan.select("doc_id", "text_key", F.explode("found").alias("x")).where("x.kind IS NULL")
    new = new.select("doc_id", "text_key", F.col("x.start").alias("start"), F.col("x.end").alias("end"), F.col("x.value").alias("value")).join(added, "value")
    new = new.groupBy("doc_id", "text_key").agg(outer(F.collect_set(F.struct("start", "end", F.col("as_kind").alias("kind")))).alias("new"))
    new = new.withColumnsRenamed({"doc_id": "__d", "text_key": "__k"})
    rows = scan.select("doc_id", "text_key", "base").join(new, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("text_key") == F.col("__k")), "left")
    both = F.concat("base", F.coalesce("new", F.expr("array()").cast("array<struct<start:bigint,end:bigint,kind:string>>")))
    rank = lambda x: F.array_position(F.array(*[F.lit(k) for k in KINDS]), x["kind"])
    ranked = F.transform(both, lambda x: F.struct(x["start"].alias("start"), rank(x).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))
    return rows.select("doc_id", "text_key", "base", F.transform(F.array_sort(ranked), lambda x: F.struct(x["start"], x["end"], x["kind"])).alias("spans"))


def _joined(spans: str):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _of_kind(spans: str, kind: str):
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def report(docs: DataFrame, p: Params = Params(), label: str = "pii") -> DataFrame:
    """Counts and digest of the base spans, and all spans, of each document."""
    found = find(docs, p, label)
    counts = [_of_kind("base", k).alias(f"n_{k}") for k in KINDS]
    added = (F.size("spans") - F.size("base")).cast("long").alias("n_added")
    return found.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"), added)


def redact(docs: DataFrame, p: Params = Params(), label: str = "pii") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets."""
    found = find(docs, p, label).where(F.size("spans") > 0).dropDuplicates(["doc_id", "text_key"])
    found = found.select(F.col("doc_id").alias("__d"), F.col("text_key").alias("__k"), F.col("spans").alias("__spans"))

    @F.pandas_udf("string")
    def replaced(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, where in zip(texts, spans):
            if text is None or where is None or not len(where):
                out.append(text)
                continue
            parts, at = [], 0
            for x in where:
                if x["end"] <= at:
                    continue
                if x["start"] >= at:
                    parts += [text[at : x["start"]], f"<{x['kind']}>"]
                at = x["end"]
            out.append("".join(parts) + text[at:])
        return pd.Series(out, dtype="object")

    key = F.md5(F.coalesce("text", F.lit("")))
    rows = docs.withColumn("__key", key).join(found, F.col("doc_id").cast("long").eqNullSafe(F.col("__d")) & (F.col("__key") == F.col("__k")), "left")
    text = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(replaced("text", "__spans"))
    rows = rows.withColumn("text", text).drop("__key", "__d", "__k", "__spans")
    return rows.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else rows
