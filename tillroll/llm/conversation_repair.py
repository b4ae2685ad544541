"""Conversation structure repair by Hirschberg's divide and conquer.

A conversation should read ``(system? (user assistant)+)?``. Every row gets one
edit: Keep (0), Rerole to user or assistant (3), Delete (4; the only choice for
blank and duplicate rows); Insert (3) puts an empty user or assistant row
anywhere. A truncated row that is not deleted costs 3 more. The cheapest edits
are taken, and of these the ones whose initials read least in ASCII order.

How a conversation is judged is in four states (nothing yet, after system,
after user, after assistant), so a row is a 4 x 4 table of cheapest steps. A
conversation is cut in the middle: a forward vector (cost and rank of the
least audit for each state) of the first half meets a backward vector (cost) of
the second, the cheapest crossing with the least rank is chosen, and both
halves are solved the same way. No table of rows x states is kept.

On Spark: rows with equal values are counted first, so copies are one row. The
rows are ordered by a range partitioning on (conversation, turn, role, text
digest), which splits a conversation of any length, and are cut into blocks
of consecutive rows. A block gives the four-state tables of its first and last
conversation only; conversations that span blocks are solved once over these
tables (one row a block), and then all blocks are solved on their own.

Defined results: a null role or text is one space, a null turn comes first, a
null conv_id is one conversation; rows of one turn are ordered by role, then by
the SHA-256 of their text; texts with one SHA-256 are equal. A role's initial is
its first character; an empty role has none and cannot be kept. Rows that are
equal in all four columns count as often as they occur. Other columns are not
used. An empty table gives empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import group_starts, grouped, materialise

BLANK = r" \t\n\x0B\f\r"
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 3, 4, 3, 3
FAR = 1 << 40
#: States: nothing yet, after system, after user, after assistant.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ROLE_AFTER = {1: "system", 2: "user", 3: "assistant"}
STEPS = ["D", "ID", "IID", "IIK", "IIR", "IK", "IR", "K", "R"]  # ASCII order
INITIALS = "sua"
GONE = 8  # the class of rows that must be deleted
TAIL = np.array([0, 2 * INSERT, INSERT, 0], np.int64)


@dataclass(frozen=True)
class Params:
    block_bits: int = 16  # at most 2 ** block_bits consecutive rows a block


def _filled(state: int) -> int:
    """The state after the only user or assistant row that may come next."""
    return NEXT.get((state, "u")) or NEXT[state, "a"]


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Cost and step code of the cheapest way from state to state, by row class.

    Two inserts before a row are enough: a third returns to the state after one.
    """
    cost, code = np.full((GONE + 1, 4, 4), FAR, np.int64), np.zeros((GONE + 1, 4, 4), np.int64)
    for c in range(GONE + 1):
        initial, extra = "sua-"[c % 4], UNFINISHED * (c // 4 == 1)
        for p in range(4):
            q = p
            for k in range(3):
                ways = {"D": (q, DELETE)}
                if c != GONE:
                    ways["R"] = (_filled(q), REROLE + extra)
                    if (q, initial) in NEXT:
                        ways["K"] = (NEXT[q, initial], KEEP + extra)
                for op, (s, price) in ways.items():
                    new = (price + k * INSERT, STEPS.index("I" * k + op))
                    if new < (cost[c, p, s], code[c, p, s]):
                        cost[c, p, s], code[c, p, s] = new
                q = _filled(q)
    return cost, code


COST, CODE = _tables()


def _advance(cost: np.ndarray, rank: np.ndarray, t: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward vectors after one more item (row or block), least audit first."""
    key = (((cost[:, :, None] + t) << 6) + rank[:, :, None] * 16 + o).min(axis=1)
    order = key & 63
    return np.minimum(key >> 6, FAR), (order[:, :, None] > order[:, None, :]).sum(axis=2)


def _forward(t, o, lo, hi, cost, rank):
    for i in range(int((hi - lo).max(initial=0))):
        on = np.flatnonzero(lo + i < hi)
        at = lo[on] + i
        cost[on], rank[on] = _advance(cost[on], rank[on], t[at], o[at])
    return cost, rank


def _backward(t, lo, hi, cost):
    for i in range(1, int((hi - lo).max(initial=0)) + 1):
        on = np.flatnonzero(hi - i >= lo)
        cost[on] = np.minimum((t[hi[on] - i] + cost[on][:, None, :]).min(axis=2), FAR)
    return cost


def _only(states: np.ndarray) -> np.ndarray:
    out = np.full((len(states), 4), FAR, np.int64)
    out[np.arange(len(states)), states] = 0
    return out


def solve(t: np.ndarray, o: np.ndarray, lo, hi, start, end) -> np.ndarray:
    """The state after each item of the segments [lo, hi).

    ``start`` is each segment's first state, ``end`` the cost of its last one.
    """
    state = np.zeros(len(t), np.int64)
    while len(lo):
        one = hi - lo == 1
        at, s = lo[one], start[one]
        state[at] = (((t[at, s] + end[one]) << 4) + o[at, s]).argmin(axis=1)
        lo, hi, start, end = lo[~one], hi[~one], start[~one], end[~one]
        mid = (lo + hi) // 2
        cost, rank = _forward(t, o, lo, mid, _only(start), np.tile(np.arange(4), (len(lo), 1)))
        meet = (((cost + _backward(t, mid, hi, end.copy())) << 2) + rank).argmin(axis=1)
        lo, hi = np.concatenate([lo, mid]), np.concatenate([mid, hi])
        start, end = np.concatenate([start, meet]), np.concatenate([_only(meet), end])
    return state


# ---------------------------------------------------------------- rows


def _initial(role: Column) -> Column:
    return F.substring(role, 1, 1)


def _rows(conversations: DataFrame, label: str) -> DataFrame:
    """Distinct rows with their number of copies, conversation key and faults."""
    plain = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")
    )
    rows = plain.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    rows = rows.select(
        F.monotonically_increasing_id().alias("rid"),
        F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string"))).alias("ckey"),
        "*",
        F.unhex(F.sha2("text", 256)).alias("digest"),
        (~F.col("text").rlike(f"[^{BLANK}]")).alias("blank"),
        (~F.btrim("text", F.lit(" \t\n\x0b\f\r")).rlike(r"[.!?]\z")).alias("unfinished"),
    )
    return materialise(rows, f"{label}-rows")


def _faulty(rows: DataFrame, label: str) -> DataFrame:
    """Rows without texts, and how many of their copies are duplicates.

    The first of the rows with one conversation, role and text is the one with
    the least turn (null first); all others and its own copies are duplicates.
    """
    light = rows.drop("text")
    turns = light.where("NOT blank").groupBy("ckey", "role", "digest").agg(F.count("*").alias("n"), F.max(F.col("turn").isNull()).alias("unset"), F.min("turn").alias("least"))
    again = turns.where("n > 1").drop("n")
    out = light.join(again, ["ckey", "role", "digest"], "left")
    first = F.col("unset").isNull() | F.when(F.col("unset"), F.col("turn").isNull()).otherwise(F.col("turn") == F.col("least"))
    repeated = F.when(F.col("blank"), F.lit(0)).when(first, F.col("copies") - 1).otherwise(F.col("copies"))
    return materialise(out.withColumn("duplicates", repeated.cast("long")).drop("unset", "least"), f"{label}-faulty")


def _items(faulty: DataFrame, p: Params, label: str) -> DataFrame:
    """One item a row to judge and one a run of copies to delete, in order.

    The numbers are those of the written, range-partitioned order, so they stay
    when a task runs again.
    """
    place = sum(F.when(_initial(F.col("role")) == x, i).otherwise(0) for i, x in enumerate(INITIALS))
    known = _initial(F.col("role")).isin(*INITIALS)
    initial = F.when(known, place).otherwise(3)
    own = F.when(F.col("blank"), F.lit(0)).otherwise(F.col("copies") - F.col("duplicates"))
    judged = F.struct(F.lit(False).alias("rest"), (initial + F.when(F.col("unfinished"), 4).otherwise(0)).cast("int").alias("cls"), F.lit(1).cast("long").alias("m"))
    rest = F.struct(F.lit(True).alias("rest"), F.lit(GONE).alias("cls"), (F.col("copies") - own).alias("m"))
    parts = F.filter(F.array(F.when(own > 0, judged), F.when(F.col("copies") > own, rest)), lambda x: x.isNotNull())
    order = ["ckey", "turn", "role", "digest", "rest"]
    items = faulty.select("rid", "ckey", "turn", "role", "digest", initial.cast("int").alias("initial"), F.inline(parts))
    items = items.repartitionByRange(*order).sortWithinPartitions(*order)
    number = F.monotonically_increasing_id()
    items = items.select("rid", "ckey", "initial", "rest", "cls", "m", number.alias("id"))
    return materialise(items, f"{label}-items").withColumn("block", F.shiftright("id", p.block_bits))


def _tables_of(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    cls = frame["cls"].to_numpy()
    t = COST[cls] + (frame["m"].to_numpy(np.int64) - 1)[:, None, None] * DELETE
    return np.minimum(t, FAR), CODE[cls]


_EDGE = "ckey string, block long, cost array<long>, rank array<long>, first int, last int"


def _edges(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The four-state tables of the first and the last conversation of each block."""
    for frame in grouped(frames, ["block"]):
        for _, block in frame.groupby("block", sort=False):
            block = block.reset_index(drop=True)
            starts = group_starts(block, ["ckey"])
            ends = np.append(starts[1:], len(block))
            some = sorted({0, len(starts) - 1})
            t, o = _tables_of(block)
            lo, hi = np.repeat(starts[some], 4), np.repeat(ends[some], 4)
            cost, rank = _forward(t, o, lo, hi, _only(np.tile(np.arange(4), len(some))), np.tile(np.arange(4), (len(lo), 1)))
            yield pd.DataFrame({
                "ckey": block["ckey"].to_numpy()[starts[some]], "block": block["block"].iloc[0],
                "cost": list(cost.reshape(-1, 16)), "rank": list(rank.reshape(-1, 16)),
                "first": block["initial"].to_numpy()[starts[some]], "last": block["initial"].to_numpy()[ends[some] - 1],
            })


_CHAIN = "ckey string, block long, enter int, leave int, before int"


def _chain(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The states in which conversations over several blocks enter and leave each."""
    for frame in grouped(frames, ["ckey"]):
        if not len(frame):
            continue
        lo = group_starts(frame, ["ckey"])
        hi = np.append(lo[1:], len(frame))
        t = np.stack(frame["cost"].to_numpy()).reshape(-1, 4, 4).astype(np.int64)
        o = np.stack(frame["rank"].to_numpy()).reshape(-1, 4, 4).astype(np.int64)
        state = solve(t, o, lo, hi, np.zeros(len(lo), np.int64), np.tile(TAIL, (len(lo), 1)))
        enter, before = np.append(0, state[:-1]), np.append(-1, frame["last"].to_numpy()[:-1])
        leave = state.copy()
        enter[lo], before[lo], leave[hi - 1] = 0, -1, -1
        yield pd.DataFrame({"ckey": frame["ckey"], "block": frame["block"], "enter": enter, "leave": leave, "before": before})


_EDIT = "rid long, id long, ckey string, copies long, edits string, inserted array<string>, new_role string, appended array<string>, cost long, illegal long"


def _legal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether initials b may follow initials a (su, ua, au)."""
    return ((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1))


def _inserted(state: int, n: int) -> tuple[list[str], int]:
    out = []
    for _ in range(n):
        state = _filled(state)
        out.append(ROLE_AFTER[state])
    return out, state


def _edit(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edits of every item of whole blocks."""
    for frame in grouped(frames, ["block"]):
        if not len(frame):
            continue
        lo = group_starts(frame, ["block", "ckey"])
        hi = np.append(lo[1:], len(frame))
        t, o = _tables_of(frame)
        spans = frame["enter"].notna().to_numpy()[lo]
        start = np.where(spans, frame["enter"].fillna(0).to_numpy()[lo], 0).astype(np.int64)
        leave = np.where(spans, frame["leave"].fillna(-1).to_numpy()[lo], -1).astype(np.int64)
        end = np.where((leave < 0)[:, None], TAIL, _only(np.maximum(leave, 0)))
        state = solve(t, o, lo, hi, start, end)
        came = np.append(0, state[:-1])
        came[lo] = start
        row = np.arange(len(frame))
        code, cost = o[row, came, state], t[row, came, state]

        initial, m = frame["initial"].to_numpy(), frame["m"].to_numpy(np.int64)
        before = np.append(-1, initial[:-1])
        before[lo] = np.where(spans, frame["before"].fillna(-1).to_numpy()[lo], -1)
        illegal = m - 1 + ((before >= 0) & ~_legal(before, initial))

        done = np.zeros(len(frame), bool)
        done[hi[leave < 0] - 1] = True
        inserted, roles, appended = [], [], []
        for p, s, c, last in zip(came.tolist(), state.tolist(), code.tolist(), done.tolist()):
            step = STEPS[c]
            inserted.append(_inserted(p, len(step) - 1)[0])
            roles.append(None if step[-1] == "D" else "" if step[-1] == "K" else ROLE_AFTER[s])
            appended.append(_inserted(s, int(TAIL[s]) // INSERT)[0] if last else [])
        yield pd.DataFrame({
            "rid": frame["rid"], "id": frame["id"], "ckey": frame["ckey"], "copies": m, "edits": [STEPS[c] for c in code], "inserted": inserted,
            "new_role": roles, "appended": appended, "cost": cost + np.where(done, TAIL[state], 0), "illegal": illegal,
        })


@dataclass(frozen=True)
class Repair:
    """``rows``: distinct rows; ``faulty``: their faults; ``edits``: what is done with them.

    ``edits`` has one row for each row and one for each run of copies to delete:
    ``id`` (order over all conversations), ``copies``, ``edits`` (the initials;
    of a run, those of its last copy, and D for the others), ``inserted`` (roles
    before it), ``new_role`` (null: deleted, empty: kept) and ``appended``
    (roles after a conversation's last row).
    """

    rows: DataFrame
    faulty: DataFrame
    edits: DataFrame


def repair(conversations: DataFrame, p: Params = Params(), label: str = "repair") -> Repair:
    """The cheapest, audit-least edits of every conversation."""
    rows = _rows(conversations, label)
    faulty = _faulty(rows, label)
    items = _items(faulty, p, label)
    by_block = lambda df: df.repartition("block").sortWithinPartitions("id")
    edges = materialise(by_block(items.select("block", "id", "ckey", "cls", "m", "initial")).mapInPandas(_edges, _EDGE), f"{label}-edges")
    spanning = edges.groupBy("ckey").agg(F.count("*").alias("n")).where("n > 1").select("ckey")
    chain = edges.join(spanning, "ckey").repartition("ckey").sortWithinPartitions("ckey", "block").mapInPandas(_chain, _CHAIN)
    chain = materialise(chain, f"{label}-chain")
    edits = by_block(items.join(chain, ["ckey", "block"], "left")).mapInPandas(_edit, _EDIT)
    return Repair(rows, faulty, materialise(edits, f"{label}-edits"))


def _with_texts(done: Repair) -> DataFrame:
    texts = done.rows.select("rid", "conv_id", "turn", "role", "text")
    kept = done.edits.where("new_role IS NOT NULL").select("rid", "id")
    texts = kept.join(texts, "rid").select("id", "conv_id", "turn", "role", "text")
    return done.edits.drop("rid").join(texts, "id", "left")


def repaired_rows(done: Repair) -> DataFrame:
    """(conv_id, id, part, turn, role, text): the repaired conversations.

    Rows are in the order of (id, part); inserted rows have no turn and no text.
    """
    keys = done.rows.select("ckey", "conv_id").distinct()
    rows = _with_texts(done).drop("conv_id").join(keys, "ckey")
    empty = lambda names: F.transform(names, lambda x: F.struct(F.lit(None).cast("long").alias("turn"), x.alias("role"), F.lit("").alias("text")))
    role = F.when(F.col("new_role") == "", F.col("role")).otherwise(F.col("new_role"))
    own = F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), F.col("text"))
    own = F.when(F.col("new_role").isNotNull(), F.array(own)).otherwise(F.array().cast("array<struct<turn:long,role:string,text:string>>"))
    return rows.select("conv_id", "id", F.posexplode(F.concat(empty(F.col("inserted")), own, empty(F.col("appended")))).alias("part", "row")).select("conv_id", "id", "part", "row.*")


_DIGEST = "ckey string, cost long, illegal long, audit string, repaired_sha256 string"


def _digests(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Audit and hash of each conversation; its rows stream by in order."""
    key, audit, sha, n, cost, illegal = None, [], hashlib.sha256(), 0, 0, 0

    def line(role: str, text: str) -> None:
        nonlocal n
        sha.update((("\n" if n else "") + role + ":" + text).encode())
        n += 1

    for frame in frames:
        out = []
        for r in frame.itertuples(index=False):
            if r.ckey != key:
                if key is not None:
                    out.append((key, cost, illegal, "".join(audit), sha.hexdigest()))
                key, audit, sha, n, cost, illegal = r.ckey, [], hashlib.sha256(), 0, 0, 0
            audit.append("D" * (r.copies - 1) + r.edits + "I" * len(r.appended))
            cost, illegal = cost + r.cost, illegal + r.illegal
            for role in r.inserted:
                line(role, "")
            if r.new_role is not None:
                line(r.new_role or r.role, r.text)
            for role in r.appended:
                line(role, "")
        yield pd.DataFrame(out, columns=["ckey", "cost", "illegal", "audit", "repaired_sha256"])
    if key is not None:
        yield pd.DataFrame([(key, cost, illegal, "".join(audit), sha.hexdigest())], columns=["ckey", "cost", "illegal", "audit", "repaired_sha256"])


def report(conversations: DataFrame, damaged: DataFrame, p: Params = Params(), label: str = "repair") -> DataFrame:
    """One row for every conv_id of ``conversations``: faults and repair of ``damaged``.

    A hash of a whole conversation is sequential, so its rows stream through one
    task here (nothing but its audit is held); the repair itself is not.
    """
    done = repair(damaged, p, label)
    stream = _with_texts(done).select("ckey", "id", "copies", "edits", "inserted", "new_role", "appended", "cost", "illegal", "role", "text")
    digests = stream.repartition("ckey").sortWithinPartitions("ckey", "id").mapInPandas(_digests, _DIGEST)
    faults = done.faulty.groupBy("ckey").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"),
        F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
        F.sum("duplicates").alias("duplicate"),
        F.sum(F.when(~F.col("blank") & F.col("unfinished"), F.col("copies") - F.col("duplicates")).otherwise(0)).alias("truncated"),
    )
    every = conversations.select("conv_id").distinct()
    every = every.withColumn("ckey", F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string"))))
    out = every.join(faults, "ckey", "left").join(digests, "ckey", "left")
    numbers = [F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def damage(conversations: DataFrame) -> DataFrame:
    """Conversations with planted faults, chosen by the CRC-32 of ``conv_id:turn``."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.pmod(F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", "turn", one("role").alias("role"), one("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.withColumn("text", text).withColumn("role", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat("fault", F.when(F.col("fault") == 3, 2).otherwise(1))).alias("fault")).drop("fault")


#: Damage, faults and the cheapest, audit-least edits for DuckDB.
ORACLE = r"""
WITH RECURSIVE crcs AS (
    SELECT list(v ORDER BY i) AS t FROM (
        SELECT i, list_reduce(range(8), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) AS v FROM range(256) r(i)
    )
), keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '') AS k
    FROM conversations
), hashed AS (
    SELECT conv_id, turn, role, text, xor(list_reduce(list_transform(k, lambda x: ascii(x)::BIGINT),
        lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295::BIGINT), 4294967295::BIGINT) % 20 AS f
    FROM keyed, crcs
), damaged AS (
    SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN f = 1 THEN '' WHEN f = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM hashed, range(2) c(copy) WHERE f <> 0 AND (copy = 0 OR f = 3)
), placed AS (
    SELECT coalesce(conv_id::VARCHAR, 'none') AS c, turn, role, text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM damaged
), judged AS (
    SELECT *, left(role, 1) AS initial,
        CASE WHEN NOT regexp_matches(text, '[^ \t\n\x0B\f\r]') THEN 'blank'
            WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate'
            WHEN NOT regexp_matches(text, '[.!?][ \t\n\x0B\f\r]*\z') THEN 'truncated' END AS fault,
        lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) || left(role, 1) AS pair
    FROM placed
), nxt(p, r, s) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
states(p) AS (VALUES (0), (1), (2), (3)),
fill AS (SELECT p, s, CASE r WHEN 'u' THEN 'user:' ELSE 'assistant:' END AS line FROM nxt WHERE r <> 's'),
fills AS (
    SELECT p, p AS s, '' AS edits, []::VARCHAR[] AS lines FROM states
    UNION ALL SELECT p, s, 'I', [line] FROM fill
    UNION ALL SELECT a.p, b.s, 'II', [a.line, b.line] FROM fill a JOIN fill b ON b.p = a.s
), moves AS (
    SELECT f.p, f.s, f.edits || 'D' AS edits, f.lines, 4 + 3 * len(f.edits) AS price, 'D' AS op, '' AS r FROM fills f
    UNION ALL SELECT f.p, n.s, f.edits || 'K', f.lines, 3 * len(f.edits), 'K', n.r FROM fills f JOIN nxt n ON n.p = f.s
    UNION ALL SELECT f.p, n.s, f.edits || 'R', f.lines, 3 + 3 * len(f.edits), 'R', n.r FROM fills f JOIN nxt n ON n.p = f.s WHERE n.r <> 's'
), reach AS (
    SELECT DISTINCT c, 0::BIGINT AS i, 0 AS s, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS lines FROM placed
    UNION ALL
    SELECT * FROM (
        SELECT r.c, j.i, m.s, r.cost + m.price + CASE WHEN j.fault = 'truncated' AND m.op <> 'D' THEN 3 ELSE 0 END AS cost, r.audit || m.edits AS audit,
            r.lines || m.lines || CASE m.op WHEN 'D' THEN [] WHEN 'K' THEN [j.role || ':' || j.text]
                ELSE [CASE m.r WHEN 'u' THEN 'user:' ELSE 'assistant:' END || j.text] END AS lines
        FROM reach r JOIN judged j ON j.c = r.c AND j.i = r.i + 1 JOIN moves m ON m.p = r.s
            AND (m.op = 'D' OR coalesce(j.fault, '') NOT IN ('blank', 'duplicate') AND (m.op = 'R' OR m.r = j.initial))
    ) QUALIFY row_number() OVER (PARTITION BY c, s ORDER BY cost, audit) = 1
), ended AS (
    SELECT * FROM (
        SELECT r.c, r.cost + 3 * len(f.edits) AS cost, r.audit || f.edits AS audit, r.lines || f.lines AS lines
        FROM reach r JOIN (SELECT c, max(i) AS i FROM placed GROUP BY c) USING (c, i) JOIN fills f ON f.p = r.s AND f.s IN (0, 3)
    ) QUALIFY row_number() OVER (PARTITION BY c ORDER BY cost, audit) = 1
), counts AS (
    SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
        count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
        count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM judged GROUP BY c
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, 'none') AS c FROM conversations) o LEFT JOIN counts USING (c) LEFT JOIN ended USING (c)
"""
