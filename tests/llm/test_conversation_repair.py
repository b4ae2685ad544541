"""Conversation repair against a plain search over all edits."""

import hashlib
import random

import numpy as np
import pytest

from tillroll.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string, ckey string, id int, audit string"
WHITE = " \t\n\x0b\f\r"


def brute(rows):
    """The best of all edit sequences, as (cost, audit, lines), by states."""
    rows = [(t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(WHITE)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    names = {"u": "user", "a": "assistant"}

    def spread(ways):
        """Adds up to four inserted rows to every way."""
        for _ in range(4):
            for state, (cost, audit, lines) in list(ways.items()):
                for x in "ua":
                    if (state, x) in after:
                        new = (cost + 3, audit + "I", lines + [names[x] + ":"])
                        if x not in ways or new[:2] < ways[x][:2]:
                            ways[x] = new
        return ways

    ways = {"": (0, "", [])}
    for (_, role, text), fault in zip(rows, faults):
        new = {}

        def add(state, way):
            if state not in new or way[:2] < new[state][:2]:
                new[state] = way

        extra = 3 if fault == "truncated" else 0
        # Inserts are tried from every state on its own, so that no way hides another.
        for start, way in ways.items():
            for state, (cost, audit, lines) in spread({start: way}).items():
                add(state, (cost + 4, audit + "D", lines))
                if fault in ("blank", "duplicate"):
                    continue
                if role[:1] and (state, role[:1]) in after:
                    add(after[state, role[:1]], (cost + extra, audit + "K", lines + [role + ":" + text]))
                for x in "ua":
                    if (state, x) in after:
                        add(x, (cost + 3 + extra, audit + "R", lines + [names[x] + ":" + text]))
        ways = new
    cost, audit, lines = min(w for s, w in spread(ways).items() if s in ("", "a"))
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + "|" + b[1][:1] for a, b in zip(rows, rows[1:])]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(p not in ("s|u", "u|a", "a|u") for p in pairs),
        "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def conversations():
    draw = random.Random(5)
    roles = ["user"] * 4 + ["assistant"] * 4 + ["system", "tool", "", "umpire", None]
    texts = ["Hi.", "Yes!", "No?", "open", "more \n", "", "  ", None, "Fine. ", "é?", "\x0b", "a.", "b.", "c.", "d.", "e.", "f."]
    out = {}
    for c in [None, *range(60)]:
        n = draw.randint(1, 14)
        out[c] = [(draw.choice([None, *range(9)]) if c % 3 else i, draw.choice(roles), draw.choice(texts)) for i in range(n)] if c is not None else [(1, "user", "Hi."), (2, "assistant", "Yes!")]
    out[60] = [(i // 2, ["user", "assistant", "assistant", "system"][i % 4], f"text {i}" + ".?x"[i % 3]) for i in range(150)]
    out[61] = [(3, "user", "Same.")] * 40 + [(4, "user", "")] * 5 + [(5, "assistant", "Done.")]
    out[62] = [(None, None, None)]
    return out


@pytest.mark.parametrize("bits", [1, 3, 16])
def test_matches_plain_search(spark, bits):
    data = conversations()
    rows = [(c, *r, "x", 1, "y") for c, rs in data.items() for r in rs]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    more = df.unionByName(spark.createDataFrame([(99, 0, "user", "Gone.", None, None, None)], SCHEMA))
    got = {r.conv_id: r.asDict() for r in cr.report(more, df, cr.Params(block_bits=bits), "test").collect()}
    assert set(got) == set(data) | {99}
    for c, rs in data.items():
        assert {k: v for k, v in got[c].items() if k != "conv_id"} == brute(rs), c
    nothing = hashlib.sha256(b"").hexdigest()
    assert got[99] == {"conv_id": 99, **dict.fromkeys(["gaps", "blank", "duplicate", "truncated", "illegal", "cost"], 0), "audit": "", "repaired_sha256": nothing}


def test_repaired_rows_are_the_hashed_ones(spark):
    data = conversations()
    df = spark.createDataFrame([(c, *r, "x", 1, "y") for c, rs in data.items() for r in rs], SCHEMA)
    rows = cr.repaired_rows(cr.repair(df, cr.Params(block_bits=4), "test")).collect()
    lines = {}
    for r in sorted(rows, key=lambda r: (r.id, r.part)):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for c, rs in data.items():
        assert hashlib.sha256("\n".join(lines.get(c, [])).encode()).hexdigest() == brute(rs)["repaired_sha256"], c


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert cr.report(df, cr.damage(df), label="test").count() == 0
    assert cr.repaired_rows(cr.repair(df, label="test")).count() == 0
    one = spark.createDataFrame([(1, 0, "user", "Hi.", None, None, None)], SCHEMA)
    assert [r.audit for r in cr.report(one, df, label="test").collect()] == [""]


def test_damage_follows_the_key(spark):
    import zlib

    rows = [(c, t, "assistant", "One. Two! Three?") for c in [None, *range(30)] for t in [None, 0, 1]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted((r.conv_id or -1, r.turn or -1, r.role, r.text) for r in cr.damage(df).collect())
    want = []
    for c, t, role, text in rows:
        f = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if f:
            text = "" if f == 1 else "One Two Three" if f == 2 else text
            want += [(c or -1, t or -1, "user" if f == 4 else role, text)] * (2 if f == 3 else 1)
    assert got == sorted(want)


def test_crossing_is_the_audit_least(spark):
    """Hirschberg's halves give the same steps as one pass from the left."""
    draw = np.random.default_rng(2)
    for _ in range(200):
        cls = draw.integers(0, cr.GONE + 1, draw.integers(1, 20))
        t, o = cr.COST[cls], cr.CODE[cls]
        state = cr.solve(t, o, np.array([0]), np.array([len(cls)]), np.array([0]), cr.TAIL[None, :])
        best = {0: (0, "")}
        for c in cls:
            new = {}
            for p, (cost, audit) in best.items():
                for s in range(4):
                    if cr.COST[c, p, s] < cr.FAR:
                        way = (cost + int(cr.COST[c, p, s]), audit + cr.STEPS[cr.CODE[c, p, s]])
                        new[s] = min(new.get(s, way), way)
            best = new
        cost, audit = min((c + int(cr.TAIL[s]), a + "I" * (int(cr.TAIL[s]) // 3)) for s, (c, a) in best.items())
        came = np.append(0, state[:-1])
        steps = "".join(cr.STEPS[o[i, p, s]] for i, (p, s) in enumerate(zip(came, state)))
        assert (int(sum(t[i, p, s] for i, (p, s) in enumerate(zip(came, state))) + cr.TAIL[state[-1]]), steps + "I" * (int(cr.TAIL[state[-1]]) // 3)) == (cost, audit)
