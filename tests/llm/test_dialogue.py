"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from spanloom.llm import dialogue

CONV = "conv_id long, turn long, role string, text string"
INK = re.compile(r"[^\x20\x09-\x0D]")


def plain(rows):
    """The digest of one conversation from right to left; two inserts in a row at most."""
    rows = sorted(((t is not None, t), r if r is not None else " ", x if x is not None else " ") for t, r, x in rows)
    seen, faults = set(), []
    for _, role, text in rows:
        ink = INK.findall(text)
        fault = "blank" if not ink else "duplicate" if (role, text) in seen else "" if ink[-1] in ".!?" else "truncated"
        faults.append(fault)
        seen.add((role, text))
    step = {"": "su", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}
    force = lambda q: "a" if q == "u" else "u"

    def closed(best):
        for _ in range(3):
            for q in step:
                c, a, lines = best[force(q)]
                best[q] = min(best[q], (c + 2, "I" + a, [f"{name[force(q)]}:"] + lines))
        return best

    none = (10**9, "", [])
    best = closed({"": (0, "", []), "s": none, "u": none, "a": (0, "", [])})
    for (_, role, text), fault in reversed(list(zip(rows, faults))):
        new = {}
        for q in step:
            c, a, lines = best[q]
            options = [(c + 3, "D" + a, lines)]
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                c, a, lines = best[force(q)]
                options.append((c + 2 + extra, "R" + a, [f"{name[force(q)]}:{text}"] + lines))
                if role and role[0] in step[q]:
                    c, a, lines = best[role[0]]
                    options.append((c + extra, "K" + a, [f"{role}:{text}"] + lines))
            new[q] = min(options)
        best = closed(new)
    cost, audit, lines = best[""]
    numbers = [t for (_, t), _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def conversation(rng, n):
    texts = ["Yes.", "no", " \n", "", "Why?", "é!", "x. y", None, "Ok. ", "so \t"]
    roles = ["system", "user", "user", "assistant", "assistant", "tool", "", None, "umpire"]
    number = lambda i: rng.choice([i, i, i, 2 * i, None])
    return [(number(i), rng.choice(roles), rng.choice(texts + [f"t{i}.", f"u{i}"])) for i in range(n)]


def digest(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_one_conversation_at_a_time():
    rng = random.Random(8)
    for _ in range(400):
        rows = conversation(rng, rng.choice([0, 1, 2, 3, 5, 9, 20]))
        order = sorted(((t is not None, t), r if r is not None else " ", x if x is not None else " ") for t, r, x in rows)
        seen, turns = set(), []
        for _, role, text in order:
            turns += dialogue.turns_of(role, text, 1, (role, text) in seen)
            seen.add((role, text))
        tally = dialogue.Tally()
        tally.add([t for (_, t), _, _ in order], turns, dialogue._ACCEPT, True)
        got = tally.row()
        keys = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
        assert tuple(got[k] for k in keys) == plain(rows)


def test_segments_and_partitions(spark):
    """A conversation may be cut anywhere: by a segment's border or a partition's."""
    rng = random.Random(9)
    cases = {c: conversation(rng, rng.choice([1, 2, 4, 7, 30])) for c in [*range(40), None]}
    cases[17] = conversation(rng, 400)
    cases[18] = [(3, "user", "Same.")] * 200 + [(None, "assistant", "Same.")]
    rows = [(c, *r) for c, turns in cases.items() for r in turns]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, CONV).repartition(5).withColumns({c: F.lit(3) for c in ("conv", "copies", "seen", "part", "seq")})
    expected = {c: plain(turns) for c, turns in cases.items()}
    for segment in (1, 3, dialogue.SEGMENT):
        assert digest(dialogue.repair(df, segment=segment)) == expected
    lines = {}
    for r in sorted(dialogue.repaired_turns(df, segment=3).collect(), key=lambda r: (r.part, r.seq, r.pos)):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for c, e in expected.items():
        assert hashlib.sha256("\n".join(lines.get(c, [])).encode()).hexdigest() == e[-1]


def test_edges(spark):
    empty = hashlib.sha256(b"").hexdigest()
    rows = [(1, 0, "user", "A."), (1, 1, "assistant", "B."), (2, 5, "user", "x" * 300_000), (3, 0, None, None), (None, None, None, None)]
    df = spark.createDataFrame(rows, CONV)
    out = digest(dialogue.repair(df))
    assert out[1][:-1] == (0, 0, 0, 0, 0, 0, "KK")
    assert out[2][:-1] == (0, 0, 0, 1, 0, 3, "D") or out[2][5] == 3
    assert out[3] == (0, 1, 0, 0, 0, 3, "D", empty) == out[None]
    dropped = dialogue.repair(df.withColumn("n", F.lit(0)), copies="n")
    assert digest(dropped) == {c: (0, 0, 0, 0, 0, 0, "", empty) for c in (1, 2, 3, None)}
    assert dialogue.repair(df.limit(0)).count() == 0
