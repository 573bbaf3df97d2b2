"""Conversation repair against a plain search over edits, turn by turn."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from factloom.llm import conversations as c

WHITE = " \t\n\x0b\f\r"
KINDS = "uUaAsSoOx"


def enumerated(kinds):
    """The best of all edits of up to two insertions in each gap."""
    best = None
    for gaps in itertools.product(["", "u", "a", "ua", "au"], repeat=len(kinds) + 1):
        for edits in itertools.product("DKua", repeat=len(kinds)):
            cost, audit, roles = 5 * len("".join(gaps)), "I" * len(gaps[0]), gaps[0]
            for kind, edit, gap in zip(kinds, edits, gaps[1:]):
                if kind == "x" and edit != "D":
                    break
                cost += {"D": 2, "K": 0}.get(edit, 1) + 5 * (kind.isupper() and edit != "D")
                audit += {"D": "D", "K": "K"}.get(edit, "R") + "I" * len(gap)
                roles += {"D": "", "K": kind.lower()}.get(edit, edit) + gap
            else:
                if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                    best = cost, audit
    return best


def forward(kinds):
    """The best edits by a walk over states, one turn at a time."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def inserted(states):
        todo = dict(states)
        for _ in range(3):
            for q, (cost, audit) in list(todo.items()):
                for x in "ua":
                    if (q, x) in step:
                        r = step[q, x]
                        todo[r] = min(todo.get(r, (10**9, "")), (cost + 5, audit + "I"))
        return todo

    now = inserted({0: (0, "")})
    for kind in kinds:
        then = {}
        for q, (cost, audit) in now.items():
            ways = [(q, 2, "D")]
            if kind != "x":
                more = 5 * kind.isupper()
                ways += [(step[q, kind.lower()], more, "K")] if (q, kind.lower()) in step else []
                ways += [(step[q, x], more + 1, "R") for x in "ua" if (q, x) in step]
            for r, n, e in ways:
                then[r] = min(then.get(r, (10**9, "")), (cost + n, audit + e))
        now = inserted(then)
    return min(now[q] for q in (0, 3) if q in now)


def test_parser_equals_all_edits_of_short_conversations():
    parser = c.Parser()
    assert parser.repair("") == (0, "")
    for n in (1, 2):
        for kinds in map("".join, itertools.product(KINDS, repeat=n)):
            assert parser.repair(kinds) == enumerated(kinds) == forward(kinds), kinds
    for kinds in ("uau", "aua", "sua", "Uau", "xao", "aAs"):
        assert parser.repair(kinds) == enumerated(kinds), kinds


def test_parser_equals_a_walk_over_states():
    r, parser = random.Random(4), c.Parser()
    for i in range(400):
        kinds = "".join(r.choices(KINDS, k=r.choice([3, 5, 8, 11, 12, 13, 24, 25, 60, 401 if i % 40 == 0 else 30])))
        assert parser.repair(kinds) == forward(kinds), kinds


def test_split_of_a_span_does_not_matter(monkeypatch):
    r = random.Random(5)
    for _ in range(20):
        kinds = "".join(r.choices(KINDS, k=20))
        got = set()
        for whole in (1, 3, 12, 20):
            monkeypatch.setattr(c, "WHOLE", whole)
            got.add(c.Parser().repair(kinds))
        assert len(got) == 1


def plain(rows):
    """conv_id to what op12 returns of it, by plain loops."""
    or_space = lambda x: " " if x is None else str(x)
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{or_space(conv)}:{or_space(turn)}".encode()) % 20
        role, text = or_space(role), or_space(text)
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        digest = hashlib.sha256(f"{len('user' if h == 4 else role)}:{'user' if h == 4 else role}{text}".encode()).digest()
        row = (turn is not None, turn or 0, "user" if h == 4 else role, digest, text)
        found[conv] += [row] * {0: 0, 3: 2}.get(h, 1)
    out = {}
    for conv, own in found.items():
        own.sort()
        turns = [t for k, t, *_ in own if k]
        seen, kinds, tally = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, _, text in own:
            body = text.strip(WHITE)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            tally |= {fault: tally[fault] + 1} if fault else {}
            initial = role[0] if role[:1] and role[0] in "sua" else "o"
            kinds += "x" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit = forward(kinds)
        lines, rest, last = [], iter(own), ""
        for e in audit:
            row = next(rest) if e != "I" else ("", "", "", "", "")
            if e == "D":
                continue
            last = row[2] if e == "K" else "assistant" if last[:1] == "u" else "user"
            lines.append(f"{last}:{row[4]}")
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *tally.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def made(seed=7):
    r = random.Random(seed)
    text = lambda: r.choice(["Yes.", "No!", "Why?", "cut off", "", " \n", None, "é.\u000b", "same.", "wordy " * 300 + "."])
    rows = [(i, t, r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), text()) for i in range(150) for t in range(r.randint(1, 9))]
    rows += [(i, t, ["user", "assistant"][t % 2], f"{t}. Well.") for i in range(150, 190) for t in range(r.randint(2, 8)) if r.random() < 0.95]
    rows += [(200, t, ["user", "assistant"][t % 2], f"{t}.") for t in range(900)] + [(201, None, "user", "a."), (201, None, "assistant", "b."), (201, 4, "user", "c")]
    return rows + [(None, t, "user", "Hm.") for t in (None, 1, 2)] + [rows[3], rows[3], rows[40]]


@pytest.mark.parametrize("batch", [10_000, 7])
def test_query_equals_plain_loops(spark, tmp_path, batch):
    rows = made()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({x: F.lit(1) for x in ("kind", "at", "times", "digest", "audit", "cost")})
    df.write.parquet(f"file://{tmp_path}/conversations.parquet")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {r["conv_id"]: tuple(r)[1:] for r in c.query(spark, f"file://{tmp_path}").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == plain(rows)


def test_repaired_turns(spark):
    rows = spark.createDataFrame([(1, 0, "assistant", "Hello."), (1, 1, "user", "And?")], "conv_id long, turn long, role string, text string")
    whole = rows.withColumn("times", F.lit(1))
    got = [tuple(r)[1:5] for r in c.repaired(whole).collect()]
    assert got[0][:2] == (0, None) and [x[2] for x in got[1:]] == ["user", "assistant"] and [x[3] for x in got[1:]] == ["Hello.", "And?"]
    assert c.repaired(whole.where("false")).count() == 0


def test_all_rows_of_a_conversation_dropped(spark, tmp_path):
    key = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    spark.createDataFrame([(key, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string").write.parquet(f"file://{tmp_path}/conversations.parquet")
    assert tuple(c.query(spark, f"file://{tmp_path}").first()) == (key, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
