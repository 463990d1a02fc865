"""Conversation repair against exhaustive edits and against a plain dynamic program over whole tables."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from voxspark.llm import conversation as cv
from voxspark.llm.queries import op13_conversation_repair

GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def damaged(rows):
    out = []
    for c, t, r, x in rows:
        shown = lambda v: " " if v is None else str(v)
        h, r, x = zlib.crc32(f"{shown(c)}:{shown(t)}".encode()) % 20, shown(r), shown(x)
        x = "" if h == 1 else re.sub("[.!?]", "", x) if h == 2 else x
        out += [(c, t, "user" if h == 4 else r, x)] * (0 if h == 0 else 2 if h == 3 else 1)
    return out


def faults_of(rows):
    seen, out = set(), []
    for _, _, r, x in rows:
        bare = re.sub(r"[\x20\t-\r]", "", x)
        out.append("b" if not bare else "d" if (r, x) in seen else "t" if bare[-1] not in ".!?" else " ")
        seen.add((r, x))
    return out


def repaired(rows, faults):
    """A forward program over all states: (cost, audit, output) by the roles' initials so far."""
    now = {"": (0, "", ())}

    def insert(now):
        for _ in range(4):
            for state, (c, a, o) in list(now.items()):
                role = "assistant" if state == "u" else "user"
                new = (c + 5, a + "I", (*o, (role, "")))
                if role[0] not in now or new[:2] < now[role[0]][:2]:
                    now[role[0]] = new
        return now

    for (_, _, r, x), f in zip(rows, faults, strict=True):
        new: dict = {}
        for state, (c, a, o) in insert(now).items():
            found = [(state, (c + 2, a + "D", o))]
            if f not in "bd":
                more = 5 * (f == "t")
                for role, cost, letter in ((r, 0, "K"), ("user", 1, "R"), ("assistant", 1, "R")):
                    if role[:1] and state + role[:1] in ("s", "u", "su", "ua", "au"):
                        found.append((role[0], (c + cost + more, a + letter, (*o, (role, x)))))
            for s, y in found:
                if s not in new or y[:2] < new[s][:2]:
                    new[s] = y
        now = new
    return min((v for s, v in insert(now).items() if s in ("", "a")), key=lambda v: v[:2])


def expected(table):
    out = {}
    for c in {r[0] for r in table}:
        rows = sorted((r for r in damaged(table) if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        faults = faults_of(rows)
        cost, audit, kept = repaired(rows, faults)
        turns = [r[1] for r in rows if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in kept).encode()).hexdigest()
        out[c] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, digest)
    return out


def as_dict(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


def test_search_against_all_edits():
    """Every sequence of edits with up to three insertions, of short conversations."""
    rng = random.Random(3)
    for _ in range(60):
        symbols = "".join(rng.choice("suaoSUAO-") for _ in range(rng.randint(0, 4)))
        best = None
        for letters in itertools.product("DKR", repeat=len(symbols)):
            if any(s == "-" and x != "D" for s, x in zip(symbols, letters, strict=True)):
                continue
            for places in itertools.chain.from_iterable(itertools.combinations_with_replacement(range(len(symbols) + 1), k) for k in range(4)):
                audit, roles, cost = "", [[]], 5 * len(places)
                for i, x in enumerate([*letters, ""]):
                    for _ in range(places.count(i)):
                        audit, roles = audit + "I", [[*r, y] for r in roles for y in "ua"]
                    audit += x
                    if x in ("K", "R"):
                        roles = [[*r, y] for r in roles for y in (symbols[i].lower() if x == "K" else "ua")]
                        cost += 5 * symbols[i].isupper()
                    cost += {"D": 2, "R": 1}.get(x, 0)
                if any(GRAMMAR.match("".join(r)) for r in roles):
                    best = min(best or (cost, audit), (cost, audit))
        assert cv.solve_rows(symbols) == best, symbols


def test_blocks_join_to_the_whole():
    rng = random.Random(5)
    for _ in range(10):
        symbols = "".join(rng.choice("suaoSUA-uaua") for _ in range(150))
        cuts = [0, *sorted(rng.sample(range(1, 150), 70)), 150]
        tables = [[[cv.solve_rows(symbols[a:b], s, (t,)) for t in range(4)] for s in range(4)] for a, b in itertools.pairwise(cuts)]
        assert cv.solve_blocks(tables) == cv.solve_rows(symbols)


def test_op13_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert as_dict(op13_conversation_repair(spark, sf)) == expected(rows)


@pytest.mark.parametrize("block", [2, 512])
def test_odd_rows_and_long_conversations(spark, block):
    rng = random.Random(7)
    roles, texts = ["user", "assistant", "system", "tool", "", None], ["Yes.", "no end", "", None, " \n", "Really? ", "ünd!", "x" * 30_000]
    rows = [(1, i, rng.choice(roles), rng.choice(texts) if i % 3 else f"Text {i}.") for i in range(300)]
    rows += [(2, None, None, None), (2, None, "user", "Hi."), (2, 4, "user", "Hi."), (2, 9, "assistant", "Bye."), (2, 9, "assistant", "Bye.")]
    rows += [(None, 1, "user", "a."), (None, None, "assistant", "b."), (3, 1, "user", None), *[(4, 5, "user", "Same.")] * 40]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.selectExpr("*", "'clash' AS kind", "'clash' AS k", "'clash' AS copies")
    assert as_dict(cv.repair_reports(cv.damage(df), df, block)) == expected(rows)
    turns = cv.repair_turns(cv.damage(df), block).collect()
    for c, want in expected(rows).items():
        kept = sorted((r for r in turns if r["conv_id"] == c), key=lambda r: r["position"])
        assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in kept).encode()).hexdigest() == want[-1]
        assert "".join(r["edit"] for r in kept) == want[-2].replace("D", "")
    assert cv.repair_reports(cv.damage(df.where("false")), df.where("false")).count() == 0
