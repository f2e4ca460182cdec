"""Conversation repair against exhaustive search, in one piece and in many, and its edge cases."""

import hashlib
import random
import re

import pytest
from lineupkit.llm import conversation_repair, queries
from lineupkit.llm.earley import ROLES, Fold, matrix, parse, repair

GOOD = re.compile(r"(s?(ua)+)?\Z")
SCHEMA = "conv_id long, turn long, role string, text string"


def exhaustive(tokens):
    """The least (cost, audit) and its roles over all edits with at most two inserts in a place."""
    rows, best = [tokens[k : k + 2] for k in range(0, len(tokens), 2)], None

    def go(k, cost, audit, out):
        nonlocal best
        if best and cost > best[0]:
            return
        for new in ("", "u", "a", "ua", "au"):
            c, e, o = cost + 3 * len(new), audit + "I" * len(new), out + new
            if k == len(rows):
                if GOOD.match(o) and (best is None or (c, e) < best[:2]):
                    best = c, e, o
                continue
            initial, fault = rows[k]
            cut = 3 if fault == "t" else 0
            go(k + 1, c + 4, e + "D", o)
            if fault not in "bd":
                go(k + 1, c + cut, e + "K", o + initial)
                for role in "ua":
                    go(k + 1, c + 3 + cut, e + "R", o + role)

    go(0, 0, "", "")
    return best


def letters(rng, n):
    return "".join(rng.choice("suuaa?") + rng.choice("....bdt") for _ in range(n))


def test_parser_finds_the_least_repair():
    rng = random.Random(3)
    for _ in range(300):
        tokens = letters(rng, rng.randint(0, 5))
        cost, audit, roles = repair(tokens, ROLES)
        assert (cost, audit, roles.replace("-", "")) == exhaustive(tokens)


@pytest.mark.parametrize("size", [1, 2, 7])
def test_pieces_give_the_same_repair(size):
    rng = random.Random(size)
    for n in (1, 2, 5, 40, 173):
        tokens = letters(rng, n)
        pieces, fold, whole = [tokens[k : k + 2 * size] for k in range(0, len(tokens), 2 * size)], Fold(ROLES), (0, "")
        for p in pieces:
            fold.add(matrix(p, ROLES))
        for p, (x, y) in zip(pieces, fold.entries(), strict=True):
            part = repair(p, ROLES, ROLES.states[x]) if y < 0 else parse(p, ROLES, ROLES.states[x], closing=False)[ROLES.states[y]]
            whole = whole[0] + part[0], whole[1] + part[1]
        assert whole == repair(tokens, ROLES)[:2]


def plain(rows):
    """Digest of one conversation's rows, in plain Python."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, tokens = set(), ""
    for _, role, text in rows:
        bare = (text or "").strip(" \t\n\x0b\x0c\r")
        fault = "b" if not bare else "d" if (role, text) in seen else "." if bare[-1] in ".!?" else "t"
        seen.add((role, text))
        first = (role or "")[:1]
        tokens += (first if first and first in "sua" else "?") + fault
    cost, audit, roles = repair(tokens, ROLES)
    out, k = [], 0
    for edit, to in zip(audit, roles, strict=True):
        _, role, text = rows[k] if edit != "I" else (0, "", "")
        k += edit != "I"
        if edit != "D":
            out.append(f"{role if edit == 'K' else {'u': 'user', 'a': 'assistant'}[to]}:{text}")
    turns = [r[0] for r in rows if r[0] is not None]
    illegal = sum(tokens[k] + tokens[k + 2] not in ("su", "ua", "au") for k in range(0, len(tokens) - 2, 2))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *(tokens[1::2].count(f) for f in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def test_long_and_odd_conversations(spark):
    rng = random.Random(8)
    words = ["Yes.", "no", "Why?", "", " \t", "x" * 5000 + "!", "Ünï.", "a\nb."]
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice(words) + str(t % 41)) for t in range(400)]  # over many pieces
    rows += [(2, None, "user", "Hello."), (2, 5, "assistant", "Hi."), (2, 9, "odd", "Hm.")]
    rows += [(3, 0, None, None), (3, 1, "", "Text.")]
    rows += [(4, 0, "user", "Same."), (4, 0, "user", "Same."), (4, 1, "assistant", "Ends")]
    rows += [(None, 0, "system", "Be good."), (None, 1, "user", "Ask?")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).selectExpr("*", "1 AS id", "'x' AS fault", "0 AS part")
    got = {r[0]: tuple(r)[1:] for r in conversation_repair.digests(conversation_repair.repair_conversations(df, piece_rows=9, tasks=6)).collect()}
    want = {c: plain([r[1:] for r in rows if r[0] == c]) for c in (1, 2, 4, None)}
    want[3] = plain([(0, "", ""), (1, "", "Text.")])
    assert got == want


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert conversation_repair.digests(conversation_repair.repair_conversations(empty)).count() == 0


def test_edits_are_rows(spark):
    rows = [(1, 0, "user", "Ask."), (1, 1, "user", "Again."), (1, 3, "assistant", " ")]
    found = conversation_repair.repair_conversations(spark.createDataFrame(rows, SCHEMA)).orderBy("part", "piece", "place").collect()
    assert [(r.edit, r.role, r.text, r.fault, r.cost) for r in found] == [("K", "user", "Ask.", ".", 0), ("R", "assistant", "Again.", ".", 3), ("D", "assistant", " ", "b", 4)]


def test_query_equals_sql(spark, duck):
    got = sorted(tuple(r) for r in queries.QUERIES["op11_earley_repair"](spark, "/root/testdata/sf0.001").collect())
    assert got == sorted(duck.execute(queries.SQL["op11_earley_repair"]).fetchall())
