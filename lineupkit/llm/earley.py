"""Error-correcting Earley parsing with minimum-cost chart items.

A grammar's productions are widened by edits: a terminal may be kept, be read from a row of another role (rerole), or be
there without a row (insert), and every nonterminal may take in a row that is thrown away (delete).  A chart
item (production, dot, origin) retains the least (cost, audit, roles) of all ways to it; the audit has one letter an edit,
K, R, D or I, and ``roles`` the terminal that each stands for (- for a delete).

Two audits of one cost over the same rows are never one the beginning of the other, since the longer would have more inserts
and so cost more.  Therefore the least of a whole is made of the least of its parts, and a long input can be cut: ``parse``
starts from any nonterminal, and ``fold`` puts the pieces together from their costs and the order of their audits.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import lru_cache

Value = tuple[int, str, str]
#: A row is two letters to the parser: role initial, and fault (. none, b blank, d duplicate, t truncated).
#: The terminal of the delete productions, which every row is.
DELETE = "<delete>"


@dataclass(frozen=True)
class Grammar:
    """Left-linear productions (left, (nonterminal, terminal)), where to begin, and what may be complete at the end."""

    rules: tuple[tuple[str, tuple[str, str]], ...]
    start: str
    accepting: tuple[str, ...]
    editable: str = "ua"
    rerole: int = 3
    delete: int = 4
    insert: int = 3
    truncated: int = 3

    @property
    def states(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys([self.start, *[r[0] for r in self.rules]]))

    def widened(self) -> tuple[tuple[str, tuple[str, str]], ...]:
        """The productions with a delete production for every nonterminal."""
        return (*self.rules, *[(n, (n, DELETE)) for n in self.states])

    def edits(self, terminal: str, initial: str, fault: str) -> list[Value]:
        """Ways to read a row as ``terminal``."""
        if terminal == DELETE:
            return [(self.delete, "D", "-")]
        if fault in "bd":
            return []
        more = self.truncated if fault == "t" else 0
        out = [(more, "K", terminal)] if initial == terminal else []
        return out + ([(self.rerole + more, "R", terminal)] if terminal in self.editable else [])


#: (s?(ua)+)?: nothing, or a system turn that may be missing and then user and assistant in turns.
ROLES = Grammar(
    rules=(("system", ("nothing", "s")), ("user", ("nothing", "u")), ("user", ("system", "u")), ("user", ("reply", "u")), ("reply", ("user", "a"))),
    start="nothing",
    accepting=("nothing", "reply"),
)


def _parse(tokens: str, grammar: Grammar, entry: str, closing: bool) -> dict[str, Value]:
    rules, n = grammar.widened(), len(tokens) // 2
    names = set(grammar.states)
    by_left: dict[str, list[int]] = {}
    for k, (left, _) in enumerate(rules):
        by_left.setdefault(left, []).append(k)
    charts: list[dict[tuple[int, int, int], Value]] = [{} for _ in range(n + 1)]
    waiting: list[dict[str, set]] = [{} for _ in range(n + 1)]  # items before a nonterminal
    complete: list[dict[tuple[str, int], Value]] = [{} for _ in range(n + 1)]
    heaps: list[list] = [[] for _ in range(n + 1)]

    def add(j: int, item: tuple[int, int, int], value: Value) -> None:
        old = charts[j].get(item)
        if old is None or value < old:
            charts[j][item] = value
            heapq.heappush(heaps[j], (value, item))

    def joined(a: Value, b: Value) -> Value:
        return a[0] + b[0], a[1] + b[1], a[2] + b[2]

    def completed(j: int, left: str, origin: int, value: Value) -> None:
        old = complete[j].get((left, origin))
        if old is None or value < old:
            complete[j][left, origin] = value
            for rule, dot, begin in waiting[origin].get(left, ()):
                add(j, (rule, dot + 1, begin), joined(charts[origin][rule, dot, begin], value))

    def settle(j: int) -> None:
        """Predict, scan and complete at ``j``, cheapest items first."""
        while heaps[j]:
            value, item = heapq.heappop(heaps[j])
            if charts[j][item] != value:
                continue
            k, dot, origin = item
            left, right = rules[k]
            if dot == len(right):
                completed(j, left, origin, value)
            elif right[dot] in names:
                waiting[j].setdefault(right[dot], set()).add(item)
                for p in by_left.get(right[dot], ()):
                    add(j, (p, 0, j), (0, "", ""))
                if (done := complete[j].get((right[dot], j))) is not None:
                    add(j, (k, dot + 1, origin), joined(value, done))
            else:
                terminal, then = right[dot], (k, dot + 1, origin)
                if terminal in grammar.editable and (closing or j < n):
                    add(j, then, joined(value, (grammar.insert, "I", terminal)))
                if j < n:
                    for edit in grammar.edits(terminal, tokens[2 * j], tokens[2 * j + 1]):
                        add(j + 1, then, joined(value, edit))

    for k in range(len(rules)):  # all are predicted at once: a piece may end in any nonterminal
        add(0, (k, 0, 0), (0, "", ""))
    settle(0)
    completed(0, entry, 0, (0, "", ""))
    for j in range(n + 1):
        settle(j)
        if j < n:  # later rows read only what waits here
            charts[j] = {i: charts[j][i] for items in waiting[j].values() for i in items}
    return {name: v for (name, origin), v in complete[n].items() if origin == 0}


_short = lru_cache(1 << 16)(_parse)


def parse(tokens: str, grammar: Grammar, entry: str | None = None, closing: bool = True) -> dict[str, Value]:
    """Least value of every nonterminal that can be complete after all rows.

    ``tokens`` has two letters a row.  Without ``closing`` nothing is inserted after the last row.  Parses of short inputs
    are kept: conversations of the same roles and faults are parsed once a task.
    """
    entry = grammar.start if entry is None else entry
    return (_short if len(tokens) <= 32 else _parse)(tokens, grammar, entry, closing)


def repair(tokens: str, grammar: Grammar, entry: str | None = None) -> Value:
    """The least repair of a whole input, or of its last piece from ``entry`` on."""
    found = parse(tokens, grammar, entry)
    return min(found[n] for n in grammar.accepting if n in found)


def matrix(tokens: str, grammar: Grammar) -> list[int]:
    """Of a piece, for every entry and exit: cost (-1 where there is no way) and the place of its audit among its entry's."""
    out = []
    for entry in grammar.states:
        found = parse(tokens, grammar, entry, closing=False)
        order = sorted(found, key=lambda n: found[n][1:])
        out += [x for n in grammar.states for x in ((found[n][0], order.index(n)) if n in found else (-1, -1))]
    return out


class Fold:
    """The best way through the pieces of one conversation, from their matrices in order."""

    def __init__(self, grammar: Grammar) -> None:
        self.grammar, self.names = grammar, grammar.states
        self.best: dict[int, tuple[int, int]] = {self.names.index(grammar.start): (0, 0)}  # exit: cost, place of the audit
        self.back: list[dict[int, int]] = []

    def add(self, piece: list[int]) -> None:
        n = len(self.names)
        new: dict[int, tuple[int, int, int, int]] = {}
        for x, (cost, place) in self.best.items():
            for y in range(n):
                more, rank = piece[2 * (x * n + y) : 2 * (x * n + y) + 2]
                if more >= 0 and (y not in new or (cost + more, place, rank) < new[y][:3]):
                    new[y] = (cost + more, place, rank, x)
        order = sorted(new, key=lambda y: new[y][1:3])
        self.best = {y: (new[y][0], order.index(y)) for y in new}
        self.back.append({y: v[3] for y, v in new.items()})

    def entries(self) -> list[tuple[int, int]]:
        """(entry, exit) of every piece; the last one's exit is open (-1)."""
        ends = {}
        for y, (cost, place) in self.best.items():
            ends[y] = (cost + repair("", self.grammar, self.names[y])[0], place)
        y, out = min(ends, key=ends.get), []
        for back in reversed(self.back):
            out.append((back[y], y))
            y = back[y]
        out.reverse()
        return [*out[:-1], (out[-1][0], -1)]
