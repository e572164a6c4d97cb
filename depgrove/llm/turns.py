"""The cheapest edits that give a conversation the roles `(s?(ua)+)?`: costs to go backward, then a walk forward.

States of the grammar: 0 nothing yet, 1 a system turn, 2 a user's, 3 an assistant's; 0 and 3 may end. What lies ahead of a place is a tuple
of the least cost from each state to a good end. Only differences matter to the walk, so tuples are kept less their minimum; there are few
of them, and each step and each walk over a row is worked out once for a tuple and a kind of row. Parts of a conversation compose: a part
is a matrix from the costs after it to those before it, and, once those are known, a map from the state before it to that after it.
"""

from __future__ import annotations

import hashlib
from functools import cache

USER, ASSISTANT = b"user", b"assistant"
INITIALS = {b"s": 0, b"u": 1, b"a": 2}
OTHER = 3
#: Added to an initial: the row is cut off, or must go (blank, duplicate).
CUT, GONE = 4, 8
REROLE, DELETE, INSERT, UNENDED = 1, 2, 5, 5
INF = float("inf")
STATES = range(4)
#: The state after a user's or assistant's turn, whichever the grammar allows, and the role it has.
ADDED = (2, 2, 3, 2)
ADDS = (USER, USER, ASSISTANT, USER)
#: What lies ahead of a conversation's end.
END = (0, 2 * INSERT, INSERT, 0)
#: Adjacent initials that are in order.
LEGAL = {(0, 1), (1, 2), (2, 1)}
LONG = 2**63 - 1


def _kept(state: int, kind: int) -> int | None:
    """The state after a row that stays as it is."""
    initial = kind % 4
    if initial == 0:
        return 1 if state == 0 else None
    return ADDED[state] if initial < OTHER and (ADDED[state] == 2) == (initial == 1) else None


def _choices(state: int, kind: int) -> list[tuple[str, int, int]]:
    """Edits of a row in ASCII order: letter, cost, state after it."""
    out = [("D", DELETE, state)]
    if kind < GONE:
        cost = UNENDED if kind & CUT else 0
        to = _kept(state, kind)
        out += [("K", cost, to)] if to is not None else []
        out.append(("R", cost + REROLE, ADDED[state]))
    return out


def _least(ahead: tuple) -> tuple:
    low = min(ahead)
    return tuple(v - low for v in ahead)


@cache
def _exact(ahead: tuple, kind: int) -> tuple:
    """What lies ahead of a row of this kind, with its costs in full."""
    cost = [min(c + ahead[to] for _, c, to in _choices(q, kind)) for q in STATES]
    for _ in STATES:
        cost = [min(cost[q], INSERT + cost[ADDED[q]]) for q in STATES]
    return tuple(cost)


@cache
def before(ahead: tuple, kind: int) -> tuple:
    return _least(_exact(ahead, kind))


@cache
def walk(ahead: tuple, kind: int, state: int) -> tuple[str, int, int, tuple]:
    """Over one row, with the least letter of those that cost no more than must be: letters, cost, state after it, and the roles of the turns
    that are added, with None for the row itself and its new role in a tuple of its own."""
    here, letters, spent, turns = _exact(ahead, kind), "", 0, []
    while True:
        options = sorted([*_choices(state, kind), ("I", INSERT, ADDED[state])])
        for letter, cost, to in options:
            rest = here[to] if letter == "I" else ahead[to]
            if cost + rest == here[state]:
                break
        letters, spent = letters + letter, spent + cost
        if letter == "I":
            turns.append(("I", ADDS[state]))
        elif letter != "D":
            turns.append((letter, ADDS[state]))
        state = to
        if letter != "I":
            return letters, spent, state, tuple(turns)


def ahead_of(kinds: list[int], end: tuple) -> list[tuple]:
    """What lies after each row."""
    out, v = [END] * len(kinds), _least(end)
    for i in range(len(kinds) - 1, -1, -1):
        out[i] = v
        v = before(v, kinds[i])
    return out


def costs(kinds: list[int]) -> list[float]:
    """The matrix of a part, row by row: the least cost from a state before it to a state after it."""
    columns = []
    for to in STATES:
        v, total = tuple(0 if q == to else INF for q in STATES), 0
        for kind in reversed(kinds):
            v = _exact(v, kind)
            low = min(v)
            v, total = tuple(x - low for x in v), total + low
        columns.append([x + total for x in v])
    return [columns[to][q] for q in STATES for to in STATES]


def through(matrix: list[float], after: tuple) -> tuple:
    """What lies ahead of a part."""
    return _least(tuple(min(matrix[4 * q + to] + after[to] for to in STATES) for q in STATES))


def exits(kinds: list[int], after: tuple) -> list[int]:
    """The state after a part for each state before it."""
    ahead, out = ahead_of(kinds, after), []
    for state in STATES:
        for kind, v in zip(kinds, ahead):
            state = walk(v, kind, state)[2]
        out.append(state)
    return out


def closing(state: int) -> list[bytes]:
    """The roles of the turns that a conversation still needs at its end."""
    return {0: [], 1: [USER, ASSISTANT], 2: [ASSISTANT], 3: []}[state]


class Part:
    """A run of a conversation's rows, repaired: its counts, letters and text, to be put together with the runs that follow."""

    def __init__(self, rows, after: tuple = END, state: int = 0, last: bool = True):
        """rows: turn, kind, fault (0 none, 1 blank, 2 duplicate, 3 cut off), role, text, copies; further copies of a row are duplicates, and a
        row without any only names its conversation."""
        rows = [r for r in rows if r[5]]
        self.faults = [0, 0, 0, 0]
        self.illegal, self.first, self.last = 0, None, None
        kinds = []
        for _, kind, fault, _, _, copies in rows:
            self.faults[fault] += copies if fault in (1, 2) else 1
            self.faults[2] += copies - 1 if fault in (0, 3) else 0
            self._follow(kind % 4)
            self.illegal += copies - 1
            kinds.append(kind)
        turns = sorted({r[0] for r in rows if r[0] is not None})
        self.low, self.high, self.turns = (turns[0], turns[-1], len(turns)) if turns else (None, None, 0)
        letters, self.cost, lines = [], 0, []
        for (_, kind, _, role, text, copies), v in zip(rows, ahead_of(kinds, after)):
            edits, cost, state, added = walk(v, kind, state)
            letters.append(edits + "D" * (copies - 1))
            self.cost += cost + DELETE * (copies - 1)
            for letter, new in added:
                lines.append(new + b":" if letter == "I" else (role if letter == "K" else new) + b":" + text)
        if last:
            more = closing(state)
            letters.append("I" * len(more))
            self.cost += INSERT * len(more)
            lines += [role + b":" for role in more]
        self.audit, self.lines = "".join(letters), lines

    def _follow(self, initial: int) -> None:
        self.illegal += self.last is not None and (self.last, initial) not in LEGAL
        self.first = initial if self.first is None else self.first
        self.last = initial


class Whole:
    """Parts of one conversation put together in order; the text is hashed as it comes."""

    def __init__(self):
        self.faults, self.illegal, self.last, self.cost, self.audit = [0, 0, 0, 0], 0, None, 0, []
        self.low = self.high = None
        self.turns, self.sha, self.begun = 0, hashlib.sha256(), False

    def add(self, faults, illegal, first, last, low, high, turns, cost, audit) -> None:
        self.faults = [a + b for a, b in zip(self.faults, faults)]
        self.illegal += illegal + (self.last is not None and first is not None and (self.last, first) not in LEGAL)
        self.last = self.last if last is None else last
        if low is not None:
            self.turns += turns - (self.high == low)
            self.low, self.high = low if self.low is None else self.low, high
        self.cost += cost
        self.audit.append(audit)

    def text(self, piece: bytes) -> None:
        if piece:
            self.sha.update(b"\n" * self.begun + piece)
            self.begun = True

    def row(self) -> tuple:
        """gaps, blank, duplicate, truncated, illegal, cost, audit and the hash."""
        gaps = 0 if self.low is None else min(LONG, self.high - self.low + 1 - self.turns)
        return (gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest())
