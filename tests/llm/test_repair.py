"""Conversation repair against a search over all edits, in one segment and in many, with odd rows."""

import collections
import hashlib
import random
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from depgrove.llm import repair

SPACES = " \t\n\x0b\x0c\r"


def damage(rows):
    out = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        spaced = [" " if v is None else str(v) for v in (conv, turn, role, text)]
        kind = zlib.crc32(f"{spaced[0]}:{spaced[1]}".encode()) % 20
        role, text = ("user" if kind == 4 else spaced[2]), spaced[3]
        text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
        out[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    name = lambda conv: "" if conv is None else f"={conv}"
    key = lambda conv, r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(f"{len(name(conv))}:{name(conv)}:{len(r[1])}:{r[1]}:{r[2]}".encode()).hexdigest())
    return {conv: sorted(found, key=lambda r: key(conv, r)) for conv, found in out.items()}


def wanted(rows):
    turns = [r[0] for r in rows if r[0] is not None]
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.rstrip(SPACES)
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [role[:1] for _, role, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))

    @cache
    def best(i, state, inserts=0):
        """Least cost and letters from here, and the turns; the states are the initials of the turn before."""
        options = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        new = "assistant" if state == "u" else "user"
        then = lambda rest, cost, letter, turn: options.append((rest[0] + cost, letter + rest[1], turn + rest[2]))
        if inserts < 3:
            then(best(i, new[0], inserts + 1), 5, "I", (new + ":",))
        if i < len(rows):
            _, role, text = rows[i]
            then(best(i + 1, state), 2, "D", ())
            if faults[i] not in ("b", "d"):
                extra = 5 if faults[i] == "t" else 0
                if role[:1] == new[0] or (role[:1] == "s" and state == ""):
                    then(best(i + 1, role[:1]), extra, "K", (f"{role}:{text}",))
                then(best(i + 1, new[0]), extra + 1, "R", (f"{new}:{text}",))
        return min(options, default=(10**9, "", ()))

    for i in range(len(rows), 0, -1):  # from the end, so that no call goes deep
        for state in ("", "s", "u", "a"):
            best(i, state)
    cost, audit, lines = best(0, "")
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = []
    for conv in [*range(150), None]:
        for turn in range(rng.choice([1, 2, 5, 9])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "User", "agent", "", None])
            text = rng.choice(["Yes.", "No", "  ", "", None, "What is it?  \n", "a.b", "über!", "..."] + [f"text {rng.random()}." for _ in range(6)])
            out.append((conv, rng.choice([turn, turn, turn, turn + 1, 3 * turn, None, -turn]), role, text))
    out += out[5:40]
    for turn in range(400):  # a hot one, over many segments
        out.append((1000, turn // 3 if turn % 7 else None, rng.choice(["user", "assistant", "system", "x"]), rng.choice(["Same.", "other", f"{turn}.", f"{turn}"])))
    out += [(1001, 0, "user", "long. " * 120_000), (1001, 1, "assistant", "word " * 90_000 + "."), (1001, 2, "user", "end")]
    out += [(1002, 5, "assistant", "all alike.")] * 60
    return out


def test_repair(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    df = df.select("*", *[F.lit(None).cast("string").alias(c) for c in ("kind", "copies", "known", "key", "seg", "after", "entry", "last", "cost")])
    want = {conv: wanted(found) for conv, found in damage(rows).items()}
    assert any(not found for found in damage(rows).values()) and {c for w in want.values() for c in w[6]} == set("DKR")  # an insert never pays: its partner can go for less
    for size in (1 << 30, 4000):
        found = repair.repair(df, segment_bytes=size).collect()
        got = {r.conv_id: tuple(r)[1:] for r in found}
        assert len(found) == len(got) == len(want)
        for conv, w in want.items():
            assert got[conv] == w, conv
    assert repair.repair(df.limit(0)).count() == 0


def test_text_ids(spark):
    df = spark.createDataFrame([("a b", 0, "user", "Hi."), ("a b", 1, "assistant", "Ho."), (None, None, None, None)], "conv_id string, turn int, role string, text string")
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair(df).collect()}
    assert got == {c: wanted(r) for c, r in damage([tuple(r) for r in df.collect()]).items()}
