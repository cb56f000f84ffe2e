"""Versions of sessions against a replay that sorts everything anew after each batch."""

import random
import zlib
from collections import defaultdict

import pytest

from chirplake.llm import late_sessions
from chirplake.llm.shared import Scratch

SCHEMA = "user long, time long, batch long, value long"


def by_hand(rows, gap=240):
    users, out = defaultdict(lambda: defaultdict(list)), []
    for user, time, batch, value in rows:
        if None not in (user, time, batch):
            users[user][batch].append((time, value or 0))
    for user, batches in users.items():
        seen, standing = [], []
        for number in sorted(batches):
            seen = sorted(seen + [(t, v, number) for t, v in batches[number]])
            sessions = [[seen[0]]]
            for e in seen[1:]:
                sessions[-1].append(e) if e[0] - sessions[-1][-1][0] <= gap else sessions.append([e])
            new = []
            for s in sessions:
                fresh = sum(e[2] == number for e in s)
                if fresh:
                    old = [v for v in standing if s[0][0] <= v[2] <= s[-1][0]]
                    standing = [v for v in standing if v not in old]
                    out += [[*v[:8], number, s[0][0]] for v in old]
                    new.append([user, number, s[0][0], s[-1][0], len(s), fresh, len(old), sum(e[1] for e in s), None, None])
            standing += new
        out += standing
    return sorted((tuple(-1 if x is None else x for x in v) for v in out))


def versions(spark, frame, rows, **more):
    got = late_sessions.versions(frame(rows, SCHEMA).selectExpr("*", "'x' AS cell", "'y' AS stretch", "1 AS block", "2 AS h"), Scratch(spark, "late"), **more)
    return sorted(tuple(-1 if x is None else x for x in r) for r in got.collect())


@pytest.mark.parametrize("seed", range(4))
def test_random_events(spark, frame, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(5), rng.randrange(-3000, 12_000), rng.randrange(-2, 9), rng.randrange(100)) for _ in range(400)]
    rows += rows[:30]  # equal events
    assert versions(spark, frame, rows) == by_hand(rows)


def test_one_user_over_many_blocks(spark, frame):
    """Stretches that fill blocks without a beginning in them, and one that ends on a block's border."""
    rng, block = random.Random(7), 240 * late_sessions.BLOCK
    rows = [(1, t + rng.randrange(20), rng.randrange(4), 1) for t in range(0, 9 * block, 200)]
    rows += [(1, 9 * block + 200 * i, 1, 2) for i in range(1, 4)] + [(2, 5 * block - 1, 0, 1), (2, 5 * block, 3, 1), (2, 5 * block + 240, 2, 1), (2, 5 * block + 481, 1, 1)]
    assert versions(spark, frame, rows) == by_hand(rows)


def test_nulls_and_nothing(spark, frame):
    rows = [(None, 1, 1, 1), (1, None, 1, 1), (1, 1, None, 1), (1, 5, 1, None), (1, 245, 2, 7), (1, 486, 2, 1)]
    assert versions(spark, frame, rows) == by_hand(rows) == [(1, 1, 5, 5, 1, 1, 0, 0, 2, 5), (1, 2, 5, 245, 2, 1, 1, 7, -1, -1), (1, 2, 486, 486, 1, 1, 0, 1, -1, -1)]
    assert versions(spark, frame, []) == []


def test_many_events_of_one_second_are_one_row(spark, frame):
    rows = [(1, 10, 0, 1)] * 5000 + [(1, 100, 1, 1)] * 5000
    assert versions(spark, frame, rows) == by_hand(rows)


def test_turns_as_events(spark, frame):
    rows = [(c, t) for c in range(40) for t in range(6)] + [(3, None), (None, 2), (3, 1)]
    got = late_sessions.turns_as_events(frame([(*r, "x") for r in rows], "conv_id long, turn long, text string")).collect()
    want = []
    for conv, turn in rows:
        if conv is not None and turn is not None:
            c, h = zlib.crc32(str(conv).encode()), zlib.crc32(f"{conv}:{turn}".encode())
            s = (c // 2) % 7200 + 300 * turn + h % 600
            want.append((2 * (conv // 8) + c % 2, s, s // 1800 + (h // 600 % 4 if h // 600 % 3 == 0 else 0), h))
    assert sorted(map(tuple, got)) == sorted(want)
