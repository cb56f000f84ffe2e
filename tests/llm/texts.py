"""Small tables with the awkward cases: nulls, empty and long texts, copies, repeated rows, odd characters."""

import random
import re

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(s):
    return s.translate({i: i + 32 for i in range(65, 91)})


def words(n, rng, letters="abcdeé"):
    return [("".join(rng.choice(letters) for _ in range(rng.randint(1, 4)))) for _ in range(n)]


def documents(seed=0, n=40):
    """(doc_id, text), shuffled."""
    rng, out = random.Random(seed), []
    base = words(120, rng)
    for i in range(n):
        kind = i % 6
        if kind == 0:
            text = " ".join(words(rng.randint(1, 80), rng))
        elif kind == 1:
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = "changed"
            text = " ".join(copy)
        elif kind == 2:
            text = " ".join(words(10, rng)) + "\n" + " ".join(base[20:70]) + ".\n" + " ".join(words(10, rng))
        elif kind == 3:
            text = " ".join(base).upper()
        elif kind == 4:
            text = ("ab " * rng.randint(1, 60)) + " 中文 😀\n\n  x"
        else:
            text = rng.choice(["", " \n ", "one", "one two three", "the end."])
        out.append((i * 3, text))
    out += [(1000, None), (1001, " ".join(base * 30)), (3, out[1][1]), (1002, "\0 a\tb")]
    rng.shuffle(out)
    return out


SCHEMA = "doc_id long, text string"
