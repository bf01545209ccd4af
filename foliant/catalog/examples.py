"""Strings made from the patterns that they are to match, and card numbers with a right check sum."""

from __future__ import annotations

import random
import re
import string
from re import _parser as parser

PLAIN = string.ascii_letters + string.digits
MORE = 3  # how much longer than its least length a repeated part may be


def _one_of(members: list, draw: random.Random) -> str:
    """A character of a set, a letter or digit if it has any."""
    kinds = {"category_digit": string.digits, "category_space": " ", "category_word": PLAIN}
    chars, negated = "", False
    for kind, value in members:
        name = str(kind).lower()
        if name == "negate":
            negated = True
        elif name == "literal":
            chars += chr(value)
        elif name == "range":
            chars += "".join(map(chr, range(value[0], min(value[1], 126) + 1)))
        elif name == "category":
            chars += kinds.get(str(value).lower(), PLAIN)
    if negated:
        chars = "".join(c for c in PLAIN if c not in chars)
    good = [c for c in chars if c in PLAIN]
    return draw.choice(good or list(chars))


def _made(parsed, draw: random.Random) -> str:
    out = ""
    for kind, value in parsed:
        name = str(kind).lower()
        if name == "literal":
            out += chr(value)
        elif name in ("any", "not_literal"):
            out += draw.choice(string.ascii_lowercase)
        elif name == "in":
            out += _one_of(value, draw)
        elif name == "branch":
            out += _made(draw.choice(value[1]), draw)
        elif name == "subpattern":
            out += _made(value[3], draw)
        elif name in ("max_repeat", "min_repeat"):
            least, most, part = value
            if str(part[0][0]).lower() == "in" and str(part[0][1][0][0]).lower() == "negate":  # whatever may stand between two words
                out += " " + draw.choice(["", "".join(draw.choices(string.ascii_lowercase, k=4)) + " "])
                continue
            out += "".join(_made(part, draw) for _ in range(draw.randint(least, min(int(most), least + MORE))))
    return out


def example(pattern: str, seed: int) -> str:
    """A string that ``pattern`` matches, the same for the same seed."""
    draw, parsed = random.Random(f"{pattern}|{seed}"), parser.parse(pattern)
    for _ in range(200):
        text = _made(parsed, draw)
        if re.search(pattern, text):
            return text
    raise ValueError(f"no example found for {pattern}")


def card(seed: int, digits: int = 16, gap: str = "") -> str:
    """A number of so many digits whose last one makes the check sum right, in groups of four."""
    draw = random.Random(seed)
    body = [draw.randint(1, 9)] + [draw.randint(0, 9) for _ in range(digits - 2)]
    doubled = sum(sum(divmod(2 * d, 10)) for d in body[::-1][::2]) + sum(body[::-1][1::2])
    number = "".join(map(str, body)) + str(-doubled % 10)
    return gap.join(number[i:i + 4] for i in range(0, digits, 4))


def off_by_one(number: str) -> str:
    """The number with another last digit, so that its check sum is wrong."""
    return number[:-1] + str((int(number[-1]) + 1) % 10)
