"""Visual order of a line with right-to-left text, after the public bidirectional algorithm (without explicit embeddings; marks are not mirrored)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F
from pyspark.sql import types as T

STRONG = {"L", "R", "AL"}
NEUTRAL = {"B", "S", "WS", "ON"}


def _levels(text: str, base: int) -> list[int]:
    """The embedding level of each character."""
    outer = "R" if base else "L"
    kinds = [unicodedata.bidirectional(c) or "L" for c in text]
    kinds = ["ON" if k in ("LRE", "RLE", "LRO", "RLO", "PDF", "LRI", "RLI", "FSI", "PDI", "BN") else k for k in kinds]
    last, strong = outer, outer
    for i, kind in enumerate(kinds):  # marks take the kind before; digits after Arabic letters are Arabic; Arabic letters are R
        if kind == "NSM":
            kinds[i] = last
        elif kind == "EN" and strong == "AL":
            kinds[i] = "AN"
        last = kinds[i]
        if kind in STRONG:
            strong = kind
    kinds = ["R" if k == "AL" else k for k in kinds]
    for i in range(1, len(kinds) - 1):  # one separator between digits of a kind joins them
        if kinds[i] == "ES" and kinds[i - 1] == kinds[i + 1] == "EN":
            kinds[i] = "EN"
        elif kinds[i] == "CS" and kinds[i - 1] == kinds[i + 1] in ("EN", "AN"):
            kinds[i] = kinds[i - 1]
    for turn in (range(len(kinds)), range(len(kinds) - 1, -1, -1)):  # signs next to digits are digits
        before = ""
        for i in turn:
            if kinds[i] == "ET" and before == "EN":
                kinds[i] = "EN"
            before = kinds[i]
    kinds = ["ON" if k in ("ES", "ET", "CS") else k for k in kinds]
    strong = outer
    for i, kind in enumerate(kinds):  # digits after Latin letters are Latin
        if kind in ("L", "R"):
            strong = kind
        elif kind == "EN" and strong == "L":
            kinds[i] = "L"
    side = lambda k: "R" if k in ("R", "EN", "AN") else "L"
    i = 0
    while i < len(kinds):  # neutrals take the direction that both sides agree on, else that of the line
        j = i
        while j < len(kinds) and kinds[j] in NEUTRAL:
            j += 1
        if j > i:
            before, after = side(kinds[i - 1]) if i else outer, side(kinds[j]) if j < len(kinds) else outer
            kinds[i:j] = [before if before == after else outer] * (j - i)
        i = max(j, i + 1)
    rise = {"L": (0, 1), "R": (1, 0), "AN": (2, 1), "EN": (2, 1)}
    return [base + rise[k][base] for k in kinds]


def visual_order_of(text: str) -> str:
    """The characters as they stand from left to right; a text without right-to-left letters stays as it is."""
    kinds = [unicodedata.bidirectional(c) for c in text]
    if not any(k in ("R", "AL") for k in kinds):
        return text
    base = int(next(k for k in kinds if k in STRONG) != "L")
    levels = _levels(text, base)
    order = list(range(len(text)))
    for level in range(max(levels), 0, -1):  # turn round every run at a level or above, from the highest down
        i = 0
        while i < len(order):
            j = i
            while j < len(order) and levels[order[j]] >= level:
                j += 1
            order[i:j] = order[i:j][::-1]
            i = max(j, i + 1)
    return "".join(text[k] for k in order)


visual_order = F.udf(lambda s: None if s is None else visual_order_of(s), T.StringType(), useArrow=True)
