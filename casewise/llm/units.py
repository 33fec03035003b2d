"""Splits text for byte-level BPE: white-space units first, pattern pieces inside a unit.

A unit is a run of non-space characters with the single space before it, or a run of white space as
the pattern cuts it. No piece of the pattern crosses a unit, so ids of a text are the ids of its
units, and a bounded memo over units replaces most work on the next occurrence of a word.
"""

from __future__ import annotations

import re

#: Unicode White_Space, which ``\s`` means to the tokenizer libraries (fixed values).
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

_UNIT = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")

split_units = _UNIT.findall


def piece_splitter(pattern: str):
    """``pattern`` as a find-all function, with white space spelled out."""
    import regex

    spelled = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{WHITE}\\p{{L}}\\p{{N}}]")
    spelled = spelled.replace(r"(?!\S)", f"(?![^{WHITE}])").replace(r"\s", f"[{WHITE}]")
    return regex.compile(spelled).findall


class UnitMemo(dict):
    """Unit to value; computes what is missing and keeps at most ``limit`` entries.

    The first units seen stay, which keeps the frequent ones; the bound limits memory, not results.
    """

    def __init__(self, compute, limit: int = 400_000, longest: int = 48):
        super().__init__()
        self.compute, self.limit, self.longest = compute, limit, longest

    def __missing__(self, unit):
        value = self.compute(unit)
        if len(self) < self.limit and len(unit) <= self.longest:
            self[unit] = value
        return value
