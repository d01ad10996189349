"""Many fixed names in texts, in one pass.

An Aho-Corasick automaton over all names is built once per Python process and
run over Arrow batches, so that the time follows the texts and not the number
of names. Matches are those of an alternation of the names, the longest first:
the leftmost one is taken, of those that begin there the longest, and the search
goes on behind it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: So few names are an alternation in the JVM.
FEW = 24
FOUND = "array<struct<s: int, e: int, name: string>>"
_BUILT: dict[str, ahocorasick.Automaton | None] = {}


@dataclass(frozen=True)
class Names:
    """A register of names. border: a class of characters, such as ``[가-힣]``, that may not stand beside a match."""

    names: tuple[str, ...]
    border: str | None = None

    @staticmethod
    def of(names: list[str], border: str | None = None) -> Names:
        """Distinct names without empty ones, in the order of the alternation."""
        return Names(tuple(sorted({n for n in names if n}, key=lambda n: (-len(n), n))), border)

    def digest(self) -> str:
        return hashlib.sha256(repr((self.names, self.border)).encode("utf-8", "surrogatepass")).hexdigest()

    def automaton(self) -> ahocorasick.Automaton | None:
        """One per process and register."""
        key = self.digest()
        if key not in _BUILT:
            built = ahocorasick.Automaton() if self.names else None
            for name in self.names:
                built.add_word(name, name)
            if built is not None:
                built.make_automaton()
            _BUILT[key] = built
        return _BUILT[key]

    def matches(self, text: str | None) -> Iterator[tuple[int, int, str]]:
        """(start, end, name), places from 0."""
        built = self.automaton()
        if not text or built is None:
            return
        bars = regex.compile(self.border) if self.border else None
        longest: dict[int, str] = {}
        for last, name in built.iter(text):
            start = last + 1 - len(name)
            if bars and (start and bars.match(text[start - 1]) or last + 1 < len(text) and bars.match(text[last + 1])):
                continue
            if len(name) > len(longest.get(start, "")):
                longest[start] = name
        behind = 0
        for start in sorted(longest):
            if start >= behind:
                behind = start + len(longest[start])
                yield start, behind, longest[start]

    def pattern(self) -> str:
        """The alternation itself."""
        quoted = "|".join(r"\Q" + n.replace(r"\E", r"\E\\E\Q") + r"\E" for n in self.names)
        return f"(?<!{self.border})(?:{quoted})(?!{self.border})" if self.border else f"(?:{quoted})"


def found(text: Column | str, names: Names) -> Column:
    """array<struct<s, e, name>> of the names in a text; empty for null."""
    return F.pandas_udf(lambda texts: pd.Series([[{"s": s, "e": e, "name": n} for s, e, n in names.matches(t)] for t in texts]), FOUND)(text)


def any_found(text: Column | str, names: Names) -> Column:
    """Whether a text has any of the names; false for null."""
    if not names.names:
        return F.lit(False)
    if len(names.names) <= FEW:
        return F.coalesce((F.col(text) if isinstance(text, str) else text).rlike(names.pattern()), F.lit(False))
    return F.pandas_udf(lambda texts: pd.Series([next(names.matches(t), None) is not None for t in texts]), "boolean")(text)
