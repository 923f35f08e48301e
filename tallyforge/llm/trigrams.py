"""Boolean trigram conditions that any text matching a regular expression must meet.

A condition is a list of alternatives (all must hold), each a list of trigram sets of which one must be present in
full: ``[[{"aki", "kia"}]]`` asks for both trigrams, ``[[{"abc"}, {"xyz"}]]`` for either. An empty list asks for nothing.
Trigrams are lower case, and so is the text they are looked for in.
"""

from __future__ import annotations

import re
from itertools import product

from re import _constants as kinds
from re import _parser as parser

Condition = list[list[frozenset[str]]]

#: Fixed value: letters of running text, the most frequent first.
COMMON = " etaoinsrhldcumfpgwybvk"
#: Literal parts are multiplied out up to so many strings; beyond, the part counts as unknown.
MAX_STRINGS = 64


def mandatory(pattern: str) -> Condition:
    """The trigram condition of a pattern; empty if there is none, so that every text has to be read."""
    clauses: Condition = []
    for run in _runs(parser.parse(pattern)):
        sets = [frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in run]
        if sets and all(sets):
            least = [s for s in set(sets) if not any(other < s for other in sets)]
            clauses.append(sorted(least, key=sorted))
    return clauses


def selective(condition: Condition, most: int = 2) -> Condition:
    """A weaker condition of a few trigrams per alternative, those of the rarest letters; every match still meets it."""
    def commonness(gram: str) -> tuple[int, str]:
        return sum(COMMON.find(c) + 1 and len(COMMON) - COMMON.find(c) for c in gram), gram

    return [sorted({frozenset(sorted(grams, key=commonness)[:most]) for grams in clause}, key=sorted) for clause in condition]


def vocabulary(conditions: list[Condition]) -> list[str]:
    """All trigrams that some condition names."""
    return sorted({t for condition in conditions for clause in condition for grams in clause for t in grams})


def _runs(tokens) -> list[set[str]]:
    """Sets of strings, one of each of which occurs in every match: neighbouring literal parts are joined."""
    runs, run = [], {""}
    for token in tokens:
        strings = _strings(token)
        if strings is not None and len(run) * len(strings) <= MAX_STRINGS:
            run = {a + b for a, b in product(run, strings)}
            continue
        runs.append(run)
        run = {""} if strings is None or len(strings) > MAX_STRINGS else strings
        if strings is None:
            runs += _inner(token)
    return [r for r in [*runs, run] if r != {""}]


def _inner(token) -> list[set[str]]:
    """Runs inside a part that has no short list of strings but occurs at least once."""
    kind, value = token
    if kind is kinds.SUBPATTERN:
        return _runs(value[3])
    if kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT) and value[0] > 0:
        return _runs(value[2])
    return []


def _strings(token) -> set[str] | None:
    """All strings a part can be, in lower case; None if there are too many or it is not known."""
    kind, value = token
    if kind is kinds.LITERAL:
        return {chr(value).lower()}
    if kind is kinds.AT:
        return {""}
    if kind is kinds.SUBPATTERN:
        return _sequence(value[3])
    if kind is kinds.BRANCH:
        options = [_sequence(x) for x in value[1]]
        return None if any(o is None for o in options) else _few(set().union(*options))
    if kind is kinds.IN:
        found: set[str] = set()
        for what, x in value:
            if what is kinds.LITERAL:
                found.add(chr(x).lower())
            elif what is kinds.RANGE and x[1] - x[0] < 8:
                found |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None
        return found if len(found) <= 8 else None
    if kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT) and value[1] <= 4:
        once = _sequence(value[2])
        if once is None:
            return None
        options, power = set(), {""}
        for n in range(value[1] + 1):
            if n >= value[0]:
                options |= power
            power = {a + b for a, b in product(power, once)}
        return _few(options)
    return None


def _sequence(tokens) -> set[str] | None:
    joined = {""}
    for token in tokens:
        strings = _strings(token)
        if strings is None or len(joined) * len(strings) > MAX_STRINGS:
            return None
        joined = {a + b for a, b in product(joined, strings)}
    return joined


def _few(strings: set[str]) -> set[str] | None:
    return strings if len(strings) <= MAX_STRINGS else None


def holds(condition: Condition, text: str) -> bool:
    """The condition on one text; the index gives the same answer for many."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return all(any(all(t in low for t in grams) for grams in clause) for clause in condition)
