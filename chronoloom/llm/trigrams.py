"""Boolean trigram queries of regular expressions.

A query is True (nothing is mandatory), a trigram, ("and", ...) or ("or", ...).  It holds for
every text in which the expression matches.  Text and trigrams are lower-cased (A-Z), so one
index serves both letter-sensitive and other rules.

The parser below knows what Java and Python write alike: literals, classes, groups,
alternatives, repeats, anchors and an initial (?i).  What it can't look into (look-arounds,
back references) demands nothing, which keeps a query necessary.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

Query = bool | str | tuple

#: string sets and repeats larger than this are given up for a weaker query
MAX_EXACT = 64
#: classes of more characters than this stand for any character
MAX_CLASS = 8

# Characters that an escape stands for.
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "f": "\f", "v": "\x0b", "a": "\x07", "e": "\x1b", "0": "\x00"}
# Letters of English text from frequent to rare.
_USUAL = "etaoinshrdlcumwfgypbvkjxqz"


def _lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# ---- parsing ------------------------------------------------------------------------------
# A node is ("one", characters or None for any), ("cat", nodes), ("alt", nodes),
# ("rep", node, least, most or None), ("any",) for what may be anything and ("none",) for what has no width.


class _Parser:
    def __init__(self, pattern: str):
        self.s, self.at = pattern, 0

    def peek(self) -> str:
        return self.s[self.at : self.at + 1]

    def take(self, n: int = 1) -> str:
        self.at += n
        return self.s[self.at - n : self.at]

    def alternatives(self) -> tuple:
        parts = [self.sequence()]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence(self) -> tuple:
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.repeat(self.atom()))
        return ("cat", parts)

    def repeat(self, node: tuple) -> tuple:
        while (c := self.peek()) and c in "*+?{":
            if c == "{":
                stop = self.s.find("}", self.at)
                least, comma, most = self.s[self.at + 1 : stop].partition(",")
                if stop < 0 or not (least.isdigit() and (most.isdigit() or not most)):
                    return node  # a brace that stands for itself, as the next atom
                self.at = stop + 1
                node = ("rep", node, int(least), int(most) if most else None if comma else int(least))
            else:
                self.take()
                node = ("rep", node, int(c == "+"), 1 if c == "?" else None)
            if self.peek() and self.peek() in "?+":  # lazy or possessive: the same strings at most
                self.take()
        return node

    def atom(self) -> tuple:
        c = self.take()
        if c == "(":
            return self.group()
        if c == "[":
            return ("one", self.members())
        if c == ".":
            return ("one", None)
        if c in "^$":
            return ("none",)
        if c == "\\":
            return self.escape()
        return ("one", {_lower(c)})

    def group(self) -> tuple:
        opaque = False
        if self.peek() == "?":
            self.take()
            c = self.take()
            if c in "=!":
                opaque = True
            elif c == "<" and self.peek() in "=!":
                self.take()
                opaque = True
            elif c == "P" or c == "<":
                self.at = self.s.index(">", self.at) + 1
            elif c != ":" and c != ">":  # flags for the rest of the group
                while self.peek() not in ":)":
                    self.take()
                if self.take() == ")":
                    return ("none",)
        node = self.alternatives()
        if self.take() != ")":
            raise ValueError(f"unbalanced group in {self.s!r}")
        return ("none",) if opaque else node

    def escape(self) -> tuple:
        c = self.take()
        if c in "bBAZzG":
            return ("none",)
        if c in "dDwWsShHvVR":
            return ("one", None)
        if c in "pP":
            self.at = self.s.index("}", self.at) + 1 if self.peek() == "{" else self.at + 1
            return ("one", None)
        if c.isdigit() and c != "0" or c == "k":
            return ("any",)
        return ("one", {_lower(self.character(c))})

    def character(self, c: str) -> str:
        if c == "x":
            return chr(int(self.take(2), 16))
        if c == "u":
            return chr(int(self.take(4), 16))
        return _ESCAPES.get(c, c)

    def members(self) -> set[str] | None:
        """The characters of a class; None if they are many."""
        found: set[str] = set()
        many, first = False, True
        if self.peek() == "^":
            self.take()
            many = True
        while first or self.peek() != "]":
            c, first = self.take(), False
            if not c:
                raise ValueError(f"unbalanced class in {self.s!r}")
            if c == "\\":
                c = self.take()
                if c in "dDwWsShHvVpP":
                    many = True
                    continue
                c = self.character(c)
            if self.peek() == "-" and self.s[self.at + 1 : self.at + 2] not in ("]", ""):
                self.take()
                end = self.take()
                end = self.character(self.take()) if end == "\\" else end
                if ord(end) - ord(c) > MAX_EXACT:
                    many = True
                else:
                    found |= {_lower(chr(x)) for x in range(ord(c), ord(end) + 1)}
            else:
                found.add(_lower(c))
        self.take()
        return None if many or len(found) > MAX_CLASS else found


# ---- queries ------------------------------------------------------------------------------


def both(kind: str, parts: list[Query]) -> Query:
    flat: list[Query] = []
    for p in parts:
        flat += p[1:] if isinstance(p, tuple) and p[0] == kind else [p]
    if kind == "and":
        flat = [p for p in flat if p is not True]
    elif True in flat:
        return True
    flat = sorted(dict.fromkeys(flat), key=repr)
    if kind == "or":  # a weaker alternative absorbs a stronger one
        terms = {q: set(q[1:]) if isinstance(q, tuple) and q[0] == "and" else {q} for q in flat}
        flat = [q for q in flat if not any(terms[p] < terms[q] for p in flat)]
    return True if not flat else flat[0] if len(flat) == 1 else (kind, *flat)


def _of_strings(strings: set[str]) -> Query:
    """What holds if one of the strings is in the text."""
    return both("or", [both("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in strings])


def _demand(node: tuple) -> tuple[Query, set[str] | None]:
    """The query of a node, and all strings that it matches if they are few."""
    kind = node[0]
    if kind == "none":
        return True, {""}
    if kind == "any":
        return True, None
    if kind == "one":
        return True, node[1]
    if kind == "alt":
        parts = [_demand(n) for n in node[1]]
        strings = None if any(s is None for _, s in parts) else set().union(*[s for _, s in parts])
        query = both("or", [both("and", [q, _of_strings(s)]) if s is not None else q for q, s in parts])
        return query, strings if strings is not None and len(strings) <= MAX_EXACT else None
    if kind == "cat":
        return _sequence(node[1])
    _, body, least, most = node
    query, strings = _demand(body)
    if not least:
        return True, strings | {""} if strings is not None and most == 1 else None
    if strings is None:
        return query, None
    times = min(least, MAX_EXACT)
    if len(strings) ** times * times * max(1, *map(len, strings)) > MAX_EXACT * MAX_EXACT:
        return both("and", [query, _of_strings(strings)]), None
    repeated = {"".join(p) for p in product(strings, repeat=times)}
    if least == most == times:
        return query, repeated
    return both("and", [query, _of_strings(repeated)]), None


def _sequence(nodes: list[tuple]) -> tuple[Query, set[str] | None]:
    queries: list[Query] = []
    run, exact = {""}, True  # the strings that the nodes since the last unknown one spell
    for node in nodes:
        if node[0] == "rep" and node[2] and node[2] != node[3] and (strings := _demand(node[1])[1]) is not None and len(strings) == 1 and len(run) <= MAX_EXACT:
            # at least so many of one string follow what came before, and it is the last one before what comes after
            (one,) = strings
            queries.append(_of_strings({a + one * min(node[2], MAX_EXACT) for a in run}))
            run, exact = {one}, False
            continue
        query, strings = _demand(node)
        queries.append(query)
        if strings is not None and len(run) * len(strings) <= MAX_EXACT:
            run = {a + b for a, b in product(run, strings)}
            continue
        exact = False
        queries.append(_of_strings(run))
        run = strings if strings is not None and len(strings) <= MAX_EXACT else {""}
        if strings is not None and len(strings) > MAX_EXACT:
            queries.append(_of_strings(strings))
    if exact:
        return both("and", queries), run
    return both("and", [*queries, _of_strings(run)]), None


def trigram_query(pattern: str) -> Query:
    """The query of a regular expression (the syntax that Python and Java share)."""
    parser = _Parser(pattern)
    node = parser.alternatives()
    if parser.at < len(pattern):
        raise ValueError(f"unbalanced group in {pattern!r}")
    query, strings = _demand(node)
    return query if strings is None else both("and", [query, _of_strings(strings)])


def trigrams_of(query: Query) -> set[str]:
    if isinstance(query, str):
        return {query}
    return set().union(*[trigrams_of(q) for q in query[1:]]) if isinstance(query, tuple) else set()


def holds(query: Query, text: str) -> bool:
    """Plain evaluation, for tests."""
    if isinstance(query, str):
        return query in _lower(text)
    if isinstance(query, tuple):
        return (all if query[0] == "and" else any)(holds(q, text) for q in query[1:])
    return query


def commonness(trigram: str) -> float:
    """A guess at how common a trigram is: the product of its letters' usual shares."""
    share = lambda c: 0.13 * 0.88 ** _USUAL.index(c) if c in _USUAL else 0.005
    return reduce(lambda a, c: a * share(c), trigram, 1.0)


def pivots(query: Query) -> set[str] | None:
    """Trigrams of which a text holds at least one if the query holds, the rarest such choice by :func:`commonness`; None if nothing is mandatory."""

    def cost(found: set[str]) -> tuple:
        return sum(map(commonness, found)), sorted(found)

    if isinstance(query, str):
        return {query}
    if query is True:
        return None
    found = [pivots(q) for q in query[1:]]
    if query[0] == "or":
        return None if None in found else set().union(*found)
    found = [f for f in found if f]
    return min(found, key=cost) if found else None
