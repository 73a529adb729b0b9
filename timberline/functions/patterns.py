"""Whole-term patterns, with intersections, complements and numeric ranges, as Java regular expressions.

A pattern is read into a tree of tuples: ("set", ranges), ("cat", parts),
("or", parts), ("and", parts), ("not", x) and ("many", x, least, most), where a
set's ranges are sorted pairs of code points. Intersections and complements
that end at the end of the term become look-aheads. Those with something behind
them must agree with the rest on where they end, which a look-ahead can't say:
they are turned into an automaton by derivatives and back into an expression
without them, state by state.
"""

from __future__ import annotations

import sys

LAST = sys.maxunicode
#: An automaton with more states is refused.
MAX_STATES = 500

NOTHING = ("set", ())
EMPTY = ("cat", ())
ANY = ("set", ((0, LAST),))


def _joined(ranges) -> tuple:
    """Sorted ranges that neither overlap nor touch."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return tuple(out)


def _others(ranges) -> tuple:
    """All code points outside of sorted ranges."""
    edges = [-1, *(x for r in ranges for x in r), LAST + 1]
    return tuple((low + 1, high - 1) for low, high in zip(edges[::2], edges[1::2], strict=True) if high - low > 1)


_DIGITS = _joined([(48, 57)])
_WORD = _joined([(48, 57), (65, 90), (95, 95), (97, 122)])
_SPACE = _joined([(9, 10), (13, 13), (32, 32)])
CLASSES = {"d": _DIGITS, "D": _others(_DIGITS), "w": _WORD, "W": _others(_WORD), "s": _SPACE, "S": _others(_SPACE)}


def char(c: str) -> tuple:
    return ("set", ((ord(c), ord(c)),))


def cat(*parts) -> tuple:
    flat = [q for p in parts for q in (p[1] if p[0] == "cat" else (p,))]
    return NOTHING if NOTHING in flat else flat[0] if len(flat) == 1 else ("cat", tuple(flat))


def either(*parts) -> tuple:
    flat = {q for p in parts for q in (p[1] if p[0] == "or" else (p,))} - {NOTHING}
    sets = [p for p in flat if p[0] == "set"]
    flat = (flat - {*sets}) | ({("set", _joined(r for s in sets for r in s[1]))} if sets else set())
    return NOTHING if not flat else next(iter(flat)) if len(flat) == 1 else ("or", frozenset(flat))


def both(*parts) -> tuple:
    flat = {q for p in parts for q in (p[1] if p[0] == "and" else (p,))}
    return NOTHING if NOTHING in flat else next(iter(flat)) if len(flat) == 1 else ("and", frozenset(flat))


def negated(x) -> tuple:
    return x[1] if x[0] == "not" else ("not", x)


def many(x, least: int = 0, most: int | None = None) -> tuple:
    return EMPTY if most == 0 or x == EMPTY else x if (least, most) == (1, 1) else ("many", x, least, most)


# Numbers


def _between(low: str, high: str) -> tuple:
    """Digit strings of one width, from ``low`` to ``high``."""
    if not low:
        return EMPTY
    digits = lambda a, b: ("set", ((ord(a), ord(b)),))
    if low[0] == high[0]:
        return cat(char(low[0]), _between(low[1:], high[1:]))
    rest = len(low) - 1
    parts = [cat(char(low[0]), _between(low[1:], "9" * rest)), cat(char(high[0]), _between("0" * rest, high[1:]))]
    if ord(high[0]) - ord(low[0]) > 1:
        parts.append(cat(digits(chr(ord(low[0]) + 1), chr(ord(high[0]) - 1)), many(digits("0", "9"), rest, rest)))
    return either(*parts)


def numbers(low: str, high: str) -> tuple:
    """Decimal numbers of a range. Bounds of one width ask for that width; others allow any zeros in front."""
    width = len(low) if len(low) == len(high) else 0
    a, b = sorted((int(low), int(high)))
    if width:
        return _between(str(a).zfill(width), str(b).zfill(width))
    parts = [_between(str(max(a, 10 ** (k - 1) if k > 1 else 0)), str(min(b, 10**k - 1))) for k in range(len(str(a)), len(str(b)) + 1)]
    return cat(many(char("0")), either(*parts))


# Reading


class _Reader:
    def __init__(self, pattern: str, complement: bool):
        self.text, self.at, self.complement = pattern, 0, complement

    def peek(self, of: str) -> bool:
        return self.at < len(self.text) and self.text[self.at] in of

    def take(self, c: str) -> bool:
        found = self.peek(c)
        self.at += found
        return found

    def next(self) -> str:
        if self.at >= len(self.text):
            raise ValueError("a term pattern ends too early")
        self.at += 1
        return self.text[self.at - 1]

    def until(self, end: str) -> str:
        stop = self.text.find(end, self.at)
        if stop < 0:
            raise ValueError(f"{end} is missing in a term pattern")
        found, self.at = self.text[self.at : stop], stop + 1
        return found

    def union(self) -> tuple:
        parts = [self.intersection()]
        while self.take("|"):
            parts.append(self.intersection())
        return either(*parts)

    def intersection(self) -> tuple:
        parts = [self.sequence()]
        while self.take("&"):
            parts.append(self.sequence())
        return both(*parts)

    def sequence(self) -> tuple:
        parts = []
        while self.at < len(self.text) and not self.peek(")|&"):
            parts.append(self.repeated())
        return cat(*parts)

    def repeated(self) -> tuple:
        x = self.negation()
        while self.peek("?*+{"):
            c = self.next()
            if c == "{":
                least, comma, most = self.until("}").partition(",")
                if not least.isdecimal() or (most and (not most.isdecimal() or int(most) < int(least))):
                    raise ValueError("a count in a term pattern needs numbers in order")
                x = many(x, int(least), (int(most) if most else None) if comma else int(least))
            else:
                x = many(x, *{"?": (0, 1), "*": (0, None), "+": (1, None)}[c])
        return x

    def negation(self) -> tuple:
        return negated(self.negation()) if self.complement and self.take("~") else self.single()

    def single(self) -> tuple:
        c = self.next()
        if c == "[":
            return self.characters()
        if c == "(":
            inner = EMPTY if self.peek(")") else self.union()
            if not self.take(")"):
                raise ValueError(") is missing in a term pattern")
            return inner
        if c == '"':
            return cat(*map(char, self.until('"')))
        if c == "<":
            low, dash, high = self.until(">").partition("-")
            if not dash or not low.isdecimal() or not high.isdecimal():
                raise ValueError("a numeric range in a term pattern is <low-high>")
            return numbers(low, high)
        if c == "\\":
            return self.escaped()
        return {".": ANY, "#": NOTHING, "@": many(ANY)}.get(c) or char(c)

    def escaped(self) -> tuple:
        c = self.next()
        return ("set", CLASSES[c]) if c in CLASSES else char(c)

    def characters(self) -> tuple:
        outside, ranges, first = self.take("^"), [], True
        while first or not self.peek("]"):
            first = False
            c = self.next()
            low = self.escaped() if c == "\\" else char(c)
            if self.take("-"):
                c = self.next()
                high = self.escaped() if c == "\\" else char(c)
                if len({*low[1], *high[1]}) > 2 or low[1][0][0] > high[1][0][1]:
                    raise ValueError("a range of characters in a term pattern is out of order")
                ranges.append((low[1][0][0], high[1][0][1]))
            else:
                ranges += low[1]
        self.next()
        return ("set", _others(_joined(ranges)) if outside else _joined(ranges))


def read(pattern: str, complement: bool = False) -> tuple:
    """The tree of a term pattern; ``~`` negates what follows it only with ``complement``."""
    reader = _Reader(pattern, complement)
    tree = reader.union()
    if reader.at < len(pattern):
        raise ValueError("a term pattern closes what it didn't open")
    return tree


# Automata


def empty_matches(x) -> bool:
    kind = x[0]
    if kind in ("cat", "and"):
        return all(map(empty_matches, x[1]))
    if kind == "or":
        return any(map(empty_matches, x[1]))
    return not empty_matches(x[1]) if kind == "not" else kind == "many" and (x[2] == 0 or empty_matches(x[1]))


def after(x, c: int) -> tuple:
    """What may follow the character ``c`` in a term of ``x``."""
    kind = x[0]
    if kind == "set":
        return EMPTY if any(low <= c <= high for low, high in x[1]) else NOTHING
    if kind == "cat":
        if not x[1]:
            return NOTHING
        rest = cat(*x[1][1:])
        first = cat(after(x[1][0], c), rest)
        return either(first, after(rest, c)) if empty_matches(x[1][0]) else first
    if kind == "not":
        return negated(after(x[1], c))
    if kind == "many":
        return cat(after(x[1], c), many(x[1], max(x[2] - 1, 0), None if x[3] is None else x[3] - 1))
    return (either if kind == "or" else both)(*[after(p, c) for p in x[1]])


def _edges(x) -> set[int]:
    """Code points at which some set of the tree begins or has just ended."""
    if x[0] == "set":
        return {e for low, high in x[1] for e in (low, high + 1)}
    return set().union(*map(_edges, x[1] if x[0] in ("cat", "or", "and") else (x[1],)))


def without_lookahead(x) -> tuple:
    """A tree for the same terms of sets, sequences, choices and repeats alone."""
    starts = sorted({0} | _edges(x) - {LAST + 1})
    blocks = list(zip(starts, [*(s - 1 for s in starts[1:]), LAST], strict=True))
    states, steps, todo = {x: 0}, {}, [x]
    while todo:
        state = todo.pop()
        for low, high in blocks:
            to = after(state, low)
            if to == NOTHING:
                continue
            if to not in states:
                if len(states) >= MAX_STATES:
                    raise ValueError("a term pattern needs too many states")
                states[to] = len(states)
                todo.append(to)
            key = states[state], states[to]
            steps[key] = either(steps.get(key, NOTHING), ("set", ((low, high),)))
    end = len(states)
    steps |= {(k, end): EMPTY for s, k in states.items() if empty_matches(s)}
    for gone in sorted(range(1, end), key=lambda k: sum(k in edge for edge in steps)):
        steps = _bypass(steps, gone)
    loop = steps.get((0, 0), NOTHING)
    return cat(many(loop) if loop != NOTHING else EMPTY, steps.get((0, end), NOTHING))


def _bypass(steps: dict, gone: int) -> dict:
    loop = many(steps[gone, gone]) if (gone, gone) in steps else EMPTY
    kept = {edge: x for edge, x in steps.items() if gone not in edge}
    for (a, via), first in steps.items():
        for (by, b), last in steps.items():
            if via == by == gone and a != gone != b:
                kept[a, b] = either(kept.get((a, b), NOTHING), cat(first, loop, last))
    return kept


# Writing


def _point(c: int) -> str:
    return chr(c) if c < 128 and chr(c).isalnum() else f"\\x{{{c:x}}}"


def _class(ranges) -> str:
    if ranges == ANY[1]:
        return "."
    if len(ranges) == 1 and ranges[0][0] == ranges[0][1]:
        return _point(ranges[0][0])
    return "[" + "".join(_point(a) if a == b else f"{_point(a)}-{_point(b)}" for a, b in ranges) + "]" if ranges else "(?!)"


def _java(x, ends: bool) -> str:
    """``ends`` tells that the term ends where ``x`` ends."""
    kind = x[0]
    if kind == "set":
        return _class(x[1])
    if kind == "cat":
        return "".join(_java(p, ends and i == len(x[1]) - 1) for i, p in enumerate(x[1]))
    if kind == "or":
        return "(?:" + "|".join(sorted(_java(p, ends) for p in x[1])) + ")"
    if kind == "many":
        return f"(?:{_java(x[1], False)})" + {(0, None): "*", (1, None): "+", (0, 1): "?"}.get((x[2], x[3]), f"{{{x[2]},{'' if x[3] is None else x[3]}}}")
    if not ends:
        return _java(without_lookahead(x), False)
    if kind == "not":
        return f"(?!{_java(x[1], True)}\\z).*"
    return "".join(sorted(f"(?={_java(p, True)}\\z)" for p in x[1])) + ".*"


def whole_term_pattern(pattern: str, complement: bool = False) -> str:
    """A term pattern as a Java regular expression of whole terms.

    ``.`` is any character, ``@`` any text, ``#`` matches nothing, ``"..."`` is
    literal text, ``a&b`` asks for both, ``<1-20>`` is a number of a range,
    ``\\d \\w \\s`` and their capitals are ASCII classes; ``^`` and ``$`` are plain
    characters. ``~`` is one too, unless ``complement``: then ``~a`` is any text but a.
    """
    return f"(?s)^(?:{_java(read(pattern, complement), True)})\\z"
