"""Cheap substring tests that must hold wherever a pattern can match.

A case-insensitive regex over a long text costs far more than a few substring searches.
``literal_guards`` finds, per alternative of a pattern, a piece of text every match
contains; a scan asks for those pieces first and runs the regex only where one occurs.
"""

from __future__ import annotations

MIN_LENGTH = 2


def _close(p: str, i: int) -> int:
    """Index of the bracket that closes the group or class opened at ``i``."""
    depth, j, in_class = 0, i, False
    while j < len(p):
        c = p[j]
        if c == "\\":
            j += 2
            continue
        if in_class:
            in_class = not (c == "]" and j > start + 1)
        elif c == "[":
            in_class, start = True, j + (p[j + 1:j + 2] == "^")
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        if depth == 0 and not in_class:
            return j
        j += 1
    return len(p) - 1


def _alternatives(p: str) -> list[str]:
    out, at, i = [], 0, 0
    while i < len(p):
        if p[i] == "\\":
            i += 2
        elif p[i] in "([":
            i = _close(p, i) + 1
        elif p[i] == "|":
            out.append(p[at:i])
            i += 1
            at = i
        else:
            i += 1
    return out + [p[at:]]


def _weight(g: tuple[str, ...] | None) -> int:
    return min(map(len, g)) if g else 0


def _one(p: str) -> tuple[str, ...] | None:
    """Best guard of a pattern without top-level alternation."""
    best: tuple[str, ...] | None = None
    run = ""
    i = 0

    def keep(g):
        nonlocal best
        if _weight(g) > _weight(best):
            best = g

    while i < len(p):
        c, size, lit, inner = p[i], 1, None, None
        if c == "\\":
            nxt, size = p[i + 1], 2
            if not nxt.isalnum():
                lit = nxt
            elif nxt in "bBAZ":
                i += 2
                continue
        elif c in "^$":
            i += 1
            continue
        elif c == "(":
            end = _close(p, i)
            body, size = p[i + 1:end], end - i + 1
            if body.startswith(("?!", "?=", "?<!", "?<=")):
                i += size
                continue
            inner = body[2:] if body.startswith("?:") else body
        elif c == "[":
            size = _close(p, i) - i + 1
        elif c != ".":
            lit = c
        after = p[i + size:i + size + 1]
        optional = after in ("?", "*") or p[i + size:i + size + 2] == "{0"
        if lit is not None and not optional:
            run += lit
            if after in ("+", "{"):
                keep((run,))
                run = ""
        else:
            keep((run,) if run else None)
            run = ""
            if inner is not None and not optional:
                keep(literal_guards(inner))
        i += size
        if after in ("?", "*", "+", "{") and after:
            i = p.index("}", i) + 1 if after == "{" else i + 1
            if p[i:i + 1] in ("?", "+"):
                i += 1
    keep((run,) if run else None)
    return best


def literal_guards(pattern: str) -> tuple[str, ...] | None:
    """Lower-case pieces of which every match contains at least one; None when there are none."""
    p = pattern
    while p.startswith("(?") and p[2:3] in "imsux" and ")" in p:
        p = p[p.index(")") + 1:]
    found: list[str] = []
    for alt in _alternatives(p):
        g = _one(alt)
        if _weight(g) < MIN_LENGTH:
            return None
        found.extend(x.lower() for x in g)
    # A piece that holds another piece adds nothing.
    once = dict.fromkeys(found)
    return tuple(x for x in once if not any(y != x and y in x for y in once))


def guard_sql(pattern: str, low: str) -> str:
    """SQL test on the lower-cased text ``low``; 'true' for patterns without a guard."""
    from codecensus.functions.matching import quoted

    g = literal_guards(pattern)
    return "(" + " OR ".join(f"contains({low}, {quoted(x)})" for x in g) + ")" if g else "true"


def _trie(pieces: list[str]) -> str:
    """A pattern for the longest of the pieces that begins here, with shared beginnings written once."""
    import re

    if pieces == [""]:
        return ""
    heads: dict[str, list[str]] = {}
    for x in pieces:
        if x:
            heads.setdefault(x[0], []).append(x[1:])
    arms = [re.escape(c) + _trie(rest) for c, rest in sorted(heads.items())]
    if len(arms) > 4:
        # An alternation is tried arm by arm, so a class in front of every four rules these out at once.
        firsts = [re.escape(c) for c in sorted(heads)]
        arms = [f"(?=[{''.join(firsts[k:k + 4])}])(?:{'|'.join(arms[k:k + 4])})" for k in range(0, len(arms), 4)]
    return f"(?:{'|'.join(arms)})?" if "" in pieces else f"(?:{'|'.join(arms)})" if len(arms) > 1 else arms[0]


def pieces_sql(patterns: list[str], low: str) -> str:
    """SQL for the distinct guard pieces of all patterns that occur in the lower-cased text ``low``, found in one walk over it.

    A search for each piece reads the text as often as there are pieces. Here every place is looked at once, also inside
    other pieces, and gives the longest piece that begins there; pieces that this one begins with occur as well.
    """
    from codecensus.functions.matching import quoted

    pieces = dict.fromkeys(x for p in patterns for x in literal_guards(p) or ())
    if not pieces:
        return "cast(array() AS array<string>)"
    return f"array_distinct(regexp_extract_all({low}, {quoted('(?=(' + _trie(list(pieces)) + '))')}, 1))"


def holds_sql(pattern: str, patterns: list[str], found: str, text: str) -> str:
    """SQL test whether ``text`` holds a match of the pattern, upper or lower case, by the pieces ``found`` by ``pieces_sql``
    of all ``patterns``. Only alternatives of which a piece occurs are looked for, so a common word of one costs no search for the others."""
    from codecensus.functions.matching import quoted

    if literal_guards(pattern) is None:
        return f"{text} RLIKE {quoted('(?i)' + pattern)}"
    every = dict.fromkeys(x for p in patterns for x in literal_guards(p) or ())
    own = literal_guards(pattern)
    tests = []
    for alt in _alternatives(pattern):
        # A piece that holds another one of its pattern is not among the pieces: it is found by that one.
        g = tuple(x for x in own if any(x in y for y in literal_guards(alt)))
        met = ", ".join(quoted(x) for x in every if x.startswith(g))
        tests.append(f"(arrays_overlap({found}, array({met})) AND {text} RLIKE {quoted('(?i)' + alt)})")
    return "(" + " OR ".join(tests) + ")"
