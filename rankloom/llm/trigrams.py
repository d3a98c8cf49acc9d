"""Boolean trigram queries that every match of a regular expression satisfies."""

from __future__ import annotations

from re import _constants as op
from re import _parser

#: ("all", [queries]), ("any", [queries]), ("has", trigram), or None: nothing is known.
Query = tuple | None

MAX_STRINGS = 64


def trigram_query(pattern: str) -> Query:
    """The query of a pattern over ASCII-lower-cased UTF-8 text; None where no trigram is mandatory.

    Literal runs, alternatives and small classes are expanded into sets of exact
    strings; where an element has no such set, the strings gathered so far give
    their trigrams and a new run begins.
    """
    exact, query = _sequence(list(_parser.parse(pattern)))
    return _all(query, _strings_query(exact))


def trigrams_of(query: Query) -> set[bytes]:
    if query is None:
        return set()
    return {query[1]} if query[0] == "has" else set().union(*map(trigrams_of, query[1]))


def _fold(code: int) -> bytes:
    return chr(code).encode().lower()


def _strings_query(strings: set[bytes]) -> Query:
    if any(len(s) < 3 for s in strings):
        return None
    return _any([_all(*[("has", s[i : i + 3]) for i in range(len(s) - 2)]) for s in sorted(strings)])


def _all(*queries: Query) -> Query:
    found = list(dict.fromkeys(q for q in queries if q is not None))
    return (found[0] if len(found) == 1 else ("all", tuple(found))) if found else None


def _any(queries: list[Query]) -> Query:
    found = list(dict.fromkeys(queries))
    if None in found or not found:
        return None
    return found[0] if len(found) == 1 else ("any", tuple(found))


def _sequence(items: list) -> tuple[set[bytes], Query]:
    """Strings one of which ends what was read so far, and the query of what came before."""
    strings, query = {b""}, None
    for item in items:
        choices, inner = _element(*item)
        query = _all(query, inner)
        if choices is not None and len(joined := {a + b for a in strings for b in choices}) <= MAX_STRINGS:
            strings = joined
            continue
        query = _all(query, _strings_query(strings))
        strings = choices if choices is not None and len(choices) <= MAX_STRINGS else {b""}
    return strings, query


def _element(kind, value) -> tuple[set[bytes] | None, Query]:
    """The exact strings of an element, or None and the query of what it matches."""
    if kind is op.LITERAL:
        return {_fold(value)}, None
    if kind is op.IN:
        codes: set[int] = set()
        for what, x in value:
            if what is op.LITERAL:
                codes.add(x)
            elif what is op.RANGE and x[1] - x[0] < MAX_STRINGS:
                codes |= set(range(x[0], x[1] + 1))
            else:
                return None, None
        return {_fold(c) for c in codes}, None
    if kind is op.BRANCH:
        parts = [_whole(branch) for branch in value[1]]
        if all(strings is not None for strings, _ in parts):
            return set().union(*[strings for strings, _ in parts]), None
        return None, _any([_all(query, None if strings is None else _strings_query(strings)) for strings, query in parts])
    if kind is op.SUBPATTERN:
        return _whole(value[3])
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        low, high, body = value
        strings, query = _whole(body)
        if (low, high) == (0, 1) and strings is not None:
            return strings | {b""}, None
        if low == high and strings is not None and low <= 40:
            exact = {b""}
            for _ in range(low):
                exact = {a + b for a in exact for b in strings}
                if len(exact) > MAX_STRINGS:
                    return None, None
            return exact, None
        return None, _all(query, None if strings is None else _strings_query(strings)) if low else None
    if kind is op.AT or kind in (op.ASSERT, op.ASSERT_NOT):
        return {b""}, None
    return None, None


def _whole(body) -> tuple[set[bytes] | None, Query]:
    items = list(body)
    strings: set[bytes] | None = {b""}
    for item in items:
        choices, _ = _element(*item)
        strings = None if strings is None or choices is None else {a + b for a in strings for b in choices}
        if strings is None or len(strings) > MAX_STRINGS:
            break
    else:
        return strings, None
    end, query = _sequence(items)
    return None, _all(query, _strings_query(end))
