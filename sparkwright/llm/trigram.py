"""Boolean trigram queries for regular expressions, after Cox, "Regular Expression Matching with a Trigram Index" (2012).

A query is a set of clauses, each a set of lower-case trigrams: a text can match only if it holds all trigrams
of one clause. The empty clause means that any text can.
"""

from __future__ import annotations

import re._constants as c
import re._parser as parser

Query = frozenset[frozenset[str]]
ANY: Query = frozenset([frozenset()])
#: Strings that are followed at once, and clauses of a query; beyond, the query is loosened, never tightened.
MOST = 48


def _least(q: set[frozenset[str]]) -> Query:
    return frozenset(x for x in q if not any(y < x for y in q))


def _and(a: Query, b: Query) -> Query:
    both = _least({x | y for x in a for y in b})
    return both if len(both) <= MOST else min(a, b, key=len)


def _of_strings(strings: set[str]) -> Query:
    if any(len(s) < 3 for s in strings):
        return ANY
    return _least({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


def _chars(items: list) -> set[str] | None:
    """The lower-cased characters of a class, or None if they are many."""
    out: set[str] = set()
    for op, arg in items:
        if op is c.LITERAL:
            out.add(chr(arg).lower())
        elif op is c.RANGE and arg[1] - arg[0] < 8:
            out |= {chr(x).lower() for x in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _walk(nodes) -> tuple[set[str] | None, Query]:
    """All strings that the nodes match, if they are few, and else the query."""
    whole: set[str] | None = {""}  # all that was matched so far
    run: set[str] = {""}  # the strings just matched, not yet in the query
    query = ANY
    for op, arg in nodes:
        strings: set[str] | None = None
        inner = ANY
        if op is c.LITERAL:
            strings = {chr(arg).lower()}
        elif op is c.IN:
            strings = _chars(arg)
        elif op is c.AT:
            strings = {""}
        elif op is c.SUBPATTERN:
            strings, inner = _walk(arg[-1])
        elif op is c.BRANCH:
            parts = [_walk(x) for x in arg[1]]
            if all(s is not None for s, _ in parts):
                strings = set().union(*(s for s, _ in parts))
            else:
                inner = _least(set().union(*(_of_strings(s) if s is not None else q for s, q in parts)))
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT):
            low, high, item = arg
            s, q = _walk(item)
            if s is not None and (low, high) == (0, 1):
                strings = s | {""}
            elif s is not None and low == high:
                strings = {""}
                for _ in range(low):
                    strings = {x + y for x in strings for y in s} if len(strings) * len(s) <= MOST else None
                    if strings is None:
                        break
            elif low:
                inner = _of_strings(s) if s is not None else q
        joined = {x + y for x in run for y in strings} if strings is not None and len(run) * len(strings) <= MOST else None
        if joined is not None:
            run = joined
            whole = run if whole is not None else None
        else:
            query = _and(_and(query, _of_strings(run)), inner)
            whole, run = None, strings if strings is not None else {""}
            if strings is not None:
                query = _and(query, _of_strings(strings))
    return (whole, ANY) if whole is not None else (None, _and(query, _of_strings(run)))


def trigram_query(pattern: str) -> Query:
    strings, query = _walk(parser.parse(pattern))
    return _of_strings(strings) if strings is not None else query
