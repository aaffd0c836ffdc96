"""Linear tests for rules with gaps.

A rule like ``A.*?B`` is retried by a backtracking engine from every ``A``, which is quadratic in a text of many ``A``
without a ``B``. Whether it matches at all depends on the first ``A`` only: what follows the first one follows
every later one's gap as well. ``linear_form`` states that: the gap's characters are searched from the start of their
run for the first ``A``, which is kept (an atomic group), then for ``B``. It answers whether a pattern matches, in texts
without line feeds (normalised texts and single lines); where it matches is left to the pattern itself.

    (?<![C])(?>[C]*?A)[C]*?B        for A[C]*B, if A consists of characters of C
    (?<![C])(?>[C]*?A)(?>[C]*?B)[C]*?D        for A[C]*B[C]*D, if B does as well
    A(?![C]*?(?:P|A))        for A(?![C]*P): of the A in one run the last one decides

A form is used only if it is sure to be equal: no ``A`` may end inside another one (decided on the two automata), so
that the first is the one with the least end. Alternatives and optional parts before a gap are multiplied out. Where
``A`` holds a character outside of ``C``, gaps do not overlap and the pattern is linear as it is.
"""

from __future__ import annotations

import itertools
import re
from functools import cache
from re import _constants as sre
from re import _parser as sre_parser

# Characters that stand for all others when sets of characters are compared; a line feed does not occur.
_UNIVERSE = [c for c in map(chr, [*range(0x180), 0x1680, 0x2003, 0x2028, 0x3000, 0x4E2D, 0x1F600]) if c != "\n"]
_ALL = (1 << len(_UNIVERSE)) - 1
_CATEGORIES = {
    sre.CATEGORY_DIGIT: r"\d", sre.CATEGORY_NOT_DIGIT: r"\D", sre.CATEGORY_SPACE: r"\s", sre.CATEGORY_NOT_SPACE: r"\S",
    sre.CATEGORY_WORD: r"\w", sre.CATEGORY_NOT_WORD: r"\W"}
_PLACES = {
    sre.AT_BEGINNING: "^", sre.AT_BEGINNING_STRING: r"\A", sre.AT_BOUNDARY: r"\b", sre.AT_NON_BOUNDARY: r"\B", sre.AT_END: "$",
    sre.AT_END_STRING: r"\Z"}
_LEAVES = (sre.LITERAL, sre.NOT_LITERAL, sre.ANY, sre.IN)
_REPEATS = (sre.MAX_REPEAT, sre.MIN_REPEAT)
_MOST_FORMS = 16


class _NotSure(Exception):
    """No form is known to be equal."""


def _char(code: int) -> str:
    c = chr(code)
    return c if c.isalnum() or c in "_<>\"'`~!@%,:;=" else f"\\{c}" if " " < c <= "~" else f"\\x{code:02x}" if code < 256 else c


def _written(items) -> str:
    """The source text of parsed items, with groups that do not capture."""
    out = []
    for op, arg in items:
        if op is sre.LITERAL:
            out.append(_char(arg))
        elif op is sre.NOT_LITERAL:
            out.append(f"[^{_char(arg)}]")
        elif op is sre.ANY:
            out.append(".")
        elif op is sre.IN:
            out.append("[" + "".join(_member(*x) for x in arg) + "]")
        elif op in _REPEATS:
            low, high, inner = arg
            body = _written(inner)
            if len(inner) != 1 or inner[0][0] not in _LEAVES:
                body = f"(?:{body})"
            count = {(0, 1): "?", (0, sre.MAXREPEAT): "*", (1, sre.MAXREPEAT): "+"}.get(
                (low, high), f"{{{low},{'' if high is sre.MAXREPEAT else high}}}")
            out.append(body + count + ("?" if op is sre.MIN_REPEAT else ""))
        elif op is sre.SUBPATTERN:
            out.append(f"(?:{_written(arg[3])})")
        elif op is sre.BRANCH:
            out.append("(?:" + "|".join(_written(x) for x in arg[1]) + ")")
        elif op is sre.AT:
            out.append(_PLACES[arg])
        elif op in (sre.ASSERT, sre.ASSERT_NOT):
            out.append(f"(?{'' if arg[0] > 0 else '<'}{'=' if op is sre.ASSERT else '!'}{_written(arg[1])})")
        else:
            raise _NotSure(str(op))
    return "".join(out)


def _member(op, arg) -> str:
    if op is sre.NEGATE:
        return "^"
    if op is sre.LITERAL:
        return _char(arg) if chr(arg) not in "'\"" else chr(arg)
    if op is sre.RANGE:
        return f"{_char(arg[0])}-{_char(arg[1])}"
    return _CATEGORIES[arg]


@cache
def _charset(source: str) -> int:
    test = re.compile(source, re.IGNORECASE)
    return sum(1 << i for i, c in enumerate(_UNIVERSE) if test.fullmatch(c))


def _leaf_set(item) -> int:
    return _charset(_written([item]))


def _chars(items) -> int:
    """All characters that a match of the items may hold."""
    out = 0
    for op, arg in items:
        if op in _LEAVES:
            out |= _leaf_set((op, arg))
        elif op in _REPEATS:
            out |= _chars(arg[2])
        elif op is sre.SUBPATTERN:
            out |= _chars(arg[3])
        elif op is sre.BRANCH:
            for branch in arg[1]:
                out |= _chars(branch)
    return out


def _always_outside(items, chars: int) -> bool:
    """True if every match of the items holds a character outside of the set."""
    for op, arg in items:
        if op in _LEAVES and not _leaf_set((op, arg)) & chars:
            return True
        if op in _REPEATS and arg[0] and _always_outside(arg[2], chars):
            return True
        if op is sre.SUBPATTERN and _always_outside(arg[3], chars):
            return True
        if op is sre.BRANCH and all(_always_outside(x, chars) for x in arg[1]):
            return True
    return False


# --- no match may end inside another ----------------------------------------

def _automaton(items) -> tuple[dict[int, list[tuple[int | None, int]]], int]:
    """Edges (characters or None for no character, target) by state; states start at 0. Assertions are passed over,
    which only adds matches."""
    edges: dict[int, list] = {}
    names = itertools.count(1)

    def link(a: int, chars: int | None, b: int) -> int:
        edges.setdefault(a, []).append((chars, b))
        return b

    def build(items, at: int) -> int:
        for op, arg in items:
            if op in _LEAVES:
                at = link(at, _leaf_set((op, arg)), next(names))
            elif op in _REPEATS:
                low, high, inner = arg
                for _ in range(min(low, 3)):  # more copies of a run end where fewer do, for what is asked here
                    at = build(inner, at)
                if high is sre.MAXREPEAT:
                    at = link(at, None, next(names))
                    link(build(inner, at), None, at)
                else:
                    end = next(names)
                    for _ in range(min(high - low, 3)):
                        link(at, None, end)
                        at = build(inner, at)
                    at = link(at, None, end)
            elif op is sre.SUBPATTERN:
                at = build(arg[3], at)
            elif op is sre.BRANCH:
                end = next(names)
                for branch in arg[1]:
                    link(build(branch, at), None, end)
                at = end
            elif op not in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
                raise _NotSure(str(op))
        return at

    return edges, build(items, 0)


def _ends_are_sure(items) -> bool:
    """No match of the items ends inside another one that does not start later."""
    edges, accept = _automaton(items)

    def reach(state: int) -> set[int]:
        seen, todo = {state}, [state]
        while todo:
            for chars, to in edges.get(todo.pop(), []):
                if chars is None and to not in seen:
                    seen.add(to)
                    todo.append(to)
        return seen

    near = {s: reach(s) for s in {0, accept, *edges, *(to for out in edges.values() for _, to in out)}}
    steps = {s: [(c, to) for x in near[s] for c, to in edges.get(x, []) if c] for s in near}
    seen, todo = set(), [(0, None), (0, 0)]
    while todo:
        outer, inner = todo.pop()
        if (outer, inner) in seen:
            continue
        seen.add((outer, inner))
        if inner is not None and accept in near[inner] and steps[outer]:
            return False  # the inner match has ended, the outer one goes on
        for chars, to in steps[outer]:
            if inner is None:
                todo += [(to, None), (to, 0)]
            else:
                todo += [(to, other) for c, other in steps[inner] if c & chars]
    return accept not in near[0]


# --- forms -------------------------------------------------------------------

def _flat(items) -> list:
    """Groups without a count are opened; alternatives stay one item."""
    out = []
    for op, arg in items:
        if op is sre.SUBPATTERN and (arg[1] or arg[2]):
            raise _NotSure("flags")
        if op is sre.SUBPATTERN:
            out += _flat(arg[3])
        else:
            out.append((op, arg))
    return out


def _gap(item) -> bool:
    op, arg = item
    return op in _REPEATS and arg[1] is sre.MAXREPEAT and len(arg[2]) == 1 and arg[2][0][0] in _LEAVES


def _holds_gap(items) -> bool:
    return any(
        _gap(x) or (x[0] in _REPEATS and _holds_gap(x[1][2])) or (x[0] is sre.SUBPATTERN and _holds_gap(x[1][3]))
        or (x[0] is sre.BRANCH and any(_holds_gap(b) for b in x[1][1])) for x in items)


def _alternatives(items) -> list[list]:
    """Alternatives whose gaps should be seen are multiplied out."""
    items = _flat(items)
    for i, (op, arg) in enumerate(items):
        inner = [(op, arg)] if op is sre.BRANCH else list(arg[3]) if op is sre.SUBPATTERN else []
        wide = [b for x in inner if x[0] is sre.BRANCH for b in x[1][1] if any(_gap(y) and _leaf_set(y[1][2][0]).bit_count() > 40 for y in _flat(b))]
        if wide:
            at = next(k for k, x in enumerate(inner) if x[0] is sre.BRANCH)
            out = []
            for branch in inner[at][1][1]:
                out += _alternatives([*items[:i], *inner[:at], *branch, *inner[at + 1:], *items[i + 1:]])
            return out
    return [items]


def _wide_gap(items, at: int) -> bool:
    """A gap whose run may hold what stands before it."""
    if not _gap(items[at]):
        return False
    chars = _leaf_set(items[at][1][2][0])
    before = items[:at]
    return bool(_chars(before)) and not _always_outside(before, chars)


def _trimmed(items: list, chars: int) -> list[list]:
    """What stands before a gap, as alternatives that end in what must be there: parts that the gap can take over go,
    a run that it can take over shrinks, other optional parts are there or not."""
    items = list(items)
    while items:
        op, arg = items[-1]
        if op not in _REPEATS:
            return [items]
        low, high, inner = arg
        inside = not _chars(inner) & ~chars
        if low == 0 and inside:
            items.pop()
        elif low == 0:
            there = items[:-1] + (list(inner) if high == 1 else [(op, (1, high, inner))])
            return _trimmed(items[:-1], chars) + (_trimmed(there, chars) if high == 1 else [there])
        elif inside and high is sre.MAXREPEAT and len(inner) == 1 and inner[0][0] in _LEAVES:
            items[-1:] = [inner[0]] * low
            return [items]
        else:
            return [items]
    raise _NotSure("nothing must stand before a gap")


def _forms(items: list) -> list[str]:
    """The items as linear alternatives."""
    for at in range(len(items)):
        if _wide_gap(items, at):
            break
    else:
        return [_last_of_run(items)]
    gap = items[at][1]
    leaf = gap[2][0]
    chars, one = _leaf_set(leaf), _written([leaf])
    out = []
    for first in _trimmed(items[:at], chars):
        if _always_outside(first, chars):  # its gaps do not overlap
            rest = _written([(sre.MIN_REPEAT, gap)]) + _written(items[at + 1:])
            out.append(_written(first) + rest)
            continue
        if _chars(first) & ~chars or not _ends_are_sure(first):
            raise _NotSure("what stands before a gap")
        # Parts between gaps of the same characters are found one after the other, each at its first place.
        found, low, rest = f"(?<!{one})(?>{one}*?{_written(first)})", gap[0], items[at + 1:]
        while True:
            nxt = next((k for k, x in enumerate(rest) if _gap(x) and _leaf_set(x[1][2][0]) == chars and _chars(rest[:k])), None)
            if nxt is None or any(_gap(x) and _leaf_set(x[1][2][0]) == chars for x in rest[:nxt]):
                break
            middle = _trimmed(rest[:nxt], chars)
            if len(middle) != 1 or _chars(middle[0]) & ~chars or not _ends_are_sure(middle[0]):
                break
            found += f"(?>{one}{{{low},}}?{_written(middle[0])})"
            low, rest = rest[nxt][1][0], rest[nxt + 1:]
        out.append(found + f"{one}{{{low},}}?{_written(rest)}")
    return out


def _last_of_run(items: list) -> str:
    """``A(?![C]*P)`` so that an ``A`` looks no further than the next one."""
    if items and items[-1][0] is sre.ASSERT_NOT and items[-1][1][0] > 0:
        ahead = list(items[-1][1][1])
        if ahead and _gap(ahead[0]) and ahead[0][1][0] == 0:
            leaf, before = ahead[0][1][2][0], items[:-1]
            if not _chars(before) & ~_leaf_set(leaf):
                own = _written(before)
                return f"{own}(?!{_written([leaf])}*?(?:{_written(ahead[1:])}|{own}))"
    return _written(items)


@cache
def linear_form(pattern: str) -> str:
    """A pattern that matches the same texts without line feeds, in the dialect of the rules; the pattern itself where
    no linear form is sure."""
    parsed = sre_parser.parse(pattern, re.IGNORECASE)
    try:
        if re.search(r"\\[1-9]", pattern):
            raise _NotSure("back-reference")
        alternatives = _alternatives(list(parsed)) if parsed[0][0] is not sre.BRANCH else [
            x for branch in parsed[0][1][1] for x in _alternatives(list(branch))]
        forms = [form for items in alternatives for form in _forms(items)]
        if len(forms) > _MOST_FORMS or not any("(?>" in f or "(?!" in f for f in forms):
            return pattern
        return "|".join(f"(?:{form})" for form in forms) if len(forms) > 1 else forms[0]
    except _NotSure:
        return pattern
