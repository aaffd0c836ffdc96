"""Regular-expression dialects: rules are written for Python or JavaScript and
run on the Java engine behind ``rlike`` and ``regexp_extract``.

``python_to_java`` keeps Python's meaning of ``\\s`` (it includes U+001C..U+001F),
of ``.`` and ``$`` (only ``\\n`` ends a line: flag ``d``) and of case and word
characters (Unicode: flags ``i`` and ``U``). ``js_to_java`` keeps JavaScript's
ASCII ``\\b``.

``literal_groups`` reads off the literals a match cannot do without. They guard
the regexes with plain byte searches, see ``operators.matching``.
"""

from __future__ import annotations

import re
from re import _constants as sre
from re import _parser as sre_parser

_SEPARATORS = r"\x1c-\x1f"
_ASCII_BOUNDARY = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def _translate(pattern: str, *, spaces: bool, ascii_boundary: bool) -> str:
    out, in_class, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            token = pattern[i:i + 2]
            if token == r"\s" and spaces:
                token = r"\s" + _SEPARATORS if in_class else rf"[\s{_SEPARATORS}]"
            elif token == r"\S" and spaces and not in_class:
                token = rf"[^\s{_SEPARATORS}]"
            elif token == r"\b" and ascii_boundary and not in_class:
                token = _ASCII_BOUNDARY
            out.append(token)
            i += 2
            continue
        if in_class and c in "[&":
            out.append("\\" + c)
        else:
            out.append(c)
            if c == "[" and not in_class:
                in_class = True
                if pattern[i + 1:i + 2] == "^":
                    out.append("^")
                    i += 1
            elif c == "]" and in_class:
                in_class = False
        i += 1
    return "".join(out)


def python_to_java(pattern: str, *, ignore_case: bool = True, multiline: bool = False) -> str:
    flags = "dU" + ("i" if ignore_case else "") + ("m" if multiline else "")
    return f"(?{flags})" + _translate(pattern, spaces=True, ascii_boundary=False)


def js_to_java(pattern: str) -> str:
    return "(?di)" + _translate(pattern, spaces=False, ascii_boundary=True)


def with_prefix_group(java_pattern: str) -> str:
    """The pattern preceded by a group holding everything left of its first match."""
    flags, _, body = java_pattern.partition(")")
    # The new group comes first, so back-references move up by one.
    body = re.sub(r"\\(.)", lambda m: f"\\{int(m[1]) + 1}" if m[1] in "12345678" else m[0], body)
    return rf"{flags})^([\s\S]*?)(?:{body})"


def any_of(patterns) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def literal_groups(pattern: str) -> list[tuple[str, ...]]:
    """Groups of lower-case literals; every match contains one literal of each group."""
    return _groups(sre_parser.parse(pattern, re.IGNORECASE))


def _groups(parsed) -> list[tuple[str, ...]]:
    groups: list[tuple[str, ...]] = []
    run: list[str] = []

    def close():
        if run:
            groups.append(("".join(run),))
            run.clear()

    for op, arg in parsed:
        if op is sre.LITERAL:
            run.append(chr(arg).lower())
            continue
        if op is sre.SUBPATTERN:
            inner = arg[3]
            if all(o is sre.LITERAL for o, _ in inner):
                run.extend(chr(a).lower() for _, a in inner)
                continue
            close()
            groups.extend(_groups(inner))
        elif op is sre.BRANCH:
            close()
            best = [best_group(_groups(branch)) for branch in arg[1]]
            if all(best):
                groups.append(tuple(dict.fromkeys(word for group in best for word in group)))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
            close()
            groups.extend(_groups(arg[2]))
        else:
            close()
    close()
    return [group for group in groups if all(telling(word) for word in group)]


def telling(word: str) -> bool:
    return len(word) >= 2 or word in "|<>$\x1b\x08"


def best_group(groups):
    """The group whose shortest literal is longest, then the one with fewest literals."""
    return max(groups, key=lambda g: (min(map(len, g)), -len(g)), default=None)
