"""Texts that every match of a regex must hold."""

from __future__ import annotations

import re

_OPS = re._constants


def required_literals(regex: str) -> list[str]:
    """Of these texts every match of ``regex`` holds at least one; empty where none can be told.

    The choice is the one whose shortest text is longest. Letters matched in either case
    count as unknown, and so do characters beyond the basic plane.
    """
    tree = re._parser.parse(regex)
    return [] if tree.state.flags & re.IGNORECASE else _required(tree)


def _required(tree) -> list[str]:
    found: list[list[str]] = []
    run = ""
    # here, as these constants do not travel to tasks by themselves
    repeats = (_OPS.MAX_REPEAT, _OPS.MIN_REPEAT, _OPS.POSSESSIVE_REPEAT)

    def close() -> None:
        nonlocal run
        if run:
            found.append([run])
        run = ""

    for op, arg in tree:
        if op is _OPS.LITERAL and arg <= 0xFFFF:
            run += chr(arg)
            continue
        if op is _OPS.AT:  # an anchor takes no room
            continue
        close()
        if op is _OPS.SUBPATTERN:
            _, on, _, inner = arg
            found.append([] if on & re.IGNORECASE else _required(inner))
        elif op is _OPS.ATOMIC_GROUP:
            found.append(_required(arg))
        elif op in repeats and arg[0] >= 1:
            found.append(_required(arg[2]))
        elif op is _OPS.BRANCH:
            each = [_required(way) for way in arg[1]]
            found.append(list(dict.fromkeys(t for way in each for t in way)) if all(each) else [])
    close()
    return max(filter(None, found), key=lambda texts: (min(map(len, texts)), -len(texts)), default=[])
