"""Strict JSON of any depth: completeness, and members whose key comes again."""

from __future__ import annotations

import json
import re

_TOKEN = re.compile(r'[ \t\n\r]*(?:(?P<punct>[{}\[\]:,])|(?P<str>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(?P<other>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.+-])|true\b|false\b|null\b))', re.A)


class _Repeated(Exception):
    """An object has a key twice."""


def _pairs(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise _Repeated
    return out


def _no_constant(text: str) -> None:
    raise ValueError(text)


def _walk(text: str) -> list[tuple[int, int]] | None:
    """Without recursion: the spans of members whose key comes again in their object; None if the text is no complete strict JSON."""
    gone: list[tuple[int, int]] = []
    stack: list[tuple[bool, dict[str, int]]] = []  # of each open container: whether it is an object, and where the member of each key begins
    keys: dict[str, int] = {}
    starts: list[int] = []  # where the members of the innermost object begin, in order
    state, at, whole = "value", 0, False
    in_object = False
    saved: list[list[int]] = []
    while True:
        m = _TOKEN.match(text, at)
        if m is None:
            return gone if whole and not text[at:].strip(" \t\n\r") else None
        if whole:
            return None
        at, kind = m.end(), m.lastgroup
        tok = m[kind]
        if state in ("key", "first_key"):
            if kind == "str":
                name = json.loads(tok)
                if name in keys:
                    first = keys[name]
                    gone.append((first, next((s for s in starts if s > first), m.start(kind))))
                keys[name] = m.start(kind)
                starts.append(m.start(kind))
                state = "colon"
                continue
            if tok != "}" or state == "key":
                return None
        elif state == "colon":
            if tok != ":":
                return None
            state = "value"
            continue
        elif state in ("value", "first_value"):
            if tok == "{":
                stack.append((in_object, keys))
                saved.append(starts)
                in_object, keys, starts, state = True, {}, [], "first_key"
                continue
            if tok == "[":
                stack.append((in_object, keys))
                saved.append(starts)
                in_object, keys, starts, state = False, {}, [], "first_value"
                continue
            if kind != "punct":
                state, whole = "after", not stack
                continue
            if tok != "]" or state == "value":
                return None
        elif tok == ",":
            state = "key" if in_object else "value"
            continue
        elif tok != ("}" if in_object else "]"):
            return None
        (in_object, keys), starts = stack.pop(), saved.pop()
        state, whole = "after", not stack


def complete(text: str | bytes) -> bool | None:
    """Whether ``text`` is complete, strict JSON, of any depth and with numbers of any length; None if it is, with a repeated key."""
    try:
        json.loads(text, object_pairs_hook=_pairs, parse_constant=_no_constant, parse_int=str, parse_float=str)
        return True
    except _Repeated:
        pass
    except RecursionError:
        pass
    except ValueError:
        return False
    found = _walk(text.decode() if isinstance(text, bytes) else text)
    return False if found is None else None if found else True


def last_of_keys(text: str) -> str:
    """The text without the members whose key comes again in their object, so that of repeated keys the last counts."""
    at, out = 0, []
    for a, b in sorted(_walk(text) or []):
        if a >= at:  # not inside one that is gone already
            out.append(text[at:a])
            at = b
    return "".join([*out, text[at:]])
