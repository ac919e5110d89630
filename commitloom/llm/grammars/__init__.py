"""Which texts obey the grammar of which language."""

from __future__ import annotations

import ast
import re
import sys
import warnings
from collections import Counter

from ...functions.jsontext import complete
from . import bash, c, go, javascript
from .base import Broken


def _python(text: str) -> None:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        ast.parse(text.removeprefix("\ufeff"))


def _json(text: str) -> None:
    if not complete(text):
        raise Broken("json")


GRAMMARS = {"python": _python, "bash": bash.parse, "javascript": javascript.parse, "c": c.parse, "go": go.parse, "json": _json}

#: The language that the last extension of a path tells.
EXTENSIONS = {"py": "python", "sh": "bash", "js": "javascript", "c": "c", "h": "c", "go": "go", "json": "json"}

#: How deep constructs may nest, and the calls that one of them may take.
MAX_NESTING, FRAMES = 50_000, 16

#: Tokens that are typical of a language; used only to rank the grammars.
MARKS = {
    "python": "def class import from elif except with self None True False lambda pass raise \"\"\"",
    "bash": "fi done then esac elif echo local export $ ${ $( #!",
    "javascript": "function const let var require => === !== typeof undefined null async await",
    "c": "#include #define #ifdef #ifndef #endif struct int void static char unsigned sizeof ->",
    "go": "package func := fmt range defer chan interface nil import",
    "json": "\":",
}
_TOKEN = re.compile(r"[A-Za-z]\w*|\":|\"\"\"|=>|[=!]==|:=|->|\$[{(]?|#!|#[a-z]+")
_MARKED: dict[str, list[str]] = {}
for _language, _tokens in MARKS.items():
    for _token in _tokens.split():
        _MARKED.setdefault(_token, []).append(_language)


def language_of(path: str | None) -> str | None:
    """The language that the last extension of a path tells, in any letter case."""
    if not path or "." not in path.rsplit("/", 1)[-1]:
        return None
    return EXTENSIONS.get(path.rsplit(".", 1)[-1].lower())


def rank(text: str) -> list[str]:
    """All languages, the likeliest by its typical tokens first."""
    score = dict.fromkeys(GRAMMARS, 0)
    for token, n in Counter(_TOKEN.findall(text)).items():
        for language in _MARKED.get(token, ()):
            score[language] += n
    return sorted(GRAMMARS, key=lambda g: -score[g])


def obeys(text: str, language: str) -> bool:
    """Whether the text obeys the grammar.

    Constructs may nest MAX_NESTING deep; what nests deeper counts as a break
    (Python's own parser stops at 200 brackets, JSON may nest without bound).
    """
    if sys.getrecursionlimit() < FRAMES * MAX_NESTING:
        sys.setrecursionlimit(FRAMES * MAX_NESTING)
    try:
        GRAMMARS[language](text)
        return True
    except (Broken, SyntaxError, RecursionError):
        return False
    except (ValueError, MemoryError):  # Python's parser: null characters, more nesting than it has room for
        if language != "python":
            raise
        return False


def parses(text: str) -> list[str]:
    """The languages whose grammar the text obeys, in ranked order."""
    return [g for g in rank(text) if obeys(text, g)]
