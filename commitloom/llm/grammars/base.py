"""What all grammars share."""

from __future__ import annotations

import re


class Broken(Exception):
    """The text breaks the grammar."""


class Lazy:
    """A parser that lexes on demand: the grammar, not the lexer, knows where an operand may stand.

    Subclasses give ``SKIP`` (blanks and comments) and ``TOKEN``; ``self.tok`` is
    the current token, ``self.kind`` the name of the group that matched and
    ``self.nl`` tells whether a line end stands before it.
    """

    SKIP: re.Pattern
    TOKEN: re.Pattern

    def __init__(self, text: str) -> None:
        self.text = text
        self.pos = 0
        self.start = 0
        self.tok: str | None = None
        self.kind = ""
        self.nl = False

    def advance(self) -> str | None:
        """Go to the next token; returns the one that was current."""
        old = self.tok
        m = self.SKIP.match(self.text, self.pos)
        gap, at = m.group(), m.end()
        self.nl = "\n" in gap or "\r" in gap or "\u2028" in gap
        self.start = at
        if at >= len(self.text):
            self.tok, self.kind, self.pos = None, "end", at
            return old
        m = self.TOKEN.match(self.text, at)
        if not m:
            raise Broken(f"character {at}")
        self.tok, self.kind, self.pos = m.group(), m.lastgroup, m.end()
        return old

    def save(self) -> tuple:
        return self.pos, self.start, self.tok, self.kind, self.nl

    def restore(self, state: tuple) -> None:
        self.pos, self.start, self.tok, self.kind, self.nl = state

    def at(self, *toks: str) -> bool:
        return self.tok in toks and self.kind in ("op", "name")

    def take(self, *toks: str) -> bool:
        if self.tok in toks and self.kind in ("op", "name"):
            self.advance()
            return True
        return False

    def need(self, *toks: str) -> None:
        if not self.take(*toks):
            raise Broken(f"{toks} at {self.start}")

    def name(self) -> str:
        if self.kind != "name":
            raise Broken(f"name at {self.start}")
        return self.advance()
