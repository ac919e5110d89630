"""A recognizer of Bash, straight on the characters: what a character means depends on the words around it."""

from __future__ import annotations

import re

from .base import Broken

RESERVED = frozenset("if then else elif fi do done case esac while until for select in function time coproc { } ! [[ ]]".split())
ENDS = frozenset("then else elif fi do done esac }".split())
_BLANK = re.compile(r"(?:[ \t]|\\\r?\n)*")
_PLAIN = re.compile(r"[^\s;&|()<>'\"\\$`#]+")
_NAME = re.compile(r"[A-Za-z_]\w*")
_ASSIGN = re.compile(r"[A-Za-z_]\w*(?:\[[^\]\n]*\])?\+?=")
_REDIRECT = re.compile(r"(?:\d+|\{[A-Za-z_]\w*\})?(?:<<<|<<-?|<>|<&|>&|>>|>\||&>>|&>|<(?!\()|>(?!\())")


class Bash:
    def __init__(self, text: str) -> None:
        self.text = text.replace("\r\n", "\n")
        self.n = len(self.text)
        self.pos = 0
        self.heredocs: list[tuple[str, bool]] = []

    # characters
    def look(self, k: int = 0) -> str:
        at = self.pos + k
        return self.text[at] if at < self.n else ""

    def starts(self, s: str) -> bool:
        return self.text.startswith(s, self.pos)

    def blanks(self) -> None:
        self.pos = _BLANK.match(self.text, self.pos).end()
        if self.look() == "#":
            end = self.text.find("\n", self.pos)
            self.pos = self.n if end < 0 else end

    def newline(self) -> None:
        """Past a line end, and the here-documents that begin there."""
        self.pos += 1
        for mark, tabs in self.heredocs:
            while self.pos < self.n:
                end = self.text.find("\n", self.pos)
                end = self.n if end < 0 else end
                line = self.text[self.pos : end]
                self.pos = min(end + 1, self.n)
                if (line.lstrip("\t") if tabs else line) == mark:
                    break
        self.heredocs = []

    def lines(self) -> None:
        while True:
            self.blanks()
            if self.look() != "\n":
                return
            self.newline()

    def single(self) -> None:
        end = self.text.find("'", self.pos + 1)
        if end < 0:
            raise Broken("open quote")
        self.pos = end + 1

    def ansi(self) -> None:
        self.pos += 2
        while self.look() != "'":
            if self.pos >= self.n:
                raise Broken("open quote")
            self.pos += 2 if self.look() == "\\" else 1
        self.pos += 1

    def double(self) -> None:
        self.pos += 1
        while True:
            c = self.look()
            if not c:
                raise Broken("open quote")
            if c == '"':
                self.pos += 1
                return
            if c == "\\":
                self.pos += 2
            elif c == "$":
                self.dollar()
            elif c == "`":
                self.backtick()
            else:
                self.pos += 1

    def backtick(self) -> None:
        self.pos += 1
        start = self.pos
        while self.look() != "`":
            if self.pos >= self.n:
                raise Broken("open `")
            self.pos += 2 if self.look() == "\\" else 1
        inner = self.text[start : self.pos].replace("\\`", "`")
        self.pos += 1
        if inner.strip():
            Bash(inner).program()

    def arithmetic(self) -> bool:
        """Past ``((...))`` if the parentheses close so."""
        at, depth = self.pos + 2, 2
        while at < self.n and depth:
            c = self.text[at]
            if c == "(":
                depth += 1
            elif c == ")":
                depth -= 1
                if depth == 1 and not self.text.startswith("))", at):
                    return False
            elif c == "\\":
                at += 1
            elif c in "'\"":
                end = self.text.find(c, at + 1)
                if end < 0:
                    return False
                at = end
            at += 1
        if depth:
            return False
        self.pos = at
        return True

    def dollar(self) -> None:
        after = self.look(1)
        if after == "(":
            if self.look(2) == "(":
                self.pos += 1
                if self.arithmetic():
                    return
                self.pos -= 1
            self.pos += 2
            self.commands(closing=")")
            if self.look() != ")":
                raise Broken("open $(")
            self.pos += 1
        elif after == "{":
            self.pos += 2
            self.parameter()
        elif after == "[":
            end = self.text.find("]", self.pos)
            if end < 0:
                raise Broken("open $[")
            self.pos = end + 1
        elif after == "'":
            self.ansi()
        else:
            self.pos += 1

    def parameter(self) -> None:
        while True:
            c = self.look()
            if not c:
                raise Broken("open ${")
            if c == "}":
                self.pos += 1
                return
            if c == "\\":
                self.pos += 2
            elif c == "'":
                self.single()
            elif c == '"':
                self.double()
            elif c == "$" and self.look(1) in "({'":
                self.dollar()
            elif c == "`":
                self.backtick()
            else:
                self.pos += 1

    def word(self) -> str:
        """The next word, "" if there is none; quoted parts stand as they are."""
        start = self.pos
        while self.pos < self.n:
            m = _PLAIN.match(self.text, self.pos)
            if m:
                self.pos = m.end()
                continue
            c = self.look()
            if c == "'":
                self.single()
            elif c == '"':
                self.double()
            elif c == "\\":
                self.pos += 2
            elif c == "$":
                self.dollar() if self.look(1) != '"' else setattr(self, "pos", self.pos + 1)
            elif c == "`":
                self.backtick()
            elif c == "#" and self.pos > start:
                self.pos += 1
            elif c in "<>" and self.look(1) == "(":
                self.pos += 2
                self.commands(closing=")")
                if self.look() != ")":
                    raise Broken("open <(")
                self.pos += 1
            elif c == "(" and self.pos > start and self.text[self.pos - 1] in "@?*+!" and self.text[self.pos - 2 : self.pos - 1] != "$":
                self.pattern_group()
            else:
                break
        return self.text[start : self.pos]

    def pattern_group(self) -> None:
        self.pos += 1
        while self.look() != ")":
            if self.pos >= self.n or self.look() == "\n":
                raise Broken("open pattern")
            before = self.pos
            self.word()
            if self.pos == before:
                if self.look() == "(":
                    self.pattern_group()
                else:
                    self.pos += 1
        self.pos += 1

    def peek(self) -> str:
        """The next word, if it is written plainly: what may be a reserved word."""
        self.blanks()
        m = _PLAIN.match(self.text, self.pos)
        if not m:
            return ""
        after = self.text[m.end() : m.end() + 1]
        return m.group() if not after or after in " \t\r\n;&|()<>" else ""

    def take(self, *words: str) -> bool:
        if self.peek() in words:
            self.pos += len(self.peek())
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise Broken(f"{words} at {self.pos}")

    # grammar
    def program(self) -> None:
        self.commands()
        if self.pos < self.n:
            raise Broken(f"word at {self.pos}")

    def commands(self, closing: str = "", needed: bool = False) -> None:
        """A list up to a closing word or bracket, which is not consumed."""
        self.lines()
        some = False
        while self.pos < self.n and not (closing and self.look() == closing) and self.peek() not in ENDS and not self.starts(";;") and not (self.starts(";&")):
            self.and_or()
            some = True
            self.blanks()
            c = self.look()
            if c == "\n":
                self.lines()
            elif c == ";" and self.look(1) not in (";", "&"):
                self.pos += 1
                self.lines()
            elif c == "&" and self.look(1) not in ("&", ">"):
                self.pos += 1
                self.lines()
            else:
                break
        if needed and not some:
            raise Broken(f"command at {self.pos}")

    def and_or(self) -> None:
        self.pipeline()
        while True:
            self.blanks()
            if self.starts("&&") or self.starts("||"):
                self.pos += 2
                self.lines()
                self.pipeline()
            else:
                return

    def pipeline(self) -> None:
        while self.take("!", "time"):
            if self.take("-p"):
                pass
            self.blanks()
            if self.look() in ("", "\n", ";"):
                return
        self.command()
        while True:
            self.blanks()
            if self.look() == "|" and self.look(1) != "|":
                self.pos += 2 if self.look(1) == "&" else 1
                self.lines()
                self.take("!")
                self.command()
            else:
                return

    def redirect(self) -> bool:
        self.blanks()
        m = _REDIRECT.match(self.text, self.pos)
        if not m:
            return False
        op = m.group().lstrip("0123456789")
        self.pos = m.end()
        self.pos = _BLANK.match(self.text, self.pos).end()
        start = self.pos
        if not self.word():
            raise Broken(f"target at {self.pos}")
        if op.endswith(("<<", "<<-")) and not op.endswith("<<<"):
            mark = re.sub(r"\\(.)|[\"']", r"\1", self.text[start : self.pos])
            self.heredocs.append((mark, op.endswith("-")))
        return True

    def redirects(self) -> None:
        while self.redirect():
            pass

    def command(self) -> None:
        self.blanks()
        if self.look() == "(":
            if self.look(1) == "(" and self.arithmetic():
                return self.redirects()
            self.pos += 1
            self.commands(closing=")", needed=True)
            if self.look() != ")":
                raise Broken("open (")
            self.pos += 1
            return self.redirects()
        word = self.peek()
        handler = self.COMPOUND.get(word)
        if handler:
            self.pos += len(word)
            handler(self)
            return self.redirects()
        if word in ENDS or word in ("in", "]]") and word == "]]":
            raise Broken(f"{word} at {self.pos}")
        if word == "function":
            self.pos += len(word)
            self.blanks()
            if not self.word():
                raise Broken("function without a name")
            self.blanks()
            if self.look() == "(":
                self.pos += 1
                self.blanks()
                if self.look() != ")":
                    raise Broken("parameters")
                self.pos += 1
            self.lines()
            return self.body()
        if word == "coproc":
            self.pos += len(word)
            if _NAME.fullmatch(self.peek() or "") and self.peek() not in RESERVED:
                state = self.pos
                self.pos += len(self.peek())
                self.blanks()
                if self.look() in "{(":
                    return self.command()
                self.pos = state
            return self.command()
        self.simple()

    def body(self) -> None:
        self.blanks()
        if self.look() != "(" and self.peek() not in self.COMPOUND:
            raise Broken(f"body at {self.pos}")
        self.command()

    def simple(self) -> None:
        words = parts = 0
        while True:
            if self.redirect():
                parts += 1
                continue
            start = self.pos
            m = None if words else _ASSIGN.match(self.text, self.pos)
            if m:
                self.pos = m.end()
                if self.look() == "(":
                    self.array()
                else:
                    self.word()
                parts += 1
                continue
            w = self.word()
            if not w:
                if self.look() == "(" and words == 1 and parts == 0:
                    self.pos += 1
                    self.blanks()
                    if self.look() != ")":
                        raise Broken(f"( at {self.pos}")
                    self.pos += 1
                    self.lines()
                    return self.body()
                if self.look() == "(" and words and self.text[self.pos - 1] == "=":
                    self.array()  # declare -a name=(...)
                    continue
                if self.look() == "(":
                    raise Broken(f"( at {self.pos}")
                break
            if self.pos == start:
                break
            words += 1
        if not words and not parts:
            raise Broken(f"command at {self.pos}")

    def array(self) -> None:
        self.pos += 1
        while True:
            self.lines()
            if self.look() == ")":
                self.pos += 1
                return
            before = self.pos
            self.word()
            if self.pos == before:
                raise Broken(f"array at {self.pos}")

    def c_if(self) -> None:
        self.commands(needed=True)
        self.need("then")
        self.commands(needed=True)
        while self.take("elif"):
            self.commands(needed=True)
            self.need("then")
            self.commands(needed=True)
        if self.take("else"):
            self.commands(needed=True)
        self.need("fi")

    def c_while(self) -> None:
        self.commands(needed=True)
        self.group()

    def group(self) -> None:
        self.need("do")
        self.commands(needed=True)
        self.need("done")

    def c_for(self) -> None:
        self.blanks()
        if self.starts("(("):
            if not self.arithmetic():
                raise Broken("open ((")
            self.blanks()
            if self.look() == ";":
                self.pos += 1
            self.lines()
            if self.peek() == "{":
                return self.command()
            return self.group()
        if not self.word():
            raise Broken("for without a name")
        self.lines()
        if self.take("in"):
            while True:
                self.blanks()
                if not self.word():
                    break
            if self.look() not in (";", "\n"):
                raise Broken(f"list at {self.pos}")
        self.blanks()
        if self.look() == ";":
            self.pos += 1
        self.lines()
        if self.peek() == "{":
            return self.command()
        self.group()

    def c_case(self) -> None:
        self.blanks()
        if not self.word():
            raise Broken("case without a word")
        self.lines()
        self.need("in")
        self.lines()
        while not self.take("esac"):
            if self.look() == "(":
                self.pos += 1
            while True:
                self.blanks()
                if not self.word():
                    raise Broken(f"pattern at {self.pos}")
                self.blanks()
                if self.look() != "|":
                    break
                self.pos += 1
            if self.look() != ")":
                raise Broken(f"pattern at {self.pos}")
            self.pos += 1
            self.commands()
            if self.starts(";;&"):
                self.pos += 3
            elif self.starts(";;") or self.starts(";&"):
                self.pos += 2
            else:
                self.lines()
                self.need("esac")
                return
            self.lines()

    def c_brace(self) -> None:
        self.commands(needed=True)
        self.need("}")

    def c_test(self) -> None:
        depth, some, regex = 0, False, False
        while True:
            self.lines()
            if depth == 0 and self.peek() == "]]":
                if not some:
                    raise Broken("empty [[")
                self.pos += 2
                return
            c = self.look()
            if not c:
                raise Broken("open [[")
            if self.starts("&&") or self.starts("||"):
                self.pos += 2
                some = False
            elif regex:
                self.regex_word()
                regex, some = False, True
            elif c == "(":
                depth += 1
                self.pos += 1
            elif c == ")":
                depth -= 1
                if depth < 0:
                    raise Broken(f") at {self.pos}")
                self.pos += 1
            elif c in "<>":
                self.pos += 1
            elif c in ";&|":
                raise Broken(f"{c} in [[")
            else:
                w = self.word()
                if not w:
                    raise Broken(f"word at {self.pos}")
                regex = w == "=~"
                some = True

    def regex_word(self) -> None:
        depth = 0
        while self.pos < self.n:
            c = self.look()
            if c in " \t\n" and not depth:
                return
            if c == "\\":
                self.pos += 2
                continue
            if c == "'":
                self.single()
                continue
            if c == '"':
                self.double()
                continue
            if c == "$" and self.look(1) in ("{", "("):
                self.dollar()
                continue
            depth += (c == "(") - (c == ")")
            self.pos += 1

    COMPOUND = {"if": c_if, "while": c_while, "until": c_while, "for": c_for, "select": c_for, "case": c_case, "{": c_brace, "[[": c_test}


def parse(text: str) -> None:
    Bash(text).program()
