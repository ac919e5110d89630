"""A recognizer of Go, with type parameters and automatic semicolons."""

from __future__ import annotations

import re

from .base import Broken, Lazy

KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
ASSIGN = frozenset("= := += -= *= /= %= &= |= ^= <<= >>= &^=".split())
BINARY = frozenset("|| && == != < <= > >= + - | ^ * / % << >> & &^".split())
UNARY = frozenset("+ - ! ^ * & <- ~".split())


class Go(Lazy):
    SKIP = re.compile(r"(?:[ \t\r\ufeff]+|//[^\n]*)*")
    LONG = re.compile(r"/\*.*?\*/", re.S)
    TOKEN = re.compile(
        r"(?P<line>\n)"
        r"|(?P<name>[^\W\d]\w*)"
        r"|(?P<num>(?:0[xX][0-9a-fA-F_]*(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)i?(?!\w))"
        r"|(?P<str>\"(?:[^\"\\\n]|\\[^\n])*\"|`[^`]*`|'(?:[^'\\\n]|\\(?:[abfnrtv\\'\"]|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))')"
        r"|(?P<op>&\^=|<<=|>>=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[+\-*/%&|^<>=!()\[\]{},;.:~])"
    )

    def __init__(self, text: str) -> None:
        super().__init__(text)
        self.ends = False  # a line end here is a semicolon
        self.level = 0  # below 0: a brace opens the block of a statement, no literal

    def advance(self) -> str | None:
        old = self.tok
        while True:
            at = self.SKIP.match(self.text, self.pos).end()
            broke = False
            if self.text.startswith("/*", at):
                m = self.LONG.match(self.text, at)
                if not m:
                    raise Broken("open comment")
                broke = "\n" in m.group()
                self.pos = m.end()
                if not (broke and self.ends):
                    continue
            self.start = at
            if broke or at >= len(self.text):
                if self.ends:
                    self.ends = False
                    self.tok, self.kind = ";", "op"
                    self.pos = self.pos if broke else at
                    return old
                self.tok, self.kind, self.pos = None, "end", at
                return old
            m = self.TOKEN.match(self.text, at)
            if not m:
                raise Broken(f"character {at}")
            self.pos = m.end()
            if m.lastgroup == "line":
                if not self.ends:
                    continue
                self.ends = False
                self.tok, self.kind = ";", "op"
                return old
            self.tok, self.kind = m.group(), m.lastgroup
            self.ends = (self.kind == "name" and (self.tok not in KEYWORDS or self.tok in ("break", "continue", "fallthrough", "return"))) or self.kind in ("num", "str") or self.tok in ("++", "--", ")", "]", "}")
            return old

    def save(self) -> tuple:
        return super().save(), self.ends, self.level

    def restore(self, state: tuple) -> None:
        super().restore(state[0])
        self.ends, self.level = state[1:]

    def ident(self) -> None:
        if self.kind != "name" or self.tok in KEYWORDS:
            raise Broken(f"identifier at {self.start}")
        self.advance()

    def is_ident(self) -> bool:
        return self.kind == "name" and self.tok not in KEYWORDS

    def end_of(self, close: str) -> None:
        """The semicolon that ends an item, which may lack before ``close``."""
        if not self.at(close):
            self.need(";")

    def program(self) -> None:
        self.advance()
        self.need("package")
        self.ident()
        self.need(";")
        while self.take("import"):
            self.group(self.import_spec)
            self.need(";")
        while self.kind != "end":
            if self.at("func"):
                self.function()
            elif self.at("var", "const", "type"):
                self.declaration()
            else:
                raise Broken(f"declaration at {self.start}")
            if self.kind != "end":
                self.need(";")

    def group(self, spec) -> None:
        if self.take("("):
            while not self.take(")"):
                spec()
                self.end_of(")")
        else:
            spec()

    def import_spec(self) -> None:
        if self.at(".") or self.is_ident():
            self.advance()
        if self.kind != "str":
            raise Broken(f"import at {self.start}")
        self.advance()

    def declaration(self) -> None:
        self.group({"var": self.var_spec, "const": self.const_spec, "type": self.type_spec}[self.advance()])

    def idents(self) -> None:
        self.ident()
        while self.take(","):
            self.ident()

    def var_spec(self) -> None:
        self.idents()
        if not self.at("="):
            self.type()
        if self.take("="):
            self.expressions()

    def const_spec(self) -> None:
        self.idents()
        if not self.at("=", ";", ")"):
            self.type()
        if self.take("="):
            self.expressions()

    def type_spec(self) -> None:
        self.ident()
        if self.at("["):
            state = self.save()
            try:
                self.type_parameters()
                self.take("=")
                return self.type()
            except Broken:
                self.restore(state)
        self.take("=")
        self.type()

    def type_parameters(self) -> None:
        self.need("[")
        while True:
            self.idents()
            self.constraint()
            if self.take(","):
                if self.take("]"):
                    return
                continue
            self.need("]")
            return

    def constraint(self) -> None:
        while True:
            self.take("~")
            self.type()
            if not self.take("|"):
                return

    def function(self) -> None:
        self.need("func")
        if self.at("("):
            self.parameters()
        self.ident()
        if self.at("["):
            self.type_parameters()
        self.signature()
        if self.at("{"):
            self.body()

    def body(self) -> None:
        old, self.level = self.level, 0
        self.block()
        self.level = old

    def signature(self) -> None:
        self.parameters()
        if self.at("("):
            self.parameters()
        elif self.starts_type():
            self.type()

    def starts_type(self) -> bool:
        return self.is_ident() or self.at("*", "[", "map", "chan", "func", "struct", "interface", "(", "<-")

    def parameters(self) -> None:
        self.need("(")
        while not self.take(")"):
            if self.take("..."):
                self.type()
            else:
                self.type()
                if self.take("..."):
                    self.type()
                elif self.starts_type():
                    self.type()
            if not self.at(")"):
                self.need(",")

    def type(self) -> None:
        if self.is_ident():
            self.advance()
            if self.take("."):
                self.ident()
            if self.at("["):
                state = self.save()
                try:
                    self.advance()
                    self.type()
                    while self.take(","):
                        if self.at("]"):
                            break
                        self.type()
                    self.need("]")
                except Broken:
                    self.restore(state)
        elif self.take("*"):
            self.type()
        elif self.take("("):
            self.type()
            self.need(")")
        elif self.take("["):
            if not self.take("]"):
                if not self.take("..."):
                    old, self.level = self.level, 0
                    self.expression()
                    self.level = old
                self.need("]")
            self.type()
        elif self.take("map"):
            self.need("[")
            self.type()
            self.need("]")
            self.type()
        elif self.take("chan"):
            self.take("<-")
            self.type()
        elif self.take("<-"):
            self.need("chan")
            self.type()
        elif self.take("func"):
            self.signature()
        elif self.take("struct"):
            self.need("{")
            while not self.take("}"):
                self.field()
                if self.kind == "str":
                    self.advance()
                self.end_of("}")
        elif self.take("interface"):
            self.need("{")
            while not self.take("}"):
                if self.is_ident():
                    state = self.save()
                    self.advance()
                    if self.at("("):
                        self.signature()
                    else:
                        self.restore(state)
                        self.constraint()
                else:
                    self.constraint()
                self.end_of("}")
        else:
            raise Broken(f"type at {self.start}")

    def field(self) -> None:
        if self.take("*"):
            return self.type()
        state = self.save()
        self.ident()
        if self.at(";", "}", ".") or self.kind == "str":
            self.restore(state)
            return self.type()
        while self.take(","):
            self.ident()
        self.type()

    def block(self) -> None:
        self.need("{")
        self.statements()
        self.need("}")

    def statements(self) -> None:
        while not self.at("}", "case", "default"):
            if self.kind == "end":
                raise Broken("open block")
            self.statement()
            if not self.at("}", "case", "default"):
                self.need(";")

    def statement(self) -> None:
        tok = self.tok if self.kind in ("name", "op") else None
        if tok == ";":
            return
        if tok in ("var", "const", "type"):
            self.declaration()
        elif tok == "{":
            self.block()
        elif tok == "return":
            self.advance()
            if not self.at(";", "}"):
                self.expressions()
        elif tok in ("break", "continue", "goto"):
            self.advance()
            if self.is_ident():
                self.advance()
            elif tok == "goto":
                raise Broken("goto alone")
        elif tok == "fallthrough":
            self.advance()
        elif tok in ("go", "defer"):
            self.advance()
            self.expression()
        elif tok == "if":
            self.s_if()
        elif tok == "for":
            self.s_for()
        elif tok == "switch":
            self.s_switch()
        elif tok == "select":
            self.advance()
            self.cases(lambda: self.simple())
        else:
            self.simple(label=True)

    def simple(self, label: bool = False, ranges: bool = False) -> str:
        if ranges and self.take("range"):
            self.expression()
            return "range"
        many = self.expressions(types=True)
        if label and self.at(":") and not many:
            self.advance()
            if not self.at("}"):
                self.statement()
            return "label"
        if self.kind == "op":
            if self.tok in ("++", "--"):
                self.advance()
                return "step"
            if self.tok in ASSIGN:
                self.advance()
                if ranges and self.take("range"):
                    self.expression()
                    return "range"
                self.expressions(types=True)
                return "assign"
            if self.tok == "<-":
                self.advance()
                self.expression()
                return "send"
        if many:
            raise Broken(f"list at {self.start}")
        return "expression"

    def s_if(self) -> None:
        self.need("if")
        old, self.level = self.level, -1
        if not self.take(";"):
            self.simple()
            if self.take(";"):
                self.simple()
        else:
            self.simple()
        self.level = old
        self.block()
        if self.take("else"):
            if self.at("if"):
                self.s_if()
            else:
                self.block()

    def s_for(self) -> None:
        self.need("for")
        old, self.level = self.level, -1
        if not self.at("{"):
            kind = "" if self.at(";") else self.simple(ranges=True)
            if kind != "range" and self.take(";"):
                if not self.at(";"):
                    self.expression()
                self.need(";")
                if not self.at("{"):
                    self.simple()
        self.level = old
        self.block()

    def s_switch(self) -> None:
        self.need("switch")
        old, self.level = self.level, -1
        if not self.at("{"):
            if not self.at(";"):
                self.simple()
            if self.take(";") and not self.at("{"):
                self.simple()
        self.level = old
        self.cases(lambda: self.expressions(types=True))

    def cases(self, head) -> None:
        self.need("{")
        while not self.take("}"):
            if not self.take("default"):
                self.need("case")
                head()
            self.need(":")
            self.statements()

    def expressions(self, types: bool = False) -> bool:
        self.expression()
        many = False
        while self.take(","):
            many = True
            self.expression()
        return many

    def expression(self) -> None:
        self.unary()
        while self.kind == "op" and self.tok in BINARY:
            self.advance()
            self.unary()

    def unary(self) -> None:
        while self.kind == "op" and self.tok in UNARY:
            if self.tok == "<-":
                state = self.save()
                self.advance()
                if self.at("chan"):
                    self.restore(state)
                    self.type()
                    return self.suffixes(True)
                continue
            self.advance()
        self.suffixes(self.operand())

    def operand(self) -> bool:
        """Whether a composite literal may follow."""
        if self.kind in ("num", "str"):
            self.advance()
            return False
        if self.is_ident():
            self.advance()
            return True
        if self.at("("):
            self.advance()
            old, self.level = self.level, 0
            self.expression_or_type()
            self.level = old
            self.need(")")
            return False
        if self.at("func"):
            self.advance()
            self.signature()
            if self.at("{"):
                self.body()
            return False
        if self.at("[", "map", "struct", "chan", "interface"):
            self.type()
            if self.at("{"):
                self.literal()
                return False
            return True
        raise Broken(f"operand at {self.start}")

    def expression_or_type(self) -> None:
        state = self.save()
        try:
            self.expression()
            if not self.at(")", "]", ",", ":"):
                raise Broken(f"expression at {self.start}")
        except Broken:
            self.restore(state)
            self.type()

    def suffixes(self, typed: bool) -> None:
        while self.kind == "op":
            if self.tok == ".":
                self.advance()
                if self.take("("):
                    if not self.take("type"):
                        self.type()
                    self.need(")")
                    typed = False
                else:
                    self.ident()
            elif self.tok == "(":
                self.advance()
                old, self.level = self.level, 0
                while not self.take(")"):
                    self.expression_or_type()
                    self.take("...")
                    if not self.at(")"):
                        self.need(",")
                self.level = old
                typed = False
            elif self.tok == "[":
                self.advance()
                old, self.level = self.level, 0
                empty = True
                while not self.at("]"):
                    if self.take(":", ","):
                        continue
                    empty = False
                    self.expression_or_type()
                    if not self.at("]", ":", ","):
                        raise Broken(f"index at {self.start}")
                if empty and self.text[self.start - 1] == "[":
                    raise Broken(f"index at {self.start}")
                self.advance()
                self.level = old
            elif self.tok == "{" and typed and self.level >= 0:
                self.literal()
                typed = False
            else:
                return

    def literal(self) -> None:
        self.need("{")
        old, self.level = self.level, 0
        while not self.take("}"):
            self.element()
            if self.take(":"):
                self.element()
            if not self.at("}"):
                self.need(",")
        self.level = old

    def element(self) -> None:
        if self.at("{"):
            self.literal()
        else:
            self.expression()


def parse(text: str) -> None:
    Go(text).program()
