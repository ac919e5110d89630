"""A recognizer of ECMAScript (scripts and modules, with classes, async functions and optional chains)."""

from __future__ import annotations

import re

from .base import Broken, Lazy

RESERVED = frozenset("break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split())
ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
BINARY = frozenset("?? || && | ^ & == != === !== < > <= >= << >> >>> + - * / % ** instanceof in".split())
UNARY = frozenset("delete void typeof + - ~ ! ++ --".split())


class JavaScript(Lazy):
    #: Blanks and comments, with the old marks ``<!--`` anywhere and ``-->`` at the begin of a line.
    SKIP = re.compile(r"(?:[\s\ufeff]+|//[^\n\r\u2028\u2029]*|/\*.*?\*/|<!--[^\n\r\u2028\u2029]*|(?:(?<=[\n\r\u2028\u2029])|(?<=^))[ \t]*-->[^\n\r\u2028\u2029]*)*", re.S)
    TOKEN = re.compile(
        r"(?P<name>\#?(?:[^\W\d]|\$|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[\w$\u200c\u200d]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*)"
        r"|(?P<num>(?:0[xX][0-9a-fA-F_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:\d[\d_]*n|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?))(?![\w$]))"
        r"|(?P<str>\"(?:[^\"\\\n\r]|\\(?:\r\n|.))*\"|'(?:[^'\\\n\r]|\\(?:\r\n|.))*')"
        r"|(?P<tick>`)"
        r"|(?P<op>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@])",
        re.S,
    )
    REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[\w$]*")
    QUASI = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)

    def program(self) -> None:
        if self.text.startswith("#!"):
            self.pos = len(self.text.split("\n", 1)[0])
        self.generator = False
        self.asynchronous = True  # await may stand at the top of a module
        self.advance()
        while self.kind != "end":
            self.statement()

    def ident(self) -> None:
        if self.kind != "name" or self.tok in RESERVED or self.tok[0] == "#":
            raise Broken(f"identifier at {self.start}")
        self.advance()

    def semicolon(self) -> None:
        if not self.take(";") and not (self.at("}") or self.kind == "end" or self.nl):
            raise Broken(f"; at {self.start}")

    def block(self) -> None:
        self.need("{")
        while not self.at("}"):
            if self.kind == "end":
                raise Broken("open block")
            self.statement()
        self.advance()

    def parens(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def statement(self) -> None:
        tok = self.tok if self.kind in ("name", "op") else None
        handler = self.STATEMENTS.get(tok)
        if handler:
            return handler(self)
        if tok == "let":
            state = self.save()
            self.advance()
            if (self.kind == "name" and self.tok not in ("in", "instanceof", "of")) or self.at("[", "{"):
                self.declarations()
                return self.semicolon()
            self.restore(state)
        elif tok == "async":
            state = self.save()
            self.advance()
            if self.at("function") and not self.nl:
                return self.function(asynchronous=True)
            self.restore(state)
        elif tok == "import":
            state = self.save()
            self.advance()
            if not self.at("(", "."):
                return self.imports()
            self.restore(state)
        if self.kind == "name" and tok not in RESERVED:
            state = self.save()
            self.advance()
            if self.take(":"):
                return self.statement()
            self.restore(state)
        self.expression()
        self.semicolon()

    def s_empty(self) -> None:
        self.advance()

    def s_var(self) -> None:
        self.advance()
        self.declarations()
        self.semicolon()

    def declarations(self, no_in: bool = False) -> None:
        while True:
            self.binding()
            if self.take("="):
                self.assignment(no_in)
            if not self.take(","):
                return

    def binding(self) -> None:
        if self.take("["):
            while not self.take("]"):
                if self.take(","):
                    continue
                self.take("...")
                self.binding()
                if self.take("="):
                    self.assignment()
                if not self.at("]"):
                    self.need(",")
        elif self.take("{"):
            while not self.take("}"):
                if self.take("..."):
                    self.ident()
                else:
                    plain = self.kind == "name" and self.tok not in RESERVED
                    self.property_name()
                    if self.take(":"):
                        self.binding()
                    elif not plain:
                        raise Broken(f"binding at {self.start}")
                    if self.take("="):
                        self.assignment()
                if not self.at("}"):
                    self.need(",")
        else:
            self.ident()

    def s_if(self) -> None:
        self.advance()
        self.parens()
        self.statement()
        if self.take("else"):
            self.statement()

    def s_while(self) -> None:
        self.advance()
        self.parens()
        self.statement()

    def s_do(self) -> None:
        self.advance()
        self.statement()
        self.need("while")
        self.parens()
        self.take(";")

    def s_for(self) -> None:
        self.advance()
        self.take("await")
        self.need("(")
        if self.at("var", "const") or self.at("let"):
            self.advance()
            self.binding()
            if self.take("of"):
                self.assignment()
                self.need(")")
                return self.statement()
            if self.take("in"):
                self.expression()
                self.need(")")
                return self.statement()
            if self.take("="):
                self.assignment(True)
            if self.take(","):
                self.declarations(True)
        elif not self.at(";"):
            self.expression(True)
            if self.take("of"):
                self.assignment()
                self.need(")")
                return self.statement()
            if self.take("in"):
                self.expression()
                self.need(")")
                return self.statement()
        self.need(";")
        if not self.at(";"):
            self.expression()
        self.need(";")
        if not self.at(")"):
            self.expression()
        self.need(")")
        self.statement()

    def s_jump(self) -> None:
        self.advance()
        if self.kind == "name" and not self.nl and self.tok not in RESERVED:
            self.advance()
        self.semicolon()

    def s_return(self) -> None:
        self.advance()
        if not (self.at(";", "}") or self.kind == "end" or self.nl):
            self.expression()
        self.semicolon()

    def s_throw(self) -> None:
        self.advance()
        if self.nl:
            raise Broken("line end after throw")
        self.expression()
        self.semicolon()

    def s_switch(self) -> None:
        self.advance()
        self.parens()
        self.need("{")
        while not self.take("}"):
            if self.take("default"):
                pass
            else:
                self.need("case")
                self.expression()
            self.need(":")
            while not self.at("case", "default", "}"):
                if self.kind == "end":
                    raise Broken("open switch")
                self.statement()

    def s_try(self) -> None:
        self.advance()
        self.block()
        done = False
        if self.take("catch"):
            done = True
            if self.take("("):
                self.binding()
                self.need(")")
            self.block()
        if self.take("finally"):
            done = True
            self.block()
        if not done:
            raise Broken("try alone")

    def s_debugger(self) -> None:
        self.advance()
        self.semicolon()

    def function(self, asynchronous: bool = False, expression: bool = False) -> None:
        self.need("function")
        generator = self.take("*")
        if not expression or self.kind == "name":
            self.ident()
        self.rest_of_function(generator, asynchronous)

    def rest_of_function(self, generator: bool = False, asynchronous: bool = False) -> None:
        old = self.generator, self.asynchronous
        self.generator, self.asynchronous = generator, asynchronous
        self.need("(")
        while not self.take(")"):
            self.take("...")
            self.binding()
            if self.take("="):
                self.assignment()
            if not self.at(")"):
                self.need(",")
        self.block()
        self.generator, self.asynchronous = old

    def s_class(self, expression: bool = False) -> None:
        self.advance()
        if not expression or (self.kind == "name" and self.tok != "extends"):
            self.ident()
        if self.take("extends"):
            self.postfix()
        self.need("{")
        while not self.take("}"):
            if self.take(";"):
                continue
            self.member()

    def member(self) -> None:
        flags = set()
        while self.kind == "name" and self.tok in ("static", "async", "get", "set", "accessor"):
            state = self.save()
            word = self.advance()
            if word == "static" and self.at("{"):
                return self.block()
            if self.at("(", "=", ";", "}") or (self.nl and word != "static"):
                self.restore(state)
                break
            flags.add(word)
        generator = self.take("*")
        self.property_name()
        if self.at("("):
            return self.rest_of_function(generator, "async" in flags)
        if generator:
            raise Broken("field of a generator")
        if self.take("="):
            self.assignment()
        self.semicolon()

    def property_name(self) -> None:
        if self.take("["):
            self.assignment()
            self.need("]")
        elif self.kind in ("name", "str", "num"):
            self.advance()
        else:
            raise Broken(f"property at {self.start}")

    def string(self) -> None:
        if self.kind != "str":
            raise Broken(f"string at {self.start}")
        self.advance()

    def names_list(self) -> None:
        self.need("{")
        while not self.take("}"):
            if self.kind not in ("name", "str"):
                raise Broken(f"name at {self.start}")
            self.advance()
            if self.take("as"):
                if self.kind not in ("name", "str"):
                    raise Broken(f"name at {self.start}")
                self.advance()
            if not self.at("}"):
                self.need(",")

    def source_end(self) -> None:
        if self.take("with", "assert"):
            self.object_literal()
        self.semicolon()

    def imports(self) -> None:
        if self.kind == "str":
            self.advance()
            return self.source_end()
        if self.kind == "name":
            self.ident()
            if self.take(","):
                if not self.at("*", "{"):
                    raise Broken(f"import at {self.start}")
        if self.take("*"):
            self.need("as")
            self.ident()
        elif self.at("{"):
            self.names_list()
        self.need("from")
        self.string()
        self.source_end()

    def s_export(self) -> None:
        self.advance()
        if self.take("default"):
            if self.at("function"):
                return self.function(expression=True)
            if self.at("class"):
                return self.s_class(expression=True)
            self.assignment()
            return self.semicolon()
        if self.take("*"):
            if self.take("as"):
                self.advance()
            self.need("from")
            self.string()
            return self.source_end()
        if self.at("{"):
            self.names_list()
            if self.take("from"):
                self.string()
            return self.source_end()
        if not self.at("var", "let", "const", "function", "class", "async"):
            raise Broken(f"export at {self.start}")
        self.statement()

    STATEMENTS = {"{": block, ";": s_empty, "var": s_var, "const": s_var, "if": s_if, "while": s_while, "do": s_do, "for": s_for, "break": s_jump, "continue": s_jump, "return": s_return, "throw": s_throw, "switch": s_switch, "try": s_try, "debugger": s_debugger, "function": function, "class": s_class, "export": s_export, "with": s_while}

    # expressions; the kind that is returned tells what may be assigned to
    def expression(self, no_in: bool = False) -> str:
        kind = self.assignment(no_in)
        while self.take(","):
            kind = "list"
            self.assignment(no_in)
        return kind

    def arrow_body(self, asynchronous: bool = False) -> str:
        old = self.generator, self.asynchronous
        self.generator, self.asynchronous = False, asynchronous or self.asynchronous
        if self.at("{"):
            self.block()
        else:
            self.assignment()
        self.generator, self.asynchronous = old
        return "arrow"

    def assignment(self, no_in: bool = False) -> str:
        if self.kind == "name":
            if self.tok == "async":
                state = self.save()
                self.advance()
                if self.kind == "name" and not self.nl and self.tok not in RESERVED:
                    self.advance()
                    if self.take("=>"):
                        return self.arrow_body(True)
                self.restore(state)
            elif self.tok == "yield" and self.generator:
                self.advance()
                if not self.nl and not self.at(")", "]", "}", ",", ";", ":") and self.kind != "end":
                    self.take("*")
                    self.assignment(no_in)
                return "yield"
            elif self.tok not in RESERVED:
                state = self.save()
                self.advance()
                if self.at("=>") and not self.nl:
                    self.advance()
                    return self.arrow_body()
                self.restore(state)
        kind = self.binary(no_in)
        if kind == "arrow":
            return kind
        if self.kind == "op":
            if self.tok == "?":
                self.advance()
                self.assignment()
                self.need(":")
                self.assignment(no_in)
                return "other"
            if self.tok in ASSIGN:
                if kind not in ("name", "member", "pattern") or (kind == "pattern" and self.tok != "="):
                    raise Broken(f"assignment at {self.start}")
                self.advance()
                self.assignment(no_in)
                return "other"
        return kind

    def binary(self, no_in: bool) -> str:
        kind = self.unary()
        while self.tok in BINARY and self.kind in ("op", "name") and not (no_in and self.tok == "in"):
            if kind == "arrow":
                raise Broken(f"operator at {self.start}")
            self.advance()
            self.unary()
            kind = "other"
        return kind

    def unary(self) -> str:
        if (self.kind in ("op", "name") and self.tok in UNARY) or (self.kind == "name" and self.tok == "await" and self.asynchronous):
            word = self.advance()
            if word == "await" and (self.at(")", "]", "}", ",", ";", "=", "=>", ".", ":") or self.kind == "end"):
                return "name"
            kind = self.unary()
            if word in ("++", "--") and kind not in ("name", "member"):
                raise Broken(f"{word} at {self.start}")
            return "other"
        kind = self.postfix()
        if self.at("++", "--") and not self.nl:
            if kind not in ("name", "member"):
                raise Broken(f"{self.tok} at {self.start}")
            self.advance()
            return "other"
        return kind

    def arguments(self) -> None:
        self.need("(")
        while not self.take(")"):
            self.take("...")
            self.assignment()
            if not self.at(")"):
                self.need(",")

    def postfix(self) -> str:
        if self.take("new"):
            if self.take("."):
                self.need("target")
                kind = "other"
            else:
                kind = "other"
                self.postfix_of(self.primary() if not self.at("new") else self.postfix(), calls=False)
                if self.at("("):
                    self.arguments()
        else:
            kind = self.primary()
        return self.postfix_of(kind)

    def postfix_of(self, kind: str, calls: bool = True) -> str:
        if kind == "arrow":
            return kind
        while True:
            if self.kind == "tick":
                self.template()
                kind = "other"
            elif self.kind != "op":
                return kind
            elif self.tok == ".":
                self.advance()
                self.name()
                kind = "member"
            elif self.tok == "[":
                self.advance()
                self.expression()
                self.need("]")
                kind = "member"
            elif self.tok == "(" and calls:
                self.arguments()
                kind = "call"
                if self.at("=>"):
                    return kind
            elif self.tok == "?." and calls:
                self.advance()
                if self.at("("):
                    self.arguments()
                elif self.take("["):
                    self.expression()
                    self.need("]")
                elif self.kind != "tick":
                    self.name()
                kind = "other"
            else:
                return kind

    def template(self) -> None:
        while True:
            at = self.QUASI.match(self.text, self.pos).end()
            if self.text.startswith("`", at):
                self.pos = at + 1
                self.advance()
                return
            if not self.text.startswith("${", at):
                raise Broken("open template")
            self.pos = at + 2
            self.advance()
            self.expression()
            if not self.at("}"):
                raise Broken("open template")

    def primary(self) -> str:
        kind, tok = self.kind, self.tok
        if kind in ("num", "str"):
            self.advance()
            return "other"
        if kind == "tick":
            self.template()
            return "other"
        if kind == "name":
            if tok == "function":
                self.function(expression=True)
                return "other"
            if tok == "class":
                self.s_class(expression=True)
                return "other"
            if tok == "async":
                self.advance()
                if self.at("function") and not self.nl:
                    self.function(asynchronous=True, expression=True)
                    return "other"
                if self.at("(") and not self.nl:
                    return self.parenthesized(True)
                return "name"
            if tok in ("this", "null", "true", "false"):
                self.advance()
                return "other"
            if tok == "super":
                self.advance()
                if not self.at("(", ".", "["):
                    raise Broken("super alone")
                return "other"
            if tok == "import":
                self.advance()
                if self.take("."):
                    self.name()
                elif not self.at("("):
                    raise Broken("import in an expression")
                return "other"
            if tok[0] == "#":
                self.advance()
                if not self.at("in"):
                    raise Broken("private name alone")
                return "other"
            self.ident()
            return "name"
        if kind == "op":
            if tok == "(":
                return self.parenthesized(False)
            if tok == "[":
                self.advance()
                while not self.take("]"):
                    if self.take(","):
                        continue
                    self.take("...")
                    self.assignment()
                    if not self.at("]"):
                        self.need(",")
                return "pattern"
            if tok == "{":
                self.object_literal()
                return "pattern"
            if tok in ("/", "/="):
                m = self.REGEX.match(self.text, self.start)
                if not m:
                    raise Broken("open regular expression")
                self.pos = m.end()
                self.advance()
                return "other"
        raise Broken(f"operand at {self.start}")

    def parenthesized(self, call: bool) -> str:
        """A parenthesized expression, or the parameters and body of an arrow function; behind ``async`` it may be a call."""
        self.need("(")
        only_arrow, kind, many = False, "other", False
        if self.at(")"):
            only_arrow = True
        while not self.at(")"):
            if self.take("..."):
                only_arrow = True
                self.assignment() if call else self.binding()
            else:
                kind = self.assignment()
            if not self.at(")"):
                self.need(",")
                many = True
                if self.at(")"):
                    only_arrow = True
        self.advance()
        if self.at("=>") and not self.nl:
            self.advance()
            return self.arrow_body(call)
        if call:
            return "other"
        if only_arrow:
            raise Broken(f"=> at {self.start}")
        return "other" if many or kind == "pattern" else kind if kind != "arrow" else "other"

    def object_literal(self) -> None:
        self.need("{")
        while not self.take("}"):
            if self.take("..."):
                self.assignment()
            else:
                flags, plain = set(), False
                while self.kind == "name" and self.tok in ("async", "get", "set"):
                    state = self.save()
                    word = self.advance()
                    if self.at("(", ":", ",", "}", "="):
                        self.restore(state)
                        break
                    flags.add(word)
                generator = self.take("*")
                plain = self.kind == "name" and self.tok not in RESERVED
                self.property_name()
                if self.at("("):
                    self.rest_of_function(generator, "async" in flags)
                elif flags or generator:
                    raise Broken(f"method at {self.start}")
                elif self.take(":"):
                    self.assignment()
                elif not plain:
                    raise Broken(f"property at {self.start}")
                elif self.take("="):
                    self.assignment()
            if not self.at("}"):
                self.need(",")


def parse(text: str) -> None:
    JavaScript(text).program()
