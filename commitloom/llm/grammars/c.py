"""A recognizer of C.  Which names are types is not known from one file, so a name may be either."""

from __future__ import annotations

import re

from .base import Broken, Lazy

STORAGE = frozenset("typedef extern static auto register inline const volatile restrict signed unsigned void char short int long float double _Bool _Complex _Noreturn _Thread_local _Atomic __inline __inline__ __restrict __extension__ constexpr thread_local bool".split())
KEYWORDS = STORAGE | frozenset("break case continue default do else enum for goto if return sizeof struct switch union while _Alignas _Alignof _Generic _Static_assert static_assert __attribute__ __asm__ asm".split()) - {"bool", "constexpr", "thread_local", "asm", "static_assert"}
ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>=".split())
BINARY = frozenset("|| && | ^ & == != < > <= >= << >> + - * / %".split())
UNARY = frozenset("+ - ! ~ * & ++ --".split())
DIRECTIVE = re.compile(r"[ \t]*#[ \t]*(\w*)")


CONDITION = re.compile(r"(?P<word>ifdef|ifndef|elifdef|elifndef|if|elif|else|endif)\b(?P<rest>.*)")
_DEFINED = re.compile(r"(?P<no>!?)\s*defined\s*(?:\(\s*(\w+)\s*\)|(\w+))")
KNOWN = frozenset("define undef include include_next import pragma error warning line ident embed".split())


def condition(word: str, rest: str) -> tuple[str, bool]:
    """What a conditional asks and the answer that it wants: ``#ifndef A`` and ``#if !defined(A)`` both want A not to be there."""
    rest = " ".join(re.sub(r"//.*|/\*.*?\*/", " ", rest).split())
    if word.endswith("def"):
        return rest, not word.endswith("ndef")
    m = _DEFINED.fullmatch(rest)
    return (m[2] or m[3], not m["no"]) if m else (rest, True)


def branches(text: str) -> tuple[list[tuple[str, int]], list[tuple[int, int, str, bool, int]]]:
    """Lines outside directives, each with the number of its innermost branch (0 for none), and the branches."""
    text = re.sub(r"\\[ \t]*\r?\n", "  ", text.replace("\r\n", "\n").replace("\r", "\n"))
    out: list[tuple[str, int]] = []
    parts: list[tuple[int, int, str, bool, int]] = [(0, 0, "", True, 0)]  # of each branch: branch around it, its conditional, question, answer wanted, place
    stack: list[list[int]] = []  # conditional, place, branch around it, whether #else was there
    conditionals, comment, here = 0, False, 0
    for line in text.split("\n"):
        m = None if comment else DIRECTIVE.match(line)
        if not m:
            comment = _in_comment(line, comment)
            out.append((line, here))
            continue
        word, tail = m.group(1), line[m.end() :]
        if word in ("if", "ifdef", "ifndef"):
            conditionals += 1
            parts.append((here, conditionals, *condition(word, tail), 0))
            stack.append([conditionals, 0, here, 0])
            here = len(parts) - 1
        elif word in ("else", "elif", "elifdef", "elifndef"):
            if not stack or stack[-1][3]:
                raise Broken(f"#{word} without #if")
            top = stack[-1]
            top[1] += 1
            top[3] = int(word == "else")
            parts.append((top[2], top[0], *(("", True) if word == "else" else condition(word[2:] if word != "elif" else "if", tail)), top[1]))
            here = len(parts) - 1
        elif word == "endif":
            if not stack:
                raise Broken("#endif without #if")
            here = stack.pop()[2]
        elif word and word not in KNOWN:
            raise Broken(f"#{word}")
        comment = tail.rfind("/*") > tail.rfind("*/") and _in_comment(tail, False)
        if comment:
            out.append(("/*", here))
    if stack:
        raise Broken("open #if")
    return out, parts


#: Questions of conditionals whose answer is known.
ANSWERS = {"0": False, "1": True, "false": False, "true": True, "__cplusplus": False, "__OBJC__": False}


def readings(text: str) -> list[str]:
    """The text as the compiler may see it, without directives, once for every way to answer the conditionals that reads something new.

    All questions answered yes, then all answered no, then one reading for each
    place of ``#elif`` that neither reads.  Branches that no answer reaches
    (``#if 0``, ``#ifdef __cplusplus``) are in none.
    """
    lines, parts = branches(text)
    if len(parts) == 1:
        return ["\n".join(line for line, _ in lines)]
    chains: dict[int, list[int]] = {}
    for i, part in enumerate(parts[1:], 1):
        chains.setdefault(part[1], []).append(i)
    sure = {i for i in range(1, len(parts)) if ANSWERS.get(parts[i][2]) == parts[i][3] or not parts[i][2]}
    never = {i for chain in chains.values() for n, i in enumerate(chain) if sure.intersection(chain[:n]) or ANSWERS.get(parts[i][2], parts[i][3]) != parts[i][3]}
    seen: set[int] = set()

    def reading(answer: bool, forced: int) -> str | None:
        live = {0}
        for chain in chains.values():
            chosen = None
            wanted = [i for i in chain if parts[i][4] == forced and i not in seen and i not in never] if forced else []
            for i in wanted or chain:
                question, want = parts[i][2], parts[i][3]
                if wanted or question == "" or ANSWERS.get(question, answer) == want:
                    chosen = i
                    break
            if chosen is not None and parts[chosen][0] in live:
                live.add(chosen)
        if live <= seen and seen:
            return None
        seen.update(live)
        return "\n".join(line for line, where in lines if where in live)

    found = [reading(True, 0), reading(False, 0)]
    found += [reading(False, k) for k in range(1, max(map(len, chains.values())))]
    return [t for t in found if t is not None]


_PIECE = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|//.*|/\*|\*/")


def _in_comment(line: str, inside: bool) -> bool:
    at = 0
    while True:
        if inside:
            at = line.find("*/", at)
            if at < 0:
                return True
            inside, at = False, at + 2
        m = _PIECE.search(line, at)
        if not m:
            return False
        at = m.end()
        if m.group() == "/*":
            inside = True


class C(Lazy):
    SKIP = re.compile(r"(?:\s+|//[^\n]*|/\*.*?\*/)*", re.S)
    TOKEN = re.compile(
        r"(?P<str>(?:u8|[uUL])?\"(?:[^\"\\\n]|\\.)*\"|(?:[uUL]|u8)?'(?:[^'\\\n]|\\.)+')"
        r"|(?P<name>(?:[^\W\d]|\$)[\w$]*)"
        r"|(?P<num>(?:0[xX][0-9a-fA-F']*\.?[0-9a-fA-F']*(?:[pP][+-]?\d+)?|0[bB][01']+|(?:\d[\d']*\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)(?:[uUlLfFzZ]*)(?![\w.]))"
        r"|(?P<op>\.\.\.|<<=|>>=|->|\+\+|--|<<|>>|<=|>=|==|!=|&&|\|\||\+=|-=|\*=|/=|%=|&=|\|=|\^=|::|[{}()\[\];,<>+\-*/%&|^!~?:=.])"
    )

    def program(self) -> None:
        self.no_cast: set[int] = set()
        self.advance()
        while self.kind != "end":
            if not self.take(";"):
                self.external()

    def ident(self) -> None:
        if self.kind != "name" or self.tok in KEYWORDS:
            raise Broken(f"identifier at {self.start}")
        self.advance()

    def is_ident(self) -> bool:
        return self.kind == "name" and self.tok not in KEYWORDS

    def attributes(self) -> None:
        while self.at("__attribute__", "__asm__", "asm", "_Alignas", "__declspec"):
            self.advance()
            self.take("volatile")
            self.balanced()
        while self.at("["):
            state = self.save()
            self.advance()
            if not self.at("["):
                return self.restore(state)
            self.restore(state)
            self.balanced("[", "]")

    def balanced(self, a: str = "(", b: str = ")") -> None:
        self.need(a)
        depth = 1
        while depth:
            if self.kind == "end":
                raise Broken("open bracket")
            if self.kind == "op":
                depth += (self.tok == a) - (self.tok == b)
            self.advance()

    def specifiers(self, top: bool = False) -> bool:
        """Declaration specifiers; whether there are any."""
        seen_type = any_ = False
        while True:
            self.attributes()
            if self.kind != "name":
                return any_
            if self.at("struct", "union", "enum"):
                word = self.advance()
                self.attributes()
                named = self.is_ident()
                if named:
                    self.advance()
                if word == "enum" and self.take(":"):
                    self.specifiers()
                if self.at("{"):
                    self.enumerators() if word == "enum" else self.members()
                elif not named:
                    raise Broken(f"tag at {self.start}")
                seen_type = any_ = True
            elif self.at("typeof", "__typeof__", "_Atomic") and self.ahead() == "(":
                self.advance()
                self.balanced()
                seen_type = any_ = True
            elif self.tok in STORAGE:
                seen_type |= self.tok not in ("typedef", "extern", "static", "auto", "register", "inline", "const", "volatile", "restrict", "__inline", "__inline__", "__restrict", "__extension__", "_Noreturn", "_Thread_local")
                any_ = True
                self.advance()
            elif self.is_ident() and not seen_type:
                # a name is a type here if another name, a star or a declarator in parentheses follows
                after = self.ahead()
                if after is not None and (after == "*" or after[0].isalpha() or after[0] == "_" or (after == "(" and any_) or (any_ and after in (",", ")") and not top)):
                    seen_type = any_ = True
                    self.advance()
                else:
                    return any_
            else:
                return any_

    def ahead(self) -> str | None:
        state = self.save()
        self.advance()
        tok = self.tok
        self.restore(state)
        return tok

    def enumerators(self) -> None:
        self.need("{")
        if self.at("}"):
            raise Broken("empty enum")
        while not self.take("}"):
            self.ident()
            self.attributes()
            if self.take("="):
                self.conditional()
            if not self.at("}"):
                self.need(",")

    def members(self) -> None:
        self.need("{")
        while not self.take("}"):
            if self.take(";"):
                continue
            if self.at("_Static_assert", "static_assert"):
                self.advance()
                self.balanced()
                self.need(";")
                continue
            if not self.specifiers():
                raise Broken(f"member at {self.start}")
            while not self.at(";"):
                if not self.at(":"):
                    self.declarator()
                if self.take(":"):
                    self.conditional()
                self.attributes()
                if not self.at(";"):
                    self.need(",")
            self.advance()

    def declarator(self, abstract: bool = False) -> bool:
        """Whether it ends with a parameter list."""
        while self.take("*", "^"):
            while self.at("const", "volatile", "restrict", "__restrict", "_Atomic"):
                self.advance()
        self.attributes()
        if self.is_ident():
            self.advance()
        elif self.at("("):
            state = self.save()
            self.advance()
            if abstract and (self.at(")") or self.starts_declaration()):
                self.restore(state)
            else:
                self.declarator(abstract)
                self.need(")")
        elif not abstract:
            raise Broken(f"declarator at {self.start}")
        call = False
        while True:
            self.attributes()
            if self.take("["):
                while self.at("static", "const", "volatile", "restrict"):
                    self.advance()
                if not self.take("]"):
                    if self.at("*") and self.ahead() == "]":
                        self.advance()
                    else:
                        self.assignment()
                    self.need("]")
            elif self.at("("):
                self.parameters()
                call = True
            else:
                return call

    def parameters(self) -> None:
        self.need("(")
        if self.take(")"):
            return
        while True:
            if self.take("..."):
                self.need(")")
                return
            if not self.specifiers() and not self.is_ident():
                raise Broken(f"parameter at {self.start}")
            self.declarator(abstract=True)
            if self.take(")"):
                return
            self.need(",")

    def external(self) -> None:
        if self.at("_Static_assert", "static_assert", "__asm__", "asm"):
            self.advance()
            self.balanced()
            return self.need(";")
        any_ = self.specifiers(top=True)
        if any_ and self.take(";"):
            return
        if not any_ and not self.is_ident():
            raise Broken(f"declaration at {self.start}")
        first = True
        while True:
            call = self.declarator()
            self.attributes()
            if first and call and not self.at(";", ",", "="):
                if self.at("{"):
                    return self.block()
                if not any_:
                    return  # a macro that stands like a call
                while not self.at("{"):  # parameters declared in the old style
                    if not self.specifiers():
                        raise Broken(f"function at {self.start}")
                    self.declarators()
                return self.block()
            if not any_ and not call:
                raise Broken(f"declaration at {self.start}")
            first = False
            if self.take("="):
                self.initializer()
            if self.take(";"):
                return
            self.need(",")

    def declarators(self) -> None:
        while not self.take(";"):
            self.declarator()
            self.attributes()
            if self.take("="):
                self.initializer()
            if not self.at(";"):
                self.need(",")
                if self.at(";"):
                    raise Broken(f"declarator at {self.start}")

    def initializer(self) -> None:
        if not self.at("{"):
            return self.assignment()
        self.advance()
        while not self.take("}"):
            marked = False
            while self.at(".", "["):
                marked = True
                if self.take("."):
                    self.ident()
                else:
                    self.advance()
                    self.conditional()
                    if self.take("..."):
                        self.conditional()
                    self.need("]")
            if marked:
                self.need("=")
            self.initializer()
            if not self.at("}"):
                self.need(",")

    def starts_declaration(self) -> bool:
        if self.kind != "name":
            return False
        if self.tok in STORAGE or self.tok in ("struct", "union", "enum", "typeof", "__typeof__"):
            return True
        if not self.is_ident():
            return False
        state = self.save()
        self.advance()
        sure = self.is_ident()
        if not sure and self.at("*"):
            while self.take("*"):
                pass
            if self.is_ident():
                self.advance()
                sure = self.at(";", "=", ",", "[", ")")
            else:
                sure = self.at(")")
        self.restore(state)
        return sure

    def block(self) -> None:
        self.need("{")
        while not self.take("}"):
            if self.kind == "end":
                raise Broken("open block")
            if self.starts_declaration():
                self.local()
            else:
                self.statement()

    def local(self) -> None:
        if not self.specifiers():
            raise Broken(f"declaration at {self.start}")
        self.declarators()

    def parens(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def statement(self) -> None:
        tok = self.tok if self.kind in ("name", "op") else None
        if tok == "{":
            self.block()
        elif tok == ";":
            self.advance()
        elif tok == "if":
            self.advance()
            self.parens()
            self.statement()
            if self.take("else"):
                self.statement()
        elif tok in ("while", "switch"):
            self.advance()
            self.parens()
            self.statement()
        elif tok == "do":
            self.advance()
            self.statement()
            self.need("while")
            self.parens()
            self.need(";")
        elif tok == "for":
            self.advance()
            self.need("(")
            if self.starts_declaration():
                self.local()
            else:
                if not self.at(";"):
                    self.expression()
                self.need(";")
            if not self.at(";"):
                self.expression()
            self.need(";")
            if not self.at(")"):
                self.expression()
            self.need(")")
            self.statement()
        elif tok in ("break", "continue"):
            self.advance()
            self.need(";")
        elif tok == "goto":
            self.advance()
            if self.at("*"):
                self.expression()
            else:
                self.ident()
            self.need(";")
        elif tok == "return":
            self.advance()
            if not self.at(";"):
                self.expression()
            self.need(";")
        elif tok == "case":
            self.advance()
            self.conditional()
            if self.take("..."):
                self.conditional()
            self.need(":")
            self.labelled()
        elif tok == "default":
            self.advance()
            self.need(":")
            self.labelled()
        elif tok in ("__asm__", "asm"):
            self.attributes()
            self.need(";")
        elif tok in ("_Static_assert", "static_assert"):
            self.advance()
            self.balanced()
            self.need(";")
        else:
            if self.is_ident() and self.ahead() == ":":
                self.advance()
                self.advance()
                return self.labelled()
            self.expression()
            if self.at("{"):  # a macro that loops
                return self.block()
            self.need(";")

    def labelled(self) -> None:
        if self.at("}"):
            return
        if self.starts_declaration():
            self.local()
        else:
            self.statement()

    def expression(self) -> None:
        self.assignment()
        while self.take(","):
            self.assignment()

    def assignment(self) -> None:
        self.conditional()
        while self.kind == "op" and self.tok in ASSIGN:
            self.advance()
            self.conditional() if not self.at("{") else self.initializer()

    def conditional(self) -> None:
        self.unary()
        while self.kind == "op" and self.tok in BINARY:
            self.advance()
            self.unary()
        if self.take("?"):
            if not self.at(":"):
                self.expression()
            self.need(":")
            self.conditional()

    def type_name(self) -> None:
        if not self.specifiers() and not self.is_ident():
            raise Broken(f"type at {self.start}")
        if self.is_ident():
            self.advance()
        self.declarator(abstract=True)

    def unary(self) -> None:
        while self.kind == "op" and self.tok in UNARY or self.at("&&"):
            self.advance()
        if self.at("sizeof", "_Alignof", "alignof", "__alignof__"):
            self.advance()
            if self.at("("):
                state = self.save()
                try:
                    self.parens()
                    return self.suffixes()
                except Broken:
                    self.restore(state)
                self.advance()
                self.type_name()
                self.need(")")
                if self.at("{"):
                    self.initializer()
                return
            return self.unary()
        if self.at("("):
            state = self.save()
            self.advance()
            if self.at("{"):
                self.block()
                self.need(")")
                return self.suffixes()
            if state[1] not in self.no_cast and self.starts_declaration():
                try:
                    self.type_name()
                    self.need(")")
                    if self.at("{"):
                        self.initializer()
                        return self.suffixes()
                    return self.unary()
                except Broken:
                    self.no_cast.add(state[1])  # never tried again, so chains of products stay cheap
                    self.restore(state)
                    self.advance()
            single = self.is_ident() and self.ahead() == ")"
            self.expression()
            self.need(")")
            if single and (self.kind in ("name", "num", "str") and self.tok not in KEYWORDS or self.at("{", "sizeof")):
                if self.at("{"):
                    self.initializer()
                    return self.suffixes()
                return self.unary()  # a cast to a named type
            return self.suffixes()
        self.operand()
        self.suffixes()

    def operand(self) -> None:
        if self.kind == "str":
            while self.kind == "str" or (self.is_ident() and self.tok.isupper()) or (self.is_ident() and self.tok.startswith("PRI")):
                self.advance()
        elif self.kind == "num":
            self.advance()
        elif self.at("_Generic", "__builtin_offsetof", "__builtin_va_arg", "offsetof", "va_arg"):
            self.advance()
            self.balanced()
        else:
            self.ident()
            if self.kind == "str" and self.text[self.start - 1] != "'":
                self.advance()

    def suffixes(self) -> None:
        while self.kind == "op":
            if self.tok == "[":
                self.advance()
                self.expression()
                self.need("]")
            elif self.tok == "(":
                self.advance()
                while not self.take(")"):
                    if self.starts_declaration():
                        state = self.save()
                        try:
                            self.type_name()
                            if not self.at(",", ")"):
                                raise Broken("type")
                        except Broken:
                            self.restore(state)
                            self.assignment()
                    else:
                        self.assignment()
                    if not self.at(")"):
                        self.need(",")
                        if self.at(")"):
                            raise Broken(f"argument at {self.start}")
            elif self.tok in (".", "->"):
                self.advance()
                self.ident()
            elif self.tok in ("++", "--"):
                self.advance()
            else:
                return


def parse(text: str) -> None:
    for reading in readings(text.removeprefix("\ufeff")):
        C(reading).program()
