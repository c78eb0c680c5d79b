"""Recursive-descent parser of Go; semicolons are put in at line ends as the language says."""

from __future__ import annotations

from graphlens.llm.syntax.braces import Parser
from graphlens.llm.syntax.lexing import END, NAME, NUM, STR

_BINARY = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "+": 4, "-": 4, "|": 4, "^": 4, "*": 5, "/": 5, "%": 5, "<<": 5, ">>": 5, "&": 5, "&^": 5}
_ASSIGN = frozenset(("=", ":=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", "&^="))
_ENDS = frozenset((NAME, NUM, STR, "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"))
LOOP, SWITCH = 2, 4


class Go(Parser):
    lang = "go"
    tokens_of: dict = {}
    accepted: dict = {}
    anew = frozenset("func type var const import if for switch return package".split())
    no_literal = False

    def line_tokens(self, tokens: list[str]) -> tuple:
        if tokens and tokens[-1] in _ENDS:
            tokens = [*tokens, ";"]
        return tuple(tokens)

    def pieces(self, shape: str) -> list[str]:
        return [shape]

    def program(self) -> None:
        if self.t[self.i] != "package":
            self.errors.append((self.line_number(0), "expected package"))
        else:
            self.i += 1
            if self.t[self.i] == NAME:
                self.i += 1
                if not self.take(";"):
                    self.errors.append((self.line_number(self.i), "expected ;"))
            else:
                self.errors.append((self.line_number(self.i), "expected a package name"))
        self.statements("", self.top)
        while self.t[self.i] != END:
            self.errors.append((self.line_number(self.i), f"unexpected {self.t[self.i]}"))
            self.i += 1
            self.statements("", self.top)

    def end(self) -> None:
        if self.t[self.i] not in ("}", ")", END):
            self.expect(";")

    def top(self) -> None:
        t = self.t[self.i]
        if t == ";":
            self.i += 1
        elif t == "func":
            self.i += 1
            if self.t[self.i] == "(":
                self.parameters()
            self.name()
            if self.t[self.i] == "[":
                self.type_parameters()
            self.signature()
            if self.t[self.i] == "{":
                self.body()
            self.end()
        elif t == "import":
            self.i += 1
            self.group(self.import_)
            self.end()
        elif t in ("var", "const", "type"):
            self.declaration()
        else:
            self.fail("declaration expected" if t != "package" else "")

    def group(self, one) -> None:
        if self.take("("):
            while not self.take(")"):
                one()
                if self.t[self.i] != ")":
                    self.expect(";")
        else:
            one()

    def import_(self) -> None:
        if self.t[self.i] in (NAME, "."):
            self.i += 1
        self.expect(STR)

    def declaration(self) -> None:
        word = self.t[self.i]
        self.i += 1
        self.group({"var": self.var, "const": self.const, "type": self.type_spec}[word])
        self.end()

    def name_list(self) -> None:
        self.name()
        while self.take(","):
            self.name()

    def var(self) -> None:
        self.name_list()
        if self.t[self.i] != "=":
            self.type()
        if self.take("="):
            self.expressions()

    def const(self) -> None:
        self.name_list()
        if self.t[self.i] not in ("=", ";", ")"):
            self.type()
            if self.t[self.i] != "=":
                self.fail()
        if self.take("="):
            self.expressions()

    def type_spec(self) -> None:
        self.name()
        if self.t[self.i] == "[" and self.t[self.i + 1] == NAME and self.t[self.i + 2] not in ("]",):
            save = self.i
            try:
                self.type_parameters()
            except Exception:  # noqa: BLE001 - an array type whose length is an expression
                self.i = save
        self.take("=")
        self.type()

    def type_parameters(self) -> None:
        self.expect("[")
        while not self.take("]"):
            self.name_list()
            self.constraint()
            if self.t[self.i] != "]":
                self.expect(",")

    def constraint(self) -> None:
        while True:
            self.take("~")
            self.type()
            if not self.take("|"):
                return

    def body(self) -> None:
        keep, lit = self.ctx, self.no_literal
        self.ctx, self.no_literal = 0, False
        try:
            self.block()
        finally:
            self.ctx, self.no_literal = keep, lit

    def block(self) -> None:
        lit, self.no_literal = self.no_literal, False
        self.expect("{")
        self.statements("}", self.statement)
        self.expect("}")
        self.no_literal = lit

    def signature(self) -> None:
        self.parameters()
        t = self.t[self.i]
        if t == "(":
            self.parameters()
        elif t in (NAME, "*", "[", "map", "chan", "func", "struct", "interface", "<-"):
            self.type()

    def parameters(self) -> None:
        self.expect("(")
        while not self.take(")"):
            if self.t[self.i] == NAME and self.t[self.i + 1] not in (",", ")", "."):
                save = self.i
                self.i += 1
                try:
                    self.take("...")
                    self.type()
                except Exception:  # noqa: BLE001 - a type alone, such as a[b]
                    self.i = save
                    self.type()
            else:
                self.take("...")
                self.type()
            if self.t[self.i] != ")":
                self.expect(",")

    def type(self) -> None:
        t = self.t[self.i]
        if t == NAME:
            self.i += 1
            if self.take("."):
                self.name()
            if self.t[self.i] == "[" and self.t[self.i + 1] != "]":
                self.i += 1
                self.type()
                while self.take(","):
                    self.type()
                self.expect("]")
        elif t == "*":
            self.i += 1
            self.type()
        elif t == "(":
            self.i += 1
            self.type()
            self.expect(")")
        elif t == "[":
            self.i += 1
            if not self.take("]"):
                if not self.take("..."):
                    self.expression()
                self.expect("]")
            self.type()
        elif t == "map":
            self.i += 1
            self.expect("[")
            self.type()
            self.expect("]")
            self.type()
        elif t == "chan":
            self.i += 1
            self.take("<-")
            self.type()
        elif t == "<-":
            self.i += 1
            self.expect("chan")
            self.type()
        elif t == "func":
            self.i += 1
            self.signature()
        elif t == "struct":
            self.i += 1
            self.expect("{")
            while not self.take("}"):
                if self.t[self.i] == "*" or (self.t[self.i] == NAME and self.t[self.i + 1] in (";", ".", STR, "}")):
                    self.type()
                else:
                    self.name_list()
                    self.type()
                self.take(STR)
                if self.t[self.i] != "}":
                    self.expect(";")
        elif t == "interface":
            self.i += 1
            self.expect("{")
            while not self.take("}"):
                if self.t[self.i] == NAME and self.t[self.i + 1] == "(":
                    self.i += 1
                    self.signature()
                else:
                    self.constraint()
                if self.t[self.i] != "}":
                    self.expect(";")
        else:
            self.fail(f"expected a type, found {t}")

    def statement(self) -> None:
        t = self.t[self.i]
        if t == ";":
            self.i += 1
            return
        if t in ("var", "const", "type"):
            self.declaration()
            return
        if t == "{":
            self.block()
        elif t == "if":
            self.if_()
        elif t == "for":
            self.for_()
        elif t in ("switch",):
            self.switch()
        elif t == "select":
            self.i += 1
            self.clauses(self.comm)
        elif t == "return":
            self.i += 1
            if self.t[self.i] not in (";", "}"):
                self.expressions()
        elif t in ("break", "continue"):
            self.i += 1
            if not self.take(NAME) and not self.ctx & (LOOP | (SWITCH if t == "break" else 0)):
                self.i -= 1
                self.fail(f"{t} outside of a loop")
        elif t == "goto":
            self.i += 1
            self.name()
        elif t == "fallthrough":
            self.i += 1
        elif t in ("go", "defer"):
            self.i += 1
            self.expression()
            if self.t[self.i - 1] != ")":
                self.fail("expected a call")
        elif t == NAME and self.t[self.i + 1] == ":":
            self.i += 2
            if self.t[self.i] != "}":
                self.statement()
            return
        else:
            self.simple()
        self.end()

    def simple(self) -> None:
        start = self.i
        self.expressions()
        t = self.t[self.i]
        if t in ("++", "--"):
            self.i += 1
        elif t in _ASSIGN:
            if t == ":=":
                for k in range(start, self.i):
                    if self.t[k] not in (NAME, ","):
                        self.fail("only names can be declared")
            elif self.t[self.i - 1] in (NUM, STR, "}"):
                self.fail("cannot assign to this expression")
            self.i += 1
            if t in (":=", "=") and self.take("range"):
                self.expression()
            else:
                self.expressions()
        elif t == "<-":
            self.i += 1
            self.expression()

    def header(self, extra: int = 0) -> None:
        """[simple;] condition of if and switch; composite literals need parentheses here."""
        keep, self.no_literal = self.no_literal, True
        self.plain_ok = True
        if self.t[self.i] not in ("{", ";"):
            self.header_part()
        if self.take(";"):
            if self.t[self.i] != "{":
                self.header_part()
        self.no_literal = keep

    def header_part(self) -> None:
        start = self.i
        self.expressions()
        t = self.t[self.i]
        if t in ("++", "--"):
            self.i += 1
        elif t in _ASSIGN:
            if t == ":=" and any(self.t[k] not in (NAME, ",") for k in range(start, self.i)):
                self.fail("only names can be declared")
            self.i += 1
            self.take("range")
            self.expressions()
        elif t == "<-":
            self.i += 1
            self.expression()

    def if_(self) -> None:
        self.expect("if")
        if self.t[self.i] == "{":
            self.fail("missing condition")
        self.header()
        if self.t[self.i - 1] == ";":
            self.fail("missing condition")
        self.block()
        if self.take("else"):
            if self.t[self.i] == "if":
                self.if_()
            else:
                self.block()

    def inside(self, flag: int) -> None:
        keep = self.ctx
        self.ctx |= flag
        try:
            self.block()
        finally:
            self.ctx = keep

    def for_(self) -> None:
        self.i += 1
        keep, self.no_literal = self.no_literal, True
        if self.t[self.i] != "{":
            if self.take("range"):
                self.expression()
            else:
                if self.t[self.i] != ";":
                    self.header_part()
                if self.take(";"):
                    if self.t[self.i] != ";":
                        self.expression()
                    self.expect(";")
                    if self.t[self.i] != "{":
                        self.header_part()
        self.no_literal = keep
        self.inside(LOOP)

    def switch(self) -> None:
        self.i += 1
        self.header()
        self.clauses(self.case_types)

    def case_types(self) -> None:
        while True:
            save = self.i
            try:
                self.expression()
                if self.t[self.i] not in (",", ":"):
                    raise ValueError
            except Exception:  # noqa: BLE001 - a type then
                self.i = save
                self.type()
            if not self.take(","):
                return

    def comm(self) -> None:
        self.header_part()

    def clauses(self, one) -> None:
        self.expect("{")
        keep = self.ctx
        self.ctx |= SWITCH
        lit, self.no_literal = self.no_literal, False
        try:
            while not self.take("}"):
                if not self.take("default"):
                    self.expect("case")
                    one()
                self.expect(":")
                while self.t[self.i] not in ("case", "default", "}", END):
                    self.statement()
        finally:
            self.ctx, self.no_literal = keep, lit

    def expressions(self) -> None:
        self.expression()
        while self.take(","):
            self.expression()

    def expression(self, least: int = 1) -> None:
        self.unary()
        while True:
            power = _BINARY.get(self.t[self.i], 0)
            if power < least:
                return
            self.i += 1
            self.expression(power + 1)

    def unary(self) -> None:
        while self.t[self.i] in ("+", "-", "!", "^", "*", "&", "<-"):
            self.i += 1
        self.primary()

    def primary(self) -> None:
        t = self.t
        x = t[self.i]
        literal = False
        if x in (NUM, STR):
            self.i += 1
        elif x == NAME:
            self.i += 1
            literal = not self.no_literal
        elif x == "(":
            keep, self.no_literal = self.no_literal, False
            self.i += 1
            try:
                self.expression()
            except Exception:  # noqa: BLE001 - a type in parentheses, as in (*T)(x)
                while t[self.i] not in ("(", END) or False:
                    self.i -= 1
                self.i += 1
                self.type()
            self.expect(")")
            self.no_literal = keep
        elif x == "func":
            self.i += 1
            self.signature()
            if t[self.i] == "{":
                self.body()
        elif x in ("[", "map", "struct", "chan", "interface"):
            self.type()
            if t[self.i] == "{":
                self.literal()
            elif t[self.i] not in ("(", ")", ",", "]", "..."):  # a type alone is an argument
                self.fail()
        else:
            self.fail()
        while True:
            x = t[self.i]
            if x == ".":
                self.i += 1
                if self.take("("):
                    if not self.take("type"):
                        self.type()
                    self.expect(")")
                else:
                    self.name()
            elif x == "(":
                self.arguments()
                literal = False
            elif x == "[":
                self.i += 1
                keep, self.no_literal = self.no_literal, False
                if t[self.i] != ":":
                    self.expression()
                while t[self.i] in (":", ","):
                    self.i += 1
                    if t[self.i] not in (":", "]"):
                        self.expression()
                self.no_literal = keep
                self.expect("]")
            elif x == "{" and literal:
                self.literal()
                literal = False
            else:
                return

    def literal(self) -> None:
        keep, self.no_literal = self.no_literal, False
        self.expect("{")
        while not self.take("}"):
            self.element()
            if self.take(":"):
                self.element()
            if self.t[self.i] != "}":
                self.expect(",")
        self.no_literal = keep

    def element(self) -> None:
        if self.t[self.i] == "{":
            self.literal()
        else:
            self.expression()

    def arguments(self) -> None:
        keep, self.no_literal = self.no_literal, False
        self.expect("(")
        while not self.take(")"):
            self.expression()
            self.take("...")
            if self.t[self.i] != ")":
                self.expect(",")
        self.no_literal = keep
