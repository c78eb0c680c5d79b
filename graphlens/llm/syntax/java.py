"""Recursive-descent parser of Java."""

from __future__ import annotations

from graphlens.llm.syntax.braces import Parser
from graphlens.llm.syntax.lexing import END, KEYWORDS, NAME, NUM, STR

# Modifiers, primitive types, words that may be names, operators and their precedence.
MODIFIERS = frozenset("public protected private static abstract final native synchronized transient volatile strictfp default sealed non".split())
PRIMITIVES = frozenset("boolean byte short int long char float double".split())
CONTEXTUAL = frozenset(("record", "sealed", "permits", "yield", "non", "when", "open", "module", "with", NAME))
_BINARY = {"||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "<": 7, ">": 7, "<=": 7, ">=": 7, "instanceof": 7, "<<": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10}
_ASSIGN = frozenset(("=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", ">>>="))
LOOP, SWITCH, LAMBDA = 2, 4, 8


class Java(Parser):
    lang = "java"
    tokens_of: dict = {}
    accepted: dict = {}
    names = CONTEXTUAL
    anew = frozenset("public private protected class interface enum if for while return try switch import package static final".split())

    def program(self) -> None:
        self.statements("", self.top)
        while self.t[self.i] != END:
            self.errors.append((self.line_number(self.i), f"unexpected {self.t[self.i]}"))
            self.i += 1
            self.statements("", self.top)

    def top(self) -> None:
        t = self.t[self.i]
        if t == ";":
            self.i += 1
        elif t in ("import",):
            self.i += 1
            self.take("static")
            self.name()
            while self.take("."):
                if self.take("*"):
                    break
                self.name()
            self.expect(";")
        elif t == "package" or (t == "@" and self.package_ahead()):
            self.annotations()
            self.expect("package")
            self.qualified()
            self.expect(";")
        else:
            self.modifiers()
            if not self.type_declaration():
                self.fail(f"expected a class, found {self.t[self.i]}")

    def package_ahead(self) -> bool:
        save = self.i
        try:
            self.annotations()
            return self.t[self.i] == "package"
        finally:
            self.i = save

    def qualified(self) -> None:
        self.name()
        while self.take("."):
            self.name()

    def annotations(self) -> None:
        while self.t[self.i] == "@" and self.t[self.i + 1] != "interface":
            self.i += 1
            self.qualified()
            if self.take("("):
                while not self.take(")"):
                    if self.t[self.i] in CONTEXTUAL and self.t[self.i + 1] == "=":
                        self.i += 2
                    self.element()
                    if self.t[self.i] != ")":
                        self.expect(",")

    def element(self) -> None:
        if self.t[self.i] == "{":
            self.i += 1
            while not self.take("}"):
                self.element()
                if self.t[self.i] != "}":
                    self.expect(",")
        elif self.t[self.i] == "@":
            self.annotations()
        else:
            self.ternary()

    def modifiers(self) -> None:
        while True:
            t = self.t[self.i]
            if t == "@" and self.t[self.i + 1] != "interface":
                self.annotations()
            elif t == "non" and self.t[self.i + 1] == "-":
                self.i += 3
            elif t == "sealed" and self.t[self.i + 1] not in CONTEXTUAL | {"class", "interface", "abstract", "public", "static"}:
                return
            elif t in MODIFIERS and t != "non":
                if t == "default" and self.t[self.i + 1] in (":", "->"):
                    return
                self.i += 1
            else:
                return

    def type_declaration(self) -> bool:
        t = self.t[self.i]
        if t == "class":
            self.i += 1
            self.name()
            self.type_parameters()
            if self.take("extends"):
                self.type()
            if self.take("implements"):
                self.types()
            if self.take("permits"):
                self.types()
            self.class_body()
        elif t == "interface":
            self.i += 1
            self.name()
            self.type_parameters()
            if self.take("extends"):
                self.types()
            if self.take("permits"):
                self.types()
            self.class_body()
        elif t == "@" and self.t[self.i + 1] == "interface":
            self.i += 2
            self.name()
            self.class_body()
        elif t == "enum":
            self.i += 1
            self.name()
            if self.take("implements"):
                self.types()
            self.enum_body()
        elif t == "record" and self.t[self.i + 1] in CONTEXTUAL and self.t[self.i + 2] in ("(", "<"):
            self.i += 1
            self.name()
            self.type_parameters()
            self.parameters()
            if self.take("implements"):
                self.types()
            self.class_body()
        else:
            return False
        return True

    def types(self) -> None:
        self.type()
        while self.take(","):
            self.type()

    def type_parameters(self) -> None:
        if not self.take("<"):
            return
        while True:
            self.annotations()
            self.name()
            if self.take("extends"):
                self.type()
                while self.take("&"):
                    self.type()
            if not self.take(","):
                break
        self.expect(">")

    def class_body(self) -> None:
        self.expect("{")
        keep, self.ctx = self.ctx, 0
        try:
            self.statements("}", self.member)
        finally:
            self.ctx = keep
        self.expect("}")

    def enum_body(self) -> None:
        self.expect("{")
        while self.t[self.i] in CONTEXTUAL or self.t[self.i] == "@":
            self.annotations()
            self.name()
            if self.t[self.i] == "(":
                self.arguments()
            if self.t[self.i] == "{":
                self.class_body()
            if not self.take(","):
                break
        if self.take(";"):
            self.statements("}", self.member)
        self.expect("}")

    def member(self) -> None:
        t = self.t
        if self.take(";"):
            return
        if t[self.i] == "{" or (t[self.i] == "static" and t[self.i + 1] == "{"):
            self.take("static")
            self.block()
            return
        self.modifiers()
        if self.type_declaration():
            return
        self.type_parameters()
        self.annotations()
        if t[self.i] in CONTEXTUAL and t[self.i + 1] in ("(", "{"):  # a constructor
            self.i += 1
            if t[self.i] == "(":
                self.parameters()
                self.throws()
            self.block()
            return
        if not self.take("void"):
            self.type()
        self.name()
        if t[self.i] == "(":
            self.parameters()
            self.dims()
            self.throws()
            if self.take("default"):
                self.element()
            if not self.take(";"):
                self.block()
            return
        self.declarators()
        self.expect(";")

    def throws(self) -> None:
        if self.take("throws"):
            self.types()

    def dims(self) -> None:
        while True:
            if self.t[self.i] == "@":
                self.annotations()
            if self.t[self.i] == "[" and self.t[self.i + 1] == "]":
                self.i += 2
            else:
                return

    def parameters(self) -> None:
        self.expect("(")
        while not self.take(")"):
            self.modifiers()
            self.type()
            self.take("...")
            if not self.take("this"):
                self.name()
            self.dims()
            if self.t[self.i] != ")":
                self.expect(",")
                if self.t[self.i] == ")":
                    self.fail()

    def declarators(self) -> None:
        while True:
            self.dims()
            if self.take("="):
                self.initializer()
            if not self.take(","):
                return
            self.name()

    def initializer(self) -> None:
        if self.take("{"):
            while not self.take("}"):
                self.initializer()
                if self.t[self.i] != "}":
                    self.expect(",")
        elif self.t[self.i] == NUM or True:
            self.expression()

    def type(self) -> None:
        self.annotations()
        t = self.t[self.i]
        if t in PRIMITIVES:
            self.i += 1
        elif t == "?":
            self.i += 1
            if self.t[self.i] in ("extends", "super"):
                self.i += 1
                self.type()
            return
        else:
            while True:
                self.name()
                if self.t[self.i] == "<":
                    self.type_arguments()
                if not (self.t[self.i] == "." and self.t[self.i + 1] in CONTEXTUAL):
                    break
                self.i += 1
        self.dims()

    def type_arguments(self) -> None:
        self.expect("<")
        if self.take(">"):
            return
        while True:
            self.type()
            while self.take("&"):
                self.type()
            if not self.take(","):
                break
        self.expect(">")

    def block(self) -> None:
        self.expect("{")
        self.statements("}", self.statement)
        self.expect("}")

    def is_declaration(self) -> bool:
        """Whether a type and a name stand here."""
        t = self.t[self.i]
        if t in PRIMITIVES:
            return self.t[self.i + 1] not in (".", "::") and not (self.t[self.i + 1] == "[" and False)
        if t not in CONTEXTUAL:
            return False
        if self.t[self.i + 1] in CONTEXTUAL:
            return t != "yield" or self.t[self.i + 2] in ("=", ";", ",", ":")
        if self.t[self.i + 1] not in (".", "<", "["):
            return False
        save = self.i
        try:
            self.type()
            return self.t[self.i] in CONTEXTUAL and self.t[self.i + 1] in ("=", ";", ",", ":", "[", ")", "&&")
        except Exception:  # noqa: BLE001 - only a look ahead
            return False
        finally:
            self.i = save

    def statement(self) -> None:
        t = self.t[self.i]
        n = self.t[self.i + 1]
        if t == "{":
            self.block()
        elif t == ";":
            self.i += 1
        elif t == "if":
            self.i += 1
            self.paren()
            self.statement()
            if self.take("else"):
                self.statement()
        elif t == "for":
            self.for_()
        elif t == "while":
            self.i += 1
            self.paren()
            self.inside(LOOP)
        elif t == "do":
            self.i += 1
            self.inside(LOOP)
            self.expect("while")
            self.paren()
            self.expect(";")
        elif t in ("break", "continue"):
            self.i += 1
            if self.t[self.i] in CONTEXTUAL:
                self.i += 1
            elif not self.ctx & (LOOP | (SWITCH if t == "break" else 0)):
                self.i -= 1
                self.fail(f"{t} outside of a loop")
            self.expect(";")
        elif t in ("return", "throw"):
            self.i += 1
            if t == "throw" or self.t[self.i] != ";":
                self.expression()
            self.expect(";")
        elif t == "yield" and n not in ("=", ".", "(", "++", "--", "[") and not self.is_declaration():
            self.i += 1
            self.expression()
            self.expect(";")
        elif t == "try":
            self.try_()
        elif t == "switch":
            self.switch()
            self.take(";")
        elif t == "synchronized" and n == "(":
            self.i += 1
            self.paren()
            self.block()
        elif t == "assert":
            self.i += 1
            self.expression()
            if self.take(":"):
                self.expression()
            self.expect(";")
        elif t in CONTEXTUAL and n == ":":
            self.i += 2
            self.statement()
        elif t in ("class", "interface", "enum", "abstract", "static", "strictfp", "final", "@") or (t == "record" and n in CONTEXTUAL and self.t[self.i + 2] in ("(", "<")):
            self.modifiers()
            if not self.type_declaration():
                self.local()
        elif self.is_declaration():
            self.local()
        else:
            start = self.i
            self.expression()
            if not self.statement_like(start, self.i):
                self.fail("not a statement")
            self.expect(";")

    def statement_like(self, a: int, b: int) -> bool:
        """Only assignments, calls, steps and creations may stand alone."""
        t = self.t
        if t[b - 1] in (")", "++", "--") or t[a] in ("++", "--", "new", "switch"):
            return not (t[a] == "(" and t[b - 1] == ")" and self.closing(a) == b - 1)
        return self.had_assignment

    def closing(self, k: int) -> int:
        depth = 0
        while self.t[k] != END:
            depth += (self.t[k] == "(") - (self.t[k] == ")")
            if not depth:
                return k
            k += 1
        return -1

    had_assignment = False

    def local(self) -> None:
        self.type()
        self.name()
        self.declarators()
        self.expect(";")

    def paren(self) -> None:
        self.expect("(")
        self.expression()
        self.expect(")")

    def inside(self, flag: int) -> None:
        keep = self.ctx
        self.ctx |= flag
        try:
            self.statement()
        finally:
            self.ctx = keep

    def for_(self) -> None:
        self.i += 1
        self.expect("(")
        if self.t[self.i] != ";":
            mods = self.i
            self.modifiers()
            if self.i > mods or self.is_declaration():
                self.type()
                self.name()
                if self.take(":"):
                    self.expression()
                    self.expect(")")
                    self.inside(LOOP)
                    return
                self.declarators()
            else:
                self.expressions()
        self.expect(";")
        if self.t[self.i] != ";":
            self.expression()
        self.expect(";")
        if self.t[self.i] != ")":
            self.expressions()
        self.expect(")")
        self.inside(LOOP)

    def expressions(self) -> None:
        self.expression()
        while self.take(","):
            self.expression()

    def try_(self) -> None:
        self.i += 1
        resources = False
        if self.take("("):
            resources = True
            while not self.take(")"):
                mods = self.i
                self.modifiers()
                if self.i > mods or self.is_declaration():
                    self.type()
                    self.name()
                    self.expect("=")
                self.expression()
                if self.t[self.i] != ")":
                    self.expect(";")
        self.block()
        caught = False
        while self.take("catch"):
            caught = True
            self.expect("(")
            self.modifiers()
            self.type()
            while self.take("|"):
                self.type()
            self.name()
            self.expect(")")
            self.block()
        if self.take("finally"):
            self.block()
        elif not caught and not resources:
            self.fail("try without catch or finally")

    def switch(self) -> None:
        self.expect("switch")
        self.paren()
        self.expect("{")
        keep = self.ctx
        self.ctx |= SWITCH
        try:
            while not self.take("}"):
                if not self.take("default"):
                    self.expect("case")
                    while True:
                        if self.take("default"):
                            pass
                        elif self.is_declaration() or (self.t[self.i] in CONTEXTUAL and self.t[self.i + 1] == "(" and self.pattern_ahead()):
                            self.pattern()
                        else:
                            self.ternary()
                        if not self.take(","):
                            break
                    if self.take("when"):
                        self.expression()
                if self.take("->"):
                    if self.t[self.i] == "{":
                        self.block()
                    elif self.t[self.i] == "throw":
                        self.statement()
                    else:
                        self.expression()
                        self.expect(";")
                else:
                    self.expect(":")
                    while self.t[self.i] not in ("case", "default", "}", END):
                        self.statement()
        finally:
            self.ctx = keep

    def pattern_ahead(self) -> bool:
        save = self.i
        try:
            self.pattern()
            return self.t[self.i] in ("->", ":", ",", "when")
        except Exception:  # noqa: BLE001 - only a look ahead
            return False
        finally:
            self.i = save

    def pattern(self) -> None:
        self.modifiers()
        self.type()
        if self.take("("):
            while not self.take(")"):
                self.pattern()
                if self.t[self.i] != ")":
                    self.expect(",")
        elif self.t[self.i] in CONTEXTUAL and self.t[self.i] != "when":
            self.i += 1

    # expressions
    def expression(self) -> None:
        start = self.i
        if self.lambda_ahead():
            self.lambda_()
            return
        self.ternary()
        self.had_assignment = False
        t = self.t
        x = t[self.i]
        if x == ">" and t[self.i + 1] == ">=" or x == ">" and t[self.i + 1] == ">" and t[self.i + 2] == ">=":
            while t[self.i] == ">":
                self.i += 1
            x = "="
        if x in _ASSIGN:
            last = t[self.i - 1]
            if last not in CONTEXTUAL and last not in ("]", ")", ">") or t[start] in (NUM, STR):
                self.fail("cannot assign to this expression")
            self.i += 1
            self.expression()
            self.had_assignment = True

    def lambda_ahead(self) -> bool:
        t = self.t
        if t[self.i] in CONTEXTUAL and t[self.i + 1] == "->":
            return True
        if t[self.i] != "(":
            return False
        n = t[self.i + 1]
        if n not in CONTEXTUAL and n not in PRIMITIVES and n not in (")", "final", "@"):
            return False
        k = self.closing(self.i)
        return k > 0 and t[k + 1] == "->"

    def lambda_(self) -> None:
        t = self.t
        if t[self.i] in CONTEXTUAL:
            self.i += 1
        elif t[self.i + 1] == ")" or not (t[self.i + 1] in CONTEXTUAL and t[self.i + 2] in (",", ")")):
            self.parameters()
        else:
            self.i += 1
            while not self.take(")"):
                self.name()
                if t[self.i] != ")":
                    self.expect(",")
        self.expect("->")
        if t[self.i] == "{":
            keep, self.ctx = self.ctx, 0
            try:
                self.block()
            finally:
                self.ctx = keep
        else:
            self.expression()

    def ternary(self) -> None:
        self.binary(1)
        if self.take("?"):
            if self.lambda_ahead():
                self.lambda_()
            else:
                self.expression()
            self.expect(":")
            if self.lambda_ahead():
                self.lambda_()
            else:
                self.ternary()

    def binary(self, least: int) -> None:
        t = self.t
        self.unary()
        while True:
            x = t[self.i]
            power = _BINARY.get(x, 0)
            if power < least:
                return
            if x == "instanceof":
                self.i += 1
                self.pattern()
                continue
            if x == ">":
                k = self.i + 1
                while t[k] == ">" and k < self.i + 3:
                    k += 1
                if t[k] == ">=":
                    return
                if k > self.i + 1:
                    power = 8
                    if power < least:
                        return
                self.i = k
            else:
                self.i += 1
            if self.lambda_ahead():
                self.lambda_()
            else:
                self.binary(power + 1)

    def unary(self) -> None:
        t = self.t[self.i]
        if t in ("+", "-", "!", "~", "++", "--"):
            self.i += 1
            self.unary()
            return
        if t == "(" and self.cast():
            return
        self.primary()
        while self.t[self.i] in ("++", "--"):
            if self.t[self.i - 1] in (NUM, STR):
                self.fail()
            self.i += 1

    def cast(self) -> bool:
        n = self.t[self.i + 1]
        if n not in PRIMITIVES and n not in CONTEXTUAL and n != "@":
            return False
        save = self.i
        try:
            self.i += 1
            self.type()
            while self.take("&"):
                self.type()
            if not self.take(")"):
                raise ValueError
            t = self.t[self.i]
            if n in PRIMITIVES and self.t[save + 2] == ")":
                self.unary()
                return True
            if t in CONTEXTUAL or t in (NUM, STR, "(", "!", "~", "this", "new", "super", "true", "false", "null", "switch") or t in PRIMITIVES:
                if self.lambda_ahead():
                    self.lambda_()
                else:
                    self.unary()
                return True
        except Exception:  # noqa: BLE001 - it is an expression in parentheses then
            pass
        self.i = save
        return False

    def primary(self) -> None:
        t = self.t
        x = t[self.i]
        if x in (NUM, STR, "true", "false", "null", "this", "super"):
            self.i += 1
        elif x in CONTEXTUAL:
            self.i += 1
            if t[self.i] in ("<", "["):
                self.generic_reference()
        elif x == "(":
            self.paren()
        elif x == "new":
            self.new()
        elif x == "switch":
            self.switch()
        elif x in PRIMITIVES or x == "void":
            self.i += 1
            self.dims()
            if t[self.i] not in (".", "::"):
                self.fail()
        else:
            self.fail()
        while True:
            x = t[self.i]
            if x == ".":
                self.i += 1
                if t[self.i] == "<":
                    self.type_arguments()
                if t[self.i] in ("class", "this", "super"):
                    self.i += 1
                elif t[self.i] == "new":
                    self.new()
                else:
                    self.name()
                    if t[self.i] in ("<", "["):
                        self.generic_reference()
            elif x == "(":
                if t[self.i - 1] in (NUM, STR, "]") or t[self.i - 1] in ("true", "false", "null"):
                    self.fail()
                self.arguments()
            elif x == "[":
                self.i += 1
                self.expression()
                self.expect("]")
            elif x == "::":
                self.i += 1
                if t[self.i] == "<":
                    self.type_arguments()
                if not self.take("new"):
                    self.name()
            else:
                return

    def generic_reference(self) -> None:
        """Type<X>::new and Type[]::new; anything else stays a comparison or an index."""
        save = self.i
        try:
            if self.t[self.i] == "<":
                self.type_arguments()
            self.dims()
            if self.t[self.i] == "::" or (self.t[self.i] == "." and self.t[self.i + 1] == "class"):
                return
        except Exception:  # noqa: BLE001 - only a look ahead
            pass
        self.i = save

    def new(self) -> None:
        self.i += 1
        self.annotations()
        if self.t[self.i] == "<":
            self.type_arguments()
        if self.t[self.i] in PRIMITIVES:
            self.i += 1
        else:
            while True:
                self.name()
                if self.t[self.i] == "<":
                    self.type_arguments()
                if not self.take("."):
                    break
        if self.t[self.i] == "(":
            self.arguments()
            if self.t[self.i] == "{":
                self.class_body()
        else:
            if self.t[self.i] != "[":
                self.fail("expected ( or [")
            sized = False
            while self.t[self.i] == "[":
                self.i += 1
                if not self.take("]"):
                    self.expression()
                    self.expect("]")
                    sized = True
            if not sized:
                if self.t[self.i] == "{":
                    self.initializer()
                else:
                    self.expect(NUM)

    def arguments(self) -> None:
        self.expect("(")
        if self.take(")"):
            return
        while True:
            self.expression()
            if not self.take(","):
                break
        self.expect(")")
