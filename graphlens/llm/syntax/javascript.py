"""Recursive-descent parser of JavaScript, and of TypeScript where ``typed``."""

from __future__ import annotations

from graphlens.llm.syntax.braces import Parser
from graphlens.llm.syntax.lexing import END, KEYWORDS, NAME, NUM, STR

# Reserved words, operators and their precedence.
RESERVED = frozenset("break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split())
WORDS = frozenset(KEYWORDS["javascript"].split())
CONTEXTUAL = (WORDS - RESERVED) | {NAME}
ANY = WORDS | {NAME}
_BINARY = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "as": 8, "satisfies": 8, "<<": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
_ASSIGN = frozenset(("=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "**=", "<<=", ">>>=", "&&=", "||=", "??="))
_MODIFIERS = frozenset("public private protected static readonly abstract declare override accessor async get set".split())
FUNC, LOOP, SWITCH, ASYNC, GEN, TYPED, JSX, AMBIENT = 1, 2, 4, 8, 16, 32, 64, 128


class JavaScript(Parser):
    lang = "javascript"
    tokens_of: dict = {}
    accepted: dict = {}
    names = CONTEXTUAL
    anew = frozenset("function class const let var import export return if for while interface async".split())

    @property
    def typed(self) -> bool:
        return bool(self.ctx & TYPED)

    def program(self) -> None:
        self.statements("", self.statement)
        while self.t[self.i] != END:
            self.errors.append((self.line_number(self.i), f"unexpected {self.t[self.i]}"))
            self.i += 1
            self.statements("", self.statement)

    def end(self) -> None:
        """End of a statement: ; or where one is put in."""
        t = self.t[self.i]
        if t == ";":
            self.i += 1
        elif t != "}" and t != END and not self.starts_line(self.i):
            self.fail(f"expected ;, found {t}")

    def block(self) -> None:
        self.expect("{")
        self.statements("}", self.statement)
        self.expect("}")

    def body(self, extra: int) -> None:
        keep = self.ctx
        self.ctx = (keep & (TYPED | JSX)) | FUNC | extra
        try:
            self.block()
        finally:
            self.ctx = keep

    def loop_body(self) -> None:
        keep = self.ctx
        self.ctx |= LOOP
        try:
            self.statement()
        finally:
            self.ctx = keep

    def statement(self) -> None:
        t = self.t[self.i]
        method = _STATEMENTS.get(t)
        if method is not None and not (t in CONTEXTUAL and self.plain_word(t)):
            method(self)
            return
        if t in CONTEXTUAL and self.t[self.i + 1] == ":" and t != "await":
            self.i += 2
            self.statement()
            return
        self.expression()
        self.end()

    def plain_word(self, t: str) -> bool:
        """Whether a contextual word at a statement's start is a name after all."""
        n = self.t[self.i + 1]
        if t == "let":
            return n not in CONTEXTUAL and n not in ("[", "{")
        if t == "async":
            return n != "function" or self.starts_line(self.i + 1)
        if t in ("abstract",):
            return not (self.typed and n == "class")
        if t == "declare":
            return not (self.typed and n in ANY and not self.starts_line(self.i + 1))
        if t in ("type", "interface"):
            return not (self.typed and n in CONTEXTUAL and not self.starts_line(self.i + 1))
        if t in ("namespace", "module"):
            return not (self.typed and (n in CONTEXTUAL or n == STR) and not self.starts_line(self.i + 1))
        if t == "global":
            return not (self.typed and n == "{")
        return False

    # declarations
    def variables(self, no_in: bool = False) -> None:
        kind = self.t[self.i]
        self.i += 1
        if kind == "const" and self.typed and self.take("enum"):
            self.i -= 1
            self.enum()
            return
        while True:
            pattern = self.t[self.i] in ("[", "{")
            self.binding()
            if self.typed:
                self.take("!")
                if self.take(":"):
                    self.type()
            if self.take("="):
                self.assignment(no_in)
            elif no_in and self.t[self.i] in ("of", "in"):
                return
            elif (pattern or kind == "const") and not no_in and not self.declared():
                self.fail("missing initializer")
            if not self.take(","):
                break
        if not no_in:
            self.end()

    def declared(self) -> bool:
        return bool(self.ctx & AMBIENT)

    def binding(self) -> None:
        if self.take("["):
            while not self.take("]"):
                if self.take(","):
                    continue
                self.take("...")
                self.binding()
                if self.take("="):
                    self.assignment()
                if self.t[self.i] != "]":
                    self.expect(",")
        elif self.take("{"):
            while not self.take("}"):
                if self.take("..."):
                    self.binding()
                else:
                    bare = self.t[self.i] in CONTEXTUAL
                    self.property_name()
                    if self.take(":"):
                        self.binding()
                    elif not bare:
                        self.fail()
                    if self.take("="):
                        self.assignment()
                if self.t[self.i] != "}":
                    self.expect(",")
        else:
            self.name()

    def function(self) -> None:
        extra = ASYNC if self.take("async") else 0
        self.expect("function")
        if self.take("*"):
            extra |= GEN
        if self.t[self.i] in CONTEXTUAL:
            self.i += 1
        self.signature()
        if self.typed and self.t[self.i] != "{":
            self.end()
            return
        self.body(extra)

    def function_declaration(self) -> None:
        k = self.i + (self.t[self.i] == "async") + 1
        k += self.t[k] == "*"
        if self.t[k] not in CONTEXTUAL:
            self.i = k
            self.fail("expected a function name")
        self.function()

    def signature(self) -> None:
        if self.typed and self.t[self.i] == "<":
            self.type_parameters()
        self.parameters()
        if self.typed and self.take(":"):
            self.return_type()

    def parameters(self) -> None:
        self.expect("(")
        while not self.take(")"):
            self.decorators()
            if self.typed:
                while self.t[self.i] in ("public", "private", "protected", "readonly", "override") and self.t[self.i + 1] in CONTEXTUAL:
                    self.i += 1
            rest = self.take("...")
            if self.typed and self.t[self.i] == "this":
                self.i += 1
            else:
                self.binding()
            if self.typed:
                self.take("?")
                if self.take(":"):
                    self.type()
            if self.take("="):
                self.assignment()
            if rest and self.t[self.i] != ")":
                self.fail("a rest parameter must be last")
            if self.t[self.i] != ")":
                self.expect(",")

    def decorators(self) -> None:
        while self.take("@"):
            if self.take("("):
                self.expression()
                self.expect(")")
            else:
                self.name()
                while self.take("."):
                    self.any_name()
                if self.t[self.i] == "(":
                    self.arguments()

    def any_name(self) -> None:
        if self.t[self.i] in ANY:
            self.i += 1
        elif self.t[self.i] == "#" and self.t[self.i + 1] in ANY:
            self.i += 2
        else:
            self.fail(f"expected a name, found {self.t[self.i]}")

    def class_declaration(self) -> None:
        self.decorators()
        if self.t[self.i] == "export":
            self.export()
            return
        if self.typed:
            self.take("abstract")
        if self.t[self.i] != "class":
            self.fail("a decorator needs a class")
        if self.t[self.i + 1] not in CONTEXTUAL:
            self.i += 1
            self.fail("expected a class name")
        self.class_()

    def class_(self) -> None:
        self.expect("class")
        if self.t[self.i] in CONTEXTUAL and not (self.t[self.i] == "implements" and self.typed):
            self.i += 1
        if self.typed and self.t[self.i] == "<":
            self.type_parameters()
        if self.take("extends"):
            self.left_hand()
            if self.typed and self.t[self.i] == "<":
                self.type_arguments()
        if self.typed and self.take("implements"):
            self.type()
            while self.take(","):
                self.type()
        self.expect("{")
        keep = self.ctx
        self.ctx = keep & (TYPED | JSX)
        try:
            self.statements("}", self.member)
        finally:
            self.ctx = keep
        self.expect("}")

    def member(self) -> None:
        if self.take(";"):
            return
        self.decorators()
        t = self.t
        if t[self.i] == "static" and t[self.i + 1] == "{":
            self.i += 1
            self.body(0)
            return
        extra = 0
        while t[self.i] in _MODIFIERS and t[self.i + 1] not in ("(", "=", ";", "}", ":", "?", "!", "<", ","):
            w = t[self.i]
            if not self.typed and w not in ("static", "async", "get", "set", "accessor"):
                self.fail()
            if w == "async" and self.starts_line(self.i + 1):
                break
            extra |= ASYNC if w == "async" else 0
            self.i += 1
        if self.take("*"):
            extra |= GEN
        if self.typed and t[self.i] == "[" and t[self.i + 1] in CONTEXTUAL and t[self.i + 2] == ":":
            self.i += 3
            self.type()
            self.expect("]")
            self.expect(":")
            self.type()
            self.end()
            return
        self.property_name()
        if self.typed:
            if not self.take("?"):
                self.take("!")
        if t[self.i] in ("(", "<"):
            self.signature()
            if self.typed and t[self.i] != "{":
                self.end()
                return
            self.body(extra)
            return
        if self.typed and self.take(":"):
            self.type()
        if self.take("="):
            keep = self.ctx
            self.ctx |= FUNC
            try:
                self.assignment()
            finally:
                self.ctx = keep
        self.end()

    def property_name(self) -> None:
        t = self.t[self.i]
        if t in ANY or t in (STR, NUM):
            self.i += 1
        elif t == "#":
            self.i += 1
            self.any_name()
        elif self.take("["):
            self.assignment()
            self.expect("]")
        else:
            self.fail(f"expected a property name, found {t}")

    # modules
    def import_(self) -> None:
        t = self.t
        if t[self.i + 1] in ("(", "."):
            self.expression()
            self.end()
            return
        self.i += 1
        if self.take(STR):
            self.attributes()
            self.end()
            return
        if self.typed and t[self.i] == "type" and t[self.i + 1] != "from":
            self.i += 1
        elif self.typed and t[self.i] == "type" and t[self.i + 2] == "from":
            self.i += 1
        if t[self.i] in CONTEXTUAL:
            self.i += 1
            if self.typed and self.take("="):
                self.expression()
                self.end()
                return
            if not self.take(","):
                self.from_()
                return
        if self.take("*"):
            self.expect("as")
            self.name()
        else:
            self.specifiers()
        self.from_()

    def specifiers(self) -> None:
        self.expect("{")
        while not self.take("}"):
            if self.typed and self.t[self.i] == "type" and self.t[self.i + 1] in ANY and self.t[self.i + 1] != "as":
                self.i += 1
            if not self.take(STR):
                self.any_name()
            if self.take("as") and not self.take(STR):
                self.any_name()
            if self.t[self.i] != "}":
                self.expect(",")

    def from_(self) -> None:
        self.expect("from")
        self.expect(STR)
        self.attributes()
        self.end()

    def attributes(self) -> None:
        if self.t[self.i] == "with" and self.t[self.i + 1] == "{":
            self.i += 1
            self.primary()

    def export(self) -> None:
        self.i += 1
        t = self.t[self.i]
        if t == "default":
            self.i += 1
            n = self.t[self.i]
            if n == "function" or (n == "async" and self.t[self.i + 1] == "function"):
                self.function()
            elif n in ("class", "@") or (self.typed and n == "abstract"):
                self.decorators()
                self.take("abstract")
                self.class_()
            elif self.typed and n == "interface":
                self.interface()
            else:
                self.assignment()
                self.end()
        elif t == "*":
            self.i += 1
            if self.take("as"):
                self.any_name()
            self.from_()
        elif t == "{" or (self.typed and t == "type" and self.t[self.i + 1] in ("{", "*")):
            self.take("type")
            if self.take("*"):
                if self.take("as"):
                    self.any_name()
                self.from_()
                return
            self.specifiers()
            if self.t[self.i] == "from":
                self.from_()
            else:
                self.end()
        elif self.typed and t in ("=", "as"):
            self.i += 1
            if t == "as":
                self.expect("namespace")
            self.expression()
            self.end()
        elif t in ("var", "let", "const", "function", "class", "async", "@") or (self.typed and t in ("interface", "type", "enum", "namespace", "module", "declare", "abstract", "import")):
            self.statement()
        else:
            self.fail()

    # statements with keywords
    def if_(self) -> None:
        self.i += 1
        self.paren()
        self.statement()
        if self.take("else"):
            self.statement()

    def paren(self) -> None:
        self.expect("(")
        self.expression()
        self.expect(")")

    def for_(self) -> None:
        self.i += 1
        self.take("await")
        self.expect("(")
        t = self.t[self.i]
        if t in ("var", "const") or (t == "let" and not self.plain_word("let")):
            self.variables(no_in=True)
        elif t != ";":
            self.expression(no_in=True)
        if self.t[self.i] == "of":
            self.i += 1
            self.assignment()
        elif self.t[self.i] == "in":
            self.i += 1
            self.expression()
        else:
            self.expect(";")
            if self.t[self.i] != ";":
                self.expression()
            self.expect(";")
            if self.t[self.i] != ")":
                self.expression()
        self.expect(")")
        self.loop_body()

    def while_(self) -> None:
        self.i += 1
        self.paren()
        self.loop_body()

    def do(self) -> None:
        self.i += 1
        self.loop_body()
        self.expect("while")
        self.paren()
        self.take(";")

    def jump(self) -> None:
        word = self.t[self.i]
        self.i += 1
        if self.t[self.i] in CONTEXTUAL and not self.starts_line(self.i):
            self.i += 1
        elif not self.ctx & (LOOP | (SWITCH if word == "break" else 0)):
            self.i -= 1
            self.fail(f"{word} outside of a loop")
        self.end()

    def return_(self) -> None:
        if not self.ctx & FUNC:
            self.fail("return outside of a function")
        self.i += 1
        if self.t[self.i] not in (";", "}", END) and not self.starts_line(self.i):
            self.expression()
        self.end()

    def throw(self) -> None:
        self.i += 1
        if self.starts_line(self.i):
            self.fail("line break after throw")
        self.expression()
        self.end()

    def try_(self) -> None:
        self.i += 1
        self.block()
        caught = False
        if self.take("catch"):
            caught = True
            if self.take("("):
                self.binding()
                if self.typed and self.take(":"):
                    self.type()
                self.expect(")")
            self.block()
        if self.take("finally"):
            self.block()
        elif not caught:
            self.fail("try without catch or finally")

    def switch(self) -> None:
        self.i += 1
        self.paren()
        self.expect("{")
        keep = self.ctx
        self.ctx |= SWITCH
        try:
            while not self.take("}"):
                if self.take("default"):
                    pass
                else:
                    self.expect("case")
                    self.expression()
                self.expect(":")
                while self.t[self.i] not in ("case", "default", "}", END):
                    self.statement()
        finally:
            self.ctx = keep

    def debugger(self) -> None:
        self.i += 1
        self.end()

    def empty(self) -> None:
        self.i += 1

    def with_(self) -> None:
        self.i += 1
        self.paren()
        self.statement()

    # TypeScript declarations
    def interface(self) -> None:
        self.i += 1
        self.name()
        if self.t[self.i] == "<":
            self.type_parameters()
        if self.take("extends"):
            self.type()
            while self.take(","):
                self.type()
        self.object_type()

    def type_alias(self) -> None:
        self.i += 1
        self.name()
        if self.t[self.i] == "<":
            self.type_parameters()
        self.expect("=")
        self.type()
        self.end()

    def enum(self) -> None:
        if not self.typed:
            self.fail()
        self.expect("enum")
        self.name()
        self.expect("{")
        while not self.take("}"):
            self.property_name()
            if self.take("="):
                self.assignment()
            if self.t[self.i] != "}":
                self.expect(",")

    def namespace(self) -> None:
        self.i += 1
        if not self.take(STR):
            if not self.take("global"):
                self.name()
                while self.take("."):
                    self.name()
        if self.t[self.i] == "{":
            self.block()
        else:
            self.end()

    def global_(self) -> None:
        self.i += 1
        self.block()

    def declare(self) -> None:
        self.i += 1
        keep = self.ctx
        self.ctx |= AMBIENT
        try:
            self.statement()
        finally:
            self.ctx = keep

    # types
    def return_type(self) -> None:
        if self.t[self.i] == "asserts" and self.t[self.i + 1] in ANY and not self.starts_line(self.i + 1):
            self.i += 1
        if self.t[self.i] in ANY and self.t[self.i + 1] == "is":
            self.i += 2
        self.type()
        if self.take("is"):
            self.type()

    def type(self) -> None:
        t = self.t
        if t[self.i] == "new" or (t[self.i] == "abstract" and t[self.i + 1] == "new"):
            self.take("abstract")
            self.i += 1
            self.function_type()
            return
        if t[self.i] == "<" or (t[self.i] == "(" and self.is_function_type()):
            self.function_type()
            return
        self.union()
        if t[self.i] == "extends" and not self.starts_line(self.i):
            self.i += 1
            self.union()
            self.expect("?")
            self.type()
            self.expect(":")
            self.type()

    def function_type(self) -> None:
        if self.t[self.i] == "<":
            self.type_parameters()
        self.parameters()
        self.expect("=>")
        self.return_type()

    def is_function_type(self) -> bool:
        k, depth = self.i, 0
        while self.t[k] != END:
            if self.t[k] in "([{":
                depth += 1
            elif self.t[k] in ")]}":
                depth -= 1
                if not depth:
                    return self.t[k + 1] == "=>"
            k += 1
        return False

    def union(self) -> None:
        if not self.take("|"):
            self.take("&")
        while True:
            self.type_postfix()
            if self.t[self.i] in ("|", "&"):
                self.i += 1
                continue
            return

    def type_postfix(self) -> None:
        while self.t[self.i] in ("keyof", "readonly", "infer", "unique") and self.t[self.i + 1] not in (",", ")", ">", ";", "=", "|", "&", "]", "}"):
            self.i += 1
        self.type_primary()
        while self.t[self.i] == "[" and not self.starts_line(self.i):
            self.i += 1
            if not self.take("]"):
                self.type()
                self.expect("]")

    def type_primary(self) -> None:
        t = self.t[self.i]
        if t == "(":
            if self.is_function_type():
                self.function_type()
                return
            self.i += 1
            self.type()
            self.expect(")")
        elif t == "[":
            self.i += 1
            while not self.take("]"):
                self.take("...")
                if self.t[self.i] in ANY and self.t[self.i + 1] in (":", "?") and (self.t[self.i + 1] == ":" or self.t[self.i + 2] == ":"):
                    self.i += 1
                    self.take("?")
                    self.expect(":")
                self.type()
                self.take("?")
                if self.t[self.i] != "]":
                    self.expect(",")
        elif t == "{":
            self.object_type()
        elif t in (STR, NUM, "`"):
            self.i += 1
        elif t == "-":
            self.i += 1
            self.expect(NUM)
        elif t == "typeof":
            self.i += 1
            self.left_name()
        elif t == "import":
            self.i += 1
            self.expect("(")
            self.expect(STR)
            self.expect(")")
            while self.take("."):
                self.any_name()
            if self.t[self.i] == "<":
                self.type_arguments()
        elif t in ("void", "null", "this", "true", "false") or t in CONTEXTUAL:
            self.i += 1
            while self.take("."):
                self.any_name()
            if self.t[self.i] == "<" and not self.starts_line(self.i):
                self.type_arguments()
        else:
            self.fail(f"expected a type, found {t}")

    def left_name(self) -> None:
        self.any_name()
        while self.take("."):
            self.any_name()
        if self.t[self.i] == "<":
            self.type_arguments()

    def type_arguments(self) -> None:
        self.expect("<")
        while True:
            self.type()
            if not self.take(","):
                break
        self.close_angle()

    def close_angle(self) -> None:
        if self.t[self.i] == ">":
            self.i += 1
        else:
            self.fail(f"expected >, found {self.t[self.i]}")

    def type_parameters(self) -> None:
        self.expect("<")
        while True:
            while self.t[self.i] in ("const", "in", "out") and self.t[self.i + 1] in CONTEXTUAL:
                self.i += 1
            self.name()
            if self.take("extends"):
                self.type()
            if self.take("="):
                self.type()
            if not self.take(",") or self.t[self.i] == ">":
                break
        self.close_angle()

    def object_type(self) -> None:
        self.expect("{")
        t = self.t
        while not self.take("}"):
            if t[self.i] in ("+", "-"):
                self.i += 1
            while t[self.i] in ("readonly", "get", "set") and t[self.i + 1] not in ("(", ":", "?", ";", ",", "}", "<"):
                self.i += 1
            if t[self.i] in ("(", "<"):
                self.signature()
            elif t[self.i] == "new" and t[self.i + 1] in ("(", "<"):
                self.i += 1
                self.signature()
            elif t[self.i] == "[" and t[self.i + 1] in CONTEXTUAL and t[self.i + 2] in (":", "in"):
                self.i += 3
                self.type()
                if self.take("as"):
                    self.type()
                self.expect("]")
                if t[self.i] in ("+", "-"):
                    self.i += 1
                self.take("?")
                if self.take(":"):
                    self.type()
            else:
                self.property_name()
                self.take("?")
                if t[self.i] in ("(", "<"):
                    self.signature()
                elif self.take(":"):
                    self.type()
            if t[self.i] in (",", ";"):
                self.i += 1
            elif t[self.i] != "}" and not self.starts_line(self.i):
                self.fail(f"expected ;, found {t[self.i]}")

    # expressions
    def expression(self, no_in: bool = False) -> None:
        self.assignment(no_in)
        while self.take(","):
            self.assignment(no_in)

    def assignment(self, no_in: bool = False) -> None:
        t = self.t
        i = self.i
        x = t[i]
        if x == "yield" and self.ctx & GEN:
            self.i += 1
            if t[self.i] not in (")", "]", "}", ",", ";", ":", END) and not self.starts_line(self.i):
                self.take("*")
                self.assignment(no_in)
            return
        if x == "async" and not self.starts_line(i + 1):
            if t[i + 1] in CONTEXTUAL and t[i + 2] == "=>":
                self.i += 3
                self.arrow_body(ASYNC)
                return
            if t[i + 1] in ("(", "<") and self.arrow_ahead(i + 1):
                self.i += 1
                self.arrow(ASYNC)
                return
        if x in CONTEXTUAL and t[i + 1] == "=>":
            self.i += 2
            self.arrow_body(0)
            return
        if (x == "(" or (x == "<" and self.typed)) and self.arrow_ahead(i):
            self.arrow(0)
            return
        self.conditional(no_in)
        x = t[self.i]
        if x in _ASSIGN or (x == ">" and t[self.i + 1 : self.i + 3] in ([">="], [">", ">="])) or (x == ">" and t[self.i + 1] == ">="):
            self.check_target(i, self.i, x == "=")
            while self.t[self.i] == ">":
                self.i += 1
            self.i += 1
            self.assignment(no_in)

    def check_target(self, start: int, end: int, plain: bool) -> None:
        t = self.t
        first, last = t[start], t[end - 1]
        if first in ("[", "{") and plain and self.closing(start) == end - 1:
            return
        if first == "(" and self.closing(start) == end - 1:
            self.check_target(start + 1, end - 1, False)
            return
        if last == "]" and first not in ("+", "-", "!", "~"):
            return
        if last in ANY and (end - start == 1 and last in CONTEXTUAL or t[end - 2] in (".", "#")):
            return
        if self.typed and last in ("!", ">") or self.typed and "as" in t[start:end]:
            return
        self.i = end
        self.fail("cannot assign to this expression")

    def closing(self, k: int) -> int:
        depth = 0
        while self.t[k] != END:
            if self.t[k] in "([{":
                depth += 1
            elif self.t[k] in ")]}":
                depth -= 1
                if not depth:
                    return k
            k += 1
        return -1

    def arrow_ahead(self, k: int) -> bool:
        t = self.t
        if t[k] == "<":
            if not self.typed:
                return False
            depth = 0
            while t[k] != END:
                depth += (t[k] == "<") - (t[k] == ">")
                k += 1
                if not depth:
                    break
            if t[k] != "(":
                return False
        n = t[k + 1]
        if n not in CONTEXTUAL and n not in (")", "[", "{", "...", "this", "@"):
            return False
        k = self.closing(k) + 1
        if not k:
            return False
        if t[k] == "=>":
            return not self.starts_line(k)
        if t[k] == ":" and self.typed:
            save, self.i = self.i, k + 1
            try:
                self.return_type()
                return t[self.i] == "=>"
            except Exception:  # noqa: BLE001 - only a look ahead
                return False
            finally:
                self.i = save
        return False

    def arrow(self, extra: int) -> None:
        self.signature()
        self.expect("=>")
        self.arrow_body(extra)

    def arrow_body(self, extra: int) -> None:
        if self.t[self.i] == "{":
            self.body(extra)
        else:
            keep = self.ctx
            self.ctx = (keep & (TYPED | JSX | FUNC)) | extra
            try:
                self.assignment()
            finally:
                self.ctx = keep

    def conditional(self, no_in: bool) -> None:
        self.binary(1, no_in)
        if self.take("?"):
            self.assignment()
            self.expect(":")
            self.assignment(no_in)

    def binary(self, least: int, no_in: bool) -> None:
        t = self.t
        if t[self.i] == "#" and t[self.i + 1] in ANY and t[self.i + 2] == "in":
            self.i += 2
        else:
            self.unary()
        while True:
            x = t[self.i]
            power = _BINARY.get(x, 0)
            if power < least or (x == "in" and no_in):
                return
            if x in ("as", "satisfies"):
                if not self.typed or self.starts_line(self.i):
                    return
                self.i += 1
                if not self.take("const"):
                    self.type()
                continue
            if x == ">":
                k = self.i + 1
                while t[k] == ">" or t[k] == ">=":
                    if t[k] == ">=":
                        return  # >>= and >>>= assign
                    k += 1
                if k > self.i + 3:
                    self.fail()
                if k > self.i + 1:
                    if least > 9:
                        return
                    power = 9
                self.i = k
            else:
                self.i += 1
            self.binary(power if x == "**" else power + 1, no_in)

    def unary(self) -> None:
        t = self.t[self.i]
        if t in ("!", "~", "+", "-", "typeof", "void", "delete"):
            self.i += 1
            self.unary()
        elif t in ("++", "--"):
            self.i += 1
            start = self.i
            self.unary()
            self.check_target(start, self.i, False)
        elif t == "await" and (self.ctx & ASYNC or not self.ctx & FUNC) and self.t[self.i + 1] not in (")", ",", ";", "=", ".", "]", "}", ":", "=>", END):
            self.i += 1
            self.unary()
        elif t == "<" and self.typed and not self.ctx & JSX:
            self.i += 1
            if not self.take("const"):
                self.type()
            self.close_angle()
            self.unary()
        else:
            start = self.i
            self.left_hand()
            if self.t[self.i] in ("++", "--") and not self.starts_line(self.i):
                self.check_target(start, self.i, False)
                self.i += 1

    def left_hand(self) -> None:
        t = self.t
        if t[self.i] == "new":
            self.new()
        elif t[self.i] == "super":
            self.i += 1
            if t[self.i] not in ("(", ".", "["):
                self.fail()
        elif t[self.i] == "import":
            self.i += 1
            if self.take("."):
                self.any_name()
            elif t[self.i] != "(":
                self.fail()
        else:
            self.primary()
        self.tail(calls=True)

    def new(self) -> None:
        self.i += 1
        if self.take("."):
            self.expect("target")
            return
        if self.t[self.i] == "new":
            self.new()
        else:
            self.primary()
        self.tail(calls=False)
        if self.typed and self.t[self.i] == "<":
            self.try_type_arguments()
        if self.t[self.i] == "(":
            self.arguments()

    def try_type_arguments(self) -> bool:
        save = self.i
        try:
            self.type_arguments()
            if self.t[self.i] in ("(", "`", ")", "]", ":", ";", ",", ".", "?.", "==", "===", "!=", "!==", "&&", "||", "??", "}", END) or self.starts_line(self.i):
                return True
        except Exception:  # noqa: BLE001 - it is a comparison then
            pass
        self.i = save
        return False

    def tail(self, calls: bool) -> None:
        t = self.t
        while True:
            x = t[self.i]
            if x == ".":
                self.i += 1
                self.any_name()
            elif x == "[":
                self.i += 1
                self.expression()
                self.expect("]")
            elif x == "(" and calls:
                self.arguments()
            elif x == "`":
                self.i += 1
            elif x == "?." and calls:
                self.i += 1
                if t[self.i] == "(":
                    self.arguments()
                elif self.take("["):
                    self.expression()
                    self.expect("]")
                else:
                    self.any_name()
            elif x == "!" and self.typed and not self.starts_line(self.i):
                self.i += 1
            elif x == "<" and self.typed and calls and self.try_type_arguments():
                pass
            else:
                return

    def arguments(self) -> None:
        self.expect("(")
        while not self.take(")"):
            self.take("...")
            self.assignment()
            if self.t[self.i] != ")":
                self.expect(",")

    def primary(self) -> None:
        t = self.t[self.i]
        if t == "async" and self.t[self.i + 1] == "function" and not self.starts_line(self.i + 1):
            self.function()
        elif t in (NAME, NUM, STR, "this", "null", "true", "false", "`") or t in CONTEXTUAL:
            self.i += 1
        elif t == "(":
            self.i += 1
            self.expression()
            self.expect(")")
        elif t == "[":
            self.i += 1
            while not self.take("]"):
                if self.take(","):
                    continue
                self.take("...")
                self.assignment()
                if self.t[self.i] != "]":
                    self.expect(",")
        elif t == "{":
            self.object()
        elif t == "function":
            self.function()
        elif t in ("class", "@"):
            self.decorators()
            self.class_()
        elif t == "<" and self.ctx & JSX:
            self.jsx()
        else:
            self.fail()

    def object(self) -> None:
        self.expect("{")
        t = self.t
        while not self.take("}"):
            if self.take("..."):
                self.assignment()
            else:
                extra = 0
                while t[self.i] in ("async", "get", "set") and t[self.i + 1] not in ("(", ",", "}", ":", "=", "<"):
                    extra |= ASYNC if t[self.i] == "async" else 0
                    self.i += 1
                if self.take("*"):
                    extra |= GEN
                bare = t[self.i] in CONTEXTUAL
                self.property_name()
                if t[self.i] in ("(", "<"):
                    self.signature()
                    self.body(extra)
                elif self.take(":"):
                    self.assignment()
                elif bare:
                    if self.take("="):
                        self.assignment()
                else:
                    self.fail()
            if t[self.i] != "}":
                self.expect(",")

    def jsx(self) -> None:
        self.expect("<")
        t = self.t
        if not self.take(">"):
            self.jsx_name()
            while t[self.i] not in (">", "/", END):
                if self.take("{"):
                    self.take("...")
                    self.assignment()
                    self.expect("}")
                    continue
                self.jsx_name()
                if self.take("="):
                    if self.take("{"):
                        self.assignment()
                        self.expect("}")
                    elif t[self.i] == "<":
                        self.jsx()
                    else:
                        self.expect(STR)
            if self.take("/"):
                self.expect(">")
                return
            self.expect(">")
        while True:
            if t[self.i] == END:
                self.fail("element was never closed")
            if t[self.i] == "<":
                if t[self.i + 1] == "/":
                    self.i += 2
                    if t[self.i] != ">":
                        self.jsx_name()
                    self.expect(">")
                    return
                self.jsx()
            elif self.take("{"):
                if t[self.i] != "}":
                    self.take("...")
                    self.expression()
                self.expect("}")
            else:
                self.i += 1

    def jsx_name(self) -> None:
        self.any_name()
        while self.t[self.i] in ("-", ".", ":"):
            self.i += 1
            self.any_name()


_STATEMENTS = {
    "{": JavaScript.block, ";": JavaScript.empty, "var": JavaScript.variables, "let": JavaScript.variables, "const": JavaScript.variables, "function": JavaScript.function_declaration, "async": JavaScript.function_declaration,
    "class": JavaScript.class_declaration, "@": JavaScript.class_declaration, "abstract": JavaScript.class_declaration, "if": JavaScript.if_, "for": JavaScript.for_, "while": JavaScript.while_, "do": JavaScript.do, "break": JavaScript.jump,
    "continue": JavaScript.jump, "return": JavaScript.return_, "throw": JavaScript.throw, "try": JavaScript.try_, "switch": JavaScript.switch, "debugger": JavaScript.debugger, "with": JavaScript.with_, "import": JavaScript.import_, "export": JavaScript.export,
    "enum": JavaScript.enum, "interface": JavaScript.interface, "type": JavaScript.type_alias, "namespace": JavaScript.namespace, "module": JavaScript.namespace, "global": JavaScript.global_, "declare": JavaScript.declare,
}
