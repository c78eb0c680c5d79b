"""Recursive-descent parser of Rust."""

from __future__ import annotations

from graphlens.llm.syntax.braces import Parser
from graphlens.llm.syntax.lexing import END, NAME, NUM, STR

_BINARY = {"..": 1, "..=": 1, "||": 2, "&&": 3, "==": 4, "!=": 4, "<": 4, ">": 4, "<=": 4, ">=": 4, "|": 5, "^": 6, "&": 7, "<<": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10, "as": 11}
_ASSIGN = frozenset(("=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>="))
_PATH = frozenset((NAME, "self", "Self", "super", "crate", "union", "macro_rules", "dyn"))
_BLOCKISH = frozenset(("if", "match", "for", "while", "loop", "unsafe", "{"))
LOOP = 2


class Rust(Parser):
    lang = "rust"
    tokens_of: dict = {}
    accepted: dict = {}
    names = frozenset((NAME, "union", "macro_rules"))
    anew = frozenset("fn pub let struct enum impl trait use mod const static if for while loop match return".split())
    no_struct = False

    def program(self) -> None:
        self.statements("", self.item_only)
        while self.t[self.i] != END:
            self.errors.append((self.line_number(self.i), f"unexpected {self.t[self.i]}"))
            self.i += 1
            self.statements("", self.item_only)

    def attributes(self) -> None:
        while self.t[self.i] == "#":
            self.i += 1
            self.take("!")
            if self.t[self.i] != "[":
                self.fail()
            self.tree()

    def tree(self) -> None:
        """One balanced token tree."""
        pairs = {"(": ")", "[": "]", "{": "}"}
        stack = []
        while True:
            x = self.t[self.i]
            if x == END:
                self.fail("bracket was never closed")
            if x in pairs:
                stack.append(pairs[x])
            elif x in (")", "]", "}"):
                if not stack or stack.pop() != x:
                    self.fail(f"unexpected {x}")
            self.i += 1
            if not stack:
                return

    def item_only(self) -> None:
        if self.take(";"):
            return
        if not self.item():
            self.fail(f"expected an item, found {self.t[self.i]}")

    def visibility(self) -> None:
        if self.take("pub") and self.t[self.i] == "(" and self.t[self.i + 1] in ("crate", "super", "self", "in"):
            self.tree()

    def item(self) -> bool:
        self.attributes()
        start = self.i
        self.visibility()
        t = self.t
        x = t[self.i]
        if x in ("fn", "async", "unsafe", "extern", "const") and self.function_ahead():
            while t[self.i] != "fn":
                self.i += 1
            self.function()
        elif x == "use":
            self.i += 1
            self.use_tree()
            self.expect(";")
        elif x == "mod" or (x == "unsafe" and t[self.i + 1] == "mod"):
            self.take("unsafe")
            self.i += 1
            self.name()
            if not self.take(";"):
                self.expect("{")
                self.statements("}", self.item_only)
                self.expect("}")
        elif x in ("struct",) or (x == "union" and t[self.i + 1] == NAME):
            self.i += 1
            self.name()
            self.generics()
            self.where()
            if t[self.i] == "{":
                self.fields()
            elif t[self.i] == "(":
                self.tuple_fields()
                self.where()
                self.expect(";")
            else:
                self.expect(";")
        elif x == "enum":
            self.i += 1
            self.name()
            self.generics()
            self.where()
            self.expect("{")
            while not self.take("}"):
                self.attributes()
                self.visibility()
                self.name()
                if t[self.i] == "{":
                    self.fields()
                elif t[self.i] == "(":
                    self.tuple_fields()
                if self.take("="):
                    self.expression()
                if t[self.i] != "}":
                    self.expect(",")
        elif x in ("trait", "unsafe", "auto") and (x == "trait" or t[self.i + 1] == "trait"):
            self.take("unsafe")
            self.i += 1
            self.name()
            self.generics()
            if self.take(":"):
                self.bounds()
            self.where()
            self.associated()
        elif x == "impl" or (x == "unsafe" and t[self.i + 1] == "impl"):
            self.take("unsafe")
            self.i += 1
            if t[self.i] == "<":
                self.generics()
            self.take("!")
            self.type()
            if self.take("for"):
                self.type()
            self.where()
            self.associated()
        elif x == "type":
            self.i += 1
            self.name()
            self.generics()
            if self.take(":"):
                self.bounds()
            self.where()
            if self.take("="):
                self.type()
            self.where()
            self.expect(";")
        elif x in ("const", "static") and t[self.i + 1] in (NAME, "mut", "ref") or (x == "const" and t[self.i + 1] == ":"):
            self.i += 1
            self.take("mut")
            if not self.take(NAME):
                self.fail("expected a name")
            self.generics()
            self.expect(":")
            self.type()
            if self.take("="):
                self.expression()
            self.expect(";")
        elif x == "extern":
            self.i += 1
            if self.take("crate"):
                if not self.take("self"):
                    self.name()
                if self.take("as"):
                    self.name()
                self.expect(";")
            else:
                self.take(STR)
                self.expect("{")
                self.statements("}", self.item_only)
                self.expect("}")
        elif x == "macro_rules" and t[self.i + 1] == "!":
            self.i += 2
            self.name()
            brace = t[self.i] == "{"
            self.tree()
            if not brace:
                self.expect(";")
        elif x == "macro" and t[self.i + 1] == NAME:
            self.i += 2
            self.tree()
            if t[self.i] == "{":
                self.tree()
        elif x in _PATH and self.macro_item():
            pass
        else:
            if self.i > start:
                self.fail()
            return False
        return True

    def macro_item(self) -> bool:
        k = self.i
        t = self.t
        while t[k] in _PATH and t[k + 1] == "::":
            k += 2
        if t[k] in _PATH and t[k + 1] == "!" and t[k + 2] in "([{" and self.in_items:
            self.i = k + 2
            brace = t[self.i] == "{"
            self.tree()
            if not brace:
                self.expect(";")
            return True
        return False

    in_items = True

    def function_ahead(self) -> bool:
        k, t = self.i, self.t
        while t[k] in ("async", "unsafe", "extern", "const", STR):
            k += 1
        return t[k] == "fn"

    def associated(self) -> None:
        self.expect("{")
        self.statements("}", self.item_only)
        self.expect("}")

    def use_tree(self) -> None:
        self.take("::")
        while True:
            if self.take("*"):
                return
            if self.take("{"):
                while not self.take("}"):
                    self.use_tree()
                    if self.t[self.i] != "}":
                        self.expect(",")
                return
            if self.t[self.i] not in _PATH:
                self.fail(f"expected a path, found {self.t[self.i]}")
            self.i += 1
            if not self.take("::"):
                break
        if self.take("as"):
            self.name()

    def function(self) -> None:
        self.expect("fn")
        self.name()
        self.generics()
        self.expect("(")
        while not self.take(")"):
            self.attributes()
            if self.take("..."):
                continue
            if not self.receiver():
                self.pattern()
                self.expect(":")
                self.type()
            if self.t[self.i] != ")":
                self.expect(",")
        if self.take("->"):
            self.type()
        self.where()
        if not self.take(";"):
            self.body()

    def receiver(self) -> bool:
        save = self.i
        if self.take("&"):
            if self.take("'"):
                pass
        self.take("mut")
        if self.take("self"):
            if self.take(":"):
                self.type()
            return True
        self.i = save
        return False

    def body(self) -> None:
        keep, self.ctx = self.ctx, 0
        lit, self.no_struct = self.no_struct, False
        items, self.in_items = self.in_items, False
        try:
            self.block()
        finally:
            self.ctx, self.no_struct, self.in_items = keep, lit, items

    def block(self) -> None:
        lit, self.no_struct = self.no_struct, False
        items, self.in_items = self.in_items, False
        self.expect("{")
        self.statements("}", self.statement)
        self.expect("}")
        self.no_struct, self.in_items = lit, items

    def fields(self) -> None:
        self.expect("{")
        while not self.take("}"):
            self.attributes()
            self.visibility()
            self.name()
            self.expect(":")
            self.type()
            if self.t[self.i] != "}":
                self.expect(",")

    def tuple_fields(self) -> None:
        self.expect("(")
        while not self.take(")"):
            self.attributes()
            self.visibility()
            self.type()
            if self.t[self.i] != ")":
                self.expect(",")

    def generics(self) -> None:
        if not self.take("<"):
            return
        while not self.take(">"):
            self.attributes()
            if self.take("'"):
                if self.take(":"):
                    self.bounds()
            elif self.take("const"):
                self.name()
                self.expect(":")
                self.type()
                if self.take("="):
                    self.unary()
            else:
                self.name()
                if self.take(":") and self.t[self.i] not in (",", ">", "="):
                    self.bounds()
                if self.take("="):
                    self.type()
            if self.t[self.i] != ">":
                self.expect(",")

    def where(self) -> None:
        if not self.take("where"):
            return
        while self.t[self.i] not in ("{", ";", "="):
            if not self.take("'"):
                if self.take("for"):
                    self.generics()
                self.type()
            self.expect(":")
            if self.t[self.i] not in (",", "{", ";"):
                self.bounds()
            if not self.take(","):
                return

    def bounds(self) -> None:
        while True:
            if self.take("'"):
                pass
            else:
                paren = self.take("(")
                self.take("?")
                self.take("~")
                if self.take("for"):
                    self.generics()
                self.type_path()
                if paren:
                    self.expect(")")
            if not self.take("+"):
                return

    def type(self) -> None:
        t = self.t
        x = t[self.i]
        if x in ("&", "&&"):
            self.i += 1
            self.take("'")
            self.take("mut")
            self.type()
            return
        if x == "*":
            self.i += 1
            if t[self.i] not in ("const", "mut"):
                self.fail()
            self.i += 1
            self.type()
        elif x == "(":
            self.i += 1
            while not self.take(")"):
                self.type()
                if self.take("+"):
                    self.bounds()
                if t[self.i] != ")":
                    self.expect(",")
        elif x == "[":
            self.i += 1
            self.type()
            if self.take(";"):
                self.expression()
            self.expect("]")
        elif x == "!":
            self.i += 1
        elif x in ("impl", "dyn"):
            self.i += 1
            self.bounds()
        elif x == "for":
            self.i += 1
            self.generics()
            self.type()
        elif x in ("fn", "unsafe", "extern"):
            while t[self.i] != "fn":
                if t[self.i] not in ("unsafe", "extern", STR):
                    self.fail()
                self.i += 1
            self.i += 1
            self.expect("(")
            while not self.take(")"):
                if t[self.i] == NAME and t[self.i + 1] == ":":
                    self.i += 2
                self.take("...")
                if t[self.i] != ")":
                    self.type()
                if t[self.i] != ")":
                    self.expect(",")
            if self.take("->"):
                self.type()
        else:
            self.type_path()

    def type_path(self) -> None:
        t = self.t
        if self.take("<"):
            self.type()
            if self.take("as"):
                self.type_path()
            self.close_angle()
            self.expect("::")
        else:
            self.take("::")
        while True:
            if t[self.i] not in _PATH:
                self.fail(f"expected a type, found {t[self.i]}")
            self.i += 1
            if t[self.i] == "!" and t[self.i + 1] in ("(", "[", "{"):
                self.i += 1
                self.tree()
                return
            if t[self.i] == "::" and t[self.i + 1] == "<":
                self.i += 1
            if t[self.i] == "<":
                self.type_arguments()
            elif t[self.i] == "(" and t[self.i - 1] == NAME:
                self.i += 1
                while not self.take(")"):
                    self.type()
                    if t[self.i] != ")":
                        self.expect(",")
                if self.take("->"):
                    self.type()
            if not (t[self.i] == "::" and t[self.i + 1] in _PATH):
                return
            self.i += 1

    def close_angle(self) -> None:
        self.expect(">")

    def type_arguments(self) -> None:
        self.expect("<")
        t = self.t
        while t[self.i] != ">":
            if self.take("'"):
                pass
            elif t[self.i] in (NUM, STR, "{", "-", "true", "false"):
                self.unary()
            elif t[self.i] == NAME and t[self.i + 1] == "=":
                self.i += 2
                self.type()
            elif t[self.i] == NAME and t[self.i + 1] == ":":
                self.i += 2
                self.bounds()
            else:
                self.type()
                if self.take("="):
                    self.type()
            if t[self.i] != ">":
                if t[self.i] == ">=":
                    break
                self.expect(",")
        self.close_angle()

    # patterns
    def pattern(self) -> None:
        self.take("|")
        self.pattern_one()
        while self.take("|"):
            self.pattern_one()

    def pattern_one(self) -> None:
        t = self.t
        x = t[self.i]
        if x in ("&", "&&"):
            self.i += 1
            self.take("mut")
            self.pattern_one()
        elif x in ("ref", "mut"):
            self.i += 1
            self.take("mut")
            self.name()
            if self.take("@"):
                self.pattern_one()
        elif x in ("(", "["):
            close = ")" if x == "(" else "]"
            self.i += 1
            while not self.take(close):
                self.pattern()
                if t[self.i] != close:
                    self.expect(",")
        elif x in (NUM, STR, "-", "true", "false"):
            self.take("-")
            self.i += 1
            self.range_end()
        elif x in ("..", "..="):
            self.i += 1
            if t[self.i] in (NUM, STR, "-") or t[self.i] in _PATH:
                self.take("-")
                self.i += 1
        elif x == "box":
            self.i += 1
            self.pattern_one()
        elif x in _PATH or x in ("<", "::"):
            self.path()
            if t[self.i] == "!" and t[self.i + 1] in ("(", "[", "{"):
                self.i += 1
                self.tree()
            elif self.take("@"):
                self.pattern_one()
            elif self.take("("):
                while not self.take(")"):
                    self.pattern()
                    if t[self.i] != ")":
                        self.expect(",")
            elif t[self.i] == "{":
                self.i += 1
                while not self.take("}"):
                    self.attributes()
                    if self.take(".."):
                        continue
                    while t[self.i] in ("ref", "mut"):
                        self.i += 1
                    if not self.take(NUM):
                        self.name()
                    if self.take(":"):
                        self.pattern()
                    if t[self.i] != "}":
                        self.expect(",")
            else:
                self.range_end()
        elif x == "const":
            self.i += 1
            self.block()
        else:
            self.fail(f"expected a pattern, found {x}")

    def range_end(self) -> None:
        if self.t[self.i] in ("..=", "..", "..."):
            self.i += 1
            if self.t[self.i] in (NUM, STR, "-") or self.t[self.i] in _PATH:
                self.take("-")
                if self.t[self.i] in _PATH:
                    self.path()
                else:
                    self.i += 1

    # statements
    def statement(self) -> None:
        t = self.t
        if self.take(";"):
            return
        self.attributes()
        x = t[self.i]
        if x == "let":
            self.let()
            return
        if x in ("fn", "pub", "use", "mod", "struct", "enum", "trait", "impl", "type", "static", "extern") or (x in ("const", "unsafe", "async") and (self.function_ahead() or t[self.i + 1] in ("impl", "trait", NAME, "mod") and x != "async")) or (x == "macro_rules" and t[self.i + 1] == "!") or (x == "union" and t[self.i + 1] == NAME):
            if not self.item():
                self.fail()
            return
        if t[self.i] == "}":
            return
        start = self.i
        blockish = x in _BLOCKISH or (x == "'" and t[self.i + 1] == ":") or (x == "async" and t[self.i + 1] in ("{", "move"))
        if blockish:
            self.primary_block()
            if t[self.i] in (".", "?") :
                self.i = start
                self.expression()
            else:
                self.take(";")
                return
        elif x in _PATH and self.macro_brace():
            if t[self.i] not in (".", "?"):
                self.take(";")
                return
            self.i = start
            self.expression()
        else:
            self.expression()
        if not self.take(";") and t[self.i] != "}":
            self.fail(f"expected ;, found {t[self.i]}")

    def macro_brace(self) -> bool:
        k, t = self.i, self.t
        while t[k] in _PATH and t[k + 1] == "::":
            k += 2
        if t[k] in _PATH and t[k + 1] == "!" and t[k + 2] == "{":
            self.i = k + 2
            self.tree()
            return True
        return False

    def let(self) -> None:
        self.i += 1
        self.pattern()
        if self.take(":"):
            self.type()
        if self.take("="):
            self.expression()
            if self.take("else"):
                self.block()
        self.expect(";")

    # expressions
    def expression(self) -> None:
        t = self.t
        x = t[self.i]
        if x in ("|", "||", "move") or (x in ("async", "static") and t[self.i + 1] in ("|", "||", "move")) and not (x == "async" and t[self.i + 1] == "move" and t[self.i + 2] == "{"):
            self.closure()
            return
        if x in ("return", "break"):
            if x == "break" and not self.ctx & LOOP:
                self.fail("break outside of a loop")
            self.i += 1
            if x == "break":
                self.take("'")
            if t[self.i] not in (";", "}", ")", ",", "]", "=>", END, "else"):
                self.expression()
            return
        if x in ("..", "..="):
            self.i += 1
            if t[self.i] not in (")", "]", "}", ";", ",", "=>", "{", END):
                self.binary(2)
            return
        self.binary(1)
        x = t[self.i]
        if x in _ASSIGN or (x == ">" and t[self.i + 1] == ">="):
            if t[self.i - 1] in (STR,) or (t[self.i - 1] == NUM and t[self.i - 2] != "."):
                self.fail("cannot assign to this expression")
            self.i += 2 if x == ">" else 1
            self.expression()

    def closure(self) -> None:
        while self.t[self.i] in ("move", "async", "static"):
            self.i += 1
        if not self.take("||"):
            self.expect("|")
            while not self.take("|"):
                self.pattern_one()
                if self.take(":"):
                    self.type()
                if self.t[self.i] != "|":
                    self.expect(",")
        if self.take("->"):
            self.type()
            self.block()
        else:
            self.expression()

    def binary(self, least: int) -> None:
        t = self.t
        self.unary()
        while True:
            x = t[self.i]
            power = _BINARY.get(x, 0)
            if power < least:
                return
            if x == "as":
                self.i += 1
                self.type()
                continue
            if x == ">":
                if t[self.i + 1] == ">=":
                    return
                if t[self.i + 1] == ">":
                    if 8 < least:
                        return
                    self.i += 2
                    self.binary(9)
                    continue
            self.i += 1
            if x in ("..", "..=") and t[self.i] in (")", "]", "}", ";", ",", "=>", END) or (x == ".." and t[self.i] == "{" and self.no_struct):
                return
            if t[self.i] in ("|", "||", "move") and x not in ("|",):
                self.closure()
                return
            self.binary(power + 1)

    def unary(self) -> None:
        t = self.t
        while t[self.i] in ("-", "!", "*", "&", "&&"):
            amp = t[self.i] in ("&", "&&")
            self.i += 1
            if amp:
                if t[self.i] == NAME and t[self.i + 1] in ("const", "mut") and False:
                    self.i += 2
                self.take("mut")
        if t[self.i] in ("|", "||", "move", "return", "break") and t[self.i] not in ("||",):
            self.expression()
            return
        self.primary()
        while True:
            x = t[self.i]
            if x == "?":
                self.i += 1
            elif x == ".":
                self.i += 1
                if self.take("await") or self.take(NUM):
                    continue
                if t[self.i] not in _PATH:
                    self.fail(f"expected a name, found {t[self.i]}")
                self.i += 1
                if t[self.i] == "::":
                    self.i += 1
                    self.type_arguments()
            elif x == "(":
                self.list(")")
            elif x == "[":
                self.i += 1
                keep, self.no_struct = self.no_struct, False
                self.expression()
                self.no_struct = keep
                self.expect("]")
            else:
                return

    def list(self, close: str) -> None:
        self.i += 1
        keep, self.no_struct = self.no_struct, False
        while not self.take(close):
            self.attributes()
            self.expression()
            if self.t[self.i] != close:
                self.expect(",")
        self.no_struct = keep

    def path(self) -> None:
        t = self.t
        if self.take("<"):
            self.type()
            if self.take("as"):
                self.type_path()
            self.close_angle()
            self.expect("::")
        else:
            self.take("::")
        while True:
            if t[self.i] not in _PATH:
                self.fail(f"expected a name, found {t[self.i]}")
            self.i += 1
            if t[self.i] != "::":
                return
            self.i += 1
            if t[self.i] == "<":
                self.type_arguments()
                if not self.take("::"):
                    return

    def inside_loop(self) -> None:
        keep = self.ctx
        self.ctx |= LOOP
        try:
            self.block()
        finally:
            self.ctx = keep

    def condition(self) -> None:
        keep, self.no_struct = self.no_struct, True
        while True:
            if self.take("let"):
                self.pattern()
                self.expect("=")
                self.binary(4)
            else:
                self.expression()
            if not self.take("&&"):
                break
        self.no_struct = keep

    def primary_block(self) -> None:
        t = self.t
        if self.take("'"):
            self.expect(":")
        x = t[self.i]
        if x == "{":
            self.block()
        elif x in ("unsafe", "const"):
            self.i += 1
            self.block()
        elif x == "async":
            self.i += 1
            self.take("move")
            self.block()
        elif x == "if":
            self.i += 1
            self.condition()
            self.block()
            if self.take("else"):
                if t[self.i] == "if":
                    self.primary_block()
                else:
                    self.block()
        elif x == "while":
            self.i += 1
            self.condition()
            self.inside_loop()
        elif x == "loop":
            self.i += 1
            self.inside_loop()
        elif x == "for":
            self.i += 1
            self.pattern()
            self.expect("in")
            keep, self.no_struct = self.no_struct, True
            self.expression()
            self.no_struct = keep
            self.inside_loop()
        elif x == "match":
            self.i += 1
            keep, self.no_struct = self.no_struct, True
            self.expression()
            self.no_struct = False
            self.expect("{")
            while not self.take("}"):
                self.attributes()
                self.pattern()
                if self.take("if"):
                    self.condition()
                    self.no_struct = False
                self.expect("=>")
                block = t[self.i] in ("{",) or t[self.i] in ("if", "match", "for", "while", "loop", "unsafe")
                self.expression()
                if not self.take(",") and t[self.i] != "}" and not (block and t[self.i - 1] == "}"):
                    self.fail(f"expected , found {t[self.i]}")
            self.no_struct = keep
        else:
            self.fail()

    def primary(self) -> None:
        t = self.t
        x = t[self.i]
        if x in (NUM, STR, "true", "false"):
            self.i += 1
        elif x == "(":
            self.list(")")
        elif x == "[":
            self.i += 1
            keep, self.no_struct = self.no_struct, False
            if t[self.i] != "]":
                self.expression()
                if self.take(";"):
                    self.expression()
                else:
                    while self.take(","):
                        if t[self.i] == "]":
                            break
                        self.expression()
            self.expect("]")
            self.no_struct = keep
        elif x in _BLOCKISH or x == "'" or (x in ("async", "const") and t[self.i + 1] in ("{", "move")):
            self.primary_block()
        elif x == "continue":
            if not self.ctx & LOOP:
                self.fail("continue outside of a loop")
            self.i += 1
            self.take("'")
        elif x in _PATH or x in ("::", "<"):
            self.path()
            if t[self.i] == "!" and t[self.i + 1] in ("(", "[", "{"):
                self.i += 1
                self.tree()
            elif t[self.i] == "{" and not self.no_struct:
                self.struct_literal()
        elif x == "let":
            self.i += 1
            self.pattern()
            self.expect("=")
            self.binary(4)
        else:
            self.fail()

    def struct_literal(self) -> None:
        self.expect("{")
        t = self.t
        while not self.take("}"):
            self.attributes()
            if self.take(".."):
                if t[self.i] != "}":
                    self.expression()
            else:
                if not self.take(NUM):
                    self.name()
                if self.take(":"):
                    self.expression()
            if t[self.i] != "}":
                self.expect(",")
