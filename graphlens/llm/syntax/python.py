"""Recursive-descent parser of Python 3 on logical lines, with an indentation stack."""

from __future__ import annotations

from graphlens.llm.syntax.lexing import END, NAME, NUM, STR, rules

_SOFT = frozenset(("match", "case", "type"))
_NAMES = _SOFT | {NAME}
#: Binding powers for precedence climbing, low to high.
_BINARY = {"|": 6, "^": 7, "&": 8, "<<": 9, ">>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "//": 11, "%": 11, "@": 11}
_COMPARE = frozenset(("<", ">", "<=", ">=", "==", "!=", "in", "is"))
_AUGMENTED = frozenset(("+=", "-=", "*=", "/=", "//=", "%=", "@=", "&=", "|=", "^=", ">>=", "<<=", "**="))
_ATOM_WORDS = frozenset(("True", "False", "None", "..."))


class Fault(Exception):
    pass


class Line:
    """One logical line. ``kind`` says what it is; ``target`` tells assignable expressions from others."""

    def __init__(self, tokens: list[str]):
        self.t, self.i, self.needs = [*tokens, END, END, END], 0, set()

    def fail(self, what: str = ""):
        raise Fault(what or f"unexpected {self.t[self.i]}")

    def take(self, x: str) -> bool:
        if self.t[self.i] == x:
            self.i += 1
            return True
        return False

    def expect(self, x: str) -> None:
        if self.t[self.i] != x:
            raise Fault(f"expected {x}, found {self.t[self.i]}")
        self.i += 1

    def name(self) -> None:
        if self.t[self.i] not in _NAMES:
            raise Fault(f"expected a name, found {self.t[self.i]}")
        self.i += 1

    # statements
    def line(self) -> str:
        t = self.t[self.i]
        method = getattr(self, "on_" + t, None) if t.isalpha() else None
        if t == "@":
            self.i += 1
            self.named()
            self.expect(END)
            return "decorator"
        if t in ("match", "case") or method is None or t not in _COMPOUND:
            if t in ("match", "case"):
                save = self.i
                try:
                    return self.soft_block(t)
                except Fault:
                    self.i, = (save,)
            self.simple_list()
            return "simple"
        kind = method()
        return self.colon(kind)

    def colon(self, kind: str) -> str:
        self.expect(":")
        if self.t[self.i] == END:
            return kind
        self.simple_list()
        return kind + "!"

    def soft_block(self, t: str) -> str:
        self.i += 1
        if t == "match":
            self.star_list(named=True)
            self.expect(":")
            self.expect(END)
            return "match"
        self.patterns()
        if self.take("if"):
            self.named()
        return self.colon("case")

    def patterns(self) -> None:
        self.pattern_as()
        while self.take(","):
            if self.t[self.i] in (":", "if"):
                break
            self.pattern_as()

    def pattern_as(self) -> None:
        self.pattern_one()
        while self.take("|"):
            self.pattern_one()
        if self.take("as"):
            self.name()

    def pattern_one(self) -> None:
        t = self.t[self.i]
        if t == "*":
            self.i += 1
            self.name()
        elif t in ("-", NUM):
            self.take("-")
            self.expect(NUM)
            if self.t[self.i] in ("+", "-"):
                self.i += 1
                self.expect(NUM)
        elif t == STR:
            while self.take(STR):
                pass
        elif t in ("True", "False", "None"):
            self.i += 1
        elif t in ("(", "["):
            close = ")" if t == "(" else "]"
            self.i += 1
            while self.t[self.i] != close:
                self.pattern_as()
                if not self.take(","):
                    break
            self.expect(close)
        elif t == "{":
            self.i += 1
            while self.t[self.i] != "}":
                if self.take("**"):
                    self.name()
                else:
                    self.primary()
                    self.expect(":")
                    self.pattern_as()
                if not self.take(","):
                    break
            self.expect("}")
        else:
            self.name()
            while self.take("."):
                self.name()
            if self.take("("):
                while self.t[self.i] != ")":
                    if self.t[self.i] in _NAMES and self.t[self.i + 1] == "=":
                        self.i += 2
                    self.pattern_as()
                    if not self.take(","):
                        break
                self.expect(")")

    def simple_list(self) -> None:
        self.simple()
        while self.take(";"):
            if self.t[self.i] == END:
                return
            self.simple()
        self.expect(END)

    def simple(self) -> None:
        t = self.t[self.i]
        if t == "pass":
            self.i += 1
        elif t in ("break", "continue"):
            self.i += 1
            self.needs.add("loop")
        elif t == "return":
            self.i += 1
            self.needs.add("function")
            if self.t[self.i] not in (END, ";"):
                self.star_list()
        elif t == "raise":
            self.i += 1
            if self.t[self.i] not in (END, ";"):
                self.test()
                if self.take("from"):
                    self.test()
        elif t in ("global", "nonlocal"):
            self.i += 1
            self.name()
            while self.take(","):
                self.name()
        elif t == "del":
            self.i += 1
            start = self.i
            self.star_list()
            self.assignable(start, self.i, delete=True)
        elif t == "assert":
            self.i += 1
            self.test()
            if self.take(","):
                self.test()
        elif t == "import":
            self.i += 1
            self.dotted_as()
            while self.take(","):
                self.dotted_as()
        elif t == "from":
            self.i += 1
            dots = False
            while self.t[self.i] in (".", "..."):
                self.i += 1
                dots = True
            if not (dots and self.t[self.i] == "import"):
                self.dotted()
            self.expect("import")
            if self.take("*"):
                return
            paren = self.take("(")
            while True:
                self.name()
                if self.take("as"):
                    self.name()
                if not self.take(","):
                    break
                if paren and self.t[self.i] == ")":
                    break
            if paren:
                self.expect(")")
        elif t == "type" and self.t[self.i + 1] in _NAMES and self.t[self.i + 2] in ("=", "["):
            self.i += 2
            self.type_params()
            self.expect("=")
            self.test()
        else:
            self.expression_statement()

    def expression_statement(self) -> None:
        start = self.i
        self.star_list(yields=True)
        t = self.t[self.i]
        if t == ":":
            self.assignable(start, self.i, single=True)
            self.i += 1
            self.test()
            if self.take("="):
                self.star_list(yields=True)
        elif t in _AUGMENTED:
            self.assignable(start, self.i, single=True)
            self.i += 1
            self.star_list(yields=True)
        else:
            while self.t[self.i] == "=":
                self.assignable(start, self.i)
                self.i += 1
                start = self.i
                self.star_list(yields=True)

    def assignable(self, start: int, end: int, single: bool = False, delete: bool = False) -> None:
        """Whether tokens [start, end), already a valid expression, may be assigned to."""
        depth, part = 0, start
        parts = []
        for k in range(start, end):
            t = self.t[k]
            if t in "([{":
                depth += 1
            elif t in ")]}":
                depth -= 1
            elif t == "," and not depth:
                parts.append((part, k))
                part = k + 1
        if part < end:
            parts.append((part, end))
        if single and len(parts) > 1 or not parts:
            self.fail("cannot assign to this expression")
        for a, b in parts:
            if self.t[a] == "*" and not single and not delete:
                a += 1
            first, last = self.t[a], self.t[b - 1]
            if first in "([" and self.closes(a) == b - 1:
                if b - a == 2:
                    if single:
                        self.fail("cannot assign to this expression")
                    continue
                if single and first == "[":
                    self.fail("cannot assign to this expression")
                self.assignable(a + 1, b - 1, single=single, delete=delete)
                continue
            depth = 0
            for k in range(a, b):
                t = self.t[k]
                if t in ")]}":
                    depth -= 1
                elif t in "([{":
                    depth += 1
                elif not depth and t not in _NAMES and t not in (".", STR, "await"):
                    self.fail("cannot assign to this expression")
            if last == ")" or last == "}" or last == STR or last == NUM or (b - a == 1 and first not in _NAMES):
                self.fail("cannot assign to this expression")

    def closes(self, a: int) -> int:
        depth = 0
        for k in range(a, len(self.t)):
            if self.t[k] in "([{":
                depth += 1
            elif self.t[k] in ")]}":
                depth -= 1
                if not depth:
                    return k
        return -1

    def dotted(self) -> None:
        self.name()
        while self.take("."):
            self.name()

    def dotted_as(self) -> None:
        self.dotted()
        if self.take("as"):
            self.name()

    # compound headers
    def on_if(self):
        self.i += 1
        self.named()
        return "if"

    def on_elif(self):
        self.i += 1
        self.named()
        return "elif"

    def on_while(self):
        self.i += 1
        self.named()
        return "while"

    def on_else(self):
        self.i += 1
        return "else"

    def on_try(self):
        self.i += 1
        return "try"

    def on_finally(self):
        self.i += 1
        return "finally"

    def on_except(self):
        self.i += 1
        self.take("*")
        if self.t[self.i] != ":":
            self.test()
            if self.take("as"):
                self.name()
            else:
                while self.take(","):
                    self.fail("multiple exception types must be parenthesized")
        return "except"

    def on_for(self):
        self.i += 1
        start = self.i
        self.targets()
        self.assignable(start, self.i)
        self.expect("in")
        self.star_list()
        return "for"

    def targets(self) -> None:
        while True:
            self.take("*")
            self.unary(no_in=True)
            if not self.take(",") or self.t[self.i] == "in":
                return

    def on_with(self):
        self.i += 1
        save = self.i
        if self.take("("):
            try:
                while self.t[self.i] != ")":
                    self.with_item()
                    if not self.take(","):
                        break
                self.expect(")")
                if self.t[self.i] == ":":
                    return "with"
            except Fault:
                pass
            self.i = save
        self.with_item()
        while self.take(","):
            self.with_item()
        return "with"

    def with_item(self) -> None:
        self.test()
        if self.take("as"):
            start = self.i
            self.take("*")
            self.unary()
            self.assignable(start, self.i)

    def on_async(self):
        self.i += 1
        t = self.t[self.i]
        if t == "def":
            return "async " + self.on_def()
        if t == "for":
            return self.on_for()
        if t == "with":
            return self.on_with()
        self.fail()

    def on_def(self):
        self.i += 1
        self.name()
        self.type_params()
        self.expect("(")
        self.params(")", True)
        self.expect(")")
        if self.take("->"):
            self.star_list()
        return "def"

    def on_class(self):
        self.i += 1
        self.name()
        self.type_params()
        if self.take("("):
            self.arguments()
        return "class"

    def type_params(self) -> None:
        if self.take("["):
            while self.t[self.i] != "]":
                if not self.take("*"):
                    self.take("**")
                self.name()
                if self.take(":"):
                    self.test()
                if self.take("="):
                    self.test()
                if not self.take(","):
                    break
            self.expect("]")

    def params(self, close: str, typed: bool) -> None:
        slash = star = default = False
        while self.t[self.i] != close:
            if self.take("/"):
                if slash or star:
                    self.fail("misplaced /")
                slash = True
            elif self.take("**"):
                self.name()
                if typed and self.take(":"):
                    self.test()
                self.take(",")
                if self.t[self.i] != close:
                    self.fail("arguments cannot follow var-keyword argument")
                return
            elif self.take("*"):
                if star:
                    self.fail("* may appear only once")
                star, default = True, False
                if self.t[self.i] in _NAMES:
                    self.i += 1
                    if typed and self.take(":"):
                        self.take("*")
                        self.test()
                elif self.t[self.i] != "," or self.t[self.i + 1] == close:
                    self.fail("named arguments must follow bare *")
            else:
                self.name()
                if typed and self.take(":"):
                    self.test()
                if self.take("="):
                    self.test()
                    default = True
                elif default and not star:
                    self.fail("parameter without a default follows parameter with a default")
            if not self.take(","):
                return

    # expressions
    def star_list(self, yields: bool = False, named: bool = False) -> None:
        if yields and self.t[self.i] == "yield":
            self.yield_expr()
            return
        while True:
            if self.take("*"):
                self.binary(6)
            elif named:
                self.named()
            else:
                self.test()
            if not self.take(","):
                return
            if self.t[self.i] in _LIST_ENDS:
                return

    def yield_expr(self) -> None:
        self.i += 1
        self.needs.add("function")
        if self.take("from"):
            self.test()
        elif self.t[self.i] not in _LIST_ENDS:
            self.star_list()

    def named(self) -> None:
        if self.t[self.i] in _NAMES and self.t[self.i + 1] == ":=":
            self.i += 2
        self.test()

    def test(self) -> None:
        if self.t[self.i] == "lambda":
            self.i += 1
            self.params(":", False)
            self.expect(":")
            self.test()
            return
        self.disjunction()
        if self.take("if"):
            self.disjunction()
            self.expect("else")
            self.test()

    def disjunction(self) -> None:
        while True:
            while self.take("not"):
                pass
            self.comparison()
            if self.t[self.i] in ("or", "and"):
                self.i += 1
                continue
            return

    def comparison(self) -> None:
        self.binary(6)
        while True:
            t = self.t[self.i]
            if t in _COMPARE:
                self.i += 1
                if t == "is":
                    self.take("not")
            elif t == "not" and self.t[self.i + 1] == "in":
                self.i += 2
            else:
                return
            self.binary(6)

    def binary(self, least: int) -> None:
        self.unary()
        while True:
            power = _BINARY.get(self.t[self.i], 0)
            if power < least:
                return
            self.i += 1
            self.binary(power + 1)

    def unary(self, no_in: bool = False) -> None:
        while self.t[self.i] in ("+", "-", "~"):
            self.i += 1
        if self.take("await"):
            self.needs.add("function")
        self.primary()
        if self.take("**"):
            self.unary()

    def primary(self) -> None:
        self.atom()
        while True:
            t = self.t[self.i]
            if t == "(":
                self.i += 1
                self.arguments()
            elif t == ".":
                self.i += 1
                self.name()
            elif t == "[":
                self.i += 1
                self.subscript()
            else:
                return

    def arguments(self) -> None:
        keyword = False
        count = 0
        while self.t[self.i] != ")":
            if self.take("**"):
                self.test()
                keyword = True
            elif self.take("*"):
                self.test()
            elif self.t[self.i] in _NAMES and self.t[self.i + 1] == "=":
                self.i += 2
                self.test()
                keyword = True
            else:
                self.named()
                if self.t[self.i] in ("for", "async"):
                    self.comprehension()
                    if count or self.t[self.i] not in (")", ",") or self.t[self.i] == "," and self.t[self.i + 1] != ")":
                        self.fail("generator expression must be parenthesized")
                elif keyword:
                    self.fail("positional argument follows keyword argument")
            count += 1
            if not self.take(","):
                break
        self.expect(")")

    def subscript(self) -> None:
        while True:
            if not self.take("*"):
                if self.t[self.i] != ":":
                    self.named()
                for _ in range(2):
                    if self.take(":") and self.t[self.i] not in (":", ",", "]"):
                        self.test()
            else:
                self.binary(6)
            if not self.take(",") or self.t[self.i] == "]":
                break
        self.expect("]")

    def atom(self) -> None:
        t = self.t[self.i]
        if t in _NAMES or t == NUM or t in _ATOM_WORDS:
            self.i += 1
        elif t == STR:
            while self.t[self.i] == STR:
                self.i += 1
        elif t == "(":
            self.i += 1
            if self.t[self.i] == "yield":
                self.yield_expr()
            elif self.t[self.i] != ")":
                self.display(")")
            self.expect(")")
        elif t == "[":
            self.i += 1
            if self.t[self.i] != "]":
                self.display("]")
            self.expect("]")
        elif t == "{":
            self.i += 1
            if self.t[self.i] != "}":
                self.braces()
            self.expect("}")
        else:
            self.fail()

    def display(self, close: str) -> None:
        first = True
        while True:
            if self.take("*"):
                self.binary(6)
            else:
                self.named()
                if first and self.t[self.i] in ("for", "async"):
                    self.comprehension()
                    return
            first = False
            if not self.take(",") or self.t[self.i] == close:
                return

    def braces(self) -> None:
        first, pairs = True, None
        while True:
            if self.take("**"):
                self.binary(6)
                is_pair = True
            elif self.take("*"):
                self.binary(6)
                is_pair = False
            else:
                self.named()
                is_pair = self.take(":")
                if is_pair:
                    self.test()
                if first and self.t[self.i] in ("for", "async"):
                    self.comprehension()
                    return
            if pairs is not None and pairs != is_pair:
                self.fail("mixed set and dict")
            pairs, first = is_pair, False
            if not self.take(",") or self.t[self.i] == "}":
                return

    def comprehension(self) -> None:
        while self.t[self.i] in ("for", "async"):
            self.take("async")
            self.expect("for")
            start = self.i
            self.targets()
            self.assignable(start, self.i)
            self.expect("in")
            self.disjunction()
            while self.take("if"):
                self.disjunction()


_COMPOUND = frozenset(("if", "elif", "while", "else", "try", "finally", "except", "for", "with", "async", "def", "class"))
_LIST_ENDS = frozenset((END, ";", ")", "]", "}", ":", "=", "in")) | _AUGMENTED
_LINES: dict[str, tuple] = {}
MEMO = 400_000


def _classify(shape: str, r) -> tuple:
    tokens = r.tokens.findall(shape)
    depth = sum((t in "([{") - (t in ")]}") for t in tokens)
    if depth > 0:
        return ("open", depth, None)
    line = Line(tokens)
    try:
        kind = line.line()
        return (kind, 0, frozenset(line.needs))
    except Fault as e:
        return ("error", 0, str(e))
    except RecursionError:
        return ("error", 0, "nested too deeply")


def parse(lines: list[str]) -> list[tuple[int, str]]:
    """(line number within ``lines`` from 0, cause) of every error."""
    r = rules("python")
    errors: list[tuple[int, str]] = []
    # (indent, function, loop, what may follow: the last header on this level)
    stack: list[list] = [[0, False, False, ""]]
    wants = None  # header that waits for its block
    wants_line = 0
    decorated = False
    at, n = 0, len(lines)
    while at < n:
        raw = lines[at]
        shape = raw.strip()
        if not shape:
            at += 1
            continue
        here = at
        got = _LINES.get(shape)
        if got is None:
            got = _classify(shape, r)
            if len(shape) < 300 and len(_LINES) < MEMO:
                _LINES[shape] = got
        if got[0] == "open":
            depth, parts = got[1], [shape]
            while depth > 0 and at + 1 < n:
                at += 1
                more = lines[at].strip()
                if more:
                    parts.append(more)
                    depth += more.count("(") + more.count("[") + more.count("{") - more.count(")") - more.count("]") - more.count("}")
                    if depth > 0 and _begins_anew(more, lines[at]) and _never_closes(lines, at, depth):
                        break
            shape = " ".join(parts)
            got = _LINES.get(shape) if len(shape) < 300 else None
            if got is None:
                got = _classify(shape, r)
                if len(shape) < 300 and len(_LINES) < MEMO:
                    _LINES[shape] = got
            if got[0] == "open":
                got = ("error", 0, "bracket was never closed")
        at += 1
        body = raw.lstrip(" \t")
        gap = raw[: len(raw) - len(body)]
        indent = len(gap.expandtabs(8)) if "\t" in gap else len(gap)
        kind = got[0]
        if wants is not None:
            if indent > stack[-1][0]:
                up = stack[-1]
                word = wants.split()[-1]
                function = word == "def" or (up[1] and word != "class")
                loop = word in ("for", "while") or (up[2] and word not in ("def", "class"))
                stack.append([indent, function, loop, "match" if word == "match" else ""])
            else:
                errors.append((here, f"expected an indented block after {wants}"))
            wants = None
        elif indent > stack[-1][0]:
            errors.append((here, "unexpected indent"))
            stack.append([indent, stack[-1][1], stack[-1][2], ""])
        while indent < stack[-1][0]:
            stack.pop()
        if indent != stack[-1][0]:
            errors.append((here, "unindent does not match any outer level"))
            stack.append([indent, stack[-1][1], stack[-1][2], ""])
        level = stack[-1]
        if kind == "error":
            errors.append((here, got[2]))
            decorated = False
            level[3] = "?"
            continue
        if decorated and kind not in ("decorator", "def", "class", "async def", "def!", "class!", "async def!"):
            errors.append((here, "a decorator needs a function or class"))
        decorated = kind == "decorator"
        needs = got[2]
        if needs:
            inside = kind in ("def!", "async def!")
            if "function" in needs and not level[1] and not inside:
                errors.append((here, "outside function"))
            if "loop" in needs and not level[2] and kind not in ("for!", "while!"):
                errors.append((here, "outside loop"))
        word = kind[:-1] if kind.endswith("!") else kind
        before = level[3]
        if word in ("elif", "else", "except", "finally", "case"):
            allowed = {"elif": ("if", "elif", "?"), "else": ("if", "elif", "for", "while", "except", "?"), "except": ("try", "except", "?"), "finally": ("try", "except", "tryelse", "?"), "case": ("match", "case", "?")}[word]
            if before not in allowed:
                errors.append((here, f"{word} without its beginning"))
            level[3] = "tryelse" if word == "else" and before == "except" else word if word in ("elif", "except", "case") else ""
        else:
            if before in ("try",):
                errors.append((here, "try without except or finally"))
            elif before == "match" and word != "case":
                errors.append((here, "expected case"))
            level[3] = word if word in ("if", "for", "while", "try") else ""
        if kind in _BLOCKS:
            wants, wants_line = kind, here
    if wants is not None:
        errors.append((wants_line, f"expected an indented block after {wants}"))
    if decorated:
        errors.append((n - 1, "a decorator needs a function or class"))
    if any(level[3] == "try" for level in stack):
        errors.append((n - 1, "try without except or finally"))
    return errors


_BLOCKS = frozenset(("if", "elif", "else", "for", "while", "try", "except", "finally", "with", "def", "async def", "class", "match", "case"))
_ANEW = ("def ", "class ", "return", "if ", "for ", "while ", "import ", "from ", "async ", "with ", "try:")


def _begins_anew(shape: str, raw: str) -> bool:
    return shape.startswith(_ANEW)


def _never_closes(lines: list[str], at: int, depth: int) -> bool:
    """Panic-mode recovery: a statement keyword begins a line inside a bracket; does the bracket ever close?"""
    for k in range(at + 1, len(lines)):
        s = lines[k]
        depth += s.count("(") + s.count("[") + s.count("{") - s.count(")") - s.count("]") - s.count("}")
        if depth <= 0:
            return False
    return True
