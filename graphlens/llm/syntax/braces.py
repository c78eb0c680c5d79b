"""What the parsers of languages with braces share: tokens, recovery and the memory of line shapes.

A statement that fills whole lines and was accepted once is accepted again
wherever the same shapes stand in the same context; only what was not seen
before is parsed token by token.
"""

from __future__ import annotations

from graphlens.llm.syntax.lexing import END, NAME, rules

MEMO = 300_000


class Fault(Exception):
    pass


class Parser:
    lang = ""
    #: token tuples by line shape, and accepted lines by context; shared by all files a worker reads
    tokens_of: dict[str, tuple]
    accepted: dict[tuple, int]
    names = frozenset((NAME,))

    def __init__(self, lines: list[str], ctx: int = 0):
        self.errors: list[tuple[int, str]] = []
        self.ctx = ctx
        self.t: list[str] = []
        self.starts: list[int] = []
        self.at: dict[int, int] = {}
        self.lines: list[str] = []
        self.numbers: list[int] = []
        find, memo = rules(self.lang).tokens.findall, self.tokens_of
        for n, raw in enumerate(lines):
            shape = raw.strip()
            if not shape:
                continue
            if len(shape) > 160:
                pieces = self.pieces(shape)
            else:
                pieces = (shape,)
            for k, piece in enumerate(pieces):
                got = memo.get(piece)
                if got is None:
                    got = self.line_tokens(find(piece))
                    if len(memo) < MEMO and len(piece) < 300:
                        memo[piece] = got
                if got:
                    self.at[len(self.t)] = len(self.lines)
                    self.starts.append(len(self.t) if k == 0 else -1)
                    self.lines.append(piece)
                    self.numbers.append(n)
                    self.t.extend(got)
        self.first_of = list(self.at)
        self.first_of.append(len(self.t))
        self.t.extend((END,) * 4)
        self.i = 0
        self.last_line = len(lines) - 1

    def pieces(self, shape: str) -> list[str]:
        """A long line in pieces that end with ; or }, so that what repeats within it is known again."""
        out, begin = [], 0
        for m in rules(self.lang).tokens.finditer(shape):
            if m.group() in ";}" and m.end() - begin > 12:
                out.append(shape[begin : m.end()])
                begin = m.end()
        out.append(shape[begin:])
        return [p.strip() for p in out if p.strip()]

    def line_tokens(self, tokens: list[str]) -> tuple:
        return tuple(tokens)

    # reading tokens
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
        if self.t[self.i] not in self.names:
            raise Fault(f"expected a name, found {self.t[self.i]}")
        self.i += 1

    def line_number(self, i: int) -> int:
        from bisect import bisect_right

        k = bisect_right(self.first_of, min(i, len(self.t) - 4)) - 1
        return self.numbers[k] if k < len(self.numbers) else self.last_line

    def starts_line(self, i: int) -> bool:
        """Whether a line break stands before token i."""
        n = self.at.get(i)
        return (n is not None and self.starts[n] >= 0) or self.t[i] == END

    # statements
    def statements(self, close: str, one) -> None:
        """Statements up to ``close``; after a fault, panic mode skips to where a statement may begin."""
        t, at, accepted, first = self.t, self.at, self.accepted, self.first_of
        while True:
            i = self.i
            if t[i] == close or t[i] == END:
                return
            n = at.get(i)
            if n is not None:
                took = accepted.get((self.ctx, one.__name__, self.lines[n]))
                if took == 1:
                    self.i = first[n + 1]
                    continue
                if n + 2 < len(self.lines) and t[first[n + 3]] not in _FOLLOW:
                    if (self.ctx, one.__name__, self.lines[n], self.lines[n + 1], self.lines[n + 2]) in accepted:
                        self.i = first[n + 3]
                        continue
            faults = len(self.errors)
            try:
                one()
            except Fault as e:
                self.errors.append((self.line_number(self.i), str(e)))
                self.recover(i, close)
                continue
            except RecursionError:
                self.errors.append((self.line_number(i), "nested too deeply"))
                self.recover(i, close)
                continue
            if self.i == i:
                self.errors.append((self.line_number(i), f"unexpected {t[i]}"))
                self.recover(i, close)
            elif n is not None and len(self.errors) == faults and t[self.i - 1] in ";}":
                m = at.get(self.i)
                if m is None and t[self.i] == END:
                    m = len(self.lines)
                if m is not None and len(accepted) < MEMO:
                    if m == n + 1 and t[self.i - 1] == ";":
                        accepted[(self.ctx, one.__name__, self.lines[n])] = 1
                    elif m == n + 3 and self.lines[n].endswith("{"):
                        accepted[(self.ctx, one.__name__, self.lines[n], self.lines[n + 1], self.lines[n + 2])] = 3

    def recover(self, began: int, close: str) -> None:
        depth, i, t = 0, max(self.i, began + 1), self.t
        while t[i] != END:
            x = t[i]
            if x in "{([":
                depth += 1
            elif x in ")]}":
                if x == "}" and depth <= 0:
                    break
                depth -= 1
            elif x == ";" and depth <= 0:
                i += 1
                break
            elif depth <= 0 and i in self.at and x in self.anew:
                break
            i += 1
        self.i = i if i > began else began + 1

    anew: frozenset = frozenset()


_FOLLOW = frozenset(("else", "catch", "finally", "while", ".", "(", "[", "?", ",", "=", "+", "-", "as"))
