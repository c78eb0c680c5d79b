"""From source text to line shapes: strings, comments, names and numbers become single letters.

Syntax does not depend on how names are spelled, so after this step the same
few thousand shapes make up most lines of a corpus, and what a parser found
out about one need not be found out again.
"""

from __future__ import annotations

import re

NAME, NUM, STR = "a", "1", '"'
END = "<end>"

_STRING = r"\"(?:[^\"\\\r\n]|\\(?:\r\n|[\s\S]))*\"|'(?:[^'\\\r\n]|\\(?:\r\n|[\s\S]))*'"
_PY_PREFIX = r"(?:(?<![\w])(?:[rR][bBfFtT]?|[bB][rR]?|[uU]|[fFtT][rR]?))?"
_SCANS = {
    "python": rf"(?P<c>\#[^\r\n]*)|(?P<j>\\\r?\n)|(?P<s>{_PY_PREFIX}(?:\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'''(?:[^\\]|\\[\s\S])*?'''|(?!\"\"\"|''')(?:{_STRING})))|(?P<x>[\"'])",
    "javascript": rf"(?P<c>//[^\r\n]*|/\*[\s\S]*?\*/)|(?P<s>{_STRING})|(?P<t>`)|(?P<r>(?:(?<=[=(,:;!&|?{{\[+\-*%~^\r\n])|(?<=return)|(?<=typeof)|(?<=case)|(?<=^))[ \t]*/(?![*/])(?:[^/\\\r\n\[]|\\.|\[(?:[^\]\\\r\n]|\\.)*\])+/[a-z]*)|(?P<x>[\"']|/\*)",
    "java": rf"(?P<c>//[^\r\n]*|/\*[\s\S]*?\*/)|(?P<s>\"\"\"[ \t]*\r?\n(?:[^\\]|\\[\s\S])*?\"\"\"|(?!\"\"\"[ \t]*\r?\n)\"(?:[^\"\\\r\n]|\\.)*\"|'(?:[^'\\\r\n]|\\(?:u+[0-9a-fA-F]{{4}}|[0-7]{{1,3}}|.))')|(?P<x>[\"']|/\*)",
    "go": r"(?P<c>//[^\r\n]*|/\*[\s\S]*?\*/)|(?P<s>\"(?:[^\"\\\r\n]|\\.)*\"|`[^`]*`|'(?:[^'\\\r\n]|\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3}|.))')|(?P<x>[\"'`]|/\*)",
    "rust": r"(?P<c>//[^\r\n]*)|(?P<n>/\*)|(?P<s>(?:(?<!\w)b?r(?P<h>\#*)\"[\s\S]*?\"(?P=h)(?!\#))|(?:(?<!\w)[bc])?\"(?:[^\"\\]|\\[\s\S])*\"|(?:(?<!\w)b)?'(?:[^'\\\r\n]|\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]+\}|.))')|(?P<l>'(?:[^\W\d]\w*))|(?P<x>[\"'])",
}
KEYWORDS = {
    "python": "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match case type",
    "javascript": "await async break case catch class const continue debugger default delete do else enum export extends false finally for function if implements import in instanceof interface let new null of return static super switch this throw true try typeof var void while with yield get set as from type declare namespace module abstract readonly public private protected keyof infer is asserts satisfies unique override accessor constructor require target global out",
    "java": "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null record sealed permits yield non when open module with",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "rust": "as break const continue crate else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while async await dyn union macro_rules",
}
_NUMBERS = {
    "python": r"(?:0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*[eE][+-]?\d(?:_?\d)*[jJ]?|0(?:_?0)*[jJ]?(?!\d)|[1-9](?:_?\d)*[jJ]?|\d+[jJ])",
    "javascript": r"(?:0[xX][\da-fA-F]+(?:_[\da-fA-F]+)*n?|0[oO][0-7]+(?:_[0-7]+)*n?|0[bB][01]+(?:_[01]+)*n?|(?:\d+(?:_\d+)*)?\.\d+(?:_\d+)*(?:[eE][+-]?\d+)?|\d+(?:_\d+)*\.?(?:[eE][+-]?\d+)?n?)",
    "java": r"(?:0[xX][\da-fA-F_]*\.?[\da-fA-F_]*(?:[pP][+-]?\d+)?[lLfFdD]?|0[bB][01_]+[lL]?|(?:\d[\d_]*)?\.\d[\d_]*(?:[eE][+-]?\d+)?[fFdD]?|\d[\d_]*\.?(?:[eE][+-]?\d+)?[lLfFdD]?)",
    "go": r"(?:0[xX][\da-fA-F_]+(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?i?|0[bB][01_]+i?|0[oO][0-7_]+i?|(?:\d[\d_]*)?\.\d[\d_]*(?:[eE][+-]?\d+)?i?|\d[\d_]*\.?(?:[eE][+-]?\d+)?i?)",
    "rust": r"(?:0x[\da-fA-F_]+(?:[iu](?:8|16|32|64|128|size))?|0b[01_]+(?:[iu](?:8|16|32|64|128|size))?|0o[0-7_]+(?:[iu](?:8|16|32|64|128|size))?|\d[\d_]*(?:\.\d[\d_]*|\.(?![.\w]))?(?:[eE][+-]?[\d_]+)?(?:[iuf](?:8|16|32|64|128|size))?)",
}
_EXTRA = {"javascript": "$", "java": "$", "python": "", "go": "", "rust": ""}
_OPERATORS = {
    "python": r"\*\*=|//=|>>=|<<=|\.\.\.|\*\*|//|>>|<<|<=|>=|==|!=|->|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|[-+*/%@&|^~<>()\[\]{},:.;=]",
    "javascript": r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\*\*|<<|[-+*/%&|^!~?:=<>()\[\]{},.;@#]",
    "java": r">>>=|<<=|>>=|\.\.\.|->|::|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|[-+*/%&|^!~?:=<>()\[\]{},.;@]",
    "go": r"<<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[-+*/%&|^!<>=()\[\]{},;.:~]",
    "rust": r"<<=|>>=|\.\.\.|\.\.=|::|->|=>|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\.\.|<<|[-+*/%&|^!<>=()\[\]{},;.:@#$?~]",
}
_RISKY_SPLIT = {"python": False, "javascript": True, "java": True, "go": True, "rust": True}
LANGUAGES = {"py": "python", "pyi": "python", "pyw": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "javascript", "mts": "javascript", "cts": "javascript", "tsx": "javascript", "java": "java", "go": "go", "rs": "rust"}


class Rules:
    """Compiled patterns of one language."""

    def __init__(self, lang: str):
        words = sorted(KEYWORDS[lang].split(), key=len, reverse=True)
        extra = _EXTRA[lang]
        self.lang = lang
        self.scan = re.compile(_SCANS[lang])
        self.keywords = frozenset(words)
        self.names = re.compile(rf"(?<![\w{extra}])(?!(?:{'|'.join(words)})(?![\w{extra}]))(?:[^\W\d]|[{extra}_])[\w{extra}]*")
        self.numbers = re.compile(rf"(?<![\w{extra}]){_NUMBERS[lang]}")
        self.tokens = re.compile(rf"{_OPERATORS[lang]}|[\w{extra}]+|\S")
        # Literal data is as valid long as short. A list is one only behind what an expression must follow, as
        # behind a name, a literal or a closing bracket it is a subscript, and before ':' or '(' it is a key.
        one, behind = rf"[-+]?(?:{NUM}|{STR})", r"(?=\s*[,\])}])"
        self.run = re.compile(rf"(?<=[\[({{,])(\s*){one}(?:\s*,\s*{one}){{3,}}{behind}")
        listed = rf"(?<=[=(\[,:])(\s*)\[\s*{one}(?:\s*,\s*{one})*\s*,?\s*\](?=\s*[,\])}};]|\s*\n)"
        self.list = re.compile(listed) if lang in ("python", "javascript", "rust") else None
        pair = rf"{STR}\s*:\s*{one}"
        self.dict = re.compile(rf'(?:(?<=[\[,(=])|(?<=":))(\s*)\{{\s*{pair}(?:\s*,\s*{pair})*\s*,?\s*\}}{behind}') if lang in ("python", "javascript") else None


_RULES: dict[str, Rules] = {}


def rules(lang: str) -> Rules:
    if lang not in _RULES:
        _RULES[lang] = Rules(lang)
    return _RULES[lang]


def _nested_comment(text: str, at: int) -> int:
    depth, i = 1, at + 2
    for m in re.compile(r"/\*|\*/").finditer(text, i):
        depth += 1 if m.group() == "/*" else -1
        if not depth:
            return m.end()
    return -1


def _template(text: str, at: int, inner: list[str]) -> int:
    """End of a template literal that begins at ``at``; its embedded expressions go to ``inner``."""
    i, n = at + 1, len(text)
    while i < n:
        c = text[i]
        if c == "\\":
            i += 2
        elif c == "`":
            return i + 1
        elif c == "$" and text[i + 1 : i + 2] == "{":
            depth, j = 1, i + 2
            while j < n and depth:
                d = text[j]
                if d == "`":
                    j = _template(text, j, [])
                    if j < 0:
                        return -1
                    continue
                if d in "\"'":
                    m = rules("javascript").scan.match(text, j)
                    if not m or m.lastgroup == "x":
                        return -1
                    j = m.end()
                    continue
                depth += (d == "{") - (d == "}")
                j += 1
            if depth:
                return -1
            inner.append(text[i + 2 : j - 1])
            i = j
        else:
            i += 1
    return -1


def strip(text: str, lang: str) -> tuple[str, list[tuple[int, str]], list[str]]:
    """(code, faults, embedded): comments removed and literals replaced; faults are (offset, cause)."""
    scan = rules(lang).scan
    out: list[str] = []
    faults: list[tuple[int, str]] = []
    inner: list[str] = []
    pos = 0
    m = scan.search(text)
    while m:
        kind, start, end = m.lastgroup, m.start(), m.end()
        if kind == "h":
            kind = "s"
        out.append(text[pos:start])
        if kind == "s":
            out.append(STR)
        elif kind == "c":
            out.append("\n" if lang in ("javascript", "go") and "\n" in text[start:end] else " ")
        elif kind == "j":
            out.append(" ")
        elif kind == "l":
            out.append("'")
        elif kind == "r":
            out.append(" " + STR)
        elif kind == "t":
            end = _template(text, start, inner)
            out.append("`")
        elif kind == "n":
            end = _nested_comment(text, start)
            out.append(" ")
        if kind == "x" or end < 0:
            faults.append((start, "unterminated comment" if text[start] == "/" else "unterminated string"))
            # go on behind the line, as the rest of it cannot be told apart
            stop = text.find("\n", start)
            end = len(text) if stop < 0 or text[start] in "/`" else stop
            out.append(STR)
        pos = end
        m = scan.search(text, pos)
    out.append(text[pos:])
    return "".join(out), faults, inner


def line_of(text: str, offset: int) -> int:
    return text.count("\n", 0, offset) + 1


def shapes(text: str, lang: str) -> tuple[list[str], list[tuple[int, str]], list[str]]:
    """(lines, faults, embedded) of a text; a leading byte-order mark and a first line of '#!' are no code."""
    if text.startswith("﻿"):
        text = text[1:]
    if text.startswith("#!") and lang in ("javascript", "rust") and not text.startswith("#!["):
        text = "//" + text[2:]
    code, faults, inner = strip(text, lang)
    r = rules(lang)
    code = r.numbers.sub(NUM, r.names.sub(NAME, code))
    if "," in code:
        code = r.run.sub(rf"\g<1>{NUM},{NUM}", code)
        for _ in range(3):
            before = len(code)
            for literal in (r.list, r.dict):
                if literal:
                    code = literal.sub(rf"\g<1>{NUM}", code)
            code = r.run.sub(rf"\g<1>{NUM},{NUM}", code)
            if len(code) == before:
                break
    code = code.replace("\r\n", "\n").replace("\r", "\n").replace("\x0c", " ")
    return code.split("\n"), faults, inner
