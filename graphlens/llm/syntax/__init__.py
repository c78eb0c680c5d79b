"""Parsers of Python, JavaScript, TypeScript, Java, Go and Rust that go on after an error.

``errors(text, extension)`` gives every error of a file as (line, cause).
"""

from __future__ import annotations

from graphlens.llm.syntax import go, java, javascript, python, rust
from graphlens.llm.syntax.braces import Fault
from graphlens.llm.syntax.lexing import LANGUAGES, line_of, shapes

_CLASSES = {"go": go.Go, "java": java.Java, "rust": rust.Rust}


def _original_lines(text: str, lang: str) -> list[int]:
    """Extra line breaks inside removed tokens, as (shape line, breaks so far): maps shape lines to file lines."""
    from graphlens.llm.syntax.lexing import rules

    scan, pos, extra, out, shape_line = rules(lang).scan, 0, 0, [], 0
    m = scan.search(text)
    while m:
        shape_line += text.count("\n", pos, m.start())
        inside = text.count("\n", m.start(), m.end())
        if inside:
            kept = 1 if m.lastgroup == "c" and lang in ("javascript", "go") else 0
            shape_line += kept
            extra += inside - kept
            out.append((shape_line, extra))
        pos = m.end()
        m = scan.search(text, pos)
    return out


def errors(text: str, extension: str) -> list[tuple[int, str]]:
    """(line from 1, cause) of every error, first one first. A null character is no source text; '' is a valid file.

    ``extension`` without its dot, in any case; for an unknown one there are no errors.
    """
    extension = extension.lower()
    lang = LANGUAGES.get(extension)
    if lang is None:
        return []
    lines, faults, inner = shapes(text, lang)
    found = [(line_of(text, o), cause) for o, cause in faults]
    if "\x00" in text:
        found.append((line_of(text, text.index("\x00")), "null character"))
    if lang == "python":
        shaped = python.parse(lines)
    elif lang == "javascript":
        flags = (javascript.TYPED if extension in ("ts", "mts", "cts", "tsx") else 0) | (javascript.JSX if extension in ("tsx", "jsx") else 0)
        parser = javascript.JavaScript(lines, flags)
        parser.program()
        shaped = parser.errors
        for part in inner:
            lines, bad, deeper = shapes(part, lang)
            inner.extend(deeper)
            if bad:
                found.append((1, f"in a template: {bad[0][1]}"))
            sub = javascript.JavaScript(lines, flags | javascript.ASYNC)
            try:
                sub.expression()
                if sub.t[sub.i] != "<end>":
                    sub.fail()
            except Fault as e:
                found.append((1, f"in a template: {e}"))
    elif lang == "go":
        parser = go.Go(lines)
        if parser.t[0] == "<end>":
            return found or [(1, "expected package")]
        parser.program()
        shaped = parser.errors
    else:
        parser = _CLASSES[lang](lines)
        parser.program()
        shaped = parser.errors
    if shaped:
        moved = _original_lines(text, lang)
        for n, cause in shaped:
            extra = 0
            for at, e in moved:
                if at > n:
                    break
                extra = e
            found.append((n + extra + 1, cause))
    return sorted(found)
