"""Comments and string literals of source files of any size, by parallel prefix.

A lexer that only tells code, comments and strings apart is a finite
automaton. A chunk of a file is then a function from the state before it to
the state behind it, and such functions compose: chunks of a huge file are
worked on wherever they lie, their functions are composed in order, and each
chunk is read again from the state that turned out to be right. Files of at
most ``CHUNK`` characters are one chunk and are read once.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a chunk: several to a file of common length, so that one huge file is the work of many tasks.
CHUNK = 2**13

# States of the automaton. Those behind START are inside a span; an escape or a first mark seen has a state of its own.
(CODE, SLASH, LINE, BLOCK, BLOCK_STAR, DOUBLE, DOUBLE_ESC, SINGLE, SINGLE_ESC, TICK, TICK_ESC, D1, D2, TD, TD_ESC, TD1, TD2, S1, S2, TS, TS_ESC, TS1, TS2) = range(23)
STATES = 23
_COMMENTS = frozenset((LINE, BLOCK, BLOCK_STAR))
_STRINGS = frozenset((DOUBLE, DOUBLE_ESC, SINGLE, SINGLE_ESC, TICK, TICK_ESC, TD, TD_ESC, TD1, TD2, TS, TS_ESC, TS1, TS2))
_OTHER = "x"
_MARKS = "/*\n\"'`\\#"


def _step(lang: str, s: int, c: str) -> int:
    """The state behind character ``c``, any other than a mark being the same."""
    python = lang == "python"
    if s in (LINE,):
        return CODE if c == "\n" else LINE
    if s == BLOCK:
        return BLOCK_STAR if c == "*" else BLOCK
    if s == BLOCK_STAR:
        return CODE if c == "/" else BLOCK_STAR if c == "*" else BLOCK
    for inside, escaped, mark in ((DOUBLE, DOUBLE_ESC, '"'), (SINGLE, SINGLE_ESC, "'"), (TICK, TICK_ESC, "`")):
        if s == escaped:
            return inside
        if s == inside:
            if c == "\\" and not (inside == TICK and lang == "go"):
                return escaped
            if c == mark:
                return CODE
            return CODE if c == "\n" and inside != TICK and lang != "rust" else inside
    for inside, escaped, one, two, mark in ((TD, TD_ESC, TD1, TD2, '"'), (TS, TS_ESC, TS1, TS2, "'")):
        if s == escaped:
            return inside
        if s in (inside, one, two):
            if c == "\\":
                return escaped
            if c == mark:
                return {inside: one, one: two, two: CODE}[s]
            return inside
    # here code goes on, after '/' or one or two quotes perhaps
    triple = python or lang == "java"
    if s in (D1, S1):
        mark = '"' if s == D1 else "'"
        if c == mark:
            return D2 if s == D1 else S2
        return _step(lang, DOUBLE if s == D1 else SINGLE, c)
    if s in (D2, S2):
        mark = '"' if s == D2 else "'"
        if c == mark:
            return TD if s == D2 else TS
        return _step(lang, CODE, c)
    if s == SLASH and c == "/":
        return LINE
    if s == SLASH and c == "*":
        return BLOCK
    if c == "#" and python:
        return LINE
    if c == "/" and not python:
        return SLASH
    if c == '"':
        return D1 if triple else DOUBLE
    if c == "'" and lang != "rust":
        return S1 if python else SINGLE
    if c == "`" and lang in ("javascript", "go"):
        return TICK
    return CODE


@lru_cache(maxsize=None)
def table(lang: str) -> dict[str, tuple[int, ...]]:
    """mark -> next state of each state."""
    return {c: tuple(_step(lang, s, c) for s in range(STATES)) for c in _MARKS + _OTHER}


def transition(chunk: str, lang: str) -> tuple[int, ...]:
    """The chunk as a function: the state behind it for each state before it."""
    t = table(lang)
    now = tuple(range(STATES))
    for c in _runs(chunk):
        step = t[c]
        now = tuple(step[s] for s in now)
    return now


def _runs(chunk: str):
    """Marks of a chunk, with what stands between them as one other character: further ones change nothing more."""
    import re

    for m in re.finditer(r"[/*\n\"'`\\#]|[^/*\n\"'`\\#]+", chunk):
        c = m.group()
        yield c if c in _MARKS and len(c) == 1 else _OTHER


def compose(first: tuple[int, ...], then: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(then[s] for s in first)


def spans(chunk: str, lang: str, state: int) -> list[tuple[int, int, str, bool, bool]]:
    """(start, end, kind, open_before, open_behind) of comments and strings in a chunk read from ``state``."""
    import re

    t = table(lang)
    out = []
    began = 0 if state in _COMMENTS or state in _STRINGS else -1
    kind = "comment" if state in _COMMENTS else "string"
    before = began == 0
    for m in re.finditer(r"[/*\n\"'`\\#]|[^/*\n\"'`\\#]+", chunk):
        c = m.group()
        nxt = t[c if c in _MARKS and len(c) == 1 else _OTHER][state]
        inside, goes_on = state in _COMMENTS or state in _STRINGS, nxt in _COMMENTS or nxt in _STRINGS
        if goes_on and not inside:
            # a string of a language with triple quotes shows only behind its first character
            began, kind, before = (m.start() if state in (D1, S1) else m.end()), "comment" if nxt in _COMMENTS else "string", False
        elif inside and not goes_on and began >= 0:
            out.append((began, m.start(), kind, before, False))
            began = -1
        state = nxt
    if began >= 0:
        out.append((began, len(chunk), kind, before, True))
    return [x for x in out if x[1] > x[0] or x[3] or x[4]]


def texts(docs: DataFrame, path: str = "file_path", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(file_path, start, kind, text) of every comment and string literal of every file of a known extension.

    ``start`` is the offset of its first character behind the opening mark; of
    a closing mark of several characters all but the last stay. Rows with a null path or text are left out. A
    span that crosses chunks comes out once, joined again.
    """
    import pyarrow as pa

    from graphlens.llm.syntax.lexing import LANGUAGES

    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    known = F.create_map(*[F.lit(x) for pair in sorted(LANGUAGES.items()) for x in pair])
    rows = docs.filter(F.col(path).isNotNull() & F.col(text).isNotNull()).select(F.col(path).alias("file_path"), F.col(text).alias("text"), known[extension].alias("lang")).filter("lang IS NOT NULL")
    size = F.length("text")
    names = ["file_path", "start", "kind", "text", "open_before", "open_behind"]
    schema = "file_path string, start long, kind string, text string, open_before boolean, open_behind boolean"
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_())

    def emit(found):
        columns = list(zip(*found)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

    def whole(batches):
        for batch in batches:
            found = []
            for p, t, lang in zip(*(c.to_pylist() for c in batch.columns)):
                found += [(p, s, k, t[s:e], b, a) for s, e, k, b, a in spans(t, lang, CODE)]
            yield emit(found)

    small = rows.filter(size <= chunk).mapInArrow(whole, schema).select("file_path", "start", "kind", "text")
    pieces = rows.filter(size > chunk).select("file_path", "lang", F.explode(F.sequence(F.lit(0), ((size - 1) / chunk).cast("int"))).alias("n"), "text").select("file_path", "lang", "n", F.substring("text", F.col("n") * chunk + 1, F.lit(chunk)).alias("piece"))

    @F.pandas_udf("array<int>")
    def function(piece, lang):
        import pandas as pd

        return pd.Series([list(transition(p, g)) for p, g in zip(piece, lang)])

    # a file has as many functions as chunks, of STATES small numbers each: they are composed in order within the file
    functions = pieces.select("file_path", "n", function("piece", "lang").alias("f"))
    ordered = functions.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("n", "f"))).alias("fs"))
    prefix = ordered.select(
        "file_path",
        F.posexplode(
            F.aggregate("fs", F.array(F.lit(CODE)), lambda acc, x: F.concat(acc, F.array(F.element_at(x.f, F.element_at(acc, -1) + 1))))
        ).alias("n", "state"),
    )

    def parts(batches):
        for batch in batches:
            found = []
            for p, lang, n, piece, state in zip(*(c.to_pylist() for c in batch.columns)):
                found += [(p, n * chunk + s, k, piece[s:e], b, a) for s, e, k, b, a in spans(piece, lang, state)]
            yield emit(found)

    read = pieces.join(prefix, ["file_path", "n"]).select("file_path", "lang", "n", "piece", "state").mapInArrow(parts, schema)
    # spans that run on are joined: each piece belongs to the last span that was not open before it
    from pyspark.sql import Window

    by = Window.partitionBy("file_path").orderBy("start")
    grouped = read.withColumn("first", F.max(F.when(~F.col("open_before"), F.col("start"))).over(by))
    large = grouped.groupBy("file_path", "first").agg(F.min("kind").alias("kind"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda x: x.text), "").alias("text"))
    return small.unionByName(large.select("file_path", F.col("first").alias("start"), "kind", "text")).filter("text <> ''")
