"""Functions paired with their documentation.

Comment spans are taken from the texts and function spans from the parsed
nodes, independently of each other. Each comment knows the lines between which
a function must begin to be its own: up to the next statement behind it, or,
for a docstring, the header line right before it. An as-of join in line order
attaches the nearest such comment to a function; what lies behind another
statement is rejected. Documentation that says nothing is dropped.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlens.llm.syntax.lexing import LANGUAGES, rules

# Notices that documentation is absent or still to be written.
NOTICES = """todo|fixme|tbd|tba|wip|xxx|hack|n/?a|none|null|nil|empty|missing|pending|undocumented|not documented( yet)?|docstring|doc ?string here|summary( line)?|description|short description|documentation|docs|no ?docs?|no comment|placeholder( text)?|inherit ?docs?|see (above|below|base class)|as above|same as above|self[- ]explanatory
|placeholder[ ,].*(later|filled|replaced).*|(write|add|insert|put|fill in|provide) .*(documentation|docs|docstring|description|comment|summary)\\b.*|(documentation|docs|docstring|description|comment|summary) (is |are |to be |will be |goes |go )*(missing|pending|needed|required|written|added|follows?|later|here|tbd|todo|coming soon|to follow|follow)\\b.*|no (description|documentation|docs|docstring|comment|summary)\\b.*|(to be|still to be|needs to be|will be|must be) (documented|written|described|done|added|filled|completed|determined|defined|announced)\\b.*|needs (documentation|docs|a description|a docstring)\\b.*|lorem ipsum.*
|à (compléter|documenter|rédiger|faire|décrire)\\b.*|noch (zu |nicht )?(dokumentieren|dokumentiert|beschreiben|beschrieben|offen)\\b.*|(keine|ohne) (beschreibung|dokumentation)\\b.*|fehlt noch|(por|sin) (documentar|completar|hacer|describir|documentación|descripción)\\b.*|pendiente( de .*)?|da (documentare|completare|fare|descrivere)\\b.*|(a|por) (documentar|completar|fazer)\\b.*|sem (documentação|descrição)\\b.*|nog (te documenteren|in te vullen|te doen|niet gedocumenteerd)\\b.*|do (uzupełnienia|zrobienia|opisania)\\b.*|brak (opisu|dokumentacji)\\b.*|(нет|без) (описания|документации)\\b.*|(будет )?(заполнить|дописать|описать) позже\\b.*|не описано|belgelenecek|açıklama (yok|eklenecek)
|待补充|待完善|待办|暂无(说明|描述|文档|注释)?|无|未完成|説明なし|未記入|後で(書く|記述)|要記入|작성 ?예정|설명 ?없음|추후 ?작성|لا يوجد وصف|कोई विवरण नहीं"""
_NOTICE = re.compile(r"(?:" + NOTICES.replace("\n", "") + r")", re.I)
_MARKER = re.compile(r"^(?:todo|fixme|xxx|hack|note|tbd|wip)\b(?:\([^)]*\))?\s*[:\-–—.]*\s*", re.I)
# Words that mean nothing beside a name, and names of sections and tags.
_ARTICLES = frozenset("the a an this le la les l un une der die das ein eine el los las il lo gli i uno una o os as um uma de het een".split())
_EMPTY_WORDS = frozenset("function method func fn def getter setter".split())
_SECTIONS = re.compile(r"^(?:args?|arguments?|param(?:eter)?s?|returns?|yields?|raises?|throws?|examples?|attributes?|notes?|see also|keyword args)\s*:?\s*$", re.I)
_TAG = re.compile(r"^[@:\\](\w+)(?:[ \t]+\{[^}]*\})?(.*)$")
_WORD = re.compile(r"[^\W_]+")
_HUMPS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\dA-Z_]+|\d+|[^\W_]+")
_PARAMS = re.compile(r"[^\W\d]\w*")


def clean(doc: str) -> str:
    """The text of a docstring or comment without quotes and comment marks."""
    t = doc.strip()
    m = re.match(r"(?s)^[rRuUbBfF]{0,2}(\"\"\"|''')(.*?)(?:\1)?$", t) or re.match(r"(?s)^[rRuUbB]?([\"'])([^\"'\n]*)\1$", t)
    if m:
        t = m.group(2)
    if t.startswith("/*"):
        t = re.sub(r"^/\*+!?|\*+/$", "", t)
        t = "\n".join(re.sub(r"^\s*\*(?!/) ?", "", x) for x in t.split("\n"))
    lines = [re.sub(r"^\s*(?:///?!?|#+!?(?=\s|$))[ \t]?", "", x.rstrip()) for x in t.split("\n")]
    return "\n".join(lines).strip()


def _name_words(name: str) -> set[str]:
    parts = {p.lower() for p in _HUMPS.findall(name)}
    return parts | {name.lower(), name.lower().strip("_"), *(x.lower() for x in name.split("_"))}


def says_something(doc: str | None, name: str | None, signature: str | None) -> bool:
    """Whether documentation holds more than the name, parameter names, bare tags or a notice.

    Null and blank documentation says nothing. A null name or signature only
    means that fewer words are taken away.
    """
    if not doc or not doc.strip():
        return False
    name = (name or "").rpartition(".")[2]
    inside = (signature or "").partition("(")[2]
    params = {p for p in _PARAMS.findall(inside)}
    own = _name_words(name)
    low_params = {p.lower() for p in params} | {w for p in params for w in _name_words(p)}
    for raw in clean(doc).split("\n"):
        line = raw.strip().strip("*_`").strip()
        if not line or _SECTIONS.match(line) or not _WORD.search(line):
            continue
        m = _TAG.match(line)
        if m:
            tag, line = m.group(1).lower(), m.group(2).strip()
            line = re.sub(r"^\{[^}]*\}\s*", "", line)
            if raw.strip()[0] == ":" and ":" in line:
                line = line.partition(":")[2]
            elif tag in ("param", "parameter", "arg", "argument", "throws", "raises", "exception", "type", "typeparam", "template", "property"):
                line = re.sub(r"^\[?[\w.$]+\]?\s*[-–:]*\s*", "", line)
            elif tag in ("see", "link", "since", "author", "version", "inheritdoc", "override", "deprecated", "internal", "private", "public") and len(_WORD.findall(line)) < 3:
                continue
        else:
            item = re.match(r"^[-*]?\s*`?(\w+)`?\s*(?:\([^)]*\))?\s*[:–-]\s*(.*)$", line)
            if item and item.group(1) in params:
                line = item.group(2)
        line = re.sub(r"^\[[^\]]*\]\s*", "", line.strip())
        line = _MARKER.sub("", line).strip().strip("-–—:;.!…*_<>(){}[]`\"' ").strip()
        if not line or not _WORD.search(line) or _NOTICE.fullmatch(line):
            continue
        words = [w.lower() for w in _WORD.findall(line)]
        humps = {h.lower() for h in _HUMPS.findall(line)}
        if all(w in own or w in low_params or w in _ARTICLES or w in _EMPTY_WORDS or w in ("returns", "return", "param") for w in words) or humps <= own | low_params | _ARTICLES | _EMPTY_WORDS:
            continue
        return True
    return False


_DEF = re.compile(r"(?:async[ \t]+)?def\b")
_NESTED = re.compile(r"/\*|\*/")
_TEMPLATE = re.compile(r"\\[\s\S]|(?P<e>`)|(?P<i>\$\{)")
_EMBEDDED = re.compile(rf"{rules('javascript').scan.pattern}|(?P<o>[{{}}])")
_IN_STRING = re.compile(r"\\[\s\S]|(?P<c>/\*[\s\S]*?\*/)|//[^\n]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'")


def _string_comments(text: str, start: int, end: int):
    """(start, end, string's end) of the comments in what was read as a string."""
    for m in _IN_STRING.finditer(text, start, max(start, text.rfind("*/", start, end) + 2)):
        if m.lastgroup:
            yield m.start(), m.end(), end


def _block_comments(text: str, lang: str):
    """(start, end, 0) of the block comments of a whole text, whether it parses or not.

    A quote left open turns the strings behind it inside out, so comments in
    strings of several lines are given too, with the end of the string: they
    count only for a function that begins within it, which none does where
    the string is one.
    """
    scan, size = rules(lang).scan, len(text)
    nested: dict[int, int] | None = None
    pos, braces = 0, []  # braces: open ones in each embedded expression of a template
    while m := (_EMBEDDED if braces else scan).search(text, pos):
        kind, at, pos = m.lastgroup, m.start(), m.end()
        if kind == "c":
            if text.startswith("/*", at):
                yield at, pos, 0
        elif kind == "n":
            if nested is None:
                nested, opened = {}, []
                for c in _NESTED.finditer(text):
                    if c.group() == "/*":
                        opened.append(c.start())
                    elif opened:
                        nested[opened.pop()] = c.end()
            pos = nested.get(at) or text.find("*/", at + 2) + 2
            if pos < at + 2:
                return  # no comment ends behind it
            yield at, pos, 0
        elif kind == "o" and (m.group() == "{" or braces[-1]):
            braces[-1] += 1 if m.group() == "{" else -1
        elif kind in ("t", "o"):
            if kind == "o":
                braces.pop()
            start, stop = pos, next((t for t in _TEMPLATE.finditer(text, pos) if t.lastgroup), None)
            pos = stop.end() if stop else size
            yield from _string_comments(text, start, pos)
            if stop and stop.lastgroup == "i":
                braces.append(0)
        elif kind == "s":
            line_end = text.find("\n", at, pos)
            if line_end > 0:
                yield from _string_comments(text, line_end, pos)
        elif kind == "x":
            line_end = text.find("\n", at)
            if line_end < 0 or text[at] == "/":
                return  # no comment ends behind it
            if text.startswith({"rust": '"', "go": "`", "java": '"""'}.get(lang, "\n"), at):
                yield from _string_comments(text, line_end, size)
                return
            # an apostrophe behind a letter is text of JSX; else the rest of the line cannot be told apart
            if lang != "javascript" or not text[max(at - 1, 0)].isalnum():
                pos = line_end


def comment_spans(text: str, extension: str) -> list[tuple[int, int, int, str]]:
    """(line, first, last, text) of what may document a function; a function it belongs to begins in lines first..last."""
    lang = LANGUAGES.get(extension)
    if lang is None or not text:
        return []
    out: list[tuple[int, int, int, str]] = []
    starts = [0]
    for m in re.finditer("\n", text):
        starts.append(m.end())
    line_of = lambda o: bisect_right(starts, o)  # noqa: E731 - from 1
    if lang == "python":
        scan, pos = rules(lang).scan, 0
        while m := scan.search(text, pos):
            pos = m.end()
            if m.lastgroup == "x":
                # the rest of the line cannot be told apart; what is behind it is read on
                pos = starts[line_of(m.start())] if line_of(m.start()) < len(starts) else len(text)
            if m.lastgroup != "s":
                continue
            line_start = starts[line_of(m.start()) - 1]
            if not text[line_start : m.start()].strip():
                # the logical line before: what ends with ':' and began with def
                head = _header_line(text, line_start, starts, line_of)
                if head:
                    out.append((line_of(m.start()), head, head, m.group()))
            quotes = m.group()[-3:]
            if quotes in ('"""', "'''") and "\n" in m.group():
                # where quotes were left open, closing ones are those that open a docstring, of a function within the string
                at = pos - 3
                line_start = starts[line_of(at) - 1]
                head = 0 if text[line_start:at].strip(" \t\frRuU") else _header_line(text, line_start, starts, line_of)
                end = text.find(quotes, pos) if head > line_of(m.start()) else -1
                if end > 0:
                    out.append((line_of(at), head, head, text[at : end + 3]))
        return out
    lines = text.split("\n")
    spans: list[tuple[int, int, int, str]] = []
    if lang in ("go", "rust"):
        mark = "///" if lang == "rust" else "//"
        k, n = 0, len(lines)
        while k < n:
            s = lines[k].strip()
            if s.startswith(mark) and not (lang == "rust" and s.startswith("////")):
                j = k
                while j + 1 < n and lines[j + 1].strip().startswith(mark):
                    j += 1
                spans.append((k + 1, j + 1, n + 1, "\n".join(x.strip() for x in lines[k : j + 1])))
                k = j
            k += 1
    if "/**" in text or (lang == "go" and "/*" in text):
        for start, end, string_end in _block_comments(text, lang):
            body = text[start:end]
            if body.startswith("/**" if lang != "go" else "/*") and body != "/**/":
                within = len(lines) + 1
                if string_end:
                    within = line_of(string_end - 1)
                    within -= not text[starts[within - 1] : string_end].strip().strip("\"'`#${")
                spans.append((line_of(start), line_of(end - 1), within, body))
    for first, last, within, body in spans:
        k = last
        if lang == "go":
            stop = last + 1 if k < len(lines) and lines[k].strip() else last
        else:
            while k < len(lines):
                s = lines[k].strip()
                if s and not s.startswith(("@", "#[", "//")):
                    break
                k += 1
            stop = k + 1
        if min(stop, within) > last:
            out.append((first, last + 1, min(stop, within), body))
    return out


def _header_line(text: str, at: int, starts: list[int], line_of) -> int:
    """Line of the def whose header is the logical line right before offset ``at``, or 0."""
    n = line_of(at) - 1
    while n > 0:
        s = text[starts[n - 1] : starts[n] - 1].strip()
        if s and not s.startswith("#"):
            break
        n -= 1
    if n <= 0:
        return 0
    s = re.sub(r"\s+#.*$", "", s)
    if not s.endswith(":"):
        return 0
    # up to where the brackets of the header open; a header is as long as its parameters are
    depth = 0
    for k in range(n, 0, -1):
        t = text[starts[k - 1] : starts[k] - 1]
        depth += sum(t.count(c) for c in ")]}") - sum(t.count(c) for c in "([{")
        if depth <= 0:
            return k if _DEF.match(t.strip()) else 0
    return 0


def _python_udf_says() -> Column:
    @F.pandas_udf("boolean")
    def says(doc, name, signature):
        import pandas as pd

        return pd.Series([says_something(d, n, s) for d, n, s in zip(doc, name, signature)])

    return says


def pairs(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node_id, file_path, name, signature, start_line, documentation) of functions whose documentation says something.

    The current row of a node is that of the highest row_seq (ties: the
    greatest row); its type is taken in any case. Where the docstring column
    is null or blank, the text of the file decides. Rows without node_id are
    left out, repeated rows count once.
    """
    import pyarrow as pa

    current = nodes.filter("node_id IS NOT NULL").groupBy("node_id").agg(
        F.max(F.struct(F.coalesce("row_seq", F.lit(-(2**62))).alias("v"), "type", "file_path", "name", "signature", "docstring", "start_line")).alias("r")
    )
    functions = current.filter(F.lower("r.type").isin("function", "method")).select("node_id", "r.file_path", "r.name", "r.signature", "r.docstring", "r.start_line")
    blank = F.coalesce(F.trim(F.regexp_replace("docstring", r"\s+", " ")), F.lit("")) == ""
    from_column = functions.filter(~blank).withColumn("documentation", F.col("docstring"))
    asked = functions.filter(blank & F.col("file_path").isNotNull() & F.col("start_line").isNotNull())
    texts = docs.filter("file_path IS NOT NULL AND text IS NOT NULL").select("file_path", "text", F.lower(F.regexp_extract("file_path", r"\.([A-Za-z0-9]+)$", 1)).alias("ext")).filter(F.col("ext").isin(sorted(LANGUAGES)))

    def spans(batches):
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for path, text, ext in zip(*(c.to_pylist() for c in batch.columns)):
                for span in comment_spans(text, ext):
                    for column, x in zip(rows, (path, *span)):
                        column.append(x)
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds)], names=["file_path", "line", "first", "last", "comment"])

    comments = texts.mapInArrow(spans, "file_path string, line int, first int, last int, comment string")
    null = lambda kind: F.lit(None).cast(kind)
    # in line order: a comment stands where its functions may begin; the nearest one at or before a function is looked at
    line = comments.select("file_path", F.col("first").alias("at"), F.lit(0).alias("is_function"), F.struct("first", "line", "last", "comment").alias("c"), null("string").alias("node_id"), null("string").alias("name"), null("string").alias("signature"))
    begins = asked.select("file_path", F.col("start_line").alias("at"), F.lit(1).alias("is_function"), null("struct<first:int,line:int,last:int,comment:string>").alias("c"), "node_id", "name", "signature")
    order = Window.partitionBy("file_path").orderBy("at", "is_function", "c.line").rowsBetween(Window.unboundedPreceding, 0)
    met = line.unionByName(begins).withColumn("near", F.last("c", ignorenulls=True).over(order)).filter("is_function = 1 AND near IS NOT NULL AND near.last >= at")
    from_text = met.select("node_id", "file_path", "name", "signature", F.col("at").alias("start_line"), F.col("near.comment").alias("documentation"))
    both = from_column.select("node_id", "file_path", "name", "signature", "start_line", "documentation").unionByName(from_text)
    return both.filter(_python_udf_says()("documentation", "name", "signature"))
