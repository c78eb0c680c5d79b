"""Files that nobody wrote by hand: generated, minified, vendored, or data saved as code.

Method: attribute files of repositories mark paths as generated or vendored;
their globs are resolved per directory, the deepest directory first and in it
the last matching line. Equivalent patterns are mined, from the files of
declared repositories by what was declared, from the others by what their
content shows, and applied to all repositories without attribute files. Files
that no declaration and no pattern reaches are judged by their content alone
(a generator's header, the shape of its lines, a published file it equals but
for small changes).
"""

from __future__ import annotations

import io
import re
from collections import Counter
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.operators.skew import join_unique
from graphlens.session import stage

#: A mined pattern needs this many files that show evidence, and this share of all files it matches.
SUPPORT, PRECISION = 3, 0.95
#: Share of code that is repeated or data from which a file counts as made by a tool, and least characters of code for it.
MADE, LEAST = 0.6, 300
#: Minified code has at most this share of white space, and lines this long.
DENSE, LONG_LINE = 0.09, 250
#: The share of words in the same order that makes a copy.
SIMILAR = 0.8

# How generators and copies announce themselves at the top of a file.
GENERATED = re.compile(
    r"@generated\b|<auto-?generated|\bauto-?generated\b(?! by hand)|\bcode generated by\b|\bgenerated (?:by|from|with|using) (?!hand\b)|\b(?:automatically|auto) (?:generated|produced|created|built|written)\b|\b(?:generated|produced|created) automatically\b|\bmachine[- ]generated\b"
    r"|générée? (?:automatiquement|par)|automatisch (?:erzeugt|generiert|erstellt|gegenereerd|aangemaakt)|(?:generado|gerado|generato|creado|criado) (?:automáticamente|automaticamente)|wygenerowan\w* (?:automatycznie|przez)|автоматически (?:сгенерирован|создан)|(?:сгенерирован|создан)\w* автоматически|otomatik olarak (?:oluştur|üret)|自动生成|自動生成|자동(?:으로)? ?생성|تم إنشاؤه تلقائي|स्वचालित रूप से",
    re.I,
)
COPIED = re.compile(r"\b(?:copied|vendored|taken|imported|adapted) from [\w.@/-]+ v?\d|\(c\) (?:the )?[\w.-]+ (?:contributors|authors|developers|project)\b|copyright .{0,40}\b(?:contributors|authors|developers)\b|^\s*/\*!\s*[\w.@/-]+ v?\d|^\W*[\w.-]+ v\d+\.\d+(?:\.\d+)?\s*$", re.I | re.M)
# Attributes of repository attribute files.
ATTRIBUTES = {"linguist-generated": "generated", "linguist-vendored": "vendored"}

_COMMENT_LINE = re.compile(r"^[ \t]*(?://|#(?!\[|!\[)|/?\*).*$", re.M)
_BLOCK = re.compile(r'"""[\s\S]*?"""|\'\'\'[\s\S]*?\'\'\'|/\*[\s\S]*?\*/')
_STRING = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'')
_NUMBER = re.compile(r"\b0x[0-9a-fA-F]+\b|\d[\d.]*")
_NAME = re.compile(r"[^\W\d]\w*")
_DATA = re.compile(r"[\s\[\]{}(),:;9+\-.]*")


def head(text: str) -> str:
    """The comment lines a text begins with; blank lines and a first line of '#!' belong to them."""
    out = []
    block = False
    for line in io.StringIO(text.lstrip("﻿"), newline="\n"):
        s = line.strip()
        if block or not s or s.startswith(("//", "#", "/*", "*", "<!--", "<?")) and not s.startswith(("#[", "#include", "#define")):
            out.append(s)
            block = (block or s.startswith("/*")) and "*/" not in s
            continue
        break
    return "\n".join(out)


def code_of(text: str) -> str:
    """The text without comments and documentation."""
    return _COMMENT_LINE.sub("", _BLOCK.sub("", text) if "/*" in text or '"""' in text or "'''" in text else text)


def words_of(text: str) -> list[str]:
    """Words of the code without comment lines, as compared with published files."""
    return _COMMENT_LINE.sub("", text).split()


class Published:
    """The files of third parties: a table of fixed size, held as word counts and as words in order."""

    MOST = 50_000_000

    def __init__(self, texts: list[str]):
        import numpy as np

        if sum(map(len, texts)) > self.MOST:
            raise ValueError("the table of published files is larger than may be sent to every worker")
        self.words = [w for w in map(words_of, texts) if w]
        self.ids = {w: k for k, w in enumerate(sorted({w for ws in self.words for w in ws}))}
        self.counts = np.zeros((len(self.words), len(self.ids)), np.int32)
        for row, ws in zip(self.counts, self.words):
            for w, k in Counter(ws).items():
                row[self.ids[w]] = k
        self.sizes = np.array([len(w) for w in self.words])

    def is_copy(self, text: str) -> bool:
        """Whether the words of any published file are those of the text, in order, to ``SIMILAR`` or more.

        A word in order is a word in common, so files whose words in common
        are too few cannot be similar; every other one is compared exactly.
        """
        from difflib import SequenceMatcher

        import numpy as np

        words = words_of(text)
        if not words or not self.words:
            return False
        known = [(self.ids[w], k) for w, k in Counter(words).items() if w in self.ids]
        if not known:
            return False
        at, k = np.array(known).T
        common = np.minimum(self.counts[:, at], k).sum(axis=1)
        near = np.flatnonzero(2 * common >= SIMILAR * (self.sizes + len(words)))
        return any(SequenceMatcher(None, self.words[n], words, autojunk=False).ratio() >= SIMILAR for n in near[np.argsort(-common[near], kind="stable")])


def shape(text: str) -> str:
    """'minified', 'generated' or 'data' by the look of the code, else ''."""
    code = code_of(text)
    lines = [x.strip() for x in code.split("\n")]
    lines = [x for x in lines if x]
    total = sum(map(len, lines))
    if total < LEAST:
        return ""
    longest = max(map(len, lines))
    if longest >= LONG_LINE:
        bare = _STRING.sub('""', code)
        inside = sum(len(x) for x in (y.strip() for y in bare.split("\n")) if len(x) >= LONG_LINE)
        dense = [x for x in (y.strip() for y in bare.split("\n")) if len(x) >= LONG_LINE]
        if inside >= 0.5 * len(bare.strip()) and dense:
            joined = "".join(dense)
            if (joined.count(" ") + joined.count("\t")) <= DENSE * len(joined) and len(_NAME.findall(joined)) * 12 > len(joined):
                return "minified"
    plain = _NUMBER.sub("9", _STRING.sub("9", code))
    shapes = [(_NAME.sub("a", s), len(o)) for s, o in zip((x.strip() for x in plain.split("\n") if x.strip()), lines)]
    counts = Counter(s for s, _ in shapes)
    often = {s for s, k in counts.items() if k >= 8 and len(s) > 12 and 2 * k >= len(shapes)}
    data = repeated = other = 0
    for s, n in shapes:
        if s in often:
            repeated += n
        elif _DATA.fullmatch(s):
            data += n
        else:
            other += 1
    if repeated + data >= MADE * total:
        return "generated" if repeated >= data and not _looks_like_data(often) else "data"
    if other <= 4:
        literal = sum(map(len, _STRING.findall(code))) + sum(map(len, _NUMBER.findall(_STRING.sub("", code))))
        if literal >= 0.5 * total and total >= 3 * LEAST:
            return "data"
    return ""


def _looks_like_data(shapes: set[str]) -> bool:
    return all(_DATA.fullmatch(s) for s in shapes)


def evidence(text: str | None, published: Published) -> str:
    """Why a text is not written by hand, by its content: a reason, or ''. Null and '' texts show nothing."""
    if not text:
        return ""
    top = head(text)
    if top:
        if GENERATED.search(top):
            return "generated"
        if COPIED.search(top):
            return "vendored"
    return shape(text) or ("vendored" if published.is_copy(text) else "")


# attribute files
def glob_regex(pattern: str, directory: str) -> str:
    """A glob of an attribute file in ``directory`` as a regular expression on whole paths.

    Without a slash (but at the end) it matches a name at any depth; '*' and
    '?' stop at slashes, '**' does not.
    """
    anchored = "/" in pattern.rstrip("/")
    body = pattern.strip("/")
    out, i = [], 0
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
            continue
        if body.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and "]" in body[i + 1 :]:
            j = body.index("]", i + 1)
            out.append("[" + body[i + 1 : j].replace("!", "^", 1).replace("\\", "\\\\") + "]")
            i = j
        else:
            out.append(re.escape(c))
        i += 1
    base = re.escape(directory) + "/" if directory else ""
    return f"^{base}{'' if anchored else '(?:.*/)?'}{''.join(out)}(?:/.*)?$"


def parse_attributes(path: str, text: str | None) -> list[tuple[str, int, str, str, bool]]:
    """(directory, line, regex, reason, set) of each generated or vendored mark in an attribute file."""
    directory = path.rpartition("/")[0]
    out = []
    for n, line in enumerate((text or "").splitlines()):
        parts = line.split()
        if len(parts) < 2 or parts[0].startswith("#"):
            continue
        for word in parts[1:]:
            name, _, value = word.lstrip("-!").partition("=")
            if name in ATTRIBUTES:
                out.append((directory, n, glob_regex(parts[0], directory), ATTRIBUTES[name], not word.startswith(("-", "!")) and value.lower() not in ("false", "0", "no")))
    return out


def rules_of(attributes: DataFrame) -> DataFrame:
    """(directory, rules): one row for every directory with an attribute file that marks something; rules (line, regex, reason, on)."""
    import pyarrow as pa

    kind = pa.list_(pa.struct([("line", pa.int32()), ("regex", pa.string()), ("reason", pa.string()), ("on", pa.bool_())]))

    def read(batches):
        for batch in batches:
            found = [(p.rpartition("/")[0], parse_attributes(p, t)) for p, t in zip(*(c.to_pylist() for c in batch.columns))]
            rows = [(d, [{"line": n, "regex": x, "reason": why, "on": on} for _, n, x, why, on in marks]) for d, marks in found if marks]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.string()), pa.array([m for _, m in rows], kind)], names=["directory", "rules"])

    rows = attributes.filter("file_path IS NOT NULL").select("file_path", "text").mapInArrow(read, "directory string, rules array<struct<line:int,regex:string,reason:string,on:boolean>>")
    # a file delivered twice, or in several versions: the greatest
    return rows.groupBy("directory").agg(F.max("rules").alias("rules"))


def declared(files: DataFrame, attributes: DataFrame) -> DataFrame:
    """(file_path, declared): the reason an attribute file gives for a path, or '' where it denies one.

    ``attributes``: (file_path, text) of attribute files. A rule only meets
    files below its directory: paths are joined with the directories above
    them, of which each is one row however many rules it has. For each
    attribute the deepest directory decides, in it the last line. Files
    without a matching rule are left out.
    """
    import pyarrow as pa

    rules = stage(rules_of(attributes), "rules")
    parts = F.split("file_path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    paths = stage(files.select("file_path").filter("file_path IS NOT NULL").distinct().select("file_path", F.explode(above).alias("directory")), "paths")

    def match(batches):
        compiled = lru_cache(maxsize=None)(re.compile)  # as many as there are rules
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for path, directory, marks in zip(*(c.to_pylist() for c in batch.columns)):
                last: dict[str, tuple[int, bool]] = {}
                for m in marks:
                    if compiled(m["regex"]).search(path):
                        last[m["reason"]] = max(last.get(m["reason"], (-1, False)), (m["line"], m["on"]))
                for reason, (_, on) in last.items():
                    for column, x in zip(out, (path, 0 if not directory else directory.count("/") + 1, reason, on)):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.string(), pa.int32(), pa.string(), pa.bool_()))], names=["file_path", "depth", "reason", "on"])

    met = join_unique(paths, rules, "directory").select("file_path", "directory", "rules").mapInArrow(match, "file_path string, depth int, reason string, on boolean")
    last = met.groupBy("file_path", "reason").agg(F.max_by("on", "depth").alias("on"))
    return last.groupBy("file_path").agg(F.coalesce(F.min(F.when(F.col("on"), F.col("reason"))), F.lit("")).alias("declared"))


def _patterns(path):
    """Path patterns of a file: each of its directories but the repository, and marks in its name."""
    name = F.element_at(F.split(path, "/"), -1)
    directories = F.transform(F.slice(F.split(path, "/"), 2, F.greatest(F.size(F.split(path, "/")) - 2, F.lit(0))), lambda x: F.concat(F.lit("**/"), x, F.lit("/**")))
    dotted = F.regexp_extract(name, r"(\.[A-Za-z]+\.[A-Za-z]+)$", 1)
    marked = F.regexp_extract(name, r"([_-][A-Za-z0-9]+\.[A-Za-z]+)$", 1)
    ends = F.filter(F.array(dotted, marked), lambda x: x != "")
    return F.array_distinct(F.concat(directories, F.transform(ends, lambda x: F.concat(F.lit("*"), x))))


def mine(shown: DataFrame) -> DataFrame:
    """(pattern, usual, n): globs whose files are nearly all known not to be written by hand, with the usual reason.

    ``shown``: (file_path, reason, undeclared), reason '' where a file shows
    nothing. A glob is a directory's name or a mark in a file's name, at any
    depth. Files of declaring repositories and all others are counted apart:
    it is enough that a glob holds for one of the two.
    """
    matched = shown.select("reason", "undeclared", F.explode(_patterns(F.col("file_path"))).alias("pattern"))
    shown_by = F.sum((F.col("reason") != "").cast("int"))
    mined = matched.groupBy("pattern", "undeclared").agg(F.count("*").alias("n"), shown_by.alias("shown"), F.mode(F.when(F.col("reason") != "", F.col("reason")), True).alias("usual"))
    good = mined.filter((F.col("shown") >= SUPPORT) & (F.col("shown") >= PRECISION * F.col("n")))
    return good.groupBy("pattern").agg(F.min_by("usual", "undeclared").alias("usual"), F.sum("n").alias("n"))


def classify(docs: DataFrame, published: DataFrame, attributes: DataFrame | None = None) -> DataFrame:
    """(file_path, reason, by) of every file not written by hand; reason: generated, minified, vendored or data.

    ``by`` is declared, pattern or content, the first that applies. In a
    repository with attribute files a declaration wins over the content, in
    both directions, and mined patterns are not applied. Rows with a null path
    are left out; repeated paths count once, with the greatest reason.
    """
    spark = docs.sparkSession
    size = published.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if size > Published.MOST:
        raise ValueError("the table of published files is larger than may be sent to every worker")
    texts = [r[0] for r in published.select("text").filter("text IS NOT NULL").collect()]
    shared = spark.sparkContext.broadcast(texts)

    seen = _with_evidence(docs, shared)
    seen = stage(seen.groupBy("file_path").agg(F.max("reason").alias("reason")).withColumn("said", F.lit(None).cast("string")).withColumn("undeclared", F.lit(True)), "evidence")
    if attributes is not None and not attributes.isEmpty():
        said = declared(seen, attributes).withColumnRenamed("declared", "said")
        repository = F.regexp_extract("file_path", r"^([^/]*)", 1)
        with_files = stage(attributes.filter("file_path IS NOT NULL").select(repository.alias("repository")).distinct().withColumn("undeclared", F.lit(False)), "declaring")
        known = stage(seen.select("file_path", "reason", repository.alias("repository")).join(said, "file_path", "left"), "said")
        seen = stage(join_unique(known, with_files, "repository", "left").select("file_path", "reason", "said", F.coalesce("undeclared", F.lit(True)).alias("undeclared")), "known")
    mined = stage(mine(seen.select("file_path", F.coalesce("said", "reason").alias("reason"), "undeclared")), "mined")
    open_ = stage(seen.filter("undeclared").select("file_path", F.explode(_patterns(F.col("file_path"))).alias("pattern")), "patterns")
    by_pattern = join_unique(open_, mined, "pattern").groupBy("file_path").agg(F.max_by("usual", F.struct("n", "pattern")).alias("usual"))
    rows = seen.join(by_pattern, "file_path", "left")
    by = F.when(F.col("said").isNotNull(), "declared").when(F.col("usual").isNotNull(), "pattern").otherwise("content")
    # what the content shows tells more of a file than what is usual for its pattern
    reason = F.coalesce("said", F.when(F.col("reason") != "", F.col("reason")), "usual", "reason")
    return rows.select("file_path", reason.alias("reason"), by.alias("by")).filter("reason <> ''")


def _with_evidence(docs: DataFrame, shared) -> DataFrame:
    import pyarrow as pa

    def show(batches):
        known = Published(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([evidence(t, known) for t in batch.column(1).to_pylist()], pa.string())], names=["file_path", "reason"])

    return docs.filter("file_path IS NOT NULL").select("file_path", "text").mapInArrow(show, "file_path string, reason string")


def lines_by_repository(found: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, reason, files, lines): files and their lines by repository; reason 'hand-written' for the rest.

    The current row of a file is that with the latest parsed_at; a missing or
    zero line_count counts as 0.
    """
    current = files.filter("file_path IS NOT NULL").groupBy("file_path").agg(F.max(F.struct("parsed_at", "row_seq", "repo", "line_count")).alias("r"))
    joined = current.select("file_path", "r.repo", "r.line_count").join(found.select("file_path", "reason"), "file_path", "left")
    return joined.groupBy("repo", F.coalesce("reason", F.lit("hand-written")).alias("reason")).agg(F.count("*").alias("files"), F.sum(F.coalesce("line_count", F.lit(0)).cast("long")).alias("lines"))
