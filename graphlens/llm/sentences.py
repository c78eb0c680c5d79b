"""Sentence boundaries across languages and scripts.

Method: document-centred disambiguation. A first pass over each document
counts how every token that is written with a period goes on: before a lower
case word or digit it must be an abbreviation, at the end of a block it ends a
sentence. It also notes the proper names: words with a capital inside a
sentence, where nothing else asks for one, that the document never writes
small. Those counts decide inside the document; where it is silent the counts
of the corpus decide (over distinct texts, joined per document, never
broadcast); a short list of common abbreviations is asked last, where both are
silent. Behind an abbreviation that may end a sentence, a proper name goes on
with it. Scripts without spaces or periods have their own terminators.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.operators.skew import join_unique
from graphlens.session import stage

# Abbreviations that never end a sentence, and some that may; asked only where document and corpus are silent.
NEVER_LAST = frozenset("mr mrs ms dr prof st no sec fig vol approx e.g i.e cf vs eq ch m mme mlle c.-à-d p pp pág pag sr sra dra ej dott sig ing bzw z b d h mind ca nr vgl см напр проф г. с т стр рис bkz örn tzn np str r vb dr bijv blz o.a d.w.z m.a.w د डॉ श्री".split())
MAY_BE_LAST = frozenset("etc inc ltd co corp p.m a.m u.k u.s usw u.a д п г др ecc enz vd itp itd".split())
# German month names, before which a number with a period is a day.
MONTHS = frozenset("Januar Februar März April Mai Juni Juli August September Oktober November Dezember Jänner".split())

#: A token counts as an abbreviation in the corpus from this share of unambiguous uses on, seen at least SEEN times.
SHARE, SEEN = 0.3, 4
#: One without unambiguous uses counts as one if that is so many times likelier than an ordinary word; PERIOD: how often an abbreviation has its period.
LIKELIER, PERIOD = 1000, 0.99
#: How often a proper name stands behind an abbreviation that goes before names.
NAMED = 0.99
#: What is counted of a word: see ``evidence``; ``small`` is its uses written small.
COUNTS = ("low", "up", "last", "bare", "small")

STOPS = ".!?。！？।॥؟…．｡۔"
_FULL = "。！？।॥؟．｡۔"
_OPEN = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "【": "】", "「": "」", "『": "』", "《": "》", "〈": "〉", "“": "”", "«": "»", "„": "“", "‹": "›"}
_CLOSE = frozenset(_OPEN.values())
_BRACKETS = frozenset("([{（［【")
_MARKS = re.compile(r'["()\[\]{}（）［］【】「」『』《》〈〉“”„«»‹›]')
_STOP_RUN = re.compile(f"[{re.escape(STOPS)}]+")
_BREAKS = frozenset("\"“”„«»‹›()[]{}（）,;:!?。，、/")
_NEXT = re.compile(r"\s*(\S*)")
_HEADING = re.compile(r"[ \t]{0,3}(#{1,6})[ \t]+(.*?)(?:[ \t]+#+)?[ \t]*$")
_BULLET = re.compile(r"[ \t]*(?:[-*+•‣◦–—·]|\[[ xX]\])[ \t]+(?:\[[ xX]\][ \t]+)?")
_NUMBER = re.compile(r"[ \t]*(?:\d{1,3}[.)]|[A-Za-z]\))[ \t]+")
_RULE = re.compile(r"[ \t]*([-*_=~`])(?:[ \t]*\1){2,}[ \t]*\w*[ \t]*$")
_LINES = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+")
_THAI_SPACE = re.compile(r"(?<=[ก-ฺเ-๎])[  　]+(?=[ก-ฺเ-๎])")
_BARE = re.compile(r"\w[\w\-'’]*(?:\.\w[\w\-'’]*)*(?!\.?[\w.])")
_INSIDE = re.compile(r"(?:(?<=[^\W\d_] )|(?<=[^\W\d_], ))[^\W\d_][\w'’-]*")
_FIRST = re.compile(r"[\w'’-]*")
_WORDISH = re.compile(r"[a-z][a-z0-9]*(?:[A-Z_]|\.\w+\(|\()")


def blocks(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, one_unit): headings and list items are one unit each, paragraphs are not.

    Markers are left out. A numbered line is a list item only after a blank
    line or another item, since a wrapped line may begin with a number.
    """
    out: list[tuple[int, int, bool]] = []
    open_at, open_unit, fresh, item_before = -1, False, True, False
    at, last = 0, 0
    for line in _LINES.findall(text):
        body = line.rstrip()
        start, at = at, at + len(line)
        if not body.strip("﻿ \t 　"):
            if open_at >= 0:
                out.append((open_at, last, open_unit))
            open_at, fresh, item_before = -1, True, False
            continue
        heading, bullet = _HEADING.match(body), _BULLET.match(body)
        number = None if bullet or not (fresh or item_before) else _NUMBER.match(body)
        if heading or _RULE.match(body):
            if open_at >= 0:
                out.append((open_at, last, open_unit))
            if heading and heading.group(2):
                out.append((start + heading.start(2), start + heading.end(2), True))
            open_at, fresh, item_before = -1, True, False
            continue
        if bullet or number:
            if open_at >= 0:
                out.append((open_at, last, open_unit))
            open_at, open_unit, item_before = start + (bullet or number).end(), True, True
        elif open_at < 0:
            open_at, open_unit, item_before = start, False, False
        last, fresh = start + len(body), False
    if open_at >= 0:
        out.append((open_at, last, open_unit))
    return out


def pairs(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Outermost (open, close) of quotes and brackets in one block; what has no partner is no quote."""
    stack: list[tuple[str, int]] = []
    found: list[tuple[int, int]] = []
    for m in _MARKS.finditer(text, start, end):
        c, i = m.group(), m.start()
        if c == '"':
            wants = [k for k, (w, _) in enumerate(stack) if w == '"']
            if wants:
                found.append((stack[wants[-1]][1], i))
                del stack[wants[-1] :]
            else:
                stack.append(('"', i))
        elif c in _CLOSE and any(w == c for w, _ in stack):
            k = max(k for k, (w, _) in enumerate(stack) if w == c)
            found.append((stack[k][1], i))
            del stack[k:]
        elif c in _OPEN:
            stack.append((_OPEN[c], i))
    found.sort()
    outer: list[tuple[int, int]] = []
    for a, b in found:
        if not outer or a > outer[-1][1]:
            outer.append((a, b))
        elif b > outer[-1][1]:
            outer[-1] = (outer[-1][0], max(b, outer[-1][1]))
    return outer


def _begins_sentence(word: str) -> bool:
    """Whether a word can begin a sentence: anything but a plain lower case word."""
    w = word.lstrip("\"'“”„«»‹›([{（「『¿¡*_`")
    if not w:
        return bool(word)
    return not w[0].islower() or bool(_WORDISH.match(w)) or "_" in w


def _token(text: str, start: int, stop: int) -> str:
    """What stands before ``stop`` without space or mark, however long."""
    at = stop
    while at > start and text[at - 1] not in _BREAKS and not text[at - 1].isspace():
        at -= 1
    return text[at:stop]


def _bare(text: str) -> Counter:
    """Word -> uses without a period."""
    return Counter(_BARE.findall(text.lower()))


def _small(text: str) -> Counter:
    """Word -> uses without a period that are written small."""
    return Counter(w for w in _BARE.findall(text) if w[0].islower())


def evidence(text: str, bare: Counter | None = None, followers: Counter | None = None) -> dict[str, list[int]]:
    """token -> [before lower case or digit, before what may begin a sentence, at the end of a block, without period].

    ``followers`` counts (token, word behind it in lower case) where that word has a capital.
    """
    seen: dict[str, list[int]] = {}
    for a, b, _ in blocks(text):
        spans = pairs(text, a, b)
        opens = [x for x, _ in spans]
        for m in _STOP_RUN.finditer(text, a, b):
            if m.group() != ".":
                continue
            k = bisect_right(opens, m.start()) - 1
            quoted = k >= 0 and spans[k][1] > m.start()
            w = _token(text, a, m.start()).lower()
            if not w or w.isdigit():
                continue
            rest = text[m.end()] if m.end() < b else ""
            if rest and not rest.isspace() and rest not in ",;:":
                continue
            nxt = _NEXT.match(text, m.end(), b).group(1)
            s = seen.setdefault(w, [0, 0, 0, 0])
            if not nxt:
                s[2] += 1
            elif rest in ",;:" or nxt[0].isdigit() or not _begins_sentence(nxt):
                s[0] += 1
            elif not quoted:
                s[1] += 1
                if followers is not None:
                    word = _FIRST.match(nxt.lstrip("\"'“„«([¿¡")).group()
                    if word[:1].isupper():
                        followers[w, word.lower()] += 1
    if seen:
        bare = _bare(text) if bare is None else bare
        for w, s in seen.items():
            s[3] = bare.get(w, 0)
    return seen


def _abbreviation(token: str, doc: dict[str, list[int]], corpus: dict[str, bool]) -> str:
    """'never' or 'may' end a sentence, or '' for an ordinary word: by the document, then the corpus, then the lists."""
    w = token.lower()
    low, _, last, bare = doc.get(w, (0, 0, 0, 0))
    told = corpus.get(w)
    if last and not low:  # it ends blocks here, and nothing here makes it an abbreviation
        return "may" if told is not None or w in NEVER_LAST or w in MAY_BE_LAST or "." in w else ""
    if low and not bare:  # an abbreviation in this document
        return "may" if last or told or (told is None and w in MAY_BE_LAST) else "never"
    if told is not None:
        return "may" if told or last else "never"
    if w in NEVER_LAST or w in MAY_BE_LAST:
        return "may" if w in MAY_BE_LAST or last else "never"
    return "never" if len(token) == 1 and token.isalpha() and not last else ""


def names(text: str) -> frozenset[str]:
    """Proper names of a document, by their unambiguous occurrences: capitals inside a sentence, and never written small."""
    inside = {w for w in _INSIDE.findall(text) if w[0].isupper()}
    return frozenset(w for w in inside if not re.search(rf"(?<!\w){re.escape(w.lower())}(?!\w)", text)) if inside else frozenset()


def split(text: str, corpus: dict[str, bool] | None = None) -> list[tuple[int, int]]:
    """(start, end) of every sentence, in code points. ``corpus``: token -> whether it may end a sentence."""
    corpus = corpus or {}
    doc = evidence(text)
    proper: list[frozenset] = []  # worked out where first asked for
    known = lambda w: w in (proper or proper.append(names(text)) or proper)[0]
    out: list[tuple[int, int]] = []
    for a, b, unit in blocks(text):
        cuts = [] if unit else _cuts(text, a, b, doc, corpus, known)
        for c in [*cuts, b]:
            s, e = a, c
            while s < e and (text[s].isspace() or text[s] in "﻿​"):
                s += 1
            while e > s and (text[e - 1].isspace() or text[e - 1] in "﻿​"):
                e -= 1
            if e > s:
                out.append((s, e))
            a = c
    return out


def _cuts(text: str, a: int, b: int, doc: dict, corpus: dict, known) -> list[int]:
    spans = pairs(text, a, b)
    opens = [x for x, _ in spans]
    cuts: list[int] = []
    begin = a
    for m in _STOP_RUN.finditer(text, a, b):
        i, j, run = m.start(), m.end(), m.group()
        k = bisect_right(opens, i) - 1
        if k >= 0 and spans[k][1] > i:  # inside a quote or bracket: a boundary only where that ends with the stop
            close = spans[k][1]
            if text[j:close].strip():
                continue
            j, opened = close + 1, spans[k][0]
            if j >= b:
                continue
            alone = not text[begin:opened].strip()
            gap = _NEXT.match(text, j, b)
            if text[opened] in _BRACKETS and not alone:
                continue
            if gap.start(1) == j and not alone:
                continue  # the sentence goes on right behind the quote
            if gap.group(1) and (_begins_sentence(gap.group(1)) or (alone and text[opened] in _BRACKETS)):
                cuts.append(j)
                begin = j
            continue
        while j < b and text[j] in "\"'”’»›)]}）］】」』》〉" and not (text[j] == '"' and j in opens):
            j += 1
        if j >= b:
            continue
        gap = _NEXT.match(text, j, b)
        nxt, spaced = gap.group(1), gap.start(1) > j
        if not nxt:
            continue
        if any(c in _FULL for c in run):
            if run[-1] in "．" and not spaced and nxt[0].isalnum():
                continue
            cuts.append(j)
            begin = j
            continue
        if not spaced:
            continue
        if run == ".":
            w = _token(text, begin, i)
            if w.isdigit() and len(w) <= 2 and re.match(r"\w+", nxt) and re.match(r"\w+", nxt).group() in MONTHS:
                continue
            kind = _abbreviation(w, doc, corpus) if w and not w.isdigit() else ""
            if kind == "never" or not _begins_sentence(nxt):
                continue
            bare = nxt.lstrip("\"'“„«([¿¡")
            if kind == "may" and (not bare[:1].isupper() or nxt[0].isdigit() or known(_FIRST.match(bare).group())):
                continue
        elif not _begins_sentence(nxt):
            continue
        cuts.append(j)
        begin = j
    if "ก" <= max(text[a:b], default="") and re.search("[ก-๎]", text[a:b]):
        inside = lambda x: (k := bisect_right(opens, x) - 1) >= 0 and spans[k][1] > x
        cuts = sorted({*cuts, *(m.start() for m in _THAI_SPACE.finditer(text, a, b) if not inside(m.start()))})
    return cuts


def title_terms(n, last, dots: int, bare: int, all_up: int, all_last: int, without):
    """Log-likelihoods against an ordinary word, as (that it has its period so often, that its periods never end a block)."""
    rate, ends = min(dots / (dots + bare), 1 - PERIOD / 2), all_last / (all_last + all_up + 1)
    return n * math.log(PERIOD / rate) + without * math.log((1 - PERIOD) / (1 - rate)), n * -math.log(1 - ends)


def name_terms(named, plain, all_named: int, all_plain: int):
    """Log-likelihood against an ordinary word that so many of the words behind it are proper names and so many are not."""
    rate = min(max(all_named / max(1, all_named + all_plain), 1 - NAMED), NAMED - 0.01)
    return named * math.log(NAMED / rate) + plain * math.log((1 - NAMED) / (1 - rate))


def _titles(total: DataFrame, behind: DataFrame) -> DataFrame:
    """(word): abbreviations that always go on before a capital ('Dr.').

    Likelihood ratios against an ordinary word, with rates of the corpus: that
    it has a period so often; and that its periods never end a block while
    proper names follow it, names being words the corpus never writes small.
    """
    n = F.col("low") + F.col("up") + F.col("last")
    r = total.agg(F.sum(n).alias("dots"), F.sum("bare").alias("bare"), F.sum("up").alias("up"), F.sum("last").alias("last")).first()
    if not r.dots or not r.bare or not r.last:
        return total.limit(0).select("word")
    small = total.filter("small > 0").select(F.col("word").alias("next"), F.lit(True).alias("small"))
    behind = stage(behind, "behind")
    told = join_unique(behind, small, "next", "left").groupBy("word").agg(F.sum(F.when(F.col("small").isNull(), F.col("up")).otherwise(0)).alias("named"), F.sum(F.when(F.col("small"), F.col("up")).otherwise(0)).alias("plain"))
    told = stage(told, "followed")
    every = told.agg(F.sum("named").alias("named"), F.sum("plain").alias("plain")).first()
    dotted, inside = title_terms(n, F.col("last"), r.dots, r.bare, r.up, r.last, F.col("bare"))
    named = name_terms(F.coalesce("named", F.lit(0)), F.coalesce("plain", F.lit(0)), every.named or 0, every.plain or 0)
    least = math.log(LIKELIER)
    some = total.filter((F.col("last") == 0) & (F.col("low") == 0) & (n > 0)).filter(dotted >= least)
    # a name may also be a common word ('Alt'), so names only ever add to the evidence
    return some.join(told, "word", "left").filter(inside + F.greatest(named, F.lit(0.0)) >= least).select("word")


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start_char, end_char) of every sentence of every row.

    Null, '' and blank texts have no sentences; rows with a null key are left
    out; a key that occurs twice is split twice and its rows come out once.
    """
    import pyarrow as pa

    rows = docs.filter(F.col(key).isNotNull() & F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()

    def count(batches):
        for batch in batches:
            total: dict[str, list[int]] = {}
            followers: Counter = Counter()
            for t in batch.column(0).to_pylist():
                bare = _bare(t)
                seen = evidence(t, bare, followers)
                for w, k in bare.items():
                    total.setdefault(w, [0, 0, 0, 0, 0])[3] += k
                for w, k in _small(t).items():
                    total.setdefault(w, [0, 0, 0, 0, 0])[4] += k
                for w, s in seen.items():
                    have = total.setdefault(w, [0, 0, 0, 0, 0])
                    for n in range(3):
                        have[n] += s[n]
            words = [*total, *(w for w, _ in followers)]
            nexts = [*[None] * len(total), *(x for _, x in followers)]
            rows = [*total.values(), *([0, k, 0, 0, 0] for k in followers.values())]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(nexts, pa.string()), *(pa.array([r[n] for r in rows], pa.int64()) for n in range(5))], names=["word", "next", *COUNTS])

    def own(batches):
        for batch in batches:
            keys, words = [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for w in evidence(t, Counter()):
                    keys.append(k)
                    words.append(w)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(words, pa.string())], names=["_key", "word"])

    def cut(batches):
        for batch in batches:
            keys, starts, ends = [], [], []
            for k, t, known in zip(*(c.to_pylist() for c in batch.columns)):
                for s, e in split(t, {x["word"]: x["may"] for x in known or ()}):
                    keys.append(k)
                    starts.append(s)
                    ends.append(e)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["_key", "start_char", "end_char"])

    # each text counts once, however often it is delivered; uses without period count in all texts
    counts = rows.select("_text").distinct().mapInArrow(count, "word string, next string, " + ", ".join(f"{c} long" for c in COUNTS))
    counted = stage(counts.groupBy("word", "next").agg(*[F.sum(c).alias(c) for c in COUNTS]), "words")
    total = counted.filter("next IS NULL").drop("next")
    n = F.col("low") + F.col("up") + F.col("last")
    plain = total.filter((n >= SEEN) & (F.col("low") >= SHARE * n)).select("word", ((F.col("last") > 0) | (F.col("up") == 0)).alias("may"))
    known = plain.unionByName(_titles(total, counted.filter("next IS NOT NULL").select("word", "next", "up")).withColumn("may", F.lit(False)))
    # a token that many documents share is in `known` at most once; the pairs are as many as the documents' own tokens
    told = rows.mapInArrow(own, f"_key {kind}, word string").join(known, "word").groupBy("_key").agg(F.collect_set(F.struct("word", "may")).alias("known"))
    out = rows.join(told, "_key", "left").select("_key", "_text", "known").mapInArrow(cut, f"_key {kind}, start_char int, end_char int")
    return out.withColumnRenamed("_key", key).distinct()
