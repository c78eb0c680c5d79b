"""Natural language inside code: which comments hold some, and in which language.

Spans are labelled by multinomial logistic regression on hashed character
n-grams. The model is linear and n-grams stay inside words, so a word's scores
are worked out once per worker. It is fitted on a bounded sample of labelled
texts, each read whole (``PER_LANGUAGE`` a language, at most), and on a few
function words of each language, which keep a language present that has no
labelled text at all.
"""

from __future__ import annotations

import re
import unicodedata
import zlib

import numpy as np
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Labelled texts a language that the model is fitted on at most.
PER_LANGUAGE = 60
BUCKETS = 2**14
LANGUAGES = ("ar", "de", "en", "es", "fr", "hi", "it", "ja", "ko", "nl", "pl", "pt", "ru", "th", "tr", "zh")
#: A comment is text from this many words on, or characters of a script without spaces.
LEAST_WORDS, LEAST_IDEOGRAPHS, LEAST_THAI = 5, 7, 12

# Frequent function words by language.
SEEDS = {
    "ar": "في من على إلى عن هذا هذه التي الذي لا ما كان إذا ثم بعد قبل كل مع حتى أن أو",
    "de": "der die das und ist nicht ein eine zu mit auf für wird von den dem sich auch wenn werden nach noch sonst über",
    "en": "the of and to in is that it for not are was with on be this which by from or when has have after before",
    "es": "el la los las de que y en un una no se por con para es del al cuando más lo como ya aquí si",
    "fr": "le la les des de et un une est que qui dans pour pas sur au plus par ne avec quand il elle ce cette si",
    "hi": "का की के है में से को और यह नहीं पर तो कर हर एक जब अगर पहले बाद क्यों था हैं",
    "it": "il lo la gli le di che e un una non è per con del della al si più quando prima dopo questo questa se",
    "ja": "の に は を た が で て と し れ さ ある いる も する から な こと として です ます ください",
    "ko": "이 그 는 은 을 를 에 의 가 와 한 하고 합니다 있는 없는 않습니다 다시 먼저 이후 경우 모든",
    "nl": "de het een en van is niet dat op te in met voor zijn wordt er maar als ook bij naar deze dit moet nog",
    "pl": "i w na z nie się jest to do że po tylko już ale od przez jak jeśli dla ten ta jeszcze raz gdy",
    "pt": "o a os as de que e em um uma não se por com para é do da ao quando mais já foi este esta antes",
    "ru": "и в не на с что это как по из за для если то только уже был она они так же от но к",
    "th": "ที่ และ ใน ของ การ เป็น ได้ ไม่ จะ มี ให้ กับ นี้ แล้ว ถ้า เมื่อ ทุก จาก ก่อน หลัง",
    "tr": "ve bir bu için ile de da ne çok daha kadar sonra önce ama ise gibi her olarak değil mı yalnızca eğer",
    "zh": "的 了 是 在 不 和 有 这个 如果 就 之前 以后 必须 我们 已经 或者 其他 任何 因为 所以 什么",
}
_URL = re.compile(r"(?:https?|ftp)://\S+|www\.\S+|\S+@\S+\.\w+|</?[A-Za-z][^<>]*>|`[^`\n]*`|\{@\w+[^}]*\}")
_TAG = re.compile(r"(?m)^[ \t]*(?:[*#/!-]+[ \t]*)?[@:\\](?:param|parameter|arg|argument|property|type|typeparam|template|throws|raises|exception|key|keyword|var|ivar)\b(?:[ \t]+\{[^}\n]*\})?[ \t]+\[?[\w.$]+\]?[ \t]*[-–:]*|^[ \t]*(?:[*#/!-]+[ \t]*)?[@:\\]\w+\b:?")
_SECTION = re.compile(r"(?mi)^[ \t]*(?:args?|arguments?|param(?:eter)?s?|returns?|yields?|raises?|throws?|examples?|attributes?|notes?)[ \t]*:?[ \t]*$|^[ \t]*[-=~*#_]{3,}[ \t]*$")
_ITEM = re.compile(r"(?m)^[ \t]+([A-Za-z_]\w*)(?:[ \t]*\([^)\n]*\))?[ \t]*:[ \t]+")
_MARKER = re.compile(r"(?m)^[ \t*#/!-]*(?:TODO|FIXME|XXX|HACK|NOTE|NB|BUG|WARNING|SAFETY)\b(?:\([^)\n]*\))?[ \t]*[:\-–]*")
_DIRECTIVE = re.compile(r"(?i)^[\W_]*(?:pragma|pylint|noqa|fmt|type|mypy|isort|flake8|eslint[\w-]*|tslint[\w:-]*|@?ts-[\w-]+|prettier[\w-]*|istanbul|jshint|jslint|nosonar|checkstyle|nolint|lint|go|noinspection|clippy|rustfmt|sourcemappingurl|region|endregion|coding|language)(?::|\b(?=[ \t]*(?:[:=]|ignore\b|disable\b|off\b|on\b|skip\b|no cover)))")
_CODE_WORD = re.compile(r"(?a)(?<![A-Za-z0-9_$])(?:[A-Za-z0-9_$]*(?:[A-Za-z0-9]_[A-Za-z0-9]|_[A-Za-z]|[a-z][A-Z]|[A-Za-z]\d|\d[A-Za-z])[A-Za-z0-9_$]*(?:\.[A-Za-z_]\w*)*(?:\(\))?|[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+(?:\([^()\s]*\))?|[A-Za-z_]\w*\(\))")
_CODE_MARK = re.compile(r"[{}=;<>|\\]|\(\)|\[\w*\]|::|->|!=|\+\+|\w\(\w")
_WORD = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー々]+|\p{Thai}+|(?:(?![\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}])[\p{L}\p{M}])+(?:['’\-](?:(?![\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}])[\p{L}\p{M}])+)*")
_ASCII_WORD = re.compile(r"[A-Za-z]+(?:['-][A-Za-z]+)*")
_SENTENCE = re.compile(r"(?<=[.!?।؟])\s+|(?<=[。！？])|\n\s*\n|\n(?=[ \t]*[@:])")
_HUMPS = regex.compile(r"\p{Lu}+(?!\p{Ll})|\p{Lu}?\p{Ll}+|\d+")
_ARTICLES = frozenset(("the", "a", "an", "this"))


def prose(text: str) -> str:
    """What is left of a comment without addresses, markup, tags, markers, directives and names of the code."""
    t = text if text.isascii() else unicodedata.normalize("NFKC", text)
    if "://" in t or "@" in t or "<" in t or "`" in t or "www." in t:
        t = _URL.sub(" ", t)
    if "@" in t or ":" in t or "\\" in t:
        t = _TAG.sub(" ", t)
        t = _DIRECTIVE.sub(" ", t)
    if "\n" in t:
        t = _SECTION.sub(" ", t)
        t = _ITEM.sub(" ", t)
    return _CODE_WORD.sub(" ", _MARKER.sub(" ", t))


def sizes(words: list[str]) -> tuple[int, int, int]:
    """(words of scripts with spaces, ideographs and kana, Thai letters)."""
    plain = wide = thai = 0
    for w in words:
        c = w[0]
        if c < "\u0e00":
            plain += 1
        elif c <= "\u0e7f":
            thai += len(w)
        elif "\u3005" <= c <= "\u9fff" and not "\u3130" <= c <= "\u318f" or "\uf900" <= c <= "\ufaff" or "\uff66" <= c <= "\uff9f" or c >= "\U00020000":
            wide += len(w)
        else:
            plain += 1
    return plain, wide, thai


def read(text: str) -> list[list[str]]:
    """Words of each sentence of a comment; [] unless it holds human language."""
    t = prose(text)
    sentences = [w for w in (_words(part) for part in _SENTENCE.split(t) if part) if w]
    plain, wide, thai = sizes([w for s in sentences for w in s])
    if plain < LEAST_WORDS and wide < LEAST_IDEOGRAPHS and thai < LEAST_THAI:
        return []
    marks = len(_CODE_MARK.findall(text))
    if marks * 3 > plain + wide // 3 + thai // 6:
        return []
    return sentences


def _words(text: str) -> list[str]:
    return _ASCII_WORD.findall(text) if text.isascii() else _WORD.findall(text)


def only_name(sentences: list[list[str]], name: str) -> bool:
    """Whether words are those of a node's name, alone or with an article."""
    own = {h.lower() for h in _HUMPS.findall(name)} | set(name.lower().split("_")) | {name.lower()} | _ARTICLES
    return all(w.lower() in own for s in sentences for w in s)


def is_text(text: str | None, name: str = "") -> bool:
    """Whether a comment holds human language: five words, or a sentence in a script without spaces.

    Code does not count, nor does the name of the node, alone, in words or
    with an article. Null and '' hold none.
    """
    sentences = read(text) if text else []
    return bool(sentences) and not (name and only_name(sentences, name))


def buckets(word: str) -> list[int]:
    """Hash buckets of the n-grams of a word, with its borders."""
    w = f"<{word.lower()}>"
    grams = [w] + [w[i : i + n] for n in (1, 2, 3) for i in range(len(w) - n + 1)]
    return [zlib.crc32(g.encode("utf-8", "replace")) & (BUCKETS - 1) for g in grams]


class Model:
    """Weights (bucket, language). ``scores`` keeps what it has worked out for a word."""

    MEMO = 200_000

    def __init__(self, weights: np.ndarray):
        self.weights, self.known, self.texts = weights, {}, {}

    def scores(self, word: str) -> np.ndarray:
        s = self.known.get(word)
        if s is None:
            s = self.weights[buckets(word)].sum(axis=0)
            if len(self.known) < self.MEMO:
                self.known[word] = s
        return s

    def label(self, words: list[str]) -> str:
        """The most likely language; '' without words. Ties: the first in order."""
        if not words:
            return ""
        return LANGUAGES[int(sum(self.scores(w) for w in words).argmax())]

    def spans(self, sentences: list[list[str]]) -> dict[str, int]:
        """Letters by language, each sentence labelled by itself."""
        out: dict[str, int] = {}
        for words in sentences:
            lang = self.label(words)
            out[lang] = out.get(lang, 0) + sum(len(w) * (3 if "\u3005" <= w[0] <= "\u9fff" else 1) for w in words)
        return out

    def languages(self, text: str, name: str = "") -> dict[str, int]:
        """Letters by language of a comment; {} if it holds no human language, or only the name of its node."""
        got = self.texts.get((text, name))
        if got is None:
            sentences = read(text)
            got = {} if not sentences or (name and only_name(sentences, name)) else self.spans(sentences)
            if len(self.texts) < self.MEMO and len(text) < 200:
                self.texts[text, name] = got
        return got

    def main(self, text: str, name: str = "") -> tuple[str, int]:
        """(language that most of a comment is in, its letters); ('', 0) if it holds no human language. Ties: the first in order."""
        spans = self.languages(text, name)
        best = max(sorted(spans), key=lambda k: spans[k]) if spans else ""
        return best, spans.get(best, 0)


def fit(rows: list[tuple[str, str]], rounds: int = 25, rate: float = 0.6, decay: float = 1e-4) -> Model:
    """A model of (text, language) rows and the seeds; rows that it then contradicts are taken as mislabelled, and it is fitted again."""
    examples: list[tuple[list[str], int, bool]] = []
    for lang, words in SEEDS.items():
        for w in (words, *(" ".join(words.split()[k::4]) for k in range(4))):
            examples.append((_WORD.findall(w), LANGUAGES.index(lang), True))
    for text, lang in rows:
        if lang in LANGUAGES:
            for part in _SENTENCE.split(prose(text)):
                words = _words(part or "")
                if words:
                    examples.append((words, LANGUAGES.index(lang), False))
    first = Model(_descend(examples, rounds, rate, decay))
    kept = [e for e in examples if e[2] or first.label(e[0]) == LANGUAGES[e[1]]]
    return Model(_descend(kept, rounds, rate, decay))


def _descend(examples: list, rounds: int, rate: float, decay: float) -> np.ndarray:
    """Full-batch gradient descent on the softmax loss, steps scaled by each weight's past gradients.

    n-grams stay inside words, so each distinct word is scored once a round
    and an example is the sum of its words: texts are used whole, whatever
    their number of n-grams.
    """
    n, k = len(examples), len(LANGUAGES)
    ids: dict[str, int] = {}
    words = np.fromiter((ids.setdefault(w, len(ids)) for e in examples for w in e[0]), dtype=np.int64)
    lengths = np.array([len(e[0]) for e in examples])
    grams = [buckets(w) for w in ids]
    sizes_ = np.array([len(g) for g in grams])
    index = np.fromiter((b for g in grams for b in g), dtype=np.int64, count=int(sizes_.sum()))
    of_word = np.repeat(np.arange(len(ids)), sizes_)
    of_example = np.repeat(np.arange(n), lengths)
    word_starts, starts = (np.concatenate(([0], np.cumsum(x)[:-1])) for x in (sizes_, lengths))
    value = (1.0 / np.sqrt(np.add.reduceat(sizes_[words], starts))).astype(np.float32)
    truth = np.array([e[1] for e in examples])
    share = np.bincount(truth, minlength=k).astype(np.float32)
    weight = (n / k / np.maximum(share, 1))[truth].astype(np.float32)
    w = np.zeros((BUCKETS, k), np.float32)
    past = np.full((BUCKETS, k), 1e-8, np.float32)
    for _ in range(rounds):
        scored = np.add.reduceat(w[index], word_starts, axis=0)
        logits = np.add.reduceat(scored[words], starts, axis=0) * value[:, None]
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(n), truth] -= 1
        p *= (weight * value)[:, None]
        by_word = np.stack([np.bincount(words, weights=p[of_example, c], minlength=len(ids)) for c in range(k)], axis=1)
        grad = np.stack([np.bincount(index, weights=by_word[of_word, c], minlength=BUCKETS) for c in range(k)], axis=1).astype(np.float32) / n + decay * w
        past += grad**2
        w -= rate * grad / np.sqrt(past)
    return w


def sample(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = PER_LANGUAGE) -> list[tuple[str, str]]:
    """At most ``per_language`` rows of each language, by hash of the key: the bound of what goes to the driver."""
    code = F.lower(F.substring(lang, 1, 2))
    rows = docs.filter(F.col(text).isNotNull() & (F.length(text) > 20) & code.isin(*LANGUAGES)).select(F.col(text).alias("t"), code.alias("l"), F.xxhash64(key).alias("h"))
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("l").orderBy("h", "t"))).filter(F.col("n") <= per_language)
    return [(r.t, r.l) for r in first.select("t", "l").collect()]


def label_comments(semantics: DataFrame, model: Model, every: bool = False) -> DataFrame:
    """(node_id, line, lang, letters): every comment and docstring (line 0) that holds human language.

    ``lang`` is the language that most of the text is in; with ``every`` each
    language of the text has a row with its own letters. Rows without
    node_id are left out; a null list of comments, null comments and null
    lines hold nothing. Rows delivered twice come out once.
    """
    import pyarrow as pa

    shared = semantics.sparkSession.sparkContext.broadcast(model.weights)
    rows = semantics.filter("node_id IS NOT NULL").select("node_id", "docstring", F.col("inline_comments.line").alias("lines"), F.col("inline_comments.text").alias("texts"))

    def label(batches):
        m = Model(shared.value)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for node, doc, lines, texts in zip(*(c.to_pylist() for c in batch.columns)):
                parts = node.split("::")
                name = parts[-2] if len(parts) > 2 else ""
                for line, text in [(0, doc), *zip(lines or (), texts or ())]:
                    if line is None or not text:
                        continue
                    for lang, letters in m.languages(text, name).items() if every else [m.main(text, name)]:
                        if lang:
                            for column, x in zip(out, (node, line, lang, letters)):
                                column.append(x)
            kinds = (pa.string(), pa.int32(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["node_id", "line", "lang", "letters"])

    return rows.mapInArrow(label, "node_id string, line int, lang string, letters long").distinct()


def shares(labelled: DataFrame, nodes: DataFrame) -> DataFrame:
    """(file_path, lang, letters, share): the share each language has of the text in a file's comments.

    A node's file is that of its row with the highest row_seq; nodes that are
    not in ``nodes`` belong to no file.
    """
    where = nodes.filter("node_id IS NOT NULL").groupBy("node_id").agg(F.max_by("file_path", F.struct("row_seq", "file_path")).alias("file_path"))
    by = labelled.join(where, "node_id").groupBy("file_path", "lang").agg(F.sum("letters").alias("letters"))
    return by.withColumn("share", F.col("letters") / F.sum("letters").over(Window.partitionBy("file_path")))


def label_texts(spans: DataFrame, model: Model, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """``keep`` columns with lang and letters, a row for each language of each text; texts without human language are left out."""
    import pyarrow as pa

    shared = spans.sparkSession.sparkContext.broadcast(model.weights)

    def label(batches):
        m = Model(shared.value)
        for batch in batches:
            found = [(k, lang, n) for k, t in enumerate(batch.column(0).to_pylist()) if t for lang, n in m.languages(t).items()]
            kept = [c.take(pa.array([k for k, _, _ in found], pa.int64())) for c in batch.columns[1:]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([x for _, x, _ in found], pa.string()), pa.array([n for _, _, n in found], pa.int64())], names=[*batch.schema.names[1:], "lang", "letters"])

    fields = [f"`{c}` {spans.schema[c].dataType.simpleString()}" for c in keep]
    return spans.select(F.col(text).alias("_text"), *keep).mapInArrow(label, ", ".join([*fields, "lang string", "letters long"]))
