"""Encoding of the whole corpus with a public byte-level tokenizer.

Method: a table of distinct words. Texts are split into words inside Spark and
counted; every distinct word is encoded once; ids are joined back by position.
The most frequent words (a fixed number of bounded length) go to the workers
as a dictionary, all others are joined by shuffle, so nothing that grows with
the data is broadcast.
"""

from __future__ import annotations

import base64
from array import array
from collections import Counter
from functools import lru_cache
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.operators.skew import join_unique
from graphlens.session import stage

#: Where the vocabulary files lie unless the caller says otherwise.
FOLDER = "/opt/tokenizers"
#: Words that are looked up in a broadcast dictionary: this many, of at most LONGEST characters.
FREQUENT, LONGEST = 2**17, 64
#: Distinct words a task counts before it passes them on.
FLUSH = 200_000
#: Bytes of text that a worker takes from an Arrow batch, and whose ids it hands back, at a time.
PART = 2**20

# The split pattern of the byte-level vocabularies, once for all of Unicode and once for ASCII texts.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
ASCII_WORDS = r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"


def read_ranks(path: str) -> list[tuple[bytes, int]]:
    with open(path, "rb") as f:
        return [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, f)]


# The same where a text has no number but decimal digits and none of the control characters that Python takes for white space.
COMMON_WORDS = r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"


@lru_cache(maxsize=1)
def splitter():
    """A function from text to words; joined, the words give the text again."""
    import re
    import unicodedata

    import regex

    plain, common, full = re.compile(ASCII_WORDS).findall, re.compile(COMMON_WORDS).findall, regex.compile(WORDS).findall
    alike: set[str] = set()  # characters that COMMON_WORDS takes as WORDS does

    def split(text: str) -> list[str]:
        if text.isascii():
            return plain(text)
        new = set(text) - alike
        if new:
            alike.update(c for c in new if not "\x1c" <= c <= "\x1f" and unicodedata.category(c) not in ("No", "Nl", "Cn"))
            if not new <= alike:
                return full(text)
        return common(text)

    return split


def _parts(batches):
    """The batches in slices of at most PART bytes of text, which is the first column, or of one row."""
    import pyarrow.compute as pc

    for batch in batches:
        start = size = 0
        for k, n in enumerate(pc.fill_null(pc.binary_length(batch.column(0)), 0).to_pylist()):
            if k > start and size + n > PART:
                yield batch.slice(start, k - start)
                start, size = k, 0
            size += n
        yield batch.slice(start)


def word_table(texts: DataFrame, text: str, ranks: list[tuple[bytes, int]]) -> DataFrame:
    """(word, n, ids): each distinct word of all texts once, with its count and ids. Null and '' texts have none."""
    import pyarrow as pa

    shared = texts.sparkSession.sparkContext.broadcast(ranks)

    def count(batches):
        find, seen = splitter(), Counter()
        for batch in _parts(batches):
            for t in batch.column(0).to_pylist():
                if t:
                    seen.update(find(t))
                    if len(seen) > FLUSH:
                        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
                        seen = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    def encode(batches):
        import tiktoken

        # the pattern is not used: words are encoded as they are
        own = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=dict(shared.value), special_tokens={})
        for batch in batches:
            words, n = batch.column(0), batch.column(1)
            yield pa.RecordBatch.from_arrays([words, n, pa.array([own.encode_ordinary(w) for w in words.to_pylist()], pa.list_(pa.int32()))], names=["word", "n", "ids"])

    counted = texts.select(F.col(text)).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.mapInArrow(encode, "word string, n long, ids array<int>")


def _frequent(words: DataFrame) -> dict[str, tuple]:
    top = words.filter(F.length("word") <= LONGEST).orderBy(F.desc("n"), "word").limit(FREQUENT).select("word", "ids").toArrow()
    return dict(zip(top.column(0).to_pylist(), map(tuple, top.column(1).to_pylist())))


def encode(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), folder: str = FOLDER, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """``keep`` columns and ids (array<int>) of every row; [] for null and '' texts.

    A text that looks like a special token is ordinary text. Rows delivered
    twice come out twice.
    """
    return _encoded(df, text, keep, folder, vocabulary, False)


def count_tokens(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), folder: str = FOLDER, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """``keep`` columns and tokens (long): the number of ids ``encode`` gives."""
    return _encoded(df, text, keep, folder, vocabulary, True)


def _encoded(df: DataFrame, text: str, keep: tuple[str, ...], folder: str, vocabulary: str, only_count: bool) -> DataFrame:
    import pyarrow as pa

    spark = df.sparkSession
    words = stage(word_table(df, text, read_ranks(f"{folder}/{vocabulary}.tiktoken")), "words")
    frequent = _frequent(words)
    table = spark.sparkContext.broadcast({w: len(i) for w, i in frequent.items()} if only_count else frequent)

    def look_up(batches):
        find, known = splitter(), table.value
        for batch in _parts(batches):
            flat, ends, rares = array("i"), [0], []
            for t in batch.column(0).to_pylist():
                found = find(t) if t else []
                parts, rare = list(map(known.get, found)), None
                if None in parts:
                    rare, slots, k = [], {}, parts.index(None)
                    for k in [k, *(n for n in range(k + 1, len(parts)) if parts[n] is None)]:
                        w = found[k]
                        if only_count:
                            rare.append(w)
                            parts[k] = 0
                        else:
                            if w not in slots:
                                slots[w] = len(rare)
                                rare.append(w)
                            parts[k] = (-1 - slots[w],)
                if only_count:
                    flat.append(sum(parts))
                else:
                    flat.extend(chain.from_iterable(parts))
                    ends.append(len(flat))
                rares.append(rare)
            numbers = pa.array(memoryview(flat), pa.int32()) if len(flat) else pa.array([], pa.int32())
            if not only_count:
                numbers = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), numbers)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], numbers, pa.array(rares, pa.list_(pa.string()))], names=[*batch.schema.names[1:], "_known", "_rare"])

    fields = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]
    found = df.select(F.col(text).alias("_text"), *keep).mapInArrow(look_up, ", ".join([*fields, "_known int" if only_count else "_known array<int>", "_rare array<string>"]))
    found = stage(found.withColumn("_row", F.monotonically_increasing_id()), "looked-up")
    rare = stage(found.filter("_rare IS NOT NULL").select("_row", F.posexplode("_rare").alias("k", "word")), "rare")
    more = join_unique(rare, words.select("word", "ids"), "word")
    full = found.filter("_rare IS NULL")
    if only_count:
        extra = more.groupBy("_row").agg(F.sum(F.size("ids")).alias("extra"))
        part = found.filter("_rare IS NOT NULL").join(extra, "_row")
        return full.select(*keep, F.col("_known").cast("long").alias("tokens")).unionByName(part.select(*keep, (F.col("_known") + F.col("extra")).cast("long").alias("tokens")))
    # one row has at most as many rare words as its text has words
    fill = more.groupBy("_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x.ids).alias("fill"))
    part = found.filter("_rare IS NOT NULL").join(fill, "_row")
    ids = F.flatten(F.transform("_known", lambda x: F.when(x >= 0, F.array(x)).otherwise(F.element_at("fill", -x))))
    return full.select(*keep, F.col("_known").alias("ids")).unionByName(part.select(*keep, ids.alias("ids")))


def decode(encoded: DataFrame, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), folder: str = FOLDER, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """``keep`` columns and text: the text that the ids stand for; '' for no ids.

    The ids are joined with the table of pieces by position: the table is a
    file of fixed size, so every worker holds it, and a batch's ids take their
    pieces in one step, in order, so no row is unfolded or moved. An id that is
    no piece, or null, makes the text null; bytes that are no UTF-8 are
    replaced.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast(read_ranks(f"{folder}/{vocabulary}.tiktoken"))

    def joined(batches):
        import numpy as np

        table: list = [None] * (max(r for _, r in shared.value) + 1)
        for piece, rank in shared.value:
            table[rank] = piece
        pieces = pa.array(table, pa.large_binary())
        for batch in batches:
            lists = batch.column(0)
            at = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)))).astype(np.int64)
            flat = lists.flatten()
            known = pc.fill_null(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(pieces))), False)
            taken = pieces.take(pc.if_else(known, flat, None))
            lost = np.concatenate(([0], np.cumsum(pc.is_null(taken).to_numpy(zero_copy_only=False)))).astype(np.int64)
            sizes = pc.fill_null(pc.binary_length(taken), 0).to_numpy(zero_copy_only=False)
            ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
            data = b"".join(x for x in taken.to_pylist() if x) if len(taken) else b""
            texts = [None if lost[j] > lost[i] else data[ends[i] : ends[j]].decode("utf-8", "replace") for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], names=[*batch.schema.names[1:], "text"])

    fields = [f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in keep]
    return encoded.select(F.col(ids).alias("_ids"), *keep).mapInArrow(joined, ", ".join([*fields, "text string"]))
