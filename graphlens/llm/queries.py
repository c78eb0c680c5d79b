"""Queries of the operators on texts, with SQL where there can be one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.llm import chunklex, docpairs, language, mixing, provenance, sentences, tokens, validity
from graphlens.session import stage, table


def _sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("kind = 'source'")


def _not_by_hand(spark: SparkSession, d: str) -> DataFrame:
    # an attribute file would be a document of that name; where a corpus has none, patterns are mined
    docs = table(spark, d, "documents")
    attributes = docs.filter("file_path LIKE '%.gitattributes'").select("file_path", "text")
    return provenance.classify(_sources(spark, d), table(spark, d, "upstream_files"), attributes)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _not_by_hand(spark, d).select("file_path")


def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _not_by_hand(spark, d)


def p1_lines(spark: SparkSession, d: str) -> DataFrame:
    return provenance.lines_by_repository(_not_by_hand(spark, d), table(spark, d, "parsed_files"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return validity.check(_sources(spark, d)).filter(F.size("errors") > 0).select("file_path").distinct()


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    return validity.rates(validity.check(_sources(spark, d)))


def p2_causes(spark: SparkSession, d: str) -> DataFrame:
    return validity.causes(validity.check(_sources(spark, d)))


def _language_model(spark: SparkSession, d: str) -> language.Model:
    return language.fit(language.sample(table(spark, d, "documents").filter("kind = 'prose'")))


def _labelled(spark: SparkSession, d: str, every: bool = False) -> DataFrame:
    return language.label_comments(table(spark, d, "node_semantics"), _language_model(spark, d), every)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d).select("node_id", "line", "lang").distinct()


def p3_shares(spark: SparkSession, d: str) -> DataFrame:
    return language.shares(_labelled(spark, d, True), table(spark, d, "parsed_nodes"))


def p3_hidden(spark: SparkSession, d: str) -> DataFrame:
    """(file_path, kind, lang, letters, share_of_file): human language in the comments and strings of source files."""
    files = _sources(spark, d)
    found = language.label_texts(chunklex.texts(files), _language_model(spark, d), ("file_path", "kind"))
    by = found.groupBy("file_path", "kind", "lang").agg(F.sum("letters").alias("letters"))
    sizes = files.filter("file_path IS NOT NULL").groupBy("file_path").agg(F.max(F.length("text")).alias("size"))
    return by.join(sizes, "file_path").select("file_path", "kind", "lang", "letters", (F.col("letters") / F.col("size")).alias("share_of_file"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.pairs(table(spark, d, "parsed_nodes"), _sources(spark, d)).select("node_id").distinct()


def p7_pairs(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.pairs(table(spark, d, "parsed_nodes"), _sources(spark, d)).dropDuplicates(["node_id"])


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


def p8_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, same): whether the ids of a document decode to its text."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("original"))
    back = tokens.decode(tokens.encode(table(spark, d, "documents")))
    return docs.join(back, "doc_id").select("doc_id", (F.col("original") == F.col("text")).alias("same"))


def _plan(spark: SparkSession, d: str) -> mixing.Plan:
    sizes = stage(tokens.count_tokens(table(spark, d, "documents"), keep=("doc_id", "source")), "sizes")
    return mixing.Plan(sizes, table(spark, d, "mix_targets"))


def p9_sample(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d).sample()


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d).shares()


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(table(spark, d, "documents").filter("kind = 'prose'"))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_reasons, p1_lines, p2_found, p2_rates, p2_causes, p3_found, p3_shares, p3_hidden, p7_found, p7_pairs, p8_ids, p8_roundtrip, p9_sample, p9_shares, p10_found)}


def oracle_sql() -> dict:
    return {"p8_roundtrip": "select doc_id, true as same from documents"}
