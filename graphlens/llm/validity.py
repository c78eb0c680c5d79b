"""Source files that do not parse: per file, and rates per repository and language.

Each file goes through the recursive-descent parser of the language its
extension stands for; all errors are kept, the first one as the cause.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check(docs: DataFrame, path: str = "file_path", text: str = "text", keep: tuple[str, ...] = ("repo",)) -> DataFrame:
    """(path, keep..., language, errors, first_line, first_cause) of every file of a known extension.

    ``errors`` is an array of (line, cause) with every error, empty for a
    valid file. A null text counts as ''. Rows with a null path or an unknown
    extension are left out; rows delivered twice come out twice.
    """
    import pyarrow as pa

    from graphlens.llm.syntax import LANGUAGES

    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    rows = docs.filter(F.col(path).isNotNull()).select(F.col(path).alias("_path"), *[F.col(c).alias(f"_k_{c}") for c in keep], F.coalesce(F.col(text), F.lit("")).alias("_text"), extension.alias("_ext")).filter(F.col("_ext").isin(sorted(LANGUAGES)))
    kept = rows.columns[: 1 + len(keep)]
    fault = pa.list_(pa.struct([("line", pa.int32()), ("cause", pa.string())]))

    def parse(batches):
        import sys

        from graphlens.llm.syntax import LANGUAGES, errors

        sys.setrecursionlimit(20_000)
        for batch in batches:
            found = [errors(t, e) for t, e in zip(batch.column(len(kept)).to_pylist(), batch.column(len(kept) + 1).to_pylist())]
            languages = ["typescript" if e in ("ts", "tsx", "mts", "cts") else LANGUAGES[e] for e in batch.column(len(kept) + 1).to_pylist()]
            lists = pa.array([[{"line": n, "cause": c} for n, c in f] for f in found], fault)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(languages, pa.string()), lists], names=[*kept, "language", "errors"])

    fields = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept]
    out = rows.mapInArrow(parse, ", ".join([*fields, "language string", "errors array<struct<line:int,cause:string>>"]))
    first = F.when(F.size("errors") > 0, F.element_at("errors", 1))
    out = out.select(*[F.col(c).alias(n) for c, n in zip(kept, (path, *keep))], "language", "errors", first.getField("line").alias("first_line"), first.getField("cause").alias("first_cause"))
    return out


def rates(checked: DataFrame, by: tuple[str, ...] = ("repo", "language")) -> DataFrame:
    """(by..., files, invalid, rate): each file counts once."""
    bad = F.max((F.size("errors") > 0).cast("int"))
    return checked.groupBy(*by, "file_path").agg(bad.alias("bad")).groupBy(*by).agg(F.count("*").alias("files"), F.sum("bad").cast("long").alias("invalid"), (F.sum("bad") / F.count("*")).alias("rate"))


def causes(checked: DataFrame) -> DataFrame:
    """(language, first_cause, files): acceptance per language has a null cause."""
    return checked.groupBy("language", "first_cause").agg(F.countDistinct("file_path").alias("files"))
