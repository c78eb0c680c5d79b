"""Column expressions: scores, similarities, classes and fingerprints. All but two stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Decorators of web handlers, paths of shared code, weights of fields in a search.
HTTP_VERBS = ("get", "post", "put", "delete", "patch", "head", "options")
SHARED_PATHS = ("/utils", "/lib", "/shared", "/helpers")
SEARCH_WEIGHTS = (("name", 3), ("docstring", 2), ("description", 1))


def _lower(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def search_score(name: Column, docstring: Column, description: Column, terms: list[str]) -> Column:
    """Sum over terms: 3 if in the name, 2 in the docstring, 1 in the description; in any case. 0 without terms."""
    fields = {"name": _lower(name), "docstring": _lower(docstring), "description": _lower(description)}
    total = F.lit(0)
    for term in terms:
        for field, weight in SEARCH_WEIGHTS:
            total = total + F.when(fields[field].contains(term.lower()), weight).otherwise(0)
    return total


def locate_score(name: Column, docstring: Column, tags: Column, terms: list[str]) -> Column:
    """struct(score, matched_on). All terms in the name 100, any 50; else all in the docstring 30, any 15; 10 more if a tag holds a term.

    Without terms all of none are met: every row scores 100.
    """
    low = [t.lower() for t in terms]
    n, d = _lower(name), _lower(docstring)
    meets = lambda c, how: F.lit(how == "all") if not low else _fold([c.contains(t) for t in low], how)
    tag = F.lit(False) if not low else F.exists(F.coalesce(tags, F.array().cast("array<string>")), lambda t: _fold([F.lower(t).contains(x) for x in low], "any"))
    base = F.when(meets(n, "all"), 100).when(meets(n, "any"), 50).when(meets(d, "all"), 30).when(meets(d, "any"), 15).otherwise(0)
    said = F.when(meets(n, "all"), "name").when(meets(n, "any"), "name (partial)").when(meets(d, "all"), "docstring").when(meets(d, "any"), "docstring (partial)").otherwise("")
    tagged = F.when(tag, F.when(said == "", F.lit("tags")).otherwise(F.concat(said, F.lit(", tags")))).otherwise(said)
    return F.struct((base + F.when(tag, 10).otherwise(0)).alias("score"), tagged.alias("matched_on"))


def _fold(tests: list[Column], how: str) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = (out & t) if how == "all" else (out | t)
    return out


def characters(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(_lower(c), ""), lambda x: x != ""))


def name_similarity(a: Column, b: Column) -> Column:
    """Jaccard of the sets of lower-case characters; 0 if either is empty or null."""
    x, y = characters(a), characters(b)
    either = F.size(F.array_union(x, y))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / either).otherwise(0.0)


def http_decorators(decorators: Column) -> Column:
    """Those of an array of decorators that name a web verb, with or without '@'. A call such as @app.get(...) does not."""
    bare = lambda d: F.lower(F.regexp_replace(d, "^@+", ""))
    return F.filter(F.coalesce(decorators, F.array().cast("array<string>")), lambda d: bare(d).isin(*HTTP_VERBS))


def role(path: Column, type_: Column, importers: Column, defined: Column, http: Column) -> Column:
    """What a file is for; the first rule that holds decides."""
    shared = _fold([path.contains(s) for s in SHARED_PATHS], "any")
    return (
        F.when(path.contains("/test") | path.contains("/spec"), "test")
        .when(type_ == "Config", "config")
        .when(http > 0, "endpoint")
        .when(path.contains("/routes") | path.contains("/controllers"), "endpoint")
        .when(path.contains("/services") & (importers > 0), "service")
        .when((importers > 5) & shared, "core_utility")
        .when((importers == 0) & (defined == 0), "isolated")
        .otherwise("module")
    )


def severity(dependents: Column) -> Column:
    return F.when(dependents > 10, "high").when(dependents > 3, "medium").otherwise("low")


def risk(blast: Column, average: Column) -> Column:
    return F.when((blast > 10) | (average > 8), "high").when((blast > 3) | (average > 4), "medium").otherwise("low")


def add_tags(old: Column, new: Column) -> Column:
    """Union in order of first sight, each once."""
    return F.array_distinct(F.concat(F.coalesce(old, F.array().cast("array<string>")), new))


def remove_tags(old: Column, gone: Column) -> Column:
    """What is left, repeats and all."""
    return F.filter(F.coalesce(old, F.array().cast("array<string>")), lambda x: ~F.array_contains(gone, x))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine in double; a zero vector has norm 1, so its distance is 1."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda x: F.sqrt(dot(x, x))
    safe = lambda x: F.when(norm(x) == 0, 1.0).otherwise(norm(x))
    return F.lit(1.0) - dot(a, b) / (safe(a) * safe(b))


def signature(*fields: Column) -> Column:
    """SHA-256 of the fields behind each other; '' for null."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]), 256)


def json_signature():
    """SHA-256 of the sorted JSON of a node's seven fields, byte for byte as Python writes JSON."""

    @F.pandas_udf("string")
    def digest(id_, type_, file, name, sig, start, end):
        import hashlib
        import json

        import pandas as pd

        rows = zip(id_, type_, file, name, sig, start, end)
        keys = ("id", "type", "file", "name", "signature", "start_line", "end_line")
        return pd.Series([hashlib.sha256(json.dumps(dict(zip(keys, (*r[:5], int(r[5]), int(r[6])))), sort_keys=True).encode()).hexdigest() for r in rows])

    return digest


def content_hash():
    """blake2b of 8 bytes, in hex, over UTF-8; null stays null."""

    @F.pandas_udf("string")
    def digest(text):
        import hashlib

        import pandas as pd

        return pd.Series([None if t is None else hashlib.blake2b(t.encode("utf-8", "replace"), digest_size=8).hexdigest() for t in text])

    return digest


def short_name_hash(text: Column) -> Column:
    """A JVM-side fingerprint where no equality with other systems is needed."""
    return F.lower(F.hex(F.xxhash64(text)))


def stale_lease(expires_at: Column, now: Column) -> Column:
    """Whether an ISO time has passed; what is no time is not stale."""
    return F.coalesce(F.try_to_timestamp(expires_at) < now, F.lit(False))


def label_escape(value: Column) -> Column:
    """A metric label's value with backslash, quote and line break escaped."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(value, r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n")


def file_stem(path: Column) -> Column:
    """File name without folder and last extension."""
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")


def parse_priority(stale: Column, requested: Column, dependents: Column) -> Column:
    """Lower runs first: asked-for files, then stale ones, then by how much depends on them."""
    return F.when(requested, 0).when(stale, 10).otherwise(F.greatest(F.lit(20), F.lit(90) - F.least(dependents, F.lit(70))))


def snippet(text: Column, chars: int = 80) -> Column:
    return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("…"))).otherwise(text)
