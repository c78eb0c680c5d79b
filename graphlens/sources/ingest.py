"""Source trees to nodes and edges: scan, parse, link."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphlens.session import ship, stage

# What a scan leaves out, what it takes at most, and the extensions a watcher accepts.
SKIPPED = ("node_modules", "__pycache__", "venv", "dist", "build")
MOST_BYTES = 1_000_000
WATCHED = (".py", ".pyi", ".js", ".jsx", ".mjs", ".ts", ".tsx", ".java", ".c", ".h", ".cpp", ".hpp", ".cc", ".cs", ".go", ".rs", ".php", ".swift", ".kt", ".rb", ".m")

PARSED = (
    "path string, error string, line_count int, content_hash string, "
    "nodes array<struct<id:string,type:string,name:string,signature:string,docstring:string,start_line:int,end_line:int,decorators:array<string>,complexity:int,parameters:int,parent_id:string>>, "
    "edges array<struct<source_id:string,target_name:string,type:string,hint:string>>, imports array<struct<alias:string,module:string,name:string>>"
)


def accepted(path: Column) -> Column:
    """Whether a watcher takes a file, by its extension in any case."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).isin(*WATCHED)


def scan(spark: SparkSession, root: str, glob: str = "*.py") -> DataFrame:
    """(path, content, length, modified) of files below a folder; hidden, skipped and too large ones are left out before they are read."""
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    inner = F.regexp_replace("path", r"^[a-z]+:/*" + root.lstrip("/").replace(".", r"\."), "")
    hidden = F.exists(F.split(inner, "/"), lambda x: x.startswith(".") | x.isin(*SKIPPED))
    return files.filter((F.col("length") <= MOST_BYTES) & ~hidden).select("path", "content", "length", F.col("modificationTime").alias("modified"))


def parse_text(path: str, content: bytes) -> dict:
    """One parsed file: nodes, call and definition candidates, imports. What is no valid Python gives an error and no nodes; other files only counts and hash."""
    import ast
    import hashlib

    text = content.decode("utf-8", "replace")
    out = {"path": path, "error": None, "line_count": len(text.splitlines()), "content_hash": hashlib.blake2b(content, digest_size=8).hexdigest(), "nodes": [], "edges": [], "imports": []}
    if not path.endswith((".py", ".pyi")):
        return out
    try:
        tree = ast.parse(text.lstrip("﻿"))
    except (SyntaxError, ValueError, RecursionError) as e:
        out["error"] = f"{type(e).__name__}: {e}"
        return out
    file = hashlib.blake2b(path.encode(), digest_size=4).hexdigest()
    make = lambda kind, name, line: f"{file}::{kind}::{name}::{line}"
    base = path.rpartition("/")[2]
    file_id = make("File", base, 1)
    branches = (ast.If, ast.For, ast.While, ast.AsyncFor, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.BoolOp, ast.IfExp, ast.comprehension, ast.match_case)

    def add(kind, name, node, parent, signature="", doc=""):
        id_ = make(kind, name, getattr(node, "lineno", 1))
        own = [n for n in ast.walk(node)] if kind != "File" else []
        out["nodes"].append({
            "id": id_, "type": kind, "name": name, "signature": signature, "docstring": doc or "", "start_line": getattr(node, "lineno", 1), "end_line": getattr(node, "end_lineno", out["line_count"]) or 1,
            "decorators": ["@" + ast.unparse(d) for d in getattr(node, "decorator_list", [])], "complexity": 1 + sum(isinstance(n, branches) for n in own) if kind == "Function" else 0,
            "parameters": len(node.args.args) + len(node.args.kwonlyargs) if hasattr(node, "args") and hasattr(node.args, "args") else 0, "parent_id": parent,
        })
        if parent:
            out["edges"].append({"source_id": parent, "target_name": id_, "type": "DEFINES", "hint": "id"})
        return id_

    add("File", base, tree, None, doc=ast.get_docstring(tree))

    def walk(node, owner, inside):
        for child in ast.iter_child_nodes(node):
            here = owner
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                word = "async def" if isinstance(child, ast.AsyncFunctionDef) else "def"
                back = f" -> {ast.unparse(child.returns)}" if child.returns else ""
                here = add("Test" if child.name.startswith("test_") else "Function", child.name, child, owner, f"{word} {child.name}({ast.unparse(child.args)}){back}", ast.get_docstring(child))
            elif isinstance(child, ast.ClassDef):
                bases = ", ".join(ast.unparse(b) for b in child.bases)
                here = add("Class", child.name, child, owner, f"class {child.name}({bases})" if bases else f"class {child.name}", ast.get_docstring(child))
                for b in child.bases:
                    out["edges"].append({"source_id": here, "target_name": ast.unparse(b), "type": "INHERITS", "hint": ""})
            elif isinstance(child, ast.Import):
                for a in child.names:
                    out["imports"].append({"alias": a.asname or a.name.split(".")[0], "module": a.name.replace(".", "/"), "name": ""})
                    out["edges"].append({"source_id": file_id, "target_name": a.name, "type": "IMPORTS", "hint": ""})
            elif isinstance(child, ast.ImportFrom):
                module = (child.module or "").replace(".", "/")
                for a in child.names:
                    out["imports"].append({"alias": a.asname or a.name, "module": module, "name": a.name})
                    out["edges"].append({"source_id": file_id, "target_name": a.name, "type": "IMPORTS", "hint": module})
            elif isinstance(child, ast.Call):
                try:
                    out["edges"].append({"source_id": owner, "target_name": ast.unparse(child.func), "type": "CALLS", "hint": ""})
                except (ValueError, RecursionError):
                    pass
            walk(child, here, child)

    walk(tree, file_id, tree)
    return out


def parse(files: DataFrame) -> DataFrame:
    """``PARSED`` rows of files (path, content): one struct row per file, parsed in Arrow batches."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ship(files.sparkSession)
    target = to_arrow_schema(_parse_datatype_string(PARSED))

    def run(batches):
        for batch in batches:
            rows = [parse_text(p, c) for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if p is not None and c is not None]
            yield pa.RecordBatch.from_pylist(rows, schema=target)

    return files.select("path", F.col("content").cast("binary")).mapInArrow(run, PARSED)


def nodes_of(parsed: DataFrame) -> DataFrame:
    """Flat nodes of parsed files, ready for ``schema.make_nodes``."""
    n = parsed.select("path", "content_hash", F.posexplode("nodes").alias("at", "n"))
    return n.select("n.*", F.col("path").alias("file_path"), (F.col("n.end_line") - F.col("n.start_line") + 1).alias("lines"), F.when(F.col("n.docstring") != "", "enriched").otherwise("no_metadata").alias("status"), F.col("content_hash").alias("source_hash"))


def candidates_of(parsed: DataFrame) -> DataFrame:
    """(path, source_id, target_name, type, hint) of parsed files."""
    return parsed.select("path", F.explode("edges").alias("e")).select("path", "e.*")


def link(candidates: DataFrame, nodes: DataFrame, imports: DataFrame) -> DataFrame:
    """(source_id, target_id, type, by): candidates with the node they mean.

    Rules, first that holds: an id; a name in the same file; ``alias.name`` or
    an imported name, where the module is the file's path, then its stem, then
    the first node of that name; else the placeholder '::name::'.
    ``nodes``: (id, name, file_path, seq); ``imports``: (path, alias, module, name).
    """
    c = candidates.withColumn("_row", F.monotonically_increasing_id())
    c = stage(c, "candidates")
    by_id = c.filter("hint = 'id'").select("source_id", F.col("target_name").alias("target_id"), "type", F.lit("id").alias("by"))
    open_ = c.filter("hint <> 'id'")
    last = F.regexp_extract("target_name", r"([^.]*)$", 1)
    first = F.regexp_extract("target_name", r"^([^.]*)", 1)
    named = open_.select("_row", "path", "source_id", "type", "target_name", last.alias("name"), first.alias("alias"), "hint")
    own = nodes.select(F.col("id").alias("target_id"), "name", F.col("file_path").alias("path"), "seq").groupBy("path", "name").agg(F.min_by("target_id", "seq").alias("target_id"))
    same = named.filter("name = target_name OR alias IN ('self', 'cls')").join(own, ["path", "name"]).select("_row", F.lit(0).alias("rule"), F.lit(0).alias("place"), F.lit(0).cast("bigint").alias("seq"), "target_id")
    known = imports.select("path", "alias", "module", F.col("name").alias("original"))
    meant = named.join(known, ["path", "alias"]).select("_row", F.when((F.col("name") == F.col("alias")) & (F.col("original") != ""), F.col("original")).otherwise(F.col("name")).alias("name"), "module")
    meant = stage(meant, "meant")
    found = _imported(meant.select("name", "module").distinct(), nodes)
    cross = meant.join(found, ["name", "module"]).select("_row", F.lit(1).alias("rule"), "place", "seq", "target_id")
    best = same.unionByName(cross).groupBy("_row").agg(F.min(F.struct("rule", "place", "seq", "target_id")).alias("m"))
    done = named.join(best, "_row", "left")
    by = F.when(F.col("m").isNull(), "unresolved").when(F.col("m.rule") == 0, "same_file").otherwise("import")
    target = F.coalesce("m.target_id", F.concat(F.lit("::"), F.col("target_name"), F.lit("::")))
    return by_id.unionByName(done.select("source_id", target.alias("target_id"), "type", by.alias("by")))


def _imported(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """(name, module, place, seq, target_id): what a name imported from a module means, the nearest place first.

    Place 0: the module is the file's path, with or without extension, or its
    last folders; 1: it ends in the file's name; 2: anywhere. Each place is a
    table with one row a key, so a name that many nodes have and many files
    import is no product of both.
    """
    first = F.min(F.struct("seq", F.col("id").alias("target_id"))).alias("n")
    bare = F.regexp_replace("file_path", r"\.[^./]*$", "")
    parts = F.split(bare, "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))
    by_path = nodes.select("id", "name", "seq", F.explode(F.array_distinct(F.concat(ends, F.array("file_path")))).alias("module")).groupBy("name", "module").agg(first)
    by_stem = nodes.select("id", "name", "seq", F.element_at(parts, -1).alias("stem")).groupBy("name", "stem").agg(first)
    anywhere = nodes.groupBy("name").agg(first)
    asked = wanted.withColumn("stem", F.regexp_extract("module", r"([^/]*)$", 1))
    met = asked.join(by_path.withColumnRenamed("n", "p0"), ["name", "module"], "left").join(by_stem.withColumnRenamed("n", "p1"), ["name", "stem"], "left").join(anywhere.withColumnRenamed("n", "p2"), "name")
    place = F.when(F.col("p0").isNotNull(), 0).when(F.col("p1").isNotNull(), 1).otherwise(2)
    return met.select("name", "module", place.alias("place"), F.coalesce("p0", "p1", "p2").alias("n")).select("name", "module", "place", "n.seq", "n.target_id")


def unresolved(linked: DataFrame, nodes: DataFrame) -> DataFrame:
    """(name, uses, candidates): names that stayed placeholders, with how many nodes are called so."""
    name = F.regexp_extract("target_id", r"^::(?:.*\.)?([^.]*)::$", 1)
    uses = linked.filter("by = 'unresolved'").groupBy(name.alias("name")).agg(F.count("*").alias("uses"))
    return uses.join(nodes.groupBy("name").agg(F.count("*").alias("candidates")), "name", "left").fillna(0)


def changed_files(files: DataFrame, status: DataFrame) -> DataFrame:
    """Files (path, content_hash) whose hash differs from the one last parsed, or that were never parsed."""
    return files.join(status.select(F.col("file_path").alias("path"), F.col("content_hash").alias("_kept")), "path", "left").filter(~F.col("content_hash").eqNullSafe(F.col("_kept"))).drop("_kept")


def parse_status(parsed: DataFrame, files: DataFrame) -> DataFrame:
    """(path, status, content_hash): parsed, error, stale (the text has changed since) or not_parsed, for every file (path, content_hash)."""
    kept = parsed.select("path", F.col("content_hash").alias("kept"), F.col("error").isNotNull().alias("bad"))
    status = F.when(F.col("kept").isNull(), "not_parsed").when(~F.col("kept").eqNullSafe(F.col("content_hash")), "stale").when(F.col("bad"), "error").otherwise("parsed")
    return files.select("path", "content_hash").join(kept, "path", "left").select("path", status.alias("status"), "content_hash")


def ensure_parsed(parsed: DataFrame, files: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """``parsed`` with the asked files (path) brought up to date, all by default: new and changed ones are parsed, vanished ones go.

    ``files``: (path, content). One pass from text to replaced rows: what is
    as it was is not parsed again. A null content counts as empty.
    """
    import hashlib

    @F.pandas_udf("string")
    def hashed(content):
        return content.map(lambda c: hashlib.blake2b(c or b"", digest_size=8).hexdigest())

    now = files.filter("path IS NOT NULL").select("path", F.coalesce(F.col("content").cast("binary"), F.lit(b"").cast("binary")).alias("content"))
    wanted = now if asked is None else now.join(asked.select("path").distinct(), "path", "left_semi")
    todo = wanted.withColumn("content_hash", hashed("content")).join(parsed.select("path", F.col("content_hash").alias("kept")), "path", "left").filter(~F.col("content_hash").eqNullSafe(F.col("kept")))
    new = stage(parse(todo.select("path", "content")), "parsed")
    gone = parsed.select("path") if asked is None else parsed.select("path").join(asked.select("path").distinct(), "path", "left_semi")
    gone = gone.join(now.select("path"), "path", "left_anti")
    kept = parsed.join(new.select("path"), "path", "left_anti").join(gone, "path", "left_anti")
    return kept.select(*parsed.columns).unionByName(new.select(*parsed.columns))


def replace_files(nodes: DataFrame, new: DataFrame, files: DataFrame) -> DataFrame:
    """Nodes with those of the given files (file_path) put in the old ones' place."""
    return nodes.join(files.select("file_path").distinct(), "file_path", "left_anti").select(*nodes.columns).unionByName(new.select(*nodes.columns))


def diff_file(nodes: DataFrame, proposed: DataFrame) -> DataFrame:
    """(id, change): nodes a proposed parse of their files adds or removes."""
    files = proposed.select("file_path").distinct()
    now = nodes.join(files, "file_path", "left_semi").select("id")
    then = proposed.select("id")
    return then.join(now, "id", "left_anti").select("id", F.lit("added").alias("change")).unionByName(now.join(then, "id", "left_anti").select("id", F.lit("removed").alias("change")))


def parse_order(pending: DataFrame) -> DataFrame:
    """Pending files (path, priority, seq), each once, lowest number first."""
    first = Window.partitionBy("path").orderBy("priority", "seq")
    return pending.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n").orderBy("priority", "seq")
