"""References to records that are missing, deleted or arrive later.

Composite keys may have null parts. References are grouped by which parts are
null; each group is looked up on its non-null parts, as the declared match
semantics say, and what is not found is an orphan. All groups share one join:
the key of a lookup is a 128-bit hash of the mask and the parts, so long paths
are shuffled as 16 bytes. What is found and has a history is then looked at as
of the time of the reference. Keys that hold a large part of the rows are
split in every step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlens.operators.skew import join_unique
from graphlens.session import Staged, stage

#: Tables of at most this many rows go to every executor in a lookup; larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000
SOURCE, FILE, NAME = 0, 1, 2
FIELDS = ("source_id", "target_file_hint", "target_name")

def resolved_path(path: Column) -> Column:
    """The path as a file system takes it: either slash, no '.', '..' resolved, no doubled slash.

    Null stays null. '..' at the top of a relative path is kept; a leading
    slash keeps a path absolute.
    """
    slashes = F.regexp_replace(path, r"\\", "/")
    parts = F.filter(F.split(slashes, "/"), lambda x: (x != "") & (x != "."))
    up = F.lit("..")
    absolute = slashes.startswith("/")
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(
            x == up,
            F.when(F.size(acc) == 0, F.when(absolute, acc).otherwise(F.array(x)))
            .when(F.element_at(acc, -1) == up, F.concat(acc, F.array(x)))
            .otherwise(F.slice(acc, F.lit(1), F.size(acc) - 1)),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    plain = ~slashes.contains("//") & ~slashes.startswith("/") & ~slashes.startswith("./") & ~slashes.contains("/./") & ~slashes.contains("..") & ~slashes.endswith("/") & ~slashes.endswith("/.")
    return F.when(plain, slashes).otherwise(F.concat(F.when(absolute, F.lit("/")).otherwise(F.lit("")), F.array_join(folded, "/")))


def null_mask(parts: list[Column]) -> Column:
    """Which parts of a key are null, as bits from the first part on."""
    bits = [F.when(p.isNull(), 1 << k).otherwise(0) for k, p in enumerate(parts)]
    out = bits[0]
    for b in bits[1:]:
        out = out + b
    return out.cast("int")


def masked_key(field: int | str, mask: Column, parts: list[Column]) -> Column:
    """128 bits of the field, the mask and the parts that are not null; a length before each part keeps them apart."""
    texts = [F.when(p.isNull(), "-").otherwise(F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string"))) for p in parts]
    return F.unhex(F.md5(F.concat_ws("|", F.lit(str(field)), mask.cast("string"), *texts)))


def target_keys(field: int | str, masks: list[int], targets: DataFrame, parts: list[str], kept: tuple[str, ...] = ()) -> DataFrame:
    """(key, kept...) of target rows, once for each mask that references have; a row with a null in a wanted part is met by none."""
    rows = None
    for mask in masks:
        wanted = [p for k, p in enumerate(parts) if not mask >> k & 1]
        cut = [F.lit(None).cast("string") if mask >> k & 1 else F.col(p) for k, p in enumerate(parts)]
        own = targets.dropna(subset=wanted).select(masked_key(field, F.lit(mask), cut).alias("key"), *kept)
        rows = own if rows is None else rows.unionByName(own)
    return rows if rows is not None else targets.limit(0).select(F.lit(None).cast("binary").alias("key"), *kept)


def rule(match: str, mask: int, parts: int) -> str:
    """What a mask means: 'none' (no reference), 'broken', or 'look up'.

    ``simple``: a null part makes it no reference. ``partial``: the parts that
    are not null must occur together. ``full``: all parts or none must be null.
    """
    if match not in ("simple", "partial", "full"):
        raise ValueError(match)
    if mask == (1 << parts) - 1 or (mask and match == "simple"):
        return "none"
    return "broken" if mask and match == "full" else "look up"


def dangling(refs: DataFrame, targets: DataFrame, parts: list[str], match: str = "simple", key: str = "id") -> DataFrame:
    """(key, mask) of references whose parts occur in no row of ``targets`` (the same column names), each once.

    Masks are taken from the data. Rows with a null ``key`` are left out;
    empty targets leave every reference dangling, empty references give none.
    """
    columns = [F.col(p) for p in parts]
    mask = null_mask(columns)
    rows = Staged(refs.filter(F.col(key).isNotNull()).select(F.col(key).alias("_id"), mask.alias("mask"), masked_key("", mask, columns).alias("key")), "references").df
    masks = [r.mask for r in rows.select("mask").distinct().collect()]  # at most two to the number of parts
    by_rule = lambda what: [m for m in masks if rule(match, m, len(parts)) == what]
    known = target_keys("", by_rule("look up"), targets, parts).distinct().withColumn("found", F.lit(True))
    asked = rows.filter(F.col("mask").isin(by_rule("look up")))
    lost = join_unique(asked, known, "key", "left").filter("found IS NULL").select("_id", "mask")
    broken = rows.filter(F.col("mask").isin(by_rule("broken"))).select("_id", "mask")
    return lost.unionByName(broken).select(F.col("_id").alias(key), "mask").distinct()


def as_of(refs: DataFrame, events: DataFrame) -> DataFrame:
    """refs (id, field, key, t) with p and r: the last event of kind 0 and of kind 1 at or before t; null where there is none.

    ``events``: (key, t, kind). Both are put in one order by key and time and
    cut into ranges of it, so a key of any size is spread over many ranges.
    The last values of the key a range begins with come from the ranges
    before it, of which the driver gets two rows each.
    """
    nothing = F.lit(None)
    both = refs.select("key", "t", F.lit(2).alias("kind"), "id", "field").unionByName(events.select("key", "t", "kind", nothing.cast("bigint").alias("id"), nothing.cast("int").alias("field")))
    # id comes last only to cut a run of equal rows
    rows = Staged(both.repartitionByRange("key", "t", "kind", "id").withColumn("range", F.spark_partition_id()), "ordered").df
    when = lambda k: F.when(F.col("kind") == k, F.col("t"))
    by_key = rows.groupBy("range", "key").agg(F.max(when(0)).alias("p"), F.max(when(1)).alias("r"))
    ends = by_key.groupBy("range").agg(F.min(F.struct("key", "p", "r")).alias("first"), F.max(F.struct("key", "p", "r")).alias("last"))
    carried, open_ = [], (None, None, None)
    later = lambda a, b: b if a is None else a if b is None else max(a, b)
    for x in sorted(ends.collect(), key=lambda x: x.range):
        if open_[0] is not None and bytes(x.first.key) == open_[0]:
            carried.append((x.range, x.first.key, open_[1], open_[2]))
        p, r = x.last.p, x.last.r
        if bytes(x.last.key) == open_[0]:  # the whole range is one key
            p, r = later(open_[1], p), later(open_[2], r)
        open_ = (bytes(x.last.key), p, r)
    before = F.broadcast(refs.sparkSession.createDataFrame(carried, "range int, key binary, _p timestamp, _r timestamp"))
    so_far = Window.partitionBy("range", "key").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.select("range", "key", "t", "kind", "id", "field", F.max(when(0)).over(so_far).alias("p"), F.max(when(1)).over(so_far).alias("r")).filter("kind = 2")
    return seen.join(before, ["range", "key"], "left").select("id", "field", "key", "t", F.greatest("p", "_p").alias("p"), F.greatest("r", "_r").alias("r"))


def orphans(edges: DataFrame, nodes: DataFrame, files: DataFrame, removals: DataFrame, symbols: DataFrame) -> DataFrame:
    """(edge_id, ref_field, state) of every broken reference; no row twice.

    source_id and target_file_hint are keys of one part. target_name is a key
    of the parts (hint, repo, last name) under partial match: with a hint the
    repo is null, as the path says it, without one the hint is. A null or ''
    reference is none; a null repo is that of no node. An edge without seen_at
    can only be ``missing``. Edges without edge_id are left out. Repeated rows
    count once.
    """
    filled = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    one = lambda field, part: F.when(part.isNotNull(), masked_key(field, F.lit(0), [part]))
    path, last = resolved_path(F.col("file_path")), F.regexp_extract("target_name", r"([^.]*)$", 1)
    e = edges.filter("edge_id IS NOT NULL").select("edge_id", "repo", "source_id", "target_name", F.col("seen_at").alias("t"), F.when(filled("target_file_hint"), resolved_path(F.col("target_file_hint"))).alias("hint"))
    known_symbols = symbols.filter("symbol IS NOT NULL").select(F.col("symbol").alias("target_name")).distinct().withColumn("external", F.lit(True))
    e = e.join(F.broadcast(known_symbols), "target_name", "left") if symbols.count() <= BROADCAST_ROWS else join_unique(stage(e, "named"), known_symbols, "target_name", "left")
    parts = [F.col("hint"), F.when(F.col("hint").isNull(), F.coalesce("repo", F.lit("\x00"))), last]
    mask = null_mask(parts)
    named = filled("target_name") & (F.col("hint").isNotNull() | F.col("external").isNull())
    # references of an edge, normalised once: 16 bytes each, and mostly the same few values
    wide = Staged(
        e.select(
            "edge_id",
            "t",
            F.when(filled("source_id"), one(SOURCE, F.col("source_id"))).alias("source"),
            one(FILE, F.col("hint")).alias("file"),
            F.when(named, mask).alias("mask"),
            F.when(named, masked_key(NAME, mask, parts)).alias("name"),
        ),
        "references",
    ).df
    masks = [r.mask for r in wide.select("mask").filter("mask IS NOT NULL").distinct().collect()]
    ref = lambda field, key, also: F.struct(F.lit(field).cast("int").alias("field"), F.col(key).alias("key"), also.alias("also"))
    nothing = F.lit(None).cast("binary")
    long = wide.select("edge_id", "t", F.explode(F.array(ref(SOURCE, "source", nothing), ref(FILE, "file", nothing), ref(NAME, "name", F.col("file")))).alias("x")).select("edge_id", "t", "x.*").filter("key IS NOT NULL")

    # what is referred to: one row a key
    gone = removals.filter("object_key IS NOT NULL AND removed_at IS NOT NULL")
    removed = gone.filter("object_kind = 'node'").select(one(SOURCE, F.col("object_key")).alias("key"), F.col("removed_at").alias("t")).unionByName(
        gone.filter("object_kind = 'file'").select(one(FILE, resolved_path(F.col("object_key"))).alias("key"), F.col("removed_at").alias("t"))
    )
    parsed = nodes.select(one(SOURCE, F.col("node_id")).alias("key"), F.col("parsed_at").alias("t")).unionByName(files.select(one(FILE, path).alias("key"), F.col("parsed_at").alias("t"))).filter("key IS NOT NULL AND t IS NOT NULL")
    targets = nodes.filter(filled("name")).select(path.alias("hint"), F.regexp_extract(path, r"^([^/]*)", 1).alias("repo"), F.col("name").alias("last"))
    names = target_keys(NAME, masks, targets, ["hint", "repo", "last"])
    when, no = F.lit(None).cast("timestamp"), F.lit(False)
    known = (
        parsed.select("key", "t", F.lit(True).alias("found"), no.alias("gone"))
        .unionByName(names.select("key", when.alias("t"), F.lit(True).alias("found"), no.alias("gone")))
        .unionByName(removed.select("key", when.alias("t"), no.alias("found"), F.lit(True).alias("gone")))
        .groupBy("key")
        .agg(F.min("t").alias("first"), F.max("found").alias("found"), F.max("gone").alias("gone"))
    )
    known = stage(known.filter("found").drop("found"), "known")
    lost = F.when(F.col("gone").isNull(), "missing").when(F.col("field") == NAME, None).when(F.col("first") > F.col("t"), "late").when(F.col("gone") & F.col("t").isNotNull(), "look")
    met = join_unique(long, known, "key", "left").withColumn("state", lost).filter("state IS NOT NULL")
    met = stage(met.select("edge_id", "field", "key", "t", "also", "state"), "open")

    field = F.element_at(F.array(*[F.lit(f) for f in FIELDS]), F.col("field") + 1).alias("ref_field")
    told = met.filter("state IN ('missing', 'late') AND (field <> 2 OR also IS NULL)").select("edge_id", "field", "state")
    # a name that its file lacks counts if the file itself is there
    hinted = stage(met.filter("field = 2 AND also IS NOT NULL").select("edge_id", F.col("also").alias("key")), "hinted")
    in_file = join_unique(hinted, known.select("key"), "key").select("edge_id", F.lit(NAME).alias("field"), F.lit("missing").alias("state"))
    # the history of keys that were removed once or more
    events = parsed.withColumn("kind", F.lit(0)).unionByName(removed.withColumn("kind", F.lit(1))).join(removed.select("key").distinct(), "key", "left_semi")
    looked = as_of(met.filter("state = 'look'").select(F.col("edge_id").alias("id"), "field", "key", "t"), events)
    deleted = looked.filter("r > p").select(F.col("id").alias("edge_id"), "field", F.lit("deleted").alias("state"))
    return told.unionByName(in_file).unionByName(deleted).select("edge_id", field, "state").distinct()


def report(found: DataFrame, edges: DataFrame, unit: str = "month") -> DataFrame:
    """(ref_field, target_table, state, period, n): broken references by table and period of seen_at."""
    when = edges.filter("edge_id IS NOT NULL").groupBy("edge_id").agg(F.date_trunc(unit, F.min("seen_at")).alias("period"))
    target = F.when(F.col("ref_field") == "target_file_hint", "parsed_files").otherwise("parsed_nodes")
    return found.join(when, "edge_id").groupBy("ref_field", target.alias("target_table"), "state", "period").agg(F.count(F.lit(1)).alias("n"))
