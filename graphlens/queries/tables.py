"""Queries over the driver's other tables: vectors, logs, events, documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.functions import scalar
from graphlens.operators import changelog, enrich, ranking, telemetry, vectors
from graphlens.queries.derived import graph, sql
from graphlens.session import stage, table
from graphlens.sources import exchange, ingest
from graphlens.streaming import pipelines

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(text: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = text
        return f

    return keep


# vectors
def _vectors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("id"), "embedding", F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata"), F.concat(F.lit("vector "), "vec_id").alias("document"), F.col("vec_id").alias("seq"), F.lit(False).alias("deleted"))


_Q = "q as (select embedding as e from embeddings where vec_id = (select min(vec_id) from embeddings))"
_DIST = "round(1 - list_dot_product(list_transform(v.embedding, lambda x: x::double), list_transform(q.e, lambda x: x::double)) / (sqrt(list_dot_product(list_transform(v.embedding, lambda x: x::double), list_transform(v.embedding, lambda x: x::double))) * sqrt(list_dot_product(list_transform(q.e, lambda x: x::double), list_transform(q.e, lambda x: x::double)))), 5) + 0.0"


def _query_vector(spark, d) -> list[float]:
    e = table(spark, d, "embeddings")
    return e.orderBy("vec_id").limit(1).collect()[0].embedding


@query(f"with {_Q} select cast(v.vec_id as varchar) as id, {_DIST} as score from embeddings v, q order by score, id limit 10")
def vector_topk(spark, d):
    return vectors.top_k(_vectors(spark, d), _query_vector(spark, d)).select("id", F.round("score", 5).alias("score"))


@query(f"with {_Q} select cast(v.vec_id as varchar) as id, {_DIST} as score from embeddings v, q where label = 3 order by score, id limit 5")
def vector_topk_where(spark, d):
    return vectors.top_k(_vectors(spark, d), _query_vector(spark, d), 5, {"label": "3"}).select("id", F.round("score", 5).alias("score"))


@query("select cast(vec_id as varchar) as id from embeddings where vec_id % 7 <> 0")
def vector_latest(spark, d):
    v = _vectors(spark, d)
    gone = v.filter("seq % 7 = 0").withColumn("deleted", F.lit(True)).withColumn("seq", F.col("seq") + 10**9)
    return vectors.latest(v.unionByName(gone)).select("id")


@query("""with unit as (select cast(vec_id as varchar) as id, vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings),
    scored as (select q.id as query_id, v.id, 1 - list_dot_product(v.e, q.e) / (sqrt(list_dot_product(v.e, v.e)) * sqrt(list_dot_product(q.e, q.e))) as score from unit q, unit v where q.vec_id % 100 = 0)
    select query_id, id, round(score, 6) + 0.0 as score from (select *, row_number() over (partition by query_id order by score, id) as place from scored) where place <= 10""")
def vector_neighbors(spark, d):
    v = stage(_vectors(spark, d), "vectors")
    return vectors.many_top_k(v, v.filter("seq % 100 = 0").select("id", "embedding"), 10).select("query_id", "id", (F.round("score", 6) + F.lit(0.0)).alias("score"))


@query()
def vector_routed(spark, d):
    v = _vectors(spark, d).withColumn("label", F.element_at("metadata", F.lit("label")))
    return vectors.routed(v, _query_vector(spark, d), "label")


# the change log, made of orders as transactions of their lines
_LOG = """with ctl as (select o_orderkey as k, o_orderstatus as s from orders),
    log as (select l.l_orderkey as tx, cast(l.l_partkey as varchar) as key, l.l_orderkey * 100 + l.l_linenumber as seq from lineitem l),
    kept as (select log.* from log join ctl on k = tx where s <> 'P')"""


def _log(spark, d) -> DataFrame:
    """Each order is BEGIN, its lines as upserts, then COMMIT; orders of status P end with ABORT."""
    orders, lines = table(spark, d, "orders").select(F.col("o_orderkey").alias("tx"), "o_orderstatus"), table(spark, d, "lineitem")
    row = lambda df, seq, rtype, key: df.select(seq.alias("seq"), rtype.alias("rtype"), key.alias("key"), F.col("tx").alias("tx_id"), F.concat(F.lit('{"file_path": "f'), F.pmod(F.xxhash64(key), F.lit(9)).cast("string"), F.lit('"}')).alias("payload"))
    body = row(lines.withColumnRenamed("l_orderkey", "tx"), F.col("tx") * 100 + F.col("l_linenumber"), F.lit("NODE_UPSERT"), F.col("l_partkey").cast("string"))
    end = F.when(F.col("o_orderstatus") == "P", "ABORT").otherwise("COMMIT")
    null = F.lit(None).cast("string")
    return row(orders, F.col("tx") * 100, F.lit("BEGIN"), null).unionByName(body).unionByName(row(orders, F.col("tx") * 100 + 99, end, null))


@query(_LOG + " select key, seq from kept")
def tx_replay(spark, d):
    return changelog.committed(_log(spark, d)).select("key", "seq")


@query(_LOG + " select key, max(seq) as seq, min(seq) as first_seq from kept group by 1")
def changelog_current(spark, d):
    return changelog.replay(_log(spark, d))["nodes"].select("key", "seq", "first_seq")


@query("select 'NODE_UPSERT' as rtype, count(*) as n from lineitem union all select 'BEGIN', count(*) from orders union all select case when o_orderstatus = 'P' then 'ABORT' else 'COMMIT' end, count(*) from orders group by 1")
def changelog_counts(spark, d):
    return changelog.counts(_log(spark, d))


@query("select distinct cast(l_partkey as varchar) as key from lineitem join orders on l_orderkey = o_orderkey where o_orderstatus <> 'P'")
def changelog_compact(spark, d):
    return changelog.compact(_log(spark, d)).select("key").distinct()


@query(sql("select e.source_id, e.target_id, e.type from edges e where e.type = 'IMPORTS' and not exists (select 1 from part p where 'part::' || p_partkey = e.target_id and p_partkey % 5 = 0)"))
def cascade_delete(spark, d):
    g = graph(spark, d)
    deletes = table(spark, d, "part").filter("p_partkey % 5 = 0").select(F.concat(F.lit("part::"), "p_partkey").alias("key"), F.lit(2**62).alias("seq"))
    return changelog.live_edges(g.typed(["IMPORTS"]).select("source_id", "target_id", "type", "seq"), deletes).select("source_id", "target_id", "type")


@query("select user_id, event_type, event_id, value from events qualify row_number() over (partition by user_id, event_type order by event_id desc) = 1")
def latest_per_key(spark, d):
    return enrich.latest_per_key(table(spark, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


# events: audit, metrics, churn, windows, rates
def _events(spark, d):
    return table(spark, d, "events")


@query("select event_id, event_type from events where user_id = 7 or not exists (select 1 from events where user_id = 7)")
def audit_by_session(spark, d):
    log = _events(spark, d).withColumn("session_id", F.col("user_id").cast("string"))
    return telemetry.audit(log, "7").select("event_id", "event_type")


@query("select event_type, count(*) as count, round(sum(value), 4) as sum, round(arg_max(value, event_id), 6) as last from events group by 1")
def metrics_rollup(spark, d):
    return telemetry.metrics(_events(spark, d), ["event_type"], "value", "event_id").select("event_type", "count", F.round("sum", 4).alias("sum"), F.round("last", 6).alias("last"))


@query()
def metrics_exposition(spark, d):
    return telemetry.exposition(telemetry.metrics(_events(spark, d), ["event_type"], "value", "event_id"), "calls", ["event_type"])


@query(sql(""", ch as (select 'part::' || user_id as id, count(*) as changes from events where ts <= timestamp '2024-01-31 00:00:00' and ts > timestamp '2024-01-31 00:00:00' - interval 30 days group by 1),
    ca as (select target_id as id, count(distinct source_id) as callers from edges where type = 'CALLS' group by 1)
    select id, changes, coalesce(callers, 0) as callers, changes * coalesce(callers, 0) as heat from ch left join ca using (id) order by heat desc, changes desc, id limit 10"""))
def telemetry_churn(spark, d):
    import datetime

    ev = _events(spark, d).select(F.concat(F.lit("part::"), "user_id").alias("key"), "ts")
    return telemetry.churn(ev, graph(spark, d), datetime.datetime(2024, 1, 31, tzinfo=datetime.timezone.utc))


@query("select cast(user_id as varchar) as key, count(*) as changes, min(ts) as first_seen, max(ts) as last_seen from events group by 1")
def node_history(spark, d):
    return telemetry.history(_events(spark, d).select(F.col("user_id").cast("string").alias("key"), "ts")).select("key", "changes", "first_seen", "last_seen")


@query("select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n from events group by 1, 2")
def windowed_counts(spark, d):
    return pipelines.windowed_counts(_events(spark, d), ["event_type"], "1 hour").select("start", "event_type", "n")


@query("select user_id, ts, (select count(*) from events b where b.user_id = a.user_id and b.ts <= a.ts and b.ts > a.ts - interval 60 minutes) as n from (select distinct user_id, ts from events) a")
def rate_window_counts(spark, d):
    return pipelines.calls_in_window(_events(spark, d), "user_id", 3600).select("user_id", "ts", "n")


@query("select 'n' || user_id as source_id, event_type as target_id, count(*) as n, min(ts) as first_seen from events group by 1, 2")
def runtime_edges(spark, d):
    calls = _events(spark, d).select(F.concat(F.lit("n"), "user_id").alias("source_id"), F.col("event_type").alias("target_id"), "ts")
    return telemetry.runtime_edges(calls).select("source_id", "target_id", "n", "first_seen")


@query("select event_id, coalesce(try_cast(case when event_id % 3 = 0 then 'never' else strftime(ts, '%Y-%m-%dT%H:%M:%S') end as timestamp) < timestamp '2024-01-15 00:00:00', false) as stale from events")
def lease_staleness(spark, d):
    text = F.when(F.col("event_id") % 3 == 0, "never").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return _events(spark, d).select("event_id", scalar.stale_lease(text, F.lit("2024-01-15 00:00:00").cast("timestamp")).alias("stale"))


# documents: search, hashes, parsing, linking
_BM25 = """with w as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as w from documents),
    s as (select count(*) as n, avg(len(w)) as m from w), t as (select doc_id, len(w) as length, unnest(w) as term from w),
    tf as (select doc_id, length, term, count(*) as tf from t where term in ('scheduler', 'lock', 'replay', 'order') group by 1, 2, 3), df as (select term, count(*) as df from tf group by 1),
    scored as (select doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / m))) as score from tf join df using (term), s group by 1)
    select doc_id, round(score, 6) as score from scored order by round(score, 9) desc, doc_id limit 10"""


@query(_BM25)
def bm25_topk(spark, d):
    return ranking.bm25(table(spark, d, "documents"), "scheduler lock replay order").select("doc_id", F.round("score", 6).alias("score"))


@query("""with w as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as w from documents),
    s as (select count(*) as n, avg(len(w)) as m from w), t as (select doc_id, len(w) as length, unnest(w) as term from w),
    tf as (select doc_id, length, term, count(*) as tf from t where term in ('lock', 'replay') group by 1, 2, 3), df as (select term, count(*) as df from tf group by 1)
    select doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / m))), 6) as score from tf join df using (term), s group by 1 order by sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / m))) desc, doc_id limit 10""")
def bm25_two_terms(spark, d):
    return ranking.bm25(table(spark, d, "documents"), "lock replay").select("doc_id", F.round("score", 6).alias("score"))


@query("select doc_id, content_hash from parsed_files where doc_id is not null group by 1, 2")
def content_hash(spark, d):
    return table(spark, d, "documents").filter("kind = 'source'").select("doc_id", scalar.content_hash()("text").alias("content_hash"))


def _python_files(spark, d):
    return table(spark, d, "documents").filter("kind = 'source' AND file_path LIKE '%.py'").select(F.col("file_path").alias("path"), F.encode("text", "UTF-8").alias("content"))


@query()
def parse_files(spark, d):
    p = ingest.parse(_python_files(spark, d))
    return p.select("path", "line_count", "content_hash", F.size("nodes").alias("nodes"), F.size("edges").alias("edges"), F.col("error").isNull().alias("ok"))


@query()
def parsed_functions(spark, d):
    return ingest.nodes_of(ingest.parse(_python_files(spark, d))).filter("type = 'Function'").select("id", "name", "file_path", "start_line", "end_line", "signature")


@query()
def linked_edges(spark, d):
    p = stage(ingest.parse(_python_files(spark, d)), "parsed")
    nodes = ingest.nodes_of(p).select("id", "name", "file_path", F.xxhash64("id").alias("seq"))
    imports = p.select("path", F.explode("imports").alias("i")).select("path", "i.*")
    return ingest.link(ingest.candidates_of(p), nodes, imports).groupBy("type", "by").agg(F.count("*").alias("n"))


_LINK = r"""with n as (select node_id as id, arg_max(name, row_seq) as name, arg_max(file_path, row_seq) as file_path, max(row_seq) as seq from parsed_nodes group by 1),
    cand as (select c.source_id, c.target_name, c.type, n.file_path as path, regexp_extract(target_name, '[^.]*$') as name, regexp_extract(target_name, '^[^.]*') as alias
      from (select distinct source_id, target_name, edge_type as type from edge_candidates where source_id <> '' and target_name <> '') c join n on n.id = c.source_id),
    own as (select file_path as path, name, arg_min(id, seq) as id from n group by 1, 2),
    imp as (select distinct n.file_path as path, regexp_extract(target_name, '^[^.]*') as alias, regexp_replace(target_file_hint, '\.[^./]*$', '') as module from edge_candidates e join n on n.id = e.source_id where target_file_hint <> '' and contains(target_name, '.')),
    met as (select c.source_id, c.target_name, c.type, (0, 0, 0::bigint, o.id) as m from cand c join own o using (path, name) where c.name = c.target_name or c.alias in ('self', 'cls')
      union all select c.source_id, c.target_name, c.type, (1, case when x.file_path = i.module or x.bare = i.module or ends_with(x.bare, '/' || i.module) then 0 when regexp_extract(x.bare, '[^/]*$') = regexp_extract(i.module, '[^/]*$') then 1 else 2 end, x.seq, x.id)
      from cand c join imp i using (path, alias) join (select *, regexp_replace(file_path, '\.[^./]*$', '') as bare from n) x on x.name = c.name),
    best as (select source_id, target_name, type, min(m) as m from met group by 1, 2, 3)
    select c.source_id, c.type, coalesce(b.m[4], '::' || c.target_name || '::') as target_id, case when b.m is null then 'unresolved' when b.m[1] = 0 then 'same_file' else 'import' end as by
    from cand c left join best b on b.source_id = c.source_id and b.target_name = c.target_name and b.type is not distinct from c.type"""


@query(_LINK)
def linker(spark, d):
    """Every edge candidate with the node it means; imports are what hints say of dotted names."""
    e, last = table(spark, d, "edge_candidates"), lambda c: F.max_by(c, "row_seq").alias(c)
    nodes = table(spark, d, "parsed_nodes").filter("node_id IS NOT NULL").groupBy(F.col("node_id").alias("id")).agg(last("name"), last("file_path"), F.max("row_seq").alias("seq"))
    nodes = stage(nodes, "nodes")
    where = nodes.select(F.col("id").alias("source_id"), F.col("file_path").alias("path"))
    cand = e.filter("source_id <> '' AND target_name <> ''").select("source_id", "target_name", F.col("edge_type").alias("type")).distinct().join(where, "source_id").withColumn("hint", F.lit(""))
    dotted = e.filter("target_file_hint <> '' AND contains(target_name, '.')").join(where, "source_id")
    imports = dotted.select("path", F.regexp_extract("target_name", r"^([^.]*)", 1).alias("alias"), F.regexp_replace("target_file_hint", r"\.[^./]*$", "").alias("module"), F.lit("").alias("name")).distinct()
    return ingest.link(cand, nodes, imports).select("source_id", "type", "target_id", "by")


@query("select file_path, content_hash from parsed_files f where doc_id is not null and exists (select 1 from parsed_files g where g.file_path = f.file_path and g.content_hash <> f.content_hash) group by 1, 2")
def changed_files(spark, d):
    files = table(spark, d, "parsed_files")
    now = files.filter("doc_id IS NOT NULL").select(F.col("file_path").alias("path"), "content_hash").distinct()
    old = files.filter("doc_id IS NULL").select("file_path", "content_hash")
    return ingest.changed_files(now, old).join(old.select(F.col("file_path").alias("path")), "path", "left_semi").select(F.col("path").alias("file_path"), "content_hash").distinct()


@query("select distinct file_path from file_scans where regexp_matches(lower(file_path), '\\.(py|pyi|js|jsx|mjs|ts|tsx|java|c|h|cpp|hpp|cc|cs|go|rs|php|swift|kt|rb|m)$')")
def watched_files(spark, d):
    return table(spark, d, "file_scans").filter(ingest.accepted(F.col("file_path"))).select("file_path").distinct()


@query("select p_partkey, regexp_replace(regexp_extract(f, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1') as stem from (select p_partkey, 'src/a.b/' || p_name || '.test.py' as f from part)")
def file_stem(spark, d):
    return table(spark, d, "part").select("p_partkey", scalar.file_stem(F.concat(F.lit("src/a.b/"), "p_name", F.lit(".test.py"))).alias("stem"))


@query("select 'nodes' as kind, count(*) as n from part where p_partkey % 10 = 0 union all select 'edges', count(*) from lineitem where l_linenumber = 1")
def bulk_import_skipped(spark, d):
    part, line = table(spark, d, "part"), table(spark, d, "lineitem")
    nodes = part.select(F.when(F.col("p_partkey") % 10 == 0, None).otherwise(F.concat(F.lit("p"), "p_partkey")).alias("id"), F.lit("function").alias("type"), F.lit("a.py").alias("file"), F.col("p_name").alias("name"))
    edges = line.select(F.concat(F.lit("p"), "l_partkey").alias("source"), F.when(F.col("l_linenumber") == 1, "").otherwise("x").alias("target"), F.lit(None).cast("string").alias("type"))
    return exchange.load(nodes, edges)[1]


@query()
def checksums(spark, d):
    log = table(spark, d, "documents").select(F.col("doc_id").alias("seq"), F.col("text").alias("payload"))
    return changelog.checksums(log).select(F.col("seq").alias("doc_id"), "crc").distinct()


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
