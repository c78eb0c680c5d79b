"""Queries of the graph operators over the derived graph, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.functions import scalar
from graphlens.operators import community, enrich, explore, ranking, sets, telemetry, traverse
from graphlens.plans import pathql
from graphlens.queries.derived import graph, sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(text: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = text
        return f

    return keep


# lookups and filters
@query(sql("select id, name, file_path from nodes where type = 'Package'"))
def find_nodes_by_type(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).find_nodes("Package").select("id", F.col("structural.name").alias("name"), "file_path")


@query(sql("select id, type, seq from nodes where id = 'part::7'"))
def get_node(spark, d):
    return graph(spark, d).get_node("part::7").select("id", "type", "seq")


@query(sql("select id from nodes where type = 'Function' and file_path = 'src/shared/p7.py'"))
def find_nodes_conjunction(spark, d):
    return graph(spark, d).find_nodes("Function", "src/shared/p7.py").select("id")


@query(sql("select source_id, target_id, type, 'outgoing' as side from edges where source_id = 'part::1' and type = 'CALLS' union all select source_id, target_id, type, 'incoming' from edges where target_id = 'part::1' and type = 'CALLS'"))
def get_edges_both(spark, d):
    return graph(spark, d).get_edges("part::1", "CALLS").select("source_id", "target_id", "type", "side")


@query(sql("select id from nodes where starts_with(file_path, 'src/shared/')"))
def scope_prefix(spark, d):
    return graph(spark, d).in_scope("package:src/shared").select("id")


@query(sql("select id, name from nodes where regexp_matches(name, '(?i)^S.*(ring|bolt)$')"))
def regex_filter(spark, d):
    return graph(spark, d).nodes.filter(pathql.condition(pathql.Filter("name", "=~", "(?i)^S.*(ring|bolt)$"))).select("id", F.col("structural.name").alias("name"))


@query(sql("select count(*) as nodes, (select count(*) from edges) as edges from nodes"))
def count_graph(spark, d):
    return telemetry.summary(graph(spark, d))


@query(sql("select type, count(*) as n from nodes group by type"))
def count_by_type(spark, d):
    return telemetry.types(graph(spark, d))


# degrees
_DEGREE = "deg as (select n.id, n.seq, n.type, n.name, n.file_path, n.complexity, coalesce(i.c, 0) as in_degree, coalesce(o.c, 0) as out_degree from nodes n left join (select target_id as id, count(*) as c from edges group by 1) i using (id) left join (select source_id as id, count(*) as c from edges group by 1) o using (id))"


@query(sql(f", {_DEGREE} select id, in_degree, out_degree, in_degree + out_degree as degree from deg"))
def degree(spark, d):
    return telemetry.degrees(graph(spark, d))


@query(sql(f", {_DEGREE} select id as node_id, name, file_path as file, type, in_degree + out_degree as degree, in_degree, out_degree from deg where in_degree + out_degree >= 5 order by degree desc, seq limit 10"))
def hot_nodes(spark, d):
    return telemetry.hot_nodes(graph(spark, d), 5, 10)


@query(sql(f", {_DEGREE} select id, in_degree + out_degree as degree, complexity, in_degree + out_degree > 10 or complexity > 8 as is_hot from deg"))
def hot_report(spark, d):
    return telemetry.hot_report(graph(spark, d))


@query(sql("select source_id as id, 'out' as side, type, count(*) as n from edges where source_id in (select id from nodes) group by 1, 3 union all select target_id, 'in', type, count(*) from edges where target_id in (select id from nodes) group by 1, 3"))
def edges_by_type_per_node(spark, d):
    return telemetry.edges_by_type(graph(spark, d)).select("id", "side", "type", "n")


# path expressions
def _edges(spark, d, text):
    return pathql.run(graph(spark, d), text).edges


@query(sql("select distinct e.source_id, e.target_id, e.type from edges e join nodes a on a.id = e.source_id join nodes b on b.id = e.target_id where e.type = 'CALLS' and a.type = 'Function' and b.type = 'Function'"))
def path_one_hop(spark, d):
    return _edges(spark, d, "Function CALLS Function")


@query(sql("""select distinct e.source_id, e.target_id, e.type from edges e where e.type = 'CONTAINS' and e.source_id = 'region::1'
    union select distinct f.source_id, f.target_id, f.type from edges e join edges f on f.source_id = e.target_id join nodes n on n.id = f.target_id where e.type = 'CONTAINS' and e.source_id = 'region::1' and f.type = 'CONTAINS' and n.type = 'File'"""))
def path_two_hop(spark, d):
    return _edges(spark, d, "*[id='region::1'] CONTAINS Package CONTAINS File")


@query(sql("select distinct e.source_id, e.target_id, e.type from edges e join nodes n on n.id = e.source_id where e.type = 'DEFINES' and n.type = 'File' and e.target_id in (select id from nodes where type = 'Class' and name = '1-URGENT')"))
def path_incoming(spark, d):
    return _edges(spark, d, "Class[name='1-URGENT'] <-DEFINES<- File")


@query(sql("select distinct source_id, target_id, type from edges where type = 'CALLS' and ((source_id = 'part::3' and target_id in (select id from nodes)) or (target_id = 'part::3' and source_id in (select id from nodes)))"))
def path_both(spark, d):
    return _edges(spark, d, "*[id='part::3'] <->CALLS<-> Function")


@query(sql("select distinct e.source_id, e.target_id, e.type from edges e join nodes b on b.id = e.target_id where e.source_id = 'supplier::3' and b.type = 'Function'"))
def path_untyped(spark, d):
    return _edges(spark, d, "*[id='supplier::3'] -> Function")


@query(sql("select distinct e.source_id, e.target_id, e.type from edges e join nodes b on b.id = e.target_id where e.type = 'IMPORTS' and e.source_id = 'supplier::3' and b.type = 'Function' and b.docstring <> 'PROMO' and regexp_matches(b.name, '^(red|old) ')"))
def path_filter_target(spark, d):
    return _edges(spark, d, "*[id='supplier::3'] IMPORTS Function[docstring!='PROMO', name=~'^(red|old) ']")


@query(sql(""", reach as (select target_id as id from edges where type = 'CONTAINS' and source_id = 'region::2' union select e.target_id from edges e join reach r on e.source_id = r.id where e.type = 'CONTAINS')
    select distinct source_id, target_id, type from edges where type = 'CONTAINS' and (source_id = 'region::2' or source_id in (select id from reach)) and target_id in (select id from nodes)""", True))
def path_transitive(spark, d):
    return _edges(spark, d, "*[id='region::2'] CONTAINS+ File")


@query(sql("select count(*) + 1 as matched_nodes, count(*) as matched_edges, count(*) as terminal_nodes, 1 as hops from edges where type = 'CONTAINS' and source_id = 'region::0'"))
def path_stats(spark, d):
    return pathql.run(graph(spark, d), "*[id='region::0'] CONTAINS Package").stats


# walks
_LEVELS = "walk as (select '{start}' as id, 0 as level union select {far}, w.level + 1 from walk w join edges e on e.{near} = w.id where w.level < {depth} and e.type in ({types}) and {far} in (select id from nodes))"


@query(sql(", " + _LEVELS.format(start="part::1", far="e.target_id", near="source_id", depth=3, types="'CALLS'") + " select id, min(level) as level from walk group by id", True))
def trace_depth3(spark, d):
    return traverse.distances(graph(spark, d), "part::1", ["CALLS"], most=3)


def _capped(start: str, depth: int, cap: int) -> str:
    """Levels unrolled: a level holds what no earlier one has, in order of parent, then edge; a row stays if its parent came before the cap."""
    out, before = f", l0 as (select '{start}' as id, 0 as level, 0::bigint as rank, -1::bigint as parent_rank)", "select * from l0"
    for k in range(1, depth + 1):
        out += f""", m{k} as (select e.target_id as id, min((w.rank, e.seq)) as m from l{k - 1} w join edges e on e.source_id = w.id where e.type = 'CALLS' and e.target_id in (select id from nodes)
            and e.target_id not in (select id from ({before})) group by 1),
            a{k} as (select id, {k} as level, row_number() over (order by m, id) - 1 + (select count(*) from ({before})) as rank, m[1] as parent_rank from m{k}),
            l{k} as (select * from a{k} a where (select count(*) from ({before} union all select * from a{k}) b where b.parent_rank < a.parent_rank) < {cap})"""
        before += f" union all select * from l{k}"
    return out + f", walked as ({before})"


@query(sql(_capped("part::1", 3, 100) + " select w.id, level, rank, n.name from walked w join nodes n using (id)").replace("a.parent_rank) <", "a.parent_rank) + 0 <"))
def trace_capped(spark, d):
    return traverse.trace(graph(spark, d), "part::1").select("id", "level", "rank", "name")


@query(sql(", " + _LEVELS.format(start="part::6", far="e.source_id", near="target_id", depth=2, types="'CALLS', 'IMPORTS', 'DEFINES'") + " select id, min(level) as level from walk group by id", True))
def impact_reverse(spark, d):
    return traverse.distances(graph(spark, d), "part::6", ["CALLS", "IMPORTS", "DEFINES"], "incoming", 2)


@query(sql("select 'nation::' || n_nationkey as id, 'low' as severity from nation where n_nationkey = 3 union all select 'region::' || n_regionkey, 'low' from nation where n_nationkey = 3 limit 0"))
def impact_nothing(spark, d):
    return traverse.impact(graph(spark, d), "no such entity").select("id", "severity")


@query(sql("select f.file_path from (select 'customer::' || o_custkey as id from orders where o_orderkey = (select min(o_orderkey) from orders) union all select 'orders::' || min(o_orderkey) from orders) x join nodes f using (id)"))
def impact_files(spark, d):
    g = graph(spark, d)
    first = g.find_nodes("Class").orderBy("seq").limit(1).collect()[0].id
    return traverse.impact_files(traverse.impact(g, first)).select("file_path")


@query(sql(", " + _LEVELS.format(start="region::0", far="e.target_id", near="source_id", depth=10, types="'CONTAINS'") + " select id from walk where level > 0 group by id", True))
def reachable(spark, d):
    g = graph(spark, d)
    return traverse.reachable(g, g.get_node("region::0"), ["CONTAINS"])


@query(sql(", " + _LEVELS.format(start="part::1", far="e.target_id", near="source_id", depth=6, types="'CALLS', 'DEFINES'") + " select cast(min(level) as bigint) as length from walk where id = 'part::2'", True))
def shortest_flow_length(spark, d):
    return traverse.flow(graph(spark, d), "part::1", "part::2").agg((F.count("*") - 1).alias("length"))


@query(sql("select id, min(level) as level from (select 'region::0' as id, 0 as level union all select 'region::3', 0 union all select case when source_id in ('region::0', 'region::3') then target_id else source_id end, 1 from edges where source_id in ('region::0', 'region::3') or target_id in ('region::0', 'region::3')) group by id"))
def seed_walk(spark, d):
    g = graph(spark, d)
    return traverse.seed_walk(g, g.nodes.filter(F.col("id").isin("region::0", "region::3")), 1)


# single entities
@query(sql("""select relation, id from (select 'entity' as relation, 'part::5' as id union all select 'calls', target_id from edges where source_id = 'part::5' and type = 'CALLS'
    union all select 'called_by', source_id from edges where target_id = 'part::5' and type = 'CALLS' union all select 'imported_by', source_id from edges where target_id = 'part::5' and type = 'IMPORTS')"""))
def navigate_relationships(spark, d):
    return explore.navigate(graph(spark, d), "part::5").select("relation", "id")


@query(sql("""select side, position, edge_type, n.name as other, n.file_path as file from (select 'outgoing' as side, target_id as o, type as edge_type, row_number() over (order by seq, source_id, target_id, type) as position from edges where source_id = 'part::5'
    union all select 'incoming', source_id, type, row_number() over (order by seq, source_id, target_id, type) from edges where target_id = 'part::5') x join nodes n on n.id = x.o where position <= 3"""))
def why_first_k(spark, d):
    return explore.why(graph(spark, d), "part::5").select("side", F.col("position").cast("bigint").alias("position"), "edge_type", "other", "file")


_SCORE = "(case when contains(lower(name), 'bolt') then 3 else 0 end + case when contains(lower(docstring), 'bolt') then 2 else 0 end + case when contains(lower(name), 'econ') then 3 else 0 end + case when contains(lower(docstring), 'econ') then 2 else 0 end)"


@query(sql(f"select id, type, name, file_path, {_SCORE} as score from nodes where {_SCORE} > 0 order by score desc, seq limit 5"))
def search_topk(spark, d):
    return explore.search(graph(spark, d), ["bolt", "ECON"])


@query(sql("""select id, name, file_path as file, case when contains(lower(name), 'machinery') then 100 when contains(lower(docstring), 'machinery') then 30 end as score from nodes where contains(lower(name), 'machinery') or contains(lower(docstring), 'machinery') order by score desc, seq limit 5"""))
def locate_topk(spark, d):
    return explore.locate(graph(spark, d), "machinery").select("id", "name", "file", "score")


_CHARS = "list_distinct(list_filter(string_split(lower({0}), ''), lambda x: x <> ''))"


@query(sql(f""", me as (select type, name from nodes where file_path = 'repo/nation_1' order by seq limit 1),
    liked as (select n.file_path, n.name, n.seq, len(list_intersect({_CHARS.format("n.name")}, {_CHARS.format("me.name")})) * 1.0 / len(list_distinct(list_concat({_CHARS.format("n.name")}, {_CHARS.format("me.name")}))) as s from nodes n join me using (type) where n.file_path <> 'repo/nation_1')
    select file_path, name, round(s, 2) as similarity from liked where s > 0.5 order by similarity desc, seq limit 5"""))
def related_patterns(spark, d):
    return explore.related_patterns(graph(spark, d), "repo/nation_1")


@query(sql("""select id, len(list_intersect(a, b)) * 1.0 / len(list_distinct(list_concat(a, b))) as similarity from (select id, list_distinct(list_filter(string_split(lower(name), ''), lambda x: x <> '')) as a, list_distinct(string_split('germany', '')) as b from nodes where type = 'Package')"""))
def name_jaccard(spark, d):
    return graph(spark, d).find_nodes("Package").select("id", scalar.name_similarity(F.col("structural.name"), F.lit("germany")).alias("similarity"))


_FILES = """, first as (select file_path, arg_min(id, seq) as id, arg_min(type, seq) as type from nodes group by 1),
    imp as (select target_id as id, count(*) as blast from edges where type = 'IMPORTS' group by 1),
    def as (select e.source_id as id, count(*) as defined, avg(n.complexity) as mean, max(n.complexity) as most from edges e join nodes n on n.id = e.target_id where e.type = 'DEFINES' group by 1),
    summed as (select f.file_path, f.id, f.type, coalesce(blast, 0) as blast, coalesce(defined, 0) as defined, coalesce(mean, 0) as mean, coalesce(most, 0) as most from first f left join imp using (id) left join def using (id))"""


@query(sql(_FILES + """ select file_path, case when contains(file_path, '/test') or contains(file_path, '/spec') then 'test' when type = 'Config' then 'config' when contains(file_path, '/routes') or contains(file_path, '/controllers') then 'endpoint'
    when contains(file_path, '/services') and blast > 0 then 'service' when blast > 5 and (contains(file_path, '/utils') or contains(file_path, '/lib') or contains(file_path, '/shared') or contains(file_path, '/helpers')) then 'core_utility'
    when blast = 0 and defined = 0 then 'isolated' else 'module' end as role from summed"""))
def role_classify(spark, d):
    return explore.file_summaries(graph(spark, d)).select("file_path", "role")


@query(sql(_FILES + " select file_path, blast as blast_radius, defined, most as max_complexity, blast > 10 or most > 8 as is_hot_node, blast + most as heat_score from summed"))
def file_heat(spark, d):
    return explore.file_summaries(graph(spark, d)).select("file_path", "blast_radius", "defined", F.col("max_complexity").cast("int").alias("max_complexity"), "is_hot_node", "heat_score")


@query(sql(_FILES + " select file_path, case when blast > 10 or round_even(mean, 1) > 8 then 'high' when blast > 3 or round_even(mean, 1) > 4 then 'medium' else 'low' end as risk_level from summed"))
def risk_level(spark, d):
    return explore.file_summaries(graph(spark, d)).select("file_path", "risk_level")


@query(sql(_FILES + """, api as (select e.target_id as id, count(*) as c from edges e join nodes n on n.id = e.source_id where e.type = 'IMPORTS' and contains(n.file_path, '/api') group by 1),
    tested as (select distinct target_id as id from edges where type = 'TESTS' and source_id in (select id from nodes))
    select file_path, id, case when blast > 5 then 'core_utility' when blast = 0 and defined = 0 then 'isolated' else 'module' end as role, blast as blast_radius, coalesce(api.c, 0) as api_layer_callers, defined, round_even(mean, 1) as avg_complexity, cast(most as int) as max_complexity,
      tested.id is not null as has_tests, blast > 10 or most > 8 as is_hot_node, blast + most as heat_score, case when blast > 10 or round_even(mean, 1) > 8 then 'high' when blast > 3 or round_even(mean, 1) > 4 then 'medium' else 'low' end as risk_level
    from summed left join api using (id) left join tested using (id) where file_path = 'src/lib/s3.py'"""))
def context_summary(spark, d):
    return explore.context(graph(spark, d), "src/lib/s3.py")["summary"]


@query(sql("""select row_number() over (order by n.file_path) as position, n.file_path from edges e join nodes n on n.id = e.source_id
    where e.type = 'TESTS' and e.target_id = (select id from nodes where file_path = 'src/lib/s6.py' order by seq limit 1) group by n.file_path"""))
def context_tests(spark, d):
    return explore.context(graph(spark, d), "src/lib/s6.py")["tests"].select(F.col("position").cast("bigint").alias("position"), "file_path")


@query(sql("select n.id, coalesce(c, 0) as caller_count, coalesce(c, 0) > 5 as conflict from nodes n left join (select target_id as id, count(*) as c from edges where type = 'CALLS' group by 1) using (id)"))
def conflict_callers(spark, d):
    return explore.conflicts(graph(spark, d)).select("id", "caller_count", "conflict")


@query(sql("select id as node_id from nodes where file_path = 'models/o11.py'"))
def plan_affected(spark, d):
    return explore.plan(graph(spark, d), "change", "models/o11.py")["affected"]


@query(sql(""", listed as (select * from (values (1, 'src/shared/p1.py'), (2, 'src/shared/p2.py'), (3, 'src/shared/p3.py')) t(step, file)),
    out as (select l.file, count(*) as n from listed l join nodes n on n.file_path = l.file join edges e on e.source_id = n.id group by 1),
    dep as (select file, count(*) as n from (select distinct a.file_path as f, e.target_id, b.file_path as file from edges e join nodes a on a.id = e.source_id join nodes b on b.id = e.target_id join listed x on x.file = a.file_path join listed y on y.file = b.file_path where e.type = 'CALLS' and a.file_path <> b.file_path) group by 1)
    select step, file, coalesce(dep.n, 0) as dependants_in_plan, coalesce(out.n, 0) as dependencies_in_plan from listed left join dep using (file) left join out using (file)"""))
def plan_multi_file(spark, d):
    return explore.plan_files(graph(spark, d), ["src/shared/p1.py", "src/shared/p2.py", "src/shared/p3.py"]).select("step", "file", "dependants_in_plan", "dependencies_in_plan")


_PLANNED = [f"src/lib/s{k}.py" for k in range(1, 6)] + ["src/shared/p1.py", "src/shared/p6.py"]


def _layers(files: list[str]) -> str:
    listed = ", ".join(f"('{f}')" for f in files)
    out = f""", listed as (select * from (values {listed}) t(file)), needs as (select distinct a.file_path as f, b.file_path as t from edges e join nodes a on a.id = e.source_id join nodes b on b.id = e.target_id
        where e.type in ('CALLS', 'IMPORTS', 'DEPENDS_ON') and a.file_path <> b.file_path and a.file_path in (select file from listed) and b.file_path in (select file from listed)), left0 as (select file from listed)"""
    for k in range(len(files)):
        out += f", layer{k} as (select file, {k} as layer from left{k} where file not in (select f from needs where t in (select file from left{k}))), left{k + 1} as (select file from left{k} where file not in (select file from layer{k}))"
    return out + "".join(f" select * from layer{k} union all" for k in range(len(files))) + f" select file, -1 from left{len(files)}"


@query(sql(_layers(_PLANNED)))
def dependency_layers(spark, d):
    return explore.dependency_order(graph(spark, d), _PLANNED)


# comparing graphs
@query(sql("select id, case seq % 11 when 2 then 'removed' when 3 then 'changed' else 'added' end as change from nodes where seq % 11 in (2, 3, 4)"))
def snapshot_diff(spark, d):
    nodes = graph(spark, d).nodes
    renamed = nodes.withColumn("structural", F.when(F.col("seq") % 11 == 3, F.col("structural").withField("name", F.lit("other"))).otherwise(F.col("structural")))
    return sets.diff(sets.baseline(nodes.filter("seq % 11 != 4")), sets.baseline(renamed.filter("seq % 11 != 2")))


@query(sql("select id, case when type = 'Repository' then 'missing_locally' when type = 'Package' then 'missing_remotely' else 'in_sync' end as state from nodes where type <> 'Function'"))
def sync_delta(spark, d):
    nodes = graph(spark, d).nodes.filter("type <> 'Function'")
    return sets.sync(sets.signatures(nodes.filter("type <> 'Repository'")), sets.signatures(nodes.filter("type <> 'Package'")))


@query(sql("select id, sha256(concat_ws(chr(31), id, type, file_path, name, signature, '0', '0')) as signature from nodes"))
def node_signature(spark, d):
    return sets.signatures(graph(spark, d).nodes)


@query(sql("select id, case seq % 7 when 0 then 'changed' when 1 then 'unsigned' else 'ok' end as state from nodes"))
def integrity_check(spark, d):
    """Every node against its kept signature, after the name of one in seven was changed and the signature of one in seven lost."""
    nodes, seq = sets.baseline(graph(spark, d).nodes), F.col("seq")
    changed = F.col("structural").withField("name", F.when(seq % 7 == 0, F.lit("tampered")).otherwise(F.col("structural.name")))
    lost = F.col("semantic").withField("source_hash", F.when(seq % 7 == 1, F.lit("")).otherwise(F.col("semantic.source_hash")))
    ok = sets.check(nodes.withColumn("structural", changed).withColumn("semantic", lost))
    return ok.select("id", F.when(F.col("ok").isNull(), "unsigned").when(F.col("ok"), "ok").otherwise("changed").alias("state"))


@query(sql("select 'orphan' as problem, source_id, target_id, type from edges where source_id in (select id from nodes where type = 'Repository') union all select 'dangling', source_id, target_id, type from edges where target_id in (select id from nodes where type = 'Repository')"))
def integrity_dangling(spark, d):
    g = graph(spark, d)
    g.nodes = g.nodes.filter("type <> 'Repository'")
    return sets.integrity(g)


def _merkle_sum(text: str, at: int) -> str:
    return f"cast(sum(cast(cast(('0x' || substr(sha256({text}), {at}, 15)) as bigint) as decimal(38, 0))) as varchar)"


_SIGNED = "sha256(concat_ws(chr(31), id, type, file_path, name, signature, '0', '0'))"
_LINE = f"id || '=' || {_SIGNED}"


@query(sql(f"select file_path as path, sha256(concat_ws(':', cast(count(*) as varchar), {_merkle_sum(_LINE, 1)}, {_merkle_sum(_LINE, 16)})) as hash, count(*) as nodes from nodes group by 1"))
def merkle_files(spark, d):
    return sets.file_hashes(graph(spark, d).nodes)


def _merkle(deepest: int) -> str:
    """Files, then the directories of each depth from the deepest up: a directory's hash is over what lies one below it, files and directories alike."""
    combined = lambda text: f"sha256(concat_ws(':', cast(count(*) as varchar), {_merkle_sum(text, 1)}, {_merkle_sum(text, 16)}))"
    out = f", t{deepest} as (select file_path as path, case when file_path = '' then 0 else len(string_split(file_path, '/')) end as depth, {combined(_LINE)} as hash, count(*) as nodes from nodes group by 1)"
    above = "path || '=' || hash"
    for k in range(deepest, 0, -1):
        out += f", t{k - 1} as (select * from t{k} union all select regexp_replace(path, '/?[^/]*$', ''), {k - 1}, {combined(above)}, cast(sum(nodes) as bigint) from t{k} where depth = {k} group by 1)"
    return out + " select path, depth, hash, nodes from t0"


@query(sql(_merkle(3)))
def merkle_tree(spark, d):
    return sets.merkle(graph(spark, d).nodes)


# communities
_SMALL = ["CONTAINS"]


@query(sql(", pairs as (select source_id as a, target_id as b from edges where type = 'CONTAINS' union all select target_id, source_id from edges where type = 'CONTAINS'), reach as (select id, id as c from nodes where type in ('Repository') union select p.b, r.c from reach r join pairs p on p.a = r.id) select n.id, coalesce(min(r.c), n.id) as community0 from nodes n left join reach r using (id) where n.type <> 'Function' and n.type <> 'Class' group by n.id", True).replace("community0", "region"))
def components_regions(spark, d):
    g = graph(spark, d)
    members = community.components(g, _SMALL)
    top = members.filter(F.col("id").startswith("region::")).select("community", F.col("id").alias("region"))
    return g.nodes.filter("type NOT IN ('Function', 'Class')").select("id").join(members, "id").join(top, "community", "left").select("id", F.coalesce("region", "id").alias("region"))


_REGION = "top as (select 'region::' || n_regionkey as r, 'nation::' || n_nationkey as id from nation union all select 'region::' || r_regionkey, 'region::' || r_regionkey from region union all select 'region::' || n_regionkey, 'customer::' || c_custkey from customer join nation on n_nationkey = c_nationkey union all select 'region::' || n_regionkey, 'supplier::' || s_suppkey from supplier join nation on n_nationkey = s_nationkey)"


@query(sql(f", {_REGION} select size, count(*) as communities from (select coalesce(r, n.id) as r, count(*) as size from nodes n left join top using (id) group by 1) group by 1"))
def community_sizes(spark, d):
    return community.sizes(community.components(graph(spark, d), _SMALL)).groupBy("size").agg(F.count("*").alias("communities"))


@query(sql(f", {_REGION} select e.source_id, e.target_id, e.type from edges e left join top a on a.id = e.source_id left join top b on b.id = e.target_id where coalesce(a.r, e.source_id) <> coalesce(b.r, e.target_id) and e.type = 'TESTS'"))
def community_bridges(spark, d):
    g = graph(spark, d)
    return community.bridges(g, community.components(g, _SMALL)).filter("type = 'TESTS'").select("source_id", "target_id", "type")


@query(sql(f", {_REGION} select count(*) as pairs, sum(c) as crossing from (select coalesce(a.r, e.source_id) as x, coalesce(b.r, e.target_id) as y, count(*) as c from edges e left join top a on a.id = e.source_id left join top b on b.id = e.target_id where coalesce(a.r, e.source_id) <> coalesce(b.r, e.target_id) group by 1, 2)").replace("sum(c)", "cast(sum(c) as bigint)"))
def community_boundaries(spark, d):
    g = graph(spark, d)
    return community.boundaries(g, community.components(g, _SMALL)).agg(F.count("*").alias("pairs"), F.sum("edge_count").alias("crossing"))


def _labels(rounds: int) -> str:
    out = """, near as (select here, there, count(*) as w from (select source_id as here, target_id as there from edges where type in ('CONTAINS', 'DEFINES') union all select target_id, source_id from edges where type in ('CONTAINS', 'DEFINES')) where here <> there group by 1, 2),
        p0 as (select id, id as community from nodes)"""
    for k in range(rounds):
        out += f""", v{k} as (select here, community, sum(w) as w from near join p{k} on id = there group by 1, 2), b{k} as (select here as id, min((-w, community)) as b from v{k} group by 1),
            p{k + 1} as (select id, coalesce(b[2], community) as community from p{k} left join b{k} using (id))"""
    return out


@query(sql(_labels(3) + " select id, community from p3"))
def label_propagation(spark, d):
    return community.label_propagation(graph(spark, d), 3, ["CONTAINS", "DEFINES"])


def _ranks(rounds: int) -> str:
    out = """, n as (select count(*)::double as n from nodes), known as (select source_id, target_id from edges where type in ('CALLS', 'IMPORTS') and source_id in (select id from nodes) and target_id in (select id from nodes)),
        k as (select source_id, target_id, count(*) over (partition by source_id) as o from known), r0 as (select id, 1 / (select n from n) as rank from nodes)"""
    for i in range(rounds):
        out += f""", g{i} as (select k.target_id as id, sum(r.rank / k.o) as got from k join r{i} r on r.id = k.source_id group by 1),
            i{i} as (select sum(rank) as idle from r{i} where id not in (select source_id from k)),
            r{i + 1} as (select r.id, 0.15 / (select n from n) + 0.85 * coalesce((select idle from i{i}), 0) / (select n from n) + 0.85 * coalesce(got, 0) as rank from r{i} r left join g{i} using (id))"""
    return out


@query(sql(_ranks(5) + " select id, round(rank, 11) as rank from r5"))
def pagerank(spark, d):
    return ranking.pagerank(graph(spark, d), ["CALLS", "IMPORTS"], 5).select("id", F.round("rank", 11).alias("rank"))


@query(sql("select count(*) as n, 1.0 as total from nodes"))
def pagerank_sums_to_one(spark, d):
    return ranking.pagerank(graph(spark, d), ["CONTAINS"], 3).agg(F.count("*").alias("n"), F.round(F.sum("rank"), 6).alias("total"))


@query(sql("select source_id as id, count(distinct target_id) as shared from edges where type = 'IMPORTS' and source_id <> 'supplier::1' and target_id in (select target_id from edges where type = 'IMPORTS' and source_id = 'supplier::1') group by 1 order by shared desc, id limit 10"))
def shared_imports(spark, d):
    return ranking.shared_imports(graph(spark, d), "supplier::1")


# annotations
@query(sql("select id, case when type = 'Package' then ['a', 'b'] else [] end as tags from nodes where type in ('Package', 'Repository')").replace("[] end", "[]::varchar[] end"))
def tag_add(spark, d):
    out = enrich.tag(graph(spark, d).nodes, ["a", "b", "a"], "add", F.col("type") == "Package")
    return out.filter("type IN ('Package', 'Repository')").select("id", "semantic.tags")


@query(sql("select id, ['b', 'b'] as tags from nodes where type = 'Repository'"))
def tag_remove(spark, d):
    nodes = graph(spark, d).find_nodes("Repository").withColumn("semantic", F.col("semantic").withField("tags", F.array(F.lit("a"), F.lit("b"), F.lit("a"), F.lit("b"))))
    return enrich.tag(nodes, ["a"], "remove").select("id", "semantic.tags")


@query(sql("select id, ['x'] as tags from nodes where type = 'Repository'"))
def tag_set(spark, d):
    return enrich.tag(graph(spark, d).find_nodes("Repository"), ["x", "x"], "set").select("id", "semantic.tags")


@query(sql("select case when type in ('Package', 'File') then 'enriched' else 'no_metadata' end as status, count(*) as n from nodes group by 1"))
def enrich_status_counts(spark, d):
    nodes = graph(spark, d).nodes
    return enrich.status_counts(enrich.enrich(nodes, "2024-01-01T00:00:00Z", nodes.filter("type IN ('Package', 'File')")))


@query(sql("select type, count(*) as nodes, sum(case when docstring <> '' then 1 else 0 end)::bigint as documented from nodes group by 1"))
def enrich_coverage(spark, d):
    return enrich.coverage(graph(spark, d).nodes).select("type", "nodes", "documented")


@query(sql("select id, 'second' as description, ['t1', 't2'] as tags, true as manually_set from nodes where id = 'nation::4'"))
def annotate_bulk(spark, d):
    notes = spark.createDataFrame([("nation::4", "first", ["t1"], 1), ("nation::4", "second", ["t2", "t1"], 2), ("nation::4", "", [], 3)], "id string, description string, tags array<string>, seq int")
    out = enrich.annotate(graph(spark, d).nodes, notes)
    return out.filter("id = 'nation::4'").select("id", "semantic.description", "semantic.tags", "semantic.manually_set")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
