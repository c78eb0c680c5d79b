"""Queries of the general training-data operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.operators import hierarchy, incremental, references
from graphlens.session import scratch, stage, table


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    edges, nodes, files, removals, symbols = (table(spark, d, t) for t in ("edge_candidates", "parsed_nodes", "parsed_files", "removals", "external_symbols"))
    return references.orphans(edges, nodes, files, removals, symbols)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d)


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return references.report(_orphans(spark, d), table(spark, d, "edge_candidates"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.resolve(table(spark, d, "parsed_nodes")).select("node_id", "root_id", "depth")


def _looped(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    nodes = table(spark, d, "parsed_nodes")
    resolved = stage(hierarchy.resolve(nodes, paths=True), "paths")
    return resolved, stage(hierarchy.loops(nodes, resolved), "looped")


def p5_loops(spark: SparkSession, d: str) -> DataFrame:
    """(node_id, loop_id, in_loop): the nodes of every loop, and those that hang below one."""
    return _looped(spark, d)[1].select("node_id", "loop_id", "in_loop")


def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    """(node_id, path) of every node: from its root, or from the loop node it hangs from."""
    resolved, looped = _looped(spark, d)
    return resolved.filter("depth >= 0").select("node_id", "path").unionByName(looped.select("node_id", "path")).select("node_id", F.array_join("path", " > ").alias("path"))


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    """(node_id, descendant_id, distance) of every node, also of those in and below loops."""
    resolved, looped = _looped(spark, d)
    return hierarchy.descendants(resolved).unionByName(hierarchy.loop_descendants(looped))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    runs = incremental.successful_runs(table(spark, d, "scan_runs"))
    store = incremental.StateStore(spark, scratch(spark, "scan-state"))
    return incremental.process(table(spark, d, "file_scans"), runs, store)


def queries() -> dict:
    return {f.__name__: f for f in (p4_found, p4_report, p5_found, p5_paths, p5_descendants, p5_loops, p6_found)}


_NORMAL = "list_aggregate(list_reduce(list_prepend(['']::varchar[], list_transform(list_filter(string_split(replace({0}, '\\', '/'), '/'), lambda x: x not in ('', '.')), lambda x: [x])), lambda acc, x: case when x[1] = '..' then acc[:-2] else list_concat(acc, x) end)[2:], 'string_agg', '/')"

_P4 = f"""
e as (select distinct edge_id, repo, source_id, target_name, case when target_file_hint <> '' then {_NORMAL.format("target_file_hint")} end as hint, seen_at from edge_candidates),
refs as (select edge_id, 'source_id' as ref_field, source_id as k, seen_at as t from e where source_id <> ''
  union all select edge_id, 'target_file_hint', hint, seen_at from e where hint is not null),
parses as (select 'source_id' as ref_field, node_id as k, parsed_at as t from parsed_nodes union all select 'target_file_hint', file_path, parsed_at from parsed_files),
gone as (select case object_kind when 'node' then 'source_id' else 'target_file_hint' end as ref_field, object_key as k, removed_at as t from removals),
seen as (select r.edge_id, r.ref_field, r.k, r.t, count(p.t) as n, min(p.t) as first, max(case when p.t <= r.t then p.t end) as last
  from refs r left join parses p on p.ref_field = r.ref_field and p.k = r.k group by all),
stated as (select s.edge_id, s.ref_field, case when n = 0 then 'missing' when first > s.t then 'late' when max(g.t) > last then 'deleted' else 'ok' end as state
  from seen s left join gone g on g.ref_field = s.ref_field and g.k = s.k and g.t <= s.t group by s.edge_id, s.ref_field, s.k, s.t, n, first, last),
named as (select edge_id, repo, target_name, hint, split_part(target_name, '.', -1) as last from e where target_name <> ''),
lost as (select edge_id from named n where hint is not null and hint in (select file_path from parsed_files)
    and not exists (select 1 from parsed_nodes p where p.file_path = n.hint and p.name = n.last)
  union all select edge_id from named n where hint is null and target_name not in (select symbol from external_symbols)
    and not exists (select 1 from parsed_nodes p where split_part(p.file_path, '/', 1) = n.repo and p.name = n.last)),
found as (select distinct edge_id, ref_field, state from stated where state <> 'ok' union select edge_id, 'target_name', 'missing' from lost)
"""

_P5 = """
cur as (select node_id, arg_max(coalesce(parent_id, ''), row_seq) as parent from parsed_nodes group by 1),
tied as (select c.node_id, p.node_id as parent from cur c left join cur p on p.node_id = c.parent),
tree as (select node_id, node_id as root_id, 0 as depth, node_id as path from tied where parent is null
  union all select t.node_id, r.root_id, r.depth + 1, r.path || ' > ' || t.node_id from tied t join tree r on t.parent = r.node_id)
"""


# nodes that no walk from a root reaches: in a loop are those that a walk upwards meets again
_STUCK = f"""{_P5},
    stuck as (select node_id, parent from tied where node_id not in (select node_id from tree)),
    walk as (select node_id as start, parent as here from stuck union select w.start, s.parent from walk w join stuck s on s.node_id = w.here),
    ring as (select start as node_id from walk where here = start),
    up as (select node_id as start, node_id as here from stuck union select u.start, s.parent from up u join stuck s on s.node_id = u.here where u.here not in (select node_id from ring)),
    hung as (select start as node_id, here as ring_node from up where here in (select node_id from ring)),
    named as (select start as node_id, min(here) as loop_id from walk where start in (select node_id from ring) group by 1)
"""


def oracle_sql() -> dict:
    return {
        "p4_found": f"with {_P4} select edge_id, ref_field, state from found",
        "p4_report": f"""with {_P4}, seen_in as (select edge_id, date_trunc('month', min(seen_at)) as period from edge_candidates group by 1)
            select ref_field, case ref_field when 'target_file_hint' then 'parsed_files' else 'parsed_nodes' end as target_table, state, period, count(*) as n
            from found join seen_in using (edge_id) group by 1, 2, 3, 4""",
        "p5_found": f"""with recursive {_P5},
            stuck as (select node_id, parent from tied where node_id not in (select node_id from tree)),
            walk as (select node_id as start, node_id as at from stuck union select w.start, s.parent from walk w join stuck s on s.node_id = w.at),
            looped as (select distinct w.start from walk w join stuck s on s.node_id = w.at where s.parent = w.start)
            select node_id, root_id, depth from tree
            union all select w.start, min(w.at), -1 from walk w join looped l on l.start = w.at group by 1""",
        "p5_loops": f"""with recursive {_STUCK} select h.node_id, n.loop_id, h.node_id = h.ring_node as in_loop from hung h join named n on n.node_id = h.ring_node""",
        "p5_paths": f"""with recursive {_STUCK}, below as (select node_id, node_id as path from ring union all select s.node_id, b.path || ' > ' || s.node_id from below b join stuck s on s.parent = b.node_id where s.node_id not in (select node_id from ring))
            select node_id, path from tree union all select node_id, path from below""",
        "p5_descendants": f"""with recursive {_STUCK}, above as (select node_id as descendant_id, parent as node_id, 1 as distance from tied where parent is not null
            union select u.descendant_id, t.parent, u.distance + 1 from above u join tied t using (node_id) where t.parent is not null and u.node_id <> u.descendant_id
              and (u.node_id not in (select node_id from stuck) or u.distance <= (select count(*) from (select 1 from up where start = u.descendant_id union all select 1 from ring))))
            select node_id, descendant_id, min(distance) as distance from above where node_id <> descendant_id group by 1, 2""",
        "p6_found": """with runs as (select run_id, cutoff, row_number() over (order by cutoff, run_id) as n from
              (select run_id, arg_max(status, logged_at) as status, arg_max(cutoff_at, logged_at) as cutoff from scan_runs group by 1) where status = 'ok'),
            useful as (select file_path, scan_id, observed_at, arrived_at, content_hash, coalesce(event_type = 'deleted', false) as gone from file_scans
              where content_hash is not null or event_type = 'deleted'),
            at_run as (select r.n, r.run_id, u.file_path, arg_max({'h': content_hash, 'g': gone}, {'o': observed_at, 's': scan_id}) as s
              from runs r join useful u on u.arrived_at <= r.cutoff group by 1, 2, 3),
            pair as (select a.run_id, a.file_path, a.s, b.s as before, b.file_path as had from at_run a left join at_run b on b.file_path = a.file_path and b.n = a.n - 1)
            select run_id, file_path, s.h as content_hash from pair where not s.g and (had is null or before.g or before.h is distinct from s.h)""",
    }
