"""A graph derived from the driver's relational tables, by SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphlens.session import exists, scratch, table
from graphlens.store import Graph

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

NODES = """
select 'region::' || r_regionkey as id, 'Repository' as type, 'repo' as file_path, r_name as name, '' as signature, '' as docstring, 1 as complexity, cast(r_regionkey as bigint) as seq from {region}
union all select 'nation::' || n_nationkey, 'Package', 'repo/' || lower(n_name), n_name, '', '', 1, cast(100 + n_nationkey as bigint) from {nation}
union all select 'customer::' || c_custkey, 'File', case c_custkey % 6 when 0 then 'src/tests/c' when 1 then 'src/routes/c' when 2 then 'src/services/c' when 3 then 'src/utils/c' when 4 then 'src/api/c' else 'src/core/c' end || c_custkey || '.py', c_name, '', c_mktsegment, 1, cast(1000 + c_custkey as bigint) from {customer}
union all select 'supplier::' || s_suppkey, case when s_suppkey % 50 = 0 then 'Config' else 'File' end, 'src/lib/s' || s_suppkey || '.py', s_name, '', '', 1, cast(10000000000 + s_suppkey as bigint) from {supplier}
union all select 'orders::' || o_orderkey, 'Class', 'models/o' || (o_orderkey % 97) || '.py', o_orderpriority, '', o_orderstatus, 1, cast(20000000000 + o_orderkey as bigint) from {orders}
union all select 'part::' || p_partkey, 'Function', 'src/shared/p' || (p_partkey % 53) || '.py', p_name, 'def ' || p_name, p_type, p_size, cast(100000000000 + p_partkey as bigint) from {part}
"""

EDGES = """
select 'region::' || n_regionkey as source_id, 'nation::' || n_nationkey as target_id, 'CONTAINS' as type, cast(n_nationkey as bigint) as seq from {nation}
union all select 'nation::' || c_nationkey, 'customer::' || c_custkey, 'CONTAINS', cast(1000 + c_custkey as bigint) from {customer}
union all select 'nation::' || s_nationkey, 'supplier::' || s_suppkey, 'CONTAINS', cast(10000000000 + s_suppkey as bigint) from {supplier}
union all select 'customer::' || o_custkey, 'orders::' || o_orderkey, 'DEFINES', cast(20000000000 + o_orderkey as bigint) from {orders}
union all select 'customer::' || c_custkey, 'supplier::' || s_suppkey, 'TESTS', cast(30000000000 + c_custkey as bigint) from {customer} join {supplier} on s_suppkey = c_custkey where c_custkey % 6 = 0
union all select 'supplier::' || s_suppkey, 'part::' || p_partkey, 'DEFINES', cast(40000000000 + p_partkey as bigint) from {supplier} join {part} on p_partkey = s_suppkey * 3
union all select 'orders::' || l_orderkey, 'part::' || l_partkey, 'USES', cast(50000000000 + l_orderkey * 10 + l_linenumber as bigint) from {lineitem}
union all select distinct 'supplier::' || l_suppkey, 'part::' || l_partkey, 'IMPORTS', cast(60000000000 + l_suppkey * 1000000 + l_partkey as bigint) from {lineitem}
union all select distinct 'part::' || a.l_partkey, 'part::' || b.l_partkey, 'CALLS', cast(1000000000000 + a.l_partkey * 10000000 + b.l_partkey as bigint) from {lineitem} a join {lineitem} b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1
"""


def flat(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    tables = {t: table(spark, d, t) for t in TABLES}
    return spark.sql(NODES, **tables), spark.sql(EDGES, **tables)


_SAVED: dict[tuple[str, str], str] = {}


def graph(spark: SparkSession, d: str) -> Graph:
    """The graph of a folder's tables, saved once per application as a store and opened from then on."""
    key = (spark.sparkContext.applicationId, d)
    path = _SAVED.get(key)
    if path is None or not exists(spark, f"{path}/edges_by_target/_SUCCESS"):
        path = _SAVED[key] = scratch(spark, "graph")
        Graph.from_flat(*flat(spark, d)).save(path)
    return Graph.load(spark, path)


def sql(rest: str, recursive: bool = False) -> str:
    """A DuckDB query over the CTEs ``nodes`` and ``edges``."""
    names = {t: t for t in TABLES}
    return f"with {'recursive ' if recursive else ''}nodes as ({NODES.format(**names)}), edges as ({EDGES.format(**names)}){rest if rest.lstrip().startswith(",") else " " + rest}"
