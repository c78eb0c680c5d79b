"""python tools/scale.py [NODES]: build a graph of that many nodes, chain and three random calls each, and time the usual questions."""

import json
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import functions as F  # noqa: E402

from graphlens.operators import telemetry, traverse  # noqa: E402
from graphlens.store import Graph  # noqa: E402
from tests.helpers import session  # noqa: E402


def main(n: int) -> None:
    spark, took = session(), {}

    def timed(name, f):
        began = time.time()
        out = f()
        took[name] = round(time.time() - began, 3)
        return out

    ids = spark.range(n)
    name = lambda c: F.concat(F.lit("f"), c.cast("string"))
    nodes = ids.select(name(F.col("id")).alias("id"), name(F.col("id")).alias("name"), F.concat(F.lit("bench/"), (F.col("id") % 100).cast("string"), F.lit(".py")).alias("file_path"), F.col("id").alias("seq"))
    ends = F.array((F.col("id") + 1) % n, *[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(n)) for k in range(3)])
    edges = ids.select(name(F.col("id")).alias("source_id"), F.posexplode(ends).alias("k", "t"), F.col("id")).filter("t <> id").select("source_id", name(F.col("t")).alias("target_id"), F.lit("CALLS").alias("type"), (F.col("id") * 4 + F.col("k")).alias("seq"))
    path = tempfile.mkdtemp(prefix="graphlens-scale-")
    timed("write", lambda: Graph.from_flat(nodes, edges).save(path, "overwrite"))
    g = Graph.load(spark, path)
    timed("count", lambda: telemetry.summary(g).collect())
    timed("type_filter", lambda: g.find_nodes("Function").count())
    timed("1000_lookups", lambda: g.nodes.join(F.broadcast(spark.range(1000).select(name(F.col("id") * (n // 1000)).alias("id"))), "id").count())
    timed("walk_depth3_cap200", lambda: traverse.traverse(g, "f1", ["CALLS"], 3, 200).count())
    timed("degrees", lambda: telemetry.degrees(g).agg(F.max("degree")).collect())
    print(json.dumps({"nodes": n, "seconds": took}))


if __name__ == "__main__":
    main(int(sys.argv[1]) if len(sys.argv) > 1 else 10_000)
