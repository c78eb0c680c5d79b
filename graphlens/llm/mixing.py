"""Mixing sources to target weights by Poisson replication.

Each document gets a uniform number from a hash of seed, mix and id, and is
repeated as often as the inverse of a Poisson distribution says there, at most
``max_repeats`` times. The mean is chosen so that the capped repetition has
the rate the target needs, then corrected to the tokens really drawn.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Factors on the mean tried in the first and in the second correcting pass.
COARSE = tuple(0.7 + 0.05 * k for k in range(15))
FINE = tuple(0.97 + 0.005 * k for k in range(13))


def cdf(mean: float, cap: int) -> tuple[int, list[float]]:
    """(offset, P(count <= k) for k = offset, offset + 1, ... below cap): a draw at u is the offset and the number of values not above u.

    What lies 40 standard deviations off is 0 or 1 in a double, so the list is
    no longer than 80 of them, whatever the mean; an infinite mean is the cap.
    """
    if cap <= 0 or mean <= 0:
        return 0, [1.0]
    if mean == math.inf:
        return cap, []
    width = 40 * math.sqrt(mean) + 40
    low = max(0, math.floor(mean - width))
    if low >= cap:
        return cap, []
    out, total = [], 0.0
    for k in range(low, min(cap, math.ceil(mean + width))):
        total += math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
        out.append(min(1.0, total))
        if total >= 1 - 1e-15 and k > mean:
            break
    return low, out


def capped_mean(mean: float, cap: int) -> float:
    """E[min(Poisson(mean), cap)] = sum over k < cap of P(count > k)."""
    if mean <= 0 or cap <= 0:
        return 0.0
    offset, steps = cdf(mean, cap)
    return offset + sum(1 - p for p in steps)


def mean_for(rate: float, cap: int) -> float:
    """The Poisson mean whose capped mean is ``rate``; infinite where the cap is reached."""
    if rate <= 0 or cap <= 0:
        return 0.0
    if rate >= cap * (1 - 1e-9):
        return math.inf
    low, high = 0.0, 2.0 * cap + 200
    for _ in range(70):
        mid = (low + high) / 2
        low, high = (mid, high) if capped_mean(mid, cap) < rate else (low, mid)
        if high - low <= 1e-12 * high:
            break
    return high


def _uniform(seed: int, mix: Column, key: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), mix, key), 11) / F.lit(float(2**53))


def _drawn(draw: Column) -> Column:
    """Number of copies at ``u`` of a struct (offset, steps)."""
    return draw.getField("offset") + F.size(F.filter(draw.getField("steps"), lambda c: c <= F.col("u")))


class Plan:
    """What each (mix, source) needs, and the tables ``sample`` and ``shares`` made of it.

    ``sizes`` is (doc_id, source, tokens), one row per document, a written
    table as it is read several times. ``targets`` is a small table by nature:
    one row per mix and source, read to the driver and checked to be at most
    ``MOST`` rows. Rows with null mix, source, share or cap and shares or caps
    not above 0 are left out; of several rows of a mix and source that with
    the greatest share, then cap, counts; documents of null source belong to
    no mix.
    """

    MOST = 10_000

    def __init__(self, sizes: DataFrame, targets: DataFrame, seed: int = 42):
        self.sizes, self.seed, self.spark = sizes.filter("source IS NOT NULL AND doc_id IS NOT NULL"), seed, sizes.sparkSession
        usable = targets.select("mix", "source", "target_share", "max_repeats").dropna().filter("target_share > 0 AND max_repeats > 0")
        rows = usable.groupBy("mix", "source").agg(F.max(F.struct("target_share", "max_repeats")).alias("t")).select("mix", "source", "t.*").orderBy("mix", "source").limit(self.MOST + 1).collect()
        if len(rows) > self.MOST:
            raise ValueError(f"more than {self.MOST} targets")
        wanted = sorted({r.source for r in rows})
        held = {r.source: (r.docs, r.tokens) for r in self.sizes.filter(F.col("source").isin(wanted)).groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens")).collect()}
        size: dict[str, int] = {}
        for r in rows:
            size[r.mix] = size.get(r.mix, 0) + (held.get(r.source, (0, 0))[1] or 0)
        self.parts = []
        for r in rows:
            docs, tokens = held.get(r.source, (0, 0))
            need = r.target_share * size[r.mix]
            rate = need / tokens if tokens else 0.0
            self.parts.append({"mix": r.mix, "source": r.source, "share": r.target_share, "cap": r.max_repeats, "docs": docs, "tokens": tokens or 0, "need": need, "size": size[r.mix], "mean": mean_for(rate, r.max_repeats)})
        self._correct(COARSE)
        self._correct(FINE)

    def _correct(self, factors: tuple[float, ...]) -> None:
        """Move each finite mean to where the hash draws give the tokens needed: one pass over the sizes."""
        tried = [(n, f, cdf(p["mean"] * f, p["cap"])) for n, p in enumerate(self.parts) if 0 < p["mean"] < math.inf for f in factors]
        if not tried:
            return
        table = self.spark.createDataFrame([(self.parts[n]["mix"], self.parts[n]["source"], n, [s for k, _, s in tried if k == n]) for n in sorted({n for n, _, _ in tried})], "mix string, source string, n int, draws array<struct<offset:int,steps:array<double>>>")
        rows = self.sizes.join(F.broadcast(table), "source").withColumn("u", _uniform(self.seed, F.col("mix"), F.col("doc_id")))
        drawn = rows.groupBy("n").agg(*[F.sum(_drawn(F.col("draws")[k]) * F.col("tokens")).alias(f"d{k}") for k in range(len(factors))]).collect()
        for r in drawn:
            p = self.parts[r.n]
            points = [(f, r[f"d{k}"]) for k, f in enumerate(factors)]
            p["mean"] *= min(points, key=lambda x: (abs(x[1] - p["need"]), abs(x[0] - 1)))[0]

    def _table(self) -> DataFrame:
        rows = [(p["mix"], p["source"], cdf(p["mean"], p["cap"])) for p in self.parts]
        return F.broadcast(self.spark.createDataFrame(rows, "mix string, source string, draw struct<offset:int,steps:array<double>>"))

    def counts(self) -> DataFrame:
        """(mix, source, doc_id, tokens, n): how often each document is drawn for each mix."""
        rows = self.sizes.join(self._table(), "source").withColumn("u", _uniform(self.seed, F.col("mix"), F.col("doc_id")))
        return rows.select("mix", "source", "doc_id", "tokens", _drawn(F.col("draw")).alias("n"))

    def sample(self) -> DataFrame:
        """(mix, doc_id, copy) in random order: copy counts from 1; sorted by a hash over all partitions."""
        drawn = self.counts().filter("n > 0").select("mix", "doc_id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
        return drawn.withColumn("_at", F.xxhash64(F.lit(self.seed + 1), "mix", "doc_id", "copy")).orderBy("_at").drop("_at")

    def shares(self) -> DataFrame:
        """One row per target: what its source holds, what was drawn, the share of the mix and of its planned size.

        ``met`` is false where the source holds no tokens or the cap is too low.
        """
        drawn = self.counts().groupBy("mix", "source").agg(F.sum("n").alias("copies"), F.sum(F.col("n") * F.col("tokens")).alias("drawn_tokens"))
        plan = self.spark.createDataFrame([(p["mix"], p["source"], p["share"], p["cap"], p["docs"], p["tokens"], p["size"], bool(p["tokens"]) and p["need"] <= p["cap"] * p["tokens"]) for p in self.parts], "mix string, source string, target_share double, max_repeats int, docs long, source_tokens long, mix_tokens long, met boolean")
        out = plan.join(drawn, ["mix", "source"], "left").fillna(0, ["copies", "drawn_tokens"])
        from pyspark.sql import Window

        of_mix = F.sum("drawn_tokens").over(Window.partitionBy("mix"))
        return out.withColumn("actual_share", F.when(of_mix > 0, F.col("drawn_tokens") / of_mix).otherwise(0.0)).withColumn("share_of_size", F.when(F.col("mix_tokens") > 0, F.col("drawn_tokens") / F.col("mix_tokens")).otherwise(0.0))
