"""Deterministic samples, quotas and leakage-free splits; nothing is random.

The order of a sample is that of SHA-256 over the key's parts joined by a NUL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.session import with_checkpoints


def selection_key(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("\0", *(p if isinstance(p, Column) else F.lit(p) for p in parts)), 256)


def first_n(df: DataFrame, key: Column, n: int) -> DataFrame:
    return df.withColumn("selection_key", key).orderBy("selection_key").limit(n)


def stratified(df: DataFrame, stratum: str, key: Column, quota: int) -> DataFrame:
    """The first ``quota`` rows of each stratum in the order of the key."""
    w = Window.partitionBy(stratum).orderBy("selection_key")
    return df.withColumn("selection_key", key).withColumn("place", F.row_number().over(w)).where(F.col("place") <= quota)


def quotas(counts: DataFrame, name: str, total: int) -> DataFrame:
    """A total divided over (name, n) in proportion, the largest remainders rounded up; equal ones in order of name.

    ``counts`` has a row a stratum and is small: the windows below are over strata, not rows.
    """
    w, by = Window.partitionBy(), Window.orderBy(F.desc("rest"), name)
    exact = counts.select(name, (F.lit(total) * F.col("n") / F.sum("n").over(w)).alias("exact"))
    floored = exact.select(name, F.floor("exact").alias("quota"), F.round(F.col("exact") - F.floor("exact"), 9).alias("rest"))
    spare = F.lit(total) - F.sum("quota").over(w)
    return floored.select(name, (F.col("quota") + (F.row_number().over(by) <= spare).cast("int")).cast("long").alias("quota"))


def strided(df: DataFrame, order: str, step: int) -> DataFrame:
    """Every step-th row in order, the first one included."""
    return ranked(df, order).where((F.col("rank") - 1) % step == 0).drop("rank")


def hash_split(df: DataFrame, key: Column, dev_share: float) -> DataFrame:
    """split = dev or test by the first 8 hex digits of the selection key; the same for a key at any size."""
    part = F.conv(F.substring(selection_key(key), 1, 8), 16, 10).cast("bigint") / float(1 << 32)
    return df.withColumn("split", F.when(part < dev_share, "dev").otherwise("test"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of undirected (a, b) edges: the least node reached.

    Large and small stars in turn: every node's greater neighbours, then its
    lesser ones, are linked to the least of its neighbours, until each component
    is a star around its least node. Rounds grow with the logarithm of a
    component's size (15 for a chain of 30,000); RuntimeError if ``rounds`` do not
    suffice. The lineage is cut by a checkpoint every round. Null ends make no edge.
    """
    with_checkpoints(edges.sparkSession)
    good = edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct().checkpoint()
    down = good.where("high != low")
    for done in range(rounds + 1):
        ends = down.select(F.col("high").alias("node"), F.lit(1).alias("ups"), F.lit(0).alias("under")).unionByName(down.select(F.col("low").alias("node"), F.lit(0).alias("ups"), F.lit(1).alias("under")))
        if ends.groupBy("node").agg((F.sum("ups") + F.max("under")).alias("n")).where("n > 1").isEmpty():
            break
        if done == rounds:
            raise RuntimeError(f"components are not found after {rounds} rounds")
        both = down.select(F.col("high").alias("a"), F.col("low").alias("b")).unionByName(down.select(F.col("low").alias("a"), F.col("high").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("low"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("high"), "low").distinct()
        least = large.groupBy("high").agg(F.min("low").alias("least"))
        small = large.join(least, "high").where("low != least").select(F.col("low").alias("high"), F.col("least").alias("low"))
        down = small.unionByName(least.select("high", F.col("least").alias("low"))).distinct().checkpoint()
    nodes = good.select(F.col("high").alias("node")).union(good.select("low")).distinct()
    return nodes.join(down.select(F.col("high").alias("node"), "low"), "node", "left").select("node", F.coalesce("low", "node").alias("component"))


def leakage(df: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Groups that stand in more than one split; empty for a good split."""
    return df.groupBy(group).agg(F.countDistinct(split).alias("splits")).where("splits > 1")


def ranked(df: DataFrame, *order: str) -> DataFrame:
    """Rows with ``rank`` 1..n in order (nulls first). Rows are sorted by range into blocks; no task sees all rows."""
    with_checkpoints(df.sparkSession)
    blocks = df.repartitionByRange(*order).withColumn("__block", F.spark_partition_id()).checkpoint()  # counts and places must see the same blocks
    counts = blocks.groupBy("__block").agg(F.count("*").alias("n"))
    # A row a block: a few thousand at most.
    before = counts.select("__block", (F.sum("n").over(Window.orderBy("__block")) - F.col("n")).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__block").orderBy(*order))
    return blocks.withColumn("__place", place).join(F.broadcast(before), "__block").withColumn("rank", F.col("__place") + F.col("__before")).drop("__block", "__place", "__before")


def evenly(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """n rows evenly spaced in order, the first and the last among them; all rows where there are no more."""
    if n < 2:
        raise ValueError("two rows at least: the first and the last")
    total = df.count()
    if total <= n:
        return df
    places = df.sparkSession.range(n).select((F.bround(F.col("id") * F.lit((total - 1) / (n - 1))) + 1).cast("bigint").alias("rank")).distinct()
    return ranked(df, *order).join(F.broadcast(places), "rank", "left_semi").drop("rank")  # n rows


def pilot(df: DataFrame, stratum: str, key: str, size: str) -> DataFrame:
    """The first row (by key) of each stratum, the smallest and the largest row, and the first without a size; each once."""
    firsts = df.groupBy(stratum).agg(F.min(key).alias(key)).select(key)
    some = df.where(F.coalesce(size, F.lit(0)) > 0).agg(F.min(F.struct(size, key)).alias("a"), F.max(F.struct(size, key)).alias("z"))
    ends = some.select(F.explode(F.array(f"a.{key}", f"z.{key}")).alias(key))
    none = df.where(F.coalesce(size, F.lit(0)) == 0).agg(F.min(key).alias(key))
    return firsts.union(ends).union(none).where(F.col(key).isNotNull()).distinct()


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows in the order of a hash of key and seed: the same rows each time."""
    return df.withColumn("__h", F.xxhash64(key, F.lit(seed))).orderBy("__h", key).limit(n).drop("__h")


def filled_quotas(df: DataFrame, stratum: str, key: str, quota: DataFrame, total: int, purpose: str) -> DataFrame:
    """Rows by quota (stratum, quota) of each stratum, in the order of a selection key, then of any stratum until there are ``total``.

    ``backfilled`` marks the latter.
    """
    own = selection_key(purpose, F.col(stratum).cast("string"), F.col(key).cast("string"))
    w = Window.partitionBy(stratum).orderBy("__k", key)
    keyed = df.withColumn("__k", own)
    largest = quota.agg(F.coalesce(F.max(quota.columns[1]), F.lit(0))).first()[0]
    # Each task keeps no more of a stratum than the largest quota before rows are brought together.
    placed = keyed.withColumn("__place", F.row_number().over(w)).where(F.col("__place") <= int(largest))
    placed = placed.join(F.broadcast(quota.select(F.col(quota.columns[0]).alias(stratum), F.col(quota.columns[1]).alias("quota"))), stratum)  # a row a stratum
    taken = placed.where(F.col("__place") <= F.col("quota")).drop("__place", "quota")
    have = taken.count()
    rest = keyed.join(taken.select(key), key, "left_anti").withColumn("__k", selection_key(f"{purpose} backfill", F.col(key).cast("string")))
    more = rest.orderBy("__k", key).limit(max(0, total - have))
    return taken.withColumn("backfilled", F.lit(False)).unionByName(more.withColumn("backfilled", F.lit(True))).drop("__k")


def balanced_split(components: DataFrame, dev_share: float, purpose: str = "split") -> DataFrame:
    """(component, weight, split) of components (component, weight): one after the other, in the order of a selection key, to the side that is further behind its share.

    A component is a row, so a task that walks through them in order holds two
    numbers; what follows depends on what went before, so it is one task.
    """
    import pyarrow as pa

    total = components.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    dev = round(dev_share * total)
    wanted = (dev, total - dev)

    def walk(batches):
        have = [0, 0]
        for b in batches:
            sides = []
            for weight in b.column(1).to_pylist():
                share = [h / w if w > 0 else 1.0 for h, w in zip(have, wanted, strict=True)]
                side = 0 if share[0] <= share[1] else 1
                have[side] += weight
                sides.append(("dev", "test")[side])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sides, pa.string())], names=["component", "weight", "split"])

    keyed = components.select(F.col("component").cast("string").alias("component"), F.col("weight").cast("bigint").alias("weight"), selection_key(purpose, F.col("component").cast("string")).alias("k"))
    return keyed.repartition(1).sortWithinPartitions("k", "component").select("component", "weight").mapInArrow(walk, "component string, weight bigint, split string")


def completeness(all_ids: DataFrame, dev: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """How many ids are in both splits, in none, and in a split but not among all; all 0 for a complete split."""
    tagged = all_ids.select(key, F.lit(1).alias("a"), F.lit(0).alias("d"), F.lit(0).alias("t")).union(dev.select(key, F.lit(0), F.lit(1), F.lit(0))).union(test.select(key, F.lit(0), F.lit(0), F.lit(1)))
    each = tagged.groupBy(key).agg(F.max("a").alias("a"), F.max("d").alias("d"), F.max("t").alias("t"))
    return each.agg(F.count_if(F.expr("d = 1 and t = 1")).alias("both"), F.count_if(F.expr("a = 1 and d = 0 and t = 0")).alias("missing"), F.count_if(F.expr("a = 0")).alias("extra"))
