"""Graphs as tables of edges: connected components, and labels spread along edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.ordinals import numbered
from siltstone.operators.staging import drop, packed, staged

#: Labels whose shares stand beside each other in a row.
WIDE = 8


def components(edges: DataFrame) -> DataFrame:
    """node, component for every node of ``edges(a, b)`` (longs): the smallest node it reaches.

    In each round every node takes the least label among its own and its neighbours', and then the label
    that its label's node has, so paths shorten by half at least. All steps are aggregates that combine
    on the map side and joins by node; a node of very many edges is never gathered.
    """
    e = edges.where("a <> b").select("a", "b")
    both = staged(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    now = staged(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("component")))
    while True:
        near = both.join(now.select(F.col("node").alias("b"), "component"), "b").select(F.col("a").alias("node"), "component")
        # what a node learns, the node that it is labelled with learns, too
        root = now.join(near.withColumnRenamed("component", "heard"), "node").select(F.col("component").alias("node"), F.col("heard").alias("component"))
        heard = now.unionByName(near).unionByName(root).groupBy("node").agg(F.min("component").alias("component"))
        jump = heard.select(F.col("node").alias("component"), F.col("component").alias("next"))
        found = heard.join(jump, "component").select("node", F.col("next").alias("component"))
        new = staged(found.join(now.select("node", F.col("component").alias("was")), "node"))
        now = new.select("node", "component")
        if new.where("component <> was").isEmpty():
            return now


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = 20, keep: float = 0.5, unit: int = 1 << 40) -> DataFrame:
    """node, label, share: labels spread from ``seeds(node, label)`` over ``edges(a, b, weight)``, weights positive and edges in
    both directions.

    In each round a node's shares become the mean of its neighbours' shares by weight, mixed with its own
    seed: ``keep`` of the seed and the rest of the mean for a seed, the mean alone otherwise. Shares are whole
    multiples of 1/``unit``, rounded down, so sums do not depend on the order of rows. It ends when nothing
    changes, or after ``rounds``; each round is staged.
    """
    total = edges.groupBy("a").agg(F.sum("weight").alias("total"))
    links = staged(edges.join(total, "a").select("a", "b", "weight", "total"))
    own = staged(seeds.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.collect_set("label").alias("labels")).select("node", F.explode("labels").alias("label"), F.floor(F.lit(unit) / F.size("labels")).alias("seed")))
    is_seed = own.select("node").distinct()
    held = F.floor(F.col("seed") * keep)
    now = staged(own.select("node", "label", F.col("seed").alias("share")))
    for _ in range(rounds):
        sent = links.join(now.withColumnRenamed("node", "b"), "b").groupBy("a", "label", "total").agg(F.sum(F.col("weight").cast("decimal(38,0)") * F.col("share")).alias("sum"))
        mean = sent.select(F.col("a").alias("node"), "label", F.expr("sum div total").cast("long").alias("share"))
        mixed = mean.join(is_seed.withColumn("fixed", F.lit(True)), "node", "left").select("node", "label", F.when(F.col("fixed"), F.floor(F.col("share") * (1 - keep))).otherwise(F.col("share")).alias("share"))
        new = mixed.unionByName(own.select("node", "label", held.alias("share"))).groupBy("node", "label").agg(F.sum("share").alias("share")).where("share > 0")
        both = staged(new.join(now.select("node", "label", F.col("share").alias("was")), ["node", "label"], "full"))
        now = both.where("share IS NOT NULL").select("node", "label", "share")
        if both.where("share IS DISTINCT FROM was").isEmpty():
            break
    return now.select("node", "label", (F.col("share") / unit).alias("share"))


def propagate_between(pairs: DataFrame, seeds: DataFrame, rounds: int = 20, keep: float = 0.5, unit: int = 1 << 40) -> DataFrame:
    """node, label, share for the nodes ``a`` of ``pairs(a, b)``: as :func:`propagate` over edges of weight 1 from each a to its
    b and back, where only nodes a have ``seeds(node, label)``.

    What the one side has after a round depends on what the other had before it, so each round computes one side
    only. Edges are kept once, a round's shares until the next but one is there. Labels are numbered, and a row holds the shares
    of ``WIDE`` of them, so an edge and its node's key are not repeated for each label.
    """
    edges, _ = packed(pairs.select("a", "b").distinct())
    sizes = {side: packed(edges.groupBy(F.col(side).alias("node")).agg(F.count(F.lit(1)).alias("total")))[0] for side in "ab"}
    labels = seeds.where("label IS NOT NULL").select("label").distinct()
    slots = [f"s{i}" for i in range(max(1, min(WIDE, labels.count())))]
    number = numbered(labels, ["label"], place="number").select(F.col("label").alias("_label"), (F.col("number") - 1).alias("number"))
    seed = seeds.groupBy("node").agg(F.collect_set("label").alias("labels")).select("node", F.explode("labels").alias("label"), F.floor(F.lit(unit) / F.size("labels")).alias("seed"))
    own, _ = packed(seed.join(number, F.col("label") == F.col("_label")).drop("_label"))

    def beside(value) -> DataFrame:
        of = [F.sum(F.when(F.col("number") % len(slots) == i, value).otherwise(F.lit(0).cast("long"))).alias(s) for i, s in enumerate(slots)]
        return own.groupBy("node", F.floor(F.col("number") / len(slots)).alias("part")).agg(*of)

    held, some = beside(F.floor(F.col("seed") * keep)), " OR ".join(f"{s} > 0" for s in slots)
    most = max(sizes[s].agg(F.max("total")).first()[0] or 0 for s in "ab")
    kind = "long" if most * unit < 1 << 62 else "decimal(38,0)"
    start = beside(F.col("seed"))
    (now, path), before = packed(start if rounds % 2 == 0 else start.limit(0)), None
    for left in range(rounds, 0, -1):
        to, of = ("a", "b") if left % 2 else ("b", "a")
        sent = edges.join(now.withColumnRenamed("node", of), of).groupBy(F.col(to).alias("node"), "part").agg(*[F.sum(F.col(s).cast(kind)).alias(s) for s in slots])
        new = sent.join(sizes[to], "node").select("node", "part", *[F.expr(f"{s} div total").cast("long").alias(s) for s in slots])
        if to == "a":
            fixed = own.select("node").distinct().withColumn("fixed", F.lit(True))
            mixed = new.join(fixed, "node", "left").select("node", "part", *[F.when(F.col("fixed"), F.floor(F.col(s) * (1 - keep))).otherwise(F.col(s)).alias(s) for s in slots])
            new = mixed.unionByName(held).groupBy("node", "part").agg(*[F.sum(s).alias(s) for s in slots])
        last, (now, path) = (now, path), packed(new.where(some))
        drop(now, last[1])
        if to == "a":
            # the same shares again would give the same again
            marks = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("node", "part", *slots)), F.sum(F.xxhash64(*slots, "part", "node").cast("decimal(38,0)"))).first()
            if marks == before:
                break
            before = marks
    tall = now.select("node", "part", F.posexplode(F.array(*slots)).alias("slot", "share")).where("share > 0")
    named = own.select("label", "number").distinct()
    return tall.join(named, F.col("part") * len(slots) + F.col("slot") == F.col("number")).select("node", "label", (F.col("share") / unit).alias("share"))
