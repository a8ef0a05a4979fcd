"""Problem 2: items that appear together, by basket collapsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from memloom.operators.skew import skew_join
from memloom.session import materialize, rows_of

#: Items of a basket that one task expands against each other; larger baskets are cut into blocks of about this size.
BLOCK = 256


def item_pairs(rows: DataFrame, basket: str, item: str, min_common: int = 1, min_lift: float | None = None, block: int = BLOCK) -> DataFrame:
    """(item_a, item_b, common, count_a, count_b, baskets, lift, conviction) of the pairs of items that share a basket.

    ``rows`` has one row per occurrence; rows with a null basket or item are dropped, an item counts
    once per basket, other columns are ignored, ``baskets`` is the number of baskets with an item. lift = common · N / (count_a · count_b);
    conviction of a → b = (1 - count_b/N) / (1 - common/count_a), null where a never occurs without b.
    item_a < item_b. An empty table gives an empty result. ``min_common`` and ``min_lift`` keep the
    pairs that reach both, compared exactly. Items that can be in no such pair are left out before
    pairs are made: those in fewer than ``min_common`` baskets, and those so frequent that even full overlap stays below
    ``min_lift`` (N / count < min_lift, since common never exceeds either count).

    Identical baskets are collapsed into one with a weight and expanded once. A basket of
    more than ``block`` items is cut by item hash into blocks, and each pair of blocks is a row of its own, so no
    task holds a whole large basket; equal large baskets are cut alike and still collapse.
    """
    seen = materialize(rows.select(F.col(basket).alias("basket"), F.col(item).alias("item")).where("basket is not null and item is not null").distinct(), "seen")
    total = seen.select("basket").distinct().count()
    items = seen.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_common)
    if min_lift is not None:
        items = items.where(F.col("n") * F.lit(min_lift) <= total)
    items = materialize(items.withColumn("k", F.monotonically_increasing_id()), "items")
    coded = materialize(skew_join(seen, items.select("item", "k"), ["item"]).select("basket", "k"), "coded")
    # Basket sizes combine on the map side; only baskets of more than one item have pairs.
    sizes = coded.groupBy("basket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    large = materialize(sizes.where(F.col("size") > block), "large")
    small = coded.join(sizes.where(F.col("size") <= block).select("basket"), "basket", "left_semi")
    whole = small.groupBy("basket").agg(F.array_sort(F.collect_list("k")).alias("left")).select("left", F.lit(None).cast("array<bigint>").alias("right"))
    if rows_of(large):
        cut = skew_join(coded, large.withColumn("parts", F.ceil(F.col("size") / block).cast("int")), ["basket"])
        cut = cut.withColumn("part", F.pmod(F.xxhash64("k"), F.col("parts")).cast("int"))
        blocks = materialize(cut.groupBy("basket", "part", "parts").agg(F.array_sort(F.collect_list("k")).alias("ks")), "blocks")
        own = blocks.select(F.col("ks").alias("left"), F.lit(None).cast("array<bigint>").alias("right"))
        # Every pair of blocks is a key of its own: a block goes to each pair it is in.
        others = blocks.where("parts > 1").select("basket", "part", "ks", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")).where("part <> other")
        key = [F.col("basket"), F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi")]
        former = others.where("part < other").select(*key, F.col("ks").alias("left"))
        later = others.where("part > other").select(*key, F.col("ks").alias("right"))
        whole = whole.unionByName(own).unionByName(former.join(later, ["basket", "lo", "hi"]).select("left", "right"))
    weights = whole.groupBy("left", "right").agg(F.count(F.lit(1)).alias("weight"))
    within = F.flatten(F.transform("left", lambda x, i: F.transform(F.slice("left", i + 2, F.size("left")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    across = F.flatten(F.transform("left", lambda x: F.transform("right", lambda y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")))))
    made = weights.select("weight", F.explode(F.when(F.col("right").isNull(), within).otherwise(across)).alias("p"))
    counts = made.groupBy("p.a", "p.b").agg(F.sum("weight").alias("common")).where(F.col("common") >= min_common)
    counts = materialize(counts, "pairs")
    for end in ("a", "b"):
        counts = skew_join(counts, items.select(F.col("k").alias(end), F.col("item").alias(f"item_{end}"), F.col("n").alias(f"count_{end}")), [end])
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    if min_lift is not None:
        counts = counts.where(exact("common") * F.lit(total).cast("decimal(19,0)") >= F.lit(str(min_lift)).cast("decimal(9,4)") * exact("count_a") * exact("count_b"))
    swap = F.col("item_a") > F.col("item_b")
    counts = counts.select("common", *[F.when(swap, F.col(f"{c}_{y}")).otherwise(F.col(f"{c}_{x}")).alias(f"{c}_{x}") for c in ("item", "count") for x, y in (("a", "b"), ("b", "a"))])
    n = F.lit(float(total))
    return counts.select(
        "item_a", "item_b", "common", "count_a", "count_b", F.lit(total).cast("bigint").alias("baskets"),
        (F.col("common") * n / (F.col("count_a").cast("double") * F.col("count_b"))).alias("lift"),
        F.when(F.col("common") < F.col("count_a"), (1 - F.col("count_b") / n) / (1 - F.col("common") / F.col("count_a"))).alias("conviction"),
    )


def counting_links(links: DataFrame) -> DataFrame:
    """The links that count: coact above 0, a target, and not from a node to itself."""
    return links.where("coact > 0 and target is not null and target <> source").select("source", "target")
