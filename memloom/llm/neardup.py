"""Problem 5: near-duplicate records, by size-banded tiles with hashed bitmap signatures."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from memloom.operators.skew import hot_keys, self_pairs, skew_join
from memloom.session import discard, materialize

THRESHOLD = "0.82"
WORDS = 4  # of 64 bits in a signature
#: A part of at most this many tokens is too common to name a tile by itself.
SMALL_PART = 1

TOKEN = r"[\p{L}\p{N}_]+"


def token_set(text: Column) -> Column:
    """Sorted distinct lower-cased tokens of letters, digits and underscores as 64-bit hashes; empty for null."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), 0)
    return F.sort_array(F.array_distinct(F.transform(found, lambda t: F.xxhash64(F.lower(t)))))


def band_of(size: np.ndarray, ratio: Fraction, most: int) -> tuple[np.ndarray, list[int]]:
    """The size band of each size up to ``most``, and the least size of every band and of the next: a set can be similar only to sets of its own band and the two next to it."""
    starts = [1]
    while starts[-1] <= most:
        # The least size that is too large for the least of this band.
        starts.append(starts[-1] * ratio.denominator // ratio.numerator + 1)
    return np.searchsorted(np.array(starts), size, side="right") - 1, starts


def parts_of_band(starts: list[int], band: int, ratio: Fraction) -> int:
    """One part more than the tokens by which two similar sets can differ if the smaller of them is of ``band``."""
    small = starts[band + 1] - 1
    large = small * ratio.denominator // ratio.numerator
    return (small + large) * (ratio.denominator - ratio.numerator) // (ratio.denominator + ratio.numerator) + 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _tile_rows(ratio: Fraction):
    """Of records (k, h) with their sorted token hashes: one row (tile, k, size, signature) per tile."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            ks, sizes = batch["k"].to_numpy(), batch["h"].map(len).to_numpy()
            flat = np.concatenate(batch["h"].to_numpy()).astype(np.int64).view(np.uint64)
            begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            bits = np.uint64(1) << (flat & np.uint64(63))
            word = (flat >> np.uint64(6)) & np.uint64(WORDS - 1)
            signature = [np.bitwise_or.reduceat(np.where(word == w, bits, np.uint64(0)), begin).view(np.int64) for w in range(WORDS)]
            band, starts = band_of(sizes, ratio, int(sizes.max()))
            mixed, owner = _mixed(flat), np.repeat(np.arange(len(ks)), sizes)
            tiles, who, guest = [], [], []
            for home in range(int(band.min()) - 1, int(band.max()) + 1):
                # A tile's band is that of the smaller set of a pair: sets of the next band come to it too.
                guests = np.flatnonzero((band == home) | (band == home + 1))
                if home < 0 or not len(guests):
                    continue
                parts = parts_of_band(starts, home, ratio)
                if parts < 2:
                    continue
                place = np.full(len(ks), -1)
                place[guests] = np.arange(len(guests))
                mine = place[owner] >= 0
                cell = place[owner[mine]] * parts + (mixed[mine] % np.uint64(parts)).astype(np.int64)
                # The tokens of a part are added up: equal parts have equal sums, and a part less one token is a subtraction.
                weight = _mixed(mixed[mine] + np.uint64(home + 1))
                total = np.zeros(len(guests) * parts, np.uint64)
                np.add.at(total, cell, weight)
                small = np.bincount(cell, minlength=len(total)) <= SMALL_PART
                part = np.arange(len(total)) % parts
                label = _mixed(total + _mixed((part + parts * 1_000 * (home + 1)).astype(np.uint64)))
                after = np.arange(len(total)) - part + (part + 1) % parts
                before = cell - cell % parts + (cell % parts - 1) % parts
                # A part of few tokens says little. Of the parts around a ring some are equal and followed by one that differs by a token at most, so such a part is named
                # with the next one as well: with all of it, and with each of its tokens left out.
                less = small[before]
                tiles += [label[~small], _mixed(label[small] ^ total[after[small]]), _mixed(label[before[less]] ^ (total[cell[less]] - weight[less]))]
                who += [guests[np.flatnonzero(~small) // parts], guests[np.flatnonzero(small) // parts], guests[before[less] // parts]]
                guest += [band[w] != home for w in who[-3:]]
            if not tiles:
                continue
            name, who = np.concatenate(tiles), np.concatenate(who)
            yield pd.DataFrame({"tile": name.view(np.int64), "k": ks[who], "size": sizes[who].astype(np.int32), "guest": np.concatenate(guest), **{f"s{w}": signature[w][who] for w in range(WORDS)}})

    return run


def near_duplicates(records: DataFrame, ident: str, text: Column, threshold: str = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Classes of records with equal token sets, and the pairs of classes at ``threshold`` or more.

    Returns ``members`` (class_id, record_id) and ``pairs`` (class_a, class_b, common, size_a,
    size_b): class_id is the smallest record id of the class; class_a < class_b; every pair of classes whose
    token sets have ``threshold`` of their union in common is there, once. Records without a token and null ids
    are in no class; of rows with one id the one with the greatest text counts. An empty table gives empty results.

    Exact, without comparing all pairs: sets are put into size bands, so that similar ones are of the same band or of neighbours, and within a band their tokens are parted by hash into one part more than
    similar sets can differ by tokens. Two similar sets then have an equal part: a tile is named by band, part and the tokens in it. Within a tile a
    256-bit signature bounds the overlap: each bit that differs costs at least one token that is
    not shared. What passes is settled by the exact intersection of the sorted arrays. Tokens are compared by 64-bit hashes.
    """
    ratio = Fraction(threshold)
    num, den = ratio.numerator, ratio.denominator
    docs = records.where(F.col(ident).isNotNull()).groupBy(F.col(ident).alias("record_id")).agg(F.max(F.coalesce(text, F.lit(""))).alias("t"))
    docs = docs.select("record_id", token_set(F.col("t")).alias("h")).where(F.size("h") > 0)
    docs = materialize(docs.select("record_id", F.struct(F.xxhash64(F.lit(1), "h").alias("x"), F.xxhash64(F.lit(2), "h").alias("y")).alias("digest"), "h"), "docs")
    classes = docs.groupBy("digest").agg(F.min("record_id").alias("class_id"), F.any_value("h").alias("h"))
    classes = materialize(classes.withColumn("k", F.monotonically_increasing_id()), "classes")
    members = skew_join(docs.select("record_id", "digest"), classes.select("digest", "class_id"), ["digest"], hot=hot_keys(docs, ["digest"])).select("class_id", "record_id")
    # A set of fewer tokens than ratio / (1 - ratio) is similar to no other set but itself.
    able = classes.where(F.size("h") >= math.ceil(ratio / (1 - ratio))).select("k", "h")
    schema = "tile bigint, k bigint, size int, guest boolean, " + ", ".join(f"s{w} bigint" for w in range(WORDS))
    rows = materialize(able.mapInPandas(_tile_rows(ratio), schema), "tiles")

    def possible(a: Column, b: Column) -> Column:
        x, y = a["size"], b["size"]
        differ = sum((F.bit_count(a[f"s{w}"].bitwiseXOR(b[f"s{w}"])) for w in range(WORDS)), F.lit(0))
        return ~(a["guest"] & b["guest"]) & (F.least(x, y) * den >= F.greatest(x, y) * num) & (differ * (den + num) <= (x + y) * (den - num))

    near = self_pairs(rows, "tile", "k", possible).select(F.col("a.k").alias("a"), F.col("b.k").alias("b")).distinct()
    near = materialize(near, "near")
    discard(rows)
    for end in ("a", "b"):
        near = skew_join(near, classes.select(F.col("k").alias(end), F.col("class_id").alias(f"class_{end}"), F.col("h").alias(f"h_{end}")), [end])
    near = near.select("class_a", "class_b", F.size(F.array_intersect("h_a", "h_b")).alias("common"), F.size("h_a").alias("size_a"), F.size("h_b").alias("size_b"))
    near = near.where(F.col("common") * den >= (F.col("size_a") + F.col("size_b") - F.col("common")) * num)
    swap = F.col("class_a") > F.col("class_b")
    pairs = near.select("common", *[F.when(swap, F.col(f"{c}_{y}")).otherwise(F.col(f"{c}_{x}")).alias(f"{c}_{x}") for c in ("class", "size") for x, y in (("a", "b"), ("b", "a"))])
    return materialize(members, "members"), materialize(pairs.select("class_a", "class_b", "common", "size_a", "size_b"), "pairs")


def record_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b): all pairs of records that ``near_duplicates`` implies, a < b: within a class, and between similar classes."""
    alike = self_pairs(members, "class_id", "record_id").select(F.col("a.record_id").alias("a"), F.col("b.record_id").alias("b"))
    across = pairs.select("class_a", "class_b")
    crowded = hot_keys(members, ["class_id"])
    for end in ("a", "b"):
        # A large class meets all its partners: its members are salted, not gathered.
        own = members.select(F.col("class_id").alias(f"class_{end}"), F.col("record_id").alias(end))
        across = skew_join(own, across, [f"class_{end}"], hot=crowded and crowded.withColumnRenamed("class_id", f"class_{end}"), keys=0)
    across = across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return alike.unionByName(across)


def unfiled_nodes(nodes: DataFrame) -> DataFrame:
    """The authored and synthesized nodes with what they say."""
    return nodes.where("source_kind <> 'derived_from_file'").select("id", F.concat_ws(" ", "summary", "body").alias("said"))
