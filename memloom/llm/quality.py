"""Problem 10: per-document text quality statistics and outlier scores from exact per-language ranks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from memloom.operators.ordering import partition_offsets, sorted_with_local_rows
from memloom.operators.skew import skew_join
from memloom.session import discard, materialize

#: The common words of a language are its words that occur in most documents, so many of them.
COMMON = 25
#: A language tag counts as a language if at least this share of the documents carry it.
LANGUAGE_SHARE = 0.01
#: A document is in a language if this share of its words, and two different ones, are common in it.
SPOKEN = 1 / 16
#: A line or stretch of words is bare if fewer than this share of its words are common.
BARE = 1 / 10
STRETCH = 12

_WORD = re.compile(r"[^\W\d_]+")
_ITEM = re.compile(r"\s*(?:[^\w\s#\"'(¿¡<>{\[|]|\[.?\]|\(?\w{1,3}[.)])\s+\S")
_STOPS = frozenset(".!?…。！？")

#: Shares are counted in thousandths, lengths of words and lines in hundredths, so ties are exact.
STATISTICS = (
    "words", "mean_word_length", "symbol_ratio", "digit_ratio", "stop_line_share", "common_word_share", "item_line_share", "delimiter_ratio", "repeated_share",
    "underscore_ratio", "words_per_line", "bare_stretch_share", "distinct_share", "item_text_share", "stops_per_word", "bare_text_share",
)

#: Rank of a document among all documents, whatever their language.
ALL = "*"


def text_statistics(text: str | None, common: dict[str, frozenset[str]]) -> tuple[str | None, list[int]] | None:
    """The language whose ``common`` words the text uses most, None if it uses too few, and the values of ``STATISTICS``; None for a text that is null or blank."""
    if not text or text.isspace():
        return None
    low = text.lower()
    lines = [(x, _WORD.findall(x)) for raw in low.splitlines() if (x := raw.strip())]
    words = [w for _, ws in lines for w in ws]
    n, seen = len(words), set(words)
    used = {k: len(seen & own) for k, own in common.items()}
    lang = max(used, key=lambda k: (used[k], k)) if used else None
    own = common[lang] if lang else frozenset()
    known = [w in own for w in words]
    if not lang or used[lang] < 2 or sum(known) < SPOKEN * n:
        lang, own, known = None, frozenset(), [False] * n
    letters, digits = sum(map(len, words)), sum(map(low.count, "0123456789"))
    dense = sum(map(len, low.split())) or 1
    full = bare = listed = stops = items = 0
    for line, ws in lines:
        size = len(line) - line.count(" ")
        full += size
        if not ws or sum(map(own.__contains__, ws)) < BARE * len(ws):
            bare += size
        if _ITEM.match(line):
            items += 1
            listed += size
        stops += line[-1] in _STOPS
    parts = max(1, n // STRETCH)
    at = [i * n // parts for i in range(parts + 1)]
    stretches = sum(sum(known[a:b]) * STRETCH < 2 * (b - a) for a, b in zip(at, at[1:], strict=False)) / parts if n else 1.0
    delimiters = low.count("|") + low.count("\t") + low.count(";") + low.count(",") - low.count(", ") + low.count("   ")
    repeated = 1 - len(set(zip(words, words[1:], words[2:], strict=False))) / (n - 2) if n > 5 else 0.0
    of = lambda x, whole: round(1000 * x / whole) if whole else 0
    values = [
        n, round(100 * letters / n) if n else 0, of(max(0, dense - letters - digits), dense), of(digits, dense), of(stops, len(lines)), of(sum(known), n), of(items, len(lines)), of(delimiters, dense), round(1000 * repeated),
        of(low.count("_"), dense), round(100 * n / len(lines)), round(1000 * stretches), of(len(seen), n), of(listed, full), of(sum(map(low.count, ".!?")), n), of(bare, full),
    ]
    return lang, values


def common_words(documents: DataFrame, most: int = COMMON, share: float = LANGUAGE_SHARE) -> dict[str, frozenset[str]]:
    """The ``most`` words that occur in most documents of each language tag that at least ``share`` of all documents carry; ties by the word.

    Counted over all documents. The tag is the first two or three letters of ``lang`` whatever their case. Null texts and tags count for nothing. The result has
    at most ``most / share`` words: the counts shrink to the first of every task before they are shuffled.
    """
    tag = F.regexp_extract(F.lower(F.trim("lang")), "^[a-z]{2,3}", 0)
    rows = documents.where("text is not null").select(tag.alias("tag"), "text")
    counts = rows.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    sizes = rows.where("tag <> ''").groupBy("tag").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= share * counts)
    tags = [r["tag"] for r in sizes.collect()]
    if not tags:
        return {}
    each = rows.where(F.col("tag").isin(tags)).select("tag", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), 0))).alias("word"))
    each = each.groupBy("tag", "word").agg(F.count(F.lit(1)).alias("n"))
    first = each.withColumn("r", F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("n"), "word"))).where(F.col("r") <= most)
    found: dict[str, set[str]] = {}
    for r in first.select("tag", "word").collect():
        found.setdefault(r["tag"], set()).add(r["word"])
    return {k: frozenset(v) for k, v in sorted(found.items())}


def _statistics(common):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, langs, rows = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = text_statistics(text, common.value)
                if found:
                    ids.append(doc)
                    langs.append(found[0])
                    rows.append(found[1])
            table = np.array(rows, np.int64).reshape(len(rows), len(STATISTICS))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), *(pa.array(table[:, i]) for i in range(len(STATISTICS)))], ["doc_id", "language", *STATISTICS])

    return run


def document_statistics(documents: DataFrame, common: dict[str, frozenset[str]] | None = None) -> DataFrame:
    """(doc_id, language, ...``STATISTICS``) of every document with some text that is not blank.

    Counted over the whole text. language is the one whose ``common`` words (by default those of ``common_words``) the text uses most, null if it uses too few of any. Shares are in
    thousandths, mean lengths in hundredths. Rows with a null doc_id are dropped; null, empty and blank texts give no row; other columns are not read.
    """
    rows = documents.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = documents.sparkSession.sparkContext.broadcast(common_words(documents) if common is None else common)
    return rows.mapInArrow(_statistics(shared), "doc_id bigint, language string, " + ", ".join(f"{s} bigint" for s in STATISTICS))


def tail_probabilities(values: DataFrame, group: list[str], value: str, small: int | None = None) -> DataFrame:
    """(*group, value, at_most, at_least): the exact shares of rows of the group with at most and at least each value.

    Equal values are counted first, combined on the map side, so a value that a third of all rows share is one row.
    The counts are sorted by range over all partitions; running sums within each partition plus the sums of the partitions
    before give exact ranks, and no partition has to hold a group. The totals of the groups are broadcast if there are at most ``small`` of them.
    """
    small = SMALL_TABLE if small is None else small
    counts = values.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    ordered = sorted_with_local_rows(counts, [*map(F.col, group), F.col(value)], "ranks")
    offsets = F.broadcast(partition_offsets(ordered, F.col("n")))
    within = F.sum("n").over(Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0))
    ranked = ordered.withColumn("upto", within).join(offsets, "_part").withColumn("upto", F.col("upto") + F.col("_before"))
    whole = ranked.groupBy(*group).agg(F.min(F.col("upto") - F.col("n")).alias("start"), F.sum("n").alias("total"))
    ranked = ranked.join(F.broadcast(whole) if whole.limit(small + 1).count() <= small else whole, group)
    upto = F.col("upto") - F.col("start")
    return ranked.select(*group, value, (upto / F.col("total")).alias("at_most"), ((F.col("total") - upto + F.col("n")) / F.col("total")).alias("at_least"))


#: A table of ranks of at most this many rows is broadcast; a larger one is joined by shuffle.
SMALL_TABLE = 400_000
#: At most this many labelled rows are used to weigh the tails; of more, those of the smallest hash.
LABELLED = 20_000
#: Beside its logarithm a tail probability p speaks by how far it stays below each of these.
LEVELS = (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5)
#: How hard the weights are drawn to 0: some labels are wrong.
PULL = 10.0


def _evidence() -> list[Column]:
    """What the two tail probabilities of a value say, each 0 for a value that is not in the tail."""
    sides = [F.col("at_most"), F.col("at_least")]
    return [-F.log(p) for p in sides] + [F.greatest(F.lit(0.0), 1 - p / level) for level in LEVELS for p in sides]


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Logistic regression by Newton steps, all weights but the bias drawn to 0."""
    z = np.column_stack([np.ones(len(x)), x])
    w, pull = np.zeros(z.shape[1]), np.full(z.shape[1], PULL)
    pull[0] = 1e-3
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pull), z.T @ (p - y) + pull * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), w[1:]


def outlier_scores(documents: DataFrame, labels: DataFrame | None = None, small: int | None = None) -> DataFrame:
    """(doc_id, language, ...``STATISTICS``, outlier, score): how far each document lies out among those of its language, and whether that speaks against prose.

    ``outlier`` is the sum over the statistics of the larger of -ln of its two empirical tail probabilities among the documents of its language (among all if it has none).
    ``score`` sums what the tails say, among the language and among all, by weights that are a logistic regression on at most ``LABELLED`` labelled documents (label ``prose`` or ``not_prose``; of several labels for
    a document the majority, none if equal): above 0 a document is taken for not running prose. Without labels of both kinds the score is null. Nothing but the tails enters it. Ranks and scores are over all documents with text. A repeated doc_id has
    one row for each of its rows. ``small``: the number of rank rows up to which they are broadcast (default ``SMALL_TABLE``).
    """
    small = SMALL_TABLE if small is None else small
    stats = materialize(document_statistics(documents).withColumn("row", F.monotonically_increasing_id()), "stats")
    own = F.coalesce("language", F.lit(ALL))
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("stat"), F.col(s).alias("value")) for i, s in enumerate(STATISTICS)])).alias("s")
    long = stats.select("row", "doc_id", own.alias("language"), cells).select("row", "doc_id", "language", "s.stat", "s.value")
    among = long.withColumn("language", F.explode(F.array_distinct(F.array("language", F.lit(ALL)))))
    ranks = materialize(tail_probabilities(among, ["language", "stat"], "value", small), "ranks")
    fits = ranks.count() <= small
    key = ["within", "language", "stat", "value"]
    # Each rank speaks in its own role: within the language, or among all; who has no language is ranked among all in both.
    roles = ranks.withColumn("within", F.explode(F.when(F.col("language") == ALL, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))))
    both = lambda rows: rows.select("*", F.explode(F.array(F.struct(F.lit(True).alias("within"), F.col("language").alias("at")), F.struct(F.lit(False).alias("within"), F.lit(ALL).alias("at")))).alias("role")).withColumn("within", F.col("role.within")).withColumn("language", F.col("role.at")).drop("role")
    joined = lambda rows, table: (rows.join(F.broadcast(table), key) if fits else skew_join(rows, table, key))
    n, per = len(STATISTICS), 2 + 2 * len(LEVELS)
    bias = weights = None
    if labels is not None:
        votes = labels.where("doc_id is not null and label in ('prose', 'not_prose')").groupBy("doc_id").agg(F.sum(F.when(F.col("label") == "prose", -1).otherwise(1)).alias("vote")).where("vote <> 0")
        votes = materialize(votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED), "votes")
        seen = joined(both(long.join(F.broadcast(votes), "doc_id")), roles.withColumn("e", F.array(*_evidence()))).select("row", "vote", "within", "stat", "e").toPandas()
        y = seen.drop_duplicates("row").sort_values("row")["vote"].to_numpy() > 0 if len(seen) else np.empty(0, bool)
        if y.any() and not y.all():
            x = np.stack(seen.sort_values(["row", "within", "stat"])["e"]).reshape(len(y), 2 * n * per)
            bias, weights = _fit(x, y.astype(float))
            weights = weights.reshape(2, n, per)
        discard(votes)
    part = F.lit(None).cast("double")
    if weights is not None:
        place = F.col("within").cast("int") * n + F.col("stat") + 1
        part = sum((F.element_at(F.array(*[F.lit(float(w)) for w in weights[:, :, i].ravel()]), place) * e for i, e in enumerate(_evidence())), F.lit(0.0))
    table = roles.select(*key, F.when(F.col("within"), F.greatest(-F.log("at_most"), -F.log("at_least"))).otherwise(0.0).alias("tail"), part.alias("part"))
    scored = joined(both(long.drop("doc_id")), materialize(table, "parts")).groupBy("row").agg(F.sum("tail").alias("outlier"), (F.sum("part") + F.lit(bias)).alias("score"))
    return stats.join(scored, "row").drop("row")
