"""Problem 9: evaluation texts leaking into training text: CGK embedding, bit-sampling LSH over windows, exact verification."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


#: A leak is this many consecutive words of an item, or all of a shorter item.
WINDOW = 12
#: Items are taken in blocks of this many rows: one block's index is what a worker holds, and a larger test set takes several passes.
BLOCK = 20_000
RECALL = 0.99
#: An edit is allowed for so many words of a window; a shorter window must occur as it is.
WORDS_PER_EDIT = 6
#: Windows with edits are hashed by positions of their first so many words, the greatest of these that a window has; then they are verified whole.
SPANS = (6, 8, 12, 16, 24, 32, 48)
#: Numbers of sampled positions to choose from, and the most hashes that may be needed.
SAMPLES = (8, 6, 5, 4, 3, 2)
MOST_ROUNDS = 100
#: Raw words whose number a worker remembers; bounds memory, not the result.
REMEMBERED = 1_000_000
#: Colliding windows verified at a time.
VERIFIED = 100_000

_WORDS = re.compile(r"[^\W_]+").findall


def words(text: str | None) -> list[str]:
    """The maximal runs of letters and digits, lower-cased."""
    return [w.lower() for w in _WORDS(text or "")]


def allowed(size: int, edits: int) -> int:
    """The edits a window of ``size`` words may have."""
    return min(edits, size // WORDS_PER_EDIT)


def _walk(flat: np.ndarray, coins: np.ndarray, starts: np.ndarray, steps: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(step, word written) at each of the ascending ``steps`` of the CGK walks from ``starts``.

    Step j writes the current word, then moves on if bit j of the word's random bits is set. Two walks that an edit has put out of step
    drift against each other and fall into step again, so few edits change few of the words written. ``coins`` are the bits of the words of ``flat``.
    """
    at, wanted = starts.copy(), set(steps)
    for j in range(steps[-1] + 1):
        if j in wanted:
            yield j, flat[at]
        at += (coins[at] >> (j % 62)) & 1


def _mix(key: np.ndarray | None, word: np.ndarray, weight: int) -> np.ndarray:
    x = (word.astype(np.uint64) + np.uint64(0x9E37)) * np.uint64(weight)
    x ^= x >> np.uint64(31)
    return x if key is None else key * np.uint64(0x9E3779B97F4A7C15) + x


@lru_cache(maxsize=256)
def hash_plan(span: int, edits: int, recall: float) -> tuple[int, int]:
    """(sampled positions, rounds) so that a window of ``span`` words and one ``edits`` edits away collide in some round with probability ``recall``.

    Measured, not bounded: 400 windows of different words get ``edits`` random edits and both sides are walked with fresh bits in ``MOST_ROUNDS`` rounds; of the numbers of
    sampled positions the one with the fewest rounds times positions left to verify is taken, the largest that needs no more than half of the rounds, else the one needing fewest. Positions lie below ``span``, where no walk has left the window.
    """
    rng = np.random.default_rng(span * 100 + edits)
    trials, width = 400, span + edits + 1
    a = np.tile(np.arange(1, width + 1), (trials, 1))
    b = []
    for row in a.tolist():
        for _ in range(edits):
            at, kind = int(rng.integers(0, span)), int(rng.integers(0, 3))
            row[at : at + (kind != 1)] = [] if kind == 0 else [int(rng.integers(1000, 1 << 20))]
        b.append((row + list(range(2000, 2000 + edits)))[:width])
    flat = np.concatenate([a.ravel(), np.array(b).ravel(), np.zeros(2 * span, np.int64)])
    starts = np.arange(2 * trials) * width
    best = (SAMPLES[-1], MOST_ROUNDS, -1.0)
    for sampled in SAMPLES:
        hit, rounds = np.zeros(trials, bool), 0
        while rounds < MOST_ROUNDS and hit.mean() < recall:
            coins = rng.integers(0, 1 << 62, 1 << 20, np.int64)[flat]
            same = np.ones(trials, bool)
            for _, w in _walk(flat, coins, starts, sorted(rng.choice(span, min(sampled, span), replace=False).tolist())):
                same &= w[:trials] == w[trials:]
            hit |= same
            rounds += 1
        if hit.mean() >= recall and rounds <= MOST_ROUNDS // 2:
            return sampled, rounds
        if hit.mean() > best[2] or (hit.mean() == best[2] and rounds < best[1]):
            best = (sampled, rounds, float(hit.mean()))
    return best[:2]


class Index:
    """Hashed windows of a block of items. ``items``: (item_id, text); ``window``: words of a window, None for whole items."""

    def __init__(self, items: list[tuple[int, str]], window: int | None = WINDOW, edits: int = 0, recall: float = RECALL, seed: int = 9):
        texts = [(i, w) for i, t in items if i is not None and (w := words(t))]
        self.number = {w: n for n, w in enumerate(sorted({w for _, ws in texts for w in ws}), 1)}
        rng = np.random.default_rng(seed)
        by_size: dict[int, list[tuple[int, list[int]]]] = {}
        for i, ws in texts:
            ids, size = [self.number[w] for w in ws], min(window or len(ws), len(ws))
            for at in range(len(ids) - size + 1):
                by_size.setdefault(size, []).append((i, ids[at : at + size]))
        #: (size, edits, windows, their items), by size.
        self.sizes = {size: (allowed(size, edits), np.array([r[1] for r in rows], np.int64), np.array([r[0] for r in rows], np.int64)) for size, rows in sorted(by_size.items())}
        spans: dict[int, list[int]] = {}
        for size, (k, _, _) in self.sizes.items():
            spans.setdefault(max(s for s in SPANS if s <= size) if k else -size, []).append(size)
        plans = {s: hash_plan(s, max(self.sizes[z][0] for z in sizes), recall) if s > 0 else (-s, 1) for s, sizes in spans.items()}
        #: Rounds of (bits of the words, span, positions, weights, sorted keys, size of each, window of each).
        self.rounds = []
        for r in range(max((p[1] for p in plans.values()), default=0)):
            bits, parts = rng.integers(0, 1 << 62, len(self.number) + 1, np.int64), []
            for span, (sampled, rounds) in plans.items():
                if r >= rounds:
                    continue
                # Windows without edits are equal, and so are their embeddings, whole.
                at = sorted(rng.choice(span, min(sampled, span), replace=False).tolist()) if span > 0 else list(range(-span))
                weights = [int(w) | 1 for w in rng.integers(1, 1 << 62, len(at), np.int64)]
                keys, owner, row = [], [], []
                for size in spans[span]:
                    table = self.sizes[size][1]
                    flat = np.concatenate([table.ravel(), np.zeros(1, np.int64)])
                    key = None
                    for (_, w), weight in zip(_walk(flat, bits[flat], np.arange(len(table)) * size, at), weights, strict=True):
                        key = _mix(key, w, weight)
                    keys.append(key)
                    owner.append(np.full(len(table), size))
                    row.append(np.arange(len(table)))
                key = np.concatenate(keys)
                order = np.argsort(key, kind="stable")
                parts.append((abs(span), at, weights, key[order], np.concatenate(owner)[order], np.concatenate(row)[order]))
            self.rounds.append((bits, parts))
        self.edits = {abs(s): max(self.sizes[z][0] for z in sizes) for s, sizes in sorted(spans.items(), reverse=True)}


def edit_distance(a: list[int], b: list[int]) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def _fewest_edits(windows: np.ndarray, flat: np.ndarray, places: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """The fewest edits between each window and any run of words that begins at its place and ends within its text; k + 1 for more than ``k``."""
    n = windows.shape[1]
    at = places[:, None] + np.arange(n + k)[None, :]
    text = np.where(at < ends[:, None], flat[np.minimum(at, len(flat) - 1)], -1)
    if not k:
        return (text != windows).any(axis=1).astype(np.int64)
    far = np.int64(n + k + 1)
    # row[d + k]: cost of the first i words of the window against the first i + d of the text.
    row = [np.full(len(places), max(d, 0) if d >= 0 else far) for d in range(-k, k + 1)]
    for i in range(n):
        nxt = []
        for d in range(-k, k + 1):
            j = i + d
            cost = row[d + k] + (text[:, j] != windows[:, i]) if j >= 0 else np.full(len(places), i + 1 if j == -1 else far)
            if d < k:
                cost = np.minimum(cost, row[d + k + 1] + 1)
            if d > -k and j >= 0:
                # A word of the text that the window does not have; past the end of the text there is none.
                cost = np.minimum(cost, np.where(text[:, j] >= 0, nxt[-1] + 1, far))
            nxt.append(cost)
        row = nxt
    for d in range(1, k + 1):
        row[d + k] = np.where(text[:, n + d - 1] >= 0, row[d + k], far)
    return np.minimum(np.min(row, axis=0), k + 1)


def _matches(index: Index, flat: np.ndarray, limits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(place in ``flat``, item_id, window, edits) of verified runs of words; ``limits`` are the ends of the texts in ``flat``."""
    if not len(flat) or not index.rounds:
        return
    zeros = np.concatenate([[0], np.cumsum(flat == 0)])
    # A window with more foreign words among its first ones than edits can match nothing.
    open_at = {s: np.flatnonzero(zeros[np.minimum(np.arange(len(flat)) + s, len(flat))] - zeros[:-1] <= k) for s, k in index.edits.items()}
    longest = max(at[-1] for _, parts in index.rounds for _, at, *_ in parts) + 1
    padded = np.concatenate([flat, np.zeros(longest + 1, np.int64)])
    seen: dict[int, np.ndarray] = {}
    for bits, parts in index.rounds:
        coins = bits[padded]
        for span, at, weights, keys, owner, row in parts:
            starts, key = open_at[span], None
            if not len(starts):
                continue
            for (_, w), weight in zip(_walk(padded, coins, starts, at), weights, strict=True):
                key = _mix(key, w, weight)
            lo = np.searchsorted(keys, key, "left")
            hit = np.flatnonzero((lo < len(keys)) & (keys[np.minimum(lo, len(keys) - 1)] == key))
            if not len(hit):
                continue
            many = np.searchsorted(keys, key[hit], "right") - lo[hit]
            place = np.repeat(starts[hit], many)
            which = np.repeat(lo[hit], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            for size in np.unique(owner[which]):
                mine = owner[which] == size
                k, table, items = index.sizes[int(size)]
                pair = np.unique(place[mine] * len(table) + row[which[mine]])
                if k:  # what an earlier round has verified is known
                    old = seen.get(int(size), np.empty(0, np.int64))
                    pair = np.setdiff1d(pair, old, assume_unique=True)
                    seen[int(size)] = np.union1d(old, pair)
                for a in range(0, len(pair), VERIFIED):
                    p, r = np.divmod(pair[a : a + VERIFIED], len(table))
                    cost = _fewest_edits(table[r], flat, p, limits[np.searchsorted(limits, p, "right")], k)
                    good = cost <= (k if k else 0)
                    if good.any():
                        yield p[good], items[r[good]], r[good], cost[good]


def _find(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        number = own.number.get

        class Memory(dict):
            def __missing__(self, raw: str) -> int:
                if len(self) >= REMEMBERED:
                    self.clear()
                n = self[raw] = number(raw.lower(), 0)
                return n

        get = Memory().__getitem__
        for batch in batches:
            docs = batch.column(0).to_numpy(zero_copy_only=False)
            parts, ends, total = [], [], 0
            for text in batch.column(1).to_pylist():
                ids = np.fromiter(map(get, _WORDS(text)), np.int64) if text else np.empty(0, np.int64)
                parts += [ids, np.zeros(1, np.int64)]  # a foreign word between texts
                total += len(ids) + 1
                ends.append(total - 1)
            flat, ends = np.concatenate(parts), np.array(ends)
            begins = np.concatenate([[0], ends[:-1] + 1])
            found: dict[tuple[int, int], tuple[int, int, int]] = {}
            for place, item, window, edits in _matches(own, flat, ends):
                doc = np.searchsorted(ends, place, "right")
                for d, i, p, w, e in zip(doc.tolist(), item.tolist(), (place - begins[doc]).tolist(), window.tolist(), edits.tolist(), strict=True):
                    first, windows, least = found.get((d, i), (p, set(), e))
                    windows.add(w)
                    found[d, i] = (min(first, p), windows, min(least, e))
            rows = [(docs[d], i, p, len(ws), e) for (d, i), (p, ws, e) in found.items()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["doc_id", "item_id", "first_word", "windows", "edits"])

    return run


def leaked_items(documents: DataFrame, items: DataFrame, window: int | None = WINDOW, edits: int = 0, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, first_word, windows, edits): the documents that contain part of an item.

    Contained is a window of ``window`` consecutive words of the item (all of them if it has fewer, or if ``window`` is None) within ``edits`` word edits (insertions, deletions
    and replacements; at most one for every ``WORDS_PER_EDIT`` words) of a run of consecutive words of the document. first_word is where the first match starts in the
    document (words from 0), windows the number of different windows of the item found, edits the fewest
    of a match. A window that occurs as it is is always found; one with edits with a probability of ``recall`` or
    more. Null texts, and texts or items without a word, match nothing; null item ids are dropped; a repeated doc_id gives one row
    for each item; other columns are not read. Empty tables give an empty result.

    The windows of both sides are embedded by the CGK random walk, which makes of few edits few different positions; windows are hashed by sampled positions in as many rounds as
    reach the recall (``hash_plan``; one where no edit is allowed, since equal windows have equal embeddings), and what collides is verified exactly, in the scan of the documents: nothing of the corpus
    is shuffled but the matches. The items come to the driver ``block`` rows at a time and are broadcast; more items take more passes.
    """
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    schema = "doc_id bigint, item_id bigint, first_word int, windows int, edits int"
    parts, pending = [], []
    for r in [*rows.toLocalIterator(), None]:
        if r is not None:
            pending.append((r["item_id"], r["text"]))
        if pending and (r is None or len(pending) == block):
            index = spark.sparkContext.broadcast(Index(pending, window, edits, recall))
            parts.append(texts.mapInArrow(_find(index), schema))
            pending = []
    if not parts:
        return spark.createDataFrame([], schema)
    found = reduce(DataFrame.unionByName, parts)
    return found.groupBy("doc_id", "item_id").agg(F.min("first_word").alias("first_word"), F.max("windows").alias("windows"), F.min("edits").alias("edits"))
