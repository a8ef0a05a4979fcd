"""Problem 8: encoding of the whole corpus with a public tokenizer, by a backtracking encoder."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

#: Folder of the vocabulary files, and the file of byte_bpe_50k.
FOLDER = os.environ.get("MEMLOOM_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE_50K = f"{FOLDER}/byte_bpe_50k.json"

# How the byte-level vocabulary cuts a text into pieces before merging.
PIECE = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_UNICODE = regex.compile(PIECE).findall
#: The same for ASCII, where the standard library's matcher is faster. White space there is the property, without \x1c to \x1f.
_ASCII = re.compile(PIECE.replace(r"[^\s\p{L}\p{N}]", r"[^\t-\r A-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]").replace(r"\s", r"[\t-\r ]").replace(r"\S", r"[^\t-\r ]")).findall


def split_pieces(text: str) -> list[str]:
    return _ASCII(text) if text.isascii() else _UNICODE(text)


#: Pieces whose ids a worker remembers; beyond it starts afresh. It bounds memory, not the result.
REMEMBERED = 500_000
#: Longer pieces are encoded each time, so that what is remembered stays small.
LONGEST = 64


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of every byte in the vocabulary file: itself where printable, else the next letter from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Exact byte-pair encoding in time linear in the text, without merging.

    A text of tokens is what merging gives if and only if every two neighbours are compatible: merging
    their bytes alone gives just these two. The encoder walks to the right, takes the longest token that
    starts at each place (found for all places by one Aho-Corasick pass), and checks it against
    the token before; where that fails it takes the next shorter token, and where none is
    left it steps back and marks the place as a dead end, so no place is left twice in the same way.
    """

    def __init__(self, path: str = BYTE_BPE_50K):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte_of = _byte_letters()
        spelled = {word: bytes(byte_of[c] for c in word) for word in model["vocab"] if all(c in byte_of for c in word)}
        self.id_of = {spelled[w]: i for w, i in model["vocab"].items() if w in spelled}
        self.size = 1 + max(model["vocab"].values())
        rank, halves = {}, {}
        for r, m in enumerate(model["merges"]):
            left, right = m.split(" ") if isinstance(m, str) else m
            a, b = self.id_of[spelled[left]], self.id_of[spelled[right]]
            whole = self.id_of.get(spelled[left] + spelled[right])
            if whole is not None and whole not in halves:
                rank[a, b] = r
                halves[whole] = (a, b, r)
        # Only what merging can reach is a token here; special tokens are ordinary text and so no tokens.
        self.rank, self.halves = rank, halves
        self.bytes_of = [b""] * self.size
        for word, i in self.id_of.items():
            if i in halves or len(word) == 1:
                self.bytes_of[i] = word
        self.blob = b"".join(self.bytes_of)
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in self.bytes_of])]).tolist()
        known = {w: i for i, w in enumerate(self.bytes_of) if w}
        self.shorter = {i: next((known[w[:n]] for n in range(len(w) - 1, 0, -1) if w[:n] in known), -1) for w, i in known.items()}
        self.automaton = ahocorasick.Automaton()
        for w, i in known.items():
            self.automaton.add_word(w.decode("latin-1"), (i, len(w)))
        self.automaton.make_automaton()
        self.known = known
        self.compatible: dict[tuple[int, int], bool] = {}
        self.pieces = split_pieces

    def fits(self, a: int, b: int) -> bool:
        """Whether no merge crosses the border of a and b before both are complete; looked up once for each pair."""
        answer = self.compatible.get((a, b))
        if answer is None:
            if len(self.compatible) >= 4 * REMEMBERED:
                self.compatible.clear()
            answer = self.compatible[a, b] = self._border_holds(a, b)
        return answer

    def _border_holds(self, a: int, b: int) -> bool:
        """Undo merges on both sides of the border, the latest first; a merge across it that came earlier than the undone ones would have happened.

        The right edge of a is a chain of tokens, each the right half of the one before, and so is the left edge of b. At any
        moment of merging one token of each chain stands at the border. A pair (x, y) of them merges
        across if its rank is below the ranks at which x and y are merged on into the next of their chains.
        """
        never = len(self.rank) + 1
        left, right = [(a, never)], [(b, never)]  # (token, rank at which it is merged further)
        while left[-1][0] in self.halves:
            _, y, r = self.halves[left[-1][0]]
            left.append((y, r))
        while right[-1][0] in self.halves:
            x, _, r = self.halves[right[-1][0]]
            right.append((x, r))
        # Both chains grow from bytes; the side with the earlier next merge moves first (on a tie the left one, as merging goes from left to right).
        i, j = len(left) - 1, len(right) - 1
        while True:
            (x, up_x), (y, up_y) = left[i], right[j]
            r = self.rank.get((x, y), never)
            # On equal ranks the leftmost pair merges first: x's own merge lies to the left of the border, y's to the right.
            if r < up_x and r <= up_y and r < never:
                return False
            if not i and not j:
                return True
            if i and (up_x <= up_y or not j):
                i -= 1
            else:
                j -= 1

    def encode_piece(self, data: bytes) -> tuple[int, ...]:
        """The ids of one piece, given as bytes."""
        whole = self.known.get(data)
        if whole is not None:
            return (whole,)
        n = len(data)
        longest = [0] * n  # id of the longest token that starts at each place
        reach = [0] * n
        for end, (token, size) in self.automaton.iter(data.decode("latin-1")):
            start = end - size + 1
            if size > reach[start]:
                reach[start], longest[start] = size, token
        length, fits, shorter = self.bytes_of, self.fits, self.shorter
        open_at = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + len(length[token])
                if open_at[end] and (last < 0 or fits(last, token)):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                if at == n:
                    return tuple(out)
                token = longest[at]
            else:
                open_at[at] = 0
                token = out.pop()
                at -= len(length[token])

    def encoder(self):
        """text -> the ids as 32-bit integers in one bytes object; pieces are remembered in that form."""
        encode = self.encode_piece

        class Memory(dict):
            def __missing__(self, piece: str) -> bytes:
                ids = array("i", encode(piece.encode("utf-8", "surrogatepass"))).tobytes()
                if len(piece) <= LONGEST:
                    if len(self) >= REMEMBERED:
                        self.clear()
                    self[piece] = ids
                return ids

        get, pieces, join = Memory().__getitem__, self.pieces, b"".join
        return lambda text: join(map(get, pieces(text)))

    def encode(self, text: str | None) -> list[int]:
        return list(memoryview(self.encoder()(text)).cast("i")) if text else []

    def decode(self, ids) -> str:
        """The text of ids, cut from one run of bytes by the offset table."""
        blob, at = self.blob, self.offsets
        return b"".join([blob[at[i] : at[i + 1]] for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def load(path: str) -> Encoder:
    return Encoder(path)


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = load(path).encoder()
        for batch in batches:
            ids = [to_ids(text) if text else b"" for text in batch.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids]) // 4])
            values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(ids))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)], ["doc_id", "ids"])

    return run


def encode_corpus(documents: DataFrame, path: str = BYTE_BPE_50K) -> DataFrame:
    """(doc_id, ids) of every row: the ids of its text exactly as stored, without special tokens.

    Text that looks like a special token is ordinary text. An empty and a null text give an empty list, a
    null doc_id stays null, repeated rows stay repeated, other columns are not read. One scan without a
    shuffle; each worker loads the vocabulary once. ``path`` must be readable on every executor.
    """
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_encode(path), "doc_id bigint, ids array<int>")


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = load(path).decode
        for batch in batches:
            texts = [None if ids is None else decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def decode_corpus(encoded: DataFrame, path: str = BYTE_BPE_50K) -> DataFrame:
    """(doc_id, text) from (doc_id, ids): the inverse of ``encode_corpus``; a null list gives null, an empty one an empty text."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(path), "doc_id bigint, text string")
