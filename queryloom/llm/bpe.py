"""Byte-level BPE, encoding and decoding.

Encoding is the textbook algorithm: the bytes of a pre-token are a doubly linked list
of symbols, a priority queue holds (merge rank, place) of every adjacent pair that has
a merge, and an entry whose pair has changed since it was queued is stale and skipped.
A pre-token's ids never depend on its neighbours, so they are kept by pre-token in a
bounded cache of each worker. Decoding concatenates the vocabulary's byte strings.

Defined results: a null text is the empty text (no ids); a special token's string in a
text becomes its id; ids of rows that repeat are computed anew; other columns are
ignored. Nothing is exchanged between rows, so there is no shuffle and no skew beyond
the length of one text.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queryloom.llm._common import strings

PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: White space as the pre-tokenizer knows it; a stretch between two places it may cut at is a chunk.
WS = "\t-\r \x85\xa0  -     　"
CHUNK = re.compile(f" ?[^{WS}]+|[{WS}]+(?![^{WS}])|[{WS}]+")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, reversed."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class BytePairs:
    """A byte-level BPE vocabulary, read from a tokenizer file."""

    def __init__(self, path: str, cache: int = 300_000) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.byte_id = [0] * 256
        for ch, b in alphabet.items():
            self.byte_id[b] = vocab[ch]
        # A pair's two ids make one integer key; a rank gives the merged id.
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[a] << 32 | vocab[b]] = rank
            self.made.append(vocab[a + b])
        self.piece = {i: bytes(alphabet[ch] for ch in s) for s, i in vocab.items()}
        self.piece |= {i: s.encode() for s, i in self.special.items()}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.limit = cache

    def merged(self, symbols: list[int]) -> list[int]:
        """Apply the merges in order of rank, the leftmost first among equals."""
        n, rank_of, made = len(symbols), self.rank.get, self.made
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue, left = [], symbols[0] if n else 0
        for i in range(1, n):
            right = symbols[i]
            if (r := rank_of(left << 32 | right)) is not None:
                queue.append((r, i - 1))
            left = right
        heapify(queue)
        while queue:
            r, i = heappop(queue)
            j = after[i]
            if j >= n or symbols[i] < 0 or rank_of(symbols[i] << 32 | symbols[j]) != r:
                continue  # stale
            symbols[i] = new = made[r]
            symbols[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of(new << 32 | symbols[k])) is not None:
                    heappush(queue, (r, i))
            if (h := before[i]) >= 0 and (r := rank_of(symbols[h] << 32 | new)) is not None:
                heappush(queue, (r, h))
        return [s for s in symbols if s >= 0]

    def _word(self, word: str) -> bytes:
        out = self.words.get(word)
        if out is None:
            ids = self.merged([self.byte_id[b] for b in word.encode()])
            out = struct.pack(f"<{len(ids)}I", *ids)
            if len(word) <= 64:
                if len(self.words) >= self.limit:
                    self.words.clear()
                self.words[word] = out
        return out

    def _chunk(self, chunk: str) -> bytes:
        if (out := self.old.get(chunk)) is None:
            if chunk.isalpha() or (chunk[0] == " " and chunk[1:].isalpha()):
                out = self._word(chunk)
            else:
                out = b"".join(map(self._word, PRE_TOKEN.findall(chunk)))
        if len(chunk) <= 64:
            if len(self.young) >= self.limit:  # what was not used since the last turn goes
                self.old, self.young = self.young, {}
            self.young[chunk] = out
        return out

    def _plain(self, text: str) -> bytes:
        cache, miss = self.young.get, self._chunk
        return b"".join([cache(c) or miss(c) for c in CHUNK.findall(text)])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.cut_special is None or not any(s in text for s in self.special):
            return self._plain(text)
        return b"".join(struct.pack("<I", self.special[x]) if x in self.special else self._plain(x) for x in self.cut_special.split(text))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.piece.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, ids (binary, little-endian u32), decoded."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = BytePairs(path)
        for batch in batches:
            ids = [bpe.encode(t) for t in strings(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array([bpe.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(work, "doc_id long, ids binary, decoded string")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """As ``encode_decode``, hashed where the ids are made, so that they needn't leave the worker."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = BytePairs(path)
        for batch in batches:
            n, a, b = [], [], []
            for t in strings(batch.column(1)):
                ids = bpe.encode(t)
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
