"""Packing of tokenized documents into fixed sequences: concatenate and cut.

The documents of all partitions, in scan order, are one stream of ids, each document
closed by an end id. Two passes: the first tokenizes, keeps the ids compressed in the
shared checkpoint folder and sums the tokens of each partition; prefix sums of these
totals (one number per partition, all the driver ever sees) give every partition its
place in the stream. The second pass walks the kept partitions and cuts at multiples
of the sequence length; a document across a boundary leaves a piece on either side.
A window that two partitions share leaves a boundary record in each. ``pack`` lists the
pieces, whose sequence and offset are known without a meeting; ``sequences`` joins the
boundary records, and nothing else, to whole windows. All sequences but the last are
full, so there is no padding but there.

Defined results: a null text is empty (only the end id); a long text is any number of
pieces; an empty table gives an empty result; a null doc_id stays null; repeated rows
are packed each; other columns are ignored and may have any name.
"""

from __future__ import annotations

import json
import os
import string
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queryloom.llm._common import checkpoint, lean
from queryloom.llm.bpe import byte_alphabet

LENGTH, END = 2048, 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


class PairTable:
    """Merge ranks by pair of ids, looked up for whole arrays (open addressing)."""

    BITS, NONE = 20, np.int64(1) << 40

    def __init__(self, pairs: np.ndarray, made: np.ndarray) -> None:
        self.made = made
        self.keys = np.full(1 << self.BITS, -1, np.int64)
        self.ranks = np.full(1 << self.BITS, self.NONE, np.int64)
        slot = self._slot(pairs)
        for key, at, rank in zip(pairs.tolist(), slot.tolist(), range(len(pairs))):
            while self.keys[at] >= 0:
                at = (at + 1) & ((1 << self.BITS) - 1)
            self.keys[at], self.ranks[at] = key, rank

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pairs = left << 32 | right
        slot, out = self._slot(pairs), np.full(len(pairs), self.NONE)
        todo = np.arange(len(pairs))
        while len(todo):
            found = self.keys[slot[todo]]
            hit = found == pairs[todo]
            out[todo[hit]] = self.ranks[slot[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
            slot[todo] = (slot[todo] + 1) & ((1 << self.BITS) - 1)
        return out

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        """BPE of many words at once: each round merges the first pair of lowest rank in every word."""
        done: list[bytes] = [b""] * len(lengths)
        word = np.flatnonzero(lengths)
        lengths = lengths[word]
        starts = np.cumsum(lengths) - lengths
        inner = np.ones(len(symbols), bool)
        inner[starts + lengths - 1] = False
        rank = np.full(len(symbols), self.NONE)
        at = np.flatnonzero(inner)
        rank[at] = self.rank(symbols[at], symbols[at + 1])
        while len(word):
            # The low bits make the leftmost of equal ranks the least; a rank fits 40 bits.
            least = np.minimum.reduceat(rank * (1 << 22) + (np.arange(len(rank)) - np.repeat(starts, lengths)), starts)
            ended = least >= self.NONE << 22
            if ended.any():
                flat = symbols.astype("<u4").tobytes()
                for w, s, n in zip(word[ended].tolist(), starts[ended].tolist(), lengths[ended].tolist()):
                    done[w] = flat[4 * s : 4 * (s + n)]
                stays = np.repeat(~ended, lengths)
                symbols, rank = symbols[stays], rank[stays]
                word, lengths, least = word[~ended], lengths[~ended], least[~ended]
                starts = np.cumsum(lengths) - lengths
                if not len(word):
                    break
            i = starts + (least & ((1 << 22) - 1))
            symbols[i] = self.made[least >> 22]
            stays = np.ones(len(symbols), bool)
            stays[i + 1] = False
            symbols, rank = symbols[stays], rank[stays]
            i -= np.arange(len(word))
            lengths = lengths - 1
            starts = np.cumsum(lengths) - lengths
            end = starts + lengths - 1
            rank[end] = self.NONE
            for at in (i[i < end], (i - 1)[i > starts]):
                rank[at] = self.rank(symbols[at], symbols[at + 1])
        return done


SEPARATOR, LETTER, DIGIT, SIGN, OTHER = range(5)
KIND = np.full(256, OTHER, np.uint8)  # of a byte of UTF-8
KIND[[9, 10, 13, 32]] = SEPARATOR
KIND[list(string.ascii_letters.encode())] = LETTER
KIND[list(string.digits.encode())] = DIGIT
KIND[list(set(string.punctuation.encode()) - set(b"<'"))] = SIGN
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def pieces(data: np.ndarray, starts: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Texts that begin at ``starts`` in ``data`` (UTF-8): the pieces to encode one by one, which are rough, and of each text how many.

    A text is cut into chunks at spaces, tabs and line ends. A chunk of nothing but letters of
    ASCII and Latin-1, ASCII digits and signs without < and ' is cut into its pre-tokens, in
    lower case; any other chunk is one piece as it stands, a rough one.
    """
    kind, low = KIND[data], LOWER[data]
    latin = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7))  # all of U+00C0 to U+00FF but two signs
    kind[latin] = kind[latin + 1] = LETTER
    low[latin[data[latin + 1] <= 0x9E] + 1] += 0x20
    inside = kind != SEPARATOR
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = starts[starts < len(data)]
    begins[first] = inside[first]
    rough = np.zeros(len(data), bool)
    if (other := np.flatnonzero(kind == OTHER)).size:
        chunk = np.cumsum(begins, dtype=np.int32)
        of = np.zeros(int(chunk[-1]) + 1, bool)
        of[chunk[other]] = True
        rough = of[chunk] & inside
    begins[1:] |= inside[1:] & ~rough[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT))
    at = np.flatnonzero(begins)
    held = np.where(rough, data, low)[inside]
    ends = np.append(np.flatnonzero(begins[inside]), len(held)).astype(np.int32)
    found = pa.StringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(held))
    return found, rough[at], np.diff(np.searchsorted(at, starts), append=len(at))


@lru_cache(maxsize=1)
def merges(path: str, changed: int) -> tuple[PairTable, np.ndarray, np.ndarray]:
    """Of a tokenizer's file: merge ranks, ids of bytes inside and at the end of a word; kept from task to task."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, suffix = model["vocab"], model["end_of_word_suffix"]
    pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
    table = PairTable(np.array([vocab[a] << 32 | vocab[b] for a, b in pairs]), np.array([vocab[a + b] for a, b in pairs]))
    inside, final = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for ch, b in byte_alphabet().items():
        inside[b], final[b] = vocab[ch], vocab[ch + suffix]
    return table, inside, final


class WordIds:
    """Ids of texts by a lower-casing word BPE (end-of-word suffix), kept by piece.

    White space is dropped by this kind of tokenizer, so a text is cut at spaces, tabs
    and line ends, where that is plain into pre-tokens, and each distinct piece is encoded
    once; new ones are encoded many at a time. What the short way doesn't cover (other white
    space, special tokens, decomposed or unusual letters) is left to the tokenizers library,
    chunk by chunk.
    """

    PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    ODD = regex.compile(r"[\s\p{M}<Σİ]")
    LONG = 1_000

    def __init__(self, path: str, cache: int = 300_000) -> None:
        self.path = path
        self.table, self.inside, self.final = merges(path, os.stat(path).st_mtime_ns)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.limit = cache

    @cached_property
    def tokenizer(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path)
        found.no_truncation()
        found.no_padding()
        return found

    def _by_library(self, chunk: str) -> bytes:
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn_words(self, new: list[str], into: dict[str, bytes]) -> None:
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            raw = [w.encode() for w in part]
            lengths = np.array([len(w) for w in raw])
            codes = np.frombuffer(b"".join(raw), np.uint8)
            symbols = self.inside[codes]
            last = np.cumsum(lengths) - 1
            symbols[last] = self.final[codes[last]]
            into.update(zip(part, self.table.merge(symbols, lengths)))

    def _learn_rough(self, chunks: list[str]) -> None:
        split: dict[str, list[str]] = {}
        for chunk in chunks:
            if self.ODD.search(chunk) or not unicodedata.is_normalized("NFC", chunk) or len(chunk) > self.LONG:
                self.young[chunk] = self._by_library(chunk)
            else:
                split[chunk] = self.PRE_TOKEN.findall(chunk.lower())
        if split:
            needed = set().union(*split.values())
            if len(self.words) > self.limit:
                self.words = {}
            if new := [w for w in needed if w not in self.words]:
                self._learn_words(new, self.words)
            known = self.words
            for chunk, words in split.items():
                self.young[chunk] = known[words[0]] if len(words) == 1 else b"".join([known[w] for w in words])

    def _known(self, found: list[str], rough: np.ndarray) -> list[bytes]:
        """Ids of each of the distinct pieces."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        new, rest = [], []
        for k, piece in enumerate(found):
            if piece not in young:
                if piece in old:
                    young[piece] = old[piece]
                elif rough[k]:
                    rest.append(piece)
                elif len(piece) > self.LONG:
                    young[piece] = self._by_library(piece)
                else:
                    new.append(piece)
        if new:
            self._learn_words(new, young)
        if rest:
            self._learn_rough(rest)
        return [young[piece] for piece in found]

    def encode_column(self, column: pa.Array, most: int = 1 << 22) -> Iterator[bytes]:
        """Little-endian u32 ids of each text of a string column, null as the empty text; some ``most`` bytes of text at a time."""
        column = column.fill_null("")
        _, offsets, data = column.buffers()
        kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
        ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
        data, a = np.frombuffer(data or b"", np.uint8), 0
        while a < len(column):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + most, "right")) - 1)
            found, rough, n = pieces(data[ends[a] : ends[b]], ends[a:b] - ends[a])
            coded = found.dictionary_encode()
            which = coded.indices.to_numpy()
            is_rough = np.zeros(len(coded.dictionary), bool)
            is_rough[which] = rough
            known = self._known(coded.dictionary.to_pylist(), is_rough)
            pool, size = np.frombuffer(b"".join(known), "<u4"), np.array([len(x) // 4 for x in known], np.int64)
            long = size[which]
            upto = np.cumsum(long)
            ids = pool[np.repeat((np.cumsum(size) - size)[which] - (upto - long), long) + np.arange(long.sum())].tobytes()
            stop = 4 * np.append(0, upto)[np.cumsum(n)]
            begin = 0
            for end in stop.tolist():
                yield ids[begin:end]
                begin = end
            a = b

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian u32 ids of each text."""
        return list(self.encode_column(pa.array(texts, pa.string())))


def tokenized(docs: DataFrame, path: str, end: int, id_col: str, text_col: str) -> tuple[DataFrame, dict[int, int]]:
    """First pass: part, doc_id, n, ids (compressed) in the shared folder, and where each part begins in the stream."""

    @lean
    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, squeeze = WordIds(path), zstandard.ZstdCompressor(level=1)
        close = np.array([end], "<u4").tobytes()
        for batch in batches:
            n, ids = [], []
            for x in words.encode_column(batch.column(2)):
                n.append(len(x) // 4 + 1)
                ids.append(squeeze.compress(x + close))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], ["part", "doc_id", "n", "ids"])

    tokens = docs.select(F.spark_partition_id().alias("part"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kept = checkpoint(tokens.mapInArrow(tokenize, "part int, doc_id long, n long, ids binary"))
    totals = sorted((r["part"], r["n"]) for r in kept.groupBy("part").agg(F.sum("n").alias("n")).collect())
    return kept, dict(zip((p for p, _ in totals), accumulate((n for _, n in totals), initial=0)))


def cut(batches: Iterator[pa.RecordBatch], base: dict[int, int], length: int) -> Iterator[list[tuple]]:
    """Second pass: (doc_id, start, size, crc32, doc_tokens, sequence, offset, ids) of each piece, in order."""
    at, part, expand = 0, None, zstandard.ZstdDecompressor()
    for batch in batches:
        rows: list[tuple] = []
        for p, doc, n, packed in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if p != part:
                part, at = p, base[p]
            ids, start = expand.decompress(packed, max_output_size=4 * n), 0
            while start < n:
                size = min(n - start, length - at % length)
                piece = ids[4 * start : 4 * (start + size)]
                rows.append((doc, start, size, zlib.crc32(piece), n, at // length, at % length, piece))
                start, at = start + size, at + size
        yield rows


def pack(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece, with its ids (little-endian u32): see PIECES."""
    kept, base = tokenized(docs, path, end, id_col, text_col)

    @lean
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
        for rows in cut(batches, base, length):
            columns = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == 7 else pa.int64()) for k, c in enumerate(columns)], names)

    return kept.mapInArrow(work, PIECES)


def sequences(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per sequence: sequence_id, length, ids (little-endian u32, without padding).

    A window that lies in one partition is complete there. Of a window across a border
    each partition has a boundary record, and only these (at most two for a partition)
    are exchanged and joined, in the order of their offsets.
    """
    kept, base = tokenized(docs, path, end, id_col, text_col)

    @lean
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list[tuple[int, int, bytes]] = []  # the open window's pieces: sequence, offset, ids

        def row() -> tuple[int, int, bytes]:
            return now[0][0], now[0][1], b"".join(x for _, _, x in now)

        for rows in cut(batches, base, length):
            out = []
            for *_, sequence, offset, ids in rows:
                if now and now[-1][0] != sequence:
                    out.append(row())
                    now = []
                now.append((sequence, offset, ids))
            if out:
                yield windows(out)
        if now:
            yield windows([row()])

    def windows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        a, b, c = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.binary())], ["sequence_id", "offset", "ids"])

    found = kept.mapInArrow(work, "sequence_id long, offset long, ids binary")
    whole = F.octet_length("ids") == 4 * length
    records = found.where(~whole).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("r"))
    joined = records.select("sequence_id", F.expr("aggregate(r, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"))
    return found.where(whole).select("sequence_id", "ids").unionByName(joined).select("sequence_id", (F.octet_length("ids") / 4).cast("long").alias("length"), "ids")


def digest(docs: DataFrame, path: str) -> DataFrame:
    return pack(docs, path).drop("ids")
