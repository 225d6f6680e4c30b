"""Removal of word spans that an earlier document already has.

Method: a De Bruijn graph over words, compacted. The edges are the windows of
``width`` consecutive words. Writing every edge out costs more than the corpus, so
nonbranching paths are compacted first, at the source: consecutive edges that share
an anchor (see ``_spans``) make one path, and Spark brings equal paths and paths that
meet at an anchor together by its hash. A path that nobody else meets is unique, one
that only equals others is settled whole, and only where different paths meet (the
graph branches) are single edges compared, fetched again by their source coordinates.

Defined results: a null text has no words; a null doc_id sorts before every other and
comes back as null; rows that repeat a doc_id with the same text are one document and
each get its result, with another text they are documents of equal id, which do not
count as earlier than each other; an empty table gives an empty result; columns other
than the two named are ignored and may have any name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queryloom.llm import _spans as S
from queryloom.llm._common import checkpoint, lean, mix, outer_id

WIDTH, GRAM = 13, 4
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class WordHash(dict):
    """Word to 64-bit hash; what no longer fits the cache is hashed anew."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 500_000:
            self[word] = h
        return h


def symbolizer():
    of = WordHash().__getitem__

    def symbols(texts: list[bytes]) -> Iterator[np.ndarray]:
        for t in texts:
            words = t.split()  # bytes split at the space and \t to \r only
            yield np.fromiter(map(of, words), np.uint64, len(words))

    return symbols


@lean
def edges(batches: Iterator[pa.RecordBatch], shape: S.Shape) -> Iterator[pa.RecordBatch]:
    """The single windows of candidate paths, as RUN_SCHEMA; of equal ones of a document and of a batch the first."""
    symbols = symbolizer()
    for batch in batches:
        out = []
        texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
        docs = batch.column(batch.schema.get_field_index("doc")).to_numpy()
        tags = batch.column(batch.schema.get_field_index("tag")).to_numpy()
        for doc, tag, (starts, ns), s in zip(docs, tags, S.mark_arrays(batch), symbols(texts)):
            # A document of any length: only the stretch around each run is hashed.
            spans = np.flatnonzero(S.covered(len(s), starts, ns))
            if not len(spans):
                continue
            for at in range(0, len(spans), S.CHUNK >> 1):
                w = spans[at : at + (S.CHUNK >> 1)]
                low = int(w[0])
                part = s[low : int(w[-1]) + shape.width]
                for lo in range(0, len(part) - shape.width + 1, S.CHUNK):
                    piece = part[lo : lo + S.CHUNK + shape.width - 1]
                    x = w[(w >= low + lo) & (w < low + lo + S.CHUNK)] - low - lo
                    if len(x):
                        a = mix(S.KEY.ranges(S.KEY.prefix(piece), x, x + shape.width))
                        b = mix(S.SEG.ranges(S.SEG.prefix(piece), x, x + shape.width))
                        out.append((a, b, np.full(len(x), doc), np.full(len(x), tag), S.pack(x + low + lo, np.ones(len(x), np.int64))))
        if out:
            a, b, doc, tag, pos = (np.concatenate([x[i] for x in out]) for i in range(5))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(doc), pa.array(tag), pa.array(pos), pa.array(np.zeros(len(a), np.int32))], ["key", "seg", "doc", "tag", "pos", "size"])


def kept_text(text: bytes, gone: np.ndarray) -> bytes:
    """The text without the words marked gone: kept stretches as they are, one space between them."""
    keep = np.flatnonzero(~gone)
    if not len(keep):
        return b""
    words = [m.span() for m in WORD.finditer(text)]
    cuts = np.flatnonzero(np.diff(keep) > 1)
    return b" ".join(text[words[keep[i]][0] : words[keep[j]][1]] for i, j in zip(np.append(0, cuts + 1), np.append(cuts, len(keep) - 1)))


@lean
def cut(batches: Iterator[pa.RecordBatch], digest: bool) -> Iterator[pa.RecordBatch]:
    """Rows of at_text to their row, counts and kept text (with ``digest``, the hash of the kept words in place of the text)."""
    for batch in batches:
        n_words, n_removed, kept = [], [], []
        for t, (starts, sizes) in zip(batch.column(batch.schema.get_field_index("text")).to_pylist(), S.mark_arrays(batch)):
            words = t.split()
            gone = S.covered(len(words), starts, sizes) if len(starts) else None
            n_words.append(len(words))
            n_removed.append(0 if gone is None else int(gone.sum()))
            if digest:
                kept.append(hashlib.sha256(b" ".join(words if gone is None else compress(words, ~gone))).hexdigest())
            else:
                kept.append(t if gone is None else kept_text(t, gone))
        name = "doc" if digest else "row"
        first = batch.column(batch.schema.get_field_index(name))
        yield pa.RecordBatch.from_arrays([first, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string() if digest else pa.binary())], [name, "n_words", "n_removed", "kept"])


def repeated_ranges(prep: DataFrame, shape: S.Shape) -> DataFrame:
    """doc, tag, pos, size: word ranges to remove; they may overlap."""
    rows = prep.mapInArrow(lambda it: S.scan(it, shape, symbolizer()), S.RUN_SCHEMA)
    found = checkpoint(S.settled(rows, shape))
    meet = S.at_text(found.where("size = 0"), prep, "inner")
    single = meet.mapInArrow(lambda it: edges(it, shape), S.RUN_SCHEMA)
    return found.where("size > 0").select("doc", "tag", "pos", "size").unionByName(S.settled(single, shape, last=True).select("doc", "tag", "pos", "size"))


def _done(docs: DataFrame, shape: S.Shape, id_col: str, text_col: str, digest: bool) -> DataFrame:
    prep = S.prepared(docs, id_col, text_col)
    ranges = repeated_ranges(prep, shape)
    if digest:  # over the same columns as the search for ranges, so that the texts are exchanged once
        return S.at_text(ranges, prep, "left").mapInArrow(lambda it: cut(it, True), "doc long, n_words long, n_removed long, kept string")
    rows = S.at_text(ranges, S.prepared(docs, id_col, text_col, row=True), "left")
    return rows.mapInArrow(lambda it: cut(it, False), f"row {rows.schema['row'].dataType.simpleString()}, n_words long, n_removed long, kept binary")


def remove_repeated(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated words cut out of the text; a text without any stays as it is."""
    done = _done(docs, S.Shape(width, gram, inside=False), id_col, text_col, digest=False)
    text = F.when(F.col("row")[text_col].isNotNull() | (F.col("n_removed") > 0), F.col("kept").cast("string"))
    return done.select(*(text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))


def digest(docs: DataFrame) -> DataFrame:
    done = _done(docs.select("doc_id", "text"), S.Shape(WIDTH, GRAM, inside=False), "doc_id", "text", digest=True)
    return done.select(outer_id("doc").alias("doc_id"), "n_words", "n_removed", F.col("kept").alias("kept_sha256"))
