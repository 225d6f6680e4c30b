"""Removal of byte spans that occur earlier in the collection.

The order of all suffixes of a collection and their common prefixes tell which
100-byte strings repeat: suffixes that share 100 bytes stand side by side. Sorting a
corpus' suffixes as a whole does not distribute, so the collection is first divided
by anchors (see ``_spans``): equal strings always meet under one anchor hash, runs that
are equal as a whole are settled by hash, and only the short segments around an anchor
that also occurs with another surrounding go on to the suffix stage.

There the Burrows-Wheeler transform of a batch of segments and its common-prefix array
are built column by column (Bauer, Cox and Rosone, 2013; with common prefixes: Cox,
Garofalo, Rosone and Sciortino, 2016): round j inserts the suffix of length j of every
segment, one symbol each, into the order of the round before. All positions follow
from one stable counting sort of the transform, which is read and written
sequentially; a common prefix is one more than the least one between two equal
symbols of the transform. Spark's sorted shuffle files take the place of the
algorithm's external files: a batch is a stretch of whole anchor groups, so memory is
bounded by a batch. An anchor group larger than a batch is divided further into
its single windows, keyed by their own hash, and equal windows collapse to their first
as they are read.

Defined results: a null text is empty; a null doc_id sorts before every other and
comes back as null; rows that repeat a doc_id with the same text are one document and
each get its result, with another text they are ordered by a hash of the text; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queryloom.llm import _spans as S
from queryloom.llm._common import checkpoint, mix, outer_id, shuffle_width

WIDTH, GRAM = 100, 28
#: Segments of one anchor up to which it stays one group, and those that make a batch.
GROUP, BATCH = 2_000, 1_500
#: Anchor offsets to a part of a segment.
STEP = 18
SEGMENT = "key long, text binary, doc long, tag long, pos long"
Placed = tuple[bytes, int, int, int]  # text, doc, tag, pos
BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def symbolize(texts: list[bytes]) -> Iterator[np.ndarray]:
    for t in texts:
        yield BYTES[np.frombuffer(t, np.uint8)]


def collection_order(strings: list[bytes], cap: int = 254) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of all strings in order: string number, suffix length, common prefix with the one before (capped).

    Column-wise construction: after round j all suffixes of at most j symbols are in
    order. End marks sort before every byte and differ by string, so ties stand in the
    order of the strings.
    """
    m = len(strings)
    lengths = np.array([len(s) for s in strings], np.int32)
    # One mark (0) stands before each string and ends the round of its extensions.
    flat = np.frombuffer(b"\0" + b"\0".join(strings), np.uint8)
    begin = (np.cumsum(lengths + 1) - lengths).astype(np.int32)
    inside = np.ones(len(flat), bool)
    inside[begin - 1] = False
    used = np.bincount(flat[inside], minlength=256) > 0
    code = np.where(used, np.cumsum(used), 0)
    text = code.astype(np.uint8 if code.max(initial=0) < 256 else np.uint16)[flat]
    text[begin - 1] = 0
    ends = begin + lengths
    at, common = ends, np.zeros(m, np.uint8)  # where each suffix begins
    top = np.uint8(min(cap, 254))
    bwt = text[at - 1]
    for _ in range(int(lengths.max(initial=0))):
        rows = np.flatnonzero(bwt).astype(np.int32)
        order = rows[np.argsort(bwt[rows], kind="stable")]
        symbol = bwt[order]
        same = np.flatnonzero(symbol[1:] == symbol[:-1])
        # Least common prefix on the way from the previous row with this symbol.
        fresh = np.zeros(len(order), np.uint8)
        fresh[same + 1] = np.minimum(_range_min(common, order[same] + 1, order[same + 1]), top) + 1
        at = np.concatenate((ends, at[order] - 1))
        common = np.concatenate((np.zeros(m, np.uint8), fresh))
        bwt = text[at - 1]
    ids = np.searchsorted(begin, at, side="right") - 1
    empty = ends == begin  # an empty string shares its place with the next one's mark
    if empty.any():
        ids[:m] = np.arange(m)
    return ids, ends[ids] - at, common


LEVEL = (np.frexp(np.arange(1 << 16, dtype=np.float32))[1] - 1).clip(0).astype(np.uint8)


def _range_min(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Least of values[first..last] for many ranges, by a table of powers of two."""
    span = last - first + 1
    level = LEVEL[np.minimum(span, 65535)]
    far = np.flatnonzero(span > 65535)
    level[far] = np.frexp(span[far].astype(np.float64))[1] - 1
    order = np.argsort(level, kind="stable")
    first, last = first[order], last[order]
    found, row, done = np.empty(len(order), values.dtype), values, 0
    for k, n in enumerate(np.bincount(level)):
        if k:
            row = np.minimum(row[: -(1 << k - 1)], row[1 << k - 1 :])
        at = slice(done, done + n)
        found[at] = np.minimum(row[first[at]], row[last[at] - ((1 << k) - 1)])
        done += n
    out = np.empty_like(found)
    out[order] = found
    return out


def divide(group: list[Placed], width: int) -> tuple[list[list[Placed]], list[Placed]]:
    """Segments of one anchor to sets that may share a window, and what an equal earlier one settles.

    The windows of a segment are divided by the anchor's offset in them, ``STEP`` offsets
    to a part; the windows of a part have a core in common. Parts with different
    cores share no window, and equal parts need no sorting.
    """
    by_core: dict[tuple[int, bytes], dict[bytes, tuple[int, int, int]]] = {}
    settled = []
    for text, doc, tag, pos in group:
        anchor, n = pos >> 8 & 0xFF, pos & 0xFF
        for low in range((anchor - n + 1) // STEP * STEP, anchor + 1, STEP):
            i, j = max(0, anchor - low - STEP + 1), min(n - 1, anchor - low)
            core = text[anchor - low : anchor - low + width - STEP + 1]
            part = text[i : j + width]
            new = (doc, tag, pos + (i << 16))
            known = by_core.setdefault((low, core), {})
            old = known.setdefault(part, new)
            if old is not new:
                early, late = (old, new) if (*old[:2], old[2] >> 16) <= (*new[:2], new[2] >> 16) else (new, old)
                known[part] = early
                settled.append((part, *late))
    return [[(t, *at) for t, at in known.items()] for known in by_core.values() if len(known) > 1], settled


def repeated(segments: list[Placed], width: int) -> tuple[list[int], list[int], list[int], list[int]]:
    """doc, tag, pos, size of repeated stretches in segments, each distinct text once."""
    ids, size, common = collection_order([s[0] for s in segments], width)
    doc = np.array([s[1] for s in segments])
    tag = np.array([s[2] for s in segments])
    pos = np.array([s[3] for s in segments])
    # Blocks of suffixes that share width symbols; the earliest of a block stays.
    at = np.flatnonzero((common >= width) | (np.append(common[1:], 0) >= width))
    if not len(at):
        return [], [], [], []
    block = np.cumsum(common[at] < width)
    who, start = ids[at], np.array([len(s[0]) for s in segments])[ids[at]] - size[at]
    order = np.lexsort(((pos[who] >> 16) + start, tag[who], doc[who], block))
    again = np.zeros(len(order), bool)
    again[1:] = block[order][1:] == block[order][:-1]
    hit = order[again]
    d, s, z = S.merged(who[hit], start[hit], np.full(len(hit), width))
    return doc[d].tolist(), tag[d].tolist(), (((pos[d] >> 16) + s) << 16).tolist(), z.tolist()


def suffix_stage(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """SEGMENT rows sorted by key, text, doc, tag, pos to ranges (doc, tag, pos, size)."""
    held: list[Placed] = []  # sets that are complete
    group: list[Placed] = []  # distinct texts of the open anchor
    open_key = None
    out: tuple[list[int], ...] = ([], [], [], [])  # doc, tag, pos, size

    def close(last: bool) -> None:
        if len(group) > 1:
            sets, settled = divide(group, width)
            for part, *at in settled:
                for column, x in zip(out, (*at, len(part))):
                    column.append(x)
            for x in sets:
                held.extend(x)
        group.clear()
        if held and (last or len(held) >= BATCH):
            for column, x in zip(out, repeated(held, width)):
                column.extend(x)
            held.clear()

    def rows() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if k == 3 else pa.int64()) for k, x in enumerate(out)], ["doc", "tag", "pos", "size"])
        for x in out:
            x.clear()
        return batch

    for batch in batches:
        for key, text, *at in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if key != open_key:
                close(last=False)
                open_key = key
            if group and group[-1] == (text, *at):
                continue  # of a repeated row
            if group and group[-1][0] == text:
                for column, x in zip(out, (*at, len(text))):
                    column.append(x)
            else:
                group.append((text, *at))
        yield rows()
    close(last=True)
    yield rows()


def segments(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows of at_text with candidate marks to SEGMENT; those of hot anchors (size -1) window by window."""
    kinds, names = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()], ["key", "text", "doc", "tag", "pos"]
    for batch in batches:
        column = lambda c: batch.column(batch.schema.get_field_index(c)).to_pylist()  # noqa: B023, E731
        out: list[tuple] = []
        for text, doc, tag, marks in zip(column("text"), column("doc"), column("tag"), column("marks")):
            for mark in marks:
                start, n = mark["pos"] >> 16, mark["pos"] & 0xFF
                if mark["size"] < 0:
                    s = BYTES[np.frombuffer(text[start : start + n + width - 1], np.uint8)]
                    at = np.arange(n)
                    keys = mix(S.KEY.ranges(S.KEY.prefix(s), at, at + width)).view(np.int64).tolist()
                    out += ((key, text[k : k + width], doc, tag, k << 16 | 1) for k, key in enumerate(keys, start))
                else:
                    out.append((mark["key"], text[start : start + n + width - 1], doc, tag, mark["pos"]))
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of at_text to doc, n_bytes, n_removed, n_spans, kept."""
    for batch in batches:
        n_bytes, n_removed, n_spans, kept = [], [], [], []
        for t, (starts, sizes) in zip(batch.column(batch.schema.get_field_index("text")).to_pylist(), S.mark_arrays(batch)):
            n_bytes.append(len(t))
            if len(starts):
                gone = S.covered(len(t), starts, sizes)
                n_removed.append(int(gone.sum()))
                n_spans.append(int(np.diff(gone.astype(np.int8), prepend=0).clip(0).sum()))
                t = np.frombuffer(t, np.uint8)[~gone].tobytes()
            else:
                n_removed.append(0)
                n_spans.append(0)
            kept.append(t)
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc")), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())], ["doc", "n_bytes", "n_removed", "n_spans", "kept"])


def repeated_ranges(prep: DataFrame, shape: S.Shape) -> DataFrame:
    """doc, tag, pos, size: byte ranges to remove; they may overlap."""
    rows = prep.mapInArrow(lambda it: S.scan(it, shape, symbolize), S.RUN_SCHEMA)
    found = checkpoint(S.settled(rows, shape))
    meet = found.where("size = 0")
    hot = meet.groupBy("key").count().where(F.col("count") > GROUP).select("key", F.lit(-1).alias("hot"))
    marked = meet.join(hot, "key", "left").select("key", "doc", "tag", "pos", F.coalesce("hot", F.lit(0)).alias("size"))
    of_doc = marked.groupBy("doc", "tag").agg(F.collect_list(F.struct("pos", "size", "key")).alias("marks"))
    cut_out = prep.join(of_doc, ["doc", "tag"]).mapInArrow(lambda it: segments(it, shape.width), SEGMENT)
    sorted_rows = cut_out.repartition(shuffle_width(prep.sparkSession), "key").sortWithinPartitions("key", "text", "doc", "tag", "pos")
    late = sorted_rows.mapInArrow(lambda it: suffix_stage(it, shape.width), "doc long, tag long, pos long, size int")
    return found.where("size > 0").select("doc", "tag", "pos", "size").unionByName(late)


def remove_repeated(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept (bytes; they need not be whole characters)."""
    shape = S.Shape(width, gram, inside=True)
    prep = S.prepared(docs, id_col, text_col)
    done = S.at_text(repeated_ranges(prep, shape), prep, "left").mapInArrow(cut, "doc long, n_bytes long, n_removed long, n_spans long, kept binary")
    return done.select(outer_id("doc").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")


def digest(docs: DataFrame) -> DataFrame:
    out = remove_repeated(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
