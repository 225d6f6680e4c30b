"""Repeated windows of L symbols, found through anchored runs.

Every window of ``width`` symbols has an anchor: of the ``gram``-symbol grams in it,
the leftmost one with the smallest hash. Equal windows have equal anchors at equal
offsets, so consecutive windows with one anchor form a *run* and two equal windows
always lie in runs of one key, the hash of the anchor's gram. A run is the unit of
exchange: some twenty symbols long on average, it costs one row in place of one for
each window, and runs that are equal as a whole (most of what copies share) need
no look at their text at all.

``scan`` makes the rows of runs, ``settle`` reads them sorted by key and finds which
are settled by an equal earlier run and which meet a different run with their key
and hence need to be compared window by window (``candidates``).

Rows: ``doc`` and ``tag`` name a document (the tag tells apart different texts filed under
one id, see ``row_tag``); ``pos`` packs 32 bits of the start, 8 bits of the anchor's
offset in the run and 8 bits of the number of windows. ``size`` is 0 for a run, else the
number of symbols to remove from ``start``.

Hot runs. A passage that a third of all documents hold would send as many rows to one
task. So each scanning task remembers the runs that it has met repeatedly (``Known``) with
the first place of each, and settles later ones on the spot; a hot run leaves a task a
few times only, whatever its number. What is forgotten there costs rows, not results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queryloom.llm._common import inner_id, lean, mix, row_tag, shuffle_width

#: Symbols handled at once; it must fit the low bits that hold a gram's place.
CHUNK_BITS = 20
CHUNK = 1 << CHUNK_BITS
U = np.uint64
RUN_SCHEMA = "key long, seg long, doc long, tag long, pos long, size int"
FOUND_SCHEMA = "key long, doc long, tag long, pos long, size int"
#: Repeated runs that a scanning task remembers.
KNOWN = 1 << 17


@dataclass(frozen=True)
class Shape:
    """What a window is: its width, the anchor gram, and whether a repeat inside one document counts."""

    width: int
    gram: int
    inside: bool

    def __post_init__(self) -> None:
        if not 0 < self.gram <= self.width or self.width - self.gram > 120:
            raise ValueError("0 < gram <= width <= gram + 120 is needed")


class Rolling:
    """Hashes of any range of a symbol array, by prefix sums of a polynomial modulo 2**64."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = U(base | 1), U(pow(base | 1, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            with np.errstate(over="ignore"):
                self.up = np.multiply.accumulate(np.concatenate(([U(1)], np.full(n - 1, self.base))))
                self.down = np.multiply.accumulate(np.concatenate(([U(1)], np.full(n - 1, self.inverse))))

    def prefix(self, symbols: np.ndarray) -> np.ndarray:
        self._powers(len(symbols) + 1)
        out = np.zeros(len(symbols) + 1, np.uint64)
        np.multiply(symbols, self.up[: len(symbols)], out=out[1:])
        return np.cumsum(out, out=out)

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (prefix[end] - prefix[start]) * self.down[start]


KEY, SEG = Rolling(0x9E3779B97F4A7C15), Rolling(0xD1342543DE82EF95)


def pack(start: np.ndarray, n: np.ndarray, anchor: np.ndarray | int = 0) -> np.ndarray:
    return (start.astype(np.int64) << 16) | (anchor << 8) | n.astype(np.int64)


def start_of(pos: np.ndarray) -> np.ndarray:
    return pos >> 16


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def pieces(ids: Iterable[int], tags: Iterable[int], symbols: Iterable[np.ndarray], width: int):
    """Chunks of at most CHUNK symbols: (doc, tag, offset, symbols) lists.

    A longer document is cut with an overlap of width - 1, so each window is in one piece.
    """
    held: list[tuple[int, int, int, np.ndarray]] = []
    n = 0
    for doc, tag, s in zip(ids, tags, symbols):
        for at in range(0, max(1, len(s) - width + 1), CHUNK - width + 1):
            piece = s[at : at + CHUNK]
            if len(piece) < width:
                continue
            if n + len(piece) > CHUNK:
                yield held
                held, n = [], 0
            held.append((doc, tag, at, piece))
            n += len(piece)
    if held:
        yield held


def runs(held: list[tuple[int, int, int, np.ndarray]], shape: Shape) -> dict[str, np.ndarray]:
    """The runs of one chunk, in order of place; ``doc`` is an index into ``held``. Arrays as long as the chunk go as soon as they can."""
    lengths = np.array([len(x[3]) for x in held])
    symbols = np.concatenate([x[3] for x in held]) if len(held) > 1 else held[0][3]
    owner = np.repeat(np.arange(len(held), dtype=np.int32), lengths)
    begins = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    prefix = KEY.prefix(symbols)
    n_grams = len(symbols) - shape.gram + 1
    grams = prefix[shape.gram :] - prefix[:n_grams]
    del prefix
    grams *= KEY.down[:n_grams]
    grams = mix(grams)
    placed = grams & ~U(CHUNK - 1)
    placed |= np.arange(n_grams, dtype=np.uint64)
    placed = sliding_min(placed, shape.width - shape.gram + 1)
    anchor = (placed & U(CHUNK - 1)).view(np.int64)
    del placed
    n_windows = len(symbols) - shape.width + 1
    inside = owner[:n_windows] == owner[shape.width - 1 :]
    first = inside.copy()
    first[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    starts = np.flatnonzero(first)
    anchor = anchor[starts]
    key = grams[anchor]
    del grams, inside, first
    # A run ends before the next one or before a window that would leave its document.
    ends = np.append(starts[1:], n_windows)
    stop = begins[owner[starts]] + lengths[owner[starts]] - shape.width + 1
    n = np.minimum(ends, stop) - starts
    seg_prefix = SEG.prefix(symbols)
    seg = mix(SEG.ranges(seg_prefix, starts, starts + n + shape.width - 1) + ((n.astype(np.uint64) << U(8)) + (anchor - starts).astype(np.uint64)) * U(0xA0761D6478BD642F))
    return {"key": key, "seg": seg, "doc": owner[starts], "start": starts - begins[owner[starts]], "n": n, "anchor": anchor - starts}


def merged(doc: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of the ranges of each doc, sorted."""
    if not len(doc):
        return doc, start, size
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], (start + size)[order]
    # Offsetting by document keeps one running maximum from crossing into the next.
    step = int(end.max()) + 1
    rank = np.concatenate(([0], np.cumsum(doc[1:] != doc[:-1])))
    top = np.maximum.accumulate(end + rank * step)
    new = np.ones(len(doc), bool)
    new[1:] = (start[1:] + rank[1:] * step > top[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(doc)) - 1
    return doc[at], start[at], top[last] - rank[last] * step - start[at]


class Known:
    """Runs that a task has met repeatedly, each with its first place so far."""

    def __init__(self, most: int = KNOWN) -> None:
        self.most = most
        self.hash, self.rows = np.zeros(0, np.uint64), np.zeros((5, 0), np.int64)  # key, seg, doc, tag, pos
        self.age, self.now = np.zeros(0, np.int64), 0

    @staticmethod
    def of(key: np.ndarray, seg: np.ndarray) -> np.ndarray:
        return key ^ (seg * U(0xA0761D6478BD642F))

    def find(self, key: np.ndarray, seg: np.ndarray) -> np.ndarray:
        """Places in ``rows``, -1 for what isn't known."""
        if not len(self.hash):
            return np.full(len(key), -1)
        h = self.of(key, seg)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        same = (self.hash[at] == h) & (self.rows[0, at] == key.view(np.int64)) & (self.rows[1, at] == seg.view(np.int64))
        return np.where(same, at, -1)

    def add(self, fresh: np.ndarray) -> None:
        """Rows that aren't known yet."""
        self.hash = np.concatenate((self.hash, self.of(fresh[0].view(U), fresh[1].view(U))))
        self.rows, self.age = np.concatenate((self.rows, fresh), 1), np.append(self.age, np.full(fresh.shape[1], self.now))
        if len(self.hash) > self.most:  # what was met last stays
            stays = np.argsort(-self.age, kind="stable")[: self.most // 2]
            self.hash, self.rows, self.age = self.hash[stays], self.rows[:, stays], self.age[stays]
        order = np.argsort(self.hash, kind="stable")
        self.hash, self.rows, self.age = self.hash[order], self.rows[:, order], self.age[order]


def scan_chunk(held, shape: Shape, known: Known) -> tuple[np.ndarray, ...]:
    """Columns of RUN_SCHEMA for one chunk; runs equal to an earlier one of the chunk or a known one are settled on the spot."""
    r = runs(held, shape)
    ids = np.array([x[0] for x in held], dtype=np.int64)
    tags = np.array([x[1] for x in held], dtype=np.int64)
    offsets = np.array([x[2] for x in held], dtype=np.int64)
    start, which = r["start"] + offsets[r["doc"]], r["doc"]
    pos = pack(start, r["n"], r["anchor"])
    order = np.lexsort((pos, tags[which], ids[which], r["seg"], r["key"]))
    key, seg = r["key"][order], r["seg"][order]
    pos, which, start, n = pos[order], which[order], start[order], r["n"][order]
    doc, tag = ids[which], tags[which]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (seg[1:] != seg[:-1])
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    lead = first[group]
    twin = ~new & (doc == doc[lead]) & (tag == tag[lead]) & (pos == pos[lead])  # of a repeated row
    gone = ~new & ~twin if shape.inside else doc > doc[lead]
    # What is known of the groups; the earlier one of both is the first place from now on.
    known.now += 1
    at = known.find(key[first], seg[first])
    met = np.flatnonzero(at >= 0)
    if len(met):
        k = at[met]
        known.age[k] = known.now
        d, t, p = known.rows[2:, k]
        mine = first[met]
        later = (doc[mine] > d) | ((doc[mine] == d) & ((tag[mine] > t) | ((tag[mine] == t) & (pos[mine] > p))))
        before = np.full(len(first), np.iinfo(np.int64).max)
        before[met] = d
        if shape.inside:
            gone[mine[later]] = True
            gone |= twin & gone[lead]
        else:
            gone |= doc > before[group]
        known.rows[2:, k[~later]] = np.stack((doc[mine], tag[mine], pos[mine]))[:, ~later]
    often = np.flatnonzero((np.diff(np.append(first, len(key))) > 1) & (at < 0))
    if len(often):
        f = first[often]
        known.add(np.stack((key[f].view(np.int64), seg[f].view(np.int64), doc[f], tag[f], pos[f])))
    kept = ~gone & ~twin
    d, s, z = merged(which[gone], start[gone], n[gone] + shape.width - 1)
    k = len(d)
    return (
        np.concatenate((key[kept], mix(d.astype(np.uint64) + key[:1].sum()) if k else np.zeros(0, np.uint64))).view(np.int64),
        np.concatenate((seg[kept].view(np.int64), np.zeros(k, np.int64))),
        np.concatenate((doc[kept], ids[d])),
        np.concatenate((tag[kept], tags[d])),
        np.concatenate((pos[kept], pack(s, np.zeros(k, np.int64)))),
        np.concatenate((np.zeros(int(kept.sum()), np.int64), z)).astype(np.int32),
    )


@lean
def scan(batches: Iterator[pa.RecordBatch], shape: Shape, symbolize: Callable[[list[str]], list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """(doc, tag, text) to RUN_SCHEMA."""
    names, known = ["key", "seg", "doc", "tag", "pos", "size"], Known()
    for batch in batches:
        texts = ["" if x is None else x for x in batch.column(2).to_pylist()]
        ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for held in pieces(ids, tags, symbolize(texts), shape.width):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in scan_chunk(held, shape, known)], names)


@lean
def settle(batches: Iterator[pa.RecordBatch], shape: Shape, last: bool = False) -> Iterator[pa.RecordBatch]:
    """RUN_SCHEMA sorted by key, seg, doc, tag, pos to FOUND_SCHEMA, in constant memory.

    A run with an equal earlier one becomes a range to remove. A run whose key has
    another run too is handed on as a candidate, unless ``last`` is set: then runs
    are single windows and there is nothing left to compare.
    """
    names = ["key", "doc", "tag", "pos", "size"]
    empty = np.zeros(0, np.int64)
    state = None  # key, seg, first doc, tag and pos of seg, whether the key has several runs
    waiting: list[tuple[np.ndarray, ...]] = []  # candidates of a key's only run so far
    for batch in batches:
        key, seg, doc, tag, pos, size = (batch.column(i).to_numpy() for i in range(6))
        fixed = size > 0
        out = [(key[fixed], doc[fixed], tag[fixed], pos[fixed], size[fixed])]
        key, seg, doc, tag, pos = (x[~fixed] for x in (key, seg, doc, tag, pos))
        if len(key):
            new_key, new_seg = np.ones(len(key), bool), np.ones(len(key), bool)
            new_key[1:] = key[1:] != key[:-1]
            new_seg[1:] = new_key[1:] | (seg[1:] != seg[:-1])
            if state is not None:
                new_key[0] = key[0] != state[0]
                new_seg[0] = new_key[0] or seg[0] != state[1]
            at = np.where(new_seg, np.arange(len(key)), -1)
            lead = np.maximum.accumulate(at)
            first = [np.where(lead >= 0, x[np.maximum(lead, 0)], state[2][i] if state is not None else 0) for i, x in enumerate((doc, tag, pos))]
            twin = ~new_seg & (doc == first[0]) & (tag == first[1]) & (pos == first[2])  # of a repeated row
            gone = ~new_seg & ~twin if shape.inside else doc > first[0]
            sizes = (pos & 0xFF).astype(np.int64) + shape.width - 1
            out.append((key[gone], doc[gone], tag[gone], pos[gone], sizes[gone]))
            group = np.cumsum(new_key)  # 0: goes on from the batch before
            several = np.bincount(group, weights=new_seg & ~new_key, minlength=group[-1] + 1) > 0
            if state is not None and not new_key[0]:
                several[0] |= state[3]
                if several[0]:
                    out += [(*x, np.zeros(len(x[0]), np.int64)) for x in waiting]
                    waiting = []
            if new_key.any():  # the key that was open is complete
                waiting = []
            if not last:
                rest = ~gone & ~twin
                now = rest & several[group]
                out.append((key[now], doc[now], tag[now], pos[now], np.zeros(int(now.sum()), np.int64)))
                later = rest & ~several[group] & (group == group[-1])
                if later.any():
                    waiting.append((key[later], doc[later], tag[later], pos[later]))
            state = (key[-1], seg[-1], [x[-1] for x in first], bool(several[group[-1]]))
        columns = [np.concatenate([x[i] for x in out] or [empty]) for i in range(5)]
        if len(columns[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32) if i == 4 else c.astype(np.int64)) for i, c in enumerate(columns)], names)


def prepared(docs: DataFrame, id_col: str, text_col: str, row: bool = False) -> DataFrame:
    """doc, tag, text as bytes; with ``row`` the row's other columns come along as a struct.

    In that struct the text is only told from null, so it does not travel twice.
    """
    text = F.coalesce(F.col("_text").cast("string"), F.lit(""))
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *([_row(docs, text_col)] if row else []))
    return row_tag(source, "_id", text).select(inner_id("_id").alias("doc"), F.col("_tag").alias("tag"), text.cast("binary").alias("text"), *(["row"] if row else []))


def _row(docs: DataFrame, text_col: str) -> Column:
    return F.struct(*(F.when(F.col(c).isNotNull(), F.lit("")).alias(c) if c == text_col else F.col(c) for c in docs.columns)).alias("row")


def by_key(rows: DataFrame) -> DataFrame:
    """Rows of one key side by side, earliest first; the sort spills, so a hot key is no matter of memory."""
    return rows.repartition(shuffle_width(rows.sparkSession), "key").sortWithinPartitions("key", "seg", "doc", "tag", "pos")


def settled(rows: DataFrame, shape: Shape, last: bool = False) -> DataFrame:
    return by_key(rows).mapInArrow(lambda it: settle(it, shape, last), FOUND_SCHEMA)


def at_text(marks: DataFrame, prep: DataFrame, how: str) -> DataFrame:
    """doc, tag, text, marks: the (pos, size) of each document, beside its text."""
    of_doc = marks.groupBy("doc", "tag").agg(F.collect_list(F.struct("pos", "size")).alias("marks"))
    return prep.join(of_doc, ["doc", "tag"], how)


def mark_arrays(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each row of at_text: starts and sizes (for a candidate its number of windows)."""
    lists = batch.column(batch.schema.get_field_index("marks"))
    pos = lists.values.field(0).to_numpy(zero_copy_only=False)
    size = lists.values.field(1).to_numpy(zero_copy_only=False)
    offsets = lists.offsets.to_numpy()
    valid = lists.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(lists)):
        at = slice(offsets[i], offsets[i + 1]) if valid[i] else slice(0, 0)
        yield start_of(pos[at]), np.where(size[at] > 0, size[at], pos[at] & 0xFF).astype(np.int64)


def covered(n: int, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Boolean mask of the n symbols that the ranges cover."""
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, np.minimum(starts, n), 1)
    np.add.at(steps, np.minimum(starts + sizes, n), -1)
    return np.cumsum(steps[:n]) > 0
