"""Near-duplicate classes by SimHash and random bit sampling.

1. Every text gets a SimHash of ``BITS`` bits over the set of its five-word shingles
   (words: lower-case runs of letters and digits; a shorter text is one shingle), and
   texts with the same set collapse to one representative with its members.
2. Each of several tables samples some coordinates of the signature and groups
   representatives that agree on them. A bucket with more than ``bucket`` members is
   split for the first comparison by further sampled bits, again and again; the last
   bits are the whole signature, so what is left together is equal and gets a chain.
3. In a bucket, signatures are compared by distance; of the pairs within the candidate
   distance only the edges of a minimum spanning forest and each member's nearest
   few go on, never all pairs.
4. Candidate edges are verified: both shingle sets are brought together and the edge
   stays if their Jaccard similarity is at least ``similarity``.
5. Connected components of the verified edges are the first classes (alternating stars,
   each round cut by a checkpoint).
6. Pairs that a split (2) or the forest (3) left out and whose ends are in different classes are all verified:
   their buckets are cut into blocks, block pairs with a pair to verify get the shingle
   sets, and what is found joins classes. So every pair within the candidate distance in
   a common bucket is verified or lies in one class of verified edges.

Everything is keyed, salted or spread by hash of content, so copies, however many,
cost one row in the tables, and a hot bucket splits. Nothing is collected.

Defined results: null and empty texts (no word) form no class, each row stands alone and
stays; a null id is an id before all others and comes back as null; rows that share an id
or have none are told apart by their texts (a class is named by its smallest id, so
different classes may then bear one name; of equal ids the text with the smallest hash
is kept); rows that repeat id and text are one document each, kept together by
``classes`` and once by ``keep_one``; an empty table gives an empty result; other columns
are ignored and may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from queryloom.llm._common import checkpoint, inner_id, lean, mix, outer_id, shuffle_width, unused
from queryloom.llm.components import components

BITS, SHINGLE, SIMILARITY = 256, 5, 0.8
#: Candidate distance: at similarity 0.8 about 39 of 256 bits differ, with a deviation of 5.8.
DISTANCE, TABLES, SAMPLED, BUCKET, NEAREST = 58, 36, 14, 2048, 3
#: A block of step 6 has at most so many rows, and bytes of shingles (one larger text is a block).
BLOCK, BLOCK_BYTES = 1024, 8 << 20
WORD = re.compile(r"[^\W_]+")
U = np.uint64


class Shingles:
    """Sorted distinct 64-bit hashes of a text's word shingles."""

    def __init__(self, size: int = SHINGLE, cache: int = 500_000) -> None:
        self.size, self.cache, self.known = size, cache, {}

    def _hash(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self.known) >= self.cache:
            self.known.clear()
        self.known[word] = h
        return h

    def __call__(self, text: str) -> np.ndarray:
        words = WORD.findall(text.lower())
        if not words:
            return np.zeros(0, U)
        known, miss = self.known.get, self._hash
        w = np.array([known(x) or miss(x) for x in words], U)
        n = max(1, len(w) - self.size + 1)
        h = np.zeros(n, U)
        for k in range(min(self.size, len(w))):
            h = mix(h + w[k : k + n] + U(k + 1))
        return np.unique(h)


def simhash(shingles: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Signature as bits // 64 words; each shingle's bits come from a counter-mode hash."""
    out = np.zeros(bits // 64, U)
    for k in range(bits // 64):
        total = np.zeros(64, np.int64)
        for at in range(0, len(shingles), 1 << 16):
            x = mix(shingles[at : at + (1 << 16)] ^ U((k + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
            total += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out[k] = np.packbits(2 * total > len(shingles)).view(U)[0]
    return out


@lean
def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, text, th to doc, th, set_hash (of the whole shingle set), signature, number of shingles."""
    shingles = Shingles()
    for batch in batches:
        a, b, sigs, sizes = [], [], [], []
        for t in batch.column(1).to_pylist():
            s = shingles(t)
            d = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
            a.append(d and int.from_bytes(d[:8], "little", signed=True))
            b.append(d and int.from_bytes(d[8:], "little", signed=True))
            sigs.append(d and simhash(s).tobytes())
            sizes.append(len(s))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sigs, pa.binary()), pa.array(sizes, pa.int64())], ["doc", "th", "set_a", "set_b", "sig", "size"])


def coordinates(table: int, n: int) -> np.ndarray:
    """An order of all bits of a table; the first are its key, the later ones split."""
    return np.random.default_rng(1000 + table).permutation(n)


@lean
def keyed(batches: Iterator[pa.RecordBatch], tables: int, sampled: int) -> Iterator[pa.RecordBatch]:
    """doc, sig to one row per table: bucket (key of the sampled bits), doc, sig."""
    orders = [coordinates(t, BITS) for t in range(tables)]
    weights = U(1) << np.arange(sampled, dtype=U)
    for batch in batches:
        if not batch.num_rows:
            continue
        bits = np.unpackbits(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1), axis=1)
        for t, order in enumerate(orders):
            key = (bits[:, order[:sampled]] * weights).sum(1, dtype=U)
            bucket = (key | U(t) << U(40)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), batch.column(0), batch.column(1), pa.array(np.full(len(bucket), t, np.int32))], ["bucket", "doc", "sig", "tab"])


def narrow(rows: DataFrame, sampled: int, limit: int, step: int = 8) -> tuple[DataFrame, DataFrame]:
    """Buckets of at most ``limit`` members, by more bits where there are more; and the buckets that were split.

    Each round counts bucket sizes (combined before the shuffle); only members of large
    buckets are looked at again. Rounds end when no bucket is too large or the bits are
    used up, where the members of a bucket are equal in all bits.
    """
    done, used, split = [], sampled, None
    while True:
        large = checkpoint(rows.groupBy("bucket").count().where(F.col("count") > limit).select("bucket"))
        split = large if split is None else split
        if used >= BITS or large.isEmpty():
            done.append(rows)
            break
        done.append(rows.join(large, "bucket", "left_anti"))

        def deeper(batches: Iterator[pa.RecordBatch], used: int = used) -> Iterator[pa.RecordBatch]:
            orders: dict[int, np.ndarray] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                bucket, tab = batch.column(0).to_numpy(), batch.column(3).to_numpy()
                bits = np.unpackbits(np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, -1), axis=1)
                new = bucket.copy()
                for t in np.unique(tab):
                    order = orders.setdefault(int(t), coordinates(int(t), BITS))[used : used + step]
                    at = np.flatnonzero(tab == t)
                    more = (bits[np.ix_(at, order)] * (U(1) << np.arange(len(order), dtype=U))).sum(1, dtype=U)
                    new[at] = mix(mix(bucket[at].view(U)) + more + U(used)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(new), batch.column(1), batch.column(2), batch.column(3)], ["bucket", "doc", "sig", "tab"])

        rows = checkpoint(rows.join(large, "bucket", "left_semi").select("bucket", "doc", "sig", "tab").mapInArrow(deeper, "bucket long, doc long, sig binary, tab int"))
        used += step
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out, split


def link(docs: np.ndarray, sigs: np.ndarray, distance: int, nearest: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidate edges in one bucket: spanning forest by least distance, and nearest neighbours; the members of pairs left out."""
    n = len(docs)
    if n > BUCKET:  # equal in every bit that was left to split by
        order = np.lexsort((docs, *sigs.T))
        same = (sigs[order[1:]] == sigs[order[:-1]]).all(1)
        return np.stack([docs[order[:-1]][same], docs[order[1:]][same]], 1), docs[:0]
    d = np.zeros((n, n), np.uint16)
    for k in range(sigs.shape[1]):
        d += np.bitwise_count(sigs[:, None, k] ^ sigs[None, :, k])
    i, j = np.nonzero(np.triu(d <= distance, 1))
    if not len(i):
        return np.zeros((0, 2), np.int64), docs[:0]
    order = np.argsort(d[i, j], kind="stable")
    parent, degree, out, left = list(range(n)), [0] * n, [], np.zeros(n, bool)
    for a, b in zip(i[order].tolist(), j[order].tolist()):
        x, y = a, b
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[max(x, y)] = min(x, y)
        elif degree[a] >= nearest and degree[b] >= nearest:
            left[a] = left[b] = True
            continue
        degree[a] += 1
        degree[b] += 1
        out.append((docs[a], docs[b]))
    return np.array(out, np.int64), docs[left]


@lean
def bucket_edges(batches: Iterator[pa.RecordBatch], distance: int, nearest: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket to candidate edges (a < b) with bucket -1, and rows (doc, doc, bucket) for members of pairs
    left out; a bucket is at most BUCKET rows or all equal."""
    words = BITS // 64
    held: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def finish(bucket, doc, sig):
        cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        ends = np.append(cut[1:], len(bucket))
        out = []
        for s, e in zip(cut, ends):
            if e - s > 1:
                pairs, left = link(doc[s:e], sig[s:e], distance, nearest)
                out.append(np.column_stack((np.sort(pairs, 1), np.full(len(pairs), -1))))
                out.append(np.column_stack((left, left, np.full(len(left), bucket[s]))))
        return [x for x in out if len(x)]

    def batch_of(rows):
        e = np.concatenate(rows)
        return pa.RecordBatch.from_arrays([pa.array(e[:, k]) for k in range(3)], ["a", "b", "bucket"])

    for batch in batches:
        if not batch.num_rows:
            continue
        now = (batch.column(0).to_numpy(), batch.column(1).to_numpy(), np.frombuffer(b"".join(batch.column(2).to_pylist()), U).reshape(-1, words))
        if held is not None:
            now = tuple(np.concatenate(x) for x in zip(held, now))
        last = int(np.searchsorted(now[0], now[0][-1])) if (np.diff(now[0]) >= 0).all() else len(now[0]) - int(np.argmax(now[0][::-1] != now[0][-1]))
        if len(now[0]) - last > 4 * BUCKET:  # a bucket of equal signatures: chain what is here and keep one
            pairs = finish(*now)
            held = tuple(x[-1:] for x in now)
        else:
            pairs = finish(*(x[:last] for x in now)) if last else []
            held = tuple(x[last:] for x in now)
        if pairs:
            yield batch_of(pairs)
    if held is not None and (pairs := finish(*held)):
        yield batch_of(pairs)


@lean
def shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingles = Shingles()
    for batch in batches:
        # 40 bits a shingle tell sets apart: sorted, 5 bytes each.
        sets = [np.unique(shingles(t) >> U(24)).view(np.uint8).reshape(-1, 8)[:, :5].tobytes() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["doc", "shingles"])


def numbers(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return wide.view(U).ravel()


@lean
def jaccard(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            a, b = numbers(x), numbers(y)
            both = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(both >= least * (len(a) + len(b) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], ["a", "b"])


def halves(rows: pa.Table) -> tuple[pa.Table, int, bool]:
    """Rows of a block pair with those of the first block in front, how many these are, and whether both are one block."""
    i, j, block = (rows[c].to_numpy() for c in ("i", "j", "block"))
    return rows.take(np.argsort(block != i, kind="stable")), int((block == i).sum()), bool(i[0] == j[0])


def unsettled(rows: pa.Table, distance: int, similarity: float, sampled: int) -> pa.Table:
    """The members of a block pair that have a pair to verify: within the distance, of different classes, of sizes
    that allow the similarity, and in no common bucket of an earlier table (where the same is done)."""
    rows, m, one = halves(rows)
    comp, size = rows["comp"].to_numpy(), rows["size"].to_numpy()
    raw = np.frombuffer(b"".join(rows["sig"].to_pylist()), np.uint8).reshape(len(rows), -1)
    sigs, bits = raw.view(U), np.unpackbits(raw, axis=1)
    weights = U(1) << np.arange(sampled, dtype=U)
    earlier = [(bits[:, coordinates(t, BITS)[:sampled]] * weights).sum(1, dtype=U) for t in range(rows["bucket"][0].as_py() >> 40)]
    hit = np.zeros(len(rows), bool)
    for x in range(m):
        at = np.arange(x + 1 if one else m, len(rows))
        at = at[comp[at] != comp[x]]
        at = at[np.bitwise_count(sigs[at] ^ sigs[x]).sum(1, dtype=np.int64) <= distance]
        at = at[np.minimum(size[at], size[x]) + 2 >= similarity * np.maximum(size[at], size[x])]
        for key in earlier:
            if not len(at):
                break
            at = at[key[at] != key[x]]
        if len(at):
            hit[x] = hit[at] = True
    return rows.select(["bucket", "i", "j", "block", "doc", "comp"]).filter(pa.array(hit))


def verified(rows: pa.Table, similarity: float) -> pa.Table:
    """Links between classes by the shingle sets of a block pair; of links that close a circle here, none."""
    rows, m, one = halves(rows)
    comp = rows["comp"].to_numpy()
    sets = [numbers(x) for x in rows["shingles"].to_pylist()]
    n = np.array([len(x) for x in sets])
    ends = np.cumsum(n)
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    marked = np.zeros(len(values), bool)
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while (p := parent.get(c, c)) != c:
            parent[c] = parent.get(p, p)
            c = p
        return c

    out = []
    for x in range(m):
        lo = x + 1 if one else m
        if lo >= len(sets):
            continue
        own = flat[ends[x] - n[x] : ends[x]]
        marked[own] = True
        start = ends[lo] - n[lo]
        both = np.add.reduceat(marked[flat[start:]], ends[lo:] - n[lo:] - start, dtype=np.int64)
        marked[own] = False
        near = both >= similarity * (n[x] + n[lo:] - both)
        for c in comp[lo:][near & (comp[lo:] != comp[x])].tolist():
            a, b = sorted((root(int(comp[x])), root(c)))
            if a != b:
                parent[b] = a
                out.append((int(comp[x]), c))
    return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def settle(again: DataFrame, rep: DataFrame, comp: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float, block: int, block_bytes: int) -> DataFrame:
    """comp with the classes joined that any pair within the distance links among the rows ``again`` (bucket, doc)."""
    rows = again.join(comp, again["doc"] == comp["node"], "left").select("bucket", "doc", F.coalesce("root", "doc").alias("comp"))
    mixed = rows.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("bucket")
    rows = checkpoint(rows.join(mixed, "bucket", "left_semi"))
    if rows.isEmpty():
        return comp
    # Blocks in the order of classes: most block pairs of a large class have nothing to compare and are not made.
    weight = F.greatest(F.col("size") * 8, F.lit(block_bytes // block))
    order = Window.partitionBy("bucket").orderBy("comp", "doc").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = checkpoint(rows.join(rep.select("doc", "sig", "size"), "doc").withColumn("block", F.floor((F.sum(weight).over(order) - 1) / block_bytes).cast("long")))
    cut = checkpoint(rows.groupBy("bucket", "block").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")))
    pairs = cut.select("bucket", F.col("block").alias("i"), F.col("lo").alias("lo_i"), F.col("hi").alias("hi_i")).join(cut.withColumnRenamed("block", "j"), "bucket")
    pairs = pairs.where("i <= j and not (lo_i = hi_i and lo = hi and lo_i = lo)").select("bucket", "i", "j")
    sides = pairs.withColumn("block", F.col("i")).union(pairs.where("i < j").withColumn("block", F.col("j")))
    open_ = rows.join(sides, ["bucket", "block"]).groupBy("bucket", "i", "j").applyInArrow(lambda t: unsettled(t, DISTANCE, similarity, SAMPLED), "bucket long, i long, j long, block long, doc long, comp long")
    open_ = checkpoint(open_)
    with_sets = open_.join(sets_of(open_.select("doc").distinct()), "doc")
    links = with_sets.groupBy("bucket", "i", "j").applyInArrow(lambda t: verified(t, similarity), "a long, b long")
    joined = components(links).select(F.col("node").alias("was"), F.col("root").alias("now"))
    every = rep.join(comp, rep["doc"] == comp["node"], "left").select("doc", F.coalesce("root", "doc").alias("was"))
    return every.join(joined, "was", "left").select(F.col("doc").alias("node"), F.coalesce("now", "was").alias("root"))


def _classes(docs: DataFrame, similarity: float, tables: int, id_col: str, text_col: str) -> DataFrame:
    """Each row of docs: doc and th, which name its text, and its class (number of a representative; null without a word)."""
    clean = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    text = docs.select(inner_id(id_col).alias("doc"), clean.alias("text"), F.xxhash64(clean).alias("th"))
    signed = checkpoint(text.mapInArrow(sign, "doc long, th long, set_a long, set_b long, sig binary, size long"))
    # Equal sets (exact copies and the like) become one representative before anything is compared. It has a
    # number of its own: ids may be missing or stand on several texts.
    sets = signed.where("sig is not null").groupBy("set_a", "set_b").agg(F.min(F.struct("doc", "th")).alias("first"), F.first("sig").alias("sig"), F.first("size").alias("size"))
    rep = checkpoint(sets.select("set_a", "set_b", F.col("first.doc").alias("at_doc"), F.col("first.th").alias("at_th"), "sig", "size").withColumn("doc", F.monotonically_increasing_id()))
    keys = rep.select("doc", "sig").mapInArrow(lambda it: keyed(it, tables, SAMPLED), "bucket long, doc long, sig binary, tab int")
    rows, split = narrow(keys, SAMPLED, BUCKET)
    rows = rows.select("bucket", "doc", "sig")
    width = shuffle_width(docs.sparkSession)
    edges = rows.repartition(width, "bucket").sortWithinPartitions("bucket").mapInArrow(lambda it: bucket_edges(it, DISTANCE, NEAREST), "a long, b long, bucket long")
    found = checkpoint(edges.where(f"a != b or bucket between 0 and {(tables << 40) - 1}").distinct())
    edges = found.where("a != b").select("a", "b")

    def sets_of(need: DataFrame) -> DataFrame:
        wanted = need.join(rep.select(F.col("doc").alias("rep"), "at_doc", "at_th"), F.col("doc") == F.col("rep")).select("rep", F.col("at_doc").alias("doc"), F.col("at_th").alias("th"))
        return wanted.join(text, ["doc", "th"]).dropDuplicates(["rep"]).select("rep", "text").mapInArrow(shingle_sets, "doc long, shingles binary")

    shingled = checkpoint(sets_of(edges.select(F.col("a").alias("doc")).union(edges.select("b")).distinct()))
    left = edges.join(shingled.select(F.col("doc").alias("a"), F.col("shingles").alias("sa")), "a")
    both = left.join(shingled.select(F.col("doc").alias("b"), F.col("shingles").alias("sb")), "b").select("a", "b", "sa", "sb")
    comp = components(both.mapInArrow(lambda it: jaccard(it, similarity), "a long, b long"))
    again = found.where("a = b").select("bucket", F.col("a").alias("doc"))
    if not split.isEmpty():
        again = again.union(keys.join(split, "bucket", "left_semi").select("bucket", "doc")).distinct()
    comp = settle(again, rep, comp, sets_of, similarity, BLOCK, BLOCK_BYTES)
    # Members of a set have the class of their representative.
    root = rep.join(comp, rep["doc"] == comp["node"], "left").select("set_a", "set_b", F.coalesce("root", "doc").alias("class"))
    return signed.join(root, ["set_a", "set_b"], "left").select("doc", "th", "class")


def classes(docs: DataFrame, similarity: float = SIMILARITY, tables: int = TABLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, class_id (smallest id of the class), class_size, kept."""
    rows = _classes(docs, similarity, tables, id_col, text_col)
    of_class = rows.where("class is not null").groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "th")).alias("first"))
    first = F.coalesce(F.col("first"), F.struct("doc", "th"))
    return rows.join(of_class, "class", "left").select(outer_id("doc").alias("doc_id"), F.coalesce("n", F.lit(1).cast("long")).alias("class_size"), first["doc"].alias("root"), (F.struct("doc", "th") == first).alias("kept")).select("doc_id", outer_id("root").alias("class_id"), "class_size", "kept")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, tables: int = TABLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class: the one with the smallest id, and of equal ids the one with the smallest hash of the text."""
    rows = checkpoint(_classes(docs, similarity, tables, id_col, text_col).where("class is not null"))
    first = rows.groupBy("class").agg(F.min(F.struct("doc", "th")).alias("first"))
    doc, th = unused(docs, "doc"), unused(docs, "th")
    as_named = [F.col("doc").alias(doc), F.col("th").alias(th)]
    gone = rows.join(first, "class").where(F.struct("doc", "th") != F.col("first")).select(*as_named).distinct()
    named = docs.withColumn(doc, inner_id(id_col)).withColumn(th, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    left = named.join(gone, [doc, th], "left_anti")
    # A row that stands there several times, text and id alike, is a copy of itself.
    twice = checkpoint(rows.groupBy("doc", "th").count().where("count > 1").select(*as_named))
    if not twice.isEmpty():
        left = left.join(twice, [doc, th], "left_anti").unionByName(left.join(twice, [doc, th], "left_semi").dropDuplicates([doc, th]))
    return left.select(*docs.columns)
