"""Exact BM25 top-k search over sharded inverted indexes with block-max pruning.

Statistics (number of documents, mean length, document frequencies) are global, so a
score does not depend on the shard that computes it. Documents are spread over shards
by hash; the number of shards follows the corpus, so an index in memory stays small.
The queries are written once, as a table in the shared folder: a shard's task builds the
index of its partition and streams the queries from there, any number of them. So what is
on disk is documents and queries once, not queries times shards; the folder goes when the
hits are there.

In a shard, similar documents stand side by side (a few singular vectors of the weighted
term matrix, halved again and again), in blocks; of every term the index has the largest
impact in each block. The longest lists are columns of a table of all documents, as far
as its bytes go. A query's terms are read from the rarest list to the longest (MaxScore),
in groups, the table last and for many queries at once. After each group a document can
still win only if its sum so far and the largest impacts that the terms left have in its
block reach a score that k documents are known to have (block-max WAND): of documents that
lead so far, scored at once. Blocks in which no document can win are skipped in all
further lists; a block of the table is multiplied by the weights of the queries for which
it lives. What is left then is scored from the documents' own terms, so every score that
leaves is the same sum in the same order. Bounds are widened by more than sums can be off,
and ties go by id, so the result is exact. The k best of every shard meet per query, and
the k best of them are the result.

Texts are cut into words as arrays of bytes, many at once; a word's hash is computed from
eight of its bytes at a time.

Score: sum over the query's distinct terms of qtf * idf * tf (k1 + 1) / (tf + k1 (1 - b +
b * length / mean length)), idf = ln(1 + (N - df + 0.5) / (df + 0.5)); terms are
lower-case runs of letters and digits, of the whole text.

Work grows with queries times postings; if the queries are a share of the corpus it
is quadratic in the corpus, which pruning softens and cannot remove.

Defined results: null or empty texts match nothing and, as queries, have no rows; a
null id is never a query, and as a document it comes last among ties; rows that repeat an
id are searched each and queried once each id and text; documents with score 0 are no
hits; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from queryloom.llm._common import checkpoint, checkpoint_folder, give_back, lean, mix, remove_folder, strings

K1, B, TOP = 1.2, 0.75, 10
BLOCK, SHARD_BYTES = 64, 32 << 20
#: Shares of a query's postings after which documents are dropped, and documents scored to raise the bar.
STEPS, LEADERS = (0.05, 0.1, 0.2, 0.35, 0.5, 0.7), 16
QUERY_BYTES, QUERY_ROWS = 4 << 20, 256  # of the queries' file that a task reads, and queries that it answers, at once
SLACK = 1e-6  # lists and tables hold impacts in single precision; they only choose the candidates
#: Lists with at least one of so many documents are columns of a table, the longest first, as far as its bytes go; bytes of sums that the queries at work have.
TABLE_SHARE, TABLE_BYTES, SUMS_BYTES = 32, 32 << 20, 16 << 20
SLICE = 1 << 20  # characters that are cut into words at once
WORD_BYTES = 64  # longer words are hashed one by one


@cache
def letters() -> np.ndarray:
    """Which code points are letters or digits."""
    return np.array([chr(c).isalnum() for c in range(0x110000)])


def in_words(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 belong to letters and digits."""
    inside = np.append(letters()[:128], np.zeros(128, bool))[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        more = 1 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)  # bytes that follow
        code = data[lead].astype(np.int32) & 0x3F >> more
        for k in (1, 2, 3):
            has = np.flatnonzero(more >= k)
            code[has] = code[has] << 6 | data[lead[has] + k] & 0x3F
        letter = letters()[code]
        for k in (0, 1, 2, 3):
            inside[lead[letter & (more >= k)] + k] = True
    return inside


def hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Of the words at these places, eight bytes at a time; words hold no zero bytes, 8 of them follow the data."""
    size = last - first
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    mask = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
    out = mix(eight[first] & mask[np.minimum(size, 8)])
    more = np.flatnonzero((size > 8) & (size <= WORD_BYTES))
    done = 8
    while len(more):
        out[more] = mix(out[more] ^ eight[first[more] + done] & mask[np.minimum(size[more] - done, 8)])
        done += 8
        more = more[size[more] > done]
    for w in np.flatnonzero(size > WORD_BYTES).tolist():
        out[w] = xxhash.xxh3_64_intdigest(data[first[w] : last[w]])
    return (out & np.uint64(2**63 - 1) | np.uint64(2)).astype(np.int64)  # 0 and 1 are kept for sums


def bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct terms of texts, sorted in each text, how often they occur, and where each text's begin and end."""
    lower = [t.lower().encode() for t in texts]
    data = np.frombuffer(b"\n".join(lower) + bytes(8), np.uint8)
    inside = in_words(data)
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.append(0, edges)
    first, last = edges[::2], edges[1::2]
    word = hashes(data, first, last)
    ends = np.searchsorted(first, np.cumsum([0, *(len(t) + 1 for t in lower)]))
    new = np.ones(len(word), bool)
    for a, b in pairwise(ends.tolist()):
        word[a:b].sort()
    new[1:] = word[1:] != word[:-1]
    new[ends[ends < len(word)]] = True
    at = np.flatnonzero(new)
    return word[at], np.diff(np.append(at, len(word))), np.searchsorted(at, ends)


def sliced(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, list[str]]]:
    """Texts of about ``size`` characters at a time, and the first one's number."""
    texts = strings(column)
    begin = held = 0
    for i, text in enumerate(texts):
        if held and held + len(text) > size:
            yield begin, texts[begin:i]
            begin, held = i, 0
        held += len(text) + 1
    if begin < len(texts):
        yield begin, texts[begin:]


class Terms:
    """Sorted term hashes of a text and their counts."""

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return bags([text])[:2]


@lean
def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to partial (term, n): documents with the term; 0 counts documents, 1 their words."""
    held, docs, words, size = [], 0, 0, 0

    def rows() -> pa.RecordBatch:
        t, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.append(t, [0, 1])), pa.array(np.append(n, [docs, words]).astype(np.int64))], ["term", "n"])

    for batch in batches:
        for _, texts in sliced(batch.column(0)):
            t, n, _ = bags(texts)
            held.append(t)
            docs, words, size = docs + len(texts), words + int(n.sum()), size + len(t)
            if size > 2_000_000:
                yield rows()
                held, docs, words, size = [], 0, 0, 0
    yield rows()


def blobs(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Parts of an array as binary values."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


@lean
def document_rows(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """id, text to shard, id, terms and counts (binary)."""
    for batch in batches:
        for begin, texts in sliced(batch.column(1)):
            terms, counts, ends = bags(texts)
            ids = batch.column(0).slice(begin, len(texts))
            shard = [xxhash.xxh3_64_intdigest(terms[a:b], seed=(i or 0) & (2**64 - 1)) % shards for (a, b), i in zip(pairwise(ends.tolist()), ids.to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), ids, blobs(terms, ends), blobs(counts.astype(np.uint32), ends)], ["shard", "id", "terms", "counts"])


def query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, texts in sliced(batch.column(1)):
            terms, counts, ends = bags(texts)
            ids = np.repeat(batch.column(0).slice(begin, len(texts)).to_numpy(zero_copy_only=False), np.diff(ends))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms), pa.array(counts.astype(np.int64))], ["id", "term", "qtf"])


def grouped(numbers: np.ndarray) -> np.ndarray:
    """The stable order of 32-bit numbers."""
    return np.sort(numbers.astype(np.int64) << 32 | np.arange(len(numbers))) & (2**32 - 1)


def similar_order(doc: np.ndarray, term: np.ndarray, value: np.ndarray, n: int, terms: int, rank: int = 4, rounds: int = 3) -> np.ndarray:
    """An order of documents with similar ones side by side; postings are sorted by doc."""
    if n <= BLOCK or not len(doc):
        return np.arange(n)
    norm = np.sqrt(np.bincount(doc, weights=value * value, minlength=n)) + 1e-12
    value = (value / norm[doc]).astype(np.float32)
    new = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    by_term = grouped(term)
    first = np.flatnonzero(np.append(True, np.diff(term[by_term]) != 0))
    found, at = np.random.default_rng(0).standard_normal((terms, rank)).astype(np.float32), np.zeros((n, rank), np.float32)
    for k in range(rounds):
        at[doc[new]] = np.add.reduceat(value[:, None] * found[term], new, axis=0)
        if k < rounds - 1:
            basis = np.linalg.qr(at)[0]
            found[term[by_term[first]]] = np.add.reduceat(value[by_term, None] * basis[doc[by_term]], first, axis=0)
    out: list[np.ndarray] = []
    todo = [np.arange(n)]
    while todo:
        part = todo.pop()
        if len(part) <= BLOCK:
            out.append(part)
            continue
        x = at[part]
        part = part[np.argsort(x[:, np.argmax(x.var(0))], kind="stable")]
        half = max(BLOCK, len(part) // 2 // BLOCK * BLOCK)
        todo += [part[half:], part[:half]]
    return np.concatenate(out)


class Index:
    """Inverted index of one shard, with the documents' own terms beside it; it empties the lists that it is built from."""

    def __init__(self, ids: list, terms: list[np.ndarray], counts: list[np.ndarray], mean: float, k1: float = K1, b: float = B) -> None:
        n = len(ids)
        length = np.array([c.sum(dtype=np.int64) for c in counts])
        sizes = np.array([len(t) for t in terms], np.int64)
        doc = np.repeat(np.arange(n, dtype=np.int32), sizes)
        impact = np.concatenate(counts).astype(np.float64) if counts else np.zeros(0)
        counts.clear()
        weaker = (k1 * (1 - b + b * length / mean))[doc]
        weaker += impact
        impact *= k1 + 1
        impact /= weaker
        del weaker
        term = np.concatenate(terms) if terms else np.zeros(0, np.int64)
        terms.clear()
        self.terms, term = np.unique(term, return_inverse=True)
        term = term.astype(np.int32)
        self.length = np.bincount(term, minlength=len(self.terms))  # of the lists
        telling = np.flatnonzero(((self.length >= n / 128) & (self.length <= n / 2))[term])  # terms that neither few nor most documents have
        rare = np.log1p(n / (self.length + 0.5))
        order = similar_order(doc[telling], term[telling], impact[telling] * rare[term[telling]], n, len(self.terms))
        del doc, telling
        # Documents by place: their terms and impacts as they came.
        self.ids = np.array([2**63 - 1 if i is None else i for i in ids], np.int64)[order]
        last = np.cumsum(sizes)[order]
        own = places(last - sizes[order], last)
        self.own_term, self.own_impact = term[own], impact[own]
        del own, term, impact
        of = np.repeat(np.arange(n, dtype=np.int32), sizes[order])
        self.own = np.append(0, np.cumsum(sizes[order]))
        # The longest lists are columns of a table of all documents; the other lists are by term and place.
        self.blocks = -(-n // BLOCK)
        longest = np.argsort(-self.length, kind="stable")[: TABLE_BYTES // (4 * BLOCK * max(1, self.blocks))]
        longest = longest[self.length[longest] * TABLE_SHARE >= n]
        self.column = np.full(len(self.terms), -1)
        self.column[longest] = np.arange(len(longest))
        column = self.column[self.own_term]
        long = np.flatnonzero(column >= 0)
        self.table = np.zeros((self.blocks * BLOCK, len(longest)), np.float32)
        self.table[of[long], column[long]] = self.own_impact[long]
        del long
        self.table_most = self.table.reshape(self.blocks, BLOCK, len(longest)).max(1, initial=0).T
        by_term = np.flatnonzero(column < 0)
        del column
        by_term = by_term[grouped(self.own_term[by_term])]
        self.doc, self.impact, term = of[by_term], self.own_impact[by_term].astype(np.float32), self.own_term[by_term]
        del of, by_term
        new = np.ones(len(term), bool)  # segments: the postings of a term in a block
        new[1:] = (term[1:] != term[:-1]) | (self.doc[1:] // BLOCK != self.doc[:-1] // BLOCK)
        self.segment = np.append(np.flatnonzero(new), len(term))
        self.seg_block = self.doc[self.segment[:-1]] // BLOCK
        self.seg_most = np.maximum.reduceat(self.impact, self.segment[:-1]) if len(term) else np.zeros(0)
        self.first = np.searchsorted(term[self.segment[:-1]], np.arange(len(self.terms) + 1))
        self.weight = np.zeros(len(self.terms))  # of the query at work
        #: Of what a sum in single precision may be off, each way: every addition rounds once.
        self.slack = SLACK + (len(longest) + 8) * 2.0**-23
        # Postings that queries read one by one, and all that they have; blocks of the table that they read, and that hold any of their terms.
        self.read = self.all = self.blocks_read = self.blocks_all = 0

    def scores(self, docs: np.ndarray, at: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Of documents, from their own terms."""
        self.weight[at] = weights
        first, last = self.own[docs], self.own[docs + 1]
        of = np.repeat(np.arange(len(docs)), last - first)
        self.read += len(of)
        scores = np.bincount(of, weights=self.weight[parts(self.own_term, first, last)] * parts(self.own_impact, first, last), minlength=len(docs))
        self.weight[at] = 0
        return scores

    def top(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each query (terms, weights): ids and scores of the k best documents; ties by id."""
        if not len(self.terms):
            return [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
        step = max(1, SUMS_BYTES // (4 * BLOCK * self.blocks))
        return [hits for i in range(0, len(queries), step) for hits in self._top(queries[i : i + step], k)]

    def _top(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        asked = []
        heavy = np.zeros((len(queries), self.table.shape[1]), np.float32)  # weights of the table's terms
        for q, (terms, weights) in enumerate(queries):
            at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
            known = self.terms[at] == terms
            at, weights = at[known], weights[known]
            order = np.argsort(self.length[at], kind="stable")
            asked.append((at[order], weights[order]))
            column = self.column[at]
            heavy[q, column[column >= 0]] = weights[column >= 0]
        later = heavy @ self.table_most  # what the table can add in each block
        total = np.zeros((len(queries), self.blocks * BLOCK), np.float32)
        least = np.array([self._lists(*asked[q], heavy[q], later[q], total[q], k) for q in range(len(queries))])
        # A block of the table is read for the queries that can still find one of their best there.
        live = (later > 0) & (total.reshape(len(queries), self.blocks, BLOCK).max(2) + later >= (least * (1 - self.slack))[:, None])
        self.blocks_read += int(live.sum())
        self.blocks_all += int((later > 0).sum())
        for block in range(self.blocks):
            q, of = np.flatnonzero(live[:, block]), slice(block * BLOCK, (block + 1) * BLOCK)
            if len(q) == len(queries):
                total[:, of] += heavy @ self.table[of].T
            elif len(q):
                total[q, of] += heavy[q] @ self.table[of].T
        out = []
        for q, (at, weights) in enumerate(asked):
            # Sums are known but for their last digits: what can't be among the k best goes.
            docs = np.flatnonzero((total[q] > 0) & (total[q] >= least[q] * (1 - self.slack)))
            if len(docs) > k:
                sums = total[q, docs]
                docs = docs[sums >= np.partition(sums, -k)[-k] * (1 - 2 * self.slack)]
            scores = self.scores(docs, at, weights)
            hit = scores > 0
            docs, scores = self.ids[docs[hit]], scores[hit]
            best = np.lexsort((docs, -scores))[:k]
            out.append((docs[best], scores[best]))
        return out

    def _lists(self, at: np.ndarray, weights: np.ndarray, heavy: np.ndarray, most: np.ndarray, total: np.ndarray, k: int) -> float:
        """Adds up a query's lists where one of the k best can be; a score that k documents reach.

        ``heavy``: weights of the table's terms; ``most``: what these can add in each block.
        """
        n, size = len(self.ids), int(self.length[at].sum())
        lists = self.column[at] < 0
        at_all, weights_all, at, weights = at, weights, at[lists], weights[lists]
        lists = np.cumsum(self.length[at])
        self.all += size
        # Lists that are the lesser part are one group: to drop documents between them costs more than it saves.
        steps = STEPS if len(lists) and 2 * lists[-1] > size else ()
        cuts = np.unique(np.append(np.minimum(np.searchsorted(lists, np.array(steps) * size) + 1, len(at)), len(at)))
        segments, of = ranges(self.first[at[cuts[0] :]], self.first[at[cuts[0] :] + 1])
        starts, of = np.searchsorted(of, cuts - cuts[0]), of + cuts[0]
        # What the terms of all groups behind each can add in each block.
        later = np.zeros((len(cuts), self.blocks))
        later[-1] = most
        for g in range(len(cuts) - 2, -1, -1):
            s = slice(starts[g], starts[g + 1])
            later[g] = later[g + 1] + np.bincount(self.seg_block[segments[s]], weights=weights[of[s]] * self.seg_most[segments[s]], minlength=self.blocks)
        least, sums, live = 0.0, np.zeros(n), None
        low, high, w = self.segment[self.first[at[: cuts[0]]]], self.segment[self.first[at[: cuts[0]] + 1]], weights[: cuts[0]]
        known, real = np.zeros(0, np.int64), np.zeros(0)  # documents that were scored at once
        for g in range(len(cuts)):
            if g:  # segments of blocks that live
                o = slice(starts[g - 1], starts[g])
                o = np.flatnonzero(live[self.seg_block[segments[o]]]) + starts[g - 1]
                low, high, w = self.segment[segments[o]], self.segment[segments[o] + 1], weights[of[o]]
            self.read += int((high - low).sum())
            sums += np.bincount(parts(self.doc, low, high), weights=parts(self.impact, low, high) * np.repeat(w, high - low), minlength=n)
            total[:n] = sums
            if g == len(cuts) - 1:
                break
            m = min(k if len(known) else max(k, LEADERS), n)
            lead = np.setdiff1d(np.argpartition(-total[:n], m - 1)[:m], known)
            known, real = np.append(known, lead), np.append(real, self.scores(lead, at_all, weights_all))
            least = np.partition(real, -k)[-k] if len(real) >= k else 0.0
            live = total.reshape(self.blocks, BLOCK).max(1) + later[g] >= least * (1 - self.slack)
        # The lists are read: what leads so far needs the table alone, and its sum is a score but for last digits.
        m = min(max(k, LEADERS), n)
        lead = np.argpartition(-total[:n], m - 1)[:m]
        real = total[lead] + self.table[lead] @ heavy
        return max(least, float(np.partition(real, -k)[-k]) * (1 - self.slack)) if m >= k else least


def places(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All numbers of many half-open ranges."""
    n = last - first
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(n) else 0) + np.repeat(first - ends + n, n)


def parts(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """What stands in many half-open ranges."""
    if len(first) > 1000:
        return values[places(first, last)]
    return np.concatenate([values[:0], *[values[a:b] for a, b in zip(first.tolist(), last.tolist())]])


def ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of many half-open ranges, and the number of each one's range."""
    return places(first, last), np.repeat(np.arange(len(first)), last - first)


@lean
def search_shard(batches: Iterator[pa.RecordBatch], files: list[str], mean: float, k: int) -> Iterator[pa.RecordBatch]:
    """Documents of a partition (see document_rows) and the files of all queries to each query's k best there."""
    ids, terms, counts = [], [], []
    for batch in batches:
        ids += batch.column(1).to_pylist()
        terms += [np.frombuffer(t, np.int64) for t in batch.column(2).to_pylist()]
        counts += [np.frombuffer(c, np.uint32) for c in batch.column(3).to_pylist()]
        del batch
    if not ids:
        return
    index = Index(ids, terms, counts, mean)
    del ids, terms, counts
    give_back()
    for file in files:
        system, path = pyarrow.fs.FileSystem.from_uri(file)
        with system.open_input_file(path) as source:
            for batch in pq.ParquetFile(source).iter_batches(QUERY_ROWS, use_threads=False):
                asked = [(np.frombuffer(t, np.int64), np.frombuffer(w, np.float64)) for t, w in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
                found = [(np.full(len(hits), i, np.int64), hits, scores) for i, (hits, scores) in zip(batch.column(0).to_pylist(), index.top(asked, k)) if len(hits)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["query_id", "doc", "score"])


def query_blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id and its (term, weight) list to id, terms and weights (binary)."""
    for batch in batches:
        lists = [sorted((x["term"], x["weight"]) for x in terms) for terms in batch.column(1).to_pylist()]
        t = [np.array([x for x, _ in terms], np.int64).tobytes() for terms in lists]
        w = [np.array([x for _, x in terms], np.float64).tobytes() for terms in lists]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(t, pa.binary()), pa.array(w, pa.binary())], ["id", "terms", "weights"])


def search(docs: DataFrame, queries: DataFrame, k: int = TOP, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The k best documents of every query: query_id, rank, doc_id, score."""
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null").distinct()
    size = text.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    df = text.select("text").mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    df = checkpoint(df.join(asked.mapInArrow(query_terms, "id long, term long, qtf long").select("term").distinct().union(docs.sparkSession.createDataFrame([(0,), (1,)], "term long")), "term"))
    sums = {r["term"]: r["n"] for r in df.where("term < 2").collect()}
    n, mean = sums.get(0, 0), sums.get(1, 0) / max(1, sums.get(0, 0)) or 1.0
    weight = F.col("qtf") * F.log1p((F.lit(float(n)) - F.col("n") + 0.5) / (F.col("n") + 0.5))
    terms = asked.mapInArrow(query_terms, "id long, term long, qtf long").join(df, "term").groupBy("id").agg(F.collect_list(F.struct("term", weight.alias("weight"))).alias("terms"))
    rows = text.mapInArrow(lambda it: document_rows(it, shards), "shard int, id long, terms binary, counts binary").repartitionById(shards, "shard")
    folder = f"{checkpoint_folder(docs.sparkSession)}/queries-{uuid.uuid4().hex}"
    try:
        terms.mapInArrow(query_blobs, "id long, terms binary, weights binary").write.option("parquet.block.size", QUERY_BYTES).parquet(folder)
        files = docs.sparkSession.read.parquet(folder).inputFiles()
        local = rows.mapInArrow(lambda it: search_shard(it, files, mean, k), "query_id long, doc long, score double")
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc")
        best = checkpoint(local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
    finally:
        remove_folder(docs.sparkSession, folder)
    return best.select("query_id", "rank", F.when(F.col("doc") != 2**63 - 1, F.col("doc")).alias("doc_id"), "score")
