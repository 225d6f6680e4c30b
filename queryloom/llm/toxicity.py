"""Toxicity scores by weak supervision.

Voters. Every term (a whole word, or the first 3 to 6 letters of a longer one; lower
case) that labelled training texts show to be typical of toxic ones enters a lexicon;
the lexicons, split by kind of term and by hash, are voters that say "toxic" when a
text holds at least ``hits`` of their terms. Beside them stand pattern voters on form
alone (share of capitals, exclamation marks, masked letters).

Label model. A generative model with one hidden class per text explains the votes: each
voter has its own rates of voting in either class, which say how accurate it is, fitted
by expectation-maximization over all the sampled texts. The given label is one more
voter, whose accuracy is estimated like the others'. Voters are not independent given
the class: each depends on at most one other as well (the spanning forest of the
strongest residual correlations), so these correlations are parameters of the model.

Classifier. Logistic regression over terms is trained on the posterior labels and it
alone scores texts: one pass over the corpus, no shuffle, with a model of a few thousand
weights. Its terms are the lexicons' and, of those that at least 5 sampled texts have, an
eighth as many as there are texts, those that lean most to one class.

Sample. The fit collects at most ``sample`` labelled rows (a documented bound, 12,000
by default), those whose ids hash lowest; scoring covers every text whole.

Defined results: a null text is empty and scores as the classifier's constant says; a
null id is never a training row (its held_out is false); labels that are null or name
no document are unused, of several labels for one id the largest counts; with no
usable labels, or of one class only, every score is the smoothed base rate (0.5 when
there are none). Repeated rows score alike. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queryloom.llm._common import give_back, lean, strings

SAMPLE, THRESHOLD = 12_000, 0.7
WORD = re.compile(r"[^\W_]+")
PREFIXES = (3, 4, 5, 6)
GROUPS = 6
MASK = (1 << 40) - 1
BLOCK = 1 << 19  # term ids of the sample that the fit sorts or looks up at a time


def terms(word: str) -> tuple[int, ...]:
    """Ids of a word and of its beginnings; two low bits and more of an id tell the kind."""
    h = xxhash.xxh3_64_intdigest
    out = [h("w" + word) & MASK]
    out += [h(f"{n}{word[:n]}") & MASK | (k + 1) << 41 for k, n in enumerate(PREFIXES) if len(word) > n]
    return tuple(out)


def form(text: str) -> tuple[bool, ...]:
    """Votes of the pattern voters."""
    n = max(1, len(text))
    return (
        sum(map(str.isupper, text)) > 0.5 * n,
        text.count("!") > 0.01 * n,
        bool(re.search(r"\w[*#$%&]{2,}", text)),
        bool(re.search(r"(?i)\b(you|your|he|she|they)\b.{0,20}\b(is|are|re)\b", text)),
    )


@dataclass
class Model:
    ids: np.ndarray
    weights: np.ndarray
    bias: float
    labels: LabelModel | None = None  # the label model it was trained by

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        z = np.array([self.bias + self.weights[r].sum() for r in rows])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Reader:
    """Texts to sorted places of the model's terms; words met before are looked up."""

    def __init__(self, ids: np.ndarray, cache: int = 600_000) -> None:
        self.place = {int(x): i for i, x in enumerate(ids)}
        self.known: dict[str, tuple[int, ...]] = {}
        self.cache = cache

    def _word(self, word: str) -> tuple[int, ...]:
        got = tuple(self.place[t] for t in terms(word) if t in self.place)
        if len(self.known) >= self.cache:
            self.known.clear()
        self.known[word] = got
        return got

    def __call__(self, text: str) -> np.ndarray:
        found: set[int] = set()
        known = self.known.get
        for word in set(WORD.findall(text.lower())):
            got = known(word)
            if got is None:
                got = self._word(word)
            if got:
                found.update(got)
        return np.array(sorted(found), np.int64)


def sampled(docs: DataFrame, labels: DataFrame, sample: int) -> list[tuple[int, list[int], list[bool]]]:
    """(label, term ids, form votes) of the training rows, at most ``sample``."""
    usable = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id is not null and toxic is not null")
        .where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # The sample is at most `sample` ids and labels (16 bytes each), whatever the size of the tables.
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    @lean
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            ids, votes = [], []
            for t in batch.column(1).to_pylist():
                found: set[int] = set()
                for w in set(WORD.findall(t.lower())):
                    got = seen.get(w)
                    if got is None:
                        if len(seen) > 200_000:
                            seen.clear()
                        got = seen[w] = terms(w)
                    found.update(got)
                ids.append(np.array(sorted(found), np.int64).tobytes())
                votes.append(bytes(form(t)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(votes, pa.binary())], ["toxic", "ids", "form"])

    rows = text.join(F.broadcast(chosen), "doc_id").select("toxic", "text").mapInArrow(read, "toxic int, ids binary, form binary")
    # Copies would pose as evidence: of equal term sets the one with the larger label stays.
    one: dict[bytes, tuple] = {}
    for r in rows.toLocalIterator():
        key = xxhash.xxh3_128_digest(r["ids"])
        if key not in one or one[key][0] < r["toxic"]:
            one[key] = (r["toxic"], np.frombuffer(r["ids"], np.int64), [bool(x) for x in r["form"]])
    return [one[k] for k in sorted(one)]


@dataclass
class LabelModel:
    """P(vote | vote of the parent, class) of each voter; the last voter is the given label."""

    posterior: np.ndarray  # of class 1, for each text
    prior: float
    parent: np.ndarray  # of each voter, -1 for none
    rates: np.ndarray  # voter x vote of the parent x class
    correlation: np.ndarray  # of the voters given the class, signed
    accuracy: np.ndarray  # of each voter: share of texts on which it votes for the likelier class


def dependencies(rest: np.ndarray, free: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Correlations of what the class leaves unexplained, and the spanning forest of the strongest (Chow and Liu).

    Voter ``free`` has no parent and is none.
    """
    m = rest.shape[1]
    scale = np.sqrt((rest**2).sum(0)) + 1e-9
    corr = (rest.T @ rest) / np.outer(scale, scale)
    strength = np.abs(corr)
    np.fill_diagonal(strength, 0)
    strength[free] = strength[:, free] = 0
    parent = np.full(m, -1)
    inside, best, via = np.zeros(m, bool), np.zeros(m), np.full(m, -1)
    for _ in range(m):
        j = int(np.argmax(np.where(inside, -1, best)))
        inside[j], parent[j] = True, via[j] if best[j] > least else -1
        closer = strength[j] > best
        best[closer], via[closer] = strength[j][closer], j
    return corr, parent


def label_model(votes: np.ndarray, given: np.ndarray, start: float = 0.9, rounds: int = 60, rebuilt: int = 3) -> LabelModel:
    """A generative model of the votes with one hidden class a text, fitted by expectation-maximization.

    The given label is a voter like the others: how far it is to be trusted is estimated;
    ``start`` is only where the iteration begins. Each voter's vote depends on the class and on
    the vote of one other, its parent: the correlations of voters are parameters. The
    forest of parents is found anew ``rebuilt`` times, from what the class then leaves
    unexplained; correlations that chance alone may give are left out.
    """
    v = np.column_stack((votes, given > 0.5)).astype(float)
    n, m = v.shape
    p = np.where(given > 0.5, start, 1 - start)
    parent, corr, rates, prior = np.full(m, -1), np.eye(m), np.empty((m, 2, 2)), 0.5
    for step in range(max(1, rebuilt)):
        if rebuilt:  # before the first fit too: voters that echo each other would make a class of their own
            flat = np.stack([((1 - p) @ v + 0.5) / ((1 - p).sum() + 1), (p @ v + 0.5) / (p.sum() + 1)])
            corr, found = dependencies(v - (p[:, None] * flat[1] + (1 - p)[:, None] * flat[0]), m - 1, 4 / np.sqrt(n))
            if step and (found == parent).all():
                break
            parent = found
        above = np.where(parent[None, :] >= 0, v[:, np.maximum(parent, 0)], 0.0)
        for _ in range(rounds):
            for c, w in ((0, 1 - p), (1, p)):
                flat = (w @ v + 0.5) / (w.sum() + 1)  # what a voter does in the class, whatever its parent
                for a, mask in ((0, 1 - above), (1, above)):
                    rates[:, a, c] = (w @ (mask * v) + 2 * flat) / (w @ mask + 2)
            prior = float(np.clip(p.mean(), 1e-3, 1 - 1e-3))
            yes, no = np.log(rates), np.log1p(-rates)
            gain, loss = yes[:, :, 1] - yes[:, :, 0], no[:, :, 1] - no[:, :, 0]
            of = gain[:, 0] * (1 - above) * v + gain[:, 1] * above * v + loss[:, 0] * (1 - above) * (1 - v) + loss[:, 1] * above * (1 - v)
            z = np.log(prior / (1 - prior)) + of.sum(1)
            new = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            moved, p = np.abs(new - p).max(), new
            if moved < 1e-4:
                break
    accuracy = (v * p[:, None] + (1 - v) * (1 - p)[:, None]).mean(0)
    return LabelModel(p, prior, parent, rates, corr, accuracy)


def blocks(rows: list[tuple[int, np.ndarray, list[bool]]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, term id) of all rows, in order, some ``BLOCK`` at a time."""
    first, n = 0, 0
    for k, r in enumerate(rows):
        n += len(r[1])
        if n >= BLOCK or k + 1 == len(rows):
            part = [x[1] for x in rows[first : k + 1]]
            yield np.repeat(np.arange(first, k + 1), [len(x) for x in part]), np.concatenate(part)
            first, n = k + 1, 0


def counted(rows: list[tuple[int, np.ndarray, list[bool]]], y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct term ids, sorted, and for each the number of rows that have it and the sum of their ``y``.

    The driver sorts blocks of the sample, never the whole: beside the rows it holds what is distinct.
    """
    all_ids, held, n = np.zeros(0, np.int64), [], 0
    for _, ids in blocks(rows):
        held.append(np.unique(ids))
        n += len(held[-1])
        if n >= max(BLOCK, len(all_ids)):
            all_ids, held, n = np.unique(np.concatenate((all_ids, *held))), [], 0
    all_ids = np.unique(np.concatenate((all_ids, *held)))
    df, pos = np.zeros(len(all_ids), np.int64), np.zeros(len(all_ids))
    for owner, ids in blocks(rows):
        at = np.searchsorted(all_ids, ids)
        np.add.at(df, at, 1)
        np.add.at(pos, at, y[owner])
    return all_ids, df, pos


def fit(rows: list[tuple[int, np.ndarray, list[bool]]]) -> Model:
    y = np.array([r[0] for r in rows], float)
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1)
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(rate / (1 - rate))))
    all_ids, df, pos = counted(rows, y)
    base = y.mean()
    rate = (pos + base) / (df + 1)
    # Lexicons: clearly over the base rate, with a margin that few mentions can't reach.
    low = rate - 1.5 * np.sqrt(rate * (1 - rate) / (df + 1))
    lexicon = np.flatnonzero((pos >= 4) & (low > max(0.5, 1.5 * base)))
    spread = np.abs(pos - df * base) / np.sqrt(df * base * (1 - base) + 1)
    extra = np.argsort(-spread * (df >= 5), kind="stable")[: max(50, len(rows) // 8)]  # as many as the sample can weigh
    used = np.union1d(lexicon, extra)
    doc, term = [], []
    for owner, ids in blocks(rows):
        at = np.minimum(np.searchsorted(all_ids[used], ids), len(used) - 1)
        in_use = all_ids[used][at] == ids
        doc.append(owner[in_use])
        term.append(at[in_use])
    doc, term = np.concatenate(doc), np.concatenate(term)
    kind = (all_ids[used] >> 41) & 7
    is_lexicon = np.isin(used, lexicon)
    voter = np.where(is_lexicon, kind * GROUPS + all_ids[used] % GROUPS, -1)
    n_voters = (len(PREFIXES) + 1) * GROUPS
    votes = np.zeros((len(rows), n_voters + len(rows[0][2])))
    at = voter[term] >= 0
    np.add.at(votes, (doc[at], voter[term[at]]), 1)
    votes[:, :n_voters] = votes[:, :n_voters] > 0
    votes[:, n_voters:] = [r[2] for r in rows]
    labels = label_model(votes, y)
    weights, bias = logistic(doc, term, labels.posterior, len(rows), len(used))
    return Model(all_ids[used], weights, bias, labels)


def logistic(doc: np.ndarray, term: np.ndarray, target: np.ndarray, n: int, m: int, rounds: int = 600, prior: float = 0.3, balance: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and constant over sparse 0/1 features (adaptive gradient steps, L2 penalty)."""
    # Both classes weigh the same, so that a few clear terms suffice; the penalty fades with the sample.
    share = float(np.clip(target.mean(), 1e-3, 1 - 1e-3))
    weight = target / share**balance + (1 - target) / (1 - share) ** balance
    weight /= weight.sum()
    w, b = np.zeros(m), float(np.log(share / (1 - share)))
    mom, var, mb, vb = np.zeros(m), np.zeros(m), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = b + np.bincount(doc, weights=w[term], minlength=n)
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * weight
        g, gb = np.bincount(term, weights=err[doc], minlength=m) + prior / n * w, err.sum()
        mom, var = 0.9 * mom + 0.1 * g, 0.99 * var + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        step = 0.05 / (1 + t / 100)
        w -= step * (mom / (1 - 0.9**t)) / (np.sqrt(var / (1 - 0.99**t)) + 1e-8)
        b -= step * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    model = fit(sampled(docs, labels, sample))
    give_back()  # the driver lives on, and so would the sample's memory
    return model


def apply(docs: DataFrame, model: Model, threshold: float = THRESHOLD, score_col: str = "score") -> DataFrame:
    """docs with its score (0 to 1) in ``score_col``."""
    at = docs.columns.index("text")
    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])

    @lean
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader(model.ids)
        for batch in batches:
            score = model.score([read(t) for t in strings(batch.column(at))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], [*batch.schema.names, score_col])

    return docs.mapInArrow(work, schema)


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    scored = apply(docs.select("doc_id", "text"), train(docs, labels, sample), threshold)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
