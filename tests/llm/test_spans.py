"""Suffix dedup and substring dedup against brute force."""

import hashlib
import os
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from queryloom.llm import _spans, substring_dedup, suffix_dedup


def order(corpus):
    """Null ids first, then by id."""
    return sorted(corpus, key=lambda r: (-(2**63) if r[0] is None else r[0]))


def test_suffix_order_is_the_sorted_one():
    r = random.Random(1)
    strings = [bytes(r.choice(b"ab\xff\x00") for _ in range(r.randint(0, 40))) for _ in range(30)] + [b"abab" * 9] * 3 + [b""]
    ids, size, common = suffix_dedup.collection_order(strings, 250)
    want = sorted((s[k:], i) for i, s in enumerate(strings) for k in range(len(s) + 1))
    assert [(strings[i][len(strings[i]) - n :], i) for i, n in zip(ids, size)] == want

    def shared(a, b):
        return next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))

    assert common.tolist() == [0] + [shared(a[0], b[0]) for a, b in zip(want, want[1:])]


def test_range_min():
    r = np.random.default_rng(2)
    v = r.integers(0, 200, 5000).astype(np.uint8)
    a = r.integers(0, 5000, 400)
    b = np.minimum(a + r.integers(0, 4999, 400), 4999)
    assert suffix_dedup._range_min(v, a, b).tolist() == [v[i : j + 1].min() for i, j in zip(a, b)]


def worker_mb(spark):
    """The most private memory that a Python worker has between tasks."""

    def look(batches):
        for _ in batches:
            pass
        time.sleep(0.2)  # so that each worker gets a task
        with open("/proc/self/status") as f:
            yield pa.RecordBatch.from_arrays([pa.array([int(re.search(r"RssAnon:\s+(\d+)", f.read())[1]) >> 10])], ["mb"])

    return spark.range(0, 16, 1, 16).mapInArrow(look, "mb long").agg({"mb": "max"}).first()[0]


@pytest.mark.skipif(not os.path.exists("/proc/self/status"), reason="reads /proc")
def test_workers_give_memory_back(spark):
    """A worker that has removed repeated words from much text is as small again as before."""
    text = "concat_ws(' ', transform(sequence(1, {}), x -> hex(xxhash64(id, x)))) AS text"
    few = spark.range(0, 40, 1, 4).selectExpr("id AS doc_id", text.format(30))
    many = spark.range(0, 4000, 1, 4).selectExpr("id AS doc_id", text.format(600))
    assert substring_dedup.remove_repeated(few).count() == 40
    before = worker_mb(spark)
    assert substring_dedup.remove_repeated(many).selectExpr("sum(length(text)) AS n").first()[0] > 4000 * 600 * 15
    assert worker_mb(spark) < before + 75


def test_equal_windows_meet_under_one_key():
    shape = _spans.Shape(20, 6, True)
    r = np.random.default_rng(3)
    text = r.integers(0, 3, 3000).astype(np.uint64)
    found = _spans.runs([(0, 0, 0, text)], shape)
    covered = sum(found["n"])
    assert covered == len(text) - 19
    keys = {}
    for k, s, n, a in zip(found["key"], found["start"], found["n"], found["anchor"]):
        for i in range(n):
            w = text[s + i : s + i + 20].tobytes()
            assert keys.setdefault(w, (k, a - i)) == (k, a - i)


def brute_bytes(corpus, width=100, ordered=False):
    seen, out = set(), []
    rows = [(i, t or "") for i, t in corpus]
    rows = rows if ordered else order(rows)
    for i, t in rows:
        b = t.encode()
        gone = np.zeros(len(b) + 1, int)
        for k in range(len(b) - width + 1):
            w = b[k : k + width]
            if w in seen:
                gone[k] += 1
                gone[k + width] -= 1
            seen.add(w)
        gone = np.cumsum(gone[:-1]) > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((i, len(b), int(gone.sum()), int(np.diff(gone.astype(int), prepend=0).clip(0).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def unrepeated(corpus):
    """Without ids that stand twice: a repeated row has a result of its own, tested apart."""
    return [r for r in corpus if [x[0] for x in corpus].count(r[0]) == 1]


@pytest.mark.parametrize("group", [2000, 3])
def test_suffix_dedup(spark, corpus, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)  # 3: most anchors take the way of hot ones
    rows = unrepeated(corpus)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, suffix_dedup.digest(df).collect())) == sorted(brute_bytes(rows))


def test_suffix_dedup_edges(spark, docs, no_docs, corpus):
    got = suffix_dedup.digest(docs).collect()
    assert len(got) == len(corpus)
    twice = [tuple(r) for r in got if r["doc_id"] == 67]
    assert len(twice) == 2 and twice[0] == twice[1] and twice[0][2] == twice[0][1]  # a copy of 60
    assert suffix_dedup.digest(no_docs).collect() == []
    run = spark.createDataFrame([(1, "z" * 5000)], "doc_id long, text string")
    assert suffix_dedup.digest(run).first()["n_removed"] == 4999


@pytest.fixture(scope="module")
def crowd(words):
    """Thousands of different texts under no id, as many under one id; half of them hold one of two passages."""
    r = random.Random(11)
    passages = [" ".join(r.choices(words, k=25)) for _ in range(2)]
    rows = []
    for i in range(5000):
        t = r.choices(words, k=r.randint(8, 16))
        if i % 2:
            t.insert(r.randint(0, len(t)), passages[i % 4 // 2])
        rows.append((None if i % 3 else 7, " ".join(t)))
    return [*rows, rows[1], (3, passages[0]), (9, passages[1] + " and more")]


def tag(text):
    """Orders texts of one id."""
    return np.int64(np.uint64(xxhash.xxh64_intdigest(text.encode(), seed=42) | 1))


def test_suffix_dedup_of_repeated_ids(spark, crowd):
    df = spark.createDataFrame(crowd, "doc_id long, text string").repartition(3)
    one = sorted(set(crowd), key=lambda x: (-(2**63) if x[0] is None else x[0], tag(x[1])))
    key = lambda x: tuple(map(str, x))
    of = dict(zip(one, brute_bytes(one, ordered=True)))
    assert sorted(map(tuple, suffix_dedup.digest(df).collect()), key=key) == sorted((of[x] for x in crowd), key=key)


def test_substring_dedup_of_repeated_ids(spark, crowd):
    df = spark.createDataFrame(crowd, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, substring_dedup.digest(df).collect()), key=str) == sorted(brute_words(crowd), key=str)
    assert sorted(r["text"] for r in substring_dedup.remove_repeated(df).collect() if r["doc_id"] is None) == sorted(t for i, t in crowd if i is None)


def test_known_runs_settle_later_chunks(monkeypatch):
    """Runs that a task meets in many chunks leave it a few times only, in any order of the documents."""
    shape, r = _spans.Shape(20, 6, True), np.random.default_rng(5)
    passage = r.integers(0, 1000, 60).astype(np.uint64)
    known, rows = _spans.Known(), 0
    for k in range(40):
        held = [(d, 0, 0, np.concatenate((r.integers(0, 1 << 40, 30).astype(np.uint64), passage))) for d in r.permutation(1000)[:20].tolist()]
        found = _spans.scan_chunk(held, shape, known)
        rows += int((found[5] > 0).sum())
    firsts = [k for k in range(known.rows.shape[1])]
    assert firsts and rows > 700
    few = _spans.Known(most=4)
    for k in range(8):
        _spans.scan_chunk([(d, 0, 0, passage) for d in (2 * k, 2 * k + 1)], shape, few)
    assert len(few.hash) <= 4 and (np.diff(few.hash.astype(object)) >= 0).all()


def brute_words(corpus, width=13):
    first, out = {}, []
    rows = [(-(2**63) if i is None else i, i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in corpus]
    for key, _, w in rows:
        for k in range(len(w) - width + 1):
            at = tuple(w[k : k + width])
            first[at] = min(first.get(at, key), key)
    for key, i, w in rows:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < key:
                gone[k : k + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_substring_dedup(docs, corpus):
    assert sorted(map(tuple, substring_dedup.digest(docs).collect()), key=str) == sorted(brute_words(corpus), key=str)


def test_substring_dedup_keeps_rows_and_columns(docs, no_docs, corpus):
    got = substring_dedup.remove_repeated(docs)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    have, rows = dict(corpus), got.collect()
    by_id = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(corpus) and by_id[64]["text"] is None and by_id[66]["text"] == " \t\n "
    for i, n, gone, digest in brute_words(corpus):
        text = by_id[i]["text"] if i is not None else None
        if i is not None and gone == 0:
            assert text == have[i]
        elif i is not None:
            assert hashlib.sha256(" ".join(re.findall(r"[^\x20\x09-\x0D]+", text)).encode()).hexdigest() == digest
    assert substring_dedup.remove_repeated(no_docs).collect() == []


def test_long_documents_are_cut_into_pieces_without_loss(monkeypatch):
    monkeypatch.setattr(_spans, "CHUNK", 64)
    text = np.arange(1000, dtype=np.uint64)
    windows = [int(a) for held in _spans.pieces([1], [0], [text], 20) for _, _, at, s in held for a in range(at, at + len(s) - 19)]
    assert sorted(windows) == list(range(981))
