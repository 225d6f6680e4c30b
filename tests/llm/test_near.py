"""SimHash and embedding near-dedup, and components, against brute force."""

import random

import numpy as np
import pytest
import xxhash

from queryloom.llm import embedding_dedup, simhash_dedup
from queryloom.llm.components import components


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, i) for i in range(5001, 5400)]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = roots({n for e in edges for n in e}, edges)
    assert got == {n: want[n] for n in {n for a, b in edges if a != b for n in (a, b)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def near(words, r):
    rows, at = [], 0
    for size in (1, 1, 2, 3, 8, 30):
        base = r.choices(words, k=200)
        for _ in range(size):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 2])):
                t[r.randrange(len(t))] = r.choice(words)
            rows.append((at, " ".join(t)))
            at += 1
    return rows


@pytest.mark.parametrize("bucket", [2048, 4])
def test_simhash_classes(spark, words, monkeypatch, bucket):
    monkeypatch.setattr(simhash_dedup, "BUCKET", bucket)  # 4: buckets are split by further bits
    rows = near(words, random.Random(8)) + [(900, None), (901, ""), (902, "!!!"), (903, "one two"), (904, "One, two")]
    r = random.Random(9)
    r.shuffle(rows)
    sh = simhash_dedup.Shingles()
    sets = {i: set(sh(t or "").tolist()) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = roots(sets, links)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, doc string")
    got = simhash_dedup.classes(df).collect()
    assert {x["doc_id"]: x["class_id"] for x in got} == want
    assert all(x["kept"] == (x["doc_id"] == x["class_id"]) and x["class_size"] == list(want.values()).count(x["class_id"]) for x in got)
    if bucket > 4:
        kept = simhash_dedup.keep_one(df)
        assert kept.columns == df.columns and sorted(x["doc_id"] for x in kept.collect()) == sorted(set(want.values()))


def by_signature(rows):
    """Classes by brute force over the pairs that share a bucket and are within the distance."""
    sh, m = simhash_dedup.Shingles(), simhash_dedup
    sets = {i: sh(t) for i, t in rows}
    sigs = np.stack([m.simhash(s) for s in sets.values()])
    bits = np.unpackbits(sigs.view(np.uint8), axis=1)
    keys = [bits[:, m.coordinates(t, m.BITS)[: m.SAMPLED]] for t in range(m.TABLES)]
    ids, own, links = list(sets), [set(s.tolist()) for s in sets.values()], []
    for x in range(len(ids)):
        near = np.bitwise_count(sigs ^ sigs[x]).sum(1) <= m.DISTANCE
        near &= np.any([(k == k[x]).all(1) for k in keys], 0)
        links += [(ids[x], ids[y]) for y in np.flatnonzero(near) if y > x and len(own[x] & own[y]) >= 0.8 * len(own[x] | own[y])]
    return roots(ids, links), len(links)


def family(r, n, planted):
    """Texts on one template at Jaccard 0.78, the first of them with a partner at 0.81."""
    own = lambda k: [f"u{r.getrandbits(40):x}" for _ in range(k)]
    common = own(200)
    tails = [own(28) for _ in range(n)]
    for k in range(planted):
        tails.append(tails[k][:5] + own(23))
    rows = [(i, " ".join(common + tail)) for i, tail in enumerate(tails)]
    r.shuffle(rows)
    return rows


def test_simhash_family_below_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "BLOCK_BYTES", 1 << 16)  # several blocks in a bucket
    rows = family(random.Random(3), 1200, 60)
    want, links = by_signature(rows)
    assert links >= 50
    got = {x["doc_id"]: x["class_id"] for x in simhash_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_simhash_family_in_split_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "BUCKET", 16)
    rows = family(random.Random(4), 300, 60)
    want, links = by_signature(rows)
    assert links >= 50
    got = {x["doc_id"]: x["class_id"] for x in simhash_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_simhash_edges(spark, docs, no_docs, corpus):
    got = simhash_dedup.classes(docs).collect()
    assert len(got) == len(corpus)
    cls = {x["doc_id"]: x["class_id"] for x in got if x["doc_id"] is not None}
    assert cls[60] is None and cls[61] is None and cls[67] is None  # the row without an id comes first
    assert simhash_dedup.classes(no_docs).collect() == [] and simhash_dedup.keep_one(no_docs).collect() == []


def ranked(rows):
    """Rows in the order in which they name and keep: ids (none first), then the hash of the text."""
    return sorted(rows, key=lambda x: (-(2**63) if x[0] is None else x[0], np.int64(np.uint64(xxhash.xxh64_intdigest(x[1].encode(), seed=42)))))


def test_simhash_of_repeated_ids(spark, words):
    """Thousands of rows without an id and of one id: each has the class of its own text."""
    r, rows = random.Random(21), []
    for k in range(2500):
        t = r.choices(words, k=40)
        near = [*t[:-1], "changed"]
        rows.append((None if k % 2 else 7, " ".join(t)))
        if k % 5 == 0:
            rows.append((None if k % 3 else 7, " ".join(near)))
        if k % 50 == 0:
            rows.append((k + 100, " ".join(t)))
    rows += [rows[0], rows[0], (None, ""), (None, "")]
    order = ranked(rows)
    stem, classes = lambda t: " ".join(t.split()[:39]), {}
    for k, x in enumerate(order):
        classes.setdefault(stem(x[1]) or k, []).append(x)
    want = [(x[0], c[0][0], len(c), x == c[0]) for k, c in classes.items() for x in c]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, doc int, _th int").repartition(3)
    got = [tuple(x) for x in simhash_dedup.classes(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = simhash_dedup.keep_one(df)
    assert kept.columns == df.columns and sorted((x["doc_id"], x["text"]) for x in kept.where("text != ''").collect() if x["doc_id"]) == sorted(c[0] for c in classes.values() if c[0][0])
    assert sorted(x["text"] for x in kept.collect() if x["doc_id"] is None) == sorted(c[0][1] for k, c in classes.items() if c[0][0] is None)


def test_similarity_of_signatures():
    r = np.random.default_rng(1)
    a = r.integers(0, 2**63, 1000).astype(np.uint64)
    b = np.concatenate((a[:900], r.integers(0, 2**63, 100).astype(np.uint64)))
    d = np.bitwise_count(simhash_dedup.simhash(a) ^ simhash_dedup.simhash(b)).sum()
    assert 10 < d < 60 and (simhash_dedup.simhash(a) == simhash_dedup.simhash(a[::-1].copy())).all()


@pytest.mark.parametrize("leaf", [384, 16])
def test_embedding_links(spark, leaf):
    r = np.random.default_rng(6)
    rows, at = [], 0
    for size in (1, 1, 1, 2, 3, 60, 5):
        for _ in range(8 if size < 60 else 1):
            base = r.standard_normal(32)
            for _ in range(size):
                rows.append((at, (base + 0.08 * r.standard_normal(32)).astype(np.float32).tolist(), int(at % 3 == 0) if size == 1 else 2))
                at += 1
    rows += [(900, rows[0][1], rows[0][2]), (901, [0.0] * 32, 1), (902, None, 1), (903, [float("nan")] * 32, 1), (904, rows[0][1], None), (905, [1.0] * 4, 1), (906, [2.0] * 4, 1)]
    x = {i: np.array(v, float) for i, v, l in rows if v is not None and l is not None}
    label = {i: l for i, v, l in rows}
    ok = [i for i, v in x.items() if np.isfinite(v).all() and v.any()]
    links = [(a, b) for a in ok for b in ok if a < b and label[a] == label[b] and len(x[a]) == len(x[b]) and x[a] @ x[b] / np.sqrt((x[a] @ x[a]) * (x[b] @ x[b])) >= 0.93]
    want = roots([i for i, _, _ in rows], links)
    degree = {i: sum(i in e for e in links) for i in want}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {g["vec_id"]: (g["n_links"], g["component_id"], g["kept"]) for g in embedding_dedup.near_duplicates(df, leaf=leaf).collect()}
    wrong = [i for i in want if got[i] != (degree[i], want[i], want[i] == i)]
    assert len(got) == len(rows) and not wrong, wrong
    assert embedding_dedup.near_duplicates(df.limit(0)).collect() == []


def test_embedding_links_of_repeated_ids(spark):
    """Thousands of rows without an id and of one id are vectors of their own."""
    r = np.random.default_rng(16)
    rows = []
    for k in range(2000):
        base = r.standard_normal(24)
        for _ in range(1 + (k % 4 == 0)):
            rows.append((None if k % 2 else 3, (base + 0.05 * r.standard_normal(24)).astype(np.float32).tolist(), k % 5))
    rows += [rows[0], (8, rows[1][1], rows[1][2]), (9, rows[8][1], None)]
    x = np.array([v for _, v, _ in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([-1 - i if l is None else l for i, (_, _, l) in enumerate(rows)])
    near = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    root = roots(range(len(rows)), zip(*(v.tolist() for v in np.nonzero(np.triu(near)))))
    of = lambda i: -(2**63) if i is None else i
    least = {}
    for k, c in root.items():
        least[c] = min(least.get(c, 2**63), of(rows[k][0]))
    out = lambda i: None if i == -(2**63) else i
    want = [(i, int(near[k].sum()), out(least[root[k]]), of(i) == least[root[k]]) for k, (i, _, _) in enumerate(rows)]
    df = spark.createDataFrame([(*t, 1, 2) for t in rows], "vec_id long, embedding array<float>, label int, rep int, weight int")
    assert sorted(map(tuple, embedding_dedup.near_duplicates(df).collect()), key=str) == sorted(want, key=str)
