"""Near-duplicate embeddings by a forest of random-projection trees with spill.

1. Vectors that are equal in every component (and in label) collapse to one
   representative with a weight.
2. In each tree a node (at the root: a label and a dimension) has a random direction.
   Its vectors are projected, the node's count, mean and deviation are aggregated over
   all of them, and the node splits at the mean; what lies within ``spill`` deviations
   of the cut goes to both sides. A node becomes a leaf when it has at most ``leaf``
   vectors, or when it is dense: its spread is that of vectors which all link, and to
   split it would only lose links.
3. Leaves are compared exactly, in blocks of at most ``leaf`` rows; a larger, dense
   leaf is the set of its block pairs, so no task ever holds more than two blocks.
   A pair that shares several leaves belongs to the first of them, so links are
   counted once without writing a single pair out; what leaves a block pair are link
   counts and the edges of a spanning forest.
4. Components of the forest edges.

Defined results: a null id is an id before all others and comes back as null; a vector
that is null, zero, or has null or non-finite components, or whose label is null, has no
links; rows that repeat an id, or have none, are vectors of their own (a component is
named by its smallest id, so different ones may then bear one name); an empty table gives
an empty result; other columns are ignored and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queryloom.llm._common import checkpoint, inner_id, outer_id, shuffle_width
from queryloom.llm.components import components

SIMILARITY, TREES, LEAF, SPILL, DENSE = 0.93, 5, 384, 0.3, 0.15


def unit(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def vectors(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """id, label, embedding to id, label, vec (bytes, null if unusable)."""
    for batch in batches:
        out = []
        for x in batch.column(2).to_pylist():
            v = None if x is None or not len(x) or any(y is None for y in x) else np.array(x, kind) + 0  # makes -0 equal to 0
            ok = v is not None and np.isfinite(v).all() and 0 < float(v.astype(np.float64) @ v) < np.inf
            out.append(v.tobytes() if ok else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["id", "label", "vec"])


def direction(node: int, dim: int) -> np.ndarray:
    r = np.random.default_rng(node & (2**64 - 1)).standard_normal(dim)
    return r / np.linalg.norm(r)


def project(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """rep, vec, nodes to rep, node, p (projection on the node's direction), dim."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column(2)
        node = lists.flatten().to_numpy()
        row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
        raw = batch.column(1).to_pylist()
        dims = np.array([len(v) for v in raw]) // np.dtype(kind).itemsize
        x = {int(d): (np.cumsum(dims == d) - 1, unit([v for v, e in zip(raw, dims) if e == d], kind)) for d in np.unique(dims)}
        p = np.zeros(len(node))
        order = np.argsort(node, kind="stable")
        cuts = np.flatnonzero(np.append(True, np.diff(node[order]) != 0))
        for s, e in zip(cuts, np.append(cuts[1:], len(order))):
            at = order[s:e]
            place, y = x[int(dims[row[at[0]]])]
            p[at] = y[place[row[at]]] @ direction(int(node[at[0]]), y.shape[1])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(node), pa.array(p), pa.array(dims[row].astype(np.int32))], ["rep", "node", "p", "dim"])


def leaves(reps: DataFrame, trees: int, leaf: int, spill: float, kind: str) -> DataFrame:
    """(rep, node) of all leaves of all trees. Only ids go from level to level; the vectors stay in ``reps``."""
    tree = F.explode(F.array(*(F.lit(t) for t in range(trees))))
    state = reps.select("rep", "label", F.length("vec").alias("n"), tree.alias("tree")).select("rep", F.xxhash64("label", "n", "tree").alias("node"))
    closed = None
    while True:
        at_vector = reps.select("rep", "vec").join(state.groupBy("rep").agg(F.collect_list("node").alias("nodes")), "rep")
        rows = checkpoint(at_vector.mapInArrow(lambda it: project(it, kind), "rep long, node long, p double, dim int"))
        if rows.isEmpty():
            return closed if closed is not None else rows.select("rep", "node")
        stats = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean"), F.stddev_pop("p").alias("dev"), F.first("dim").alias("d"))
        stats = stats.select("node", "mean", "dev", ((F.col("n") <= leaf) | (F.col("dev") ** 2 * F.col("d") < DENSE)).alias("ends"))
        joined = rows.join(stats, "node")
        done = joined.where("ends").select("rep", "node")
        closed = done if closed is None else closed.unionByName(done)
        live, margin = joined.where("not ends"), F.lit(spill) * F.col("dev")
        low = live.where(F.col("p") <= F.col("mean") + margin).select("rep", F.xxhash64("node", F.lit(0)).alias("node"))
        high = live.where(F.col("p") >= F.col("mean") - margin).select("rep", F.xxhash64("node", F.lit(1)).alias("node"))
        state = low.unionByName(high)


def compare(batches: Iterator[pa.RecordBatch], similarity: float, kind: str) -> Iterator[pa.RecordBatch]:
    """Block pairs, sorted by (node, i, j), to rep, links (weighted), other (a forest edge's end, or null).

    Of a block pair with i < j only pairs across the blocks are compared.
    """

    def work(rows: list[tuple]) -> list[tuple[int, int, int | None]]:
        _, i, j = rows[0][:3]
        rep = np.array([r[4] for r in rows])
        block = np.array([r[3] for r in rows])
        weight = np.array([r[6] for r in rows])
        x = unit([r[5] for r in rows], kind)
        near = x @ x.T >= similarity
        np.fill_diagonal(near, False)
        if i != j:
            near &= block[:, None] != block[None, :]
        if not near.any():
            return []
        # A pair belongs to the first leaf that both are in.
        node, earlier = rows[0][0], {}
        for k in np.flatnonzero(near.any(1)):
            for other in rows[k][7]:
                if other < node:
                    earlier.setdefault(other, []).append(k)
        for members in earlier.values():
            if len(members) > 1:
                near[np.ix_(members, members)] = False
        links = near @ weight
        out = [(int(rep[k]), int(links[k]), None) for k in np.flatnonzero(links)]
        parent = list(range(len(rows)))

        def find(a: int) -> int:
            while parent[a] != a:
                parent[a] = a = parent[parent[a]]
            return a

        for a, b in zip(*(v.tolist() for v in np.nonzero(np.triu(near)))):
            if (u := find(a)) != (v := find(b)):
                parent[max(u, v)] = min(u, v)
                out.append((int(rep[a]), 0, int(rep[b])))
        return out

    held: list[tuple] = []
    for batch in batches:
        out = []
        for row in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns))):
            if held and held[0][:3] != row[:3]:
                out += work(held)
                held = []
            held.append(row)
        if out:
            yield _links(out)
    if held and (out := work(held)):
        yield _links(out)


def _links(rows: list[tuple]) -> pa.RecordBatch:
    a, b, c = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64())], ["rep", "links", "other"])


def near_duplicates(table: DataFrame, similarity: float = SIMILARITY, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of table: vec_id, n_links, component_id, kept."""
    # Single-precision input is kept as it is and widened where it is compared: the same numbers in half the bytes.
    kind = "f4" if table.schema[vector_col].dataType.simpleString() == "array<float>" else "f8"
    source = table.select(inner_id(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast(f"array<{'float' if kind == 'f4' else 'double'}>").alias("embedding"))
    vec = checkpoint(source.mapInArrow(lambda it: vectors(it, kind), "id long, label string, vec binary"))
    usable = vec.where("label is not null and vec is not null")
    # A representative has a number of its own: ids may be missing or stand on several vectors.
    reps = checkpoint(usable.groupBy("label", "vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight")).withColumn("rep", F.monotonically_increasing_id()))
    leaf_rows = checkpoint(leaves(reps, trees, leaf, spill, kind))
    sizes = leaf_rows.groupBy("node").count()
    of_rep = leaf_rows.groupBy("rep").agg(F.collect_set("node").alias("nodes"))
    blocks = F.ceil(F.col("count") / leaf).cast("int")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    rows = leaf_rows.join(sizes.where("count > 1"), "node").withColumn("blocks", blocks).withColumn("own", own)
    rows = rows.withColumn("partner", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("i", F.least("own", "partner")).withColumn("j", F.greatest("own", "partner"))
    rows = rows.join(of_rep, "rep").join(reps.select("rep", "vec", "weight"), "rep").select("node", "i", "j", "own", "rep", "vec", "weight", "nodes")
    width = shuffle_width(table.sparkSession)
    found = checkpoint(rows.repartition(width, "node", "i", "j").sortWithinPartitions("node", "i", "j").mapInArrow(lambda it: compare(it, similarity, kind), "rep long, links long, other long"))
    links = found.where("links > 0").groupBy("rep").agg(F.sum("links").alias("links"))
    comp = components(found.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    rooted = checkpoint(reps.join(links, "rep", "left").join(comp, F.col("rep") == F.col("node"), "left").select("label", "vec", "id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root")))
    of_set = rooted.join(rooted.groupBy("root").agg(F.min("id").alias("component")), "root").select("label", "vec", "n_links", "component")
    out = vec.join(of_set, ["label", "vec"], "left").select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "id").alias("component"))
    return out.select(outer_id("id").alias("vec_id"), "n_links", outer_id("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
