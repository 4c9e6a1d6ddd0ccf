"""Operator 7, embedding near-dedup with a forest of random-projection trees.

Every tree splits the vectors again and again by a random direction at the median of a bounded sample, and vectors
near a split go to both sides (spill overlap). All vectors are routed through all trees; those that meet in a leaf
are compared there as unit vectors of 2-byte components, whose rounding moves a cosine by a proven margin at most:
what lies further than that from the threshold is decided in the leaf, and the few pairs within the margin are written
and verified by the full vectors in double precision.

Links are counted and joined where they are found: a pair that meets in several leaves counts in the first of them,
which the tasks decide from the 2-byte leaf numbers that travel with each vector, so decided pairs are never written.
A leaf yields, per vector, its number of links and the smallest vector that it is connected with in that leaf; connected
components over those follow.

Equal vectors are one class before anything else. A leaf above BLOCK_ROWS is compared in pairs of blocks, so its rows
spread over many tasks and none is left out.

Defined cases: a vector that is null, zero, or holds null or non-finite components is linked with nothing, not even
with its copies; vectors of different lengths are never linked; an empty table gives an empty result; rows that repeat
a vector id are vectors of their own; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.components import components
from evalspark.llm.shared import discard, materialise

THRESHOLD = 0.9
#: Of vectors at the threshold, 0.992 meet in a leaf of one of four trees at depth 11 (0.999 at depth 5).
TREES = 4
#: Sampled vectors that all trees are fitted on (at most; of 64 floats they are 8 MB), and the least of them in a leaf.
SAMPLE, SAMPLE_LEAF = 32_768, 16
#: Rows that a leaf should have before spilling, and the most that are compared in one task: a larger leaf is compared
#: in blocks of this many rows.
LEAF_ROWS, BLOCK_ROWS = 2_000, 4_096
#: Share of a node's vectors on either side of a split that go to both children.
SPILL = 0.08
SEED = 20_240_607


class Forest:
    """Directions, and the bounds between which a vector goes both ways, of all inner nodes of all trees (heap order)."""

    def __init__(self, sample: np.ndarray, depth: int, trees: int = TREES, spill: float = SPILL):
        rng = np.random.default_rng(SEED)
        dim, inner = sample.shape[1], (1 << depth) - 1
        self.depth, self.trees = depth, trees
        self.directions = rng.standard_normal((trees, inner, dim)).astype(np.float32)
        self.low, self.high = np.zeros((trees, inner)), np.zeros((trees, inner))
        for t in range(trees):
            rows = {0: np.arange(len(sample))}
            for node in range(inner):
                here = rows.pop(node)
                p = sample[here] @ self.directions[t, node]
                self.low[t, node], mid, self.high[t, node] = np.quantile(p, [0.5 - spill, 0.5, 0.5 + spill]) if len(p) else (0.0, 0.0, 0.0)
                rows[2 * node + 1], rows[2 * node + 2] = here[p <= mid], here[p > mid]

    def leaves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf that a vector reaches, by row, then leaf; leaves are numbered across trees."""
        at, leaf = [], []
        inner = (1 << self.depth) - 1
        for t in range(self.trees):
            rows = {0: np.arange(len(vectors))}
            for node in range(inner):
                here = rows.pop(node, None)
                if here is None or not len(here):
                    continue
                p = vectors[here] @ self.directions[t, node]
                rows[2 * node + 1], rows[2 * node + 2] = here[p <= self.high[t, node]], here[p >= self.low[t, node]]
            for node, here in rows.items():
                at.append(here)
                leaf.append(np.full(len(here), (t << (self.depth + 1)) + node, dtype=np.uint16))
        at, leaf = np.concatenate(at), np.concatenate(leaf)
        order = np.lexsort((leaf, at))
        return at[order], leaf[order]


def _unit(lists: pa.Array, dim: int) -> np.ndarray:
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def margin(dim: int) -> float:
    """How far the cosine of two rounded unit vectors, summed in 4-byte numbers, can be from the true one: each vector
    is moved by at most 2**-11 of its length (and 2**-25 a component below the smallest normal number)."""
    moved = 2.0**-11 + dim**0.5 * 2.0**-25
    return 2 * moved + moved**2 + dim * 2.0**-23


def _classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vec_id, h1, h2, valid) of every row, and a row per class of equal valid vectors: rep, embedding, copies, dim."""
    v = F.col("embedding").cast("array<double>")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    valid = F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select("vec_id", "embedding", valid.alias("valid"), F.xxhash64(v).alias("h1"), F.xxhash64(F.lit(1), v).alias("h2"))
    # the pair of digests stands for the vector, so that the vectors themselves are not grouped
    good = rows.filter("valid").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies"), F.min_by("embedding", "vec_id").alias("embedding"))
    # classes are told apart by number; the smallest vector id may repeat
    return rows.drop("embedding"), good.select(F.xxhash64("h1", "h2").alias("rep"), "h1", "h2", "copies", "embedding", F.size("embedding").alias("dim"))


def _fit(reps: DataFrame, dim: int, n: int) -> Forest:
    share = SAMPLE / max(n, 1)
    picked = reps.filter(F.col("dim") == dim)
    if share < 1:
        picked = picked.filter(F.pmod(F.xxhash64("rep", F.lit(SEED)), F.lit(1 << 30)) < int(share * (1 << 30)))
    # bounded: the limit only cuts what sampling draws beyond its mean
    rows = picked.select("embedding").limit(SAMPLE).toArrow().column("embedding").combine_chunks()
    rows = rows if isinstance(rows, pa.Array) else rows.chunk(0)
    sample = _unit(rows, dim).astype(np.float32)
    depth = max(0, int(np.ceil(np.log2(max(n, 1) / LEAF_ROWS))))
    return Forest(sample, min(depth, int(np.log2(max(len(sample), SAMPLE_LEAF) / SAMPLE_LEAF))))


def _route(reps: DataFrame, forest: Forest, dim: int) -> DataFrame:
    """(rep, copies, vector, leaves) for every vector: 2-byte components and 2-byte leaf numbers, ascending."""
    shared = reps.sparkSession.sparkContext.broadcast(forest)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 1024):
                part = batch.slice(k, 1024)
                unit = _unit(part.column("embedding"), dim)
                at, leaf = shared.value.leaves(unit.astype(np.float32))
                begin = np.searchsorted(at, np.arange(len(part) + 1))
                packed = [leaf[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)]
                vectors = [u.tobytes() for u in unit.astype("<f2")]
                yield pa.RecordBatch.from_arrays([part.column("rep"), part.column("copies"), pa.array(vectors, pa.binary()), pa.array(packed, pa.binary())], names=["rep", "copies", "vector", "leaves"])

    return reps.filter(F.col("dim") == dim).select("rep", "copies", "embedding").mapInArrow(route, "rep long, copies long, vector binary, leaves binary")


def _blocks(routed: DataFrame) -> np.ndarray:
    """The number of blocks of every leaf; leaves are as many as the forest has, at most 65,536."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, dtype=np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column("leaves").to_pylist()), dtype="<u2"), minlength=1 << 16)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["leaf", "rows"])

    sizes = routed.select("leaves").mapInArrow(count, "leaf long, rows long").groupBy("leaf").agg(F.sum("rows").alias("rows"))
    out = np.ones(1 << 16, dtype=np.int64)
    for row in sizes.filter(F.col("rows") > BLOCK_ROWS).collect():
        out[row["leaf"]] = -(-row["rows"] // BLOCK_ROWS)
    return out


def _cells(routed: DataFrame, blocks: np.ndarray) -> DataFrame:
    """Every vector in each of its leaves, copied to the pairs of blocks (i, j) that it takes part in; own is its block.
    The cell is leaf, i and j in one number."""
    shared = routed.sparkSession.sparkContext.broadcast(blocks)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 512):
                part = batch.slice(k, 512)
                packed = part.column("leaves").to_pylist()
                leaf = np.frombuffer(b"".join(packed), dtype="<u2").astype(np.int64)
                at = np.repeat(np.arange(len(part)), [len(b) // 2 for b in packed])
                n = shared.value[leaf]
                own = part.column("rep").to_numpy()[at] % n
                each = np.repeat(np.arange(len(at)), n)
                other = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                at, leaf, own = at[each], leaf[each], own[each]
                cell = (leaf << 46) + (np.minimum(own, other) << 23) + np.maximum(own, other)
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(own), *(part.column(c).take(take) for c in ("rep", "copies", "vector", "leaves"))], names=["cell", "own", "rep", "copies", "vector", "leaves"])

    return routed.mapInArrow(deal, "cell long, own long, rep long, copies long, vector binary, leaves binary")


_FOUND = "rep long, links long, label long, other long"


def _compare(table: pa.Table) -> pa.Table:
    """Links within one cell: per vector that has any, new links (copies counted) and its label; and the new pairs
    (rep, other) that the margin leaves open."""
    cell = table.column("cell")[0].as_py()
    leaf, i, j = cell >> 46, cell >> 23 & (1 << 23) - 1, cell & (1 << 23) - 1
    table = table.sort_by("rep")
    reps, own = table.column("rep").to_numpy(), table.column("own").to_numpy()
    copies = table.column("copies").to_numpy()
    x = np.frombuffer(b"".join(table.column("vector").to_pylist()), dtype="<f2").reshape(len(reps), -1).astype(np.float32)
    slack = margin(x.shape[1])
    before = [np.frombuffer(b, dtype="<u2") for b in table.column("leaves").to_pylist()]
    before = [b[b < leaf] for b in before]
    links, label = np.zeros(len(reps), dtype=np.int64), np.arange(len(reps))
    edges, open_pairs = [], []
    rows = np.flatnonzero(own == i)
    for a in range(0, len(rows), 256):
        r = rows[a : a + 256]
        cosine = x[r] @ x.T
        hit = cosine >= THRESHOLD - slack
        if i != j:
            hit &= own != i  # pairs within a block belong to that block with itself
        hit[np.arange(len(r)), r] = False
        ii, jj = np.nonzero(hit)
        if not len(ii):
            continue
        sure = cosine[ii, jj] >= THRESHOLD + slack
        edges.append(np.stack((r[ii[sure]], jj[sure])))
        # pairs that met in an earlier leaf were counted there
        ru, cu = np.unique(ii), np.unique(jj)
        names = np.unique(np.concatenate([before[k] for k in np.unique(np.concatenate((r[ru], cu)))]))
        if len(names):
            member = np.zeros((len(reps), len(names)), dtype=np.float32)
            for k in np.unique(np.concatenate((r[ru], cu))):
                member[k, np.searchsorted(names, before[k])] = 1
            met = member[r[ru]] @ member[cu].T > 0
            fresh = ~met[np.searchsorted(ru, ii), np.searchsorted(cu, jj)]
            ii, jj, sure = ii[fresh], jj[fresh], sure[fresh]
        left = ~sure & ((i != j) | (r[ii] < jj))
        open_pairs.append(np.stack((reps[r[ii[left]]], reps[jj[left]])))
        ii, jj = ii[sure], jj[sure]
        np.add.at(links, r[ii], copies[jj])
        if i != j:
            np.add.at(links, jj, copies[r[ii]])
    u, v = np.concatenate(edges, axis=1) if edges else np.zeros((2, 0), dtype=np.int64)
    while True:  # smallest label of every connected vector
        new = label.copy()
        np.minimum.at(new, u, label[v])
        np.minimum.at(new, v, label[u])
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    some = np.unique(np.concatenate((u, v)))
    first, second = np.concatenate(open_pairs, axis=1) if open_pairs else np.zeros((2, 0), dtype=np.int64)
    nothing = lambda n: pa.nulls(n, pa.int64())
    columns = [(reps[some], first), (links[some], None), (reps[label[some]], None), (None, second)]
    sizes = (len(some), len(first))
    return pa.table([pa.chunked_array([nothing(n) if c is None else pa.array(c, pa.int64()) for c, n in zip(pair, sizes, strict=True)]) for pair in columns], names=["rep", "links", "label", "other"])


def _verified(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Of pairs (rep, other), those whose cosine is high enough in double precision, with the copies of both."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                dim = len(batch.column("x")[0])
                cosine = (_unit(batch.column("x"), dim) * _unit(batch.column("y"), dim)).sum(axis=1)
                yield batch.select(["rep", "other", "nx", "ny"]).filter(pa.array(cosine >= THRESHOLD))

    x = reps.select("rep", F.col("copies").alias("nx"), F.col("embedding").alias("x"))
    y = reps.select(F.col("rep").alias("other"), F.col("copies").alias("ny"), F.col("embedding").alias("y"))
    joined = pairs.join(x, "rep").join(y, "other").select("rep", "other", "nx", "ny", "x", "y")
    return joined.mapInArrow(check, "rep long, other long, nx long, ny long")


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors."""
    v = vectors.select(vectors[vec_id].cast("long").alias("vec_id"), vectors[embedding].alias("embedding"))
    rows, reps = _classes(v)
    reps = materialise(reps, "vectors")
    spark = reps.sparkSession
    found, checked = spark.createDataFrame([], _FOUND), spark.createDataFrame([], "rep long, other long, nx long, ny long")
    # lengths of vectors are few: models have one each
    for row in reps.groupBy("dim").count().collect():
        routed = materialise(_route(reps, _fit(reps, row["dim"], row["count"]), row["dim"]), "leaves")
        cells = _cells(routed, _blocks(routed))
        part = materialise(cells.groupBy("cell").applyInArrow(_compare, _FOUND), "leaf-links")
        discard(routed)
        found = found.unionByName(part.filter("other is null"))
        checked = checked.unionByName(_verified(part.filter("other is not null").select("rep", "other"), reps.filter(F.col("dim") == row["dim"])))
    checked = materialise(checked, "margin-links")
    more = checked.select("rep", F.col("ny").alias("links"), F.col("other").alias("label"))
    more = more.unionByName(checked.select(F.col("other").alias("rep"), F.col("nx").alias("links"), F.col("rep").alias("label")))
    found = found.drop("other").unionByName(more)
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("rep").alias("a"), F.col("label").alias("b"))).select(F.col("node").alias("rep"), "component")
    by_class = reps.select("rep", "h1", "h2", "copies").join(linked, "rep", "left").join(labels, "rep", "left")
    by_class = by_class.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component"), F.lit(True).alias("valid"))
    joined = rows.join(by_class, ["h1", "h2", "valid"], "left")
    least = joined.filter("component is not null").groupBy("component").agg(F.min("vec_id").alias("least"))
    out = joined.join(least, "component", "left")
    component_id = F.coalesce("least", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"), F.col("vec_id").eqNullSafe(component_id).alias("kept"))
