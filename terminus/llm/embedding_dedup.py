"""Embedding near-duplicates by a subspace pigeonhole join.

For unit vectors, cosine >= c means squared distance <= 2 - 2c. The vectors are
rotated (a fixed random rotation spreads the distance evenly) and split into
``BLOCKS`` blocks; a block of d_b of the d dimensions has the budget
(2 - 2c) * d_b / d. If a pair keeps within the whole budget, it keeps within the
budget of one block at least, so the union of the blocks' range joins misses
nothing. Each candidate is verified on the whole vectors in double precision.

The range join of a block: its first coordinate is cut into cells as wide as the
block's radius, so partners are in the same or the next cell. A cell is dealt
into chunks of at most about ``CHUNK`` vectors, and a task compares two chunks,
so memory is bounded whatever the cell holds. A pair belongs to the first block
that admits it, hence is counted once although several blocks find it. Tasks
return sums per vector and a spanning forest of their links, never the pairs, so
a group of thousands of copies costs rows in proportion to its members.

The first cell coordinate prunes little when the vectors are spread evenly over
the sphere (few cells are as wide as the radius); the block budgets then save the
verification, not the block comparisons. ``cell_dims`` > 1 makes more and smaller
cells, which pays with more vectors.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terminus.llm.common import written
from terminus.llm.components import components

COSINE = 0.9
BLOCKS = 4
CHUNK = 20_000
TILE = 512
SLACK = 1e-9      # on squared distances in double precision
SLACK32 = 1e-4    # the same in single precision


def rotation(dim: int) -> np.ndarray:
    """A fixed orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def block_edges(dim: int, blocks: int) -> np.ndarray:
    return np.unique(np.linspace(0, dim, min(blocks, dim) + 1).astype(int))


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.stack([np.frombuffer(r, "<f8") for r in raw])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _rotated(x: np.ndarray) -> np.ndarray:
    # einsum adds up every row in the same order whatever the batch, unlike BLAS:
    # all tasks see the same coordinates.
    return np.einsum("ij,kj->ik", x, rotation(x.shape[1]))


def _cells(cosine: float, blocks: int, cell_dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            raw, reps = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for dim in sorted({len(r) // 8 for r in raw}):
                mine = [i for i, r in enumerate(raw) if len(r) // 8 == dim]
                x = _rotated(_unit([raw[i] for i in mine]))
                edges = block_edges(dim, blocks)
                for b, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
                    width = np.sqrt((2 - 2 * cosine) * (hi - lo) / dim) + 1e-6
                    cells = np.floor(x[:, lo:min(hi, lo + cell_dims)] / width).astype(int).tolist()
                    out += [(reps[i], dim, b, c) for i, c in zip(mine, cells, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], t) for i, t in
                 enumerate((pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())))], ["rep", "dim", "block", "cell"])
    return run


def _admits(x: np.ndarray, y: np.ndarray, edges: np.ndarray, b: int, most: float) -> np.ndarray:
    lo, hi = edges[b], edges[b + 1]
    d = x[:, lo:hi] - y[:, lo:hi]
    return np.einsum("ij,ij->i", d, d) <= most * (hi - lo) / edges[-1] + SLACK


def _hook(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Union of the sets of i and j; ``root`` maps straight to the smallest index."""
    while True:
        a, b = root[i], root[j]
        open_ = a != b
        if not open_.any():
            return root
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != root[root]).any():
            root = root[root]


def _links(cosine: float, blocks: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        key = [k.as_py() for k in key]  # dim, block, cell and chunk of both sides
        b, most = key[1], 2 - 2 * cosine
        reps = group.column("rep").to_numpy()
        mult = group.column("mult").to_numpy()
        side = group.column("side").to_numpy()
        x = _unit(group.column("vector").to_pylist())
        r = _rotated(x)
        edges = block_edges(x.shape[1], blocks)
        lo, hi = edges[b], edges[b + 1]
        thin = r[:, lo:hi].astype(np.float32)
        norm = np.einsum("ij,ij->i", thin, thin)
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1)
        same = key[2:4] == key[4:6]
        right = left if same else right
        added, root = np.zeros(len(reps), np.int64), np.arange(len(reps))
        limit = np.float32(most * (hi - lo) / edges[-1] + SLACK32)
        for at in range(0, len(left), TILE):
            rows = left[at:at + TILE]
            cols = right[at:] if same else right
            near = norm[rows][:, None] + norm[cols][None, :] - 2 * (thin[rows] @ thin[cols].T) <= limit
            if same:
                near &= np.arange(len(rows))[:, None] < np.arange(len(cols))[None, :]
            i, j = near.nonzero()
            for part in range(0, len(i), 200_000):
                p, q = rows[i[part:part + 200_000]], cols[j[part:part + 200_000]]
                ok = _admits(r[p], r[q], edges, b, most)
                p, q = p[ok], q[ok]
                ok = np.einsum("ij,ij->i", x[p], x[q]) >= cosine
                for first in range(b):
                    ok &= ~_admits(r[p], r[q], edges, first, most)
                p, q = p[ok], q[ok]
                np.add.at(added, p, mult[q])
                np.add.at(added, q, mult[p])
                root = _hook(root, p, q)
        hit = np.flatnonzero(added)
        return pa.table({"rep": reps[hit], "added": added[hit], "root": reps[root[hit]]})
    return run


def near_embeddings(vectors: DataFrame, cosine: float = COSINE, blocks: int = BLOCKS, chunk: int = CHUNK,
                    cell_dims: int = 1) -> DataFrame:
    """``vectors(vec_id, embedding, ..)`` -> ``vec_id, n_links, component_id,
    kept``, one row per input row.

    A link is a cosine >= ``cosine`` in double precision. Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing, neither
    do vectors of different lengths. Equal vectors are one class and count with
    their number. A row without a vec_id is linked with nothing and is kept.
    Rows that repeat a vec_id count as separate vectors in n_links and share its
    component. Only vec_id and embedding are read. An empty table gives no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    usable = F.coalesce(F.col("vec_id").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda c: c != 0), F.lit(False))
    rows = rows.withColumn("v", F.when(usable, F.transform("v", lambda c: c + F.lit(0.0))))  # -0.0 becomes 0.0

    classes = written(rows.filter("v is not null").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"))
                      .mapInArrow(_packed, "rep bigint, mult bigint, vector binary"))
    cells = written(classes.select("rep", "vector").mapInArrow(
        _cells(cosine, blocks, cell_dims), "rep bigint, dim bigint, block bigint, cell array<bigint>"))
    # A coordinate of a unit vector has at most 2 / width + 2 cells: bounded by
    # the threshold, the blocks and cell_dims, not by the number of vectors.
    sizes = (cells.groupBy("dim", "block", "cell").agg(F.count("*").alias("n"))
             .select("dim", "block", "cell", F.ceil(F.col("n") / chunk).alias("chunks")))
    home = cells.join(F.broadcast(sizes), ["dim", "block", "cell"]).withColumn(
        "own", F.pmod(F.xxhash64("rep"), F.col("chunks")))
    steps = F.array(*[F.array(*[F.lit(x).cast("bigint") for x in s]) for s in itertools.product((-1, 0, 1), repeat=cell_dims)])
    other = sizes.select("dim", "block", F.col("cell").alias("cell2"), F.col("chunks").alias("chunks2"))
    pairs = (sizes.withColumn("step", F.explode(steps))
             .withColumn("cell2", F.zip_with("cell", F.slice("step", 1, F.size("cell")), lambda c, s: c + s))
             .select("dim", "block", "cell", "cell2").distinct().join(other, ["dim", "block", "cell2"]))
    dealt = (home.join(F.broadcast(pairs), ["dim", "block", "cell"])
             .withColumn("partner", F.explode(F.sequence(F.lit(0), F.col("chunks2") - 1)))
             .withColumn("me", F.struct("cell", F.col("own").alias("chunk")))
             .withColumn("you", F.struct(F.col("cell2").alias("cell"), F.col("partner").alias("chunk")))
             .withColumn("side", F.when(F.col("me") <= F.col("you"), 0).otherwise(1))
             .select("rep", "dim", "block", "side", F.least("me", "you").alias("a"), F.greatest("me", "you").alias("b"))
             .select("rep", "side", "dim", "block", F.col("a.cell").cast("string").alias("cell_a"),
                     F.col("a.chunk").alias("chunk_a"), F.col("b.cell").cast("string").alias("cell_b"),
                     F.col("b.chunk").alias("chunk_b")))
    found = written(dealt.join(classes, "rep").groupBy("dim", "block", "cell_a", "chunk_a", "cell_b", "chunk_b")
                    .applyInArrow(_links(cosine, blocks), "rep bigint, added bigint, root bigint"))
    sums = found.groupBy("rep").agg(F.sum("added").alias("added"))
    per_class = classes.join(sums, "rep", "left").select(
        "rep", "vector", (F.col("mult") - 1 + F.coalesce("added", F.lit(0))).alias("n_links"))
    members = written(rows.select("vec_id", "v").mapInArrow(_packed_ids, "vec_id bigint, vector binary")
                      .join(per_class, "vector", "left").select("vec_id", "rep", "n_links"))
    edges = found.select(F.col("rep").alias("a"), F.col("root").alias("b")).union(
        members.filter("rep is not null").select("vec_id", "rep").distinct())
    label = components(edges)
    return (members.join(label.withColumnRenamed("node", "vec_id"), "vec_id", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                    F.coalesce("component", "vec_id").alias("component_id"))
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))


def _bytes(column: pa.Array) -> pa.Array:
    return pa.array([None if v is None else np.asarray(v, "<f8").tobytes() for v in column.to_pylist()], pa.binary())


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), _bytes(b.column(0))], ["rep", "mult", "vector"])


def _packed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), _bytes(b.column(1))], ["vec_id", "vector"])
