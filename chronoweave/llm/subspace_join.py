"""Near vectors of equal labels by a subspace pigeonhole join.

Unit vectors of cosine ``least`` or more are at a squared distance of ``2 - 2 * least`` at most. Rotated and cut into
blocks of coordinates, two such vectors are, in some block, within that block's share of the squared distance. Each block
is a range join of its own: vectors are dealt by cells of the block's first coordinate, with those near a cell's
border in both cells, and meet by the squared distance in the block. A pair is checked where the first block
finds it, so the union over blocks needs no shuffle and counts no pair twice; the check is the cosine itself. Pairs
are never rows: tasks count links and pass on a spanning set of edges.

Rotated coordinates are whole numbers (fixed point), so all tasks find the same distances; what the rounding may take away is
added to the bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components

LEAST = 0.93
BLOCKS = 8
#: A cell is so many times the block's radius wide.
WIDTH = 4
#: Vectors of a cell that are compared in one task with as many others; larger cells are dealt over several tasks.
MOST = 16_384
#: Vectors that are compared with the others of their cell at once.
CHUNK = 512
UNIT = 1 << 20
SEED = 7


def comparable(vector: Column) -> Column:
    """Whether a vector has a direction: not null, not zero, all components there and finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows at length 1. Sums go column by column, so that a row's result does not depend on the rows beside it."""
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    total = np.zeros(len(x))
    for column in x.T:
        total += column * column
    return x / np.sqrt(total)[:, None]


def rotated(x: np.ndarray) -> np.ndarray:
    """Rows turned by random signs and Hadamard transforms, twice, as whole multiples of 1 / UNIT; padded to a power of two."""
    n, d = x.shape
    size = 1 << max(0, d - 1).bit_length()
    y = np.zeros((n, size))
    y[:, :d] = x
    rng = np.random.default_rng(SEED)
    for _ in range(2):
        y = y * rng.choice([-1.0, 1.0], size)
        step = 1
        while step < size:
            pairs = y.reshape(n, -1, 2, step)
            y = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, size)
            step *= 2
        y = y / np.sqrt(size)
    return np.rint(y * UNIT)


def cuts(size: int, blocks: int) -> list[tuple[int, int]]:
    """Beginnings and ends of blocks of about equal numbers of coordinates."""
    ends = [size * i // min(blocks, size) for i in range(min(blocks, size) + 1)]
    return list(zip(ends, ends[1:]))


def radii(size: int, blocks: int, least: float) -> list[float]:
    """Each block's radius in units of UNIT: the root of its share of the squared distance, and what rounding may add."""
    return [UNIT * np.sqrt((2 - 2 * least) * (b - a) / size) + 2 * np.sqrt(b - a) for a, b in cuts(size, blocks)]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _cells(classes: DataFrame, blocks: int, least: float) -> DataFrame:
    """Rows ``(c, n, label, dim, block, cell, home, v)``: each vector in its cell of each block, and as a guest in the cells whose border is near."""
    element = classes.schema["v"].dataType.elementType.simpleString()
    kind = np.float32 if element == "float" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(3).to_numpy()
            for dim in np.unique(dims):
                for some in np.array_split(np.flatnonzero(dims == dim), -(-int((dims == dim).sum()) * int(dim) // (1 << 20))):
                    yield from laid(batch.take(pa.array(some)))

    def laid(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        v = _matrix(batch.column(4)).astype(kind)
        y = rotated(units(v))
        raw = pa.array([r.tobytes() for r in v], pa.binary())
        for block, ((first, _), radius) in enumerate(zip(cuts(y.shape[1], blocks), radii(y.shape[1], blocks, least))):
            width = int(WIDTH * radius)
            at = y[:, first].astype(np.int64)
            home = at // width
            inside = at - home * width
            everyone = np.arange(len(v))
            low, high = everyone[inside <= radius], everyone[inside >= width - radius - 1]
            who = np.concatenate([everyone, low, high])
            cell = np.concatenate([home, home[low] - 1, home[high] + 1])
            rows = pa.array(who)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), batch.column(2).take(rows), batch.column(3).take(rows), pa.array(np.full(len(who), block, np.int32)), pa.array(cell), pa.array(np.arange(len(who)) < len(v)), raw.take(rows)],
                names=["c", "n", "label", "dim", "block", "cell", "home", "v"],
            )

    label = classes.schema["label"].dataType.simpleString()
    return classes.select("c", "n", "label", "dim", "v").mapInArrow(run, f"c long, n long, label {label}, dim int, block int, cell long, home boolean, v binary")


def _tiled(cells: DataFrame, most: int) -> DataFrame:
    """``cells`` with the tile ``(left, right)`` in which a row is compared, and its roles there; cells of more than ``most`` rows are several tiles."""
    by = ["label", "dim", "block", "cell"]
    large = materialize(cells.groupBy(*by).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > most).select(*by, F.ceil(F.col("rows") / most).cast("int").alias("tiles")), "large-cells")
    zero = F.lit(0)
    if large.isEmpty():
        return cells.withColumns({"left": zero, "right": zero, "asks": F.col("home"), "answers": F.lit(True)})
    sized = cells.join(large, by, "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    own, every = F.pmod(F.xxhash64("c"), F.col("tiles")).cast("int"), F.sequence(zero, F.col("tiles") - 1)
    tile = lambda left, right, asks: F.struct(left.alias("left"), right.alias("right"), asks.alias("asks"), (right == own).alias("answers"))
    asking = F.when(F.col("home"), F.transform(every, lambda i: tile(own, i, F.lit(True)))).otherwise(F.array().cast("array<struct<left:int,right:int,asks:boolean,answers:boolean>>"))
    others = F.filter(F.transform(every, lambda i: tile(i, own, F.lit(False))), lambda t: ~(F.col("home") & (t["left"] == own)))
    return sized.select(*cells.columns, F.inline(F.concat(asking, others)))


class _Block:
    """A block's coordinates of some vectors, laid out so that one product tells which pairs are within the block's radius: ``ab - (aa + bb) / 2`` is minus half the squared distance, exactly."""

    def __init__(self, y: np.ndarray, radius: float) -> None:
        half, one = (y * y).sum(1, keepdims=True) / 2, np.ones((len(y), 1))
        self.asking, self.answering, self.limit = np.hstack([y, -half, one]), np.hstack([y, one, -half]), -radius * radius / 2

    def near(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        return self.asking[rows] @ self.answering[columns].T >= self.limit


def _met(laid: list[_Block], ids: np.ndarray, x: np.ndarray, rows: np.ndarray, columns: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Links between ``rows`` and ``columns`` that the last of the blocks is the first to find: the rows and columns that may have any, and the matrix of them."""
    near = laid[-1].near(rows, columns)
    some, others = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
    if not len(some):
        return None
    near, rows, columns = near[np.ix_(some, others)], rows[some], columns[others]
    near &= ids[rows][:, None] != ids[columns][None, :]
    for before in laid[:-1]:
        near &= ~before.near(rows, columns)
    near &= x[rows] @ x[columns].T >= least
    return rows, columns, near


def _spanning(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Pairs of a linked id and the least id that its links lead to, inside ``near``."""
    a, b, last = left.copy(), right.copy(), np.iinfo(np.int64).max
    while True:
        a2 = np.minimum(a, np.where(near, b[None, :], last).min(1))
        b2 = np.minimum(b, np.where(near, a2[:, None], last).min(0))
        if (a2 == a).all() and (b2 == b).all():
            return np.concatenate([np.stack([left, a], 1)[a != left], np.stack([right, b], 1)[b != right]])
        a, b = a2, b2


def _links(tiles: DataFrame, element: str, blocks: int, least: float) -> DataFrame:
    """Rows ``(c, links, other)``: how many vectors a class is linked with in a tile, or an edge to another class."""
    import pandas as pd

    kind = np.float32 if element == "float" else np.float64

    def compare(t: pd.DataFrame) -> pd.DataFrame:
        block = int(t["block"].iloc[0])
        ids, n = t["c"].to_numpy(np.int64), t["n"].to_numpy(np.int64)
        x = units(np.frombuffer(b"".join(t["v"]), kind).reshape(len(t), -1))
        y = rotated(x)
        size = y.shape[1]
        laid = [_Block(y[:, a:b], r) for (a, b), r in zip(cuts(size, blocks)[: block + 1], radii(size, blocks, least))]
        # By the block's first coordinate only those within its radius of a chunk come into question.
        first, radius = y[:, cuts(size, blocks)[block][0]], radii(size, blocks, least)[block]
        order = np.argsort(first, kind="stable")
        asks, answers = order[t["asks"].to_numpy()[order]], order[t["answers"].to_numpy()[order]]
        links, edges = np.zeros(len(t), np.int64), [np.zeros((0, 2), np.int64)]
        for at in range(0, len(asks), CHUNK):
            some = asks[at : at + CHUNK]
            low, high = np.searchsorted(first[answers], [first[some[0]] - radius, first[some[-1]] + radius + 1])
            met = _met(laid, ids, x, some, answers[low:high], least)
            if met is None:
                continue
            rows, columns, near = met
            links[rows] += near @ n[columns]
            rows, columns, near = rows[near.any(1)], columns[near.any(0)], near[near.any(1)][:, near.any(0)]
            if len(rows):
                edges.append(_spanning(near, ids[rows], ids[columns]))
        found, edges = np.flatnonzero(links), np.unique(np.concatenate(edges), axis=0)
        return pd.DataFrame({"c": np.concatenate([ids[found], edges[:, 0]]), "links": np.concatenate([links[found], np.zeros(len(edges), np.int64)]), "other": np.concatenate([ids[found], edges[:, 1]])})

    return tiles.groupBy("label", "dim", "block", "cell", "left", "right").applyInPandas(compare, "c long, links long, other long")


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = LEAST, blocks: int = BLOCKS, most: int = MOST) -> DataFrame:
    """``(key, n_links, component_id, kept)`` of each row: how many others it links with, and the least key that links lead to.

    Vectors of equal labels and lengths link at a cosine of ``least`` or more, in double precision. A null label, a null or zero
    vector, and one with a null or non-finite component link with nothing; such a row is a component of its own. Equal
    vectors are compared once, with their number. Rows that share a key are vectors of their own; a null key takes part, but
    names a component only where no other does. ``kept`` marks the row that names its component. An empty table
    gives an empty one. Further columns are ignored.
    """
    element = vectors.schema[vector].dataType.elementType.simpleString()
    v, dim = F.col(vector), F.size(vector)
    good = comparable(v) & F.col(label).isNotNull()
    marks = {"dim": F.when(good, dim), "h1": F.when(good, F.xxhash64(v)), "h2": F.when(good, F.xxhash64(F.lit(1), v))}
    rows = vectors.select(F.col(key).alias("key"), F.col(label).alias("label"), v.alias("v"), *[c.alias(k) for k, c in marks.items()])
    by = ["label", "dim", "h1", "h2"]
    classes = rows.where("dim is not null").groupBy(*by).agg(F.first("v").alias("v"), F.min("key").alias("least_key"), F.count(F.lit(1)).alias("n"))
    classes = materialize(classes.withColumn("c", F.monotonically_increasing_id()), "vectors")
    found = materialize(_links(_tiled(_cells(classes, blocks, least), most), element, blocks, least), "vector-links")
    links = found.where("links > 0").groupBy("c").agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("links = 0").select(F.col("c").alias("a"), F.col("other").alias("b"))).withColumnRenamed("v", "c")
    led = classes.select(*by, "c", "n", "least_key").join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))
    led = materialize(led.join(links, "c", "left").select(*by, "root", "least_key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "vectors-linked")
    names = led.groupBy("root").agg(F.min("least_key").alias("component_id"))
    told = led.join(names, "root").select(*by, "n_links", "component_id")
    out = rows.select("key", *by).join(told, by, "left")
    component = F.coalesce("component_id", "key")
    return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("key").eqNullSafe(component).alias("kept"))


#: For tables of some thousand rows: all pairs of a label.
OP12_SQL = """WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.93 ELSE FALSE END),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a), c AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, c.m AS component_id, vec_id = c.m AS kept FROM embeddings LEFT JOIN n ON vec_id = n.a LEFT JOIN c ON vec_id = c.a"""
