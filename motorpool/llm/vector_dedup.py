"""Near copies among embeddings: inverted lists with product-quantised residuals.

Vectors of a label fall into the cells of a coarse quantiser. A pair at the least cosine lies at a known distance, so
a vector has to look into another cell only if it lies that close to the plane between the two centres: these probes
are sufficient. Inside a cell the residual of each vector to the centre is coded by sub-vectors; a query adds up table
entries for the codes, plus the length of what the code leaves out, and so bounds the cosine from above. What passes
is decided by the exact cosine in double precision. Nothing is lost on the way; the quantisers only decide the cost.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motorpool.llm.common import written
from motorpool.llm.graph import components

LEAST = 0.93
# Vectors the quantisers are fitted on, chosen by hash; every vector is then indexed.
SAMPLE = 20_000
# Vectors aimed at for a cell, and sampled vectors a centre needs.
CELL, PER_CENTRE = 1024, 8
SUBSPACES, CODES = 8, 256
# Vectors of a cell compared by one task; larger cells are cut into blocks, and every query visits all of them.
BLOCK = 4096
QUERIES = 64
# Vectors whose probes are worked out at once.
PROBED = 1024


def centres(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Lloyd's k-means from evenly spaced rows; a centre without members stays where it is."""
    k = min(k, len(x))
    found = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = nearest(x, found)
        count = np.bincount(own, minlength=k)
        total = np.zeros_like(found)
        np.add.at(total, own, x)
        found[count > 0] = total[count > 0] / count[count > 0, None]
    return found


def nearest(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    return ((points * points).sum(axis=1) - 2 * x @ points.T).argmin(axis=1)


def _units(x: np.ndarray) -> np.ndarray:
    # Scaled first, so that very large and very small components neither overflow nor vanish.
    scaled = x / np.abs(x).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))


@dataclass
class Quantiser:
    """Cells of one label and the codes of residuals, for vectors of one width."""

    coarse: np.ndarray
    books: np.ndarray  # subspaces x codes x dimensions of a subspace

    def probes(self, unit: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """The own cell of each vector, and for each vector and cell whether a partner may lie there."""
        apart = (self.coarse**2).sum(axis=1) - 2 * unit @ self.coarse.T
        own = apart.argmin(axis=1)
        reach = sqrt(max(0.0, 2 - 2 * least)) + 1e-9
        return own, apart - apart[np.arange(len(unit)), own][:, None] <= 2 * reach * self.between[own] + 1e-9

    @functools.cached_property
    def between(self) -> np.ndarray:
        """Distances of the centres, worked out once in each task; a little more than they are."""
        squares = (self.coarse**2).sum(axis=1)
        return np.sqrt(np.maximum(squares[:, None] + squares - 2 * self.coarse @ self.coarse.T, 0)) + 1e-6

    def padded(self, x: np.ndarray) -> np.ndarray:
        count, _, width = self.books.shape
        wide = np.zeros((len(x), count * width))
        wide[:, : x.shape[1]] = x
        return wide.reshape(len(x), count, width)

    def codes(self, unit: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and the length of what they leave out."""
        rest = self.padded(unit - self.coarse[own])
        found = np.stack([nearest(rest[:, m], b) for m, b in enumerate(self.books)], axis=1)
        left = rest - np.stack([b[found[:, m]] for m, b in enumerate(self.books)], axis=1)
        return found.astype(np.uint8), np.sqrt((left**2).sum(axis=(1, 2)))

    def bounds(self, queries: np.ndarray, cell: int, codes: np.ndarray, left: np.ndarray) -> np.ndarray:
        """For each query and coded vector of a cell the largest cosine they can have."""
        tables = np.einsum("qmd,mcd->qmc", self.padded(queries), self.books)
        total = (queries @ self.coarse[cell])[:, None] + left[None, :]
        for m in range(tables.shape[1]):
            total += tables[:, m][:, codes[:, m]]
        return total


@dataclass(eq=False)
class Model:
    """Quantisers by label and width. A label that the sample does not show has one cell."""

    coarse: dict[tuple[str, int], np.ndarray]
    books: dict[int, np.ndarray]

    @functools.lru_cache(maxsize=4)
    def of(self, label: str, width: int) -> Quantiser:
        books = self.books.get(width)
        if books is None:
            books = np.zeros((SUBSPACES, 1, ceil(width / SUBSPACES)))
        return Quantiser(self.coarse.get((label, width), np.zeros((1, width))), books)


def fit(rows: list[tuple[str, np.ndarray]], total: int) -> Model:
    """Cells for each label in proportion to its share of ``total`` vectors, and code books for each width."""
    by_label: dict[tuple[str, int], list[np.ndarray]] = {}
    for label, vector in rows:
        by_label.setdefault((label, len(vector)), []).append(vector)
    coarse, rest = {}, {}
    for (label, width), vectors in by_label.items():
        unit = _units(np.array(vectors, dtype=float))
        cells = max(1, min(round(total * len(unit) / len(rows) / CELL), len(unit) // PER_CENTRE))
        coarse[label, width] = centres(unit, cells)
        rest.setdefault(width, []).append(unit - coarse[label, width][nearest(unit, coarse[label, width])])
    books = {}
    for width, parts in rest.items():
        residual = np.concatenate(parts)
        size = ceil(width / SUBSPACES)
        wide = np.zeros((len(residual), SUBSPACES * size))
        wide[:, :width] = residual
        books[width] = np.stack(
            [_filled(centres(wide[:, m * size : (m + 1) * size], CODES, 6)) for m in range(SUBSPACES)]
        )
    return Model(coarse, books)


def _filled(book: np.ndarray) -> np.ndarray:
    """A book of few codes, filled up with its last one."""
    return np.concatenate((book, np.repeat(book[-1:], CODES - len(book), axis=0)))


_ASSIGNED = (
    "label string, width int, cell int, is_query boolean, own int, id long, copies long, vector binary, code binary, left double"
)
_FOUND = "id long, other long, links long"


def _assign(shared, least: float, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            ids, copies, labels = (batch.column(i).to_pylist() for i in range(3))
            vectors = batch.column(3)
            widths = np.diff(vectors.offsets.to_numpy())
            flat = vectors.flatten().to_numpy()
            starts = np.concatenate(([0], np.cumsum(widths)))
            groups: dict[tuple[str, int], list[int]] = {}
            for i, (label, width) in enumerate(zip(labels, widths.tolist())):
                groups.setdefault((label, width), []).append(i)
            # A table of vectors by cells is held at a time: not too many vectors at once.
            parts = [(name, rows[k : k + PROBED]) for name, rows in groups.items() for k in range(0, len(rows), PROBED)]
            for (label, width), members in parts:
                x = np.stack([flat[starts[i] : starts[i + 1]] for i in members]).astype(float)
                unit = _units(x)
                quantiser = model.of(label, width)
                own, near = quantiser.probes(unit, least)
                code, left = quantiser.codes(unit, own)
                near &= np.arange(near.shape[1])[None, :] >= own[:, None]  # each pair of cells once
                who, cell = np.nonzero(near)
                n = len(members)
                raw = [v.tobytes() for v in x.astype(kind)]
                order = np.concatenate((np.arange(n), who))
                index = np.arange(len(order)) < n
                yield pa.RecordBatch.from_pydict(
                    {
                        "label": pa.array([label] * len(order)),
                        "width": pa.array(np.full(len(order), width, np.int32)),
                        "cell": pa.array(np.concatenate((own, cell)).astype(np.int32)),
                        "is_query": pa.array(~index),
                        "own": pa.array(own[order].astype(np.int32)),
                        "id": pa.array([ids[members[i]] for i in order.tolist()], pa.int64()),
                        "copies": pa.array([copies[members[i]] for i in order.tolist()], pa.int64()),
                        "vector": pa.array([raw[i] for i in order.tolist()]),
                        "code": pa.array([code[i].tobytes() for i in range(n)] + [None] * len(who), pa.binary()),
                        "left": pa.array(np.concatenate((left, np.zeros(len(who))))),
                    }
                )

    return run


class _Forest:
    """Keeps of all links only those that join two trees."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}
        self.kept: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def link(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.kept.append((x, y))


def _search(shared, least: float, kind: str):
    """Compares the queries of a (label, cell, block) with its coded vectors, which come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, here = shared.value, None
        index: list[tuple] = []
        links: dict[int, int] = {}
        forest = _Forest()
        held: tuple | None = None

        def flushed() -> pa.RecordBatch:
            nonlocal forest
            rows = [(i, None, n) for i, n in links.items()] + [(a, b, None) for a, b in forest.kept]
            links.clear()
            forest = _Forest()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["id", "other", "links"])

        for batch in batches:
            names = ("label", "width", "cell", "block", "is_query", "own", "id", "copies", "vector", "code", "left")
            rows = list(zip(*(batch.column(n).to_pylist() for n in names)))
            at = 0
            while at < len(rows):
                key, is_query = rows[at][:4], rows[at][4]
                stop = at
                while stop < len(rows) and rows[stop][:4] == key and rows[stop][4] == is_query and (not is_query or stop - at < QUERIES):
                    stop += 1
                part = rows[at:stop]
                at = stop
                if key != here:
                    if links or forest.kept:
                        yield flushed()
                    here, index, held = key, [], None
                if not is_query:
                    index += part
                    continue
                if not index:
                    continue
                quantiser = model.of(key[0], key[1])
                if held is None:
                    x = np.stack([np.frombuffer(r[8], kind) for r in index]).astype(float)
                    held = (
                        _units(x), np.array([r[6] for r in index]), np.array([r[7] for r in index]),
                        np.stack([np.frombuffer(r[9], np.uint8) for r in index]), np.array([r[10] for r in index]),
                    )
                x, x_id, x_copies, code, left = held
                y = np.stack([np.frombuffer(r[8], kind) for r in part]).astype(float)
                unit = _units(y)
                y_id, y_copies = np.array([r[6] for r in part]), np.array([r[7] for r in part])
                own = np.array([r[5] for r in part]) == key[2]
                q, i = np.nonzero(quantiser.bounds(unit, key[2], code, left) >= least - 1e-9)
                keep = y_id[q] != x_id[i]
                q, i = q[keep], i[keep]
                if not len(q):
                    continue
                exact = np.einsum("nd,nd->n", unit[q], x[i])
                q, i = q[exact >= least], i[exact >= least]
                for a, b, n, m, same in zip(y_id[q].tolist(), x_id[i].tolist(), x_copies[i].tolist(), y_copies[q].tolist(), own[q].tolist()):
                    links[a] = links.get(a, 0) + n
                    if not same:  # in the own cell the other one asks too
                        links[b] = links.get(b, 0) + m
                    forest.link(a, b)
        if links or forest.kept:
            yield flushed()

    return run


def near_vectors(
    vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = LEAST
) -> DataFrame:
    """``key``, ``n_links``, ``component_id`` and ``kept`` of every row.

    Rows of one label link when the cosine of their vectors is ``least`` or more. Rows whose label is null, or whose
    vector is null, empty, zero or holds null or non-finite components, link with nothing; so do vectors of unequal
    widths. Equal vectors are compared once and counted as often as they occur, so a very frequent one is one row here.
    Repeated rows link with each other. A row with a null key takes part and is not kept. No rows give no rows.
    """
    spark = vectors.sparkSession
    # Vectors travel in the width of their column; all arithmetic is in double precision.
    kind = "<f4" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "<f8"
    usable = (
        F.col("label").isNotNull()
        & F.col("vector").isNotNull()
        & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists("vector", lambda v: v != 0)
    )
    rows = vectors.select(F.col(key).alias("key"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    named = rows.withColumn("id", F.when(F.coalesce(usable, F.lit(False)), F.xxhash64("label", "vector")))
    distinct = named.where("id IS NOT NULL").groupBy("id", "label", "vector").agg(F.count(F.lit(1)).alias("copies"))
    distinct = written(distinct.select("id", "copies", "label", "vector"), "vectors")
    total = distinct.count()
    sample = [(r[0], np.array(r[1])) for r in distinct.select("label", "vector", "id").orderBy("id").limit(SAMPLE).collect()]
    model = spark.sparkContext.broadcast(fit(sample, total))
    assigned = written(distinct.mapInArrow(_assign(model, least, kind), _ASSIGNED), "assigned")
    place = ["label", "width", "cell"]
    large = assigned.where("NOT is_query").groupBy(*place).count().where(F.col("count") > BLOCK)
    large = large.select(*place, F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    cut = assigned.join(large, place, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    one = F.array(F.pmod(F.col("id"), F.col("blocks")).cast("int"))
    pieces = cut.withColumn("block", F.explode(F.when(F.col("is_query"), every).otherwise(one))).drop("blocks")
    dealt = pieces.repartition(*place, "block").sortWithinPartitions(*place, "block", "is_query")
    found = written(dealt.mapInArrow(_search(model, least, kind), _FOUND), "found")
    links = found.where("other IS NULL").groupBy("id").agg(F.sum("links").alias("links"))
    trees = components(found.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b")))
    known = distinct.select("id", "copies").join(links, "id", "left").join(trees, F.col("id") == F.col("vertex"), "left")
    known = known.select(
        F.col("id").alias("i"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "id").alias("group"),
    )
    placed = named.select("key", "id").join(known, F.col("id") == F.col("i"), "left")
    groups = placed.where("group IS NOT NULL").groupBy(F.col("group").alias("g")).agg(F.min("key").alias("smallest"))
    return placed.join(groups, F.col("group") == F.col("g"), "left").select(
        F.col("key").alias(key),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("smallest", "key").cast("long").alias("component_id"),
        F.coalesce(F.col("key") == F.coalesce("smallest", "key"), F.lit(False)).alias("kept"),
    )
