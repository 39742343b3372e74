"""Operator 7, nearest neighbours: a vantage-point tree for each shard, below one top tree that says which shards a query needs.

A node keeps a vantage point and the median distance of its vectors to it; leaves keep up to ``LEAF_ROWS`` vectors.  Distances
are Euclidean on unit vectors, whose order is that of the cosine.  A side of a node is left out if the triangle inequality,
relaxed by ``factor``, says that it cannot hold a nearer vector than the k found so far: ``factor`` times the gap to the
dividing sphere exceeds the k-th distance.  Factor 1 is exact search, larger ones look at less.

1. A sample of at most ``SAMPLE_ROWS`` vectors, picked by a hash, comes to the driver: the top tree is fitted on it.  Its leaves
   are cells; every vector falls into one, and a cell is dealt to as many shards as its share of the sample asks for, by a hash
   (so equal vectors, which no sphere divides, spread as well).
2. The k-th distance of a query within the sample bounds its true one.  With it the query goes down the top tree and to the
   shards of the cells that the bound leaves, which is all that is moved of it.
3. A task holds one shard's vectors, builds their tree and streams the shard's queries through it in blocks of ``QUERY_ROWS``.
   A query's nearest of all its shards are merged at the end.

The score is the cosine of the original vectors in double precision; ties go to the smaller id.  A vector is first divided by a
power of two near its largest component, which changes no digit of the cosine and keeps squares from under- or overflowing.
Vectors that are null, empty, zero, or hold null or non-finite components take no part; rows that repeat an id are candidates
each, and a query's own id is none; query rows that repeat an id, with equal vectors or others, get a list each; vectors are compared with those of their own length only; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.llm.memory import lean

SHARD_ROWS, LEAF_ROWS, QUERY_ROWS = 8192, 256, 2048
#: Rows and bytes of the sample, and cells of a top tree at most.
SAMPLE_ROWS, SAMPLE_BYTES, CELLS = 4096, 32 << 20, 1024
#: A shard is (cell, salt in it).
SALT_BITS = 24
#: Rounding of distances; what lies within it of a bound is looked at.
SLACK = 1e-6


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows, summed from the first component to the last: equal vectors give equal sums wherever they stand."""
    return np.cumsum(a * b, axis=1)[:, -1]


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each row divided by the power of two that brings its largest component to 0.5 or more and under 1; exact."""
    if not vectors.size:
        return vectors
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1, keepdims=True))[1])


def _units(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.sqrt(_dot(vectors, vectors))
    return vectors / norm[:, None], norm


def _reach(score: np.ndarray) -> np.ndarray:
    """The distance of unit vectors whose cosine is ``score``, without end where that is -inf."""
    return np.where(np.isinf(score), np.inf, np.sqrt(np.maximum(2 - 2 * score, 0))) + SLACK


def _gap(unit: np.ndarray, point: np.ndarray, middle: float) -> np.ndarray:
    return np.sqrt(np.maximum(((unit - point) ** 2).sum(1), 0)) - middle


class Tree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF_ROWS):
        order = np.argsort(ids, kind="stable")
        self.ids, self.raw = ids[order], scaled(vectors[order])
        self.unit, self.norm = _units(self.raw)
        self.root = self._build(np.arange(len(ids)), leaf)

    def _build(self, rows: np.ndarray, leaf: int):
        if len(rows) <= leaf:
            return rows
        # The row farthest from the mean divides best; any row is right.
        away = self.unit[rows]
        point = away[np.argmax(((away - away.mean(0)) ** 2).sum(1))]
        far = np.sqrt(np.maximum(((away - point) ** 2).sum(1), 0))
        middle = float(np.median(far))
        inside = far <= middle
        if inside.all():  # many equal distances: no sphere divides them
            return rows
        return point, middle, self._build(rows[inside], leaf), self._build(rows[~inside], leaf)

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, factor: float, least: np.ndarray | None = None):
        """(scores, rows) of the k nearest of each query; rows are -1 where there are fewer.  ``least`` is a score that a
        query's k-th nearest of all shards is known to reach; what lies below it may be left out."""
        self._q, self._k, self._factor, self._own = scaled(queries), k, factor, ids
        self._qunit, self._qnorm = _units(self._q)
        self._least = np.full(len(ids), -np.inf) if least is None else least
        self._score = np.full((len(ids), k), -np.inf)
        self._row = np.full((len(ids), k), -1)
        self._visit(self.root, np.arange(len(ids)))
        return self._score, self._row

    def _worst(self, q: np.ndarray) -> np.ndarray:
        return np.maximum(self._score[q, -1], self._least[q])

    def _visit(self, node, q: np.ndarray) -> None:
        if not len(q):
            return
        if isinstance(node, np.ndarray):
            for a in range(0, len(node), 4 * LEAF_ROWS):
                self._scan(node[a : a + 4 * LEAF_ROWS], q)
            return
        point, middle, inner, outer = node
        gap = _gap(self._qunit[q], point, middle)
        near = gap <= 0
        self._visit(inner, q[near])
        self._visit(outer, q[~near])
        open_ = self._factor * np.abs(gap) <= _reach(self._worst(q))
        self._visit(outer, q[near & open_])
        self._visit(inner, q[~near & open_])

    def _scan(self, rows: np.ndarray, q: np.ndarray) -> None:
        # A product of matrices finds who may be among the k; their scores are summed row by row, so equal vectors tie.
        close = self._qunit[q] @ self.unit[rows].T
        close[self._own[q][:, None] == self.ids[rows][None, :]] = -np.inf
        a, b = np.nonzero(close >= np.maximum(self._worst(q), -1e9)[:, None] - SLACK)
        for c in range(0, len(a), 1 << 17):
            self._merge(q, rows, a[c : c + (1 << 17)], b[c : c + (1 << 17)], close)

    def _merge(self, q, rows, a, b, close) -> None:
        raw, other = self._q[q[a]], self.raw[rows[b]]
        score = _dot(raw, other) / (self._qnorm[q[a]] * self.norm[rows[b]])
        who = np.unique(a)
        all_q = np.concatenate([np.repeat(who, self._k), a])
        all_score = np.concatenate([self._score[q[who]].ravel(), score])
        all_row = np.concatenate([self._row[q[who]].ravel(), rows[b]])
        order = np.lexsort((np.where(all_row < 0, len(self.ids), all_row), -all_score, all_q))
        first = np.searchsorted(all_q[order], who)
        take = order[first[:, None] + np.arange(self._k)]
        self._score[q[who]], self._row[q[who]] = all_score[take], all_row[take]


@dataclass
class Top:
    """The tree above the shards of the vectors of one length: cells by number, the shards of each, and the sample."""

    root: object
    salts: np.ndarray
    first: int
    ids: np.ndarray
    raw: np.ndarray

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """The cell of each unit vector."""
        out, todo = np.zeros(len(unit), np.int64), [(self.root, np.arange(len(unit)))]
        while todo:
            node, rows = todo.pop()
            if isinstance(node, int):
                out[rows] = node
            else:
                point, middle, inner, outer = node
                near = _gap(unit[rows], point, middle) <= 0
                todo += [(inner, rows[near]), (outer, rows[~near])]
        return out

    def shards(self, unit: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        """The shard of each vector, by a hash of it within its cell."""
        cell = self.cells(unit)
        return self.first + cell << SALT_BITS | mixed % self.salts[cell]

    def least(self, ids: np.ndarray, unit: np.ndarray, k: int) -> np.ndarray:
        """A score that each query's k-th nearest reaches: that of its k-th nearest in the sample."""
        if len(self.ids) < k:
            return np.full(len(ids), -np.inf)
        close = unit @ _units(self.raw)[0].T
        close[ids[:, None] == self.ids[None, :]] = -np.inf
        return np.partition(close, -k, axis=1)[:, -k] - SLACK

    def routes(self, unit: np.ndarray, least: np.ndarray, factor: float) -> list[np.ndarray]:
        """The shards that may hold one of each query's k nearest."""
        reach, todo = _reach(least), [(self.root, np.arange(len(unit)))]
        rows, cells = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while todo:
            node, own = todo.pop()
            if not len(own):
                continue
            if isinstance(node, int):
                rows.append(own)
                cells.append(np.full(len(own), node))
                continue
            point, middle, inner, outer = node
            gap = _gap(unit[own], point, middle)
            both = factor * np.abs(gap) <= reach[own]
            todo += [(inner, own[(gap <= 0) | both]), (outer, own[(gap > 0) | both])]
        row, cell = np.concatenate(rows), np.concatenate(cells)
        order = np.argsort(row, kind="stable")
        ends = np.searchsorted(row[order], np.arange(1, len(unit) + 1))
        spread = lambda c: np.concatenate([np.zeros(0, np.int64), *(np.arange(self.salts[x]) + (self.first + x << SALT_BITS) for x in c)])
        return [spread(cell[order[a:b]]) for a, b in zip(np.append(0, ends[:-1]), ends)]


def top_of(ids: np.ndarray, vectors: np.ndarray, rows: int, shard_rows: int, first: int) -> Top:
    """Fitted on a sample of ``rows`` vectors."""
    cells = min(CELLS, math.ceil(rows / shard_rows))
    if len(ids) < 2 or cells < 2:
        return Top(0, np.array([max(1, math.ceil(rows / shard_rows))]), first, ids, scaled(vectors))
    tree, sizes = Tree(ids, vectors, max(4, len(ids) // cells)), []

    def numbered(node):
        if isinstance(node, np.ndarray):
            sizes.append(len(node))
            return len(sizes) - 1
        point, middle, inner, outer = node
        return point, middle, numbered(inner), numbered(outer)

    root = numbered(tree.root)
    return Top(root, np.ceil(np.array(sizes) / len(ids) * rows / shard_rows).astype(np.int64).clip(1), first, tree.ids, tree.raw)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _by_width(tops, batch: pa.RecordBatch):
    """(top tree, rows, their vectors) for each length in a batch (vec_id, vector, width, mixed)."""
    width = batch.column("width").to_numpy()
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        vectors = scaled(_matrix(batch.column("vector").take(pa.array(rows))))
        for a in range(0, len(rows), QUERY_ROWS):
            yield tops.value[int(w)], rows[a : a + QUERY_ROWS], _units(vectors[a : a + QUERY_ROWS])[0]


def _deal(tops):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = np.zeros(batch.num_rows, np.int64)
            for top, rows, unit in _by_width(tops, batch):
                shard[rows] = top.shards(unit, batch.column("mixed").to_numpy()[rows])
            yield pa.RecordBatch.from_arrays([pa.array(shard), batch.column("vec_id"), batch.column("vector")], ["shard", "id", "vector"])

    return run


def _ask(tops, k: int, factor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards, known = [np.zeros(0, np.int64)] * batch.num_rows, np.zeros(batch.num_rows)
            for top, rows, unit in _by_width(tops, batch):
                known[rows] = top.least(batch.column("vec_id").to_numpy()[rows], unit, k)
                for row, own in zip(rows, top.routes(unit, known[rows], factor)):
                    shards[row] = own
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.list_(pa.int64())), batch.column("vec_id"), batch.column("vector"), pa.array(known), batch.column("row"), batch.column("copies")], ["shards", "id", "vector", "least", "row", "copies"])

    return run


def _search(k: int, factor: float):
    """Of rows sorted by shard, vectors before queries: each shard's tree, and its queries as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, tree = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            shard, kind = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            edge = np.flatnonzero(np.append(True, (shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1])))
            for a, b in zip(edge, np.append(edge[1:], batch.num_rows)):
                if shard[a] != last:
                    last, held, tree = shard[a], [], None
                part = batch.slice(a, b - a)
                if kind[a] == 0:
                    held.append((part.column("id").to_numpy(), _matrix(part.column("vector"))))
                    continue
                if not held:
                    continue
                if tree is None:
                    tree = Tree(*(np.concatenate(x) for x in zip(*held)))
                    held = [()]
                for at in range(0, b - a, QUERY_ROWS):
                    block = part.slice(at, QUERY_ROWS)
                    own = block.column("id").to_numpy()
                    score, row = tree.search(own, _matrix(block.column("vector")), k, factor, block.column("least").to_numpy())
                    found = row >= 0
                    of = pa.array(np.repeat(np.arange(len(own)), found.sum(1)))
                    yield pa.RecordBatch.from_arrays([block.column("id").take(of), block.column("row").take(of), block.column("copies").take(of), pa.array(tree.ids[row[found]]), pa.array(score[found])], ["query_id", "row", "copies", "vec_id", "score"])

    return run


def search(vectors: DataFrame, queries: DataFrame, *, k: int = 5, factor: float = 1.0, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The k nearest of ``vectors`` for each of ``queries`` (both: vec_id, embedding): query_id, rank, vec_id, score."""
    spark = vectors.sparkSession

    def usable(df: DataFrame) -> DataFrame:
        vector = F.transform("embedding", lambda x: x.cast("double"))
        bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf))
        rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).where("vec_id is not null and vector is not null and size(vector) > 0")
        rows = rows.where(~bad & F.exists("vector", lambda x: x != 0)).withColumn("width", F.size("vector"))
        return rows.withColumn("mixed", F.xxhash64("vec_id", F.hash("vector")).bitwiseAND(F.lit((1 << 62) - 1)))

    good = usable(vectors)
    tops, first = {}, 0
    # One count and one bounded sample for each length that there is.
    for row in good.groupBy("width").agg(F.count("*").alias("n")).orderBy("width").collect():
        most = max(2, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * row["width"])))
        some = good.where(F.col("width") == row["width"]).orderBy("mixed", "vec_id").limit(most).select("vec_id", "vector").toArrow() if row["n"] > shard_rows else None
        ids, sample = (some.column("vec_id").to_numpy(), _matrix(some.column("vector"))) if some is not None else (np.zeros(0, np.int64), np.zeros((0, row["width"])))
        tops[row["width"]] = top_of(ids, sample, row["n"], shard_rows, first)
        first += len(tops[row["width"]].salts)
    sent = spark.sparkContext.broadcast(tops)
    dealt = good.mapInArrow(lean(_deal(sent)), "shard long, id long, vector array<double>").select("shard", F.lit(0).alias("kind"), "id", "vector", F.lit(0.0).alias("least"), F.lit(0).cast("long").alias("row"), F.lit(0).cast("long").alias("copies"))
    asked = usable(queries).where(F.col("width").isin([*tops])) if tops else usable(queries).limit(0)
    # Query rows are told apart by id and vector; equal ones are asked once and answered as often as they are there.
    asked = asked.groupBy("vec_id", "vector", "width", "mixed").agg(F.count("*").alias("copies")).withColumn("row", F.xxhash64(F.lit("query"), "vector"))
    routed = asked.mapInArrow(lean(_ask(sent, k, factor)), "shards array<long>, id long, vector array<double>, least double, row long, copies long").select(F.explode("shards").alias("shard"), F.lit(1).alias("kind"), "id", "vector", "least", "row", "copies")
    near = dealt.unionByName(routed).repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(lean(_search(k, factor)), "query_id long, row long, copies long, vec_id long, score double")
    order = Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id")
    best = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("query_id", "rank", "vec_id", "score")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, vectors.where("vec_id % 50 = 0"))


OP7_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e, c.e) / (q.norm * c.norm) AS score FROM n q JOIN n c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
