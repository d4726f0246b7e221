"""Exact top-k by inner product of quantised vectors."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, only, rows_of
from .cover_tree import ERROR, NEVER, TOO_SMALL, Data, Search

SCALE = 256.0
LARGEST = 2.0**400  # of a scaled component: squares of larger ones are beyond floats
SAMPLE = 2_048  # vectors from which the pivots are taken
PIVOTS = 32
BLOCK = 16_384  # vectors in a block of data, about
ASKED = 8_192  # queries that a task searches together, at most

FOUND = "row long, query_id long, vec_id long, score long"
INFINITY = float("inf")


def valid_rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, dim, v`` as they are; without rows that take no part."""
    rows = rows_of(vectors, vec_id=F.col(f"`{id_col}`").cast("long"), v=vector_col)
    finite = F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < INFINITY))  # NaN is larger than any number
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite).select("vec_id", F.size("v").alias("dim"), "v")


def matrix(column, dim: int) -> np.ndarray:
    """Vectors of one length, a row each, quantised: whole numbers as floats."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    whole = np.floor(flat * SCALE).reshape(len(column), dim)
    if np.abs(whole).max(initial=0) > LARGEST:
        raise OverflowError("a component is too large for any score to fit into 64 bits")
    return whole


def pick(sample: np.ndarray, most: int) -> np.ndarray:
    """Pivots, farthest first: the top level of a cover tree over the sample."""
    chosen, least = [0], ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(most, len(sample)) and least.max() > 0:
        chosen.append(int(least.argmax()))
        least = np.minimum(least, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def place(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Add ``cell``, the nearest pivot, and ``away``, the distance from it."""

    def run(batches):
        only(None)
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                x, p = matrix(part.column("v"), dim), pivots.get(dim)
                if p is None:  # a length that the sample missed: one cell around the origin
                    p = np.zeros((1, dim))
                cell, away = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
                for k, c in enumerate(p):
                    d = np.sqrt(((x - c) ** 2).sum(axis=1))
                    nearer = d < away
                    cell[nearer], away[nearer] = k, d[nearer]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell, pa.int32()), pa.array(away)], [*part.schema.names, "cell", "away"])

    kind = rows.schema["v"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id long, dim int, v {kind}, cell int, away double")


def blocks_of(rows: DataFrame, size: int) -> tuple[DataFrame, dict]:
    """Add ``part`` so that (dim, cell, part) holds about ``size`` rows; per (dim, cell): radius and parts."""
    cells = {(r.dim, r.cell): (r.radius, math.ceil(r.n / size)) for r in rows.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).collect()}
    parts = F.lit(1)
    for (dim, cell), (_, n) in cells.items():  # a cell for each pivot at most
        if n > 1:
            parts = F.when((F.col("dim") == dim) & (F.col("cell") == cell), n).otherwise(parts)
    return rows.withColumn("part", F.pmod(F.xxhash64("row"), parts).cast("int")), cells


def search(rows: DataFrame, k: int, tasks: int, asked: int) -> DataFrame:
    """Search each block (dim, at, part): its rows with a ``floor`` are queries, the others data.

    A block's data come first in its partition.  Its tree is built once and the
    queries stream past it, ``asked`` at a time, so that a task holds one block
    whatever the number of queries.
    """
    key = ["dim", "at", "part"]

    def run(batches):
        only(None)
        block, gathered, waiting, data, held = None, [], [], None, 0

        def answers():
            nonlocal waiting, held
            if waiting and data is not None:
                table = pa.Table.from_batches(waiting)
                s = Search(matrix(table["v"], block[0]), table["vec_id"].to_numpy(), table["row"].to_numpy(), k, table["floor"].to_numpy())
                s.look(data)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in s.rows()], ["row", "query_id", "vec_id", "score"])
            waiting, held = [], 0

        for batch in batches:
            names = np.stack([batch.column(c).to_numpy() for c in (*key, "asks")], axis=1)
            cuts = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1).tolist(), len(names)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                *at, asks = names[a].tolist()
                if at != block:
                    yield from answers()
                    block, gathered, data = at, [], None
                piece = batch.slice(a, b - a)
                if not asks:
                    gathered.append(piece)
                    continue
                if gathered:
                    table = pa.Table.from_batches(gathered)
                    data, gathered = Data(matrix(table["v"], block[0]), table["vec_id"].to_numpy(), table["row"].to_numpy()), []
                for i in range(0, len(piece), asked):
                    part = piece.slice(i, asked)
                    if held + len(part) > asked:
                        yield from answers()
                    waiting.append(part)
                    held += len(part)
        yield from answers()

    dealt = rows.repartition(tasks, *key).sortWithinPartitions(*key, "asks")
    return dealt.mapInArrow(run, FOUND)


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact_topk(vectors: DataFrame, is_query: Callable[[Column], Column], k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, asked: int = ASKED, pivots: int = PIVOTS) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` best rows but its own.

    Components become floor(256 x); the score is the integer inner product and
    ties go to the smaller id.  Rows fall into cells around pivots (the top of a
    cover tree, from a bounded sample) and these into blocks of bounded size.
    Each query first searches one block of its own cell; the kth scores found
    there and the cells' radii rule out cells for good.  Every data block that
    is left is one task's dual-tree search, past which its queries stream.

    Rows with a null id, a null vector, or a component that is null or not
    finite take no part; all others do, however large.  The job fails with an
    ``OverflowError`` if a score that belongs to the result does not fit into
    64 bits.  Vectors of another length are not compared.  Each row is a query
    of its own and a candidate for every other row, also where rows share an
    id.  Extra columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = valid_rows(vectors, id_col, vector_col)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("dim", "v").collect()
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(r.dim, []).append(r.v)
    centres = {dim: pick(np.floor(np.array(v, np.float64).reshape(len(v), dim) * SCALE), pivots) for dim, v in by_dim.items()}
    placed = cut(place(rows, centres).withColumn("row", F.monotonically_increasing_id()))
    data, cells = blocks_of(placed, block)
    queries = placed.where(is_query(F.col("vec_id")))
    asking = {(r.dim, r.cell): r.radius for r in queries.groupBy("dim", "cell").agg(F.max("away").alias("radius")).collect()}
    most_tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(wanted: dict[tuple[int, int], list[int]], queries: DataFrame, one: bool) -> DataFrame:
        """Search the blocks of the cells wanted for each cell of queries, or one block of each.

        What is broadcast are pairs of cells, at most the square of the pivots.
        """
        parts = {key: 1 if one else n for key, (_, n) in cells.items()}
        asks = [(dim, qc, dc, parts[dim, dc]) for (dim, qc), found in wanted.items() for dc in found]
        gives = sorted({(dim, dc, n) for dim, _, dc, n in asks})
        columns = ["dim", "at", "part", "row", "vec_id", "v"]
        sent = queries.join(F.broadcast(spark.createDataFrame(asks, "dim int, cell int, at int, parts int")), ["dim", "cell"])
        sent = sent.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*columns, "floor", F.lit(1).alias("asks"))
        given = data.withColumnRenamed("cell", "at").join(F.broadcast(spark.createDataFrame(gives, "dim int, at int, parts int")), ["dim", "at"])
        given = given.where("part < parts").select(*columns, F.lit(None).cast("long").alias("floor"), F.lit(0).alias("asks"))
        return search(given.unionByName(sent), k, min(most_tasks, sum(n for _, _, n in gives)) or 1, asked)

    def at(dim: int, cell: int) -> np.ndarray:
        return centres[dim][cell] if dim in centres else np.zeros(dim)

    seeds = cut(best(run({(dim, qc): [qc] for dim, qc in asking}, queries.withColumn("floor", F.lit(int(NEVER))), one=True), k))
    kth = seeds.where(F.col("rank") == k).select("row", F.col("score").alias("kth"))
    queries = queries.join(kth, "row", "left").withColumn("floor", F.coalesce("kth", F.lit(int(NEVER)))).drop("kth")
    floors = {(r.dim, r.cell): r.least for r in queries.groupBy("dim", "cell").agg(F.min("floor").alias("least")).collect()}
    wanted: dict[tuple[int, int], list[int]] = {}
    for (dim, qc), q_radius in asking.items():
        q = at(dim, qc)
        for other, dc in cells:
            if other == dim:
                d, d_radius = at(dim, dc), cells[dim, dc][0]
                q_norm, d_norm = math.sqrt(q @ q), math.sqrt(d @ d)
                slack = 1 + ERROR * (q_norm + q_radius) * (d_norm + d_radius)
                most = q @ d + q_radius * d_norm + d_radius * q_norm + q_radius * d_radius + slack
                if floors[dim, qc] == NEVER or most >= floors[dim, qc]:
                    wanted.setdefault((dim, qc), []).append(dc)
    found = best(run(wanted, queries, one=False), k)
    held = F.when(F.col("score") == int(TOO_SMALL), F.raise_error(F.lit("a score does not fit into 64 bits")).cast("long")).otherwise(F.col("score"))
    return found.select("query_id", "rank", "vec_id", held.alias("score"))
