"""Exact top-k search by inner product with block-at-a-time pruning.

Vectors are whole numbers.  A term is a component with its sign: terms of a block of vectors have
maxima (the greatest and the least value of the component).  For a query, the sum over its
terms of weight times maximum bounds every score in the block.  Vectors go into blocks by recursive halving
along the component that varies most, so that maxima are telling.  Each query takes the blocks of a
range in falling order of bound, scores each through the block's forward index (its vectors as a
matrix), and stops at the first whose bound is under its k-th score so far; a bound equal to it goes on,
since ties go to smaller ids.

Ranges of vectors and chunks of queries are dealt so that each range meets each chunk in one task of
bounded size.  The first range is searched before the others: its k-th score of a query is a floor that the
others start with.  A range keeps k rows a query, and the ranges' rows are ranked together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._tables import written
from ._text import spared

RANGE_ROWS, BLOCK_ROWS, CHUNK_ROWS = 16384, 64, 2048
#: Blocks scored one by one before it is asked how many of the others can be left out.
LEAD = 8
_HIT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_SEEN = pa.schema([("query_id", pa.int64()), ("blocks", pa.int64()), ("scored", pa.int64())])


def _halved(x: np.ndarray, ids: np.ndarray) -> list[np.ndarray]:
    """Rows of each block: halves along the component of most variance until they fit."""
    todo, out = [np.argsort(ids, kind="stable")], []
    while todo:
        rows = todo.pop()
        if len(rows) <= BLOCK_ROWS:
            out.append(rows)
            continue
        own = x[rows]
        rows = rows[np.argsort(own[:, np.argmax(own.var(axis=0))], kind="stable")] if x.shape[1] else rows
        cut = -(-len(rows) // (2 * BLOCK_ROWS)) * BLOCK_ROWS
        todo += [rows[cut:], rows[:cut]]
    return out


def _first(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _search(k: int, counted: bool = False):
    def run(table: pa.Table) -> pa.Table:
        ask = table.column("ask").to_numpy(zero_copy_only=False)
        ids = table.column("vec_id").to_numpy(zero_copy_only=False)
        floors = table.column("floor").to_pylist()
        flat = table.column("v").combine_chunks()
        flat = flat if isinstance(flat, pa.ListArray) else flat.chunk(0)
        values, starts = flat.values.to_numpy(zero_copy_only=False), flat.offsets.to_numpy()
        sizes = np.diff(starts)
        hits, seen = [np.zeros((0, 3), np.int64)], [np.zeros((0, 3), np.int64)]
        for dim in np.unique(sizes[ask]).tolist():
            rows, asked = np.flatnonzero((sizes == dim) & ~ask), np.flatnonzero((sizes == dim) & ask)
            if not len(rows):
                continue
            x, q = (values[starts[at][:, None] + np.arange(dim)] for at in (rows, asked))
            top = max(int(np.abs(x).max(initial=0)), 1) * max(int(np.abs(q).max(initial=0)), 1) * max(dim, 1)
            # sums that a double holds exactly, else whole numbers of any size
            kind = np.float64 if top < 1 << 53 else object
            own, whole = ids[rows], x.astype(kind)
            blocks = [(own[b], whole[b]) for b in _halved(x, own)]
            up, down = (np.stack([f(b) for _, b in blocks]) for f in (lambda b: b.max(axis=0), lambda b: b.min(axis=0)))
            q = q.astype(kind)
            bounds = np.where(q > 0, q, 0) @ up.T + np.where(q < 0, q, 0) @ down.T
            for n, at in enumerate(asked.tolist()):
                order = sorted(range(len(blocks)), key=lambda b: -bounds[n, b]) if kind is object else np.argsort(-bounds[n], kind="stable")  # noqa: B023
                got_ids, got, least, scored = np.zeros(0, np.int64), np.zeros(0, np.int64), floors[at], 0
                for step, b in enumerate(order):
                    if least is not None and bounds[n, b] < least:
                        break
                    if step == LEAD and least is not None and 2 * np.count_nonzero(bounds[n][np.asarray(order[step:])] >= least) > len(order) - step:
                        # most blocks have to be scored: as one matrix
                        scores, scored = whole @ q[n], len(blocks)
                        use = (own != ids[at]) & (scores >= least)
                        got_ids, got = _first(own[use], scores[use].astype(np.int64), k)
                        break
                    scored += 1
                    names, block = blocks[b]
                    scores = block @ q[n]
                    use = names != ids[at]
                    if least is not None:
                        use &= scores >= least
                    if use.any():
                        got_ids, got = _first(np.append(got_ids, names[use]), np.append(got, scores[use].astype(np.int64)), k)
                        if len(got) == k:
                            least = max(int(got[-1]), least) if least is not None else int(got[-1])
                hits.append(np.stack([np.full(len(got), ids[at]), got_ids, got], axis=1))
                seen.append(np.array([[ids[at], len(blocks), scored]], np.int64))
        found, schema = (np.concatenate(seen), _SEEN) if counted else (np.concatenate(hits), _HIT)
        return pa.Table.from_arrays([pa.array(found[:, i]) for i in range(3)], schema=schema)

    return run


def _dealt(vectors: DataFrame, queries: DataFrame, id: str, vector: str):
    """Vectors with their range and chunk, queries likewise, and the number of ranges."""
    fit = lambda df: df.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).cast("array<long>").alias("v")).where("vec_id is not null and v is not null and not exists(v, x -> x is null)")
    base = fit(vectors)
    asked = fit(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    rows, n_asked = base.count(), asked.count()
    ranges, chunks = max(1, -(-rows // RANGE_ROWS)), max(1, -(-n_asked // CHUNK_ROWS))
    at = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "vec_id", "v"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = base.select(at(ranges, 1).alias("r"), "vec_id", "v").select("r", every(chunks).alias("c"), F.lit(False).alias("ask"), "vec_id", "v")
    right = asked.select(every(ranges).alias("r"), at(chunks, 2).alias("c"), F.lit(True).alias("ask"), "vec_id", "v")
    return left, right, ranges


def _found(vectors: DataFrame, queries: DataFrame, k: int, id: str, vector: str, counted: bool) -> DataFrame:
    left, right, ranges = _dealt(vectors, queries, id, vector)
    none = F.lit(None).cast("long").alias("floor")
    search = lambda rows, asked, counted: rows.select("*", none).unionByName(asked).groupBy("r", "c").applyInArrow(spared(_search(k, counted)), "query_id long, blocks long, scored long" if counted else "query_id long, vec_id long, score long")
    if ranges == 1:
        return search(left, right.select("*", none), counted)
    begun = written(search(left.where("r = 0"), right.where("r = 0").select("*", none), False), "first-range")
    floors = begun.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k).select(F.col("query_id").alias("vec_id"), "floor")
    rest = search(left.where("r > 0"), right.where("r > 0").join(floors, "vec_id", "left").select("r", "c", "ask", "vec_id", "v", "floor"), counted)
    return rest.unionByName(search(left.where("r = 0"), right.where("r = 0").select("*", none), True) if counted else begun)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, id: str = "vec_id", vector: str = "vector") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` its ``k`` best rows of ``vectors``
    but those of its own id; both have an id and an array of whole numbers.

    score: inner product; ties go to the smaller id; fewer rows if there are fewer.  Vectors of
    another length than the query's don't take part, nor do rows whose id or vector is null or
    holds null.  Rows of ``vectors`` that repeat an id each count; rows of ``queries`` that repeat one
    are one query (the first by vector).  Empty input: no rows.
    """
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    hits = _found(vectors, queries, k, id, vector, False)
    return hits.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def pruning(vectors: DataFrame, queries: DataFrame, k: int = 20, id: str = "vec_id", vector: str = "vector") -> DataFrame:
    """(query_id, blocks, scored) of the same search: how many blocks there were and how many had to be scored."""
    return _found(vectors, queries, k, id, vector, True).groupBy("query_id").agg(F.sum("blocks").alias("blocks"), F.sum("scored").alias("scored"))
