"""Exact top-k search by the threshold algorithm.

Components are scaled to integers. Vectors and queries are packed into blocks. A vector block goes to a task once for each wave of query
blocks, which follow it one by one; each pair of blocks is
searched by Fagin's threshold algorithm over the vector block's lists, one per dimension, sorted once by component: the
lists are read in step from the end that the query's sign favours, rows seen for the first time are scored in full, and the
search stops when the scores of the last entries read, the bound of any unseen row, can't beat the k-th result. The queries of a block
read the lists together: a row that one of them sees is scored for all that haven't stopped, in one matrix product. The k best of
each pair of blocks then meet in one ranking per query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of vectors, and of queries.
VECTOR_BLOCK = 16_384
QUERY_BLOCK = 512
#: Query blocks that one copy of a vector block meets.
WAVE = 256
#: Entries first read of each list; every further read doubles the depth.
FIRST_DEPTH = 16
#: Rows that are scored at once for a block of queries.
SCORED_ROWS = 4_096
#: What the score column can hold.
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def sorted_lists(vectors: np.ndarray) -> np.ndarray:
    """Row numbers by ascending component, one list per dimension."""
    return np.argsort(vectors.T, axis=1, kind="stable")


def threshold_search(vectors: np.ndarray, ids: np.ndarray, lists: np.ndarray, query: np.ndarray, k: int, skip: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """ids and scores of the k rows of highest inner product, ties to smaller ids; rows of id ``skip`` are left out.

    ``vectors`` and ``query`` hold integers; object arrays keep any size exact.
    """
    n = len(vectors)
    dims = np.flatnonzero(query != 0)
    weight = query[dims]
    seen = np.zeros(n, bool)
    if skip is not None:
        seen[ids == skip] = True
    best_id, best = ids[:0], vectors[:0, 0] if vectors.shape[1] else np.zeros(0, np.int64)
    done, depth = 0, FIRST_DEPTH if len(dims) else n
    up = weight < 0
    while done < n:
        depth = min(n, depth)
        if depth == n:
            fresh = np.flatnonzero(~seen)
        else:
            read = np.where(up[:, None], lists[dims, done:depth], lists[dims, n - depth : n - done])
            mark = np.zeros(n, bool)
            mark[read.ravel()] = True
            fresh = np.flatnonzero(mark & ~seen)
        seen[fresh] = True
        scores = vectors[fresh] @ query
        if len(best) == k:  # a tie may still win by its id
            able = scores >= best[-1]
            fresh, scores = fresh[able], scores[able]
        if len(fresh):
            all_id, all_score = np.concatenate([best_id, ids[fresh]]), np.concatenate([best, scores])
            order = np.lexsort((all_id, -all_score))[:k]
            best_id, best = all_id[order], all_score[order]
        if depth == n:
            break
        last = np.where(up, lists[dims, depth - 1], lists[dims, n - depth])
        bound = (vectors[last, dims] * weight).sum()
        if len(best) == k and best[-1] > bound:
            break
        done, depth = depth, depth * 2
    return best_id, best


def _best(owner: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each owner, in order; ties to smaller ids."""
    order = np.lexsort((ids, -scores, owner))
    start = np.flatnonzero(np.r_[True, np.diff(owner[order]) != 0]) if len(order) else np.zeros(0, np.int64)
    place = np.arange(len(order)) - np.repeat(start, np.diff(np.r_[start, len(order)]))
    order = order[place < k]
    return owner[order], ids[order], scores[order]


def threshold_searches(vectors: np.ndarray, ids: np.ndarray, lists: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`threshold_search` for each row of ``queries``, whose ids are left out: (query's number, id, score). ``ids`` ascend; inner products are exact in doubles."""
    n, dims = len(vectors), np.arange(vectors.shape[1])
    small = vectors.size and queries.size and np.abs(vectors).max() * np.abs(queries).max() * len(dims) < 2.0**24
    kind = np.float32 if small else np.float64  # either holds every partial sum
    rows, asked = vectors.astype(kind), queries.astype(kind)
    seen, least = np.zeros(n, bool), np.full(len(queries), -np.inf)
    owner, found, best = np.zeros(0, np.int64), ids[:0], np.zeros(0)
    active, done, depth = np.arange(len(queries)), 0, FIRST_DEPTH
    while done < n and len(active):
        depth = min(n, depth)
        if depth == n or not len(dims):
            depth, fresh = n, np.flatnonzero(~seen)
        else:
            up, down = (asked[active] < 0).any(0), (asked[active] > 0).any(0)
            mark = np.zeros(n, bool)
            mark[lists[up, done:depth].ravel()] = True
            mark[lists[down, n - depth : n - done].ravel()] = True
            fresh = np.flatnonzero(mark & ~seen)
        seen[fresh] = True
        for a in range(0, len(fresh), SCORED_ROWS):
            part = fresh[a : a + SCORED_ROWS]
            scores = asked[active] @ rows[part].T
            first, stop = (np.searchsorted(ids[part], query_ids[active], side) for side in ("left", "right"))
            for i in np.flatnonzero(stop > first).tolist():
                scores[i, first[i] : stop[i]] = -np.inf
            bar = least[active]
            if len(part) > k:  # the k-th of these rows alone is a bar too
                bare = np.flatnonzero(np.isneginf(bar))
                bar[bare] = np.partition(scores[bare], len(part) - k, axis=1)[:, len(part) - k]
            # a tie may still win by its id
            q, r = np.divmod(np.flatnonzero(scores >= bar[:, None].astype(kind)), len(part))
            able = scores[q, r] > -np.inf
            q, r = q[able], r[able]
            if len(q):
                owner, found, best = _best(np.r_[owner, active[q]], np.r_[found, ids[part[r]]], np.r_[best, scores[q, r].astype(np.float64)], k)
                full = np.flatnonzero(np.bincount(owner, minlength=len(queries)) == k)
                least[full] = best[np.searchsorted(owner, full, side="right") - 1]
        if depth == n:
            break
        low, high = vectors[lists[:, depth - 1], dims], vectors[lists[:, n - depth], dims]
        bound = np.minimum(queries[active], 0) @ low + np.maximum(queries[active], 0) @ high
        active = active[~(least[active] > bound)]
        done, depth = depth, depth * 2
    return owner, found, best


def _pack(df: DataFrame, id_type: str, rows: int, label: str) -> DataFrame:
    """Blocks of about ``rows`` rows: block, ids, width, values (int64 or, beyond, decimal text)."""
    n = max(1, -(-df.count() // rows))

    def pack(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy().astype(np.int64)
        lists = table.column("v").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        flat = np.floor(64.0 * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
        width = int(sizes.max(initial=0))
        m = np.zeros((len(ids), width))
        # a shorter vector has zeros where it ends
        m[np.repeat(np.arange(len(ids)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
        order = np.argsort(ids, kind="stable")
        return pa.table({"block": table.column("block").slice(0, 1), "ids": [ids[order].tobytes()], "width": pa.array([width], pa.int32()), "data": [m[order].tobytes()]})

    blocked = df.withColumn("block", F.pmod(F.xxhash64("id", F.lit(label)), F.lit(n)).cast("int"))
    return blocked.groupBy("block").applyInArrow(pack, "block int, ids binary, width int, data binary")


def top_k(
    vectors: DataFrame, k: int = 20, query_every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
    vector_block: int = VECTOR_BLOCK, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest integer inner products of each query.

    Components are floor(64 * x), x as double. Queries are the rows whose id is divisible by ``query_every``, candidates
    every row but those with the query's id. A vector that is null or holds a null or non-finite component takes no part (nor does one
    whose component is too large to be multiplied by 64), nor does a row without an id; a shorter vector counts as if zeros followed, an empty one as
    zeros alone. Ties go to the smaller id. Repeated rows are candidates of their own; a repeated query id gives its answers once, those of its least
    vector. Sums below 2^53 are exact in doubles, larger ones are made of Python integers; the score column, of 64 bits, then holds the nearest
    number that it can. Other columns play no part. An empty table gives an empty table.
    """
    value = F.col(vector_col).cast("array<double>")
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * 64.0) < F.lit(float("inf"))))
    able = vectors.select(F.col(id_col).cast("bigint").alias("id"), value.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite)
    queries = able.where(F.col("id") % query_every == 0).groupBy("id").agg(F.min("v").alias("v"))
    left = _pack(able, "bigint", vector_block, "v")
    right = _pack(queries, "bigint", query_block, "q")
    q_blocks, v_blocks = max(1, -(-queries.count() // query_block)), max(1, -(-able.count() // vector_block))
    wave = F.floor(F.col("block") / WAVE).cast("int")
    waves = F.sequence(F.lit(0), F.lit((q_blocks - 1) // WAVE))
    first = left.select("block", F.explode(waves).alias("wave"), F.lit(-1).alias("asks"), "ids", "width", "data")
    then = right.select(F.explode(F.sequence(F.lit(0), F.lit(v_blocks - 1))).alias("block"), wave.alias("wave"), F.col("block").alias("asks"), "ids", "width", "data")
    # a vector block comes before the query blocks of its wave, and stays while they pass
    dealt = first.unionByName(then).repartition("block", "wave").sortWithinPartitions("block", "wave", "asks")

    def search(batches):
        held, lists, vectors_, ids = None, None, None, None
        for batch in batches:
            for row in batch.to_pylist():
                place = (row["block"], row["wave"])
                if row["asks"] < 0:
                    held, ids = place, np.frombuffer(row["ids"], np.int64)
                    vectors_ = np.frombuffer(row["data"]).reshape(len(ids), row["width"])
                    lists = sorted_lists(vectors_)
                    continue
                if held != place:  # the hash left this block empty
                    continue
                q_ids = np.frombuffer(row["ids"], np.int64)
                q = np.frombuffer(row["data"]).reshape(len(q_ids), row["width"])
                w = min(q.shape[1], vectors_.shape[1])
                q, v = q[:, :w], np.ascontiguousarray(vectors_[:, :w])
                if v.size and q.size and np.abs(v).max() * np.abs(q).max() * w >= 2.0**53:
                    v, q = np.array([[int(x) for x in r] for r in v], object).reshape(v.shape), np.array([[int(x) for x in r] for r in q], object).reshape(q.shape)
                    found = [threshold_search(v, ids, lists, q[i], k, int(q_ids[i])) for i in range(len(q_ids))]
                    owner = np.repeat(np.arange(len(q_ids)), [len(f[0]) for f in found])
                    near = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
                    scores = pa.array([max(LEAST, min(MOST, int(s))) for f in found for s in f[1]], pa.int64())
                else:
                    owner, near, scores = threshold_searches(v, ids, lists[:w], q, q_ids, k)
                    scores = pa.array(scores.astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[owner]), pa.array(near, pa.int64()), scores], names=["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
