"""Exact deduplication by deterministic block naming.

Texts are cut into blocks of a fixed number of bytes. Sorting all blocks gives every distinct block an integer name;
adjacent pairs of names are sorted and named in turn, until each document is down to one name. Documents of equal
numbers of blocks are equal if and only if their last names are equal: names stand for contents, not for hashes.

The sort is a range partitioning on (hash of the block, document), so that a block which a third of all rows share is dealt over
many tasks, and the sample that bounds the ranges holds numbers alone. Each task numbers the distinct keys of its own range: equal hashes are sorted by
the keys themselves, so different blocks never share a name. A key that several ranges hold has its name from the first of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

BLOCK_BYTES = 4096
#: Rows of a range of the sort; the number of ranges follows the number of blocks.
BLOCKS_PER_RANGE = 12_000
PAIRS_PER_RANGE = 500_000


#: Kinds of rows that :func:`_ordinals` makes.
ROW, COUNT, EDGE = 0, 1, 2


def _ordinals(width: int, payload: list[str], schema: pa.Schema):
    """For ``mapInArrow`` over ranges sorted by hash and key: the ordinal of each row's key among the keys of the range.

    The first column is the hash, the next ``width`` the key. Further rows hold the number of keys, and the keys of the first and the last hash: these
    may be in other ranges too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count, last, first_hash, last_hash = TaskContext.get().partitionId(), 0, None, None, None
        first_keys, last_keys = [], []

        def made(kind: int, local: pa.Array, payloads: list, keys: list) -> pa.RecordBatch:
            n = len(local)
            columns = [pa.array([kind] * n, pa.int32()), pa.array([task] * n, pa.int32()), local, *payloads]
            columns += keys or [pa.nulls(n, f.type) for f in list(schema)[len(columns):]]
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            hashes, keys = batch.column(0).to_numpy(), [batch.column(i) for i in range(1, width + 1)]
            fresh = pa.array([last is None or tuple(k[0].as_py() for k in keys) != last])
            if n > 1:
                differs = pc.not_equal(keys[0].slice(1), keys[0].slice(0, n - 1))
                for k in keys[1:]:
                    differs = pc.or_(differs, pc.not_equal(k.slice(1), k.slice(0, n - 1)))
                fresh = pa.concat_arrays([fresh, differs])
            local = pc.add(pc.cumulative_sum(fresh.cast(pa.int64())), count)
            begins = np.flatnonzero(fresh.to_numpy(zero_copy_only=False))

            def of(value: int) -> list[tuple]:
                return [(local[i].as_py(), *(k[i].as_py() for k in keys)) for i in begins[hashes[begins] == value].tolist()]

            first_hash = hashes[0] if first_hash is None else first_hash
            if hashes[0] == first_hash:
                first_keys += of(first_hash)
            last_keys = (last_keys if hashes[-1] == last_hash else []) + of(hashes[-1])
            last, last_hash, count = tuple(k[n - 1].as_py() for k in keys), hashes[-1], local[n - 1].as_py()
            yield made(ROW, local, [batch.column(c) for c in payload], [])
        if count:
            nothing = [pa.nulls(1, schema.field(c).type) for c in payload]
            yield made(COUNT, pa.array([count], pa.int64()), nothing, [])
            for edge in sorted({*first_keys, *last_keys}):
                yield made(EDGE, pa.array([edge[0]], pa.int64()), nothing, [pa.array([x], f.type) for x, f in zip(edge[1:], list(schema)[-width:])])

    return run


def hash_of(key: list[str]) -> Column:
    return F.xxhash64(*key)


def name_rows(df: DataFrame, key: list[str], tie: list[str], ranges: int, label: str) -> DataFrame:
    """The columns of ``df`` but for ``key``, and ``name``: a number that rows of the same key alone share.

    Key columns hold no nulls. What is broadcast is a number or two per range.
    """
    payload = [c for c in df.columns if c not in key]
    hashed = df.select(hash_of(key).alias("__hash"), *key, *payload)
    ordered = hashed.repartitionByRange(max(1, ranges), "__hash", *tie).sortWithinPartitions("__hash", *key)
    fields = {f.name: f.dataType.simpleString() for f in df.schema}
    layout = [("__kind", "int"), ("__task", "int"), ("__local", "bigint"), *((c, fields[c]) for c in payload), *((f"__key{i}", fields[k]) for i, k in enumerate(key))]
    arrow = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(c, arrow[t]) for c, t in layout])
    numbered = scratch.write(ordered.mapInArrow(_ordinals(len(key), payload, schema), ", ".join(f"`{c}` {t}" for c, t in layout)), label)
    before = F.sum("__local").over(Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1))
    base = numbered.where(F.col("__kind") == COUNT).select("__task", F.coalesce(before, F.lit(0)).alias("__base"))  # a row per range
    edges = numbered.where(F.col("__kind") == EDGE)
    place = F.struct("__task", "__local")
    shared = edges.groupBy(*(f"__key{i}" for i in range(len(key)))).agg(F.collect_list(place).alias("__at"), F.min(place).alias("__first")).where(F.size("__at") > 1)
    moved = shared.select(F.explode("__at").alias("__p"), "__first").where("__p <> __first")
    moved = moved.join(F.broadcast(base.select(F.col("__task").alias("__t"), F.col("__base").alias("__b"))), F.col("__first.__task") == F.col("__t"))
    moved = moved.select(F.col("__p.__task").alias("__mt"), F.col("__p.__local").alias("__ml"), (F.col("__b") + F.col("__first.__local")).alias("__name"))
    rows = numbered.where(F.col("__kind") == ROW).join(F.broadcast(base), "__task")
    rows = rows.join(F.broadcast(moved), (F.col("__task") == F.col("__mt")) & (F.col("__local") == F.col("__ml")), "left")
    return rows.select(*payload, F.coalesce(F.col("__name"), F.col("__base") + F.col("__local")).alias("name"))


def identities(docs: DataFrame, text: str = "text", id_col: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, row (its own number), text_sha256, and (blocks, name), equal for equal texts alone."""
    content = F.coalesce(F.col(text), F.lit("")).cast("binary")
    base = docs.select(F.col(id_col).alias("doc_id"), content.alias("__bytes"), F.monotonically_increasing_id().alias("row"))
    n_blocks = F.greatest(F.lit(1), F.ceil(F.length("__bytes") / block_bytes)).cast("int")

    def piece(i: Column) -> Column:
        return F.struct(i.alias("idx"), F.substring(F.col("__bytes"), i * block_bytes + 1, F.lit(block_bytes)).alias("block"))

    cut = base.select(
        "doc_id", "row", F.sha2("__bytes", 256).alias("text_sha256"), n_blocks.alias("blocks"),
        F.transform(F.sequence(F.lit(0), n_blocks - 1), piece).alias("pieces"),
    )
    size = docs.select(F.sum(F.greatest(F.lit(1), F.ceil(F.octet_length(F.coalesce(F.col(text), F.lit(""))) / block_bytes))), F.max(F.ceil(F.octet_length(text) / block_bytes))).first()
    total, longest = int(size[0] or 0), int(size[1] or 1)
    blocks = cut.select("doc_id", "row", "text_sha256", "blocks", F.explode("pieces").alias("p"))
    # the document's own columns go with its first block alone
    first = F.col("p.idx") == 0
    blocks = blocks.select(
        F.col("p.block").alias("block"), "row", F.col("p.idx").alias("idx"), "blocks", F.col("blocks").alias("left"),
        F.when(first, F.col("doc_id")).alias("doc_id"), F.when(first, F.col("text_sha256")).alias("text_sha256"),
    )
    named = name_rows(blocks, ["block"], ["row", "idx"], total // BLOCKS_PER_RANGE + 1, "blocks")
    done = [named.where("left = 1")]
    while longest > 1:
        open_ = named.where("left > 1")
        half = F.floor(F.col("idx") / 2).cast("int")
        pairs = open_.groupBy("row", half.alias("half"), "blocks", "left").agg(
            F.max(F.when(F.col("idx") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("idx") % 2 == 1, F.col("name"))), F.lit(0)).alias("b"),
            F.max("doc_id").alias("doc_id"), F.max("text_sha256").alias("text_sha256"),
        )
        pairs = pairs.select("a", "b", "row", F.col("half").alias("idx"), "blocks", F.ceil(F.col("left") / 2).cast("int").alias("left"), "doc_id", "text_sha256")
        total, longest = (total + 1) // 2, (longest + 1) // 2
        named = name_rows(pairs, ["a", "b"], ["row", "idx"], total // PAIRS_PER_RANGE + 1, "pairs")
        done.append(named.where("left = 1"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("doc_id", "row", "text_sha256", "blocks", "name")


def _with_tops(ids: DataFrame) -> DataFrame:
    """``ids`` with the row that stays (__top: doc_id, row) and the rows (__n) of each group of equal texts; null for a text that is alone."""
    ids = scratch.write(ids, "identities")
    groups = ids.groupBy("blocks", "name").agg(F.max(F.struct("doc_id", "row")).alias("__top"), F.count(F.lit(1)).alias("__n"))
    groups = scratch.write(groups.where("__n > 1").select(F.col("blocks").alias("__b"), F.col("name").alias("__name"), "__top", "__n"), "groups")
    return ids.join(groups, (F.col("blocks") == F.col("__b")) & (F.col("name") == F.col("__name")), "left")


def exact_dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if their UTF-8 bytes are; null counts as empty. Of equal texts the row with the largest doc_id stays
    (a null doc_id is the smallest; among repeated rows of one doc_id exactly one stays). Other columns of the
    input, whatever their names, play no part. An empty table gives an empty table.
    """
    joined = _with_tops(identities(docs, text, id_col, block_bytes))
    return joined.select(
        "doc_id",
        F.when(F.col("__n").isNull(), F.col("doc_id")).otherwise(F.col("__top.doc_id")).alias("keep_id"),
        F.coalesce("__n", F.lit(1).cast("bigint")).alias("group_size"),
        F.coalesce(F.col("row") == F.col("__top.row"), F.lit(True)).alias("kept"),
        "text_sha256",
    )


def keep_distinct(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_dedup` keeps, all columns unchanged. Rows are told apart by doc_id and text; of repeated rows one stays."""
    keys = _with_tops(identities(docs, text, id_col)).where("__n > 1").groupBy(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    keys = scratch.write(keys.agg(F.max(F.col("row") == F.col("__top.row")).alias("stays"), F.count(F.lit(1)).alias("n")), "judged")
    return scratch.without(docs, keys.where("not stays"), keys.where("stays and n > 1"), text, id_col)
