"""Removal of repeated passages by merged Burrows-Wheeler transforms.

A passage is a string of LENGTH bytes. What has to be sorted is cut down and dealt out exactly:

1. Every passage has minimizers, the least hashes among its k-grams. Equal passages have equal minimizers, so passages whose
   minimizer of long k-grams occurs once in the corpus can't repeat. Blocks of documents send each bucket of
   minimizers the set of theirs and hear which occur elsewhere.
2. Runs of the passages left, of successive ones with one minimizer of short k-grams, are dealt out by that minimizer:
   blocks send their distinct runs, with the bytes around them and the least doc_id that has them. A minimizer that a sample of
   the documents shows to have very many runs is dealt out by whole passages instead, so that no bucket gathers an
   unbounded group.
3. A bucket splits the distinct strings into shards, builds the Burrows-Wheeler transform of each, and merges the
   transforms by iterative interleave refinement: pass h of the interleave is right for the first h steps, and keeps
   the intervals of equal prefixes. After LENGTH / 2 passes of two bytes each interval holds all occurrences of one passage, no
   suffix having been sorted anew; the least doc_id of an interval goes back to the blocks.
4. Blocks mark the passages whose least doc_id is smaller than their own.

Texts are shuffled once; all else is packed into one row per block and bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 50
#: Length of the k-grams that passages are told apart by first, and of those that they are dealt out by.
FILTER_K = 32
K = 16
#: Bytes of text of a block of documents, and for each bucket of minimizers.
BLOCK_BYTES = 6_000_000
BUCKET_BYTES = 12_000_000
#: A minimizer with more strings than this, as one document of SAMPLE_SHARE tells, is dealt out by whole passages; at most MAX_HOT
#: are. Which ones are only decides where passages meet, never what is found.
HOT_STRINGS = 50_000
SAMPLE_SHARE = 64
MAX_HOT = 10_000
SHARDS = 2
#: Bytes that a symbol of the transforms has; LENGTH is a multiple.
STEP = 2
#: Bytes that one pass of hashing takes.
CHUNK = 1 << 20
NOBODY = np.int64(2**63 - 1)
BASE = np.uint64(0x9E3779B97F4A7C15)

_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None:
        up, down = np.full(CHUNK + LENGTH + 1, BASE), np.full(CHUNK + LENGTH + 1, np.uint64(pow(int(BASE), -1, 1 << 64)))
        up[0] = down[0] = 1
        _powers = np.cumprod(up), np.cumprod(down)
    return _powers


def passage_minimizers(data: np.ndarray, ks: tuple[int, ...], length: int = LENGTH) -> list[np.ndarray]:
    """Minimizers of the passage at each position of a chunk, for each k; neighbours in a chunk may be of different documents."""
    n, m, out = len(data), len(data) - length + 1, []
    up, down = _power_tables()
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        for k in ks:
            least = (total[k:] - total[: n - k + 1]) * down[: n - k + 1]
            least ^= least >> np.uint64(32)
            least *= np.uint64(0xD6E8FEB86659FD93)
            least ^= least >> np.uint64(32)
            width, size = length - k + 1, 1
            while size * 2 <= width:
                least = np.minimum(least[:-size], least[size:])
                size *= 2
            out.append(np.minimum(least[:m], least[width - size : width - size + m]))
    return out


def _runs_of(same: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of positions that are ``inside``; ``same``: as the position before."""
    new = ~same
    new[1:] |= ~inside[:-1]
    first = np.flatnonzero(new & inside)
    stop = np.flatnonzero(np.r_[(new | ~inside)[1:], True])
    return first, stop[np.searchsorted(stop, first)] - first + 1


class Block:
    """Documents laid end to end, and the runs of their passages with one minimizer: start, number of passages, minimizer."""

    def __init__(self, texts: list[bytes], doc_ids: np.ndarray) -> None:
        self.raw = b"".join(texts)
        self.data = np.frombuffer(self.raw, np.uint8)
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(self.sizes)
        self.doc_ids = doc_ids

    def passages(self, ks: tuple[int, ...]) -> Iterator[tuple[int, list[np.ndarray], np.ndarray, np.ndarray]]:
        """For each chunk: its offset, minimizers, whether a position has a passage, and the position's document."""
        n = len(self.data)
        for a in range(0, max(0, n - LENGTH + 1), CHUNK):
            values = passage_minimizers(self.data[a : a + CHUNK + LENGTH - 1], ks)
            at = np.arange(a, a + len(values[0]))
            first = int(np.searchsorted(self.ends, a, side="right"))
            cut = self.ends[first:] - a
            doc = first + np.cumsum(np.bincount(cut[cut < len(at)], minlength=len(at)))
            yield a, values, at + LENGTH <= self.ends[doc], doc

    def filter_keys(self, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys (bucket << 32 | 32 bits), whether several runs have one, and the key's number and length of each run."""
        found, lengths, self.long_runs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], []
        for _, (value,), inside, doc in self.passages((FILTER_K,)):
            same = np.r_[False, (value[1:] == value[:-1]) & (doc[1:] == doc[:-1])]
            first, size = _runs_of(same, inside)
            found.append(value[first])
            lengths.append(size)
            self.long_runs.append((first, size))
        value = np.concatenate(found)
        bucket = (value >> np.uint64(32)) % np.uint64(n_buckets)
        keys, number, count = np.unique(bucket << np.uint64(32) | value & np.uint64(0xFFFFFFFF), return_inverse=True, return_counts=True)
        return keys, count > 1, number, np.concatenate(lengths)

    def strings(self, elsewhere: np.ndarray, n_buckets: int, hot: set[int] | None = None):
        """Runs of passages that may repeat, as numbered distinct strings.

        (start, passages and number of each run; strings, their minimizers and buckets). ``elsewhere``: whether each run of
        :meth:`filter_keys`, which comes before, may repeat. Runs of ``hot`` minimizers are split into passages.
        """
        starts, runs, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        at = 0
        for (first, size), (a, (short,), inside, doc) in zip(self.long_runs, self.passages((K,))):
            near = np.r_[False, doc[1:] == doc[:-1]]
            edge = np.zeros(len(inside) + 1, np.int8)
            kept = elsewhere[at : at + len(first)]
            at += len(first)
            edge[first[kept]] += 1
            edge[first[kept] + size[kept]] -= 1
            inside &= np.cumsum(edge[:-1], dtype=np.int8) > 0
            first, size = _runs_of(near & np.r_[False, short[1:] == short[:-1]], inside)
            starts.append(first + a)
            runs.append(size)
            values.append(short[first])
        starts, runs, values = np.concatenate(starts), np.concatenate(runs), np.concatenate(values)
        many = np.isin(values, np.array(sorted(hot), np.uint64)) if hot else np.zeros(len(values), bool)
        n_many = runs[many]
        spread = np.repeat(starts[many] - (np.cumsum(n_many) - n_many), n_many) + np.arange(n_many.sum())
        n_cold = int((~many).sum())
        starts, runs, values = np.concatenate([starts[~many], spread]), np.concatenate([runs[~many], np.ones(len(spread), np.int64)]), values[~many]
        known: dict[bytes, int] = {}
        number_of, raw = known.setdefault, self.raw
        ids = np.array([number_of(raw[a:b], len(known)) for a, b in zip(starts.tolist(), (starts + runs + LENGTH - 1).tolist())], np.int64)
        words, minimizers = list(known), np.zeros(len(known), np.uint64)
        minimizers[ids[:n_cold]] = values
        for i in np.unique(ids[n_cold:]).tolist():
            minimizers[i] = xxhash.xxh64_intdigest(words[i], 7)
        return starts, runs, ids, words, minimizers, ((minimizers >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int64)

    def owner(self, at: np.ndarray) -> np.ndarray:
        return self.doc_ids[np.searchsorted(self.ends, at, side="right")]


def shard_transform(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the suffixes, the STEP symbols before each) of strings that end in the symbol 0, sorted to a depth of 64.

    A string is read in a circle, as the merge reads it. Order beyond that depth is never looked at. The transform takes
    two bytes a step, which halves the passes of the merge.
    """
    begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = np.arange(len(codes)) - begin
    size = np.repeat(sizes, sizes)
    key = np.zeros(len(codes), np.uint64)
    for j in range(8):
        key = key << np.uint64(8) | codes[begin + (place + j) % size]
    depth = 8
    while depth < 64:
        rank = np.unique(key, return_inverse=True)[1].astype(np.uint64)
        key = rank * np.uint64(len(codes)) + rank[begin + (place + depth) % size]
        depth *= 2
    order = np.argsort(key)  # suffixes alike to that depth may stand in any order
    before = codes[begin + (place - 2) % size].astype(np.uint16) << np.uint16(8) | codes[begin + (place - 1) % size]
    return order, before[order]


def merge_transforms(transforms: list[np.ndarray], passes: int) -> tuple[np.ndarray, np.ndarray]:
    """(row in the shards' concatenation, interval) of each place of the merged order, right for ``passes`` steps.

    ``shard`` is the interleave. A pass takes the symbols in its order and sorts them stably, which makes it right for
    one more step; two neighbours share a longer prefix if their symbols agree and what follows did before.
    """
    sizes = [len(t) for t in transforms]
    shard = np.repeat(np.arange(len(transforms), dtype=np.uint8), sizes)
    interval = np.zeros(len(shard), np.int32)
    place = np.empty(len(shard), np.uint16)
    fresh = np.zeros(len(shard), bool)
    for _ in range(passes):
        for i, t in enumerate(transforms):
            place[shard == i] = t
        order = np.argsort(place, kind="stable")
        shard, follows, first = shard[order], interval[order], place[order]
        np.not_equal(first[1:], first[:-1], out=fresh[1:])
        fresh[1:] |= follows[1:] != follows[:-1]
        interval = np.cumsum(fresh, dtype=np.int32)
    rows = np.empty(len(shard), np.int64)
    for i, offset in enumerate(np.cumsum(sizes) - sizes):
        rows[shard == i] = np.arange(offset, offset + sizes[i])
    return rows, interval


def least_owners(strings: list[bytes], owners: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """For each passage of each string, in order: the least owner among all strings that hold the passage."""
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    # no byte of UTF-8 is 255, so codes fit 8 bits with 0 to end a string
    bounds = np.linspace(0, len(strings), min(SHARDS, len(strings)) + 1).astype(int)
    transforms, suffixes = [], []
    offsets = np.cumsum(lengths + 1) - (lengths + 1)
    for a, b in zip(bounds, bounds[1:]):
        codes = np.frombuffer(b"\xff".join(strings[a:b]) + b"\xff", np.uint8) + np.uint8(1)
        order, transform = shard_transform(codes, lengths[a:b] + 1)
        suffixes.append(order + offsets[a])
        transforms.append(transform)
    rows, interval = merge_transforms(transforms, depth // STEP)
    suffix = np.concatenate(suffixes)[rows]
    total = int(lengths.sum()) + len(strings)
    string = np.repeat(np.arange(len(strings)), lengths + 1)
    passage = (np.arange(total) - offsets[string]) + depth <= lengths[string]
    owner = np.where(passage, owners[string], NOBODY)
    starts = np.flatnonzero(np.r_[True, interval[1:] != interval[:-1]])
    least = np.empty(total, np.int64)
    least[suffix] = np.minimum.reduceat(owner[suffix], starts)[interval]
    return least[passage]


def solve_bucket(strings: list[bytes], values: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """As :func:`least_owners`; a string that is its minimizer's only one has no other to be merged with."""
    _, group, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count[group] > 1
    passages = np.fromiter(map(len, strings), np.int64, len(strings)) - LENGTH + 1
    out = np.repeat(owners, passages)
    if shared.any():
        out[np.repeat(shared, passages)] = least_owners([s for s, x in zip(strings, shared) if x], owners[shared])
    return out


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().fill_null(int(NOBODY)).to_numpy(zero_copy_only=False).astype(np.int64)


def _in_order(table: pa.Table) -> pa.Table:
    """A block's documents in one order for every stage; a shuffle brings them in any."""
    ids, texts = _ids(table.column("doc_id")).tolist(), table.column("text").to_pylist()
    return table.take(pa.array(sorted(range(len(ids)), key=lambda i: (ids[i], texts[i])), pa.int64()))


def _block(table: pa.Table) -> Block:
    return Block(table.column("text").to_pylist(), _ids(table.column("doc_id")))


def _by_bucket(buckets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(buckets, kind="stable")
    cut = np.flatnonzero(np.diff(buckets[order])) + 1
    for part in np.split(order, cut):
        if len(part):
            yield int(buckets[part[0]]), part


def _answers(keys: np.ndarray, replies: pa.Table) -> np.ndarray:
    answer = np.zeros(len(keys), np.uint8)
    bucket = (keys >> np.uint64(32)).astype(np.int64)
    got = dict(zip(replies.column("bucket").to_pylist(), replies.column("states").to_pylist()))
    for b, part in _by_bucket(bucket):
        answer[part] = np.frombuffer(got[b], np.uint8)
    return answer


def _dealt(docs: DataFrame, text: str, id_col: str) -> tuple[DataFrame, int]:
    content = F.coalesce(F.col(text), F.lit("")).cast("binary")
    total = int(docs.select(F.sum(F.octet_length(F.col(text)))).first()[0] or 0)
    n_blocks = total // BLOCK_BYTES + 1
    dealt = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), content.alias("text"), F.pmod(F.xxhash64(id_col, content), F.lit(n_blocks)).cast("int").alias("block"))
    return dealt, total // BUCKET_BYTES + 1


def hot_minimizers(dealt: DataFrame) -> set[int]:
    def count(table: pa.Table) -> pa.Table:
        block = _block(table)
        runs = len(block.filter_keys(1)[3])
        _, _, _, _, minimizers, _ = block.strings(np.ones(runs, bool), 1)
        value, n = np.unique(minimizers, return_counts=True)
        several = n > 1
        return pa.table({"minimizer": pa.array(value[several].view(np.int64)), "n": pa.array(n[several], pa.int64())})

    sample = dealt.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(SAMPLE_SHARE)) == 0)
    totals = sample.groupBy("block").applyInArrow(count, "minimizer bigint, n bigint").groupBy("minimizer").agg(F.sum("n").alias("n"))
    found = totals.where(F.col("n") * SAMPLE_SHARE > HOT_STRINGS).orderBy(F.col("n").desc(), "minimizer").limit(MAX_HOT).collect()
    return {r["minimizer"] & 0xFFFFFFFFFFFFFFFF for r in found}


def repeats(docs: DataFrame, make, schema: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``make(doc_id, content, removed)`` for each document, ``removed`` marking the bytes of repeated passages."""
    dealt, n_buckets = _dealt(docs, text, id_col)
    by_block = dealt.groupBy("block")

    def ask(table: pa.Table) -> pa.Table:
        keys, *_ = _block(_in_order(table)).filter_keys(n_buckets)
        low, parts = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), list(_by_bucket((keys >> np.uint64(32)).astype(np.int64)))
        block = table.column("block")[0].as_py()
        return pa.table({"bucket": pa.array([b for b, _ in parts], pa.int32()), "block": pa.array([block] * len(parts), pa.int32()), "keys": pa.array([low[p].tobytes() for _, p in parts], pa.binary())})

    def hear(table: pa.Table) -> pa.Table:
        sent = [np.frombuffer(k, np.uint32) for k in table.column("keys").to_pylist()]
        known, count = np.unique(np.concatenate(sent), return_counts=True)
        state = (count > 1).astype(np.uint8)
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "states": pa.array([state[np.searchsorted(known, s)].tobytes() for s in sent], pa.binary())})

    states = by_block.applyInArrow(ask, "bucket int, block int, keys binary").groupBy("bucket").applyInArrow(hear, "block int, bucket int, states binary")

    hot = hot_minimizers(dealt)

    def candidates(table: pa.Table, replies: pa.Table):
        block = _block(table)
        keys, several, number, _ = block.filter_keys(n_buckets)
        return block, block.strings(((_answers(keys, replies) > 0) | several)[number], n_buckets, hot)

    def send(table: pa.Table, replies: pa.Table) -> pa.Table:
        rows = {"bucket": [], "block": [], "chars": [], "passages": [], "minimizers": [], "owners": []}
        if table.num_rows:
            block, (starts, _, ids, words, values, buckets) = candidates(_in_order(table), replies)
            owners = np.full(len(words), NOBODY)
            np.minimum.at(owners, ids, block.owner(starts))
            sizes = np.fromiter(map(len, words), np.int64, len(words)) - LENGTH + 1
            name = table.column("block")[0].as_py()
            for b, part in _by_bucket(buckets):
                found = (b, name, b"".join([words[i] for i in part.tolist()]), sizes[part].astype(np.uint32).tobytes(), values[part].tobytes(), owners[part].tobytes())
                for column, x in zip(rows.values(), found):
                    column.append(x)
        return pa.table({k: pa.array(v, pa.int32() if k in ("bucket", "block") else pa.binary()) for k, v in rows.items()})

    sent = by_block.cogroup(states.groupBy("block")).applyInArrow(send, "bucket int, block int, chars binary, passages binary, minimizers binary, owners binary")

    def solve(table: pa.Table) -> pa.Table:
        known: dict[bytes, int] = {}
        number_of, numbers, sizes_of, values, owners = known.setdefault, [], [], [], []
        for chars, passages, minimizers, own in zip(*(table.column(c).to_pylist() for c in ("chars", "passages", "minimizers", "owners"))):
            sizes = np.frombuffer(passages, np.uint32).astype(np.int64)
            ends = np.cumsum(sizes + LENGTH - 1)
            numbers.append(np.array([number_of(chars[a:b], len(known)) for a, b in zip((ends - sizes - LENGTH + 1).tolist(), ends.tolist())], np.int64))
            sizes_of.append(sizes)
            values.append(np.frombuffer(minimizers, np.uint64))
            owners.append(np.frombuffer(own, np.int64))
        least, value = np.full(len(known), NOBODY), np.zeros(len(known), np.uint64)
        np.minimum.at(least, np.concatenate(numbers), np.concatenate(owners))
        value[np.concatenate(numbers)] = np.concatenate(values)
        words = list(known)
        solved = solve_bucket(words, value, least)
        passages = np.fromiter(map(len, words), np.int64, len(words)) - LENGTH + 1
        offsets = np.cumsum(passages) - passages
        starts_out, values_out = [], []
        for number, sizes in zip(numbers, sizes_of):
            at = np.repeat(offsets[number] - (np.cumsum(sizes) - sizes), sizes)
            reply = solved[at + np.arange(len(at))]
            change = np.flatnonzero(np.r_[True, reply[1:] != reply[:-1]])
            starts_out.append(change.astype(np.uint32).tobytes())
            values_out.append(reply[change].tobytes())
        binary = pa.binary()
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "states": pa.nulls(table.num_rows, binary), "starts": pa.array(starts_out, binary), "least": pa.array(values_out, binary)})

    solved = sent.groupBy("bucket").applyInArrow(solve, "block int, bucket int, states binary, starts binary, least binary")
    none = F.lit(None).cast("binary")
    replies = states.select("block", "bucket", "states", none.alias("starts"), none.alias("least")).unionByName(solved)

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        heard = replies.filter(pa.compute.is_valid(replies.column("states")))
        told, table = replies.filter(pa.compute.is_valid(replies.column("starts"))), _in_order(table)
        block, (starts, runs, ids, words, _, buckets) = candidates(table, heard)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) - LENGTH + 1
        offsets, total = np.cumsum(sizes) - sizes, int(sizes.sum())
        least = np.empty(total, np.int64)
        got = {b: (np.frombuffer(s, np.uint32), np.frombuffer(v, np.int64)) for b, s, v in zip(*(told.column(c).to_pylist() for c in ("bucket", "starts", "least")))}
        for b, part in _by_bucket(buckets):
            change, value = got[b]
            n = sizes[part]
            full = np.repeat(value, np.diff(np.r_[change.astype(np.int64), n.sum()]))
            least[np.repeat(offsets[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())] = full
        first = np.repeat(offsets[ids] - (np.cumsum(runs) - runs), runs) + np.arange(runs.sum())
        at = np.repeat(starts - (np.cumsum(runs) - runs), runs) + np.arange(runs.sum())
        at = at[least[first] < np.repeat(block.owner(starts), runs)]
        edge = np.zeros(len(block.data) + LENGTH + 1, np.int32)
        edge[at] += 1  # a position starts one passage
        edge[LENGTH:] -= np.bincount(at, minlength=len(edge) - LENGTH).astype(np.int32) if len(at) else 0
        removed = np.cumsum(edge[: len(block.data)]) > 0
        return make(table.column("doc_id").combine_chunks(), block, removed)

    return by_block.cogroup(replies.groupBy("block")).applyInArrow(_when_any(finish, make), schema)


def _when_any(finish, make):
    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        if table.num_rows:
            return finish(table, replies)
        return make(pa.array([], pa.int64()), Block([], np.zeros(0, np.int64)), np.zeros(0, bool))

    return run


def _runs(removed: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal removed runs within documents: start, stop, number of the document."""
    begins = block.ends - block.sizes
    first = removed & np.r_[True, ~removed[:-1]][: len(removed)]
    last = removed & np.r_[~removed[1:], True][-len(removed) :] if len(removed) else removed
    some = begins[block.sizes > 0]
    first[some] = removed[some]
    last[block.ends[block.sizes > 0] - 1] = removed[block.ends[block.sizes > 0] - 1]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, stop, np.searchsorted(block.ends, start, side="right")


def spans(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes and spans: the removed byte ranges (start, stop) of each document, in order.

    Cases are those of :func:`digests`.
    """

    def make(doc_id: pa.Array, block: Block, removed: np.ndarray) -> pa.Table:
        start, stop, doc = _runs(removed, block)
        shift = (block.ends - block.sizes)[doc]
        offsets = np.r_[0, np.cumsum(np.bincount(doc, minlength=len(block.sizes)))]
        pieces = pa.StructArray.from_arrays([pa.array(start - shift, pa.int64()), pa.array(stop - shift, pa.int64())], ["start", "stop"])
        return pa.table({"doc_id": doc_id, "n_bytes": pa.array(block.sizes, pa.int64()), "spans": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pieces)})

    return repeats(docs, make, "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,stop:bigint>>", text, id_col)


def digests(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256, one row per document.

    A byte is removed if a passage of ``LENGTH`` bytes that covers it also starts in a document with a smaller doc_id, judged on the
    input. Passages lie within one document. A null text counts as empty; an empty or short one loses nothing. Rows of one doc_id
    never take from each other; a null doc_id counts as larger than any other. Other columns play no part. An empty table
    gives an empty table.
    """

    def make(doc_id: pa.Array, block: Block, removed: np.ndarray) -> pa.Table:
        _, _, doc = _runs(removed, block)
        n_removed = np.diff(np.r_[0, np.cumsum(removed)][np.r_[0, block.ends]])
        begins = (block.ends - block.sizes).tolist()
        shas = [hashlib.sha256((block.data[a:b][~removed[a:b]] if n else block.data[a:b]).tobytes()).hexdigest() for a, b, n in zip(begins, block.ends.tolist(), n_removed.tolist())]
        return pa.table({
            "doc_id": doc_id, "n_bytes": pa.array(block.sizes, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
            "n_spans": pa.array(np.bincount(doc, minlength=len(block.sizes)), pa.int64()), "kept_sha256": pa.array(shas, pa.string()),
        })

    return repeats(docs, make, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string", text, id_col)
