"""SimHash near-deduplication over shards of a vantage-point tree.

Distinct fingerprints are partitioned by their Hamming distance from vantage points. Two fingerprints at most r apart differ
by at most r in their distance from any point, so each fingerprint visits, besides its own shard, only those that the
triangle bounds don't exclude. Shards are searched by the same pruning down to small tiles, which are compared in full.
Where fingerprints stand for sets, the set's size is its distance from the empty set and bounds in the same way: a node of the tree
splits by size or by a vantage point, whichever leaves fewer points that must visit both sides.
Links within a shard come out as trees of bounded degree, never as all pairs, and are joined up over shards.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import memory, scratch

#: Fingerprints that the tree is planned on; more only balance the shards better.
TREE_SAMPLE = 20_000
#: Aimed-at fingerprints of a shard.
SHARD_ROWS = 32_768
#: Fingerprints of a tile that is compared in full, and the rows and columns of it that are compared at once.
TILE = 1_024
STRIP = (16, 4_096)
#: Links of a tile that are held before they are joined up.
HELD_LINKS = 1 << 20
#: Aimed-at shingle sets of a cell; two cells meet in a task.
CELL = 256
#: Children of a node in the trees that carry links.
FANOUT = 8


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of a UTF-8 text. Zero for a text without words."""
    words = text.lower().split()  # bytes: A-Z alone are lower-cased, and only ASCII white space splits
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(b" ".join(words), seed)
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[: len(words) - width])]
    set_bits = np.zeros(64, np.int64)
    for k in range(0, len(starts), 65_536):
        part = zip(starts[k : k + 65_536], ends[width - 1 + k :])
        h = np.array([digest(joined[a:b], seed) for a, b in part], np.uint64)
        set_bits += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_bits * 2 > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = 4, seed: int = 42) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long). A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py(), width, seed) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])
        memory.give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    return source.mapInArrow(run, f"doc_id {kind}, fp bigint")


@dataclass(frozen=True)
class Node:
    """Inner: fingerprints within ``radius`` of ``point``, or with ``bound`` sets of that size at most; outer: the others. A leaf has a shard number alone."""

    shard: int = -1
    point: int = 0
    radius: int = 0
    inner: Node | None = None
    outer: Node | None = None
    bound: int = -1


def size_visits(sizes: np.ndarray, bound: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Which sets may have a Jaccard similarity of ``least`` to one of ``bound`` elements or fewer, and to a larger one: of two, the smaller has ``least`` times the larger's."""
    return bound >= least * sizes, sizes >= least * (bound + 1)


def distance_visits(distance: np.ndarray, radius: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    return distance <= radius + reach, distance > radius - reach


def plan_tree(sample: np.ndarray, depth: int, seed: int = 1, reach: int = 0, sizes: np.ndarray | None = None, least: float = 0.0) -> Node:
    counter = iter(range(1 << (depth + 1)))
    rng = np.random.default_rng(seed)

    def build(at: np.ndarray, left: int) -> Node:
        points = sample[at]
        if left and len(points) >= 8:
            point = points[rng.integers(len(points))]
            d = np.bitwise_count(points ^ point).astype(np.int16)
            radius = int(np.median(d))
            near, bound = d <= radius, -1
            splits = 0 < near.sum() < len(points)
            if sizes is not None:
                middle = int(np.median(sizes[at]))
                small = sizes[at] <= middle
                twice = [(x & y).sum() for x, y in (size_visits(sizes[at], middle, least), distance_visits(d, radius, reach))]
                if 0 < small.sum() < len(points) and (not splits or twice[0] < twice[1]):
                    near, bound, splits = small, middle, True
            if splits:
                return Node(-1, int(point), radius, build(at[near], left - 1), build(at[~near], left - 1), bound)
        return Node(next(counter))

    return build(np.arange(len(sample)), depth)


def route(node: Node, fps: np.ndarray, reach: int, sizes: np.ndarray | None = None, least: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, shard, home) of every shard that may hold something within ``reach`` of a fingerprint; home: its own.

    With ``sizes`` of sets, something whose size also allows a Jaccard similarity of ``least``.
    """
    out: list[tuple[np.ndarray, int, np.ndarray]] = []

    def walk(n: Node, idx: np.ndarray, home: np.ndarray) -> None:
        if not len(idx):
            return
        if n.inner is None or n.outer is None:
            out.append((idx, n.shard, home))
            return
        if n.bound >= 0:
            a, b = size_visits(sizes[idx], n.bound, least)
            inside = sizes[idx] <= n.bound
        else:
            d = np.bitwise_count(fps[idx] ^ np.uint64(n.point)).astype(np.int16)
            a, b = distance_visits(d, n.radius, reach)
            inside = d <= n.radius
        walk(n.inner, idx[a], home[a] & inside[a])
        walk(n.outer, idx[b], home[b] & ~inside[b])

    walk(node, np.arange(len(fps)), np.ones(len(fps), bool))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)
    return np.concatenate([o[0] for o in out]), np.concatenate([np.full(len(o[0]), o[1], np.int32) for o in out]), np.concatenate([o[2] for o in out])


class Linked:
    """Components of numbered points: each point has the smallest number that it is linked to."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while True:
            a, b = label[i], label[j]
            open_ = a != b
            if not open_.any():
                return
            i, j, low, high = i[open_], j[open_], np.minimum(a, b)[open_], np.maximum(a, b)[open_]
            np.minimum.at(label, high, low)
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up

    def tree_edges(self) -> tuple[np.ndarray, np.ndarray]:
        """A tree over each component in which no point has over ``FANOUT`` + 1 edges."""
        order = np.argsort(self.label, kind="stable")
        label = self.label[order]
        start = np.flatnonzero(np.r_[True, label[1:] != label[:-1]]) if len(label) else np.zeros(0, int)
        first = np.repeat(start, np.diff(np.r_[start, len(label)]))
        place = np.arange(len(label)) - first
        child = np.flatnonzero(place > 0)
        return order[child], order[first[child] + (place[child] - 1) // FANOUT]


def near_pairs(rows: np.ndarray, columns: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs within ``reach``, strip by strip; a strip's distances stay in the processor's cache."""
    height, width = STRIP
    apart, count, near = (np.empty(height * width, t) for t in (np.uint64, np.uint8, bool))
    for m in range(0, len(columns), width):
        some = columns[m : m + width]
        for k in range(0, len(rows), height):
            part = rows[k : k + height]
            cells, shape = len(part) * len(some), (len(part), len(some))
            np.bitwise_xor(part[:, None], some[None, :], out=apart[:cells].reshape(shape))
            np.bitwise_count(apart[:cells], out=count[:cells])
            np.less_equal(count[:cells], reach, out=near[:cells])
            found = np.flatnonzero(near[:cells])
            if len(found):
                i, j = np.divmod(found, len(some))
                yield i + k, j + m


def link_within(
    home: np.ndarray, guests: np.ndarray, reach: int, seed: int = 1, second: np.ndarray | None = None, both: int = 128,
    sizes: np.ndarray | None = None, least: float = 0.0,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All fingerprints, and tree edges (as indexes) over the links home-home and home-guest.

    With ``second``, a further fingerprint of each point, a link differs in ``both`` bits of the two at most. With ``sizes`` of the points' sets, links
    are between sizes that allow a Jaccard similarity of ``least``.
    """
    points = np.concatenate([home, guests])
    linked, rng = Linked(len(points)), np.random.default_rng(seed)

    def tile(h: np.ndarray, q: np.ndarray) -> None:
        held, n_held = [], 0
        for k in range(0, len(h), TILE):
            rows = h[k : k + TILE]
            for i, j in near_pairs(points[rows], points[q], reach):
                i, j = rows[i], q[j]
                if second is not None:
                    able = np.bitwise_count(points[i] ^ points[j]) + np.bitwise_count(second[i] ^ second[j]) <= both
                    i, j = i[able], j[able]
                if sizes is not None:
                    able = np.minimum(sizes[i], sizes[j]) >= least * np.maximum(sizes[i], sizes[j])
                    i, j = i[able], j[able]
                if len(i):
                    held.append((i, j))
                    n_held += len(i)
                if n_held > HELD_LINKS:
                    linked.add(*map(np.concatenate, zip(*held)))
                    held, n_held = [], 0
        if n_held:
            linked.add(*map(np.concatenate, zip(*held)))

    def search(h: np.ndarray, q: np.ndarray) -> None:
        """Links of home points ``h`` (which ``q`` holds too) with ``q``."""
        if not len(h) or not len(q):
            return
        if len(h) > TILE:
            point = points[h[rng.integers(len(h))]]
            dh, dq = np.bitwise_count(points[h] ^ point).astype(np.int16), np.bitwise_count(points[q] ^ point).astype(np.int16)
            radius = int(np.median(dh))
            near, visits = dh <= radius, distance_visits(dq, radius, reach)
            splits = 0 < near.sum() < len(h)
            if sizes is not None:
                middle = int(np.median(sizes[h]))
                small, fewer = sizes[h] <= middle, size_visits(sizes[q], middle, least)
                if 0 < small.sum() < len(h) and (not splits or sum(x.sum() for x in fewer) < sum(x.sum() for x in visits)):
                    near, visits, splits = small, fewer, True
            if splits:
                search(h[near], q[visits[0]])
                search(h[~near], q[visits[1]])
                return
        tile(h, q)

    search(np.arange(len(home)), np.arange(len(points)))
    return points, *linked.tree_edges()


def linked_fingerprints(fps: DataFrame, reach: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose components are those of all links within ``reach`` bits.

    ``fps`` has one column fp without repeats. The driver sees a sample of at most ``TREE_SAMPLE`` fingerprints.
    """
    return _linked(fps, reach, shard_rows, None)


def _linked(fps: DataFrame, reach: int, shard_rows: int, both: int | None, least: float = 0.0) -> DataFrame:
    """As :func:`linked_fingerprints`; with ``both``, fps has fp, second, node and size, links are as in :func:`link_within`, and edges are of nodes."""
    n = fps.count()
    sample = scratch.bounded_sample(fps, ["fp"], TREE_SAMPLE, 1, n)
    depth = max(0, int(np.ceil(np.log2(max(1, n) / shard_rows)))) if n else 0
    sampled_sizes = None if both is None else np.array([r["size"] for r in sample], np.int64)
    tree = plan_tree(np.array([r["fp"] for r in sample], np.int64).view(np.uint64), depth, reach=reach, sizes=sampled_sizes, least=least)
    extra = [] if both is None else ["second", "node", "size"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            sizes = None if both is None else batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
            idx, shard, home = route(tree, points, reach, sizes, least)
            own = np.empty(len(points), np.int32)
            own[idx[home]] = shard[home]
            # of two shards, one gets the other's guests: a linked pair could visit both ways
            other = own[idx]
            goes = home | ((other < shard) == ((other + shard) % 2 == 1)) & (other != shard)
            idx, shard, home = idx[goes], shard[goes], home[goes]
            carried = [batch.column(c).take(pa.array(idx)) for c in extra]
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(points[idx].view(np.int64)), pa.array(home), *carried], names=["shard", "fp", "home", *extra])

    def search(table: pa.Table) -> pa.Table:
        if both is not None:
            home = table.column("home").to_numpy().astype(bool)
            order = np.r_[np.flatnonzero(home), np.flatnonzero(~home)]
            points, second, node, sizes = (table.column(c).to_numpy().astype(np.int64)[order] for c in ("fp", "second", "node", "size"))
            own = int(home.sum())
            _, a, b = link_within(points[:own].view(np.uint64), points[own:].view(np.uint64), reach, second=second.view(np.uint64), both=both, sizes=sizes, least=least)
            return pa.table({"a": node[a], "b": node[b]})
        points = table.column("fp").to_numpy().astype(np.int64).view(np.uint64)
        home = table.column("home").to_numpy().astype(bool)
        points, a, b = link_within(np.sort(points[home]), points[~home], reach)
        return pa.table({"a": points[a].view(np.int64), "b": points[b].view(np.int64)})

    layout = "shard int, fp bigint, home boolean" + "".join(f", {c} bigint" for c in extra)
    return fps.select("fp", *extra).mapInArrow(deal, layout).groupBy("shard").applyInArrow(search, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for every node of an edge, the smallest node reachable.

    Each round takes the least label among the neighbours and then jumps to that label's own label, and is written out, so
    lineage stays short; the number of rounds is logarithmic in a component's diameter.
    """
    edges = scratch.write(edges, "links")
    both = edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(edges.select("b", "a"))
    both = scratch.write(both.distinct(), "edges")
    labels = scratch.write(both.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("node"), F.least("src", "m").alias("root")), "labels")
    while True:
        told = both.join(labels, F.col("src") == F.col("node")).groupBy("dst").agg(F.min("root").alias("m"))
        lower = labels.join(told, F.col("node") == F.col("dst")).select("node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        parent = labels.select(F.col("node").alias("p"), F.col("root").alias("pr"))
        jumped = scratch.write(lower.join(parent, F.col("root") == F.col("p"), "left").select("node", "old", F.least("root", "pr").alias("root")), "labels")
        scratch.drop(labels)
        labels, moved = jumped, jumped.where("root <> old").limit(1).count()
        if not moved:
            scratch.drop(both)
            return labels.select("node", "root")


def near_dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = 4, seed: int = 42, reach: int = 4, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable by links).

    Documents link if their fingerprints differ in ``reach`` bits or fewer. A null or empty text, and one of white space alone,
    has fingerprint zero and is linked like any other. A shorter text than ``width`` words is one shingle. Repeated rows
    are rows of the same component; a null doc_id is never the smallest unless a component has no other. Other columns of
    the input play no part. An empty table gives an empty table.
    """
    docs = scratch.write(fingerprints(docs, text, id_col, width, seed), "fingerprints")
    distinct = scratch.write(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(linked_fingerprints(distinct.select("fp"), reach, shard_rows))
    rooted = scratch.write(distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    component = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = scratch.write(rooted.join(component, "root").select(F.col("fp").alias("__fp"), "component_id"), "components")
    # one join on the fingerprint: a hot one is split, as nothing after it needs the rows of a key together
    linked = docs.join(named, F.col("fp") == F.col("__fp"))
    return linked.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_hashes(text: bytes, width: int, seed: int = 42) -> np.ndarray:
    """Hashes of the distinct word shingles of a text, sorted; none for a text without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    found = {digest(b" ".join(words[i : i + width]), seed) for i in range(max(1, len(words) - width + 1))}
    return np.sort(np.fromiter(found, np.uint64, len(found)))


def _majority(hashes: np.ndarray) -> int:
    bits = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65_536):
        bits += np.unpackbits(hashes[k : k + 65_536].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > len(hashes)).tobytes(), "big")


def sketch(hashes: np.ndarray) -> tuple[int, int, int]:
    """Two SimHashes of a set of shingles, and a digest that names the set."""
    mixed = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)  # the shingle's bits anew
    mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return _majority(hashes), _majority(mixed ^ (mixed >> np.uint64(31))), xxhash.xxh64_intdigest(hashes.tobytes())


def similar_components(sets: list[np.ndarray], least: float) -> np.ndarray:
    """For each set the number of the first of its component; sets link if their Jaccard similarity is ``least`` or more."""
    sizes = np.fromiter((len(x) for x in sets), np.int64, len(sets))
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
    begin = np.cumsum(sizes) - sizes
    label, open_ = np.full(len(sets), -1), np.arange(len(sets))
    while len(open_):
        root, queue, open_ = open_[0], [open_[0]], open_[1:]
        label[root] = root
        while queue and len(open_):
            x = queue.pop()
            fits = open_[np.minimum(sizes[open_], sizes[x]) >= least * np.maximum(sizes[open_], sizes[x])]
            if not len(fits):
                continue
            if not sizes[x]:
                common, joined = np.zeros(len(fits)), np.zeros(len(fits))
            else:
                n = sizes[fits]
                at = np.cumsum(n) - n
                own = flat[np.repeat(begin[fits] - at, n) + np.arange(n.sum())]
                place = np.minimum(np.searchsorted(sets[x], own), sizes[x] - 1)
                common = np.add.reduceat((sets[x][place] == own).astype(np.int64), at)
                joined = n + sizes[x] - common
            near = fits[common >= least * joined]  # two empty sets are alike
            label[near] = root
            queue.extend(near.tolist())
            open_ = open_[label[open_] < 0]
    return label


def cell_edges(sets: list[np.ndarray], cell: np.ndarray, met: tuple[int, int], cells: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Tree edges (as indexes) for one cell alone, or for what two cells link: trees within a cell come from one of its meetings."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    own = np.arange(len(sets))
    for c in np.unique(cell):
        at = np.flatnonzero(cell == c)
        own[at] = at[similar_components([sets[i] for i in at], least)]
        partner = c + 1 if c + 1 < cells else c - 1
        if cells == 1 or partner in met:
            part = Linked(0)
            part.label = own[at]
            a, b = part.tree_edges()
            found.append((at[a], at[b]))
    if cells > 1:
        heads = np.flatnonzero(own == np.arange(len(sets)))
        across = Linked(0)
        across.label = similar_components(sets, least)[heads]
        a, b = across.tree_edges()
        found.append((heads[a], heads[b]))
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def similar_sets(docs: DataFrame, text: str, id_col: str, width: int, reach: int, both: int, least: float, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """__id, __sha (of the text) and root, for rows in components of more than one row.

    Texts link if their shingle sets have a Jaccard similarity of ``least`` or more. Candidates are sets whose fingerprints differ in ``reach`` bits
    or fewer, and with a second fingerprint in ``both``, and whose sizes allow that similarity; their components are dealt into cells of bounded size, each two of which meet
    in one task, where the sets themselves are compared. A component's root is the smallest name of a set in it.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(*sketch(hashes), len(hashes)) for hashes in (shingle_hashes(x.as_py(), width) for x in batch.column(2))]
            columns = np.array(found, np.uint64).reshape(-1, 4).T.copy().view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c) for c in columns)], names=["__id", "__sha", "fp", "second", "node", "size"])
        memory.give_back()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([shingle_hashes(x.as_py(), width).tobytes() for x in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), found, batch.column(2), batch.column(3)], names=["node", "hashes", "group", "cells"])
        memory.give_back()

    def meet(table: pa.Table) -> pa.Table:
        node, cell = table.column("node").to_numpy(), table.column("cell").to_numpy()
        a, b = cell_edges([np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()], cell, (table.column("low")[0].as_py(), table.column("high")[0].as_py()), table.column("cells")[0].as_py(), least)
        return pa.table({"a": pa.array(node[a]), "b": pa.array(node[b])})

    content = F.coalesce(F.col(text), F.lit("")).cast("binary")
    source = docs.select(F.col(id_col).alias("__id"), scratch.digest(text).alias("__sha"), content.alias("text"))
    drawn = scratch.write(source.mapInArrow(sketches, f"__id {kind}, __sha string, fp bigint, second bigint, node bigint, size bigint"), "sketches")
    nodes = scratch.write(drawn.groupBy("node").agg(F.min("fp").alias("fp"), F.min("second").alias("second"), F.min("size").alias("size"), F.min("__sha").alias("first"), F.count(F.lit(1)).alias("n")), "nodes")
    groups = components(_linked(nodes.select("fp", "second", "node", "size"), reach, shard_rows, both, least)).select(F.col("node").alias("in_group"), F.col("root").alias("group"))
    held = scratch.write(nodes.join(groups, F.col("node") == F.col("in_group")).select("first", F.col("node").alias("member"), "group"), "candidates")
    cells = held.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("cells")).select(F.col("group").alias("of"), "cells")
    texts = source.join(held.join(cells, F.col("group") == F.col("of")), F.col("__sha") == F.col("first")).select("member", "text", "group", "cells").dropDuplicates(["member"])
    own = scratch.write(texts.mapInArrow(sets, "node bigint, hashes binary, group bigint, cells int"), "shingle-sets")
    own = own.withColumn("cell", F.pmod(F.xxhash64("node"), F.col("cells")).cast("int"))
    met = F.when(F.col("cells") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("cells") - 1), lambda i: i != F.col("cell")))
    dealt = own.withColumn("other", F.explode(met)).withColumn("low", F.least("cell", "other")).withColumn("high", F.greatest("cell", "other"))
    roots = components(dealt.groupBy("group", "low", "high").applyInArrow(meet, "a bigint, b bigint")).select(F.col("node").alias("linked"), "root")
    named = nodes.join(roots, F.col("node") == F.col("linked"), "left").where("n > 1 or root is not null").select(F.col("node").alias("linked"), F.coalesce("root", "node").alias("root"))
    return drawn.join(named, F.col("node") == F.col("linked")).select("__id", "__sha", "root")


def keep_one(docs: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = 4, reach: int = 16, both: int = 30, least: float = 0.8) -> DataFrame:
    """One row of each component of :func:`similar_sets`, all columns unchanged: that of the smallest doc_id, a null one last, and one alone of repeated rows."""
    order = F.struct(F.col("__id").isNull().alias("none"), "__id", "__sha")
    members = similar_sets(docs, text, id_col, width, reach, both, least).groupBy("__id", "__sha").agg(F.min("root").alias("root"), F.count(F.lit(1)).alias("n"))
    members = scratch.write(members.withColumn("order", order), "members")
    first = members.groupBy("root").agg(F.min("order").alias("first")).select(F.col("first.__id").alias("id"), F.col("first.__sha").alias("sha"))
    stays = F.col("__id").eqNullSafe(F.col("id")) & (F.col("__sha") == F.col("sha"))
    return scratch.without(docs, members.join(first, stays, "left_anti"), members.where("n > 1").join(first, stays, "left_semi"), text, id_col)
