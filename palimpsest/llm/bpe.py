"""Byte-level BPE by merge replay over a corpus.

Texts are cut into pieces by the tokenizer's pattern, evaluated over arrays of code points. The distinct pieces of a corpus
(what one task holds at a time) form one array of token positions; an inverted index leads from each rank to the positions of
its pairs. Merges are replayed in rank order over the whole array: each takes the positions from the index, joins
the pairs and files only the pairs with the touched neighbours anew.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import memory

#: Bytes of words that are merged side by side; longer ones are replayed.
SHORT_BYTES = 48
#: Code points that one pass over arrays takes, and that one replay covers: bounds on a task's memory.
PASS_CHARS = 1_000_000
REPLAY_CHARS = 4_000_000
NEVER = np.int32(2**31 - 1)
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
# The code points of the Unicode property White_Space, and the pattern's contractions.
WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CONTRACTIONS_1 = "stmd"
CONTRACTIONS_2 = ("re", "ve", "ll")

_classes: np.ndarray | None = None


def char_classes() -> np.ndarray:
    global _classes
    if _classes is None:
        first = {"L": LETTER, "N": NUMBER}
        _classes = np.array([first.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)], np.uint8)
        _classes[WHITE_SPACE] = SPACE
    return _classes


def piece_starts(points: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Positions at which pieces begin in texts that are laid end to end; ``doc_starts``: where a text that isn't empty begins."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = char_classes()[points]
    begins = np.zeros(n + 1, bool)  # of a text
    begins[doc_starts] = True
    begins[n] = True
    run = begins.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    starts = run[:n].copy()
    # a run of spaces that a text goes on after gives its last one away: to the next piece if it is a plain space
    ends = np.flatnonzero(run[1:]) if n else np.zeros(0, int)  # last position of each run
    before = ends[(kind[ends] == SPACE) & ~begins[ends + 1]]
    starts[before] = True
    starts[before[points[before] == 32] + 1] = False
    # contractions: a run of one apostrophe that no space was joined to
    quote = np.flatnonzero((points == 39) & starts & run[:n] & run[1:])
    quote = quote[(quote + 1 < n)]
    quote = quote[~begins[quote + 1]]
    one = quote[np.isin(points[quote + 1], [ord(c) for c in CONTRACTIONS_1])]
    two = quote[quote + 2 < n]
    two = two[~begins[two + 2]]
    two = two[np.any([(points[two + 1] == ord(a)) & (points[two + 2] == ord(b)) for a, b in CONTRACTIONS_2], axis=0)]
    for at, length in ((one, 2), (two, 3)):
        starts[at + 1] = False
        after = at + length
        inside = after[after < n]
        inside = inside[~begins[inside] & (kind[inside] == LETTER)]
        starts[inside] = True
    return np.flatnonzero(starts)


def distinct_spans(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of a span of equal content for each distinct content, the content's number for each span).

    Found by 64-bit hashes and proved by comparing every code point; spans that a hash throws together wrongly are told apart.
    """
    n = len(points)
    with np.errstate(over="ignore"):
        base = np.uint64(0x9E3779B97F4A7C15)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        power = np.full(n, base, np.uint64)
        power[0] = 1
        np.cumprod(power, out=power)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * power, out=total[1:])
        back = np.full(n, inverse, np.uint64)
        back[0] = 1
        np.cumprod(back, out=back)
        ends = np.r_[starts[1:], n]
        code = (total[ends] - total[starts]) * back[starts]
        code ^= code >> np.uint64(29)
    del power, back, total
    _, first, number = np.unique(code, return_index=True, return_inverse=True)
    sizes = ends - starts
    model = first[number]
    same = sizes == sizes[model]
    owner = np.repeat(np.arange(len(starts), dtype=np.int32), sizes)
    shift = (starts[model] - starts)[owner]
    at = np.arange(n)
    at += shift
    np.minimum(at, n - 1, out=at)
    wrong = owner[points[at] != points]
    same[wrong] = False
    if not same.all():
        odd, known, first = np.flatnonzero(~same), {}, list(first)
        for i in odd:
            content = points[starts[i] : ends[i]].tobytes()
            if content not in known:
                known[content] = len(first)
                first.append(i)
            number[i] = known[content]
        first = np.array(first)
    return first, number


class Ranks:
    """A vocabulary: one ``base64 rank`` a line, in which every byte has a rank."""

    _cached: dict[bytes, Ranks] = {}

    def __init__(self, content: bytes, size: int | None = None) -> None:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line.strip())}
        if size is not None:
            ranks = {k: v for k, v in ranks.items() if v < size}
        self.ranks = ranks
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.bytes_of = {v: k for k, v in ranks.items()}
        top = max(ranks.values()) + 1
        self.size = top
        self.lengths = np.zeros(top, np.int64)
        for k, v in ranks.items():
            self.lengths[v] = len(k)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(top)), np.uint8)
        pairs = {}
        for k, v in ranks.items():
            for i in range(1, len(k)):
                a, b = ranks.get(k[:i]), ranks.get(k[i:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = v
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys = keys[order]
        self.merged = np.fromiter(pairs.values(), np.int32, len(pairs))[order]

    @classmethod
    def cached(cls, content: bytes, size: int | None = None) -> Ranks:
        key = hashlib.sha256(content + str(size).encode()).digest()
        if key not in cls._cached:
            cls._cached[key] = cls(content, size)
        return cls._cached[key]

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(a), NEVER)
        key = a.astype(np.int64) << 20 | b
        at = np.searchsorted(self.keys, key)
        np.minimum(at, len(self.keys) - 1, out=at)
        return np.where(self.keys[at] == key, self.merged[at], NEVER)

    def encode_one(self, word: bytes) -> list[int]:
        """The rule itself: again and again the leftmost pair of least rank is merged."""
        ids = [self.ranks[bytes([c])] for c in word]
        while len(ids) > 1:
            ranks = [self.ranks.get(self.bytes_of[a] + self.bytes_of[b], int(NEVER)) for a, b in zip(ids, ids[1:])]
            low = min(ranks)
            if low == NEVER:
                break
            i = ranks.index(low)
            ids[i : i + 2] = [low]
        return ids

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`replay`, faster for words of few bytes: in each round every word merges its leftmost pair of least rank, and words without a pair leave."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        short, long = np.flatnonzero(lengths <= SHORT_BYTES), np.flatnonzero(lengths > SHORT_BYTES)
        token = self.of_byte[np.frombuffer(b"".join(words if not len(long) else [words[i] for i in short.tolist()]), np.uint8)]
        word = np.repeat(short, lengths[short])
        rank = np.full(len(token), NEVER)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner] = self.pair_ranks(token[inner], token[inner + 1])
        tokens, owners = [], []
        while len(token):
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            size = np.diff(np.r_[start, len(word)])
            least = np.repeat(np.minimum.reduceat(rank, start), size)
            done = least == NEVER
            if done.any():
                tokens.append(token[done])
                owners.append(word[done])
                left = ~done
                token, word, rank, least = token[left], word[left], rank[left], least[left]
                if not len(token):
                    break
            at = np.flatnonzero(rank == least)
            at = at[np.r_[True, word[at[1:]] != word[at[:-1]]]]
            token[at] = rank[at]
            keep = np.ones(len(token), bool)
            keep[at + 1] = False
            token, word, rank = token[keep], word[keep], rank[keep]
            at -= np.arange(len(at))  # one token of each word before it is gone
            touched = np.concatenate([at, at[at > 0] - 1])
            inside = touched + 1 < len(word)
            inside[inside] = word[touched[inside]] == word[touched[inside] + 1]
            rank[at] = NEVER
            touched = touched[inside]
            rank[touched] = self.pair_ranks(token[touched], token[touched + 1])
        if len(long):
            ids, sizes = self.replay([words[i] for i in long.tolist()])
            tokens.append(ids)
            owners.append(np.repeat(long, sizes))
        owner = np.concatenate([np.zeros(0, np.int64), *owners])
        return np.concatenate([np.zeros(0, np.int32), *tokens])[np.argsort(owner, kind="stable")].astype(np.int32), np.bincount(owner, minlength=len(words))

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, end to end, and how many each word has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        token = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        n = len(token)
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        if n:
            last = (np.cumsum(sizes) - 1)[sizes > 0]
            after[last] = -1
            before[(np.cumsum(sizes) - sizes)[sizes > 0]] = -1
        rank = np.full(n, NEVER)
        alive = np.ones(n, bool)
        inner = np.flatnonzero(after >= 0)
        rank[inner] = self.pair_ranks(token[inner], token[inner + 1])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def file(at: np.ndarray, ranks: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cut = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            bounds = [0, *cut.tolist(), len(at)]
            for a, b in zip(bounds, bounds[1:]):
                r = int(ranks[a])
                if r in index:
                    index[r].append(at[a:b])
                else:
                    index[r] = [at[a:b]]
                    heapq.heappush(heap, r)

        some = np.flatnonzero(rank != NEVER)
        if len(some):
            file(some, rank[some])
        odd: list[np.ndarray] = []
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = at[rank[at] == r]
            if not len(at):
                continue
            right = after[at]
            if len(at) > 1 and (right[:-1] == at[1:]).any():  # as in "aaa": every second one
                keep = np.ones(len(at), bool)
                for i in np.flatnonzero(right[:-1] == at[1:]) + 1:
                    keep[i] = not keep[i - 1]
                at, right = at[keep], right[keep]
            beyond = after[right]
            next_too = beyond[:-1] == at[1:]
            if next_too.any():  # one after the other, the first would meet the second's left part
                met = token[beyond[:-1][next_too]]
                early = self.pair_ranks(np.full(len(met), r), met) <= r
                if early.any():
                    odd.append(word[at[:-1][next_too][early]])
            token[at] = r
            alive[right] = False
            rank[right] = NEVER
            after[at] = beyond
            has = beyond >= 0
            before[beyond[has]] = at[has]
            rank[at] = NEVER
            left = before[at]
            left = left[left >= 0]
            touched = np.concatenate([at[has], left])
            if len(touched):
                fresh = self.pair_ranks(token[touched], token[after[touched]])
                rank[touched] = fresh
                some = fresh != NEVER
                if some.any():
                    touched, fresh = touched[some], fresh[some]
                    early = fresh <= r
                    if early.any():  # the word's own order of merges may differ from the corpus's
                        odd.append(word[touched[early]])
                    file(touched, fresh)
        counts = np.bincount(word[alive], minlength=len(words)) if n else np.zeros(len(words), np.int64)
        ids = token[alive]
        if odd:
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for w in np.unique(np.concatenate(odd)):
                parts[w] = np.array(self.encode_one(words[w]), np.int32)
                counts[w] = len(parts[w])
            ids = np.concatenate(parts)
        return ids.astype(np.int32), counts


def gather(flat: np.ndarray, offsets: np.ndarray, sizes: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The chosen slices of ``flat``, end to end."""
    n = sizes[chosen]
    at = np.repeat(offsets[chosen] - (np.cumsum(n) - n), n)
    at += np.arange(len(at))
    return flat[at]


def encode_texts(texts: Iterator[str], ranks: Ranks) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids end to end, number of ids of each text) for runs of texts, in order. Whole texts, however long."""
    held: list[tuple[np.ndarray, np.ndarray]] = []  # of each pass: word numbers, words of each text
    known: dict[str, int] = {}
    group: list[str] = []
    chars = total = 0

    def close() -> None:
        nonlocal group, chars
        sizes = np.fromiter(map(len, group), np.int64, len(group))
        points = np.frombuffer("".join(group).encode("utf-32-le"), np.uint32)
        begin = np.cumsum(sizes) - sizes
        starts = piece_starts(points, begin[sizes > 0])
        per_text = np.diff(np.r_[np.searchsorted(starts, begin), len(starts)])
        if len(starts):
            first, number = distinct_spans(points, starts)
            ends, joined = np.r_[starts[1:], len(points)], "".join(group)
            names = [known.setdefault(joined[a:b], len(known)) for a, b in zip(starts[first].tolist(), ends[first].tolist())]
            number = np.array(names, np.int32)[number]
        else:
            number = np.zeros(0, np.int32)
        held.append((number, per_text))
        group, chars = [], 0

    def flush() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        flat, sizes = ranks.replay([w.encode() for w in known])
        offsets = np.cumsum(sizes) - sizes
        for number, per_text in held:
            upto = np.r_[0, np.cumsum(sizes[number])]
            edge = np.r_[0, np.cumsum(per_text)]
            yield gather(flat, offsets, sizes, number), np.diff(upto[edge])
        held.clear()
        known.clear()

    for text in texts:
        group.append(text)
        chars, total = chars + len(text), total + len(text)
        if chars >= PASS_CHARS:
            close()
        if total >= REPLAY_CHARS:
            if group:
                close()
            yield from flush()
            total = 0
    if group:
        close()
    if held:
        yield from flush()


def _mapped(docs: DataFrame, vocabulary: str, text: str, id_col: str, fields: str, make) -> DataFrame:
    with open(vocabulary, "rb") as f:
        content = f.read()
    shipped = docs.sparkSession.sparkContext.broadcast(content)  # of a fixed size, the vocabulary's

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, ids = Ranks.cached(shipped.value), []

        def texts() -> Iterator[str]:
            for batch in batches:
                ids.append(batch.column(0))
                for x in batch.column(1):
                    yield x.as_py()

        for flat, counts in encode_texts(texts(), ranks):
            own = pa.concat_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in ids])
            ids[:] = [own.slice(len(counts))]
            yield make(ranks, own.slice(0, len(counts)), flat, counts)
        memory.give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return source.mapInArrow(run, f"doc_id {kind}, {fields}")


def encode(docs: DataFrame, vocabulary: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id and ids (array of int), one row per document. A null text counts as empty and has no ids.

    Special tokens are ordinary text. Repeated rows are encoded alike, other columns play no part, an empty table gives an empty
    table.
    """

    def make(ranks: Ranks, doc_id: pa.Array, flat: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(flat, pa.int32()))
        return pa.RecordBatch.from_arrays([doc_id, lists], names=["doc_id", "ids"])

    return _mapped(docs, vocabulary, text, id_col, "ids array<int>", make)


def decode_bytes(ranks: Ranks, ids: np.ndarray) -> np.ndarray:
    return gather(ranks.flat, ranks.offsets, ranks.lengths, ids)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and bytes, the inverse of :func:`encode`. Null ids count as none."""
    with open(vocabulary, "rb") as f:
        shipped = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = Ranks.cached(shipped.value)
        for batch in batches:
            out = [decode_bytes(ranks, np.array(x.as_py() or [], np.int64)).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "bytes"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, bytes binary")


def digests(docs: DataFrame, vocabulary: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids (little-endian, 32 bits each) and of the bytes they decode to."""

    def make(ranks: Ranks, doc_id: pa.Array, flat: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        raw = memoryview(flat.astype("<u4")).cast("B")
        plain = memoryview(decode_bytes(ranks, flat))
        byte_ends = np.r_[0, np.cumsum(ranks.lengths[flat])]
        edge = np.r_[0, np.cumsum(counts)]
        at = byte_ends[edge].tolist()
        edge = edge.tolist()
        of_ids = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(edge, edge[1:])]
        of_bytes = [hashlib.sha256(plain[a:b]).hexdigest() for a, b in zip(at, at[1:])]
        return pa.RecordBatch.from_arrays([doc_id, pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_bytes)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _mapped(docs, vocabulary, text, id_col, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", make)
