"""Removal of passages that an earlier document has, byte for byte.

A byte goes if a run of ``depth`` bytes that covers it also starts in a document
with a smaller id. Equal runs have the same least anchor (a shorter run of bytes
with the smallest hash in it), so three passes suffice:

1. The anchors of each segment of text go, as packed numbers, to the share that
   their hash names; it answers which stand in more than one document.
2. Around those, the stretches of text that the anchor governs go to the same
   share, where the collection's Burrows-Wheeler transform and common prefixes are
   built column by column (:mod:`vecspark.llm.bwt`). Suffixes with ``depth`` common
   symbols are equal runs; each run learns whether a smaller document has it.
3. The answers, a bit a run, go back to the segments, which cut out the bytes.

Segments are kept compressed in a bucketed table, so the text itself is never
shuffled. Shares are bounded by the number of anchors; copies within a segment
count once, so a passage in every document costs a row a segment. An anchor with
very many stretches (boilerplate in ever new surroundings) has them cut into
single runs, dealt over all shares by the runs' own hashes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm._common import arrow_rows, as_bytes, bucketed, slices
from vecspark.llm.bwt import least_owner

DEPTH, ANCHOR = 50, 24
LAST = np.iinfo(np.int64).max
STEP = 1 << 18


def power(e: int) -> np.uint64:
    return np.uint64(pow(0x100000001B3, e, 1 << 64))


def gram_hashes(raw: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every run of ``k`` bytes."""
    h = (raw.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    parts, size, whole, have = h, 1, None, 0
    for bit in range(k.bit_length()):
        if k >> bit & 1:
            whole = parts if whole is None else whole[: len(raw) - have - size + 1] * power(size) + parts[have:]
            have += size
        if k >> bit > 1:
            parts = parts[:-size] * power(size) + parts[size:]
            size *= 2
    whole = (whole ^ (whole >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return whole ^ (whole >> np.uint64(32))


def sliding_least(a: np.ndarray, w: int) -> np.ndarray:
    """The least of every ``w`` neighbours."""
    size, out = 1, a
    while size * 2 <= w:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(a) - w + 1], out[w - size :]) if size < w else out


def stretches(raw: np.ndarray, sizes: np.ndarray, depth: int = DEPTH, k: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first start, number of starts, anchor's start, anchor's hash) of the runs of neighbouring starts that share an anchor.

    ``raw`` holds documents of ``sizes`` bytes end to end; no run crosses one's end.
    """
    n = len(raw) - depth + 1
    if n <= 0:
        return (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64))
    ends = np.cumsum(sizes)
    valid = np.ones(n + depth, dtype=np.int8)
    for back in range(1, depth):
        at = ends - back
        valid[at[(at >= 0) & (at < n)]] = 0
    firsts, counts, anchors, hashes = [], [], [], []
    w = depth - k + 1
    for at in range(0, n, STEP):
        high = min(n, at + STEP)
        h = gram_hashes(raw[at : high + depth - 1], k)
        marked = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
        chosen = (sliding_least(marked, w) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        ok = valid[at:high] > 0
        edge = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (ok[1:] != ok[:-1])]))
        count = np.diff(np.append(edge, len(chosen)))
        edge, count = edge[ok[edge]], count[ok[edge]]
        firsts.append(edge + at)
        counts.append(count)
        anchors.append(chosen[edge] + at)
        hashes.append(h[chosen[edge]])
    return np.concatenate(firsts), np.concatenate(counts), np.concatenate(anchors), np.concatenate(hashes)


def pack(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


SEGMENT = "seg bigint, ids array<bigint>, sizes array<bigint>, packed binary"
SENT = pa.schema([("share", pa.int32()), ("seg", pa.int64()), ("packed", pa.binary())])


def segments(docs: DataFrame, id_col: str, text_col: str, segment_bytes: int) -> DataFrame:
    """``docs`` as compressed segments, in a bucketed table in the shared folder."""
    schema = pa.schema([("seg", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("packed", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", segment_bytes):
                texts = [t or b"" for t in as_bytes(part.column(1))]
                yield arrow_rows(schema, [[number], [part.column(0).to_pylist()], [list(map(len, texts))], [pack(b"".join(texts))]])
                number += 1

    picked = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].alias("text"))
    return bucketed(picked.mapInArrow(run, SEGMENT), "seg", picked)


class Segment:
    """One segment's documents and the stretches of its text."""

    def __init__(self, ids, sizes, packed: bytes, shares: int):
        self.ids = [LAST if x is None else x for x in ids.to_pylist()]
        self.sizes = np.asarray(sizes, dtype=np.int64)
        self.text = unpack(packed)
        self.raw = np.frombuffer(self.text, dtype=np.uint8)
        self.first, self.count, self.anchor, h = stretches(self.raw, self.sizes)
        self.shares = shares
        self.share = ((h >> np.uint64(32)) % np.uint64(shares)).astype(np.int64)
        self.value = h.astype(np.uint32)
        self.key = (self.share.astype(np.uint64) << np.uint64(32)) | self.value
        self.doc = np.searchsorted(np.cumsum(self.sizes), self.first, side="right")
        self.owner = np.array(self.ids, dtype=np.int64)[self.doc] if len(self.doc) else self.doc

    def shared(self, answers: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        """The stretches whose anchor stands in several documents by the answers, and whether it is a hot one."""
        if not answers or not len(self.key):
            return np.empty(0, np.int64), np.empty(0, bool)
        parts = [unpaired(a["packed"]) for a in answers]
        keys = np.concatenate([v.astype(np.uint64) | np.uint64(a["share"] << 32) for a, (v, _) in zip(answers, parts, strict=True)])
        hot = np.concatenate([h for _, h in parts]) > 0
        at, place = among(self.key, keys)
        return np.flatnonzero(at), hot[place[at]]

    def pieces(self, answers: list[dict]) -> Iterator[Pieces]:
        """The stretches to compare, by share, always in the same order.

        A hot anchor's stretches are cut into single runs, which go to the shares
        of their own hashes, so that no share has to hold them all.
        """
        at, hot = self.shared(answers)
        calm, every = at[~hot], at[hot]
        first, count, anchor, share, owner = (x[calm] for x in (self.first, self.count, self.anchor, self.share, self.owner))
        if len(every):
            n = self.count[every]
            start = np.repeat(self.first[every] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            own = np.array([int.from_bytes(hashlib.blake2b(self.text[i : i + DEPTH], digest_size=7).digest()) for i in start.tolist()], dtype=np.int64) % self.shares
            first, count, anchor = np.concatenate([first, start]), np.concatenate([count, np.ones_like(start)]), np.concatenate([anchor, np.repeat(self.anchor[every], n)])
            share, owner = np.concatenate([share, own]), np.concatenate([owner, np.repeat(self.owner[every], n)])
        order = np.argsort(share, kind="stable")
        first, count, anchor, share, owner = (x[order] for x in (first, count, anchor, share, owner))
        bounds = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), len(share)]
        for a, b in zip(bounds, bounds[1:]):
            if a < b:
                yield Pieces(int(share[a]), self.text, first[a:b], count[a:b], anchor[a:b], owner[a:b])


class Pieces:
    """A segment's stretches for one share, with their distinct texts numbered in order."""

    def __init__(self, share: int, text: bytes, first: np.ndarray, count: np.ndarray, anchor: np.ndarray, owner: np.ndarray):
        self.share, self.first, self.count, self.owner = share, first, count, owner
        numbers: dict[bytes, int] = {}
        put = numbers.setdefault
        self.number = np.array([put(text[i:j], len(numbers)) for i, j in zip(first.tolist(), (first + count + DEPTH - 1).tolist())], dtype=np.int64)
        self.texts = list(numbers)
        self.before = np.zeros(len(numbers), dtype=np.uint8)
        self.before[self.number] = anchor - first
        #: The smallest document of each text.
        self.least = np.full(len(numbers), LAST)
        np.minimum.at(self.least, self.number, owner)


def paired(values: np.ndarray, marks: np.ndarray) -> bytes:
    return values.astype("<u4").tobytes() + marks.astype("<u4").tobytes()


def unpaired(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(raw, dtype="<u4")
    return both[: len(both) // 2], both[len(both) // 2 :]


def among(values: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values are in ``keys`` (ascending), and where."""
    if not len(keys):
        return np.zeros(len(values), dtype=bool), np.zeros(len(values), dtype=np.int64)
    at = np.searchsorted(keys, values)
    at[at == len(keys)] = 0
    return keys[at] == values, at


def sieve(table: DataFrame, shares: int, hot: int) -> DataFrame:
    """seg, share, packed: the anchors of each segment that stand in more than one document.

    Those with more than ``hot`` stretches over all segments are marked.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                s = Segment(batch.column(1)[row].values, batch.column(2)[row].values, batch.column(3)[row].as_py(), shares)
                if not len(s.key):
                    continue
                order = np.lexsort((s.owner, s.key))
                key, owner = s.key[order], s.owner[order]
                begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                end = np.append(begin[1:], len(key))
                # One number says both: how many stretches, and (lowest bit) whether of several documents.
                marks = ((end - begin) << 1) | (owner[end - 1] != owner[begin])
                share = (key[begin] >> np.uint64(32)).astype(np.int64)
                value = key[begin].astype("<u4")
                bounds = np.searchsorted(share, np.arange(shares + 1))
                full = np.flatnonzero(np.diff(bounds)).tolist()
                seg = batch.column(0)[row].as_py()
                yield arrow_rows(SENT, [full, [seg] * len(full), [paired(value[bounds[i] : bounds[i + 1]], marks[bounds[i] : bounds[i + 1]]) for i in full]])

    def answer(share: int, rows: list[tuple[int, bytes]]) -> list[tuple[int, int, bytes]]:
        lists = [unpaired(raw) for _, raw in rows]
        value, group = np.unique(np.concatenate([v for v, _ in lists]), return_inverse=True)
        marks = np.concatenate([m for _, m in lists])
        documents = np.bincount(group, 1 + (marks & 1), len(value))
        stretches_of = np.bincount(group, marks >> 1, len(value))
        often = documents > 1
        value, crowd = value[often], (stretches_of[often] > hot).astype(np.uint32)
        out = []
        for (seg, _), (own, _) in zip(rows, lists, strict=True):
            found, at = among(own, value)
            if found.any():
                out.append((share, seg, paired(own[found], crowd[at[found]])))
        return out

    return by_share(table.mapInArrow(send, "share int, seg bigint, packed binary"), answer)


def by_share(sent: DataFrame, answer) -> DataFrame:
    """``answer(share, [(seg, packed)])`` for every share; a task holds one share at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if rows:
                out = answer(now, rows)
                for at in range(0, len(out), 256):
                    yield arrow_rows(SENT, [*zip(*out[at : at + 256], strict=True)])

        for batch in batches:
            for share, seg, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if share != now:
                    yield from done()
                    now, rows = share, []
                rows.append((seg, packed))
        yield from done()

    return sent.repartition("share").sortWithinPartitions("share", "seg").mapInArrow(run, "share int, seg bigint, packed binary")


def ordered(answers) -> list[dict]:
    return sorted(answers.as_py() or [], key=lambda a: a["share"])


def resolve(table: DataFrame, answers: DataFrame, shares: int, batch_strings: int = 4_000) -> DataFrame:
    """share, seg, packed: for each piece of a segment, in order, a bit a run: a smaller document has it."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                s = Segment(batch.column(1)[row].values, batch.column(2)[row].values, batch.column(3)[row].as_py(), shares)
                for p in s.pieces(ordered(batch.column(4)[row])):
                    sizes = np.array([len(t) for t in p.texts], dtype="<u1")
                    raw = np.array([len(p.texts)], dtype="<u4").tobytes() + p.least.astype("<i8").tobytes() + sizes.tobytes() + p.before.tobytes() + b"".join(p.texts)
                    yield arrow_rows(SENT, [[p.share], [batch.column(0)[row].as_py()], [pack(raw)]])

    def answer(share: int, rows: list[tuple[int, bytes]]) -> list[tuple[int, int, bytes]]:
        numbers: dict[tuple[bytes, int], int] = {}
        held, put = [], numbers.setdefault
        for seg, packed in rows:
            raw = unpack(packed)
            n = int(np.frombuffer(raw, "<u4", 1)[0])
            owners = np.frombuffer(raw, "<i8", n, 4)
            sizes, before = np.frombuffer(raw, "<u1", n, 4 + 8 * n), np.frombuffer(raw, "<u1", n, 4 + 9 * n).tolist()
            ends = np.cumsum(sizes, dtype=np.int64) + 4 + 10 * n
            ids = np.array([put((raw[i:j], k), len(numbers)) for i, j, k in zip((ends - sizes).tolist(), ends.tolist(), before)], dtype=np.int64)
            held.append((seg, ids, owners))
        least = np.full(len(numbers), LAST)
        for _, ids, owners in held:
            np.minimum.at(least, ids, owners)
        runs, first, known = earliest(list(numbers), least, batch_strings)
        out = []
        for seg, ids, owners in held:
            n = runs[ids]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            bit = (known[np.repeat(first[ids], n) + step] < np.repeat(owners, n)).astype(np.uint32) << step.astype(np.uint32)
            out.append((share, seg, pack(np.add.reduceat(bit, np.cumsum(n) - n).astype("<u4").tobytes())))
        return out

    joined = table.join(answers, "seg").select("seg", "ids", "sizes", "packed", "answers")
    return by_share(joined.mapInArrow(send, "share int, seg bigint, packed binary"), answer)


def earliest(texts: list[tuple[bytes, int]], owners: np.ndarray, batch_strings: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the runs of ``DEPTH`` bytes in each text, end to end: the smallest document that has it.

    ``texts`` are distinct (stretch, where its anchor starts). Texts of one anchor go
    to one collection, of ``batch_strings`` texts or, if one anchor has more, just its
    own. The anchor, which equal runs share at the same place, counts as one symbol.
    A text whose anchor no other has, and texts that are single runs all, share no
    run with any other: their own documents are the answer.
    Returns the number of runs of each text, where they begin, and the documents.
    """
    by_anchor: dict[bytes, list[int]] = {}
    for i, (text, k) in enumerate(texts):
        by_anchor.setdefault(text[k : k + ANCHOR], []).append(i)
    runs = np.array([len(t) - DEPTH + 1 for t, _ in texts], dtype=np.int64)
    first = np.cumsum(runs) - runs
    known = np.repeat(owners, runs)
    part: list[int] = []
    marks: list[int] = []

    def settle() -> None:
        flat, sizes = collection([texts[i] for i in part], marks)
        found = least_owner(flat, sizes, owners[part], DEPTH - ANCHOR + 1)
        n = runs[part]
        known[np.repeat(first[part], n) + np.arange(len(found)) - np.repeat(np.cumsum(n) - n, n)] = found
        part.clear()
        marks.clear()

    for group in by_anchor.values():
        if len(group) == 1 or runs[group].max() == 1:
            continue
        marks += [257 if not marks else marks[-1] + 1] * len(group)
        part += group
        if len(part) >= batch_strings:
            settle()
    if part:
        settle()
    return runs, first, known


def collection(texts: list[tuple[bytes, int]], marks: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' symbols end to end, each text's anchor as the one symbol of ``marks``, and their sizes."""
    sizes = np.array([len(t) for t, _ in texts], dtype=np.int64)
    flat = np.frombuffer(b"".join(t for t, _ in texts), dtype=np.uint8).astype(np.uint16) + 1
    at = np.cumsum(sizes) - sizes + np.array([k for _, k in texts], dtype=np.int64)
    flat[at] = marks
    keep = np.ones(len(flat), dtype=bool)
    for i in range(1, ANCHOR):
        keep[at + i] = False
    return flat[keep], sizes - ANCHOR + 1


def gathered(answers: DataFrame, name: str) -> DataFrame:
    return answers.groupBy("seg").agg(F.collect_list(F.struct("share", "packed")).alias(name))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = 4 << 20, share_anchors: int = 1 << 19, hot: int = 1 << 16) -> DataFrame:
    """Per row of ``docs``: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (binary).

    A byte is removed if a run of 50 bytes that covers it also starts in a
    document with a smaller id; runs are judged on the input. Null texts count as
    empty; texts under 50 bytes stay whole; rows of equal id do not remove each
    other; a null id counts as larger than any; very long texts are taken whole;
    other columns are not read.
    """
    table = segments(docs, id_col, text_col, segment_bytes)
    total = table.agg(F.sum(F.expr("aggregate(sizes, 0L, (a, x) -> a + x)"))).first()[0] or 0
    shares = max(1, math.ceil(total * 2 / (DEPTH - ANCHOR + 2) / share_anchors))
    first = gathered(sieve(table, shares, hot), "answers")
    second = gathered(resolve(table, first, shares), "masks")
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids = batch.column(1)[row].values
                s = Segment(ids, batch.column(2)[row].values, batch.column(3)[row].as_py(), shares)
                yield arrow_rows(schema, [ids, *cut(s, ordered(batch.column(4)[row]), ordered(batch.column(5)[row]))])

    joined = table.join(first, "seg", "left").join(second, "seg", "left").select("seg", "ids", "sizes", "packed", "answers", "masks")
    return joined.mapInArrow(run, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary").withColumnRenamed("id", id_col)


def cut(s: Segment, answers: list[dict], masks: list[dict]) -> tuple[list, list, list, list]:
    """Sizes, removed bytes, removed runs and kept bytes of a segment's documents."""
    bits = {m["share"]: np.frombuffer(unpack(m["packed"]), dtype="<u4") for m in masks}
    cover = np.zeros(len(s.raw) + 1, dtype=np.int32)
    for p in s.pieces(answers):
        # A text that a smaller document of this segment has is known in whole; else its mask says.
        whole = p.owner > p.least[p.number]
        np.add.at(cover, p.first[whole], 1)
        np.add.at(cover, (p.first + p.count + DEPTH - 1)[whole], -1)
        rest = np.flatnonzero(~whole)
        mask = bits[p.share][p.number[rest]]
        for t in range(int(p.count.max())):
            start = p.first[rest[mask >> np.uint32(t) & np.uint32(1) > 0]] + t
            np.add.at(cover, start, 1)
            np.add.at(cover, start + DEPTH, -1)
    gone = np.cumsum(cover[:-1]) > 0
    ends = np.cumsum(s.sizes)
    removed, spans, kept = [], [], []
    for a, b in zip((ends - s.sizes).tolist(), ends.tolist()):
        own = gone[a:b]
        removed.append(int(own.sum()))
        spans.append(int(own[:1].sum() + (own[1:] & ~own[:-1]).sum()))
        kept.append(s.raw[a:b][~own].tobytes() if removed[-1] else s.text[a:b])
    return s.sizes.tolist(), removed, spans, kept


def digests(cleaned: DataFrame) -> DataFrame:
    """The columns that ``op10_suffix_dedup`` returns."""
    return cleaned.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
