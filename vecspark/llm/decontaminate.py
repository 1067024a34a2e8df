"""Benchmark decontamination over a distributed positional inverted index.

``build_index`` turns the training documents into index segments, each a few
megabytes of text: for every word the ascending positions at which it stands,
documents laid end to end. A segment is one row of a table in the shared folder,
stored once whatever the test set. ``search`` takes the test items in blocks of
bounded size to every segment and, for each phrase, starts from the list of its
rarest term there, intersecting the other lists shifted by their offsets. The
postings never move: a segment answers for its own documents.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm._common import arrow_rows, as_bytes, lean, slices, stored

#: A-Z to lower case; every other ASCII character but digits and letters to a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Space between documents in a segment's positions, so that no phrase crosses.
GAP = 1024
#: Bytes of text of which :func:`clean_documents` holds the index at once, in a worker.
CLEANED = 1 << 20


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


def windows_of(words: Sequence[bytes], n: int) -> list[tuple[bytes, ...]]:
    """All runs of ``n`` words; all words at once if there are fewer, but some."""
    if not words:
        return []
    return [tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]


class Phrases:
    """A block of test items: their terms, their distinct windows as term numbers, and whose they are.

    Windows go by their pivot, the term that the fewest windows of the block have:
    a segment looks at the windows of those pivots only that it holds.
    """

    def __init__(self, items: list[tuple[object, bytes | None]], n: int):
        self.terms: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            name = "" if item is None else str(item)
            for w in windows_of(words_of(text), n):
                owners.setdefault(tuple(self.terms.setdefault(x, len(self.terms)) for x in w), set()).add(name)
        windows, lengths = list(owners), np.array([len(w) for w in owners], dtype=np.int64)
        padded = np.full((len(windows), n), -1, dtype=np.int64)
        for i, w in enumerate(windows):
            padded[i, : len(w)] = w
        use = np.bincount(padded[padded >= 0], minlength=len(self.terms))
        rank = np.where(padded >= 0, use[padded], np.iinfo(np.int64).max) if len(windows) else padded
        pivot = padded[np.arange(len(windows)), rank.argmin(axis=1)] if len(windows) else np.empty(0, np.int64)
        order = np.argsort(pivot, kind="stable")
        self.padded, self.lengths = padded[order], lengths[order]
        self.owners = [sorted(owners[windows[i]]) for i in order.tolist()]
        #: Where each term's windows as pivot begin and end.
        self.bounds = np.searchsorted(pivot[order], np.arange(len(self.terms) + 1))

    def possible(self, present: np.ndarray) -> np.ndarray:
        """The windows all of whose terms are ``present`` (a mark a term)."""
        pivots = np.flatnonzero(present)
        size = self.bounds[pivots + 1] - self.bounds[pivots]
        own = np.repeat(self.bounds[pivots] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        for column in range(self.padded.shape[1]):
            term = self.padded[own, column]
            own = own[(term < 0) | present[term]]
        return own


def exact(lists: list[np.ndarray], offsets: list[int]) -> np.ndarray:
    """Starts at which every list has start + its offset; the lists come rarest first."""
    starts = lists[0] - offsets[0]
    for found, k in zip(lists[1:], offsets[1:]):
        if not len(starts):
            break
        at = np.searchsorted(found, starts + k)
        at[at == len(found)] = 0
        starts = starts[found[at] == starts + k]
    return starts


def near(lists: list[np.ndarray], offsets: list[int], slop: int) -> np.ndarray:
    """Starts (by the rarest term) with every other term within ``slop`` words of its own place."""
    starts = lists[0] - offsets[0]
    for found, k in zip(lists[1:], offsets[1:]):
        if not len(starts):
            break
        at = np.searchsorted(found, starts + (k - slop))
        inside = at < len(found)
        at[~inside] = 0
        starts = starts[inside & (found[at] <= starts + (k + slop))]
    return starts


def match_segment(words: list[bytes], ends: np.ndarray, places: np.ndarray, phrases: Phrases, slop: int = 0) -> list[tuple[int, np.ndarray]]:
    """(window, ascending starts) of every window of ``phrases`` that occurs in a segment.

    ``words`` are the segment's terms, ``places`` their lists end to end, which end at ``ends``.
    """
    get = phrases.terms.get
    known = np.fromiter(map(get, words, [-1] * len(words)), dtype=np.int64, count=len(words))
    own = np.full(len(phrases.terms) + 1, -1, dtype=np.int64)
    own[known] = np.arange(len(words))
    own = own[:-1]
    begins = ends - np.diff(ends, prepend=0)
    out = []
    for i in phrases.possible(own >= 0).tolist():
        terms = own[phrases.padded[i, : phrases.lengths[i]]]
        order = np.argsort(ends[terms] - begins[terms], kind="stable").tolist()
        lists = [places[begins[t] : ends[t]] for t in terms[order].tolist()]
        found = near(lists, order, slop) if slop else exact(lists, order)
        if len(found):
            out.append((i, found))
    return out


def postings(texts: list[bytes | None]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """Words of each text; the distinct words; where the list of each ends; the lists of their places."""
    numbers: dict[bytes, int] = {}
    counts, terms = np.zeros(len(texts), dtype=np.int64), []
    for i, text in enumerate(texts):
        words = words_of(text)
        counts[i] = len(words)
        for w in words:
            if w not in numbers:
                numbers[w] = len(numbers)
        terms.append(np.fromiter(map(numbers.__getitem__, words), dtype=np.int32, count=len(words)))
    term = np.concatenate(terms) if terms else np.empty(0, np.int32)
    shift = starts_of(counts) - (np.cumsum(counts) - counts)
    place = np.arange(len(term)) + np.repeat(shift, counts)
    order = np.argsort(term, kind="stable")
    return counts, list(numbers), np.cumsum(np.bincount(term, minlength=len(numbers))), place[order]


def starts_of(counts: np.ndarray) -> np.ndarray:
    """The place of each document's first word in its segment."""
    return np.cumsum(counts + GAP) - counts - GAP


def segments_of(batches: Iterator[pa.RecordBatch], column: str, segment_bytes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch, column, segment_bytes)


INDEX = "segment bigint, ids array<bigint>, n_words array<bigint>, terms array<binary>, ends array<bigint>, places array<int>"


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = 8 << 20) -> DataFrame:
    """The index segments of ``docs``, stored in the shared folder.

    Columns: the segment's number, ids and word counts of its documents, its
    terms, where each list ends, and the lists. Every row of ``docs`` is in one
    segment; a segment has ``segment_bytes`` of text or a single longer one.
    """
    schema = pa.schema([("segment", pa.int64()), ("ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), ("terms", pa.list_(pa.binary())), ("ends", pa.list_(pa.int64())), ("places", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for part in segments_of(batches, "text", segment_bytes):
            counts, terms, ends, places = postings(as_bytes(part.column(1)))
            yield arrow_rows(schema, [[number], [part.column(0).to_pylist()], [counts], [terms], [ends], [places.astype(np.int32)]])
            number += 1

    picked = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].alias("text"))
    return stored(picked.mapInArrow(run, INDEX), "postings")


def hit_words(counts: np.ndarray, terms: list[bytes], ends: np.ndarray, places: np.ndarray, wanted: Phrases, slop: int) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
    """The start of each document; whether a window covers each place; the items of each document."""
    first = starts_of(counts)
    hit = np.zeros(int((counts + GAP).sum()) + GAP + 1, dtype=np.int32)
    items: list[set[str]] = [set() for _ in range(len(counts))]
    for w, starts in match_segment(terms, ends, places, wanted, slop):
        n = int(wanted.lengths[w])
        np.add.at(hit, np.maximum(starts, 0), 1)
        np.add.at(hit, np.minimum(starts + n, len(hit) - 1), -1)
        for d in np.unique(np.searchsorted(first, starts, side="right") - 1).tolist():
            items[max(d, 0)].update(wanted.owners[w])
    return first, np.cumsum(hit) > 0, items


def search(index: DataFrame, phrases: Phrases, slop: int = 0, only_hit: bool = False) -> DataFrame:
    """Per document of the index: ``segment``, ``row`` in it, ``id``, ``n_words``, ``hits`` (positions of hit words, ascending), ``items``.

    With ``slop`` a window also matches where each of its words stands within
    that many words of its place; the hit words are then those of the span from
    the window's start to its end. With ``only_hit`` documents without hits are left out.
    """
    block = index.sparkSession.sparkContext.broadcast(phrases)
    schema = pa.schema([("segment", pa.int64()), ("row", pa.int32()), ("id", pa.int64()), ("n_words", pa.int64()), ("hits", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                counts, ends, places = (np.asarray(batch.column(i)[at].values) for i in (2, 4, 5))
                first, covered, items = hit_words(counts, batch.column(3)[at].values.to_pylist(), ends, places, block.value, slop)
                hits = [np.flatnonzero(covered[f : f + c]) for f, c in zip(first.tolist(), counts.tolist())]
                out = arrow_rows(schema, [np.full(len(counts), batch.column(0)[at].as_py()), np.arange(len(counts)), batch.column(1)[at].values, counts, hits, [sorted(x) for x in items]])
                yield out.filter(pa.array([len(h) > 0 for h in hits], type=pa.bool_())) if only_hit else out

    return index.mapInArrow(run, "segment bigint, row int, id bigint, n_words bigint, hits array<bigint>, items array<string>")


def item_blocks(bench: DataFrame, id_col: str, text_col: str, most_bytes: int) -> Iterator[list[tuple[int, bytes | None]]]:
    """The test items in blocks of about ``most_bytes`` of text."""
    block, held = [], 0
    for row in bench.select(bench[id_col].alias("i"), bench[text_col].alias("t")).toLocalIterator():
        raw = row.t.encode() if row.t is not None else None
        block.append((row.i, raw))
        held += len(raw or b"")
        if held >= most_bytes:
            yield block
            block, held = [], 0
    if block:
        yield block


def contamination(docs: DataFrame, bench: DataFrame | None, n: int = 10, slop: int = 0, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 32 << 20) -> DataFrame:
    """Per row of ``docs``: id, ``n_words``, ``hits`` (hit word positions) and ``items`` (whose windows occur).

    Words are lower-cased ASCII letters, digits and all non-ASCII characters; a
    window is ``n`` consecutive words of an item (all of them if fewer, but not
    none). Null and empty texts have no words and no hits; an empty test set hits
    nothing; items of equal words all count; items without an id count as one
    item, named by the empty string; repeated rows, and rows without an id, each
    give their own row; other columns are not read. The index is built once; the
    test items go to the executors in blocks of ``block_bytes`` of text, and a
    row's hits in the blocks meet by its place in the index.
    """
    index = build_index(docs, id_col, text_col)
    blocks = (Phrases(block, n) for block in (item_blocks(bench, item_col, item_text_col, block_bytes) if bench is not None else ()))
    found, more = search(index, next(blocks, Phrases([], n)), slop), [search(index, p, slop, only_hit=True) for p in blocks]
    if more:
        every = reduce(DataFrame.unionByName, [found, *more])
        united = lambda name: F.array_sort(F.array_distinct(F.flatten(F.collect_list(name)))).alias(name)
        found = every.groupBy("segment", "row").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), united("hits"), united("items"))
    return found.select(F.col("id").alias(id_col), "n_words", "hits", "items")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The columns that ``op2_decontaminate`` returns."""
    n_hit = F.size("hits").cast("bigint")
    return found.select(id_col, F.col("n_words"), n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, bench: DataFrame, n: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", segment_bytes: int = CLEANED, block_bytes: int = 32 << 20) -> DataFrame:
    """The rows of ``docs`` that hold no window of a test item, as they are.

    Each task indexes its own rows, segment by segment, searches the segment and
    passes on the rows without hits, so no row is moved or joined; what a worker
    holds at once is an eighth of a stored segment. Every block of
    test items is one more such pass over the rows. Null and empty texts hold
    nothing and stay; every row, whatever its id, is judged by its own text;
    all columns stay.
    """

    def without(rows: DataFrame, phrases: Phrases) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast(phrases)
        return rows.mapInArrow(lean(lambda batches: clean_rows(batches, shared.value, text_col, segment_bytes)), rows.schema)

    return reduce(without, (Phrases(block, n) for block in item_blocks(bench, item_col, item_text_col, block_bytes)), docs)


def clean_rows(batches: Iterator[pa.RecordBatch], phrases: Phrases, text_col: str, segment_bytes: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` without a window, indexed and searched ``segment_bytes`` of text at once."""
    for part in segments_of(batches, text_col, segment_bytes):
        counts, terms, ends, places = postings(as_bytes(part.column(text_col)))
        _, _, items = hit_words(counts, terms, ends, places, phrases, 0)
        del terms, ends, places
        yield part.filter(pa.array([not x for x in items], type=pa.bool_()))
