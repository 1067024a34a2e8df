"""Token counts that follow edits.

A document is a segment tree over its pre-tokens: leaves hold up to a hundred-odd
pre-tokens (their text, the characters and the tokens of each), inner nodes the
sums of their children. ``counted`` encodes documents once and gives their leaves
as a table; ``edited`` takes that table with edits and re-encodes only the
pre-tokens an edit touches, from a little before it until the old and new
boundaries fall together again, and then the sums on the way up. Neither the
rest of the text nor the vocabulary is looked at again, and the new leaves are
the table that the next edits take.

A pre-token's end depends on the characters up to two places behind its start or
one behind its end, never on those before its start; so encoding may start at any
old boundary at least three characters before the edit, and stop at the first new
boundary behind the edit that is an old one too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm._common import arrow_rows, stored
from vecspark.llm.bpe import Codec, codec_of, read_spec

LEAF = 128
FAN = 16
#: Characters before an edit that a boundary must leave untouched, and behind a pre-token that it may depend on.
REACH = 3
#: Characters behind an edit that are read at first; twice as many if the boundaries don't meet there.
TAIL = 64


class Node:
    """A leaf (``text``, ``packed``: lengths, then tokens of its pre-tokens) or an inner node (``children``), with sums."""

    __slots__ = ("text", "packed", "children", "chars", "count", "pieces")

    def __init__(self, text: str = "", packed: bytes = b"", chars: int = 0, count: int = 0, pieces: int = 0, children: list[Node] | None = None):
        self.text, self.packed, self.children, self.chars, self.count, self.pieces = text, packed, children, chars, count, pieces
        if children is not None:
            self.sum()

    def sum(self) -> None:
        self.chars = sum(c.chars for c in self.children)
        self.count = sum(c.count for c in self.children)
        self.pieces = sum(c.pieces for c in self.children)

    @property
    def lengths(self) -> list[int]:
        return np.frombuffer(self.packed, "<u4", self.pieces).tolist()

    @property
    def tokens(self) -> list[int]:
        return np.frombuffer(self.packed, "<u4", self.pieces, 4 * self.pieces).tolist()


def leaves(text: str, lengths: list[int], tokens: list[int]) -> list[Node]:
    if not len(lengths):
        return []
    own, counts = np.asarray(lengths, dtype="<u4"), np.asarray(tokens, dtype="<u4")
    first = np.arange(0, len(own), LEAF)
    chars, sums = (np.add.reduceat(c, first, dtype=np.int64).tolist() for c in (own, counts))
    own, counts, out, at = own.tobytes(), counts.tobytes(), [], 0
    for i, n, m in zip(range(0, len(own), 4 * LEAF), chars, sums, strict=True):
        part = own[i : i + 4 * LEAF]
        out.append(Node(text[at : at + n], part + counts[i : i + 4 * LEAF], n, m, len(part) // 4))
        at += n
    return out


def raised(nodes: list[Node]) -> Node:
    """One tree over ``nodes``."""
    while len(nodes) > 1:
        nodes = [Node(children=nodes[i : i + FAN]) for i in range(0, len(nodes), FAN)]
    return nodes[0] if nodes else Node()


class CountedText:
    """A text whose token count is kept through edits."""

    def __init__(self, codec: Codec, nodes: list[Node]):
        self.codec, self.root, self.encoded = codec, raised(nodes), 0

    @classmethod
    def of(cls, text: str, codec: Codec) -> CountedText:
        return cls(codec, encoded_leaves(text, codec))

    @property
    def n_tokens(self) -> int:
        return self.root.count

    @property
    def n_pieces(self) -> int:
        return self.root.pieces

    def leaves(self) -> Iterator[Node]:
        todo = [self.root]
        while todo:
            node = todo.pop()
            if node.children is None:
                if node.pieces:
                    yield node
            else:
                todo += reversed(node.children)

    @property
    def text(self) -> str:
        return "".join(leaf.text for leaf in self.leaves())

    def boundary(self, at: int) -> int:
        """The last boundary at or before character ``at``."""
        node, base = self.root, 0
        while node.children is not None:
            for child in node.children:
                if at < base + child.chars or child is node.children[-1]:
                    node = child
                    break
                base += child.chars
        for n in node.lengths:
            if at < base + n:
                break
            base += n
        return base

    def between(self, start: int, end: int) -> str:
        """The characters [start, end), from the leaves that have them."""
        out, todo = [], [(self.root, 0)]
        while todo:
            node, base = todo.pop()
            if base >= end or base + node.chars <= start:
                continue
            if node.children is None:
                out.append(node.text[max(0, start - base) : end - base])
            else:
                ends = np.cumsum([base, *(c.chars for c in node.children)]).tolist()
                todo += reversed(list(zip(node.children, ends)))
        return "".join(out)

    def edit(self, start: int, end: int, new: str) -> int:
        """Replace characters [start, end) by ``new``; returns how many pre-tokens were encoded."""
        size = self.root.chars
        start = max(0, min(start, size))
        end = max(start, min(end, size))
        first = self.boundary(start - REACH) if start > REACH else 0
        head, shift, tail = self.between(first, start) + new, len(new) - (end - start), TAIL
        while True:
            here = head + self.between(end, end + tail)
            pieces, last = self._until_met(here, first, start + len(new), shift, end + tail >= size)
            if last is not None:
                break
            tail *= 2
        lengths, tokens = [len(p) for p in pieces], [tokens_of(self.codec, p) for p in pieces]
        fresh = self._replace(self.root, 0, first, last - shift, "".join(pieces), lengths, tokens)
        self.root = raised(fresh)
        self.encoded += len(pieces)
        return len(pieces)

    def _until_met(self, here: str, first: int, behind: int, shift: int, whole: bool) -> tuple[list[str], int | None]:
        """The pre-tokens from ``first`` on, and where they meet an old boundary behind the edit; none if ``here`` is too short."""
        pieces, at = [], first
        for m in self.codec.pattern.finditer(here):
            at = first + m.start()
            if at >= behind and self.boundary(at - shift) == at - shift:
                return pieces, at
            if not whole and m.end() + REACH > len(here):
                return pieces, None
            pieces.append(m[0])
            at = first + m.end()
        return pieces, at if whole else None

    def _replace(self, node: Node, base: int, first: int, last: int, text: str, lengths: list[int], tokens: list[int]) -> list[Node]:
        """``node`` without its pre-tokens in [first, last) and with the new ones, which stand where ``first`` falls."""
        if node.children is None:
            own, counts, at, i = node.lengths, node.tokens, base, 0
            while i < len(own) and at < first:
                at += own[i]
                i += 1
            to, j = at, i
            while j < len(own) and to < last:
                to += own[j]
                j += 1
            return leaves(node.text[: at - base] + text + node.text[to - base :], own[:i] + lengths + own[j:], counts[:i] + tokens + counts[j:])
        children: list[Node] = []
        placed = False
        for k, child in enumerate(node.children):
            low, high = base, base + child.chars
            base = high
            here = not placed and (low <= first < high or k == len(node.children) - 1)
            if here:
                children += self._replace(child, low, first, last, text, lengths, tokens)
                placed = True
            elif low < last and high > first:
                children += self._replace(child, low, first, last, "", [], [])
            else:
                children.append(child)
        while len(children) > FAN * 2:
            children = [Node(children=children[i : i + FAN]) for i in range(0, len(children), FAN)]
        if not children:
            return []
        node.children = children
        node.sum()
        return [node]


def tokens_of(codec: Codec, piece: str) -> int:
    got = codec.sizes.get(piece)
    return codec.size(piece) if got is None else got


def encoded_leaves(text: str, codec: Codec) -> list[Node]:
    """The leaves of a whole text."""
    pieces = codec.pattern.findall(text)
    tokens = list(map(codec.sizes.get, pieces))
    if None in tokens:
        tokens = [tokens_of(codec, p) if n is None else n for p, n in zip(pieces, tokens)]
    return leaves(text, np.fromiter(map(len, pieces), "<u4", len(pieces)), tokens)


#: A document's leaves, one behind the other: texts, sums, and what each leaf packs.
TREE = "texts array<string>, packed array<binary>, chars array<int>, counts array<int>, sizes array<int>"
TREE_ARROW = [("texts", pa.list_(pa.string())), ("packed", pa.list_(pa.binary())), ("chars", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32()))]


def columns_of(own: list[Node]) -> tuple[list, list, list, list, list]:
    return [x.text for x in own], [x.packed for x in own], [x.chars for x in own], [x.count for x in own], [x.pieces for x in own]


def from_columns(codec: Codec, *columns: list) -> CountedText:
    return CountedText(codec, [Node(*leaf) for leaf in zip(*columns, strict=True)])


def counted(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The trees of ``docs``, stored in the shared folder: id, ``n_chars``, ``n_tokens`` and the leaves.

    Special tokens' names are ordinary text. Null texts count as empty; texts may
    be very long; repeated rows give repeated rows; other columns are not read. No shuffle.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer_path))
    schema = pa.schema([(id_col, pa.int64()), ("n_chars", pa.int64()), ("n_tokens", pa.int64()), *TREE_ARROW])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(spec.value, special=False)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                own = [encoded_leaves(t or "", codec) for t in part.column(1).to_pylist()]
                sums = [[sum(x.chars for x in c) for c in own], [sum(x.count for x in c) for c in own]]
                yield arrow_rows(schema, [part.column(0), *sums, *zip(*map(columns_of, own), strict=True)])

    picked = docs.select(docs[id_col].cast("bigint").alias(id_col), docs[text_col].alias("text"))
    return stored(picked.mapInArrow(run, f"`{id_col}` bigint, n_chars bigint, n_tokens bigint, {TREE}"), "trees")


def with_edits(trees: DataFrame, edits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``trees`` with ``edits``: those of ``edits`` (id, ``seq``, ``start``, ``end``, ``new``) of the id, by ``seq``.

    Rows of equal id all get the id's edits; a null id gets none. The edits of one
    document meet in a row, as they must follow each other.
    """
    own = edits.groupBy(F.col(id_col).cast("bigint").alias("vs_id")).agg(F.array_sort(F.collect_list(F.struct("seq", "start", "end", "new"))).alias("edits"))
    own = own.withColumn("edits", F.expr("transform(edits, e -> struct(e.start, e.end, e.new))"))
    return trees.drop("edits").join(own.hint("merge"), F.col(id_col) == F.col("vs_id"), "left").drop("vs_id")


def edited(trees: DataFrame, tokenizer_path: str, edits_col: str = "edits", id_col: str = "doc_id") -> DataFrame:
    """Apply each row's edits to its tree, in order.

    ``edits_col`` is an array of structs (start, end, new): code points of the text
    as the edits before it left it, clamped to it; null edits, or null fields of
    one, change nothing. Returns per row the id, ``n_chars``, ``n_tokens``, the new
    leaves, ``n_tokens_before``, ``n_pieces`` and ``n_reencoded`` (pre-tokens encoded
    for the edits, all that is encoded here). No shuffle.
    """
    spec = trees.sparkSession.sparkContext.broadcast(read_spec(tokenizer_path))
    names = ("n_tokens_before", "n_pieces", "n_reencoded")
    schema = pa.schema([(id_col, pa.int64()), ("n_chars", pa.int64()), ("n_tokens", pa.int64()), *TREE_ARROW, *((n, pa.int64()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(spec.value, special=False)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part, rows = batch.slice(at, 1000), []
                for before, edits, *leaf in zip(*(part.column(i).to_pylist() for i in range(1, 8)), strict=True):
                    own = from_columns(codec, *leaf)
                    for e in edits or []:
                        if e and None not in e.values():
                            own.edit(*e.values())
                    rows.append((own.root.chars, own.n_tokens, *columns_of(list(own.leaves())), before, own.n_pieces, own.encoded))
                yield arrow_rows(schema, [part.column(0), *zip(*rows, strict=True)])

    picked = trees.select(F.col(id_col).cast("bigint").alias(id_col), "n_tokens", F.col(edits_col).cast("array<struct<start:bigint,end:bigint,new:string>>").alias("edits"), "texts", "packed", "chars", "counts", "sizes")
    return picked.mapInArrow(run, f"`{id_col}` bigint, n_chars bigint, n_tokens bigint, {TREE}, " + ", ".join(f"{n} bigint" for n in names))


def digests(trees: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The columns that ``op8_token_counts`` returns."""
    return trees.select(id_col, "n_tokens_before", "n_tokens", "n_pieces", "n_reencoded", F.sha2(F.concat_ws("", "texts"), 256).alias("edited_sha256"))


def revision(trees: DataFrame) -> DataFrame:
    """``trees`` with ``edits``: three to each text, at its quarters: a cut, an insertion, a replacement."""
    at = lambda q: F.floor(F.col("n_chars") * q / 4).cast("bigint")
    edit = lambda start, end, new: F.struct(start.alias("start"), end.alias("end"), F.lit(new).alias("new"))
    return trees.withColumn("edits", F.array(edit(at(1), at(1) + 7, ""), edit(at(2), at(2), " it's been edited, 3 times "), edit(at(3), at(3) + 12, "\n\n  They'll see.")))
