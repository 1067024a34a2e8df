"""Byte-pair encoding by forced boundaries.

A pair of bytes that occurs inside no token of the vocabulary can lie in no
token of any encoding, so the text may be cut between the two with certainty.
Pre-token boundaries and these forced boundaries cut a text into fragments;
each is encoded on its own (and kept for the next time), then the ids are
concatenated.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from vecspark.llm._common import arrow_rows, row_wise, worker_cache

# Fixed value: the pre-token pattern of public byte-level vocabularies.
PRE_TOKEN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
SHORT = 40
NEVER = 1 << 60


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder for one byte-level BPE vocabulary (the JSON text of its file)."""

    def __init__(self, spec: str, most_kept: int = 400_000, special: bool = True):
        data = json.loads(spec)
        symbols = byte_symbols()
        vocab = data["model"]["vocab"]
        self.most_kept = most_kept
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])} if special else {}
        in_bytes = {t: bytes(symbols[c] for c in t) for t in vocab if all(c in symbols for c in t)}
        size = max([*vocab.values(), *(t["id"] for t in data.get("added_tokens", []))]) + 1
        self.table = [b""] * size
        for token, raw in in_bytes.items():
            self.table[vocab[token]] = raw
        for t in data.get("added_tokens", []):
            self.table[t["id"]] = t["content"].encode()
        self.of_byte = [vocab[c] for c, _ in sorted(symbols.items(), key=lambda x: x[1])]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(data["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.ranks = {a << 32 | b: rank for (a, b), (rank, _) in self.merges.items()}
        self.first = [self.ranks.get(a << 32 | b, NEVER) for a in self.of_byte for b in self.of_byte]
        self.made = {rank: new for rank, new in self.merges.values()}
        self.inner = {pair for raw in in_bytes.values() for pair in zip(raw, raw[1:])}
        self.pattern = regex.compile(PRE_TOKEN)
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.words: dict[str, bytes] = {}
        self.sizes: dict[str, int] = {}
        self.fragments: dict[bytes, bytes] = {}

    def cuts(self, raw: bytes) -> list[int]:
        """The forced boundaries of ``raw``: no token spans any of them."""
        inner = self.inner
        return [i for i, pair in enumerate(zip(raw, raw[1:]), 1) if pair not in inner]

    def fragment(self, raw: bytes) -> bytes:
        """The ids (little-endian, 32 bits each) of a piece that no cut crosses."""
        got = self.fragments.get(raw)
        if got is None:
            got = self._encode(raw)
            if len(self.fragments) >= self.most_kept:
                self.fragments.clear()
            if len(raw) <= 64:
                self.fragments[raw] = got
        return got

    def _encode(self, raw: bytes) -> bytes:
        ids = self._short(raw) if len(raw) <= SHORT else self._long([self.of_byte[b] for b in raw])
        return np.array(ids, dtype="<u4").tobytes()

    def _short(self, raw: bytes) -> list[int]:
        get, made, first = self.ranks.get, self.made, self.first
        ids = [self.of_byte[b] for b in raw]
        ranks = [first[a << 8 | b] for a, b in zip(raw, raw[1:])]
        while ranks:
            best = min(ranks)
            if best == NEVER:
                break
            i = ranks.index(best)
            ids[i] = new = made[best]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 32 | new, NEVER)
            if i < len(ranks):
                ranks[i] = get(new << 32 | ids[i + 1], NEVER)
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        """The same merges in the same order, from a heap: n log n for pieces of any length."""
        n, merges = len(ids), self.merges
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(merges[p][0], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in merges]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = merges[a, b][1], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (ids[x], ids[y]) in merges:
                    heapq.heappush(heap, (merges[ids[x], ids[y]][0], x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]

    def word(self, piece: str) -> bytes:
        """The ids of one pre-token."""
        got = self._word(piece)
        if len(self.words) >= self.most_kept:
            self.words.clear()
        if len(piece) <= 64:
            self.words[piece] = got
        return got

    def size(self, piece: str) -> int:
        """How many tokens one pre-token has."""
        raw = piece.encode()
        got = len(self._short(raw)) if len(raw) <= SHORT else len(self._word(piece)) // 4
        if len(self.sizes) >= self.most_kept:
            self.sizes.clear()
        if len(piece) <= 64:
            self.sizes[piece] = got
        return got

    def _word(self, piece: str) -> bytes:
        raw = piece.encode()
        if cuts := self.cuts(raw):
            return b"".join(self.fragment(raw[i:j]) for i, j in zip([0, *cuts], [*cuts, len(raw)]))
        return self._encode(raw)

    def _plain(self, text: str) -> bytes:
        kept, out = self.words, []
        for piece in self.pattern.findall(text):
            got = kept.get(piece)
            out.append(self.word(piece) if got is None else got)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        if self.specials is None or not self.specials.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += [self._plain(text[at : m.start()]), np.array([self.special[m[0]]], dtype="<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.table.__getitem__, ids)).decode("utf-8", errors="replace")


def codec_of(spec: str, special: bool = True) -> Codec:
    key = ("codec", hashlib.sha256(spec.encode()).hexdigest(), special)
    return worker_cache(key, lambda: Codec(spec, special=special))


def read_spec(path: str) -> str:
    """The vocabulary file's text, read on the driver; executors get it with the task."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Encode every whole text and decode the ids again.

    Returns one row per row of ``docs``: the id, ``n_tokens``, and ``ids`` with
    ``decoded``; with ``digest=True`` their SHA-256 instead, so that the ids need
    not leave the worker. A null text counts as empty (no tokens); empty and very
    long texts are ordinary; repeated rows give repeated rows; other columns are
    not read. No shuffle: each task needs memory for one Arrow batch.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer_path))
    out = [pa.field(id_col, pa.int64()), pa.field("n_tokens", pa.int64())]
    out += [pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())] if digest else [pa.field("ids", pa.list_(pa.int64())), pa.field("decoded", pa.string())]
    schema = pa.schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(spec.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                counts, first, second = [], [], []
                for text in part.column(1).to_pylist():
                    raw = codec.encode(text or "")
                    ids = np.frombuffer(raw, dtype="<u4")
                    decoded = codec.decode(ids.tolist())
                    counts.append(len(ids))
                    first.append(hashlib.sha256(raw).hexdigest() if digest else ids.astype(np.int64))
                    second.append(hashlib.sha256(decoded.encode()).hexdigest() if digest else decoded)
                yield arrow_rows(schema, [part.column(0), counts, first, second])

    kinds = "ids_sha256 string, decoded_sha256 string" if digest else "ids array<bigint>, decoded string"
    picked = docs.select(docs[id_col].cast("bigint").alias(id_col), docs[text_col].alias(text_col))
    return picked.mapInArrow(run, f"`{id_col}` bigint, n_tokens bigint, {kinds}")


def tokenized(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (of the whole text), ``n_tokens`` and ``decoded``, whether the ids give the text back.

    Null and empty texts have no ids; very long texts are encoded whole; repeated
    rows give repeated rows; columns of clashing names are replaced, all others
    stay. No shuffle.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer_path))

    def make(texts: list, batch: pa.RecordBatch) -> dict:
        codec = codec_of(spec.value)
        ids = [np.frombuffer(codec.encode(t or ""), dtype="<u4").astype(np.int32) for t in texts]
        same = [codec.decode(i.tolist()) == (t or "") for i, t in zip(ids, texts, strict=True)]
        return {"ids": ids, "n_tokens": list(map(len, ids)), "decoded": same}

    return row_wise(docs, text_col, make, {"ids": "array<int>", "n_tokens": "bigint", "decoded": "boolean"})
