"""SimHash near-dedup with pigeonring filtering.

Two 64-bit fingerprints that differ in at most ``limit`` bits, cut into ``parts``
segments on a ring, have a start from which every chain of l consecutive segments
holds at most l * limit / parts differences. The longest chains with a budget
below one difference must be equal, so they are the index keys; longer chains are
checked against their budgets before the full Hamming distance.

Fingerprints are made distinct first. A key's bucket of up to ``pairwise``
fingerprints is compared pair by pair; a larger one is linked through variants:
two fingerprints within two bits share a fingerprint that is within one bit of
both, so a bucket of n costs 65 n words, not n * n. Buckets beyond ``in_task``
fingerprints do the same as a distributed group-by, whose groups never exceed 65.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from vecspark.llm._common import MADE, arrow_rows, as_bytes, bundled, forget, lean, stored, unbundled
from vecspark.llm.components import components, named_components, salted_join

LIMIT = 2
PARTS = 5


def shingles(text: bytes | None, n: int = 3) -> list[bytes]:
    """The n-word shingles, repeats included; all words at once if there are fewer; none for none."""
    words = (text or b"").lower().split()
    if len(words) < n:
        return [b" ".join(words)] if words else []
    return [b" ".join(x) for x in zip(*(words[i:] for i in range(n)))]


def fingerprint(text: bytes | None, n: int = 3, seed: int = 42) -> int:
    """Bit i is set if it is in over half the shingles' XXH64; without shingles 0."""
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, seed) for s in shingles(text, n)], dtype="<u8")
    if not len(h):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 8192):
        part = h[at : at + 8192]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, seed: int = 42) -> DataFrame:
    """``id`` and ``fp`` (the 64 bits as a signed number) for every row of ``docs``."""
    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, n, seed) for t in as_bytes(batch.column(1))], dtype=np.uint64)
            yield arrow_rows(schema, [batch.column(0), found.view(np.int64)])

    return docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].alias("text")).mapInArrow(run, "id bigint, fp bigint")


def segments(parts: int = PARTS) -> list[tuple[int, int]]:
    """(first bit from the top, width) of each segment."""
    bounds = [64 * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(bounds, bounds[1:])]


def exact_chain(limit: int = LIMIT, parts: int = PARTS) -> int:
    """The length of the longest chain whose budget is below one difference."""
    return max(n for n in range(1, parts + 1) if n * limit // parts == 0)


def keys(fp: str, limit: int = LIMIT, parts: int = PARTS):
    """A column: for each start on the ring the start with the chain that must be equal, as one number."""
    ring, out = segments(parts), []
    for i, (first, _) in enumerate(ring):
        width = sum(ring[(i + j) % parts][1] for j in range(exact_chain(limit, parts)))
        turned = F.shiftleft(fp, first).bitwiseOR(F.shiftrightunsigned(fp, 64 - first)) if first else F.col(fp)
        out.append(F.shiftrightunsigned(turned, 64 - width).bitwiseOR(F.lit(i << 40)))
    return F.array(*out)


def chain_masks(start: int, parts: int = PARTS) -> list[int]:
    """The bits of the chains of 1 to ``parts`` segments from ``start``."""
    out, mask = [], 0
    for j in range(parts):
        first, width = segments(parts)[(start + j) % parts]
        mask |= ((1 << width) - 1) << (64 - first - width)
        out.append(mask)
    return out


def close_pairs(fps: np.ndarray, start: int, limit: int = LIMIT, parts: int = PARTS) -> list[tuple[int, int]]:
    """Index pairs within ``limit`` bits whose every chain from ``start`` keeps its budget."""
    i, j = np.triu_indices(len(fps), 1)
    apart = fps[i] ^ fps[j]
    for n, mask in enumerate(chain_masks(start, parts), 1):
        held = np.bitwise_count(apart & np.uint64(mask)) <= n * limit // parts
        i, j, apart = i[held], j[held], apart[held]
    return list(zip(i.tolist(), j.tolist(), strict=True))


def by_variants(fps: np.ndarray) -> list[tuple[int, int]]:
    """Index pairs that connect all fingerprints within two bits of each other."""
    masks = np.concatenate([[0], 1 << np.arange(64, dtype=np.uint64)]).astype(np.uint64)
    variants = (fps[:, None] ^ masks[None, :]).ravel()
    order = np.argsort(variants, kind="stable")
    same = np.flatnonzero(variants[order[1:]] == variants[order[:-1]])
    return list(zip((order[same] // 65).tolist(), (order[same + 1] // 65).tolist(), strict=True))


def links(distinct: DataFrame, limit: int = LIMIT, parts: int = PARTS, pairwise: int = 64, in_task: int = 1 << 16) -> DataFrame:
    """``u``, ``v``: edges that connect all of ``distinct.fp`` within two bits; one edge per link in small buckets."""
    keyed = distinct.select("fp", F.explode(keys("fp", limit, parts)).alias("k"))
    shared = keyed.groupBy("k").agg(F.count("*").alias("n")).where("n > 1")
    members = keyed.join(shared, "k")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = [], []
            for k, group in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.sort(np.asarray(group.values).astype(np.int64)).view(np.uint64)
                pairs = close_pairs(own, k >> 40, limit, parts) if len(own) <= pairwise else by_variants(own)
                signed = own.view(np.int64)
                u += [int(signed[i]) for i, _ in pairs]
                v += [int(signed[j]) for _, j in pairs]
            yield arrow_rows(schema, [u, v])

    grouped = members.where(F.col("n") <= in_task).groupBy("k").agg(F.collect_list("fp").alias("fps"))
    edges = grouped.mapInArrow(run, "u bigint, v bigint")
    variants = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)))
    hot = members.where(F.col("n") > in_task).select("fp").distinct().select("fp", F.explode(variants).alias("x"))
    stars = hot.groupBy("x").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return edges.unionByName(stars.select(F.array_min("fps").alias("u"), F.explode("fps").alias("v")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, seed: int = 42, in_task: int = 1 << 16) -> DataFrame:
    """Per row of ``docs``: id, ``fp``, ``component_id`` (smallest id reachable over links of two bits or fewer).

    Words are runs of non-white ASCII; A-Z count as a-z. Null, empty and blank
    texts have fingerprint zero and link like any other; very long texts are
    taken whole; repeated rows give repeated rows; a null id is in no component's
    name unless all its ids are null; other columns are not read.
    """
    own = stored(fingerprints(docs, id_col, text_col, n, seed), "fingerprints")
    distinct = stored(own.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    rooted = components(links(distinct, in_task=in_task))
    named = named_components(distinct.withColumn("node", F.col("fp")), rooted).withColumnRenamed("node", "fp")
    return salted_join(own, named, "fp", "id").select(F.col("id").alias(id_col), "fp", "component_id")


def fingerprint_text(fp: str = "fp"):
    """The fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


#: Words of 64 bits in a wide fingerprint; bits in each of its segments, and from one segment's start to the next one's.
WIDE, SEGMENT_BITS, STRIDE = 32, 24, 12
#: Standard errors of the Hamming distance within which the shingles themselves decide.
DOUBT = 2.5
#: Rows before it that a row is linked to before the pairs of groups meet.
LINKS = 4


def majority(rows: np.ndarray) -> np.ndarray:
    """Bitwise majority of rows of 64-bit words, by adding bit-sliced counters pairwise."""
    k, planes = len(rows), [rows]
    while len(planes[0]) > 1:
        if len(planes[0]) % 2:
            planes = [np.concatenate([p, np.zeros((1, p.shape[1]), dtype=np.uint64)]) for p in planes]
        carry, added = np.zeros_like(planes[0][::2]), []
        for p in planes:
            a, b = p[::2], p[1::2]
            odd = a ^ b
            added.append(odd ^ carry)
            carry = (a & b) | (carry & odd)
        planes = [*added, carry]
    counts = sum(np.unpackbits(p.astype("<u8").view(np.uint8), bitorder="little").astype(np.int64) << i for i, p in enumerate(planes))
    return np.packbits(counts * 2 > k, bitorder="little").view("<u8")


def wide_fingerprint(text: bytes | None, n: int = 5, words: int = WIDE, seed: int = 42) -> np.ndarray:
    """SimHash of ``64 * words`` bits over the distinct n-word shingles; zero without words."""
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, seed) for s in set(shingles(text, n))], dtype=np.uint64)
    if not len(h):
        return np.zeros(words, dtype="<u8")
    mixed = h[:, None] + (np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed ^= mixed >> np.uint64(shift)
        mixed *= np.uint64(factor)
    return majority(mixed ^ (mixed >> np.uint64(31)))


def most_apart(similarity: float, bits: int, errors: float = 0.0) -> int:
    """The expected bits that differ between equally large sets of that Jaccard similarity, and so many standard errors more."""
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(np.floor(share * bits + errors * np.sqrt(bits * share * (1 - share))))


def wide_fingerprints(segments: DataFrame, text_col: str, n: int) -> DataFrame:
    """``seg``, ``at`` (the row's place in its segment), ``id``, ``wide`` (the fingerprint's bytes) of every row."""
    schema = pa.schema([("seg", pa.int64()), ("at", pa.int32()), ("id", pa.int64()), ("wide", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                texts = as_bytes(unbundled(batch.column(2)[row])[text_col])
                wide = [wide_fingerprint(t, n).tobytes() for t in texts]
                yield arrow_rows(schema, [np.full(len(texts), batch.column(0)[row].as_py()), np.arange(len(texts)), batch.column(1)[row].values, wide])

    return segments.select("seg", "ids", "packed").mapInArrow(lean(run), "seg bigint, at int, id bigint, wide binary")


def window(raw: np.ndarray, bit: int) -> np.ndarray:
    """The 64 bits from ``bit`` on of each row of bytes; the row's first bytes stand behind it again."""
    first, turn = bit >> 3, np.uint64(bit & 7)
    own = np.ascontiguousarray(raw[:, first : first + 8]).view(">u8").ravel().astype(np.uint64)
    return (own << turn) | (raw[:, first + 8].astype(np.uint64) >> (np.uint64(8) - turn)) if turn else own


def segment_rows(nodes: DataFrame) -> DataFrame:
    """``k`` (segment and its bits), ``rest`` (the bits that follow on the ring), ``node``: a row a segment.

    Segments overlap: of the pairs at the limit 94 in 100 agree in one of them.
    """
    schema = pa.schema([("k", pa.int64()), ("rest", pa.int64()), ("node", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                raw = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype=np.uint8).reshape(part.num_rows, -1)
                ring = np.concatenate([raw, raw[:, :9]], axis=1)
                for i in range(raw.shape[1] * 8 // STRIDE):
                    own = window(ring, i * STRIDE)
                    key = (own >> np.uint64(64 - SEGMENT_BITS)).astype(np.int64) | (i << 32)
                    rest = (own & np.uint64((1 << (64 - SEGMENT_BITS)) - 1)).astype(np.int64)
                    yield arrow_rows(schema, [key, rest, part.column(0)])

    return nodes.select("node", "wide").mapInArrow(run, "k bigint, rest bigint, node bigint")


def shared_segments(rows: DataFrame, limit: int) -> DataFrame:
    """Of :func:`segment_rows` those whose ``k`` may stand in several, with ``prev``: the node before it there.

    Rows go by the order of the bits behind the segment; ``prev`` is null unless
    the chain of the segment and those bits keeps its share of ``limit``. The first
    and the last row of a partition stay, as their group may go on in another.
    """
    schema = pa.schema([("k", pa.int64()), ("rest", pa.int64()), ("node", pa.int64()), ("prev", pa.int64())])
    budget = chain_budget(limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, dtype=np.int64)
        held, met = (none, none, none), np.zeros(0, dtype=bool)  # the last row, and whether it shares its group or is the first
        held_prev, held_near = none, met
        for batch in batches:
            if not batch.num_rows:
                continue
            key, rest, node = (np.concatenate([old, column.to_numpy()]) for old, column in zip(held, batch.columns))
            same = key[1:] == key[:-1]
            near = np.concatenate([held_near if len(held_near) else [False], same & (np.bitwise_count(rest[1:] ^ rest[:-1]) <= budget)])
            prev = np.concatenate([held_prev if len(held_prev) else [0], node[:-1]])
            shared = np.concatenate([met if len(met) else [True], same])
            shared[:-1] |= same
            out = np.flatnonzero(shared[:-1])
            yield arrow_rows(schema, [key[out], rest[out], node[out], pa.array(prev[out], mask=~near[out])])
            held, met, held_prev, held_near = (key[-1:], rest[-1:], node[-1:]), shared[-1:], prev[-1:], near[-1:]
        if len(held[0]):
            yield arrow_rows(schema, [*held, pa.array(held_prev, mask=~held_near)])

    ordered = rows.repartitionByRange("k", "rest").sortWithinPartitions("k", "rest", "node")
    return ordered.mapInArrow(run, "k bigint, rest bigint, node bigint, prev bigint")


def likely_links(members: DataFrame, most: int = LINKS) -> DataFrame:
    """``u``, ``v``: each node with up to ``most`` of those before it (``prev``), which stand there in the most segments.

    A bounded number a node, whatever its groups. It only spares comparisons:
    :func:`crossing_pairs` looks at all pairs that these links leave apart.
    """
    often = members.where("prev is not null").groupBy("node", "prev").agg(F.count("*").alias("n"))
    order = F.struct((-F.col("n")).alias("n"), F.xxhash64("node", "prev").alias("h"), "prev")
    best = often.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(order)), 1, most).alias("best"))
    pairs = best.select("node", F.explode("best.prev").alias("prev"))
    return pairs.select(F.greatest("node", "prev").alias("u"), F.least("node", "prev").alias("v")).distinct()


def chain_budget(limit: int) -> int:
    """Differences that the first 64 bits of a chain may hold."""
    return 64 * limit // (64 * WIDE)


def crossing_pairs(members: DataFrame, rooted: DataFrame, nodes: DataFrame, limit: int, block: int = 512) -> DataFrame:
    """``u``, ``v``, ``apart``: all pairs of a segment's group within ``limit`` bits that aren't in one component of ``rooted``.

    A group of one component is passed over. Others are dealt over blocks of about
    ``block`` rows, and each block meets each: a task holds two blocks at most,
    whatever the group. The chain's share of the limit is looked at first, then
    the whole fingerprints, which come with the rows: only near pairs leave the task.
    """
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("apart", pa.int32())])
    budget = chain_budget(limit)

    def columns(batch: pa.RecordBatch) -> list[np.ndarray]:
        wide = np.frombuffer(b"".join(batch.column(6).to_pylist()), dtype="<u8").reshape(batch.num_rows, -1)
        return [*(batch.column(i).to_numpy() for i in range(6)), wide]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in itertools.chain(batches, [None]):
            if batch is None:
                if held is None:
                    return
                now, end = held, len(held[0])
            else:
                now = columns(batch) if held is None else [np.concatenate(x) for x in zip(held, columns(batch))]
                if not len(now[0]):
                    continue
                last = (now[0] == now[0][-1]) & (now[1] == now[1][-1]) & (now[2] == now[2][-1])
                end = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
            k, i, j, rest, node, part, wide = now
            at, step = np.arange(end), 0
            while len(at):
                step += 1
                at = at[at + step < end]
                to = at + step
                together = (k[at] == k[to]) & (i[at] == i[to]) & (j[at] == j[to])
                at, to = at[together], to[together]
                near = (part[at] != part[to]) & (np.bitwise_count(rest[at] ^ rest[to]) <= budget)
                a, b = at[near], to[near]
                apart = np.bitwise_count(wide[a] ^ wide[b]).sum(axis=1, dtype=np.int64)
                close = apart <= limit
                if close.any():
                    u, v = node[a[close]], node[b[close]]
                    yield arrow_rows(schema, [np.maximum(u, v), np.minimum(u, v), apart[close]])
            held = [x[end:] for x in now]

    named = members.join(rooted.hint("merge"), "node", "left").select("k", "rest", "node", F.coalesce("root", "node").alias("part"))
    named = stored(named, "members")
    parted = named.groupBy("k").agg(F.count("*").alias("n"), F.min("part").alias("low"), F.max("part").alias("high")).where("low < high")
    blocks = parted.select("k", F.ceil(F.col("n") / block).cast("bigint").alias("blocks"))
    dealt = named.join(blocks.hint("merge"), "k").join(nodes.select("node", "wide").hint("merge"), "node").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    tiles = dealt.select("k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rest", "node", "part", "wide")
    ordered = tiles.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j", "node")
    return ordered.mapInArrow(run, "u bigint, v bigint, apart int").distinct()


def close_nodes(pairs: DataFrame, nodes: DataFrame, limit: int) -> DataFrame:
    """The ``pairs`` whose wide fingerprints differ in at most ``limit`` bits, and in how many: ``u``, ``v``, ``apart``."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("apart", pa.int32())])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                a, b = (np.frombuffer(b"".join(part.column(i).to_pylist()), dtype="<u8").reshape(part.num_rows, -1) for i in (2, 3))
                apart = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
                close = apart <= limit
                yield arrow_rows(schema, [part.column(0).to_numpy()[close], part.column(1).to_numpy()[close], apart[close]])

    side = lambda name, as_: nodes.select(F.col("node").alias(name), F.col("wide").alias(as_)).hint("merge")
    return pairs.join(side("u", "a"), "u").join(side("v", "b"), "v").select("u", "v", "a", "b").mapInArrow(near, "u bigint, v bigint, apart int")


def alike(pairs: DataFrame, nodes: DataFrame, segments: DataFrame, similarity: float, n: int, text_col: str) -> DataFrame:
    """The ``pairs`` (``u``, ``v``) whose sets of n-word shingles have at least that Jaccard similarity."""
    wanted = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    places = nodes.select("node", "top.seg", "top.at").join(wanted.hint("merge"), "node")
    asked = places.groupBy("seg").agg(F.collect_list("at").alias("ats"), F.collect_list("node").alias("nodes"))
    schema, out = pa.schema([("node", pa.int64()), ("set", pa.binary())]), pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                texts = unbundled(batch.column(0)[row])[text_col].take(batch.column(1)[row].values)
                sets = [np.unique(np.array([xxhash.xxh64_intdigest(x) for x in shingles(t, n)], dtype="<u8")).tobytes() for t in as_bytes(texts)]
                yield arrow_rows(schema, [batch.column(2)[row].values, sets])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                both = len(np.intersect1d(np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8"), assume_unique=True))
                held.append(both >= similarity * ((len(a) + len(b)) // 8 - both))
            yield arrow_rows(out, [batch.column(0), batch.column(1)]).filter(pa.array(held, type=pa.bool_()))

    sets = stored(segments.join(asked, "seg").select("packed", "ats", "nodes").mapInArrow(read, "node bigint, set binary"), "shingles")
    side = lambda name, as_: sets.select(F.col("node").alias(name), F.col("set").alias(as_)).hint("merge")
    return pairs.select("u", "v").join(side("u", "a"), "u").join(side("v", "b"), "v").select("u", "v", "a", "b").mapInArrow(compare, "u bigint, v bigint")


def near_nodes(nodes: DataFrame, similarity: float, decide, block: int = 512) -> DataFrame:
    """Edges ``u``, ``v`` that connect those of ``nodes`` (``node``, ``wide``) that share a segment and are alike.

    First each is linked to a few of those that it follows in the segments' groups,
    not to k * k; then, with the components of these, all other pairs of the
    group that could still join two of them are compared. Fingerprints that are
    clearly near are linked; of pairs in doubt ``decide`` gives those that are alike.
    """
    sure, limit = (most_apart(similarity, 64 * WIDE, x) for x in (-DOUBT, DOUBT))

    def linked(near: DataFrame, known: DataFrame | None) -> DataFrame:
        near = stored(near, "near")
        doubt = near.where(F.col("apart") > sure).select("u", "v")
        return near.where(F.col("apart") <= sure).select("u", "v").unionByName(decide(doubt if known is None else stored(unjoined(doubt, known), "doubt")))

    members = stored(shared_segments(segment_rows(nodes), limit), "segments")
    rooted = components(linked(close_nodes(likely_links(members), nodes, limit), None))
    return edges_of(rooted).unionByName(linked(crossing_pairs(members, rooted, nodes, limit, block), rooted))


def wide_components(nodes: DataFrame, segments: DataFrame, similarity: float, n: int, text_col: str) -> DataFrame:
    """What :func:`components` gives for all ``nodes`` that share a segment and are alike; in doubt the shingles decide."""
    first = len(MADE)
    rooted = components(near_nodes(nodes, similarity, lambda doubt: alike(doubt, nodes, segments, similarity, n, text_col)))
    forget(nodes.sparkSession, first, len(MADE) - 1)
    return rooted


def edges_of(rooted: DataFrame) -> DataFrame:
    return rooted.select(F.col("node").alias("u"), F.col("root").alias("v"))


def unjoined(pairs: DataFrame, rooted: DataFrame) -> DataFrame:
    """The ``pairs`` that are not in one component of ``rooted``."""
    root = lambda name: rooted.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root")).hint("merge")
    met = pairs.join(root("u"), "u", "left").join(root("v"), "v", "left")
    return met.where(F.coalesce("u_root", "u") != F.coalesce("v_root", "v")).select("u", "v")


#: Stands for a null id: larger than any.
NO_ID = (1 << 63) - 1


def groups_of(docs: DataFrame, similarity: float, n: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The segments of ``docs``, their rows' fingerprints, the distinct ones (``top``: the least row of each), their components."""
    segments = bundled(docs, id_col, text_col)
    own = stored(wide_fingerprints(segments, text_col, n), "wide")
    least = F.min(F.struct(F.coalesce("id", F.lit(NO_ID)).alias("first"), "seg", "at")).alias("top")
    nodes = stored(own.groupBy("wide").agg(least).withColumn("node", F.xxhash64("wide")), "nodes")
    return segments, own, nodes, wide_components(nodes, segments, similarity, n, text_col)


def similar_documents(docs: DataFrame, similarity: float = 0.8, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``id``, ``component_id`` (smallest id reachable), for texts of at least ``similarity``.

    Similarity is that of the sets of n-word shingles. It is measured by the
    Hamming distance of wide fingerprints (2048 bits: a standard error of 16), and
    by the sets themselves within 2.5 standard errors of the limit. Candidates
    agree in one of 170 segments and keep the budget of the chain behind it. Rules
    for nulls, empty texts and repeated rows are those of :func:`near_duplicates`.
    """
    _, own, nodes, rooted = groups_of(docs, similarity, n, id_col, text_col)
    named = named_components(nodes.select("node", F.col("top.first").alias("first")), rooted)
    met = salted_join(own.select("id", F.xxhash64("wide").alias("node")), named, "node", "id")
    return met.select("id", F.nullif("component_id", F.lit(NO_ID)).alias("component_id"))


def one_of_each(docs: DataFrame, similarity: float = 0.8, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` of which each group of similar texts keeps one row, that of the smallest id.

    All columns stay as they are, of any names. Of rows of the same id in a group
    one stays, unlike ones each stay in their own groups; a null id is larger than
    any. Texts without words are alike. Rows stay in their segments: only the places
    of those kept come to them.
    """
    segments, _, nodes, rooted = groups_of(docs, similarity, n, id_col, text_col)
    tops = rooted.select(F.col("root").alias("node")).distinct().withColumn("root", F.col("node"))
    met = nodes.select("node", "top").join(rooted.select("node", "root").unionByName(tops).hint("merge"), "node", "left")
    kept = met.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("top").alias("top"))
    places = kept.groupBy("top.seg").agg(F.collect_list("top.at").alias("ats"))
    schema = to_arrow_schema(docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                rows = unbundled(batch.column(0)[row]).take(pa.array(sorted(batch.column(1)[row].as_py())))
                yield from rows.cast(schema).combine_chunks().to_batches()

    return segments.join(places, "seg").select("packed", "ats").mapInArrow(lean(run), docs.schema)
