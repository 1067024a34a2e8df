"""Quality by perplexity under an interpolated modified Kneser-Ney n-gram model.

N-grams run over the characters of the texts, so the model grows with the trusted
text and knows every script that it has. Documents are packed into segments, which
stay where they are:

1. Each segment lists its distinct n-grams of every order, and how often those of
   the highest order stand in its trusted documents.
2. The counts are added up by n-gram; each order is joined with its contexts and
   with the order below. Nothing of it is gathered: the model is a table.
3. The segments' n-grams are joined with the model by n-gram, and the answers go
   back to their segments, which add up the log probability of each document.

What moves is a row a distinct n-gram of a segment, not one a character. A
document is rejected if its perplexity is above a quantile of the trusted
documents' of its language, with a margin.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from vecspark.llm._common import MADE, arrow_rows, bundled, forget, lean, stored, unbundled
from vecspark.llm.components import salted_join

ORDER = 4
#: The edges of a text, as characters that texts do not have.
OPEN, CLOSE = 2, 3
#: Characters that there are, for the share of one that no trusted text has.
ALPHABET = 1 << 17
#: Symbols' worth of the language's usual perplexity that a text gets beside its own.
PRIOR = 100.0
#: Symbols and documents of all languages that every language gets beside its own.
PRIOR_SYMBOLS, PRIOR_DOCS = 10_000.0, 20.0
#: One in so many trusted documents calibrates the limits without being trained on.
FOLDS = 5
#: Combinations up to which n-grams are numbered by a table, beyond by sorting.
TABLE = 1 << 23
#: Rows of a segment that are handed back at once: a segment whole would stand several times in the executor's memory.
HANDED = 500
#: Characters of a segment that are looked at together.
CHUNK = 1 << 19


def numbered(code: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A number from 0 for each distinct value below ``size``, and the values in that order."""
    if size > TABLE:
        values, numbers = np.unique(code, return_inverse=True)
        return numbers.astype(np.int32), values
    seen = np.zeros(size, dtype=bool)
    seen[code] = True
    rank = np.cumsum(seen, dtype=np.int32)
    return rank[code] - 1, np.flatnonzero(seen)


class Grams:
    """The distinct n-grams of some texts, and which of them ends at each symbol.

    Each text stands between edges; its places are that of the last opening edge,
    where contexts but no symbols end, its characters and the closing edge.
    """

    def __init__(self, texts: list[str | None], order: int = ORDER):
        raw = [np.frombuffer((t or "").encode("utf-32-le"), dtype="<u4") for t in texts]
        opening, closing = np.full(order, OPEN, dtype="<u4"), np.full(1, CLOSE, dtype="<u4")
        self.flat = np.concatenate([x for r in raw for x in (opening, r, closing)]) if raw else np.empty(0, "<u4")
        self.sizes = np.array([len(r) + 1 for r in raw], dtype=np.int64)
        whole, places = self.sizes + order, self.sizes + 1
        first = np.cumsum(whole) - whole + order - 1
        self.at = np.repeat(first - np.cumsum(places) + places, places) + np.arange(int(places.sum()))
        self.first = np.cumsum(places) - places
        symbol, alphabet = numbered(self.flat, 0x110000)
        #: For each order: where one of each n-gram ends (an index of ``at``), its suffix and its context in the order below.
        self.ends: list[np.ndarray] = []
        self.suffix: list[np.ndarray] = []
        self.context: list[np.ndarray] = []
        self.ids, count = np.zeros(len(self.at), dtype=np.int32), 1
        for k in range(1, order + 1):
            code = symbol[self.at - (k - 1)].astype(np.int64) * count + self.ids
            ids, values = numbered(code, len(alphabet) * count)
            end = np.empty(len(values), dtype=np.int64)
            end[ids] = np.arange(len(ids))
            self.ends.append(end)
            self.suffix.append(values % count)
            self.context.append(self.ids[end - 1])
            self.ids, count = ids, max(1, len(values))

    def names(self, k: int, wanted: np.ndarray) -> list[str]:
        """The ``wanted`` (a mark each) n-grams of order ``k``."""
        text = self.flat.tobytes().decode("utf-32-le")
        return [text[e - k + 1 : e + 1] for e in self.at[self.ends[k - 1][wanted]].tolist()]

    def hashes(self) -> list[np.ndarray]:
        """64 bits for each n-gram, by order."""
        out = []
        for k, end in enumerate(self.ends, 1):
            at, h = self.at[end], np.full(len(end), k, dtype=np.uint64)
            for j in range(k):
                h = (h ^ self.flat[at - j]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            out.append(h)
        return out

    def counts(self, wanted: np.ndarray) -> np.ndarray:
        """How often each n-gram of the highest order stands in the ``wanted`` texts."""
        use = np.repeat(wanted, self.sizes + 1)
        use[self.first] = False
        return np.bincount(self.ids[use], minlength=len(self.ends[-1]))

    def log_probabilities(self, p: list[np.ndarray], back: list[np.ndarray], floor: float) -> np.ndarray:
        """log p of each text; ``p`` and ``back`` are the model's for the n-grams of each order, nan where it has none."""
        below, weights = np.array([floor]), np.zeros(1)
        for own, weight, suffix, context in zip(p, back, self.suffix, self.context, strict=True):
            below = np.where(np.isnan(own), weights[context] + below[suffix], own)
            weights = np.nan_to_num(weight, nan=0.0)
        each = below[self.ids]
        each[self.first] = 0.0
        return np.add.reduceat(each, self.first)


class Slots:
    """A segment's distinct n-grams, numbered as they come."""

    def __init__(self, order: int = ORDER):
        self.count = 0
        self.seen = [np.empty(0, dtype=np.uint64) for _ in range(order)]
        self.slots = [np.empty(0, dtype=np.int64) for _ in range(order)]

    def of(self, hashes: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The numbers of the n-grams of each order, and marks of those that are new."""
        out, fresh = [], []
        for k, h in enumerate(hashes):
            place = np.searchsorted(self.seen[k], h)
            known = np.zeros(len(h), dtype=bool)
            inside = place < len(self.seen[k])
            known[inside] = self.seen[k][place[inside]] == h[inside]
            own = np.empty(len(h), dtype=np.int64)
            own[known] = self.slots[k][place[known]]
            own[~known] = self.count + np.arange(int((~known).sum()))
            self.count += int((~known).sum())
            order = np.argsort(h[~known], kind="stable")
            spot = place[~known][order]
            self.seen[k], self.slots[k] = np.insert(self.seen[k], spot, h[~known][order]), np.insert(self.slots[k], spot, own[~known][order])
            out.append(own)
            fresh.append(~known)
        return out, fresh


def chunks(texts: list[str | None], size: int | None = None) -> Iterator[slice]:
    """Runs of texts of about ``size`` characters (a longer text stands alone)."""
    start, held, size = 0, 0, size or CHUNK
    for i, text in enumerate(texts):
        if i > start and held + len(text or "") > size:
            yield slice(start, i)
            start, held = i, 0
        held += len(text or "")
    if start < len(texts):
        yield slice(start, len(texts))


def trains(doc_id: int | None) -> bool:
    """Whether a trusted document is one to train on."""
    return zlib.crc32(str(doc_id).encode()) % FOLDS != 0


def trusted_ids(segments: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """``seg``, ``trusted``: the ids in each segment that ``labels`` calls good."""
    good = labels.where(F.col(label_col) == 1).select(F.col(id_col).cast("bigint").alias("id")).where("id is not null").distinct()
    own = segments.select("seg", F.explode("ids").alias("id"))
    return salted_join(own, good, "id", "seg").groupBy("seg").agg(F.collect_set("id").alias("trusted"))


def segment_grams(segments: DataFrame, trusted: DataFrame, text_col: str, order: int = ORDER) -> DataFrame:
    """``g``, ``seg``, ``slot``, ``n``: the distinct n-grams of each segment, with their counts in documents to train on."""
    schema = pa.schema([("g", pa.string()), ("seg", pa.int64()), ("slot", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                texts, good = unbundled(batch.column(2)[row])[text_col].to_pylist(), set(batch.column(3)[row].as_py() or ())
                wanted = np.array([i in good and trains(i) for i in batch.column(1)[row].as_py()], dtype=bool)
                known, names, n = Slots(order), [], np.zeros(0, dtype=np.int64)
                for part in chunks(texts):
                    grams = Grams(texts[part], order)
                    slots, fresh = known.of(grams.hashes())
                    for k, new in enumerate(fresh, 1):
                        names += grams.names(k, new)
                    n = np.concatenate([n, np.zeros(known.count - len(n), dtype=np.int64)])
                    n[slots[-1]] += grams.counts(wanted[part])
                for at in range(0, len(names), 20_000):
                    part = names[at : at + 20_000]
                    yield arrow_rows(schema, [part, [batch.column(0)[row].as_py()] * len(part), np.arange(at, at + len(part)), n[at : at + 20_000]])

    joined = segments.join(trusted, "seg", "left").select("seg", "ids", "packed", "trusted")
    return stored(joined.mapInArrow(lean(run), "g string, seg bigint, slot int, n bigint"), "grams")


def discounts(table: DataFrame) -> list[float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more."""
    found = {r[0]: r[1] for r in table.where("n <= 4").groupBy("n").count().collect()}
    n1, n2, n3, n4 = (found.get(i, 0) for i in (1, 2, 3, 4))
    if not n1 or not n2:
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.5]
    return [min(max(d, 0.05), i - 0.05) for i, d in enumerate(raw, 1)]


def kneser_ney(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """The model: ``g``, ``p`` (log probability after its context, if seen), ``back`` (log weight of the order below, if a context).

    ``counts`` has ``g`` (n-grams of the highest order) and ``n``. Orders below the
    highest count the distinct characters before an n-gram. The empty n-gram is
    the context of the lowest order.
    """
    tables = [stored(counts, "counts")]
    for _ in range(order - 1):
        tables.append(stored(tables[-1].select(F.expr("substring(g, 2)").alias("g")).groupBy("g").agg(F.count("*").alias("n")), "counts"))
    lower, parts = None, []
    for k, table in enumerate(reversed(tables), 1):
        d1, d2, d3 = discounts(table)
        off = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        cut = table.select("g", F.expr(f"substring(g, 1, {k - 1})").alias("c"), "n", off.alias("off"))
        contexts = cut.groupBy("c").agg(F.sum("n").alias("all"), (F.sum("off") / F.sum("n")).alias("back"))
        own = cut.join(contexts.hint("merge"), "c").withColumn("p", (F.col("n") - F.col("off")) / F.col("all"))
        if lower is None:
            seen = own.select("g", (F.col("p") + F.col("back") / ALPHABET).alias("p"))
        else:
            seen = own.withColumn("s", F.expr("substring(g, 2)")).join(lower.select(F.col("g").alias("s"), F.col("p").alias("below")).hint("merge"), "s").select("g", (F.col("p") + F.col("back") * F.col("below")).alias("p"))
        lower = stored(seen, "probabilities")
        parts += [lower.select("g", F.log("p").alias("p"), F.lit(None).cast("double").alias("back")), contexts.select(F.col("c").alias("g"), F.lit(None).cast("double").alias("p"), F.log("back").alias("back"))]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return stored(every.groupBy("g").agg(F.max("p").alias("p"), F.max("back").alias("back")), "model")


def floor_of(model: DataFrame) -> float:
    """log p of a character that the model does not know."""
    row = model.where("g = ''").select("back").first()
    return (row[0] if row else 0.0) - math.log(ALPHABET)


def scores(segments: DataFrame, grams: DataFrame, model: DataFrame, text_col: str, order: int = ORDER) -> DataFrame:
    """``seg``, ``nll`` (minus the log probability of each document), ``n`` (its symbols, the closing edge included)."""
    floor = floor_of(model)
    answers = grams.select("g", "seg", "slot").join(model.hint("merge"), "g").select("seg", "slot", "p", "back")
    answers = answers.groupBy("seg").agg(F.collect_list("slot").alias("slots"), F.collect_list(F.coalesce("p", F.lit(float("nan")))).alias("p"), F.collect_list(F.coalesce("back", F.lit(float("nan")))).alias("back"))
    schema = pa.schema([("seg", pa.int64()), ("nll", pa.list_(pa.float64())), ("n", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                texts = unbundled(batch.column(1)[row])[text_col].to_pylist()
                slots, p, back = (np.asarray(batch.column(i)[row].values if batch.column(i)[row].is_valid else []) for i in (2, 3, 4))
                told = np.full((2, int(slots.max(initial=-1)) + 2), np.nan)
                told[:, slots.astype(np.int64)] = p, back
                known, nll, n = Slots(order), [], []
                for part in chunks(texts):
                    grams = Grams(texts[part], order)
                    # Numbers beyond the last one that was answered are as unknown as that behind it.
                    own = [np.minimum(x, told.shape[1] - 1) for x in known.of(grams.hashes())[0]]
                    nll.append(-grams.log_probabilities([told[0][x] for x in own], [told[1][x] for x in own], floor))
                    n.append(grams.sizes)
                yield arrow_rows(schema, [[batch.column(0)[row].as_py()], [np.concatenate(nll)], [np.concatenate(n)]])

    joined = segments.join(answers, "seg", "left").select("seg", "packed", "slots", "p", "back")
    return stored(joined.mapInArrow(lean(run), "seg bigint, nll array<double>, n array<bigint>"), "scores")


class Limits:
    """What the trusted documents say: the mean and the limit of the smoothed log perplexity, by language."""

    def __init__(self, means: dict[str, float], mean_all: float, limits: dict[str, float], limit_all: float):
        self.means, self.mean_all, self.limits, self.limit_all = means, mean_all, limits, limit_all

    def smoothed(self, lang: str | None, nll: float, n: int) -> float:
        return (nll + PRIOR * self.means.get(lang or "", self.mean_all)) / (n + PRIOR)

    def limit(self, lang: str | None) -> float:
        return self.limits.get(lang or "", self.limit_all)


def limits_of(segments: DataFrame, trusted: DataFrame, scored: DataFrame, quantile: float) -> Limits:
    """The limits from the scores of all trusted documents.

    Every language's mean and quantile are drawn to those of all languages by a
    prior of fixed weight. The quantile is exact to a thousandth of the log
    perplexity: it is read off a histogram, so no list of scores is gathered anywhere.
    """
    rows = segments.select("seg", "ids", "langs").join(scored, "seg").join(trusted, "seg")
    own = rows.select("trusted", F.explode(F.arrays_zip("ids", "langs", "nll", "n")).alias("d")).where(F.expr("array_contains(trusted, d.ids)"))
    good = stored(own.select(F.coalesce("d.langs", F.lit("")).alias("lang"), F.col("d.nll").alias("nll"), F.col("d.n").alias("n")), "trusted")
    levels = good.groupBy("lang").agg(F.sum("nll").alias("nll"), F.sum("n").alias("n"), F.count("*").alias("docs")).collect()  # a row a language
    n = sum(r.n for r in levels)
    mean_all = sum(r.nll for r in levels) / n if n else 0.0
    means = {r.lang: (r.nll + PRIOR_SYMBOLS * mean_all) / (r.n + PRIOR_SYMBOLS) for r in levels}
    mean = F.lit(mean_all)
    for lang, x in means.items():
        mean = F.when(F.col("lang") == lang, F.lit(x)).otherwise(mean)
    smooth = (F.col("nll") + PRIOR * mean) / (F.col("n") + PRIOR)
    bins = good.select("lang", F.ceil(smooth * 1000).alias("b")).groupBy("lang", "b").count().collect()  # a row a language and thousandth
    if not bins:
        return Limits({}, 0.0, {}, float("inf"))
    limit_all = at_quantile([(r.b, r["count"]) for r in bins], quantile)
    limits = {r.lang: (r.docs * at_quantile([(x.b, x["count"]) for x in bins if x.lang == r.lang], quantile) + PRIOR_DOCS * limit_all) / (r.docs + PRIOR_DOCS) for r in levels}
    return Limits(means, mean_all, limits, limit_all)


def judged(docs: DataFrame, labels: DataFrame, quantile: float = 0.999, margin: float = 1.05, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality", only_kept: bool = False) -> DataFrame:
    """``docs`` with ``perplexity``, ``threshold`` and ``keep``; with ``only_kept`` the rows kept, as they are.

    The model is trained on four fifths (by id) of the documents that ``labels``
    calls good, whole; all of them set the limits. ``perplexity`` includes
    ``PRIOR`` symbols at the trusted documents' mean of the language, so that a
    text of few characters is judged by little. The threshold is the language's
    trusted ``quantile`` times ``margin``; a language of few or no trusted
    documents has nearly or wholly that of all languages (a null one counts as a
    language). Null and empty texts score the closing edge alone and are kept by
    the prior; very long texts are scored whole; repeated rows are judged alike
    and all stay; a null id is never trusted; without any trusted document
    everything is kept; columns of clashing names are replaced (``only_kept``:
    left alone).
    """
    segments = bundled(docs, id_col, text_col, {"langs": (lang_col, "string")}, most_bytes=16 << 20)
    trusted = stored(trusted_ids(segments, labels, id_col, label_col), "trusted-ids")
    first = len(MADE)
    grams = segment_grams(segments, trusted, text_col, order)
    model = kneser_ney(grams.where("n > 0").groupBy("g").agg(F.sum("n").alias("n")), order)
    scored = scores(segments, grams, model, text_col, order)
    forget(docs.sparkSession, first, len(MADE) - 1)  # the model has done its work
    limits = docs.sparkSession.sparkContext.broadcast(limits_of(segments, trusted, scored, quantile))
    extra = {} if only_kept else {"perplexity": "double", "threshold": "double", "keep": "boolean"}
    kinds = StructType([*(f for f in docs.schema.fields if f.name not in extra), *(StructField(n, _parse_datatype_string(t)) for n, t in extra.items())])
    schema = to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = limits.value
        for batch in batches:
            for row in range(batch.num_rows):
                rows = unbundled(batch.column(1)[row])
                langs, nll, n = (batch.column(i)[row].as_py() for i in (2, 3, 4))
                found = [math.exp(min(own.smoothed(*x), 700.0)) for x in zip(langs, nll, n, strict=True)]
                bar = [math.exp(min(own.limit(lang), 700.0)) * margin for lang in langs]
                new = {"perplexity": found, "threshold": bar, "keep": [x <= y for x, y in zip(found, bar, strict=True)]}
                out = pa.RecordBatch.from_arrays([pa.array(new[f.name], type=f.type) if f.name in extra else rows[f.name].combine_chunks() for f in schema], schema=schema)
                kept = pa.array(new["keep"], type=pa.bool_())
                for at in range(0, out.num_rows, HANDED):
                    part = out.slice(at, HANDED)
                    yield part.filter(kept.slice(at, HANDED)) if only_kept else part

    return segments.join(scored, "seg").select("seg", "packed", "langs", "nll", "n").mapInArrow(lean(run), kinds)


def at_quantile(bins: list[tuple[int, int]], q: float) -> float:
    total, run = sum(n for _, n in bins), 0
    for b, n in sorted(bins):
        run += n
        if run >= q * total:
            break
    return b / 1000.0
