"""Toxic passages by maximum-scoring segments of token log-odds.

A token's score is the log-odds of its frequency in toxic against clean training
texts under an informative Dirichlet prior (the pooled frequencies). Tokens are
words; a word that is no significant token itself takes the score of the longest
significant beginning of it. All other words share one small negative score. A
linear scan over the scores finds every maximal scoring segment; with scores that
are log likelihood ratios, the largest of n positions follows an extreme-value
law whose scale is 1, so each segment has an expected number of equals by chance.
A logistic curve over the best segment's surprise gives the document's score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm._common import arrow_rows, stored

TOKEN = re.compile(r"[^\W\d_]+")
#: Lengths of the beginnings of words that may be tokens, longest first.
BEGINNINGS = (6, 5, 4, 3)
#: Expected number by chance under which a passage counts as significant.
SIGNIFICANT = 0.05
FOLDS, HELD_OUT = 5, 0


def fold(doc_id: int | None) -> int | None:
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % FOLDS


def fold_column(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def segments(hits: list[tuple[int, float]], gap: float) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first position, last position), in linear time.

    ``hits`` are the positions with a positive score; every other position has the
    negative score ``gap``. Each held segment knows the last one before it whose
    sum on the left is smaller, so a search steps over those between, and when
    there is none all held segments are final.
    """
    done: list[tuple[float, int, int]] = []
    held: list[tuple[float, float, int, int, int]] = []  # left and right cumulative sums, first and last position, the smaller one before
    total, at = 0.0, -1
    for position, score in hits:
        total += gap * (position - at - 1)
        left, right, first, j = total, total + score, position, len(held) - 1
        total, at = right, position
        while True:
            while j >= 0 and held[j][0] >= left:
                j = held[j][4]
            if j < 0:
                done += [(y - x, a, b) for x, y, a, b, _ in held]
                held.clear()
                break
            if held[j][1] >= right:
                break
            left, _, first, _, before = held[j]
            del held[j:]
            j = before
        held.append((left, right, first, position, j))
    return done + [(y - x, a, b) for x, y, a, b, _ in held]


class Model:
    """Scores of significant tokens, the other words' score, and the calibration."""

    def __init__(self, scores: dict[str, float], gap: float, k: float = 1.0, slope: float = 1.0, offset: float = 0.0):
        self.scores, self.gap, self.k, self.slope, self.offset = scores, gap, k, slope, offset
        self.known: dict[str, float] = {}

    def word(self, word: str) -> float:
        got = self.scores.get(word)
        if got is None:
            got = next((s for n in BEGINNINGS if len(word) > n and (s := self.scores.get(word[:n] + "*")) is not None), 0.0)
        if len(self.known) >= 300_000:
            self.known.clear()
        self.known[word] = got
        return got

    def hits(self, text: str | None) -> tuple[int, list[tuple[int, float]]]:
        words, known = tokens(text), self.known
        found = [known.get(w, -1.0) for w in words]
        if -1.0 in found:
            found = [self.word(w) if s < 0 else s for w, s in zip(words, found, strict=True)]
        return len(words), [(i, s) for i, s in enumerate(found) if s > 0] if any(found) else []

    def passages(self, text: str | None) -> tuple[int, list[tuple[float, int, int]]]:
        n, hits = self.hits(text)
        return n, segments(hits, self.gap)

    def surprise(self, n: int, score: float) -> float:
        """Minus the log of the expected number of segments of this score by chance."""
        return min(max(score - math.log(self.k * max(n, 1)), -20.0), 20.0)

    def judge(self, text: str | None) -> tuple[float, list[tuple[int, int]]]:
        """The score, and the word ranges (end exclusive) of the significant passages."""
        n, found = self.passages(text)
        best = max((s for s, _, _ in found), default=0.0)
        x = self.slope * self.surprise(n, best) + self.offset
        score = 1.0 / (1.0 + math.exp(-min(max(x, -40.0), 40.0)))
        limit = -math.log(SIGNIFICANT)
        return score, [(a, b + 1) for s, a, b in found if self.surprise(n, s) > limit]


def training_rows(docs: DataFrame, labels: DataFrame, most: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """``label``, ``text`` of at most ``most`` labelled documents of each class, none held out.

    Those with the smallest hashes are taken; their ids, of bounded number, are broadcast.
    """
    usable = labels.where(F.col(label_col).isin(0, 1) & (fold_column(id_col) != HELD_OUT)).groupBy(F.col(id_col).cast("bigint").alias("vs_id")).agg(F.max(label_col).cast("int").alias("vs_label"))
    chosen = [usable.where(F.col("vs_label") == y).orderBy(F.xxhash64("vs_id"), "vs_id").limit(most) for y in (0, 1)]
    picked = stored(chosen[0].unionByName(chosen[1]), "training-ids")
    found = docs.select(docs[id_col].cast("bigint").alias("vs_id"), docs[text_col].alias("text")).join(F.broadcast(picked), "vs_id").select(F.col("vs_label").alias("label"), "text")
    schema = pa.schema([("label", pa.int32()), ("text", pa.string()), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield arrow_rows(schema, [batch.column(0), batch.column(1), [sketch(t) for t in batch.column(1).to_pylist()]])

    # Copies and near copies count once: one text for each sketch and class.
    return found.mapInArrow(run, "label int, text string, sketch binary").groupBy("label", "sketch").agg(F.min("text").alias("text")).select("label", "text")


def sketch(text: str | None, size: int = 4) -> bytes:
    """The least ``size`` hashes of the text's 4-word runs.

    Near copies mostly share all of them; texts that share a passage would need
    all of them to fall into it.
    """
    words = tokens(text)
    runs = {zlib.crc32(" ".join(words[i : i + 4]).encode()) for i in range(max(1, len(words) - 3))}
    return b"".join(h.to_bytes(4) for h in sorted(runs)[:size])


def token_counts(rows: DataFrame) -> DataFrame:
    """``token``, ``clean``, ``toxic``: how many texts of each kind have the word or the beginning.

    Texts, not places: one text that repeats a word says no more about it than
    one that has it once.
    """
    schema = pa.schema([("token", pa.string()), ("clean", pa.int64()), ("toxic", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = set(tokens(text))
                counts[label].update(words)
                counts[label].update({word[:size] + "*" for word in words for size in BEGINNINGS if len(word) > size})
            names = list(counts[0].keys() | counts[1].keys())
            yield arrow_rows(schema, [names, [counts[0][w] for w in names], [counts[1][w] for w in names]])

    return rows.mapInArrow(run, "token string, clean bigint, toxic bigint").groupBy("token").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def log_odds(counts: DataFrame, prior: float, least: int, z: float, most_tokens: int) -> tuple[dict[str, float], float, float]:
    """Scores of the tokens whose log-odds are significant, and the sizes of both samples.

    The prior weighs ``prior`` times the whole sample: a token that clean texts
    lack altogether still has a finite score with a bounded variance.
    """
    words = counts.where(~F.col("token").endswith("*")).agg(F.sum("clean"), F.sum("toxic")).first()
    n0, n1 = float(words[0] or 0), float(words[1] or 0)
    if not n0 or not n1:
        return {}, n0, n1
    strength = prior * (n0 + n1)
    share = (F.col("clean") + F.col("toxic")) * prior
    a1, a0 = F.col("toxic") + share, F.col("clean") + share
    delta = F.log(a1 / (n1 + strength - a1)) - F.log(a0 / (n0 + strength - a0))
    ranked = counts.where(F.col("clean") + F.col("toxic") >= least).select("token", delta.alias("s"), (delta / F.sqrt(1 / a1 + 1 / a0)).alias("z"))
    kept = ranked.where((F.col("z") > z) & (F.col("s") > 0.5)).orderBy(F.desc("z"), "token").limit(most_tokens)
    return {r.token: r.s for r in kept.collect()}, n0, n1


def fit(docs: DataFrame, labels: DataFrame, most: int = 20_000, prior: float = 0.05, least: int = 5, z: float = 3.5, most_tokens: int = 100_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """The model from at most ``most`` labelled documents a class (the documented bound of the sample).

    Without rows of both classes every text scores 0.5 or a little less.
    """
    rows = stored(training_rows(docs, labels, most, id_col, text_col, label_col), "training")
    scores, n0, n1 = log_odds(token_counts(rows), prior, least, z, most_tokens)
    if not scores:
        return Model({}, -0.01, 1.0, 0.0, -1e-6)
    bare = docs.sparkSession.sparkContext.broadcast(Model(scores, 0.0))
    tally = hits_of(rows, bare).groupBy("label").agg(F.sum("n").alias("n"), F.sum("hit").alias("hit")).collect()
    rate = {r.label: r.hit / max(r.n, 1) for r in tally}
    gap = min(math.log((1 - min(rate.get(1, 0.0), 0.9)) / (1 - min(rate.get(0, 0.0), 0.9))), -0.01)
    shared = docs.sparkSession.sparkContext.broadcast(Model(scores, gap))
    best = hits_of(rows, shared).select("label", "n", "best").toArrow()
    label, n, s = (best[c].to_numpy() for c in ("label", "n", "best"))
    clean = label == 0
    k = clean.sum() / max((np.maximum(n, 1) * np.exp(-s))[clean].sum(), 1e-9)
    model = Model(scores, gap, float(k))
    x = np.array([model.surprise(a, b) for a, b in zip(n.tolist(), s.tolist(), strict=True)])
    model.slope, model.offset = logistic(x, label.astype(float))
    return model


def hits_of(rows: DataFrame, shared) -> DataFrame:
    """``label``, ``n`` (words), ``hit`` (scored words), ``best`` (largest segment) of the training texts."""
    schema = pa.schema([("label", pa.int32()), ("n", pa.int64()), ("hit", pa.int64()), ("best", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            n, hit, best = [], [], []
            for text in batch.column(1).to_pylist():
                count, found = model.hits(text)
                n.append(count)
                hit.append(len(found))
                best.append(max((s for s, _, _ in segments(found, model.gap)), default=0.0))
            yield arrow_rows(schema, [batch.column(0), n, hit, best])

    return rows.select("label", "text").mapInArrow(run, "label int, n bigint, hit bigint, best double")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset of a logistic curve, both classes weighing the same."""
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    design, beta = np.stack([x, np.ones_like(x)], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -40, 40)))
        step = np.linalg.solve((design * (weight * p * (1 - p))[:, None]).T @ design + ridge * np.eye(2), design.T @ (weight * (y - p)) - ridge * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-10:
            break
    return float(beta[0]), float(beta[1])


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 20_000) -> DataFrame:
    """Per row of ``docs``: id, ``held_out``, ``score``, ``predicted``, ``n_passages``, ``passages`` ("first:end" in words).

    The score comes from the text alone. Null and empty texts have no word and
    score what no toxic word scores; very long texts are scanned whole; repeated
    rows give repeated rows; a null id is not held out; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, most, id_col=id_col, text_col=text_col))
    schema = pa.schema([(id_col, pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("n_passages", pa.int64()), ("passages", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            judged = [model.judge(t) for t in batch.column(1).to_pylist()]
            scores = [s for s, _ in judged]
            yield arrow_rows(schema, [ids, [fold(i) == HELD_OUT for i in ids], scores, [int(s >= 0.5) for s in scores], [len(p) for _, p in judged], [",".join(f"{a}:{b}" for a, b in p) for _, p in judged]])

    picked = docs.select(docs[id_col].cast("bigint").alias(id_col), docs[text_col].alias("text"))
    return picked.mapInArrow(run, f"`{id_col}` bigint, held_out boolean, score double, predicted int, n_passages bigint, passages string")
