"""Quality classifier from weak labels.

Overlapping heuristic labellers vote junk, good or nothing on every document. Over
all documents' vote patterns (at most 3**labellers rows, counted by one
aggregate), expectation-maximisation estimates each labeller's accuracy and
the class balance - no true label is read. Each pattern's
posterior then labels a sample of at most about `fit_rows` distinct documents (a
hash threshold, the documented bound of the fit), on which a linear scorer
over hashed byte pairs is fitted; the scorer judges every document.

Scale: two passes over the text, no shuffle but the pattern counts; the driver
holds patterns and the fit's rows, whose number does not grow with the input.

Edge cases: null and wordless texts get score 0 and are not kept; repeated ids
and texts are judged each by itself and alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import aside, back, map_batches, table, text_slices, trim, without

SIZE = 1 << 11  #: slot 0 is kept for repeats
#: Byte pair -> feature, by a multiplicative hash.
PAIR = ((np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 11)).astype(np.int64).clip(1)
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
PLAIN = LETTER.copy()
PLAIN[[*range(48, 58), *b" \t\n\r.,;:'\"-()?!"]] = True

LABELLERS = ("symbols", "capitals", "bars", "repeats", "shouts", "few_kinds", "clean_words", "prose", "rich")


def votes(text: bytes | None) -> tuple[int, ...]:
    """One vote of each labeller: 1 good, -1 junk, 0 none.

    The first six look for one symptom each and know nothing of texts without
    it; the last three look for prose and are silent on texts with a trace of
    the symptoms that they can see.
    """
    words = (text or b"").split()
    if not words:
        return (-1,) * 6 + (0,) * 3
    n = len(words)
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    letters = max(int(count[LETTER].sum()), 1)
    symbols = 1 - count[PLAIN].sum() / count.sum()
    capitals = count[UPPER].sum() / letters
    bars, shouts = count[124] / n, count[33] / n
    again = sum(map(eq, words, words[1:]))
    repeats = again / n if again > 2 else 0.0  # a doubled word is no sign in a short text
    kinds = len(set(words)) / n**0.5
    stops = sum(w.endswith((b".", b"?")) for w in words) / n
    calm = capitals < 0.15 and shouts < 0.02
    return (
        -1 if symbols >= 0.03 else 0,
        -1 if capitals >= 0.3 and letters >= 20 else 0,
        -1 if bars >= 0.08 else 0,
        -1 if repeats >= 0.08 else 0,
        -1 if shouts >= 0.1 else 0,
        -1 if n >= 20 and kinds < 1.5 else 0,
        1 if symbols < 0.01 and bars < 0.02 and shouts < 0.02 and capitals < 0.3 and repeats < 0.05 else 0,
        1 if calm and symbols < 0.02 and bars < 0.02 and repeats < 0.03 and 0.01 < stops < 0.4 else 0,
        1 if calm and symbols < 0.01 and kinds >= min(2.0, 0.7 * n**0.5) and repeats < 0.03 else 0,
    )


def pattern(v: tuple[int, ...]) -> int:
    return sum((x + 1) * 3**k for k, x in enumerate(v))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500, smoothing: float = 1.0, bounds: tuple[float, float] = (0.6, 0.98)) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of good per pattern, accuracy of each labeller where it votes, share of good): votes are independent given the class, silence says nothing.

    Labellers are taken to beat chance (`bounds` of the accuracies) and the classes
    to weigh alike beforehand, whatever their estimated shares: most labellers speak
    for one class alone, so with the share as prior, or with noisy labellers and no bounds, EM
    settles on the trivial explanation that a lone symptom is its labeller's
    mistake and nearly all documents are of the commoner class.
    """
    v = patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1
    good = 1 / (1 + np.exp(-2.0 * v.sum(1)))  # begin from the majority
    for _ in range(rounds):
        share = ((good * counts).sum() + smoothing) / (counts.sum() + 2 * smoothing)
        right = np.where(v > 0, good[:, None], np.where(v < 0, 1 - good[:, None], 0)) * counts[:, None]
        accuracy = np.clip((right.sum(0) + 2 * smoothing) / ((counts[:, None] * (v != 0)).sum(0) + 3 * smoothing), *bounds)
        log = (v * np.log(accuracy / (1 - accuracy))).sum(1)
        new = 1 / (1 + np.exp(-np.clip(log, -500, 500)))
        if np.abs(new - good).max() < 1e-10:
            break
        good = new
    return good, accuracy, share


def hashed(text: bytes | None) -> np.ndarray:
    """Square roots of the shares of hashed byte pairs, and of words that repeat the word before (slot 0): a vector of length sqrt(2) at most."""
    raw = np.frombuffer(text or b"", np.uint8).astype(np.int64)
    if len(raw) < 2:
        return np.zeros(SIZE)
    pairs = np.bincount(PAIR[raw[:-1] << 8 | raw[1:]], minlength=SIZE)
    x = np.sqrt(pairs / pairs.sum())
    words = text.split()
    x[0] = np.sqrt(sum(map(eq, words, words[1:])) / max(len(words), 1))
    return x * min(1.0, (len(raw) / 80) ** 0.5)  # a few bytes say little


def fit(x: np.ndarray, good: np.ndarray, ridge: float = 1e-4, rounds: int = 400) -> np.ndarray:
    """Logistic weights (the last is the bias) on soft labels, classes weighing alike, by accelerated gradient steps."""
    if not len(x):
        return np.zeros(SIZE + 1)
    each = good / max(good.sum(), 1e-9) + (1 - good) / max((1 - good).sum(), 1e-9)
    each /= each.sum()
    w = before = np.zeros(x.shape[1] + 1)
    step = 1.3  # rows have length sqrt(3) at most, so the slope's rate of change is under 1
    for t in range(rounds):
        ahead = w + t / (t + 3) * (w - before)
        p = 1 / (1 + np.exp(-np.clip(x @ ahead[:-1].astype(x.dtype) + ahead[-1], -500, 500).astype(float)))
        off = each * (p - good)
        slope = np.append(off.astype(x.dtype) @ x + ridge * ahead[:-1], off.sum())
        before, w = w, ahead - step * slope
    return w


def model(documents: DataFrame, fit_rows: int = 4096) -> tuple[np.ndarray, dict[int, float], dict]:
    """(scorer's weights, posterior of each vote pattern, what EM found)."""

    def cast(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([pattern(votes(t)) for t in text_slices(batch.column("text"))], pa.int64())], ["pattern"])

    seen = map_batches(documents.select("text"), cast, "pattern long").groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").collect()
    if not seen:
        return np.zeros(SIZE + 1), {}, {}
    patterns, counts = np.array([r.pattern for r in seen]), np.array([r.n for r in seen], float)
    good, accuracy, share = expectation_maximisation(patterns, counts)
    posterior = dict(zip(patterns.tolist(), good.tolist(), strict=True))
    part = min(1.0, fit_rows / counts.sum())

    def look(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = list(text_slices(batch.column("text")))
        x = [hashed(t).astype("<f4").tobytes() for t in texts]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([posterior[pattern(votes(t))] for t in texts], pa.float64()), pa.array(x, pa.binary())], ["doc_id", "good", "x"])

    chosen = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if part < 1:
        chosen = chosen.where(F.xxhash64(F.lit(29), "doc_id", "text") < F.lit(int(-(1 << 63) + part * (1 << 64))))
    seen = map_batches(chosen.where("length(text) > 0").dropDuplicates(["doc_id", "text"]), look, "doc_id long, good double, x binary").toArrow().combine_chunks()
    seen = seen.sort_by([("doc_id", "ascending"), ("x", "ascending")]).combine_chunks().to_batches()
    weights = np.zeros(SIZE + 1)
    if seen:
        x = np.frombuffer(seen[0].column("x").buffers()[2], "<f4", seen[0].num_rows * SIZE).reshape(-1, SIZE)  # the column's own memory, not a copy
        weights = fit(x, seen[0].column("good").to_numpy())
        del x
    del seen
    trim()
    return weights, posterior, {"share": share, "accuracy": dict(zip(LABELLERS, accuracy.tolist(), strict=True))}


def classify(documents: DataFrame, fit_rows: int = 4096, keep_from: float = 0.3) -> DataFrame:
    """All columns of `documents`, q_posterior (of its votes), q_score (the scorer's probability of good) and q_keep, which replace columns of these names."""
    added = ["q_posterior", "q_score", "q_keep"]
    own = without(documents, added)
    safe = aside(own, "doc_id", "text")
    weights, posterior, _ = model(safe, fit_rows)
    names = safe.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in safe.schema)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        good, score, keep = [], [], []
        for t in text_slices(batch.column("text")):
            good.append(posterior[pattern(votes(t))])
            words = bool(t and t.split(None, 1))
            score.append(float(1 / (1 + np.exp(-np.clip(hashed(t) @ weights[:-1] + weights[-1], -500, 500)))) if words else 0.0)
            keep.append(words and score[-1] >= keep_from)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(good, pa.float64()), pa.array(score, pa.float64()), pa.array(keep, pa.bool_())], [*names, *added])

    return map_batches(safe, run, f"{schema}, q_posterior double, q_score double, q_keep boolean").toDF(*own.columns, *added)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = classify(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", F.col("q_posterior").alias("posterior"), F.col("q_score").alias("score"), F.col("q_keep").alias("keep"))


def kept(documents: DataFrame) -> DataFrame:
    """The documents that the scorer keeps, with their own columns."""
    safe = aside(documents, "doc_id", "text")
    return back(classify(safe).where("q_keep"), safe, documents)
