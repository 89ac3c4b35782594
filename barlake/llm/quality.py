"""Quality rules: counts over whole texts, and a logistic regression on hashed word and character n-grams.

The model sums a weight per n-gram, scaled by the text's length, so a text of any length is scored in one pass without building its
feature vector.  It is fitted in one task on a bounded sample of labelled rows and calibrated on rows that it did not
see; the scores of all other rows are computed in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlake.llm import tokens
from barlake.llm.common import batches, lean, release, slices
from barlake.session import staged

SLOTS = 1 << 16  # weights per n-gram kind
CHAR_N = (1, 3)
WORD_N = (1, 2)
SAMPLE = 4000  # labelled rows that the model is fitted on, at most
SAMPLE_BYTES = 256 << 20  # of their texts together, at most
PART = 1 << 18  # bytes of texts that are scored together; a longer text is scored alone
THRESHOLD = 0.5  # least calibrated probability of a good text
SYMBOLS = np.array([ord(c) for c in "#*$%&|<>"], np.uint32)


@dataclass
class Model:
    weights: np.ndarray  # one row per n-gram kind
    bias: float
    slope: float  # of the calibration: probability = sigmoid(slope * score + shift)
    shift: float

    def probability(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * score + self.shift, -30, 30)))


def _grams(words: tokens.Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram kind: (slot, text index) of every occurrence; digits count as one character."""
    n_texts = len(words.text_start)
    codes = words.codes.astype(np.uint64)
    codes = np.where((codes >= 48) & (codes <= 57), np.uint64(48), codes)
    owner = np.repeat(np.arange(n_texts), np.diff(np.append(words.text_start, len(codes))))
    for n in CHAR_N:
        hashed = tokens.chain(codes, n)
        same = owner[: len(hashed)] == owner[n - 1 : len(hashed) + n - 1]
        yield (hashed[same] & np.uint64(SLOTS - 1)).astype(np.int64), owner[: len(hashed)][same]
    single = words.hashes()
    for n in WORD_N:
        hashed = tokens.chain(single, n)
        same = words.owner[: len(hashed)] == words.owner[n - 1 : len(hashed) + n - 1]
        yield (hashed[same] & np.uint64(SLOTS - 1)).astype(np.int64), words.owner[: len(hashed)][same]


def _scale(kind: int, n: np.ndarray) -> np.ndarray:
    """Characters count by their share.  Words count by the root of n, so that a few telling words show in a long text."""
    return np.maximum(n if kind < len(CHAR_N) else np.sqrt(n), 1)


def scores(model: Model, words: tokens.Words) -> np.ndarray:
    """Bias plus, for each n-gram kind, the text's summed weights over n (characters) or the root of n (words)."""
    out = np.full(len(words.text_start), model.bias)
    for k, (slot, owner) in enumerate(_grams(words)):
        total = np.bincount(owner, model.weights[k][slot], len(out))
        out += total / _scale(k, np.bincount(owner, minlength=len(out)))
    return out


def fit(texts: list[str], good: np.ndarray, steps: int = 120, rate: float = 0.3, decay: float = 1e-5) -> Model:
    """Logistic regression by Adam on four fifths of the rows, Platt calibration on the other fifth.

    Classes are weighted alike while fitting; the calibration restores their shares.  With one class only, the model
    answers that class's share for every text.
    """
    good = good.astype(np.float64)
    held = np.arange(len(texts)) % 5 == 4
    if len(set(good[~held])) < 2 or len(set(good[held])) < 2:
        share = (good.sum() + 1) / (len(good) + 1) if good.all() else good.mean()
        return Model(np.zeros((len(CHAR_N) + len(WORD_N), SLOTS)), 0.0, 1.0, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    parts: list[list[tuple]] = [[] for _ in range(len(CHAR_N) + len(WORD_N))]
    for start, end in slices(pa.array(texts, pa.string())):  # whole texts, some at a time
        for k, (slot, owner) in enumerate(_grams(tokens.split(texts[start:end]))):
            cell, count = np.unique(owner * SLOTS + slot, return_counts=True)
            owner, slot = cell // SLOTS, cell % SLOTS
            share = count / _scale(k, np.bincount(owner, count, end - start))[owner]
            parts[k].append(((owner + start).astype(np.int32), slot.astype(np.int32), share.astype(np.float32)))
    kinds = [tuple(np.concatenate(x) for x in zip(*p, strict=True)) for p in parts]
    weight = np.where(good == 1, 0.5 / good[~held].sum(), 0.5 / (1 - good[~held]).sum()) * ~held
    w, bias = np.zeros((len(kinds), SLOTS)), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0

    def linear() -> np.ndarray:
        return bias + sum(np.bincount(o, x * w[k][s], len(texts)) for k, (o, s, x) in enumerate(kinds))

    for t in range(1, steps + 1):
        error = weight * (1 / (1 + np.exp(-np.clip(linear(), -30, 30))) - good)
        g = np.stack([np.bincount(s, x * error[o], SLOTS) for o, s, x in kinds]) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        gb = error.sum()
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        bias -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-6)
    score, y = linear()[held], good[held]
    slope, shift = _platt(score, y)
    return Model(w, bias, slope, shift)


def _platt(score: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of the log-odds by Newton's method on smoothed targets."""
    high, low = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    target, x = np.where(y == 1, high, low), np.stack([score, np.ones_like(score)])
    beta = np.array([1.0, 0.0])
    loss = lambda b: float(np.sum(np.logaddexp(0, b @ x) - target * (b @ x)))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(beta @ x, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-9 * np.eye(2), x @ (p - target))
        size = 1.0
        while size > 1e-6 and loss(beta - size * step) > loss(beta):
            size /= 2
        beta = beta - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled rows, chosen by the hash of doc_id; the rows meet in one task, never on the driver.

    A doc_id of several rows counts once, with its smallest text.  Texts over a sixteenth of SAMPLE_BYTES are not fitted
    on, and the rows whose texts pass SAMPLE_BYTES together, in order of the hash, are left out of the fit as well.

    A row is good if its quality is 1 and it isn't toxic.  Only the bounded weights come to the driver.
    """
    target = F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0)
    chosen = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(target).alias("good")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").where("text IS NOT NULL").where(F.octet_length("text") <= SAMPLE_BYTES // 16)
    rows = staged(texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "good").agg(F.min("text").alias("text")))
    so_far = F.sum(F.octet_length("text").cast("long")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # of at most ``sample`` rows
    fits = rows.select("doc_id", so_far.alias("so_far")).where(F.col("so_far") <= SAMPLE_BYTES).select("doc_id")
    rows = rows.join(fits, "doc_id", "left_semi").select("doc_id", "text", "good")

    def one(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        order = np.argsort(tokens.mix(group.column("doc_id").to_numpy().astype(np.uint64)), kind="stable")
        texts = group.column("text").to_pylist()
        model = fit([texts[i] for i in order], group.column("good").to_numpy()[order])
        release()
        return pa.table({"weights": pa.array([model.weights.astype(np.float32).tobytes()], pa.binary()), "bias": [model.bias], "slope": [model.slope], "shift": [model.shift]})

    fitted = rows.groupBy(F.lit(1).alias("all")).applyInArrow(one, "weights binary, bias double, slope double, shift double").collect()
    if not fitted:
        return fit([], np.zeros(0))
    row = fitted[0]
    return Model(np.frombuffer(row.weights, np.float32).reshape(-1, SLOTS).astype(np.float64), row.bias, row.slope, row.shift)


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measures(texts: list[str | None], words: tokens.Words) -> dict[str, np.ndarray]:
    """Counts of each whole text; see ``score``."""
    n = words.count
    symbol = np.concatenate(([0], np.cumsum(np.isin(words.codes, SYMBOLS))))
    until = np.append(words.text_start[1:], len(words.codes))
    lines = [[x for x in (t or "").split("\n") if x.strip(" \t\n\v\f\r")] for t in texts]
    keys = tokens.chain(words.hashes(), 3)
    inside = words.owner[: len(keys)] == words.owner[2 : len(keys) + 2]
    keys = tokens.mix(keys + words.owner[: len(keys)].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, back, count = np.unique(keys[inside], return_inverse=True, return_counts=True)
    place = np.flatnonzero(inside)[count[back] > 1]
    repeated = np.zeros(len(words.owner), bool)
    for i in range(3):
        repeated[place + i] = True
    return {
        "n_words": n, "word_chars": tokens.per_text(words.end - words.start, words.first), "n_symbols": symbol[until] - symbol[words.text_start],
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], np.int64), "n_repeat_words": tokens.per_text(repeated, words.first),
    }


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed and kept (boolean), quality (double).

    ``quality`` is the calibrated probability that the text is good; ``kept`` is false where the base rules fail
    (under 50 words, or over half of the words in repeated 3-word windows) or quality is under THRESHOLD.  A null text
    is empty.  All input columns stay; a column of the same name is refused.
    """
    clash = {*MEASURES, "base_failed", "kept", "quality"} & {*docs.columns}
    if clash:
        raise ValueError(f"columns exist: {sorted(clash)}")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.weights.astype(np.float32).tobytes(), model.bias, model.slope, model.shift))

    def run(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, *rest = shared.value
        local = Model(np.frombuffer(raw, np.float32).reshape(-1, SLOTS), *rest)
        for batch in batches(source, text, PART):
            texts = batch.column(text).to_pylist()
            words = tokens.split(texts)
            found = measures(texts, words)
            quality = local.probability(scores(local, words))
            failed = (found["n_words"] < 50) | (100 * found["n_repeat_words"] > 50 * found["n_words"])
            columns = [*(pa.array(found[k].astype(np.int64)) for k in MEASURES), pa.array(failed), pa.array(~failed & (quality >= THRESHOLD)), pa.array(quality)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *MEASURES, "base_failed", "kept", "quality"])

    row = docs.select("*", *[F.lit(0).cast("long").alias(k) for k in MEASURES], F.lit(True).alias("base_failed"), F.lit(True).alias("kept"), F.lit(0.0).alias("quality"))
    return docs.mapInArrow(lean(run), row.schema)
