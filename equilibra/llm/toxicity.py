"""Toxicity by compression distance.

Two zstandard dictionaries are trained apart, both with ``train_dictionary`` on
windows of text: one on labelled toxic text, one on labelled ordinary text.  A
window of a few words is compressed twice: by the ordinary dictionary, and by
the toxic and the ordinary dictionary joined.  Most of a toxic text is ordinary,
so the difference of the two lengths isolates what toxic text adds.  The
ordinary part stands nearer in the joined dictionary, so that what both parts
hold costs the same in both; the order of words that ordinary text uses often
is therefore not seen.  Windows stand between constant paddings, which keep
zstandard from storing a tiny block raw.

A document's windows (one from every word on) give a histogram of length
differences; longer spans are compared first, and only those that the toxic
side shortens are looked into.  Its calibrated decision is a logistic curve over that histogram,
fitted on labelled rows that trained no dictionary, with the intercept set so
that 0.5 is the threshold of least error at the labelled share of toxic rows.

Bounded: at most ``per_class`` labelled rows of each class are read for
fitting (rows of smallest id hash); the model is under 1 MB whatever the
corpus holds.  Scoring is one pass over the whole texts without a shuffle.

Defined results: a null or empty text has no window and scores as the curve
says for an empty histogram, at most 0.49; repeated rows score alike; with no labelled toxic row (or
no ordinary one, or with too little text for a dictionary) every score is 0; other columns pass
through untouched.
"""

from __future__ import annotations

import math
import random
import re
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equilibra.llm.common import add_columns, hashed_sample, id_remainder, once

PER_CLASS = 2000          # labelled rows per class used for fitting (the bound of the sample)
ORDINARY_BYTES = 262144   # size of the ordinary dictionary
TOXIC_BYTES = 16384       # size of the toxic dictionary
WINDOW = 3                # words of a window
SPAN = 12                 # words that are compared before their windows are
LONG_WINDOW = 6           # words of a sample that trains the ordinary dictionary
SAMPLES = 400_000         # windows that train a dictionary, at most
HEAD = bytes(random.Random(7).randrange(97, 123) for _ in range(48))
TAIL = bytes([1, 2, 3, 4, 5, 6, 7, 8, 11, 12, 14, 15])
LEAST, MOST = -3, 9       # length differences, beyond which they count as these
BINS = MOST - LEAST + 1
BATCH = 4096              # windows compressed together

_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[bytes]:
    return [w.encode() for w in _WORD.findall((text or "").lower())]


def windows(words: list[bytes], size: int = WINDOW, stride: int = 1) -> list[bytes]:
    """Runs of ``size`` words, one every ``stride`` words (shorter ones at the end where the stride leaves some)."""
    if not words:
        return []
    text = b" " + b" ".join(words) + b" "
    at = list(accumulate(words, lambda i, w: i + len(w) + 1, initial=0))  # the space before each word
    last = max(len(words) - size, 0) + stride  # the run that holds the last word is there too
    return [text[at[i]:at[min(i + size, len(words))] + 1] for i in range(0, last, stride)]


@dataclass(frozen=True)
class Model:
    ordinary: bytes            # dictionary contents
    toxic: bytes
    weights: tuple[float, ...]  # intercept, one per difference, log of windows


def _parameters() -> zstandard.ZstdCompressionParameters:
    return zstandard.ZstdCompressionParameters(
        window_log=19, chain_log=17, hash_log=17, search_log=2, min_match=4, target_length=16,
        strategy=zstandard.STRATEGY_GREEDY, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        write_content_size=0, write_dict_id=0, write_checksum=0)


class Meter:
    """Length differences (ordinary minus toxic) of windows."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        p = _parameters()
        self._by = []
        for content in (ordinary + HEAD + TAIL, toxic + ordinary + HEAD + TAIL):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=p)
            self._by.append(zstandard.ZstdCompressor(dict_data=d, compression_params=p))

    def differences(self, found: list[bytes]) -> np.ndarray:
        out = [np.zeros(0, np.int64)]
        for at in range(0, len(found), BATCH):
            padded = [HEAD + w + TAIL for w in found[at:at + BATCH]]
            a, b = (np.fromiter(map(len, c.multi_compress_to_buffer(padded, threads=0)), np.int64, len(padded)) for c in self._by)
            out.append(a - b)
        return np.concatenate(out)

    def histogram(self, words: list[bytes]) -> np.ndarray:
        """How many windows have each length difference.

        Spans of ``SPAN`` words are compared first; they overlap, so that every window lies in one.  The
        windows of a span that the toxic side does not shorten count as no difference.
        """
        h, step = np.zeros(BINS), SPAN - WINDOW + 1
        if not words:
            return h
        shorter = np.flatnonzero(self.differences(windows(words, SPAN, step)) > 0)
        close = [w for i in shorter for w in windows(words[i * step:i * step + SPAN])]
        h += np.bincount(np.clip(self.differences(close), LEAST, MOST) - LEAST, minlength=BINS)
        h[-LEAST] += max(len(words) - WINDOW + 1, 1) - len(close)
        return h


def _features(h: np.ndarray) -> np.ndarray:
    """Intercept, log counts of each difference, log of all windows."""
    return np.concatenate([[1.0], np.log1p(h), [math.log1p(h.sum())]])


def dictionary(texts: list[list[bytes]], window: int, size: int) -> bytes | None:
    """The content of a dictionary trained on the texts' windows; None where zstandard finds too little to train on."""
    samples = [w for words in texts for w in windows(words, window, window)]
    random.Random(1).shuffle(samples)
    try:
        return zstandard.train_dictionary(size, samples[:SAMPLES]).as_bytes()
    except zstandard.ZstdError:
        return None


def fit(toxic: list[str], ordinary: list[str], toxic_share: float) -> Model | None:
    """Fit dictionaries on one half of the sample and the decision on the other."""
    if not toxic or not ordinary:
        return None
    if len(toxic) == 1 or len(ordinary) == 1:
        toxic, ordinary = toxic * 2, ordinary * 2
    t, o = [words_of(x) for x in toxic], [words_of(x) for x in ordinary]
    ht, ho = (len(t) + 1) // 2, (len(o) + 1) // 2
    tox_dict, ord_dict = dictionary(t[:ht], WINDOW, TOXIC_BYTES), dictionary(o[:ho], LONG_WINDOW, ORDINARY_BYTES)
    if tox_dict is None or ord_dict is None:
        return None
    meter = Meter(ord_dict, tox_dict)
    x = np.array([_features(meter.histogram(ws)) for ws in t[ht:] + o[ho:]])
    y = np.array([1.0] * (len(t) - ht) + [0.0] * (len(o) - ho))
    n1, n0 = max(1.0, y.sum()), max(1.0, (1 - y).sum())
    share = min(max(toxic_share, 1e-4), 1 - 1e-4)
    weight = np.where(y > 0, share / n1, (1 - share) / n0) * len(y)
    beta = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 0.3)
    ridge[0] = 1e-3
    for _ in range(60):  # iteratively reweighted least squares
        z = np.clip(x @ beta, -30, 30)
        p = 1 / (1 + np.exp(-z))
        s = np.maximum(p * (1 - p), 1e-9) * weight
        step = np.linalg.solve(x.T @ (x * s[:, None]) + np.diag(ridge), x.T @ (weight * (y - p)) - ridge * beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    # threshold of least weighted error among the midpoints of the sorted margins
    z = x @ beta
    order = np.argsort(z)
    zs, ws = z[order], (weight * np.where(y > 0, 1, -1))[order]
    err = np.concatenate([[weight[y == 0].sum()], weight[y == 0].sum() + np.cumsum(ws)])
    best = np.flatnonzero(err <= err.min() + 1e-9)
    lo, hi = best[0], best[-1]
    edge = np.concatenate([[zs[0] - 1], (zs[1:] + zs[:-1]) / 2, [zs[-1] + 1]])
    beta[0] -= (edge[lo] + edge[hi]) / 2
    return Model(ord_dict, tox_dict, tuple(float(b) for b in beta))


class Scorer:
    def __init__(self, model: Model):
        self._meter = Meter(model.ordinary, model.toxic)
        self._beta = np.array(model.weights)

    def __call__(self, text: str | None) -> float:
        words = words_of(text)
        z = float(_features(self._meter.histogram(words)) @ self._beta)
        p = 1 / (1 + math.exp(-min(max(z, -30), 30)))
        return p if words else min(p, 0.49)


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, per_class: int = PER_CLASS) -> Model | None:
    """Fit on at most ``per_class`` labelled rows of each class.

    ``usable`` filters the labels (by its doc_id) that may be learned from.
    The label table alone picks the sample; its ids are then looked up among
    the documents by a broadcast of at most 2 x per_class ids, so no text is
    shuffled.
    """
    known = labels.select("doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    if usable is not None:
        known = known.where(usable)
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = None
    for label in (0, 1):
        part = hashed_sample(known.where(F.col("toxic") == label).select("doc_id").distinct(), "doc_id", per_class, 4)
        part = part.withColumn("toxic", F.lit(label))
        picked = part if picked is None else picked.union(part)
    rows = (docs.select("doc_id", "text").where(F.col("text").isNotNull())
            .join(F.broadcast(picked), "doc_id")
            .groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
            .orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id", "toxic").collect())
    total = sum(counts.values())
    return fit([r.text for r in rows if r.toxic == 1], [r.text for r in rows if r.toxic == 0],
               counts.get(1, 0) / total if total else 0.0)


def score(df: DataFrame, model: Model | None, text_col: str = "text", out: str = "score") -> DataFrame:
    """Append the toxicity score (0 to 1) of every row's whole text."""
    if model is None:
        return df.withColumn(out, F.lit(0.0))
    sent = df.sparkSession.sparkContext.broadcast((model.ordinary, model.toxic, model.weights))  # under 1 MB
    version = hash(model)

    def run(texts: list) -> list[list[float]]:
        scorer = once("toxicity", version, lambda: Scorer(Model(*sent.value)))
        return [[scorer(t) for t in texts]]

    return add_columns(df, text_col, f"`{out}` double", run)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return id_remainder(doc_id, 5) == 0
