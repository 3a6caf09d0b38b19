"""Language identification with language-bitmask n-gram filters.

Every language has a Bloom filter over the hashes of its frequent letter
n-grams.  The filters are stored bit-sliced: slot j of one table is a word
whose bit l says that language l's filter has bit j set.  Reading the k slots
of an n-gram and AND-ing them returns, at once, all languages that contain it.
A text's bits are counted per language; a language whose filter has a share
``fp`` of false positives is expected to answer ``n * fp`` times anyway, so its
count c is corrected to ``(c - n * fp) / (1 - fp)``.  The language with the
largest corrected count wins and ``score`` is its corrected count's share of
the n-grams.  N-grams are 3 letters long and span word edges (any run of
non-letters is one edge, one and two letter words included).

Fitting: at most ``per_lang`` labelled rows of each language (smallest id hash)
are counted in tasks, pre-aggregated per task; per language the ``grams`` most
frequent n-grams that reach ``min_share`` of its n-grams are collected.  The
table is ``slots`` words of 64 bits per 64 languages: fixed by parameters.
Prediction is one pass over the whole texts without a shuffle.

Defined results: null, empty and letterless texts give ``und`` with score 0;
ties go to the language first by code point; with no labelled row every text
is ``und``; repeated rows score alike; other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equilibra.llm.common import add_columns, id_remainder, once

PER_LANG = 1500
GRAMS = 6000
MIN_SHARE = 2e-5
SLOTS = 1 << 18
HASHES = 3
UND = "und"
CHUNK = 1 << 20  # characters handled at a time; a piece sees one character of each neighbour

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _letters() -> np.ndarray:
    return once("letters", 0, lambda: np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _M2
    return (h ^ (h >> np.uint64(29))) * _M3


def grams(codes: np.ndarray) -> np.ndarray:
    """Hashes of the letter 3-grams of a code point array; non-letters separate words."""
    ok = _letters()[codes]
    c = np.where(ok, codes, np.uint32(32)).astype(np.uint64)
    keep = ok.copy()
    keep[1:] |= ok[:-1]           # one edge after each word
    c = c[keep]
    if not len(c):
        return np.zeros(0, dtype=np.uint64)
    c = np.concatenate([[np.uint64(32)], c, [np.uint64(32)]])
    packed = (c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:]
    return _mix(packed[c[1:-1] != 32] * _M1)  # the middle of an n-gram is a letter


def _slots(h: np.ndarray, slots: int, hashes: int) -> list[np.ndarray]:
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(i) * step) % np.uint64(slots)).astype(np.int64) for i in range(hashes)]


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    table: np.ndarray            # (words of 64 languages, slots)
    false_share: np.ndarray      # per language
    hashes: int


def build(sets: dict[str, np.ndarray], slots: int = SLOTS, hashes: int = HASHES) -> Model | None:
    """Bit-sliced filters from each language's n-gram hashes."""
    names = sorted(sets)
    if not names:
        return None
    table = np.zeros(((len(names) + 63) // 64, slots), dtype=np.uint64)
    for i, name in enumerate(names):
        for at in _slots(sets[name].astype(np.uint64), slots, hashes):
            table[i // 64, at] |= np.uint64(1 << (i % 64))
    fill = np.array([((table[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(names))])
    return Model(tuple(names), table, np.minimum(fill ** hashes, 0.999), hashes)


def languages_of(model: Model, h: np.ndarray) -> np.ndarray:
    """Per n-gram the bitmask of all languages whose filter contains it, (words, n)."""
    out = None
    for at in _slots(h, model.table.shape[1], model.hashes):
        got = model.table[:, at]
        out = got if out is None else out & got
    return out


def decide(model: Model, text: str | None) -> tuple[str, float]:
    if not text:
        return UND, 0.0
    text = text.lower()
    counts, n = np.zeros(len(model.languages)), 0
    for at in range(0, len(text), CHUNK):
        piece = text[max(0, at - 1):at + CHUNK + 1]
        h = grams(_codes(piece))
        # a neighbour's letter is the middle of an n-gram of its own piece
        h = h[int(at > 0 and piece[0].isalpha()):len(h) - int(at + CHUNK < len(text) and piece[-1].isalpha())]
        n += len(h)
        masks = languages_of(model, h)
        for i in range(len(model.languages)):
            counts[i] += int(((masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).sum())
    if not n:
        return UND, 0.0
    corrected = np.clip((counts - n * model.false_share) / (1 - model.false_share), 0, n)
    best = int(corrected.argmax())
    return model.languages[best], float(corrected[best] / n)


def train(docs: DataFrame, usable: Column | None = None, per_lang: int = PER_LANG, grams_kept: int = GRAMS,
          min_share: float = MIN_SHARE, slots: int = SLOTS, hashes: int = HASHES) -> Model | None:
    """Learn from ``text`` and non-null ``lang`` of the rows that pass ``usable``."""
    rows = docs.select("doc_id", "text", "lang")
    if usable is not None:
        rows = rows.where(usable)
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    seen = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    # keep per_lang rows of each language in expectation: a hash threshold per language
    key = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 40))
    cut = seen.select("lang", (F.least(F.lit(1.0), F.lit(float(per_lang)) / F.col("n")) * (1 << 40)).alias("cut"))
    picked = rows.join(F.broadcast(cut), "lang").where(key < F.col("cut")).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[np.ndarray]] = {}
        sizes: dict[str, int] = {}

        def flush(lang: str) -> pd.DataFrame:
            h, n = np.unique(np.concatenate(held.pop(lang)), return_counts=True)
            sizes[lang] = 0
            return pd.DataFrame({"lang": lang, "gram": h.view(np.int64), "n": n})

        for b in batches:
            for lang, text in zip(b["lang"], b["text"]):
                h = grams(_codes(text))
                held.setdefault(lang, []).append(h)
                sizes[lang] = sizes.get(lang, 0) + len(h)
                if sizes[lang] > 4_000_000:
                    yield flush(lang)
        for lang in list(held):
            yield flush(lang)

    total = picked.mapInPandas(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    total = total.join(total.groupBy("lang").agg(F.sum("n").alias("all")), "lang")
    total = total.where(F.col("n") >= F.greatest(F.lit(1.0), F.col("all") * F.lit(min_share)))
    # at most 1 / min_share n-grams per language can pass, so this collect is bounded
    got = total.select("lang", "gram", "n").toPandas()
    sets = {lang: part.sort_values(["n", "gram"], ascending=[False, True])["gram"].to_numpy(dtype=np.int64).view(np.uint64)[:grams_kept]
            for lang, part in got.groupby("lang")}
    return build(sets, slots, hashes)


def predict(df: DataFrame, model: Model | None, text_col: str = "text", lang_out: str = "lang_pred",
            score_out: str = "score") -> DataFrame:
    """Append the predicted language and its score for every row's whole text."""
    if model is None:
        return df.withColumn(lang_out, F.lit(UND)).withColumn(score_out, F.lit(0.0))
    # slots x 8 bytes per 64 languages, sent as plain values
    sent = df.sparkSession.sparkContext.broadcast((model.languages, model.table, model.false_share, model.hashes))

    def run(texts: list) -> list[list]:
        here = Model(*sent.value)
        got = [decide(here, t) for t in texts]
        return [[g[0] for g in got], [g[1] for g in got]]

    return add_columns(df, text_col, f"`{lang_out}` string, `{score_out}` double", run)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return id_remainder(doc_id, 3) == 1
