"""Quality classifier by positive-unlabelled learning.

A linear model on style features is trained by minimising the non-negative unbiased risk of Kiryo et al. (2017):
with class prior p, positives P, unlabelled U and the logistic loss l,

    p E_P[l(x, +1)] + max(0, E_U[l(x, -1)] - p E_P[l(x, -1)])

Trusted positives are learning rows of label 1; unlabelled web text is every learning row, whatever its label, so that
the prior holds for it.
The prior is estimated from positives and unlabelled text alone, labelled negatives aren't looked at: a model is fitted on half of the
rows, and of the other half the shares of unlabelled and of positive rows that score above a threshold are compared. Where the best
scores are those of positives only, their ratio is the prior; the threshold is the one with the least upper confidence bound
(best bin estimation, Garg et al. 2021).

Features are of form, not of vocabulary: shares of pairs of byte classes (letters, upper case, digits, each kind of
punctuation, white space ...), of word lengths, of repeated words, and the text's length. Scores use nothing else.
The fit is on the driver over at most ``FIT_ROWS`` feature rows of each set; every text is scored, as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Sealed, mapped, release, single, steps, utf8
from .words import PART, Words

#: Most rows of each of the two sets that the model is fitted on: those with the least hash of the key.
FIT_ROWS = 10_000
#: Byte classes: 0 other, 1 a-z, 2 A-Z, 3 beyond ASCII, 4 digits, 5 blank, 6 line ends and tabs, then one for each common mark.
MARKS = b".,;:!?'\"()[]{}<>|/\\$%&*#@+-=_~"
CLASS = np.zeros(256, np.int64)
CLASS[97:123], CLASS[65:91], CLASS[128:], CLASS[48:58], CLASS[32] = 1, 2, 3, 4, 5
CLASS[[9, 10, 11, 12, 13]] = 6
for _i, _c in enumerate(MARKS):
    CLASS[_c] = 7 + _i
CLASSES = 7 + len(MARKS)
LENGTHS = 16
WIDTH = CLASSES + 8 * 8 + LENGTHS + 5


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of style features for each text; an empty text has zeros but for the last, a constant.

    Bytes and words are counted ``PART`` at a time, with the byte or word before, so a text of any length is counted as a whole.
    """
    n = len(offsets) - 1
    size = np.diff(offsets)
    chars, pairs = np.zeros(n * CLASSES, np.int64), np.zeros(n * 64, np.int64)
    for a in range(0, len(raw), PART):
        low, high = max(a - 1, 0), min(a + PART, len(raw))
        kind = CLASS[raw[low:high]]
        doc = np.repeat(np.arange(n), np.diff(np.clip(offsets, low, high)))
        chars += np.bincount((doc * CLASSES + kind)[a - low :], minlength=n * CLASSES)
        coarse = np.minimum(kind, 7)
        same = doc[:-1] == doc[1:]
        pairs += np.bincount((doc[:-1] * 64 + coarse[:-1] * 8 + coarse[1:])[same], minlength=n * 64)
    words = Words(raw, offsets)
    lengths, again, distinct = np.zeros(n * LENGTHS, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    seen = np.zeros(0, np.uint64)  # words so far of the text that a part ends in
    seen_of = -1
    for low, high, first in words.parts(1):
        doc, hashes = np.repeat(np.arange(n), np.diff(first)), words.hash[low:high]
        fresh = slice(int(low > 0), None)  # the first is of the part before
        lengths += np.bincount((doc * LENGTHS + np.minimum(words.end[low:high] - words.start[low:high], LENGTHS) - 1)[fresh], minlength=n * LENGTHS)
        again += np.bincount(doc[1:][(hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])], minlength=n)
        doc, hashes = doc[fresh], hashes[fresh]
        order = np.lexsort((hashes, doc))
        hashes, doc = hashes[order], doc[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
        hashes, doc = hashes[new], doc[new]
        if len(doc) and doc[0] == seen_of:
            known = np.isin(hashes, seen) & (doc == seen_of)
        else:
            known, seen = np.zeros(len(doc), bool), seen[:0]
        distinct += np.bincount(doc[~known], minlength=n)
        if len(doc):
            mine = hashes[~known & (doc == doc[-1])]
            seen, seen_of = (np.concatenate([seen, mine]) if doc[-1] == seen_of else mine), doc[-1]
    count = np.diff(words.first)
    some, whole = np.maximum(count, 1), np.maximum(size, 1)[:, None]
    out = np.zeros((n, WIDTH))
    at = CLASSES + 64 + LENGTHS
    out[:, :CLASSES], out[:, CLASSES : CLASSES + 64] = chars.reshape(n, CLASSES) / whole, pairs.reshape(n, 64) / whole
    out[:, CLASSES + 64 : at] = lengths.reshape(n, LENGTHS) / some[:, None]
    out[:, at] = again / some
    out[:, at + 1] = distinct / np.sqrt(some) / 30
    out[:, at + 2] = np.log1p(size) / 12
    out[:, at + 3] = count == 0
    out[:, at + 4] = 1
    return out


def nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, *, rounds: int = 600, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    """Weights of the linear model by full-batch Adam; where the estimated negative risk is below zero, its gradient is turned round."""
    w = np.zeros(positive.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    loss = lambda z: np.logaddexp(0, -z)
    for step in range(1, rounds + 1):
        zp, zu = positive @ w, unlabelled @ w
        up = -(prior / len(zp)) * (positive.T @ sigmoid(-zp))
        down = unlabelled.T @ sigmoid(zu) / len(zu) - (prior / len(zp)) * (positive.T @ sigmoid(zp))
        negative = loss(-zu).mean() - prior * loss(-zp).mean()
        g = (up + down if negative >= 0 else -down) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, half_p: np.ndarray, half_u: np.ndarray, *, delta: float = 0.1, gamma: float = 0.01) -> float:
    """Share of positives among unlabelled rows. A model learns from the rows of the given halves; the others are compared."""
    w = nnpu(positive[half_p], unlabelled[half_u], 0.5)
    p, u = np.sort(positive[~half_p] @ w), np.sort(unlabelled[~half_u] @ w)
    if not len(p) or not len(u):
        return 0.5
    cut = np.unique(p)
    above_p, above_u = 1 - np.searchsorted(p, cut) / len(p), 1 - np.searchsorted(u, cut) / len(u)
    slack = (1 + gamma) * sum(np.sqrt(np.log(4 / delta) / (2 * len(x))) for x in (p, u))
    best = int(np.argmin((above_u + slack) / above_p))
    return float(np.clip(above_u[best] / above_p[best], 0.01, 0.99))


class Model:
    """Scales features and scores them."""

    def __init__(self, x: np.ndarray, is_positive: np.ndarray, is_unlabelled: np.ndarray):
        positive, unlabelled = x[is_positive], x[is_unlabelled]
        both = np.concatenate([positive, unlabelled])
        self.mean, self.scale = both.mean(0), both.std(0)
        self.mean[-1], self.scale[self.scale < 1e-9], self.scale[-1] = 0, 1, 1
        half = np.arange(len(x)) % 2 == 0
        positive, unlabelled = self.scaled(positive), self.scaled(unlabelled)
        self.prior = estimate_prior(positive, unlabelled, half[is_positive], half[is_unlabelled])
        self.w = nnpu(positive, unlabelled, self.prior)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scaled(x) @ self.w, -50, 50)))


def _mapped(docs: DataFrame, text: str, new: T.StructField, kind: pa.DataType, f) -> DataFrame:
    """``docs`` with a column that f(bytes, offsets) gives for some texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(single(batch, text))
            parts = [f(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in steps(offsets)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for p in parts for x in p], kind)], names=[*batch.schema.names, new.name])

    return mapped(docs, run, T.StructType([*docs.schema.fields, new]))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, *, key: str = "doc_id", text: str = "text", label: str = "quality", fit_rows: int = FIT_ROWS) -> Model | None:
    """The model, or None if no learning row has label 1.

    Labels are joined by key; of several for one key the largest counts, null ones don't. Rows with a null key are unlabelled.
    Samples are of keys, by hash; of their rows, which are about as many, at most 4 x ``fit_rows`` are taken, by a hash of key and text.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("_id")).agg((F.max(label) == 1).cast("int").alias("_y"))
    keys = docs.where(learn).select(F.col(key).alias("_id"), F.xxhash64(F.lit(3), F.col(key)).alias("_hash"))
    keys = keys.join(known, "_id", "left")
    facts = keys.agg(F.coalesce(F.sum("_y"), F.lit(0)).alias("positive"), F.count("*").alias("all")).first()
    if not facts["positive"]:
        return None

    # Bounded samples: the rows whose hash is under a limit that lets some fit_rows through.
    def some(n: int) -> Column:
        share = min(1.0, fit_rows / max(n, 1))
        return F.pmod("_hash", F.lit(1 << 30)) < int(share * (1 << 30))

    positive = F.coalesce(F.col("_y") == 1, F.lit(False))
    chosen = keys.select("_id", (positive & some(facts["positive"])).alias("_p"), some(facts["all"]).alias("_u"))
    chosen = chosen.where(F.col("_p") | F.col("_u")).distinct()  # some 2 x fit_rows rows
    rows = docs.where(learn).select(F.col(key).alias("_key"), F.col(text).alias("_t"), F.xxhash64(F.lit(4), F.col(key), F.col(text)).alias("_r"))
    texts = rows.join(F.broadcast(chosen), F.col("_key").eqNullSafe(F.col("_id"))).select("_p", "_u", "_t", "_r")
    vectors = _mapped(texts, "_t", T.StructField("_x", T.ArrayType(T.FloatType())), pa.list_(pa.float32()), lambda raw, offsets: list(features(raw, offsets).astype(np.float32)))
    # a key that stands in very many rows doesn't bring all of them here
    table = vectors.orderBy("_r").limit(4 * fit_rows).select("_p", "_u", "_x").toArrow()
    x = column(table, "_x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, WIDTH)
    p, u = (column(table, c).to_numpy(zero_copy_only=False).astype(bool) for c in ("_p", "_u"))
    if not p.any() or not u.any():
        return None
    order = np.lexsort(x.T)  # the same model whatever the order in which rows arrive
    model = Model(x[order], p[order], u[order])
    del table, x
    release()  # this is the driver, which stays
    return model


def column(table: pa.Table, name: str) -> pa.Array:
    """A column in one piece; values stay in Arrow's memory, since as Python's objects they take some ten times that of the driver."""
    return pa.concat_arrays(table[name].chunks) if table.num_rows else pa.array([], table.schema.field(name).type)


def score(docs: DataFrame, model: Model | None, *, text: str = "text", score: str = "_score") -> DataFrame:
    """``docs`` with a score in [0, 1] for each whole text, higher where label 1 is likelier.

    A null text is scored as an empty one. Without a model every score is 0.5. A column named ``score`` is replaced.
    """
    sealed = Sealed(docs, score)
    if model is None:
        return sealed.open(sealed.df, **{score: F.lit(0.5)})
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = _mapped(sealed.df, sealed[text], T.StructField("_score", T.DoubleType()), pa.float64(), lambda raw, offsets: shared.value.score(features(raw, offsets)))
    return sealed.open(scored, **{score: F.col("_score")})
