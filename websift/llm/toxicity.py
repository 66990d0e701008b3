"""Toxicity scores from confirmed toxic examples and unlabelled text: non-negative positive-unlabelled learning.

Negative labels are never used as examples.  With class prior p, the risk of a classifier g is
``p E_toxic[l(g, 1)] + max(0, E_all[l(g, 0)] - p E_toxic[l(g, 1 -> 0)])``: unlabelled text stands for the clean text
after its toxic share is taken away, and where that estimate turns negative (over-fitting) the step is reversed.

Features are words (runs of letters, lower case) and the beginnings of words (``PREFIXES`` bytes, for inflected and
compound forms) present in a text.  The fit uses at most ``MAX_TOXIC`` confirmed toxic texts, in a fixed random order
(a documented bound, so that their ids can be broadcast and no text is shuffled).  Candidates are the features that at
least ``MIN_SHARE`` of them hold; each is then counted over all documents, and those that tell the two apart best are
used.  The classifier is fitted on these texts and about ``MAX_UNLABELLED`` others (only the presence of the features
is gathered), and scores every whole text.

The class prior is the share of toxic texts among all texts, which the share among the labelled rows need not be near.
It is estimated from unlabelled text: whatever toxic texts have, all texts have at least prior times as often, so the
least ratio of both shares, over thresholds of a likelihood ratio, bounds the prior and meets it where clean texts
hardly reach the threshold.

Defined results: rows are held out when crc32 of doc_id as text is divisible by ``FOLDS`` (null doc_ids are not);
null, empty and blank texts have no words and get the score of the intercept; repeated labels count once; without a
toxic training text all scores are 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .shingles import _P, _powers, mix

FOLDS = 5
MIN_TEXTS, MIN_SHARE = 5, 0.01
CANDIDATES, FEATURES = 65_536, 512
PREFIXES = (4, 5, 6)
#: A feature's share among toxic texts must differ from its share everywhere by so many standard deviations.
MIN_DEVIATIONS = 4
MAX_TOXIC, MAX_UNLABELLED = 5000, 20_000
#: Texts of each kind in a step; small batches would make the risk of clean text negative by chance.
STEPS, BATCH, RATE, PENALTY = 1500, 2048, 0.03, 1e-5
#: The weights are averaged over so many of the last steps.
AVERAGED = 500
#: Thresholds that fewer toxic texts reach say too little about the prior.
MIN_REACHED = 0.2

# letters of ASCII in lower case, bytes of other letters as they are, 0 for all that separates words
_LETTER = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], dtype=np.uint8)


def features(texts, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature): the distinct features of each text as 64-bit hashes, ordered by text; with ``known`` (sorted),
    only those in it, as their positions there."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    buf = _LETTER[np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)]
    change = np.diff(np.concatenate(([False], buf > 0)).astype(np.int8))
    start, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    running = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(buf.astype(np.uint64) * _powers(_P, len(buf)), dtype=np.uint64)))
    back = _powers(pow(_P, -1, 1 << 64), len(buf))
    in_text = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), start, side="right")
    pick, text, kind = (None if known is None else _filter(known)), [], []
    for n in (0, *PREFIXES):
        long = np.flatnonzero(end - start > n) if n else np.arange(len(start))
        s, e = start[long], (start[long] + n if n else end[long])
        h = mix((running[e] - running[s]) * back[s] + (e - s).astype(np.uint64) + np.uint64(n << 32)).view(np.int64)
        t = in_text[long]
        if pick is not None:
            maybe = pick[h & 0xFFFF]
            at = _positions(known, h[maybe])
            t, h = t[maybe][at >= 0], at[at >= 0]
        text.append(t)
        kind.append(h)
    text, kind = np.concatenate(text), np.concatenate(kind)
    order = np.lexsort((kind, text))
    text, kind = text[order], kind[order]
    new = np.ones(len(kind), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (kind[1:] != kind[:-1])
    return text[new], kind[new]


def _filter(known: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 16, dtype=bool)
    out[known & 0xFFFF] = True
    return out


def _positions(known: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Index of each feature in the sorted array ``known``, or -1."""
    if not len(known):
        return np.full(len(kind), -1)
    at = np.minimum(np.searchsorted(known, kind), len(known) - 1)
    return np.where(known[at] == kind, at, -1)


def _count_words(df: DataFrame, known: np.ndarray | None = None) -> DataFrame:
    """(word, n): number of texts that hold each word (of ``known``, if given); counted in tasks before the shuffle."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = pd.Series(dtype=np.int64)
        for b in batches:
            word = features(b["text"], known)[1]
            if known is not None:
                word = known[word]
            found, n = np.unique(word, return_counts=True)
            total = total.add(pd.Series(n, index=found), fill_value=0)
            if len(total) > 500_000:
                yield pd.DataFrame({"word": total.index.astype(np.int64), "n": total.to_numpy().astype(np.int64)})
                total = pd.Series(dtype=np.int64)
        yield pd.DataFrame({"word": total.index.astype(np.int64), "n": total.to_numpy().astype(np.int64)})
    return df.select("text").mapInPandas(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _presence(df: DataFrame, known: np.ndarray) -> list[list[int]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text, at = features(b["text"], known)
            cuts = np.searchsorted(text, np.arange(len(b) + 1))
            yield pd.DataFrame({"at": [at[i:j].tolist() for i, j in zip(cuts[:-1], cuts[1:])]})
    return [r["at"] for r in df.select("text").mapInPandas(run, "at array<int>").collect()]


def _matrix(rows: list[list[int]], n: int) -> np.ndarray:
    x = np.zeros((len(rows), n), dtype=np.float32)
    for k, r in enumerate(rows):
        x[k, r] = 1
    return x


def class_prior(toxic: np.ndarray, unlabelled: np.ndarray) -> float:
    """Estimated share of toxic texts among the unlabelled ones, from the presence of features (rows x features)."""
    p, u = ((x.sum(axis=0) + 0.5) / (len(x) + 1) for x in (toxic, unlabelled))
    ratio = np.maximum(0, np.log(p / u))
    of_toxic, of_all = np.sort(toxic @ ratio), np.sort(unlabelled @ ratio)
    at = np.unique(of_toxic)
    reached, everywhere = (1 - np.searchsorted(x, at) / len(x) for x in (of_toxic, of_all))
    at_most = (everywhere + np.sqrt(everywhere * (1 - everywhere) / len(of_all))) / reached  # one standard deviation more
    return float(np.clip(at_most[reached >= MIN_REACHED].min(), 0.001, 0.9))


def fit_nnpu(toxic: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 3) -> tuple[np.ndarray, float]:
    """(weights, intercept) of a logistic model under the non-negative risk, by Adam on mini-batches."""
    rng = np.random.default_rng(seed)
    w = np.zeros(toxic.shape[1] + 1, dtype=np.float32)
    w[-1] = np.log(prior / (1 - prior))
    m, v, mean = np.zeros_like(w), np.zeros_like(w), np.zeros(len(w))
    toxic, unlabelled = (np.hstack([x, np.ones((len(x), 1), dtype=np.float32)]) for x in (toxic, unlabelled))

    def sigmoid(z):
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def batch(x):
        return x if len(x) <= BATCH else x[rng.integers(0, len(x), BATCH)]

    for t in range(1, STEPS + 1):
        p, u = batch(toxic), batch(unlabelled)
        sp, su = sigmoid(p @ w), sigmoid(u @ w)
        as_clean_u, as_clean_p = -np.log(1 - su + 1e-9).mean(), -np.log(1 - sp + 1e-9).mean()
        grad = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
        grad = grad - prior * (p.T @ (1 - sp)) / len(p) if as_clean_u >= prior * as_clean_p else -grad
        grad[:-1] += PENALTY * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        w -= RATE * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        if t > STEPS - AVERAGED:
            mean += w / AVERAGED
    return mean[:-1], float(mean[-1])


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float] | None:
    """(words, weights, intercept), or None without toxic training texts.  ``docs``: doc_id, text; ``labels``: doc_id, toxic."""
    learn = labels.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != 0) & F.col("toxic").isNotNull())
    per_doc = learn.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.lit("nnpu"), "doc_id")  # a fixed random order
    chosen = per_doc.where("toxic = 1").orderBy(order, "doc_id").limit(MAX_TOXIC).select("doc_id")
    # at most MAX_TOXIC ids: the texts of all documents stay where they are
    toxic = cut(docs.join(F.broadcast(chosen), "doc_id", "left_semi"), "toxic")
    n_toxic, n_all = toxic.count(), docs.count()
    if not n_toxic:
        return None
    least = max(min(MIN_TEXTS, n_toxic), MIN_SHARE * n_toxic)
    held = {r["word"]: r["n"] for r in _count_words(toxic).where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(CANDIDATES).collect()}
    known = np.array(sorted(held), dtype=np.int64)
    everywhere = {r["word"]: r["n"] for r in _count_words(docs, known).collect()}  # at most CANDIDATES rows
    p = np.array([held[x] for x in known.tolist()]) / n_toxic
    u = np.array([everywhere.get(x, 0) for x in known.tolist()]) / max(1, n_all)
    smooth = 0.5 / n_toxic
    gain = np.abs((p - u) * np.log((p + smooth) / (u + smooth)))
    gain[np.abs(p - u) < MIN_DEVIATIONS * np.sqrt((u + smooth) / n_toxic)] = 0  # may be chance
    best = np.argsort(-gain, kind="stable")[:FEATURES]
    known = np.sort(known[best[gain[best] > 0]])
    # bounded samples, the same on every run
    part = F.pmod(order, F.lit(1_000_000)) / 1_000_000
    some_toxic = _matrix(_presence(toxic.where(part < MAX_TOXIC / n_toxic), known), len(known))
    some = _matrix(_presence(docs.where(part < MAX_UNLABELLED / n_all), known), len(known))
    if not len(some_toxic) or not len(some):
        return None
    weights, intercept = fit_nnpu(some_toxic, some, class_prior(some_toxic, some))
    return known, weights, intercept


def score(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from 0.5 on) for every row of ``df``."""
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    model = train(docs, labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("toxic")))

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        if model is None:
            return pd.Series(np.zeros(len(texts)))
        known, weights, intercept = model
        of, at = features(texts, known)
        z = intercept + np.bincount(of, weights=weights[at], minlength=len(texts))
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))
    out = docs.select("doc_id", held_out.alias("held_out"), run("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
