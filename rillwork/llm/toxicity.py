"""Toxicity: non-negative positive-unlabelled learning (Kiryo et al., 2017) on the words of a text.

The confirmed toxic texts and a sample of unlabelled ones train linear classifiers. The risk of the negative class is
what the unlabelled texts show less the class prior's share of the toxic ones; it is kept from going below zero.
A text's features are 64-bit hashes: of each lower-cased word that it holds, of each beginning of PREFIXES letters that
its words have, and of each such beginning that is dense in it (see ``feature_sets``), since insults are inflected and one that
stands alone in a long text may be chance. The FEATURES that tell the two sets apart best take part. The sample, hence what the
driver holds, is bounded by ``max_confirmed`` and ``max_unlabelled``; every whole text is scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.llm._shared import map_batches, materialize, read_table, with_default_columns

TOKEN = re.compile(r"\w+")
FEATURES, LEAST_TEXTS, SEED = 256, 3, 20241
PREFIXES = (3, 4, 5)
#: A beginning is dense where two words or more, and one of DENSE or more, have it.
DENSE = 128
#: Classifiers whose probabilities are averaged, each with its own share of the unlabelled texts.
MEMBERS = 3
#: Tokens hashed at once.
CHUNK = 1 << 17


def _tokens(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Rows and lower-cased words, about CHUNK at once; a text may come in several parts."""
    rows, words = [], []
    for i, t in enumerate(texts):
        for m in TOKEN.finditer(t or ""):
            words.append(m.group().lower())
            if len(words) == CHUNK:
                rows += [i] * (len(words) - len(rows))
                yield rows, words
                rows, words = [], []
        rows += [i] * (len(words) - len(rows))
    if words:
        yield rows, words


def _hashes(strings: list[str], length: int) -> np.ndarray:
    """Of words (length 0), or of their beginnings: even numbers, those of beginnings with the second bit set."""
    cut = [w[:length] for w in strings] if length else strings
    h = pd.util.hash_array(np.array(cut, dtype=object), categorize=False).astype(np.int64)
    return (h & ~3) + (2 if length else 0) ^ length << 56


def _collected(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, count), one of each row and feature, sorted."""
    row, feature, count = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((feature, row))
    row, feature, count = row[order], feature[order], count[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (feature[1:] != feature[:-1])
    starts = np.flatnonzero(new)
    return row[starts], feature[starts], np.add.reduceat(count, starts) if len(starts) else count


def feature_sets(texts: list[str | None], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) once for each feature of a row, sorted by row; of ``wanted`` (ascending) only, if given.

    An odd feature is the even one before it where that is dense: a beginning of two of the text's words or more, and of one in DENSE or more.
    """
    none = np.zeros(0, np.int64)
    parts, total = [(none, none, none)], np.zeros(len(texts), np.int64)
    followed = None if wanted is None else np.unique(wanted & ~1)
    for rows, words in _tokens(texts):
        row = np.array(rows, np.int64)
        total += np.bincount(row, minlength=len(texts))
        code, unique = pd.factorize(np.array(words, dtype=object))
        long, some = np.array([len(w) for w in unique]), []
        for length in (0, *PREFIXES):
            ids = _hashes(unique.tolist(), length)
            keep = long >= length if followed is None else (long >= length) & np.isin(ids, followed)
            at = keep[code]
            some.append((row[at], ids[code[at]], np.ones(int(at.sum()), np.int64)))
        parts.append(_collected(some))
    row, feature, count = _collected(parts)
    dense = (feature & 2 > 0) & (count >= 2) & (count * DENSE >= total[row])
    row, feature = np.concatenate([row, row[dense]]), np.concatenate([feature, feature[dense] | 1])
    keep = np.isin(feature, wanted) if wanted is not None else slice(None)
    row, feature = row[keep], feature[keep]
    order = np.lexsort((feature, row))
    return row[order], feature[order]


@dataclass
class Classifiers:
    """Linear classifiers: ``features`` ascend, ``weights`` is MEMBERS x features, ``bias`` one number a member."""

    features: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def score(self, texts: list[str | None]) -> np.ndarray:
        row, feature = feature_sets(texts, self.features)
        at = np.searchsorted(self.features, feature)
        logits = [np.bincount(row, weights=w[at], minlength=len(texts)) + b for w, b in zip(self.weights, self.bias, strict=True)]
        return np.mean([1 / (1 + np.exp(-np.clip(z, -40, 40))) for z in logits], axis=0)


class _Sets:
    """Rows of feature numbers, and sums over them."""

    def __init__(self, lists: list[np.ndarray]) -> None:
        self.n, self.ends = len(lists), np.cumsum([0, *(len(x) for x in lists)])
        self.at = np.concatenate([np.zeros(0, np.int64), *lists]).astype(np.int64)

    def pick(self, rows: np.ndarray) -> _Sets:
        return _Sets([self.at[self.ends[r] : self.ends[r + 1]] for r in rows])

    def logits(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self._rows(), weights=w[self.at], minlength=self.n)

    def back(self, g: np.ndarray, features: int) -> np.ndarray:
        return np.bincount(self.at, weights=g[self._rows()], minlength=features)

    def _rows(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.ends))


def risk_step(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """From logits: the non-negative risk under logistic loss, and the gradients by the logits of both sets.

    Where the negative class's risk falls below zero it counts as zero, and the step goes back up that part alone.
    """
    p, u = 1 / (1 + np.exp(-positive)), 1 / (1 + np.exp(-unlabelled))
    negative = np.logaddexp(0, unlabelled).mean() - prior * np.logaddexp(0, positive).mean()
    known = prior * np.logaddexp(0, -positive).mean()
    gp, gu = -prior * p / len(p), u / len(u)
    if negative < 0:
        return known, -gp, -gu
    return known + negative, gp + prior * (p - 1) / len(p), gu


def train(confirmed: list[np.ndarray], unlabelled: list[np.ndarray], features: int, prior: float, member: int, epochs: int = 300, rate: float = 0.05, decay: float = 2e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam; ``decay`` is a pull of the weights to zero. Without confirmed rows: never toxic."""
    w, b = np.zeros(features), np.log(prior / (1 - prior)) if 0 < prior < 1 else -40.0
    if not confirmed or not unlabelled or prior <= 0:
        return w, -40.0 if not confirmed or prior <= 0 else 40.0
    rng = np.random.default_rng(SEED + member)
    p = _Sets(confirmed)
    u = _Sets(unlabelled).pick(np.sort(rng.permutation(len(unlabelled))[: max(1, len(unlabelled) * 2 // 3)]))
    first, second = np.zeros(features + 1), np.zeros(features + 1)
    for t in range(1, epochs + 1):
        _, gp, gu = risk_step(p.logits(w) + b, u.logits(w) + b, prior)
        g = np.append(p.back(gp, features) + u.back(gu, features) + decay * w, gp.sum() + gu.sum())
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        move = rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def held_out(doc_id: str) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def _sample(docs: DataFrame, labels: DataFrame, max_confirmed: int, max_unlabelled: int) -> tuple[DataFrame, float]:
    """(doc_id, confirmed, unlabelled, features): the sample's texts, one a doc_id; and the labels' share of toxic documents."""
    labelled = with_default_columns(labels, doc_id="bigint", toxic="int").where("doc_id is not null and toxic is not null").where(~held_out("doc_id"))
    labelled = labelled.groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    share = labelled.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    ids = with_default_columns(docs, doc_id="bigint").where("doc_id is not null").where(~held_out("doc_id")).distinct()
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    confirmed = labelled.where("toxic").select("doc_id").orderBy(*by_hash).limit(max_confirmed).withColumn("confirmed", F.lit(True))
    unlabelled = ids.orderBy(*by_hash).limit(max_unlabelled).withColumn("unlabelled", F.lit(True))
    chosen = materialize(confirmed.join(unlabelled, "doc_id", "full").na.fill(False), "toxicity-ids")
    texts = with_default_columns(docs, doc_id="bigint", text="string").join(F.broadcast(chosen), "doc_id")

    def make():
        def step(c: dict) -> dict:
            row, feature = feature_sets(c["text"].to_pylist())
            ends = np.searchsorted(row, np.arange(1, len(c["text"]) + 1))
            return {n: c[n] for n in ("doc_id", "confirmed", "unlabelled")} | {"features": np.split(feature, ends[:-1])}

        return step

    sets = map_batches(texts, make, "doc_id bigint, confirmed boolean, unlabelled boolean, features array<bigint>")
    one = sets.groupBy("doc_id").agg(F.max("confirmed").alias("confirmed"), F.max("unlabelled").alias("unlabelled"), F.min("features").alias("features"))
    return materialize(one, "toxicity-sets"), share


def fit(docs: DataFrame, labels: DataFrame, prior: float | None = None, max_confirmed: int = 20000, max_unlabelled: int = 20000) -> Classifiers:
    """Classifiers from the documents that ``labels`` marks as toxic, outside the held-out fold, and unlabelled ones outside it.

    Of both the rows smallest by a hash of doc_id are taken, up to the maxima. ``prior`` is the class's share in all texts; None takes the labels' share.
    A doc_id with several labels counts with its largest, one with several texts with its least features; null ids and labels
    are not used. Without toxic labels nothing is toxic: every score is next to zero.
    """
    sets, share = _sample(docs, labels, max_confirmed, max_unlabelled)
    prior = min(0.99, share) if prior is None else prior
    sizes = sets.agg(F.sum(F.col("confirmed").cast("bigint")), F.sum(F.col("unlabelled").cast("bigint"))).first()
    n, m = sizes[0] or 0, sizes[1] or 0
    with_feature = sets.select("confirmed", "unlabelled", F.explode("features").alias("feature"))
    counts = with_feature.groupBy("feature").agg(F.sum(F.col("confirmed").cast("bigint")).alias("a"), F.sum(F.col("unlabelled").cast("bigint")).alias("b")).where(f"a + b >= {LEAST_TEXTS}")
    both = (F.col("a") + F.col("b") + 1) / F.lit(n + m + 2.0)
    apart = F.abs(F.col("a") / F.lit(max(n, 1)) - F.col("b") / F.lit(max(m, 1))) / F.sqrt(both * (1 - both))
    features = np.array(sorted(r.feature for r in counts.orderBy(apart.desc(), "feature").limit(FEATURES).collect()), np.int64)

    def make():
        def step(c: dict) -> dict:
            lists = [np.asarray(x, np.int64) for x in c["features"].to_pylist()]
            return {k: c[k] for k in ("doc_id", "confirmed", "unlabelled")} | {"at": [np.searchsorted(features, x[np.isin(x, features)]) for x in lists]}

        return step

    rows = map_batches(sets, make, "doc_id bigint, confirmed boolean, unlabelled boolean, at array<int>").orderBy("doc_id").collect()
    pick = lambda flag: [np.array(r["at"], np.int32) for r in rows if r[flag]]
    confirmed, unlabelled = pick("confirmed"), pick("unlabelled")
    fitted = [train(confirmed, unlabelled, len(features), prior, k) for k in range(MEMBERS)]
    return Classifiers(features, np.array([w for w, _ in fitted]).reshape(MEMBERS, -1), np.array([b for _, b in fitted]))


def score(docs: DataFrame, model: Classifiers, extra: tuple[str, ...] = ()) -> DataFrame:
    """docs -> (extra columns, __score): the probability that each whole text is toxic. A null text counts as empty;
    equal texts score alike; columns of any other name are left alone; an empty table gives an empty result."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*extra, F.col("text").cast("string").alias("__text"))

    def make():
        return lambda c: {n: c[n] for n in extra} | {"__score": shared.value.score(c["__text"].to_pylist())}

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "__text"]
    return map_batches(kept, make, ", ".join([*fields, "__score double"]))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of documents; repeated rows stay, a null doc_id has a null held_out."""
    docs = read_table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, read_table(spark, sf_dir, "labels")), ("doc_id",))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))
