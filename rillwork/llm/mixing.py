"""Mixing to target weights by soft membership, with DataFrame functions only.

A naive Bayes classifier over hashed words is counted from the rows of a labelled table; it gives every
document posteriors over the domains. Document rates r >= ``min_rate`` then solve the least squares
(A r - T)' (G + e)^-1 (A r - T) with A r = sum_i r_i n_i p_i, n being tokens, T targets, G the posteriors' Gram matrix and e
a thousandth of its mean diagonal, by projected gradient from r = 1. In that metric (and the documents' token
counts as theirs) a step of 1 never raises the loss and is all but exact while no rate is at its bound: targets by language
take two or three rounds. A rate depends on the document's posteriors and the
steps of the rounds so far (one number per domain and round), so a round is one aggregation and no state is
kept per document. Rounds end where the targets are met, where a round gains next to nothing (they can't be
met), or after ROUNDS; in the latter two cases a warning is given. The miss is a column of the result.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.llm._shared import by_bitmaps, materialize, read_table, with_default_columns

#: Word buckets; words of evidence that a text counts for at most; rounds; largest relative residual; least relative gain of a round.
BUCKETS, EVIDENCE, ROUNDS, TOLERANCE, GAIN = 2048, 32, 100, 1e-3, 1e-4
#: Production targets: shares of expected tokens by language. (Texts don't tell their source; the README has figures.)
TARGETS = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}


def words(text: Column) -> Column:
    """Lower-cased words between white space; none for a null or blank text."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0d]+"), lambda w: w != "")


def buckets(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.pmod(F.hash(w), F.lit(BUCKETS)).cast("int"))


def _numbers(values) -> Column:
    """A constant array of doubles, folded to a literal when the plan is optimized."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def _total(tokens: Column, table: Column) -> Column:
    return F.aggregate(tokens, F.lit(0.0), lambda acc, t: acc + F.get(table, t))


@dataclass
class Classifier:
    """log p(bucket | domain) (domains x BUCKETS) and log priors."""

    domains: list[str]
    likelihood: np.ndarray
    prior: np.ndarray

    def posteriors(self, rows: DataFrame) -> DataFrame:
        """rows(b: buckets, ...) -> (..., n: tokens, p: array<double> over the domains) without b.

        Evidence beyond EVIDENCE words is averaged; without words p is the prior. Each step is a
        projection of its own, so that no score is computed twice.
        """
        k = range(len(self.domains))
        scale = F.least(F.col("n"), F.lit(EVIDENCE)) / F.greatest(F.col("n"), F.lit(1))
        out = rows.withColumns({"n": F.size("b")} | {f"__s{i}": _total(F.col("b"), _numbers(self.likelihood[i])) for i in k}).drop("b")
        out = out.withColumns({f"__s{i}": F.col(f"__s{i}") * scale + F.lit(float(self.prior[i])) for i in k})
        out = out.withColumns({f"__e{i}": F.exp(F.col(f"__s{i}") - (F.greatest(*(F.col(f"__s{j}") for j in k)) if len(k) > 1 else F.col("__s0"))) for i in k})
        total = sum((F.col(f"__e{i}") for i in k[1:]), F.col("__e0"))
        return out.withColumn("p", F.array(*(F.col(f"__e{i}") / total for i in k))).drop(*(f"__{c}{i}" for c in "se" for i in k))


def fit_classifier(labelled: DataFrame, domains: list[str]) -> Classifier:
    """labelled(text, domain): counts over all rows whose domain is listed; smoothed by one."""
    rows = labelled.where(F.col("domain").isin(*domains)).select("domain", F.explode(buckets(F.col("text"))).alias("bucket"))
    counts = np.ones((len(domains), BUCKETS))
    for r in rows.groupBy("domain", "bucket").count().collect():  # len(domains) x BUCKETS rows at most
        counts[domains.index(r["domain"]), r["bucket"]] += r["count"]
    total = counts.sum(axis=1)
    return Classifier(domains, np.log(counts / total[:, None]), np.log(total / total.sum()))


def _rates(p: Column, history: list[np.ndarray], n: int, min_rate: float) -> Column:
    if not history:
        return F.lit(max(1.0, min_rate))
    rounds = _numbers(np.concatenate(history))
    step = lambda r, i: F.greatest(F.lit(min_rate), r - sum((p[k] * F.get(rounds, i * n + k) for k in range(n)), F.lit(0.0)))
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(history) - 1)), F.lit(max(1.0, min_rate)), step)


def _inverse(row, k: int) -> np.ndarray:
    gram = np.array([[row[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    return np.linalg.inv(gram + np.eye(k) * 1e-3 * np.trace(gram) / k)


@dataclass
class Fit:
    """The steps that determine the rates, the largest miss as a share of the total, and whether it is within TOLERANCE."""

    history: list[np.ndarray]
    missed: float = 0.0
    met: bool = True


def fit_rates(rows: DataFrame, weights: dict[str, float], min_rate: float = 0.0, total: float | None = None) -> Fit:
    """rows(n, p): the rates' steps. ``total`` tokens default to the supply,
    or with min_rate > 0 to the least total at which no domain has to shrink below it."""
    k = len(weights)
    share = np.array(list(weights.values()), float)
    share /= share.sum()
    n, p = F.col("n").cast("double"), F.col("p")
    gram = rows.agg(*(F.sum(n * p[i]).alias(f"s{i}") for i in range(k)), *(F.sum(n * p[i] * p[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k))).first()
    supply = np.array([gram[f"s{i}"] or 0.0 for i in range(k)])
    if not supply.sum():
        return Fit([])
    inverse = _inverse(gram, k)
    if total is None:
        total = float((supply / share).max()) * min_rate if min_rate else float(supply.sum())
    fit, before = Fit([]), np.inf
    for _ in range(ROUNDS):
        got = rows.agg(*(F.sum(_rates(p, fit.history, k, min_rate) * n * p[i]).alias(f"t{i}") for i in range(k))).first()
        miss = np.array([got[f"t{i}"] or 0.0 for i in range(k)]) - share * total
        fit.missed, loss = float(np.abs(miss).max() / total), float(miss @ inverse @ miss)
        fit.met = fit.missed <= TOLERANCE
        if fit.met:
            return fit
        if loss >= before * (1 - GAIN) or len(fit.history) == ROUNDS - 1:
            break
        before = loss
        fit.history.append(inverse @ miss)
    warnings.warn(f"after {len(fit.history)} rounds the targets are missed by up to {fit.missed:.4f} of the total", stacklevel=2)
    return fit


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], min_rate: float = 0.0, keys: tuple[str, ...] = ("doc_id",), total: float | None = None) -> DataFrame:
    """docs(text, keys) -> keys, n (tokens), p (posteriors in the order of ``weights``), rate, copies, missed.

    A null or blank text has no tokens, the prior as posteriors and a rate like any other. Repeated rows are
    rows of their own, with equal rates and copies; an empty table gives no rows. Without labelled rows all posteriors are equal.
    ``copies`` rounds the rate down or up by a hash of the keys, so its expectation is the rate. ``missed`` is the
    largest miss of a target as a share of the total, the same in every row.
    """
    model = fit_classifier(labelled, list(weights))
    tokens = docs.select(*keys, buckets(F.col("text").cast("string")).alias("b"))
    rows = materialize(model.posteriors(tokens), "posteriors")
    fit = fit_rates(rows, weights, min_rate, total)
    u = F.shiftrightunsigned(F.xxhash64(*keys, F.lit(29)), 11) * F.lit(2.0**-53)
    rated = rows.withColumn("rate", _rates(F.col("p"), fit.history, len(weights), min_rate))
    return rated.withColumn("copies", F.floor(F.col("rate") + u).cast("int")).withColumn("missed", F.lit(fit.missed))


def with_copies(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], min_rate: float = 0.0, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs with ``__copies``, what ``mix`` gives each row (as stated there) in its ``copies``.

    Posteriors are counted a second time for it, so that no text is written or shuffled. Columns may have any names.
    """
    model = fit_classifier(labelled, list(weights))
    fit = fit_rates(materialize(model.posteriors(docs.select(buckets(F.col("text").cast("string")).alias("b"))), "posteriors"), weights, min_rate)
    u = F.shiftrightunsigned(F.xxhash64(*keys, F.lit(29)), 11) * F.lit(2.0**-53)
    rows = model.posteriors(docs.select(F.struct(*docs.columns).alias("__row"), u.alias("__u"), buckets(F.col("text").cast("string")).alias("b")))
    rated = rows.select("__row", F.floor(_rates(F.col("p"), fit.history, len(weights), min_rate) + F.col("__u")).cast("int").alias("__copies"))
    return rated.select("__row.*", "__copies")


def labelled_part(docs: DataFrame, labels: DataFrame, domain: str) -> DataFrame:
    """(text, domain) of the documents that the labels table names, but for its held-out quarter (crc32 of doc_id, mod 4, is 2).

    The other documents' own domains are never looked at.
    """
    known = with_default_columns(labels, doc_id="bigint").where("doc_id is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    part = by_bitmaps(docs, known)
    part = docs.join(known.distinct(), "doc_id", "left_semi") if part is None else part
    return part.select(F.col("text").cast("string").alias("text"), F.col(domain).alias("domain"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_default_columns(read_table(spark, sf_dir, "documents"), doc_id="bigint", text="string", lang="string", source="string")
    labelled = labelled_part(docs, read_table(spark, sf_dir, "labels"), "lang")
    mixed = mix(docs, labelled, TARGETS, keys=("doc_id", "source", "lang"))
    named = [F.round(F.col("p")[i], 9).alias(f"p_{d}") for i, d in enumerate(TARGETS)]
    return mixed.select("doc_id", "source", "lang", F.col("n").cast("bigint").alias("n_tokens"), *named, F.round("rate", 9).alias("rate"), "copies", F.round("missed", 9).alias("missed"))
