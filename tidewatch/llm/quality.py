"""Quality classifier learned from trusted positives and unlabelled web text (positive-unlabelled learning).

Texts become a few dozen measures of form (letter cases, symbols, repetition, lines). A small network is
trained on a non-negative unbiased risk: prior * P[l(+)] + max(0, U[l(-)] - prior * P[l(-)]), where P are
trusted texts, a bounded sample, and U is all unlabelled text. Training starts on a bounded sample of U and goes on
with the risk of all of it, whose gradient Spark sums up over the stored measures; of these steps the weights with
the least risk are taken. The class prior is estimated first: a classifier of P against U is fitted on one half,
and on the other half, of all texts, the least ratio of U's to P's share above a threshold, with margins for chance,
bounds the share of positives in U; the halves change places, and the mean of both is taken.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stored import stored
from .common import slices

THRESHOLD = 0.7
#: Texts that are measured together at most.
SLICE_ROWS = 1000
_CLASS = np.zeros(256, dtype=np.int64)  # 0 other control, then by kind of byte
for _name, _bytes in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", "\n", ".,;:?'\"()-", "!", "|#&$*%@<>{}[]^~`+=\\/_"), 1):
    _CLASS[list(_bytes.encode())] = _name
_CLASS[128:192] = 9
_CLASS[192:] = 10


def measures(text: str) -> list[float]:
    """The text's measures; those of an empty text are zeros."""
    n_bytes = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8), minlength=256)
    lower, upper, digits, blank, lines, stops, bangs, signs, _, wide = np.bincount(_CLASS, weights=n_bytes, minlength=11)[1:]
    chars, letters = max(len(text), 1), max(lower + upper + wide, 1)
    words = text.split()
    n = max(len(words), 1)
    different = set(words)
    again = sum(map(str.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:], strict=False)))
    rows = [x for x in text.split("\n") if x]
    caps = sum(map(str.isupper, words))
    alpha = sum(map(str.isalpha, different))
    return [
        np.log1p(len(words)), np.log1p(chars), sum(map(len, words)) / n, upper / letters, lower / chars, digits / chars, blank / chars,
        lines / n, stops / n, bangs / n, signs / n, min(signs, 50.0), np.log1p(signs), np.log1p(bangs), wide / letters, caps / n, np.log1p(caps),
        len(different) / n, len(different) / np.sqrt(n), again / n, np.log1p(again), pairs / n, alpha / max(len(different), 1),
        len(set(rows)) / max(len(rows), 1), n / max(len(rows), 1), sum(r.rstrip()[-1:] in ".!?:" for r in rows) / max(len(rows), 1),
    ]


WIDTH = len(measures(""))


@dataclass
class Network:
    """One hidden layer on standardised measures; gives the log-odds of a positive."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]

    def shaped(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def odds(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.tanh(self.shaped(x) @ a + b) @ c + d[0]

    def chance(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.odds(x), -40, 40)))


def _forward(weights: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b, c, d = weights
    h = np.tanh(x @ a + b)
    return h, np.clip(h @ c + d[0], -40, 40)


def _backward(weights: list[np.ndarray], x: np.ndarray, h: np.ndarray, g: np.ndarray) -> list[np.ndarray]:
    back = np.outer(g, weights[2]) * (1 - h * h)
    return [x.T @ back, back.sum(axis=0), h.T @ g, np.array([g.sum()])]


def as_negative(weights: list[np.ndarray], x: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Loss of taking all of x for negatives, summed, and its gradient."""
    h, z = _forward(weights, x)
    return float(np.logaddexp(0, z).sum()), _backward(weights, x, h, 1 / (1 + np.exp(-z)))


def risk_and_gradient(weights: list[np.ndarray], p: np.ndarray, u: tuple[float, list[np.ndarray]], prior: float | None) -> tuple[float, list[np.ndarray]]:
    """The non-negative risk of a network on shaped measures, and the direction to step against.

    u is the mean of :func:`as_negative` over U. With a prior of None it is the risk of telling P from U. Where the
    risk of negatives falls below zero it counts as zero, and the step goes back up it.
    """
    h, z = _forward(weights, p)
    s = 1 / (1 + np.exp(-z))
    positive, wrong = np.logaddexp(0, -z).mean(), np.logaddexp(0, z).mean()
    if prior is None:
        risk, g, sign = positive + u[0], s - 1, 1.0
    else:
        negative = u[0] - prior * wrong
        risk = prior * positive + max(0.0, negative)
        g, sign = (prior * ((s - 1) - s), 1.0) if negative >= 0 else (prior * s, -1.0)
    own = _backward(weights, p, h, g / len(p))
    return float(risk), [x + sign * y for x, y in zip(own, u[1], strict=True)]


class Adam:
    def __init__(self, weights: list[np.ndarray], rate: float) -> None:
        self.rate, self.step = rate, 0
        self.m, self.v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]

    def stepped(self, weights: list[np.ndarray], grads: list[np.ndarray]) -> list[np.ndarray]:
        self.step += 1
        out = []
        for k, (w, grad) in enumerate(zip(weights, grads, strict=True)):
            grad = grad + 1e-4 * w if k in (0, 2) else grad
            self.m[k], self.v[k] = 0.9 * self.m[k] + 0.1 * grad, 0.999 * self.v[k] + 0.001 * grad * grad
            out.append(w - self.rate * (self.m[k] / (1 - 0.9**self.step)) / (np.sqrt(self.v[k] / (1 - 0.999**self.step)) + 1e-8))
        return out


def _trained(p: np.ndarray, u: np.ndarray, prior: float | None, moments: tuple[np.ndarray, np.ndarray], steps: int = 400, hidden: int = 16, seed: int = 5) -> Network:
    """Trained on the non-negative risk under the prior, or with None to tell p from u; moments are U's mean and spread."""
    random = np.random.default_rng(seed)
    width = p.shape[1]
    net = Network(*moments, [random.normal(0, width**-0.5, (width, hidden)), np.zeros(hidden), random.normal(0, hidden**-0.5, hidden), np.zeros(1)])
    at_p, at_u, adam = net.shaped(p), net.shaped(u), Adam(net.weights, 0.02)
    for _ in range(steps):
        loss, grads = as_negative(net.weights, at_u)
        _, grads = risk_and_gradient(net.weights, at_p, (loss / len(u), [g / len(u) for g in grads]), prior)
        net.weights = adam.stepped(net.weights, grads)
    return net


def prior_cuts(net: Network, p: np.ndarray) -> np.ndarray:
    """Odds at which U's and P's shares above are compared."""
    return np.quantile(net.odds(p), np.linspace(0, 0.9, 91))


def estimate_prior(net: Network, cuts: np.ndarray, p: np.ndarray, above_u: np.ndarray, n_u: float) -> float:
    """Share of positives in U, from a classifier of P against U, other texts of P, and how many of n_u texts of U are at each cut or above."""
    above_p = 1 - np.searchsorted(np.sort(net.odds(p)), cuts, "left") / len(p)
    above_u = above_u / n_u
    margin = np.sqrt(np.log(20) / 2) * (len(p) ** -0.5 + n_u**-0.5)
    best = np.argmin((above_u + margin) / np.maximum(above_p, 1e-9))
    return float(np.clip(above_u[best] / above_p[best], 0.05, 0.98))


def summed(measured: DataFrame, f: Callable[[np.ndarray], np.ndarray], where: str = "true") -> np.ndarray:
    """Sum of f(measures), a vector for some rows at a time, over the stored measures; only the sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            if batch.num_rows:
                total = total + f(_unpacked(batch.column("x")))
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["k", "v"])

    found = measured.where(where).select("x").mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").toPandas()
    return found["v"].to_numpy()


def _unpacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f4").reshape(-1, WIDTH).astype(np.float64)


def refined(net: Network, p: np.ndarray, measured: DataFrame, n: int, prior: float, steps: int) -> Network:
    """net after some steps against the risk with all of U; the weights with the least risk on the way are taken."""
    best, least, adam, at_p = net.weights, np.inf, Adam(net.weights, 0.005), net.shaped(p)
    weights = net.weights
    for step in range(steps + 1):
        given = measured.sparkSession.sparkContext.broadcast(Network(net.mean, net.scale, weights))

        def negative(x: np.ndarray, given=given) -> np.ndarray:
            net = given.value
            loss, grads = as_negative(net.weights, net.shaped(x))
            return np.concatenate([[loss], *(g.ravel() for g in grads)])

        sums = summed(measured, negative) / n
        cuts = np.cumsum([1, *(w.size for w in weights)])
        u = float(sums[0]), [sums[a:b].reshape(w.shape) for a, b, w in zip(cuts, cuts[1:], weights, strict=False)]
        risk, grads = risk_and_gradient(weights, at_p, u, prior)
        if risk < least:
            best, least = weights, risk
        if step < steps:
            weights = adam.stepped(weights, grads)
    return Network(net.mean, net.scale, best)


def _drawn(seed: int, share: float):
    """Rows drawn by the hash of their id."""
    return F.coalesce(F.xxhash64(F.lit(seed), "tw_id").bitwiseAND(F.lit((1 << 30) - 1)) < (1 << 30) * min(1.0, share), F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", quality_col: str = "quality", positives: int = 4000, start: int = 12000, steps: int = 6) -> Network:
    """A network fitted on about so many trusted texts (a documented bound, drawn by the hash of ids) and on all of docs.

    docs and labels are the rows that may be learned from; labels other than 1 aren't used. About `start` texts,
    drawn likewise, give the weights to begin with; U's moments, the prior and the last `steps` steps are of all
    texts. Their measures, 104 bytes a text, are stored in between. Nulls: a null id or label is not trusted, a null
    text counts as empty. Repeated rows count each. With fewer than ten trusted or unlabelled texts, or an empty
    table, nothing is learned, and every text gets a chance of one half.
    """
    good = labels.where(F.col(quality_col) == 1).select(F.col(id_col).alias("tw_id")).where("tw_id is not null").distinct()
    rows = docs.select(F.col(id_col).alias("tw_id"), F.col(text_col).alias("tw_text"))
    n_good, n = good.count(), rows.count()
    trusted = good.where(_drawn(21, positives / max(n_good, 1))).withColumn("good", F.lit(True))
    half = F.pmod(F.xxhash64(F.lit(23), "tw_id", "tw_text"), F.lit(2)).cast("int").alias("half")
    picked = rows.join(F.broadcast(trusted), "tw_id", "left").select("tw_text", F.coalesce("good", F.lit(False)).alias("good"), _drawn(22, start / max(n, 1)).alias("drawn"), half)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "tw_text", SLICE_ROWS):
            x = pa.array([np.array(measures(t or ""), dtype="<f4").tobytes() for t in batch.column("tw_text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("good", "drawn", "half")), x], names=["good", "drawn", "half", "x"])

    measured = stored(picked.mapInArrow(measure, "good boolean, drawn boolean, half int, x binary"), "measures")
    frame = measured.where("good or drawn").toPandas()
    x = _unpacked(pa.array(frame["x"].tolist(), pa.binary()))
    order = np.lexsort(x.T)  # the same model wherever the rows were computed
    x, is_p, drawn = x[order], frame["good"].to_numpy(dtype=bool)[order], frame["drawn"].to_numpy(dtype=bool)[order]
    half = frame["half"].to_numpy()[order]
    p, u, half = x[is_p][np.random.default_rng(3).permutation(is_p.sum())], x[drawn], half[drawn]
    if min(len(p), len(u)) < 10:
        return Network(np.zeros(WIDTH), np.ones(WIDTH), [np.zeros((WIDTH, 1)), np.zeros(1), np.zeros(1), np.zeros(1)])
    sums = summed(measured, lambda x: np.concatenate([x.sum(axis=0), (x * x).sum(axis=0)])) / n
    moments = sums[:WIDTH], np.sqrt(np.maximum(sums[WIDTH:] - sums[:WIDTH] ** 2, 0)) + 1e-6
    priors = []
    for i in (0, 1):  # each half is tried by a classifier of the other
        if not (half == i).any():
            continue
        first, tried = _trained(p[i::2], u[half == i], None, moments, steps=200), p[1 - i :: 2]
        cuts = prior_cuts(first, tried)
        above = summed(measured, lambda x, net=first, cuts=cuts: np.append((net.odds(x)[:, None] >= cuts).sum(axis=0), len(x)).astype(float), f"half = {1 - i}")
        if len(above):
            priors.append(estimate_prior(first, cuts, tried, above[:-1], above[-1]))
    prior = float(np.mean(priors)) if priors else 0.5
    return refined(_trained(p, u, prior, moments), p, measured, n, prior, steps)


def score(docs: DataFrame, model: Network, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from the threshold on).

    A null text counts as empty. Texts are read whole. Columns of those names are replaced, others stay, whatever
    their names. Rows with the same text, repeated or not, get the same score; a score equal to the threshold is
    predicted 1. An empty table gives an empty result.
    """
    given = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = given.value
        for batch in slices(batches, text_col, SLICE_ROWS):
            s = net.chance(np.array([measures(t or "") for t in batch.column(text_col).to_pylist()]).reshape(-1, WIDTH))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*keep, "score", "predicted"])

    return docs.mapInArrow(run, f"{schema}, score double, predicted int")


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs.where(~_held_out()), labels.where(~_held_out()))
    return score(docs.select("doc_id", _held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "score", "predicted")
