"""Quality by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are rows whose label is 1; all other training rows are unlabelled web text, whatever
they are: labels of 0 are never read. The class prior is estimated from the two samples alone (Garg et
al. 2021): a plain classifier of positives against unlabelled rows orders a held back half of both, and
the prior is the least ratio of unlabelled to positive rows above a score, sampling error allowed for.
A small network then minimises ``pi * R_p(+) + max(0, R_u(-) - pi * R_p(-))``: the risk of calling
unlabelled text negative, less what the positives hidden in it contribute, is not let below zero (where
it is, the step goes the other way, as in Kiryo et al. 2017).

Features are shape statistics of the whole text and the shares of its hashed words and word pairs.
Training reads a bounded sample of rows (``SAMPLE`` positives and as many unlabelled); scoring reads
every text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from attesta.llm.common import held_out, lean, table
from attesta.llm.shingles import pair_hashes, word_hashes

#: Positives, and unlabelled rows, that training reads at most.
SAMPLE = 4096
HIDDEN, STEPS, BATCH, RATE = 16, 600, 512, 0.01
#: Buckets of hashed words, and as many of word pairs; by how much less than a shape statistic each of them counts.
BUCKETS, DAMPING = 64, 3.0
DEFAULT_PRIOR = 0.5
THRESHOLD = 0.3
#: Bytes of a text compressed at a time.
PIECE = 1 << 16


def features(text: str) -> np.ndarray:
    """Shape statistics of a whole text, then the square roots of the shares of its words and word pairs by bucket; zeros for a text without words."""
    out = np.zeros(N_FEATURES)
    out[:N_SHAPE] = shape(text)
    words = word_hashes(text)
    for at, hashes in ((N_SHAPE, words), (N_SHAPE + BUCKETS, pair_hashes(words))):
        if len(hashes):
            out[at : at + BUCKETS] = np.sqrt(np.bincount((hashes % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS) / len(hashes))
    return out


def shape(text: str) -> list[float]:
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * N_SHAPE
    lines = [line for line in text.split("\n") if line.strip()]
    data = text.encode("utf-8", "surrogatepass")
    packed = sum(len(zlib.compress(data[i : i + PIECE], 1)) for i in range(0, len(data), PIECE))
    space = chars - sum(map(len, words))
    upper = sum(1 for w in words if w.isupper())
    alpha = sum(1 for w in words if w.isalpha())
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    symbols = sum(text.count(c) for c in "#$%&*|<>{}[]=_~^\\/@+")
    exclaims, stops, commas, digits = text.count("!"), text.count("."), text.count(","), sum(text.count(c) for c in "0123456789")
    longest = max(map(len, words))
    return [
        np.log1p(n) / 10,
        (chars - space) / n / 10,
        len(set(words)) / n,
        len(set(words)) / (n**0.5) / 20,
        alpha / n,
        upper / n,
        repeats / n,
        symbols / n,
        text.count("|") / n,
        exclaims / n,
        stops / n,
        commas / n,
        digits / chars,
        len(set(lines)) / max(1, len(lines)),
        n / max(1, len(lines)) / 100,
        packed / len(data),
        min(longest, 100) / 100,
        space / chars,
        sum(1 for w in words if w[0].isupper()) / n,
        1.0,
    ]


N_SHAPE = 20
N_FEATURES = N_SHAPE + 2 * BUCKETS


class Scorer:
    """A network of one hidden layer on standardised features."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 5):
        r = np.random.default_rng(seed)
        self.mean, self.scale = mean, np.where(np.arange(len(mean)) < N_SHAPE, scale, DAMPING * scale)
        self.p = {"w": r.normal(0, 0.5 / np.sqrt(len(mean)), (len(mean), HIDDEN)), "b": np.zeros(HIDDEN), "v": r.normal(0, 0.3, HIDDEN), "c": np.zeros(1)}

    def _hidden(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ self.p["w"] + self.p["b"])

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self._hidden(x) @ self.p["v"] + self.p["c"]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -40, 40)))

    def gradient(self, x: np.ndarray, slope: np.ndarray) -> dict[str, np.ndarray]:
        """Of ``sum(slope * logits)`` with ``slope`` held fixed."""
        h = self._hidden(x)
        back = slope[:, None] * self.p["v"] * (1 - h * h)
        return {"w": np.clip((x - self.mean) / self.scale, -8, 8).T @ back, "b": back.sum(axis=0), "v": h.T @ slope, "c": slope.sum(keepdims=True)}


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def risk(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """(non-negative PU risk of the logits with the logistic loss, slopes of the step by logit of positives and unlabelled)."""
    called, hidden = _softplus(zu).mean(), prior * _softplus(zp).mean()
    sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
    value = prior * _softplus(-zp).mean() + max(0.0, called - hidden)
    # d/dz softplus(-z) = sigmoid(z) - 1, d/dz softplus(z) = sigmoid(z)
    if called >= hidden:
        return value, prior * (sp - 1) / len(zp) - prior * sp / len(zp), su / len(zu)
    return value, prior * sp / len(zp), -su / len(zu)


def against(zp: np.ndarray, zu: np.ndarray, _prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Like ``risk``, but of telling positives from unlabelled rows."""
    return (_softplus(-zp).mean() + _softplus(zu).mean()) / 2, -1 / (1 + np.exp(zp)) / (2 * len(zp)), 1 / (1 + np.exp(-zu)) / (2 * len(zu))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 5, loss=risk) -> Scorer | None:
    """Minimise ``loss``; None without positives or unlabelled rows."""
    if not len(positive) or not len(unlabelled):
        return None
    every = np.concatenate([positive, unlabelled])
    net = Scorer(every.mean(axis=0), every.std(axis=0) + 1e-3, seed)
    r = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    for step in range(1, STEPS + 1):
        p, u = positive[r.integers(len(positive), size=BATCH)], unlabelled[r.integers(len(unlabelled), size=BATCH)]
        _, gp, gu = loss(net.logits(p), net.logits(u), prior)
        a, b = net.gradient(p, gp), net.gradient(u, gu)
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for k in net.p:
            grad = a[k] + b[k] + 1e-4 * net.p[k]
            m[k] += 0.1 * (grad - m[k])
            v[k] += 0.01 * (grad * grad - v[k])
            net.p[k] = net.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return net


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 5) -> float:
    """Share of positives among the unlabelled rows by their shape statistics, between 0.05 and 0.95; ``DEFAULT_PRIOR`` of fewer than four rows of either."""
    if min(len(positive), len(unlabelled)) < 4:
        return DEFAULT_PRIOR
    positive, unlabelled = positive[:, :N_SHAPE], unlabelled[:, :N_SHAPE]
    net = train(positive[::2], unlabelled[::2], DEFAULT_PRIOR, seed, against)
    p, u = np.sort(net.logits(positive[1::2])), np.sort(net.logits(unlabelled[1::2]))
    at = np.unique(p)  # scores from which on rows count
    q_p, q_u = (1 - np.searchsorted(z, at) / len(z) for z in (p, u))
    error = np.sqrt(np.log(40) / 2 / len(u)) + np.sqrt(np.log(40) / 2 / len(p))
    best = int(np.argmin((q_u + 1.01 * error) / q_p))
    return float(np.clip(q_u[best] / q_p[best], 0.05, 0.95))


def _described(rows: DataFrame, names: list[str]) -> DataFrame:
    """``names`` and ``features`` (doubles as bytes) of each row's ``text``."""
    schema = rows.select(*names).schema.add("features", BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [features(t or "").astype("<f8").tobytes() for t in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(values, pa.binary())], names=[*names, "features"])

    return lean(rows).select(*names, "text").mapInArrow(run, schema)


def _least_hashes(rows: DataFrame, n: int) -> list[int]:
    """At most ``n`` id hashes: the least of each of ``n`` hash classes, found map-side from ids alone."""
    digest = F.xxhash64("doc_id")
    return [r["h"] for r in rows.groupBy(F.pmod(digest, F.lit(n))).agg(F.min(digest).alias("h")).collect()]


def fit(documents: DataFrame, labels: DataFrame) -> Scorer | None:
    """Train on rows that are not held out: labelled 1 as positives, all others (labels unseen) as unlabelled.

    Needs doc_id, text of ``documents`` and doc_id, quality of ``labels``. None if there is no positive
    or no unlabelled row.
    """
    known = labels.select(F.col("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality = 1").where(~held_out(F.col("doc_id")))
    positive = set(_least_hashes(known, SAMPLE))
    rows = documents.select("doc_id", "text").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    unlabelled = set(_least_hashes(rows, SAMPLE)) if positive else set()
    if not positive:
        return None
    digest = F.xxhash64("doc_id")
    chosen = rows.withColumn("h", digest).where(F.col("h").isin(list(positive | unlabelled)))
    found = sorted((r["h"], bytes(r["features"])) for r in _described(chosen, ["h"]).collect())
    x = {kind: np.array([np.frombuffer(f, "<f8") for h, f in found if h in hashes]) for kind, hashes in (("p", positive), ("u", unlabelled))}
    return train(x["p"], x["u"], class_prior(x["p"], x["u"]))


def score(documents: DataFrame, net: Scorer | None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; needs doc_id and text only.

    Null and empty texts score as a text without words; without a trained scorer every score is the
    default prior. Repeated rows get equal rows; a null doc_id is not held out.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = scored(net, batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], schema=schema)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held"), "text")
    return lean(rows).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def scored(net: Scorer | None, texts: list[str | None]) -> np.ndarray:
    if net is None or not texts:
        return np.full(len(texts), DEFAULT_PRIOR)
    return net.scores(np.array([features(t or "") for t in texts]))


def keep(documents: DataFrame, net: Scorer | None) -> DataFrame:
    """The rows of ``documents``, all columns, that score ``THRESHOLD`` or more.

    Null and empty texts score as a text without words, repeated rows alike; an empty table stays empty; columns pass
    through whatever their names; without a trained scorer every row stays.
    """
    def of(text: pa.Array) -> pa.Array:
        return pa.array(scored(net, text.to_pylist()))

    return lean(documents).where(F.arrow_udf(of, "double")(F.col("text")) >= THRESHOLD)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(documents, fit(documents, table(spark, sf_dir, "labels").select("doc_id", "quality")))
