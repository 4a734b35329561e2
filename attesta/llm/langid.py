"""Language identification by a bidirectional gated recurrent network over bytes.

Each direction is a light gated unit (an update gate and a candidate state, piecewise linear): bytes
enter through a table, one matrix carries the state on. Both directions' states give every position a
distribution over the learned languages; a document's distribution is the mean over its positions.
The network is trained in numpy by backpropagation through time on a bounded sample of labelled rows
(``SAMPLE`` a language); prediction runs over all bytes of all texts in batches of equal windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import held_out, lean, table

HIDDEN = 12
#: Labelled rows a language that training reads at most, and characters of each.
SAMPLE = 512
SAMPLE_CHARS = 1200
#: Languages learned at most, those with the most labelled rows: a column of dirty labels does not become a model of its own size.
LANGUAGES = 256
TRAIN_WINDOW, TRAIN_BATCH, TRAIN_STEPS, RATE = 64, 128, 260, 0.02
#: Bytes of a window and windows of a batch in prediction; together they bound a task's memory.
WINDOW, WINDOWS = 128, 2048
UNDETERMINED = "und"
PAD = 0x20


class Network:
    """Per direction (f, b) a byte table (2H, 256), a state matrix (2H, H) and output weights (N, H)."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7):
        r = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        n = len(languages)
        p = {"bias": np.zeros((n, 1))}
        for d in "fb":
            p["in" + d] = r.normal(0, 0.3, (2 * hidden, 256))
            p["in" + d][:hidden] += 0.5  # gates start half open
            p["state" + d] = r.normal(0, 0.3 / np.sqrt(hidden), (2 * hidden, hidden))
            p["out" + d] = r.normal(0, 0.3, (n, hidden))
        self.p = {k: v.astype(np.float32) for k, v in p.items()}

    def states(self, d: str, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """(T, H, B) after each byte of ``x`` (T, B), read in the order given; ``keep`` gets the raw gate inputs."""
        size = self.hidden
        entry, carry = self.p["in" + d], self.p["state" + d]
        out = np.empty((len(x), size, x.shape[1]), np.float32)
        a, r = (np.empty((2 * size, x.shape[1]), np.float32) for _ in range(2))
        z, n = a[:size], a[size:]
        h = np.zeros((size, x.shape[1]), np.float32)
        for t in range(len(x)):
            np.take(entry, x[t], axis=1, out=a, mode="clip")
            a += np.matmul(carry, h, out=r)
            if keep is not None:
                keep.append(a.copy())
            np.minimum(np.maximum(z, 0, out=z), 1, out=z)
            np.minimum(np.maximum(n, -1, out=n), 1, out=n)
            np.subtract(h, n, out=out[t])
            out[t] *= z
            out[t] += n
            h = out[t]
        return out

    def probabilities(self, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
        """(N, B) at one position."""
        s = self.p["outf"] @ forward
        s += self.p["outb"] @ backward
        s += self.p["bias"]
        s -= s.max(axis=0)
        np.exp(s, out=s)
        s /= s.sum(axis=0)
        return s

    def pooled(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Sums over each window's first ``lengths`` positions: (N, B) for windows ``x`` (T, B)."""
        forward, backward = self.states("f", x), self.states("b", x[::-1])
        total = np.zeros((len(self.languages), x.shape[1]), np.float64)
        for t in range(len(x)):
            total += self.probabilities(forward[t], backward[len(x) - 1 - t]) * (lengths > t)
        return total

    def gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over all positions, windows ``x`` (T, B) of languages ``y`` (B)."""
        t_max, b = x.shape
        size, p = self.hidden, self.p
        sides = {}
        for d, seen in (("f", x), ("b", x[::-1])):
            raw: list[np.ndarray] = []
            sides[d] = (seen, self.states(d, seen, raw), raw)
        wanted = np.zeros((len(self.languages), b), np.float32)
        wanted[y, np.arange(b)] = 1
        error = np.stack([self.probabilities(sides["f"][1][t], sides["b"][1][t_max - 1 - t]) - wanted for t in range(t_max)]) / (t_max * b)
        g = {"bias": error.sum(axis=(0, 2))[:, None]}
        for d, (seen, states, raw) in sides.items():
            err = error if d == "f" else error[::-1]
            g["out" + d] = np.einsum("tnb,thb->nh", err, states, optimize=True)
            carry = p["state" + d]
            g["state" + d] = np.zeros_like(carry)
            back = np.zeros((size, b), np.float32)
            through = np.empty((t_max, 2 * size, b), np.float32)
            for t in range(t_max - 1, -1, -1):
                before = states[t - 1] if t else np.zeros((size, b), np.float32)
                z, n = np.clip(raw[t][:size], 0, 1), np.clip(raw[t][size:], -1, 1)
                dh = p["out" + d].T @ err[t] + back
                da = through[t]
                da[:size] = dh * (before - n) * ((raw[t][:size] > 0) & (raw[t][:size] < 1))
                da[size:] = dh * (1 - z) * (np.abs(raw[t][size:]) < 1)
                g["state" + d] += da @ before.T
                back = dh * z + carry.T @ da
            flat, codes = through.transpose(1, 0, 2).reshape(2 * size, -1), seen.reshape(-1)
            order = np.argsort(codes, kind="stable")
            starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
            g["in" + d] = np.zeros_like(p["in" + d])
            g["in" + d][:, codes[order][starts]] = np.add.reduceat(flat[:, order], starts, axis=1)
        return g


def train(texts: list[bytes], labels: list[str], hidden: int = HIDDEN, steps: int = TRAIN_STEPS, seed: int = 7) -> Network | None:
    """Adam on balanced batches of windows; None without a labelled text."""
    languages = sorted(set(labels))
    if not languages:
        return None
    net, r = Network(languages, hidden, seed), np.random.default_rng(seed)
    by = [[np.frombuffer(t, np.uint8) for t, l in zip(texts, labels, strict=True) if l == language] for language in languages]
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    for step in range(1, steps + 1 if len(languages) > 1 else 1):
        y = np.arange(TRAIN_BATCH) % len(languages)
        x = np.full((TRAIN_WINDOW, TRAIN_BATCH), PAD, np.int64)
        for i, language in enumerate(y):
            text = by[language][r.integers(len(by[language]))]
            at = r.integers(max(1, len(text) - TRAIN_WINDOW + 1))
            part = text[at : at + TRAIN_WINDOW]
            x[: len(part), i] = part
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        g = net.gradient(x, y)
        norm = np.sqrt(sum(float((q * q).sum()) for q in g.values()))
        for k, grad in g.items():
            grad = grad * min(1.0, 1.0 / (norm + 1e-12))
            m[k] += 0.1 * (grad - m[k])
            v[k] += 0.01 * (grad * grad - v[k])
            net.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def fit(documents: DataFrame, hidden: int = HIDDEN) -> Network | None:
    """Train on at most ``SAMPLE`` labelled rows that are not held out of each of ``LANGUAGES`` languages; needs doc_id, text, lang.

    The sample is the row of least hash in each of ``SAMPLE`` hash classes a language: a map-side
    minimum over ids alone, then one scan for the chosen texts' slices.
    """
    digest = F.xxhash64("doc_id")
    rows = documents.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    learned = [r["lang"] for r in rows.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(LANGUAGES).collect()]
    rows = rows.where(F.col("lang").isin(learned))
    least = rows.groupBy("lang", F.pmod(digest, F.lit(SAMPLE))).agg(F.min(digest).alias("h")).select("h").collect()
    start = (F.pmod(F.xxhash64("doc_id", F.lit("at")), F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS)) + 1).cast("int")
    found = (
        rows.where(digest.isin([r["h"] for r in least]))
        .select("lang", digest.alias("h"), F.substring(F.col("text"), start, F.lit(SAMPLE_CHARS)).alias("t"))
        .where(F.regexp_like("t", F.lit(r"\p{L}")))
        .collect()
        if least
        else []
    )
    found.sort(key=lambda r: (r["lang"], r["h"], r["t"]))
    return train([r["t"].encode() for r in found], [r["lang"] for r in found], hidden)


class Pooler:
    """Collects documents' windows and pools their positions in full batches."""

    def __init__(self, net: Network):
        self.net = net
        self.x = np.full((WINDOWS, WINDOW), PAD, np.uint8)
        self.lengths, self.owner = np.zeros(WINDOWS, np.int64), np.zeros(WINDOWS, np.int64)
        self.used = 0
        self.sums: np.ndarray = np.zeros((0, len(net.languages)))

    def add(self, texts: list[bytes]) -> np.ndarray:
        """Mean distribution (documents, N) of non-empty texts."""
        self.sums = np.zeros((len(texts), len(self.net.languages)))
        for i, text in enumerate(texts):
            codes = np.frombuffer(text, np.uint8)
            at = 0
            while at < len(codes):
                n = min(-(-(len(codes) - at) // WINDOW), WINDOWS - self.used)
                part = codes[at : at + n * WINDOW]
                to = self.x[self.used : self.used + n].reshape(-1)
                to[: len(part)], to[len(part) :] = part, PAD
                self.lengths[self.used : self.used + n] = WINDOW
                self.lengths[self.used + n - 1] = len(part) - (n - 1) * WINDOW
                self.owner[self.used : self.used + n] = i
                self.used, at = self.used + n, at + n * WINDOW
                if self.used == WINDOWS:
                    self._flush()
        self._flush()
        return self.sums / np.array([len(t) for t in texts])[:, None]

    def _flush(self) -> None:
        n, self.used = self.used, 0
        if n:
            pooled = self.net.pooled(np.ascontiguousarray(self.x[:n].T).astype(np.intp), self.lengths[:n])
            np.add.at(self.sums, self.owner[:n], pooled.T)


def predict(documents: DataFrame, net: Network | None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row; needs doc_id and text only.

    ``und`` and 0 for a null or empty text or one without a letter, and everywhere if nothing was
    learned. A text's every byte is read. Repeated rows get equal rows; a null doc_id is not held out.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pooler = Pooler(net) if net else None
        for batch in batches:
            rows = batch.num_rows
            pred, score = [UNDETERMINED] * rows, np.zeros(rows)
            texts = batch.column(2).to_pylist() if pooler else []
            some = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
            if some:
                mean = pooler.add([texts[i].encode() for i in some])
                best = mean.argmax(axis=1)
                for i, b, row in zip(some, best, mean, strict=True):
                    pred[i], score[i] = net.languages[b], min(1.0, float(row[b]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred), pa.array(score)], schema=schema)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held"), "text")
    return lean(rows).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(documents: DataFrame) -> DataFrame:
    return predict(documents, fit(documents))


def op1_langid(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
