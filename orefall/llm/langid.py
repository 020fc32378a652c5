"""Language identification by a small convolutional network over bytes.

A text's UTF-8 bytes are cut into windows of fixed length that cover all of it. Each byte has
a small vector; filters of several widths slide over a window, their maxima are pooled, and a
softmax layer gives the languages' probabilities. A document gets the mean over its windows,
weighted by their bytes. The network is trained in numpy.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefall.llm.common import crc_mod

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
SIZE = 4
MAX_LABELLED = 3_000  # bound on the labelled documents that the network is trained on
UNDETERMINED = "und"
_letter = re.compile(r"[^\W\d_]")


def windows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(bytes in windows, bytes of text in each); the last window is filled with zeros."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    n = -(-len(raw) // WINDOW)
    out = np.zeros((n, WINDOW), dtype=np.uint8)
    out.reshape(-1)[: len(raw)] = raw
    sizes = np.full(n, WINDOW)
    if n:
        sizes[-1] = len(raw) - (n - 1) * WINDOW
    return out, sizes


@dataclass
class ByteNet:
    """vectors (256, SIZE); kernel (max width * SIZE, filters of all widths), narrower ones end in zeros; out and bias."""

    langs: list[str]
    vectors: np.ndarray
    kernel: np.ndarray
    shift: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def columns(self, x: np.ndarray) -> np.ndarray:
        """(windows, positions, width * SIZE) of the bytes that each filter position sees."""
        e = self.vectors[x]
        n, reach = WINDOW - max(WIDTHS) + 1, max(WIDTHS)
        return np.concatenate([e[:, k : k + n] for k in range(reach)], axis=2)

    def pooled(self, x: np.ndarray) -> np.ndarray:
        c = self.columns(x)
        y = c.reshape(-1, c.shape[2]) @ self.kernel
        return np.maximum(y.reshape(len(x), -1, y.shape[1]).max(axis=1) + self.shift, 0)

    def probabilities(self, x: np.ndarray, chunk: int = 256) -> np.ndarray:
        """Softmax of each window, in chunks of bounded memory."""
        out = [np.zeros((0, len(self.langs)), np.float32)]
        for at in range(0, len(x), chunk):
            z = self.pooled(x[at : at + chunk]) @ self.out + self.bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out.append(z / z.sum(axis=1, keepdims=True))
        return np.concatenate(out)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and its share for each text; ``und`` and 0 for null texts and texts without a letter."""
        known = [bool(t) and _letter.search(t) is not None for t in texts]
        parts = [windows(t) for t, k in zip(texts, known, strict=True) if k]
        if not parts or not self.langs:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        probs = self.probabilities(np.concatenate([p for p, _ in parts])).astype(np.float64)
        sizes = np.concatenate([s for _, s in parts]).astype(np.float64)
        starts = np.cumsum([0, *(len(p) for p, _ in parts)])[:-1]
        mean = np.add.reduceat(probs * sizes[:, None], starts, axis=0) / np.add.reduceat(sizes, starts)[:, None]
        best = mean.argmax(axis=1)
        found = iter(zip(best, mean[np.arange(len(best)), best], strict=True))
        langs, scores = [], []
        for k in known:
            i, p = next(found) if k else (None, 0.0)
            langs.append(self.langs[i] if k else UNDETERMINED)
            scores.append(float(min(1.0, p)))
        return langs, scores


def fit(texts: list[str], langs: list[str], epochs: int = 6, most_windows: int = 8_000, seed: int = 7) -> ByteNet:
    """Train on windows of labelled texts (up to four a text, spread over it) by Adam on cross-entropy."""
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for t, lang in zip(texts, langs, strict=True):
        w, s = windows(t)
        w = w[s >= min(40, s.max(initial=0))]
        for i in np.unique(np.linspace(0, len(w) - 1, 4).astype(int)) if len(w) else []:
            xs.append(w[i])
            ys.append(names.index(lang))
    dim, cols = SIZE * max(WIDTHS), FILTERS * len(WIDTHS)
    mask = np.zeros((dim, cols), np.float32)
    for i, width in enumerate(WIDTHS):
        mask[: width * SIZE, i * FILTERS : (i + 1) * FILTERS] = 1
    f = np.float32
    net = ByteNet(names, rng.normal(0, 0.5, (256, SIZE)).astype(f), rng.normal(0, 0.3, (dim, cols)).astype(f) * mask, np.zeros(cols, f), rng.normal(0, 0.3, (cols, max(1, len(names)))).astype(f), np.zeros(max(1, len(names)), f))
    if not xs or len(names) < 2:
        return net
    x, y = np.array(xs), np.array(ys)
    pick = rng.permutation(len(x))[:most_windows]
    x, y = x[pick], y[pick]
    weight = (len(y) / np.maximum(1, np.bincount(y, minlength=len(names))) / len(names)).astype(f)
    params = [net.vectors, net.kernel, net.shift, net.out, net.bias]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    epochs = max(epochs, -(-600 * 64 // max(1, len(x))) if len(x) < 4000 else epochs)
    for _ in range(min(epochs, 60)):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 64):
            part = order[at : at + 64]
            grads = _gradients(net, x[part], y[part], weight, mask)
            step += 1
            for i, (p, g) in enumerate(zip(params, grads, strict=True)):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p -= (0.01 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)).astype(f)
    return net


def _gradients(net: ByteNet, x: np.ndarray, y: np.ndarray, weight: np.ndarray, mask: np.ndarray) -> list[np.ndarray]:
    c = net.columns(x)
    n, positions, dim = c.shape
    conv = (c.reshape(-1, dim) @ net.kernel).reshape(n, positions, -1)
    top = conv.argmax(axis=1)
    act = np.take_along_axis(conv, top[:, None, :], axis=1)[:, 0] + net.shift
    hidden = np.maximum(act, 0)
    z = hidden @ net.out + net.bias
    z = np.exp(z - z.max(axis=1, keepdims=True))
    dz = z / z.sum(axis=1, keepdims=True)
    dz[np.arange(n), y] -= 1
    dz *= (weight[y] / n)[:, None]
    dh = (dz @ net.out.T) * (act > 0)
    seen = c[np.arange(n)[:, None], top]  # (n, filters, dim): what each filter saw at its maximum
    dk = np.einsum("nfd,nf->df", seen, dh) * mask
    dseen = dh[:, :, None] * net.kernel.T[None]
    dv = np.zeros_like(net.vectors)
    for k in range(max(WIDTHS)):
        np.add.at(dv, x[np.arange(n)[:, None], top + k], dseen[:, :, k * SIZE : (k + 1) * SIZE])
    return [dv, dk, dh.sum(axis=0), hidden.T @ dz, dz.sum(axis=0)]


def labelled_sample(docs: DataFrame, limit: int = MAX_LABELLED) -> tuple[list[str], list[str]]:
    """Text and lang of at most ``limit`` documents with a lang that are not held out, the first by a hash of the id.

    A doc_id counts once, with its first lang and the first of its texts in that lang, so that
    the same table always gives the same sample.
    """
    ids = (
        docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", 3) != 1))
        .groupBy("doc_id").agg(F.min("lang").alias("lang")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    texts = docs.select("doc_id", "lang", "text").join(F.broadcast(ids), ["doc_id", "lang"]).where(F.col("text").isNotNull())
    got = texts.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).orderBy("doc_id").select("text", "lang").toArrow()
    return got.column("text").to_pylist(), got.column("lang").to_pylist()


def train(docs: DataFrame, limit: int = MAX_LABELLED) -> ByteNet:
    return fit(*labelled_sample(docs, limit))


def identify(docs: DataFrame, net: ByteNet) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row; a null id is not held out."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                langs, scores = shared.value.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


LEAST = 0.6  # share of its bytes' windows that a document's language needs in the pipeline


def keep_identified(docs: DataFrame, net: ByteNet, least: float = LEAST, wanted: Sequence[str] | None = None) -> DataFrame:
    """The rows of ``docs`` in a learned language (one of ``wanted``, if given) with at least that share.

    The others go: texts without a letter, in two languages, of one odd word over and over, or
    too short to tell. Where ``net`` has learned no language, the rows with a letter stay. Null
    texts go, repeated rows are judged alike, and columns and their order stay as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    columns, spot = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                texts = part.column(spot).to_pylist()
                if not shared.value.langs:
                    yield part.filter(pa.array([bool(t) and _letter.search(t) is not None for t in texts], pa.bool_()))
                    continue
                langs, scores = shared.value.predict(texts)
                yield part.filter(pa.array([a != UNDETERMINED and s >= least and (wanted is None or a in wanted) for a, s in zip(langs, scores, strict=True)], pa.bool_()))

    return docs.select(columns).mapInArrow(run, docs.schema)
