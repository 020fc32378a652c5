"""Toxicity by weak supervision.

Many voters look at a text: fixed word lists, words and word beginnings mined from labelled
rows, and patterns. A generative label model, fitted by expectation maximisation, estimates
how accurate each voter is on either class and how far voters are correlated given the class;
correlated voters share one say. Its posterior labels train a linear classifier over the
voters' evidence, which scores whole texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefall.llm.common import crc_mod

# English insults by kind, one voter for each kind.
LEXICONS: dict[str, tuple[str, ...]] = {
    "wits": ("idiot", "moron", "stupid", "dumb", "imbecile", "fool", "dunce", "halfwit", "brainless"),
    "worth": ("worthless", "pathetic", "loser", "failure", "useless", "nobody"),
    "filth": ("scum", "trash", "garbage", "filth", "vermin", "disgusting"),
    "mockery": ("clown", "freak", "creep", "weirdo", "buffoon"),
    "threat": ("kill", "hate", "destroy", "hurt"),
}
MAX_LABELLED = 8_000  # bound on the labelled rows that a model is fitted on
MAX_MINED = 400
MAX_VOTERS = 80
STEMS = (4, 5, 6)
RIDGE = 0.5
_BLANKED = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
PATTERNS = ("shouting", "exclaims", "decorated", "repeats")
DENSE = 4 + len(PATTERNS)


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_BLANKED).split()


def patterns_of(text: str, words: list[bytes], distinct: int) -> list[float]:
    """Shares between 0 and 1 of a whole text that the pattern voters look at."""
    n, chars = max(1, len(words)), max(1, len(text))
    upper = sum(map(str.isupper, text.split())) if text.isupper() or not text.islower() else 0
    return [upper / n, min(1.0, text.count("!") / n), min(1.0, sum(map(text.count, ("%%%", "***", "###", "$$$", "&&&"))) / n), 1 - distinct / n if chars > 1 else 0.0]


@dataclass
class ToxicityModel:
    """features: word or stem to column; weights: a weight for each column, then the dense ones, then the bias."""

    features: dict[bytes, int]
    weights: np.ndarray
    odds: np.ndarray  # log odds of each feature: how strongly a word that it matches speaks for toxic
    voters: list[str] = field(default_factory=list)
    accuracy: np.ndarray | None = None  # P(vote toxic | toxic), P(vote toxic | clean) for each voter
    correlation: np.ndarray | None = None

    def evidence(self, text: str) -> tuple[list[int], list[float]]:
        """(features that occur, DENSE measures): a word that several features match counts once, by the strongest."""
        words = words_of(text)
        distinct = set(words)
        features, stems4, odds = self.features, self._stems4(), self.odds
        hits: set[int] = set()
        strengths = []
        for w in distinct:
            found = [features[w]] if w in features else []
            if len(w) > 4 and w[:4] in stems4:
                found += [features[s] for k in STEMS if len(w) > k and (s := w[:k] + b"~") in features]
            if found:
                hits.update(found)
                strengths.append(max(odds[i] for i in found))
        total = sum(strengths)
        dense = [float(bool(strengths)), max(strengths, default=0.0), float(np.log1p(total)), min(10.0, 20 * total / max(1, len(distinct))), *patterns_of(text, words, len(distinct))]
        return sorted(hits), dense

    def _stems4(self) -> frozenset:
        if not hasattr(self, "_s4"):
            self._s4 = frozenset(f[:4] for f in self.features if f.endswith(b"~"))
        return self._s4

    def score(self, text: str) -> float:
        hits, dense = self.evidence(text)
        n = len(self.features)
        z = float(self.weights[hits].sum() + self.weights[n : n + len(dense)] @ np.array(dense) + self.weights[-1])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def surprise(a: float, b: float, rate: float) -> float:
    """How far a of a + b texts exceed the rate, as the exponent of the chance that it happens by luck."""
    n = a + b
    p = min(a / n, 1 - 1e-9)
    if p <= rate:
        return 0.0
    return n * (p * np.log(p / rate) + (1 - p) * np.log((1 - p) / (1 - rate)))


def mine(texts: list[str], toxic: np.ndarray, fixed: list[bytes]) -> tuple[dict[bytes, float], list[bytes]]:
    """(words and word beginnings, marked ~, that speak for toxic, with their log odds; fixed words that labelled clean texts don't contradict).

    Copies of a text count once. Beginnings are preferred where they say as much as the whole
    words, since they also hold for words not seen.
    """
    pos, neg, seen = Counter(), Counter(), set()
    for turn in (1, 0):  # toxic texts first: only what they have at least three times is counted in the others
        for text, y in zip(texts, toxic, strict=True):
            if y == turn and (mark := hash(text)) not in seen:
                seen.add(mark)
                distinct = set(words_of(text))
                distinct |= {w[:k] + b"~" for w in distinct for k in STEMS if len(w) > k}
                pos.update(distinct) if turn else neg.update(distinct & pos.keys())
        if turn:
            pos = Counter({f: n for f, n in pos.items() if n >= 3})
    n1, n0 = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    rate = min(max(n1 / (n1 + n0), 0.001), 0.999)
    scored = {f: surprise(a, neg.get(f, 0), rate) for f, a in pos.items() if a >= 3}
    share = lambda f: pos[f] / (pos[f] + neg.get(f, 0))
    found = sorted((-v, f) for f, v in scored.items() if v > 12 and share(f) >= min(0.75, 3 * rate))[:MAX_MINED]
    kept = [w for w in fixed if not (neg.get(w, 0) >= 3 and scored.get(w, 0.0) < 12)]
    odds = {f: float(np.log((pos[f] + 0.5) / (n1 + 1)) - np.log((neg.get(f, 0) + 0.5) / (n0 + 1))) for _, f in found}
    return odds, kept


def label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior, accuracies, correlations) for votes in {-1 clean, 0 abstain, 1 toxic}.

    Each voter has its own vote distribution for each class. Correlations are those of the
    votes' residuals given the class; a voter's evidence is divided by one plus the sum of its
    positive correlations, so that a clique of copies counts about once.
    """
    n, m = votes.shape
    q, share = start.astype(float), np.ones(m)
    probs = np.full((2, m, 3), 1 / 3)
    corr = np.eye(m)
    for r in range(rounds):
        prior = np.clip(q.mean(), 0.01, 0.99)
        for y, w in ((0, 1 - q), (1, q)):
            for k, v in enumerate((-1, 0, 1)):
                probs[y, :, k] = ((votes == v) * w[:, None]).sum(axis=0) + 0.5
            probs[y] /= probs[y].sum(axis=1, keepdims=True)
        if r in (2, 8, 16):
            resid = votes - (1 - q)[:, None] * (probs[0, :, 2] - probs[0, :, 0]) - q[:, None] * (probs[1, :, 2] - probs[1, :, 0])
            scale = np.sqrt((resid**2).mean(axis=0)) + 1e-9
            corr = (resid.T @ resid) / n / np.outer(scale, scale)
            share = 1 / (1 + np.clip(corr - np.eye(m), 0, None).sum(axis=1))
        ratio = np.log(probs[1]) - np.log(probs[0])
        z = np.log(prior / (1 - prior)) + sum(share[j] * ratio[j, votes[:, j] + 1] for j in range(m))
        new = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        done = np.abs(new - q).max() < 1e-4
        q = new
        if done and r > 16:
            break
    return q, probs[:, :, 2].T.copy(), corr


def _fit_linear(x: np.ndarray, q: np.ndarray, ridge: float | np.ndarray = 0.3, rounds: int = 25) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    pen = np.full(x.shape[1], 1e-3)
    pen[:-1] = ridge
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - q) + pen * w
        hess = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(pen)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-5:
            break
    return w


def fit(texts: list[str], toxic: list[int]) -> ToxicityModel:
    """A model from labelled texts; without any, only the fixed lists speak."""
    y = np.array([int(t == 1) for t in toxic], dtype=float)
    fixed = [w.encode() for ws in LEXICONS.values() for w in ws]
    mined, fixed = mine(texts, y, fixed) if len(texts) else ({}, fixed)
    features = {f: i for i, f in enumerate(dict.fromkeys([*mined, *fixed]))}
    odds = np.array([mined.get(f, 3.0) for f in features])
    model = ToxicityModel(features, np.zeros(len(features) + DENSE + 1), odds)
    mined = list(mined)
    if not len(texts):
        model.weights[[features[w] for w in fixed]] = 2.0
        model.weights[-1] = -3.0
        return model
    rows = [model.evidence(t) for t in texts]
    n, f = len(texts), len(features)
    sparse = np.zeros((n, f), np.float32)
    for i, (hits, _) in enumerate(rows):
        sparse[i, hits] = 1
    dense = np.array([d for _, d in rows])
    kinds = [sparse[:, [features[w.encode()] for w in ws if w.encode() in features]].any(axis=1).astype(int) for ws in LEXICONS.values()]
    singles = sparse[:, : min(len(mined), MAX_VOTERS)].astype(int)
    none = -(dense[:, 0] == 0).astype(int)
    patterns = [(dense[:, 4 + i] > cut).astype(int) - (dense[:, 4 + i] <= cut / 4).astype(int) for i, cut in enumerate((0.5, 0.3, 0.3, 0.6))]
    density = (dense[:, 3] > 1).astype(int) - (dense[:, 3] < 0.2).astype(int)
    votes = np.column_stack([*kinds, none, density, *patterns, singles]).astype(int)
    model.voters = [*LEXICONS, "no listed word", "density of listed words", *PATTERNS, *(m.decode("utf-8", "replace") for m in mined[: singles.shape[1]])]
    q, model.accuracy, model.correlation = label_model(votes, 0.05 + 0.9 * y)
    x = np.c_[sparse, dense]
    w = _fit_linear(x, q, np.r_[np.full(f, RIDGE), np.full(dense.shape[1], 0.05)])
    # A slope and an intercept fitted on the same labelled rows set the meaning of 0.5.
    z = np.c_[x, np.ones(n)] @ w
    a, b = _fit_linear(z[:, None], y, ridge=1e-2)
    model.weights = w * max(a, 0.05)
    model.weights[-1] = w[-1] * max(a, 0.05) + b
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> tuple[list[str], list[int]]:
    """Texts and toxic marks of at most ``limit`` labelled rows that are not held out, the first by a hash of the id.

    A doc_id counts once, with the first of its texts, so that repeated rows weigh no more than one.
    """
    chosen = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", 5) != 0))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    got = texts.orderBy("doc_id").select("text", "toxic").toArrow()
    return [t or "" for t in got.column("text").to_pylist()], got.column("toxic").to_pylist()


def train(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> ToxicityModel:
    return fit(*labelled_sample(docs, labels, limit))


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row; null texts count as empty, a null id is not held out."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [shared.value.score(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def keep_clean(docs: DataFrame, model: ToxicityModel, cut: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``cut``, with their columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns, spot = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([shared.value.score(t or "") < cut for t in b.column(spot).to_pylist()], pa.bool_()))

    return docs.select(columns).mapInArrow(run, docs.schema)
