"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic examples (P) and unlabelled texts (U, drawn without regard to labels) train a linear
classifier g in numpy. With the class prior pi, the risk is

    pi * mean_P loss(g)  +  max(0, mean_U loss(-g) - pi * mean_P loss(-g))

where the second part, the negatives' share of U, cannot fall below zero in truth; where an estimate of it
does, the step goes up it instead, which keeps the classifier from learning the sample by heart. The loss
is the logistic one, so the sigmoid of g is a probability.

Features are the words of a text and their first 4, 5 and 6 letters, as present or absent. Fitting reads a
bounded sample, named in ``Bounds``; the prior comes from all labelled rows and scoring reads every text whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.scratch import bound_batches
from tarnlake.llm.workers import lean

_WORD = re.compile(r"[^\W\d_]+")
THRESHOLD = 0.3


@dataclass(frozen=True)
class Bounds:
    """What the fit takes at most: so many texts of each side, whole, until ``side_bytes`` of a side are full, and so
    many features. Which texts goes by their hash, not by their length; one that alone is over the bytes is left out."""

    positives: int = 3000
    unlabelled: int = 6000
    side_bytes: int = 32 << 20
    features: int = 512


@dataclass
class Model:
    bias: float
    weights: dict[str, float] = field(default_factory=dict)


def parts_of(word: str) -> tuple[str, ...]:
    """A word's features: itself and its beginnings."""
    return (word, *(f"{word[:n]}-" for n in (4, 5, 6) if len(word) > n))


def features_of(text: str) -> set[str]:
    out: set[str] = set()
    for w in set(_WORD.findall(text.lower())):
        out.update(parts_of(w))
    return out


def select_features(positive: list[str], unlabelled: list[str], count: int, share: float = 0.02) -> list[str]:
    """Those whose shares in P and U differ most in standard errors, of those in enough texts of P to be no
    accident. Texts are cut into features one at a time, so only counts are held."""
    least = max(3, int(share * len(positive)))
    p: Counter = Counter()
    for t in positive:
        p.update(features_of(t))
    p = Counter({f: n for f, n in p.items() if n >= least})
    u: Counter = Counter()
    for t in unlabelled:
        u.update(features_of(t) & p.keys())
    n_p, n_u = max(1, len(positive)), max(1, len(unlabelled))

    def strength(f: str) -> float:
        a, b, all_of = p[f] / n_p, u[f] / n_u, (p[f] + u[f] + 1) / (n_p + n_u + 2)
        return abs(a - b) / (all_of * (1 - all_of) * (1 / n_p + 1 / n_u)) ** 0.5

    return sorted(p, key=lambda f: (-strength(f), f))[:count]


def as_matrix(texts: list[str], place: dict[str, int]) -> np.ndarray:
    x = np.zeros((len(texts), len(place)), dtype=np.float32)
    for i, t in enumerate(texts):
        x[i, [place[f] for f in features_of(t) & place.keys()]] = 1
    return x


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def nonnegative_risk(z_p: np.ndarray, z_u: np.ndarray, prior: float) -> tuple[float, float]:
    """(positive part, negative part before the correction) of the risk."""
    loss = lambda z: np.logaddexp(0, -z).mean()
    return prior * loss(z_p), loss(-z_u) - prior * loss(-z_p)


def fit(x_p: np.ndarray, x_u: np.ndarray, prior: float, steps: int = 800, rate: float = 0.05, decay: float = 3e-4) -> tuple[np.ndarray, float]:
    """Weights and bias, by Adam on the whole sample. Deterministic."""
    w, b = np.zeros(x_p.shape[1] + 1), float(np.log(prior / (1 - prior)))
    w[-1] = b
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z_p, z_u = x_p @ w[:-1].astype(np.float32) + w[-1], x_u @ w[:-1].astype(np.float32) + w[-1]
        s_p, s_u = sigmoid(z_p), sigmoid(z_u)
        # gradients with respect to z: of loss(z) it is s-1, of loss(-z) it is s
        if nonnegative_risk(z_p, z_u, prior)[1] >= 0:
            g_p, g_u = (prior * (s_p - 1) - prior * s_p) / len(z_p), s_u / len(z_u)
        else:
            g_p, g_u = prior * s_p / len(z_p), -s_u / len(z_u)
        grad = np.append(x_p.T @ g_p.astype(np.float32) + x_u.T @ g_u.astype(np.float32), g_p.sum() + g_u.sum())
        grad[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from. A null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def sample_texts(docs: DataFrame, chosen: DataFrame, most: int, most_bytes: int) -> list[str]:
    """Distinct texts of the chosen ids in order of their hash, up to both bounds. Their sizes come first, so that no
    more than ``most_bytes`` of texts reach the driver."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    keyed = rows.select(F.xxhash64("text").alias("h"), F.octet_length("text").alias("n"), "text")
    sizes = keyed.groupBy("h").agg(F.max("n").alias("n")).orderBy("h").limit(most).toArrow()
    n = sizes["n"].to_numpy()
    n = np.where(n > most_bytes, 0, n)
    fits = sizes.filter(pa.array((n > 0) & (np.cumsum(n) <= most_bytes)))["h"].to_pylist()
    if not fits:
        return []
    # at most ``most`` rows; as an Arrow table, since a list goes through Python workers on the executors
    wanted = docs.sparkSession.createDataFrame(pa.table({"h": pa.array(fits, pa.int64())}))
    found = keyed.join(F.broadcast(wanted), "h").groupBy("h").agg(F.min("text").alias("text")).orderBy("h")
    return found.select("text").toArrow()["text"].to_pylist()


def train(docs: DataFrame, labels: DataFrame, bounds: Bounds = Bounds()) -> Model:  # noqa: B008
    """Fit on the bounded sample; the prior comes from all labelled rows outside the held-out part.

    Without any toxic label, or without texts of either side, the model gives every text the prior (at least 0.001);
    so it does for empty tables. Null and empty texts are texts without features; of rows that repeat an id and a text
    one counts; of labels that repeat an id the largest does.
    """
    known = labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = known.agg(F.avg(F.col("toxic").cast("double")).alias("prior")).first()
    prior = min(0.9, max(0.001, total["prior"] or 0.0))
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = docs.select("doc_id").filter(~held_out(F.col("doc_id"))).distinct()
    toxic = ids.join(known.filter("toxic = 1"), "doc_id").select("doc_id").orderBy(*by_hash).limit(bounds.positives)
    drawn = ids.orderBy(F.xxhash64("doc_id", F.lit("u")), "doc_id").limit(bounds.unlabelled)
    # the two lists hold at most positives + unlabelled ids
    chosen = toxic.withColumn("side", F.lit("p")).unionByName(drawn.withColumn("side", F.lit("u")))
    texts = {side: sample_texts(docs, chosen.filter(F.col("side") == side), most, bounds.side_bytes) for side, most in (("p", bounds.positives), ("u", bounds.unlabelled))}
    if not texts["p"] or not texts["u"]:
        return Model(float(np.log(prior / (1 - prior))))
    names = select_features(texts["p"], texts["u"], bounds.features)
    place = {f: k for k, f in enumerate(names)}
    w, b = fit(as_matrix(texts["p"], place), as_matrix(texts["u"], place), prior)
    return Model(b, {f: float(x) for f, x in zip(names, w, strict=True) if x})


class Scorer:
    def __init__(self, model: Model, cap: int = 100_000):
        self._w, self._bias, self._cap = model.weights, model.bias, cap
        self._known: dict[str, tuple[str, ...]] = {}

    def _of(self, word: str) -> tuple[str, ...]:
        found = tuple(f for f in parts_of(word) if f in self._w)
        if len(self._known) < self._cap and len(word) <= 64:
            self._known[word] = found
        return found

    def score(self, text: str) -> float:
        z, seen, known = self._bias, set(), self._known
        for word in set(_WORD.findall(text.lower())):
            found = known.get(word)
            if found is None:
                found = self._of(word)
            if found:
                seen.update(found)
        z += sum(sorted(self._w[f] for f in seen))  # sorted: the same sum in any order of words
        return float(sigmoid(np.float64(z)))


def score_documents(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """The input's columns with the score as ``column``, last; null texts score as empty ones. No shuffle."""
    names = docs.columns
    text_at = names.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(model)
        for batch in batches:
            scores = [s.score(t.as_py() or "") for t in batch.column(text_at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*names, column])

    bound_batches(docs.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(lean(score), f"{schema}, `{column}` double")


def toxicity_report(docs: DataFrame, labels: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:  # noqa: B008
    """doc_id, held_out, score, predicted for every row, repeated ones too; whole texts, null ones as empty. An empty
    table gives no rows; other columns take no part."""
    model = train(docs, labels, bounds)
    scored = score_documents(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:  # noqa: B008
    """The rows scored below the threshold, with the columns they had; cases are those of ``toxicity_report``."""
    column = "score"
    while column in docs.columns:
        column += "_"
    scored = score_documents(docs, train(docs, labels, bounds), column)
    return scored.filter(F.col(column) < THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])
