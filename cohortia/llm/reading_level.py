"""Reading level of each document by regularised ordinal regression."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortia.session import cut

WORD = re.compile(r"[^\W\d_]+")
SHRINK = 2.0
RARE = 9.0
ENDINGS = ("mente", "ción", "ciones", "dad", "dades", "tion", "tions", "ly", "ity", "ment")
STOP = re.compile(r"[.!?;:\n]+")

# Word lists of this library: connectives and subordinators of Spanish and English, and words that open clauses, of which the
# share among all words stands in for clause depth.
CONNECTIVES = frozenset(
    "aunque porque pues mientras cuando donde según mediante conforme asimismo además "
    "embargo obstante sino luego entonces así dado debido tras hasta desde sin "
    "although because while when where whereas therefore however moreover furthermore thus hence "
    "since until unless despite given provided whether nevertheless notwithstanding".split()
)
CLAUSE = frozenset(
    "que cual cuales quien quienes cuyo cuya cuyos cuyas si como siempre "
    "which that who whom whose if as whether".split()
)
FEATURES = (
    "letras_por_palabra", "palabras_largas", "palabras_muy_largas", "palabras_cortas", "diversidad", "rareza",
    "rareza_alta", "conectores", "clausulas", "comas", "terminacion_adverbial", "log_palabras_por_frase",
    "letras_mediana", "rareza_mediana", "letras_q1", "letras_q3",
)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class WordTable:
    """What a word contributes to the features, worked out once per distinct word of a task.

    Columns: letters, rarity, long (8+), very long (12+), short (up to 4), rarer than RARE, connective, clause mark, learned ending.
    """

    LIMIT = 500_000  # distinct words held; the table is then started anew, which changes no value

    def __init__(self, rarity: dict[str, float], floor: float) -> None:
        self.rarity, self.floor = rarity, floor
        self.places: dict[str, int] = {}
        self.rows = np.empty((1024, 9))

    def __getitem__(self, words: list[str]) -> np.ndarray:
        if len(self.places) > self.LIMIT:
            self.places, self.rows = {}, np.empty((1024, 9))
        known = self.places
        ids = [known[w] if w in known else self._add(w) for w in words]
        return self.rows[ids]

    def _add(self, w: str) -> int:
        k = self.places[w] = len(self.places)
        if k == len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        n, rare = len(w), self.rarity.get(w, self.floor)
        self.rows[k] = (n, rare, n >= 8, n >= 12, n <= 4, rare > RARE, w in CONNECTIVES, w in CLAUSE, w.endswith(ENDINGS))
        return k


def _between(ordered: np.ndarray, q: float) -> float:
    """Quantile of sorted values by linear interpolation."""
    at = q * (len(ordered) - 1)
    low = int(at)
    high = min(low + 1, len(ordered) - 1)
    return float(ordered[low] + (at - low) * (ordered[high] - ordered[low]))


def document_features(text: str | None, table: WordTable, stretch: int = 24) -> list[float] | None:
    """The number of words, then FEATURES over all words of one text; None for a text without words.

    Means over words are completed by medians and quartiles over stretches of `stretch` words, which single easier
    or harder sentences don't move. Nothing depends on full stops alone, as lists and notes often have none.
    """
    words = words_of(text)
    n = len(words)
    if not n:
        return None
    marks = table[words]
    letters, rare, *shares = (marks.sum(axis=0) / n).tolist()
    long, longest, short, very_rare, connectives, clauses, endings = shares
    cuts = np.arange(0, max(n - stretch // 2, 1), stretch)
    sums = np.add.reduceat(marks[:, :2], cuts, axis=0)  # the last stretch takes what is left
    means = np.sort(sums / np.diff(np.append(cuts, n))[:, None], axis=0)
    window = min(n, 50)
    steps = range(0, n - window + 1, max(1, window // 2))
    diversity = sum(len(set(words[i : i + window])) for i in steps) / window**0.9 / len(steps)
    phrases = [k for p in STOP.split(text) if (k := len(p.split()))]
    return [
        float(n), letters, long, longest, short, diversity, rare, very_rare, connectives, clauses, text.count(",") / n, endings,
        math.log(sum(phrases) / max(len(phrases), 1) + 1.0),
        _between(means[:, 0], 0.5), _between(means[:, 1], 0.5), _between(means[:, 0], 0.25), _between(means[:, 0], 0.75),
    ]


# ---------------------------------------------------------------- proportional odds

@dataclass(frozen=True)
class OrdinalModel:
    """P(level <= k) = sigmoid(cut_k - x.w) on standardised features.

    A text of few words is weak evidence: its standardised features are shrunk by n / (n + SHRINK) towards the mean.
    """

    levels: tuple[int, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    cuts: tuple[float, ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _standard(x, np.array(self.mean), np.array(self.scale)) @ np.array(self.weights)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.levels)[(self.score(x)[:, None] > np.array(self.cuts)[None, :]).sum(axis=1)]

    def level(self, features: Column) -> Column:
        """The same prediction as a column over an array of features."""
        terms = [(features[i + 1] - F.lit(float(m))) * F.lit(float(w / s)) for i, (m, s, w) in enumerate(zip(self.mean, self.scale, self.weights))]
        score = sum(terms[1:], terms[0]) * (features[0] / (features[0] + F.lit(SHRINK)))
        level = F.lit(self.levels[0])
        for k, c in zip(self.levels[1:], self.cuts):
            level = F.when(score > F.lit(float(c)), F.lit(k)).otherwise(level)
        return F.when(features.isNotNull(), level)


def _standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return (x[:, 1:] - mean) / scale * (x[:, :1] / (x[:, :1] + SHRINK))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def fit_ordinal(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 200) -> OrdinalModel:
    """Cumulative-logit regression with an L2 penalty, by Newton steps with the outer-product information.

    x has rows as from document_features, y levels in any integers. Cut points are parametrised by their increments, so they stay in order.
    """
    levels = tuple(int(v) for v in np.unique(y))
    if len(levels) < 2:
        raise ValueError("labels of at least two levels are needed")
    mean, scale = x[:, 1:].mean(axis=0), x[:, 1:].std(axis=0)
    scale = np.where(scale > 1e-12, scale, 1.0)
    z = _standard(x, mean, scale)
    k, (n, p) = len(levels) - 1, z.shape
    rank = np.searchsorted(levels, y)
    share = np.cumsum(np.bincount(rank, minlength=k + 1))[:-1] / n
    theta = np.concatenate([np.log(share / (1 - share)), np.zeros(p)])

    def parts(theta: np.ndarray):
        cuts = np.concatenate([[-np.inf], theta[:k], [np.inf]])
        eta = z @ theta[k:]
        hi, lo = _sigmoid(cuts[rank + 1] - eta), _sigmoid(cuts[rank] - eta)
        return hi, lo, np.clip(hi - lo, 1e-12, None)

    def loss(theta: np.ndarray) -> float:
        if np.any(np.diff(theta[:k]) <= 0):
            return np.inf
        return -np.log(parts(theta)[2]).sum() + 0.5 * ridge * (theta[k:] ** 2).sum()

    now, step = loss(theta), 1.0
    for _ in range(rounds):
        hi, lo, prob = parts(theta)
        d_hi, d_lo = hi * (1 - hi), lo * (1 - lo)
        jac = np.zeros((n, k + p))  # derivative of each row's log probability
        inside, above = rank < k, rank > 0
        jac[np.nonzero(inside)[0], rank[inside]] = d_hi[inside]
        jac[np.nonzero(above)[0], rank[above] - 1] -= d_lo[above]
        jac[:, k:] = -(d_hi - d_lo)[:, None] * z
        jac /= prob[:, None]
        penalty = np.concatenate([np.zeros(k), np.full(p, ridge)])
        grad = -jac.sum(axis=0) + penalty * theta
        info = jac.T @ jac + np.diag(penalty + 1e-6)
        move = np.linalg.solve(info, grad)
        step = min(1.0, step * 2)
        while step > 1e-6 and not (new := loss(theta - step * move)) < now:
            step /= 2
        if step <= 1e-6 or now - new < 1e-8 * (1 + now):
            break
        theta, now = theta - step * move, new
    return OrdinalModel(levels, tuple(mean), tuple(scale), tuple(theta[k:]), tuple(theta[:k]))


# ---------------------------------------------------------------- over the corpus

def word_rarity(docs: DataFrame, text: str, least_share: float = 1e-5) -> dict[str, float]:
    """-log of a word's share of all words, for the words with at least least_share of them.

    All documents are counted, with one table of partial counts per task. At most 1 / least_share words can reach that
    share, so what comes to the driver has a bound; all rarer words take the value of the bound.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(words_of(t))
            if len(seen) > 200_000:
                yield pack(seen)
                seen = Counter()
        yield pack(seen)

    def pack(seen: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["w", "k"])

    counts = cut(docs.select(text).mapInArrow(count, "w string, k bigint").groupBy("w").agg(F.sum("k").alias("k")), "palabras")
    total = counts.agg(F.sum("k")).first()[0] or 0
    return {r["w"]: -math.log(r["k"] / total) for r in counts.where(F.col("k") >= least_share * total).collect()}


def feature_table(docs: DataFrame, doc_id: str, text: str, rarity: dict[str, float], floor: float) -> DataFrame:
    """(doc_id, rasgos): rasgos null for texts without words."""
    sent = docs.sparkSession.sparkContext.broadcast(rarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordTable(sent.value, floor)
        for b in batches:
            rows = [document_features(t, known) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "rasgos"])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text).mapInArrow(run, "doc_id bigint, rasgos array<double>")


def reading_levels(
    docs: DataFrame, doc_id: str, text: str, labels: DataFrame, label_id: str, level: str,
    least_share: float = 1e-5, max_labels: int = 20_000, ridge: float = 1.0,
) -> DataFrame:
    """(doc_id, nivel) of every document, nivel on the scale of the labels, null for texts without words.

    Word counts cover the whole corpus and features the whole text. The regression is fitted on the driver on at most
    max_labels labels, the least by a hash of the document's id; labels without a document, level or words are
    passed over, and a document labelled twice counts twice. Every document is then scored inside the JVM. The
    feature table is written once, as fitting and scoring both read it. Copies of a document get equal
    levels. Labels of fewer than two levels raise ValueError; an empty corpus gives no rows if labels are empty too.
    """
    rarity = word_rarity(docs, text, least_share)
    features = cut(feature_table(docs, doc_id, text, rarity, -math.log(least_share)), "rasgos")
    usable = labels.where(F.col(label_id).isNotNull() & F.col(level).isNotNull()).select(F.col(label_id).cast("bigint").alias("doc_id"), F.col(level).cast("int").alias("nivel"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "nivel").limit(max_labels)
    graded = features.join(sample, "doc_id").where(F.col("rasgos").isNotNull()).select("rasgos", "nivel").limit(max_labels).toPandas()
    if graded.empty and not features.limit(1).count():
        return features.select("doc_id", F.lit(None).cast("int").alias("nivel"))
    if graded.empty:
        raise ValueError("labels of at least two levels are needed")
    model = fit_ordinal(np.array(graded["rasgos"].tolist(), dtype=np.float64), graded["nivel"].to_numpy(), ridge)
    return features.select("doc_id", model.level(F.col("rasgos")).alias("nivel"))
