"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

Grades are ordered: 0 clean, then mild to severe. One weight vector is shared by all thresholds,
``P(grade > k) = sigmoid(x . w - t_k)`` with ``t_0 < t_1 < …``, and the expected severity is the sum of these over ``k``.
Features are the presence of words (lower-cased letters) and of four letters in a row within words (a word's begin counts
as a letter) that go with toxic or with clean labels; weights have either sign.

Labels say only whether a text is toxic, so the order among toxic texts comes from evidence that the model to be fitted
does not see: labelled texts fall into folds by a hash of their id, a model of two grades fitted on the other folds gives
each text its log-odds, and toxic texts are graded by the quantiles of these (``grades`` classes of equal numbers; a
toxic label above 1 is taken as it is). Folds without both kinds of label keep two grades. The severity from which a text
is rejected is chosen on held-out folds too: the lowest at which the clean texts kept are at least ``keep`` of all.

The model is fitted on at most ``sample`` labelled documents (those of the lowest hashes of ``doc_id``, one text an id).
Features are counted by fold and label on the executors; only those that go with a label in some set of
folds on which a model is fitted, and the texts that have them, come to the driver. Scoring reads every whole text.

Defined cases: a null or empty text has no features and scores by the thresholds alone (clean); without any labels, or
with labels of one grade only, every document is clean with severity 0; null labels and labels of unknown documents are
left out; repeated documents each get a row; other columns are not read.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.llm import common

_letters = re.compile(r"[^\W\d_]+").findall
_GRAM = 4
_GRADES = 2
#: A feature counts if so many texts have it, and if its likelihood ratio's signed root is so large.
_OFTEN, _STRONG = 3, 3.5
_FOLDS = 4


def words_of(text: str) -> set[str]:
    return set(_letters(text.lower()))


class _Known(dict):
    """The features of words, of all or of those with a weight: the word, and its runs of four letters behind a mark.

    The begin of a word counts as a letter. Forgotten when too many.
    """

    def __init__(self, weights: dict[str, float] | None = None):
        self.all = weights is None
        self.words = frozenset(f for f in weights or () if not f.startswith("~"))
        self.runs = frozenset(f[1:] for f in weights or () if f.startswith("~"))

    def __missing__(self, word: str) -> tuple[str, ...]:
        marked = "^" + word
        if self.all:
            own = (word, *{"~" + marked[i : i + _GRAM] for i in range(len(marked) - _GRAM + 1)})
        else:
            runs = self.runs
            own = tuple(["~" + g for i in range(len(marked) - _GRAM + 1) if (g := marked[i : i + _GRAM]) in runs])
            if word in self.words:
                own = (word, *own)
        if len(word) <= 64:
            if len(self) > 200_000:
                self.clear()
            self[word] = own
        return own

    def of(self, words: set[str]) -> list[str]:
        return sorted({f for w in words for f in self[w]})


@dataclass
class OrdinalModel:
    """Shared weights of features and ordered thresholds."""

    weights: dict[str, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=list)
    reject: float = 0.5  # the expected severity from which a text is rejected

    def odds(self, words: set[str], known: _Known | None = None) -> float:
        """What the words say, before any threshold; ``known`` keeps what is known of a word from text to text."""
        return sum(self.weights[f] for f in (_Known(self.weights) if known is None else known).of(words))

    def above(self, odds: float) -> list[float]:
        """The chance of each threshold to be passed."""
        return [1 / (1 + math.exp(-min(60.0, max(-60.0, odds - t)))) for t in self.thresholds]

    def severity(self, text: str, known: _Known | None = None) -> tuple[float, int]:
        """Expected severity, and the grade: 0 below ``reject``, otherwise the likeliest from 1 up."""
        if not self.thresholds:
            return 0.0, 0
        above = self.above(self.odds(words_of(text), known))
        chances = [a - b for a, b in zip(above, [*above[1:], 0.0], strict=True)]
        expected = sum(above)
        return expected, 1 + chances.index(max(chances)) if expected >= self.reject else 0


@dataclass
class Bag:
    """Features of texts: ``rows`` and ``columns`` of those present, in order of the rows."""

    rows: np.ndarray
    columns: np.ndarray
    codes: np.ndarray
    texts: int

    @classmethod
    def of(cls, rows: np.ndarray, codes: np.ndarray, texts: int) -> Bag:
        """From pairs of a text's number and a feature, each once."""
        own, columns = np.unique(codes, return_inverse=True)
        order = np.lexsort((columns, rows))
        return cls(rows[order], columns[order], own, texts)

    def among(self, texts: np.ndarray) -> Bag:
        """The texts of a mask."""
        kept = texts[self.rows]
        return Bag((np.cumsum(texts) - 1)[self.rows[kept]], self.columns[kept], self.codes, int(texts.sum()))

    def odds(self, model: OrdinalModel) -> np.ndarray:
        weight = np.array([model.weights.get(c, 0.0) for c in self.codes.tolist()])
        return np.bincount(self.rows, weight[self.columns], self.texts) if len(self.rows) else np.zeros(self.texts)


def fit(sets: list[set[str]], labels: list[int]) -> OrdinalModel:
    """A model of texts given as sets of words."""
    known = _Known()
    codes = [known.of(x) for x in sets]
    rows = np.repeat(np.arange(len(sets)), [len(c) for c in codes])
    return fit_bag(Bag.of(rows, np.array([c for own in codes for c in own], object), len(sets)), np.array(labels, np.int64))


def fit_bag(bag: Bag, y: np.ndarray, vocabulary: int = 4096, least: int = _OFTEN, ridge: float = 0.5, steps: int = 400) -> OrdinalModel:
    """Fit by gradient steps on the likelihood with a ridge on the weights."""
    n, toxic = len(y), int((y > 0).sum())
    if not toxic or toxic == n or not len(bag.rows):
        return OrdinalModel()
    k = np.bincount(bag.columns, minlength=len(bag.codes)).astype(float)
    a = np.bincount(bag.columns, (y > 0)[bag.rows], len(bag.codes))
    rate = toxic / n
    # signed root of the likelihood ratio of a feature against independence
    tables = ((a, k * rate), (k - a, k * (1 - rate)), (toxic - a, toxic * (1 - k / n)), (n - toxic - k + a, (n - toxic) * (1 - k / n)))
    g = sum(np.where((o > 0) & (e > 0), o * np.log(np.maximum(o, 1e-9) / np.maximum(e, 1e-9)), 0.0) for o, e in tables)
    strength = np.where(k >= least, np.sqrt(np.maximum(2 * g, 0)), 0.0)
    chosen = [i for i in np.lexsort((np.arange(len(k)), -strength)).tolist()[:vocabulary] if strength[i] > _STRONG]
    if not chosen:
        return OrdinalModel()
    column = np.full(len(bag.codes), -1)
    column[chosen] = np.arange(len(chosen))
    inside = column[bag.columns] >= 0
    rows, cols = bag.rows[inside], column[bag.columns[inside]]
    grades = int(y.max())
    w = np.zeros(len(chosen))
    share = np.array([(y > k).mean() for k in range(grades)])
    t = -np.log(np.clip(share, 1e-4, 1 - 1e-4) / (1 - np.clip(share, 1e-4, 1 - 1e-4)))
    gap = np.log(np.maximum(np.diff(t), 0.1))  # thresholds: the first, then positive gaps
    first = t[0]
    state = [np.zeros(len(w) + grades), np.zeros(len(w) + grades)]
    at = np.arange(n)
    for step in range(1, steps + 1):
        t = first + np.concatenate([[0.0], np.cumsum(np.exp(gap))])
        score = np.bincount(rows, w[cols], n)
        s = 1 / (1 + np.exp(-np.clip(score[:, None] - t[None, :], -30, 30)))
        cumulative = np.hstack([np.ones((n, 1)), s, np.zeros((n, 1))])
        slope = np.hstack([np.zeros((n, 1)), s * (1 - s), np.zeros((n, 1))])
        chance = np.maximum(cumulative[at, y] - cumulative[at, y + 1], 1e-9)
        d_score = (slope[at, y] - slope[at, y + 1]) / chance
        ratio = slope / chance[:, None]
        d_t = np.array([ratio[y == k, k + 1].sum() - ratio[y == k + 1, k + 1].sum() for k in range(grades)])
        g_w = np.bincount(cols, d_score[rows], len(w)) / n - ridge * w / n
        g_t = np.concatenate([[d_t.sum()], [np.exp(gap[j]) * d_t[j + 1 :].sum() for j in range(grades - 1)]]) / n
        g = np.concatenate([g_w, g_t])
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.99 * state[1] + 0.01 * g * g
        move = 0.1 * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
        w, first, gap = w + move[: len(w)], first + move[len(w)], gap + move[len(w) + 1 :]
    t = first + np.concatenate([[0.0], np.cumsum(np.exp(gap))])
    return OrdinalModel({str(bag.codes[i]): float(v) for i, v in zip(chosen, w, strict=True)}, [float(x) for x in t])


def graded(bag: Bag, labels: np.ndarray, fold: np.ndarray, grades: int = _GRADES) -> np.ndarray:
    """Labels with each toxic one (1) as a grade from 1 up, by quantiles of its log-odds under models of the other folds."""
    odds = np.full(len(labels), np.nan)
    for f in np.unique(fold).tolist():
        own, others = fold == f, fold != f
        model = fit_bag(bag.among(others), (labels[others] > 0).astype(np.int64))
        if model.thresholds:
            odds[own] = bag.among(own).odds(model) - model.thresholds[0]
    known = (labels == 1) & ~np.isnan(odds)
    out = labels.copy()
    if known.any():
        cuts = np.quantile(odds[known], [k / grades for k in range(1, grades)])
        out[known] = 1 + np.searchsorted(cuts, odds[known], "right")
    return out


def held_out(bag: Bag, labels: np.ndarray, fold: np.ndarray, grades: int = _GRADES) -> np.ndarray:
    """Each text's expected severity under a model fitted on the other folds alone, grading included."""
    out = np.zeros(len(labels))
    for f in np.unique(fold).tolist():
        own, others = fold == f, fold != f
        known = bag.among(others)
        model = fit_bag(known, graded(known, labels[others], fold[others], grades))
        out[own] = [sum(model.above(x)) for x in bag.among(own).odds(model).tolist()]
    return out


def cut_for(severities: np.ndarray, labels: np.ndarray, keep: float) -> float:
    """The lowest severity at which at least ``keep`` of the clean texts stay: half-way to the next higher one."""
    clean = np.sort(severities[labels == 0])
    if not len(clean):
        return 0.5
    last = float(clean[max(0, math.ceil(keep * len(clean)) - 1)])
    above = severities[severities > last]
    return (last + float(above.min())) / 2 if len(above) else last + 0.5


def learn(bag: Bag, y: np.ndarray, fold: np.ndarray, keep: float = 0.995) -> OrdinalModel:
    """Fit on all the labelled texts, with grades and the cut for rejection from held-out folds."""
    if not bag.texts:
        return OrdinalModel()
    model = fit_bag(bag, graded(bag, y, fold))
    if model.thresholds:
        model.reject = cut_for(held_out(bag, y, fold), y, keep)
    return model


@common.releasing
def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _Known()
    for rows, texts in common.documents_in_pieces(batches, 3):
        yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array([known.of(words_of(t)) for t in texts], pa.list_(pa.string()))], ["doc_id", "label", "fold", "codes"])


def labelled(docs: DataFrame, labels: DataFrame, sample: int = 8000) -> DataFrame:
    """``doc_id, label, fold, codes`` of at most ``sample`` labelled documents, one text for each id, settled."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).where("doc_id is not null and label is not null and label >= 0")
    few = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")  # sample rows at most
    once = chosen.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(_FOLDS)).cast("int")
    return common.settle(once.select("doc_id", "label", fold.alias("fold"), "text").mapInArrow(_features, "doc_id long, label int, fold int, codes array<string>"), "toxicity-features")


def gathered(texts: DataFrame, most: int = 4096) -> tuple[Bag, np.ndarray, np.ndarray]:
    """The labelled texts as a bag, with labels and folds: of features that count in some set of folds, the strongest ``most``.

    Models are fitted on all folds and on all but one or two of them; a feature's strength is the greatest of these.
    """
    heads = texts.select("doc_id", "label", "fold").toArrow()  # one row a text, at most the sample
    ids, labels, folds = (heads.column(c).to_numpy() for c in range(3))
    order = np.argsort(ids)
    ids, labels, folds = ids[order], labels[order].astype(np.int64), folds[order].astype(np.int64)
    toxic = [[int(((folds == f) & ((labels > 0) == bad)).sum()) for bad in (False, True)] for f in range(_FOLDS)]
    exploded = texts.select("doc_id", "label", "fold", F.explode("codes").alias("code"))
    count = exploded.groupBy("code").agg(*(F.count_if((F.col("fold") == f) & ((F.col("label") > 0) == F.lit(bad))).alias(f"n{f}{int(bad)}") for f in range(_FOLDS) for bad in (False, True)))
    subsets = [s for left_out in range(3) for s in itertools.combinations(range(_FOLDS), _FOLDS - left_out)]
    chosen = []
    for own in subsets:
        n, t = sum(sum(toxic[f]) for f in own), sum(toxic[f][1] for f in own)
        if 0 < t < n:
            chosen.append(F.struct(F.lit(float(n)).alias("n"), F.lit(float(t)).alias("t"), *(F.lit(float(f in own)).alias(f"f{f}") for f in range(_FOLDS))))

    def strength_in(s: Column) -> Column:
        a, c = (sum((F.col(f"n{f}{bad}") * s[f"f{f}"] for f in range(_FOLDS)), F.lit(0.0)) for bad in (1, 0))
        n, t = s["n"], s["t"]
        cells = F.array(*(F.struct(o.alias("o"), e.alias("e")) for o, e in ((a, (a + c) * t / n), (c, (a + c) * (n - t) / n), (t - a, t * (1 - (a + c) / n)), ((n - t) - c, (n - t) * (1 - (a + c) / n)))))
        ratio = F.aggregate(cells, F.lit(0.0), lambda x, y: x + F.when((y["o"] > 0) & (y["e"] > 0), y["o"] * F.log(y["o"] / y["e"])).otherwise(0.0))
        return F.when(a + c >= _OFTEN, F.sqrt(F.greatest(2 * ratio, F.lit(0.0)))).otherwise(0.0)

    found = (np.zeros(0, np.int64), np.zeros(0, object))
    if chosen:
        strength = F.array_max(F.transform(F.array(*chosen), strength_in))
        strong = count.select("code", strength.alias("strength")).where(F.col("strength") > _STRONG).orderBy(F.desc("strength"), "code").limit(most).select("code")
        pairs = exploded.select("doc_id", "code").join(F.broadcast(strong), "code").select("doc_id", "code").toArrow()
        found = (np.searchsorted(ids, pairs.column(0).to_numpy()), pairs.column(1).to_numpy(zero_copy_only=False))
    return Bag.of(*found, len(ids)), labels, folds


def train(docs: DataFrame, labels: DataFrame, sample: int = 8000) -> OrdinalModel:
    """Fit on at most ``sample`` labelled documents; their number bounds what is broadcast and what is gathered."""
    return learn(*gathered(labelled(docs, labels, sample)))


def severity(docs: DataFrame, model: OrdinalModel, reject: float | None = None) -> DataFrame:
    """All columns of ``docs`` with ``severity double, grade int, toxic boolean``; toxic is a severity of ``reject`` (the model's own) or more.

    Where ``docs`` has a column of such a name, the new one is called the same with underscores at its end.
    """
    names = common.fresh(docs.columns, "severity", "grade", "toxic")
    reject = model.reject if reject is None else reject
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(model.weights)
        for rows, texts in common.documents_in_pieces(batches, at):
            found = [model.severity(t, known) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array([s for s, _ in found], pa.float64()), pa.array([g for _, g in found], pa.int32()), pa.array([s >= reject for s, _ in found], pa.bool_())],
                [*rows.schema.names, *names],
            )

    fields = docs.schema.fields
    schema = type(docs.schema)([*fields])
    for name, kind in zip(names, ("double", "integer", "boolean"), strict=True):
        schema = schema.add(name, kind)
    return docs.mapInArrow(run, schema)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, common.table(spark, sf_dir, "labels"))
    return severity(docs, model).select("doc_id", "severity", "grade", "toxic", (~F.col("toxic")).alias("kept"))
