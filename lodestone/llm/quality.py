"""Quality: a sparse ensemble of rules over text statistics.

Fit: the statistics of a bounded, documented sample of labelled rows (``max_train``, those of smallest
hash) come to the driver. Small trees are boosted on random parts of it; every path from a root to a
node is a rule, a conjunction of comparisons. Lasso logistic regression over all rules keeps few of
them. Score: the statistics are Spark expressions, and so are the rules, ``CASE WHEN a AND b THEN weight``,
summed and squashed: the scan of the corpus stays in the JVM and has no shuffle.

Defined results: null and empty texts have statistics of 0 and get the score of those; rows with null
labels or texts teach nothing, and ties in the hash that bounds the sample go by label and statistics; of labels
repeated for a document the largest counts; an input column named as the score is replaced, all others stay
whatever their names; empty tables give empty tables; without both labels the score is the share of ones; repeated rows are
scored each; a null doc_id is not held out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.mixing import word_count
from lodestone.llm.toxicity import is_held_out

THRESHOLD = 0.3
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ"
MARKS = "!#$%&*|@^~<>=_{}[]\\/+"

Rule = tuple[tuple[str, bool, float], ...]  # (statistic, whether it is above, bound) each


def without(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


STATISTICS = ("words", "word_length", "upper", "digits", "marks", "stops", "distinct_words", "lines", "distinct_lines")


def with_statistics(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with a column for each of STATISTICS, and the prefix of their names, which no other column's name has.

    Texts are split once into words and once into lines.
    """
    prefix = "__q"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "q"
    own = {x: f"{prefix}_{x}" for x in ("text", "parts", "rows", "n")}
    t, w, rows, count = (F.col(own[x]) for x in own)
    step = docs.withColumn(own["text"], F.coalesce(F.col(f"`{text}`"), F.lit(""))).withColumn(own["parts"], F.split(t, r"[\x20\x09-\x0D]+", -1)).withColumn(own["rows"], F.split(t, "\n", -1)).withColumn(own["n"], word_count(t))
    n, chars = F.greatest(count, F.lit(1)).cast("double"), F.greatest(F.length(t), F.lit(1)).cast("double")
    stats = (
        F.log1p(count.cast("double")),
        F.length(t) / n,
        without(t, UPPER) / chars,
        without(t, "0123456789") / chars,
        without(t, MARKS) / chars,
        without(t, ".,;:?") / n,
        F.size(F.array_distinct(w)) / n,
        F.size(rows) / n,
        F.size(F.array_distinct(rows)) / F.size(rows).cast("double"),
    )
    values = [F.coalesce(v, F.lit(0.0)).cast("double").alias(f"{prefix}_{k}") for k, v in zip(STATISTICS, stats, strict=True)]
    return step.select(*[F.col(f"`{c}`") for c in docs.columns], *values), prefix


@dataclass
class Model:
    rules: list[Rule]
    weights: list[float]
    bias: float


def grow(x: np.ndarray, target: np.ndarray, depth: int, least: int) -> list[tuple]:
    """A regression tree as nested (feature, bound, mean, below, above) tuples; leaves are (mean,)."""
    mean = float(target.mean())
    if depth == 0 or len(target) < 2 * least:
        return (mean,)
    best = (1e-9, None)
    for j in range(x.shape[1]):
        at = np.argsort(x[:, j], kind="stable")
        v, sums, n = x[at, j], np.cumsum(target[at]), np.arange(1, len(at) + 1)
        gain = sums**2 / n + (sums[-1] - sums) ** 2 / np.maximum(1, len(at) - n) - sums[-1] ** 2 / len(at)
        gain[np.append(v[1:] == v[:-1], True)] = 0
        gain[: least - 1] = gain[len(at) - least :] = 0
        i = int(gain.argmax())
        if gain[i] > best[0]:
            best = (float(gain[i]), (j, float((v[i] + v[i + 1]) / 2)))
    if best[1] is None:
        return (mean,)
    j, bound = best[1]
    above = x[:, j] > bound
    return (j, bound, mean, grow(x[~above], target[~above], depth - 1, least), grow(x[above], target[above], depth - 1, least))


def predict(tree: tuple, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    above = x[:, tree[0]] > tree[1]
    return np.where(above, predict(tree[4], x), predict(tree[3], x))


def paths(tree: tuple, names: list[str], path: Rule = ()) -> list[Rule]:
    out = [path] if path else []
    if len(tree) > 1:
        for side, above in ((tree[3], False), (tree[4], True)):
            out += paths(side, names, (*path, (names[tree[0]], above, tree[1])))
    return out


def holds(rule: Rule, x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, above, bound in rule:
        v = x[:, names.index(name)]
        out &= v > bound if above else v <= bound
    return out


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 500) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty on all but the constant, by accelerated proximal gradients."""
    n, m = z.shape
    rate = 4.0 / (np.linalg.norm(np.column_stack((z, np.ones(n))), 2) ** 2 / n)
    w, v, t = np.zeros(m + 1), np.zeros(m + 1), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ v[:m] + v[m], -30, 30)))
        step = v - rate * np.append(z.T @ (p - y) / n, (p - y).mean())
        step[:m] = np.sign(step[:m]) * np.maximum(0, np.abs(step[:m]) - rate * penalty)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = step + (t - 1) / after * (step - w), step, after
    return w[:m], float(w[m])


def fit(labelled: DataFrame, text: str = "text", label: str = "label", max_train: int = 8000, key: str = "key", trees: int = 40, depth: int = 3, penalty: float = 0.002, seed: int = 5) -> Model:
    """Learn from at most ``max_train`` rows with label 0 or 1 and a text."""
    rows = labelled.where(F.col(label).isin(0, 1) & F.col(text).isNotNull())
    cut = rows.select(F.xxhash64(key).alias("h")).orderBy("h").limit(max_train).agg(F.max("h")).first()[0]
    if cut is None:
        return Model([], [], 0.0)
    table, prefix = with_statistics(rows.where(F.xxhash64(key) <= cut), text)
    names = list(STATISTICS)
    table = table.select(key, label, *[F.col(f"{prefix}_{n}").alias(n) for n in names])
    got = table.select(F.xxhash64(key).alias("h"), label, *names).orderBy("h", label, *names).limit(max_train).toArrow()
    y = got.column(label).to_numpy().astype(float)
    x = np.column_stack([got.column(n).to_numpy() for n in names])
    if y.min() == y.max():
        return Model([], [], 20.0 if y[0] else -20.0)
    rng = np.random.default_rng(seed)
    rules: dict[Rule, None] = {}
    z = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for _ in range(trees):
        some = rng.random(len(y)) < 0.5
        tree = grow(x[some], (y - 1 / (1 + np.exp(-z)))[some], depth, max(5, len(y) // 200))
        z += 2.0 * predict(tree, x)
        rules |= dict.fromkeys(paths(tree, names))
    every = list(rules)
    if not every:
        return Model([], [], float(np.log(y.mean() / (1 - y.mean()))))
    on = np.column_stack([holds(r, x, names) for r in every]).astype(float)
    mean, spread = on.mean(0), np.maximum(on.std(0), 1e-6)
    w, bias = lasso((on - mean) / spread, y, penalty)
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    return Model([every[i] for i in kept], [float(w[i] / spread[i]) for i in kept], bias - float((w * mean / spread).sum()))


def probability(model: Model, prefix: str) -> Column:
    """The ensemble as an expression over the statistics."""
    z = F.lit(model.bias)
    for rule, weight in zip(model.rules, model.weights, strict=True):
        test = F.lit(True)
        for name, above, bound in rule:
            test = test & (F.col(f"{prefix}_{name}") > bound if above else F.col(f"{prefix}_{name}") <= bound)
        z = z + F.when(test, weight).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with ``out``, the probability of label 1. An input column of that name is replaced."""
    table, prefix = with_statistics(docs.drop(out), text)
    return table.withColumn(out, probability(model, prefix)).drop(*[f"{prefix}_{n}" for n in STATISTICS])


def classify_documents(docs: DataFrame, labels: DataFrame, max_train: int = 8000) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (1 from THRESHOLD on)."""
    held = is_held_out(F.col("doc_id"), 5, 0)
    lab = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    train = docs.where(~held).select("doc_id", "text").join(lab, "doc_id").select(F.col("doc_id").alias("key"), "text", "label")
    scored = score(docs.select("doc_id", "text"), fit(train, max_train=max_train))
    return scored.select("doc_id", is_held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
