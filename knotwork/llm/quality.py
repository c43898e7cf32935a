"""Quality classifier: a sparse rule ensemble over text statistics.

Boosted trees of small depth are fitted to the labelled statistics; every path from a root to a node is a rule, a
conjunction of thresholds. A lasso logistic regression over all rules and the (winsorised) statistics keeps few of them.
What it keeps is compiled into one Spark column over the statistics, so scoring a corpus runs no model code at all beyond
the statistics themselves.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from operator import eq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.llm.common import crc_mod, map_batches, materialize

#: The model is fitted to at most this many labelled rows, those with the smallest hash of their id.
FIT_ROWS = 20_000
TREES, DEPTH, BINS, SHRINK, LEAF = 60, 3, 32, 0.2, 20
PENALTIES = (0.03, 0.01, 0.003, 0.001)

STATISTICS = (
    "chars", "words", "word_length", "longest_word", "distinct_words", "top_word", "repeats", "lines", "line_length", "repeated_lines",
    "ended_lines", "letters", "capitals", "digits", "spaces", "stops", "symbols", "bars", "non_ascii", "entropy", "bigrams", "short_words",
)


def statistics(text: str | None) -> list[float]:
    """STATISTICS of a whole text; null and empty texts have zeros."""
    import numpy as np

    raw = (text or "").encode()
    if not raw:
        return [0.0] * len(STATISTICS)
    words = raw.split()
    seen = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n, w, k = len(raw), max(len(words), 1), max(len(lines), 1)
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    capitals, small, high = int(by[65:91].sum()), int(by[97:123].sum()), int(by[128:].sum())
    digits, spaces = int(by[48:58].sum()), int(by[32] + by[9:14].sum())
    stops = int(by[44] + by[46])
    share = by[by > 0] / n
    return [
        float(n), float(len(words)), (n - spaces) / w, float(max(map(len, words), default=0)), len(seen) / w, max(seen.values(), default=0) / w,
        sum(map(eq, words, words[1:])) / w, float(len(lines)), n / k, 1 - len(set(lines)) / k,
        sum(x.rstrip()[-1:] in b".!?" for x in lines) / k, (capitals + small + high) / n, capitals / n, digits / n, spaces / n, stops / n,
        (n - capitals - small - high - digits - spaces - stops) / n, int(by[124]) / n, high / n, float(-(share * np.log2(share)).sum()),
        len(set(zip(words, words[1:], strict=False))) / max(w - 1, 1), sum(len(x) <= 2 for x in words) / w,
    ]


def with_statistics(docs: DataFrame, text_col: str, keep: list[str], stats_col: str = "stats") -> DataFrame:
    """The columns keep of docs and stats_col, an array of STATISTICS."""
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    schema = StructType([docs.schema[c] for c in keep] + [StructField(stats_col, ArrayType(DoubleType()))])
    # a text that is kept is sent once
    rows, at_text = (docs.select(*keep), keep.index(text_col)) if text_col in keep else (docs.select(*keep, F.col(text_col).alias("_text")), len(keep))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            text = batch.column(at_text)
            for at in range(0, batch.num_rows, 1024):
                found = [statistics(x) for x in text.slice(at, 1024).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(at, 1024) for k in range(len(keep))), pa.array(found, pa.list_(pa.float64()))], names=schema.names)

    return map_batches(rows, run, schema)


@dataclass
class RuleEnsemble:
    """weights of rules [((statistic, above, threshold), ...)] and of statistics clipped to (low, high) and scaled."""

    bias: float
    rules: list[tuple[tuple[tuple[int, bool, float], ...], float]] = field(default_factory=list)
    linear: list[tuple[int, float, float, float]] = field(default_factory=list)

    def column(self, stats: Column) -> Column:
        """The score, in (0, 1), as an expression over the array of statistics."""
        total = F.lit(self.bias)
        for conditions, weight in self.rules:
            test = F.lit(True)
            for at, above, threshold in conditions:
                test = test & ((stats[at] > threshold) if above else (stats[at] <= threshold))
            total = total + F.when(test, weight).otherwise(0.0)
        for at, low, high, weight in self.linear:
            total = total + F.least(F.greatest(stats[at], F.lit(low)), F.lit(high)) * weight
        return 1 / (1 + F.exp(-total))

    def scores(self, x):
        """The same as column(), over a matrix of statistics."""
        import numpy as np

        total = np.full(len(x), self.bias)
        for conditions, weight in self.rules:
            total += weight * rule_mask(x, conditions)
        for at, low, high, weight in self.linear:
            total += np.clip(x[:, at], low, high) * weight
        return 1 / (1 + np.exp(-total))


def rule_mask(x, conditions):
    import numpy as np

    held = np.ones(len(x), bool)
    for at, above, threshold in conditions:
        held &= (x[:, at] > threshold) == above
    return held


def grow_rules(x, y):
    """Rules of boosted trees: for each, the conditions on the path to a node below the root."""
    import numpy as np

    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)])
    rules: dict[tuple, None] = {}
    margin = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = y - p, p * (1 - p) + 1e-6
        nodes = [(np.arange(len(y)), ())]
        for depth in range(DEPTH + 1):
            below = []
            for rows, path in nodes:
                if path:
                    rules[tuple(sorted(path))] = None
                best = (1e-3, None)
                if depth < DEPTH and len(rows) >= 2 * LEAF:
                    g, h = gradient[rows], weight[rows]
                    whole = g.sum() ** 2 / (h.sum() + 1)
                    for k, e in enumerate(edges):
                        if not len(e):
                            continue
                        b = binned[k, rows]
                        gs, hs, ns = (np.cumsum(np.bincount(b, v, len(e) + 1))[:-1] for v in (g, h, np.ones(len(rows))))
                        gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - whole
                        gain[(ns < LEAF) | (len(rows) - ns < LEAF)] = -1
                        at = int(gain.argmax())
                        if gain[at] > best[0]:
                            best = (gain[at], (k, at))
                if best[1] is None:
                    margin[rows] += SHRINK * gradient[rows].sum() / (weight[rows].sum() + 1)
                    continue
                k, at = best[1]
                left = binned[k, rows] <= at
                below += [(rows[left], (*path, (k, False, float(edges[k][at])))), (rows[~left], (*path, (k, True, float(edges[k][at]))))]
            nodes = below
    return list(rules)


def lasso_logistic(z, y, penalty: float, rounds: int = 300):
    """(weights, bias) by accelerated proximal gradient; z has columns of unit scale."""
    import numpy as np

    n, w, b = len(y), np.zeros(z.shape[1]), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    v = np.ones(z.shape[1])
    for _ in range(20):  # the largest curvature
        v = z.T @ (z @ v)
        v /= np.linalg.norm(v) + 1e-12
    step = 1 / (0.25 * (np.linalg.norm(z @ v) ** 2 / n + 1) + 1e-9)
    look, t = w.copy(), 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(z @ look + b)))
        new = look - step * (z.T @ (p - y)) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        b -= step * float((p - y).mean())
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        look, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w, b


def fit(x, y) -> RuleEnsemble:
    """A rule ensemble for statistics x and labels y (0 or 1); the penalty is chosen on every fifth row, then all are used.

    Without rows, or with one class only, the score is constant.
    """
    import numpy as np

    if len(y) < 2 * LEAF or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return RuleEnsemble(float(np.log(share / (1 - share))))
    test = np.arange(len(y)) % 5 == 4
    if y[~test].min() == y[~test].max() or test.sum() < 1:
        test[:] = False
    rules = grow_rules(x[~test], y[~test])
    low, high = np.quantile(x, 0.025, axis=0), np.quantile(x, 0.975, axis=0)
    columns = np.concatenate([np.stack([rule_mask(x, r) for r in rules], 1).astype(float) if rules else np.zeros((len(x), 0)), np.clip(x, low, high)], 1)
    scale, mean = columns.std(0), columns.mean(0)
    used = np.flatnonzero(scale > 1e-9)
    z = (columns[:, used] - mean[used]) / scale[used]
    best = (np.inf, PENALTIES[-1])
    for penalty in PENALTIES if test.any() else ():
        w, b = lasso_logistic(z[~test], y[~test], penalty)
        p = np.clip(1 / (1 + np.exp(-(z[test] @ w + b))), 1e-6, 1 - 1e-6)
        best = min(best, (float(-(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p)).mean()), penalty))
    w, b = lasso_logistic(z, y, best[1])
    weights = np.zeros(columns.shape[1])
    weights[used] = w / scale[used]
    bias = float(b - (weights * mean).sum())
    kept = [(r, float(v)) for r, v in zip(rules, weights, strict=False) if v]
    linear = [(k, float(low[k]), float(high[k]), float(v)) for k, v in enumerate(weights[len(rules) :]) if v]
    return RuleEnsemble(bias, kept, linear)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = FIT_ROWS, fold: tuple[int, int] = (3, 1)) -> RuleEnsemble:
    """Fits to labelled documents outside the held-out fold (crc32 of the id modulo fold[0] is fold[1]).

    Labels that are null, not 0 or 1, or of unknown ids are not used; of an id with several labels the mean decides
    (a tie counts as 1). At most `rows` labelled ids are sampled, by hash, and of documents that share an id the one with
    the least statistics is taken, so the driver holds a matrix of at most `rows` rows.
    """
    import numpy as np

    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).filter((crc_mod(F.col("id"), fold[0]) != fold[1]) & F.col("label").isin(0, 1))
    sample = known.groupBy("id").agg((F.avg("label") >= 0.5).cast("double").alias("label")).orderBy(F.xxhash64("id"), "id").limit(rows)
    sample = materialize(sample, "labelled-sample")
    joined = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")
    found = with_statistics(joined, "text", ["id", "label"]).groupBy("id").agg(F.min("stats").alias("stats"), F.first("label").alias("label")).orderBy("id").toPandas()
    x = np.array(found["stats"].tolist(), float).reshape(len(found), len(STATISTICS))
    return fit(x, found["label"].to_numpy(float))


def score(docs: DataFrame, model: RuleEnsemble, id_col: str = "doc_id", text_col: str = "text", fold: tuple[int, int] = (3, 1)) -> DataFrame:
    """One row per row of docs: id_col, held_out, score (0 to 1), predicted. Null texts score as empty ones."""
    value = model.column(F.col("stats"))
    stats = with_statistics(docs, text_col, [id_col])
    scored = stats.select(id_col, (crc_mod(F.col(id_col), fold[0]) == fold[1]).alias("held_out"), value.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, model: RuleEnsemble, text_col: str = "text") -> DataFrame:
    """docs with its own columns, without the rows that the model rejects (score below 0.5).

    Null texts are judged as empty ones; rows that repeat are judged alike; ids are not read, so null and repeated ids change
    nothing; an empty table stays empty. No column of docs may be named _quality_stats.
    """
    stats = with_statistics(docs, text_col, docs.columns, "_quality_stats")
    return stats.filter(model.column(F.col("_quality_stats")) >= 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])
