"""Quality classifier: a generalised additive model with pairwise interactions over features of a text.

Each feature has a lookup table over its bins and each chosen pair of features a table over both.
Boosting visits the features in turn: a shallow tree over the bins of one feature is fitted to what
the model still misses, and a small step of it is added to that feature's table; the pairs follow
the same way. A score is the sum of one table entry per feature and pair, looked up by bin for
a whole batch at once.

The features come from the bytes and words of the whole text. The model is fitted on a bounded sample of labelled
rows (``max_rows``, those with the smallest hash of their id), so fitting costs the same at every
size; every document is scored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = (
    "bytes", "words", "word_length", "longest_word", "upper", "digit", "high", "space", "bang", "bar", "marks", "stops",
    "other_symbols", "distinct_words", "repeated_next", "words_ending_in_mark", "upper_words", "lines", "line_length", "distinct_lines",
)
_MARKS = b"#$%&*"
_ENDS = tuple(bytes([c]) for c in b"#$%&*|!")


def text_features(text: bytes) -> list[float]:
    """The features of one text in UTF-8; all zero for an empty one."""
    n = len(text)
    if not n:
        return [0.0] * len(FEATURES)
    count = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    upper, lower = count[65:91].sum(), count[97:123].sum()
    digit, high = count[48:58].sum(), count[128:].sum()
    space = count[9:14].sum() + count[32]
    marks = sum(count[c] for c in _MARKS)
    stops = count[ord(".")] + count[ord(",")]
    bang, bar = count[ord("!")], count[ord("|")]
    other = n - upper - lower - digit - high - space - marks - stops - bang - bar
    words = text.split()
    k = max(1, len(words))
    lines = text.split(b"\n")
    return [
        np.log1p(n), np.log1p(len(words)), (n - space) / k, np.log1p(max(map(len, words), default=0)),
        upper / max(1, upper + lower), digit / n, high / n, space / n, bang / k, bar / k, marks / k, stops / k, other / k,
        len(set(words)) / k, sum(a == b for a, b in zip(words, words[1:])) / k, sum(w.endswith(_ENDS) for w in words) / k,
        sum(w.isupper() for w in words) / k, np.log1p(len(lines)), np.log1p(n / len(lines)), len(set(lines)) / len(lines),
    ]


@dataclass
class AdditiveModel:
    """Cuts and tables per feature, tables per pair on coarser cuts, and the starting log-odds."""

    start: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for the rows of ``x``."""
        total = np.full(len(x), self.start)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.cuts[j], x[:, j], side="right")]
        for i, j, table in self.pairs:
            rows = np.searchsorted(self.coarse[i], x[:, i], side="right")
            total += table[rows, np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, bins) / bins))


def _best_cut(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """Gain and place of the best cut of bins with gradients ``g`` and weights ``h``; place 0: none."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1 if gain[at] > 1e-9 else 0


def _tree(g: np.ndarray, h: np.ndarray, ridge: float, leaves: int) -> np.ndarray:
    """Values per bin of a tree with up to ``leaves`` leaves, grown at the best cut."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        found = [(*_best_cut(g[a:b], h[a:b], ridge), a, b) for a, b in parts]
        _, at, a, b = max(found)
        if not at:
            break
        parts.remove((a, b))
        parts += [(a, a + at), (a + at, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def _quarters(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree with one cut along each of two features."""
    cg = np.pad(g.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    ch = np.pad(h.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    best = (0.0, 0, 0)
    parts = []
    for c in (cg, ch):
        a = c[1:-1, 1:-1]
        b, d = c[1:-1, -1:] - a, c[-1:, 1:-1] - a
        parts.append((a, b, d, c[-1, -1] - a - b - d))
    if parts[0][0].size:
        gain = sum(x**2 / (y + ridge) for x, y in zip(*parts)) - cg[-1, -1] ** 2 / (ch[-1, -1] + ridge)
        at = np.unravel_index(int(np.argmax(gain)), gain.shape)
        best = (float(gain[at]), int(at[0]) + 1, int(at[1]) + 1)
    out = np.zeros_like(g)
    _, r, c = best
    if r:
        for rows in (slice(0, r), slice(r, None)):
            for cols in (slice(0, c), slice(c, None)):
                out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + ridge)
    return best[0], out


def fit(
    x: np.ndarray, y: np.ndarray, bins: int = 48, rounds: int = 150, rate: float = 0.1, leaves: int = 3,
    n_pairs: int = 8, pair_bins: int = 10, pair_rounds: int = 50, ridge: float = 2.0,
) -> AdditiveModel:
    """Fit on the rows of ``x`` (finite numbers) and labels 0 or 1; without rows every score is one half."""
    ones = float(y.sum())
    model = AdditiveModel(start=float(np.log((ones + 1) / (len(y) - ones + 1))))
    if not 0 < ones < len(y):
        return model
    n, d = x.shape
    model.cuts = [_cuts(x[:, j], bins) for j in range(d)]
    model.coarse = [_cuts(x[:, j], pair_bins) for j in range(d)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    at = [np.searchsorted(model.cuts[j], x[:, j], side="right") for j in range(d)]
    total = np.full(n, model.start)

    def missing() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(d):
            g, h = missing()
            size = len(model.tables[j])
            step = rate * np.clip(_tree(np.bincount(at[j], g, size), np.bincount(at[j], h, size), ridge, leaves), -4, 4)
            model.tables[j] += step
            total += step[at[j]]
    low = [np.searchsorted(model.coarse[j], x[:, j], side="right") for j in range(d)]

    def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        g, h = missing()
        shape = len(model.coarse[i]) + 1, len(model.coarse[j]) + 1
        cell = low[i] * shape[1] + low[j]
        return cell, *(np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (g, h))

    ranked = sorted(((_quarters(*grid(i, j)[1:], ridge)[0], i, j) for i in range(d) for j in range(i)), reverse=True)
    model.pairs = [(i, j, np.zeros((len(model.coarse[i]) + 1, len(model.coarse[j]) + 1))) for _, i, j in ranked[:n_pairs]]
    for _ in range(pair_rounds):
        for i, j, table in model.pairs:
            cell, g, h = grid(i, j)
            step = rate * np.clip(_quarters(g, h, ridge)[1], -4, 4)
            table += step
            total += step.ravel()[cell]
    return model


def held_out(id_col: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text leaves 1 when divided by 3. A null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def features_column(text: Column) -> Column:
    @F.arrow_udf("array<double>")
    def features(texts: pa.Array) -> pa.Array:
        return pa.array([text_features(t.as_py() or b"") for t in texts], type=pa.list_(pa.float64()))

    return features(text.cast("binary"))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 20_000
) -> AdditiveModel:
    """Fit the model on at most ``max_rows`` labelled documents that are not held out.

    Labels that are null or neither 0 nor 1 and null ids are left out; a document with unlike labels counts
    with the smaller one. Of documents with the same id the one whose text has the smallest hash counts, once.
    """
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    sample = (
        usable.groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).alias("__label"))
        .orderBy(F.xxhash64(F.col("__id").cast("string")), "__id").limit(max_rows)
    )
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    # at most max_rows ids and labels are broadcast, and one row for each comes to the driver
    found = texts.join(F.broadcast(sample), "__id").groupBy("__id", "__label").agg(F.min(F.struct(F.xxhash64("__text"), "__text")).alias("__least"))
    rows = found.select("__id", "__label", features_column(F.col("__least.__text")).alias("x")).toPandas()
    if rows.empty:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    x = np.array(rows["x"].tolist(), dtype=np.float64)
    y = rows["__label"].to_numpy(dtype=np.float64)
    order = np.lexsort((*x.T, y, rows["__id"].astype(str)))
    return fit(x[order], y[order])


def score_column(text: Column, model: AdditiveModel) -> Column:
    """Score of each text, 0 to 1; a null text is scored as an empty one."""

    @F.arrow_udf("double")
    def quality(texts: pa.Array) -> pa.Array:
        x = np.array([text_features(t.as_py() or b"") for t in texts], dtype=np.float64).reshape(len(texts), len(FEATURES))
        return pa.array(model.score(x))

    return quality(text.cast("binary"))


def score_documents(docs: DataFrame, model: AdditiveModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, ``held_out``, ``score`` and ``predicted`` (1 from a score of one half).

    Null and empty texts get the score of a text without words. Repeated rows are scored each on
    their own, an empty table gives an empty result, and no column but the text enters a score.
    """
    scored = docs.select(F.col(id_col).alias("__id"), score_column(F.col(text_col), model).alias("score"))
    return scored.select(
        F.col("__id").alias(id_col), held_out(F.col("__id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, model: AdditiveModel, text_col: str = "text") -> DataFrame:
    """The documents that the model does not reject, with all their columns."""
    return docs.where(score_column(F.col(text_col), model) >= 0.5)
