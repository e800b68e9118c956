"""Quality classifier: an SVM on n-gram indicators scaled by naive Bayes log-count ratios.

After Wang and Manning. Indicators of word n-grams and word-shape n-grams are
hashed into a fixed table. Spark counts, over all labelled training rows, the
documents of each class with each feature; the log ratio of these counts scales
the indicators. A linear hinge-loss model is then fitted by dual coordinate
descent (Hsieh et al.) on a bounded sample of labelled rows, and its margins are
turned into probabilities by a logistic curve on rows that the fit left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fits_broadcast, lower_ascii, mix64, ngrams, slices, tidy, word_hashes, words

FEATURE_BITS = 18
#: Labelled rows of each class that the model is fitted on at most; counts use all rows.
FIT_ROWS = 6000


def features(buf: np.ndarray, offs: np.ndarray):
    """Per document of a slice: its distinct feature numbers, ascending.

    Features are words and word pairs (A-Z lower-cased), the length class of
    words, and one to three neighbouring word shapes. A shape has the word's
    letter case, its closing ASCII sign, whether it has digits, and whether it
    repeats the word before it.
    """
    low = lower_ascii(buf)
    s, e, first = words(low, offs)
    if len(s):
        h = word_hashes(low, s, e)
        upper = np.add.reduceat(((buf >= 65) & (buf <= 90)).astype(np.int32), s)
        lower = np.add.reduceat((((buf >= 97) & (buf <= 122)) | (buf >= 128)).astype(np.int32), s)
        digit = np.add.reduceat(((buf >= 48) & (buf <= 57)).astype(np.int32), s)
        end = buf[e - 1].astype(np.uint64)
        sign = np.where((end < 128) & ~((low[e - 1] >= 97) & (low[e - 1] <= 122)) & ~((end >= 48) & (end <= 57)), end, np.uint64(0))
        case = np.where(upper == 0, np.where(lower > 0, 0, 1), np.where(lower == 0, 2, np.where(upper == 1, 3, 4))).astype(np.uint64)
        again = np.r_[False, h[1:] == h[:-1]]
        again[first[:-1][first[:-1] < len(h)]] = False
        shape = mix64(sign * np.uint64(64) + case * np.uint64(8) + (digit > 0).astype(np.uint64) * np.uint64(2) + again.astype(np.uint64) + np.uint64(1))
        length = mix64(np.minimum(e - s, 40).astype(np.uint64) // np.uint64(4) + np.uint64(1 << 20))
        kinds = [(h, 1), (ngrams(h, 2), 2), (shape, 1), (ngrams(shape, 2), 2), (ngrams(shape, 3), 3), (length, 1)]
        kinds = [((mix64(g + np.uint64(k)) >> np.uint64(64 - FEATURE_BITS)).astype(np.int32), n) for k, (g, n) in enumerate(kinds, 1)]
    for i in range(len(offs) - 1):
        a, b = int(first[i]), int(first[i + 1])
        yield np.unique(np.concatenate([g[a : b - n + 1] for g, n in kinds if b - a >= n])) if b > a else np.zeros(0, np.int32)


def _count(batches):
    """Rows (feature, n0, n1): documents of either class with each feature that the task has met; feature -1: all of its documents."""
    total = np.zeros((2, 1 << FEATURE_BITS), np.int64)
    seen = np.zeros(2, np.int64)
    for batch in batches:
        y = batch.column(1).to_numpy()
        for lo, _, buf, offs in slices(batch.column(0)):
            for k, f in enumerate(features(buf, offs)):
                total[y[lo + k], f] += 1
                seen[y[lo + k]] += 1
    if seen.any():
        met = np.flatnonzero(total.any(0))
        n0, n1 = (np.r_[seen[c], total[c, met]] for c in (0, 1))
        yield pa.record_batch([pa.array(np.r_[-1, met]), pa.array(n0), pa.array(n1)], names=["feature", "n0", "n1"])
    tidy()


def _featurize(batches):
    for batch in batches:
        y, key = batch.column(1), batch.column(2)
        for lo, hi, buf, offs in slices(batch.column(0)):
            rows = [f.tobytes() for f in features(buf, offs)]
            yield pa.record_batch([y[lo:hi], key[lo:hi], pa.array(rows, pa.binary())], names=["y", "key", "features"])


def dual_coordinate_descent(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int = 12, seed: int = 0) -> np.ndarray:
    """Weights (the last is the bias) of the linear SVM with hinge loss: min |w|^2/2 + sum cost * max(0, 1 - y w.x).

    x are a row's scaled indicators at length 1, and 1 for the bias. One dual
    variable changes at a time, to its best value within 0 and its cost.
    """
    w = np.zeros(len(scale) + 1)
    xs = [scale[f] for f in rows]
    xs = [x / max(float(np.sqrt(x @ x)), 1e-9) for x in xs]
    norm = np.array([float(x @ x) + 1 for x in xs])
    alpha = np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)):
            f, x = rows[i], xs[i]
            gradient = y[i] * (w[f] @ x + w[-1]) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[f] += step * x
                w[-1] += step
                most = max(most, abs(new - alpha[i]))
                alpha[i] = new
        if most < 1e-3:
            break
    return w


def logistic_curve(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and offset of P(1) = 1 / (1 + exp(-(slope * margin + offset))), by Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = weight * (p - y)
        h = weight * p * (1 - p)
        grad = np.array([g @ margin + 1e-3 * (a - 1), g.sum() + 1e-3 * b])
        hess = np.array([[h @ margin**2 + 1e-3, h @ margin], [h @ margin, h.sum() + 1e-3]])
        step = np.linalg.solve(hess, grad)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
        if abs(step).max() < 1e-6:
            break
    return max(float(a), 1e-3), float(b)


@dataclass(frozen=True)
class Model:
    """scale: log-count ratios; weight: scale times SVM weight. Both have one number a feature."""

    scale2: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    offset: float

    def scores(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        margin = np.array([float(self.weight[f].sum() / max(float(np.sqrt(self.scale2[f].sum())), 1e-9)) for f in features(buf, offs)]) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def _margins(w, scale, rows):
    return np.array([w[f] @ (scale[f] / max(float(np.sqrt(scale[f] @ scale[f])), 1e-9)) + w[-1] for f in rows])


def _fit(scale: np.ndarray, seen: tuple[int, int]):
    """One row with the model, from the sample's rows; a sample's rate by class is undone by weights."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("y", "ascending")])
        y = table.column("y").to_numpy().astype(int)
        rows = [np.frombuffer(x, np.int32) for x in table.column("features").to_pylist()]
        share = np.array([seen[c] / max(1, (y == c).sum()) for c in (0, 1)])
        calibrate = table.column("key").to_numpy() % 4 == 0
        if min(len(set(y[calibrate])), len(set(y[~calibrate]))) < 2:
            calibrate[:] = False
        fit = np.flatnonzero(~calibrate)
        per_class = np.array([max(1, (y[fit] == c).sum()) for c in (0, 1)])
        cost = (len(fit) / (2 * per_class))[y[fit]]
        w = dual_coordinate_descent([rows[i] for i in fit], scale, 2.0 * y[fit] - 1, cost)
        at = np.flatnonzero(calibrate) if calibrate.any() else fit
        margin = _margins(w, scale, [rows[i] for i in at])
        slope, offset = logistic_curve(margin, y[at].astype(float), share[y[at]] * len(at) / sum(seen))
        return pa.table({"weight": pa.array([(w[:-1] * scale).astype(np.float64).tobytes()], pa.binary()), "bias": [float(w[-1])], "slope": [slope], "offset": [offset]})

    return run


def _flat(p: float) -> Model:
    none = np.zeros(1 << FEATURE_BITS)
    return Model(none, none, 0.0, 1.0, float(np.log(p / (1 - p))))


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "label", key_col: str = "doc_id", fit_rows: int = FIT_ROWS) -> Model:
    """The model of rows (text, label 0 or 1, key). Other labels and null labels are ignored.

    Class counts cover all rows; at most about ``fit_rows`` rows of each class,
    by a hash of the key, are gathered in one task for the fit. Without rows of
    both classes every text gets the smoothed share of label 1.
    """
    rows = labelled.where(F.col(label_col).isin(0, 1)).select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(label_col).cast("int").alias("y"), F.pmod(F.xxhash64(F.col(key_col)), F.lit(1 << 30)).alias("key"))
    counted = rows.mapInArrow(_count, "feature long, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counted = counted.toArrow()  # two numbers a feature, whatever the rows
    number, counts = counted["feature"].to_numpy(), np.array([counted[c].to_numpy() for c in ("n0", "n1")])
    seen = tuple(int(x) for x in counts[:, number < 0].sum(1))
    if not all(seen):
        return _flat((seen[1] + 1) / (sum(seen) + 2))
    have = np.ones((2, 1 << FEATURE_BITS))
    have[:, number[number >= 0]] += counts[:, number >= 0]
    scale = np.log((have[1] / (seen[1] + 2)) / (have[0] / (seen[0] + 2)))
    rate = F.when(F.col("y") == 1, fit_rows / seen[1]).otherwise(fit_rows / seen[0])
    sample = rows.where(F.col("key") < rate * (1 << 30)).select("text", "y", "key")
    sample = sample.mapInArrow(_featurize, "y int, key long, features binary")
    got = sample.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_fit(scale, seen), "weight binary, bias double, slope double, offset double").first()
    return Model(scale**2, np.frombuffer(bytes(got.weight), np.float64), got.bias, got.slope, got.offset)


def score(docs: DataFrame, model: Model, text_col: str = "text"):
    """A column: probability of label 1 of each whole text, null texts as empty ones."""
    small = Model(model.scale2.astype(np.float32), model.weight.astype(np.float32), model.bias, model.slope, model.offset)

    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        out = [small.scores(buf, offs) for _, _, buf, offs in slices(texts)]
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return scores(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text is divisible by 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, label, doc_id) of labelled documents that aren't held out; a repeated label counts again."""
    known = labels.where(~held_out()).select(F.col("doc_id").alias("label_id"), F.col("quality").alias("label")).where("label is not null")
    side = F.broadcast(known) if fits_broadcast(known, 16) else known
    return docs.select("doc_id", "text").join(side, F.col("doc_id") == F.col("label_id")).select("text", "label", "doc_id")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """All rows and columns of ``docs`` with held_out, quality_score and quality_predicted (0 or 1).

    ``docs`` has its ids in doc_id and texts in text, ``labels`` (doc_id, quality). Null texts count as empty, and an
    empty text has the score that the model gives without features; a null id is held out as the empty text is, and meets no label.

    Scores come from texts alone. Rows with equal texts have equal scores. An
    empty table of documents gives no rows; an empty table of labels gives every
    text the score 0.5. Columns of ``docs`` with these names are replaced.
    """
    model = fit(training_rows(docs, labels))
    out = docs.withColumn("held_out", held_out()).withColumn("quality_score", score(docs, model))
    return out.withColumn("quality_predicted", (F.col("quality_score") >= threshold).cast("int"))
