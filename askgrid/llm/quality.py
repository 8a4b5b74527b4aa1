"""Quality classifier by compression.

Two zstandard dictionaries are made from text labelled good and bad. A text is compressed block by
block with each of them; blocks keep a long text from becoming its own dictionary. The difference of
both sizes per byte says which dictionary knows the text better. A logistic model turns it into a
probability, together with the size per byte under the good dictionary, the size per byte of the
whole text without one (very repetitive text needs little under either) and the text's length.

A text that a dictionary was made from would be known to it word for word. So there are two pairs of
dictionaries, from texts told apart by a hash of the text, and the pair that knows a text less decides.

Model size is bounded: `DICTIONARY_ROWS` stretches of text per dictionary, `FIT_ROWS` labelled rows to
fit the logistic model. Both are drawn by a hash of the id, from disjoint rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askgrid.session import materialise

DICTIONARY_ROWS = 1024
STRETCH = 2048
FIT_ROWS = 20_000
BLOCK = 1024
LEVEL = 3
FOLDS, HELD_OUT = 3, 1
_FEATURES = 4


@dataclass
class QualityModel:
    """Dictionaries and the logistic model. `weights` is None if there was nothing to tell apart."""

    good: list[bytes]
    bad: list[bytes]
    low: np.ndarray
    high: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray | None
    base: float

    def probabilities(self, features: np.ndarray) -> np.ndarray:
        """Probability of label 1; features are kept within the range seen when fitting."""
        if self.weights is None:
            return np.full(len(features), self.base)
        design = _design(np.clip(features, self.low, self.high))
        return _logistic(((design - self.mean) / self.spread) @ self.weights)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _design(x: np.ndarray) -> np.ndarray:
    """Features, their squares and products, and a constant."""
    columns = [np.ones(len(x))] + [x[:, i] for i in range(_FEATURES)]
    columns += [x[:, i] * x[:, j] for i in range(_FEATURES) for j in range(i, _FEATURES)]
    return np.stack(columns, axis=1)


class _Sizes:
    """Compressed sizes of a text."""

    def __init__(self, good: list[bytes], bad: list[bytes]):
        self.pairs = []
        for pair in zip(good, bad, strict=True):
            both = []
            for content in pair:
                known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                known.precompute_compress(LEVEL)
                compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False)
                both.append(compressor.compress)
            self.pairs.append(both)
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)

    def features(self, texts: list[str | None]) -> np.ndarray:
        rows = np.zeros((len(texts), _FEATURES))
        for i, text in enumerate(texts):
            data = (text or "").encode("utf-8", "surrogatepass")
            if not data:
                continue
            blocks = [data[at : at + BLOCK] for at in range(0, len(data), BLOCK)]
            sizes = [
                (sum([len(good(b)) for b in blocks]), sum([len(bad(b)) for b in blocks]))
                for good, bad in self.pairs
            ]
            by_good, by_bad = max(sizes, key=sum)
            size = len(data)
            rows[i] = (
                (by_bad - by_good) / size, by_good / size, len(self.plain.compress(data)) / size, np.log(size),
            )
        return rows


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from. A row without an id is not held out, nor labelled."""
    fold = F.crc32(doc_id.cast("string").cast("binary")) % FOLDS
    return F.coalesce(fold == HELD_OUT, F.lit(False))


def fit_quality(
    docs: DataFrame, labels: DataFrame, dictionary_rows: int = DICTIONARY_ROWS, fit_rows: int = FIT_ROWS
) -> QualityModel:
    """Learn from `labels` (doc_id, quality 0 or 1) outside the held-out fold and the texts they name.

    At most 2 * `dictionary_rows` + `fit_rows` labelled rows are used, drawn by a hash of their id,
    those for the dictionaries from one half of the ids and those for the fit from the other. Rows
    with a null id or label are not used; repeated labels count once; a document with both labels
    counts as both; of several documents with one id the text of least digest is used. If either label is missing, every text gets the share of label 1 among the rows
    drawn (0.5 without any).
    """
    known = (
        labels.where(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1))
        .select("doc_id", F.col("quality").cast("int").alias("quality"))
        .distinct()
        .withColumn("draw", F.xxhash64("doc_id", F.lit("quality")))
    )
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(4)) == 0
    parts = [
        known.where(half & (F.col("quality") == q)).orderBy("draw", "doc_id").limit(dictionary_rows)
        for q in (1, 0)
    ]
    parts.append(known.where(~half).orderBy("draw", "doc_id", "quality").limit(fit_rows))
    drawn = parts[0].union(parts[1]).withColumn("use", F.lit("dictionary")).union(
        parts[2].withColumn("use", F.lit("fit"))
    )
    drawn = materialise(drawn, "labelled_sample")
    # The sample's size is bounded by the parameters, so it may go to every task. Of the rows with one id
    # one text stays, that of least digest, so repeated rows don't exceed the bound.
    named = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").where(F.col("text").isNotNull())
    least = F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text")
    rows = materialise(named.groupBy("doc_id", "quality", "draw", "use").agg(least), "labelled_texts")
    room = F.greatest(F.length("text") - F.lit(STRETCH), F.lit(0)) + 1
    start = F.pmod(F.xxhash64("doc_id", F.lit("stretch")), room) + 1
    stretches = (
        rows.where("use = 'dictionary'")
        .select(
            "quality",
            "draw",
            F.pmod(F.xxhash64("text"), F.lit(2)).alias("pair"),
            F.substring("text", start.cast("int"), F.lit(STRETCH)).alias("stretch"),
        )
        .groupBy("quality", "draw", "pair")
        .agg(F.min("stretch").alias("stretch"))
        .orderBy("draw", "pair")
        .collect()
    )
    def joined(quality: int, pairs: tuple[int, ...]) -> bytes:
        chosen = [r["stretch"] for r in stretches if r["quality"] == quality and r["pair"] in pairs]
        return "\n".join(chosen).encode("utf-8", "surrogatepass")

    # All texts of a label may be one and the same; then both pairs have it.
    good, bad = ([joined(q, (pair,)) or joined(q, (0, 1)) for pair in (0, 1)] for q in (1, 0))
    features = _measured(rows.where("use = 'fit'"), good, bad).collect() if good[0] and bad[0] else []
    y = np.array([r["quality"] for r in features], float)
    x = np.array([r["features"] for r in features], float).reshape(-1, _FEATURES)
    base = float(y.mean()) if len(y) else 0.5
    if not len(y) or y.min() == y.max():
        none = np.zeros(0)
        return QualityModel([], [], none, none, none, none, None, base)
    low, high = x.min(axis=0), x.max(axis=0)
    design = _design(x)
    mean, spread = design.mean(axis=0), design.std(axis=0) + 1e-9
    mean[0], spread[0] = 0.0, 1.0
    weights = _fit((design - mean) / spread, y)
    return QualityModel(good, bad, low, high, mean, spread, weights, base)


def _measured(rows: DataFrame, good: list[bytes], bad: list[bytes]) -> DataFrame:
    """quality and features of labelled rows; their number is bounded by `fit_rows`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes = _Sizes(good, bad)
        for batch in batches:
            yield pd.DataFrame(
                {"quality": batch["quality"], "features": sizes.features(batch["text"].tolist()).tolist()}
            )

    return rows.select("quality", "text").mapInPandas(run, "quality int, features array<double>")


def _fit(design: np.ndarray, y: np.ndarray, penalty: float = 0.05, rounds: int = 60) -> np.ndarray:
    """Logistic regression by Newton steps with a ridge penalty, halved while they overshoot."""
    weights = np.zeros(design.shape[1])
    ridge = np.full(design.shape[1], penalty)
    ridge[0] = 1e-6

    def loss(w: np.ndarray) -> float:
        z = design @ w
        return float(np.sum(np.logaddexp(0, z) - y * z) + 0.5 * np.sum(ridge * w * w))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        gradient = design.T @ (y - p) - ridge * weights
        curvature = (design * (p * (1 - p))[:, None]).T @ design + np.diag(ridge)
        step = np.linalg.solve(curvature, gradient)
        size, now = 1.0, loss(weights)
        while loss(weights + size * step) > now and size > 1e-6:
            size /= 2
        weights = weights + size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return weights


def score_quality(df: DataFrame, model: QualityModel, column: str = "text", to: str = "score") -> DataFrame:
    """Add the probability of label 1 for the whole text in `column` as double `to`.

    Null counts as empty; an empty text has a score, too. Other columns pass through as they are; a
    column that is called like `to` is replaced. Empty table: empty result.
    """
    kept = df.drop(to)
    shared = df.sparkSession.sparkContext.broadcast(vars(model))  # executors may lack the class

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = QualityModel(**shared.value)
        sizes = _Sizes(model.good, model.bad)
        for batch in batches:
            texts = batch.column(column).to_pylist()
            features = sizes.features(texts) if model.weights is not None else np.zeros((len(texts), _FEATURES))
            scores = pa.array(model.probabilities(features), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, to])

    schema = T.StructType([*kept.schema.fields, T.StructField(to, T.DoubleType())])
    return kept.mapInArrow(run, schema)


def judge_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    scored = score_quality(docs.select("doc_id", "text"), fit_quality(docs, labels))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op10_quality(spark, sf_dir: str) -> DataFrame:
    return judge_documents(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    )
