"""Quality by compression: zstandard dictionaries of good and of bad text.

Two dictionaries are trained on labelled text, one a class. A text is compressed with each; the normalised
difference of the two sizes says which class describes it more briefly, and a logistic curve fitted on other
labelled rows (weighing as the labels are shared out) turns it into a score from 0 to 1. Fitting reads a bounded, documented
sample of labelled rows: ``per_class`` rows of each label for its dictionary and as many again for the curve, the
first in the order of a hash of the id, as far as ``most_bytes`` a label reach. Texts are whole, there and in scoring.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import released, written

RIDGE, INPUTS = 1e-5, 4


def measures(text: str | None, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> tuple[float, float, float, float]:
    """The difference of the compressed sizes (bad - good) over the text's bytes and over the sum of the sizes; the
    size with the good dictionary over the text's bytes, and its square. Zeros for an empty text."""
    data = (text or "").encode()
    if not data:
        return 0.0, 0.0, 0.0, 0.0
    a, b = len(good.compress(data)), len(bad.compress(data))
    return (b - a) / len(data), (b - a) / (a + b), a / len(data), (a / len(data)) ** 2


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    level: int
    weights: tuple[float, ...] = ()

    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        made = []
        for data in (self.good, self.bad):
            d = zstandard.ZstdCompressionDict(data)
            d.precompute_compress(level=self.level)
            made.append(zstandard.ZstdCompressor(level=self.level, dict_data=d, write_content_size=False, write_checksum=False))
        return made[0], made[1]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Scores of rows of measures, of which the first so many count as there are weights."""
        return 1 / (1 + np.exp(-np.clip(x[:, : len(self.weights) - 1] @ np.array(self.weights[1:]) + self.weights[0], -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, share: float = 0.5, steps: int = 60) -> tuple[float, ...]:
    """Offset and slopes by Newton's method with a small ridge; label 1 weighs ``share`` in all, label 0 the rest."""
    middle, scale = x.mean(0), x.std(0)
    scale[scale == 0] = 1
    z, w = np.c_[np.ones(len(x)), (x - middle) / scale], np.where(y == 1, share / max(y.sum(), 1), (1 - share) / max((1 - y).sum(), 1))
    beta = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -40, 40)))
        gradient = z.T @ (w * (y - p)) - RIDGE * beta
        hessian = (z * (w * p * (1 - p))[:, None]).T @ z + RIDGE * np.eye(len(beta))
        beta = beta + np.linalg.solve(hessian, gradient)
    slopes = beta[1:] / scale
    return (float(beta[0] - slopes @ middle), *map(float, slopes))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = 2000, most_bytes: int = 32 << 20, dictionary: int = 512 << 10, level: int = 3, inputs: int = INPUTS) -> QualityModel:
    """A model from the labelled rows whose crc32 of the id (as text) is not divisible by 5.

    The sample's ids, ``2 * per_class`` a class at most, are chosen from the labels alone; only their texts are read
    into the driver, one a label and id (the least, if rows repeat it), and only as many as ``most_bytes`` hold: in their
    order, those up to where their sum exceeds it, without single texts that do. Null ids, labels and texts are not
    read, nor are empty texts; ids of equal hash go by the id; an id with both labels counts for both. ``inputs``: so many of the measures count (1: the size difference
    alone). With too little text of a class (or none), its dictionary is the text itself, or one blank.
    """
    spark = docs.sparkSession
    usable = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0))
    order = F.xxhash64(F.lit(5), F.col(id_col))
    chosen = [
        usable.filter(F.col(label_col) == label).select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_label"), order.alias("_order")).distinct().orderBy("_order", "_id").limit(2 * per_class)
        for label in (0, 1)
    ]
    ids = chosen[0].union(chosen[1]).collect()  # 4 * per_class rows at most
    share = usable.agg(F.avg(label_col)).first()[0]
    named = spark.createDataFrame([tuple(r) for r in ids], "_id long, _label int, _order long")
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).filter("_text <> ''")
    sized = written(texts.join(F.broadcast(named), "_id").groupBy("_id", "_label", "_order").agg(F.min("_text").alias("_text")), "sample")
    so_far = Window.partitionBy("_label").orderBy("_order", "_id")  # 2 * per_class rows at most
    sizes = sized.select("_id", "_label", "_order", F.octet_length("_text").cast("long").alias("_size")).filter(F.col("_size") <= most_bytes)
    kept = sizes.withColumn("_sum", F.sum("_size").over(so_far)).filter(F.col("_sum") <= most_bytes).select("_id", "_label")
    sample = sorted(tuple(r) for r in sized.join(F.broadcast(kept), ["_id", "_label"]).select("_order", "_id", "_label", "_text").collect())
    released(spark, sized)
    by = {label: [r[3].encode() for r in sample if r[2] == label] for label in (0, 1)}
    half = {label: by[label][: max(1, len(by[label]) // 2)] for label in by}
    made = {}
    for label, data in half.items():
        try:
            made[label] = zstandard.train_dictionary(dictionary, data).as_bytes()
        except zstandard.ZstdError:  # too few or too short texts to train on
            made[label] = b"\n".join(data)[:dictionary].rjust(8)
    model = QualityModel(made[1], made[0], level)
    compressors = model.compressors()
    rest = [(*measures(t.decode(), *compressors)[:inputs], label) for label in by for t in by[label][len(half[label]) :]]
    if len({r[-1] for r in rest}) < 2:
        return QualityModel(made[1], made[0], level, (0.0, 40.0, *[0.0] * (inputs - 1)))
    table = np.array(rest, float)
    return QualityModel(made[1], made[0], level, logistic(table[:, :-1], table[:, -1], share))


def scored(docs: DataFrame, model: QualityModel, text_col: str = "text", cut: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1 from ``cut`` on); columns of these names are replaced.

    Defined cases: null and empty texts get the score of sizes of zero; repeated rows get equal scores; an
    empty table gives an empty table.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of at most ``dictionary`` bytes

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pair = held.value.compressors()
        for texts in batches:
            yield pd.Series(held.value.scores(np.array([measures(t, *pair) for t in texts], float).reshape(-1, INPUTS)))

    return docs.drop("score", "predicted").withColumn("score", score(F.col(text_col))).withColumn("predicted", (F.col("score") >= cut).cast("int"))
