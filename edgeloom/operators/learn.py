"""Fitting on pair features with Spark ML: ensembles, scaling, embeddings, factorisation."""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import MaxAbsScaler, MinMaxScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import digest_int, order_key
from .graph import cooccurrence, positive_information
from .rank import top_runs
from .scale import checkpointed, dense_index, salted_join
from .splits import oversample

def scale_features(train: DataFrame, others, kind: str = "minmax", col: str = "feature"):
    """Scaler fitted on the training rows only; returns (train, *others) with array features."""
    scaler = (MinMaxScaler if kind == "minmax" else MaxAbsScaler)(inputCol="_v", outputCol="_s")
    vec = lambda df: df.withColumn("_v", array_to_vector(F.col(col).cast("array<double>")))
    model = scaler.fit(vec(train))
    done = lambda df: model.transform(vec(df)).withColumn(col, vector_to_array("_s")).drop("_v", "_s")
    return tuple(done(df) for df in [train, *others])


def _classifier(model: str, seed: int, **params):
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier

    make = {"forest": RandomForestClassifier, "boosted": GBTClassifier}[model]
    return make(featuresCol="_x", labelCol="label", seed=seed, **params)


def fit_pairs(features: DataFrame, n_folds: int, model: str = "forest", balance: bool = True, seed: int = 0, scale: str = "minmax", **params) -> DataFrame:
    """Per fold: scale, balance the classes, fit on the other folds, score the fold.

    Input (fold, src, dst, label, feature array); output (fold, src, dst, score, pred, label).
    """
    features = checkpointed(features.select("fold", "src", "dst", F.col("label").cast("int").alias("label"), "feature"))
    out = None
    for fold in range(n_folds):
        train, test = features.filter(F.col("fold") != fold), features.filter(F.col("fold") == fold)
        train, test = scale_features(train, [test], scale)
        train = oversample(train, seed=seed) if balance else train
        vec = lambda df: df.withColumn("_x", array_to_vector("feature"))
        fitted = _classifier(model, seed, **params).fit(vec(train.select("label", "feature")))
        scored = fitted.transform(vec(test)).select(
            "fold", "src", "dst", vector_to_array("probability")[1].alias("score"), F.col("prediction").cast("int").alias("pred"), "label"
        )
        out = scored if out is None else out.unionByName(scored)
    return out


def grid(params: dict) -> list[dict]:
    """All combinations of a small grid of settings."""
    return [dict(zip(params, values)) for values in product(*params.values())]


def run_name(setting: dict) -> str:
    return "_".join(f"{k}={v}" for k, v in sorted(setting.items()))


def pending_runs(settings, done: DataFrame) -> list[dict]:
    """Settings without a row in the table of finished runs (column ``run``)."""
    spark = done.sparkSession
    names = spark.createDataFrame([(run_name(s),) for s in settings], "run string")
    todo = {r.run for r in names.join(done.select("run").distinct(), "run", "left_anti").collect()}
    return [s for s in settings if run_name(s) in todo]


def grid_search(settings, evaluate, done: DataFrame | None = None, by: str = "auc") -> DataFrame:
    """Metrics of every setting not yet run, joined with the finished ones.

    ``evaluate(setting)`` returns a one-row DataFrame of metrics.
    """
    todo = settings if done is None else pending_runs(settings, done)
    out = done
    for s in todo:
        row = evaluate(s).withColumn("run", F.lit(run_name(s)))
        out = row if out is None else out.unionByName(row)
    return out


def best_run(metrics: DataFrame, by: str = "auc") -> DataFrame:
    return top_runs(metrics.withColumn("_all", F.lit(1)), "_all", by, 1).drop("_all")


def cross_dataset(datasets: dict[str, DataFrame], fit, score, seeds=(0,)) -> DataFrame:
    """Train on each data set, test on every other, for each seed: one metrics table.

    ``fit(df, seed)`` gives a model, ``score(model, df)`` a one-row DataFrame.
    """
    out = None
    for seed in seeds:
        for train_name, train in datasets.items():
            model = fit(train, seed)
            for test_name, test in datasets.items():
                if test_name == train_name:
                    continue
                tags = [F.lit(train_name).alias("train_ds"), F.lit(test_name).alias("test_ds"), F.lit(seed).alias("seed")]
                row = score(model, test).select(*tags, "*")
                out = row if out is None else out.unionByName(row)
    return out


def factor_scores(train: DataFrame, test: DataFrame, rank: int = 10, iterations: int = 5, seed: int = 0) -> DataFrame:
    """Low-rank completion of the interaction matrix, scored on the test pairs.

    Side features are not used. Pairs with an id unknown to the training edges get NULL.
    """
    si, di = dense_index(train, "src", "i"), dense_index(train, "dst", "j")
    number = lambda df, how: df.join(si, "src", how).join(di, "dst", how).withColumn("i", F.col("i").cast("int")).withColumn("j", F.col("j").cast("int"))
    data = number(train.select("src", "dst"), "inner").withColumn("r", F.lit(1.0))
    als = ALS(userCol="i", itemCol="j", ratingCol="r", implicitPrefs=True, rank=rank, maxIter=iterations, seed=seed)
    model = als.fit(data)
    user = model.userFactors.select(F.col("id").alias("i"), F.col("features").alias("_u"))
    item = model.itemFactors.select(F.col("id").alias("j"), F.col("features").alias("_w"))
    x = number(test, "left").join(user, "i", "left").join(item, "j", "left")
    dot = F.aggregate(F.zip_with("_u", "_w", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v)
    return x.withColumn("score", dot).drop("i", "j", "_u", "_w")


def _products(rows: DataFrame, left: str, right: str) -> np.ndarray:
    """Sum over the rows of the outer products of two array columns: partial sums in the tasks, width² numbers in the end."""

    def run(batches):
        total = 0.0
        for b in batches:
            x, y = (np.array(b[c].flatten().to_numpy(zero_copy_only=False)).reshape(b.num_rows, -1) for c in (left, right))
            total = total + x.T @ y
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["at", "v"])

    parts = rows.select(*dict.fromkeys((left, right))).mapInArrow(run, "at long, v double")
    cells = parts.groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()
    width = round(len(cells) ** 0.5)
    return np.array([r.v for r in cells]).reshape(width, width)


def _turned(rows: DataFrame, col: str, by: np.ndarray, out: str) -> DataFrame:
    """(id, out): the array column times a small matrix."""

    def run(batches):
        for b in batches:
            x = np.array(b[col].flatten().to_numpy(zero_copy_only=False)).reshape(b.num_rows, -1) @ by
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(list(x), pa.list_(pa.float64()))], names=["id", out])

    return rows.select("id", col).mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {out} array<double>")


def _whitening(gram: np.ndarray) -> np.ndarray:
    """T with Tᵀ·G·T = 1 on the directions that G has."""
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    ok = values > values.max() * 1e-13
    return vectors[:, ok] / np.sqrt(values[ok])


def leading_vectors(matrix: DataFrame, dim: int, spare: int = 8, rounds: int = 12, tol: float = 1e-3, seed: int = 0) -> tuple[DataFrame, np.ndarray]:
    """Eigenvectors of a symmetric sparse matrix (a, b, w) for its ``dim`` eigenvalues of largest size: ((id, vec), values).

    Block power iteration with ``spare`` more columns: the matrix times the block is a join and sums, the block is made
    orthonormal by its Gram matrix, a sum over the rows, whose small factor is applied back to them. It stops when the
    Ritz values have moved by less than ``tol`` of the largest, or after ``rounds``. Only width² numbers leave the cluster.
    """
    width = dim + spare
    matrix = checkpointed(matrix.select("a", "b", F.col("w").cast("double").alias("w")))
    sign = lambda i: F.when(digest_int(order_key(seed, "id", F.lit(str(i))), 1, 1) % 2 == 0, 1.0).otherwise(-1.0)
    start = checkpointed(matrix.select(F.col("a").alias("id")).distinct().select("id", F.array(*[sign(i) for i in range(width)]).alias("v")))
    if not start.head(1):
        return start.withColumnRenamed("v", "vec"), np.zeros(0)
    block = _turned(start, "v", _whitening(_products(start, "v", "v")), "v")
    before = None
    for no in range(rounds):
        block = checkpointed(block)
        width = block.select(F.size("v")).first()[0]
        met = matrix.join(block.withColumnRenamed("id", "b"), "b")
        moved = met.groupBy("a").agg(*[F.sum(F.col("w") * F.col("v")[i]).alias(f"y{i}") for i in range(width)])
        moved = checkpointed(moved.select(F.col("a").alias("id"), F.array(*[f"y{i}" for i in range(width)]).alias("y")).join(block, "id"))
        small = _products(moved, "v", "y")
        values, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-np.abs(values))[:dim]
        values, turn = values[order], turn[:, order]
        if no == rounds - 1 or before is not None and len(before) == len(values) and np.abs(np.abs(values) - np.abs(before)).max() <= tol * np.abs(values).max():
            break
        before = values
        block = _turned(moved, "y", _whitening(_products(moved, "y", "y")), "v")
    return _turned(moved, "v", turn, "vec"), values


def node_embeddings(walks: DataFrame, dim: int = 32, window: int = 10, rounds: int = 12, seed: int = 0) -> DataFrame:
    """Vectors (id, vec) of unit length of the nodes in walks (walk, step, node), near for nodes of like company.

    They factorise the positive mutual information of nodes within a window: its leading eigenvectors, each times the
    root of its eigenvalue's size. Nodes without any such information are absent.
    """
    vectors, values = leading_vectors(positive_information(checkpointed(cooccurrence(walks, window))), dim, rounds=rounds, seed=seed)
    weight = F.array(*[F.lit(float(w)) for w in np.sqrt(np.abs(values))])
    out = vectors.select("id", F.zip_with("vec", weight, lambda x, w: x * w).alias("vec"))
    size = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    return out.select("id", F.when(size > 0, F.transform("vec", lambda x: x / size)).otherwise(F.col("vec")).alias("vec"))
