"""Learned sentence importance (M7-M12) and its persistence.

The network of the original (5 -> 64 -> 32 -> 1, trained with Adam on binary
cross-entropy) is re-expressed as Spark ML's
``MultilayerPerceptronClassifier`` (layers 5-64-32-2, L-BFGS, sigmoid hidden
units, softmax output, no dropout): same inputs and task, other optimiser and
weights.  Its training runs over blocks of rows in matrix products
(:mod:`precis.operators.training`): a Spark job for each gradient; the driver only holds
the 2.5k weights.

Early stopping (M10): training proceeds in "epochs" of a few L-BFGS
iterations, each warm-started from the previous weights; after every epoch the validation log-loss is measured
and the best weights are kept; ``patience`` epochs without improvement stop.
"""

from __future__ import annotations

import json
import os

from pyspark.ml import PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from precis import config as C
from precis.operators.features import FEATURES, apply_scaler, fit_scaler, train_val_split
from precis.operators.network import Network, fixed_network
from precis.operators.training import Blocks, Fitted, minimised
from precis.session import checkpoint_dir

SCALER_KEYS = ("data_min", "data_max", "data_range", "scale", "min", "n_features_in")


class ImportanceModel:
    """Scaler and network.  Untrained instances refuse to predict/save.

    The network is that of a fitted pipeline (assembler + MLP), or one made elsewhere.
    """

    def __init__(self, pipeline: PipelineModel | None = None, scaler: dict | None = None, history=None,
                 network: Network | None = None):
        self.pipeline = pipeline
        self.scaler = scaler
        self.history = history or []
        self.network = network or (Network.from_mlp(pipeline.stages[-1]) if pipeline is not None else None)

    @property
    def is_trained(self) -> bool:
        return self.network is not None and self.scaler is not None

    def _check(self):
        if not self.is_trained:
            raise RuntimeError("no importance model: train one or load one")

    # --- M12 -----------------------------------------------------------------
    def transform(self, feats: DataFrame) -> DataFrame:
        """The scaled features and ``importance``, the network's probability."""
        self._check()
        scaled = apply_scaler(feats, self.scaler)
        return scaled.withColumn("importance", self.network.apply(*[F.col(c) for c in FEATURES]))

    # --- S10 / S8 --------------------------------------------------------------
    def save(self, spark: SparkSession, path: str) -> None:
        if not self.is_trained:
            raise RuntimeError("there is no trained model to save")
        if self.pipeline is not None:
            self.pipeline.write().overwrite().save(os.path.join(path, "model"))
        else:
            self.network.save(spark, os.path.join(path, "network"))
        save_scaler(spark, self.scaler, os.path.join(path, "scaler"))

    # --- S11 / S9 --------------------------------------------------------------
    @staticmethod
    def load(spark: SparkSession, path: str) -> "ImportanceModel":
        model_path, network_path = os.path.join(path, "model"), os.path.join(path, "network")
        if _exists(spark, model_path):
            return ImportanceModel(PipelineModel.load(model_path), load_scaler(spark, os.path.join(path, "scaler")))
        if _exists(spark, network_path):
            return ImportanceModel(None, load_scaler(spark, os.path.join(path, "scaler")), network=Network.load(spark, network_path))
        raise FileNotFoundError(f"no model at {path}")


def _exists(spark: SparkSession, path: str) -> bool:
    """Path check through the Hadoop file system (works for any scheme)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def save_scaler(spark: SparkSession, scaler: dict, path: str) -> None:
    """The six scaler fields as one JSON row."""
    row = {k: scaler[k] for k in SCALER_KEYS}
    spark.createDataFrame([json.dumps(row)], "string").coalesce(1).write.mode("overwrite").text(path)


def load_scaler(spark: SparkSession, path: str) -> dict:
    """Read the JSON row; a missing ``scale`` is 1/range (0 where the
    range is 0), a missing ``min`` is -data_min * scale.  A missing file is
    an error (an unfitted scaler could only fail later)."""
    if not _exists(spark, path):
        raise FileNotFoundError(f"no scaler at {path}")
    row = spark.read.json(path).first().asDict()
    dmin = [float(v) for v in row["data_min"]]
    rng = [float(v) for v in row["data_range"]]
    scale = row.get("scale")
    scale = [float(v) for v in scale] if scale is not None else [1.0 / r if r != 0 else 0.0 for r in rng]
    mins = row.get("min")
    mins = [float(v) for v in mins] if mins is not None else [-a * s for a, s in zip(dmin, scale)]
    return {"data_min": dmin, "data_max": [float(v) for v in row["data_max"]], "data_range": rng,
            "scale": scale, "min": mins, "n_features_in": len(dmin)}


class BlockMLP:
    """One epoch: some steps of L-BFGS over the blocks of a training set, from given weights."""

    def __init__(self, sizes: list[int], max_iter: int, initial, tol: float = 1e-6):
        self.sizes, self.max_iter, self.initial, self.tol = sizes, max_iter, initial, tol

    def fit(self, blocks: Blocks) -> Fitted:
        return Fitted(minimised(lambda w: blocks.objective(w, self.sizes), self.initial, self.max_iter, self.tol), self.sizes)


def _classifier(spark: SparkSession, settings: C.Settings, initial=None) -> MultilayerPerceptronClassificationModel:
    """Spark ML's model of given weights, or of those it starts from."""
    m = MultilayerPerceptronClassifier(
        layers=[len(FEATURES), *settings.hidden_layers, 2],
        maxIter=0,  # no step: the weights stay
        seed=settings.random_state,
        featuresCol="features",
        labelCol="label",
        solver="l-bfgs",
        blockSize=128,
    )
    if initial is not None:
        m.setInitialWeights(Vectors.dense(initial))
    return m.fit(spark.createDataFrame([(Vectors.dense([0.0] * len(FEATURES)), 0.0)], ["features", "label"]))


def _mlp(settings: C.Settings, max_iter: int, initial) -> BlockMLP:
    return BlockMLP([len(FEATURES), *settings.hidden_layers, 2], max_iter, initial)


def log_loss(parts: list[tuple[float, int]]) -> float:
    """The mean of losses given as (sum, rows)."""
    return sum(loss for loss, _ in parts) / sum(rows for _, rows in parts)


def train(ts: DataFrame, settings: C.Settings = C.DEFAULT, epochs: int | None = None,
          iters_per_epoch: int = 10) -> ImportanceModel:
    """M8 + M10: fit scaler and network; early stopping on validation loss.

    ``ts`` is the training set (features + label).  Falsy ``epochs`` means the
    configured default; an empty training set raises.  Where the split leaves no
    validation row there is nothing to stop on: every epoch runs, the last weights
    stay and the history's losses are null.  The features are computed once.
    """
    epochs = epochs or settings.epochs
    spark = ts.sparkSession
    rows = ts.select(*[c for c in (*FEATURES, "label", "doc_id") if c in ts.columns]).persist()
    blocks = None
    best, best_loss, since, history = None, float("inf"), 0, []
    try:
        scaler = fit_scaler(rows)  # raises on empty data
        blocks = Blocks(train_val_split(apply_scaler(rows, scaler), settings.validation_split), list(FEATURES))
        rows.unpersist()
        weights = _classifier(spark, settings).weights.toArray()
        for ep in range(1, epochs + 1):
            fitted = _mlp(settings, iters_per_epoch, weights).fit(blocks)
            weights = fitted.weights
            loss = log_loss(fitted.losses(blocks)) if blocks.validated else None
            history.append({"epoch": ep, "val_loss": loss})
            if not blocks.validated:
                best = fitted
            elif loss < best_loss - 1e-12:
                best, best_loss, since = fitted, loss, 0
            else:
                since += 1
                if since >= settings.patience:
                    break
    finally:
        rows.unpersist()
        if blocks is not None:
            blocks.close()
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    pipeline = PipelineModel(stages=[assembler, _classifier(spark, settings, best.weights)])
    return ImportanceModel(pipeline, scaler, history)


def binary_metrics(scored: DataFrame, split: str = "split", label: str = "label", score: str = "score") -> DataFrame:
    """(split, rows, accuracy, auc, loss) of scores in [0, 1] against labels 0 and 1, exact at any size.

    ``auc`` is the area under the ROC curve with ties counted half: of all pairs of a
    positive and a negative the share in which the positive has the higher score; null
    where a class has no rows.  Rows of one score are one group, pre-aggregated, and the
    groups are range-partitioned by score, so a group's negatives below it are those of
    the partitions before (one number each) and those before it in its own: no window
    spans more than a partition.  Rows without label or score do not count.
    """
    checkpoint_dir(scored.sparkSession)
    p, y = F.col(score).cast("double"), F.col(label).cast("int")
    rows = scored.select(F.col(split).alias("split"), p.alias("p"), y.alias("y")).where(F.col("p").isNotNull() & F.col("y").isNotNull())
    likely = F.when(F.col("y") == 1, F.col("p")).otherwise(1 - F.col("p"))
    groups = rows.groupBy("split", "p").agg(
        F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"),
        F.sum(F.when((F.col("p") >= 0.5) == (F.col("y") == 1), 1).otherwise(0)).alias("right"),
        F.sum(-F.log(F.greatest(likely, F.lit(1e-15)))).alias("loss"))
    # stored: both uses of the groups must see the same partitions
    groups = groups.repartitionByRange("split", "p").sortWithinPartitions("split", "p").withColumn("part", F.spark_partition_id()).checkpoint()
    before = Window.partitionBy("split").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = groups.groupBy("split", "part").agg(F.sum("neg").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    own = Window.partitionBy("split", "part").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    ranked = groups.withColumn("below", F.coalesce(F.sum("neg").over(own), F.lit(0))).join(F.broadcast(parts.drop("n")), ["split", "part"])
    twice = F.col("pos").cast("decimal(38,0)") * (2 * (F.col("offset") + F.col("below")) + F.col("neg")).cast("decimal(20,0)")
    total = ranked.groupBy("split").agg(
        F.sum("pos").alias("P"), F.sum("neg").alias("N"), F.sum(twice.cast("double")).alias("twice"),
        F.sum("right").alias("right"), F.sum("loss").alias("loss"))
    n = F.col("P") + F.col("N")
    return total.select(
        "split", n.alias("rows"), (F.col("right") / n).alias("accuracy"),
        F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("twice") / (2.0 * F.col("P") * F.col("N"))).alias("auc"),
        (F.col("loss") / n).alias("loss"))


def training_metrics(model: ImportanceModel, ts: DataFrame, settings: C.Settings = C.DEFAULT) -> DataFrame:
    """Accuracy, AUC and log-loss on the train and validation parts (those that have rows)."""
    split = train_val_split(ts, settings.validation_split)
    scored = predict_importance(model, split).select(
        F.when(F.col("is_val"), "validation").otherwise("train").alias("split"), "label", F.col("importance").alias("score"))
    return binary_metrics(scored).drop("rows")


def fixed_model() -> ImportanceModel:
    """A model of fixed numbers: :func:`fixed_network`, and a scaler of round ranges."""
    ranges = [1.0, 1.0, 1.0, 50.0, 3.0]
    return ImportanceModel(network=fixed_network(), scaler={
        "data_min": [0.0] * 5, "data_max": ranges, "data_range": ranges, "scale": [1.0 / r for r in ranges], "min": [0.0] * 5,
        "n_features_in": 5})


def predict_importance(model: ImportanceModel, feats: DataFrame) -> DataFrame:
    """Probability of the positive class per sentence."""
    if model is None:
        raise RuntimeError("no importance model: train one or load one")
    return model.transform(feats)


def load_optional(spark: SparkSession, path: str | None):
    """The model when present and loadable, else None (with a warning)."""
    import warnings

    if not path:
        return None
    try:
        return ImportanceModel.load(spark, path)
    except Exception as e:  # noqa: BLE001 - any failure means: run without it
        warnings.warn(f"hybrid model unavailable ({e}); continuing with the other methods")
        return None
