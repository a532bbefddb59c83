"""A multinomial classifier of results over feature columns, with Spark ML.

Three one-against-rest gradient-boosted classifiers (Spark's are binary), whose scores are renormalised.  Missing values are
imputed by the median with a flag column beside, since Spark's trees don't branch on missing values."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.odds import clipped


def usable(train: DataFrame, features: list[str]) -> list[str]:
    """The features that have a value in train, found by one aggregate."""
    counts = train.agg(*(F.count(c).alias(c) for c in features)).first()
    return [c for c in features if counts[c]]


def preparation(train: DataFrame, features: list[str]):
    """What puts a vector of the features on rows: medians of train for missing ones, and flags."""
    imputer = Imputer(inputCols=features, outputCols=[f"__{c}" for c in features]).fit(train)
    assembler = VectorAssembler(inputCols=[f"__{c}" for c in features] + [f"__no_{c}" for c in features], outputCol="features")

    def prepare(rows: DataFrame) -> DataFrame:
        return assembler.transform(imputer.transform(rows).withColumns({f"__no_{c}": F.col(c).isNull().cast("double") for c in features}))

    return prepare


class Models(list):
    """Fitted models, and the features that they have seen."""

    features: list[str]


def boosted(train: DataFrame, rows: DataFrame, features: list[str], rounds: int = 20, depth: int = 3, seed: int = 42, held: str | None = None) -> tuple[DataFrame, Models]:
    """rows with p1, px, p2 by boosted trees fitted on train (y in 0, 1, 2), and the three models.

    held names a boolean column of train: rows where it is true aren't fitted, and growing stops where they are no longer forecast better."""
    models = Models()
    models.features = usable(train, features)
    prepare = preparation(train, models.features)
    data = prepare(train.where("y is not null"))
    scored = prepare(rows)
    for k in range(3):
        stop = {"validationIndicatorCol": held, "validationTol": 0.001} if held else {}
        tree = GBTClassifier(labelCol="label", featuresCol="features", maxIter=rounds, maxDepth=depth, stepSize=0.1, seed=seed, **stop)
        tree = tree.setPredictionCol(f"__k{k}").setProbabilityCol(f"__p{k}").setRawPredictionCol(f"__r{k}")
        model = tree.fit(data.withColumn("label", (F.col("y") == k).cast("double")))
        scored = model.transform(scored).withColumn(f"__s{k}", vector_to_array(f"__p{k}")[1])
        models.append(model)
    p = dict(zip(("p1", "px", "p2"), clipped(*(F.col(f"__s{k}") for k in range(3))), strict=True))
    return scored.select(*rows.columns, *(c.alias(n) for n, c in p.items())), models


def logistic(train: DataFrame, rows: DataFrame, features: list[str], ridge: float = 0.01) -> DataFrame:
    """rows with p1, px, p2 by a multinomial logit."""
    prepare = preparation(train, usable(train, features))
    logit = LogisticRegression(labelCol="label", featuresCol="features", family="multinomial", regParam=ridge)
    model = logit.fit(prepare(train.where("y is not null")).withColumn("label", F.col("y").cast("double")))
    scored = model.transform(prepare(rows)).withColumn("__p", vector_to_array("probability"))
    return scored.select(*rows.columns, *(F.col("__p")[k].alias(n) for k, n in enumerate(("p1", "px", "p2"))))


def importances(models: Models, n: int = 15) -> list[tuple[str, float]]:
    """The features that the three models' trees gained most by, flags of missing values added to their features."""
    half = len(models[0].featureImportances) // 2
    total = [sum(float(m.featureImportances[i] + m.featureImportances[i + half]) for m in models) / len(models) for i in range(half)]
    ranked = sorted(zip(models.features, total, strict=True), key=lambda x: (-x[1], x[0]))
    return [x for x in ranked if x[1] > 0][:n]
