"""Training and scoring with Spark ML."""

from __future__ import annotations

from pyspark import SparkContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.config import DEFAULT, PanelConfig
from ledgerline.operators.features import CATEGORICAL, NUMERIC
from ledgerline.plans import order
from ledgerline.plans.reuse import cut


def split(frame: DataFrame, cfg: PanelConfig = DEFAULT) -> tuple[DataFrame, DataFrame]:
    known = frame.where("target IS NOT NULL")
    return known.where(F.col(cfg.year) <= cfg.train_until), known.where(F.col(cfg.year) >= cfg.test_from)


def validation(train: DataFrame, cfg: PanelConfig = DEFAULT, years: int = 3) -> tuple[DataFrame, DataFrame]:
    """train without its last years, and these, to decide when to stop; the test years are not touched."""
    last = F.col(cfg.year) > cfg.train_until - years
    return train.where(~last), train.where(last)


def fills(train: DataFrame, numeric=NUMERIC, categorical=CATEGORICAL) -> dict:
    """What nulls take: the median of a number's values in the training part, the most frequent value of a category, the least
    of equals."""
    values = doubles(train, numeric).select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in numeric])))
    out = {r.feature: r.median for r in order.percentiles(values, ["feature"], "value", {"median": 0.5}).collect()}  # a row for each feature
    for c in categorical:
        top = train.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).first()
        out[c] = top[0] if top else "unknown"
    return {c: out.get(c, 0.0) for c in (*numeric, *categorical)}


def preprocessing(numeric=NUMERIC, categorical=CATEGORICAL) -> list:
    return [
        VectorAssembler(inputCols=list(numeric), outputCol="raw_numeric", handleInvalid="keep"),
        StandardScaler(inputCol="raw_numeric", outputCol="numeric", withMean=True),
        *[StringIndexer(inputCol=c, outputCol=f"{c}_i", handleInvalid="keep") for c in categorical],
        OneHotEncoder(inputCols=[f"{c}_i" for c in categorical], outputCols=[f"{c}_v" for c in categorical], dropLast=False),
        VectorAssembler(inputCols=["numeric", *[f"{c}_v" for c in categorical]], outputCol="features"),
    ]


def statistics(train: DataFrame, numeric=NUMERIC) -> DataFrame:
    """feature, median, mean, deviation of the filled training part, as the preprocessing takes them."""
    known = fills(train)
    full = doubles(train, numeric).fillna(known)
    one = full.agg(*[x for c in numeric for x in (F.avg(c).alias(f"m_{c}"), F.stddev_samp(c).alias(f"d_{c}"))])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(known[c]).alias("median"), F.col(f"m_{c}").alias("mean"), F.col(f"d_{c}").alias("deviation")) for c in numeric])))


def balanced(train: DataFrame, like: DataFrame | None = None) -> DataFrame:
    """A weight that gives both classes the same total, in `like` if that is given."""
    n = {r.target: r["count"] for r in (train if like is None else like).groupBy("target").count().collect()}
    total = sum(n.values())
    w = None
    for k, v in n.items():
        w = F.when(F.col("target") == k, F.lit(total / (len(n) * v))) if w is None else w.when(F.col("target") == k, F.lit(total / (len(n) * v)))
    return train.withColumn("weight", w).withColumn("label", F.col("target").cast("double"))


def doubles(df: DataFrame, numeric=NUMERIC) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in numeric})


def _prepared(train: DataFrame) -> PipelineModel:
    """The preprocessing, fitted, with what nulls take in `fills`."""
    known = fills(train)
    model = Pipeline(stages=preprocessing()).fit(doubles(train).fillna(known))
    model.fills = known
    return model


def _with(before: PipelineModel, last) -> PipelineModel:
    model = PipelineModel([*before.stages, last])
    model.fills = before.fills
    return model


def fit_linear(train: DataFrame) -> PipelineModel:
    before = _prepared(train)
    data = before.transform(balanced(doubles(train).fillna(before.fills)))
    return _with(before, LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", maxIter=100, regParam=1e-4).fit(data))


def kept_stages(losses: list[float], patience: int) -> tuple[int, bool]:
    """The stages up to the least loss, looked for until `patience` stages bring nothing better; and whether that ended it."""
    best = 0
    for k, loss in enumerate(losses):
        if loss < losses[best]:
            best = k
        elif k - best >= patience:
            return best + 1, True
    return best + 1, False


def first_trees(model: GBTClassificationModel, n: int) -> GBTClassificationModel:
    """The ensemble of the first n trees."""
    java, jvm, gateway = model._java_obj, SparkContext._active_spark_context._jvm, SparkContext._active_spark_context._gateway
    trees, weights = java.trees(), java.treeWeights()
    some = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    shares = gateway.new_array(gateway.jvm.double, n)
    for i in range(n):
        some[i], shares[i] = trees[i], weights[i]
    cut_off = jvm.org.apache.spark.ml.classification.GBTClassificationModel(java.uid(), some, shares)
    return GBTClassificationModel(java.copyValues(cut_off, java.extractParamMap()))


def fit_trees(train: DataFrame, cfg: PanelConfig = DEFAULT, iterations: int = 400, depth: int = 5, rate: float = 0.05, validation_years: int = 3, patience: int = 25) -> PipelineModel:
    """Boosted trees, grown on train without its last `validation_years` until `patience` trees bring no less loss on these
    years, and cut at the least loss. The ensemble grows by doubling, as one that has to go on begins with the same trees,
    so at most twice the trees that are needed are grown. `losses` of the model are those of its stages; where train has
    no rows in one of both parts, all `iterations` are grown on all of it."""
    before = _prepared(train)
    own, late = validation(train, cfg, validation_years)
    ready = lambda rows, like: cut(before.transform(balanced(doubles(rows).fillna(before.fills), like)).select("features", "label", "weight"))
    grow = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxDepth=depth, stepSize=rate, subsamplingRate=0.8, seed=7)
    if not (own.take(1) and late.take(1)):
        return _with(before, grow.setMaxIter(iterations).fit(ready(train, None)))
    seen, held = ready(own, None), ready(late, own)
    n = min(2 * patience, iterations)
    while True:
        grown = grow.setMaxIter(n).fit(seen)
        losses = list(grown.evaluateEachIteration(held))
        kept, stopped = kept_stages(losses, patience)
        if stopped or n == iterations:
            break
        n = min(2 * n, iterations)
    out = _with(before, first_trees(grown, kept))
    out.losses = losses
    return out


def score(df: DataFrame, model: PipelineModel, name: str = "proba") -> DataFrame:
    out = model.transform(doubles(df).fillna(model.fills))
    return out.withColumn(name, vector_to_array("probability")[1])


def feature_names(model: PipelineModel, numeric=NUMERIC, categorical=CATEGORICAL) -> list[tuple[str, str]]:
    """(column of the model's vector, source feature)."""
    indexers = [s for s in model.stages if hasattr(s, "labels")]
    names = [(c, c) for c in numeric]
    for c, s in zip(categorical, indexers):
        names += [(f"{c}={v}", c) for v in [*s.labels, "__unknown"]]
    return names


def coefficients(spark, model: PipelineModel) -> DataFrame:
    """Columns of the linear model with their coefficients, the largest first."""
    w = model.stages[-1].coefficients.toArray().tolist()
    rows = [(n, g, float(x)) for (n, g), x in zip(feature_names(model), w)]
    return spark.createDataFrame(rows, "name string, feature string, coefficient double").orderBy(F.desc(F.abs("coefficient")))


def importances(spark, model: PipelineModel) -> DataFrame:
    """Tree importances, columns of one source feature summed."""
    w = model.stages[-1].featureImportances.toArray().tolist()
    names = feature_names(model)
    rows = [(n, g, float(x)) for (n, g), x in zip(names, w + [0.0] * (len(names) - len(w)))]  # none for columns after the last one used
    return spark.createDataFrame(rows, "name string, feature string, importance double").groupBy("feature").agg(F.sum("importance").alias("importance")).orderBy(F.desc("importance"))


def drivers(scored: DataFrame, model: PipelineModel, top: int = 3) -> DataFrame:
    """For each row the features that raise its log-odds most: coefficient x standardised value, summed by source feature."""
    w = F.array(*[F.lit(float(x)) for x in model.stages[-1].coefficients.toArray()])
    columns: dict[str, list[int]] = {}
    for i, (_, feature) in enumerate(feature_names(model)):  # those of one feature stand side by side
        columns.setdefault(feature, []).append(i)
    part = lambda at: F.aggregate(F.slice("_parts", at[0] + 1, len(at)), F.lit(0.0), lambda a, x: a + x)
    each = F.array(*[F.struct((-part(at)).alias("less"), F.lit(feature).alias("feature")) for feature, at in columns.items()])
    best = F.slice(F.array_sort(F.filter(each, lambda x: x["less"] < 0)), 1, top)
    rows = scored.select("ein", "fiscal_year", vector_to_array("features").alias("_x")).withColumn("_parts", F.zip_with("_x", w, lambda x, y: x * y)).withColumn("_best", best)
    text = F.array_join(F.transform("_best", lambda x: F.format_string("%s (+%.2f)", x["feature"], -x["less"])), "; ")
    return rows.where(F.size("_best") > 0).select("ein", "fiscal_year", text.alias("drivers"))


def global_drivers(scored: DataFrame, model: PipelineModel) -> DataFrame:
    """feature, mean_abs_contribution: what a feature moves the log-odds by on average, the columns of one source feature
    summed. Each task keeps a sum for each column of the vector."""
    w = model.stages[-1].coefficients.toArray().tolist()
    table = scored.sparkSession.createDataFrame([(i, g, abs(float(x))) for i, ((_, g), x) in enumerate(zip(feature_names(model), w))], "at int, feature string, size double")
    means = scored.select(F.posexplode(vector_to_array("features")).alias("at", "value")).groupBy("at").agg(F.avg(F.abs("value")).alias("mean"))
    return means.join(F.broadcast(table), "at").groupBy("feature").agg(F.sum(F.col("mean") * F.col("size")).alias("mean_abs_contribution"))
