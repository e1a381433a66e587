"""A text model of scores, and the measures of models and scorers."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import CountVectorizer, IDF, MaxAbsScaler, NGram, OneHotEncoder, RegexTokenizer, StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valora.functions import text as T
from valora.runtime import keep


def training_rows(rows: DataFrame) -> DataFrame:
    """Institutional rows with a score and a text: labels default to 'desconocido', lengths are features."""
    text = T.first_filled(F.col("relevant_text"), F.col("justification"))
    return (
        rows.where(T.identifier(F.col("tipo_informe")) == "institucional")
        .select(
            "row_id",
            F.coalesce(T.first_filled(F.col("section_id")), F.lit("desconocido")).alias("seccion"),
            F.coalesce(T.first_filled(F.col("dimension_name")), F.lit("desconocido")).alias("criterio"),
            F.lower(T.clean_spaces(text)).alias("texto"),
            F.col("question_score").cast("double").alias("label"),
        )
        .where("texto IS NOT NULL AND label IS NOT NULL")
        .withColumn("chars", F.length("texto").cast("double"))
        .withColumn("words", T.word_count(F.col("texto")).cast("double"))
    )


# Columns that a training set has at least.
REQUIRED = ("tipo_informe", "section_id", "dimension_name", "question_text", "question_score", "relevant_text")


def checked(rows: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """rows, or a ValueError that names the columns which are missing."""
    missing = [c for c in required if c not in rows.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    return rows


def save_dataset(rows: DataFrame, path: str) -> str:
    """A training set as CSV or parquet by the path's suffix."""
    if path.endswith(".csv"):
        rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    elif path.endswith(".parquet"):
        rows.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"{path} ends in neither .csv nor .parquet")
    return path


#: Words and word pairs that the text features hold at most, the most frequent ones.
VOCABULARY = 1 << 15


def _features(ngrams: int, vocabulary: int) -> Pipeline:
    """TF-IDF of words (and of pairs, if ngrams is 2), one-hot labels, scaled lengths."""
    stages = [RegexTokenizer(inputCol="texto", outputCol="tokens", pattern=r"[^\p{L}\p{N}]+")]
    parts = []
    for n in range(1, ngrams + 1):
        stages += [
            NGram(inputCol="tokens", outputCol=f"grams{n}", n=n),
            CountVectorizer(inputCol=f"grams{n}", outputCol=f"tf{n}", vocabSize=vocabulary, minDF=2.0),
            IDF(inputCol=f"tf{n}", outputCol=f"tfidf{n}"),
        ]
        parts.append(f"tfidf{n}")
    stages += [
        StringIndexer(inputCols=["seccion", "criterio"], outputCols=["s_ix", "c_ix"], handleInvalid="keep"),
        OneHotEncoder(inputCols=["s_ix", "c_ix"], outputCols=["s_oh", "c_oh"], handleInvalid="keep"),
        VectorAssembler(inputCols=["chars", "words"], outputCol="lengths"),
        MaxAbsScaler(inputCol="lengths", outputCol="scaled"),
        VectorAssembler(inputCols=[*parts, "s_oh", "c_oh", "scaled"], outputCol="features"),
    ]
    return Pipeline(stages=stages)


def train(rows: DataFrame, alphas: tuple[float, ...] = (0.1, 1.0, 10.0), folds: int = 5, seed: int = 42, ngrams: tuple[int, ...] = (1, 2), vocabulary: int = VOCABULARY):
    """(model, predictions of the held-out fifth): TF-IDF, one-hot labels, lengths, ridge regression.

    The grid has every alpha with words alone and with pairs of words; the mean absolute error over
    the folds decides. A ridge's alpha weighs against the sum of squared errors, Spark's regParam
    against their mean, so it is divided by the rows.
    """
    split = F.pmod(F.xxhash64("row_id", F.lit(seed)), F.lit(5))
    fit, held = rows.where(split != 0), rows.where(split == 0)
    ridge = LinearRegression(elasticNetParam=0.0, maxIter=20, solver="l-bfgs", standardization=False)
    n = max(fit.count(), 1)
    grid = ParamGridBuilder().addGrid(ridge.regParam, [a / n for a in alphas]).build()
    best = None
    for k in ngrams:
        pre = _features(k, vocabulary).fit(fit)
        ready = keep(pre.transform(fit).select("features", "label"), "training")
        cv = CrossValidator(estimator=ridge, estimatorParamMaps=grid, evaluator=RegressionEvaluator(metricName="mae"), numFolds=folds, seed=seed, parallelism=4).fit(ready)
        if best is None or min(cv.avgMetrics) < best[0]:
            best = (min(cv.avgMetrics), pre, cv.bestModel)
    _, pre, model = best
    scored = model.transform(pre.transform(held)).select("row_id", "seccion", "criterio", "label", F.least(F.greatest("prediction", F.lit(0.0)), F.lit(4.0)).alias("prediction"))
    return (pre, model), scored


def error_metrics(scored: DataFrame, truth: str, guess: str, keys: list[str]) -> DataFrame:
    """mae, rmse, r2, count, means and ranges of predictions, over all or by keys."""
    e = F.col(guess) - F.col(truth)
    ss_tot = F.sum(F.col(truth) * F.col(truth)) - F.count(F.lit(1)) * F.avg(truth) * F.avg(truth)
    aggs = [
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.sum(e * e).alias("sse"), ss_tot.alias("sst"),
        F.avg(truth).alias("mean_true"), F.min(truth).alias("min_true"), F.max(truth).alias("max_true"), F.avg(guess).alias("mean_pred"),
    ]
    out = scored.where(F.col(truth).isNotNull() & F.col(guess).isNotNull()).groupBy(*keys).agg(*aggs)
    return out.withColumn("r2", F.when(F.col("sst") > 1e-9, 1 - F.col("sse") / F.col("sst"))).drop("sse", "sst")


def correlation(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson's correlation, 0 where either side doesn't vary."""
    p = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    s = p.agg(F.count(F.lit(1)).alias("n"), F.covar_pop(a, b).alias("c"), F.stddev_pop(a).alias("x"), F.stddev_pop(b).alias("y"))
    return s.select("n", F.when((F.col("x") > 0) & (F.col("y") > 0), F.col("c") / (F.col("x") * F.col("y"))).otherwise(0.0).alias("pearson"))


def expected_correlation(scored: DataFrame, expected: DataFrame, key: str, score: str, wanted: str) -> DataFrame:
    """Pearson's correlation of scores with expected ones of the same key."""
    return correlation(scored.select(key, score).join(expected.select(key, wanted), key), score, wanted)


def save(model, path: str, metrics: DataFrame | None = None) -> None:
    """Both parts of a trained model under a folder, and its metrics as JSON."""
    if metrics is not None:
        metrics.coalesce(1).write.mode("overwrite").json(f"{path}/metrics")
    pre, ridge = model
    pre.write().overwrite().save(f"{path}/features")
    ridge.write().overwrite().save(f"{path}/ridge")


def load(path: str):
    """A model that save() wrote."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.regression import LinearRegressionModel

    return PipelineModel.load(f"{path}/features"), LinearRegressionModel.load(f"{path}/ridge")


def predict(model, rows: DataFrame) -> DataFrame:
    """(row_id, prediction) of training_rows(), kept within the scale."""
    pre, ridge = model
    return ridge.transform(pre.transform(rows)).select("row_id", F.least(F.greatest("prediction", F.lit(0.0)), F.lit(4.0)).alias("prediction"))
