"""Response propensities by logistic regression, and how well they fit."""
from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import RFormula
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotapanel.functions.running import running_sums


def fit_response(
    people: DataFrame, response: str, covariates: list[str], max_iter: int = 25, tol: float = 1e-9
) -> PipelineModel:
    """Binomial logit of the response flag, unweighted.

    Rows with a missing covariate are left out of the fit, as are all columns
    the model does not use; the rest is kept on the executors (spilling to
    disk) over the iterations.
    """
    used = people.select(F.col(response).cast("double").alias(response), *covariates).dropna()
    used = used.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        seen = used.agg(F.min(response).alias("lo"), F.max(response).alias("hi")).first()
        if seen.lo == seen.hi:
            raise ValueError("the response has a single class")
        formula = RFormula(
            formula=f"{response} ~ {' + '.join(covariates)}",
            featuresCol="_features",
            labelCol="_label",
            stringIndexerOrderType="alphabetDesc",
        )
        glm = GeneralizedLinearRegression(
            family="binomial",
            link="logit",
            featuresCol="_features",
            labelCol="_label",
            predictionCol="prob_resp",
            maxIter=max_iter,
            tol=tol,
        )
        model = Pipeline(stages=[formula, glm]).fit(used)
        if model.stages[-1].summary.numIterations >= max_iter:
            raise RuntimeError(f"the response model did not converge in {max_iter} steps")
        return model
    finally:
        used.unpersist()


def predict_response(model: PipelineModel, people: DataFrame, covariates: list[str]) -> DataFrame:
    """Add ``prob_resp``; it stays NULL where a covariate is missing."""
    complete = people.dropna(subset=covariates)
    scored = model.transform(complete).drop("_features", "_label")
    any_missing = F.lit(False)
    for c in covariates:
        any_missing = any_missing | F.col(c).isNull()
    rest = people.where(any_missing).withColumn("prob_resp", F.lit(None).cast("double"))
    return scored.unionByName(rest)


def coefficients(model: PipelineModel, people: DataFrame) -> DataFrame:
    """Coefficient table: term, estimate, standard error, t and p value."""
    spark = people.sparkSession
    glm = model.stages[-1]
    names = _feature_names(model, people)
    summary = glm.summary
    estimates = [*glm.coefficients.toArray().tolist(), glm.intercept]
    rows = zip(
        [*names, "(Intercept)"],
        estimates,
        summary.coefficientStandardErrors,
        summary.tValues,
        summary.pValues,
    )
    return spark.createDataFrame(
        [(n, float(e), float(s), float(t), float(p)) for n, e, s, t, p in rows],
        "term string, estimate double, se double, t double, p double",
    )


def _feature_names(model: PipelineModel, people: DataFrame) -> list[str]:
    scored = model.stages[0].transform(people.limit(1))
    attrs = scored.schema["_features"].metadata["ml_attr"]["attrs"]
    found = sorted((a["idx"], a["name"]) for group in attrs.values() for a in group)
    return [name for _, name in found]


def roc_points(scored: DataFrame, flag: str, score: str) -> DataFrame:
    """Sensitivity and specificity at each distinct score.

    Rows are counted per score first; the running counts are made in ranges.
    """
    s = F.col(score)
    counts = scored.where(s.isNotNull()).groupBy(s.alias("score")).agg(
        F.sum(F.col(flag).cast("long")).alias("pos"), F.sum((1 - F.col(flag)).cast("long")).alias("neg")
    )
    cum = running_sums(counts, "score", ["pos", "neg"])
    totals = cum.agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    return cum.join(F.broadcast(totals), F.lit(True)).select(  # one row
        "score",
        "pos",
        "neg",
        "p",
        "q",
        (F.col("cum_neg") - F.col("neg")).alias("neg_below"),
        ((F.col("p") - F.col("cum_pos") + F.col("pos")) / F.col("p")).alias("sensitivity"),
        ((F.col("cum_neg") - F.col("neg")) / F.col("q")).alias("specificity"),
    )


def auc(scored: DataFrame, flag: str, score: str) -> DataFrame:
    """Area under the curve; ties between classes count one half."""
    points = roc_points(scored, flag, score)
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2))
    return points.agg((wins / F.max("p") / F.max("q")).alias("auc"))


def balance(people: DataFrame, flag: str, covariates: dict[str, Column]) -> DataFrame:
    """Standardised mean difference of covariates between the two groups."""
    aggs = []
    for n, x in covariates.items():
        x = x.cast("double")
        aggs += [F.avg(x).alias(f"m_{n}"), F.var_samp(x).alias(f"v_{n}")]
    groups = people.groupBy(flag).agg(*aggs)
    entries = [
        F.struct(F.lit(n).alias("covariate"), F.col(f"m_{n}").alias("mean"), F.col(f"v_{n}").alias("var"))
        for n in covariates
    ]
    long = groups.select(flag, F.explode(F.array(*entries)).alias("e")).select(flag, "e.*")
    one, zero = F.col(flag) == 1, F.col(flag) == 0

    def of(cond: Column, c: str) -> Column:
        return F.max(F.when(cond, F.col(c)))

    pooled = F.sqrt((of(one, "var") + of(zero, "var")) / 2)
    return long.groupBy("covariate").agg(
        of(one, "mean").alias("mean_1"),
        of(zero, "mean").alias("mean_0"),
        F.try_divide(of(one, "mean") - of(zero, "mean"), pooled).alias("smd"),
    )


def common_support(scored: DataFrame, flag: str, score: str, bins: int = 10) -> DataFrame:
    """Counts of each group by score bin, with the group's range."""
    s = F.col(score)
    bin_of = F.least(F.floor(s * bins) + 1, F.lit(bins).cast("long"))
    counts = scored.where(s.isNotNull()).groupBy(bin_of.alias("bin")).agg(
        F.count_if(F.col(flag) == 1).alias("n_1"),
        F.count_if(F.col(flag) == 0).alias("n_0"),
        F.min(s).alias("lowest"),
        F.max(s).alias("highest"),
    )
    return counts
