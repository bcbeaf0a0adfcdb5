"""Learned operators on pyspark.ml: TF-IDF, matched meta-models with out-of-fold scores, benefit router, anchors."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import CountVectorizer, Normalizer, RegexTokenizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scores import threshold_search


def tfidf(docs: DataFrame, text: str = "text", terms: int = 256) -> DataFrame:
    """features: at most ``terms`` terms by corpus frequency, smooth idf ln((1 + n) / (1 + df)) + 1, unit length."""
    words = RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"\b\w+\b", gaps=False, toLowercase=True)
    counts = CountVectorizer(inputCol="_words", outputCol="_tf", vocabSize=terms)
    model = Pipeline(stages=[words, counts]).fit(docs.select(text))
    rows = model.transform(docs)
    size = len(model.stages[1].vocabulary)
    # One row of sums for the whole corpus, bounded by the number of terms.
    n, df = rows.select(F.posexplode(vector_to_array("_tf")).alias("k", "tf")).groupBy("k").agg(F.sum((F.col("tf") > 0).cast("long")).alias("df")), rows.count()
    idf = {r["k"]: r["df"] for r in n.collect()}
    weights = F.array(*[F.ln(F.lit((1.0 + df) / (1.0 + idf.get(k, 0)))) + 1 for k in range(size)])
    from pyspark.ml.functions import array_to_vector

    rows = rows.withColumn("_w", array_to_vector(F.zip_with(vector_to_array("_tf"), weights, lambda a, b: a * b)))
    return Normalizer(inputCol="_w", outputCol="features").transform(rows).drop("_words", "_tf", "_w")


def folds(df: DataFrame, key: str, y: str, group: str | None = None, k: int = 3) -> DataFrame:
    """fold in 0..k-1: by hash of the group if there is one, else in turns within each class by hash order."""
    if group:
        return df.withColumn("fold", F.pmod(F.xxhash64(F.col(group)), F.lit(k)).cast("int"))
    return df.withColumn("fold", F.pmod(F.row_number().over(W.partitionBy(y).orderBy(F.xxhash64(key), key)), F.lit(k)))


def _model(features: list[str], y: str, n: int, c: float = 1.0):
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=features, outputCol="_raw"),
            StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True),
            LogisticRegression(featuresCol="_x", labelCol=y, regParam=1.0 / (c * max(n, 1)), standardization=False, probabilityCol="_p", predictionCol="_y", rawPredictionCol="_margin"),
        ]
    )


def fit_meta(df: DataFrame, features: list[str], y: str = "y"):
    return _model(features, y, df.count()).fit(df)


def apply_meta(model, df: DataFrame, score: str) -> DataFrame:
    return model.transform(df).withColumn(score, vector_to_array("_p")[1]).drop("_raw", "_x", "_p", "_y", "_margin")


def out_of_fold(df: DataFrame, features: list[str], y: str = "y", key: str = "id", group: str | None = None, k: int = 3, score: str = "oof") -> DataFrame:
    """Scores of each fold by the model of the others."""
    rows = folds(df, key, y, group, k)
    out = None
    for f in range(k):
        part = apply_meta(fit_meta(rows.filter(F.col("fold") != f), features, y), rows.filter(F.col("fold") == f), score)
        out = part if out is None else out.unionByName(part)
    return out


def matched_pair(validation: DataFrame, test: DataFrame, base: list[str], extra: list[str], y: str = "y", key: str = "id") -> DataFrame:
    """Test scores p_pre (base features) and p_post (with the expert's), and predictions at thresholds locked on validation.

    Rows whose expert is invalid copy the score before. Thresholds come from out-of-fold scores of validation alone.
    """
    out, taus = test, {}
    for name, features in (("pre", base), ("post", base + extra)):
        tau = threshold_search(out_of_fold(validation, features, y, key), y, "oof").first()["tau"]
        taus[name] = tau
        out = apply_meta(fit_meta(validation, features, y), out, f"p_{name}")
    out = out.withColumn("p_post", F.when(F.col("valid"), F.col("p_post")).otherwise(F.col("p_pre")))
    return out.withColumns({f"pred_{n}": (F.col(f"p_{n}") >= t).cast("int") for n, t in taus.items()}).withColumns({f"tau_{n}": F.lit(t) for n, t in taus.items()})


def benefit_router(df: DataFrame, features: list[str], benefit: str, valid: str, alpha: float = 10.0) -> DataFrame:
    """rank_score: ridge regression of repair minus harm, fitted on valid rows."""
    rows = VectorAssembler(inputCols=features, outputCol="_x").transform(df)
    known = rows.filter(valid)
    model = LinearRegression(featuresCol="_x", labelCol=benefit, predictionCol="rank_score", regParam=alpha / max(known.count(), 1), elasticNetParam=0.0).fit(known)
    return model.transform(rows).drop("_x")


def anchor_mlp(train: DataFrame, test: DataFrame, features: list[str], y: str, seed: int = 42, hidden: int = 128) -> DataFrame:
    """s_mlp of test rows by a perceptron of one hidden layer."""
    prep = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_x", withMean=True)]).fit(train)
    net = MultilayerPerceptronClassifier(featuresCol="_x", labelCol=y, layers=[len(features), hidden, 2], seed=seed, maxIter=50, probabilityCol="_p", predictionCol="_y", rawPredictionCol="_m").fit(prep.transform(train))
    return net.transform(prep.transform(test)).withColumn("s_mlp", vector_to_array("_p")[1]).drop("_raw", "_x", "_p", "_y", "_m")
