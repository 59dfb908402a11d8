"""Fitted text models.

Training text is hand-labelled, hence small beside the records; features stay
sparse vectors made where the rows lie (``weights``), fits run as distributed jobs, and only the
vocabulary, as flat arrays, and the fitted coefficients reach the driver. Applying a model is a narrow pass:
vectors are made, one Arrow batch at a time is multiplied by the
coefficient matrix, and nothing is shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LinearSVC,
    LogisticRegression,
    NaiveBayes,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import DenseMatrix, DenseVector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagspark import fixed
from tagspark.functions.codes import explode_rows, split_codes
from tagspark.functions.text import char_wb_ngrams, clean_text, word_ngrams, word_tokens
from tagspark.operators import features
from tagspark.operators.boosting import fit_boosted
from tagspark.operators.decide import decided
from tagspark.operators.joins import PART, answers_to_parts, in_parts
from tagspark.operators.kernel import fit_kernel_svc
from tagspark.operators.linear import FEATURES, Target, View, arrow_vectors, fit_linear, fit_views, label_sizes, margins
from tagspark.operators.ranking import argmax_class
from tagspark.operators.stochastic import fit_stochastic
from tagspark.operators.text_ops import cleaned
from tagspark.operators.weights import TermVectors, fit_terms
from tagspark.session import keep_table, release

# Coefficients that are sent to the executors at a time, in bytes; a larger matrix goes in blocks of labels.
MAX_MATRIX_BYTES = 256 << 20
# Largest slope at which a fit ends; stochastic settings ask for less.
TOL, SGD_TOL = 1e-4, 1e-3
# The class model's penalty is tiny, so it needs a smaller slope. On 389 records its objective was 3.5e-4 at 1e-4, 0.7e-4 at 1e-6, and 2.2e-4 by the library's learner.
CLASS_TOL = 1e-6


@dataclass(frozen=True)
class Settings:
    """One point of the settings grid."""

    approach: str = "ovr_logistic"
    fields: tuple[str, ...] = fixed.DEFAULT_FIELDS
    clean_text: bool = True
    model_family: str = "logistic"
    ngram_max: int = 1
    char_ngram_max: int = 0
    model_c: float = 10.0
    sgd_loss: str | None = None
    sgd_alpha: float | None = None
    class_weight_mode: str = "none"
    threshold: float = 0.5
    fallback_mode: str = "top_k"
    fallback_min_score: float = 0.0
    top_k_fallback: int = 0
    min_df: int = fixed.MIN_DF
    include_groups: bool = False
    hybrid_rule: str | None = None
    hybrid_conf: float | None = None
    selected_by: str | None = None

    def __post_init__(self) -> None:
        for name, (holds, wanted) in _CHECKS.items():
            value = getattr(self, name)
            if not holds(value, self):
                raise ValueError(f"{name} = {value!r}; wanted: {wanted}")


#: What each setting must be, tested with the other settings at hand.
_CHECKS = {
    "ngram_max": (lambda v, s: v >= 1, "1 or more"),
    "char_ngram_max": (lambda v, s: v == 0 or v >= 3, "0, or 3 or more"),
    "model_family": (lambda v, s: v in ("logistic", "linear_svc", "sgd"), "logistic, linear_svc or sgd"),
    "class_weight_mode": (lambda v, s: v in ("none", "balanced"), "none or balanced"),
    "fallback_mode": (lambda v, s: v in ("none", "top_k", "max_score_top_1"), "none, top_k or max_score_top_1"),
    "sgd_loss": (lambda v, s: s.model_family != "sgd" or v in ("log_loss", "modified_huber"), "log_loss or modified_huber"),
    "sgd_alpha": (lambda v, s: s.model_family != "sgd" or (v is not None and v > 0), "more than 0"),
    "model_c": (lambda v, s: s.model_family == "sgd" or v > 0, "more than 0"),
}


# --- features ---------------------------------------------------------------

def _tokenised(df: DataFrame, text: str, s: Settings) -> DataFrame:
    words = F.coalesce(word_tokens(F.col(text)), F.expr("cast(array() as array<string>)"))
    out = df.withColumn("_tokens", words)
    out = out.withColumn("_words", word_ngrams(F.col("_tokens"), s.ngram_max)).drop("_tokens")
    if s.char_ngram_max:
        grams = char_wb_ngrams(F.coalesce(text, F.lit("")), s.char_ngram_max)
        out = out.withColumn("_chars", grams)
    return out


def _token_columns(s: Settings) -> list[str]:
    return ["_words", "_chars"] if s.char_ngram_max else ["_words"]


def feature_union(tokenised: DataFrame, s: Settings) -> TermVectors:
    """Word part and, if asked for, character part: weighted and scaled apart,
    then side by side in one vector."""
    n = tokenised.count()
    return TermVectors([fit_terms(tokenised, c, s.min_df, n) for c in _token_columns(s)])


def featurise(df: DataFrame, text: str, s: Settings, model: TermVectors, keep: Sequence[str]) -> DataFrame:
    return model.transform(_tokenised(df, text, s).select(*keep, *_token_columns(s))).select(*keep, FEATURES)


def _load_features(spark: SparkSession, path: str) -> TermVectors | PipelineModel:
    """Stored vectors; those of before, stages of the library, are read as such."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/metadata")
    old = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    return PipelineModel.load(path) if old else TermVectors.load(spark, path)


def word_places(model: TermVectors, terms: Sequence[str], spark: SparkSession) -> dict[str, int]:
    """Places of some terms in the word part of a feature union."""
    return model.places(terms)


def keep_for_fits(df: DataFrame) -> DataFrame:
    """A table that many fits read, kept as ``session.keep_table`` keeps it."""
    return keep_table(df, "fit")


def _save_coefficients(spark: SparkSession, path: str, labels: Sequence[str], coef, intercept) -> None:
    """One table row per label, with its coefficients that are not 0."""
    import pyarrow as pa

    for i, label in enumerate(labels):
        at = np.flatnonzero(coef[i]).astype(np.int32)
        cells = {"position": pa.array([i], pa.int32()), "code": pa.array([label], pa.string()), "width": pa.array([coef.shape[1]], pa.int32()), "places": _one_list(at), "coef": _one_list(coef[i][at]), "intercept": pa.array([float(intercept[i])])}
        spark.createDataFrame(pa.table(cells)).write.mode("append" if i else "overwrite").parquet(path)


def _one_list(values: np.ndarray):
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))


def _load_coefficients(spark: SparkSession, path: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    rows = spark.read.parquet(path).orderBy("position").toArrow().combine_chunks()
    width = rows["width"].to_pylist() if "width" in rows.column_names else [len(x) for x in rows["coef"]]
    coef = np.zeros((rows.num_rows, max(width, default=0)))
    for i in range(rows.num_rows):
        values = rows["coef"][i].values.to_numpy(zero_copy_only=False)
        coef[i, rows["places"][i].values.to_numpy() if "places" in rows.column_names else slice(None)] = values
    return rows["code"].to_pylist(), coef, np.array(rows["intercept"].to_pylist())


# --- linear one-vs-rest model -------------------------------------------------

@dataclass
class OvrModel:
    """One linear scorer per label over shared features."""

    settings: Settings
    features: TermVectors
    labels: list[str]
    coef: np.ndarray  # labels x terms
    intercept: np.ndarray
    link: str  # sigmoid, margin or clipped
    info: dict = field(default_factory=dict)
    lexicon: DataFrame | None = None  # base forms that cleaning looks up

    def text_of(self, df: DataFrame, corpus: str) -> DataFrame:
        """The text the model reads: cleaned, and in base forms, as it was trained."""
        if not self.settings.clean_text:
            return df.withColumn("_text", F.col(corpus))
        return cleaned(df, corpus, self.lexicon)

    def ranked(self, df: DataFrame, corpus: str = "corpus", keep: Sequence[str] = ("org_id",)) -> DataFrame:
        """``keep`` columns and the list of scores, best first."""
        rows = self.text_of(df, corpus)
        vectors = featurise(rows, "_text", self.settings, self.features, keep)
        scored = _score_vectors(vectors, keep, self.coef, self.intercept, self.link)
        names = F.array(*[F.lit(x) for x in self.labels])
        pairs = F.zip_with(
            "_scores", names, lambda s, c: F.struct((-s).alias("neg"), c.alias("code"))
        )
        return scored.select(*keep, F.array_sort(pairs).alias("ranked"))

    def scores(self, df: DataFrame, corpus: str = "corpus", id: str = "org_id") -> DataFrame:
        rows = explode_rows(self.ranked(df, corpus, [id]), [id], "ranked", "_s")
        return rows.select(id, F.col("_s.code").alias("code"), (-F.col("_s.neg")).alias("score"))

    def predict(self, df: DataFrame, corpus: str = "corpus", keep: Sequence[str] = ("org_id",)) -> DataFrame:
        """Code sets by the model's own threshold and fallback."""
        s = self.settings
        codes = decided(
            F.col("ranked"), s.threshold, s.fallback_mode, s.top_k_fallback, s.fallback_min_score
        )
        return self.ranked(df, corpus, keep).select(*keep, codes.alias("predicted_codes"), "ranked")

    def save(self, spark: SparkSession, path: str, with_features: bool = True) -> None:
        """Feature stages, and one table row per label, with its coefficients that are not 0."""
        if with_features:
            self.features.save(spark, f"{path}/features")
        _save_coefficients(spark, f"{path}/labels", self.labels, self.coef, self.intercept)
        if self.lexicon is not None:
            self.lexicon.select("surface", "lemma").write.mode("overwrite").parquet(f"{path}/lexicon")
        meta = json.dumps(
            {"settings": asdict(self.settings), "link": self.link, "info": self.info, "lexicon": self.lexicon is not None}
        )
        spark.createDataFrame([(meta,)], "meta string").coalesce(1).write.mode("overwrite").text(
            f"{path}/settings"
        )

    @staticmethod
    def load(spark: SparkSession, path: str, shared: TermVectors | None = None) -> OvrModel:
        """A saved model; with ``shared``, one that was saved without the feature stages that it shares."""
        meta = json.loads(spark.read.text(f"{path}/settings").first()[0])
        meta["settings"]["fields"] = tuple(meta["settings"]["fields"])
        labels, coef, intercept = _load_coefficients(spark, f"{path}/labels")
        return OvrModel(
            Settings(**meta["settings"]),
            shared or _load_features(spark, f"{path}/features"),
            labels,
            coef,
            intercept,
            meta["link"],
            meta["info"],
            spark.read.parquet(f"{path}/lexicon") if meta.get("lexicon") else None,
        )


def _score_vectors(vectors: DataFrame, keep: Sequence[str], coef, intercept, link: str) -> DataFrame:
    """Scores as one array per row: blocks of labels follow each other, each with a broadcast of bounded size."""
    return _scored(vectors.select(*keep, FEATURES), coef, intercept, link).select(*keep, "_scores")


def _scored(rows: DataFrame, coef, intercept, link: str) -> DataFrame:
    """``rows``, which hold vectors, with their scores as the last column."""
    per = max(1, MAX_MATRIX_BYTES // max(1, 8 * coef.shape[1]))
    out = rows.select("*", F.expr("cast(array() as array<double>)").alias("_scores"))
    for start in range(0, max(1, len(coef)), per):
        out = _score_block(out, coef[start : start + per], intercept[start : start + per], link)
    return out


def _score_block(rows: DataFrame, coef, intercept, link: str) -> DataFrame:
    """Append the scores of some labels to the array that the row carries."""
    shared = rows.sparkSession.sparkContext.broadcast((np.ascontiguousarray(coef.T), np.asarray(intercept)))

    def run(batches):
        import pyarrow as pa

        weights, bias = shared.value
        for batch in batches:
            at = batch.schema.get_field_index(FEATURES)
            scores = margins(*arrow_vectors(batch.column(at)), weights, bias)
            if link == "sigmoid":
                scores = 1.0 / (1.0 + np.exp(-scores))
            elif link == "clipped":
                scores = (np.clip(scores, -1.0, 1.0) + 1.0) / 2.0
            n = len(scores)
            before = batch.column(batch.schema.get_field_index("_scores"))
            had = np.asarray(before.flatten()).reshape(n, -1) if n else np.zeros((0, 0))
            both = np.hstack([had, scores])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * both.shape[1]), pa.array(both.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


# --- fitting -----------------------------------------------------------------

def fit_ovr_logistic(features: DataFrame, c: float, weights: str = "none", tol: float = TOL):
    """(labels, coefficients, intercepts): logistic regression per label.

    Minimising ``C * sum(loss) + |w|^2 / 2`` is the same as minimising the mean
    loss plus ``|w|^2 / (2 * C * n)``.
    """
    return fit_linear(features, "logistic", 1.0 / (c * features.count()), weights, tol=tol)


def fit_ovr_svc(features: DataFrame, c: float, weights: str = "none", tol: float = TOL):
    """Linear support vector machine per label: squared hinge, intercept
    regularised with the other coefficients."""
    l2 = 1.0 / (c * features.count())
    return fit_linear(features, "squared_hinge", l2, weights, regularise_bias=True, tol=tol)


def fit_ovr_sgd(features: DataFrame, loss: str, alpha: float, weights: str = "none", tol: float = SGD_TOL, passes: int | None = None, seed: int = fixed.SEED):
    """``log_loss`` or ``modified_huber`` with an L2 penalty of ``alpha``.

    With ``passes``, true stochastic steps, at most so many passes (see ``stochastic``); without, full-batch steps reach the
    optimum that stochastic ones circle around.
    """
    if passes is not None:
        return fit_stochastic(features, loss, alpha, weights, passes, seed)
    return fit_linear(features, _SGD_LOSSES[loss], alpha, weights, tol=tol)


_SGD_LOSSES = {"log_loss": "logistic", "modified_huber": "modified_huber"}


def prepared(
    gold: DataFrame, s: Settings, corpus: str = "corpus", truth: str = "tags",
    id: str = "org_id", lexicon: DataFrame | None = None,
) -> tuple[TermVectors, DataFrame]:
    """Feature stages fitted on labelled rows, and the rows' ``labels, features``, kept for fits (``release`` them)."""
    text = cleaned(gold, corpus, lexicon, id) if s.clean_text else gold.withColumn("_text", F.col(corpus))
    rows = text.select(id, "_text", F.array_distinct(split_codes(F.col(truth))).alias("labels"))
    # Counting, weighting and fitting all read the tokens: make them once.
    tokens = keep_for_fits(_tokenised(rows, "_text", s))
    pipeline = feature_union(tokens, s)
    kept = keep_for_fits(pipeline.transform(tokens.select("labels", *_token_columns(s))).select("labels", FEATURES))
    release(tokens)
    return pipeline, kept


def targets(s: Settings, labels: Sequence[str], n: int, tol: float | None = None) -> list[Target]:
    """What the settings fit for each label on ``n`` rows: the objectives of ``fit_ovr_logistic``, ``fit_ovr_svc`` and ``fit_ovr_sgd``."""
    close = tol or (SGD_TOL if s.model_family == "sgd" else TOL)
    if s.model_family == "logistic":
        loss, l2, bias = "logistic", 1.0 / (s.model_c * n), False
    elif s.model_family == "linear_svc":
        loss, l2, bias = "squared_hinge", 1.0 / (s.model_c * n), True
    else:
        loss, l2, bias = _SGD_LOSSES[s.sgd_loss], s.sgd_alpha, False
    return [Target(c, loss, l2, s.class_weight_mode, bias, tol=close) for c in labels]


def link_of(s: Settings) -> str:
    """How margins become scores."""
    if s.model_family == "logistic" or (s.model_family == "sgd" and s.sgd_loss == "log_loss"):
        return "sigmoid"
    return "margin" if s.model_family == "linear_svc" else "clipped"


def train_final(
    gold: DataFrame, s: Settings, corpus: str = "corpus", truth: str = "tags",
    id: str = "org_id", lexicon: DataFrame | None = None, tol: float | None = None,
) -> OvrModel:
    """Fit the chosen settings on all labelled rows, until no slope is above ``tol`` (by default that of the model family).

    A lexicon ``(surface, lemma)`` puts cleaned words in their base form; the model keeps it for scoring.
    """
    pipeline, kept = prepared(gold, s, corpus, truth, id, lexicon)
    try:
        sizes, n = label_sizes(kept)
        labels = sorted(sizes)
        fitted = fit_views({"all": View(kept, targets(s, labels, n, tol))})["all"]
    finally:
        release(kept)
    steps = dict(zip(labels, fitted.report, strict=True))
    return OvrModel(s, pipeline, labels, fitted.coef, fitted.intercept, link_of(s), {"steps": steps}, lexicon if s.clean_text else None)


def train_many(named: dict[str, tuple[DataFrame, Sequence[Settings]]], corpus: str = "corpus", truth: str = "tags", id: str = "org_id") -> dict[str, list[OvrModel]]:
    """Models of many settings on several sets of rows (splits, or texts made of other fields), all fitted together.

    The settings of one set must agree in how features are made. Features are made once for each set; the jobs of
    the fits do not depend on how many settings there are.
    """
    views, pipelines, kept = {}, {}, []
    try:
        for name, (rows, settings) in named.items():
            if len({feature_key(s) for s in settings}) > 1:
                raise ValueError(f"settings of {name!r} make different features")
            pipelines[name], features = prepared(rows, settings[0], corpus, truth, id)
            kept.append(features)
            sizes, n = label_sizes(features)
            views[name] = View(features, [t for s in settings for t in targets(s, sorted(sizes), n)])
        fitted = fit_views(views)
    finally:
        release(*kept)
    out: dict[str, list[OvrModel]] = {}
    for name, (_, settings) in named.items():
        k = len(views[name].targets) // len(settings)
        labels = [t.label for t in views[name].targets[:k]]
        for i, s in enumerate(settings):
            part, f = slice(i * k, (i + 1) * k), fitted[name]
            out.setdefault(name, []).append(OvrModel(s, pipelines[name], labels, f.coef[part], f.intercept[part], link_of(s), {"steps": dict(zip(labels, f.report[part], strict=True))}))
    return out


def feature_key(s: Settings) -> tuple:
    """What features depend on."""
    return s.fields, s.clean_text, s.ngram_max, s.char_ngram_max, s.min_df


def training_key(s: Settings) -> tuple:
    """What a fit depends on beside its features."""
    return s.model_family, s.model_c, s.sgd_loss, s.sgd_alpha, s.class_weight_mode


def ranked_many(models: Sequence[OvrModel], names: Sequence[str], df: DataFrame, corpus: str = "corpus", keep: Sequence[str] = ("org_id",)) -> DataFrame:
    """``name``, ``keep`` columns and ``ranked`` of several models that share features and labels, in one pass over the texts."""
    one = models[0]
    vectors = featurise(one.text_of(df, corpus), "_text", one.settings, one.features, keep)
    scored = _score_vectors(vectors, keep, np.vstack([m.coef for m in models]), np.concatenate([m.intercept for m in models]), "margin")
    k = len(one.labels)
    labels = F.array(*[F.lit(x) for x in one.labels]) if k else F.expr("cast(array() as array<string>)")
    which = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(i * k + 1).alias("start"), F.lit(m.link).alias("link")) for i, (n, m) in enumerate(zip(names, models, strict=True))])
    rows = scored.select(*keep, "_scores", F.explode(which).alias("_m"))

    def score(x):
        clipped = (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)) + 1.0) / 2.0
        return F.when(F.col("_m.link") == "sigmoid", 1.0 / (1.0 + F.exp(-x))).when(F.col("_m.link") == "clipped", clipped).otherwise(x)

    pairs = F.zip_with(F.slice("_scores", F.col("_m.start"), F.lit(k)), labels, lambda x, c: F.struct((-score(x)).alias("neg"), c.alias("code")))
    return rows.select(F.col("_m.name").alias("name"), *keep, F.array_sort(pairs).alias("ranked"))


# --- single-class models --------------------------------------------------------

@dataclass
class ClassModel:
    """Feature stages, a multi-class model and its class names."""

    features: TermVectors
    model: PipelineModel
    clean: bool = True

    def _vectors(self, df: DataFrame, corpus: str, keep: Sequence[str]) -> DataFrame:
        text = clean_text(F.col(corpus)) if self.clean else F.col(corpus)
        rows = df.withColumn("_text", text)
        return featurise(rows, "_text", _CLASS_FEATURES, self.features, keep)

    @property
    def classes(self) -> list[str]:
        return list(self.model.stages[-1].getLabels())

    def predict(self, df: DataFrame, corpus: str = "corpus", keep: Sequence[str] = ("org_id",)) -> DataFrame:
        """Best class and its probability (null where the learner has none)."""
        from pyspark.ml.functions import vector_to_array

        out = self.model.transform(self._vectors(df, corpus, keep))
        best = F.lit(None).cast("double")
        if "probability" in out.columns:
            best = F.array_max(vector_to_array("probability"))
        return out.select(*keep, "class_code", best.alias("class_code_probability"))

    def scores(self, df: DataFrame, corpus: str = "corpus", id: str = "org_id") -> DataFrame:
        """Probability of every class, one row each."""
        from pyspark.ml.functions import vector_to_array

        out = self.model.transform(self._vectors(df, corpus, [id]))
        names = F.array(*[F.lit(x) for x in self.classes])
        pairs = F.arrays_zip(names.alias("code"), vector_to_array("probability").alias("score"))
        return out.select(id, F.explode(pairs).alias("_p")).select(id, "_p.code", "_p.score")

    def save(self, spark: SparkSession, path: str) -> None:
        self.features.save(spark, f"{path}/features")
        first = self.model.stages[0]
        if isinstance(first, LinearClasses):
            _save_coefficients(spark, f"{path}/classes", self.classes, first.coef, first.intercept)
        else:
            self.model.write().overwrite().save(f"{path}/model")
        spark.createDataFrame([(self.clean, isinstance(first, LinearClasses))], "clean boolean, linear boolean").coalesce(1).write.mode(
            "overwrite"
        ).json(f"{path}/settings")

    @staticmethod
    def load(spark: SparkSession, path: str) -> ClassModel:
        clean, linear = spark.read.schema("clean boolean, linear boolean").json(f"{path}/settings").first()
        if linear:
            classes, coef, intercept = _load_coefficients(spark, f"{path}/classes")
            model = PipelineModel([LinearClasses(coef, intercept), _named(classes)])
        else:
            model = PipelineModel.load(f"{path}/model")
        return ClassModel(_load_features(spark, f"{path}/features"), model, clean)


def _named(classes: Sequence[str]) -> IndexToString:
    return IndexToString(inputCol="prediction", outputCol="class_code", labels=list(classes))


_CLASS_FEATURES = Settings(clean_text=False, ngram_max=1, char_ngram_max=0, min_df=1)


@dataclass
class LinearClasses:
    """Coefficients (classes x terms) and intercepts of a multinomial model, applied block by block where the rows lie."""

    coef: np.ndarray
    intercept: np.ndarray

    @property
    def coefficientMatrix(self) -> DenseMatrix:  # named as in the library's models
        return DenseMatrix(*self.coef.shape, self.coef.ravel(), isTransposed=True)

    @property
    def interceptVector(self) -> DenseVector:
        return DenseVector(self.intercept)

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``probability`` of each class, and the place of the likeliest as ``prediction``, the first on ties."""
        scored = _scored(rows, self.coef, self.intercept, "margin")
        top = F.array_max("_scores")
        powers = scored.withColumn("_powers", F.transform("_scores", lambda x: F.exp(x - top)))
        whole = F.aggregate("_powers", F.lit(0.0), lambda a, x: a + x)
        place = (F.array_position("_scores", top) - 1).cast("double")
        return powers.withColumns({"probability": array_to_vector(F.transform("_powers", lambda x: x / whole)), "prediction": place}).drop("_scores", "_powers")


@dataclass(frozen=True)
class _MultinomialFit:
    """Multinomial logistic regression by the steps of ``linear``, which end at a largest slope of ``CLASS_TOL``.

    The library's learner ends at a relative gain of the loss; where classes separate, the loss goes to 0 and that says little.
    """

    c: float
    n: int
    max_iter: int

    def fit(self, rows: DataFrame):
        features = rows.select(FEATURES, F.array("_class").alias("labels"))
        classes = sorted(label_sizes(features)[0])
        l2 = 1.0 / (self.c * max(1, self.n))
        if len(classes) < 2:
            return LogisticRegression(family="multinomial", standardization=False, regParam=l2, maxIter=self.max_iter, tol=1e-4).fit(rows)
        found = fit_views({"all": View(features, [Target(x, "softmax", l2, group="classes") for x in classes])}, self.max_iter, CLASS_TOL)["all"]
        return LinearClasses(found.coef, found.intercept)


def classifiers(c: float = fixed.CLASS_C, max_iter: int = fixed.CLASS_MAX_ITER) -> dict:
    """Learners of the comparison that have a distributed form."""
    svc = LinearSVC(maxIter=5, regParam=1e-3, standardization=False)
    return {
        "naive_bayes": lambda n: NaiveBayes(modelType="multinomial", smoothing=1.0),
        "logistic_regression": lambda n: _MultinomialFit(c, n, max_iter),
        "sgd_hinge": lambda n: OneVsRest(classifier=svc, parallelism=4),
        "decision_tree": lambda n: DecisionTreeClassifier(maxDepth=5, seed=fixed.SEED),
        "random_forest": lambda n: RandomForestClassifier(
            numTrees=10, maxDepth=5, featureSubsetStrategy="1", seed=fixed.SEED
        ),
    }


def fit_class(
    train: DataFrame, learner, corpus: str = "corpus", label: str = "class_code",
    clean: bool = True, features: TermVectors | None = None,
) -> ClassModel:
    """Any multi-class learner on word features."""
    text = clean_text(F.col(corpus)) if clean else F.col(corpus)
    rows = train.where(F.col(label).isNotNull()).select(F.col(label).alias("_class"), text.alias("_text"))
    tokens = keep_for_fits(_tokenised(rows, "_text", _CLASS_FEATURES))
    stages = features or feature_union(tokens, _CLASS_FEATURES)
    kept = keep_for_fits(stages.transform(tokens.select("_class", "_words")).select("_class", FEATURES))
    try:
        n = kept.count()
        index = StringIndexer(
            inputCol="_class", outputCol="label", stringOrderType="alphabetAsc"
        ).fit(kept)
        fitted = learner(n).fit(index.transform(kept))
    finally:
        release(kept, tokens)
    return ClassModel(stages, PipelineModel([fitted, _named(index.labels)]), clean)


def fit_class_lr(
    train: DataFrame, corpus: str = "corpus", label: str = "class_code",
    c: float = fixed.CLASS_C, max_iter: int = fixed.CLASS_MAX_ITER, clean: bool = True,
) -> ClassModel:
    """Multinomial logistic regression on tf-idf words."""
    return fit_class(train, classifiers(c, max_iter)["logistic_regression"], corpus, label, clean)


def fit_class_svc(
    train: DataFrame, corpus: str = "corpus", label: str = "class_code", c: float = 1.0
) -> OvrModel:
    """Linear support vector machine, one scorer per class; the best one wins."""
    s = Settings(model_family="linear_svc", model_c=c, min_df=1)
    return train_final(train.where(F.col(label).isNotNull()), s, corpus, label)


def model_compare(
    train: DataFrame, test: DataFrame, names: Sequence[str] | None = None,
    corpus: str = "corpus", label: str = "class_code", id: str = "org_id", max_iter: int = fixed.CLASS_MAX_ITER,
    rounds: int = fixed.BOOSTING_ROUNDS,
) -> DataFrame:
    """Predictions of several learners on one split: (classifier, id, truth, class_code).

    All learners but the per-class one share the features of the first.
    """
    available = classifiers(max_iter=max_iter)
    held = test.withColumn("truth", F.col(label))
    shared, out = None, None
    for name in names or [*available, "linear_svc", "kernel_svc", "ada_boost"]:
        if name == "linear_svc":
            ranked = fit_class_svc(train, corpus, label).ranked(held, corpus, [id, "truth"])
            rows = ranked.withColumn("class_code", F.col("ranked")[0]["code"])
        elif name == "ada_boost":
            rows = fit_boosted(train, rounds, corpus, label).predict(held, corpus, [id, "truth"])
        elif name == "kernel_svc":
            rows = fit_kernel_svc(train, corpus, label).predict(held, corpus, [id, "truth"])
        else:
            model = fit_class(train, available[name], corpus, label, features=shared)
            shared = model.features
            rows = model.predict(held, corpus, [id, "truth"])
        rows = rows.select(F.lit(name).alias("classifier"), id, "truth", "class_code")
        out = rows if out is None else out.unionByName(rows)
    return out


_CLASS_SETTINGS = Settings(clean_text=True, ngram_max=1, char_ngram_max=0, min_df=1)


@dataclass
class TwoStepModel:
    """A model of sections, one model for each section with several codes, and the codes of the others."""

    first: OvrModel
    inside: dict[str, OvrModel]
    single: dict[str, str]

    def predict(self, df: DataFrame, corpus: str = "corpus", keep: Sequence[str] = ("org_id",)) -> DataFrame:
        """``keep`` columns, ``section`` and ``class_code``: the best section, then its best code; first in order on ties.

        Predicted sections are kept, so the first model scores the rows once and each second model only reads its own part.
        """
        best = F.col("ranked")[0]["code"]
        rows = df.select(*keep, corpus) if corpus not in keep else df.select(*keep)
        guess = self.first.ranked(rows, corpus, list(dict.fromkeys([*keep, corpus])))
        guess = keep_for_fits(guess.withColumn("section", best).drop("ranked"))
        code = F.lit(None).cast("string")
        for section, only in self.single.items():
            code = F.when(F.col("section") == section, F.lit(only)).otherwise(code)
        out = guess.where(~F.col("section").isin(list(self.inside))).select(*keep, "section", code.alias("class_code"))
        for section, model in sorted(self.inside.items()):
            part = model.ranked(guess.where(F.col("section") == section), corpus, [*keep, "section"])
            out = out.unionByName(part.select(*keep, "section", best.alias("class_code")))
        return out

    def save(self, spark: SparkSession, path: str) -> None:
        """One folder for each model, and the codes that need none. Feature stages that a second model shares with the first are saved once."""
        self.first.save(spark, f"{path}/first")
        for section, model in self.inside.items():
            model.save(spark, f"{path}/inside/{section}", model.features is not self.first.features)
        rows = [(s, None, m.features is self.first.features) for s, m in self.inside.items()] + [(s, c, None) for s, c in self.single.items()]
        spark.createDataFrame(rows, "section string, code string, shared boolean").coalesce(1).write.mode("overwrite").parquet(f"{path}/sections")

    @staticmethod
    def load(spark: SparkSession, path: str) -> TwoStepModel:
        rows = spark.read.parquet(f"{path}/sections").collect()
        first = OvrModel.load(spark, f"{path}/first")
        alike = {r["section"]: first.features if r.asDict().get("shared") else None for r in rows if r["code"] is None}
        return TwoStepModel(
            first,
            {s: OvrModel.load(spark, f"{path}/inside/{s}", shared) for s, shared in alike.items()},
            {r["section"]: r["code"] for r in rows if r["code"] is not None},
        )


def fit_two_step(
    train: DataFrame, corpus: str = "corpus", label: str = "class_code", id: str = "org_id",
    c: float = fixed.CLASS_C, max_iter: int = fixed.CLASS_MAX_ITER,
) -> TwoStepModel:
    """Multinomial models of the sections and of the codes inside each, fitted by one series of jobs.

    Each section's model sees its own rows and its own terms, so it is the model a fit of its own would give; rows of other sections
    are in other packs. A section of one code needs no model.
    """
    rows = keep_for_fits(train.where(F.col(label).isNotNull()).select(id, corpus, F.col(label).alias("_code"), F.substring(label, 1, 1).alias("_section")))
    found = rows.groupBy("_section").agg(F.array_sort(F.collect_set("_code")).alias("codes")).collect()
    single = {r["_section"]: r["codes"][0] for r in found if len(r["codes"]) == 1}
    parts = {"": (rows, "_section")} | {r["_section"]: (rows.where(F.col("_section") == r["_section"]), "_code") for r in found if len(r["codes"]) > 1}
    views, pipelines, kept = {}, {}, [rows]
    try:
        for name, (part, truth) in parts.items():
            pipelines[name], features = prepared(part, _CLASS_SETTINGS, corpus, truth, id)
            kept.append(features)
            sizes, n = label_sizes(features)
            views[name] = View(features, [Target(x, "softmax", 1.0 / (c * max(1, n)), group="classes") for x in sorted(sizes)])
        fitted = fit_views(views, max_iter)
    finally:
        release(*kept)
    made = {}
    for name, f in fitted.items():
        labels = [t.label for t in views[name].targets]
        made[name] = OvrModel(_CLASS_SETTINGS, pipelines[name], labels, f.coef, f.intercept, "margin", {"steps": dict(zip(labels, f.report, strict=True))})
    return TwoStepModel(made.pop(""), made, single)


def two_step_classify(
    train: DataFrame, test: DataFrame, corpus: str = "corpus", label: str = "class_code",
    id: str = "org_id", max_iter: int = fixed.CLASS_MAX_ITER,
) -> DataFrame:
    """Section first, then the code inside the predicted section: ``id, truth, section, class_code`` of the test rows."""
    model = fit_two_step(train, corpus, label, id, max_iter=max_iter)
    return model.predict(test.withColumn("truth", F.col(label)), corpus, [id, "truth"])


def two_step_counting(
    train_terms: DataFrame, train_labels: DataFrame, test_terms: DataFrame, label: str = "class_code", id: str = "org_id"
) -> DataFrame:
    """The two steps by counting: naive Bayes picks the section, then the code among those of that section.

    Term tables are ``(id, term, tf)``. All sections are counted and scored in one pass, whatever their
    number; records without a known term of their section are left out, as they are by one step.
    """
    sections = train_labels.select(id, F.col(label).alias("label"), F.substring(label, 1, 1).alias("section"))
    train_terms, test_terms = in_parts(train_terms, id), in_parts(test_terms, id)
    first = features.naive_bayes_sql(train_terms, sections.select(id, F.col("section").alias("label")), test_terms, id=id)
    guess = answers_to_parts(in_parts(argmax_class(first, id, out="section").select(id, "section"), id))
    scores = features.naive_bayes_sql(train_terms, sections, test_terms.join(guess, [PART, id]), by=("section",), id=id)
    return argmax_class(scores, id, out=label, by=("section",)).select(id, "section", label)
