"""The class model on classes that separate: it ends when no slope is left, not after all steps allowed."""

import uuid

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tagspark import fixed
from tagspark.operators import models

WORDS = {"A10": "the and", "A20": "pour les", "B10": "und die", "B20": "para con"}


def rows(spark, classes=tuple(WORDS)):
    made = [(str(i), f"{WORDS[c]} w{i % 7} x{i % 3}", c) for i, c in enumerate(classes * 10)]
    return spark.createDataFrame(made, "org_id string, corpus string, class_code string").coalesce(1)


def test_steps_end_where_classes_separate(spark):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "fit")
    try:
        model = models.fit_class_lr(rows(spark), clean=False)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 100
    got = model.predict(rows(spark), keep=["org_id", "corpus"]).join(rows(spark).select("org_id", F.col("class_code").alias("truth")), "org_id")
    assert got.where("class_code = truth and class_code_probability > 0.99").count() == 40
    assert model.model.stages[0].coefficientMatrix.numRows == 4


def objective(model, df):
    lr = model.model.stages[0]
    n, own = df.count(), F.element_at("p", F.array_position(F.array(*map(F.lit, model.classes)), F.col("class_code")).cast("int"))
    vectors = lr.transform(model._vectors(df, "corpus", ["class_code"])).select("class_code", vector_to_array("probability").alias("p"))
    return vectors.agg(-F.avg(F.log(own))).first()[0] + 0.5 / (fixed.CLASS_C * n) * (lr.coefficientMatrix.toArray() ** 2).sum()


def test_objective_is_near_the_librarys(spark):
    learner = LogisticRegression(family="multinomial", standardization=False, regParam=1.0 / (fixed.CLASS_C * 40), maxIter=1000, tol=1e-4)
    mine, theirs = (objective(m, rows(spark)) for m in (models.fit_class_lr(rows(spark), clean=False), models.fit_class(rows(spark), lambda n: learner, clean=False)))
    assert mine <= theirs + 5e-5, (mine, theirs)


def test_saved_and_read_again(spark, tmp_path):
    model = models.fit_class_lr(rows(spark), clean=False)
    model.save(spark, str(tmp_path / "m"))
    again = models.ClassModel.load(spark, str(tmp_path / "m"))
    one, two = ({r.org_id: (r.class_code, r.class_code_probability) for r in m.predict(rows(spark)).collect()} for m in (model, again))
    assert one == two


def test_one_class_only(spark):
    assert {r.class_code for r in models.fit_class_lr(rows(spark, ("A10",)), clean=False).predict(rows(spark)).collect()} == {"A10"}
