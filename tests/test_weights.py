"""Vectors of weighted terms are those of the library, and the vocabulary is no object of the driver's JVM."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.feature import IDF, CountVectorizer

from tagspark.operators import models, weights


def test_weights_are_the_librarys(spark, monkeypatch):
    monkeypatch.setattr(weights, "_TOKENS", 5)
    monkeypatch.setattr(weights, "_WRITTEN", 2)
    texts = ["a a b", "b c d d d", None, "", "zz", "a cé b b", "d a a"]
    rows = spark.createDataFrame([(i, None if t is None else t.split(), (t or "").split()[:2]) for i, t in enumerate(texts)], "i int, _words array<string>, _chars array<string>").repartition(2)
    found = models.feature_union(rows, models.Settings(char_ngram_max=3, min_df=2))
    assert isinstance(found.stages[0].terms, pa.Array)  # the library's held each term as an object of the JVM
    assert found.stages[0].vocabulary == ["a", "b", "d"]
    got = {r.i: r.features for r in found.transform(rows).collect()}
    known = rows.na.drop(subset=["_words"])
    expected = {i: [] for i in got}
    for column in ("_words", "_chars"):
        counter = CountVectorizer(inputCol=column, outputCol="n", minDF=2.0).fit(known)
        order = [counter.vocabulary.index(t) for t in found.stages[0 if column == "_words" else 1].vocabulary]
        plus_one = np.log(8.0 / (np.array(IDF(inputCol="n", outputCol="x").fit(counter.transform(known)).docFreq) + 1.0)) + 1.0
        raw = {r.i: (r.n.toArray() * plus_one)[order] for r in counter.transform(known).collect()}
        for i in expected:
            x = raw.get(i, np.zeros(len(order)))
            expected[i] += list(x / (np.linalg.norm(x) or 1.0))
    assert all(np.abs(got[i].toArray() - expected[i]).max() < 1e-12 for i in got) and len(got) == 7


def test_stored_and_read_again(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(weights, "_WRITTEN", 2)
    rows = spark.createDataFrame([(["x", "y", "x"],), (["z", "y"],)], "_words array<string>")
    found = models.feature_union(rows, models.Settings(min_df=1))
    found.save(spark, str(tmp_path / "f"))
    again = models._load_features(spark, str(tmp_path / "f"))
    assert again.stages[0].vocabulary == found.stages[0].vocabulary and (again.stages[0].weights == found.stages[0].weights).all()
    assert models.word_places(again, ["z", "none"], spark) == {"z": found.stages[0].vocabulary.index("z")}
    with pytest.raises(ValueError):
        models.feature_union(rows, models.Settings(min_df=5))
