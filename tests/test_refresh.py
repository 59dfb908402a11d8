"""Refreshed tags equal a full run, whatever changed, and only changed records are tagged."""

import pytest
from pyspark.sql import functions as F

from tagspark.operators import rules
from tagspark.plans.refresh import TagStore, record_digests, snapshot_diff

RULES = [rules.Rule("A1", r"\bcat\b"), rules.Rule("B2", r"\bdog\b")]
SCHEMA = "org_id string, corpus string, income double"
FIRST = [(f"o{i}", ["cat", "dog", "cat dog", "none", None][i % 5], float(i)) for i in range(60)] + [("two", "cat", 1.0), ("two", "dog", 2.0), (None, "cat", None)]


def full(df):
    return sorted(map(str, rules.tag_by_rules(df, RULES).collect()))


def test_only_changes_are_tagged(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA).repartition(3)
    store, seen = TagStore(spark, str(tmp_path / "store"), buckets=8), []

    def tagger(df):
        seen.append(df.count())
        return rules.tag_by_rules(df, RULES)

    first = frame(FIRST)
    assert store.tags().count() == 0
    assert store.refresh(first, tagger) == {"added": 62, "changed": 0, "removed": 0, "tagged": 62, "buckets": 8}
    assert sorted(map(str, store.tags().collect())) == full(first)
    assert store.refresh(first.repartition(7), tagger) == {"added": 0, "changed": 0, "removed": 0, "tagged": 0, "buckets": 0} and len(seen) == 1
    rows = [r for r in FIRST if r[0] not in ("o1", "o2")]
    rows = [(a, "dog", c) if a == "o3" else (a, b, 99.0) if a == "o4" else (a, b, c) for a, b, c in rows] + [("new", "cat", 0.0)]
    rows.remove(("two", "dog", 2.0))
    second = frame(rows)
    got = store.refresh(second, tagger)
    assert (got["added"], got["changed"], got["removed"], seen[-1]) == (1, 3, 2, 4) and got["buckets"] < 8
    assert sorted(map(str, store.tags().collect())) == full(second)
    # other rules: all anew
    assert store.refresh(second, tagger, "v2")["tagged"] == len({r[0] for r in rows})
    assert store.versions() == [1, 2, 3] and store.vacuum() > 0 and store.versions() == [3]
    assert sorted(map(str, store.tags().collect())) == full(second)
    assert store.refresh(second.limit(0), tagger, "v2")["removed"] == len({r[0] for r in rows}) and store.tags().count() == 0


def test_a_refresh_that_dies_changes_nothing(spark, tmp_path):
    store, first = TagStore(spark, str(tmp_path / "store"), buckets=4), spark.createDataFrame(FIRST, SCHEMA)
    store.refresh(first, lambda df: rules.tag_by_rules(df, RULES))
    before = sorted(map(str, store.tags().collect()))
    more = first.unionByName(spark.createDataFrame([("late", "dog", 1.0)], SCHEMA))

    class Lost(Exception):
        pass

    def dies(df):
        raise Lost

    with pytest.raises(Lost):
        store.refresh(more, dies)
    # files of a version that was not committed are no part of the store
    spark.createDataFrame([("x", "Z9")], "org_id string, code string").withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{store.path}/tags/v=2")
    assert sorted(map(str, store.tags().collect())) == before and store.versions() == [1]
    assert store.refresh(more, lambda df: rules.tag_by_rules(df, RULES))["added"] == 1
    assert sorted(map(str, store.tags().collect())) == full(more)


def test_digests_and_differences(spark):
    a = spark.createDataFrame([("x", "1", 1.0), ("x", "2", 2.0), ("y", None, None), (None, "n", 0.0)], SCHEMA)
    same = spark.createDataFrame([(None, "n", 0.0), ("y", None, None), ("x", "2", 2.0), ("x", "1", 1.0)], SCHEMA)
    assert snapshot_diff(record_digests(a), record_digests(same)).count() == 0
    other = spark.createDataFrame([("x", "1", 2.0), ("x", "2", 1.0), ("y", "", None), ("z", "n", 0.0)], SCHEMA)
    got = {r.org_id: r.change for r in snapshot_diff(record_digests(a), record_digests(other)).collect()}
    assert got == {"x": "changed", "y": "changed", "z": "added", None: "removed"}
