import os

import pytest

pytest.importorskip("corpus_pipeline")
import corpus_pipeline as cp  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in cp.STAGES:
        stage(spark, docs, SF).write.parquet(str(folder / name))
        out.append((name, docs, spark.read.parquet(str(folder / name))))
        docs = out[-1][2]
    return out


def test_order_and_columns(stages):
    assert [s[0] for s in stages] == ["language", "near_duplicates", "repeated_passages", "decontaminate", "packed_sequences"]
    for _, before, after in stages[:-1]:
        assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"] and after.dtypes == before.dtypes


def test_each_stage_by_brute_force(stages):
    from tagspark.llm import decontam, simhash, suffix_dedup

    rows = {name: ([tuple(r) for r in a.collect()], [tuple(r) for r in b.collect()]) for name, a, b in stages}
    before, after = rows["language"]
    assert {r[0] for r in before if any(c.isalpha() for c in r[1] or "")} == {r[0] for r in after}
    before, after = rows["near_duplicates"]
    fps = {r[0]: simhash.fingerprint((r[1] or "").encode()) for r in before}
    root = {f: f for f in fps.values()}
    ordered = sorted(root)
    changed = True
    while changed:
        changed = False
        for a in ordered:
            for b in ordered:
                if root[a] != root[b] and (a ^ b).bit_count() <= 4:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    first = {}
    for i in sorted(fps):
        first.setdefault(root[fps[i]], i)
    assert sorted(r[0] for r in after) == sorted(first.values())
    before, after = rows["repeated_passages"]
    want = {r[0]: w for r, w in zip(before, suffix_dedup.passages_by_brute_force([r[1] for r in before]), strict=True)}
    assert {r[0]: r[1] for r in after} == want
    assert all(r[4] == len(r[1]) for r in after)
    before, after = rows["decontaminate"]
    items = [tuple(r) for r in before and stages[0][1].sparkSession.read.parquet(f"{SF}/benchmark.parquet").collect()]
    marks = decontam.brute_force([r[1] for r in before], items)
    assert sorted(r[0] for r in after) == sorted(r[0] for r, (n, hit, _) in zip(before, marks, strict=True) if not (hit and 20 * hit >= n))
    docs, pieces = rows["packed_sequences"]
    assert {r[0] for r in docs} == {r[0] for r in pieces}
    total = sum(r[3] for r in pieces)
    assert len({r[5] for r in pieces}) <= -(-total // 2048) + 1


def test_query_is_registered(spark):
    import __spark_entry__ as entry

    assert "pipeline" in entry.queries() and sum(k.startswith("op") and k[2].isdigit() for k in entry.queries()) == 13


def test_op9_agrees_with_sql(spark):
    from checks.compare import compare, connection
    from tagspark.llm import catalog

    name = "op9_benchmark_decontamination"
    assert compare(spark, connection(SF), catalog.QUERIES[name], catalog.ORACLE[name], SF) == ""


def test_planted_passages_leave(spark):
    """Passages of 51 to 60 words that stand in two documents go, in whatever language; others stay."""
    import random

    r = random.Random(6)
    word = lambda: "".join(r.choices("abcdefghijklmnoprstuvwxyzéü", k=r.randrange(4, 9)))
    own = lambda n: " ".join(word() for _ in range(n))
    rows, passages = [], []
    for n in range(51, 61):
        passages.append(own(n))
        rows += [(len(rows) + i, f"{own(30)}\n{passages[-1]}\n{own(40)}", "en", "s", 5) for i in range(2)]
    short = own(20)
    rows += [(100 + i, f"{own(20)} {short} {own(20)}", "en", "s", 5) for i in range(2)]
    rows += [(200, None, "en", "s", 0), (201, "", "en", "s", 0), (202, own(30_000), "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = {x.doc_id: x.text for x in cp.repeated_passages(spark, df, SF).collect()}
    assert not any(p[8:-8] in (t or "") for p in passages for t in got.values())
    assert all(got[i] == t for i, t, *_ in rows if i >= 100)
    assert all(len(got[i].split()) >= 65 for i in range(20))


def test_stages_take_nulls_empty_tables_and_clashing_columns(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, lang_pred int, score string, row int, key string, piece int"
    text = "the house stands at the water and people walk there every day " * 12
    rows = [(1, text, "en", None, 3, 1, "s", 1, "k", 7), (2, None, None, "a", None, None, None, None, None, None), (3, "", "en", "", 0, 0, "", 0, "", 0), (3, "", "en", "", 0, 0, "", 0, "", 0), (None, text + "x", "en", "a", 1, 1, "s", 1, "k", 7)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in cp.STAGES:
        for given in (docs, docs.limit(0)):
            out = stage(spark, given, SF)
            n = out.count()
            if name != "packed_sequences":
                assert out.columns == docs.columns and n <= given.count()
            if name == "repeated_passages":
                assert n == given.count()
    assert cp.language(spark, docs, SF).where("text is null or text = ''").count() == 0


def test_run_on_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_kept_folders_can_be_removed(spark):
    from pathlib import Path

    from tagspark.llm import common

    start = len(common.KEPT)
    one, two = (common.keep(spark.range(3), n) for n in ("one", "two"))
    folders = [Path(p.removeprefix("file:")) for p in common.KEPT[start:]]
    assert one.union(two).count() == 6 and all(f.is_dir() for f in folders)
    assert common.drop_kept(spark, start + 1) == 1 and [f.is_dir() for f in folders] == [True, False]
    assert common.drop_kept(spark, start) == 1 and not folders[0].is_dir() and len(common.KEPT) == start


def test_run_leaves_only_what_its_result_reads(spark):
    from tagspark.llm import common

    start = len(common.KEPT)
    n = cp.run(spark, SF).count()
    assert n > 0 and len(common.KEPT) - start < 8
    common.drop_kept(spark, start)
