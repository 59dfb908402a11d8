import random

import pytest

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from tagspark.llm import pretok  # noqa: E402

PIECES = [
    "the", "Thing", "'s", "'re", "''", "'", " ", "  ", "\n", " \n ", "\t", "!'s", "'st", "'llx", "don't", "WE'LL", "É", "ß", "ñandú",
    "123", "4", "½", "٣", "日本", "かな", "é", "İ", "ΣΑΣ", "🙂", " ", " ", "​", "\x1c", "\x00", "...", "a_b", "#", "<|endoftext|>",
    "<|startoftext|>", "<|end", "x" * 40, "\r\n", "’s", "�", "ﬁ",
]


def texts(n=400, seed=3):
    r = random.Random(seed)
    return ["", " ", "\n\n", "'s", "' s", " 's", "it's", "\n's"] + ["".join(r.choices(PIECES, k=r.randrange(1, 14))) for _ in range(n)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_the_library_s(name, monkeypatch):
    path = P.path(name)
    tok, enc = Tokenizer.from_file(path), pretok.Encoder(path)
    given = texts()
    want = [tok.encode(t, add_special_tokens=False).ids for t in given]
    for t, w, g in zip(given, want, enc.encode(given), strict=True):
        assert g.tolist() == w, repr(t)
    assert enc.counts(given).tolist() == [len(w) for w in want]
    # small chunks and a small memory change nothing
    monkeypatch.setattr(pretok, "CHUNK", 64)
    monkeypatch.setattr(pretok, "KNOWN", 50)
    long = ["the quick brown fox " * 30, "x" * 300, "a b" * 100, *given]
    pretok.powers.cache_clear()
    small = pretok.Encoder(path)
    assert [g.tolist() for g in small.encode(long)] == [tok.encode(t, add_special_tokens=False).ids for t in long]
    pretok.powers.cache_clear()


def test_proven_strings_are_single_tokens():
    path = P.path("word_bpe_49k.json")
    tok, proven = Tokenizer.from_file(path), pretok.whole_tokens(path)
    assert len(proven) > 20_000
    for word in list(proven)[::397]:
        assert pretok.Encoder(path).merge(word) == [proven[word]]
    assert "the" in proven and tok.encode("the", add_special_tokens=False).ids == [proven["the"]]


DOCS = "doc_id long, text string, length long, ids string"


def rows():
    return [(i, t, 1, "x") for i, t in enumerate(texts(60, 5))] + [(900, None, None, None), (901, "word " * 5000, 0, ""), (901, "word " * 5000, 0, "")]


def test_counts_and_empty_tables(spark, frame):
    from tagspark.llm.token_count import count_tokens

    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    got = sorted(tuple(r) for r in count_tokens(frame(rows(), DOCS), path).select("doc_id", "n_bytes", "n_tokens").collect())
    assert got == sorted((i, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows())
    assert count_tokens(frame([], DOCS), path).count() == 0


def test_files_round_trip(spark, frame, tmp_path):
    import zlib

    import numpy as np

    from tagspark.llm import token_files as tf

    path = P.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    given = [(i, t) for i, t, *_ in rows()] + [(None, "no id")]
    tf.write_ids(frame(given, "doc_id long, text string"), path, str(tmp_path / "a"), block=200, parts=4)
    got = sorted(tuple(r) for r in tf.read_ids(spark, str(tmp_path / "a")).selectExpr("coalesce(doc_id, -1)", "start", "n_tokens", "crc32(ids)").collect())
    want, at = [], 0
    for i, t in sorted(given, key=lambda x: (-1 if x[0] is None else x[0])):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((-1 if i is None else i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == sorted(want)
    assert tf.one_document(spark, str(tmp_path / "a"), 901) == [*tok.encode("word " * 5000, add_special_tokens=False).ids, 2]
    assert tf.one_document(spark, str(tmp_path / "a"), 12345) is None
    tf.write_ids(frame([], "doc_id long, text string"), path, str(tmp_path / "b"))
    assert tf.read_ids(spark, str(tmp_path / "b")).count() == 0


def test_dictionary_is_used(spark, frame, tmp_path):
    from tagspark.llm import token_files as tf

    given = [(i, f"the {w} house of number {i} stands by the river, " * 12) for i, w in enumerate(["old", "new", "red"] * 80)]
    path = P.path("byte_bpe_50k.json")
    tf.write_ids(frame(given, "doc_id long, text string"), path, str(tmp_path / "c"))
    assert len(spark.read.parquet(str(tmp_path / "c/dictionary")).first()["dictionary"]) > 100
    back = {r.doc_id: r.n_tokens for r in tf.read_ids(spark, str(tmp_path / "c")).collect()}
    assert back == {i: len(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids) + 1 for i, t in given}


def test_packing_is_gapless_and_tight(spark, frame):
    from tagspark.llm import packing

    path = P.path("word_bpe_49k.json")
    docs = frame(rows() * 3, DOCS)
    pieces = packing.cut(docs, path, capacity=64)
    got = packing.pack(pieces, 64).collect()
    assert len(got) == pieces.count() and {"ids", "sequence_id"} <= set(got[0].asDict())
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for content in bins.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= -(-sum(r.length for r in got) // 64) + 1
    whole = {}
    for r in sorted(got, key=lambda r: r.piece):
        assert r.start == 64 * r.piece
        whole.setdefault(r.doc_id, []).append(len(r.ids) // 4)
    assert packing.pack(packing.cut(frame([], DOCS), path), 64).count() == 0


def test_fullest_is_the_best_of_all_combinations():
    import itertools
    from collections import Counter

    from tagspark.llm.packing import fullest, patterns

    r = random.Random(4)
    for _ in range(60):
        left, room = Counter(r.choices(range(1, 14), k=7)), r.randrange(1, 40)
        items = list(left.elements())
        best = max(s for k in range(len(items) + 1) for c in itertools.combinations(items, k) if (s := sum(c)) <= room)
        use = fullest(dict(left), room)
        assert sum(k * n for k, n in use.items()) == best and all(n <= left[k] for k, n in use.items())
    counts = {k: r.randrange(1, 500) for k in range(1, 300)}
    used = Counter()
    for times, use in patterns(counts, 300):
        assert sum(k * n for k, n in use.items()) <= 300
        for k, n in use.items():
            used[k] += times * n
    assert used == Counter(counts)
