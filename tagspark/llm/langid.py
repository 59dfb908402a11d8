"""Language identification of mixed texts: script ranges, per-word scores, Viterbi with a switching penalty.

A word's script narrows the languages it may belong to; character n-grams of the padded word give
each candidate a log-likelihood. Viterbi over the words pays a penalty for each switch and so labels
spans; a document's language is the one whose spans hold most letters.
"""

from __future__ import annotations

import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagspark.llm.common import aside, bounded_sample, crc_bucket, in_batches, slices, table, text_list

#: Bound of the labelled rows that a model is fitted on, for each language.
PER_LANGUAGE = 1000
#: Most frequent n-grams kept for each language; the others count as not seen.
GRAMS = 100_000
PENALTY = 6.0
CACHE = 300_000
#: Tokens scored together, and characters labelled together; they bound what a worker holds.
LEARNED, LABELLED = 8_192, 2 << 20
WORD = regex.compile(r"[\p{L}\p{M}]+")
SPECIES = ("LATIN", "GREEK", "CYRILLIC", "ARABIC", "HEBREW", "DEVANAGARI", "THAI", "HANGUL", "HIRAGANA", "KATAKANA", "CJK")


def script(char: str) -> str:
    """The script range of a letter, by its Unicode name; kana and Han count as one."""
    name = unicodedata.name(char, "").split(" ")[0]
    name = name if name in SPECIES else "OTHER"
    return "CJK" if name in ("HIRAGANA", "KATAKANA") else name


def grams(word: str) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for n in (2, 3) for i in range(len(padded) - n + 1)]


def fit(labelled: DataFrame) -> dict:
    """A model from rows (doc_id, text, lang): languages, their scripts, n-gram log-likelihoods.

    At most about ``PER_LANGUAGE`` rows of each language are used (documented bound); their counts are
    summed in Spark and the ``GRAMS`` most frequent n-grams of each language reach the driver, with all scripts.
    Without labelled rows the model has no language, and all texts are ``und``.
    """
    rows = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    sample = bounded_sample(rows, "lang", PER_LANGUAGE, "langid")

    def count(batches):
        seen: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for text, lang in zip(text_list(batch.column("text")), batch.column("lang").to_pylist(), strict=True):
                for word, n in Counter(WORD.findall(text.lower())).items():
                    for g in grams(word):
                        seen[lang][g] += n
                    seen[lang]["\0" + script(word[0])] += n
        out = [(lang, g, n) for lang, c in seen.items() for g, n in c.items()]
        yield pa.RecordBatch.from_pydict({"lang": pa.array([x[0] for x in out], pa.string()), "g": pa.array([x[1] for x in out], pa.string()), "n": pa.array([x[2] for x in out], pa.int64())})

    counted = in_batches(sample, count, "lang string, g string, n long").groupBy("lang", "g").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang", F.col("g").startswith("\0")).orderBy(F.desc("n"), "g"))
    got = counted.withColumn("place", place).where(F.col("place") <= GRAMS).orderBy("lang", "g").collect()
    langs = sorted({r.lang for r in got})
    at = {lang: i for i, lang in enumerate(langs)}
    table_, scripts, total = {}, defaultdict(lambda: np.zeros(len(langs))), np.zeros((4, len(langs)))
    for r in got:
        if r.g[0] == "\0":
            scripts[r.g[1:]][at[r.lang]] += r.n
        else:
            table_.setdefault(r.g, np.zeros(len(langs)))[at[r.lang]] += r.n
            total[len(r.g)][at[r.lang]] += r.n
    words = sum(scripts.values()) if scripts else np.zeros(len(langs))
    sizes = np.bincount([len(g) for g in table_], minlength=4)
    bottom = total + 0.5 * sizes[:, None] + 1
    # rows 0 and 1 serve n-grams of two and three letters that were not seen
    logs = np.log(np.vstack([0.5 / bottom[2:4], *((c + 0.5) / bottom[len(g)] for g, c in table_.items())]))
    # a language is a candidate for a script that a hundredth of its words is in
    candidates = {s: c >= 0.01 * np.maximum(words, 1) for s, c in scripts.items()}
    return {"langs": langs, "place": {g: i for i, g in enumerate(table_, 2)}, "logs": logs, "candidates": {s: c for s, c in candidates.items() if c.any()}}


class Scores:
    """Scores and letters of tokens, worked out once and kept for up to ``CACHE`` tokens.

    A token is what stands between white space; its letters, lower-cased, are the word that is scored.
    A token without letters has no say.
    """

    def __init__(self, model: dict):
        self.model, self.n = model, len(model["langs"])
        self.empty()

    def empty(self) -> None:
        self.at: dict[str, int] = {}
        self.rows, self.letters = np.zeros((0, self.n), np.float32), np.zeros(0, np.int64)

    def learn(self, tokens: list[str]) -> None:
        place, parts, sizes, letters, barred = self.model["place"].get, [], [], [], []
        for k, token in enumerate(tokens):
            word = "".join(WORD.findall(token.lower())) if not (token.isascii() and token.isalpha()) else token.lower()
            letters.append(len(word))
            if not word:
                parts.append(0)
                sizes.append(1)
                continue
            p = f" {word} "
            n = len(p)
            parts += [place(p[i : i + 2], 0) for i in range(n - 1)]
            parts += [place(p[i : i + 3], 1) for i in range(n - 2)]
            sizes.append(2 * n - 3)
            if not word[0].isascii():
                allowed = self.model["candidates"].get(script(word[0]))
                if allowed is not None:
                    barred.append((k, ~allowed))
        sizes = np.array(sizes)
        rows = np.add.reduceat(self.model["logs"][parts], np.cumsum(sizes) - sizes, axis=0)
        # n-grams of a word overlap, and one very long word must not outweigh all others
        rows *= (0.5 * np.minimum(1, 60 / sizes))[:, None]
        rows -= rows.max(1, keepdims=True)
        rows[np.array(letters) == 0] = 0
        for k, out in barred:
            rows[k, out] = -30
        self.at.update(zip(tokens, range(len(self.at), len(self.at) + len(tokens)), strict=True))
        self.rows = np.concatenate([self.rows, np.maximum(rows, -30).astype(np.float32)])
        self.letters = np.concatenate([self.letters, np.array(letters, np.int64)])

    def places(self, tokens: list[str]) -> np.ndarray:
        new = set(tokens).difference(self.at)
        if new:
            if len(self.at) + len(new) > CACHE:
                self.empty()
                new = set(tokens)
            new = sorted(new)
            for i in range(0, len(new), LEARNED):
                self.learn(new[i : i + LEARNED])
        return np.fromiter(map(self.at.__getitem__, tokens), np.int64, len(tokens))


def viterbi(scores: np.ndarray, starts: np.ndarray, lens: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each word; documents are walked in step, longest first."""
    labels = np.zeros(len(scores), np.int32)
    order = np.argsort(-lens, kind="stable")
    starts, lens = starts[order], lens[order]
    if not len(lens) or lens[0] == 0:
        return labels
    active = np.searchsorted(-lens, -np.arange(lens[0]), side="left")  # documents longer than t
    stay = np.ones(scores.shape, bool)
    best = np.zeros(len(scores), np.int32)  # best label of the word before
    state = scores[starts[: active[0]]].astype(np.float64)
    for t in range(1, lens[0]):
        a = active[t]
        state_t, at = state[:a], starts[:a] + t
        top = state_t.argmax(1)
        switch = (state_t[np.arange(a), top] - penalty)[:, None]
        keep_ = state_t >= switch
        stay[at], best[at] = keep_, top
        state[:a] = np.where(keep_, state_t, switch) + scores[at]
    now = state.argmax(1)
    for t in range(lens[0] - 1, -1, -1):
        a = active[t]
        at = starts[:a] + t
        labels[at] = now[:a]
        if t:
            now[:a] = np.where(stay[at, now[:a]], now[:a], best[at])
    return labels


def predict(docs: DataFrame, model: dict, penalty: float = PENALTY) -> DataFrame:
    """All columns of ``docs`` with ``lang_pred``, ``score`` (share of letters in its spans) and ``n_spans``.

    Reads ``text`` alone. Null texts, texts without a letter, and all texts of a model without languages
    are ``und`` with score 0; ties go to the first language by name. Columns of ``docs`` with the names of the
    results are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "n_spans")]
    src = docs.select(*kept)
    schema = src.withColumns({"lang_pred": F.lit("").cast("string"), "score": F.lit(0.0), "n_spans": F.lit(0).cast("long")}).schema

    def label(batches):
        m = sent.value
        cache, n_langs = Scores(m), len(m["langs"])

        def group(texts: list[str]):
            tokens = [text.split() for text in texts] if n_langs else [[] for _ in texts]
            lens = np.array([len(w) for w in tokens], np.int64)
            ends = np.cumsum(lens)
            at = cache.places([w for words in tokens for w in words])
            letters = cache.letters[at]
            labels = viterbi(cache.rows[at], ends - lens, lens, penalty)
            mass = np.zeros((len(texts), max(1, n_langs)))
            np.add.at(mass, (np.repeat(np.arange(len(texts)), lens), labels), letters)
            total, top = mass.sum(1), mass.argmax(1)
            turns = np.zeros(len(labels) + 1, np.int64)
            np.cumsum(np.r_[0, np.diff(labels) != 0][: len(labels)], out=turns[1:])
            names = [m["langs"][k] if n else "und" for k, n in zip(top.tolist(), total.tolist(), strict=True)]
            n_spans = [int(turns[e] - turns[e - n + 1]) + 1 if n else 0 for e, n in zip(ends.tolist(), lens.tolist(), strict=True)]
            return names, (mass.max(1) / np.maximum(total, 1)).tolist(), n_spans

        for batch in batches:
            for part in slices(batch, "text"):
                texts = text_list(part.column("text"))
                order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
                found: list = [None] * len(texts)
                held: list[int] = []
                size = 0
                for place, i in enumerate(order):
                    held.append(i)
                    size += len(texts[i])
                    if size >= LABELLED or place == len(order) - 1:
                        for j, *x in zip(held, *group([texts[j] for j in held]), strict=True):
                            found[j] = x
                        held, size = [], 0
                arrays = [part.column(c) for c in kept] + [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return in_batches(src, label, schema)


def op10_language_id(spark, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(crc_bucket(F.col("doc_id"), 4) != 2))
    out = predict(docs.select("doc_id", "text"), model)
    held = F.coalesce(crc_bucket(F.col("doc_id"), 4) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "n_spans")


def keep_known(docs: DataFrame) -> DataFrame:
    """Pipeline stage: documents of no language go; the others carry the language found in ``lang``."""
    model = fit(docs.where(crc_bucket(F.col("doc_id"), 4) != 2))
    own, back = aside(docs, "lang_pred", "score", "n_spans")
    return predict(own, model).where("lang_pred <> 'und'").withColumn("lang", F.col("lang_pred")).select(*back)
