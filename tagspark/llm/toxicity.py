"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding lower-cases, maps look-alike letters and digits to one letter and turns everything else into
spaces. The lexicon holds words and word beginnings that labelled toxic texts have far more often; phrases
in which a term is harmless are exceptions and cancel its match. Hits, weighted and normalised by
length, become a score through a logistic curve.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagspark.llm.common import bounded_sample, crc_bucket, in_batches, keep, logistic, probability, slices, table, text_list

#: Bound of the labelled rows used, for each label. The lexicon and the exceptions have none but what these rows hold.
PER_LABEL = 3000
SHORTEST, LONGEST = 4, 8
#: Logarithm of how much likelier a term must be in toxic texts before phrases excuse it.
LEANS = 0.2
THRESHOLD = 0.3
#: Look-alikes of Latin letters. i, l and 1 look alike and fold to i.
LOOKALIKES = {
    "a": "аα@4ａ", "b": "ьβ8", "c": "сϲ", "d": "ԁ", "e": "еεё3€", "g": "ɡ9", "h": "һ", "i": "іιїlӏ1|", "j": "ј", "k": "кκ",
    "m": "м", "n": "п", "o": "оοσ0", "p": "рρ", "r": "г", "s": "ѕ$5", "t": "тτ7", "u": "υս", "v": "ѵν", "w": "ԝω", "x": "хχ", "y": "уγ", "z": "2",
}


class Fold(dict):
    """A table for ``str.translate``, filled as characters are met."""

    def __init__(self):
        super().__init__({ord(x): k for k, v in LOOKALIKES.items() for x in v})
        self.update({c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)})

    def __missing__(self, point: int):
        self[point] = out = point if unicodedata.category(chr(point))[0] in "LM" else " "
        return out


FOLD = Fold()
#: Full-width and styled letters, which compatibility folding makes plain.
WIDE = re.compile("[\uff01-\uff5e\U0001d400-\U0001d7ff]")


def fold(text: str) -> str:
    text = text.lower()
    if not text.isascii() and WIDE.search(text):
        text = unicodedata.normalize("NFKC", text).lower()
    return f" {text.translate(FOLD)} "


def beginnings(word: str) -> list[str]:
    """The word itself, closed by a space, and its beginnings."""
    return [f" {word} ", *(f" {word[:n]}" for n in range(SHORTEST, min(LONGEST, len(word)) + 1))]


def _counted(sample: DataFrame, terms) -> DataFrame:
    """(term, toxic documents, other documents) over the sample."""

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text, label in zip(text_list(batch.column("text")), batch.column("label").to_pylist(), strict=True):
                seen.update((t, label) for t in terms(text))
        rows = list(seen.items())
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.int32()), pa.array([n for _, n in rows], pa.int64())], ["t", "label", "n"])

    got = in_batches(sample, count, "t string, label int, n long").groupBy("t").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("good"))
    return got


class Matcher:
    """Finds lexicon terms and drops the matches that an exception phrase covers."""

    def __init__(self, lexicon: dict[str, float], exceptions: list[str]):
        self.auto = ahocorasick.Automaton()
        for term, weight in lexicon.items():
            self.auto.add_word(term, (len(term), weight))
        for phrase in exceptions:
            self.auto.add_word(phrase, (len(phrase), None))
        if lexicon:
            self.auto.make_automaton()
        self.any = bool(lexicon)

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        found, shields = [], []
        if self.any:
            for end, (n, weight) in self.auto.iter(folded):
                (shields if weight is None else found).append((end - n + 1, end + 1, weight))
        if shields:
            # a match is covered if a phrase that begins no later ends no earlier
            shields.sort()
            starts, reach = [a for a, *_ in shields], list(accumulate((b for _, b, _ in shields), max))
            found = [h for h in found if not ((k := bisect_right(starts, h[0])) and reach[k - 1] >= h[1])]
        return found

    def terms(self, folded: str) -> set[str]:
        return {folded[a:b] for a, b, _ in self.hits(folded)}

    def features(self, texts: list[str]) -> tuple[np.ndarray, list[int]]:
        """Features of each text, and its number of matches."""
        out, counts = np.zeros((len(texts), 3)), []
        for i, text in enumerate(texts):
            hits = self.hits(fold(text))
            counts.append(len(hits))
            if hits:
                total = sum(w for *_, w in hits)
                out[i] = 1.0, np.log1p(total), np.log1p(100 * total / (len(text) / 6 + 10))
        return out, counts


def phrases(matcher: Matcher, text: str) -> set[str]:
    """The phrases of two words around each match."""
    folded = fold(text)
    words = [(m.start(), m.group()) for m in re.finditer(r"[^ ]+", folded)]
    starts, out = [at for at, _ in words], set()
    for start, *_ in matcher.hits(folded):
        k = bisect_right(starts, start + 1) - 1  # a match begins at the space before its word
        word = words[k][1]
        if k:
            out.add(f" {words[k - 1][1]} {word} ")
        if k + 1 < len(words):
            out.add(f" {word} {words[k + 1][1]} ")
    return out


def fit(docs: DataFrame, labels: DataFrame) -> dict | None:
    """Lexicon, exceptions and curve from ``docs`` (doc_id, text) and ``labels`` (doc_id, label); None without two labels.

    At most about ``PER_LABEL`` rows a label are used, chosen by a hash of the id before any text is read;
    only these few ids are sent to the scan of the texts. A term needs a hundredth of the toxic texts and
    at least four; its weight is the logarithm of how much likelier it is there.
    """
    labels = labels.where("label is not null").select("doc_id", F.col("label").cast("int").alias("label"))
    counts = {r[0]: r[1] for r in labels.groupBy("label").count().collect()}
    if not counts.get(0) or not counts.get(1):
        return None
    chosen = F.broadcast(bounded_sample(labels, "label", PER_LABEL, "toxicity"))
    sample = keep(docs.select("doc_id", "text").join(chosen, "doc_id").where("text is not null").select("text", "label"), "toxicity-sample")
    n = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    often = F.col("bad") >= max(4, 0.01 * bad)
    terms = _counted(sample, lambda text: {t for w in set(fold(text).split()) for t in beginnings(w)})
    # first every term that leans to toxic texts, then the phrases that excuse it, then what is left of the term
    loose = {r.t: 1.0 for r in terms.where(often & (odds >= LEANS)).collect()}
    plain = Matcher(loose, [])
    spared = _counted(sample, lambda text: phrases(plain, text)).where("good >= 3 and bad = 0").collect()
    exceptions = sorted(r.t for r in spared)
    excused = Matcher(loose, exceptions)
    chosen = _counted(sample, lambda text: excused.terms(fold(text))).where(often & (odds >= 2.5)).withColumn("w", odds).collect()
    lexicon: dict[str, float] = {}
    found: dict[str, int] = {r.t: r.bad for r in chosen}
    for r in sorted(chosen, key=lambda r: (len(r.t.rstrip()), r.t)):
        shorter = [r.t[:k] for k in range(SHORTEST + 1, len(r.t))]
        # a term stands for its longer forms, unless they are no rarer than it
        if not any(x in lexicon for x in shorter) and not any(found.get(x, 0) > 1.02 * r.bad for x in shorter):
            lexicon[r.t] = float(r.w)
    exceptions = [x for x in exceptions if any(t in x for t in lexicon)]
    sent = sample.sparkSession.sparkContext.broadcast((lexicon, exceptions))

    def features(batches):
        m = Matcher(*sent.value)
        for batch in batches:
            x, _ = m.features(text_list(batch.column("text")))
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), pa.array(x[:, 2]), batch.column("label").cast(pa.float64())], ["a", "b", "c", "y"])

    got = np.array(in_batches(sample, features, "a double, b double, c double, y double").collect(), float).reshape(-1, 4)
    w = logistic(got[:, :3], got[:, 3])
    w[-1] += np.log(counts[1] / counts[0]) - np.log(max(bad, 1) / max(good, 1))
    return {"lexicon": lexicon, "exceptions": exceptions, "w": w}


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """All columns of ``docs`` with ``score`` and ``n_hits``, reading ``text`` alone; null counts as empty.

    Without a model every score is 0. Columns of ``docs`` named like the results are replaced.
    """
    kept = [c for c in docs.columns if c not in ("score", "n_hits")]
    if model is None:
        return docs.select(*kept, F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_hits"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(*kept)
    schema = src.withColumns({"score": F.lit(0.0), "n_hits": F.lit(0).cast("long")}).schema

    def run(batches):
        m = sent.value
        matcher = Matcher(m["lexicon"], m["exceptions"])
        for batch in batches:
            for part in slices(batch, "text"):
                x, n = matcher.features(text_list(part.column("text")))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(probability(x, m["w"])), pa.array(n, pa.int64())], schema.names)

    return in_batches(src, run, schema)


def op7_toxicity(spark, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    labels = table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label"))
    bucket = crc_bucket(F.col("doc_id"), 4)
    model = fit(docs, labels.where(bucket != 2))
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(bucket == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_hits")
