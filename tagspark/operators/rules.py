"""Tagging by include and exclude patterns.

A list of rules becomes one projection of literal patterns: the text is read once,
every pattern is compiled once per task, and nothing is shuffled. Rules given as a table, and lists
too long for a plan, go through the word index of ``rule_index``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagspark import fixed
from tagspark.functions import patterns
from tagspark.functions.codes import code_set, explode_rows, group_codes, split_codes, with_groups
from tagspark.operators.rule_index import FLAGS, RuleIndex, build_index, folded_ascii, indexed_sets, letter_words

#: Rules of plain words from which on finding a text's words first is worth it.
MANY_RULES = 20
#: Rules that a plan holds as literals; longer lists are indexed.
PLAN_RULES = 300


@dataclass(frozen=True)
class Rule:
    code: str
    include: str | None
    exclude: str | None = None


def _stated(pattern: str | None) -> bool:
    return bool(pattern) and pattern != fixed.EMPTY_RULE


def load_rules(table: DataFrame) -> list[Rule]:
    """Rules of a taxonomy table (``code, include, exclude``) on the driver, one partition at a time.

    They become literals of the plan; a longer list than a plan should hold is better left a table (see ``tag_sets``).
    """
    rows = table.select("code", "include", "exclude").toLocalIterator()
    return [Rule(*row) for row in rows if _stated(row["include"])]


#: What may stand around the alternatives of a rule of plain words.
_EDGES = ((r"\b(", r")\b"), (r"(^|[^\p{L}\p{N}_])(", r")([^\p{L}\p{N}_]|$)"))


def gate_words(pattern: str) -> list[str] | None:
    """For a rule of plain words between word edges: the first word of each alternative, one of which its text
    must hold. None for any other pattern."""
    for left, right in _EDGES:
        body = pattern[len(left) : len(pattern) - len(right)]
        if pattern == left + body + right and body:
            words = [x.split(" ")[0] for x in body.split("|")]
            plain = all(re.fullmatch(r"[^\W\d_]+([ -][^\W\d_]+)*", x) for x in body.split("|"))
            return sorted({w.split("-")[0].upper().replace("İ", "I").lower() for w in words}) if plain else None
    return None


def whole_words(pattern: str) -> list[str] | None:
    """For a rule of single ASCII words between edges of letters, digits and ``_``: the words, one of which its text holds as a whole
    run of such characters if and only if the pattern matches. None for any other pattern."""
    left, right = _EDGES[1]
    body = pattern[len(left) : len(pattern) - len(right)]
    if pattern == left + body + right and re.fullmatch(r"[A-Za-z]+(\|[A-Za-z]+)*", body):
        return sorted({w.lower() for w in body.split("|")})
    return None


def listed_words(corpus: Column, rules: Iterable[Rule]) -> Column:
    """Those of the words of :func:`whole_words` of all rules that the text holds, each once."""
    wanted = sorted({w for r in rules if _stated(r.include) for w in whole_words(r.include) or ()})
    runs = F.regexp_extract_all(corpus, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    # letters fold one by one, as a pattern folds them: a run that grows in capitals (as with a sharp s) is no ASCII word
    alike = F.filter(runs, lambda w: F.char_length(F.upper(w)) == F.char_length(w))
    folded = F.transform(alike, lambda w: F.lower(F.translate(F.upper(w), "İ", "I")))
    return F.array_intersect(folded, F.array(*map(F.lit, wanted)))


def _found(corpus: Column, pattern: str, folded: Column | None) -> Column:
    """Whether the pattern matches; with ``folded``, tried only where a text that a match needs stands."""
    hit = corpus.rlike(FLAGS + pattern)
    wanted = patterns.needed(pattern) if folded is not None else None
    return reduce(or_, [F.contains(folded, F.lit(w)) for w in wanted]) & hit if wanted else hit


def matched_codes(
    corpus: Column, rules: Iterable[Rule], letters: Column | None = None, listed: Column | None = None, folded: Column | None = None,
) -> Column:
    """Sorted codes of all rules that hold for the text.

    With ``letters`` (see :func:`letter_words`, as a column of its own), the pattern of a rule of plain words
    is only tried where one of them stands; with ``listed`` (see :func:`listed_words`, likewise), a rule of whole words needs no
    pattern; with ``folded`` (see :func:`folded_ascii`, likewise), a pattern is only tried where letters or a sign that it needs stand. None changes a result.
    """
    hits = []
    for rule in rules:
        if not _stated(rule.include):
            continue
        hit = _found(corpus, rule.include, folded)
        whole = whole_words(rule.include) if listed is not None else None
        gate = gate_words(rule.include) if letters is not None and whole is None else None
        if whole is not None:
            hit = F.arrays_overlap(listed, F.array(*map(F.lit, whole))) if len(whole) > 1 else F.array_contains(listed, whole[0])
        if gate is not None:
            hit = F.arrays_overlap(letters, F.array(*map(F.lit, gate))) & hit
        if _stated(rule.exclude):
            hit = hit & ~_found(corpus, rule.exclude, folded)
        hits.append(F.when(hit, F.lit(rule.code)))
    return code_set(F.array_compact(F.array(*hits)) if hits else F.lit(None).cast("array<string>"))


def rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    return spark.createDataFrame([(r.code, r.include, r.exclude) for r in rules], "code string, include string, exclude string")


def tag_sets(
    df: DataFrame,
    rules: Sequence[Rule] | DataFrame | RuleIndex,
    corpus: str = "corpus",
    include_groups: bool = False,
    out: str = "codes",
) -> DataFrame:
    """Every record with its set of codes, empty when no rule holds.

    ``rules`` may be a table (code, include, exclude) of any length; the index is then built by actions on ``df``, which should be a
    stored table. An index built before may be given too, and released when its results are written.
    """
    if not isinstance(rules, (DataFrame, RuleIndex)) and len(rules) > PLAN_RULES:
        rules = rule_table(df.sparkSession, rules)
    if isinstance(rules, (DataFrame, RuleIndex)):
        index = rules if isinstance(rules, RuleIndex) else build_index(df, rules, corpus)
        sets = indexed_sets(df, index, corpus, out)
        return sets.withColumn(out, with_groups(F.col(out))) if include_groups else sets
    rules = [r for r in rules if _stated(r.include)]
    listed = sum(whole_words(r.include) is not None for r in rules) >= MANY_RULES
    open_rules = [r for r in rules if not (listed and whole_words(r.include) is not None)]
    gated = sum(gate_words(r.include) is not None for r in open_rules) >= MANY_RULES
    rows = df.withColumn("_letters", letter_words(F.col(corpus))) if gated else df
    rows = rows.withColumn("_listed", listed_words(F.col(corpus), rules)) if listed else rows
    few = not (gated or listed)
    rows = rows.withColumn("_folded", folded_ascii(F.col(corpus))) if few else rows
    codes = matched_codes(
        F.col(corpus), rules, F.col("_letters") if gated else None, F.col("_listed") if listed else None, F.col("_folded") if few else None
    )
    return rows.withColumn(out, with_groups(codes) if include_groups else codes).drop("_letters", "_listed", "_folded")


def tag_by_rules(
    df: DataFrame,
    rules: Sequence[Rule] | DataFrame | RuleIndex,
    corpus: str = "corpus",
    include_groups: bool = False,
    id: str = "org_id",
) -> DataFrame:
    """One row per record and code that holds."""
    sets = tag_sets(df.select(id, corpus), rules, corpus, include_groups)
    return explode_rows(sets, [id], "codes", "code")


def tag_by_rules_eval(
    gold: DataFrame,
    rules: Sequence[Rule] | DataFrame | RuleIndex,
    include_groups: bool = False,
    corpus: str = "corpus",
    truth: str = "tags",
    id: str = "org_id",
) -> DataFrame:
    """Rule codes beside gold codes, in place: no join is needed, because each
    record carries its own text."""
    sets = tag_sets(gold.select(id, truth, corpus), rules, corpus, include_groups)
    return sets.select(
        id,
        code_set(split_codes(F.col(truth))).alias("true_codes"),
        F.col("codes").alias("predicted_codes"),
        F.lit("regex_rules").alias("prediction_source"),
    )


def expand_groups(tags: DataFrame, code: str = "code") -> DataFrame:
    """Rows for a code and for its parents (see ``group_codes``)."""
    rest = [c for c in tags.columns if c != code]
    return tags.select(*rest, F.explode(group_codes(F.col(code))).alias(code))


def related_codes(
    tags: DataFrame, taxonomy: DataFrame, id: str = "org_id", related: str = "related"
) -> DataFrame:
    """Per record, the second-taxonomy codes related to any of its tags."""
    links = taxonomy.select("code", F.explode(split_codes(F.col(related))).alias("candidate"))
    return (
        tags.join(links, "code")
        .groupBy(id)
        .agg(F.array_sort(F.collect_set("candidate")).alias("candidates"))
    )
