"""Token operators that need a second table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagspark import fixed

from tagspark.functions.codes import no_codes
from tagspark.functions.text import clean_text, clean_words
from tagspark.operators.joins import PART, answers_to_parts, in_parts
from tagspark.session import keep_table

#: Characters beyond which a word is no word; it is shortened by one ending only.
LONGEST_WORD = 100


def lemma_lookup(
    df: DataFrame, tokens_col: str, lexicon: DataFrame, id: str = "org_id", out: str = "lemmas"
) -> DataFrame:
    """Tokens replaced by their base form ``(surface, lemma)``, order kept.

    Lists of tokens travel once, to lie by record. Each part asks the lexicon, which may have any size, once for each of its words; what it
    knows is answered to the part, and tokens meet the answers where they lie. A surface listed several times takes its smallest lemma.
    """
    entries = lexicon.groupBy(F.col("surface").alias("_token")).agg(F.min("lemma").alias("_lemma"))
    lists = in_parts(df.select(id, tokens_col), id)
    asked = lists.select(PART, F.explode(tokens_col).alias("_token")).distinct()
    answers = answers_to_parts(asked.join(entries, "_token"))
    rows = lists.select(PART, id, F.posexplode_outer(tokens_col).alias("_pos", "_token")).join(answers, [PART, "_token"], "left")
    lemma = F.coalesce("_lemma", "_token")
    lists = rows.groupBy(PART, id).agg(F.array_sort(F.collect_list(F.struct("_pos", lemma.alias("_lemma")))).alias("_l"))
    words = F.transform("_l", lambda x: x["_lemma"])
    return lists.select(id, F.array_compact(words).alias(out))


def _shortened(form: Column, endings: Sequence[tuple[str, str]]) -> Column:
    """The forms that one ending rule makes of a word."""
    made = [F.when(F.endswith(form, F.lit(old)), F.concat(F.substring(form, F.lit(1), F.char_length(form) - len(old)), F.lit(new))) for old, new in endings]
    return F.array_compact(F.array(*made))


def ending_forms(word: Column, endings: Sequence[tuple[str, str]] = tuple(fixed.NOUN_ENDINGS)) -> Column:
    """All forms that ending rules make of a word, with the number of rules used: array of (level, form), the word itself first."""
    def grow(acc: Column, level: Column) -> Column:
        new = F.array_distinct(F.flatten(F.transform(acc["last"], lambda f: _shortened(f, endings))))
        rows = F.transform(new, lambda f: F.struct(level.alias("level"), f.alias("form")))
        return F.struct(F.concat(acc["all"], rows).alias("all"), new.alias("last"))

    start = F.struct(F.array(F.struct(F.lit(0).alias("level"), word.alias("form"))).alias("all"), F.array(word).alias("last"))
    # every rule but one shortens a word, and that one cannot follow itself
    steps = F.when(F.char_length(word) > LONGEST_WORD, F.lit(1)).otherwise(F.char_length(word) + 1)
    return F.aggregate(F.sequence(F.lit(1), steps), start, grow, lambda acc: acc["all"])


def base_forms(
    words: DataFrame, lexicon: DataFrame, exceptions: DataFrame | None = None,
    endings: Sequence[tuple[str, str]] = tuple(fixed.NOUN_ENDINGS),
) -> DataFrame:
    """``(surface, lemma)`` for every distinct ``surface`` of ``words``, known to a lexicon or not.

    A word listed in ``exceptions`` (surface, lemma) takes the shortest of itself and the lemmas listed for it that the lexicon
    (word) has. Any other word takes the shortest of itself and the forms of one ending rule that the lexicon has; if it has none, the forms of two
    rules are asked for, and so on. Of equally long forms the first in alphabet is taken; a word without any known form stays as it
    is; of a word beyond ``LONGEST_WORD`` characters only the forms of one rule are asked for. The vocabulary meets the lexicon in one join.
    """
    own = words.select("surface").where("surface is not null").distinct()
    known = lexicon.select(F.col("word").alias("form")).distinct()
    forms = own.select("surface", F.explode(ending_forms(F.col("surface"), endings)).alias("_f")).select("surface", F.greatest("_f.level", F.lit(1)).alias("level"), "_f.form")
    if exceptions is not None:
        listed = exceptions.select("surface", F.col("lemma").alias("form")).where("surface is not null and form is not null")
        both = listed.unionByName(listed.select("surface", F.col("surface").alias("form"))).distinct().join(own, "surface", "left_semi")
        forms = forms.join(listed, "surface", "left_anti").unionByName(both.withColumn("level", F.lit(1)))
    # forms of a word are few, whatever the word
    best = F.row_number().over(Window.partitionBy("surface").orderBy("level", F.char_length("form"), "form"))
    found = forms.join(known, "form", "left_semi").withColumn("_n", best).where("_n = 1").select("surface", F.col("form").alias("lemma"))
    return own.join(found, "surface", "left").withColumn("lemma", F.coalesce("lemma", "surface"))


def lemmatise(
    df: DataFrame, tokens_col: str, lexicon: DataFrame, exceptions: DataFrame | None = None, id: str = "org_id", out: str = "lemmas",
    endings: Sequence[tuple[str, str]] = tuple(fixed.NOUN_ENDINGS),
) -> DataFrame:
    """Tokens replaced by their base forms, order kept. The forms are worked out once for each distinct token."""
    vocabulary = df.select(F.explode(tokens_col).alias("surface")).distinct()
    forms = keep_table(base_forms(vocabulary, lexicon, exceptions, endings).where("lemma <> surface"), "base-forms")
    return lemma_lookup(df, tokens_col, forms, id, out)


def cleaned(
    df: DataFrame, corpus: str, lexicon: DataFrame | None = None, id: str = "org_id", out: str = "_text"
) -> DataFrame:
    """``df`` with the cleaned text, its words in base form if there is a lexicon."""
    if lexicon is None:
        return df.withColumn(out, clean_text(F.col(corpus)))
    words = df.select(id, clean_words(F.col(corpus)).alias("_words"))
    lemmas = lemma_lookup(words, "_words", lexicon, id, "_lemmas")
    joined = df.join(lemmas, id, "left")
    return joined.withColumn(out, F.array_join(F.coalesce("_lemmas", no_codes()), " ")).drop("_lemmas")
