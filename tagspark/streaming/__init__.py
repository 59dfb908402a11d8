"""Rule tagging of a stream.

Tagging is stateless per record, so the batch operators are used as they are;
this module only names the stream entry point.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tagspark import fixed
from tagspark.functions.text import text_corpus
from tagspark.operators.rules import Rule, tag_by_rules


def tag_stream(
    records: DataFrame, rule_list: Sequence[Rule], fields: Sequence[str] = fixed.DEFAULT_FIELDS,
    include_groups: bool = False, id: str = "org_id",
) -> DataFrame:
    """Tags of a streaming (or plain) table of records, ready for an append sink."""
    return tag_by_rules(text_corpus(records, fields), rule_list, include_groups=include_groups, id=id)
