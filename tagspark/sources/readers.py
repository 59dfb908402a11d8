"""Text sources as typed tables.

Columns are matched by header name and cast without failing: a value that does
not fit its type becomes null, as do the texts a CSV reader takes as missing.
Files stay splittable unless ``multi_line`` is asked for.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagspark import fixed

ISO = "yyyy-MM-dd"
DAY_FIRST = "d/M/yyyy"


def parse_date(text: Column, pattern: str = ISO) -> Column:
    """A date, or null where the text is not one."""
    if pattern == ISO:
        return F.substring(F.trim(text), 1, 10).try_cast("date")
    # Day-first registers also come with dashes and with a time of day.
    day = F.substring_index(F.translate(F.trim(text), "-", "/"), " ", 1)
    return F.try_to_timestamp(day, F.lit(pattern)).cast("date")


def _typed(
    raw: DataFrame, schema: T.StructType, date_cols: Sequence[str] = (), pattern: str = ISO
) -> list[Column]:
    """The columns of ``schema`` out of an all-text table, matched by name."""
    names = {c.lstrip("\ufeff"): c for c in raw.columns}
    out = []
    for field in schema.fields:
        if field.name not in names:
            out.append(F.lit(None).cast(field.dataType).alias(field.name))
            continue
        text = F.col(f"`{names[field.name]}`")
        text = F.when(~text.isin(fixed.MISSING_TEXTS), text)
        if field.name in date_cols or isinstance(field.dataType, T.DateType):
            value = parse_date(text, pattern)
        elif isinstance(field.dataType, T.StringType):
            value = text
        elif isinstance(field.dataType, T.BooleanType):
            value = F.lower(F.trim(text)).try_cast("boolean")
        else:
            value = F.trim(text).try_cast(field.dataType)
        out.append(value.alias(field.name))
    return out


def _read_csv(spark: SparkSession, path, encoding: str = "UTF-8", multi_line: bool = False):
    return (
        spark.read.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("encoding", encoding)
        .option("multiLine", multi_line)
        .option("mode", "PERMISSIVE")
        .csv(path)
    )


def scan_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType,
    date_cols: Sequence[str] = (),
    date_pattern: str = ISO,
    encoding: str = "UTF-8",
    multi_line: bool = False,
) -> DataFrame:
    """Headered CSV. ``multi_line`` allows newlines inside quotes but makes one
    task read one whole file; our own sinks flatten newlines so it is rarely needed."""
    raw = _read_csv(spark, path, encoding, multi_line)
    return raw.select(*_typed(raw, schema, date_cols, date_pattern))


def scan_dayfirst(
    spark: SparkSession, path, schema: T.StructType, date_cols: Sequence[str], **kw
) -> DataFrame:
    """CSV with dates written ``dd/mm/yyyy``."""
    return scan_csv(spark, path, schema, date_cols, DAY_FIRST, **kw)


def scan_encoded(
    spark: SparkSession,
    path,
    schema: T.StructType,
    encoding: str = "cp858",
    date_cols: Sequence[str] = (),
) -> DataFrame:
    """Day-first CSV in a one-byte code page.

    The reader takes only a few charsets, so bytes are read as Latin-1 (one
    character per byte) and the upper half is then translated.
    """
    raw = _read_csv(spark, path, "ISO-8859-1")
    upper = bytes(range(128, 256))
    latin, wanted = upper.decode("latin-1"), upper.decode(encoding)
    # Header names are ASCII in practice, but go through the same table.
    table = str.maketrans(latin, wanted)
    decoded = raw.select(
        *[F.translate(f"`{c}`", latin, wanted).alias(c.translate(table)) for c in raw.columns]
    )
    return decoded.select(*_typed(decoded, schema, date_cols, DAY_FIRST))


def scan_tsv(
    spark: SparkSession,
    path,
    schema: T.StructType,
    date_cols: Sequence[str] = (),
    header: Sequence[str] | None = None,
) -> DataFrame:
    r"""Tab-separated text without quoting, ``\`` escaping the next character.

    The CSV reader honours escapes only inside quotes, so lines are cut here by
    one regular expression. ``header`` names the file's columns in order; by
    default they are those of ``schema``.
    """
    names = list(header) if header else schema.fieldNames()
    line = F.regexp_replace(F.col("value"), "^\ufeff|\r$", "")
    cells = F.regexp_extract_all(line, F.lit(r"((?:[^\t\\]|\\.)*)(?:\t|$)"), F.lit(1))
    lines = (
        spark.read.text(path)
        .where(line != "\t".join(names))
        .select(cells.alias("cells"))
    )
    raw = lines.select(
        *[
            F.regexp_replace(F.get("cells", F.lit(i)), r"\\(.)", "$1").alias(name)
            for i, name in enumerate(names)
        ]
    )
    return raw.select(*_typed(raw, schema, date_cols))


def stack_in_order(tables: Sequence[DataFrame]) -> DataFrame:
    """Tables one below the other; ``file_ord`` says which one a row came from."""
    numbered = [df.withColumn("file_ord", F.lit(i)) for i, df in enumerate(tables)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)


def scan_multi(
    spark: SparkSession,
    paths: Sequence[str],
    schema: T.StructType,
    date_cols: Sequence[str] = (),
    date_pattern: str = ISO,
    multi_line: bool = False,
) -> DataFrame:
    """Several CSV files, or folders of them, stacked, with ``file_ord`` and ``row_ord``.

    ``row_ord`` grows along each path: the file's name (a folder's files follow each other by name), the start of the block a
    row was read from, then its place in that block. ``multi_line`` reads line breaks inside quotes, each file in one task (see
    :func:`scan_csv`), so a large table with line breaks is better a folder of several files.
    """
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
    )
    tables = []
    for path in paths:
        raw = _read_csv(spark, path, multi_line=multi_line)
        tables.append(
            raw.select(*_typed(raw, schema, date_cols, date_pattern), place.alias("row_ord"))
        )
    return stack_in_order(tables)


def records_to_table(
    records: DataFrame,
    schema: T.StructType,
    join_fields: Sequence[str] = (),
    fields_col: str = "fields",
    id_cols: Sequence[str] = ("id",),
    sep: str = ";",
) -> DataFrame:
    """Sparse JSON records to a table: a missing field is null, a list field is
    joined by ``sep``, and a join field that is no list of texts is null."""
    kinds = T.StructType(
        [
            T.StructField(f.name, T.ArrayType(T.StringType()) if f.name in join_fields else f.dataType)
            for f in schema.fields
        ]
    )
    parsed = records.withColumn("_rec", F.from_json(fields_col, kinds))
    cols = []
    for f in schema.fields:
        value = F.col("_rec").getField(f.name)
        cols.append((F.array_join(value, sep) if f.name in join_fields else value).alias(f.name))
    return parsed.select(*id_cols, *cols)
