"""Reading the transaction tables and writing results."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rarespark.functions.values import INTEGER_TEXT, NUMBER_TEXT, nan_to_null, to_number
from rarespark.operators.checks import require_target, require_unique
from rarespark.operators.joins import left_join_side
from rarespark.settings import CATEGORICAL_NAMES, ID_COL, TARGET_COL

# The two input tables of the protocol.
FACT_TABLE = "train_transaction"
SIDE_TABLE = "train_identity"

# Field texts that mean a missing value in CSV.
MISSING_MARKERS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
]


def clean_missing(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating column."""
    floating = {f.name: f.dataType for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    if not floating:
        return df
    return df.withColumns({c: nan_to_null(F.col(c)).cast(t) for c, t in floating.items()})


def _source_path(root: str, name: str, format: str) -> str:
    return f"{root.rstrip('/')}/{name}.{format}"


def _raw_csv(spark: SparkSession, root: str, name: str, header: bool, columns: list[str] | None) -> DataFrame:
    """All fields as text, doubled quotes read as one, missing markers as NULL.

    Line ends inside quotes are not supported: they would keep a file from being split."""
    reader = spark.read.option("header", header).option("quote", '"').option("escape", '"')
    try:
        raw = reader.csv(_source_path(root, name, "csv"), enforceSchema=False) if columns is None else reader.schema(
            T.StructType([T.StructField(c, T.StringType()) for c in columns])
        ).option("enforceSchema", not header).csv(_source_path(root, name, "csv"))
        missing = lambda c: F.when(~F.col(f"`{c}`").isin(MISSING_MARKERS), F.col(f"`{c}`")).alias(c)
        return raw.select(*[missing(c) for c in raw.columns])
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"required table {name} not found at {_source_path(root, name, 'csv')}") from error
        raise


def content_types(raw: DataFrame, text: Iterable[str] = CATEGORICAL_NAMES) -> dict[str, str]:
    """``bigint``, ``double`` or ``string`` for each text column, by all of its values in
    one pass. Names in ``text`` stay text; a column without values is a number."""
    text = set(text)
    names = [c for c in raw.columns if c not in text]
    counts = []
    for i, c in enumerate(names):
        column = F.col(f"`{c}`")
        counts += [F.count_if(~column.rlike(NUMBER_TEXT)).alias(f"t{i}"), F.count_if(~column.rlike(INTEGER_TEXT)).alias(f"f{i}")]
        counts.append(F.count_if(column.isNull()).alias(f"n{i}"))
    found = raw.agg(*counts).first() if counts else None
    kinds = {c: "string" for c in raw.columns if c in text}
    for i, c in enumerate(names):
        whole = not found[f"f{i}"] and not found[f"n{i}"]
        kinds[c] = "string" if found[f"t{i}"] else "bigint" if whole else "double"
    return kinds


def _typed(raw: DataFrame, schema: T.StructType, table: str) -> DataFrame:
    """Numbers from text; a value that is no number of its column's type is an error, never a NULL."""
    columns, lost = [], []
    for f in schema.fields:
        column = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            made = column
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            made = to_number(column, True).cast(f.dataType)
        else:
            made = F.trim(column).try_cast(f.dataType)
        columns.append(made.alias(f.name))
        if not isinstance(f.dataType, T.StringType):
            gone = column.isNotNull() & made.isNull() & ~F.lower(F.trim(column)).rlike("^[+-]?nan$")
            lost.append(F.count_if(gone).alias(f.name))
    if lost:
        counts = {c: n for c, n in raw.agg(*lost).first().asDict().items() if n}
        if counts:
            raise ValueError(f"table {table}: values that don't fit their column's type: {counts}")
    return raw.select(*columns)


def read_table(
    spark: SparkSession, root: str, name: str, schema: T.StructType | str | None = None, format: str = "csv", header: bool = True
) -> DataFrame:
    """One table: ``<root>/<name>.<format>``.

    CSV is read as text first and needs a ``schema`` that names all columns in order. What does
    not fit its type raises an error that names the columns."""
    if format != "csv":
        try:
            reader = spark.read if schema is None else spark.read.schema(schema)
            return clean_missing(reader.format(format).load(_source_path(root, name, format)))
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                raise FileNotFoundError(f"required table {name} not found at {_source_path(root, name, format)}") from error
            raise
    if schema is None:
        raise ValueError(f"table {name}: a CSV source needs an explicit schema; header_schema makes one")
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    return clean_missing(_typed(_raw_csv(spark, root, name, header, schema.names), schema, name))


def header_schema(spark: SparkSession, root: str, name: str, types: dict[str, str] | None = None, default: str | None = None) -> str:
    """Schema (DDL) of a CSV table: ``types`` by column name; the others are ``default``, or, without
    one, decided by their content."""
    raw = _raw_csv(spark, root, name, True, None)
    if not raw.columns:
        raise FileNotFoundError(f"table {name} has no header line")
    types = types or {}
    open_ = [c for c in raw.columns if c not in types]
    kinds = content_types(raw.select(*[f"`{c}`" for c in open_])) if default is None else dict.fromkeys(open_, default)
    return ", ".join(f"`{c}` {types.get(c) or kinds[c]}" for c in raw.columns)


def load_transactions(
    spark: SparkSession,
    root: str,
    fact_schema=None,
    side_schema=None,
    key: str = ID_COL,
    target: str = TARGET_COL,
    fact: str = FACT_TABLE,
    side: str = SIDE_TABLE,
    format: str = "csv",
) -> DataFrame:
    """Transactions with their identity row if any; checked for unique keys and complete targets.

    The keys of both tables are checked apart, which is cheaper than checking
    the wide join and rules out the same duplicates.
    """
    facts = read_table(spark, root, fact, fact_schema, format)
    sides = read_table(spark, root, side, side_schema, format)
    require_unique(facts, key)
    require_unique(sides.select(key), key)
    require_target(facts, target)
    return left_join_side(facts, sides, key)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
