"""Delimited text: loading, missing-value tokens, types and delimiter detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# Field texts that mean "missing": fixed values.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# Candidates in order of preference on a tie: fixed values.
DELIMITERS = ("|", "\t", ",", ";", " ")

_NUMBER = r"^\s*[-+]?(?i:\d+\.?\d*(e[-+]?\d+)?|\.\d+(e[-+]?\d+)?|inf|infinity)\s*$"
_BROKEN = "__broken_line"


def _require_content(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs
    location = hadoop.Path(path)
    system = location.getFileSystem(spark._jsc.hadoopConfiguration())
    found = system.globStatus(location)
    if found is None or len(found) == 0:
        raise FileNotFoundError(f"Data file not found at: {path}")
    if sum(system.getContentSummary(s.getPath()).getLength() for s in found) == 0:
        raise ValueError(f"Data file is empty: {path}")


def load_delimited(
    spark: SparkSession,
    path: str,
    delimiter: str = "|",
    encoding: str = "utf-8",
    schema: T.StructType | str | None = None,
    multiline: bool = False,
) -> DataFrame:
    """A delimited text file (or folder of them) with a header line.

    Without a schema, types are inferred from all rows in one pass: whole numbers,
    then numbers, then true/false, else text.  Pass a schema for repeated loads.  A
    line with the wrong number of fields fails the load (``mode``).
    """
    _require_content(spark, path)
    reader = (
        spark.read.option("header", True)
        .option("sep", delimiter)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multiline)
        .option("encoding", encoding)
        .option("inferSchema", False)
    )
    names = reader.csv(path).columns
    fields = [T.StructField(n, T.StringType()) for n in [*names, _BROKEN]]
    raw = reader.option("columnNameOfCorruptRecord", _BROKEN).schema(T.StructType(fields)).csv(path)
    unquoted = F.regexp_replace(_BROKEN, r'"(?:[^"]|"")*"', "")
    separators = F.length(unquoted) - F.length(F.replace(unquoted, F.lit(delimiter), F.lit("")))
    too_many = F.col(_BROKEN).isNotNull() & (separators >= len(names))
    message = f"Error parsing {path} with delimiter {delimiter!r}; try another delimiter"
    text = raw.select(*[_missing_to_null(c) for c in names], too_many.alias(_BROKEN))
    if schema is not None:
        # Checked as the rows are read.
        checked = F.when(F.col(_BROKEN), F.raise_error(F.lit(message)).cast("boolean")).otherwise(True)
        wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        out = text.filter(checked).select(
            *[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in wanted.fields]
        )
        empty = raw.isEmpty()
    else:
        out, empty, broken = _typed(text)
        if broken:
            raise ValueError(message)
    if empty:
        raise ValueError(f"No data found in file: {path}")
    return out


def _missing_to_null(column: str) -> Column:
    x = F.col(f"`{column}`")
    return F.when(~x.isin(*NA_TOKENS), x).alias(column)


def _typed(text: DataFrame) -> tuple[DataFrame, bool, bool]:
    """The typed columns, whether there is no row, and whether a line has too many fields."""

    def never(column: str, fits: Column) -> Column:
        return F.count_if(F.col(f"`{column}`").isNotNull() & ~fits) == 0

    names = [c for c in text.columns if c != _BROKEN]
    checks = [F.count(F.lit(1)).alias("__rows"), F.count_if(_BROKEN).alias("__broken")]
    for i, c in enumerate(names):
        x = F.col(f"`{c}`")
        whole = x.rlike(r"^\s*[-+]?\d{1,19}\s*$") & F.trim(x).try_cast("bigint").isNotNull()
        checks += [
            F.count(x).alias(f"n{i}"),
            never(c, whole).alias(f"whole{i}"),
            never(c, x.rlike(r"^\s*[-+]?\d+\s*$")).alias(f"digits{i}"),
            never(c, x.rlike(_NUMBER)).alias(f"number{i}"),
            never(c, x.rlike(r"^([Tt]rue|TRUE|[Ff]alse|FALSE)$")).alias(f"flag{i}"),
        ]
    row = text.agg(*checks).first()
    out = []
    for i, c in enumerate(names):
        x = F.col(f"`{c}`")
        if row[f"n{i}"] == 0:
            out.append(x.try_cast("double").alias(c))
        elif row[f"whole{i}"]:
            out.append(F.trim(x).try_cast("bigint").alias(c))
        elif row[f"digits{i}"]:
            out.append(x)  # whole numbers too long for 64 bits keep all digits, as text
        elif row[f"number{i}"]:
            out.append(F.trim(x).try_cast("double").alias(c))
        elif row[f"flag{i}"]:
            out.append(x.try_cast("boolean").alias(c))
        else:
            out.append(x)
    return text.select(*out), row["__rows"] == 0, row["__broken"] > 0


def delimiter_counts(spark: SparkSession, path: str, n_lines: int = 5) -> DataFrame:
    """``(delimiter, position, n)`` over the first lines of a file."""
    _require_content(spark, path)
    lines = spark.read.text(path).limit(n_lines)
    cells = F.array(
        *[
            F.struct(
                F.lit(d).alias("delimiter"),
                F.lit(i).alias("position"),
                (F.length("value") - F.length(F.replace("value", F.lit(d), F.lit("")))).alias("n"),
            )
            for i, d in enumerate(DELIMITERS)
        ]
    )
    return lines.select(F.inline(cells)).groupBy("delimiter", "position").agg(
        F.sum("n").cast("long").alias("n")
    )


def detect_delimiter(spark: SparkSession, path: str, n_lines: int = 5) -> str:
    """The most frequent candidate; the earlier one on a tie."""
    best = delimiter_counts(spark, path, n_lines).orderBy(F.desc("n"), "position").first()
    return best["delimiter"]
