"""Tables as separated text with comment lines: written by Spark, read by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Written forms of a missing number.
MISSING = ("", "NA", "nan", "NaN")


def write(t: DataFrame, path: str, sep: str = "\t", comment: str = "") -> str:
    """Write t as text, columns' names first in each file, after the lines of the comment; null as NA."""
    names = sep.join(t.columns)
    line = F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in t.columns])
    head = [f"# {x}" for x in comment.splitlines()]

    def run(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array([*head, names], pa.string())], names=["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["value"])

    t.select(line.alias("value")).mapInArrow(run, "value string").write.text(path)
    return path


def read(spark: SparkSession, path: str, schema: str, sep: str = "\t") -> DataFrame:
    """The rows of separated text: lines that begin with # and repeated headings are left out, missing and malformed numbers are null, and columns
    that the schema does not name are not read. schema: names and types in the order wanted."""
    head = spark.read.text(path).filter(~F.col("value").startswith("#")).limit(1).first()
    wanted = [x.strip().split(" ") for x in schema.split(",")]
    if head is None:
        return spark.createDataFrame([], schema)
    names = head["value"].split(sep)
    raw = spark.read.option("sep", sep).option("comment", "#").schema(", ".join(f"`{n}` string" for n in names)).csv(path)
    rows = raw.filter(~(F.col(names[0]).eqNullSafe(F.lit(names[0])) & F.col(names[-1]).eqNullSafe(F.lit(names[-1]))))

    def column(name: str, kind: str):
        if name not in names:
            return F.lit(None).cast(kind).alias(name)
        x = F.col(f"`{name}`")
        if kind == "string":
            return x.alias(name)
        number = F.expr(f"try_cast(`{name}` AS {kind})")
        return F.when(~x.isin(*MISSING) & (~F.isnan(number) if kind in ("double", "float") else F.lit(True)), number).alias(name)

    return rows.select(*[column(n, k) for n, k in wanted])
