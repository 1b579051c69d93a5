"""Table sinks: CSV with chosen columns, one file or many; names; previews."""

from __future__ import annotations

from datetime import date
from pathlib import PurePosixPath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def file_name(kind: str, name: str, user: str, version: int, on: date, end: str = "csv") -> str:
    """``{kind}_{name}-{user}-v{version}-{yyyymmdd}.{end}``, the name as a slug."""
    return f"{kind}_{name.replace(' ', '_').lower()}-{user}-v{version}-{on:%Y%m%d}.{end}"


def diagram_name(path: str, version: int, on: date) -> str:
    return f"diagram_{PurePosixPath(path).stem}-v{version}-{on:%Y%m%d}.drawio"


def write_csv(df: DataFrame, path: str, first: str | None = None, single: bool = False, mode: str = "overwrite") -> None:
    """CSV with a header. ``first`` puts a column first, as an index. ``single`` makes one file, for
    small results only: by default every task writes its own."""
    if first:
        df = df.select(f"`{first}`", *[f"`{c}`" for c in df.columns if c != first])
    (df.coalesce(1) if single else df).write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_unless_empty(df: DataFrame, path: str, **options) -> bool:
    """Writes and returns True, or leaves the path alone if there are no rows."""
    if df.isEmpty():
        return False
    write_csv(df, path, **options)
    return True


def write_twice(df: DataFrame, path: str, copy: str, **options) -> None:
    """One computation, two places: the copy is read from the first."""
    write_csv(df, path, **options)
    spark = df.sparkSession
    again = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    write_csv(again, copy, **options)


def filtered(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Rows whose columns contain the given texts, whatever the case: what a grid's column filters show."""
    for name, text in wanted.items():
        df = df.where(F.contains(F.lower(F.col(f"`{name}`").cast("string")), F.lit(text.lower())))
    return df


def last_rows(df: DataFrame, order: str, rows: int = 20) -> DataFrame:
    """The last rows by a column, in its order; each task hands over that many at most."""
    return df.orderBy(F.desc(order)).limit(rows).orderBy(order)


def preview(df: DataFrame, columns: list[str] | None = None, rows: int = 10) -> str:
    """The first rows as a markdown table."""
    shown = [c for c in columns or df.columns if c in df.columns]
    got = df.select(*[f"`{c}`" for c in shown]).limit(rows).collect()
    text = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [shown, ["---"] * len(shown), *[[text(v) for v in r] for r in got]]
    return "\n".join("| " + " | ".join(r) + " |" for r in lines)
