"""Sources and sinks: drifting yearly extracts, ragged and faulty CSV, JSON, Stata files, JDBC, staged downloads, polygons, stored pages, small exports."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clean_column_name
from ..operators.name_graphs import numbered


def existing(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def yearly_csv(spark: SparkSession, folder: str, prefix: str, years: Sequence[int], suffix: str = ".csv") -> DataFrame:
    """The files ``<prefix><year>`` that exist, all columns as strings with lower-case names, missing ones null, and ``year``."""
    out = None
    for y in years:
        path = f"{folder}/{prefix}{y}{suffix}"
        if existing(spark, path):
            t = spark.read.csv(path, header=True, inferSchema=False)
            t = t.toDF(*[clean_column_name(c) for c in t.columns]).withColumn("year", F.lit(y))
            out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(f"no {prefix} file of {list(years)} in {folder}")
    return out


def _whole_lines(df: DataFrame) -> DataFrame:
    """All columns are parsed for every query: Spark judges a line by the columns that it reads.  The condition always holds."""
    return df.filter(F.length(F.concat_ws("", *[F.col(c).cast("string") for c in df.columns])) >= 0)


def parse_audit(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """Rows of a CSV file that don't fit a schema, counted by file."""
    typed = spark.read.schema(f"{schema}, _bad string").csv(path, header=header, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")
    return _whole_lines(typed).withColumn("file", F.input_file_name()).groupBy("file").agg(F.count("*").alias("rows"), F.count("_bad").alias("bad"))


def ragged_csv(spark: SparkSession, path: str, lower: bool = True) -> DataFrame:
    """Lines of any number of values without a header: ``values``, an array without empty and NA entries."""
    values = F.filter(F.transform(F.split("value", ","), lambda v: F.trim(F.lower(v) if lower else v)), lambda v: (v != "") & (F.upper(v) != "NA"))
    return spark.read.text(path).select(values.alias("values"))


def tolerant_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines that don't fit the schema are left out, whichever columns a query reads."""
    return _whole_lines(spark.read.schema(schema).csv(path, header=False, mode="DROPMALFORMED"))


def equivalent_pairs(lists: DataFrame, values: str = "values") -> DataFrame:
    """Symmetric pairs of the names of each row."""
    one = lists.select(F.col(values).alias("_v"), F.explode(values).alias("name1"))
    return one.select("name1", F.explode("_v").alias("name2")).filter("name1 <> name2").distinct()


def jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16, **options) -> DataFrame:
    """A remote table, read in ``parts`` ranges of a key if its bounds are given."""
    r = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key and bounds:
        r = r.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return r.load()


def latex_table(df: DataFrame, most: int = 200) -> str:
    """A small result as a LaTeX tabular; raises over ``most`` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows")
    text = lambda v: re.sub(r"([&%$#_{}])", r"\\\1", "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v))
    lines = [" & ".join(map(text, r)) + r" \\" for r in [df.columns, *rows]]
    return "\\begin{tabular}{" + "l" * len(df.columns) + "}\n\\hline\n" + lines[0] + "\n\\hline\n" + "\n".join(lines[1:]) + "\n\\hline\n\\end{tabular}\n"


def write_csv(df: DataFrame, path: str, files: int | None = None) -> None:
    """Header and quoted texts; null is an empty field, an empty text is quoted.  ``files`` joins a small result into so many files."""
    (df.coalesce(files) if files else df).write.csv(path, header=True, mode="overwrite", escape='"', emptyValue='""', nullValue="")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What ``write_csv`` wrote."""
    return spark.read.schema(schema).csv(path, header=True, escape='"', multiLine=True, emptyValue="", nullValue=None)


def write_json(df: DataFrame, path: str) -> None:
    """One object a line; nulls are left out."""
    df.write.json(path, mode="overwrite")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects, one a line, by a given schema, so that no pass infers one; a line that is no object gives a row of nulls."""
    return spark.read.schema(schema).json(path, mode="PERMISSIVE")


def write_dta(df: DataFrame, path: str, most: int = 1_000_000) -> None:
    """A Stata file on the driver's disk, for exchange; raises over ``most`` rows.  Null texts become empty, as Stata has no other."""
    rows = df.limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"over {most} rows")
    for c, t in df.dtypes:
        rows[c] = rows[c].fillna("").astype(str) if t == "string" else rows[c].astype("float64") if rows[c].isna().any() or t == "bigint" else rows[c]
    rows.to_stata(path, write_index=False, version=118)


def read_dta(spark: SparkSession, path: str, chunk: int = 100_000) -> DataFrame:
    """A Stata file from the driver's disk, chunk by chunk; missing numbers are null, texts stay as they are."""
    import pandas as pd

    out = None
    with pd.read_stata(path, chunksize=chunk, convert_categoricals=False) as reader:
        for part in reader:
            t = spark.createDataFrame(part.astype(object).where(part.notna(), None), schema=_dta_schema(part))
            out = t if out is None else out.unionByName(t)
    if out is None:
        raise ValueError(f"{path} has no rows")
    return out


def _dta_schema(part) -> str:
    kind = lambda d: "string" if d == object or str(d) in ("str", "string") else "timestamp" if str(d).startswith("datetime") else "double" if str(d).startswith("float") else "long"
    return ", ".join(f"`{c}` {kind(d)}" for c, d in part.dtypes.items())


def staged(spark: SparkSession, url: str, folder: str, schema: str, header: bool = True) -> DataFrame:
    """A CSV file that was downloaded before, found in ``folder`` by the last part of its address; raises where it has yet to be staged.  Nothing is fetched while a query runs."""
    path = f"{folder}/{url.rstrip('/').rsplit('/', 1)[-1].split('?')[0]}"
    if not existing(spark, path):
        raise FileNotFoundError(f"{url} isn't staged in {folder}")
    return spark.read.schema(schema).csv(path, header=header)


def polygons_of_year(spark: SparkSession, folder: str, year: int, first: int, id_col: str = "id", wkt: str = "wkt") -> DataFrame:
    """Polygons of a year's Parquet file (that of year ``first`` for earlier ones) with their outer ``ring`` from well-known text."""
    t = spark.read.parquet(f"{folder}/{max(year, first)}.parquet")
    return t.select(F.col(id_col).alias("id"), F.lit(year).alias("year"), ring_of(F.col(wkt)).alias("ring")).filter("ring is not null")


def ring_of(wkt):
    """The outer ring of a POLYGON text as an array of structs (x, y); null for anything else."""
    points = F.split(F.regexp_extract(wkt, r"(?i)^\s*POLYGON\s*\(\s*\(([^()]*)\)", 1), ",")
    xy = F.transform(points, lambda p: F.split(F.trim(p), r"\s+"))
    ring = F.transform(xy, lambda p: F.struct(F.get(p, F.lit(0)).try_cast("double").alias("x"), F.get(p, F.lit(1)).try_cast("double").alias("y")))
    return F.when((F.size(points) > 2) & F.forall(ring, lambda p: p.x.isNotNull() & p.y.isNotNull()), ring)


def sheet_rows(df: DataFrame, by: str) -> DataFrame:
    """One sheet for each value of ``by``: ``sheet``, ``row`` from 0 in the order of the columns, ``filled`` and the other columns.

    Names are cleaned for spreadsheets, and numbered in the order of the values
    where that makes them clash; a null is the sheet ``sheet``.  All sheets are padded with
    empty rows to the longest.  Rows are numbered over ranges of their order, so no
    task holds a sheet.
    """
    columns = [c for c in df.columns if c != by]
    cleaned = F.trim(F.substring(F.trim(F.regexp_replace(F.coalesce(F.col(by).cast("string"), F.lit("")), r"[\[\]:*?/\\]", " ")), 1, 31))
    named = df.select(by).distinct().withColumn("_clean", F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("sheet")))
    turn = F.row_number().over(Window.partitionBy("_clean").orderBy(F.col(by).asc_nulls_first()))
    named = named.withColumn("_turn", turn).withColumn("sheet", F.when(F.col("_turn") == 1, F.col("_clean")).otherwise(F.concat(F.substring("_clean", 1, 28), F.lit(" "), F.col("_turn").cast("string"))))
    placed = numbered(df, [by], columns).withColumnsRenamed({by: "_by"})
    rows = placed.join(named.select(F.col(by).alias("_of"), "sheet"), F.col("_by").eqNullSafe(F.col("_of"))).select("sheet", F.col("_number").alias("row"), F.lit(True).alias("filled"), *columns)
    heights = rows.groupBy("sheet").agg(F.count("*").alias("_n"))
    tallest = F.broadcast(heights.agg(F.max("_n").alias("_most")))  # one row
    short = heights.join(tallest, F.col("_n") < F.col("_most")).select("sheet", F.explode(F.sequence(F.col("_n"), F.col("_most") - 1)).alias("row"), F.lit(False).alias("filled"))
    return rows.unionByName(short, allowMissingColumns=True)


def write_sheets(rows: DataFrame, path: str) -> None:
    """A folder of CSV files for each sheet, in the order of its rows."""
    rows.repartitionByRange("sheet", "row").sortWithinPartitions("sheet", "row").drop("row", "filled").write.partitionBy("sheet").csv(path, header=True, mode="overwrite")


def plot_frame(df: DataFrame, x: str, y: str, series: str | None = None, se: str | None = None, z: float = 1.96) -> DataFrame:
    """What a figure draws: ``series``, ``x``, ``y``, ``low``, ``high`` (y itself without a standard error); rows without x or y go."""
    width = F.coalesce(F.col(se) * z, F.lit(0.0)) if se else F.lit(0.0)
    label = F.col(series).cast("string") if series else F.lit("")
    return df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(label.alias("series"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), (F.col(y) - width).alias("low"), (F.col(y) + width).alias("high"))


def page_details(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Heading, topic, region, page number and body of stored pages.

    ``heading``: the first h1, tags out, else the title; ``topic``: the first label
    of the host; ``region``: the first part of the path; ``page``: its ``page``
    parameter, 1 without one; ``body``: the article's text (the body's without an
    article), space squished.  What isn't there is null.
    """
    h, u = F.col(html), F.col(url)
    plain = lambda c: F.nullif(F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]*>", " "), r"[\s\u00A0]+", " ")), F.lit(""))
    part = lambda p, c=h: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    bare = F.regexp_replace(h, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    return pages.withColumns({
        "heading": F.coalesce(plain(part(r"(?is)<h1[^>]*>(.*?)</h1>")), plain(part(r"(?is)<title[^>]*>(.*?)</title>"))), "topic": part(r"^[a-z]+://([^./]+)", u), "region": part(r"^[a-z]+://[^/]+/([^/?]+)", u),
        "page": F.coalesce(part(r"[?&]page=([0-9]+)", u).try_cast("int"), F.lit(1)), "body": F.coalesce(plain(part(r"(?is)<article[^>]*>(.*?)</article>", bare)), plain(part(r"(?is)<body[^>]*>(.*?)</body>", bare))),
    })


def sheet_name(name: str) -> str:
    """A name that a spreadsheet takes: without []:*?/\\ and 31 characters long at most."""
    return re.sub(r"[\[\]:*?/\\]", " ", name).strip()[:31] or "sheet"


def cached_lookup(keys: DataFrame, cache: DataFrame, on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Keys with their cached answer, and the keys that a costly service has yet to be asked for."""
    k = keys.select(*on).distinct()
    return k.join(cache, list(on)), k.join(cache, list(on), "left_anti")


def page_fields(pages: DataFrame, html: str = "html") -> DataFrame:
    """Title, date and text length of stored pages, by patterns."""
    h = F.col(html)
    body = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(h, r"(?is)<(script|style)[^>]*>.*?</\1>", " "), r"(?s)<[^>]+>", " "), r"\s+", " "))
    return pages.withColumns({
        "title": F.nullif(F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1), F.lit("")),
        "date": F.coalesce(*[F.try_to_timestamp(F.regexp_extract(h, p, 1), F.lit(f)).cast("date") for p, f in ((r"([0-9]{4}-[0-9]{2}-[0-9]{2})", "yyyy-MM-dd"), (r"([A-Z][a-z]+ [0-9]{1,2}, [0-9]{4})", "MMMM d, yyyy"))]),
        "n_links": F.size(F.regexp_extract_all(h, F.lit("(?i)<a[ >]"), F.lit(0))), "body_chars": F.length(body),
    })
