"""Library statistics, index status, failures and sections."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkseek.functions.text import color_name

TOP_COLORS = 8
BACKLOG = 40


def totals(catalog: DataFrame) -> DataFrame:
    """One row: items, bytes, items with text, of shown rows."""
    return catalog.filter(~F.col("hidden")).agg(F.count("*").alias("items"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count_if(F.col("text") != "").alias("with_text"))


def folders(catalog: DataFrame) -> DataFrame:
    """(folder, items), most first and then by name."""
    return catalog.filter(~F.col("hidden")).groupBy("folder").agg(F.count("*").alias("items")).orderBy(F.desc("items"), "folder")


def months(catalog: DataFrame, now: datetime, count: int = 12) -> DataFrame:
    """(month, items) of the last months, with months without items as 0; months after now drop out."""
    spark = catalog.sparkSession
    first = f"date_trunc('month', add_months(timestamp '{now:%Y-%m-%d %H:%M:%S}', {1 - count}))"
    spine = spark.sql(f"SELECT date_format(m, 'yyyy-MM') AS month FROM (SELECT explode(sequence({first}, date_trunc('month', timestamp '{now:%Y-%m-%d %H:%M:%S}'), interval 1 month)) AS m)")
    own = catalog.filter(~F.col("hidden")).groupBy(F.date_format(F.timestamp_millis("mtime"), "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    return spine.join(own, "month", "left").select("month", F.coalesce("n", F.lit(0)).alias("items")).orderBy("month")


def colors(catalog: DataFrame, top: int = TOP_COLORS) -> DataFrame:
    """(name, hex, items) of the commonest first colours; hex is the first row's by id."""
    first = catalog.filter(~F.col("hidden") & (F.size("colors") > 0)).select("id", F.get("colors", F.lit(0)).alias("hex")).withColumn("name", color_name(F.col("hex")))
    return first.groupBy("name").agg(F.min_by("hex", "id").alias("hex"), F.count("*").alias("items")).orderBy(F.desc("items"), "name").limit(top)


def status(catalog: DataFrame, version: str | None) -> DataFrame:
    """One row of counts: all, read, embedded by this model, with errors, read sharply."""
    embedded = F.col("embedding").isNotNull() & (F.lit(True) if version is None else F.col("embedding_version").eqNullSafe(version))
    return catalog.filter(~F.col("hidden")).agg(
        F.count("*").alias("total"), F.count_if(F.col("stage") >= 1).alias("read"), F.count_if(embedded).alias("embedded"),
        F.count_if((F.col("stage") == -1) | F.col("error").isNotNull()).alias("errors"), F.count_if(F.col("ocr") == 1).alias("sharp"),
    )


def failures(catalog: DataFrame) -> DataFrame:
    """(id, path, message) of rows that could not be read or read sharply, newest first."""
    failed = (F.col("stage") == -1) | (F.col("ocr") == -1) | F.col("error").isNotNull()
    message = F.coalesce("error", F.when(F.col("ocr") == -1, "Accurate text reading failed").otherwise("Could not be read"))
    return catalog.filter(~F.col("hidden") & failed).select("id", "path", "mtime", message.alias("message")).orderBy(F.desc("mtime"), "id").drop("mtime")


def waiting(catalog: DataFrame, most: int = BACKLOG) -> DataFrame:
    """Rows that wait to be read, no more than one past the most that is asked about."""
    return catalog.filter(~F.col("hidden") & (F.col("stage") == 0)).limit(most + 1)


def backlog(catalog: DataFrame, most: int = BACKLOG) -> int:
    return waiting(catalog, most).count()


def exists(df: DataFrame) -> bool:
    return not df.isEmpty()


def group_size(catalog: DataFrame, group_id: int) -> int:
    return catalog.filter(~F.col("hidden") & (F.col("group_id") == group_id)).count()


def state(paused: bool, scanning: bool, waiting: int) -> str:
    return "paused" if paused else "scanning" if scanning else "indexing" if waiting else "idle"


def waiting_reason(paused: bool, forced: bool, on_battery: bool, idle: bool, waiting: int, small: int = BACKLOG) -> str | None:
    """Why waiting rows are not worked on, the first that applies; None if they are or none waits."""
    if not waiting or forced:
        return None
    if paused:
        return "paused"
    if on_battery:
        return "on battery"
    return None if idle or waiting <= small else "busy"


def recent_warnings(warnings: list[str], new: str, most: int = 20) -> list[str]:
    """The warnings with a new one; the oldest are dropped beyond a bound."""
    return [*warnings, new][-most:]


def status_line(total: int, read: int, paused: bool) -> str:
    return "Paused" if paused else f"Reading {read} of {total}" if read < total else f"{total} searchable"


def diagnostics(catalog: DataFrame, version: str | None) -> DataFrame:
    """One row of counts only: neither paths nor texts."""
    return status(catalog, version).crossJoin(totals(catalog).select("bytes", "with_text"))


def section(mtime: Column, now: datetime) -> Column:
    """Today, Yesterday, This week, the month's name, or month and year."""
    day, today = F.to_date(F.timestamp_millis(mtime)), F.to_date(F.lit(f"{now:%Y-%m-%d}"))
    age = F.date_diff(today, day)
    return F.when(age <= 0, "Today").when(age == 1, "Yesterday").when(age < 7, "This week").when(F.year(day) == now.year, F.date_format(day, "MMMM")).otherwise(F.date_format(day, "MMMM yyyy"))


def sections(page: DataFrame, order: list[Column], title: Column) -> DataFrame:
    """Runs of neighbouring rows of one title: (run, title, first, rows). A page is small, so one window holds it."""
    by = Window.orderBy(*order)
    marked = page.withColumn("title", title).withColumn("_at", F.row_number().over(by))
    marked = marked.withColumn("_new", F.coalesce((F.col("title") != F.lag("title").over(Window.orderBy("_at"))).cast("int"), F.lit(1)))
    marked = marked.withColumn("run", F.sum("_new").over(Window.orderBy("_at")))
    return marked.groupBy("run", "title").agg(F.min("_at").alias("first"), F.count("*").alias("rows"))
