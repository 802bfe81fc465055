"""Lines of read text with their boxes: joining, merging two readings, and highlights."""

from __future__ import annotations



import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE = "struct<t: string, x: float, y: float, w: float, h: float>"
LINES = f"array<{LINE}>"
MAX_BOXES = 64
OVERLAP = 0.3


def line_text(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda x: x["t"]), "\n")


def lines_from_json(text: Column) -> Column:
    """Lines kept as JSON; what can't be read is no line."""
    return F.coalesce(F.from_json(text, LINES), F.array().cast(LINES))


def shared_area(a: Column, b: Column) -> Column:
    side = lambda p, s: F.greatest(F.lit(0.0), F.least(a[p] + a[s], b[p] + b[s]) - F.greatest(a[p], b[p]))
    return side("x", "w") * side("y", "h")


def merge_lines(primary: Column, extra: Column) -> Column:
    """The primary lines, and extra ones that they cover by less than 30 %, each before the first line below it."""
    covered = lambda e: F.aggregate(primary, F.lit(0.0), lambda s, p: s + shared_area(e, p).cast("double"))
    new = F.filter(extra, lambda e: covered(e) < OVERLAP * (e["w"] * e["h"]).cast("double"))

    def insert(out: Column, line: Column) -> Column:
        at = F.size(F.filter(F.transform(out, lambda x, i: F.when(x["y"] > line["y"], i)), lambda i: i.isNotNull()))
        first = F.coalesce(F.array_min(F.filter(F.transform(out, lambda x, i: F.when(x["y"] > line["y"], i)), lambda i: i.isNotNull())), F.size(out))
        head = F.slice(out, F.lit(1), first)
        return F.when(at == 0, F.concat(out, F.array(line))).otherwise(F.concat(head, F.array(line), F.slice(out, first + 1, F.size(out))))

    return F.aggregate(new, primary, insert)


def boxes(lines: list, terms: list[str]) -> tuple[list[dict], str | None]:
    """Boxes for the terms within the lines, by share of characters, and the first line that has one."""
    found: list[dict] = []
    snippet = None
    for line in lines if lines is not None else ():
        low = line["t"].lower()
        length = max(1, len(low))
        for term in terms:
            if len(found) >= MAX_BOXES:
                break
            at = low.find(term) if term else -1
            while at >= 0:
                part = line["w"] / length
                found.append({"t": line["t"][at : at + len(term)], "x": line["x"] + part * at, "y": line["y"], "w": part * len(term), "h": line["h"]})
                snippet = line["t"] if snippet is None else snippet
                at = low.find(term, at + len(term))
    return found, snippet


def _highlight(lines: pd.Series, terms: list[str]) -> pd.DataFrame:
    found = [boxes(x, terms) for x in lines]
    return pd.DataFrame({"highlights": [b for b, _ in found], "snippet": [s for _, s in found]})


def with_highlights(page: DataFrame, terms: list[str], lines: str = "lines") -> DataFrame:
    """The rows of one page with highlights and snippet; geometry is read for these rows only."""

    def highlight(column: pd.Series) -> pd.DataFrame:
        return _highlight(column, terms)

    marked = page.withColumn("_marks", F.pandas_udf(highlight, f"highlights {LINES}, snippet string")(F.col(lines)))
    return marked.withColumns({"highlights": F.col("_marks")["highlights"], "snippet": F.col("_marks")["snippet"]}).drop("_marks")


def reading_rows(lines: list) -> list[list]:
    """Boxes in reading order: a box joins the row if its middle is above the lower edge of the row's first box."""
    rows: list[list] = []
    for line in sorted(lines, key=lambda x: (x["y"], x["x"])):
        first = rows[-1][0] if rows else None
        middle = line["y"] + line["h"] / 2
        if first is not None and middle < first["y"] + first["h"]:
            rows[-1].append(line)
        else:
            rows.append([line])
    return [sorted(r, key=lambda x: x["x"]) for r in rows]


