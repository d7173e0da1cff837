"""HTML page sources: tables (S2, P4) and elements by tag/class.

Pages are rows of a ``pages(page_id, html, ...)`` DataFrame; every page is parsed in the
executors (``functions/text.py``), so the work is spread by page and nothing goes through
the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import elements, table


def page_elements(pages: DataFrame, tag: str, cls: str | None = None,
                  limit: int | None = None, id_col: str = "page_id",
                  keep: list[str] | None = None) -> DataFrame:
    """One row per matching element: (page_id, ord, text).

    ``text`` is the element's text (``get_text()``: text nodes concatenated).
    ``limit`` keeps the first N elements of each page, in document order.
    """
    keep = keep or []
    found = elements("html", tag, cls)
    if limit is not None:
        found = F.slice(found, 1, limit)
    return pages.select(id_col, *keep, F.posexplode(found).alias("ord", "text"))


def html_tables(pages: DataFrame, table_index: int = 0, id_col: str = "page_id",
                keep: list[str] | None = None) -> DataFrame:
    """S2 + P4: rows of the ``table_index``-th ``<table>`` of each page.

    Output ``(page_id, row, header array<string>, cells array<string>)``.  Spans are written
    out, end tags may be missing, a nested table is text of its cell; cell text is decoded and
    trimmed, always a string.  A page without that table yields no rows.
    """
    keep = keep or []
    parsed = pages.select(id_col, *keep, table("html", table_index).alias("t"))
    return (parsed.select(id_col, *keep, F.col("t.header").alias("header"),
                          F.posexplode("t.rows").alias("row", "cells"))
            .select(id_col, *keep, "row", "header", "cells"))


def table_pages(rows: DataFrame, keys: list[str], order_by: str, row_col: str, head: str, tail: str) -> DataFrame:
    """The way back: one page per ``keys`` (its columns and ``html``), ``head`` with the table's
    header, the markup of its rows in order, ``tail``.  A page is one value, so a key of many
    rows should be dealt into parts first and have ``part`` among the keys; each part's page
    carries the header."""
    body = F.array_sort(F.collect_list(F.struct(F.col(order_by).alias("k"), F.col(row_col).alias("row"))))["row"]
    return (rows.groupBy(*keys).agg(F.array_join(body, "").alias("_body"))
            .select(*keys, F.concat(F.lit(head), "_body", F.lit(tail)).alias("html")))


#: Begins every error about a page's headers, by which the cycle knows one.
HEADER_ERROR = "line-up header: "


def header_target(header: str, mapping: list[tuple[str, str]]) -> str | None:
    """P5 rule: the target of the last key that ``header`` contains, or None."""
    return next((target for key, target in reversed(mapping) if key in header), None)


def header_targets(header: Column, mapping: list[tuple[str, str]]) -> Column:
    """``header_target`` as one CASE over a header column, keys tested last to first."""
    cases = F.lit(None).cast("string")
    for key, target in mapping:
        cases = F.when(F.contains(header, F.lit(key)), F.lit(target)).otherwise(cases)
    return cases


def table_columns(tables: DataFrame, mapping: list[tuple[str, str]],
                  strict: bool = True, id_col: str = "page_id",
                  keep: list[str] | None = None,
                  required: list[str] | None = None) -> DataFrame:
    """P5 on parsed rows: pick cells by header substring into named columns.

    For each header, the *last* key of ``mapping`` it contains decides its
    target.  A target matched by two headers of one page fails the job with
    a named error; with ``strict`` a ``required`` target (default: all) that
    no header matches fails too, otherwise the column is NULL.
    """
    keep = keep or []
    owners = F.transform("header", lambda h: header_targets(h, mapping))
    named = F.filter(owners, lambda t: t.isNotNull())
    dup_msg = F.concat(F.lit(HEADER_ERROR + "duplicate column targets in headers: "), F.array_join("header", ", "))
    staged = tables.select(id_col, *keep, "row", "header", "cells",
                           F.when(F.size(named) != F.size(F.array_distinct(named)),
                                  F.raise_error(dup_msg).cast("array<string>"))
                           .otherwise(owners).alias("_owners"))
    targets = []
    seen = set()
    for _, target in mapping:
        if target in seen:
            continue
        seen.add(target)
        pos = F.array_position("_owners", target).cast("int")
        miss_msg = F.concat(F.lit(f"{HEADER_ERROR}no column for '{target}'; detected columns: "),
                            F.array_join("header", ", "))
        if strict and (required is None or target in required):
            value = F.when(pos == 0, F.raise_error(miss_msg).cast("string"))
        else:
            value = F.when(pos == 0, F.lit(None).cast("string"))
        targets.append(value.otherwise(F.try_element_at("cells", pos)).alias(target))
    return staged.select(id_col, *keep, "row", *targets)
