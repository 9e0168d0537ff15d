"""K2, K3: page arithmetic and the page envelope.

``paginate`` follows the tracker's rule: page at least 1; limit 1..100,
default 20 when missing, not a number or 0. Numbers are read like a lenient
integer parse (leading sign and digits; anything else stops the parse).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlake import schemas

_INT = re.compile(r"^\s*([+-]?\d+)")


def parse_int(value) -> int | None:
    if value is None:
        return None
    if isinstance(value, bool):
        return None
    if isinstance(value, int):
        return value
    if isinstance(value, float):
        return int(value) if value == value and abs(value) != float("inf") else None
    m = _INT.match(str(value))
    return int(m.group(1)) if m else None


@dataclass(frozen=True)
class Page:
    page: int
    limit: int

    @property
    def offset(self) -> int:
        return (self.page - 1) * self.limit


def paginate(page=None, limit=None) -> Page:
    p = parse_int(page) or 1
    lim = parse_int(limit) or schemas.PAGE_DEFAULT_LIMIT
    return Page(max(1, p), min(schemas.PAGE_MAX_LIMIT, max(1, lim)))


def take_page(df: DataFrame, order: list[Column], page: Page) -> DataFrame:
    """Sorted page: ORDER BY ... OFFSET ... LIMIT (planned as one
    TakeOrderedAndProject of offset+limit rows; no global sort)."""
    return df.orderBy(*order).offset(page.offset).limit(page.limit)


def page_meta(count_df: DataFrame, page: Page, total_col: str = "total") -> DataFrame:
    """One-row envelope: total, page, limit, pages = ceil(total / limit)."""
    total = F.col(total_col).cast("bigint")
    return count_df.select(total.alias("total"), F.lit(page.page).cast("bigint").alias("page"),
                           F.lit(page.limit).cast("bigint").alias("limit"),
                           F.ceil(total / F.lit(page.limit)).cast("bigint").alias("pages"))
