"""Cells of HTML tables, one row of output for each table row."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame


class _Rows(HTMLParser):
    """Collects the cells of each row; br, p and div are spaces, white space is squeezed."""

    def __init__(self, row: str, cells: tuple[str, ...]):
        super().__init__()
        self.row, self.kinds = row, cells
        self.rows: list[tuple[str | None, list[str]]] = []
        self.id: str | None = None
        self.cells: list[str] = []
        self.text: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == self.row:
            self.close_row()
        elif tag in self.kinds:
            self.close_cell()
            self.text = []
            if not self.cells and self.id is None:
                self.id = dict(attrs).get("id")
        elif tag in ("br", "p", "div") and self.text is not None:
            self.text.append(" ")

    def handle_endtag(self, tag):
        if tag in self.kinds:
            self.close_cell()
        elif tag == self.row:
            self.close_row()

    def handle_data(self, data):
        if self.text is not None:
            self.text.append(data)

    def close_cell(self):
        if self.text is not None:
            self.cells.append(" ".join("".join(self.text).split()))
            self.text = None

    def close_row(self):
        self.close_cell()
        if self.cells:
            self.rows.append((self.id, self.cells))
        self.id, self.cells = None, []


def table_rows(pages: DataFrame, key: str, html: str, row: str = "tr", cells: tuple[str, ...] = ("td",)) -> DataFrame:
    """(key, row_no, row_id, cells): rows in order; ``cells`` ("td",) or ("td", "th"); row_id is the id of the first cell. Null pages have none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k, page in zip(f.iloc[:, 0], f.iloc[:, 1], strict=True):
                p = _Rows(row, cells)
                p.feed(page or "")
                p.close_row()
                out += [(k, n, i, c) for n, (i, c) in enumerate(p.rows, 1)]
            yield pd.DataFrame(out, columns=[key, "row_no", "row_id", "cells"])

    return pages.select(key, html).mapInPandas(run, f"{key} bigint, row_no int, row_id string, cells array<string>")
