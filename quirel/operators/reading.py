"""Reading order by geometry: lines are cut into segments, and a page's segments are read column by column.

A page is a bounded group, so its order is found by one small function over the segments, after
windows have cut them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirel.functions.strings import expand_ligatures, join_hyphens, reorder_bidi

from .text import WORD, piece, spaced_text, starts_line, tracking, with_neighbours

#: Fixed values, in em: gap that cuts a line, narrowest gutter, how far a line may reach over one, gaps that join neighbours of a row, and height of a row.
CUT, GUTTER, OVERHANG, NEAR_LOW, NEAR_HIGH, ROW = 1.2, 0.6, 0.3, -0.25, 0.5, 0.4
#: Segments up to which columns are looked for, nested regions, aligned starts of a column, gutters tried.
SEGMENTS, LEVELS, STARTS, TRIED = 4000, 6, 3, 8


def segments(found: DataFrame) -> DataFrame:
    """(doc_id, page_index, direction, seg_seq, s0, s1, t, em, text): runs in paint order, cut at baselines, steps back and wide gaps.

    Places are in the frame of the line's first run, whose direction the segment has.
    """
    page = Window.partitionBy("doc_id", "page_index").orderBy("run_seq")
    kept = with_neighbours(found).withColumn("line", F.last(F.when(starts_line(), F.col("frame")), ignorenulls=True).over(page))
    kept = kept.withColumn("seg_seq", F.sum((starts_line() | (F.col("gap") > CUT * F.col("em_small"))).cast("int")).over(page) - 1)
    start, end = F.col("x") * F.col("line.ux") + F.col("y") * F.col("line.uy"), (F.col("x") + F.col("adv_x")) * F.col("line.ux") + (F.col("y") + F.col("adv_y")) * F.col("line.uy")
    across = F.col("x") * F.col("line.vx") + F.col("y") * F.col("line.vy")
    grouped = kept.groupBy("doc_id", "page_index", "seg_seq").agg(F.first("line.direction").alias("direction"), F.min(F.least(start, end)).alias("s0"), F.max(F.greatest(start, end)).alias("s1"), F.max_by(across, F.struct("em", -F.col("run_seq"))).alias("t"), F.max("em").alias("em"), F.array_sort(F.collect_list(piece())).alias("p"))
    grouped = grouped.withColumn("spacing", tracking(F.col("p")))
    grouped = grouped.withColumn("text", spaced_text("p", "spacing"))
    # Text of fonts without widths gets half an em a character.
    s1 = F.when(F.col("s1") - F.col("s0") < 0.01 * F.col("em"), F.col("s0") + 0.5 * F.col("em") * F.length("text")).otherwise(F.col("s1"))
    return grouped.select("doc_id", "page_index", "direction", "seg_seq", "s0", s1.alias("s1"), "t", "em", "text")


class _Page:
    """Order of a page's segments as rows of (place, row, column)."""

    def __init__(self, s: pd.DataFrame):
        self.s0, self.s1, self.t, self.em = (s[c].to_numpy(float) for c in ("s0", "s1", "t", "em"))
        self.rows: list[list[int]] = []
        everything = sorted(range(len(s)), key=lambda i: (-self.t[i], self.s0[i], i))
        self.region(everything, 0 if len(s) <= SEGMENTS else LEVELS)

    def region(self, at: list[int], level: int) -> None:
        split = self.gutter(at) if level < LEVELS and len(at) >= 2 * STARTS else None
        if split is None:
            return self.read(at)
        left, right, wide = split
        tops = sorted((self.t[i] for i in wide), reverse=True)
        section = lambda i: sum(self.t[i] <= top for top in tops)
        for k in range(len(tops) + 1):
            if k:
                self.read([i for i in wide if self.t[i] == tops[k - 1] and i not in {j for row in self.rows for j in row}])
            for side in (left, right):
                part = [i for i in side if section(i) == k]
                if part:
                    self.region(part, level + 1)

    def gutter(self, at: list[int]):
        """Left, right and crossing segments of the best gutter: where starts align, by fewest crossings and then most starts."""
        em = sorted(self.em[i] for i in at)[len(at) // 2]
        groups: dict[int, list[int]] = {}
        for i in at:
            groups.setdefault(round(self.s0[i] / (OVERHANG * em)), []).append(i)
        low = min(self.s0[i] for i in at)
        tried = []
        for same in groups.values():
            x = min(self.s0[i] for i in same)
            if len(same) < STARTS or x - low < GUTTER * em:
                continue
            crossing = [i for i in at if self.s0[i] < x - OVERHANG * em and self.s1[i] > x - GUTTER * em + OVERHANG * em]
            tried.append((len(crossing), -len(same), x, crossing))
        for _, _, x, crossing in sorted(tried)[:TRIED]:
            left = [i for i in at if self.s0[i] < x - OVERHANG * em and i not in crossing]
            right = [i for i in at if self.s0[i] >= x - OVERHANG * em]
            spans = [(self.t[i], i) for i in left]
            # Rows that begin on both sides at one height are a table's, not two columns'.
            level = sum(any(abs(t - self.t[j]) < 0.1 * em for t, _ in spans) for j in right)
            wordy = sum(self.s1[i] - self.s0[i] > 8 * em for i in left + right) * 2 >= len(left + right)
            if len(left) >= STARTS and len(right) >= STARTS and len(crossing) * 4 <= len(at) and (wordy or level * 2 < len(right)):
                return left, right, crossing
        return None

    def read(self, at: list[int]) -> None:
        row: list[int] = []
        for i in sorted(at, key=lambda i: (-self.t[i], self.s0[i], i)):
            if row and self.t[row[0]] - self.t[i] > ROW * min(self.em[row[0]], self.em[i]):
                self.rows.append(sorted(row, key=lambda j: (self.s0[j], j)))
                row = []
            row.append(i)
        if row:
            self.rows.append(sorted(row, key=lambda j: (self.s0[j], j)))


def reading_rows(found: DataFrame) -> DataFrame:
    """(doc_id, page_index, row_seq, text): a page's rows in reading order; neighbours within half an em aren't set apart.

    Each direction of writing is laid out by itself, that with most text first.
    """

    def one(s: pd.DataFrame) -> list[str]:
        s = s.sort_values("seg_seq").reset_index(drop=True)
        page, out = _Page(s), []
        for row in page.rows:
            text = ""
            for k, i in enumerate(row):
                gap = (page.s0[i] - page.s1[row[k - 1]]) / page.em[i] if k else 0.0
                text += (" " if k and not (NEAR_LOW <= gap < WORD) and not text.endswith(" ") else "") + s["text"][i]
            out.append(text.rstrip())
        return out

    def order(s: pd.DataFrame) -> pd.DataFrame:
        parts = [part for _, part in s.groupby("direction")]
        parts.sort(key=lambda part: (-sum(len(t.encode()) for t in part["text"]), part["seg_seq"].min()))
        rows = [text for part in parts for text in one(part)]
        return pd.DataFrame({"doc_id": s["doc_id"].iloc[0], "page_index": s["page_index"].iloc[0], "row_seq": range(len(rows)), "text": rows})

    return segments(found).groupBy("doc_id", "page_index").applyInPandas(order, "doc_id long, page_index int, row_seq int, text string")


def finished(rows: Column, hyphens: bool = True, ligatures: bool = True) -> Column:
    """An array of rows without empty ones, hyphens joined, right-to-left lines turned, ligatures spelled out."""
    rows = F.filter(rows, lambda r: F.trim(r) != "")
    rows = join_hyphens(rows) if hyphens else rows
    return F.transform(rows, expand_ligatures) if ligatures else rows


def layout_text(found: DataFrame, hyphens: bool = True, ligatures: bool = True, invisible: bool = True, artifacts: bool = True, bidi: bool = True) -> DataFrame:
    """(doc_id, page_index, text) in reading order, with the options of a layout."""
    if not invisible:
        found = found.where("render_mode <> 3")
    if not artifacts:
        found = found.where("not artifact")
    rows = reading_rows(found)
    if bidi:
        rows = rows.withColumn("text", reorder_bidi(F.col("text")))
    grouped = rows.groupBy("doc_id", "page_index").agg(F.array_sort(F.collect_list(F.struct("row_seq", "text"))).alias("r"))
    return grouped.select("doc_id", "page_index", F.array_join(finished(F.transform("r", lambda r: r["text"]), hyphens, ligatures), "\n").alias("text"))
