"""Problem 1: splitting oversized items at natural boundaries, with overlap.

Method: pointer doubling. Every boundary of an item is joined to its farthest legal successor
(a sorted search, overlap included); squaring that successor table and following it from the
start gives all greedy cuts in a logarithmic number of array steps, not one after another.
An item is one row, so nothing is shuffled; only items over the limit reach Python.

Boundaries: line ends first, then the ends of words and marks, then, in stretches without
either, a grid that keeps combining characters together (up to an eighth of the limit). A piece ends at the farthest line
end in the second half of its window if there is one, else at the farthest other boundary.
The next piece starts overlap_size before that end, or up to a quarter of it later if a line
(else a word) starts there.

Defined cases: null or small texts give no pieces; a kind without a row in the limits, or with a null or
non-positive max_size gives none; overlap is held under half of max_size; a null line_start
counts lines from 1; line_end is not used; repeated rows give repeated pieces.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rows import map_rows

PIECES = "item_kind string, item_id long, piece_no int, start_pos long, end_pos long, start_line long, end_line long, text string"
WORD_END = re.compile(r"(?<=[^\s\w])(?=\w)|(?<=\s)(?=\S)|(?<=[,;:.!?。、,;:!?)\]}])")


def boundaries(text: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Line ends, and all boundaries; both sorted, both ending with the end of the text."""
    n = len(text)
    lines = np.fromiter((m.end() for m in re.finditer("\n", text)), np.int64)
    every = np.unique(np.concatenate([lines, np.fromiter((m.start() for m in WORD_END.finditer(text)), np.int64), [0, n]]))
    step = max(1, size // 8)
    most = step if size > 1 else 0  # so that every window has a boundary inside
    grid = []
    for k in np.flatnonzero(np.diff(every) > step):
        stop = int(every[k + 1])
        for p in range(int(every[k]) + step, stop, step):
            q = p
            while q < stop and q - p < most and unicodedata.combining(text[q]):
                q += 1
            grid.append(p if q < stop and unicodedata.combining(text[q]) else q)
    return np.append(lines, n), np.unique(np.concatenate([every, np.array(grid, np.int64)]))


def starts_after(cuts: np.ndarray, lines: np.ndarray, every: np.ndarray, overlap: int) -> np.ndarray:
    """Where the piece after each cut starts."""
    low = np.maximum(cuts - overlap, 0)
    out = low.copy()
    if overlap:
        slack = overlap // 4
        for own in (every, lines):  # line starts win, being set last
            k = np.minimum(np.searchsorted(own, low), len(own) - 1)
            fit = (own[k] >= low) & (own[k] <= np.minimum(low + slack, cuts))
            out = np.where(fit, own[k], out)
    return out


def cut(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Ranges of the pieces of a text longer than size."""
    n = len(text)
    if n <= size:
        return [(0, n)]
    overlap = max(0, min(overlap, (size - 1) // 2))
    lines, every = boundaries(text, size)
    start = starts_after(every, lines, every, overlap)
    start[0] = 0
    high = start + size
    by_line = lines[np.maximum(np.searchsorted(lines, high, "right") - 1, 0)]
    far = every[np.searchsorted(every, high, "right") - 1]
    reach = np.where((by_line > np.maximum(every, start + size // 2)) & (by_line <= high), by_line, far)
    return _follow(every, start, np.searchsorted(every, reach))


def _follow(every: np.ndarray, start: np.ndarray, succ: np.ndarray) -> list[tuple[int, int]]:
    """Cuts reached from the first boundary: tables are squared until the end of the text is reached."""
    last = len(every) - 1
    succ = succ.copy()
    succ[last] = last
    reached, table = np.array([0]), succ
    while reached[-1] != last:
        reached = np.concatenate([reached, table[reached]])
        reached.sort()
        table = table[table]
    cuts = np.unique(reached)
    return list(zip(start[cuts[:-1]].tolist(), every[cuts[1:]].tolist(), strict=True))


def _splitter(with_text: bool):
    def make():
        def one(kind, item, text, first_line, size, overlap):
            found = cut(text, size, overlap or 0)
            if not with_text:
                yield from ((kind, item, k, a, b, None, None, None) for k, (a, b) in enumerate(found))
                return
            breaks = np.fromiter((m.start() for m in re.finditer("\n", text)), np.int64)
            first = np.searchsorted(breaks, [a for a, _ in found]) + (first_line or 1)
            last = np.searchsorted(breaks, [b - 1 for _, b in found]) + (first_line or 1)
            for k, (a, b) in enumerate(found):
                yield kind, item, k, a, b, int(first[k]), int(last[k]), text[a:b]

        return one

    return make


def oversized(symbols: DataFrame, sources: DataFrame, limits: DataFrame) -> DataFrame:
    """Items of both kinds over their limit, with it. The limits are a table of fixed size, broadcast."""
    items = symbols.select(F.lit("symbol").alias("item_kind"), F.col("symbol_id").alias("item_id"), F.col("body").alias("text"), F.col("line_start").cast("long").alias("first_line"), F.lit("symbol_body").alias("limit_kind")).unionAll(
        sources.select(F.lit("source").alias("item_kind"), F.col("source_row_id").alias("item_id"), F.col("content").alias("text"), F.col("start_line").cast("long").alias("first_line"), F.lit("retrieved_source").alias("limit_kind"))
    )
    lim = limits.where((F.col("unit") == "characters") & (F.col("max_size") > 0)).groupBy(F.col("item_kind").alias("limit_kind")).agg(F.min("max_size").alias("max_size"), F.min("overlap_size").alias("overlap_size"))
    return items.join(F.broadcast(lim), "limit_kind").where(F.char_length("text") > F.col("max_size")).select("item_kind", "item_id", "text", "first_line", "max_size", "overlap_size")


def pieces(symbols: DataFrame, sources: DataFrame, limits: DataFrame, with_text: bool = True) -> DataFrame:
    """Ordered pieces of every oversized item with their ranges; with their lines and texts, too, if these are asked for."""
    return map_rows(oversized(symbols, sources, limits), _splitter(with_text), PIECES)


def split_items(symbols: DataFrame, sources: DataFrame, limits: DataFrame) -> DataFrame:
    """Keys of the items that the splitter cut, each once."""
    return pieces(symbols, sources, limits, with_text=False).where("piece_no = 1").select("item_kind", "item_id").distinct()


def whole_items(symbols: DataFrame, sources: DataFrame, limits: DataFrame) -> DataFrame:
    """One row per oversized item: where its pieces begin and end, and whether they are in order, within the limit, joined with an overlap no larger than asked for, and hold the text they stand for."""
    lim = limits.where("unit = 'characters'").groupBy(F.when(F.col("item_kind") == "symbol_body", "symbol").otherwise("source").alias("item_kind")).agg(F.min("max_size").alias("max_size"), F.min("overlap_size").alias("overlap_size"))
    w = Window.partitionBy("item_kind", "item_id").orderBy("piece_no")
    p = pieces(symbols, sources, limits).withColumn("before", F.lag("end_pos").over(w)).join(F.broadcast(lim), "item_kind")
    shared = F.col("before") - F.col("start_pos")
    good = (F.col("end_pos") - F.col("start_pos") <= F.col("max_size")) & (F.char_length("text") == F.col("end_pos") - F.col("start_pos")) & (F.col("before").isNull() | shared.between(0, F.col("overlap_size")) & (F.col("end_pos") > F.col("before")))
    return p.groupBy("item_kind", "item_id").agg(F.min("start_pos").alias("first_pos"), F.max("end_pos").alias("last_pos"), F.bool_and(good).alias("is_whole"))
