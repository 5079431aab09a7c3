"""Problem 7: oversized texts cut at natural boundaries, with overlap between consecutive pieces.

Lexical-cohesion segmentation: at every boundary the words of the block before are compared with those of the
block after; where the similarity has a valley the topic changes. Boundaries are the ends of lines and, inside
long lines, of sentences. Each piece ends at the deepest valley in the window in which it may end, between lines
if the window has such a boundary, else between sentences.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_TOKENS = 800
OVERLAP_LINES = 2
OVERLAP_CHARS = 40
#: Lines (or sentences) on either side of a boundary whose words are compared.
BLOCK = 6
#: What a blank line before a boundary and an unindented line after it add to a valley: they settle near-equal
#: ones, while a valley of cohesion (up to 2) decides.
BLANK_LINE, UNINDENTED = 0.1, 0.05
#: Characters of a line from which its sentences are units of their own.
LONG_LINE = 400

_WORD = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{2,}|\d+|[぀-ヿ一-鿿]")
_SOFT = re.compile(r"[\s,;)\]}。、]")
_SENTENCE = re.compile(r"[.!?;:}][\"')\]]*(?:\s+|(?<=[;}])(?=\S))|[。！？]")


def units(lines: list[str], long_line: int = LONG_LINE) -> tuple[list[str], list[bool]]:
    """(parts, whether each ends its line): the lines, long ones in sentences."""
    parts, ends = [], []
    for line in lines:
        at = 0
        if len(line) > long_line:
            for m in _SENTENCE.finditer(line):
                if m.end() - at >= long_line // 8 and m.end() < len(line):
                    parts.append(line[at : m.end()])
                    ends.append(False)
                    at = m.end()
        parts.append(line[at:])
        ends.append(True)
    return parts, ends


def cohesion(parts: list[str], block: int = BLOCK) -> list[float]:
    """The cosine of the words of the ``block`` parts before each part and of the ``block`` parts from it on.

    Counts move by one part at a time, and products and norms with them, so the cost is that of the words.
    """
    number: dict[str, int] = defaultdict(lambda: len(number))
    bags = [[number[w.lower()] for w in _WORD.findall(p)] for p in parts]
    n = len(parts)
    left, right = [0] * len(number), [0] * len(number)
    dot = square_left = square_right = 0
    for bag in bags[:block]:
        for w in bag:
            square_right += 2 * right[w] + 1
            right[w] += 1
    out = [1.0] * (n + 1)
    for i in range(1, n):
        for w in bags[i - 1]:
            # From the right side to the left one.
            square_right -= 2 * right[w] - 1
            dot -= left[w]
            right[w] -= 1
            square_left += 2 * left[w] + 1
            dot += right[w]
            left[w] += 1
        if i - 1 >= block:
            for w in bags[i - 1 - block]:
                square_left -= 2 * left[w] - 1
                dot -= right[w]
                left[w] -= 1
        if i - 1 + block < n:
            for w in bags[i - 1 + block]:
                square_right += 2 * right[w] + 1
                dot += left[w]
                right[w] += 1
        norm = math.sqrt(square_left * square_right)
        out[i] = dot / norm if norm else 0.0
    return out


def valley_depths(parts: list[str], block: int = BLOCK) -> list[float]:
    """Depth of the cohesion valley at the boundary before each part, visible breaks settling near-equal ones."""
    similarity, n = cohesion(parts, block), len(parts)
    depths = [0.0] * (n + 1)
    rising = [0.0] * (n + 1)
    for i in range(1, n):
        rising[i] = max(similarity[i], rising[i - 1] if i > 1 and similarity[i - 1] >= similarity[i] else 0)
    falling = [0.0] * (n + 2)
    for i in range(n - 1, 0, -1):
        falling[i] = max(similarity[i], falling[i + 1] if similarity[i + 1] >= similarity[i] and i + 1 < n else 0)
    for i in range(1, n):
        depth = rising[i] + falling[i] - 2 * similarity[i]
        depth += BLANK_LINE if not parts[i - 1].strip() else 0
        depths[i] = depth + (UNINDENTED if parts[i].strip() and not parts[i][0].isspace() else 0)
    return depths


def split_text(text: str, max_tokens: int = MAX_TOKENS, overlap_lines: int = OVERLAP_LINES, overlap_chars: int = OVERLAP_CHARS) -> list[tuple[int, int]]:
    """Character spans [start, end) of the pieces, each of at most ``max_tokens`` estimated tokens.

    Joined without their overlaps they give the text back. A piece that ends between lines shares its last
    ``overlap_lines`` lines with the next (fewer where more would leave the next no room); one that ends inside a
    line shares ``overlap_chars`` characters.
    """
    limit = max_tokens * 4
    if len(text.encode("utf-8", "surrogatepass")) <= limit:
        return [(0, len(text))]
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    size = [0, *np.cumsum(width).tolist()]
    lines = text.splitlines(keepends=True) if "\n" not in text else re.findall(r"[^\n]*\n|[^\n]+", text)
    parts, closes = units(lines)
    ends = [0]
    for part in parts:
        ends.append(ends[-1] + len(part))
    line_ends = [0, *(e for e, c in zip(ends[1:], closes) if c)]
    line_of = {e: i for i, e in enumerate(line_ends)}
    depths = valley_depths([p.rstrip("\r\n") for p in parts])
    spans, start, shared = [], 0, 0  # shared: where the part that is not yet in a piece begins
    unit = 0
    while True:
        if size[-1] - size[start] <= limit:
            spans.append((start, len(text)))
            return spans
        while unit < len(parts) and ends[unit] <= shared:
            unit += 1
        fits = []
        k = unit
        while k < len(ends) and size[ends[k]] - size[start] <= limit:
            fits.append(k)
            k += 1
        # The second half of the piece is the window; a boundary between lines goes before one between sentences.
        late = [k for k in fits if size[ends[k]] - size[start] >= limit // 2]
        window = [k for k in late if ends[k] in line_of] or late or [k for k in fits if ends[k] in line_of][-1:] or fits[-1:]
        if window:
            best = max(window, key=lambda k: (round(depths[k], 6), k))
            end = ends[best]
            nxt = end
            if end in line_of:
                line = line_of[end]
                for back in range(overlap_lines, 0, -1):
                    at = line_ends[max(0, line - back)]
                    room = size[line_ends[min(line + 1, len(line_ends) - 1)]] - size[at]
                    if at > start and (room <= limit or size[end] - size[at] <= limit // 2):
                        nxt = at
                        break
            if nxt == end:
                nxt = max(end - overlap_chars, start + 1)
        else:
            low, high = shared + 1, len(text)
            while low < high:
                middle = (low + high + 1) // 2
                low, high = (middle, high) if size[middle] - size[start] <= limit else (low, middle - 1)
            end = low
            soft = [m.end() for m in _SOFT.finditer(text, max(shared + 1, end - (end - start) // 5), end)]
            end = soft[-1] if soft else end
            nxt = max(end - overlap_chars, start + 1)
        spans.append((start, end))
        start, shared = nxt, end


def pieces(df: DataFrame, item: str, text: str, start_line: str, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """(item, piece, start_line, end_line, start_char, tokens, text): each text whole or in pieces.

    Texts within the limit are one piece, 0, and stay in the JVM. Line numbers count from the text's own
    ``start_line`` (1 where it is null) and follow the lines in the text, not a declared end line. Null texts
    give no piece; an empty one gives one empty piece.
    """
    base = df.where(F.col(text).isNotNull()).select(
        F.col(item).cast("long").alias("_k"), F.col(text).alias("_t"), F.coalesce(F.col(start_line), F.lit(1)).cast("long").alias("_s"), F.ceil(F.octet_length(text) / 4).alias("_n")
    )
    breaks = F.length("_t") - F.length(F.replace("_t", F.lit("\n"))) - F.when(F.endswith("_t", F.lit("\n")), 1).otherwise(0)
    small = base.where(F.col("_n") <= max_tokens).select(
        F.col("_k").alias(item), F.lit(0).alias("piece"), F.col("_s").alias("start_line"), (F.col("_s") + F.greatest(breaks, F.lit(0))).cast("long").alias("end_line"), F.lit(0).cast("long").alias("start_char"), F.col("_n").alias("tokens"), F.col("_t").alias("text")
    )

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, value, first in zip(batch["_k"], batch["_t"], batch["_s"]):
                for n, (a, b) in enumerate(split_text(value, max_tokens)):
                    line = first + value.count("\n", 0, a)
                    size = -(-len(value[a:b].encode("utf-8", "surrogatepass")) // 4)
                    rows.append((key, n, line, line + value.count("\n", a, max(a, b - 1)), a, size, value[a:b]))
            yield pd.DataFrame(rows, columns=[item, "piece", "start_line", "end_line", "start_char", "tokens", "text"])

    large = base.where(F.col("_n") > max_tokens).select("_k", "_t", "_s")
    return small.unionByName(large.mapInPandas(work, f"{item} long, piece int, start_line long, end_line long, start_char long, tokens long, text string"))
