"""Benchmark decontamination by pigeonhole edit matching.

An item of n characters may differ from the passage that leaked by k = floor(n * rate) edits. Split into k + 1
pieces, one of them is in the passage unchanged, so an automaton of all pieces finds every candidate place. Each
is verified: Myers' bit-parallel algorithm (1999) gives the least edit distance of the whole item to any substring
of the window around the hit. Items and texts are compared lower-cased, with runs of white space as one blank.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Edits allowed for each character of an item.
RATE = 0.05
#: Characters of items that are matched in one pass over the documents; more items take more passes.
BLOCK_CHARS = 1_000_000


def plain(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, rate: float = RATE) -> list[tuple[int, str]]:
    """(offset, piece): budget + 1 pieces of nearly equal length."""
    k = min(int(len(item) * rate), len(item) - 1)
    ends = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def myers(pattern_bits: dict[str, int], n: int, text: str, start: int, end: int) -> tuple[int, int]:
    """(distance, end) of the substring of text[start:end] nearest to a pattern of n characters, the first of the nearest.

    pattern_bits has the positions of each character of the pattern as bits.
    """
    full, top = (1 << n) - 1, 1 << (n - 1)
    pv, mv, score = full, 0, n
    best, at = n, start
    for j in range(start, end):
        eq = pattern_bits.get(text[j], 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        pv, mv = (mh << 1 & full) | ~(xv | ph) & full, ph & xv
        if score < best:
            best, at = score, j + 1
    return best, at


def bits(pattern: str) -> dict[str, int]:
    found: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        found[c] |= 1 << i
    return dict(found)


class Matcher:
    """Finds the items of one block in texts. Each row of items is looked for, whatever its id."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float = RATE):
        self.rate = rate
        self.ids = [i for i, _ in items]
        self.items = {row: p for row, (_, t) in enumerate(items) if (p := plain(t))}
        self.bits = {i: bits(p) for i, p in self.items.items()}
        self.back = {i: bits(p[::-1]) for i, p in self.items.items()}
        where: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, p in self.items.items():
            for offset, piece in pieces(p, rate):
                where[piece].append((i, offset))
        self.tree = ahocorasick.Automaton()
        for piece, owners in where.items():
            self.tree.add_word(piece, (len(piece), owners))
        if self.items:
            self.tree.make_automaton()

    def find(self, text: str | None) -> list[tuple[int | None, int, int, int]]:
        """(item, start, end, distance) of the nearest passage of each item that is within its budget.

        start and end are offsets in the plain text; of equally near passages the first counts.
        """
        text = plain(text)
        if not self.items or not text:
            return []
        windows: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for last, (length, owners) in self.tree.iter(text):
            for i, offset in owners:
                n, at = len(self.items[i]), last + 1 - length - offset
                k = int(n * self.rate)
                windows[i].append((max(0, at - k), min(len(text), at + n + k)))
        found = []
        for i, spans in windows.items():
            p = self.items[i]
            n, budget = len(p), int(len(p) * self.rate)
            best = (budget + 1, 0)
            spans.sort()
            start, end = spans[0]
            for a, b in [*spans[1:], (len(text) + 1, 0)]:
                if a <= end and a - start < 4 * n:  # windows that overlap are read once
                    end = max(end, b)
                    continue
                best = min(best, myers(self.bits[i], n, text, start, end))
                start, end = a, b
            if best[0] <= budget:
                distance, stop = best
                window = text[max(0, stop - n - budget) : stop][::-1]
                # read backwards from its end, the passage is the prefix at which the item's distance is the same
                begin = stop - _prefix(self.back[i], n, window, distance)
                found.append((self.ids[i], begin, stop, distance))
        return sorted(found, key=lambda hit: (hit[0] is None, hit))


def _prefix(pattern_bits: dict[str, int], n: int, text: str, distance: int) -> int:
    """The length of the shortest prefix of text at that edit distance of the pattern."""
    full, top = (1 << n) - 1, 1 << (n - 1)
    pv, mv, score = full, 0, n
    if score == distance:
        return 0
    for j, c in enumerate(text):
        eq = pattern_bits.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1 | 1) & full
        pv, mv = (mh << 1 & full) | ~(xv | ph) & full, ph & xv
        if score == distance:
            return j + 1
    return len(text)


def _blocks(items: DataFrame, most: int, unnamed: bool) -> Iterator[list[tuple[int | None, str]]]:
    """The distinct items (id and text) in blocks of a bounded number of characters, one block at a time on the driver."""
    block, size = [], 0
    items = items if unnamed else items.where("item_id is not null")
    for row in items.select("item_id", "text").distinct().toLocalIterator():
        block.append((row.item_id, row.text))
        size += len(row.text or "") + 1
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaks(docs: DataFrame, items: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS, id_col: str = "doc_id", keep: list[str] | None = None, unnamed: bool = False) -> DataFrame:
    """One row for each document and item that it holds: the kept columns, item_id, start, end, distance.

    keep are the columns of docs that stay (its id, if not given). Null, empty and blank texts and items match nothing; an
    item too short for an edit is matched exactly. Items that repeat an id with other texts are matched each, those that repeat
    both once. Items with a null id take part if `unnamed`, as in the query and the pipeline, and report a null item_id; else they
    match nothing. Documents that repeat are matched each. The benchmark is broadcast in blocks of block_chars, each matched in a pass of its own.
    """
    keep = [id_col] if keep is None else keep
    source = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep)], F.col("text").cast("string").alias("text"))
    kinds = ", ".join(f"_{i} {source.schema[i].dataType.simpleString()}" for i in range(len(keep)))
    item_type = items.schema["item_id"].dataType
    arrow_type = to_arrow_type(item_type)
    schema = f"{kinds}, item_id {item_type.simpleString()}, start int, end int, distance int"
    found = docs.sparkSession.createDataFrame([], schema)
    for block in _blocks(items, block_chars, unnamed):
        shared = docs.sparkSession.sparkContext.broadcast((block, rate))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(*shared.value)
            for batch in batches:
                rows, hits = [], []
                for at, text in enumerate(batch["text"]):
                    for hit in matcher.find(text.as_py()):
                        rows.append(at)
                        hits.append(hit)
                taken = [batch[f"_{i}"].take(pa.array(rows, pa.int64())) for i in range(len(keep))]
                numbers = [pa.array([h[j] for h in hits], arrow_type if j == 0 else pa.int32()) for j in range(4)]
                yield pa.RecordBatch.from_arrays([*taken, *numbers], names=[*[f"_{i}" for i in range(len(keep))], "item_id", "start", "end", "distance"])

        found = found.unionByName(source.mapInArrow(run, schema))
    return found.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], "item_id", "start", "end", "distance")


def clean(docs: DataFrame, items: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS, unnamed: bool = False) -> DataFrame:
    """The documents that hold no item, with all their columns, whatever their names; `unnamed` as in leaks().

    Null, empty and blank texts hold nothing and stay; repeated rows share their fate; without items or documents nothing goes.
    One pass for each block of items.
    """
    for block in _blocks(items, block_chars, unnamed):
        shared = docs.sparkSession.sparkContext.broadcast((block, rate))

        @F.pandas_udf("boolean")
        def held(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            matcher = Matcher(*shared.value)  # noqa: B023  bound before the next block
            for texts in batches:
                yield texts.map(lambda t: bool(matcher.find(t))).astype(bool)

        docs = docs.where(~held(F.col("text").cast("string")))
    return docs


#: levenshtein counts bytes: code points beyond ASCII that an item has get unused characters, all others of a text one more.
ORACLE = f"""
WITH items AS (
  SELECT DISTINCT item_id, text FROM benchmark
), plain_items AS (
  SELECT row_number() OVER () AS item, item_id, p, length(p) AS n, floor(length(p) * {RATE})::BIGINT AS budget
  FROM (SELECT item_id, trim(regexp_replace(lower(text), '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+', ' ', 'g')) AS p FROM items) WHERE p <> ''
), texts AS (
  SELECT row_number() OVER () AS doc, doc_id, trim(regexp_replace(lower(text), '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+', ' ', 'g')) AS t FROM documents
), pieces AS (
  SELECT item, n, budget, n * i // (k + 1) AS off_, substr(p, n * i // (k + 1) + 1, n * (i + 1) // (k + 1) - n * i // (k + 1)) AS piece
  FROM (SELECT *, unnest(range(k + 1)) AS i FROM (SELECT *, least(budget, n - 1) AS k FROM plain_items))
), hits AS (
  SELECT doc, item, n, budget, off_, unnest(list_filter(range(1, length(t) - length(piece) + 2), lambda j: substr(t, j, length(piece)) = piece)) AS hit
  FROM texts JOIN pieces ON contains(t, piece)
), starts AS (
  SELECT DISTINCT doc, item, n, budget, unnest(range(greatest(1, hit - off_ - budget), hit - off_ + budget + 1)) AS first FROM hits
), places AS (
  SELECT doc, item, first, unnest(range(n - budget, n + budget + 1)) AS size FROM starts
), spelled AS (
  SELECT doc, item, doc_id, item_id, length(t) AS chars, budget, translate(p, array_to_string(far, ''), array_to_string(free[2:len(far) + 1], '')) AS p,
         regexp_replace(translate(t, array_to_string(far, ''), array_to_string(free[2:len(far) + 1], '')), '[^\\x01-\\x7f]', free[1], 'g') AS t
  FROM (SELECT *, list_distinct(regexp_extract_all(p, '[^\\x01-\\x7f]')) AS far,
               list_filter(list_transform(range(1, 128), lambda c: chr(c::INT)), lambda c: NOT contains(p || t, c) AND c NOT IN (chr(92), '$')) AS free
        FROM (SELECT DISTINCT doc, item FROM hits) JOIN texts USING (doc) JOIN plain_items USING (item))
), measured AS (
  SELECT doc, item, doc_id, item_id, budget, first - 1 AS start_, first - 1 + size AS end_, levenshtein(p, substr(t, first, size)) AS distance
  FROM places JOIN spelled USING (doc, item) WHERE first - 1 + size <= chars
)
SELECT doc_id, item_id, best[3]::INT * -1 AS start, best[2]::INT AS "end", best[1]::INT AS distance
FROM (SELECT doc, item, doc_id, item_id, min((distance, end_, -start_)) AS best FROM measured WHERE distance <= budget GROUP BY ALL)
"""
