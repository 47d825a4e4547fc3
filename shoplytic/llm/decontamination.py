"""Benchmark items in documents, up to a share of edited characters.

An item with an error budget of k edits is cut into k + 1 pieces. Whatever k edits do,
one piece stays as it is; so exact hits of pieces show every place where the item can
be, and Myers' bit-parallel distance confirms it there. Texts and items are compared in
lower case with runs of white space as one space.

The benchmark is the fixed query set. It is dealt into blocks of bounded size; a block
travels to the tasks as a broadcast and one pass over the documents answers it. Another
block is another pass, so no broadcast grows with the benchmark.

Items without a word are skipped. A null text is empty. Repeated rows give repeated
matches; an item that occurs more than once in a text is reported at its best place, the
first of equals. Texts may have any length, a task holds one batch of them; matches
are sought in one scan of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ERROR_SHARE = 0.05
BLOCK_CHARS = 1 << 20

Pieces = list[tuple[str, int, int]]


def normalised(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget_of(item: str, error_share: float) -> int:
    return int(len(item) * error_share)


def pieces_of(item: str, budget: int) -> list[tuple[int, str]]:
    """``budget + 1`` consecutive pieces (offset, piece), lengths at most one apart."""
    count = min(budget + 1, len(item))
    cuts = [len(item) * i // count for i in range(count + 1)]
    return [(cuts[i], item[cuts[i] : cuts[i + 1]]) for i in range(count)]


class Pattern:
    """Myers' bit-parallel search for one item; the bit vectors are Python integers."""

    def __init__(self, item: str) -> None:
        self.size = len(item)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(item):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def best_end(self, text: str, anchored: bool = False) -> tuple[int, int]:
        """(distance, end) of the substring nearest to the item, the first of equals.

        With ``anchored``, of the prefix nearest to it.
        """
        top, all_bits = 1 << (self.size - 1), (1 << self.size) - 1
        plus, minus, score = all_bits, 0, self.size
        best, end = score, 0
        for at, c in enumerate(text, 1):
            same = self.masks.get(c, 0)
            vertical = same | minus
            diagonal = (((same & plus) + plus) ^ plus) | same
            up = minus | (~(diagonal | plus) & all_bits)
            down = plus & diagonal
            if up & top:
                score += 1
            elif down & top:
                score -= 1
            up = (up << 1) & all_bits | anchored
            down = (down << 1) & all_bits
            plus = down | (~(vertical | up) & all_bits)
            minus = up & vertical
            if score < best:
                best, end = score, at
        return best, end


class Matcher:
    """All items of one block, ready to search texts."""

    def __init__(self, items: list[tuple[int, str]], error_share: float) -> None:
        import ahocorasick

        self.items = {
            number: (item_id, text, budget_of(text, error_share))
            for number, (item_id, text) in enumerate(items)
        }
        places: dict[str, list[tuple[int, int]]] = {}
        for number, (_, text, budget) in self.items.items():
            for offset, piece in pieces_of(text, budget):
                places.setdefault(piece, []).append((number, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()
        self.patterns: dict[int, tuple[Pattern, Pattern]] = {}

    def matches(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of each item within its budget."""
        starts: dict[int, set[int]] = {}
        for last, (size, where) in self.automaton.iter(text):
            for number, offset in where:
                starts.setdefault(number, set()).add(last + 1 - size - offset)
        for number in sorted(starts):
            found = self._best(number, text, sorted(starts[number]))
            if found:
                yield self.items[number][0], *found

    def _best(self, number: int, text: str, starts: list[int]) -> tuple[int, int, int] | None:
        _, item, budget = self.items[number]
        if number not in self.patterns:
            self.patterns[number] = Pattern(item), Pattern(item[::-1])
        forward, backward = self.patterns[number]
        best: tuple[int, int, int] | None = None
        low = high = None
        # Places whose surroundings overlap are searched together.
        regions: list[tuple[int, int]] = []
        for start in starts:
            low, high = max(0, start - budget), min(len(text), start + len(item) + budget)
            if regions and low <= regions[-1][1]:
                regions[-1] = regions[-1][0], high
            else:
                regions.append((low, high))
        for low, high in regions:
            distance, end = forward.best_end(text[low:high])
            if distance <= budget and (best is None or distance < best[0]):
                _, back = backward.best_end(text[low : low + end][::-1], anchored=True)
                best = distance, low + end - back, low + end
        return best


def blocks_of(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items, in lower case and single-spaced, in blocks of about ``block_chars``."""
    items = benchmark.filter(F.col("text").rlike(r"\S")).select("item_id", "text")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // block_chars)
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, blocks))))
    for block in range(blocks):
        rows = dealt.filter(F.col("block") == block).select("item_id", "text").collect()
        found = [(r["item_id"], text) for r in rows if (text := normalised(r["text"]))]
        if found:
            yield sorted(found, key=lambda item: (item[0] is None, item[0] or 0, item[1]))


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    error_share: float = ERROR_SHARE,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``doc_id, item_id, distance, start, end`` for every item found in a document.

    An item of m characters may differ by ``int(m * error_share)`` edits. Offsets count
    code points of the lower-case, single-spaced text. One pass per block, no shuffle.
    """
    context = docs.sparkSession.sparkContext
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = f"doc_id {kinds['doc_id']}, item_id long, distance int, start int, end int"
    narrow = docs.select("doc_id", "text")

    def searched(block: list[tuple[int, str]]) -> DataFrame:
        shared = context.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, error_share)
            for batch in batches:
                ids, texts = batch.column(0), batch.column(1)
                rows, found = [], []
                for at, text in enumerate(texts):
                    for match in matcher.matches(normalised(text.as_py())):
                        rows.append(at)
                        found.append(match)
                columns = list(zip(*found, strict=True)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(rows, pa.int32())),
                        pa.array(columns[0], pa.int64()),
                        *[pa.array(c, pa.int32()) for c in columns[1:]],
                    ],
                    names=["doc_id", "item_id", "distance", "start", "end"],
                )

        return narrow.mapInArrow(search, schema)

    found = [searched(block) for block in blocks_of(benchmark, block_chars)]
    if not found:
        return docs.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.union, found)


def without_leaks(docs: DataFrame, leaks: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id no leak names; a row without doc_id stays.

    Leaks are few next to the documents; which join follows is left to their size.
    """
    ids = leaks.select("doc_id").filter(F.col("doc_id").isNotNull()).distinct()
    return docs.join(ids, "doc_id", "left_anti").select(*docs.columns)
