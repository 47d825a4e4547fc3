"""Katz backoff scores of documents, with counts from the whole training part.

Seen n-grams keep a Good-Turing discounted share of their context's count; what the
discounts leave goes to the unseen ones by the next lower order, times a backoff weight
that makes every context's probabilities add up to one exactly. A token is evaluated
recursively: its n-gram if seen, else the weight of its context times the value of the
order below, down to single words, where all unseen words are one class.

A corpus has nearly as many different n-grams as tokens, and each count is needed in many
documents, so rows of (n-gram, document) would be several times the input. Documents are
packed into blocks of about a million tokens instead. A block sends each distinct n-gram
once, as sorted arrays of 64-bit hashes cut by key range; a key range adds up what all
blocks sent and answers each block in its own order, so answers carry no keys. A hot
n-gram is one entry per block. Answers are kept as partitioned tables in the shared
folder: counts per order, and backoff weights per context. From order 3 on, an n-gram whose
context or last words no other block has is counted where it stands. A context that a single
block has gets its weight there; of the others, those go through the key ranges whose weight
can matter, and a block is answered those that its own tokens use. Arrays are stored and travel
packed: sorted keys as differences, and the bytes of all values by place.

A null text is empty: one end token. A row without doc_id is a training row. Repeated
rows count and are scored each. Without training rows every word is unseen and has
probability one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplytic.llm.common import (
    discard,
    mixed,
    release_shuffles,
    split_words,
    stored,
    word_hashes,
)
from shoplytic.session import checkpoint_folder

ORDER = 2
BLOCK_TOKENS = 1 << 20
# Texts are split into words in slices of about so many bytes.
SLICE_BYTES = 8 << 20
RANGE_TOKENS = 1 << 21
# What was sent is added up in so many turns; shuffle files of one are gone before the next.
# Blocks meet their answers in as many.
TURNS = 2
# Counts above this are trusted as they are.
LAST_DISCOUNTED = 5
START, END = np.uint64(1), np.uint64(2)
# Whether a context is in one block only, or in several and then whether its weight can matter.
LOCAL, UNASKED, ASKED = 0, 1, 2


def is_training(doc_id: str = "doc_id"):
    """All but the documents whose crc32 of the id leaves 1 modulo 5."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 != 1


def token_blocks(docs: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per block: its documents, and their tokens as numbers into ``words``.

    Every text begins with a start mark and ends with an end token. ``words`` are hashes,
    the block's most frequent first, so the numbers are small and compress well. Block
    numbers come from the task; the table must be stored before it is read twice.
    """
    kind = dict(docs.dtypes)["doc_id"]
    schema = (
        f"block long, doc_ids array<{kind}>, training array<boolean>, sizes array<int>, "
        "tokens array<int>, words array<long>"
    )

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            sizes, hashes = _hashed(batch.column("text"))
            sizes += 2
            before = np.concatenate([[0], np.cumsum(sizes)])
            sequence = np.empty(before[-1], dtype=np.uint64)
            marks = np.ones(len(sequence), dtype=bool)
            marks[before[:-1]] = marks[before[1:] - 1] = False
            sequence[marks] = hashes
            sequence[before[:-1]], sequence[before[1:] - 1] = START, END
            low = 0
            while low < len(sizes):
                high = max(
                    low + 1, int(np.searchsorted(before, before[low] + block_tokens, "right")) - 1
                )
                words, index, counts = np.unique(
                    sequence[before[low] : before[high]], return_inverse=True, return_counts=True
                )
                by_count = np.argsort(-counts, kind="stable")
                place = np.empty(len(words), dtype=np.int32)
                place[by_count] = np.arange(len(words), dtype=np.int32)
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": pa.array([number], pa.int64()),
                        "doc_ids": _one_list(part.column("doc_id")),
                        "training": _one_list(part.column("training")),
                        "sizes": _one_list(pa.array(sizes[low:high], pa.int32())),
                        "tokens": _one_list(pa.array(place[index])),
                        "words": _one_list(pa.array(words[by_count].view(np.int64))),
                    }
                )
                number, low = number + 1, high

    return docs.select("doc_id", "text", is_training().alias("training")).mapInArrow(
        packed, schema
    )


def _give_back() -> None:
    """Return freed memory to the machine: a worker that waits for its next task holds none."""
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()


def _tidily(work: Callable[..., pa.Table], *tables: pa.Table) -> pa.Table:
    found = work(*tables)
    _give_back()
    return found


def _hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """How many words each text has, and the hashes of all, from one slice after the other."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    slices = np.cumsum(lengths, dtype=np.int64) // SLICE_BYTES
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(slices)) + 1, [len(texts)]])
    sizes, hashes = [], []
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        starts, flat = split_words(pc.ascii_lower(texts.slice(low, high - low)))
        sizes.append(np.diff(starts))
        hashes.append(word_hashes(flat))
        del flat
        _give_back()
    return np.concatenate(sizes), np.concatenate(hashes)


def _one_list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _packed(values: np.ndarray) -> bytes:
    """Numbers in few bytes: the first bytes of all, then the second ones, compressed.

    Places after the last that any number has a bit in are left out.
    """
    values = np.ascontiguousarray(values)
    width = values.itemsize
    highest = int(values.view(f"u{width}").max()) if len(values) else 0
    used = -(-highest.bit_length() // 8)
    places = values.view(np.uint8).reshape(-1, width).T[:used]
    squeezed = pa.compress(places.tobytes(), codec="zstd", asbytes=True)
    return len(values).to_bytes(4, "little") + bytes([used]) + squeezed


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    size, used = int.from_bytes(data[:4], "little"), data[4]
    values = np.zeros((size, np.dtype(kind).itemsize), np.uint8)
    if used:
        places = pa.decompress(memoryview(data)[5:], size * used, codec="zstd", asbytes=True)
        values[:, :used] = np.frombuffer(places, np.uint8).reshape(used, size).T
    return values.reshape(-1).view(kind)


def _joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """The packed arrays of all rows on end; null counts as empty."""
    parts = [_unpacked(data, kind) for data in column.to_pylist() if data is not None]
    return np.concatenate(parts) if parts else np.empty(0, kind)


def _joined_keys(column: pa.ChunkedArray) -> np.ndarray:
    parts = [np.cumsum(_unpacked(data, np.uint64)) for data in column.to_pylist()]
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def _carried(table: DataFrame, **kinds: type) -> DataFrame:
    """``table`` with the arrays named in ``kinds`` packed, before it is stored."""
    schema = ", ".join(
        f"`{name}` {'binary' if name in kinds else kind}" for name, kind in table.dtypes
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A block is large: its rows go on one by one.
            for row in (batch.slice(i, 1) for i in range(len(batch))):
                columns = dict(zip(row.schema.names, row.columns, strict=True))
                for name, kind in kinds.items():
                    cell = columns[name][0]
                    data = None
                    if cell.is_valid:
                        values = cell.values.to_numpy(zero_copy_only=False)
                        if name == "words":  # ascending among equally frequent ones
                            values = np.diff(values, prepend=np.int64(0))
                        data = _packed(values.astype(kind, copy=False))
                    columns[name] = pa.array([data], pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    return table.mapInArrow(pack, schema)


def _sorting(keys: np.ndarray) -> np.ndarray:
    """The order that sorts hashes, of equal ones the first first.

    The leading bits in which hashes differ are sorted with the places in the low bits,
    several times as fast as places by keys. The few runs with different hashes that agree in
    these bits are sorted once more.
    """
    if len(keys) < 2:
        return np.arange(len(keys))
    bits = np.uint64((len(keys) - 1).bit_length())
    alike = np.uint64(64 - int(keys.min() ^ keys.max()).bit_length())
    if alike == 64:
        return np.arange(len(keys))
    packed = (keys << alike) >> bits << bits
    packed |= np.arange(len(keys), dtype=np.uint64)
    packed.sort()
    order = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    ordered = keys[order]
    wrong = np.flatnonzero(ordered[1:] < ordered[:-1])
    if len(wrong) > 1000:
        return np.argsort(keys, kind="stable")
    leading = packed >> bits
    for head in np.unique(leading[wrong]):
        run = slice(np.searchsorted(leading, head), np.searchsorted(leading, head, "right"))
        order[run] = order[run][np.argsort(keys[order[run]], kind="stable")]
    return order


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct keys, the first place of each, and which of them each key is."""
    order = _sorting(keys)
    ordered = keys[order]
    new = np.ones(len(keys), dtype=bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    kind = np.int32 if len(keys) < 1 << 31 else np.int64
    index = np.empty(len(keys), dtype=kind)
    index[order] = np.cumsum(new, dtype=kind) - kind(1)
    return ordered[new], order[new], index


@dataclass
class Grams:
    """The n-grams of one order in a block; entry i of a token array is token i's."""

    valid: np.ndarray
    distinct: np.ndarray  # sorted
    first: np.ndarray  # a token that ends each distinct n-gram
    index: np.ndarray  # of the tokens among the distinct ones, -1 where not valid
    trained: np.ndarray  # how often each distinct one is in the block's training part
    held: np.ndarray  # whether each distinct one is in the block's other part


class Block:
    """One row of ``token_blocks`` with its n-grams of every order up to ``order``."""

    def __init__(self, row: dict, order: int) -> None:
        self.sizes = row["sizes"]
        self.training = np.repeat(row["training"], self.sizes)
        words = row["words"].view(np.uint64)
        starts = np.cumsum(self.sizes) - self.sizes
        self.scored = np.ones(len(self.training), dtype=bool)
        self.scored[starts] = False
        self.levels: list[Grams] = [self._words(words, row["tokens"])]
        if order == 1:
            return
        keys = words[row["tokens"]]
        spread, valid = mixed(words)[row["tokens"]], self.scored
        for level in range(2, order + 1):
            shifted = np.concatenate([keys[:1], keys[:-1]])
            shifted *= np.uint64(0x9FB21C651E98DF25)
            shifted ^= spread
            keys = mixed(shifted)
            if level > 2:
                # The token before must end an n-gram that is one shorter.
                valid = valid & np.concatenate([[False], valid[:-1]])
            self.levels.append(self._grams(keys, valid))

    def _words(self, words: np.ndarray, tokens: np.ndarray) -> Grams:
        order = np.argsort(words)
        rank = np.empty(len(words), dtype=np.int32)
        rank[order] = np.arange(len(words), dtype=np.int32)
        index = rank[tokens]
        first = np.empty(len(words), dtype=np.int64)
        first[index] = np.arange(len(index))
        return self._counted(np.ones(len(index), dtype=bool), words[order], first, index, index)

    def _grams(self, keys: np.ndarray, valid: np.ndarray) -> Grams:
        at = np.flatnonzero(valid)
        distinct, first, inverse = _distinct(keys[at])
        index = np.full(len(keys), -1, dtype=inverse.dtype)
        index[at] = inverse
        return self._counted(valid, distinct, at[first], index, inverse)

    def _counted(
        self,
        valid: np.ndarray,
        distinct: np.ndarray,
        first: np.ndarray,
        index: np.ndarray,
        inverse: np.ndarray,
    ) -> Grams:
        training = self.training[valid]
        trained = np.bincount(inverse[training], minlength=len(distinct)).astype(np.int32)
        held = np.zeros(len(distinct), dtype=bool)
        held[inverse[~training]] = True
        return Grams(valid, distinct, first, index, trained, held)


# Arrays of a block that are packed on the way, and those of an answer.
CARRIED = {"tokens": np.int32, "words": np.int64}
ANSWERED = {"counts": np.int64, "owned": np.uint8, "asked": np.uint8, "weights": np.float64}


def _blocks_of(table: pa.Table, order: int) -> Iterator[tuple[int, Block, pa.Table]]:
    for i in range(len(table)):
        row = {}
        for name, kind in {"training": bool, "sizes": np.int32, **CARRIED}.items():
            cell = table.column(name)[i]
            if pa.types.is_list(cell.type):
                row[name] = cell.values.to_numpy(zero_copy_only=False)
            else:
                row[name] = _unpacked(cell.as_py(), kind)
                if name == "words":
                    row[name] = np.cumsum(row[name])
        yield table.column("block")[i].as_py(), Block(row, order), table.slice(i, 1)


def _by_range(distinct: np.ndarray, ranges: int) -> np.ndarray:
    """Where each key range begins in sorted keys; ``ranges`` is a power of two."""
    bits = ranges.bit_length() - 1
    numbers = distinct >> np.uint64(64 - bits) if bits else np.zeros(len(distinct), np.uint64)
    return np.searchsorted(numbers, np.arange(ranges + 1, dtype=np.uint64))


def _pieces(block: int, ranges: int, distinct: np.ndarray, **columns: np.ndarray) -> pa.Table:
    """One row per key range that the block has keys of."""
    cuts = _by_range(distinct, ranges)
    used = np.flatnonzero(np.diff(cuts))
    parts = [slice(cuts[i], cuts[i + 1]) for i in used]
    keys = [_packed(np.diff(distinct[part], prepend=np.uint64(0))) for part in parts]
    return pa.table(
        {
            "range": pa.array(used, pa.int32()),
            "block": pa.array(np.full(len(used), block), pa.int64()),
            "size": pa.array(np.diff(cuts)[used], pa.int32()),
            "keys": pa.array(keys, pa.binary()),
            **{
                n: pa.array([_packed(values[part]) for part in parts], pa.binary())
                for n, values in columns.items()
            },
        }
    )


def _as_sent(
    table: pa.Table, sizes: np.ndarray, packed: bool, answers: dict[str, np.ndarray]
) -> pa.Table:
    """The answers, cut into a list of its size for each row that was sent."""
    ends = np.cumsum(sizes)

    def cut(values: np.ndarray, kind: type) -> pa.Array:
        if packed:
            values = values.astype(kind, copy=False)
            parts = zip(ends - sizes, ends, strict=True)
            return pa.array([_packed(values[low:high]) for low, high in parts], pa.binary())
        offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(values))

    return pa.table(
        {
            "block": table.column("block"),
            "range": table.column("range"),
            **{name: cut(values, ANSWERED[name]) for name, values in answers.items()},
        }
    )


def count_kind(tokens: int) -> str:
    """The narrowest type for counts of ``tokens`` tokens."""
    return "int" if tokens < 1 << 31 else "long"


def gram_counts(
    blocks: DataFrame, level: int, ranges: int, kind: str = "long", packed: bool = False
) -> DataFrame:
    """``block, range, counts, owned, asked``: training counts of a block's distinct n-grams.

    Every n-gram is owned by one of the blocks that have it, so sums over owned ones
    take each n-gram once. ``asked`` says of an n-gram as a context whether it is LOCAL, or
    else whether its weight can matter: it stands in a text to be scored that is no training
    text, or so often in training that all that follow it may be undiscounted. ``kind`` is
    the type of the counts; ``packed`` ones, like the other arrays, are bytes.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, block, _ in _blocks_of(pa.Table.from_batches([batch]), level):
                sent = _sent_grams(number, ranges, block.levels[level - 1])
                del block
                _give_back()
                yield from sent.to_batches()

    sent = blocks.mapInArrow(send, "range int, block long, size int, keys binary, seen binary")
    return _added_up(sent, kind, packed)


def _sent_grams(
    number: int, ranges: int, grams: Grams, which: np.ndarray | slice = slice(None)
) -> pa.Table:
    seen = 2 * grams.trained[which] + grams.held[which]
    return _pieces(number, ranges, grams.distinct[which], seen=seen.astype(np.int32))


def _added_up(sent: DataFrame, kind: str, packed: bool) -> DataFrame:
    """The answers to the n-grams that blocks sent."""
    number = np.int32 if kind == "int" else np.int64

    def add_up(table: pa.Table) -> pa.Table:
        keys, seen = _joined_keys(table.column("keys")), _joined(table.column("seen"), np.int32)
        _, first, index = _distinct(keys)
        size = len(first)
        totals = np.bincount(index, weights=seen >> 1, minlength=size).astype(number)
        held = np.bincount(index, weights=seen & 1, minlength=size) > 0
        shared = np.bincount(index, minlength=size) > 1
        asked = np.where(shared, UNASKED, LOCAL).astype(np.int8)
        asked[shared & (held | (totals > LAST_DISCOUNTED))] = ASKED
        owned = np.zeros(len(keys), dtype=bool)
        owned[first] = True
        sizes = table.column("size").to_numpy()
        answers = {"counts": totals[index], "owned": owned, "asked": asked[index]}
        return _as_sent(table, sizes, packed, answers)

    arrays = f"counts array<{kind}>, owned array<boolean>, asked array<tinyint>"
    if packed:
        arrays = "counts binary, owned binary, asked binary"
    return sent.groupBy("range").applyInArrow(
        lambda table: _tidily(add_up, table), f"block long, range int, {arrays}"
    )


@dataclass(frozen=True)
class Statistics:
    """What an order's distinct n-grams come to in training."""

    tokens: int
    types: int
    of_count: tuple[int, ...]  # how many n-grams have count 1, 2, ...

    def discounts(self) -> np.ndarray:
        """The factor d for counts 0..LAST_DISCOUNTED + 1; that of 0 is not used.

        Good-Turing with Katz's cutoff. Where the counts of counts are too thin for it,
        half a count is taken off instead.
        """
        n = (0, *self.of_count)
        last = LAST_DISCOUNTED
        factors = np.ones(last + 2)
        cut = (last + 1) * n[last + 1] / n[1] if n[1] else 1.0
        for c in range(1, last + 1):
            turing = (c + 1) * n[c + 1] / (c * n[c]) if n[c] else 0.0
            d = (turing - cut) / (1 - cut) if cut < 1 else 0.0
            factors[c] = d if 0 < d < 1 else (c - 0.5) / c
        return factors


def _tally(counts: np.ndarray) -> np.ndarray:
    """Tokens, types, and how many n-grams have count 1, 2, ..."""
    width, seen = LAST_DISCOUNTED + 1, counts[counts > 0]
    small = np.bincount(seen[seen <= width], minlength=width + 1)[1:]
    return np.array([seen.sum(), len(seen), *small], dtype=np.int64)


def statistics(
    counts: DataFrame, blocks: DataFrame, level: int, alone: DataFrame | None = None
) -> Statistics:
    """Sums over the owned n-grams of packed ``counts``; the start mark is no word.

    ``alone`` has the tallies of n-grams that were counted where they stand.
    """
    width = LAST_DISCOUNTED + 1

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.zeros(width + 2, dtype=np.int64)
            for i in range(len(batch)):
                values, owned = (
                    _unpacked(batch.column(name)[i].as_py(), ANSWERED[name])
                    for name in ("counts", "owned")
                )
                sums += _tally(values[owned.view(bool)])
            _give_back()
            yield pa.RecordBatch.from_pydict({"tally": _one_list(pa.array(sums))})

    parts = counts.select("counts", "owned").mapInArrow(tally, "tally array<long>")
    if alone is not None:
        parts = parts.union(alone)
    row = parts.agg(*[F.sum(F.col("tally")[i]) for i in range(width + 2)]).first()
    tokens, types, *small = [int(value or 0) for value in row]
    if level == 1:
        texts = F.size(F.filter("training", lambda t: t))
        starts = int(blocks.agg(F.sum(texts)).first()[0] or 0)
        tokens, types = tokens - starts, types - (starts > 0)
        if 0 < starts <= width:
            small[starts - 1] -= 1
    return Statistics(tokens, types, tuple(small))


def _placed(answers: np.ndarray, sent: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """What was answered where it was sent, else ``alone``; as it is if it didn't come along."""
    if len(answers) != np.count_nonzero(sent):
        return answers
    whole = alone.astype(answers.dtype)
    whole[sent] = answers
    return whole


class Model:
    """The counts and weights that one block was answered, ready to evaluate its tokens."""

    def __init__(self, block: Block, answers: pa.Table, stats: list[Statistics]) -> None:
        self.block, self.stats = block, stats
        self.counts, self.owned, self.asked, self.weights = [], [], [], []
        levels = answers.column("level").to_numpy()
        ranges = answers.column("range").to_numpy()

        def answered(level: int, name: str) -> np.ndarray:
            own = np.flatnonzero(levels == level)
            part = answers.take(pa.array(own[np.argsort(ranges[own])]))
            return _joined(part.column(name), ANSWERED[name])

        for level in range(1, len(stats) + 1):
            counts, asked = answered(level, "counts"), answered(level, "asked")
            # Only the order whose weights are looked for comes with its owners.
            owned = answered(level, "owned").view(bool)
            if level > 2:
                sent, grams = self.sent(level), block.levels[level - 1]
                counts = _placed(counts, sent, grams.trained)
                owned = _placed(owned, sent, np.ones(len(sent), dtype=bool))
                asked = _placed(asked, sent, np.full(len(sent), LOCAL))
            self.counts.append(counts)
            self.owned.append(owned)
            self.asked.append(asked)
            self.weights.append(answered(-level, "weights"))

    def sent(self, level: int) -> np.ndarray:
        """Which n-grams of an order above 2 other blocks may have.

        Where the context or the last words are in no other block, the n-gram isn't either.
        """
        grams, lower = self.block.levels[level - 1], self.block.levels[level - 2]
        shared = self.asked[level - 2] != LOCAL
        return shared[lower.index[grams.first - 1]] & shared[lower.index[grams.first]]

    def discounted(self, level: int) -> np.ndarray:
        """d * c of every distinct n-gram."""
        counts = self.counts[level - 1]
        factors = self.stats[level - 1].discounts()
        return counts * factors[np.minimum(counts, len(factors) - 1)]

    def words(self) -> np.ndarray:
        """The probability of each token as a word by itself."""
        stats = self.stats[0]
        small = np.arange(1, LAST_DISCOUNTED + 2) * stats.of_count
        factors = stats.discounts()[1:]
        seen = stats.tokens - float((small * (1 - factors)).sum())
        # If no count was discounted, one is added so that unseen words keep a share.
        total = stats.tokens if seen < stats.tokens else stats.tokens + 1
        chance = np.where(self.counts[0] > 0, self.discounted(1) / total, 1 - seen / total)
        return chance[self.block.levels[0].index]

    def probabilities(self, level: int) -> np.ndarray:
        """Of each token after up to ``level - 1`` tokens; unset for start marks."""
        if level == 1:
            return self.words()
        below = self.probabilities(level - 1)
        grams, context = self.block.levels[level - 1], self.block.levels[level - 2]
        at = np.flatnonzero(grams.valid)
        before = context.index[at - 1]
        weight = self._context_weights(level, below)[before]
        times = self.counts[level - 2][before]
        count = self.counts[level - 1][grams.index[at]]
        # A negative weight says that the context's count was raised by one.
        total = np.maximum(times + (weight < 0), 1)
        seen = self.discounted(level)[grams.index[at]] / total
        backed_off = np.where(times > 0, np.abs(weight), 1.0) * below[at]
        result = below.copy()
        result[at] = np.where(count > 0, seen, backed_off)
        return result

    def _context_weights(self, level: int, below: np.ndarray) -> np.ndarray:
        """The weight of every context: those used as answered, local ones from here."""
        asked = self.asked[level - 2]
        weights = np.ones(len(asked))
        weights[self.used(level)] = self.weights[level - 1]
        # No other block has n-grams that begin with a local context.
        mass, lower = self._sums(level, below, self.counts[level - 1] > 0)
        local = asked == LOCAL
        times = self.counts[level - 2][local].astype(np.float64)
        weights[local] = backed_off_share(times, mass[local], lower[local])
        return weights

    def used(self, level: int) -> np.ndarray:
        """The shared contexts whose weight an n-gram of this block needs.

        It is unseen, or nothing that follows here shows that a discount was taken, so that
        the context's count may have been raised.
        """
        grams, context = self.block.levels[level - 1], self.block.levels[level - 2]
        before, size = context.index[grams.first - 1], len(context.distinct)
        counts, times = self.counts[level - 1], self.counts[level - 2]
        unseen = np.bincount(before[counts == 0], minlength=size) > 0
        taken = np.bincount(before, weights=counts - self.discounted(level), minlength=size)
        raisable = (np.bincount(before, minlength=size) > 0) & (taken <= 1e-9 * times)
        return (self.asked[level - 2] == ASKED) & (times > 0) & (unseen | raisable)

    def context_sums(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Per context of this block: discounted counts and lower-order chances, of owned."""
        own = self.owned[level - 1] & (self.counts[level - 1] > 0)
        return self._sums(level, self.probabilities(level - 1), own)

    def _sums(
        self, level: int, below: np.ndarray, own: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        grams, context = self.block.levels[level - 1], self.block.levels[level - 2]
        last = grams.first[own]
        before = context.index[last - 1]
        size = len(context.distinct)
        mass = np.bincount(before, weights=self.discounted(level)[own], minlength=size)
        lower = np.bincount(before, weights=below[last], minlength=size)
        return mass, lower


def backed_off_share(times: np.ndarray, mass: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """(1 - seen share) / (1 - lower-order chances of the seen), so that both add up to one.

    It is negative where the context's count had to be raised by one because no discount
    left anything to the unseen.
    """
    raised = (times > 0) & (mass >= times * (1 - 1e-12))
    left = 1 - mass / np.maximum(times + raised, 1)
    weights = left / np.maximum(1 - lower, 1e-12)
    return np.where(raised, -weights, weights)


# What blocks send once they were answered: sums for the weights of order k at level -k, n-grams
# of the next order, and at range -1 the tally of those that are counted where they stand.
EXCHANGED = (
    "level int, range int, block long, size int, keys binary, seen binary, times binary, "
    "mass binary, lower binary, used binary, tally array<long>"
)


def exchanged(
    blocks: DataFrame,
    answers: DataFrame,
    stats: list[Statistics],
    level: int,
    ranges: int,
    last: bool = True,
) -> DataFrame:
    """What blocks send for the weights of order ``level``; unless ``last``, n-grams as well."""
    top = level if last else level + 1
    empty = _nothing(EXCHANGED)

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [empty]
        for number, block, _ in _blocks_of(left, top):
            model = Model(block, right, stats)
            mass, lower = model.context_sums(level)
            used = model.used(level)
            # Without a share in the sums and without use for the weight, nothing is sent.
            sent = used | ((model.asked[level - 2] == ASKED) & (mass > 0))
            sums = _pieces(
                number, ranges, block.levels[level - 2].distinct[sent],
                times=model.counts[level - 2][sent], mass=mass[sent], lower=lower[sent],
                used=used[sent],
            )
            parts.append(_at_level(sums, -level))
            if not last:
                grams, sent = block.levels[level], model.sent(level + 1)
                parts.append(_at_level(_sent_grams(number, ranges, grams, sent), level + 1))
                tally = _one_list(pa.array(_tally(grams.trained[~sent])))
                alone = pa.table({"range": pa.array([-1], pa.int32()), "tally": tally})
                parts.append(_at_level(alone, level + 1))
        return pa.concat_tables(parts, promote_options="default")

    return _meeting(blocks, answers).applyInArrow(
        lambda left, right: _tidily(send, left, right), EXCHANGED
    )


def _at_level(table: pa.Table, level: int) -> pa.Table:
    return table.append_column("level", pa.array(np.full(len(table), level), pa.int32()))


def backoff_weights(sent: DataFrame, level: int) -> DataFrame:
    """``block, range, weights`` (packed) of the contexts a block uses, for order ``level``."""

    def add_up(table: pa.Table) -> pa.Table:
        _, first, index = _distinct(_joined_keys(table.column("keys")))
        size = len(first)
        mass = _joined(table.column("mass"), np.float64)
        mass = np.bincount(index, weights=mass, minlength=size)
        lower = _joined(table.column("lower"), np.float64)
        lower = np.bincount(index, weights=lower, minlength=size)
        times = _joined(table.column("times"), np.int64)[first].astype(np.float64)
        used = _joined(table.column("used"), np.uint8).view(bool)
        before = np.concatenate([[0], np.cumsum(used)])
        ends = np.cumsum(table.column("size").to_numpy())
        sizes = np.diff(before[ends], prepend=0)
        weights = backed_off_share(times, mass, lower)[index[used]]
        return _as_sent(table, sizes, True, {"weights": weights})

    sums = sent.filter(F.col("level") == -level)
    return (
        sums.select("range", "block", "size", "keys", "times", "mass", "lower", "used")
        .groupBy("range")
        .applyInArrow(
            lambda table: _tidily(add_up, table), "block long, range int, weights binary"
        )
    )


def _meeting(blocks: DataFrame, answers: DataFrame):
    """Each block with what it was answered."""
    return blocks.groupBy("block").cogroup(answers.groupBy("block"))


def _nothing(schema: str) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema)).empty_table()


def _answers(
    counts: list[DataFrame],
    weights: list[DataFrame],
    owned: int | None = None,
    order: int | None = None,
) -> DataFrame:
    """All answers so far as one frame; level -k has the weights of n-grams of order k.

    Owners are moved only for the order ``owned``, and what is asked for below the last
    ``order``, which is that of the last counts unless given.
    """
    none = {n: kind for n, kind in counts[0].dtypes if n in ANSWERED}
    none["weights"] = "binary" if none["counts"] == "binary" else "array<double>"

    def whole(table: DataFrame, level: int) -> DataFrame:
        columns = [
            F.col(n)
            if n in table.columns
            and (n != "owned" or level == owned)
            and (n != "asked" or level < (order or len(counts)))
            else F.lit(None).cast(kind).alias(n)
            for n, kind in none.items()
        ]
        return table.select("block", "range", F.lit(level).alias("level"), *columns)

    tables = [(t, level) for level, t in enumerate(counts, 1)]
    tables += [(t, -level) for level, t in enumerate(weights, 2)]
    return reduce(DataFrame.union, [whole(*table) for table in tables])


def _turns(column: str) -> list[Column]:
    """Conditions of which every row meets one, by its block or key range."""
    return [F.pmod(F.xxhash64(column), F.lit(TURNS)) == i for i in range(TURNS)]


def _stored_in_turns(spark: SparkSession, frames: Iterator[DataFrame], name: str) -> DataFrame:
    """The frames as one ``stored`` table; after each, its shuffle files are deleted."""
    path = f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for frame in frames:
        frame.write.parquet(path, mode="append", compression="zstd")
        schema = frame.schema
        del frame
        release_shuffles(spark)
    return spark.read.schema(schema).parquet(path)


def score_documents(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row.

    ``base_score`` is the smoothed unigram score, ``score`` the Katz model's; both are
    sums of log10 over the words and one end token.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    blocks = stored(_carried(token_blocks(docs), **CARRIED), "token-blocks", "zstd")
    tokens = blocks.select(F.explode("sizes").alias("size")).agg(F.sum("size")).first()[0] or 0
    ranges = 1 << max(3, (int(tokens) // RANGE_TOKENS).bit_length())
    number = count_kind(int(tokens))
    counts, weights, stats = [], [], []

    for level in range(1, min(order, 2) + 1):
        found = gram_counts(blocks, level, ranges, number, True)
        counts.append(stored(found, f"counts-{level}", "zstd"))
        release_shuffles(spark)
        stats.append(statistics(counts[-1], blocks, level))
    for level in range(2, order + 1):
        answers = _answers(counts, weights, level, order)
        # Stored, so that the blocks' shuffle is gone before the sums are shuffled.
        turns = (
            exchanged(blocks.filter(turn), answers.filter(turn), stats, level, ranges, level == order)
            for turn in _turns("block")
        )
        sent = _stored_in_turns(spark, turns, f"sums-{level}")
        turns = (backoff_weights(sent.filter(turn), level) for turn in _turns("range"))
        weights.append(_stored_in_turns(spark, turns, f"weights-{level}"))
        if level < order:
            grams = sent.filter(F.col("level") > 0)
            more = grams.filter(F.col("range") >= 0)
            more = more.select("range", "block", "size", "keys", "seen")
            turns = (_added_up(more.filter(turn), number, True) for turn in _turns("range"))
            counts.append(_stored_in_turns(spark, turns, f"counts-{level + 1}"))
            alone = grams.filter(F.col("range") < 0).select("tally")
            stats.append(statistics(counts[-1], blocks, level + 1, alone))
        discard(sent)

    def evaluate(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [
            _scored(block, Model(block, right, stats), row, order)
            for _, block, row in _blocks_of(left, order)
        ]
        return pa.concat_tables(parts) if parts else _nothing(schema)

    schema = (
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double"
    )
    answers = _answers(counts, weights)
    return _meeting(blocks, answers).applyInArrow(
        lambda left, right: _tidily(evaluate, left, right), schema
    )


def _scored(block: Block, model: Model, row: pa.Table, order: int) -> pa.Table:
    """The result rows of one block."""
    stats = model.stats[0]
    count = model.counts[0][block.levels[0].index]
    base = np.log10((count + 0.5) / (stats.tokens + 0.5 * (stats.types + 1)))
    katz = np.log10(np.maximum(model.probabilities(order), np.finfo(np.float64).tiny))
    starts = np.cumsum(block.sizes) - block.sizes

    def summed(values: np.ndarray) -> np.ndarray:
        values = np.where(block.scored, values, 0)
        return np.add.reduceat(values, starts)

    training = row.column("training").combine_chunks().flatten()
    size = len(block.sizes)
    return pa.table(
        {
            "doc_id": row.column("doc_ids").combine_chunks().flatten(),
            "held_out": pc.invert(training),
            "n_tokens": pa.array(block.sizes.astype(np.int64) - 1),
            "n_known": pa.array(summed((count > 0).astype(np.int64))),
            "train_tokens": pa.array(np.full(size, stats.tokens, dtype=np.int64)),
            "base_score": pa.array(summed(base)),
            "score": pa.array(summed(katz)),
        }
    )
