"""Benchmark decontamination: word n-grams seed passages, Smith-Waterman alignment scores them."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.licenses import word_hashes
from auditloom.llm.words import shingles, text_blocks

HITS = "doc_id long, item_id long, score double, first_word long, end_word long"
HITS_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64())])


@dataclass(frozen=True)
class LeakSettings:
    """seed_words: length of a seed. Every n-gram of an item is a seed, however many documents hold it.
    score: least alignment score per word of the item; a match counts 1, a wrong, missing or further word -1.
    block_chars: characters of benchmark items that are searched for at a time."""

    seed_words: int = 3
    score: float = 0.4
    block_chars: int = 4_000_000


@dataclass
class Items:
    """Items of one block, their distinct words in order, and their n-grams: sorted hashes, and for each the item and
    the place in it."""

    ids: list[int]
    words: list[np.ndarray]
    known: list[np.ndarray]
    grams: np.ndarray
    owner: np.ndarray
    place: np.ndarray


def prepare(rows: list[tuple[int, str]], seed_words: int) -> Items:
    words: list[np.ndarray] = []
    for block in text_blocks(pa.array([text for _, text in rows], pa.string())):
        hashes, owner = word_hashes(block)
        words += np.split(hashes, np.searchsorted(owner, np.arange(1, block.rows)))
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
    starts = np.cumsum([0, *map(len, words)])
    grams, at = shingles(np.concatenate([*words, np.zeros(0, np.uint64)]), owner, seed_words)
    order = np.argsort(grams, kind="stable")
    owner = owner[at[order]]
    return Items([i for i, _ in rows], words, [np.unique(w) for w in words], grams[order], owner, at[order] - starts[owner])


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of two word sequences: score, and begin and end in text (Smith-Waterman, whole matrix).

    A row of the matrix is made at once: a run of further words costs 1 each, so its best start is a running maximum.
    """
    n = len(text)
    column = np.arange(n + 1)
    score, start = np.zeros(n + 1, np.int64), column.copy()
    best = (0, 0, 0)
    wide = np.int64(n + 2)  # score and start in one number, so that both travel with the maximum
    for word in item:
        step = np.where(text == word, 1, -1)
        cells = np.full(n + 1, 0, np.int64) * wide + column
        diagonal = (score[:-1] + step) * wide + start[:-1]
        down = (score - 1) * wide + start
        cells[1:] = np.maximum(cells[1:], np.where(score[:-1] + step > 0, diagonal, 0))
        cells = np.maximum(cells, np.where(score > 1, down, 0))
        run = np.maximum.accumulate(cells + column * wide) - column * wide
        cells = np.where(run >= wide, np.maximum(run, cells), cells)
        score, start = cells // wide, np.where(cells >= wide, cells % wide, column)
        top = int(score.argmax())
        if score[top] > best[0]:
            best = (int(score[top]), int(start[top]), top)
    return best


def most_score(known: np.ndarray, part: np.ndarray) -> int:
    """No local alignment scores more: each text word in it brings 1 at most, and costs 1 if the item lacks it.

    known: the item's distinct words, sorted.
    """
    at = np.minimum(np.searchsorted(known, part), len(known) - 1)
    sums = np.zeros(len(part) + 1, np.int64)
    np.cumsum(np.where(known[at] == part, 1, -1), out=sums[1:])
    return int((sums - np.minimum.accumulate(sums)).max())


def windows(places: np.ndarray, offsets: np.ndarray, length: int, n_words: int) -> Iterator[tuple[int, int]]:
    """Stretches of a text that may hold an item, given the places of seeds in the text and in the item."""
    low = np.maximum(0, places - offsets - length)
    high = np.minimum(n_words, places - offsets + 2 * length)
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    cut = np.flatnonzero(np.concatenate([[True], low[1:] > high[:-1]]))
    yield from zip(low[cut].tolist(), high[np.append(cut[1:], len(low)) - 1].tolist(), strict=True)


def leaks(words: np.ndarray, rows: np.ndarray, items: Items, settings: LeakSettings) -> list[tuple[int, int, float, int, int]]:
    """(row, item number, score, first and end word) of each text and item that align well enough."""
    grams, at = shingles(words, rows, settings.seed_words)
    low = np.searchsorted(items.grams, grams, "left")
    some = np.flatnonzero((low < len(items.grams)) & (items.grams[np.minimum(low, len(items.grams) - 1)] == grams)) if len(items.grams) else low[:0]
    if not len(some):
        return []
    low = low[some]
    times = np.searchsorted(items.grams, grams[some], "right") - low
    entry = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    place, offset, item_of = at[np.repeat(some, times)], items.place[entry], items.owner[entry]
    row_of = rows[place]
    order = np.lexsort((item_of, row_of))
    place, offset, item_of, row_of = place[order], offset[order], item_of[order], row_of[order]
    cut = np.flatnonzero(np.concatenate([[True], (row_of[1:] != row_of[:-1]) | (item_of[1:] != item_of[:-1])]))
    first = np.searchsorted(rows, np.arange(rows[-1] + 2))
    out = []
    for low, high in zip(cut.tolist(), [*cut[1:].tolist(), len(order)], strict=True):
        row, item = row_of[low], item_of[low]
        text, wanted, known = words[first[row] : first[row + 1]], items.words[item], items.known[item]
        best = (0, 0, 0)
        for begin, end in windows(place[low:high] - first[row], offset[low:high], len(wanted), len(text)):
            part = text[begin:end]
            least = max(settings.score * len(wanted), best[0] + 1)
            # a score is at most the number of item words that occur here, too
            if most_score(known, part) < least or np.isin(wanted, part).sum() < least:
                continue
            got = align(wanted, part)
            if got[0] > best[0]:
                best = (got[0], begin + got[1], begin + got[2])
        if best[0] >= settings.score * len(wanted):
            out.append((int(row), int(item), best[0] / len(wanted), best[1], best[2]))
    return out


def item_blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about block_chars characters, each small enough for the driver and every task."""
    items = benchmark.select(F.col("item_id").cast("long"), F.lower("text").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    total = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    n = -(-total // block_chars)
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        yield sorted((r["item_id"], r["text"]) for r in rows)


def seeded_blocks(docs: DataFrame, benchmark: DataFrame, settings: LeakSettings) -> Iterator[Broadcast]:
    """The benchmark's items in blocks, each with all its n-grams as seeds."""
    for rows in item_blocks(benchmark, settings.block_chars):
        yield docs.sparkSession.sparkContext.broadcast(prepare(rows, settings.seed_words))


def lowered(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, settings: LeakSettings = LeakSettings()) -> DataFrame:
    """Documents that hold a benchmark item or an edited copy of it: doc_id, item_id, score, first_word, end_word.

    The benchmark is a stated query set: it is searched for in blocks, and each block passes over all documents once. A
    document that shares any n-gram with an item is aligned around it, unless a bound shows that the score stays below
    the limit; the bound never drops a pair that reaches it. Documents are never shuffled.
    score is the alignment score per word of the item; a row per input row and item at or above the limit. Words are
    runs of letters and digits in lower case. Null texts, and items of fewer words than a seed, match nothing.
    """
    texts = lowered(docs)
    found = docs.sparkSession.createDataFrame([], HITS)
    for seeds in seeded_blocks(docs, benchmark, settings):
        found = found.unionByName(texts.mapInArrow(_aligner(seeds, settings), HITS))
    return found


def _holds_item(seeds: Broadcast, settings: LeakSettings):
    """A column function: does a text in lower case hold an item of the block?"""

    @F.arrow_udf("boolean")
    def leaked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = np.zeros(len(batch), bool)
            for block in text_blocks(batch):
                words, rows = word_hashes(block)
                if len(words):
                    out[[block.first + r for r, *_ in leaks(words, rows, seeds.value, settings)]] = True
            yield pa.array(out, pa.bool_())

    return leaked.asNondeterministic()


def without_leaks(docs: DataFrame, benchmark: DataFrame, settings: LeakSettings = LeakSettings()) -> DataFrame:
    """The rows of docs, with all their columns, in which find_leaks finds no item."""
    blocks = list(seeded_blocks(docs, benchmark, settings))
    for seeds in blocks:
        docs = docs.where(~_holds_item(seeds, settings)(F.lower("text")))
    return docs


def _aligner(shared, settings: LeakSettings):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        for batch in batches:
            ids = batch.column(0)
            out = []
            for block in text_blocks(batch.column(1)):
                words, rows = word_hashes(block)
                if len(words):
                    out += [(ids[block.first + r].as_py(), items.ids[i], *rest) for r, i, *rest in leaks(words, rows, items, settings)]
            frame = pd.DataFrame(out, columns=HITS_ARROW.names, dtype=object)
            yield pa.RecordBatch.from_pandas(frame, HITS_ARROW, preserve_index=False)

    return search
