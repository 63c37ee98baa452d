"""Quality rules on repetition within a text: suffix arrays over words and their longest common prefixes."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.words import Texts, mix, shingles, span_hash, text_blocks

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
ROW = np.uint64(0x9FB21C651E98DF25)
RESULT = (
    "struct<n_words: long, word_chars: long, n_symbols: long, n_dup_lines: long, n_repeat_words: long, "
    "longest_repeat: long, n_repeat_spans: long, base_failed: boolean, kept: boolean>"
)


@dataclass(frozen=True)
class Limits:
    """least: words of the shortest repeat that counts. The base rule fails short texts and many repeat words; the
    verdict also limits the share of words in maximal repeats and the longest of them."""

    least: int = 8
    least_words: int = 20
    base_share: float = 0.30
    covered_share: float = 0.20
    longest: int = 100


def suffix_array(words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes of all texts in order, text by text, and the ranks by 1, 2, 4 ... words that led there.

    words are hashes, whose order serves as well as that of the words. A suffix ends with its text, so none of a text
    equals another and doubling ends when all ranks differ. Suffixes that are alone already aren't sorted again.
    """
    n = len(words)
    ends = np.searchsorted(rows, rows, "right")
    order = np.lexsort((words, rows))
    first = np.ones(n, bool)
    first[1:] = (words[order[1:]] != words[order[:-1]]) | (rows[order[1:]] != rows[order[:-1]])
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))  # place of the group's first suffix
    levels, step = [rank.copy()], 1
    while len(open_ := np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)):
        ahead = open_ + step
        then = np.where(ahead < ends[open_], rank[np.minimum(ahead, n - 1)], -1)
        by = np.lexsort((then, rank[open_]))
        at, group, then = open_[by], rank[open_][by], then[by]
        place = np.arange(len(at))
        new_group = np.concatenate([[True], group[1:] != group[:-1]])
        new_part = new_group | np.concatenate([[True], then[1:] != then[:-1]])
        base = np.maximum.accumulate(np.where(new_group, place, 0))
        rank[at] = group + np.maximum.accumulate(np.where(new_part, place, 0)) - base
        levels.append(rank.copy())
        step *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out, levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Words that each suffix shares with the one before it in the same text."""
    n = len(order)
    left, right = order[:-1], order[1:]
    shared = np.zeros(max(0, n - 1), np.int64)
    ends = np.searchsorted(rows, rows, "right")
    for level in range(len(levels) - 1, -1, -1):
        a, b = left + shared, right + shared
        inside = (rows[left] == rows[right]) & (a < ends[left]) & (b < ends[right])
        same = inside & (levels[level][np.where(inside, a, 0)] == levels[level][np.where(inside, b, 0)])
        shared += np.where(same, 1 << level, 0)
    return np.concatenate([np.zeros(min(n, 1), np.int64), shared])


def repeats(words: np.ndarray, rows: np.ndarray, n_rows: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: words covered by repeats of `least` words or more, words of the longest repeat, number of covered spans.

    An interval of the suffix array whose neighbours share a prefix is a repeat; the deepest interval around a suffix
    is the longest repeat that starts there. The union over all suffixes is that of all maximal repeats.
    Texts in which no `least` words occur twice are left out first.
    """
    covered, longest, count = (np.zeros(n_rows, np.int64) for _ in range(3))
    starts, at = shingles(words, rows, least)
    keys = np.sort(mix(starts ^ (rows[at].astype(np.uint64) * ROW)))
    twice = keys[1:][keys[1:] == keys[:-1]]
    if not len(twice):
        return covered, longest, count
    again = np.zeros(n_rows, bool)
    again[rows[at[np.isin(mix(starts ^ (rows[at].astype(np.uint64) * ROW)), twice)]]] = True
    words, rows = words[again[rows]], rows[again[rows]]
    order, levels = suffix_array(words, rows)
    lcp = common_prefixes(order, levels, rows)
    deep = np.maximum(lcp, np.append(lcp[1:], 0))
    long = deep >= least
    reach = np.zeros(len(words), np.int64)
    reach[order[long]] = order[long] + deep[long]
    begin = np.flatnonzero(reach)
    end = np.maximum.accumulate(reach[begin])
    before = np.concatenate([[0], end[:-1]])
    np.add.at(covered, rows[begin], end - np.maximum(begin, before))
    np.add.at(count, rows[begin[(begin > before) | (rows[begin] != rows[before - (before > 0)])]], 1)
    np.maximum.at(longest, rows[order[long]], deep[long])
    return covered, longest, count


def judge(texts: Texts, limits: Limits) -> dict[str, np.ndarray]:
    prefix = texts.prefix()
    begin, end, rows = texts.words()
    n_words = np.bincount(rows, minlength=texts.rows)
    points = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])
    word_chars = np.bincount(rows, points[end] - points[begin], texts.rows).astype(np.int64)
    low, high, line_rows = texts.lines()
    held = np.searchsorted(begin, high) > np.searchsorted(begin, low)  # lines with a word
    low, high, line_rows = low[held], high[held], line_rows[held]
    keys = mix(span_hash(prefix, low, high) ^ (line_rows.astype(np.uint64) * ROW))
    first = np.unique(keys, return_index=True)[1]
    n_dup_lines = np.bincount(line_rows, minlength=texts.rows) - np.bincount(line_rows[first], minlength=texts.rows)
    covered, longest, count = repeats(span_hash(prefix, begin, end), rows, texts.rows, limits.least)
    failed = (n_words < limits.least_words) | (covered > limits.base_share * n_words + 1e-9)
    kept = ~failed & (covered <= limits.covered_share * n_words + 1e-9) & (longest <= limits.longest)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": texts.totals(SYMBOLS[texts.data]),
        "n_dup_lines": n_dup_lines, "n_repeat_words": covered, "longest_repeat": longest, "n_repeat_spans": count,
        "base_failed": failed, "kept": kept,
    }


def with_repetition(docs: DataFrame, column: str = "repetition", limits: Limits = Limits()) -> DataFrame:
    """docs and one more column: what the whole text repeats within itself, and whether it passes.

    struct<n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, longest_repeat, n_repeat_spans, base_failed, kept>.
    Null and empty texts have no words, so they fail. Each row is judged by itself.
    """

    @F.arrow_udf(RESULT)
    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat", "n_repeat_spans", "base_failed", "kept"]
        for batch in batches:
            parts = [judge(t, limits) for t in text_blocks(batch)]
            columns = [np.concatenate([p[name] for p in parts]) if parts else np.zeros(0) for name in names]
            kinds = [pa.int64()] * 7 + [pa.bool_()] * 2
            yield pa.StructArray.from_arrays([pa.array(c.astype(bool) if k == pa.bool_() else c.astype(np.int64), k) for c, k in zip(columns, kinds, strict=True)], names)

    return docs.withColumn(column, measure.asNondeterministic()(F.col("text")))
