"""Ranked lexical search: dense tiles of item weights times dense tiles of document impacts, by BLAS, in whole numbers."""

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from auditloom.llm.words import ALNUM, Texts, text_blocks

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
EXACT = 1 << 53  # whole numbers below this add up exactly in float64
MOST_IMPACT = 10**6  # (10**9 * tf) div (1000 * tf + 8 * m) stays below
SALTS = 64
COUNTS = "term int, n long"
COUNTS_ARROW = pa.schema([("term", pa.int32()), ("n", pa.int64())])
HITS = "salt int, item_key string, doc_id long, score long"
HITS_ARROW = pa.schema([("salt", pa.int32()), ("item_key", pa.string()), ("doc_id", pa.int64()), ("score", pa.int64())])


@dataclass(frozen=True)
class SearchSettings:
    """k: documents per item. item_chars: about how many characters of items one pass over the documents serves (what a
    task holds of the items is bounded by it). doc_rows, terms, items: the sides of the dense tiles."""

    k: int = 10
    item_chars: int = 4_000_000
    doc_rows: int = 256
    terms: int = 1024
    items: int = 512


def terms(block: Texts) -> tuple[pa.Array, np.ndarray]:
    """The terms of a block of texts in order, as bytes in lower case, and the row of each."""
    solid = ALNUM[block.data]
    begin, end, row = block.spans(solid)
    offsets = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int64)
    data = LOWER[block.data[solid]]
    return pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(data)]), row


@dataclass
class Items:
    """A block of item texts: their keys, their distinct terms, and (term, item) postings sorted by term."""

    keys: list[str]
    vocabulary: pa.Array
    first: np.ndarray  # postings of term t are first[t]:first[t + 1]
    owner: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[str, str]]) -> "Items":
        keys = [key for key, _ in rows]
        found, owners = [], []
        for block in text_blocks(pa.array([text for _, text in rows], pa.large_string())):
            words, row = terms(block)
            found.append(words)
            owners.append(row + block.first)
        words = pa.concat_arrays(found) if found else pa.array([], pa.large_binary())
        coded = words.dictionary_encode()
        number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        pairs = np.unique(number * len(keys) + np.concatenate(owners)) if len(number) else np.zeros(0, np.int64)
        term, owner = np.divmod(pairs, max(1, len(keys)))
        return cls(keys, coded.dictionary, np.searchsorted(term, np.arange(len(coded.dictionary) + 1)), owner)

    def uses(self, block: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Terms of each row; and row, term, times of the items' terms that occur, in order."""
        words, row = terms(block)
        size = max(1, len(self.vocabulary))
        at = pc.index_in(words, value_set=self.vocabulary)
        known = at.is_valid().to_numpy(zero_copy_only=False)
        at = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        key, times = np.unique(row[known] * size + at[known], return_counts=True)
        return np.bincount(row, minlength=block.rows), key // size, key % size, times


@dataclass
class Weighted:
    """Items with the collection's figures: documents, terms in them, and the weight of each term."""

    items: Items
    n_docs: int
    n_terms: int
    weight: np.ndarray

    def impacts(self, sizes: np.ndarray, row: np.ndarray, times: np.ndarray) -> np.ndarray:
        norm = np.array([100 - 90 + (90 * n * self.n_docs) // self.n_terms for n in sizes.tolist()], np.int64)
        return (10**9 * times) // (1000 * times + 8 * norm[row])


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def tile_scores(shared: Weighted, row: np.ndarray, term: np.ndarray, impact: np.ndarray, rows: int, settings: SearchSettings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(items, scores items x rows) of a tile of documents, for the items that share a term with it.

    Only terms that occur here and items that hold one of them take part. Every product of a tile is a whole number below
    2**53, so its float64 sums are exact; tiles add up in 64-bit integers.
    """
    items = shared.items
    present, column = np.unique(term, return_inverse=True)
    span = items.first[present + 1] - items.first[present]
    entry = np.arange(span.sum()) - np.repeat(np.cumsum(span) - span, span) + np.repeat(items.first[present], span)
    held = items.owner[entry]
    held_column = np.repeat(np.arange(len(present)), span)
    weight = shared.weight[present].astype(np.float64)
    step = min(settings.terms, EXACT // (MOST_IMPACT * max(1, int(weight.max()))) - 1)
    documents = []
    for low in range(0, len(present), step):
        some = (column >= low) & (column < low + step)
        tile = np.zeros((min(step, len(present) - low), rows))
        tile[column[some] - low, row[some]] = impact[some]
        documents.append(tile)
    numbers, place = np.unique(held, return_inverse=True)
    for low in range(0, len(numbers), settings.items):
        high = min(low + settings.items, len(numbers))
        scores = np.zeros((high - low, rows), np.int64)
        ours = (place >= low) & (place < high)
        for k, tile in enumerate(documents):
            some = ours & (held_column >= k * step) & (held_column < k * step + len(tile))
            weights = np.zeros((high - low, len(tile)))
            weights[place[some] - low, held_column[some] - k * step] = weight[held_column[some]]
            scores += (weights @ tile).astype(np.int64)
        yield numbers[low:high], scores


class Best:
    """The k best documents of each item so far; equal scores by ascending id, null ids last."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.least = np.ones(items, np.int64)  # a score below this can't enter; an equal one may, by its id
        self.rows = np.zeros((4, 0), np.int64)  # item, score, id is null, id

    def add(self, numbers: np.ndarray, scores: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        item, at = np.nonzero(scores >= self.least[numbers][:, None])
        if not len(item):
            return
        new = np.stack([numbers[item], scores[item, at], no_id[at], ids[at]])
        rows = np.concatenate([self.rows, new], axis=1)
        rows = rows[:, np.lexsort((rows[3], rows[2], -rows[1], rows[0]))]
        start = np.searchsorted(rows[0], rows[0])
        rank = np.arange(rows.shape[1]) - start
        self.rows = rows[:, rank < self.k]
        last = rows[:, rank == self.k - 1]
        self.least[last[0]] = last[1]


def _counter(shared):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        df = np.zeros(len(items.vocabulary), np.int64)
        n_docs = n_terms = 0
        for batch in batches:
            for block in text_blocks(batch.column(0)):
                sizes, _, term, _ = items.uses(block)
                n_docs += int((sizes > 0).sum())
                n_terms += int(sizes.sum())
                df += np.bincount(term, minlength=len(df))
        some = np.flatnonzero(df)
        yield pa.record_batch([np.concatenate([[-2, -1], some]).astype(np.int32), np.concatenate([[n_docs, n_terms], df[some]])], schema=COUNTS_ARROW)

    return count


def _searcher(shared, settings: SearchSettings):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weighted: Weighted = shared.value
        best = Best(len(weighted.items.keys), settings.k)
        for batch in batches:
            no_id = batch.column(0).is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            for block in text_blocks(batch.column(1)):
                sizes, row, term, times = weighted.items.uses(block)
                impact = weighted.impacts(sizes, row, times) if len(row) else times
                for low in range(0, block.rows, settings.doc_rows):
                    high = min(low + settings.doc_rows, block.rows)
                    a, b = np.searchsorted(row, [low, high])
                    if a == b:
                        continue
                    here = slice(block.first + low, block.first + high)
                    for numbers, scores in tile_scores(weighted, row[a:b] - low, term[a:b], impact[a:b], high - low, settings):
                        best.add(numbers, scores, ids[here], no_id[here])
        item, score, no_id, ids = best.rows
        salt = np.full(len(item), TaskContext.get().partitionId() % SALTS, np.int32)
        keys = pa.array(weighted.items.keys, pa.string()).take(pa.array(item))
        yield pa.record_batch([pa.array(salt), keys, pa.array(ids, mask=no_id.astype(bool)), pa.array(score)], schema=HITS_ARROW)

    return search


def item_blocks(items: DataFrame, chars: int) -> Iterator[Items]:
    """Distinct item texts (item_key, text) in blocks of about so many characters, each for the driver and every task."""
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // chars)
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_key"), F.lit(n)) == k).collect()
        if rows:
            yield Items.of(sorted((r["item_key"], r["text"]) for r in rows))


def best_first(df: DataFrame, *keys: str, k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, settings: SearchSettings = SearchSettings()) -> DataFrame:
    """The k best documents of each item: item_id, rank (from 1, unique), doc_id, score.

    docs: doc_id (an integer type, else TypeError) and text; items: item_id of any type and text; further columns of any
    name are ignored. Terms are runs of ASCII letters, digits and characters beyond ASCII, A-Z in lower case. Scores are
    whole numbers above 0 and exact; equal scores go by ascending doc_id, null ids last. Every row of docs and of items
    counts by itself, with a repeated or null id, too: rows alike in id and text tie and take a rank each. Null and empty
    texts have no term and so neither ranks nor are ranked; empty tables give an empty result.

    Equal item texts are searched for once. The items are a stated query set: each block of them (see SearchSettings)
    passes over all texts twice, once to count documents by term, once to score. A task keeps k documents per item and
    sends no more; documents are never shuffled. Terms are compared byte by byte, not by hash.
    """
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError("doc_id must be of an integer type")
    spark = docs.sparkSession
    ours = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    asked = items.where("text IS NOT NULL").select("item_id", "text").withColumn("item_key", F.md5("text"))
    found = spark.createDataFrame([], HITS)
    for block in item_blocks(asked.select("item_key", "text").dropDuplicates(["item_key"]), settings.item_chars):
        if not len(block.vocabulary):
            continue
        counted = ours.select("text").mapInArrow(_counter(spark.sparkContext.broadcast(block)), COUNTS)
        # one row per term of the block at most
        figures = dict(counted.groupBy("term").agg(F.sum("n").alias("n")).collect())
        n_docs, n_terms = figures.get(-2) or 0, figures.get(-1) or 0
        if not n_terms:
            continue
        weight = np.array([term_weight(n_docs, figures.get(t, 0)) for t in range(len(block.vocabulary))], np.int64)
        weighted = spark.sparkContext.broadcast(Weighted(block, n_docs, n_terms, weight))
        found = found.unionByName(ours.mapInArrow(_searcher(weighted, settings), HITS))
    # fewer rows per item first, so that no item meets those of all tasks at once
    ranked = best_first(best_first(found, "item_key", "salt", k=settings.k), "item_key", k=settings.k)
    return asked.select("item_id", "item_key").join(ranked, "item_key").select("item_id", "rank", "doc_id", "score")


SEARCH_SQL = """
WITH cut AS (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL
), sized AS (SELECT doc_id, row, terms, len(terms) AS n FROM cut WHERE len(terms) > 0
), facts AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM sized
), uses AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM sized) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM uses GROUP BY term), facts
), wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM benchmark
), scored AS (
  SELECT item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * n_docs) // n_terms)))))::BIGINT AS score
  FROM wanted JOIN weights USING (term) JOIN uses USING (term) JOIN sized USING (row), facts
  GROUP BY item_id, row, doc_id
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST)::INTEGER AS rank, doc_id, score
  FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
