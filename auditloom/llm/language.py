"""Language identification by per-language piece probabilities, summed over all segmentations of each word."""

import base64
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.store import stored
from auditloom.llm.words import BASE, mix

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
UNKNOWN = "und"
MAX_PIECE = 16
# runs of letters; longer runs count as parts of this many letters
LETTERS = re.compile(r"[^\W\d_]{1,16}")
SCALE = 1024.0  # per byte, keeps products of probabilities within a double
SMOOTHING = 0.01
MEMO_WORDS = 60_000


def vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """Pieces of a public byte-level vocabulary: its letter pieces in lower case, and all single bytes."""
    pieces = {bytes([b]) for b in range(256)}
    for line in Path(path).read_bytes().splitlines():
        piece = base64.b64decode(line.split()[0])
        try:
            text = piece.decode().lower()
        except UnicodeDecodeError:
            continue
        if text.removeprefix(" ").isalpha() and len(text.encode()) <= MAX_PIECE:
            pieces.add(text.encode())
    return sorted(pieces)


def piece_keys(pieces: list[bytes]) -> np.ndarray:
    """Hash of each piece, as Lattice computes it for the parts of words."""
    out = np.zeros(len(pieces), np.uint64)
    for k, piece in enumerate(pieces):
        h = 0
        for b in piece:
            h = (h * int(BASE) + b + 1) % (1 << 64)
        out[k] = h
    return mix(out)


class Lattice:
    """All pieces in words of one length: for each start and piece length, the piece's number or the last, unused one."""

    def __init__(self, words: list[bytes], keys: np.ndarray, order: np.ndarray):
        self.n = n = len(words[0])
        letters = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), n).astype(np.uint64) + np.uint64(1)
        self.pieces: dict[tuple[int, int], np.ndarray] = {}
        hashes = np.zeros((len(words), n), np.uint64)
        for size in range(1, min(n, MAX_PIECE) + 1):
            hashes = hashes[:, : n - size + 1] * BASE + letters[:, size - 1 :]
            mixed = mix(hashes)
            at = np.minimum(np.searchsorted(keys, mixed), len(keys) - 1)
            found = np.where(keys[at] == mixed, order[at], len(keys))
            for start in range(n - size + 1):
                if (found[:, start] < len(keys)).any():
                    self.pieces[start, size] = found[:, start]

    def forward(self, probs: np.ndarray) -> list[np.ndarray]:
        """Scaled probability of each prefix, all segmentations summed; probs has a last row of zeros."""
        sums = [np.zeros(0)] * (self.n + 1)
        some = next(iter(self.pieces.values()))
        sums[0] = np.ones((len(some), probs.shape[1]))
        for end in range(1, self.n + 1):
            total = np.zeros_like(sums[0])
            for size in range(1, min(end, MAX_PIECE) + 1):
                if (ids := self.pieces.get((end - size, size))) is not None:
                    total += sums[end - size] * probs[ids] * SCALE**size
            sums[end] = np.maximum(total, 1e-300)
        return sums

    def expected(self, probs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in these words, which occur weight times; one language."""
        ahead = self.forward(probs)
        behind = [np.zeros_like(ahead[0]) for _ in range(self.n + 1)]
        behind[self.n] += 1
        for start in range(self.n - 1, -1, -1):
            for size in range(1, min(self.n - start, MAX_PIECE) + 1):
                if (ids := self.pieces.get((start, size))) is not None:
                    behind[start] += behind[start + size] * probs[ids] * SCALE**size
        counts = np.zeros(len(probs))
        for (start, size), ids in self.pieces.items():
            share = ahead[start] * probs[ids] * SCALE**size * behind[start + size] / ahead[self.n]
            counts += np.bincount(ids, share[:, 0] * weight, len(probs))
        return counts


def lattices(words: list[bytes], keys: np.ndarray, order: np.ndarray) -> Iterator[tuple[np.ndarray, Lattice]]:
    """Groups of at most 5,000 words of one length: their places in the list, and their lattice."""
    sizes = np.array([len(w) for w in words])
    for n in np.unique(sizes):
        same = np.flatnonzero(sizes == n)
        for at in range(0, len(same), 5_000):
            part = same[at : at + 5_000]
            yield part, Lattice([words[i] for i in part], keys, order)


@dataclass
class LanguageModel:
    """Piece probabilities: a row for each piece and one of zeros, a column for each language."""

    languages: list[str]
    keys: np.ndarray
    order: np.ndarray
    probs: np.ndarray

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        """Natural logarithm of each word's probability in each language."""
        out = np.zeros((len(words), len(self.languages)))
        for at, lattice in lattices(words, self.keys, self.order):
            out[at] = np.log(lattice.forward(self.probs)[lattice.n]) - lattice.n * math.log(SCALE)
        return out


def marked(word: str) -> bytes:
    return b" " + word.encode()


def words_of(text: str | None) -> list[str]:
    """A text's letter runs in lower case; none if it has no letter."""
    words = LETTERS.findall((text or "").lower())
    return words if any(any(map(str.isalpha, w)) for w in words) else []


class _Numbers(dict):
    """Words in order of their first use."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


def language_column(model: Broadcast):
    """A column function: text to struct<lang_pred, score>."""

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m: LanguageModel = model.value
        numbers, scores = _Numbers(), np.zeros((0, len(m.languages)))
        for batch in batches:
            picked, sure = [], []
            # few texts at a time, however long a batch's texts are
            for at in range(0, len(batch), 200):
                if len(numbers) > MEMO_WORDS:
                    numbers, scores = _Numbers(), scores[:0]
                ids = [np.fromiter(map(numbers.__getitem__, words_of(t)), np.int64) for t in batch[at : at + 200].to_pylist()]
                if len(numbers) > len(scores) and m.languages:
                    fresh = [marked(w) for w in list(numbers)[len(scores) :]]
                    scores = np.concatenate([scores, m.word_scores(fresh)])
                for own in ids:
                    if not len(own) or not m.languages:
                        picked.append(UNKNOWN)
                        sure.append(0.0)
                        continue
                    total = scores[own].sum(axis=0)
                    best = int(total.argmax())
                    picked.append(m.languages[best])
                    sure.append(float(1 / np.exp(total - total[best]).sum()))
            yield pa.StructArray.from_arrays([pa.array(picked, pa.string()), pa.array(sure, pa.float64())], ["lang_pred", "score"])

    return predict.asNondeterministic()  # else a filter on the result runs it a second time


def _word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for lang, texts in batch.groupby("lang")["text"]:
            words = pd.Series([w for t in texts for w in words_of(t)], dtype=object)
            counts = words.value_counts()
            yield pd.DataFrame({"lang": lang, "word": counts.index, "uses": counts.to_numpy(np.int64)})


def train_languages(
    labelled: DataFrame, path: str = VOCABULARY, texts_per_language: int = 400, rounds: int = 3
) -> LanguageModel:
    """Learn piece probabilities by expectation-maximisation from rows with text and lang (others are passed over).

    The model is fitted on a sample of about texts_per_language texts of each language, drawn by a hash of id and text;
    this is the only place where not all rows count. One row per language, and one per language and piece of the
    fixed vocabulary, reach the driver. Without labelled rows the model knows no language.
    """
    spark = labelled.sparkSession
    pieces = vocabulary(path)
    keys = piece_keys(pieces)
    order = np.argsort(keys)
    keys = keys[order]
    labelled = labelled.select("doc_id", "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], keys, order, np.zeros((len(keys) + 1, 0)))
    parts = 1 << 30
    below = F.lit(parts)
    for lang, n in sizes.items():
        below = F.when(F.col("lang") == lang, F.lit(int(min(1.0, texts_per_language / n) * parts))).otherwise(below)
    sample = labelled.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)) < below)
    words = stored(
        sample.select("lang", "text").mapInPandas(_word_counts, "lang string, word string, uses long")
        .groupBy("lang", "word").agg(F.sum("uses").alias("uses")),
        "language-words",
    )
    probs = np.zeros((len(keys) + 1, len(languages)))
    probs[:-1] = 1 / len(keys)
    number = {lang: k for k, lang in enumerate(languages)}
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((keys, order, probs, number))

        def uses(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            keys, order, probs, number = shared.value
            totals: dict[str, np.ndarray] = {}
            for batch in batches:
                for lang, rows in batch.groupby("lang"):
                    weight = rows["uses"].to_numpy(float)
                    for at, lattice in lattices([marked(w) for w in rows["word"]], keys, order):
                        counts = lattice.expected(probs[:, [number[lang]]], weight[at])
                        totals[lang] = totals.get(lang, 0) + counts
            for lang, counts in totals.items():
                used = np.flatnonzero(counts[:-1] > 1e-9)
                yield pd.DataFrame({"lang": lang, "piece": used, "uses": counts[used]})

        counts = np.zeros_like(probs)
        spread = words.repartition(spark.sparkContext.defaultParallelism)
        for r in spread.mapInPandas(uses, "lang string, piece int, uses double").groupBy("lang", "piece").agg(F.sum("uses").alias("uses")).toLocalIterator():
            counts[r["piece"], number[r["lang"]]] = r["uses"]
        shared.destroy()
        counts[:-1] += SMOOTHING
        probs = counts / counts.sum(axis=0)
    return LanguageModel(languages, keys, order, probs)


def with_language(docs: DataFrame, model: LanguageModel, column: str = "language") -> DataFrame:
    """docs and one more column, struct<lang_pred, score>, from the whole text.

    score is the language's share of the text's probability over all languages. Null text, or text without a letter:
    `und`, 0. Between equal languages the first by code point wins. Each row is judged by itself, so repeated rows,
    null ids and further columns change nothing.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.withColumn(column, language_column(shared)(F.col("text")))


def held_out(doc_id, parts: int, part: int):
    """Whether crc32 of the id as text leaves this remainder; a null id never does."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))
