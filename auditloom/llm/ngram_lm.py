"""Language-model scores: smoothed n-grams with failure arcs. Chunks of texts send their n-grams, packed, to the buckets that
count them, and get the counts back."""

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.store import stored
from auditloom.llm.words import BASE, Texts, mix, span_hash, text_blocks

# stand for the end and the begin of a text; hashes of words are never these in practice
END, BEGIN = np.uint64(0), np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
# n numbers for the keys of a chunk that lie in a bucket, and on their way there the keys, too
ASKED = "chunk long, bucket long, n long, keys binary, numbers binary"
ANSWERS = "chunk long, bucket long, n long, numbers binary, total long, used long"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


@dataclass(frozen=True)
class LmSettings:
    """order: longest n-gram, 2 or 3. least: an n-gram becomes an arc from this many uses on, whatever the corpus's
    size. share: above 0, an arc must make up this share of all training tokens, too. discount: taken off each count of
    an arc, and given to the failure arc. chunk_bytes: text scored at a time. passes: n-grams are counted in so many parts,
    one after another, to have less of them on disk at a time."""

    order: int = 3
    least: int = 2
    share: float = 0.0
    discount: float = 0.75
    chunk_bytes: int = 8 << 20
    passes: int = 2


@dataclass(frozen=True)
class Corpus:
    """Tokens, distinct tokens and texts of the training rows. Each text has one end token."""

    tokens: int
    distinct: int
    texts: int

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        """The add-one-half estimate for words with these counts."""
        return (counts + 0.5) / (self.tokens + 0.5 * (self.distinct + 1))


@dataclass
class Facts:
    """Sorted keys of n-grams with their values; 0 for others. Keys are hashes, so their first bits say nearly where they stand."""

    keys: np.ndarray
    values: np.ndarray

    def __post_init__(self) -> None:
        bits = len(self.keys).bit_length() + 1
        self.shift = np.uint64(64 - bits)
        self.starts = np.append(np.searchsorted(self.keys, np.arange(1 << bits, dtype=np.uint64) << self.shift), len(self.keys))

    @staticmethod
    def of(keys: np.ndarray, values: np.ndarray) -> "Facts":
        by = np.argsort(keys)
        return Facts(keys[by], values[by])

    def look(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), self.values.dtype)
        slot = (keys >> self.shift).astype(np.int64)
        at, end = self.starts[slot], self.starts[slot + 1]
        todo = np.flatnonzero(at < end)
        while len(todo):
            here = at[todo]
            hit = self.keys[here] == keys[todo]
            out[todo[hit]] = self.values[here[hit]]
            at[todo] += 1
            todo = todo[~hit & (here + 1 < end[todo])]
        return out


def token_hashes(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, A-Z in lower case, and their rows."""
    low = Texts(LOWER[texts.data], texts.starts, texts.first)
    begin, end, rows = low.words()
    return span_hash(low.prefix(), begin, end), rows


def framed(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens with begin before and end after each text, and their rows."""
    hashes, rows = token_hashes(texts)
    all_rows = np.arange(texts.rows)
    stops = np.searchsorted(rows, all_rows, "right")
    hashes = np.insert(hashes, stops, END)
    owners = np.insert(rows, stops, all_rows)
    starts = np.searchsorted(owners, all_rows)
    return np.insert(hashes, starts, BEGIN), np.insert(owners, starts, all_rows)


def gram_keys(hashes: np.ndarray, rows: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length from 1 to order: the key of the n-gram that ends at each token, and whether its text has one.

    The key of a longer n-gram is made of its history's key and its last word.
    """
    out = [(hashes, np.ones(len(hashes), bool))]
    for _ in range(2, order + 1):
        before, there = out[-1]
        keys, whole = np.zeros(len(hashes), np.uint64), np.zeros(len(hashes), bool)
        keys[1:] = mix(before[:-1] * BASE + mix(hashes[1:]))
        whole[1:] = there[:-1] & (rows[1:] == rows[:-1])
        out.append((keys, whole))
    return out


def packed(numbers: np.ndarray) -> bytes:
    """Numbers of 64 bits, compressed: the first bytes of all come first, then the second ones."""
    return pa.compress(numbers.view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int, kind: type) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * n, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view(kind).ravel()


@dataclass(frozen=True)
class Buckets:
    """Buckets first to last (that one left out) of `number`; all of them share the range of the keys evenly."""

    first: int
    last: int
    number: int

    def edges(self) -> list[int]:
        return [(k << 64) // self.number for k in range(self.first, self.last + 1)]

    def part(self, keys: np.ndarray) -> np.ndarray:
        """Which keys lie in these buckets."""
        edges = self.edges()
        return (keys >= np.uint64(edges[0])) & (keys <= np.uint64(edges[-1] - 1))

    def asked(self, chunk: int, keys: np.ndarray, numbers: np.ndarray) -> pa.Table:
        """A row for each bucket that has some of these keys (distinct and sorted, all of them in these buckets)."""
        cuts = np.append(np.searchsorted(keys, np.array(self.edges()[:-1], np.uint64)), len(keys))
        some = np.flatnonzero(np.diff(cuts))
        spans = [(cuts[k], cuts[k + 1]) for k in some]
        gaps = [np.diff(keys[a:b], prepend=np.uint64(0)) for a, b in spans]
        return pa.table({
            "chunk": pa.array(np.full(len(some), chunk, np.int64)), "bucket": pa.array((some + self.first).astype(np.int64)),
            "n": pa.array(np.array([b - a for a, b in spans], np.int64)), "keys": pa.array([packed(x) for x in gaps], pa.binary()),
            "numbers": pa.array([packed(numbers[a:b]) for a, b in spans], pa.binary()),
        })


def _answer(rows: pa.Table, kind: type, told: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> pa.Table:
    """What a bucket tells each chunk for its keys: told() of the sum of all chunks' numbers, and of whether the chunk is
    the one that speaks for the key. total: the sum of all numbers of the bucket, used: its keys with a sum above 0, on its first row."""
    sizes = rows["n"].to_numpy()
    packs = [list(zip(rows[c].to_pylist(), sizes.tolist(), strict=True)) for c in ("keys", "numbers")]
    keys = np.concatenate([np.cumsum(unpacked(x, n, np.uint64)) for x, n in packs[0]])
    numbers = np.concatenate([unpacked(x, n, kind) for x, n in packs[1]])
    every, first, at = np.unique(keys, return_index=True, return_inverse=True)
    sums = np.bincount(at, numbers, len(every)).astype(kind)
    speaks = np.zeros(len(keys), bool)
    speaks[first] = True
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    out = told(sums[at], speaks)
    facts = np.zeros((2, len(sizes)), np.int64)
    facts[:, 0] = sums.sum(), np.count_nonzero(sums)
    return pa.table({
        "chunk": rows["chunk"], "bucket": rows["bucket"], "n": rows["n"],
        "numbers": pa.array([packed(out[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
        "total": pa.array(facts[0]), "used": pa.array(facts[1]),
    })


def _answered(asked: DataFrame, name: str, kind: type, told: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    def run(rows: pa.Table) -> pa.Table:
        return _answer(rows, kind, told)

    return stored(asked.groupBy("bucket").applyInArrow(run, ANSWERS), name)


def _numbers(answers: pa.Table, what: int, kind: type) -> np.ndarray:
    """The numbers that a chunk was told, in the order of its keys."""
    rows = answers.filter(pc.equal(answers["what"], what)).sort_by("bucket")
    parts = [unpacked(x, n, kind) for x, n in zip(rows["numbers"].to_pylist(), rows["n"].to_pylist(), strict=True)]
    return np.concatenate([np.zeros(0, kind), *parts])


def _distinct(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and how often each occurs. Nearly all keys are distinct, so sorting is faster than np.unique."""
    keys = np.sort(np.concatenate([np.zeros(0, np.uint64), *keys]))
    at = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
    return keys[at], np.diff(at, append=len(keys))


def _tally(keys: list[np.ndarray], training: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and how often each is used in training rows."""
    every, _ = _distinct(keys)
    used, counts = _distinct([k[t] for k, t in zip(keys, training, strict=True)])
    uses = np.zeros(len(every), np.int64)
    uses[np.searchsorted(every, used)] = counts
    return every, uses


def ask_words(rows: pa.Table, buckets: Buckets) -> pa.Table:
    """A chunk's words with their uses in training rows."""
    keys, training, trains = [], [], rows["training"].to_numpy()
    for block in text_blocks(rows["text"]):
        hashes, at = token_hashes(block)
        keys.append(hashes)
        training.append(trains[block.first + at])
    return buckets.asked(rows["chunk"][0].as_py(), *_tally(keys, training))


def ask_grams(rows: pa.Table, buckets: Buckets, order: int) -> pa.Table:
    """A chunk's n-grams of 2 to order tokens that lie in these buckets, with their uses in training rows."""
    keys, training, trains = [], [], rows["training"].to_numpy()
    for block in text_blocks(rows["text"]):
        hashes, owners = framed(block)
        for found, whole in gram_keys(hashes, owners, order)[1:]:
            at = np.flatnonzero(whole & buckets.part(found))
            keys.append(found[at])
            training.append(trains[block.first + owners[at]])
    return buckets.asked(rows["chunk"][0].as_py(), *_tally(keys, training))


@dataclass
class Arcs:
    """Of a chunk: its arcs with their uses; the arcs it speaks for, as history and uses of each; and the histories that can have
    arcs, sorted: words, begin, and n-grams that are arcs."""

    uses: Facts
    spoken: tuple[np.ndarray, np.ndarray]
    histories: np.ndarray

    @staticmethod
    def of(rows: pa.Table, answers: pa.Table, order: int) -> "Arcs":
        lengths = [[np.zeros((2, 0), np.uint64)] for _ in range(2, order + 1)]
        for block in text_blocks(rows["text"]):
            grams = gram_keys(*framed(block), order)
            for held, (shorter, _), (keys, whole) in zip(lengths, grams[:-1], grams[1:], strict=True):
                at = np.flatnonzero(whole)
                held.append(np.stack([keys[at], shorter[at - 1]]))
        held = [np.concatenate(x, axis=1) for x in lengths]
        keys, told = _distinct([x[0] for x in held])[0], _numbers(answers, 1, np.int64)
        told = Facts(keys[told > 0], told[told > 0])
        known = [held[0], *(x[:, told.look(x[1]) > 0] for x in held[1:])]
        spoken, history = np.concatenate([x[:, (told.look(x[0]) & 1) > 0] for x in known], axis=1)
        spoken, first = np.unique(spoken, return_index=True)
        return Arcs(Facts(told.keys, told.values >> 1), (history[first], told.look(spoken) >> 1), _distinct([x[1] for x in known])[0])


def ask_histories(rows: pa.Table, answers: pa.Table, buckets: Buckets, settings: LmSettings) -> pa.Table:
    """A chunk's histories with the discounted uses of those of their arcs that the chunk speaks for. One chunk speaks for each arc."""
    arcs = Arcs.of(rows, answers, settings.order)
    history, uses = arcs.spoken
    seen = np.bincount(np.searchsorted(arcs.histories, history), uses - settings.discount, len(arcs.histories))
    return buckets.asked(rows["chunk"][0].as_py(), arcs.histories, seen)


def score_block(texts: Texts, corpus: Corpus, uses: Facts, seen: Facts, settings: LmSettings) -> dict[str, np.ndarray]:
    """Scores of some texts. uses: counts of their words, and of their n-grams with arcs; seen: for histories, the sum
    of the discounted counts of their arcs.

    A token takes the arc of the longest history that has one for it; each history that has arcs, but none for it,
    costs its failure arc. An arc's probability holds the failure arc's share of the shorter history, too.
    """
    hashes, rows = framed(texts)
    grams = gram_keys(hashes, rows, settings.order)
    first = np.searchsorted(rows, np.arange(texts.rows))
    token = np.ones(len(hashes), bool)
    token[first] = False
    counts = [uses.look(keys) for keys, _ in grams]
    counts[0][(hashes == END) | ~token] = corpus.texts
    p = corpus.unigram(counts[0])
    base = np.log10(p)
    for n in range(1, settings.order):
        at = np.flatnonzero(grams[n][1])
        taken = seen.look(grams[n - 1][0][at - 1])
        at, taken = at[taken > 0], taken[taken > 0]
        total = counts[n - 1][at - 1]
        p[at] = np.maximum(counts[n][at] - settings.discount, 0) / total + np.maximum(1 - taken / total, 1e-300) * p[at]
    return {
        "n_tokens": np.bincount(rows[token], minlength=texts.rows),
        "n_known": np.bincount(rows[token & (counts[0] > 0)], minlength=texts.rows),
        "base_score": np.bincount(rows[token], base[token], texts.rows),
        "score": np.bincount(rows[token], np.log10(p[token]), texts.rows),
    }


def score_texts(docs: DataFrame, held_out, settings: LmSettings = LmSettings()) -> DataFrame:
    """Scores of all whole texts under a model learned from the rows where held_out (a boolean column) is false.

    Texts are dealt into chunks of a few megabytes. A chunk sends its words and n-grams, each once and with its uses, to the buckets
    of their keys; a bucket adds up what all chunks send, and answers each. In a second round, in the same way, chunks
    add up the arcs of each history, an arc by one chunk. What buckets hold grows with the corpus, and none of it is gathered.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, a row per input row. A null text is
    empty: one end token. Without training rows every token
    has probability 1.
    """
    if settings.order not in (2, 3):
        raise ValueError("order is 2 or 3")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), held_out.alias("held_out"))
    docs = docs.withColumn("training", F.coalesce(~F.col("held_out"), F.lit(False)))
    sums = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count_if("training").alias("texts")).first()
    n = max(1, -(-(sums["bytes"] or 0) // settings.chunk_bytes))
    dealt = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("long"))
    texts = dealt.select("chunk", "text", "training").groupBy("chunk")
    whole = Buckets(0, n, n)
    words = _answered(texts.applyInArrow(lambda rows: ask_words(rows, whole), ASKED), "lm-words", np.int64, lambda uses, speaks: uses)
    facts = words.agg(F.sum("total").alias("n"), F.sum("used").alias("v")).first()
    n_texts = sums["texts"]
    corpus = Corpus((facts["n"] or 0) + n_texts, (facts["v"] or 0) + (n_texts > 0), n_texts)
    least = max(settings.least, settings.share * corpus.tokens)

    def arcs(uses: np.ndarray, speaks: np.ndarray) -> np.ndarray:
        return np.where(uses >= least, 2 * uses + speaks, 0)

    def asked_grams(part: Buckets) -> DataFrame:
        return texts.applyInArrow(lambda rows: ask_grams(rows, part, settings.order), ASKED)

    answers = words.withColumn("what", F.lit(0))
    for k in range(settings.passes):
        grams = _answered(asked_grams(Buckets(k * n, (k + 1) * n, settings.passes * n)), "lm-arcs", np.int64, arcs)
        answers = answers.unionByName(grams.withColumn("what", F.lit(1)))
    answers = answers.select("chunk", "what", "bucket", "n", "numbers")
    asked = texts.cogroup(answers.where("what = 1").groupBy("chunk")).applyInArrow(lambda rows, told: ask_histories(rows, told, whole, settings), ASKED)
    seen = _answered(asked, "lm-seen", np.float64, lambda seen, speaks: seen)
    answers = answers.unionByName(seen.withColumn("what", F.lit(2)).select(*answers.columns))

    def score(rows: pa.Table, told: pa.Table) -> pa.Table:
        words, _ = _distinct([token_hashes(t)[0] for t in text_blocks(rows["text"])])
        arcs = Arcs.of(rows, told, settings.order)
        uses = Facts.of(np.concatenate([words, arcs.uses.keys]), np.concatenate([_numbers(told, 0, np.int64), arcs.uses.values]).astype(float))
        seen = Facts(arcs.histories, _numbers(told, 2, np.float64))
        parts = [score_block(t, corpus, uses, seen, settings) for t in text_blocks(rows["text"])]
        out = {c: pa.array(np.concatenate([p[c] for p in parts])) for c in parts[0]}
        out |= {"doc_id": rows["doc_id"], "held_out": rows["held_out"], "train_tokens": pa.array(np.full(len(rows), corpus.tokens, np.int64))}
        return pa.table({c.split()[0]: out[c.split()[0]] for c in SCORES.split(", ")})

    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, SCORES)
