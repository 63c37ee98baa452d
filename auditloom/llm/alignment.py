"""Alignment of two tokenizers: both cover the same bytes, tokens that overlap form groups, groups are cut by one sweep."""

import base64
import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.store import stored

A_FILE = "/opt/tokenizers/byte_bpe_50k.json"
B_FILE = "/opt/tokenizers/piece_bpe_32k.model"
# Fixed value: the public pattern that splits texts before byte pairs are merged.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# characters on whose classes every engine of that pattern agrees; texts with others go to the tokenizer's own library
PLAIN = re.compile("[\t-\r -~¡-ɏΑ-ΡΣ-ώА-я–-„]*")
BLOCK = 1 << 19  # bytes of text that are aligned at a time
LINK = 32  # an id pair is a << LINK | b

GROUPS = "array<struct<a: array<int>, b: array<int>, begin: int, end: int>>"
CHUNKS = (
    "chunk long, docs array<struct<doc_id: long, n_a: long, n_b: long, n_groups: long, n_links: long, n_pairs: long, groups_sha256: string>>, "
    "packed binary, pair array<long>, times array<long>"
)
DOC_ARROW = pa.struct([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("n_pairs", pa.int64()), ("groups_sha256", pa.string())])
CHUNKS_ARROW = pa.schema([("chunk", pa.int64()), ("docs", pa.list_(DOC_ARROW)), ("packed", pa.binary()), ("pair", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])
DIGESTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
DIGESTS_ARROW = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], ("groups_sha256", pa.string())])


# ---- the two tokenizers ----


def byte_symbols() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteTokens:
    """Ids of a byte-level BPE file (tokenizers JSON), and the bytes of each."""

    def __init__(self, content: bytes):
        self.content, self.own = content, None
        model = json.loads(content)["model"]
        symbols = byte_symbols()
        # entries that are no byte string, such as special tokens, never come out of a text
        known = {entry: i for entry, i in model["vocab"].items() if all(c in symbols for c in entry)}
        self.pieces = [b""] * (max(model["vocab"].values()) + 1)
        for entry, i in known.items():
            self.pieces[i] = bytes(symbols[c] for c in entry)
        self.sizes = np.array([len(p) for p in self.pieces], np.int64)
        merges = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
        made = [known.get(m.replace(" ", "", 1)) for m in merges]
        self.quick = None
        if None not in made and all(x < y for x, y in zip(made, made[1:])):  # merged in the order of ids
            import tiktoken

            ranks = {self.pieces[i]: i for i in {*made, *(known[c] for c in symbols)}}
            self.quick = tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        plain = [self.quick is not None and PLAIN.fullmatch(t) is not None for t in texts]
        if not all(plain) and self.own is None:
            from tokenizers import Tokenizer

            self.own = Tokenizer.from_buffer(self.content)
            self.own.encode_special_tokens = True
        return [self.quick.encode_ordinary(t) if p else self.own.encode(t, add_special_tokens=False).ids for t, p in zip(texts, plain, strict=True)]


class PieceTokens:
    """Ids of a sentencepiece model, and the bytes of each."""

    def __init__(self, content: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=content)
        self.pieces = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.pieces.append(bytes([int(piece[3:-1], 16)]))
            elif self.model.is_control(i) or self.model.is_unknown(i):
                self.pieces.append(b"")
            else:
                self.pieces.append(piece.replace("▁", " ").encode())
        self.sizes = np.array([len(p) for p in self.pieces], np.int64)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@dataclass
class Files:
    """The content of both files, as sent to the tasks. (b64 of their hash names them among those a worker has loaded.)"""

    a: bytes
    b: bytes
    name: str = field(init=False)

    def __post_init__(self):
        self.name = base64.b64encode(hashlib.sha256(self.a + b"\0" + self.b).digest()).decode()


_loaded: dict[str, tuple[ByteTokens, PieceTokens]] = {}


def loaded(files: Files) -> tuple[ByteTokens, PieceTokens]:
    if files.name not in _loaded:
        _loaded.clear()
        _loaded[files.name] = ByteTokens(files.a), PieceTokens(files.b)
    return _loaded[files.name]


# ---- one block of texts ----


@dataclass
class Block:
    """Tokens of some texts, one after another. a, b: ids; *_end: the end of each token in the bytes of all texts;
    *_group: its group; *_row: its text. A text that both sides don't render alike has none."""

    rows: int
    a: np.ndarray
    b: np.ndarray
    a_end: np.ndarray
    b_end: np.ndarray
    a_row: np.ndarray
    b_row: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Places (in a, in b) of all tokens whose bytes overlap."""
        a_begin = np.concatenate([[0], self.a_end])[:-1]
        b_begin = np.concatenate([[0], self.b_end])[:-1]
        low = np.searchsorted(self.b_end, a_begin, "right")
        n = np.searchsorted(b_begin, self.a_end, "left") - low
        left = np.repeat(np.arange(len(self.a)), n)
        return left, np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


def coalesced(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token. Both sides cover the same bytes without gaps.

    All tokens are sorted by where they start; a group breaks where a start reaches the furthest end so far.
    """
    start = np.concatenate([[0], a_end[:-1], [0], b_end[:-1]]) if len(a_end) and len(b_end) else np.zeros(0, np.int64)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    end = np.concatenate([a_end, b_end])
    side = np.repeat([0, 1], [len(a_end), len(b_end)])
    order = np.lexsort((side, start))
    reach = np.maximum.accumulate(end[order])
    fresh = np.ones(len(order), np.int64)
    fresh[1:] = start[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(fresh) - 1
    return group[: len(a_end)], group[len(a_end) :]


def aligned(texts: list[str | None], files: Files) -> Block:
    a_side, b_side = loaded(files)
    some = [k for k, t in enumerate(texts) if t]
    spaced = [" " + texts[k] for k in some]
    a_ids, b_ids = a_side.encode(spaced), b_side.encode([texts[k] for k in some])
    a, b, rows = [], [], []
    for k, text, left, right in zip(some, spaced, a_ids, b_ids, strict=True):
        data = text.encode()
        if b"".join([a_side.pieces[i] for i in left]) == data == b"".join([b_side.pieces[i] for i in right]):
            a.append(left)
            b.append(right)
            rows.append(k)

    def flat(lists: list[list[int]], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = np.fromiter(chain.from_iterable(lists), np.int64, sum(map(len, lists)))
        return ids, np.cumsum(sizes[ids]), np.repeat(np.array(rows, np.int64), [len(x) for x in lists])

    a, a_end, a_row = flat(a, a_side.sizes)
    b, b_end, b_row = flat(b, b_side.sizes)
    return Block(len(texts), a, b, a_end, b_end, a_row, b_row, *coalesced(a_end, b_end))


def text_lists(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, list[str | None]]]:
    """The rows of a batch in lists of about limit characters, each with the place of its first."""
    first, held, size = 0, [], 0
    for k, text in enumerate(column):
        text = text.as_py()
        if held and size + len(text or "") > limit:
            yield first, held
            first, held, size = k, [], 0
        held.append(text)
        size += len(text or "")
    if held:
        yield first, held


# ---- groups as rows ----


def token_groups(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """doc_id and groups: for each group of a text its A ids, its B ids and its bytes (of space + text).

    A encodes space + text, B encodes text; special tokens are plain text. Groups lie between byte offsets at which tokens
    of both sides end. A null or empty text, or one that a side does not give back byte for byte, has no groups. Rows are
    taken one by one, so null or repeated ids change nothing; further columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Files(Path(a_file).read_bytes(), Path(b_file).read_bytes()))

    @F.arrow_udf(GROUPS)
    def grouped(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("begin", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            out = []
            for _, texts in text_lists(batch):
                block = aligned(texts, shared.value)
                n = int(block.a_group[-1]) + 1 if len(block.a) else 0
                a_cut = np.searchsorted(block.a_group, np.arange(n + 1))
                b_cut = np.searchsorted(block.b_group, np.arange(n + 1))
                rows = [[] for _ in texts]
                base = {}
                for g in range(n):
                    row = int(block.a_row[a_cut[g]])
                    begin = int(block.a_end[a_cut[g] - 1]) if a_cut[g] else 0
                    base.setdefault(row, begin)
                    end = int(block.a_end[a_cut[g + 1] - 1])
                    rows[row].append({"a": block.a[a_cut[g] : a_cut[g + 1]].tolist(), "b": block.b[b_cut[g] : b_cut[g + 1]].tolist(), "begin": begin - base[row], "end": end - base[row]})
                out += rows
            yield pa.array(out, kind)

    return docs.select("doc_id", grouped("text").alias("groups"))


# ---- digests and counts of linked ids ----


def written(block: Block, names: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The groups of all texts as `a1,a2|b1;a3|b2`, as bytes, and where each text's part ends.

    names has every id, padded with zero bytes, followed by `,` `|` or `;` or nothing: a token's separator is given by
    the token behind it.
    """
    group = np.concatenate([block.a_group, block.b_group])
    side = np.repeat([0, 1], [len(block.a), len(block.b)])
    order = np.lexsort((side, group))
    ids, row = np.concatenate([block.a, block.b])[order], np.concatenate([block.a_row, block.b_row])[order]
    group, side = group[order], side[order]
    kind = np.full(len(order), 3)
    if len(order) > 1:
        kind[:-1] = np.where(row[1:] != row[:-1], 3, np.where(group[1:] != group[:-1], 2, np.where(side[1:] != side[:-1], 1, 0)))
    table, sizes = names
    sizes = np.cumsum(sizes[ids * 4 + kind])
    data = table[ids * 4 + kind].view(np.uint8)
    last = np.searchsorted(row, np.arange(block.rows), "right")
    return data[data != 0], np.concatenate([[0], sizes])[last]


def id_names(n: int) -> tuple[np.ndarray, np.ndarray]:
    words = [f"{i}{mark}".encode() for i in range(n) for mark in (",", "|", ";", "")]
    table = np.array(words)
    return table, np.char.str_len(table)


def packed(values: np.ndarray) -> bytes:
    """32-bit values, byte plane by byte plane, compressed."""
    planes = values.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel().astype(np.int64)


class Chunk:
    """Digests of some texts, and which id pairs each links how often."""

    def __init__(self):
        self.docs, self.size, self.rows = [], 0, 0
        self.pairs, self.owners, self.counts = [], [], []

    def add(self, ids: list[int | None], texts: list[str | None], files: Files, names: tuple[np.ndarray, np.ndarray]) -> None:
        block = aligned(texts, files)
        data, last = written(block, names)
        left, right = block.links()
        pair = (block.a[left] << LINK) | block.b[right]
        owner = block.a_row[left]
        n_links = np.bincount(owner, minlength=block.rows)
        by = np.lexsort((pair, owner))
        pair, owner = pair[by], owner[by]
        fresh = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (owner[1:] != owner[:-1])])) if len(pair) else by
        pair, owner, times = pair[fresh], owner[fresh], np.diff(np.append(fresh, len(by)))
        first = np.searchsorted(block.a_row, np.arange(block.rows + 1))
        groups = np.concatenate([block.a_group, [block.a_group[-1] + 1 if len(block.a) else 0]])
        n_groups = groups[first[1:]] - groups[first[:-1]]
        n_b = np.bincount(block.b_row, minlength=block.rows)
        n_pairs = np.bincount(owner, minlength=block.rows)
        low, view = 0, memoryview(data)
        for k, (doc_id, high) in enumerate(zip(ids, last.tolist(), strict=True)):
            sha = hashlib.sha256(view[low:high]).hexdigest() if high > low else ""
            self.docs.append((doc_id, int(first[k + 1] - first[k]), int(n_b[k]), int(n_groups[k]), int(n_links[k]), int(n_pairs[k]), sha))
            low = high
        self.pairs.append(pair)
        self.owners.append(owner + self.rows)
        self.counts.append(times)
        self.rows += block.rows
        self.size += sum(len(t or "") for t in texts)

    def batch(self, number: int) -> pa.RecordBatch:
        pairs, counts = np.concatenate(self.pairs), np.concatenate(self.counts)
        distinct, place = np.unique(pairs, return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, place, counts)
        # within a text the places ascend, so that steps between them are small
        step = np.diff(place, prepend=0)
        owner = np.concatenate(self.owners)
        fresh = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, bool)
        step[fresh] = place[fresh]
        docs = pa.array([dict(zip(DOC_ARROW.names, d, strict=True)) for d in self.docs], DOC_ARROW)
        row = {"docs": pa.ListArray.from_arrays([0, len(docs)], docs), "pair": pa.ListArray.from_arrays([0, len(distinct)], pa.array(distinct)), "times": pa.ListArray.from_arrays([0, len(distinct)], pa.array(total))}
        both = np.concatenate([step, counts])
        return pa.record_batch([pa.array([number]), row["docs"], pa.array([packed(both)], pa.binary()), row["pair"], row["times"]], schema=CHUNKS_ARROW)


def _encoder(shared, chunk_chars: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: Files = shared.value
        names = id_names(max(len(side.pieces) for side in loaded(files)))
        number = TaskContext.get().partitionId() << 32
        chunk = Chunk()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, texts in text_lists(batch.column(1)):
                chunk.add(ids[first : first + len(texts)], texts, files, names)
                if chunk.size >= chunk_chars:
                    yield chunk.batch(number)
                    number, chunk = number + 1, Chunk()
        if chunk.rows:
            yield chunk.batch(number)

    return encode


def _digest(chunks: pa.Table, answers: pa.Table) -> pa.Table:
    """Joins a chunk's texts with the totals of its pairs, which both sort alike."""
    pair, value = (answers.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("pair", "value"))
    value = value[np.argsort(pair)]
    docs = chunks.column("docs").combine_chunks().flatten()
    n_pairs = docs.field("n_pairs").to_numpy(zero_copy_only=False)
    n = int(n_pairs.sum())
    both = unpacked(chunks.column("packed")[0].as_py(), 2 * n)
    step, times = both[:n], both[n:]
    last = np.cumsum(n_pairs)
    sums = np.concatenate([[0], np.cumsum(step)])
    place = sums[1:] - np.repeat(sums[last - n_pairs], n_pairs)
    found = value[place] if n else step

    def per_doc(x: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(x)])
        return sums[last] - sums[last - n_pairs]

    sums = {"n_best": per_doc(times * (found & 1)), "count_sum": per_doc(times * (found >> 1))}
    columns = [pa.array(sums[c]) if c in sums else docs.field(c) for c in DIGESTS_ARROW.names]
    return pa.Table.from_arrays(columns, schema=DIGESTS_ARROW)


@dataclass
class Alignment:
    """chunks: digests and links of the texts, a chunk per row. counts: pair, a_id, b_id, links, best."""

    chunks: DataFrame
    counts: DataFrame

    def per_document(self) -> DataFrame:
        """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: a row per input row."""
        value = (F.col("links") * 2 + F.col("best").cast("long")).alias("value")
        asked = self.chunks.select(F.col("chunk").alias("asker"), F.explode("pair").alias("pair")).join(self.counts.select("pair", value), "pair")
        texts = self.chunks.select("chunk", "docs", "packed")
        return texts.groupBy("chunk").cogroup(asked.groupBy("asker")).applyInArrow(_digest, DIGESTS)


def align(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, chunk_chars: int = 6_000_000) -> Alignment:
    """Both tokenizers over every whole text, and how often each id of A and id of B overlap in all of them.

    Reads doc_id (cast to long) and text. Texts are encoded once, in chunks of about chunk_chars characters (or one text);
    a chunk writes its texts' digests and each distinct id pair once. Pairs are summed over chunks, and a chunk then asks
    for the totals of its own pairs by a join: no text is shuffled, and rows grow with the distinct pairs of the chunks.
    best: is a pair's count the highest of its B id (of equals, all)? The totals for each B id are at most as many as the
    vocabulary, so they are broadcast.
    Texts that have no tokens (see token_groups) get zeros and ''. Rows count one by one; ids may be null or repeat.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Files(Path(a_file).read_bytes(), Path(b_file).read_bytes()))
    chunks = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encoder(shared, chunk_chars), CHUNKS), "alignment-chunks")
    pairs = chunks.select(F.explode(F.arrays_zip("pair", "times")).alias("p")).groupBy("p.pair").agg(F.sum("p.times").alias("links"))
    pairs = stored(pairs.select("pair", F.shiftright("pair", LINK).cast("int").alias("a_id"), F.col("pair").bitwiseAND((1 << LINK) - 1).cast("int").alias("b_id"), "links"), "alignment-pairs")
    most = pairs.groupBy("b_id").agg(F.max("links").alias("most"))
    return Alignment(chunks, pairs.join(F.broadcast(most), "b_id").select("pair", "a_id", "b_id", "links", (F.col("links") == F.col("most")).alias("best")))
