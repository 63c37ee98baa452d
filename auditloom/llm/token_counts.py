"""Token counts of sections: whole documents are encoded once, token spans are joined to section spans."""

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pattern that splits texts before byte pairs are merged.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("most", "first")
RESULT = "array<struct<section: int, begin: int, end: int, n_tokens: long>>"


@lru_cache
def encoder(path: str, pattern: str):
    """The encoder, and the number of bytes of each token."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for piece, number in ranks.items():
        sizes[number] = len(piece)
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes


def line_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of lines; the line feed belongs to the line it ends."""
    ends = np.flatnonzero(data == 0x0A) + 1
    if len(data) and (not len(ends) or ends[-1] < len(data)):
        ends = np.append(ends, len(data))
    return np.concatenate([[0], ends[:-1]])[: len(ends)].astype(np.int64), ends.astype(np.int64)


def allot(begin: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray, rule: str) -> np.ndarray:
    """The section of each token, -1 outside all.

    begin and end are the tokens' byte spans, low and high those of the sections, in order and without overlap.
    `most`: a token belongs to the section that holds most of its bytes, of equals the first. `first`: to the first
    section that holds any of its bytes.
    """
    section = np.searchsorted(high, begin, "right")
    last = np.searchsorted(low, end, "left") - 1
    best = np.where(section <= last, section, -1)
    if rule == "most":
        open_ = np.flatnonzero(section < last)
        held = np.zeros(len(begin), np.int64)
        k = section.copy()
        while len(open_):
            part = np.minimum(end[open_], high[k[open_]]) - np.maximum(begin[open_], low[k[open_]])
            more = open_[part > held[open_]]
            held[more] = part[part > held[open_]]
            best[more] = k[more]
            k[open_] += 1
            open_ = open_[k[open_] <= last[open_]]
    return best


def section_tokens(
    docs: DataFrame, sections: Column | None = None, path: str = VOCABULARY, pattern: str = PATTERN, rule: str = "most"
) -> DataFrame:
    """Tokens of each section of each whole text.

    sections is a column of array<struct<begin: int, end: int>>: spans of code points, in order and without overlap;
    by default a section is a line with its line feed. A text is encoded as a whole, so a token may lie over the edge
    of two sections; rule says which one counts it (see allot). Tokens outside all sections count for section -1, so
    that the counts of a text add up to its tokens.

    Returns doc_id, section, begin, end (code points; null for section -1), n_tokens, doc_tokens. A null or empty text
    has no rows. Rows are taken one by one, so null or repeated ids, and further columns, change nothing.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")

    def rows(text: str, spans: list | None) -> list[dict]:
        data = text.encode()
        raw = np.frombuffer(data, np.uint8)
        encoding, sizes = encoder(path, pattern)
        end = np.cumsum(sizes[encoding.encode_ordinary(text)])
        begin = np.concatenate([[0], end[:-1]]).astype(np.int64)
        chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        if spans is None:
            low, high = line_spans(raw)
        else:
            points = np.array([(s["begin"], s["end"]) for s in spans], np.int64).reshape(-1, 2)
            low, high = np.searchsorted(chars, points, "left").T
        held = np.bincount(allot(begin, end, low, high, rule) + 1, minlength=len(low) + 1)
        out = [{"section": -1, "begin": None, "end": None, "n_tokens": int(held[0])}] if held[0] else []
        for k, (a, b, n) in enumerate(zip(chars[low].tolist(), chars[high].tolist(), held[1:].tolist(), strict=True)):
            out.append({"section": k, "begin": a, "end": b, "n_tokens": n})
        return out

    kind = pa.list_(pa.struct([("section", pa.int32()), ("begin", pa.int32()), ("end", pa.int32()), ("n_tokens", pa.int64())]))

    @F.arrow_udf(RESULT)
    def count_lines(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([rows(t.as_py(), None) if t.is_valid else [] for t in batch], kind)

    @F.arrow_udf(RESULT)
    def count_spans(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, spans in batches:
            yield pa.array([rows(t.as_py(), s.as_py() or []) if t.is_valid else [] for t, s in zip(texts, spans, strict=True)], kind)

    text = F.col("text")
    counted = count_lines(text) if sections is None else count_spans(text, sections)
    return (
        docs.select("doc_id", counted.alias("counted"))
        .withColumn("doc_tokens", F.aggregate("counted", F.lit(0).cast("long"), lambda n, s: n + s.n_tokens))
        .select("doc_id", F.explode("counted").alias("s"), "doc_tokens")
        .select("doc_id", "s.section", "s.begin", "s.end", "s.n_tokens", "doc_tokens")
    )
