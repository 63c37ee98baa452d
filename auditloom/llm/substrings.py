"""Exact removal of long repeated byte strings: sampled anchors bring equal strings together, run-compressed
Burrows-Wheeler indexes of the anchors' contexts find the matches."""

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.store import own_columns_aside, stored
from auditloom.llm.words import Texts, mix, span_hash, text_blocks

SYMBOLS = 6  # bytes, or terminators, that one number holds
SPANS = "array<struct<a: int, b: int>>"


@dataclass(frozen=True)
class RepeatSettings:
    """length: bytes of a string that counts as repeated. anchor: bytes of an anchor. index_bytes: contexts indexed at
    a time. group: contexts of one anchor that are indexed together; larger groups are split by longer anchors."""

    length: int = 200
    anchor: int = 50
    index_bytes: int = 1 << 19
    group: int = 2000


def anchors(texts: Texts, s: RepeatSettings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors, the hash of each, and running sums for further hashes.

    Each string of s.length bytes has one anchor: the part of s.anchor bytes whose hash is least, of equals the first.
    That depends on the string alone, so equal strings have equal anchors at the same distance from their start.
    """
    n, reach = len(texts.data), s.length - s.anchor + 1
    prefix = texts.prefix()
    if n < s.length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), prefix
    at = np.arange(n - s.anchor + 1)
    hashes = span_hash(prefix, at, at + s.anchor)
    # half of the hash and the place in one number: the least is the first of the least
    packed = (hashes & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    tiles = np.append(packed, np.full(-len(packed) % reach, np.iinfo(np.uint64).max)).reshape(-1, reach)
    up = np.minimum.accumulate(tiles, axis=1).ravel()
    down = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - s.length + 1
    least = np.minimum(down[:starts], up[reach - 1 : reach - 1 + starts])
    edges = np.zeros(n + 1, np.int64)
    long = np.diff(texts.starts) >= s.length
    np.add.at(edges, texts.starts[:-1][long], 1)
    np.add.at(edges, texts.starts[1:][long] - s.length + 1, -1)
    inside = np.flatnonzero(np.cumsum(edges)[:starts])  # starts of strings that lie in one text
    if not len(inside):
        return inside, np.zeros(0, np.uint64), prefix
    place = (least[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    place = place[np.concatenate([[True], place[1:] != place[:-1]])]
    return place, hashes[place], prefix


def contexts(texts: Texts, place: np.ndarray, s: RepeatSettings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, begin and end of what the strings around each anchor can cover."""
    row = np.searchsorted(texts.starts, place, "right") - 1
    begin = np.maximum(texts.starts[row], place - (s.length - s.anchor))
    return row, begin, np.minimum(texts.starts[row + 1], place + s.length)


def row_key(doc_id: Column, text: Column) -> Column:
    """The id; a null id counts as a hash of the text, above all ids."""
    return F.coalesce(doc_id.cast("long"), F.xxhash64(text).bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62))


def keyed(docs: DataFrame) -> DataFrame:
    """docs and the two never-null columns that tell rows apart; rows that share both have the same text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn("_row_key", row_key(F.col("doc_id"), text)).withColumn("_text_key", F.xxhash64(text, F.lit(8)))


# ---- index of contexts ----


def suffix_order(data: np.ndarray, starts: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of strings, group by group in lexicographic order, and for each place its next six symbols as a number.

    String k is data[starts[k]:starts[k + 1]]; it ends with a terminator of its own, less than any byte and less than
    those of later strings. Ranks by six symbols are doubled until all differ; a suffix that is alone isn't sorted again.
    """
    n, sizes = len(data), np.diff(starts)
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    left = (starts[1:][owner] - np.arange(n)).astype(np.int32)  # bytes up to the string's end
    pad = np.zeros(n + SYMBOLS, np.int64)
    pad[:n] = data
    pad[:n] += 1
    two = np.where(left > 1, pad[1 : n + 1], 0) | pad[:n] << 9
    two = np.append(two, np.zeros(SYMBOLS, np.int64))
    packed = two[:n] << 36
    packed |= np.where(left > 2, two[2 : n + 2], 0) << 18
    packed |= np.where(left > 4, two[4 : n + 4], 0)
    order = np.argsort(packed)
    small = groups.astype(np.uint16 if len(groups) < 1 << 16 else np.int32)
    order = order[np.argsort(small[owner[order]], kind="stable")].astype(np.int32)
    key, group = packed[order], groups[owner[order]]
    new = np.ones(n, bool)
    new[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
    rank = np.empty(n, np.int32)
    slot = np.arange(n, dtype=np.int32)
    base = np.maximum.accumulate(np.where(new, slot, 0))
    rank[order] = base
    open_ = ~(new & np.append(new[1:], True))
    at, base, step = order[open_], base[open_], SYMBOLS
    wide = np.int64(n + len(sizes) + 1)
    while len(at):
        ahead = at + np.int32(step)
        ended = left[at] <= step
        ahead[ended] = 0
        then = rank[ahead] + np.int32(len(sizes))
        then[ended] = owner[at[ended]]
        key = base * wide + then
        by = np.argsort(key)
        at, key, base = at[by], key[by], base[by]
        new_group = np.ones(len(at), bool)
        new_group[1:] = base[1:] != base[:-1]
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        slot = np.arange(len(at), dtype=np.int32)
        base = base + np.maximum.accumulate(np.where(new, slot, 0)) - np.maximum.accumulate(np.where(new_group, slot, 0))
        rank[at] = base
        open_ = ~(new & np.append(new[1:], True))
        at, base = at[open_], base[open_]
        step *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out, packed


@dataclass
class RunIndex:
    """Run-compressed transform of a set of strings: for the head of each run of equal symbols, the place of its
    suffix, and the symbols this shares with the suffix before it."""

    heads: np.ndarray
    shared: np.ndarray

    @classmethod
    def build(cls, data: np.ndarray, starts: np.ndarray, groups: np.ndarray, order: np.ndarray, packed: np.ndarray) -> "RunIndex":
        owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        opens = np.zeros(len(data), bool)
        opens[starts[:-1]] = True
        symbol = data[np.maximum(order - 1, 0)]
        # a terminator before a suffix equals no other symbol
        head = np.ones(len(order), bool)
        head[1:] = (symbol[1:] != symbol[:-1]) | opens[order[1:]] | opens[order[:-1]]
        k = np.flatnonzero(head)
        place, before = order[k], order[np.maximum(k - 1, 0)]
        most = np.minimum(starts[1:][owner[place]] - place, starts[1:][owner[before]] - before)
        most = np.where((k > 0) & (groups[owner[place]] == groups[owner[before]]), most, 0)
        shared = np.zeros(len(k), np.int64)
        live = np.flatnonzero(most > 0)
        while len(live):
            a, b = place[live] + shared[live], before[live] + shared[live]
            differ = packed[a] ^ packed[b]
            # equal ones of the next symbols, nine bits each
            same = sum(((differ >> (9 * j)) == 0).astype(np.int64) for j in range(SYMBOLS))
            shared[live] = np.minimum(shared[live] + same, most[live])
            live = live[(same == SYMBOLS) & (shared[live] < most[live])]
        return cls(place, shared)

    def stream(self, n: int) -> np.ndarray:
        """For every place, from left to right, the symbols it shares with the suffix before it in order.

        From one place to the next this falls by one, except at the sampled heads, where it may rise.
        """
        reach = np.zeros(n, np.int64)
        reach[self.heads] = self.heads + self.shared
        return np.maximum(np.maximum.accumulate(reach) - np.arange(n), 0)


def repeated_starts(data: np.ndarray, starts: np.ndarray, groups: np.ndarray, origin: np.ndarray, often: np.ndarray, length: int) -> np.ndarray:
    """Places in the strings at which `length` bytes start that also start elsewhere in the corpus.

    origin: a number for each string that tells where in the corpus its first byte stands; two strings of a group may
    show the same stretch of one text, which is no repeat. often: whether a string itself occurs twice.
    """
    order, packed = suffix_order(data, starts, groups)
    lcp = RunIndex.build(data, starts, groups, order, packed).stream(len(data))[order]
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    joined = lcp >= length
    tied = np.flatnonzero(joined | np.append(joined[1:], False))
    if not len(tied):
        return tied
    cut = np.flatnonzero(~joined[tied])  # an interval starts where a suffix shares too little with the one before
    at = order[tied]
    where = origin[owner[at]] + (at - starts[owner[at]]).astype(np.uint64)
    low, high = np.minimum.reduceat(where, cut), np.maximum.reduceat(where, cut)
    twice = np.logical_or.reduceat(often[owner[at]], cut)
    sizes = np.diff(np.append(cut, len(tied)))
    return np.sort(at[np.repeat((low != high) | twice, sizes)])


def united(spans: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of the spans (a, b) of each row: begins, ends, and where each row's part of them starts. Null has none."""
    counts = spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = spans.flatten()
    begin, end = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("a", "b"))
    owner = np.repeat(np.arange(len(spans)), counts)
    by = np.lexsort((begin, owner))
    begin, end = begin[by], end[by]
    # the furthest end so far; rows lie further apart than any end
    apart = owner * (int(end.max(initial=0)) + 1)
    reach = np.maximum.accumulate(apart + end)
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (begin[1:] + apart[1:] > reach[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(owner)) - 1 if len(owner) else first
    return begin[first], (reach - apart)[last], np.concatenate([[0], np.cumsum(np.bincount(owner[first], minlength=len(spans)))])


# ---- Spark ----

OCCURRENCES = "anchor long, context long, _row_key long, _text_key long, place int, lead int, size int"


def _repeated_occurrences(docs: DataFrame, s: RepeatSettings) -> DataFrame:
    """All anchors that occur more than once: anchor, context (hash), the row, place (of the context), lead, size."""

    def only_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(anchors(block, s)[1].view(np.int64))], ["anchor"])

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in OCCURRENCES.split(", ")]
        for batch in batches:
            _row_key, _text_key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for block in text_blocks(batch.column(2)):
                place, hashes, prefix = anchors(block, s)
                row, begin, end = contexts(block, place, s)
                lead = place - begin
                context = mix(span_hash(prefix, begin, end) ^ (lead + 1).astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(hashes.view(np.int64)), pa.array(context.view(np.int64)), pa.array(_row_key[block.first + row]),
                        pa.array(_text_key[block.first + row]), pa.array((begin - block.starts[row]).astype(np.int32)),
                        pa.array(lead.astype(np.int32)), pa.array((end - begin).astype(np.int32)),
                    ],
                    names,
                )

    counts = docs.select("text").mapInArrow(only_hashes, "anchor long").groupBy("anchor").agg(F.count("*").alias("n"))
    often = stored(counts.where("n > 1").select("anchor"), "repeat-anchors")
    found = docs.select("_row_key", "_text_key", "text").mapInArrow(full, OCCURRENCES)
    return stored(found.join(often, "anchor"), "repeat-occurrences")


CUTS = 4096  # contexts cut at a time
CUT = "context long, anchor long, root long, lead int, n long, origin long, lo int, hi int, text binary"


def _signed(x: int) -> int:
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def _cut(docs: DataFrame, wanted: DataFrame, s: RepeatSettings) -> DataFrame:
    """The bytes of one occurrence of each wanted context."""
    per_row = wanted.groupBy(F.col("at._row_key").alias("_row_key"), F.col("at._text_key").alias("_text_key")).agg(
        F.collect_list(F.struct("context", "anchor", "n", F.col("at.place").alias("place"), "lead", "size")).alias("_parts")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column("_parts")
            texts = batch.column("text").cast(pa.large_binary()).fill_null(b"")
            edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            row = np.repeat(np.arange(len(parts)), parts.value_lengths().to_numpy(zero_copy_only=False))
            keys = [batch.column(c).to_numpy().view(np.uint64) for c in ("_row_key", "_text_key")]
            origin = (mix(keys[0]) + mix(keys[1]))[row]
            flat = parts.flatten()
            place, size, lead = (flat.field(c).to_numpy().astype(np.int64) for c in ("place", "size", "lead"))
            origin = (origin + place.astype(np.uint64)).view(np.int64)
            for low in range(0, len(row), CUTS):
                here = slice(low, low + CUTS)
                ends = np.concatenate([[0], np.cumsum(size[here])])
                at = np.arange(ends[-1]) + np.repeat(edges[row[here]] + place[here] - ends[:-1], size[here])
                text = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data[at])])
                context, anchor, n = (flat.field(c).slice(low, CUTS) for c in ("context", "anchor", "n"))
                first = lead[here].astype(np.int32)
                columns = [context, anchor, anchor, pa.array(first), n, pa.array(origin[here]), pa.array(first), pa.array(first + np.int32(s.anchor)), text]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in CUT.split(", ")])

    return docs.join(per_row, ["_row_key", "_text_key"]).mapInArrow(cut, CUT)


def _longer_anchors(s: RepeatSettings):
    """Strings around an anchor hold more of it on the left or on the right: two longer anchors take its place.

    text is cut to what strings with the longer anchor can cover, and context is the hash of what is left; source is
    the context it was cut from, shift where it starts in it.
    """
    kinds = {"context": pa.int64(), "anchor": pa.int64(), "root": pa.int64(), "lead": pa.int32(), "n": pa.int64(), "origin": pa.int64(), "lo": pa.int32(), "hi": pa.int32(), "text": pa.binary(), "source": pa.int64(), "shift": pa.int32()}
    schema = pa.schema(list(kinds.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch), 1000):
                out = []
                for r in batch.slice(begin, 1000).to_pylist():
                    more = (s.length - (r["hi"] - r["lo"]) + 1) // 2
                    for lo, hi in ((r["lo"] - more, r["hi"]), (r["lo"], r["hi"] + more)):
                        cut = max(0, hi - s.length)
                        text = r["text"][cut : lo + s.length]
                        if lo < 0 or hi > len(r["text"]) or len(text) < s.length:
                            continue
                        # the first anchor and its place stay part of the keys, as they keep equal strings apart
                        mark = f"{r['root']},{r['lead'] - lo}".encode()
                        key = hashlib.blake2b(r["text"][lo:hi], digest_size=8, key=mark).digest()
                        own = hashlib.blake2b(text, digest_size=8, key=mark + f",{hi - lo},{lo - cut}".encode()).digest()
                        out.append({
                            "context": int.from_bytes(own, "big", signed=True), "anchor": int.from_bytes(key, "big", signed=True),
                            "root": r["root"], "lead": r["lead"] - cut, "n": r["n"], "origin": _signed(r["origin"] + cut),
                            "lo": lo - cut, "hi": hi - cut, "text": text, "source": r["context"], "shift": cut,
                        })
                yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _match(parts: DataFrame, s: RepeatSettings) -> DataFrame:
    """context, spans: what of each context starts elsewhere too. parts has the columns of CUT; anchor is the group."""

    def match(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        texts = rows.column("text").combine_chunks().cast(pa.large_binary())
        edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
        starts = edges - edges[0]
        context, anchor, origin, n = (rows.column(c).to_numpy() for c in ("context", "anchor", "origin", "n"))
        groups = np.unique(anchor, return_inverse=True)[1]
        found = repeated_starts(data, starts, groups, origin.view(np.uint64), n > 1, s.length)
        owner = np.searchsorted(starts, found, "right") - 1
        # strings of one length in order: a span ends where the next one starts behind it, or in another context
        fresh = np.ones(len(found), bool)
        fresh[1:] = (owner[1:] != owner[:-1]) | (found[1:] > found[:-1] + s.length)
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(found)) - 1 if len(found) else first
        of, begin, end = owner[first], found[first] - starts[owner[first]], found[last] + s.length - starts[owner[first]]
        own, counts = np.unique(of, return_counts=True)
        spans = pa.StructArray.from_arrays([pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32))], ["a", "b"])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), spans)
        return pa.table({"context": context[own], "spans": lists})

    return parts.groupBy("bucket").applyInArrow(match, f"context long, spans {SPANS}")


def repeated_spans(docs: DataFrame, s: RepeatSettings = RepeatSettings()) -> DataFrame:
    """_row_key, _text_key, spans: bytes of each text covered by strings that start anywhere else too; docs is keyed()."""
    seen = _repeated_occurrences(docs, s)
    distinct = seen.groupBy("context").agg(
        F.first("anchor").alias("anchor"), F.count("*").alias("n"), F.first("lead").alias("lead"), F.first("size").alias("size"),
        F.min(F.struct("_row_key", "_text_key", "place")).alias("at"),
    )
    distinct = stored(distinct, "repeat-contexts")
    per_anchor = distinct.groupBy("anchor").agg(F.count("*").alias("n_contexts"))
    some = distinct.join(per_anchor.where("n_contexts > 1"), "anchor")
    facts = some.agg(F.sum("size").alias("bytes"), F.max("n_contexts").alias("most")).first()
    # a context that occurs twice is repeated as a whole
    whole = distinct.where("n > 1").select("context", F.array(F.struct(F.lit(0).alias("a"), F.col("size").alias("b"))).alias("spans"))
    verdicts = whole
    if facts["bytes"]:
        parts = _cut(docs, some.where(F.col("n_contexts") <= s.group), s)
        found, places = None, None
        if facts["most"] > s.group:
            split, found, places = _split(_cut(docs, some.where(F.col("n_contexts") > s.group), s), s)
            parts = parts.unionByName(split)
        n_buckets = -(-facts["bytes"] // s.index_bytes)
        matched = _match(parts.withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(n_buckets))), s)
        if places is not None:
            shifted = F.transform("spans", lambda x: F.struct((x.a + F.col("shift")).alias("a"), (x.b + F.col("shift")).alias("b")))
            matched = matched.unionByName(found).join(places, "context", "left").select(
                F.coalesce("top", "context").alias("context"), F.when(F.col("top").isNull(), F.col("spans")).otherwise(shifted).alias("spans")
            )
        verdicts = verdicts.unionByName(matched)
    # several cuts of a context may each have found something: one row per context, spans joined
    united = verdicts.groupBy("context").agg(F.flatten(F.collect_list("spans")).alias("spans")).withColumn("spans", _united()(F.col("spans")))
    here = F.transform("spans", lambda x: F.struct((x.a + F.col("place")).alias("a"), (x.b + F.col("place")).alias("b")))
    marks = seen.join(united, "context").select("_row_key", "_text_key", here.alias("spans"))
    return marks.groupBy("_row_key", "_text_key").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _united():
    """A column function: the union of a list of spans."""

    @F.arrow_udf(SPANS)
    def unite(spans: pa.Array) -> pa.Array:
        begin, end, edges = united(spans)
        parts = pa.StructArray.from_arrays([pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32))], ["a", "b"])
        return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), parts)

    return unite


def _split(parts: DataFrame, s: RepeatSettings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Anchors with very many contexts: longer anchors split them, until all groups are small.

    With each step contexts are cut to what the longer anchor can cover, and those that are alike from then on are
    one. Inside a passage that many texts share they soon all are; at its ends few strings still share an anchor.
    Returns the contexts in small groups; (context, spans) of those that are repeated as a whole; and places: top, the
    context in the corpus that a later context was cut from, and shift, where in it.
    """
    parts = stored(parts, "repeat-hot")
    tops = parts.select(F.col("context").alias("top"), "n")
    places = parts.select(F.col("context").alias("top"), "context", F.lit(0).alias("shift"))
    small, whole, all_places = parts.where("false"), [], []
    while True:
        cut = stored(parts.mapInArrow(_longer_anchors(s), CUT + ", source long, shift int"), "repeat-cut")
        moved = cut.select("source", F.col("context").alias("to"), F.col("shift").alias("by"))
        places = stored(
            places.join(moved, places["context"] == moved["source"]).select("top", F.col("to").alias("context"), (F.col("shift") + F.col("by")).alias("shift")).distinct(),
            "repeat-places",
        )
        all_places.append(places)
        uses = places.join(tops, "top").groupBy("context").agg(F.sum("n").alias("n"))
        one = cut.groupBy("context").agg(*[F.min_by(c, "origin").alias(c) for c in ("anchor", "root", "lead", "lo", "hi", "text")], F.min("origin").alias("origin"))
        now = stored(one.join(uses, "context"), "repeat-split")
        sized = now.join(now.groupBy("anchor").agg(F.count("*").alias("members")), "anchor")
        whole.append(now.where("n > 1").select("context", F.array(F.struct(F.lit(0).alias("a"), F.length("text").alias("b"))).alias("spans")))
        columns = [c.split()[0] for c in CUT.split(", ")]
        small = small.unionByName(sized.where((F.col("members") > 1) & (F.col("members") <= s.group)).select(*columns))
        parts = stored(sized.where(F.col("members") > s.group).select(*columns), "repeat-hot")
        if parts.isEmpty():
            break
    found, where = whole[0], all_places[0]
    for more, also in zip(whole[1:], all_places[1:], strict=True):
        found, where = found.unionByName(more), where.unionByName(also)
    return small, found, where


@own_columns_aside("doc_id", "text")
def with_repeats(docs: DataFrame, column: str = "repeats", s: RepeatSettings = RepeatSettings()) -> DataFrame:
    """docs and one more column, array<struct<a, b>>: the spans of bytes of each whole text, in UTF-8, that are covered
    by a string of s.length bytes which also starts anywhere else in docs, the same text included. Null: none.

    Matches never cross texts and are judged on the input. Repeated rows repeat each other. Only anchors that occur
    twice, and of these one copy of each distinct context, are compared; contexts are grouped by anchor and indexed in
    buckets of bounded size.
    """
    # both joins of the texts deal them out alike, so that they are shuffled once
    rows = keyed(docs.drop(column))
    spans = repeated_spans(rows, s).withColumnRenamed("spans", column)
    return rows.join(spans, ["_row_key", "_text_key"], "left").select(*[c for c in docs.columns if c != column], column)


def kept_bytes(texts: pa.Array, spans: pa.Array) -> Iterator[tuple[bytes, int, int]]:
    """What is left of each text, bytes removed, and runs removed."""
    begin, end, edges = (x.tolist() for x in united(spans))
    for text, low, high in zip(texts, edges[:-1], edges[1:], strict=True):
        data = (text.as_py() or "").encode()
        left, at = [], 0
        for a, b in zip(begin[low:high], end[low:high], strict=True):
            left.append(data[at:a])
            at = b
        yield b"".join([*left, data[at:]]) if left else data, sum(end[low:high]) - sum(begin[low:high]), high - low


def removal_digest(text: Column, spans: Column) -> Column:
    """struct<n_bytes, n_removed, n_spans, kept_sha256> of a text and its repeated spans."""
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]

    @F.arrow_udf("struct<n_bytes: long, n_removed: long, n_spans: long, kept_sha256: string>")
    def digest(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = [(len(left) + removed, removed, runs, hashlib.sha256(left).hexdigest()) for left, removed, runs in kept_bytes(texts, spans)]
        columns = list(zip(*out, strict=True)) or [[]] * len(names)
        return pa.StructArray.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names)

    return digest(text, spans)


def remaining_text(text: Column, spans: Column) -> Column:
    """What is left of a text; a character of which a byte was removed goes as a whole."""

    @F.arrow_udf("string")
    def remaining(texts: pa.Array, spans: pa.Array) -> pa.Array:
        left = [left.decode(errors="ignore") if t.is_valid else None for t, (left, _, _) in zip(texts, kept_bytes(texts, spans), strict=True)]
        return pa.array(left, pa.string())

    return remaining.asNondeterministic()(text, spans)


@own_columns_aside("doc_id", "text")
def without_repeats(docs: DataFrame, s: RepeatSettings = RepeatSettings(), changed: str | None = None) -> DataFrame:
    """docs with repeated bytes taken out of text; a text of which no word is left goes, a text that had none stays.

    changed: name of a further boolean column that tells whether text lost anything.
    """
    marked = with_repeats(docs, "__spans", s)
    hit = F.col("__spans").isNotNull()
    cut = marked.withColumn("__left", F.when(hit, remaining_text(F.col("text"), F.col("__spans"))).otherwise(F.col("text")))
    cut = cut.where(~hit | F.col("__left").rlike("[^\\x20\\x09-\\x0D]")).withColumn("text", F.col("__left"))
    if changed:
        cut = cut.withColumn(changed, hit)
    return cut.drop("__spans", "__left")
