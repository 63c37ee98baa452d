"""Per-client cooldown over a table of requests.

A request is admitted when its client has had none admitted in the last `seconds`; rejected requests do
not extend the wait. Which requests are admitted depends on the ones before, yet no client is gathered
in one task: requests are range-partitioned on (client, time), so a busy client spans many partitions.
Each partition is scanned twice in time order with constant state. The first scan sums up how a
partition moves the time until which its leading client is blocked, the sums are chained per client, and
the second scan starts every partition from the right state.
"""

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions import text as T
from auditloom.session import checkpoint

# task functions travel with the job, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TTL_SECONDS = 300
NEVER = np.iinfo(np.int64).min
PIECE_BITS = 16  # a piece has 2**PIECE_BITS rows at most


def client_key(forwarded: Column, peer: Column | None = None) -> Column:
    """First forwarded address, trimmed, else the peer address."""
    source = forwarded if peer is None else F.coalesce(forwarded, peer)
    return T.strip(F.substring_index(source, ",", 1))


def chain(times: np.ndarray, starts: np.ndarray, blocked: int, wait: int) -> tuple[np.ndarray, int]:
    """Admissions in one batch of times sorted within segments; `starts` are the first indexes of the
    segments and `blocked` bounds the first one. Gives the mask and the last segment's blocked-until."""
    n, sizes = len(times), np.diff(np.append(starts, len(times)))
    segment = np.repeat(np.arange(len(starts)), sizes)
    # put the segments on one axis, each far enough from the next for a wait not to reach it
    spans = times[starts + sizes - 1] - times[starts] + wait + 1
    scale = times - np.repeat(times[starts] - (np.cumsum(spans) - spans), sizes)
    mask = np.zeros(n, dtype=bool)
    current = starts.copy()
    current[0] = np.searchsorted(scale, min(max(blocked - int(times[0]), 0), int(spans[0]) - 1))
    owner = np.arange(len(starts))
    last = len(starts) - 1
    until = blocked if last == 0 else NEVER
    while len(current):
        inside = current < n
        inside[inside] = segment[current[inside]] == owner[inside]
        current, owner = current[inside], owner[inside]
        if not len(current):
            break
        mask[current] = True
        if owner[-1] == last:
            until = int(times[current[-1]]) + wait
        current = np.searchsorted(scale, scale[current] + wait)
    return mask, until


def _segments(keys: pd.Series) -> np.ndarray:
    values = keys.to_numpy()
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1])


def ranged_pieces(rows: DataFrame, keys: list[str], bits: int, partitions: int | None = None) -> DataFrame:
    """rows sorted by the keys over all partitions, with the number of their piece; numbers ascend in that order.

    Written once, so that all later steps see the same pieces.
    """
    ranged = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    piece = F.shiftright(F.monotonically_increasing_id(), bits)
    return checkpoint(ranged.sortWithinPartitions(*keys).withColumn("piece", piece))


def _whole_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = []
    for pdf in batches:
        cuts = np.append(_segments(pdf["piece"]), len(pdf)) if len(pdf) else []
        for low, high in zip(cuts[:-1], cuts[1:]):
            part = pdf.iloc[low:high]
            if held and held[-1]["piece"].iloc[0] != part["piece"].iloc[0]:
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(part)
    if held:
        yield pd.concat(held, ignore_index=True)


def _entries(wait: int):
    """(client, piece, entry, until) of each piece. `entry` is the latest time to be blocked until for the row to apply;
    `until` is the time until which the client is blocked behind the piece. The last client, if it is not the first,
    starts in the piece: its one row applies whatever came before."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole_pieces(batches):
            times, starts = pdf["at"].to_numpy(), _segments(pdf["client"])
            own = times[: starts[1]] if len(starts) > 1 else times
            # blocked by an earlier request: until a time within one wait of the first one here, or none of those
            entries = own[: np.searchsorted(own, own[0] + wait) + 1]
            exits = entries.copy()
            while True:
                at = np.searchsorted(own, exits)
                open_ = at < len(own)
                if not open_.any():
                    break
                exits[open_] = own[at[open_]] + wait
            # of neighbouring entries with one exit only the last is needed
            wanted = np.append(exits[1:] != exits[:-1], True)
            piece = int(pdf["piece"].iloc[0])
            yield pd.DataFrame({"client": pdf["client"].iloc[0], "piece": piece, "entry": entries[wanted], "until": exits[wanted]})
            if len(starts) > 1:
                last = times[starts[-1] :]
                _, until = chain(last, np.array([0]), NEVER, wait)
                yield pd.DataFrame({"client": [pdf["client"].iloc[-1]], "piece": [piece], "entry": [int(last[0])], "until": [until]})

    return scan


def next_at_or_after(points: DataFrame, probes: DataFrame, bits: int = PIECE_BITS) -> DataFrame:
    """client, at, next: for each distinct probe (client, at) its client's first point at or after it; without one, no row.

    Points and probes are sorted together into pieces. A probe finds its point in its own piece, or else at the fence: the
    first point of the client in a later piece. A window never holds more than a piece, or a row for each of a client's pieces.
    """
    both = points.select("client", "at", F.lit(1).alias("kind")).unionByName(probes.select("client", "at", F.lit(0).alias("kind"))).distinct()
    pieces = ranged_pieces(both, ["client", "at", "kind"], bits)
    point = F.when(F.col("kind") == 1, F.col("at"))
    later = Window.partitionBy("client", "piece").orderBy(F.desc("at"), F.desc("kind"))
    within = pieces.withColumn("next", F.last(point, ignorenulls=True).over(later)).where("kind = 0")
    behind = Window.partitionBy("client").orderBy("piece").rowsBetween(1, Window.unboundedFollowing)
    fences = pieces.groupBy("client", "piece").agg(F.min(point).alias("first_point"))
    fences = fences.withColumn("fence", F.first("first_point", ignorenulls=True).over(behind))
    found = within.join(fences.select("client", "piece", "fence"), ["client", "piece"])
    return found.select("client", "at", F.coalesce("next", "fence").alias("next")).where("next IS NOT NULL")


def taken_entries(entries: DataFrame, bits: int = PIECE_BITS) -> DataFrame:
    """client, entry, blocked: the entries that each client passes through, and until when it is blocked on arrival.

    Known at first is the first entry of each client. A jump leads from an entry 2**k entries ahead; a round joins the
    known ones with their jumps, and the jumps with themselves, so rounds grow with the logarithm of a client's entries.
    """
    found = next_at_or_after(entries.select("client", F.col("entry").alias("at")), entries.select("client", F.col("until").alias("at")), bits)
    pointers = entries.select("client", "entry", F.col("until").alias("at")).join(found, ["client", "at"])
    jumps = checkpoint(pointers.select("client", "entry", F.col("next").alias("to"), F.col("at").alias("blocked")))
    known = entries.groupBy("client").agg(F.min("entry").alias("entry")).withColumn("blocked", F.lit(NEVER))
    while True:
        steps = jumps.select("client", "entry", "to", F.col("blocked").alias("arrived"))
        reached = known.join(steps, ["client", "entry"]).select("client", F.col("to").alias("entry"), F.col("arrived").alias("blocked"))
        reached = checkpoint(reached)
        if reached.isEmpty():
            return known
        known = checkpoint(known.unionByName(reached))
        ahead = jumps.select("client", F.col("entry").alias("to"), F.col("to").alias("beyond"), F.col("blocked").alias("last"))
        jumps = checkpoint(jumps.join(ahead, ["client", "to"]).select("client", "entry", F.col("beyond").alias("to"), F.col("last").alias("blocked")))


def _admissions(wait: int):
    """The admitted instants of a piece. The first client starts from the state of its entry; without one it is blocked
    through the whole piece."""

    def scan(rows: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return rows[["client", "at", "event_id"]]
        rows = rows.sort_values(["client", "at"])
        times, starts = rows["at"].to_numpy(), _segments(rows["client"])
        state = states.loc[states["client"] == rows["client"].iloc[0], "blocked"]
        stop = starts[1] if len(starts) > 1 else len(times)
        mask, _ = chain(times, starts, int(state.iloc[0]) if len(state) else int(times[stop - 1]) + wait, wait)
        if not len(state):
            mask[:stop] = False
        return rows.loc[mask, ["client", "at", "event_id"]]

    return scan


def admitted_requests(
    requests: DataFrame, seconds: int = TTL_SECONDS, partitions: int | None = None, piece_bits: int = PIECE_BITS
) -> DataFrame:
    """Admitted requests of (client, ts, event_id) as client, at (microseconds), event_id; of equal times the lowest
    event_id goes first. Requests without a client are one client's; those without a time are never admitted.
    seconds is above 0."""
    if seconds <= 0:
        raise ValueError("a cooldown lasts longer than 0 seconds")
    wait = seconds * 1_000_000
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    client = F.coalesce(F.concat(F.lit("="), F.col("client")), F.lit(""))
    instants = requests.where("ts IS NOT NULL").groupBy(client.alias("client"), micros.alias("at")).agg(F.min("event_id").alias("event_id"))
    pieces = ranged_pieces(instants, ["client", "at"], piece_bits, partitions)
    entries = checkpoint(pieces.mapInPandas(_entries(wait), "client string, piece long, entry long, until long"))
    states = taken_entries(entries, piece_bits).join(entries.select("client", "entry", "piece"), ["client", "entry"])
    states = states.select(F.col("piece").alias("of_piece"), "client", "blocked")
    admitted = pieces.groupBy("piece").cogroup(states.groupBy("of_piece")).applyInPandas(_admissions(wait), "client string, at long, event_id long")
    return admitted.withColumn("client", F.when(F.col("client") != "", F.expr("substring(client, 2)")))


def cooldown_admit(
    requests: DataFrame, seconds: int = TTL_SECONDS, partitions: int | None = None, piece_bits: int = PIECE_BITS
) -> DataFrame:
    """All requests with their verdict in `admitted`."""
    winners = admitted_requests(requests, seconds, partitions, piece_bits).select(
        "event_id", F.lit(True).alias("admitted")
    )
    joined = requests.join(winners, "event_id", "left")
    return joined.withColumn("admitted", F.coalesce("admitted", F.lit(False)))
