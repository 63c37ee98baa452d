"""License scans: MinHash bands over overlapping windows find templates, exact shingle containment verifies them."""

import math
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.words import ALNUM, Texts, mix, shingles, span_hash, text_blocks

# Openings of public license texts and usual notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "GPL": "This work is licensed under the GNU General Public License, version 3",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "MIT": "Released under the MIT License",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}
SHINGLE = 5


def bands_needed(similarity: float, rows: int, miss: float) -> int:
    """Bands of so many rows with which a pair of this similarity is missed with probability `miss` at most."""
    return math.ceil(math.log(miss) / math.log(1 - similarity**rows))


@dataclass(frozen=True)
class ScanSettings:
    """containment: share of a template's shingles a window must hold. A band is one row: windows that share no
    shingle with a template then almost never collide, and those that do are few. miss bounds the probability that
    the bands overlook a window with that containment."""

    containment: float = 0.8
    rows: int = 1
    miss: float = 1e-4


@dataclass
class TemplateIndex:
    """Templates of one length: window size and step in shingles, bands, and for each band its sorted minima."""

    size: int
    step: int
    names: list[str]
    shingle_sets: list[np.ndarray]
    minima: np.ndarray  # template x hash function


def word_hashes(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of letters and digits, and their rows; the text should be in lower case."""
    begin, end, rows = texts.spans(ALNUM[texts.data])
    return span_hash(texts.prefix(), begin, end), rows


def rehashed(values: np.ndarray, k: int) -> np.ndarray:
    return mix(values ^ np.uint64((k + 1) * 0xA24BAED4963EE407 % (1 << 64)))


def build_index(templates: Mapping[str, str], settings: ScanSettings) -> list[TemplateIndex]:
    """Templates of fewer than five words can't be told from ordinary text and are refused."""
    by_size: dict[int, list[tuple[str, np.ndarray]]] = {}
    for name, text in templates.items():
        (block,) = text_blocks(pa.array([text.lower()]))
        hashes, rows = word_hashes(block)
        grams = np.unique(shingles(hashes, rows, SHINGLE)[0])
        if not len(grams):
            raise ValueError(f"template {name} has fewer than {SHINGLE} words")
        by_size.setdefault(len(grams), []).append((name, grams))
    out = []
    for n, group in sorted(by_size.items()):
        step = max(1, n // 4)
        size = n + step - 1  # every stretch of n shingles lies in some window
        least = math.ceil(settings.containment * n)
        bands = bands_needed(least / (size + n - least), settings.rows, settings.miss) if least < n + size - least else 1
        minima = np.array([[rehashed(g, k).min() for k in range(bands * settings.rows)] for _, g in group])
        out.append(TemplateIndex(size, step, [name for name, _ in group], [g for _, g in group], minima))
    return out


def window_candidates(index: TemplateIndex, grams: np.ndarray, begins: np.ndarray, ends: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(first shingle of window, template) where a whole band agrees.

    begins and ends: for each window its span in grams. Windows start every `step` shingles of a text; minima are taken
    per step and then over the steps of a window.
    """
    n_windows = len(begins)
    hit = np.zeros((len(index.names), n_windows), bool)
    for band in range(index.minima.shape[1] // rows):
        agree = np.ones_like(hit)
        for k in range(band * rows, (band + 1) * rows):
            values = rehashed(grams, k)
            steps = np.minimum.reduceat(values, begins)  # up to the next window's start
            low = steps.copy()
            for far in range(1, -(-index.size // index.step)):
                later = np.minimum(np.arange(n_windows) + far, n_windows - 1)
                inside = begins[later] < ends
                np.minimum(low, np.where(inside, steps[later], low), out=low)
            agree &= low[None, :] == index.minima[:, [k]]
        hit |= agree
    template, window = np.nonzero(hit)
    return window, template


def scan(texts: Texts, indexes: list[TemplateIndex], settings: ScanSettings) -> list[tuple[int, str, float, int, int]]:
    """(row, template, containment, first word, end word) of each text's best window for each template it holds."""
    hashes, word_rows = word_hashes(texts)
    grams, at = shingles(hashes, word_rows, SHINGLE)
    if not len(grams):
        return []
    rows = word_rows[at]
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    row_end = np.append(first[1:], len(grams))
    word_first = np.searchsorted(word_rows, rows[first])
    found: dict[tuple[int, str], tuple[float, int, int]] = {}
    for index in indexes:
        counts = -(-(row_end - first) // index.step)
        owner = np.repeat(np.arange(len(first)), counts)
        begins = first[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * index.step
        ends = np.minimum(begins + index.size, row_end[owner])
        for w, t in zip(*window_candidates(index, grams, begins, ends, settings.rows), strict=True):
            own = grams[begins[w] : ends[w]]
            inside = np.flatnonzero(np.isin(own, index.shingle_sets[t]))
            share = len(np.unique(own[inside])) / len(index.shingle_sets[t])
            if share < settings.containment:
                continue
            o = owner[w]
            span = at[begins[w] + inside[[0, -1]]] - word_first[o]
            key = (int(rows[first[o]]), index.names[t])
            old = found.get(key)
            if old is None or (-share, span[0]) < (-old[0], old[1]):
                found[key] = (float(share), int(span[0]), int(span[1]) + SHINGLE)
    return [(row, name, *rest) for (row, name), rest in sorted(found.items())]


def scan_licenses(
    docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, settings: ScanSettings = ScanSettings()
) -> DataFrame:
    """License templates in whole texts: doc_id, license, containment, first_word, end_word (of the best, first window).

    Words are runs of letters and digits in lower case. A row per input row and template it holds; texts without any,
    and null texts, have none. templates is a small mapping that goes to every task.
    """
    indexes = build_index(templates, settings)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            out = [
                (ids[block.first + row].as_py(), *rest)
                for block in text_blocks(batch.column(1))
                for row, *rest in scan(block, indexes, settings)
            ]
            frame = pd.DataFrame(out, columns=["doc_id", "license", "containment", "first_word", "end_word"], dtype=object)
            yield pa.RecordBatch.from_pandas(frame, schema, preserve_index=False)

    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("containment", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64())])
    return docs.select(F.col("doc_id").cast("long"), F.lower("text").alias("text")).mapInArrow(
        find, "doc_id long, license string, containment double, first_word long, end_word long"
    )
