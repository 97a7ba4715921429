"""Licence scan: winnowed fingerprints find candidate templates, banded alignment measures what of them a text has."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflux.llm.arrowmap import map_texts
from folioflux.llm.license_templates import TEMPLATES
from folioflux.llm.wordarrays import slices, words_of
from folioflux.sources.tables import load

#: Words of a gram, and grams of a winnowing window: a shared run of GRAM + WINDOW - 1 words shares a fingerprint.
GRAM, WINDOW = 3, 3
#: Words by which an alignment may drift from the diagonals of its fingerprints: a quarter of the template, so much at
#: most. Copies of a template in one text are further apart than that.
BAND = 12
#: Share of a template's words that must be matched, in order, to report it.
COVERAGE = 0.8

FIELDS = "matches array<struct<template:string,coverage:double,matched:long,first_word:long,last_word:long,start:long,end:long>>"


def gram_hashes(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the grams of each text's words, and the word each begins with."""
    if len(h) < GRAM:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    with np.errstate(over="ignore"):
        g = h[: len(h) - GRAM + 1].copy()
        for k in range(1, GRAM):
            g = g * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - GRAM + 1 + k]
        g ^= g >> np.uint64(31)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.flatnonzero(doc[: len(g)] == doc[GRAM - 1 :])
    return g[at], at


def winnow(g: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Places of the grams that are the least of some window of WINDOW grams of their text; all of shorter texts."""
    n = len(g)
    if not n:
        return np.zeros(0, dtype=np.int64)
    kept = np.zeros(n, dtype=bool)
    count = np.bincount(doc)
    kept[count[doc] < WINDOW] = True
    if n >= WINDOW:
        views = [g[k : n - WINDOW + 1 + k] for k in range(WINDOW)]
        least = np.minimum.reduce(views)
        whole = doc[: n - WINDOW + 1] == doc[WINDOW - 1 :]
        for k, v in enumerate(views):
            kept[k : n - WINDOW + 1 + k] |= whole & (v == least)
    return np.flatnonzero(kept)


@dataclass
class Index:
    """The inverted index: fingerprints, sorted, with template and place of each, and each template's word hashes."""

    names: list[str]
    words: list[np.ndarray]
    print: np.ndarray
    template: np.ndarray
    place: np.ndarray
    maybe: np.ndarray


def build_index(templates: dict[str, str]) -> Index:
    names = sorted(n for n, t in templates.items() if t)
    words, prints, which, places = [], [], [], []
    for k, name in enumerate(names):
        for _, _, data, offsets in slices(pa.array([templates[name].encode()], type=pa.large_binary())):
            w = words_of(data, offsets)
            h = w.hashes()
            words.append(h)
            g, at = gram_hashes(h, w.bounds)
            prints.append(g)  # every gram of a template: whichever of them a text keeps is met
            places.append(at)
            which.append(np.full(len(g), k))
    flat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, dtype=t)
    g, t, p = flat(prints, np.uint64), flat(which, np.int64), flat(places, np.int64)
    order = np.argsort(g, kind="stable")
    maybe = np.zeros(1 << 16, dtype=bool)
    maybe[(g & np.uint64(0xFFFF)).astype(np.int64)] = True
    return Index(names, words, g[order], t[order], p[order], maybe)


def align(text: np.ndarray, template: np.ndarray, low: int, high: int, allowed: np.ndarray | None = None) -> tuple[int, int, int]:
    """The longest common subsequence of a template's words and a text's, on diagonals (text minus template) low to high:
    words matched, and the first and last of the text that match. Ends are free; rows of the band are kept to go back.
    `allowed` says on which of the diagonals words may match, all by default."""
    width = high - low + 1
    rows = np.zeros((len(template) + 1, width + 2), dtype=np.int32)
    equal = np.zeros((len(template), width), dtype=bool)
    for i, word in enumerate(template):
        j = np.arange(i + low, i + high + 1)
        inside = (j >= 0) & (j < len(text))
        equal[i] = inside & (text[np.clip(j, 0, len(text) - 1)] == word)
        if allowed is not None:
            equal[i] &= allowed
        best = np.maximum(rows[i, 1 : width + 1] + equal[i], rows[i, 2 : width + 2])
        rows[i + 1, 1 : width + 1] = np.maximum.accumulate(best)
        rows[i + 1, width + 1] = 0
    i, c = len(template), int(rows[-1, 1 : width + 1].argmax())
    matched, first, last = int(rows[-1, c + 1]), -1, -1
    while i > 0 and rows[i, c + 1] > 0:
        if c > 0 and rows[i, c] == rows[i, c + 1]:
            c -= 1
        elif equal[i - 1, c] and rows[i, c + 1] == rows[i - 1, c + 1] + 1:
            first = i - 1 + low + c
            last = max(last, first)
            i -= 1
        else:
            i, c = i - 1, c + 1
    return matched, first, last


def chains(clusters: list[tuple[int, int, int, int, int]], length: int) -> list[list[int]]:
    """Stretches of fingerprints (first and last place in the text, first and last in the template, how many) that continue
    each other in both orders, with less than a template's length of text between: the chains with most fingerprints, each
    stretch in one of them, and of two or more stretches."""
    order = sorted(range(len(clusters)), key=lambda c: clusters[c][0])
    most, before = {}, {}
    longest = max((b - a for a, b, *_ in clusters), default=0)
    for at, c in enumerate(order):
        most[c], before[c] = clusters[c][4], -1
        options = []
        for p in reversed(order[:at]):
            if clusters[p][0] + longest + GRAM + length <= clusters[c][0]:
                break
            gap = clusters[c][0] - clusters[p][1] - GRAM
            later = all(x < y for x, y in zip(clusters[p][:4], clusters[c][:4], strict=True))
            if later and gap < length and gap > -2 * GRAM and clusters[p][3] < clusters[c][2] + GRAM:
                options.append((-most[p], gap, p))
        if options:
            best = min(options)
            most[c], before[c] = most[c] - best[0], best[2]
    used, found = set(), []
    for c in sorted(order, key=lambda c: -most[c]):
        chain = []
        while c >= 0 and c not in used:
            used.add(c)
            chain.append(c)
            c = before[c]
        if len(chain) > 1:
            found.append(chain[::-1])
    return found


def scan_slice(index: Index, data: np.ndarray, offsets: np.ndarray, coverage: float) -> pa.Array:
    words = words_of(data, offsets)
    h = words.hashes()
    g, at = gram_hashes(h, words.bounds)
    kept = winnow(g, words.doc[at])
    kept = kept[index.maybe[(g[kept] & np.uint64(0xFFFF)).astype(np.int64)]]
    low, high = np.searchsorted(index.print, g[kept], "left"), np.searchsorted(index.print, g[kept], "right")
    n = high - low
    hit = np.repeat(low, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    place, template = np.repeat(at[kept], n), index.template[hit]
    doc, diagonal = words.doc[place], place - index.place[hit]
    order = np.lexsort((place, diagonal, template, doc))
    band = np.array([max(1, min(BAND, len(w) // 4)) for w in index.words], dtype=np.int64)
    found, clusters = [], {}
    # a cluster: fingerprints of one text and template on diagonals that follow each other within the band
    for part in np.split(order, np.flatnonzero((np.diff(doc[order]) != 0) | (np.diff(template[order]) != 0) | (np.diff(diagonal[order]) > band[template[order[:-1]]])) + 1):
        if not len(part):
            continue
        d, t = int(doc[part[0]]), int(template[part[0]])
        a, b = int(diagonal[part].min() - band[t]), int(diagonal[part].max() + band[t])
        begin = max(int(words.bounds[d]), a)
        end = min(int(words.bounds[d + 1]), b + len(index.words[t]) + 1)
        matched, first, last = align(h[begin:end], index.words[t], a - begin, b - begin)
        share = matched / len(index.words[t])
        if share >= coverage:
            found.append((d, -share, -matched, begin + first, begin + last, t))
        # its stretches: fingerprints that follow each other on one diagonal
        for run in np.split(part, np.flatnonzero((np.diff(diagonal[part]) != 0) | (np.diff(place[part]) > GRAM + WINDOW)) + 1):
            x, y, off = int(place[run[0]]), int(place[run[-1]]), int(diagonal[run[0]])
            clusters.setdefault((d, t), []).append(((x, y, x - off, y - off, len(run)), a, b))
    # what was put in or left out between two clusters is no part of the template: a chain is aligned in the bands of its clusters
    for (d, t), own in clusters.items():
        for chain in chains([c[0] for c in own], len(index.words[t])) if len(own) > 1 else []:
            bands = {own[c][1:] for c in chain}
            if len(bands) < 2:
                continue
            a, b = min(x for x, _ in bands), max(y for _, y in bands)
            allowed = np.zeros(b - a + 1, dtype=bool)
            for x, y in bands:
                allowed[x - a : y - a + 1] = True
            begin, end = max(int(words.bounds[d]), a), min(int(words.bounds[d + 1]), b + len(index.words[t]) + 1)
            matched, first, last = align(h[begin:end], index.words[t], a - begin, b - begin, allowed)
            if matched / len(index.words[t]) >= coverage:
                found.append((d, -matched / len(index.words[t]), -matched, begin + first, begin + last, t))
    chars = np.cumsum((data & 0xC0) != 0x80)
    code = lambda byte: int(chars[byte - 1]) if byte else 0
    taken: dict[int, list[tuple[int, int]]] = {}
    rows: list[list[dict]] = [[] for _ in range(len(offsets) - 1)]
    # of matches that overlap, the one with more matched words is reported; on ties the better covered
    for d, share, matched, a, b, t in sorted(found, key=lambda x: (x[0], x[2], x[1], x[3], x[5])):
        if any(a <= y and x <= b for x, y in taken.get(d, [])):
            continue
        taken.setdefault(d, []).append((a, b))
        base, first = code(int(offsets[d])), int(words.bounds[d])
        rows[d].append({"template": index.names[t], "coverage": -share, "matched": -matched, "first_word": a - first, "last_word": b - first, "start": code(int(words.start[a])) - base, "end": code(int(words.end[b])) - base})
    for r in rows:
        r.sort(key=lambda m: m["first_word"])
    kind = pa.list_(pa.struct([("template", pa.string()), ("coverage", pa.float64()), ("matched", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
    return pa.array(rows, type=kind)


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, text_col: str = "text", columns: list[str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """_row (a struct of `columns` of each row, all by default) and matches for each row of `docs`.

    A match names the template, the share of its words that the text has in order within the band, how many these are,
    and the place: first and last word, and code points from start to end (exclusive). Parts of a template that follow
    each other in the text, with less than its length between, count together and what is between lies in their place.
    Fingerprints of the whole text
    that the index holds say where to align; matches that overlap a better one are left out.

    One pass over the rows in their partitions: no shuffle, memory bounded by a slice of an Arrow batch; the templates
    are a fixed set, broadcast with their index. Null and empty texts have no match; rows with null or repeated ids are
    rows of their own; without templates nothing matches.
    """
    held = docs.sparkSession.sparkContext.broadcast(build_index(TEMPLATES if templates is None else templates))

    def make():
        index = held.value
        return lambda data, offsets, texts: [scan_slice(index, data, offsets, coverage)]

    return map_texts(docs, text_col, FIELDS, make, columns)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_matches, licenses (sorted, comma-joined), spans (template:start:end:matched, comma-joined) for every
    row of documents."""
    found = scan_licenses(load(spark, sf_dir, "documents"), columns=["doc_id"])
    spans = F.transform("matches", lambda m: F.concat_ws(":", m["template"], m["start"].cast("string"), m["end"].cast("string"), m["matched"].cast("string")))
    names = F.array_join(F.array_sort(F.array_distinct("matches.template")), ",")
    return found.select("_row.doc_id", F.size("matches").cast("long").alias("n_matches"), names.alias("licenses"), F.array_join(spans, ",").alias("spans"))
