"""License scan: MinHash bands over overlapping windows, verified by containment.

Templates are short texts with an id.  A text is cut into overlapping windows
of words, twice as long as the templates of a length class and starting every
half window, so each place where a template may stand lies whole in some
window.  A window and a template meet if one of ``bands`` one-row MinHash bands
agrees.  A class with half windows of h shingles holds templates of m
shingles, h / 2 < m <= h; one that a window of 2 h shingles holds to a share c
has Jaccard similarity J >= c m / (2 h + (1 - c) m) with it.  The chance to miss
it is (1 - J) ** bands.  With 40 bands that is under 1e-5 for whole
templates (J > 1 / 4) and under 3e-4 at the threshold c = 0.8.  Retrieved
pairs are verified exactly: the share of the template's shingles that the
window holds.  Templates of one shingle are looked up as they are.

The built-in templates are the full texts and the notices of the package folder
``license_texts`` and ``TEMPLATES``.  Texts of one family share much of their
wording, so of built-in templates of a family that match at one place only the
license with the most matched words is reported.

Work is one pass over each text inside the tasks; the templates are a bounded
table that is sent along.
"""

from __future__ import annotations

import re
from importlib import resources

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns

MAX_TEMPLATES = 10_000
BANDS = 40
BATCH = 128           # texts scanned together
SHINGLE = 5
WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")

FAMILIES = {"GPL": "GNU", "LGPL": "GNU", "AGPL": "GNU", "GFDL": "GNU"}
TITLE_GAP = 16        # words between a title and its text

# Notices by which texts state their license.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights"),
    ("all-rights-reserved", "All rights reserved."),
)

MATCH = T.StructType([T.StructField("license_id", T.StringType()), T.StructField("n_places", T.LongType()),
                      T.StructField("containment", T.DoubleType()), T.StructField("first_word", T.LongType())])


def built_in() -> list:
    """``(license id, text, whether it is a title that decides between rivals)`` of all built-in templates."""
    rows = [(lid, text, False) for lid, text in TEMPLATES]
    for f in sorted(resources.files(__package__).joinpath("license_texts").iterdir(), key=lambda f: f.name):
        if f.name.endswith(".txt"):
            rows.append((f.name[:-4], f.read_text(encoding="utf-8"), False))
        elif f.name.endswith(".tsv"):
            for line in f.read_text(encoding="utf-8").splitlines():
                if line and not line.startswith("#"):
                    lid, text = line.split("\t")
                    rows.append((lid.lstrip("!"), text, lid.startswith("!")))
    return rows


def words_of(text: str | None) -> list:
    return WORD.findall(text.lower()) if text else []


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of a sum depends on all words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: list, size: int) -> np.ndarray:
    """Hash of each shingle of ``size`` words; fewer words are one shingle."""
    import xxhash

    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), dtype=np.uint64, count=len(words))
    n = max(1, len(words) - size + 1)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(min(size, len(words))):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i:i + n])
    return out


def permutations(bands: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return (rng.integers(1, 2 ** 63, bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1),
            rng.integers(0, 2 ** 63, bands, dtype=np.uint64))


def compile_templates(rows: list, bands: int, size: int) -> list:
    """Length classes ``(shingle, half window, [template], {(band, minhash): [template]}, marks)``.

    ``marks[band]`` has the low 16 bits of the band's minhashes, to tell most
    windows apart from all templates by one look.  Templates of one shingle
    (half window 1) have ``{shingle: [template]}`` and the marks of it instead.
    Templates shorter than a shingle are their own whole sequence: their class
    looks for that many words at a time.
    """
    classes: dict = {}
    for lid, text, *title in rows:
        words = words_of(text)
        if words:
            own = min(size, len(words))
            h = np.unique(shingle_hashes(words, own))
            m = len(words) - own + 1
            classes.setdefault((own, 1 << (m - 1).bit_length()), []).append((lid, h, m, any(title)))
    a, b = permutations(bands)
    out = []
    for (own, half), found in sorted(classes.items()):
        by: dict = {}
        if half == 1:
            for t, (_, h, _, _) in enumerate(found):
                by.setdefault(int(h[0]), []).append(t)
            marks = np.zeros(1 << 16, dtype=bool)
            marks[[x & 0xFFFF for x in by]] = True
            out.append((own, half, found, by, marks))
            continue
        for t, (_, h, _, _) in enumerate(found):
            low = (h[None, :] * a[:, None] + b[:, None]).min(axis=1)
            for k in range(bands):
                by.setdefault((k, int(low[k])), []).append(t)
        marks = np.zeros((bands, 1 << 16), dtype=bool)
        for k, low in by:
            marks[k, low & 0xFFFF] = True
        out.append((own, half, found, by, marks))
    return out


def places_in(window: np.ndarray, want: np.ndarray, m: int, share: float) -> list:
    """``(start, containment)`` of the places in a window where a template of ``m`` shingles stands."""
    at = np.flatnonzero(np.isin(window, want))
    got = len(np.unique(window[at])) / len(want)
    if got < share:
        return []
    out, end = [], 0
    for i, p in enumerate(at.tolist()):
        if p < end:
            continue
        upto = int(np.searchsorted(at, p + m))
        if upto - i < share * len(want):
            continue
        c = len(np.unique(window[at[i:upto]])) / len(want)
        if c >= share:
            out.append((p, c))
            end = p + m
    return out if len(out) > 1 else [(out[0][0] if out else int(at[0]), got)]


def without_rivals(found: list) -> list:
    """Matches of one text ``(id, first word, end, containment, matched words, title)`` less those that a
    relative (of the same family) outdoes at the same place: by a title there, or else by more matched words."""
    family = [FAMILIES.get(x[0].split("-")[0], x[0].split("-")[0]) for x in found]
    groups: dict = {}
    for f, x in zip(family, found):
        groups.setdefault(f, []).append(x)
    out = []
    for xs in groups.values():
        if len({x[0] for x in xs}) == 1:
            out += xs
            continue
        xs = sorted(xs, key=lambda x: (-x[5], -x[4], -x[3]))
        kept: list = []
        for x in xs:
            if all(x[0] == k[0] or x[1] >= k[2] + TITLE_GAP * k[5] or k[1] >= x[2]
                   or (x[5], x[4], x[3]) == (k[5], k[4], k[3]) for k in kept):
                kept.append(x)
        out += kept
    return out


def scan(texts: list, classes: list, bands: int, share: float, rivals: bool = False) -> list:
    """Matches of each text in order of license id: ``(id, places, best containment, first word)``.

    The texts' shingles lie in one array, each text padded to a whole number of
    the longest half windows whose templates it can hold, the longest ones
    first, so that a band is a few passes over the array; those for a class end
    with the last text that can hold one of its templates.  ``rivals``: of
    related licenses at one place only the best counts.
    """
    import xxhash

    words = [words_of(t) for t in texts]
    count = np.array([len(w) for w in words], dtype=np.int64)
    flat = np.fromiter((xxhash.xxh3_64_intdigest(w) for ws in words for w in ws), dtype=np.uint64, count=int(count.sum()))
    begin = np.cumsum(count) - count
    found_in: list = [[] for _ in texts]
    a, b = permutations(bands)
    for own in sorted({c[0] for c in classes}):
        mine = [c for c in classes if c[0] == own]
        m = np.maximum(count - own + 1, 0)
        pad = np.zeros(len(texts), dtype=np.int64)
        for _, half, found, _, _ in mine:
            pad[m >= max(1, share * min(len(x[1]) for x in found) - 1e-9)] = half
        order = np.argsort(-pad, kind="stable")
        m = np.where(pad > 0, m, 0)[order]
        pad = pad[order]
        slots = -(-m // np.maximum(pad, 1)) * pad
        if not slots.sum():
            continue
        to = np.cumsum(slots) - slots
        text_of = np.repeat(np.arange(len(texts)), m)
        inside = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
        src, dst = begin[order][text_of] + inside, to[text_of] + inside
        h = np.zeros(int(slots.sum()), dtype=np.uint64)
        gram = np.zeros(len(src), dtype=np.uint64)
        for i in range(own):
            gram = mixed(gram * np.uint64(0x9E3779B97F4A7C15) + flat[src + i])
        h[dst] = gram
        filled = np.zeros(len(h), dtype=bool)
        filled[dst] = True
        gaps = np.flatnonzero(~filled)
        starts = np.append(to, len(h))
        met: list = [set() for _ in mine]
        for j, (_, half, found, by, marks) in enumerate(mine):
            if half == 1:
                for i in np.flatnonzero(marks[(h & np.uint64(0xFFFF)).astype(np.intp)] & filled):
                    for t in by.get(int(h[i]), ()):
                        doc = int(np.searchsorted(starts, i, side="right")) - 1
                        lid, _, _, title = found[t]
                        place = int(i - to[doc])
                        found_in[order[doc]].append((lid, place, place + own, 1.0, own, title))
        ends = [int(slots[pad >= c[1]].sum()) for c in mine]
        for k in range(bands if mine[-1][1] > 1 else 0):
            low = h * a[k] + b[k]
            low[gaps] = np.uint64(2 ** 64 - 1)
            width = 1
            for j, (_, half, _, by, marks) in enumerate(mine):
                if half == 1:
                    continue
                low = low[:ends[j] // width]
                while width < half:
                    low = np.minimum(low[0::2], low[1::2])
                    width *= 2
                for i in np.flatnonzero(marks[k][(low & np.uint64(0xFFFF)).astype(np.intp)]):
                    for t in by.get((k, int(low[i])), ()):
                        met[j].add((int(i), t))
        for j, (_, half, found, _, _) in enumerate(mine):
            windows = set()
            for i, t in met[j]:
                # The half belongs to the window that starts there and to the one before.
                doc = int(np.searchsorted(starts, i * half, side="right")) - 1
                windows.add((doc, i * half, t))
                if i * half - half >= to[doc]:
                    windows.add((doc, i * half - half, t))
            for doc, first, t in windows:
                lid, want, size, title = found[t]
                window = h[first:min(first + 2 * half, int(to[doc] + m[doc]))]
                for p, c in places_in(window, want, size, share):
                    place = int(first - to[doc] + p)
                    found_in[order[doc]].append((lid, place, place + size + own - 1, c, round(c * len(want)) + own - 1, title))
    out = []
    for found in found_in:
        best: dict = {}
        for lid, place, end, c, _, _ in sorted(without_rivals(found) if rivals else found, key=lambda x: x[:3]):
            # Wordings of one license that overlap are one place.
            n, most, first, last = best.get(lid, (0, 0.0, place, 0))
            best[lid] = (n + (place >= last), max(most, c), first, max(last, end))
        out.append([(lid, n, c, f) for lid, (n, c, f, _) in sorted(best.items())])
    return out


def with_licenses(docs: DataFrame, templates: DataFrame | None = None, share: float = 0.8, bands: int = BANDS,
                  shingle: int = SHINGLE, text_col: str = "text", max_templates: int = MAX_TEMPLATES,
                  keep: list[str] | None = None) -> DataFrame:
    """All columns (or ``keep``) plus ``licenses``: one struct per license found, in order of its id.

    ``templates`` has columns license_id and text; without it the built-in
    texts and notices are used, and of related licenses at one place the best.  More than ``max_templates`` templates are refused, since
    they are sent to every task.  Null and empty texts hold no license;
    templates without a word match nothing.
    """
    rows, rivals = built_in(), templates is None
    if templates is not None:
        rows = [(r[0], r[1]) for r in templates.select("license_id", "text").limit(max_templates + 1).collect()]
        if len(rows) > max_templates:
            raise ValueError(f"more than {max_templates} templates")
    held = docs.sparkSession.sparkContext.broadcast(compile_templates(rows, bands, shingle))

    def compute(col):
        texts, got = col.to_pylist(), []
        for i in range(0, len(texts), BATCH):
            got += scan(texts[i:i + BATCH], held.value, bands, share, rivals)
        return [[[dict(zip(MATCH.names, m)) for m in g] for g in got]]

    fields = T.StructType([T.StructField("licenses", T.ArrayType(MATCH))])
    return append_columns(docs, fields, [text_col], compute, keep)
