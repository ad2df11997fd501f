"""Fuzzy search for short licence notices.

A notice of n characters may hold k edits. Cut into k + 1 seeds, at least one seed stands unchanged in any such match, so an
exact search for all notices' seeds at once, by one automaton, finds every candidate place. The regex library's bounded-error matching then verifies a window around
it and counts the edits. Texts are searched whole, as lower-case words joined by one space.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skimmer.llm.common import WORD_BYTES, col, table

# Fixed by the contract: phrases that count where their words stand consecutively.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# This operator's notices, matched with edits: opening or naming lines of licences and of reservations of rights.
NOTICES = {
    "licensed under the apache license": "apache",
    "you may not use this file except in compliance with the license": "apache",
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "distributed under the mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "the software is provided as is without warranty of any kind": "mit",
    "permission to use copy modify and or distribute this software": "isc",
    "licensed under the gnu general public license": "gpl",
    "terms of the gnu general public license": "gpl",
    "under the terms of the gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "redistribution and use in source and binary forms": "bsd",
    "licensed under the bsd license": "bsd",
    "terms of the mozilla public license": "mpl",
    "subject to the terms of the mozilla public license": "mpl",
    "terms of the eclipse public license": "epl",
    "common development and distribution license": "cddl",
    "boost software license version": "boost",
    "altered source versions must be plainly marked as such": "zlib",
    "distributed under the artistic license": "artistic",
    "python software foundation license": "psf",
    "licensed under the open software license": "osl",
    "academic free license version": "afl",
    "european union public licence": "eupl",
    "microsoft public license": "ms-pl",
    "sil open font license version": "ofl",
    "open database license": "odbl",
    "server side public license": "sspl",
    "business source license": "busl",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution noderivatives": "cc-by-nd",
    "creative commons zero": "cc0",
    "no rights reserved": "cc0",
    "dedicated to the public domain": "public-domain",
    "free and unencumbered software released into the public domain": "public-domain",
    "do what the fuck you want to public license": "wtfpl",
    "all rights reserved": "reserved",
    "no part of this publication may be reproduced": "reserved",
    "unauthorized copying of this file is strictly prohibited": "reserved",
    "proprietary and confidential": "reserved",
    "may not be distributed without prior written permission": "reserved",
}

COLUMNS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:int,end:int,edits:int>>"


def allowed(notice: str, per_edit: int) -> int:
    return max(1, len(notice) // per_edit)


def seeds(notice: str, edits: int) -> list[tuple[int, str]]:
    """(offset, seed) of edits + 1 pieces of about equal length."""
    cut = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cut, cut[1:])]


@lru_cache(maxsize=256)
def _pattern(notice: str, edits: int):
    import regex

    return regex.compile(rf"(?b)(?:{regex.escape(notice)}){{e<={edits}}}")


@lru_cache(maxsize=4096)
def _verify(notice: str, edits: int, window: str):
    """(start, end, edits) of the best match in a window, or None."""
    m = _pattern(notice, edits).search(window)
    return (*m.span(), sum(m.fuzzy_counts)) if m else None


class Seeds:
    """All notices' seeds in one automaton, so a text is searched once for any number of notices."""

    def __init__(self, notices: dict[str, str], per_edit: int):
        import ahocorasick

        self.notices = [(notice, label, allowed(notice, per_edit)) for notice, label in notices.items()]
        self.longest = {label: max(len(n) for n, x in notices.items() if x == label) for label in set(notices.values())}
        self.automaton, at = ahocorasick.Automaton(), {}
        for i, (notice, _, k) in enumerate(self.notices):
            for offset, seed in seeds(notice, k):
                at.setdefault(seed, []).append((i, offset, len(seed)))
        for seed, places in at.items():
            self.automaton.add_word(seed, places)
        if at:
            self.automaton.make_automaton()

    def candidates(self, text: str) -> dict[tuple[int, int], None]:
        """(notice, where it would begin) of every seed met, each once."""
        out: dict = {}
        for last, places in self.automaton.iter(text) if len(self.automaton) else ():
            for i, offset, n in places:
                out[i, last + 1 - n - offset] = None
        return out


def fuzzy(text: str, index: Seeds) -> list[tuple[str, int, int, int]]:
    """(label, first word, word after the last, edits) of the notices in a text of words joined by one space; of matches of
    one label that overlap, the one of fewest edits, then the first."""
    found = set()
    for i, at in index.candidates(text):
        notice, label, k = index.notices[i]
        low = max(0, at - k)
        if got := _verify(notice, k, text[low : max(at, 0) + len(notice) + k]):
            found.add((label, low + got[0], low + got[1], got[2]))
    if not found:
        return []
    taken: dict[str, bytearray] = {}
    out: list = []
    for label, a, b, edits in sorted(found, key=lambda x: (x[3], x[1], x[2], x[0])):
        held = taken.setdefault(label, bytearray(len(text)))
        if held.find(1, a, b) < 0:
            held[a:b] = b"\1" * (b - a)
            out.append((label, a, b, edits))
    spaces = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == 32)
    word = lambda at: int(np.searchsorted(spaces, at))  # noqa: E731  spaces before a place
    words = [(label, word(a) + (text[a : a + 1] == " "), word(max(a + 1, b - (text[b - 1 : b] == " "))) + 1, edits) for label, a, b, edits in out]
    return sorted(words, key=lambda x: (x[1], x[2], x[0]))


def scan_text(text: bytes, index: Seeds) -> tuple:
    words = text.translate(WORD_BYTES).split()
    joined = b" ".join(words)
    padded, at, base = b" " + joined + b" ", [], set()
    for phrase, label in PHRASES.items():
        look = b" " + phrase.encode() + b" "
        found = padded.find(look)
        while found >= 0:
            at.append(found)
            base.add(label)
            found = padded.find(look, found + 1)
    spaces = np.flatnonzero(np.frombuffer(padded, np.uint8) == 0x20) if at else None
    places = np.searchsorted(spaces, at).tolist() if at else []
    near = fuzzy(joined.decode("utf-8", "replace"), index)
    score = max([1.0 if places else 0.0, *(1 - e / index.longest[label] for label, _, _, e in near)])
    return (
        len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
        ",".join(sorted(base | {x[0] for x in near})), score, [{"label": a, "start": b, "end": c, "edits": d} for a, b, c, d in near],
    )


@lru_cache(maxsize=8)
def _seeds(notices: tuple, per_edit: int) -> Seeds:
    """One index per worker process."""
    return Seeds(dict(notices), per_edit)


def scan(docs: DataFrame, doc_id="doc_id", text="text", notices: dict[str, str] | None = None, per_edit: int = 12) -> DataFrame:
    """One row per row of docs: base places, labels, score and the spans of words that match a notice.

    Null and empty texts have no words, no labels and score 0; repeated rows get equal rows; other columns are not read."""
    notices = tuple((NOTICES if notices is None else notices).items())

    def run(batches):
        import pyarrow as pa

        names, index = [x.split()[0] for x in COLUMNS.split(", ")], _seeds(notices, per_edit)
        for b in batches:
            texts = b.column(1).cast(pa.large_binary()).fill_null(b"")
            cols = list(zip(*(scan_text(t.as_py(), index) for t in texts))) or [[]] * len(names)
            span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())]))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), span]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), k) for c, k in zip(cols, kinds))], ["doc_id", *names])

    return docs.select(col(doc_id).cast("long").alias("doc_id"), col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id long, {COLUMNS}")


def query(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
