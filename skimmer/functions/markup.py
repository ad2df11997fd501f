"""Nested wiki markup, taken out by counting brackets: linear in the text, however deep."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What opens and closes templates, tables and links, and the links whose whole content goes.
MARKS = re.compile(r"\{\{|\}\}|\{\||\|\}|\[\[|\]\]")
CLOSES = {"}}": "{{", "|}": "{|", "]]": "[["}
DEEP = 8  # links within links; deeper ones stay as text
DROPPED = re.compile(r"\s*(?:File|Image|Category)\s*:", re.IGNORECASE)


def without_nested(text: str) -> str:
    """The text without templates, tables and file links, at any depth; other links leave their label. A bracket without its partner
    stays as text."""
    matched, stack = {}, []
    for m in MARKS.finditer(text):
        mark = m[0]
        if mark in CLOSES:
            at = next((i for i in range(len(stack) - 1, max(-1, len(stack) - 9), -1) if stack[i][0] == CLOSES[mark]), None)
            if at is not None:  # what was opened inside and never closed is text
                matched[stack[at][1]] = m.end()
                matched[m.start()] = -1
                del stack[at:]
        else:
            stack.append((mark, m.start()))
    out, at = [], 0
    labels: list[tuple[int, int]] = []  # of links that are open: where their part of out begins, where they end
    for m in MARKS.finditer(text):
        if m.start() < at:
            continue
        end = matched.get(m.start())
        if end is None:
            continue
        if m[0] == "[[" and len(labels) == DEEP and not DROPPED.match(text, m.end()):
            matched[end - 2] = None
            continue
        out.append(text[at : m.start()])
        if end == -1:  # the end of a link: its label is what follows the last bar
            begun = labels.pop()[0] if labels else 0
            label = "".join(out[begun:])
            out[begun:] = [label.rpartition("|")[2]]
            at = m.end()
        elif m[0] == "[[" and not DROPPED.match(text, m.end()):
            labels.append((len(out), end))
            at = m.end()
        else:
            at = end
            out.append(" ")
    out.append(text[at:])
    return "".join(out)


def nested_markup(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts):
        return texts.map(lambda t: None if t is None else without_nested(t) if "{" in t or "[[" in t else t)

    return run(text)
