"""Nested wiki markup."""

import random
import time

import pytest

from skimmer.functions.markup import without_nested


@pytest.mark.parametrize("text,want", [
    ("a {{b {{c {{d {{e {{f}} }} }} }} }} g", "a   g"), ("x [[A|lab]] [[B]] [[File:z.png|thumb|cap [[C|d]] {{t}}]] y", "x lab B   y"),
    ("{{open [[x]] end", "{{open x end"), ("}} stray {| tab {{t}} |} z", "}} stray   z"), ("[[a|b {{t|u}} c]]", "b   c"), ("", ""), ("[[]]", ""), ("no marks", "no marks"),
])
def test_markup(text, want):
    assert without_nested(text) == want


def slow(text):
    """Innermost templates first, again and again."""
    import re

    while (new := re.sub(r"\{\{[^{}]*\}\}", "\x00", text)) != text:
        text = new
    return text.replace("\x00", " ")


def test_templates_like_the_innermost_first_rule():
    rng = random.Random(1)

    def piece(depth):
        return "".join(rng.choice(["a", " b"]) if rng.random() < 0.6 or not depth else "{{" + piece(depth - 1) + "}}" for _ in range(rng.randrange(5)))

    for _ in range(300):
        text = piece(6)
        assert without_nested(text) == slow(text)


@pytest.mark.parametrize("part", ["{{a ", "[[a ", "}}", "{{a [[b|c]] }} ", "[[a|" * 9 + "]]" * 9])
def test_time_is_linear(part):
    def took(n):
        began = time.process_time()
        without_nested(part * n)
        return time.process_time() - began

    took(10_000)
    assert took(160_000) < 30 * max(took(20_000), 5e-3)


def test_a_page_of_20_mb():
    page = ("{{x " * 5 + "[[A|b]]" + "}}" * 5 + " plain text that stays ") * 450_000
    assert len(page) > 20e6
    assert without_nested(page).split() == "plain text that stays".split() * 450_000
