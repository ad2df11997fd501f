"""Text cleaning, tokenising and normalising as Column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is stripped, what a token is, which characters count as clean, where message texts are collapsed.
STRIP = r"(https?:/*)[^ ]+|#|@"
TOKEN = r"((?:[a-z]\.)+[a-z]?|\w+(?:-\w+)*)"
CLEAN = r"[\w\d\s\.\?,@#]"
BREAKS = r"\t+|\n+"

STOPWORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its "
    "itself they them their theirs themselves what which who whom this that these those am is are was were be been being have "
    "has had having do does did doing a an the and but if or because as until while of at by for with about against between "
    "into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very s t can "
    "will just don should now"
).split()


def let(value: Column, body) -> Column:
    """body(value) with value computed once; else each use inside a lambda computes it again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def characters(text: Column) -> Column:
    """An array of them: reaching the n-th character of a string takes n steps, of an array one."""
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def collapse_breaks(text: Column, by: str = " ") -> Column:
    return F.regexp_replace(text, BREAKS, by)


def message_text(screen_name: Column, text: Column) -> Column:
    """The sender's name and the text on one line."""
    return F.concat_ws(" ", screen_name, collapse_breaks(text))


def strip_marks(text: Column) -> Column:
    """Lower case without addresses, # and @."""
    return F.regexp_replace(F.lower(text), STRIP, "")


def tokens(text: Column, unicode: bool = True) -> Column:
    """Abbreviations, and words with inner hyphens. unicode: letters of any script, else ASCII."""
    return F.regexp_extract_all(text, F.lit(("(?U)" if unicode else "") + TOKEN), F.lit(1))


def clean_ratio(text: Column) -> Column:
    """Share of clean characters; null for an empty text."""
    return F.try_divide(F.regexp_count(text, F.lit(CLEAN)), F.length(text))


def without_stopwords(words: Column, stopwords=STOPWORDS) -> Column:
    """Repeated words stay repeated."""
    return F.filter(words, lambda w: ~w.isin(list(stopwords)))


def contained(text: Column, multigrams: Column) -> Column:
    """The multi-word keywords that stand anywhere in the text, word ends or not."""
    return F.filter(multigrams, lambda m: F.contains(text, m))


# -- language normalising -------------------------------------------------------------------------------------------

# Fixed values, as Java patterns: dashes, what is not Latin, runs, and what a message has besides words.
DASHES = r"[‐-―]"
NOT_LATIN = r"[^ -~¡-ɏ̀-ͯḀ-ỿ]+"
LATIN_RUN = r"([a-zà-ɏ])\1{2,}"
SYMBOL_RUN = r"([^a-zà-ɏ])\1{1,}"
MARKED = r"(@|#|https?://)[^ ]+"
FACE = r"(^| )[:;x]-?[\(\)dop]($| )"
RETWEET = r"^(rt[ :]+)*| (rt[ :]+)+"  # a blank stays a blank if nothing follows: only the first place changes for each text
LAUGH = r"([hj])+([aieo])+(\1+\2+){1,}"
ENDING = r" +(via|live on) *$"
TONE_BASES = "AEIOUYaeiouyÂÊÔâêôĂăƠơƯư"
TONES = "̣̀́̃̉"

# Private characters that stand in while a chain of replacements runs.
_CAPITAL_I, _DONE = "\ue000", "\ue001"


def normalise_message(text: Column, two_laughs_only: bool = False) -> Column:
    """Takes out mentions, tags, addresses, faces, retweet marks and a trailing "via" or "live on"; laughs become two rounds.

    two_laughs_only: an old quirk, the first two laughs of a text in lower case; else all, in either case."""
    text = _if_any(text, ("@", "#", "http"), lambda t: F.regexp_replace(t, MARKED, ""))
    text = _if_any(text, (":", ";", " x"), lambda t: F.regexp_replace(t, FACE, " "), F.startswith, "x")
    text = F.regexp_replace(text, RETWEET, " ")
    if two_laughs_only:
        first = "(?s)^((?:.*" + _DONE + r")?.*?)([hj])+([aieo])+(\2+\3+){1,}"
        for _ in range(2):  # each search begins after what is done
            text = F.regexp_replace(text, first, "$1$2$3$2$3" + _DONE)
        text = F.replace(text, F.lit(_DONE), F.lit(""))
    else:
        text = F.regexp_replace(text, "(?i)" + LAUGH, "$1$2$1$2")
    return _if_any(text, (" via", " live on"), lambda t: F.regexp_replace(t, ENDING, ""))


def _if_any(text: Column, parts, body, more=None, *those) -> Column:
    """body(text) where the text holds any of the parts, which body needs to change it: looking for them is cheaper. more: another test
    of text and literals that will do."""

    def tested(t: Column) -> Column:
        found = [F.contains(t, F.lit(p)) for p in parts] + ([more(t, *map(F.lit, those))] if more else [])
        return F.when(reduce(or_, found), body(t)).otherwise(t)

    return let(text, tested)


def unify_dashes(text: Column) -> Column:
    return _if_any(text, map(chr, range(0x2010, 0x2016)), lambda t: F.regexp_replace(t, DASHES, "-"))


def digits_to_zero(text: Column) -> Column:
    return F.regexp_replace(text, "[0-9]+", "0")


def latin_only(text: Column) -> Column:
    return _if_any(F.regexp_replace(text, NOT_LATIN, " "), ("  ",), lambda t: F.regexp_replace(t, "  +", " "))


def lower_but_i(text: Column) -> Column:
    """Lower case; a capital I stays, as Turkish writes it with another small letter."""
    return F.replace(F.lower(F.replace(text, F.lit("I"), F.lit(_CAPITAL_I))), F.lit(_CAPITAL_I), F.lit("I"))  # translate() is slow


def romanian_commas(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("ș"), F.lit("ş")), F.lit("ț"), F.lit("ţ"))


def collapse_runs(text: Column) -> Column:
    """Three or more of a letter become two, two or more of anything else one."""
    return F.regexp_replace(F.regexp_replace(text, LATIN_RUN, "$1$1"), SYMBOL_RUN, "$1")


def compose_tones(text: Column) -> Column:
    """A Vietnamese base letter and the tone mark after it become one letter."""
    import unicodedata

    def all_of(t: Column) -> Column:
        for base in TONE_BASES:
            for tone in TONES:
                t = F.replace(t, F.lit(base + tone), F.lit(unicodedata.normalize("NFC", base + tone)))
        return t

    return _if_any(text, TONES, all_of)


def normalise_language(text: Column, two_laughs_only: bool = False) -> Column:
    """The whole chain before n-grams are taken, after entities are decoded."""
    text = latin_only(digits_to_zero(unify_dashes(text)))
    text = romanian_commas(lower_but_i(compose_tones(text)))
    return F.trim(collapse_runs(normalise_message(text, two_laughs_only)))


def with_bounds(text: Column) -> Column:
    """The mark that tells a text's beginning and end in n-grams."""
    return F.concat(F.lit("\u0001"), text, F.lit("\u0001"))


def labelled_line(line: Column) -> tuple[Column, Column]:
    """(label, text): the label before the first tab, "" if there is none, and the field after the last one, which may be empty and may
    hold what Java takes for ends of lines (U+0085, U+2028)."""
    head = r"(?s)^([-A-Za-z]+)\t(.*)"
    rest = F.when(line.rlike(head), F.regexp_extract(line, head, 2)).otherwise(line)
    return F.regexp_extract(line, head, 1), F.element_at(F.split(rest, "\t"), -1)
