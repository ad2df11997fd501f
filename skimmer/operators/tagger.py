"""A pluggable part-of-speech filter. The default goes by a few closed word classes and endings, JVM-side; Tagger is trained."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skimmer.operators.match import small
from skimmer.scratch import scratch

CLOSED = "and or but nor so yet for the a an this that these those in on at by of to with from as than then there here very too not never also just only".split()


def open_classes(words: Column) -> Column:
    """Nouns, adjectives and verbs, as far as adverbs (-ly), numbers and closed classes can be told from them."""
    return F.filter(words, lambda w: ~w.isin(CLOSED) & ~w.rlike(r"^[0-9]+$|ly$"))


def arrow_tagger(tag) -> "callable":
    """A tagger from tag(list of words) -> list of tags; keeps JJ, NN and VB, an Arrow batch at a time."""
    @F.pandas_udf("array<string>")
    def keep(s):
        return s.map(lambda ws: None if ws is None else [w for w, t in zip(ws, tag(list(ws))) if t[:2] in ("JJ", "NN", "VB")])

    return keep


# -- a tagger that is trained -------------------------------------------------------------------------------------------

#: The beginnings of the tags that are kept, and how long an ending of an unknown word counts.
KEPT, ENDING = ("JJ", "NN", "VB"), 3
PIECE = 1 << 16  # words that are tagged together
BLOCK_BITS = 10  # a block that asks a large model for its words is of 1,024 texts


def _counts(tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(before, tag, n) and (word, tag, n) of a tagged table. Where it has before, the tag of the word before or null, nothing is sorted."""
    rows = tagged.where("sentence is not null and at is not null and word is not null and tag is not null")
    before = F.col("before") if "before" in tagged.columns else F.lag("tag").over(Window.partitionBy("sentence").orderBy("at"))
    moves = rows.select(before.alias("before"), "tag").groupBy("before", "tag").agg(F.count("*").alias("n"))
    return moves, rows.groupBy("word", "tag").agg(F.count("*").alias("n"))


def _moves(pairs: list, smoothing: float) -> tuple:
    """(tags, log-probabilities of the first tag, of a tag after another); pairs are tags by tags."""
    tags = sorted({r.tag for r in pairs})
    at, k = {t: i for i, t in enumerate(tags)}, len(tags)
    start, follow = np.full(k, smoothing), np.full((k, k), smoothing)
    for r in pairs:
        if r.before is None:
            start[at[r.tag]] += r.n
        else:
            follow[at[r.before], at[r.tag]] += r.n
    return tags, np.log(start / start.sum()), np.log(follow / follow.sum(axis=1, keepdims=True))


class Tagger:
    """A hidden Markov model of tags: what a tag follows, what it spells, and for words that were never seen what their endings tell.

    Counts are grouped by Spark from a tagged table; the model that comes to the driver has a row for each (word, tag) seen, up to
    ``most_rows``, and fails beyond: see filtered(). Ties go to the tag that is first in the alphabet. A null or empty text has no tags."""

    def __init__(self, tags: list[str], start, follow, words: dict, endings: dict, rest):
        self.tags, self.start, self.follow, self.words, self.endings, self.rest = tags, start, follow, words, endings, rest

    @classmethod
    def train(cls, tagged: DataFrame, smoothing: float = 0.1, most_rows: int = 2_000_000) -> Tagger:
        """tagged: (sentence, at, word, tag), words in the form that is tagged later. Rows with a null among these are left out."""
        moves, spelt = _counts(tagged)
        spelt = spelt.limit(most_rows + 1).toArrow()
        if spelt.num_rows > most_rows:
            raise ValueError("the model has too many rows")
        tags, start, follow = _moves(moves.collect(), smoothing)
        at, k = {t: i for i, t in enumerate(tags)}, len(tags)
        total = np.full(k, smoothing)
        words: dict = {}
        endings: dict = {}
        for w, t, n in zip(*(spelt.column(c).to_pylist() for c in ("word", "tag", "n"))):
            total[at[t]] += n
            words.setdefault(w, np.zeros(k))[at[t]] += n
            for j in range(1, ENDING + 1):
                endings.setdefault(w[-j:], np.zeros(k))[at[t]] += 1  # each word once: rare ones are what the unknown are like
        log = lambda n: np.log(n + smoothing) - np.log(total)
        return cls(tags, start, follow, {w: log(n) for w, n in words.items()}, {e: log(n) for e, n in endings.items()}, log(np.zeros(k)))

    def spelled(self, word: str) -> np.ndarray:
        """Log-probability of a word by tag, of the longest known ending of an unknown one."""
        if word in self.words:
            return self.words[word]
        return next((self.endings[word[-j:]] for j in range(min(ENDING, len(word)), 0, -1) if word[-j:] in self.endings), self.rest)

    def decided(self, own: np.ndarray) -> np.ndarray:
        """The tag of each word (log-probabilities by tag) that has it whatever stands around it, else -1: it is ahead of any other
        tag by more than the tags before and after can make up for, so no best path has another."""
        if len(self.tags) == 1:
            return np.zeros(len(own), np.int64)
        with np.errstate(invalid="ignore"):
            into = np.vstack([self.follow, self.start])
            gain = (into[:, :, None] - into[:, None, :]).max(axis=0)  # of tag b over tag a, by what is before
            gain += np.maximum((self.follow[:, None, :] - self.follow[None, :, :]).max(axis=2), 0)  # and after; a text may end, too
            best = own.argmax(axis=1)
            ahead = own[np.arange(len(own)), best][:, None] - own > gain.T[best] + 1e-6
        ahead[np.arange(len(own)), best] = True
        return np.where(ahead.all(axis=1), best, -1)

    def tag(self, texts: list[list[str]]) -> list[list[str]]:
        """The likeliest tags of each text. Words whose tag is decided by themselves part a text into runs of the others, which
        are tagged all together, a word at a time: the longest first, so those that have ended drop out."""
        if not self.tags or not any(map(len, texts)):
            return [[] for _ in texts]
        cut = np.cumsum([0, *map(len, texts)])
        place: dict = {}
        code = np.fromiter((place.setdefault(w, len(place)) for t in texts for w in t), np.int64, cut[-1])
        found = self._found(cut, code, np.stack([self.spelled(w) for w in place]))
        names = np.array(self.tags, object)[found].tolist()
        return [names[a:b] for a, b in zip(cut[:-1], cut[1:])]

    def _found(self, cut: np.ndarray, code: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Numbers of the tags of texts that lie one after another, from cut to cut; code: the row of own that a word has."""
        found = self.decided(own)[code]
        opens, closes = np.zeros(len(code) + 1, bool), np.zeros(len(code) + 1, bool)  # of texts: where one begins, past where one ends
        opens[cut[:-1][np.diff(cut) > 0]] = closes[cut[1:][np.diff(cut) > 0]] = True
        free = found < 0
        first = np.flatnonzero(free & (opens[:-1] | ~np.concatenate([[False], free[:-1]])))
        last = np.flatnonzero(free & (closes[1:] | ~np.concatenate([free[1:], [False]]))) + 1
        if len(first):
            order = np.argsort(first - last, kind="stable")
            self._runs(first[order], last[order], code, own, found, opens, closes)
        return found

    def _runs(self, first, last, code, own, found, opens, closes) -> None:
        """Tags of the words from first to last (past it), the longest run first, into found; next to them are texts' ends or tags."""
        size = last - first
        start = np.where(opens[first][:, None], self.start, self.follow[found[first - 1]])
        after = np.where(closes[last][:, None], 0.0, self.follow.T[found[np.minimum(last, len(found) - 1)]])
        most, live, back = int(size[0]), len(size), []
        ends = np.zeros(live, np.int64)
        score = start + own[code[first]]
        for t in range(1, most):
            now = int(np.searchsorted(-size, -t, "left"))  # runs of more than t words
            if now < live:
                ends[now:live] = (score[now:] + after[now:live]).argmax(axis=1)
            step = score[:now, :, None] + self.follow
            best = step.argmax(axis=1)
            back.append(best.astype(np.int16))
            score = np.take_along_axis(step, best[:, None, :], 1)[:, 0] + own[code[first[:now] + t]]
            live = now
        ends[:live] = (score + after[:live]).argmax(axis=1)
        found[last - 1] = ends
        for t in range(most - 1, 0, -1):
            best = back[t - 1]  # runs of more than t words; the others haven't begun yet, seen from the end
            at = first[: len(best)] + t
            found[at - 1] = best[np.arange(len(best)), found[at]]

    def keep(self, words: Column) -> Column:
        """The words whose tags are nouns, adjectives or verbs; for match.token_set(tagger=...)."""
        return arrow_tagger_of_batch(self)(words)


def arrow_tagger_of_batch(model: Tagger):
    """keep() of a model, so many words at a time; a text of more than PIECE words begins anew after each PIECE."""

    @F.pandas_udf("array<string>")
    def keep(texts):
        import pandas as pd

        return pd.Series(_kept(model, texts))

    return keep


def _kept(model: Tagger, texts) -> list:
    """The words of each text that are kept, None for None."""
    held: list = []
    size = 0
    kept: list = [None if t is None else [] for t in texts]

    def done():
        for (i, ws), tags in zip(held, model.tag([ws for _, ws in held])):
            kept[i] += [w for w, tag in zip(ws, tags) if tag[:2] in KEPT]
        held.clear()

    for i, t in enumerate(texts):
        ws = [] if t is None else list(t)
        for at in range(0, len(ws), PIECE):
            held.append((i, ws[at : at + PIECE]))
            size += len(held[-1][1])
            if size >= PIECE:
                done()
                size = 0
    done()
    return kept


def filtered(docs: DataFrame, key: str, words: str, tagged: DataFrame, smoothing: float = 0.1, most_rows: int = 200_000) -> DataFrame:
    """(key, kept): the words of each text that a tagger trained on the tagged table keeps, as Tagger.train() and keep() give them.

    A model of up to ``most_rows`` (word, tag) goes to every worker. A larger one stays a table: texts are cut into blocks of
    1,024, each block asks for its distinct words and is tagged with what the table, or that of the endings, has on them."""
    moves, spelt = _counts(tagged)
    spelt = scratch(spelt)
    if spelt.count() <= most_rows:
        return docs.select(key, Tagger.train(tagged, smoothing, most_rows).keep(F.col(words)).alias("kept"))
    tags, start, follow = _moves(moves.collect(), smoothing)
    at = {t: i for i, t in enumerate(tags)}
    total = np.full(len(tags), smoothing)
    for r in spelt.groupBy("tag").agg(F.sum("n").alias("n")).collect():
        total[at[r.tag]] += r.n
    log = lambda n: np.log(n + smoothing) - np.log(total)
    place = F.array_position(F.array(*map(F.lit, tags)), F.col("tag")).cast("int") - 1
    listed = lambda rows, by: rows.groupBy(by).agg(F.collect_list(F.struct(place.alias("tag"), "n")).alias("seen"))  # noqa: E731  a tag each
    ends = spelt.select("tag", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(ENDING)), lambda j: F.right("word", j)))).alias("ending"))
    ends = scratch(listed(ends.groupBy("ending", "tag").agg(F.count("*").alias("n")), "ending"))

    # blocks are written: numbers of rows may differ from run to run
    block = F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)
    texts = scratch(docs.select(block.alias("block"), F.col(key).alias("key"), F.col(words).alias("words")))
    asked = texts.select(F.col("block").alias("asks"), F.explode("words").alias("word")).distinct().join(listed(spelt, "word"), "word", "left")
    for j in range(ENDING, 0, -1):  # of a word that is known the ending isn't asked for
        known = small(ends.select(F.col("ending").alias("__ending"), F.col("seen").alias("__seen")))
        ending = F.when(F.col("seen").isNull(), F.right("word", F.lit(j)))
        asked = asked.join(known, ending == F.col("__ending"), "left").select("asks", "word", F.coalesce("seen", "__seen").alias("seen"))

    def tag(own, found):
        import pyarrow as pa
        import pyarrow.compute as pc

        whole = lambda c, kind: pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], kind)
        lengths = lambda x: pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False)
        listed, seen = (whole(t.column(c), t.schema.field(c).type) for t, c in ((own, "words"), (found, "seen")))
        each, n = seen.flatten(), np.zeros((len(seen) + 1, len(tags)))  # the last row is that of a word which nothing is known of
        np.add.at(n, (np.repeat(np.arange(len(seen)), lengths(seen)), each.field("tag").to_numpy(zero_copy_only=False)), each.field("n").to_numpy(zero_copy_only=False))
        model, spelled = Tagger(tags, start, follow, {}, {}, log(np.zeros(len(tags)))), log(n)
        flat, size = listed.flatten(), lengths(listed)
        begin = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        # a text of more than PIECE words begins anew after each PIECE, as in keep(); so many words are tagged together
        cut = np.concatenate([*(np.arange(a, b, PIECE) for a, b in zip(begin[:-1], begin[1:])), begin[-1:]]).astype(np.int64)
        keeps, masks = np.array([t[:2] in KEPT for t in tags], bool), []
        at = 0
        while at < len(cut) - 1:
            to = max(at + 1, int(np.searchsorted(cut, cut[at] + 4 * PIECE, "right")) - 1)
            words = flat.slice(cut[at], cut[to] - cut[at]).dictionary_encode()
            row = pc.fill_null(pc.index_in(words.dictionary, whole(found.column("word"), pa.string())), len(seen)).to_numpy(zero_copy_only=False)
            masks.append(keeps[model._found(cut[at : to + 1] - cut[at], words.indices.to_numpy(zero_copy_only=False), spelled[row])])
            at = to
        mask = np.concatenate(masks) if masks else np.zeros(0, bool)
        ends = np.concatenate([[0], np.cumsum(mask)])[begin].astype(np.int32)
        kept = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat.filter(pa.array(mask, pa.bool_())), mask=listed.is_null())
        return pa.table({key: own.column("key"), "kept": kept})

    kind = docs.schema[key].dataType.simpleString()
    return texts.groupBy("block").cogroup(asked.groupBy("asks")).applyInArrow(tag, f"`{key}` {kind}, kept array<string>")
