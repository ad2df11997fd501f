"""Cross-entropy difference of two n-gram models.

A target model (rows of the target) and a background model (all rows) count every word and word pair of the corpus by its
64-bit hash (the lowest bit tells words from pairs), so the counts grow with the corpus and no two n-grams share one. Both
judge the same events. A pair's probability is smoothed towards its second word's, a word's towards the uniform over a
vocabulary of 2**WORD_BITS words, or all distinct ones if they are more. A document's score is the mean over its tokens of
the target's loss less the background's: the lower, the more it looks like the target.

Rows are dealt into blocks. A block's distinct n-grams and their counts go to buckets of the hash's range; a bucket adds up
and sends each block the sums of its own n-grams, in the order of their hashes; so no task holds more than a block or a bucket.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skimmer.llm.common import chunks, mix, scratch, table, word_hashes

WORD_BITS = 18
STRENGTH = 20.0
#: Bytes of text in a block; n-grams that the blocks send to one bucket, about; the fewest of each.
BLOCK, BUCKET, LEAST_BLOCKS, LEAST_BITS = 4 << 20, 3_000_000, 64, 8


def events(data: np.ndarray, offsets: np.ndarray):
    """(row, word hash, pair hash, whether there is a pair) of each token of a piece; a row's first word has no pair."""
    h, rows, _, _ = word_hashes(data, offsets)
    pair, later = np.zeros(len(h), np.uint64), np.zeros(len(h), bool)
    if len(h) > 1:
        pair[1:] = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) & ~np.uint64(1)
        later[1:] = rows[1:] == rows[:-1]
    return rows, h | np.uint64(1), pair, later


def block_events(texts):
    """(row, place of the word, places of the pairs, whether there is a pair, the distinct hashes in order) of a block."""
    import pyarrow as pa

    texts = texts.cast(pa.large_string()).combine_chunks()
    parts = [(first + rows, *rest) for first, data, offsets in chunks(texts) for rows, *rest in [events(data, offsets)]]
    if not parts:
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool))]
    rows, word, pair, later = (np.concatenate(p) for p in zip(*parts))
    found, at = np.unique(np.concatenate([word, pair[later]]), return_inverse=True)
    return rows, at[: len(word)], at[len(word) :], later, found


def pack(x: np.ndarray) -> bytes:
    """Byte planes: those of sorted hashes and of small counts compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unpack(data, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def dealt(docs: DataFrame, doc_id: str, blocks: int, *more) -> DataFrame:
    """Rows with their block: by id, those without one by text."""
    key = F.col(doc_id).cast("long")
    text = [c for c in more if c == "text"]
    spread = F.when(key.isNotNull(), F.xxhash64(key)).otherwise(F.xxhash64(*text) if text else F.lit(0))
    return docs.select(F.pmod(spread, F.lit(blocks)).cast("int").alias("block"), key.alias("doc_id"), *more)


def cells(rows: DataFrame, good: DataFrame | None, bits: int, counted: bool = True, asks: bool = True) -> DataFrame:
    """(bucket, block, payload): the distinct n-grams of each block and how often they occur in all rows and in the target.

    rows: (block, doc_id, text[, target]); good: (block, doc_id) of the target, where rows don't tell. Without counted
    the counts are zero; without asks the block is -1, which gets no answer."""
    schema = "bucket int, block int, payload binary"

    def made(docs, wanted):
        import pyarrow as pa

        at, words, pairs, later, found = block_events(docs.column("text"))
        n = t = np.zeros(len(found), np.uint32)
        if counted:
            n = np.bincount(np.concatenate([words, pairs]), minlength=len(found)).astype(np.uint32)
            of = wanted[at]
            t = np.bincount(np.concatenate([words[of], pairs[of[later]]]), minlength=len(found)).astype(np.uint32)
        bucket = (found >> np.uint64(64 - bits)).astype(np.int32)
        names, begin = np.unique(bucket, return_index=True)
        ends = np.append(begin[1:], len(found))
        block = docs.column("block")[0].as_py() if asks and docs.num_rows else -1
        payload = [pack(found[a:b]) + pack(n[a:b]) + pack(t[a:b]) for a, b in zip(begin, ends)]
        return pa.table({"bucket": pa.array(names, pa.int32()), "block": pa.array(np.full(len(names), block, np.int32)), "payload": pa.array(payload, pa.binary())})

    def flagged(docs):
        return made(docs, docs.column("target").fill_null(False).to_numpy())

    def looked_up(docs, ids):
        import pyarrow.compute as pc

        return made(docs, pc.is_in(docs.column("doc_id"), value_set=ids.column("doc_id").combine_chunks()).to_numpy())

    if good is None:
        return rows.groupBy("block").applyInArrow(flagged, schema)
    return rows.groupBy("block").cogroup(good.groupBy("block")).applyInArrow(looked_up, schema)


def answers(asked: DataFrame) -> DataFrame:
    """(bucket, block, payload, n, t, distinct): the sums of each block's n-grams over all blocks, in order of their hashes.

    One row of each bucket has block -1, and the words of the bucket: occurrences in all rows, in the target, distinct ones."""

    def run(key, found):
        import pyarrow as pa

        blocks, payloads = found.column("block").to_pylist(), found.column("payload").to_pylist()
        sizes = [len(p) // 16 for p in payloads]
        h = np.concatenate([unpack(p[: 8 * m], np.uint64) for p, m in zip(payloads, sizes)])
        each = [np.concatenate([unpack(p[a * m : (a + 4) * m], np.uint32) for p, m in zip(payloads, sizes)]) for a in (8, 12)]
        names, at = np.unique(h, return_inverse=True)
        n, t = (np.bincount(at, x, len(names)).astype(np.uint64) for x in each)  # exact to 2**53
        word = (names & np.uint64(1) == 1) & (n > 0)
        ends, out = np.cumsum(sizes), []
        for m, end in zip(sizes, ends):
            k = at[end - m : end]
            out.append(pack(n[k]) + pack(t[k]))
        some = [i for i, b in enumerate(blocks) if b >= 0]
        cols = {"block": pa.array([blocks[i] for i in some] + [-1], pa.int32()), "payload": pa.array([out[i] for i in some] + [None], pa.binary())}
        told = dict(zip(("n", "t", "distinct"), (int(n[word].sum()), int(t[word].sum()), int(word.sum()))))
        cols |= {c: pa.array([None] * len(some) + [x], pa.int64()) for c, x in told.items()}
        return pa.table({"bucket": pa.array([key[0].as_py()] * (len(some) + 1), pa.int32()), **cols})

    return asked.groupBy("bucket").applyInArrow(run, "bucket int, block int, payload binary, n long, t long, distinct long")


@dataclass(frozen=True)
class Corpus:
    """The counted rows, how they were dealt, and the answers to their own blocks."""

    docs: DataFrame
    rows: DataFrame
    good: DataFrame | None
    blocks: int
    bits: int
    answers: DataFrame


@dataclass(frozen=True)
class Model:
    """Counts of one kind of rows: occurrences of words by bucket, the size of the vocabulary, and the corpus with the rest."""

    words: np.ndarray
    vocabulary: int
    corpus: Corpus | None = None

    def losses(self, counts: np.ndarray, words: np.ndarray, pairs: np.ndarray, later: np.ndarray) -> np.ndarray:
        p = (counts[words] + 0.5) / (float(self.words.sum()) + 0.5 * self.vocabulary)
        at = np.flatnonzero(later)
        p[at] = (counts[pairs] + STRENGTH * p[at]) / (counts[words[at - 1]] + STRENGTH)
        return -np.log(p)


def _blocks(docs: DataFrame, text: str) -> tuple[int, int]:
    """(blocks, bits of the buckets) for the bytes of docs."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(LEAST_BLOCKS, -(-size // BLOCK)), max(LEAST_BITS, int(size // 8 // BUCKET).bit_length())


def train(docs: DataFrame, text: str = "text", target: str = "target", good: DataFrame | None = None, doc_id: str = "doc_id") -> tuple[Model, Model]:
    """(target, background). Rows of the target have a true ``target``, or their doc_id in ``good`` if that is given."""
    blocks, bits = _blocks(docs, text)
    own = F.coalesce(F.col(text), F.lit("")).alias("text")
    flag = [F.col(target).alias("target")] if good is None else []
    rows = dealt(docs.select(F.col(doc_id).alias("doc_id"), own, *flag), "doc_id", blocks, "text", *["target"] * (good is None))
    ids = None if good is None else dealt(good.where(F.col(doc_id).isNotNull()), doc_id, blocks)
    found = scratch(answers(cells(rows, ids, bits)))
    told = found.where("block = -1").select("n", "t", "distinct").toArrow()
    n, t, distinct = (told.column(c).to_numpy() for c in ("n", "t", "distinct"))
    corpus, vocabulary = Corpus(docs, rows, ids, blocks, bits, found), max(1 << WORD_BITS, int(distinct.sum()))
    return Model(t, vocabulary, corpus), Model(n, vocabulary, corpus)


def score(docs: DataFrame, models: tuple[Model, Model], doc_id="doc_id", text="text") -> DataFrame:
    """(doc_id, n_tokens, ce_target, ce_background, score) per row of docs.

    Null and empty texts have no tokens and null scores; repeated rows get equal rows; other columns are not read. Where docs
    is the frame that was counted, its blocks have their answers already."""
    corpus = models[0].corpus
    if docs is corpus.docs:
        rows, found = corpus.rows.select("block", "doc_id", "text"), corpus.answers
    else:
        blocks, _ = _blocks(docs, text)
        rows = dealt(docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")), "doc_id", blocks, "text")
        known = cells(corpus.rows, corpus.good, corpus.bits, asks=False)
        found = answers(known.unionByName(cells(rows.withColumn("target", F.lit(False)), None, corpus.bits, counted=False)))
    bare = [Model(m.words, m.vocabulary) for m in models]

    def run(docs, told):
        import pyarrow as pa

        at, words, pairs, later, names = block_events(docs.column("text"))
        payloads = [p for _, p in sorted(zip(told.column("bucket").to_pylist(), told.column("payload").to_pylist()))]
        counts = [np.concatenate([np.zeros(0, np.uint64), *(unpack(p[len(p) // 2 * k : len(p) // 2 * (k + 1)], np.uint64) for p in payloads)]).astype(np.float64) for k in (1, 0)]
        if len(counts[0]) != len(names):
            raise ValueError("the rows changed since they were counted")
        n = np.bincount(at, minlength=docs.num_rows)
        means = [np.bincount(at, m.losses(c, words, pairs, later), docs.num_rows) / np.maximum(n, 1) for m, c in zip(bare, counts)]
        cols = [pa.array(x, mask=n == 0) for x in (means[0], means[1], means[0] - means[1])]
        return pa.table([docs.column("doc_id"), pa.array(n.astype(np.int64)), *cols], ["doc_id", "n_tokens", "ce_target", "ce_background", "score"])

    told = found.where("block >= 0").select("block", "bucket", "payload")
    return rows.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, "doc_id long, n_tokens long, ce_target double, ce_background double, score double")


def query(spark, sf_dir: str) -> DataFrame:
    """Target: the documents labelled as of good quality. Background: all documents. Labels grow with the corpus: they are dealt into
    the blocks of their documents, so texts move once to be counted and once to be scored."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct()
    return score(docs, train(docs, good=good))
