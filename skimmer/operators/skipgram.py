"""Word vectors: skip-gram with negative sampling, trained on pieces of the sentences and averaged."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skimmer.scratch import scratch

# A part's bytes of text and a piece's most words; words of a list; words that are trained at once and by how many of them draws are shared; draws a row; table of draws.
PIECE, PIECE_WORDS, LISTED, BLOCK, BLOCKS, DRAWS, TABLE = 32 << 20, 8_000_000, 10_000, 32, 64, 16, 1 << 20
#: Within a batch a word moves as by so many occurrences at most, and by so much in one dimension: such sums are of stale vectors.
MOST_TIMES, MOST_STEP = 8, 0.25


def pieces_of(text: DataFrame, column: str = "text", least: int = 8) -> int:
    """As many pieces as 32 MB of text each, or least: a piece is one task's work, so their number grows with the text."""
    size = text.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]
    return max(least, -(-size // PIECE))


def _first(keys: np.ndarray, size: int) -> np.ndarray:
    """Vectors to begin with, small and random by a word's hash: alike in all pieces."""
    z = keys.view(np.uint64)[:, None] + np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (((z ^ (z >> np.uint64(31))) >> np.uint64(40)).astype(np.float32) / np.float32(1 << 24) - np.float32(0.5)) / np.float32(size)


def _train(ids: np.ndarray, sentence: np.ndarray, weights: np.ndarray, both: np.ndarray, rng, window: int, negative: int, rate: float, begun: float, whole: float) -> None:
    """One pass over a piece. ids and sentence: words and whose they are, in order; both: a row a word of its vector, then its vector as
    context, changed in place; the rate falls from where ``begun`` of ``whole`` passes are done.

    A batch is 64 blocks of 32 words, or fewer, so that there are 2,000 batches of a short piece too. A block meets its words, those about it and 16 drawn ones, each for as many draws as it stands for, in one product."""
    n, size, cols = len(ids), both.shape[1] // 2, BLOCK + 2 * window
    blocks = min(BLOCKS, 1 + len(ids) // (2000 * BLOCK))
    batch = BLOCK * blocks
    lead = -(-2 * window // BLOCK)  # blocks over which the last one's context reaches
    wide, mid = batch + lead * BLOCK, slice(window, window + BLOCK)
    ids = np.concatenate([np.zeros(window, np.int32), ids, np.zeros(wide + batch, np.int32)])
    sentence = np.concatenate([np.full(window, -1, np.int32), sentence, np.full(wide + batch, -2, np.int32)])
    apart = np.abs(np.arange(cols) - np.arange(BLOCK)[:, None] - window)
    apart[apart == 0] = window + 1
    apart = apart.astype(np.int16)
    band = np.arange(blocks)[:, None] * BLOCK + np.arange(cols)
    share = np.cumsum(weights**0.75)
    table = np.searchsorted(share, (np.arange(TABLE) + 0.5) / TABLE * share[-1]).astype(np.int32)
    slot, dims = np.zeros(len(both), np.int64), np.arange(2 * size)
    for at in range(0, n, batch):
        a = np.float32(rate * max(1 - (begun + at / n) / whole, 1e-4))
        words = np.concatenate([ids[at : at + wide], table[rng.integers(0, TABLE, blocks * DRAWS)]])
        rows = both.take(words, axis=0)
        x = rows[window : window + batch, :size].reshape(blocks, BLOCK, size)
        y = np.concatenate([rows[:wide, size:].take(band, axis=0), rows[wide:, size:].reshape(blocks, DRAWS, size)], axis=1)
        whose = sentence[at : at + wide].take(band)
        met = apart <= rng.integers(1, window + 1, (blocks, BLOCK, 1), dtype=np.int16)
        met &= whose[:, mid, None] == whose[:, None, :]
        s = x @ np.ascontiguousarray(y.transpose(0, 2, 1))
        s *= np.float32(0.5)
        np.tanh(s, out=s)
        s += 1
        s *= -a / 2  # minus the rate times the logistic function
        s[:, :, :cols] += a
        s[:, :, :cols] *= met
        s[:, :, cols:] *= met.sum(2, keepdims=True, dtype=np.float32) * np.float32(negative / DRAWS)
        step = np.zeros((len(words), 2 * size), np.float32)
        step[window : window + batch, :size] = (s @ y).reshape(batch, size)
        back = s.transpose(0, 2, 1) @ x
        about = step[:wide, size:].reshape(blocks + lead, BLOCK, size)
        for k in range(0, cols, BLOCK):
            some = back[:, k : min(k + BLOCK, cols)]
            about[k // BLOCK : k // BLOCK + blocks, : some.shape[1]] += some
        step[wide:, size:] = back[:, cols:].reshape(-1, size)
        slot[words] = np.arange(len(words))  # a word's steps are summed at its last place
        last = slot[words]
        held = np.bincount(last, minlength=len(words))
        here, again = np.flatnonzero(held), np.flatnonzero(held > 1)
        if len(again):
            times = np.bincount(np.concatenate([last[window : window + min(batch, n - at)], last[wide:]]), minlength=len(words))
            twice = np.flatnonzero(held[last] > 1)
            rank = np.cumsum(held > 1) - 1
            to = (rank[last[twice]] * (2 * size))[:, None] + dims
            total = np.bincount(to.ravel(), step.take(twice, axis=0).ravel()).reshape(-1, 2 * size)
            step[again] = total * np.minimum(1.0, MOST_TIMES / np.maximum(times[again], 1))[:, None]
        np.clip(step, -MOST_STEP, MOST_STEP, out=step)
        both[words[here]] = rows.take(here, axis=0) + step.take(here, axis=0)


def _coded(batches):
    """Rows of a piece: its sentences as numbers of words, batch by batch, and its words with their times, in the order of the numbers."""
    import pyarrow as pa

    names: dict = {}
    counts, at, size, after = np.zeros(0, np.int64), 0, 0, 0

    def row(piece, at, codes=None, lengths=None, words=None, counts=None):
        held = [[piece], [at], [codes], [lengths], [words], [counts]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(held, schema)], schema=schema)

    def listed():
        words = list(names)
        for i in range(0, len(words), LISTED):
            yield row(piece, i, words=words[i : i + LISTED], counts=counts[i : i + LISTED])

    fields = {"piece": pa.int64(), "at": pa.int32(), "codes": pa.binary(), "lengths": pa.binary(), "words": pa.list_(pa.string()), "counts": pa.list_(pa.int64())}
    schema = pa.schema(list(fields.items()))
    for batch in batches:
        if not batch.num_rows:
            continue
        piece, words = (batch.column("part")[0].as_py() << 32) + after, batch.column("words")
        flat = words.flatten().dictionary_encode()
        numbers = np.array([-1 if w is None else names.setdefault(w, len(names)) for w in flat.dictionary.to_pylist()] + [-1], np.int32)
        codes = numbers[flat.indices.fill_null(len(numbers) - 1).to_numpy()]
        counts = np.append(counts, np.zeros(len(names) - len(counts), np.int64)) + np.bincount(codes[codes >= 0], minlength=len(names))
        yield row(piece, at, codes.tobytes(), words.value_lengths().fill_null(0).to_numpy().astype(np.int32).tobytes())
        at, size = at + 1, size + len(codes)
        if size >= PIECE_WORDS:  # a part of too many words is more than one piece
            yield from listed()
            names.clear()
            counts, at, size, after = counts[:0], 0, 0, after + 1
    if size:
        yield from listed()


def _packed(rows: np.ndarray):
    """A binary value a row: arrays cost Spark a step an element."""
    import pyarrow as pa

    rows = np.ascontiguousarray(rows, np.float32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * (4 * rows.shape[1])), pa.py_buffer(rows)])


def _unpacked(column, wide: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, wide)


def word2vec(sentences: DataFrame, column: str = "words", size: int = 400, window: int = 5, least: int = 5, parts: int = 1, seed: int = 1, rounds: int = 1, negative: int = 5, rate: float = 0.025, key: str | None = None) -> DataFrame:
    """(word, vec array<double>) of the words that sentences (array<string>) have ``least`` times at least.

    Sentences are dealt into ``parts`` by key, if given. Each part is one task's work, or some tasks' if it is long: it begins with the same
    vectors and asks for its own words only; a word's vectors are then averaged over the parts that have it, by its times there. No task
    holds all words."""
    dealt = sentences.repartition(parts, key).sortWithinPartitions(key) if key else sentences.repartition(parts)
    dealt = dealt.select(F.spark_partition_id().cast("long").alias("part"), F.col(column).alias("words"))
    coded = scratch(dealt.mapInArrow(_coded, "piece long, at int, codes binary, lengths binary, words array<string>, counts array<long>"))
    texts = coded.where("codes IS NOT NULL").select("piece", "at", "codes", "lengths")
    asked = coded.where("words IS NOT NULL").select("piece", "at", F.posexplode(F.arrays_zip("words", "counts")).alias("i", "x"))
    asked = asked.select("piece", (F.col("at") + F.col("i")).alias("code"), F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    asked = asked.withColumn("total", F.expr("sum(n) OVER (PARTITION BY word)")).where(F.col("total") >= least)
    asked = asked.withColumn("key", F.xxhash64(F.lit(seed), "word"))

    def trainer(done: int):
        def train(own, asked):
            import pyarrow as pa

            asked, own = asked.sort_by("code").combine_chunks(), own.sort_by("at")
            n = len(asked)
            if n and len(own):
                both = _unpacked(asked.column("state"), 2 * size).copy() if done else np.concatenate([_first(asked.column("key").to_numpy(), size), np.zeros((n, size), np.float32)], axis=1)
                read = lambda name: np.concatenate([np.frombuffer(b.as_buffer(), np.int32) for b in own.column(name)])
                codes, lengths, at = read("codes"), read("lengths"), asked.column("code").to_numpy()
                places = np.full(max(codes.max(initial=-1), at.max()) + 2, -1, np.int32)  # the last one is for nulls
                places[at] = np.arange(n)
                ids = places[codes]
                sentence = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)[ids >= 0]
                rng = np.random.default_rng([seed, done, own.column("piece")[0].as_py()])
                _train(ids[ids >= 0], sentence, asked.column("total").to_numpy().astype(float), both, rng, window, negative, rate, done, rounds)
            else:
                both = np.zeros((n, 2 * size), np.float32)
            kept = both[:, :size] if done + 1 == rounds else both
            return pa.table({"word": asked.column("word"), "n": asked.column("n"), "state": _packed(kept)})

        return train

    def averager(last: bool):
        wide = size if last else 2 * size

        def mean(found):
            import pyarrow as pa

            words, n = found.column("word").combine_chunks().dictionary_encode(), found.column("n").to_numpy().astype(float)
            at, many = words.indices.to_numpy().astype(np.int64), len(words.dictionary)
            rows = _unpacked(found.column("state"), wide) * n[:, None]
            rows = np.bincount((at[:, None] * wide + np.arange(wide)).ravel(), rows.ravel(), many * wide).reshape(many, wide) / np.bincount(at, n, many)[:, None]
            if last:
                return pa.table({"word": words.dictionary, "vec": pa.ListArray.from_arrays(np.arange(many + 1, dtype=np.int32) * size, rows.ravel())})
            return pa.table({"word": words.dictionary, "state": _packed(rows)})

        return mean

    if rounds > 1:
        asked = scratch(asked)
    # some tasks a piece, so that few of them get two; a bucket of words gets about as many rows as a part has words
    spread = lambda rows: rows.repartition(4 * parts, "piece").groupBy("piece")
    bucket = F.pmod(F.xxhash64("word"), F.lit(max(parts, 8))).alias("bucket")
    model = None
    for done in range(rounds):
        told = asked.join(model, "word") if model else asked
        found = spread(texts).cogroup(spread(told)).applyInArrow(trainer(done), "word string, n long, state binary")
        found = found.select(bucket, "word", "n", "state").groupBy("bucket")
        if done + 1 == rounds:
            return found.applyInArrow(averager(True), "word string, vec array<double>")
        model = scratch(found.applyInArrow(averager(False), "word string, state binary"))
    raise ValueError("rounds must be 1 at least")
