"""SimHash near-duplicates by pivot distance tables.

A document's fingerprint is the bitwise majority of the XXH64 hashes of its word shingles. Fingerprints that differ in at
most ``radius`` bits are linked, and linked documents form components.

The pivot table is computed once: each distinct fingerprint is stored with its Hamming distances to PIVOTS reference
fingerprints. By the triangle inequality a pair whose coordinates differ by more than the radius anywhere is discarded; what
survives is verified by its exact distance. Distances to any reference crowd about 32, so coordinates can't deal fingerprints
into small groups without meeting most pairs. The pairs to be tested therefore come from blocks of bits: cut into ``blocks``
blocks, two fingerprints within ``radius`` agree on all bits of blocks - radius of them at least, and those bits are a join key.

A bucket of more than ``tile`` fingerprints is dealt into tiles, so that no task holds an unbounded group. A tile returns
a spanning forest of its links, at most one row per member: the closure of all links is the same as if every pair were listed.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skimmer.llm.common import col, fresh, scratch, table

PIECE, PIVOTS = 1 << 15, 16


def fingerprint(text: bytes, size: int = 4) -> int:
    """Unsigned 64-bit SimHash of the words between ASCII white space, A-Z lower-cased; zero without words."""
    from xxhash import xxh64_intdigest as h

    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= size:
        return h(b" ".join(words), 42)  # one shingle: its own majority
    whole = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends[: len(words) - size])]
    n, ones = len(starts), np.zeros(64, np.int64)
    for at in range(0, n, PIECE):
        some = [h(whole[a:b], 42) for a, b in zip(starts[at : at + PIECE], ends[size - 1 + at : size - 1 + at + PIECE])]
        bits = np.unpackbits(np.array(some, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4) -> DataFrame:
    """(doc_id, text_hash, fp) per row of docs; fp is the signed view of the fingerprint. Null text: as an empty one."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = b.column(2).cast(pa.large_binary())
            fp = np.fromiter((fingerprint(t.as_py(), size) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], ["doc_id", "text_hash", "fp"])

    rows = docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, fp long")


def references(count: int = PIVOTS) -> np.ndarray:
    """Fixed random fingerprints."""
    return np.random.default_rng(20240229).integers(0, 1 << 64, count, dtype=np.uint64)


def distances(fp: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """One row per fingerprint, one coordinate per reference."""
    return np.bitwise_count(fp[:, None] ^ refs[None, :]).astype(np.int8)


def pivot_table(nodes: DataFrame) -> DataFrame:
    """(fp, node, pivots) of nodes (fp, node): pivots holds the coordinates, a byte each."""

    def run(batches):
        import pyarrow as pa

        refs = references()
        for b in batches:
            far = distances(b.column(0).to_numpy().view(np.uint64), refs)
            pivots = pa.FixedSizeBinaryArray.from_buffers(pa.binary(PIVOTS), len(far), [None, pa.py_buffer(np.ascontiguousarray(far))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pivots], ["fp", "node", "pivots"])

    return scratch(nodes.select("fp", "node").mapInArrow(run, "fp long, node long, pivots binary"))


def bucket_keys(fp: np.ndarray, blocks: int, radius: int) -> np.ndarray:
    """A key per fingerprint and choice of blocks - radius blocks: the bits of those blocks."""
    cut = [64 * i // blocks for i in range(blocks + 1)]
    keep = [sum(((1 << (cut[b + 1] - cut[b])) - 1) << cut[b] for b in c) for c in combinations(range(blocks), blocks - radius)]
    return fp[:, None] & np.array(keep, np.uint64)[None, :]


def forest(fp: np.ndarray, far: np.ndarray, radius: int) -> tuple[list[tuple[int, int]], int, int]:
    """(a spanning forest, as index pairs, of the links among fp, pairs met, pairs left to verify): each fingerprint is visited
    once. far: their pivot coordinates."""
    left, out, met, kept = np.arange(len(fp)), [], 0, 0
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            u = queue.pop()
            near = np.abs(far[left] - far[u]).max(axis=1) <= radius
            met, kept = met + len(left), kept + int(near.sum())
            near[near] = np.bitwise_count(fp[left[near]] ^ fp[u]) <= radius
            got = left[near]
            out += [(u, v) for v in got]
            queue += list(got)
            left = left[~near]
    return out, met, kept


def links(nodes: DataFrame, radius: int = 4, blocks: int = 7, tile: int = 4096, counted: bool = False) -> DataFrame:
    """Links (a, b), a < b, that connect the nodes (fp, node) just as all pairs within the radius do.

    Empty input: no rows. Fingerprints in nodes are distinct. counted: instead one row (met, kept, linked), the pairs that met in
    buckets, those that the pivot table left, and those that were within the radius."""

    def keyed(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, PIECE):
                rows = b.slice(at, PIECE)
                keys = bucket_keys(rows.column(0).to_numpy().view(np.uint64), blocks, radius)
                n, k = keys.shape
                which, row = np.tile(np.arange(k, dtype=np.int16), n), pa.array(np.repeat(np.arange(n), k))
                yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(keys.ravel().view(np.int64)), *(c.take(row) for c in rows.columns)], ["which", "key", "fp", "node", "pivots"])

    keys = pivot_table(nodes).mapInArrow(keyed, "which short, key long, fp long, node long, pivots binary")
    keys = scratch(keys)
    busy = keys.groupBy("which", "key").count().where(F.col("count") > tile)
    tiles = F.ceil(F.col("count") / tile).cast("int")
    cold, hot = keys.withColumn("tile", F.lit(0).cast("long")), None
    busy = scratch(busy)
    if not busy.isEmpty():
        cold = keys.join(busy, ["which", "key"], "left_anti").withColumn("tile", F.lit(0).cast("long"))
        own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("long")
        pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda t: F.least(t, F.col("own")) * F.col("tiles") + F.greatest(t, F.col("own")) + 1)
        hot = keys.join(busy.withColumn("tiles", tiles.cast("long")), ["which", "key"]).withColumn("own", own).withColumn("tile", F.explode(pair)).select(*cold.columns)
    dealt = (cold.unionByName(hot) if hot is not None else cold).repartition("which", "key", "tile").sortWithinPartitions("which", "key", "tile")

    def linked(batches):
        import pyarrow as pa

        def solve(t):
            which, key, fp, node, tiles = (t.column(c).to_numpy() for c in ("which", "key", "fp", "node", "tile"))
            fp = fp.view(np.uint64)
            far = np.frombuffer(b"".join(t.column("pivots").to_pylist()), np.int8).reshape(len(fp), PIVOTS)
            new = np.ones(len(fp), bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in (which, key, tiles)], axis=0)
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, len(fp)))
            a, b, met, kept = [], [], 0, 0
            for s, n in zip(starts[sizes > 24], sizes[sizes > 24]):
                pairs, m, k = forest(fp[s : s + n], far[s : s + n], radius)
                u, v = np.array(pairs, np.int64).reshape(-1, 2).T
                a.append(node[s + u])
                b.append(node[s + v])
                met, kept = met + m, kept + k
            small = (sizes > 1) & (sizes <= 24)
            starts, sizes = starts[small], sizes[small]
            for i in range(24):
                for d in range(1, 24 - i):
                    s = starts[sizes > i + d] + i
                    if not len(s):
                        break
                    met += len(s)
                    s = s[np.abs(far[s] - far[s + d]).max(axis=1) <= radius]
                    kept += len(s)
                    s = s[np.bitwise_count(fp[s] ^ fp[s + d]) <= radius]
                    a.append(node[s])
                    b.append(node[s + d])
            a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
            if counted:
                return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (met, kept, len(a))], ["met", "kept", "linked"])
            both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([*held, batch])
            last = [t.column(c)[-1].as_py() for c in ("which", "key", "tile")]
            same = np.all([t.column(c).to_numpy() == x for c, x in zip(("which", "key", "tile"), last)], axis=0)
            cut = int(np.argmax(same))  # the last bucket may go on in the next batch
            if cut:
                yield solve(t.slice(0, cut))
            held = t.slice(cut).to_batches()
        if held:
            yield solve(pa.Table.from_batches(held))

    if counted:
        return dealt.mapInArrow(linked, "met long, kept long, linked long").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("met", "kept", "linked")))
    return dealt.mapInArrow(linked, "a long, b long").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of each node in links (a, b): the smallest node reachable. Large-star and small-star rounds, by
    grouped minima and joins; each round is written to the scratch folder."""
    edges, mark = scratch(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()), None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = scratch(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = now
    raise RuntimeError("components did not settle")


def grouped(docs: DataFrame, id_col: str, text_col: str, size: int, radius: int) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id) per row of docs. root: the component's smallest fingerprint, as a long."""
    own = scratch(fingerprints(docs, id_col, text_col, size))
    nodes = scratch(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    stars = components(links(nodes.select("fp", F.col("fp").alias("node")), radius))
    rooted = scratch(nodes.join(stars.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root")))
    # a component of many fingerprints: its least id is found by partial minima, and joined back by root
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "root", "component_id")
    return own.join(named, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) per row of docs: repeated rows stay repeated, texts without words share fingerprint zero, and
    rows of one id but different texts are not linked by their id.

    A null id takes no part as a smallest id; its row gets the component of its fingerprint, or null if no id is there.
    Empty tables give no rows; other columns are not read."""
    return grouped(docs, id_col, text_col, size, radius).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, radius: int = 4) -> DataFrame:
    """docs with one row of each component: the one of the smallest id, then of the least hash of its text. Rows without an id
    stay as they are. Rows that repeat id and text are copies, whatever else they hold. Other rows of one id are rows of their own."""
    given, hash_ = fresh(docs, "__id", "__hash")
    rows = scratch(grouped(docs, id_col, text_col, size, radius).where("doc_id is not null").groupBy("doc_id", "text_hash", "root").agg(F.count("*").alias("n")))
    first = rows.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    rows = rows.join(first, "root").withColumn("stays", F.struct("doc_id", "text_hash") == F.col("first"))
    rows = scratch(rows.select(F.col("doc_id").alias(given), F.col("text_hash").alias(hash_), "n", "stays").where("n > 1 or not stays"))
    marked = docs.withColumns({given: col(id_col).cast("long"), hash_: F.xxhash64(F.coalesce(col(text_col).cast("string"), F.lit("")))})
    kept = marked.join(rows.select(given, hash_), [given, hash_], "left_anti").select(*map(col, docs.columns))
    more = rows.where("stays")  # rows that stand there more than once, one of each to keep
    if more.isEmpty():
        return kept
    return kept.unionByName(marked.join(more.select(given, hash_), [given, hash_], "left_semi").dropDuplicates([given, hash_]).select(*map(col, docs.columns)))


def query(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
