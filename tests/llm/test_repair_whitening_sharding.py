"""Conversation repair, whitening and sharding against brute force, on odd rows and on the driver's small tables."""

import collections
import hashlib
import heapq
import os
import random
import re
import zlib

import numpy as np
import pytest

from skimmer.llm import conversation_repair, sharding, whitening

DATA = "/root/testdata/sf0.001"
TALK = "conv_id long, turn long, role string, text string, key string, kind int, live int, audit string, signature string"

# -- 11 -----------------------------------------------------------------------------------------------------------------


def damaged(rows):
    for conv, turn, role, text in rows:
        sp = lambda v: " " if v is None else v
        h, role, text = zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20, sp(role), sp(text)
        if h == 1:
            text = ""
        if h == 2:
            text = re.sub("[.!?]", "", text)
        if h == 4:
            role = "user"
        yield from [(conv, turn, role, text)] * (0 if h == 0 else 2 if h == 3 else 1)


def slow_report(rows):
    """Cheapest edits by shortest paths over (row, roles so far); the heap's order breaks ties by the audit."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    turns = {r[1] for r in rows if r[1] is not None}
    gaps, seen, faults = max(turns) - min(turns) + 1 - len(turns) if turns else 0, set(), []
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]", r[3])
        faults.append("blank" if not words else "duplicate" if r[2:] in seen else "truncated" if words[-1] not in ".!?" else "")
        seen.add(r[2:])
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    goal, heap, done = re.compile(r"(s?(ua)+)?"), [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, roles, out = heapq.heappop(heap)
        if (i, roles if len(roles) < 2 else roles[-1]) in done:
            continue
        done.add((i, roles if len(roles) < 2 else roles[-1]))
        if i == len(rows) and goal.fullmatch(roles):
            return (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())
        legal = lambda x: len(x) == 1 and any(goal.fullmatch(roles + x + y) for y in ("", "a", "ua"))
        steps = [("I", 3, 0, n[0], f"{n}:") for n in ("user", "assistant")]
        if i < len(rows):
            role, text, extra = rows[i][2], rows[i][3], 3 * (faults[i] == "truncated")
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, roles, out))
            if faults[i] not in ("blank", "duplicate"):
                steps += [("K", extra, 1, role[:1], f"{role}:{text}")] + [("R", 3 + extra, 1, n[0], f"{n}:{text}") for n in ("user", "assistant")]
        for edit, more, on, x, line in steps:
            if legal(x):
                heapq.heappush(heap, (cost + more, audit + edit, i + on, roles + x, (*out, line)))


def talk(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, 1, "x", "x") for r in rows], TALK)


def random_rows(rng, convs, most):
    rows = []
    for c in [*range(convs), None]:
        for t in range(rng.randrange(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "super"])
            rows.append((c, rng.choice([t, t, t + 3, None, 5]), role, rng.choice(["Hi.", "Hi.", "no end", "", " \n", None, "Wäre das? \t", "x" * 300 + "!", "."])))
    return rows


def by_conv(rows):
    out = collections.defaultdict(list)
    for r in rows:
        out[r[0]].append(r)
    return out


def test_repair_equals_shortest_paths(spark):
    rows = random_rows(random.Random(11), 150, 9)
    frame = talk(spark, rows)
    got = {r.conv_id: tuple(r)[1:] for r in conversation_repair.report(conversation_repair.damaged(frame), live="live").collect()}
    want = {c: slow_report(damaged(x)) for c, x in by_conv(rows).items()}
    assert got == want
    plain = {r.conv_id: tuple(r)[1:] for r in conversation_repair.report(frame).collect()}
    spaced = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert plain == {c: slow_report(x) for c, x in by_conv(spaced).items()}


def test_repaired_rows_have_the_reported_hash_and_order(spark):
    frame = talk(spark, random_rows(random.Random(12), 60, 12))
    hashes = {r.conv_id: r.repaired_sha256 for r in conversation_repair.report(frame).collect()}
    lines = collections.defaultdict(dict)
    for r in conversation_repair.repaired(frame).collect():
        lines[r.conv_id][r.place] = (r.role, r.text)
    for c, h in hashes.items():
        rows = [lines[c][i] for i in range(len(lines[c]))]
        assert re.fullmatch(r"(s?(ua)+)?", "".join(r[0][:1] for r in rows))
        assert hashlib.sha256("\n".join(f"{a}:{b}" for a, b in rows).encode()).hexdigest() == h


def test_repair_of_a_long_conversation_and_of_none(spark):
    rng = random.Random(13)
    rows = [(7, t, rng.choice(["user", "assistant"]), f"{t % 5000} {rng.choice(['.', ''])}") for t in range(15_000)]
    found = conversation_repair.report(talk(spark, rows + [(8, 0, "user", "Yes.")])).collect()
    long = next(r for r in found if r.conv_id == 7)
    edits = collections.Counter(long.audit)
    assert edits["K"] + edits["R"] + edits["D"] == 15_000 and long.duplicate + long.truncated > 5_000 and edits["D"] >= long.duplicate
    assert conversation_repair.report(talk(spark, [])).collect() == [] and conversation_repair.repaired(talk(spark, [])).collect() == []
    gone = next(r for r in ((c, 0, "user", "A.") for c in range(1000)) if zlib.crc32(f"{r[0]}:0".encode()) % 20 == 0)
    (only,) = conversation_repair.report(conversation_repair.damaged(talk(spark, [gone])), live="live").collect()
    assert tuple(only) == (gone[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


@pytest.mark.parametrize("seed", range(3))
def test_audit_of_random_signatures(seed):
    rng = random.Random(seed)
    roles = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
    for _ in range(150):
        sign = "".join(rng.choice("suaoSUAOxuaua") for _ in range(rng.randrange(9)))
        rows = [(0, i, *(("user", "") if x == "x" else (roles[x.lower()], f"{i}" + "." * x.islower()))) for i, x in enumerate(sign)]
        want = slow_report(rows)
        assert conversation_repair.audit(sign) == (want[6], want[5])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_repair_query(spark):
    got = {r.conv_id: tuple(r)[1:] for r in conversation_repair.query(spark, DATA).collect()}
    rows = by_conv(tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect())
    assert got == {c: slow_report(damaged(x)) for c, x in rows.items()}


# -- 12 -----------------------------------------------------------------------------------------------------------------

VEC = "vec_id long, embedding array<float>, component int, n long, x string"


def vectors(spark, vs):
    return spark.createDataFrame([(i, v, 1, 1, "x") for i, v in enumerate(vs)], VEC)


def slow_white(x, k):
    n, total = len(x), x.sum(axis=0)
    centred = (n * x - total) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    return centred @ axes[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum(), ((n * x - total).astype(object) ** 2).sum(axis=1)


def held_against(found, ids, x, k):
    white, share, deviation = slow_white(x, k)
    rows = {(r.vec_id, r.component): r for r in found}
    assert len(rows) == len(found) == len(ids) * k and {r.n for r in found} == {len(ids)}
    got = np.array([[rows[i, c + 1].whitened for c in range(k)] for i in ids])
    sign = np.sign((got * white).sum(axis=0))
    assert np.abs(got - white * sign).max() < 1e-9
    assert all(abs(r.explained / share[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9 for r in found)
    assert all(int(rows[i, 1].deviation) == int(d) for i, d in zip(ids, deviation))


@pytest.mark.parametrize("block", [None, 9])
def test_whitening_equals_eigenvectors(spark, block):
    rng = np.random.default_rng(5)
    vs = [list(map(float, v)) for v in (rng.normal(size=(300, 24)) * np.linspace(3, 0.2, 24)).astype(np.float32)]
    vs[:0] = [vs[0], vs[0]]
    odd = [None, [], [None] * 24, [1.0] * 23 + [None], [float("nan")] * 24, [float("inf")] + [0.0] * 23, [1.0, 2.0]]
    found = whitening.whiten(vectors(spark, vs + odd), k=6, block=block).collect()
    x = np.floor(64 * np.array(vs)).astype(np.int64) + 1_000_000
    held_against(found, list(range(len(vs))), x, 6)
    if block:
        fitted = whitening.fit(whitening.whole(vectors(spark, vs), "vec_id", "embedding"), k=6, block=block)
        assert fitted.passes > 3 and fitted.residual < 1e-11


def test_whitening_of_too_little(spark):
    for vs in ([], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 5):
        assert whitening.whiten(vectors(spark, vs)).collect() == []
    line = whitening.whiten(vectors(spark, [[float(i), 2.0 * i, 0.0] for i in range(9)])).collect()  # one direction only
    assert {r.component for r in line} == {1} and len(line) == 9 and all(abs(r.explained - 1) < 1e-12 for r in line)
    big = whitening.whiten(vectors(spark, [[float(i) * 2**27, 0.5] for i in range(50)])).collect()
    x = np.array([[i * 2**33 + 1_000_000, 1_000_032] for i in range(50)])
    assert {int(r.deviation) for r in big} == set(((50 * x.astype(object) - x.sum(axis=0)) ** 2).sum(axis=1))
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(vectors(spark, [[1e30], [1.0]])).collect()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_whitening_query(spark):
    found = whitening.query(spark, DATA).collect()
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    held_against(found, [r.vec_id for r in rows], np.floor(64 * np.array([r.embedding for r in rows], float)).astype(np.int64) + 1_000_000, 32)


# -- 13 -----------------------------------------------------------------------------------------------------------------

DOC = "doc_id long, text string, shard string, slot int, size int, part int, __size int"


def shards_of(spark, rows, tmp_path, **how):
    frame = spark.createDataFrame([(i, t, "s", 1, 1, 1, 1) for i, t in rows], DOC)
    return sharding.write_shards(frame, f"file://{tmp_path}/out", **how).toDF(*(f"own_{c}" for c in frame.columns), "shard", "slot", "size").collect()


def held(found, rows, shards, tolerance=0.001):
    size = lambda t: len((t or "").encode()) + 1
    assert collections.Counter((r.own_doc_id, r.own_text) for r in found) == collections.Counter(rows)
    assert all(r.size == size(r.own_text) and r.own_shard == "s" for r in found)
    by = collections.defaultdict(list)
    for r in found:
        by[r.shard].append(r)
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values()) and set(by) <= set(range(shards))
    total, most = sum(size(t) for _, t in rows), max((size(t) for _, t in rows), default=0)
    for s in range(shards):  # boundaries stand within the tolerance, or at the nearest row
        assert abs(sum(r.size for r in by[s]) - total / shards) <= 2 * tolerance * total / shards + most


@pytest.mark.parametrize("part_bytes", [1 << 20, 2000])
def test_shards_are_even_and_slots_gapless(spark, tmp_path, part_bytes):
    rng = random.Random(13)
    rows = [(i, rng.choice(["é" * rng.randrange(400), "word " * rng.randrange(50), None, ""])) for i in range(1500)]
    rows += [(5000 + i, "one text of many") for i in range(1500)] + [(9999, "the same row")] * 700 + [(None, "no id")] * 20 + [(None, None)]
    held(shards_of(spark, rows, tmp_path, part_bytes=part_bytes), rows, 8)


def test_shards_of_a_very_long_text_and_of_nothing(spark, tmp_path):
    rows = [(i, "ab" * 20) for i in range(300)] + [(1000, "x" * 3_000_000)]
    found = shards_of(spark, rows, tmp_path / "a", shards=3)
    held(found, rows, 3)
    assert shards_of(spark, [], tmp_path / "b") == []
    assert [(r.own_doc_id, r.slot) for r in shards_of(spark, [(1, "only")], tmp_path / "c")] == [(1, 0)]


def test_equal_texts_stand_together(spark, tmp_path):
    rows = [(i, f"text {i % 40}") for i in range(4000)]
    by = collections.defaultdict(set)
    for r in shards_of(spark, rows, tmp_path):
        by[r.own_text].add(r.shard)
    assert sum(len(x) > 1 for x in by.values()) <= 7 and all(max(x) - min(x) == len(x) - 1 for x in by.values())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_sharding_query(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    want = {r.doc_id: (len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows}
    found = sharding.query(spark, DATA).collect()
    assert {r.doc_id: (r["size"], r.text_crc32) for r in found} == want and len(found) == len(rows)
    assert {(r.law, r.grown_shard) for r in found} == {("bytes", None)}
    assert len({(r.shard, r.slot) for r in found}) == len(rows) and {r.shard for r in found} <= set(range(8))
