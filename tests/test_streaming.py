"""The engine on a stream: stopped, resumed, late rows, state that ends, feedback, counts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from skimmer.operators import push
from skimmer.plans import filtering
from skimmer.streaming import engine, state
from skimmer.streaming import push as S
from skimmer.streaming.metrics import Counts, watched_batch

T0 = 1704067200000
DAY = 86_400_000


def line(i, text, ms, orig=None, user="u", followers=10):
    m = {"id_str": str(i), "text": text, "created_at": "x", "timestamp_ms": str(ms), "user": {"screen_name": user, "lang": "en", "followers_count": followers, "statuses_count": 1}, "entities": {"urls": [], "user_mentions": []}}
    if orig is not None:
        m["retweeted_status"] = {"id_str": str(orig), "text": text, "retweet_count": 1, "user": {"followers_count": 1, "statuses_count": 1}}
    return json.dumps(m)


def profiles(spark):
    rows = [(0, "red||fox", "fox && red||brown"), (1, "", "bird"), (2, "sea", "salt water||fox")]
    return filtering.load_profiles(spark.createDataFrame(rows, "pid int, optional string, required string"))


def put(tmp_path, name, lines):
    (tmp_path / "in").mkdir(exist_ok=True)
    (tmp_path / "in" / name).write_text("\n".join(lines) + "\n")


def stream_of(spark, tmp_path, **how):
    from skimmer.sources import readers

    thresholds = spark.createDataFrame([(p, 0.5) for p in range(3)], "pid int, threshold double")
    score = lambda rows: rows.withColumn("score", F.col("user.followers_count") / 100)
    return engine.filtered(readers.stream_lines(spark, str(tmp_path / "in"), 1), profiles(spark), thresholds, score, cap=2, hash_of=F.md5, lang="user.lang", **how)


def out_of(spark, tmp_path, stream):
    return sorted((r.seq, r.pid, r.kind, r.received, r.pushed) for r in engine.read_batches(spark, str(tmp_path / "rows"), stream.schema).collect())


def run(stream, tmp_path, **how):
    query = engine.start(stream, f"file://{tmp_path}/rows", f"file://{tmp_path}/check", **how)
    query.awaitTermination()
    return query


def sequential(files, cap=2):
    """The rule message by message: contents once for all, origins and the cap by profile and day."""
    index = [(0, {"red", "fox"}, [{"fox"}, {"red", "brown"}]), (1, {""}, [{"bird"}]), (2, {"sea"}, [{"salt water", "fox"}])]
    hashes, origins, count, received, out = set(), set(), {}, {}, []
    for m in (json.loads(x) for f in files for x in f):
        again = m.get("retweeted_status")
        text = f"{m['user']['screen_name']} {again['text'] if again else m['text']}".lower()
        words = set(text.split()) | {w for w in ("salt water",) if w in text}
        best = max(((len(o & words) / len(o)) ** 0.5, -p) for p, o, c in index if all(x & words for x in c)) if any(all(x & words for x in c) for _, _, c in index) else None
        score = m["user"]["followers_count"] / 100
        if best is None or (best[0] / 2 + 0.5) * score < 0.15 or text in hashes:
            continue
        hashes.add(text)
        pid, ms, orig = -best[1], int(m["timestamp_ms"]), again["id_str"] if again else m["id_str"]
        key = (pid, ms // DAY)
        if (key, orig) in origins:
            continue
        received[key] = received.get(key, 0) + 1
        if count.get(key, 0) < cap and round(score, 12) > 0.5:
            count[key] = count.get(key, 0) + 1
            origins.add((key, orig))
            out.append((ms, pid, "pushed", received[key], count[key]))
        out.append((ms, pid, "related", received[key], count.get(key, 0)))
    return sorted(out)


def files_of(rng, n_files=4, each=40):
    texts = ["red fox", "brown fox runs", "a bird", "salt water fox", "nothing here", "bird sings", "red fox sea"]
    at, files = 0, []
    for _ in range(n_files):
        lines = []
        for _ in range(each):
            at += 1
            lines.append(line(at, rng.choice(texts) + f" {rng.randrange(12)}", T0 + at * DAY // 60, orig=rng.choice([None, None, rng.randrange(at)]), followers=rng.randrange(101)))
        files.append(lines)
    return files


def test_stream_that_fails_and_resumes_equals_the_sequence(spark, tmp_path):
    files, counts = files_of(random.Random(5)), Counts()
    want = sequential(files)
    (tmp_path / "in").mkdir()
    assert any(x[2] == "pushed" for x in want) and len(want) > 20
    stream = stream_of(spark, tmp_path, keep_days=400)
    for i in range(2):
        put(tmp_path, f"f{i}", files[i])
        run(stream, tmp_path)
    assert out_of(spark, tmp_path, stream) == sequential(files[:2])
    put(tmp_path, "f2", files[2])
    written = engine.write_batches(f"file://{tmp_path}/rows")

    def breaks(batch, at):  # after writing, before the batch is committed
        written(batch, at)
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        run(stream_of(spark, tmp_path, keep_days=400), tmp_path, write=breaks)
    put(tmp_path, "f3", files[3])
    spark.streams.addListener(counts)
    run(stream_of(spark, tmp_path, keep_days=400), tmp_path)
    counts.wait()
    spark.streams.removeListener(counts)
    assert out_of(spark, tmp_path, stream) == want
    assert counts.total("received", "n") == 80  # the two last files; the broken batch counts once


def scored_stream(spark, tmp_path, parts, **more):
    schema = "seq long, hash string, orig_id long, pid int, day string, score double, threshold double, ts timestamp" + "".join(f", {k} double" for k in more)
    for rows in parts:
        df = spark.createDataFrame([(s, h, o, p, None, x) for s, h, o, p, x, _ in rows], "seq long, hash string, orig_id long, pid int, day string, score double")
        ts = {s: ms for s, *_, ms in rows}
        df = df.withColumn("ts", F.timestamp_millis(F.element_at(F.create_map(*(F.lit(v) for kv in ts.items() for v in kv)), F.col("seq"))))
        df = df.withColumns({"day": F.date_format("ts", "yyyyMMdd"), "threshold": F.lit(0.5)} | {k: F.lit(v) for k, v in more.items()})
        df.selectExpr(*(f"cast({c.split()[0]} as {c.split()[1]}) {c.split()[0]}" for c in schema.split(", "))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_contents_end_and_late_rows_are_left_out(spark, tmp_path):
    parts = [
        [(1, "a", 1, 0, 0.9, T0), (2, "b", 2, 0, 0.9, T0 + 1000)],
        [(3, "a", 1, 0, 0.9, T0 + DAY // 2), (4, "far", 9, 0, 0.9, T0 + 10 * DAY)],  # the watermark moves on after this
        [(5, "late", 5, 0, 0.9, T0 + 1000), (6, "a", 1, 0, 0.9, T0 + 10 * DAY), (7, "far", 9, 0, 0.9, T0 + 10 * DAY + 5)],
    ]
    stream = scored_stream(spark, tmp_path, parts).withWatermark("ts", "1 day")
    got = S.run_available(state.first_contents(stream, ["hash"], keep_days=2)).collect()
    # 3 is known; 5 is late; 6 is new again, as its content ended; 7 is known
    assert sorted(r.seq for r in got) == [1, 2, 4, 6]


def test_day_state_ends(spark, tmp_path):
    parts = [[(i, f"h{i}", i, 0, 0.9, T0 + i) for i in range(3)], [(10, "x", 10, 0, 0.9, T0 + 20 * DAY)], [(11, "y", 11, 0, 0.9, T0 + 20 * DAY + 1)]]
    stream = scored_stream(spark, tmp_path, parts)
    got = S.run_available(S.pushes(stream, cap=2)).collect()
    assert sorted((r.seq, r.received, r.pushed) for r in got) == [(0, 1, 1), (1, 2, 2), (10, 1, 1), (11, 2, 2)]


def test_times_after_2262_are_kept(spark, tmp_path):
    far = T0 + 400 * 365 * DAY
    parts = [[(1, "a", 1, 0, 0.9, far), (2, "b", 2, 0, 0.9, far + 1000)], [(3, "a", 1, 0, 0.9, far + DAY), (4, "c", 2, 0, 0.9, far + DAY)]]
    rows = scored_stream(spark, tmp_path, parts).withWatermark("ts", "1 day")
    got = S.run_available(state.decided(state.first_contents(rows, ["hash"]), ["pid", "day"], cap=1, more=["hash"])).collect()
    assert sorted((r.seq, r.kind, r.received, r.pushed) for r in got) == [(1, "pushed", 1, 1), (1, "related", 1, 1), (2, "related", 2, 1), (4, "pushed", 1, 1), (4, "related", 1, 1)]
    assert {r.day[:4] for r in got} == {"2423"}


def slow_adaptive(rows, cap):
    state_, out = {}, []
    for seq, pid, score, threshold, predicted in rows:
        received, pushed, t, w = state_.get(pid, (0, 0, threshold, 0.618))
        received += 1
        if pushed != cap:
            if round(score, 12) > t:
                pushed += 1
                out.append((seq, pushed))
            if received / predicted > w:
                t, w = t * 0.95, w * 1.1
        state_[pid] = (received, pushed, t, w)
    return sorted(out)


@pytest.mark.parametrize("predicted", [0.5, 3.0, 40.0])
def test_adaptive_threshold_both_forms(spark, tmp_path, predicted):
    rng = random.Random(int(predicted * 2))
    rows = [(i, rng.randrange(3), rng.random() * 0.5, 0.4, predicted) for i in range(150)]
    df = spark.createDataFrame(rows, "seq long, pid int, score double, threshold double, predicted double")
    want = slow_adaptive(rows, 6)
    assert sorted((r.seq, r["at"]) for r in push.adaptive(df, cap=6).collect()) == want
    for at in range(0, 150, 50):
        df.where(F.col("seq").between(at, at + 49)).withColumns({"day": F.lit("20240101"), "ts": F.timestamp_millis(F.lit(T0) + F.col("seq"))}).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    kinds = "seq long, pid int, score double, threshold double, predicted double, day string, ts timestamp"
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert sorted((r.seq, r.pushed) for r in S.run_available(S.adaptive(stream, cap=6)).collect()) == want


def test_adaptive_threshold_of_nothing_and_without_prediction(spark):
    kinds = "seq long, pid int, score double, threshold double, predicted double"
    assert push.adaptive(spark.createDataFrame([], kinds)).collect() == []
    rows = [(1, 0, 0.5, 0.4, None), (2, 0, 0.39, 0.4, 0.0), (3, 0, None, 0.4, 1.0)]
    assert [r.seq for r in push.adaptive(spark.createDataFrame(rows, kinds)).collect()] == [1]


def slow_feedback(files):
    """Batch by batch, message by message; the words of a batch's records count from the next one on."""
    index = {0: ({"red", "fox"}, [{"fox"}, {"red", "brown"}]), 1: ({""}, [{"bird"}]), 2: ({"sea"}, [{"salt", "fox"}])}
    best, terms, out = {}, {}, {}
    for batch, rows in enumerate(files):
        lent = {p: [w for w, _ in sorted(terms.get(p, {}).items(), key=lambda x: (-x[1], x[0]))[:2]] for p in index}
        for seq, text in rows:
            words = set(text.split())
            met = [(len((own | set(lent[p])) & words) / 2 + 0.5, -p) for p, (own, c) in index.items() if all(x & words for x in c)]
            if not met:
                continue
            sim, p = max(met)[0], -max(met)[1]
            out[seq] = (p, sim, batch)
            if sim > 1.0 and sim > best.get(p, 0.0):
                best[p] = sim
                for w in words:
                    terms.setdefault(p, {})[w] = terms.setdefault(p, {}).get(w, 0.0) + sim
    return out, lent


def test_feedback_over_batches_that_run_again(spark, tmp_path):
    rng = random.Random(3)
    vocabulary = "red fox brown bird sea salt tree hill lake moss".split()
    files = [[(b * 20 + i, " ".join(rng.sample(vocabulary, rng.randrange(1, 7)))) for i in range(20)] for b in range(4)]
    want, lent = slow_feedback(files)
    assert any(lent.values())
    rows = [(0, "red||fox", "fox && red||brown"), (1, "", "bird"), (2, "sea", "salt||fox")]
    run_batch = engine.Feedback(filtering.load_profiles(spark.createDataFrame(rows, "pid int, optional string, required string")), f"file://{tmp_path}/out")
    for b, rows in enumerate(files):
        frame = spark.createDataFrame(rows, "seq long, text string")
        for _ in range(2 if b == 2 else 1):
            run_batch(frame, b)
    got = spark.read.schema("seq long, pid int, similarity double, batch int").parquet(f"{tmp_path}/out/rows").collect()
    assert {r.seq: (r.pid, r.similarity, r.batch) for r in got} == want and len(got) == len(want)


def test_batch_counts(spark):
    rows, seen = watched_batch(spark.range(100), "b", n=F.count("*"), even=F.count_if(F.col("id") % 2 == 0))
    rows.write.format("noop").mode("overwrite").save()
    assert seen.get == {"n": 100, "even": 50}


def test_larger_batches_have_more_files_and_stay_batches(spark, monkeypatch):
    from skimmer.plans import queries
    from skimmer.scratch import scratch_path

    rows = spark.createDataFrame([(i, "x" * 100) for i in range(2000)], "seq long, text string")
    monkeypatch.setattr(queries, "STREAM_FILE_BYTES", 9_000, raising=False)
    got: dict = {}
    stream = queries._in_batches(rows, "seq")
    files = {}

    def write(batch, at):
        seen = batch.select("seq", F.input_file_name().alias("file")).collect()
        got[at], files[at] = sorted(r.seq for r in seen), len({r.file for r in seen})

    stream.writeStream.foreachBatch(write).option("checkpointLocation", scratch_path(spark)).trigger(availableNow=True).start().awaitTermination()
    assert got == {i: list(range(500 * i, 500 * i + 500)) for i in range(4)} and files == dict.fromkeys(range(4), 6)
