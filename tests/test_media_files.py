"""MP3 and WAV files, listings, scans over ranges and interval joins."""

import os
import random
import time
import wave

from pyspark.sql import functions as F

from callgrid.operators import intervals, media, operations, scans, sentiment
from callgrid.sources.listing import listed


def mp3(n, version=3, rate_at=9, sample_at=0, mode=3, pad=0):
    """n frames of silence, headers right and bodies empty."""
    head = (0x7FF << 21 | version << 19 | 1 << 17 | 1 << 16 | rate_at << 12 | sample_at << 10 | pad << 9 | mode << 6).to_bytes(4, "big")
    size = media.mp3_frame(head, 0)[0]
    return (head + bytes(size - 4)) * n


def tagged(n, announced, **how):
    first = bytearray(mp3(1, **how))
    at = 4 + (17 if how.get("mode", 3) == 3 else 32)
    first[at : at + 12] = b"Xing" + (1).to_bytes(4, "big") + announced.to_bytes(4, "big")
    return bytes(first) + mp3(n, **how)


def test_recordings_of_both_kinds(spark, tmp_path):
    id3 = b"ID3\x04\x00\x00\x00\x00\x01\x00" + bytes(128)
    files = {
        "plain.mp3": mp3(100), "tags.mp3": id3 + mp3(50, mode=0) + b"TAG" + bytes(125), "low.mp3": mp3(200, version=2, rate_at=8, sample_at=2), "lowest.mp3": mp3(200, version=0, rate_at=4, sample_at=2),
        "variable.mp3": mp3(30, rate_at=5) + mp3(30, rate_at=11, pad=1), "whole.mp3": tagged(100, 100), "near.mp3": tagged(98, 100), "short.mp3": tagged(90, 100), "cut.mp3": mp3(100)[:-10],
        "text.mp3": b"no sound here", "bare.mp3": id3, "broken.mp3": mp3(10) + b"rubbish" + mp3(10), "empty.wav": b"", "other.mp3": mp3(20) + mp3(20, sample_at=1),
    }
    (tmp_path / "deep").mkdir()
    for name, raw in files.items():
        (tmp_path / "deep" / name).write_bytes(raw)
    with wave.open(str(tmp_path / "sound.wav"), "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(8000)
        w.writeframes(bytes(4 * 16000))
    got = {os.path.basename(r["path"]): (r["codec"], r["rate"], r["channels"], r["duration_ms"], r["fault"]) for r in media.recordings(spark, str(tmp_path)).collect()}
    ms = lambda n, samples, rate: round(n * samples * 1000 / rate)
    assert got == {
        "plain.mp3": ("mp3", 44100, 1, ms(100, 1152, 44100), None), "tags.mp3": ("mp3", 44100, 2, ms(50, 1152, 44100), None), "low.mp3": ("mp3", 16000, 1, ms(200, 576, 16000), None), "lowest.mp3": ("mp3", 8000, 1, ms(200, 576, 8000), None),
        "variable.mp3": ("mp3", 44100, 1, ms(60, 1152, 44100), None), "whole.mp3": ("mp3", 44100, 1, ms(100, 1152, 44100), None), "near.mp3": ("mp3", 44100, 1, ms(98, 1152, 44100), None), "short.mp3": ("mp3", 44100, 1, ms(90, 1152, 44100), "TRUNCATED"),
        "cut.mp3": ("mp3", 44100, 1, ms(99, 1152, 44100), "TRUNCATED"), "text.mp3": (None, None, None, None, "FORMAT"), "bare.mp3": ("mp3", None, None, None, "FORMAT"), "broken.mp3": ("mp3", 44100, 1, ms(10, 1152, 44100), "FORMAT"),
        "other.mp3": ("mp3", 44100, 1, ms(20, 1152, 44100), "FORMAT"), "sound.wav": ("wav", 8000, 2, 2000, None),
    }


def test_listing_finds_orphans_of_a_real_folder(spark, tmp_path):
    for name in ("a/one", "a/deep/er/two", "b/three", "b/four", "top"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * len(name))
    old = time.time() - 3 * 86400
    for name in ("a/one", "a/deep/er/two", "b/three", "top"):
        os.utime(tmp_path / name, (old, old))
    rows = listed(spark, str(tmp_path))
    assert {(r["path"], r["size"]) for r in rows.collect()} == {(n, len(n)) for n in ("a/one", "a/deep/er/two", "b/three", "b/four", "top")}
    assert {r["path"] for r in listed(spark, str(tmp_path), "a/d", 2).collect()} == {"a/deep/er/two"}
    assert {r["path"] for r in listed(spark, str(tmp_path), "b").collect()} == {"b/three", "b/four"}
    used = spark.createDataFrame([("a/one",), ("elsewhere",)], "key string")
    gone = operations.orphans(rows, used, F.current_timestamp())
    assert {r["path"] for r in gone.collect()} == {"a/deep/er/two", "b/three", "top"}


def test_scans_equal_the_array_forms(spark):
    rng = random.Random(5)
    holds = [(c, s := rng.randrange(60_000), s + rng.randrange(400)) for c in range(4) for _ in range(3 if c == 3 else 150)] + [(9, 5, 5)]
    table = spark.createDataFrame(holds, "call_id long, start_ms long, end_ms long").repartition(7)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(intervals.long_merged(table).select("call_id", "start_ms", "end_ms")) == key(intervals.merge_intervals(table).select("call_id", "start_ms", "end_ms"))
    by = table.groupBy("call_id").agg(F.collect_list(F.struct("start_ms", "end_ms")).alias("h"))
    starts = table.select("call_id").distinct().select("call_id", (F.col("call_id") * 7000 + 50).alias("start_ms"), F.lit(20_000).cast("long").alias("opportunity_ms"))
    want = by.join(starts, "call_id").select("call_id", intervals.paused_deadline(F.col("start_ms"), F.col("opportunity_ms"), intervals.merged_array(F.col("h"))).alias("deadline_ms"))
    assert key(intervals.long_deadlines(starts, table)) == key(want)
    assert key(intervals.long_deadlines(starts, table.limit(0))) == sorted((r["call_id"], r["start_ms"] + 20_000) for r in starts.collect())
    times = spark.createDataFrame([(c, 30_000 * rng.randrange(400)) for c in range(3) for _ in range(250)] + [(7, 0)], "call_id long, alert_ms long")
    kept = times.groupBy("call_id").agg(F.collect_list("alert_ms").alias("a")).select("call_id", F.explode(sentiment.cooled(F.col("a"))).alias("alert_ms"))
    assert key(scans.kept_apart(times, "call_id", "alert_ms", 90_000)) == key(kept)
    assert key(scans.kept_apart(times.limit(0), "call_id", "alert_ms", 90_000)) == []


def test_interval_join_equals_the_theta_join(spark):
    rng = random.Random(6)
    some = lambda n, longest: [(rng.randrange(3), i, s := rng.randrange(-5000, 60_000), s + rng.randrange(-2, longest)) for i in range(n)]
    left, right = some(300, 900) + [(0, 998, -10, 70_000), (None, 999, 0, 10)], some(200, 5000) + [(0, 997, 0, 100_000), (1, 996, 5, 6)]
    a = spark.createDataFrame(left, "call_id long, i long, start_ms long, end_ms long")
    b = spark.createDataFrame(right, "call_id long, i long, start_ms long, end_ms long")
    got = sorted((r["i"], r["right_i"], r["overlap_ms"]) for r in intervals.overlapping(a, b).collect())
    want = sorted((i, j, min(e, f) - max(s, t)) for c, i, s, e in left for d, j, t, f in right if c is not None and c == d and s < e and t < f and min(e, f) > max(s, t))
    assert got == want and intervals.overlapping(a, b.limit(0)).count() == 0


def test_many_intervals_of_one_call(spark):
    """A million of each side in one call: pairs are few, and so is the work."""
    n = 1_000_000
    a = spark.range(n).select(F.lit(1).alias("call_id"), (F.col("id") * 10).alias("start_ms"), (F.col("id") * 10 + 4).alias("end_ms"))
    b = spark.range(n).select(F.lit(1).alias("call_id"), (F.col("id") * 10 + 2).alias("start_ms"), (F.col("id") * 10 + 12).alias("end_ms"))
    r = intervals.overlapping(a, b).agg(F.count(F.lit(1)).alias("n"), F.sum("overlap_ms").alias("ms")).collect()[0]
    assert (r["n"], r["ms"]) == (2 * n - 1, n * 2 + (n - 1) * 2)
