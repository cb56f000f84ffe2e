"""Streams against tables and plain models: windows of samples over shuffled batches, coincidences, late rows."""

import random

import pytest
from pyspark.sql import functions as F

from chirplake.streaming import buffer, coincide

CHUNKS = "detector string, start double, samples array<double>"


def whole_windows(chunks, duration, stride, rate):
    """A model: samples by detector and number, and every window that has all of its."""
    size, step, held = round(duration * rate), round(stride * rate), {}
    for detector, start, samples in chunks:
        if start is not None and samples:
            for i, x in enumerate(samples):
                held.setdefault((detector, round(start * rate) + i), x)
    begins = {(d, (i - k) // step * step) for d, i in held for k in range(0, size, 1)}
    return sorted((d, w / rate, [held[d, w + i] for i in range(size)]) for d, w in begins if all((d, w + i) in held for i in range(size)))


def chunks_with_gaps(seed):
    rng, out = random.Random(seed), []
    for detector in ("H", "L"):
        at = -6
        while at < 60:
            n = rng.choice([1, 2, 3])
            if rng.random() > 0.12:
                out.append((detector, at / 2.0, [float(at + i) + rng.random() for i in range(n)]))
            at += n
    return out


@pytest.mark.parametrize(("duration", "stride"), [(4.0, 2.0), (3.0, 0.5), (1.0, 5.0)])
def test_windows_of_a_table(frame, duration, stride):
    rows = chunks_with_gaps(1)
    got = buffer.windows(frame([*rows, rows[3], ("H", None, [1.0]), ("H", 500.0, None), ("H", 501.0, [])], CHUNKS), duration, stride, 2.0)
    assert sorted((r.detector, r.start, r.samples) for r in got.collect()) == whole_windows(rows, duration, stride, 2.0)


def run(spark, folder, batches, make):
    """A stream over one file per batch."""
    for i, rows in enumerate(batches):
        rows.coalesce(1).write.parquet(f"{folder}/in/batch={i}")
    schema = batches[0].schema
    got = []
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    query = make(stream).writeStream.foreachBatch(lambda df, n: got.extend(df.collect())).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return got


def test_windows_of_a_stream_in_any_order(spark, frame, tmp_path):
    """Micro-batches within the watermark's reach, shuffled and repeated, give each whole window once."""
    rows = chunks_with_gaps(2)
    rng = random.Random(3)
    order = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 6))
    order.insert(5, order[2])
    done = lambda df: df.withColumn("done", F.timestamp_millis(((F.col("start") + F.size("samples") / 2 + 1000) * 1000).cast("long"))).withColumn("start", F.col("start") + 1000)
    batches = [done(frame(order[i : i + 12], CHUNKS)) for i in range(0, len(order), 12)]
    got = run(spark, str(tmp_path), batches, lambda s: buffer.streamed_windows(s, "done", 4.0, 2.0, 2.0, 8))
    assert sorted((r.detector, r.start - 1000, r.samples) for r in got) == whole_windows(rows, 4.0, 2.0, 2.0)


def test_chunks_behind_the_watermark_are_left_out(spark, frame, tmp_path):
    chunk = lambda t: ("H", float(t), [float(t), t + 0.5])
    timed = lambda rows: frame(rows, CHUNKS).withColumn("done", F.timestamp_seconds(F.col("start") + 1))
    batches = [timed([chunk(100), chunk(101)]), timed([chunk(200)]), timed([chunk(201)]), timed([chunk(102), chunk(103)])]
    got = run(spark, str(tmp_path), batches, lambda s: buffer.streamed_windows(s, "done", 2.0, 2.0, 2.0, 10))
    assert sorted(r.start for r in got) == [100.0, 200.0]


TRIGGERS = "id long, ms long"


def timed(frame, rows):
    return frame(rows, TRIGGERS).withColumn("at", F.timestamp_millis("ms")).drop("ms")


def pairs(a, b, reach):
    return sorted((i, j) for i, s in a for j, t in b if s is not None and t is not None and abs(s - t) <= reach)


def test_coincidences_of_tables(frame):
    rng = random.Random(1)
    a, b = ([(i, rng.randrange(-20_000, 200_000)) for i in range(150)] for _ in range(2))
    a += [(900, None), (901, 0), (901, 0)]
    b += [(900, None), (901, 500), (902, -500), (903, 501)]
    got = coincide.coincident(timed(frame, a), timed(frame, b), "at", 500, "left")
    rows = [(r.id, r.other_id) for r in got.collect()]
    found = pairs(a, b, 500)
    alone = [(i, None) for i, t in a if not any(i == x for x, _ in found)]
    assert sorted(rows, key=str) == sorted(found + alone, key=str)
    with pytest.raises(ValueError):
        coincide.coincident(timed(frame, a), timed(frame, b), "at", 500, "outer")


@pytest.mark.parametrize("how", ["inner", "left"])
def test_coincidences_of_streams(spark, frame, tmp_path, how):
    """One stream feeds both sides; a partner may come batches later, a late trigger is dropped, and a lonely one is given out when the clock has passed it."""
    rng = random.Random(5)
    base = [(i, 1_000_000 + 400 * i + rng.randrange(-900, 900)) for i in range(300)]
    tail = [(10_000, 3_000_000), (10_001, 3_000_100)]  # moves the clock on
    late = [(20_000, 1_000_000), (20_001, 1_000_010)]
    end = [(10_002, 3_900_000), (10_003, 3_900_001)]
    order = sorted(base, key=lambda r: r[1] + rng.randrange(0, 5000))
    batches = [timed(frame, rows) for rows in (order[:100], order[100:180], order[180:], tail, late, end)]
    got = run(spark, str(tmp_path), batches, lambda s: coincide.coincident(s.where("id % 2 = 0"), s.where("id % 2 = 1"), "at", 500, how, late=20))
    everything = base + tail + end
    a, b = [r for r in everything if r[0] % 2 == 0], [r for r in everything if r[0] % 2 == 1]
    found = pairs(a, b, 500)
    lonely = [(i, None) for i, t in a if not any(i == x for x, _ in found) and t < 3_000_000]
    assert sorted([(r.id, r.other_id) for r in got], key=str) == sorted(found + (lonely if how == "left" else []), key=str)
