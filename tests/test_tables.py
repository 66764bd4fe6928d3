import io
import shutil
import time
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions.providers import Fatal, apply_provider, doubling, linear
from lectern.operators import audio, partitioning, relational, segments
from lectern.plans import pipeline
from lectern.sources import files, sinks
from lectern.streaming import progress


@pytest.mark.parametrize(
    ("t", "n", "want"),
    [
        ("fog\n\nbow", 2, ["fo", "g\n", "\n", "bo", "w"]), ("雾来\n船去\n灯灭", 4, ["雾来\n", "船去\n", "灯灭"]), ("fog\n\nbow\n\nsea", 6, ["fog\n\n", "bow\n\n", "sea"]),
        ("mooring", 3, ["moo", "rin", "g"]), ("", 5, []), (" \t", 5, []), ("x\r\ny\rz", 9, ["x\ny\nz"]), (None, 5, []),
    ],
)
def test_bounded_pieces(t, n, want):
    assert segments.bounded_pieces(t, n) == want


def test_bounded_pieces_lossless():
    t = "船过了桥。" * 9 + "\n\n" + "灯还亮着。" * 9
    got = segments.bounded_pieces(t, 33)
    assert "".join(got) == t and max(map(len, got)) <= 33 and len(got) >= 3
    with pytest.raises(ValueError):
        segments.bounded_pieces(t, 0)


def test_segment_rows_and_translation(spark):
    df = spark.createDataFrame([(1, "船来。\n\n灯灭。"), (2, None), (3, "")], "k bigint, t string")
    rows = segments.segment_rows(df, "k", "t", 5, trim=True).orderBy("segment_index").collect()
    assert [(r.k, r.segment_text) for r in rows] == [(1, "船来。"), (1, "灯灭。")]
    got = pipeline.translated(df, "k", "t", "fake", 5).collect()
    assert [(r.k, r.text) for r in got] == [(1, "译文：船来。\n\n译文：灯灭。")]
    jobs = pipeline.segment_jobs(df, "k", "t", 5)[1].orderBy("k").collect()
    assert [(r.total_units, r.status, r.error_message) for r in jobs] == [(2, "pending", None), (0, "failed", "chapter has no translatable text"), (0, "failed", "chapter has no translatable text")]


def test_provider_errors_stay_in_their_rows(spark):
    def call(prompts):
        if "bad" in prompts:
            raise ValueError("no such text")
        return [p.upper() for p in prompts]

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c")], "k bigint, p string").coalesce(1)
    got = {r.k: (r.status, r.result, r.error) for r in apply_provider(df, "k", "p", call, retries=1, wait=0.0).collect()}
    assert got == {1: ("completed", "A", None), 2: ("failed", None, "no such text"), 3: ("completed", "C", None)}


def test_providers_that_give_too_little_or_fail_for_good(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k bigint, p string").coalesce(1)
    short = lambda prompts: ["x"] * min(1, len(prompts)) if prompts != [""] else []
    got = {r.k: (r.status, r.error) for r in apply_provider(df, "k", "p", short, retries=0).collect()}
    assert got == {1: ("completed", None), 2: ("completed", None), 3: ("failed", "the provider gave no single result")}

    def final(prompts):
        raise Fatal("not again")

    started = time.perf_counter()
    rows = apply_provider(df, "k", "p", final, retries=5, wait=linear(30.0)).collect()
    assert {r.error for r in rows} == {"not again"} and time.perf_counter() - started < 20
    assert [linear()(k) for k in (0, 1)] == pytest.approx([0.1, 0.2]) and [doubling()(k) for k in (0, 3, 9)] == [1.0, 8.0, 30.0]
    sound = apply_provider(df, "k", "p", "fake speech", result="binary").first()
    assert files.decode_wav(bytes(sound.result))[:4] == (1, 2, 8000, 8)


def _jobs(spark):
    return spark.createDataFrame([(1, 7, "tts"), (2, 7, "tts"), (3, 8, "tts"), (4, None, "split"), (5, None, "split")], "id bigint, chapter_id bigint, kind string")


def test_relational(spark):
    jobs = _jobs(spark)
    seg = spark.createDataFrame([(1, 2, 0, "completed", "x"), (2, 2, 1, "failed", None), (3, 3, 0, "pending", None), (4, 3, 1, "pending", None), (5, 1, 0, "completed", "y")], "id bigint, job_id bigint, segment_index int, status string, result string")
    counts = {r.id: (r.segment_count, r.completed_count, r.pending_count) for r in relational.with_counts(jobs, seg).collect()}
    assert counts == {1: (1, 1, 0), 2: (2, 1, 0), 3: (2, 0, 2), 4: (0, 0, 0), 5: (0, 0, 0)}
    assert {r.id for r in relational.without_newer(jobs, ["chapter_id", "kind"]).collect()} == {2, 3, 4, 5}
    assert {r.id for r in relational.latest(jobs.where("chapter_id is not null"), ["chapter_id"], "id").collect()} == {2, 3}
    assert {r.job_id for r in relational.all_done(seg, "job_id", "result").collect()} == {1}
    assert {r.id for r in relational.next_in_queue(seg).collect()} == {3}
    assert {r.id for r in relational.next_in_queue(seg, workers=2).collect()} == {3, 4}
    left = relational.cascade_deleted({"j": jobs, "s": seg}, spark.createDataFrame([(2,)], "id bigint"), [("j", "id", "s", "job_id")])
    assert left["j"].count() == 4 and {r.id for r in left["s"].collect()} == {3, 4, 5}
    assert relational.with_counts(jobs.limit(0), seg).count() == 0


def test_replaced_and_stale(spark):
    old = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k bigint, v string")
    new = spark.createDataFrame([(1, "z")], "k bigint, v string")
    assert sorted(tuple(r) for r in relational.replaced(old, new, "k").collect()) == [(1, "z"), (2, "c")]
    res = spark.createDataFrame([(1, 7, 0), (2, 7, 1)], "id bigint, chapter_id bigint, rev bigint")
    ch = spark.createDataFrame([(7, 1)], "id bigint, content_revision int")
    assert [r.id for r in relational.stale_rejected(res, ch, F.col("rev")).collect()] == [2]


def test_upserted(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k bigint, v string, w int")
    new = spark.createDataFrame([(2, None), (3, "c")], "k bigint, v string")
    assert sorted(map(tuple, relational.upserted(old, new, "k").collect())) == [(1, "a", 5), (2, None, 6), (3, "c", None)]
    assert relational.upserted(old.limit(0), new.limit(0), "k").count() == 0


def test_placed_and_numbered(spark):
    rows = [(k, v) for k in range(5) for v in range(40 if k == 2 else 3)]
    df = spark.createDataFrame(rows, "k int, v int").repartition(3)
    for hot in (10, 1, 1000):  # one hot key, all, none
        assert sorted((r.k, r.v, r.p) for r in relational.placed(df, ["k"], ["v"], "p", hot).collect()) == [(k, v, v + 1) for k, v in rows]
    assert sorted(r.n for r in relational.numbered(df, ["k", "v"], "n").collect()) == list(range(1, len(rows) + 1))
    assert relational.placed(df.limit(0), ["k"], ["v"], "p").count() == 0


def test_peaks_and_silence(spark):
    df = spark.createDataFrame([([0] * 4 + [16384] * 4, 1), ([], 1), ([-32768], 1)], "s array<smallint>, c int")
    assert [r.p for r in df.select(audio.peaks(F.col("s"), F.col("c"), 2).alias("p")).collect()] == [[0.0, 0.5], None, [1.0]]
    assert [r.p for r in df.limit(1).select(audio.peaks(F.col("s"), F.lit(2), 2).alias("p")).collect()] == [[0.0, 0.5]]
    long = np.array([1000] * 800 + [0] * 24000 + [1000] * 800, dtype=np.int16)
    assert len(audio.collapsed_samples(long, 1, 8000)) == 11200
    assert audio.collapsed_samples(np.array([1000] * 800 + [0] * 4000 + [1000] * 800, dtype=np.int16), 1, 8000) is None
    assert audio.collapsed_samples(np.zeros(0, dtype=np.int16), 1, 8000) is None


def test_wav_epub_and_archives(spark, tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w/a.wav").write_bytes(files.encode_wav(np.arange(10), 1, 8000))
    (tmp_path / "w/b.wav").write_bytes(b"no sound")
    got = {r.path[-5:]: r for r in files.read_wav(files.binary_files(spark, str(tmp_path / "w"))).collect()}
    assert got["a.wav"].samples == list(range(10)) and got["a.wav"].duration_seconds == 0.001 and got["b.wav"].error == "unreadable"
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>')
        z.writestr("O/c.opf", '<package><manifest><item id="n" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="b" href="b%20x.xhtml" media-type="application/xhtml+xml"/><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="n"/><itemref idref="b"/><itemref idref="a"/></spine></package>')
        z.writestr("O/nav.xhtml", "<html><body><a href='b%20x.xhtml#f'>Second</a><a href='a.xhtml'>First</a></body></html>")
        z.writestr("O/b x.xhtml", "<html><head><title>t</title><script>x</script></head><body><p> B </p></body></html>")
        z.writestr("O/a.xhtml", "<html><body><h1>A</h1><p>x &amp; y</p></body></html>")
    (tmp_path / "e").mkdir()
    (tmp_path / "e/book.epub").write_bytes(buf.getvalue())
    (tmp_path / "e/bad.epub").write_bytes(b"not an epub")
    rows = files.read_epub_chapters(files.binary_files(spark, str(tmp_path / "e"))).orderBy("path", "chapter_index").collect()
    assert [(r.title, r.text, r.error) for r in rows] == [(None, None, "could not parse EPUB"), ("Second", "t\nB", None), ("First", "A\nx & y", None)]
    entries = spark.createDataFrame([("z", 1, "b.txt", bytearray(b"2")), ("z", 0, "a.txt", bytearray(b"1")), ("z", 2, "../x", bytearray(b"3"))], "archive string, position int, path string, content binary")
    z = zipfile.ZipFile(io.BytesIO(sinks.archives(entries).first().content))
    assert z.namelist() == ["a.txt", "b.txt"] and sinks.archive_manifest(entries).where("error is not null").count() == 1


def test_text_books(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfx\r\ny\n")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "c.txt").write_bytes(b"  ")
    got = {r.title: (r.full_text, r.error) for r in files.read_text_books(spark, str(tmp_path)).collect()}
    assert got == {"a": ("x\ny", None), "b": (None, "not UTF-8"), "c": (None, "empty file")}


def test_streams(spark, tmp_path):
    ev = [(1, "2025-01-01 00:00:00", 1, 1, "completed", 2, "new"), (2, "2025-01-01 00:01:00", 1, 1, "completed", 1, "late"), (2, "2025-01-01 00:01:00", 1, 1, "completed", 1, "late"), (3, "2025-01-01 00:30:00", 1, 2, "failed", 1, None)]
    df = spark.createDataFrame(ev, "event_id bigint, ts string, job_id bigint, segment_id bigint, status string, revision bigint, result string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "ev"))
    stream = progress.read_events(spark, str(tmp_path / "ev"))
    newest = progress.run_once(progress.newest_result(stream), str(tmp_path / "o1"), str(tmp_path / "c1"))
    assert [(r.segment_id, r.result) for r in newest.collect()] == [(1, "new")]
    closed = progress.run_once(progress.windowed_progress(stream, late="1 minute"), str(tmp_path / "o2"), str(tmp_path / "c2"), "append")
    assert sum(r.events for r in closed.collect()) == 2  # the repeated event once, the last window still open
    every = progress.run_once(progress.windowed_progress(stream, late=None), str(tmp_path / "o3"), str(tmp_path / "c3"))
    assert sum(r.events for r in every.collect()) == 4
    write = progress.upsert_newest(str(tmp_path / "t"))
    write(df.where("revision = 2").select("segment_id", "job_id", "revision", "result"), 0)
    write(df.where("revision = 1 and status = 'completed'").select("segment_id", "job_id", "revision", "result"), 1)
    read = lambda: sorted((r.segment_id, r.result) for r in progress.read_newest(spark, str(tmp_path / "t"), "segment_id bigint, job_id bigint, revision bigint, result string").collect())
    assert read() == [(1, "new")]
    more = spark.createDataFrame([(k, 9, 3, f"r{k}") for k in range(2, 40)], "segment_id bigint, job_id bigint, revision bigint, result string")
    for _ in range(2):  # a repeated batch writes the same again
        write(more, 2)
    assert read() == [(1, "new"), *((k, f"r{k}") for k in range(2, 40))]
    written = len(list((tmp_path / "t/v=1").glob("bucket=*")))
    assert written == 1  # only what the batch changed
    assert progress.read_newest(spark, str(tmp_path / "none"), "segment_id bigint").count() == 0


def test_a_lost_version_fails_the_batch(spark, tmp_path):
    """What is listed and can't be read is an error, not an empty table."""
    write = progress.upsert_newest(str(tmp_path / "t"))
    row = spark.createDataFrame([(1, 1, 1, "a")], "segment_id bigint, job_id bigint, revision bigint, result string")
    write(row, 0)
    for f in (tmp_path / "t/v=0").rglob("*.parquet"):
        f.unlink()
    shutil.rmtree(tmp_path / "t/v=0")
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        write(row, 1)


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    schema = "event_id bigint, ts timestamp, job_id bigint, segment_id bigint, status string, revision bigint, result string"
    part = lambda n: spark.createDataFrame([(n, n, n, "completed", 1, f"r{n}")], "event_id bigint, job_id bigint, segment_id bigint, status string, revision bigint, result string").withColumn("ts", F.lit("2025-01-01").cast("timestamp")).select(*(c.split()[0] for c in schema.split(", ")))
    run = lambda: {r.job_id: r.events for r in progress.run_once(progress.windowed_progress(progress.read_events(spark, str(tmp_path / "ev")), late=None), str(tmp_path / "o"), str(tmp_path / "c")).collect()}
    part(1).write.parquet(str(tmp_path / "ev"))
    assert run() == {1: 1}
    assert run() == {1: 1}  # nothing new, nothing counted twice
    part(2).write.mode("append").parquet(str(tmp_path / "ev"))
    assert run() == {1: 1, 2: 1}


def test_the_local_folder_is_for_local_sessions(spark, monkeypatch):
    class Fake:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})()
        sparkContext = type("S", (), {"master": "spark://host:7077", "getConf": lambda self: Fake.conf})()  # noqa: N815

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        partitioning.shared_dir(Fake())


def test_latest_keeps_wide_rows_whole(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, "b"), (3, 7, "c"), (4, 7, "d")], "id bigint, k bigint, v string")
    assert sorted((r.id, r.v) for r in relational.latest(df, ["k"], "id").collect()) == [(2, "b"), (4, "d")]
    assert sorted(tuple(r) for r in relational.latest(df.select("k", "id"), ["k"], "id").collect() if r.k) == [(7, 4)]
    assert relational.latest(df.limit(0), ["k"], "id").count() == 0


def test_files_limit_and_pages(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"12345")
    (tmp_path / "b.txt").write_bytes(b"123456")
    got = {r.title: r.error for r in files.read_text_books(spark, str(tmp_path), most=5).collect()}
    assert got == {"a": None, "b": "file too large"}
    df = spark.createDataFrame([(1, "<h1> Fog <b>bow</b></h1><title>no</title><p>a &lt; b<br>c"), (2, None), (3, "<style>x</style>")], "k int, html string")
    assert [(r.page_text, r.page_title) for r in files.pages_text(df).orderBy("k").collect()] == [("Fog\nbow\nno\na < b\nc", "Fog bow"), (None, None), ("", None)]


def test_merged_audio_refuses_mixed_parts(spark):
    rows = [(1, 0, [5000, 0, 0, 0], 1000), (1, 1, [6000], 1000), (2, 0, [1], 1000), (2, 1, [1], 999), (3, 0, None, 1000), (3, 1, [7], 1000)]
    df = spark.createDataFrame(rows, "k int, i int, samples array<smallint>, sample_rate int").withColumn("channels", F.lit(1)).withColumn("sample_width", F.lit(2))
    got = {r.k: r.samples for r in audio.merged_audio(df, ["k"], "i", ms=2, threshold=10).collect()}
    assert got == {1: [5000, 0, 0, 6000], 3: None}  # a part that cannot be read: no sound
    assert audio.merged_audio(df.limit(0), ["k"], "i").count() == 0
