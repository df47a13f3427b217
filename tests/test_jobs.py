"""Scans, plans, copies and duplicates over real trees, the stream twin of the meter, and the catalogue's plan invariants."""

import datetime
import hashlib
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from arborplan.operators import dedup, extract, plan, progress
from arborplan.operators import tree as tree_ops
from arborplan.plans import catalogue, job
from arborplan.sources import copy, tree
from arborplan.streaming import rate


def grow(root, files):
    for rel, data in files.items():
        p = root / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)


FLAT = ["README.md", "src/main.go", "src/util.go", "tests/main.go", "docs/api/index.md", "skipme/secret.txt", "skipme/deep/x.txt"]


def test_flat_plan(spark, tmp_path):
    grow(tmp_path / "s", {r: r.encode() for r in FLAT} | {".DS_Store": b"x", "Trip/.Trashes/y": b"y", "._z": b"z"})
    os.symlink(tmp_path / "s/README.md", tmp_path / "s/link")
    rows = job.planned(spark, job.JobSpec(str(tmp_path / "s"))).collect()
    assert {r.dst for r in rows} == {"README.md", "src_main.go", "src_util.go", "tests_main.go", "api_index.md", "skipme_secret.txt", "deep_x.txt"}
    some = job.planned(spark, job.JobSpec(str(tmp_path / "s"), excluded=frozenset({"skipme"}))).collect()
    assert len(some) == 5
    assert job.planned(spark, job.JobSpec(str(tmp_path / "none"))).count() == 0


def test_organised_copy(spark, tmp_path):
    names = ["README.md", "photo.JPG", "LICENSE", ".gitignore", "archive.tar.gz", "src/main.go", "tests/main.go"]
    grow(tmp_path / "s", {r: r.encode() for r in names})
    os.utime(tmp_path / "s/LICENSE", (915192000, 915192000))
    rows = job.run(spark, job.JobSpec(str(tmp_path / "s"), str(tmp_path / "t"), mode="organize")).collect()
    assert all(r.error is None for r in rows)
    got = {r.dst: (tmp_path / "t" / r.dst).read_text() for r in rows}
    assert got["Code/go/main.go"] == "src/main.go" and got["Code/go/main_1.go"] == "tests/main.go"
    assert {"Other/no-extension/LICENSE", "Other/no-extension/.gitignore", "Archives/tar.gz/archive.tar.gz", "Images/jpg/photo.JPG", "Documents/md/README.md"} < got.keys()
    assert abs((tmp_path / "t/Other/no-extension/LICENSE").stat().st_mtime - 915192000) < 2


def test_failures_are_rows(spark, tmp_path):
    grow(tmp_path, {"ok.bin": bytes(500)})
    p = spark.createDataFrame([(0, str(tmp_path / "ok.bin"), "ok.bin"), (1, str(tmp_path / "gone"), "gone")], "seq long, src string, dst string")
    rows = {r.seq: r for r in copy.copied(p, str(tmp_path / "t")).collect()}
    assert rows[0].bytes == 500 and rows[1].error_class == "FileNotFoundError" and not (tmp_path / "t/gone").exists()


def test_stall(tmp_path):
    os.mkfifo(tmp_path / "pipe")
    try:
        copy.copy_file(str(tmp_path / "pipe"), str(tmp_path / "out"), 0.4)
        raise AssertionError
    except copy.Stalled:
        assert not (tmp_path / "out").exists()


def test_duplicates(spark, tmp_path):
    head = bytes(65536)
    grow(tmp_path, {"a": head + b"one", "b": head + b"two", "c": head + b"one", "d": b"x", "e": b"x", "f": b"", "g": b""})
    rows = [(i, str(tmp_path / n), (tmp_path / n).stat().st_size) for i, n in enumerate("abcdefg")] + [(7, str(tmp_path / "none"), 1)]
    files = spark.createDataFrame(rows, "seq long, src string, size long")
    found, bad = copy.duplicate_files(files, stall_s=0)
    assert sorted((r.size, r.keep, r.seq) for r in found.collect()) == [(1, 3, 3), (1, 3, 4), (65539, 0, 0), (65539, 0, 2)]
    assert [r.seq for r in bad.collect()] == [7]
    held = spark.createDataFrame([(i, s, None if i == 7 else bytes(open(p, "rb").read())) for i, p, s in rows], "seq long, size long, content binary")
    assert dedup.summary(held).collect()[0].asDict() == {"sets": 2, "files": 2, "bytes": 65540, "hashed": 8}
    assert [tuple(r) for r in dedup.reported(dedup.sets(held)).collect()] == [(65539, 0, [2]), (1, 3, [4])]
    # Sizes 1, 1, 1 and three of 65539 are candidates; the last announces as many as there are.
    steps = [tuple(r) for r in copy.hash_progress(files).collect()]
    assert steps == [(k, 6) for k in range(1, 7)]
    plan_df = files.select("seq")
    assert sorted(r.seq for r in dedup.resolved(plan_df, dedup.members(held), "skip").collect()) == [0, 1, 3, 5, 6, 7]
    assert dedup.resolved(plan_df, dedup.members(held), "cancel").count() == 0
    assert dedup.resolved(plan_df, dedup.members(held.where("seq < 2")), "cancel").count() == 8


def test_only_what_must_be_is_read(spark, tmp_path):
    """Unique sizes are never opened; equal heads are read whole, unlike heads aren't. Readable by the files' access times of a folder where nobody may open others."""
    head = bytes(65536)
    cases = {
        "sizes": {"a": b"1", "b": b"22", "c": b"333"},
        "heads": {"a": b"\1" * 262144, "b": b"\2" * 262144, "c": b"\3" * 262144},
        "wholes": {"a": head + b"one", "b": head + b"two", "c": head + b"one"},
    }
    for name, want in (("sizes", 0), ("heads", 3), ("wholes", 6)):
        grow(tmp_path / name, cases[name])
        rows = [(i, str(tmp_path / name / n), len(d)) for i, (n, d) in enumerate(cases[name].items())]
        files = spark.createDataFrame(rows, "seq long, src string, size long")
        opened = spark.sparkContext.accumulator(0)
        inner = copy.hashed

        def hashed(df, limit=-1, stall_s=0, inner=inner, opened=opened):
            out = inner(df, limit, stall_s)

            def count(batches):
                for b in batches:
                    opened.add(len(b))
                    yield b

            return out.mapInPandas(count, out.schema)

        copy.hashed = hashed
        try:
            found, _ = copy.duplicate_files(files, stall_s=0)
            found.count()
        finally:
            copy.hashed = inner
        assert opened.value == want, name


def test_contents_are_not_shuffled(spark):
    held = spark.createDataFrame([(0, 3, b"abc"), (1, 3, b"abc"), (2, 1, b"x")], "seq long, size long, content binary")
    for df in (dedup.members(held), dedup.summary(held), dedup.by_head(held)):
        plan_text = df._jdf.queryExecution().executedPlan().toString()
        lines = plan_text.split("\n")
        for i, line in enumerate(lines):
            if "Exchange hashpartitioning" in line:
                assert "content" not in lines[i + 1].split("AS")[0] or "sha2" in lines[i + 1], lines[i : i + 2]


def test_plan_is_greedy(spark):
    names = ["a.txt", "A.txt", "a_1.txt", "a.txt", "a_1_1.txt", "a_1.txt", "_1.txt", ".txt", ".txt", "x/a", "x/a", "x/A_1", "t.tar.gz", "T.tar.gz"] * 3
    df = spark.createDataFrame([(i, n, n) for i, n in enumerate(names)], "seq long, src string, dst string")
    got = [r.dst for r in plan.assign_unique(df).orderBy("seq").collect()]
    used, want = set(), []
    for n in names:
        cut = n.rfind(".") if n.rfind(".") > n.rfind("/") else len(n)
        c, i = n, 0
        while c.lower() in used:
            i += 1
            c = f"{n[:cut]}_{i}{n[cut:]}"
        used.add(c.lower())
        want.append(c)
    assert got == want


def test_stream_equals_batch(spark, tmp_path):
    log = spark.createDataFrame([(j, i, i * 1000 * (i % 3), i * 200_000_000) for j in ("a", "b") for i in range(30)], "job string, seq long, bytes long, elapsed_ns long")
    log.write.parquet(str(tmp_path / "log"))
    q = rate.metered(spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))).writeStream.format("memory").queryName("metered").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (r.job, r.seq)
    assert sorted(spark.table("metered").collect(), key=key) == sorted(progress.rates(log).collect(), key=key)


def test_catalogue(spark):
    sf = "/root/testdata/sf0.001"
    rows = catalogue.QUERIES["plan_flatten"](spark, sf)
    assert rows.count() == rows.select(F.lower("dst")).distinct().count() > 0
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)
    assert catalogue.QUERIES["copy_report"](spark, sf).where("error_class is not null").count() == 1


def test_rate_meter_is_whole(spark, tmp_path):
    n = 1500
    start = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
    events = [(j * n + i, "ab"[j], (i * 37 % 101) / 4, start + datetime.timedelta(seconds=i * (900 + i % 7))) for j in range(2) for i in range(n)]
    spark.createDataFrame(events, "event_id long, event_type string, value double, ts timestamp").write.parquet(str(tmp_path / "events.parquet"))
    want = {}
    for j in range(2):
        done, last_at, last_bytes, rate, moved = 0, 0, 0, 0.0, 0
        for seq, _, value, ts in events[j * n : (j + 1) * n]:
            at = (ts - start) // datetime.timedelta(microseconds=1) * 1000 // catalogue.FASTER
            more = round(value * 100)
            done, moved = done + more, at if more else moved
            if at > last_at and (rate == 0 or at - last_at >= 300_000_000):
                now = (done - last_bytes) / ((at - last_at) / 1e9)
                rate = now if rate == 0 else 0.6 * rate + 0.4 * now
                last_at, last_bytes = at, done
            want["ab"[j], seq] = (rate, at - moved)
    got = {(r.job, r.seq): r for r in catalogue.QUERIES["rate_meter"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys()
    assert all(abs(r.rate - want[k][0]) < 1e-3 * max(1, abs(r.rate) * 1e-6) and r.stalled_ns == want[k][1] for k, r in got.items())


def test_copy_report_covers_the_plan(spark):
    sf = "/root/testdata/sf0.001"
    size = {r.rel: r.n for r in catalogue.doc_manifest(spark, sf).selectExpr("rel", "octet_length(coalesce(text, '')) as n").collect()}
    want = {r.seq: (r.dst, size[r.src]) for r in catalogue.QUERIES["plan_flatten"](spark, sf).collect()}
    got = {r.seq: r for r in catalogue.QUERIES["copy_report"](spark, sf).collect()}
    assert got.keys() == want.keys() and got.pop(7).error_class == "FileNotFoundError"
    assert {k: (r.dst, r.bytes) for k, r in got.items()} == {k: v for k, v in want.items() if k != 7}
    assert all(r.error_class is None for r in got.values())


def test_large_family_without_counters(spark):
    """A hundred thousand files of one name are numbered in the JVM, and rows with counters of their own in a stream."""
    df = spark.range(100_000).selectExpr("id as seq", "cast(id as string) as src", "if(id % 2 = 0, 'README.md', 'readme.MD') as dst")
    got = plan.assign_unique(df)
    assert "MapInPandas" in got._jdf.queryExecution().toString()
    assert got.select(F.lower("dst")).distinct().count() == 100_000
    assert {r.seq: r.dst for r in got.where("seq in (0, 1, 99999)").collect()} == {0: "README.md", 1: "readme_1.MD", 99999: "readme_99999.MD"}


def test_numbers_are_kept(spark):
    df = spark.range(1000).selectExpr("id as k", "hash(id) as part", "id as __k")
    got = plan.numbered(df, F.col("part"), F.col("k"), parts=7)
    want = [r.k for r in df.orderBy("part", "k").collect()]
    assert got.columns == ["k", "part", "__k", "seq"] and [r.k for r in got.orderBy("seq").collect()] == want
    assert [r.seq for r in got.orderBy("seq").collect()] == list(range(1000))


def test_sniffed_equals_sniff(spark):
    heads = [None, b"", b"  \n<!doctype html>", b"<HTML>", b"<htmlx", b"<!-- x", b"<?xml ?>", b"%PDF-1", b"\xfe\xffab", b"\xef\xbb\xbfa", b"GIF87a", b"GIF88a", b"RIFFabcdWEBPVP8", b"RIFF\n\0\x85\xffWAVE",
             b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff\xe0", b"ID3", b"\x00\x00\x00\x18ftypmp42abcdmp41isom", b"\x00\x00\x00\x10ftypisommp42", b"\x00\x00\x00\x14ftypisomabcdmp42", b"\x00\x00\x00\xffftypmp42", b"PK\x03\x04", b"a\x00b", b"plain \xc3\xa9", b"\x1bx", b"\x85\n<b>", b"a\n" * 300 + b"\x00"]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(heads)], "i int, content binary")
    got = {r.i: r.m for r in df.select("i", extract.sniffed(F.col("content")).alias("m")).collect()}
    assert got == {i: extract.sniff(h) for i, h in enumerate(heads)}


def test_inspect_reads_heads_only(spark, tmp_path):
    grow(tmp_path, {"a_b.html": b"<html>" + b"x" * 5000, ".DS_Store": b"\0", "sub/c.txt": b"c", "d.gif": b"GIF89a"})
    rows = [tuple(r) for r in job.inspect(spark, str(tmp_path)).collect()]
    assert rows == [(".DS_Store", "", "application/octet-stream", 1), ("a_b.html", "a b", "text/html; charset=utf-8", 5006), ("d.gif", "d", "image/gif", 6)]
    read = spark.read.format("tree").option("path", str(tmp_path)).option("content", "true").option("head", "512").load()
    assert max(len(r.content) for r in read.where("kind = 'file'").collect()) == 512


def test_one_large_subtree_is_split(spark, tmp_path):
    grow(tmp_path / "s", {f"only/d{i}/f{j}.txt": b"x" for i in range(12) for j in range(3)} | {"only/._m/x": b"x", "top.txt": b"x"})
    tree.register(spark)
    df = spark.read.format("tree").option("path", str(tmp_path / "s")).option("dirs", "true").option("bundles", "8").load()
    assert df.rdd.getNumPartitions() == 8
    got = sorted(r.rel for r in df.collect())
    assert got == sorted(["top.txt", "only", *(f"only/d{i}" for i in range(12)), *(f"only/d{i}/f{j}.txt" for i in range(12) for j in range(3))])
    out = spark.read.format("tree").option("path", str(tmp_path / "s")).option("dirs", "true").option("exclude", "only/d3").option("depth", "2").load()
    assert sorted(r.rel for r in out.collect()) == sorted(["top.txt", "only", *(f"only/d{i}" for i in range(12) if i != 3)])


def test_report_and_failures(spark):
    rows = spark.createDataFrame([(1, "b", 0, "gone"), (0, "a", 52_400_000, None), (2, "c", 0, "no data for 1s")], "seq long, src string, bytes long, error string")
    assert progress.report(rows, 2_000_000_000).collect()[0].asDict() == {"items": 3, "failed": 2, "bytes": 52_400_000, "text": "52.4 MB in 2s  ·  26.2 MB/s average"}
    assert [r.line for r in progress.failure_lines(rows).collect()] == ["b: gone", "c: no data for 1s"]


def test_tree_rows(spark):
    df = tree_ops.entries(spark.createDataFrame([("B/x",), ("a/y",), ("a/k/z",), ("c/.Trashes/z",), (".Trashes/q",)], "rel string"))
    assert [r.name for r in tree_ops.children(df, "").orderBy("place").collect()] == ["B", "a", "c"]
    assert [r.name for r in tree_ops.page(tree_ops.children(df, ""), 1, 5).orderBy("place").collect()] == ["a", "c"]
    assert tree_ops.expand({"B"}, df, "a") == {"B", "a"} and tree_ops.expand({"B"}, df, "c") == {"B"}
    assert tree_ops.collapse({"a", "a/k"}, "a") == ({"a/k"}, "a") and tree_ops.collapse({"a"}, "a/k") == (set(), "a") and tree_ops.collapse(set(), "a") == (set(), "a")


def test_stall_cases(tmp_path):
    def feed(times, gap):
        path = str(tmp_path / f"pipe{times}{gap}")
        os.mkfifo(path)

        def write():
            with open(path, "wb", buffering=0) as f:
                for _ in range(times):
                    f.write(bytes(1024))
                    time.sleep(gap)
                if times < 12:
                    time.sleep(1.5)

        threading.Thread(target=write, daemon=True).start()
        return path

    # Moving slowly is no stall; a dribble that stops is one, and leaves no target.
    assert copy.copy_file(feed(12, 0.1), str(tmp_path / "slow"), 0.8) == 12288
    with pytest.raises(copy.Stalled):
        copy.copy_file(feed(2, 0.05), str(tmp_path / "stopped"), 0.5)
    assert not (tmp_path / "stopped").exists()
    (tmp_path / "large").write_bytes(bytes(range(256)) * 40000)
    assert copy.copy_file(str(tmp_path / "large"), str(tmp_path / "copy"), 5) == 10_240_000 and (tmp_path / "copy").read_bytes() == (tmp_path / "large").read_bytes()
    assert copy.hash_file(str(tmp_path / "large"), 100, 5) == hashlib.sha256((bytes(range(256)) * 40000)[:100]).hexdigest()
