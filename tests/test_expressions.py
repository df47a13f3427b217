"""Truth tables of path, dimension and text expressions."""

import pytest
from pyspark.sql import functions as F

from arborplan.functions import dims, paths, text
from arborplan.operators import plan
from arborplan.operators.extract import sniff
from arborplan.operators.progress import Meter
from arborplan.plans import job


def values(spark, kind, rows, make):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {kind}")
    return [r.x for r in df.select("i", make.alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("kind", "make", "table"),
    [
        ("a string", lambda: paths.extension(F.col("a")), [("notes.md", "md"), ("photo.JPG", "jpg"), ("archive.tar.gz", "tar.gz"), ("backup.TAR.BZ2", "tar.bz2"), ("data.gz", "gz"), ("README", ""), (".gitignore", ""), ("file.", ""), (".tar.gz", "gz"), (".x.tar.gz", "tar.gz"), ("..foo", "foo"), ("file..", "")]),
        ("a string", lambda: dims.is_metadata(F.col("a")), [(".DS_Store", True), ("Thumbs.db", True), ("._x", True), ("System Volume Information", True), (".ds_storey", False), ("ds_store", False), ("_notes.txt", False), ("Trash Talk", False)]),
        ("a string", lambda: paths.flat_name(F.col("a")), [("README.md", "README.md"), ("src/main.go", "src_main.go"), ("docs/api/index.md", "api_index.md")]),
        ("a string", lambda: paths.title(F.col("a")), [("my_doc-v2.pdf", "my doc v2"), (".gitignore", ""), ("a.tar.gz", "a.tar")]),
        ("a string", lambda: paths.base_name(F.col("a")), [("a/b", "b"), ("a\\b", "b"), ("c", "c")]),
        ("a long", lambda: text.human_bytes(F.col("a")), [(0, "0 B"), (999, "999 B"), (1000, "1.0 kB"), (1500000, "1.5 MB"), (52400000, "52.4 MB"), (4200000000, "4.2 GB"), (999999, "1000.0 kB"), (2250, "2.2 kB"), (145650, "145.7 kB")]),
        ("a double", lambda: text.human_rate(F.col("a")), [(0.0, "— MB/s"), (-5.0, "— MB/s"), (58.3e6, "58.3 MB/s")]),
        ("a long", lambda: text.human_duration(F.col("a")), [(120_000_000, "0.1s"), (3_000_000_000, "3s"), (59_000_000_000, "59s"), (130_000_000_000, "2m10s"), (3_900_000_000_000, "1h05m"), (9_009_000_000_000, "2h30m")]),
        ("a long, b long, c long", lambda: text.eta_ns(F.col("a"), F.col("b"), F.col("c")), [(1, 100, 10**10, None), (10, 10, 10**10, None), (10, 100, 10**10, 90 * 10**9), (11, 12, 110_000_000, None)]),
        ("a string, b string", lambda: paths.overlaps(F.col("a"), F.col("b")), [("/a", "/a/b", True), ("/a/b", "/a", True), ("/a", "/ab", False), ("/A", "/a", True), ("/", "/x", True), ("/a", "/b", False)]),
        ("a string", lambda: paths.truncate_middle(F.col("a"), 20), [("short", "short"), ("x" * 30 + ".NEF", "x" * 9 + "…" + "x" * 6 + ".NEF")]),
    ],
)
def test_table(spark, kind, make, table):
    assert values(spark, kind, [r[:-1] for r in table], make()) == [r[-1] for r in table]


def test_names():
    def given(names):
        low = [n.lower() for n in names]
        split = [(n[: n.rindex(".")], n[n.rindex(".") :]) if "." in n else (n, "") for n in names]
        return plan.unique_names(names, low, [b for b, _ in split], [e for _, e in split], [b.lower() for b, _ in split], [e.lower() for _, e in split])

    assert given(["report.txt"] * 3) == ["report.txt", "report_1.txt", "report_2.txt"]
    assert given(["beach.JPG", "Beach.jpg", "BEACH.JPG"]) == ["beach.JPG", "Beach_1.jpg", "BEACH_2.JPG"]
    assert given(["a.txt", "a.txt", "a_1.txt"]) == ["a.txt", "a_1.txt", "a_1_1.txt"]
    assert given(["a_1.txt", "a.txt", "a.txt"]) == ["a_1.txt", "a.txt", "a_2.txt"]


def test_toggle():
    assert plan.toggled({"a"}, "a/b") == {"a"}
    assert plan.toggled({"a"}, "a") == set()
    assert plan.toggled({"a/b", "c"}, "a") == {"a", "c"}


def test_sniff():
    assert sniff(b" \n<!doctype html><p>") == "text/html; charset=utf-8"
    assert sniff(b"%PDF-1.4") == "application/pdf"
    assert sniff(b"\x89PNG\r\n\x1a\n") == "image/png"
    assert sniff(b"") == "text/plain; charset=utf-8"
    assert sniff(b"\x00\x01\x02\x05") == sniff(None) == "application/octet-stream"
    assert sniff(b"\x00\x00\x00\x10ftypmp42\x00\x00\x00\x00") == "video/mp4"


def test_meter():
    m = Meter()
    rate, stalled = m.observe(10**9, 10 * 10**9)
    assert rate == pytest.approx(1e8) and stalled == 0
    assert m.observe(10**9 + 1000, 10 * 10**9 + 10**6)[0] == rate
    assert m.observe(10**9 + 1000, 30 * 10**9)[1] == 30 * 10**9 - (10 * 10**9 + 10**6)
    assert m.observe(10**9 + 1001, 31 * 10**9)[1] == 0


def test_job_names():
    assert [job.safe_base(p) for p in ("/a/b", "/", "/photos", "/a/b/")] == ["b", "flattened", "photos", "b"]
    assert [job.valid_name(n) for n in ("a", " ", ".", "..", "a/b")] == [True, False, False, False, False]
    with pytest.raises(ValueError):
        job.JobSpec("/a", "/A/b").checked()
    assert job.JobSpec("/a/b", "/t", frozenset({"x"})).with_source("/c") == job.JobSpec("/c")
