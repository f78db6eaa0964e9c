"""Queries and their SQL twins on tables that the given ones do not have."""

import glob
import os

import duckdb

import __spark_entry__ as entry

LONG = "这一段正文足够长，可以作为可见文本保留下来。"


def both(spark, name, folder):
    """(rows of the query, rows of its SQL), sorted, over a folder of tables."""
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}/*.parquet'")
    found = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    rows = [tuple(r[c] for c in names) for r in entry.queries()[name](spark, str(folder)).collect()]
    return sorted(rows, key=repr), sorted(found.fetchall(), key=repr)


def write_pages(spark, folder, rows):
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(f"{folder}/pages.parquet")


def test_merge_pages_of_one_url(spark, tmp_path):
    """URLs with several pages: good and lost ones, equal bodies, seeds with and without a text, none in order."""
    page = lambda k, size: f"<title>Page {k}</title><p>{LONG} {k}</p>".ljust(size, "x")
    rows = [(9, "https://e.org/a", page("z", 91)), (4, "https://e.org/a", page("b", 92)), (5, "https://e.org/a", page("c", 90)), (3, "https://e.org/b", page("y", 91)), (8, "https://e.org/b", page("x", 91)), (2, "https://e.org/c", page("l", 90))]
    rows += [(7, "https://e.org/c", page("k", 95)), (11, "https://e.org/d", page("s", 91)), (12, "https://e.org/d", page("s", 91)), (13, "https://e.org/e", None), (14, "https://e.org/e", page("t", 91)), (15, "https://e.org/f", page("u", 91))]
    write_pages(spark, tmp_path, rows)
    got, want = both(spark, "merge_pages", tmp_path)
    assert got == want and len(got) == 6
    said = {r[0][-1]: r[4] for r in got}
    assert said["a"].startswith("看看这个") and said["b"] == "" and "HTTP 404" in said["c"]
    assert {r[0][-1]: r[3] for r in got}["a"] == "Page b"


def test_notes_longer_than_their_section(spark, tmp_path):
    """Texts that end before, at and after the 120,000 bytes that are looked at, or whose characters are cut there."""
    sizes = [10, 100, 119_900, *range(119_920, 119_960), 119_970, 130_000]
    rows = [(k, f"https://e.org/{k:03}", "<p>" + "x" * n) for k, n in enumerate(sizes)]
    rows += [(100 + n, f"https://e.org/{100 + n}", "<p>" + "x" * n + "链" * 41_000) for n in range(4)]
    rows += [(200, "https://e.org/200", "\\\\\" \"desc\":\"" + "\"" * 59_000), (201, "https://e.org/201", "\\\"" * 31_000), (202, "https://e.org/202", "a\x01\x1fb\x7f é&amp;amp;"), (203, "https://e.org/203", "<p>"), (204, "https://e.org/204", None), (205, None, "text"), (206, None, None), (207, None, "y" * 121_000)]
    write_pages(spark, tmp_path, rows)
    got, want = both(spark, "xhs_metadata", tmp_path)
    assert got == want and len(got) == len(rows)
    held = {r[0]: r[1:] for r in got}
    assert held[0] == ("https://e.org/000", "x" * 10, "someone") and held[len(sizes) - 1] == (rows[len(sizes) - 1][1], None, None)
    assert [n for n in range(4) if held[100 + n] == (None, None, None)] and [n for n in range(4) if held[100 + n][0]]
