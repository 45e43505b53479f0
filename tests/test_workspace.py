"""The workspace source: what is pushed down, what is opened, and pages."""

import os

from pyspark.sql import functions as F

from ferrograph.sources.workspace import page, workspace


def made(tmp_path):
    for path, text in {"a/one.md": "one é", "a/two.TXT": "two", "a/deep/three.md": "three", "b/four.json": "{}", "b/five.bin": "x", ".git/six.md": "six", "seven.md": "", "c/eight.rec": "result x"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    return str(tmp_path)


def test_documents(spark, tmp_path):
    rows = workspace(spark, made(tmp_path)).orderBy("path").collect()
    assert [(r["path"], r["folder"], r["kind"], r["text"]) for r in rows] == [
        ("a/deep/three.md", "a/deep", "markdown", "three"), ("a/one.md", "a", "markdown", "one é"), ("a/two.TXT", "a", "text", "two"),
        ("b/four.json", "b", "json", "{}"), ("c/eight.rec", "c", "record", "result x"), ("seven.md", "", "markdown", ""),
    ]
    assert rows[1]["size"] == 6 and workspace(spark, str(tmp_path), text=False).where("text is not null").count() == 0


def test_what_filters_leave_out_is_not_opened(spark, tmp_path):
    root = made(tmp_path)
    os.symlink("/nowhere", tmp_path / "b/broken.md")  # cannot be opened: a scan that meets it fails
    docs = workspace(spark, root)
    assert docs.where("kind = 'json'").count() == 1 and docs.where("folder in ('a', 'c')").count() == 3
    assert [r["path"] for r in docs.where(F.col("path").startswith("a/")).orderBy("path").collect()] == ["a/deep/three.md", "a/one.md", "a/two.TXT"]
    assert docs.where("path = 'a/one.md' and size > 3").count() == 1 and docs.where("path = 'a/one.md' and size > 30").count() == 0
    assert docs.where("kind = 'nothing'").count() == 0 and docs.where("folder = 'none'").count() == 0
    assert docs.where("kind = 'markdown' and folder = 'a'").rdd.getNumPartitions() == 1
    try:
        docs.where("folder = 'b'").count()
    except Exception as error:
        assert "broken.md" in str(error)
    else:
        raise AssertionError("the broken file was not read")


def test_pages_follow_one_another(spark, tmp_path):
    docs = workspace(spark, made(tmp_path), text=False)
    paths, after = [], None
    while got := [r["path"] for r in page(docs, 2, after).collect()]:
        paths += got
        after = got[-1]
    assert paths == ["a/deep/three.md", "a/one.md", "a/two.TXT", "b/four.json", "c/eight.rec", "seven.md"]
    assert page(docs, 2, "b/four.json").collect()[0]["path"] == "c/eight.rec"
