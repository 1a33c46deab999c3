"""The paginated source: batches, resumed streams, works on several pages, bad pages."""

import json

import pytest

from loomspan.sources import pages


def put(root, number, results, part="part-0.txt"):
    folder = root / f"page={number}"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / part).write_text(json.dumps({"meta": {"page": number}, "results": results}))


def works(*ids):
    return [{"id": i, "title": f"T{i} é"} for i in ids]


def test_batches_have_each_work_once(spark, tmp_path):
    put(tmp_path, 0, works("a", "b", "a"))
    put(tmp_path, 2, works("b", "c"))
    put(tmp_path, 2, [{"id": None}, {"title": "no id"}, {"id": 7}], "part-1.txt")
    (tmp_path / "page=0" / "_SUCCESS").write_text("")
    rows = {r.work_id: (r.page, r.ordinal, json.loads(r.record).get("title")) for r in pages.read_works(spark, str(tmp_path)).collect()}
    assert rows == {"a": (0, 0, "Ta é"), "b": (0, 1, "Tb é"), "c": (2, 1, "Tc é"), "7": (2, 2, None)}
    empty = tmp_path / "none"
    empty.mkdir()
    assert pages.read_works(spark, str(empty)).collect() == []
    (tmp_path / "page=0" / "part-9.txt").write_text("[1]")
    with pytest.raises(Exception, match="is no page of works"):
        pages.read_works(spark, str(tmp_path)).collect()


def test_a_killed_stream_goes_on_and_gives_each_work_once(spark, tmp_path):
    root, checkpoint = tmp_path / "in", str(tmp_path / "cp")
    put(root, 0, works("a", "b"))
    put(root, 1, works("b", "c"))
    put(root, 3, works("z"))  # not before page 2 is there

    def run(folder):
        pages.collect_works(spark, str(root), "paged_works", folder).awaitTermination()
        spark.catalog.refreshTable("paged_works")  # the stream's session has written it
        return sorted((r.work_id, r.page) for r in spark.table("paged_works").collect())

    assert run(checkpoint) == [("a", 0), ("b", 0), ("c", 1)]
    (root / "page=2").mkdir()
    (root / "page=2" / "part-0.txt").write_text("{")
    with pytest.raises(Exception, match="is no page of works"):
        run(checkpoint)
    put(root, 2, works("c", "d"))
    want = [("a", 0), ("b", 0), ("c", 1), ("d", 2), ("z", 3)]
    assert run(checkpoint) == want
    assert run(checkpoint) == want
    assert run(str(tmp_path / "other")) == want  # a lost checkpoint reads all pages again and adds nothing
    spark.sql("drop table paged_works")
