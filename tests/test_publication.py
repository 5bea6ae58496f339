"""Generations from a stream of files: crashes between the steps, restarts, replaced files."""

from __future__ import annotations

import os
import time

import pytest

from folioscan.sources.storage import exists
from folioscan.streaming import publication


class Crash(Exception):
    pass


def crash_after(name, number):
    def step(done, batch):
        if (done, batch) == (name, number):
            raise Crash

    return step


def run(spark, folder, root, step=None):
    publication.follow(publication.text_files(spark, folder), root, *([step] if step else [])).awaitTermination()


def texts(spark, root):
    now = publication.current(spark, root)
    return {r["path"]: r["text"] for r in publication.documents_of(spark, root, now["generation"]).collect()}


def put(folder, files):
    for name, text in files.items():
        os.makedirs(os.path.dirname(f"{folder}/{name}"), exist_ok=True)
        with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
            f.write(text)


def test_batches_replace_and_add(spark, tmp_path):
    folder, root = str(tmp_path / "in"), str(tmp_path / "out")
    put(folder, {"a.txt": "one\n", "b/c d+.txt": "zwei é"})
    run(spark, folder, root)
    assert texts(spark, root) == {"a.txt": "one\n", "b/c d+.txt": "zwei é"}
    first = publication.current(spark, root)
    run(spark, folder, root)
    assert publication.current(spark, root) == first
    time.sleep(1.1)
    put(folder, {"new.txt": "three"})
    run(spark, folder, root)
    assert len(texts(spark, root)) == 3 and publication.current(spark, root)["batch"] > first["batch"]
    batch = spark.createDataFrame([("a.txt", "changed"), ("z.txt", "")], "path string, text string").selectExpr("*", "current_timestamp() AS at")
    publication.publish(batch, 99, root)
    assert texts(spark, root)["a.txt"] == "changed" and len(texts(spark, root)) == 4
    assert publication.publish(batch, 98, root) == publication.current(spark, root)["generation"]


@pytest.mark.parametrize("place", ["prepared", "written", "published"])
def test_a_crash_between_steps_changes_nothing(spark, tmp_path, place):
    folder, root, other = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "other")
    put(folder, {f"{i}.txt": f"text {i}" for i in range(5)})
    with pytest.raises(Exception, match="Crash"):
        run(spark, folder, root, crash_after(place, 0))
    assert exists(spark, f"{root}/prepared/000000000000.json") and (publication.current(spark, root) is None) == (place != "published")
    run(spark, folder, root)
    run(spark, folder, other)
    assert publication.current(spark, root)["generation"] == publication.current(spark, other)["generation"]
    assert texts(spark, root) == texts(spark, other) == {f"{i}.txt": f"text {i}" for i in range(5)}
    assert sum(name.startswith("g") for name in os.listdir(root)) == 1


def test_changed_content_isn_t_published(spark, tmp_path):
    root = str(tmp_path / "out")
    one, two = (spark.createDataFrame([("a", t)], "path string, text string").selectExpr("*", "current_timestamp() AS at") for t in ("x", "y"))
    with pytest.raises(Crash):
        publication.publish(one, 0, root, crash_after("prepared", 0))
    with pytest.raises(ValueError, match="another generation"):
        publication.publish(two, 0, root)
    publication.publish(one, 0, root)
    assert texts(spark, root) == {"a": "x"}
