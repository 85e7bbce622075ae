"""Files under given names, all or none."""

import os

import pytest

from cuelake.sources import named, readers, sinks


def tree(path):
    return {os.path.relpath(os.path.join(d, f), path): open(os.path.join(d, f), encoding="utf-8").read() for d, _, names in os.walk(path) for f in names}


def test_files_are_replaced_as_a_whole(spark, tmp_path):
    target = f"{tmp_path}/out"
    rows = [(f"s{k % 3}/en_{k}.vtt", f"körper {k}\n" * k) for k in range(40)]
    named.write_named(spark.createDataFrame([*rows, ("top.m3u8", None)], "file string, body string").repartition(5), f"file://{target}")
    assert tree(target) == dict(rows) | {"top.m3u8": ""}
    assert os.listdir(tmp_path) == ["out"]
    with pytest.raises(Exception, match="Exists"):
        named.write_named(spark.createDataFrame(rows[:1], "file string, body string"), f"file://{target}", "append")
    named.write_named(spark.createDataFrame(rows[:2], "file string, body string"), f"file://{target}")
    assert tree(target) == dict(rows[:2]) and os.listdir(tmp_path) == ["out"]
    named.write_named(spark.createDataFrame([], "file string, body string"), f"file://{target}")
    assert tree(target) == {}


@pytest.mark.parametrize("bad", ["../x", "/x", "a//b", "", None, "a/./b", "dup"])
def test_a_failing_task_leaves_the_old_files(spark, tmp_path, bad):
    target = f"{tmp_path}/out"
    named.write_named(spark.createDataFrame([("old", "1")], "file string, body string"), f"file://{target}")
    rows = [("a", "x"), ("dup", "y"), (bad, "z")]
    with pytest.raises(Exception, match="file name"):
        named.write_named(spark.createDataFrame(rows, "file string, body string"), f"file://{target}")
    assert tree(target) == {"old": "1"} and os.listdir(tmp_path) == ["out"]


def test_stream_names_are_safe(spark, tmp_path):
    bodies = spark.createDataFrame([("a/b ü", "en", 3, "x")], "stream_id string, lang string, seq long, body string")
    named.write_vtt_segments(bodies, f"file://{tmp_path}/out")
    assert tree(f"{tmp_path}/out") == {"a%2Fb+%C3%BC/en_3.vtt": "x"}


def test_files_opened_by_name(spark, tmp_path):
    path = f"file://{tmp_path}/by-name"
    named.write_named(spark.createDataFrame([("1/a.vtt", "x\ny"), ("2/b c.vtt", "")], "file string, body string"), path)
    asked = spark.createDataFrame([(1, "1/a.vtt"), (2, "2/b c.vtt"), (3, "3/none.vtt"), (4, None), (5, "1/a.vtt")], "id long, file string")
    assert {r.id: r.value for r in named.read_named(asked, path).collect()} == {1: "x\ny", 2: "", 3: None, 4: None, 5: "x\ny"}


def test_published_files_are_not_listed(spark):
    """Listed files are planned at some 30 files a task, so tasks grow with the files."""
    from cuelake.plans import captions

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    plan = captions.published_subtitles(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Relation [value" not in plan and "MapInArrow" in plan


def test_word_files_are_opened_by_name(spark, tmp_path):
    """Word logs are a file for each stream and hour, found without partition folders; each call adds files."""
    rows = [("a b", "x", 1.5, 1.75, 2.0), ("a b", "y", 0.5, 0.75, 1.0), ("a b", "z", 3600.0, 3600.5, None), ("_c", "", 1.0, 1.25, 2.0), (None, "n", 0.0, 0.25, 0.5)]
    df = spark.createDataFrame(rows, "stream_id string, text string, t0_s double, t1_s double, emit_s double")
    path = f"file://{tmp_path}/words"
    files = sinks.write_words(df, path)
    assert sorted(r.file.split("/", 1)[1] for r in files.collect()) == ["0/%.tsv", "0/%5Fc.tsv", "0/a+b.tsv", "1/a+b.tsv"]
    expected = sorted(((s, t, int(a * 1000), int(z * 1000), e) for s, t, a, z, e in rows), key=str)
    assert sorted(map(tuple, readers.read_word_files(files, path, "engine").collect()), key=str) == expected
    sinks.write_words(df, path)
    assert readers.read_words(spark, path, "engine").count() == 2 * len(rows)
    assert not list(tmp_path.glob("**/stream_id=*"))
