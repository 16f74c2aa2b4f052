"""JSON arrays in one file against the json module."""

import json
import random

import pytest

from vouch.sources.json_array import json_texts, read_json_array


def records(n):
    rng = random.Random(4)
    odd = ["}", "{", '"', "\\", '\\"', "},{", "]", "é", "سلام", "\n", '{"a": 1}', ""]
    return [{"id": i, "name": "".join(rng.choice(odd) for _ in range(rng.randint(0, 8))),
             "in": {"k": rng.choice(odd), "deep": [{"x": i}, {}]}, "o": {}} for i in range(n)]


@pytest.fixture
def small_blocks(spark):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    old = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "2000")
    spark.conf.set(names[1], "0")
    yield
    for n, v in zip(names, old):
        spark.conf.set(n, v)


@pytest.mark.parametrize("level,form", [(0, "dense"), (0, "lines"), (0, "bom"), (2, "dense")])
def test_rows_equal_the_small_reader(spark, tmp_path, small_blocks, level, form):
    rows = records(300)
    body = json.dumps(rows, ensure_ascii=form == "lines", indent=1 if form == "lines" else None,
                      separators=None if form == "lines" else (",", ":"))
    if level:
        body = '{"head":{"vars":["a}","{\\""]},"results":{"n":1,"bindings":' + body + ',"z":{}}}'
    if form == "bom":
        body = "﻿" + body + "\n"
    (tmp_path / "one.json").write_text(body, encoding="utf-8")
    texts = [json.loads(r.json) for r in json_texts(spark, str(tmp_path), level).collect()]
    if level:
        texts.remove({})  # the other member at that depth
    assert sorted(texts, key=lambda r: r["id"]) == rows
    assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 5


def test_several_files_empty_arrays_and_broken_ends(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 1}, {"id": 2}]')
    (tmp_path / "b.json").write_text("[]")
    (tmp_path / "c.json").write_text('[{"id": 3}, {"id": 4, "o": {"x": 1}')
    (tmp_path / "d.json").write_text("")
    got = read_json_array(spark, str(tmp_path), "id long").collect()
    assert sorted(r.id for r in got) == [1, 2, 3]
