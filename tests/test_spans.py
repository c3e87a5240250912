"""Records over many splits against a plain parser."""

import csv
import io
import json
import random

import pytest

from tablewright.sources import readers, spans


@pytest.fixture()
def tiny_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}

    def cut(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "0")
        spark.conf.set(names[2], "1")

    yield cut
    for n, v in before.items():
        spark.conf.set(n, v) if v is not None else spark.conf.unset(n)


def put(folder, name, text):
    with open(f"{folder}/{name}", "w", encoding="utf-8", newline="") as f:
        f.write(text)
    return f"{folder}/{name}"


CELLS = ["", "a", 'say "hi"', "two\nlines", "x;y", "\n", '"', '""', "é\n\n;", "plain text", '5" pipe', "a\r\nb"]


def rows_of(rng, n):
    return [[rng.choice(CELLS) for _ in range(3)] for _ in range(n)]


@pytest.mark.parametrize("size,end", [(120, "\n"), (250, "\r\n"), (100_000, "\n")])
def test_quoted_line_breaks(spark, folder, tiny_splits, size, end):
    rng = random.Random(size)
    rows = [["id", "b", "c"], *([str(i), *r[1:]] for i, r in enumerate(rows_of(rng, 24)))]
    buffer = io.StringIO()
    csv.writer(buffer, delimiter=";", lineterminator=end).writerows(rows)
    path = put(folder, "q.csv", buffer.getvalue())
    tiny_splits(size)
    got = readers.read_delimited(spark, path, sep=";", multi_line=True)
    assert got.columns == rows[0]
    plain = lambda df: sorted(([c or "" for c in r] for r in df.collect()), key=lambda r: int(r[0]))  # noqa: E731  an empty cell is NULL
    assert plain(got) == rows[1:]
    part = readers.read_delimited(spark, path, sep=";", title_row=3, first_row=5, last_row=20, header=False)
    assert plain(part) == rows[4:20]


def test_a_quote_within_a_field_is_text(spark, folder, tiny_splits):
    path = put(folder, "w.csv", 'a,b\n1,5" pipe\n2,x"y"z\n3,"in\nside"\n4,"open\n5,never closed')
    tiny_splits(9)
    got = readers.read_delimited(spark, path, multi_line=True).collect()
    assert sorted(map(tuple, got))[:3] == [("1", '5" pipe'), ("2", 'x"y"z'), ("3", "in\nside")] and len(got) == 4


def test_files_are_numbered_one_after_another(spark, folder, tiny_splits):
    for k in range(3):
        put(folder, f"part-{k}.csv", "".join(f'{k}{i},"x\ny"\n' for i in range(9)))
    tiny_splits(30)
    got = readers.read_delimited(spark, folder, header=False, first_row=8, last_row=20).collect()
    assert sorted(r[0] for r in got) == [*(f"0{i}" for i in (7, 8)), *(f"1{i}" for i in range(9)), *(f"2{i}" for i in (0, 1))]


def nested(rng, depth=0):
    kind = rng.randrange(6 if depth < 3 else 3)
    if kind == 0:
        return rng.choice(["a,b", '"', "\\", "]}", "é[{", 'x\\"y', "", ",", '\\",'])
    if kind == 1:
        return rng.choice([None, True, 3, -1.5])
    if kind == 2:
        return "t" * rng.randrange(40)
    if kind == 3:
        return [nested(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice("abc,]{") + str(i): nested(rng, depth + 1) for i in range(rng.randrange(4))}


@pytest.mark.parametrize("size,indent", [(250, None), (500, 2), (100_000, None)])
def test_one_json_array_over_many_splits(spark, folder, tiny_splits, size, indent):
    rng = random.Random(size)
    docs = [{"id": i, "v": nested(rng)} for i in range(16)]
    path = put(folder, "a.json", "﻿ \n" * bool(indent) + json.dumps(docs, indent=indent) + "\n")
    tiny_splits(size)
    items = readers.json_items(spark, path).collect()
    assert sorted((json.loads(r["item"]) for r in items), key=lambda d: d["id"]) == docs
    assert {r["kind"] for r in items} == {"object"}
    df = readers.read_json_rows(spark, path)
    assert df.columns == ["id", "v"] and {r["id"] for r in df.collect()} == {str(i) for i in range(16)}


def test_other_json_documents(spark, folder, tiny_splits):
    tiny_splits(8)
    items = lambda text: [json.loads(r["item"]) for r in readers.json_items(spark, put(folder, "d.json", text)).collect()]
    assert items('{"a": [1, 2, {"b": ",]"}], "c": "x"}') == [{"a": [1, 2, {"b": ",]"}], "c": "x"}]
    assert items("[]") == [] and items("") == [] and items(" [ ] ") == []
    assert items("[[1, 2]]") == [[1, 2]] and items('["a,b"]') == ["a,b"]


def test_both_starts_of_a_split():
    scan = spans.quoted_fields(",")
    assert scan(['a,"b', 'c",d', "e"], False)[0].tolist() == [True, False, False]
    assert scan(['c",d', '"x'], True)[0].tolist() == [False, True]
    ends, opened = spans.json_pieces(['{"a": "x', 'y"}'], False)
    assert ends.tolist() == [True, False] and opened.tolist() == [1, 0]
