import gzip
import json
import random
import tracemalloc

import pytest

from wardspan.sources import readers
from wardspan.sources.envelopes import Walker, json_records


def walked(text, rng=None, name="Records"):
    """What a walker gives for a text in pieces cut anywhere."""
    walker, out, at = Walker(name), [], 0
    while at < len(text):
        step = rng.randrange(1, 9) if rng else len(text)
        out += walker.feed(text[at : at + step])
        at += step
    return out


def value(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind < 2:
        return rng.choice(["", "a", 'q"q', "back\\slash", "{[", "]}", "é", '\\"', "Records", "\n"])
    if kind < 4:
        return rng.choice([1, -2.5, None, True])
    if kind == 4:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["a", "Records", "b}", 'c"']): value(rng, depth + 1) for _ in range(rng.randrange(4))}


def plain(doc):
    if isinstance(doc, dict):
        inner = doc.get("Records")
        return [x for x in inner if isinstance(x, dict)] if isinstance(inner, list) else [doc]
    return [x for x in doc if isinstance(x, dict)] if isinstance(doc, list) else []


def test_same_as_reading_the_whole_document():
    rng = random.Random(1)
    for _ in range(4000):
        records = [value(rng) for _ in range(rng.randrange(5))]
        doc = rng.choice([{"v": value(rng), "Records": records, "w": value(rng)}, records, {"Records": value(rng)}, {"x": records}])
        text = json.dumps(doc, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2]))
        assert [json.loads(r) for r in walked(text, rng)] == plain(doc) == [json.loads(r) for r in walked(text)], text
    assert walked('{"Events": [{"a": 1}]}', name="Events") == ['{"a": 1}'] and walked('{"a": 1}\n[{"b": 2}, 3]') == ['{"a": 1}', '{"b": 2}']


def test_broken_tails_keep_the_records_before(spark, tmp_path):
    good = '{"Records": [{"n": 1}, {"n": {"m": "}"}}, '
    for i, tail in enumerate(["", '{"n": 3', '{"n": "x}', '{"n":', "]", '{"n": "\\']):
        (tmp_path / f"{i}.json").write_text(good + tail)
        got = json_records(spark, str(tmp_path / f"{i}.json")).collect()
        assert sorted(r["raw"] for r in got) == ['{"n":1}', '{"n":{"m":"}"}}'], tail
    (tmp_path / "none.json").write_text("")
    (tmp_path / "odd.json").write_text("not a document")
    assert json_records(spark, [str(tmp_path / "none.json"), str(tmp_path / "odd.json")]).count() == 0


def test_a_large_document_in_many_splits(spark, tmp_path):
    """50 MB: Spark splits it, the walker holds a record."""
    n = 200_000
    with open(tmp_path / "big.json", "w") as f:
        f.write('{"head": [{"not": "a record"}], "Records": [')
        f.writelines(("," if i else "") + '{"eventName": "E%d", "deep": {"list": [1, {"x": "}]{["}], "text": "%s"}}' % (i, "z" * 190) for i in range(n))
        f.write("]}")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    spark.conf.set("spark.sql.files.openCostInBytes", "1m")
    try:
        assert spark.read.option("lineSep", "}").text(str(tmp_path / "big.json")).rdd.getNumPartitions() > 8
        found = readers.any_events(spark, str(tmp_path / "big.json")).selectExpr("get_json_object(raw, '$.eventName') AS e", "length(get_json_object(raw, '$.deep.text')) AS l")
        row = found.selectExpr("count(*) AS n", "count(DISTINCT e) AS d", "min(l) AS l").first()
        assert tuple(row) == (n, n, 190)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    with gzip.open(tmp_path / "big.json.gz", "wt") as f:
        f.write('{"Records": [' + ",".join('{"n": %d}' % i for i in range(3000)) + "]}")
    assert readers.any_events(spark, str(tmp_path / "big.json.gz")).count() == 3000


def test_a_walker_holds_one_record():
    piece = ",".join('{"n": %d, "text": "%s"}' % (i, "y" * 400) for i in range(200))
    walker, n = Walker(), 0
    tracemalloc.start()
    for text in ['{"Records": [', *[piece + ","] * 300, piece, "]}"]:
        n += sum(1 for _ in walker.feed(text))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 301 * 200 and peak < 2_000_000


@pytest.mark.parametrize("whole", [True, False])
def test_lines_and_documents(spark, tmp_path, whole):
    (tmp_path / "a.json").write_text('{"Records": [{"a": 1}]}\n{"b": 2}\n')
    assert sorted(r["raw"] for r in readers.json_events(spark, str(tmp_path / "a.json"), whole).collect()) == ['{"a":1}', '{"b":2}']
