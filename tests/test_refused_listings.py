"""Bodies that a client refuses whole: nothing is read or healed from them."""

import json

import pytest
from conftest import rows

from docsync.operators import reconcile
from docsync.schemas import SYNC_STATE
from docsync.sources.remote_json import rejected_bodies, valid_kb_catalog, valid_kb_files

FILES = [
    ("ok", '{"files":[{"id":"a","filename":"x.md"},{"id":"b"}]}', None),
    ("empty", '{"files":[]}', None),
    ("no list", '{"name":"kb"}', None),
    ("extra", '{"files":[{"id":"a","filename":"x","meta":{"n":[1,2]}}],"more":1}', None),
    ("cut", '{"files":[{"id":"a","filename":"x.md"}', "not_json"),
    ("text", "Internal error", "not_json"),
    ("bare", '[{"id":"a"}]', "not_json"),
    ("null", None, "not_json"),
    ("no id", '{"files":[{"id":"a"},{"filename":"x.md"}]}', "no_id"),
    ("null id", '{"files":[{"id":null,"filename":"x.md"}]}', "no_id"),
    ("number id", '{"files":[{"id":7,"filename":"x.md"}]}', "bad_entry"),
    ("null name", '{"files":[{"id":"a","filename":null}]}', "bad_entry"),
    ("number name", '{"files":[{"id":"a","filename":3}]}', "bad_entry"),
    ("no object", '{"files":["a"]}', "no_id"),
    ("null list", '{"files":null}', "bad_list"),
    ("object", '{"files":{"id":"a"}}', "bad_list"),
]
CATALOGUES = [
    ("wrapped", '{"items":[{"id":"a","name":"n"}]}', None),
    ("bare", '[{"id":"a","description":"d"},{"id":"b"}]', None),
    ("empty", "[]", None),
    ("no items", '{"page":1}', "bad_list"),
    ("bare no id", '[{"id":"a"},{"name":"n"}]', "no_id"),
    ("wrapped number", '{"items":[{"id":"a","name":1}]}', "bad_entry"),
    ("cut", '[{"id":"a"}', "not_json"),
]


@pytest.mark.parametrize("cases, entries", [(FILES, "files"), (CATALOGUES, "items")])
def test_reasons(spark, cases, entries):
    bodies = spark.createDataFrame([c[:2] for c in cases], "kb_id string, body string")
    got = {r["kb_id"]: r["reason"] for r in rejected_bodies(bodies, entries).collect()}
    assert got == {name: reason for name, _, reason in cases if reason}


def test_one_refused_body_refuses_its_listing(spark):
    page = lambda *ids: json.dumps({"files": [{"id": i, "filename": f"{i}.md"} for i in ids]})
    bodies = [("k1", 0, page("a", "b")), ("k1", 2, page("c")), ("k2", 0, page("d")), ("k2", 1, '{"files":[{}]}'), ("k3", 0, "{}")]
    got = valid_kb_files(spark.createDataFrame(bodies, "kb_id string, first_pos long, body string"))
    assert rows(got) == [("k1", i, x, f"{x}.md") for i, x in enumerate("abc")]


def test_refused_catalogues_give_no_entry(spark):
    bodies = spark.createDataFrame([c[1:2] for c in CATALOGUES], "body string")
    assert rows(valid_kb_catalog(bodies)) == [("a", "", "d"), ("a", "n", ""), ("b", "", "")]


def test_refused_listing_heals_nothing(spark):
    """An entry without an id among good ones: before, the good ones still healed."""
    inventory = spark.createDataFrame(
        [(kb, f"{kb}_x.md", f"/rag/{kb}/x.md", "x.md", "x.md", "file", "hash") for kb in ("good", "bad")],
        "kb_id string, file_key string, path string, rel_path string, filename string, kind string, content_hash string",
    )
    body = '{"files":[{"id":"r1","filename":"x.md"}%s]}'
    bodies = spark.createDataFrame([("good", body % ""), ("bad", body % ',{"filename":"y.md"}')], "kb_id string, body string")
    state = spark.createDataFrame([], SYNC_STATE)
    healed, log = reconcile.reconcile(inventory, state, valid_kb_files(bodies))
    assert [r["kb_id"] for r in healed.collect()] == ["good"] == [r["kb_id"] for r in log.collect()]
