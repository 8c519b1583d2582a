"""An index after upserts next to one built anew."""

import random

import pytest
from pyspark.sql import functions as F

from stallwise.operators import retrieval as R
from stallwise.operators.upserts import ProductIndex

SCHEMA = "id string, text string, price string"


def products(rng, ids):
    words = "cable fast charger usb red blue steel lamp kettle phone case 65w".split()
    return {i: (i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 12))) or None, f"₹{rng.randrange(99)}")
            for i in ids}


def frame(spark, rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def vectors(table):
    return {r["id"]: (r["text"], r["price"], [round(x, 5) for x in r["embedding"]]) for r in table.collect()}


def test_upserts_equal_a_new_index(spark, tmp_path):
    rng, now = random.Random(2), {}
    schema = spark.createDataFrame([], SCHEMA).schema
    index = ProductIndex(spark, str(tmp_path / "i"), schema, buckets=4)
    assert index.rows().count() == 0
    for step in range(5):
        given = products(rng, [f"p{rng.randrange(40)}" for _ in range(15)])
        same = {i: now[i] for i in rng.sample(sorted(now), min(5, len(now))) if i not in given}
        gone = [i for i in rng.sample(sorted(now), min(4, len(now))) if i not in given and i not in same]
        removed = spark.createDataFrame([(i,) for i in [*gone, "nobody", None]], "id string")
        figures = index.upsert(frame(spark, [*given.values(), *same.values(), (None, "no id", "1")]), removed, merge_every=3).first()
        new = [i for i in given if i not in now]
        changed = [i for i in given if i in now and now[i] != given[i]]
        assert (figures["new"], figures["changed"], figures["removed"], figures["unknown"]) == (len(new), len(changed), len(gone), 1)
        assert figures["encoded"] == len(new) + len(changed)  # nothing else is split into words again
        assert figures["same"] == len(given) + len(same) - len(new) - len(changed)
        now.update(given)
        for i in gone:
            del now[i]
        whole = frame(spark, now.values())
        anew = R.encode(whole, R.fit_encoder(whole))
        assert vectors(index.vectors()) == vectors(anew)
    again = ProductIndex(spark, str(tmp_path / "i"))
    assert vectors(again.vectors()) == vectors(index.vectors())
    fresh = ProductIndex(spark, str(tmp_path / "fresh"), schema)
    fresh.upsert(whole)
    assert fresh.state()[1:] == index.state()[1:]
    assert sorted(map(str, fresh.vectors().collect())) == sorted(map(str, index.vectors().collect()))


def test_an_upsert_that_stops_has_not_happened(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    index = ProductIndex(spark, str(tmp_path / "i"), spark.createDataFrame([], SCHEMA).schema, buckets=2)
    first = products(rng, [f"p{i}" for i in range(10)])
    index.upsert(frame(spark, first.values()))
    before = vectors(index.vectors())
    more = products(rng, [f"p{i}" for i in range(5, 15)])
    with monkeypatch.context() as patch:
        patch.setattr(ProductIndex, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError):
            index.upsert(frame(spark, more.values()))
    assert vectors(index.vectors()) == before
    other = products(rng, ["p3", "p99"])
    index.upsert(frame(spark, other.values()))
    whole = frame(spark, {**first, **other}.values())
    assert vectors(index.vectors()) == vectors(R.encode(whole, R.fit_encoder(whole)))


def test_repeated_ids_and_one_batch(spark, tmp_path):
    index = ProductIndex(spark, str(tmp_path / "i"), spark.createDataFrame([], SCHEMA).schema)
    rows = [("a", "x y", "1"), ("a", "x y", "1"), ("b", None, None), ("b", "z", None)]
    figures = index.upsert(frame(spark, rows), spark.createDataFrame([("a",)], "id string")).first()
    assert (figures["given"], figures["new"], figures["removed"]) == (2, 2, 0)
    once = sorted((r["id"], r["text"]) for r in index.rows().collect())
    index.upsert(frame(spark, reversed(rows)))
    assert sorted((r["id"], r["text"]) for r in index.rows().collect()) == once
    nothing = index.upsert(frame(spark, rows[:1]).limit(0)).first()
    assert nothing["given"] == 0 and index.rows().count() == 2
    assert index.vectors().where(F.size("embedding") != R.DIMENSION).count() == 0
