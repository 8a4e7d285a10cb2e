"""Loading, resolving, searching and the history, on small catalogues."""

import json
import random

from pyspark.sql import functions as F

from scanweft.operators import history, resolve, search
from scanweft.sources import catalog

ITEMS = [(0, "aZero", "p/Zero", "first item", "a", 10.0, None, ["0000000000017"]), (1, "One", "p/One", None, "b", 0.0, 3, []), (2, "cTwo", "p/Two", "", "c", 99.5, 0, ["2"]), (3, "x", "100%_p", "", "?", None, None, None)]
CODES = [("0000000000017", 0, 2, None), ("0000000000024", 1, 1, None), ("0000000000031", None, None, [2, 0]), ("0000000000048", None, None, []), ("14710000000017", 1, None, None), ("4710000000024", 2, None, None)]


def tables(spark):
    return spark.createDataFrame(ITEMS, catalog.ITEMS), spark.createDataFrame(CODES, catalog.CODES)


def outcomes(spark, raws):
    items, codes = tables(spark)
    scans = spark.createDataFrame(list(enumerate(raws)), "seq int, raw string")
    return items, codes, resolve.with_outcome(resolve.looked_up(scans, codes))


def test_outcomes(spark):
    raws = ["17", "0-24", "31", "48", "99", None, "no", "14710000000017", "34710000000024", "04710000000024"]
    _, _, out = outcomes(spark, raws)
    got = [(r.status, r.ok, r.code, r.shown_code, r.p) for r in out.orderBy("seq").collect()]
    assert got == [
        ("hit", True, "0000000000017", "0000000000017", 0), ("hit", True, "0000000000024", "0000000000024", 1), ("multi", True, "0000000000031", "0000000000031", None), ("multi", True, "0000000000048", "0000000000048", None),
        ("miss", False, None, "99", None), ("miss", False, None, "", None), ("miss", False, None, "", None), ("hit", True, "14710000000017", "14710000000017", 1), ("hit", True, "4710000000024", "4710000000024", 2), ("hit", True, "4710000000024", "4710000000024", 2),
    ]


def test_cards_conflicts_misses(spark):
    items, codes, out = outcomes(spark, ["17", "24", "31", "48", "99"])
    cards = {r.seq: r for r in resolve.cards(resolve.hits(out, items)).collect()}
    assert set(cards) == {0, 1}
    assert (cards[0].title, cards[0].price_text, cards[0].case_price_text, cards[0].layer_label, cards[0].badge) == ("Zero", "$10.00", "$99.50", "件（最小單位）", None)
    assert (cards[1].price_text, cards[1].case_price_text, cards[1].description, cards[1].badge) == ("—", None, None, "熱銷 TOP 3")
    many = [(r.seq, r.choice, r.item_id, r.item.leaf) for r in resolve.conflicts(out, items).orderBy("seq", "choice").collect()]
    assert many == [(2, 0, 2, "cTwo"), (2, 1, 0, "aZero")]
    assert [(r.seq, r.shown_code, r.n_codes) for r in resolve.misses(out, codes).collect()] == [(4, "99", 6)]


def test_lookup_never_shuffles_scans_for_a_small_index(spark, tmp_path):
    items, codes = tables(spark)
    catalog.write(items, codes, f"file://{tmp_path}/tables")
    _, stored = catalog.read(spark, f"file://{tmp_path}/tables")
    out = resolve.looked_up(spark.range(9).select(F.col("id").cast("string").alias("raw")), stored)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_json_round_trip_and_problems(spark, tmp_path):
    db = {"items": [{"id": i, "leaf": leaf, "name": n, "desc": d, "layer": la, "price": p, "rank": r, "bc": bc} for i, leaf, n, d, la, p, r, bc in ITEMS], "barcodes": {c: {"m": m} if m is not None else {"p": p, "c": k} for c, p, k, m in CODES}}
    (tmp_path / "db.json").write_text(json.dumps(db, ensure_ascii=False, indent=1))
    items, codes = catalog.load_json(spark, f"file://{tmp_path}/db.json")
    assert sorted(map(str, codes.collect())) == sorted(map(str, spark.createDataFrame(CODES, catalog.CODES).collect()))
    assert [tuple(r)[1:] for r in items.orderBy("position").collect()] == ITEMS
    assert catalog.problems(items, codes).count() == 0
    catalog.write(items, codes, f"file://{tmp_path}/tables")
    stored, _ = catalog.read(spark, f"file://{tmp_path}/tables")
    plan = search.matches(stored, "zero item")._jdf.queryExecution().executedPlan().toString()
    assert "StringContains" in plan  # reaches the scan, on the stored lower-case column
    bad = items.withColumn("layer", items.layer.substr(2, 1)).where("item_id <> 2").union(items.where("item_id = 0"))
    kinds = {r.kind for r in catalog.problems(bad, codes.union(codes.limit(1))).collect()}
    assert kinds == {"item id repeats", "unknown layer", "code repeats", "code names no item"}


def plain_search(items, query, limit):
    terms = query.strip(" 　").lower().split()
    if not terms:
        return []
    found = [i for i in items if all(t in f"{i[2]} {i[3] or ''}".lower() for t in terms)]
    found.sort(key=lambda i: (i[6] or 999, i[4] != "a", len(i[2].encode("utf-16-be")), i[0]))
    return [i[0] for i in found[:limit]]


def test_search(spark, monkeypatch):
    rng = random.Random(2)
    words = ["red", "blue", "Bolt", "100%", "a_b", "珍珠", "widget", "😀"]
    items = [(k, "leaf", " ".join(rng.choice(words) for _ in range(rng.randint(1, 4))), rng.choice([None, "", "RED thing"]), rng.choice("abc?"), 1.0, rng.choice([None, None, 0, 5, 1200]), []) for k in range(300)]
    table = spark.createDataFrame(items, catalog.ITEMS).repartition(3)
    queries = ["red", "RED　bolt", "%", "_", "", "  ", "red red", "珍珠 red", "nothing", "t r", "😀", "e"]
    for q in queries:
        assert [r.item_id for r in search.top(table, q, 7).collect()] == plain_search(items, q, 7), q
        assert search.hit_count(table, q).first()[0] == len(plain_search(items, q, 999))
    many = spark.createDataFrame(list(enumerate(queries)), "query_id int, q string")
    for limit in (search.BROADCAST_TERMS, 0):
        monkeypatch.setattr(search, "BROADCAST_TERMS", limit)
        got = {}
        for r in search.rows(search.top_of_many(many, table, 7)).orderBy("query_id", "place").collect():
            got.setdefault(r.query_id, []).append((r.item_id, r.n_hits))
        for i, q in enumerate(queries):
            assert [x for x, _ in got.get(i, [])] == plain_search(items, q, 7), (q, limit)
            assert all(n == len(plain_search(items, q, 999)) for _, n in got.get(i, []))


def test_history(spark):
    items, _, _ = outcomes(spark, ["1"])
    rows = [(1, s, f"c{s}", ["hit", "multi", "miss", "hit"][s % 4], [0, None, None, 77][s % 4], 1000 * (s // 2)) for s in range(130)] + [(2, 0, 'q"\\', "miss", None, 5)]
    table = spark.createDataFrame(rows, catalog.HISTORY).repartition(3)
    newest = history.recent(table).orderBy("device_id", "place").collect()
    assert [(r.device_id, r.seq) for r in newest] == [(1, s) for s in range(129, 69, -1)] + [(2, 0)]
    labels = {r.seq: (r.label, r.price_text, r.at) for r in history.labelled(table.where("device_id = 1"), items).collect()}
    assert labels[0] == ("Zero", "$10.00", "1/1 00:00")  # item 0 is an item
    assert labels[1][:2] == ("⚠️ 一碼多品項", None) and labels[2][:2] == ("❓ 不在資料庫", None) and labels[3][:2] == ("❓ 不在資料庫", None)
    texts = {r.device_id: r.history for r in history.as_json(table).collect()}
    assert [e["i"] for e in json.loads(texts[1])][:4] == [None if s % 4 == 2 else "multi" if s % 4 == 1 else [0, 0, 0, 77][s % 4] for s in range(129, 125, -1)]
    assert json.loads(texts[2]) == [{"c": 'q"\\', "i": None, "t": 5}]
    back = history.from_json(history.as_json(table)).orderBy("device_id", "place").collect()
    assert [(r.device_id, r.code, r.status, r.item_id, r.t_ms) for r in back] == [(r.device_id, r.code, r.status, r.item_id, r.t_ms) for r in newest]
