"""The operators over the driver's tables: a synthetic catalogue from part, scans from events.

Every query has a twin in DuckDB SQL that is written from the rules and not from the Spark code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanweft.functions import codes as code_functions
from scanweft.functions import texts
from scanweft.operators import gate, history, resolve, search
from scanweft.sources import catalog
from scanweft.sources.folder import shared_path
from scanweft.streaming import gate as stream_gate

#: Searches of the many-query form: doubled terms, wide spaces, literal % and _, capitals, nothing, no match.
SEARCHES = ["red", "widget brand#1", "hot　gear", "Blue BOLT bolt", "%", "_", "   ", "", "small ring standard", "no such thing", "#1 e", "brand#2/"]
ONE_SEARCH = "red  Brand#1"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    at = F.pmod(k, F.lit(4)).cast("int")
    name = F.concat("p_brand", F.lit("/"), "p_name", F.lit("#"), k.cast("string"))
    return _read(spark, sf_dir, "part").select(
        k.cast("int").alias("item_id"),
        F.concat(F.element_at(F.array(*map(F.lit, ["a", "b", "c", ""])), at + 1), F.initcap("p_name")).alias("leaf"),
        name.alias("name"),
        F.when(k % 5 == 0, "").otherwise(F.col("p_type")).alias("desc"),
        F.element_at(F.array(*map(F.lit, catalog.LAYERS)), at + 1).alias("layer"),
        F.when(k % 11 == 0, 0.0).otherwise(F.col("p_retailprice")).alias("price"),
        F.when(k % 17 == 3, F.floor(k / 17) + 1).cast("int").alias("rank"),
        F.when(k % 13 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lpad(k.cast("string"), 13, "0"))).alias("bc"),
    )


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey").cast("int")
    many = k % 19 == 0
    last = F.lit(None).cast("int")
    return _read(spark, sf_dir, "part").where(k % 13 != 0).select(
        F.lpad(k.cast("string"), 13, "0").alias("code"),
        F.when(~many, k).alias("p"),
        F.when(~many & (k % 4 == 0), k + 2).otherwise(last).alias("c"),
        F.when(many, F.array(k, k + 1)).alias("m"),
    )


def raw_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, form, raw): every part in seven forms of writing."""
    k = F.col("p_partkey")
    padded = lambda n: F.lpad(k.cast("string"), n, "0")
    forms = [padded(13), padded(12), F.concat(F.lit("0"), padded(13)), F.concat(F.lit("9"), padded(13)), F.concat(F.lit(" "), k.cast("string"), F.lit("-")), F.lit("no digits"), F.concat(F.lit("777"), padded(13))]
    return _read(spark, sf_dir, "part").select(k.alias("k"), F.posexplode(F.array(*forms)).alias("form", "raw"))


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return _read(spark, sf_dir, "events").select(
        F.col("user_id").alias("device_id"),
        F.col("event_id").alias("seq"),
        (n * 700 + (F.col("event_id") * 37) % 600).cast("long").alias("t_ms"),
        F.col("event_type").alias("code"),
        (~F.col("event_type").isin("error", "signup")).alias("known"),
    )


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of all events: the code is that of a part, as the event's number gives it."""
    n = _read(spark, sf_dir, "part").count()
    e = _read(spark, sf_dir, "events")
    raw = F.when(F.col("event_id") % 7 == 0, F.lit("777")).otherwise((F.col("event_id") % n).cast("string"))
    read = e.select(F.col("user_id").alias("device_id"), F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("t_ms"), raw.alias("raw"))
    return history.entries(resolve.with_outcome(resolve.looked_up(read, codes(spark, sf_dir))))


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.looked_up(raw_codes(spark, sf_dir), codes(spark, sf_dir))


def code_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = raw_codes(spark, sf_dir).withColumn("digits", code_functions.digits(F.col("raw")))
    return found.select("k", "form", "digits", F.array_join(code_functions.candidates(F.col("raw")), "|").alias("candidates"))


def barcode_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which item does each raw code mean?"""
    outcome = resolve.with_outcome(_found(spark, sf_dir))
    it = items(spark, sf_dir).select(F.col("item_id").alias("p"), F.col("name").alias("item_name"))
    return outcome.join(it, "p", "left").select("k", "form", "code", "status", "ok", F.col("p").alias("item_id"), "item_name")


def lookup_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.with_outcome(_found(spark, sf_dir)).groupBy("form", "status", "ok").agg(F.count("*").alias("n"))


def miss_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.misses(_found(spark, sf_dir), codes(spark, sf_dir)).select("k", "form", "shown_code", "n_codes")


def conflict_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve.conflicts(_found(spark, sf_dir), items(spark, sf_dir))
    return out.select("k", "form", "code", "choice", "item_id", texts.clean_leaf(F.col("item.leaf")).alias("title"), F.col("item.name").alias("path"))


def case_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve.cards(resolve.hits(_found(spark, sf_dir), items(spark, sf_dir)))
    return out.select("k", "form", "code", F.col("p").alias("item_id"), "price_text", "case_price_text")


def item_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve.cards(resolve.hits(_found(spark, sf_dir), items(spark, sf_dir)))
    return out.select("k", "form", "code", "title", "path", "layer_label", "badge", "price_label", "price_text", "case_price_label", "case_price_text", "description")


def manual_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes typed by hand, with their outcome and what goes into the history."""
    out = resolve.entered(raw_codes(spark, sf_dir), codes(spark, sf_dir))
    return out.select("k", "form", F.col("raw").alias("typed"), "status", "ok", "shown_code", F.when(F.col("status") == "hit", F.col("p")).alias("item_id"))


def clean_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("item_id", "leaf", texts.clean_leaf(F.col("leaf")).alias("title"))


def price_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    eighths = F.col("p_size") / F.lit(8.0) + F.col("p_partkey")
    part = _read(spark, sf_dir, "part")
    return part.select("p_partkey", texts.price_text(F.col("p_retailprice")).alias("retail"), texts.price_text(F.when(F.col("p_partkey") % 9 == 0, -eighths).otherwise(eighths)).alias("eighths"))


def layer_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    layer = F.when(F.col("item_id") % 23 == 0, "z").otherwise(F.col("layer"))
    it = items(spark, sf_dir)
    return it.select("item_id", texts.layer_label(layer).alias("on_card"), texts.layer_label_in_list(layer).alias("in_list"), texts.price_label(layer).alias("price_label"), texts.badge(F.col("rank")).alias("badge"), texts.first_barcode(F.col("bc")).alias("barcode"), texts.rank_or_last(F.col("rank")).alias("rank0"), texts.utf16_length(F.col("name")).alias("name_length"))


def searches(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(SEARCHES)), "query_id int, q string")


def search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.top(items(spark, sf_dir), ONE_SEARCH)
    return search.rows(found).select("item_id", "title", "price_text", "layer_label", "badge", "barcode")


def search_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rows(search.top_of_many(searches(spark), items(spark, sf_dir))).select("query_id", "place", "n_hits", "item_id", "title", "price_text", "layer_label", "badge", "barcode")


def search_hit_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hit_count(items(spark, sf_dir), ONE_SEARCH)


def scan_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.accepted(scans(spark, sf_dir))


def scan_gate_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate as a stream: all scans that there are, taken in one go, with the state of each device kept."""
    source, out, state = (shared_path(spark, f"gate-{x}") for x in ("in", "out", "state"))
    scans(spark, sf_dir).write.parquet(source)
    reads = spark.readStream.schema(catalog.SCANS).parquet(source)
    query = stream_gate.accepted(reads).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream_gate.ACCEPTED).parquet(out).drop("late")


def history_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.recent(_history(spark, sf_dir)).select("device_id", "place", "seq", "code", "status", "item_id", "t_ms")


def history_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.labelled(_history(spark, sf_dir), items(spark, sf_dir)).select("device_id", "seq", "code", "label", "price_text", "at")


def history_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.as_json(_history(spark, sf_dir))


def history_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.from_json(history.as_json(_history(spark, sf_dir)))


def code_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes(spark, sf_dir).agg(F.count("*").alias("n_codes"))


def catalog_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue with faults put in: an unknown layer, a wrong position, a code without an item."""
    it = items(spark, sf_dir).withColumn("position", F.when(F.col("item_id") % 101 == 7, F.col("item_id") + 1).otherwise(F.col("item_id")))
    it = it.withColumn("layer", F.when(F.col("item_id") % 103 == 5, "x").otherwise(F.col("layer"))).where("item_id % 107 <> 11")
    return catalog.problems(it, codes(spark, sf_dir)).select("kind", "ref")


def history_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bounded history as a stream of three micro-batches, each of which writes a whole new version."""
    source, out, state = (shared_path(spark, f"history-{x}") for x in ("in", "out", "state"))
    _history(spark, sf_dir).repartition(3, F.col("seq")).write.option("maxRecordsPerFile", 0).parquet(source)
    entries = spark.readStream.schema(catalog.HISTORY).option("maxFilesPerTrigger", 1).parquet(source)
    stream_gate.keep_history(entries, out, state).trigger(availableNow=True).start().awaitTermination()
    return stream_gate.latest_history(spark, out).select("device_id", "place", "seq", "code", "status", "item_id", "t_ms")


def catalog_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue as JSON texts in Base64, of a hundred items each with all their codes, parsed again."""
    it = items(spark, sf_dir).withColumnRenamed("item_id", "id").select(F.struct("id", "leaf", "name", "desc", "layer", "price", "rank", "bc").alias("it"))
    own = it.join(codes(spark, sf_dir), F.col("code") == F.lpad(F.col("it.id").cast("string"), 13, "0"), "left").withColumn("db", F.floor(F.col("it.id") / 100))
    entry = F.when(F.col("code").isNotNull(), F.struct("code", F.struct("p", "c", "m")))
    one = own.groupBy("db").agg(F.array_sort(F.collect_list("it")).alias("items"), F.map_from_entries(F.collect_list(entry)).alias("barcodes"))  # a hundred items
    text = F.to_json(F.struct("items", "barcodes"))
    parsed = one.select(F.decode(catalog.from_base64(F.base64(F.encode(text, "UTF-8"))), "UTF-8").alias("json")).select(catalog.parse(F.col("json")).alias("db")).select("db.*")
    loaded, index = catalog.unpacked(parsed)
    return loaded.join(index.select(F.coalesce("p", F.get("m", F.lit(0))).alias("item_id"), "code"), "item_id", "left").select("item_id", "position", "leaf", "name", "desc", "layer", "price", "rank", F.get("bc", F.lit(0)).alias("bc0"), "code")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (code_candidates, barcode_lookup, lookup_outcome, miss_report, conflict_expand, case_price, item_card, manual_entry, clean_leaf, price_format, layer_labels, search_topk, search_many, search_hit_count, scan_gate, scan_gate_stream, history_recent, history_labels, history_json, history_from_json, history_stream, code_count, catalog_problems, catalog_load)
}

_ITEMS = """items AS (
  SELECT CAST(p_partkey AS INT) AS item_id,
    CASE p_partkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' ELSE '' END
      || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS leaf,
    p_brand || '/' || p_name || '#' || p_partkey AS name,
    CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_type END AS "desc",
    CASE p_partkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' ELSE '?' END AS layer,
    CASE WHEN p_partkey % 11 = 0 THEN 0.0 ELSE p_retailprice END AS price,
    CASE WHEN p_partkey % 17 = 3 THEN CAST(p_partkey // 17 + 1 AS INT) END AS rank,
    CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE lpad(CAST(p_partkey AS VARCHAR), 13, '0') END AS bc0
  FROM part)"""
_CODES = """codes AS (
  SELECT lpad(CAST(p_partkey AS VARCHAR), 13, '0') AS code,
    CASE WHEN p_partkey % 19 <> 0 THEN CAST(p_partkey AS INT) END AS p,
    CASE WHEN p_partkey % 19 <> 0 AND p_partkey % 4 = 0 THEN CAST(p_partkey + 2 AS INT) END AS c,
    CASE WHEN p_partkey % 19 = 0 THEN [CAST(p_partkey AS INT), CAST(p_partkey + 1 AS INT)] END AS m
  FROM part WHERE p_partkey % 13 <> 0)"""
_RAW = """raws AS (
  SELECT p_partkey AS k, form, CASE form
      WHEN 0 THEN lpad(CAST(p_partkey AS VARCHAR), 13, '0') WHEN 1 THEN lpad(CAST(p_partkey AS VARCHAR), 12, '0')
      WHEN 2 THEN '0' || lpad(CAST(p_partkey AS VARCHAR), 13, '0') WHEN 3 THEN '9' || lpad(CAST(p_partkey AS VARCHAR), 13, '0')
      WHEN 4 THEN ' ' || p_partkey || '-' WHEN 5 THEN 'no digits' ELSE '777' || lpad(CAST(p_partkey AS VARCHAR), 13, '0') END AS raw
  FROM part, (SELECT CAST(unnest(range(7)) AS INT) AS form)),
digits AS (SELECT *, regexp_replace(raw, '[^0-9]', '', 'g') AS d FROM raws),
tries AS (
  SELECT *, CASE WHEN d = '' THEN [] WHEN length(d) < 14 THEN [repeat('0', 13 - length(d)) || d]
      WHEN length(d) > 14 THEN [d] WHEN d[1] = '0' THEN [d[2:], d] ELSE [d, d[2:]] END AS cs
  FROM digits)"""
_FOUND = f"""{_CODES}, {_RAW},
hitlist AS (
  SELECT t.k, t.form, c.*, row_number() OVER (PARTITION BY t.k, t.form ORDER BY list_position(t.cs, c.code)) AS place
  FROM tries t JOIN codes c ON list_contains(t.cs, c.code)),
found AS (
  SELECT t.k, t.form, t.d, h.code, h.p, h.c, h.m,
    CASE WHEN h.code IS NULL THEN 'miss' WHEN h.m IS NOT NULL THEN 'multi' ELSE 'hit' END AS status
  FROM tries t LEFT JOIN hitlist h ON h.k = t.k AND h.form = t.form AND h.place = 1)"""


def _price(x: str) -> str:
    """Ties, odd multiples of an eighth, are moved up; printf rounds all other exact values."""
    return f"CASE WHEN {x} IS NULL OR isnan({x}) OR {x} <= 0 THEN '—' WHEN ({x} * 8) % 2 = 1 THEN '$' || printf('%.2f', {x} + 0.001) ELSE '$' || printf('%.2f', {x}) END"


_LEAF = "regexp_replace({}, '^[abcpABCP]([A-Z0-9一-鿿（(])', '\\1')"
_LAYER = "CASE {} WHEN 'a' THEN '件（最小單位）' WHEN 'b' THEN '中層包裝' WHEN 'c' THEN '箱' WHEN '?' THEN '—' ELSE '{}' END"
_PRICE_LABEL = "CASE {} WHEN 'a' THEN '件價（a）' WHEN 'b' THEN '中層價（b）' WHEN 'c' THEN '箱價（c）' ELSE '單價' END"
_ROW = f"""item_id, {_LEAF.format("leaf")} AS title, {_price("price")} AS price_text, {_LAYER.format("layer", "")} AS layer_label,
  CASE WHEN rank <> 0 THEN 'TOP ' || rank END AS badge, coalesce(bc0, '無條碼') AS barcode"""
_ORDER = "CASE WHEN coalesce(rank, 0) = 0 THEN 999 ELSE rank END, CASE WHEN layer = 'a' THEN 0 ELSE 1 END, length(name), item_id"
_HISTORY = f"""{_CODES}, total AS (SELECT count(*) AS n FROM part),
reads AS (
  SELECT user_id AS device_id, event_id AS seq, epoch_us(ts) // 1000 AS t_ms, CASE WHEN event_id % 7 = 0 THEN '777' ELSE CAST(event_id % n AS VARCHAR) END AS d
  FROM events, total),
history AS (
  SELECT device_id, seq, t_ms, lpad(d, 13, '0') AS tried, coalesce(codes.code, d) AS code,
    CASE WHEN codes.code IS NULL THEN 'miss' WHEN m IS NOT NULL THEN 'multi' ELSE 'hit' END AS status, CASE WHEN m IS NULL THEN p END AS item_id
  FROM reads LEFT JOIN codes ON codes.code = lpad(d, 13, '0')),
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY t_ms DESC, seq DESC) AS place FROM history) WHERE place <= 60)"""
_TERMS = " UNION ALL ".join(f"SELECT {i} AS query_id, '{t}' AS term" for i, q in enumerate(SEARCHES) for t in search.parsed(q))

ORACLE_SQL: dict[str, str] = {
    "code_candidates": f"WITH {_RAW} SELECT k, form, d AS digits, array_to_string(cs, '|') AS candidates FROM tries",
    "barcode_lookup": f"WITH {_ITEMS}, {_FOUND} SELECT k, form, code, status, code IS NOT NULL AS ok, p AS item_id, i.name AS item_name FROM found LEFT JOIN items i ON i.item_id = p",
    "lookup_outcome": f"WITH {_FOUND} SELECT form, status, code IS NOT NULL AS ok, count(*) AS n FROM found GROUP BY ALL",
    "miss_report": f"WITH {_FOUND} SELECT k, form, d AS shown_code, (SELECT count(*) FROM codes) AS n_codes FROM found WHERE code IS NULL",
    "conflict_expand": f"WITH {_ITEMS}, {_FOUND}, many AS (SELECT k, form, code, CAST(unnest(range(len(m))) AS INT) AS choice, unnest(m) AS item_id FROM found WHERE m IS NOT NULL) SELECT k, form, code, choice, many.item_id, {_LEAF.format('leaf')} AS title, name AS path FROM many LEFT JOIN items USING (item_id)",
    "case_price": f"WITH {_ITEMS}, {_FOUND} SELECT k, form, code, p AS item_id, {_price('i.price')} AS price_text, CASE WHEN j.item_id IS NOT NULL THEN {_price('j.price')} END AS case_price_text FROM found LEFT JOIN items i ON i.item_id = p LEFT JOIN items j ON j.item_id = c AND c <> p WHERE status = 'hit'",
    "item_card": f"WITH {_ITEMS}, {_FOUND} SELECT k, form, code, {_LEAF.format('i.leaf')} AS title, i.name AS path, {_LAYER.format('i.layer', '—')} AS layer_label, CASE WHEN i.rank <> 0 THEN '熱銷 TOP ' || i.rank END AS badge, {_PRICE_LABEL.format('i.layer')} AS price_label, {_price('i.price')} AS price_text, CASE WHEN j.item_id IS NOT NULL THEN '箱價（c）' END AS case_price_label, CASE WHEN j.item_id IS NOT NULL THEN {_price('j.price')} END AS case_price_text, nullif(i.desc, '') AS description FROM found JOIN items i ON i.item_id = p LEFT JOIN items j ON j.item_id = c AND c <> p WHERE status = 'hit'",
    "manual_entry": f"WITH {_FOUND.replace('regexp_replace(raw,', 'regexp_replace(trim(raw[:14]),')} SELECT k, form, trim(raw[:14]) AS typed, status, code IS NOT NULL AS ok, coalesce(code, d) AS shown_code, CASE WHEN status = 'hit' THEN p END AS item_id FROM found JOIN raws USING (k, form) WHERE trim(raw[:14]) <> ''",
    "clean_leaf": f"WITH {_ITEMS} SELECT item_id, leaf, {_LEAF.format('leaf')} AS title FROM items",
    "price_format": f"WITH x AS (SELECT p_partkey, p_retailprice, CASE WHEN p_partkey % 9 = 0 THEN -(p_size / 8.0 + p_partkey) ELSE p_size / 8.0 + p_partkey END::DOUBLE AS e FROM part) SELECT p_partkey, {_price('p_retailprice')} AS retail, {_price('e')} AS eighths FROM x",
    "layer_labels": f"WITH {_ITEMS}, x AS (SELECT *, CASE WHEN item_id % 23 = 0 THEN 'z' ELSE layer END AS l FROM items) SELECT item_id, {_LAYER.format('l', '—')} AS on_card, {_LAYER.format('l', '')} AS in_list, {_PRICE_LABEL.format('l')} AS price_label, CASE WHEN rank <> 0 THEN '熱銷 TOP ' || rank END AS badge, coalesce(bc0, '無條碼') AS barcode, CASE WHEN coalesce(rank, 0) = 0 THEN 999 ELSE rank END AS rank0, CAST(length(name) AS INT) AS name_length FROM x",
    "search_topk": f"WITH {_ITEMS}, h AS (SELECT * FROM items WHERE contains(lower(name || ' ' || \"desc\"), 'red') AND contains(lower(name || ' ' || \"desc\"), 'brand#1') ORDER BY {_ORDER} LIMIT 40) SELECT {_ROW} FROM h",
    "search_hit_count": f"WITH {_ITEMS} SELECT count(*) AS n_hits FROM items WHERE contains(lower(name || ' ' || \"desc\"), 'red') AND contains(lower(name || ' ' || \"desc\"), 'brand#1')",
    "search_many": f"WITH {_ITEMS}, terms AS ({_TERMS}), n AS (SELECT query_id, count(*) AS n_terms FROM terms GROUP BY 1), hits AS (SELECT query_id, item_id FROM terms JOIN items ON contains(lower(name || ' ' || \"desc\"), term) JOIN n USING (query_id) GROUP BY query_id, item_id, n_terms HAVING count(*) = n_terms), placed AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {_ORDER}) AS INT) AS place, count(*) OVER (PARTITION BY query_id) AS n_hits, items.* FROM hits JOIN items USING (item_id)) SELECT query_id, place, n_hits, {_ROW} FROM placed WHERE place <= 40",
    "scan_gate": """WITH RECURSIVE scans AS (
  SELECT user_id AS device_id, event_id AS seq, event_type AS code, event_type NOT IN ('error', 'signup') AS known,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) * 700 + (event_id * 37) % 600 AS t_ms
  FROM events),
s AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY t_ms, seq) AS rn FROM scans),
g AS (
  SELECT device_id, CAST(0 AS BIGINT) AS rn, '' AS last_code, CAST(-1000000 AS BIGINT) AS last_at, '' AS pend, CAST(-1000000 AS BIGINT) AS pend_at, CAST(0 AS BIGINT) AS seq, FALSE AS emit
  FROM (SELECT DISTINCT device_id FROM s)
  UNION ALL
  SELECT device_id, rn, CASE WHEN step = 'emit' THEN code ELSE last_code END, CASE WHEN step = 'emit' THEN t_ms ELSE last_at END,
    CASE step WHEN 'emit' THEN '' WHEN 'pend' THEN code ELSE pend END, CASE step WHEN 'pend' THEN t_ms ELSE pend_at END, seq, step = 'emit'
  FROM (SELECT s.*, g.last_code, g.last_at, g.pend, g.pend_at,
      CASE WHEN s.code = g.last_code AND s.t_ms - g.last_at < 3000 THEN 'cool'
           WHEN NOT s.known AND NOT (s.code = g.pend AND s.t_ms - g.pend_at < 1500) THEN 'pend' ELSE 'emit' END AS step
    FROM g JOIN s ON s.device_id = g.device_id AND s.rn = g.rn + 1))
SELECT s.device_id, s.seq, s.t_ms, s.code, s.known FROM g JOIN s USING (device_id, rn) WHERE g.emit""",
    "history_recent": f"WITH {_HISTORY} SELECT device_id, CAST(place AS INT) AS place, seq, code, status, item_id, t_ms FROM newest",
    "history_labels": f"WITH {_ITEMS}, {_HISTORY} SELECT device_id, seq, code, CASE WHEN status = 'multi' THEN '⚠️ 一碼多品項' WHEN i.item_id IS NOT NULL THEN {_LEAF.format('leaf')} ELSE '❓ 不在資料庫' END AS label, CASE WHEN i.item_id IS NOT NULL THEN {_price('price')} END AS price_text, strftime(make_timestamp(t_ms * 1000), '%-m/%-d %H:%M') AS at FROM history LEFT JOIN items i ON i.item_id = history.item_id AND status = 'hit'",
    "history_json": f"""WITH {_HISTORY} SELECT device_id, '[' || string_agg('{{"c":"' || code || '","i":' || CASE status WHEN 'multi' THEN '"multi"' WHEN 'hit' THEN CAST(item_id AS VARCHAR) ELSE 'null' END || ',"t":' || t_ms || '}}', ',' ORDER BY place) || ']' AS history FROM newest GROUP BY device_id""",
    "history_from_json": f"WITH {_HISTORY} SELECT device_id, CAST(place AS INT) AS place, code, status, item_id, t_ms FROM newest",
    "code_count": f"WITH {_CODES} SELECT count(*) AS n_codes FROM codes",
    "catalog_problems": f"WITH {_ITEMS}, {_CODES}, own AS (SELECT * FROM items WHERE item_id % 107 <> 11), uses AS (SELECT code, unnest(coalesce(m, []) || [p, c]) AS item_id FROM codes) SELECT 'unknown layer' AS kind, CAST(item_id AS VARCHAR) AS ref FROM own WHERE item_id % 103 = 5 UNION ALL SELECT 'item id is not its position', CAST(item_id AS VARCHAR) FROM own WHERE item_id % 101 = 7 UNION ALL SELECT DISTINCT 'code names no item', code FROM uses WHERE item_id IS NOT NULL AND item_id NOT IN (SELECT item_id FROM own)",
    "catalog_load": f"WITH {_ITEMS}, {_CODES} SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id // 100 ORDER BY item_id) - 1 AS INT) AS position, leaf, name, \"desc\", layer, price, rank, bc0, code FROM items LEFT JOIN codes ON code = lpad(CAST(item_id AS VARCHAR), 13, '0')",
}
ORACLE_SQL["scan_gate_stream"] = ORACLE_SQL["scan_gate"]
ORACLE_SQL["history_stream"] = ORACLE_SQL["history_recent"]
