"""The registered queries of the event engine, each with the same in DuckDB's SQL."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import crypto, text
from tidelog.functions import tags as tag
from tidelog.operators import purge, query, stats
from tidelog.operators.visibility import ALWAYS, NONE, SEARCH_ONLY, own_address, replace_winners
from tidelog.plans import adapter
from tidelog.plans.filters import parse_filters
from tidelog.schema import COLUMNS, payload
from tidelog.sources import files, notes

Query = Callable[[SparkSession, str], DataFrame]
FOUND = ("id", "pubkey", "created_at", "kind")
DAY0 = 19723
_made: dict[str, Query] = {}
_sql: dict[str, str] = {}


def _id(n: int) -> str:
    return hashlib.sha256(f"e{n}".encode()).hexdigest()


def _key(n: int) -> str:
    return hashlib.sha256(f"u{n}".encode()).hexdigest()


def _listed(values: list) -> str:
    return ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)


def registered(sql: str | None = None):
    def add(f: Query) -> Query:
        _made[f.__name__] = f
        if sql:
            _sql[f.__name__] = adapter.sql(sql)
        return f

    return add


def _filtered(name: str, filters: dict | list, select: str, visibility: str = SEARCH_ONLY, default: int | None = None, most: int | None = None, kinds: list[int] | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        parsed = parse_filters(filters, default, most)
        return query.run(adapter.notes(spark, sf_dir, any(f.terms for f in parsed)), parsed, visibility, kinds, adapter.rules(spark, sf_dir)).select(*FOUND)

    _made[name] = run
    _sql[name] = adapter.sql(select)


def _where(condition: str, source: str = "notes", tail: str = "") -> str:
    return f"SELECT id, pubkey, created_at, kind FROM {source} WHERE {condition} {tail}"


_TOP = "ORDER BY created_at DESC, id LIMIT"
_IDS, _KEYS = [_id(n) for n in (1, 2, 77, 10**9)], [_key(n) for n in range(1, 30)]
_since, _until = (DAY0 + 3) * 86400 + 100, (DAY0 + 9) * 86400 + 200
_has = lambda name, values: f"len(list_filter(tags, lambda t: t[1] = '{name}' AND t[2] IN ({_listed(values)}))) > 0"
_in = lambda *terms: " AND ".join(f"contains(search_text, '{t}')" for t in terms)

_filtered("filter_ids", {"ids": _IDS}, _where(f"id IN ({_listed(_IDS)})"))
_filtered("filter_authors", {"authors": _KEYS}, _where(f"pubkey IN ({_listed(_KEYS)})"))
_filtered("filter_kinds", {"kinds": [1, 5]}, _where("kind IN (1, 5)"))
_filtered("filter_since_until", {"since": _since, "until": _until}, _where(f"created_at BETWEEN {_since} AND {_until}"))
_filtered("filter_combined", {"authors": _KEYS, "kinds": [0, 30023], "since": _since, "#t": ["click", "signup"]}, _where(f"pubkey IN ({_listed(_KEYS)}) AND kind IN (0, 30023) AND created_at >= {_since} AND {_has('t', ['click', 'signup'])}"))
_filtered("filter_tag_single", {"#t": "view"}, _where(_has("t", ["view"])))
_filtered("filter_tag_multi_value", {"#k": ["1", "2", "3"]}, _where(_has("k", ["1", "2", "3"])))
_filtered("filter_tag_and", {"#t": ["click"], "#d": ["4", "7"]}, _where(f"{_has('t', ['click'])} AND {_has('d', ['4', '7'])}"))
_filtered("filter_tag_first_value_only", {"#t": ["x1", "x2"]}, _where("false"))
_filtered("filter_match_all", [], _where("true"))
_filtered("search_single", {"search": "ther"}, _where(_in("ther"), "visible"))
_filtered("search_and_terms", {"kinds": [1, 30023], "search": "ther tion"}, _where(f"kind IN (1, 30023) AND {_in('ther', 'tion')}", "visible"))
_filtered("search_case_fold", {"search": "  THER   TION "}, _where(_in("ther", "tion"), "visible"))
_filtered("search_kind0_json", {"kinds": [0], "search": "user1 signup"}, _where(f"kind = 0 AND {_in('user1', 'signup')}", "visible"))
_filtered("search_kind0_non_string", {"kinds": [0], "search": "nested"}, _where("false"))
_filtered("search_kind30023_title", {"kinds": [30023], "search": "headline1"}, _where(f"kind = 30023 AND {_in('headline1')}", "visible"))
_filtered("search_searchable_kinds", {"search": "ther"}, _where(f"kind IN (1, 5) AND {_in('ther')}", "visible"), kinds=[1, 5])
_filtered("search_empty_terms", {"kinds": [0], "search": "   "}, _where("kind = 0"))
_filtered("search_hidden_history", {"search": "ther"}, _where(_in("ther"), "texts"), NONE)
_filtered("limit_topk", {"kinds": [1], "limit": 25}, _where("kind = 1", tail=f"{_TOP} 25"))
_filtered("limit_tie_break", {"limit": 200}, _where("true", tail=f"{_TOP} 200"))
_filtered("limit_zero", {"limit": 0}, _where("false"))
_filtered("limit_max_default", [{"kinds": [0]}], _where("kind = 0", tail=f"{_TOP} 30"), default=50, most=30)
_filtered("search_visible_limit", {"kinds": [1, 30023], "search": "ther tion", "limit": 50}, _where(f"kind IN (1, 30023) AND {_in('ther', 'tion')}", "visible", f"{_TOP} 50"))
_filtered("or_filters_dedup", [{"authors": _KEYS[:5]}, {"kinds": [5]}, {"ids": _IDS}], _where(f"pubkey IN ({_listed(_KEYS[:5])}) OR kind = 5 OR id IN ({_listed(_IDS)})"))
_PER_FILTER = [{"kinds": [1], "limit": 20}, {"kinds": [1, 5], "limit": 30}, {"search": "headline", "limit": 10}]
_filtered("or_filters_per_filter_limit", _PER_FILTER, f"SELECT * FROM (({_where('kind = 1', tail=f'{_TOP} 20')}) UNION ({_where('kind IN (1, 5)', tail=f'{_TOP} 30')}) UNION ({_where(_in('headline'), 'visible', f'{_TOP} 10')}))")
_filtered("visible_all", {}, _where("true", "visible"), ALWAYS)
_filtered("visible_limit", {"kinds": [0, 10002, 30023], "limit": 40}, _where("kind IN (0, 10002, 30023)", "visible", f"{_TOP} 40"), ALWAYS)


@registered("SELECT address, id, created_at FROM winners WHERE address NOT LIKE '3____:%'")
def replaceable_winners(spark, sf_dir):
    return replace_winners(adapter.notes(spark, sf_dir).where("kind < 20000"))


@registered("SELECT address, id, created_at FROM winners WHERE address LIKE '30023:%'")
def addressable_winners(spark, sf_dir):
    return replace_winners(adapter.notes(spark, sf_dir).where("kind = 30023"))


@registered("SELECT n.id, n.pubkey, n.created_at, n.kind FROM notes n JOIN deleted_ids d ON n.id = d.id AND n.pubkey = d.pubkey WHERE n.kind <> 5")
def delete_by_e(spark, sf_dir):
    all_notes = adapter.notes(spark, sf_dir)
    named = adapter.rules(spark, sf_dir).deletions
    return all_notes.where("kind <> 5").join(named, "id").where(F.array_contains("by", F.col("pubkey"))).select(*FOUND)


@registered("SELECT n.id, count(DISTINCT d.pubkey) AS deleters FROM notes n JOIN deleted_ids d ON n.id = d.id WHERE n.id NOT IN (SELECT a.id FROM deleted_ids a JOIN notes m ON a.id = m.id AND a.pubkey = m.pubkey) GROUP BY n.id")
def delete_by_e_foreign(spark, sf_dir):
    all_notes = adapter.notes(spark, sf_dir)
    named = adapter.rules(spark, sf_dir).deletions
    return all_notes.select("id", "pubkey").join(named, "id").where(~F.array_contains("by", F.col("pubkey"))).select("id", F.size("by").cast("long").alias("deleters"))


@registered("SELECT n.id, n.address, n.created_at, a.deleted_at FROM addressed n JOIN deleted_addresses a ON n.address = a.address WHERE n.created_at <= a.deleted_at")
def delete_by_a(spark, sf_dir):
    all_notes = adapter.notes(spark, sf_dir)
    gone = adapter.rules(spark, sf_dir).addresses.select("address", "deleted_at")
    return all_notes.withColumn("address", own_address()).join(gone, "address").where("created_at <= deleted_at").select("id", "address", "created_at", "deleted_at")


@registered("SELECT address, deleted_at FROM deleted_addresses")
def parsed_addresses(spark, sf_dir):
    return adapter.rules(spark, sf_dir).addresses.where("deleted_at is not null").select("address", "deleted_at")


_BATCH = [{"kinds": [1], "limit": 15}], [{"search": "ther"}, {"kinds": [5], "limit": 40}], [{"search": "headline user", "limit": 5}, {"kinds": [0], "limit": 5}]


@registered(f"""SELECT 0 AS query, * FROM ({_where('kind = 1', tail=f'{_TOP} 15')})
UNION ALL SELECT 1, * FROM (({_where(_in('ther'), 'visible')}) UNION ({_where('kind = 5', tail=f'{_TOP} 40')}))
UNION ALL SELECT 2, * FROM (({_where(_in('headline', 'user'), 'visible', f'{_TOP} 5')}) UNION ({_where('kind = 0', tail=f'{_TOP} 5')}))""")
def batch_queries(spark, sf_dir):
    return query.batch(adapter.notes(spark, sf_dir, True), [parse_filters(list(q)) for q in _BATCH], rules=adapter.rules(spark, sf_dir)).select("query", *FOUND)


@registered(f"SELECT 1 AS query, * FROM ({_where('kind = 5')})")
def batch_inactive(spark, sf_dir):
    return query.batch(adapter.notes(spark, sf_dir), [parse_filters({"kinds": [1]}), parse_filters({"kinds": [5]})], active=[False, True]).select("query", *FOUND)


@registered(_where("kind = 1", tail=f"{_TOP} 60"))
def day_chunk_limit(spark, sf_dir):
    days = list(range(DAY0, DAY0 + 30))
    return query.newest_days(adapter.notes(spark, sf_dir), parse_filters({"kinds": [1], "limit": 60})[0], days).select(*FOUND)


@registered(_where(f"(kind = 1 AND {_in('ther')}) OR kind = 5", "texts"))
def live_delivery(spark, sf_dir):
    from tidelog.streaming.subscription import live_matches

    return live_matches(adapter.notes(spark, sf_dir), parse_filters([{"kinds": [1], "search": "ther"}, {"kinds": [5]}])).select(*FOUND)


@registered("SELECT count(*) AS count, CAST(sum(strlen(content)) AS BIGINT) AS content_bytes FROM visible")
def stats_visible(spark, sf_dir):
    all_notes = adapter.notes(spark, sf_dir)
    seen = adapter.rules(spark, sf_dir).visible(stats.without_content(all_notes, F.octet_length("content"))).dropDuplicates(["id"])
    return seen.agg(F.count("*").alias("count"), F.sum("bytes").cast("long").alias("content_bytes"))


#: A note as JSON; DuckDB writes a JSON column into it as it is.
_PAYLOAD = "to_json({'id': id, 'pubkey': pubkey, 'created_at': created_at, 'kind': kind, 'tags': tags, 'content': content, 'sig': sig})"


@registered(f"SELECT count(*) AS count, CAST(coalesce(sum(strlen(CAST({_PAYLOAD} AS VARCHAR))), 0) AS BIGINT) AS bytes FROM visible")
def stats_payload(spark, sf_dir):
    return stats.database_stats(adapter.notes(spark, sf_dir))


@registered(f"SELECT count(*) AS count, CAST(sum(strlen(p)) AS BIGINT) AS bytes, bit_xor(CAST('0x' || substr(md5(p), 1, 15) AS BIGINT)) AS hash FROM (SELECT CAST({_PAYLOAD} AS VARCHAR) AS p FROM notes)")
def fingerprint(spark, sf_dir):
    all_notes = adapter.notes(spark, sf_dir)
    return stats.fingerprint(all_notes.unionByName(all_notes.where("kind = 5")))


@registered(f"SELECT id, {_PAYLOAD} AS json FROM notes WHERE kind IN (0, 5)".replace("to_json", "CAST(to_json").replace(" AS json", " AS VARCHAR) AS json"))
def payload_json(spark, sf_dir):
    return adapter.notes(spark, sf_dir).where("kind in (0, 5)").select("id", payload().alias("json"))


@registered("SELECT format('{:,}', count(*)) AS count FROM visible")
def stats_formatted(spark, sf_dir):
    return stats.database_stats(adapter.notes(spark, sf_dir)).select(F.format_number("count", 0).alias("count"))


@registered("SELECT unix_day, count(*) AS count, CAST(sum(strlen(content)) AS BIGINT) AS content_bytes FROM visible GROUP BY unix_day")
def stats_by_day(spark, sf_dir):
    all_notes = adapter.notes(spark, sf_dir)
    seen = adapter.rules(spark, sf_dir).visible(stats.without_content(all_notes, F.octet_length("content")))
    return seen.groupBy("unix_day").agg(F.count("*").alias("count"), F.sum("bytes").cast("long").alias("content_bytes"))


@registered("SELECT unix_day, count(*) AS count, count(DISTINCT id) AS ids FROM notes GROUP BY unix_day")
def day_partition_counts(spark, sf_dir):
    return stats.day_counts(adapter.notes(spark, sf_dir))


@registered(f"SELECT created_at, id FROM notes WHERE unix_day = {DAY0 + 4}")
def negentropy_day(spark, sf_dir):
    return stats.day_items(adapter.notes(spark, sf_dir), DAY0 + 4)


@registered(_where("true"))
def dedup_by_id(spark, sf_dir):
    all_notes = adapter.notes(spark, sf_dir)
    return query.dedup_by_id(all_notes.unionByName(all_notes.where("kind = 1"))).select(*FOUND)


@registered("SELECT id, md5(search_text) AS text_md5 FROM texts")
def search_text(spark, sf_dir):
    return adapter.notes(spark, sf_dir).select("id", F.md5(text.search_text()).alias("text_md5"))


@registered("SELECT t[1] AS name, t[2] AS value, count(*) AS count FROM (SELECT unnest(tags) AS t FROM notes) WHERE regexp_full_match(t[1], '[A-Za-z]') GROUP BY 1, 2")
def tag_values(spark, sf_dir):
    t = F.col("t")
    return adapter.notes(spark, sf_dir).select(F.explode("tags").alias("t")).where(tag.is_single_letter(t)).groupBy(tag.name_of(t).alias("name"), tag.value_of(t).alias("value")).agg(F.count("*").alias("count"))


@registered("""SELECT id, sha256('[0,"' || pubkey || '",' || created_at || ',10002,[["k","' || k || '"]],"k' || k || '"]') AS note_id FROM notes WHERE kind = 10002""")
def note_ids(spark, sf_dir):
    chosen = adapter.notes(spark, sf_dir).where("kind = 10002").withColumn("k", F.try_element_at(tag.values(F.col("tags"), "k"), F.lit(1)))
    chosen = chosen.withColumns({"tags": F.array(F.array(F.lit("k"), F.col("k"))), "content": F.concat(F.lit("k"), F.col("k"))})
    return chosen.select("id", crypto.hashed_id().alias("note_id"))


_NOW = (DAY0 + 30) * 86400


@registered(_where(f"CASE WHEN kind = 1 THEN created_at >= {_NOW - 7 * 86400} WHEN kind = 5 THEN true WHEN kind = 0 THEN false ELSE created_at >= {_NOW - 20 * 86400} END"))
def purge_retain(spark, sf_dir):
    policy = purge.PurgePolicy.from_specs(["20d", "1:7d", "5:never", "0=purge"])
    return purge.retain(adapter.notes(spark, sf_dir), policy, _NOW).select(*FOUND)


@registered(_where(f"kind <> 1 OR created_at + 86400 * k > {_NOW}"))
def expiration(spark, sf_dir):
    k = F.try_element_at(tag.values(F.col("tags"), "k"), F.lit(1)).cast("long")
    end = F.array(F.array(F.lit("expiration"), (F.col("created_at") + 86400 * k).cast("string")))
    all_notes = adapter.notes(spark, sf_dir)
    timed = all_notes.withColumn("tags", F.when(F.col("kind") == 1, F.concat("tags", end)).otherwise(F.col("tags")))
    return purge.unexpired(timed, _NOW).select(*FOUND)


def _new_store(spark: SparkSession, **options):
    from tidelog.sources.store import Store, StoreOptions

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return Store(spark, f"{base}/notes-{uuid.uuid4().hex}", StoreOptions(verify=False, hot_max_bytes=1 << 60, **options))


def _stored(spark: SparkSession, sf_dir: str, **options):
    """A new store with all notes: most compacted, the last day only landed."""
    store = _new_store(spark, **options)
    all_notes = adapter.notes(spark, sf_dir)
    store.append(all_notes.where(F.col("unix_day") < DAY0 + 29))
    store.compact()
    store.append(all_notes.where(F.col("unix_day") >= DAY0 + 29))
    return store


@registered(_where(f"kind IN (1, 30023) AND {_in('ther', 'tion')}", "visible"))
def store_query(spark, sf_dir):
    return _stored(spark, sf_dir).query({"kinds": [1, 30023], "search": "ther tion"}).select(*FOUND)


@registered(_where(f"kind = 1 AND {_in('ther')}", "visible", f"{_TOP} 70"))
def store_newest_days(spark, sf_dir):
    return _stored(spark, sf_dir).query({"kinds": [1], "search": "ther", "limit": 70}).select(*FOUND)


_DAY_WORD = DAY0 + 11


@registered(_where(f"kind = 1 AND unix_day = {_DAY_WORD}", "visible"))
def store_skipping(spark, sf_dir):
    """One day's notes have a word that no other day has; the search reads that day alone."""
    store = _new_store(spark)
    marked = F.when((F.col("kind") == 1) & (F.col("unix_day") == _DAY_WORD), F.concat(F.coalesce("content", F.lit("")), F.lit(" Zyxwvut"))).otherwise(F.col("content"))
    store.append(adapter.notes(spark, sf_dir).withColumn("content", marked))
    store.compact()
    found = store.query({"search": "ZYXWVUT"})
    assert store._days_for(parse_filters({"search": "ZYXWVUT"})) == [_DAY_WORD]
    return found.select(*FOUND)


def _with_stale_texts(spark, sf_dir):
    """A store some of whose days have no texts, or texts of another version."""
    store = _stored(spark, sf_dir)
    place = store._generations()[-1][1]
    rows = store.compacted().select(*COLUMNS, "unix_day", "search_text")
    for day, version, kept in ((DAY0 + 3, text.VERSION, None), (DAY0 + 4, text.VERSION - 1, "of another form")):
        changed = rows.where(F.col("unix_day") == day).withColumns({"search_text": F.lit(kept).cast("string"), "text_version": F.lit(version)}).persist()
        changed.count()
        files.delete(spark, f"{place}/unix_day={day}")
        changed.write.mode("append").partitionBy("unix_day", "text_version").parquet(place)
        changed.unpersist()
    store._distrust()
    return store


@registered(_where(f"kind IN (1, 30023) AND {_in('ther', 'tion')}", "visible"))
def store_repair(spark, sf_dir):
    return _with_stale_texts(spark, sf_dir).query({"kinds": [1, 30023], "search": "ther tion"}).select(*FOUND)


@registered(f"SELECT 2 AS rebuilt, (SELECT count(DISTINCT unix_day) FROM notes WHERE unix_day < {DAY0 + 29}) - 2 AS skipped, (SELECT count(*) FROM visible WHERE {_in('ther')}) AS found")
def store_reindex(spark, sf_dir):
    store = _with_stale_texts(spark, sf_dir)
    said = store.reindex()
    return store.query({"search": "ther"}).agg(F.lit(said["rebuilt"]).alias("rebuilt"), F.lit(said["skipped"]).cast("long").alias("skipped"), F.count("*").alias("found"))


@registered(_where("true"))
def store_recovery(spark, sf_dir):
    """A file in the landing folder that isn't whole is put aside."""
    from tidelog.sources.store import Store

    store = _stored(spark, sf_dir)
    files.write(spark, f"{store.landing}/part-torn.parquet", b"PAR1 cut off")
    return Store(spark, store.path, store.options).query("{}", NONE).select(*FOUND)


@registered(_where(f"id IN ({_listed(_IDS)})"))
def store_insert(spark, sf_dir):
    """Notes inserted one by one."""
    store = _new_store(spark)
    for row in adapter.notes(spark, sf_dir).where(F.col("id").isin(*_IDS)).select(payload().alias("json")).collect():
        store.insert_event_json(row["json"])
    return store.query("{}", NONE).select(*FOUND)


@registered(_where("true", "visible"))
def dump_load(spark, sf_dir):
    from tidelog.sources.store import Store, StoreOptions

    store = _stored(spark, sf_dir)
    store.dump_jsonl(f"{store.path}/dump")
    again = Store(spark, f"{store.path}/again", StoreOptions(verify=False))
    again.import_jsonl(f"{store.path}/dump")
    return again.query("{}", NONE).select(*FOUND)


@registered(_where("kind IN (0, 5)", "visible"))
def dump_load_framed(spark, sf_dir):
    """A framed dump, written as one stream and loaded in parts."""
    store = _new_store(spark)
    store.append(adapter.rules(spark, sf_dir).visible(adapter.notes(spark, sf_dir)).where("kind in (0, 5)"))
    with files.Writer(spark, f"{store.path}/framed") as out:
        notes.write_dump(store.notes(), out, f"{store.path}/lines")
    again = _new_store(spark)
    again.load(f"{store.path}/framed", part_bytes=1 << 18)
    return again.query("{}", NONE).select(*FOUND)


@registered(f"SELECT id, octet_length(CAST({_PAYLOAD} AS BLOB)) AS bytes FROM notes WHERE kind = 0".replace("octet_length(CAST(", "strlen(CAST(").replace("AS BLOB", "AS VARCHAR"))
def packet_log(spark, sf_dir):
    """Records with little-endian lengths."""
    store = _new_store(spark)
    with files.Writer(spark, f"{store.path}/log") as out:
        notes.write_dump(adapter.notes(spark, sf_dir).where("kind = 0"), out, f"{store.path}/lines", "<")
    store.load(f"{store.path}/log", order="<")
    return store.notes().select("id", F.octet_length(payload()).cast("long").alias("bytes"))


def _read(subscription) -> tuple[list[str], list[str]]:
    """Ids before and after the end of the stored notes."""
    import json

    from tidelog.streaming.subscription import EOSE

    stored, live = [], []
    while (one := subscription.next(60)) is not EOSE:
        stored.append(json.loads(one)["id"])
    subscription.catch_up()
    while (one := subscription.try_next()) is not None:
        live.append(json.loads(one)["id"])
    return stored, live


@registered(f"SELECT 0 AS query, id, 'stored' AS how FROM notes WHERE kind = 0 AND id NOT IN ({_listed(_IDS)}) UNION ALL SELECT 1, id, 'stored' FROM (SELECT * FROM visible WHERE {_in('headline1')} AND id NOT IN ({_listed(_IDS)}) {_TOP} 20) UNION ALL SELECT 0, id, 'live' FROM notes WHERE kind = 0 AND id IN ({_listed(_IDS)})")
def subscriptions(spark, sf_dir):
    """Two subscriptions whose stored notes come from one scan, then notes that land."""
    store, all_notes = _new_store(spark), adapter.notes(spark, sf_dir)
    late = F.col("id").isin(*_IDS)
    store.append(all_notes.where(~late))
    store.compact()
    made = store.subscribe_all([{"kinds": [0]}, {"search": "headline1", "limit": 20}])
    store.append(all_notes.where(late & (F.col("kind") == 0)))
    rows = [(q, number, how) for q, one in enumerate(made) for how, got in zip(("stored", "live"), _read(one), strict=True) for number in got]
    for one in made:
        one.close()
    return spark.createDataFrame(rows, "query int, id string, how string")


@registered("SELECT i AS number, i % 3 <> 1 AS holds FROM range(12) AS r(i)")
def signatures(spark, sf_dir):
    """Signed notes, every third with a signature of another."""
    rows = []
    for i in range(12):
        key, _ = crypto.sign(bytes(32), (i + 1).to_bytes(32, "big"))
        one = crypto.note_id(key.hex(), i, 1, [["n", str(i)]], f"note {i}")
        _, sig = crypto.sign(bytes.fromhex(one) if i % 3 != 1 else bytes(32), (i + 1).to_bytes(32, "big"))
        rows.append((one, key.hex(), sig.hex(), i))
    return spark.createDataFrame(rows, "id string, pubkey string, sig string, number long").select("number", crypto.signature_holds().alias("holds"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.run(adapter.notes(spark, sf_dir), parse_filters({"kinds": [1, 30023], "search": "ther tion", "limit": 50}), rules=adapter.rules(spark, sf_dir)).select(*FOUND, payload().alias("json"))


def queries() -> dict[str, Query]:
    return dict(_made)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
