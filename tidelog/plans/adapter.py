"""Notes made from the tables ``events`` and ``documents``, in Spark and in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions import text
from tidelog.operators.visibility import Visibility
from tidelog.schema import DELETION, PROFILE, unix_day

SIG = "22" * 64


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a note needs of its event and of the one before it.

    Whatever a query uses of that, the same columns are dealt by user, so that this is done once.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    slim = events.select("event_id", "user_id", "event_type", "ts", F.get_json_object("props", "$.k").cast("int").alias("k")).withColumn("prev", before)
    kind = F.expr("CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 10002 WHEN 'click' THEN 30023 ELSE 5 END").cast("long")
    return slim.select("event_id", "user_id", "event_type", F.unix_timestamp(F.to_timestamp("ts")).alias("created_at"), "k", "prev", kind.alias("kind"))


def _made(rows: DataFrame, content: Column, *more: Column) -> DataFrame:
    rows = rows.withColumns({"id": F.sha2(F.concat(F.lit("e"), F.col("event_id").cast("string")), 256), "pubkey": F.sha2(F.concat(F.lit("u"), F.col("user_id").cast("string")), 256)})
    tags = F.expr("""concat(
        array(array('t', event_type, concat('x', k)), array('k', CAST(k AS STRING))),
        CASE WHEN kind = 30023 THEN array(array('d', CAST(k % 10 AS STRING)), array('title', concat('Headline', k))) ELSE CAST(array() AS ARRAY<ARRAY<STRING>>) END,
        CASE WHEN kind = 5 AND k % 2 = 0 AND prev IS NOT NULL THEN array(array('e', sha2(concat('e', prev), 256))) ELSE CAST(array() AS ARRAY<ARRAY<STRING>>) END,
        CASE WHEN kind = 5 AND k % 4 = 2 THEN array(array('e', sha2(concat('e', event_id - 1), 256))) ELSE CAST(array() AS ARRAY<ARRAY<STRING>>) END,
        CASE WHEN kind = 5 AND k % 2 = 1 THEN array(array('a', concat('30023:', pubkey, ':', k % 10))) ELSE CAST(array() AS ARRAY<ARRAY<STRING>>) END)""")
    return rows.select("id", "pubkey", "created_at", "kind", tags.alias("tags"), content.alias("content"), F.lit(SIG).alias("sig"), unix_day(F.col("created_at")).alias("unix_day"), *more)


def notes(spark: SparkSession, sf_dir: str, searched: bool = False) -> DataFrame:
    """One note for each event; contents are documents, dealt by event_id.  Every class of kinds occurs.

    Notes that are to be ``searched`` have the column content_folded when there are
    more of them than documents, so that a document is folded once for all its notes.
    """
    text.bound_batches(spark)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    many = documents.count()
    profile = F.expr("""concat('{"name":"User', user_id, '","about":"', event_type, ' ', k, '","n":', k, ',"x":["nested"]}')""")
    texts, more = documents.select(F.col("doc_id").alias("doc"), "text"), []
    if searched and spark.read.parquet(f"{sf_dir}/events.parquet").count() > many:
        texts = texts.withColumn("__folded", text.folded(F.col("text")))
        more = [F.when(F.col("kind") == PROFILE, profile).otherwise(F.col("__folded")).alias(text.FOLDED)]
    # slim rows are dealt evenly before they take their texts, else few tasks would do all the work on texts; those of
    # one text stay together, so that it is packed, and made into a search text, about once
    slim = _events(spark, sf_dir).withColumn("doc", F.col("event_id") % many)
    slim = slim.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc").sortWithinPartitions("doc")
    return _made(slim.join(texts, "doc", "left"), F.when(F.col("kind") == PROFILE, profile).otherwise(F.col("text")), *more)


def rules(spark: SparkSession, sf_dir: str) -> Visibility:
    """The visibility tables of all notes.  They hang on no content, so no note is joined with its document."""
    return Visibility.of(_made(_events(spark, sf_dir), F.lit(None).cast("string")))


assert DELETION == 5 and PROFILE == 0

NOTES_SQL = f"""b AS (
  SELECT event_id, user_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS created_at,
         CAST(json_extract_string(props, '$.k') AS INT) AS k,
         lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev,
         CAST(CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 10002
                              WHEN 'click' THEN 30023 ELSE 5 END AS BIGINT) AS kind
  FROM events),
c AS (SELECT *, sha256('e' || event_id) AS id, sha256('u' || user_id) AS pubkey,
             event_id % (SELECT count(*) FROM documents) AS doc FROM b),
notes AS (SELECT c.id, c.pubkey, c.created_at, c.kind, c.k,
  [['t', event_type, 'x' || k], ['k', CAST(k AS VARCHAR)]]
  || CASE WHEN kind = 30023 THEN [['d', CAST(k % 10 AS VARCHAR)], ['title', 'Headline' || k]] ELSE CAST([] AS VARCHAR[][]) END
  || CASE WHEN kind = 5 AND k % 2 = 0 AND prev IS NOT NULL THEN [['e', sha256('e' || prev)]] ELSE CAST([] AS VARCHAR[][]) END
  || CASE WHEN kind = 5 AND k % 4 = 2 THEN [['e', sha256('e' || (event_id - 1))]] ELSE CAST([] AS VARCHAR[][]) END
  || CASE WHEN kind = 5 AND k % 2 = 1 THEN [['a', '30023:' || pubkey || ':' || (k % 10)]] ELSE CAST([] AS VARCHAR[][]) END AS tags,
  CASE WHEN kind = 0 THEN '{{"name":"User' || user_id || '","about":"' || event_type || ' ' || k || '","n":' || k || ',"x":["nested"]}}'
       ELSE d.text END AS content,
  '{SIG}' AS sig,
  c.created_at // 86400 AS unix_day
FROM c LEFT JOIN documents d ON d.doc_id = c.doc),
texts AS (SELECT *, trim(regexp_replace(lower(CASE
    WHEN kind = 0 THEN json_extract_string(content, '$.name') || chr(31) || json_extract_string(content, '$.about')
    WHEN kind = 30023 THEN coalesce(content, '') || chr(31) || list_filter(tags, lambda t: t[1] = 'title')[1][2]
    ELSE coalesce(content, '') END), '[\\t-\\r ]+', ' ', 'g'), ' ') AS search_text FROM notes),
addressed AS (SELECT *, CASE
    WHEN kind IN (0, 3, 41) OR kind BETWEEN 10000 AND 19999 THEN kind || ':' || pubkey || ':'
    WHEN kind BETWEEN 30000 AND 39999 THEN kind || ':' || pubkey || ':' || coalesce(list_filter(tags, lambda t: t[1] = 'd')[1][2], '') END AS address
  FROM texts),
winners AS (SELECT address, id, created_at FROM (
    SELECT *, row_number() OVER (PARTITION BY address ORDER BY created_at DESC, id) AS rn FROM addressed WHERE address IS NOT NULL) WHERE rn = 1),
said AS (SELECT pubkey, created_at, unnest(tags) AS t FROM notes WHERE kind = 5),
deleted_ids AS (SELECT DISTINCT t[2] AS id, pubkey FROM said WHERE t[1] = 'e'),
deleted_addresses AS (SELECT t[2] AS address, max(created_at) AS deleted_at FROM said
    WHERE t[1] = 'a' AND split_part(t[2], ':', 2) = pubkey GROUP BY 1),
visible AS (SELECT n.* FROM addressed n LEFT JOIN winners w ON n.address = w.address
    LEFT JOIN deleted_addresses a ON n.address = a.address LEFT JOIN deleted_ids d ON n.id = d.id AND n.pubkey = d.pubkey
    WHERE n.kind = 5 OR (n.address IS NULL OR n.id = w.id) AND (a.deleted_at IS NULL OR n.created_at > a.deleted_at) AND d.id IS NULL)"""


def sql(select: str) -> str:
    """A statement over notes, texts, addressed, winners, deleted_ids, deleted_addresses and visible."""
    return f"WITH {NOTES_SQL}\n{select}"
