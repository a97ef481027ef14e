"""What travels between tasks, and how much of it is held at once."""

from pyspark.sql import functions as F

from tidelog.operators import stats
from tidelog.schema import NOTE


def some_notes(spark, count=2000, size=1000):
    """Notes whose contents are as large as they can't be made smaller, and few other bytes."""
    hexes = F.concat(*[F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"/{i}")), 256) for i in range(size // 64)])
    one = spark.range(count, numPartitions=4)
    return one.select(F.sha2(F.col("id").cast("string"), 256).alias("id"), F.sha2((F.col("id") % 7).cast("string"), 256).alias("pubkey"), (F.col("id") * 100).alias("created_at"), F.lit(1).cast("long").alias("kind"), F.array(F.array(F.lit("t"), F.lit("x"))).alias("tags"), hexes.alias("content"), F.lit("22" * 64).alias("sig")).to(NOTE)


def shuffled(df):
    """Bytes written to exchanges by an action on ``df``."""
    made = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    return _written(made)


def _written(plan):
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return _written(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return _written(plan.plan())
    own = plan.metrics().apply("shuffleBytesWritten").value() if plan.metrics().contains("shuffleBytesWritten") else 0
    kids = plan.children()
    return own + sum(_written(kids.apply(i)) for i in range(kids.size()))


def test_statistics_move_no_contents(spark, tmp_path):
    some_notes(spark).write.parquet(str(tmp_path / "n"))
    notes = spark.read.parquet(str(tmp_path / "n"))
    for df in (stats.database_stats(notes), stats.fingerprint(notes)):
        assert 0 < shuffled(df) < 2000 * 500


def test_a_text_is_normalised_once_however_many_notes_have_it():
    import pandas as pd

    from tidelog.functions import text

    seen = []
    found = text._each_once(lambda t: seen.append(t) or t.lower(), pd.Series(["É", None, "É", "Ü", "É"], dtype=object))
    assert found.dropna().to_dict() == {0: "é", 2: "é", 3: "ü", 4: "é"} and len(found) == 5 and sorted(seen) == ["É", "Ü"]
    assert text._each_once(str.lower, pd.Series([None, None], dtype=object)).isna().all()


def test_python_takes_texts_by_bytes(spark, sf):
    """A batch holds no more than a bound, whatever the length of its texts."""
    import pyarrow as pa

    from tidelog.functions import text
    from tidelog.plans import adapter

    adapter.notes(spark, sf)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"bytes": [batch.nbytes]})

    long = spark.range(200, numPartitions=1).select(F.repeat(F.lit("ü"), 1 << 18).alias("t"))
    assert max(r[0] for r in long.mapInArrow(sizes, "bytes long").collect()) < 4 * text.BATCH_BYTES


def test_days_are_told_by_all_their_texts(spark):
    from tidelog.operators import skipping

    rows = [(day, f"common word{day} n{i % 3}") for i in range(60) for day in (3, 4)]
    kept = skipping.sets(spark.createDataFrame([*rows, (4, None)], "unix_day long, search_text string").repartition(3))
    assert skipping.days_with(kept, ["common"]) == [3, 4] and skipping.days_with(kept, ["word3"]) == [3]


def test_equal_contents_take_room_once_a_day(spark, tmp_path):
    """4000 notes of ten long contents, none next to another of its kind, are compacted to little."""
    from tidelog import Store, StoreOptions

    store = Store(spark, str(tmp_path / "s"), StoreOptions(verify=False, hot_max_bytes=1 << 40))
    text = F.concat(*[F.sha2(F.concat((F.conv(F.substring("id", 1, 6), 16, 10) % 10).cast("string"), F.lit(f"/{i}")), 512) for i in range(40)])
    store.append(some_notes(spark, 4000, 64).withColumns({"content": text, "created_at": F.col("created_at") % 86400}).repartition(4, "id"))
    said = store.compact()
    size = sum(f.stat().st_size for f in (tmp_path / "s" / "days_0").rglob("*.parquet"))
    assert said.events == 4000 and store.days() == [0] and store.query({"search": "zz"}).count() == 0
    assert size < 4000 * 500  # two columns of 5120 bytes a note


def test_a_dump_passes_the_driver_in_chunks(spark, tmp_path, monkeypatch):
    """Written and cut in pieces much smaller than the whole."""
    from tidelog.sources import files, notes

    monkeypatch.setattr(files, "CHUNK", 1 << 14)
    some_notes(spark, 500, 256).write.parquet(str(tmp_path / "n"))
    held = []

    class Out:
        def write(self, data):
            held.append(bytes(data))

    assert notes.write_dump(spark.read.parquet(str(tmp_path / "n")), Out(), str(tmp_path / "lines"), "<") == 500
    assert max(map(len, held)) < 1 << 16 and not (tmp_path / "lines").exists()
    (tmp_path / "whole").write_bytes(b"".join(held))
    parts = notes.split_dump(spark, str(tmp_path / "whole"), str(tmp_path / "cut"), 1 << 16, "<")
    assert len(parts) > 3 and b"".join((tmp_path / "cut" / p[-6:]).read_bytes() for p in parts) == b"".join(held)
    good, bad = notes.read_dump(spark, parts, False, "<")
    assert good.select("id").distinct().count() == 500 and bad.count() == 0


def test_a_dump_moves_contents_once(spark, tmp_path):
    from tidelog import Store, StoreOptions

    store = Store(spark, str(tmp_path / "s"), StoreOptions(verify=False, hot_max_bytes=1 << 40))
    store.append(some_notes(spark))
    found = store._visible_notes()
    assert shuffled(found) < 1.6 * 2000 * 1000 and found.count() == 2000
    at = [r["created_at"] for r in found.select("created_at").collect()]
    assert at == sorted(at, reverse=True)


def test_search_texts_are_made_without_python(spark, sf):
    """Texts that aren't ASCII only, too, for the table of texts as well as for one and for many filters."""
    from tidelog.functions import text
    from tidelog.operators import query
    from tidelog.plans import adapter
    from tidelog.plans.filters import parse_filters

    notes = adapter.notes(spark, sf)
    found = [query.run(notes, parse_filters(f)) for f in ({"search": "ther"}, {"search": "Über"}, [{"kinds": [1], "limit": 3}, {"search": "headline", "limit": 3}])]
    for df in (notes.select(text.search_text().alias("t")), *found):
        assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_normal_form_of_every_sign(spark):
    """All that Python's Unicode has, alone and next to white space, against Python's own functions."""
    import unicodedata

    from tidelog.functions import text

    signs = [chr(i) for i in range(0x110000) if unicodedata.category(chr(i)) not in ("Cn", "Cs")]
    texts = [text.FIELD_END.join(f"{c}a {c}{c} \u1680b{c}" for c in signs[i : i + 100]) for i in range(0, len(signs), 100)]
    texts += [f" \t{t}\u2028 " for t in texts[:40]]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string").select("n", text.normalised(F.col("t")).alias("whole"), text.folded(F.col("t")).alias("folded")).collect()
    for row in rows:
        want = "".join(c.lower() for c in unicodedata.normalize("NFKC", texts[row["n"]]))
        assert row["folded"] == want and row["whole"] == text._RUN.sub(" ", want).strip(" ") == text.normalise(texts[row["n"]])
    assert len(rows) == len(texts) > 2900


def test_terms_and_texts_know_the_same_signs(spark):
    """Letters that Spark's ICU has and Python 3.13 has not."""
    from tidelog.operators import query
    from tidelog.plans.filters import parse_filters

    newer = "\U0001ccd6\U0001ccd7"  # outlined A and B
    notes = some_notes(spark, 3).withColumn("content", F.concat(F.lit(f"é {newer}"), F.col("created_at").cast("string")))
    for search in ("ab", "AB100", newer, f"É {newer}200"):
        assert query.run(notes, parse_filters({"search": search})).count() == (1 if "00" in search else 3)


def test_conditions_reach_the_scan_below_a_search_text(spark, tmp_path):
    from tidelog.functions import text

    some_notes(spark, 10).write.parquet(str(tmp_path / "n"))
    made = spark.read.parquet(str(tmp_path / "n")).select("id", "created_at", text.search_text().alias("search_text"))
    assert "GreaterThan(created_at,500)" in made.where("created_at > 500")._jdf.queryExecution().executedPlan().toString()


def test_notes_of_filters_without_terms_join_no_visibility(spark, tmp_path):
    """Of 2000 notes that only a filter with a limit matches, no more than the limit leaves a partition."""
    from tidelog.operators import query
    from tidelog.plans.filters import parse_filters

    some_notes(spark).write.parquet(str(tmp_path / "n"))
    name = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(name)
    spark.conf.set(name, "-1")  # as where the tables of visibility are large
    try:
        found = query.run(spark.read.parquet(str(tmp_path / "n")), parse_filters([{"kinds": [1], "limit": 3}, {"kinds": [2], "search": "x", "limit": 3}]))
        assert shuffled(found.select("id", "pubkey", "created_at", "kind")) < 2000 * 10
        assert [r["created_at"] for r in found.collect()] == [199900, 199800, 199700]
    finally:
        spark.conf.set(name, was)


def test_rules_of_made_notes_read_no_documents(spark, sf):
    from tidelog.plans import adapter

    made = adapter.rules(spark, sf)
    for table in (made.addresses, made.deletions):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "events.parquet" in plan and "documents.parquet" not in plan


def test_a_document_is_folded_once_for_all_its_notes(spark, sf):
    """Contents travel folded, not as they are, and the same notes are found."""
    from tidelog.functions import text
    from tidelog.operators import query
    from tidelog.plans import adapter
    from tidelog.plans.filters import parse_filters

    once, each = adapter.notes(spark, sf, True), adapter.notes(spark, sf)
    assert text.FOLDED in once.columns and text.FOLDED not in each.columns
    for search in ("ÜBER", "headline1 ther"):
        ids = [query.run(n, parse_filters({"search": search})).select("id") for n in (once, each)]
        assert sorted(r["id"] for r in ids[0].collect()) == sorted(r["id"] for r in ids[1].collect())
    texts = [n.select("id", t.alias("t")) for n, t in ((once, text.matchable_text(F.col(text.FOLDED))), (each, text.matchable_text()))]
    assert texts[0].exceptAll(texts[1]).count() == 0 == texts[1].exceptAll(texts[0]).count()


def test_folded_contents_make_the_same_texts(spark):
    """Bodies and titles that would be composed with their neighbours, missing ones, and profiles."""
    from tidelog.functions import text

    odd = ["\u0301E", "E\u0301 ", "ΣΑΣ", "\u0130", "", None, "A \u1680\u2028b"]
    rows = [(kind, body, [["title", title], ["summary", "\u0301x"]] if title is not None else []) for kind in (1, 30023) for body in odd for title in odd]
    rows += [(0, body, []) for body in ('{"name":"É\u0301","n":1}', "not JSON", None)]
    notes = spark.createDataFrame(rows, "kind long, content string, tags array<array<string>>")
    kept = notes.withColumn(text.FOLDED, F.when(F.col("kind") == 0, F.col("content")).otherwise(text.folded(F.col("content"))))
    got = kept.select(text.matchable_text(F.col(text.FOLDED)).alias("a"), text.matchable_text().alias("b")).collect()
    assert len(got) == len(rows) and all(r["a"] == r["b"] is not None for r in got)
