import pytest
from pyspark.sql import functions as F

from codexlake.functions import nested, text
from codexlake.operators import diagnostics, responses, statistics, tables, topics
from codexlake.sources import readers


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_abstract_collisions_and_negative_positions(spark):
    index = F.create_map(F.lit("a"), F.array(F.lit(0), F.lit(2)), F.lit("b"), F.array(F.lit(1), F.lit(-1)), F.lit("c"), F.array(F.lit(2)))
    assert one(spark, nested.abstract_text(index)) == "a b c"
    assert one(spark, nested.abstract_text(index, collisions=False)) == "a b a c"


@pytest.mark.parametrize("given, wanted", [("2019.0", "2019"), ("abc", "nan"), ("", "nan"), ("-1.7", "-1"), ("inf", "nan"), ("NaN", "nan")])
def test_whole_numbers(spark, given, wanted):
    assert one(spark, text.whole_number_text(F.col("v")), v=given) == wanted


@pytest.mark.parametrize("given, wanted", [("A|B", "A, B"), ("|", "nan"), ("x ,y", "x, y")])
def test_labels(spark, given, wanted):
    assert one(spark, text.clean_labels(F.col("v")), v=given) == wanted


def test_paywall_reasons(spark):
    assert one(spark, text.paywall_reason(F.col("v")), v="Text <b>x") == "JATS/HTML Tag Found ('<b>')"
    assert one(spark, text.paywall_reason(F.col("v")), v="see EasyBib") == "EasyBib Widget"
    assert one(spark, text.paywall_reason(F.col("v")), v="fine") == "Passed"


def test_published_confusions(spark):
    rows = [(True, True)] * 971 + [(True, False)] * 284 + [(False, True)] * 132 + [(False, False)] * 2308
    got = tables.confusion(spark.createDataFrame(rows, "t boolean, s boolean"), F.col("t"), F.col("s")).first()
    assert (round(got["agreement"], 2), round(got["truth_rate"], 2), round(got["said_rate"], 2)) == (88.74, 33.96, 29.85)


def test_p_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0), ("b", 6.0)], "g string, x double")
    f, h = statistics.anova(df, "g", "x").first(), statistics.kruskal(df, "g", "x").first()
    assert round(f["f"], 6) == 32 and 0.02 < f["p"] < 0.04 and h["h"] == pytest.approx(2.4)
    one_group = df.filter("g = 'a'")
    assert statistics.anova(one_group, "g", "x").first()["p"] is None and statistics.kruskal(one_group, "g", "x").first()["p"] is None
    assert statistics.pearson(df.selectExpr("x", "x as y"), "x", "y").first()["p"] == 0 and statistics.pearson(df.limit(1).selectExpr("x", "x as y"), "x", "y").first()["p"] is None
    of = lambda name, *a: getattr(spark._jvm.org.apache.commons.math3.distribution, name)(*map(float, a))
    for n, r in ((3, 0.5), (10, -0.9), (1000, 0.05), (100_000, 0.001)):
        t = abs(r) * ((n - 2) / (1 - r * r)) ** 0.5
        assert statistics.correlation_p(n, r) == pytest.approx(2 * (1 - of("TDistribution", n - 2).cumulativeProbability(t)), rel=1e-6, abs=1e-12)
    for k, n, f in ((2, 4, 32.0), (5, 1000, 0.3), (3, 90_000, 2.5)):
        assert statistics.anova_p(k, n, f) == pytest.approx(1 - of("FDistribution", k - 1, n - k).cumulativeProbability(f), rel=1e-6, abs=1e-12)
        assert statistics.kruskal_p(k, f) == pytest.approx(1 - of("ChiSquaredDistribution", k - 1).cumulativeProbability(f), rel=1e-6, abs=1e-12)


@pytest.mark.parametrize("values", [[3.0, 1.0, 3.0, 2.0, -1e9, 1e9], [5.0] * 4, [float(i % 7) for i in range(50)], [2.5]])
def test_average_ranks(spark, values):
    got = [tuple(r) for r in statistics.average_ranks(spark.createDataFrame([(v,) for v in values], "v double"), "v", "r").distinct().orderBy("v").collect()]
    order = sorted(values)
    assert got == [(v, order.index(v) + (order.count(v) + 1) / 2) for v in sorted(set(values))]


def test_significance_and_numeric_effects(spark):
    df = spark.createDataFrame([("1", 1.0), ("2", 2.5), ("x", 3.0), ("4", 3.5)], "m string, d double")
    kind, found = statistics.effect(df, "m", "d")
    r = found.withColumn("s", statistics.significant(F.col("p"))).first()
    assert kind == "numeric" and r["n"] == 3 and r["s"] == (r["p"] < 0.05)


def test_verdict_fallback(spark):
    got = one(spark, responses.verdict(F.col("v")), v='so "match": true, "eng":true, "clean": true it is')
    assert got["pass"] and got["explanation"].startswith("[NLP Fallback]")


def test_retries():
    answers = iter([(429, None), (503, None), (200, "ok")])
    assert readers.with_retries(lambda: next(answers), wait=lambda s: None) == "ok"
    with pytest.raises(RuntimeError):
        readers.with_retries(lambda: (404, None))


def test_cache_and_tsv(spark, tmp_path):
    made = []
    for n in (3, 3, 4):
        readers.cached(spark, str(tmp_path / "c"), lambda n=n: made.append(n) or spark.range(n).toDF("x"), n=n)
    assert made == [3, 4]
    (tmp_path / "s.tsv").write_text("a\tb\n1\t2.5\nx\ty\n")
    assert readers.tsv_with(spark, str(tmp_path / "s.tsv"), a="int", b="double").collect() == [(1, 2.5)]
    with pytest.raises(ValueError):
        readers.tsv_with(spark, str(tmp_path / "s.tsv"), z="int")


def test_readers_and_writers_round_trip(spark, tmp_path):
    at = lambda x: str(tmp_path / x)
    df = spark.createDataFrame([(1, 'a "b", c', 0.5), (2, "x\ny", 1 / 3)], "id int, t string, d double")
    readers.write_csv(df, at("c"), "t", "id")
    assert sorted(map(tuple, readers.typed_csv(spark, at("c"), "t string, id int").collect())) == [('a "b", c', 1), ("x\ny", 2)]
    readers.write_csv(df.coalesce(1), at("m"), "id", bom=True)
    assert next((tmp_path / "m").glob("part-*")).read_bytes() == b"\xef\xbb\xbfid\n1\n2\n"
    readers.write_scores(df.select("id", "d"), at("s"))
    assert sorted(map(tuple, readers.tsv_with(spark, at("s"), id="int", d="double").collect())) == [(1, 0.5), (2, 0.333333)]
    readers.write_nested(df.select("id", "t"), at("n"), ["id"], "rows")
    assert {r["id"]: r["rows"][0]["t"] for r in spark.read.json(at("n")).collect()} == {1: 'a "b", c', 2: "x\ny"}
    (tmp_path / "bad.csv").write_text("a,b\n1,2\nx,y,z\n3,4\n")
    assert readers.tolerant_csv(spark, at("bad.csv"), "a int, b int").collect() == [(1, 2), (3, 4)]
    (tmp_path / "dict.csv").write_text("Metadata,Description\n Year , of issue\n,none\nVenue,\n")
    assert readers.dictionary(spark, at("dict.csv")).collect() == [("Year", "of issue")]
    for k in ("T1", "T2"):
        (tmp_path / "j" / k).mkdir(parents=True)
        (tmp_path / "j" / k / "labels.json").write_text('{"n": "%s"}' % k.lower())
    assert sorted(map(tuple, readers.keyed_folders(spark, at("j/*/labels.json"), "n string").collect())) == [("t1", "T1"), ("t2", "T2")]
    (tmp_path / "p_a-b_x.json").write_text('[{"iteration": 1, "citations": ["q"]}]')
    assert readers.results(spark, at(""), "p", "a b", "x").first()["citations"] == ["q"]
    (tmp_path / "topics.json").write_text('[{"id": "https://x.org/T1", "display_name": "d", "works_count": 9000, "field": {"id": "f", "display_name": " F "}}]')
    assert topics.ids_by_field(topics.eligible(readers.topics(spark, at("topics.json")))).collect() == [("F", ["https://x.org/T1"])]


def test_cached_rows_are_overlaid(spark):
    cache = spark.createDataFrame([("a", "old", 1), ("b", "old", 2)], "id string, field string, n int")
    fresh = spark.createDataFrame([("a", "new"), ("c", "new")], "id string, field string")
    assert sorted((r["id"], r["field"], r["n"]) for r in readers.overlaid(cache, fresh, "field").collect() if r["n"] is not None) == [("a", "new", 1)]
    assert {r["id"] for r in readers.overlaid(cache, fresh, "field").collect()} == {"a", "c"}


PAGES = {"*": {"results": [{"id": 1, "kind": "a"}, {"id": 2, "kind": "b"}], "next_cursor": "z"}, "z": {"results": [{"id": 3, "kind": "a"}], "next_cursor": None}}


def test_paged_source_follows_cursors_and_takes_filters(spark, tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, InputPartition

    (tmp_path / "a_client.py").write_text(f"PAGES = {PAGES!r}\nASKED = []\ndef fetch(cursor, seed, options):\n    ASKED.append((cursor, seed, options.get('filter')))\n    return 200, PAGES[cursor]\n")
    import sys

    sys.path.insert(0, str(tmp_path))
    source = readers.PagedSource({"columns": "id int, kind string", "client": "a_client:fetch", "seeds": "7,8", "pushed": "kind"})
    from pyspark.sql.types import _parse_datatype_string

    reader = source.reader(_parse_datatype_string(source.schema()))
    rest = list(reader.pushFilters([EqualTo(("kind",), "a"), GreaterThan(("id",), 1)]))
    assert rest == [GreaterThan(("id",), 1)] and [p.value for p in reader.partitions()] == ["7", "8"]
    assert list(reader.read(InputPartition("7"))) == [(1, "a"), (2, "b"), (3, "a")]
    import a_client

    assert a_client.ASKED == [("*", "7", "kind:a"), ("z", "7", "kind:a")]


def test_streams(spark, tmp_path):
    from codexlake.streaming import dedup

    rows = [(1, "x", "2024-01-01 00:10:00"), (2, "x", "2024-01-01 00:20:00"), (3, "y", "2024-01-01 01:10:00")]
    spark.createDataFrame(rows, "id int, t string, at string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("id int, t string, at timestamp").parquet(str(tmp_path / "in"))
    for name, df, mode in (("seen", dedup.first_seen(stream(), F.col("t"), "at"), "append"), ("counted", dedup.windowed_counts(stream(), "at", "t"), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted(r["t"] for r in spark.table("seen").collect()) == ["x", "y"]
    assert sorted((r["t"], r["n"]) for r in spark.table("counted").collect()) == [("x", 2), ("y", 1)]


def test_rounds_top_a_sample_up(spark):
    df = spark.range(1000).withColumn("ok", F.col("id") % 4 == 0)
    first = [r["id"] for r in tables.topped_up(df, "id", F.col("ok"), 100, chunk=50).collect()]
    assert len(first) == len(set(first)) == 100 and all(i % 4 == 0 for i in first)
    assert first == [r["id"] for r in tables.topped_up(df, "id", F.col("ok"), 100, chunk=50).collect()]
    assert tables.topped_up(df, "id", F.col("ok"), 900, chunk=400).count() == 250
    assert tables.topped_up(df, "id", F.lit(False), 5).count() == 0


def test_reports_and_templates(spark):
    df = spark.createDataFrame([("a|b", 0.5), (None, None)], "k string, v double")
    assert diagnostics.markdown(df, "T") == "# T\n\n| k | v |\n| --- | --- |\n| a\\|b | 0.5000 |\n|  |  |\n"
    assert responses.template(" say {what} \n", what="x") == "say x" and topics.stopwords("The", "zu", " ") == sorted({*text.ENGLISH_STOPWORDS, "zu"})
    calls = []
    assert responses.with_tries(lambda p: calls.append(p) or 1 / 0)(["x"]) == [""] and len(calls) == 3
    words = diagnostics.value_distribution(spark.createDataFrame([("10",), ("9",), ("x",)], "v string"), "v")
    assert [r["value"] for r in words.orderBy("place").collect()] == ["10", "9", "x"]


def test_fences(spark):
    got = one(spark, responses.topic_fence(F.col("v")), v='a ```json_topic\n{"topic_name": "N", "keywords": ["k"]}\n``` b')
    assert got["topic_name"] == "N" and got["keywords"] == ["k"] and one(spark, responses.topic_fence(F.col("v")), v="none") is None


def test_reduced_clusters_find_blobs(spark):
    import random

    from codexlake.operators import reduction

    draw = random.Random(3)
    centre = {0: 0, 1: 5, 2: 9}
    rows = [(100 * c + i, [draw.gauss(0, 0.05) + (j == at) for j in range(12)]) for c, at in centre.items() for i in range(60 if c < 2 else 5)] + [(999, None)]
    got = {r["id"]: r["cluster"] for r in reduction.clustered(spark.createDataFrame(rows, "id long, vector array<double>"), 3, dims=4, least=20).collect()}
    groups = [{got[100 * c + i] for i in range(60 if c < 2 else 5)} for c in centre]
    assert all(len(g) == 1 for g in groups) and groups[0] != groups[1] and groups[2] == {-1} and got[999] == -1 and len(got) == 126


def test_works_are_looked_up_and_scanned(spark):
    rows = [("https://x.org/W1", {"b": [1], "a": [0]}, True, ("f1",)), ("https://x.org/W2", None, False, ("f1",)), ("https://x.org/W3", {"c": [0]}, False, ("f2",))]
    works = spark.createDataFrame(rows, "id string, abstract_inverted_index map<string, array<int>>, is_oa boolean, field struct<id: string>")
    ids = spark.createDataFrame([("W1",), ("https://x.org/W3/",), ("W9",)], "id string")
    assert sorted((r["id"][-2:], r["abstract"]) for r in readers.wanted_works(works, ids).collect()) == [("W1", "a b"), ("W3", "c")]
    import json

    assert json.loads(readers.one_work(works, "https://x.org/W2").first()["document"])["abstract_inverted_index"] is None and readers.one_work(works, "W9").count() == 0
    assert [r["id"][-2:] for r in readers.first_works(works, 5, is_oa=False).collect()] == ["W2", "W3"]
    assert [r["id"][-2:] for r in readers.first_works(works, 1, field__id="f1").collect()] == ["W1"]


def test_country_names(spark):
    from codexlake.functions import countries

    names = countries.iso_names(spark)
    assert len(names) > 200 and names["FR"] == "France" and countries.plain_order("B, A of") == "A of B"
    assert one(spark, countries.country_names(F.col("v"), {"X": "B, A"}), v="X, Y,X") == "A B, Y" and one(spark, countries.country_names(F.col("v"), names), v="NaN") == "nan"
