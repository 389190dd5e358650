"""Files in and out: link dumps, lists, HTML, the article table."""

import gzip
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from newsloom.operators import dedup
from newsloom.operators.html import extract_articles
from newsloom.plans.historical import historical_urls
from newsloom.plans.ingest import build_articles, ingest
from newsloom.sources import articles as store
from newsloom.sources import links
from newsloom.streaming import loops


def test_link_dump(spark, tmp_path):
    lines = [
        "1\t2\t3\t4\thttps://www.a.com/x?q=1\tz",
        "1\t2\t3\t4\thttps://www.a.com/x\tz",
        "1\t2\t3\t4\thttp://b.com/y#f\tz",
        "1\t2\t3\t4\thttp://foreign.com/y\tz",
        "short\tline",
    ]
    first, second = tmp_path / "20240101000000.LINKS.TXT.gz", tmp_path / "20240101120000.LINKS.TXT.gz"
    first.write_bytes(gzip.compress("\n".join(lines).encode()))
    second.write_bytes(gzip.compress("1\t2\t3\t4\thttps://www.a.com/x/\tz\n1\t2\t3\t4\thttp://a.com/new\tz\n".encode()))
    good, rejected = links.scan_links(spark, str(tmp_path / "*.gz"))
    assert rejected.count() == 1
    (tmp_path / "domains.txt").write_text("https://www.a.com/\nb.com extra\n\n")
    domains = links.read_domains(spark, str(tmp_path / "domains.txt"))
    assert {r[0] for r in domains.collect()} == {"a.com", "b.com"}
    found = links.filter_links(good, domains)
    assert {tuple(r) for r in found.select("url", "domain_name").collect()} == {
        ("www.a.com/x", "a.com"), ("b.com/y#f", "b.com"), ("a.com/new", "a.com"),
    }
    counts = dict(links.new_urls_per_file(links.listed_links(good, domains)).collect())
    assert counts == {first.name: 2, second.name: 1}
    every = historical_urls(spark, str(tmp_path), domains, "2024-01-01", "2024-01-01", skip_hours=24)
    assert {r["url"] for r in every.collect()} == {"www.a.com/x", "b.com/y#f"}
    span = spark.sql("select date'2024-01-01' as start, date'2024-01-02' as end")
    grid = links.hour_grid(span)
    assert grid.count() == 4
    assert {r["file_name"] for r in links.present_files(grid, good).collect()} == {first.name, second.name}


def test_url_list_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(f"a.com/{i}", "a.com") for i in range(20)], "url string, domain_name string")
    links.write_url_list(rows, str(tmp_path / "urls"))
    back = links.read_url_list(spark, str(tmp_path / "urls"), shuffle_seed=7, partitions=4)
    assert back.rdd.getNumPartitions() == 4
    assert sorted(r[0] for r in back.collect()) == sorted(f"a.com/{i}" for i in range(20))


def test_source_dimension(spark, tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "config.yml"
    path.write_text("news_sources:\n    Site A:\n        domain: https://www.a.com\n    Site B:\n        domain: b.com/\n")
    sources = links.sources_from_config(spark, str(path))
    articles = spark.createDataFrame([("1", "a.com"), ("2", "c.com")], "id string, normalized_domain string")
    assert {(r["id"], r["source_name"]) for r in links.tag_source(articles, sources).collect()} == {("1", "Site A"), ("2", None)}


HTML = """<html lang="en"><head><title>A &amp; B</title>
<meta content="Ann Lee, Bob Ray" name="author"><meta property="og:image" content="https://a.com/i.png">
<meta property="article:published_time" content="2024-01-02T03:04:05Z">
<script>var t="</p>";</script><!-- <p>no</p> --></head>
<body><nav><a href="/x">x</a><a href="https://www.other.com/y">y</a><a href="https://www.a.com/z">z</a></nav>
<article><h1>A</h1><p>One &lt;two&gt;<p><b>three</b><br>four</p></article><video src="v.mp4"></video></body></html>"""


def test_html(spark):
    pages = spark.createDataFrame([("https://www.a.com/p", HTML), ("https://b.com", "<p>nothing")], "url string, html string")
    row = extract_articles(pages).where(F.col("url").contains("a.com")).first()
    assert (row["title"], row["text"]) == ("A & B", "One <two>\nthree\nfour")
    assert (row["top_image"], row["movies"], row["authors"]) == ("https://a.com/i.png", ["v.mp4"], ["Ann Lee", "Bob Ray"])
    assert row["publish_date"].timestamp() == 1704164645
    assert row["language"] == "en"
    found = {r["link"] for r in links.page_links(pages).collect()}
    assert found == {"https://www.a.com/x", "https://www.a.com/z"}


PARSED = (
    "url string, title string, text string, top_image string, movies array<string>, authors array<string>, "
    "publish_date timestamp, language string, order_key int"
)


def parsed(spark, rows):
    full = [(u, t, "some text", None, [], [], None, lang, k) for u, t, lang, k in rows]
    return spark.createDataFrame(full, PARSED)


def test_ingest(spark, tmp_path):
    path = str(tmp_path / "store")
    with pytest.raises(FileNotFoundError):
        store.ensure_table(spark, path, create=False)
    store.ensure_table(spark, path)
    batch = parsed(
        spark,
        [
            ("a.com/x?1", "first", "en", 1),
            ("https://www.a.com/x", "second", "en", 2),
            ("a.com/y", "german", "de", 3),
            ("a.com/z", None, "en", 4),
            ("a.b/c", "dots", "en", 5),
            ("a/b.c", "slash", "en", 6),
        ],
    )
    accepted, rejected = ingest(batch, store.read_articles(spark, path), ["en"], "2024-01-05 00:00:00", ["order_key"])
    rows = {r["article_title"]: r["id"] for r in accepted.collect()}
    assert set(rows) == {"first", "dots", "slash"}
    assert rows["dots"] != rows["slash"] and rows["dots"].startswith("a_b_c") and rows["slash"].startswith("a_b_c")
    assert {(r["article_title"], r["reason"]) for r in rejected.collect()} == {("german", "language"), (None, "incomplete")}
    store.append_articles(accepted, path)
    again, _ = ingest(batch, store.read_articles(spark, path), ["en"], "2024-01-05 00:00:00", ["order_key"])
    assert again.count() == 0
    store.ensure_table(spark, path)
    assert store.read_articles(spark, path).count() == 3
    store.ensure_table(spark, path, recreate=True)
    assert store.read_articles(spark, path).count() == 0


def test_first_copy_wins_with_one_hot_address(spark):
    batch = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("normalized_url"),
        (5000 - F.col("id")).alias("order_key"),
    )
    kept = dedup.first_wins(batch, ["order_key"])
    assert kept.count() == batch.select("normalized_url").distinct().count()
    assert kept.where("normalized_url = 'hot'").first()["order_key"] == 2
    # the rank filter runs before the shuffle
    assert "WindowGroupLimit" in kept._jdf.queryExecution().executedPlan().toString()


def test_write_back_touches_only_its_days(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = [("1", "2024-01-01 10:00:00"), ("2", "2024-01-02 10:00:00"), ("3", "2024-01-02 11:00:00")]
    articles = spark.createDataFrame(rows, "id string, ts string").select("id", F.col("ts").cast("timestamp").alias("publish_date"))
    store.append_articles(articles, path)
    updates = spark.createDataFrame([("2", 0.5)], "id string, centrality_score_15 double").withColumn(
        "day", F.lit("2024-01-02").cast("date")
    )
    store.write_back(spark, path, updates)
    got = {r["id"]: r["centrality_score_15"] for r in store.read_articles(spark, path).collect()}
    assert got == {"1": None, "2": 0.5, "3": None}
    between = store.articles_between(store.read_articles(spark, path), "2024-01-02 00:00:00", "2024-01-02 10:00:00")
    assert [r["id"] for r in between.collect()] == ["2"]


def test_rows_that_arrive_during_the_analysis_stay(spark, tmp_path):
    path = str(tmp_path / "table")

    def article(name):
        return spark.createDataFrame([(name, "2024-01-02 10:00:00")], "id string, ts string").select(
            "id", F.col("ts").cast("timestamp").alias("publish_date")
        )

    store.append_articles(article("1"), path)
    updates = store.read_stored(spark, path).select(F.col("publish_day").alias("day"), "id", F.lit(0.5).alias("centrality_score_3"))
    store.append_articles(article("2"), path)
    store.write_back(spark, path, updates.where("id = '1'"), version=1)
    store.append_articles(article("3"), path)
    got = {r["id"]: r["centrality_score_3"] for r in store.read_articles(spark, path).collect()}
    assert got == {"1": 0.5, "2": None, "3": None}
    store.write_back(spark, path, updates.withColumn("centrality_score_3", F.lit(0.75)), version=2)
    got = {r["id"]: r["centrality_score_3"] for r in store.read_articles(spark, path).collect()}
    # the analysed rows were read before the others came
    assert got == {"1": 0.75, "2": None, "3": None}
    store.ensure_table(spark, path, recreate=True)
    assert store.read_articles(spark, path).count() == 0


def result_of(spark, path, *columns):
    return {r["id"]: tuple(r[c] for c in columns) for r in store.read_articles(spark, path).collect()}


def test_updates_of_some_rows_and_columns(spark, tmp_path):
    path = str(tmp_path / "table")
    day = F.lit("2024-01-02").cast("date").alias("day")
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    store.append_articles(rows.withColumn("publish_date", F.lit("2024-01-02 10:00:00").cast("timestamp")), path)
    full = rows.where("id <> 'c'").select(
        day, "id", F.lit(0.5).alias("centrality_score_15"), F.lit(0.25).alias("centrality_score_3"), F.array(F.lit("centroid_k5")).alias("article_centroid_tags")
    )
    names = ("centrality_score_15", "centrality_score_3", "article_centroid_tags")
    store.write_back(spark, path, full, version=1)
    part = rows.where("id = 'a'").select(day, "id", F.lit(0.75).alias("centrality_score_15"))
    store.write_back(spark, path, part, version=2)
    expected = {"a": (0.75, 0.25, ["centroid_k5"]), "b": (0.5, 0.25, ["centroid_k5"]), "c": (None, None, None)}
    assert result_of(spark, path, *names) == expected
    # a late replay of the first version changes nothing
    store.write_back(spark, path, full, version=1)
    assert result_of(spark, path, *names) == expected
    # a null that is written sets the column to null
    none = rows.where("id = 'b'").select(day, "id", F.lit(None).cast("double").alias("centrality_score_3"))
    store.write_back(spark, path, none, version=3)
    expected["b"] = (0.5, None, ["centroid_k5"])
    assert result_of(spark, path, *names) == expected
    assert store.compact_results(spark, path) == 2 and store.compact_results(spark, path) == 0
    assert result_of(spark, path, *names) == expected
    store.write_back(spark, path, part.withColumn("centrality_score_15", F.lit(0.125)), version=4)
    expected["a"] = (0.125, 0.25, ["centroid_k5"])
    assert result_of(spark, path, *names) == expected
    assert store.compact_results(spark, path) == 1
    assert result_of(spark, path, *names) == expected


def test_random_order_is_fixed_and_even(spark, tmp_path):
    rows = spark.createDataFrame([(f"a.com/{i}",) for i in range(103)] + [("a.com/1",)] * 20, "url string")
    dealt = links.ordered_parts(rows.repartition(5), 8, seed=3).collect()
    assert sorted(r.position for r in dealt) == list(range(123))
    sizes = [sum(r.part == p for r in dealt) for p in range(8)]
    assert max(sizes) - min(sizes) <= 1 and all(r.part == r.position * 8 // 123 for r in dealt)
    order = [r.url for r in sorted(dealt, key=lambda r: r.position)]
    again = links.ordered_parts(rows.repartition(3), 2, seed=3).orderBy("position").collect()
    assert [r.url for r in again] == order != sorted(order)
    assert [r.url for r in links.ordered_parts(rows, 8, seed=4).orderBy("position").collect()] != order
    links.write_ordered_parts(rows, str(tmp_path / "parts"), 4, seed=3)
    back = [r.url for p in range(4) for r in spark.read.csv(str(tmp_path / f"parts/part={p}"), header=True).collect()]
    assert back == order
    assert links.ordered_parts(rows.limit(0), 4, seed=1).count() == 0


def test_rejected_rows_are_kept_once(spark, tmp_path):
    landing, table = str(tmp_path / "landing"), str(tmp_path / "table")
    rows = parsed(spark, [("a.com/x", "first", "en", 1), ("a.com/y", "german", "de", 2), ("a.com/z", None, "en", 3)])
    rows.write.parquet(landing)
    for state in ("one", "two"):  # a lost checkpoint replays the batch
        stream = loops.read_landing(spark, landing, rows.schema)
        loops.stream_ingest(stream, table, str(tmp_path / state), ["en"], "2024-01-05 00:00:00", ["order_key"]).awaitTermination()
    kept = {(r.normalized_url, r.reason, r.batch) for r in loops.read_rejected(spark, table).collect()}
    assert kept == {("https://a.com/y", "language", 0), ("https://a.com/z", "incomplete", 0)}
    assert loops.read_rejected(spark, table).count() == 2 and store.read_articles(spark, table).count() == 1


def test_late_rows_are_counted(spark, tmp_path):
    landing, log, state = (str(tmp_path / x) for x in ("landing", "log", "state"))

    def land(*days):
        rows = spark.createDataFrame([(f"{d} 12:00:00", "k") for d in days], "ts string, kind string")
        rows.select(F.col("ts").cast("timestamp").alias("ts"), "kind").coalesce(1).write.mode("append").parquet(landing)
        stream = loops.read_landing(spark, landing, rows.select(F.col("ts").cast("timestamp"), "kind").schema)
        loops.stream_counts(stream, "ts", "kind", log, state).awaitTermination()

    def counts():
        return {str(r.day): r.n for r in loops.latest_counts(spark, log, "kind").collect()}

    land("2024-03-01", "2024-03-01", "2024-01-20")
    land("2024-01-20", "2024-03-02")
    assert counts() == {"2024-03-01": 2, "2024-01-20": 2, "2024-03-02": 1}
    assert loops.fold_counts(spark, log, "kind") == 1 and counts()["2024-01-20"] == 2
    land("2024-01-20", "2023-06-01")
    assert counts() == {"2024-03-01": 2, "2024-01-20": 3, "2024-03-02": 1, "2023-06-01": 1}


def test_link_addresses(spark):
    html = """<link rel="stylesheet" href="/s.css"><a href="next.html">n</a><a class=x href='/q'>q</a><a href=../up?a=1&amp;b=2>u</a>
    <a href="#top">t</a><a href="mailto:x@a.com">m</a><a href="./here">h</a><a href="?p=2">p</a><A HREF="//a.com/abs">z</A>"""
    pages = spark.createDataFrame([("https://a.com/d/e/p.html?x=1", html), ("https://a.com", "<a href='x'>x</a>")], "url string, html string")
    found = {(r["url"][-3:], r["link"]) for r in links.page_links(pages).collect()}
    deep = {"d/e/next.html", "q", "d/up?a=1&b=2", "d/e/here", "d/e/p.html?p=2", "abs"}
    assert found == {("x=1", f"https://a.com/{x}") for x in deep} | {("com", "https://a.com/x")}


def test_dedup_moves_neither_side_of_the_store(spark):
    kept = dedup.dedup_new(
        spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "normalized_url string, order_key int"),
        spark.range(100_000).select(F.concat(F.lit("a"), F.col("id")).alias("normalized_url")).union(spark.createDataFrame([("b",)], "normalized_url string")),
        ["order_key"],
    )
    assert [(r.normalized_url, r.order_key) for r in kept.collect()] == [("a", 1)]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftSemi, BuildRight" in plan


def test_source_names_reach_the_table(spark):
    sources = spark.createDataFrame([("Site A", "a.com")], "source_name string, normalized_domain string")
    batch = parsed(spark, [("a.com/x", "first", "en", 1), ("b.com/y", "second", "en", 2)])
    nothing = build_articles(batch, "2024-01-05 00:00:00").where("false")
    accepted, _ = ingest(batch, nothing, ["en"], "2024-01-05 00:00:00", ["order_key"], sources)
    assert {r["normalized_domain"]: r["source_name"] for r in accepted.collect()} == {"a.com": "Site A", "b.com": None}


def test_build_articles_beginning(spark):
    long_text = " ".join(str(i) for i in range(150))
    page = parsed(spark, [("a.com/x", "t", "en", 1)]).withColumn("text", F.lit(long_text))
    row = build_articles(page, "2024-01-05 00:00:00").first()
    assert row["article_text_beginning"].split(" ")[-1] == "99"
    assert (row["id"], row["normalized_domain"]) == ("a_com_x", "a.com")


def test_landed_pages_become_articles(spark, sf_dir, tmp_path):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("url", "html").limit(12)
    pages.write.parquet(str(tmp_path / "landing"))
    sources = links.url_domain(F.col("url")).alias("normalized_domain")
    named = pages.select(sources).distinct().withColumn("source_name", F.upper("normalized_domain"))
    landing = loops.read_landing(spark, str(tmp_path / "landing"), pages.schema)
    table = str(tmp_path / "table")
    loops.stream_pages(landing, table, str(tmp_path / "state"), ["en", "de", "fr", "es"], "2024-01-05 00:00:00", sources=named).awaitTermination()
    rows = store.read_articles(spark, table).collect()
    assert rows and all(r["source_name"] == r["normalized_domain"].upper() and r["article_text"] for r in rows)


def test_steps_of_any_number_are_resolved(spark):
    """Against the resolution of the standard library, with more steps than names and steps at the end."""
    paths = ["/a/b/../c", "/a/./b/.", "/a/b/..", "/..", "/../../x", "/a//../b", "/.hidden/..x/...", "/a?q=/../b", "/a/../b#/./c", "", "/"]
    paths += ["/" + "n/" * 40 + "../" * k + "end" for k in (1, 9, 39, 40, 60)]
    rows = spark.createDataFrame([(f"https://site.org{p}",) for p in paths] + [(None,)], "url string")
    got = {r["url"]: r["link"] for r in rows.select("url", links.without_steps(F.col("url")).alias("link")).collect()}
    assert got.pop(None) is None
    assert got == {url: urljoin("https://site.org/", url[len("https://site.org") :] or "https://site.org") for url in got}
