"""Named behaviours on hand fixtures."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quern.functions.html_clean import clean, links
from quern.functions.text import wilson
from quern.operators import frontier, scoring, sessions, stats
from quern.sources import config


def test_clean_lists_headings_tables_links():
    assert clean("<ul><li>Dogs</li><li>Cats</li></ul>") == "- Dogs\n- Cats"
    assert clean("<h1>Main title</h1><h2>Subtitle</h2>") == "# Main title\n## Subtitle"
    assert clean("<table><tr><th>Species</th><th>Accepted</th></tr><tr><td>Dogs</td><td>Yes</td></tr></table>") == "Species | Accepted\nDogs | Yes"
    assert clean('<p>Contact <a href="mailto:x@y.z">us</a></p>') == "Contact\nus (mailto:x@y.z)"
    assert clean('<a href="/x"></a>') == "(/x)"
    assert clean("<p>a <b>b</b> c</p>") == "a\nb\nc"
    assert clean('<table><tr><td>Call <a href="/t">us</a></td></tr></table>') == "Callus (/t)"
    assert clean("<p>a</p><p>a</p>", deduplicate=True) == "a"
    assert clean("<nav>x</nav><p>y</p>", ("nav",)) == "y"


def test_links_are_sorted_unique_and_http():
    page = '<a href="/b"></a><a href="/a"></a><a href="/a"></a><a href="mailto:x"></a><a href="#y"></a><a href=""></a><a href="tel:1"></a>'
    assert links(page, "http://example.com/page") == ["http://example.com/a", "http://example.com/b"]


def test_greedy_match_ties_prefer_higher_indices():
    assert scoring.greedy_pairs(["A"], ["A", "A"]) == [(0, 1, 1.0)]
    assert scoring.greedy_pairs([""], [""]) == [(0, 0, 1.0)]
    assert scoring.greedy_pairs(["abc"], ["xyz"]) == [(0, None, 0.0)]


def test_greedy_match_equals_all_pairs_and_scores_names_once(monkeypatch):
    import difflib
    import random

    def all_pairs(gold, extracted, least):
        clean = [[(x or "").strip().lower() for x in names] for names in (gold, extracted)]
        ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
        used, taken = {}, set()
        for s, i, j in sorted(((ratio(a, b), i, j) for i, a in enumerate(clean[0]) for j, b in enumerate(clean[1])), reverse=True):
            if s >= least and i not in used and j not in taken:
                used[i] = j, s
                taken.add(j)
        return [(i, *used.get(i, (None, 0.0))) for i in range(len(gold))]

    r = random.Random(5)
    name = lambda: None if r.random() < 0.05 else "".join(r.choice("abC ") for _ in range(r.randint(0, 6)))
    for kept in (1, 2, 256):
        monkeypatch.setattr(scoring, "KEPT_NAMES", kept, raising=False)
        for _ in range(150):
            gold, extracted, least = [name() for _ in range(r.randint(0, 20))], [name() for _ in range(r.randint(0, 20))], r.choice([0, 0.3, 1.0])
            assert scoring.greedy_pairs(gold, extracted, least) == all_pairs(gold, extracted, least)
    # Long names too, with what difflib takes for junk in 200 characters and more.
    long = ["ab" * 300, "ab" * 99 + "c", "ab" * 100, "x" * 250]
    assert scoring.greedy_pairs(long, long[::-1]) == all_pairs(long, long[::-1], 0.3)
    # 3,000 records of 3 names a side: 9 scores, and not 9 million.
    calls, matcher = [], difflib.SequenceMatcher
    monkeypatch.setattr(difflib, "SequenceMatcher", lambda *a: calls.append(a) or len(calls) > 9 and pytest.fail("scores records") or matcher(*a))
    got = scoring.greedy_pairs(["red bolt", "old plate", "hot ring"] * 1000, ["bolt", "plate", "ring"] * 1000)
    assert got[-1] == (2999, 2999, pytest.approx(2 / 3)) and len({j for _, j, _ in got}) == 3000


def test_wilson(spark):
    df = spark.createDataFrame([(5, 5), (0, 13), (28, 35), (0, 0)], "h long, n long")
    low, high = wilson(df["h"], df["n"])
    got = [tuple(r) for r in df.select(low, high).collect()]
    for have, want in zip(got, [(0.565509, 1.0), (0.0, 0.228102), (0.641081, 0.899577), (0.0, 0.0)]):
        assert have == pytest.approx(want, abs=1e-6)


def test_session_rounds(spark):
    log = spark.createDataFrame([(0, "round_start", 1, 101.0, 3), (1, "round_end", 1, 110.0, None), (2, "round_start", 2, 113.0, 2)], "seq int, event string, round long, monotonic_time double, queued long")
    crawls = spark.createDataFrame(list(enumerate([102.0, 105.0, 106.0, 110.0, 0.0, 113.0, 500.0])), "crawl_id long, crawl_time double")
    got = {r["crawl_id"]: r["round"] for r in sessions.assign_rounds(crawls, sessions.rounds_of_log(log)).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: None, 4: None, 5: 2, 6: 2}


def test_politeness(spark):
    df = spark.createDataFrame([("d", 0), ("d", 1), ("d", 12)], "domain string, arrival long")
    assert sorted(r["start"] for r in frontier.polite_starts(df, 5).collect()) == [0, 5, 12]


def test_run_loop_stop_rules():
    clock = lambda: 0.0
    none = lambda _: []
    assert frontier.run_loop([], [], frontier.Limits(), none, none, clock) == ("exhausted", 0, 0)
    assert frontier.run_loop([], list("abcdef"), frontier.Limits(discovery_batches=2, batch_size=1), none, none, clock) == ("reached max_discovery_batches", 0, 2)
    assert frontier.run_loop(["a"], [], frontier.Limits(rounds=2), lambda x: [x[0] + "b"], none, clock) == ("reached max_rounds", 2, 0)


def test_reachable_goes_all_the_way_unless_limited(spark):
    edges = spark.range(103).selectExpr("id AS src", "id + 1 AS dst")
    roots = spark.sql("SELECT 0L AS url")
    save = lambda df, _: spark.sql("SELECT * FROM VALUES " + ", ".join(f"({u}L, {d})" for u, d in df.collect()) + " AS t(url, depth)")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert {(r["url"], r["depth"]) for r in frontier.reachable(edges, roots, save).collect()} == {(i, i) for i in range(104)}
        assert {r["url"] for r in frontier.reachable(edges, roots, save, most=3).collect()} == {0, 1, 2, 3}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)


def test_config():
    text = "a = 1;\n# note\nname = \"x; y\";\na = 2; b = 3;\n"
    assert config.read_entries(text) == {"a": "2", "name": "x; y"}
    with pytest.raises(config.ConfigError):
        config.parse_flag("true", "relevancy")
    assert config.is_true("True") and not config.is_true("true") and not config.is_true(None)
    schema = config.record_schema({"e-mail": "string", "kinds": "list[animal]"}, {"animal": ["dog", "cat"]}, as_list=True)
    assert config.field_names(schema) == ["e-mail", "kinds"]
    assert config.spark_type(schema).simpleString() == "array<struct<e-mail:string,kinds:array<string>>>"


CONFIG = """
politeness = 2;
skip_tags = nav, footer;
redo_all_fetches = False;
redo_failed_fetches = True;
category_prompt = "Which one; choose";
category_max_tokens = 9;
category_context = 128;
category_model_path = m;
define kind = dog | cat;
fields = {"name": "string", "kind": "kind"};
categories = HOME|FARM|OTHER;
relevancy[HOME] = True;
prompt[HOME] = read;
model_path[HOME] = m;
max_tokens[HOME] = 9;
context[HOME] = 64;
check_linked_urls[HOME] = True;
is_list_category[HOME] = True;
relevancy[FARM] = True;
prompt[FARM] = read;
model_path[FARM] = m;
max_tokens[FARM] = 9;
context[FARM] = 64;
check_linked_urls[FARM] = False;
fields[FARM] = {"cows": "integer"};
relevancy[OTHER] = False;
"""


def test_compiled_config_and_analysis(spark):
    from quern.operators import analyze

    c = config.compile_config(CONFIG)
    assert [x.name for x in c.categories] == ["HOME", "FARM", "OTHER"] and c.batch_size == 5 and c.redo_failed and c.skip_tags == ["nav", "footer"]
    assert config.entry_columns(c.categories) == ["name", "kind", "cows"] and c.category_prompt == "Which one; choose"
    with pytest.raises(config.CategoryNotFoundError):
        c.category("NONE")
    for broken in (CONFIG.replace("politeness = 2;", ""), CONFIG.replace("relevancy[FARM] = True", "relevancy[FARM] = yes"), CONFIG.replace("= 9", "= nine")):
        with pytest.raises(config.ConfigError):
            config.compile_config(broken)
    pages = spark.createDataFrame([(1, "a home\nname: Rex\nkind: dog"), (2, "some farm"), (3, ""), (4, None), (5, "else")], "id long, text string")
    found = analyze.categorized(pages, F.col("text"), c)
    assert {r["id"]: r["category"] for r in found.collect()} == {1: "HOME", 2: "FARM", 3: None, 4: None, 5: "OTHER"}
    gated = analyze.with_dimension(found, spark, c)
    assert {r["id"] for r in gated.where("is_relevant").collect()} == {1, 2} and {r["id"] for r in gated.where("process_links").collect()} == {1}
    out = analyze.extracted(gated.where("category = 'HOME'"), F.col("text"), F.array(F.lit("http://x")), c.category("HOME")).first()
    assert out["records"][0]["name"] == "Rex" and out["found_links"] == ["http://x"] and out["extract_error"] is None


def test_failures_stay_with_their_item(spark):
    from quern.operators import analyze
    from quern.sources import search, web

    class Failing:
        def complete(self, *a, **k):
            raise OSError("down")

    failing = lambda path, context: Failing()
    pages = spark.createDataFrame([(1, "a home")], "id long, text string")
    row = analyze.categorized(pages, F.col("text"), config.compile_config(CONFIG), failing).first()
    assert row["category"] is None and row["category_error"] == "OSError: down"

    def get(url):
        if url == "bad":
            raise ValueError("no")
        return "<p>" if url == "good" else None

    rows = {r["url"]: (r["html"], r["fetch_success"], r["error"]) for r in web.fetch(spark.createDataFrame([("good",), ("bad",), ("good",), ("none",)], "url string"), get).collect()}
    assert rows == {"good": ("<p>", True, None), "bad": ("", False, "ValueError: no"), "none": ("", False, None)}

    provider = search.JsonProvider(lambda q: {"r": {"items": [{"u": q + "1"}, 7, {"u": ""}, {"u": q + "2"}]}} if q != "x" else 1 / 0, "r.items", "u")
    found = search.discover(spark.createDataFrame([("a",), ("x",)], "query string"), provider, 4).collect()
    assert {(r["query"], r["url"]) for r in found} == {("a", "a1"), ("a", "a2"), ("x", None)}


def test_search_paging():
    from quern.sources.search import PagedProvider

    calls = []

    def fetch(q, start, n):
        calls.append((start, n))
        return [{"link": f"{q}{i}"} if i % 5 else {} for i in range(start, min(start + n, 24))]

    assert len(PagedProvider(fetch).search("q", 30)) == 19 and calls == [(1, 10), (11, 10), (21, 10)]
    assert PagedProvider(fetch).search("q", 2) == ["q1", "q2"] and PagedProvider(lambda *a: []).search("q", 5) == []


def test_json_responses(spark):
    from quern.sources.search import response_urls

    rows = ['{"a": {"b": [{"u": "1"}, {"v": 2}, 3, {"u": "4"}, {"u": "5"}]}}', '{"a": {"b": {"u": "1"}}}', '{"a": 1}', "not json", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, r string")
    got = {r["i"]: r["u"] for r in df.select("i", response_urls(F.col("r"), "a.b", "u", 4).alias("u")).collect()}
    assert got == {0: ["1", "4"], 1: [], 2: [], 3: [], 4: []}


def test_robots(spark):
    from quern.sources import web

    robots = spark.createDataFrame([("a.example", "User-agent: *\nDisallow: /private")], "domain string, robots string")
    urls = spark.createDataFrame([("http://a.example/x",), ("http://a.example/private/y",), ("http://b.example/private",)], "url string")
    assert {r["url"]: r["allowed"] for r in web.with_permission(urls, robots, "bot").collect()} == {
        "http://a.example/x": True, "http://a.example/private/y": False, "http://b.example/private": True
    }
    last = spark.createDataFrame([("d", 1), ("d", 4), ("e", 2)], "domain string, at long")
    assert {(r["domain"], r["at"]): r["p"] for r in last.withColumn("p", web.last_request(last)).collect()} == {("d", 1): None, ("d", 4): 1, ("e", 2): None}


def test_files(spark, tmp_path):
    from quern.sources import files

    (tmp_path / "t.txt").write_text("# x\nLocation:  A B \n\n\tT in {location}\u00a0\nU\n")
    templates, places = files.read_templates(spark, str(tmp_path / "t.txt"))
    assert [r["template"] for r in templates.orderBy("t_ord").collect()] == ["T in {location}", "U"] and [r["location"] for r in places.collect()] == ["A B"]
    (tmp_path / "u.txt").write_text(" http://a \n\n http://b\n")
    assert [r["url"] for r in files.read_url_list(spark, str(tmp_path / "u.txt")).orderBy("ord").collect()] == ["http://a", "http://b"]
    files.write_csv(spark.createDataFrame([("k ", 'say "a, b"\nc'), (" ", "x"), ("m", None)], "k string, v string").coalesce(1), str(tmp_path / "csv"))
    got = {(r["k"], r["v"]) for r in files.read_gold(spark, str(tmp_path / "csv"), ["k", "v"], "k").collect()}
    assert got == {("k", 'say "a, b"\nc'), ("m", "")}
    for name in ("20240101_000000.jsonl", "20250101_000000.jsonl"):
        (tmp_path / name).write_text("{}\n")
    assert files.latest_file(spark, f"{tmp_path}/*.jsonl").endswith("20250101_000000.jsonl") and files.latest_file(spark, f"{tmp_path}/*.none") is None


def test_deep_page():
    from quern.functions.html_clean import clean, links

    page = "<div>" * 20_000 + "deep <a href='/x'>y</a>"
    assert clean(page) == "deep\ny (/x)" and links(page, "http://h/") == ["http://h/x"]


def test_wilcoxon_exact():
    assert stats.wilcoxon_exact_p(6, 0) == pytest.approx(2 / 64)


def test_stream_dedup_and_throttle(spark, tmp_path):
    from quern.streaming import sessions as st

    src = tmp_path / "in"
    spark.createDataFrame([("d", "u1", 0.0), ("d", "u1", 0.0), ("d", "u2", 1.0), ("e", "u3", 1.0)], "domain string, url string, arrival double").coalesce(1).write.json(str(src))
    stream = spark.readStream.schema("domain string, url string, arrival double").json(str(src))
    out = st.distinct_urls(stream)
    q = out.writeStream.format("memory").queryName("urls_seen").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["url"] for r in spark.table("urls_seen").collect()) == ["u1", "u2", "u3"]
    q = st.throttle(stream, 5.0).writeStream.format("memory").queryName("starts").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["domain"], r["start"]) for r in spark.table("starts").collect()) == [("d", 0.0), ("d", 5.0), ("d", 10.0), ("e", 1.0)]


def test_seed_antijoin_goes_by_page_as_its_sql_does(spark):
    import duckdb

    from quern.plans.catalogue import ORACLES, QUERIES_RAW

    def both(pages, labels):
        values = lambda rows: ", ".join(f"({', '.join('NULL' if x is None else repr(x) for x in r)})" for r in rows)
        con = duckdb.connect()
        con.sql(f"CREATE TABLE pages AS SELECT * FROM (VALUES {values(pages)}) p(page_id, url)")
        con.sql(f"CREATE TABLE labels AS SELECT * FROM (VALUES {values(labels)}) l(doc_id, quality)")
        tables = {"pages": spark.createDataFrame(pages, "page_id long, url string"), "labels": spark.createDataFrame(labels, "doc_id long, quality int")}
        got = QUERIES_RAW["seed_antijoin"](spark, lambda name: tables[name]).collect()
        rows = lambda x: sorted((tuple(r) for r in x), key=str)
        assert rows(got) == rows(con.sql(ORACLES["seed_antijoin"]).fetchall())
        return [r.url for r in got]

    # Two pages of one URL, of which one is labelled good; a page without URL; a label of no page.
    assert sorted(both([(1, "u"), (2, "u"), (3, "v"), (4, "w"), (5, None)], [(1, 1), (1, 1), (3, 0), (9, 1)]), key=str) == [None, "u", "v", "w"]
    assert both([(1, "u"), (2, "v")], [(None, 1)]) == []
    assert both([(None, "u"), (2, "v")], [(3, 1), (None, 0)]) == ["v"]
    assert sorted(both([(None, "u"), (2, "v")], [(2, 0)])) == ["u", "v"]


def test_pages_are_answered_in_small_batches_and_their_trees_go_at_once(spark):
    import gc

    import pyarrow as pa

    from quern.functions import html_clean

    class Pages:
        """One Arrow batch of 1,000 pages, in place of a table."""

        schema = spark.createDataFrame([], "html string, url string, page_id long").schema

        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):  # noqa: N802
            page = '<ul><li><a href="/x">a</a></li></ul>'
            batch = pa.RecordBatch.from_pydict({"html": [page] * 999 + [None], "url": ["http://h/"] * 1000, "page_id": list(range(1000))})
            return list(run(iter([batch])))

    gc.collect()
    gc.disable()
    try:
        out = html_clean.page_links(Pages(), ["page_id"])
        left = sum(isinstance(x, html_clean.Element) for x in gc.get_objects())
    finally:
        gc.enable()
    assert max(b.num_rows for b in out) <= 256 and left == 0
    rows = [r for b in out for r in b.to_pylist()]
    assert rows == [{"page_id": i, "links": ["http://h/x"] if i < 999 else []} for i in range(1000)]
