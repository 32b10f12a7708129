"""Query contracts, properties and plans."""

import os
import random
import subprocess
import sys
import tempfile
from datetime import date, datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from vacansight.functions import text
from vacansight.operators import digest, distributions, health, pairs, search, trends
from vacansight.operators.filters import Filters, matching
from vacansight.plans import standins
from vacansight.session import with_dense_ids
from vacansight.sources import pages

HOT = [
    "skill_demand", "skill_demand_scoped", "role_distribution", "location_distribution_city", "skill_category_mix",
    "co_occurrence", "skill_suggestions", "skills_reference", "specializations_reference", "search_page",
    "search_skill_all", "search_everything", "posting_detail", "delta_baseline", "movers_both", "fingerprint_merge",
    "orphan_report", "cleaned_postings", "summary",
]


@pytest.mark.parametrize("name", HOT)
def test_no_nested_loops(spark, sf, name):
    plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan and "BatchEvalPython" not in plan


def test_list_query_never_reads_descriptions(spark, sf):
    t = standins.StandIns(spark, sf, skills=True, cities=True, description=True)
    plan = search.search_postings(t)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "text#" not in plan


def test_filters_reach_the_scan(spark, sf):
    t = standins.StandIns(spark, sf)
    t.postings = standins.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.col("o_orderpriority").alias("seniority_level"), F.col("o_orderstatus").alias("working_type")
    )
    plan = matching(t, Filters(seniority_level=["1-URGENT"], working_type=["O"])).select("job_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In" in plan or "EqualTo(o_orderpriority,1-URGENT)" in plan
    assert "o_totalprice" not in plan


def test_shares_add_up(spark, sf):
    t = standins.StandIns(spark, sf, skills=True, cities=True)
    for report in (
        distributions.role_distribution(t), distributions.location_distribution(t), distributions.category_mix(t),
        distributions.seniority_distribution(t),
    ):
        assert abs(report.agg(F.sum("share_pct")).first()[0] - 100) < 0.2
    assert digest.band_squares(t).agg(F.sum("squares")).first()[0] == 100


def test_pairs_are_symmetric_and_match_brute_force(spark, sf):
    t = standins.StandIns(spark, sf, skills=True)
    wide = {r["skill_a"]: r["together"] for r in pairs.pair_matrix(t, 50).collect()}
    assert all(wide[b][a] == n for a, row in wide.items() for b, n in row.items())
    names = {r["skill_id"]: r["skill_name"] for r in t.skills.collect()}
    blocked = set(standins.BLOCKED)
    counts = {}
    for row in t.postings.select("skill_ids").collect():
        mine = [names[i] for i in row["skill_ids"] if names[i] not in blocked]
        for a in mine:
            for b in mine:
                if a != b:
                    counts[a, b] = counts.get((a, b), 0) + 1
    assert counts == {(a, b): n for a, row in wide.items() for b, n in row.items()}


def test_unknown_names_and_bad_arguments(spark, sf):
    t = standins.StandIns(spark, sf, skills=True)
    assert pairs.skill_suggestions(t, ["No such skill"]).count() == 0
    for call in (
        lambda: search.search_postings(t, sort_by="job_id; drop"),
        lambda: search.search_postings(t, page_size=500),
        lambda: trends.movers(None, None, comparison="weekly"),
        lambda: distributions.location_distribution(t, by="street"),
    ):
        with pytest.raises(ValueError):
            call()


def test_pages_follow_each_other(spark, sf):
    t = standins.StandIns(spark, sf, skills=True, cities=True)
    everything = [r["job_id"] for r in search.search_postings(t, None, "openings", "desc", 1, 200).collect()]
    page2 = [r["job_id"] for r in search.search_postings(t, None, "openings", "desc", 2, 30).collect()]
    assert page2 == everything[30:60]
    last = t.postings.filter(F.col("job_id") == everything[29]).first()
    after = search.search_after(t, (last["openings"], last["job_id"]), None, "openings", "desc", 30).collect()
    assert [r["job_id"] for r in after] == page2
    assert search.page_info(t, Filters(company="nobody at all")).first()["pages"] == 1


def series(spark, counts, start=date(2024, 1, 1)):
    rows = [(date.fromordinal(start.toordinal() + i), s, n) for s, many in counts.items() for i, n in enumerate(many) if n is not None]
    return spark.createDataFrame(rows, "snapshot_date date, skill string, posting_count long")


def none_blocked(spark):
    return spark.createDataFrame([], "skill string")


def test_trend_windows(spark):
    daily = series(spark, {"a": [4, 6, None, 0, 5], "b": [1] * 5})
    day = {(r["skill"], r["snapshot_date"].day): r for r in trends.delta_daily(daily, none_blocked(spark)).collect()}
    assert (day["a", 1]["change"], day["a", 2]["change"], day["a", 2]["pct_change"]) == (None, 2, 50.0)
    assert day["a", 4]["previous_count"] == 6 and day["a", 5]["pct_change"] is None
    base = {(r["skill"], r["snapshot_date"].day): r for r in trends.delta_baseline(daily, none_blocked(spark)).collect()}
    assert ("a", 1) not in base
    assert (base["a", 5]["baseline_7d"], base["a", 5]["change_vs_baseline"], base["a", 5]["pct_vs_baseline"]) == (3.3, 1.7, 50.0)


def test_movers_need_history(spark):
    short, longer = series(spark, {"a": [1]}), series(spark, {"a": [1, 5], "b": [5, 2], "c": [3, 3]})
    full = series(spark, {"a": [2] * 8 + [9], "b": [3] * 9})
    blocked = spark.createDataFrame([("c",)], "skill string")
    assert trends.movers(short, blocked).count() == 0
    assert trends.movers(longer, blocked, comparison="rolling_7d").count() == 0
    assert [(r["skill"], r["change"], r["comparison"]) for r in trends.movers(longer, blocked).collect()] == [
        ("a", 4.0, "previous_day"), ("b", -3.0, "previous_day"),
    ]
    assert [r["skill"] for r in trends.movers(longer, blocked, direction="down").collect()] == ["b"]
    assert [(r["skill"], r["change"]) for r in trends.movers(full, blocked, direction="up").collect()] == [("a", 7.0)]
    assert trends.movers(full, blocked).first()["comparison"] == "rolling_7d"


def test_snapshot_keeps_keys_already_written(spark):
    daily = spark.createDataFrame([(date(2024, 1, 1), "a", 1), (date(2024, 1, 1), "b", 2)], "snapshot_date date, skill string, posting_count long")
    fresh = spark.createDataFrame([(date(2024, 1, 1), "b", 5), (date(2024, 1, 1), "c", 1)], "snapshot_date date, skill string, posting_count long")
    got = {r["skill"]: r["posting_count"] for r in trends.upsert_counts(daily, fresh).collect()}
    assert got == {"a": 1, "b": 5, "c": 1}


def runs(spark, counts):
    rows = [(i, datetime(2024, 1, i), n, c) for i, (n, c) in enumerate(counts, 1)]
    return spark.createDataFrame(rows, "run_id long, started_at timestamp, postings_scraped int, field_found_counts map<string,int>")


def test_field_health(spark):
    log = runs(spark, [(10, {"a": 9, "b": 8, "rare": 2}), (10, {"a": 9, "b": 9}), (0, {}), (10, {"a": 8, "rare": 0})])
    got = {r["field"]: (r["current_rate"], r["historical_avg_rate"]) for r in health.field_health(log, 4).collect()}
    assert got == {"b": (0.0, 0.85)}
    assert health.field_health(log, 3).count() == 0
    assert {(r["run_id"], r["field"]) for r in health.field_health_history(log).collect()} == {(4, "b")}


def test_logged_counts_read_from_json(spark):
    df = spark.createDataFrame([('{"title": 3, "salary": 1}',), (None,)], "j string")
    assert [r[0] for r in df.select(health.found_counts(F.col("j"))).collect()] == [{"title": 3, "salary": 1}, None]


def test_fill_counts_skip_marks_and_empties(spark):
    raw = spark.createDataFrame(
        [("Dev", "not found", [], 2), ("Dev", "Acme", ["Python"], None)],
        "title string, company string, skills array<string>, openings int",
    )
    row = health.field_fill_counts(raw, raw.columns).first()
    assert row["field_found_counts"] == {"title": 2, "company": 1, "skills": 1, "openings": 1}
    assert health.field_fill_counts(raw.limit(0), raw.columns).first()["field_found_counts"] == {}


def test_dense_ids(spark):
    names = spark.range(1000).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"))
    got = with_dense_ids(names, "id", ["name"], 7).collect()
    assert [r["id"] for r in sorted(got, key=lambda r: r["name"])] == list(range(8, 1008))
    assert with_dense_ids(names.limit(0), "id", ["name"]).count() == 0


PAGE = """<html><h1 class="jd title">Data &amp; ML Engineer</h1><div class="company"><a href="/c">Acme</a></div>
<div class="experience"><span>5-8 years</span></div><div class="location">Pune</div><div class="salary">Not Disclosed</div>
<div class="work-mode">Hybrid</div><span class="rating">4.1</span><span class="reviews">50.5K Reviews</span>
<span class="badge">TOP</span><span class="badge">Best 500</span>
<a class="chip" href="#"><i class="star"></i><span>Python</span></a><a class="chip" href="#"><span>Power Bi</span></a>
<div><label>Posted:</label><span>3 days ago</span></div><div><label>Openings:</label><span>2</span></div>
<div><label>Applicants:</label><span>Less than 10</span></div><div><label>Role Category:</label><span><span>Software</span></span></div>
<div><label>Role:</label><span><a>Back End</a></span></div>
<div><label>Department:</label><span><a href="#">Engineering</a><span>,</span><a href="#">QA</a></span></div>
<section class="education"><div><label>UG:</label><span>Any Graduate</span></div><div><label>PG:</label><span></span></div></section>
<div class="description">We use Python, Power BI and Docker.</div></html>"""


def test_page_fields(spark):
    df = spark.createDataFrame([("u1", PAGE), ("u2", "<html>blocked</html>")], "url string, html string")
    rows = pages.page_fields(df, F.lit(date(2024, 5, 10))).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["title"], r["company"], r["experience"], r["working_type"]) == ("Data & ML Engineer", "Acme", "5-8 years", "Hybrid")
    assert (r["key_skills"], r["preferred_key_skills"], r["tech_in_description"]) == (["Python", "Power Bi"], ["Python"], ["Docker"])
    assert (r["posted_date"], r["openings"], r["applicant_count"], r["applicant_count_qualifier"]) == ("2024-05-07", 2, 10, "less_than")
    assert (r["role_category"], r["listed_role"], r["department"], r["industry_type"]) == ("Software", "Back End", "Engineering, QA", None)
    assert (r["company_reviews"], r["company_badges"], r["education"]) == (50500, ["TOP", "Best 500"], {"UG": "Any Graduate"})


def test_discovery(spark):
    links = spark.createDataFrame(
        [(0, "https://www.site.com/a"), (1, "https://other.org/x"), (2, "https://www.site.com/b"), (3, "https://www.site.com/a"), (4, "/rel"), (5, None)],
        "pos int, url string",
    )
    assert [tuple(r) for r in pages.discover_urls(links, "site.com", ["pos"]).collect()] == [
        ("https://www.site.com/a", 0), ("https://www.site.com/b", 2),
    ]
    assert pages.discover_urls(links, "site.com", ["pos"], limit=1).count() == 1


def test_page_text_is_whole_and_keeps_its_lines(spark):
    html = (
        '<body><script>var d = "</div>";</script><div class="description"><div><p>Key Responsibilities</p><p>Build&nbsp;Python &amp; <b>SQL</b></p></div>'
        "<!-- </div> --><div>Requirements<br>Docker &#8211; 2&#x2B; years &unknown; &amp;lt;</div></div><div>after</div></body>"
    )
    df = spark.createDataFrame([(html,), ('<div class="description">never <div>closed</div> here',), ("<p>none</p>",), (None,)], "html string")
    rules = pages.PageRules(texts={"description": pages.element("div", "description")})
    found = [r["description"] for r in pages.extract_fields(df, rules).collect()]
    assert found[0].split("\n") == ["Key Responsibilities", "Build Python & SQL", "Requirements", "Docker – 2+ years &unknown; &lt;"]
    assert found[1].split("\n") == ["never", "closed", "here"]
    assert found[2:] == [None, None]


def test_members_of_lists_are_whole_and_marked_elements_are_found_anywhere(spark):
    html = (
        '<ul><li>one<ul><li>two <b>deep</b></li></ul>tail</li><li>open <p>never<li>closed</ul></i>'
        '<A CLASS="chip big"><span>Go</span> <i class="star"></i></A><a class="chipped">no</a><br><span class=\'badge\'>x<span>y</span>z</span>'
    )
    many = "<ul>" + "".join(f"<li>m{i}</li>" for i in range(700)) + "</ul>"
    df = spark.createDataFrame([(html,), (many,), (None,), ("",), ("a < b and <",)], "html string")
    rules = pages.PageRules(lists={"items": pages.element("li"), "chips": pages.element("a", "chip"), "badges": pages.element("span", "badge")})
    found = [(r["items"], r["chips"], r["badges"]) for r in pages.extract_fields(df, rules).collect()]
    assert found[0] == (["one\ntwo deep\ntail", "two deep", "open\nnever\nclosed", "closed"], ["Go"], ["xyz"])
    assert found[1][0] == [f"m{i}" for i in range(700)]
    assert found[2:] == [([], [], [])] * 3


def test_references_are_checked_in_one_pass_of_the_fact_and_without_a_join(spark, sf):
    t = standins.StandIns(spark, sf, skills=True, cities=True, degrees=True)
    t.postings = t.postings.withColumn("preferred_skill_ids", F.when(F.col("job_id") == 7, F.array(F.lit(-5))).otherwise(F.col("preferred_skill_ids")))
    fact = t.postings.selectExpr("cast(job_id as bigint) as job_id", *[c for c in t.postings.columns if c != "job_id"])
    stored = spark.createDataFrame(fact.collect(), fact.schema)
    t.postings = stored
    report = health.orphan_report(t)
    got = {r["reference"]: r["orphans"] for r in report.collect()}
    assert len(got) == 12 and got["preferred_skill_ids"] == 1 and got["pair_degree_id"] == got["city_state"] == 0
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation [job_id") == 1 and "LeftAnti" not in plan


def test_history_of_runs_has_no_window_over_all_runs(spark, sf):
    plan = health.field_health_history(standins.runs(spark, sf), 10)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
    keyed = standins.runs(spark, sf).withColumn("feed", F.col("run_id") % 2)
    assert health.field_health_history(keyed, 3, ["feed"]).count() >= 0


def test_movers_of_skills_that_skip_days_send_few_rows(spark):
    daily = series(spark, {"a": [2] * 3 + [None] * 40 + [9], "b": [3] * 44, "c": [1, 5] + [None] * 42})
    got = {r["skill"]: (r["previous_count"], r["change"]) for r in trends.movers(daily, none_blocked(spark)).collect()}
    assert got == {"a": (2.0, 7.0), "b": (3.0, 0.0)}
    plan = trends.movers(daily, none_blocked(spark))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_pages_made_from_orders_are_cut_on_every_core(spark, sf):
    made = standins.posting_pages(spark, sf)
    assert made.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_qualifications_are_grouped_in_small_tasks(spark, sf):
    grouped = standins.qualifications(spark, sf)
    assert grouped.rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert grouped.count() == grouped.select("job_id", "level").distinct().count() > 0


ODD_HTML = [
    "", " ", "<", "a < b and <", "<!-- open", "x<!-- a --> <b>y</b><script>1", "<scripté>kept</scripté>", "<ſcript>kept</ſcript>", "<SCRIPT a=1>x</script >z",
    "a\x0b\r\n b\t\tc", "one<BR/>two <br >three<brx>four", "<div <p>> x", "<hr", " &nbsp;x\x85\x1c", "&amp;lt; &#65;&#x2B;&#0;&#xD800;&#x110000;&#12345678;&nope;&;&", "<td>1</td><th>2</th>\n\n<p>\n3 \n 4",
    "<!doctype x>t<?p?>", "İ<DİV>ſ</DİV>", "😀<i>日本</i>", "<style>a</style><template>b</template><noscript>c</noscript>d",
]


def test_text_of_a_page_is_that_of_the_columns(values):
    assert [pages.Page("<div>" + h).text(0) for h in ODD_HTML] == values(lambda c: text.strip_tags(F.concat(F.lit("<div>"), c)), ODD_HTML)


def test_pages_are_read_in_one_pass_and_not_by_array_expressions(spark):
    found = pages.page_fields(spark.createDataFrame([("u1", PAGE)], "url string, html string"), F.lit(date(2024, 5, 10)))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "aggregate(" not in plan


def test_elements_close_where_those_around_them_do(spark):
    """Against a plain stack that keeps every element, on random tags; and on one element in 20,000 others."""
    rng = random.Random(6)
    for _ in range(400):
        tags = [(rng.choice(["div", "p", "a", "br"]), rng.random() < 0.45) for _ in range(rng.randrange(40))]
        page = pages.Page("".join(f"<{'/' * shut}{name}>" for name, shut in tags))
        stack, expected = [], {}
        for i, (name, shut) in enumerate(tags):
            if name == "br":
                continue
            if not shut:
                stack.append(i)
            elif any(tags[j][0] == name for j in stack):
                while True:
                    expected[j := stack.pop()] = i
                    if tags[j][0] == name:
                        break
        assert page.close == expected | dict.fromkeys(stack, len(tags))
    deep = "<i>" * 20_000 + '<div class="description">in</div>'
    df = spark.createDataFrame([(deep,)], "html string")
    assert [r["d"] for r in pages.extract_fields(df, pages.PageRules(texts={"d": pages.element("div", "description")})).collect()] == ["in"]


def test_pages_that_are_no_utf8_are_read_with_marks(spark):
    df = spark.sql("select cast(concat(cast('<h1>a' as binary), X'FF', cast('b</h1>' as binary)) as string) as html")
    assert [r["h"] for r in pages.extract_fields(df, pages.PageRules(texts={"h": pages.element("h1")})).select("h").collect()] == ["a�b"]


def test_fields_replace_columns_of_their_name_and_keep_the_others(spark):
    df = spark.createDataFrame([(1, "old", "<h1>new</h1>", 2.5)], "page_id int, h string, body string, score double")
    found = pages.extract_fields(df, pages.PageRules(texts={"h": pages.element("h1")}, lists={"none": pages.element("li")}), "body")
    assert found.columns == ["page_id", "h", "body", "score", "none"] and [tuple(r) for r in found.collect()] == [(1, "new", "<h1>new</h1>", 2.5, [])]


def test_pages_need_no_package_on_the_executors(spark):
    code = f"""
import sys; sys.path.insert(0, {str(Path(pages.__file__).parents[2])!r})
from vacansight.session import build_session; from vacansight.sources import pages
spark = build_session("local[1]", "elsewhere")
df = spark.createDataFrame([("<h1 class='a'>found</h1>",)], "html string")
print(pages.extract_fields(df, pages.PageRules(texts={{"h": pages.element("h1", "a")}})).collect()[0]["h"])
"""
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    with tempfile.TemporaryDirectory() as elsewhere:
        run = subprocess.run([sys.executable, "-c", code], cwd=elsewhere, env=env, capture_output=True, text=True, timeout=120)
    assert run.stdout.split() == ["found"], run.stderr[-2000:]
