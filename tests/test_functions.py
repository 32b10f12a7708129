"""Every cleaning step on the cases its rules were written for."""

from datetime import date

from pyspark.sql import functions as F

from vacansight import vocab
from vacansight.functions import display, education, parsing, places, sections, skills, text
from vacansight.session import unfolded


def test_missing_values(values):
    assert values(text.present, [None, "", "not found", ",", "- -", "é", "a", "7"]) == [None] * 6 + ["a", "7"]


def test_canonical_form(values):
    assert values(text.canonical, ["\tNorthwind  \u00a0 Mills\r\n", "x   Y", "x y", None]) == ["northwind mills", "x y", "x y", None]


def test_strip_takes_every_white_space(values):
    assert values(text.strip, ["\u00a0 a b \t\n", "\x1fx", "", None]) == ["a b", "x", "", None]


def test_fingerprint(spark):
    rows = [
        ("Ostrava Optics", "Lens Grinder", "Nagpur", "1 - 3 years"),
        ("ostrava\tOPTICS ", " LENS grinder", "nagpur  ", "1 - 3 YEARS"),
        ("Ostrava Optics", "Lens Grinder", "Nagpur", "3 - 1 years"),
        (None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "c string, t string, l string, e string")
    a, b, c, d = [r[0] for r in df.select(text.fingerprint(F.col("c"), F.col("t"), F.col("l"), F.col("e"))).collect()]
    assert a == b != c and len(d) == 64


def test_description_hash(values):
    a, b, none, empty = values(text.description_hash, ["We mend\n\nclocks", "WE mend clocks ", None, ""])
    assert a == b and none is None and empty is None


def test_initcap_runs(values):
    assert values(text.initcap_runs, ["j2ee", "ci/cd", "hELLO wORLD-2x", "", None]) == ["J2ee", "Ci/Cd", "Hello World-2x", "", None]


def test_ranges(values):
    inputs = ["11 - 14 years", "8+ years", "on request", None, "7.5-9.25 Lacs P.A.", "120,000 - 98,000"]
    assert values(lambda c: parsing.range_min(c).cast("double"), inputs) == [11, 8, None, None, 7.5, 0]
    assert values(lambda c: parsing.range_max(c).cast("double"), inputs) == [14, None, None, None, 9.25, 98]


def test_years_round_half_up(values):
    assert values(parsing.to_years, ["2.5", "3.5", "2.4", "99999999999999", None]) == [3, 4, 2, None, None]


def test_years_in_text(values):
    inputs = ["9-12 years of weaving", "6 to 8 yrs", "we ask for 13+ years", "minimum 1 years", "at least 10 years", "8 years", "no years", None]
    got = values(parsing.years_in_text, inputs)
    assert [(r["min"], r["max"]) for r in got] == [(9, 12), (6, 8), (13, None), (1, None), (10, None)] + [(None, None)] * 3


def test_employment_and_contract(values):
    inputs = ["permanent , full time", "by the tide", "Contractual, PART-TIME", None]
    assert values(parsing.employment_type, inputs) == ["Full Time", None, "Part Time", None]
    assert values(parsing.contract_type, inputs) == ["Permanent", None, "Contract", None]


def test_working_type(values):
    inputs = [None, "at the mill", "HYBRID, two days", "remote within Goa", "either remote or hybrid"]
    assert values(parsing.working_type, inputs) == ["On-site", "On-site", "Hybrid", "Remote", "Hybrid"]


def test_seniority(values):
    inputs = ["Glass Blower", None, "senior glass blower", "Kiln Manager", "Junior Potter", "Trainee Weaver"]
    assert values(lambda c: parsing.first_phrase(c, vocab.SENIORITY_PATTERNS, None), inputs) == [
        None, None, "Senior", "Manager/Leadership", "Junior", "Intern/Trainee",
    ]


def test_role_family(values):
    inputs = ["Lighthouse Keeper", None, "Data Scientist for tides", "Harbour Java Developer", "Sluice Consultant"]
    assert values(lambda c: parsing.first_phrase(c, vocab.ROLE_PATTERNS, "Other"), inputs) == [
        "Other", "Other", "Data Scientist", "Backend Developer", "Consultant",
    ]


def test_posted_date(values):
    inputs = ["today!", "posted just now", "22 hours ago", "17 days ago", "1 day ago", "4 months ago", "60+ days ago", "when it rained", "", None]
    today = date(2023, 11, 20)
    got = values(lambda c: parsing.posted_date(c, F.lit(today)), inputs)
    assert got == [today, today, today, date(2023, 11, 3), date(2023, 11, 19), date(2023, 7, 23), None, None, None, None]


def test_counts(values):
    assert values(parsing.suffixed_count, ["7.3K opinions", "2.5M", "1206", "", None, "--"]) == [7300, 2500000, 1206, None, None, None]
    got = values(parsing.applicants, ["31 Applicants", "250+ Applicants", "Less than 25 Applicants", "nobody yet", "", None])
    assert [(r["count"], r["qualifier"]) for r in got] == [(31, None), (250, "at_least"), (25, "less_than")] + [(None, None)] * 3


def _place(spark, inputs, cities):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, loc string")
    dim = spark.createDataFrame(cities, "city_id int, city_name string, state string")
    rows = sorted(places.resolve_locations(df, "loc", dim).collect(), key=lambda r: r["i"])
    return [(r["city_ids"], r["unmapped_locations"]) for r in rows]


def test_locations(spark):
    cities = [(4, "Mumbai", "Maharashtra"), (9, "Bengaluru", "Karnataka")]
    inputs = [
        "Bangalore, Mumbai", "Mumbai, Port Nowhere", None, "Mumbai( Sewri )", "India, Remote", "bangalore, Bengaluru", "Old Mill, Mumbai",
    ]
    assert _place(spark, inputs, cities) == [
        ([4, 9], []), ([4], ["Port Nowhere"]), ([], []), ([4], []), ([], []), ([9], []), ([4], ["Old Mill"]),
    ]


def test_merged_skills(spark):
    rows = [(["scala", "GCP"], ["Scala", "Redis"], ["SCALA", "kotlin"]), (None, None, None), (["", None, "loom/warp knots"], [], [])]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>, p array<string>")
    merged = df.withColumn("s", skills.merge_skills(F.col("a"), F.col("b")))
    got = merged.select("s", skills.preferred_skills(F.col("s"), F.col("p"))).collect()
    assert [tuple(r) for r in got] == [(["GCP", "Redis", "Scala"], ["Scala"]), ([], []), (["Loom/Warp Knots"], [])]


def test_tags_and_mined_names_stay_apart(values):
    assert values(skills.normalise_skill, ["elt", "nodejs", "Fast API", "power bi"]) == ["ELT", "Node.js", "FastAPI", "Power BI"]


def test_category(values):
    assert values(skills.skill_category, ["Kotlin", "Bobbin Lace"]) == ["Languages", None]


def _mine(spark, inputs, vocabulary):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, t string")
    return [r["found"] for r in sorted(skills.mine_terms(df, "t", vocabulary, "found").collect(), key=lambda r: r["i"])]


def test_skill_mining(spark):
    inputs = [
        "The loom is driven by Rust, Redis and Terraform.", "", None, "Kotlin? kotlin; KOTLIN.",
        "rusty redistribution of jenkinsen", "cpp / .NET (core), Angular 9, gitlab and anet", "csharp, (vue.js) and CI CD",
    ]
    assert _mine(spark, inputs, vocab.SKILL_PATTERNS) == [
        ["Rust", "Redis", "Terraform"], [], [], ["Kotlin"], [],
        ["C++", "Angular", ".NET", ".NET Core", "GitLab"], ["C#", "Vue", "CI/CD"],
    ]


def test_mining_finds_what_the_pattern_alone_finds(spark, sf):
    """The cheap substring test never hides a match."""
    import re

    sentences = [f"x {p} y" for many in vocab.SKILL_PATTERNS.values() for p in (re.sub(r"\\d\+\\\+\?", "15+", m).replace("\\", "") for m in many)]
    found = _mine(spark, sentences, vocab.SKILL_PATTERNS)
    for sentence, got in zip(sentences, found):
        want = [
            name for name, many in vocab.SKILL_PATTERNS.items()
            if any(re.search(rf"(?<![a-zA-Z0-9])(?:{m})(?![a-zA-Z0-9])", sentence, re.I) for m in many)
        ]
        assert got == want and want, sentence


def test_certifications(spark):
    inputs = ["A CISSP or an ITIL paper helps at the mill.", "", None, "Five looms, no papers asked."]
    assert _mine(spark, inputs, vocab.CERTIFICATION_PATTERNS) == [["CISSP", "ITIL"], [], [], []]


def test_every_certification_is_found_as_a_word_and_missed_within_one(spark):
    for written, found in (("Holds {} since May.", True), ("Holds x{}y since May.", False)):
        many = [(name, p.replace("\\", "")) for name, patterns in vocab.CERTIFICATION_PATTERNS.items() for p in patterns]
        got = _mine(spark, [written.format(p.upper()) for _, p in many], vocab.CERTIFICATION_PATTERNS)
        assert [name in g for (name, _), g in zip(many, got)] == [found] * len(many)


def test_alternatives(spark):
    first, second = vocab.ALTERNATIVE_GROUPS[:2]
    df = spark.createDataFrame([([first[1], second[0], first[0], second[1], "Loom"],), ([second[0], "Loom"],), ([],)], "s array<string>")
    got = [r[0] for r in df.select(skills.group_alternatives(F.col("s"))).collect()]
    assert got == [[f"{first[1]}/{first[0]}", f"{second[0]}/{second[1]}", "Loom"], [second[0], "Loom"], []]


def _degrees(spark, block):
    df = spark.createDataFrame([(block,)], "e map<string,string>")
    rows = df.select(education.degree_breakdown(F.col("e")).alias("d")).first()["d"]
    return [(r["degree"], r["level"], r["specializations"]) for r in rows]


def test_degree_breakdown(spark):
    cases = {
        "": [],
        "Any Graduate": [("Any Graduate", "UG", [])],
        "B.Sc in Weaving": [("B.Sc", "UG", ["Weaving"])],
        "B.Tech / B.E. in Dyes": [("B.Tech", "UG", ["Dyes"]), ("B.E.", "UG", ["Dyes"])],
        "B.Sc in Looms, B.C.A. in Threads, Knots": [("B.Sc", "UG", ["Looms"]), ("B.C.A.", "UG", ["Threads", "Knots"])],
        "B.A - Bachelor of Arts in Lace And Felt (Hand)": [("B.A", "UG", ["Lace and Felt (Hand)"])],
        "B.Sc in Information Technology (IT), Any Graduate": [("B.Sc", "UG", ["Information Technology"]), ("Any Graduate", "UG", [])],
        "M.Tech in Wool, MCA in Silk, Jute": [("M.Tech", "PG", ["Wool"]), ("MCA", "PG", ["Silk", "Jute"])],
        "Ph.D/Doctorate in Sails": [("Ph.D", "Doctorate", ["Sails"]), ("Doctorate", "Doctorate", ["Sails"])],
        "LLB - Bachelor of Laws in Guilds": [("LLB", "UG", ["Guilds"])],
        "CA in CA": [("CA", "PG", ["CA"])],
    }
    for wording, want in cases.items():
        assert _degrees(spark, {" Diploma ": wording}) == want, wording


def test_degrees_without_a_level_are_dropped_and_levels_combine(spark):
    assert _degrees(spark, {" ": "Guild Papers"}) == []
    assert _degrees(spark, {" ": "Guild Papers, MCA in Yarn"}) == [("MCA", "PG", ["Yarn"])]
    assert _degrees(spark, {"UG": "Any Graduate", "Post Graduate": "CMA", "PhD": None}) == [("Any Graduate", "UG", []), ("CMA", "PG", [])]
    assert _degrees(spark, None) == []


def test_qualification_levels(spark):
    df = spark.createDataFrame([({"Under Graduate": " Any ", "x": "", "PhD": "Y", " ": "Z"},), (None,)], "e map<string,string>")
    got = [[tuple(q) for q in r[0]] for r in df.select(education.qualification_levels(F.col("e"))).collect()]
    assert got == [[("UG", "Any"), ("Doctorate", "Y")], []]


def test_sections(values):
    duty, need = vocab.RESPONSIBILITY_HEADINGS[0].title(), vocab.REQUIREMENT_HEADINGS[0].title()
    full = f"A mill by the river.\r\n{duty}:\n oil the looms, daily\n\n and sweep, too\nOur Mill\nnot kept 1.\n{need}\nsteady hands,\n{need}\ngood eyes,"
    got = values(sections.description_sections, [full, "one line, no heading", "", None])
    assert got[0].asDict() == {"responsibilities": "oil the looms, daily\nand sweep, too", "requirements": "steady hands,\ngood eyes,"}
    assert all(g is None or (g["responsibilities"], g["requirements"]) == (None, None) for g in got[1:])


def test_display(spark):
    df = spark.createDataFrame([(5, 8, 12.5, 20.0, 100, "at_least"), (None, None, None, None, None, None), (5, None, 3.0, None, 7, "less_than")],
                               "a int, b int, c double, d double, n int, q string")
    got = df.select(
        display.experience_text(F.col("a"), F.col("b")), display.salary_text(F.col("c"), F.col("d")),
        display.applicants_text(F.col("n"), F.col("q")),
    ).collect()
    assert [tuple(r) for r in got] == [
        ("5-8 yrs", "12.5-20 LPA", "100+"), ("Not stated", "Not disclosed", "—"), ("5-nan yrs", "3-nan LPA", "<7"),
    ]


def test_skills_text(spark):
    df = spark.createDataFrame([(list("abcdefgh"),), (["a"],), ([],)], "s array<string>")
    assert [r[0] for r in df.select(display.skills_text(F.col("s"))).collect()] == ["a, b, c, d, e, f +2 more", "a", ""]


def test_unfolded_keeps_all_elements(spark):
    df = spark.createDataFrame([(1, [1, 2]), (2, []), (3, None)], "i int, a array<int>")
    assert sorted(tuple(r) for r in unfolded(df, F.transform("a", lambda x: x * 10), "x", "i").collect()) == [(1, 10), (1, 20)]


def test_parts_and_degrees_trim_every_white_space_whatever_else_the_text_has(spark, values):
    texts = [" Pune , Goa,,", "\u2003Pune\u00a0,\tGoa ", "Zürich , Goa", "", None, "a b ,  c"]
    want = [["Pune", "Goa", "", ""], ["Pune", "Goa"], ["Zürich", "Goa"], [""], None, ["a b", "c"]]
    assert values(text.list_parts, texts) == want
    tags = spark.createDataFrame([(0, [" K8S ", None, "", " "]), (1, ["\u2003k8s\t", "my tool", "\u00a0"]), (2, None)], "i int, t array<string>")
    got = [r["s"] for r in tags.orderBy("i").select(skills.normalise_skills(F.col("t")).alias("s")).collect()]
    assert got == [["Kubernetes"], ["Kubernetes", "My Tool"], []]
    blocks = [(0, {"ug": " B.Sc in Dyes And Ink , Salt"}), (1, {"\u2003ug\t": " B.Sc in Dyes And Ink\t, Salt"}), (2, {"Own": "Odd / Other in X, B.ScX"}), (3, None)]
    df = spark.createDataFrame(blocks, "i int, e map<string,string>").orderBy("i").select(education.degree_breakdown(F.col("e")).alias("d"))
    dyes = [("B.Sc", "UG", ["Dyes and Ink", "Salt"])]
    own = [(name, "Own", ["X", "B.ScX"]) for name in ("Odd", "Other")]
    assert [[tuple(d) for d in r["d"]] for r in df.collect()] == [dyes, dyes, own, []]


def test_long_lookups_go_by_the_number_of_bytes(spark, values):
    """Before, every key of the map was compared with every text."""
    names = {f"{'é' * (i % 7)}{i}": str(i) for i in range(200)}
    assert values(lambda c: text.look_up(names, c), [*names, "", None, "x" * 300]) == [*names.values(), None, None, None]
    plan = spark.range(1).select(text.look_up(names, F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert "octet_length" in plan
