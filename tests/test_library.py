import uuid

import duckdb
import pytest
from pyspark.sql import functions as F

from linkwright.functions import columns as C
from linkwright.functions.similarity import lcs, token_set_ratio, token_sort_ratio
from linkwright.operators import report, search, suggest
from linkwright.operators.components import connected_components
from linkwright.operators.linkage import cluster_ids, component_clusters, greedy_clusters
from linkwright.operators.project import project
from linkwright.operators.resolve import conflicts, entities, scalar_fields, supported, values
from linkwright.operators.store import Store
from linkwright.operators.checkpoint import saved
from linkwright.operators.extract import ats_records
from linkwright.operators.validate import schema_of, validated
from linkwright.plans.catalog import ORACLES, QUERIES
from linkwright.plans.pipeline import all_records, run
from linkwright.sources.files import PROFILE_SCHEMA, read_ats_json, read_recruiter_csv

SF = "/root/testdata/sf0.001"
HEADER = "name,email,phone,current_company,title,github_url,location,notes\n"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_scalar_functions(spark):
    phones = {"+1 415 555 2671": "+14155552671", "7249381902": "+917249381902", "+91 7249381902": "+917249381902", "000-000-0000": None, "555-0001": None, "+1-555-123-0101": None}
    for raw, want in phones.items():
        assert one(spark, C.phone(F.lit(raw))) == want, raw
    for text in ("o'neil mc-donald", "ÉCOLE d'art", "node.js 3x", ""):
        assert one(spark, C.title_case(F.lit(text))) == text.title()
    for key in ("github:https://github.com/torvalds", "email:mona@lisa.com"):
        assert one(spark, C.uuid5_oid(F.lit(key))) == str(uuid.uuid5(uuid.NAMESPACE_OID, key))
    assert [one(spark, C.year_month(F.lit(d))) for d in ("Jan 2025", "2025-01", "01/2025", "January 2025", "junk")] == ["2025-01"] * 4 + [None]
    assert one(spark, C.noisy_or(F.array(F.lit(0.5), F.lit(0.7)))) == pytest.approx(0.85)


def test_similarity():
    assert lcs("kitten", "sitting") == 4 and lcs("", "a") == 0
    assert token_sort_ratio("John Smith", "smith, john") == 100 and token_set_ratio("react", "react native") == 100


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (9, 9), (None, 3)], "src long, dst long")
    assert {r.node: r.component for r in connected_components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 9: 9}


def records(spark, rows):
    return all_records(csv=spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ext_seq long, name string, email string, phone string, current_company string, title string, github_url string, location string"))


def test_greedy_clusters_are_not_transitive(spark):
    rec = records(spark, [("A", "a@x.y", None, None, None, None, None), ("B", None, "+91 9876543210", None, None, None, None), ("C", "a@x.y", "9876543210", None, None, None, None)])
    assert {r.ext_seq: r.cluster for r in greedy_clusters(rec).collect()} == {0: 0, 1: 1, 2: 0}
    assert {r.cluster for r in component_clusters(rec).collect()} == {0}


def test_identity_persists_across_runs(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    first = {r.full_name.value: r.candidate_id for r in run(records(spark, [("Ann", "ann@x.y", None, "Co", None, None, None)]), store).entities.collect()}
    run(records(spark, [("Ann B", "ANN@x.y", "9876543210", "Co", None, None, "Paris, France")]), store)
    again = store.read("entities").collect()
    assert [r.candidate_id for r in again] == list(first.values()) and store.candidate(again[0].candidate_id).count() == 1
    assert {r.kind for r in store.read("identity").collect()} == {"email", "phone"}


def test_stored_values_survive_later_runs(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    whole = ("Ann Lee", "ann@x.y", "9876543210", "Co", "Engineer", None, "Paris, France")
    run(records(spark, [whole]), store)
    run(records(spark, [(None, "ann@x.y", None, None, None, None, None)]), store)
    # two rows of one stored entity that share nothing with each other
    run(records(spark, [(None, "ann@x.y", None, "Two Co", None, None, None), ("Ann L", None, "9876543210", None, None, "https://github.com/ann", None)]), store)
    run(records(spark, [whole]), store)  # the same row again changes nothing
    (ann,) = store.read("entities").collect()
    assert (ann.full_name.value, ann.location.value, ann.github) == ("Ann Lee", "Paris, France", "https://github.com/ann")
    assert [x.value for x in ann.emails] == ["ann@x.y"] and [x.value for x in ann.phones] == ["+919876543210"]
    assert [x.company for x in ann.experience] == ["Co", "Two Co"] and store.read("records").count() == 4


def test_stream_keeps_what_is_stored(spark, tmp_path):
    from linkwright.streaming.incremental import link_stream

    store = Store(spark, f"file://{tmp_path}/store")
    ddl = "ext_seq long, name string, email string, phone string, current_company string, title string, github_url string, location string"
    for i, row in enumerate([(0, "Bo", "bo@x.y", "9876543211", None, None, None, None), (1, None, "bo@x.y", None, "Co", None, None, None)]):
        spark.createDataFrame([row], ddl).write.mode("append").json(f"file://{tmp_path}/in")
        rows = spark.readStream.schema(ddl).json(f"file://{tmp_path}/in")
        link_stream(rows, store, f"file://{tmp_path}/checkpoint").awaitTermination()
        assert len(store.read("entities").collect()) == 1, i
    (bo,) = store.read("entities").collect()
    assert bo.full_name.value == "Bo" and bo.phones[0].value == "+919876543211" and bo.experience[0].company == "Co"


def test_ats_rows_without_an_id(spark):
    rows = spark.createDataFrame([(0, None, "Cy", None), (1, " ", "Di", None), (2, "7", "Ed", None)], "ext_seq long, ats_record_id string, display_name string, tags array<string>")
    ids = [r.ext_id for r in ats_records(rows).collect()]
    assert len(set(ids)) == 3 and all(ids) and ids[2] == "7"


def test_sources(spark, tmp_path):
    (tmp_path / "r.csv").write_text(HEADER + 'Ann,bad.example,,,,,"Paris, X, France",note\n,,,,,,,\n')
    (tmp_path / "a.json").write_text('{"export_date": "x", "candidates": [{"ats_record_id": "1", "personal": {"displayName": "Bo"}}, {"ats_record_id": "2"}]}')
    assert read_recruiter_csv(spark, str(tmp_path / "r.csv")).count() == 1 and read_recruiter_csv(spark, str(tmp_path / "none.csv")).count() == 0
    assert [r.display_name for r in read_ats_json(spark, str(tmp_path / "a.json")).collect()] == ["Bo", None]
    row = records(spark, [("Ann", "bad.example", None, None, None, None, "Paris, X, France")]).first()
    assert row.email_confidence == pytest.approx(0.4) and row.location == "Paris, France"


def test_projection_and_validation(spark):
    rows = spark.sql("SELECT named_struct('value', 'x') AS a, array(named_struct('v', 'js'), named_struct('v', 'k8s')) AS b, 2.0D AS overall_confidence")
    p = project(rows, {"fields": [{"path": "n", "from": "a.value"}, {"path": "s", "from": "b[].v", "normalize": "canonical"}, {"path": "f", "from": "b[7].v"}]}).first()
    assert (p.n, p.s, p.f) == ("x", ["JavaScript", "Kubernetes"], None)
    with pytest.raises(Exception, match="missing required field"):
        project(rows, {"on_missing": "error", "fields": [{"path": "q", "from": "b[9].v", "required": True}]}).collect()
    v = validated(rows.withColumn("candidate_id", F.lit(None).cast("string"))).first()
    assert not v.valid and len(v.errors) == 2


@pytest.mark.parametrize("name", ["csv_extract", "text_section_carry", "default_projection", "norm_location", "incremental_merge", "gold_accuracy", "fts_bm25"])
def test_catalogue_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF), con.execute(ORACLES[name])
    columns = sorted(got.columns)
    names = [d[0] for d in want.description]
    rows = [tuple(r[names.index(c)] for c in columns) for r in want.fetchall()]
    assert sorted(map(repr, rows)) == sorted(repr(tuple(r[c] for c in columns)) for r in got.collect())


def test_all_four_sources_are_linked(spark):
    csv = spark.createDataFrame([(0, "Ann Lee", "ann@x.y", None, "Co", None, "https://github.com/Ann", None)], "ext_seq long, name string, email string, phone string, current_company string, title string, github_url string, location string")
    ats = spark.createDataFrame([(0, "A-1", "Ann Lee", "ann@x.y", None, ["python"])], "ext_seq long, ats_record_id string, display_name string, primary_email string, mobile string, tags array<string>")
    text = "Ann Lee\nother@z.org\nann@x.y\n+91 9876543210\nSkills\nTools: golang, AWS\nEducation\nUniversity of Oz"
    resumes = spark.createDataFrame([(0, "/in/Ann Resume.pdf", text), (1, "/in/scan.pdf", "")], "ext_seq long, path string, text string")
    profile = ("Ann Lee", None, "Oz", "https://github.com/ann", None, "Hub Co")
    profiles = spark.createDataFrame([(200, "Ann", profile, [("Python",), ("Python",), ("Go",)])] * 2 + [(200, "nobody", profile, [])], PROFILE_SCHEMA)
    rec = saved(all_records(csv, ats, resumes, profiles))
    clusters = saved(greedy_clusters(rec))
    table = saved(entities(rec, clusters, cluster_ids(rec, clusters)))
    found = table.collect()
    assert len(found) == 2 and sum(bool(r.emails) for r in found) == 1
    ann = next(r for r in found if r.emails)
    assert set(ann.full_name.sources) == {"recruiter.csv", "ats.json", "ann_resume_pdf", "github_api"}
    assert {x.value for x in ann.emails} == {"ann@x.y", "other@z.org"} and [x.value for x in ann.phones] == ["+919876543210"] and ann.location.value == "Oz"
    skills = {x.value: round(x.confidence, 6) for x in ann.skills}
    assert skills == {"Python": round(1 - 0.05 * 0.5, 6), "Go": round(1 - 0.6 * 0.5, 6), "AWS": 0.4} and ann.education == ["University of Oz"]
    assert [x.company for x in ann.experience] == ["Co", "Hub Co"]
    assert report.summary(table).first().three_way == 1


def test_suggestions_and_explanations_against_brute_force(spark):
    people = [("Ann Lee", "a0@x.y", None, "Rare Co", "Dev", None, "Oz, Faraway"), ("Lee, Ann", "a1@x.y", None, "rare co", None, None, "Uz, Faraway"), ("Ann Leigh", "a2@x.y", None, "Big", None, None, "Oz, Near"),
              ("Bob Roe", "a3@x.y", None, "Big", None, None, "Oz, Near"), (None, "a4@x.y", None, "Big", None, None, None), ("Ann Leih", "a5@x.y", None, "Student", None, None, "Oz, Near"), ("Ann Leih", "a6@x.y", None, "student", None, None, None)]
    rec = saved(records(spark, [*people, ("Ann Lee B", "a0@x.y", None, None, None, None, None)]))
    clusters = saved(greedy_clusters(rec))
    table = saved(entities(rec, clusters, cluster_ids(rec, clusters)))
    company = {0: "rare co", 1: "rare co", 2: "big", 3: "big", 4: "big"}
    country = {0: "faraway", 1: "faraway", 2: "near", 3: "near", 5: "near"}

    def told(held, a, b):
        n = list(held.values()).count(held.get(a))
        return 1 / n if a in held and held[a] == held.get(b) else 0.0

    names = [p[0] or "" for p in people]
    want = {}
    for a in range(7):
        for b in range(a + 1, 7):
            score = (token_sort_ratio(names[a], names[b]) / 100 if names[a] and names[b] else 0.0) * 0.4 + told(company, a, b) * 0.3 + told(country, a, b) * 0.15
            want[a, b] = score
    got = saved(suggest.suggestions(table)).collect()
    assert [(r.a, r.b, r.score) for r in got] == [(a, b, round(s, 2)) for (a, b), s in want.items() if s > 0.6] == [(0, 1, 0.62)]
    assert got[0].signals == ["name similarity (1.00)", "shared company: rare co (contributed 0.15)", "shared country: Faraway (contributed 0.07)"]
    asked = table.filter("cluster IN (0, 2, 6)")
    near = saved(suggest.suggestions_for(table, asked))
    assert {(r.a, r.b, r.score) for r in near.collect()} == {(a, b, round(s, 2)) for (a, b), s in want.items() if s > 0.4 and {a, b} & {0, 2, 6}}
    assert (2, 5) in {(r.a, r.b) for r in near.collect()} and (5, 6) not in {(r.a, r.b) for r in near.collect()}  # a stoplisted value shares nothing
    for call in (lambda: suggest.suggestions(table, 0.5), lambda: suggest.suggestions_for(table, asked, 0.3)):
        with pytest.raises(ValueError):
            call()
    vals = values(rec, clusters)
    texts = {r.candidate_id: r.explanation for r in report.explanations(table, conflicts(vals, scalar_fields(supported(vals))), near).collect()}
    ids = {r.cluster: r.candidate_id for r in table.select("cluster", "candidate_id").collect()}
    first = texts[ids[0]].split("\n")
    assert first[:3] == ["Candidate: Ann Lee (confidence: 0.47)", "-" * 47, 'full_name: "Ann Lee"']
    assert first[3] == '  - confidence 0.90 - (penalized: conflicting value "Ann Lee B" also seen from recruiter.csv)'
    assert '! overall_confidence 0.47 - FLAGGED FOR REVIEW (missing: phone; low-agreement: full_name)' in first
    assert first[-1] == '  ! Possible duplicate of "Lee, Ann" (score 0.62 — flagged for review)' and '"Ann Lee" (score 0.62' in texts[ids[1]]
    assert texts[ids[4]].startswith("Candidate: Unknown (confidence: 0.25)") and "Possible" not in texts[ids[4]]
    assert "below review threshold" in texts[ids[2]]


def test_explanation_of_skills_from_languages(spark):
    rows = spark.createDataFrame([(200, "u", ("U", None, None, "https://github.com/u", None, None), [("Go",)])], PROFILE_SCHEMA)
    rec = saved(all_records(csv=spark.createDataFrame([(0, "U", None, None, None, None, "https://github.com/u", None)], "ext_seq long, name string, email string, phone string, current_company string, title string, github_url string, location string"), profiles=rows))
    clusters = saved(greedy_clusters(rec))
    table = saved(entities(rec, clusters, cluster_ids(rec, clusters)))
    none = spark.createDataFrame([], "cluster long, field string, value string, source string")
    text = report.explanations(table, none).first().explanation
    assert "agreed by recruiter.csv (1.00) and github_api (0.70)" in text and report.ONLY_LANGUAGES in text
    assert [r.id for r in search.ranked(search.bm25_of_texts(search.searchable(table), ["go"])).collect()] == [table.first().candidate_id]
    assert report.flagged(table).count() == 1 and report.top_skills(table).first().skills == ["Go"]


def test_missing_policy_and_schema_of_a_projection(spark):
    rows = spark.sql("SELECT CAST(NULL AS STRING) AS a, CAST(NULL AS STRING) AS b, 'india' AS c, named_struct('country', 'India') AS location, 'x' AS candidate_id")
    config = {"on_missing": "omit", "fields": [{"path": "a", "type": "string", "required": True}, {"path": "b", "type": "string"}, {"path": "c", "type": "string[]", "normalize": "country"}]}
    assert project(rows, config).first().json == '{"b":null,"c":"IN"}'
    shown = project(rows, config | {"on_missing": "null"})
    assert validated(shown, schema_of(config)).first().errors == ["$: a is required", "$.c: not of type array/null"]
    assert validated(shown, schema_of(config, compat=True)).first().errors == ["$: a is required"]
    assert validated(rows).first().errors == ["$.location.country: does not match the pattern"]
    with pytest.warns(UserWarning, match="unknown normaliser"):
        assert project(rows, {"fields": [{"path": "c", "normalize": "nonsense"}]}).first().c == "india"
