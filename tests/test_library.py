"""Documents written here with planted faults, through loading and all modules."""

import pytest
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import graph as G
from folioscope.operators import procedures as P
from folioscope.operators import quality as Q
from folioscope.operators import rewriting as R
from folioscope.operators import rollup
from folioscope.plans import modules as M
from folioscope.sources import corpus as C
from folioscope.sources import sinks
from folioscope.streaming import dropfolder

HEAD = "---\nsop_id: {id}\ntitle: {title}\ndepartment_code: CLN\nlanguage: {lang}\nnext_review: 2025-01-01\n{more}---\n"
BODY = """## 1. Purpose
This tells how rooms are cleaned. See SOP-CLN-002 and SOP-CLN-099. It follows EU GMP Annex 1 (2008 revision).

## 2. Safety
Gloves must be worn.

## 3. Procedure
1. Wipe the wall with 70% alcohol for 5 minutes.
2. If the surface is still wet, wait until it is dry again.
3. Record the time in the log book.

## 4. References
ISO 14644-1:2015.
"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("docs")
    put = lambda id, lang, body, more="": (path / f"{id}.md").write_text(HEAD.format(id=id, title=f"Cleaning {id}", lang=lang, more=more) + body, encoding="utf-8")
    put("SOP-CLN-001", "en", BODY)
    put("SOP-CLN-002", "en", BODY.replace("SOP-CLN-002", "SOP-CLN-001").replace("the log book", "the large log book"))
    put("SOP-CLN-003", "en", "REVISION HISTORY\nIt shall be confirmed that the room is clean; appropriate care shall be taken.\n")
    put("SOP-CLN-001-ES", "es", BODY.replace("70%", "60,5%").replace("## 2. Safety\n", ""), "parent: SOP-CLN-001\n")
    (path / "README.md").write_text("not a document")
    return str(path)


@pytest.fixture(scope="module")
def inputs(spark, folder):
    register = spark.createDataFrame([("EU GMP Annex 1", "2022", "sterile", ["2008"]), ("ISO 14644-1", "2015", "rooms", ["1999"])], "canonical string, current string, topic string, outdated array<string>")
    bands = spark.createDataFrame([("Cleaning", "CLN", 1, 2), ("Dispensing", "DSP", 1, 2)], "topic string, dept string, expected_min int, expected_max int")
    return M.Inputs(C.load_documents(spark, folder).cache(), bands, register)


def test_loading(inputs):
    rows = {r["sop_id"]: r for r in inputs.docs.collect()}
    assert sorted(rows) == ["SOP-CLN-001", "SOP-CLN-001-ES", "SOP-CLN-002", "SOP-CLN-003"]
    assert rows["SOP-CLN-001-ES"]["parent_id"] == "SOP-CLN-001" and rows["SOP-CLN-001"]["body"].startswith("## 1.")


def test_modules_find_the_planted_faults(inputs):
    results = M.run(inputs)
    assert {n: r.error for n, r in results.items() if r.error} == {}
    cited = {(r["sop_id"], r["canonical"], r["status"]) for r in results["m05_regaudit"].table.collect()}
    assert ("SOP-CLN-001", "EU GMP Annex 1", "outdated") in cited and ("SOP-CLN-001", "ISO 14644-1", "current") in cited
    graph = {(r["category"], r["sop_id"]) for r in results["m04_dependencies"].table.collect()}
    assert {("orphan", "SOP-CLN-003"), ("broken", "SOP-CLN-099"), ("cycle", "SOP-CLN-001")} <= graph
    assert [(r["a"], r["b"]) for r in results["m01_similarity"].table.collect()] == [("SOP-CLN-001", "SOP-CLN-002")]
    assert {r["status"] for r in results["m09_coverage"].table.collect()} == {"over-documented", "absent"}
    differ = {(r["category"], r["en_value"], r["es_value"]) for r in results["m12_multilang"].table.collect()}
    assert differ == {("value", "70%", "60.5%"), ("format", "point decimals", "comma decimals"), ("structure", "4 sections", "3 sections"), ("structure", "safety section", "none")}
    flow = [r for r in results["m10_visual_aids"].table.collect() if r["sop_id"] == "SOP-CLN-001"]
    assert [r["type"] for r in sorted(flow, key=lambda r: r["pos"])] == ["process", "decision", "process"]
    style = {r["sop_id"]: r["heading_style"] for r in results["m11_style"].table.collect()}
    assert style["SOP-CLN-001"] == "markdown" and style["SOP-CLN-003"] == "allcaps"
    training = {r["sop_id"]: r for r in results["m13_training"].table.collect()}
    assert len(training["SOP-CLN-001"]["steps"]) == 3 and training["SOP-CLN-001"]["method"] == "numbered"
    worst = {r["sop_id"]: r["status"] for r in rollup.worst_status(M.per_document({k: results[k] for k in ("m05_regaudit", "m11_style", "m12_multilang")})).collect()}
    assert worst["SOP-CLN-001"] == "fail"


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_rewriting_and_decisions(spark):
    new = value(spark, R.rewritten_paragraph(F.lit("It shall be confirmed that the room is clean; the log shall be kept with care.")))
    assert new.startswith("Confirm that the room is clean.")
    verbs = [value(spark, R.verb_of(F.lit(w))) for w in ("verified", "stopped", "calibrated", "Utilized", "shown", "wiped", "filled")]
    assert verbs == ["verify", "stop", "calibrate", "use", "shown", "wip", "fil"]
    assert value(spark, R.mark_vague(F.lit("use an adequate amount"))) == "use an [DEFINE criterion: adequate] amount"
    assert tuple(value(spark, P.decision(F.lit("If the seal is broken again, reject the whole container")))) == ("the seal is broken again", "reject the whole container")
    assert value(spark, P.decision(F.lit("Record the time"))) is None
    assert value(spark, P.section_title(F.lit("V. CLEANING OF THE ROOM"))) == "Cleaning of the Room"


def test_rewritten_blocks(spark):
    body = "| a | b |\n| c | d |\n\nROOM CLEANING\n\n4. The wall shall be wiped with care. 5. Record the time now.\n\nThe final log must be kept by the lead.\n\n1. Close the door."
    text = value(spark, R.rewritten(F.lit(body)))
    assert text == "| a | b |\n| c | d |\n\n\n## Room Cleaning\n\n1. Wip the wall with care.\n\n2. Record the time now.\n\nKept final log by the lead.\n\n3. Close the door."


def test_blocks_of_steps(spark):
    body = "Intro line\n\nHEAD ONE\n1. First step\n   goes on here\n\n2. Second step\nprose ends it\n3. Alone\n\n   not a part\nStep 7: again\n"
    got = value(spark, P.step_blocks(F.lit(body)))
    assert [(b["heading"], [(s["n"], s["text"]) for s in b["steps"]]) for b in got] == [
        ("HEAD ONE", [(1, "First step goes on here"), (2, "Second step")]), ("prose ends it", [(3, "Alone")]), ("not a part", [(7, "again")])
    ]
    assert value(spark, P.step_blocks(F.lit(None).cast("string"))) == []
    many = "Head\n" + "\n".join(f"{k}. Step number {k}" for k in range(1, 5001))
    assert len(value(spark, P.longest_block(P.step_blocks(F.lit(many))))["steps"]) == 5000


def test_sentences_and_dates(spark):
    df = spark.createDataFrame([("Use approx. 5 ml. See no. 4 here. \"Go\" (Now) now. x",), ("",)], "t string")
    got = [r[0] for r in df.select(T.sentences(F.col("t"))).collect()]
    assert got == [["Use approx. 5 ml.", "See no. 4 here.", '"Go" (Now) now. x'], []]
    dates = spark.createDataFrame([("5 de marzo de 2024",), ("3/25/2024",), ("4/5/2024",), ("Marble 5, 2024",), ("Sept. 5, 2024",), ("junk",)], "t string").select(T.parse_date(F.col("t")).alias("d")).collect()
    assert [tuple(r["d"]) for r in dates] == [("2024-03-05", None), ("2024-03-25", None), ("2024-05-04", "day and month are ambiguous; read as day first"), (None, None), ("2024-09-05", None), (None, None)]


def test_cycles_and_empty_tables(spark, inputs):
    links = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    assert sorted(tuple(r["nodes"]) for r in G.cycles(links).collect()) == [("a", "b"), ("a", "b", "c")]
    assert G.cycles(links.limit(0)).count() == 0
    assert sorted(map(tuple, G.cycle_edges(links).collect())) == [("a", "b"), ("b", "a"), ("b", "c"), ("c", "a")]
    assert Q.readability(inputs.docs.limit(0)).count() == 0


def test_sinks_and_stream(spark, inputs, folder, tmp_path):
    sinks.write_csv(inputs.docs.select("sop_id", "frontmatter"), f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 4
    cards = inputs.docs.select("sop_id", sinks.html_page(F.col("sop_id"), F.array(F.lit("<b>"))).alias("text"))
    assert "&lt;b&gt;" in cards.first()["text"]
    query = dropfolder.analyse(dropfolder.watch_documents(spark, folder), lambda d: d.select("sop_id"), f"{tmp_path}/out", f"{tmp_path}/state")
    query.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").filter("sop_id like 'SOP%'").count() == 4


def test_commands(spark, folder, tmp_path, capsys):
    from folioscope import cli

    assert cli.main(["list"]) == 0 and "m07_scorecard" in capsys.readouterr().out
    assert cli.main(["run", "--docs", f"{tmp_path}/none", "--out", f"{tmp_path}/o"], spark) == 1
    assert cli.main(["run", "--docs", folder, "--module", "77", "--out", f"{tmp_path}/o"], spark) == 1
    for number in ("3", "11"):  # the second run keeps what the first one said
        assert cli.main(["run", "--docs", folder, "--module", number, "--out", f"{tmp_path}/o"], spark) == 0
    told = spark.read.json(f"{tmp_path}/o/results.json")
    assert {r["module"] for r in told.select("module").distinct().collect()} == {"m03_readability", "m11_style"}
    pages = spark.read.text(f"{tmp_path}/o/dossiers", wholetext=True)
    assert pages.filter("value like '%m03_readability%' and value like '%m11_style%'").count() == 3
    assert "<td>m11_style</td>" in spark.read.text(f"{tmp_path}/o/dashboard", wholetext=True).first()[0]


def test_topic_findings(spark):
    docs = spark.createDataFrame([("A", "Syringe line"), ("B", "Vial line"), ("C", "Vial room"), ("D", "Other")], "sop_id string, title string")
    table = spark.createDataFrame([(0, "line / wipe", 2, ["wipe line", "clean"], ["A", "B"]), (1, "x", 2, ["room"], ["C", "D"])], "cluster int, label string, size long, top_terms array<string>, examples array<string>")
    for clusters, said in (((0, 0, 1, 1), "they share topic 0"), ((0, 1, 1, 1), "syringes in topics [0], vials in [1]")):
        members = spark.createDataFrame(list(zip("ABCD", clusters, strict=True)), "sop_id string, cluster int")
        got = [r["finding"] for r in M.topic_findings(docs, members, table).collect()]
        assert len(got) == 4 and got[0].startswith("Equipment/Cleaning cluster 0") and said in got[1] and got[3] == "2 topics of 4 documents."


def test_groups_and_ranks(spark):
    from folioscope.operators import similarity as V

    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("c", "d")], "a string, b string")
    groups = spark.createDataFrame([("g", "a"), ("g", "b"), ("h", "c"), ("h", "d"), ("i", "d"), ("i", "c")], "group string, member string")
    assert {(r["a"], r["b"]): r["group"] for r in V.in_one_group(pairs, groups).collect()} == {("a", "b"): "g", ("a", "c"): None, ("c", "d"): "h"}
    rows = spark.createDataFrame([(k, k % 7) for k in range(100)], "sop_id int, v int")
    got = {r["sop_id"]: r["rank"] for r in Q.with_ranks(rows.repartition(5), "v").collect()}
    assert got == {k: n for n, k in enumerate(sorted(range(100), key=lambda k: (-(k % 7), k)), 1)}


def test_queries_import_without_training_data_operators():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {"m03_readability", "m05_citations"} <= names and set(entry.oracle_sql()) <= names


def test_entry_runs_a_registered_query(monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setitem(entry._plain.QUERIES, "m03_readability", lambda spark, sf_dir: (spark, sf_dir))
    assert entry.entry("session")[0] == "session"
