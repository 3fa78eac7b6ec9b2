import json

import numpy as np
from pyspark.sql import functions as F

from studyloom.conf import prompts as PR
from studyloom.operators import candidates as C
from studyloom.operators import metrics as M
from studyloom.operators import features as X
from studyloom.operators import studies as S
from studyloom.functions import ids
from studyloom.plans.build_dataset import Inputs, build_dataset
from studyloom.plans.evaluate import evaluate
from studyloom.plans.select_best import select_best
from studyloom.sources import readers, writers


def test_ids_and_times(spark):
    rows = [("50414267.0",), ("abc.0",), (None,), ("12",)]
    df = spark.createDataFrame(rows, "x string")
    assert [r[0] for r in df.select(ids.normal_id(F.col("x"))).collect()] == ["50414267", "abc", "0", "12"]
    t = spark.createDataFrame([("20200102", 30405.678), ("20200102", None), ("2020", 1.0)], "d string, t double")
    got = [str(r[0]) for r in t.select(ids.study_timestamp(F.col("d"), F.col("t"))).collect()]
    assert got == ["2020-01-02 03:04:05", "2020-01-02 00:00:00", "None"]
    p = spark.createDataFrame([("a/s50414267.txt",), ("a/s0.txt",), ("a/readme.txt",)], "p string")
    assert [r[0] for r in p.select(ids.study_of_path(F.col("p"))).collect()] == [50414267, None, None]


def test_views_keep_nulls_and_priority(spark):
    rows = [(1, "c", None), (1, "a", "LATERAL"), (1, "b", "pa"), (1, "e", "AP"), (1, "d", "X")]
    df = spark.createDataFrame([(*r, None) for r in rows], "s int, p string, v string, t timestamp")
    img = S.images_per_study(df, ["s"], "p", "v", "t")
    assert [x["view"] for x in img.first()["images"]] == ["LATERAL", "pa", None, "X", "AP"]
    p = img.select(S.pick_views(F.col("images")).alias("p")).first()["p"]
    assert [x["path"] for x in p["views"]] == ["b", "e", "a", "c"]
    assert (p["num_views"], p["original_num_views"], p["truncated"]) == (4, 5, True)


def test_json_lines(spark, tmp_path):
    lines = [
        json.dumps({"study_id": "1", "real_report": "a", "generated_report": "b"}), "", "  ", "{broken",
        '{"study_id": 2, "real_report": {"findings": "f"}, "generated_report": "g"}',
    ]
    (tmp_path / "p.jsonl").write_text("\n".join(lines))
    good, bad = readers.read_json_lines(spark, str(tmp_path / "p.jsonl"))
    got = {r["study_id"]: r["real_report"] for r in good.collect()}
    assert got == {"1": "a", "2": '{"findings":"f"}'}
    assert [r["line"] for r in bad.collect()] == ["{broken"]


def test_graphs_vectors_texts(spark, tmp_path):
    graph = {"p10/s5.txt": {"entities": {"1": {"tokens": "opacity", "label": "OBS-DP", "relations": [["located_at", "2"]]},
                                          "2": {"tokens": "lung", "label": "ANAT-DP", "relations": []}}}, "x/bad.txt": {"entities": {}}}
    (tmp_path / "g.json").write_text(json.dumps(graph))
    ent, rel = readers.read_report_graphs(spark, str(tmp_path / "g.json"))
    assert {(r["case_id"], r["tokens"]) for r in ent.collect()} == {(5, "opacity"), (5, "lung")}
    r = rel.first()
    assert (r["case_id"], r["eid"], r["rel_type"], r["target"]) == (5, 0, "located_at", 1)
    vec = tmp_path / "v"
    vec.mkdir()
    np.save(vec / "7.npy", np.ones((1, 3), dtype=np.float32))
    (vec / "8.npy").write_bytes(b"junk")
    assert [(r["study_id"], r["vec"]) for r in readers.read_vectors(spark, str(vec)).collect()] == [(7, [1.0, 1.0, 1.0])]
    txt = tmp_path / "files" / "p10"
    txt.mkdir(parents=True)
    (txt / "s5.txt").write_text("line one\nline two")
    assert [tuple(r) for r in readers.read_text_files(spark, str(tmp_path / "files")).collect()] == [("p10/s5.txt", "line one\nline two")]
    assert [tuple(r) for r in readers.list_files(spark, str(tmp_path / "files")).collect()] == [("p10/s5.txt", 17)]


def test_large_object_is_read_by_byte_ranges(spark, tmp_path):
    """Ranges of a few bytes cut names, texts and graphs anywhere; odd texts stand before and after the entities."""
    graphs, want, links = {}, {}, {}
    for i in range(1, 60):
        nodes = {str(k): {"tokens": f'w{k} "entities" é\\', "label": "OBS", "relations": [["modify", str(k - 1)]] if k else []} for k in range(i % 4)}
        graphs[f"files/p10/s{i}.txt"] = {"text": f'see "entities": {{ {i}, ', "n": i, "entities": nodes, "data_source": None, "data_split": "x", "more": [1, {"a": 2}]}
        want[i], links[i] = i % 4, max(0, i % 4 - 1)
    (tmp_path / "g.json").write_text(json.dumps(graphs, indent=1))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "701")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert spark.read.option("lineSep", '"entities":').text(str(tmp_path / "g.json")).rdd.getNumPartitions() > 10
        ent, rel = readers.read_report_graphs(spark, str(tmp_path / "g.json"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    rows = ent.collect()
    assert {i: sum(r["case_id"] == i for r in rows) for i in want} == want and {r["tokens"] for r in rows} == {f'w{k} "entities" é\\' for k in range(3)}
    assert {r["case_id"]: r["n"] for r in rel.groupBy("case_id").agg(F.count("*").alias("n")).collect()} == {i: n for i, n in links.items() if n}


def test_vector_files_tell_what_was_dropped(spark, tmp_path):
    np.save(tmp_path / "7.npy", np.ones((1, 3), dtype=np.float64))
    np.save(tmp_path / "8.npy", np.arange(2, dtype=np.float32))
    np.save(tmp_path / "9.npy", np.ones((4, 3), dtype=np.float32))
    np.save(tmp_path / "name.npy", np.ones(3, dtype=np.float32))
    (tmp_path / "5.npy").write_bytes(b"")
    (tmp_path / "6.npy").write_bytes(b"junk")
    good, bad = readers.read_vector_files(spark, str(tmp_path))
    assert sorted(tuple(r) for r in good.collect()) == [(7, [1.0] * 3, "float64", "(1, 3)"), (8, [0.0, 1.0], "float32", "(2,)")]
    found = {r["path"]: r["problem"] for r in bad.collect()}
    assert set(found) == {"6.npy", "9.npy", "name.npy"} and all(found.values())  # Spark lists no file of length 0
    kinds = X.value_distribution(good, F.col("dtype"), "dtype").collect()
    assert sorted(tuple(r) for r in kinds) == [("float32", 1, 50.0), ("float64", 1, 50.0)]


def test_vector_faults(spark):
    rows = [(None, 3), ([1.0, float("nan"), 0.0], 3), ([1.0, float("inf"), 0.0], 3), ([1.0, 2.0], 3), ([1.0, 2.0, 3.0], None), ([1.0, 2.0, 3.0], 3)]
    df = spark.createDataFrame(rows, "v array<float>, dim int")
    assert [r["status"] for r in X.integrity(df, "v", F.col("dim")).collect()] == ["missing", "nan", "inf", "bad_dim", "missing_meta", "ok"]
    two = X.integrity(df.filter("dim = 3 and size(v) = 3"), "v", F.col("dim"), F.lit(1), F.lit(2))
    assert {r["status"] for r in two.collect()} == {"nan", "inf", "bad_rows"}


def test_csv_projection_by_name(spark, tmp_path):
    (tmp_path / "m.csv").write_text("extra,icd_code,hadm_id\nx,038,1\ny,4280,2\n")
    df = readers.read_csv(spark, str(tmp_path / "m.csv"), "hadm_id long, icd_code string")
    assert [tuple(r) for r in df.collect()] == [(1, "038"), (2, "4280")]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("t", "f", 0.123456)], "eval_timestamp string, report_file string, `BLEU-1` double")
    for _ in range(2):
        writers.append_metrics(rows, str(tmp_path / "m"))
    back = spark.read.option("header", True).csv(str(tmp_path / "m"))
    assert back.count() == 2 and back.first()["BLEU-1"] == "0.1235" and back.first()["METEOR"] == "0.0"
    subjects = spark.createDataFrame([(10000032,), (10000033,), (11000001,), (10000032,), (5,)], "s long")
    writers.write_ids_by_prefix(subjects, "s", str(tmp_path / "ids"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "ids" / "prefix=p10")).collect()) == ["10000032", "10000033"]
    e = spark.createDataFrame([("1",)], "icd string")
    writers.save_knowledge_base(e, e, str(tmp_path / "kb"))
    assert writers.load_knowledge_base(spark, str(tmp_path / "kb"))[0].count() == 1


def test_gating(spark):
    probs = {"Pneumonia": 0.1, "Edema": 0.0, "Support Devices": 0.6, "Fracture": 0.95, "Lung Opacity": 0.9}
    df = spark.createDataFrame([("Pneumonia [x], mild edema, infiltrate, thing", probs)], "r string, p map<string,double>")
    g = df.select(C.gated_context(F.col("r"), F.col("p")).alias("g")).first()["g"]
    assert g["text"] == "mild edema\ninfiltrate\nthing"
    assert g["injected"] == "Lung Opacity, Fracture, Support Devices (Tubes/Lines)"


def test_best_of_n_first_wins(spark):
    df = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.5), (2, 0, 0.1), (2, 1, 0.2)], "k int, cand_ord int, m double")
    got = {r["k"]: r["cand_ord"] for r in C.best_of_n(df, "k", {"m": 1.0}).collect()}
    assert got == {1: 0, 2: 1}


def test_strategies_and_prompt(spark):
    df = spark.createDataFrame([("[PATIENT MEDICAL HISTORY]\n- x", "ref", "", {"Edema": 0.9})], "h string, a string, b string, p map<string,double>")
    rows = C.expand_strategies(df)
    prompt = C.ensemble_prompt(*[F.col(c) for c in ("h", "a", "b", "p", "use_kg1", "use_kg2")])
    got = {r["method"]: r["t"] for r in rows.select("method", prompt.alias("t")).collect()}
    assert len(got) == len(PR.STRATEGIES)
    assert got["Vis+Hist+KG1"] == PR.ENSEMBLE_TEMPLATE.format(kg_context="", history="[PATIENT MEDICAL HISTORY]\n- x")
    assert got["Vis+Hist+KG2"] == PR.ENSEMBLE_TEMPLATE.format(kg_context="Edema", history="[PATIENT MEDICAL HISTORY]\n- x")


def test_select_best_resumes(spark):
    rows = [("1", 0, "a", "lungs are clear", "the lungs are clear"), ("1", 1, "b", "the lungs are clear", "the lungs are clear"), ("2", 0, "a", "x", "y")]
    df = spark.createDataFrame(rows, "study_id string, cand_ord int, method string, text string, reference string")
    done = spark.createDataFrame([("2",)], "study_id string")
    out = [tuple(r) for r in select_best(df, done).collect()]
    assert out == [("1", "the lungs are clear", "FINDINGS: the lungs are clear", "b")]


def test_evaluation_dedupes_and_scores_identity(spark):
    rows = [("1", "old text here", "bad", 0), ("1", "heart is big today ok", "heart is big today ok", 1), ("2", "", "x", 2)]
    df = spark.createDataFrame(rows, "study_id string, real_report string, generated_report string, ord int")
    r = evaluate(df, report_file="f", timestamp="t", order="ord").first()
    assert r["BLEU-4"] == 1.0 and r["ROUGE-L"] == 1.0 and r["METEOR"] == 0.0 and r["RadGraph_F1"] is None
    entities = spark.createDataFrame([("1", 0, "heart", "ANAT"), ("1", 1, "big", "OBS")], "study_id string, eid int, tokens string, entity_type string")
    links = spark.createDataFrame([("1", 1, "modify", 0)], "study_id string, eid int, rel_type string, target int")
    same = (entities, links)
    other = (entities, links.filter("false"))
    assert evaluate(df, report_file="f", timestamp="t", order="ord", graphs=(same, same)).first()["RadGraph_F1"] == 1.0
    assert evaluate(df, report_file="f", timestamp="t", order="ord", graphs=(same, other)).first()["RadGraph_F1"] == 0.5


def test_typed_graph_f1_levels(spark):
    cols = "k int, eid int, tokens string, entity_type string"
    a = spark.createDataFrame([(1, 0, "Lung", "ANAT"), (1, 1, "opacity", "OBS"), (1, 2, "opacity", "OBS"), (2, 0, "rib", "ANAT")], cols)
    b = spark.createDataFrame([(1, 5, "lung", "ANAT"), (1, 6, "opacity", "OBS"), (1, 7, "edema", "OBS"), (3, 0, "rib", "ANAT")], cols)
    links = "k int, eid int, rel_type string, target int"
    ra = spark.createDataFrame([(1, 1, "located_at", 0), (1, 1, "located_at", 99)], links)
    rb = spark.createDataFrame([(1, 6, "located_at", 5), (1, 7, "located_at", 5)], links)
    got = {level: {r["k"]: r["graph_f1"] for r in M.typed_graph_f1((a, ra), (b, rb), "k", level).collect()} for level in M.GRAPH_LEVELS}
    assert got["simple"] == {1: 0.8, 2: 0.0, 3: 0.0}
    # facts of 1: lung -, opacity +, opacity - / lung -, opacity +, edema +; with the triples one more each in common, one alone
    assert got["partial"][1] == round(2 * 2 / 6, 6) and got["complete"][1] == round(2 * 3 / 9, 6)


def test_build_dataset_cleans_texts_and_describes_admissions_once(spark):
    day = "timestamp'2020-01-0{} 00:00:00'"
    rows = lambda sql: spark.sql(f"SELECT * FROM VALUES {sql}")
    src = Inputs(
        image_meta=rows("(1, 10, 'a', '20200103', CAST(NULL AS DOUBLE), 'PA'), (1, 11, 'b', '20200105', NULL, NULL), (2, 20, 'c', '20200105', NULL, NULL), (3, 30, 'd', '20200105', NULL, NULL) t(subject_id, study_id, dicom_id, StudyDate, StudyTime, ViewPosition)"),
        image_path=rows("('a', 'pa'), ('a', 'pb'), ('b', 'pc'), ('c', 'pd'), ('d', 'pe') t(dicom_id, path)"),
        study_list=rows("(1, 10, 'f10'), (1, 11, 'f11'), (2, 20, 'f20'), (3, 30, 'f30'), (3, 30, 'f30') t(subject_id, study_id, path)"),
        report_file=rows("('f10', 'FINDINGS: The heart is normal again.'), ('f11', 'Discussed with Dr. X.'), ('f30', 'Lungs are clear.'), ('f99', 'No study.') t(path, text)"),
        admission=rows(f"(1, 100, {day.format(1)}, {day.format(2)}), (1, 101, {day.format(3)}, {day.format(4)}), (2, 200, {day.format(1)}, {day.format(2)}), (3, 300, {day.format(1)}, {day.format(2)}) t(subject_id, hadm_id, admittime, dischtime)"),
        diagnosis=rows("(100, 2, 'B'), (100, 1, 'A'), (101, 1, 'A'), (200, 1, 'A') t(hadm_id, seq_num, icd_code)"),
        icd_title=rows("('A', 'a old'), ('A', 'a title') t(icd_code, long_title)"),
        drg=rows("(100, 'APR', 'grave', 3.0, 1.0), (100, 'HCFA', 'other', 1.0, 1.0) t(hadm_id, drg_type, description, drg_severity, drg_mortality)"),
    )
    studies, routed = build_dataset(src)
    assert sorted((r.study_id, r.status) for r in routed.collect()) == [(10, "valid"), (11, "rejected_toxic"), (30, "valid"), (30, "valid")]
    assert "__row" not in routed.columns
    found = sorted((r.study_id, r.report, len(r.images), [(h.hadm_id, [d.description for d in h.diagnoses], h.drg and h.drg.description) for h in r.history]) for r in studies.collect())
    heart, lungs = [(100, ["a title", "Unknown"], "grave")], [(300, [], None)] * 2  # a study listed twice has its history twice
    assert found[0][2:] == (2, heart)
    assert [x[0] for x in found] == [10, 30, 30] and found[1] == found[2] and found[1][3] == lungs
    plan = studies._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "long_title" not in plan
