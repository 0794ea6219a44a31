from __future__ import annotations

import pytest

from provenant.operators import evaluate as e, report


@pytest.fixture(scope="module")
def rows(spark):
    questions = spark.createDataFrame(
        [("N1", "normal", "answer", ["c1", "c9"], ["1234567", "a|b"], None), ("N2", "normal", "answer", None, None, False), ("S1", "scenario", "answer", ["c5"], ["x"], True), ("O1", "out_of_kb", "refuse", [], [], False), ("O2", "out_of_kb", "refuse", [], [], None)],
        "id string, type string, expect string, gold array<string>, must array<string>, expect_case boolean",
    )
    hits = spark.createDataFrame([("N1", 0, 1, "c0", 0.71234), ("N1", 0, 2, "c1", 0.5), ("N2", 0, 1, "c0", 0.2), ("S1", 0, 1, "c4", 0.35), ("S1", 1, 1, "c5", 0.9), ("O2", 0, 1, "c0", 0.3)], "id string, search_no int, hit_rank int, chunk_id string, score double")
    answers = spark.createDataFrame(
        [("N1", False, "", "共 1,234,567 元 b", ["c1"], [], []), ("N2", True, "no_evidence", "", [], [], ["案例1(0.60)"]), ("S1", False, "", "见条文", ["c4"], ["S2 错"], []), ("O1", True, "no_evidence", "", [], [], []), ("O2", False, "", "答", [], [], [])],
        "id string, refused boolean, reason string, answer string, cited array<string>, dropped array<string>, cases array<string>",
    )
    return e.evaluation_rows(questions, hits, answers).cache()


def test_rows(rows):
    r = {x["id"]: x for x in rows.collect()}
    assert (r["N1"]["top_score"], r["N1"]["hit_at_1"], r["N1"]["hit_at_k"], r["N1"]["gold_rank"], r["N1"]["cited_gold"], r["N1"]["points_ok"], r["N1"]["case_ok"]) == (0.712, False, True, 2, True, True, None)
    assert (r["S1"]["hit_at_k"], r["S1"]["gold_rank"], r["S1"]["missing_points"], r["S1"]["case_ok"]) == (True, None, ["x"], False)  # found by a sub-search only
    assert (r["O1"]["top_score"], r["O1"]["has_gold"], r["O1"]["points_ok"], r["O1"]["case_ok"]) == (0.0, False, True, True)


def test_metrics(rows):
    m = e.metrics(rows).first().asDict()
    assert m == {"n": 5, "n_answerable": 3, "n_gold": 2, "n_out_of_kb": 2, "n_case": 3, "hit_at_k": 2, "hit_at_1": 0, "citation_ok": 1, "points_ok": 2, "dropped_citations": 1, "refused_right": 1, "refused_wrong": 1, "case_right": 1}
    assert e.metrics(rows.where("false")).first()["n"] == 0
    assert {r["type"]: r["mean_length"] for r in e.mean_length(rows).collect()} == {"normal": "15", "scenario": "3", "out_of_kb": "1"}
    shown = {r["metric"]: r["value"] for r in report.metric_table(rows).collect()}
    assert shown["refused wrongly"] == "1/3 = 33%" and {r["value"] for r in report.metric_table(rows.where("false")).collect()} == {"-"}


def test_failures(rows):
    got = {r["id"]: r["why"] for r in e.failures(rows).collect()}
    assert got == {
        "N2": "被拒答(no_evidence, top=0.200)；不应展示案例却展示了：案例1(0.60)",
        "S1": "引用未含标准条款：c4；引用被剔除：S2 错；回答缺少要点：x；应展示案例却没有",
        "O2": "应拒答却作答(top=0.300)",
    }
    assert {r["id"]: r["tags"] for r in e.issue_tags(rows).collect()}["S1"] == ["引用未含标准条款", "缺少要点：x", "案例展示不符合预期"]


def test_sweep_and_report(rows):
    got = {r["threshold"]: (r["refused_right"], r["refused_wrong"]) for r in e.threshold_sweep(rows).collect()}
    assert got == {0.05: (1, 0), 0.1: (1, 0), 0.2: (1, 0), 0.3: (1, 1), 0.4: (2, 2), 0.5: (2, 2)}
    assert e.threshold_sweep(rows).first()["lowest_answerable"] == 0.2
    text = report.markdown(rows, full=False)
    assert "| 0.3 | 1/2 = 50% | 1/3 = 33% |" in text and "- O2: 应拒答却作答(top=0.300)" in text
    assert "<summary>S1 " in report.page(rows)
