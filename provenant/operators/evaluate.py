"""Batch evaluation: a row for each question, metrics with their own denominators, failures, threshold sweep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.functions.text import missing_points

# Thresholds of the sweep, and what failures are called.
THRESHOLDS = (0.05, 0.1, 0.2, 0.3, 0.4, 0.5)
NOT_RETRIEVED, REFUSED, NO_GOLD_CITED, DROPPED, POINTS = "标准条款未检索到", "被拒答", "引用未含标准条款", "引用被剔除", "回答缺少要点"
NOT_REFUSED, CASE_MISSING, CASE_UNWANTED = "应拒答却作答", "应展示案例却没有", "不应展示案例却展示了"
SHORT_POINTS, SHORT_CASE = "缺少要点", "案例展示不符合预期"


def evaluation_rows(questions: DataFrame, hits: DataFrame, answers: DataFrame) -> DataFrame:
    """A row for each question, in the 26 columns of ``sources.files.DETAILS``.

    ``questions``: id, type, expect, gold, must (arrays), expect_case (boolean or null), and question and key if they have them. ``hits``: id, search_no (0: the main search), hit_rank, chunk_id, score.
    ``answers``: id, refused, reason, answer, cited (array), dropped (array), cases (array), and verdict and seconds if they have them. hit_at_k counts all searches, and whatever they return beyond k.
    """
    more = {"question": F.lit(""), "key": F.lit("")}
    questions = questions.withColumns({c: F.coalesce(F.col(c).cast("string"), x) if c in questions.columns else x for c, x in more.items()})
    more = {"verdict": F.lit(""), "seconds": F.lit(0.0)}
    answers = answers.withColumns({c: F.coalesce(F.col(c), x) if c in answers.columns else x for c, x in more.items()})
    listed = lambda on: F.transform(F.array_sort(F.collect_list(F.when(on, F.struct("search_no", "hit_rank", "chunk_id")))), lambda x: x["chunk_id"])
    first = F.max(F.when((F.col("search_no") == 0) & (F.col("hit_rank") == 1), F.col("score")))
    found = hits.groupBy("id").agg(listed(F.col("search_no") == 0).alias("main"), F.array_distinct(listed(F.lit(True))).alias("retrieved"), first.alias("_top"))
    kind = dict(hits.dtypes)["chunk_id"]
    none = F.array().cast(f"array<{kind}>")
    text = F.array().cast("array<string>")
    x = questions.join(found, "id", "left").join(answers, "id", "left")
    x = x.withColumns({"main": F.coalesce("main", none), "retrieved": F.coalesce("retrieved", none), "gold": F.array_sort(F.array_distinct(F.coalesce("gold", none))), "must": F.coalesce("must", text), "refused": F.coalesce("refused", F.lit(True)), "cited": F.coalesce("cited", none), "dropped": F.coalesce("dropped", text), "cases": F.coalesce("cases", text)})
    ranks = F.filter(F.transform("gold", lambda g: F.array_position("main", g)), lambda r: r > 0)
    missing = F.when(F.col("refused"), F.col("must")).otherwise(missing_points(F.coalesce("answer", F.lit("")), F.col("must")))
    shown = F.size("cases") > 0
    return x.select(
        "id", "type", "question", "expect", "refused", F.coalesce("reason", F.lit("")).alias("reason"), F.coalesce("verdict", F.lit("")).alias("verdict"),
        F.round(F.coalesce("_top", F.lit(0.0)), 3).alias("top_score"),
        F.coalesce(F.array_contains("gold", F.try_element_at("main", F.lit(1))), F.lit(False)).alias("hit_at_1"),
        F.arrays_overlap("gold", "retrieved").alias("hit_at_k"),
        F.array_min(ranks).alias("gold_rank"),
        (F.size("gold") > 0).alias("has_gold"), "gold", "cited",
        F.arrays_overlap("gold", "cited").alias("cited_gold"),
        F.size("dropped").alias("dropped_citations"), F.col("dropped").alias("dropped_detail"),
        missing.alias("missing_points"), (F.size(missing) == 0).alias("points_ok"),
        "expect_case", F.col("cases").alias("cases_shown"), F.when(F.col("expect_case").isNotNull(), shown == F.col("expect_case")).alias("case_ok"),
        "retrieved", F.coalesce("answer", F.lit("")).alias("answer"), "key", F.round(F.coalesce("seconds", F.lit(0.0)), 1).alias("seconds"),
    )


def ratio(n: Column, d: Column) -> Column:
    """``n/d = p%``, or ``-`` for none."""
    return F.when(d > 0, F.format_string("%d/%d = %.0f%%", n, d, F.rint(n * 100 / F.nullif(d, F.lit(0))))).otherwise("-")


def metrics(rows: DataFrame, *by: str) -> DataFrame:
    """Counts and denominators of all metrics in one aggregation, overall or by columns."""
    answer, ook = F.col("expect") == "answer", F.col("type") == "out_of_kb"
    gold = answer & F.col("has_gold")
    case = F.col("case_ok").isNotNull()
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    out = {
        "n": F.count("*"), "n_answerable": count(answer), "n_gold": count(gold), "n_out_of_kb": count(ook), "n_case": count(case),
        "hit_at_k": count(gold & F.col("hit_at_k")), "hit_at_1": count(gold & F.col("hit_at_1")),
        "citation_ok": count(gold & ~F.col("refused") & F.col("cited_gold")), "points_ok": count(answer & F.col("points_ok")),
        "dropped_citations": F.coalesce(F.sum("dropped_citations"), F.lit(0)), "refused_right": count(ook & F.col("refused")), "refused_wrong": count(answer & F.col("refused")), "case_right": count(case & F.col("case_ok")),
    }
    return (rows.groupBy(*by) if by else rows.groupBy()).agg(*(c.cast("long").alias(n) for n, c in out.items()))


def mean_length(rows: DataFrame, by: str = "type") -> DataFrame:
    """(type, mean_length): whole characters of answers that were given, ``-`` where none was; by the question's type, not the way it was answered."""
    given = ~F.col("refused") & (F.col("answer") != "")
    total, n = F.sum(F.when(given, F.length("answer"))), F.count_if(given)
    return rows.groupBy(by).agg(F.coalesce(F.floor(total / F.nullif(n, F.lit(0))).cast("string"), F.lit("-")).alias("mean_length"))


def failures(rows: DataFrame, *, full: bool = True) -> DataFrame:
    """(id, why): all that went wrong with a question; questions without failures are left out. full: answers were generated, not only searched."""
    answer, refused = F.col("expect") == "answer", F.col("refused")
    given = answer & ~refused & F.lit(full)
    why = lambda on, text: F.when(F.coalesce(on, F.lit(False)), text)
    top = F.format_string("%.3f", "top_score")
    parts = F.array(
        why(answer & F.col("has_gold") & ~F.col("hit_at_k"), F.lit(NOT_RETRIEVED)),
        why(answer & refused, F.concat(F.lit(REFUSED + "("), F.coalesce("reason", F.lit("")), F.lit(", top="), top, F.lit(")"))),
        why(given & F.col("has_gold") & ~F.col("cited_gold"), F.concat(F.lit(NO_GOLD_CITED + "："), F.array_join(F.col("cited").cast("array<string>"), ","))),
        why(given & (F.size("dropped_detail") > 0), F.concat(F.lit(DROPPED + "："), F.array_join("dropped_detail", "；"))),
        why(given & (F.size("missing_points") > 0), F.concat(F.lit(POINTS + "："), F.array_join("missing_points", "、"))),
        why(~answer & ~refused, F.concat(F.lit(NOT_REFUSED + "(top="), top, F.lit(")"))),
        why(F.col("case_ok") == F.lit(False), F.when(F.col("expect_case"), CASE_MISSING).otherwise(F.concat(F.lit(CASE_UNWANTED + "："), F.array_join("cases_shown", "、")))),
    )
    found = F.filter(parts, lambda p: p.isNotNull())
    return rows.select("id", F.array_join(found, "；").alias("why")).where("why <> ''")


def issue_tags(rows: DataFrame) -> DataFrame:
    """(id, tags): the short form of failures that the web report shows."""
    answer, refused = F.col("expect") == "answer", F.col("refused")
    why = lambda on, text: F.when(F.coalesce(on, F.lit(False)), text)
    parts = F.array(
        why(answer & F.col("has_gold") & ~F.col("hit_at_k"), F.lit(NOT_RETRIEVED)),
        why(answer & refused, F.lit(REFUSED)),
        why(answer & ~refused & F.col("has_gold") & ~F.col("cited_gold"), F.lit(NO_GOLD_CITED)),
        why(answer & ~refused & (F.size("missing_points") > 0), F.concat(F.lit(SHORT_POINTS + "："), F.array_join("missing_points", "、"))),
        why(~answer & ~refused, F.lit(NOT_REFUSED)),
        why(F.col("case_ok") == F.lit(False), F.lit(SHORT_CASE)),
    )
    return rows.select("id", F.filter(parts, lambda p: p.isNotNull()).alias("tags"))


def threshold_sweep(rows: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """(threshold, refused_right, n_out_of_kb, refused_wrong, n_answerable, lowest_answerable, highest_out_of_kb): gates simulated on top scores.

    Rows are summed once; thresholds are columns of that one aggregation and become rows at the end.
    """
    answer, ook = F.col("expect") == "answer", F.col("type") == "out_of_kb"
    sums = []
    for i, t in enumerate(thresholds):
        sums += [F.count_if(ook & (F.col("top_score") < t)).alias(f"r{i}"), F.count_if(answer & (F.col("top_score") < t)).alias(f"w{i}")]
    one = rows.agg(*sums, F.count_if(ook).alias("n_out_of_kb"), F.count_if(answer).alias("n_answerable"), F.min(F.when(answer, F.col("top_score"))).alias("lowest_answerable"), F.coalesce(F.max(F.when(ook, F.col("top_score"))), F.lit(0.0)).alias("highest_out_of_kb"))
    cells = F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"r{i}").alias("refused_right"), F.col(f"w{i}").alias("refused_wrong")) for i, t in enumerate(thresholds)))
    return one.select(F.explode(cells).alias("c"), "n_out_of_kb", "n_answerable", "lowest_answerable", "highest_out_of_kb").select("c.*", "n_out_of_kb", "n_answerable", "lowest_answerable", "highest_out_of_kb")


def titles_by_level(chunks: DataFrame, *, level: str = "doc_type", title: str = "doc_title") -> DataFrame:
    """(level, titles): distinct titles of each level, sorted."""
    return chunks.groupBy(level).agg(F.array_sort(F.collect_set(title)).alias("titles"))
