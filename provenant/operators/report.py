"""Reports of an evaluation: Markdown lines and a self-contained page, from aggregated rows."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evaluate import failures, issue_tags, mean_length, metrics, ratio, threshold_sweep

METRICS = (
    ("retrieval hit", "hit_at_k", "n_gold"), ("retrieval hit, first", "hit_at_1", "n_gold"), ("citation accuracy", "citation_ok", "n_gold"), ("key-point coverage", "points_ok", "n_answerable"),
    ("refused rightly", "refused_right", "n_out_of_kb"), ("refused wrongly", "refused_wrong", "n_answerable"), ("case shown as expected", "case_right", "n_case"),
)


def metric_table(rows: DataFrame) -> DataFrame:
    """(metric, value): every metric as ``n/d = p%``, in order."""
    cells = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(name).alias("metric"), ratio(F.col(n), F.col(d)).alias("value")) for i, (name, n, d) in enumerate(METRICS)))
    return metrics(rows).select(F.explode(cells).alias("c")).select("c.i", "c.metric", "c.value")


def markdown(rows: DataFrame, *, full: bool = True) -> str:
    """The report: metrics, lengths, threshold sweep, failures. Only aggregated rows and failures come to the driver."""
    out = ["| metric | value |", "|---|---|", *(f"| {r['metric']} | {r['value']} |" for r in metric_table(rows).orderBy("i").collect())]
    if full:
        out += [f"| answer length, {r['type']} | {r['mean_length']} |" for r in mean_length(rows).orderBy("type").collect()]
    else:
        out += ["", "| threshold | refused rightly | refused wrongly |", "|---|---|---|"]
        sweep = threshold_sweep(rows).select("threshold", ratio(F.col("refused_right"), F.col("n_out_of_kb")).alias("r"), ratio(F.col("refused_wrong"), F.col("n_answerable")).alias("w"))
        out += [f"| {r['threshold']} | {r['r']} | {r['w']} |" for r in sweep.orderBy("threshold").collect()]
    return "\n".join([*out, "", *(f"- {r['id']}: {r['why']}" for r in failures(rows, full=full).orderBy("id").collect())])


#: Shows the questions of a type, and those with tags only.
FILTER = (
    "<p><select id=t><option value=''>all</select> <label><input type=checkbox id=f> with issues</label>"
    "<script>const d=[...document.querySelectorAll('details')],t=document.getElementById('t'),f=document.getElementById('f');"
    "for(const x of new Set(d.map(e=>e.dataset.type)))t.add(new Option(x,x));"
    "const s=()=>d.forEach(e=>e.hidden=t.value&&e.dataset.type!=t.value||f.checked&&!e.dataset.tags);t.onchange=f.onchange=s</script>"
)


def page(rows: DataFrame, title: str = "Evaluation") -> str:
    """A page without outside references: metrics, then questions with their tags and answers, which open on a click and can be filtered by type and issues."""
    e = html.escape
    table = "".join(f"<tr><th>{e(r['metric'])}<td>{e(r['value'])}" for r in metric_table(rows).orderBy("i").collect())
    tagged = rows.join(issue_tags(rows), "id").select("id", "type", "answer", "tags").orderBy("id")
    items = "".join(f"<details data-type='{e(r['type'])}' data-tags='{e('; '.join(r['tags']))}'><summary>{e(r['id'])} {e('; '.join(r['tags']))}</summary><pre>{e(r['answer'] or '')}</pre></details>" for r in tagged.toLocalIterator())
    return f"<!doctype html><meta charset=utf-8><title>{e(title)}</title><h1>{e(title)}</h1><table>{table}</table><div>{items}</div>{FILTER}"
