"""A model as a stage: prompts go out in rounds, replies are kept in a log by a digest of what was asked, and nothing in the log is asked again.

A round is a job that appends its replies to the log, so a lost executor repeats a task of one round at most, and a run that is started again goes on where the log ends.
Equal prompts are asked once. A call that fails or takes too long is tried again after a pause; what fails to the end isn't logged, so that
the next run asks it again, and counts as a reply that found nothing.
"""

from __future__ import annotations

import concurrent.futures
import json
import os
import time
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.session import checkpointed

from .answer import messages

#: A call turns a list of {"role", "content"} and a time limit in seconds into the reply's text.
Call = Callable[[list[dict], float], str]
LOG = "digest string, raw string, seconds double, attempts int"

# Limits of a call, verdicts of an assessment and titles of its sections.
TIME_LIMIT, RETRIES = 90.0, 2
VERDICTS = ("合规可行", "有条件可行（需办理手续或受额度限制）", "存在较高合规风险", "违法或被禁止", "依据不足，无法判断")
TITLES = ("适用的规定", "需要办理的手续与额度限制", "风险与法律责任", "合规建议")

_RULES = "只用【资料】作答，每个结论后标 [S编号]，并为用到的每个来源在 citations 中逐字摘抄一句原文（中间可用……省略）。案例只作参考。资料答不了时 found 为 false，citations 为空。只输出 JSON："
QUESTION_RULES = f'回答法规问题，先给结论，不超过 400 字。{_RULES}{{"found": true, "answer": "…[S1]…", "citations": [{{"source": "S1", "quote": "…"}}]}}'
PLAN_RULES = '把用户想做的事拆成 2 到 5 个便于检索法规的问题，并列出事实，不下结论。只输出 JSON：{"summary": "…", "facts": ["…"], "issues": [{"topic": "…", "query": "…"}]}'
ASSESSMENT_RULES = (
    f"评估用户想做的事是否合规。verdict 取其一：{'；'.join(VERDICTS)}。summary 两三句说明结论；sections 依次为{'、'.join(TITLES)}四节，只写与用户情形有关的内容。"
    f'{_RULES}{{"found": true, "verdict": "…", "summary": "…[S1]…", "sections": [{{"title": "{TITLES[0]}", "content": "…[S2]…"}}], "citations": [{{"source": "S1", "quote": "…"}}]}}'
)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Replies by digest, one each; empty before the first round."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], LOG)
    one = spark.read.schema(LOG).parquet(path).groupBy("digest").agg(F.min(F.struct("raw", "seconds", "attempts")).alias("r"))
    return one.select("digest", "r.*")


def asker(call: Call, *, retries: int = RETRIES, limit: float = TIME_LIMIT, pause: float = 1.0, at_once: int = 4) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Asks what (digest, said) holds, some prompts at once; rows of ``LOG``, with null for what failed to the end."""

    def ask(said: str) -> tuple[str | None, float, int]:
        began = time.monotonic()
        for attempt in range(1, retries + 2):
            try:
                return call(json.loads(said), limit), time.monotonic() - began, attempt
            except Exception:
                if attempt <= retries:
                    time.sleep(pause * 2 ** (attempt - 1))
        return None, time.monotonic() - began, retries + 1

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        most = (retries + 1) * limit + pause * 2 ** (retries + 1)  # a call that doesn't keep its limit isn't waited for
        pool = concurrent.futures.ThreadPoolExecutor(at_once)
        try:
            for frame in frames:
                for i in range(0, len(frame), at_once):
                    part = frame.iloc[i : i + at_once]
                    waiting = [pool.submit(ask, said) for said in part["said"]]
                    concurrent.futures.wait(waiting, timeout=most)
                    out = [f.result() if f.done() else (None, most, retries + 1) for f in waiting]
                    yield pd.DataFrame([(d, *o) for d, o in zip(part["digest"], out, strict=True)], columns=["digest", "raw", "seconds", "attempts"])
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    return run


def replies(asked: DataFrame, said: Column, call: Call, log: str, *, settings: str = "", round_rows: int = 2_000, task_rows: int = 50, **how) -> DataFrame:
    """(query_id, raw, seconds): ``asked`` (query_id and what ``said``, an array of messages, reads) answered from the log, and by the model where the log has nothing.

    ``settings`` is part of the digest: what else decides a reply (the model's name, say). Rounds have ``round_rows`` prompts, tasks ``task_rows``.
    """
    spark = asked.sparkSession
    x = asked.select("query_id", F.to_json(said).alias("said"))
    x = checkpointed(x.withColumn("digest", F.sha2(F.concat_ws("\n", F.lit(settings), "said"), 256)))
    missing = checkpointed(x.select("digest", "said").dropDuplicates(["digest"]).join(read_log(spark, log).select("digest"), "digest", "left_anti"))
    total = missing.count()
    rounds = -(-total // round_rows)
    run = asker(call, **how)
    for r in range(rounds):  # digests are even, so their first digits deal them to rounds
        mine = missing.where(F.pmod(F.xxhash64("digest"), F.lit(rounds)) == r)
        tasks = max(1, round_rows // task_rows)
        given = mine.repartition(tasks, "digest").mapInPandas(run, LOG)
        given.where("raw is not null").write.mode("append").parquet(log)
    return x.join(read_log(spark, log), "digest", "left").select("query_id", "raw", F.coalesce("seconds", F.lit(0.0)).alias("seconds"))


def generator(call: Call, log: str, rules: str, **how) -> Callable[[DataFrame], DataFrame]:
    """A model for ``answer.generate_checked``."""
    return lambda prompts: replies(prompts, messages(rules), call, log, **how)


def planner(call: Call, log: str, rules: str = PLAN_RULES, **how) -> Callable[[DataFrame], DataFrame]:
    """A planner for ``flows.assess_scenarios``."""
    said = F.array(F.struct(F.lit("system").alias("role"), F.lit(rules).alias("content")), F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))
    return lambda queries: replies(queries, said, call, log, **how)


def chat(url: str, model: str, *, key_in: str = "CHAT_API_KEY", temperature: float = 0.0) -> Call:
    """Calls a service of chat completions that answers in JSON; its key is in an environment variable of the executors."""

    def call(said: list[dict], limit: float) -> str:
        body = {"model": model, "messages": said, "temperature": temperature, "response_format": {"type": "json_object"}}
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {os.environ[key_in]}"} if key_in in os.environ else {})
        request = urllib.request.Request(url, json.dumps(body).encode(), head)
        with urllib.request.urlopen(request, timeout=limit) as answer:
            return json.load(answer)["choices"][0]["message"]["content"] or "{}"

    return call
