"""The model stage: a log that runs go on from, failures, limits, a service of chat completions."""

from __future__ import annotations

import json
import os
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, HTTPServer
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from provenant.operators import model


def counting(folder, bad=None, slow=None):
    """A call that notes what it is asked in a file of its own, and ends its worker at one prompt."""

    def call(said, limit):
        text = said[-1]["content"]
        with open(f"{folder}/{os.getpid()}-{threading.get_ident()}", "a") as out:
            out.write(text + "\n")
        if text == bad:
            os._exit(1)  # a lost worker
        if text == slow:
            time.sleep(30)
        if text.startswith("fails"):
            raise OSError("no answer")
        return json.dumps({"said": text})

    return call


def asked(folder):
    return Counter(line for p in Path(folder).iterdir() for line in p.read_text().splitlines())


def said():
    return F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")))


def test_a_run_goes_on_where_the_log_ends(spark, tmp_path):
    """A worker is lost midway: rounds that were written aren't asked again, and the next run asks the others."""
    log, one, two, three = (str(tmp_path / x) for x in ("log", "one", "two", "three"))
    for folder in (one, two, three):
        os.mkdir(folder)
    prompts = spark.createDataFrame([(i, f"p{i // 2}") for i in range(120)], "query_id long, prompt string")  # each prompt twice
    how = {"round_rows": 10, "task_rows": 4, "at_once": 1}
    with pytest.raises(Exception, match="(?s).*"):
        model.replies(prompts, said(), counting(one, bad="p37"), log, **how)
    kept = {json.loads(r["raw"])["said"] for r in model.read_log(spark, log).collect()}
    assert 0 < len(kept) < 60 and kept <= set(asked(one))
    out = model.replies(prompts, said(), counting(two), log, **how)
    again = asked(two)
    assert not kept & set(again) and set(again) == {f"p{i}" for i in range(60)} - kept and set(again.values()) == {1}
    assert {r["query_id"]: json.loads(r["raw"])["said"] for r in out.collect()} == {i: f"p{i // 2}" for i in range(120)}
    model.replies(prompts, said(), counting(three), log, **how)
    assert not asked(three)
    model.replies(prompts.limit(2), said(), counting(three), log, settings="another model", **how)
    assert sum(asked(three).values()) >= 1


def test_failures_and_limits(spark, tmp_path):
    """What fails is tried again and isn't logged; a call beyond its limit isn't waited for."""
    log, folder = str(tmp_path / "log"), str(tmp_path / "asked")
    os.mkdir(folder)
    prompts = spark.createDataFrame([(1, "good"), (2, "fails"), (3, "sleeps"), (4, None)], "query_id long, prompt string").coalesce(1)
    began = time.monotonic()
    out = {r["query_id"]: r["raw"] for r in model.replies(prompts, F.array(F.struct(F.lit("user").alias("role"), F.coalesce("prompt", F.lit("")).alias("content"))), counting(folder, slow="sleeps"), log, retries=1, limit=0.5, pause=0.1).collect()}
    assert time.monotonic() - began < 25 and out[2] is None and out[3] is None and json.loads(out[1]) == {"said": "good"} and out[4] is not None
    assert asked(folder)["fails"] == 2 and model.read_log(spark, log).count() == 2


def test_chat(spark, tmp_path):
    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            got = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            body = json.dumps({"choices": [{"message": {"content": json.dumps({"model": got["model"], "n": len(got["messages"]), "last": got["messages"][-1]["content"]})}}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        call = model.chat(f"http://127.0.0.1:{server.server_port}/chat", "m")
        prompts = spark.createDataFrame([(1, "问", None, None), (2, "问", "S1: 错", "{}")], "query_id long, prompt string, feedback string, previous string")
        out = {r["query_id"]: json.loads(r["raw"]) for r in model.generator(call, str(tmp_path / "log"), model.QUESTION_RULES)(prompts).collect()}
        assert out[1] == {"model": "m", "n": 2, "last": "问"} and out[2]["n"] == 4
        plans = model.planner(call, str(tmp_path / "log"))(prompts.select("query_id", F.col("prompt").alias("text")))
        assert plans.count() == 2
    finally:
        server.shutdown()
