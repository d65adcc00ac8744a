import collections
import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from lodestone.functions import embed
from lodestone.plans import answers, cli, config, engine


class Endpoint:
    """A chat endpoint that fails at times: each prompt's first call gets a 503, 'never' always a 500, 'refused' a 400."""

    def __init__(self):
        self.calls, self.open, self.most, self.lock = collections.Counter(), 0, 0, threading.Lock()
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def log_message(self, *a):
                pass

            def do_POST(self):
                user = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["messages"][1]["content"]
                question = user.rsplit("Question: ", 1)[1]
                with outer.lock:
                    outer.calls[question] += 1
                    outer.open += 1
                    outer.most = max(outer.most, outer.open)
                time.sleep(0.05)
                code = 500 if "never" in question else 400 if "refused" in question else 503 if outer.calls[question] == 1 else 200
                with outer.lock:
                    outer.open -= 1
                self.send_response(code)
                if code == 503:
                    self.send_header("Retry-After", "0")
                self.end_headers()
                if code == 200:
                    self.wfile.write(json.dumps({"choices": [{"message": {"content": f"about {question}"}}]}).encode())

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}"


@pytest.fixture
def endpoint():
    e = Endpoint()
    yield e
    e.server.shutdown()
    e.server.server_close()


@pytest.fixture
def asked(spark, tmp_path, endpoint):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "pigeons.txt").write_text("Pigeons find their way home.")
    s = config.Settings(docs_dir=str(docs), index_dir=f"file://{tmp_path}/index", system_prompt_path="Be brief.", embedding_model="hashed", llm_base_url=endpoint.url)
    e = engine.Engine(spark, s, embed.hashed(), lambda q, t: F.length(t).cast("double"))
    e.sync()
    return e


def test_a_rerun_asks_only_what_is_missing(asked, endpoint, spark, tmp_path):
    kept = f"file://{tmp_path}/kept"
    qs = [(i, f"question {i % 8}") for i in range(12)] + [(12, "never"), (13, "refused")]
    table = spark.createDataFrame(qs, "query_id int, question string")
    run = lambda t, **o: {r.query_id: (r.answer, r.error) for r in answers.answer(asked, t, kept, tasks=2, concurrent=2, attempts=3, pause=0.01, **o).collect()}
    got = run(table, wave=3)
    assert got == {i: (f"about {q}", None) for i, q in qs[:12]} | {12: (None, "the endpoint answered 500"), 13: (None, "the endpoint answered 400")}
    assert endpoint.calls == {f"question {i}": 2 for i in range(8)} | {"never": 3, "refused": 1}  # copies are one call, a refusal is final
    assert endpoint.most <= 4
    more = spark.createDataFrame([*qs, (14, "question 9")], table.schema)
    again = run(more)
    assert again == got | {14: ("about question 9", None)}
    assert endpoint.calls["question 0"] == 2 and endpoint.calls["question 9"] == 2 and endpoint.calls["never"] == 6
    (tmp_path / "docs" / "more.txt").write_text("Another passage changes every prompt.")
    asked.sync()
    assert run(table.limit(1))[0] == ("about question 0", None) and endpoint.calls["question 0"] == 3


def test_a_lost_run_keeps_its_waves(asked, endpoint, spark, tmp_path, monkeypatch):
    kept = f"file://{tmp_path}/kept"
    table = spark.createDataFrame([(i, f"question {i}") for i in range(9)], "query_id int, question string")
    plain, made = answers.asking, []

    def breaks(*args):
        made.append(1)
        if len(made) == 3:
            raise RuntimeError("lost")
        return plain(*args)

    monkeypatch.setattr(answers, "asking", breaks)
    with pytest.raises(RuntimeError):
        answers.answer(asked, table, kept, pause=0.01, wave=2)
    before = dict(endpoint.calls)
    assert 0 < len(before) < 9
    monkeypatch.setattr(answers, "asking", plain)
    assert {r.answer for r in answers.answer(asked, table, kept, pause=0.01).collect()} == {f"about question {i}" for i in range(9)}
    assert all(endpoint.calls[q] == n for q, n in before.items()) and len(endpoint.calls) == 9


def test_odd_questions(asked, endpoint, spark, tmp_path):
    kept = f"file://{tmp_path}/kept"
    none = spark.createDataFrame([], "query_id string, question string")
    assert answers.answer(asked, none, kept).count() == 0 and not endpoint.calls
    for bad in ({"tasks": 0}, {"concurrent": 0}, {"attempts": 0}, {"wave": 0}, {"pause": -1}):
        with pytest.raises(ValueError):
            answers.answer(asked, none, kept, **bad)
    empty = engine.Engine(spark, config.replace(asked.settings, index_dir=f"file://{tmp_path}/none"), asked.embedder, asked.scorer)
    one = spark.createDataFrame([("a", "question")], none.schema)
    assert [tuple(r)[:3] for r in answers.answer(empty, one, kept).collect()] == [("a", engine.NO_CONTEXT, None)] and not endpoint.calls


def test_command(asked, endpoint, tmp_path, capsys):
    (tmp_path / "q.yaml").write_text("- {id: q1, question: where, answerable: true, sources: [way]}\n- {id: q2, question: refused, answerable: false}\n")
    args = ["answers", "--questions", str(tmp_path / "q.yaml"), "--kept", f"file://{tmp_path}/kept", "--output", f"file://{tmp_path}/out"]
    assert cli.main(args, asked) == 1 and "answered: 1, failed: 1" in capsys.readouterr().out
    rows = [json.loads(line) for f in (tmp_path / "out").glob("*.json") for line in f.read_text().splitlines()]
    assert {r["query_id"]: r.get("answer") for r in rows} == {"q1": "about where", "q2": None}
