"""A workspace from raw videos to a report, with recorded models; the client chain; transcription around fixtures."""

import http.client
import http.server
import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from veritrail import cli
from veritrail.service import MOST_BYTES, Service, serve
from veritrail.operators import answers, synthesis
from veritrail.operators import claims as C
from veritrail.sources import models, store, video
from veritrail.workspace import Models, Workspace, workspaces

PARTS = " ".join(f"Sentence number {i} says apples and pears are fruit." for i in range(60))


def _client():
    def answer(prompt: str) -> str:
        if "JSON array" in prompt:
            ids = [line[1:-1] for line in prompt.splitlines() if line.startswith("[v")]
            return "```json\n" + json.dumps([{"claim": f"apples and pears are both fruit says {i[:2]}", "claim_type": "fact", "stance": "support", "evidence": [{"chunk_id": i, "evidence_text": "x"}], "topics": []} for i in ids] + [{"claim": "bad", "claim_type": "gossip", "stance": "support", "evidence": []}]) + "\n```"
        if "JSON object" in prompt:
            return json.dumps({"relationship": "agreement", "synthesis_note": "both"})
        return "Apples are fruit [Source 1]."

    return answer


def test_workspace(spark, tmp_path):
    videos = [{"metadata": {"video_id": f"v{k}", "title": f"T{k}", "channel": "C", "duration_seconds": 600}, "transcript": f"[00:00] Video {k} begins. {PARTS}"} for k in (1, 2)]
    src = tmp_path / "in.json"
    src.write_text(json.dumps([*videos, {"metadata": {"video_id": "v3"}, "transcript": ""}]))
    w = Workspace(spark, str(tmp_path / "w"), "demo")
    first = w.ingest(str(src))
    assert first["videos"] == 2 and first["added"] == first["chunks"] > 2
    assert w.ingest(str(src))["added"] == 0
    assert w.index() == first["chunks"]
    got = w.extract_claims(_client)
    assert got["claims"] == first["chunks"] and got["rejected"] >= 1
    assert w.extract_claims(lambda: models.Recorded({}))["claims"] == got["claims"]  # all cached
    assert w.cluster() == {"clusters": 2} and w.themes(_client) >= 1 and w.cluster() == {"clusters": 2, "reused": 1}
    text = w.report()
    assert "- **T1** — C (10:00, " in text and "### Agreement — across v1, v2" in text and "https://youtu.be/v1?t=" in text
    said = w.ask("are apples fruit?", _client)
    assert said["verified"] and said["citation_check"]["valid_citations"] == ["Source 1"]
    assert w.status()["messages"] == 2 and workspaces(spark, f"{tmp_path}/w")[0]["exchanges"] == 1
    ev = tmp_path / "ev.json"
    ev.write_text(json.dumps([{"question": "apples fruit", "category": None, "expected_chunk_ids": ["v1_c0000"]}]))
    assert {r["category"] for r in w.evaluate(str(ev))} == {"(all)", "unlabeled"}
    args = cli.parser().parse_args(["--root", f"{tmp_path}/w", "status", "demo"])
    assert cli.run(spark, args)["videos"] == 2
    assert w.delete()["vectors"] == first["chunks"] and workspaces(spark, f"{tmp_path}/w") == []


def test_ask_without_sources(spark):
    q = spark.createDataFrame([(1, "x")], "question_id long, question string")
    none = spark.createDataFrame([], "question_id long, label_no int, id long, block string")
    got = answers.ask(q, none, lambda: models.Recorded({})).first()
    assert got.answer == answers.NOTHING_FOUND and got.verified and got.citation_check.cited_count == 0
    hi = spark.createDataFrame([("Hello!",), ("Hello world",)], "m string").select(answers.is_greeting(F.col("m"))).collect()
    assert [r[0] for r in hi] == [True, False]


def test_chain():
    waits = []

    def limited(_):
        raise models.RateLimited

    assert models.ask_chain("p", ["a", "b"], {"a": limited, "b": lambda p: p + "!"}, sleep=waits.append) == "p!" and not waits
    with pytest.raises(RuntimeError):
        models.ask_chain("p", ["a"], {"a": limited}, sleep=waits.append)
    assert len(waits) == models.PASSES - 1 and all(2 * 2**n <= w <= 2 * 2**n + 1 for n, w in enumerate(waits))
    assert models.chain_of("auto", {"grok", "gemini"}) == ["gemini", "grok"] and models.chain_of("auto", set()) == ["ollama"]
    assert models.backend_of("chat", {"CHAT_BACKEND": "A, b", "LLM_BACKEND": "c"}) == "a, b" and models.chain_of("a, b", set()) == ["a", "b"]


def test_adjudicated_clusters(spark):
    rows = spark.createDataFrame([(0, i, f"c{i}", v, f"t{i}", x) for i, (v, x) in enumerate([("a", [1.0, 0.0]), ("a", [0.85, 0.5268]), ("b", [0.8, 0.6]), ("b", [0.0, 1.0])])], "workspace_id long, ord long, claim_id string, video string, claim string, vector array<double>")
    no = {r.claim_id: r.cluster_id for r in synthesis.cluster_adjudicated(rows, lambda: lambda *_: False).collect()}
    yes = {r.claim_id: r.cluster_id for r in synthesis.cluster_adjudicated(rows, lambda: lambda *_: True).collect()}
    assert len(set(no.values())) == 4 and yes["c1"] == yes["c0"] == yes["c2"] != yes["c3"]

    def broken(*_):
        raise OSError

    assert sum(r.errors for r in synthesis.cluster_adjudicated(rows, lambda: broken).collect()) >= 2


def test_transcription(spark, tmp_path):
    got = video.payload("u", lambda url, folder: (f"{folder}/a", {"video_id": "v", "other": 1}), lambda audio: [(0, "a "), (61.5, "b")])
    assert got["transcript"] == "[00:00] a\n[01:01] b" and got["metadata"]["video_id"] == "v" and "other" not in got["metadata"]
    path = tmp_path / "p.json"
    path.write_text("{broken")
    assert video.append_payload(str(path), got) == 1 and video.append_payload(str(path), got) == 2
    rows = spark.createDataFrame([("v", 1, 61.5, "b"), ("v", 0, 0.0, "a")], "video_id string, ord long, start_seconds double, text string")
    assert video.render_transcripts(rows).first().transcript == got["transcript"]


def test_routes(spark, tmp_path):
    """Every route over a workspace filled by /add and a list of URLs, one of which can't be fetched."""

    def fetch(url: str) -> dict:
        if url == "bad":
            raise OSError("gone")
        return {"metadata": {"video_id": url, "title": url.upper(), "channel": "C", "duration_seconds": 60}, "transcript": f"[00:00] This is {url}. {PARTS}"}

    s = Service(spark, str(tmp_path / "w"), _client, fetch)
    assert s.respond("GET", "/health") == (200, {"status": "ok"}) and s.respond("GET", "/workspaces") == (200, {"workspaces": []})
    assert [s.respond(*x)[0] for x in (("GET", "/nowhere"), ("PUT", "/add"), ("GET", "/workspaces/demo"), ("GET", "/claims/demo"), ("DELETE", "/workspaces/demo"), ("GET", "/report/a b"), ("POST", "/chat"))] == [404, 405, 404, 404, 404, 404, 422]
    assert s.respond("POST", "/add", {"url": "bad", "workspace_id": "demo"})[1]["detail"].endswith("gone")
    assert s.respond("POST", "/add", {"url": "v1", "workspace_id": "demo"}) == (200, {"status": "ok", "workspace_id": "demo"})
    (tmp_path / "urls.txt").write_text("# two\n\n v2 \nbad\n")
    args = cli.parser().parse_args(["--root", f"{tmp_path}/w", "batch", "demo", f"{tmp_path}/urls.txt"])
    assert ["error" in x for x in cli.run(spark, args)] == [True, True]  # no --fetch
    w = Workspace(spark, f"{tmp_path}/w", "demo")
    got = w.add_all(w.urls(f"{tmp_path}/urls.txt"), fetch, _client)
    assert got[0]["videos"] == 2 and got[0]["themes"] >= 1 and got[1] == {"url": "bad", "error": "OSError: gone"}
    detail = s.respond("GET", "/workspaces/demo/")[1]
    assert [v["video_id"] for v in detail["videos"]] == ["v1", "v2"] and detail["claim_count"] == len(s.respond("GET", "/claims/demo")[1]["claims"]) > 0
    assert s.respond("GET", "/workspaces")[1]["workspaces"] == [{"id": "demo", "videos": 2, "claims": detail["claim_count"], "has_report": True}]
    said = s.respond("POST", "/chat", {"workspace_id": "demo", "question": "are apples fruit?", "history": [{"role": "user", "content": "hi"}], "mode": "assist"})[1]
    assert said["cited_count"] == 1 and said["citations_valid"] and not said["verified"] and said["caveat"]
    assert s.respond("GET", "/messages/demo")[1]["messages"] == []
    assert len(s.respond("GET", "/themes/demo")[1]["themes"]) == detail["theme_count"] and "v1" in s.respond("GET", "/report/demo")[1]["markdown"].lower()
    assert s.respond("POST", "/transcribe", {"url": "v9"})[1]["metadata"]["video_id"] == "v9"
    assert s.respond("DELETE", "/workspaces/demo")[1]["vectors_removed"] > 0 and s.respond("GET", "/workspaces/demo")[0] == 404


def test_synthesize_clusters(spark):
    rows = [("c1", 1, "a", "apples", "v1", "support", 1), ("c1", 2, "b", "pears", "v2", "support", 1), ("c2", 3, "d", "plums", "v1", "support", 1)]
    claims = spark.createDataFrame(rows, "cluster_id string, ord long, claim_id string, claim string, video_id string, stance string, n_evidence int")
    got = {r.cluster_id: r for r in synthesis.synthesize_clusters(claims, _client).collect()}
    assert (got["c1"].relationship, got["c1"].synthesis_note, got["c1"].status) == ("agreement", "both", "ok")
    assert (got["c2"].relationship, got["c2"].synthesis_note, got["c2"].status) == ("single_source", None, "ok")


def _chunks(spark, n=7):
    rows = [("v1", i, f"v1_c{i:04d}", f"h{i}", f"text {i}") for i in range(n)]
    return spark.createDataFrame(rows, "video_id string, ord long, chunk_id string, content_hash string, text string")


def test_each_prompt_is_asked_once(spark, tmp_path):
    """Whatever reads the replies, a model gets each prompt once; a chunk of a failed batch is asked again."""
    asked, answer = spark.sparkContext.accumulator(0), _client()

    def counting():
        def client(prompt):
            asked.add(1)
            if "v1_c0005" in prompt:
                raise OSError("down")
            return answer(prompt)

        return client

    cache = spark.createDataFrame([], f"content_hash string, claims array<{C.CLAIM}>")
    fresh, rejected = synthesis.extract_claims(_chunks(spark), cache, counting)
    got = {r.content_hash: r.claims for r in fresh.collect()}
    assert (fresh.count(), rejected.count()) == (5, 1) and asked.value == 2
    assert set(got) == {f"h{i}" for i in range(5)}
    assert got["h3"][0].claim_type == "fact" and got["h3"][0].stance == "support" and got["h3"][0].evidence[0].chunk_id == "v1_c0003"
    again, _ = synthesis.extract_claims(_chunks(spark), fresh, _client)
    assert {r.content_hash for r in again.collect()} == {"h5", "h6"}


def test_a_step_without_rows_replaces_the_old_ones(spark, tmp_path):
    for rows in ([("x", 1)], [], [("y", 2)]):
        df = spark.createDataFrame(rows, "a string, b int")
        store.replace_workspace(df, f"{tmp_path}/t", "w")
        got = store.read_optional(spark, f"{tmp_path}/t", "workspace_id string, a string, b int").where("workspace_id = 'w'")
        assert [(r.a, r.b) for r in got.collect()] == rows
        store.replace_workspace(got.drop("workspace_id"), f"{tmp_path}/t", "w")  # the plan reads what it replaces
    assert spark.read.parquet(f"{tmp_path}/t").count() == 1 and [p.name for p in (tmp_path / "t").iterdir()] == ["workspace_id=w"]


def test_merge_replies():
    assert synthesis.merges('```json\n{"merge": true}\n```') and not synthesis.merges("{}")
    for bad in ("yes", "[true]"):
        with pytest.raises(ValueError):
            synthesis.merges(bad)
    agrees = synthesis.asking(lambda: lambda prompt: json.dumps({"merge": "Said in: x" in prompt}))()
    assert agrees("a", "b", "x", "") and not agrees("a", "b", "", "")


def _embedder():
    return lambda texts: [[float("query: " in t), float("apple" in t), 0.1] for t in texts]


def _scorer():
    return lambda pairs: [float(len(t)) for _, t in pairs]


def test_models_of_a_workspace(spark, tmp_path):
    """A chain of embedder and scorer; evaluation reranks fused lists; results become a file."""
    src = tmp_path / "in.json"
    src.write_text(json.dumps([{"metadata": {"video_id": "v1", "title": "T" * 80, "channel": "C", "duration_seconds": 600, "description": "0:00 Start\n5:00 Later"}, "transcript": f"[00:00] {PARTS}"}]))
    w = Workspace(spark, str(tmp_path / "w"), "demo", Models(_embedder, _scorer, "query: "))
    first = w.ingest(str(src))
    assert first["skipped"] == 0 and w.ingest(str(src))["videos_skipped"] == 1
    assert {r.nearest_chapter_title for r in w.table("chunks").collect()} == {"Start", "Later"}
    assert w.index() == first["chunks"] and w.table("vectors").first().vector[0] == 0.0
    assert w._embedded(spark.createDataFrame([("x",)], "q string"), "q", "query: ").first().vector == [1.0, 0.0, 0.1]
    ev = tmp_path / "ev.json"
    ev.write_text(json.dumps([{"question": "apples", "category": "c", "expected_chunk_ids": ["v1_c0000"]}]))
    found = {r["category"]: r["n"] for r in w.evaluate(str(ev), str(tmp_path / "out"))}
    assert found == {"(all)": 1, "c": 1}
    told = spark.read.json(str(tmp_path / "out")).first()
    longest = {r.chunk_id: len(r.text) for r in w.table("chunks").collect()}
    assert [longest[c] for c in told.retrieved_top5] == sorted(longest.values(), reverse=True)[:5]
    assert w.ask("Hello!", _client)["answer"].startswith("Hello") and w.status()["messages"] is None
    w.extract_claims(_client)
    got = w.cluster(synthesis.asking(lambda: lambda prompt: '{"merge": false}'))
    assert got["within_auto_merges"] > 0 and got["adjudication_errors"] == 0
    assert w.synthesize(_client) == {"clusters": got["clusters"], "across": 0, "themes": 0}
    assert w.synthesize(lambda: models.Recorded({}))["clusters"] == got["clusters"]
    assert w.report(str(tmp_path / "report.md")) == (tmp_path / "report.md").read_text() and w.titles() == ["T" * 60 + " (C)"]
    assert workspaces(spark, f"{tmp_path}/w")[0]["titles"] == "T" * 40


def test_large_bodies_are_refused(spark, tmp_path):
    service = Service(spark, str(tmp_path), _client, lambda url: {})
    port = 18753
    threading.Thread(target=lambda: serve(service, port), daemon=True).start()
    for _ in range(50):
        try:
            c = http.client.HTTPConnection("127.0.0.1", port, timeout=10)
            c.request("GET", "/health")
            break
        except OSError:
            time.sleep(0.1)
    assert json.loads(c.getresponse().read()) == {"status": "ok"}
    c = http.client.HTTPConnection("127.0.0.1", port, timeout=10)
    c.putrequest("POST", "/chat")
    c.putheader("Content-Length", str(MOST_BYTES + 1))
    c.endheaders()
    assert c.getresponse().status == 413


def test_http_clients():
    """Both clients against a local server, which is busy once; the chain asks the next one then."""
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, self.headers.get("Authorization"), body.get("temperature", body.get("options", {}).get("temperature"))))
            status = 429 if body["model"] == "busy" else 500 if body["model"] == "broken" else 200
            text = "chat " + body["messages"][0]["content"] if "messages" in body else "local " + body["prompt"]
            raw = json.dumps({"choices": [{"message": {"content": text}}], "response": text}).encode()
            self.send_response(status)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    assert models.chat_client(f"{url}/chat", "m", "k")("a") == "chat a" and models.local_client(f"{url}/", "m")("b") == "local b"
    assert seen == [("/chat", "Bearer k", 0), ("/api/generate", None, 0)]
    with pytest.raises(models.RateLimited):
        models.chat_client(url, "busy", "k")("a")
    with pytest.raises(RuntimeError, match="HTTP 500"):
        models.chat_client(url, "broken", "k")("a")
    make = models.chained(["x", "busy", "ok"], {"busy": lambda: models.chat_client(url, "busy", "k"), "ok": lambda: models.local_client(url, "m")})
    assert make()("c") == "local c"
    server.shutdown()


def test_first_device():
    def load(device):
        if device == "cuda":
            raise OSError("no device")
        return lambda audio: [(0.0, device)]

    assert video.on_first_device(load)("a") == [(0.0, "cpu")]
    with pytest.raises(RuntimeError):
        video.on_first_device(load, ["cuda"])
