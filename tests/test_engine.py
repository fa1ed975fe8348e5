import datetime
import json

import pytest

import __spark_entry__ as entry
from sextant import api, schemas
from sextant.operators import export, ingest, lifecycle
from sextant.operators.answer import extractive_answer
from sextant.operators.retrieve import Params, fuse
from sextant.sources.pages import json_lines_report, parsed, url_list

NOW = "2024-01-01 00:00:00"


def empty(spark, name):
    return spark.createDataFrame([], schemas.TABLES[name])


def source(text, sid="S1", rrf=0.1):
    return {"sid": sid, "text": text, "rrf_score": rrf}


def test_answer_rules():
    assert extractive_answer("x", []) == ("", [])
    two = [source("nada\naqui"), source("a\nb\no limite é 0,2 de thc\nc\nd\ne", "S2")]
    assert extractive_answer("limite 0,2 thc", two) == ("b\no limite é 0,2 de thc\nc\nd", ["S2"])
    assert extractive_answer("zzz", [source("a\nb\nc\nd\ne")]) == ("a\nb\nc\nd", ["S1"])
    assert extractive_answer("prazo", [source("x\nArt.\n51.\nprazo de dias\ny")])[0] == "Art.\n51.\nprazo de dias\ny"
    long = extractive_answer("prazo", [source("prazo " + "w" * 2000)])[0]
    assert len(long) == 1201 and long.endswith("…")


def base(spark):
    pages = spark.createDataFrame([("http://a", "<title>T</title><h1>Prazo</h1><p>o prazo final do registro</p>"), ("http://b", "<title>T</title><h1>Prazo</h1><p>o prazo final do registro</p>"), ("http://c", "<h1>X</h1><p>a</p><h1>X</h1><p>b</p>"), ("http://d", "<h1>Outro</h1><p>texto sobre registro</p><h2>Sub</h2><p>mais</p>")], "url string, html string")
    return parsed(pages)


def test_landing_is_idempotent_and_rejects_alone(spark):
    got = ingest.land(base(spark), empty(spark, "documents"), empty(spark, "document_versions"), "org", "law", NOW)
    versions, documents, nodes = got.versions.cache(), got.documents.cache(), got.nodes.cache()
    assert sorted(r["source_url"] for r in versions.collect()) == ["http://a", "http://d"]
    assert got.rejected.count() == 1
    for name, df in (("documents", documents), ("document_versions", versions), ("nodes", nodes)):
        schemas.checked(df, name)
    rows = {r["heading_text"]: r for r in nodes.collect()}
    assert rows["Sub"]["parent_id"] == rows["Outro"]["node_id"] and rows["Outro"]["parent_id"] is None
    again = ingest.land(base(spark), documents, versions, "org", "law", NOW)
    assert again.versions.count() == 0 and again.refreshed.count() == 2
    assert ingest.refresh(versions, again.refreshed).count() == 2


def test_query_ask_and_audit(spark, tmp_path):
    got = ingest.land(base(spark), empty(spark, "documents"), empty(spark, "document_versions"), "org", "law", NOW)
    chunks = lifecycle.index_versions(got.versions, got.nodes, "v1")
    versions = lifecycle.mark_indexed(got.versions, chunks)
    chunks = chunks.cache()
    kb = api.KnowledgeBase(got.documents, versions, chunks, None, str(tmp_path / "audit"))
    params = Params(30, 0, 60, 5)
    result = api.query(kb, "prazo do registro", params=params, now=NOW)
    assert not api.contract_errors(result) and result["results"][0]["rank"] == 1 and "prazo" in result["results"][0]["chunk"]["text"]
    reply = api.ask(kb, "qual o prazo?", now=NOW)
    assert "prazo" in reply["answer"]["text"] and reply["answer"]["cited_sources"] == ["S1"]
    again = api.query(kb, "prazo do registro", params=params, now="2025-01-01 00:00:00")
    assert lifecycle.stable_hash(again) == lifecycle.stable_hash(result)
    assert spark.read.parquet(kb.audit_path).count() == 3
    assert json.loads(open(api.save(result, str(tmp_path))).read())["run_id"] == result["run_id"]
    with pytest.raises(ValueError, match="empty"):
        api.query(kb, " ")
    with pytest.raises(ValueError, match="at least one"):
        api.query(kb, "x", params=Params(0, 0))
    with pytest.raises(RuntimeError, match="vector"):
        api.query(kb, "x", params=Params(0, 5))


def test_queue(spark):
    jobs = lifecycle.enqueue(empty(spark, "jobs"), spark.createDataFrame([("a",), ("b",)], "payload string"), "index", NOW)
    taken, jobs = lifecycle.lease(jobs, "w", NOW)
    job = taken.first()
    assert job["job_id"] == 1
    late = lifecycle.eligible(jobs, "2024-01-01 00:16:00").select("job_id").collect()
    assert sorted(r[0] for r in late) == [1, 2]
    failed = lifecycle.settled(jobs, 1, "failed", NOW, "boom")
    row = failed.where("job_id = 1").first()
    assert (row["status"], row["attempts"], row["last_error"], row["locked_by"]) == ("failed", 1, "boom", None)
    assert lifecycle.settled(jobs, 1, "failed", NOW, "boom", most=1).where("job_id = 1").first()["status"] == "dead"
    assert lifecycle.rearm(failed, NOW).where("status = 'queued'").count() == 2

    def work(job):
        if job["payload"] == "a":
            raise lifecycle.PermanentError("no")

    done = lifecycle.drain(lifecycle.enqueue(empty(spark, "jobs"), spark.createDataFrame([("a",), ("b",)], "payload string"), "index", NOW), work, "w", NOW, lambda df: spark.createDataFrame(df.collect(), df.schema))
    assert sorted(r["status"] for r in done.collect()) == ["dead", "done"]


def test_exports_and_reports(spark, tmp_path):
    got = ingest.land(base(spark), empty(spark, "documents"), empty(spark, "document_versions"), "org", "law", NOW)
    lines = export.node_lines(got.nodes, got.versions, got.documents)
    export.write_lines(lines, str(tmp_path / "nodes"))
    report = json_lines_report(spark, str(tmp_path / "nodes")).first()
    assert (report["total"], report["invalid"], report["errors"]) == (3, 0, [])
    (tmp_path / "bad.jsonl").write_text('{"a":1}\n\nnot json\n')
    report = json_lines_report(spark, str(tmp_path / "bad.jsonl")).first()
    assert (report["total"], report["invalid"], report["errors"]) == (3, 1, [(3, report["errors"][0]["file"], 3, "Expecting value: line 1 column 1 (char 0)", "not json")])
    assert export.article_report(got.versions, got.documents, got.nodes).count() == 2
    row = lambda i, t: {"rank": i, "chunk": {"text": t}, "document": {"title": "T"}, "citations": [{"heading": "H2"}, {"heading": "H1"}, {"heading": "H2"}]}
    text = export.prompt({"query": "q?", "results": [row(2, "second"), row(1, "first")]})
    assert text.startswith("Você é um assistente") and "PERGUNTA:\nq?\n" in text
    assert "### TRECHO 1\nDocumento: T\nArtigos/Nós: H1, H2\n\nfirst\n\n----------------------------------------\n\n### TRECHO 2" in text
    broken = got.versions.withColumn("status", __import__("pyspark").sql.functions.lit("odd"))
    with pytest.raises(ValueError, match="status"):
        schemas.checked(broken, "document_versions")


def test_url_list(tmp_path):
    (tmp_path / "urls.env").write_text('URL_B="http://b"\nURL_A=http://a\nURL_C=\nOTHER=1\n')
    assert url_list(str(tmp_path / "urls.env")) == [("URL_A", "http://a"), ("URL_B", "http://b")]
    with pytest.raises(FileNotFoundError):
        url_list(str(tmp_path / "none"))


def test_one_signal_equals_the_hybrid_without_the_other(spark):
    text = spark.createDataFrame([(1, 2.0, 1), (2, 1.0, 2)], "chunk_id long, fts_score double, fts_rank int")
    none = spark.createDataFrame([], "chunk_id long, vec_distance double, vec_rank int")
    assert fuse(text, None, 60, 5).collect() == fuse(text, none, 60, 5).collect()


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_equal_their_sql(spark, sf_small):
    import duckdb

    from sextant.plans import search, tables  # noqa: F401  they register their queries
    from sextant.plans.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t in "documents embeddings pages labels events conversations benchmark clicks".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    plain = lambda v: f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    failed = []
    for name, sql in ORACLE_SQL.items():
        frame = QUERIES[name](spark, sf_small)
        order = sorted(frame.columns)
        got = sorted(tuple(map(plain, r)) for r in frame.select(order).collect())
        cursor = con.execute(sql)
        columns = [c[0] for c in cursor.description]
        want = sorted(tuple(plain(r[columns.index(c)]) for c in order) for r in cursor.fetchall())
        if got != want:
            failed.append((name, [x for x in got if x not in want][:3], [x for x in want if x not in got][:3]))
    assert not failed


def test_embeddings():
    import numpy as np

    from sextant.functions.embed import embed, hashed, model_name

    got = np.array(embed(["um dois", "", "um dois"] * 20, hashed(16), "passage"))
    assert np.allclose(np.linalg.norm(got, axis=1), 1) and (got[0] == got[2]).all()
    assert model_name("a/b@rev") == "a/b"
    with pytest.raises(ValueError, match="role"):
        embed(["x"], hashed(), "other")


def test_warehouse(spark, tmp_path):
    from sextant.operators.warehouse import Warehouse

    home = Warehouse(spark, str(tmp_path / "kb"))
    home.bootstrap()
    home.bootstrap()
    jobs = lifecycle.enqueue(home.read("jobs"), spark.createDataFrame([("a",)], "payload string"), "index", NOW)
    home.append("jobs", jobs)
    home.replace("jobs", lifecycle.settled(home.read("jobs"), 1, "done", NOW))
    assert [r["status"] for r in home.read("jobs").collect()] == ["done"]
    with pytest.raises(ValueError, match="confirmed"):
        home.reset("elsewhere")
    home.reset(home.path)
    assert home.read("jobs").count() == 0
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "file").write_text("x")
    with pytest.raises(ValueError, match="other files"):
        Warehouse(spark, str(tmp_path / "other")).bootstrap()


def test_slugs_read_whole_texts(spark, tmp_path):
    import hashlib

    texts = [(1, "Título\ncorpo único"), (2, "Título\ncorpo outro"), (3, "a\n"), (4, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["slug"], r["plain_sha256"]) for r in entry.queries()["slugs"](spark, str(tmp_path)).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {1: ("titulo", digest("Titulo\ncorpo unico")), 2: ("titulo", digest("Titulo\ncorpo outro")), 3: ("a", digest("a\n")), 4: ("secao", None)}


def small_base(spark):
    """Three chunks of two indexed versions and one that waits, with vectors of two pipelines."""
    stamp = datetime.datetime(2024, 1, 1)
    documents = spark.createDataFrame([("d1", "T1", "org", "law", stamp), ("d2", "T2", "org", "law", stamp)], schemas.TABLES["documents"])
    versions = spark.createDataFrame([(f"v{i}", f"d{i % 2 + 1}", "READY_FOR_INDEX" if i == 3 else "INDEXED", "http://x", None, 200, stamp, f"h{i}", stamp) for i in (1, 2, 3)], schemas.TABLES["document_versions"])
    texts = {1: "O prazo de registro do produto", 2: "Os registros vencem", 3: "prazo registro"}
    chunks = spark.createDataFrame([(f"c{i}", f"v{i}", "p1", 0, f"k{i}", t, [(f"n{i}", "p", "H", 0, len(t))], 3, stamp) for i, t in texts.items()], schemas.TABLES["embedding_chunks"])
    vectors = spark.createDataFrame([("c1", "m@1", "p1", [1.0, 0.0], stamp), ("c2", "m@1", "p1", [0.0, 1.0], stamp), ("c1", "m@1", "p0", [0.0, 1.0], stamp), ("c3", "m@1", "p1", [1.0, 0.0], stamp)], schemas.TABLES["chunk_embeddings"])
    return api.KnowledgeBase(documents, versions, chunks, vectors, provider=lambda texts: [[1.0, 0.0] if t == "query: prazo" else [0.0, 1.0] for t in texts])


def test_contract_and_filters(spark):
    kb = small_base(spark)
    result = api.query(kb, "prazo", params=Params(10, 10, 60, 5), pipeline_version="p1", model="m@1", now=NOW)
    assert api.contract_errors(result) == [] and result["retrieval"] == {"version_id": None, "pipeline_version": "p1", "embedding_model_id": "m@1", "n1_fts": 10, "n2_vec": 10, "rrf_k": 60, "top_k": 5}
    first, second = result["results"]  # the vector of another pipeline and the chunk of a waiting version take no part
    assert first["chunk"] == {"chunk_id": "c1", "version_id": "v1", "chunk_index": 0, "tokens_count": 3, "text": "O prazo de registro do produto"}
    assert first["scores"] == {"rrf_score": 2 / 61, "fts_rank": 1, "fts_score": 1.0, "vec_rank": 1, "vec_distance": 0.0} and first["scores"]["rrf_score"] == first["rrf_score"]
    assert first["citations"] == [{"node_id": "n1", "path": "p", "heading": "H", "char_start": 0, "char_end": 30}] and first["document"]["title"] == "T2"
    assert second["chunk"]["chunk_id"] == "c2" and second["fts_rank"] is None and second["vec_rank"] == 2
    broken = result | {"results": [{k: v for k, v in first.items() if k != "scores"}]}
    assert api.contract_errors(broken) == ["result 1 lacks scores"] and api.contract_errors({"schema_version": 1})
    assert "retrieval lacks n1_fts" in api.contract_errors(result | {"retrieval": {}})


def test_parameter_matrix(spark):
    kb = small_base(spark)
    for n1, n2, k, top, want in ((30, 30, 60, 5, 2), (80, 0, 60, 5, 1), (0, 80, 60, 5, 2), (30, 30, 60, 1, 1), (30, 30, 10, 10, 2), (30, 30, 120, 10, 2)):
        result = api.query(kb, "prazo", params=Params(n1, n2, k, top))
        assert len(result["results"]) == want and not api.contract_errors(result)
    assert [r["chunk"]["chunk_id"] for r in api.query(kb, "prazo", params=Params(0, 9, 60, 9), version_id="v2")["results"]] == ["c2"]
    request_id, result = api.call(api.query, kb, {"question": "registro", "n2_vec": 0}, "own")
    assert request_id == "own" and [r["chunk"]["chunk_id"] for r in result["results"]] == ["c1", "c2"]  # registros has the stem of registro
    assert len(api.call(api.ask, kb, {"question": "prazo"})[0]) == 32 and api.health("p1")["ok"]
    with pytest.raises(api.Unauthorized):
        api.call(api.query, kb, {"question": "prazo"}, key="wrong", configured_key="right")
    with pytest.raises(ValueError, match="empty"):
        api.call(api.query, kb, {"question": ""})


def test_audit_of_a_query_must_be_written(spark, tmp_path):
    kb = small_base(spark)
    (tmp_path / "file").write_text("no folder")
    kb.audit_path = str(tmp_path / "file")
    with pytest.raises(Exception):
        api.query(kb, "prazo", params=Params(5, 0, 60, 5))
    with pytest.warns(UserWarning, match="audit"):
        assert api.ask(kb, "prazo")["answer"]["cited_sources"] == ["S1"]


def test_stored_postings_and_ladder(spark):
    from sextant.functions import fts
    from sextant.operators import retrieve

    kb = small_base(spark)
    stored = fts.postings(kb.chunks).cache()
    for text in ("prazo registro", '"prazo de registro"', "-vencem", "absent or -prazo"):
        query = fts.websearch(text)
        assert fts.search(kb.chunks, query, 9, stored).collect() == fts.search(kb.chunks, query, 9).collect()
    assert retrieve.ladder(kb.chunks, "prazo vencem", stored=stored).first()["mode"] == "or"
    assert retrieve.ladder(kb.chunks, "prazo do registro").first()["mode"] == "websearch"
    assert retrieve.ladder(kb.chunks, "nada disso").first()["mode"] == "websearch"
    assert retrieve.fts_hits(kb.chunks, "or", "prazo vencem") == 3 and retrieve.fts_hits(kb.chunks, "plain", "") == 0
    with pytest.raises(ValueError, match="form"):
        retrieve.fts_hits(kb.chunks, "odd", "prazo")


def test_worker_loop(spark):
    jobs = spark.createDataFrame([], schemas.TABLES["jobs"])
    payloads = spark.createDataFrame([(f"p{i}",) for i in range(5)], "payload string")
    state = [lifecycle.enqueue(jobs, payloads, "index", NOW).cache()]
    seen = []

    def work(job):
        seen.append(job["payload"])
        if job["payload"] == "p1":
            raise lifecycle.PermanentError("no such version")
        if job["payload"] == "p2":
            raise OSError("later")

    run = lambda **more: lifecycle.poll(lambda: state[0], lambda df: state.__setitem__(0, df), work, "w", lambda: NOW, lambda df: df.cache(), **more)
    assert run(once=True) == 1 and len(seen) == 1
    with pytest.raises(KeyboardInterrupt):
        run(wait=lambda s: (_ for _ in ()).throw(KeyboardInterrupt))
    assert sorted(seen) == ["p0", "p1", "p2", "p3", "p4"]
    assert {r["payload"]: (r["status"], r["attempts"]) for r in state[0].collect()} == {"p0": ("done", 0), "p1": ("dead", 0), "p2": ("failed", 1), "p3": ("done", 0), "p4": ("done", 0)}


def test_swap_that_breaks_off(spark, tmp_path):
    from sextant.operators.warehouse import Warehouse

    house = Warehouse(spark, str(tmp_path / "house"))
    house.bootstrap()
    stamp = datetime.datetime(2024, 1, 1)
    row = lambda i: spark.createDataFrame([(f"d{i}", "T", "org", "law", stamp)], schemas.TABLES["documents"])
    house.append("documents", row(1))
    with pytest.raises(ValueError, match="repeated"):
        house.append("documents", row(1))
    (tmp_path / "house" / "documents").rename(tmp_path / "house" / "documents.old")  # the crash
    assert house.read("documents").count() == 1
    house.replace("documents", row(2))
    assert [r["document_id"] for r in house.read("documents").collect()] == ["d2"]


def test_latest_run(spark, tmp_path):
    import os

    from sextant.sources.pages import latest_run

    for i, name in enumerate(["20240101_9_query.json", "20240101_10_query.json", "20240101_11_ask.json"]):
        (tmp_path / name).write_text('{"n": %d}' % i)
        os.utime(tmp_path / name, (1000 - i, 1000 - i))
    assert latest_run(spark, str(tmp_path)).first()["json"] == '{"n": 0}'
    assert latest_run(spark, str(tmp_path), by_name=True).first()["json"] == '{"n": 1}'
    assert latest_run(spark, str(tmp_path), "_none.json").collect() == []


def test_page_source(spark):
    import http.server
    import threading

    from sextant.sources.pages import PageSource, parsed

    class Site(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            if self.path == "/old":
                self.send_response(302)
                self.send_header("Location", "/new")
                self.end_headers()
                return
            self.send_response(200 if self.path != "/none" else 404)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.end_headers()
            self.wfile.write("<title>Prática</title><h1>A</h1><p>b</p>".encode())

        def log_message(self, *args):
            return

    site = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=site.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{site.server_port}"
    spark.dataSource.register(PageSource)
    pages = spark.read.format("pages").option("urls", f"{at}/old {at}/new").load()
    assert sorted((r["url"], r["final_url"], r["http_status"], r["title"]) for r in parsed(pages).collect()) == [(f"{at}/new", f"{at}/new", 200, "Prática"), (f"{at}/old", f"{at}/new", 200, "Prática")]
    with pytest.raises(Exception, match="404"):
        spark.read.format("pages").option("urls", f"{at}/none").load().collect()
    site.shutdown()


def test_landing_stream(spark, tmp_path):
    """Each content lands once, also when a later file brings it again; a rerun has nothing to do."""
    from sextant.streaming.landing import PAGE, hourly, into, landing

    stamp = datetime.datetime(2024, 1, 1, 10)
    page = lambda i: (f"http://{i}", f"<h1>A{i}</h1><p>text {i}</p>", stamp + datetime.timedelta(minutes=40 * i))
    write = lambda rows, name: spark.createDataFrame(rows, PAGE).write.parquet(str(tmp_path / "in" / name))
    write([page(0), page(1)], "a")
    got = []
    run = lambda: into(landing(spark, str(tmp_path / "in" / "*")), str(tmp_path / "checkpoint"), lambda df, n: got.extend(r["url"] for r in df.collect())).awaitTermination(60)
    assert run() and sorted(got) == ["http://0", "http://1"]
    write([("http://again", *page(1)[1:]), page(2)], "b")
    assert run() and sorted(got) == ["http://0", "http://1", "http://2"]
    assert run() and len(got) == 3
    batch = spark.read.schema(PAGE).parquet(str(tmp_path / "in" / "*"))
    assert sorted((r["window"]["start"].hour, r["n"]) for r in hourly(batch).collect()) == [(10, 3), (11, 1)]
