from sextant.sources.html import Section, extract, parse
from sextant.sources.legal import article_warning, article_worth


def paths(sections):
    return [(s.heading_level, s.path, s.parent_path) for s in sections]


def test_page_without_headings():
    title, got = extract("<html><title> A  B </title><body><nav>x</nav>one<p>two</body>")
    assert title == "A B" and len(got) == 1 and "one" in got[0].text and "x" not in got[0].text


def test_heading_stack_and_empty_section():
    _, got = extract("<body><h1>Top</h1><p>a<p>b<h2>Empty</h2><h2>Sub</h2><li>c</li><h3>Deep</h3><p>d</p><h1>Next</h1><p>e</p></body>")
    assert paths(got) == [(1, "h1-top", None), (2, "h1-top/h2-sub", "h1-top"), (3, "h1-top/h2-sub/h3-deep", "h1-top/h2-sub"), (1, "h1-next", None)]
    assert got[0].text == "a b"


def test_empty_page():
    assert extract(None) == ("Documento", [])


ACT = """<div class="ato"><p>O Diretor resolve:</p><p>CAPÍTULO I</p><p style="text-align: center">DAS DISPOSIÇÕES</p>
<p>Seção I</p><p>Art. 1º Primeiro texto. Art. 2º Segundo texto.</p><p>Terceiro Art.</p><p>3. Texto do três,</p>
<p>Art. 12 O produto</p><p>Art. 10-A Letra</p><p>Art. 10 Numero</p><p>Art. 3 Texto inteiro do artigo três.</p>
<p>Fim do texto. CAPÍTULO II</p><p>sem artigo</p><p>ANEXO I</p><table><tr><td>a</td><td>b</td></tr></table></div>"""


def test_act():
    _, got = extract(ACT)
    assert got[0].path == "preambulo"
    by = {s.heading_text: s for s in got}
    assert by["Art. 1"].text == "Art. 1o Primeiro texto." and by["Art. 2"].heading_level == 5
    assert by["Art. 3"].text == "Art. 3 Texto inteiro do artigo três.\nFim do texto."  # the better copy, in the first one's place
    assert [s.heading_text for s in got].index("Art. 3") < [s.heading_text for s in got].index("Art. 12")
    assert by["Art. 12"].text.endswith("O produto") and "Art. 10-A" in by and "Art. 10" in by
    assert by["CAPÍTULO II"].heading_level == 1 and by["Notas finais"].text == "sem artigo" and by["Notas finais"].parent_path == by["CAPÍTULO II"].path
    annex = [s for s in got if s.heading_text == "ANEXO I"]
    assert annex[-1].path.endswith("/conteudo") and annex[-1].parent_path is None and annex[-1].text == "a | b"
    assert len({s.path for s in got}) == len(got)


def test_repeated_document_is_cut():
    twice = ACT.replace("</div>", "<p>CAPÍTULO I</p><p>Art. 1 Outra vez</p></div>")
    assert paths(extract(twice)[1]) == paths(extract(ACT)[1])


def test_article_warning():
    page = lambda n: parse("".join(f"<p>Art. {i} texto e Art. {i} de novo</p>" for i in range(n)) + "<p>ver Art. 9</p>")
    assert article_warning(page(6), []) and not article_warning(page(4), [])


def act(*paragraphs):
    return extract('<div class="ato">' + "".join(f"<p>{p}</p>" for p in paragraphs) + "</div>")[1]


def test_articles_in_mid_line():
    got = {s.heading_text: s.text for s in act("Art. 1 Texto Art. 2 Outro; e Art. 3 Mais", "prefixo Art. 4 Quarto")}
    assert got == {"Art. 1": "Art. 1 Texto", "Art. 2": "Art. 2 Outro; e", "Art. 3": "Art. 3 Mais\nprefixo", "Art. 4": "Art. 4 Quarto"}


def test_glued_headings():
    got = act("Publicação. CAPÍTULO I Das regras Seção II Do prazo", "Art. 1 Um")
    assert [s.heading_text for s in got][:3] == ["Preâmbulo", "CAPÍTULO I Das regras", "Seção II Do prazo"] and got[-1].parent_path == got[2].path


def test_article_number_in_the_next_block():
    assert {s.heading_text: s.text for s in act("Art. 1 Um Art.", "2. Dois", "Art.")} == {"Art. 1": "Art. 1 Um", "Art. 2": "Art. 2. Dois\nArt."}


def test_better_copy_of_an_article():
    got = {s.heading_text: s.text for s in act("Art. 1 Curto", "Art. 2 Dois", "Art. 1 Texto bem mais longo")}
    assert got["Art. 1"] == "Art. 1 Texto bem mais longo"
    assert article_worth(Section(5, "Art. 1", "a", None, "longo texto e ANEXO")) < article_worth(Section(5, "Art. 1", "a", None, "curto"))


def test_act_that_is_there_twice():
    head = '<p style="text-align:center">DIRETORIA COLEGIADA</p>'
    page = f'<div class="ato">{head}<p>Art. 1 Um</p><p>Art. 2 Dois</p>{head}<p>Art. 3 fora</p></div>'
    assert [s.heading_text for s in extract(page)[1]] == ["Preâmbulo", "Art. 1", "Art. 2"]
    again = act("Art. 1 Um", "ANEXO I", "conteudo", "MINISTÉRIO DA SAÚDE", "Art. 2 fora")
    assert [s.heading_text for s in again] == ["Art. 1", "ANEXO I", "ANEXO I"] and "fora" not in again[-1].text


def test_queries_read_closed_references_only(spark, tmp_path):
    """A title cut within a reference: its SQL keeps what has no semicolon."""
    import duckdb

    from sextant.plans.queries import ORACLE_SQL, QUERIES

    heads = ["a&amp;&amp", "b &am", "c&lt", "d&quot;&#x27", "e&amp;lt;", "f & g&", "plain"]
    pages = [(i, f"u{i}", f"<html><title>{h}</title><body><article><h1>{h}</h1><p>text {h}</p></article></body></html>") for i, h in enumerate(heads)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    for name in ("html_title", "html_nodes"):
        frame = QUERIES[name](spark, str(tmp_path))
        cursor = con.execute(ORACLE_SQL[name])
        columns = [c[0] for c in cursor.description]
        assert sorted(map(repr, map(tuple, frame.select(columns).collect()))) == sorted(map(repr, cursor.fetchall()))
    assert extract("<title>a&amp</title>")[0] == "a&" and extract("<title>a&amp</title>", closed=True)[0] == "a&amp"


def test_parents_of_nodes_without_a_join(spark):
    """One row a section, pages parsed once: the parent is an earlier section of the same version, also where a path repeats."""
    from sextant.operators.ingest import digest, node_rows
    from sextant.sources.pages import SECTIONS

    section = lambda i, path, parent: (i, 1, None, path, parent, "t")
    versions = [("a", [section(0, "x", None), section(1, "x", None), section(2, "x/y", "x"), section(3, "z", "later"), section(4, "later", None)]), ("b", [section(0, "x/y", "x")]), ("c", None)]
    frame = node_rows(spark.createDataFrame(versions, f"version_id string, sections {SECTIONS}"))
    ids = {r["n"]: r["v"] for r in spark.createDataFrame([("x",)], "p string").selectExpr("'a' AS version_id", "p").select(digest("version_id", "p").alias("v"), "p").toDF("v", "n").collect()}
    got = [(r["version_id"], r["node_index"], r["parent_id"]) for r in frame.orderBy("version_id", "node_index").collect()]
    assert got == [("a", 0, None), ("a", 1, None), ("a", 2, ids["x"]), ("a", 3, None), ("a", 4, None), ("b", 0, None)]
    assert "Join" not in frame._jdf.queryExecution().executedPlan().toString()
