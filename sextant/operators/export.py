"""Exports and reports: JSON lines, the manual prompt, integrity aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a heading in the middle of a text looks like.
STRUCTURE = r"(?iu)(^|\n)\s*(cap[íi]tulo|se[cç][ãa]o|subse[cç][ãa]o|anexo)\s+[ivxlc\d]+"


def node_lines(nodes: DataFrame, versions: DataFrame, documents: DataFrame) -> DataFrame:
    """value: a JSON object a node, in the order of version and node."""
    rows = nodes.join(versions.select("version_id", "document_id"), "version_id").join(documents.select("document_id", "title", "source_org", "doc_type"), "document_id")
    body = F.struct("version_id", "document_id", "title", "source_org", "doc_type", "node_id", "parent_id", "node_index", "path", "heading_level", "heading_text", F.length("text_normalized").alias("chars"), F.col("text_normalized").alias("text"))
    return rows.select("version_id", "node_index", F.to_json(body, {"ignoreNullFields": "false"}).alias("value")).orderBy("version_id", "node_index").select("value")


def chunk_lines(chunks: DataFrame) -> DataFrame:
    """value: a JSON object a chunk, in the order of version and chunk."""
    body = F.struct("chunk_id", "version_id", "pipeline_version", "chunk_index", "chunk_hash", "tokens_count", F.length("text").alias("chars"), F.left("text", F.lit(220)).alias("preview"), "node_refs")
    return chunks.select("version_id", "chunk_index", F.to_json(body, {"ignoreNullFields": "false"}).alias("value")).orderBy("version_id", "chunk_index").select("value")


def write_lines(lines: DataFrame, path: str) -> None:
    """Gzipped JSON lines; sorted output stays sorted by file name."""
    lines.write.mode("errorifexists").option("compression", "gzip").text(path)


# The instructions and marks of the manual prompt.
INSTRUCTIONS = """Você é um assistente de inteligência regulatória especializado em normas da Anvisa.

INSTRUÇÕES:
- Responda exclusivamente com base nos trechos fornecidos abaixo.
- Não utilize conhecimento externo.
- Organize a resposta nos seguintes blocos:
  1) Composição e elegibilidade (≤ 0,2% THC)
  2) Condições de prescrição e uso
  3) Restrições regulatórias do produto
  4) Rotulagem, embalagem e rastreabilidade
  5) Requisitos da empresa e Autorização Sanitária
- Cite sempre o artigo correspondente no formato: (RDC 327/2019, Art. X).
- Se alguma informação não constar nos trechos, declare explicitamente: "Não consta nos trechos fornecidos."
"""
RULE = "\n----------------------------------------\n\n"


def prompt(result: dict) -> str:
    """The text for a manual run of a language model: instructions, question, and the results by rank with their headings."""

    def part(r: dict) -> str:
        headings = ", ".join(sorted({c["heading"] for c in r["citations"] if c.get("heading")})) or "sem_heading"
        return f"### TRECHO {r['rank']}\nDocumento: {r['document'].get('title') or 'sem_titulo'}\nArtigos/Nós: {headings}\n\n{r['chunk']['text']}\n"

    return f"{INSTRUCTIONS}\nPERGUNTA:\n{result['query']}\n\nCONTEXTO REGULATÓRIO:\n\n" + RULE.join(part(r) for r in sorted(result["results"], key=lambda r: r["rank"]))


def status_counts(versions: DataFrame) -> DataFrame:
    return versions.groupBy("status").agg(F.count(F.lit(1)).alias("n")).orderBy("status")


def leaks(nodes: DataFrame) -> DataFrame:
    """Nodes whose text still holds a structural heading."""
    return nodes.where(F.col("text_normalized").rlike(STRUCTURE)).select("version_id", "node_index", "path", F.left("text_normalized", F.lit(220)).alias("preview"))


def article_report(versions: DataFrame, documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """title, version_id, n_nodes, n_articles, n_numbers and the numbers in order; versions without nodes too."""
    article = F.col("heading_text").rlike(r"(?iu)^art\.")
    number = F.regexp_replace("heading_text", r"\D", "")
    label = F.when(article, number)
    own = nodes.select("version_id", "heading_text").withColumns({"article": article, "label": label})
    counts = own.groupBy("version_id").agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if("article").alias("n_articles"), F.countDistinct("label").alias("n_numbers"), F.array_sort(F.collect_set(F.struct(F.nullif("label", F.lit("")).try_cast("int").alias("n"), F.col("label").alias("label")))).alias("numbers"))
    labels = F.array_join(F.transform(F.filter("numbers", lambda x: x["label"].isNotNull()), lambda x: x["label"]), ",")
    rows = versions.select("version_id", "document_id").join(documents.select("document_id", "title"), "document_id").join(counts, "version_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("title", "version_id", zero("n_nodes"), zero("n_articles"), zero("n_numbers"), F.coalesce(labels, F.lit("")).alias("numbers")).orderBy("title", "version_id")
