"""Chunks and vectors."""

from pyspark.sql import functions as F

from dossier.functions.rows import rows_of
from dossier.functions.vectors import hash_embed, l2_normalise, vectors_from_payload
from dossier.operators import chunking, embedding
from dossier.sources import corpus
from workload.base import query, scratch, table, texts
from workload.sources import structured_cases

# Word positions with the characters taken so far; where a chunk from each word ends, and where
# the next one begins; then the chain of chunk starts from the first word.
_PACKED = r"""
WITH RECURSIVE words AS (SELECT {key}, string_split_regex(trim({text}, E' \n\t'), '\s+') AS w FROM {source} WHERE trim({text}, E' \n\t') <> ''),
flat AS (SELECT {key}, len(w) AS n, unnest(w) AS word, unnest(range(len(w))) AS i FROM words),
reach AS (SELECT {key}, n, i, coalesce(sum(len(word) + 1) OVER (PARTITION BY {key} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM flat
  UNION ALL SELECT {key}, any_value(n), any_value(n), sum(len(word) + 1) FROM flat GROUP BY {key}),
ends AS (SELECT s.*, greatest(s.i + 1, e.i) AS e FROM (SELECT *, c + {size} + 1 AS lim FROM reach WHERE i < n) s
  ASOF JOIN (SELECT {key}, i, c FROM reach) e ON {on_e} AND s.lim >= e.c),
ends2 AS (SELECT s.*, r.c AS c_end, r.c - {overlap} AS low FROM ends s JOIN reach r ON {on_r} AND r.i = s.e),
nexts AS (SELECT s.*, greatest(s.i + 1, j.i) AS nxt FROM ends2 s ASOF JOIN (SELECT {key}, i, c FROM reach) j ON {on_j} AND s.low <= j.c),
chain AS (SELECT {key}, n, i, e, nxt, 0 AS piece FROM nexts WHERE i = 0
  UNION ALL SELECT {x_key}, x.n, x.i, x.e, x.nxt, chain.piece + 1 FROM chain JOIN nexts x ON {on_x} AND x.i = chain.nxt WHERE chain.e < chain.n),
pieces AS (SELECT {c_key}, piece, array_to_string(w[chain.i + 1 : chain.e], ' ') AS text FROM chain JOIN words ON {on_w})"""


def packed_sql(keys: list[str], text: str, source: str, size: int, overlap: int) -> str:
    on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys)
    pre = lambda a: ", ".join(f"{a}.{k}" for k in keys)
    values = dict(key=", ".join(keys), text=text, source=source, size=size, overlap=overlap,
                  on_e=on("s", "e"), on_r=on("s", "r"), on_j=on("s", "j"), on_x=on("x", "chain"),
                  on_w=on("words", "chain"), x_key=pre("x"), c_key=pre("chain"))
    sql = _PACKED
    for name, value in values.items():
        sql = sql.replace("{" + name + "}", str(value))
    return sql


def document_pages(spark, sf):
    """A page per line of a document."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("p", "text")
    ).select("document_id", (F.col("p") + 1).alias("page_number"), "text")


PAGES_SQL = r"""(SELECT doc_id AS document_id, unnest(range(1, len(p) + 1)) AS page_number, unnest(p) AS text
  FROM (SELECT doc_id, string_split(text, E'\n') AS p FROM documents))"""


@query("c1_chunk_fixed", packed_sql(["doc_id"], "text", "documents", 800, 100) + """
SELECT doc_id, piece::INT AS piece, len(text)::INT AS n_chars, md5(text) AS text_md5 FROM pieces""")
def chunk_fixed(spark, sf):
    """Each whole document as one page."""
    pieces = chunking.chunk_pages(texts(spark, sf, "documents", "doc_id", "text"))
    return pieces.select("doc_id", "piece", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


_CASES_SQL = r"""sections AS (
  SELECT 'D-' || doc_id AS case_id, doc_id, source, lang, n_chars, s AS position, CASE s WHEN 0 THEN 'opening' ELSE 'body' END AS section,
    CASE s WHEN 0 THEN string_split(text, E'\n')[1] ELSE substr(text, len(string_split(text, E'\n')[1]) + 1) END AS text
  FROM documents, (SELECT unnest([0, 1]) AS s)),
worded AS (SELECT *, string_split_regex(trim(text, E' \n\t'), '\s+') AS w FROM sections WHERE trim(text, E' \n\t') <> ''),
counted AS (SELECT *, CASE WHEN len(w) <= 200 THEN 1 ELSE ceil((len(w) - 200) / 160.0)::INT + 1 END AS n FROM worded),
windows AS (SELECT *, unnest(range(n)) AS k FROM counted),
cut AS (SELECT case_id, doc_id, section, source, lang, n_chars, position, k, array_to_string(w[k * 160 + 1 : k * 160 + 200], ' ') AS body FROM windows)"""


@query("c2_chunk_windows", f"""
WITH {_CASES_SQL}
SELECT case_id, section, (row_number() OVER (PARTITION BY case_id ORDER BY position, k) - 1)::INT AS chunk_index, md5(body) AS body_md5 FROM cut""")
def chunk_windows(spark, sf):
    return chunking.chunk_windows(structured_cases(spark, sf)).select(
        "case_id", "section", "chunk_index", F.md5("body").alias("body_md5"))


@query("a7_write_chunks", f"""
WITH {_CASES_SQL} SELECT 'documents' AS source, count(*) AS n, count(*) AS n_whole FROM cut""")
def write_chunks(spark, sf):
    path = scratch(spark, "chunks")
    corpus.write_chunks(chunking.chunk_windows(structured_cases(spark, sf)), path, "documents")
    back = spark.read.schema(
        "source string, case_id string, header string, body string, text string").json(path)
    return back.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("text") == F.concat_ws("\n", "header", "body")).alias("n_whole"))


@query("c3_chunk_header", f"""
WITH {_CASES_SQL}
SELECT DISTINCT case_id, section, '[القضية ' || case_id || ' | ' || source || CASE WHEN lang <> 'en' THEN ' | ' || lang ELSE '' END
  || CASE WHEN n_chars <= 1000 THEN ' | ' || n_chars ELSE '' END || ' | القسم: ' || section || ']' AS header FROM cut""")
def chunk_header(spark, sf):
    return chunking.chunk_windows(structured_cases(spark, sf)).select(
        "case_id", "section", "header").distinct()


_NUMBERED = packed_sql(["document_id", "page_number"], "text", PAGES_SQL, 200, 40)


@query("c4_document_numbering", _NUMBERED + """
SELECT document_id, page_number::INT AS page_number, row_number() OVER (PARTITION BY document_id ORDER BY page_number, piece) - 1 AS sequence,
  md5(text) AS text_md5 FROM pieces""")
def numbering(spark, sf):
    """Numbers run over the pages of a document."""
    found = chunking.chunk_fixed(document_pages(spark, sf), 200, 40)
    return found.select("document_id", "page_number", "sequence", F.md5("text").alias("text_md5"))


@query("c4_document_numbering_nested", _NUMBERED + """
SELECT document_id, page_number::INT AS page_number, (row_number() OVER (PARTITION BY document_id ORDER BY page_number, piece) - 1)::INT AS sequence,
  md5(text) AS text_md5 FROM pieces""")
def numbering_nested(spark, sf):
    """The same for documents that hold their pages in one row: no shuffle."""
    page = F.transform(F.split("text", "\n"), lambda t, i: F.struct((i + 1).alias("page_number"), t.alias("text")))
    docs = texts(spark, sf, "documents", "doc_id", "text").select(F.col("doc_id").alias("document_id"), page.alias("pages"))
    found = rows_of(docs, ["document_id"], chunking.chunk_document(F.col("pages"), 200, 40), "n", "c")
    return found.select("document_id", "c.*").select("document_id", "page_number", "sequence", F.md5("text").alias("text_md5"))


@query("c5_total_in_case", f"""
WITH {_CASES_SQL} SELECT case_id, section, count(*) AS n, (count(*) + coalesce(any_value(o.n), 0))::INT AS total_in_case
FROM cut c LEFT JOIN (SELECT case_id AS ci, section AS si, count(*) AS n FROM cut GROUP BY ALL) o ON o.ci = c.case_id AND o.si <> c.section GROUP BY ALL""")
def total(spark, sf):
    """The array's own count and the counted one agree."""
    made = chunking.chunk_windows(structured_cases(spark, sf)).withColumnRenamed("total_in_case", "own_total")
    both = chunking.total_in_case(made)
    return both.where(F.col("own_total") == F.col("total_in_case")).groupBy("case_id", "section").agg(
        F.count(F.lit(1)).alias("n"), F.max("total_in_case").cast("int").alias("total_in_case"))


@query("c6_preview_chunks", packed_sql(["document_id", "page_number"], "text", PAGES_SQL, 200, 40) + r"""
SELECT document_id, page_number::INT AS page_number, piece::INT AS piece, CASE WHEN len(text) > 80 THEN substr(text, 1, 80) || '…' ELSE text END AS text,
  len(string_split(text, ' '))::INT AS n_words FROM pieces WHERE page_number BETWEEN 2 AND 5""")
def preview(spark, sf):
    pieces = chunking.chunk_pages(document_pages(spark, sf), 200, 40)
    return chunking.preview_chunks(pieces, 2, 5, 80).select(
        "document_id", "page_number", "piece", "text", "n_words")


# --- vectors ------------------------------------------------------------------------------

_HASHED = """
WITH raw AS (SELECT doc_id, list_transform(range(16), lambda i: ('0x' || substr(sha256('0:' || text), i * 2 + 1, 2))::INT / 255.0::DOUBLE - 0.5) AS v FROM documents),
unit AS (SELECT doc_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM raw)
SELECT doc_id, round(v[1], 6) AS v0, round(v[8], 6) AS v7, round(v[16], 6) AS v15, len(v)::INT AS width FROM unit"""


@query("d1_hash_embed", _HASHED)
def hashed(spark, sf):
    vectors = texts(spark, sf, "documents", "doc_id", "text").select("doc_id", hash_embed(F.col("text"), 16).alias("v"))
    return vectors.select("doc_id", *[F.round(F.col("v")[i], 6).alias(f"v{i}") for i in (0, 7, 15)],
                          F.size("v").alias("width"))


@query("d2_l2_normalise", """
WITH scaled AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: CASE WHEN label = 3 THEN 0 ELSE x * (label + 1) END) AS v FROM embeddings),
unit AS (SELECT vec_id, CASE WHEN list_dot_product(v, v) = 0 THEN list_prepend(1.0::DOUBLE, list_transform(range(63), lambda i: 0.0::DOUBLE))
  ELSE list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) END AS v FROM scaled)
SELECT vec_id, round(v[1], 6) + 0.0 AS v0, round(v[64], 6) + 0.0 AS v63, round(list_dot_product(v, v), 6) AS square FROM unit""")
def normalised(spark, sf):
    """Vectors of other lengths; those of one label are zero."""
    scaled = F.transform("embedding", lambda x: F.when(F.col("label") == 3, F.lit(0.0)).otherwise(
        x.cast("double") * (F.col("label") + 1)))
    unit = table(spark, sf, "embeddings").select("vec_id", l2_normalise(scaled, 64).alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x)
    return unit.select("vec_id", (F.round(F.col("v")[0], 6) + 0.0).alias("v0"),
                       (F.round(F.col("v")[63], 6) + 0.0).alias("v63"), F.round(square, 6).alias("square"))


@query("d3_embed", _HASHED.replace("round(v[1], 6)", "round(v[1], 4)").replace("round(v[8], 6)", "round(v[8], 4)")
       .replace("round(v[16], 6)", "round(v[16], 4)"))
def embedded(spark, sf):
    vectors = embedding.embed(texts(spark, sf, "documents", "doc_id", "text"),
                              lambda: embedding.HashProvider(16), 16)
    value = lambda i: F.round(F.col("embedding")[i].cast("double"), 4)
    return vectors.select("doc_id", *[value(i).alias(f"v{i}") for i in (0, 7, 15)],
                          F.size("embedding").alias("width"))


@query("d4_vectors_from_payload", """
SELECT event_id, CASE event_type WHEN 'error' THEN 'Unexpected response shape' WHEN 'signup' THEN 'Expected 2 vectors, got 1'
    WHEN 'view' THEN 'Model produced a 1-wide vector, expected 2' ELSE '' END AS error,
  CASE WHEN event_type IN ('click', 'purchase') THEN value ELSE -1 END AS second FROM events""")
def payload(spark, sf):
    v = F.col("value").cast("string")
    item = lambda i, body: F.concat(F.lit(f'{{"index":{i},"embedding":['), body, F.lit("]}"))
    pair = F.concat(v, F.lit(",1.5"))
    kind = F.col("event_type")
    body = (
        F.when(kind == "error", F.lit('{"message": "no"}'))
        .when(kind == "signup", F.concat(F.lit('{"data":['), item(0, pair), F.lit("]}")))
        .when(kind == "view", F.concat(F.lit('{"data":['), item(1, pair), F.lit(","), item(0, v), F.lit("]}")))
        # Out of order: the vector with index 1 comes first.
        .otherwise(F.concat(F.lit('{"data":['), item(1, pair), F.lit(","), item(0, F.lit("0.25,0.5")), F.lit("]}")))
    )
    parsed = table(spark, sf, "events").select(
        "event_id", vectors_from_payload(body, F.lit(2), 2).alias("p"))
    return parsed.select("event_id", F.coalesce("p.error", F.lit("")).alias("error"),
                         F.coalesce(F.col("p.vectors")[1][0], F.lit(-1.0)).alias("second"))


@query("d5_width_report", """
SELECT len(embedding)::INT AS width, count(*) AS n, len(embedding) = 64 AS fits FROM embeddings GROUP BY 1, 3""")
def widths(spark, sf):
    kept = embedding.require_width(table(spark, sf, "embeddings"), 64)
    return embedding.width_report(kept, 64)
