"""Text scalar queries over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.catalog.base import part, query
from tagloom.functions import text as X
from tagloom.functions.columns import n64, r6
from tagloom.session import staged
from tagloom.sources import tables as T

DIM = 3072

part(
    "note_words",
    r"SELECT doc_id, source, text, regexp_extract_all(text, '\p{L}+') AS w FROM documents",
)
part(
    "tagged_notes",
    r"""SELECT doc_id, source AS bucket, w[1:4] AS words,
         '# ' || array_to_string(w[1:3], ' ') || chr(10) || chr(10) || text || chr(10) || chr(10) || chr(10) || chr(10)
         || 'Tag: ' || coalesce(w[1], '') || ', ' || coalesce(w[2], '') || '、' || coalesce(w[3], '') || '， ' || coalesce(w[4], '') AS content
       FROM note_words""",
    ("note_words",),
)
part(
    "prose",
    r"""SELECT doc_id, bucket, content, trim(regexp_replace(array_to_string(list_filter(
           list_transform(regexp_split_to_array(content, '\r?\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')),
           lambda x: length(x) > 0 AND NOT starts_with(x, '#') AND NOT regexp_matches(x, '^(?i)Tag\s*[:：]')), ' '), '\s+', ' ', 'g')) AS flat
       FROM tagged_notes""",
    ("tagged_notes",),
)
part(
    "doc_tokens",
    """SELECT doc_id, token, count(*) AS c FROM (
         SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{2,}')) AS token FROM documents
       ) GROUP BY 1, 2""",
)
part(
    "doc_hashed",
    """SELECT doc_id, c, h1, xor(xor(h1, 0) * 16777619 % 4294967296, 120) * 16777619 % 4294967296 AS h2 FROM (
         SELECT doc_id, c, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(token, ''), lambda x: unicode(x)::BIGINT)),
           lambda h, x: xor(h, x) * 16777619 % 4294967296) AS h1 FROM doc_tokens)""",
    ("doc_tokens",),
)
part(
    "doc_slots_raw",
    f"""SELECT doc_id, slot, sum(w) AS w FROM (
         SELECT doc_id, (h1 % {DIM})::INTEGER AS slot, c * 1.0e0 AS w FROM doc_hashed
         UNION ALL SELECT doc_id, (h2 % {DIM})::INTEGER, c * 0.5e0 FROM doc_hashed) GROUP BY 1, 2""",
    ("doc_hashed",),
)
part(
    "doc_slots",
    """SELECT doc_id, slot, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM doc_slots_raw
       UNION ALL SELECT doc_id, 0, 1.0e0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM doc_slots_raw)""",
    ("doc_slots_raw",),
)
part(
    "doc_vec",
    f"""SELECT doc_id, list(coalesce(weight, 0) ORDER BY i) AS v FROM (
         SELECT d.doc_id, r.i, s.weight FROM documents d CROSS JOIN range({DIM}) r(i)
         LEFT JOIN doc_slots s ON s.doc_id = d.doc_id AND s.slot = r.i) GROUP BY 1""",
    ("doc_slots",),
)


def tagged_notes(spark, d):
    """Documents as notes with a heading and a closing tag line made from their first words."""
    docs = T.read_table(spark, d, "documents")
    w = F.regexp_extract_all(F.col("text"), F.lit(r"(\p{L}+)"), F.lit(1))

    def word(i):
        return F.coalesce(F.try_element_at(F.col("w"), F.lit(i)), F.lit(""))

    return docs.withColumn("w", w).select(
        "doc_id",
        F.col("source").alias("bucket"),
        F.concat(
            F.lit("# "),
            F.array_join(F.slice("w", 1, 3), " "),
            F.lit("\n\n"),
            F.col("text"),
            F.lit("\n\n\n\nTag: "),
            word(1),
            F.lit(", "),
            word(2),
            F.lit("、"),
            word(3),
            F.lit("， "),
            word(4),
        ).alias("content"),
    )


def document_slots(spark, d):
    return staged(
        spark, d, "document_slots", lambda: X.hash_slots(T.read_table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", DIM)
    )


def document_vectors(spark, d):
    """(doc_id, vector, bucket, updated_at) with hash embeddings as slots and weights."""

    def build():
        notes = T.text_notes(spark, d).select(F.col("file_id").alias("doc_id"), "bucket", "updated_at")
        return X.sparse_vectors(document_slots(spark, d), "doc_id", DIM).join(notes, "doc_id")

    return staged(spark, d, "document_vectors", build)


@query(
    "tag_line_parse",
    r"""SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_extract(content, '(?im)^Tag[ \t]*[:：][ \t]*(.+)$', 1), '[,，、]'),
          lambda t: regexp_replace(t, '^\s+|\s+$', '', 'g')), lambda t: length(t) > 0) AS tags,
        length(list_filter(words, lambda x: x IS NOT NULL)) AS n_tags FROM tagged_notes""",
    ("tagged_notes",),
)
def _(spark, d):
    return tagged_notes(spark, d).select(
        "doc_id",
        X.parse_tag_line(F.col("content")).alias("tags"),
        n64(F.size(X.parse_last_tag_line(F.col("content"))), "n_tags"),
    )


@query(
    "strip_tag_line",
    r"""SELECT doc_id, length(b) AS n_chars, sha256(b) AS body_sha FROM (
         SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(content, '(?im)^Tag[ \t]*[:：][ \t]*(.+)$', ''), '\n{3,}', chr(10) || chr(10), 'g'), '\s+$', '') AS b
         FROM tagged_notes)""",
    ("tagged_notes",),
)
def _(spark, d):
    body = X.strip_tag_line(F.col("content"))
    return tagged_notes(spark, d).select("doc_id", n64(F.length(body), "n_chars"), F.sha2(body, 256).alias("body_sha"))


@query(
    "title_chain",
    r"""SELECT doc_id, array_to_string(words[1:3], ' ') AS heading,
         CASE WHEN doc_id % 2 = 0 THEN 'T ' || doc_id::VARCHAR ELSE coalesce(nullif(array_to_string(words[1:3], ' '), ''), bucket) END AS title,
         coalesce(nullif(regexp_replace(regexp_replace(left(regexp_replace(regexp_replace(content, '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g'), 40), '', ''), '', ''), ''), 'diary') AS slug
       FROM tagged_notes""",
    ("tagged_notes",),
)
def _(spark, d):
    c = F.col("content")
    explicit = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("T "), F.col("doc_id").cast("string")))
    return tagged_notes(spark, d).select(
        "doc_id",
        F.coalesce(X.heading(c), F.lit("")).alias("heading"),
        X.title_chain(explicit, c, F.col("bucket")).alias("title"),
        X.slug(c).alias("slug"),
    )


@query(
    "prose_excerpt",
    """SELECT doc_id, CASE WHEN length(flat) > 120 THEN left(flat, 120) || '…' ELSE flat END AS excerpt,
         length(flat) AS prose_chars FROM prose""",
    ("prose",),
)
def _(spark, d):
    c = F.col("content")
    return tagged_notes(spark, d).select("doc_id", X.excerpt(c).alias("excerpt"), n64(F.length(X.prose_text(c)), "prose_chars"))


@query(
    "first_sentence",
    """SELECT doc_id, CASE WHEN length(head) > 120 THEN left(head, 120) || '…' ELSE head END AS head FROM (
         SELECT doc_id, coalesce(nullif(regexp_extract(flat, '(?s)^.{19,}?[。！？!?]'), ''), nullif(regexp_extract(flat, '(?s)^.*[。！？!?]'), ''), flat) AS head FROM prose)""",
    ("prose",),
)
def _(spark, d):
    return tagged_notes(spark, d).select("doc_id", X.first_sentence(F.col("content")).alias("head"))


@query(
    "token_estimate",
    """SELECT doc_id, (length(text) - o + ceil(o / 4))::BIGINT AS tokens FROM (
         SELECT doc_id, text, length(regexp_replace(text, '[⺀-鿿豈-﫿＀-￯]', '', 'g')) AS o FROM documents)""",
)
def _(spark, d):
    return T.read_table(spark, d, "documents").select("doc_id", X.estimate_tokens(F.col("text")).alias("tokens"))


@query(
    "continuation_tail",
    r"""SELECT doc_id, CASE WHEN length(t) > 36 THEN left(t, 36) || '…' ELSE t END AS tail FROM (
         SELECT doc_id, list_filter(list_transform(regexp_split_to_array(content, '\r?\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')),
           lambda x: length(x) > 0 AND NOT regexp_matches(x, '^(?i)tag\s*[:：]'))[-1] AS t FROM tagged_notes)""",
    ("tagged_notes",),
)
def _(spark, d):
    return tagged_notes(spark, d).select("doc_id", X.continuation_tail(F.col("content")).alias("tail"))


@query(
    "query_field",
    r"""SELECT conv_id AS session_id, turn, right(array_to_string(list(regexp_replace(text, '^\s+|\s+$', '', 'g')) OVER (
          PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), chr(10)), 4000) AS query_text
       FROM conversations WHERE length(trim(text)) > 0""",
)
def _(spark, d):
    turns = T.read_table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "text")
    return X.query_fields(turns)


@query(
    "name_predicates",
    """SELECT doc_id, regexp_matches(text, '[一-鿿]') AS cjk, length(source) > 3 AND regexp_matches(source, '^[A-Za-z0-9\\-_.\\s]+$') AS technical FROM documents""",
)
def _(spark, d):
    docs = T.read_table(spark, d, "documents")
    return docs.select("doc_id", X.contains_cjk(F.col("text")).alias("cjk"), X.technical_name(F.col("source")).alias("technical"))


@query(
    "citations",
    r"""SELECT user_id, cited, count(*) AS mentions FROM (
          SELECT user_id, unnest(list_distinct(regexp_extract_all('see D' || k || ' and XD' || k || ', D' || (k::INTEGER % 7)::VARCHAR || '!', '\bD(\d+)\b', 1))) AS cited
          FROM (SELECT user_id, regexp_extract(props, '\d+') AS k FROM events)) GROUP BY 1, 2""",
)
def _(spark, d):
    k = F.regexp_extract("props", r"\d+", 0)
    said = F.concat(F.lit("see D"), k, F.lit(" and XD"), k, F.lit(", D"), (k.cast("int") % 7).cast("string"), F.lit("!"))
    return (
        T.read_table(spark, d, "events")
        .select("user_id", F.explode(X.citations(said, digits=None)).alias("cited"))
        .groupBy("user_id", "cited")
        .agg(F.count(F.lit(1)).alias("mentions"))
    )


@query("text_hashes", "SELECT doc_id, sha256(text) AS sha, left(sha256(text), 16) AS short FROM documents")
def _(spark, d):
    return T.read_table(spark, d, "documents").select(
        "doc_id", X.text_hash(F.col("text")).alias("sha"), X.text_hash(F.col("text"), 16).alias("short")
    )


@query(
    "date_filter",
    """SELECT o_orderpriority AS bucket, count(*) AS notes FROM orders
       WHERE o_orderdate::DATE BETWEEN DATE '1996-03-01' AND DATE '1998-06-30' GROUP BY 1""",
)
def _(spark, d):
    title = F.concat(F.date_format("updated_at", "yyyy-MM-dd"), F.lit(" note"))
    files = T.note_files(spark, d).withColumn("day", X.date_prefix(title))
    return files.filter(X.in_time_range(F.col("day"), F.lit("1996-03-01~1998-06-30"))).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("notes")
    )


@query("hash_embedding", "SELECT doc_id, slot, round(weight, 6) AS weight FROM doc_slots", ("doc_slots",))
def _(spark, d):
    return document_slots(spark, d).select("doc_id", "slot", r6(F.col("weight"), "weight"))


@query(
    "draft_composition",
    r"""SELECT conv_id, turn, '# ' || title || chr(10) || chr(10) || regexp_replace(text, '^\s+|\s+$', '', 'g') || chr(10) || chr(10) || 'origin: ' || conv_id::VARCHAR || chr(10) || chr(10) || 'Tag: ' || role || ', draft' AS content
       FROM (SELECT *, left(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), 24) AS title FROM conversations)""",
)
def _(spark, d):
    note = X.compose_note(X.draft_title(F.col("text")), F.col("text"), F.array(F.col("role"), F.lit("draft")))
    mark = F.concat(F.lit("origin: "), F.col("conv_id").cast("string"))
    return T.read_table(spark, d, "conversations").select("conv_id", "turn", X.with_provenance(note, mark).alias("content"))


@query(
    "body_integrity",
    """SELECT conv_id, count(*) AS chunks, sha256(string_agg(text, chr(10) ORDER BY turn)) AS body_sha FROM conversations GROUP BY 1""",
)
def _(spark, d):
    chunks = T.read_table(spark, d, "conversations")
    ordered = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return chunks.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.sha2(F.array_join(ordered["text"], "\n"), 256).alias("body_sha")
    )
