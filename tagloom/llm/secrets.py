"""Secret scan with multipart credential linking.

Strong parts (assigned values, access key ids, long hexadecimal runs) are always reported. Weak parts (account names,
opaque tokens, endpoints) say little alone: they are reported only if within `scope` characters there is a strong part
of another role, or weak parts of both other roles. Roles are identifier, secret and endpoint.

The link is an interval join over cells of `scope` characters per document: each cell is first reduced to the first and
last position per role and strength, so a part reads at most three cells and no pairs of parts are formed.

Null and empty texts have no spans. Repeated rows are scanned each by themselves. An empty table gives an empty result.
Extra columns pass through `find_secrets` only if named in `keep`; its own columns are `spans` and `row_key`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.columns import chunks_of, cut, let, matches_of, running
from tagloom.llm.registry import query, table
from tagloom.session import cut_lineage

SCOPE = 400
MASK = "[SECRET]"
# Kind, role, strong, pattern, group whose length counts, least length, what the value must contain.
KINDS = [
    ("assign", "secret", True, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, []),
    ("access", "identifier", True, r"AKIA[A-Z0-9]+", 0, 20, []),
    ("hex", "secret", True, r"[0-9a-f]{24,}", 0, 24, []),
    ("account", "identifier", False, r"""(?i:(username|user|login|client_id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)""", 2, 3, []),
    ("opaque", "secret", False, r"[A-Za-z0-9+/_=-]{20,}", 0, 20, ["[A-Z]", "[a-z]", "[0-9]"]),
    ("endpoint", "endpoint", False, r"https?://[A-Za-z0-9._:/?&=%#@~+-]+|[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(:[0-9]+)?", 0, 7, []),
]
BASE = [kind for kind, _, strong, *_ in KINDS if strong]
ROLES = ["identifier", "secret", "endpoint"]


def part_spans(text: Column, kind: str) -> Column:
    """Spans of one kind as structs (start, end)."""
    _, _, _, pattern, group, least, needs = next(k for k in KINDS if k[0] == kind)

    def good(m: Column) -> Column:
        ok = F.length(m["value"]) >= least
        for need in needs:
            ok = ok & m["value"].rlike(need)
        return ok

    return F.transform(F.filter(matches_of(text, pattern, group), good), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))


def _as_parts(kinds: list[str]) -> Column:
    """All spans of some kinds as structs that sort by start, then kind as listed."""
    order = [k[0] for k in KINDS]

    def numbered(kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), F.lit(order.index(kind)).alias("kind_no"), s["end"].alias("end")))

    return F.sort_array(F.concat(*map(numbered, kinds)))


def _linked(found: DataFrame, scope: int) -> DataFrame:
    """(row_key, weak): the weak parts that complementary parts confirm."""
    weak_kinds = [k[0] for k in KINDS if not k[2]]
    rows = found.filter(F.greatest(*(F.size(k) for k in weak_kinds)) > 0).select("row_key", F.explode(_as_parts([k[0] for k in KINDS])).alias("p"))
    role = F.element_at(F.array(*(F.lit(k[1]) for k in KINDS)), F.col("p.kind_no") + 1)
    strong = F.element_at(F.array(*(F.lit(k[2]) for k in KINDS)), F.col("p.kind_no") + 1)
    parts = rows.select("row_key", "p", role.alias("role"), strong.alias("strong"), F.floor(F.col("p.start") / scope).alias("cell"))
    cells = parts.groupBy("row_key", "cell").agg(
        *(
            extreme(F.when((F.col("role") == r) & (F.col("strong") == s), F.col("p.start"))).alias(f"{name}_{r}_{s}")
            for r in ROLES
            for s in (True, False)
            for name, extreme in (("first", F.min), ("last", F.max))
        )
    )
    probes = parts.filter(~F.col("strong")).withColumn("step", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn("cell", F.col("cell") + F.col("step"))
    met = probes.join(cells, ["row_key", "cell"])

    def near(r: str, s: bool) -> Column:
        first, last, at = F.col(f"first_{r}_{s}"), F.col(f"last_{r}_{s}"), F.col("p.start")
        hit = F.when(F.col("step") == 0, first.isNotNull()).when(F.col("step") < 0, last >= at - scope).otherwise(first <= at + scope)
        return F.coalesce(hit, F.lit(False))

    seen = met.groupBy("row_key", "p", "role").agg(*(F.max(near(r, s)).alias(f"near_{r}_{s}") for r in ROLES for s in (True, False)))
    confirmed = F.lit(False)
    for r in ROLES:
        others = [o for o in ROLES if o != r]
        any_strong = F.col(f"near_{others[0]}_True") | F.col(f"near_{others[1]}_True")
        both_weak = F.col(f"near_{others[0]}_False") & F.col(f"near_{others[1]}_False")
        confirmed = confirmed | ((F.col("role") == r) & (any_strong | both_weak))
    return seen.filter(confirmed).groupBy("row_key").agg(F.collect_list("p").alias("weak"))


def find_secrets(docs: DataFrame, text: str = "text", keep: list[str] | None = None, scope: int = SCOPE) -> DataFrame:
    """The `keep` columns of each row, its base spans by kind, and `spans`: all reported parts (start, kind_no, end) in order."""
    full = F.coalesce(F.col(text), F.lit(""))
    found = docs.select(*(keep or []), F.monotonically_increasing_id().alias("row_key"), *(part_spans(full, k[0]).alias(k[0]) for k in KINDS))
    found = cut_lineage(found, "secret-parts")
    out = found.join(_linked(found.select("row_key", *(k[0] for k in KINDS)), scope), "row_key", "left")
    base = _as_parts(BASE)
    spans = F.when(F.col("weak").isNull(), base).otherwise(F.sort_array(F.concat(base, F.col("weak"))))
    return out.select(*(keep or []), "row_key", *BASE, base.alias("base"), spans.alias("spans"))


def span_list(parts: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k[0]) for k in KINDS))
    return F.array_join(F.transform(parts, lambda p: F.concat_ws(":", F.element_at(names, p["kind_no"] + 1), p["start"], p["end"])), ",")


def redact(text: Column, spans: Column, mask: str = MASK) -> Column:
    """The text with every identifier and secret among the spans replaced by a mask, touching spans by one; endpoints stay."""
    hidden = F.filter(spans, lambda p: p["kind_no"] != [k[0] for k in KINDS].index("endpoint"))

    def build(parts: Column, reach: Column, chunks: Column) -> Column:
        piece = lambda p, i: F.when(
            p["start"] > F.coalesce(F.get(reach, i - 1), F.lit(-1)),
            F.concat(cut(chunks, F.coalesce(F.get(reach, i - 1), F.lit(0)), p["start"]), F.lit(mask)),
        ).otherwise("")
        tail = cut(chunks, F.element_at(reach, -1), F.length(text).cast("bigint"))
        return F.concat(F.array_join(F.transform(parts, piece), ""), tail)

    def masked(parts: Column) -> Column:
        ends = running(F.transform(parts, lambda p: p["end"]), 0, lambda a, b: F.greatest(a, b))
        return F.when(F.size(parts) == 0, text).otherwise(let(ends, lambda reach: let(chunks_of(text), lambda chunks: build(parts, reach, chunks))))

    return let(hidden, masked)


def _sql() -> str:
    one = []
    for n, (_, role, strong, pattern, group, least, needs) in enumerate(KINDS):
        quoted = pattern.replace("'", "''")
        checks = "".join(f" AND regexp_matches(v[i], '{need}')" for need in needs)
        one.append(f"""
          SELECT doc_id, {n} AS kind_no, '{role}' AS role, {str(strong).lower()} AS strong, s, s + length(m[i]) AS e
          FROM (SELECT *, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s
                FROM (SELECT doc_id, m, v, g, unnest(range(1, len(m) + 1)) AS i
                      FROM (SELECT doc_id, regexp_extract_all(text, '{quoted}') AS m, regexp_extract_all(text, '{quoted}', {group}) AS v,
                                   string_split_regex(text, '{quoted}') AS g FROM t)))
          WHERE length(v[i]) >= {least}{checks}""")
    names = ", ".join(f"'{k[0]}'" for k in KINDS)
    part = f"string_agg([{names}][kind_no + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind_no)"
    near = " OR ".join(
        f"(w.role = '{r}' AND (bool_or(o.strong AND o.role <> '{r}') OR (bool_or(o.role = '{a}' AND NOT o.strong) AND bool_or(o.role = '{b}' AND NOT o.strong))))"
        for r, a, b in (("identifier", "secret", "endpoint"), ("secret", "identifier", "endpoint"), ("endpoint", "identifier", "secret"))
    )
    counts = ", ".join(f"count(*) FILTER (kind_no = {n}) AS n_{k}" for n, k in enumerate(BASE))
    return f"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    p AS MATERIALIZED ({" UNION ALL ".join(one)}),
    weak AS (
      SELECT w.doc_id, w.kind_no, w.s, w.e FROM p w JOIN p o ON o.doc_id = w.doc_id AND abs(o.s - w.s) <= {SCOPE}
      WHERE NOT w.strong GROUP BY w.doc_id, w.kind_no, w.s, w.e, w.role HAVING {near}
    ),
    base AS (SELECT doc_id, {counts}, {part} AS list FROM p WHERE strong GROUP BY doc_id),
    whole AS (SELECT doc_id, {part} AS list FROM (SELECT doc_id, kind_no, s, e FROM p WHERE strong UNION ALL SELECT * FROM weak) GROUP BY doc_id)
    SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(base.list, '')) AS base_sha256, coalesce(whole.list, '') AS spans
    FROM t LEFT JOIN base USING (doc_id) LEFT JOIN whole USING (doc_id)
    """


@query("op9_secret_links", _sql())
def secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(span_list(F.col("base")), 256).alias("base_sha256"),
        span_list(F.col("spans")).alias("spans"),
    )
