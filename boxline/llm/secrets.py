"""Secret scans with corpus-wide ownership frequency.

Candidates are found by pattern, hashed, and counted by the distinct owners and
repositories that hold them. A value that one owner holds in a few repositories
looks like a live credential; one that many owners hold, or that is copied
through many repositories of one owner, is an example. Everything here is
DataFrame functions.

Positions come without a sentinel: the parts between matches and the matches
themselves alternate, so their lengths add up to every start and end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxline.llm.common import document_columns, stored, text_of


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# The kinds of secret, in the order in which equal starts are listed.
_NAMES = "|".join(either_case(name) for name in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = "(" + _NAMES + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
OPAQUE = "[A-Za-z0-9+/_-]{32,}"
KINDS = {"assign": (ASSIGN, 2, 6), "access": (ACCESS, 0, 20), "hex": (HEX, 0, 24), "opaque": (OPAQUE, 0, 32)}
BASE = ("assign", "access", "hex")
ORDER = {kind: place for place, kind in enumerate(KINDS)}

_SPAN = "array<struct<start:bigint,place:int,end:bigint,kind:string,value:string>>"


def _placed(kind: str, matches: Column, values: Column, parts: Column) -> Column:
    """Spans of one kind with start and end in code points, the short ones dropped."""
    least = KINDS[kind][2]
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr(f"cast(array() as {_SPAN})").alias("spans"))

    def step(acc, item):
        begin = acc["at"] + F.length(item["part"])
        end = begin + F.length(item["match"])
        span = F.struct(begin.alias("start"), F.lit(ORDER[kind]).alias("place"), end.alias("end"), F.lit(kind).alias("kind"), F.sha2(item["value"], 256).alias("value"))
        keep = F.length(item["value"]) >= least
        if kind == "opaque":
            keep &= item["value"].rlike("[a-z]") & item["value"].rlike("[A-Z]") & item["value"].rlike("[0-9]")
        return F.struct(end.cast("long").alias("at"), F.when(keep, F.concat(acc["spans"], F.array(span).cast(_SPAN))).otherwise(acc["spans"]).alias("spans"))

    # The part after the last match has no match beside it.
    zipped = F.arrays_zip(F.slice(parts, 1, F.size(matches)).alias("part"), matches.alias("match"), values.alias("value"))
    found = F.aggregate(zipped, start, step, lambda acc: acc["spans"])
    return F.when(F.size(matches) > 0, found).otherwise(F.expr(f"cast(array() as {_SPAN})"))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """All candidates of each row: columns ``_doc`` (the row), ``_base`` and ``_opaque`` (spans).

    Null text counts as empty. No shuffle, and no row is dropped.
    """
    rows = docs.select(F.struct(*document_columns(docs)).alias("_doc"), text_of(F.col(f"`{text}`")).alias("_text"))
    # One projection per step, so that no pattern runs twice over a text.
    rows = rows.select("*", *(F.regexp_extract_all("_text", F.lit(p), F.lit(0)).alias(f"_m_{k}") for k, (p, _, _) in KINDS.items()))
    rows = rows.select(
        "*",
        *(F.when(F.size(f"_m_{k}") > 0, F.split("_text", p, -1)).alias(f"_p_{k}") for k, (p, _, _) in KINDS.items()),
        F.when(F.size("_m_assign") > 0, F.regexp_extract_all("_text", F.lit(ASSIGN), F.lit(2))).alias("_v_assign"),
    )
    rows = rows.select(
        "_doc",
        "_text",
        *(_placed(k, F.col(f"_m_{k}"), F.col("_v_assign" if k == "assign" else f"_m_{k}"), F.col(f"_p_{k}")).alias(f"_s_{k}") for k in KINDS),
    )
    rows = rows.select("_doc", "_text", "_s_opaque", F.array_sort(F.concat(*(F.col(f"_s_{k}") for k in BASE))).alias("_base"))
    free = lambda x: ~F.exists("_base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    return rows.select("_doc", "_text", "_base", F.filter("_s_opaque", free).alias("_opaque"))


def ownership(candidates: DataFrame) -> DataFrame:
    """Distinct owners and repositories per candidate hash.

    ``candidates`` has ``value``, ``owner`` and ``repository``. Three partial
    aggregations; a value that a third of all rows hold shrinks before each
    shuffle. A null owner is an owner of its own.
    """
    repositories = candidates.groupBy("value", "owner", "repository").agg(F.count(F.lit(1)).alias("uses"))
    owners = repositories.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("uses").alias("uses"))
    return owners.groupBy("value").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"), F.sum("uses").alias("uses"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _classified(rows: DataFrame, owner: Column, repository: Column, max_owners: int, max_repositories: int) -> DataFrame:
    """Rows that have candidates, with ``_spans``: base spans, and opaque ones that are live; each has ``live``.

    ``rows`` are read from a written table and have a number ``_row`` of their own.
    """
    rows = rows.withColumn("_owner", owner).withColumn("_repository", repository)
    spans = rows.select("_row", "_owner", "_repository", F.explode(F.concat("_base", "_opaque")).alias("span")).select(
        "_row", F.col("_owner").alias("owner"), F.col("_repository").alias("repository"), "span.*"
    )
    owned = ownership(spans.select("value", "owner", "repository"))
    judged = spans.select("_row", "start", "place", "end", "kind", "value").join(owned, "value").withColumn(
        "live", (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)
    )
    # Groups are single documents, so no list outgrows one text.
    lists = judged.where(F.col("live") | (F.col("kind") != "opaque")).groupBy("_row").agg(
        F.array_sort(F.collect_list(F.struct("start", "place", "end", "kind", "live", "owners", "repositories"))).alias("_spans")
    )
    empty = "cast(array() as array<struct<start:bigint,place:int,end:bigint,kind:string,live:boolean,owners:bigint,repositories:bigint>>)"
    return rows.join(lists, "_row", "left").withColumn("_spans", F.coalesce("_spans", F.expr(empty)))


def _origin(docs: DataFrame, owner: str, repository: tuple[str, ...]) -> tuple[Column, Column]:
    field = lambda name: F.col("_doc").getField(name).cast("string") if name in docs.columns else F.lit(None).cast("string")
    return field(owner), F.to_json(F.struct(*(field(name).alias(f"k{i}") for i, name in enumerate(repository))))


def find_secrets(docs: DataFrame, text: str = "text", owner: str = "source", repository: tuple[str, ...] = ("source", "lang"), max_owners: int = 1, max_repositories: int = 2) -> DataFrame:
    """One row per document with its secrets.

    ``spans`` lists the base kinds and, as ``opaque``, long mixed tokens beside
    no base span that look live: at most ``max_owners`` owners hold them, in at
    most ``max_repositories`` repositories. ``n_live`` counts the listed spans
    that look live, ``n_example`` the others.

    Null text counts as empty; repeated rows give repeated results; an empty
    table gives an empty result; missing owner columns count as one owner.
    """
    found = scan(docs, text).select(F.struct(F.col("_doc").getField("doc_id").alias("doc_id"), *(F.col("_doc").getField(c).alias(c) for c in dict.fromkeys((owner, *repository)) if c in docs.columns)).alias("_doc"), "_base", "_opaque", F.monotonically_increasing_id().alias("_row"))
    has = (F.size("_base") > 0) | (F.size("_opaque") > 0)
    slim = stored(found, "scan")
    judged = _classified(slim.where(has), *_origin(docs, owner, repository), max_owners, max_repositories)
    count = lambda kind: F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    size = lambda test: F.size(F.filter("_spans", test)).cast("long")
    common = [F.col("_doc.doc_id").alias("doc_id"), *map(count, BASE), F.sha2(_listed(F.col("_base")), 256).alias("base_sha256")]
    none = F.lit(0).cast("long")
    with_spans = judged.select(*common, _listed(F.col("_spans")).alias("spans"), size(lambda s: s["live"]).alias("n_live"), size(lambda s: ~s["live"]).alias("n_example"))
    return with_spans.unionByName(slim.where(~has).select(*common, F.lit("").alias("spans"), none.alias("n_live"), none.alias("n_example")))


def redact(docs: DataFrame, text: str = "text", owner: str = "source", repository: tuple[str, ...] = ("source", "lang"), max_owners: int = 1, max_repositories: int = 2, mark: str = "[secret]") -> DataFrame:
    """Documents with every span that ``find_secrets`` lists replaced by ``mark``.

    Overlapping spans become one mark. Other documents pass unchanged and
    unshuffled. A column ``n_chars`` is counted anew where the text changes. Null
    text stays null; repeated rows stay; an empty table gives an empty result.
    """
    # Written once, so that the patterns run once over each text.
    found = stored(scan(docs, text).drop("_text").withColumn("_row", F.monotonically_increasing_id()), "secrets")
    found = found.withColumn("_text", text_of(F.col("_doc").getField(text)))
    has = (F.size("_base") > 0) | (F.size("_opaque") > 0)
    judged = _classified(found.where(has), *_origin(docs, owner, repository), max_owners, max_repositories)

    def step(acc, span):
        gap = F.substring(F.col("_text"), acc["at"] + 1, span["start"].cast("int") - acc["at"])
        out = F.when(span["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], span["end"].cast("int")).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rebuilt = F.aggregate("_spans", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("_text"), acc["at"] + 1, F.length("_text"))))
    dirty = judged.withColumn("_new", F.when(F.size("_spans") > 0, rebuilt).otherwise(F.col("_doc").getField(text)))

    def column(name: str) -> Column:
        kept = F.col("_doc").getField(name)
        if name == text:
            return F.col("_new").alias(name)
        if name == "n_chars":
            return F.when(F.size("_spans") > 0, F.length("_new")).otherwise(kept).cast(docs.schema[name].dataType).alias(name)
        return kept.alias(name)

    clean = found.where(~has).select(*(F.col("_doc").getField(name).alias(name) for name in docs.columns))
    return clean.unionByName(dirty.select(*map(column, docs.columns)))


def _duck(kind: str, text: str) -> str:
    """DuckDB list of (start, place, end, kind, value) for one kind, in code points."""
    pattern, group, least = KINDS[kind]
    p = pattern.replace("'", "''")
    test = f"length(v) >= {least}"
    if kind == "opaque":
        test += " AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9]')"
    return f"""SELECT n, b, b + length(m) AS e, {ORDER[kind]} AS place, '{kind}' AS kind, v FROM (
      SELECT n, m, v, sum(length(part)) OVER w + coalesce(sum(length(m)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
      FROM (SELECT n, unnest(ms) AS m, unnest(vs) AS v, unnest(ps[:len(ms)]) AS part, unnest(range(len(ms))) AS i FROM (
        SELECT n, regexp_extract_all({text}, '{p}') AS ms, regexp_extract_all({text}, '{p}', {group}) AS vs, string_split_regex({text}, '{p}') AS ps FROM d))
      WINDOW w AS (PARTITION BY n ORDER BY i)) WHERE {test}"""


def oracle(max_owners: int = 1, max_repositories: int = 2) -> str:
    base = " UNION ALL ".join(_duck(k, "t") for k in BASE)
    listed = "string_agg(kind || ':' || b::BIGINT || ':' || e::BIGINT, ',' ORDER BY b, place)"
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t, source, lang FROM documents),
    base AS MATERIALIZED ({base}),
    free AS (SELECT * FROM ({_duck("opaque", "t")}) o WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.n = o.n AND b.b < o.e AND o.b < b.e)),
    spans AS MATERIALIZED (SELECT * FROM base UNION ALL SELECT * FROM free),
    owned AS (SELECT v, count(DISTINCT coalesce('x' || source, '')) <= {max_owners} AND count(DISTINCT {{'source': source, 'lang': lang}}) <= {max_repositories} AS live FROM spans JOIN d USING (n) GROUP BY v),
    kept AS (SELECT * FROM spans JOIN owned USING (v) WHERE kind <> 'opaque' OR live),
    a AS (SELECT n, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, {listed} AS s FROM base GROUP BY n),
    k AS (SELECT n, {listed} AS spans, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example FROM kept GROUP BY n)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(s, '')) AS base_sha256,
      coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
    FROM d LEFT JOIN a USING (n) LEFT JOIN k USING (n)"""
