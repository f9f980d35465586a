"""Secret scans by corpus-wide ownership frequency, in DataFrame functions only.

Every text gives spans of base kinds (assign, access, hex) and of added kinds (mixed: long tokens with digits and both
letter cases; pem: private keys from header to end line, or as far as their body goes).  Candidate values, of a key its
body, are hashed and counted over all documents by distinct
repositories and owners.  A value of one owner is live however many repositories of that owner hold it; one of several
owners is a copied example if they are many, or if it spread over many repositories; values that look repetitive are
never live, nor are headers without a body.  Mixed tokens count as spans only if live; base spans and keys always do.
Null text counts as empty and gives no spans; a null repository or owner is one of its own; repeated rows each get the
same verdict and count once; spans are code points, end exclusive, ordered by start, then kind; an empty table gives no
rows; other columns, whatever their names, play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_key, stage, whole_row

# Kinds in the order in which they are listed, and their patterns.
KINDS = ("assign", "access", "hex", "mixed", "pem")
ASSIGN = (
    "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
# Runs are maximal, so the least length can stand in the pattern for these kinds.
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
MIXED = "[A-Za-z0-9+/_-]{20,}"
PEM = (
    "-----BEGIN [A-Z ]*PRIVATE KEY-----"
    "(?:[^-]*(?:-[^-]+){0,64}-----END [A-Z ]*PRIVATE KEY-----|(?:[ \\t\\r\\n]+[A-Za-z0-9+/=]{16,}){0,60})"
)
PEM_FRAME = "-----(?:BEGIN|END) [A-Z ]*PRIVATE KEY-----|[ \\t\\r\\n]"
ASSIGN_LEAST = 12
#: Owners from which on a value is an example; repositories from which on one of several owners is; different characters a live value has.
EXAMPLE_OWNERS = 3
EXAMPLE_REPOSITORIES = 5
LIVE_CHARACTERS = 8
#: Matches of a text that are put together before they join the others.
TOGETHER = 256
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"
MASK = "[SECRET]"


def found(text: Column, pattern: str, kind: int, value, keep) -> Column:
    """Leftmost non-overlapping matches as structs; starts are running sums of the gaps and matches before them."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    both = F.arrays_zip(gaps.alias("gap"), matches.alias("match"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + F.length(x["match"])
        one = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), value(x["match"]).alias("value"))
        out = F.when(keep(value(x["match"])), F.concat(state["out"], F.array(one))).otherwise(state["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    # an array that grows is copied with every step, so it grows by parts
    def part(state: Column, k: Column) -> Column:
        start = F.struct(state["at"].alias("at"), F.array().cast(SPAN).alias("out"))
        own = lambda o: F.struct(o["at"].alias("at"), F.concat(state["out"], o["out"]).alias("out"))
        return F.aggregate(F.slice(matched, k * TOGETHER + 1, TOGETHER), start, step, own)

    matched = F.filter(both, lambda x: x["match"].isNotNull())
    parts = F.sequence(F.lit(0), F.floor(F.size(matches) / TOGETHER).cast("int"))
    spans = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")), part, lambda s: s["out"])
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(SPAN))


def candidates(text: Column) -> Column:
    """All spans of base and added kinds, ordered by start, then kind."""
    same = lambda m: m
    always = lambda v: F.lit(True)
    varied = lambda v: v.rlike("[0-9]") & v.rlike("[A-Z]") & v.rlike("[a-z]")
    parts = [
        found(text, ASSIGN, 0, lambda m: F.regexp_extract(m, ASSIGN, 1), lambda v: F.length(v) >= ASSIGN_LEAST),
        found(text, ACCESS, 1, same, always),
        found(text, HEX, 2, same, always),
        found(text, MIXED, 3, same, varied),
        found(text, PEM, 4, lambda m: F.regexp_replace(m, PEM_FRAME, ""), always),
    ]
    return F.array_sort(F.concat(*parts))


def scan(docs: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """row, doc_id, repository, owner, spans: the candidates of each text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        row_key(F.col("doc_id"), repository, owner, text).alias("row"), "doc_id",
        F.coalesce(repository, F.lit("")).alias("repository"), F.coalesce(owner, F.lit("")).alias("owner"), candidates(text).alias("spans"),
    )


def ownership(scanned: DataFrame) -> DataFrame:
    """value_hash, repositories, owners: distinct holders of each candidate value, counted in two steps so that copies combine early."""
    held = scanned.where(F.size("spans") > 0).select("repository", "owner", F.explode(F.array_distinct(F.transform("spans", lambda s: F.sha2(s["value"], 256)))).alias("value_hash"))
    by_owner = held.groupBy("value_hash", "owner").agg(F.collect_set("repository").alias("repositories"))
    each = by_owner.select("value_hash", "owner", F.explode("repositories").alias("repository"))
    counted = each.groupBy("value_hash", "repository").agg(F.count("*").alias("owners_here"))
    owners = by_owner.groupBy("value_hash").agg(F.count("*").alias("owners"))
    return owners.join(counted.groupBy("value_hash").agg(F.count("*").alias("repositories")), "value_hash")


def verdicts(docs: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """row, doc_id, all_spans: every candidate with owners, repositories and live; one row for each row of ``docs``."""
    scanned = stage(scan(docs, repository, owner), "secrets")
    single = scanned.where(F.size("spans") > 0).select("row", F.explode("spans").alias("s")).distinct()
    known = single.select("row", "s", F.sha2(F.col("s.value"), 256).alias("value_hash")).join(stage(ownership(scanned), "owners"), "value_hash")
    example = (F.col("owners") >= EXAMPLE_OWNERS) | ((F.col("owners") > 1) & (F.col("repositories") >= EXAMPLE_REPOSITORIES))
    live = ~example & (F.size(F.array_distinct(F.split(F.col("s.value"), ""))) >= LIVE_CHARACTERS)
    judged = known.select("row", F.struct("s.start", "s.kind", "s.end", "owners", "repositories", live.alias("live")).alias("span"))
    per_row = judged.groupBy(F.col("row").alias("of")).agg(F.array_sort(F.collect_list("span")).alias("spans"))
    none = F.array().cast(per_row.schema["spans"].dataType)
    out = scanned.select("row", "doc_id").join(per_row, F.col("row") == F.col("of"), "left")
    spans = F.filter(F.coalesce("spans", none), lambda s: (s["kind"] != 3) | s["live"])
    return out.select("row", "doc_id", spans.alias("all_spans"))


def written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def secret_spans(docs: DataFrame, repository: Column, owner: Column) -> DataFrame:
    s = F.col("all_spans")
    count = lambda k: F.size(F.filter(s, lambda x: x["kind"] == k)).cast("long")
    base = F.filter(s, lambda x: x["kind"] <= 2)
    return verdicts(docs, repository, owner).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(written(base), 256).alias("base_sha256"), written(s).alias("spans"),
        F.size(F.filter(s, lambda x: x["live"])).cast("long").alias("n_live"),
        F.size(F.filter(s, lambda x: ~x["live"])).cast("long").alias("n_example"),
        F.coalesce(F.array_max(F.transform(s, lambda x: x["owners"])), F.lit(0)).cast("long").alias("most_owners"),
    )


def redact(docs: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """The rows of ``docs`` with every live span replaced by a mask; n_chars follows.  Examples that many owners copy stay."""
    live = verdicts(docs, repository, owner).select("row", F.filter("all_spans", lambda s: s["live"]).alias("live")).where(F.size("live") > 0).dropDuplicates(["row"])
    key = row_key(F.col("doc_id"), repository, owner, F.coalesce(F.col("text"), F.lit("")))
    joined = docs.select(whole_row(docs).alias("document"), key.alias("row")).join(stage(live, "live"), "row", "left")
    text = F.col("document.text")

    def step(state: Column, x: Column) -> Column:
        fresh = x["start"] >= state["at"]
        part = F.substr(text, state["at"] + 1, x["start"] - state["at"])
        return F.struct(F.greatest(state["at"], x["end"]).alias("at"), F.when(fresh, F.concat(state["out"], part, F.lit(MASK))).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = F.aggregate("live", start, step, lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1, F.length(text))))
    masked = joined.select("document", F.col("live").isNotNull().alias("changed"), F.when(F.col("live").isNotNull(), rest).otherwise(text).alias("masked"))
    new = {"text": F.col("masked")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("changed"), F.length("masked")).otherwise(F.col("document.n_chars")).cast(docs.schema["n_chars"].dataType)
    return masked.select(*[new.get(c, F.col("document")[c]).alias(c) for c in docs.columns])


def oracle(repository: str, owner: str) -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"

    def part(kind: int, pattern: str, value: str, keep: str) -> str:
        return f"""SELECT doc_id, repository, owner, u.i - 1 AS i, {kind} AS kind, u.m AS match, u.start AS start, {value} AS value FROM (
 SELECT doc_id, repository, owner, unnest(list_transform(range(1, len(ms) + 1), lambda k: {{'i': k, 'm': ms[k],
  'start': list_sum(list_transform(gaps[1:k], lambda g: length(g)))::BIGINT + coalesce(list_sum(list_transform(ms[1:k - 1], lambda g: length(g))), 0)::BIGINT}})) AS u
 FROM (SELECT doc_id, repository, owner, regexp_extract_all(text, {quoted(pattern)}) AS ms, string_split_regex(text, {quoted(pattern)}) AS gaps
  FROM docs WHERE regexp_matches(text, {quoted(pattern)}))) WHERE {keep}"""

    assign = f"regexp_extract(u.m, {quoted(ASSIGN)}, 1)"
    mixed = "regexp_matches(u.m, '[0-9]') AND regexp_matches(u.m, '[A-Z]') AND regexp_matches(u.m, '[a-z]')"
    parts = [part(0, ASSIGN, assign, f"length({assign}) >= {ASSIGN_LEAST}"), part(1, ACCESS, "u.m", "true"), part(2, HEX, "u.m", "true"), part(3, MIXED, "u.m", mixed), part(4, PEM, f"regexp_replace(u.m, {quoted(PEM_FRAME)}, '', 'g')", "true")]
    names = "CASE kind " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END"
    line = f"{names} || ':' || start || ':' || (start + length(match))"
    return f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, coalesce({repository}, '') AS repository, coalesce({owner}, '') AS owner FROM documents),
c AS ({' UNION ALL '.join(parts)}),
held AS (SELECT value, count(DISTINCT owner) AS owners, count(DISTINCT repository) AS repositories FROM c GROUP BY value),
s AS (SELECT c.*, owners, owners < {EXAMPLE_OWNERS} AND NOT (owners > 1 AND repositories >= {EXAMPLE_REPOSITORIES}) AND len(list_distinct(string_split(value, ''))) >= {LIVE_CHARACTERS} AS live FROM c JOIN held USING (value)),
k AS (SELECT * FROM s WHERE kind <> 3 OR live),
g AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
 coalesce(string_agg({line}, ',' ORDER BY start, kind) FILTER (kind <= 2), '') AS base, string_agg({line}, ',' ORDER BY start, kind) AS spans,
 count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example, max(owners) AS most_owners FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
 coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example, coalesce(most_owners, 0) AS most_owners
FROM docs d LEFT JOIN g USING (doc_id)"""
