"""Secrets in texts: plain ones by pattern, weak ones where the parts of a credential stand together.

Plain findings (``assign``, ``access``, ``hex``) are reported wherever they are. Weak candidates, such as a short
password, a bare random-looking token, a user name or an endpoint, mean nothing alone. Each is
an interval with a role (identifier, secret or endpoint); plain findings have roles, too. Within a
scope, that is, between empty lines, an interval widened by ``REACH`` characters on both sides
is joined with the intervals of the complementary roles, and a weak candidate is
reported only where the join finds one: an identifier needs a secret, a secret an identifier
or endpoint, an endpoint a secret. A bare token needs an identifier and is no secret to an endpoint.

The join asks for the nearest interval of a role on either side, which a running maximum of ends and
a running minimum of starts over the scope in order give: linear in the intervals, no pairs.
Places come from running sums of the lengths of matches and of what lies between them.

Only DataFrame functions are used. A text is scanned once, where it is read; what is shuffled are an id and two
hashes per document and the matches. Equal rows are one until the end and come back as
often as they were there; documents, not sources, are the groups, and a document's matches are bounded
by its text.

Null texts count as empty, empty ones give zero counts and empty strings. Null ids are kept; rows
that share an id but not the text are told apart. An empty table gives an empty result. Only
the id and text columns are read, so others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _either(words: str) -> str:
    """The pattern with each letter outside brackets in either case (fixed to ASCII)."""
    out, inside = "", False
    for c in words:
        inside = (inside or c == "[") and c != "]"
        out += f"[{c.upper()}{c}]" if c.isalpha() and not inside else c
    return out


_SET = r"""["']?\x20*[:=]\x20*["']?"""
# fixed patterns of the plain findings. Runs shorter than asked for never hold a longer one, so
# access and hex can ask for the length; assign cannot, as a failing match takes up its text
ASSIGN = f"({_either('password|passwd|secret|token|api_?key')}){_SET}" + r"([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGNED = 12  # characters of an assigned value, at least

# weak candidates
ENDPOINT = (
    f"(?:(?:{_either('https?|ftps?|sftp|ssh|postgres(?:ql)?|mysql|mongodb|redis|amqp')}"
    + r")://[A-Za-z0-9._~:/?#@!$&*+,;=%-]{4,}|"
    + f"(?:{_either('hostname|host|endpoint|server')}){_SET}" + r"[A-Za-z0-9.-]{3,}(?::[0-9]{1,5})?)"
)
IDENT = (
    f"(?:{_either('access[_-]?key[_-]?id|client[_-]?id|key[_-]?id|user[_-]?name|user|login|account')}){_SET}"
    + r"[A-Za-z0-9._@+-]{3,}"
)
SECRET = (
    f"(?:{_either('password|passwd|passphrase|pass|pwd|secret|token|api[_-]?key|private[_-]?key|access[_-]?key|credentials?')}){_SET}"
    + r"[A-Za-z0-9+/_.=!@#$%^&*~-]{6,}"
)
PARTS = f"{ENDPOINT}|{IDENT}|{SECRET}"
BARE = r"[A-Za-z0-9+/]{24,}={0,2}"
BREAK = r"\n[\x20\t\r]*\n"
REACH = 200

#: kinds in the order of spans with one start; the first three are plain
KINDS = ("assign", "access", "hex", "ident", "secret", "endpoint")
_FOUND = "array<struct<source:int,nr:int,gap:int,found:string>>"


def _matches(text: Column, source: int, pattern: str, asked: Column | None = None) -> Column:
    """All matches in order, each with the number of characters between it and the one before."""
    between = F.split(text, pattern, -1)
    every = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.filter(F.arrays_zip(every.alias("found"), between.alias("gap")), lambda x: x["found"].isNotNull())
    rows = F.transform(
        zipped,
        lambda x, i: F.struct(F.lit(source).alias("source"), i.alias("nr"), F.length(x["gap"]).alias("gap"), x["found"].alias("found")),
    )
    hit = text.rlike(pattern)
    return F.when(hit if asked is None else asked & hit, rows).otherwise(F.array().cast(_FOUND))


def _scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per distinct document and match, documents without any kept: key columns, copies, match."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # bare tokens and empty lines matter only where there are parts to go with them
    asked = text.rlike(PARTS)
    named = asked | text.rlike(ACCESS)
    found = F.concat(
        _matches(text, 0, ASSIGN),
        _matches(text, 1, ACCESS),
        _matches(text, 2, HEX),
        _matches(text, 3, PARTS),
        _matches(text, 4, BARE, named),
        _matches(text, 5, BREAK, named),
    )
    return (
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.xxhash64(text).alias("sig_a"),
            F.xxhash64(F.lit(1), text).alias("sig_b"),
            found.alias("matches"),
        )
        .groupBy("doc_id", "sig_a", "sig_b")
        .agg(F.first("matches").alias("matches"), F.count("*").alias("copies"))
        .select("doc_id", "sig_a", "sig_b", "copies", F.explode_outer("matches").alias("match"))
        .select("doc_id", "sig_a", "sig_b", "copies", "match.*")
    )


KEY = ["doc_id", "sig_a", "sig_b"]


def _kind(found: Column, source: Column) -> Column:
    """The kind of a match; null if it fails."""
    mixed = found.rlike("[a-z]") & found.rlike("[A-Z]") & found.rlike("[0-9]")
    value = F.regexp_extract(found, ASSIGN, 2)
    return (
        F.when(source == 0, F.when(F.length(value) >= ASSIGNED, "assign"))
        .when(source == 1, "access")
        .when(source == 2, "hex")
        .when(source == 3, F.when(found.rlike(f"^{ENDPOINT}"), "endpoint").when(found.rlike(f"^{IDENT}"), "ident").otherwise("secret"))
        .when(source == 4, F.when(mixed, "bare"))
        .when(source == 5, "break")
    )


def parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every candidate with its place, scope and role; a row without kind where a document has none."""
    upto = Window.partitionBy(*KEY, "source").orderBy("nr").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("found")
    kind = F.col("kind")
    placed = (
        _scanned(docs, id_col, text_col)
        .withColumn("end", F.sum(F.col("gap") + size).over(upto))
        .withColumn("start", F.col("end") - size)
        .withColumn("kind", _kind(F.col("found"), F.col("source")))
    )
    plain = kind.isin(*KINDS[:3])
    role = (
        F.when(kind.isin("assign", "secret", "bare"), "secret")
        .when(kind.isin("access", "ident"), "ident")
        .when(kind == "endpoint", "endpoint")
        # digits alone are as likely a number as a secret
        .when((kind == "hex") & F.col("found").rlike("[a-f]") & F.col("found").rlike("[0-9]"), "secret")
    )
    # a break comes before what starts with it; ties by place are settled by source
    line = Window.partitionBy(*KEY).orderBy("start", "source")
    earlier, later = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(1, Window.unboundedFollowing)
    covered = F.coalesce(F.max(F.when(plain, F.col("end"))).over(earlier) > F.col("start"), F.lit(False)) | F.coalesce(
        F.min(F.when(plain, F.col("start"))).over(later) < F.col("end"), F.lit(False)
    )
    return (
        placed.withColumn("scope", F.sum(F.when(kind == "break", 1).otherwise(0)).over(line.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("plain", F.coalesce(plain, F.lit(False)))
        # what overlaps a plain finding adds nothing as a secret
        .withColumn("role", F.when(F.col("plain") | ~(kind.isin("secret", "bare") & covered), role))
        .withColumn("kind", F.when(kind != "break", kind))
        .drop("gap", "nr")
    )


def _nearest(own: Column) -> tuple[Column, Column]:
    """Intervals (start, end) that are ``own`` before and after a part in its scope, nearest to it, within REACH."""
    line = Window.partitionBy(*KEY, "scope").orderBy("start", "source")
    before = F.max(F.when(own, F.struct(F.col("end").alias("at"), "start", "end"))).over(line.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(own, F.struct(F.col("start").alias("at"), "start", "end"))).over(line.rowsBetween(1, Window.unboundedFollowing))
    near_before = F.when(F.col("start") - before["end"] <= REACH, before)
    near_after = F.when(after["start"] - F.col("end") <= REACH, after)
    return near_before, near_after


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``parts`` with the nearest complementary intervals and ``reported``."""
    out = parts(docs, id_col, text_col)
    near = {}
    for role in ("ident", "secret", "endpoint"):
        near[f"{role}_before"], near[f"{role}_after"] = _nearest(F.col("role") == role)
    near["named_before"], near["named_after"] = _nearest((F.col("role") == "secret") & (F.col("kind") != "bare"))
    out = out.withColumns(near)
    has = lambda role: F.col(f"{role}_before").isNotNull() | F.col(f"{role}_after").isNotNull()
    weak = (
        F.when(F.col("role") == "ident", has("secret"))
        .when(F.col("role") == "endpoint", has("named"))
        .when(F.col("role") == "secret", has("ident") | ((F.col("kind") != "bare") & has("endpoint")))
    )
    return out.withColumn("reported", F.col("plain") | F.coalesce(weak, F.lit(False)))


def credentials(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per reported secret with a partner: its span and the spans of the nearest identifier and endpoint.

    Of two partners at the same distance the one before counts.
    """
    found = linked(docs, id_col, text_col).where((F.col("role") == "secret") & F.col("reported"))

    def nearest(role: str) -> Column:
        before, after = F.col(f"{role}_before"), F.col(f"{role}_after")
        first = after.isNull() | (F.col("start") - before["end"] <= after["start"] - F.col("end"))
        return F.when(before.isNotNull() & first, before).otherwise(after)

    return (
        found.withColumns({"ident": nearest("ident"), "endpoint": nearest("endpoint")})
        .where("ident IS NOT NULL OR endpoint IS NOT NULL")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .select(
            "doc_id", "scope", "kind", "start", "end",
            F.col("ident.start").alias("ident_start"), F.col("ident.end").alias("ident_end"),
            F.col("endpoint.start").alias("endpoint_start"), F.col("endpoint.end").alias("endpoint_end"),
        )
    )


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex (plain spans), base_sha256, spans, n_linked of every row."""
    kind = F.when(F.col("kind") == "bare", "secret").otherwise(F.col("kind"))
    place = F.array_position(F.array(*map(F.lit, KINDS)), kind)
    span = F.struct("start", place.alias("place"), "end", "plain", kind.alias("kind"))
    found = (
        linked(docs, id_col, text_col)
        .groupBy(*KEY)
        .agg(F.array_sort(F.collect_list(F.when(F.col("reported"), span))).alias("all"), F.first("copies").alias("copies"))
    )
    text = lambda spans: F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )
    count = lambda kind: F.size(F.filter("all", lambda x: x["kind"] == kind)).cast("long")
    plain = F.filter("all", lambda x: x["plain"])
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(text(plain).cast("binary"), 256).alias("base_sha256"),
        text(F.col("all")).alias("spans"),
        (F.size("all") - F.size(plain)).cast("long").alias("n_linked"),
    )


def _sql() -> str:
    q = lambda pattern: pattern.replace("'", "''")
    scans = "\n  UNION ALL\n  ".join(
        f"""SELECT n, {i} AS source, unnest(range(1, len(found) + 1)) AS nr, unnest(found) AS found, unnest(gaps[1:len(found)]) AS gap
  FROM (SELECT n, regexp_extract_all(text, '{q(p)}', 0) AS found, string_split_regex(text, '{q(p)}') AS gaps FROM docs)"""
        for i, p in enumerate((ASSIGN, ACCESS, HEX, PARTS, BARE, BREAK))
    )
    exists = lambda role, more="": (
        f"EXISTS (FROM parts o WHERE o.n = p.n AND o.scope = p.scope AND o.role = '{role}' AND o.m <> p.m {more}"
        f"AND o.start - p.stop <= {REACH} AND p.start - o.stop <= {REACH})"
    )
    joined = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place, stop)"
    return f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
matches AS MATERIALIZED (
  {scans}),
placed AS (
  SELECT n, source, found, row_number() OVER () AS m,
         (sum(length(gap) + length(found)) OVER (PARTITION BY n, source ORDER BY nr))::BIGINT AS stop,
         CASE source WHEN 0 THEN CASE WHEN length(regexp_extract(found, '{q(ASSIGN)}', 2)) >= {ASSIGNED} THEN 'assign' END
           WHEN 1 THEN 'access' WHEN 2 THEN 'hex'
           WHEN 3 THEN CASE WHEN regexp_matches(found, '^{q(ENDPOINT)}') THEN 'endpoint' WHEN regexp_matches(found, '^{q(IDENT)}') THEN 'ident' ELSE 'secret' END
           WHEN 4 THEN CASE WHEN regexp_matches(found, '[a-z]') AND regexp_matches(found, '[A-Z]') AND regexp_matches(found, '[0-9]') THEN 'bare' END
           ELSE 'break' END AS kind
  FROM matches),
spans AS MATERIALIZED (
  SELECT *, stop - length(found) AS start, kind IN ('assign', 'access', 'hex') AS plain FROM placed WHERE kind IS NOT NULL),
parts AS MATERIALIZED (
  SELECT *, (SELECT count(*) FROM spans b WHERE b.n = s.n AND b.kind = 'break' AND b.start <= s.start) AS scope,
         CASE WHEN kind IN ('secret', 'bare')
                THEN CASE WHEN NOT EXISTS (FROM spans b WHERE b.n = s.n AND b.plain AND b.start < s.stop AND b.stop > s.start) THEN 'secret' END
              WHEN kind = 'assign' THEN 'secret' WHEN kind IN ('access', 'ident') THEN 'ident' WHEN kind = 'endpoint' THEN 'endpoint'
              WHEN kind = 'hex' AND regexp_matches(found, '[a-f]') AND regexp_matches(found, '[0-9]') THEN 'secret' END AS role
  FROM spans s WHERE kind <> 'break'),
reported AS (
  SELECT p.n, p.start, p.stop, p.plain, CASE kind WHEN 'bare' THEN 'secret' ELSE kind END AS kind,
         list_position(['{"', '".join(KINDS)}'], CASE kind WHEN 'bare' THEN 'secret' ELSE kind END) AS place
  FROM parts p
  WHERE p.plain OR (p.role = 'ident' AND {exists('secret')})
     OR (p.role = 'endpoint' AND {exists('secret', "AND o.kind <> 'bare' ")})
     OR (p.role = 'secret' AND ({exists('ident')} OR (p.kind <> 'bare' AND {exists('endpoint')}))))
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
       count(*) FILTER (kind = 'hex') AS n_hex,
       sha256(coalesce({joined} FILTER (plain), '')) AS base_sha256, coalesce({joined} FILTER (r.n IS NOT NULL), '') AS spans,
       count(*) FILTER (NOT plain) AS n_linked
FROM docs d LEFT JOIN reported r USING (n) GROUP BY d.n, d.doc_id
"""


SQL = _sql()
