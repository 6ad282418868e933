"""Secret scans with ownership frequency, in DataFrame functions only.

Four patterns give candidates: assignments to names like password, access keys, runs of hexadecimal digits, and long
tokens that mix digits, upper-case and lower-case letters. The hash of each candidate's value is counted over the corpus by
distinct repositories and owners. A value that few of them hold, and that does not look like a placeholder, is live; one that
many hold is an example that was copied. Spans of the first three kinds are always reported; tokens are, as `owned` spans,
where they are live and touch no other span.

One scan of the texts writes the candidates, with a number for each row; all counts and joins read that small table, which
holds hashes and places but no secrets. A hash that very many rows hold is summed before it is shuffled and dealt to
several tasks where rows are joined to it.

Defined results: null texts are as empty ones, which have no spans (base_sha256 is that of the empty text); a null owner
or repository counts as one that is named ''; repeated rows get equal results, and count once for each owner and repository; an
empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.oracle import find_all as sql_find_all
from ..plans.oracle import q
from .common import documents, join_hot, materialize

_NAMES = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = f"(?:{_NAMES})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: The least lengths are in the patterns where a match that is too short can hide no other: both are whole runs.
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
TOKEN = "[A-Za-z0-9+/_=-]{20,}"
LEAST_ASSIGNED = 12
KINDS = ("assign", "access", "hex", "owned")
#: A value held by more owners, or more repositories, than these is a copied example.
MAX_OWNERS, MAX_REPOSITORIES = 2, 4
#: Live values have so many different characters at least, and none of these words.
LEAST_CHARACTERS = 8
PLACEHOLDER = "[Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Ss][Aa][Mm][Pp][Ll][Ee]|[Dd][Uu][Mm][Mm][Yy]|[Cc][Hh][Aa][Nn][Gg][Ee][Mm][Ee]|[Xx][Xx][Xx][Xx]|1234567|abcdef0|0123456"


def _spans(found: Column, kind: int, value: str = "value") -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"), m[value].alias("value")))


def candidates(text: Column) -> Column:
    """Spans (start, kind, end, hash, looks_live) of all four kinds, in order of start and kind; tokens that touch another span are left out."""
    def base(t: Column) -> Column:
        assigned = F.filter(T.find_all(t, ASSIGN, (1,)), lambda m: F.length(m["g1"]) >= LEAST_ASSIGNED)
        return F.array_sort(F.concat(_spans(assigned, 0, "g1"), _spans(T.find_all(t, ACCESS), 1), _spans(T.find_all(t, HEX), 2)))

    def tokens(t: Column) -> Column:
        mixed = F.filter(T.find_all(t, TOKEN), lambda m: m["value"].rlike("[0-9]") & m["value"].rlike("[A-Z]") & m["value"].rlike("[a-z]"))
        return _spans(mixed, 3)

    def apart(spans: Column, more: Column) -> Column:
        free = F.filter(more, lambda x: ~F.exists(spans, lambda s: (s["start"] < x["end"]) & (x["start"] < s["end"])))
        return F.when(F.size(more) == 0, spans).otherwise(F.array_sort(F.concat(spans, free)))

    def hashed(s: Column) -> Column:
        varied = F.size(F.array_distinct(F.split(s["value"], ""))) >= LEAST_CHARACTERS
        return F.struct(s["start"], s["kind"], s["end"], F.sha2(s["value"], 256).alias("hash"), (varied & ~s["value"].rlike(PLACEHOLDER)).alias("looks_live"))

    whole = T.let(F.coalesce(text, F.lit("")), lambda t: T.let(base(t), lambda spans: T.let(tokens(t), lambda more: apart(spans, more))))
    return F.transform(whole, hashed)


def ownership(spans: DataFrame, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """Rows (hash, repository, owner, looks_live) -> a row a hash: rows n, repositories, owners, live."""
    pairs = spans.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"), F.min("looks_live").alias("looks_live"))
    owners = pairs.groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("repositories"), F.min("looks_live").alias("looks_live"))
    counted = owners.groupBy("hash").agg(F.sum("n").alias("n"), F.sum("repositories").alias("repositories"), F.count("*").alias("owners"), F.min("looks_live").alias("looks_live"))
    few = (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)
    return counted.select("hash", "n", "repositories", "owners", (few & F.col("looks_live")).alias("live"))


def show(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, owner: Column, repository: Column, id_col: str = "doc_id", text_col: str = "text", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> tuple[DataFrame, DataFrame]:
    """(one row a document, one row a secret's hash): documents have `spans` with the live tokens among them, and the numbers
    of live spans and of copied examples; hashes have their numbers of rows, repositories and owners."""
    named = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), named(owner).alias("owner"), named(repository).alias("repository"), candidates(F.col(f"`{text_col}`").cast("string")).alias("spans"))
    # Written once: the rows' numbers stay as they are, whichever task is run again.
    found = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "candidates")
    each = T.unnest(found, "spans", "s", "row", "owner", "repository").select("row", "owner", "repository", "s.*")
    hashes = materialize(ownership(each, max_owners, max_repositories), "owners")
    joined = join_hot(each.select("row", "start", "kind", "end", "hash"), hashes.select("hash", "n", "live"), "hash", "n")
    token = F.col("kind") == KINDS.index("owned")
    verdicts = joined.groupBy("row").agg(
        F.collect_list(F.when(token & F.col("live"), F.struct("start", "kind", "end"))).alias("owned"),
        F.sum(F.col("live").cast("long")).alias("n_live"), F.sum((~token & ~F.col("live")).cast("long")).alias("n_example"),
    )
    plain = F.transform(F.filter("spans", lambda s: s["kind"] < KINDS.index("owned")), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    out = found.select("row", "doc_id", plain.alias("base")).join(verdicts, "row", "left")
    spans = F.when(F.size("owned") > 0, F.array_sort(F.concat("base", "owned"))).otherwise(F.col("base"))
    return out.select("doc_id", "base", spans.alias("spans"), F.coalesce("n_live", F.lit(0).cast("long")).alias("n_live"), F.coalesce("n_example", F.lit(0).cast("long")).alias("n_example")), hashes


def op11_secrets_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets. The owner of a document is its source; its repository is its source and language."""
    found, _ = scan(documents(spark, sf_dir), F.col("source"), F.concat_ws("/", "source", "lang"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(3)], F.sha2(show(F.col("base")), 256).alias("base_sha256"), show(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index("owned"))).cast("long").alias("n_owned"), "n_live", "n_example",
    )


def _sql() -> str:
    found = []
    for k, (pattern, more) in enumerate([(ASSIGN, ()), (ACCESS, ()), (HEX, ()), (TOKEN, ())]):
        groups = (1,) if pattern == ASSIGN else ()
        value = "g1" if groups else "value"
        keep = f"length(g1) >= {LEAST_ASSIGNED}" if groups else "regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]')" if pattern == TOKEN else "true"
        found.append(f'SELECT doc_id, {k} AS kind, start, "end", {value} AS secret FROM ({sql_find_all("texts", pattern, "doc_id", groups=groups)}) h{k} WHERE {keep}')
    kind = "CASE kind " + " ".join(f"WHEN {k} THEN {q(name)}" for k, name in enumerate(KINDS)) + " END"
    listed = lambda which: f"coalesce(string_agg({kind} || ':' || start || ':' || \"end\", ',' ORDER BY start, kind) FILTER ({which}), '')"
    return f"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
hits AS ({' UNION ALL '.join(found)}),
spans AS (SELECT * FROM hits h WHERE kind < 3 OR NOT EXISTS (SELECT 1 FROM hits b WHERE b.kind < 3 AND b.doc_id = h.doc_id AND b.start < h."end" AND h.start < b."end")),
held AS (SELECT s.*, coalesce(d.source, '') AS owner, concat_ws('/', d.source, d.lang) AS repository FROM spans s JOIN documents d USING (doc_id)),
live AS (SELECT secret, count(DISTINCT owner) <= {MAX_OWNERS} AND count(DISTINCT (owner, repository)) <= {MAX_REPOSITORIES} AND len(list_distinct(string_split(secret, ''))) >= {LEAST_CHARACTERS}
 AND NOT regexp_matches(secret, {q(PLACEHOLDER)}) AS live FROM held GROUP BY secret),
told AS (SELECT s.*, live FROM spans s JOIN live USING (secret))
SELECT t.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
 sha256({listed('kind < 3')}) AS base_sha256, {listed('kind < 3 OR live')} AS spans, count(*) FILTER (kind = 3 AND live) AS n_owned,
 count(*) FILTER (live) AS n_live, count(*) FILTER (kind < 3 AND NOT live) AS n_example
FROM texts t LEFT JOIN told USING (doc_id) GROUP BY t.doc_id"""


OP11_SQL = _sql()
