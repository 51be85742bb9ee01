"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are found by patterns; their hashes are counted over distinct owners and repositories of the whole corpus.
A value that many owners hold is a copied example; one that stays with few owners looks live. Formats that only a
provider issues (``EXTRA``) are reported where their value looks live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.store import materialize, table


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([*(_either(w) for w in ("password", "passwd", "secret", "token")), "[Aa][Pp][Ii]_?[Kk][Ee][Yy]"])
#: kind -> (pattern, group of the value, least length of the value). The first three are the base kinds, in order.
BASE = {
    "assign": (rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    "access": ("AKIA[A-Z0-9]+", 0, 16),
    "hex": ("[0-9a-f]{32,}", 0, 32),
}
EXTRA = {
    "forge": ("gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    "chat": ("xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    "pay": ("[sr]k_live_[A-Za-z0-9]{16,}", 0, 24),
    "cloud": ("AIza[A-Za-z0-9_-]{35}", 0, 39),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
    "pem": ("-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\\s]{40,}", 0, 60),
}
KINDS = [*BASE, *EXTRA]
#: A value that so many owners hold is a copied example.
COPIED_OWNERS = 3
#: Matches whose positions are summed in one run; slices of each hash when documents meet its owners.
RUN, SALT = 256, 16
_SPAN = "array<struct<start:int,rank:int,kind:string,end:int,hash:string>>"


def _running(steps: Column) -> Column:
    """Running sums of an array of int, a run of ``RUN`` at a time: an array that grows by one item is copied each time."""
    grown = lambda xs, first: F.aggregate(xs, F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), first) + x)))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / RUN).cast("int")), lambda i: F.slice(steps, i * RUN + 1, F.lit(RUN)))
    sums = F.transform(runs, lambda r: F.aggregate(r, F.lit(0), lambda acc, x: acc + x))
    return F.flatten(F.zip_with(runs, grown(sums, F.lit(0)), lambda r, end: grown(r, end - F.aggregate(r, F.lit(0), lambda acc, x: acc + x))))


def _spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans of a kind in code points: gaps between matches and the matches themselves add up to positions."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = (lambda m: F.regexp_extract(m, pattern, group)) if group else (lambda m: m)
    steps = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("m")))
    ends = _running(F.transform(steps, lambda s: s["gap"] + F.length(s["m"])))
    spans = F.zip_with(found, ends, lambda m, e: F.struct((e - F.length(m)).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), e.alias("end"), F.sha2(value(m), 256).alias("hash"), F.length(value(m)).alias("n")))
    kept = F.transform(F.filter(spans, lambda s: s["n"] >= least), lambda s: F.struct(*[s[c].alias(c) for c in ("start", "rank", "kind", "end", "hash")]))
    return F.when(text.rlike(pattern), kept).otherwise(F.array()).cast(_SPAN)


def _told(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def candidates(docs: DataFrame, repo: Column, owner: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, repo, owner, base and extra spans of every row; null texts are empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base, extra = (F.concat(*[_spans(text, k, *v) for k, v in kinds.items()]) for kinds in (BASE, EXTRA))
    return docs.select(F.col(id_col).cast("long").alias("id"), repo.alias("repo"), owner.alias("owner"), base.alias("base"), extra.alias("extra"))


def ownership(found: DataFrame) -> DataFrame:
    """hash, owners, repos: in how many distinct owners and repositories each candidate value occurs (nulls are one)."""
    each = found.select("owner", "repo", F.explode(F.array_distinct(F.transform(F.concat("base", "extra"), lambda s: s["hash"]))).alias("hash"))
    return each.distinct().groupBy("hash", "owner").agg(F.count("*").alias("repos")).groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))


def scan(docs: DataFrame, repo: Column, owner: Column, copied: int = COPIED_OWNERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id_col, base (spans), spans (base and live-looking extra ones), n_live, n_copied.

    A repository belongs to one owner. Null owners and repositories count as one owner or repository each.
    """
    found = materialize(candidates(docs, repo, owner, id_col, text_col))
    both = F.concat("base", "extra")
    key = F.sha2(F.concat_ws("|", F.coalesce(F.col("id").cast("string"), F.lit("-")), F.to_json(both)), 256)
    some = found.filter(F.size(both) > 0).withColumn("key", key)
    hits = some.select("key", F.explode(both).alias("s")).select("key", F.col("s.hash").alias("hash")).distinct()
    rare = ownership(found).filter(F.col("owners") < copied).select("hash", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    live = hits.withColumn("salt", F.pmod(F.hash("key"), F.lit(SALT))).join(rare, ["hash", "salt"]).groupBy("key").agg(F.collect_list("hash").alias("live"))
    joined = some.join(live, "key", "left").withColumn("live", F.coalesce("live", F.array().cast("array<string>")))
    is_live = lambda s: F.array_contains(F.col("live"), s["hash"])
    told = joined.select(
        "id", "base",
        F.concat("base", F.filter("extra", is_live)).alias("spans"),
        F.size(F.filter(both, is_live)).cast("long").alias("n_live"),
        (F.size(both) - F.size(F.filter(both, is_live))).cast("long").alias("n_copied"),
    )
    none = found.filter(F.size(both) == 0).select("id", "base", F.col("extra").alias("spans"), F.lit(0).cast("long").alias("n_live"), F.lit(0).cast("long").alias("n_copied"))
    return told.unionByName(none).withColumnRenamed("id", id_col)


def op10_secret_ownership(spark, sf_dir: str) -> DataFrame:
    """Secrets of every document; a source is an owner, and a source's texts of one language are a repository."""
    owner, lang = F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))
    found = scan(table(spark, sf_dir, "documents"), F.concat_ws("/", owner, lang), owner)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(_told(F.col("base")), 256).alias("base_sha256"), _told(F.col("spans")).alias("spans"), "n_live", "n_copied")


def _sql() -> str:
    def kind(k: str, pattern: str, group: int, least: int) -> str:
        p = pattern.replace("'", "''")
        value = f"regexp_extract(m, '{p}', {group})" if group else "m"
        return f"""{k}_m AS (SELECT doc_id, owner, repo, unnest(regexp_extract_all(text, '{p}')) AS m, unnest(range(1, len(regexp_extract_all(text, '{p}')) + 1)) AS i,
  unnest(list_slice(string_split_regex(text, '{p}'), 1, len(regexp_extract_all(text, '{p}')))) AS g FROM t),
{k}_s AS (SELECT *, CAST(sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS e FROM {k}_m),
{k} AS (SELECT doc_id, owner, repo, e - length(m) AS s, {KINDS.index(k)} AS rank, '{k}' AS kind, e, sha256({value}) AS hash FROM {k}_s WHERE length({value}) >= {least})"""

    parts = ",\n".join(kind(k, *v) for k, v in (BASE | EXTRA).items())
    union = " UNION ALL ".join(f"SELECT * FROM {k}" for k in KINDS)
    tell = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e)"
    return f"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS owner, coalesce(source, '') || '/' || coalesce(lang, '') AS repo, coalesce(text, '') AS text FROM documents),
{parts},
a AS ({union}),
f AS (SELECT hash, count(DISTINCT owner) < {COPIED_OWNERS} AS live FROM a GROUP BY hash),
h AS (SELECT a.*, live FROM a JOIN f USING (hash)),
r AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)}, {tell} FILTER (rank < {len(BASE)}) AS base, {tell} FILTER (rank < {len(BASE)} OR live) AS spans,
  count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied FROM h GROUP BY doc_id)
SELECT t.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM t LEFT JOIN r USING (doc_id)
"""


ORACLE_SQL = _sql()
