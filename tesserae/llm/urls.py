"""URL filters by temporal list join, in DataFrame functions only.

Dated entries (a domain joins or leaves a list) become validity intervals; a capture is judged by the entries that
were active when it was fetched, for its host and every parent domain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm.store import table

#: Fixed entries of the registered query: list, domain, action, day.
ENTRIES = [
    ("bulk", "tionsh.example.net", "add", "2024-05-01"),
    ("bulk", "tiontion.example.net", "add", "2023-12-01"),
    ("bulk", "tiontion.example.net", "remove", "2024-02-10"),
    ("gambling", "casino-win.example.com", "add", "2024-01-15"),
    ("gambling", "casino-win.example.com", "remove", "2024-07-01"),
    ("gambling", "casino-win.example.com", "add", "2024-10-01"),
    ("gambling", "free-bets.example.com", "add", "2023-06-01"),
    ("pharma", "cheap-pills.example.com", "add", "2024-03-01"),
    ("tracking", "ads-track.example.com", "add", "2024-02-01"),
    ("tracking", "ads-track.example.com", "remove", "2024-09-15"),
    ("watch", "example.org", "add", "2024-11-01"),
]
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"


def host_of(url: Column) -> Column:
    """Lower-case host without a trailing dot; empty where there is none."""
    return F.regexp_replace(F.lower(F.coalesce(F.regexp_extract(url, _HOST, 1), F.lit(""))), r"\.$", "")


def intervals(entries: DataFrame) -> DataFrame:
    """list, domain, since, until (exclusive, null: still active) from dated (list, domain, action, day).

    Of several entries of one list, domain and day the last action by name counts, so a removal beats an addition.
    Entries with a null in any column are ignored.
    """
    daily = entries.dropna(subset=["list", "domain", "action", "day"]).groupBy("list", F.lower("domain").alias("domain"), "day").agg(F.max("action").alias("action"))
    order = Window.partitionBy("list", "domain").orderBy("day")
    return daily.withColumn("until", F.lead("day").over(order)).filter("action = 'add'").select("list", "domain", F.col("day").alias("since"), "until")


def judge(captures: DataFrame, entries: DataFrame, url_col: str = "url", fetched_col: str = "fetched") -> DataFrame:
    """``captures`` with host, n_lists and lists (comma-joined names in order) active for the host at fetch time.

    Each (host, day) is judged once, however many captures it has. A null or odd url has no host, and like a capture
    without a fetch time it is on no list. Repeated captures give equal rows, and an empty table of either gives none on
    a list. Columns of captures named as the new ones are replaced, all others stay.
    """
    rows = captures.drop("host", "n_lists", "lists").withColumn("host", host_of(F.col(url_col)))
    asked = rows.filter(F.col("host") != "").select(F.col("host").alias("_judged_host"), F.col(fetched_col).alias("_judged_day")).dropna().distinct()
    labels = F.split("_judged_host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    listed = intervals(entries).select("list", F.col("domain").alias("listed"), "since", "until")
    active = asked.select("_judged_host", "_judged_day", F.explode(parents).alias("domain")).join(listed, F.expr("domain = listed and _judged_day >= since and (until is null or _judged_day < until)"))
    verdict = active.groupBy("_judged_host", "_judged_day").agg(F.array_sort(F.collect_set("list")).alias("_judged_lists"))
    joined = rows.join(verdict, (F.col("host") == F.col("_judged_host")) & (F.col(fetched_col) == F.col("_judged_day")), "left")
    told = joined.withColumns({"n_lists": F.coalesce(F.size("_judged_lists"), F.lit(0)).cast("long"), "lists": F.coalesce(F.array_join("_judged_lists", ","), F.lit(""))})
    return told.drop("_judged_host", "_judged_day", "_judged_lists")


def entry_table(spark: SparkSession, entries=ENTRIES) -> DataFrame:
    values = ", ".join(f"('{a}', '{b}', '{c}', DATE '{d}')" for a, b, c, d in entries)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(list, domain, action, day)")


def op9_url_lists(spark, sf_dir: str) -> DataFrame:
    """Every page against the lists of its fetch day (the table has none: day page_id mod 366 of 2024)."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.expr("date_add(DATE '2024-01-01', cast(page_id % 366 as int))").alias("fetched"))
    return judge(pages, entry_table(spark)).select("page_id", "url", "host", F.date_format("fetched", "yyyy-MM-dd").alias("fetched"), "n_lists", "lists", (F.col("n_lists") == 0).alias("kept"))


ORACLE_SQL = f"""
WITH e(list, domain, action, day) AS (VALUES {", ".join(f"('{a}', '{b}', '{c}', DATE '{d}')" for a, b, c, d in ENTRIES)}),
i AS (SELECT * FROM (SELECT *, lead(day) OVER (PARTITION BY list, domain ORDER BY day) AS until FROM e) WHERE action = 'add'),
p AS (SELECT page_id, url, rtrim(lower(coalesce(regexp_extract(url, '{_HOST}', 1), '')), '.') AS host, DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS fetched FROM pages),
hit AS (SELECT p.page_id, count(DISTINCT list) AS n, string_agg(DISTINCT list, ',' ORDER BY list) AS lists FROM p JOIN i ON (p.host = i.domain OR ends_with(p.host, '.' || i.domain)) AND p.fetched >= i.day AND (i.until IS NULL OR p.fetched < i.until) GROUP BY p.page_id)
SELECT p.page_id, p.url, p.host, strftime(p.fetched, '%Y-%m-%d') AS fetched, coalesce(n, 0) AS n_lists, coalesce(lists, '') AS lists, n IS NULL AS kept FROM p LEFT JOIN hit USING (page_id)
"""
