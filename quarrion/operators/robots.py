"""Whether urls may be fetched, by the robots files of their hosts as they stood at the time."""

from __future__ import annotations

from urllib.parse import quote, unquote, urlparse, urlunparse
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds for which a robots file that was read holds.
TTL = 86_400
RULES = "array<struct<path: string, allowed: boolean>>"


def agent_rules(text: Column, agent: str) -> Column:
    """The lines of a robots file that hold for an agent, in their order, the first that fits a path decides."""

    @F.pandas_udf(RULES)
    def parsed(texts: pd.Series) -> pd.Series:
        def rules(t):
            if t is None:
                return None
            file = RobotFileParser()
            file.parse(t.splitlines())
            entry = next((e for e in file.entries if e.applies_to(agent)), file.default_entry)
            return [{"path": r.path, "allowed": r.allowance} for r in entry.rulelines] if entry else []

        return texts.map(rules)

    return parsed(text)


def _asked(url: Column) -> Column:
    """What robots files call a url: all after the host, decoded and quoted again, at least ``/``."""

    @F.pandas_udf("string")
    def asked(urls: pd.Series) -> pd.Series:
        def one(u):
            if u is None:
                return None
            try:
                p = urlparse(unquote(u))
            except ValueError:  # no url, so no host and no rule
                return "/"
            return quote(urlunparse(("", "", p.path, p.params, p.query, p.fragment))) or "/"

        return urls.map(one)

    return asked(url)


def can_fetch(requests: DataFrame, fetched: DataFrame, agent: str, url: str = "url", ts: str = "ts", ttl: int = TTL) -> DataFrame:
    """Adds ``allowed`` and ``known`` (a robots file that still held was at hand) to requests.

    ``fetched`` is the log of robots files: (host, fetched timestamp, status
    int, text string). A file holds from its time on for ``ttl`` seconds or until the
    next of its host. 401 and 403 forbid all, other 4xx allow all; a file that
    could not be read (any other status, or no text), a host without one and a
    url without a host allow the request. Of files of one host and time the
    last by status and text counts.

    A file's time is cut into days of ``ttl``, of which it touches two at most,
    so requests and files meet by (host, day) and not by host alone, however
    long the log is; the rules of the agent are all that is joined.
    """
    from pyspark.sql import Window

    one = fetched.where(F.col("host").isNotNull() & F.col("fetched").isNotNull()).groupBy("host", F.unix_micros(F.col("fetched").cast("timestamp")).alias("_from"))
    one = one.agg(F.max(F.struct(F.coalesce("status", F.lit(-1)).alias("status"), "text")).alias("f"))
    after = F.lead("_from").over(Window.partitionBy("host").orderBy("_from"))
    span = ttl * 1_000_000
    read = F.col("f.status").between(200, 299) & F.col("f.text").isNotNull()
    everything = lambda allowed: F.array(F.struct(F.lit("").alias("path"), F.lit(allowed).alias("allowed")))
    one = one.withColumn("_to", F.least(F.coalesce(after, F.col("_from") + span), F.col("_from") + span)).select(
        F.col("host").alias("_host"), "_from", "_to",
        F.when(read, agent_rules(F.col("f.text"), agent)).when(F.col("f.status").isin(401, 403), everything(False)).when(F.col("f.status").between(400, 499), everything(True)).alias("_rules"),
    )
    days = one.withColumn("_day", F.explode(F.sequence(F.floor(F.col("_from") / span), F.floor((F.col("_to") - 1) / span))))
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    asked = requests.withColumn("_host", F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)).withColumn("_at", at)
    asked = asked.withColumn("_day", F.floor(F.col("_at") / span)).withColumn("_path", _asked(F.col(url)))
    met = asked.alias("q").join(days.alias("d"), (F.col("q._host") == F.col("d._host")) & (F.col("q._day") == F.col("d._day")) & (F.col("q._at") >= F.col("d._from")) & (F.col("q._at") < F.col("d._to")), "left")
    first = F.filter("d._rules", lambda r: (r["path"] == "*") | F.startswith(F.col("q._path"), r["path"]))
    allowed = F.coalesce(F.get(first, F.lit(0))["allowed"], F.lit(True))
    return met.select(*[F.col(f"q.`{c}`") for c in requests.columns], allowed.alias("allowed"), F.col("d._rules").isNotNull().alias("known"))
