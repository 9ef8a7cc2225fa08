"""Robots rules: what a site's robots.txt says of each URL. Fetching is the caller's; decisions are joins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

_RULE = StructType([StructField("agent", StringType()), StructField("allow", BooleanType()), StructField("path", StringType())])


@F.pandas_udf(ArrayType(_RULE))
def _parsed(bodies: pd.Series) -> pd.Series:
    def parse(body: str | None) -> list[dict]:
        out, agents, open_ = [], [], False
        for line in (body or "").splitlines():
            key, colon, value = line.split("#", 1)[0].partition(":")
            key, value = key.strip().lower(), value.strip()
            if not colon:
                continue
            if key == "user-agent":
                agents = [*agents, value.lower()] if open_ else [value.lower()]
                open_ = True
                out.append({"agent": value.lower(), "allow": True, "path": ""})
            elif key in ("allow", "disallow"):
                open_ = False
                out += [{"agent": a, "allow": key == "allow", "path": value} for a in agents if value]
        return out

    return bodies.map(parse)


def parse_rules(files: DataFrame) -> DataFrame:
    """(domain, agent, allow, path) of robots files (domain, body). Each group of agents has a rule with an empty path, which matches nothing: it says that
    there is such a group. A file is small, so one value of it is parsed at a time."""
    return files.select("domain", F.explode(_parsed(F.col("body"))).alias("r")).select("domain", "r.agent", "r.allow", "r.path")


def domain_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """Path and query, without fragment; at least a slash."""
    rest = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"#.*$", "")
    return F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))


def _form(path: Column) -> Column:
    """A rule's path as a pattern: ``*`` is any text, ``$`` at its end is the end."""
    plain = F.regexp_replace(F.regexp_replace(path, r"\$$", ""), r"([\\.+?()\[\]{}|^$])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(plain, F.lit("*"), F.lit(".*")), F.when(path.endswith("$"), "$").otherwise(""))


def decide(urls: DataFrame, sites: DataFrame, rules: DataFrame, *, user_agent: str, url: str = "url") -> DataFrame:
    """(url, domain, allowed, reason), a row per distinct URL of ``urls``.

    ``sites``: (domain, status) of robots.txt, null where it could not be reached. A site without the file (404, 410) allows all; any other status but
    200, and a site that is not there, forbid all. ``rules``: as ``parse_rules`` gives them. Groups that name a part of ``user_agent`` count, else those of
    ``*``. Of the rules whose path begins the URL's the longest decides, of equally long ones the one that allows; without any the URL is allowed.

    A rule is found by its text before the first ``*`` or ``$``: URLs list their beginnings of the lengths that their site's rules have, and meet rules
    in an equi-join; only what is left of the pattern is matched then. Null URLs are left out.
    """
    agent = F.lower(F.lit(user_agent))
    named = (F.col("agent") != "*") & F.contains(agent, F.col("agent"))
    own = rules.where(named | (F.col("agent") == "*")).withColumn("named", named)
    kinds = own.groupBy("domain").agg(F.max("named").alias("has_named"))
    own = own.join(kinds, "domain").where(F.col("named") == F.col("has_named")).where("path <> ''").select("domain", "allow", "path", F.regexp_extract("path", r"^[^*$]*", 0).alias("head")).distinct()
    lengths = own.groupBy("domain").agg(F.collect_set(F.char_length("head")).alias("lengths"))
    asked = urls.select(F.col(url).alias("url")).where("url is not null").distinct().select("url", domain_of(F.col("url")).alias("domain"), path_of(F.col("url")).alias("to"))
    asked = asked.join(sites.select("domain", "status", F.lit(True).alias("known")), "domain", "left")
    state = F.when(F.col("status").isin(404, 410), "absent").when(F.col("status") == 200, "rules").otherwise("unavailable")
    asked = asked.withColumn("state", state)
    heads = asked.where("state = 'rules'").join(lengths, "domain").select("url", "domain", "to", F.explode(F.filter("lengths", lambda n: n <= F.char_length("to"))).alias("n"))
    met = heads.withColumn("head", F.left("to", F.col("n"))).join(own, ["domain", "head"])
    plain = ~F.col("path").rlike(r"[*$]")
    hits = met.withColumn("form", F.when(~plain, _form(F.col("path")))).where(plain | F.expr("to rlike form"))
    best = hits.groupBy("url").agg(F.max_by("allow", F.struct(F.char_length("path"), "allow")).alias("allow"))
    reason = F.when(F.col("state") != "rules", F.col("state")).when(F.coalesce("allow", F.lit(True)), "allowed").otherwise("disallowed")
    return asked.join(best, "url", "left").select("url", "domain", reason.isin("absent", "allowed").alias("allowed"), reason.alias("reason"))
