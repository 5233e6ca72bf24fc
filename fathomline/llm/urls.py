"""URL filter by rules and by trust that spreads over the host graph.

Hosts point at the hosts their pages link to; a host and its parent domains also
point at each other. A personalised PageRank starts from the hosts whose pages the
rules allow and follows the edges; distrust starts from the hosts whose pages the
rules block and follows them backwards (who points at bad hosts is suspect). A URL
that no rule decides gets the verdict of its host.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.scratch import Scratch

#: (action, host, path): a rule fits the host and its subdomains below the path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Rounds of both walks. What is still under way after them is less than damping ** rounds of all mass (0.85 ** 20: 4 %).
ROUNDS = 20
#: Rules are written into the plan, so their number is bounded; none is dropped.
MOST_RULES = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.when(F.locate("://", url) > 0, F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.when(F.locate("://", url) > 0, F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def _rest(url: Column) -> Column:
    return F.substr(url, F.locate("://", url) + F.lit(3))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct (rule, action) of the longest rule that fits, ties by name; else null."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    found = F.lit(None).cast("struct<rule:string,action:string>")
    for action, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(action).alias("action"))).otherwise(found)
    return found


def link_edges(pages: DataFrame, url: str, html: str) -> DataFrame:
    """``(src, dst, weight)``: links between different hosts, counted before they are shuffled."""
    links = pages.select(host_of(F.col(f"`{url}`")).alias("src"), F.explode(F.regexp_extract_all(F.col(f"`{html}`"), F.lit(LINK), 1)).alias("link"))
    whole = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))  # of the page's own scheme
    between = links.select("src", host_of(whole).alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    return between.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def parent_edges(hosts: DataFrame) -> DataFrame:
    """``(src, dst, weight)``: one edge each way between a host and its parents of two labels or more."""
    label = F.split("host", r"\.")
    parents = hosts.select("host", F.explode(F.filter(F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(label))), lambda i: F.array_join(F.slice(label, i, F.size(label)), ".")), lambda x: x.contains("."))).alias("parent")).distinct()
    one = F.lit(1.0).alias("weight")
    return parents.select(F.col("host").alias("src"), F.col("parent").alias("dst"), one).unionByName(parents.select(F.col("parent").alias("src"), F.col("host").alias("dst"), one))


def propagate(edges: DataFrame, seeds: DataFrame, scratch: Scratch, damping: float = 0.85, rounds: int = ROUNDS) -> DataFrame:
    """``(host, trust, distrust)`` after ``rounds`` of both propagations.

    ``edges(src, dst, weight)`` has one row per edge, ``seeds(host, good, bad)`` one
    row per host with its starting masses (each summing to one, or all zero). Both
    walks share one join and one map-side combined sum a round; rounds are written
    tables. What reaches a host without edges onward is not passed on. Each mass lies
    below its limit, and all that is missing sums to less than ``damping ** rounds``.
    """
    onward = edges.join(edges.groupBy("src").agg(F.sum("weight").alias("all")), "src").select(F.col("src").alias("from"), F.col("dst").alias("to"), (F.col("weight") / F.col("all")).alias("share"), F.lit(True).alias("forward"))
    back = edges.join(edges.groupBy("dst").agg(F.sum("weight").alias("all")), "dst").select(F.col("dst").alias("from"), F.col("src").alias("to"), (F.col("weight") / F.col("all")).alias("share"), F.lit(False).alias("forward"))
    steps = scratch.save(onward.unionByName(back))
    start = scratch.save(seeds)
    now = start.select("host", F.col("good").alias("trust"), F.col("bad").alias("distrust"))
    for _ in range(rounds):
        flow = steps.join(now, steps["from"] == now["host"]).groupBy(F.col("to").alias("host")).agg(F.sum(F.when(F.col("forward"), F.col("trust") * F.col("share")).otherwise(0.0)).alias("t"), F.sum(F.when(F.col("forward"), 0.0).otherwise(F.col("distrust") * F.col("share"))).alias("d"))
        after = scratch.save(
            start.join(flow, "host", "full").select("host", ((1 - damping) * F.coalesce("good", F.lit(0.0)) + damping * F.coalesce("t", F.lit(0.0))).alias("trust"), ((1 - damping) * F.coalesce("bad", F.lit(0.0)) + damping * F.coalesce("d", F.lit(0.0))).alias("distrust"))
        )
        scratch.drop(now)
        now = after
    return now


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, page_id: str = "page_id", url: str = "url", html: str = "html", threshold: float = 0.5, rounds: int = ROUNDS) -> DataFrame:
    """``(page_id, host, path, rule, verdict, trust, distrust)``: one row per input row.

    Without a rule the verdict is ``block`` where distrust makes up more than
    ``threshold`` of the host's trust and distrust (a share rounded to nine digits),
    else ``allow``; both masses are rounded to nine digits in the result only; so a host that neither walk reaches is allowed, and ties are allowed.
    Null and malformed urls have an empty host and path and are allowed; null pages
    have no links; repeated rows count once each; an empty table gives an empty one;
    other columns are ignored.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    own = pages.select(F.col(f"`{page_id}`").alias("page_id"), host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    own = own.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    hosts = scratch.save(own.where("host <> ''").groupBy("host").agg(F.count(F.when(F.col("fit.action") == "allow", 1)).cast("double").alias("good"), F.count(F.when(F.col("fit.action") == "block", 1)).cast("double").alias("bad")))
    good, bad = hosts.agg(F.sum("good"), F.sum("bad")).first()
    seeds = hosts.select("host", (F.col("good") / F.lit(good or 1.0)).alias("good"), (F.col("bad") / F.lit(bad or 1.0)).alias("bad"))
    edges = link_edges(pages, url, html).unionByName(parent_edges(hosts)).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    ranks = propagate(scratch.save(edges), seeds, scratch, rounds=rounds)
    judged = own.join(ranks, "host", "left").withColumns({"trust": F.coalesce("trust", F.lit(0.0)), "distrust": F.coalesce("distrust", F.lit(0.0))})
    both = F.col("trust") + F.col("distrust")
    # The share is rounded, not the masses: those of a host shrink as the corpus grows.
    host_says = F.when((both > 0) & (F.round(F.col("distrust") / F.when(both > 0, both), 9) > F.lit(threshold)), "block").otherwise("allow")
    return judged.select(F.col("page_id").alias(page_id), "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.action", host_says).alias("verdict"), F.round("trust", 9).alias("trust"), F.round("distrust", 9).alias("distrust"))


def judge_urls_sql(rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = 0.5, rounds: int = ROUNDS, damping: float = 0.85) -> str:
    """The same in DuckDB SQL, with the rounds written out."""
    rest = "substr(url, strpos(url, '://') + 3)"
    low = f"'{UPPER}', '{LOWER}'"
    ordered = sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2]), reverse=True)
    fit = [(f"(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')", h + p, action) for action, h, p in ordered]
    link = LINK.replace("'", "''")
    walk = []
    for i in range(1, rounds + 1):
        walk.append(f"""f{i} AS MATERIALIZED (SELECT s."to" AS host, sum(CASE WHEN forward THEN trust * share ELSE 0e0 END) AS t, sum(CASE WHEN forward THEN 0e0 ELSE distrust * share END) AS d FROM steps s JOIN r{i - 1} r ON s."from" = r.host GROUP BY 1),
r{i} AS MATERIALIZED (SELECT host, {1 - damping!r}::DOUBLE * coalesce(good, 0e0) + {damping!r}::DOUBLE * coalesce(t, 0e0) AS trust, {1 - damping!r}::DOUBLE * coalesce(bad, 0e0) + {damping!r}::DOUBLE * coalesce(d, 0e0) AS distrust FROM seeds FULL JOIN f{i} USING (host))""")
    return f"""
WITH cut AS (SELECT page_id, html,
  CASE WHEN strpos(url, '://') > 0 THEN translate(regexp_extract({rest}, '^([^/?#]*)', 1), {low}) ELSE '' END AS host,
  CASE WHEN strpos(url, '://') > 0 THEN regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
own AS MATERIALIZED (SELECT page_id, host, path, html, CASE {' '.join(f"WHEN {c} THEN '{r}'" for c, r, _ in fit)} END AS rule, CASE {' '.join(f"WHEN {c} THEN '{a}'" for c, _, a in fit)} END AS action FROM cut),
hosts AS MATERIALIZED (SELECT host, count(*) FILTER (action = 'allow')::DOUBLE AS good, count(*) FILTER (action = 'block')::DOUBLE AS bad FROM own WHERE host <> '' GROUP BY host),
seeds AS MATERIALIZED (SELECT host, good / greatest(1e0, (SELECT sum(good) FROM hosts)) AS good, bad / greatest(1e0, (SELECT sum(bad) FROM hosts)) AS bad FROM hosts),
found AS (SELECT host AS src, unnest(regexp_extract_all(html, '{link}', 1)) AS link FROM own),
links AS (SELECT src, CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END AS link FROM found),
far AS (SELECT src, translate(regexp_extract(substr(link, strpos(link, '://') + 3), '^([^/?#]*)', 1), {low}) AS dst FROM links),
labels AS (SELECT host, string_split(host, '.') AS label FROM hosts),
parents AS (SELECT DISTINCT host, parent FROM (SELECT host, array_to_string(label[i:], '.') AS parent FROM (SELECT host, label, unnest(range(2, greatest(2, len(label)) + 1)) AS i FROM labels) x) y WHERE contains(parent, '.')),
edges AS MATERIALIZED (SELECT src, dst, sum(weight) AS weight FROM (
  SELECT src, dst, count(*)::DOUBLE AS weight FROM far WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL
  UNION ALL SELECT host, parent, 1e0 FROM parents UNION ALL SELECT parent, host, 1e0 FROM parents) e GROUP BY ALL),
steps AS MATERIALIZED (SELECT src AS "from", dst AS "to", weight / sum(weight) OVER (PARTITION BY src) AS share, true AS forward FROM edges
  UNION ALL SELECT dst, src, weight / sum(weight) OVER (PARTITION BY dst), false FROM edges),
r0 AS MATERIALIZED (SELECT host, good AS trust, bad AS distrust FROM seeds),
{", ".join(walk)},
ranks AS (SELECT host, trust, distrust FROM r{rounds})
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN trust + distrust > 0 AND round(distrust / (trust + distrust), 9) > {threshold!r}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict, round(trust, 9) AS trust, round(distrust, 9) AS distrust
FROM (SELECT page_id, own.host, path, rule, action, coalesce(trust, 0e0) AS trust, coalesce(distrust, 0e0) AS distrust FROM own LEFT JOIN ranks USING (host)) x
"""
