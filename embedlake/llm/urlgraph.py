"""Operator 13: URL filters by rules and by a propagation of trust over host links. DataFrame functions only.

Rules name a host and the start of a path; the longest rule that fits a page decides it. What no rule decides is
judged by its host. Each host is a seed of trust to the share of its pages that rules allow, and a seed of distrust
to the share that rules block; a host that is only linked to is one if a rule fits its top page. Trust is a
personalised PageRank along links between hosts: a host passes ``DAMPING`` hundredths of its trust to the hosts
that it links to, by the number of its pages that do. Distrust runs the same way against the links: a blocked host
passes it to the hosts that link to it. A host whose distrust exceeds its trust by more than ``LIMIT`` is blocked;
without links that means more blocked than allowed pages by half of all its pages. Links within a host don't count.

Scores are whole billionths and sums of whole numbers, so they don't depend on the order of rows. ``rounds`` rounds
are made, or fewer if scores stand still before. Each round is one join of links with the scores of their hosts,
dealt out by host and a salt, and one sum; a hub's links go to several tasks. Pages are joined with what is known of
hosts by broadcast if that is short (it is counted first), else by host and salt.

Cases: a null url, or one without ``://``, has neither host nor path, fits no rule and is allowed; a host keeps its
port and user; null html has no links; repeated ids are judged each by its url; rules of equal length: the one
with the longer host, then the blocking one; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from embedlake.llm._work import Workspace, join_facts

#: One, in the scores' numbers.
UNIT = 1_000_000_000
#: Hundredths of a score that links pass on, rounds, and the excess of distrust at which a host is blocked.
DAMPING, ROUNDS, LIMIT = 85, 40, 0.5
SALTS = 8
#: Host and path of an address, and the hosts of links in a page.
ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"(?i)href[\x20\x09-\x0D]*=[\x20\x09-\x0D]*[\"']?[\x20\x09-\x0D]*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'<>\x20\x09-\x0D]+)"


def _lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def parts(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z in lower case, and path; both empty where there is no ``://``."""
    url = F.coalesce(url, F.lit(""))
    return _lower(F.regexp_extract(url, ADDRESS, 1)), F.regexp_extract(url, ADDRESS, 2)


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(verdict, rule) rows of a short list of rules, such as ``("block", "example.com/de/")``."""
    made = F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(r).alias("rule")) for v, r in rules] or [F.struct(F.lit(None).cast("string").alias("verdict"), F.lit(None).cast("string").alias("rule"))])
    return spark.range(1).select(F.inline(made)).where("rule is not null")


def _suffixes(host: Column) -> Column:
    """The host and the domains that it lies in."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def _host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): those that fit the host, for hosts that any fits."""
    cut = F.instr("rule", "/") - 1
    known = rules.select("verdict", "rule", F.when(cut >= 0, _lower(F.substring("rule", F.lit(1), cut))).otherwise(_lower(F.col("rule"))).alias("at"), F.when(cut >= 0, F.substring("rule", cut + 1, F.length("rule"))).otherwise("").alias("start"))
    met = hosts.select("host", F.explode(_suffixes(F.col("host"))).alias("at")).join(known, "at")
    order = F.struct(F.length("rule").alias("size"), F.length("at").alias("of"), (F.col("verdict") == "block").alias("strict"), "rule", "verdict", "start")
    return met.groupBy("host").agg(F.collect_list(order).alias("rules"))


def _decided(path: Column) -> Column:
    """The longest of ``rules`` that fits the path, or null."""
    return F.array_max(F.filter("rules", lambda r: F.startswith(path, r["start"])))


def links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, n): hosts that link to other hosts, and on how many pages they do."""
    host, _ = parts(F.col(url_col))
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(LINK), 1), _lower))
    return pages.select(host.alias("src"), F.explode(found).alias("dst")).where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def _arcs(ws: Workspace, edges: DataFrame) -> DataFrame:
    """(kind, src, dst, share): along links for trust (1), against them for distrust (-1); shares of a source make one."""
    both = edges.select(F.lit(1).alias("kind"), "src", "dst", "n").unionAll(edges.select(F.lit(-1), F.col("dst"), F.col("src"), "n"))
    totals = ws.save(both.groupBy("kind", "src").agg(F.sum("n").alias("all")), "totals")
    share = F.expr(f"cast(n as decimal(20, 0)) * {UNIT} div all")
    return join_facts(both, totals, ["kind", "src"], F.xxhash64("dst"), "inner").select("kind", "src", "dst", share.alias("share"))


def scores(ws: Workspace, seeds: DataFrame, edges: DataFrame, damping: int = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(kind, host, score) above zero after ``rounds`` rounds from ``seeds`` of the same columns, over ``edges`` (src, dst, n)."""
    seeds = ws.save(seeds.where("score > 0"), "seeds")
    if edges.isEmpty():
        return seeds
    arcs = ws.save(_arcs(ws, edges).withColumn("salt", F.pmod(F.xxhash64("dst"), F.lit(SALTS)).cast("int")), "arcs")
    state, total = seeds, None
    for k in range(rounds):
        spread = state.withColumnRenamed("host", "src").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        passed = F.expr(f"cast(score as decimal(20, 0)) * cast(share * {damping} as decimal(13, 0)) div {100 * UNIT}")
        sent = arcs.join(spread, ["kind", "src", "salt"]).select("kind", F.col("dst").alias("host"), passed.alias("score"))
        new = ws.save(seeds.unionByName(sent).groupBy("kind", "host").agg(F.sum("score").cast("bigint").alias("score")).where("score > 0"), f"scores-{k}")
        if k:
            ws.drop(f"scores-{k - 1}")
        # scores never fall, so equal sums are equal scores
        state, before, total = new, total, new.agg(F.sum(F.col("score").cast("decimal(38, 0)"))).first()[0]
        if before == total:
            break
    return state


def judge(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", edges: DataFrame | None = None,
    damping: int = DAMPING, rounds: int = ROUNDS, limit: float = LIMIT,
) -> DataFrame:
    """id, host, path, rule (or null) and verdict (allow or block) of each page.

    ``rules`` has the columns verdict and rule, see ``rule_table``; the rules that fit one host are held together.
    ``edges`` (src, dst, n) replaces the links that pages hold.
    """
    ws = Workspace(pages.sparkSession, "urls")
    host, path = parts(F.col(url_col))
    read = pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"))
    edges = ws.save(links(pages, url_col, html_col) if edges is None else edges.where("src <> dst"), "links")
    hosts = read.select("host").unionAll(edges.select("dst")).where("host <> ''").distinct()
    fit = ws.save(_host_rules(hosts, rules), "rules")
    best = _decided(F.col("path"))
    judged = join_facts(read, fit, ["host"], F.xxhash64("_id", "path")).select("_id", "host", "path", best.alias("b"))
    judged = ws.save(judged.select("_id", "host", "path", F.col("b.rule").alias("rule"), F.col("b.verdict").alias("ruled")), "judged")
    seen = judged.where("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("ruled") == "allow").alias("good"), F.count_if(F.col("ruled") == "block").alias("bad"))
    top = _decided(F.lit("/"))["verdict"]
    unseen = edges.select(F.col("dst").alias("host")).distinct().join(seen.select("host"), "host", "left_anti").join(fit, "host").select(
        "host", F.lit(1).alias("n"), (top == "allow").cast("int").alias("good"), (top == "block").cast("int").alias("bad"))
    both = seen.unionByName(unseen).select("host", F.explode(F.array(F.struct(F.lit(1).alias("kind"), F.col("good").cast("bigint").alias("m")), F.struct(F.lit(-1).alias("kind"), F.col("bad").cast("bigint").alias("m")))).alias("s"), "n")
    seeds = both.select("s.kind", "host", F.expr(f"s.m * {UNIT} div n").alias("score"))
    found = scores(ws, seeds, edges, damping, rounds)
    excess = found.groupBy("host").agg(F.sum(-F.col("kind") * F.col("score")).alias("excess"))
    blocked = ws.save(excess.where(F.col("excess") > round(limit * UNIT)).select("host", F.lit(True).alias("blocked")), "blocked")
    ws.drop("links", "rules", "seeds", "totals", "arcs")
    out = join_facts(judged, blocked, ["host"], F.xxhash64("_id", "path"))
    verdict = F.coalesce("ruled", F.when(F.col("blocked"), "block").otherwise("allow"))
    return out.select(F.col("_id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"))
