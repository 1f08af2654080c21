"""URL filtering by link-graph propagation. DataFrame functions only.

Rules decide the pages they fit. For the rest, hosts are scored on the host graph: trust is a
personalised PageRank that starts from hosts of allowed pages and follows the edges; distrust
starts from hosts of blocked pages and follows them backwards. A host is blocked where its
distrust exceeds its trust by the threshold.

Host edges are the links of the pages; a relative link leads to the page's own host and ties no
two hosts. With ``steps`` a host is tied to its parent domain as well (both ways), but never to a
suffix under which others register: a single label, or a category of SUFFIXES under a country.
Links are counted by host pair before any shuffle; both propagations share one table keyed by
(side, host), so a round is one join and one sum. What moves is written to the shared folder
every round. Rounds end when a round reaches no new host and changes no host's rank by more
than a tolerance of its own, whatever the size of the graph; there is no other end.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule,
has no edges and is allowed; a null html has no links; a very long url or html is read whole;
hosts that no seed reaches are allowed, and so are those whose trust equals their distrust; of
rules of equal length that fit, the later one decides;
repeated rows count as often as they come; an empty table gives an empty one; columns of the
input named like those of the result are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, written

#: (verdict, host, path): the longest fitting one decides.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DAMPING, THRESHOLD, TOLERANCE, EVERY = 0.85, 0.0, 1e-3, 4
#: Edges for a task of a round at least: a small graph is not dealt out over many files.
TASK_EDGES = 200_000
#: Categories under which countries register domains, as in co.uk or com.br.
SUFFIXES = ("ac", "co", "com", "edu", "go", "gob", "gov", "gv", "ltd", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """``pages`` with host, path, rule and the rule's verdict (both null where none fits)."""
    rows = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rows.withColumns({"rule": rule, "ruled": verdict})


def is_suffix(domain: Column) -> Column:
    """Whether domains of different owners may stand below this one."""
    category = F.lit(rf"^(?:{'|'.join(SUFFIXES)})\.[a-z][a-z]$")
    return ~domain.contains(".") | F.regexp_like(domain, category)


def host_edges(pages: DataFrame, steps: bool = False) -> DataFrame:
    """(src, dst, n) between different hosts; ``pages`` has host and html."""
    link = F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(r"(?i)href\s*=\s*[\"']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\s>]+)"), F.lit(1))))
    links = pages.where("host <> '' and html is not null").select(F.col("host").alias("src"), link.alias("dst"))
    links = links.withColumn("dst", F.translate("dst", UPPER, LOWER)).where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    return _with_steps(pages, links) if steps else links


def _with_steps(pages: DataFrame, links: DataFrame) -> DataFrame:
    # every domain above a host up to its suffix: one step each, however many pages the host has
    hosts = pages.where("host <> ''").select("host").union(links.select("dst")).distinct()
    parts = F.split("host", r"\.")
    chain = hosts.where(~F.col("host").rlike(r"(?:^|\.)[0-9]+$")).select(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")).alias("c"))
    steps = chain.where(F.size("c") > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.struct(F.element_at("c", i).alias("a"), F.element_at("c", i + 1).alias("b")))).alias("s"))
    steps = steps.select("s.a", "s.b").where(~is_suffix(F.col("b"))).distinct()
    both = steps.union(steps.select("b", "a")).toDF("src", "dst").withColumn("n", F.lit(1).cast("long"))
    return links.union(both).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) from ``seeds(host, good, bad)``, each side starting with mass 1.

    Mass of hosts without edges on a side returns to that side's seeds. Every EVERY rounds the last
    one is compared with the one before, host by host: another follows while a host is new or
    has changed by more than ``tolerance`` of its rank.
    """
    sided = edges.select(F.lit("t").alias("side"), "src", "dst", "n").union(edges.select(F.lit("d"), F.col("dst"), F.col("src"), "n"))
    out = sided.groupBy("side", "src").agg(F.sum("n").alias("out"))
    sided = written(sided.join(out, ["side", "src"]).select("side", "src", "dst", (F.col("n") / F.col("out")).alias("w")), "url-edges")
    count = sided.count()
    tasks = max(1, -(-count // TASK_EDGES))
    start = seeds.select(F.lit("t").alias("side"), "host", F.col("good").alias("m")).union(seeds.select(F.lit("d"), "host", "bad")).where("m > 0")
    mass = start.groupBy("side").agg(F.sum("m").alias("all"))
    start = written(start.join(mass, "side").select("side", "host", (F.col("m") / F.col("all")).alias("jump")).coalesce(tasks), "url-seeds")
    ranks, k = start.select("side", "host", F.col("jump").alias("rank")), 0
    while count:
        old = ranks
        moved = (
            ranks.join(sided, (ranks["side"] == sided["side"]) & (ranks["host"] == sided["src"]))
            .select(sided["side"], F.col("dst").alias("host"), (F.col("rank") * F.col("w") * damping).alias("m"))
            .groupBy("side", "host")
            .agg(F.sum("m").alias("m"))
        )
        moved = written(moved.coalesce(tasks), "url-moved")
        kept = {r.side: r.kept for r in moved.groupBy("side").agg(F.sum("m").alias("kept")).collect()}
        back = F.when(F.col("side") == "t", F.lit(1.0 - kept.get("t", 0.0))).otherwise(F.lit(1.0 - kept.get("d", 0.0)))
        jumps = start.select("side", "host", (F.col("jump") * back).alias("m"))
        ranks = moved.union(jumps).groupBy("side", "host").agg(F.sum("m").alias("rank")).coalesce(tasks)
        k += 1
        if k % EVERY == 0:
            now = F.sum(F.when(F.col("now"), F.col("rank")).otherwise(0.0))
            before = F.sum(F.when(F.col("now"), 0.0).otherwise(F.col("rank")))
            both = old.withColumn("now", F.lit(False)).unionByName(ranks.withColumn("now", F.lit(True))).groupBy("side", "host").agg(now.alias("a"), before.alias("b"))
            if both.where((F.col("a") > 0) & ((F.col("b") == 0) | (F.abs(F.col("a") - F.col("b")) > tolerance * F.col("a")))).isEmpty():
                break
    ranks = written(ranks, "url-ranks")
    one = lambda side: F.coalesce(F.sum(F.when(F.col("side") == side, F.col("rank"))), F.lit(0.0))
    return ranks.groupBy("host").agg(one("t").alias("trust"), one("d").alias("distrust"))


def judge(pages: DataFrame, rules=RULES, damping: float = DAMPING, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, steps: bool = False) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust), one row for each page."""
    rows = ruled(pages, rules)
    seeds = rows.where("ruled is not null and host <> ''").groupBy("host").agg(F.count_if(F.col("ruled") == "allow").alias("good"), F.count_if(F.col("ruled") == "block").alias("bad"))
    edges = written(host_edges(rows.select("host", "html"), steps), "url-graph")
    scores = propagate(edges, written(seeds, "url-marks"), damping, tolerance)
    scored = rows.select("page_id", "host", "path", "rule", "ruled").join(scores, "host", "left")
    own = F.when(F.coalesce("distrust", F.lit(0.0)) - F.coalesce("trust", F.lit(0.0)) > threshold, F.lit("block")).otherwise(F.lit("allow"))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), zero("trust"), zero("distrust"))
