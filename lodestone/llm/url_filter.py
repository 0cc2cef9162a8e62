"""URL filters by link-graph propagation.

Rules decide the pages that they fit. Their share of a host's pages is the
host's seed: allowed pages make trust, blocked pages distrust. Trust follows
links between hosts by personalised PageRank, distrust goes back along them.
A page without a rule gets its host's verdict: block where distrust exceeds
trust by MARGIN, which is what half of a host's pages give without any link.

Scores are linear in the seeds and are not scaled to a sum of one, so a
threshold means the same whatever the number of hosts.

Defined results: a null url or one without ``://`` has empty host and path and
is allowed; a null html has no links; repeated links count once and links
inside a host not at all; repeated rows are judged alike; an empty table gives
an empty result; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Scratch

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
DAMPING = 0.85
ITERATIONS = 20
MARGIN = (1 - DAMPING) * 0.5
MAX_BROADCAST = 200_000  # hosts whose verdicts are broadcast at most
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i:href)[ \t\r\n]*=[ \t\r\n]*["']?(?i:https?:)?//([^/?#"'<> \t\r\n]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules) -> Column:
    """The longest fitting rule as a struct (verdict, rule), or null."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[0])):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(slash + p))
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def judged(pages: DataFrame, rules=RULES, page_col="page_id", url_col="url") -> DataFrame:
    host, path = host_and_path(F.col(url_col))
    p = pages.select(F.col(page_col).alias("page_id"), host.alias("host"), path.alias("path"))
    return p.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "fit.rule", F.col("fit.verdict").alias("ruled"))


def host_edges(pages: DataFrame, url_col="url", html_col="html") -> DataFrame:
    """Distinct (src, dst) links between different hosts."""
    host, _ = host_and_path(F.col(url_col))
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(LINK), F.lit(1)))
    e = pages.select(host.alias("src"), F.explode(found).alias("dst")).withColumn("dst", F.translate("dst", UPPER, LOWER))
    return e.where("src != '' AND src != dst").distinct()


def host_scores(seeds: DataFrame, edges: DataFrame, iterations: int = ITERATIONS, damping: float = DAMPING) -> DataFrame:
    """seeds (host, trust, distrust) and edges → (host, trust, distrust).

    Both propagations run as one: a row of the graph is (kind, from, to, w).
    A round is one join and one partly pre-aggregated sum, written to the
    shared folder."""
    scratch = Scratch(seeds.sparkSession)
    edges = scratch.save(edges)
    # written before the joins, so that the rows of a hub host can be split
    out_n = scratch.save(edges.groupBy("src").agg(F.count("*").alias("n")))
    in_n = scratch.save(edges.groupBy("dst").agg(F.count("*").alias("n")))
    forward = edges.join(out_n, "src").select(F.lit("trust").alias("kind"), F.col("src").alias("from"), F.col("dst").alias("to"), (damping / F.col("n")).alias("w"))
    backward = edges.join(in_n, "dst").select(F.lit("distrust").alias("kind"), F.col("dst").alias("from"), F.col("src").alias("to"), (damping / F.col("n")).alias("w"))
    graph = scratch.save(forward.union(backward))
    scratch.drop(edges, out_n, in_n)
    base = scratch.save(seeds.select("host", F.explode(F.create_map(F.lit("trust"), "trust", F.lit("distrust"), "distrust")).alias("kind", "score")).select("kind", "host", (F.col("score") * (1 - damping)).alias("score")).where("score > 0"))
    score = base
    for _ in range(0 if graph.isEmpty() else iterations):
        sent = score.join(graph, (score["kind"] == graph["kind"]) & (score["host"] == graph["from"])).select(graph["kind"], F.col("to").alias("host"), (F.col("score") * F.col("w")).alias("score"))
        nxt = scratch.save(base.union(sent).groupBy("kind", "host").agg(F.sum("score").alias("score")))
        if score is not base:
            scratch.drop(score)
        score = nxt

    def of(kind):
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0)).alias(kind)

    out = scratch.cut(score.groupBy("host").agg(of("trust"), of("distrust")))
    scratch.drop(graph, base, *([score] if score is not base else []))
    return out


def filter_urls(pages: DataFrame, rules=RULES, iterations: int = ITERATIONS, margin: float = MARGIN, page_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust."""
    p = judged(pages, rules, page_col, url_col)

    def share(verdict):
        return F.avg(F.when(F.col("ruled") == verdict, 1.0).otherwise(0.0))

    seeds = p.where("host != ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    scores = host_scores(seeds, host_edges(pages, url_col, html_col), iterations)
    if scores.count() <= MAX_BROADCAST:
        scores = F.broadcast(scores)
    j = p.join(scores, "host", "left").withColumn("trust", F.coalesce("trust", F.lit(0.0))).withColumn("distrust", F.coalesce("distrust", F.lit(0.0)))
    method = F.when(F.col("distrust") - F.col("trust") >= margin, "block").otherwise("allow")
    return j.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "trust", "distrust")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


def _linked_to(page: str) -> str:
    return f"({page} * {page} + 7 * {page} + 3)"


def linked_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, with a link from each to the host of another one, as the
    given pages link to no other host; scores as well as verdicts."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    n = pages.count()
    target = pages.select((F.col("page_id") % n).alias("target"), host_and_path(F.col("url"))[0].alias("to"))
    linked = pages.withColumn("target", F.expr(f"{_linked_to('page_id')} % {n}")).join(target, "target", "left")
    linked = linked.withColumn("html", F.concat(F.coalesce("html", F.lit("")), F.lit('<a href="http://'), F.coalesce("to", F.lit("nowhere.org")), F.lit('/">x</a>')))
    out = filter_urls(linked)
    return out.select("page_id", "host", "rule", "verdict", F.round("trust", 9).alias("trust"), F.round("distrust", 9).alias("distrust"))


def _sql(linked: bool = False) -> str:
    rest = "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END"
    host = f"coalesce(translate(regexp_extract({rest}, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '')"
    fits = []
    for verdict, rule in sorted(RULES, key=lambda r: -len(r[1])):
        h, slash, p = rule.partition("/")
        fits.append((f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{slash}{p}')", verdict, rule))
    case = lambda i: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[i]}'" for f in fits) + " END"
    rounds = ", ".join(
        f"r{i} AS (SELECT kind, host, sum(score) AS score FROM (SELECT * FROM base UNION ALL SELECT g.kind, g.to_, score * w FROM r{i - 1} r JOIN graph g ON r.kind = g.kind AND r.host = g.from_) GROUP BY ALL)"
        for i in range(1, ITERATIONS + 1)
    )
    link = LINK.replace("'", "''")
    table, with_, shown = "pages", "", "page_id, p.host, path, rule"
    if linked:
        table, shown = "linked", "page_id, p.host, rule, round(coalesce(t, 0), 9) AS trust, round(coalesce(b, 0), 9) AS distrust"
        with_ = f"""linked AS (SELECT a.page_id, a.url, coalesce(a.html, '') || '<a href="http://' || coalesce(c.to_, 'nowhere.org') || '/">x</a>' AS html FROM pages a
  LEFT JOIN (SELECT page_id % (SELECT count(*) FROM pages) AS target, {host} AS to_ FROM pages) c ON c.target = {_linked_to('a.page_id')} % (SELECT count(*) FROM pages)),"""
    return f"""
WITH {with_} p0 AS (SELECT page_id, html, {host} AS host, coalesce(regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1), '') AS path FROM {table}),
p AS (SELECT *, {case(2)} AS rule, {case(1)} AS ruled FROM p0),
e AS (SELECT DISTINCT src, translate(dst, '{UPPER}', '{LOWER}') AS dst FROM (SELECT host AS src, unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)) AS dst FROM p)
      WHERE src <> '' AND src <> translate(dst, '{UPPER}', '{LOWER}')),
graph AS (SELECT 'trust' AS kind, src AS from_, dst AS to_, {DAMPING} / count(*) OVER (PARTITION BY src) AS w FROM e
          UNION ALL SELECT 'distrust', dst, src, {DAMPING} / count(*) OVER (PARTITION BY dst) FROM e),
base AS (SELECT kind, host, (avg(CASE WHEN ruled = v THEN 1.0 ELSE 0.0 END) * {1 - DAMPING})::DOUBLE AS score FROM p, (VALUES ('trust', 'allow'), ('distrust', 'block')) k(kind, v) WHERE host <> '' GROUP BY kind, host HAVING score > 0),
r0 AS (SELECT * FROM base), {rounds},
s AS (SELECT host, coalesce(sum(score) FILTER (kind = 'trust'), 0) AS t, coalesce(sum(score) FILTER (kind = 'distrust'), 0) AS b FROM r{ITERATIONS} GROUP BY host)
SELECT {shown}, coalesce(ruled, CASE WHEN coalesce(b, 0) - coalesce(t, 0) >= {MARGIN} THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN s ON s.host = p.host"""


SQL = _sql()
LINKED_SQL = _sql(linked=True)
