"""URL filters by rules and by a path-template tree, in DataFrame functions only.

Per host, paths form a tree. From the root down, segments that are rare below their parent become ``*``; frequent siblings whose
labelled pages are not significantly different from their parent's become ``*`` too (merged branches). Each leaf of what is left is
a template, rejected if its smoothed share of pages labelled as blocked is one half or more. Labels come from the rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, table

#: (verdict, host, path): fits the host and all its subdomains where the path starts so; the longest rule wins.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: A segment stays if it has MIN_PAGES pages and one in MIN_SHARE of its parent's.
MIN_PAGES, MIN_SHARE = 3, 10
#: Pages that a template's prior counts for.
STRENGTH = 5.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def ruled(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The rule that fits (as host + path) and its verdict; null where none does."""
    best = F.lit(None).cast("string")
    verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        best, verdict = F.when(fits, F.lit(h + p)).otherwise(best), F.when(fits, F.lit(v)).otherwise(verdict)
    return best, verdict


def templates(paths: DataFrame) -> DataFrame:
    """From distinct (host, path, pages, blocked, labelled) rows to the same rows with a template.

    One level a round; a round's tables are kept, so that plans stay short. All steps are aggregates with partial sums, and joins on
    (host, template, segment). A branch that has too few pages for any frequent segment, or labels of one kind only, has no segment that
    stays, here or below: its paths get ``*`` for all the rest and leave. So there are as many rounds as branches are deep that may still
    split, whatever the depth of the paths.
    """
    segments = F.filter(F.split("path", "/"), lambda x: x != "")
    rows = keep(paths.withColumn("segments", segments).withColumn("template", F.lit("")), "tree")
    out, level = None, 0
    sums = ("pages", "blocked", "labelled")
    while True:
        level += 1
        here = rows.withColumn("segment", F.get("segments", F.lit(level - 1)))
        child = here.where("segment is not null").groupBy("host", "template", "segment").agg(*(F.sum(c).alias(c) for c in sums))
        parent = child.groupBy("host", "template").agg(*(F.sum(c).alias(f"p_{c}") for c in sums))
        live = parent.where((F.col("p_pages") >= MIN_PAGES) & (F.col("p_blocked") > 0) & (F.col("p_blocked") < F.col("p_labelled")))
        b, n, pb, pn = (F.col(c).cast("double") for c in ("blocked", "labelled", "p_blocked", "p_labelled"))
        apart = (b * pn - pb * n) * (b * pn - pb * n) > 4 * pb * (pn - pb) * n
        frequent = (F.col("pages") >= MIN_PAGES) & (F.col("pages") * MIN_SHARE >= F.col("p_pages"))
        stays = child.join(live, ["host", "template"]).where(frequent & apart).select("host", "template", "segment", F.lit(True).alias("stays"))
        step = F.when(F.col("stays"), F.concat(F.lit("/="), "segment")).otherwise(F.lit("/*"))
        met = here.join(stays, ["host", "template", "segment"], "left").join(live.select("host", "template", F.lit(True).alias("live")), ["host", "template"], "left")
        left = F.size("segments") - (level - 1)
        met = met.withColumn("ends", F.col("live").isNull() | (left <= 1))
        rest = F.when(left <= 0, F.lit("")).when(F.col("live").isNull(), F.expr(f"repeat('/*', size(segments) - {level - 1})")).otherwise(step)
        met = keep(met.withColumn("template", F.concat("template", rest)).drop("segment", "stays", "live"), "tree")
        done = met.where("ends").drop("segments", "ends")
        out = done if out is None else out.unionByName(done)
        rows = met.where("not ends").drop("ends")
        if not rows.limit(1).count():
            return out


def judge(pages: DataFrame, url: str = "url", rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Adds host, path, rule, verdict, template and purity (the smoothed blocked share) to the rows; columns of these names are replaced.

    Hosts without any labelled page reject nothing. A null url, or one without ``://``, has an empty host and path. Rows that a rule fits get its verdict, the others their template's.
    """
    pages = pages.drop("host", "path", "rule", "verdict", "template", "purity")
    seen = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    seen = seen.withColumns({"rule": rule, "_ruled": verdict})
    paths = seen.groupBy("host", "path").agg(F.count("*").alias("pages"), F.sum(F.when(F.col("_ruled") == "block", 1).otherwise(0)).alias("blocked"), F.count("_ruled").alias("labelled"))
    tree = keep(templates(paths), "templates")
    hosts = tree.groupBy("host").agg(F.sum("blocked").alias("h_blocked"), F.sum("labelled").alias("h_labelled"))
    whole = hosts.agg(F.coalesce(F.sum("h_blocked"), F.lit(0)).alias("b"), F.coalesce(F.sum("h_labelled"), F.lit(0)).alias("n")).first()
    base = F.lit(float((whole.b + 1.0) / (whole.n + 2.0)))
    leaf = tree.groupBy("host", "template").agg(F.sum("blocked").alias("t_blocked"), F.sum("labelled").alias("t_labelled"))
    prior = F.when(F.col("h_labelled") == 0, F.lit(0.0)).otherwise((F.col("h_blocked") + STRENGTH * base) / (F.col("h_labelled") + STRENGTH))
    pure = leaf.join(hosts, "host").select("host", "template", ((F.col("t_blocked") + STRENGTH * prior) / (F.col("t_labelled") + STRENGTH)).alias("purity"))
    verdicts = tree.join(pure, ["host", "template"]).select("host", "path", "template", "purity")
    named = F.coalesce("_ruled", F.when(F.col("purity") >= 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return seen.join(verdicts, ["host", "path"]).withColumn("verdict", named).drop("_ruled")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "template", F.round("purity", 6).alias("purity"))


def _sql() -> str:
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    longest = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    case = lambda value: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{value(v, h, p)}'" for v, h, p in longest) + " END"
    out = [f"""WITH RECURSIVE cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM cut
), seen AS (
  SELECT *, {case(lambda v, h, p: h + p)} AS rule, {case(lambda v, h, p: v)} AS ruled FROM split
), t0 AS (
  SELECT host, path, count(*) AS pages, sum(CASE WHEN ruled = 'block' THEN 1 ELSE 0 END) AS blocked, count(ruled) AS labelled,
         list_filter(string_split(path, '/'), lambda x: x <> '') AS segments, '' AS template
  FROM seen GROUP BY host, path
)"""]
    out.append(f""", lv AS (
  SELECT 0 AS level, host, path, pages, blocked, labelled, segments, template FROM t0
  UNION ALL SELECT level, host, path, pages, blocked, labelled, segments, template || CASE WHEN sp >= {MIN_PAGES} AND sp * {MIN_SHARE} >= pp AND (b * pn - pb * n) * (b * pn - pb * n) > 4 * pb * (pn - pb) * n THEN '/=' || segment ELSE '/*' END FROM (
    SELECT *, sum(pages) OVER s AS sp, sum(blocked) OVER s::DOUBLE AS b, sum(labelled) OVER s::DOUBLE AS n, sum(pages) OVER w AS pp, sum(blocked) OVER w::DOUBLE AS pb, sum(labelled) OVER w::DOUBLE AS pn
    FROM (SELECT level + 1 AS level, host, path, pages, blocked, labelled, segments, template, segments[level + 1] AS segment FROM lv WHERE len(segments) > level)
    WINDOW w AS (PARTITION BY host, template), s AS (PARTITION BY host, template, segment))
)""")
    out.append(f""", tree AS (
  SELECT host, path, blocked, labelled, template FROM lv WHERE level = len(segments)
), g AS (SELECT (coalesce(sum(blocked), 0) + 1.0::DOUBLE) / (coalesce(sum(labelled), 0) + 2.0::DOUBLE) AS base FROM tree
), h AS (SELECT host, CASE WHEN sum(labelled) = 0 THEN 0.0::DOUBLE ELSE (sum(blocked) + {STRENGTH}::DOUBLE * any_value(base)) / (sum(labelled) + {STRENGTH}::DOUBLE) END AS prior FROM tree, g GROUP BY host
), p AS (
  SELECT tree.host, template, (sum(blocked) + {STRENGTH}::DOUBLE * any_value(prior)) / (sum(labelled) + {STRENGTH}::DOUBLE) AS purity
  FROM tree JOIN h ON h.host = tree.host GROUP BY tree.host, template
)
SELECT page_id, seen.host AS host, seen.path AS path, rule, coalesce(ruled, CASE WHEN purity >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict, tree.template AS template, round(purity, 6) AS purity
FROM seen JOIN tree ON tree.host = seen.host AND tree.path = seen.path JOIN p ON p.host = tree.host AND p.template = tree.template""")
    return "".join(out)


OP10_SQL = _sql()
