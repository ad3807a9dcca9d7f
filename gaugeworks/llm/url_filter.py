"""URL filter: rules, and for what no rule fits a tree of path templates per host.

DataFrame functions only. Distinct paths of a host are put into a tree level by level. At a node, a segment becomes a
wildcard if it is variable (the node has many values with few rows each, or this value is rare among many) or
if its branch is statistically like the node as a whole: its share of blocked rows, among rows that a rule
judges, differs by two standard errors at most. Branches without judged rows cannot be compared and stay by themselves.
A template is rejected if its smoothed purity, the share of blocked among judged rows with ``PRIOR_ROWS`` rows of the
overall share, half at most, added, is high enough. The tree goes on until no path has a segment left; a path that is alone
at its node is finished there, as nothing that follows could be compared.

Tables are reduced to distinct paths before they move, and the joins of a host's many paths are spread by salt.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import write_down

#: Fixed values: (verdict, host, path) of the query's rules.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Levels of the tree that the SQL has steps for.
SQL_LEVELS = 12
MANY_VALUES = 5
FEW_ROWS = 3
RARE = 4
PRIOR_ROWS = 4
REJECT_FROM = 0.8
SALTS = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for null and for urls without ``://``."""
    url = F.coalesce(url, F.lit(""))
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(after, "^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)


def _rule(host: Column, path: Column, rules: tuple, pick) -> Column:
    """What ``pick`` says of the longest rule that fits, else null; of equally long ones that with the longer host."""
    ordered = sorted(rules, key=lambda rule: (len(rule[1] + rule[2]), len(rule[1])))
    found = F.lit(None).cast("string")
    for rule in ordered:
        fits = ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])
        found = F.when(fits, F.lit(pick(rule))).otherwise(found)
    return found


def _salt(of: str) -> Column:
    return F.pmod(F.xxhash64(of), F.lit(SALTS)).cast("int")


def _spread(small: DataFrame) -> DataFrame:
    """A copy of each row per salt, for a join with rows that carry one."""
    return small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def path_templates(paths: DataFrame) -> DataFrame:
    """(host, path, n, blocked, allowed, template) for distinct paths with numbers of rows and of those judged."""
    segments = F.filter(F.split("path", "/"), lambda part: part != "")
    tree = paths.select("*", segments.alias("segments"), F.lit("").alias("template"))
    counts = [F.sum(name).alias(name) for name in ("n", "blocked", "allowed")]
    finished, level = [], 0
    while True:
        # Every level reads the last one several times; it is written down, so that plans do not grow.
        tree = write_down(tree).withColumn("segment", F.get("segments", F.lit(level)))
        finished.append(tree.where("segment is null").select(*paths.columns, "template"))
        here = tree.where("segment is not null")
        if here.isEmpty():
            break
        children = here.groupBy("host", "template", "segment").agg(*counts, F.count("*").alias("paths"))
        nodes = children.groupBy("host", "template").agg(
            F.count("*").alias("kinds"), F.sum("n").alias("rows"), F.sum("blocked").alias("b"), F.sum("allowed").alias("a")
        )
        judged = F.col("blocked") + F.col("allowed")
        all_judged = F.col("a") + F.col("b")
        many = F.col("kinds") >= MANY_VALUES
        variable = many & (F.col("rows") < FEW_ROWS * F.col("kinds"))
        rare = many & (F.col("n") * F.col("kinds") * RARE < F.col("rows"))
        far = F.col("blocked").cast("double") * all_judged - F.col("b").cast("double") * judged
        like = (F.col("kinds") > 1) & (judged > 0) & (far * far <= 4.0 * F.col("b") * F.col("a") * judged)
        alone = (F.col("kinds") == 1) & (F.col("paths") == 1)
        marked = (
            children.withColumn("salt", _salt("segment"))
            .join(_spread(nodes), ["host", "template", "salt"])
            .where(variable | rare | like | alone)
            .select("host", "template", "segment", F.when(alone, "rest").otherwise("*").alias("mark"))
        )
        size = F.size("segments")
        rest = F.array_join(F.slice("segments", level + 1, size), "/")
        label = F.when(F.col("mark") == "rest", rest).when(F.col("mark") == "*", "*").otherwise(F.col("segment"))
        left = F.when(F.col("mark") == "rest", F.array().cast("array<string>")).otherwise(F.col("segments"))
        tree = (
            here.withColumn("salt", _salt("path"))
            .join(_spread(marked), ["host", "template", "segment", "salt"], "left")
            .select(*paths.columns, left.alias("segments"), F.concat("template", F.lit("/"), label).alias("template"))
        )
        level += 1
    return reduce(DataFrame.unionByName, finished)


def judge(pages: DataFrame, rules: tuple = RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """One row per row of ``pages``: (page_id, host, path, rule, verdict).

    ``rules`` is a short list of (verdict, host, path); the longest that fits a page's host or a domain above it and the
    start of its path wins. Other pages get the verdict of their template, ``allow`` where nothing speaks against
    it. Null urls and those without ``://`` have an empty host and path, no rule and are allowed; null keys and
    repeated rows pass through; an empty table gives an empty one. Columns other than the two named are not read.
    """
    host, path = host_and_path(F.col("u"))
    parsed = pages.select(F.col(key).alias("page_id"), F.col(url).alias("u")).select("page_id", host.alias("host"), path.alias("path"))
    ruled = parsed.select(
        "*",
        _rule(F.col("host"), F.col("path"), rules, lambda rule: rule[1] + rule[2]).alias("rule"),
        _rule(F.col("host"), F.col("path"), rules, lambda rule: rule[0]).alias("ruled"),
    )
    verdicts = [F.sum(F.when(F.col("ruled") == kind, 1).otherwise(0)).alias(name) for kind, name in (("block", "blocked"), ("allow", "allowed"))]
    paths = ruled.groupBy("host", "path").agg(F.count("*").alias("n"), *verdicts)
    templates = write_down(path_templates(paths))
    total = templates.agg(F.sum("blocked").alias("b"), F.sum("allowed").alias("a")).first()
    # At most half: where no rule has judged anything, a template is not rejected.
    share = min((total["b"] or 0) / max((total["b"] or 0) + (total["a"] or 0), 1), 0.5)
    purity = (F.sum("blocked") + PRIOR_ROWS * share) / (F.sum("blocked") + F.sum("allowed") + PRIOR_ROWS)
    rejected = templates.groupBy("host", "template").agg(purity.alias("purity")).where(F.col("purity") >= REJECT_FROM)
    # Rules depend on host and path alone: only paths that no rule fits need their template's verdict.
    open_paths = templates.where("blocked + allowed = 0").withColumn("salt", _salt("path"))
    bad = open_paths.join(_spread(rejected), ["host", "template", "salt"]).select("host", "path", F.lit("block").alias("learned"))
    rows = ruled.withColumn("salt", _salt("page_id"))
    return rows.join(_spread(bad), ["host", "path", "salt"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", "learned", F.lit("allow")).alias("verdict")
    )


def oracle(rules: tuple = RULES, depth: int = SQL_LEVELS) -> str:
    """The same in SQL, one step per level of the tree, for paths of ``depth`` segments at most."""
    ordered = sorted(rules, key=lambda rule: (-len(rule[1] + rule[2]), -len(rule[1])))

    def case(pick) -> str:
        whens = " ".join(
            f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{pick(v, h, p)}'" for v, h, p in ordered
        )
        return f"CASE {whens} END"

    levels = "".join(
        f"""
children{n} AS (SELECT host, template, segments[{n + 1}] AS segment, sum(n) AS n, sum(blocked) AS blocked, sum(allowed) AS allowed
  FROM tree{n} WHERE len(segments) > {n} GROUP BY ALL),
nodes{n} AS (SELECT host, template, count(*) AS kinds, sum(n) AS total, sum(blocked) AS b, sum(allowed) AS a
  FROM children{n} GROUP BY ALL),
wild{n} AS (SELECT c.host, c.template, segment FROM children{n} c JOIN nodes{n} p ON c.host = p.host AND c.template = p.template
  WHERE (kinds >= {MANY_VALUES} AND total < {FEW_ROWS} * kinds) OR (kinds >= {MANY_VALUES} AND n * kinds * {RARE} < total)
     OR (kinds > 1 AND blocked + allowed > 0 AND (blocked::DOUBLE * (a + b) - b::DOUBLE * (blocked + allowed)) ** 2
         <= 4.0::DOUBLE * b::DOUBLE * a * (blocked + allowed))),
tree{n + 1} AS (SELECT t.host, path, n, blocked, allowed, segments, t.template ||
    CASE WHEN len(segments) <= {n} THEN '' WHEN w.segment IS NOT NULL THEN '/*' ELSE '/' || segments[{n + 1}] END AS template
  FROM tree{n} t LEFT JOIN wild{n} w ON t.host = w.host AND t.template = w.template AND segments[{n + 1}] = w.segment),"""
        for n in range(depth)
    )
    return f"""
WITH rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parsed AS (SELECT page_id, regexp_replace(regexp_extract(r, '^[^/?#]*'), '[?#].*', '') AS raw, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
cased AS (SELECT page_id, translate(raw, '{_UPPER}', '{_LOWER}') AS host, path FROM parsed),
ruled AS (SELECT *, {case(lambda v, h, p: h + p)} AS rule, {case(lambda v, h, p: v)} AS ruled FROM cased),
tree0 AS (SELECT host, path, count(*) AS n, count(*) FILTER (ruled = 'block') AS blocked, count(*) FILTER (ruled = 'allow') AS allowed,
  list_filter(string_split(path, '/'), lambda s: s <> '') AS segments, '' AS template FROM ruled GROUP BY host, path),{levels}
finished AS (SELECT host, path, blocked, allowed, template FROM tree{depth}),
overall AS (SELECT least(sum(blocked)::DOUBLE / greatest(sum(blocked) + sum(allowed), 1), 0.5::DOUBLE) AS share FROM finished),
rejected AS (SELECT host, template FROM finished, overall GROUP BY host, template, share
  HAVING (sum(blocked) + {PRIOR_ROWS} * share) / (sum(blocked) + sum(allowed) + {PRIOR_ROWS}) >= {REJECT_FROM}),
bad AS (SELECT f.host, f.path FROM finished f JOIN rejected j ON f.host = j.host AND f.template = j.template WHERE blocked + allowed = 0)
SELECT page_id, r.host, r.path, rule, coalesce(ruled, CASE WHEN bad.host IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM ruled r LEFT JOIN bad ON r.host = bad.host AND r.path = bad.path"""
