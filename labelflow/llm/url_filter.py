"""URL filter: rules by host and path, and a tree of path templates per host.

Method. Every host has a tree whose levels are the path's segments (level ``LEVELS`` holds the rest
of the path as one segment). Going down level by level, below each node:

* a form with digits that has more than ``VARIABLE`` different segments becomes a wildcard, every
  run of digits written ``<n>``;
* a branch is compared with all its siblings together by a chi-square statistic over six kinds of
  urls (labelled bad, labelled good or unlabelled; ending here or going on). Branches that do not
  differ, and those with fewer than ``MIN_BRANCH`` urls, merge into ``*``; an only child keeps its
  name.

A node's purity is the share of bad ones among its labelled urls, smoothed with ``STRENGTH`` urls of
its parent's purity, from ``PRIOR`` above the root down. Templates with at least ``MIN_LABELLED``
labelled urls and a purity of ``REJECT`` or more are rejected. Rules come before the tree; where no
label table is given, the urls that a rule decides are the labelled ones.

Only DataFrame functions. A url meets the tree in equi joins on host and template; the tree's side
is copied ``SALTS`` times and urls are spread by page_id, so one host or template may hold most of
the rows. Statistics are aggregated in the tasks before anything moves; a node's children are never
listed. The rules are a short list and become expressions.

Defined results: url null or without ``://``: host and path empty. The rule with the most characters
wins, of equals the one with the longer host, then the first in text order. Repeated rows and null
page_ids stay; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, shared_table

LEVELS = 4
VARIABLE = 8
MIN_BRANCH = 10
DIFFERENT = 20.515  # chi-square, 5 degrees of freedom, p = 0.001
STRENGTH = 4.0
PRIOR = 0.5
MIN_LABELLED = 5
REJECT = 0.8
SALTS = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KINDS = ("bad_end", "bad_on", "good_end", "good_on", "none_end", "none_on")
Rule = tuple[str, str, str]  # verdict, host, path


def split_url(df: DataFrame, url: str = "url") -> DataFrame:
    """``df`` with ``host`` and ``path``."""
    rest = F.expr(f"CASE WHEN instr(`{url}`, '://') > 0 THEN substr(`{url}`, instr(`{url}`, '://') + 3) ELSE '' END")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.expr("substr(_rest, length(_host) + 1)"), r"^[^?#]*", 0)
    return (df.withColumn("_rest", rest).withColumn("_host", raw).withColumn("path", path)
            .withColumn("host", F.translate("_host", UPPER, LOWER)).drop("_rest", "_host"))


def ordered(rules: list[Rule]) -> list[Rule]:
    return sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), -len(r[1]), r[1], r[2], r[0]))


def rule_of(rules: list[Rule]):
    """Struct (rule, verdict) of the winning rule, null where none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, host, path in reversed(ordered(rules)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        out = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def salted(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def level_rows(rows: DataFrame, level: int) -> DataFrame:
    """Urls that reach the level: segment, its form, the kind of the url."""
    parts = F.split("path", "/")
    seg = F.element_at(parts, level + 1) if level < LEVELS else F.array_join(F.slice(parts, level + 1, F.size(parts)), "/")
    ends = F.lit(True) if level == LEVELS else F.size(parts) == level + 1
    kind = F.concat(F.coalesce("label", F.lit("none")), F.when(ends, "_end").otherwise("_on"))
    return (rows.where(F.size(parts) > level).withColumn("seg", seg).withColumn("form", F.regexp_replace(seg, "[0-9]+", "<n>"))
            .withColumn("kind", kind))


def branch(rows: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """One level: (urls with their template one segment longer, nodes of the level with the sums of
    labels and their parent's template)."""
    here = level_rows(rows, level)
    wide = (here.where("form <> seg").select("host", "tmpl", "form", "seg").distinct()
            .groupBy("host", "tmpl", "form").count().where(F.col("count") > VARIABLE).select("host", "tmpl", "form", F.lit(True).alias("wide")))
    named = (here.join(salted(wide), ["host", "tmpl", "form", "salt"], "left")
             .withColumn("name", F.when(F.col("wide"), F.col("form")).otherwise(F.col("seg"))).drop("wide"))
    count = [F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).alias(k) for k in KINDS]
    children = shared_table(named.groupBy("host", "tmpl", "name").agg(*count, F.count(F.lit(1)).alias("n")), "children")
    parents = children.groupBy("host", "tmpl").agg(*[F.sum(k).alias("all_" + k) for k in KINDS], F.sum("n").alias("all"), F.count(F.lit(1)).alias("branches"))
    d = lambda c: F.col(c).cast("double")
    square = F.lit(0.0)
    for k in KINDS:
        off = d(k) * d("all") - d("n") * d("all_" + k)
        square = square + F.when(F.col("all_" + k) > 0, off * off / (d("n") * d("all_" + k) * (d("all") - d("n")))).otherwise(0.0)
    own = (F.col("branches") == 1) | ((F.col("n") >= MIN_BRANCH) & (F.col("n") < F.col("all")) & (square > DIFFERENT))
    spread = children.withColumn("salt", F.expr(f"pmod(xxhash64(name), {SALTS})").cast("int"))
    judged = shared_table(spread.join(salted(parents), ["host", "tmpl", "salt"])
                          .withColumn("step", F.when(own, F.col("name")).otherwise("*")).drop("salt"), "judged")
    steps = judged.select("host", "tmpl", "name", "step")
    longer = F.concat("tmpl", F.lit("/"), "step")
    moved = named.join(salted(steps.where("step <> '*' OR name = '*'")), ["host", "tmpl", "name", "salt"], "left").withColumn(
        "tmpl", F.concat("tmpl", F.lit("/"), F.coalesce("step", F.lit("*"))))
    done = rows.where(F.size(F.split("path", "/")) <= level)
    nodes = (judged.withColumn("parent", F.col("tmpl")).withColumn("tmpl", longer).groupBy("host", "parent", "tmpl")
             .agg(F.sum(F.expr("bad_end + bad_on")).alias("bad"), F.sum(F.expr("good_end + good_on")).alias("good")))
    return shared_table(moved.select(*rows.columns).unionByName(done), "urls"), nodes


def purity(parent):
    return (F.col("bad").cast("double") + F.lit(STRENGTH) * parent) / (F.col("bad").cast("double") + F.col("good").cast("double") + F.lit(STRENGTH))


def templates(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(urls with their template, tree: host, tmpl, bad, good, purity)."""
    rows = shared_table(rows.withColumn("tmpl", F.lit("")), "urls")
    sums = [F.sum(F.when(F.col("label") == k, 1).otherwise(0)).alias(k) for k in ("bad", "good")]
    level = rows.groupBy("host").agg(*sums).select("host", F.lit("").alias("tmpl"), "bad", "good").withColumn("purity", purity(F.lit(PRIOR)))
    level = shared_table(level, "nodes")
    tree = level
    depth = rows.agg(F.max(F.size(F.split("path", "/")))).first()[0] or 0
    for at in range(1, min(LEVELS, depth - 1) + 1):
        rows, nodes = branch(rows, at)
        above = level.select("host", F.col("tmpl").alias("parent"), F.col("purity").alias("above"))
        # a node may have many children: spread them like the branches
        spread = nodes.withColumn("salt", F.expr(f"pmod(xxhash64(tmpl), {SALTS})").cast("int"))
        level = shared_table(spread.join(salted(above), ["host", "parent", "salt"])
                             .select("host", "tmpl", "bad", "good", purity(F.col("above")).alias("purity")), "nodes")
        tree = tree.unionByName(level)
    return rows, tree


def judge(pages: DataFrame, rules: list[Rule], labels: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, template, labelled, purity, verdict of every row. ``labels``:
    page_id, bad (boolean), one row a page; without it the rules label the urls they decide."""
    spark = pages.sparkSession
    prepare(spark)
    url = split_url(pages.select(F.col("page_id"), F.col("url"))).drop("url").withColumn("_rule", rule_of(rules))
    url = url.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.col("_rule.verdict").alias("said"))
    if labels is None:
        url = url.withColumn("label", F.when(F.col("said") == "block", "bad").when(F.col("said") == "allow", "good"))
    else:
        known = labels.select("page_id", F.when(F.col("bad"), "bad").otherwise("good").alias("label"))
        url = url.join(known, "page_id", "left")
    url = url.withColumn("salt", F.expr(f"pmod(xxhash64(page_id, path), {SALTS})").cast("int"))
    rows, tree = templates(url)
    found = salted(tree.select("host", "tmpl", (F.col("bad") + F.col("good")).alias("labelled"), "purity"))
    out = rows.join(found, ["host", "tmpl", "salt"], "left")
    reject = (F.col("labelled") >= MIN_LABELLED) & (F.col("purity") >= REJECT)
    return out.select("page_id", "host", "path", "rule", F.col("tmpl").alias("template"), "labelled", "purity",
                      F.coalesce("said", F.when(reject, "block").otherwise("allow")).alias("verdict"))


def twin_sql(rules: list[Rule]) -> str:
    """The same in DuckDB's SQL over ``pages``."""
    case = lambda what: "CASE " + " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p if what == 'rule' else v}'"
        for v, h, p in ordered(rules)) + " END"
    out = [f"""
WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM a),
c AS (SELECT page_id, translate(h, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM b),
r0 AS (SELECT *, {case('rule')} AS rule, {case('said')} AS said, '' AS tmpl, string_split(path, '/') AS parts FROM c),
t0 AS (SELECT host, '' AS tmpl, sum(CASE WHEN said = 'block' THEN 1 ELSE 0 END) AS bad, sum(CASE WHEN said = 'allow' THEN 1 ELSE 0 END) AS good
       FROM r0 GROUP BY host),
n0 AS (SELECT *, (CAST(bad AS DOUBLE) + {STRENGTH} * {PRIOR}) / (CAST(bad AS DOUBLE) + CAST(good AS DOUBLE) + {STRENGTH}) AS purity FROM t0)"""]
    kinds = {f"{k}_{e}": (f"said IS NULL" if k == "none" else f"said = '{'block' if k == 'bad' else 'allow'}'", e) for k in ("bad", "good", "none") for e in ("end", "on")}
    d = lambda c: f"CAST({c} AS DOUBLE)"
    for i in range(1, LEVELS + 1):
        p = i - 1
        seg = f"parts[{i + 1}]" if i < LEVELS else f"array_to_string(parts[{i + 1}:], '/')"
        ends = f"(len(parts) = {i + 1})" if i < LEVELS else "true"
        sums = ", ".join(f"sum(CASE WHEN {c} AND {'ends' if e == 'end' else 'NOT ends'} THEN 1 ELSE 0 END) AS {k}" for k, (c, e) in kinds.items())
        off = lambda k: f"({d('c.' + k)} * {d('p.total')} - {d('c.n')} * {d('p.' + k)})"
        chi = " + ".join(["0.0", *(f"(CASE WHEN p.{k} > 0 THEN {off(k)} * {off(k)} / ({d('c.n')} * {d('p.' + k)} * ({d('p.total')} - {d('c.n')})) ELSE 0.0 END)" for k in KINDS)])
        out.append(f"""
s{i} AS (SELECT *, {seg} AS seg, regexp_replace({seg}, '[0-9]+', '<n>', 'g') AS form, {ends} AS ends FROM r{p} WHERE len(parts) > {i}),
w{i} AS (SELECT host, tmpl, form FROM s{i} WHERE form <> seg GROUP BY ALL HAVING count(DISTINCT seg) > {VARIABLE}),
m{i} AS (SELECT s.*, CASE WHEN w.form IS NULL THEN seg ELSE s.form END AS name FROM s{i} s LEFT JOIN w{i} w USING (host, tmpl, form)),
c{i} AS (SELECT host, tmpl, name, {sums}, count(*) AS n FROM m{i} GROUP BY host, tmpl, name),
p{i} AS (SELECT host, tmpl, {', '.join(f'sum({k}) AS {k}' for k in KINDS)}, sum(n) AS total, count(*) AS branches FROM c{i} GROUP BY host, tmpl),
j{i} AS (SELECT c.*, CASE WHEN p.branches = 1 OR (c.n >= {MIN_BRANCH} AND c.n < p.total AND {chi} > {DIFFERENT}) THEN name ELSE '*' END AS step
         FROM c{i} c JOIN p{i} p USING (host, tmpl)),
g{i} AS (SELECT host, tmpl AS parent, tmpl || '/' || step AS tmpl, sum(bad_end + bad_on) AS bad, sum(good_end + good_on) AS good FROM j{i} GROUP BY ALL),
n{i} AS (SELECT g.host, g.tmpl, g.bad, g.good, (CAST(g.bad AS DOUBLE) + {STRENGTH} * u.purity) / (CAST(g.bad AS DOUBLE) + CAST(g.good AS DOUBLE) + {STRENGTH}) AS purity
         FROM g{i} g JOIN n{p} u ON u.host = g.host AND u.tmpl = g.parent),
r{i} AS (SELECT m.page_id, host, path, rule, said, tmpl || '/' || j.step AS tmpl, parts FROM m{i} m JOIN j{i} j USING (host, tmpl, name)
         UNION ALL SELECT page_id, host, path, rule, said, tmpl, parts FROM r{p} WHERE len(parts) <= {i})""")
    tree = " UNION ALL ".join(f"SELECT host, tmpl, bad, good, purity FROM n{i}" for i in range(LEVELS + 1))
    return ",".join(out) + f""",
tree AS ({tree})
SELECT r.page_id, r.host, r.path, r.rule, coalesce(r.said, CASE WHEN t.bad + t.good >= {MIN_LABELLED} AND t.purity >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict
FROM r{LEVELS} r LEFT JOIN tree t ON t.host = r.host AND t.tmpl = r.tmpl"""
