"""URL filtering: explicit rules first, then a path-template tree with smoothed labelled purity.

Every host has a tree of path templates. Variable segments become wildcards: those with digits at
once (a file ending stays), and under each branching, level by level to the deepest, all segments,
where there are many different ones that each come seldom. Branches of a host that have the same shape
and don't differ significantly in their blocked share are merged (two-sided test against the
shape's share); branches without labels can't differ, so they are judged with their shape. Labelled urls are those a rule decides. The blocked share of a template is
smoothed towards the share of the same template over all hosts, and that one towards the share
of all labelled urls; templates at or above ``threshold`` are rejected.

DataFrame operations only. Urls are summed up by host and raw template before anything is
shuffled, so the tree is made from counts, and urls meet their template by one join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_hot, materialize, workdir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the url's path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @classmethod
    def of(cls, verdict: str, text: str) -> Rule:
        host, slash, path = text.partition("/")
        return cls(verdict, host, slash + path)


#: Branchings that the DuckDB form unrolls; ``judge`` goes on to the deepest of the data.
LEVELS = 3
#: A branching with more different segments than this, each seen fewer times than that on average.
MANY, SELDOM = 16, 4
#: Weight of what a share is smoothed towards, in urls.
ALPHA = 5.0


def host_and_path(url: str = "url") -> tuple[str, str]:
    """SQL for a url's host and path: '' both, if it is null or has no '://'."""
    rest = f"substr(`{url}`, instr(`{url}`, '://') + 3)"
    there = f"coalesce(instr(`{url}`, '://'), 0) > 0"
    host = f"if({there}, translate(regexp_extract({rest}, '^[^/?#]*', 0), '{UPPER}', '{LOWER}'), '')"
    return host, f"if({there}, regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1), '')"


def rule_sql(rules: list[Rule]) -> str:
    """SQL for the longest rule that fits columns host and path, as struct (rule, verdict), or null; ties go to the first listed."""
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    whens = [
        f"when (host = {quote(r.host)} or endswith(host, {quote('.' + r.host)})) and startswith(path, {quote(r.path)}) then named_struct('rule', {quote(r.host + r.path)}, 'verdict', {quote(r.verdict)})"
        for r in sorted(rules, key=lambda r: -len(r.host + r.path))
    ]
    return f"case {' '.join(whens)} end" if whens else "cast(null as struct<rule:string,verdict:string>)"


def _depth(tree: DataFrame) -> int:
    """Levels at which some host has templates enough for a wide branching: none can be below."""
    sizes = tree.groupBy("host", F.size("template").alias("size")).agg(F.count("*").alias("templates"))
    deeper = Window.partitionBy("host").orderBy(F.desc("size"))
    return sizes.withColumn("reach", F.sum("templates").over(deeper)).filter(F.col("reach") > MANY).agg(F.max("size")).first()[0] or 0


def judge(pages: DataFrame, rules: list[Rule], threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity for every row of ``pages``.

    Null urls and urls without '://' have an empty host and path and are judged like others, as
    the template '/' of the host ''. Rows that repeat, and null ids, are each judged; other
    columns are not read; an empty table gives no rows. Without any labelled url, purity is 0 and
    the method allows.
    """
    host, path = host_and_path(url_col)
    urls = pages.select(pages[id_col].alias("page_id"), F.expr(host).alias("host"), F.expr(path).alias("path"))
    urls = urls.withColumn("hit", F.expr(rule_sql(rules)))
    urls = urls.withColumn("raw", F.expr("transform(filter(split(path, '/'), s -> s <> ''), s -> if(s rlike '[0-9]', concat('*', regexp_extract(s, '[.][A-Za-z]+$', 0)), s))"))
    blocked = F.sum(F.when(F.col("hit.verdict") == "block", 1).otherwise(0))
    raw = urls.groupBy("host", "raw").agg(F.count("*").alias("n"), F.count("hit").alias("labelled"), blocked.alias("blocked"))
    # counts by host and template are written, as many plans below start from them
    folder = workdir(pages.sparkSession)
    tree = counts = materialize(raw.withColumn("template", F.col("raw")), f"{folder}/raw")
    for level in range(_depth(tree)):
        prefix = F.slice("template", 1, level)
        here = F.try_element_at("template", F.lit(level + 1))
        split = tree.filter(here.isNotNull() & ~F.startswith(here, F.lit("*"))).groupBy("host", prefix.alias("prefix")).agg(F.countDistinct(here).alias("kinds"), F.sum("n").alias("seen"))
        wide = split.filter((F.col("kinds") > MANY) & (F.col("seen") < SELDOM * F.col("kinds"))).select(F.col("host").alias("h"), "prefix", F.lit(True).alias("wide"))
        joined = tree.join(wide, (tree["host"] == F.col("h")) & (prefix == F.col("prefix")), "left")
        general = F.expr(f"transform(template, (s, i) -> if(i = {level} and not startswith(s, '*'), '*', s))")
        tree = materialize(joined.withColumn("template", F.when(F.col("wide"), general).otherwise(F.col("template"))).drop("h", "prefix", "wide"), f"{folder}/level-{level}")
    text = lambda a: F.concat(F.lit("/"), F.array_join(a, "/"))
    shape = F.transform("template", lambda s: F.when(F.startswith(s, F.lit("*")), s).otherwise("*"))
    tree = tree.select("host", "raw", "labelled", "blocked", text("template").alias("own"), text(shape).alias("shape"))
    sums = [F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")]
    branch = materialize(tree.groupBy("host", "own", "shape").agg(*sums), f"{folder}/branch")
    shapes = branch.groupBy("host", "shape").agg(F.sum("labelled").alias("all_labelled"), F.sum("blocked").alias("all_blocked"), F.count("*").alias("branches"))
    share = F.try_divide("all_blocked", "all_labelled")
    # far apart: the branch's share lies over 1.96 standard errors from the shape's
    off = F.col("blocked") - F.col("labelled") * share
    alike = (F.col("labelled") == 0) | (F.col("all_labelled") == 0) | (off * off <= 1.96 * 1.96 * F.col("labelled") * share * (1 - share))
    merged = branch.join(shapes, ["host", "shape"]).withColumn("template", F.when((F.col("branches") > 1) & alike, F.col("shape")).otherwise(F.col("own")))
    nodes = merged.groupBy("host", "template").agg(*sums)
    total = nodes.agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l")).select(F.coalesce(F.try_divide("b", "l"), F.lit(0.0)).alias("prior"))
    across = branch.groupBy(F.col("own").alias("t")).agg(F.sum("labelled").alias("cl"), F.sum("blocked").alias("cb"))
    # one row holds the share of all labelled urls
    across = across.join(F.broadcast(total)).select("t", ((F.col("cb") + ALPHA * F.col("prior")) / (F.col("cl") + ALPHA)).alias("wide_share"))
    judged = merged.select("host", "own", "template").join(nodes, ["host", "template"]).join(across, F.col("own") == F.col("t"))
    judged = judged.select("host", "own", "template", ((F.col("blocked") + ALPHA * F.col("wide_share")) / (F.col("labelled") + ALPHA)).alias("purity"))
    by_raw = tree.select("host", "raw", "own").join(judged, ["host", "own"]).select("host", "raw", "template", "purity")
    # a host, or urls without one, may be a third of all rows
    out = join_hot(urls, by_raw, ["host", "raw"], "page_id", counts=counts)
    method = F.when(F.col("purity") >= threshold, "block").otherwise("allow")
    return out.select(F.col("page_id").alias(id_col), "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", method).alias("verdict"), "template", F.round("purity", 6).alias("purity"))


def duckdb_sql(rules: list[Rule], threshold: float = 0.5) -> str:
    """The same for DuckDB over the view ``pages``."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    ordered = sorted(rules, key=lambda r: -len(r.host + r.path))
    fits = lambda r: f"(host = {quote(r.host)} or ends_with(host, {quote('.' + r.host)})) and starts_with(path, {quote(r.path)})"
    rule = "case " + " ".join(f"when {fits(r)} then {quote(r.host + r.path)}" for r in ordered) + " end"
    verdict = "case " + " ".join(f"when {fits(r)} then {quote(r.verdict)}" for r in ordered) + " end"
    levels, name = [], "t0"
    for level in range(LEVELS):
        here, prefix = f"template[{level + 1}]", f"template[1:{level}]" if level else "cast([] as varchar[])"
        levels.append(
            f"w{level} as (select host, {prefix} prefix from {name} where len(template) > {level} and not starts_with({here}, '*') "
            f"group by 1, 2 having count(distinct {here}) > {MANY} and sum(n) < {SELDOM} * count(distinct {here})), "
            f"t{level + 1} as (select t.host, raw, n, labelled, blocked, case when w.host is not null then list_transform(template, lambda s, i: case when i = {level + 1} and not starts_with(s, '*') then '*' else s end) else template end template "
            f"from {name} t left join w{level} w on t.host = w.host and {prefix} = w.prefix)"
        )
        name = f"t{level + 1}"
    return f"""
with cut as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end rest from pages),
hp as (select page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}'), '') host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') path from cut),
urls as (select page_id, host, path, {rule} rule, {verdict} verdict,
  list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: case when regexp_matches(s, '[0-9]') then '*' || regexp_extract(s, '[.][A-Za-z]+$', 0) else s end) raw from hp),
t0 as (select host, raw, raw template, count(*) n, count(rule) labelled, count(*) filter (verdict = 'block') blocked from urls group by host, raw),
{', '.join(levels)},
tree as (select host, raw, labelled, blocked, '/' || array_to_string(template, '/') own, '/' || array_to_string(list_transform(template, lambda s: case when starts_with(s, '*') then s else '*' end), '/') shape from {name}),
branch as (select host, own, shape, sum(labelled) labelled, sum(blocked) blocked from tree group by all),
shapes as (select host, shape, sum(labelled) al, sum(blocked) ab, count(*) branches from branch group by all),
merged as (select host, own, labelled, blocked, case when branches > 1 and (labelled = 0 or
    (blocked - labelled * (ab / al)) * (blocked - labelled * (ab / al)) <= 1.96::double * 1.96::double * labelled * (ab / al) * (1 - ab / al)) then shape else own end template
  from branch join shapes using (host, shape)),
nodes as (select host, template, sum(labelled) labelled, sum(blocked) blocked from merged group by all),
total as (select case when sum(labelled) > 0 then sum(blocked) / sum(labelled) else 0 end prior from nodes),
across as (select own, (sum(blocked) + {ALPHA}::double * max(prior)) / (sum(labelled) + {ALPHA}::double) wide_share from branch, total group by own),
judged as (select host, own, template, (nodes.blocked + {ALPHA}::double * wide_share) / (nodes.labelled + {ALPHA}::double) purity from merged join nodes using (host, template) join across using (own))
select page_id, urls.host host, path, rule, coalesce(verdict, case when purity >= {threshold} then 'block' else 'allow' end) verdict, template, round(purity, 6) purity
from urls join tree on urls.host = tree.host and urls.raw = tree.raw join judged on judged.host = tree.host and judged.own = tree.own
"""
