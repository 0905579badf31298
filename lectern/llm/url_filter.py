"""Allow and block rules for urls in a trie over reversed host labels and path segments.

A rule names a host and a path prefix. It fits its host and all subdomains if
the url's path starts with the rule's path; the longest fitting rule wins (more
host labels first, then the longer path, then block before allow). The trie is
broadcast after a check of its size; beyond MAX_RULES the rules stay a table
that is joined on host suffixes.

A null url, or one without `://`, has an empty host and path and meets no rule.
Rows without a rule get the default verdict. Repeated rows are judged alike.
Other columns are kept unless a result column has their name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import _stages

MAX_RULES = 1_000_000
ASCII_LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})
HOST_END = re.compile("[/?#]")
PATH_END = re.compile("[?#]")


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass
class Node:
    """A host label or a path segment; `ends` holds what a rule asks of the start of the next segment."""

    labels: dict[str, Node] = field(default_factory=dict)
    segments: dict[str, Node] = field(default_factory=dict)
    ends: dict[str, Rule] = field(default_factory=dict)
    by_length: list[int] = field(default_factory=list)


def build_trie(rules: list[Rule]) -> Node:
    root = Node()
    for rule in rules:
        node = root
        for label in reversed(rule.host.translate(ASCII_LOWER).split(".")) if rule.host else ():
            node = node.labels.setdefault(label, Node())
        *whole, rest = rule.path.split("/")
        for segment in whole:
            node = node.segments.setdefault(segment, Node())
        if node.ends.get(rest) is None or rule.verdict == "block":
            node.ends[rest] = rule
    _sort_lengths(root)
    return root


def _sort_lengths(root: Node) -> None:
    stack = [root]
    while stack:
        node = stack.pop()
        node.by_length = sorted({len(e) for e in node.ends}, reverse=True)
        stack += [*node.labels.values(), *node.segments.values()]


def split_url(url: str | None) -> tuple[str, str]:
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    m = HOST_END.search(rest)
    if m is None:
        return rest.translate(ASCII_LOWER), ""
    tail = rest[m.start() :]
    end = PATH_END.search(tail)
    return rest[: m.start()].translate(ASCII_LOWER), tail[: end.start()] if end else tail


def longest_rule(root: Node, host: str, path: str) -> Rule | None:
    best = _path_rule(root, path)
    node = root
    for label in reversed(host.split(".")):
        node = node.labels.get(label)
        if node is None:
            break
        best = _path_rule(node, path) or best
    return best


def _path_rule(node: Node, path: str) -> Rule | None:
    best, at = None, 0
    while node is not None:
        if node.ends:
            slash = path.find("/", at)
            own = len(path) - at if slash < 0 else slash - at
            for n in node.by_length:
                if n <= own and (rule := node.ends.get(path[at : at + n])):
                    best = rule
                    break
        slash = path.find("/", at) if node.segments else -1
        if slash < 0:
            break
        node, at = node.segments.get(path[at:slash]), slash + 1
    return best


_RESULT = ["host", "path", "rule", "verdict"]


def judge_urls(pages: DataFrame, rules: list[Rule], url_col: str = "url", keep: list[str] | None = None, default: str = "allow", max_rules: int = MAX_RULES) -> DataFrame:
    """host, path, rule (null without one) and verdict, beside the columns in `keep`."""
    kept = [c for c in (pages.columns if keep is None else keep) if c not in _RESULT and c != "__url"]
    source = pages.select(*[F.col(f"`{c}`") for c in kept], F.col(url_col).cast("string").alias("__url"))
    if len(rules) > max_rules:
        return _joined(source, rules, default)
    trie = pages.sparkSession.sparkContext.broadcast(build_trie(rules))

    def run(batches):
        root = trie.value
        for batch in batches:
            out = []
            for url in batch.column("__url").to_pylist():
                host, path = split_url(url)
                rule = longest_rule(root, host, path) if host or path else None
                out.append((host, path, rule.name if rule else None, rule.verdict if rule else default))
            own = [pa.array([o[k] for o in out], pa.string()) for k in range(4)]
            rest = [batch.column(n) for n in batch.schema.names if n != "__url"]
            yield pa.RecordBatch.from_arrays([*rest, *own], names=[*(n for n in batch.schema.names if n != "__url"), *_RESULT])

    return _stages.arrow_map(source, run, {n: "string" for n in _RESULT}, ("__url",))


def _joined(source: DataFrame, rules: list[Rule], default: str) -> DataFrame:
    """The same verdicts by a join on host suffixes: the rules' hosts are many, paths per host few.

    Urls meet the rules once per distinct (host, path).
    """
    spark = source.sparkSession
    table = spark.createDataFrame([(r.host.translate(ASCII_LOWER), r.path, r.verdict, r.name) for r in rules], "rule_host string, rule_path string, rule_verdict string, rule string")
    seen = source.withColumn("__at", F.instr("__url", "://"))
    rest = F.when(F.col("__at") > 0, F.expr("substring(__url, __at + 3)")).otherwise("")
    lower = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    parts = seen.withColumn("__rest", rest).withColumn("host", lower(F.regexp_extract("__rest", r"(?s)^([^/?#]*)", 1))).withColumn("path", F.regexp_extract("__rest", r"(?s)^[^/?#]*([^?#]*)", 1))
    own = parts.select("host", "path").where("host <> '' or path <> ''").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hits = own.select("host", "path", F.explode(F.array_union(suffixes, F.array(F.lit("")))).alias("rule_host")).join(table, "rule_host").where(F.expr("startswith(path, rule_path)"))
    depth = F.when(F.col("rule_host") == "", 0).otherwise(F.size(F.split("rule_host", r"\.")))
    rank = F.struct(depth, F.length("rule_path"), (F.col("rule_verdict") == "block").cast("int"))
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "rule_verdict"), rank).alias("hit"))
    kept = [c for c in source.columns if c != "__url"]
    return parts.join(best, ["host", "path"], "left").select(*[F.col(f"`{c}`") for c in kept], "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.rule_verdict", F.lit(default)).alias("verdict"))


RULES = [
    Rule("com", "/en/", "block"),
    Rule("example.com", "/en/7", "allow"),
    Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"),
    Rule("org", "/es/", "block"),
]


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge_urls(pages, RULES, keep=["page_id"])


OP3_SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM p
), r(rule_host, rule_path, rule_verdict) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
         ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), m AS (
  SELECT h.page_id, h.host, h.path, r.*,
         row_number() OVER (PARTITION BY h.page_id ORDER BY length(r.rule_host) + length(r.rule_path) DESC) AS rn
  FROM h LEFT JOIN r ON (h.host = r.rule_host OR ends_with(h.host, '.' || r.rule_host)) AND starts_with(h.path, r.rule_path)
)
SELECT page_id, host, path, rule_host || rule_path AS rule, coalesce(rule_verdict, 'allow') AS verdict FROM m WHERE rn = 1
"""
