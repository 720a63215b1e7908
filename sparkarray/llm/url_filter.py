"""URL filters: a trie over reversed host labels, then path segments.

The rules are compiled into one trie.  A URL walks it by its host's labels from
the right; at every label reached, the rules of that host are tried along the
path, segment by segment (a rule may end within a segment: it is a string
prefix).  The longest match wins: most host labels first, then the longest path;
if one place both allows and blocks, it blocks.  Up to ``MOST_RULES`` rules go to
the executors as one trie, a proven bound.  More of them, or rules in a table,
stay distributed: the trie's steps are then keys (host suffix, whole path
segments) by which URLs and rules are joined, and the same rule wins.

Cases: a null URL or one without ``://`` has an empty host and path and no rule;
ports and user names stay part of the host; an empty path only fits rules with
an empty path; a rule without a host fits every host; very long URLs are read
whole; null ids and repeated rows are judged row by row; an empty table, or no
rules, gives an empty result or the default; other columns of the input,
whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scope, stored, table

MOST_RULES = 100_000
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

#: (verdict, host, path)
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    for stop in "#?":
        rest = rest.partition(stop)[0]
    slash = rest.find("/")
    return (rest.translate(_LOWER), "") if slash < 0 else (rest[:slash].translate(_LOWER), rest[slash:])


class _Node:
    """A host label or a whole path segment; ``tails``: rules that end inside the next segment, ``lens``: their lengths, falling."""

    __slots__ = ("labels", "lens", "segments", "tails")

    def __init__(self) -> None:
        self.labels: dict[str, _Node] = {}
        self.segments: dict[str, _Node] = {}
        self.tails: dict[str, tuple[str, str]] = {}
        self.lens: list[int] = []


class UrlTrie:
    """Rules as a trie; :meth:`judge` gives the rule and verdict of a host and path."""

    def __init__(self, rules: list[tuple[str, str, str]], default: str = "allow") -> None:
        self.default, self.root = default, _Node()
        for verdict, host, path in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"verdict must be allow or block, not {verdict!r}")
            node = self.root
            for label in reversed(host.translate(_LOWER).split(".")) if host else ():
                node = node.labels.setdefault(label, _Node())
            *whole, tail = path.split("/")
            for segment in whole:
                node = node.segments.setdefault(segment, _Node())
            if node.tails.get(tail, ("", ""))[1] != "block":
                node.tails[tail] = (host.translate(_LOWER) + path, verdict)
            if len(tail) not in node.lens:
                node.lens = sorted([*node.lens, len(tail)], reverse=True)

    @staticmethod
    def _along(node: _Node, segments: list[str]) -> tuple[str, str] | None:
        """The rule with the longest path among those of one host."""
        best = None
        for k, segment in enumerate(segments):
            for n in node.lens:
                if n <= len(segment) and (found := node.tails.get(segment[:n])):
                    best = found
                    break
            if k + 1 == len(segments) or segment not in node.segments:
                break
            node = node.segments[segment]
        return best

    def judge(self, host: str, path: str) -> tuple[str | None, str]:
        segments, node = path.split("/"), self.root
        best = self._along(node, segments)
        for label in reversed(host.split(".")) if host else ():
            if (node := node.labels.get(label)) is None:
                break
            best = self._along(node, segments) or best
        return best or (None, self.default)


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url", most: int = MOST_RULES) -> DataFrame:
    """One row per page: id, host, path, rule, verdict; rules as a list or as a table (verdict, host, path)."""
    if isinstance(rules, DataFrame) or len(rules) > most:
        frame = rules if isinstance(rules, DataFrame) else pages.sparkSession.createDataFrame(rules, "verdict string, host string, path string")
        return _judge_joined(pages, frame, default, id_col, url_col)
    trie = pages.sparkSession.sparkContext.broadcast((rules, default))
    kind = pages.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = UrlTrie(*trie.value)
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            # A URL without a host matches nothing, not even a rule for all hosts.
            said = [own.judge(*p) if p[0] else (None, own.default) for p in parts]
            text = lambda xs: pa.array(xs, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), text([p[0] for p in parts]), text([p[1] for p in parts]), text([s[0] for s in said]), text([s[1] for s in said])], [id_col, "host", "path", "rule", "verdict"])

    return pages.select(id_col, F.col(url_col).cast("string")).mapInArrow(run, f"{id_col} {kind.simpleString()}, host string, path string, rule string, verdict string")


def _judge_joined(pages: DataFrame, rules: DataFrame, default: str, id_col: str, url_col: str) -> DataFrame:
    """The same where rules are too many for one trie: each URL meets the rules at its own steps of the trie only."""
    low = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rules = rules.select("verdict", low(F.coalesce("host", F.lit(""))).alias("_host"), F.coalesce("path", F.lit("")).alias("_path"))
    known = F.when(F.col("verdict").isin("allow", "block"), F.col("verdict") == "block").otherwise(F.raise_error(F.lit("verdict must be allow or block")).cast("boolean"))
    rules = rules.groupBy("_host", "_path").agg(F.max(known).alias("_block"))
    parts = F.split("_path", "/")
    rules = rules.select("_host", "_block", "_path", F.size(parts).alias("_deep"), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/").alias("_whole"), F.element_at(parts, -1).alias("_tail"))
    url = F.col(url_col).cast("string")
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(F.substring(url, F.instr(url, "://") + 3, F.length(url)), "^[^?#]*", 0)).otherwise("")
    rows = pages.select(F.col(id_col).alias("_id"), F.coalesce(rest, F.lit("")).alias("_rest"), F.monotonically_increasing_id().alias("_nr"))
    rows = rows.select("_nr", "_id", low(F.regexp_extract("_rest", "^[^/]*", 0)).alias("_of"), F.regexp_extract("_rest", "^[^/]*((?s:.*))$", 1).alias("_along"))
    with Scope() as scope:
        rows = scope.keep(stored(rows, "url-parts"))
        labels, segments = F.split("_of", r"\."), F.split("_along", "/")
        n = F.size(labels)
        suffixes = F.transform(F.sequence(F.lit(0), n), lambda k: F.struct(k.alias("labels"), F.array_join(F.slice(labels, n - k + 1, k), ".").alias("host")))
        deep = rules.agg(F.max("_deep")).first()[0] or 0  # no rule is deeper
        steps = F.transform(F.sequence(F.lit(1), F.least(F.size(segments), F.lit(max(1, deep)))), lambda d: F.struct(F.array_join(F.slice(segments, F.lit(1), d - 1), "/").alias("whole"), F.element_at(segments, d).alias("next"), d.alias("deep")))
        asked = rows.filter("_of <> ''").select("_nr", F.explode(suffixes).alias("_s"), steps.alias("_steps")).select("_nr", "_s.*", F.explode("_steps").alias("_t")).select("_nr", "labels", "host", "_t.*")
        met = asked.join(rules, (F.col("host") == F.col("_host")) & (F.col("whole") == F.col("_whole")) & (F.col("deep") == F.col("_deep")) & F.col("next").startswith(F.col("_tail")))
        best = F.max(F.struct("labels", F.length("_path").alias("long"), F.concat("_host", "_path").alias("rule"), "_block")).alias("_best")
        best = scope.keep(stored(met.groupBy(F.col("_nr").alias("_for")).agg(best), "url-rules"))
    found = rows.join(best, F.col("_nr") == F.col("_for"), "left")
    verdict = F.when(F.col("_best").isNull(), F.lit(default)).when(F.col("_best._block"), "block").otherwise("allow")
    return found.select(F.col("_id").alias(id_col), F.col("_of").alias("host"), F.col("_along").alias("path"), F.col("_best.rule").alias("rule"), verdict.alias("verdict"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, the rule that decides and the verdict."""
    return judge_urls(table(spark, sf_dir, "pages"), RULES)


QUERIES = {"op8_url_filters": op8_url_filters}
ORACLE_SQL = {
    "op8_url_filters": """
        WITH cut AS (
          SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*', 0) ELSE '' END AS rest FROM pages),
        parts AS (
          SELECT page_id, translate(regexp_extract(rest, '^[^/]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/]*((?s:.*))$', 1) AS path FROM cut),
        rules(rhost, rpath, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
        best AS (
          SELECT p.page_id, max_by(rhost || rpath, length(rhost) * 1000 + length(rpath)) AS rule, max_by(verdict, length(rhost) * 1000 + length(rpath)) AS verdict
          FROM parts p JOIN rules r ON (p.host = rhost OR suffix(p.host, '.' || rhost)) AND starts_with(p.path, rpath) GROUP BY p.page_id)
        SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
        FROM parts p LEFT JOIN best b ON p.page_id = b.page_id"""
}
