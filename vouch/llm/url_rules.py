"""Allow and block lists of URLs: a trie over reversed host labels and path segments."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from vouch.llm.common import read

#: The rules of the registered query (fixed values): verdict, then host and path.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
VERDICTS = ("allow", "block")
#: Most rules that one broadcast trie may hold; `judge` refuses a longer list.
MOST_RULES = 1_000_000

_HOST_PATH = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class RuleTrie:
    """Hosts by reversed label, then paths by whole segments; the last, open segment of a rule
    is kept with its node as a prefix of the segment that may follow."""

    __slots__ = ("root",)

    def __init__(self, rules: Iterator[tuple[str, str]] | tuple[tuple[str, str], ...]):
        self.root: dict = {}
        for verdict, rule in rules:
            if verdict not in VERDICTS or "/" not in rule:
                raise ValueError(f"not a rule: {verdict} {rule}")
            host, _, path = rule.partition("/")
            node = self.root
            for label in reversed(host.translate(_LOWER).split(".")):
                node = node.setdefault(("host", label), {})
            *whole, last = path.split("/")
            node = node.setdefault("paths", {})
            for segment in whole:
                node = node.setdefault(("path", segment), {})
            # of one rule given twice with both verdicts, block holds
            ends = node.setdefault("open", {})
            if ends.get(last, (None, "allow"))[1] != "block":
                ends[last] = (rule, verdict)

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest rule that fits: the longest host first, then the longest path."""
        node, best = self.root, None
        if not path.startswith("/"):
            return None
        segments = path[1:].split("/")
        for label in reversed(host.split(".")):
            node = node.get(("host", label))
            if node is None:
                break
            at = node.get("paths")
            for segment in segments:
                if at is None:
                    break
                fits = [p for p in at.get("open", ()) if segment.startswith(p)]
                if fits:
                    best_here = at["open"][max(fits, key=len)]
                    best = best_here
                at = at.get(("path", segment))
        return best


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path:
    from there up to ``?``, ``#`` or the end. Null, or no ``://``: both empty."""
    found = _HOST_PATH.search(url) if url else None
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


def judge(pages: DataFrame, url: str = "url", rules=RULES, default: str = "allow",
          keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all), then host, path, rule and verdict of every row.

    One narrow pass without a shuffle. The trie goes to the workers with the function; it is as
    large as the rule list, which is configuration (at most ``MOST_RULES`` entries, checked), not
    data. The longest rule that fits decides; where none fits, rule is null and ``default`` holds.
    A rule ``host/path`` fits its host and all subdomains if the url's path starts with ``/path``;
    so a url without any path fits no rule. Null and broken urls have empty host and path and get
    the default. Columns of the input named like an output must not be in ``keep``.
    """
    rules = tuple(rules)
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    if default not in VERDICTS:
        raise ValueError(f"default must be one of {VERDICTS}")
    trie = RuleTrie(rules)
    out = ("host", "path", "rule", "verdict")
    keep = [c for c in pages.columns if c not in out] if keep is None else keep
    df = pages.select(*[pages[c] for c in keep], pages[url].alias("_url"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema[:-1]),
                        *(f"{c} string" for c in out)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = batch.column(batch.num_columns - 1)
            hosts, paths, names, verdicts = [], [], [], []
            for u in urls.to_pylist():
                host, path = host_and_path(u)
                rule = trie.match(host, path)
                hosts.append(host)
                paths.append(path)
                names.append(rule[0] if rule else None)
                verdicts.append(rule[1] if rule else default)
            columns = [pa.array(x, pa.string()) for x in (hosts, paths, names, verdicts)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *columns], [*batch.schema.names[:-1], *out])

    return df.mapInArrow(run, schema)


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 10: page_id, host, path, rule and verdict of every page."""
    return judge(read(spark, sf_dir, "pages").select("page_id", "url"), keep=["page_id"])


OP10_SQL = r"""
WITH rules(verdict, rule) AS (VALUES ('allow', 'org/'), ('block', 'example.org/es/'),
  ('block', 'example.org/en/1'), ('allow', 'com/fr/'), ('block', 'com/de/')),
split AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
numbered AS (SELECT *, row_number() OVER () AS row FROM split),
fits AS (
  SELECT n.row, r.rule, r.verdict, row_number() OVER (
    PARTITION BY n.row ORDER BY instr(r.rule, '/') DESC, length(r.rule) DESC) AS place
  FROM numbered n JOIN rules r
    ON (n.host = split_part(r.rule, '/', 1) OR ends_with(n.host, '.' || split_part(r.rule, '/', 1)))
   AND starts_with(n.path, substr(r.rule, instr(r.rule, '/'))))
SELECT n.page_id, n.host, n.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM numbered n LEFT JOIN fits f ON f.row = n.row AND f.place = 1
"""
