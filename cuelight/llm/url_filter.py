"""URL filters: rules first, then trust and distrust spread over the link graph of hosts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .tables import Scratch, stored


@dataclass(frozen=True)
class Rule:
    """``verdict`` (allow or block) for the urls of a host and its subdomains whose path starts with a prefix; ``text``
    is the host and the prefix in one, such as ``example.org/es/``."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def prefix(self) -> str:
        return self.text[len(self.host):]


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3)))


def host_of(rest: Column) -> Column:
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)


def parse(url: Column) -> tuple[Column, Column]:
    """Host and path: between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased, and from there to
    ``?``, ``#`` or the end. Both are empty for a null url or one without ``://``."""
    rest = F.coalesce(after_scheme(url), F.lit(""))
    return host_of(rest), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits (the first of equally long ones), or nulls. The rules are a short
    list; they are tried in the row, without a join."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(sorted(rules, key=lambda r: -len(r.text))):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.prefix)
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """Links ``(src, dst, n)`` between different hosts, from the ``href`` values of ``pages(host, html)`` that name a
    host (absolute, or from ``//`` on); others stay on their own host."""
    href = r"""(?i)\bhref\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""
    link = F.explode(F.regexp_extract_all("html", F.lit(href), F.lit(1)))
    ends = pages.select(F.col("host").alias("src"), link.alias("link")).select(
        "src", host_of(F.regexp_extract("link", r"^[^/]*//([^\s]*)", 1)).alias("dst"))
    return ends.filter("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(links: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 1000,
              settled: float = 1e-6, cut_every: int = 5, margin: float = 0.0) -> DataFrame:
    """Rows ``(host, trust, distrust)``: personalised PageRank of ``links(src, dst, n)``.

    Trust restarts at the trusted seeds and follows links; distrust restarts at the blocked seeds and follows links
    backwards. ``seeds(host, kind, weight)`` has kinds ``trust`` and ``distrust`` with weights that add up to 1 each. A
    host shares its score among its links by their number; a host without links gives its share back to the seeds. Both
    scores move in one pass per round, over a graph that is stored once. After every
    ``cut_every`` steps the scores are stored, which cuts lineage.

    That ends once no further host is reached, every score moves by less than ``settled`` of itself in such a block, and no host can get to the
    other side of ``margin`` any more: all that still moves is less than ``damping ** cut_every`` of the last block's moves, and as
    much of that, and so on. Hosts that stand on the margin itself end it at a millionth of ``settled``. If ``rounds``
    blocks are not enough, it is an error.
    """
    both = links.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "n").unionByName(
        links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "n"))
    out = both.groupBy("kind", "host").agg(F.sum("n").alias("out"))
    graph = stored(both.join(out, ["kind", "host"]).select("kind", "host", "to", (F.col("n") / F.col("out")).alias("share")), "graph")
    start = stored(seeds.select("kind", "host", F.col("weight").alias("score")), "scores")
    score, scratch = start, Scratch(links.sparkSession, "scores")
    linked, left = not graph.isEmpty(), damping ** cut_every / (1 - damping ** cut_every)
    for n in range(rounds if linked else 0):
        following = score
        for _ in range(cut_every):
            following = _round(following, graph, start, damping)
        following = scratch.stored(following, f"scores{n}")
        now, before = F.coalesce("now", F.lit(0.0)), F.coalesce("score", F.lit(0.0))
        moves = following.withColumnRenamed("score", "now").join(score, ["kind", "host"], "full").groupBy("host").agg(
            F.sum(F.abs(now - before)).alias("moved"), F.max(F.abs(now - before) / F.greatest(now, before)).alias("share"),
            F.sum(F.when(F.col("kind") == "distrust", now).otherwise(-now)).alias("gap"), F.count_if(F.col("score").isNull()).alias("reached"))
        moved, share, reached = moves.agg(F.sum("moved"), F.max("share"), F.sum("reached")).first()
        near = (moved or 0) > 0 and not moves.filter(F.abs(F.col("gap") - margin) <= moved * left).isEmpty()
        if n:
            scratch.discard(f"scores{n - 1}")
        score = following
        if share is None or not reached and (share < settled * 1e-6 or share < settled and not near):
            break
    else:
        if linked:
            raise RuntimeError(f"scores did not settle in {rounds * cut_every} steps")

    def total(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0)).alias(kind)

    return score.groupBy("host").agg(total("trust"), total("distrust"))


def _round(score: DataFrame, graph: DataFrame, start: DataFrame, damping: float) -> DataFrame:
    moved = (score.join(graph, ["kind", "host"]).groupBy("kind", F.col("to").alias("host"))
             .agg((damping * F.sum(F.col("score") * F.col("share"))).alias("score")))
    flown = moved.groupBy("kind").agg(F.sum("score").alias("flown"))
    back = start.join(flown, "kind", "left").select(
        "kind", "host", (F.col("score") * (1 - F.coalesce("flown", F.lit(0.0)))).alias("score"))
    return moved.unionByName(back).groupBy("kind", "host").agg(F.sum("score").alias("score"))


def judge(pages: DataFrame, rules: Sequence[Rule], margin: float = 0.0, damping: float = 0.85, rounds: int = 1000,
          id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Rows ``(page_id, host, path, rule, verdict, trust, distrust)``, one per row of ``pages``.

    A url that a rule fits has the rule's verdict. Hosts of pages that a rule allows are trusted seeds, those of pages
    that a rule blocks are blocked ones, each weighted by its pages. Any other page is blocked if its host's distrust
    exceeds its trust by more than ``margin``; hosts that neither score reaches are allowed, as are pages without a
    host (null urls, urls without ``://``). ``rounds`` bounds the blocks of five steps of the propagation; more is an error.

    Only the host table is joined back, on the host; a host with very many pages is split by the join. Repeated and
    null ids stay; null html has no links; other columns are not read; an empty table gives an empty one.
    """
    host, path = parse(F.col(url_column))
    parsed = pages.select(F.col(id_column).alias("page_id"), host.alias("host"), path.alias("path"),
                          F.col(html_column).alias("html"))
    text, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    judged = parsed.select("page_id", "host", "path", text.alias("rule"), verdict.alias("ruled"))
    ruled = judged.filter("ruled is not null and host <> ''").groupBy(
        F.when(F.col("ruled") == "allow", "trust").otherwise("distrust").alias("kind"), "host").agg(F.count(F.lit(1)).alias("n"))
    totals = ruled.groupBy("kind").agg(F.sum("n").alias("all"))
    seeds = ruled.join(totals, "kind").select("kind", "host", (F.col("n") / F.col("all")).alias("weight"))
    scores = propagate(host_links(parsed), seeds, damping, rounds, margin=margin)
    none = F.lit(0.0)
    return judged.join(scores, "host", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", F.when(F.coalesce("distrust", none) - F.coalesce("trust", none) > margin, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", none).alias("trust"), F.coalesce("distrust", none).alias("distrust"))
