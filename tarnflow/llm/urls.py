"""URL filters: rules by host and path; hosts without a fitting rule by personalised PageRank of trust and reversed distrust over host edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tarnflow.llm.common import drop_stored, lookup, salt, stored

DAMPING = 0.85
#: Rounds are written TOGETHER by so many, and end when a round would change both scores together by PRECISION of FLOOR's even share at most:
#: what is unsettled then is under 1 / (1 - DAMPING) times that.
PRECISION, TOGETHER = 1e-3, 6
#: A host is blocked whose distrust is over BIAS times its trust and over FLOOR times an even share of all distrust.
BIAS, FLOOR = 2.0, 0.5
#: Weight of the edges between a host and its parent domain, against 1 for each link.
KIN = 0.25
# Hosts of absolute links; relative ones stay on their host and say nothing.
_LINK = r"""(?i)\bhref\s*+=\s*+["']?(?:https?:)?//([^/?#"'\s<>]++)"""


def _lowered(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parted(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL: host from the first :// to the next / ? # or the end, A-Z lower-cased; path from there to ? # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest) + F.lit(1)), r"\A[^?#]*", 0)
    return F.coalesce(_lowered(host), F.lit("")), F.coalesce(path, F.lit(""))


def ruled(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest fitting rule, or null. rules: (verdict, host, path) each; a rule fits its host and all subdomains."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, at, start in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit(start))
        out = F.when(fits, F.struct(F.lit(at + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight) between different hosts: links, and host with parent domain both ways. pages: host, html."""
    links = pages.select("host", F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), F.lit(1))).alias("to"))
    links = links.select(F.col("host").alias("src"), _lowered(F.col("to")).alias("dst"), F.lit(1.0).alias("weight"))
    hosts = pages.select("host").distinct().filter(F.size(F.split("host", r"\.")) > 2)
    parent = hosts.select("host", F.regexp_replace("host", r"\A[^.]*\.", "").alias("parent"))
    kin = parent.select(F.col("host").alias("src"), F.col("parent").alias("dst"), F.lit(KIN).alias("weight"))
    kin = kin.unionByName(parent.select(F.col("parent").alias("src"), F.col("host").alias("dst"), F.lit(KIN).alias("weight")))
    both = links.unionByName(kin).filter("src <> '' and dst <> '' and src <> dst")
    return both.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def _weights(products: Row | None, steps: int) -> list[float]:
    """Weights, 1 in all, of the changes of some rounds with which their sum has the least square. products: p_i_j, their products' sums."""
    if products is None:
        return [0.0] * (steps - 1) + [1.0]
    product = np.array([[products[f"p_{min(i, j)}_{max(i, j)}"] for j in range(steps)] for i in range(steps)], float)
    apart = np.vstack([np.eye(steps - 1), -np.ones(steps - 1)])
    free = np.linalg.lstsq(apart.T @ product @ apart, -(apart.T @ product[:, -1]), rcond=1e-10)[0]
    return [*free.tolist(), 1.0 - float(free.sum())]


def propagated(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, precision: float = PRECISION) -> DataFrame:
    """(host, trust, distrust) by personalised PageRank. seeds: host, trusted, blocked (weights, 0 or more), one row for each host.

    Trust starts at trusted seeds and goes along the edges, distrust starts at blocked ones and goes against them; each has 1 in all. Weight
    that reaches a host without a way on goes back to the seeds: the rounds leave it out, and scaling each score to a sum of 1 in the end
    gives just that. Both walk one doubled graph, so a round is one join and one sum. After TOGETHER rounds the next ones start from the mix
    of their results whose own change has the least square, if that change is no larger than the last round's: then each lot of rounds still
    brings the change down by damping ** TOGETHER at least, and mostly by far more. The end is told by the change, so it means the same with mixes.
    """
    edges = stored(edges, "edges")
    forth = edges.select(F.concat(F.lit("+"), "src").alias("node"), F.concat(F.lit("+"), "dst").alias("to"), "weight")
    back = edges.select(F.concat(F.lit("-"), "dst").alias("node"), F.concat(F.lit("-"), "src").alias("to"), "weight")
    doubled = forth.unionByName(back)
    ends = doubled.select("node").union(doubled.select("to")).distinct()
    signed = seeds.select(F.explode(F.array(F.struct(F.concat(F.lit("+"), "host").alias("node"), F.col("trusted").alias("seed")), F.struct(F.concat(F.lit("-"), "host").alias("node"), F.col("blocked").alias("seed")))).alias("s")).select("s.*")
    start = stored(ends.join(signed, "node", "full").select("node", F.coalesce("seed", F.lit(0.0)).alias("seed")), "seeds")
    sign = F.substring("node", 1, 1)

    def by_sign(values: dict[str, Column | float]) -> Column:
        return F.when(sign == "+", values["+"]).otherwise(values["-"])

    def whole(df: DataFrame, c: str) -> DataFrame:
        """df with c scaled to a sum of 1 for each sign (0 where nothing has that sign)."""
        sums = {r.sign: r.all for r in df.groupBy(sign.alias("sign")).agg(F.sum(c).alias("all")).collect()}  # two rows
        return df.withColumn(c, F.col(c) / by_sign({s: F.lit(float(sums.get(s) or 0) or 1.0) for s in "+-"}))

    near = precision * FLOOR / max(1, start.count() // 2)
    shares = lookup(doubled, "node", doubled.groupBy("node").agg(F.sum("weight").alias("_all")), "to").select("node", "to", (F.col("weight") / F.col("_all")).alias("share"), F.lit(False).alias("own"))
    # A node's row to itself carries its seed and scores through a round. Dealt as lookup() does, once.
    kept = start.select("node", F.col("node").alias("to"), F.lit(0.0).alias("share"), F.lit(True).alias("own"))
    graph = stored(shares.unionByName(kept).withColumn("_salt", salt(F.col("to"))), "graph")
    dealt = stored(graph.select("node", "_salt").distinct(), "dealt")

    changes = [F.col(f"x{k + 1}") - F.col(f"x{k}") for k in range(TOGETHER)]
    products = [F.sum(changes[i] * changes[j]).alias(f"p_{i}_{j}") for i in range(TOGETHER) for j in range(i, TOGETHER)]
    ranks = whole(start, "seed").withColumn("x0", (1 - damping) * F.col("seed"))
    old = None
    while True:
        rows = ranks
        for k in range(TOGETHER):
            have = ["seed", *[f"x{i}" for i in range(k + 1)]]
            sent = graph.join(dealt.join(rows, "node"), ["node", "_salt"]).groupBy(F.col("to").alias("node"))
            rows = sent.agg(*[F.max(F.when(F.col("own"), F.col(c))).alias(c) for c in have], F.sum(F.col("share") * F.col(f"x{k}")).alias("_got"))
            rows = rows.select("node", *have, ((1 - damping) * F.col("seed") + damping * F.col("_got")).alias(f"x{k + 1}"))
        rows = stored(rows, "ranks")
        if old is not None:
            drop_stored(old)
        old = rows
        found = {r.sign: r for r in rows.groupBy(sign.alias("sign")).agg(*products).collect()}  # two rows
        weights = {s: _weights(found.get(s), TOGETHER) for s in "+-"}
        mix = by_sign({s: sum(w * c for w, c in zip(weights[s], changes, strict=True)) for s in "+-"})
        left = {r.sign: r for r in rows.groupBy(sign.alias("sign")).agg(F.sum(F.abs(mix)).alias("mix"), F.sum(F.abs(changes[-1])).alias("last")).collect()}  # two rows
        for s, r in left.items():
            if not r.mix <= r.last:
                weights[s] = [0.0] * (TOGETHER - 1) + [1.0]
        ranks = rows.select("node", "seed", by_sign({s: sum(w * F.col(f"x{k + 1}") for k, w in enumerate(weights[s]) if w) for s in "+-"}).alias("x0"))
        # The mix takes each round's result, so its own change is smaller by damping than that of what the rounds began with.
        if damping * sum(r.mix if r.mix <= r.last else r.last for r in left.values()) <= near:
            break
    ranks = whole(ranks.select("node", F.greatest("x0", F.lit(0.0)).alias("score")), "score")
    for done in (edges, graph, dealt):
        drop_stored(done)

    def of(s: str) -> Column:
        return F.coalesce(F.max(F.when(sign == s, F.col("score"))), F.lit(0.0))

    return ranks.groupBy(F.substring(F.col("node"), 2, 1 << 30).alias("host")).agg(of("+").alias("trust"), of("-").alias("distrust"))


def judged(pages: DataFrame, rules: list[tuple[str, str, str]], bias: float = BIAS, floor: float = FLOOR) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages (page_id, url, html).

    The longest fitting rule decides. Else the host does: blocked if its distrust is over bias times its trust and over floor times an even
    share of all distrust, allowed otherwise. Trusted seeds are hosts by their pages that a rule allows, blocked seeds by those that a rule
    blocks. A null url, or one without ://, has an empty host and path, no rule and is allowed. Null html has no links. Repeated pages count
    again. An empty table gives no row. Other columns aren't looked at.
    """
    host, path = parted(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    narrow = stored(rows.select("page_id", "host", "path", ruled(F.col("host"), F.col("path"), rules).alias("r")), "pages")
    seeds = narrow.filter("host <> ''").groupBy("host").agg(F.count_if(F.col("r.verdict") == "allow").cast("double").alias("trusted"), F.count_if(F.col("r.verdict") == "block").cast("double").alias("blocked"))
    scores = stored(propagated(host_edges(rows), seeds), "hosts")
    even = 1.0 / max(1, scores.count())
    blocked = (F.col("distrust") > bias * F.col("trust")) & (F.col("distrust") > floor * even)
    verdicts = scores.select("host", F.when(blocked, "block").otherwise("allow").alias("_verdict"), F.round("trust", 9).alias("trust"), F.round("distrust", 9).alias("distrust"))
    out = lookup(narrow, "host", stored(verdicts, "verdicts"), "page_id", "left")
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", "_verdict", F.lit("allow")).alias("verdict"), "trust", "distrust")
