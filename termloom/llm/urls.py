"""URL filters: rules on hosts and paths, and gradient-boosted trees on lexical features for every other URL.

Rules are applied with column expressions: a rule fits its host and all subdomains, if the URL's path starts with the
rule's; the longest rule wins. The trees learn from a bounded sample of the URLs that rules have labelled, on length, depth, digit
ratio, entropy, parameter counts and statistics of the suffixes of hosts, alone and with the first directory, and judge the URLs without a rule.

A null URL, or one without `://`, has an empty host and path; no rule fits it, and the trees judge it as an empty text.
Without labelled URLs of both kinds the trees give the share of blocked ones (allow, if there are none). Rows are judged alone,
so repeated rows stay. Rules that tie in length can't both fit unless they are equal. Very long URLs are read whole. An empty
table gives an empty result; columns other than the id and the URL are not read, and may have any name.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_sample

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_ROWS, TREES, DEPTH, BINS = 20_000, 30, 3, 32
#: Suffixes with fewer labelled URLs have no statistics of their own.
LEAST = 5
FEATURES = (
    "length", "host length", "path length", "depth", "digit ratio", "entropy", "parameters", "longest part", "labels", "hyphens", "fragment",
    "last label's share", "last two labels' share", "share of those with the first directory", "extension's share",
)


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.coalesce(F.when(at > 0, F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)), F.lit(""))


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.coalesce(F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)), F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest of the rules (host and path, like `net/`) that fits; else null. Meant for short lists of rules."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=len):
        h, _, p = rule.partition("/")
        out = F.when(((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(f"/{p}")), F.lit(rule)).otherwise(out)
    return out


def verdict_of(rule: Column, rules: dict[str, str]) -> Column:
    """A rule's verdict; null without a rule."""
    return reduce(lambda out, r: F.when(rule == r, rules[r]).otherwise(out), rules, F.lit(None).cast("string"))


def suffixes(host: str, path: str) -> tuple[str, str, str, str]:
    """The host's last label, its last two, these with the path's first directory, and the file's extension."""
    parts = host.split(".")
    name = path.rsplit("/", 1)[-1]
    two = ".".join(parts[-2:])
    return parts[-1], two, f"{two}/{path[1:].partition('/')[0]}" if path.count("/") > 1 else two, name.rsplit(".", 1)[-1] if "." in name else ""


def lexical(url: str, host: str, path: str, shares: list[dict[str, float]], prior: float) -> list[float]:
    n = max(len(url), 1)
    count = Counter(url)
    query = url.partition("?")[2].partition("#")[0]
    parts = [p for p in path.split("/") if p]
    return [
        len(url), len(host), len(path), len(parts), sum(map(str.isdigit, url)) / n, -sum(c / n * math.log2(c / n) for c in count.values()),
        sum(1 for p in query.split("&") if p), max(map(len, parts), default=0), host.count(".") + 1, url.count("-"), float("#" in url),
        *(s.get(k, prior) for s, k in zip(shares, suffixes(host, path), strict=True)),
    ]


@dataclass
class Model:
    prior: float = 0.0
    start: float = -20.0
    shares: list[dict[str, float]] = field(default_factory=lambda: [{}, {}, {}, {}])
    #: Each tree: features and limits of its inner nodes, values of its leaves, as a full binary tree.
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.start)
        for feature, limit, leaf in self.trees:
            z += leaf[descend(x, feature, limit)]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def descend(x: np.ndarray, feature: np.ndarray, limit: np.ndarray) -> np.ndarray:
    at = np.zeros(len(x), np.int64)
    for _ in range(DEPTH):
        at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > limit[at])
    return at - (2**DEPTH - 1)


def boost(x: np.ndarray, y: np.ndarray, *, rate: float = 0.3, l2: float = 1.0) -> tuple[float, list]:
    """Second-order gradient boosting of logistic loss on quantile bins; ties go to the first feature and bin."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(p / (1 - p)))
    z, trees = np.full(len(y), start), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p)
        inner = 2**DEPTH - 1
        feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(y), np.int64)
        for node in range(inner):
            k = np.flatnonzero(at == node)
            best = 1e-6
            gs, hs = g[k].sum(), h[k].sum()
            for j, e in enumerate(edges):
                if len(k) == 0 or len(e) == 0:
                    continue
                gl = np.bincount(binned[k, j], g[k], len(e) + 1).cumsum()[:-1]
                hl = np.bincount(binned[k, j], h[k], len(e) + 1).cumsum()[:-1]
                gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                if gain.max() > best:
                    best, feature[node], limit[node] = gain.max(), j, e[gain.argmax()]
            at[k] = 2 * node + 1 + (x[k, feature[node]] > limit[node])
        at -= inner
        leaf = -rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + l2)
        z += leaf[at]
        trees.append((feature, limit, leaf))
    return start, trees


def train(rows: DataFrame, *, max_rows: int = MAX_ROWS) -> Model:
    """rows: url, host, path and verdict (allow, block; null is not learned from). Learns from about max_rows of them, twice as
    many at most where URLs repeat: those of the smallest hashes."""
    labelled = rows.where(F.col("verdict").isNotNull() & F.col("url").isNotNull())
    some = hash_sample(labelled.select("url", "host", "path", "verdict"), "url", max_rows)
    got = some.orderBy(F.xxhash64("url"), "url", "verdict").limit(2 * max_rows).collect()
    got.sort(key=lambda r: (zlib.crc32(r.url.encode("utf-8", "surrogatepass")), r.url))
    if not got:
        return Model()
    y = np.array([r.verdict == "block" for r in got], float)
    prior = float(y.mean())
    # a URL's own label stays out of the statistics that it is learned with: they come from the other half
    half = [suffix_shares(got[1::2], prior), suffix_shares(got[0::2], prior)]
    x = np.array([lexical(r.url, r.host, r.path, half[k % 2], prior) for k, r in enumerate(got)])
    if len(set(y)) < 2:
        return Model(prior, 20.0 if prior else -20.0)
    start, trees = boost(x, y)
    return Model(prior, start, suffix_shares(got, prior), trees)


def suffix_shares(rows: list, prior: float) -> list[dict[str, float]]:
    """For each kind of suffix, the smoothed share of blocked URLs."""
    out = []
    for kind in range(4):
        n, bad = Counter(), Counter()
        for r in rows:
            k = suffixes(r.host, r.path)[kind]
            n[k] += 1
            bad[k] += r.verdict == "block"
        out.append({k: (bad[k] + prior) / (c + 1) for k, c in n.items() if c >= LEAST})
    return out


def blocked(docs: DataFrame, model: Model, url: Column, host: Column, path: Column) -> Column:
    """A column with the probability that a URL is to be blocked; NaN, and no work, for a null host."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(urls: pd.Series, hosts: pd.Series, paths: pd.Series) -> pd.Series:
        m = held.value
        x = np.array([lexical(u or "", h, p, m.shares, m.prior) for u, h, p in zip(urls, hosts, paths, strict=True) if h is not None]).reshape(-1, len(FEATURES))
        out = np.full(len(hosts), np.nan)
        out[hosts.notna().to_numpy()] = m.probability(x)
        return pd.Series(out)

    return of(url, host, path)


def judged(pages: DataFrame, rules: dict[str, str], *, id_col: str = "page_id", url_col: str = "url", model: Model | None = None) -> DataFrame:
    """Per row: the id, host, path, rule, verdict and blocked, the trees' probability (null where a rule decides)."""
    u = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col), u.alias("url"), host_of(u).alias("host"), path_of(u).alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn("verdict", verdict_of(F.col("rule"), rules))
    model = model or train(rows)
    # the trees judge what no rule decides
    free = [F.when(F.col("rule").isNull(), F.col(c)) for c in ("url", "host", "path")]
    rows = rows.withColumn("blocked", blocked(pages, model, *free))
    by_model = F.when(F.col("blocked") >= 0.5, "block").otherwise("allow")
    return rows.select(id_col, "host", "path", "rule", F.coalesce("verdict", by_model).alias("verdict"), F.when(F.col("rule").isNull(), F.col("blocked")).alias("blocked"))
