"""URL filtering by rules, and by a tree of path templates for each host.

A path's segments with digits are variable: their digit runs become wildcards at once. Level by level then, below
every node of a host's tree that leads to more than one path: where pages spread over segments as evenly as over
more than MAX_CHILDREN equal ones (by entropy), segments with less than their even share of pages become one
wildcard; branches whose purity lies more than GAP from that of all other branches never join one; and other
branches whose paths further down are distributed like those of all branches together, and whose purity is close to
theirs, merge into the wildcard branch. A template is rejected where its purity exceeds LIMIT.

Purity is the share of blocked among labelled pages, smoothed by WEIGHT pages towards PRIOR. What other hosts say of a
path counts as WEIGHT labelled pages more: the purity of its first segment over all other hosts, then of the whole path
over these, over those of its last domain label, and over those of its last two, each smoothed towards the one before.
So pages that no rule fits are judged by what is known of their like elsewhere, if their host says nothing.

All statistics come from one table of (host, path shape) counts, aggregated over all pages before any
shuffle by key, so a host with most of the pages is a few more rows of counts. Where rows meet the sums of their
keys, keys with more than 1 / HEAVY of all rows (there are fewer than HEAVY of these) have their sums broadcast and their rows
spread over all tasks; so neither the front pages of all hosts nor a host of a third of all paths end in one task.

Results in odd cases: a null url, or one without `://`, has empty host and path, and belongs to the template
of these; labels other than block and allow count as none; of rules of one length that fit, the first in the list
wins; repeated rows count and are kept; empty tables give empty results; other columns pass through, and the new ones
replace those of their names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.shared import forget, fresh, stored

MAX_CHILDREN = 16
#: Distance of two distributions (half the summed differences) in percent, and of two purities, up to which branches merge.
MERGE, GAP = 20, 0.25
PRIOR, WEIGHT, LIMIT = 0.2, 4.0, 0.5
#: Share of all rows (1 / HEAVY) beyond which a key's rows are spread.
HEAVY = 1024
#: Up to this many rows in all, any key's rows are few enough for one task.
PLAIN = 1 << 20
#: What is counted of a path: pages, blocked and allowed ones, those of which other hosts say something, and blocked ones by that.
COUNTS = ("n", "blocked", "allowed", "told", "expected")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Up to the first `://` (if there is one), then host and path.
PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule (`domain/path`) that fits a host and path, or null. rules: (verdict, rule), a short list."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(reversed(rules), key=lambda r: len(r[1])):
        domain, _, start = rule.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit(f".{domain}"))) & F.startswith(path, F.lit(f"/{start}"))
        found = F.when(fits, rule).otherwise(found)
    return found


def purity(blocked: Column, allowed: Column, towards: Column | float = PRIOR) -> Column:
    return (blocked + towards * WEIGHT) / (blocked + allowed + F.lit(WEIGHT))


def with_sums(rows: DataFrame, sums: DataFrame, by: list[str], size: str, total: int) -> DataFrame:
    """rows with the columns of sums (one row a key; null where a key has none). size: the column of sums that counts a key's rows, total: of all rows at least."""
    values = [c for c in sums.columns if c not in by]
    if total <= PLAIN:
        return rows.join(sums, by, "left").select(*rows.columns, *values)
    heavy, light = sums.where(F.col(size) * HEAVY > total), sums.where(F.col(size) * HEAVY <= total).withColumn("__apart", F.lit(0).cast("long"))
    found = rows.join(F.broadcast(heavy.withColumnsRenamed({c: f"__{c}" for c in values})), by, "left")  # fewer than HEAVY rows
    found = found.withColumn("__apart", F.when(F.col(f"__{size}").isNull(), 0).otherwise(F.xxhash64(*rows.columns)))
    found = found.join(light, [*by, "__apart"], "left")
    return found.select(*rows.columns, *(F.coalesce(f"__{c}", c).alias(c) for c in values))


def with_evidence(counts: DataFrame) -> DataFrame:
    """counts with what other hosts say of a path: told (n, or 0 where they say nothing) and expected (blocked ones of these)."""
    keys = {"first": F.regexp_extract("shape", "^(/[^/]*)?", 0), "label": F.substring_index("host", ".", -1), "domain": F.substring_index("host", ".", -2)}
    counts = counts.withColumns(keys)

    total = counts.count()

    def sums(by: list[str], b: str, a: str) -> DataFrame:
        return counts.groupBy(*by).agg(F.sum("blocked").alias(b), F.sum("allowed").alias(a), F.count("*").alias("size"))

    out = with_sums(counts.withColumn("prior", F.lit(PRIOR)), sums(["host", "first"], "ob", "oa"), ["host", "first"], "size", total).drop("size")
    for by in (["first"], ["shape"], ["label", "shape"], ["domain", "shape"]):
        ob, oa = (F.col(c) for c in (("ob", "oa") if by == ["first"] else ("blocked", "allowed")))  # the host's own
        out = with_sums(out, sums(by, "b", "a"), by, "size", total).drop("size")
        if by == ["first"]:
            out = out.withColumn("told", F.when(F.col("b") - ob + F.col("a") - oa > 0, F.col("n")).otherwise(0))
        out = out.withColumn("prior", purity(F.col("b") - ob, F.col("a") - oa, F.col("prior"))).drop("a", "b")
    return out.withColumn("expected", F.col("told") * F.col("prior")).drop(*keys, "ob", "oa", "prior")


def with_told(blocked: Column, allowed: Column, expected: Column, told: Column, n: Column) -> tuple[Column, Column]:
    """Blocked and allowed pages of a branch of n, and WEIGHT more as other hosts say (as far as they say anything)."""
    share = WEIGHT / F.nullif(n, F.lit(0.0))
    return blocked + F.coalesce(expected * share, F.lit(0.0)), allowed + F.coalesce((told - expected) * share, F.lit(0.0))


def templates(counts: DataFrame) -> DataFrame:
    """host, shape, n, template and the template's purity, from counts (host, shape, n, blocked, allowed).

    shape is a path whose digit runs are wildcards. Every level takes a few jobs over what is left of the counts; paths
    that are alone below a node are settled, so levels end where branching does.
    """
    tree = with_evidence(counts).withColumns({"node": F.lit(""), "rest": F.col("shape")})
    tree = stored(tree.select("host", "shape", *COUNTS, "node", "rest"), "tree")
    settled, at = [], ["host", "node"]
    while True:
        total = tree.count()
        ways = tree.groupBy(*at).agg((F.min("rest") < F.max("rest")).alias("branches"), F.count("*").alias("ways"))
        known = with_sums(tree, ways, at, "ways", total).drop("ways")
        goes = F.col("branches") & (F.col("rest") != "")
        settled.append(stored(known.where(~goes).select("host", "shape", *COUNTS, F.concat("node", "rest").alias("template")), "settled"))
        deeper = stored(level(known.where(goes).drop("branches"), total), "tree")
        forget(tree)
        tree = deeper
        if not tree.take(1):
            break
    named = settled[0]
    for more in settled[1:]:
        named = named.unionByName(more)
    total = purity(*with_told(F.sum("blocked"), F.sum("allowed"), F.sum("expected"), F.sum("told"), F.sum("n").cast("double")))
    judged = named.groupBy("host", "template").agg(total.alias("purity"), F.count("*").alias("shapes"))
    return with_sums(named.select("host", "shape", "template", "n"), judged, ["host", "template"], "shapes", named.count()).drop("shapes")


def level(tree: DataFrame, total: int) -> DataFrame:
    """The tree (of total rows at most) one segment further down: node longer by the segment or by a wildcard, rest shorter."""
    first = F.regexp_extract("rest", "^/[^/]*", 0)
    tree = tree.withColumns({"seg": first, "tail": F.expr("substring(rest, char_length(regexp_extract(rest, '^/[^/]*', 0)) + 1)")})
    above = ["host", "node"]
    c = F.col
    sums = [F.sum("n").cast("double").alias("own"), F.sum("blocked").alias("ob"), F.sum("allowed").alias("oa"), F.sum("expected").alias("oe"), F.sum("told").alias("ot")]
    rows = F.count("*").alias("rows")
    each = tree.groupBy(*above, "seg").agg(*sums, rows)
    spread = F.log2(F.sum("own")) - F.sum(c("own") * F.log2("own")) / F.sum("own")
    whole = [F.sum(o).alias(p) for o, p in (("own", "size"), ("ob", "pb"), ("oa", "pa"), ("oe", "pe"), ("ot", "pt"))]
    node = each.groupBy(*above).agg(spread.alias("spread"), *whole, F.count("*").alias("k"))  # k segments are k rows of each
    blocked, allowed = with_told(c("ob"), c("oa"), c("oe"), c("ot"), c("own"))
    others = purity(*with_told(c("pb") - c("ob"), c("pa") - c("oa"), c("pe") - c("oe"), c("pt") - c("ot"), c("size") - c("own")))
    alone = (c("k") > 1) & (F.abs(purity(blocked, allowed, others) - others) > GAP)
    wide = (F.col("spread") > math.log2(MAX_CHILDREN)) & (MAX_CHILDREN * F.col("own") < F.col("size")) & ~alone
    kinds = with_sums(each, node, above, "k", total).select(*above, "seg", "rows", F.coalesce(alone, F.lit(False)).alias("alone"), F.coalesce(wide, F.lit(False)).alias("wide"))
    tree = with_sums(tree, kinds, [*above, "seg"], "rows", total)
    tree = stored(tree.withColumn("seg", F.when(F.col("wide"), "/*").otherwise(F.col("seg"))).drop("wide", "rest", "rows"), "tree")
    child = tree.groupBy(*above, "seg", "tail").agg(F.sum("n").cast("double").alias("c"))
    pooled = child.groupBy(*above, "tail").agg(F.sum("c").alias("pc"), F.count("*").alias("heads"))
    own = tree.groupBy(*above, "seg").agg(*sums, rows)
    own = with_sums(own, own.groupBy(*above).agg(*whole, F.count("*").alias("segs")), above, "segs", total)
    shares = with_sums(with_sums(child, pooled, [*above, "tail"], "heads", total), own, [*above, "seg"], "rows", total)
    apart = shares.groupBy(*above, "seg", "own", "size", "ob", "oa", "oe", "ot", "pb", "pa", "pe", "pt", "rows").agg(
        F.sum(F.abs(F.col("c") * F.col("size") - F.col("pc") * F.col("own"))).alias("differ"), F.sum("pc").alias("seen")
    )
    distance = F.col("differ") + F.col("own") * (F.col("size") - F.col("seen"))
    alike = purity(blocked, allowed) - purity(*with_told(c("pb"), c("pa"), c("pe"), c("pt"), c("size")))
    near = (100 * distance <= 2 * MERGE * F.col("own") * F.col("size")) & (F.abs(alike) <= GAP)
    merged = with_sums(tree, apart.where(near).select(*above, "seg", F.lit(True).alias("near"), "rows"), [*above, "seg"], "rows", total)
    seg = F.when(F.col("near") & ~F.col("alone"), "/*").otherwise(F.col("seg"))
    return merged.select("host", "shape", *COUNTS, F.concat("node", seg).alias("node"), F.col("tail").alias("rest"))


def judge(df: DataFrame, rules: Sequence[tuple[str, str]] = (), url: str = "url", label: str | None = None) -> DataFrame:
    """df with host, path, rule, template, purity and verdict (allow or block): the rule's, else the template's.

    The labels that purity comes from are the rules' verdicts, and the column label (block, allow or null) where no rule fits.
    """
    new = ("host", "path", "rule", "template", "purity", "verdict")
    pages = df.drop(*(c for c in df.columns if c.lower() in new and c not in (url, label)))
    h, p, r, v, s, t, w, n = fresh(pages, "host", "path", "rule", "said", "shape", "template", "purity", "n")
    pages = pages.withColumns({h: host_of(F.col(url)), p: path_of(F.col(url))})
    pages = pages.withColumn(r, matched_rule(F.col(h), F.col(p), rules))
    verdict = F.lit(None).cast("string")
    for said, rule in rules:
        verdict = F.when(F.col(r) == rule, said).otherwise(verdict)
    said = F.coalesce(verdict, F.col(label)) if label else verdict
    pages = pages.withColumns({v: verdict, s: F.regexp_replace(p, "[0-9]+", "*")})
    blocked, allowed = (F.sum(F.when(said == x, 1).otherwise(0)) for x in ("block", "allow"))
    counts = pages.groupBy(F.col(h).alias("host"), F.col(s).alias("shape")).agg(F.count("*").alias("n"), blocked.alias("blocked"), allowed.alias("allowed"))
    counts = stored(counts, "counts")
    found = templates(counts).select(F.col("host").alias(h), F.col("shape").alias(s), F.col("template").alias(t), F.col("purity").alias(w), F.col("n").alias(n))
    everything = counts.agg(F.sum("n")).first()[0] or 0
    out = with_sums(pages, stored(found, "found"), [h, s], n, everything)
    kept = [F.col(f"`{c}`") for c in df.columns if c in pages.columns and not (c.lower() in new)]
    judged = F.coalesce(F.col(v), F.when(F.col(w) > LIMIT, "block").otherwise("allow"))
    return out.select(*kept, *(F.col(a).alias(b) for a, b in zip((h, p, r, t, w), new, strict=False)), judged.alias("verdict"))
