"""URL filter: a path-template tree for each host, judged by smoothed labelled purity.

1. Rules (host, path, verdict) fit a host and its subdomains where the path starts with the rule's; the longest wins.
   They label the pages they fit. Of the others those with a word of ``block_words`` in host or path are labelled block, those with
   one of ``allow_words`` only are labelled allow, and all others have no label.
2. Paths become shapes: all their segments; numbers, dates and hexadecimal ids are replaced by a class. All pages are counted by
   host and shape.
3. Round by round, every node that at least ``support`` pages with different rests pass, not all of them labelled alike, is split at its first
   segment that differs; paths that end there are a branch of their own.
   Children stay literal where ``support`` pages have them and their labelled share of blocked pages differs from the node's by
   ``z`` standard errors, or where they have no labels though the node's share of labelled pages makes one expect some by as many; all
   others merge into the wildcard branch. Segments that all pages of a node share are walked in one round.
4. A template's purity is (blocked + m * prior) / (labelled + m). The prior of a literal child with labels is its parent's purity, that of
   others its parent's prior, since its siblings' labels are what they are not like; a host's is ``prior``. Templates of at least ``reject`` are
   blocked, so that unlabelled pages share the verdict of the labelled ones of their template.

Everything is a DataFrame plan; tables after step 2 have one row for each host and shape.

Defined results: a null url, or one without ``://``, has an empty host and path and is judged as such; an empty path has one
empty segment; paths may have any number of segments; repeated rows are judged each; nulls in other columns do not matter; an empty table gives an
empty table. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of the registered query: (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
BLOCK_WORDS = ("casino", "bets", "betting", "poker", "adult", "porn", "xxx", "pills", "viagra", "spam", "malware", "phishing")
ALLOW_WORDS = ("edu", "gov", "wiki", "docs", "research", "library", "museum", "archive", "university")

#: The step of paths that end where others go on.
END = "<end>"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_struct(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """The longest rule that fits, as struct(rule, verdict), or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def label_of(found: Column, host: Column, path: Column, block_words: tuple[str, ...], allow_words: tuple[str, ...]) -> Column:
    """1 (block), 0 (allow) or null, where neither a rule nor a word speaks."""
    words = F.split(F.translate(F.concat(host, path), UPPER, LOWER), r"[^a-z0-9]+")

    def has(some: tuple[str, ...]) -> Column:
        return F.arrays_overlap(words, F.array(*map(F.lit, some))) if some else F.lit(False)

    by_word = F.when(has(block_words), 1).when(has(allow_words), 0)
    return F.when(found.isNotNull(), F.when(found["verdict"] == "block", 1).otherwise(0)).otherwise(by_word)


def segment_class(segment: Column) -> Column:
    """A class for segments that are variable by their look, else the segment; file endings stay."""
    out = F.regexp_replace(segment, r"^\d{4}-\d\d?(-\d\d?)?$", "<date>")
    out = F.regexp_replace(out, r"^(?i)[0-9a-f]{8}-[0-9a-f-]{27}(?=\.|$)", "<uuid>")
    out = F.regexp_replace(out, r"^(?=[0-9a-f]*\d)(?=[0-9a-f]*[a-f])[0-9a-f]{8,}(?=\.|$)", "<hex>")
    return F.regexp_replace(out, r"\d+", "<n>")


def shape_of(path: Column) -> Column:
    """All segments of a path, classed."""
    return F.transform(F.split(F.regexp_replace(path, r"^/", ""), "/"), segment_class)


def _smoothed(blocked: str, labelled: str, prior: str, m: float) -> Column:
    return (F.col(blocked) + m * F.col(prior)) / (F.col(labelled) + m)


def template_tree(counts: DataFrame, support: int, z: float, m: float, prior: float) -> DataFrame:
    """(host, shape, template, purity) from (host, shape, n, labelled, blocked). Each round is a written table, so plans stay as small as one round."""
    hosts = counts.groupBy("host").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b")).withColumn("prior", F.lit(prior))
    hosts = hosts.select("host", "prior", _smoothed("b", "l", "prior", m).alias("purity"))
    rows = written(counts.join(hosts, "host").withColumn("template", F.lit("")).withColumn("rest", F.col("shape")), "url-nodes")
    done = None
    while True:
        nodes = rows.groupBy("host", "template").agg(F.sum("n").alias("p_n"), F.sum("labelled").alias("p_l"), F.sum("blocked").alias("p_b"), F.min("rest").alias("lo"), F.max("rest").alias("hi"))
        alike = (F.col("p_l") == 0) | ((F.col("p_l") == F.col("p_n")) & F.col("p_b").isin(0, F.col("p_l")))
        nodes = nodes.withColumn("split", (F.col("p_n") >= support) & (F.col("lo") != F.col("hi")) & ~alike)
        placed = written(rows.join(nodes, ["host", "template"]), "url-placed")
        tail = F.when(F.col("lo") == F.col("hi"), F.array_join(F.transform("rest", lambda s: F.concat(F.lit("/"), s)), "")).otherwise(F.lit("/**"))
        closed = placed.where(~F.col("split")).select("host", "shape", F.concat("template", tail).alias("template"), "purity")
        done = closed if done is None else done.unionByName(closed)
        some = placed.where("split")
        if not some.limit(1).count():
            return done
        same = F.array_position(F.zip_with("lo", "hi", lambda a, b: a.eqNullSafe(b)), False).cast("int") - 1
        some = some.withColumn("same", same).withColumn("seg", F.coalesce(F.get("rest", F.col("same")), F.lit(END)))
        shared = F.array_join(F.transform(F.slice("rest", F.lit(1), F.col("same")), lambda s: F.concat(F.lit("/"), s)), "")
        some = some.withColumn("stem", F.concat("template", shared)).withColumn("after", F.slice("rest", F.col("same") + 2, F.greatest(F.size("rest"), F.lit(1))))
        children = some.groupBy("host", "template", "seg").agg(F.first("stem").alias("stem"), F.sum("n").alias("n"), F.sum("labelled").alias("l"), F.sum("blocked").alias("b"), F.first("p_n").alias("p_n"), F.first("p_l").alias("p_l"), F.first("p_b").alias("p_b"), F.first("prior").alias("prior"), F.first("purity").alias("purity"))
        rate = (F.col("p_b") + 0.5) / (F.col("p_l") + 1)
        known = F.nullif(F.col("l"), F.lit(0))
        off = F.abs(F.col("b") / known - rate) / F.sqrt(rate * (1 - rate) / known)
        covered = F.col("p_l") / F.col("p_n")
        unlabelled = (F.col("l") == 0) & (F.col("n") * covered >= z * F.sqrt(F.col("n") * covered * (1 - covered))) & (covered > 0)
        literal = (F.col("n") >= support) & (F.coalesce(off >= z, F.lit(False)) | unlabelled)
        named = written(children.withColumn("literal", literal).withColumn("step", F.when(literal | (F.col("seg") == END), F.col("seg")).otherwise(F.lit("*"))), "url-steps")
        branches = named.groupBy("host", "template", "step", "stem", "literal").agg(F.sum("l").alias("l"), F.sum("b").alias("b"), F.first("prior").alias("p"), F.first("purity").alias("q"))
        branches = branches.withColumn("prior", F.when(F.col("literal") & (F.col("l") > 0), F.col("q")).otherwise(F.col("p")))
        branches = branches.select("host", "template", "step", "prior", _smoothed("b", "l", "prior", m).alias("purity"), F.concat("stem", F.lit("/"), "step").alias("deeper"))
        step_of = named.select("host", "template", "seg", "step").join(branches, ["host", "template", "step"])
        kept = some.select("host", "shape", "n", "labelled", "blocked", "template", "seg", F.col("after").alias("rest"))
        rows = written(kept.join(step_of, ["host", "template", "seg"]).drop("template", "seg", "step").withColumnRenamed("deeper", "template"), "url-nodes")


def judge_urls(
    df: DataFrame, key: str = "page_id", url: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES, block_words: tuple[str, ...] = BLOCK_WORDS,
    allow_words: tuple[str, ...] = ALLOW_WORDS, support: int = 20, z: float = 3.0, m: float = 5.0, prior: float = 0.2, reject: float = 0.5,
) -> DataFrame:
    """(key, host, path, rule, verdict, template, purity) for every row."""
    u = F.col(f"`{url}`")
    pages = pick(df, key, url).select(F.col(f"`{key}`").alias("key"), host_of(u).alias("host"), path_of(u).alias("path"))
    pages = pages.withColumn("found", rule_struct(F.col("host"), F.col("path"), rules)).withColumn("shape", shape_of(F.col("path")))
    label = label_of(F.col("found"), F.col("host"), F.col("path"), block_words, allow_words)
    # A third of all pages may share a host and a shape: partial sums come before the shuffle, and the join back below is one that can be split.
    counts = pages.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.count(label).alias("labelled"), F.coalesce(F.sum(label), F.lit(0)).alias("blocked"))
    tree = template_tree(written(counts, "url-shapes"), support, z, m, prior)
    verdict = F.coalesce(F.col("found.verdict"), F.when(F.col("purity") >= reject, "block").otherwise("allow"))
    return pages.join(tree, ["host", "shape"]).select("key", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "template", "purity")
