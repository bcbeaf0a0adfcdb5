"""Linking within hash buckets, and connected components, as distributed tables only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch

#: Documents in a block of the last turn.
BLOCK = 128
#: A bucket with so many ids outside its star's component, or fewer, is settled in the second turn.
STARS = 8
#: Modulus of the sums that tell buckets apart: products of two residues fit a long.
PRIME = (1 << 31) - 1


def components(scratch: Scratch, links: DataFrame, name: str) -> DataFrame:
    """(v, root) for every end of a link (a, b); root is the least id of v's component.

    Least neighbours and then the roots of roots are taken until nothing changes. A node with very many links is
    summed before the shuffle, and joins on it are split by adaptive execution.
    """
    both = scratch.save(links.select("a", "b").union(links.select("b", "a")), f"{name}-both")
    roots = scratch.save(both.groupBy(F.col("a").alias("v")).agg(F.least(F.first("a"), F.min("b")).alias("root")), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = both.join(roots.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("root").alias("near"))
        lower = roots.join(near, "v", "left").select("v", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        lower = scratch.save(lower, f"{name}-{step}-near")
        up = lower.select(F.col("v").alias("root"), F.col("root").alias("above"))
        after = scratch.save(lower.join(up, "root", "left").select("v", "was", F.least("root", "above").alias("root")), f"{name}-{step}")
        changed = after.filter("root < was").limit(1).count()
        scratch.drop(f"{name}-{step - 1}", f"{name}-{step}-near")
        roots = after.select("v", "root")
        if not changed:
            return roots


def classes_of(scratch: Scratch, heads: DataFrame, verify: Callable[[DataFrame, str], DataFrame], compare: Callable[[DataFrame], DataFrame], possible: Callable[[Column, Column], Column] | None = None, carry: Callable[[Column, Column], Column] | None = None, place: Callable[[Column], Column] | None = None, block: int = BLOCK, few: int = STARS) -> DataFrame:
    """(v, root): classes of ids whose links are among pairs that share a bucket.

    heads: (v, bands array<long>). verify(pairs(a, b), tag) keeps the pairs that are links. compare(blocks) gives the
    links (a, b) within blocks: rows (family, i, j, outer, v, root), where each outer id of a block is to be compared
    with each that isn't outer and has another root. With possible(mark, mark) and carry(mark, mark), bands are structs of
    bucket and mark, a pair that shares a bucket is a candidate only if its marks there allow it, and verify gets in
    ``carried`` the distinct values that carry takes of the marks of a and b. place(mark) is where in v the bucket lies.

    Buckets of the same ids, at the same distances from each other, tell the same: one of them is kept.

    Each bucket is first a star around its least id; buckets whose ids are then in one component hold no link that could
    change the result. In the others every id outside the star's component, if they are few, makes a star of its own,
    which settles the bucket, else one drawn by hash. Ids of a larger bucket that are then still outside its star's
    component are compared with all of its family, the buckets of that component, in blocks of bounded size that give
    back links only. So every pair of a bucket is compared or within one component, no component is missed, and the
    pairs written grow with the members of buckets, not with their squares.
    """
    mark = ["mark"] if possible else []
    may = possible or (lambda x, y: F.lit(True))
    spread = heads.select(F.explode("bands").alias("e"), "v").select(*(["e.bucket", "v", "e.mark"] if mark else [F.col("e").alias("bucket"), "v"]))
    ids = [F.pmod(F.xxhash64(F.lit(k), "v"), F.lit(PRIME)) for k in (1, 2)]
    at = F.pmod(place(F.col("mark")).cast("long"), F.lit(PRIME)) if place else F.lit(0)
    sums = [F.sum(x).alias(f"s{k}") for k, x in enumerate(ids)] + ([F.sum(F.pmod(x * at, F.lit(PRIME))).alias(f"p{k}") for k, x in enumerate(ids)] if place else [])
    least = F.min(F.struct("v", *mark)).alias("x") if mark else F.min("v").alias("hub")
    stars = spread.groupBy("bucket").agg(least, F.max("v").alias("top"), F.count("*").alias("n"), *sums)
    if mark:
        stars = stars.select("*", F.col("x.v").alias("hub"), F.col("x.mark").alias("hub_mark")).drop("x")
    stars = stars.filter("hub < top")
    if place:
        own = F.pmod(place(F.col("hub_mark")).cast("long"), F.lit(PRIME))
        stars = stars.withColumns({f"p{k}": F.pmod(F.pmod(f"p{k}", F.lit(PRIME)) - F.pmod(own * F.pmod(f"s{k}", F.lit(PRIME)), F.lit(PRIME)), F.lit(PRIME)) for k in (0, 1)})
    same = ["hub", "n", "s0", "s1", *(["p0", "p1"] if place else [])]
    kept = F.min_by(F.struct("bucket", *(["hub_mark"] if mark else [])), "bucket").alias("x")
    stars = stars.groupBy(*same).agg(kept).select("hub", "n", F.col("x.bucket").alias("bucket"), *[F.col("x.hub_mark").alias("hub_mark") for _ in mark])
    members = scratch.save(spread.join(scratch.save(stars, "stars"), "bucket"), "members")
    del spread, stars
    scratch.tidy()
    ends = lambda rows: rows.groupBy("a", "b").agg(F.collect_set("c").alias("carried")) if mark else rows.select("a", "b").distinct()
    met = members.filter(F.col("v") > F.col("hub")).filter(may(F.col("mark"), F.col("hub_mark")) if mark else F.lit(True))
    checked = scratch.save(ends(met.select(F.col("hub").alias("a"), F.col("v").alias("b"), *[carry(F.col("hub_mark"), F.col("mark")).alias("c") for _ in mark])), "pairs1")
    links = verify(checked, "1")
    scratch.tidy()
    roots = components(scratch, links, "roots1")

    def split_buckets(members: DataFrame, tag: str) -> DataFrame:
        named = members.join(roots, "v", "left").withColumn("root", F.coalesce("root", "v"))
        named = named.join(roots.select(F.col("v").alias("hub"), F.col("root").alias("main")), "hub", "left").withColumn("main", F.coalesce("main", "hub"))
        return scratch.save(named.select("bucket", "hub", "v", "root", "main", *mark), f"named{tag}")

    named = split_buckets(members.filter("n > 2").select("bucket", "hub", "v", *mark), "2")
    outside = named.filter("root <> main")
    mixed = scratch.save(outside.groupBy("bucket").agg(F.count("*").alias("m"), F.min_by(F.struct("v", "root", *mark), F.xxhash64("v")).alias("x")), "mixed")
    if not mixed.limit(1).count():
        return roots
    every = outside.join(mixed.filter(F.col("m") <= few).select("bucket"), "bucket").select("bucket", F.struct("v", "root", *mark).alias("x"))
    picked = every.unionByName(mixed.filter(F.col("m") > few).select("bucket", "x"))
    met = named.join(picked, "bucket").filter(F.col("root") != F.col("x.root")).filter(may(F.col("mark"), F.col("x.mark")) if mark else F.lit(True))
    taken = [F.when(F.col("v") < F.col("x.v"), carry(F.col("mark"), F.col("x.mark"))).otherwise(carry(F.col("x.mark"), F.col("mark"))).alias("c") for _ in mark]
    pairs = ends(met.select(F.least("v", "x.v").alias("a"), F.greatest("v", "x.v").alias("b"), *taken))
    # With marks a pair may have been checked by other values than it meets with here.
    pairs = scratch.save(pairs if mark else pairs.join(checked, ["a", "b"], "left_anti"), "pairs2")
    links = scratch.save(links.union(verify(pairs, "2")), "links")
    scratch.tidy()
    roots = components(scratch, links, "roots2")

    large = named.join(mixed.filter(F.col("m") > few).select("bucket"), "bucket", "left_semi").select("bucket", "hub", "v", *mark)
    named = split_buckets(large, "3")
    mixed = named.filter("root <> main").select("bucket").distinct()
    named = named.join(mixed, "bucket")
    family = scratch.save(named.select(F.col("main").alias("family"), "v", "root").distinct(), "family")
    outer = F.col("root") != F.col("family")
    sizes = family.groupBy("family").agg(F.count("*").alias("n"), F.count_if(outer).alias("m")).filter("m > 0 and n > 2")
    sizes = sizes.select("family", F.ceil(F.col("m") / F.lit(block)).cast("int").alias("rows"), F.ceil(F.col("n") / F.lit(block)).cast("int").alias("columns"))
    placed = family.join(sizes, "family").withColumn("h", F.xxhash64("v"))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = placed.filter(outer).withColumn("i", F.pmod("h", F.col("rows")).cast("int")).withColumn("j", all_of("columns")).withColumn("outer", F.lit(True))
    right = placed.withColumn("j", F.pmod("h", F.col("columns")).cast("int")).withColumn("i", all_of("rows")).withColumn("outer", F.lit(False))
    blocks = left.select("family", "i", "j", "outer", "v", "root").unionByName(right.select("family", "i", "j", "outer", "v", "root"))
    more = scratch.save(compare(blocks), "more")
    scratch.tidy()
    return components(scratch, links.union(more), "roots3") if more.limit(1).count() else roots
