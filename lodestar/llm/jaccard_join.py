"""N-gram Jaccard join by a token-group matrix.

A document's set holds the hashes of its five-word shingles. Documents with equal sets (told by 128-bit hashes) are one node, named by their least key. Two nodes link when 100 * intersection >= 80 * union.

1. Groups: nodes that share one of their least hashes, and most of a small bottom sketch, are compared with the most typical node of that bucket. Verified links make groups of similar nodes, all of one component. This is a heuristic, which the rest doesn't depend on.
2. Matrix: for each token the groups that have it, with the sizes of their members and the most that an overlap beginning there can reach. Its index holds leading tokens: a set of n tokens links only with sets that share one of its first n - ceil(0.8 n) + 1 tokens, in any order that holds for all sets. The order here puts tokens that many documents share last.
3. Bound: two groups that share no token of the index can't hold a link, nor can those where the size or the position of each shared token leaves too little. Of those that are left each member of the one is a query for the other: its overlap with the group's tokens is summed: first cell by cell of histograms of 64 cells (of the group the most of any member), and where that leaves enough, over all tokens of the query and the union of all tokens of the group's members. No member can share more with it.
4. Open: only groups whose summed overlap reaches what a link with their smallest member needs. The query is compared in full with the group's most linked member first. A link settles the pair of groups, since each is of one component already; only where none of a group's queries has one, its members are looked at. What most of them have is the group's core, and each member is what it has beyond the core and lacks of it. A query's overlap with the core is counted once for all members; those that share more with it are found by the tokens beyond, the others only if the core alone is enough.

So a large group of near copies meets others as one column of the matrix, and no pairs within it are listed. Components of all verified links are exact (up to 64-bit hash collisions of shingles). Where one token, node, bucket or group has very many rows they are dealt over several tasks (common.spread).

A null or wordless text has an empty set and links with nothing. Rows with equal keys count as one document that has all of their sets; those without words still have none. A null key has no component. Repeated rows stay repeated. The key is a bigint. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.llm.common import WordHashes, as_long, batches, bloom, bloom_hit, components, forget, hashable, maybe_in, release, shingles, spread, written

#: Tokens of a set's bottom sketch, how many of them bucket it, and how many two sketches must share to be compared in step 1.
SKETCH, BUCKETS, ALIKE = 16, 4, 9
#: Cells of a set's histogram: its tokens by their leading bits.
CELLS = 64
#: Common tokens: in a block of BLOCK shingles at least LOCAL times. The COMMON most frequent of them go last in the order; which they are changes the cost, not the result.
BLOCK, LOCAL, COMMON = 2_000_000, 3, 1 << 18


def common_tokens(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Sorted common tokens and their counts over all documents: at most COMMON of them, 4 MB."""
    schema = pa.schema([("token", pa.int64()), ("n", pa.int64())])

    def count(it) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        held: list[np.ndarray] = []
        size = 0

        def flush():
            if held:
                tokens, n = np.unique(np.concatenate(held), return_counts=True)
                much = n >= LOCAL
                yield pa.RecordBatch.from_arrays([pa.array(as_long(tokens[much])), pa.array(n[much])], schema=schema)

        for (t,) in batches(it, text):
            held.append(shingles(t, hashes))
            size += len(held[-1])
            if size >= BLOCK:
                yield from flush()
                held, size = [], 0
        yield from flush()

    got = docs.select(text).mapInArrow(count, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(COMMON).toArrow()
    tokens, n = got.column("token").to_numpy().view(np.uint64), got.column("n").to_numpy()
    order = np.argsort(tokens)
    return tokens[order], n[order]


def leading(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


def _sets(docs: DataFrame, common, key: str, text: str) -> DataFrame:
    """(key, n, h, typical, sketch, cells, tokens) of each row; h: hash of the whole set; cells: its histogram; tokens: the leading ones."""
    none = np.zeros(0, np.int64)

    def run(it) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        often, counts = common.value
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            k, n, h, typical, *lists = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(n, pa.int64()), pa.array(h, pa.binary()), pa.array(typical, pa.int64()), *(listed(x, t) for x, t in zip(lists, (np.int64, np.int32, np.int64), strict=True))], ["key", "n", "h", "typical", "sketch", "cells", "tokens"])

        for k, t in batches(it, key, text):
            s = shingles(t, hashes)
            if not len(s):
                rows.append((k, 0, None, 0, none, none, none))
            else:
                if len(often):
                    at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                    known = often[at] == s
                    rare, hot = s[~known], s[known]
                    hot = hot[np.lexsort((hot, counts[at[known]]))]
                else:
                    rare, hot = s, s[:0]
                first = np.concatenate([rare, hot])[: leading(len(s))]
                rows.append((k, len(s), xxhash.xxh3_128_digest(s.tobytes()), 1000 * len(hot) // len(s), as_long(s[:SKETCH]), np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=CELLS), as_long(first)))
            if len(rows) == 500:
                yield batch()
                rows.clear()
        if rows:
            yield batch()

    return docs.select(key, text).mapInArrow(run, "key bigint, n bigint, h binary, typical bigint, sketch array<bigint>, cells array<int>, tokens array<bigint>")


def listed(arrays, kind: type) -> pa.ListArray:
    """Arrays as one column of lists."""
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays).astype(kind)))


def _whole(docs: DataFrame, asked: DataFrame, key: str, text: str) -> DataFrame:
    """(node, tokens): the whole sets of asked nodes, made again. A Bloom filter of fixed size picks their documents where the texts are read, so texts are not shuffled."""
    bits = docs.sparkSession.sparkContext.broadcast(bloom(asked, "node"))

    def run(it) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in it:
            hit = pa.array(bloom_hit(bits.value, b.column("_p1").to_numpy(), b.column("_p2").to_numpy()))
            asked = b.select(["key", "text"]).filter(hit)
            for at in range(0, asked.num_rows, 200):
                keys, texts = (asked.slice(at, 200).column(c).to_pylist() for c in ("key", "text"))
                sets = [shingles(t, hashes) for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), listed([as_long(s) for s in sets], np.int64)], ["node", "tokens"])

    made = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), *maybe_in(key)).mapInArrow(run, "node bigint, tokens array<bigint>").where(F.size("tokens") > 0)
    return written(made.join(asked, "node", "left_semi"))


def _linked(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """Of pairs (a, b) of nodes, a written table, those whose sets link."""
    shared = F.size(F.array_intersect("ta", "tb"))
    both = spread(pairs, whole.withColumnsRenamed({"node": "b", "tokens": "tb"}), "b").join(whole.withColumnsRenamed({"node": "a", "tokens": "ta"}), "a")
    return written(both.where(9 * shared >= 4 * (F.size("ta") + F.size("tb"))).select("a", "b").distinct())


def _groups(nodes: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """Verified links (a, b) of nodes with a typical node that shares their least hashes."""
    buckets = nodes.select("node", "n", "typical", "sketch", F.explode(F.slice("sketch", 1, BUCKETS)).alias("m"))
    lead = buckets.groupBy("m").agg(F.min(F.struct((-F.col("typical")).alias("t"), "node", "n", "sketch")).alias("l"), F.count(F.lit(1)).alias("c")).where("c > 1").select("m", F.col("l.node").alias("b"), F.col("l.n").alias("nb"), F.col("l.sketch").alias("sb"))
    alike = F.size(F.array_intersect("sketch", "sb")) >= F.least(F.lit(ALIKE), F.ceil(F.least("n", "nb") * 0.6))
    star = spread(buckets, lead, "m").where("node <> b and 5 * n >= 4 * nb and 5 * nb >= 4 * n").where(alike).select(F.col("node").alias("a"), "b").distinct()
    star = written(star)
    whole = _whole(docs, star.select(F.explode(F.array("a", "b")).alias("node")).distinct(), key, text)
    out = _linked(star, whole)
    forget(star)
    forget(whole)
    return out


def _band(n) -> Column:
    """Sizes that can link are of one band or of neighbouring ones, up to five away."""
    return F.floor(F.log(n) / float(np.log(1.05))).cast("int")


def _index(grouped: DataFrame) -> DataFrame:
    """The matrix over leading tokens: (token, group, band, least, most, rest) for tokens that several groups have. Members of a group are gathered before they meet other groups, so a token of a large group is few rows."""
    rows = grouped.select("group", "several", "n", F.posexplode("tokens").alias("i", "token")).select("token", "group", "several", _band(F.col("n")).alias("band"), "n", (F.col("n") - F.col("i")).alias("rest"))
    alone = rows.where("not several").select("token", "group", "band", F.col("n").alias("least"), F.col("n").alias("most"), "rest")
    one = rows.where("several").groupBy("token", "group", "band").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("rest").alias("rest"))
    per = Window.partitionBy("token")
    return written(alone.union(one).withColumn("lo", F.min("group").over(per)).withColumn("hi", F.max("group").over(per)).where("lo <> hi").drop("lo", "hi"))


def _queries(matrix: DataFrame, grouped: DataFrame) -> DataFrame:
    """(q, n, own, group, least): nodes and the groups, other than their own, that they may link with.

    Of two groups the one with the smaller set asks. It looks only where a link can begin: a set of n can link with one of m >= n only if the first token that both have leaves 4/9 (n + m), so at a token with less than 8/9 n left it asks for nothing, and else for bands of sizes up to 9/4 of what is left, less n.
    """
    home = matrix.select("token", "band", *(F.col(c).alias(f"h_{c}") for c in ("group", "least", "most", "rest")))
    reach = F.least(F.col("most") * 1.25, F.col("rest") * 2.25 - F.col("least"))
    asks = matrix.where("9 * rest >= 8 * least").select("token", "group", "least", "most", "rest", F.explode(F.sequence(_band(F.col("least")), F.greatest(_band(reach + 0.001), _band(F.col("least"))))).alias("band"))
    keyed = lambda df: df.withColumn("k", F.xxhash64("token", "band")).drop("band")
    met = spread(keyed(home).withColumnRenamed("token", "h_token"), keyed(asks), "k").where("token = h_token and group <> h_group and least <= h_most and 5 * most >= 4 * h_least and 9 * least(rest, h_rest) >= 4 * (least + greatest(least, h_least))")
    may = met.select(F.least("group", "h_group").alias("own"), F.greatest("group", "h_group").alias("group")).distinct()
    may = written(may)
    # the most that two sets can share, cell by cell of their histograms; a group has the most of its members in each
    cells = grouped.where("several").groupBy("group").agg(F.count(F.lit(1)).alias("members"), F.min("n").alias("least"), F.max("n").alias("most"), F.array(*(F.max(F.col("cells")[c]) for c in range(CELLS))).alias("cells"))
    every = written(cells.unionByName(grouped.where("not several").select("group", F.lit(1).cast("bigint").alias("members"), F.col("n").alias("least"), F.col("n").alias("most"), "cells")))
    sides = lambda k: every.select(F.col("group").alias(k), F.struct("members", "group", "least", "most", "cells").alias(f"{k}_s"))
    one = written(spread(may, sides("own"), "own"))
    two = spread(one, sides("group"), "group")
    both = lambda x, y: F.aggregate(F.zip_with(x, y, lambda v, w: F.least(v, w)), F.lit(0), lambda s, v: s + v)
    # the group of fewer members asks
    small, large = F.least("own_s", "group_s"), F.greatest("own_s", "group_s")
    turned = two.select(small.alias("a"), large.alias("b"))
    smallest = F.expr("4 * (greatest(a.least, (4 * b.least + 4) div 5) + greatest(b.least, (4 * a.least + 4) div 5))")
    near = written(turned.where(9 * both("a.cells", "b.cells") >= smallest).select(F.col("a.group").alias("own"), F.col("b.group").alias("group"), F.col("b.members").alias("members"), F.col("b.least").alias("least"), F.col("b.most").alias("most"), F.col("b.cells").alias("cells")))
    forget(one)
    forget(may)
    forget(every)
    asking = spread(grouped.select(F.col("group").alias("own"), F.col("node").alias("q"), "n", F.col("cells").alias("q_cells"), "tokens"), near, "own").where("5 * n >= 4 * least and 5 * most >= 4 * n").where(9 * both("q_cells", "cells") >= 4 * (F.col("n") + F.expr("greatest(least, (4 * n + 4) div 5)")))
    asking = written(asking.select("q", "n", "own", "group", "members", "least", "most", "tokens"))
    forget(near)
    # what leading tokens both have, and what can follow them: beyond its leading tokens a set of n has ceil(0.8 n) - 1, and the one whose leading tokens end first counts
    enough = F.expr("9 * least(n, shared + (4 * greatest(n, least(most, 5 * n div 4)) + 4) div 5 - 1) >= 4 * (n + greatest(least, (4 * n + 4) div 5))")
    single = spread(asking.where("members = 1"), grouped.where("not several").select("group", F.col("tokens").alias("lead")), "group").withColumn("shared", F.size(F.array_intersect("tokens", "lead"))).where(enough)
    column = matrix.join(asking.where("members > 1").select("group").distinct(), "group", "left_semi").select(F.xxhash64("token", "group").alias("k")).distinct()
    spots = asking.where("members > 1").select("q", "n", "own", "group", "least", "most", F.explode("tokens").alias("token")).withColumn("k", F.xxhash64("token", "group"))
    sums = spots.join(column, "k").groupBy("q", "group").agg(*(F.min(c).alias(c) for c in ("n", "own", "least")), F.max("most").alias("most"), F.count(F.lit(1)).alias("shared")).where(enough)
    out = written(single.select("q", "n", "own", "group", "least").union(sums.select("q", "n", "own", "group", "least")))
    forget(asking)
    return out


def _opened(asked: DataFrame, grouped: DataFrame, whole: DataFrame, first: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of queries and groups whose union of tokens holds enough of the query's: links with the group's most linked member, and pairs (a, b) of queries and members for groups that this does not settle. first: the links within groups."""
    members = whole.join(grouped.select("node", "group").distinct(), "node").select("node", "group", F.size("tokens").alias("n"), "tokens")
    held = written(members.select("group", F.explode("tokens").alias("token")).groupBy("group", "token").agg(F.count(F.lit(1)).alias("c")))
    union = held.select(F.xxhash64("group", "token").alias("k"))
    wanted = spread(asked, whole.withColumnRenamed("node", "q"), "q").select("q", "n", "own", "group", "least", F.explode("tokens").alias("token")).withColumn("k", F.xxhash64("group", "token"))
    sums = wanted.join(union, "k").groupBy("q", "group").agg(*(F.min(c).alias(c) for c in ("n", "own", "least")), F.count(F.lit(1)).alias("shared"))
    able = written(sums.where("9 * least(shared, n) >= 4 * (n + greatest(least, (4 * n + 4) div 5))").select("q", "own", "group"))
    hubs = first.groupBy(F.col("b").alias("node")).agg(F.count(F.lit(1)).alias("c")).join(grouped.select("node", "group"), "node").groupBy("group").agg(F.max_by("node", F.struct("c", -F.col("node"))).alias("hub"))
    tries = written(spread(able, hubs, "group").select(F.col("q").alias("a"), F.col("hub").alias("b"), "own", "group"))
    hits = _linked(tries.select("a", "b"), whole)
    settled = tries.join(hits, ["a", "b"], "left_semi").select("own", "group").distinct()
    open_ = written(able.join(settled, ["own", "group"], "left_anti").select("q", "group"))
    forget(able)
    forget(tries)
    # at most twice as many tokens as a member has on average are in more than half of the members
    own = written(members.join(open_.select("group").distinct(), "group", "left_semi"))
    count = own.groupBy("group").agg(F.count(F.lit(1)).alias("members"), F.min("n").alias("least"))
    cores = written(count.join(held, "group").where("2 * c > members").groupBy("group").agg(F.min("least").alias("least"), F.collect_list("token").alias("core")))
    sized = written(spread(own, cores.select("group", "core"), "group").select("node", "group", "n", F.array_except("tokens", "core").alias("more"), F.array_except("core", "tokens").alias("lacks")))
    queries = spread(open_, whole.select(F.col("node").alias("q"), F.col("tokens").alias("mine")), "q").join(cores, "group")
    queries = written(queries.select("q", "group", "least", F.size("mine").alias("nq"), F.size(F.array_intersect("mine", "core")).alias("base"), F.array_except("mine", "core").alias("beyond"), "mine"))
    fits = "q <> node and 5 * n >= 4 * nq and 5 * nq >= 4 * n"
    keyed = lambda df, c: df.withColumn("token", F.explode(c)).withColumn("k", F.xxhash64("group", "token")).drop("token", "group")
    extra = written(keyed(sized.select("node", "group", "n", "more"), "more").select("k", "node", "n"))
    met = spread(extra, keyed(queries.select("q", "group", "nq", "base", "beyond"), "beyond").select("k", "q", "nq", "base"), "k").where(fits).groupBy("q", "node").agg(F.count(F.lit(1)).alias("shared"), *(F.max(c).alias(c) for c in ("base", "n", "nq"))).where("9 * (base + shared) >= 4 * (n + nq)")
    enough = queries.where("9 * base >= 4 * (nq + greatest(least, (4 * nq + 4) div 5))").select("q", "group", "nq", "base", "mine")
    near = spread(sized, enough, "group").where(fits).where("9 * base >= 4 * (n + nq)").where(9 * (F.col("base") - F.size(F.array_intersect("lacks", "mine")) + F.size(F.array_intersect("more", "mine"))) >= 4 * (F.col("n") + F.col("nq")))
    pairs = written(met.select(F.col("q").alias("a"), F.col("node").alias("b")).union(near.select("q", "node")).distinct())
    for t in (open_, held, own, cores, sized, queries, extra):
        forget(t)
    return hits, pairs


def joined(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) of each row; component_id is the least key that links reach."""
    spark = docs.sparkSession
    common = spark.sparkContext.broadcast(common_tokens(docs, text))
    sets = written(_sets(docs, common, key, text))
    members = written(sets.select("key", "n", "h"))
    kept = F.struct("n", "typical", "sketch", "cells", "tokens")
    nodes = written(sets.where("n > 0 and key is not null").groupBy("h").agg(F.min("key").alias("node"), F.first(kept).alias("s")).select("h", "node", "s.*"))
    forget(sets)
    release(spark)

    first = _groups(nodes, docs, key, text)
    groups = components(first)
    grouped = written(nodes.drop("h", "typical", "sketch").join(groups, "node", "left").select("node", "n", "cells", "tokens", F.coalesce("component", "node").alias("group"), F.col("component").isNotNull().alias("several")))
    matrix = _index(grouped)
    release(spark)

    asked = _queries(matrix, grouped)
    forget(matrix)
    hosts = grouped.join(asked.select("group").distinct(), "group", "left_semi").select("node")
    whole = _whole(docs, hosts.union(asked.select(F.col("q").alias("node"))).distinct(), key, text)
    hits, pairs = _opened(asked, grouped, whole, first)
    second = _linked(pairs, whole)
    for t in (asked, grouped, whole, pairs):
        forget(t)

    # documents with one key and several sets tie these together
    several = members.where("key is not null and n > 0").groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("key")
    ids = nodes.select("h", "node")
    named = members.where("n > 0").join(several, "key").select("key", "h").distinct().join(ids, "h")
    same = named.join(named.groupBy("key").agg(F.min("node").alias("b")), "key").select(F.col("node").alias("a"), "b").where("a <> b")
    linked = components(first.union(hits).union(second).union(same))
    for t in (first, hits, second):
        forget(t)
    names = ids.join(linked, "node", "left").select("h", F.coalesce("component", "node").alias("component"))
    out = spread(members, names, "h", "left")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("key").isNotNull(), F.coalesce("component", "key")).alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those that have a component of a lesser key. Of rows with the same key the one with the greatest text stays. Documents without words, and rows with a null key, stay. Columns may have any name."""
    found = joined(docs, key, text).where(F.col(key).isNotNull())
    about = found.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_rows"), F.max("n_shingles").alias("_n"), F.min("component_id").alias("_component"))
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.xxhash64(*hashable(docs)).alias("_rank"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    known = spread(rows, about, "_key", "left")
    once = known.where("_key is null or _n = 0 or (_rows = 1 and _component = _key)").select("_row")
    several = known.where("_n > 0 and _rows > 1 and _component = _key").groupBy("_key").agg(F.max_by("_row", F.struct("_text", "_rank")).alias("_row")).select("_row")
    return once.union(several).select("_row.*")
