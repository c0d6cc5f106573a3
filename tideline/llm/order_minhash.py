"""Near-duplicate detection with Order MinHash.

A text is its sequence of k-mers (five words in lower case), each labelled with its occurrence number, so a repeated
k-mer stays distinct. For each of ``SKETCHES`` permutations the ``LENGTH`` least labelled k-mers are sampled and put back
into text order; their hash is one band. Two texts agree in a band only if they share those k-mers in that order, which
follows edit similarity rather than set overlap. At similarity 0.8 a band agrees with probability about 0.8**4 = 0.41, so
a pair shares none of 24 bands with probability 3e-6.

Candidates never form all pairs of a bucket. Identical k-mer sequences count as one node. In each bucket the member with
the most companions over all its buckets is the hub, and every other member is compared with it. A bucket in which all
members are linked to the hub is one class. What is left open in the other buckets is finished exactly, between classes
only, by a prefix filter over k-mers (``_open_pairs``). No pair is set aside before alignment unless a bound on its
similarity proves it to be below the threshold (``_possible``).

Verification is a banded alignment: shared labelled k-mers on diagonals within the band that the threshold allows are
chained into the longest increasing run; similarity is aligned / (k-mers of both - aligned), links have 0.8 or more.

Classes are connected components of the links; the links of the second step join classes of the first. Nodes are 64-bit
hashes of the k-mer sequence. K-mers are kept as 32 bits in what is written; within a pair that can only raise its
similarity, by a collision of chance below 1e-6 for texts of a thousand words.

Defined results: null and empty texts, and texts without letters or digits, have no k-mers and are classes of their own
(class_id is the own id); a text of one to four words is one k-mer; class_id is the least doc_id of the class, so ties do
not occur, and null ids count as largest; repeated rows share a class; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.components import components
from tideline.llm.tokens import bounded, slices
from tideline.session import Scratch, materialize

K = 5
SKETCHES = 24
LENGTH = 4
THRESHOLD = 0.8
COMMON_KMER = 64
PARITY_BITS = 512
FILTER_WORDS = 1 << 17
CACHE_WORDS = 200_000
WORDS = re.compile(r"[^\W_]+")
MIX = np.uint64(0x9E3779B97F4A7C15)
FINISH = np.uint64(0xBF58476D1CE4E5B9)
ODD = np.random.default_rng(17).integers(0, 2**63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACES = np.random.default_rng(18).integers(0, 2**63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHash(dict):
    def __missing__(self, word: str) -> int:
        value = self[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "replace"), digest_size=8).digest(), "little")
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * FINISH
    return x ^ (x >> np.uint64(29))


def kmers(text: str | None, cache: _WordHash | None = None) -> np.ndarray:
    """Occurrence-labelled k-mer hashes of a text, in order; ``cache`` keeps word hashes from text to text."""
    cache = _WordHash() if cache is None else cache
    if len(cache) > CACHE_WORDS:
        cache.clear()
    words = np.array([cache[w] for w in WORDS.findall((text or "").lower())], dtype=np.uint64)
    if not len(words):
        return words
    width = min(K, len(words))
    found = np.zeros(len(words) - width + 1, dtype=np.uint64)
    for d in range(width):
        found += words[d : d + len(found)] * PLACES[d]
    found = _mixed(found)
    order = np.argsort(found, kind="stable")
    ranked = found[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    place = np.arange(len(ranked))
    occurrence = np.empty(len(ranked), dtype=np.uint64)
    occurrence[order] = place - np.maximum.accumulate(np.where(first, place, 0))
    return _mixed(found + occurrence * MIX)


def sketch(found: np.ndarray) -> np.ndarray:
    """Hash of the ordered sample of each permutation."""
    ranks = found[None, :] * ODD[:, None]
    take = min(LENGTH, len(found))
    if take < len(found):
        at = np.argpartition(ranks, take - 1, axis=1)[:, :take]
    else:
        at = np.tile(np.arange(take), (SKETCHES, 1))
    at.sort(axis=1)
    value = np.arange(SKETCHES, dtype=np.uint64)
    for d in range(take):
        value = _mixed(value * MIX + found[at[:, d]])
    return value.view(np.int64)


def parities(found: np.ndarray) -> np.ndarray:
    """``PARITY_BITS`` bits, as 64-bit integers: whether an odd number of k-mers falls on each of them."""
    odd = np.bincount((found >> np.uint64(64 - 9)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def alignment_similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """aligned / (len(a) + len(b) - aligned) over the band that ``threshold`` allows; 0 where even all shared k-mers are too few."""
    if not len(a) or not len(b):
        return 0.0
    band = (len(a) + len(b)) * (1 - threshold) / (1 + threshold) + 1
    order = np.argsort(b, kind="stable")
    at = np.searchsorted(b, a, sorter=order)
    at[at == len(b)] = 0
    to = order[at]
    (here,) = (b[to] == a).nonzero()
    to = to[here]
    to = to[np.abs(to - here) <= band]
    if len(to) < threshold * (len(a) + len(b) - len(to)):
        return 0.0
    if len(to) > 1 and (np.diff(to) <= 0).any():
        tails: list[int] = []
        for x in to.tolist():
            k = bisect_left(tails, x)
            if k == len(tails):
                tails.append(x)
            else:
                tails[k] = x
        aligned = len(tails)
    else:
        aligned = len(to)
    return aligned / (len(a) + len(b) - aligned)


def _node(found: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)


def sketch_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, node, n (k-mers), odd (parities), sketches and kmers of (doc_id, text); all but the first two are null without k-mers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _WordHash()
        for batch in slices(batches):
            found = [kmers(t, cache) for t in batch.column(2).to_pylist()]
            some = [len(x) > 0 for x in found]
            each = lambda f: [f(x) if y else None for x, y in zip(found, some, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2],
                    pa.array(each(_node), pa.int64()),
                    pa.array(each(len), pa.int32()),
                    pa.array(each(parities), pa.list_(pa.int64())),
                    pa.array(each(sketch), pa.list_(pa.int64())),
                    pa.array(each(lambda x: (x >> np.uint64(32)).astype("<u4").view(np.int32)), pa.list_(pa.int32())),
                ],
                ["doc_id", "text_hash", "node", "n", "odd", "sketches", "kmers"],
            )

    hashed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return hashed.mapInArrow(bounded(run), "doc_id long, text_hash long, node long, n int, odd array<long>, sketches array<long>, kmers array<int>")


def _possible(l: str, r: str) -> Column:
    """Whether two nodes can be at the threshold: by their lengths, and by a lower bound on the k-mers that only one has.

    At 0.8 two texts of n and m k-mers differ in (n + m) / 9 at most, and each bit in which their parities differ takes
    a k-mer of its own.
    """
    apart = sum(F.bit_count(F.col(f"odd_{l}")[k].bitwiseXOR(F.col(f"odd_{r}")[k])) for k in range(PARITY_BITS // 64))
    n, m = F.col(f"n_{l}"), F.col(f"n_{r}")
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (9 * apart <= n + m)


def _sided(df: DataFrame, side: str, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{c}_{side}") for c in columns])


def _hub_pairs(shared: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(bucket, node_a, node_b, possible) of (bucket, node, held): every member of a bucket with its hub.

    The hub has the most companions in all its buckets, then the largest hash. A node has a bucket for each sketch, so
    the window over its rows is small.
    """
    weight = F.sum("held").over(Window.partitionBy("node")).alias("weight")
    # written, so that the joins read both sides through plain shuffles and hot buckets can be split
    members = scratch.write(shared.join(nodes.select("node", "n", "odd"), "node").select("bucket", "node", "n", "odd", weight), "members")
    rank = F.struct("weight", F.xxhash64("node", "bucket"), "node", "n", "odd")
    hubs = members.groupBy("bucket").agg(F.max(rank).alias("hub"))
    hubs = scratch.write(hubs.select("bucket", *[F.col(f"hub.{c}").alias(f"{c}_b") for c in ("node", "n", "odd")]), "hubs")
    met = _sided(members, "a", ["bucket", "node", "n", "odd"]).withColumnRenamed("bucket_a", "bucket").join(hubs, "bucket").filter("node_a <> node_b")
    return met.select("bucket", F.least("node_a", "node_b").alias("node_a"), F.greatest("node_a", "node_b").alias("node_b"), _possible("a", "b").alias("possible"))


def _aligned(pairs: DataFrame, spelled: DataFrame) -> DataFrame:
    """The pairs (node_a, node_b) at the threshold, with their similarity."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            sides = []
            for column in (batch.column(2), batch.column(3)):
                values, edges = column.flatten().to_numpy(), column.offsets.to_numpy()
                edges = edges - edges[0]
                sides.append([values[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)])
            similar = np.array([alignment_similarity(x, y) for x, y in zip(*sides, strict=True)])
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(similar, pa.float64())], ["node_a", "node_b", "similarity"])
            yield out.filter(pa.array(similar >= THRESHOLD))

    a, b = (_sided(spelled, x, ["node", "kmers"]) for x in ("a", "b"))
    both = pairs.select("node_a", "node_b").join(a, "node_a").join(b, "node_b").select("node_a", "node_b", "kmers_a", "kmers_b")
    return both.mapInArrow(bounded(compare), "node_a long, node_b long, similarity double")


def _open_pairs(labels: DataFrame, spelled: DataFrame, common: int, scratch: Scratch) -> DataFrame:
    """Pairs (node_a, node_b) of ``labels`` (node, n, odd, label); linked, they join all classes that hold a pair at the threshold.

    Prefix filter: in one order of all k-mers, the rarest among these nodes first, two texts at 0.8 share a k-mer among
    the first n - ceil(0.8 n) + 1 of both. A k-mer that at most ``common`` nodes hold pairs its nodes directly. A text
    with other k-mers in its prefix is also paired by all its rarer ones, so a pair that is still open shares only
    common k-mers. Of the texts with one sequence of common k-mers the shortest stands for all: if x and y are at 0.8 by
    common k-mers alone, so are x and the shortest of y's, y and the shortest of x's, and these two. Within a k-mer only
    pairs outside its largest class are formed, and only those that their lengths, their parities and the number of
    their shared k-mers allow; these tests are part of the join.
    """
    each = scratch.write(spelled.join(labels.select("node"), "node").select("node", F.posexplode("kmers").alias("at", "kmer")), "open")
    held = each.groupBy("kmer").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    own = each.join(held, "kmer").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("held", "kmer", "at"))).alias("all"))
    own = own.join(labels, "node").withColumn("shared", F.size("all"))
    # k-mers that no other node holds come first in the prefix
    own = own.withColumn("take", F.expr("shared - (4 * n + 4) div 5 + 1").cast("int")).filter("take > 0").withColumn("prefix", F.slice("all", 1, F.col("take")))
    frequent = F.filter("prefix", lambda x: x["held"] > common)
    rare = F.filter(F.when(F.size(frequent) > 0, F.col("all")).otherwise(F.col("prefix")), lambda x: x["held"] <= common)
    in_order = F.array_sort(F.transform(F.filter("all", lambda x: x["held"] > common), lambda x: F.struct(x["at"], x["kmer"])))
    sequence = F.xxhash64(F.transform(in_order, lambda x: x["kmer"])).alias("sequence")
    carried = ["node", "n", "odd", "shared", "label"]
    placed = scratch.write(own.select(*carried, rare["kmer"].alias("rare"), frequent["kmer"].alias("frequent"), sequence), "prefixes")

    def paired(left: DataFrame, right: DataFrame, once: bool = False) -> DataFrame:
        a, b = (side.select("kmer", *[F.col(c).alias(f"{c}_{x}") for c in carried]) for side, x in ((left, "l"), (right, "r")))
        enough = F.expr("9 * least(shared_l, shared_r) >= 4 * (n_l + n_r)")
        apart = F.expr("label_l <> label_r AND node_l < node_r") if once else F.expr("label_l <> label_r")
        near = a.join(b, (a["kmer"] == b["kmer"]) & apart & enough & _possible("l", "r"))
        return near.select(F.least("node_l", "node_r").alias("node_a"), F.greatest("node_l", "node_r").alias("node_b"))

    by_rare = placed.select(*carried, F.explode("rare").alias("kmer"))
    of_each = placed.filter(F.size("frequent") > 0).select(*carried, "sequence", F.explode("frequent").alias("kmer"))
    sizes = of_each.groupBy("kmer", "label").agg(F.count(F.lit(1)).alias("size"))
    largest = sizes.groupBy("kmer").agg(F.max(F.struct("size", "label"))["label"].alias("largest"))
    by_frequent = scratch.write(of_each.join(largest, "kmer"), "frequent")
    shortest = by_frequent.groupBy("sequence").agg(F.min(F.struct("n", "node"))["node"].alias("node")).select("node")
    standing = scratch.write(by_frequent.join(shortest, "node", "left_semi"), "standing")
    outside = "label <> largest"
    found = (
        paired(by_rare, by_rare, once=True)
        .unionByName(paired(by_frequent.filter(outside), standing))
        .unionByName(paired(by_frequent, standing.filter(outside)))
    )
    return found.distinct()


def _likely(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows whose node may be among ``wanted``, by a bitmap of FILTER_WORDS x 64 bits, so that the others are not shuffled.

    The bitmap is broadcast: its size is fixed. When nodes fill it, it lets all rows pass, and the join decides.
    """
    word = F.pmod("node", F.lit(FILTER_WORDS)).alias("word")
    bit = F.expr(f"shiftleft(1L, cast(pmod(node div {FILTER_WORDS}, 64) AS int))").alias("bit")
    words = wanted.select(word, bit).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    asked = rows.filter("node IS NOT NULL").select("*", word, bit).join(F.broadcast(words), "word")
    return asked.filter("bits & bit <> 0").select(*rows.columns)


def linked_classes(nodes: DataFrame, rows: DataFrame, scratch: Scratch, common: int = COMMON_KMER) -> DataFrame:
    """The class (node, label) of every node with a verified link; ``nodes`` and ``rows`` (node, kmers) are written tables."""
    banded = nodes.select("node", F.explode("sketches").alias("bucket"))
    sizes = scratch.write(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("held")).filter("held > 1"), "buckets")
    shared = scratch.write(banded.join(sizes, "bucket"), "shared")
    compared = scratch.write(_hub_pairs(shared, nodes, scratch), "compared")
    companions = shared.select("node").distinct()
    spelled = _likely(rows.select("node", "kmers"), companions).join(companions, "node").groupBy("node").agg(F.first("kmers").alias("kmers"))
    spelled = scratch.write(spelled, "kmers")
    links = scratch.write(_aligned(compared.filter("possible").select("node_a", "node_b").distinct(), spelled), "links")
    classes = components(links.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")), scratch)

    contested = compared.join(links, ["node_a", "node_b"], "left_anti").select("bucket").distinct()
    base = shared.join(contested, "bucket", "left_semi").select("node").distinct()
    labels = base.join(nodes.select("node", "n", "odd"), "node").join(classes, "node", "left").withColumn("label", F.coalesce("label", "node"))
    labels = scratch.write(labels, "open-labels")
    if not labels.limit(1).count():
        return classes
    open_ = scratch.write(_open_pairs(labels, spelled, common, scratch), "open-pairs")
    # a link joins the classes of its ends; every label is a node of its class, so classes of one node are found as well
    a, b = (_sided(labels, x, ["node", "label"]) for x in ("a", "b"))
    between = _aligned(open_, spelled).join(a, "node_a").join(b, "node_b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))
    joined = components(scratch.write(between, "more-links"), scratch).select(F.col("node").alias("label"), F.col("label").alias("merged"))
    known = classes.unionByName(joined.select(F.col("label").alias("node"), "label")).distinct()
    return known.join(joined, "label", "left").select("node", F.coalesce("merged", "label").alias("label"))


def _classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Written (doc_id, text_hash, node) of every row, and (node, class_id, class_size, lead_hash) of every node."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with Scratch(docs.sparkSession, "omh") as scratch:
        rows = scratch.write(sketch_rows(docs), "sketches")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first")
        nodes = rows.filter("node IS NOT NULL").groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "odd", "sketches")], first, F.count(F.lit(1)).alias("copies"))
        nodes = scratch.write(nodes, "nodes")
        labels = linked_classes(nodes, rows, scratch)
        labelled = nodes.select("node", "first", "copies").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        labelled = scratch.write(labelled, "labelled")
        classes = labelled.groupBy("label").agg(F.min("first").alias("lead"), F.sum("copies").alias("class_size"))
        of_node = labelled.join(classes, "label").select("node", F.col("lead.doc_id").alias("class_id"), "class_size", F.col("lead.text_hash").alias("lead_hash"))
        return materialize(rows.select("doc_id", "text_hash", "node"), "omh-rows"), materialize(of_node, "omh-classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id and class_size of every row."""
    rows, of_node = _classes(docs, id_col, text_col)
    found = rows.filter("node IS NOT NULL").join(of_node, "node").select("doc_id", "class_id", "class_size")
    alone = rows.filter("node IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return found.unionByName(alone)


def keep_one_of_each_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of every class, all columns: that of the least id, then of the least hash of the text.

    Rows that repeat the id and the text of a kept row give one row.
    """
    rows, of_node = _classes(docs, id_col, text_col)
    leads = of_node.select(F.col("class_id").alias("_id"), F.col("lead_hash").alias("_hash"))
    alone = rows.filter("node IS NULL").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    kept = leads.unionByName(alone).distinct()
    same = docs[id_col].cast("long").eqNullSafe(kept["_id"]) & (F.xxhash64(docs[text_col].cast("string")) == kept["_hash"])
    return docs.join(kept, same, "left_semi").dropDuplicates([id_col, text_col])
