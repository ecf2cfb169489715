"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

A document is its set of five-word shingles (words are what white space separates), compared as 64-bit hashes. Documents
with the same set make one class. Each class has a path of DEPTH labels of eight bits, one 64-bit number, in each of
TREES prefix tries.

1. Forest: the distinct paths of each tree are sorted, and each is compared with its neighbours in that order; the longer
   of its two common prefixes is the longest match any other class has with it there. Classes whose longest match is
   shorter than the least depth, at which a pair at the threshold meets in some tree with the target recall, have no
   candidates and are done.
2. Rounds, from DEPTH labels on, STEP labels shorter each down to the least depth: classes of one node (equal tree and prefix) are candidates of
   each other if one of them is still searching. Candidates make clusters, and a cluster's pairs are verified exactly,
   those without a searching class and those that an earlier round compared excepted. A class stops searching as soon as
   the links it has found say that its recall meets the target: each found link of similarity s stands for 1 / P(s) links,
   where P is the chance that a pair meets at this depth, and one link at the threshold is always supposed besides. Classes in dense
   neighbourhoods so keep to long prefixes, the others are shortened to the least depth.
3. Only verified links make the result's components. Candidates that aren't similar can still make clusters large; those of
   more than BLOCK classes are linked again, within nodes, by the share of labels that two classes have in common, before
   they are verified. Pairs at the threshold fall below AGREE with a chance of 1e-9.

A node is its smallest class and a count, found by partial sums before a shuffle, and a tree's node has 256 children at most,
so a third of all rows in one node costs a row a task. A cluster is verified in pairs of blocks of BLOCK classes, each pair on its
own, so no task grows with a cluster; as every link counts, m near copies of each other cost m * m / BLOCK ** 2 such pairs.

Cases: null and empty texts have no shingles, so no links, and are classes of their own; texts of fewer than five words
have one shingle, all their words; a row without doc_id can't be named by a link and is a class of its own, with null
ids; rows that repeat a doc_id and its text count as copies; rows that repeat a doc_id with another text are documents of
their own; an empty table gives an empty result; columns besides doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.llm import shared
from folioflow.llm.components import components

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.9999
TREES, DEPTH, LABEL = 32, 8, 8
#: Labels by which a round's prefixes are shorter than the last one's.
STEP = 2
#: Classes in a block, and rows that are verified in one call, in the mean.
BLOCK, SLOT = 512, 512
#: Of large clusters: nodes of more classes are linked to their smallest class; in others pairs are linked that have a share
#: of labels in common, six standard deviations below the threshold.
NODE, AGREE = 256, 0.65

_ODD = np.array([int.from_bytes(hashlib.sha256(b"fold %d" % k).digest()[:8], "big") | 1 for k in range(WORDS)], np.uint64)
_A = np.array([int.from_bytes(hashlib.sha256(b"a %d" % k).digest()[:4], "big") | 1 for k in range(TREES * DEPTH)], np.uint32)
_B = np.array([int.from_bytes(hashlib.sha256(b"b %d" % k).digest()[:4], "big") for k in range(TREES * DEPTH)], np.uint32)


def meets(similarity, depth: int, trees: int = TREES):
    """The chance that a pair shares a prefix of a depth in some tree."""
    return 1 - (1 - np.asarray(similarity, float) ** depth) ** trees


def least_depth(threshold: float, recall: float = RECALL, depth: int = DEPTH) -> int:
    """The longest prefix at which a pair at the threshold meets with the recall asked for; 1 if none does."""
    while depth > 1 and meets(threshold, depth) < recall:
        depth -= 1
    return depth


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The text's shingles as sorted 64-bit hashes without repeats."""
    found = np.array([xxhash.xxh3_64_intdigest(w) for w in text.split()], np.uint64)
    if not len(found):
        return found
    n = min(words, len(found))
    out = np.zeros(len(found) - n + 1, np.uint64)
    for k in range(n):
        out += found[k : k + len(out)] * _ODD[k]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def set_id(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def paths(hashes: np.ndarray) -> np.ndarray:
    """The path in each tree: eight bits of the smallest of each of TREES * DEPTH hashes over the shingles."""
    low = (hashes ^ (hashes >> np.uint64(31))).astype(np.uint32)
    least = np.full(TREES * DEPTH, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(low), 512):
        x = low[start : start + 512, None] * _A
        x += _B
        np.minimum(least, x.min(axis=0), out=least)
    labels = (least * np.uint32(0x9E3779B1)) >> np.uint32(24)
    return labels.astype(np.uint8).view(">u8").astype(np.uint64).view(np.int64)


def sketched(texts: DataFrame) -> DataFrame:
    """doc_id, set_id (null without shingles), paths of texts (doc_id, text)."""

    def sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets, found = [], []
        for text in shared.raw(batch.column(1)):
            own = shingles(text)
            sets.append(set_id(own) if len(own) else None)
            found.append(paths(own) if len(own) else None)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary()), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "set_id", "paths"])

    return shared.map_arrow(texts, "doc_id long, set_id binary, paths array<long>", sketch)


def prefix(path: Column, depth: int) -> Column:
    return F.shiftrightunsigned(path, LABEL * (DEPTH - depth))


def forest(classes: DataFrame, least: int) -> DataFrame:
    """cls, tree, path, matched: the paths whose longest match in their tree has `least` labels or more.

    Leaves, the distinct paths, are sorted within the nodes of the least depth, whose leaves are 256 ** (DEPTH - least) at most.
    """
    rows = classes.select("cls", F.posexplode("paths").alias("tree", "path"))
    order = Window.partitionBy("tree", "node").orderBy("path")
    leaves = rows.groupBy("tree", "path").agg(F.count("*").alias("n")).withColumn("node", prefix(F.col("path"), least))
    near = [F.coalesce(F.col("path").bitwiseXOR(side("path").over(order)), F.lit(-1)) for side in (F.lag, F.lead)]
    # labels in common with a neighbour, from the number of leading zero bits in which their paths agree
    common = [F.when(x == -1, 0).otherwise(F.floor((64 - F.length(F.bin(x))) / LABEL)) for x in near]
    leaves = leaves.withColumn("matched", F.when(F.col("n") > 1, DEPTH).otherwise(F.greatest(*common)).cast("int")).where(F.col("matched") >= least)
    return rows.hint("merge").join(leaves.select("tree", "path", "matched"), ["tree", "path"])


def candidate_edges(found: DataFrame, searching: DataFrame, depth: int) -> DataFrame:
    """a, b: each class of a node of a depth, of which one is searching, and the node's smallest class."""
    rows = found.where(F.col("matched") >= depth).withColumn("node", prefix(F.col("path"), depth))
    live = rows.join(searching.select("cls").withColumn("live", F.lit(1)), "cls", "left").withColumn("live", F.coalesce("live", F.lit(0)))
    nodes = live.groupBy("tree", "node").agg(F.min("cls").alias("b"), F.max("live").alias("any")).where("any = 1")
    return rows.hint("merge").join(nodes, ["tree", "node"]).where("cls <> b").select(F.col("cls").alias("a"), "b").distinct()


def _agreeing(key: np.ndarray, cls: np.ndarray, labels: np.ndarray) -> list[tuple[int, int]]:
    """In each node (rows of equal key) a forest over the pairs that agree in AGREE of their labels."""
    edges = []
    starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
    for a, b in zip(starts, [*starts[1:], len(cls)], strict=True):
        open_ = np.arange(a, b)
        while len(open_) > 1:
            reached, edge = open_[:1], open_[:1]
            open_ = open_[1:]
            while len(edge) and len(open_):
                same = (labels[edge][:, None] == labels[open_][None]).mean(axis=2) >= AGREE
                hit = same.any(axis=0)
                edges += [(int(cls[x]), int(cls[reached[0]])) for x in open_[hit]]
                edge, open_ = open_[hit], open_[~hit]
    return edges


def agreeing_edges(found: DataFrame, large: DataFrame, classes: DataFrame, depth: int, slots: int) -> DataFrame:
    """a, b: the links of the classes in large (cls), by nodes: to the smallest class, or by the labels in small nodes."""
    rows = found.where(F.col("matched") >= depth).withColumn("node", prefix(F.col("path"), depth)).select("cls", "tree", "node").join(large.select("cls"), "cls", "left_semi")
    nodes = rows.groupBy("tree", "node").agg(F.min("cls").alias("b"), F.count("*").alias("n")).where("n > 1")
    met = shared.scratch(rows.hint("merge").join(nodes, ["tree", "node"]), "large-nodes")
    star = met.where((F.col("n") > NODE) & (F.col("cls") != F.col("b"))).select(F.col("cls").alias("a"), "b")

    def link(table: pa.Table) -> pa.Table:
        table = table.sort_by([("tree", "ascending"), ("node", "ascending"), ("cls", "ascending")])
        key, cls = np.column_stack([table.column(c).to_numpy() for c in ("tree", "node")]), table.column("cls").to_numpy()
        labels = np.array(table.column("paths").to_pylist(), np.int64).view(np.uint8).reshape(len(cls), -1)
        edges = _agreeing(key, cls, labels)
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})

    small = met.where(F.col("n") <= NODE).join(classes.select("cls", "paths"), "cls").withColumn("slot", F.pmod(F.xxhash64("tree", "node"), F.lit(slots)))
    return star.unionByName(small.groupBy("slot").applyInArrow(link, "a long, b long")).distinct()


def clusters_of(edges: DataFrame) -> DataFrame:
    """cls, cluster, size for the classes of edges; the cluster is its smallest class."""
    tree = components(edges)
    members = tree.select(F.col("node").alias("cls"), F.col("root").alias("cluster"))
    members = members.unionByName(tree.select(F.col("root").alias("cls"), F.col("root").alias("cluster")).distinct())
    return members.join(members.groupBy("cluster").agg(F.count("*").alias("size")), "cluster")


def _verify(table: dict[str, np.ndarray], sets: list[np.ndarray], same: bool, limit: Fraction, depth: int) -> dict[str, np.ndarray]:
    """For the classes of a pair of blocks: copies of linked classes, their number, the links they stand for, and the smallest
    class reached over links. With same there is one block and all pairs count, else those between the blocks."""
    n, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    row = np.repeat(np.arange(n), sizes)
    value = np.concatenate(sets)
    order = np.argsort(value, kind="stable")
    value, row = value[order], row[order]
    new = np.r_[True, value[1:] != value[:-1]]
    column = np.cumsum(new) - 1
    kept = np.bincount(column)[column] > 1
    row, column = row[kept], np.unique(column[kept], return_inverse=True)[1]
    common = np.zeros((n, n), np.float32)
    edges = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + 2048, 2048))
    for start, stop in zip(edges[:-1], edges[1:], strict=True):
        if stop > start:
            x = np.zeros((n, 2048), np.float32)
            x[row[start:stop], column[start:stop] % 2048] = 1
            common += x @ x.T
    common = common.astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - common
    near = common * limit.denominator >= union * limit.numerator
    np.fill_diagonal(near, False)
    if not same:
        near &= table["side"][:, None] != table["side"][None, :]
    near &= table["searching"][:, None] | table["searching"][None, :]
    for c in (c for name, c in table.items() if name.startswith("before")):
        near &= (c[:, None] != c[None, :]) | (c[:, None] < 0)
    a, b = np.nonzero(near)
    stand_for = np.bincount(a, 1 / meets(common[a, b] / union[a, b], depth), n).astype(float)
    root = np.arange(n)
    while True:
        # classes are sorted, so the smallest index is the smallest class
        least = np.minimum(root, np.where(near, root[None, :], n).min(axis=1))
        least = least[least]
        if (least == root).all():
            return {"links": near @ table["copies"], "found": near.sum(axis=1), "stand_for": stand_for, "root": table["cls"][root]}
        root = least


VERIFIED = "cls long, links long, found long, stand_for double, root long"


def verified(members: DataFrame, sets: DataFrame, threshold: float, depth: int, slots: int) -> DataFrame:
    """VERIFIED of the rows of members (cls, cluster, copies, searching, before0 ...: earlier rounds' clusters, own, others:
    numbers of blocks of searching and other classes) by pairs of blocks (i, j), of which i is of searching ones."""
    limit, c = Fraction(str(threshold)), F.col
    side = F.when(c("searching"), F.pmod(F.xxhash64("cls"), c("own"))).otherwise(c("own") + F.pmod(F.xxhash64("cls"), F.greatest(c("others"), F.lit(1)))).cast("int")
    last = F.when(c("searching"), c("own") + c("others")).otherwise(c("own")) - 1
    rows = members.join(sets, "cls").withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    rows = rows.withColumns({"i": F.least("side", "other"), "j": F.greatest("side", "other")})
    numbers = ["cls", "side", "copies", "searching", *(x for x in members.columns if x.startswith("before"))]
    rows = rows.select("cluster", "i", "j", *numbers, "shingles", F.pmod(F.xxhash64("cluster", "i", "j"), F.lit(slots)).alias("slot"))

    def check(table: pa.Table) -> pa.Table:
        table = table.sort_by([(x, "ascending") for x in ("cluster", "i", "j", "cls")])
        # a document of an id that repeats with its text comes more than once
        key = np.column_stack([table.column(x).to_numpy() for x in ("cluster", "i", "j", "cls")])
        table = table.filter(pa.array(np.r_[True, (key[1:] != key[:-1]).any(axis=1)]))
        key = np.column_stack([table.column(x).to_numpy() for x in ("cluster", "i", "j")])
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
        values = {x: table.column(x).to_numpy() for x in numbers}
        blobs, out = table.column("shingles").to_pylist(), []
        for a, b in zip(starts, [*starts[1:], len(key)], strict=True):
            own = {x: v[a:b] for x, v in values.items()}
            out.append({"cls": own["cls"], **_verify(own, [np.frombuffer(x, np.uint64) for x in blobs[a:b]], bool(key[a, 1] == key[a, 2]), limit, depth)})
        return pa.table({x: np.concatenate([o[x] for o in out]) for x in (y.split()[0] for y in VERIFIED.split(", "))})

    return rows.groupBy("slot").applyInArrow(check, VERIFIED)


def shingle_sets(texts: DataFrame, chosen: DataFrame) -> DataFrame:
    """cls, shingles of chosen classes (cls, doc_id, set_id), from their first document; the only step that shuffles texts."""
    # by merge at every size: a broadcast of few classes would hide what the shuffle of all texts costs
    rows = texts.hint("merge").join(chosen, "doc_id").select("cls", "set_id", "text")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingles(x) for x in shared.raw(batch.column(2))]
        own = np.array([set_id(x) == s for x, s in zip(found, batch.column(1).to_pylist(), strict=True)], bool)
        return pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(own)), pa.array([x.tobytes() for x, k in zip(found, own, strict=True) if k], pa.binary())], ["cls", "shingles"])

    return shared.map_arrow(rows, "cls long, shingles binary", cut)


def near_dup(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, rep_id (of its class), class_size, class_id, n_links of every row of docs.

    class_id is the smallest doc_id that links lead to; n_links counts the other documents at the threshold or above.
    """
    texts, least = shared.id_and_text(docs), least_depth(threshold, recall)
    found = shared.scratch(sketched(texts), "sketches")
    classes = found.where("set_id is not null and doc_id is not null").groupBy("set_id").agg(F.min(F.struct("doc_id", "paths")).alias("first"), F.count("*").alias("copies"))
    # numbers are made once and written, so they stay
    classes = shared.scratch(classes.select(F.monotonically_increasing_id().alias("cls"), "set_id", F.col("first.doc_id").alias("doc_id"), "copies", F.col("first.paths").alias("paths")), "classes")
    tries = shared.scratch(forest(classes, least), "forest")
    chosen = classes.join(tries.select("cls").distinct(), "cls", "left_semi").select("cls", "doc_id", "set_id")
    sets = shared.scratch(shingle_sets(texts, chosen), "shingles")

    searching, checked, done = chosen, None, []
    for depth in [*range(DEPTH, least, -STEP), least]:
        edges = shared.scratch(candidate_edges(tries, searching, depth), "candidates")
        if edges.isEmpty():
            continue
        members = shared.scratch(clusters_of(edges), "clusters")
        large = members.where(F.col("size") > BLOCK)
        if not large.isEmpty():
            again = clusters_of(agreeing_edges(tries, large, classes, depth, max(1, -(-large.count() // SLOT))))
            members = shared.scratch(members.where(F.col("size") <= BLOCK).unionByName(again), "clusters")
        live = searching.select("cls").withColumn("searching", F.lit(True))
        members = members.join(live, "cls", "left").withColumn("searching", F.coalesce("searching", F.lit(False))).join(classes.select("cls", "copies"), "cls")
        for k, earlier in enumerate(done):
            members = members.join(earlier.withColumnRenamed("cluster", f"before{k}"), "cls", "left").withColumn(f"before{k}", F.coalesce(f"before{k}", F.lit(-1)))
        blocks = lambda own: F.ceil(F.count_if(own) / BLOCK).cast("int")
        sizes = members.groupBy("cluster").agg(blocks(F.col("searching")).alias("own"), blocks(~F.col("searching")).alias("others")).where("own > 0")
        members = shared.scratch(members.drop("size").join(sizes, "cluster"), "members")
        rows = members.agg(F.sum(F.when(F.col("searching"), F.col("own") + F.col("others")).otherwise(F.col("own")))).first()[0] or 0
        new = shared.scratch(verified(members, sets, threshold, depth, max(1, -(-rows // SLOT))), "verified").withColumn("depth", F.lit(depth))
        checked = new if checked is None else checked.unionByName(new)
        # what a link of an earlier, longer prefix stands for at this depth is not more than it was then
        so_far = checked.groupBy("cls").agg(F.sum("found").alias("n"), F.sum("stand_for").alias("total"))
        enough = (1 + F.coalesce("n", F.lit(0))) / (F.lit(float(1 / meets(threshold, depth))) + F.coalesce("total", F.lit(0.0))) >= recall
        searching = shared.scratch(searching.select("cls").join(so_far, "cls", "left").where(~enough).select("cls"), "searching")
        done.append(members.select("cls", "cluster"))
    answer = classes.select("cls", "set_id", "doc_id", "copies")
    if checked is None:
        answer = answer.withColumns({"links": F.lit(0).cast("long"), "class_id": F.col("doc_id")})
    else:
        roots = components(checked.select(F.col("cls").alias("a"), F.col("root").alias("b")))
        links = checked.groupBy("cls").agg(F.sum("links").alias("links"))
        answer = answer.join(links, "cls", "left").join(roots, F.col("cls") == F.col("node"), "left").select("cls", "set_id", "doc_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "cls").alias("root"))
        answer = shared.scratch(answer, "answers")
        smallest = answer.groupBy("root").agg(F.min("doc_id").alias("class_id"))
        answer = answer.join(smallest, "root")
    answer = answer.select("set_id", F.col("doc_id").alias("rep"), "copies", "links", "class_id")
    # repeated copies of a text, however many, are split over tasks by Spark: both sides are shuffled as they are
    out = found.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("set_id")).alias("set_id")).hint("merge").join(answer, "set_id", "left")
    return out.select("doc_id", F.coalesce("rep", "doc_id").alias("rep_id"), F.coalesce("copies", F.lit(1)).alias("class_size"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce(F.col("copies") - 1 + F.col("links"), F.lit(0)).alias("n_links"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup(shared.documents(spark, sf_dir))


def keyed(docs: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """docs with the column key, and the table of keys (id, text_digest, key): a number for each pair of doc_id and text.

    Numbers rise with doc_id, rows without one are last, by the text's digest; null text is empty. They are written before
    they are used, so they stay.
    """
    mark = shared.private(docs, "text_digest")
    own = docs.withColumn(mark, F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)))
    pairs = own.select(F.col("doc_id").cast("long").alias("id"), shared.named(mark).alias("text_digest")).distinct()
    keys = shared.scratch(pairs.orderBy(F.col("id").asc_nulls_last(), "text_digest").withColumn("key", F.monotonically_increasing_id()), "keys")
    rows = own.hint("merge").join(keys, own["doc_id"].cast("long").eqNullSafe(keys["id"]) & (own[mark] == keys["text_digest"]))
    return rows.select(*[own["`" + c.replace("`", "``") + "`"] for c in docs.columns], keys["key"].alias(key)), keys


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class, the one of the smallest doc_id; rows without doc_id are linked as well and come last.

    Rows are known by doc_id and text, as ids may be null or repeat; of rows that repeat both one stays, the same in every run.
    """
    key = shared.private(docs, "key")
    rows, keys = keyed(docs, key)
    rows = shared.scratch(rows, "keyed")
    if rows.count() > keys.count():  # rows that repeat both
        rows = shared.scratch(shared.one_of_each(rows, key), "keyed")
    found = near_dup(rows.select(F.col(key).alias("doc_id"), "text"))
    kept = shared.scratch(found.where("doc_id = class_id").select(F.col("doc_id").alias("kept")), "kept")
    return rows.hint("merge").join(kept, rows[key] == kept["kept"], "left_semi").select(shared.columns(docs))
