"""Operator 5: SimHash near-dedup with a segment-popcount embedding.

A fingerprint is 64 bits; a bit is set if more than half of the 64-bit hashes of a text's word shingles have it set.
Fingerprints link at `radius` or fewer differing bits. They are embedded as the counts of set bits in `segments` equal
segments. A flipped bit moves one count by one, so the Manhattan distance of two embeddings is a lower bound of their
Hamming distance. The range join runs on the grid of embeddings: each fingerprint is put into its own cell and the
cells one step away, so that two within Manhattan distance 2 always meet in a cell. Fingerprints that meet no
other are done.

What is left is verified exactly without listing pairs: two fingerprints differ in at most 2 bits if and only if some
64-bit number differs from either in at most one. Each candidate is put to itself and its 64 one-bit neighbours; those
that meet there are linked to the smallest of them. So rows grow with candidates, never with pairs, in groups of any size.
Components of the links give groups. Copies share a fingerprint and are one node.

Defined results: a text without words has fingerprint zero and is linked like any other; one with fewer than `shingle`
words is one shingle; repeated rows are copies; null ids are kept as rows and never name a component unless all its ids
are null; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.llm.components import components
from aerolith.llm.shared import discard, written

#: Hashes that a worker counts at a time.
AT_ONCE = 1 << 14
#: Members, and shingles of members, of a group that are compared in one block, about.
MEMBERS, ITEMS = 1 << 10, 1 << 20


def fingerprint(text: str | None, shingle: int, seed: int) -> int:
    """The fingerprint of a text, unsigned."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    cuts = map(slice, starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
    n = len(words) - shingle + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, cuts), repeat(seed)), np.uint64, n)
    set_bits = np.zeros(64, np.int64)
    for i in range(0, n, AT_ONCE):
        bits = np.unpackbits(hashes[i : i + AT_ONCE].astype("<u8").view(np.uint8), bitorder="little")
        set_bits += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "doc_id long, fp long")


def base_of(segments: int) -> int:
    """Counts are digits of base 16, or of the least base that 16 segments and more leave room for."""
    return 16 if segments <= 12 else 64 // segments + 1


def own_cell(fp: Column, segments: int) -> Column:
    """The counts of set bits of a fingerprint's segments, as one number."""
    width, base = 64 // segments, base_of(segments)
    counts = [F.bit_count(F.shiftrightunsigned(fp, i * width).bitwiseAND(F.lit((1 << width) - 1))).cast("long") for i in range(segments)]
    own = counts[0]
    for c in counts[1:]:
        own = own * base + c
    return own


def cells(own: Column, segments: int) -> Column:
    """A fingerprint's own cell and the 2 * segments cells one step away; plain sums, which Spark compiles.

    A step over a digit's end may fall on a cell of another count, which costs a false candidate at most.
    """
    steps = [0] + [s * base_of(segments) ** i for i in range(segments) for s in (1, -1)]
    return F.array(*(own + F.lit(s).cast("long") for s in steps))


def near_hubs(fps: DataFrame, segments: int = 32) -> DataFrame:
    """hub, fp, b: the distinct fingerprints fp within one bit of a number hub that more than one is near to, b the least of them."""
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = fps.select("fp").repartition(n, "fp")  # a few small files would else be exploded in as few tasks
    own = spread.select("fp", own_cell(F.col("fp"), segments).alias("own"))
    cell = own.select("fp", F.explode(cells(F.col("own"), segments)).alias("cell")).repartition(n, "cell")  # one exchange for both uses
    met = cell.groupBy("cell").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high").select("cell")
    close = written(cell.join(met.hint("merge"), "cell", "left_semi").select("fp").distinct(), "close")
    flips = [0, *((1 << i) - (1 << 64 if i == 63 else 0) for i in range(64))]
    hubs = close.select("fp", F.explode(F.array(*(F.col("fp").bitwiseXOR(F.lit(m).cast("long")) for m in flips))).alias("hub"))
    least = hubs.groupBy("hub").agg(F.min("fp").alias("b"), F.max("fp").alias("other")).where("b < other").select("hub", "b")
    return hubs.join(least.hint("merge"), "hub")


def near_links(fps: DataFrame, segments: int = 32) -> DataFrame:
    """Links (a, b) among distinct fingerprints fp that join all within two bits, without listing pairs."""
    return near_hubs(fps, segments).where("fp != b").select(F.col("fp").alias("a"), "b").distinct()


def simhash_dedup(docs: DataFrame, shingle: int = 3, seed: int = 42, segments: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id reachable over links."""
    marked = written(fingerprints(docs, shingle, seed, id_col, text_col), "fingerprints")
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    roots = written(components(near_links(distinct.select("fp"), segments)), "roots")
    placed = written(distinct.join(roots.hint("merge"), distinct.fp == roots.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root")), "placed")
    names = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = written(placed.join(names.hint("merge"), "root").select("fp", "component_id"), "named")
    discard(distinct, roots, placed)
    return marked.join(named.hint("merge"), "fp").select("doc_id", "fp", "component_id")


# --- near duplicates by similarity: fingerprints and min-hashes find candidates, shingle sets verify them ----------------


def shingle_hashes(text: str | None, shingle: int, seed: int) -> np.ndarray:
    """Distinct hashes of a text's shingles, sorted; shorter texts are one shingle, without words there is none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(seed)), np.uint64, len(joined)))


def node_of(text: str | None) -> int:
    """One number for texts of equal lower-case words."""
    return xxhash.xxh3_64_intdigest(b" ".join((text or "").encode().lower().split())) - (1 << 63)


def majority(hashes: np.ndarray) -> int:
    """Bits set in more than half of a few hashes, as a signed long."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
    return int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(hashes), bitorder="little").view("<i8")[0])


def sampled_fingerprints(hashes: np.ndarray, views: int, sample: int) -> list[int]:
    """One fingerprint a view: of the `sample` shingles that the view's scramble puts first."""
    out = []
    for view in range(views):
        x = (hashes ^ np.uint64((view + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ x >> np.uint64(32)) * np.uint64(0xC4CEB9FE1A85EC53)
        n = min(sample, len(hashes))
        out.append(majority(hashes[np.argpartition(x, n - 1)[:n]]))
    return out


def links_across(asks: list[tuple[int, int, bytes]], answers: list[tuple[int, int, bytes]], similarity: float) -> list[tuple[int, int]]:
    """Links of (node, root, items) in asks to those in answers; none between rows that share a root or are linked already."""
    codes = np.unique(np.array([r for _, r, _ in asks + answers], np.int64), return_inverse=True)[1]
    label = np.arange(len(asks) + len(answers))
    sets = [np.frombuffer(i, np.uint64) for _, _, i in answers]
    sizes = np.array([len(x) for x in sets], np.int64)
    ends = np.cumsum(sizes)
    values, places = np.unique(np.concatenate(sets), return_inverse=True)
    theirs, out = codes[len(asks) :], []
    for (node, _, items), code in zip(asks, codes):
        if (label[theirs] == label[code]).all():
            continue
        own = np.frombuffer(items, np.uint64)
        seen = np.zeros(len(values), bool)
        seen[np.searchsorted(values, own[np.isin(own, values, assume_unique=True)])] = True
        sums = np.concatenate(([0], np.cumsum(seen[places])))
        both = sums[ends] - sums[ends - sizes]
        for i in np.flatnonzero((both >= similarity * (len(own) + sizes - both)) & (label[theirs] != label[code])).tolist():
            if label[theirs[i]] != label[code]:
                out.append((node, answers[i][0]))
                label[label == label[theirs[i]]] = label[code]
    return out


def links_left(members: DataFrame, roots: DataFrame, items: DataFrame, similarity: float) -> DataFrame:
    """node, head: links among the members (view, fp, node) of each group (view, fp), between those whose roots differ.

    After these, any two members of a group are in one component or have been compared. Members of the group's largest component ask
    nobody, so a group that is nearly one component costs its size. Large groups are dealt in blocks of asking and of answering members.
    """
    rows = members.join(roots, "node", "left").select("view", "fp", "node", F.coalesce("root", "node").alias("root"))
    rows = written(rows.join(items.select("node", (F.length("items") / 8).cast("long").alias("n_items")), "node"), "members")
    part = rows.groupBy("view", "fp", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("n_items").alias("n_items"))
    total = part.groupBy("view", "fp").agg(
        F.count(F.lit(1)).alias("parts"), F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n"), F.sum("n_items").alias("n_items")
    )
    blocks = lambda n: F.greatest(F.ceil(n / MEMBERS), F.ceil(F.col("n_items") / ITEMS))
    undone = total.where("parts > 1").select("view", "fp", "main", blocks(F.col("n") - F.col("n_main")).alias("asking"), blocks(F.col("n")).alias("answering"))
    undone = rows.join(written(undone, "undone"), ["view", "fp"]).withColumn("deal", F.xxhash64("node"))  # written, so that Spark can split a hot group
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod(F.col("deal"), F.col(n))
    key = ["view", "fp", "a", "b"]
    left = undone.where("root != main").select("view", "fp", own("asking").alias("a"), upto("answering").alias("b"), F.lit(True).alias("asks"), "node", "root")
    right = undone.select("view", "fp", upto("asking").alias("a"), own("answering").alias("b"), F.lit(False).alias("asks"), "node", "root")
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = left.unionByName(right).join(items, "node").select(*key, "asks", "node", "root", "items").repartition(n, *key).sortWithinPartitions(*key)

    def compare(batches):
        at, asks, answers = None, [], []
        for batch in batches:
            out = []
            for *where, asking, node, root, found in zip(*(c.to_pylist() for c in batch.columns)):
                if where != at:
                    out += links_across(asks, answers, similarity) if asks and answers else []
                    at, asks, answers = where, [], []
                (asks if asking else answers).append((node, root, found))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["node", "head"])
        out = links_across(asks, answers, similarity) if asks and answers else []
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["node", "head"])

    links = written(dealt.mapInArrow(compare, "node long, head long"), "links-left")
    discard(rows)
    return links


def row_links(rows: DataFrame, shingle: int, similarity: float, views: int, sample: int, segments: int, seed: int) -> DataFrame:
    """row_no, doc_id, keeper (the row_no that stays) and component_id of rows (row_no, doc_id, text).

    Candidates come from the grid of bit counts, over whole fingerprints (near_hubs), and from min-hashing: in each of `views`
    views a text has the hash of its `sample` first shingles in that view's order, and texts of similarity s agree
    in one with a chance of about s ** sample. A group of texts that agree is first paired with its smallest member, and in view
    t also with the smallest that shares view t + 1; these pairs are verified on their shingle sets and linked. Groups that are
    not one component then are done in full (links_left): any two candidates end in one component or have been compared.
    Texts of equal words are one node.
    """

    def describe(batches):
        for batch in batches:
            nodes, whole, seen = [], [], []
            for text in batch.column(2):
                text = text.as_py()
                found = shingle_hashes(text, shingle, seed)
                nodes.append(node_of(text))
                print_ = fingerprint(text, shingle, seed)
                whole.append(print_ - (1 << 64) if print_ >> 63 else print_)
                seen.append(sampled_fingerprints(found, views, sample) if len(found) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(whole, pa.int64()), pa.array(seen, pa.list_(pa.int64()))], ["row_no", "doc_id", "node", "fp", "views"])

    described = written(rows.select("row_no", "doc_id", "text").mapInArrow(describe, "row_no long, doc_id long, node long, fp long, views array<long>"), "described")
    first_row = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_no"))  # rows with an id come before those without
    nodes = described.groupBy("node").agg(first_row.alias("least"), F.min("fp").alias("fp"), F.min("views").alias("views"))
    nodes = written(nodes, "nodes")
    node = F.struct("least", "node")
    views_of = nodes.where("size(views) > 0").select("node", "least", F.posexplode("views").alias("view", "fp"), "views")
    placed = written(views_of.select("node", "least", "view", "fp", F.col("views")[F.pmod(F.col("view") + 1, F.lit(views))].alias("next")), "placed")
    pairs, done = None, []
    for key in (["view", "fp"], ["view", "fp", "next"]):
        heads = placed.groupBy(*key).agg(F.min(node).alias("head"), F.max(node).alias("last")).where("head < last").select(*key, F.col("head.node").alias("head"))
        heads = written(heads, "heads")  # so that Spark can split a group of very many members
        found = written(placed.join(heads, key).where("node != head").select("view", "fp", "node", "head"), "met")
        done += [heads, found]
        if pairs is None:
            met = found  # all but the head of each group
        pairs = found.select("node", "head") if pairs is None else pairs.unionByName(found.select("node", "head"))
    first = written(nodes.groupBy("fp").agg(F.min(node).alias("head"), F.count(F.lit(1)).alias("n")).select("fp", F.col("head.node").alias("head"), "n"), "first")
    hubs = written(near_hubs(first.select("fp"), segments), "hubs")
    close = hubs.where("fp != b").select(F.col("fp").alias("a"), "b").distinct()
    same = nodes.select("fp", "node").join(first.where("n > 1"), "fp").where("node != head").select("fp", "node", "head")
    around = nodes.select("fp", "node").join(hubs.select("fp", "hub"), "fp").select(F.lit(-2).alias("view"), F.col("hub").alias("fp"), "node")
    members = met.select("view", "fp", "node").unionByName(same.select(F.lit(-1).alias("view"), "fp", "node")).unionByName(around)
    x, y = first.select(F.col("fp").alias("a"), F.col("head").alias("x")), first.select(F.col("fp").alias("b"), F.col("head").alias("y"))
    linked = close.join(x, "a").join(y, "b").select(F.col("x").alias("node"), F.col("y").alias("head"))
    pairs = written(pairs.unionByName(same.select("node", "head")).unionByName(linked).select(F.greatest("node", "head").alias("node"), F.least("node", "head").alias("head")).distinct(), "pairs")
    discard(placed)

    def sets(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_hashes(t.as_py(), shingle, seed).tobytes() for t in batch.column(1)], pa.binary())], ["node", "items"])

    # The text of the first row of each node that has a candidate.
    asked = pairs.select("node").unionByName(pairs.select(F.col("head").alias("node"))).unionByName(around.select("node")).distinct()
    chosen = nodes.join(asked, "node", "left_semi").select("node", F.col("least.row_no").alias("row_no"))
    items = written(rows.join(chosen.hint("shuffle_hash"), "row_no").select("node", "text").mapInArrow(sets, "node long, items binary"), "items")

    def verify(batches):
        for batch in batches:
            good = []
            for a, b in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= similarity * (len(x) + len(y) - both))
            yield batch.select(["node", "head"]).filter(pa.array(good, pa.bool_()))

    sized = pairs.join(items, "node").join(items.select(F.col("node").alias("head"), F.col("items").alias("others")), "head").select("node", "head", "items", "others")
    links = written(sized.mapInArrow(verify, "node long, head long"), "verified")
    roots = written(components(links.select(F.col("node").alias("a"), F.col("head").alias("b"))), "roots")
    left = links_left(members, roots, items, similarity)
    if not left.isEmpty():
        before = roots
        roots = written(components(before.unionByName(left.select("node", F.col("head").alias("root"))).select(F.col("node").alias("a"), F.col("root").alias("b"))), "roots")
        discard(before)
    grouped = written(nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")), "grouped")
    names = written(grouped.groupBy("root").agg(F.min("least").alias("least")), "names")
    named = written(grouped.join(names.select("root", F.col("least.row_no").alias("keeper"), F.col("least.doc_id").alias("component_id")), "root").select("node", "keeper", "component_id"), "named")
    discard(nodes, first, hubs, pairs, items, links, left, roots, grouped, names, *done)
    return described.select("row_no", "doc_id", "node").join(named, "node").select("row_no", "doc_id", "keeper", "component_id")


def numbered(docs: DataFrame) -> DataFrame:
    """docs written with a number for each row, as its only sure name: ids may be missing or repeated."""
    return written(docs.select(F.monotonically_increasing_id().alias("row_no"), F.struct(*docs.columns).alias("row")), "numbered")


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, views: int = 12, sample: int = 3, segments: int = 32, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id of every row: components of links whose shingle sets have at least this Jaccard similarity.

    component_id is the smallest id of the component, null where none of its rows has an id.
    """
    rows = numbered(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).select("row_no", "row.*")
    return row_links(rows, shingle, similarity, views, sample, segments, seed).select("doc_id", "component_id")


def without_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, views: int = 12, sample: int = 3, segments: int = 32, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group: that of the smallest id, before rows without one.

    Rows are told apart by number, so rows that share an id but not a text stay, and of rows that repeat an id and text, or have no
    id, one stays. Texts without words are alike. Columns of any name are kept as they are.
    """
    table = numbered(docs)
    rows = table.select("row_no", F.col(f"row.{id_col}").cast("long").alias("doc_id"), F.col(f"row.{text_col}").alias("text"))
    found = row_links(rows, shingle, similarity, views, sample, segments, seed)
    goes = written(found.where("row_no != keeper").select("row_no"), "goes")
    return table.join(goes.hint("shuffle_hash"), "row_no", "left_anti").select("row.*")
