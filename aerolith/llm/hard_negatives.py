"""Operator 13: hard negatives by lists that clusters of anchors share, sorted by an angular upper bound.

Anchors are clustered by direction. The inner product of an anchor u and a row i is at most |u| |i| cos(angle(i, c) - b), where c is
the centre of u's cluster and b the largest angle of any member to c. So all rows are put in the order of that bound once for each
cluster, and every member walks the one list: as soon as the bound, times its own length, is below all that it still looks for, the rest
of the list can't matter. Members look for their positives first (their k best rows of the same label), then, for each positive, for the k best
rows of other labels whose score is between `share` percent of the positive's score and that score.

A list is a sequence of pages of about `page` rows: bounds are counted in bins, and a bin's place in the list follows from the bins before
it; bins that hold more than a page (copies of one vector) are spread over several by hash. Members meet the first
pages, which gives each its own threshold; then the groups of members meet the pages up to the last that one of them still needs.
Pages no group needs are never shipped. Nothing grows with a list but the number of its pages. Lists for positives hold one class of labels each.

Centres are fitted on at most `sample` anchors; the angles, the lists and the walk cover all rows, so results are exact whatever the centres.
On vectors without structure bounds tell little: then most pages are met, and the work is the product of anchors and rows.

Components are floor(scale * x), scores are exact integers. Defined results: rows without id, label or vector, or with a null or non-finite component,
take no part; shorter vectors count as padded with zeros; rows that repeat id, label and vector count once; a row is never its own partner,
by id; ties go to the smaller id; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerolith.llm.shared import ceil_div, discard, written
from aerolith.llm.topk import components, exact, matrix

#: Candidates evaluated between two looks at the thresholds.
STEP = 512
#: Classes of labels that have lists of their own, and bins of bounds.
CLASSES, BINS = 16, 256
LEAST, MOST = -(1 << 62), 1 << 62
FOUND = "anchor_id long, akey long, place int, vec_id long, score long"
SCHEMA = pa.schema([("anchor_id", pa.int64()), ("akey", pa.int64()), ("place", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])


def centres_of(v: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Unit centres of a spherical k-means; the start takes the row least like those taken before."""
    unit = v / np.maximum(np.sqrt((v * v).sum(axis=1)), 1e-30)[:, None]
    centres = unit[:1]
    while len(centres) < k:
        centres = np.vstack((centres, unit[(unit @ centres.T).max(axis=1).argmin()][None]))
    for _ in range(rounds):
        at = (unit @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, unit)
        length = np.sqrt((sums * sums).sum(axis=1))
        centres = np.where(length[:, None] > 0, sums / np.maximum(length, 1e-30)[:, None], centres)
    return centres


def angles(v: np.ndarray, norms: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(v @ centres.T / np.maximum(norms, 1e-30)[:, None], -1, 1))


def walk(ids: np.ndarray, labels: np.ndarray, v: np.ndarray, norms: np.ndarray, floor: np.ndarray, high: np.ndarray, c_ids: np.ndarray, c_labels: np.ndarray, c: np.ndarray, bound: np.ndarray, k: int, same: bool, slack: np.ndarray) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """(scores, ids) of the k best candidates for each member and each of its ranges floor..high; members stop where the bound does."""
    floor, order = floor.copy(), np.lexsort((c_ids, -bound))
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    found = [[none] * floor.shape[1] for _ in ids]
    for at in range(0, len(order), STEP):
        take = order[at : at + STEP]
        live = np.flatnonzero(((norms * bound[take[0]] + slack)[:, None] >= floor).any(axis=1))
        if not len(live):
            break
        take = take[np.argsort(c_ids[take], kind="stable")]
        scores = exact(v[live], c[take])
        fits = ((c_labels[take] == labels[live][:, None]) == same) & (c_ids[take] != ids[live][:, None])
        fits &= (scores >= floor[live].min(axis=1)[:, None]) & (scores <= high[live].max(axis=1)[:, None])
        for r in np.flatnonzero(fits.any(axis=1)):
            i, at_row = live[r], np.flatnonzero(fits[r])
            at_row = at_row[np.argsort(-scores[r, at_row], kind="stable")]
            s, names = scores[r, at_row], c_ids[take[at_row]]
            for j in range(floor.shape[1]):
                start, stop = np.searchsorted(-s, -high[i, j]), np.searchsorted(-s, -floor[i, j], "right")
                if start < stop:
                    old = found[i][j]
                    s2, n2 = np.concatenate((old[0], s[start:stop][:k])), np.concatenate((old[1], names[start:stop][:k]))
                    best = np.lexsort((n2, -s2))[:k]
                    found[i][j] = s2[best], n2[best]
                    if len(best) == k:
                        floor[i, j] = max(floor[i, j], s2[best[-1]])
    return found


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, share: int = 80, scale: int = 256, cluster: int = 256, most_clusters: int = 256, sample: int = 4096, page: int = 2048, first: int = 2, group: int = 512, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the anchors, the rows whose id is divisible by `every`."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), components(vector_col, scale).alias("v")).where("vec_id is not null and label is not null and v is not null")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    points = written(rows.dropDuplicates().withColumn("norm", norm), "points")
    n_anchors, dim, longest = points.agg(F.count_if(F.col("vec_id") % every == 0), F.max(F.size("v")), F.max("norm")).first()
    if not n_anchors:
        discard(points)
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    anchors = points.where(F.col("vec_id") % every == 0)
    fitted = [r[0] for r in anchors.orderBy(F.xxhash64("vec_id", "label", "v"), "vec_id").limit(sample).select("v").collect()]
    fitted = matrix(fitted, dim).astype(float)
    centres = centres_of(fitted, min(ceil_div(n_anchors, cluster), most_clusters, len(fitted)))

    def settled(batches):
        for batch in batches:
            v, norms = matrix(batch["v"], dim).astype(float), batch["norm"].to_numpy()
            far = angles(v, norms, centres)
            at = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32)), pa.array(np.where(norms > 0, far[np.arange(len(at)), at], 0.0))], [*batch.schema.names, "cluster", "angle"])

    members = anchors.mapInArrow(settled, "vec_id long, label long, v array<long>, norm double, cluster int, angle double")
    members = written(members.select(F.col("vec_id").alias("anchor_id"), F.xxhash64("label", "v").alias("akey"), "label", "v", "norm", "cluster", "angle"), "members")
    widest = np.zeros(len(centres))
    for c, angle in members.groupBy("cluster").agg(F.max("angle")).collect():  # a row a cluster
        widest[c] = angle + 1e-7

    def bounded(batches):
        for batch in batches:
            norms = batch["norm"].to_numpy()
            far = angles(matrix(batch["v"], dim).astype(float), norms, centres)
            bounds = norms[:, None] * np.cos(np.maximum(far - widest, 0))
            kept = [batch.column(batch.schema.get_field_index(c)) for c in ("vec_id", "label", "v")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(list(bounds), pa.list_(pa.float64()))], ["vec_id", "label", "v", "bounds"])

    ranked = written(points.mapInArrow(bounded, "vec_id long, label long, v array<long>, bounds array<double>"), "ranked")
    width = 2.0 * longest / BINS or 1.0
    slack = 1e-6 * longest

    def lists(label, cluster):
        return (F.col(cluster) * CLASSES + F.pmod(label, F.lit(CLASSES))).cast("int")

    def met(looking: DataFrame, same: bool, k: int) -> DataFrame:
        """FOUND of members with the ranges they look for (floor, high): their k best candidates of each range."""
        name = (lambda cluster: lists(F.col("label"), cluster)) if same else (lambda cluster: F.col(cluster))
        listed = ranked.select("vec_id", "label", "v", F.posexplode("bounds").alias("c", "bound")).withColumns({"list": name("c"), "bin": F.floor((F.lit(longest) - F.col("bound")) / width).cast("int")})
        bins = listed.groupBy("list", "bin").agg(F.count(F.lit(1)).alias("n"))
        before = Window.partitionBy("list").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        bins = written(bins.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))), "bins")
        paged = listed.join(bins, ["list", "bin"]).withColumn("page", F.floor((F.col("start") + F.pmod(F.xxhash64("vec_id", "v"), F.col("n"))) / page).cast("int")).drop("bin", "n", "start")
        ready = looking.withColumn("list", name("cluster"))
        sizes = ready.groupBy("list").agg(F.count(F.lit(1)).alias("m"))
        ready = written(ready.join(sizes, "list").withColumn("g", F.pmod(F.xxhash64("anchor_id", "akey"), F.ceil(F.col("m") / group)).cast("int")).drop("m"), "ready")

        def meet(left, right):
            if not left.num_rows or not right.num_rows:
                return SCHEMA.empty_table()
            norms = left["norm"].to_numpy()
            member = [left["anchor_id"].to_numpy(), left["label"].to_numpy(), matrix(left["v"], dim), norms, *(np.array(left[c].to_pylist(), np.int64) for c in ("floor", "high"))]
            found = walk(*member, right["vec_id"].to_numpy(), right["label"].to_numpy(), matrix(right["v"], dim), right["bound"].to_numpy(), k, same, norms * slack + 1e-3)
            keys, out = left["akey"].to_numpy(), []
            for i, ranges in enumerate(found):
                for j, (s, names) in enumerate(ranges):
                    out.append((np.full(len(s), member[0][i]), np.full(len(s), keys[i]), np.full(len(s), j, np.int32), names, s.astype(np.int64)))
            return pa.table([np.concatenate(x) for x in zip(*out)], schema=SCHEMA)

        def visited(rows: DataFrame, pages: DataFrame) -> DataFrame:
            """Members (rows) meet the pages (list, g, page) of their groups."""
            keys = ("list", "g", "page")
            named = [F.col(c).alias(c) for c in keys]  # new columns, as both sides come from the same groups
            left = rows.join(pages, ["list", "g"]).select(*named, "anchor_id", "akey", "label", "v", "norm", "floor", "high")
            right = paged.join(pages, ["list", "page"]).select(*named, "vec_id", "label", "v", "bound")
            return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, FOUND)

        last = F.floor((F.col("start") + F.col("n") - 1) / page)
        ends = bins.groupBy("list").agg(F.max(last).alias("end"))
        groups = ready.groupBy("list", "g").agg(F.lit(0).alias("_")).drop("_").join(ends, "list")
        start = groups.select("list", "g", F.explode(F.sequence(F.lit(0), F.least(F.col("end").cast("int"), F.lit(first - 1)))).alias("page"))
        begun = written(visited(ready, start), "begun")
        held = Window.partitionBy("anchor_id", "akey", "place").orderBy(F.desc("score"), "vec_id")
        kth = begun.withColumn("rank", F.row_number().over(held)).where(F.col("rank") == k).groupBy("anchor_id", "akey").agg(F.map_from_entries(F.collect_list(F.struct("place", "score"))).alias("kth"))
        raised = ready.join(kth, ["anchor_id", "akey"], "left").withColumn("floor", F.transform("floor", lambda f, i: F.greatest(f, F.coalesce(F.try_element_at("kth", i), f)))).drop("kth")
        # The bound a range still needs, by the member's length; a range that nothing can meet needs none.
        need = F.array_min(F.transform(F.arrays_zip("floor", "high"), lambda z: F.when(z["floor"] <= z["high"], z["floor"].cast("double"))))
        unit = F.when(F.col("norm") > 0, (need - 1e-3) / F.col("norm") - slack).otherwise(F.lit(float("-inf")))
        raised = written(raised.withColumn("need", F.when(need.isNotNull(), unit)), "raised")
        needs = raised.groupBy("list", "g").agg(F.min("need").alias("need")).where("need is not null")
        reach = needs.join(bins, "list").where(F.lit(longest) - F.col("bin") * F.lit(width) >= F.col("need")).groupBy("list", "g").agg(F.max(last).alias("end"))
        rest = reach.where(F.col("end") >= first).select("list", "g", F.explode(F.sequence(F.lit(first), F.col("end").cast("int"))).alias("page"))
        both = visited(raised.drop("need"), rest).unionByName(begun).withColumn("rank", F.row_number().over(held)).where(F.col("rank") <= k)
        out = written(both, "met")
        discard(bins, ready, begun, raised)
        return out

    one = lambda x: F.array(F.lit(x).cast("long"))
    chosen = met(members.withColumns({"floor": one(LEAST), "high": one(MOST)}), True, positives)
    wanted = chosen.groupBy("anchor_id", "akey").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("best"))
    asked = members.join(wanted, ["anchor_id", "akey"]).withColumn("high", F.transform("best", lambda b: b["score"]))
    # Ranges of all members have one length; a range that is not there is empty.
    padded = lambda values, fill: F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(F.get(values, i), F.lit(fill)))
    lowest = F.transform("high", lambda s: F.ceil((s * share).cast("decimal(38,0)") / 100).cast("long"))
    asked = asked.withColumn("floor", padded(lowest, MOST)).withColumn("high", padded(F.col("high"), LEAST)).drop("best")
    found = met(asked, False, negatives)
    partners = chosen.select("anchor_id", "akey", (F.col("rank") - 1).alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = found.join(partners, ["anchor_id", "akey", "place"])
    out = written(out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "hard_negatives")
    discard(points, members, ranked, chosen, found)
    return out
