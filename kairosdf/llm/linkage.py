"""Links from buckets, and connected components, without all pairs of a bucket.

Every member is first compared with one centre, the least member of one of its
buckets that it is likely to be linked with, then, in large buckets that still hold
members of more than one component, with the greatest such member.  Where a
bucket then still holds more than one, members are compared across components:
those of small buckets side by side, as rows sorted by bucket, which give out
likely pairs only, and in large ones the members outside the largest component
with all, in blocks of bounded size, which give out
nothing but links.  A bucket of one large group costs rows in
proportion to its size.  Nothing is capped: every pair of a bucket ends in one
component or is tested.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitmap import possible
from .store import Work

SMALL_BUCKET = 16
#: rows of a block's side; in buckets of more than COPIES * BLOCK rows up to WIDEST times as many, so that a row is copied less
BLOCK, COPIES, WIDEST = 256, 16, 8
SAMPLE, HOT = 20_000, 40
#: buckets are sought in so many rounds, a share of the keys each, so that only one round's shuffle lies on disk
ROUNDS = 4
_MASKS = [0, 0x5DEECE66D5DEECE6, 0x2545F4914F6CDD1D, 0x1B873593CC9E2D51, 0x369DEA0F31A53F85, 0x7F4A7C159E3779B9]


def connected_components(work: Work, edges: DataFrame, tag: str = "cc") -> DataFrame:
    """(id, label) for every end of an edge (a, b); equal labels are connected.

    Each round, every vertex moves to its smallest neighbour in an order that
    changes from round to round, and the graph is drawn anew between the
    vertices that are left; a constant share goes each round, so a chain of n
    takes O(log n) rounds.
    """
    here = work.table(f"{tag}-e0", edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels, n = None, 0
    while labels is None or not here.isEmpty():
        mask = F.lit(_MASKS[n % len(_MASKS)])
        both = here.select("a", "b").union(here.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # the smallest of the vertex and its neighbours, in the round's order
        move = both.groupBy("a").agg(F.min(F.col("b").bitwiseXOR(mask)).alias("m"))
        move = work.table(f"{tag}-m{n}", move.select("a", F.least("m", F.col("a").bitwiseXOR(mask)).bitwiseXOR(mask).alias("to")))
        if labels is None:
            labels = move.select(F.col("a").alias("id"), F.col("to").alias("label"))
        else:
            next_ = labels.join(move.withColumnRenamed("a", "label"), "label", "left").select("id", F.coalesce("to", "label").alias("label"))
            labels = work.table(f"{tag}-l{n}", next_)
            work.drop(f"{tag}-l{n - 1}", *([f"{tag}-m0"] if n == 1 else []))
        x, y = move.select("a", F.col("to").alias("x")), move.select(F.col("a").alias("b"), F.col("to").alias("y"))
        left = here.join(x, "a").join(y, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        here = work.table(f"{tag}-e{n + 1}", left)
        work.drop(f"{tag}-e{n}", *([f"{tag}-m{n}"] if n else []))
        n += 1
    work.drop(f"{tag}-e{n}")
    return labels


def _sides(df: DataFrame, suffix: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(c + suffix) for c in df.columns])


def in_blocks(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two sides to join on bucket, ra and rb: the members outside their bucket's largest component,
    and all of them.  A block's side has about n / COPIES rows, at least BLOCK and at most BLOCK * WIDEST:
    n members, m of them outside, make n + COPIES * m rows and more, and in buckets of more than
    COPIES * BLOCK * WIDEST members n + 2 * n * m / (BLOCK * WIDEST).

    members: (bucket, id, label, ...); of components of one size the least label's is the largest.
    """
    rows = _ranked(members)
    return _few(rows), _many(rows)


def _ranked(members: DataFrame) -> DataFrame:
    """members with their bucket's largest component, main, and how many blocks its members outside and all of them make."""
    sizes = members.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("bucket").agg(F.max(F.struct(F.col("n"), (-F.col("label")).alias("label"))).alias("top"), F.sum("n").alias("n"))
    side = F.least(F.greatest(F.ceil(F.col("n") / COPIES), F.lit(BLOCK)), F.lit(BLOCK * WIDEST))
    blocks = lambda n: F.greatest(F.ceil(n / side), F.lit(1)).cast("int")
    largest = largest.select("bucket", (-F.col("top.label")).alias("main"), blocks(F.col("n") - F.col("top.n")).alias("outside"), blocks(F.col("n")).alias("all"))
    return members.join(largest, "bucket")


def _place(n: str, salt: int):
    return F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")


def _every(n: str):
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def _few(rows: DataFrame) -> DataFrame:
    return rows.where("label <> main").withColumn("ra", _place("outside", 1)).withColumn("rb", _every("all")).drop("outside", "all")


def _many(rows: DataFrame) -> DataFrame:
    # a pair of two members outside would meet twice, and is tested where its smaller id is on the left
    return rows.withColumn("rb", _place("all", 2)).withColumn("ra", _every("outside")).drop("outside", "all")


Columns = dict[str, pa.Array]
Test = Callable[[Columns, Columns], np.ndarray]


def _passing(pairs: DataFrame, test: Test) -> DataFrame:
    """(id_a, id_b) of the pairs whose columns, with suffixes _a and _b, pass a test row by row."""
    names = [c[:-2] for c in pairs.columns if c.endswith("_a")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ({c: batch.column(c + suffix) for c in names} for suffix in ("_a", "_b"))
            keep = pa.array(test(x, y))
            yield pa.RecordBatch.from_arrays([x["id"].filter(keep), y["id"].filter(keep)], names=["id_a", "id_b"])

    return pairs.mapInArrow(run, "id_a long, id_b long")


def _block_pairs(few: pa.Table, many: pa.Table, likely: Test) -> tuple[np.ndarray, np.ndarray]:
    """Places in few and many of the pairs to test: of two components, likely, and each pair once."""
    strips = [_strip_pairs(few.slice(at, BLOCK), many, likely) for at in range(0, few.num_rows, BLOCK)]
    return np.concatenate([i + BLOCK * k for k, (i, _) in enumerate(strips)]), np.concatenate([j for _, j in strips])


def _strip_pairs(few: pa.Table, many: pa.Table, likely: Test) -> tuple[np.ndarray, np.ndarray]:
    a, b = ({c: t[c].combine_chunks() for c in t.column_names} for t in (few, many))
    label_a, label_b, id_a, id_b = (x.to_numpy() for x in (a["label"], b["label"], a["id"], b["id"]))
    once = (label_b == b["main"].to_numpy())[None, :] | (id_a[:, None] < id_b[None, :])
    i, j = np.nonzero(once & (label_a[:, None] != label_b[None, :]))
    if "buckets" in a and len(i):
        # a pair that meets in several buckets is tested in the first; lists of another kind are, to be safe, tested everywhere
        own, other = _padded(a["buckets"]), _padded(b["buckets"])
        width, here = min(own.shape[1], other.shape[1]), few["bucket"][0].as_py()
        for at in range(0, len(i), 1 << 16):
            part = slice(at, at + (1 << 16))
            x = own[i[part], :width]
            same = (x == other[j[part], :width]) & (x != -1)
            first = x[np.arange(len(x)), same.argmax(1)]
            j[part][same.any(1) & (first != here)] = -1
        i, j = i[j >= 0], j[j >= 0]
    keep = np.zeros(len(i), bool)
    for at in range(0, len(i), 1 << 16):
        x, y = (pa.array(k[at : at + (1 << 16)]) for k in (i, j))
        keep[at : at + (1 << 16)] = likely({c: v.take(x) for c, v in a.items() if c not in _OWN}, {c: v.take(y) for c, v in b.items() if c not in _OWN})
    return i[keep], j[keep]


_OWN = ("bucket", "ra", "rb", "main", "label", "buckets")


def _padded(column: pa.Array) -> np.ndarray:
    """A column of lists as a matrix, short ones filled up with -1."""
    sizes = column.value_lengths().to_numpy()
    out = np.full((len(sizes), int(sizes.max(initial=0))), -1, np.int64)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = column.flatten().to_numpy()
    return out


def _with_partner(likely: Test):
    """A cogrouped function: (bucket, ra, rb, few, id) of the members of a block that have a pair to test there."""

    def run(few: pa.Table, many: pa.Table) -> pa.Table:
        i, j = _block_pairs(few, many, likely) if few.num_rows and many.num_rows else (np.empty(0, np.int64),) * 2
        rows = [few["id"].to_numpy()[np.unique(i)], many["id"].to_numpy()[np.unique(j)]] if len(i) else [np.empty(0, np.int64)] * 2
        n = len(rows[0]) + len(rows[1])
        key = [np.full(n, few[c][0].as_py() if n else 0) for c in ("bucket", "ra", "rb")]
        columns = [pa.array(key[0], pa.int64()), pa.array(key[1], pa.int32()), pa.array(key[2], pa.int32()), pa.array(np.arange(n) < len(rows[0])), pa.array(np.concatenate(rows), pa.int64())]
        return pa.table(columns, names=["bucket", "ra", "rb", "few", "id"])

    return run


def _block_links(likely: Test, match: Test, facts: list[str], payload: list[str]):
    """A cogrouped function: (a, b), links between components of a block, enough to connect all that are connected.

    Pairs of one couple of components are tested in growing portions until one links.
    """

    def run(few: pa.Table, many: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64),) * 2]
        if few.num_rows and many.num_rows:
            keys = [*_OWN, "id", *facts]
            i, j = _block_pairs(few.select([c for c in keys if c in few.column_names]), many.select([c for c in keys if c in many.column_names]), likely)
            a, b = ({c: t[c].combine_chunks() for c in ("id", "label", *payload)} for t in (few, many))
            names, flat = np.unique(np.concatenate((a["label"].to_numpy()[i], b["label"].to_numpy()[j])), return_inverse=True)
            parent, portion = np.arange(len(names)), 1
            u, v = flat[: len(i)], flat[len(i) :]
            while len(i):
                while (parent[parent] != parent).any():
                    parent = parent[parent]
                u, v = parent[u], parent[v]
                apart = u != v
                i, j, u, v = i[apart], j[apart], u[apart], v[apart]
                lo, hi = np.minimum(u, v), np.maximum(u, v)
                order = np.lexsort((hi, lo))
                i, j, u, v, couple = i[order], j[order], u[order], v[order], (lo * len(names) + hi)[order]
                first = np.searchsorted(couple, couple)
                now = np.arange(len(i)) - first < portion
                x, y = pa.array(i[now]), pa.array(j[now])
                linked = match({c: w.take(x) for c, w in a.items()}, {c: w.take(y) for c, w in b.items()}) if len(x) else np.zeros(0, bool)
                out.append((a["id"].to_numpy()[i[now][linked]], b["id"].to_numpy()[j[now][linked]]))
                for p, q in zip(u[now][linked], v[now][linked], strict=True):
                    while parent[p] != p:
                        p = parent[p]
                    while parent[q] != q:
                        q = parent[q]
                    parent[max(p, q)] = min(p, q)
                i, j, u, v = i[~now], j[~now], u[~now], v[~now]
                portion *= 4
        a, b = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _likely_pairs(likely: Test, facts: list[str]):
    """Of rows (bucket, label, id, facts) sorted by bucket: (id_a, id_b) of the likely pairs within a bucket and across
    components, each once a bucket; holds back the rows of the last bucket.  Buckets have SMALL_BUCKET rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch]).combine_chunks()
            bucket = rows["bucket"].to_numpy()
            whole = int(np.searchsorted(bucket, bucket[-1])) if len(bucket) else 0
            held = rows.slice(whole)
            yield _side_by_side(rows.slice(0, whole), likely, facts)
        if held is not None:
            yield _side_by_side(held, likely, facts)

    return run


def _side_by_side(rows: pa.Table, likely: Test, facts: list[str]) -> pa.RecordBatch:
    columns = {c: rows[c].combine_chunks() for c in ("id", *facts)}
    bucket, label, own = (rows[c].to_numpy() for c in ("bucket", "label", "id"))
    out = [(np.empty(0, np.int64),) * 2]
    for step in range(1, len(bucket)):
        near = bucket[step:] == bucket[:-step]
        if not near.any():
            break
        i = np.flatnonzero(near & (label[step:] != label[:-step]))
        x, y = (pa.array(k) for k in (i, i + step))
        i = i[likely({c: v.take(x) for c, v in columns.items()}, {c: v.take(y) for c, v in columns.items()})] if len(i) else i
        out.append((np.minimum(own[i], own[i + step]), np.maximum(own[i], own[i + step])))
    pairs = np.unique(np.stack([np.concatenate(x) for x in zip(*out, strict=True)]), axis=1)  # those that meet in several buckets, once
    return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["id_a", "id_b"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by bucket, those with an equal one before or after; holds one row back."""
    last = None
    for batch in batches:
        bucket, own = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        if last is not None:
            bucket, own = np.append(last[0], bucket), np.append(last[1], own)
        if not len(bucket):
            continue
        equal, keep = bucket[1:] == bucket[:-1], np.zeros(len(bucket), bool)
        keep[1:] |= equal
        keep[:-1] |= equal
        keep[0] |= last is not None and last[2]
        last = bucket[-1], own[-1], keep[-1]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[:-1][keep[:-1]]), pa.array(own[:-1][keep[:-1]])], names=["bucket", "id"])
    if last is not None and last[2]:
        yield pa.RecordBatch.from_arrays([pa.array([last[0]]), pa.array([last[1]])], names=["bucket", "id"])


def hot_buckets(keyed: DataFrame, n: int) -> list[int]:
    """Those that a sample of about SAMPLE of n rows shows HOT times; some SAMPLE * buckets / HOT at most."""
    hot = keyed.sample(min(1.0, SAMPLE / max(1, n)), 1).select(F.explode("buckets").alias("bucket"))
    return [r.bucket for r in hot.groupBy("bucket").count().where(f"count >= {HOT}").select("bucket").collect()]


def in_company(keyed: DataFrame, hot: list[int] | None = None, part: int | None = None) -> DataFrame:
    """(bucket, id) for the buckets of (id, buckets) that hold more than one row; of one of ROUNDS parts of the buckets, if it is given.

    Rows are sorted by bucket and compared with their neighbours, so nothing
    is held for the many buckets of one.  A hot bucket is known to have company: its rows, which
    would meet in one task, pass by.  The sample decides on the way only.
    """
    hot = hot_buckets(keyed, keyed.count()) if hot is None else hot
    rows = keyed.select(F.explode("buckets").alias("bucket"), "id")
    if part is not None:
        rows = rows.where(F.pmod("bucket", F.lit(ROUNDS)) == part)
    passing = []
    if hot:
        known = F.broadcast(keyed.sparkSession.createDataFrame([(b,) for b in hot], "bucket long"))
        passing, rows = [rows.join(known, "bucket", "left_semi")], rows.join(known, "bucket", "left_anti")
    met = rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_neighbours, "bucket long, id long")
    return met.union(passing[0]) if passing else met


def linked_components(work: Work, keyed: DataFrame, facts: DataFrame, payload: Callable[[DataFrame], DataFrame], likely: Test, match: Test) -> DataFrame:
    """(id, label) of the ids that have a link.

    keyed: (id, buckets), an array of longs.  facts: (id, ...), cheap columns of every id;
    likely(x, y) is a necessary condition on them and match(x, y) the exact one
    on the columns of payload(ids), a table of (id, ...); both take columns of
    the left and the right of each pair and are true or false for each.
    """
    hot = hot_buckets(keyed, facts.count())
    for part in range(ROUNDS):
        met = work.append("company", in_company(keyed, hot, part))
    sizes = work.table("buckets", met.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("size")))
    members = work.table("members", met.join(sizes, "bucket").select("bucket", "size", "lo", "hi", "id"))
    work.drop("buckets", "company")
    ids = members.select("id").distinct()
    known = work.table("facts", facts.join(ids, "id", "left_semi"))

    def candidates(pairs: DataFrame) -> DataFrame:
        """The likely ones of pairs (id_a, id_b)."""
        return _passing(pairs.join(_sides(known, "_a"), "id_a").join(_sides(known, "_b"), "id_b"), likely)

    def one_each(pairs: DataFrame) -> DataFrame:
        return candidates(pairs.distinct()).groupBy("id_b").agg(F.min("id_a").alias("id_a")).select("id_a", "id_b")

    star = work.table("star", one_each(members.where("id <> lo").select(F.col("lo").alias("id_a"), F.col("id").alias("id_b"))))
    heavy = work.table("payload", payload(ids))

    def verified(pairs: DataFrame) -> DataFrame:
        return _passing(pairs.join(_sides(heavy, "_a"), "id_a").join(_sides(heavy, "_b"), "id_b"), match).toDF("a", "b")

    def mixed(found: DataFrame, name: str) -> DataFrame:
        """Members, with labels, of the buckets that hold more than one component."""
        labelled = work.table(f"{name}-all", members.join(found, "id", "left").withColumn("label", F.coalesce("label", "id")))
        some = labelled.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("bucket")
        out = work.table(name, labelled.join(some, "bucket"))
        work.drop(f"{name}-all")
        return out

    links = work.table("links1", verified(star))
    found = connected_components(work, links, "c1")
    rest = mixed(found, "mixed1").where(F.col("size") > SMALL_BUCKET)  # a small one's pairs are all tested below
    tops = rest.where("id = hi").select("bucket", F.col("label").alias("top"))
    star2 = rest.join(tops, "bucket").where("id <> hi and label <> top").select(F.col("hi").alias("id_a"), F.col("id").alias("id_b"))
    star2 = work.table("star2", one_each(star2))
    links2 = work.table("links2", verified(star2))
    work.drop("mixed1")
    links = links.union(links2)
    if not links2.isEmpty():
        found = connected_components(work, links, "c2")
    rest = mixed(found, "mixed2")
    work.drop("members")

    small = rest.where(F.col("size") <= SMALL_BUCKET).select("bucket", "id", "label")
    beside = small.join(known, "id").repartition("bucket").sortWithinPartitions("bucket")
    pairs = beside.mapInArrow(_likely_pairs(likely, [c for c in known.columns if c != "id"]), "id_a long, id_b long").distinct()
    tried = star.union(star2).select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    more = verified(work.table("pairs", pairs.join(tried, ["id_a", "id_b"], "left_anti")))

    large = rest.where(F.col("size") > SMALL_BUCKET).select("bucket", "id", "label")
    if not large.isEmpty():
        # facts and lists are fetched once an id, not once a member, and the members with them written once; blocks are made as they are
        # read.  A pair to test meets in buckets of `rest` only, so other keys, which would be copied with each row, are blanked
        wide = rest.join(large.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.collect_set("bucket").alias("own"))
        wide = work.table("wide", wide)
        both = possible(keyed.select("id", "buckets"), [F.col("id")], wide.select("id")).join(known, "id").join(wide, "id")
        both = both.withColumn("buckets", F.transform("buckets", lambda b: F.when(F.array_contains("own", b), b).otherwise(F.lit(-1).cast("long"))))
        large = work.table("large", _ranked(large.join(work.table("both", both.drop("own")), "id")))
        keys, own = ["bucket", "ra", "rb"], [c for c in known.columns if c != "id"]
        few, many = _few(large), _many(work.spark.read.schema(large.schema).parquet(work.paths["large"]))  # the two sides mustn't share columns
        alive = few.groupBy(*keys).cogroup(many.groupBy(*keys)).applyInArrow(_with_partner(likely), "bucket long, ra int, rb int, few boolean, id long")
        alive = work.table("alive", alive)
        # only rows with a pair to test bring their payload
        brought = work.table("brought", heavy.join(alive.select("id").distinct(), "id", "left_semi"))
        again = work.spark.read.schema(brought.schema).parquet(work.paths["brought"])
        few = few.join(alive.where("few").drop("few"), [*keys, "id"], "left_semi").join(brought, "id")
        many = many.join(alive.where("not few").drop("few"), [*keys, "id"], "left_semi").join(again, "id")
        body = [c for c in heavy.columns if c != "id"]
        more = more.union(few.groupBy(*keys).cogroup(many.groupBy(*keys)).applyInArrow(_block_links(likely, match, own, body), "a long, b long"))
    more = work.table("links3", more)
    work.drop("mixed2", "payload", "pairs", "facts", "star", "star2", "wide", "both", "large", "alive", "brought")
    if more.isEmpty():
        return found
    return connected_components(work, links.union(more), "c3")
