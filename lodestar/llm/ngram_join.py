"""N-gram Jaccard join by PartEnum signatures.

Sets of distinct five-word shingles link at a Jaccard similarity of 3/4 or more. Two linked sets of s and
t shingles differ in at most d = (s + t) / 7 elements. Sets fall into size bands; a band's scheme deals the feature
domain into parts, more than a pair with its larger set in the band can differ in, and enumerates the subsets of one
part each: a set's signatures are its projections on them. A set takes part in the schemes of its own band and of those
that a larger partner may be in. Of the first d + 1 + slack parts a linked pair agrees on slack + 1 and more; parts
where a set is empty give it no signature, so the pair shares need = 1 + slack - (empty parts) signatures, by
either set's count. (Subsets of two of three parts cost more here: a third of the parts of a band's smallest sets are empty.)

Signatures are grouped by hash; equal sets are one node throughout, so copies cost nothing. No group is expanded
into pairs:

1. Groups with the same members become one with a weight. Nodes with fewer shared signatures than they need go.
2. A group's centre is the member that meets most others in all its groups: in a family of near copies, that
   nearest to what they were copied from. Each member is paired with the centre only; pairs that meet
   as often as they need are verified on the whole sets, and links are closed to components.
3. A linked pair of different components shares its signatures in groups that hold both. So groups within a
   component are settled, and nodes with fewer signatures in the others than they need are too.
4. What is left meets by an exact prefix filter, across components only: linked sets share one of their
   s - ceil(3s/4) + 1 rarest shingles, at places that leave room for enough common ones. Few pairs are left, are verified,
   and join components. Nodes whose empty parts use up the slack, who may share no signature, take part in this too.

The result is exact up to collisions of 64-bit hashes. The workers' buckets of signatures follow the bytes of the input.

Defined results: texts without words (null, empty, blank) have empty sets, link with nothing and are their own
component. Texts of one to four words have one shingle. A null doc_id never names a component unless it is alone.
Repeated rows are copies of each other; an empty table gives no rows; extra columns are ignored by
``joined`` and carried by ``keep_one_of_each``.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.llm import common, shingles
from lodestar.operators.graphs import connected_components

#: A group with more members than this among what a worker sends at once is spread: one goes on to meet those of
#: other workers, the rest are sent as rows of their own, so that no bucket holds a frequent signature's members.
SMALL = 32
#: A group with more members than this is not kept as one row.
LONGEST = 4096
#: Signatures that a worker gathers before it sends them on.
FLUSH = 500_000
#: Buckets of signatures for each shuffle partition, at least; and bytes of text for each bucket, at most (about one signature
#: for eight bytes).
FINE = 2
BUCKET_BYTES = 8_000_000
#: Tasks for each core that gather signatures, at least, if there are so many shuffle partitions.
TASKS = 3
#: Bytes of an Arrow batch of packed signatures, or of pairs of whole sets.
BATCH = 8_000_000
BROADCAST_ROWS = 500_000
NO_ID = -(1 << 63)
PACKED, LIST, SPREAD, NODE = range(4)
ROWS = "kind int, a long, b long, c long, n int, m int, members array<long>"


@functools.cache
def bands(most: int = 1 << 40) -> tuple[np.ndarray, np.ndarray]:
    """First and last set size of each band."""
    first = [1]
    while first[-1] < most:
        first.append(first[-1] * 4 // 3 + 1)
    return np.array(first[:-1]), np.array(first[1:]) - 1


@functools.cache
def scheme(band: int) -> tuple[int, int, int]:
    """(last size, parts, slack) of a band: the slack covers empty parts of its smallest participants, mostly."""
    first, last = bands()
    r = int(last[band])
    least = max(1, math.ceil(0.75 * int(first[band])))
    slack = 2
    for _ in range(8):  # the number of parts and of empty ones depend on each other
        parts = 2 * r // 7 + 1 + slack
        empty = parts * math.exp(-least / parts)
        slack = min(2 + math.ceil(empty + 4 * math.sqrt(empty)), 2 + 2 * r // 7)
    return r, 2 * r // 7 + 1 + slack, slack


def schemes_of(size: int) -> list[tuple[int, int, int, int]]:
    """(band, parts, used parts, slack) of every scheme that a set of this size takes part in."""
    first, _ = bands()
    own, furthest = (int(np.searchsorted(first, s, "right")) - 1 for s in (size, 4 * size // 3))
    out = []
    for band in range(own, furthest + 1):
        r, parts, slack = scheme(band)
        out.append((band, parts, min(parts, (size + min(r, 4 * size // 3)) // 7 + 1 + slack), slack))
    return out


cached_schemes = functools.lru_cache(100_000)(schemes_of)


def identity(s: np.ndarray) -> int:
    """A set's node: a 64-bit hash of its elements and size, as a signed number; 0 is the empty set."""
    if not len(s):
        return 0
    x = shingles.mix(np.array([shingles.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(), len(s)], np.uint64))
    return int(shingles.mix(x[:1] + x[1:])[0].astype(np.int64)) or 1


def signatures(sets: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of many sets, the index of the set of each, and each set's least slack left by its empty parts."""
    starts = np.cumsum(counts) - counts
    jobs = [(i, starts[i], c, *s) for i, c in enumerate(counts.tolist()) if c for s in cached_schemes(c)]
    left = np.full(len(counts), 1 << 20, np.int64)
    if not jobs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), left
    owner, start, count, band, parts, used, slack = np.array(jobs, np.int64).T
    cells = np.cumsum(used) - used
    job = np.repeat(np.arange(len(jobs)), count)
    element = sets[np.arange(len(job)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start, count)]
    seed = shingles.mix(band.astype(np.uint64) + np.uint64(77))
    x = shingles.mix(element ^ seed[job])
    part = ((x >> np.uint64(32)) * parts.astype(np.uint64)[job] >> np.uint64(32)).astype(np.int64)
    live = part < used[job]
    cell = (cells[job] + part)[live]
    total = np.zeros(int(used.sum()), np.uint64)
    np.add.at(total, cell, shingles.mix(x[live]))
    full = np.zeros(len(total), bool)
    full[cell] = True
    of = np.repeat(np.arange(len(jobs)), used)
    empty = np.bincount(of[~full], minlength=len(jobs))
    np.minimum.at(left, owner, slack - empty)
    place = (np.arange(len(total)) - cells[of]).astype(np.uint64)
    sig = shingles.mix(total + shingles.mix(place * np.uint64(0x9E3779B97F4A7C15) + seed[of]))
    return sig[full], owner[of[full]], left


def pack(sig: np.ndarray, node: np.ndarray, spread: np.ndarray) -> bytes:
    """The low 40 bits of each signature, nodes by a dictionary, and a bit for members of spread groups; planes of bytes compress."""
    names, index = np.unique(node, return_inverse=True)
    wide = np.uint32 if len(names) > 65535 else np.uint16
    return b"".join((np.array([len(sig), len(names)], np.int64).tobytes(), sig.astype(np.uint32).tobytes(), (sig >> np.uint64(32)).astype(np.uint8).tobytes(), index.astype(wide).tobytes(), names.tobytes(), np.packbits(spread).tobytes()))


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, k = (int(x) for x in np.frombuffer(blob, np.int64, 2))
    low = np.frombuffer(blob, np.uint32, n, 16).astype(np.uint64)
    high = np.frombuffer(blob, np.uint8, n, 16 + 4 * n).astype(np.uint64)
    wide = np.uint32 if k > 65535 else np.uint16
    index = np.frombuffer(blob, wide, n, 16 + 5 * n)
    at = 16 + 5 * n + wide().itemsize * n
    names = np.frombuffer(blob, np.int64, k, at)
    spread = np.unpackbits(np.frombuffer(blob, np.uint8, offset=at + 8 * k), count=n).astype(bool)
    return low | high << np.uint64(32), names[index], spread


def groups(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, ...]:
    """The order that sorts distinct (signature, node); where groups start in it, and their sizes."""
    order = np.lexsort((node, sig))
    s, x = sig[order], node[order]
    fresh = np.ones(len(s), bool)
    fresh[1:] = (s[1:] != s[:-1]) | (x[1:] != x[:-1])
    order, s = order[fresh], s[fresh]
    starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    return order, starts, np.diff(np.append(starts, len(s)))


def group_name(sig: np.ndarray, bucket: int, buckets: int) -> np.ndarray:
    return shingles.mix(sig * np.uint64(buckets) + np.uint64(bucket)).astype(np.int64)


def record(kind: int, **columns) -> pa.RecordBatch:
    k = len(next(iter(columns.values())))
    kinds = {"a": pa.int64(), "b": pa.int64(), "c": pa.int64(), "n": pa.int32(), "m": pa.int32(), "members": pa.list_(pa.int64())}
    own = [pa.nulls(k, t) if c not in columns else columns[c] if isinstance(columns[c], pa.Array) else pa.array(columns[c].astype(t.to_pandas_dtype())) for c, t in kinds.items()]
    return pa.RecordBatch.from_arrays([pa.array(np.full(k, kind, np.int32)), *own], ["kind", *kinds])


def send(buckets: int):
    """(doc_id, sub, text) to (bucket, kind, data): packed signatures by bucket; nodes and members of spread groups as they are."""

    def run(batches):
        shingler = shingles.Shingler()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        known: set[int] = set()
        amount, turn = 0, 0

        def raw(kind, columns):
            nonlocal turn
            turn += 1
            return (turn * 7919 + TaskContext.get().partitionId() * 104729) % buckets, kind, b"".join(np.ascontiguousarray(c, np.int64).tobytes() for c in columns)

        def sent(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "kind", "data"])

        def flush():
            sig, node = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            known.clear()
            out = []
            bucket = ((sig >> np.uint64(48)) * np.uint64(buckets) >> np.uint64(16)).astype(np.uint16 if buckets < 65536 else np.uint32)
            order = np.argsort(bucket, kind="stable")
            bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(bounds)).tolist():
                at = order[bounds[b] : bounds[b + 1]]
                s, x = sig[at] & np.uint64((1 << 40) - 1), node[at]
                own, starts, sizes = groups(s, x)
                s, x = s[own], x[own]
                spread = np.repeat(sizes > SMALL, sizes)
                if spread.any():
                    goes_on = ~spread
                    goes_on[starts] = True
                    out.append(raw(SPREAD, (group_name(s[~goes_on], b, buckets).view(np.int64), x[~goes_on])))
                    s, x, spread = s[goes_on], x[goes_on], spread[goes_on]
                out.append((b, PACKED, pack(s, x, spread)))
            return sent(out)

        for batch in batches:
            ids, subs = (batch.column(c).to_numpy() for c in ("doc_id", "sub"))
            for lo, hi, data, ends in shingles.chunked(batch.column("text")):
                sets, counts = shingler.sets(data, ends)
                stops = np.cumsum(counts)
                nodes = np.array([identity(sets[z - c : z]) for c, z in zip(counts, stops, strict=True)], np.int64)
                fresh = np.zeros(len(nodes), bool)
                for i, x in enumerate(nodes.tolist()):
                    if x and x not in known:
                        known.add(x)
                        fresh[i] = True
                sig, owner, left = signatures(sets[np.repeat(fresh, counts)], counts[fresh])
                slack = np.full(len(nodes), 1 << 20, np.int64)
                slack[fresh] = left
                held.append((sig, nodes[fresh][owner]))
                amount += len(sig)
                yield sent([raw(NODE, (ids[lo:hi], subs[lo:hi], nodes, counts, slack))])
                if amount >= FLUSH:
                    yield flush()
                    amount = 0
        if held:
            yield flush()

    # A task that runs again must send the same rows to the same buckets: nothing here depends on chance.
    return run


def receive(buckets: int):
    """(bucket, kind, data), buckets together, to ROWS: groups of two nodes and more, as lists or as members of spread groups."""

    def group(bucket, blobs):
        if not blobs:
            return
        sig, node, spread = (np.concatenate(x) for x in zip(*map(unpack, blobs), strict=True))
        order, starts, sizes = groups(sig, node)
        if not len(starts):
            return
        names, x = group_name(sig[order[starts]], bucket, buckets), node[order]
        # A repeated (signature, node) may carry the bit only in one of its rows.
        marked = np.isin(sig[order[starts]], np.unique(sig[spread])) | (sizes > LONGEST)
        at = np.repeat(marked, sizes)
        if at.any():
            yield record(SPREAD, a=np.repeat(names, sizes)[at], b=x[at])
        whole = ~marked & (sizes > 1)
        if whole.any():
            member, k = x[np.repeat(whole, sizes)], sizes[whole]
            edges = np.concatenate([[0], np.cumsum(k)])
            key = shingles.mix(np.add.reduceat(shingles.mix(member.view(np.uint64)), edges[:-1]) + k.astype(np.uint64))
            yield record(LIST, a=key.view(np.int64), n=k, members=pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(member)))

    def run(batches):
        now, blobs = -1, []
        for batch in batches:
            for bucket, kind, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "data")), strict=True):
                if bucket != now:
                    yield from group(now, blobs)
                    now, blobs = bucket, []
                if kind == PACKED:
                    blobs.append(data)
                elif kind == NODE:
                    yield record(kind, **dict(zip("abcnm", np.frombuffer(data, np.int64).reshape(5, -1), strict=True)))
                else:
                    yield record(kind, **dict(zip("ab", np.frombuffer(data, np.int64).reshape(2, -1), strict=True)))
        yield from group(now, blobs)

    return run


def documents(docs: DataFrame) -> DataFrame:
    """(doc_id, sub, text): doc_id NO_ID where it is null, sub a hash of the text."""
    return common.texts(docs).fillna({"doc_id": NO_ID}).select("doc_id", F.xxhash64("text").alias("sub"), "text")


def bounded(df: DataFrame) -> DataFrame:
    """df to broadcast if it has at most BROADCAST_ROWS rows, else as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, elements) of the wanted (node, rep, sub): the shingle set, 8 bytes an element, of each representative."""
    ids = bounded(wanted.select(F.col("rep").alias("id"), F.col("sub").alias("id_sub")))

    def run(batches):
        shingler = shingles.Shingler()
        for batch in batches:
            for _, _, data, ends in shingles.chunked(batch.column("text")):
                sets, counts = shingler.sets(data, ends)
                cut = np.cumsum(counts)
                each = [sets[z - c : z] for c, z in zip(counts, cut, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([identity(s) for s in each], pa.int64()), pa.array([s.tobytes() for s in each], pa.binary())], ["node", "elements"])

    texts = documents(docs)
    found = texts.join(ids, (texts["doc_id"] == ids["id"]) & (texts["sub"] == ids["id_sub"]), "left_semi").select("text").transform(common.in_workers, run, "node long, elements binary")
    sets = common.written(found, "sets", BATCH)
    # Repeated rows of a representative give its set again.
    return sets if sets.count() <= wanted.count() else common.written(sets.dropDuplicates(["node"]), "sets")


def verified(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """The edges (u, v) whose sets have 100 * common >= 75 * all."""

    def run(batches):
        for batch in batches:
            good = []
            for a, b in zip(batch.column("su"), batch.column("sv"), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                if 4 * min(len(x), len(y)) < 3 * max(len(x), len(y)):
                    good.append(False)
                    continue
                both = np.concatenate([x, y])
                both.sort()
                common_ = int((both[1:] == both[:-1]).sum())
                good.append(100 * common_ >= 75 * (len(both) - common_))
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    met = edges.join(sets.select(F.col("node").alias("v"), F.col("elements").alias("sv")), "v").join(sets.select(F.col("node").alias("u"), F.col("elements").alias("su")), "u")
    return common.written(met.select("u", "v", "su", "sv").transform(common.in_workers, run, "u long, v long"), "verified", BATCH, edges.count())


def rare_meetings(sets: DataFrame, labels: DataFrame) -> DataFrame:
    """Candidate pairs (u, v) of different components among sets, by a prefix filter.

    With each set ordered by rarity, a linked pair's first common shingle leaves room for 3/7 of both sizes.
    Shingles of one set only come first and meet nothing, so they are only counted.
    """

    def split(batches):
        for batch in batches:
            each = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("elements")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(each, pa.list_(pa.int64()))], ["node", "elements"])

    every = sets.transform(common.in_workers, split, "node long, elements array<long>").select("node", F.size("elements").alias("size"), F.explode("elements").alias("x"))
    held = every.groupBy("x").agg(F.count(F.lit(1)).alias("count")).where("count > 1")
    shared = every.join(held, "x")
    own, by_rarity = W.partitionBy("node"), W.partitionBy("node").orderBy("count", "x")
    ranked = shared.select("node", "size", "x", (F.col("size") - F.count(F.lit(1)).over(own) + F.row_number().over(by_rarity)).alias("place"))
    near = ranked.where("place <= size - ceil(0.75 * size) + 1").join(labels, "node", "left")
    prefix = common.written(near.select("node", "size", "x", "place", F.coalesce("label", "node").alias("label")), "prefix", BATCH)
    a, b = (prefix.select(F.col("node").alias(e), F.col("size").alias(f"s{e}"), F.col("x").alias(f"x{e}"), F.col("place").alias(f"p{e}"), F.col("label").alias(f"l{e}")) for e in "uv")
    room = "7 * (1 + least(su - pu, sv - pv)) >= 3 * (su + sv)"
    met = a.join(b, F.expr(f"xu = xv AND u < v AND lu <> lv AND 4 * least(su, sv) >= 3 * greatest(su, sv) AND {room}"))
    # Few of the pairs of a shingle pass; if there are more than rows in the prefixes, the files are larger.
    return common.written(met.select("u", "v").distinct(), "meetings", rows=prefix.count())


def needing(members: DataFrame) -> DataFrame:
    """members (grp, weight, node, need, ...) of the nodes that have as many signatures as they need."""
    enough = members.groupBy("node").agg(F.sum("weight").alias("m"), F.max("need").alias("most")).where("m >= most").select("node")
    return members.join(enough, "node", "left_semi")


def unsettled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """members of groups that hold several components, twice over, of nodes that have as many as they need there."""
    most = members.count()
    placed = members.join(labels, "node", "left").select("grp", "weight", "node", "need", F.coalesce("label", "node").alias("label"))
    for _ in range(2):  # a node that goes may settle a group; any number of turns is exact
        mixed = placed.groupBy("grp").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("grp")
        placed = common.written(needing(placed.join(mixed, "grp", "left_semi")), "unsettled", rows=most)
    return placed


def merged(labels: DataFrame, found: DataFrame) -> DataFrame:
    """labels (node, label) after the links found (u, v) between components and lone nodes."""
    most = found.count()
    for e in ("u", "v"):
        found = found.join(labels.select(F.col("node").alias(e), F.col("label").alias(f"label_{e}")), e, "left")
    across = common.written(found.select(F.coalesce("label_u", "u").alias("a"), F.coalesce("label_v", "v").alias("b")).where("a <> b").distinct(), "across", rows=most)
    links = across.count()
    if not links:
        return labels
    joint = connected_components(across, rows=links)
    again = joint.select(F.col("node").alias("old"), F.col("label").alias("new"))
    moved = labels.join(again, labels["label"] == again["old"], "left").select("node", F.coalesce("new", "label").alias("label"))
    alone = joint.join(labels.select("node"), "node", "left_anti").select("node", "label")
    return common.written(moved.unionByName(alone), "labels", rows=labels.count() + 2 * links)


def linked(docs: DataFrame, nodes: DataFrame, members: DataFrame) -> DataFrame:
    """(node, label) of every node that links with another; members: (grp, weight, size, node) of all groups."""
    own = nodes.select("node", F.col("size").alias("own"), F.greatest(F.lit(1), F.col("slack") + 1).alias("need"))
    live = needing(members.join(own, "node"))
    degrees = members.groupBy("node").agg(F.sum(F.col("weight") * F.col("size")).alias("degree"))
    live = common.written(live.join(degrees, "node").select("grp", "weight", "node", "own", "need", "degree"), "live")
    # A tie goes to the larger hash.
    centres = live.groupBy("grp").agg(F.max(F.struct("degree", "node", "own", "need")).alias("c"), F.count(F.lit(1)).alias("of")).where("of > 1").select("grp", "c.*")
    centres = centres.select("grp", F.col("node").alias("centre"), F.col("own").alias("centre_own"), F.col("need").alias("centre_need"))
    stars = live.join(centres, "grp").where("node <> centre AND 4 * least(own, centre_own) >= 3 * greatest(own, centre_own)")
    edges = stars.groupBy("centre", "node").agg(F.sum("weight").alias("met"), F.max(F.greatest("need", "centre_need")).alias("need")).where("met >= need")
    edges = common.written(edges.select(F.col("centre").alias("u"), F.col("node").alias("v")), "edges", rows=live.count())

    def ends(pairs: DataFrame) -> DataFrame:
        return nodes.join(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct(), "node", "left_semi")

    links = verified(edges, sets_of(docs, ends(edges)))
    labels = connected_components(links.select(F.col("u").alias("a"), F.col("v").alias("b")), rows=links.count())
    rest = unsettled(live, labels).select("node").distinct()
    left = sets_of(docs, nodes.join(rest, "node", "left_semi").unionByName(nodes.where("slack < 0")).dropDuplicates(["node"]))
    more = rare_meetings(left, labels)
    return labels if more.isEmpty() else merged(labels, verified(more, left))


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, sub, node, n_shingles) for every row of docs, and (node, label, component_id) for every node but the empty set's."""
    texts = documents(docs)
    parts = common.partitions(docs.sparkSession)
    size = common.text_bytes(texts)
    buckets = max(FINE * parts, size // BUCKET_BYTES)
    sent = texts.transform(common.in_workers, send(buckets), "bucket int, kind int, data binary")
    dealt = sent.repartition(max(parts, buckets // FINE), "bucket").sortWithinPartitions("bucket")
    # Where there are more partitions than the bytes and cores need, a task takes several one after another; a bucket stays together.
    tasks = max(TASKS * docs.sparkSession.sparkContext.defaultParallelism, size // (FINE * BUCKET_BYTES) + 1)
    rows = (dealt.coalesce(tasks) if tasks < parts else dealt).transform(common.in_workers, receive(buckets), ROWS)
    rows = common.written(rows, "signatures", BATCH)
    own = rows.where(f"kind = {NODE}").select(F.col("a").alias("doc_id"), F.col("b").alias("sub"), F.col("c").alias("node"), F.col("n").alias("n_shingles"), F.col("m").alias("slack"))
    nodes = own.where("node <> 0").groupBy("node").agg(F.min(F.struct(F.col("doc_id") == NO_ID, "doc_id", "sub")).alias("first"), F.min("slack").alias("slack"), F.max("n_shingles").alias("size"))
    nodes = common.written(nodes.select("node", F.col("first.doc_id").alias("rep"), F.col("first.sub").alias("sub"), "slack", "size"), "nodes", rows=own.count())
    lists = rows.where(f"kind = {LIST}").groupBy(F.col("a").alias("grp")).agg(F.count(F.lit(1)).alias("weight"), F.first("n").cast("long").alias("size"), F.first("members").alias("members"))
    spread = rows.where(f"kind = {SPREAD}").select(F.col("a").alias("grp"), F.col("b").alias("node")).distinct()
    sizes = spread.groupBy("grp").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = lists.select("grp", "weight", "size", F.explode("members").alias("node")).unionByName(spread.join(sizes, "grp").select("grp", F.lit(1).cast("long").alias("weight"), "size", "node"))
    labels = linked(docs, nodes, common.written(members, "members"))
    lone = nodes.join(labels, "node", "left").select("node", "rep", F.coalesce("label", "node").alias("label"))
    least = lone.groupBy(F.col("label").alias("of")).agg(F.coalesce(F.min(F.when(F.col("rep") != NO_ID, F.col("rep"))), F.lit(NO_ID)).alias("component_id"))
    return own.drop("slack"), lone.join(least, F.col("label") == F.col("of")).select("node", "label", "component_id")


def placed(docs: DataFrame) -> DataFrame:
    """doc_id (NO_ID for null), sub, n_shingles, component_id, label (of the component; 0 for no words) for every row of docs."""
    members, found = classes(docs)
    own = members.select("doc_id", "sub", "node", F.col("n_shingles").cast("long").alias("n_shingles"))
    met = own.where("node <> 0").join(found, "node").select("doc_id", "sub", "n_shingles", "component_id", "label")
    return met.unionByName(own.where("node = 0").select("doc_id", "sub", "n_shingles", F.col("doc_id").alias("component_id"), F.col("node").alias("label")))


def joined(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return placed(docs).select(known("doc_id"), "n_shingles", known("component_id"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one document of each component: that of the least doc_id (null last), of several texts with it that
    of the least hash. Rows without words stay; rows with one doc_id and one text stay or go together."""
    own = placed(docs).where("label <> 0")
    stays = own.groupBy("label").agg(F.min(F.struct(F.col("doc_id") == NO_ID, "doc_id", "sub")).alias("first"))
    stays = stays.select(F.col("first.doc_id").alias("stay_id"), F.col("first.sub").alias("stay_sub"))
    every = own.select("doc_id", "sub").distinct()
    gone = every.join(stays, (every["doc_id"] == stays["stay_id"]) & (every["sub"] == stays["stay_sub"]), "left_anti")
    gone = bounded(common.written(gone.select(F.col("doc_id").alias("__gone"), F.col("sub").alias("__sub")), "gone"))
    own_id = F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID))
    return docs.join(gone, (own_id == F.col("__gone")) & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == F.col("__sub")), "left_anti")


def op1_ngram_join(spark, sf_dir: str) -> DataFrame:
    return joined(common.table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
      JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
      GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))),
r AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT u AS doc_id, min(v) AS component_id FROM r GROUP BY u) c USING (doc_id)
"""
