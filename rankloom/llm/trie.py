"""Prefix trie of conversations: sorted runs with common-prefix lengths, merged range by range into finished nodes."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.workspace import Workspace

WIDTH = 16  # bytes of a turn's digest
ROOT = bytes(WIDTH)

#: Turns of a sorted run, of the smallest and of the largest range that one task merges.
RUN_TURNS = 1 << 18
RANGE_TURNS = (1 << 14, 1 << 20)
MOST_RANGES = 1024
SAMPLES_A_RANGE = 30
CHUNK_IDS = 4096
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, id binary, parent binary, straddles boolean, opens boolean, ends array<string>"


def conversations_of(rows: DataFrame) -> DataFrame:
    """(conv_id, digests, chars): each conversation's turns in order, as digests of (role, text) and code points of the text."""
    given = rows.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter("conv_id is not null")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text"))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 2 * WIDTH))
    numbered = given.select("conv_id", place.alias("place"), digest.alias("digest"), F.char_length("text").alias("chars"))
    turns = numbered.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "digest", "chars"))).alias("turns"))
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turns.digest").alias("digests"), F.col("turns.chars").alias("chars"))


def rebuilt(own: DataFrame) -> DataFrame:
    """Every conversation c with its first h turns taken from conversation c - c % 100, h = crc32(c) % 6."""
    heads = own.select(F.col("conv_id").alias("base"), F.slice("digests", 1, 5).alias("head"), F.slice("chars", 1, 5).alias("head_chars"))
    at = own.withColumn("base", F.expr("conv_id - conv_id % 100")).withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % 6).cast("int"))

    def joined(head: str, tail: str):
        return F.expr(f"concat(coalesce(slice({head}, 1, h), slice({tail}, 1, 0)), slice({tail}, h + 1, greatest(size({tail}) - h, 0)))")

    return at.join(heads, "base", "left").select("conv_id", joined("head", "digests").alias("digests"), joined("head_chars", "chars").alias("chars"))


def _lcp(a: bytes, b: bytes) -> int:
    """Turns that two sequences have in common."""
    n = min(len(a), len(b)) // WIDTH
    i = 0
    while i < n and a[WIDTH * i : WIDTH * (i + 1)] == b[WIDTH * i : WIDTH * (i + 1)]:
        i += 1
    return i


def _sorted_runs(shared, most: int):
    """Sorted runs of conversations, cut at the ranges: a row holds a run's share of a range, each entry but for what it has in common with the one before."""
    schema = pa.schema([("range", pa.int64()), ("first", pa.binary()), ("last", pa.binary()), ("last_conv", pa.int64()), ("convs", pa.list_(pa.int64())), ("lcps", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int32())), ("tails", pa.binary()), ("chars", pa.list_(pa.int32()))])

    def pieces(run: list[tuple[bytes, int, np.ndarray]]) -> pa.RecordBatch:
        run.sort(key=lambda x: x[:2])
        cuts = [0, *(bisect_left(run, s, key=lambda x: x[:2]) for s in shared.value), len(run)]
        rows = []
        for number, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if a == b:
                continue
            lcps = [0, *(_lcp(run[i - 1][0], run[i][0]) for i in range(a + 1, b))]
            part = run[a:b]
            rows.append(
                {
                    "range": number,
                    "first": part[0][0],
                    "last": part[-1][0],
                    "last_conv": part[-1][1],
                    "convs": [c for _, c, _ in part],
                    "lcps": lcps,
                    "lengths": [len(k) // WIDTH for k, _, _ in part],
                    "tails": b"".join(k[WIDTH * h :] for (k, _, _), h in zip(part, lcps)),
                    "chars": np.concatenate([x[h:] for (_, _, x), h in zip(part, lcps)]),
                }
            )
        return pa.RecordBatch.from_pylist(rows, schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, int, np.ndarray]] = []
        turns = 0
        for batch in batches:
            for conv, digests, chars in zip(*(batch.column(i) for i in range(3))):
                entry = (b"".join(digests.as_py()), conv.as_py(), np.array(chars.as_py(), np.int32))
                held.append(entry)
                turns += 1 + len(entry[2])
                if turns >= most:
                    yield pieces(held)
                    held, turns = [], 0
        if held:
            yield pieces(held)

    return run


class Run:
    """One sorted run: the entry at its head, and how many turns that has in common with the last entry merged."""

    def __init__(self, piece: dict):
        self.entries = zip(piece["convs"], piece["lcps"], piece["lengths"])
        self.tails, self.new_chars = piece["tails"], piece["chars"]
        self.at = 0
        self.digests: list[bytes] = []
        self.chars: list[int] = []
        self.conv = 0
        self.lcp = 0
        self.done = False
        self.advance()

    def advance(self) -> None:
        entry = next(self.entries, None)
        if entry is None:
            self.done = True
            return
        self.conv, self.lcp, length = entry
        stop = self.at + length - self.lcp
        self.digests = self.digests[: self.lcp] + [self.tails[WIDTH * i : WIDTH * (i + 1)] for i in range(self.at, stop)]
        self.chars = self.chars[: self.lcp] + list(self.new_chars[self.at : stop])
        self.at = stop


def _beats(a: Run, b: Run) -> bool:
    """Whether a's head goes before b's. Both know what they share with the last entry merged, which is before
    both: who shares more goes first, and only equal shares are compared, from there on.
    The loser then knows what it shares with the winner."""
    if a.done or b.done:
        return b.done
    if a.lcp != b.lcp:
        return a.lcp > b.lcp
    x, y, i = a.digests, b.digests, a.lcp
    n = min(len(x), len(y))
    while i < n and x[i] == y[i]:
        i += 1
    if i < n:
        first = x[i] < y[i]
    else:
        first = len(x) < len(y) if len(x) != len(y) else a.conv < b.conv
    (b if first else a).lcp = i
    return first


def merged(runs: list[Run]) -> Iterator[Run]:
    """A loser tree over sorted runs: the run whose head is next, again and again; its lcp is with the entry before."""
    k = len(runs)
    losers = [-1] * k  # at inner node i; leaves are k to 2k - 1
    winners = [-1] * k + list(range(k))
    for i in range(k - 1, 0, -1):
        a, b = winners[2 * i], winners[2 * i + 1]
        winners[i], losers[i] = (a, b) if _beats(runs[a], runs[b]) else (b, a)
    best = winners[1] if k > 1 else 0
    while not runs[best].done:
        yield runs[best]
        runs[best].advance()
        i = (best + k) // 2
        while i:
            if _beats(runs[losers[i]], runs[best]):
                best, losers[i] = losers[i], best
            i //= 2


class _Node:
    __slots__ = ("id", "depth", "chars", "parent", "conv", "n", "children", "leaves", "saved", "ends", "straddles", "opens", "had_child")

    def __init__(self, id_: bytes, depth: int, chars: int, parent: _Node | None, before: int, length_before: int):
        self.id, self.depth, self.chars, self.parent = id_, depth, chars, parent
        self.conv, self.n, self.children, self.leaves, self.saved = 1 << 63, 0, 0, 0, 0
        self.ends: list[int] = []
        self.straddles = depth <= before  # the range before holds members too
        self.opens, self.had_child = not self.straddles, self.straddles and length_before > depth

    def finish(self) -> None:
        """Add what is known of the node to itself and to its parent.

        Sums of a node that straddles ranges are shares: opened once, its first child once, its
        text counted for each member less once where it opens.
        """
        if self.straddles:
            self.leaves += self.opens - (self.children > 0 and not self.had_child)
            self.saved += (self.n - self.opens) * self.chars
        else:
            self.leaves += not self.children
            self.saved += (self.n - 1) * self.chars
        if self.parent is not None:
            up = self.parent
            up.conv = min(up.conv, self.conv)
            up.n += self.n
            up.leaves += self.leaves
            up.saved += self.saved


def _nodes(table: pa.Table) -> pa.Table:
    """All nodes with members in one range; those that go on in another range with their shares."""
    pieces = table.to_pylist()
    before, length_before, after = pieces[0]["before"], pieces[0]["length_before"], pieces[0]["after"]
    stack = [_Node(ROOT, 0, 0, None, before, length_before)]
    done: list[_Node] = [stack[0]]
    started = False

    def close(depth: int) -> None:
        while len(stack) > depth + 1:
            stack.pop().finish()

    for head in merged([Run(p) for p in pieces]):
        close(head.lcp if started else 0)
        for depth in range(len(stack), len(head.digests) + 1):
            parent = stack[-1]
            id_ = hashlib.blake2b(parent.id + head.digests[depth - 1], digest_size=WIDTH).digest()
            node = _Node(id_, depth, head.chars[depth - 1], parent, -1 if started else before, length_before)
            parent.children += node.opens
            stack.append(node)
            done.append(node)
        started = True
        top = stack[-1]
        top.conv = min(top.conv, head.conv)
        top.n += 1
        top.ends.append(head.conv)
    for node in stack[: after + 1]:
        node.straddles = True
    close(-1)

    def joined(ids: list[int]) -> str:
        return ",".join(map(str, ids))

    rows = {
        "conv_id": [x.conv for x in done],
        "depth": [x.depth for x in done],
        "parent_conv_id": [None if x.parent is None or x.parent.straddles else x.parent.conv for x in done],
        "n_convs": [x.n for x in done],
        "n_children": [x.children for x in done],
        "n_leaves": [x.leaves for x in done],
        "saved_tokens": [x.saved for x in done],
        "ends_sha256": [hashlib.sha256(joined(x.ends).encode()).hexdigest() for x in done],
        "id": [x.id for x in done],
        "parent": [None if x.parent is None else x.parent.id for x in done],
        "straddles": [x.straddles for x in done],
        "opens": [x.opens for x in done],
        "ends": [[joined(x.ends[i : i + CHUNK_IDS]) for i in range(0, len(x.ends), CHUNK_IDS)] if x.straddles else [] for x in done],
    }
    kinds = [pa.int64()] * 7 + [pa.string(), pa.binary(), pa.binary(), pa.bool_(), pa.bool_(), pa.list_(pa.string())]
    return pa.table({k: pa.array(v, t) for (k, v), t in zip(rows.items(), kinds, strict=True)})


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, ends_sha256) of rows (id, chunk) sorted by id and order; no list is held whole."""
    current, state = None, None
    for batch in batches:
        out: list[tuple[bytes, str]] = []
        for id_, chunk in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if id_ != current:
                if current is not None:
                    out.append((current, state.hexdigest()))
                current, state = id_, hashlib.sha256(chunk.encode())
            else:
                state.update(b"," + chunk.encode())
        if out:
            yield pa.RecordBatch.from_pydict({"id": [x[0] for x in out], "ends_sha256": [x[1] for x in out]}, pa.schema([("id", pa.binary()), ("ends_sha256", pa.string())]))
    if current is not None:
        yield pa.RecordBatch.from_pydict({"id": [current], "ends_sha256": [state.hexdigest()]}, pa.schema([("id", pa.binary()), ("ends_sha256", pa.string())]))


def conversation_trie(rows: DataFrame, run_turns: int = RUN_TURNS, range_turns: tuple[int, int] = RANGE_TURNS) -> DataFrame:
    """One row for each node of the prefix trie of the rebuilt conversations: conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``rows`` has conv_id, turn, role and text; turns are ordered by turn (null first), then role and text.
    Tasks sort their conversations into runs, which carry common-prefix lengths and are cut at sampled
    bounds; one task merges the pieces of a range by a loser tree that compares turns from the common
    prefix on, and an open-path stack closes nodes as the stream leaves them. Equal sequences are ordered by conv_id, so a
    range may begin inside them. Nodes that straddle ranges are summed by their id. Turns are equal by 128 bits of SHA-256.

    Null role or text is empty, rows without conv_id belong to no conversation, repeated rows are turns of
    their own, other columns are not read. Without rows there is no node, not even a root. A
    conversation's digests (20 bytes a turn) are in one row; texts are not held.
    """
    spark = rows.sparkSession
    ws = Workspace(spark, "trie")
    own = ws.save(conversations_of(rows))
    convs = ws.save(rebuilt(own))
    ws.drop(own)
    size = convs.agg(F.count("*").alias("n"), F.sum(F.size("digests") + 1).alias("turns")).first()
    turns = size.turns or 0
    a_range = min(max(range_turns[0], turns // MOST_RANGES), range_turns[1])
    ranges = max(1, -(-turns // a_range))
    longest = max(16, 250_000 // ranges)
    bounds: list[tuple[bytes, int]] = []
    if ranges > 1:
        prefix = F.slice("digests", 1, longest).alias("prefix")
        sample = convs.sample(min(1.0, SAMPLES_A_RANGE * ranges / size.n), seed=7).select(prefix, F.when(F.size("digests") <= longest, F.col("conv_id")).otherwise(-(1 << 63)).alias("conv"))
        keys = sorted((b"".join(bytes(d) for d in r.prefix), r.conv) for r in sample.collect())
        bounds = sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []
    shared = spark.sparkContext.broadcast(bounds)
    pieces = ws.save(convs.mapInArrow(_sorted_runs(shared, run_turns), "range long, first binary, last binary, last_conv long, convs array<long>, lcps array<int>, lengths array<int>, tails binary, chars array<int>"))
    ws.drop(convs)

    # what each range has in common with its neighbours: one row a range
    edges = pieces.groupBy("range").agg(F.min("first").alias("first"), F.max(F.struct("last", "last_conv")).getField("last").alias("last")).repartition(1)
    in_order = Window.orderBy("range")
    edges = edges.select("range", "first", "last", F.lag("last").over(in_order).alias("previous"), F.lead("first").over(in_order).alias("next"))
    common = F.udf(lambda a, b: -1 if a is None or b is None else _lcp(bytes(a), bytes(b)), "int")
    edges = ws.save(edges.select("range", common("previous", "first").alias("before"), F.coalesce(F.octet_length("previous") / WIDTH, F.lit(-1)).cast("int").alias("length_before"), common("last", "next").alias("after")))

    nodes = ws.save(pieces.drop("first", "last", "last_conv").join(edges, "range").groupBy("range").applyInArrow(_nodes, NODE))
    final = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    shares = nodes.filter("straddles")
    chunks = shares.select("id", "conv_id", "ends", F.col("n_convs")).select("id", F.posexplode("ends").alias("at", "chunk"))
    ordered = chunks.withColumn("first", F.substring_index("chunk", ",", 1).cast("long")).repartition("id").sortWithinPartitions("id", "first")
    digests = ordered.select("id", "chunk").mapInArrow(_digests, "id binary, ends_sha256 string")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    straddling = shares.groupBy("id", "depth", "parent").agg(F.min("conv_id").alias("conv_id"), *sums)
    straddling = ws.save(straddling.join(digests, "id", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))))
    parents = straddling.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    below = nodes.filter("not straddles and parent_conv_id is null").drop("parent_conv_id")
    open_above = below.select("parent", *[c for c in final if c != "parent_conv_id"]).union(straddling.select("parent", *[c for c in final if c != "parent_conv_id"]))
    return nodes.filter("not straddles and parent_conv_id is not null").select(final).union(open_above.join(parents, "parent", "left").select(final))
