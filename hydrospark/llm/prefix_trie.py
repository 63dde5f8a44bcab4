"""Prefix trie of conversations as burst tries.

A path is a conversation's sequence of turns. The suffixes that hang under a
trie head make a container, at first all paths under the root. A container of
more than ``limit`` rows bursts by the next turn id: its head becomes an inner
trie node and each next turn a head of its own. How large each would-be
container is only depends on the paths with its prefix, so all bursts are decided
at once by one aggregate per prefix instead of one round per depth. Containers
that remain are dealt to tasks, sorted by suffix and swept into nodes with a
stack.

A prefix is known by two 64-bit XORs over (turn id, depth), a running aggregate
over blocks of a path (``ordering.running``), and a turn by two 64-bit hashes of
its content. So a path, a prefix or a turn that holds a third of all rows is
spread over many tasks, and a task never holds more than one container.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrospark.llm.common import broadcast_if_small, cut_lineage
from hydrospark.llm.ordering import number_rows, running

SWEPT = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
         "saved_tokens long, ends_sha256 string, top boolean, q1 long, q2 long")


def count_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    return F.size(F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")).cast("long")


def turn_rows(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, t1, t2, words): the turns of each conversation numbered
    from 0 by ``turn`` (null first), role and content. Null roles and texts are
    empty; (t1, t2) identifies role and text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    narrow = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                          role.alias("role"), F.xxhash64(F.lit(1), role, text).alias("t1"),
                          F.xxhash64(F.lit(2), role, text).alias("t2"), count_words(text).alias("words"))
    numbered = number_rows(narrow, "conv_id", "turn", "role", "t1", "t2")
    first = numbered.groupBy(F.col("conv_id").alias("_c")).agg(F.min("row_number").alias("_first"))
    return numbered.join(first, F.col("conv_id").eqNullSafe(F.col("_c"))).select(
        "conv_id", (F.col("row_number") - F.col("_first")).alias("pos"), "t1", "t2", "words")


def rebuild(rows: DataFrame) -> DataFrame:
    """Paths of rebuilt conversations from ``turn_rows``: conversation c opens
    with the first h turns of c - c % 20 (all if fewer, none if absent), then has
    its own turns after its first h; h is crc32(decimal c) % 4.

    Returns (conv_id, depth, n_turns, t1, t2, words), depth 0 being a row for
    each conversation, turnless ones too. The rows of a null id are a
    conversation with h = 0. At most three rows of a conversation go to at most
    20 others, so nothing multiplies."""
    h = F.coalesce(F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4, F.lit(0))
    convs = rows.groupBy("conv_id").agg(F.count("*").alias("n")).withColumns(
        {"h": h, "base": F.col("conv_id") - F.col("conv_id") % 20})
    base_n = convs.select(F.col("conv_id").alias("_b"), F.col("n").alias("_n"))
    taken = F.least(F.col("h"), F.coalesce(F.col("_n"), F.lit(0)))
    convs = cut_lineage(
        convs.join(base_n, F.col("base") == F.col("_b"), "left").withColumn("open", taken)
        .select("conv_id", "base", "h", "open",
                (F.col("open") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns")))
    opening = (rows.where("pos < 3").withColumnRenamed("conv_id", "base")
               .join(convs.select("base", "conv_id", "open", "n_turns"), "base").where("pos < open")
               .select("conv_id", (F.col("pos") + 1).alias("depth"), "n_turns", "t1", "t2", "words"))
    own = convs.select(F.col("conv_id").alias("_c"), "h", "open", "n_turns")
    rest = (rows.join(own, F.col("conv_id").eqNullSafe(F.col("_c"))).where("pos >= h")
            .select("conv_id", (F.col("open") + F.col("pos") - F.col("h") + 1).alias("depth"), "n_turns", "t1", "t2",
                    "words"))
    zero = F.lit(0).cast("long")
    root = convs.select("conv_id", zero.alias("depth"), "n_turns", zero.alias("t1"), zero.alias("t2"), zero.alias("words"))
    return opening.unionByName(rest).unionByName(root)


def _digests_of_heads(ends: DataFrame) -> DataFrame:
    """(p1, p2, ends_sha256) from rows (p1, p2, conv_id): SHA-256 over the ids in
    ascending order. Sorted rows are first joined into pieces of up to 4,096 ids
    wherever they stand; the task that hashes a node reads its pieces one by one."""
    def pieces(batches):
        import pyarrow as pa

        key, ids = None, []

        def flush():
            return pa.RecordBatch.from_pydict(
                {"p1": [key[0]], "p2": [key[1]], "first": [ids[0]], "piece": [",".join(map(str, ids))]})
        for batch in batches:
            for p1, p2, c in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if ids and ((p1, p2) != key or len(ids) >= 4096):
                    yield flush()
                    ids = []
                key = (p1, p2)
                ids.append(c)
        if ids:
            yield flush()

    def hashed(batches):
        import pyarrow as pa

        key, state, out = None, None, []
        for batch in batches:
            for p1, p2, piece in zip(*(batch.column(n).to_pylist() for n in ("p1", "p2", "piece"))):
                if (p1, p2) != key:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = (p1, p2), hashlib.sha256(piece.encode())
                else:
                    state.update(b"," + piece.encode())
        if key is not None:
            out.append((*key, state.hexdigest()))
        for lo in range(0, len(out), 10_000):
            cols = list(zip(*out[lo:lo + 10_000]))
            yield pa.RecordBatch.from_pydict({"p1": cols[0], "p2": cols[1], "ends_sha256": cols[2]})

    sorted_ids = ends.where("conv_id is not null").repartitionByRange("p1", "p2", "conv_id") \
        .sortWithinPartitions("p1", "p2", "conv_id").select("p1", "p2", "conv_id")
    parts = sorted_ids.mapInArrow(pieces, "p1 long, p2 long, first long, piece string")
    return (parts.repartition("p1", "p2").sortWithinPartitions("p1", "p2", "first")
            .mapInArrow(hashed, "p1 long, p2 long, ends_sha256 string"))


class _Node:
    __slots__ = ("depth", "words", "conv", "n", "children", "leaves", "saved", "ends", "parent")

    def __init__(self, depth, words, parent):
        self.depth, self.words, self.parent = depth, words, parent
        self.conv, self.n, self.children, self.leaves, self.saved, self.ends = None, 0, 0, 0, 0, []

    def close(self):
        if not self.children:
            self.leaves = 1
        self.saved += (self.n - 1) * self.words
        up = self.parent
        if up is not None:
            up.n += self.n
            up.children += 1
            up.leaves += self.leaves
            up.saved += self.saved
            if up.conv is None or self.conv is not None and self.conv < up.conv:
                up.conv = self.conv


def _sweep(batches):
    """Nodes of containers whose suffixes come sorted, container by container."""
    import pyarrow as pa

    fields = [f.split() for f in SWEPT.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    schema = pa.schema([(n, kinds[k]) for n, k in fields])

    def rows_of(nodes, q):
        for x in nodes:
            up = x.parent
            yield (x.conv, x.depth, up.conv if up else None, x.n, x.children, x.leaves, x.saved,
                   hashlib.sha256(",".join(x.ends).encode()).hexdigest(), up is None,
                   q[0] if up is None else None, q[1] if up is None else None)

    def frame(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema, strict=True)],
                                          schema=schema)

    key, q, stack, nodes, before, out = None, None, [], [], [], []
    for batch in batches:
        cols = {n: batch.column(n).to_pylist() for n in ("p1", "p2", "q1", "q2", "conv_id", "start", "ids", "words")}
        for p1, p2, q1, q2, conv, start, ids, words in zip(*cols.values()):
            path = [(x["t1"], x["t2"]) for x in ids]
            if (p1, p2) != key:
                while stack:
                    stack.pop().close()
                out.extend(rows_of(nodes, q))
                key, q, nodes, before = (p1, p2), (q1, q2), [], []
            same = 0
            while same < len(before) and same < len(path) and before[same] == path[same]:
                same += 1
            while len(stack) > same:
                stack.pop().close()
            for i in range(same, len(path)):
                stack.append(_Node(start + i, words[i], stack[-1] if stack else None))
                nodes.append(stack[-1])
            end = stack[-1]
            end.n += 1
            if conv is not None:
                end.ends.append(str(conv))
                end.conv = conv if end.conv is None else min(end.conv, conv)
            before = path
            if len(out) >= 10_000:
                yield frame(out)
                out = []
    while stack:
        stack.pop().close()
    out.extend(rows_of(nodes, q))
    for lo in range(0, len(out), 10_000):
        yield frame(out[lo:lo + 10_000])


def build_trie(paths: DataFrame, limit: int = 4096) -> DataFrame:
    """Nodes of the prefix trie of ``paths`` (conv_id, depth, n_turns, t1, t2,
    words; a row at depth 0 for each conversation, depths without gaps).

    One row per node: ``conv_id`` (smallest member), ``depth``,
    ``parent_conv_id`` (null at the root), ``n_convs``, ``n_children``,
    ``n_leaves`` (childless nodes of the subtree, itself included),
    ``saved_tokens`` (sum over the subtree of (n_convs - 1) times the words of
    the last turn) and ``ends_sha256`` (over the ascending ids that end here).

    ``limit`` is the largest container in rows (paths and depths), which bounds a
    task's memory; it changes no result. A null conversation id counts as a
    member, is no smallest member beside others and is left out of the digest.
    No conversations, no nodes.
    """
    zero = F.lit(0).cast("long")
    h = [F.when(F.col("depth") > 0, F.xxhash64(F.lit(i), "t1", "t2", "depth")).otherwise(zero) for i in (3, 4)]
    xor = (F.bit_xor, lambda a, b: a.bitwiseXOR(b))
    named = paths.withColumns({"h1": h[0], "h2": h[1]})
    rows = cut_lineage(running(named, "conv_id", "depth", {f"p{i}": (xor[0], F.col(f"h{i}"), xor[1]) for i in (1, 2)}))
    up = [F.col(f"p{i}").bitwiseXOR(F.col(f"h{i}")).alias(f"q{i}") for i in (1, 2)]

    # Would-be containers over the limit burst: their heads are trie nodes.
    heads = cut_lineage(
        rows.groupBy("p1", "p2").agg(
            F.count("*").alias("n_convs"), F.min("conv_id").alias("rep"), F.min("depth").alias("depth"),
            F.max("words").alias("words"), *[F.max(u).alias(n) for u, n in zip(up, ("q1", "q2"))],
            F.sum(F.col("n_turns") - F.col("depth") + 1).alias("size"))
        .where(F.col("size") > limit).drop("size"))
    known = broadcast_if_small(heads.select("p1", "p2", F.lit(True).alias("burst")), 500_000)
    flagged = rows.join(known, ["p1", "p2"], "left")

    # What hangs under them: one sorted suffix per conversation, at most limit rows a container.
    tail = flagged.where("burst is null")
    suffix = tail.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("depth", "t1", "t2", "words"))).alias("s"),
        F.min(F.struct("depth", "p1", "p2", *up)).alias("head"))
    dealt = suffix.select(
        "head.p1", "head.p2", "head.q1", "head.q2", "conv_id", F.col("head.depth").alias("start"),
        F.transform("s", lambda x: F.struct(x["t1"].alias("t1"), x["t2"].alias("t2"))).alias("ids"),
        F.transform("s", lambda x: x["words"]).alias("words"))
    swept = cut_lineage(dealt.repartition("p1", "p2").sortWithinPartitions("p1", "p2", "ids", "conv_id")
                        .mapInArrow(_sweep, SWEPT))
    tops = swept.where("top")

    # Heads: children are counted by parent; subtree sums are suffix sums along
    # the path of each node's smallest member, added up per prefix.
    has_parent = heads.where("depth > 0").select("q1", "q2").unionByName(tops.where("depth > 0").select("q1", "q2"))
    children = has_parent.groupBy(F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("n_children"))
    inner = cut_lineage(heads.join(children, ["p1", "p2"], "left").fillna(0, ["n_children"]))
    adds = inner.select(F.col("rep").alias("conv_id"), "depth", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
                        F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves")) \
        .unionByName(tops.select("conv_id", "depth", F.col("saved_tokens").alias("saved"), F.col("n_leaves").alias("leaves")))
    on_path = flagged.where("burst").select("conv_id", "depth", "n_turns", "p1", "p2")
    bearers = adds.select(F.col("conv_id").alias("_c")).distinct()
    path = on_path.join(bearers, F.col("conv_id").eqNullSafe(F.col("_c")), "left_semi")
    steps = (adds.withColumns({"p1": F.lit(None).cast("long"), "p2": F.lit(None).cast("long")})
             .unionByName(path.select("conv_id", "depth", zero.alias("saved"), zero.alias("leaves"), "p1", "p2"))
             .groupBy("conv_id", (-F.col("depth")).alias("back"))
             .agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"), F.max("p1").alias("p1"),
                  F.max("p2").alias("p2")))
    plus = (F.sum, lambda a, b: a + b)
    below = running(steps, "conv_id", "back", {"s": (plus[0], F.col("saved"), plus[1]), "l": (plus[0], F.col("leaves"), plus[1])})
    sums = below.where("p1 is not null").groupBy("p1", "p2").agg(F.sum("s").alias("saved_tokens"), F.sum("l").alias("n_leaves"))
    digests = _digests_of_heads(on_path.where("depth = n_turns"))
    trie = (inner.join(sums, ["p1", "p2"], "left").join(digests, ["p1", "p2"], "left")
            .withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
            .select(F.col("rep").alias("conv_id"), "depth", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    "ends_sha256", "q1", "q2"))
    parents = heads.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("rep").alias("parent_conv_id"))
    outer = trie.unionByName(tops.select(*trie.columns))
    linked = outer.join(parents, ["q1", "q2"], "left").withColumn(
        "parent_conv_id", F.when(F.col("depth") > 0, F.col("parent_conv_id")))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return linked.select(*columns).unionByName(swept.where("not top").select(*columns))


def prefix_trie(turns: DataFrame, rebuilt: bool = True, limit: int = 4096) -> DataFrame:
    """The trie of ``turns`` (conv_id, turn, role, text); with ``rebuilt`` of the
    conversations as ``rebuild`` joins them, else as they stand. Other columns
    are not read; repeated turns are ordered by role and content. See
    ``build_trie``."""
    rows = turn_rows(turns)
    if rebuilt:
        return build_trie(rebuild(rows), limit)
    n = rows.groupBy(F.col("conv_id").alias("_c")).agg(F.count("*").alias("n_turns"))
    zero = F.lit(0).cast("long")
    paths = rows.join(n, F.col("conv_id").eqNullSafe(F.col("_c"))).select(
        "conv_id", (F.col("pos") + 1).alias("depth"), "n_turns", "t1", "t2", "words")
    root = n.select(F.col("_c").alias("conv_id"), zero.alias("depth"), "n_turns", zero.alias("t1"), zero.alias("t2"),
                    zero.alias("words"))
    return build_trie(paths.unionByName(root), limit)
