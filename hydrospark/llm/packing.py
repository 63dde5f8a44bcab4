"""Conflict-constrained best-fit packing of documents into training sequences.

Bins are ordered by residual capacity and carry bitmaps of the sources and
duplicate clusters in them. A piece goes to the tightest bin that can take it
and shares neither its source nor its cluster: the successor search starts at
the first bin with enough room and continues until a compatible one is found.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrospark.llm.common import cut_lineage
from hydrospark.llm.near_copies import near_copy_clusters

CAPACITY = 8192


class Packer:
    """Best fit over one shard, online in the order of ``add``.

    Bins of equal residual and equal bitmaps are interchangeable for the
    constraint, so they are kept as stacks; the search visits a residual once
    per different pair of bitmaps, not once per bin.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.bins: list[list] = []        # members of each bin
        self.residuals: list[int] = []    # occurring residuals of open bins, ascending
        self.at: dict[int, dict[tuple[int, int], list[int]]] = {}  # residual -> bitmaps -> bins, smallest first

    def add(self, item, length: int, source_bit: int, cluster_bit: int) -> int:
        for i in range(bisect_left(self.residuals, length), len(self.residuals)):
            room = self.residuals[i]
            groups = self.at[room]
            fits = [(g[0], maps) for maps, g in groups.items()
                    if not maps[0] & source_bit and not maps[1] & cluster_bit]
            if fits:
                number, maps = min(fits)
                groups[maps].pop(0)
                if not groups[maps]:
                    del groups[maps]
                if not groups:
                    del self.at[room]
                    del self.residuals[i]
                self.bins[number].append(item)
                self._open(number, room - length, (maps[0] | source_bit, maps[1] | cluster_bit))
                return number
        self.bins.append([item])
        self._open(len(self.bins) - 1, self.capacity - length, (source_bit, cluster_bit))
        return len(self.bins) - 1

    def _open(self, number: int, room: int, maps: tuple[int, int]) -> None:
        if room <= 0:
            return
        if room not in self.at:
            insort(self.residuals, room)
            self.at[room] = {}
        insort(self.at[room].setdefault(maps, []), number)


def _bits(values: list, shared_only: bool) -> list[int]:
    """A bit per different value; with ``shared_only`` none for values that occur once."""
    counts: dict = {}
    for v in values:
        counts[v] = counts.get(v, 0) + 1
    place: dict = {}
    return [1 << place.setdefault(v, len(place)) if counts[v] > 1 or not shared_only else 0 for v in values]


def pack_shard(pieces: list[tuple], capacity: int) -> list[list[int]]:
    """Bins (lists of positions in ``pieces``) for pieces (length, source,
    cluster), packed in the given order. Full pieces are bins of their own."""
    packer = Packer(capacity)
    sources = _bits([p[1] for p in pieces], False)
    clusters = _bits([p[2] for p in pieces], True)
    for i, p in enumerate(pieces):
        packer.add(i, p[0], sources[i], clusters[i])
    return packer.bins


def pack(docs: DataFrame, length: Column, cluster: Column, id_col: str = "doc_id", source_col: str = "source",
         capacity: int = CAPACITY, shard_rows: int = 8192) -> DataFrame:
    """One row per bin: ``bin_id`` (string), ``doc_ids``, ``starts``,
    ``lengths`` (arrays, one entry per piece), ``used``, ``residual``.

    A document longer than ``capacity`` is cut into pieces of ``capacity`` and a
    rest; no piece is lost. No bin holds two pieces of one source or of one
    cluster (pieces of one document always share both). A null source is a
    source of its own, a null cluster conflicts with nothing. Documents of
    null length or length 0 take no room and stand in no bin. Repeated rows are
    packed each. Other columns are ignored; an empty table gives no bins.

    Pieces are dealt at random into shards of about ``shard_rows`` pieces, so
    every shard has the sources in the same mix and a hot source costs no task
    more than the others; each shard is packed on its own, longest pieces first.
    A search over all bins is one shard (``shard_rows`` as large as the table).
    ``bin_id`` names a shard's bin or, of a full piece, its row's number, so it is
    unique whatever the ids.
    Texts are never moved: only ids, lengths, sources and clusters are.
    """
    import pandas as pd

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), length.cast("long").alias("n"),
                       F.col(f"`{source_col}`").cast("string").alias("source"), cluster.cast("long").alias("cluster"))
    # Numbered, as ids may repeat or be null: the number deals a row's pieces, not its id.
    rows = cut_lineage(rows.where("n > 0").withColumn("row", F.monotonically_increasing_id()))
    starts = F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(capacity).cast("long"))
    pieces = rows.withColumn("start", F.explode(starts)).withColumn(
        "len", F.least(F.lit(capacity), F.col("n") - F.col("start")))
    # Full pieces are bins already.
    whole = pieces.where(F.col("len") == capacity).select(
        F.concat_ws(":", F.lit("full"), F.col("row").cast("string"), F.col("start").cast("string")).alias("bin_id"),
        F.array("doc").alias("doc_ids"), F.array("start").alias("starts"), F.array("len").alias("lengths"))
    rest = pieces.where(F.col("len") < capacity)
    shards = max(1, -(-rest.count() // shard_rows))
    rest = rest.select("doc", "start", "len", "source", "cluster",
                       F.pmod(F.xxhash64("row", "start", F.lit(1)), F.lit(shards)).cast("int").alias("shard"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["len", "doc", "start", "source", "cluster"], ascending=[False, True, True, True, True],
                              kind="stable", na_position="last").reset_index(drop=True)
        source = pdf["source"].astype(object).where(pdf["source"].notna(), None).tolist()
        cluster = [("alone", i) if pd.isna(c) else int(c) for i, c in enumerate(pdf["cluster"])]
        bins = pack_shard(list(zip(pdf["len"].tolist(), source, cluster, strict=True)), capacity)
        doc = [None if pd.isna(d) else int(d) for d in pdf["doc"]]
        start, size = pdf["start"].tolist(), pdf["len"].tolist()
        return pd.DataFrame({
            "bin_id": [f"{key[0]}:{k}" for k in range(len(bins))], "doc_ids": [[doc[i] for i in b] for b in bins],
            "starts": [[start[i] for i in b] for b in bins], "lengths": [[size[i] for i in b] for b in bins]})

    mixed = rest.groupBy("shard").applyInPandas(
        run, "bin_id string, doc_ids array<long>, starts array<long>, lengths array<long>")
    used = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    return whole.unionByName(mixed).withColumn("used", used).withColumn("residual", F.lit(capacity) - F.col("used"))


def byte_tokens(text: Column) -> Column:
    """Length in tokens of a byte vocabulary: one per UTF-8 byte of the whole text (null: 0)."""
    return F.coalesce(F.octet_length(text), F.lit(0))


def _normal(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(text), r"\s+", " "))


def copy_cluster(text: Column) -> Column:
    """Cluster of texts that are equal up to letter case and white space."""
    return F.xxhash64(_normal(text))


def pack_texts(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source",
               **limits) -> DataFrame:
    """``pack`` in bytes, with the near copies among the texts (exact ones
    included) as the duplicate clusters."""
    text = F.col(f"`{text_col}`")
    carry = [F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), byte_tokens(text).alias("n")]
    rows = near_copy_clusters(docs.where(byte_tokens(text) > 0), copy_cluster(text), _normal(text), carry)
    return pack(rows, F.col("n"), F.col("cluster"), **limits)
