"""Mixing sources to target weights, in tokens of a public tokenizer.

1. Each document of a source in the targets is tokenised once.  The documents of a source
   stand one after another in a pseudorandom order, each closed by a separator token, and
   are cut into blocks of ``block`` tokens; the last block of a source may be shorter.
2. The size of the mixture is the largest at which every source that has documents can
   give its share without passing its repeats.  Each source gets a quota of slots; each
   output shard draws its source counts from a multinomial given those quotas, so that the
   totals come out as they must.
3. The k-th slot of a source takes the block ``permutation(k mod blocks)`` of its epoch
   ``k div blocks``; every epoch has its own pseudorandom permutation of the indices (a
   Feistel network with cycle walking), so no block, and hence no document, is used more
   often than there are epochs.
4. Slots and blocks are joined by (source, index).

Order, draws and permutations depend on ``seed`` only, never on the partitioning.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuschain.runtime import Scratch

#: How texts are cut before byte pairs are merged, where the folder has no module that says so.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class Settings:
    """``vocabulary``: a tiktoken rank file in ``folder`` with ids below 65,535; the first id after all of its own
    closes each document.  ``pattern``: how the vocabulary's texts are cut.  ``shard``: slots of a shard.
    ``group``: shards whose quotas the driver draws together; the tasks draw within them, one task for each group."""

    folder: str = "/opt/tokenizers"
    vocabulary: str = "byte_bpe_multi_50k.tiktoken"
    pattern: str = PATTERN
    block: int = 512
    shard: int = 256
    group: int = 64
    seed: int = 17


def source_key(source: Column) -> Column:
    """One spelling for a source: lower case, no outer spaces, and one underscore for spaces, hyphens and dots inside."""
    return F.regexp_replace(F.trim(F.lower(source)), r"[\s\-._]+", "_")


@lru_cache(maxsize=2)
def tokenizer(folder: str, vocabulary: str, pattern: str):
    """The encoding, and the id that closes a document: the first that no token has."""
    import tiktoken

    with (Path(folder) / vocabulary).open("rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    separator = max(ranks.values()) + 1
    if separator > 65_535:
        raise ValueError(f"{vocabulary} has ids up to {separator - 1}; tokens are packed in 16 bits, with one id left for the separator")
    return tiktoken.Encoding("mixture", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), separator


def encode(text: str, s: Settings) -> np.ndarray:
    """The tokens of a text, whole, and the separator.  A long text is encoded in pieces that end where a word begins, which no token crosses."""
    enc, separator = tokenizer(s.folder, s.vocabulary, s.pattern)
    text = text.encode("utf-8", "surrogatepass").decode("utf-8", "replace")
    ids: list[int] = []
    start = 0
    while len(text) - start > 100_000:
        end = text.rfind(" ", start + 1, start + 100_000)
        end = end if end > start and not text[end - 1].isspace() else start + 100_000
        ids += enc.encode_ordinary(text[start:end])
        start = end
    ids += enc.encode_ordinary(text[start:])
    return np.array([*ids, separator], dtype="<u2")


def unpack(tokens: bytes) -> list[int]:
    """Token ids of a ``tokens`` value."""
    return np.frombuffer(tokens, dtype="<u2").tolist()


def tokenised(docs: DataFrame, doc_id: str, text: str, source: str, targets: DataFrame, s: Settings) -> DataFrame:
    """(source, h, doc, tokens): the non-blank documents of the sources in ``targets``; h is the pseudorandom order."""
    wanted = targets.select(source_key(F.col("source")).alias("source")).where(F.col("source").isNotNull()).distinct()
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc"), F.col(text).cast("string").alias("t"), source_key(F.col(source)).alias("source"))
    rows = rows.where(F.col("t").isNotNull() & F.col("t").rlike(r"\S")).join(wanted, "source", "left_semi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"source": b["source"], "doc": b["doc"], "tokens": [encode(t, s).tobytes() for t in b["t"]]})

    return rows.select("source", "doc", "t").mapInPandas(run, "source string, doc bigint, tokens binary").select("source", F.xxhash64("doc", F.lit(s.seed)).alias("h"), "doc", "tokens")


def pack(tokens: DataFrame, scratch: Scratch, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(pieces, sizes): the parts of documents in each block (source, block, at, tokens), and (source, n_tokens, n_docs).

    Documents are range-partitioned by (source, h), so a large source spreads over many
    partitions; each partition counts from 0, and the totals of the partitions before it, one
    row for each partition and source that meet, give its start.
    """

    def along(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        upto: dict[str, int] = {}
        for b in batches:
            at = []
            for source, t in zip(b["source"], b["tokens"], strict=True):
                at.append(upto.get(source, 0))
                upto[source] = at[-1] + len(t) // 2
            b["at"] = at
            yield b

    ordered = tokens.repartitionByRange("source", "h", "doc").sortWithinPartitions("source", "h", "doc").withColumn("part", F.spark_partition_id())
    placed = scratch.cut(ordered.mapInPandas(along, "source string, h bigint, doc bigint, tokens binary, part int, at bigint"), "placed")
    n = (F.octet_length("tokens") / 2).cast("bigint")
    totals = placed.groupBy("source", "part").agg(F.sum(n).alias("n"), F.count(F.lit(1)).alias("docs"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("source", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    sizes = totals.groupBy("source").agg(F.sum("n").alias("n_tokens"), F.sum("docs").alias("n_docs"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        width = 2 * s.block
        for b in batches:
            out = []
            for source, first, t in zip(b["source"], b["first"], b["tokens"], strict=True):
                at, t = 2 * int(first), bytes(t)
                done = 0
                while done < len(t):
                    block, inside = divmod(at + done, width)
                    take = min(width - inside, len(t) - done)
                    out.append((source, block, inside, t[done : done + take]))
                    done += take
            yield pd.DataFrame(out, columns=["source", "block", "at", "tokens"])

    located = placed.join(starts, ["source", "part"]).select("source", (F.col("start") + F.col("at")).alias("first"), "tokens")
    return located.mapInPandas(cut, "source string, block bigint, at int, tokens binary"), sizes


def quotas(targets: list[tuple[str, float, int]], sizes: dict[str, int], block: int) -> list[tuple[str, int, int, int]]:
    """(source, blocks, slots, repeats): how many slots each source gets.

    The total is the largest at which no source with documents passes ``repeats`` uses of its
    blocks; shares of sources without documents go to the others in proportion.  Shares that
    are null, not positive or not finite, and repeats under 1, count as 0.
    """
    usable = [(s, w, r, sizes[s]) for s, w, r in targets if sizes.get(s) and w and np.isfinite(w) and w > 0 and r and r >= 1]
    if not usable:
        return []
    whole = sum(w for _, w, _, _ in usable)
    total = min(n * r * whole / w for _, w, r, n in usable)
    out = []
    for source, w, r, n in usable:
        blocks = -(-n // block)
        mean = n / blocks  # the last block is shorter
        out.append((source, blocks, min(blocks * r, round(total * w / whole / mean)), r))
    return out


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(n), at the given indices: four Feistel rounds with cycle walking."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(xxhash.xxh64_intdigest(f"{key}:{i}")) for i in range(4)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        with np.errstate(over="ignore"):
            for k in keys:
                f = (right + k) * np.uint64(0x9E3779B97F4A7C15)
                f ^= f >> np.uint64(29)
                f *= np.uint64(0xBF58476D1CE4E5B9)
                left, right = right, left ^ ((f >> np.uint64(32)) & mask)
        return (left << np.uint64(half)) | right

    x = once(index.astype(np.uint64))
    while (out := x >= n).any():
        x[out] = once(x[out])
    return x.astype(np.int64)


def draw(rng: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    """Counts of n slots: a multinomial in the proportions of ``left``, given that no count passes it."""
    return rng.multivariate_hypergeometric(left, n, method="marginals")


def slots(spark, plan: list[tuple[str, int, int, int]], s: Settings) -> DataFrame:
    """(shard, slot, source, epoch, block) for every slot of the mixture."""
    schema = "shard bigint, slot int, source string, epoch int, block bigint"
    total = sum(q for _, _, q, _ in plan)
    if not total:
        return spark.createDataFrame([], schema)
    shards = -(-total // s.shard)
    groups = -(-shards // s.group)
    rng = np.random.default_rng(s.seed)
    left, rows, first = np.array([q for _, _, q, _ in plan], dtype=np.int64), [], 0
    quota = left.copy()
    for g in range(groups):  # the driver's part: one draw for each s.group * s.shard slots
        last = shards * (g + 1) // groups
        n = min(s.shard * (last - first), int(left.sum()))
        own = draw(rng, left, n)
        rows.append((g, first, last, own.tolist(), (quota - left).tolist()))
        left, first = left - own, last

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for g, first, last, own, used in zip(b["g"], b["first"], b["last"], b["own"], b["used"], strict=True):
                rng = np.random.default_rng([s.seed, int(g)])
                own, used = np.array(own, dtype=np.int64), np.array(used, dtype=np.int64)
                for shard in range(first, last):
                    n = min(s.shard, int(own.sum()))
                    count = draw(rng, own, n)
                    which = rng.permutation(np.repeat(np.arange(len(plan)), count))
                    block, epoch = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
                    for i, (source, blocks, _, _) in enumerate(plan):
                        if count[i]:
                            k = used[i] + np.arange(count[i])
                            e = k // blocks
                            at = np.empty(count[i], dtype=np.int64)
                            for one in np.unique(e):
                                at[e == one] = permuted(k[e == one] % blocks, blocks, xxhash.xxh64_intdigest(f"{s.seed}:{source}:{one}"))
                            block[which == i], epoch[which == i] = at, e
                    own, used = own - count, used + count
                    yield pd.DataFrame({"shard": shard, "slot": np.arange(n), "source": [plan[i][0] for i in which], "epoch": epoch, "block": block})

    groups_df = spark.createDataFrame(rows, "g int, first bigint, last bigint, own array<bigint>, used array<bigint>")
    return groups_df.repartition(groups, "g").mapInPandas(fill, schema)


def mixture(docs: DataFrame, doc_id: str, text: str, source: str, targets: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(mixed, report).

    ``mixed``: (shard, slot, source, epoch, block, n_tokens, tokens), tokens packed as
    little-endian 16-bit ids (``unpack``).  ``report``: for each target source its target share,
    documents and tokens at hand, tokens and share in the mixture, and how often its
    blocks were used at most.

    ``targets`` has (source, target_share, max_repeats).  Spellings of a source are one
    (``source_key``).  Null and blank texts have no tokens.  Repeated target rows of a source
    add up, with the smallest max_repeats.  No usable document gives an empty mixture.
    """
    s, spark = settings, docs.sparkSession
    scratch = Scratch(spark, "mixture")
    wanted = targets.where(F.col("source").isNotNull()).groupBy(source_key(F.col("source")).alias("source")).agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    tokens = scratch.cut(tokenised(docs, doc_id, text, source, targets, s), "tokens")
    pieces, sizes = pack(tokens, scratch, s)
    scratch.drop_all(["tokens"])  # written again, in order
    sizes = scratch.cut(sizes, "sizes")
    # one row for each target source: the list that the caller wrote
    plan = quotas([tuple(r) for r in wanted.orderBy("source").collect()], {r["source"]: r["n_tokens"] for r in sizes.collect()}, s.block)
    chosen = scratch.cut(slots(spark, plan, s), "slots")
    parts = F.array_sort(F.collect_list(F.struct("at", "tokens")))
    blocks = pieces.groupBy("source", "block").agg(parts.alias("parts")).select(
        "source", "block", F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["tokens"])).alias("tokens")
    )
    mixed = chosen.join(blocks, ["source", "block"]).select("shard", "slot", "source", "epoch", "block", (F.octet_length("tokens") / 2).cast("int").alias("n_tokens"), "tokens")
    return mixed, _report(chosen, wanted, sizes, s)


def _report(chosen: DataFrame, wanted: DataFrame, sizes: DataFrame, s: Settings) -> DataFrame:
    """From the slots alone: every block but the last of its source has ``block`` tokens."""
    length = F.least(F.lit(s.block), F.col("n_tokens") - F.col("block") * s.block)
    used = chosen.join(sizes, "source").groupBy("source").agg(F.sum(length).alias("mixed_tokens"), F.count(F.lit(1)).alias("n_slots"), F.max(F.col("epoch") + 1).alias("most_uses"))
    everything = used.agg(F.sum("mixed_tokens")).scalar()
    return wanted.join(sizes, "source", "left").join(used, "source", "left").select(
        "source", F.round("target_share", 6).alias("target_share"), "max_repeats",
        F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"),
        F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"), F.coalesce("n_slots", F.lit(0)).alias("n_slots"),
        F.coalesce(F.round(F.col("mixed_tokens") / everything, 6), F.lit(0.0)).alias("share"),
        F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
    )
