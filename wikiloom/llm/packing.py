"""Filling containers of fixed capacity with items of varying length.

Variable-capacity best-fit, worked out on the histogram of sizes: sizes are whole numbers up to the capacity, so the
driver sees at most ``capacity`` counts, however many items there are. Sizes are placed from the largest down, each in
the fullest containers that still have room, whole ranges of equal containers at a time; where none has room, new ones
of the least-cost permitted size are opened: least by cost for each token that such a container can get of what is still
to be placed. At the end each container shrinks to the smallest permitted size that holds its contents. The outcome is a list of placements (items number a..b of size s go to containers c..d), again of a size
that does not depend on the number of items; items are numbered within their size by a two-step count over salted
groups, and meet their placement in a broadcast join.
"""

from __future__ import annotations

import base64
import bisect
import os
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from wikiloom.session import materialize

CAPACITY = 2048
#: File of the public tokenizer: ``.tiktoken`` ranks of a byte-level BPE, or a ``.json`` of the tokenizers library.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how that tokenizer splits text before it merges bytes.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Items that are numbered in one sorted group.
PER_GROUP = 500_000
PLACEMENTS = "size int, first_rank bigint, n bigint, first_container bigint, container_capacity int"


def fewest(capacity: int) -> float:
    """Every container costs the same: their number is the aim, and of equally good sizes the smallest is opened."""
    return 1.0


def attention(capacity: int, width: int = 4096, each: int = 64) -> float:
    """Work of a training step over one sequence of this length, padding included, in tokens: a linear part, a quadratic
    one that equals it at ``width``, and a fixed part for each sequence."""
    return capacity + capacity * capacity / width + each


def plan_containers(counts: dict[int, int], capacities: Sequence[int], cost: Callable[[int], float] | None = None) -> tuple[list[tuple], list[tuple]]:
    """Placements (size, first rank, n, first container) and containers (first, n, used, capacity).

    ``cost`` of a container by its permitted size, by default :func:`fewest`. Both lists grow with the number of sizes.
    """
    caps = sorted(capacities)
    cost = cost or fewest
    left_over = {s: n for s, n in counts.items() if s > 0}
    room: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # room left -> (first, n, opened capacity)
    open_rooms: list[int] = []
    placements: list[tuple] = []
    fresh = 0

    def put(left: int, group: tuple) -> None:
        if not room[left]:
            bisect.insort(open_rooms, left)
        room[left].append(group)

    for size in sorted(left_over, reverse=True):
        todo, rank = counts[size], 0
        while todo:
            at = bisect.bisect_left(open_rooms, size)
            if at < len(open_rooms):
                left = open_rooms[at]
                first, n, cap = room[left].pop()
                if not room[left]:
                    open_rooms.pop(at)
                used = min(n, todo)
                if used < n:
                    put(left, (first + used, n - used, cap))
            else:
                cap = min((c for c in caps if c >= size), key=lambda c: (cost(c) / _fill(left_over, size, c), c))
                left, first = cap, fresh
                used = _alike(left_over, size, cap)
                fresh += used
            placements.append((size, rank, used, first))
            put(left - size, (first, used, cap))
            todo -= used
            rank += used
            left_over[size] -= used
    containers = [(first, n, cap - left, min(c for c in caps if c >= cap - left)) for left, groups in room.items() for first, n, cap in groups]
    return placements, sorted(containers)


def _fill(counts: dict[int, int], size: int, capacity: int) -> int:
    """Tokens that a container of this capacity can hold of an item and the sizes up to it."""
    held, left = size, capacity - size
    for s in sorted((s for s in counts if 0 < s <= min(size, left)), reverse=True):
        k = min(left // s, counts[s] - (s == size))
        held, left = held + k * s, left - k * s
        if not left:
            break
    return held


def _alike(counts: dict[int, int], size: int, capacity: int) -> int:
    """How many containers to open at once: as many as items of this size fill, the last ones left to be decided anew."""
    whole = counts[size] // (capacity // size)
    return max(1, whole - (whole > 1))


@lru_cache(maxsize=2)
def token_counter(path: str, pattern: str = PATTERN) -> Callable[[list[str]], list[int]]:
    """Counts the tokens of texts; loaded once per worker. Special tokens in a text count as ordinary text."""
    if path.endswith(".json"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.encode_special_tokens = True
        return lambda texts: [len(e.ids) for e in model.encode_batch(texts, add_special_tokens=False)]
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    encoding = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [len(encoding.encode_ordinary(t)) for t in texts]


def token_counts(df: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, tokens) with the public tokenizer in the file ``tokenizer``, which all executors must have; NULL has none."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counter(tokenizer)
        for batch in batches:
            texts = batch.column(1)
            sizes = []
            for a in range(0, len(texts), 256):
                sizes += count([t or "" for t in texts[a : a + 256].to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=[key, "tokens"])

    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, tokens bigint")


def pack(sizes: DataFrame, key: str, capacity: int = CAPACITY, permitted: Sequence[int] = (256, 512, 1024, 2048), cost: Callable[[int], float] | None = None, per_group: int = PER_GROUP) -> DataFrame:
    """(key, part, first_token, tokens, container, container_capacity) of sizes(key, tokens), one row per piece.

    An item longer than ``capacity`` is cut into pieces of the capacity and a rest; no other is. Items without tokens
    (and NULL sizes) come out with no container. Rows are items, so equal rows are packed each on its own; NULL keys are
    packed like others; an empty table gives no rows; further columns are ignored.
    """
    spark = sizes.sparkSession
    permitted = sorted({c for c in permitted if c < capacity} | {capacity})
    whole = F.coalesce(F.col("tokens").cast("bigint"), F.lit(0))
    parts = F.greatest(F.ceil(whole / capacity).cast("int"), F.lit(1))
    rows = sizes.select(F.col(key), whole.alias("whole"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    size = F.least(F.lit(capacity), F.col("whole") - F.col("part").cast("bigint") * capacity).cast("int")
    rows = materialize(rows.select(key, "part", size.alias("size")))
    salts = max(16, -(-rows.count() // per_group))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64(key, "part"), F.lit(salts)).cast("int"))
    groups = rows.where("size > 0").groupBy("size", "salt").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("size").orderBy("salt")
    groups = materialize(groups.select("size", "salt", "n", (F.sum("n").over(ahead) - F.col("n")).alias("ahead")))
    counts = {r[0]: r[1] for r in groups.groupBy("size").agg(F.sum("n")).collect()}
    placements, containers = plan_containers(counts, permitted, cost)
    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy("size", "salt").orderBy(key, "part")) - 1)
    ranked = ranked.join(groups.drop("n"), ["size", "salt"], "left").withColumn("rank", F.col("rn") + F.col("ahead"))
    where = spark.createDataFrame(with_capacities(placements, containers), PLACEMENTS)
    placed = ranked.join(
        F.broadcast(where.withColumnRenamed("size", "s")),
        (F.col("size") == F.col("s")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("n")),
        "left",
    ).withColumn("container", F.col("first_container") + F.col("rank") - F.col("first_rank"))
    return placed.select(key, "part", (F.col("part").cast("bigint") * capacity).alias("first_token"), F.col("size").alias("tokens"), "container", "container_capacity")


def with_capacities(placements: list[tuple], containers: list[tuple]) -> list[tuple]:
    """Placements cut where the final capacity of their containers changes, with that capacity."""
    starts, out = [c[0] for c in containers], []
    for size, rank, n, first in placements:
        at, end = bisect.bisect_right(starts, first) - 1, first + n
        while first < end:
            low, many, _, cap = containers[at]
            k = min(end, low + many) - first
            out.append((size, rank, k, first, cap))
            first, rank, at = first + k, rank + k, at + 1
    return out


def lengths_used(packed: DataFrame) -> DataFrame:
    """(container_capacity, containers, tokens, capacity_tokens) of packed rows: what is filled, and what is paid for."""
    each = packed.where("container IS NOT NULL").groupBy("container", "container_capacity").agg(F.sum("tokens").alias("tokens"))
    return each.groupBy("container_capacity").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.sum(F.col("container_capacity").cast("bigint")).alias("capacity_tokens"))
