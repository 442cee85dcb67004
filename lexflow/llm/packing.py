"""Filling fixed-capacity containers with texts sized in tokens.

The sizes of all texts form a length histogram (at most one bin per length up to the
capacity, however many rows there are). Over it the configuration linear program is solved by
multiplicative weights: the more of a length is covered, the lower its price; a knapsack
dynamic program prices the contents of a container; and every round adds contents that reach
the program's best value, for what their lengths still lack. Rounds go on until the
fractional solution lies within ``GAP`` of the bound that the prices prove. It is then
rounded: whole containers first, then one container for each fraction, whose used-up items
are exchanged for those the prices value most; what is left is a smaller program of the same
kind. The shortest pieces (``HELD`` of all tokens) take no part: they fill the room that the
contents leave, as in the classic scheme for this program. Only the last rest is placed
first-fit. The plan is joined back to the texts by their rank within their length.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import bounded_rows, broadcast_if_small, cut_lineage

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
GAP = 0.01  # between a fractional solution and the bound of its prices
PARTS = 8  # rounds in which the demand is covered, before the rounds for what is short
FEWER = 0.9  # what is short sinks at least so far in a further round, or no more rounds follow
DISCOUNT = 0.02  # of a price, where its length is covered one part more
BATCH = 64  # contents that are made at once
HELD = 0.006  # of all tokens, in the shortest pieces, to fill up containers
ROOM = 0.008  # of a container that its content may leave to them
LEAST_LEFT = 0.005  # of all tokens; so few are not solved for again
ROWS_PER_SALT = 50_000
BLOCK = 4096  # ranks of a length that one row of the plan covers at most
MOST_CAPACITIES = 1_000  # container sizes
FEW = 500_000  # narrow rows of a lookup that is broadcast


@lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id``, ``n_tokens`` of each distinct document id; a null or empty text has 0 tokens, a null id is left out.

    A document id that is repeated counts once, with its longest text. Exact copies of a text
    within an Arrow batch are tokenised once.
    """

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoding(tokenizer).encode_ordinary
        for batch in batches:
            seen: dict[str, int] = {}
            out = np.zeros(len(batch), dtype=np.int32)
            for i, t in enumerate(batch):
                if t:
                    n = seen.get(t)
                    if n is None:
                        n = seen[t] = len(encode(t))
                    out[i] = n
            yield pd.Series(out)

    own = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), count(F.col(text)).alias("n_tokens")).where("doc_id is not null")
    return own.groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))


def best_values(values: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The greatest value of items that fit into each room up to ``capacity``; sizes ascend, items may repeat."""
    best = np.zeros(capacity + 1)
    upto = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for room in range(int(sizes[0]), capacity + 1):
        k = upto[room]
        best[room] = max(best[room - 1], (values[:k] + best[room - sizes[:k]]).max())
    return best


def full_contents(first: np.ndarray, values: np.ndarray, sizes: np.ndarray, best: np.ndarray, limit: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A content for each item of ``first``: that item, and others that bring the rest of the room to its best value.

    Item counts stay within ``limit``. Among contents of nearly equal value chance decides, so
    that a batch spreads over the items, the longer ones a little before the shorter ones.
    """
    capacity, live = len(best) - 1, np.arange(len(first))
    count = np.zeros((len(first), len(sizes)), np.int64)
    count[live, first] = 1
    room = capacity - sizes[first]
    wish = values * (1 + DISCOUNT / 2 * rng.random(count.shape) + DISCOUNT * sizes / capacity)
    wish[:, limit <= 0] = -np.inf
    once = limit[first] <= 1
    wish[live[once], first[once]] = -np.inf
    while len(live):
        upto = int(np.searchsorted(sizes, room[live].max(), "right"))
        if not upto:
            break
        rest = room[live, None] - sizes[:upto]
        gain = np.where(rest >= 0, wish[live, :upto] + best[rest], -np.inf)
        pick = gain.argmax(1)
        some = gain[np.arange(len(live)), pick] > -np.inf
        live, pick = live[some], pick[some]
        count[live, pick] += 1
        used = count[live, pick] >= limit[pick]
        wish[live[used], pick[used]] = -np.inf
        room[live] -= sizes[pick]
    return count


def fractional_solution(lengths: np.ndarray, demand: np.ndarray, capacity: int, rng: np.random.Generator):
    """Contents with the (fractional) number of containers of each, the prices, their best values, the bound, and the gap.

    Round by round a further part of each demand is covered; no length is covered by more
    than half a part beyond that, and in the end hardly at all beyond its demand. What stays
    short counts with containers of that length alone, so the gap is that of a solution that
    meets all demand. The bound holds for every price: demand at these prices over the value
    of the best content.
    """
    need, covered, pool = demand.astype(float), np.zeros(len(lengths)), {}
    bound, total, last, turn = 0.0, 0.0, np.inf, 0
    while True:
        turn += 1
        over = covered / need * PARTS
        prices = lengths * np.exp(-DISCOUNT * (over - over.min()))
        best = best_values(prices, lengths, capacity)
        bound = max(bound, float((prices * need).sum()) / best[-1])
        target = need * min(1.0, turn / PARTS)
        most = np.minimum(target + need / PARTS / 2, need * (1 + 0.4 * GAP))
        for _ in range(PARTS):
            short = np.maximum(target - covered, 0)
            wanted = np.flatnonzero(short > 0.05 * need / PARTS)
            if not len(wanted):
                break
            first = wanted[np.lexsort((rng.random(len(wanted)), -np.round(short / need, 3)[wanted]))[:BATCH]]
            limit = np.where(covered < most * (1 - 1e-9), np.maximum(1, demand), 0)
            for row in full_contents(first, prices * np.where(short > 0, 1 + DISCOUNT, 1), lengths, best, limit, rng):
                on = np.flatnonzero(row)
                k = row[on]
                amount = min(float(((most - covered)[on] / k).min()), float((np.maximum(target - covered, 0)[on] / k).max()))
                if amount > 0:
                    covered[on] += k * amount
                    total += amount
                    key = (on.tobytes(), k.tobytes())
                    pool[key] = pool.get(key, 0.0) + amount
        if turn >= PARTS:
            short = np.maximum(need - covered, 0)
            gap = (total + float((short / (capacity // lengths)).sum())) / bound - 1
            if gap <= GAP or short.sum() > FEWER * last or short.sum() < 1e-3 * need.sum():
                break
            last = short.sum()
    contents = [(np.frombuffer(on, np.int64), np.frombuffer(k, np.int64), amount) for (on, k), amount in pool.items()]
    return contents, prices, best, bound, gap


def program_plan(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[list[tuple[np.ndarray, int]], np.ndarray, float, float]:
    """Whole containers of the rounded program as (content, times), what is left, and the bound and gap of the whole program.

    A content may leave ``ROOM``; where a round of rounding places too little, twice as much.
    """
    rng, left, plan = np.random.default_rng(1), demand.astype(np.int64), []
    room_left, all_tokens, bound, gap = int(ROOM * capacity), int((demand * lengths).sum()), None, None

    def add(on: np.ndarray, k: np.ndarray, times: int) -> None:
        content = np.zeros(len(lengths), np.int64)
        content[on] = k
        left[on] -= times * k
        plan.append((content, times))

    while (left * lengths).sum() > LEAST_LEFT * all_tokens:
        on = np.flatnonzero(left > 0)
        own = lengths[on]
        contents, prices, best, this_bound, this_gap = fractional_solution(own, left[on], capacity, rng)
        if bound is None:
            bound, gap = this_bound, this_gap
        before = int((left * lengths).sum())
        loads = [int((own[a] * k).sum()) for a, k, _ in contents]
        for n in sorted(range(len(contents)), key=lambda n: (-loads[n], -contents[n][2])):
            a, k, amount = contents[n]
            whole = min(int(amount), int((left[on[a]] // k).min()))
            if whole > 0 and loads[n] >= capacity - room_left:
                add(on[a], k, whole)
        if (left * lengths).sum() > before / 2:  # fractions: one container each, fewest and so longest items first
            worth = prices * (1 + DISCOUNT * own / capacity)
            for a, k, _ in sorted(contents, key=lambda c: (int(c[1].sum()), -(c[2] % 1))):
                count = np.zeros(len(own), np.int64)
                count[a] = np.minimum(k, left[on[a]])
                room, free = capacity - int((count * own).sum()), left[on] - count
                if room > capacity / 2:
                    continue
                while room >= own[0]:
                    upto = int(np.searchsorted(own, room, "right"))
                    gain = np.where(free[:upto] > 0, worth[:upto] + best[room - own[:upto]], -1)
                    pick = int(gain.argmax())
                    if gain[pick] < 0:
                        break
                    count[pick] += 1
                    free[pick] -= 1
                    room -= int(own[pick])
                if room <= room_left:
                    used = np.flatnonzero(count)
                    add(on[used], count[used], 1)
        if (left * lengths).sum() > 0.7 * before:
            if room_left > capacity / 50:
                break
            room_left = max(1, 2 * room_left)
    return plan, left, bound or 0.0, gap or 0.0


def filled_up(plan: list[tuple[np.ndarray, int]], lengths: np.ndarray, held: np.ndarray, capacity: int) -> tuple[list[tuple[np.ndarray, int]], np.ndarray]:
    """The plan with held pieces in the room its containers leave, smallest rooms first; and what still has no place."""
    out, held, order = [], held.copy(), np.flatnonzero(held)[::-1]
    for content, times in sorted(plan, key=lambda row: capacity - int((row[0] * lengths).sum())):
        while times > 0:
            extra, room = np.zeros(len(lengths), np.int64), capacity - int((content * lengths).sum())
            for i in order:
                if held[i] > 0 and lengths[i] <= room:
                    extra[i] = min(int(held[i]), room // int(lengths[i]))
                    room -= int(extra[i] * lengths[i])
            used = extra > 0
            if not used.any():
                break
            n = min(times, int((held[used] // extra[used]).min()))
            held[used] -= n * extra[used]
            out.append((content + extra, n))
            times -= n
        if times:
            out.append((content, times))
    return out, held


def first_fit_rest(lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Containers for the last rest: each takes the longest that still fits, again and again.

    Equal containers are counted, not listed, so the work depends on the histogram only.
    """
    order, left, plan = np.argsort(-lengths, kind="stable"), left.copy(), []
    while (left > 0).any():
        content, room = np.zeros(len(lengths), dtype=np.int64), capacity
        for i in order:
            if left[i] > 0 and lengths[i] <= room:
                k = min(int(left[i]), room // int(lengths[i]))
                content[i] = k
                room -= k * int(lengths[i])
        used = content > 0
        times = int((left[used] // content[used]).min())
        left[used] -= content[used] * times
        plan.append((content, times))
    return plan


def configuration_plan(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[list[tuple[np.ndarray, int]], dict[str, float]]:
    """Contents of containers (items per length) and how many containers get each; all demand is met exactly.

    The second value tells the program's ``bound`` and ``gap`` and the shares of pieces and of
    tokens that its own contents place (the others were held to fill them up, or came last).
    """
    demand = demand.astype(np.int64)
    tokens = np.cumsum(lengths * demand)
    held = np.where(tokens <= HELD * tokens[-1], demand, 0)
    on = np.flatnonzero(demand > held)
    part, left, bound, gap = program_plan(lengths[on], (demand - held)[on], capacity)
    rest = np.zeros(len(lengths), np.int64)
    rest[on] = left
    plan = []
    for content, times in part:
        whole = np.zeros(len(lengths), np.int64)
        whole[on] = content
        plan.append((whole, times))
    told = {"bound": bound, "gap": gap, "pieces": 1 - float((rest + held).sum() / demand.sum()), "tokens": 1 - float(((rest + held) * lengths).sum() / tokens[-1])}
    plan, over = filled_up(plan + first_fit_rest(lengths, rest, capacity), lengths, held, capacity)
    return plan + first_fit_rest(lengths, over, capacity), told


def _slots(capacity_id: int, capacity: int, lengths: np.ndarray, demand: np.ndarray) -> list[tuple]:
    """The slots of one capacity: for each length, ranges of ranks and the containers that take them."""
    rows, first = [], 0
    some = lengths > 0
    own, n = lengths[some], demand[some]
    given = np.zeros(len(own), dtype=np.int64)
    for content, times in configuration_plan(own, n, capacity)[0] if len(own) else []:
        for i in np.flatnonzero(content):
            k = int(content[i])
            rows.append((capacity_id, int(own[i]), int(given[i]), int(given[i]) + k * times, first, k))
            given[i] += k * times
        first += times
    zero = int(demand[~some].sum())
    if zero:  # texts without tokens need no room and spread evenly over the containers
        rows.append((capacity_id, 0, 0, zero, 0, -(-zero // max(first, 1))))
    return rows


def pack_documents(docs: DataFrame, capacities: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``capacity_id``, ``container_id``, ``doc_id``, ``piece_no``, ``from_token``, ``n_tokens``: one row per placed piece.

    For each capacity, every document appears whole in one container; only a document larger
    than the capacity is split, into full containers and one remainder (``piece_no`` from 0).
    Texts without tokens are placed too. A capacity that is null or below 1 gets no packing;
    a repeated capacity id counts once (smallest size). Extra columns are ignored.

    Texts are ranked once, within their number of tokens; the rank of a piece within its
    length follows by arithmetic from the counts of the numbers of tokens. Ranks come from
    salted counts and the plan is cut into blocks of ranks, so a length that a third of the
    rows share is spread over many tasks. Only histogram and container plan, both bounded by
    the capacities and not by the rows, are brought together per capacity, one task each.
    """
    sizes = cut_lineage(token_counts(docs, tokenizer=tokenizer))
    caps = bounded_rows(capacities.where("max_tokens >= 1 and capacity_id is not null").groupBy("capacity_id").agg(F.min("max_tokens").cast("int").alias("capacity")), MOST_CAPACITIES)
    if caps is None:
        raise ValueError("each container size packs all texts once more; so many are not meant")
    choice = F.array(*(F.struct(F.lit(c.capacity_id).cast("bigint").alias("capacity_id"), F.lit(c.capacity).alias("capacity")) for c in sorted(caps))).cast("array<struct<capacity_id: bigint, capacity: int>>")

    counts = cut_lineage(sizes.groupBy("n_tokens").agg(F.count("*").alias("n")))
    few = broadcast_if_small(counts, FEW)
    salted = sizes.join(few.select("n_tokens", F.ceil(F.col("n") / ROWS_PER_SALT).cast("int").alias("salts")), "n_tokens")
    salted = salted.select("n_tokens", "doc_id", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int").alias("salt"))
    by_salt = salted.groupBy("n_tokens", "salt").agg(F.count("*").alias("m"))
    before = by_salt.select("n_tokens", "salt", (F.sum("m").over(Window.partitionBy("n_tokens").orderBy("salt")) - F.col("m")).alias("before"))
    ranked = salted.withColumn("r", F.row_number().over(Window.partitionBy("n_tokens", "salt").orderBy("doc_id")) - 1).join(before, ["n_tokens", "salt"])
    ranked = ranked.select("n_tokens", "doc_id", (F.col("r") + F.col("before")).alias("place"))

    # what a number of tokens comes to at each capacity, and where its pieces begin among those of their length
    every = counts.select("n_tokens", "n", F.inline(choice)).withColumn("full", F.expr("n_tokens div capacity").cast("bigint")).withColumn("rest", (F.col("n_tokens") % F.col("capacity")).cast("int"))
    full_before = F.sum(F.col("n") * F.col("full")).over(Window.partitionBy("capacity_id").orderBy("n_tokens")) - F.col("n") * F.col("full")
    rest_before = F.sum("n").over(Window.partitionBy("capacity_id", "rest").orderBy("n_tokens")) - F.col("n")
    every = cut_lineage(every.select("*", full_before.alias("full_before"), rest_before.alias("rest_before")))

    has_rest = (F.col("rest") > 0) | (F.col("n_tokens") == 0)
    lengths = every.select("capacity_id", "capacity", F.col("rest").alias("length"), "n").where(has_rest).unionByName(every.where("full > 0").select("capacity_id", "capacity", F.col("capacity").alias("length"), (F.col("n") * F.col("full")).alias("n")))
    histogram = lengths.groupBy("capacity_id", "capacity", "length").agg(F.sum("n").alias("n"))
    bins = histogram.groupBy("capacity_id", "capacity").agg(F.sort_array(F.collect_list(F.struct("length", "n"))).alias("bins"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for capacity_id, capacity, rows in zip(batch["capacity_id"], batch["capacity"], batch["bins"], strict=True):
                length, n = (np.array([r[c] for r in rows], np.int64) for c in ("length", "n"))
                yield pd.DataFrame(_slots(int(capacity_id), int(capacity), length, n), columns=["capacity_id", "length", "rank_from", "rank_to", "first_container", "each"])

    # one row per capacity, dealt out in turn: each is solved in a task of its own
    dealt = bins.coalesce(1).repartition(max(1, len(caps)))
    slots = cut_lineage(dealt.mapInPandas(solve, "capacity_id bigint, length int, rank_from bigint, rank_to bigint, first_container bigint, each bigint"))
    blocks = slots.select("*", F.explode(F.sequence(F.expr(f"rank_from div {BLOCK}"), F.expr(f"(rank_to - 1) div {BLOCK}"))).alias("block"))

    pieces = ranked.join(broadcast_if_small(every.drop("n"), FEW), "n_tokens")
    full_pieces = F.when(F.col("full") > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1), lambda k: F.struct(k.cast("int").alias("piece_no"), F.col("capacity").alias("length"), (F.col("full_before") + F.col("place") * F.col("full") + k).alias("rank"))))
    rest_piece = F.when(has_rest, F.array(F.struct(F.col("full").cast("int").alias("piece_no"), F.col("rest").alias("length"), (F.col("rest_before") + F.col("place")).alias("rank"))))
    nothing = F.array().cast("array<struct<piece_no: int, length: int, rank: bigint>>")
    pieces = pieces.select("capacity_id", "capacity", "doc_id", F.inline(F.concat(F.coalesce(full_pieces, nothing), F.coalesce(rest_piece, nothing))))
    pieces = pieces.withColumn("block", F.expr(f"rank div {BLOCK}"))
    placed = pieces.join(broadcast_if_small(blocks, FEW), ["capacity_id", "length", "block"]).where("rank >= rank_from and rank < rank_to")
    container = F.col("first_container") + F.expr("(rank - rank_from) div each")
    return placed.select("capacity_id", container.alias("container_id"), "doc_id", "piece_no", (F.col("piece_no") * F.col("capacity")).alias("from_token"), F.col("length").alias("n_tokens"))


def packing_faults(docs: DataFrame, capacities: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``capacity_id``, ``documents``, ``lost``, ``wrongly_split``, ``torn``, ``overfull`` of the packing of ``docs``.

    Counted anew from the packing and the texts' own sizes: documents placed, documents
    without a place, those split although they fit, those whose pieces do not follow each
    other to their size, and containers that hold more than the capacity.
    """
    packed = cut_lineage(pack_documents(docs, capacities, tokenizer))
    caps = capacities.where("max_tokens >= 1 and capacity_id is not null").groupBy("capacity_id").agg(F.min("max_tokens").alias("capacity"))
    own = packed.groupBy("capacity_id", "doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("tokens"), F.max(F.col("from_token") + F.col("n_tokens")).alias("reach"), F.count_distinct("piece_no").alias("numbers"))
    sized = own.join(token_counts(docs, tokenizer=tokenizer), "doc_id", "left").join(broadcast_if_small(caps, MOST_CAPACITIES), "capacity_id")
    torn = (F.col("tokens") != F.col("n_tokens")) | (F.col("reach") != F.col("n_tokens")) | (F.col("numbers") != F.col("pieces")) | F.col("n_tokens").isNull()
    by_doc = sized.groupBy("capacity_id").agg(F.count("*").alias("documents"), F.count_if((F.col("pieces") > 1) & (F.col("n_tokens") <= F.col("capacity"))).alias("wrongly_split"), F.count_if(torn).alias("torn"))
    loads = packed.groupBy("capacity_id", "container_id").agg(F.sum("n_tokens").alias("load")).join(broadcast_if_small(caps, MOST_CAPACITIES), "capacity_id")
    over = loads.groupBy("capacity_id").agg(F.count_if(F.col("load") > F.col("capacity")).alias("overfull"))
    counted = by_doc.join(over, "capacity_id")
    return docs.sparkSession.sql("SELECT capacity_id, documents, (SELECT count(DISTINCT doc_id) FROM {docs}) - documents AS lost, wrongly_split, torn, overfull FROM {counted}", docs=docs.select(F.col("doc_id").cast("bigint").alias("doc_id")), counted=counted)
