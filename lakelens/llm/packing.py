"""Problem 8: filling fixed-capacity containers with documents.

Method: Karmarkar-Karp multiway differencing. The items are dealt into blocks of a bounded
number of rows; in each block the two partial partitions with the largest imbalance are merged,
the fullest windows of one with the emptiest of the other, until one partition with
near-equal windows is left. The number of windows starts at what the sizes need at least and
rises where the capacity is exceeded. Only keys and sizes are shuffled, once; each partition deals
its rows in turn from a place of its own, so blocks stay even whatever values repeat and however
many partitions or blocks there are; every block is a task of its own.

Defined cases: documents without a token (null, empty) take no part; a document over the
capacity is cut into full containers and a rest that is packed like any other; a null key is
kept as it is; repeated rows are items of their own; an empty table gives no rows. The rows of an
input partition must come in the same order whenever its task is repeated, as they do from files.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import TOKENIZERS, token_sizes

BLOCK = 4096
SPAN = 1 << 32  # more containers than a block can fill, for a text has less than 2^31 characters
ROW = 1 << 33  # rows of a partition in monotonically_increasing_id
RISES = 2
PLACED = "container_id long, doc_id long, piece_no int, start_token long, n_tokens long"


def differencing(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Window of each item, and the sums of the k windows."""
    n = len(sizes)
    left, right = [], []  # inner nodes of the item trees, numbered from n

    def join(a: int, b: int) -> int:
        left.append(a)
        right.append(b)
        return n + len(left) - 1

    # a partition keeps only its windows that hold something, fullest first, less what all windows share
    heap = [(-int(s), i, [int(s)], [i], 0) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tick = n
    while len(heap) > 1:
        _, _, a, na, _ = heapq.heappop(heap)
        _, _, b, nb, _ = heapq.heappop(heap)
        la, lb = len(a), len(b)
        if la + lb <= k:
            sums, nodes = a + b, na + nb
        else:  # windows k-lb..la-1 of a meet those of b, fullest with emptiest
            over = la + lb - k
            sums = a[: la - over] + b[: lb - over]
            nodes = na[: la - over] + nb[: lb - over]
            for j in range(over):
                x, y = la - over + j, lb - 1 - j
                sums.append(a[x] + b[y])
                nodes.append(join(na[x], nb[y]))
        order = sorted(range(len(sums)), key=sums.__getitem__, reverse=True)
        sums = [sums[j] for j in order]
        nodes = [nodes[j] for j in order]
        low = sums[-1] if len(sums) == k else 0
        tick += 1
        heapq.heappush(heap, (-(sums[0] - low), tick, sums, nodes, 0))
    window, totals = np.zeros(n, np.int64), np.zeros(k, np.int64)
    for w, root in enumerate(heap[0][3]):
        todo = [root]
        while todo:
            x = todo.pop()
            if x < n:
                window[x] = w
                totals[w] += sizes[x]
            else:
                todo += (left[x - n], right[x - n])
    return window, totals


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window of each item; sizes are between 1 and the capacity.

    The windows start at the number that the sizes need at least. Where one exceeds the capacity, items
    are swapped with a window that has room; while that does not do, the number rises. After a few
    rises (many large items) the smallest items that relieve it move into the room that others have left; what fits nowhere
    makes the number rise and is differenced again among the new windows.
    """
    n = len(sizes)
    window = np.full(n, -1, np.int64)
    todo, used = np.arange(n), 0
    while len(todo):
        least = at_least(sizes[todo], capacity)
        for k in range(least, least + RISES):
            own, totals = differencing(sizes[todo], k)
            _swap(sizes[todo], own, totals, capacity)
            if (totals <= capacity).all():
                break
        loose = _relieve(sizes[todo], own, totals, capacity)
        room = sorted((capacity - int(t), w) for w, t in enumerate(totals))
        left = []
        for i in sorted(loose, key=lambda i: -int(sizes[todo[i]])):
            at = bisect_left(room, (int(sizes[todo[i]]), -1))
            if at == len(room):
                left.append(i)
                continue
            free, w = room.pop(at)
            own[i] = w
            insort(room, (free - int(sizes[todo[i]]), w))
        placed = np.ones(len(todo), bool)
        placed[left] = False
        window[todo[placed]] = own[placed] + used
        used += k
        if not placed.any():  # cannot happen while items fit the capacity; keeps the loop finite
            raise ValueError("an item exceeds the capacity")
        todo = todo[~placed]
    return np.unique(window, return_inverse=True)[1] if n else window


def at_least(sizes: np.ndarray, capacity: int) -> int:
    """Windows needed at least: by the total, and for each size t by the items over capacity - t, which share no window with items from t on."""
    order = np.sort(sizes)
    sums = np.concatenate([[0], np.cumsum(order)])
    n, best = len(order), max(1, math.ceil(int(sums[-1]) / capacity))
    half = np.searchsorted(order, capacity // 2, "right")
    for t in np.unique(order[order <= capacity // 2]).tolist():
        big, low = np.searchsorted(order, capacity - t, "right"), np.searchsorted(order, t)
        middle = int(sums[big] - sums[half])
        small = int(sums[half] - sums[low])
        best = max(best, int(n - half) + max(0, math.ceil((small - (int(big - half) * capacity - middle)) / capacity)))
    return max(best, int(n - half))


def _swap(sizes: np.ndarray, own: np.ndarray, totals: np.ndarray, capacity: int) -> None:
    """Evens out windows over the capacity: an item goes to a window with room and a smaller one, or none, comes back."""
    members: dict[int, list[int]] = {}
    for i, w in enumerate(own.tolist()):
        members.setdefault(w, []).append(i)
    for w in sorted(np.flatnonzero(totals > capacity).tolist(), key=lambda w: (-int(totals[w]), w)):
        excess = int(totals[w]) - capacity
        mine = np.array([sizes[i] for i in members[w]])
        spare = np.flatnonzero(totals <= capacity - excess)
        for u in spare[np.argsort(totals[spare], kind="stable")].tolist():
            theirs = np.array([0] + [sizes[i] for i in members.get(u, [])])
            gain = mine[:, None] - theirs[None, :]
            fit = (gain >= excess) & (gain <= capacity - int(totals[u]))
            if not fit.any():
                continue
            a, b = divmod(int(np.where(fit, gain, np.iinfo(np.int64).max).argmin()), len(theirs))
            moved = int(gain[a, b])
            out = members[w][a]
            if b:
                back = members[u].pop(b - 1)
                own[back] = w
                members[w].append(back)
            members[w].remove(out)
            members.setdefault(u, []).append(out)
            own[out] = u
            totals[w] -= moved
            totals[u] += moved
            break


def _relieve(sizes: np.ndarray, own: np.ndarray, totals: np.ndarray, capacity: int) -> list[int]:
    """Items taken out of the windows over the capacity: the smallest one that suffices, else the largest again and again."""
    loose: list[int] = []
    members: dict[int, list[int]] = {}
    over = set(np.flatnonzero(totals > capacity).tolist())
    for i, w in enumerate(own.tolist()):
        if w in over:
            members.setdefault(w, []).append(i)
    for w, inside in members.items():
        inside.sort(key=lambda i: int(sizes[i]))
        while totals[w] > capacity:
            excess = int(totals[w]) - capacity
            k = next((k for k, i in enumerate(inside) if sizes[i] >= excess), len(inside) - 1)
            i = inside.pop(k)
            loose.append(i)
            totals[w] -= sizes[i]
    return loose


def block_of(blocks: int):
    """Block of a row: each partition deals its rows in turn, from a place that its number decides."""
    row = F.monotonically_increasing_id()
    part = F.shiftright(row, 33)
    return F.pmod(F.pmod(F.xxhash64(part), F.lit(blocks)) + row.bitwiseAND(F.lit(ROW - 1)), F.lit(blocks)).cast("int")


def _place(capacity: int):
    schema = pa.schema([("container_id", pa.int64()), ("doc_id", pa.int64()), ("piece_no", pa.int32()), ("start_token", pa.int64()), ("n_tokens", pa.int64())])

    def place(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("row", "ascending")]).combine_chunks()
        size, doc = rows["n_tokens"].to_numpy(), rows["doc_id"]
        whole = (size - 1) // capacity  # containers filled by a document over the capacity
        rest = size - whole * capacity
        window = pack(rest, capacity)
        first = rows["block"][0].as_py() * SPAN
        many = np.repeat(np.arange(len(size)), whole)
        piece = np.arange(len(many)) - np.repeat(np.cumsum(whole) - whole, whole)
        container = np.concatenate([first + window, first + int(window.max()) + 1 + np.arange(len(many))])
        every = np.concatenate([np.arange(len(size)), many])
        number = np.concatenate([whole, piece])
        tokens = np.concatenate([rest, np.full(len(many), capacity)])
        return pa.Table.from_arrays([pa.array(container), doc.take(pa.array(every)).combine_chunks(), pa.array(number, pa.int32()), pa.array(number * capacity), pa.array(tokens, pa.int64())], schema=schema)

    return place


def containers(documents: DataFrame, capacity: int, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """One row per document (or piece of one over the capacity) with its container."""
    blocks = max(1, math.ceil(documents.count() / BLOCK))  # a count of rows, from file footers
    sized = token_sizes(documents, folder, name).where("n_tokens > 0")
    dealt = sized.withColumn("row", F.monotonically_increasing_id()).withColumn("block", block_of(blocks))
    return dealt.repartitionById(blocks, "block").groupBy("block").applyInArrow(_place(capacity), PLACED)


def placed(documents: DataFrame, capacity: int, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """One row per document: whether its pieces follow each other from its first token on, none cut below the capacity, in containers that hold no more than that."""
    p = containers(documents, capacity, folder, name)
    full = p.groupBy("container_id").agg(F.sum("n_tokens").alias("total"))
    j = p.join(full, "container_id")
    last = F.max("piece_no")
    good = (F.max("total") <= capacity) & (F.count(F.lit(1)) == last + 1) & (F.sum("n_tokens") - F.max_by("n_tokens", "piece_no") == last * capacity) & (F.min("n_tokens") > 0)
    return j.groupBy("doc_id").agg(good.alias("is_within"))
