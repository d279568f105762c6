"""Self-join of documents whose sets of word n-grams have a Jaccard similarity of at least a threshold.

Two similar sets share a minimum number T of elements (T-occurrence). As in DivideSkip, each set divides the lists of
its elements: the longest ones, as far as T allows, are skipped, and the rest is merged and counted; sets that occur
often enough there are candidates, and the skipped lists are then only searched for the candidates.

* Divide: elements a sample shows to be common come last in the order of elements, the others go by hash. A set posts
  the start of that order, all but T - 1 - e elements. Posted elements held by more than LONG sets are long as well,
  and a set skips those too, unless they are more than e.
* Merge: every list sends each of its sets the others that fit in size and position. What a set receives is merged,
  and the occurrences of each other set are counted; those that reach T less the lists skipped are candidates.
* Probe: the elements of a candidate pair are looked up in each other by binary search, the rarest first, until the
  pair reaches T or can no longer do so.

Sets that are mostly made of long lists cannot skip them. Groups of near copies are of that kind, and would turn up all
their pairs. Therefore every long list first proposes just a few of its sets to the others; what is linked that way is
one component, and inside a component no pair is listed. Sets of different components meet in blocks of the long list;
position, size and a count of elements by hash bucket rule out pairs there. What is left are candidates, and of those
only as many leave the block as it takes to hold its sets together: components that candidates connect are one cluster.

Inside a cluster pairs are never rows. Its sets are compared in blocks, again by merging lists: of a block of sets,
elements that most of them hold are kept as the lists of the sets that lack them, so that lists are short at both ends.
A block says how many links each of its sets has, and names as many links as connect what is linked. Sets of different
clusters are candidates by their short lists alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motorpool.llm.common import claim, discard, stretches, text_or_empty, written
from motorpool.llm.graph import components

WORDS, PERCENT = 5, 80
# Elements that so many of a sample of documents hold are common: they come last in the order, so that hardly any
# document posts them. Which ones these are changes the cost alone, any fixed choice gives the same pairs.
SAMPLE, COMMON, MOST_COMMON = 10_000, 4, 200_000
# Lists with more documents than this are long.
LONG = 64
# Elements posted beyond the least, as a share of the set.
EXTRA = 0.05
# Documents of a long list that propose themselves to the others in the first step.
LEADERS = 8
# Sets of one list or component compared in one piece; longer ones are cut into blocks, each pair of blocks a piece.
BLOCK = 4096
# Pairs held at once while a list is compared.
PAIRS = 1 << 20
# Elements of the sets in one block of a component, about: they bound a block of long documents.
ELEMENTS = 1 << 21
# Hash buckets of the counts that travel with the members of long lists.
BUCKETS = 64
# Rows of groups broadcast at most: a key and a hash each, 32 MB in all.
BROADCAST_ROWS = 1_000_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The distinct n-grams of a text as sorted 64-bit hashes. Fewer words than n are one n-gram; none, none.

    A-Z are lower-cased; words are separated by blanks and the control characters 9 to 13.
    """
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), dtype=np.uint64, count=len(parts))
    size = min(words, len(parts))
    total = np.full(len(parts) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        total = total * MULTIPLIER + hashed[i : len(hashed) - size + 1 + i]
    return np.unique(_mixed(total))


def extra(n: int) -> int:
    return ceil(n * EXTRA)


def posted(n: int, percent: int = PERCENT) -> int:
    """How many elements of a set of n are posted."""
    return min(n, n - ceil(n * percent / 100) + 1 + extra(n))


def least_overlap(n: np.ndarray, m: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """How many elements sets of n and m share at least if they are similar."""
    return -(-percent * (n + m) // (100 + percent))


def skipped(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """How many elements of a set of n are not posted."""
    return n - np.minimum(n, n + -n * percent // 100 + 1 + np.ceil(n * EXTRA).astype(np.int64))


def signature(elements: np.ndarray) -> int:
    """A 64-bit name of a set: equal sets are one vertex of the graph.

    Unequal sets share a name with a chance of n * n / 2**65 over n distinct sets.
    """
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(elements.tobytes()))))


def bucket_counts(elements: np.ndarray) -> bytes | None:
    """Elements by the low bits of their hash, about two to a bucket; nothing if a count does not fit a byte."""
    buckets = 64
    while buckets * 2 < len(elements):
        buckets *= 2
    counts = np.bincount((elements & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else None


def overlap_bound(a: bytes | None, b: bytes | None) -> int:
    """At most how many elements two sets share."""
    if a is None or b is None:
        return 1 << 60
    x, y = (np.frombuffer(c, np.uint8).astype(np.int64) for c in (a, b))
    size = min(len(x), len(y))
    return int(np.minimum(x.reshape(-1, size).sum(axis=0), y.reshape(-1, size).sum(axis=0)).sum())


def similar(shared: int, n: int, m: int, percent: int = PERCENT) -> bool:
    return 100 * shared >= percent * (n + m - shared)


def folded_counts(elements: np.ndarray) -> bytes:
    """Elements by BUCKETS hash buckets, none of which counts further than a 16-bit number."""
    counts = np.bincount((elements & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
    return np.minimum(counts, 65535).astype("<u2").tobytes()


_POST = "array<struct<token:long,at:int>>"
_SETS = (
    f"text_hash long, sid long, n long, tokens {_POST}, hot {_POST}, leads array<long>, leaders array<long>,"
    " buckets binary, folded binary"
)


def _elements(words: int):
    """All elements of the distinct sets of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__)
        seen: set[int] = set()
        for batch in stretches(batches, text=0):
            found = [e for e in (shingles(t, words) for t in batch.column(0).to_pylist()) if len(e)]
            fresh = [e for e in found if not ((sid := signature(e)) in seen or seen.add(sid))]
            if fresh:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(fresh).view(np.int64))], ["token"])

    return run


def ordered(elements: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The elements with those among the sorted ``common`` ones last."""
    if not len(common):
        return elements
    last = common[np.minimum(np.searchsorted(common, elements), len(common) - 1)] == elements
    return np.concatenate((elements[~last], elements[last]))


def _posts(rows: list[tuple[np.ndarray, np.ndarray] | None]) -> pa.ListArray:
    """Elements with their places in the order; null for rows that post nothing."""
    held = [r for r in rows if r is not None]
    places = np.concatenate([r[1] for r in held]) if held else np.zeros(0, np.int64)
    tokens = np.concatenate([r[0][r[1]] for r in held]) if held else np.zeros(0, np.int64)
    ends = np.cumsum([0, *(len(r[1]) if r is not None else 0 for r in rows)]).astype(np.int32)
    values = pa.StructArray.from_arrays([pa.array(tokens), pa.array(places.astype(np.int32))], ["token", "at"])
    return pa.ListArray.from_arrays(pa.array(ends), values, mask=pa.array([r is None for r in rows]))


def _describe(words: int, percent: int, shared):
    """Names, sizes and postings of sets; a set met before in the same task is only named.

    Elements that more than LONG documents of a batch post are long already here: they are listed by the smallest
    document of the batch alone (``leads``), which the others know as a leader.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__)
        common = shared.value
        seen: set[int] = set()
        for batch in stretches(batches, text=2):
            rows, fresh = [], []
            for t in batch.column(2).to_pylist():
                elements = shingles(t, words)
                n = len(elements)
                sid = signature(elements) if n else None
                row = [sid, n, None, None, None, None, None, None]
                if n and sid not in seen:
                    seen.add(sid)
                    row[2] = ordered(elements, common)[: posted(n, percent)].view(np.int64)
                    row[6], row[7] = bucket_counts(elements), folded_counts(elements)
                    fresh.append(row)
                rows.append(row)
            if fresh:
                every, count = np.unique(np.concatenate([r[2] for r in fresh]), return_counts=True)
                hot = every[count > LONG]
                leader: dict[int, int] = {}
                for r in fresh:
                    is_hot = np.isin(r[2], hot, assume_unique=True) if len(hot) else np.zeros(len(r[2]), bool)
                    r[2], r[3] = (r[2], np.flatnonzero(~is_hot)), (r[2], np.flatnonzero(is_hot))
                    for token in r[3][0][r[3][1]].tolist():
                        leader[token] = min(leader.get(token, r[0]), r[0])
                for r in fresh:
                    mine = r[3][0][r[3][1]].tolist()
                    r[4] = [t for t in mine if leader[t] == r[0]]
                    r[5] = sorted({leader[t] for t in mine} - {r[0]})
            columns = list(zip(*rows))
            numbers, lists = pa.int64(), pa.list_(pa.int64())
            arrays = [
                *batch.columns[:2], pa.array(columns[0], numbers), pa.array(columns[1], numbers), _posts(columns[2]), _posts(columns[3]),
                pa.array(columns[4], lists), pa.array(columns[5], lists), pa.array(columns[6], pa.binary()), pa.array(columns[7], pa.binary()),
            ]
            names = [batch.schema.names[0], "text_hash", "sid", "n", "tokens", "hot", "leads", "leaders", "buckets", "folded"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def whole_groups(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[pa.Table]:
    """Rows that come group by group, in tables that hold whole groups; the first ``columns`` name the group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        names = [batch.column(i).to_numpy() for i in range(columns)]
        cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in names])) + 1
        if held and any(held[-1].column(i)[-1].as_py() != names[i][0] for i in range(columns)):
            yield pa.Table.from_batches(held)
            held = []
        if len(cuts):
            last = int(cuts[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
            batch = batch.slice(last)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


# The place of a posting is kept as -1 - at where its list is long.
_LIST = "token long, sid long, at int"


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From postings by token: those of tokens with several sets, and proposals (sid, sid, no place).

    A token has at most one posting for each batch that has found it long, and LONG for any other batch.
    """
    for table in whole_groups(batches, 1):
        token, sid, at = (table.column(i).to_numpy() for i in range(3))
        order = np.lexsort((sid, token))
        token, sid, at = (c[order] for c in (token, sid, at))
        known_long = at < 0
        at = np.where(known_long, -1 - at, at)
        new = np.concatenate(([True], (token[1:] != token[:-1]) | (sid[1:] != sid[:-1])))
        group = np.cumsum(np.concatenate(([True], token[1:] != token[:-1]))) - 1
        is_long = np.bincount(group, known_long) > 0
        token, sid, group, at = (c[new] for c in (token, sid, group, at))
        count = np.bincount(group)
        is_long |= count > LONG
        first = np.cumsum(count) - count
        keep = (count[group] > 1) | is_long[group]
        # Long lists propose: the first set to all, and of large ones more sets, each the first in an order of its own,
        # as a list may hold a large group of near copies that are not all close to the first one.
        listed = is_long[group]
        proposals = [np.stack([sid[first][group][listed], sid[listed]])]
        large = np.flatnonzero(count[group] > LONG)
        for turn in range(1, LEADERS if len(large) else 1):
            own, members = group[large], sid[large]
            rank = _mixed(members.view(np.uint64) ^ np.uint64(int(MULTIPLIER) * turn % 2**64))
            by_rank = np.lexsort((rank, own))
            top = np.concatenate(([True], own[by_rank][1:] != own[by_rank][:-1]))
            leader = np.zeros(len(count), np.int64)
            leader[own[by_rank][top]] = members[by_rank][top]
            proposals.append(np.stack([np.minimum(leader[own], members), np.maximum(leader[own], members)]))
        pairs = np.unique(np.concatenate(proposals, axis=1), axis=1)
        pairs = pairs[:, pairs[0] != pairs[1]]
        names, at = ["token", "sid", "at"], np.where(listed, -1 - at, at).astype(np.int32)
        for i in range(0, int(keep.sum()), 100_000):
            part = np.flatnonzero(keep)[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(c[part]) for c in (token, sid, at)], names)
        for i in range(0, pairs.shape[1], 100_000):
            a, b = pairs[:, i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int32())], names)


def _partners_in_lists(percent: int):
    """From short lists by token: for each set of a list (own, others, needed) the later sets of other components that
    fit in size and position, and how often such a pair has to occur in all short lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__)
        for table in whole_groups(batches, 1):
            token, sid, n, at, hot, component = (table.column(i).to_numpy() for i in range(6))
            order = np.lexsort((sid, n, token))
            token, sid, n, at, hot, component = (c[order] for c in (token, sid, n, at, hot, component))
            ends = np.searchsorted(token, token, side="right")
            columns: list[list[np.ndarray]] = [[], [], []]
            # The k-th set after each in its list, for all lists at once: lists are short.
            for k in range(1, int((ends - np.arange(len(token))).max(initial=1))):
                own = np.flatnonzero(np.arange(len(token)) + k < ends)
                other = own + k
                least = least_overlap(n[own], n[other], percent)
                fit = (100 * n[own] >= percent * n[other]) & (component[own] != component[other])
                # All that comes before in both, and all from here on, has to reach the least overlap.
                fit &= np.minimum(at[own], at[other]) + np.minimum(n[own] - at[own], n[other] - at[other]) >= least
                own, other, least = own[fit], other[fit], least[fit]
                unseen = np.maximum(skipped(n[own], percent), skipped(n[other], percent)) + np.minimum(hot[own], hot[other])
                for column, values in zip(columns, (own, other, np.maximum(1, least - unseen))):
                    column.append(values)
            if not sum(map(len, columns[0])):
                continue
            own, other, needed = (np.concatenate(c) for c in columns)
            order = np.argsort(own, kind="stable")
            own, other, needed = own[order], other[order], needed[order]
            starts = np.flatnonzero(np.diff(own, prepend=-1))
            ends = pa.array(np.append(starts, len(own)).astype(np.int32))
            arrays = [pa.array(sid[own[starts]]), pa.ListArray.from_arrays(ends, pa.array(sid[other])), pa.ListArray.from_arrays(ends, pa.array(needed))]
            yield pa.RecordBatch.from_arrays(arrays, ["own", "others", "needed"])

    return run


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the lists each set has received, and keeps the sets that occur as often as needed."""
    for table in whole_groups(batches, 1):
        table = table.combine_chunks()
        lists, needs = table.column(1).chunk(0), table.column(2).chunk(0)
        own = np.repeat(table.column(0).to_numpy(), np.diff(lists.offsets.to_numpy()))
        other, needed = lists.flatten().to_numpy(), needs.flatten().to_numpy()
        order = np.lexsort((other, own))
        own, other, needed = own[order], other[order], needed[order]
        starts = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (other[1:] != other[:-1]))))
        enough = np.diff(np.append(starts, len(own))) >= needed[starts]
        a, b = own[starts[enough]], other[starts[enough]]
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


class Forest:
    """Which of the numbers 0 to n - 1 are connected, and the edges it takes to connect them."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def grow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Connect ``a[i]`` with ``b[i]``; the places i that were needed for it."""
        open_ = np.flatnonzero(self.root[a] != self.root[b])
        ends = np.sort(np.stack([self.root[a[open_]], self.root[b[open_]]]), axis=0)
        ends, first = np.unique(ends, axis=1, return_index=True)
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while x in up:
                x = up[x]
            return x

        used = []
        for i, x, y in zip(open_[first].tolist(), *ends.tolist()):
            x, y = top(x), top(y)
            if x != y:
                up[max(x, y)] = min(x, y)
                used.append(i)
        if up:
            to = np.arange(len(self.root))
            for x in up:
                to[x] = top(x)
            self.root = to[self.root]
        return np.array(used, np.int64)


def _block_edges(percent: int):
    """Within each long list or pair of its blocks: pairs of different components, of sizes, places and counts that can
    be similar. Of these, as many as connect what all of them connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__)
        for table in whole_groups(batches, 3):
            token, low, high, block, sid, n, at, component = (table.column(i).to_numpy() for i in range(8))
            counts = np.frombuffer(b"".join(table.column(8).to_pylist()), "<u2").reshape(-1, BUCKETS)
            order = np.lexsort((sid, n, high, low, token))
            token, low, high, block, sid, n, at, component = (c[order] for c in (token, low, high, block, sid, n, at, component))
            counts = counts[order]
            # A count that is full says nothing.
            open_ended = counts.max(axis=1) == 65535
            names, component = np.unique(component, return_inverse=True)
            forest = Forest(len(names))
            change = (token[1:] != token[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
            group = np.concatenate(([0], np.cumsum(change)))
            # Sorted by size: partners of a set are as large or larger, up to the size that can still be similar.
            place = group << 32 | n
            until = np.searchsorted(place, group << 32 | n * 100 // percent, side="right")
            count = until - np.arange(len(n)) - 1
            ends = np.cumsum(count)
            start = 0
            while start < len(n):
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, side="right")))
                own = np.repeat(np.arange(start, stop), count[start:stop])
                first = np.cumsum(count[start:stop]) - count[start:stop]
                other = own + 1 + np.arange(len(own)) - np.repeat(first, count[start:stop])
                fit = forest.root[component[own]] != forest.root[component[other]]
                fit &= (low[own] == high[own]) | (block[own] != block[other])
                least = least_overlap(n[own], n[other], percent)
                # A pair that short lists do not show has its first element in common here, in one of its long lists.
                fit &= np.minimum(n[own] - at[own], n[other] - at[other]) >= least
                own, other, least = own[fit], other[fit], least[fit]
                for i in range(0, len(own), 20_000):
                    a, b, least_of = own[i : i + 20_000], other[i : i + 20_000], least[i : i + 20_000]
                    apart = forest.root[component[a]] != forest.root[component[b]]
                    a, b, least_of = a[apart], b[apart], least_of[apart]
                    shared = np.minimum(counts[a], counts[b]).sum(axis=1, dtype=np.int64)
                    fit = (shared >= least_of) | open_ended[a] | open_ended[b]
                    a, b = a[fit], b[fit]
                    used = forest.grow(component[a], component[b])
                    if len(used):
                        a, b = sid[a[used]], sid[b[used]]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])
                start = stop

    return run


class Merger:
    """Counts what sets share with the sets of a block, by merging inverted lists of the block.

    Elements that more than half of the sets hold are listed by the sets that lack them: with the number of such
    elements c, two sets that lack x and y of them share c - x - y of these, and once more each they both lack.
    """

    def __init__(self, block: list[np.ndarray]) -> None:
        self.size = np.array([len(e) for e in block], np.int64)
        every = np.concatenate(block)
        owner = np.repeat(np.arange(len(block)), self.size)
        self.names, inverse, held = np.unique(every, return_inverse=True, return_counts=True)
        self.dense = np.flatnonzero(2 * held > len(block))
        is_dense = np.zeros(len(self.names), bool)
        is_dense[self.dense] = True
        sparse = ~is_dense[inverse]
        lacks = np.ones((len(self.dense), len(block)), bool)
        rank = np.cumsum(is_dense) - 1
        lacks[rank[inverse[~sparse]], owner[~sparse]] = False
        lacked, lacking = np.nonzero(lacks)
        element = np.concatenate((inverse[sparse], self.dense[lacked]))
        order = np.argsort(element, kind="stable")
        self.listed = np.concatenate((owner[sparse], lacking))[order]
        self.starts = np.searchsorted(element[order], np.arange(len(self.names) + 1))
        self.lacks = lacks.sum(axis=0)
        self.is_dense = is_dense

    def shared(self, elements: np.ndarray) -> np.ndarray:
        """How many elements (sorted) each set of the block has in common with these."""
        at = np.searchsorted(self.names, elements)
        at = at[at < len(self.names)]
        mine = at[self.names[at] == elements[: len(at)]]
        dense = self.is_dense[mine]
        missing = np.setdiff1d(self.dense, mine[dense], assume_unique=True)
        lists = np.concatenate((mine[~dense], missing))
        sizes = self.starts[lists + 1] - self.starts[lists]
        place = np.repeat(self.starts[lists] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        counts = np.bincount(self.listed[place], minlength=len(self.size))
        return counts + len(self.dense) - len(missing) - self.lacks


def _partners(percent: int):
    """From sets (component, low, high, block, sid, copies, elements) by piece: (sid, partners), the rows that hold a
    similar set of the piece, in the same block if low is high, else in the other one. Further rows (sid, 0, link) name
    as many links as connect what is linked in the piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__)
        for table in whole_groups(batches, 3):
            component, low, high, block, sid, copies = (table.column(i).to_numpy() for i in range(6))
            every = [np.sort(e.values.to_numpy()) for e in table.column(6)]
            found, links = np.zeros(len(sid), np.int64), []
            cuts = np.flatnonzero((component[1:] != component[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])) + 1
            for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sid)]):
                piece = np.arange(start, stop)
                same = low[start] == high[start]
                first = piece if same else piece[block[piece] == low[start]]
                second = piece if same else piece[block[piece] == high[start]]
                if not len(first) or not len(second):
                    continue
                merger, forest = Merger([every[i] for i in second]), Forest(len(piece))
                for i in first.tolist():
                    linked = similar(merger.shared(every[i]), len(every[i]), merger.size, percent)
                    others = second[linked]
                    links += [(i, j) for j in others[forest.grow(np.full(len(others), i - start), others - start)].tolist()]
                    if same:
                        found[i] += copies[others].sum() - copies[i]
                    else:
                        found[i] += copies[others].sum()
                        found[others] += copies[i]
            own, other = np.array(links, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((sid, sid[own]))),
                    pa.array(np.concatenate((found, np.zeros(len(own), np.int64)))),
                    pa.concat_arrays([pa.nulls(len(sid), pa.int64()), pa.array(sid[other])]),
                ],
                ["sid", "partners", "link"],
            )

    return run


def _probed(percent: int):
    """The pairs (a, b, elements of each) that reach the least overlap, by binary search of one in the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__)
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (v.values.to_numpy().view(np.uint64) for v in (x, y))
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                x, y = np.sort(x), np.sort(y)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                keep.append(similar(int((y[at] == x).sum()), len(x), len(y), percent))
            chosen = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(chosen) for i in range(2)], ["a", "b"])

    return run


def _bounded(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__)
        for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            n, m, x, y = (batch.column(i).to_pylist() for i in range(2, 6))
            keep = [
                100 * min(p, q) >= percent * max(p, q) and similar(min(overlap_bound(u, v), p, q), p, q, percent)
                for p, q, u, v in zip(n, m, x, y)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in range(2)], ["a", "b"])

    return run


def _ends(pairs: DataFrame) -> DataFrame:
    """The sets that occur in pairs, once each."""
    return pairs.select(F.col("a").alias("sid")).unionAll(pairs.select(F.col("b").alias("sid"))).distinct()


class _Join:
    def __init__(self, docs: DataFrame, key: str, text: str, words: int, percent: int) -> None:
        self.words, self.percent = words, percent
        whole = text_or_empty(text)
        self.rows = docs.select(F.col(key).alias("key"), F.xxhash64(whole).alias("text_hash"), whole.alias("text"))
        kind = self.rows.schema["key"].dataType.simpleString()
        shared = docs.sparkSession.sparkContext.broadcast(self._common())
        self.sets = written(self.rows.mapInArrow(_describe(words, percent, shared), f"key {kind}, {_SETS}"), "sets")

    def _common(self) -> np.ndarray:
        """Elements of at least COMMON of about SAMPLE documents, the MOST_COMMON most frequent ones, sorted."""
        total = self.rows.select(F.count(F.lit(1))).first()[0]
        share = max(1, ceil(total / SAMPLE))
        sample = self.rows.where(F.pmod(F.xxhash64("key", "text_hash"), F.lit(share)) == 0).select("text")
        counts = sample.mapInArrow(_elements(self.words), "token long").groupBy("token").count()
        best = counts.where(F.col("count") >= COMMON).orderBy(F.col("count").desc(), "token").limit(MOST_COMMON)
        return np.sort(best.select("token").toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets are similar, stored."""
        meta = self.sets.where("tokens IS NOT NULL").select("sid", "n", "buckets")
        meta = written(meta.join(_ends(pairs), "sid", "left_semi").dropDuplicates(["sid"]), "meta")
        sides = [meta.select(F.col("sid").alias(s), F.col("n").alias(f"n_{s}"), F.col("buckets").alias(f"buckets_{s}")) for s in "ab"]
        known = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "n_a", "n_b", "buckets_a", "buckets_b")
        likely = written(known.mapInArrow(_bounded(self.percent), "a long, b long"), "likely")
        discard(meta)
        holders = self.sets.select("sid", "text_hash").join(_ends(likely), "sid", "left_semi").groupBy("sid").agg(F.min("text_hash").alias("text_hash"))
        sets = self.elements(holders)
        left, right = (sets.select(F.col("sid").alias(s), F.col("elements").alias(f"set_{s}")) for s in "ab")
        both = likely.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b")
        found = written(both.mapInArrow(_probed(self.percent), "a long, b long"), "links")
        discard(likely)
        return found

    def elements(self, holders: DataFrame) -> DataFrame:
        """``sid`` and ``elements`` of the texts with the ``text_hash`` of the holders.

        Up to BROADCAST_ROWS hashes go to where the texts are; more are joined by shuffling.
        """
        wanted = written(holders.select("text_hash").distinct(), "wanted")
        few = wanted.count() <= BROADCAST_ROWS
        texts = self.rows.join(F.broadcast(wanted) if few else wanted, "text_hash", "left_semi").select("text_hash", "text")
        words = self.words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            claim(__name__)
            seen: set[int] = set()
            for batch in stretches(batches):
                names, sets = [], []
                for t in batch.column(1).to_pylist():
                    elements = shingles(t, words)
                    sid = signature(elements) if len(elements) else None
                    if sid is not None and sid not in seen:
                        seen.add(sid)
                        names.append(sid)
                        sets.append(elements.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["sid", "elements"])

        return texts.mapInArrow(run, "sid long, elements array<long>").dropDuplicates(["sid"])

    def grouped(self) -> DataFrame:
        """``key``, ``text_hash``, ``n`` and ``group`` of every row; rows without words have no group."""
        first, met, clusters, second = self.links()
        links = first.unionAll(second)
        if not met.isEmpty():
            # The other clusters are components that links have shown.
            uncertain = clusters.join(met.select(F.col("a").alias("vertex")), "vertex", "left_semi").select("component").distinct()
            compared = self.compared(self.members().join(clusters.join(uncertain, "component", "left_semi"), F.col("sid") == F.col("vertex")))
            links = links.unionAll(compared.where("link IS NOT NULL").select("sid", "link"))
        found = components(links)
        discard(first, met, clusters, second)
        named = self.sets.select("key", "text_hash", "n", "sid").join(found, F.col("sid") == F.col("vertex"), "left")
        return named.select("key", "text_hash", "n", F.coalesce("component", "sid").alias("group"))

    def members(self) -> DataFrame:
        """The distinct sets: ``sid``, the rows that hold it (``copies``), one ``text_hash`` of theirs, and ``n``."""
        return self.sets.where("sid IS NOT NULL").groupBy("sid").agg(
            F.count(F.lit(1)).alias("copies"), F.min("text_hash").alias("text_hash"), F.max("n").alias("n")
        )

    def compared(self, linked: DataFrame) -> DataFrame:
        """The sets of each cluster (``component``) compared with each other, as :func:`_partners` has it; stored.

        Sizes that rule each other out never meet. Large clusters are cut into blocks of sets of like sizes, each pair
        of blocks a piece.
        """
        # A little wider than the largest ratio of similar sizes: partners are in the same class or the next.
        width = max(log(100 / self.percent), 0.001) * 1.001
        linked = written(linked.withColumn("class", F.floor(F.log("n") / width)).drop("vertex"), "linked")
        classes = linked.groupBy("component", "class").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("total"))
        classes = written(classes, "classes")
        large = classes.groupBy("component").agg(F.sum("size").alias("s"), F.sum("total").alias("t"))
        large = large.where((F.col("s") > BLOCK) | (F.col("t") > ELEMENTS)).select("component")
        blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("total") / ELEMENTS))
        cut = classes.join(large, "component", "left_semi").select("component", "class", blocks.alias("blocks"))
        other = cut.select(
            F.col("component").alias("c"), F.col("class").alias("next"),
            F.explode(F.expr(f"transform(sequence(0L, blocks - 1), i -> class * {1 << 32} + i)")).alias("other"),
        )
        near = (F.col("component") == F.col("c")) & (F.abs(F.col("class") - F.col("next")) <= 1)
        cut = cut.join(other, near).groupBy("component", "class", "blocks").agg(F.collect_list("other").alias("others"))
        own = F.coalesce(F.expr(f"class * {1 << 32} + pmod(xxhash64(sid), blocks)"), F.lit(0))
        dealt = linked.join(cut, ["component", "class"], "left").withColumn("block", own)
        dealt = dealt.withColumn("other", F.explode(F.coalesce("others", F.array(F.lit(0).cast("long")))))
        dealt = dealt.select(
            "component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "sid", "copies"
        )
        pieces = dealt.join(self.elements(linked), "sid").select("component", "low", "high", "block", "sid", "copies", "elements")
        piece = ["component", "low", "high"]
        pieces = pieces.repartition(*piece).sortWithinPartitions(*piece)
        found = written(pieces.mapInArrow(_partners(self.percent), "sid long, partners long, link long"), "compared")
        discard(linked, classes)
        return found

    def counted(self) -> DataFrame:
        """``key``, ``n``, ``group`` and ``n_links`` of every row: how many other rows its set is similar to.

        The links between clusters are all listed; those inside one are counted there, among all its distinct sets.
        """
        first, met, clusters, second = self.links()
        discard(first, met)
        members = written(self.members(), "members")
        compared = self.compared(members.join(clusters, F.col("sid") == F.col("vertex")))
        groups = components(second.unionAll(compared.where("link IS NOT NULL").select("sid", "link")))
        copies = members.select(F.col("sid").alias("c"), "copies")
        between = [
            second.join(copies, F.col(other) == F.col("c")).select(F.col(own).alias("sid"), F.col("copies").alias("partners"))
            for own, other in (("a", "b"), ("b", "a"))
        ]
        listed = compared.select("sid", "partners").unionAll(between[0]).unionAll(between[1])
        partners = listed.groupBy("sid").agg(F.sum("partners").alias("partners"))
        counts = members.join(partners, "sid", "left").join(groups, F.col("sid") == F.col("vertex"), "left").select(
            F.col("sid").alias("s"), groups["component"].alias("group"),
            (F.col("copies") - 1 + F.coalesce("partners", F.lit(0))).alias("n_links"),
        )
        counts = written(counts.withColumn("group", F.coalesce("group", "s")), "counts")
        discard(members, compared, groups, clusters, second)
        rows = self.sets.select("key", "n", "sid").join(counts, F.col("sid") == F.col("s"), "left")
        return rows.select("key", "n", "group", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))

    def links(self) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """Links (a, b) that long lists propose, candidates that connect the components they make, the clusters that
        both make, and all links between sets of different clusters; all stored."""
        sets = self.sets.where("tokens IS NOT NULL")
        of_lead = F.filter("hot", lambda p: F.array_contains("leads", p["token"]))
        short = sets.select("sid", F.explode("tokens").alias("post")).select("post.token", "sid", "post.at")
        leads = sets.select("sid", F.explode(of_lead).alias("post")).select("post.token", "sid", (-1 - F.col("post.at")).alias("at"))
        posts = short.unionAll(leads).repartition("token").sortWithinPartitions("token")
        lists = written(posts.mapInArrow(_lists, _LIST), "lists")
        proposed = lists.where("at IS NULL").select(F.col("token").alias("a"), F.col("sid").alias("b")).unionAll(
            sets.select(F.explode("leaders").alias("a"), F.col("sid").alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        )
        proposed = written(proposed.distinct(), "proposed")
        first = self.verified(proposed)
        known = components(first)
        # Which long lists each set has posted, and whether it may skip them all.
        in_long = lists.where("at < 0").groupBy("sid").agg(F.collect_list(F.struct("token", (-1 - F.col("at")).alias("at"))).alias("listed"))
        sized = sets.select("sid", "n", "hot", "folded").dropDuplicates(["sid"]).join(in_long, "sid", "left")
        sized = sized.withColumn("hot", F.array_distinct(F.concat("hot", F.coalesce("listed", F.array().cast(_POST))))).drop("listed")
        sized = sized.join(known, F.col("sid") == F.col("vertex"), "left").select(
            "sid", "n", "hot", "folded", F.coalesce("component", "sid").alias("component")
        )
        sized = written(sized, "sized")
        # A partner may be as small as PERCENT of the set: skip no more than it may.
        spare = F.ceil(F.ceil(F.col("n") * self.percent / 100) * EXTRA)
        heavy = sized.where(F.size("hot") > spare)
        members = written(heavy.select(F.explode("hot").alias("post"), "sid", "n", "folded", "component").select("post.*", "sid", "n", "folded", "component"), "long")
        spread = members.groupBy("token").agg(
            F.min("component").alias("one"), F.max("component").alias("other"), F.count(F.lit(1)).alias("size")
        )
        mixed = spread.where("one <> other").select(F.col("token").alias("t"), F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
        listed = members.join(mixed, F.col("token") == F.col("t")).withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
        pieces = listed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        piece = ["token", "low", "high"]
        pieces = pieces.select(
            "token", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "block", "sid", "n",
            F.col("at").cast("long").alias("at"), "component", "folded",
        )
        met = pieces.repartition(*piece).sortWithinPartitions(*piece).mapInArrow(_block_edges(self.percent), "a long, b long")
        met = written(met.distinct(), "met")
        clusters = known
        if not met.isEmpty():
            clusters = components(first.unionAll(met))
            discard(known)
        of_set = sized.drop("component").join(clusters, F.col("sid") == F.col("vertex"), "left").select(
            F.col("sid").alias("s"), "n", F.size("hot").cast("long").alias("hot"),
            F.coalesce("component", "sid").alias("component"),
        )
        short = lists.where("at >= 0").join(of_set, F.col("sid") == F.col("s"))
        short = short.select("token", "sid", "n", F.col("at").cast("long").alias("at"), "hot", "component")
        received = short.repartition("token").sortWithinPartitions("token").mapInArrow(
            _partners_in_lists(self.percent), "own long, others array<long>, needed array<long>"
        )
        merged = received.repartition("own").sortWithinPartitions("own").mapInArrow(_occurrences, "a long, b long")
        pairs = written(merged.distinct().join(proposed, ["a", "b"], "left_anti"), "pairs")
        discard(lists, proposed, sized, members)
        second = self.verified(pairs)
        discard(pairs)
        return first, met, clusters, second


def one_of_each(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """The rows of ``docs`` with one row of each group of similar documents: that with the smallest key.

    Of equal keys the text with the smaller hash stays, of repeated rows one; null keys come last. Documents without
    words all stay.
    """
    named = written(_Join(docs, key, text, words, percent).grouped().where("group IS NOT NULL"), "grouped")
    large = named.groupBy(F.col("group").alias("g")).agg(
        F.count(F.lit(1)).alias("size"), F.min(F.struct(F.col("key").isNull(), "key", "text_hash")).alias("first")
    ).where("size > 1")
    members = named.join(large, F.col("group") == F.col("g")).select(
        F.col("key").alias("__key"), F.col("text_hash").alias("__hash"),
        (F.col("key").eqNullSafe(F.col("first.key")) & (F.col("text_hash") == F.col("first.text_hash"))).alias("__first"),
    )
    members = written(members.distinct(), "members")
    few = members.count() <= BROADCAST_ROWS
    hashed = docs.withColumn("__text_hash", F.xxhash64(text_or_empty(text)))
    same = F.col(key).eqNullSafe(F.col("__key")) & (F.col("__text_hash") == F.col("__hash"))
    firsts = members.where("__first")
    alone = hashed.join(F.broadcast(members) if few else members, same, "left_anti")
    kept = hashed.join(F.broadcast(firsts) if few else firsts, same, "left_semi").dropDuplicates([key, "__text_hash"])
    return alone.unionByName(kept).drop("__text_hash")


def near_copies(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """``key``, ``n_shingles``, ``component_id`` and ``n_links`` of every row.

    Documents link when their sets are similar; ``component_id`` is the smallest key reachable by links, the own one
    included. ``n_links`` counts all other rows a row links with, copies included. Documents without words (or text) have 0 shingles and link
    with nothing, not even with each other. Repeated rows are rows of one component; rows with a null key take part and
    get the smallest key of their component, if any. An empty table gives no rows.
    """
    join = _Join(docs, key, text, words, percent)
    named = join.counted()
    groups = named.where("group IS NOT NULL").groupBy(F.col("group").alias("g"))
    groups = groups.agg(F.min("key").alias("smallest"), F.count(F.lit(1)).alias("size")).where("size > 1")
    return named.join(groups, F.col("group") == F.col("g"), "left").select(
        F.col("key").alias(key),
        F.col("n").alias("n_shingles"),
        F.coalesce("smallest", "key").alias("component_id"),
        "n_links",
    )
