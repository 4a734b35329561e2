"""Exact Jaccard join of word-shingle sets at 0.8, with set-relation skipping.

Candidates. In any common order of tokens, the first ``k`` tokens that two linked sets share are among the
first ``n - ceil(0.8 n) + k`` of each. With ``k`` growing with the set, a pair must meet in ``k`` lists, which
chance and shared passages do not bring about. The order is: rare tokens, then frequent ones, each from many
bytes to few (short words are common, so shingles of them meet by chance, the more the larger the corpus), then
by hash; tokens count as frequent if several sets of one partition hold them and enough do in all. The order
decides only cost, never results, so the list of frequent tokens may be (and is) bounded. Pairs are counted
over the lists of up to ``SHORT`` sets, which are first brought together by their smallest set, so that the many
lists of one group of near copies add up to one row a pair before pairs are shuffled; in a longer list, runs of
compatible sizes become candidate edges as they are, so that no list is squared. A token known to be in many sets is split where it is met: the sets
of one batch form a list of their own, and only the smallest and the largest of a size class go on into the
common list, so that no task gets a list that grows with the corpus. Connected components of the candidate edges become units of work;
large components are split by size class and then into block pairs, so that no task grows with the corpus.

Verification. In a unit tokens are ordered from rare to frequent, and each token's list falls into two blocks
by the token's position in the set: in front, where sets that are linked must meet, and behind. A set visits
the front blocks of its own front tokens only, skips the blocks behind, enters each at the sets of compatible
size, and counts overlaps with the sets met there. Where a highly similar set has been answered already, its
overlaps are taken over and corrected by the lists of the tokens in which the two differ.

Only sets with words take part; equal sets are one node throughout. A node is named by 64 bits of its tokens; a
second, independent name tells different sets of one name apart, which then go by the second.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.common import lean, let_go, let_go_of_shuffles, sized, staged, table, unused
from attesta.llm.components import components
from attesta.llm.shingles import measured_sets, mixed, shingle_sets

#: Linked if 100 * |intersection| >= 80 * |union|.
PERCENT = 80
#: Frequent tokens passed to the workers at most (8 bytes each), and the sum of local counts that makes one.
FREQUENT, FREQUENT_SUM, COUNTED = 1 << 20, 4, 1 << 16
#: Tokens that a worker gathers before it counts them.
COUNT_AT = 500_000
#: Sets of a list whose pairs are counted one by one, and tokens of a set for each list in which a partner must be met.
SHORT, PER_MEETING = 64, 30
#: Bytes from which on shingles count as equally long in the common order.
LONGEST = (1 << 15) - 1
#: Tokens of a unit of work, about.
UNIT_TOKENS = 1_000_000
#: What stands for a null id among the representatives of sets.
NO_ID = -(1 << 63)
#: Names that chance may give to several sets; more would be a fault.
CLASHES = 1 << 16
#: Bits of the filter that tells the set pass which documents are in units.
FILTER_BITS = 1 << 25


def named(tokens: np.ndarray, salt: int) -> int:
    """A 64-bit name of a set; those of different salts are independent."""
    parts = mixed(tokens ^ np.uint64(salt))
    return int((mixed(np.add.reduce(parts, keepdims=True) ^ np.uint64(len(tokens))) ^ np.bitwise_xor.reduce(parts)).view(np.int64)[0])


class Names:
    """Names of sets: the first by default, the second for sets whose first name in ``met`` another set has too."""

    def __init__(self, met: frozenset[int] = frozenset(), bits: int = 64):
        self.met, self.bits = met, bits

    def first(self, tokens: np.ndarray) -> int:
        return named(tokens, 0xD6E8FEB86659FD93) >> (64 - self.bits)

    def second(self, tokens: np.ndarray) -> int:
        return named(tokens, 0xA0761D6478BD642F)

    def __call__(self, tokens: np.ndarray) -> int:
        name = self.first(tokens)
        return self.second(tokens) if name in self.met else name


def meetings(n):
    """``k`` for a set of ``n`` tokens: a linked partner shares so many of their prefixes' tokens (the smaller set's count)."""
    return 1 + n // PER_MEETING


def among(tokens: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Which of ``tokens`` are in the sorted ``chosen``."""
    if not len(chosen):
        return np.zeros(len(tokens), bool)
    return chosen[np.minimum(np.searchsorted(chosen, tokens), len(chosen) - 1)] == tokens


def prefix(tokens: np.ndarray, sizes: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The first of a set's sorted ``tokens``, whose shingles have ``sizes`` bytes, in the common order."""
    n = len(tokens)
    place = LONGEST - np.minimum(sizes, LONGEST) + (LONGEST + 1) * among(tokens, frequent)
    return tokens[np.argsort(place.astype(np.uint16), kind="stable")[: n - (-(-PERCENT * n // 100)) + meetings(n)]]


def split_lists(tokens: np.ndarray, nodes: np.ndarray, sizes: np.ndarray, salt: int):
    """One batch's entries of tokens that many sets hold -> entries in which no token has more than a few of the batch.

    The members of a token and size class move to a token of their own; its smallest and its largest set stay
    under the old one, so that the common list has the same gaps between sizes.
    """
    group = np.floor(np.log(sizes) / np.log(1.25)).astype(np.int64)
    order = np.lexsort((nodes, sizes, group, tokens))
    tokens, nodes, sizes, group = tokens[order], nodes[order], sizes[order], group[order]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (group[1:] != group[:-1])
    edge = new.copy()
    edge[:-1] |= new[1:]
    edge[-1:] = True
    own = mixed(tokens ^ mixed(group.astype(np.uint64) + np.uint64(salt)))
    return np.concatenate([own, tokens[edge]]), np.concatenate([nodes, nodes[edge]]), np.concatenate([sizes, sizes[edge]])


def _texts(batches: Iterator[pa.RecordBatch], column: int, sets=shingle_sets) -> Iterator[tuple[pa.RecordBatch, list]]:
    let_go()
    with np.errstate(over="ignore"):
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                yield part, sets(part.column(column).to_pylist())


def nodes(documents: DataFrame, names: Names) -> DataFrame:
    """doc_id, text_hash, node and second (its other name; both null without words), n_shingles of every row."""
    def run(batches):
        for batch, sets in _texts(batches, 1):
            first, second = ([name(s) if len(s) else None for s in sets] for name in (names.first, names.second))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array([len(s) for s in sets], pa.int64())],
                names=["doc_id", "text_hash", "node", "second", "n_shingles"],
            )

    rows = documents.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, node long, second long, n_shingles long")


def clashes(named_rows: DataFrame) -> frozenset[int]:
    """First names that different sets share: of n sets about n * n / 2**65, so a few hundred even of 10**11."""
    met = named_rows.where("node is not null").groupBy("node").agg(F.min("second").alias("a"), F.max("second").alias("b")).where("a <> b").select("node").limit(CLASHES + 1).collect()
    if len(met) > CLASHES:
        raise ValueError("more names are shared than chance explains")
    return frozenset(r["node"] for r in met)


def frequent_tokens(documents: DataFrame, names: Names) -> tuple[np.ndarray, np.ndarray]:
    """(sorted tokens that leave the prefixes, those of them that more than ``SHORT`` sets hold): of the tokens that two
    different sets of one partition share, counts summed over partitions, the ``FREQUENT`` commonest with ``FREQUENT_SUM`` or more."""
    def run(batches):
        seen: set[int] = set()
        parts: list[np.ndarray] = []
        held = 0
        once = np.zeros(0, np.uint64)
        totals: tuple[np.ndarray, np.ndarray] = (once, np.zeros(0, np.int64))

        def merged():
            """The counts so far with those of ``parts`` added."""
            fresh, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (once, np.zeros(0, np.int64))
            values = np.concatenate([totals[0], fresh])
            order = np.argsort(values, kind="stable")
            values, count = values[order], np.concatenate([totals[1], n])[order]
            start = np.flatnonzero(np.concatenate([np.ones(min(1, len(values)), bool), values[1:] != values[:-1]]))
            return values[start], np.add.reduceat(count, start) if len(start) else count

        for _, sets in _texts(batches, 0):
            for s in sets:
                if len(s) and (name := names(s)) not in seen:
                    seen.add(name)
                    parts.append(s)
                    held += len(s)
            if held > COUNT_AT:
                totals, parts, held = merged(), [], 0
                if len(totals[0]) > 2 * COUNT_AT:  # bounded: what has been met once only is let go
                    more = totals[1] > 1
                    totals = totals[0][more], totals[1][more]
        values, count = merged()
        values, count = values[count > 1], count[count > 1]
        for i in range(0, len(values), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(values[i : i + (1 << 16)].view(np.int64)), pa.array(count[i : i + (1 << 16)])], names=["token", "n"])

    local = documents.select("text").mapInArrow(run, "token long, n long")
    sums = staged(local.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT_SUM), "frequent")
    # The least sum from which on at most FREQUENT tokens remain, out of a bounded histogram.
    found, least = 0, COUNTED + 1
    for row in sorted(sums.groupBy(F.least("n", F.lit(COUNTED)).alias("n")).count().collect(), reverse=True):
        found += row["count"]
        if found > FREQUENT:
            break
        least = row["n"]
    chosen = sums.where(F.col("n") >= least).select("token", "n").toArrow()
    tokens, n = np.asarray(chosen.column(0).to_numpy(), np.int64).view(np.uint64), chosen.column(1).to_numpy()
    return np.sort(tokens), np.sort(tokens[n > SHORT])


def candidate_edges(documents: DataFrame, frequent: np.ndarray, common: np.ndarray, names: Names) -> DataFrame:
    """Distinct (a, b): pairs that meet often enough in short lists, and in each long list every set with the
    first of its run of compatible sizes. Lists of ``common`` tokens count as long whatever their length."""
    hot = documents.sparkSession.sparkContext.broadcast((frequent, common))

    def run(batches):
        from pyspark import TaskContext

        often, shared = hot.value
        seen: set[int] = set()  # equal sets of a partition enter once
        salt = (TaskContext.get().partitionId() + 1) << 32
        for _, sets in _texts(batches, 0, measured_sets):
            new = {names(s): (s, b) for s, b in sets if len(s)}
            new = {k: s for k, s in new.items() if k not in seen}
            seen.update(new)
            salt += 1
            if new:
                parts = [prefix(s, b, often) for s, b in new.values()]
                times = [len(t) for t in parts]
                tokens, node = np.concatenate(parts), np.repeat(np.array(list(new), np.int64), times)
                sizes = np.repeat(np.array([len(s) for s, _ in new.values()], np.int32), times)
                long = among(tokens, shared)
                for whole, some in ((False, (tokens[~long], node[~long], sizes[~long])), (True, split_lists(tokens[long], node[long], sizes[long], salt * 64) if long.any() else None)):
                    if some is not None and len(some[0]):
                        yield pa.RecordBatch.from_arrays([pa.array(some[0].view(np.int64)), pa.array(some[1]), pa.array(some[2], pa.int32()), pa.array(np.full(len(some[0]), whole))], names=["token", "node", "n", "long"])

    entries = documents.select("text").mapInArrow(run, "token long, node long, n int, long boolean")
    lists = entries.withColumn("sets", F.count("*").over(Window.partitionBy("token"))).where("sets > 1")
    is_long = F.col("long") | (F.col("sets") > SHORT)
    # Short lists: bounded arrays, all pairs of compatible sizes, smaller set first.
    members = F.array_sort(F.collect_set(F.struct("n", "node")))
    short = lists.where(~is_long).groupBy("token").agg(members.alias("m")).where("size(m) > 1").select("m").repartition(F.col("m")[0]["node"])
    pairs = F.flatten(
        F.transform("m", lambda x, i: F.transform(F.filter(F.slice("m", i + 2, F.lit(SHORT)), lambda y: 100 * x["n"] >= PERCENT * y["n"]), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b"), x["n"].alias("n"))))
    )
    met = short.select(F.explode(pairs).alias("p")).select("p.*").groupBy("a", "b").agg(F.count("*").alias("met"), F.first("n").alias("n"))
    near = met.where(F.col("met") >= 1 + F.floor(F.col("n") / PER_MEETING)).select("a", "b")
    order = Window.partitionBy("token").orderBy("n", "node")
    before = F.lag("n").over(order)
    fresh = before.isNull() | (100 * before < PERCENT * F.col("n"))
    head = F.last(F.when(F.col("fresh"), F.col("node")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    runs = lists.where(is_long).withColumn("fresh", fresh).withColumn("head", head).where("head <> node").select(F.col("head").alias("a"), F.col("node").alias("b"))
    return near.unionByName(runs).distinct()


def units(members: DataFrame) -> DataFrame:
    """(node, rep, comp, n) -> (node, rep, unit): every pair of compatible sizes in a component meets in some unit.

    Components of up to ``UNIT_TOKENS`` are dealt by hash into units, so many that an average one holds an eighth
    of that; a larger one is split by size class (a factor of 1.25, so that linked sets are in the same or in neighbouring classes), and a class
    pair that is still too large into pairs of hash blocks.
    """
    sizes = members.groupBy("comp").agg(F.sum("n").alias("tokens"))
    total = sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    buckets = max(1, -(-8 * total // UNIT_TOKENS))
    sized = members.join(sizes, "comp")
    small = sized.where(F.col("tokens") <= UNIT_TOKENS).select("node", "rep", F.concat_ws("/", F.lit("s"), F.pmod(F.xxhash64("comp"), F.lit(buckets)).cast("string")).alias("unit"))
    top = F.floor(F.log("n") / F.log(F.lit(1.25))).cast("int")
    split = sized.where(F.col("tokens") > UNIT_TOKENS).withColumn("class", F.explode(F.array(top, top - 1)))
    loads = split.groupBy("comp", "class").agg((F.floor(F.sum("n") / UNIT_TOKENS) + 1).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int")
    large = (
        split.join(loads, ["comp", "class"])
        .withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("node", "rep", F.concat_ws("/", "comp", "class", F.least("block", "other"), F.greatest("block", "other")).alias("unit"))
    )
    return small.unionByName(large)


class _Filter:
    """A Bloom filter of fixed size over 64-bit ids."""

    def __init__(self):
        self.bits = np.zeros(FILTER_BITS // 8, np.uint8)

    @staticmethod
    def _places(ids: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = mixed(np.asarray(ids, np.int64).view(np.uint64))
        return np.stack([h & np.uint64(FILTER_BITS - 1), (h >> np.uint64(32)) & np.uint64(FILTER_BITS - 1)]).astype(np.int64)

    def add(self, ids: np.ndarray) -> None:
        for place in self._places(ids):
            np.bitwise_or.at(self.bits, place >> 3, (1 << (place & 7)).astype(np.uint8))

    def has(self, ids: np.ndarray) -> np.ndarray:
        a, b = self._places(ids)
        return ((self.bits[a >> 3] >> (a & 7)) & (self.bits[b >> 3] >> (b & 7)) & 1).astype(bool)


def _member_filter(members: DataFrame) -> _Filter:
    """Built from per-task filters of fixed size, merged pairwise on the way; the driver gets one filter's bytes a partition group."""
    def run(batches):
        own = _Filter()
        for batch in batches:
            own.add(batch.column(0).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([own.bits.tobytes()], pa.binary())], names=["bits"])

    found = _Filter()
    for row in members.select("rep").coalesce(4).mapInArrow(run, "bits binary").toLocalIterator():
        found.bits |= np.frombuffer(row["bits"], np.uint8)
    return found


def linked(names: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """For each set the smallest name it is connected to by links, all links of the unit followed."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    names, sets = names[order], [sets[i] for i in order]
    k = len(sets)
    n = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(k), n)
    tokens, code = np.unique(np.concatenate(sets), return_inverse=True)
    times = np.bincount(code.reshape(-1), minlength=len(tokens))
    rank = np.empty(len(tokens), np.int64)
    rank[np.argsort(times, kind="stable")] = np.arange(len(tokens))
    code = rank[code.reshape(-1)]  # from rare to frequent
    shared = np.sort(times)[code] > 1  # a token of one set links nothing, but stands before all others
    both = np.sort(owner[shared] * len(tokens) + code[shared])
    owner, code = both // len(tokens), both % len(tokens)
    start = np.searchsorted(owner, np.arange(k + 1))
    position = np.arange(len(owner)) - start[owner] + (n - np.diff(start))[owner]
    front = position <= (n - -(-PERCENT * n // 100))[owner]
    # Each token's list in order of size: the block in front, and all of it.
    ahead, whole = np.sort(code[front] * k + owner[front]), np.sort(code * k + owner)
    fronts = np.bincount(owner[front], minlength=k)
    high = np.searchsorted(n, 100 * n // PERCENT, side="right")
    parent = np.arange(k)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def spread(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The numbers first[i], ..., first[i] + sizes[i] - 1 for every i."""
        return np.repeat(first - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())

    def members(lists: np.ndarray, part: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """The sets in [lo, hi) that stand in the lists of the tokens ``part``, once for each; the others are skipped."""
        first, last = np.searchsorted(lists, part * k + lo), np.searchsorted(lists, part * k + hi)
        return lists[spread(first, last - first)] % k

    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    twin = np.full(k, -1)
    apart = np.full(k, np.iinfo(np.int64).max)
    mark = np.zeros(len(tokens), bool)
    for x in range(k):
        mine = code[start[x] : start[x + 1]]
        lo, hi = x + 1, int(high[x])
        met = np.unique(members(ahead, mine[: fronts[x]], lo, hi)) if fronts[x] and lo < hi else np.zeros(0, np.int64)
        if not len(met):
            continue
        overlap, todo = np.zeros(len(met), np.int64), np.ones(len(met), bool)
        r = int(twin[x])
        if r in known:
            theirs, (their_met, their_overlap) = code[start[r] : start[r + 1]], known[r]
            at = np.minimum(np.searchsorted(their_met, met), len(their_met) - 1)
            todo = their_met[at] != met
            more, less = (np.bincount(members(whole, np.setdiff1d(a, b, True), lo, hi) - lo, minlength=hi - lo) for a, b in ((mine, theirs), (theirs, mine)))
            overlap = np.where(todo, 0, their_overlap[at] + more[met - lo] - less[met - lo])
        if todo.any():
            mark[mine] = True
            others = met[todo]
            sizes = start[others + 1] - start[others]
            overlap[todo] = np.add.reduceat(mark[code[spread(start[others], sizes)]].astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            mark[mine] = False
        differ = n[met] + n[x] - 2 * overlap
        close = (differ * 5 < n[met]) & (differ < apart[met])
        if close.any():
            known[x] = met, overlap
            twin[met[close]], apart[met[close]] = x, differ[close]
            if len(known) > 64:
                del known[next(iter(known))]
        for y in met[100 * overlap >= PERCENT * (n[met] + n[x] - overlap)]:
            a, b = root(x), root(int(y))
            if a != b:
                parent[max(a, b)] = min(a, b)
    roots = np.array([root(i) for i in range(k)])
    least = np.full(k, np.iinfo(np.int64).max)
    np.minimum.at(least, roots, names)
    out = np.empty(k, np.int64)
    out[order] = least[roots]
    return out


def links(documents: DataFrame, dealt: DataFrame, members: int, names: Names) -> DataFrame:
    """(a, b): within each unit, each set that is linked with another, and the smallest name of its group there."""
    there = documents.sparkSession.sparkContext.broadcast(_member_filter(dealt))

    def sets_of(batches):
        for batch in batches:
            # Rows without an id stand for a text that only such rows hold.
            some = there.value.has(batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False))
            picked = batch.filter(pa.array(some))
            for part, sets in _texts(iter([picked]), 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([names(s) if len(s) else None for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["rep", "node", "tokens"])

    sets = documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(sets_of, "rep long, node long, tokens binary")
    dealt = sized(dealt, members)
    # Repeated ids may bring other texts under a representative's id: both must agree.
    rows = sets.withColumn("rep", F.coalesce("rep", F.lit(NO_ID))).join(dealt, ["rep", "node"]).select("unit", "node", "tokens")

    def run(group):
        let_go()
        distinct, at = np.unique(group.column("node").to_numpy(), return_index=True)
        tokens = group.column("tokens").take(pa.array(at)).to_pylist()
        with np.errstate(over="ignore"):
            least = linked(distinct, [np.frombuffer(t, np.uint64) for t in tokens])
        other = least != distinct
        return pa.table({"a": pa.array(least[other]), "b": pa.array(distinct[other])})

    return rows.groupBy("unit").applyInArrow(run, "a long, b long")


def join(documents: DataFrame, name_bits: int = 64) -> DataFrame:
    """Return doc_id, n_shingles, component_id of every row: the smallest doc_id reachable by links.

    Needs doc_id and text. Words are maximal runs of anything but ASCII white space, A-Z lower-cased; a
    set holds all distinct shingles of five words, or the whole sequence if there are fewer. A null,
    empty or blank text has an empty set, is linked with nothing and is its own component; equal sets
    are linked. Repeated rows count each; a null doc_id never names a component that has another id, but
    its text links like any other. An empty table gives an empty result; other columns are ignored. Texts
    are read whole. Sets are named by ``name_bits``; results do not depend on it.
    """
    return _grouped(documents, name_bits).select("doc_id", "n_shingles", "component_id")


def _grouped(documents: DataFrame, name_bits: int = 64) -> DataFrame:
    """What ``join`` returns, with text_hash and ``root``, which tells the components of one smallest id apart (null without words)."""
    documents = lean(documents).select("doc_id", "text")
    found = staged(nodes(documents, Names(bits=name_bits)), "nodes")
    names = Names(clashes(found), name_bits)
    if names.met:
        found = found.withColumn("node", F.when(F.col("node").isin(list(names.met)), F.col("second")).otherwise(F.col("node")))
    groups = staged(components(candidate_edges(documents, *frequent_tokens(documents, names), names)), "candidates")
    let_go_of_shuffles(documents.sparkSession)
    info = found.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"))
    members = info.join(groups.select("node", F.col("root").alias("comp")), "node")
    members = members.withColumn("rep", F.coalesce("rep", F.lit(NO_ID)))
    dealt = staged(units(staged(members, "members")), "units")
    linked_nodes = components(links(documents, dealt, dealt.count(), names))
    # Node -> component: the smallest document of all nodes under one root.
    rooted = info.join(linked_nodes, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_node = rooted.join(least, "root").select("node", "root", "component_id")
    return found.join(by_node, "node", "left").select("doc_id", "text_hash", "root", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def deduplicate(documents: DataFrame) -> DataFrame:
    """``documents``, all columns, with one row of each component: that of its smallest doc_id.

    Rows without words (null, empty or blank texts) and rows with a null doc_id all stay. Where several rows
    of that id are in the component, one with the least text hash stays. An empty table stays empty; columns
    pass through whatever their names.
    """
    found = staged(_grouped(documents), "components")
    own = found.where("doc_id = component_id and root is not null")
    key, digest, nth = (unused(documents, n) for n in ("gone_id", "gone_hash", "nth"))
    several = staged(own.groupBy("doc_id", "root").agg(F.min("text_hash").alias("least"), F.count("*").alias("n")).where("n > 1"), "several")
    other = found.where("doc_id <> component_id").select("doc_id", "text_hash").union(own.join(several, ["doc_id", "root"]).where("text_hash <> least").select("doc_id", "text_hash"))
    gone = staged(other.distinct().toDF(key, digest), "gone")
    same = (F.col("doc_id") == F.col(key)) & (F.xxhash64("text") == F.col(digest))
    kept = documents.join(sized(gone, gone.count()), same, "left_anti")
    if several.isEmpty():
        return kept
    again = several.select("doc_id", "least").toDF(key, digest)
    first = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("text")
    twice = kept.join(again, same, "left_semi").withColumn(nth, F.row_number().over(first)).where(F.col(nth) == 1).drop(nth)
    return kept.join(again, same, "left_anti").unionByName(twice)


def op8_jaccard(spark, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))



SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(words) >= 5 THEN list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')))
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END AS s
  FROM w),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sets UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, r.component_id
FROM sets s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) r USING (doc_id)
"""
