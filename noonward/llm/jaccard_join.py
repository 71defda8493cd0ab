"""Jaccard join of documents on word n-grams, by adaptive multi-match prefixes.

All documents order their n-grams in the same way: by hash, with the most frequent ones (a bounded list, counted
over all documents) put last. Two sets of sizes n and m that reach the similarity share at least a(n) =
ceil(t * n) members, so the first n - a(n) + 1 members of one must meet those of the other. Each document
lengthens this prefix to n - a(n) + q members, and then two similar documents must share at least the smaller of
their two q before they are looked at. How far depends on the estimated cost: q grows with the size of the set,
and again for each frequent n-gram in its reach, since leaving those for last lengthens the prefix by as many.

1. Equal sets are one set, known by the least doc_id of its copies.
2. Prefix members are dealt out by n-gram; those that only one set holds go no further.
3. Sets that share fewer members than they must are dropped, and again with what is left of each n-gram's sets.
4. Pairs that share as many members as they must connect the rest into clusters. A cluster is not a result: it is
   a set of documents outside which they have no links. Large ones, which common lines hold together, are parted by
   what is rare inside of them; those that stay large are cut into blocks, and each pair of blocks is a task.
5. In each task, full sets are compared exactly. A breadth-first search compares the set at hand with those not
   reached yet that share one of its rarest members, so that copies cost one comparison each, and no link between
   components is missed.
6. The links found, one per set and task at most, are joined up to components.
"""

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noonward.llm.common import slices, unused
from noonward.llm.components import components
from noonward.llm.skew import join_counted
from noonward.session import discard, store


#: The bytes between words, as bytes.split() has them.
BLANK = np.isin(np.arange(256), [*b" \t\n\v\f\r"])
#: What leaves the first bytes of eight, by their number.
FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Words that are hashed at a time, and bytes from which on a word is hashed by itself.
AT_ONCE, LONG = 1 << 16, 64


@dataclass(frozen=True)
class Settings:
    """`words` per n-gram; links from `percent` of similarity on."""

    words: int = 5
    percent: int = 80
    #: The frequent n-grams that go last: those in `frequent` prefixes or more, and of them `listed` at most.
    frequent: int = 64
    listed: int = 1 << 16
    #: One more match is asked for per so many members.
    per_match: int = 32
    #: A member that up to so many sets have is looked at pair by pair.
    few: int = 32
    #: Members of sets in a block, and about so many in a task.
    block: int = 1_000_000

    def least_shared(self, n):
        """a(n): members that a set of n shares with any set that is similar to it."""
        return -(-self.percent * n // 100)

    def base_matches(self, n):
        return np.minimum(self.least_shared(n), 1 + n // self.per_match)

    def needed(self, n):
        """Members that must be shared with a similar set, whatever its size: such a set has at least a(n)."""
        return self.base_matches(self.least_shared(n))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words at `starts` in `data`, which has seven bytes or more after the last word.

    Eight bytes of all words are taken at a time, so words of at most eight bytes have equal hashes only if they are equal.
    Longer words than LONG are few, and hashed one by one.
    """
    eight = np.lib.stride_tricks.sliding_window_view(data, 8)
    out = sizes.astype(np.uint64)
    for first in range(0, len(starts), AT_ONCE):
        own = out[first : first + AT_ONCE]
        long = sizes[first : first + AT_ONCE] > LONG
        live = np.flatnonzero(~long)
        at, left = starts[first + live], sizes[first + live]
        while len(live):
            taken = eight[at].view("<u8")[:, 0] & FIRST_BYTES[np.minimum(left, 8)]
            own[live] = mixed(own[live] * MULTIPLIER + taken)
            more = left > 8
            live, at, left = live[more], at[more] + 8, left[more] - 8
        for i in np.flatnonzero(long):
            word = data[starts[first + i] : starts[first + i] + sizes[first + i]]
            own[i] = np.frombuffer(hashlib.blake2b(word.tobytes(), digest_size=8).digest(), np.uint64)[0]
    return out


def rolled(hashes: np.ndarray, words: int) -> np.ndarray:
    """The hashes of all runs of so many words."""
    runs = max(0, len(hashes) - words + 1)
    out = np.full(runs, np.uint64(words))
    for k in range(words):
        out = mixed(out * MULTIPLIER + hashes[k : k + runs])
    return out


def distinct(hashes: np.ndarray) -> np.ndarray:
    """Sorted, each once. The array given is sorted in its place."""
    hashes.sort()
    new = np.ones(len(hashes), bool)
    np.not_equal(hashes[1:], hashes[:-1], out=new[1:])
    return hashes[new]


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """The sorted 64-bit hashes of the distinct word n-grams of each whole text, A-Z in lower case.

    A text with fewer words has its whole sequence as the only one; one without words has none. Words are found and
    hashed in all texts at once: there is a step in Python for each text, none for each word.
    """
    lower = [t.encode().lower() for t in texts]
    data = np.frombuffer(b"\n".join([b"", *lower, bytes(8)]), np.uint8)  # starts and ends with a blank
    blank = BLANK[data[:-8]]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    hashes = word_hashes(data, starts, sizes)
    runs = rolled(hashes, words)
    ends = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in lower], dtype=np.int64))
    out, first = [], 0
    for end in ends.tolist():
        if end - first >= words:
            out.append(distinct(runs[first : end - words + 1]))
        else:
            out.append(rolled(hashes[first:end], end - first) if end > first else hashes[:0])
        first = end
    return out


def set_digest(members: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    a, b = np.frombuffer(hashlib.blake2b(members.tobytes(), digest_size=16).digest(), np.int64)
    return int(a), int(b)


def prefix_of(members: np.ndarray, s: Settings, listed: np.ndarray) -> np.ndarray:
    """The members a set is looked up by. `listed`: the frequent ones, sorted."""
    n = len(members)
    wanted = n - s.least_shared(n) + int(s.base_matches(n))
    if listed.size and n:
        at = np.minimum(np.searchsorted(listed, members), listed.size - 1)
        common = listed[at] == members
        rare = np.flatnonzero(~common)
        # the prefix ends where it has enough rare members; it may ask for as many matches as the smallest partner shares
        longest = n - s.least_shared(n) + int(s.least_shared(s.least_shared(n)))
        if len(rare) >= wanted and rare[wanted - 1] < longest:
            return members[rare[:wanted]]
        return members
    return members[:wanted]


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(ends, pa.array(flat.view(np.int64), pa.int64()))


def _sets(docs: DataFrame, s: Settings, listed: np.ndarray) -> DataFrame:
    """doc_id, tag, n, digest (hi, lo) and prefix of each row of (doc_id, tag, text)."""

    def run(batches):
        for batch, texts in slices(batches, "text"):
            sets = shingle_sets(texts, s.words)
            digests = [set_digest(m) for m in sets]
            columns = {
                "doc_id": batch.column("doc_id"),
                "tag": batch.column("tag"),
                "n": pa.array([len(m) for m in sets], pa.int64()),
                "hi": pa.array([d[0] for d in digests], pa.int64()),
                "lo": pa.array([d[1] for d in digests], pa.int64()),
                "prefix": _lists([prefix_of(m, s, listed) for m in sets]),
            }
            yield pa.RecordBatch.from_arrays([*columns.values()], names=[*columns])

    return docs.mapInArrow(run, "doc_id long, tag binary, n long, hi long, lo long, prefix array<long>")


def frequent_members(sets: DataFrame, s: Settings) -> np.ndarray:
    """The members found in most prefixes, `listed` at most, sorted."""
    counts = sets.select(F.explode("prefix").alias("member")).groupBy("member").count()
    top = counts.filter(F.col("count") >= s.frequent).orderBy(F.desc("count"), "member").limit(s.listed)
    return np.sort(np.array([r[0] for r in top.select("member").collect()], np.int64).view(np.uint64))


def _least_shared(s: Settings, n):
    return F.ceil(n * s.percent / 100)


def _base_matches(s: Settings, n):
    return F.least(_least_shared(s, n), F.floor(n / s.per_match) + 1)


def _needed(s: Settings):
    return _base_matches(s, _least_shared(s, F.col("n")))


def _peeled(hits: DataFrame, s: Settings) -> DataFrame:
    """Of (member, doc_id, n) those whose set has enough members that other sets have as well.

    With each comes how many of these sets have the member, and the first of them.
    """
    hits = hits.select("member", "doc_id", "n")
    enough = hits.groupBy("doc_id").agg(F.count("*").alias("shared"), F.max("n").alias("n"))
    enough = enough.filter(F.col("shared") >= _needed(s)).select("doc_id")
    left = hits.join(enough, "doc_id", "left_semi")
    groups = left.groupBy("member").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("held"))
    return store(left.join(groups.filter("first <> last").drop("last"), "member"))


def _candidates(hits: DataFrame, s: Settings) -> DataFrame:
    """Pairs (a, b) that connect all documents among which there may be links.

    A member that few sets have says which pairs share it; pairs that share at least the smaller of their q stay,
    counted over all such members. Near copies share most members, so each list of sets is taken once, with the number
    of members that have it. A member of many sets connects all of them to the first instead, so that rows
    never grow with the square of a group.
    """
    few = hits.filter(F.col("held") <= s.few).groupBy("member")
    rows = few.agg(F.sort_array(F.collect_list(F.struct("doc_id", "n"))).alias("sets"))
    lists = rows.groupBy("sets").agg(F.count(F.lit(1)).alias("times"))

    def later(a, i):
        near = F.filter(F.slice("sets", i + 2, s.few), lambda b: F.greatest(a.n, b.n) * s.percent <= F.least(a.n, b.n) * 100)
        return F.transform(near, lambda b: F.struct(a.doc_id.alias("a"), b.doc_id.alias("b"), F.least(a.n, b.n).alias("n")))

    pairs = lists.select("times", F.explode(F.flatten(F.transform("sets", later))).alias("pair")).select("times", "pair.*")
    counted = pairs.groupBy("a", "b").agg(F.sum("times").alias("shared"), F.min("n").alias("n"))
    enough = counted.filter(F.col("shared") >= _base_matches(s, F.col("n"))).select("a", "b")
    many = hits.filter(F.col("held") > s.few).select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    return enough.union(many.distinct())


def _shared_members(prefixes: DataFrame, listed: np.ndarray) -> DataFrame:
    """(member, doc_id, n) of members in the prefixes of two sets or more.

    Frequent members are few (a bounded list) but their sets are many: their ends are minima and maxima, which
    combine before the shuffle, and come back by a broadcast. Others are looked through in order, member by member.
    """
    spark = prefixes.sparkSession
    each = prefixes.select(F.explode("prefix").alias("member"), "doc_id", "n")
    common = spark.createDataFrame(pd.DataFrame({"member": listed.view(np.int64)}), "member long")
    of_rare = each.join(F.broadcast(common), "member", "left_anti") if listed.size else each
    w = Window.partitionBy("member")
    ends = {"_first": F.min("doc_id").over(w), "_last": F.max("doc_id").over(w)}
    found = of_rare.withColumns(ends).filter("_first <> _last").drop("_first", "_last")
    if listed.size:
        own = each.join(F.broadcast(common), "member", "left_semi")
        two = own.groupBy("member").agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last"))
        two = two.filter("_first <> _last").select("member")  # no more than are listed
        found = found.unionByName(own.join(F.broadcast(two), "member", "left_semi"))
    return found


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions of the ranges, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def linked(ids: list, sets: list[np.ndarray], percent: int) -> list[tuple]:
    """Links (id, id) that join up all sets of the list that similarity joins, one per set at most.

    Members are ranked by how many sets of the list have them, and a set of n is looked up by its n - a(n) + 1 rarest:
    similar sets share one of these. So what is common in the list, as lines that its texts quote, is hardly looked up.
    """
    sizes = np.array([len(m) for m in sets], np.int64)
    starts = np.cumsum(sizes) - sizes
    _, codes, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(held), np.int64)
    rank[np.argsort(held, kind="stable")] = np.arange(len(held))
    owner = np.repeat(np.arange(len(sets)), sizes)
    ranked = np.sort(owner * len(held) + rank[codes]) - owner * len(held)  # set by set, the rarest first
    looked = np.arange(len(ranked)) - starts[owner] < (sizes - -(-percent * sizes // 100) + 1)[owner]
    keys, owners = ranked[looked], owner[looked]
    firsts = np.searchsorted(owners, np.arange(len(sets) + 1))  # where a set's keys are
    by_key = np.argsort(keys, kind="stable")
    keys_sorted, there = keys[by_key], owners[by_key]  # the sets of each key that are not reached yet
    is_open, open_then, left = np.ones(len(sets), bool), len(sets), len(sets)
    low, high = np.searchsorted(keys_sorted, keys), np.searchsorted(keys_sorted, keys, "right")
    meets = np.add.reduceat(high - low > 1, firsts[:-1])  # the keys that a set shares with any other
    marked = np.zeros(len(held), bool)
    out = []
    for first in np.flatnonzero(meets).tolist():
        queue = [first] if is_open[first] else []
        left -= len(queue)
        is_open[first] = False
        while queue and left:
            x = queue.pop()
            own = slice(firsts[x], firsts[x + 1])
            near = there[_ranges(low[own], high[own] - low[own])]
            near = np.unique(near[is_open[near]])
            near = near[100 * np.minimum(sizes[near], sizes[x]) >= percent * np.maximum(sizes[near], sizes[x])]
            if not len(near):
                continue
            mine = ranked[starts[x] : starts[x] + sizes[x]]
            marked[mine] = True
            found = marked[ranked[_ranges(starts[near], sizes[near])]]
            marked[mine] = False
            shared = np.add.reduceat(found, np.cumsum(sizes[near]) - sizes[near], dtype=np.int64)
            near = near[100 * shared >= percent * (sizes[x] + sizes[near] - shared)]
            out += [(ids[x], ids[y]) for y in near.tolist()]
            is_open[near] = False
            left -= len(near)
            queue += near.tolist()
            if 2 * left < open_then:
                keep = is_open[there]
                keys_sorted, there, open_then = keys_sorted[keep], there[keep], left
                low, high = np.searchsorted(keys_sorted, keys), np.searchsorted(keys_sorted, keys, "right")
    return out


def _full_sets(docs: DataFrame, wanted: DataFrame, s: Settings) -> DataFrame:
    """`wanted` (own, hi, lo and others) with the members of each set, read from the texts of the documents `own`.

    A document's other texts, which are other sets, are told by their digests.
    """
    # a list of documents grows with the corpus, so it is not broadcast, however short it looks on a small one
    own = docs.select(F.col("doc_id").alias("own"), "text").join(wanted.hint("merge"), "own")
    passed = [c for c in wanted.columns if c not in ("own", "hi", "lo")]

    def run(batches):
        for batch, texts in slices(batches, "text"):
            sets = shingle_sets(texts, s.words)
            own = zip(batch.column("hi").to_pylist(), batch.column("lo").to_pylist())
            meant = [i for i, (m, digest) in enumerate(zip(sets, own)) if set_digest(m) == digest]
            kept = [batch.column(c).take(pa.array(meant, pa.int64())) for c in passed]
            yield pa.RecordBatch.from_arrays([*kept, _lists([sets[i] for i in meant])], names=[*passed, "members"])

    return own.mapInArrow(run, ", ".join(f"{c} long" for c in passed) + ", members array<long>")


def _totals(clustered: DataFrame) -> DataFrame:
    return clustered.groupBy("cluster").agg(F.sum("n").alias("total"))


def _parted(sets: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, n, cluster): smaller clusters for the sets (doc_id, n, cluster, members) of large ones.

    As at first, but members are ordered by how many sets of the cluster have them, the rarest first, and all members
    are counted: what ties a large cluster together, as lines that many texts quote, goes last.
    """
    each = sets.dropDuplicates(["doc_id"]).select("cluster", "doc_id", "n", F.explode("members").alias("member"))
    each = store(each.select("doc_id", "n", F.xxhash64("cluster", "member").alias("member")))
    counts = each.groupBy("member").agg(F.count(F.lit(1)).alias("held"))
    ranked = join_counted(each, counts, ["member"], "held", each.count())
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("held", "member"))
    wanted = F.col("n") - _least_shared(s, F.col("n")) + _base_matches(s, F.col("n"))
    prefixes = store(ranked.withColumn("at", at).filter((F.col("at") <= wanted) & (F.col("held") > 1)).drop("at", "held"))
    once = _peeled(prefixes, s)
    hits = _peeled(once, s)
    found = components(_candidates(hits, s)).select(F.col("id").alias("doc_id"), F.col("component").alias("cluster"))
    parts = store(hits.select("doc_id", "n").distinct().join(found, "doc_id"))
    discard(each, prefixes, once, hits)
    return parts


def _split(docs: DataFrame, clustered: DataFrame, known: DataFrame, s: Settings) -> DataFrame:
    """`clustered` (doc_id, n, cluster) with clusters over a block parted as long as that gets them to half their size.

    Those that stay large are mostly linked throughout, and compared in pairs of blocks.
    """
    done = clustered.filter("false").select("doc_id", "n", "cluster")
    rest, tables = clustered, [clustered]
    while True:
        totals = _totals(rest).filter(F.col("total") > s.block)
        large = rest.join(totals, "cluster")
        done = done.unionByName(rest.join(totals, "cluster", "left_anti").select(*done.columns))
        if totals.isEmpty():
            break
        wanted = large.withColumnRenamed("cluster", "before").join(known, "doc_id")
        sets = store(_full_sets(docs, wanted.select("own", "hi", "lo", "doc_id", "n", "before", "total"), s))
        parts = _parted(sets.select("doc_id", "n", F.col("before").alias("cluster"), "members"), s)
        discard(sets)
        parts = parts.join(large.select("doc_id", F.col("cluster").alias("before"), F.col("total").alias("of")), "doc_id")
        largest = parts.groupBy("before", "cluster").agg(F.sum("n").alias("total")).groupBy("before").agg(F.max("total").alias("most"))
        parts = store(parts.join(largest, "before"))
        tables.append(parts)
        stays = F.col("most") * 2 > F.col("of")
        done = done.unionByName(parts.filter(stays).select(*done.columns))
        rest = parts.filter(~stays).select(*done.columns)
    if len(tables) == 1:
        return clustered
    found = store(done)
    discard(*tables)
    return found


def _blocks(clustered: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, cluster, blocks): into how many blocks a document's cluster is cut; and a task for small clusters."""
    totals = _totals(clustered)
    # the sum of small clusters is one number, from which follows how many tasks they need
    small = totals.filter(F.col("total") <= s.block).agg(F.sum("total")).first()[0] or 0
    tasks = int(math.ceil(small / s.block)) + 1
    cut = totals.select(
        "cluster",
        F.ceil(F.col("total") / s.block).alias("blocks"),
        F.when(F.col("total") <= s.block, F.pmod(F.xxhash64("cluster"), F.lit(tasks))).otherwise(-1).alias("task"),
    )
    return clustered.select("doc_id", "cluster").join(cut, "cluster")


def _links(docs: DataFrame, blocks: DataFrame, s: Settings) -> DataFrame:
    """Links (a, b) between the sets of each cluster."""
    sets = _full_sets(docs, blocks, s)
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks"))
    sets = sets.withColumn("block", block).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    part = {
        "key": F.when(F.col("task") < 0, F.col("cluster")),
        "low": F.least("block", "other"),
        "high": F.greatest("block", "other"),
    }

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, group in rows.groupby("cluster"):
            group = group.drop_duplicates("doc_id")  # repeated rows
            if len(group) > 1:
                out += linked(group["doc_id"].tolist(), group["members"].tolist(), s.percent)
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    parted = sets.withColumns(part).select("task", "key", "low", "high", "cluster", "doc_id", "members")
    return parted.groupBy("task", "key", "low", "high").applyInPandas(compare, "a long, b long")


def jaccard_rows(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, tag, n_shingles, component_id, component) for every row of `docs` (doc_id, tag, text).

    As jaccard_groups; `component` is a number of the component, as two of them may have the same least doc_id if a
    doc_id has several texts. `tag` (binary) is passed on. Sets are nodes with numbers of their own throughout.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "tag", "text")
    none = np.empty(0, np.uint64)
    counted = store(_sets(docs, s, none))
    listed = frequent_members(counted.filter("n > 0"), s)
    first = store(counted.drop("prefix"))
    again = _sets(docs, s, listed) if listed.size else counted
    per_set = again.filter("n > 0").groupBy("hi", "lo").agg(
        F.min("doc_id").alias("own"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("prefix").alias("prefix")
    )
    per_set = store(per_set.withColumn("node", F.monotonically_increasing_id()))  # settled by being written
    discard(counted)
    shared = store(_shared_members(per_set.filter("own is not null").select(F.col("node").alias("doc_id"), "n", "prefix"), listed))
    once = _peeled(shared, s)
    hits = _peeled(once, s)
    discard(shared, once)
    clusters = components(_candidates(hits, s))
    sizes = hits.groupBy("doc_id").agg(F.max("n").alias("n"))
    clustered = sizes.join(clusters.select(F.col("id").alias("doc_id"), F.col("component").alias("cluster")), "doc_id")
    clustered = store(clustered)
    discard(hits)
    known = per_set.select(F.col("node").alias("doc_id"), "own", "hi", "lo")
    clustered = _split(docs, clustered, known, s)
    links = store(_links(docs, _blocks(clustered, s).join(known, "doc_id"), s))
    found = components(links).select(F.col("id").alias("node"), "component")
    named = per_set.select("hi", "lo", "node", "own", "copies").join(found, "node", "left")
    named = store(named.withColumn("component", F.coalesce("component", "node")))
    least = named.groupBy("component").agg(F.min("own").alias("component_id"), F.count(F.lit(1)).alias("held"))
    sets = join_counted(named, least, ["component"], "held", named.count())
    sets = store(sets.select("hi", "lo", "copies", "component", "component_id"))
    total = sets.agg(F.sum("copies")).first()[0] or 0
    discard(per_set, clustered, links, named)
    with_words = join_counted(first.filter("n > 0"), sets, ["hi", "lo"], "copies", total)
    others = first.filter("n = 0").withColumns({"component": F.lit(None).cast("long"), "component_id": F.col("doc_id")})
    shown = ["doc_id", "tag", F.col("n").alias("n_shingles"), "component_id", "component"]
    return with_words.select(*shown).unionByName(others.select(*shown))


def jaccard_groups(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of `docs` (doc_id, text; other columns are not used).

    component_id is the least doc_id among all documents that links lead to, the document's own included. Missing
    texts and texts without words have no shingles and are linked with nothing. Rows are taken one by one: repeated
    rows and equal texts are copies of one set, different texts under one doc_id are sets of their own. Rows without a
    doc_id belong to the component of their set's other copies; if those have none either, the component is null, and
    no link goes through them.
    """
    tagged = docs.select("doc_id", F.lit(None).cast("binary").alias("tag"), "text")
    return jaccard_rows(tagged, s).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of `docs` (doc_id, text and others) without near copies: one document of each component stays.

    It is that of the least doc_id, and of several texts there the one of the least digest; of equal rows, and rows
    that differ in other columns alone, one stays. Rows without words or without a doc_id stay, and so do different
    texts under one doc_id that are not linked.
    """
    tag = unused(docs, "_tag")
    tagged = docs.withColumn(tag, F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    rows = jaccard_rows(tagged.select("doc_id", F.col(tag).alias("tag"), "text"), s).filter("doc_id is not null")
    first = rows.filter("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "tag")).alias("first"))
    kept = first.select("first.*").union(rows.filter("component is null").select("doc_id", "tag"))
    kept = kept.distinct().withColumnRenamed("tag", tag)
    there = tagged.filter("doc_id is not null").join(kept, ["doc_id", tag], "left_semi")
    return there.dropDuplicates(["doc_id", tag]).unionByName(tagged.filter("doc_id is null")).select(*docs.columns)
