"""N-gram Jaccard join with vertical partitioning.

Documents are sets of distinct five-word shingles (64-bit hashes).  Documents link at a Jaccard similarity of 0.75 or more,
and each is given the smallest doc_id that links reach.

1. *Fragments of the shingle space.*  Each fragment counts, apart from the others, how many of a set's shingles occur in
   another set too; the partial counts, one row for a batch of texts and a fragment, are summed per batch.  A set with a partner
   shares at least 75 % of its shingles, so all others are done.  A batch sends a shingle that several of its own sets hold
   only once, so a shingle held by a third of all documents stays small.
2. *Global order.*  The shingles of the sets that are left are ordered by frequency, rarest first.  Two linked sets share a
   shingle within the first ``n - ceil(0.75 n) + 1`` of either.
3. *Hubs.*  Members of such a posting list are compared with its most typical member, for a few rounds, and what links is
   contracted.  That settles groups of near copies in time linear in the group.
4. *The rest, exactly.*  Lists that still hold several components are closed into islands; within an island every set outside
   the largest component is compared with all sets of other components, in blocks of bounded size.  The overlap of a pair is the
   sum of the partial overlaps in consecutive fragments of the global order.  Only edges of a spanning forest leave a block.

What is joined to its own aggregate (a list to its hub, a group to its least id) meets it as a written table, so that Spark can split
a key that many rows share.  Sets that are equal are one node throughout (64-bit digest of the set).  Defined cases: null texts and texts without words have
no shingles, link with nothing and are their own component; texts of fewer than five words are one shingle; a null
doc_id takes part and is reported as null only if nothing it links with has an id; repeated rows belong together; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bulwark.llm.common import checkpointed, cut, release, small_batches, text_bytes
from bulwark.llm.components import components

SHINGLE = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Shingles in a fragment of the first step, texts in one batch of it (at most 65,536), sets in one block of the last step.
FRAGMENT = 1_000_000
BATCH = 1024
BLOCK = 512
HUB_ROUNDS = 2
#: Columns of the global order whose partial overlaps are counted at a time.
COLUMNS = 4096
NO_ID = (1 << 63) - 1


def shingles(raw: bytes) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    from xxhash import xxh3_64_intdigest

    words = raw.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, n)
    size = min(SHINGLE, n)
    g = np.full(n - size + 1, size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            g = (g ^ h[k : n - size + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            g ^= g >> np.uint64(29)
    return np.unique(g)


def digest(hashes: np.ndarray) -> int:
    """A set's 64-bit identity, as a signed integer."""
    from xxhash import xxh3_64_intdigest

    return int(np.uint64(xxh3_64_intdigest(hashes.tobytes())).astype(np.int64))


def at_least(n: Column) -> Column:
    """The least overlap of a set of ``n`` with a partner."""
    return F.ceil(n * PERCENT / 100)


def set_rows(docs: DataFrame) -> DataFrame:
    """``id, th, n, sig`` of every row; a null doc_id sorts last, ``th`` stands for the text as it is."""
    small_batches(docs.sparkSession, BATCH)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (part for whole in batches for part in cut(whole, BATCH)):
            sets = [shingles(text_bytes(t)) for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "th": batch["th"], "n": [len(s) for s in sets], "sig": [digest(s) for s in sets]})

    return docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("th"), "text").mapInPandas(run, "id long, th long, n long, sig long")


#: A fragment's rows: the batch, hash remainders of its shingles, for each the place in ``names`` of the set that holds it
#: (``LONE`` if several of the batch do), and of each name the place in its batch.
PACKED = "frag int, batch long, keys binary, owners binary, places binary, names binary"
LONE = 0xFFFF


def packed(batch: pd.DataFrame, fragments: int) -> list[tuple]:
    """One batch of texts dealt out to fragments; fragment -1 has the batch's sets, their sizes and the counts that it settles itself."""
    sets = {digest(s): s for s in (shingles(text_bytes(t)) for t in batch["text"]) if len(s)}
    if not sets:
        return []
    names, sizes = np.array([*sets], np.int64), np.array([len(s) for s in sets.values()])
    h, place = np.concatenate([*sets.values()]), np.repeat(np.arange(len(names)), sizes)
    order = np.argsort(h, kind="stable")
    h, place = h[order], place[order]
    first = np.concatenate([[True], h[1:] != h[:-1]])
    many = np.zeros(len(h), bool)
    many[1:] |= ~first[1:]
    many[:-1] |= ~first[1:]
    known = np.bincount(place[many], minlength=len(names))
    # a shingle known to be shared goes out once, for no set in particular
    keep = ~many | first
    place = np.where(many, LONE, place)[keep]
    h = h[keep]
    frag = ((h >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)
    key = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    ends = np.append(np.flatnonzero(frag[1:] != frag[:-1]) + 1, len(frag))  # ordered by hash, so by fragment
    ident = digest(names)
    rows = [(-1, ident, sizes.astype(np.uint32).tobytes(), known.astype(np.uint32).tobytes(), b"", names.tobytes())]
    start = 0
    for end in ends.tolist():
        used, owners = np.unique(place[start:end], return_inverse=True)
        lone = len(used) and used[-1] == LONE
        owners = np.where(lone & (owners == len(used) - 1), LONE, owners).astype(np.uint16)
        used = used[: len(used) - int(lone)]
        rows.append((int(frag[start]), ident, key[start:end].tobytes(), owners.tobytes(), used.astype(np.uint16).tobytes(), names[used].tobytes()))
        start = end
    return rows


def counted(group: pd.DataFrame) -> pd.DataFrame:
    """Per batch of one fragment: which places share shingles with another set, and how many."""
    if group["frag"].iloc[0] < 0:
        return group[["batch", "names", "keys", "owners"]].rename(columns={"keys": "sizes", "owners": "counts"}).assign(places=b"")
    key = np.concatenate([np.frombuffer(x, np.uint32) for x in group["keys"]])
    counts = [len(x) // 4 for x in group["keys"]]
    owners = [np.frombuffer(x, np.uint16) for x in group["owners"]]
    names = [np.frombuffer(x, np.int64) for x in group["names"]]
    # a set's number: its name's rank among all names here; 0 stands for several sets
    every = np.unique(np.concatenate(names))
    ranks = [np.append(np.searchsorted(every, x) + 1, 0) for x in names]
    owner = np.concatenate([r[np.minimum(o, len(r) - 1)] for r, o in zip(ranks, owners, strict=True)])
    order = np.lexsort((owner, key))
    k, o = key[order], owner[order]
    new_key = np.concatenate([[True], k[1:] != k[:-1]])
    fresh = np.concatenate([[True], (k[1:] != k[:-1]) | (o[1:] != o[:-1])])
    run = np.cumsum(new_key) - 1
    holders = np.bincount(run, weights=fresh) + np.bincount(run, weights=fresh & (o == 0))
    shared = np.zeros(len(key), bool)
    shared[order] = holders[run] >= 2
    out, start = [], 0
    for batch, n, own, place in zip(group["batch"], counts, owners, group["places"], strict=True):
        hit = own[shared[start : start + n]]
        start += n
        used, times = np.unique(hit[hit != LONE], return_counts=True)
        if len(used):
            out.append((batch, np.frombuffer(place, np.uint16)[used].tobytes(), times.astype(np.uint32).tobytes(), None, None))
    return pd.DataFrame(out, columns=["batch", "places", "counts", "names", "sizes"])


def summed(group: pd.DataFrame) -> pd.DataFrame:
    """The sets of one batch that share as much as a partner must, partial counts added up."""
    whole = group[group["names"].notna()].iloc[0]
    names, sizes, total = (np.frombuffer(whole[c], kind).astype(np.int64) for c, kind in (("names", np.int64), ("sizes", np.uint32), ("counts", np.uint32)))
    for places, counts in zip(group["places"], group["counts"], strict=True):
        if places:
            total[np.frombuffer(places, np.uint16)] += np.frombuffer(counts, np.uint32)
    # texts whose whole batch is repeated are counted once for each time
    keep = 100 * total >= PERCENT * sizes
    return pd.DataFrame({"sig": names[keep], "n": sizes[keep]})


def sharing_sets(docs: DataFrame, fragments: int) -> DataFrame:
    """``sig, n`` of the sets of which enough shingles occur in another set (never too few sets)."""
    small_batches(docs.sparkSession, BATCH)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in cut(batch, BATCH):
                yield pd.DataFrame(packed(part, fragments), columns=["frag", "batch", "keys", "owners", "places", "names"])

    rows = docs.select("text").mapInPandas(pack, PACKED)
    salt = F.when(F.col("frag") < 0, F.col("batch")).otherwise(0)
    counts = rows.groupBy("frag", salt.alias("salt")).applyInPandas(counted, "batch long, places binary, counts binary, names binary, sizes binary")
    return counts.groupBy("batch").applyInPandas(summed, "sig long, n long").distinct()


def kept_sets(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """``sig, n, hashes`` of the sets of ``chosen`` (``sig, n, rep``), one row each."""
    small_batches(docs.sparkSession, BATCH)
    ids = chosen.select(F.col("rep").alias("id"))
    texts = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "text").join(ids, "id", "left_semi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (part for whole in batches for part in cut(whole, BATCH)):
            sets = [shingles(text_bytes(t)) for t in batch["text"]]
            yield pd.DataFrame({"sig": [digest(s) for s in sets], "hashes": [s.tobytes() for s in sets]})

    found = texts.select("text").mapInPandas(run, "sig long, hashes binary")
    return found.join(chosen.select("sig", "n"), "sig").groupBy("sig", "n").agg(F.first("hashes").alias("hashes"))


def prefix_lists(sets: DataFrame) -> DataFrame:
    """``h, sig, n, typical``: the posting lists of the prefixes in the global order, lists of one left out."""

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = [len(x) // 8 for x in batch["hashes"]]
            yield pd.DataFrame({"h": np.concatenate([np.frombuffer(x, np.int64) for x in batch["hashes"]]), "sig": np.repeat(batch["sig"].to_numpy(), sizes)})

    postings = sets.select("sig", "hashes").mapInPandas(explode, "h long, sig long")
    often = checkpointed(postings.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1"))
    release(sets.sparkSession)
    order = F.array_sort(F.collect_list(F.struct("df", "h")))
    by_set = postings.join(often, "h").groupBy("sig").agg(order.alias("shared"), F.avg(F.log2("df")).alias("typical")).join(sets.select("sig", "n"), "sig")
    # shingles found in no other set come first in the global order
    length = F.col("n") - at_least(F.col("n")) + 1 - (F.col("n") - F.size("shared"))
    by_set = by_set.withColumn("typical", F.round(F.col("typical") * F.size("shared") / F.col("n"), 6))
    listed = by_set.filter(length > 0).select("sig", "n", "typical", F.explode(F.slice("shared", F.lit(1), length.cast("int"))).alias("x"))
    return listed.select(F.col("x.h").alias("h"), "sig", "n", "typical")


def close(a: Column, b: Column) -> Column:
    """Whether two sizes allow a link."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``u, v`` whose sets link."""

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for a, b in zip(batch["a"], batch["b"], strict=True):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= PERCENT * (len(x) + len(y) - common))
            yield batch.loc[np.array(keep, bool), ["u", "v"]]

    a = sets.select(F.col("sig").alias("u"), F.col("hashes").alias("a"))
    b = sets.select(F.col("sig").alias("v"), F.col("hashes").alias("b"))
    return pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInPandas(verify, "u long, v long")


def labelled(lists: DataFrame, links: DataFrame | None) -> DataFrame:
    """Lists that hold several components, with ``comp``."""
    if links is None:
        lists = lists.withColumn("comp", F.col("sig"))
    else:
        roots = components(links, written=True)
        lists = lists.join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("comp", F.coalesce("root", "sig")).drop("root")
    mixed = checkpointed(lists.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("h"))
    return checkpointed(lists.join(mixed, "h", "left_semi"))


def hub_links(lists: DataFrame, sets: DataFrame, turn: int) -> DataFrame:
    """Links between the members of each list and its most typical member; another one of the best in each turn."""
    by = F.struct(F.floor(F.col("typical") * (8 >> turn)).alias("t"), F.xxhash64("sig", F.lit(turn)).alias("x"), F.col("sig").alias("v"), F.col("n").alias("m"), F.col("comp").alias("c"))
    hubs = checkpointed(lists.groupBy("h").agg(F.max(by).alias("hub")))
    near = lists.join(hubs, "h").filter((F.col("comp") != F.col("hub.c")) & close(F.col("n"), F.col("hub.m")))
    return linked(near.select(F.col("sig").alias("u"), F.col("hub.v").alias("v")).distinct(), sets)


def block_edges(group: pd.DataFrame) -> pd.DataFrame:
    """Edges of a spanning forest between the sets of one block that link, components counting as joined."""
    sets = [np.frombuffer(x, np.uint64) for x in group["hashes"]]
    n, sig = group["n"].to_numpy(), group["sig"].to_numpy()
    comp = pd.factorize(group["comp"])[0]
    edges: list[tuple[int, int]] = []
    if len(sets) > 1 and comp.max() > 0:
        codes, times = np.unique(np.concatenate(sets), return_counts=True)
        order = np.argsort(times, kind="stable")
        order = order[times[order] > 1]  # the global order within the block
        place = np.full(len(codes), -1)
        place[order] = np.arange(len(order))
        at = [place[np.searchsorted(codes, s)] for s in sets]
        rows = np.repeat(np.arange(len(sets)), [len(a) for a in at])
        cols = np.concatenate(at)
        rows, cols = rows[cols >= 0], cols[cols >= 0]
        by = np.argsort(cols, kind="stable")
        rows, cols = rows[by], cols[by]
        overlap = np.zeros((len(sets), len(sets)), np.float32)
        for start in range(0, len(order), COLUMNS):
            a, b = np.searchsorted(cols, [start, start + COLUMNS])
            part = np.zeros((len(sets), COLUMNS), np.float32)
            part[rows[a:b], cols[a:b] - start] = 1
            overlap += part @ part.T
        size = n[:, None] + n[None, :]
        hit = (100 * overlap.astype(np.int64) >= PERCENT * (size - overlap.astype(np.int64))) & (comp[:, None] != comp[None, :])
        root = np.arange(comp.max() + 1)

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for i, j in zip(*np.nonzero(np.triu(hit)), strict=True):
            a, b = find(comp[i]), find(comp[j])
            if a != b:
                root[a] = b
                edges.append((int(sig[i]), int(sig[j])))
    return pd.DataFrame(edges, columns=["u", "v"], dtype="int64")


def island_links(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """All links that join components of lists which hold several, as edges of forests."""
    least = checkpointed(lists.groupBy("h").agg(F.min("sig").alias("u")))
    island = components(lists.join(least, "h").select("u", F.col("sig").alias("v")))
    members = checkpointed(lists.select("sig", "comp", "n").distinct().join(island.withColumnRenamed("node", "sig"), "sig").withColumnRenamed("root", "island"))
    sizes = members.groupBy("island", "comp").agg(F.count("*").alias("k")).groupBy("island").agg(F.max(F.struct("k", "comp")).alias("top"), F.sum("k").alias("all"))
    sizes = checkpointed(sizes.select("island", F.col("top.comp").alias("major"), F.col("top.k").alias("k"), "all"))
    # blocks 0..few-1 hold the sets outside the largest component, the blocks after them the largest component
    few, many = F.ceil((F.col("all") - F.col("k")) / BLOCK), F.ceil(F.col("k") / BLOCK)
    inside = F.col("comp") == F.col("major")
    placed = members.join(sizes, "island").withColumn("few", few.cast("int")).withColumn("many", many.cast("int"))
    placed = placed.withColumn("block", (F.when(inside, F.col("few") + F.pmod(F.xxhash64("sig"), F.col("many"))).otherwise(F.pmod(F.xxhash64("sig"), F.col("few")))).cast("int"))
    last = F.when(inside, F.col("few")).otherwise(F.col("few") + F.col("many"))
    other = placed.withColumn("other", F.explode(F.sequence(F.lit(0), last - 1)))
    task = other.select("island", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "sig", "comp", "n").join(sets.select("sig", "hashes"), "sig")
    return task.groupBy("island", "i", "j").applyInPandas(block_edges, "u long, v long")


def grouped_rows(docs: DataFrame, hub_rounds: int = HUB_ROUNDS) -> DataFrame:
    """``id, th, n, root, component`` of every row of ``docs`` (``doc_id, text``); groups share a root, ids may repeat."""
    spark = docs.sparkSession
    rows = checkpointed(set_rows(docs))
    reps = rows.filter("n > 0").groupBy("sig", "n").agg(F.min("id").alias("rep"))
    total = rows.agg(F.sum("n")).first()[0] or 0
    chosen = checkpointed(reps.join(sharing_sets(docs, max(1, -(-total // FRAGMENT))), ["sig", "n"]).select("sig", "n", "rep"))
    release(spark)
    sets = checkpointed(kept_sets(docs, chosen))
    release(spark)
    lists = checkpointed(prefix_lists(sets))
    release(spark)

    links = None
    mixed = labelled(lists, None)
    for turn in range(hub_rounds):
        new = checkpointed(hub_links(mixed, sets, turn))
        links = new if links is None else links.union(new)
        mixed = labelled(lists, links)
        release(spark)
    rest = checkpointed(island_links(mixed, sets))
    del mixed, lists, sets
    release(spark)
    roots = components(rest if links is None else links.union(rest), written=True)
    joined = reps.join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    least = checkpointed(joined.groupBy("root").agg(F.min("rep").alias("component")))
    names = joined.join(least, "root").select("sig", "root", "component")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component"))
    return rows.join(names, "sig", "left").select("id", "th", "n", "root", component.alias("component"))


def similar_groups(docs: DataFrame, hub_rounds: int = HUB_ROUNDS) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs`` (``doc_id, text``)."""
    out = grouped_rows(docs, hub_rounds)
    back = lambda c: F.when(c != NO_ID, c)
    return out.select(back(F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"), back(F.col("component")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` less all but one document of each group: of those with the smallest doc_id, one row.

    Documents without words are in no group and all stay.
    """
    rows = checkpointed(grouped_rows(docs.select("doc_id", "text")).filter("n > 0").groupBy("id", "th", "root").agg(F.count("*").alias("copies")))
    best = checkpointed(rows.groupBy("root").agg(F.min(F.struct("id", "th")).alias("best")))
    marked = rows.join(best, "root").withColumn("stays", (F.col("id") == F.col("best.id")) & (F.col("th") == F.col("best.th")))
    marked = checkpointed(marked.select("id", F.col("th").alias("of"), "stays", "copies"))
    del rows, best
    release(docs.sparkSession)
    keyed = docs.select(F.struct("*").alias("doc"), F.coalesce("doc_id", F.lit(NO_ID)).alias("key"), F.xxhash64("text").alias("th"))
    same = (F.col("key") == F.col("id")) & (F.col("th") == F.col("of"))
    gone = marked.filter("not stays or copies > 1").select("id", "of")
    out = keyed.join(gone, same, "left_anti")
    repeated = marked.filter("stays and copies > 1").select("id", "of")
    if not repeated.isEmpty():
        out = out.union(keyed.join(repeated, same, "left_semi").dropDuplicates(["key", "th"]))
    return out.select("doc.*")
