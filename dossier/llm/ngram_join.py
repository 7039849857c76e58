"""Jaccard join of documents on word shingles, by token-combination prefixes.

Two documents link when 100 * |intersection| >= 75 * |union| of their shingle sets. The join is exact:

1. An inverted index over every shingle finds how many sets hold it. Shingles travel packed, in buckets of the hash
   range; what is frequent within one part of the documents travels as a count, so a shingle held by a third of all documents is
   a few entries.
2. Every document gets a prefix in one global order: shingles of one set first (they can't match and only count), then
   rare ones by frequency, then frequent ones (FREQUENT sets and more). A document of n shingles that links to another misses at
   most n // 4 of its own. Rare shingles are indexed singly, frequent ones as pairs within small classes; the prefix
   extends until more than n // 4 shingles would have to be missed to lose every index entry. A class of k
   frequent shingles counts k - 1. The number of classes follows the size of the set, on levels that a partner shares.
3. Documents of an index entry are not paired all with all. They are compared with the one that has the smallest share of
   shingles of its own; what links is one component. The shingles of its own cap the sizes a document can link to: of its n it shares
   u at most, and links hold 7 * common >= 3 * (n + m), so m <= 7 * u / 3 - n; a pair outside either cap is never formed, and a
   document whose cap no other of the entry meets leaves it. In an entry of frequent shingles u counts the frequent ones alone:
   documents there with a rare one in common meet in its entry too. Before sets travel, maps of BITS places bound what a pair can
   have in common. Only entries whose documents are still in several components are looked at again, HUBS
   more documents of each entry at a time (twice as many after a round that finds no link), until none is left. So a group of thousands of near copies costs
   one comparison each, and no link between components is lost.

Each comparison counts the common shingles exactly (hashes of 46 bits and more within a pair). Equal sets are one node
from the start: identical texts are never compared.

A null text or one without words has no shingles, no links and its own id. Other rows that repeat a doc_id are one node: they share a
component. A row with a null doc_id has no links and component null. Other columns are not read.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from dossier.llm.base import give_back, map_batches, query, table, written
from dossier.llm.components import components, merged
from dossier.llm.shingles import mixed, shingle_sets

FREQUENT = 64
HUBS = 32
PART_TOKENS = 1 << 20
BUCKET_TOKENS = 1 << 19
CENTRAL = ["own", "n", "doc_id"]  # order in which the documents of an entry are compared with the others
BITS = 512
FIRST = 8
GROUP = 256  # documents compared with one hub in one task

INDEX, LOCAL, SIZES = 0, 1, 2
PACKED = "key bigint, part bigint, kind int, docs binary, counts binary, hashes binary, more binary"
PACKED_ARROW = pa.schema([("key", pa.int64()), ("part", pa.int64()), ("kind", pa.int32()), ("docs", pa.binary()),
                          ("counts", pa.binary()), ("hashes", pa.binary()), ("more", pa.binary())])


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and a 128-bit mark of the shingle set (null for an empty one)."""
    def work(batch):
        n, marks = [], []
        for s in shingle_sets(batch.column("text")):
            n.append(len(s))
            marks.append(xxhash.xxh128_digest(s.tobytes()) if len(s) else None)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(marks, pa.binary())],
                                          ["doc_id", "n_shingles", "mark"])

    return map_batches(docs.select("doc_id", "text"), work, "doc_id bigint, n_shingles bigint, mark binary")


def _pack5(h: np.ndarray) -> bytes:
    """The low 40 bits of hashes in 5 bytes each."""
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpack5(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.reshape(-1).view("<u8")


def _packed(docs: DataFrame, bits: int) -> DataFrame:
    """The shingles of parts of the documents, packed by bucket; with them the frequent ones and the sizes by part."""

    def rows(part: int, ids: list[int], sets: list[np.ndarray]):
        sizes = np.array([len(s) for s in sets], np.int64)
        yield -1 - part, part, SIZES, np.array(ids, np.int64).tobytes(), sizes.tobytes(), b"", b""
        flat, doc = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
        order = np.argsort(flat, kind="stable")
        flat, doc = flat[order], doc[order]
        edge = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
        count = np.diff(np.append(edge, len(flat)))
        heavy = np.repeat(count >= FREQUENT, count)
        often = count >= FREQUENT
        if heavy.any():
            yield -1 - part, part, LOCAL, doc[heavy].tobytes(), b"", flat[heavy].tobytes(), b""
        big, big_count = flat[edge[often]], count[often]
        flat, doc = flat[~heavy], doc[~heavy]
        buckets = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
        cut = np.append(np.searchsorted(flat, buckets), len(flat))
        big_cut = np.append(np.searchsorted(big, buckets), len(big))
        for b in range(1 << bits):
            mine, others = slice(cut[b], cut[b + 1]), slice(big_cut[b], big_cut[b + 1])
            if mine.start < mine.stop or others.start < others.stop:
                d, h = doc[mine], flat[mine]
                o = np.argsort(d, kind="stable")
                d, h = d[o], h[o]
                at = np.flatnonzero(np.append(True, d[1:] != d[:-1])) if len(d) else np.empty(0, np.int64)
                yield (b, part, INDEX, d[at].astype(np.int32).tobytes(), np.diff(np.append(at, len(d))).astype(np.uint16 if len(d) < 65536 else np.int32).tobytes(),
                       _pack5(h), struct.pack("<?", len(d) < 65536) + counted(big[others], big_count[others]))

    def counted(h, n):
        return _pack5(h) + n.astype("<i8").tobytes()

    def run(batches):
        task, chunk, ids, sets, held, seen = TaskContext.get().partitionId(), 0, [], [], 0, {}

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows(task << 24 | chunk, ids, sets), strict=True), PACKED_ARROW, strict=True)],
                schema=PACKED_ARROW)

        for batch in batches:
            for doc_id, s in zip(batch.column("doc_id").to_pylist(), shingle_sets(batch.column("text")), strict=True):
                if doc_id is None or len(s) < 3:
                    continue  # sets of one or two shingles link with equal ones only
                at = seen.setdefault(xxhash.xxh128_digest(s.tobytes()), len(ids))
                if at < len(ids):  # an equal set: the smallest doc_id stands for it
                    ids[at] = min(ids[at], doc_id)
                    continue
                ids.append(doc_id)
                sets.append(s)
                held += len(s)
                if held >= PART_TOKENS:
                    yield flush()
                    chunk, ids, sets, held, seen = chunk + 1, [], [], 0, {}
        if sets:
            yield flush()
        del sets, ids, seen
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, PACKED)


def _shared(packed: DataFrame) -> DataFrame:
    """By bucket: which entries are held by several sets, sent back to their parts; the rest passes through."""

    def work(key, group):
        if group.column("kind")[0].as_py() != INDEX:
            return group
        parts, where, hashes, weights, owners = group.column("part").to_numpy(), [], [], [], []
        for i in range(group.num_rows):
            docs = np.frombuffer(group.column("docs")[i].as_py(), np.int32)
            more = group.column("more")[i].as_py()
            counts = np.frombuffer(group.column("counts")[i].as_py(), np.uint16 if more[:1] == b"\x01" else np.int32)
            h = _unpack5(group.column("hashes")[i].as_py())
            n = (len(more) - 1) // 13
            hashes += [h, _unpack5(more[1:1 + 5 * n])]
            weights += [np.ones(len(h), np.int64), np.frombuffer(more[1 + 5 * n:], "<i8")]
            where += [np.repeat(docs, counts), np.full(n, -1, np.int32)]
            owners += [np.full(len(h) + n, i, np.int32)]
        h, w = np.concatenate(hashes), np.concatenate(weights)
        doc, owner = np.concatenate(where), np.concatenate(owners)
        order = np.argsort(h, kind="stable")
        h, w, doc, owner = h[order], w[order], doc[order], owner[order]
        edge = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        held = np.repeat(np.add.reduceat(w, edge), np.diff(np.append(edge, len(h))))
        keep = (held >= 2) & (doc >= 0)
        h, doc, owner, held = h[keep], doc[keep], owner[keep], np.minimum(held[keep], FREQUENT).astype(np.uint8)
        order = np.argsort(owner, kind="stable")
        h, doc, owner, held = h[order], doc[order], owner[order], held[order]
        out = []
        for i in np.unique(owner).tolist():
            a, b = np.searchsorted(owner, [i, i + 1])
            o = np.argsort(doc[a:b], kind="stable")
            out.append((key[0].as_py(), int(parts[i]), INDEX, doc[a:b][o].tobytes(), held[a:b][o].tobytes(), _pack5(h[a:b][o]), b""))
        columns = zip(*out, strict=True) if out else [[] for _ in PACKED_ARROW]
        del h, doc, owner, held
        give_back()
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, PACKED_ARROW, strict=True)], schema=PACKED_ARROW)

    return packed.groupBy("key").applyInArrow(work, PACKED)


def level_of(n: int) -> int:
    return n.bit_length() - 1


def entries(n: int, rare: np.ndarray, held: np.ndarray, frequent: np.ndarray, single: int) -> list[np.ndarray]:
    """Index entries of one set: n its size, `single` its shingles that no other set holds. Empty: it can't link.

    First the entries of rare shingles, then those of pairs of frequent ones. A set that has the second kind has all its rare
    shingles among the first: two such sets meet there if they have a rare one in common.
    """
    need = n // 4 + 1 - single
    if need <= 0:
        return []
    order = np.lexsort((rare, held))
    chosen = mixed(rare[order][:need])
    need -= len(chosen)
    out = [chosen]
    if need <= 0:
        return out
    frequent = np.sort(mixed(frequent ^ np.uint64(0x5BD1E995)))
    for level in {level_of(n), level_of(-(-3 * n // 4))}:
        classes = 1 << max(0, level - 1)  # at most half as many as shingles, so what is not missed fills some class twice
        of = (frequent >> np.uint64(17)) % np.uint64(classes)
        fresh = np.zeros(len(of), np.int64)
        fresh[np.unique(of, return_index=True)[1]] = 1
        covered = np.arange(1, len(of) + 1) - np.cumsum(fresh)
        stop = int(np.searchsorted(covered, need)) + 1
        by_class = np.argsort(of[:stop], kind="stable")
        f, of = frequent[:stop][by_class], of[:stop][by_class]
        for step in range(1, len(f)):
            same = of[step:] == of[:-step]
            if not same.any():
                break
            pair = mixed(f[:-step][same] * np.uint64(3) + mixed(f[step:][same]) + np.uint64(level))
            out.append(pair)
    return out


INDEXED = "doc_id bigint, n bigint, n_often bigint, entries array<bigint>, often array<bigint>, shared binary, bits array<bigint>"


def bits_of(shared: np.ndarray) -> np.ndarray:
    """A map of BITS places with those of an odd number of the hashes set. Where two maps differ, a hash is in one set only."""
    places = np.bincount((shared % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(places.astype(np.uint8)).view(np.int64)


def _indexed(shared: DataFrame, bits: int) -> DataFrame:
    """By part: the documents that can link, with their index entries and the shingles that other sets hold too."""

    def keys(kind: int, bucket: int, data: bytes) -> np.ndarray:
        """Hashes with the bits of their bucket above the 40 that travel."""
        if kind == INDEX:
            return _unpack5(data) | np.uint64(bucket << 40)
        whole = np.frombuffer(data, np.uint64)
        return (whole & np.uint64((1 << 40) - 1)) | (whole >> np.uint64(64 - bits) << np.uint64(40))

    def work(group):
        ids = sizes = None
        docs, hashes, held = [], [], []
        for key, kind, d, c, h in zip(*(group.column(x).to_pylist() for x in ("key", "kind", "docs", "counts", "hashes")), strict=True):
            if kind == SIZES:
                ids, sizes = np.frombuffer(d, np.int64), np.frombuffer(c, np.int64)
            else:
                docs.append(np.frombuffer(d, np.int32))
                hashes.append(keys(kind, key, h))
                held.append(np.frombuffer(c, np.uint8) if kind == INDEX else np.full(len(h) // 8, FREQUENT, np.uint8))
        out_id, out_n, out_f, out_entries, out_often, out_shared, out_bits = [], [], [], [], [], [], []
        if docs:
            doc, h, c = np.concatenate(docs), np.concatenate(hashes), np.concatenate(held)
            order = np.argsort(doc, kind="stable")
            doc, h, c = doc[order], h[order], c[order]
            begins = np.searchsorted(doc, np.arange(len(ids) + 1))
            for i in np.flatnonzero(sizes - np.diff(begins) < sizes // 4 + 1).tolist():
                a, b = begins[i], begins[i + 1]
                mine, often = h[a:b], c[a:b]
                rare = often < FREQUENT
                found = entries(int(sizes[i]), mine[rare], often[rare], mine[~rare], int(sizes[i]) - (b - a))
                if sum(map(len, found)):
                    out_id.append(int(ids[i]))
                    out_n.append(int(sizes[i]))
                    out_f.append(int((~rare).sum()))
                    out_entries.append(found[0].view(np.int64))
                    out_often.append(np.unique(np.concatenate([np.empty(0, np.uint64), *found[1:]])).view(np.int64))
                    out_shared.append(np.sort(mine).tobytes())
                    out_bits.append(bits_of(mine))
        lists = pa.list_(pa.int64())
        return pa.table([pa.array(out_id, pa.int64()), pa.array(out_n, pa.int64()), pa.array(out_f, pa.int64()), pa.array(out_entries, lists),
                         pa.array(out_often, lists), pa.array(out_shared, pa.binary()), pa.array(out_bits, lists)],
                        names=["doc_id", "n", "n_often", "entries", "often", "shared", "bits"])

    return shared.groupBy("part").applyInArrow(work, INDEXED)


def _possible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, hub) that may link: at most half of what is not in one map only is common. No set travels for the others."""
    light = sets.select("doc_id", "n", F.expr("length(shared) div 8").alias("u"), "bits")
    side = lambda name: light.select(F.col("doc_id").alias(name), F.struct("n", "u", "bits").alias(f"_{name}"))
    apart = F.aggregate(F.zip_with("_a.bits", "_hub.bits", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    common = F.expr("_a.u + _hub.u") - apart  # twice as many
    return pairs.join(side("a"), "a").join(side("hub"), "hub").where(7 * common >= F.expr("6 * (_a.n + _hub.n)")).select("a", "hub")


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (a, hub) that link. The sets of the documents go to their hub, at most about GROUP of them to a task."""
    pairs = written(_possible(pairs, sets), "possible-pairs")
    sizes = pairs.groupBy("hub").agg(F.count("*").alias("k"))
    dealt = pairs.join(sizes, "hub").select(
        "a", "hub", F.pmod(F.xxhash64("a"), F.ceil(F.col("k") / GROUP)).cast("int").alias("block"))
    dealt = written(dealt, "dealt-pairs")
    held = sets.select("doc_id", "n", "shared")
    members = dealt.join(held, dealt["a"] == held["doc_id"]).select("hub", "block", "doc_id", "n", "shared", F.lit(False).alias("centre"))
    hubs = dealt.select("hub", "block").distinct()
    centres = hubs.join(held, hubs["hub"] == held["doc_id"]).select("hub", "block", "doc_id", "n", "shared", F.lit(True).alias("centre"))

    def work(group):
        rows = list(zip(group.column("doc_id").to_pylist(), group.column("n").to_pylist(), group.column("shared"),
                        group.column("centre").to_pylist(), strict=True))
        found = []
        for hub, m, theirs, centre in rows:
            if centre:
                theirs = np.frombuffer(theirs.as_py(), np.uint64)
                for doc, n, mine, own in rows:
                    if not own:
                        mine = np.frombuffer(mine.as_py(), np.uint64)
                        at = np.searchsorted(theirs, mine)
                        common = int((theirs[np.minimum(at, len(theirs) - 1)] == mine).sum()) if len(theirs) else 0
                        if 100 * common >= 75 * (n + m - common):
                            found.append((doc, hub))
        a, b = zip(*set(found), strict=True) if found else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return members.unionByName(centres).groupBy("hub", "block").applyInArrow(work, "a bigint, b bigint")


def link_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of doc_id, text."""
    spark = docs.sparkSession
    marks = written(signatures(docs), "marks")
    named = marks.where("doc_id is not null and mark is not null")
    classes = named.groupBy("mark").agg(F.min("doc_id").alias("rep"))
    # A doc_id that stands for several sets ties their classes together.
    repeated = named.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id")
    ids = named.join(repeated, "doc_id", "left_semi").join(classes, "mark").select("doc_id", "rep")
    several = ids.groupBy("doc_id").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least < most")
    ties = ids.join(several, "doc_id").select(F.col("rep").alias("a"), F.col("least").alias("b")).where("a <> b")

    total = named.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).head()[0]
    bits = max(6, int(total // BUCKET_TOKENS).bit_length())
    sets = written(_indexed(_shared(_packed(docs, bits)), bits), "indexed")

    # What two documents can have in common: all shingles that are not single ones. Of two that meet in an entry of frequent
    # ones, though, and not in one of a rare one, only the frequent ones.
    kinds = [sets.select("doc_id", F.posexplode(F.array_sort(column)).alias("place", "entry")).select(
        "doc_id", F.expr(f"shiftleft(entry, 1) | {kind}L").alias("entry"), "place") for kind, column in enumerate(("entries", "often"))]
    everything = kinds[0].unionByName(kinds[1])
    facts = sets.select("doc_id", F.col("n").cast("int").alias("n"), F.expr("length(shared) div 8").alias("u"), "n_often")
    postings = _described(everything.where(F.col("place") < FIRST).drop("place"), facts)
    # The first comparisons go by the FIRST smallest entries of each kind, which like sets have in common; the rounds below see all.
    hubs = (postings.groupBy("entry").agg(F.min(F.struct(*CENTRAL, "cap")).alias("h"), F.count("*").alias("k")).where("k > 1")
            .select("entry", F.col("h.doc_id").alias("hub"), F.col("h.n").alias("hub_n"), F.col("h.cap").alias("hub_cap")))
    star = (postings.join(hubs, "entry").where("doc_id <> hub and n <= hub_cap and hub_n <= cap")
            .groupBy(F.col("doc_id").alias("a"), "hub").agg(F.count("*").alias("k")))
    star = written(star.join(classes.select("rep"), F.col("a") == F.col("rep"), "left_semi"), "star")
    best = star.groupBy("a").agg(F.max_by("hub", F.struct("k", -F.col("hub"))).alias("hub"))
    links = written(_linked(best, sets).unionByName(ties), "links")
    tried = best.select("a", "hub")
    found = components(links)

    rest = (star.select("a", "hub").join(tried, ["a", "hub"], "left_anti"))
    rest = written(_between(rest, found), "rest")
    if not rest.isEmpty():
        found = merged(found, written(_linked(rest, sets), "links"))
    tried = written(star.select("a", "hub"), "tried")

    # Only an entry and its document travel until it is known which entries hold several components.
    chosen = everything.drop("place").join(classes.select("rep"), F.col("doc_id") == F.col("rep"), "left_semi")
    open_entries = written(_described(_mixed(chosen, found), facts), "mixed-entries")
    width = HUBS
    while True:
        open_entries = written(_unsettled(open_entries.select("entry", "doc_id", "n", "cap", "own"), found), "open-entries")
        if open_entries.isEmpty():
            break
        first = Window.partitionBy("entry").orderBy(*CENTRAL)
        ranked = open_entries.withColumn("place", F.row_number().over(first)).where(F.col("place") <= width)
        chosen = written(ranked.select("entry", F.col("doc_id").alias("hub"), F.col("n").alias("hub_n"), F.col("cap").alias("hub_cap"),
                                       F.col("own").alias("hub_own"), F.col("component").alias("hub_component")), "hubs")
        later = F.struct("own", "n", "doc_id") > F.struct("hub_own", "hub_n", "hub")
        pairs = (open_entries.join(chosen, "entry")
                 .where(F.expr("component <> hub_component and n <= hub_cap and hub_n <= cap") & later)
                 .select(F.col("doc_id").alias("a"), "hub").distinct().join(tried, ["a", "hub"], "left_anti"))
        pairs = written(pairs, "pairs")
        links = written(_linked(pairs, sets), "links")
        tried = tried.unionByName(pairs)
        if links.isEmpty():
            width *= 2
        else:
            found = merged(found, links)
        open_entries = open_entries.join(chosen.select("entry", F.col("hub").alias("doc_id")), ["entry", "doc_id"], "left_anti")

    label = classes.join(found, classes["rep"] == found["node"], "left").select("mark", F.coalesce("component", "rep").alias("c"))
    none = marks.where("mark is null").withColumn("c", F.lit(None).cast("bigint"))  # one key otherwise
    labelled = marks.where("mark is not null").join(label, "mark", "left").select(*marks.columns, "c").unionByName(none)
    return labelled.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id")).alias("component_id"))


def _labelled(rows: DataFrame, column: str, found: DataFrame, name: str) -> DataFrame:
    nodes = found.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
    return (rows.join(nodes, F.col(column) == F.col("_node"), "left")
            .withColumn(name, F.coalesce("_component", F.col(column))).drop("_node", "_component"))


def _between(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components."""
    both = _labelled(_labelled(pairs, "a", found, "ca"), "hub", found, "ch")
    return both.where("ca <> ch").select("a", "hub")


def _described(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Postings (entry, doc_id) with n, cap and own share of their document; those that can't link to anything are left out.
    The lowest bit of an entry says that it is one of frequent shingles."""
    u = F.expr("if(entry % 2 = 0, u, n_often)")
    return (rows.join(facts, "doc_id").withColumn("_u", u).where("7 * _u div 3 - n >= 3 * n / 4")
            .select("doc_id", "n", F.expr("int(7 * _u div 3 - n)").alias("cap"), F.expr("int(4096 * (n - _u) div n)").alias("own"), "entry"))


def _mixed(postings: DataFrame, found: DataFrame) -> DataFrame:
    """The postings of those entries that hold several components."""
    ends = (_labelled(postings, "doc_id", found, "component").groupBy("entry")
            .agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi"))
    return postings.join(ends.select("entry"), "entry", "left_semi")


def _unsettled(postings: DataFrame, found: DataFrame) -> DataFrame:
    """The documents of those entries that hold several components, as far as one of another component is within their cap
    and they may be within its cap: the least n and the greatest cap of the other components decide."""
    rows = _labelled(postings, "doc_id", found, "component")
    per = rows.groupBy("entry", "component").agg(F.min("n").alias("n"), F.max("cap").alias("cap"))

    def two(column: str, order) -> DataFrame:
        """The best value of an entry, its component, and the best one of the other components."""
        place = F.row_number().over(Window.partitionBy("entry").orderBy(order, "component"))
        at = lambda n, c: F.max(F.when(F.col("_p") == n, F.col(c)))
        return (per.select("entry", "component", column, place.alias("_p")).where("_p <= 2").groupBy("entry")
                .agg(at(1, column).alias(f"{column}1"), at(1, "component").alias(f"{column}_of"), at(2, column).alias(f"{column}2")))

    sides = two("n", F.asc("n")).join(two("cap", F.desc("cap")), "entry").where("n2 is not null")
    return (rows.join(sides, "entry")
            .where("cap >= if(component = n_of, n2, n1) and n <= if(component = cap_of, cap2, cap1)")
            .select("entry", "doc_id", "n", "cap", "own", "component"))


@query("op1_ngram_join", """
WITH RECURSIVE w AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS ws
  FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5
    THEN [array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)] WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')]
    ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
r AS (SELECT doc_id, doc_id AS x FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.x)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce((SELECT min(x) FROM r WHERE r.doc_id = w.doc_id), w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id)""")
def op1_ngram_join(spark, sf_dir):
    return link_components(table(spark, sf_dir, "documents"))
