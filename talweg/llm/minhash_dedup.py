"""Near-duplicate groups by SuperMinHash, banding, verification and union-find.

SuperMinHash gives each shingle a random permutation of the signature's places, drawn
step by step; step j offers j plus a random fraction to the j-th place, and a document is
done as soon as all its places are below the next step. All documents of a piece take
their steps together on numpy arrays.

Documents with equal shingle sets are one class, and only classes go on. Band keys put
classes into buckets. Round one compares each class with the class of least id in its
buckets that shares most of them; linked classes become components. Round two compares
what may still be missing: pairs that share a bucket and differ in component, so that one
of them at least is outside the bucket's largest component. In a cloud of copies that
drift away from one text such pairs are many, but few are alike enough: two sets that
reach the share have in common one of the rarest shingles of both, at a place that their
sizes bound. Only pairs that meet under such a shingle are compared. Every comparison is
made on the full sets, and every pair that shares a bucket is compared, connected, or
known to be too different.

With bands of ``rows`` places, a pair of similarity s shares no bucket with probability
(1 - s**rows)**bands; the defaults leave 8e-6 at 0.85 and 3.6e-4 at 0.8.

Defined cases: null texts and texts without words have an empty set, are linked with
nothing and kept; fewer words than a shingle make one shingle; rows that share a doc_id
are one document, so that what any of their sets is linked with is one group; a row without doc_id is linked with nothing, kept, and has no component;
an empty table gives no rows; other columns pass through, whatever their names; a very long
text is one piece of its task, and its set is signed in parts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talweg.functions.ordering import numbered
from talweg.llm._shared import BitFilter, cut, drop_cut, free_name, picker
from talweg.llm._text import SPACE, U, Chunk, chunks, lists, longs, mix, run_hashes
from talweg.llm.components import components

PLACES, BANDS = 100, 20
LEVELS = (4, 16, 64, 256, 1024, 4096, 16384)  # counts that tell common shingles from rare ones
_MARK = 0x2545F4914F6CDD1D
_GOLD, _STEP = 0x9E3779B97F4A7C15, 40  # a step's values lie in [j, j + 1) * 2**_STEP


def _draw(h: np.ndarray, j: int) -> np.ndarray:
    return mix(h + U((j + 1) * _GOLD % (1 << 64)))


def signatures(h: np.ndarray, doc: np.ndarray, docs: int, places: int = PLACES, most: int = 1 << 19) -> np.ndarray:
    """SuperMinHash signatures of ``docs`` sets; h: the sets' distinct hashes, doc: whose they are, in order. Sets without elements keep the largest value everywhere.

    Every element's permutation is its own, so a signature is the least of those of parts
    of a set: ``most`` elements at a time bound the memory, however large a set is.
    """
    out = np.full((docs, places), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(h), most):
        part = doc[a : a + most]
        first, last = int(part[0]), int(part[-1]) + 1
        out[first:last] = np.minimum(out[first:last], _signatures(h[a : a + most], part - first, last - first, places))
    return out


def _signatures(h: np.ndarray, doc: np.ndarray, docs: int, places: int) -> np.ndarray:
    sig = np.full(docs * places, np.iinfo(np.uint64).max, np.uint64)
    perm = swapped = None
    for j in range(places):
        r = _draw(h, j)
        k = (j + (r >> U(_STEP)) % U(places - j)).astype(np.int64)
        value = (r & U((1 << _STEP) - 1)) + U(j << _STEP)
        if j == 0:
            place = swapped = k
        else:
            if perm is None:  # places as step 0 left them
                perm = np.tile(np.arange(places, dtype=np.uint8 if places <= 256 else np.uint16), (len(h), 1))
                line = np.arange(len(h))
                perm[:, 0], perm[line, swapped] = swapped, 0
            line = np.arange(len(h))
            place = perm[line, k].astype(np.int64)
            perm[line, k] = perm[:, j]
        np.minimum.at(sig, doc * places + place, value)
        open_docs = sig.reshape(docs, places).max(1) >= U(j + 1 << _STEP)
        live = open_docs[doc]
        if not live.any():
            break
        if not live.all():
            h, doc, swapped = h[live], doc[live], swapped[live]
            perm = perm[live] if perm is not None else None
    return sig.reshape(docs, places)


def shingle_sets(c: Chunk, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of the chunk's documents, end to end, and how many each has."""
    at, h = c.windows(k)
    n = c.n_words
    first = np.searchsorted(at, c.wptr)
    short = {d: run_hashes(c.word_hash[c.wptr[d] : c.wptr[d + 1]], int(n[d])) for d in np.flatnonzero((n > 0) & (n < k)).tolist()}
    sets = [short[d] if d in short else np.unique(h[first[d] : first[d + 1]]) for d in range(c.n)]
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.array([len(s) for s in sets], np.int64)


def digests(h: np.ndarray, n: np.ndarray) -> list[pa.Array]:
    """Two longs that stand for each set; h, n as shingle_sets gives them."""
    off, out = np.append(0, np.cumsum(n)), []
    for salt in (1, 2):
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(_draw(h, salt << 20), out=total[1:])
        out.append(longs(mix(total[off[1:]] - total[off[:-1]] + n.astype(np.uint64))))
    return out


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """One key for each document and band."""
    rows = sig.shape[1] // bands
    keys = np.zeros((len(sig), bands), np.uint64)
    for b in range(bands):
        for r in range(rows):
            keys[:, b] = mix(keys[:, b] * U(0x5851F42D4C957F2D) + sig[:, b * rows + r] + U(b + 1))
    return keys


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def sketches(docs: DataFrame, shingle: int, places: int = PLACES, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, d1, d2 (digest of the set) and keys of every document."""
    names = ["doc_id", "n_shingles", "d1", "d2", "keys"]

    def sketch(batches):
        for c, rows in chunks(batches, SPACE, lower=True):
            h, n = shingle_sets(c, shingle)
            doc = np.repeat(np.arange(c.n), n)
            sums = digests(h, n)
            keys = band_keys(signatures(h, doc, c.n, places), bands)
            yield pa.RecordBatch.from_arrays([rows.column(0), longs(n), *sums, lists(keys.ravel(), np.full(c.n, bands))], names)

    return _source(docs).mapInArrow(sketch, "doc_id long, n_shingles long, d1 long, d2 long, keys array<long>")


def _sets_of(docs: DataFrame, wanted: BitFilter, shingle: int, classes: DataFrame | None = None) -> DataFrame:
    """(id, shingles) of the documents in the filter, and of a few others. With classes (d1, d2, owner, rep): of these, by rep."""
    names = ["id", "shingles"] + (["d1", "d2"] if classes is not None else [])
    types = {"id": "long", "shingles": "array<long>", "d1": "long", "d2": "long"}
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def sets(batches):
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            keep = sent.value.might_contain(ids.astype(np.int64).view(np.uint64))
            for c, rows in chunks([batch.filter(pa.array(keep))], SPACE, lower=True):
                h, n = shingle_sets(c, shingle)
                yield pa.RecordBatch.from_arrays([rows.column(0), lists(h, n), *(digests(h, n) if len(names) > 2 else [])], names)

    found = _source(docs).where("doc_id is not null").mapInArrow(sets, ", ".join(f"{x} {types[x]}" for x in names))
    if classes is None:
        return found
    return found.withColumnRenamed("id", "owner").join(classes, ["d1", "d2", "owner"]).groupBy(F.col("rep").alias("id")).agg(F.min("shingles").alias("shingles"))


def _same_id(usable: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (u, v) from the least class that a doc_id is in to its others."""
    held = cut(usable.join(classes.select("d1", "d2", "rep"), ["d1", "d2"]).select("doc_id", F.col("rep").alias("v")).distinct())
    least = held.groupBy("doc_id").agg(F.min("v").alias("u"), F.max("v").alias("last")).where("u < last").select("doc_id", "u")
    return held.join(least, "doc_id").where("u <> v").select("u", "v").distinct()


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of distinct pairs (u, v) of ids, those with 100 * intersection >= percent * union. Nothing follows the joins, so that Spark can split a pivot of very many pairs."""
    one = sets.select(F.col("id").alias("u"), F.col("shingles").alias("su"))
    two = sets.select(F.col("id").alias("v"), F.col("shingles").alias("sv"))
    both = F.size(F.array_intersect("su", "sv"))
    either = F.size("su") + F.size("sv") - both
    return pairs.join(two, "v").join(one, "u").where(100 * both >= percent * either).select("u", "v")


def _rarity(members: DataFrame) -> BitFilter:
    """Tells how common a shingle is among the members, as the number of LEVELS that its count reaches. A level too many now and then does no harm: all see the same one."""
    counts = members.select(F.explode("shingles").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEVELS[0])
    # a level's mark changes the hash; the products are taken here as longs do not overflow in SQL
    marks = F.array(*(F.lit(int(np.uint64(k * _MARK % (1 << 64)).view(np.int64))) for k in range(1, len(LEVELS) + 1)))
    reached = F.array_compact(F.array(*(F.when(F.col("n") >= n, F.lit(k + 1)) for k, n in enumerate(LEVELS))))
    steps = cut(counts.select("h", F.explode(reached).alias("level")).select(F.col("h").bitwiseXOR(F.element_at(marks, F.col("level"))).alias("h")))
    made = BitFilter.build(steps, "h", steps.count(), bits_per_entry=16)
    drop_cut(steps)
    return made


def _meeting(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of members (id, shingles, component, outside) of different components, one of them outside, that can reach the share.

    All sets are put into one order, rare shingles first. If a and b have at least
    o = percent / (100 + percent) * (|a| + |b|) shingles in common, the first of those is
    among the first |a| - o + 1 of a and |b| - o + 1 of b. A shingle's place in a set
    bounds the size of the partner, so rows meet by shingle and band of sizes.
    """
    rarity = members.sparkSession.sparkContext.broadcast(_rarity(members))
    band = lambda n: np.floor(np.log(n) / np.log(1.03) + 1e-9).astype(np.int64)
    names = ["h", "band", "id", "place", "size", "component", "probe"]

    def places(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                out = []
                for i, raw, comp, outside in zip(part.column(0).to_pylist(), part.column(1), part.column(2).to_pylist(), part.column(3).to_pylist()):
                    h = raw.values.to_numpy(zero_copy_only=False).view(np.uint64)
                    n, level, live = len(h), np.zeros(len(h), np.int64), np.arange(len(h))
                    for step in range(1, len(LEVELS) + 1):
                        live = live[rarity.value.might_contain(h[live] ^ U(step * _MARK % (1 << 64)))]
                        level[live] = step
                    first = n - -(-percent * n // 100) + 1
                    h = h[np.lexsort((h, level))[:first]]
                    at = np.arange(1, first + 1)
                    one = np.ones(first, np.int64)
                    out.append((h.view(np.int64), band(n) * one, i * one, at, n * one, comp * one, 0 * one))
                    if outside:
                        low = band(-(-percent * n // 100)) * one
                        high = band(np.maximum(1, np.minimum((n - at + 1) * (100 + percent) // percent - n, 100 * n // percent)))
                        width = np.maximum(0, high - low + 1)
                        row = np.repeat(np.arange(first), width)
                        step = np.arange(len(row)) - np.repeat(np.cumsum(width) - width, width)
                        out.append(tuple(x[row] for x in (h.view(np.int64), low, i * one, at, n * one, comp * one, one)))
                        out[-1][1][:] += step
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[c] for o in out])) for c in range(7)], names)

    rows = cut(members.select("id", "shingles", "component", "outside").mapInArrow(places, ", ".join(f"{x} long" for x in names)))
    probe = rows.where("probe = 1").select("h", "band", F.col("id").alias("x"), F.col("place").alias("px"), F.col("size").alias("nx"), F.col("component").alias("cx"))
    entry = rows.where("probe = 0").select("h", "band", F.col("id").alias("y"), F.col("place").alias("py"), F.col("size").alias("ny"), F.col("component").alias("cy"))
    both = F.ceil((F.col("nx") + F.col("ny")) * percent / F.lit(100 + percent) - 1e-9)
    fits = (F.col("px") <= F.col("nx") - both + 1) & (F.col("py") <= F.col("ny") - both + 1)
    met = probe.join(entry, (probe.h == entry.h) & (probe.band == entry.band) & (F.col("cx") != F.col("cy")) & fits)
    return met.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, places: int = PLACES, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document row."""
    sk = cut(sketches(docs, shingle, places, bands))
    usable = sk.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    # one row for each class of equal sets
    classes = usable.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"))
    repeats = _repeats(sk)
    if repeats:
        # classes may have their least id in common: numbers in its order stand for them until the end
        classes = cut(numbered(classes.withColumnRenamed("rep", "owner"), "rep", "owner", "d1", "d2"))
    entries = classes.select("rep", "n", F.explode("keys").alias("key"))
    shared = entries.groupBy("key").agg(F.min("rep").alias("pivot"), F.count(F.lit(1)).alias("c")).where("c > 1")
    buckets = cut(entries.join(shared, "key").select("key", "rep", "n", "pivot"))

    need = buckets.select("rep").distinct()
    if repeats:
        need = cut(classes.select("d1", "d2", "owner", "rep").join(need, "rep"))
    wanted = BitFilter.build(need, "owner" if repeats else "rep", need.count())
    sets = cut(_sets_of(docs, wanted, shingle, need if repeats else None))

    # round one: the pivot that shares most of a class's buckets
    first = buckets.where("rep <> pivot").groupBy("rep", "pivot").agg(F.count(F.lit(1)).alias("c")).groupBy("rep").agg(F.max_by("pivot", F.struct("c", -F.col("pivot"))).alias("pivot"))
    tested = cut(first.select(F.col("pivot").alias("u"), F.col("rep").alias("v")))
    links = _linked(tested, sets, percent)
    links = cut(links.unionByName(_same_id(usable, classes)) if repeats else links)
    comp = cut(components(links))

    # round two: across components, from those outside a bucket's largest one
    tagged = buckets.select("key", "rep").join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    sizes = tagged.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
    mixed = sizes.groupBy("key").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.count(F.lit(1)).alias("k")).where("k > 1").select("key", "main")
    members = tagged.join(mixed, "key").groupBy("rep").agg(F.first("component").alias("component"), F.max(F.col("component") != F.col("main")).alias("outside"))
    members = cut(sets.join(members.withColumnRenamed("rep", "id"), "id"))
    more = cut(_meeting(members, percent).join(tested, ["u", "v"], "left_anti"))
    late = cut(_linked(more, sets, percent))
    if not late.isEmpty():
        comp = components(links.select("u", "v").union(late.select("u", "v")))

    named = classes.select("d1", "d2", "rep").join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", F.coalesce("component", "rep").alias("component_id"))
    if repeats:
        named = named.join(classes.select(F.col("rep").alias("component_id"), "owner"), "component_id").select("d1", "d2", F.col("owner").alias("component_id"))
    alone = ~((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    grouped = usable.select("doc_id", "n_shingles", "d1", "d2").join(named, ["d1", "d2"]).select("doc_id", "n_shingles", "component_id")
    out = grouped.unionByName(sk.where(alone).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    drop_cut(sets)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _repeats(sk: DataFrame) -> bool:
    """Whether a doc_id stands on several rows."""
    return not sk.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("doc_id is not null and c > 1").isEmpty()


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each near-duplicate group, that of the least doc_id; only rows that may go are joined, the others stay where they are."""
    gone = cut(near_duplicates(docs.select("doc_id", "text"), shingle, percent).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct())
    key = free_name("_doc_key", docs.columns)
    rows = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.lit(0)))
    pick = picker(gone, "_gone")
    stay, some = (rows.mapInArrow(pick(x), rows.schema).select(*docs.columns) for x in (False, True))
    alone = some.where("doc_id is null")
    some = some.where("doc_id is not null")
    return stay.unionByName(alone).unionByName(some.join(gone, some["doc_id"].cast("long") == gone["_gone"], "left_anti"))
