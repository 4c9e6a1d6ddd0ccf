"""Operator 3, n-gram Jaccard join: which documents share three quarters of their five-word shingles.

Exact: prefix filtering over shingles ordered rare first, with length, positional and suffix filters, and every
candidate pair verified once on the full sets.

1. `survey`: one pass over the texts. Per document the number of its shingles and a 128-bit digest of their set, by
   which documents of equal sets fall into one class; the first of each class stands for it from then on. In the same
   pass all shingles are counted over the corpus: they travel as packed numbers, one block per batch of documents and
   slice of the hash space, not as rows, and what returns is the number of each document's shingles that occur
   elsewhere. A document linked with any other shares three quarters of its set, so most documents end here.
2. `postings`: the remaining sets are counted exactly, which gives the rare-first order; shingles of one document
   only come first and need no posting, so a document's prefix is mostly spent on them.
3. Links are found in rounds. Within a shingle's postings every document is compared with one centre, the document
   with the least share of shingles of its own, so a group of any size costs as many pairs as it has members. What
   that leaves in different components is compared across components, all pairs that the filters admit, each
   posting outside the largest component of its shingle against the others; a shingle of many such postings is dealt
   over several tasks. Pairs within one component are already known to be connected and are not compared, so the
   operator returns components, not a list of all links.
4. A pair found by its prefixes passes the length and positional filters, then a bitmap filter (parities of the sizes
   of fixed parts), and is verified once: with both sets at hand, the suffix filter cuts one at the recursive halves
   of the other and adds up by how much the parts differ, and what that admits is merged.

Memory: a task holds one slice of the hash space or one block at a time, both of which shrink as
spark.sql.shuffle.partitions grows; 32 bits and the slice tell shingles apart in the survey, where a false meeting only
lets a document through to the exact count.

Defined cases: a null or blank text has no shingles and is linked with nothing; a text of fewer than five words has
its whole sequence as its one shingle; texts that differ only in repeated shingles have equal sets; rows that repeat
an id and text get equal results; a null id is allowed and is nobody's component id unless all of a component's ids
are null; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.components import components
from evalspark.llm.shared import discard, fresh, materialise, mix64, word_hashes

WIDTH = 5
#: Similarity 3/4, in whole numbers.
NUM, DEN = 3, 4
#: Documents and shingles in one block; a block is split in as many slices as there are slices of the hash space.
BLOCK_DOCS, BLOCK_SHINGLES = 20_000, 1_500_000
#: Slices of the hash space per shuffle partition, up to this many slices in all.
SLICES, MOST_SLICES = 16, 4096
#: Parts of the bitmap filter: sets are cut into this many by the leading bits of the hash, and the parities of the
#: parts' sizes are kept as bits. Of two sets, as many shingles differ at least as parities do.
PARTS = 1024
_WORDS_OF_PARTS = PARTS // 64
#: Postings of a shingle that one task compares with as many others of it.
SALT_ROWS = 256
#: A shingle of more postings than this is hot: what belongs to it is broadcast to its postings, not joined by shuffle.
HOT_ROWS = 500
#: Halvings of the suffix filter.
HALVINGS = 5
#: Up to this many keys (8 bytes each) are broadcast to thin out a table.
BROADCAST_KEYS = 500_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


def shingles(words: np.ndarray) -> np.ndarray:
    """The sorted distinct shingle hashes of a sequence of word hashes."""
    n = len(words)
    if n == 0:
        return words
    if n < WIDTH:
        one = np.uint64(n)
        for w in words:
            one = mix64((one ^ w)[None] * _ODD[0])[0]
        return np.array([one], dtype=np.uint64)
    total = words[: n - WIDTH + 1] * _ODD[0]
    for k in range(1, WIDTH):
        total = total + words[k : n - WIDTH + 1 + k] * _ODD[k]
    return np.unique(mix64(total))


def _key(docs: DataFrame, doc_id: str, text: str) -> Column:
    """A row's key: rows of equal id and text are one document."""
    return F.xxhash64(docs[doc_id], docs[text])


_BINARY = ("keys", "ids", "no_id", "ns", "d1", "d2", "idx", "hashes", "dfs")
_BLOCKS = "to int, batch long, " + ", ".join(f"{c} binary" for c in _BINARY)
_BLOCK_SCHEMA = pa.schema([("to", pa.int32()), ("batch", pa.int64()), *[(c, pa.binary()) for c in _BINARY]])


def _block(to: int, batch: int, **parts: np.ndarray) -> dict:
    return {"to": to, "batch": batch} | {c: parts[c].tobytes() if c in parts else None for c in _BINARY}


def _emit(blocks: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(blocks, schema=_BLOCK_SCHEMA)


def _parities(s: np.ndarray) -> np.ndarray:
    """The parities of the sizes of a set's parts, as packed bits."""
    sizes = np.bincount((s >> np.uint64(64 - PARTS.bit_length() + 1)).astype(np.int64), minlength=PARTS)
    return np.packbits((sizes & 1).astype(np.uint8))


def _packed(sets: Iterator[tuple[int, int | None, np.ndarray]], n_slices: int, wide: bool) -> Iterator[pa.RecordBatch]:
    """Blocks of a stream of (key, id, set): one with what belongs to the documents, and one per slice of the hash space."""
    first, count = TaskContext.get().partitionId() << 32, 0

    def flush(rows: list[tuple[int, int | None, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        keys, ids, parts = zip(*rows, strict=True)
        ns = np.array([len(s) for s in parts], dtype="<u4")
        every = np.concatenate(parts)
        idx = np.repeat(np.arange(len(ns), dtype=np.uint16), ns)
        head = {"keys": np.array(keys, dtype="<i8"), "ns": ns}
        if not wide:
            head |= {"ids": np.array([i or 0 for i in ids], dtype="<i8"), "no_id": np.array([i is None for i in ids])}
            head |= {"d1": np.array([s.sum(dtype=np.uint64) for s in parts], dtype="<u8"), "d2": np.array([mix64(s ^ _ODD[1]).sum(dtype=np.uint64) for s in parts], dtype="<u8")}
        yield _emit([_block(-1, first + count, **head)])
        at = ((every >> np.uint64(32)) * np.uint64(n_slices) >> np.uint64(32)).astype(np.uint32)
        order = np.argsort(at.astype(np.uint16) if n_slices <= 65_536 else at, kind="stable")
        every, idx, at = every[order], idx[order], at[order]
        found, begin = np.unique(at, return_index=True)
        for k, a, b in zip(found.tolist(), begin, [*begin[1:], len(at)], strict=True):
            # documents ascend within a slice; their steps are mostly 0 and 1 and compress well
            step = np.diff(idx[a:b], prepend=np.uint16(0)).astype("<u2")
            yield _emit([_block(k, first + count, idx=step, hashes=every[a:b].astype("<u8" if wide else "<u4"))])

    rows, held = [], 0
    for row in sets:
        rows.append(row)
        held += len(row[2])
        if len(rows) >= BLOCK_DOCS or held >= BLOCK_SHINGLES:
            yield from flush(rows)
            rows, held, count = [], 0, count + 1
    if rows:
        yield from flush(rows)


def _runs(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[list[dict]]:
    """Consecutive rows of equal `by`; rows of by = -1 one at a time."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and (row[by] != held[0][by] or row[by] < 0):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _counted(batches: Iterator[pa.RecordBatch], wide: bool) -> Iterator[pa.RecordBatch]:
    """In a slice's task: which shingles occur more than once, told to the blocks that they came from."""
    for blocks in _runs(batches, "to"):
        if blocks[0]["to"] < 0:
            yield _emit(blocks)
            continue
        hashes = np.concatenate([np.frombuffer(b["hashes"], dtype="<u8" if wide else "<u4") for b in blocks])
        order = np.argsort(hashes)
        ordered = hashes[order]
        new = np.ones(len(ordered), dtype=bool)
        new[1:] = ordered[1:] != ordered[:-1]
        begin = np.flatnonzero(new)
        df = np.empty(len(ordered), dtype="<u4")
        df[order] = np.repeat(np.diff(begin, append=len(ordered)), np.diff(begin, append=len(ordered)))
        out, a = [], 0
        for block in blocks:
            idx = np.cumsum(np.frombuffer(block["idx"], dtype="<u2"), dtype=np.uint16)
            b = a + len(idx)
            shared = df[a:b] > 1
            if shared.any():
                more = {"hashes": hashes[a:b][shared], "dfs": df[a:b][shared]} if wide else {}
                out.append(_block(block["to"], block["batch"], idx=idx[shared].astype("<u2"), **more))
            a = b
        if out:
            yield _emit(out)


def _partitions(df: DataFrame) -> tuple[int, int]:
    """Shuffle partitions, and slices of the hash space."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return n, n * max(1, min(SLICES, MOST_SLICES // n))


def _exchange(packed: DataFrame, wide: bool) -> DataFrame:
    """Blocks to the slices' tasks and what is shared back, dealt by block; sorted, so that one slice or block is held
    at a time."""
    n, _ = _partitions(packed)
    sliced = packed.repartition(n, F.when(F.col("to") < 0, F.hash("batch")).otherwise(F.hash("to"))).sortWithinPartitions("to")
    return sliced.mapInArrow(lambda batches: _counted(batches, wide), _BLOCKS).repartition(n, "batch").sortWithinPartitions("batch", "to")


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[dict]]]:
    """Each block's head, which comes first, and what returned of its shingles."""
    for rows in _runs(batches, "batch"):
        yield rows[0], rows[1:]


def _least_shared(n: np.ndarray) -> np.ndarray:
    """How many of a set's n shingles any linked set has too."""
    return (NUM * n.astype(np.int64) + DEN - 1) // DEN


def survey(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, doc_id, n, d1, d2, close) for every row: set size, a 128-bit digest of the set, and whether three
    quarters of its shingles occur elsewhere (by 32 bits and the slice)."""
    _, n_slices = _partitions(docs)
    narrow = docs.select(_key(docs, doc_id, text).alias("key"), docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64()), ("close", pa.bool_())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = ((key, i, shingles(w)) for batch in batches for key, i, w in zip(batch.column("key").to_pylist(), batch.column("doc_id").to_pylist(), word_hashes(batch.column("text")), strict=True))
        yield from _packed(sets, n_slices, wide=False)

    def surveyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, rest in _by_block(batches):
            keys, ids, d1, d2 = (np.frombuffer(head[c], dtype="<i8") for c in ("keys", "ids", "d1", "d2"))
            ns, no_id = np.frombuffer(head["ns"], dtype="<u4"), np.frombuffer(head["no_id"], dtype=bool)
            m = np.zeros(len(ns), dtype=np.int64)
            for row in rest:
                m += np.bincount(np.frombuffer(row["idx"], dtype="<u2"), minlength=len(ns))
            close = (ns > 0) & (m >= _least_shared(ns))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids, mask=no_id), pa.array(ns.astype(np.int32)), pa.array(d1), pa.array(d2), pa.array(close)], schema=schema)

    return _exchange(narrow.mapInArrow(pack, _BLOCKS), wide=False).mapInArrow(surveyed, "key long, doc_id long, n int, d1 long, d2 long, close boolean")


def _few(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_KEYS else df


_BITS = f"struct<{', '.join(f'p{k}: long' for k in range(_WORDS_OF_PARTS))}>"


def set_table(docs: DataFrame, wanted: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n, bits, shingles binary) of the documents in wanted (key, copies): the bitmap and the set. Rows that
    repeat an id and text are one document; only those are dealt out to find one of them."""
    narrow = docs.select(_key(docs, doc_id, text).alias("key"), docs[text].alias("text"))
    n, repeated = wanted.count(), wanted.filter("copies > 1")
    found = narrow.join(_few(wanted.filter("copies = 1").select("key"), n), "key", "left_semi")
    if not repeated.isEmpty():
        found = found.unionByName(narrow.join(_few(repeated.select("key"), n), "key", "left_semi").dropDuplicates(["key"]))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(w) for w in word_hashes(batch.column("text"))]
            words = np.stack([_parities(s) for s in found]).view("<i8") if found else np.empty((0, _WORDS_OF_PARTS), dtype="<i8")
            bits = pa.StructArray.from_arrays([pa.array(words[:, k].copy()) for k in range(_WORDS_OF_PARTS)], names=[f"p{k}" for k in range(_WORDS_OF_PARTS)])
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([len(s) for s in found], pa.int32()), bits, pa.array([s.tobytes() for s in found], pa.binary())], names=["key", "n", "bits", "shingles"])

    return found.mapInArrow(sets, f"key long, n int, bits {_BITS}, shingles binary")


def postings(sets: DataFrame) -> DataFrame:
    """A row per shingle of a set's prefix that other sets have too: its place in the rare-first order and the number
    of the set's own shingles (no other has them; they come first)."""
    _, n_slices = _partitions(sets)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = ((key, None, np.frombuffer(s, dtype="<u8")) for batch in batches for key, s in zip(batch.column("key").to_pylist(), batch.column("shingles").to_pylist(), strict=True))
        yield from _packed(stream, n_slices, wide=True)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, rest in _by_block(batches):
            if not rest:
                continue
            keys, ns = np.frombuffer(head["keys"], dtype="<i8"), np.frombuffer(head["ns"], dtype="<u4").astype(np.int64)
            idx = np.concatenate([np.frombuffer(r["idx"], dtype="<u2") for r in rest]).astype(np.int64)
            hashes = np.concatenate([np.frombuffer(r["hashes"], dtype="<u8") for r in rest])
            dfs = np.concatenate([np.frombuffer(r["dfs"], dtype="<u4") for r in rest])
            order = np.lexsort((hashes, dfs, idx))
            idx, hashes = idx[order], hashes[order]
            m = np.bincount(idx, minlength=len(ns))
            own = ns - m
            pos = np.arange(len(idx)) - (np.cumsum(m) - m)[idx] + own[idx]
            prefix = ns - _least_shared(ns) + 1
            take = (m >= _least_shared(ns))[idx] & (pos < prefix[idx])
            idx = idx[take]
            if len(idx):
                yield pa.RecordBatch.from_arrays([pa.array(hashes[take].view(np.int64)), pa.array(keys[idx]), pa.array(ns[idx].astype(np.int32)), pa.array(pos[take].astype(np.int32)), pa.array(own[idx].astype(np.int32))], names=["shingle", "key", "n", "pos", "own"])

    return _exchange(sets.select("key", "shingles").mapInArrow(pack, _BLOCKS), wide=True).mapInArrow(prefixes, "shingle long, key long, n int, pos int, own int")


def _needed() -> Column:
    """Shingles that sets of sizes x.n and y.n must share."""
    return F.ceil((F.col("x.n") + F.col("y.n")) * NUM / (NUM + DEN))


def admitted() -> Column:
    """Whether the length and positional filters admit a pair x, y, found by a shingle at places x.pos, y.pos of their
    orders. Shingles before it may be shared too, as many as the smaller place."""
    c = F.col
    length = (c("x.n") * DEN >= c("y.n") * NUM) & (c("y.n") * DEN >= c("x.n") * NUM)
    return length & (F.least("x.pos", "y.pos") + F.least(c("x.n") - c("x.pos"), c("y.n") - c("y.pos")) >= _needed())


def bitmap_admitted() -> Column:
    """Whether the bitmap filter admits a pair x, y."""
    apart = sum((F.bit_count(F.col(f"x.bits.p{k}").bitwiseXOR(F.col(f"y.bits.p{k}"))) for k in range(_WORDS_OF_PARTS)), F.lit(0))
    return apart <= F.col("x.n") + F.col("y.n") - 2 * _needed()


def _alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets are similar enough."""
    total = len(x) + len(y)
    most_apart = total - 2 * ((NUM * total + NUM + DEN - 1) // (NUM + DEN))
    # suffix filter: y cut at its halves, quarters, ..., x at the same places; parts differ by at least their sizes
    at = np.unique(np.linspace(0, len(y), (1 << HALVINGS) + 1).astype(np.int64)[1:-1])
    at = at[at < len(y)]
    cut = np.searchsorted(x, y[at])
    apart = np.abs(np.diff(cut, prepend=0, append=len(x)) - np.diff(at, prepend=0, append=len(y))).sum()
    if apart > most_apart:
        return False
    both = np.sort(np.concatenate((x, y)))
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return (NUM + DEN) * common >= NUM * total


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of materialised pairs (a, b), each once, those whose sets are similar enough. One set travels with the pair, the
    other comes once from a table thinned out to what the pairs need."""
    n = pairs.count()
    needed = lambda c, s: sets.join(_few(pairs.select(F.col(c).alias("key")).distinct(), n), "key", "left_semi").select(F.col("key").alias(c), F.col("shingles").alias(s))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_alike(np.frombuffer(x.as_buffer(), dtype="<u8"), np.frombuffer(y.as_buffer(), dtype="<u8")) for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(needed("a", "sa"), "a").join(needed("b", "sb"), "b").select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long")


def _beside(rows: DataFrame, per: DataFrame) -> DataFrame:
    """rows joined by shingle with per, a materialised table of one row per shingle and its number of rows, df."""
    hot = per.filter(F.col("df") > HOT_ROWS)
    n = hot.count()
    if not 0 < n <= BROADCAST_KEYS:
        return rows.join(per, "shingle")
    cold = rows.join(F.broadcast(hot.select("shingle")), "shingle", "left_anti").join(per.filter(F.col("df") <= HOT_ROWS), "shingle")
    return rows.join(F.broadcast(hot), "shingle").unionByName(cold)


def _centres(posts: DataFrame) -> DataFrame:
    """Of each shingle that several prefixes have the centre as y: the set with the least share of its own shingles,
    then the least key."""
    share = (F.col("own") / F.col("n")).alias("share")
    centre = posts.groupBy("shingle").agg(F.min(F.struct(share, "key", "n", "pos")).alias("y"), F.count(F.lit(1)).alias("df"))
    return centre.filter("df > 1")


def _star_pairs(starred: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): each set with the centres of its shingles, as far as the filters admit them; b is the centre."""
    found = starred.select(F.struct("key", "n", "pos").alias("x"), "y").filter((F.col("x.key") != F.col("y.key")) & admitted())
    pairs = found.select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct()
    # two sets may be each other's centre
    once = pairs.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.min("b").alias("b")).select((F.col("lo").bitwiseXOR(F.col("hi")).bitwiseXOR(F.col("b"))).alias("a"), "b")
    bits = sets.select("key", "n", "bits").hint("shuffle_merge")
    joined = once.join(bits.select(F.col("key").alias("a"), F.struct("n", "bits").alias("x")), "a")
    return joined.join(bits.select(F.col("key").alias("b"), F.struct("n", "bits").alias("y")), "b").filter(bitmap_admitted()).select("a", "b")


def _mixed(starred: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Postings of shingles that more than one component has, with component and bitmap."""
    named = starred.select("shingle", "key", "pos").join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    per = named.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("df"))
    per = materialise(per.filter("lo <> hi").select("shingle", "df"), "jaccard-mixed-shingles")
    return _beside(named, per).drop("df").join(sets.select("key", "n", "bits").hint("shuffle_merge"), "key")


def _cross_pairs(posts: DataFrame) -> DataFrame:
    """All admitted pairs of postings in different components: those outside a shingle's largest component against
    the rest. Of a shingle with many, both sides are cut into parts of some SALT_ROWS rows, and each pair of parts is
    a join key of its own."""
    sizes = posts.groupBy("shingle", "component").count()
    per = sizes.groupBy("shingle").agg(F.max(F.struct("count", "component")).alias("m"), F.sum("count").alias("df"))
    parts = lambda n: F.ceil(n / SALT_ROWS).cast("int")
    per = materialise(per.select("shingle", "df", F.col("m.component").alias("largest"), parts(F.col("df") - F.col("m.count")).alias("xs"), parts(F.col("df")).alias("ys")), "jaccard-largest")
    named = _beside(posts, per)
    own = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = named.filter("component <> largest").withColumn("i", own("xs")).withColumn("j", every("ys")).alias("x")
    y = named.withColumn("j", own("ys")).withColumn("i", every("xs")).alias("y")
    # a pair of two outside postings would come twice; the smaller key takes it
    once = (F.col("y.component") == F.col("y.largest")) | (F.col("x.key") < F.col("y.key"))
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("shingle", "i", "j")]
    found = x.join(y, [*same, F.col("x.component") != F.col("y.component"), once])
    return found.filter(admitted() & bitmap_admitted()).select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct()


def links(sets: DataFrame) -> DataFrame:
    """Links (a, b) between sets that connect all that are similar enough, directly or through others."""
    posts = materialise(postings(sets), "jaccard-postings")
    centres = materialise(_centres(posts), "jaccard-centres")
    starred = materialise(_beside(posts.drop("own"), centres).drop("df"), "jaccard-starred")
    discard(posts, centres)
    compared = materialise(_star_pairs(starred, sets), "jaccard-stars")
    found = materialise(verify(compared, sets), "jaccard-links")
    mixed = materialise(_mixed(starred, components(found), sets), "jaccard-mixed")
    discard(starred)
    either = compared.unionByName(compared.select(F.col("b").alias("a"), F.col("a").alias("b")))
    across = materialise(_cross_pairs(mixed).join(either, ["a", "b"], "left_anti"), "jaccard-across")
    discard(mixed, compared)
    more = materialise(verify(across, sets), "jaccard-links")
    discard(across)
    return found.unionByName(more)


def _labelled(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(key, doc_id, n, component) for every row of docs; a text without words is its own component."""
    info = materialise(survey(docs, doc_id, text), "jaccard-info")
    # one document stands for each class of equal sets
    full = info.filter("close").groupBy("d1", "d2", "key").agg(F.count(F.lit(1)).alias("copies"))
    first = materialise(full.groupBy("d1", "d2").agg(F.min(F.struct("key", "copies")).alias("f")).select("d1", "d2", "f.key", "f.copies"), "jaccard-first")
    sets = materialise(set_table(docs, first.select("key", "copies"), doc_id, text), "jaccard-sets")
    labels = components(links(sets)).withColumnRenamed("node", "key")
    discard(sets)
    named = first.join(labels, "key", "left").select("d1", "d2", F.coalesce("component", "key").alias("component"))
    # a document that shares less than that with others stands alone: the key of its class is its own
    component = F.when(F.col("n") > 0, F.coalesce("component", "key")).otherwise(F.col("key"))
    return info.join(named, ["d1", "d2"], "left").select("key", "doc_id", "n", component.alias("component"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs."""
    rows = _labelled(docs, doc_id, text)
    least = rows.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "component").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component: one of the smallest id; of rows that repeat its id and text, all but one go."""
    counts = _labelled(docs, doc_id, text).groupBy("component", "key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key", "copies")).alias("m")
    key, = fresh(docs.columns, "_key")
    kept = materialise(counts.groupBy("component").agg(first).select(F.col("m.key").alias(key), F.col("m.copies").alias("_copies")), "jaccard-kept")
    keyed = docs.select("*", _key(docs, doc_id, text).alias(key))
    out = keyed.join(kept.filter("_copies = 1"), key, "left_semi")
    repeated = kept.filter("_copies > 1")
    if not repeated.isEmpty():
        # only rows that have copies are dealt out; they combine on the map side
        out = out.unionByName(keyed.join(repeated, key, "left_semi").dropDuplicates([key]))
    return out.select(*docs.columns)
