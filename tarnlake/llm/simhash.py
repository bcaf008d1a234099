"""SimHash near-dedup with covering locality-sensitive hashing.

Each bit position of the fingerprint is given a non-zero vector of radius + 1 bits; for each of the 2^(radius+1) - 1
non-zero masks v, table v keeps the positions whose vector has an odd product with v and blanks the rest.  At most
``radius`` differing positions span at most ``radius`` dimensions, so some mask is orthogonal to all of them: every pair
within the radius meets in some table, with certainty.  Pairs that meet are verified by counting bits.

Only distinct fingerprints enter the tables, a table row is 20 bytes, and what a bucket hands on is a chain
through each of its components, never its pairs; a large bucket is dealt anew into tables over the bits its members differ in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, own_columns, written
from .components import connected_components

SEED = 42


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats counted; 0 for a text without words."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(b" ".join(parts), SEED)
    joined = b" ".join(parts)
    at, starts = 0, []
    for part in parts:
        starts.append(at)
        at += len(part) + 1
    ends = starts[words:]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends)]
    hashes.append(digest(joined[starts[-words] :], SEED))
    ones = np.zeros(64, np.int64)
    for low in range(0, len(hashes), 4096):
        block = np.array(hashes[low : low + 4096], dtype="<u8")
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def covering_masks(radius: int, bits: int = 64, positions: list[int] | None = None) -> list[int]:
    """2^(radius+1) - 1 masks over the positions (default: all bits) of which every set of at most ``radius`` escapes at least one."""
    span = 1 << (radius + 1)
    vectors = [(p, 1 + i % (span - 1)) for i, p in enumerate(range(bits) if positions is None else positions)]
    return [sum(1 << p for p, m in vectors if (m & v).bit_count() % 2) for v in range(1, span)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: Up to so many fingerprints of a bucket are compared with each other; more are dealt into tables over the bits they differ in.
TOGETHER = 2048


def chain_components(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of which those of distinct uint64 fingerprints at ``radius`` or fewer bits make the same components."""
    links, left = [], prints
    if len(prints) > TOGETHER:
        differ = int(np.bitwise_or.reduce(prints ^ prints[0]))
        for mask in covering_masks(radius, positions=[p for p in range(64) if differ >> p & 1]):
            keys = prints & np.uint64(mask)
            order = np.argsort(keys, kind="stable")
            cuts = np.flatnonzero(np.diff(keys[order])) + 1
            if not len(cuts):
                break  # this table parts nothing
            for part in np.split(prints[order], cuts):
                links += chain_components(part, radius)
        else:
            return links
        links = []
    while len(left) > 1:
        queue, left, last = [left[0]], left[1:], None
        while queue:
            x = queue.pop()
            if last is not None:
                links.append((int(last), int(x)))
            last = x
            if len(left):
                near = np.bitwise_count(left ^ x) <= radius
                if near.any():
                    queue.extend(left[near])
                    left = left[~near]
    return links


def _print_batches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [_signed(fingerprint(t.as_py(), words)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["id", "fp"])

    return run


def _link_batches(radius: int):
    """Rows come sorted by (tab, key): runs of two and more become links; a run may span batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the parts of the run that may go on
        last = None
        for batch in _ended(batches):
            links: list[tuple[int, int]] = []
            if batch is None or batch.num_rows:
                ready = []
                if batch is not None:
                    tab, key, fp = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
                    parts = np.split(fp, np.flatnonzero((tab[1:] != tab[:-1]) | (key[1:] != key[:-1])) + 1)
                    if last == (tab[0], key[0]):
                        held.append(parts.pop(0))
                    if parts:
                        ready, held = [held, *([p] for p in parts[:-1])], [parts[-1]]
                    last = (tab[-1], key[-1])
                else:
                    ready, held = [held], []
                for run_parts in ready:
                    if sum(map(len, run_parts)) > 1:
                        links += chain_components(np.unique(np.concatenate(run_parts).view(np.uint64)), radius)
            if links:
                pairs = np.array(links, dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def near_links(prints: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) that connect exactly what all pairs of distinct fingerprints within the radius connect."""
    masks = [_signed(m) for m in covering_masks(radius)]
    tables = F.explode(F.array(*[F.struct(F.lit(i).cast("bigint").alias("tab"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])).alias("t")
    rows = prints.select("fp", tables).select("t.tab", "t.key", "fp")
    return rows.repartition("tab", "key").sortWithinPartitions("tab", "key").mapInArrow(_link_batches(radius), "a bigint, b bigint")


def near_groups(docs: DataFrame, words: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints at radius or fewer differing bits link; component_id is the least id reachable.  A null or wordless text
    has the fingerprint zero and links like any other; a text of fewer words than a shingle is one shingle.  Repeated rows
    and ties share a component.  A null id is in its component but never names it unless all its ids are null, when
    component_id is null.  An empty table gives no rows.
    """
    rows = own_columns(docs, id=id_col, text=text_col).select(F.col("id").cast("bigint").alias("id"), "text")
    rows = written(rows.mapInArrow(_print_batches(words), "id bigint, fp bigint"), "prints")
    prints = written(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    found = written(connected_components(near_links(prints, radius)), "components")
    linked = prints.join(found, prints.fp == found.node).select("fp", "root", "least")
    named = linked.groupBy("root").agg(F.min("least").alias("name"))
    named = written(linked.select("fp", "root").join(named, "root").select(F.col("fp").alias("node"), "name"), "named")
    names = prints.join(named, prints.fp == named.node, "left").select("fp", F.coalesce("name", "least").alias("component_id"))
    names = written(names, "names")
    return rows.join(names, "fp").select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: drop_near: minima a text (one byte each is kept for the estimate), and tables keyed by three of them.
MINIMA, TRIPLES = 256, 24
#: Only pairs of which both texts have so many distinct shingles may be put aside by their estimate.
SHORT = 300
#: How far below the wanted similarity an estimate puts a pair aside; ids of at most so many open rows are broadcast.
DOUBT, BROADCAST_NODES = 0.2, 1_000_000
#: A block of a run: so many rows, and so many distinct shingles (four bytes each), on average.  A task holds two blocks at a time.
BLOCK, BLOCK_SHINGLES = 4096, 2_000_000


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct word shingles of a text as uint64 hashes in ascending order; none for a text without words."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    each = np.array([digest(p) for p in parts], np.uint64)
    n = max(1, len(each) - words + 1)
    mixed = np.full(n, SEED, np.uint64)
    for i in range(min(words, len(each))):
        mixed = (mixed ^ each[i : i + n]) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed * np.uint64(0x9E3779B97F4A7C15))


_XORED, _TIMES = np.random.default_rng(SEED).integers(0, 1 << 32, (2, MINIMA, 1), np.uint32) | np.array([[[0]], [[1]]], np.uint32)


def minima(shingles: np.ndarray) -> np.ndarray:
    """MINIMA uint32 least hashes of a set of shingles, each by a hash function of its own over the whole set, so that each agrees
    with another set's with a chance equal to their resemblance whatever their sizes.  All zero for an empty set."""
    if not len(shingles):
        return np.zeros(MINIMA, np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 1024):
        mixed = (short[at : at + 1024] ^ _XORED) * _TIMES
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x846CA68B)
        np.minimum(least, mixed.min(1), out=least)
    return least


def _minima_batches(words: int, masks: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, keys, sizes = [], [], []
            for t in batch.column("text"):
                text = t.as_py()
                shingles = shingle_set(text, words)
                sizes.append(len(shingles))
                m = minima(shingles).astype(np.uint64)
                kept.append(((m * np.uint64(0xE7037ED1A0B428DB)) >> np.uint64(56)).astype(np.uint8).tobytes())
                triples = m[: 3 * TRIPLES].reshape(TRIPLES, 3)
                mixed = (triples[:, 0] * np.uint64(3) ^ triples[:, 1]) * np.uint64(0x94D049BB133111EB) ^ triples[:, 2] * np.uint64(0xBF58476D1CE4E5B9)
                print_ = fingerprint(text, words)
                keys.append([*mixed.view(np.int64).tolist(), *(_signed(print_ & mask) for mask in masks)])
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(kept, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.int64())], ["node", "minima", "keys", "size"])

    return run


def alike_chain(sets: list[np.ndarray], root: np.ndarray, own: np.ndarray, within: bool, similarity: float) -> Iterator[tuple[int, int]]:
    """Links (i, j) that join what all pairs of sets (uint32) at ``similarity`` or more join beyond ``root``; pairs of one ``own`` are
    left out unless ``within``.

    A set is left out if too few of its elements occur in any other.  Of the rest, a set is compared with those that hold one of its
    rarest elements, of which one alike must hold some, and whose size allows it, unless links join them already."""
    sizes = np.array([len(s) for s in sets], np.int64)
    tokens = np.concatenate([np.zeros(0, np.uint32), *sets])
    kinds, counts = np.unique(tokens, return_inverse=True, return_counts=True)[1:]
    of_row = np.repeat(np.arange(len(sets)), sizes)
    common = counts[kinds] > 1
    shared = np.bincount(of_row[common], minlength=len(sets))
    order = np.argsort(sizes, kind="stable")
    order = order[shared[order] >= similarity * sizes[order] - 1e-6]
    place = np.full(len(sets), -1)
    place[order] = np.arange(len(order))
    sizes, shared, root, own = sizes[order], shared[order], root[order], own[order]
    # elements are numbered by rising frequency, rows by rising size; tokens go by (row, element)
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    common &= place[of_row] >= 0
    row, element = place[of_row[common]], rank[kinds[common]]
    by_row = np.lexsort((element, row))
    row, element = row[by_row], element[by_row]
    starts = np.searchsorted(row, np.arange(len(order) + 1))
    holders = row[np.argsort(element, kind="stable")]
    first = np.searchsorted(np.sort(element), np.arange(len(counts) + 1))
    mark = np.zeros(len(counts), bool)
    for i in range(len(order) - 1):
        # a larger set than this can't be alike, and no smaller one follows
        stop = int(np.searchsorted(sizes, int(sizes[i] / similarity + 1e-6), "right"))
        wanted = root[i + 1 : stop] != root[i]
        if not within:
            wanted &= own[i + 1 : stop] != own[i]
        if not wanted.any():
            continue
        if not sizes[i]:
            near = np.flatnonzero(wanted) + i + 1
        else:
            mine = element[starts[i] : starts[i + 1]]
            rarest = int(sizes[i] - np.ceil(similarity * sizes[i] - 1e-6) + 1 - (sizes[i] - shared[i]))
            met = np.zeros(len(order), bool)
            for e in mine[:rarest]:
                met[holders[first[e] : first[e + 1]]] = True
            near = np.flatnonzero(met[i + 1 : stop] & wanted) + i + 1
            if not len(near):
                continue
            mark[mine] = True
            lengths = starts[near + 1] - starts[near]
            at = np.repeat(starts[near] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
            both = np.add.reduceat(mark[element[at]].astype(np.int64), np.concatenate(([0], np.cumsum(lengths)[:-1])))
            mark[mine] = False
            near = near[both >= similarity * (sizes[i] + sizes[near] - both) - 1e-9]
        for k in near:
            if root[k] != root[i]:
                yield int(order[i]), int(order[k])
                root[root == root[k]] = root[i]


def _settle_batches(similarity: float):
    """Rows (tab, key, p, q, own, root, node, shingles) come sorted by the first four: a chain of links (a, b) through what the pairs of a
    group join that are alike and not of one block (but for p = q).  A group may span batches."""

    def settled(rows: list[tuple]) -> list[tuple[int, int]]:
        own, root, node = (np.array([r[i] for r in rows], np.int64) for i in (4, 5, 6))
        sets = [np.frombuffer(r[7], "<u4") for r in rows]
        return [(int(node[i]), int(node[j])) for i, j in alike_chain(sets, root, own, rows[0][2] == rows[0][3], similarity)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in _ended(batches):
            rows = list(zip(*[c.to_pylist() for c in batch.columns])) if batch is not None else [None]
            found: list[tuple[int, int]] = []
            for row in rows:
                if held and (row is None or row[:4] != held[0][:4]):
                    found += settled(held)
                    held = []
                held.append(row)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])

    return run


def _open_batches(similarity: float):
    """The pairs (a, b) that may be alike: by their sizes, and those without a text of fewer than SHORT shingles by their estimate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one, two = batch.column("one"), batch.column("two")
                x, y = (np.frombuffer(b"".join(c.field("minima").to_pylist()), np.uint8).reshape(-1, MINIMA) for c in (one, two))
                n, m = (c.field("size").to_numpy(zero_copy_only=False) for c in (one, two))
                less, more = np.minimum(n, m), np.maximum(n, m)
                kept = (less >= similarity * more) & ((less < SHORT) | ((x == y).mean(1) >= similarity - DOUBT))
                yield batch.select(["a", "b"]).filter(pa.array(kept))

    return run


def _set_batches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [(shingle_set(t.as_py(), words) >> np.uint64(32)).astype("<u4").tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], ["node", "shingles"])

    return run


def _exact_batches(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = []
            for one, two in zip(batch.column("one").to_pylist(), batch.column("two").to_pylist()):
                x, y = np.frombuffer(one, "<u4"), np.frombuffer(two, "<u4")
                shared = len(np.intersect1d(x, y))
                alike.append(shared >= similarity * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(alike, pa.bool_()))

    return run


def _with_both(pairs: DataFrame, kept: DataFrame, value: str) -> DataFrame:
    """pairs (a, b) with the value of either node as one and two."""
    one = kept.select(F.col("node").alias("a"), F.col(value).alias("one"))
    return pairs.join(one, "a").join(kept.select(F.col("node").alias("b"), F.col(value).alias("two")), "b").select("a", "b", "one", "two")


def _open_runs(met: DataFrame, found: DataFrame, sizes: DataFrame) -> DataFrame:
    """(tab, key, node, root, large, few, many): the members of the runs that span components of found (node, root) and have pairs besides
    those of the first look, one run of each set of members.

    ``large`` marks rows of the component that holds most of the run.  Those need not meet each other: they are dealt into ``many`` blocks
    and the others into ``few``.  A run that is one block altogether has few = 1 and many = 0."""
    rooted = written(met.where("n > 3").select("tab", "key", "node").join(found, "node", "left").select("tab", "key", "node", F.coalesce("root", "node").alias("root")), "members")
    same = [F.sum(F.col("node").bitwiseAND(F.lit(0xFFFFFFFF))).alias("x"), F.sum(F.shiftrightunsigned("node", 32)).alias("y"), F.bit_xor("node").alias("z")]
    spans = rooted.groupBy("tab", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n"), *same)
    chosen = spans.where("lo <> hi").groupBy("n", "x", "y", "z").agg(F.min(F.struct("tab", "key")).alias("run")).select("run.tab", "run.key")
    sizes = sizes.select("node", "size").dropDuplicates(["node"])
    opened = written(rooted.dropDuplicates(["tab", "key", "node"]).join(chosen, ["tab", "key"]).join(sizes, "node"), "open")
    blocks = F.sum(F.lit(1.0) / F.lit(BLOCK) + F.col("size") / F.lit(float(BLOCK_SHINGLES)))
    of_root = opened.groupBy("tab", "key", "root").agg(blocks.alias("blocks"))
    of_run = of_root.groupBy("tab", "key").agg(F.sum("blocks").alias("all"), F.max(F.struct("blocks", "root")).alias("most"))
    few = F.when(F.col("all") <= 1, F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil(F.col("all") - F.col("most.blocks"))))
    many = F.when(F.col("all") <= 1, F.lit(0)).otherwise(F.ceil("most.blocks"))
    of_run = written(of_run.select("tab", "key", F.col("most.root").alias("most"), few.cast("bigint").alias("few"), many.cast("bigint").alias("many")), "blocks")
    return opened.join(of_run, ["tab", "key"]).select("tab", "key", "node", "root", ((F.col("root") == F.col("most")) & (F.col("many") > 0)).alias("large"), "few", "many")


def _dealt(opened: DataFrame, sets: DataFrame) -> DataFrame:
    """The members of open runs with their sets (node, shingles), sorted by group (tab, key, p, q): each two blocks that must meet have a
    group of their own, so no task holds more than two blocks."""
    own = F.when(F.col("large"), F.col("few") + F.pmod(F.xxhash64("node"), F.col("many"))).otherwise(F.pmod(F.xxhash64("node"), F.col("few")))
    last = F.when(F.col("large"), F.col("few") - 1).otherwise(F.col("few") + F.col("many") - 1)
    rows = opened.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    rows = rows.select("tab", "key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "root", "node")
    group = ["tab", "key", "p", "q"]
    rows = rows.join(sets, "node").select(*group, "own", "root", "node", "shingles")
    return rows.repartition(*group).sortWithinPartitions(*group)


def drop_near(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near-duplicate texts, all columns kept.

    A resemblance of 0.8 on word shingles leaves some ten of 64 SimHash bits different, and covering tables of that radius number
    2^11 - 1.  So besides the covering tables of the text's SimHash there are TRIPLES tables keyed by three minima of
    its shingles, each minimum by a hash of its own, of which a pair at 0.8 misses all with a chance below 1e-7 whatever its length.
    Rows that meet in a table link if their sets of shingles are alike; no pair links by an estimate.

    The first look takes each row of a run with the run's least and greatest node, which joins most groups in a number of pairs that is
    linear in the rows; here the sets of two texts of SHORT shingles or more are compared only if their estimate over MINIMA minima is at
    most DOUBT below ``similarity``, which a pair at 0.8 misses with a chance below 1e-11.  Then every run that still spans components is
    settled by its sets where its rows meet: no pair goes unjudged, none is handed on, only a chain of links.

    Texts without words are alike.  Rows with equal id and text go or stay together (drop exact copies first); the row
    that stays in a group is the one with the least hash.  Null ids are hashed like any other, and an empty table stays empty.
    """
    names = docs.columns
    masks = covering_masks(radius)
    node = lambda i, t: F.xxhash64(F.col(i).cast("bigint"), F.coalesce(F.col(t), F.lit("")))
    rows = own_columns(docs, id=id_col, text=text_col).select(node("id", "text").alias("node"), "text")
    signed = written(rows.mapInArrow(_minima_batches(words, masks), "node bigint, minima binary, keys array<bigint>, size bigint"), "minima")
    tables = signed.select("node", F.posexplode("keys").alias("tab", "key"))
    runs = tables.groupBy("tab", "key").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count(F.lit(1)).alias("n"))
    met = written(tables.join(runs.where("first <> last"), ["tab", "key"]).select("tab", "key", "node", "first", "last", "n"), "runs")
    ends = F.explode(F.array("first", "last")).alias("end")
    pairs = met.select("node", ends).where("node <> end").select(F.least("node", "end").alias("a"), F.greatest("node", "end").alias("b"))
    pairs = written(pairs.distinct(), "pairs")
    sketches = signed.select("node", F.struct("minima", "size").alias("sketch")).dropDuplicates(["node"])
    likely = written(_with_both(pairs, sketches, "sketch").mapInArrow(_open_batches(similarity), "a bigint, b bigint"), "likely")

    def sets_of(nodes: DataFrame) -> DataFrame:
        nodes = written(nodes.distinct(), "doubtful")
        wanted = F.broadcast(nodes) if nodes.count() <= BROADCAST_NODES else nodes
        return written(rows.join(wanted, "node", "left_semi").mapInArrow(_set_batches(words), "node bigint, shingles binary").dropDuplicates(["node"]), "sets")

    sets = sets_of(likely.select(F.col("a").alias("node")).union(likely.select("b")))
    found = connected_components(_with_both(likely, sets, "shingles").mapInArrow(_exact_batches(similarity), "a bigint, b bigint"))
    opened = _open_runs(met, found, signed)
    settled = written(_dealt(opened, sets_of(opened.select("node"))).mapInArrow(_settle_batches(similarity), "a bigint, b bigint"), "settled")
    if not settled.isEmpty():
        found = connected_components(settled.union(found.where("node <> root")))
    gone = written(found.where("node <> root").select("node"), "gone")
    kept = numbered(docs).withColumn("node", node(f"c{names.index(id_col)}", f"c{names.index(text_col)}"))
    wanted = F.broadcast(gone) if gone.count() <= BROADCAST_NODES else gone
    return kept.join(wanted, "node", "left_anti").drop("node").toDF(*names)
