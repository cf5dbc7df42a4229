"""Candidate pairs of texts by an exact prefix filter over word triples, without a row per posting.

A text is its set of distinct runs of three words.  The triples have one order everywhere, rare ones first.  Two
texts of likeness ``t`` share a triple in the first ``size - ceil(t * size) + 1`` of both (their prefixes), so only
prefixes are posted.  Nothing else decides who may meet: every filter below is a bound that no true pair breaks.

1. ``post``: texts -> sets, sizes, sketches and prefix postings (triple digest, place in the order), packed per bucket.
2. ``meet``: a bucket's postings, sorted by (digest, size).  For each entry the sizes that the likeness and its own
   place allow form one stretch of the list, found by binary search, so other sizes are skipped by position.  Then
   the other's place is tested, and then the sketches.
3. the pairs of all buckets, each once.

*Place*: if the first triple that two texts share stands at places i and j (from 0), they share at most
``min(size_a - i, size_b - j)``, and likeness ``t`` needs ``t / (1 + t)`` of both sizes together.
*Sketch*: bit h is the parity of the number of triples that hash to h.  Two sketches differ in at most as many bits as
the sets differ in triples, and likeness ``t`` allows ``(1 - t) / (1 + t)`` of both sizes together.

No row meets itself.  Texts in very many rows must be collapsed before (``without_copies``); few copies meet like others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velmira.llm import textops as X
from velmira.session import cut

_BLOCK = 1 << 17  # pairs looked at at a time
_SLACK = 1e-9
_ROWS = 1 << 12  # texts sorted at a time: 12 bits of a sort key
_LEVEL_BITS, _HASH_BITS = 6, 46
#: Texts per bucket of postings, however many there are: a bucket is one task's work and has to fit in its memory.
_BUCKET_TEXTS = 32_768
#: Triples are counted in so many cells by their hash, and the cells are summed in so many stretches.
_CELLS, _STRETCHES = 1 << 20, 64
_PACKED = "bucket int, texts binary, sketches binary, postings binary"


# ---- order of the triples --------------------------------------------------------------------------------------
def _cell(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(40) & np.uint64(_CELLS - 1)).astype(np.int64)


def _count_stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count, level = np.zeros(_CELLS, np.int64), np.zeros(_CELLS, np.uint8)
    for batch in batches:
        keys, _ = ordered_sets(*X.word_hashes(batch.column(0).to_pylist()), level)
        count += np.bincount(_cell(keys << np.uint64(64 - _HASH_BITS)), minlength=_CELLS)
    yield _counted({i: c for i, c in enumerate(count.reshape(_STRETCHES, -1)) if c.any()})


def _sum_stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, packed in zip(*(c.to_pylist() for c in batch.columns)):
            total[i] = total.get(i, 0) + np.frombuffer(zstandard.decompress(packed), np.int64)
    yield _counted(total)


def _counted(counts: dict[int, np.ndarray]) -> pa.RecordBatch:
    packed = [zstandard.compress(c.tobytes()) for c in counts.values()]
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array(packed, pa.binary())], ["stretch", "counts"])


def triple_counts(rows: DataFrame) -> np.ndarray:
    """In how many of all texts of ``uid, body`` the triples of each cell stand.  Counted per task and summed by stretches of
    cells, so the driver gets as many bytes whatever the size of the table."""
    schema = "stretch int, counts binary"
    parts = rows.select("body").mapInArrow(_count_stage, schema)
    count = np.zeros((_STRETCHES, _CELLS // _STRETCHES), np.int64)
    for r in parts.repartition(F.col("stretch")).mapInArrow(_sum_stage, schema).collect():
        count[r.stretch] = np.frombuffer(zstandard.decompress(bytes(r.counts)), np.int64)
    return count.ravel()


def triple_levels(rows: DataFrame) -> bytes:
    """How frequent the triples of each cell are in all of ``uid, body`` (packed, small): thirds of a power of two, or as
    many steps as the highest count leaves room for.  Any order is right, a good one is fast."""
    count, most = triple_counts(rows), (1 << _LEVEL_BITS) - 1
    steps = min(3.0, most / max(np.log2(1.0 + count.max()), 1.0))
    return zstandard.compress(np.round(steps * np.log2(1.0 + count)).astype(np.uint8).tobytes())


def ordered_sets(words: np.ndarray, offsets: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(flat keys, offsets): each text's distinct triples, rare ones first.  A key is a triple's level and its hash."""
    g, go = X.grams(words, offsets, 3)
    if len(g) == 0:
        return g, np.zeros(len(offsets), np.int64)
    key = levels[_cell(g)].astype(np.uint64) << np.uint64(_HASH_BITS) | g >> np.uint64(64 - _HASH_BITS)
    below, mask = np.uint64(_LEVEL_BITS + _HASH_BITS), np.uint64((1 << (_LEVEL_BITS + _HASH_BITS)) - 1)
    flat, sizes = [], []
    for at in range(0, len(go) - 1, _ROWS):
        end = min(at + _ROWS, len(go) - 1)
        held = np.sort(key[go[at] : go[end]] | X.row_index(go[at : end + 1] - go[at]).astype(np.uint64) << below)
        held = held[np.concatenate(([True], held[1:] != held[:-1]))[: len(held)]]
        sizes.append(np.bincount((held >> below).astype(np.int64), minlength=end - at))
        flat.append(held & mask)
    return np.concatenate(flat), np.concatenate(([0], np.cumsum(np.concatenate(sizes))))


def sketches(keys: np.ndarray, offsets: np.ndarray, bits: int) -> np.ndarray:
    """One row of ``bits`` / 8 bytes per text: the parities of its keys."""
    out, step = np.zeros((len(offsets) - 1, bits // 8), np.uint8), 1 << 12
    for at in range(0, len(out), step):
        end = min(at + step, len(out))
        bit = (keys[offsets[at] : offsets[end]] & np.uint64(bits - 1)).astype(np.int64)
        count = np.bincount(X.row_index(offsets[at : end + 1]) * bits + bit, minlength=(end - at) * bits)
        out[at:end] = np.packbits((count & 1).astype(np.uint8).reshape(-1, bits), axis=1)
    return out


# ---- packing -------------------------------------------------------------------------------------------------
def _pack(*columns: np.ndarray) -> bytes:
    """int64 columns as byte planes under zstd; the first is kept as differences, its rows should come sorted."""
    first = np.diff(columns[0].view(np.int64), prepend=0)
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8).T for c in (first, *(c.view(np.int64) for c in columns[1:]))]
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(np.concatenate(planes)).tobytes())


def _unpack(buf: bytes, width: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(buf), np.uint8).reshape(8 * width, -1)
    columns = [np.ascontiguousarray(raw[8 * i : 8 * i + 8].T).view(np.int64).ravel() for i in range(width)]
    columns[0] = np.cumsum(columns[0])
    return columns


def _post_stage(ratio, least, bits, buckets, levels):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(zstandard.decompress(levels.value), np.uint8)
        for batch in batches:
            uid = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            salt = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            side = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
            words, offsets = X.word_hashes(batch.column(1).to_pylist())
            keys, at = ordered_sets(words, offsets, level)
            if len(keys) == 0:
                continue
            size, row = np.diff(at), X.row_index(at)
            place = np.arange(len(keys)) - at[row]
            prefix = size - np.ceil(ratio * size - _SLACK).astype(np.int64) + 1
            posted = (place < prefix[row]) & (np.diff(offsets) >= least)[row]
            row, place = row[posted], place[posted]
            digest = X.mix(keys[posted] ^ X.mix(salt)[row])
            sketch = sketches(keys, at, bits)
            which = (digest % np.uint64(buckets)).astype(np.int64)
            # the low bits only chose a bucket: 32 more bits identify a triple, the exact check follows
            digest = (digest >> np.uint64(32)).view(np.int64)
            for b in np.unique(which):
                here = which == b
                texts, local = np.unique(row[here], return_inverse=True)
                order = np.argsort(uid[texts], kind="stable")
                moved = np.empty(len(order), np.int64)
                moved[order] = np.arange(len(order))
                local, texts = moved[local], texts[order]
                sort = np.argsort(local, kind="stable")
                body = _pack(uid[texts], size[texts], side[texts]), sketch[texts].tobytes(), _pack(local[sort], digest[here][sort], place[here][sort])
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), *(pa.array([x], pa.binary()) for x in body)], ["bucket", "texts", "sketches", "postings"])

    return run


def _bucket_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list[bytes]]]:
    """Bodies of each bucket; a partition holds the rows of one bucket."""
    held = [body for batch in batches for _, *body in zip(*(c.to_pylist() for c in batch.columns))]
    if held:
        yield held


def _meet_lists(digest, text, place, size, side, sketch, ratio):
    """Pairs of texts that share a posted triple and break no bound, in blocks: yields (text, text), some twice."""
    order = np.argsort(digest << 31 | np.minimum(size, (1 << 31) - 1)[text])
    digest, text, place = digest[order], text[order], place[order]
    part, allowed = ratio / (1 + ratio), (1 - ratio) / (1 + ratio)
    top = int(size.max()) + 2
    n = size[text]
    # the smaller of two texts needs a place that would do for two texts of its size
    early = n - place >= 2 * part * n - _SLACK
    most = np.floor((n - place) / part - n + _SLACK).astype(np.int64)  # the largest partner at this place
    low = np.ceil(n * ratio - _SLACK).astype(np.int64)
    # the first half of the sketches lies in the order of the lists; the rest is only looked up for pairs that pass it
    half = max(sketch.shape[1] // 2, 1)
    planes, rest = [np.ascontiguousarray(sketch[:, j])[text] for j in range(half)], np.ascontiguousarray(sketch[:, half:])
    cost = (allowed * n + _SLACK).astype(np.float32)
    one_side = bool((side == 3).all())
    on = [np.ones(len(text), bool)] if one_side else [(side[text] & 1) > 0, (side[text] & 2) > 0]
    for larger, smaller in zip(on, reversed(on)):
        ours, theirs = np.flatnonzero(larger), np.flatnonzero(smaller & early)
        listed = digest[theirs] * top + n[theirs]
        first = np.searchsorted(listed, digest[ours] * top + low[ours], side="left")
        last = np.searchsorted(listed, digest[ours] * top + np.maximum(np.minimum(n, most)[ours], 0), side="right")
        if one_side:
            last = np.minimum(last, np.searchsorted(theirs, ours))
        partners = np.maximum(last - first, 0)
        some = np.flatnonzero(partners)
        left = tuple(x[theirs] for x in (text, most, cost)), [x[theirs] for x in planes]
        right = tuple(x[ours[some]] for x in (text, n, cost)), [x[ours[some]] for x in planes]
        yield from _stretches(left, right, first[some], partners[some], rest)


def _stretches(theirs, ours, first, partners, rest):
    """The pairs of each of ``ours`` with its stretch of ``theirs`` that pass both bounds.  Everything is kept in the
    order of the lists, so a stretch is read from one place; a sketch is compared word by word and left when too unlike."""
    (t_text, t_most, t_cost), t_planes = theirs
    (o_text, o_size, o_cost), o_planes = ours
    cum, begin = np.cumsum(partners), 0
    while begin < len(partners):
        base = cum[begin - 1] if begin else 0
        end = max(int(np.searchsorted(cum, base + _BLOCK, side="right")), begin + 1)
        rep = partners[begin:end]
        o = np.repeat(np.arange(begin, end), rep)
        t = np.repeat(first[begin:end] - (np.cumsum(rep) - rep), rep) + np.arange(len(o))
        near = np.flatnonzero(t_most[t] >= o_size[o])
        o, t = o[near], t[near]
        bound = t_cost[t] + o_cost[o]
        apart = np.zeros(len(o), np.uint16)
        for mine, other in zip(o_planes, t_planes):
            apart += np.bitwise_count(mine[o] ^ other[t])
        near = np.flatnonzero(apart <= bound)
        a, b = t_text[t[near]], o_text[o[near]]
        near = np.flatnonzero(apart[near] + np.bitwise_count(rest[a] ^ rest[b]).sum(axis=1, dtype=np.int64) <= bound[near])
        a, b = a[near], b[near]
        if len(a):
            differ = a != b
            yield a[differ], b[differ]
        begin = end


def _meet_stage(ratio, bits):
    def run(batches):
        for held in _bucket_groups(batches):
            texts = [_unpack(t, 3) for t, _, _ in held]
            postings = [_unpack(p, 3) for _, _, p in held]
            starts = np.cumsum([0, *(len(t[0]) for t in texts)])
            uid, size, side = (np.concatenate([t[i] for t in texts]) for i in range(3))
            sketch = np.concatenate([np.frombuffer(s, np.uint64).reshape(-1, bits // 64) for _, s, _ in held])
            text = np.concatenate([p[0] + start for p, start in zip(postings, starts)])
            digest, place = (np.concatenate([p[i] for p in postings]) for i in (1, 2))
            for a, b in _meet_lists(digest, text, place, size, side, sketch, ratio):
                pair = np.unique(np.minimum(a, b) * len(uid) + np.maximum(a, b))
                a, b = uid[pair // len(uid)], uid[pair % len(uid)]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


def overlapping_pairs(texts: DataFrame, ratio: float, least: int, levels: bytes, bits: int = 512, n_texts: int = 0, buckets: int | None = None) -> DataFrame:
    """Every pair of different rows whose likeness may be ``ratio`` or more, and few others: ``a, b`` with ``a < b``.

    ``texts``: ``uid BIGINT`` (unique), ``body STRING``, ``salt BIGINT`` (texts of different salt never meet), and
    optionally ``side INT``: 1, 2 or 3 for both; a text of one side then only meets texts of the other.
    ``levels``: from ``triple_levels``.  ``bits``: width of a sketch, a power of two from 64 up; wider ones keep more
    unlike pairs out.  ``n_texts``: rows of ``texts``, at least about; buckets grow with it, so a task's work doesn't.
    Null and empty texts, and texts shorter than ``least`` words, are in no pair; an empty input gives an empty result.
    """
    spark = texts.sparkSession
    # a text's sketch goes to each bucket that one of its postings is in, so there are no more buckets than needed
    buckets = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_texts // _BUCKET_TEXTS))
    side = F.col("side").cast("long") if "side" in texts.columns else F.lit(3).cast("long")
    shared = spark.sparkContext.broadcast(levels)
    postings = texts.select("uid", "body", "salt", side.alias("side")).mapInArrow(_post_stage(ratio, least, bits, buckets, shared), _PACKED)
    met = postings.repartitionById(buckets, F.col("bucket")).mapInArrow(_meet_stage(ratio, bits), "a bigint, b bigint")
    return met.distinct()


# ---- exact check ---------------------------------------------------------------------------------------------
def likeness_of_batches(left: list[str], right: list[str], k: int = 3) -> np.ndarray:
    """Shared distinct runs of k words over all distinct runs, text by text; 0 where neither has any.

    A text that stands in several pairs is taken apart once.
    """
    number: dict[str, int] = {}
    sides = [np.array([number.setdefault(t, len(number)) for t in texts], dtype=np.int64) for texts in (left, right)]
    return likeness_of_pairs(*X.grams(*X.word_hashes(number), k), *sides)


def likeness_of_pairs(g: np.ndarray, go: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``likeness_of_batches`` of texts given by number; ``g, go``: the runs of each text and their offsets."""
    out, step, low = np.zeros(len(left)), 1 << 12, np.uint64(51)
    g = g >> np.uint64(64 - 51)
    for at in range(0, len(left), step):
        sets = []
        for side in (left, right):
            which = side[at : at + step]
            size = go[which + 1] - go[which]
            start = np.concatenate(([0], np.cumsum(size)))
            take = np.repeat(go[which] - start[:-1], size) + np.arange(start[-1])
            held = np.sort(g[take] | np.repeat(np.arange(len(which), dtype=np.uint64) << low, size))
            sets.append(held[np.concatenate(([True], held[1:] != held[:-1]))[: len(held)]])
        every = np.sort(np.concatenate(sets))
        both = every[1:][every[1:] == every[:-1]]
        n = len(left[at : at + step])
        count = [np.bincount((s >> low).astype(np.int64), minlength=n) for s in (*sets, both)]
        union = count[0] + count[1] - count[2]
        out[at : at + step] = np.where(union > 0, count[2] / np.maximum(union, 1), 0.0)
    return out


def _check_stage(least):
    def run(batches):
        for batch in batches:
            names = batch.schema.names
            column = lambda n: batch.column(names.index(n))
            like = likeness_of_batches(column("left_body").to_pylist(), column("right_body").to_pylist())
            keep = pa.array(like >= least - 1e-12)
            yield pa.RecordBatch.from_arrays(
                [column("a").filter(keep), column("b").filter(keep), pa.array(like).filter(keep)], ["a", "b", "likeness"]
            )

    return run


_FILTER_BITS = 1 << 23


def wanted(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The texts that may stand in a pair: a bit table of fixed size (at most 131,072 longs, so safe to broadcast)
    keeps most others out of the shuffle.  It lets some through, which the joins then drop; it never drops one."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(_FILTER_BITS))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("uid")).select(place("uid").alias("p"))
    table = ends.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits"))
    placed = texts.withColumn("p", place("uid")).withColumn("word", F.shiftright("p", 6))
    return placed.join(F.broadcast(table), "word").where("shiftrightunsigned(bits, cast(p % 64 as int)) & 1 = 1").select("uid", "body")


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """``a, b, likeness`` of the pairs whose exact likeness (runs of three words) is at least ``least``."""
    bodies = wanted(texts.select("uid", "body"), pairs)
    right = pairs.select("a", "b").join(bodies.withColumnsRenamed({"uid": "b", "body": "right_body"}), "b")
    both = right.join(bodies.withColumnsRenamed({"uid": "a", "body": "left_body"}), "a")
    return both.select("a", "b", "left_body", "right_body").mapInArrow(_check_stage(least), "a bigint, b bigint, likeness double")


#: A text that stands in more rows than this is searched once and its rows are listed afterwards.
COPIES = 8
BROADCAST_TEXTS = 100_000


def text_key() -> Column:
    return F.xxhash64("salt", "body")


def copied_texts(rows: DataFrame, *extra: Column) -> tuple[DataFrame, int]:
    """(``text_key, first_uid`` and the aggregates ``extra`` of the texts in more than ``COPIES`` rows, their number).

    ``rows``: ``uid, body, salt``.  A group of copies, however large, is counted map-side and never gathered.
    """
    counts = rows.select(text_key().alias("text_key"), "uid", *(c for c in ("side",) if c in rows.columns)).groupBy("text_key")
    many = cut(counts.agg(F.min("uid").alias("first_uid"), F.count("*").alias("n"), *extra).where(F.col("n") > COPIES))
    return many, many.count()


def without_copies(rows: DataFrame, many: DataFrame, n_many: int) -> DataFrame:
    """``rows`` with one row for each of the texts of ``many``, which has their ``side`` if they have one.  The list is
    broadcast up to ``BROADCAST_TEXTS`` texts and joined by shuffle beyond."""
    if n_many == 0:
        return rows
    sided = "side" in rows.columns
    listed = many.select("text_key", "first_uid", *([F.col("side").alias("all_sides")] if sided else []))
    listed = F.broadcast(listed) if n_many <= BROADCAST_TEXTS else listed
    joined = rows.withColumn("text_key", text_key()).join(listed, "text_key", "left").where("first_uid is null or first_uid = uid")
    side = [F.coalesce("all_sides", "side").alias("side")] if sided else []
    return joined.select("uid", "body", "salt", *side)
