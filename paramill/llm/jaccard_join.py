"""Near duplicates by an n-gram Jaccard join with vertical partitioning.

Documents are sets of word shingles; two of them link when their Jaccard similarity reaches 0.75.

1. Documents with the same set form a class, which is joined once. Half of the n-gram codes (the even
   ones) are counted exactly, whatever the size of the table: they go to owners of code ranges, which
   send back those that several documents have, with their counts. Prefixes of small sets need odd
   codes as well; a sketch of fixed size from the first pass notes which shingles occur twice, and
   roughly how often. The global n-gram order is (even first; once, then by count; code), rare first.
   Counts only shape the order, and any order gives the same links.
2. Two linked classes share an n-gram among the first quarter of the larger one's order (prefix) that
   is among the first seventh of the smaller one's (short prefix). Owners of n-gram ranges order the
   classes of a shared prefix n-gram by set size and join those in whose short prefix it is with the
   next of these, and any other with the last of these before it, if the sizes allow the similarity.
   That gives linearly many edges and still joins any two classes that could link; the components of
   these edges are blocks that hold every link inside.
3. Blocks are cut into tiles of at most two chunks of classes, and the n-gram codes into fragments.
   Each (tile, fragment) counts partial overlaps of all pairs of the tile; per tile the partial
   counts are summed per pair and compared with the sizes. A tile passes on stars over what its
   links join, which keeps every component, rather than all pairs within a group of copies.
4. Components of the stars give each document the least doc_id that links reach.

Defined cases: A-Z count as lower case; null or empty text, or text without words, has an empty
set, links with nothing and is its own component; with fewer than five words the whole sequence
is the one shingle; a null doc_id links with nothing and has a null component; rows that share a
doc_id are separate documents. Empty tables give empty results. Further columns are ignored.
Shingles are compared by 48-bit codes, and equal sets by 64-bit names.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paramill.llm.common import arrow_map, ship, unfolded, whole_row, whole_text, written
from paramill.llm.components import components, least_reached, stars
from paramill.llm.shingles import CODE_BITS, set_key, shingle_codes

#: Similarity in hundredths.
SIMILAR = 75
#: The sketch, dealt in ranges: for 2 to the first power of slots, whether a shingle was met, and whether another
#: was, a bit each; for 2 to the second power, how often one was met again within a task, a byte each (36 MB
#: whatever the data, 20 MB of them for the order).
SEEN_BITS, COUNT_BITS, SKETCH_RANGES = 27, 22, 64
#: Classes of a chunk, and fragments of the n-gram order.
CHUNK, FRAGMENT_BITS = 1024, 2
FRAGMENTS = 1 << FRAGMENT_BITS
#: Set sizes are compared as logarithms to base 2, so many steps to one, in two bytes.
SIZE_STEPS = 2500
#: Codes, and classes, of a bundle: what a reading task gathers before it deals it out.
BUNDLE_CODES, BUNDLE_CLASSES = 1 << 20, 1 << 15
#: Codes of classes for tiles in a group of tiles, and classes up to which texts are joined with a broadcast.
GROUP_CODES, BROADCAST_CLASSES = 1 << 22, 1 << 20
_SEEN_SHIFT, _COUNT_SHIFT = np.uint64(CODE_BITS - SEEN_BITS), np.uint64(CODE_BITS - COUNT_BITS)
_SEEN_BYTES, _COUNT_BYTES = (1 << SEEN_BITS) // 8 // SKETCH_RANGES, (1 << COUNT_BITS) // SKETCH_RANGES


def prefix_length(n: int) -> int:
    return n - -(-SIMILAR * n // 100) + 1


def short_prefix_length(n: int) -> int:
    """Of a set's first n-grams, so many hold the first one in common with any linked set that is no smaller."""
    return n - -(-2 * SIMILAR * n // (100 + SIMILAR)) + 1


def _tasks(df: DataFrame) -> int:
    return 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


class Sketch:
    """Which shingles were met, which again, and how often again."""

    def __init__(self):
        self.once = np.zeros((1 << SEEN_BITS) // 8, dtype=np.uint8)
        self.twice = np.zeros_like(self.once)
        self.counts = np.zeros(1 << COUNT_BITS, dtype=np.uint8)

    def add(self, codes: np.ndarray) -> None:
        """``codes`` may repeat."""
        if not len(codes):
            return
        slot, met = np.unique((codes >> _SEEN_SHIFT).astype(np.uint32), return_counts=True)
        bit = np.left_shift(1, slot & 7).astype(np.uint8)
        at = slot >> 3
        again = met - ((self.once[at] & bit) == 0)
        coarse = slot >> (SEEN_BITS - COUNT_BITS)
        first = np.flatnonzero(np.append(True, coarse[1:] != coarse[:-1]))
        self.counts[coarse[first]] = np.minimum(self.counts[coarse[first]] + np.add.reduceat(again, first), 255)
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        self.twice[at[first]] |= np.bitwise_or.reduceat(np.where(again > 0, bit, 0).astype(np.uint8), first)
        self.once[at[first]] |= np.bitwise_or.reduceat(bit, first)

    def parts(self) -> list[bytes]:
        cut = (np.split(x, SKETCH_RANGES) for x in (self.once, self.twice, self.counts))
        return [zlib.compress(b"".join(x.tobytes() for x in part), 1) for part in zip(*cut, strict=True)]


def ranks(codes: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """Place of each code in the order: 0 if it was met once, else higher the more often. ``sketch`` has a row per range."""
    slot, coarse = (codes >> _SEEN_SHIFT).astype(np.int64), (codes >> _COUNT_SHIFT).astype(np.int64)
    twice = sketch[slot // (8 * _SEEN_BYTES), (slot >> 3) % _SEEN_BYTES] >> (slot & 7).astype(np.uint8) & 1
    return twice * (sketch[coarse // _COUNT_BYTES, _SEEN_BYTES + coarse % _COUNT_BYTES].astype(np.uint16) + 1)


def _first_pass(batches):
    """One row per document, and the sketch of the task's shingles."""
    sketch = Sketch()
    for batch in batches:
        sizes, keys, met = [], [], [np.zeros(0, dtype=np.uint64)]
        for text in batch.column(1).to_pylist():
            codes = shingle_codes(text)
            sizes.append(len(codes))
            keys.append(set_key(codes) if len(codes) else None)
            met.append(codes)
        sketch.add(np.concatenate(met))
        n = len(sizes)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
            names=["doc_id", "n_shingles", "class", "range", "counts"],
        )
    parts = sketch.parts()
    del sketch
    none = pa.nulls(len(parts), pa.int64())
    yield pa.RecordBatch.from_arrays(
        [none, none, none, pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())],
        names=["doc_id", "n_shingles", "class", "range", "counts"],
    )


def _sum_sketch(key, table):
    """One range over all tasks: whether a shingle was met again, and counts in eighths of a doubling."""
    once, twice = np.zeros((2, _SEEN_BYTES), dtype=np.uint8)
    counts = np.zeros(_COUNT_BYTES, dtype=np.int64)
    for blob in table.column("counts"):
        part = np.frombuffer(zlib.decompress(blob.as_py()), dtype=np.uint8)
        own = part[:_SEEN_BYTES]
        twice |= part[_SEEN_BYTES : 2 * _SEEN_BYTES] | once & own
        once |= own
        counts += part[2 * _SEEN_BYTES :]
    steps = np.minimum(8 * np.log2(1 + counts), 255).astype(np.uint8)
    return pa.table({"range": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([zlib.compress(twice.tobytes() + steps.tobytes(), 1)], pa.binary())})


def _packed(codes: np.ndarray) -> np.ndarray:
    """Codes as six bytes each."""
    return np.ascontiguousarray(codes.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6]


def _unpacked(blob: bytes) -> np.ndarray:
    wide = np.zeros((len(blob) // 6, 8), dtype=np.uint8)
    wide[:, :6] = np.frombuffer(blob, dtype=np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel().astype(np.uint64)


def _spans(owner: np.ndarray) -> list[tuple[int, int]]:
    """From where to where each of the values, which are sorted, goes."""
    cuts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1], [True]])) if len(owner) else []
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _owners(code: np.ndarray, owners: int) -> np.ndarray:
    return (code >> np.uint64(CODE_BITS - 32)) * np.uint64(owners) >> np.uint64(32)


_BUNDLES = "owner long, bundle long, codes binary, places binary, counts binary, classes binary"


def _bundles(sketch, owners: int):
    """Bundles of classes: a row with the classes for the bundle (owner below 0), and one with the even codes and the
    places of their classes for every owner of codes."""

    def dealt(bundle, classes, codes):
        code = np.concatenate(codes)
        place = np.repeat(np.arange(len(codes), dtype="<u2"), list(map(len, codes)))
        owner = _owners(code, owners)
        order = np.lexsort((code, owner))
        code, place, owner = code[order], place[order], owner[order]
        spans = _spans(owner)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([-1 - bundle, *(int(owner[a]) for a, _ in spans)], pa.int64()),
                pa.array([bundle] * (len(spans) + 1), pa.int64()),
                pa.array([None, *(_packed(code[a:b]).tobytes() for a, b in spans)], pa.binary()),
                pa.array([None, *(place[a:b].tobytes() for a, b in spans)], pa.binary()),
                pa.nulls(len(spans) + 1, pa.binary()),
                pa.array([pickle.dumps(classes), *[None] * len(spans)], pa.binary()),
            ],
            names=["owner", "bundle", "codes", "places", "counts", "classes"],
        )

    def run(batches):
        counts = sketch.value
        bundle = TaskContext.get().partitionId() << 32
        classes, codes, held, seen = [], [], 0, set()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                own = shingle_codes(text)
                if not len(own) or (key := set_key(own)) in seen:
                    continue
                seen.add(key)
                even = own & np.uint64(1) == 0
                codes.append(own[even])
                odd, n, evens = own[~even], len(own), len(codes[-1])
                if (more := prefix_length(n) - evens) > 0:
                    odd = odd[np.argsort(ranks(odd, counts), kind="stable")]  # codes ascend
                classes.append((key, n, evens, odd[: max(0, more)].copy()))
                held += evens
                if held >= BUNDLE_CODES or len(codes) >= BUNDLE_CLASSES:
                    yield dealt(bundle, classes, codes)
                    bundle, classes, codes, held, seen = bundle + 1, [], [], 0, set()
        if codes:
            yield dealt(bundle, classes, codes)

    return run


def _met_again(key, table):
    """An owner's codes that several classes of the bundles have, for each bundle, with counts in eighths of a doubling."""
    if key[0].as_py() < 0:
        return table  # a bundle's own row
    parts = [_unpacked(x.as_py()) for x in table.column("codes")]
    code, row = np.concatenate(parts), np.repeat(np.arange(len(parts)), list(map(len, parts)))
    place = np.concatenate([np.frombuffer(x.as_py(), dtype="<u2") for x in table.column("places")])
    del parts
    _, of, met = np.unique(code, return_inverse=True, return_counts=True)
    met = met[of]
    again = np.flatnonzero(met > 1)  # the rows one after the other, as before
    code, row, place = code[again], row[again], place[again]
    steps = np.minimum(8 * np.log2(met[again]), 255).astype(np.uint8)
    spans = _spans(row)
    bundle = table.column("bundle").to_numpy()
    return pa.table(
        [
            pa.array([key[0].as_py()] * len(spans), pa.int64()),
            pa.array([bundle[row[a]] for a, _ in spans], pa.int64()),
            pa.array([_packed(code[a:b]).tobytes() for a, b in spans], pa.binary()),
            pa.array([place[a:b].tobytes() for a, b in spans], pa.binary()),
            pa.array([steps[a:b].tobytes() for a, b in spans], pa.binary()),
            pa.nulls(len(spans), pa.binary()),
        ],
        names=table.column_names,
    )


def ordered_prefixes(n: np.ndarray, evens: np.ndarray, code: np.ndarray, place: np.ndarray, met: np.ndarray):
    """(code, place, whether in the short prefix) of the prefix n-grams that others have too: ``code`` are the even
    codes met again of the classes at ``place``, which have ``n`` codes and ``evens`` even ones."""
    order = np.lexsort((code, met, place))
    code, place = code[order], place[order]
    again = np.bincount(place, minlength=len(n))
    at = np.arange(len(code)) - (np.cumsum(again) - again)[place] + (evens - again)[place]
    kept = at < prefix_length(n)[place]
    return code[kept], place[kept], (at < short_prefix_length(n)[place])[kept]


def _prefixes(owners: int):
    """The prefix n-grams of a bundle with their class, dealt to the owners of n-gram ranges."""

    def run(key, table):
        classes, codes, places, met = [], [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype="<u2")], [np.zeros(0, dtype=np.uint8)]
        for own, code, place, counts in zip(*(table.column(c) for c in ("classes", "codes", "places", "counts")), strict=True):
            if own.is_valid:
                classes = pickle.loads(own.as_py())  # noqa: S301 -- written by our own tasks
            else:
                codes.append(_unpacked(code.as_py()))
                places.append(np.frombuffer(place.as_py(), dtype="<u2"))
                met.append(np.frombuffer(counts.as_py(), dtype=np.uint8))
        names, n, evens = (np.array([c[i] for c in classes], dtype=np.int64) for i in range(3))
        code, place, short = ordered_prefixes(n, evens, *map(np.concatenate, (codes, places, met)))
        odd = [c[3] for c in classes]
        more = np.repeat(np.arange(len(odd)), list(map(len, odd)))
        after = np.concatenate([np.arange(len(x)) for x in odd]) + evens[more] < short_prefix_length(n)[more]
        code, place, short = np.concatenate([code, *odd]), np.concatenate([place, more]), np.concatenate([short, after])
        owner = _owners(code, owners)
        order = np.argsort(owner, kind="stable")
        code, place, short, owner = code[order], place[order], short[order], owner[order]
        name, size = names.astype("<i8")[place], (np.log2(n) * SIZE_STEPS).astype("<u2")[place]
        spans = _spans(owner)
        return pa.table(
            [
                pa.array([int(owner[a]) for a, _ in spans], pa.int32()),
                pa.array([_packed(code[a:b]).tobytes() for a, b in spans], pa.binary()),
                pa.array([name[a:b].tobytes() for a, b in spans], pa.binary()),
                pa.array([size[a:b].tobytes() for a, b in spans], pa.binary()),
                pa.array([np.packbits(short[a:b]).tobytes() for a, b in spans], pa.binary()),
            ],
            names=["owner", "codes", "classes", "sizes", "short"],
        )

    return run


def _edges(key, table):
    """Stars over the classes that share a prefix n-gram and whose sizes allow the similarity."""
    code = np.concatenate([_unpacked(x.as_py()) for x in table.column("codes")])
    name = np.concatenate([np.frombuffer(x.as_py(), dtype="<i8") for x in table.column("classes")])
    sizes = [np.frombuffer(x.as_py(), dtype="<u2") for x in table.column("sizes")]
    short = np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), dtype=np.uint8), count=len(n)) for x, n in zip(table.column("short"), sizes, strict=True)])
    u, v = stars(*pairs_of_neighbours(code, name, np.concatenate(sizes).astype(np.int64), short.astype(bool)))
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def pairs_of_neighbours(code: np.ndarray, name: np.ndarray, size: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every entry with the last one of its code before it, by size, whose short prefix holds the code.

    Of linked classes the smaller one has their first common code in its short prefix. The entries in between
    that are short have sizes in between, so all steps from the one to the other are near.
    """
    order = np.lexsort((name, ~short, size, code))  # a size stands for some; of equal ones the short entries come first
    code, name, size, short = code[order], name[order], size[order], short[order]
    last = np.maximum.accumulate(np.where(short, np.arange(len(code)), -1))[:-1]
    at = np.flatnonzero(last >= 0) + 1
    last = last[at - 1]
    near = size[at] - size[last] <= SIZE_STEPS * np.log2(100 / SIMILAR) + 2  # rounding may only let more through
    joined = near & (code[at] == code[last]) & (name[at] != name[last])
    return name[at[joined]], name[last[joined]]


def _segments(batches):
    """Rows (text, class, block, chunk, chunks) to a class's segments for every tile of its chunk."""
    for batch in batches:
        out = {"tile": [], "fragment": [], "class": [], "side": [], "codes": []}
        for text, name, block, chunk, chunks in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            codes = shingle_codes(text)
            if not len(codes) or set_key(codes) != name:
                continue  # another document of the same id
            cuts = np.searchsorted(codes, np.arange(FRAGMENTS + 1, dtype=np.uint64) << np.uint64(CODE_BITS - FRAGMENT_BITS))
            parts = [_packed(codes[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            for other in range(chunks):
                tile = f"{block}:{min(chunk, other)}:{max(chunk, other)}"
                for fragment, part in enumerate(parts):
                    for column, value in zip(out.values(), (tile, fragment, name, int(chunk > other), part), strict=True):
                        column.append(value)
        if out["tile"]:
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out.values(), kinds, strict=True)], names=list(out))


def overlaps(sets: list[np.ndarray], left: int) -> np.ndarray:
    """Counts of common codes, (left, right): of the first ``left`` sets with the others, or of all
    pairs if there are no others."""
    n = len(sets)
    square = left == n
    counts = np.zeros((n, n) if square else (left, n - left), dtype=np.int64)
    code = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.lexsort((owner, code))
    code, owner = code[order], owner[order]
    starts = np.nonzero(np.concatenate([[True], code[1:] != code[:-1]]))[0] if len(code) else np.zeros(0, dtype=np.int64)
    lengths = np.diff(np.append(starts, len(code)))
    width = counts.shape[1]
    for shared in np.unique(lengths[lengths > 1]):
        begin = starts[lengths == shared]
        if shared <= 16:  # all n-grams of that many sets at once
            of = owner[begin[:, None] + np.arange(shared)]
            for i in range(shared):
                for j in range(i + 1, shared):
                    a, b = of[:, i], of[:, j]
                    if not square:
                        crossing = (a < left) & (b >= left)
                        a, b = a[crossing], b[crossing] - left
                    np.add.at(counts.ravel(), a * width + b, 1)
        else:
            for at in begin:
                of = owner[at : at + shared]
                if square:
                    counts[np.ix_(of, of)] += 1
                else:
                    split = np.searchsorted(of, left)
                    counts[np.ix_(of[:split], of[split:] - left)] += 1
    return counts


def _count(key, table):
    """Partial overlaps of every tile in the group, for one fragment."""
    tiles: dict[str, list] = {}
    for tile, name, side, codes in zip(*(table.column(c).to_pylist() for c in ("tile", "class", "side", "codes")), strict=True):
        tiles.setdefault(tile, {})[name] = (side, name, _unpacked(codes))
    out = {"tile": [], "classes": [], "left": [], "sizes": [], "counts": []}
    for tile, members in tiles.items():
        rows = sorted(members.values(), key=lambda r: r[:2])
        _, i, j = tile.rsplit(":", 2)
        left = len(rows) if i == j else sum(r[0] == 0 for r in rows)
        if left == len(rows) and i != j:
            continue
        counted = overlaps([r[2] for r in rows], left)
        out["tile"].append(tile)
        out["classes"].append(np.array([r[1] for r in rows], dtype="<i8").tobytes())
        out["left"].append(left)
        out["sizes"].append(np.array([len(r[2]) for r in rows], dtype="<i8").tobytes())
        out["counts"].append(zlib.compress(counted.astype("<u4").tobytes(), 1))
    kinds = (pa.string(), pa.binary(), pa.int32(), pa.binary(), pa.binary())
    return pa.table([pa.array(c, k) for c, k in zip(out.values(), kinds, strict=True)], names=list(out))


def _verify(key, table):
    """Sum the partial counts per pair, compare with the sizes, pass on stars over what the links join."""
    parts: dict[str, list[int]] = {}
    for i, tile in enumerate(table.column("tile").to_pylist()):
        parts.setdefault(tile, []).append(i)
    found = [np.zeros((0, 2), dtype=np.int64)]
    for own in parts.values():  # one after the other: a tile's pairs may be a million
        classes = np.frombuffer(table.column("classes")[own[0]].as_py(), dtype="<i8")
        left, n = table.column("left")[own[0]].as_py(), len(classes)
        square = left == n
        sizes, counts = np.zeros(n, dtype=np.int64), np.zeros((left, n if square else n - left), dtype=np.int64)
        for i in own:
            sizes += np.frombuffer(table.column("sizes")[i].as_py(), dtype="<i8")
            counts += np.frombuffer(zlib.decompress(table.column("counts")[i].as_py()), dtype="<u4").reshape(counts.shape)
        a, b = np.nonzero(counts)
        shift = 0 if square else left
        common = counts[a, b]
        linked = (a < b + shift) & (100 * common >= SIMILAR * (sizes[a] + sizes[b + shift] - common))
        links = np.stack([a[linked], b[linked] + shift], axis=1)
        least = least_reached(links, n)
        hung = np.nonzero(least != np.arange(n))[0]
        found.append(classes[np.stack([hung, least[hung]], axis=1)])
    both = np.concatenate(found)
    return pa.table({"u": pa.array(both[:, 0], pa.int64()), "v": pa.array(both[:, 1], pa.int64())})


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    ship(spark)
    tasks = _tasks(docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    first = written(arrow_map(texts, _first_pass, "doc_id long, n_shingles long, class long, range int, counts binary"), "jaccard-sets")
    rows = first.filter("range IS NULL").select("doc_id", "n_shingles", "class")
    parts = first.filter("range IS NOT NULL").select("range", "counts").groupBy("range").applyInArrow(_sum_sketch, "range int, counts binary")
    sketch = np.zeros((SKETCH_RANGES, _SEEN_BYTES + _COUNT_BYTES), dtype=np.uint8)
    for r in parts.collect():  # in one job; at most the sketch, compressed
        sketch[r["range"]] = np.frombuffer(zlib.decompress(r["counts"]), dtype=np.uint8)
    shared = spark.sparkContext.broadcast(sketch)
    del sketch

    owners = max(tasks, -(-(rows.agg(F.sum("n_shingles")).first()[0] or 0) // GROUP_CODES))
    bundles = arrow_map(texts.filter("doc_id IS NOT NULL").select("text"), _bundles(shared, owners), _BUNDLES)
    again = bundles.groupBy("owner").applyInArrow(_met_again, _BUNDLES)
    prefixes = again.groupBy("bundle").applyInArrow(_prefixes(owners), "owner int, codes binary, classes binary, sizes binary, short binary")
    edges = prefixes.groupBy("owner").applyInArrow(_edges, "u long, v long")
    blocks = written(components(edges), "jaccard-blocks")
    shared.destroy()  # nothing reads the prefixes again

    classes = rows.filter("doc_id IS NOT NULL AND n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("least_id"), F.max("n_shingles").alias("codes"))
    sizes = blocks.groupBy("component").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    placed = blocks.join(sizes, "component").select(
        F.col("node").alias("class"), F.col("component").alias("block"), F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk"), "chunks"
    )
    placed = written(placed.join(classes, "class").withColumnRenamed("least_id", "doc_id"), "jaccard-places")
    size = placed.agg(F.count("*").alias("classes"), F.sum(F.col("codes") * F.col("chunks")).alias("codes")).first()
    few = size["classes"] <= BROADCAST_CLASSES  # else all texts are shuffled for the few that are in blocks
    members = texts.join(F.broadcast(placed) if few else placed, "doc_id").select("text", "class", "block", "chunk", "chunks")
    segments = arrow_map(members, _segments, "tile string, fragment int, class long, side int, codes binary")
    # what tiles hold grows faster than the texts, so groups of tiles are cut by that
    bins = F.pmod(F.xxhash64("tile"), F.lit(max(tasks, -(-(size["codes"] or 0) // GROUP_CODES))))
    counted = segments.withColumn("bin", bins).groupBy("bin", "fragment").applyInArrow(_count, "tile string, classes binary, left int, sizes binary, counts binary")
    links = counted.withColumn("bin", bins).groupBy("bin").applyInArrow(_verify, "u long, v long")
    linked = components(links)

    known = classes.drop("codes").join(linked.withColumnRenamed("node", "class"), "class", "left")
    known = known.withColumn("component", F.coalesce("component", "class"))
    least = known.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = known.join(least, "component").select(F.col("class").alias("_class"), "component_id")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = rows.join(named, rows["class"] == F.col("_class"), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each component (its least doc_id), with all
    columns.

    Rows that share a doc_id are one document and stay together if any of them stays; rows without a
    doc_id, and texts without words, link with nothing and stay. Rows travel as one struct, whatever
    their columns are called.
    """
    stays = near_duplicates(docs).filter("component_id IS NULL OR doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    rows = docs.select(whole_row(docs).alias("row"), F.col("doc_id").cast("long").alias("id"))
    return unfolded(rows.join(stays, F.col("id").eqNullSafe(F.col("kept_id")), "left_semi"), docs.columns)


ORACLE = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS gram
    FROM words, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id
    GROUP BY 1, 2),
links AS (
    SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(min(b), d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id, n
"""
