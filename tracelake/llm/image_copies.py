"""Copies of images, cropped or edited, by local descriptors.

Corners are found by the Harris measure at scales half an octave apart, so many for each tile of the picture and as many
scales as its size allows; each is turned by the direction of its patch's centroid and described by BITS binary tests
between smoothed points. Descriptors are cut into TABLES pieces: two descriptors up to DISTANCE = 2 * TABLES - 1 bits apart
differ in at most one bit of one piece at least, so an equi-join of (table, piece) with the pieces of the query and their
neighbours one bit away meets every such pair, and the bits then decide (Hamming tables). Each pair of corners proposes a
change of scale, a turn and a shift between the pictures' centres; the proposals of two pictures vote in a grid of bins of
these four, laid twice over each dimension, half a bin apart, and two images match if a bin
holds INLIERS corners of the query, or FEW that are most of those that met any (geometric consensus). Votes are counts by bin, however many proposals there are.

Images are bytes of luma, row by row, with their width and height. The operator is a search: images named as queries
against all images. Queries are few, so they are described at twice as many scales, a quarter of an octave apart, and every
size of a copy is within an eighth of an octave of one of them. The tables of up to QUERY_DESCRIPTORS descriptors, by a count, go
to all tasks, and every image is looked up and put to the vote where it is described; more queries are dealt into groups of
about so many, one pass over the images for each. Neither images nor their descriptors are shuffled or written: only the
queries' descriptors are, once, and hashes. Byte-equal images form a class and are compared once, by their smallest id. Only
where more than BROADCAST_ROWS images are copies, and as many are not, is what images are made from shuffled once, to tell them
apart (images themselves if ids repeat, of which queries are shuffled in any case). A task needs about 100 bytes of memory for
each pixel of its largest image, and 200 for each descriptor of a group.

Defined results: null images, images whose bytes don't fit width and height, and images of fewer than LEAST pixels a
side or without corners have no descriptors; they are members of their class and match nothing. Ids that repeat with
other bytes are told apart by their class. Rows of a null id are left out. Other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm._common import BROADCAST_ROWS, cut, held, table

BITS, TABLES = 192, 8
#: Corners in one bin that make a match: so many, or fewer if they are so large a share of the query's corners that met any.
INLIERS, FEW, SHARE = 8, 4, 0.8
DISTANCE = 2 * TABLES - 1
#: Corners of each tile at most, and its side in pixels of the scale.
CORNERS, TILE = 8, 40
#: Bins are so many quarter octaves, degrees, and pixels or shares of the picture's longer side wide.
SCALE, TURN, SHIFT, SPREAD = 4, 40, 12, 0.16
PATCH, LEAST = 9, 24
#: Descriptors of queries whose tables are sent to all tasks at once: about 33 bytes each, and 200 in a task.
QUERY_DESCRIPTORS = 1_000_000
#: Pairs of descriptors that are compared at once, and pairs that met, of one image or more, that are looked through at once.
COMPARED, LOOKED = 1 << 17, 1 << 21
_PIECE = BITS // TABLES
_rng = np.random.default_rng(20)
#: Pairs of points of the tests (x, y), normal around the corner, PATCH pixels away at most.
_PAIRS = _rng.normal(0, PATCH / 2.2, (BITS, 2, 2)).astype(np.float32)
_PAIRS *= np.minimum(1, PATCH / np.linalg.norm(_PAIRS, axis=2, keepdims=True))
_SPAN = np.arange(-PATCH, PATCH + 1)
_DISC = (_SPAN[:, None] ** 2 + _SPAN**2 <= PATCH**2).astype(np.float32)


def _smooth(x: np.ndarray) -> np.ndarray:
    """Binomial filter over the last two axes."""
    for axis in (1, 2):
        pad = np.pad(x, [(0, 0)] + [(1, 1) if a == axis else (0, 0) for a in (1, 2)], mode="edge")
        n = x.shape[axis]
        x = (np.take(pad, range(n), axis) + 2 * x + np.take(pad, range(2, n + 2), axis)) / 4
    return x


def _resized(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear samples at the centres of a coarser grid."""
    for axis, n in ((1, height), (2, width)):
        at = ((np.arange(n) + 0.5) * x.shape[axis] / n - 0.5).clip(0, x.shape[axis] - 1)
        low = np.minimum(at.astype(np.int64), x.shape[axis] - 2)
        part = (at - low).astype(np.float32).reshape([-1 if a == axis else 1 for a in range(3)])
        x = np.take(x, low, axis) * (1 - part) + np.take(x, low + 1, axis) * part
    return x


def _corners(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(image, row, column) of local maxima of the Harris measure: of each tile of an image the CORNERS strongest."""
    gy, gx = np.gradient(x, axis=(1, 2))
    a, b, c = _smooth(gx * gx), _smooth(gy * gy), _smooth(gx * gy)
    r = np.round(a * b - c * c - 0.05 * (a + b) ** 2, 3)
    n, h, w = r.shape
    peak = r > 1.0
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            if dy or dx:
                near = np.pad(r, [(0, 0), (1, 1), (1, 1)])[:, 1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
                peak &= (r > near) | (r == near) & ((dy, dx) > (0, 0))
    edge = PATCH + 1
    peak[:, :edge] = peak[:, h - edge :] = peak[:, :, :edge] = peak[:, :, w - edge :] = False
    image, row, col = np.nonzero(peak)
    tile = (image * (h // TILE + 1) + row // TILE) * (w // TILE + 1) + col // TILE
    order = np.lexsort((col, row, -r[image, row, col], tile))
    first = np.flatnonzero(np.concatenate([[True], np.diff(tile[order]) > 0])) if len(order) else np.zeros(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    keep = np.sort(order[rank < CORNERS])
    return image[keep], row[keep], col[keep]


def _tests(x: np.ndarray, image: np.ndarray, row: np.ndarray, col: np.ndarray, angle: np.ndarray) -> np.ndarray:
    """The binary tests of each corner, at points turned by its angle, between pixels."""
    c, s = (f(angle).astype(np.float32)[:, None, None] for f in (np.cos, np.sin))
    px, py = _PAIRS[..., 0], _PAIRS[..., 1]
    at_x, at_y = px * c - py * s + col[:, None, None].astype(np.float32), px * s + py * c + row[:, None, None].astype(np.float32)
    x0, y0 = at_x.astype(np.int64), at_y.astype(np.int64)
    fx, fy = at_x - x0, at_y - y0
    flat, wide = x.reshape(-1), x.shape[2]
    first = (image[:, None, None] * x.shape[1] + y0) * wide + x0
    upper = flat[first] * (1 - fx) + flat[first + 1] * fx
    lower = flat[first + wide] * (1 - fx) + flat[first + wide + 1] * fx
    value = upper * (1 - fy) + lower * fy
    return value[..., 0] + 1e-3 < value[..., 1]


def _pyramid(x: np.ndarray, height: int, width: int, first: int) -> list[tuple[np.ndarray, ...]]:
    """Corners of x and of ever coarser copies, half an octave apart; places are those of a picture of (height, width), and
    levels count quarter octaves from `first`."""
    found, level = [], 0
    size = x.shape[1:]
    while min(x.shape[1:]) >= LEAST:
        soft = _smooth(x)
        image, row, col = _corners(soft)
        patch = soft[image[:, None, None], row[:, None, None] + _SPAN[:, None], col[:, None, None] + _SPAN] * _DISC
        angle = np.arctan2((patch * _SPAN[:, None]).sum((1, 2)), (patch * _SPAN).sum((1, 2)))
        bits = _tests(_smooth(soft), image, row, col, angle)
        centred = lambda at, size, full: (at + 0.5 - size / 2) * full / size
        found.append((image, centred(col, x.shape[2], width), centred(row, x.shape[1], height), np.full(len(image), first + 2 * level), np.degrees(angle), bits))
        level += 1
        x = _resized(soft, round(size[0] / 2 ** (level / 2)), round(size[1] / 2 ** (level / 2)))
    return found


def described(images: np.ndarray, between: bool = False) -> tuple[np.ndarray, ...]:
    """(image, x, y, level, angle in degrees, bits) of equally large images; x and y from the picture's centre. `between` adds
    the scales between those of the pyramid, as a pyramid of the images a quarter of an octave smaller."""
    x = images.astype(np.float32)
    height, width = x.shape[1:]
    found = _pyramid(x, height, width, 0)
    if between:
        found += _pyramid(_resized(x, round(height / 2**0.25), round(width / 2**0.25)), height, width, 1)
    if not found:
        return (np.zeros(0),) * 5 + (np.zeros((0, BITS), bool),)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def packed(bits: np.ndarray) -> list[np.ndarray]:
    """Rows of bits as numbers of two pieces each."""
    weight = np.int64(1) << np.arange(2 * _PIECE)
    return [(bits[:, k : k + 2 * _PIECE] * weight).sum(1) for k in range(0, BITS, 2 * _PIECE)]


_WORDS = [f"b{i}" for i in range(TABLES // 2)]
_PLACE = ["id", "corner", "side", "x", "y", "level", "angle"]
_KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.float32(), pa.float32(), pa.int32(), pa.float32()]
_COLUMNS = "id long, corner int, side int, x float, y float, level int, angle float, " + ", ".join(f"{b} long" for b in _WORDS)
#: Pixels of the pictures of one size that are described together.
BATCH_PIXELS = 250_000


def _of_batch(batch: pa.RecordBatch, between: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """(id, corner, side, x, y, level, angle, words...) of the images (id, width, height, pixels) of a batch."""
    groups: dict[tuple[int, int], list[int]] = {}
    w, h, ids = (batch.column(i).to_pylist() for i in (1, 2, 0))
    for i in range(batch.num_rows):
        if w[i] and h[i] and min(w[i], h[i]) >= LEAST:
            groups.setdefault((h[i], w[i]), []).append(i)
    for size, own in groups.items():
        step = max(1, BATCH_PIXELS // (size[0] * size[1]))
        for start in range(0, len(own), step):
            read = [(ids[i], batch.column(3)[i].as_buffer()) for i in own[start : start + step] if batch.column(3)[i].is_valid]
            part = [(i, p) for i, p in read if len(p) == size[0] * size[1]]
            if not part:
                continue
            image, x, y, level, angle, bits = described(np.stack([np.frombuffer(p, np.uint8).reshape(size) for _, p in part]), between)
            own_ids = np.array([i for i, _ in part], np.int64)[image.astype(np.int64)]
            columns = [own_ids, np.arange(len(own_ids)), np.full(len(own_ids), max(size)), x, y, level, angle]
            yield tuple(c.astype(k.to_pandas_dtype()) for c, k in zip(columns, _KINDS, strict=True)) + tuple(packed(bits))


def _bare(images: DataFrame) -> DataFrame:
    return images.select(F.col("id").cast("long"), F.col("width").cast("int"), F.col("height").cast("int"), "pixels").where(F.col("id").isNotNull())


def descriptors(images: DataFrame, between: bool = False) -> DataFrame:
    """(id, corner, side, x, y, level, angle, b0, ...) of images (id, width, height, pixels); `between` as in described()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("image_copies", dict)  # lets go of what other operators kept
        for batch in batches:
            for columns in _of_batch(batch, between):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [*_PLACE, *_WORDS])

    return _bare(images).mapInArrow(run, _COLUMNS)


def _near_bits(bitmap: np.ndarray) -> np.ndarray:
    """The bitmap (lowest bit first) of the numbers in a bitmap and of all that differ from one in one bit."""
    near = bitmap.copy()
    for k, low in enumerate((0x55, 0x33, 0x0F)):
        near |= (bitmap & low) << (1 << k) | bitmap >> (1 << k) & low
    for k in range(_PIECE - 3):
        near.reshape(-1, 2, 1 << k)[:] |= bitmap.reshape(-1, 2, 1 << k)[:, ::-1]
    return near


def _found(bitmap: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the numbers are in the bitmap, and for each of these how many smaller ones are in its 64 bits."""
    word, bit = bitmap.view(np.uint64)[numbers >> 6], (numbers & 63).astype(np.uint64)
    known = np.flatnonzero(word >> bit & np.uint64(1))
    return known, np.bitwise_count(word[known] & ((np.uint64(1) << bit[known]) - np.uint64(1)))


def _runs(counts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(start, end) of runs whose counts sum to `most`, or of single ones that are larger."""
    ends, start = np.cumsum(counts), 0
    while start < len(counts):
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield start, end
        start = end


class Tables:
    """The Hamming tables of some queries' descriptors: descriptors in the order of their pieces, bitmaps of the pieces and of
    their neighbours, and where the descriptors of each piece start."""

    def __init__(self, columns: tuple[np.ndarray, ...]):
        self.ids, _, _, self.x, self.y, self.level, self.angle = columns[: len(_PLACE)]
        self.words = np.stack(columns[len(_PLACE) :], 1) if len(self.ids) else np.zeros((0, TABLES // 2), np.int64)
        self.flips = np.concatenate([[0], 1 << np.arange(_PIECE)]).astype(np.int32)
        self.bitmaps, self.near, self.before, self.starts = [], [], [], []
        self.order = np.zeros(TABLES * len(self.ids), np.int32)
        for t, p in enumerate(self.pieces(self.words)):
            order = np.argsort(p, kind="stable")
            self.order[t * len(p) : (t + 1) * len(p)] = order
            own = p[order]
            first = np.flatnonzero(own[1:] != own[:-1]) + 1
            self.starts.append((np.concatenate([[0], first, [len(p)]]) + t * len(p)).astype(np.int32))
            known = np.zeros(1 << _PIECE, bool)
            known[p] = True
            self.bitmaps.append(np.packbits(known, bitorder="little"))
            self.near.append(_near_bits(self.bitmaps[-1]))
            smaller = np.cumsum(np.bitwise_count(self.bitmaps[-1].view(np.uint64)), dtype=np.int32)
            self.before.append(np.concatenate([np.zeros(1, np.int32), smaller[:-1]]))

    @staticmethod
    def pieces(words: np.ndarray) -> list[np.ndarray]:
        mask = (1 << _PIECE) - 1
        return [(words[:, t // 2] >> (t % 2 * _PIECE) & mask).astype(np.int32) for t in range(TABLES)]

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(own descriptor, first place in self.order, number of places) of all pieces that agree with one of own but for a bit."""
        found = []
        for p, bitmap, near, before, starts in zip(self.pieces(words), self.bitmaps, self.near, self.before, self.starts, strict=True):
            own = _found(near, p)[0]
            probes = (p[own, None] ^ self.flips).ravel()
            known, rank = _found(bitmap, probes)
            rank = rank + before[probes[known] >> 6]
            low = starts[rank]
            found.append((own[known // len(self.flips)], low, starts[rank + 1] - low))
        own, low, count = (np.concatenate(c) for c in zip(*found, strict=True))
        return own, low, count

    def compared(self, words: np.ndarray, own: np.ndarray, low: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query's descriptor, own descriptor) of the pairs of such hits up to DISTANCE bits apart, each once."""
        kept = [np.zeros(0, np.int64)]
        for start, end in _runs(count, COMPARED):
            n = count[start:end]
            at = np.arange(n.sum()) + np.repeat(low[start:end] - (np.cumsum(n) - n), n)
            query, mine = self.order.take(at), np.repeat(own[start:end], n)
            apart = np.bitwise_count(self.words.take(query, 0) ^ words.take(mine, 0))
            good = np.flatnonzero(apart.view(np.uint32)[:, 0] * np.uint32(0x01010101) >> 24 <= DISTANCE)  # the sum of four bytes
            kept.append(query[good].astype(np.int64) * len(words) + mine[good])
        pairs = np.unique(np.concatenate(kept))
        return pairs // max(1, len(words)), pairs % max(1, len(words))

    def met(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query's descriptor, own descriptor) of all pairs up to DISTANCE bits apart, each once."""
        return self.compared(words, *self.hits(words))

    def agreed(self, ids: np.ndarray, side: np.ndarray, x: np.ndarray, y: np.ndarray, level: np.ndarray, angle: np.ndarray, words: np.ndarray) -> list[tuple[int, int, int]]:
        """(query, image, inliers) of the images whose descriptors these are, few images at a time if very many pairs meet."""
        own, low, count = self.hits(words)
        known, image = np.unique(ids, return_inverse=True)
        order = np.argsort(image[own], kind="stable")
        each = np.bincount(image[own], minlength=len(known))
        ends, found = np.cumsum(each), []
        for start, end in _runs(np.bincount(image[own], count, len(known)).astype(np.int64), LOOKED):
            part = order[ends[start] - each[start] : ends[end - 1]]
            q, n = self.compared(words, own[part], low[part], count[part])
            other = self.ids[q] != ids[n]
            found += self.voted(q[other], n[other], ids, side, x, y, level, angle) if other.any() else []
        return found

    def voted(self, q: np.ndarray, n: np.ndarray, ids: np.ndarray, side: np.ndarray, x: np.ndarray, y: np.ndarray, level: np.ndarray, angle: np.ndarray) -> list[tuple[int, int, int]]:
        """(query, image, inliers) by the votes of pairs of descriptors."""
        (queries, which), (images, image) = np.unique(self.ids[q], return_inverse=True), np.unique(ids[n], return_inverse=True)
        pair, which = np.unique(which * len(images) + image, return_inverse=True)
        known = np.bincount(np.unique(which * len(self.ids) + q) // len(self.ids), minlength=len(pair))
        if not (enough := known[which] >= FEW).all():  # fewer can't make a match
            return self.voted(q[enough], n[enough], ids, side, x, y, level, angle) if enough.any() else []
        turn = (angle[n].astype(float) - self.angle[q]) % 360
        step = level[n] - self.level[q]
        scale, (c, s) = 2.0 ** (step / 4), (f(np.radians(turn)) for f in (np.cos, np.sin))
        qx, qy = self.x[q].astype(float), self.y[q].astype(float)
        room = np.maximum(SHIFT, side[n] * SPREAD)
        dims = [(step, float(SCALE), 0), (turn, float(TURN), 360 // TURN), (x[n] - scale * (c * qx - s * qy), room, 0), (y[n] - scale * (s * qx + c * qy), room, 0)]
        cells = [[(np.floor(v / wide + h / 2) % around if around else np.floor(v / wide + h / 2)).astype(np.int64) for h in (0, 1)] for v, wide, around in dims]
        most = np.zeros(len(pair), np.int64)
        for grid in itertools.product((0, 1), repeat=len(dims)):
            votes = np.unique(np.stack([which, *(cells[k][h] for k, h in enumerate(grid)), q]), axis=1)[:-1]
            bins, count = np.unique(votes, axis=1, return_counts=True)
            np.maximum.at(most, bins[0], count)
        good = (most >= INLIERS) | (most >= FEW) & (most >= SHARE * known)
        return list(zip(queries[pair[good] // len(images)].tolist(), images[pair[good] % len(images)].tolist(), most[good].tolist(), strict=True))


def _sent(asked: DataFrame) -> Broadcast[bytes]:
    """Descriptors of queries, about as many as QUERY_DESCRIPTORS, for all tasks: a packed Arrow stream, some 33 bytes each."""
    rows, sink = asked.select(*_PLACE, *_WORDS).drop("corner", "side").toArrow(), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_table(rows)
    return asked.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())


def searched(images: DataFrame, sent: Broadcast[bytes]) -> DataFrame:
    """(q_id, id, inliers): all images looked up, as they are described, in the Hamming tables of the queries' descriptors."""
    key = f"image_copies {uuid.uuid4().hex}"

    def tables_of_queries() -> Tables:
        rows = pa.ipc.open_stream(sent.value).read_all()
        return Tables(tuple(rows.column(c).to_numpy() if c in rows.column_names else None for c in (*_PLACE, *_WORDS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = held(key, tables_of_queries)
        for batch in batches:
            for ids, _, side, x, y, level, angle, *words in _of_batch(batch, False):
                found = tables.agreed(ids, side, x, y, level, angle, np.stack(words, 1)) if len(ids) else []
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["q_id", "id", "inliers"])

    return _bare(images).mapInArrow(run, "q_id long, id long, inliers long")


def searched_in_groups(images: DataFrame, asked: DataFrame) -> DataFrame:
    """searched() for any number of queries' descriptors: queries are dealt into groups of about QUERY_DESCRIPTORS by a hash
    of their ids, and the images are passed over once for each."""
    groups = math.ceil(asked.count() / max(1, QUERY_DESCRIPTORS))
    groups = min(groups, asked.select("id").distinct().count()) if groups > 1 else groups
    if groups <= 1:
        return searched(images, _sent(asked))
    parts = []
    for group in range(groups):
        sent = _sent(asked.where(F.pmod(F.xxhash64("id"), F.lit(groups)) == group))
        parts.append(cut(searched(images, sent)))
        sent.destroy()
    return functools.reduce(DataFrame.unionByName, parts)


def _pieces(words: list[str]) -> list[Column]:
    mask = (1 << _PIECE) - 1
    return [F.shiftrightunsigned(F.col(b), k * _PIECE).bitwiseAND(mask).cast("int") for b in words for k in (0, 1)]


def _keys(words: list[str]) -> Column:
    """The pieces of a descriptor, each with its table."""
    return F.array(*[p + F.lit(t << _PIECE) for t, p in enumerate(_pieces(words))])


def _probes(words: list[str]) -> Column:
    """The pieces of a descriptor and all that differ from one in one bit, each with its table."""
    flips = F.array(F.lit(0), *[F.lit(1 << k) for k in range(_PIECE)])

    def around(piece: Column, number: int) -> Column:
        return F.transform(flips, lambda flip: piece.bitwiseXOR(flip) + F.lit(number << _PIECE))

    return F.flatten(F.array(*[around(p, t) for t, p in enumerate(_pieces(words))]))


def near(made: DataFrame, asked: DataFrame) -> DataFrame:
    """The pairs of a descriptor of `made` and one of `asked` (columns q_...), of different images, that are up to DISTANCE
    bits apart: all of them, each once, as a join of tables. Keys and names go through the join of pieces; the bits are
    fetched for what met. What meets is many times what is near, and all of it is shuffled: copies() looks up instead."""
    own = [f"q_{b}" for b in _WORDS]
    asked = asked.select(*[F.col(c).alias(f"q_{c}") for c in ("id", "corner", *_WORDS)])
    listed = made.select("id", "corner", F.explode(_keys(_WORDS)).alias("key"))
    met = listed.join(asked.select("q_id", "q_corner", F.explode(_probes(own)).alias("key")), "key")
    met = met.join(asked, ["q_id", "q_corner"]).join(made, ["id", "corner"])
    differ = [F.col(b).bitwiseXOR(F.col(f"q_{b}")) for b in _WORDS]
    apart = sum((F.bit_count(d) for d in differ), F.lit(0))
    # a pair that meets in several tables counts in the first
    parts = [F.shiftrightunsigned(d, k * _PIECE).bitwiseAND((1 << _PIECE) - 1) for d in differ for k in (0, 1)]
    first = F.coalesce(*[F.when(F.bit_count(p) <= 1, F.lit(t)) for t, p in enumerate(parts)])
    return met.where((F.col("id") != F.col("q_id")) & (apart <= DISTANCE) & (F.shiftright("key", _PIECE) == first)).drop("key", *own)


def _standing(images: DataFrame, rows: DataFrame, on: list[str], others: DataFrame | None = None) -> DataFrame:
    """The images whose `on` stands in rows; others: the ones that don't. Whichever are few, by a count, go to all tasks, and no
    image is moved; if neither are, images are shuffled."""
    few = lambda df: df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    if others is not None and few(others):
        return images.join(F.broadcast(others), on, "left_anti")
    return images.join(F.broadcast(rows) if few(rows) else rows.hint("shuffle_hash"), on, "left_semi")


def copies(images: DataFrame, is_query: Column, made: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """(kind, id, other, inliers). kind `member`: image id belongs to the class other; kind `match`: the class id holds a
    query and matches the class other, with so many agreeing corners.

    made: gives the images (id, width, height, pixels) of rows that have an id each, the same whatever rows stand beside. Rows
    are told apart before it where ids don't repeat, so that where any are shuffled, it is what images are made from."""
    images = images.withColumn("id", F.col("id").cast("long")).where(F.col("id").isNotNull())
    hashed = [F.xxhash64("width", "height", "pixels").alias("h1"), F.xxhash64(F.lit(1), "pixels", "height").alias("h2")]
    keyed = cut(made(images).select("id", is_query.alias("asked"), *hashed))
    classes = cut(keyed.groupBy("h1", "h2").agg(F.min("id").alias("class_id"), F.max("asked").alias("asked")))
    members = cut(keyed.select("id", "h1", "h2").join(classes.drop("asked"), ["h1", "h2"]).select(F.lit("member").alias("kind"), "id", F.col("class_id").alias("other"), F.lit(0).cast("long").alias("inliers")))
    asked = classes.where("asked").drop("asked")
    repeated = keyed.groupBy("id").count().where("count > 1").limit(1).count()
    if repeated:
        # the smallest id of a class may stand on several rows, of which some have other bytes
        on, known = ["id", "h1", "h2"], made(images).select("id", "width", "height", "pixels", *hashed)
        heads = _standing(known, classes.select(F.col("class_id").alias("id"), "h1", "h2"), on)
        queries = _standing(known, asked.withColumnRenamed("class_id", "id"), on).dropDuplicates(["h1", "h2"])
    else:
        heads = made(_standing(images, classes.select(F.col("class_id").alias("id")), ["id"], members.where("id != other").select("id")))
        queries = made(_standing(images, asked.select(F.col("class_id").alias("id")), ["id"]))
    matched = searched_in_groups(heads, cut(descriptors(queries, between=True)))
    matched = matched.distinct() if repeated else matched
    return members.unionByName(matched.select(F.lit("match").alias("kind"), F.col("q_id").alias("id"), F.col("id").alias("other"), "inliers"))


#: Side of the pictures that vectors are drawn as, and the strength of a component.
SIDE, CONTRAST = 80, 60


def _summed(weights: np.ndarray, textures: np.ndarray) -> np.ndarray:
    """weights @ textures, one component after the other: the rounding of a row, and so the picture of a vector, doesn't depend
    on the rows beside it, as that of a matrix product does."""
    total = np.zeros((len(weights), textures.shape[1]), np.float32)
    for own, texture in zip(weights.T, textures, strict=True):
        total += own[:, None] * texture
    return total


def drawn(vectors: DataFrame) -> DataFrame:
    """(id, width, height, pixels): a picture of each vector (vec_id, embedding), as the sum of one texture for each component.
    Vectors that nearly agree give pictures that nearly agree, as edited copies do.

    The tables of this project hold no media; this gives the vectors of `embeddings` a picture each.
    """

    def textures(n: int) -> np.ndarray:
        noise = np.random.default_rng(n).normal(0, 1, (n, SIDE, SIDE)).astype(np.float32)
        for _ in range(3):
            noise = _smooth(noise)
        return (noise / noise.std() * CONTRAST).reshape(n, -1)

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = held("drawn", dict)
        for vectors in arrays:
            made: list[bytes | None] = []
            for start in range(0, len(vectors), 500):
                part = vectors.slice(start, 500).to_pylist()
                made += [None] * len(part)
                for n in {len(v) for v in part if v}:
                    own = [i for i, v in enumerate(part) if v and len(v) == n and None not in v]
                    if n not in known:
                        known[n] = textures(n)
                    for few in (own[k : k + 16] for k in range(0, len(own), 16)):
                        pixels = (_summed(np.array([part[i] for i in few], np.float32), known[n]) + 128).clip(0, 255).astype(np.uint8)
                        for i, p in zip(few, pixels, strict=True):
                            made[start + i] = p.tobytes()
            yield pa.array(made, pa.binary())

    run.__annotations__ = {"arrays": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return vectors.select(F.col("vec_id").alias("id"), F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"), F.arrow_udf(run, "binary")("embedding").alias("pixels"))


def op6_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's picture against those whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    return copies(vectors, F.col("id") % 50 == 0, lambda rows: drawn(rows.withColumnRenamed("id", "vec_id")))
