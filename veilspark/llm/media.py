"""Operator 7, copies of images by local descriptors.

Images (binary PGM, PPM or 8-bit PNG) are read as grey pictures and shrunk to several scales. Corners are all local
maxima of the structure tensor's smaller eigenvalue within SPACING, so their number grows with the picture's area; each
corner is turned to the direction of its intensity centroid and described by TESTS binary comparisons of turned point
pairs.
Search: images with equal bytes are one class. Queries are the classes with a member whose id is divisible by 100. The
TESTS bits are cut into words of WORD bits, whatever the table's size; descriptors meet if a word is equal at the same
place, and count if they differ in at most NEAR bits. Words of 24 bits find all pairs within 9 bits and most within NEAR; the
tests measure recall against all pairs of descriptors. The queries' words go to the corners of all images, which are
described as they stream by and never stored, as long as a count shows the words small enough to broadcast; else both
sides are shuffled by word, each word dealt over SALTS tasks by the corner's place, so that a word of many flat patches
is no single task. A corner meets about 1 in 2 ** WORD of the queries' words for each of its own.
Each match votes for a rotation, scale and shift; images with at least VOTES matches that agree are copies, cropped or
edited.

Output rows: ``member`` (a: image, b: its class, i.e. the smallest id with the same bytes) and ``copy`` (a: class of a
query, b: class of a copy of it, votes). Copies of one class are not expanded into pairs.

Edge cases: null, empty or unreadable media are classes of their own kind without descriptors (null and empty together);
images without corners have none; repeated rows stay members; rows of one id with different bytes are members of
different classes; a null id is a member with a null id and names no class unless it is alone in it; an empty table gives
no rows; other columns are dropped.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, staged, table

TESTS, NEAR, VOTES = 256, 16, 4
WORD = 24  # bits
BROADCAST_ROWS = 1_000_000  # of 72 bytes: 72 MB; beyond it the joins shuffle
SALTS = 4
SCALES, EDGE, RADIUS, SPACING = (1.0, 0.84, 0.71, 0.59, 0.5), 9, 7, 2
# A corner is turned so that its brighter side lies along x; points far apart in x would give the same bit at most corners
# (measured: 24 bits or fewer apart 0.8 in 1000 random pairs), so the two points of a test stand about above each other (0.9 in a million).
_PAIRS = np.random.default_rng(20).normal(0, 4.0, (TESTS, 4))
_PAIRS[:, 2] = _PAIRS[:, 0] + np.random.default_rng(21).normal(0, 2.0, TESTS)
_PAIRS = _PAIRS.clip(-6.4, 6.4)


def read_image(raw: bytes | None) -> np.ndarray | None:
    """Grey values as floats, or None if the bytes are no image that is read here."""
    try:
        if not raw:
            return None
        if raw[:2] in (b"P5", b"P6"):
            m = re.match(rb"P[56]\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+255\s", raw)
            w, h, depth = int(m[1]), int(m[2]), 3 if raw[1:2] == b"6" else 1
            x = np.frombuffer(raw, np.uint8, w * h * depth, m.end()).reshape(h, w, depth)
            return x.mean(axis=2).astype(np.float32)
        if raw[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(raw)
    except (ValueError, TypeError, KeyError, IndexError, zlib.error):
        pass
    return None


def _png(raw: bytes) -> np.ndarray | None:
    at, data, head = 8, b"", b""
    while at + 8 <= len(raw):
        n, kind = int.from_bytes(raw[at : at + 4], "big"), raw[at + 4 : at + 8]
        if kind == b"IHDR":
            head = raw[at + 8 : at + 8 + n]
        if kind == b"IDAT":
            data += raw[at + 8 : at + 8 + n]
        at += n + 12
    w, h, depth, colour, inter = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big"), head[8], head[9], head[12]
    bands = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    if depth != 8 or inter:
        return None
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(h, 1 + w * bands)
    out, above = np.zeros((h, w * bands), np.int64), np.zeros(w * bands, np.int64)
    for y in range(h):
        kind, line = rows[y, 0], rows[y, 1:].astype(np.int64)
        if kind == 2:
            line = (line + above) % 256
        elif kind in (1, 3, 4):
            for i in range(w * bands):
                a = line[i - bands] if i >= bands else 0
                c = above[i - bands] if i >= bands else 0
                b = above[i]
                p = a + b - c
                best = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                line[i] = (line[i] + (a if kind == 1 else (a + b) // 2 if kind == 3 else best)) % 256
        out[y] = above = line
    grey = out.reshape(h, w, bands)[..., : 3 if bands >= 3 else 1]
    return grey.mean(axis=2).astype(np.float32)


def _resize(x: np.ndarray, s: float) -> np.ndarray:
    """Bilinear shrinking after a small blur."""
    if s == 1:
        return x
    x = _box(x, 1)
    h, w = max(1, round(x.shape[0] * s)), max(1, round(x.shape[1] * s))
    v, u = np.clip((np.arange(h) + 0.5) / s - 0.5, 0, x.shape[0] - 1), np.clip((np.arange(w) + 0.5) / s - 0.5, 0, x.shape[1] - 1)
    i, j = np.minimum(v.astype(int), max(0, x.shape[0] - 2)), np.minimum(u.astype(int), max(0, x.shape[1] - 2))
    a, b = (v - i)[:, None], (u - j)[None]
    i2, j2 = np.minimum(i + 1, x.shape[0] - 1), np.minimum(j + 1, x.shape[1] - 1)
    return (x[i][:, j] * (1 - a) * (1 - b) + x[i2][:, j] * a * (1 - b) + x[i][:, j2] * (1 - a) * b + x[i2][:, j2] * a * b).astype(np.float32)


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """Mean over squares of side 2r + 1."""
    p = np.pad(x, r + 1, mode="edge").cumsum(0, dtype=np.float64).cumsum(1)
    n = 2 * r + 1
    h, w = x.shape
    return ((p[n : n + h, n : n + w] - p[:h, n : n + w] - p[n : n + h, :w] + p[:h, :w]) / n**2).astype(np.float32)


_DISC = np.array([(dy, dx) for dy in range(-RADIUS, RADIUS + 1) for dx in range(-RADIUS, RADIUS + 1) if dx * dx + dy * dy <= RADIUS * RADIUS])


def describe(image: np.ndarray) -> list[tuple[float, float, float, float, bytes]]:
    """(x, y, scale, angle, bits) of the corners, in the full picture's coordinates."""
    out = []
    for s in SCALES:
        x = _resize(image, s)
        h, w = x.shape
        if min(h, w) < 2 * EDGE + 3:
            continue
        gy, gx = np.gradient(x)
        a, b, c = _box(gx * gx, 2), _box(gx * gy, 2), _box(gy * gy, 2)
        r = (a + c) / 2 - np.sqrt(((a - c) / 2) ** 2 + b * b)
        r[:EDGE] = r[-EDGE:] = 0
        r[:, :EDGE] = r[:, -EDGE:] = 0
        peak = r
        for axis in (0, 1):
            peak = np.max([np.roll(peak, i, axis) for i in range(-SPACING, SPACING + 1)], axis=0)
        ys, xs = np.nonzero((r == peak) & (r > 1.0))
        if not len(ys):
            continue
        smooth = _box(x, 1)
        disc = smooth[ys[:, None] + _DISC[:, 0], xs[:, None] + _DISC[:, 1]]
        angle = np.arctan2(disc @ _DISC[:, 0], disc @ _DISC[:, 1])
        co, si = np.cos(angle)[:, None], np.sin(angle)[:, None]
        spot = lambda px, py: smooth[np.rint(ys[:, None] + si * px + co * py).astype(int), np.rint(xs[:, None] + co * px - si * py).astype(int)]
        bits = np.packbits(spot(_PAIRS[:, 0], _PAIRS[:, 1]) < spot(_PAIRS[:, 2], _PAIRS[:, 3]), axis=1)
        out += [(float(u / s), float(v / s), s, float(t), k.tobytes()) for u, v, t, k in zip(xs, ys, angle, bits)]
    return out


def words_of(bits: np.ndarray) -> np.ndarray:
    """Rows of TESTS // 8 bytes as rows of TESTS // WORD words."""
    n = TESTS // WORD
    flat = np.unpackbits(bits, axis=1, bitorder="little")[:, : n * WORD].reshape(len(bits), n, WORD)
    return flat.astype(np.int64) @ (1 << np.arange(WORD, dtype=np.int64))


def descriptors(media: DataFrame) -> DataFrame:
    """(image_id, x, y, scale, angle, d0 to d3, words) for (image_id, media): one row for each corner."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for i, raw in zip(batch.column("image_id")[at : at + 256].to_pylist(), batch.column("media")[at : at + 256].to_pylist()):
                    image = read_image(raw)
                    if image is not None:
                        rows += [(i, *d) for d in describe(image)]
                cols = list(zip(*rows)) if rows else [[]] * 6
                bits = np.frombuffer(b"".join(cols[5]), np.uint8).reshape(-1, TESTS // 8)
                longs = np.ascontiguousarray(bits).view("<i8")
                words = words_of(bits)
                ends = np.arange(len(words) + 1, dtype=np.int32) * words.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.float32()) for c in cols[1:5]), *(pa.array(longs[:, k]) for k in range(4)), pa.ListArray.from_arrays(pa.array(ends), pa.array(words.ravel()))], ["image_id", "x", "y", "scale", "angle", "d0", "d1", "d2", "d3", "words"])

    return map_arrow(media.select("image_id", "media"), run, "image_id long, x float, y float, scale float, angle float, d0 long, d1 long, d2 long, d3 long, words array<long>")


def find_copies(media: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The output rows for (image_id, media). ``broadcast_rows``: sides of joins with no more rows are broadcast."""
    raw = F.coalesce(F.col("media"), F.lit(b""))
    named = media.select(F.col("image_id").cast("long").alias("image_id"), "media", F.unhex(F.sha2(raw, 256)).alias("digest"))
    keyed = staged(named.select("image_id", "digest"), "media-keys")
    classes = staged(keyed.groupBy("digest").agg(F.min("image_id").alias("class_id"), F.coalesce(F.max((F.col("image_id") % 100 == 0).cast("int")), F.lit(0)).alias("asks")), "media-classes")
    n = classes.count()
    held = F.broadcast if n <= broadcast_rows else lambda d: d  # pictures stay where they are
    reps = named.join(held(classes), "digest").filter("image_id = class_id")
    asked = staged(descriptors(reps.filter("asks = 1")).withColumn("q_k", F.monotonically_increasing_id()), "query-corners")
    keys = staged(asked.select("q_k", F.col("image_id").alias("q_id"), *[F.col(f"d{k}").alias(f"q{k}") for k in range(4)], F.posexplode("words").alias("slot", "word")), "query-words")
    # the queries' words go to the corners of all images, not the other way round, as long as a count shows them small
    small = keys.count() <= broadcast_rows
    hold = F.broadcast if small else lambda d: d
    salts = 1 if small else SALTS
    keys = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    every = descriptors(reps).select(F.col("image_id").alias("m_id"), *[F.col(c).alias(f"m_{c}") for c in ("x", "y", "scale", "angle")], "d0", "d1", "d2", "d3", F.posexplode("words").alias("slot", "word"))
    every = every.withColumn("salt", F.pmod(F.hash("m_id", "m_x", "m_y"), F.lit(salts)))
    differ = sum((F.bit_count(F.col(f"d{k}").bitwiseXOR(F.col(f"q{k}"))) for k in range(1, 4)), F.bit_count(F.col("d0").bitwiseXOR(F.col("q0"))))
    same = every.join(hold(keys), ["slot", "word", "salt"]).filter((F.col("q_id") != F.col("m_id")) & (differ <= NEAR))
    corner = asked.select("q_k", *[F.col(c).alias(f"q_{c}") for c in ("x", "y", "scale", "angle")])
    near = same.select("q_id", "q_k", "m_id", "m_x", "m_y", "m_scale", "m_angle").distinct().join(hold(corner), "q_k")
    # similarity transform of each match: turn, log of the scale, shift of the origin
    turn = F.col("m_angle") - F.col("q_angle")
    grow = F.col("q_scale") / F.col("m_scale")
    near = near.withColumn("turn", F.pmod(turn, F.lit(2 * np.pi))).withColumn("grow", grow)
    near = near.withColumn("dx", F.col("m_x") - grow * (F.cos("turn") * F.col("q_x") - F.sin("turn") * F.col("q_y")))
    near = near.withColumn("dy", F.col("m_y") - grow * (F.sin("turn") * F.col("q_x") + F.cos("turn") * F.col("q_y")))
    # grids half a cell apart, so that agreeing matches are not cut apart by a cell's border
    cell = lambda c, half: F.floor(F.col(c) / 16.0 + half).alias(f"{c}_cell")
    shifts = F.explode(F.array(*[F.struct(F.lit(a).alias("t"), F.lit(g).alias("g"), F.lit(x).alias("x"), F.lit(y).alias("y")) for a, g in ((0.0, 0.0), (0.5, 0.5)) for x in (0.0, 0.5) for y in (0.0, 0.5)])).alias("s")
    v = near.select("q_id", "m_id", "q_x", "q_y", "turn", "grow", "dx", "dy", shifts)
    v = v.select("q_id", "m_id", "q_x", "q_y", "s", F.pmod(F.round(F.col("turn") / (np.pi / 8) + F.col("s.t")), F.lit(16)).alias("turn_cell"), F.round(F.log2("grow") * 2 + F.col("s.g")).alias("grow_cell"), cell("dx", F.col("s.x")), cell("dy", F.col("s.y")))
    votes = v.groupBy("q_id", "m_id", "s", "turn_cell", "grow_cell", "dx_cell", "dy_cell").agg(F.countDistinct("q_x", "q_y").alias("votes"))
    copies = votes.groupBy("q_id", "m_id").agg(F.max("votes").alias("votes")).filter(F.col("votes") >= VOTES)
    members = keyed.join(classes, "digest").select(F.lit("member").alias("record"), F.col("image_id").alias("a"), F.col("class_id").alias("b"), F.lit(0).cast("long").alias("votes"))
    return members.union(copies.select(F.lit("copy"), "q_id", "m_id", F.col("votes").cast("long")))


KINDS = ("original", "cropped", "edited", "scaled", "noisy")


def draw(vector: list[float] | None, kind: int = 0, salt: int = 0, side: int = 72) -> bytes | None:
    """A PGM picture of a vector: rough ground with patches, seeded by its values. ``kind``: of KINDS, ``salt``: how much of it."""
    if vector is None:
        return None
    v = np.nan_to_num(np.asarray([x if x is not None else 0.0 for x in vector], np.float64))
    rng = np.random.default_rng(zlib.crc32(np.round(v, 4).astype("<f4").tobytes()))
    x = np.full((side, side), 128.0, np.float32)
    for grid, height in ((6, 40.0), (12, 30.0), (24, 18.0)):
        x += _stretch(rng.normal(0, height, (grid, grid)).astype(np.float32), side, side)
    for _ in range(10):
        (i, j), (h, w) = rng.integers(0, side - 8, 2), rng.integers(5, 20, 2)
        x[i : i + h, j : j + w] = x[i : i + h, j : j + w] * 0.4 + rng.integers(0, 256) * 0.6
    if kind == 1:
        top, left, low, right = (3 + (salt * k) % 10 for k in (1, 3, 7, 9))
        x = x[top : side - low, left : side - right]
    if kind == 2:
        x = x * (0.8 + salt % 4 / 10) + (salt % 5) * 6 - 12
        i, j = 8 + salt % 30, 8 + salt % 23
        x[i : i + 16, j : j + 18] = 250
    if kind == 3:
        size = round(side * (0.75, 0.85, 1.2, 1.35)[salt % 4])
        x = _stretch(_box(x, 1) if size < side else x, size, size)
    if kind == 4:
        x = x + np.random.default_rng(salt).normal(0, 4 + salt % 4, x.shape)
    return b"P5 %d %d 255 " % (x.shape[1], x.shape[0]) + np.rint(x.clip(0, 255)).astype(np.uint8).tobytes()


def _stretch(x: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear resizing to h by w."""
    v, u = np.clip((np.arange(h) + 0.5) * x.shape[0] / h - 0.5, 0, x.shape[0] - 1), np.clip((np.arange(w) + 0.5) * x.shape[1] / w - 0.5, 0, x.shape[1] - 1)
    i, j = np.minimum(v.astype(int), x.shape[0] - 2), np.minimum(u.astype(int), x.shape[1] - 2)
    a, b = (v - i)[:, None], (u - j)[None]
    return (x[i][:, j] * (1 - a) * (1 - b) + x[i + 1][:, j] * a * (1 - b) + x[i][:, j + 1] * (1 - a) * b + x[i + 1][:, j + 1] * a * b).astype(np.float32)


#: Every COPIED-th vector also has a picture of each further kind, under the id COPY_IDS * kind + vec_id + kind.
COPIED, COPY_IDS = 20, 10**12


def pictures(embeddings: DataFrame) -> DataFrame:
    """(image_id, media): a picture for each vector, as the tables hold no images, and copies of some of them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            ids, vectors = b.column("vec_id").to_pylist(), b.column("embedding").to_pylist()
            for at in range(0, len(ids), 1000):
                rows = [(i, draw(v)) for i, v in zip(ids[at : at + 1000], vectors[at : at + 1000])]
                rows += [(COPY_IDS * k + i + k, draw(v, k, i // COPIED)) for i, v in zip(ids[at : at + 1000], vectors[at : at + 1000]) if i is not None and i % COPIED == 0 for k in range(1, len(KINDS))]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["image_id", "media"])

    return map_arrow(embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), run, "image_id long, media binary")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: copies of the pictures whose id is divisible by 100 among the pictures of all embeddings and their copies."""
    return find_copies(staged(pictures(table(spark, sf_dir, "embeddings")), "pictures"))
