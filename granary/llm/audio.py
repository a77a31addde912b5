"""Media columns: chroma fingerprints of recordings and their alignment.

A recording is a binary column of WAV bytes. Its frames become energies of the twelve pitch classes; sixteen
box filters over an integral image of frames by pitch classes, each quantised to two bits in Gray code, give
one packed 32-bit integer per frame. Recordings that share integers are candidates: a histogram of the
offsets between the shared places names the alignments to try, and the share of differing bits over the
overlap accepts one.

Recordings of one fingerprint are one class; only class representatives are searched, so copies cost one row
of membership each."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.shared import ship, written

#: Samples of a frame and of a step, at a reference rate; frames that the widest filter spans; lowest and
#: highest pitch heard in Hz; most share of differing bits; least frames of overlap, least shared integers.
FRAME, STEP, RATE, SPAN, LOW, HIGH, MOST_ERROR, LEAST_OVERLAP, LEAST_VOTES = 512, 128, 4000, 16, 180.0, 1500.0, 0.12, 48, 3

#: Pairs of places that one task pairs up for a word that many recordings share, and up to how many such words are
#: broadcast rather than joined.
PAIRS, HOT = 4_000_000, 50_000

#: Of each filter: kind, first pitch class, height in pitch classes, width in frames. Kinds compare halves of
#: the box: 0 none (energy against its surroundings), 1 upper and lower, 2 left and right, 3 the diagonals.
FILTERS = [(kind, (5 * i + 2 * kind) % (13 - height), height, width) for i, (kind, height, width) in enumerate(
    [(k, h, w) for k in range(4) for h, w in ((2, 16), (4, 12), (6, 8), (12 if k == 1 else 8, 4))]
)]
#: Quantiser steps on the log ratio of the two sides.
CUTS = (-0.35, 0.0, 0.35)


def decode(body: bytes | None) -> tuple[np.ndarray, int] | None:
    """Samples in -1 to 1, channels averaged, and rate; None for null, empty or unreadable bytes."""
    if not body:
        return None
    try:
        with wave.open(io.BytesIO(body)) as w:
            kind, channels, rate, data = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.readframes(w.getnframes())
    except (wave.Error, EOFError):
        return None
    if kind not in (1, 2, 4) or not channels or not rate:
        return None
    whole = np.frombuffer(data[: len(data) // (kind * channels) * kind * channels], {1: np.uint8, 2: "<i2", 4: "<i4"}[kind]).astype(np.float32)
    whole = (whole - 128) / 128 if kind == 1 else whole / float(1 << (8 * kind - 1))
    return whole.reshape(-1, channels).mean(axis=1), rate


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """frames x 12 pitch-class energies, each frame scaled to length 1; a silent frame is all zero."""
    frame, step = round(FRAME * rate / RATE), round(STEP * rate / RATE)
    if len(samples) < frame:
        return np.empty((0, 12), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(samples, frame)[::step] * np.hanning(frame).astype(np.float32)
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    pitch = np.fft.rfftfreq(frame, 1 / rate)
    heard = (pitch >= LOW) & (pitch <= HIGH)
    classes = np.round(12 * np.log2(pitch[heard] / 440.0)).astype(int) % 12
    out = power[:, heard] @ np.eye(12, dtype=np.float32)[classes]
    size = np.sqrt((out**2).sum(axis=1, keepdims=True))
    return np.where(size > 1e-6, out / np.maximum(size, 1e-6), 0.0)


def fingerprint(image: np.ndarray) -> np.ndarray:
    """Packed integers (int32), one per frame at which the widest filter fits."""
    n = len(image) - SPAN + 1
    if n <= 0:
        return np.empty(0, np.int32)
    total = np.zeros((len(image) + 1, 13))
    total[1:, 1:] = np.cumsum(np.cumsum(image, axis=0), axis=1)
    at = np.arange(n)

    def box(x0, x1, y0, y1):
        return total[at + x1, y1] - total[at + x0, y1] - total[at + x1, y0] + total[at + x0, y0]

    packed = np.zeros(n, np.uint32)
    for kind, y, h, w in FILTERS:
        top, mid = y + h, y + h // 2
        if kind == 0:
            a, b = box(0, w, y, top), box(0, w, 0, 12) - box(0, w, y, top)
            a, b = a / h, b / (12 - h)
        elif kind == 1:
            a, b = box(0, w, y, mid), box(0, w, mid, top)
        elif kind == 2:
            a, b = box(0, w // 2, y, top), box(w // 2, w, y, top)
        else:
            a = box(0, w // 2, y, mid) + box(w // 2, w, mid, top)
            b = box(0, w // 2, mid, top) + box(w // 2, w, y, mid)
        level = np.digitize(np.round(np.log((np.abs(a) + 0.05) / (np.abs(b) + 0.05)), 6), CUTS).astype(np.uint32)
        packed = (packed << np.uint32(2)) | (level ^ (level >> np.uint32(1)))
    return packed.view(np.int32)


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints, heard = [], []
        for body in b.column(1):
            got = decode(body.as_py())
            image = chroma(*got) if got else np.empty((0, 12))
            prints.append(fingerprint(image))
            # An integer over silence alone says nothing about a recording and casts no vote.
            loud = np.concatenate([[0], np.cumsum(image.any(axis=1))])
            heard.append(np.flatnonzero(loud[SPAN:] > loud[:-SPAN]).astype(np.int32) if len(prints[-1]) else np.empty(0, np.int32))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints, pa.list_(pa.int32())), pa.array(heard, pa.list_(pa.int32()))], names=["id", "print", "heard"])


def fingerprints(recordings: DataFrame, key: str = "id", audio: str = "audio") -> DataFrame:
    """id, print (packed integers), heard (places that aren't silence). Null, empty or unreadable audio, and
    recordings shorter than the widest filter, have an empty print.

    Recordings are large; Spark cuts the batches that meet Python by bytes."""
    ship(recordings.sparkSession)
    d = recordings.select(F.col(key).cast("long").alias("id"), F.col(audio).alias("audio"))
    return d.mapInArrow(_printed, "id long, print array<int>, heard array<int>")


def align(prints: DataFrame, queries: DataFrame, *, most_error: float = MOST_ERROR, least_overlap: int = LEAST_OVERLAP, least_votes: int = LEAST_VOTES, pairs: int = PAIRS) -> tuple[DataFrame, DataFrame]:
    """(members, matches): members has id, class_id (smallest id of the same print, null if empty) and
    frames; matches has query_class, class_id, shift (place in the match minus place in the query) and
    bit_error for every two classes of which the first holds a query.

    Every offset with at least ``least_votes`` shared integers that overlaps in ``least_overlap`` frames is a
    candidate, and one that differs in at most ``most_error`` of the bits is accepted; a match is the accepted
    offset with the most shared integers (of equals the smallest). Repeated
    rows, ties and null ids fall into their class; empty prints match nothing; a class has no match with
    itself."""
    prints = written(prints.withColumn("h", F.xxhash64("print")), "prints")
    some = prints.filter(F.size("print") > 0)
    classes = some.groupBy("h", "print").agg(F.min("id").alias("class_id"), F.first("heard").alias("heard"))
    classes = written(classes.select("h", F.col("print").alias("body"), "class_id", "heard").filter("class_id is not null"), "classes")
    members = prints.join(classes.select("h", "body", "class_id"), (prints["h"] == classes["h"]) & (prints["print"] == classes["body"]), "left").select("id", "class_id", F.size("print").alias("frames"))
    asking = members.join(queries.select(F.col("id").alias("q")).distinct(), F.col("id") == F.col("q"), "left_semi").select("class_id").filter("class_id is not null").distinct()
    asking = written(asking, "asking")

    word = F.explode(F.transform("heard", lambda at: F.struct(at.alias("at"), F.get("body", at).alias("word")))).alias("w")
    asks = asking.select("class_id", F.lit(1).alias("asks"))
    placed = classes.join(asks, "class_id", "left").select("class_id", F.size("body").alias("frames"), F.coalesce("asks", F.lit(0)).alias("asks"), word).select("class_id", "frames", "asks", "w.at", "w.word")
    asked = placed.filter("asks = 1").select(F.col("class_id").alias("query_class"), F.col("frames").alias("q_frames"), F.col("at").alias("q_at"), "word")
    # a word that many hold is dealt: its places over lots, its asking places to every lot
    held = placed.groupBy("word").agg(F.count(F.lit(1)).alias("holders"), F.sum("asks").alias("askers")).filter(F.col("askers") > 0)
    hot = held.select("word", F.least("holders", F.ceil(F.col("holders") * F.col("askers") / pairs)).cast("int").alias("lots")).filter("lots > 1")
    hot = written(hot, "hot")
    hot = F.broadcast(hot) if hot.count() <= HOT else hot
    placed = placed.drop("asks")
    dealt = lambda df: df.join(hot, "word", "left").withColumn("lots", F.coalesce("lots", F.lit(1)))
    placed = dealt(placed).withColumn("lot", F.pmod(F.xxhash64("class_id", "at"), F.col("lots")).cast("int")).drop("lots")
    asked = dealt(asked).withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))).drop("lots")
    votes = placed.join(asked, ["word", "lot"]).filter("class_id <> query_class").groupBy("query_class", "class_id", (F.col("at") - F.col("q_at")).alias("shift")).agg(F.count(F.lit(1)).alias("votes"), F.max("q_frames").alias("q_frames"), F.max("frames").alias("frames"))

    def span(shift, a, b):
        start = F.greatest(F.lit(0), -shift)
        return start, F.least(a, b - shift) - start

    tried = votes.filter((F.col("votes") >= least_votes) & (span(F.col("shift"), F.col("q_frames"), F.col("frames"))[1] >= least_overlap))
    tried = tried.groupBy("query_class", "class_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("last"), "shift"))).alias("offsets"))
    pair = tried.join(classes.select(F.col("class_id").alias("query_class"), F.col("body").alias("a")), "query_class").join(classes.select("class_id", F.col("body").alias("b")), "class_id")

    def error(shift):
        start, overlap = span(shift, F.size("a"), F.size("b"))
        bits = F.zip_with(F.slice("a", start + 1, overlap), F.slice("b", start + shift + 1, overlap), lambda x, y: F.bit_count(x.bitwiseXOR(y).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))))
        return F.aggregate(bits, F.lit(0), lambda s, x: s + x) / (32.0 * overlap)

    # offsets from the most votes down; the first accepted one stays
    none = F.struct(F.lit(0).alias("shift"), F.lit(2.0).alias("bit_error"))
    found = F.aggregate("offsets", none, lambda f, o: F.when(f["bit_error"] <= most_error, f).otherwise(F.struct(o["shift"].alias("shift"), error(o["shift"]).alias("bit_error"))))
    matches = pair.select("query_class", "class_id", found.alias("found")).select("query_class", "class_id", "found.shift", "found.bit_error").filter(F.col("bit_error") <= most_error)
    return members, matches


def sonified(vectors: DataFrame) -> DataFrame:
    """id and audio (WAV) of a vector table, one tone per component; stands in for recordings in tables that
    have none. Null vectors have null audio, null and non-finite components are rests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = np.arange(256) / RATE
        for b in (batch.slice(start, 256) for batch in batches for start in range(0, batch.num_rows, 256)):
            out = []
            for v in b.column(1).to_pylist():
                if v is None:
                    out.append(None)
                    continue
                x = np.array([np.nan if c is None else c for c in v], float)
                rest = ~np.isfinite(x)
                tone = 220 * 2 ** (np.clip(np.round(np.where(rest, 0, x) * 80), -12, 17) / 12 + 0.75)
                wave_ = np.sin(2 * np.pi * tone[:, None] * t) * np.where(rest, 0, 0.5)[:, None]
                body = io.BytesIO()
                with wave.open(body, "wb") as w:
                    w.setnchannels(1)
                    w.setsampwidth(2)
                    w.setframerate(RATE)
                    w.writeframes((wave_ * 32767).astype("<i2").tobytes())
                out.append(body.getvalue())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["id", "audio"])

    ship(vectors.sparkSession)
    return vectors.select(F.col("vec_id").cast("long").alias("id"), "embedding").mapInArrow(run, "id long, audio binary")


