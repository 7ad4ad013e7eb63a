"""Quality rules with n-gram perplexity (operator 3).

Spark counts all byte n-grams of every language's whole texts.  The counts give an interpolated modified Kneser-Ney model,
whose probabilities and back-off weights lie in arrays sorted by hash.  The model is of the same order at every size: it
is counted, built and kept in parts, as files in the shared folder, and whoever scores reads them part by part.  A language
has two models, each of the texts whose hash is even or odd, and a text is scored by the one that has not counted it.
Documents outside a band around their language's usual log perplexity are rejected, beside those that fail fixed rules.

Bytes and not words are the unit, since words are told apart by spaces in some languages only, and since a model of bytes
knows no unknown words: in held-out text a rare word costs what its spelling costs.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from functools import partial
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import shared_folder, stored
from .exchange import PACKED, bucket_of, buckets_for, gathers, scatter, shuffled
from .textcore import CHUNK_BYTES, U64, Words, as_bytes, chunks, mix

#: Bytes of an n-gram.
ORDER = 5
#: N-grams of at most so many bytes stand in one model for all parts (no more than 65,536 pairs a language and half);
#: longer ones are dealt by the two bytes before their last, which all n-grams and contexts that a byte's probability asks
#: for share.
LOW = 2
#: A worker keeps parts of so many n-grams in memory; others are read again for every ROUND bytes of text.  Neither
#: changes a result.
HELD, ROUND = 2_000_000, 1 << 24
#: Log probabilities are whole multiples of this, so that sums don't hang on their order.
UNIT = 1.0 / (1 << 16)
#: A band reaches this many quartile distances below the lower and above the upper quartile of log perplexity, which count
#: LEAST_SPREAD nats a word at least.
BELOW, ABOVE, LEAST_SPREAD = 2.0, 3.5, 0.2
LEAST_WORDS = 50


# -- counting -------------------------------------------------------------------------------------------------------


def language_code(lang: str | None) -> int:
    """24 bits of a language's name, of which the last is 0; null is a language of its own."""
    data = b"\0" if lang is None else lang.encode("utf-8", "surrogatepass")
    h = np.array([len(data)], U64)
    for b in data:
        h = mix(h ^ U64(b))
    return int(h[0] >> U64(40)) & ~1


def half(text: bytes) -> int:
    """Which of its language's two models counts a text; equal texts are in one half."""
    return crc32(text) & 1


def grams(pieces: list[tuple[bytes, bytes]], models: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of every piece, its model << 40 | the ``order`` bytes that end there; a piece is its bytes and the
    order - 1 ones before them.  And where each piece begins among them, with the end last."""
    before = order - 1
    data = np.frombuffer(b"".join([x for lead, body in pieces for x in (lead, body)]), np.uint8)
    lengths = np.fromiter((len(body) for _, body in pieces), np.int64, len(pieces))
    ends = np.cumsum(lengths + before)
    key = np.zeros(len(data), U64)
    for k in range(order):
        key[k:] |= data[: len(data) - k].astype(U64) << U64(8 * k)
    own = np.ones(len(data), bool)
    for k in range(before):
        own[ends - lengths - before + k] = False
    key = key[own] | np.repeat(models.astype(U64) << U64(40), lengths)
    return key, np.concatenate([[0], np.cumsum(lengths)])


def pieces_of(texts: list[bytes], order: int) -> Iterator[tuple[list[int], list[tuple[bytes, bytes]]]]:
    """Texts in groups of about CHUNK_BYTES bytes, as (their numbers, pieces); a longer text is in several pieces, each with
    the bytes before it, and zeros stand before a text."""
    numbers, pieces, size = [], [], 0
    zeros = bytes(order - 1)
    for i, text in enumerate(texts):
        for at in range(0, len(text), CHUNK_BYTES):
            body = text[at : at + CHUNK_BYTES] if len(text) > CHUNK_BYTES else text
            if size and size + len(body) > CHUNK_BYTES:
                yield numbers, pieces
                numbers, pieces, size = [], [], 0
            numbers.append(i)
            pieces.append(((zeros + text[max(0, at - order + 1) : at])[len(text[max(0, at - order + 1) : at]) :], body))
            size += len(body) + order
    if numbers:
        yield numbers, pieces


def _models(batch: pa.RecordBatch, texts: list[bytes], codes: dict[str | None, int], other: bool) -> np.ndarray:
    """Of each text the model that counts it, or the other one of its language, which scores it."""
    langs = batch.column("lang").to_pylist()
    for x in set(langs) - codes.keys():
        codes[x] = language_code(x)
    return np.array([codes[x] | half(t) ^ other for x, t in zip(langs, texts, strict=True)], np.int64)


def _part_of(keys: np.ndarray, n: int) -> np.ndarray:
    return bucket_of(keys & LANG | keys >> U64(8) & U64(0xFFFF), n)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(keys) else counts


def _count(batches: Iterable[pa.RecordBatch], order: int, n: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size, codes = 0, {}
    for batch in batches:
        texts = as_bytes(batch.column("text"))
        models = _models(batch, texts, codes, False)
        for numbers, pieces in pieces_of(texts, order):
            keys = np.sort(grams(pieces, models[numbers], order)[0])
            at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
            held.append((keys[at], np.diff(np.r_[at, len(keys)])))
            size += len(at)
            if size > 1 << 20:
                held = [_summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))]
                size = len(held[0][0])
                if size > 1 << 19:
                    yield from scatter(np.stack([held[0][0], held[0][1].astype(U64)], 1), _part_of(held[0][0], n))
                    held, size = [], 0
    if held:
        keys, counts = _summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
        yield from scatter(np.stack([keys, counts.astype(U64)], 1), _part_of(keys, n))


def _levels(keys: np.ndarray, counts: np.ndarray, order: int, first: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Grams and their counts by order down to first; those of lower orders have continuation counts."""
    levels = {order: (keys, counts.astype(np.int64))}
    for n in range(order - 1, first - 1, -1):
        # continuation counts: different bytes before a gram
        levels[n] = _summed(_last(levels[n + 1][0], n), np.ones(len(levels[n + 1][0]), np.int64))
    return levels


_ADDED = "part int, keys binary, counts binary, entries long, low_keys binary, low_counts binary, counted binary"


def _add(batches: Iterable[pa.RecordBatch], order: int, n: int) -> Iterator[pa.RecordBatch]:
    """A part's grams, its short ones, and (language, order, how many counts are 1, 2, 3, 4) of its long ones."""
    for got in gathers(batches, 2):
        k, c = _summed(got[:, 0], got[:, 1])
        # a part is a bucket
        part = int(_part_of(k[:1], n)[0])
        levels = _levels(k, c, order, min(order, LOW))
        low = levels[min(order, LOW)]
        rows = []
        for m in range(LOW + 1, order + 1):
            lang = (levels[m][0] >> U64(40)).astype(np.int64)
            rows += [(x, m, *(np.count_nonzero(levels[m][1][lang == x] == i) for i in (1, 2, 3, 4))) for x in np.unique(lang).tolist()]
        binary = [x.tobytes() for x in (k, c, low[0], low[1], np.array(rows, np.int64))]
        columns = [pa.array([part], pa.int32()), *(pa.array([x], pa.binary()) for x in binary[:2]), pa.array([len(k)], pa.int64()), *(pa.array([x], pa.binary()) for x in binary[2:])]
        yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _ADDED.split(", ")])


# -- the model ------------------------------------------------------------------------------------------------------


class Table:
    """Values by 64-bit key, in the order of the keys' hashes."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, hashed: bool = False):
        if not hashed:
            keys = mix(keys)
            order = np.argsort(keys, kind="stable")
            keys, values = keys[order], values[order]
        self.hashes, self.values = keys, values

    def find(self, keys: np.ndarray, missing: int) -> tuple[np.ndarray, np.ndarray]:
        """(values, whether found)."""
        if not len(self.hashes):
            return np.full(len(keys), missing, self.values.dtype), np.zeros(len(keys), bool)
        h = mix(keys)
        at = np.searchsorted(self.hashes, h)
        at[at == len(self.hashes)] = 0
        found = self.hashes[at] == h
        return np.where(found, self.values[at], self.values.dtype.type(missing)), found


def _discounts(n: list[float]) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 0, 1, 2 and 3 or more, from how many counts are 1, 2, 3 and 4."""
    out = np.array([0.0, 0.5, 1.0, 1.5])
    if n[0] and n[1]:
        y = n[0] / (n[0] + 2 * n[1])
        for k in (1, 2, 3):
            if n[k - 1]:
                out[k] = min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.0), float(k))
    return out


LANG, MASK = U64(0xFFFFFF << 40), U64((1 << 40) - 1)


def _last(keys: np.ndarray, n: int) -> np.ndarray:
    """The grams' last n bytes, with their languages and n."""
    return keys & LANG | keys & U64((1 << 8 * n) - 1)


def _quantised(x: np.ndarray) -> np.ndarray:
    return np.round(np.log(np.maximum(x, 1e-9)) / UNIT).astype(np.int32)


class KneserNey:
    """Interpolated modified Kneser-Ney over bytes, per language, of (key, count) of all grams of one order.

    Of a part of the grams only orders above LOW are built: low is the model of the others, and discounts holds those of all
    parts by language and order.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int, low: KneserNey | None = None, discounts: dict[tuple[int, int], np.ndarray] | None = None):
        self.order, self.low, self.first = order, low, LOW + 1 if low else 1
        levels = _levels(keys, counts, order, self.first)
        self.probability: dict[int, Table] = {}
        self.backoff: dict[int, Table] = {}
        lower_keys, lower = low.top if low else (np.zeros(0, U64), np.zeros(0))
        for n in range(self.first, order + 1):
            k, c = levels[n]
            lang = (k >> U64(40)).astype(np.int64)
            discount = np.zeros(len(k))
            for x in np.unique(lang).tolist():
                own = lang == x
                steps = discounts[x, n] if discounts else _discounts([float(np.count_nonzero(c[own] == i)) for i in (1, 2, 3, 4)])
                discount[own] = steps[np.minimum(c[own], 3)]
            context = k & LANG | (k & MASK) >> U64(8)
            contexts, at = np.unique(context, return_inverse=True)
            total = np.bincount(at, c)
            gamma = np.bincount(at, discount) / total
            if n == 1:
                below = np.full(len(k), 1.0 / 256)
            else:
                where = np.searchsorted(lower_keys, _last(k, n - 1))
                below = lower[where]
            p = (c - discount) / total[at] + gamma[at] * below
            lower_keys, lower = k, p
            self.probability[n] = Table(k, _quantised(p))
            self.backoff[n - 1] = Table(contexts, _quantised(gamma))
        #: grams of the highest order and their probabilities, for a model to be built upon this one
        self.top = (lower_keys, lower)

    def tables(self) -> list[Table]:
        return [t for by in (self.probability, self.backoff) for _, t in sorted(by.items())]

    def packed(self) -> bytes:
        """The tables, each as its length, hashes and values."""
        return b"".join(x for t in self.tables() for x in (len(t.hashes).to_bytes(8, "little"), t.hashes.tobytes(), t.values.tobytes()))

    @classmethod
    def unpacked(cls, data: bytes, order: int, low: KneserNey) -> KneserNey:
        """The part that packed() gave, upon low."""
        self = cls.__new__(cls)
        self.order, self.low, self.first = order, low, LOW + 1
        at = 0

        def table() -> Table:
            nonlocal at
            n = int.from_bytes(data[at : at + 8], "little")
            hashes, values = np.frombuffer(data, U64, n, at + 8), np.frombuffer(data, np.int32, n, at + 8 + 8 * n)
            at += 8 + 12 * n
            return Table(hashes, values, True)

        self.probability = {n: table() for n in range(self.first, order + 1)}
        self.backoff = {n - 1: table() for n in range(self.first, order + 1)}
        return self

    def units(self, keys: np.ndarray) -> np.ndarray:
        """Log probability of each gram's last byte after the others, in UNITs."""
        out = np.zeros(len(keys), np.int64)
        left = np.arange(len(keys))
        for n in range(self.order, self.first - 1, -1):
            grams_ = _last(keys[left], n)
            value, found = self.probability[n].find(grams_, 0)
            out[left[found]] += value[found]
            left, grams_ = left[~found], grams_[~found]
            if not len(left):
                return out
            out[left] += self.backoff[n - 1].find(grams_ & LANG | (grams_ & MASK) >> U64(8), 0)[0]
        out[left] += self.low.units(keys[left]) if self.low else round(np.log(1.0 / 256) / UNIT)
        return out


#: The parts that this worker keeps, of one model at a time.
_kept: dict[str, dict[int, KneserNey]] = {}


class Parts:
    """A model in the shared folder: low, and a file for each part with longer grams."""

    def __init__(self, folder: str, order: int, low: KneserNey, n: int, entries: dict[int, int], held: int = HELD):
        self.folder, self.order, self.low, self.n = folder, order, low, n
        self.parts = sorted(entries)
        sizes = np.cumsum([entries[p] for p in self.parts])
        self.held = {p for p, size in zip(self.parts, sizes.tolist(), strict=True) if size <= held}

    def model(self, part: int) -> KneserNey:
        if self.folder not in _kept:
            _kept.clear()
        kept = _kept.setdefault(self.folder, {})
        if part in kept:
            return kept[part]
        fs, base = pafs.FileSystem.from_uri(self.folder)
        with fs.open_input_stream(f"{base}/{part}", compression=None) as stream:
            out = KneserNey.unpacked(stream.read(), self.order, self.low)
        if part in self.held:
            kept[part] = out
        return out

    def units(self, keys: np.ndarray) -> np.ndarray:
        """Log probability of each of some distinct grams, in UNITs."""
        if not self.parts or not len(keys):
            return self.low.units(keys)
        own = _part_of(keys, self.n)
        order = np.argsort(own, kind="stable")
        at = np.searchsorted(own[order], np.arange(self.n + 1))
        out = np.zeros(len(keys), np.int64)
        known = set(self.parts)
        for part in range(self.n):
            some = order[at[part] : at[part + 1]]
            if len(some):
                # a part without a file has no longer gram
                out[some] = (self.model(part) if part in known else self.low).units(keys[some])
        return out


def _build(batches: Iterable[pa.RecordBatch], folder: str, order: int, low: KneserNey, discounts: dict[tuple[int, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Writes the file of each part."""
    fs, base = pafs.FileSystem.from_uri(folder)
    for batch in batches:
        for part, keys, counts in zip(*(batch.column(x).to_pylist() for x in ("part", "keys", "counts")), strict=True):
            data = KneserNey(np.frombuffer(keys, U64), np.frombuffer(counts, np.int64), order, low, discounts).packed()
            temporary = f"{base}/_{uuid.uuid4().hex}"
            with fs.open_output_stream(temporary, compression=None) as out:
                out.write(data)
            fs.move(temporary, f"{base}/{part}")
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32())], names=["part"])


def model(docs: DataFrame, order: int = ORDER, held: int = HELD) -> Parts:
    """The model of all texts of docs(lang, text)."""
    spark = docs.sparkSession
    n = buckets_for(docs)
    packed = docs.select("lang", "text").mapInArrow(partial(_count, order=order, n=n), PACKED)
    counted = stored(shuffled(packed).mapInArrow(partial(_add, order=order, n=n), _ADDED), "grams")
    rows = counted.select("part", "entries", "low_keys", "low_counts", "counted").collect()
    keys, counts = (np.concatenate([np.zeros(0, t), *(np.frombuffer(r[x], t) for r in rows)]) for x, t in (("low_keys", U64), ("low_counts", np.int64)))
    low = KneserNey(*_summed(keys, counts), min(order, LOW))
    total: dict[tuple[int, int], np.ndarray] = {}
    for r in rows:
        for lang, m, *of in np.frombuffer(r["counted"], np.int64).reshape(-1, 6).tolist():
            total[lang, m] = total.get((lang, m), 0) + np.array(of, float)
    entries = {r["part"]: r["entries"] for r in rows} if order > LOW else {}
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    folder = path.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toUri().toString()
    fs.mkdirs(path)
    if entries:
        discounts = {k: _discounts(v.tolist()) for k, v in total.items()}
        built = counted.select("part", "keys", "counts").mapInArrow(partial(_build, folder=folder, order=order, low=low, discounts=discounts), "part int").collect()
        if len(built) != len(entries):
            raise RuntimeError(f"{len(built)} of {len(entries)} parts of the model were built")
    low.top = None
    return Parts(folder, order, low, n, entries, held)


# -- the rules ------------------------------------------------------------------------------------------------------

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[*b"#*$%&|<>"]] = True


def _repeated(words: Words, windows: np.ndarray, i: int) -> int:
    a, b = words.first[i], words.first[i + 1]
    if b - a < 4:
        return 0
    own = windows[a : b - 2]
    order = np.argsort(own, kind="stable")
    ordered = own[order]
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    hit = np.zeros(b - a, bool)
    for at in (order[1:][same], order[:-1][same]):
        hit[at] = hit[at + 1] = hit[at + 2] = True
    return int(hit.sum())


def _again(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split(b"\n")
    if len(lines) < 2:
        return 0
    lines = [x for x in lines if x.strip()]
    return len(lines) - len(set(lines))


_SCORED = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, units long"


def _units(texts: list[bytes], models: np.ndarray, kn: Parts) -> np.ndarray:
    """Log probability of every text, in UNITs: distinct grams are looked up once for ROUND bytes of text."""
    out = np.zeros(len(texts), np.int64)
    waiting: list[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def look_up() -> None:
        every = np.unique(np.concatenate([x[1] for x in waiting]))
        units = kn.units(every)
        for numbers, distinct, of, at in waiting:
            sums = np.concatenate([[0], np.cumsum(units[np.searchsorted(every, distinct)][of])])
            np.add.at(out, numbers, sums[at[1:]] - sums[at[:-1]])
        waiting.clear()

    for numbers, pieces in pieces_of(texts, kn.order):
        keys, at = grams(pieces, models[numbers], kn.order)
        distinct, of = np.unique(keys, return_inverse=True)
        waiting.append((numbers, distinct, of.astype(np.int32), at))
        size += len(keys)
        if size >= ROUND:
            look_up()
            size = 0
    if waiting:
        look_up()
    return out


def _score(batches: Iterable[pa.RecordBatch], kn: Parts) -> Iterator[pa.RecordBatch]:
    codes: dict[str | None, int] = {}
    names = [x.split()[0] for x in _SCORED.split(", ")]
    for batch in batches:
        texts = as_bytes(batch.column("text"))
        out = np.zeros((6, len(texts)), np.int64)
        for a, b in chunks(texts):
            words = Words(texts[a:b])
            windows = words.windows(3)
            out[0, a:b] = words.counts
            # leading bytes of characters in words, and symbols; what parts texts is neither
            out[1, a:b] = words.sums(((words.data & 0xC0) != 0x80) & ~words.space())
            out[2, a:b] = words.sums(_SYMBOL[words.data])
            out[3, a:b] = [_again(t) for t in texts[a:b]]
            out[4, a:b] = [_repeated(words, windows, i) for i in range(b - a)]
        out[5] = _units(texts, _models(batch, texts, codes, True), kn)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), *(pa.array(x) for x in out)], names=names)


def judged(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """One row per row of docs(doc_id, text, lang): doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, log_perplexity (nats a word), low, high, kept.

    base_failed: fewer than LEAST_WORDS words, or more than half of the words in repeated 3-word windows.  The others are
    kept if their log perplexity lies in their language's band, which the quartiles over all of the language's documents
    that don't fail set.  A null text is empty and fails; null is a language of its own; repeated rows and null ids stay
    one row each; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    kn = model(rows, order)
    scored = rows.mapInArrow(partial(_score, kn=kn), _SCORED)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    # a word, not a byte: marks added to every word are cheap by the byte.  Hundredths of a nat keep the values few
    level = F.when(F.col("n_words") > 0, F.round(-F.col("units") * UNIT / F.col("n_words"), 2))
    scored = stored(scored.withColumn("base_failed", failed).withColumn("log_perplexity", level), "scored")
    bands = scored.filter("NOT base_failed").groupBy("lang").agg(F.percentile("log_perplexity", F.lit(0.25)).alias("q1"), F.percentile("log_perplexity", F.lit(0.75)).alias("q3"))
    spread = F.greatest(F.col("q3") - F.col("q1"), F.lit(LEAST_SPREAD))
    bands = bands.select(F.col("lang").alias("of"), (F.col("q1") - BELOW * spread).alias("low"), (F.col("q3") + ABOVE * spread).alias("high"))
    out = scored.join(bands, scored["lang"].eqNullSafe(bands["of"]), "left")
    kept = ~F.col("base_failed") & (F.col("log_perplexity") >= F.col("low")) & (F.col("log_perplexity") <= F.col("high"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "log_perplexity", "low", "high", F.coalesce(kept, F.lit(False)).alias("kept"))
