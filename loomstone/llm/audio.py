"""Telephony audio as media columns: mu-law, A-law and ADPCM in WAVE files, expanded and resampled.

G.711 samples are expanded by lookup tables of 256 entries, made from the coding rule. ADPCM blocks
are coded and decoded by numpy across blocks: step i of every block of a batch at once. A stored file is
a RIFF container; what is read back is parsed from its bytes. Beside each mu-law file its sound is stored at 6 kHz, coded
as ADPCM; what is read back of that is decoded, and the result holds the expanded, resampled sound as 16-bit PCM files.

Edge cases: a null payload is empty and still gets a block of zeros; a sound that ends within an ADPCM block is filled up with its last
sample, and its length is in the file's fact chunk; a null file has a null PCM; a file that
is not RIFF/WAVE, or cut short, is an error; equal payloads give equal files and features; a null doc_id
stays null, and no id passes through Python; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import batched, values, written

#: Fixed values of the formats: format tags, ADPCM index moves and step range.
MU_LAW, A_LAW, IMA_ADPCM, PCM = 7, 6, 0x11, 1
INDEX_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8])
STEP = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107,
    118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963,
    1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894,
    6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794,
    32767,
])
STEPS = len(STEP)
RATE, BLOCK = 8000, 64
#: The share of the rate at which a sound is resampled; samples of an ADPCM block, one and two for each byte behind its header.
UP, DOWN = 3, 4
PER_BLOCK = 2 * (BLOCK - 4) + 1
#: Blocks decoded at once, and samples resampled at once.
BLOCKS_AT_ONCE, SAMPLES_AT_ONCE = 4096, 1 << 18


def mu_law_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = ((((code & 15) << 3) + 0x84) << (code >> 4 & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def a_law_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    low, part = (code & 15) << 4, code >> 4 & 7
    size = np.where(part == 0, low + 8, (low + 0x108) << np.maximum(part - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


MU, A = mu_law_table(), a_law_table()


def adpcm_blocks(data: np.ndarray) -> np.ndarray:
    """IMA ADPCM blocks, a row of bytes each -> a row of int16 samples each: the header's, then two per byte."""
    value = data[:, 0].astype(np.int32) | data[:, 1].astype(np.int32) << 8
    value = np.where(value >= 1 << 15, value - (1 << 16), value)
    index = np.clip(data[:, 2].astype(np.int32), 0, STEPS - 1)
    out = np.empty((len(data), 2 * (data.shape[1] - 4) + 1), np.int16)
    out[:, 0] = value
    step32 = STEP.astype(np.int32)
    for i in range(out.shape[1] - 1):
        code = data[:, 4 + i // 2] >> 4 * (i % 2) & 15
        size = code & 7
        step = step32[index]
        move = (step >> 3) + np.where(size & 4, step, 0) + np.where(size & 2, step >> 1, 0) + np.where(size & 1, step >> 2, 0)
        value = np.clip(np.where(code & 8, value - move, value + move), -32768, 32767)
        index = np.clip(index + INDEX_MOVES[size], 0, STEPS - 1).astype(np.int32)
        out[:, i + 1] = value
    return out


def adpcm_coded(pcm: np.ndarray) -> np.ndarray:
    """Rows of an odd number of int16 samples -> IMA ADPCM blocks, a row of bytes each; the inverse of adpcm_blocks but for rounding."""
    out = np.zeros((len(pcm), 4 + pcm.shape[1] // 2), np.uint8)
    value = pcm[:, 0].astype(np.int32)
    # Blocks are coded side by side, so none has a step from the one before: it starts with one as large as its first moves.
    moves = np.abs(np.diff(pcm[:, :4].astype(np.int32), axis=1)).max(axis=1, initial=0)
    index = np.minimum(np.searchsorted(STEP, moves), STEPS - 1).astype(np.int32)
    out[:, 0], out[:, 1], out[:, 2] = value & 0xFF, value >> 8 & 0xFF, index
    step32 = STEP.astype(np.int32)
    for i in range(pcm.shape[1] - 1):
        step = step32[index]
        left = pcm[:, i + 1].astype(np.int32) - value
        code, left = np.where(left < 0, 8, 0), np.abs(left)
        move = step >> 3
        for bit in (4, 2, 1):
            part = step >> {4: 0, 2: 1, 1: 2}[bit]
            takes = left >= part
            code, left, move = code | np.where(takes, bit, 0), left - np.where(takes, part, 0), move + np.where(takes, part, 0)
        value = np.clip(np.where(code & 8, value - move, value + move), -32768, 32767)
        index = np.clip(index + INDEX_MOVES[code & 7], 0, STEPS - 1).astype(np.int32)
        out[:, 4 + i // 2] |= (code << 4 * (i % 2)).astype(np.uint8)
    return out


def resampled(pcm: np.ndarray, up: int, down: int, taps: int = 8) -> np.ndarray:
    """int16 samples at up/down times the rate. A long sound is cut, and each cut reaches over its ends by the filter's width."""
    reach = -(-(taps * max(up, down) // up + 1) // down) * down
    step = SAMPLES_AT_ONCE // down * down
    if len(pcm) <= step:
        return _resampled(pcm, up, down, taps)
    parts = []
    for at in range(0, len(pcm), step):
        ahead = min(at, reach)
        part = _resampled(pcm[at - ahead: at + step + reach], up, down, taps)
        begin = ahead * up // down
        parts.append(part[begin: begin + -(-min(step, len(pcm) - at) * up // down)])
    return np.concatenate(parts)


def _resampled(pcm: np.ndarray, up: int, down: int, taps: int) -> np.ndarray:
    """A windowed-sinc filter, one phase of it per output residue."""
    n = -(-len(pcm) * up // down)
    wide = taps * max(up, down)
    t = np.arange(-wide, wide + 1)
    kernel = np.sinc(t / max(up, down)) * (0.5 + 0.5 * np.cos(np.pi * t / (wide + 1)))
    kernel *= up / kernel.sum()
    reach = wide // up + 2
    x = np.zeros(len(pcm) + 2 * reach + down, np.float32)  # silence on both sides
    x[reach: reach + len(pcm)] = pcm
    out = np.zeros(n, np.float32)
    for phase in range(min(up, n)):
        count = -(-(n - phase) // up)
        first_at = phase * down  # positions in the raised rate; all of a phase have one residue mod up
        first = -(-(first_at - wide) // up)
        offsets = np.arange(first, (first_at + wide) // up + 1)
        weights = kernel[(first_at - offsets * up) + wide].astype(np.float32)
        total = np.zeros(count, np.float32)
        # Outputs of a phase are `down` input samples apart, so each tap is one strided run of the input.
        for o, w in zip(offsets + reach, weights, strict=True):
            total += w * x[o: o + down * count: down][:count]
        out[phase::up] = total
    return np.clip(np.rint(out), -32768, 32767).astype(np.int16)


def wave(tag: int, samples: bytes, rate: int = RATE, bits: int = 8, align: int = 1, count: int | None = None) -> bytes:
    """A one-channel RIFF/WAVE file; count: its samples, where they do not fill its blocks."""
    per_block = 2 * (align - 4) + 1
    extra = struct.pack("<HH", 2, per_block) if tag == IMA_ADPCM else struct.pack("<H", 0) if tag != PCM else b""
    second = rate * align if tag != IMA_ADPCM else rate * align // per_block
    fmt = struct.pack("<HHIIHH", tag, 1, rate, second, align, bits) + extra
    count = len(samples) // align * (per_block if tag == IMA_ADPCM else 1) if count is None else count
    fact = b"" if tag == PCM else struct.pack("<4sII", b"fact", 4, count)
    body = b"WAVE" + struct.pack("<4sI", b"fmt ", len(fmt)) + fmt + fact + struct.pack("<4sI", b"data", len(samples)) + samples + b"\0" * (len(samples) % 2)
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def parse_wave(media: bytes) -> tuple[int, int, int, memoryview]:
    """Format tag, rate, bytes per sample or block, and the data bytes of a file; its lengths are checked."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE" or struct.unpack_from("<I", media, 4)[0] != len(media) - 8:
        raise ValueError("not a whole RIFF/WAVE file")
    view, at, fmt, data = memoryview(media), 12, None, None
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if at + 8 + size > len(media):
            raise ValueError(f"chunk {name!r} reaches past the end")
        if name == b"fmt ":
            fmt = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"data":
            data = view[at + 8: at + 8 + size]
        at += 8 + size + size % 2
    if fmt is None or data is None:
        raise ValueError("no format or no data")
    return fmt[0], fmt[2], fmt[4], data


def sample_count(media: bytes) -> int | None:
    """The samples that a file's fact chunk, which stands before its data, tells of."""
    at = media.find(b"fact", 12, 128)
    return struct.unpack_from("<I", media, at + 8)[0] if at >= 0 else None


def expand(tag: int, align: int, data: memoryview) -> np.ndarray:
    """A file's samples as int16 PCM."""
    raw = np.frombuffer(data, np.uint8)
    if tag == MU_LAW:
        return MU[raw]
    if tag == A_LAW:
        return A[raw]
    if tag == PCM:
        return np.frombuffer(data, "<i2")
    if tag != IMA_ADPCM:
        raise ValueError(f"format {tag}")
    blocks = raw[: len(raw) // align * align].reshape(-1, align)
    return np.concatenate([np.zeros(0, np.int16), *(adpcm_blocks(blocks[i: i + BLOCKS_AT_ONCE]).ravel() for i in range(0, len(blocks), BLOCKS_AT_ONCE))])


def level(pcm: np.ndarray) -> str:
    """Peak, root mean square and sign changes of some samples."""
    if not len(pcm):
        return "0/0/0"
    x = pcm.astype(np.int32)
    rms = float(np.sqrt(np.square(pcm, dtype=np.float64).mean()))
    return f"{int(np.abs(x).max())}/{rms:.3f}/{int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))}"


def adpcm_files(sounds: list[np.ndarray], rate: int) -> list[bytes]:
    """ADPCM files of some sounds, coded across the blocks of all of them."""
    filled = [np.concatenate([x, np.full(-len(x) % PER_BLOCK, x[-1] if len(x) else 0, np.int16)]).reshape(-1, PER_BLOCK) for x in sounds]
    joined = np.concatenate([np.zeros((0, PER_BLOCK), np.int16), *filled])
    coded = np.concatenate([np.zeros((0, BLOCK), np.uint8), *(adpcm_coded(joined[i: i + BLOCKS_AT_ONCE]) for i in range(0, len(joined), BLOCKS_AT_ONCE))])
    cut = np.cumsum([len(f) for f in filled])[:-1]
    return [wave(IMA_ADPCM, c.tobytes(), rate, 4, BLOCK, len(x)) for c, x in zip(np.split(coded, cut), sounds, strict=True)] if sounds else []


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, n_bytes, media, adpcm: the text's bytes, padded to whole blocks, as mu-law samples of a WAVE file; and its sound at 6 kHz as ADPCM."""

    def files(batch: pa.RecordBatch) -> tuple[None, list]:
        sizes, media, coded = [], [], []
        held, n = [], 0
        for t in values(batch, "text"):
            d = (t or "").encode()
            d_all = d + b"\0" * (max(1, -(-len(d) // BLOCK)) * BLOCK - len(d))
            sizes.append(len(d))
            media.append(wave(MU_LAW, d_all))
            held.append(resampled(MU[np.frombuffer(d_all, np.uint8)], UP, DOWN))
            n += len(held[-1])
            if n >= PER_BLOCK * BLOCKS_AT_ONCE:
                coded, held, n = coded + adpcm_files(held, RATE * UP // DOWN), [], 0
        return None, [sizes, media, coded + adpcm_files(held, RATE * UP // DOWN)]

    return batched(docs.select(F.col("doc_id").cast("long"), "text"), ["doc_id"], "n_bytes long, media binary, adpcm binary", files)


def pcm_file(sound: np.ndarray, rate: int, up: int, down: int) -> bytes:
    """A 16-bit PCM file of a sound brought to up/down of its rate."""
    sound = sound if up == down else resampled(sound, up, down)
    return wave(PCM, sound.astype("<i2").tobytes(), rate * up // down, 16, 2)


def media_features(stored: DataFrame) -> DataFrame:
    """Digests of the stored files and of their samples read back, features of the sounds, and the resampled sound as a PCM file.

    feature: peak/rms/sign changes of the samples as mu-law at 8 kHz, then of the PCM at 6 kHz, then of that sound decoded from its
    ADPCM file, then of the same bytes read as A-law.
    """

    def features(batch: pa.RecordBatch) -> tuple[None, list]:
        rows, files, coded = [], values(batch, "media"), values(batch, "adpcm")
        parts = [parse_wave(m) for m in coded]
        blocks = [np.frombuffer(p[3], np.uint8).reshape(-1, p[2]) for p in parts]
        # ADPCM: blocks of many files at once.
        at, sizes, sounds = 0, [len(b) for b in blocks], []
        while at < len(blocks):
            end, n = at, 0
            while end < len(blocks) and (n == 0 or n + sizes[end] <= BLOCKS_AT_ONCE):
                n += sizes[end]
                end += 1
            joined = np.concatenate(blocks[at:end])
            read = np.concatenate([adpcm_blocks(joined[i: i + BLOCKS_AT_ONCE]) for i in range(0, max(1, len(joined)), BLOCKS_AT_ONCE)])
            cut = np.cumsum(sizes[at:end])[:-1]
            sounds += [level(d.ravel()[: sample_count(coded[at + k])]) for k, d in enumerate(np.split(read, cut))]
            at = end
        for media, sound in zip(files, sounds, strict=True):
            tag, rate, align, data = parse_wave(media)
            samples = expand(tag, align, data)
            pcm = pcm_file(samples, rate, UP, DOWN)
            _, to, _, slow = parse_wave(pcm)
            rows.append((
                len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(),
                f"mu={level(samples)};pcm{to}={level(np.frombuffer(slow, '<i2'))};adpcm{to}={sound};a={level(A[np.frombuffer(data, np.uint8)])}", pcm,
            ))
        return None, list(zip(*rows, strict=True)) or [[]] * 7

    schema = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm binary"
    return batched(stored, ["doc_id", "n_bytes"], schema, features)


def decoded(media: DataFrame, up: int = 1, down: int = 1) -> DataFrame:
    """(doc_id, media) -> doc_id, rate, pcm: the file expanded, resampled by up/down and stored as a 16-bit PCM file."""

    def sounds(batch: pa.RecordBatch) -> tuple[None, list]:
        rates, made = [], []
        for data in values(batch, "media"):
            tag, rate, align, samples = parse_wave(data) if data is not None else (None, None, None, None)
            rates.append(None if data is None else rate * up // down)
            made.append(None if data is None else pcm_file(expand(tag, align, samples), rate, up, down))
        return None, [rates, made]

    return batched(media.select("doc_id", "media"), ["doc_id"], "rate long, pcm binary", sounds)


def texts_as_audio(docs: DataFrame) -> DataFrame:
    """Store every text as a media column of a written table, its sound as ADPCM beside it, read both back, and describe them."""
    return media_features(written(store_texts(docs), "media"))
