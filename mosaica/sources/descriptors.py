"""Default descriptors in NumPy: MFCC of WAV files, gradient histograms of PNG, PGM and PPM files.

Other formats need a decoder that is not at hand: ``sources.media.descriptors`` takes any extractor.  A file that
cannot be read has no descriptors.
"""

from __future__ import annotations

import io
import struct
import wave
import zlib

import numpy as np

RATE, SECONDS, HOP, WINDOW, MELS, COEFFICIENTS = 22050, 10.0, 512, 2048, 128, 20
KEYPOINTS, CELL = 2000, 4


# ---- audio


def samples(content: bytes) -> np.ndarray:
    """Mono samples between -1 and 1 at ``RATE``, ``SECONDS`` of them at most."""
    with wave.open(io.BytesIO(content)) as f:
        rate, channels, width = f.getframerate(), f.getnchannels(), f.getsampwidth()
        raw = f.readframes(int(SECONDS * rate))
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) ^ 0x800000).astype(np.float64) / 0x800000 - 1
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(np.float64) / (1 << (8 * width - 1))
    x = x[: len(x) // channels * channels].reshape(-1, channels).mean(1)
    n = int(len(x) * RATE / rate)
    return np.interp(np.arange(n) * rate / RATE, np.arange(len(x)), x) if n and rate != RATE else x


def mel_filters() -> np.ndarray:
    """Triangles of equal area on the mel scale that is linear to 1 kHz and logarithmic beyond."""
    step = np.log(6.4) / 27
    to_mel = lambda f: np.where(f < 1000, f * 3 / 200, 15 + np.log(np.maximum(f, 1) / 1000) / step)
    to_hz = lambda m: np.where(m < 15, m * 200 / 3, 1000 * np.exp(step * (m - 15)))
    edges = to_hz(np.linspace(0, to_mel(np.array(RATE / 2.0)), MELS + 2))
    bins = np.linspace(0, RATE / 2, WINDOW // 2 + 1)
    up = (bins[None, :] - edges[:-2, None]) / np.diff(edges)[:-1, None]
    down = (edges[2:, None] - bins[None, :]) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def mfcc(content: bytes) -> np.ndarray:
    """(frames, 20) cepstral coefficients of a WAV file."""
    try:
        x = samples(content)
    except (wave.Error, EOFError, KeyError, ValueError, struct.error):
        return np.zeros((0, COEFFICIENTS), np.float32)
    if not len(x):
        return np.zeros((0, COEFFICIENTS), np.float32)
    x = np.pad(x, WINDOW // 2)
    frames = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::HOP]
    power = np.abs(np.fft.rfft(frames * np.hanning(WINDOW + 1)[:-1], axis=1)) ** 2
    level = 10 * np.log10(np.maximum(power @ mel_filters().T, 1e-10))
    level = np.maximum(level, level.max() - 80)
    n, k = np.arange(MELS), np.arange(COEFFICIENTS)
    basis = np.sqrt(2 / MELS) * np.cos(np.pi * k[:, None] * (2 * n[None, :] + 1) / (2 * MELS))
    basis[0] /= np.sqrt(2)
    return (level @ basis.T).astype(np.float32)


# ---- images


def grey(content: bytes) -> np.ndarray:
    """Brightness of a PNG (8 bits, not interlaced), PGM or PPM file."""
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        pixels = png(content)
    elif content[:2] in (b"P5", b"P6"):
        head = content.split(maxsplit=4)
        width, height, depth = int(head[1]), int(head[2]), 3 if head[0] == b"P6" else 1
        raw = content[len(content) - width * height * depth :]
        pixels = np.frombuffer(raw, np.uint8).reshape(height, width, depth)
    else:
        raise ValueError("no known image")
    x = pixels.astype(np.float64)
    return x[:, :, :3] @ [0.299, 0.587, 0.114] if x.shape[2] >= 3 else x[:, :, 0]


def png(content: bytes) -> np.ndarray:
    at, data, width, height, kind = 8, b"", 0, 0, 0
    while at < len(content):
        size, name = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + size]
        if name == b"IHDR":
            width, height, bits, kind, _, _, laced = struct.unpack(">IIBBBBB", body)
            if bits != 8 or laced or kind not in (0, 2, 4, 6):
                raise ValueError("this kind of PNG is not read")
        elif name == b"IDAT":
            data += body
        at += size + 12
    depth = {0: 1, 2: 3, 4: 2, 6: 4}[kind]
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, 1 + width * depth)
    out, above = np.zeros((height, width, depth), np.uint8), np.zeros((width, depth), np.int32)
    for y, line in enumerate(lines):
        x = line[1:].reshape(width, depth).astype(np.int32)
        if line[0] == 1:
            x = np.cumsum(x, axis=0)
        elif line[0] == 2:
            x = x + above
        elif line[0] in (3, 4):
            left = corner = np.zeros(depth, np.int32)
            for i in range(width):
                up = above[i]
                if line[0] == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    a, b, c = abs(p - left), abs(p - up), abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                x[i] = left = (x[i] + guess) & 255
                corner = up
        above = x & 255
        out[y] = above
    return out


def gradient_histograms(content: bytes) -> np.ndarray:
    """(patches, 128) root-normalised histograms of gradient directions, 4 x 4 cells of 8 directions a patch.

    Patches lie on a grid at three scales; the ``KEYPOINTS`` of the largest response stay.
    """
    try:
        image = grey(content)
    except (ValueError, IndexError, KeyError, struct.error, zlib.error):
        return np.zeros((0, 128), np.float32)
    found, response = [], []
    for scale in (1, 2, 4):
        h, w = image.shape[0] // scale, image.shape[1] // scale
        if min(h, w) < 4 * CELL + 2:
            break
        small = image[: h * scale, : w * scale].reshape(h, scale, w, scale).mean((1, 3))
        dy, dx = np.gradient(small)
        size, turn = np.hypot(dx, dy), ((np.arctan2(dy, dx) + 2 * np.pi) / (np.pi / 4)) % 8
        low = np.floor(turn).astype(np.int64) % 8
        share = turn - np.floor(turn)
        rows, columns = h // CELL, w // CELL
        cells = np.zeros((rows, columns, 8))
        y, x = np.mgrid[: rows * CELL, : columns * CELL]
        inside = (slice(rows * CELL), slice(columns * CELL))
        np.add.at(cells, (y // CELL, x // CELL, low[inside]), (size * (1 - share))[inside])
        np.add.at(cells, (y // CELL, x // CELL, (low[inside] + 1) % 8), (size * share)[inside])
        patches = np.lib.stride_tricks.sliding_window_view(cells, (4, 4), axis=(0, 1)).transpose(0, 1, 3, 4, 2).reshape(-1, 128)
        found.append(patches)
        response.append(patches.sum(1))
    if not found:
        return np.zeros((0, 128), np.float32)
    d, r = np.concatenate(found), np.concatenate(response)
    best = np.argsort(-r, kind="stable")[:KEYPOINTS]
    d = d[best][r[best] > 1e-9]
    return np.sqrt(d / np.maximum(d.sum(1, keepdims=True), 1e-12)).astype(np.float32)
