"""Kernels on pixel and probability arrays, for use in Arrow UDFs once an image is decoded."""

from __future__ import annotations

import numpy as np

# The input that the image encoder expects.
SIDE, GREY = 224, 127
CHANNEL_MEAN = (0.48145466, 0.4578275, 0.40821073)
CHANNEL_STD = (0.26862954, 0.26130258, 0.27577711)
MAX_PIXEL_BYTES = 200 << 20
TOP_COLORS, LEAST_SHARE, SAMPLE_SIDE = 5, 0.03, 48


def _weights(old: int, new: int) -> np.ndarray:
    """Rows of triangle-filter weights from old samples to new ones; the filter widens when shrinking."""
    ratio = old / new
    reach = max(ratio, 1.0)
    centre = (np.arange(new)[:, None] + 0.5) * ratio - 0.5
    w = np.maximum(0, 1 - np.abs(np.arange(old)[None, :] - centre) / reach)
    return w / w.sum(axis=1, keepdims=True)


def resize(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """An image (rows, columns[, channels]) at another size."""
    tall = np.tensordot(_weights(pixels.shape[0], height), pixels.astype(np.float64), axes=(1, 0))
    wide = np.tensordot(_weights(pixels.shape[1], width), tall, axes=(1, 1))
    return np.clip(np.round(np.swapaxes(wide, 0, 1)), 0, 255).astype(np.uint8)


def fits(width: int, height: int) -> bool:
    return width * height * 4 <= MAX_PIXEL_BYTES


def luma(rgb: np.ndarray) -> np.ndarray:
    return (rgb.astype(np.float64) @ np.array([0.2126, 0.7152, 0.0722])).astype(np.uint8)


def difference_hash(rgb: np.ndarray) -> int:
    """64 signs of neighbours in a 9 by 8 grey image, first pair highest; as a signed number."""
    small = resize(luma(rgb), 9, 8).astype(np.int16)
    bits = (small[:, :-1] > small[:, 1:]).ravel()
    return int(np.packbits(bits).view(">u8")[0].astype(np.int64))


def dominant_colors(rgb: np.ndarray) -> list[tuple[str, float]]:
    """Up to five (hex, share) of bins of four bits a channel, each with its mean colour."""
    rows = (np.arange(SAMPLE_SIDE) + 0.5) * rgb.shape[0] / SAMPLE_SIDE
    columns = (np.arange(SAMPLE_SIDE) + 0.5) * rgb.shape[1] / SAMPLE_SIDE
    small = rgb[rows.astype(int)][:, columns.astype(int)].reshape(-1, 3).astype(np.int64)
    key = (small[:, 0] >> 4 << 8) | (small[:, 1] >> 4 << 4) | small[:, 2] >> 4
    bins, place, n = np.unique(key, return_inverse=True, return_counts=True)
    sums = np.zeros((len(bins), 3), dtype=np.int64)
    np.add.at(sums, place, small)
    order = np.argsort(-n, kind="stable")[:TOP_COLORS]
    return [("#%02x%02x%02x" % tuple(sums[i] // n[i]), round(n[i] / len(small), 3)) for i in order if n[i] / len(small) >= LEAST_SHARE]


def encoder_input(rgb: np.ndarray) -> np.ndarray:
    """The whole image on a grey square, normalised, channels first."""
    scale = SIDE / max(rgb.shape[:2])
    height, width = (max(1, round(s * scale)) for s in rgb.shape[:2])
    canvas = np.full((SIDE, SIDE, 3), GREY, dtype=np.uint8)
    top, left = (SIDE - height) // 2, (SIDE - width) // 2
    canvas[top : top + height, left : left + width] = resize(rgb, width, height)
    return ((canvas / 255.0 - CHANNEL_MEAN) / CHANNEL_STD).astype(np.float32).transpose(2, 0, 1)


def crop(rgb: np.ndarray, x: float, y: float, w: float, h: float) -> np.ndarray:
    """The part within a rectangle given as shares of the sides."""
    height, width = rgb.shape[:2]
    return rgb[round(y * height) : max(round(y * height) + 1, round((y + h) * height)), round(x * width) : max(round(x * width) + 1, round((x + w) * width))]


def tiles(width: int, height: int, overlap: int = 120) -> list[tuple[int, int]]:
    """(top, height) of the strips in which a tall image is read; others are read whole."""
    if not (height > 2400 and height > 2.2 * width):
        return [(0, height)]
    strip = max(1400, int(1.25 * width))
    return [(top, min(strip, height - top)) for top in range(0, max(1, height - overlap), strip - overlap)]


def reading_scale(width: int, height: int, most: int = 4_000) -> float:
    """By how much an image is made smaller before it is read."""
    return min(1.0, most / max(width, height))


def owned_lines(strips: list[tuple[int, int]], lines: list[list[dict]]) -> list[dict]:
    """The lines of all strips in the whole image's pixels, from lines (t, x, y, w, h) in pixels of their strips.

    Where strips overlap, a line is of the strip in whose half of the overlap its middle lies, so it
    comes once. Lines of one character are left out.
    """
    out = []
    for i, ((top, height), own) in enumerate(zip(strips, lines)):
        first = 0 if i == 0 else (top + strips[i - 1][0] + strips[i - 1][1]) / 2
        last = float("inf") if i + 1 == len(strips) else (strips[i + 1][0] + top + height) / 2
        for line in own:
            y = line["y"] + top
            if first <= y + line["h"] / 2 < last and len(line["t"].strip()) > 1:
                out.append(line | {"y": y})
    return out


def text_boxes(probability: np.ndarray, threshold: float = 0.3, least_mean: float = 0.6, unclip: float = 1.5, least_side: int = 3) -> list[tuple[float, float, float, float]]:
    """(x, y, w, h) around connected cells above the threshold, grown by area times unclip over perimeter."""
    on = probability > threshold
    label = np.where(on, np.arange(1, on.size + 1).reshape(on.shape), 0)
    while True:
        new = label.copy()
        for ahead, back in (((slice(1, None), slice(None)), (slice(None, -1), slice(None))), ((slice(None), slice(1, None)), (slice(None), slice(None, -1)))):
            both = on[ahead] & on[back]
            low = np.maximum(new[ahead], new[back])
            new[ahead] = np.where(both, low, new[ahead])
            new[back] = np.where(both, low, new[back])
        if np.array_equal(new, label):
            break
        label = new
    out = []
    for name in np.unique(label[label > 0]):
        ys, xs = np.nonzero(label == name)
        w, h = xs.max() - xs.min() + 1, ys.max() - ys.min() + 1
        if probability[ys, xs].mean() < least_mean or min(w, h) < least_side:
            continue
        grow = w * h * unclip / (2 * (w + h))
        left, top = max(0.0, xs.min() - grow), max(0.0, ys.min() - grow)
        out.append((left, top, min(probability.shape[1], xs.max() + 1 + grow) - left, min(probability.shape[0], ys.max() + 1 + grow) - top))
    return out


def ctc_greedy(probability: np.ndarray, alphabet: list[str]) -> tuple[str, float] | None:
    """The likeliest symbols without blanks (class 0) and repeats, and their mean probability."""
    best = probability.argmax(axis=1)
    new = (best != 0) & (best != np.concatenate([[0], best[:-1]])) & (best <= len(alphabet))
    if not new.any():
        return None
    return "".join(alphabet[i - 1] for i in best[new]), float(probability.max(axis=1)[new].mean())


def floats_from_bytes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype="<f4")


def bytes_from_floats(v) -> bytes:
    return np.asarray(v, dtype="<f4").tobytes()
