"""Pictures to the tensors that detection, embedding and text models take, in numpy.

A picture is an array (height, width, 3) of bytes; a tensor is (1, 3, height, width) of floats.
"""

from __future__ import annotations

import math

import numpy as np

# Sizes, and means and deviations of the colours, as the models were trained.
DETECTOR = 640
EMBEDDING = 224
EMBEDDING_MEAN, EMBEDDING_STD = (0.48145466, 0.4578275, 0.40821073), (0.26862954, 0.26130258, 0.27577711)
TEXT_SIDE = 960
TEXT_MEAN, TEXT_STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
LINE_HEIGHT, LINE_LEAST, LINE_MOST = 48, 24, 1280


def _triangle(x: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, 1.0 - np.abs(x))


def _lanczos(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)


def _weights(size: int, to: int, kernel) -> np.ndarray:
    """The share of each of ``size`` places in each of ``to``; the kernel widens where a side shrinks."""
    scale = max(1.0, size / to)
    centre = (np.arange(to) + 0.5) * size / to - 0.5
    w = kernel((np.arange(size)[None, :] - centre[:, None]) / scale)
    return w / w.sum(1, keepdims=True)


def resized(picture: np.ndarray, width: int, height: int, smooth: bool = False) -> np.ndarray:
    """The picture at another size: by a triangle, or by the smoother Lanczos kernel."""
    kernel = _lanczos if smooth else _triangle
    rows, cols = _weights(picture.shape[0], height, kernel), _weights(picture.shape[1], width, kernel)
    out = np.einsum("hy,yxc->hxc", rows, np.einsum("wx,yxc->ywc", cols, picture.astype(np.float64)))
    return np.clip(np.round(out), 0, 255).astype(np.uint8)


def tensor(picture: np.ndarray, mean=(0.0, 0.0, 0.0), std=(1.0, 1.0, 1.0)) -> np.ndarray:
    x = (picture.astype(np.float32) / np.float32(255) - np.float32(mean)) / np.float32(std)
    return np.ascontiguousarray(x.transpose(2, 0, 1)[None])


def for_detection(picture: np.ndarray) -> np.ndarray:
    """The whole picture in the middle of a black square; a small one isn't enlarged."""
    h, w = picture.shape[:2]
    share = min(1.0, DETECTOR / max(h, w))
    w2, h2 = max(1, round(w * share)), max(1, round(h * share))
    out = np.zeros((DETECTOR, DETECTOR, 3), np.uint8)
    top, left = (DETECTOR - h2) // 2, (DETECTOR - w2) // 2
    out[top : top + h2, left : left + w2] = picture if share == 1.0 else resized(picture, w2, h2, smooth=True)
    return tensor(out)


def for_embedding(picture: np.ndarray) -> np.ndarray:
    """The middle square of the picture with its short side at the model's size."""
    h, w = picture.shape[:2]
    side = EMBEDDING / min(h, w)
    small = resized(picture, max(EMBEDDING, round(w * side)), max(EMBEDDING, round(h * side)), smooth=True)
    top, left = (small.shape[0] - EMBEDDING) // 2, (small.shape[1] - EMBEDDING) // 2
    return tensor(small[top : top + EMBEDDING, left : left + EMBEDDING], EMBEDDING_MEAN, EMBEDDING_STD)


def text_size(width: int, height: int) -> tuple[int, int]:
    """The size for text detection: the long side at most ``TEXT_SIDE``, both multiples of 32, 32 at least."""
    share = min(1.0, TEXT_SIDE / max(width, height))
    return tuple(max(32, 32 * math.floor(x * share / 32 + 0.5)) for x in (width, height))


def for_text(picture: np.ndarray) -> np.ndarray:
    return tensor(resized(picture, *text_size(picture.shape[1], picture.shape[0])), TEXT_MEAN, TEXT_STD)


def line_width(width: int, height: int) -> int:
    """A line's width at the recogniser's height, within what it takes."""
    return min(LINE_MOST, max(LINE_LEAST, math.ceil(LINE_HEIGHT * width / height)))


def for_line(crop: np.ndarray) -> np.ndarray | None:
    """A cut-out line for recognition, values from -1 to 1; nothing for an empty one."""
    h, w = crop.shape[:2]
    if not h or not w:
        return None
    return tensor(resized(crop, line_width(w, h), LINE_HEIGHT), (0.5,) * 3, (0.5,) * 3)
