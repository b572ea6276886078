"""Pixels: arithmetic as column expressions, kernels over whole images as functions of arrays behind Arrow."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def luma(r: Column, g: Column, b: Column) -> Column:
    """Whole-number luma: thousandths, rounded."""
    return F.floor((299 * r + 587 * g + 114 * b + 500) / 1000)


def blend_on_white(c: Column, alpha: Column) -> Column:
    return F.floor((c * alpha + 255 * (255 - alpha)) / 255)


def decodable(width: Column, height: Column, most: int) -> Column:
    return (width > 0) & (height > 0) & (width.cast("long") * height.cast("long") <= most)


def buffer_fits(width: Column, height: Column, stride: Column, channels: int, length: Column) -> Column:
    w, h, s = (c.cast("long") for c in (width, height, stride))
    return (w > 0) & (h > 0) & (s >= w * channels) & (length >= s * h)


def auto_background(pixels: DataFrame, by: list[str]) -> DataFrame:
    """Background of each image of pixels (r, g, b, a): white behind dark ones, black behind light ones, white where all is clear."""
    y = F.avg(F.when(F.col("a") > 0, 0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")))
    return pixels.groupBy(*by).agg(F.when(F.coalesce(y, F.lit(0.0)) < 128, 255).otherwise(0).alias("background"))


# --- kernels: height x width x channels


def pixels_of(data: bytes, width: int, height: int, stride: int, channels: int, bottom_up: bool = False, roi: tuple[int, int, int, int] | None = None) -> np.ndarray:
    rows = np.frombuffer(data, np.uint8, stride * height).reshape(height, stride)[:, : width * channels].reshape(height, width, channels)
    if bottom_up:
        rows = rows[::-1]
    if roi:
        x, y, w, h = roi
        if not (w > 0 and h > 0 and x + w <= width and y + h <= height):
            raise ValueError("the region is empty or outside the image")
        rows = rows[y : y + h, x : x + w]
    return rows


def flatten_alpha(rgba: np.ndarray, background: int | None = None) -> np.ndarray:
    """Colour over a plain background; None chooses it by the mean luma of what shows."""
    colour, alpha = rgba[..., :-1].astype(np.int64), rgba[..., -1:].astype(np.int64)
    if background is None:
        shown = rgba[alpha[..., 0] > 0][:, :-1].astype(float)
        mean = (shown @ np.array([0.299, 0.587, 0.114])).mean() if len(shown) and shown.shape[1] == 3 else shown.mean() if len(shown) else 0.0
        background = 255 if mean < 128 else 0
    return ((colour * alpha + background * (255 - alpha)) // 255).astype(np.uint8)


def swap_channels(image: np.ndarray) -> np.ndarray:
    return image[..., ::-1]


def gray_to_bgr(gray: np.ndarray) -> np.ndarray:
    return np.repeat(gray.reshape(*gray.shape[:2], 1), 3, axis=2)


def oriented(image: np.ndarray, orientation: int | None) -> np.ndarray:
    """The eight orientations of a camera's tag; any other is none."""
    turns = {2: lambda a: a[:, ::-1], 3: lambda a: a[::-1, ::-1], 4: lambda a: a[::-1], 5: lambda a: a.swapaxes(0, 1), 6: lambda a: np.rot90(a, -1), 7: lambda a: a[::-1, ::-1].swapaxes(0, 1), 8: lambda a: np.rot90(a)}
    return turns.get(orientation or 1, lambda a: a)(image)


def resize_linear(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear with half-pixel centres in whole numbers: weights of 11 bits, 4 bits dropped between rows and columns. Exact halving averages two by two with rounding."""
    h, w = image.shape[:2]
    if (h, w) == (height, width):
        return image
    a = image.astype(np.int64)
    if (h, w) == (2 * height, 2 * width):
        return ((a[::2, ::2] + a[1::2, ::2] + a[::2, 1::2] + a[1::2, 1::2] + 2) >> 2).astype(np.uint8)

    def places(n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
        at = ((np.arange(m) + 0.5) * (1.0 / (m / n)) - 0.5).astype(np.float32)
        return np.floor(at).astype(np.int64), at - np.floor(at)

    def weights(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.rint(f * np.float32(2048)).astype(np.int64) for f in (np.float32(1) - part, part))

    x, fx = places(w, width)
    fx[(x < 0) | (x >= w - 1)] = 0
    x = np.clip(x, 0, w - 1)
    (a0, a1), (y, fy) = weights(fx), places(h, height)
    rows = (a[:, x] * a0[:, None] + a[:, np.minimum(x + 1, w - 1)] * a1[:, None]) >> 4
    b0, b1 = (b[:, None, None] for b in weights(fy))
    out = ((b0 * rows[np.clip(y, 0, h - 1)] >> 16) + (b1 * rows[np.clip(y + 1, 0, h - 1)] >> 16) + 2) >> 2
    return np.clip(out, 0, 255).astype(np.uint8)


def reduce_box(image: np.ndarray, step_x: int, step_y: int) -> np.ndarray:
    """Means of boxes of step_x by step_y pixels, cut at the edges, in whole numbers: a multiplier of 24 bits stands for the division."""
    rows, cols = np.arange(0, image.shape[0], step_y), np.arange(0, image.shape[1], step_x)
    sums = np.add.reduceat(np.add.reduceat(image.astype(np.int64), rows, axis=0), cols, axis=1)
    area = np.minimum(step_y, image.shape[0] - rows)[:, None, None] * np.minimum(step_x, image.shape[1] - cols)[None, :, None]
    factor = (np.float32(1 << 32) / (area << 8).astype(np.float32)).astype(np.int64)
    return (((sums + area // 2) * factor) >> 24).astype(np.uint8)


def size_within(width: int, height: int, least: int, most: int) -> tuple[int, int]:
    """Sides in bounds: the longest down to `most`, then the shortest up to `least`; what is changed goes to multiples of 32, halves to even."""
    for bound, wrong, which in ((most, lambda: max(width, height) > most, max), (least, lambda: min(width, height) < least, min)):
        if wrong():
            ratio = np.float32(bound) / np.float32(which(width, height))
            side = lambda n: max(32, int(np.rint(np.float32(int(np.float32(n) * ratio)) / np.float32(32))) * 32)  # noqa: B023, E731
            width, height = side(width), side(height)
    return width, height


def normalized(image: np.ndarray, mean: float | list[float], std: float | list[float]) -> np.ndarray:
    """(x / 255 - mean) / std, channels first, single precision."""
    return ((image.astype(np.float32) / 255 - np.float32(mean)) / np.float32(std)).transpose(2, 0, 1)


def line_tensor(image: np.ndarray, max_ratio: float, shape: tuple[int, int, int] = (3, 48, 320)) -> np.ndarray:
    """A crop at the batch's height and width, -1 to 1, zeros to its right."""
    channels, height, _ = shape
    width = int(height * max_ratio)
    own = min(width, int(np.ceil(height * image.shape[1] / image.shape[0])))
    out = np.zeros((channels, height, width), np.float32)
    out[:, :, :own] = (resize_linear(image, own, height).astype(np.float32) / 127.5 - 1).transpose(2, 0, 1)
    return out


def pad_to_square(image: np.ndarray, side: int) -> np.ndarray:
    out = np.zeros((side, side, image.shape[2]), image.dtype)
    y, x = (side - image.shape[0]) // 2, (side - image.shape[1]) // 2
    out[y : y + image.shape[0], x : x + image.shape[1]] = image
    return out


def letterbox(width: int, height: int, side: int = 768) -> dict[str, float]:
    """Scale and padding that fit an image into a square; halves go away from zero."""
    away = lambda v: np.floor(v + 0.5)
    scale = min(side / width, side / height)
    w, h = away(width * scale), away(height * scale)
    return {"scale": scale, "width": w, "height": h, "left": away((side - w) / 2 - 0.1), "top": away((side - h) / 2 - 0.1)}


def crop_margin(image: np.ndarray, limit: float = 200.0) -> np.ndarray:
    """The box of what is darker than the limit once luma is stretched to 0 to 255; all of it if nothing is."""
    y = (image.astype(int) @ np.array([299, 587, 114]) + 500) // 1000
    if y.max() == y.min():
        return image
    dark = (y - y.min()) * 255.0 / (y.max() - y.min()) < limit
    rows, cols = np.flatnonzero(dark.any(1)), np.flatnonzero(dark.any(0))
    return image[rows[0] : rows[-1] + 1, cols[0] : cols[-1] + 1] if len(rows) else image


def stretch_contrast(image: np.ndarray) -> np.ndarray:
    """Channels (blue, green, red) stretched so that the least and largest whole-number luma become 0 and 255; halves go up."""
    single = image.astype(np.float32)
    y = np.floor(np.float32(0.114) * single[..., 0] + np.float32(0.587) * single[..., 1] + np.float32(0.299) * single[..., 2] + np.float32(0.5)).astype(np.int64)
    low, wide = int(y.min()), max(1, int(y.max()) - int(y.min()))
    return np.clip(np.floor(np.maximum(image.astype(np.int64) - low, 0).astype(np.float32) * np.float32(255) / np.float32(wide) + np.float32(0.5)), 0, 255).astype(np.uint8)


def threshold_mask(values: np.ndarray, limit: float) -> np.ndarray:
    return (values > limit).astype(np.uint8)


def dilate_2x2(mask: np.ndarray) -> np.ndarray:
    """Each pixel with those left, above and left above of it."""
    out = mask.copy()
    out[1:] |= mask[:-1]
    out[:, 1:] |= mask[:, :-1]
    out[1:, 1:] |= mask[:-1, :-1]
    return out


def masked_mean(values: np.ndarray, mask: np.ndarray) -> float:
    return float(values[mask > 0].mean(dtype=np.float64)) if (mask > 0).any() else 0.0


def contour_score(values: np.ndarray, contour: list[tuple[float, float]]) -> float:
    """Mean of a map inside a contour; 0 for fewer than three points or none inside."""
    return masked_mean(values, polygon_mask(contour, values.shape[1], values.shape[0])) if len(contour) > 2 else 0.0


def whitened(image: np.ndarray, polygons: list[list[tuple[float, float]]]) -> np.ndarray:
    """The image with polygons painted white; corners go to the nearest pixel, halves away from zero, and no further than the image."""
    out = image.copy()
    near = lambda v, most: min(max(float(np.copysign(np.floor(abs(v) + 0.5), v)), 0.0), float(most))
    for points in polygons:
        out[polygon_mask([(near(x, image.shape[1]), near(y, image.shape[0])) for x, y in points], image.shape[1], image.shape[0]) > 0] = 255
    return out


def polygon_mask(points: list[tuple[float, float]], width: int, height: int) -> np.ndarray:
    """Pixels inside or on a polygon of truncated corners, row by row."""
    pts = [(int(x), int(y)) for x, y in points]
    out = np.zeros((height, width), np.uint8)
    for y in range(height):
        cuts = []
        for (ax, ay), (bx, by) in zip(pts, pts[1:] + pts[:1], strict=True):
            if ay == by:
                if ay == y:
                    lo, hi = sorted((ax, bx))
                    out[y, max(lo, 0) : min(hi, width - 1) + 1] = 1
            elif min(ay, by) <= y <= max(ay, by):
                x = ax + (y - ay) * (bx - ax) / (by - ay)
                if y < max(ay, by):
                    cuts.append(x)
                if 0 <= round(x) < width:
                    out[y, round(x)] = 1
        for lo, hi in zip(*[iter(sorted(cuts))] * 2, strict=False):
            out[y, max(0, int(np.ceil(lo))) : min(width - 1, int(np.floor(hi))) + 1] = 1
    return out


def components_of(mask: np.ndarray) -> list[np.ndarray]:
    """Pixels (x, y) of each eight-connected part, in order of its first pixel."""
    seen, out = np.zeros(mask.shape, bool), []
    for y, x in np.argwhere(mask > 0):
        if seen[y, x]:
            continue
        stack, own = [(int(y), int(x))], []
        seen[y, x] = True
        while stack:
            v, u = stack.pop()
            own.append((u, v))
            for b in range(max(0, v - 1), min(mask.shape[0], v + 2)):
                for a in range(max(0, u - 1), min(mask.shape[1], u + 2)):
                    if mask[b, a] and not seen[b, a]:
                        seen[b, a] = True
                        stack.append((b, a))
        out.append(np.array(own))
    return out


def unclipped(quad: list[tuple[float, float]], ratio: float) -> list[tuple[float, float]]:
    """A rectangle grown on each side by area * ratio / perimeter: what rounded growth and a smallest rectangle around it come to."""
    pts = np.array(quad, float)
    u, v = pts[1] - pts[0], pts[3] - pts[0]
    w, h = float(np.hypot(*u)), float(np.hypot(*v))
    if not w or not h:
        return quad
    grow = w * h * ratio / (2 * (w + h))
    u, v = u / w * grow, v / h * grow
    return [tuple(p) for p in (pts[0] - u - v, pts[1] + u - v, pts[2] + u + v, pts[3] - u + v)]


def detect_boxes(
    prob: np.ndarray, limit: float = 0.3, box_limit: float = 0.6, least: float = 3.0, most: int = 1000, ratio: float = 1.6, size: tuple[int, int] | None = None
) -> list[tuple[list, float]]:
    """Boxes and mean probability of the parts of a map over the limit.

    Small parts go, then faint ones, then what is small after growing. Corners are scaled to size (width, height) with halves to even and kept inside it.
    """
    from pagelore.functions.geometry import min_area_rect_of

    height, width = prob.shape
    to_w, to_h = size or (width, height)
    short = lambda q: min(float(np.hypot(q[i][0] - q[i - 1][0], q[i][1] - q[i - 1][1])) for i in (1, 2))
    out = []
    for part in components_of(dilate_2x2(threshold_mask(prob, limit)))[:most]:
        quad = min_area_rect_of([tuple(map(float, p)) for p in part])
        if short(quad) < least:
            continue
        score = masked_mean(prob, polygon_mask(quad, width, height))
        if score < box_limit:
            continue
        quad = unclipped(quad, ratio)
        if short(quad) < least + 2:
            continue
        out.append(([(float(np.clip(np.rint(x * to_w / width), 0, to_w)), float(np.clip(np.rint(y * to_h / height), 0, to_h))) for x, y in quad], score))
    return out


#: Filters of resampling: reach in source pixels, and weight at a distance.
FILTERS = {
    "box": (0.5, lambda x: ((x > -0.5) & (x <= 0.5)) * 1.0),
    "linear": (1.0, lambda x: np.maximum(1 - np.abs(x), 0)),
    "cubic": (2.0, lambda x: np.where(np.abs(x) < 1, (1.5 * np.abs(x) - 2.5) * x**2 + 1, np.where(np.abs(x) < 2, ((-0.5 * np.abs(x) + 2.5) * np.abs(x) - 4) * np.abs(x) + 2, 0))),
    "lanczos": (3.0, lambda x: np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0)),
}


def resample(image: np.ndarray, width: int, height: int, kind: str = "linear", box: tuple[float, float, float, float] | None = None) -> np.ndarray:
    """Separable resampling of a box (x0, x1, y0, y1; the whole image) whose filter widens as the image shrinks; rows first, in whole numbers with weights of 22 bits."""
    x0, x1, y0, y1 = box or (0.0, float(image.shape[1]), 0.0, float(image.shape[0]))
    if (height, width) == image.shape[:2] and (x0, x1, y0, y1) == (0.0, image.shape[1], 0.0, image.shape[0]):
        return image

    def weights(n: int, start: float, end: float, m: int) -> np.ndarray:
        reach, f = FILTERS[kind]
        scale = (end - start) / m
        wide = max(scale, 1.0)
        centre = (start + (np.arange(m) + 0.5) * scale)[:, None]
        first = np.maximum(np.trunc(centre - reach * wide + 0.5), 0)
        last = np.minimum(np.trunc(centre + reach * wide + 0.5), n)
        at = np.arange(n)[None, :]
        w = np.where((at >= first) & (at < last), f((at - centre + 0.5) / wide), 0.0)
        total = w.sum(1, keepdims=True)
        w = np.divide(w, total, out=w, where=total != 0)
        return np.trunc(w * (1 << 22) + np.copysign(0.5, w)).astype(np.int64)

    rounded = lambda sums: np.clip((sums + (1 << 21)) >> 22, 0, 255)
    across = rounded(np.einsum("ij,hjc->hic", weights(image.shape[1], x0, x1, width), image.astype(np.int64)))
    return rounded(np.einsum("ij,jwc->iwc", weights(image.shape[0], y0, y1, height), across)).astype(np.uint8)


def thumbnail_size(width: int, height: int, most_width: int, most_height: int) -> tuple[int, int] | None:
    """The size that fits a box with the shape kept as nearly as whole sides can; None if the image fits as it is."""
    if most_width >= width and most_height >= height:
        return None
    shape, x, y = width / height, float(most_width), float(most_height)
    nearest = lambda v, error: max(1.0, min((np.floor(v), np.ceil(v)), key=error))
    if x / y >= shape:
        x = nearest(y * shape, lambda n: abs(shape - n / y))
    else:
        y = nearest(x / shape, lambda n: abs(shape - x / n) if n else 0.0)
    return int(x), int(y)


def thumbnail(image: np.ndarray, width: int, height: int, kind: str = "cubic") -> np.ndarray:
    """The image as large as fits, its shape kept; never enlarged. Boxes of whole pixels are averaged first where it shrinks fourfold or more."""
    h, w = image.shape[:2]
    size = thumbnail_size(w, h, width, height)
    if size is None or size == (w, h):
        return image
    step_x, step_y = (max(1, int(n / m / 2)) for n, m in ((w, size[0]), (h, size[1])))
    small = reduce_box(image, step_x, step_y) if step_x > 1 or step_y > 1 else image
    return resample(small, *size, kind, (0.0, w / step_x, 0.0, h / step_y))


def cubic_weights(parts: int = 32, scale: int = 1 << 15, a: float = -0.75) -> np.ndarray:
    """parts x parts x 4 x 4 weights of bicubic sampling between pixels, as whole numbers that sum to `scale`.

    What rounding leaves over goes to the largest of the four weights next to the place, or is taken from the least of them.
    """
    t = np.arange(parts, dtype=np.float32) / np.float32(parts)
    far = lambda x: ((a * x - 5 * a) * x + 8 * a) * x - 4 * a
    close = lambda x: ((a + 2) * x - (a + 3)) * x * x + 1
    line = np.stack([far(t + 1), close(t), close(1 - t)], 1).astype(np.float32)
    line = np.concatenate([line, 1 - line.sum(1, keepdims=True, dtype=np.float32)], 1)
    table = np.clip(np.rint(line[:, None, :, None] * line[None, :, None, :] * np.float32(scale)), -(1 << 15), (1 << 15) - 1).astype(np.int64)
    for own in table.reshape(-1, 4, 4):
        over = int(own.sum()) - scale
        if over:
            inner = own[2:, 2:]
            at = np.unravel_index((np.argmax if over < 0 else np.argmin)(inner), inner.shape)
            inner[at] = np.clip(inner[at] - over, -(1 << 15), (1 << 15) - 1)
    return table


def sample_cubic(image: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The image at places (u, v) to a thirty-second of a pixel; edges repeated."""
    weights = cubic_weights()
    fx, fy = np.rint(u * 32).astype(np.int64), np.rint(v * 32).astype(np.int64)
    near = weights[fy & 31, fx & 31]
    around = np.arange(-1, 3)
    ys = np.clip((fy >> 5)[..., None] + around, 0, image.shape[0] - 1)
    xs = np.clip((fx >> 5)[..., None] + around, 0, image.shape[1] - 1)
    taken = image.astype(np.int64)[ys[..., :, None], xs[..., None, :]]
    return np.clip((np.einsum("...abc,...ab->...c", taken, near) + (1 << 14)) >> 15, 0, 255).astype(np.uint8)


def make_batch(images: list[np.ndarray], max_ratio: float, shape: tuple[int, int, int] = (3, 48, 320)) -> np.ndarray:
    """Crops as one tensor: images x channels x height x width, each as line_tensor has it; no narrower than the shape says."""
    ratio = max(max_ratio, shape[2] / shape[1])
    return np.stack([line_tensor(image, ratio, shape) for image in images]) if images else np.zeros((0, *shape), np.float32)


def perspective_crop(image: np.ndarray, quad: list[tuple[float, float]], cubic: bool = False) -> np.ndarray:
    """What a quad holds, upright: linear or cubic between pixels, edges repeated; turned by a quarter if it is half again as high as wide."""
    from pagelore.functions.geometry import homography_of

    (tl, tr, br, bl) = quad
    far = lambda a, b: float(np.hypot(a[0] - b[0], a[1] - b[1]))
    width, height = max(1, int(max(far(tl, tr), far(bl, br)))), max(1, int(max(far(tl, bl), far(tr, br))))
    m = np.array(homography_of([(0, 0), (width, 0), (width, height), (0, height)], quad)).reshape(3, 3)
    ys, xs = np.mgrid[0:height, 0:width].astype(float)
    u, v, w = np.einsum("ij,jhw->ihw", m, np.stack([xs, ys, np.ones_like(xs)]))
    u, v = u / w, v / w
    if cubic:
        out = sample_cubic(image, u, v)
        return np.rot90(out) if height / width >= 1.5 else out
    u, v = np.clip(u, 0, image.shape[1] - 1), np.clip(v, 0, image.shape[0] - 1)
    x0, y0 = np.floor(u).astype(int), np.floor(v).astype(int)
    x1, y1 = np.minimum(x0 + 1, image.shape[1] - 1), np.minimum(y0 + 1, image.shape[0] - 1)
    fx, fy, a = (u - x0)[..., None], (v - y0)[..., None], image.astype(float)
    out = np.rint((a[y0, x0] * (1 - fx) + a[y0, x1] * fx) * (1 - fy) + (a[y1, x0] * (1 - fx) + a[y1, x1] * fx) * fy).astype(np.uint8)
    return np.rot90(out) if height / width >= 1.5 else out


def draw_outlines(image: np.ndarray, quads: list[list[tuple[float, float]]], colors: list[tuple[int, int, int]]) -> np.ndarray:
    """The image with the quads' sides drawn, colours in turn."""
    out = image.copy()
    for k, quad in enumerate(quads):
        for (ax, ay), (bx, by) in zip(quad, quad[1:] + quad[:1], strict=True):
            n = int(max(abs(bx - ax), abs(by - ay))) + 1
            x, y = np.rint(np.linspace(ax, bx, n)).astype(int), np.rint(np.linspace(ay, by, n)).astype(int)
            good = (x >= 0) & (y >= 0) & (x < out.shape[1]) & (y < out.shape[0])
            out[y[good], x[good]] = colors[k % len(colors)]
    return out


def map_images(df: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], *, channels: int = 3) -> DataFrame:
    """df with w, h and data (tight rows) of each image after the kernel; its other columns as they are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            images = [kernel(pixels_of(b, w, h, w * channels, channels)) for b, w, h in zip(pdf["data"], pdf["w"], pdf["h"], strict=True)]
            yield pdf.assign(data=[np.ascontiguousarray(i).tobytes() for i in images], w=[i.shape[1] for i in images], h=[i.shape[0] for i in images])

    return df.mapInPandas(run, df.schema)


def with_model(df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """df through a model that each Python worker loads once a task; what it is comes from the caller."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            yield model(pdf)

    return df.mapInPandas(run, schema)


def constant_model(columns: dict[str, object]) -> Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]:
    """A loader for with_model whose model says the same of every row: it stands in where there is no model file."""

    def load() -> Callable[[pd.DataFrame], pd.DataFrame]:
        return lambda pdf: pdf.assign(**{name: [value] * len(pdf) for name, value in columns.items()})

    return load
