"""Array kernels for rasters: spectrum, JPEG loss, error levels, degradations. numpy only; used inside Arrow UDFs."""

from __future__ import annotations

import numpy as np

# The spectrum's side, rings and floor of power; error levels: JPEG quality, share of the side that a mean
# spans, least span, floor of the median, percentile, middle and width of its score, ratios of no heat and of full heat.
SIDE, BINS, POWER_FLOOR = 256, 32, 1e-8
ELA_QUALITY, ELA_SPANS, ELA_LEAST, ELA_FLOOR, ELA_RANK, ELA_MIDDLE, ELA_WIDTH, ELA_RANGE = 90, 24, 3, 1e-3, 99, 5.0, 0.8, (1.0, 4.0)
# The standard luminance and chrominance quantisation tables of JPEG (quality 50).
LUMA = np.array([
    [16, 11, 10, 16, 24, 40, 51, 61], [12, 12, 14, 19, 26, 58, 60, 55], [14, 13, 16, 24, 40, 57, 69, 56], [14, 17, 22, 29, 51, 87, 80, 62],
    [18, 22, 37, 56, 68, 109, 103, 77], [24, 35, 55, 64, 81, 104, 113, 92], [49, 64, 78, 87, 103, 121, 120, 101], [72, 92, 95, 98, 112, 100, 103, 99],
], np.float64)
CHROMA = np.full((8, 8), 99.0)
CHROMA[:4, :4] = [[17, 18, 24, 47], [18, 21, 26, 66], [24, 26, 56, 99], [47, 66, 99, 99]]

_k = np.arange(8)
_DCT = np.sqrt(np.where(_k == 0, 1, 2) / 8)[:, None] * np.cos((2 * _k + 1) * _k[:, None] * np.pi / 16)


def luma(rgb: np.ndarray) -> np.ndarray:
    return rgb.astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def _linear(t: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, 1 - np.abs(t))


def _cubic(t: np.ndarray) -> np.ndarray:
    """Keys' interpolation kernel for a = -1/2."""
    t = np.abs(t)
    inner, outer = (1.5 * t - 2.5) * t * t + 1, ((-0.5 * t + 2.5) * t - 4) * t + 2
    return np.where(t < 1, inner, np.where(t < 2, outer, 0.0))


def _weights(of: int, to: int, kernel) -> np.ndarray:
    """(to, of): what each input adds to each output; where an axis shrinks, the kernel is as much wider."""
    wide = max(1.0, of / to)
    centre = (np.arange(to) + 0.5) * of / to - 0.5
    w = kernel((np.arange(of) - centre[:, None]) / wide)
    return w / w.sum(1, keepdims=True)


def resize(a: np.ndarray, height: int, width: int, cubic: bool = False) -> np.ndarray:
    """Bilinear or bicubic, weighted over the area that an output pixel covers."""
    kernel = _cubic if cubic else _linear
    rows = np.tensordot(_weights(a.shape[0], height, kernel), a, 1)
    return np.moveaxis(np.tensordot(_weights(a.shape[1], width, kernel), rows, (1, 1)), 0, 1)


def _half_plane() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first, share) of the cells of a real transform: by ring, where rings begin, each cell's share of its ring's mean.

    A real image's spectrum is symmetric, so all columns but the first and the last count twice.
    """
    y, x = np.fft.fftfreq(SIDE, 1 / SIDE)[:, None], np.arange(SIDE // 2 + 1)
    ring = np.minimum(np.hypot(y, x) * BINS // (SIDE // 2), BINS - 1).astype(int).ravel()
    times = np.broadcast_to(np.where((x == 0) | (x == SIDE // 2), 1.0, 2.0), (SIDE, len(x))).ravel()
    order = np.argsort(ring, kind="stable")
    share = times / np.bincount(ring, times)[ring]
    return order, np.searchsorted(ring[order], np.arange(BINS)), share[order]


_ORDER, _FIRST, _SHARE = _half_plane()
_TAPER = np.multiply.outer(np.hanning(SIDE), np.hanning(SIDE))


def spectra(images: list[np.ndarray]) -> np.ndarray:
    """(images, BINS): the mean log power of each ring of frequencies, less that of the innermost one."""
    planes = np.stack([resize(luma(x), SIDE, SIDE, cubic=True) for x in images])
    waves = np.fft.rfft2((planes - planes.mean((1, 2), keepdims=True)) * _TAPER).reshape(len(images), -1)
    power = np.log(waves.real**2 + waves.imag**2 + POWER_FLOOR)
    rings = np.add.reduceat(power[:, _ORDER] * _SHARE, _FIRST, axis=1)
    return rings - rings[:, :1]


def tables(quality: int) -> tuple[np.ndarray, np.ndarray]:
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    return tuple(np.clip(np.floor((t * scale + 50) / 100), 1, 255) for t in (LUMA, CHROMA))


def _lossy(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
    h, w = plane.shape
    p = np.pad(plane, ((0, -h % 8), (0, -w % 8)), mode="edge") - 128
    b = p.reshape(p.shape[0] // 8, 8, p.shape[1] // 8, 8).swapaxes(1, 2)
    c = np.round(_DCT @ b @ _DCT.T / table) * table
    out = (_DCT.T @ c @ _DCT).swapaxes(1, 2).reshape(p.shape)
    return out[:h, :w] + 128


def jpeg(rgb: np.ndarray, quality: int) -> np.ndarray:
    """What JPEG at a quality, with chroma at half size, makes of an image; its lossless coding is left out."""
    x = rgb.astype(np.float64)
    y = luma(rgb)
    cb, cr = 128 + (x[..., 2] - y) / 1.772, 128 + (x[..., 0] - y) / 1.402
    light, colour = tables(quality)
    h, w = y.shape
    y = _lossy(y, light)

    def half(c: np.ndarray) -> np.ndarray:
        c = np.pad(c, ((0, h % 2), (0, w % 2)), mode="edge")
        small = c.reshape(c.shape[0] // 2, 2, c.shape[1] // 2, 2).mean((1, 3))
        return resize(_lossy(small, colour), *c.shape)[:h, :w]

    cb, cr = half(cb) - 128, half(cr) - 128
    out = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], -1)
    return np.clip(np.round(out), 0, 255).astype(np.uint8)


def box_mean(a: np.ndarray, size: int) -> np.ndarray:
    """Mean over size x size neighbours, the image mirrored at its edges."""
    before, after = size // 2, size - 1 - size // 2
    s = np.pad(np.pad(a, ((before, after), (before, after)), mode="symmetric").cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return (s[size:, size:] - s[:-size, size:] - s[size:, :-size] + s[:-size, :-size]) / size**2


def error_ratio(rgb: np.ndarray) -> np.ndarray:
    """How much more than usual in this image its surroundings lose at each place by one more JPEG."""
    lost = np.abs(np.subtract(jpeg(rgb, ELA_QUALITY), rgb, dtype=np.float64)).mean(-1)
    around = box_mean(lost, max(ELA_LEAST, min(lost.shape) // ELA_SPANS))
    return around / (np.median(around) + ELA_FLOOR)


def error_peak(rgb: np.ndarray) -> float:
    """The ratio that one place in a hundred exceeds; scores.ela_score makes a score of it."""
    return float(np.percentile(error_ratio(rgb), ELA_RANK))


def error_heat(rgb: np.ndarray) -> np.ndarray:
    return np.interp(error_ratio(rgb), ELA_RANGE, (0.0, 1.0))


def downscale(rgb: np.ndarray, factor: float = 0.5) -> np.ndarray:
    h, w = (max(1, int(n * factor)) for n in rgb.shape[:2])
    return np.clip(np.round(resize(rgb.astype(np.float64), h, w)), 0, 255).astype(np.uint8)


def contrast(rgb: np.ndarray) -> float:
    """The deviation of the luma, at most 1: a score that needs no model."""
    return float(min(1.0, luma(rgb).std() / 128))


def crop(rgb: np.ndarray, box: tuple[int, int, int, int], side: int = 224) -> np.ndarray:
    """The part of an image in (x0, y0, x1, y1), resized to a square, after one JPEG round trip that levels out file formats."""
    x0, y0, x1, y1 = box
    part = resize(rgb[y0:y1, x0:x1].astype(np.float64), side, side, cubic=True)
    return jpeg(np.clip(np.round(part), 0, 255).astype(np.uint8), 75)


def splice(rgb: np.ndarray, seed: int) -> np.ndarray:
    """The image with a patch of itself, an eighth to a quarter of its shorter side, recompressed and pasted elsewhere."""
    rng = np.random.default_rng(seed)
    h, w = rgb.shape[:2]
    short = min(h, w)
    size = int(rng.integers(max(1, short // 8), max(2, short // 4 + 1)))
    y, x, to_y, to_x = (int(rng.integers(0, n - size + 1)) for n in (h, w, h, w))
    out = rgb.copy()
    out[to_y : to_y + size, to_x : to_x + size] = jpeg(rgb[y : y + size, x : x + size], int(rng.choice([60, 70, 80])))
    return jpeg(out, 90)


#: Scores of an image that need no trained model; the others are columns made by operators.learning.
SCORERS = {"dummy": contrast, "ela": lambda x: float(1 / (1 + np.exp((ELA_MIDDLE - error_peak(x)) / ELA_WIDTH)))}


def _unavailable(name: str):
    def raises(*_):
        raise NotImplementedError(f"{name} needs a video or audio codec, which this engine does not contain")

    return raises


DEGRADATIONS = {
    "clean": lambda x: x,
    "jpeg75": lambda x: jpeg(x, 75),
    "jpeg50": lambda x: jpeg(x, 50),
    "half": downscale,
    "h264": _unavailable("h264"),
    "mp3": _unavailable("mp3"),
}
