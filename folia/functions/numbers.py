"""Number functions with the rounding that the reports use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab


def even_sample(n: Column, k: int) -> Column:
    """0-based indexes of k rows spread evenly over n, ends included, half rounded to even."""
    m = F.least(n, F.lit(k)).cast("int")
    at = F.transform(F.sequence(F.lit(0), m - 1), lambda i: F.bround(i * (n - 1) / F.greatest(F.lit(1), m - 1)).cast("int"))
    return F.when(n > 0, F.array_sort(F.array_distinct(at))).otherwise(F.array().cast("array<int>"))


def fingerprint_sample(n: Column, want: int = 12) -> Column:
    """The first and last two indexes and ``want`` spread ones; all if there are no more."""
    n = n.cast("int")
    ends = F.array(F.lit(0), F.lit(1), n - 2, n - 1)
    return F.when(n <= 0, F.array().cast("array<int>")).when(n <= want, F.sequence(F.lit(0), n - 1)).otherwise(F.array_sort(F.array_union(ends, even_sample(n, want))))


def mb(size: Column) -> Column:
    return size / F.lit(1048576.0)


def floor_percent(new: Column, old: Column) -> Column:
    return F.when(old > 0, F.floor(new * 100 / old).cast("long"))


def thread_budget(pages: Column, size: Column, cores: int) -> Column:
    """Threads a file deserves by its pages, or by its bytes where they are unknown."""
    half, two = max(2, cores // 2), min(2, max(1, cores))
    by_pages = F.when(pages >= 800, max(1, cores)).when(pages >= 200, half).when(pages >= 50, two).otherwise(1)
    by_size = F.when(mb(size) >= 50, max(1, cores)).when(mb(size) >= 10, half).when(mb(size) >= 2, two).otherwise(1)
    return F.when(F.coalesce(pages, F.lit(0)) > 0, by_pages).otherwise(by_size)


def draining_threads(remaining: Column, workers: int, cores: int) -> Column:
    """Threads when ``remaining`` files are left for ``workers``."""
    return F.greatest(F.lit(1), F.floor(F.lit(cores) / F.greatest(F.lit(1), F.least(F.lit(workers), remaining))).cast("int"))


def class_dpi(images: Column, width: Column, height: Column) -> Column:
    """Largest-image resolution of a page in points; a strip counts by its width."""
    area = (width / 72) * (height / 72)
    whole = F.sqrt(F.array_max(F.transform(images, lambda i: i.w.cast("double") * i.h)) / area)
    strip = F.array_max(F.transform(F.filter(images, lambda i: i.w >= 4 * i.h), lambda i: i.w.cast("double"))) / (width / 72)
    return F.when(F.size(images) > 0, F.greatest(whole, F.coalesce(strip, F.lit(0.0)))).otherwise(F.lit(0.0))


def render_dpi(dpi: Column, base: int = 200, most: int = 400) -> Column:
    return F.greatest(F.lit(base), F.least(F.coalesce(F.nullif(F.bround(dpi).cast("int"), F.lit(0)), F.lit(base)), F.lit(most)))


def page_kind(dpi: Column, visible: Column, coverage: Column, color: Column, ink: Column, threshold: float = 0.02) -> Column:
    """The page's kind by the ladder: vector, photo, coloured line art, blank, line."""
    return (
        F.when((dpi < vocab.SCAN_DPI) | visible, "vector")
        .when((coverage > threshold) & color, "photo_color").when(coverage > threshold, "photo_gray")
        .when(color, "color_line").when(ink < vocab.BLANK_INK, "blank").otherwise("line"))
